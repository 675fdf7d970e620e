import subprocess
import sys


def test_entry_and_catalogue(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["item_id", "doc_id", "fused", "rank"]


def test_entry_without_the_training_data_operators(tmp_path):
    """What is left without that subpackage and the pipeline imports and names its queries."""
    import os
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/vellum", tmp_path / "vellum", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_docs' in q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
