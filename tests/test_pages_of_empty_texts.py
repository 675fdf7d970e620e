"""cursor_pages on documents of no, unknown and round lengths, against its SQL."""

import duckdb
import oracle

from vellum.plans import catalog


def test_documents_without_a_length_have_one_page(spark, tmp_path):
    d = spark.createDataFrame([(1, 0), (2, None), (3, 1), (4, 1000), (5, 1001), (6, -2000)], "doc_id long, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.queries()["cursor_pages"](spark, str(tmp_path))
    assert got.where("doc_id in (1, 2, 6)").count() == 3
    assert oracle.compare(got, con, catalog.oracle_sql()["cursor_pages"]) == ""
