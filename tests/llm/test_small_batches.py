"""The pipeline's stages bound what goes to a Python worker at once, whatever the session had."""

import corpus_pipeline
import pyarrow as pa
import pytest

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def settings(spark):
    before = {k: spark.conf.get(k) for k in (ROWS, BYTES)}
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_stages_work_in_small_batches(spark, docs_of, settings):
    spark.conf.set(ROWS, "10000")
    assert corpus_pipeline.STAGES[-1][1](spark, docs_of([(1, "some words"), (2, None)]), "").count() == 2

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    got = [r.n for r in spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n long").collect()]
    assert sum(got) == 5000 and max(got) <= 2000
    assert int(spark.conf.get(BYTES).rstrip("b")) <= 8 << 20


def test_smaller_settings_stay(spark, docs_of, settings):
    spark.conf.set(ROWS, "7")
    spark.conf.set(BYTES, "4096")
    corpus_pipeline.STAGES[-1][1](spark, docs_of([(1, "some words")]), "").count()
    assert (spark.conf.get(ROWS), spark.conf.get(BYTES).rstrip("b")) == ("7", "4096")
