import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, h string, s string, part string, shard string, fp string, item_id string, __vl_note string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) pairs, with further columns whose names clash with what operators use inside."""

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t), "k", "h", "s", "p", "x", "f", "i", "n") for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


LONG = " ".join(f"word{i % 997} and more{i % 31}" for i in range(20000))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    return [(1, None), (2, ""), (3, "   \n\t"), (4, LONG), (5, "a"), (5, "a"), (6, "same text for two of them"), (7, "same text for two of them"), (None, "no id at all"), (None, None), (8, "日本語のテキスト ß é \U0001f600")]
