"""Every operator on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import hashlib

import pytest
from pyspark.sql import functions as F

from vellum.llm import decontam, langid, linededup, packing, secrets, simhash, spotsigs, sstable, substrings, warc

PER_ROW = {
    "line_dedup": linededup.report,
    "simhash": simhash.near_duplicates,
    "spotsigs": spotsigs.with_next,
    "substrings": substrings.report,
    "tables": sstable.round_trip,
    "language": langid.identify,
}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_one_row_each(docs_of, odd_rows, name):
    got = PER_ROW[name](docs_of(odd_rows)).select("doc_id").collect()
    assert sorted(repr(r.doc_id) for r in got) == sorted(repr(i) for i, _ in odd_rows)


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_empty_table(docs_of, name):
    assert PER_ROW[name](docs_of([])).count() == 0


def test_empty_tables_of_the_others(spark, docs_of):
    none = docs_of([])
    items = spark.createDataFrame([], "item_id long, text string")
    assert packing.pack(none).count() == 0 and secrets.scan(none).count() == 0 and decontam.leaks(none, items).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert langid.keep_identified(none).count() == linededup.drop_common_lines(none).count() == simhash.keep_first(none).count() == decontam.drop_leaking(none, items).count() == 0


def test_stages_keep_columns(spark, docs_of, odd_rows):
    d = docs_of(odd_rows)
    items = spark.createDataFrame([(1, "same text for two of them"), (2, None), (None, "x"), (3, "")], "item_id long, text string")
    for out in (langid.keep_identified(d), linededup.drop_common_lines(d), simhash.keep_first(d), decontam.drop_leaking(d, items)):
        assert out.columns == d.columns and out.count() >= 1


def test_packing_of_odd_rows(docs_of, odd_rows):
    got = packing.pack(docs_of(odd_rows)).collect()
    assert sorted({repr(r.doc_id) for r in got}) == sorted({repr(i) for i, _ in odd_rows})
    assert sum(r.doc_id == 5 for r in got) == 2 and all(1 <= r.length <= 2048 for r in got)


def test_secrets_of_odd_rows(docs_of, odd_rows):
    key = "AKIA" + "Q3XN7TPLM2ZK8VRC"
    rows = [*odd_rows, (20, f"é {key} end"), (20, f"é {key} end"), (21, "password=changeme please")]
    got = secrets.scan(docs_of(rows).drop("source")).where("doc_id >= 20").collect()
    found = [(r.doc_id, r.start, r.length, r.is_secret) for r in got if r.is_secret]
    assert found == [(20, 2, 20, True)] * 2 and any(r.doc_id == 21 and not r.is_secret for r in got)
    assert {r.secret_sha256 for r in got if r.doc_id == 20} == {hashlib.sha256(key.encode()).hexdigest()}


def test_decontamination_of_odd_rows(spark, docs_of, odd_rows):
    items = spark.createDataFrame([(1, "same text for two of them"), (2, "SAME text, for two of them!"), (3, None), (4, ""), (None, "x"), (5, "a")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.distance) for r in decontam.leaks(docs_of(odd_rows), items).collect())
    assert got == [(5, 5, 0), (5, 5, 0), (6, 1, 0), (7, 1, 0)]


def test_warc_of_odd_rows(spark):
    body = "x" * 200
    rows = [(3, "http://a/\r\nX: 1%", body), (1, None, body), (1, None, body), (2, "u", None), (4, "u", ""), (None, "v", body), (5, "u", "short"), (6, "u", "short"), (None, None, None)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), shard=300, roll=200)
    seen = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to, r.url) for r in got.collect()), key=repr)
    want = [(3, 200, "revisit", 1, "http://a/\r\nX: 1%"), (1, 200, "response", None, None), (1, 200, "response", None, None), (2, 0, "response", None, "u"), (4, 0, "response", None, "u"), (None, 200, "revisit", 1, "v"), (5, 5, "response", None, "u"), (6, 5, "response", None, "u"), (None, 0, "response", None, None)]
    assert seen == sorted(want, key=repr)
    assert got.where(F.col("page_id") == 3).first().payload_digest == hashlib.sha256(body.encode()).hexdigest()
