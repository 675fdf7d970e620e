"""Queries that SQL cannot express, against plain Python on the same rows."""

import hashlib
import re

import pytest

from vellum.operators import evaluation
from vellum.plans import catalog

Q = catalog.queries()


def table(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet")


def test_rate_limited_equals_a_loop_over_each_user(spark, data):
    rows = sorted((r.user_id, r.ts.timestamp(), r.event_id) for r in table(spark, data, "events").where("user_id is not null").collect())
    want, user = {}, None
    for u, t, e in rows:
        if u != user:
            user, left, last = u, 5.0, t
        left, last = min(5.0, left + (t - last) / 3600), t
        want[e] = (u, left >= 1)
        left -= left >= 1
    got = {r.event_id: (r.user_id, r.allowed) for r in Q["rate_limited"](spark, data).collect()}
    assert got == want and {x for _, x in want.values()} >= {True}


def test_chunks_of_plain_documents(spark, data):
    texts = {r.doc_id: r.text for r in table(spark, data, "documents").collect()}
    got = {}
    for r in Q["split_long_text"](spark, data).collect():
        got.setdefault(r.doc_id, []).append(r)
    marked = re.compile(r"^\s*(#|```|~~~|\$\$|\\\[|\|)", re.M)
    short = [i for i, t in texts.items() if t.strip() and len(t.strip()) <= 1700 and not marked.search(t)]
    assert len(short) > 20
    for i in short:
        assert [r.digest for r in got[i]] == [hashlib.sha256(texts[i].strip().encode()).hexdigest()]
    for rows in got.values():
        assert sorted(r.chunk_index for r in rows) == list(range(len(rows))) and all(0 < r.n_chars <= 1700 and r.part_index < r.part_total for r in rows)
    long_ = [i for i, t in texts.items() if len(t) > 5000 and not marked.search(t)]
    # pieces overlap, so together they are at least as long as the text, and not half as long again
    assert long_ and all(0.9 * len(texts[i]) <= sum(r.n_chars for r in got[i]) <= 1.5 * len(texts[i]) for i in long_)


def test_abstracts_are_beginnings_of_what_documents_say(spark, data):
    texts = {r.doc_id: " ".join(r.text.split()) for r in table(spark, data, "documents").collect()}
    rows = Q["abstracts"](spark, data).collect()
    assert len(rows) == len(texts) and all(len(r.abstract) <= 600 for r in rows)
    plain = re.compile(r"[<#*_`]")
    assert all(" ".join(r.abstract.split()) in texts[r.doc_id] for r in rows if not plain.search(texts[r.doc_id]))


def test_interval_holds_the_mean_and_does_not_depend_on_partitions(spark, data):
    values = [r.value for r in table(spark, data, "events").collect() if r.value is not None]
    got = Q["value_interval"](spark, data).first()
    again = evaluation.bootstrap_interval(table(spark, data, "events").repartition(7), "value", 50, key="event_id").first()
    assert got.mean == pytest.approx(sum(values) / len(values)) and got.low < got.mean < got.high
    assert (got.low, got.high) == pytest.approx((again.low, again.high))


def test_elements_of_pages_are_those_a_parser_opens(spark, data):
    from collections import Counter
    from html.parser import HTMLParser

    seen = Counter()

    class Tags(HTMLParser):
        def handle_starttag(self, tag, attrs):
            seen[tag] += 1

    for r in table(spark, data, "pages").collect():
        p = Tags()
        p.feed(r.html or "")
    got = {r.tag: r.n for r in Q["structured_pages"](spark, data).collect()}
    assert got and all(n <= seen[tag] for tag, n in got.items()) and got.get("p", 0) > 0
