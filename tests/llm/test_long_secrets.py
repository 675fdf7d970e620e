"""Secrets longer than any usual token are candidates as a whole."""

import hashlib
import random
import string
import time

import pytest

from vellum.llm import secrets

RNG = random.Random(5)
LETTERS = string.ascii_letters + string.digits


@pytest.mark.parametrize("n", [600, 2000, 100_000])
@pytest.mark.parametrize(("head", "kind"), [("bearer ", "dense"), ("key material ", "dense"), ("password=", "named"), ('"api_key": "', "named")])
def test_whole_value(head, kind, n):
    value = "".join(RNG.choice(LETTERS) for _ in range(n - 2)) + "A1"
    tail = "==" if kind == "dense" else ""
    assert [(a, c, k) for a, c, k, _, _ in secrets.candidates(f"see {head}{value}{tail} and on")] == [(4 + len(head), value + tail, kind)]


def test_scan_digests_the_whole_value(spark, docs_of):
    values = {i: "".join(RNG.choice(LETTERS) for _ in range(n - 2)) + "A1" for i, n in enumerate((600, 2000, 600, 2000))}
    docs = docs_of([(i, ("bearer " if i < 2 else "password=") + v) for i, v in values.items()])
    got = {r.doc_id: (r.length, r.secret_sha256) for r in secrets.scan(docs).collect()}
    assert got == {i: (len(v), hashlib.sha256(v.encode()).hexdigest()) for i, v in values.items()}


def test_long_runs_take_linear_time():
    # no digit, no letter, or a letter of no ASCII at the end: no candidate, found out in one pass
    start = time.perf_counter()
    for text in ("a" * 1_000_000, "1" * 1_000_000, "a1" * 500_000 + "é"):
        assert not list(secrets.candidates(text))
    assert time.perf_counter() - start < 20
