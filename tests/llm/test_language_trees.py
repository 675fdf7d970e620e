"""Language trees: counted in Spark as on the driver, all bytes apart, and what the stage lets go."""

import random

import numpy as np
from pyspark.sql import functions as F

from vellum.llm import langid

RNG = random.Random(8)
SYLLABLES = {"xa": "ka lo mi tu ren sal", "xb": "zwi gro bang dott uhl pef", "xc": "мо сква ве тер"}


def text(lang, n):
    return " ".join("".join(RNG.choice(SYLLABLES[lang].split()) for _ in range(3)) for _ in range(n))


def rows():
    return [(i, text(lang, RNG.randint(5, 60)), lang) for i, lang in enumerate(sorted(SYLLABLES) * 40)]


def test_counts_are_those_of_the_first_rows_by_hash(spark):
    d = spark.createDataFrame([*rows(), (900, None, "xa"), (901, "", "xa"), (902, "none", None)], "doc_id long, text string, lang string")
    for most in (7, 1000):
        taken = {}
        for r in d.where("text <> '' and lang is not null").withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1)).orderBy("h").collect():
            taken.setdefault(r.lang, []).append(r.text)
        want = langid.count_grams({k: v[:most] for k, v in taken.items()})
        got = langid.fit(d.repartition(5), most)
        assert got.langs == want.langs == ["xa", "xb", "xc"]
        for (a, b), (c, e) in zip(got.grams, want.grams, strict=True):
            assert np.array_equal(a, c) and np.array_equal(b, e)


def test_every_byte_is_a_symbol_of_its_own():
    model = langid.Model(langid.count_grams({"a": ["".join(chr(i) for i in range(1, 256)) + "é b " * 40], "b": ["plain text"]}))
    bits = model.code_lengths([" é", " ÿ", " é" * 50])
    assert bits[0, 0] < bits[1, 0] < 40 and bits[2, 0] > bits[0, 0] and bits[0, 1] == bits[1, 1] > 16


def test_the_stage_lets_go_what_no_language_codes(spark):
    known = rows()
    odd = [(500, "日本語のテキストはここにあります。" * 30, "xa"), (501, "Qv9#kz!!w7@@pv~~ZX" * 40, None), (502, "123 456 !!", None), (503, None, "xb")]
    short = [(600, "key=AKIAV26GJEGWEBHTYNN " + text("xa", 3), "xa"), (601, "kalomi", None)]
    d = spark.createDataFrame(known + odd + short, "doc_id long, text string, lang string")
    assert {r.doc_id for r in langid.keep_identified(d).collect()} == {i for i, *_ in known + short}


def test_score_is_of_a_stretch_not_of_the_whole(spark):
    mixed = text("xa", 400) + " " + text("xb", 400)
    d = spark.createDataFrame([*rows(), (700, mixed, None), (701, text("xa", 800), None)], "doc_id long, text string, lang string")
    score = {r.doc_id: r.score for r in langid.identify(d).where("doc_id >= 700").collect()}
    assert 0.5 <= score[700] < score[701] <= 1
