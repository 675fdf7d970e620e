"""The pipeline's stages on planted documents, each on its own input, and the whole on driver tables."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from test_near_sets import plain_kept

from vellum.llm import decontam

RNG = random.Random(4)
SYLLABLES = "ka lo mi tu ren sal vor pim da ne".split()


def prose(n):
    return " ".join(RNG.choice(("the", "of", "and", "to")) if RNG.random() < 0.3 else "".join(RNG.choice(SYLLABLES) for _ in range(3)) for _ in range(n))


def planted(spark, tmp_path):
    item = "seven quick auditors weigh nine heavy ledgers beneath the copper dome before noon"
    clean = {i: "\n".join(prose(40) for _ in range(3)) for i in range(30)}
    near = clean[3].split(" ")
    near[len(near) // 2] = "changed"
    rows = {
        **clean,
        40: clean[1],
        41: clean[2] + "\n" + prose(60),
        42: " ".join(near),
        43: prose(30) + "\n" + item + " " + prose(20),
        44: prose(20) + " " + item.replace("heavy", "light") + " " + prose(20),
        45: "1234 5678 !!",
        46: None,
    }
    d = spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return rows, clean


def test_stages_on_planted_documents(spark, tmp_path):
    rows, clean = planted(spark, tmp_path)
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = {r.doc_id: (r.text if "text" in docs.columns else None) for r in docs.collect()}
    assert set(seen["language_id"]) == set(rows) - {45, 46}
    assert set(seen["line_dedup"]) == set(seen["language_id"]) - {40}
    assert seen["line_dedup"][41] == rows[41].removeprefix(rows[2] + "\n") and all(seen["line_dedup"][i] == t for i, t in clean.items())
    assert {43, 44}.isdisjoint(seen["decontamination"])
    assert set(clean) <= set(seen["packing"]) == set(seen["decontamination"])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]


def test_near_stage_keeps_one_of_each_group(spark, tmp_path):
    planted(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {r.doc_id for r in corpus_pipeline.dedup_near(spark, docs, str(tmp_path)).collect()}
    # 42 is 3 with one word changed: a Jaccard of 0.92 over five-word shingles
    assert 1 in kept and 3 in kept and {40, 42}.isdisjoint(kept)
    assert kept == plain_kept([(r.doc_id, r.text) for r in docs.collect()])


def test_run_equals_its_stages(spark, data):
    got = corpus_pipeline.run(spark, data)
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and 0 < len(kept) < docs.count()
    leaking = {r.doc_id for r in decontam.leaks(docs, spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    copies = {r.doc_id for r in docs.join(docs.groupBy("text").agg(F.min("doc_id").alias("first")), "text").where("doc_id > first").select("doc_id").collect()}
    assert leaking.isdisjoint(kept) and copies.isdisjoint(kept)
