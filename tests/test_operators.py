"""Small tables with answers that can be seen."""

import datetime

import pytest
from pyspark.sql import functions as F

from vellum.functions import identifiers as I
from vellum.functions import text as T
from vellum.functions import vectors as V
from vellum.operators import chunking, components, dense, fusion, graph, lexical, quality, ranking, registry, sinks, twins
from vellum.sources import formats
from vellum.streaming import events as S


def values(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_rrf_sums_votes(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "q int, d string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "q int, d string, rank int")
    got = {r.d: r.fused for r in fusion.rrf([(a, 1.0), (b, 0.5)], "q", "d").collect()}
    assert got == {"x": round(1 / 61, 9), "y": round(1 / 62 + 0.5 / 61, 9)}


def test_bm25_prefers_rare_words(spark):
    d = spark.createDataFrame([(1, "apple pear"), (2, "apple apple"), (3, "plum"), (4, None), (5, "")], "doc_id long, text string")
    q = spark.createDataFrame([(9, "Pear, apple?")], "item_id long, text string")
    got = {r.doc_id: r.score for r in lexical.bm25(d, q).collect()}
    assert set(got) == {1, 2} and got[1] > got[2] > 0


def test_dense_blocks_ties_and_nulls(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)], "vec_id long, embedding array<float>")
    got = [(r.qid, r.vec_id, r.score) for r in lexical.top(dense.scores(v, v.where("vec_id = 1")), "qid", 5, [F.desc("score"), "vec_id"]).orderBy("rank").collect()]
    assert got == [(1, 3, 1.0), (1, 2, 0.0)]
    assert dense.scores(v, v.where("vec_id > 9")).count() == 0


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>").select(V.norm(F.col("a")).alias("n"), V.unit(F.col("a")).alias("u"), V.cosine(F.col("a"), F.col("z")).alias("c"), V.unit(F.col("z")).alias("z")).first()
    assert (r.n, list(r.u), r.c, list(r.z)) == (5.0, [0.6, 0.8], 0.0, [0.0, 0.0])


@pytest.mark.parametrize(("caps", "total", "want"), [((5, 1, 9), 6, (3, 1, 2)), ((0, 0, 0), 4, (0, 0, 0)), ((9, 9, 9), 4, (2, 1, 1)), ((1, 1, 1), 9, (1, 1, 1))])
def test_water_fill(spark, caps, total, want):
    d = spark.createDataFrame([(dict(zip("abc", caps, strict=True)),)], "m map<string,long>")
    r = d.select(ranking.water_fill(F.col("m"), list("abc"), total).alias("s")).first().s
    assert tuple(r[k] for k in "abc") == want


def test_relaxed_keeps_exact_first(spark):
    d = spark.createDataFrame([(1, "a", 1), (1, "b", 9), (2, "a", 9), (2, "b", 9)], "q int, c string, n int")
    f = {"c": F.col("c") == "a", "n": F.col("n") > 5}
    got = sorted((r.q, r.c, r.plan) for r in ranking.relaxed(d, ["q"], f, 1).collect())
    assert got == [(1, "b", 1), (2, "a", 0)]


def test_inject_and_named_places(spark):
    r = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "q int, d string, rank int")
    x = spark.createDataFrame([(1, "x")], "q int, d string")
    assert [y.d for y in fusion.inject(r, "q", x, 3).orderBy("rank").collect()] == ["a", "b", "x", "c"]
    got = ranking.place_named(r, "q", F.col("d") == "c", F.col("d") == "none").orderBy("place").collect()
    assert [y.d for y in got] == ["c", "a", "b"]


def test_components_and_links(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (2, 2)], "a long, b long")
    assert {r.node: r.root for r in components.connected_components(e).collect()} == {2: 2, 3: 2, 4: 2, 5: 2, 8: 8, 9: 8}
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 7), (9, 7)], "a long, b long")
    assert {r.node: (r.target, r.cyclic) for r in graph.follow_links(links).collect()} == {1: (3, False), 2: (3, False), 7: (7, True), 8: (7, True), 9: (7, True)}


def test_reading_status(spark):
    rows = [(0, 0, 0, 0, "unread"), (1, 1, 0, 2, "contested"), (1, 0, 0, 1, "read_once"), (2, 0, 0, 2, "confirmed_prior_art"), (0, 2, 0, 2, "ruled_out"), (2, 0, 0, 1, "agreed_same_model"), (2, 0, 0, 0, "read_once")]
    d = spark.createDataFrame(rows, "a int, d int, p int, m int, want string")
    assert d.where(registry.reading_status(F.col("a"), F.col("d"), F.col("p"), F.col("m")) != F.col("want")).count() == 0


def test_upsert_and_merge(spark):
    old = spark.createDataFrame([("k", 1, "old")], "k string, at int, v string")
    new = spark.createDataFrame([("k", 2, "new"), ("j", 1, None)], "k string, at int, v string")
    assert sorted((r.k, r.v) for r in registry.upsert(old, new, ["k"], ["at"]).collect()) == [("j", None), ("k", "new")]
    a = spark.createDataFrame([("1", "t", ["x"])], "id string, title string, layers array<string>")
    b = spark.createDataFrame([("1", "", ["y"]), ("2", "u", ["z"])], "id string, title string, layers array<string>")
    assert sorted((r.id, r.title, tuple(r.layers)) for r in registry.merge_discovered(a, b, "id", ["title"], ["layers"]).collect()) == [("1", "t", ("x", "y")), ("2", "u", ("z",))]


def test_quality_ladder(spark):
    d = spark.createDataFrame([(6, 3, 0, "pass"), (6, 2, 0, "defer"), (70, 149, 0, "reject"), (70, 75, 4, "pass"), (30, 8, 4, "pass"), (30, 0, 6, "pass"), (5, 0, 3, "pass")], "age int, c int, n int, want string")
    assert d.where(quality.quality_verdict(F.lit(False), F.col("c"), F.lit(None).cast("int"), F.col("age"), F.col("n"), F.lit(False)) != F.col("want")).count() == 0


def test_text_functions(spark):
    assert values(spark, "A Title: the  Best-of!", T.title_key) == "a title the best of"
    assert values(spark, "exam-\nple text\nhere\n\n\nnext", T.normalize_pdf) == "example text here\n\nnext"
    assert values(spark, "one two three four", lambda c: T.clip(c, 9)) == "one two…"
    assert values(spark, "First sentence. Second one is longer than that", lambda c: T.sentence_truncate(c, 25)) == "First sentence."
    assert values(spark, '["a", "b", null, "a"]', T.string_list) == ["a", "b"]
    assert values(spark, "{broken", T.string_list) == []
    assert values(spark, "<p>a&nbsp;b</p><script>x<y</script>", T.html_to_text).split() == ["a", "b"]
    assert values(spark, "See EIP-1559, ERC 20 and SIMD-33; 2023/101, arXiv:2101.00001", I.extract_ids) == ["eip:1559", "eip:20", "simd:0033", "iacr:2023/101", "2101.00001"]
    assert values(spark, "eip:20", I.source_url) == "https://eips.ethereum.org/EIPS/eip-20"
    assert values(spark, "Related Work and Results", T.section_type) == "related_work"


def test_formats(spark, tmp_path):
    fm = values(spark, "---\ntitle: A: b\nstatus: draft\n---\nbody", formats.front_matter)
    assert fm == {"title": "A: b", "status": "draft"}
    (tmp_path / "a.xml").write_text('<x><record><header status="deleted"><identifier>i1</identifier></header></record><record><header><identifier>i2</identifier></header><metadata><dc><title>T  t</title><description>D</description><date>2020-01-02</date></dc></metadata></record></x>')
    got = sorted((r.id, r.title, r.year, r.deleted) for r in formats.harvest_records(spark, str(tmp_path)).collect())
    assert got == [("i1", None, None, True), ("i2", "T t", 2020, False)]
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "p.html").write_text("<b>x</b>")
    assert formats.documents(spark, str(tmp_path / "h")).first().text.strip() == "x"
    assert values(spark, "T\n===\n``x`` `a <b>`_", formats.rst_to_markdown) == "# T\n`x` [a](b)"


def test_chunking(spark):
    md = "# A\nintro\n\n```py\ncode\n```\n## B\n$$\nx\n$$\n|a|b|\n|-|-|\n|1|2|\nend"
    assert chunking.markdown_elements(md) == [("A", "prose", "intro"), ("A", "code", "```py\ncode\n```"), ("A > B", "equation", "$$\nx\n$$"), ("A > B", "table", "|a|b|\n|-|-|\n|1|2|"), ("A > B", "prose", "end")]
    assert [len(x) for x in chunking.split_long("x" * 4000)] == [1700, 1700, 1110]
    assert "".join(chunking.split_long("short")) == "short"
    assert chunking.latex_elements("a % gone\n\\section{S}\\begin{equation}x\\end{equation}b") == [("", "prose", "a"), ("S", "equation", "\\begin{equation}x\\end{equation}"), ("S", "prose", "b")]
    d = spark.createDataFrame([(1, md), (2, None), (3, "")], "doc_id long, text string")
    assert chunking.chunk(d).count() == 5
    c = spark.createDataFrame([(1, r"see \cite{a, b} and [3]")], "doc_id long, text string")
    assert sorted(r.key for r in chunking.citation_contexts(c).collect()) == ["3", "a", "b"]


def test_fuzzy_twins(spark):
    words = "one two three four five six seven eight nine ten".split()
    d = spark.createDataFrame([(1, words), (2, words[:9]), (3, words[:4]), (4, words), (5, ["x"])], "doc_id long, w array<string>")
    pairs, members = twins.fuzzy_pairs(d, "doc_id", "w")
    assert [(r.a, r.b, r.jaccard) for r in pairs.collect()] == [(1, 2, 0.9)]
    assert {r.doc_id: r.canonical for r in twins.groups(pairs, members, "doc_id").collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_stream_equals_batch(spark, data, tmp_path):
    e = spark.read.parquet(f"{data}/events.parquet")
    e.repartition(4).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    S.run_once(S.tumbling(S.stream(spark, str(tmp_path / "in"))), out, str(tmp_path / "cp"), "complete")
    last = spark.read.parquet(out)
    last = last.where(F.col("epoch") == last.agg(F.max("epoch")).first()[0]).drop("epoch")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, S.tumbling(e).collect()))


def test_stream_drops_repeated_events(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([(1, t, 1, "a", 1.0, "{}"), (1, t, 1, "a", 1.0, "{}"), (2, t, 1, "b", 2.0, "{}")], S.SCHEMA).write.parquet(str(tmp_path / "in"))
    S.run_once(S.deduplicated(S.stream(spark, str(tmp_path / "in")), ["event_id"], "1 day"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_token_bucket():
    out, tokens, at = S.take([0, 0, 0, 3600], [1, 2, 3, 4], 2.0, None, 2.0, 1 / 3600)
    assert [x[1] for x in out] == [True, True, False, True] and tokens == 0 and at == 3600


def test_snapshots(spark, tmp_path):
    from vellum.operators import sinks

    root, d = f"file://{tmp_path}/s", spark.createDataFrame([(1, "a")], "k int, v string")
    assert sinks.current(spark, root)["version"] == 0 and sinks.publish(d, root, expected=0) == 1
    assert sinks.publish(sinks.replace_keys(sinks.read(spark, root), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), ["k"]), root) == 2
    assert sorted(map(tuple, sinks.read(spark, root).collect())) == [(1, "b"), (2, "c")]
    with pytest.raises(ValueError):
        sinks.publish(d, root, expected=1)
    bad = spark.createDataFrame([("p", 0, "x", [1.0, 2.0]), ("p", 0, " ", [1.0, float("nan")]), ("q", -1, "y", [1.0])], "paper_id string, chunk_index int, text string, vector array<double>")
    assert sorted((r.paper_id, r.reason) for r in sinks.violations(bad, 2).collect()) == [("p", "no_text"), ("p", "not_finite"), ("p", "repeated_index"), ("q", "bad_index"), ("q", "wrong_dimension")]
    t = spark.createDataFrame([([("a", None)],), ([("a", "b")],), ([("z", None)],)], "i array<struct<born:string,retired:string>>")
    assert [r.x for r in t.select(sinks.committed("i", ["a", "b"]).alias("x")).collect()] == [True, False, False]


def test_rerank_and_rescue(spark):
    from vellum.operators import search

    hits = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "q int, id string, rank int")
    logits = spark.createDataFrame([(1, "c", 0.1), (1, "c", 0.9), (1, "b", 0.5)], "q int, id string, logit double")
    assert [r.id for r in search.rescored(hits, logits).orderBy("rerank").collect()] == ["c", "b", "a"]
    chunks = spark.createDataFrame([(1, "b", 0.3), (1, "b", 0.4), (1, "a", 0.9)], "q int, id string, score double")
    assert [(r.id, r.score) for r in search.rescued(hits, hits.where("id <> 'b'"), chunks).collect()] == [("b", 0.4)]


def test_structured_html(spark):
    from vellum.sources import structured

    page = "<table><tr><td rowspan=2>a<td>b</tr><tr><td>c</tr></table><script>x</script><p>end"
    n = structured.nodes(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string"))
    assert [(r.text, r.grid_row, r.grid_col) for r in n.where("tag = 'td'").orderBy("node").collect()] == [("a", 0, 0), ("b", 0, 1), ("c", 1, 1)]
    assert structured.search_text(n).first().text == "a | b | c | end"
    assert structured.nodes(spark.createDataFrame([(1, page)], "page_id long, html string"), most_nodes=2).where("truncated").count() == 2


def test_word_overlap_and_interval(spark):
    from vellum.operators import evaluation

    d = spark.createDataFrame([("a b c", "b c d"), ("a b", "c d"), ("x", "x")], "l string, r string")
    assert [r.n for r in d.select(T.word_overlap(F.col("l"), F.col("r")).alias("n")).collect()] == [2, 0, 1]
    r = evaluation.bootstrap_interval(spark.range(200).select(F.col("id").cast("double").alias("v")), "v", 100).first()
    assert r.mean == 99.5 and 80 < r.low < 99.5 < r.high < 120


def test_last_helpers(spark):
    from vellum.operators import generation

    assert values(spark, "aaa", lambda c: T.occurrences(c, "aa")) == 2
    assert values(spark, "gh:spark:docs/x", T.project_key) == "spark" and values(spark, "eip:1", T.project_key) is None
    a, b = (spark.createDataFrame([(v,)], "v array<float>").select(T.vector_sha256(F.col("v")).alias("x")).first().x for v in ([0.5, 1.0], [0.5, 1.1]))
    assert len(a) == 64 and a != b
    reps = spark.createDataFrame([(1, "s", "s", "own_passage"), (2, "s", "o", "citation_context"), (3, "t", "t", "own_passage")], "rep_id int, source string, owner string, kind string")
    src = spark.createDataFrame([("s", 2020), ("t", 1999)], "source string, year int")
    assert [r.rep_id for r in generation.qualified(reps, src, src.where("source <> 'o'"), F.col("year") > 2000).collect()] == [1]


def test_parts_and_shared_tasks_are_no_twins(spark):
    titles = {1: "on the deep learning of large graphs part i", 2: "on the deep learning of large graphs part ii", 3: "deep learning of large graphs part i again", 4: "semeval system for deep text learning tasks", 5: "semeval system for deep text learning task"}
    d = spark.createDataFrame(list(titles.items()), "doc_id long, title string").select("doc_id", T.title_tokens(F.col("title")).alias("w"))
    pairs, _ = twins.fuzzy_pairs(d, "doc_id", "w")
    assert {(r.a, r.b) for r in pairs.collect()} == {(1, 3)}


def test_citation_markers_each_have_their_context(spark):
    text = "words before it that are long enough to be of use \\cite{k, m} and words between them that go on and on [3] and [3] end"
    got = [(r.marker, r.key, r.context) for r in chunking.citation_contexts(spark.createDataFrame([(1, text), (2, None), (3, "none")], "doc_id long, text string")).orderBy("marker", "key").collect()]
    parts = text.replace("\\cite{k, m}", "|").replace("[3]", "|").split("|")
    assert got == [(0, "k", f"{parts[0]}[CITE]{parts[1]}"), (0, "m", f"{parts[0]}[CITE]{parts[1]}"), (1, "3", f"{parts[1]}[CITE]{parts[2]}"), (2, "3", f"{parts[2]}[CITE]{parts[3]}")]
    assert {r.marker for r in chunking.citation_contexts(spark.createDataFrame([(1, text)], "doc_id long, text string"), usable=True).collect()} == {0}


def test_a_publication_that_died_leaves_the_version_before_it(spark, tmp_path):
    root, d = str(tmp_path / "p"), spark.range(3)
    assert sinks.publish(d, root) == 1
    (tmp_path / "p" / "versions" / "00000002").write_text("")
    assert sinks.current(spark, root)["version"] == 1 and sinks.publish(d.limit(1), root, expected=1) == 3 and sinks.read(spark, root).count() == 1


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from vellum.session import shared_dir

    far = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(far)
