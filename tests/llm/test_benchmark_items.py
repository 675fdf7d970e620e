"""Short, equal and very many benchmark items: what is found does not depend on how they are dealt into blocks."""

import random

from test_brute_force import plain_distance

from vellum.llm import decontam


def tables(spark):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    items = {i: [rng.choice(vocabulary) for _ in range(rng.randint(1, 25))] for i in range(20)}
    items |= {100 + i: items[i] for i in range(10)} | {200: ["W1", "w2!", "w3"], 201: ["w1", "w2", "w3"]}
    docs = {}
    for d in range(60):
        w = list(items[d % 20])
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w))
            w[at : at + 1] = rng.choice(([], ["new"], [w[at], "more"]))
            w = w or ["none"]
        docs[d] = ["q"] * rng.randint(0, 9) + w + [rng.choice(vocabulary) for _ in range(rng.randint(0, 30))]
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(300, None), (301, " .. "), (None, "w1")], "item_id long, text string")
    return items, docs, spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string"), bench


def plain(items, docs, errors, least_words):
    first = {}
    for i, w in sorted(items.items()):
        first.setdefault(tuple(decontam.words_of(" ".join(w))), i)
    return {(d, i): n for d, text in docs.items() for w, i in first.items() if (n := plain_distance(w, text)[0]) <= (int(errors * len(w)) if len(w) >= least_words else 0)}


def test_blocks_do_not_change_what_is_found(spark):
    items, docs, df, bench = tables(spark)
    want = plain(items, docs, 0.2, 5)
    assert any(i == 200 for _, i in want) or not any(i == 201 for _, i in want)
    for block in (30, 1 << 20):
        assert {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(df, bench, block=block).collect()} == want
        assert {r.doc_id for r in decontam.drop_leaking(df, bench, block=block).collect()} == set(docs) - {d for d, _ in want}


def test_least_words_is_where_errors_begin(spark):
    items, docs, df, bench = tables(spark)
    assert {(r.doc_id, r.item_id): r.distance for r in decontam.leaks(df, bench, 0.3, 8).collect()} == plain(items, docs, 0.3, 8)
    six = "one two three four five six"
    assert decontam.Index([(1, six)], 0.2, 8).matches(f"so {six} go") == [(1, 0, 6, 1, 6)] and decontam.Index([(1, six)], 0.2, 8).matches("one two three four five") == []
