"""Line dedup against every pair of documents, where all lines are frequent."""

import random

from vellum.llm import linededup


def plain_removed(rows):
    hashed = {i: linededup.line_hashes(t) for i, t in rows}
    return {i: len({p for a in hashed if a < i for p in linededup.common_lines(hashed[a][0], hashed[i][0], hashed[i][1])}) for i in hashed}


def test_block_of_frequent_lines_goes(spark):
    rows = [(1, "l1\nx"), (2, "l2\ny"), (3, "l3\nz"), *((10 + i, f"own {i}\nl1\nl2\nl3\ntail {i}") for i in range(9))]
    got = {r.doc_id: r.n_removed for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_removed(rows) == {1: 0, 2: 0, 3: 0, 10: 0} | {10 + i: 3 for i in range(1, 9)}


def test_equals_all_pairs(spark):
    rng, rows = random.Random(6), []
    # lines keep one order, so that every alignment has all common lines; some pairs of lines reach the length in characters
    pool = [f"line {i} " + "x" * rng.choice((1, 1, 30, 60, 110)) for i in range(12)]
    for d in range(120):
        lines = []
        for x in pool:
            if rng.random() < 0.5:
                lines.append(x)
            elif rng.random() < 0.3:
                lines.append(f"own {d} {len(lines)}")
        rows.append((d, "\n".join(lines)))
    got = {r.doc_id: r.n_removed for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_removed(rows)
