"""Evaluation on merged passages: against passages compared one by one, and how many rows meet."""

import random

import pytest

from textloom.operators import matches

COLUMNS = "match_id long, docid string, start long, end long"


def by_hand(gold, test):
    """(g, t, docid, gs, ge, ts, te) of overlapping passages and the pairs that meet in two documents."""
    o = {(g, t, d, a, b, x, y) for g, d, a, b in gold for t, e, x, y in test if d == e and None not in (d, a, b, x, y) and a <= y and x <= b}
    docs = {}
    for g, t, d, *_ in o:
        docs.setdefault((g, t), set()).add(d)
    return o, {k for k, v in docs.items() if len(v) > 1}


def ratio(a, b):
    return a / b if b else 0.0


def scores(r, p):
    return [round(x, 6) for x in (r, p, 2 * r * p / (r + p) if r + p else 0.0)]


def random_side(rnd, n, inverted):
    rows = set()
    while len(rows) < n:
        s = rnd.randint(-5, 2500)
        rows.add((rnd.randint(0, 5), rnd.choice("abc"), s, s + (rnd.randint(-4, 60) if inverted else rnd.choice([0, 1, 7, 60, 900]))))
    return [*rows, (1, "a", None, 4), (2, None, 3, 9)]


@pytest.mark.parametrize("seed, n, inverted", [(1, 6, False), (2, 25, False), (3, 60, False), (4, 25, True), (5, 0, False)])
def test_scores_by_hand(spark, seed, n, inverted):
    rnd = random.Random(seed)
    gold, test = random_side(rnd, n, inverted), random_side(rnd, n, inverted)
    o, same = by_hand(gold, test)
    g, t = (spark.createDataFrame(x, COLUMNS) for x in (gold, test))
    assert {tuple(r) for r in matches.overlaps(g, t).select("g", "t", "docid", "gs", "ge", "ts", "te").collect()} == o
    assert {tuple(r) for r in matches.identical(g, t).collect()} == same
    j = [x for x in o if (x[0], x[1]) in same]

    def covered(k):
        spans = {(x[2], x[k], x[k + 1]) for x in j}
        chars = {(x[2], x[k], x[k + 1], c) for x in j for c in range(max(x[3], x[5]), min(x[4], x[6]) + 1)}
        return ratio(len(chars), sum(e - s + 1 for _, s, e in spans)), len(spans)

    (r, ng), (p, nt) = covered(3), covered(5)
    assert [*matches.score_characters(g, t).first()] == scores(r, p)
    every = [sum(m in {x[k] for x in same} for m, *_ in side) for k, side in ((0, gold), (1, test))]
    assert [*matches.score_clusters(g, t).first()] == scores(ratio(ng, every[0]), ratio(nt, every[1]))
    size = lambda side, m: sum(e - s for k, _, s, e in side if k == m and None not in (s, e))
    want = {}
    for a, b in same:
        n = sum(min(x[4], x[6]) - max(x[3], x[5]) for x in j if x[:2] == (a, b))
        r, p = ratio(n, max(0, size(gold, a))), ratio(n, max(0, size(test, b)))
        want[a, b] = [round(x, 6) for x in (r, p, 2 * r * p / (p + r) if r + p > 0 else 0.0)]
    assert {(x.g, x.t): [x.r, x.p, x.f] for x in matches.pair_overlap(g, t).collect()} == want
    hits = {}
    for x in o:
        hits.setdefault(x[:2], set()).add((x[2], *x[5:]))
    want = {(a, b): round(len(v) / sum(m == b for m, *_ in test), 6) for (a, b), v in hits.items()}
    assert {(x.g, x.t): x.precision for x in matches.pair_precision(g, t).collect()} == want


def test_rows_that_meet(spark):
    """Passages of a match that overlap meet as one: the rows do not grow with the square of the passages."""
    side = lambda n: spark.range(n).selectExpr("id % 3 as match_id", "cast(id % 2 as string) as docid", "id % 1000 as start", "id % 1000 + 40 as end")
    assert matches.common(side(3000), side(3000)).count() == matches.common(side(30000), side(30000)).count() <= 3 * 3 * 2 * 2
    assert matches.stretch_of(side(30)) == 64


def test_segments_in_batches(spark):
    """A segment goes on over batches of rows; no document is a group of its own in Python."""
    texts = ["ab$segstart_1_free_2$cd", "ef", "", "g$segend_1$h$segstart_2_literal_1&3$", "i$segstart_3$j$segend_2$k", "l"]
    rows = spark.createDataFrame([(d, k, t) for d in ("x", "y") for k, t in enumerate(texts)], "docid string, row_idx int, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = matches.parse_segments(rows)
        want = [("1", 2, 3, "cd"), ("1", 0, 1, "ef"), ("1", 0, 0, "g"), ("2", 0, 1, "ij"), ("3", 1, 2, "jk"), ("3", 0, 0, "l")]
        assert sorted((r.docid, r.seg, r.start, r.end, r.text) for r in got.collect()) == sorted((d, *w) for d in "xy" for w in want)
        assert "FlatMapGroups" not in got._jdf.queryExecution().toString()
        # x and y hold each segment: 1 and 2 mean each other (three passages and one, each named in every document), 2 means 3 (two)
        assert matches.gold_matches(got).where("match_id = '3-2'").count() == 2 * 4 + 2 * 2
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
