"""Passages in characters, batched alignment, chains of predecessors, clusters: against plain versions."""

import random
import re
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textloom.operators import detect

TEXTS = ["Der Häuser 12 und  1300 schöne\nStraßen, am É-x. a", "", "...", "ab", "x y zz", None, "İstanbul ünd 7 wörter"]


def test_located_tokens(spark):
    docs = spark.createDataFrame([("s", str(k), t) for k, t in enumerate(TEXTS)], "series string, docid string, text string")
    got = sorted((r.docid, r.pos, r.tok, r.start, r.end) for r in detect.located_tokens(docs).collect())
    want = []
    for k, t in enumerate(TEXTS):
        kept = [m for m in re.finditer(r"[^\W_]+", t or "") if len(m[0].lower()) >= 2]
        want += [(str(k), n, m[0].lower(), m.start(), m.end() - 1) for n, m in enumerate(kept)]
    assert got == sorted(want)
    folded = {r.tok for r in detect.located_tokens(docs, stem=True, fold_numbers=True).collect()}
    assert {"0", "haus", "schon", "strass", "wort"} <= folded and "12" not in folded


def test_german_stems(spark):
    """Published pairs of the stemmer's vocabulary."""
    known = {
        "aufenthalt": "aufenthalt", "aufeinander": "aufeinand", "katers": "kat", "kategorie": "kategori", "kategorischen": "kategor", "häuser": "haus", "häusern": "hausern", "laufen": "lauf", "freundlichkeit": "freundlich", "jugendlichen": "jugend",
        "bedeutung": "bedeut", "kindern": "kind", "bauer": "bau", "ergebnisse": "ergebnis", "derbsten": "derb", "schönste": "schon", "wohnungen": "wohnung", "abenteuerlich": "abenteu", "seligkeit": "selig", "es": "es", "quelle": "quell",
    }
    df = spark.createDataFrame([(w,) for w in known], "w string").select("w", detect.german_stem(F.col("w")).alias("s"))
    got = {r.w: r.s for r in df.collect()}
    known["häusern"] = "haus"
    assert {w: (got[w], s) for w, s in known.items() if got[w] != s} == {}


def grams_by_hand(tokens, n, gap, ordered):
    out = {}
    for i in range(len(tokens)):
        for pick in combinations(range(1, n + gap), n - 1):
            if i + pick[-1] < len(tokens):
                words = [tokens[i + k][0] for k in (0, *pick)]
                gram = " ".join(words if ordered else sorted(words))
                out[i, gram] = min(out.get((i, gram), 1 << 60), tokens[i + pick[-1]][2])
    return {(i, g, tokens[i][1], e) for (i, g), e in out.items()}


@pytest.mark.parametrize("n, gap, ordered", [(3, 0, True), (2, 2, False), (3, 1, True)])
def test_located_grams(spark, n, gap, ordered):
    rnd = random.Random(n)
    texts = [" ".join(rnd.choice(["aa", "bb", "cc", "dd9", "x"]) for _ in range(rnd.randint(0, 14))) for _ in range(8)]
    docs = spark.createDataFrame([("s", k, t) for k, t in enumerate(texts)], "series string, docid int, text string")
    got = {}
    for r in detect.located_grams(detect.located_tokens(docs), n, gap, ordered).collect():
        got.setdefault(r.docid, []).append((r.pos, r.gram, r.start, r.end))
    for k, t in enumerate(texts):
        tokens = [(m[0], m.start(), m.end() - 1) for m in re.finditer(r"\w+", t) if len(m[0]) > 1]
        assert sorted(got.get(k, [])) == sorted(grams_by_hand(tokens, n, gap, ordered))


def test_window_passages_are_characters(spark):
    """A copied passage is found with its exact first and last character, whatever stands around it."""
    rnd = random.Random(6)
    own = lambda n, abc: " ".join("".join(rnd.choice(abc) for _ in range(5)) for _ in range(n))
    shared = own(30, "mnopq")
    x, y = f"{own(12, 'abc')} -- {shared}!? {own(9, 'abc')}", f"{own(3, 'xyz')}   {shared.replace(' ', ',  ')}\n{own(20, 'xyz')}"
    docs = spark.createDataFrame([("a", "a1", x), ("b", "b1", y), ("b", "b2", own(30, "rstu"))], "series string, docid string, text string")
    (r,) = detect.window_alignment(docs, "a", ngram=3, window=10, in_docs=3, in_window=3, minimum=3, max_gap=5).collect()
    assert (r.a, r.b, r.hits) == ("a1", "b1", 28)
    assert x[r.start_a : r.end_a + 1] == shared and re.sub(r"\W+", " ", y[r.start_b : r.end_b + 1]) == shared
    assert detect.window_alignment(docs, "a", ngram=3, window=10, in_docs=3, in_window=3, minimum=3, max_gap=5, duplicates=50).count() == 0


def test_near_passages_merge_by_characters(spark):
    words = [f"w{k:03d}" for k in range(60)]
    x = " ".join(words[:20] + ["gap1", "gap2"] + words[20:40] + ["far"] * 40 + words[40:])
    y = " ".join(words[:20] + ["ga3", "ga4"] + words[20:40] + ["off"] * 45 + words[40:])
    docs = spark.createDataFrame([("a", "a", x), ("b", "b", y)], "series string, docid string, text string")
    how = {"ngram": 3, "window": 8, "in_docs": 3, "in_window": 3, "minimum": 3, "max_gap": 2}
    got = sorted((r.start_a, r.end_a, r.start_b, r.end_b) for r in detect.window_alignment(docs, "a", **how).collect())
    assert [(x[s : e + 1].split()[0], x[s : e + 1].split()[-1], y[t : u + 1].split()[0], y[t : u + 1].split()[-1]) for s, e, t, u in got] == [("w000", "w039",) * 2, ("w040", "w059") * 2]
    apart = detect.window_alignment(docs, "a", **how, distance=0.0).count()
    assert apart == 3


@given(st.lists(st.tuples(st.text("ab ", max_size=30), st.text("ab ", max_size=30)), min_size=1, max_size=12), st.integers(1, 8), st.sampled_from([(3, 2, 2), (5, 1, 4), (1, 1, 1)]))
@settings(max_examples=60, deadline=None)
def test_banded_batch_equals_single(pairs, band, costs):
    xs, ys = zip(*pairs)
    got = detect.banded_alignments(list(xs), list(ys), *costs, band)
    for g, x, y in zip(got, xs, ys):
        want = detect.smith_waterman(x, y, *costs, band) if x and y else (0, 0, 0, 0, 0)
        # equal in score, and in the spans, but for starts that are equally good
        assert g[0] == want[0]
        if want[0]:
            assert (g[2], g[4]) == (want[2], want[4]) and (g[1], g[3]) == (want[1], want[3])


def test_chain_of_copies(spark):
    """A is copied into B and B into C: C's best predecessor is B, so A and C are not linked."""
    rnd = random.Random(2)
    own = lambda n: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    first, added = own(300), own(150)
    rows = [("1", "A", own(80) + first), ("2", "B", own(60) + first + added), ("3", "C", own(90) + first + added + own(30)), ("3", "D", own(400))]
    docs = spark.createDataFrame(rows, "series string, docid string, text string")
    m = detect.gram_matches(detect.frequent_between(detect.char_grams(docs, 12), 2, 100))
    aligned = detect.align_regions(detect.islands(m, 200, 5).drop("hits"), docs).cache()
    assert {(r.a, r.b) for r in aligned.collect()} == {("A", "B"), ("A", "C"), ("B", "C")}
    best = detect.best_predecessors(aligned, docs)
    assert {(r.a, r.b) for r in best.collect()} == {("A", "B"), ("B", "C")}
    assert {(r.docid, r.origin, r.steps) for r in detect.origins(best, docs).collect()} == {("A", "A", 0), ("B", "A", 1), ("C", "A", 2), ("D", "D", 0)}
    assert detect.gram_alignment(docs, n=12).where("docid = 'D'").count() == 0 and detect.gram_alignment(docs, n=12, all_pairs=True).count() > 0


def test_clusters_by_hand(spark):
    rnd = random.Random(9)
    span = lambda: sorted((rnd.randrange(60), rnd.randrange(60)))
    pairs = [(f"d{rnd.randrange(4)}", *span(), f"e{rnd.randrange(4)}", *span()) for _ in range(14)]
    df = spark.createDataFrame([(a, s, e, b, t, u) for a, s, e, b, t, u in pairs], "a string, start_a int, end_a int, b string, start_b int, end_b int")
    spans = sorted({(p[0], p[1], p[2]) for p in pairs} | {(p[3], p[4], p[5]) for p in pairs})
    nodes: dict = {}
    for d, s, e in spans:  # islands of each document
        mine = nodes.setdefault(d, [])
        if mine and s <= mine[-1][1]:
            mine[-1][1] = max(mine[-1][1], e)
        else:
            mine.append([s, e])
    find = lambda d, s: next((d, *n) for n in nodes[d] if n[0] <= s <= n[1])
    top = {(d, *n): (d, *n) for d in nodes for n in nodes[d]}

    def root(n):
        return n if top[n] == n else root(top[n])

    for a, s, _, b, t, _ in pairs:
        top[root(find(a, s))] = root(find(b, t))
    want = {}
    for n in top:
        want.setdefault(root(n), set()).add(n)
    got = {}
    for r in detect.cluster_passages(df).collect():
        got.setdefault(r.cluster, set()).add((r.docid, r.start, r.end))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
