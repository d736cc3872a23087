"""Short words built again, Louvain by joins, rounds that are saved: against plain versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.operators import similarity as S
from textloom.operators import wordgraph
from textloom.plans import drivers

SM = S.matrix(S.PHONETIC, {-0.5: S.VOWELS})
LETTERS = "aeiouyjckdtghzmnvfbw"


def codes(words):
    return np.array([[ord(c) - 97 for c in w] for w in words])


@given(st.integers(1, 6), st.integers(1, 6), st.integers(0, 3), st.sampled_from([(1.0, 1.0), (0.5, 1.0), (0.5, 0.25)]), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_phonetic_batch_equals_single(n, m, disfavour, gaps, rnd):
    xs, ys = (["".join(rnd.choice(LETTERS) for _ in range(k)) for _ in range(30)] for k in (n, m))
    got = S.phonetic_scores(codes(xs), codes(ys), n, m, SM, *gaps, disfavour)
    want = [S.align(x, y, SM, *gaps, True, disfavour)[0] for x, y in zip(xs, ys)]
    assert got == pytest.approx(want, abs=1e-9)


def test_phonetic_known_values():
    """N2-N4 on pairs whose score follows by hand."""
    assert S.position_weight(4, 4, 0, 0, 1) == 1 and S.position_weight(4, 4, 3, 3, 1) == 0.25 and S.position_weight(4, 2, 3, 1, 2) == 0.75
    assert S.position_weight(5, 5, 4, 0, 0) == 1.0
    assert S.free_gap("t", "tt", 1, True) and S.free_gap("c", "ck", 1, True) and S.free_gap("z", "tz", 0, False) and S.free_gap("i", "yi", 1, True)
    assert not S.free_gap("t", "ts", 1, True) and not S.free_gap("y", "yi", 1, True) and not S.free_gap("a", "a", 0, False)
    for x, y in (("vat", "vat"), ("vat", "fat"), ("vat", "wat"), ("vas", "fas")):
        assert S.align(x, y, SM, 1, 1, True, 1)[1] == pytest.approx(1.0)
    assert S.align("stat", "statt", SM, 1, 1, True, 0)[0] == pytest.approx(4)  # the second t is free beside the first


@pytest.mark.parametrize("minsim", [0.4, 0.5, 0.8])
def test_phonetic_edges_lose_nothing(spark, minsim):
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choice("aeiouvckdtsz") for _ in range(rnd.randint(1, 7))) for _ in range(220)})
    nodes = spark.createDataFrame(list(enumerate(words)) + [(9999, "Ü")], "id long, form string")
    got = {(r.src, r.dst): r.weight for r in S.phonetic_edges(nodes, SM, minsim).collect()}
    want = {(i, j): n for i, x in enumerate(words) for j in range(i + 1, len(words)) if (n := S.align(x, words[j], SM, 1, 1, True, 1)[1]) >= minsim - 1e-9}
    assert got == pytest.approx(want, abs=1e-8) and len(want) >= 10
    assert S.phonetic_edges(nodes.limit(0), SM).count() == 0


def test_short_words_meet_again(spark):
    """Words of three communities; all short words are compared with all, whatever community they come from."""
    words = ["vat", "vas", "fat", "fas", "wat", "gemeinde", "gemeinden"]
    nodes = spark.createDataFrame(list(enumerate(words)), "id long, form string")
    members = spark.createDataFrame([(0, 0), (0, 1), (2, 2), (2, 3), (4, 4), (5, 5), (5, 6)], "com_id long, id long")
    edges = spark.createDataFrame([(0, 1, 0.5), (2, 3, 0.5), (5, 6, 0.9)], "src long, dst long, weight double")
    kept, short, links = wordgraph.fine_tune(members, nodes, edges, SM)
    assert {(r.com_id, r.id) for r in kept.collect()} == {(5, 5), (5, 6)}
    weight = {(r.src, r.dst): r.weight for r in links.collect()}
    assert weight == pytest.approx({(i, j): n for i in range(5) for j in range(i + 1, 5) if (n := S.align(words[i], words[j], SM, 1, 1, True, 1)[1]) >= 0.5}, abs=1e-8)
    assert weight[0, 2] == weight[0, 4] == weight[1, 3] == pytest.approx(1.0)  # vat-fat, vat-wat, vas-fas
    groups = {}
    for r in short.collect():
        groups.setdefault(r.com_id, set()).add(words[r.id])
    assert {"vat", "wat"} in groups.values() and {"fas", "vas", "fat"} in groups.values()


def test_models_of_short_words(spark):
    words = ["vat", "fat", "wat", "gemeinde", "gemeinden"]
    nodes = spark.createDataFrame(list(enumerate(words)), "id long, form string")
    edges = spark.createDataFrame([(3, 4, 0.9)], "src long, dst long, weight double")
    models = drivers.train_models(nodes, edges, SM)
    base, tuned = ({r.form: r.lemma for r in models[m].collect()} for m in ("lem", "lem-ft"))
    assert {base[w] for w in words[:3]} == {"vat", "fat", "wat"} and base["gemeinde"] == base["gemeinden"]
    assert len({tuned[w] for w in words[:3]}) == 1 or len({tuned[w] for w in words[:3]}) == 3  # a group is used only if its words are alike enough
    assert tuned["gemeinde"] == tuned["gemeinden"] and set(tuned) == set(words)


def planted(rnd, groups, size, inside, between):
    """Edges of a graph of dense groups with few links between them."""
    n, links = groups * size, {}
    for a in range(n):
        for b in range(a + 1, n):
            if rnd.random() < (inside if a // size == b // size else between):
                links[a, b] = round(rnd.uniform(0.5, 1.0), 3)
    return [(a, b, w) for (a, b), w in links.items()]


def test_louvain_by_joins(spark, monkeypatch):
    shape = (5, 20, 0.3, 0.03)
    links = planted(random.Random(11), *shape)
    nodes = spark.range(shape[0] * shape[1] + 2).selectExpr("id", "cast(id as string) as form")
    edges = spark.createDataFrame(links, "src long, dst long, weight double")
    plain = wordgraph.modularity(wordgraph.communities(nodes, edges), edges)
    monkeypatch.setattr(wordgraph, "IN_TASK", 0)
    found = wordgraph.communities(nodes, edges)
    assert sorted(r.id for r in found.collect()) == list(range(shape[0] * shape[1] + 2))
    assert wordgraph.modularity(found, edges) >= 0.98 * plain


def test_rounds_are_saved(spark, tmp_path):
    """A training that ends in the middle goes on from its last whole round, with the same result."""
    links = planted(random.Random(3), 4, 9, 0.6, 0.1)
    nodes = spark.range(36).selectExpr("id", "cast(id as string) as form")
    edges = spark.createDataFrame(links, "src long, dst long, weight double")
    whole = {(r.com_id, r.id) for r in wordgraph.dense_communities(nodes, edges).collect()}
    folder = str(tmp_path / "rounds")
    assert wordgraph.resume(spark, folder) is None
    assert {(r.com_id, r.id) for r in wordgraph.dense_communities(nodes, edges, folder=folder).collect()} == whole
    last = wordgraph.last_round(spark, folder)
    assert last >= 2
    half = str(tmp_path / "half")
    wordgraph.save_round(spark.read.parquet(f"{folder}/round=1"), half, 1)
    (tmp_path / "half" / "round=7").mkdir()  # begun, but not saved whole
    assert wordgraph.last_round(spark, half) == 1
    assert {(r.com_id, r.id) for r in wordgraph.dense_communities(nodes, edges, folder=half).collect()} == whole
    assert wordgraph.last_round(spark, half) == last
    wordgraph.save_round(spark.read.parquet(f"{folder}/round={last}"), half, 10)
    assert wordgraph.last_round(spark, half) == 10  # numbers, not names


@pytest.mark.parametrize("in_task", [2_000_000, 0])
def test_label_propagation_settles(spark, monkeypatch, in_task):
    """Every node ends with a label of the greatest weight among its neighbours; long chains, pairs and ties end as well."""
    monkeypatch.setattr(wordgraph, "IN_TASK", in_task)
    rnd = random.Random(8)
    links = [(i, i + 1, 1.0) for i in range(40)] + [(100 + a, 100 + b, round(rnd.random(), 2)) for a in range(14) for b in range(a + 1, 14) if rnd.random() < 0.4] + [(200, 201, 1.0)]
    ids = sorted({i for a, b, _ in links for i in (a, b)} | {999})
    nodes = spark.createDataFrame([(i, str(i)) for i in ids], "id long, form string")
    got = {r.id: r.com_id for r in wordgraph.communities(nodes, spark.createDataFrame(links, "src long, dst long, weight double"), algo="lpa").collect()}
    assert sorted(got) == ids and got[200] == got[201] == 200 and got[999] == 999
    for i in ids:
        weight = {}
        for a, b, w in links:
            if i in (a, b):
                other = got[b if a == i else a]
                weight[other] = weight.get(other, 0) + w
        assert not weight or weight.get(got[i], 0) >= max(weight.values()) - 1e-9
