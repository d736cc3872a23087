"""Label propagation over blocks of nodes: every way of moving ends where each node has a label of the greatest weight."""

import random

import numpy as np
import pytest

from textloom.operators import wordgraph


@pytest.mark.parametrize("free, in_turn, links", [(2, 1 << 22, 40), (0, 0, 40), (3, 0, 1 << 18)])
def test_labels_settle_in_blocks(spark, monkeypatch, free, in_turn, links):
    """Before, a graph above IN_TASK edges was joined and shuffled in every round."""
    for name, value in (("IN_TASK", 0), ("FREE", free), ("IN_TURN", in_turn), ("LINKS", links), ("WAITING", 30)):
        monkeypatch.setattr(wordgraph, name, value)
    monkeypatch.setattr(wordgraph, "_propagated", None)
    rnd = random.Random(5)
    edges = [(7 * a - 50, 7 * b - 50, round(rnd.uniform(0.5, 1), 3)) for a in range(60) for b in range(a + 1, 60) if rnd.random() < (0.5 if a // 12 == b // 12 else 0.05)]
    ids = sorted({i for a, b, _ in edges for i in (a, b)} | {1000})
    nodes = spark.createDataFrame([(i, str(i)) for i in ids], "id long, form string")
    got = {r.id: r.com_id for r in wordgraph.communities(nodes, spark.createDataFrame(edges, "src long, dst long, weight double"), algo="lpa").collect()}
    assert sorted(got) == ids and got[1000] == 1000
    for c in set(got.values()):
        assert c == min(i for i in ids if got[i] == c)
    for i in ids:
        weight = {}
        for a, b, w in edges:
            if i in (a, b):
                other = got[b if a == i else a]
                weight[other] = weight.get(other, 0) + w
        assert not weight or weight.get(got[i], 0) >= max(weight.values()) - 1e-9


def test_votes_in_a_table_equal_sorted_votes():
    rng = np.random.default_rng(1)
    for _ in range(50):
        rows, labels = 6, 5
        row, label = rng.integers(0, rows, 40), rng.integers(0, labels, 40)
        weight, own, entered = rng.integers(1, 4, 40) / 2, rng.integers(0, labels, rows), rng.random(labels) < 0.5
        wide = np.r_[entered, np.zeros(1000, bool)]  # so many labels that votes are sorted
        for free in (True, False):
            a, b = (wordgraph._chosen(own, row, label, weight, e, free) for e in (entered, wide))
            assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()
