"""Quality classifier: a sparse ensemble of rules over statistics of whole texts.

Small regression trees are boosted on a bounded labelled sample; the path to
every node of every tree is a candidate rule (a conjunction of thresholds).
Logistic regression with an L1 penalty weighs the rules and leaves most at zero.
The rest are compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import statistics as S
from textloom.llm.shared import crc_mod, sampled, texts, written

#: About so many labelled rows are fitted at most (24 floats each), chosen by a hash of the row.
SAMPLE = 20_000
TREES, DEPTH, BINS, SHRINK = 40, 3, 32, 0.3
LEAF = 10
#: Strength of the L1 penalty, per row.
PENALTY = 2e-4
#: A document is accepted from this score on.
ACCEPT = 0.3

Rule = tuple[tuple[str, str, float], ...]  # ((statistic, "<=" or ">", threshold), ...)


def _grow(binned: np.ndarray, gradient: np.ndarray, rows: np.ndarray, depth: int, path: tuple, out: list, value: np.ndarray, leaf: int) -> None:
    """Best split by variance reduction, both sides of `leaf` rows or more, grown on; leaves set value."""
    best = (1e-9, 0, 0)
    if depth and len(rows) >= 2 * leaf:
        total, n = gradient[rows].sum(), len(rows)
        for j in range(binned.shape[1]):
            count = np.bincount(binned[rows, j], minlength=BINS).cumsum()[:-1]
            left = np.bincount(binned[rows, j], gradient[rows], minlength=BINS).cumsum()[:-1]
            ok = (count >= leaf) & (count <= n - leaf)
            if ok.any():
                gain = np.where(ok, left**2 / np.maximum(count, 1) + (total - left) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, k)
    if best[0] <= 1e-9:
        value[rows] = gradient[rows].mean()
        return
    _, j, k = best
    side = binned[rows, j] <= k
    for part, op in ((rows[side], "<="), (rows[~side], ">")):
        here = (*path, (j, op, k))
        out.append(here)
        _grow(binned, gradient, part, depth - 1, here, out, value, leaf)


def grow_rules(x: np.ndarray, y: np.ndarray) -> list[tuple[tuple[int, str, float], ...]]:
    """Distinct node paths of boosted trees on x (rows by statistics) and 0/1 labels y.

    A node holds a fortieth of the rows or more, at least one and at most LEAF.
    """
    leaf = min(LEAF, max(1, len(y) // 40))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
    rng, rules, logit = np.random.default_rng(7), [], np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(TREES):
        gradient = y - 1 / (1 + np.exp(-logit))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        value = np.zeros(len(y))
        if not len(rows):
            continue
        paths: list = []
        _grow(binned, gradient, rows, DEPTH, (), paths, value, leaf)
        logit = logit + SHRINK * 4 * value
        rules += paths
    return list(dict.fromkeys(tuple((j, op, float(cuts[j][k])) for j, op, k in p) for p in rules if all(k < len(cuts[j]) for j, _, k in p)))


def fires(x: np.ndarray, rules: list) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for r, rule in enumerate(rules):
        for j, op, cut in rule:
            out[:, r] *= x[:, j] <= cut if op == "<=" else x[:, j] > cut
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient; the bias bears no penalty."""
    n, m = z.shape
    step = 4.0 / (1e-9 + np.linalg.norm(np.c_[np.ones(n), z], 2) ** 2 / n)
    w, b = np.zeros(m), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    vw, vb, t = w, b, 1.0
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(z @ vw + vb))) - y
        nw = vw - step * (z.T @ g) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b)
        w, b, t = nw, nb, t2
    return b, w


class RuleModel:
    """bias + sum of weights of the rules that hold; compiles to a Column."""

    def __init__(self, bias: float, rules: list[tuple[Rule, float]]):
        self.bias, self.rules = bias, rules

    def score(self) -> Column:
        def holds(rule: Rule) -> Column:
            return reduce(lambda a, b: a & b, [F.col(c) <= t if op == "<=" else F.col(c) > t for c, op, t in rule])

        margin = reduce(lambda a, b: a + b, [F.when(holds(r), F.lit(w)).otherwise(0.0) for r, w in self.rules], F.lit(self.bias))
        return 1 / (1 + F.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, names: tuple[str, ...] = S.NAMES, penalty: float = PENALTY) -> RuleModel:
    """A rule model of 0/1 labels; without both labels the score is their (smoothed) mean."""
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(p / (1 - p))), [])
    rules = grow_rules(x, y)
    if not rules:
        p = y.mean()
        return RuleModel(float(np.log(p / (1 - p))), [])
    b, w = lasso_logistic(fires(x, rules), y, penalty)
    return RuleModel(b, [(tuple((names[j], op, cut) for j, op, cut in r), float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6])


def score(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", hold_out: tuple[int, int] = (5, 0), sample: int = SAMPLE, accept: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, and row_col if it is named.

    Labels are learned only from rows whose crc32(id) mod hold_out[0] is not
    hold_out[1], from about `sample` of them at most. A score uses statistics of
    the whole text alone. Null and empty texts have zero statistics and get the
    score of those. Unlabelled and null labels teach nothing, equal rows teach
    once; rows of one label only give the same smoothed share to every document,
    0.5 if there are none. Rows whose ids are null or repeat are scored each by
    its own text; an empty table gives an empty result; other columns are not
    read.
    """
    more = [row_col] if row_col else []
    stats = written(S.statistics(texts(docs, *more, id_col=id_col, text_col=text_col)), "statistics")
    held = crc_mod(F.col("doc_id"), hold_out[0]) == hold_out[1]
    told = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("_label")).where("_label is not null").where(~held).distinct()
    known = written(stats.select("doc_id", *S.NAMES).join(told, "doc_id").distinct(), "labelled")
    rows = sampled(known, sample, *known.columns).toPandas().sort_values(known.columns)
    model = fit(rows[list(S.NAMES)].to_numpy(float), rows["_label"].to_numpy(float))
    scored = stats.select("doc_id", *more, F.coalesce(held, F.lit(False)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))
