"""Toxicity by weak supervision.

1. Voters: fixed lexicons of insults, fixed patterns, and mined one-term lexicons
   (words and word beginnings of 4 to 6 bytes whose presence goes with the label
   in a bounded labelled sample, chosen by the likelihood ratio statistic).
2. Label model: a generative model of the class and of the votes given the class.
   EM over the votes on all documents estimates the class share and, for every
   voter, how often it fires in either class (one that does not fire abstains);
   labelled training rows hold the classes in place. In every round the
   correlations of the voters within a class are estimated from the same
   documents: a voter's weight is its log odds divided by one plus the sum of its
   correlations with the other voters, so that votes which are one vote count once.
3. A linear classifier over the selected features learns the posterior labels
   of the sample, so that it also scores what no voter covers.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.shared import crc_mod, few, sampled, texts, written

#: Labelled rows that are fitted at most (about), features of the classifier, EM rounds.
SAMPLE, FEATURES, ROUNDS = 20_000, 2048, 8
ACCEPT = 0.3
#: Parts of a document in which EM counts: sums of whole numbers do not hang on the order of tasks.
PARTS = 1 << 24
#: Share of label 1 among the labelled rows where a voter fires, at least (one row of label 0 is added).
PRECISION = 0.8
#: Pattern voters: hidden letters, shouting, letters spelled apart.
PATTERNS = (re.compile(r"\b[A-Za-z]\*{2,}[A-Za-z]*\b"), re.compile(r"(?:\b[A-Z]{3,}\b[ !]*){4,}"), re.compile(r"(?:\b[A-Za-z][ .-]){5,}"))
#: Common insults, words of contempt and words of violence; a lexicon votes where one of its words stands.
LEXICONS = (
    "idiot idiots moron morons imbecile fool fools dumb dumbass stupid clown loser losers scum scumbag bastard jerk creep pig dog rat",
    "worthless pathetic disgusting useless hopeless trash garbage filth vermin repulsive hateful vile despicable contemptible",
    "kill murder strangle stab beat destroy die hang burn slaughter",
)
_PREFIXES = (4, 5, 6)
_FIXED = len(PATTERNS) + len(LEXICONS)


def _hashes(words: str) -> np.ndarray:
    data, offs = K.flat(pa.array([words]))
    return np.sort(K.words(data, offs, lower=True, space=K.NOT_TERM)[0])


_LEXICONS = [_hashes(x) for x in LEXICONS]


def features(column: pa.Array):
    """(hashes of the features of all texts, number of the text of each); a feature may repeat."""
    for lo, hi in K.batches(column, 1 << 20):
        part = column.slice(lo, hi - lo)
        data, offs = K.flat(part)
        h, s, e, at = K.words(data, offs, lower=True, space=K.NOT_TERM)
        owner = np.repeat(np.arange(lo, hi), np.diff(at))
        padded = np.r_[K.LOWER[data], np.zeros(8, np.uint8)]
        value, all_h, all_o = np.zeros(len(s), np.uint64), [h], [owner]
        for i in range(max(_PREFIXES)):
            value |= padded[s + i].astype(np.uint64) << K.U64(8 * i)
            if i + 1 in _PREFIXES:
                long = e - s >= i + 1
                all_h.append(K.mix(value[long] ^ K.U64(0x5851F42D4C957F2D * (i + 2) & 0xFFFFFFFFFFFFFFFF)))
                all_o.append(owner[long])
        for k, words in enumerate(_LEXICONS):
            hit = owner[words[np.minimum(np.searchsorted(words, h), len(words) - 1)] == h]
            all_h.append(np.full(len(hit), len(PATTERNS) + k + 1, np.uint64))
            all_o.append(hit)
        for k, p in enumerate(PATTERNS):
            hit = np.array([lo + i for i, t in enumerate(part.to_pylist()) if t and p.search(t)], np.int64)
            all_h.append(np.full(len(hit), k + 1, np.uint64))
            all_o.append(hit)
        yield np.concatenate(all_h), np.concatenate(all_o)


@K.trimmed
def _counted(iterator):
    """(feature, texts of label 1, texts of label 0) of this task."""
    for batch in iterator:
        label = batch.column(1).to_numpy()
        for h, owner in features(batch.column(0)):
            order = np.lexsort((owner, h))
            h, owner = h[order], owner[order]
            keep = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
            h, y = h[keep], label[owner[keep]]
            first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            pos = np.add.reduceat(y, first) if len(first) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(pos.astype(np.int64)), pa.array((n - pos).astype(np.int64))], ["feature", "pos", "neg"])


@K.trimmed
def _hits(iterator, shared):
    """doc_id and the sorted distinct numbers of its selected features."""
    known, number = shared.value
    for batch in iterator:
        hit: list[list[int]] = [[] for _ in range(batch.num_rows)]
        for h, owner in features(batch.column(1)):
            if len(known):
                at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                ok = known[at] == h
                pairs = np.unique(owner[ok] * len(known) + number[at[ok]])
                for i, f in zip((pairs // len(known)).tolist(), (pairs % len(known)).tolist()):
                    hit[i].append(f)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hit, pa.list_(pa.int32()))], ["doc_id", "hits"])


def _pairs(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, first, second) of all pairs of places within each set of a list array."""
    size, out = np.diff(offsets), []
    for n in np.unique(size[size > 1]):
        rows = np.flatnonzero(size == n)
        i, j = np.triu_indices(n, 1)
        out.append((np.repeat(rows, len(i)), (offsets[rows, None] + i).ravel(), (offsets[rows, None] + j).ravel()))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    rows, i, j = (np.concatenate(x) for x in zip(*out))
    return rows, values[i], values[j]


def _evidence(iterator, model: LabelModel):
    """(f, g, one, zero): parts of documents of either class in which the voters f and g fire together (f = g: f fires), of this task.

    f is -1 for all documents. Documents without a label count by the posterior of their votes.
    """
    width = model.voters
    mass = np.zeros((width + 1, 2), np.int64)
    both: dict[int, np.ndarray] = {}
    for batch in iterator:
        lists = batch.column(0)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets, values = offsets - offsets[0], values[offsets[0] : offsets[-1]]
        unknown, zeros, ones = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2, 3))
        parts = np.rint(model.of(values, offsets) * PARTS).astype(np.int64) if model.fitted else np.zeros(len(unknown), np.int64)
        known = PARTS if model.fitted else 0
        each = np.stack([ones * PARTS + unknown * parts, zeros * PARTS + unknown * (known - parts)], 1)
        mass[width] += each.sum(axis=0)
        row = np.repeat(np.arange(len(each)), np.diff(offsets))
        np.add.at(mass, values, each[row])
        mass[width - 1] += each[np.diff(offsets) == 0].sum(axis=0)
        rows, f, g = _pairs(values, offsets)
        if len(rows):
            key = np.minimum(f, g) * width + np.maximum(f, g)
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
            for k, m in zip(key[order][first].tolist(), np.add.reduceat(each[rows[order]], first)):
                both[k] = both[k] + m if k in both else m
    keys = np.array(sorted(both), np.int64)
    pairs = np.array([both[k] for k in keys.tolist()], np.int64).reshape(-1, 2)
    f = np.r_[-1, np.arange(width), keys // width]
    g = np.r_[-1, np.arange(width), keys % width]
    got = np.concatenate([mass[width:], mass[:width], pairs])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (f, g, got[:, 0], got[:, 1])], ["f", "g", "one", "zero"])


class LabelModel:
    """Class share, firing rates and correlations of voters, by EM over the votes on all documents.

    votes(votes array<int>, unknown, label0, label1): the documents that cast a set
    of sorted voter numbers, by label. A round is one Spark job: tasks add up what
    the sets say about voters and pairs of voters, and only these sums, as many as
    there are pairs at most, reach the driver. Sets never do.
    """

    def __init__(self, votes: DataFrame, voters: int, rounds: int = ROUNDS):
        self.voters = voters + 1  # where all abstain, that is a vote of its own
        self.prior, self.weight, self.fitted = 0.5, np.zeros(self.voters), False
        for _ in range(rounds):
            found = votes.mapInArrow(self._task(), "f long, g long, one long, zero long").groupBy("f", "g").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero")).toPandas()
            self._update(found["f"].to_numpy(), found["g"].to_numpy(), found[["one", "zero"]].to_numpy() / PARTS)

    def _task(self):
        model = _Fitted(self.voters, self.prior, self.weight, self.fitted)
        return lambda iterator: _evidence(iterator, model)

    def _update(self, f: np.ndarray, g: np.ndarray, mass: np.ndarray) -> None:
        total = mass[f < 0].sum(axis=0)
        self.prior = float(np.clip((total[0] + 1) / (total.sum() + 2), 1e-6, 1 - 1e-6))
        alone, correlation = (f == g) & (f >= 0), np.zeros(self.voters)
        fired = np.zeros((self.voters, 2))
        fired[f[alone]] = mass[alone]
        rate = (fired + 0.5) / (total + 1)
        spread = np.sqrt(rate * (1 - rate))
        pair = f != g
        order = np.lexsort((g[pair], f[pair]))
        a, b, m = f[pair][order], g[pair][order], mass[pair][order]
        phi = (m / (total + 1) - rate[a] * rate[b]) / np.maximum(1e-12, spread[a] * spread[b])
        phi = np.clip(phi, 0, 1).sum(axis=1) / 2  # the mean of both classes, where positive
        for at in (a, b):
            np.add.at(correlation, at, phi)
        self.correlation = correlation
        self.weight = np.log(rate[:, 0] / rate[:, 1]) / (1 + correlation)
        self.fitted = True

    def posterior(self, votes: list[list[int]]) -> np.ndarray:
        """The chance of class 1 given each set of sorted voter numbers."""
        offsets = np.r_[0, np.cumsum([len(v) for v in votes])].astype(np.int64)
        return _Fitted(self.voters, self.prior, self.weight, True).of(np.array([f for v in votes for f in v], np.int64), offsets)


class _Fitted:
    """What a task needs of a label model."""

    def __init__(self, voters: int, prior: float, weight: np.ndarray, fitted: bool):
        self.voters, self.prior, self.weight, self.fitted = voters, prior, weight, fitted

    def of(self, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        size = np.diff(offsets)
        margin = np.bincount(np.repeat(np.arange(len(size)), size), self.weight[values], len(size)) if len(values) else np.zeros(len(size))
        margin = np.where(size == 0, self.weight[self.voters - 1], margin) + np.log(self.prior / (1 - self.prior))
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def _linear(hits: list[np.ndarray], y: np.ndarray, width: int, penalty: float = 1e-4, rounds: int = 300) -> tuple[float, np.ndarray]:
    """L1 logistic regression of soft labels on presence of features (sparse rows)."""
    n = len(hits)
    if not n:
        return 0.0, np.zeros(width)
    row = np.repeat(np.arange(n), [len(h) for h in hits])
    col = np.concatenate(hits).astype(np.int64) if len(row) else np.zeros(0, np.int64)
    v = np.ones(width)
    top = 1.0
    for _ in range(12):
        z = np.bincount(row, v[col], n)
        v = np.bincount(col, z[row], width) / n
        top = max(np.linalg.norm(v), 1e-9)
        v /= top
    step = 4 / (1.1 * top + 1)
    p = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    w, b, t = np.zeros(width), float(np.log(p / (1 - p))), 1.0
    vw, vb = w, b
    for _ in range(rounds):
        g = 1 / (1 + np.exp(-(np.bincount(row, vw[col], n) + vb))) - y
        nw = vw - step * np.bincount(col, g[row], width) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * penalty, 0)
        nb = vb - step * g.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb, w, b, t = nw + (t - 1) / t2 * (nw - w), nb + (t - 1) / t2 * (nb - b), nw, nb, t2
    return b, w


def score(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", hold_out: tuple[int, int] = (4, 2), sample: int = SAMPLE, accept: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Labels are learned only from rows whose crc32(id) mod hold_out[0] is not
    hold_out[1], from about `sample` ids at most; of an id with both labels 1
    counts. Votes are counted on all documents. A score uses the whole text
    alone. Null and empty texts have no features and get the classifier's base
    score; without labels of both kinds every score is the smoothed share of
    label 1. Rows whose ids are null or repeat are scored each by its own text;
    an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    source = texts(docs, id_col=id_col, text_col=text_col)
    held = F.coalesce(crc_mod(F.col("doc_id"), hold_out[0]) == hold_out[1], F.lit(False))
    told = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label is not null and doc_id is not null").where(~held)
    told = written(sampled(told.groupBy("doc_id").agg(F.max("label").alias("label")), sample, "doc_id"), "told")
    n1, n = told.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    n0 = n - n1
    base = float((n1 + 1) / (n + 2))
    if not n1 or not n0:
        return source.select("doc_id", held.alias("held_out"), F.lit(base).alias("score"), F.lit(int(base >= accept)).alias("predicted"))
    counted = source.join(few(told, n), "doc_id").select("text", "label").mapInArrow(_counted, "feature long, pos long, neg long")
    total = counted.groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    def gain(a: Column, m: int) -> Column:  # a * log(a / expected) of the likelihood ratio
        return F.when(a > 0, a * F.log(a * n / ((F.col("pos") + F.col("neg")) * m))).otherwise(0.0)

    fixed = F.col("feature").between(1, _FIXED)  # lexicons and patterns always vote
    total = written(total.where((F.col("pos") + F.col("neg") >= 4) | fixed), "features")
    ranked = total.where(~fixed).withColumn("g", gain(F.col("pos"), n1) + gain(F.col("neg"), n0)).orderBy(F.desc("g"), "feature").limit(FEATURES)
    chosen = total.where(fixed).withColumn("g", F.lit(0.0)).unionByName(ranked).toPandas()
    key = chosen["feature"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((key[order], order))
    hits = written(source.select("doc_id", "text").mapInArrow(lambda it: _hits(it, shared), "doc_id long, hits array<int>"), "hits")

    pos, neg = chosen["pos"].to_numpy(), chosen["neg"].to_numpy()
    good = (pos >= max(4, 0.01 * n1)) & (pos >= PRECISION * (pos + neg + 1))
    voters = np.flatnonzero(good | (chosen["feature"].between(1, _FIXED).to_numpy() & (pos * n0 > neg * n1)))
    chosen_voters = {int(f) for f in voters}
    # distinct vote sets and how many documents of either label, or none, cast them
    cast = F.array_intersect("hits", F.array(*map(F.lit, sorted(chosen_voters)))) if chosen_voters else F.expr("cast(array() as array<int>)")
    count = lambda test: F.count(F.when(test, 1))
    table = hits.select("doc_id", F.array_sort(cast).alias("votes")).join(few(told, n), "doc_id", "left").groupBy("votes").agg(count(F.col("label").isNull()).alias("unknown"), count(F.col("label") <= 0).alias("label0"), count(F.col("label") > 0).alias("label1"))
    model = LabelModel(written(table, "votes"), len(chosen))
    known = hits.join(few(told, n), "doc_id").select("doc_id", "hits").distinct().toPandas().sort_values("doc_id", kind="stable")
    rows = sorted((np.asarray(h, np.int64) for h in known["hits"]), key=lambda h: h.tolist())
    soft = model.posterior([sorted(f for f in h.tolist() if f in chosen_voters) for h in rows])
    bias, w = _linear(rows, soft, len(chosen))
    weights = F.array(*[F.lit(float(x)) for x in w])
    total_w = F.aggregate("hits", F.lit(float(bias)), lambda acc, i: acc + F.get(weights, i))
    return hits.select("doc_id", held.alias("held_out"), (1 / (1 + F.exp(-total_w))).alias("score")).withColumn("predicted", (F.col("score") >= accept).cast("int"))
