"""Approximate nearest neighbours by a permutation index.

Every vector is described by its nearest pivots, in order. It is posted in the
inverted files of its POSTED nearest pivots. A query visits the files of its own
VISITED nearest pivots and no others; the entries of a file are ranked by
Spearman's footrule between the first PREFIX pivots of both, and the best RERANK
of them get their exact cosine, in double precision.

A vector that stands in several visited files is ranked in one of them only: the
one of its nearest posted pivot that the query visits. A file is dealt into
parts of LIST_PART entries, so a task holds one part and lets the queries pass
by; only the best k of each query leave it.

At most PIVOTS pivots are drawn, one for every PER_PIVOT vectors. The share of
the vectors that a query ranks is therefore near POSTED * VISITED / PIVOTS at
any size; that much is what data without clusters need for a recall of 0.9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.shared import bound_batches, distinct_ids, spread, written

PIVOTS, PER_PIVOT = 1024, 8
POSTED, VISITED, PREFIX = 4, 128, 64
#: A query visits this many files at least (all, where there are no more of them).
VISITED_LEAST = 48
#: Share of the entries ranked in a file that is scored exactly, and the least number.
RERANK, LEAST = 0.5, 64
LIST_PART = 1 << 15


def places(unit: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first (ties to the smaller number)."""
    return np.argsort(-(unit @ pivots.T), axis=1, kind="stable")[:, :prefix].astype(np.uint16)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component: no square overflows, no rounding changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    offs = column.offsets.to_numpy()
    size = np.diff(offs)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), size), np.arange(offs[-1] - offs[0]) - np.repeat(offs[:-1] - offs[0], size)] = column.values.to_numpy()[offs[0] : offs[-1]]
    return out


@K.trimmed
def _described(iterator, shared, width: int, visited: int):
    pivots = shared.value
    for batch in iterator:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            x = scaled(_matrix(part.column(1), width))
            near = places(x / np.linalg.norm(x, axis=1)[:, None], pivots, max(PREFIX, visited))
            lists = lambda m: pa.array(near[:, :m].astype(np.int32).tolist(), pa.list_(pa.int32()))
            blob = lambda y: pa.array([r.tobytes() for r in y], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), blob(x), blob(near), lists(POSTED), lists(visited)], ["id", "vec", "near", "posted", "visited"])


def _arrays(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    blob = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind).reshape(len(rows), -1)
    return rows.column("id").to_numpy(), blob("vec", np.float64), blob("near", np.uint16)


class _File:
    """A part of the inverted file of one pivot."""

    def __init__(self, pivot: int, rows: pa.Table, n_pivots: int):
        self.ids, self.x, near = _arrays(rows)  # sorted by id: ties go to the smaller one
        self.norm = np.linalg.norm(self.x, axis=1)
        self.n_pivots, self.prefix = n_pivots, min(PREFIX, near.shape[1])
        self.near = near[:, : self.prefix].astype(np.int64)
        self.weight = (self.prefix - np.arange(self.prefix)).astype(np.uint8)
        self.posted = self.near[:, :POSTED]
        self.place = (self.posted == pivot).argmax(axis=1)

    def ask(self, qids: np.ndarray, q: np.ndarray, near: np.ndarray, visited: int, k: int):
        """(query id, vector id, score) of the best k of each query."""
        out: tuple[list, list, list] = ([], [], [])
        step = max(1, (1 << 22) // self.near.size)
        for lo in range(0, len(qids), step):
            own = near[lo : lo + step].astype(np.int64)
            rows = np.arange(len(own))[:, None]
            weights = np.zeros((len(own), self.n_pivots), np.uint8)
            weights[rows, own[:, : self.prefix]] = self.weight
            seen = np.zeros((len(own), self.n_pivots), bool)
            seen[rows, own[:, :visited]] = True
            # footrule = constant - 2 * sum of the lesser weights of the shared pivots
            gain = np.minimum(weights[:, self.near], self.weight).sum(axis=2, dtype=np.uint16)
            mine = qids[lo : lo + step, None] != self.ids
            for j in range(POSTED - 1):
                if j < self.posted.shape[1]:
                    mine &= ~(seen[:, self.posted[:, j]] & (self.place > j))
            for i in range(len(own)):
                c = np.flatnonzero(mine[i])
                take = max(LEAST, k, int(np.ceil(RERANK * len(c))))
                if take < len(c):
                    c = np.sort(c[np.argsort(-gain[i, c].astype(np.int32), kind="stable")[:take]])
                a = q[lo + i]
                score = (self.x[c] * a).sum(axis=1) / (self.norm[c] * np.linalg.norm(a))
                top = np.lexsort((self.ids[c], -score))[:k]
                out[0].append(np.full(len(top), qids[lo + i]))
                out[1].append(self.ids[c[top]])
                out[2].append(score[top])
        return out


@K.trimmed
def _searched(iterator, n_pivots: int, visited: int, k: int):
    """Rows sorted by pivot, part and role: the entries of a part, then the queries that visit it."""
    now, held, file = None, [], None
    for batch in iterator:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("pivot", "part", "role")]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for lo, hi in zip(np.r_[0, change], np.r_[change, batch.num_rows]):
            pivot, part, role = (int(c[lo]) for c in cols)
            if (pivot, part) != now:
                now, held, file = (pivot, part), [], None
            rows = batch.slice(lo, hi - lo)
            if not role:
                held.append(rows)
                continue
            if file is None and held:
                file, held = _File(pivot, pa.Table.from_batches(held), n_pivots), []
            if file is not None:
                found = file.ask(*_arrays(pa.Table.from_batches([rows])), visited, k)
                kinds = (pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], t) for c, t in zip(found, kinds)], ["query_id", "vec_id", "score"])


def search(vectors: DataFrame, *, every: int = 50, k: int = 5, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    Candidates are all rows but the query's own; fewer than k if there are
    fewer. Nearest first by cosine, ties to the smaller id. Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do null
    ids; shorter vectors count as padded with zeros. Of repeated ids the least
    vector stands for all. An empty table gives an empty result. The sample of
    at most `pivots` vectors is the only part of the index that is fitted.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    good = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null")
    good = good.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    if not distinct_ids(good, "id"):
        good = written(good.groupBy("id").agg(F.min("v").alias("v")), "vectors")
    n, width = good.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = good.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(min(pivots, max(1, n // PER_PIVOT))).collect()
    at = scaled(np.array([[*r["v"], *[0.0] * (width - len(r["v"]))] for r in chosen]))
    visited = min(len(at), max(VISITED_LEAST, round(len(at) * VISITED / PIVOTS)))
    shared = spark.sparkContext.broadcast(at / np.linalg.norm(at, axis=1)[:, None])
    schema = "id long, vec binary, near binary, posted array<int>, visited array<int>"
    index = written(spread(good).mapInArrow(lambda it: _described(it, shared, width, visited), schema), "index")
    sizes = {r["pivot"]: r["count"] for r in index.select(F.explode("posted").alias("pivot")).groupBy("pivot").count().collect()}  # one row a pivot
    parts = F.get(F.array(*[F.lit(-(-sizes.get(p, 0) // LIST_PART)) for p in range(len(at))]), F.col("pivot"))
    entries = index.select("id", "vec", "near", F.explode("posted").alias("pivot"), F.lit(0).alias("role"))
    entries = entries.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int"))
    queries = index.where(F.col("id") % every == 0).select("id", "vec", "near", F.explode("visited").alias("pivot"), F.lit(1).alias("role"))
    queries = queries.where(parts > 0).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    rows = entries.unionByName(queries).repartition("pivot", "part").sortWithinPartitions("pivot", "part", "role", "id")
    found = rows.mapInArrow(lambda it: _searched(it, len(at), visited, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
