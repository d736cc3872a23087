"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they are
in). Words flow from patterns to sources: a pattern offers its size once at
cost 1 and each repetition at a higher cost (convex), a source takes up to its
target. The flow of a pattern says how many words of it are taken; documents
are chosen within the pattern in a seeded order, found by a histogram of that
order, so that no pattern is ever sorted in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.shared import few, spread, written

WEIGHTS, SHARE, REPEATS, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Patterns and sources are planned on the driver (about 2 seconds for 100,000 of them); more than this many is refused.
MAX_PATTERNS = 1_000_000


def targets(sizes: list[int], weights: list[float], total: float, repeats: int) -> list[float]:
    """total shared by weight, none above repeats * its size; the excess is shared again."""
    order = sorted(range(len(sizes)), key=lambda i: (repeats * sizes[i] / weights[i], i))
    left, weight = float(total), float(sum(weights))
    level = None
    for i in order:
        if left / weight <= repeats * sizes[i] / weights[i]:
            level = left / weight
            break
        left -= repeats * sizes[i]
        weight -= weights[i]
    return [float(repeats * s) if level is None else min(float(repeats * s), level * w) for s, w in zip(sizes, weights)]


def flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int) -> list[int]:
    """Words taken of each pattern: a min-cost flow of patterns(sources, size) to source quotas.

    Pass r of a pattern costs 1 + r * r a word and no other edge has a cost, so a
    cheapest augmenting path is any one that begins with the cheapest pass left:
    a blocking flow (breadth-first levels, then depth first) is pushed until no
    path is left for a pass, and then for the next, rerouting what flows already.
    """
    p, s = len(patterns), len(quotas)
    sink, to, room = p + s, [], []
    head: list[list[int]] = [[] for _ in range(sink + 1)]

    def edge(a: int, b: int, c: int) -> None:
        for x, y, r in ((a, b, c), (b, a, 0)):
            head[x].append(len(to))
            to.append(y)
            room.append(r)

    for i, (members, size) in enumerate(patterns):
        for m in members:
            edge(i, p + m, repeats * size)
    for j, q in enumerate(quotas):
        edge(p + j, sink, q)
    taken = [0] * p
    for _ in range(repeats):
        left = [size for _, size in patterns]
        while True:
            level, line = [-1] * (sink + 1), [i for i in range(p) if left[i]]
            for i in line:
                level[i] = 0
            for a in line:
                for e in head[a]:
                    if room[e] and level[to[e]] < 0:
                        level[to[e]] = level[a] + 1
                        line.append(to[e])
            if level[sink] < 0:
                break
            tried = [0] * (sink + 1)
            for i in range(p):
                path: list[int] = []
                while left[i] and level[i] == 0:
                    a = to[path[-1]] if path else i
                    if a == sink:
                        amount = min(left[i], *(room[e] for e in path))
                        for e in path:
                            room[e] -= amount
                            room[e ^ 1] += amount
                        left[i] -= amount
                        path = path[: next(n for n, e in enumerate([*path, None]) if e is None or not room[e])]
                        continue
                    while tried[a] < len(head[a]) and not (room[head[a][tried[a]]] and level[to[head[a][tried[a]]]] == level[a] + 1):
                        tried[a] += 1
                    if tried[a] < len(head[a]):
                        path.append(head[a][tried[a]])
                    elif path:
                        path.pop()
                        tried[to[path[-1]] if path else i] += 1
                    else:
                        break
        taken = [t + size - rest for t, (_, size), rest in zip(taken, patterns, left)]
    return taken


@K.trimmed
def _sized(iterator, column: int):
    for batch in iterator:
        n = []
        for lo, hi in K.batches(batch.column(column)):
            n.append(np.diff(K.words(*K.flat(batch.column(column).slice(lo, hi - lo)))[3]))
        size = pa.array(np.concatenate(n) if n else np.zeros(0, np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), size], ["doc_id", "sources", "size"])


def mix(docs: DataFrame, *, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", sources_col: str = "source") -> DataFrame:
    """doc_id, sources, size, source_size, target, taken of every document.

    sources_col is a string, or an array of strings for documents in several
    sources. Sources by code point, null last, weigh `weights`, repeating, and
    share `share` of all words; no target exceeds `repeats` times the source's
    size. source_size and target are those of the first source of a document.
    taken counts words, repeats included, never above repeats * size; within a
    pattern whole documents are taken but for one. A null or wordless text has
    size 0 and is not taken. Repeated rows of an id are documents of their own
    in the sums. An empty table gives an empty result.
    """
    column = F.col(sources_col)
    if docs.schema[sources_col].dataType.typeName() != "array":
        column = F.array(column.cast("string"))
    rows = spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sort_array(F.array_distinct(column)).alias("sources"), F.col(text_col).cast("string").alias("text")))
    sized = written(rows.mapInArrow(lambda it: _sized(it, 2), "doc_id long, sources array<string>, size long"), "sized")
    groups = sized.groupBy("sources").agg(F.sum("size").alias("size")).limit(MAX_PATTERNS + 1).collect()
    if len(groups) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    spark = docs.sparkSession
    names = sorted({s for g in groups for s in g["sources"]}, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    sizes = [0] * len(names)
    for g in groups:
        for s in g["sources"]:
            sizes[number[s]] += g["size"]
    weight = [float(weights[i % len(weights)]) for i in range(len(names))]
    target = targets(sizes, weight, share * sum(g["size"] for g in groups), repeats) if names else []
    groups.sort(key=lambda g: [(s is None, s or "") for s in g["sources"]])
    got = flow([(tuple(number[s] for s in g["sources"]), g["size"]) for g in groups], [int(t + 0.5) for t in target], repeats)
    plan = []
    for g, f in zip(groups, got):
        first = min((number[s] for s in g["sources"]), default=None)
        full = min(repeats, f // g["size"]) if g["size"] else 0
        plan.append((g["sources"], full, f - full * g["size"], sizes[first] if first is not None else 0, target[first] if first is not None else 0.0))
    plan_df = spark.createDataFrame(plan, "sources array<string>, full long, part long, source_size long, target double")
    # seeded order: the md5 of seed and id; its first four digits are the histogram's bins
    keyed = sized.withColumn("key", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))).withColumn("bin", F.substring("key", 1, 4))
    bins = keyed.groupBy("sources", "bin").agg(F.sum("size").alias("in_bin"))
    before = bins.withColumn("before", F.expr("sum(in_bin) over (partition by sources order by bin rows between unbounded preceding and current row) - in_bin"))
    same = F.col("a.sources").eqNullSafe(F.col("b.sources"))
    edge = before.alias("a").join(few(plan_df, len(plan)).alias("b"), same).where("before < part and before + in_bin >= part").select("a.sources", F.col("bin").alias("edge"), "before")
    plan_df = plan_df.alias("a").join(edge.alias("b"), same, "left").select("a.*", "edge", "before")
    full = keyed.alias("a").join(few(plan_df, len(plan)).alias("b"), same).select("a.*", "full", "part", "source_size", "target", "edge", "before")
    inside = F.col("bin") == F.col("edge")
    rest = full.where(~F.coalesce(inside, F.lit(False))).withColumn("extra", F.when(F.col("bin") < F.col("edge"), F.col("size")).otherwise(F.lit(0).cast("long")))
    cut = full.where(inside).withColumn("upto", F.expr("sum(size) over (partition by sources order by key, doc_id, size rows between unbounded preceding and current row)"))
    cut = cut.withColumn("extra", F.expr("greatest(0L, least(size, part - before - (upto - size)))")).drop("upto")
    return rest.unionByName(cut).select("doc_id", "sources", "size", "source_size", "target", (F.col("full") * F.col("size") + F.col("extra")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('mix-1:' || doc_id) AS k FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, CASE (i - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM s),
r AS (SELECT *, row_number() OVER o AS j, sum(cap) OVER o - cap AS used, sum(weight) OVER o - weight AS gone FROM w WINDOW o AS (ORDER BY cap / weight, i ROWS UNBOUNDED PRECEDING)),
l AS (SELECT arg_min(((SELECT 1.5::DOUBLE * sum(size) FROM d) - used) / ((SELECT sum(weight) FROM w) - gone), j) AS level FROM r
      WHERE ((SELECT 1.5::DOUBLE * sum(size) FROM d) - used) / ((SELECT sum(weight) FROM w) - gone) <= cap / weight),
t AS (SELECT source, source_size, CASE WHEN level IS NULL THEN cap ELSE least(cap, level * weight) END AS target FROM w CROSS JOIN l),
p AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS want FROM t),
q AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(2, want // source_size) END AS whole FROM p),
c AS (SELECT doc_id, source, size, k, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM d)
SELECT c.doc_id, c.size, q.source_size, q.target,
       CAST(whole * size + greatest(0, least(size, want - whole * source_size - (upto - size))) AS BIGINT) AS taken
FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source
"""
