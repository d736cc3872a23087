"""Word graph, communities and pseudo-lemmas (L4-L20) over nodes(id, form) and edges(src, dst, weight)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.clean import is_number
from textloom.sources.tables import written


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst", "weight").union(edges.select("dst", "src", "weight")).toDF("src", "dst", "weight")


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """L4: nodes without an edge."""
    ends = edges.select(F.col("src").alias("id")).union(edges.select("dst"))
    return nodes.join(ends.distinct(), "id", "left_anti")


def connected(nodes: DataFrame, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) by propagating the smallest id with pointer jumping; checkpointed each round."""
    links = both_ways(edges).select("src", "dst").distinct()
    label = nodes.select("id", F.col("id").alias("component"))
    for _ in range(max_rounds):
        near = links.join(label.withColumnRenamed("id", "dst"), "dst").groupBy("src").agg(F.min("component").alias("m"))
        step = label.join(near, label["id"] == near["src"], "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("up"))
        new = step.join(jump, "component", "left").select("id", "old", F.least("component", F.coalesce("up", "component")).alias("component"))
        new = _checkpoint(new)
        changed = new.where("old <> component").limit(1).count()
        label = new.select("id", "component")
        if not changed:
            return label
    raise RuntimeError("components did not settle")


def _checkpoint(df: DataFrame) -> DataFrame:
    """df as a table in the folder that all nodes share (spark.checkpoint.dir): cuts the lineage, computed once."""
    return written(df, "graph")


def density(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(com_id, n, density) of members(com_id, id): edges over possible edges, 1 for a single word."""
    s, d = members.select(F.col("id").alias("src"), F.col("com_id").alias("cs")), members.select(F.col("id").alias("dst"), F.col("com_id").alias("cd"))
    inner = edges.join(s, "src").join(d, "dst").where("cs = cd").groupBy(F.col("cs").alias("com_id")).agg(F.count("*").alias("e"))
    size = members.groupBy("com_id").agg(F.count("*").alias("n"))
    return size.join(inner, "com_id", "left").select("com_id", "n", F.when(F.col("n") == 1, 1.0).otherwise(2.0 * F.coalesce("e", F.lit(0)) / (F.col("n") * (F.col("n") - 1))).alias("density"))


def mean_length(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """L11."""
    return members.join(nodes, "id").groupBy("com_id").agg(F.avg(F.length("form")).alias("meanlen"))


def representative(members: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(com_id, lemma): highest mean weight of incident edges in the community, then length nearest the mean, then form."""
    s, d = members.select(F.col("id").alias("src"), F.col("com_id").alias("cs")), members.select(F.col("id").alias("dst"), F.col("com_id").alias("cd"))
    mean = both_ways(edges).join(s, "src").join(d, "dst").where("cs = cd").groupBy(F.col("src").alias("id")).agg(F.avg("weight").alias("w"))
    rows = members.join(nodes, "id").join(mean, "id", "left").join(mean_length(members, nodes), "com_id")
    order = Window.partitionBy("com_id").orderBy(F.desc(F.round(F.coalesce("w", F.lit(0.0)), 9)), F.round(F.abs(F.length("form") - F.col("meanlen")), 9), "form")
    return rows.withColumn("r", F.row_number().over(order)).where("r = 1").select("com_id", F.col("form").alias("lemma"))


def mean_similarity(members: DataFrame, nodes: DataFrame, edges: DataFrame, sm=None, **how) -> DataFrame:
    """Mean over all pairs of a community; pairs without an edge are scored."""
    from textloom.operators.similarity import similarity

    m = members.join(nodes, "id")
    pairs = m.alias("a").join(m.alias("b"), (F.col("a.com_id") == F.col("b.com_id")) & (F.col("a.id") < F.col("b.id"))).select("a.com_id", F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.col("a.form").alias("x"), F.col("b.form").alias("y"))
    w = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight")
    pairs = pairs.join(w, ["src", "dst"], "left")
    known = pairs.where("weight is not null").select("com_id", "weight")
    scored = similarity(pairs.where("weight is null").select("com_id", "x", "y"), sm, **how).select("com_id", F.col("normsim").alias("weight"))
    mean = known.union(scored).groupBy("com_id").agg(F.avg("weight").alias("meansim"))
    return members.select("com_id").distinct().join(mean, "com_id", "left").fillna(1.0, ["meansim"])


def _louvain(ids: list, links: dict, total: float, resolution: float) -> dict:
    """One deterministic Louvain run; nodes in id order, ties to the smaller community."""
    graph, top = {i: dict(links.get(i, {})) for i in ids}, {i: i for i in ids}
    while True:
        com, deg = {i: i for i in graph}, {i: sum(w * (2 if j == i else 1) for j, w in graph[i].items()) for i in graph}
        weight, moved, again = dict(deg), False, True
        while again:
            again = False
            for i in sorted(graph):
                near: dict = defaultdict(float)
                for j, w in graph[i].items():
                    if j != i:
                        near[com[j]] += w
                weight[com[i]] -= deg[i]
                gain = lambda c: near.get(c, 0.0) - resolution * weight[c] * deg[i] / (2 * total)
                best = com[i]
                for c in sorted(near):
                    if gain(c) > gain(best) + 1e-12:
                        best = c
                weight[best] += deg[i]
                if best != com[i]:
                    com[i], again, moved = best, True, True
        top = {i: com[c] for i, c in top.items()}
        if not moved:
            return top
        merged: dict = defaultdict(lambda: defaultdict(float))
        for i in graph:
            merged[com[i]]
            for j, w in graph[i].items():
                if j >= i:
                    a, b = com[i], com[j]
                    merged[a][b] += w
                    if a != b:
                        merged[b][a] += w
        graph = {i: dict(v) for i, v in merged.items()}


def _greedy(ids: list, links: dict, total: float, resolution: float) -> dict:
    """Clauset-Newman-Moore: unions by gain of modularity while it is positive; ties to the smaller pair."""
    near = {i: {j: w for j, w in links[i].items() if j != i} for i in ids}
    deg = {i: sum(w * (2 if j == i else 1) for j, w in links[i].items()) for i in ids}
    top = {i: i for i in ids}
    gain = lambda a, b: near[a][b] / total - resolution * deg[a] * deg[b] / (2 * total * total)
    heap = [(-gain(a, b), a, b) for a in ids for b in near[a] if a < b]
    heapify(heap)
    while heap:
        g, a, b = heappop(heap)
        if a not in near or b not in near.get(a, ()) or abs(gain(a, b) + g) > 1e-12:
            continue  # one of them has been merged, or the gain has changed since
        if -g <= 1e-12:
            break
        for j, w in near.pop(b).items():
            near[j].pop(b)
            if j != a:
                near[a][j] = near[j][a] = near[a].get(j, 0.0) + w
        deg[a] += deg.pop(b)
        for j in near[a]:
            heappush(heap, (-gain(a, j), min(a, j), max(a, j)))
        for i, c in top.items():
            if c == b:
                top[i] = a
    return top


def _bridged(ids: list, links: dict) -> dict:
    """The first Girvan-Newman split: the heaviest edge (ties to the smaller pair) goes until a component falls apart."""
    near = {i: {j for j in links[i] if j != i} for i in ids}

    def component(i):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        return seen

    for w, a, b in sorted((-links[i][j], i, j) for i in ids for j in links[i] if i < j):
        near[a].discard(b)
        near[b].discard(a)
        if b not in component(a):
            break
    return {i: min(component(i)) for i in ids}


def _asynchronous(ids: list, links: dict) -> dict:
    """Label propagation, node by node in id order, until every node has a label of the greatest weight among its neighbours.

    A node moves only to a label that weighs more than its own (ties to the smaller), so it ends.
    """
    com, todo = {i: i for i in ids}, ids
    while todo:
        again: set = set()  # only neighbours of a node that moves can have a better label since
        for i in todo:
            near: dict = defaultdict(float)
            for j, w in links[i].items():
                if j != i:
                    near[com[j]] += w
            if near:
                most = max(near.values())
                if most > near.get(com[i], 0.0) + 1e-9:
                    com[i] = min(c for c, w in near.items() if w >= most - 1e-9)
                    again.update(links[i])
        todo = sorted(again)
    return com


def _propagated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same by joins, for graphs of any size: until every node has a label of the greatest weight among its neighbours.

    A node moves only to a label that weighs more than its own (ties to the
    smaller). In a round each label is either left or entered, by a bit of a hash of
    it and of the round: what a node moves to stays, so every round that moves nodes
    raises the weight of the edges whose ends agree, and the rounds end.
    """
    links, label, turn = _checkpoint(both_ways(edges)), _checkpoint(nodes.select("id", F.col("id").alias("com_id"))), 0
    while True:
        votes = links.join(label.toDF("dst", "com_id"), "dst").groupBy(F.col("src").alias("id"), "com_id").agg(F.round(F.sum("weight"), 9).alias("w"))
        votes = votes.join(label.toDF("id", "own"), "id")
        now = F.max(F.when(F.col("com_id") == F.col("own"), F.col("w"))).over(Window.partitionBy("id"))
        better = _checkpoint(votes.withColumn("now", F.coalesce(now, F.lit(0.0))).where("w > now").select("id", "com_id", "w", "own"))
        if not better.head(1):
            break
        moves = None
        while moves is None:
            entered = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0  # noqa: B023, E731
            open_ = better.where(entered(F.col("com_id")) & ~entered(F.col("own")))
            moves = open_ if open_.head(1) else None
            turn += 1
        moves = moves.groupBy("id").agg(F.min(F.struct((-F.col("w")).alias("w"), "com_id")).alias("m")).select("id", F.col("m.com_id").alias("to"))
        label = _checkpoint(label.join(moves, "id", "left").select("id", F.coalesce("to", "com_id").alias("com_id")))
    low = label.groupBy("com_id").agg(F.min("id").alias("low"))
    return label.join(low, "com_id").select(F.col("low").alias("com_id"), "id")


#: Links of a block of nodes, edges that wait to be sent to the blocks, and most nodes whose labels are sent to every task.
LINKS, WAITING, NODES = 1 << 18, 1 << 20, 1 << 26
#: Rounds in which half of all nodes may move, before only moves that surely raise the weight are left; links of the nodes that one task settles in turn.
FREE, IN_TURN = 16, 1 << 22


def _linked(edges: DataFrame, ids: np.ndarray, blocks: int) -> DataFrame:
    """(block, degrees, ends, kinds, weights): the links of the nodes of each block as arrays, written; node k of ids is row k // blocks of block k % blocks.

    weights holds each weight of the block once, kinds which one a link has.
    """

    def sent(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        s, d, w = (np.concatenate(x) for x in zip(*held))
        s, d, w = np.r_[s, d], np.r_[d, s], np.r_[w, w]
        order = np.argsort(s % blocks, kind="stable")
        cuts = np.searchsorted((s % blocks)[order], np.arange(1, blocks))
        parts = [(k, len(x)) for k, x in enumerate(np.split(order, cuts)) if len(x)]
        cols = [np.split(x[order], np.cumsum([n for _, n in parts])[:-1]) for x in (s.astype(np.int32), d.astype(np.int32), w)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in cols)], ["block", "s", "d", "w"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for b in batches:
            s, d, w = (b.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst", "weight"))
            other = s != d
            held, waiting = [*held, (np.searchsorted(ids, s[other]), np.searchsorted(ids, d[other]), w[other])], waiting + int(other.sum())
            if waiting >= WAITING:
                yield sent(held)
                held, waiting = [], 0
        if waiting:
            yield sent(held)

    def joined(rows: pa.Table) -> pa.Table:
        s, d, w = (np.concatenate([np.frombuffer(x, t) for x in rows.column(c).to_pylist()]) for c, t in (("s", np.int32), ("d", np.int32), ("w", float)))
        block = rows.column("block")[0].as_py()
        order = np.argsort(s, kind="stable")
        degrees = np.bincount(s // blocks, minlength=len(range(block, len(ids), blocks))).astype(np.int32)
        weights, kinds = np.unique(w[order], return_inverse=True)
        kinds = kinds.astype(np.uint8 if len(weights) <= 1 << 8 else np.uint16 if len(weights) <= 1 << 16 else np.uint32)
        return pa.table({"block": pa.array([block], pa.int32()), **{k: pa.array([x.tobytes()], pa.binary()) for k, x in (("degrees", degrees), ("ends", d[order]), ("kinds", kinds), ("weights", weights))}})

    sent_to = edges.select("src", "dst", F.col("weight").cast("double").alias("weight")).mapInArrow(dealt, "block int, s binary, d binary, w binary")
    return _checkpoint(sent_to.groupBy("block").applyInArrow(joined, "block int, degrees binary, ends binary, kinds binary, weights binary"))


def _chosen(own: np.ndarray, row: np.ndarray, label: np.ndarray, weight: np.ndarray, entered: np.ndarray, free: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows that have a better label than own, the label that each moves to or -1): row, label, weight of their links."""
    rows, labels = len(own), len(entered)
    if rows * labels <= 16 * len(row):
        votes = np.bincount(row * labels + label, weight, rows * labels).reshape(rows, labels)
        now = votes[np.arange(rows), own]
        better = np.flatnonzero(votes.max(axis=1) > now + 1e-9)
        at, own, now = votes[better], own[better], now[better]
        at = at if free else np.where(entered, at, 0.0)
        most = at.max(axis=1)
        to = np.argmax(at >= most[:, None] - 1e-9, axis=1)
    else:
        key = row * labels + label
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        r, c, w = key[first] // labels, key[first] % labels, np.add.reduceat(weight[order], first)
        now, most = np.zeros(rows), np.zeros(rows)
        now[r[c == own[r]]] = w[c == own[r]]
        better = np.unique(r[w > now[r] + 1e-9])
        open_ = np.ones(len(r), bool) if free else entered[c]
        np.maximum.at(most, r[open_], w[open_])
        tied = open_ & (w >= most[r] - 1e-9)
        to = np.zeros(rows, np.int64)
        to[r[tied][::-1]] = c[tied][::-1]  # the smallest stands last
        to, most, own, now = to[better], most[better], own[better], now[better]
    good = (most > now + 1e-9) if free else (most > now + 1e-9) & ~entered[own]
    return better, np.where(good, to, -1)


def _in_turn(links: DataFrame, label: np.ndarray, nodes: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, label) of nodes, moved one after the other in one task until each has a label of the greatest weight; the others stay."""
    wanted = np.zeros(len(label), bool)
    wanted[nodes] = True

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, degrees, ends, kinds, weights in zip(*(c.to_pylist() for c in batch.columns)):
                degrees, node = np.frombuffer(degrees, np.int32), np.arange(block, len(label), blocks)
                if wanted[node].any():
                    at = np.r_[0, np.cumsum(degrees, dtype=np.int64)]
                    ends = np.frombuffer(ends, np.int32)
                    weights = np.frombuffer(weights, float)[np.frombuffer(kinds, f"u{len(kinds) // len(ends)}")]
                    k = np.flatnonzero(wanted[node])
                    cols = [pa.array(node[k].astype(np.int32)), *(pa.array([x[at[i] : at[i + 1]].tobytes() for i in k], pa.binary()) for x in (ends, weights))]
                    yield pa.RecordBatch.from_arrays(cols, ["node", "ends", "weights"])

    def moved(table: pa.Table) -> pa.Table:
        near = {n: (np.frombuffer(e, np.int32), np.frombuffer(w, float)) for n, e, w in zip(*(table.column(c).to_pylist() for c in ("node", "ends", "weights")))}
        com, todo = label.copy(), sorted(near)
        while todo:
            again: set = set()
            for n in todo:
                ends, weights = near[n]
                names, which = np.unique(com[ends], return_inverse=True)
                votes = np.bincount(which, weights)
                most, own = votes.max(), votes[names == com[n]].sum()
                if most > own + 1e-9:
                    com[n] = names[np.argmax(votes >= most - 1e-9)]
                    again.update(ends[wanted[ends]].tolist())
            todo = sorted(again)
        n = np.array(sorted(near), np.int32)
        return pa.table({"node": pa.array(n), "to": pa.array(np.where(com[n] == label[n], -1, com[n]).astype(np.int32))})

    got = links.mapInArrow(rows, "node int, ends binary, weights binary").groupBy().applyInArrow(moved, "node int, to int").toArrow()
    return got.column("node").to_numpy(), got.column("to").to_numpy()


def _settled(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(com_id, id) of label propagation over edges whose ends(id) are given, until every node has a label of the greatest weight among its neighbours.

    The links of a block of nodes are arrays, made once; labels, four bytes a node,
    go to every task in each round, and what nodes move to comes back. For FREE
    rounds half of the nodes may move, each to its best label (ties to the smaller).
    Then each label is either left or entered in a round: what a node moves to stays,
    so every round that moves nodes raises the weight of the edges whose ends agree,
    and the rounds end. A label is entered if more nodes would come than go; after a
    round without a move by a bit of a hash of it and of the round, so that no two
    labels wait for each other. Once the nodes that could move have IN_TURN links at
    most, one task moves them one after the other until none of them can, which
    raises that weight as well. Only nodes that could move before or have a neighbour
    that moved are looked at.
    """
    ids = np.sort(ends.toArrow().column("id").to_numpy())
    blocks = 1 + 2 * edges.count() // LINKS
    links = _linked(edges, ids, blocks)
    com, moved, again, turn = np.arange(len(ids), dtype=np.int32), np.ones(len(ids), bool), np.ones(len(ids), bool), 0

    def mixed(x: np.ndarray, turn: int) -> np.ndarray:
        h = (x.astype(np.uint64) + np.uint64(turn << 32) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(63)).astype(bool)

    while again.any():
        names, label = np.unique(com, return_inverse=True)
        label, entered, free = label.astype(np.int32), mixed(names, turn), turn < FREE or moved.any()

        def run(batches: Iterator[pa.RecordBatch], label=label, entered=entered, free=free, moved=moved, again=again) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block, degrees, ends, kinds, weights in zip(*(c.to_pylist() for c in batch.columns)):
                    degrees, ends, weights = np.frombuffer(degrees, np.int32), np.frombuffer(ends, np.int32), np.frombuffer(weights, float)
                    kinds = np.frombuffer(kinds, f"u{len(kinds) // max(1, len(ends))}") if len(ends) else ends
                    node = np.arange(block, len(label), blocks)
                    row = np.repeat(np.arange(len(node)), degrees)
                    active = again[node]
                    active[row[moved[ends]]] = True
                    kept = active[row]
                    if kept.any():
                        place = np.cumsum(active) - 1
                        k, to = _chosen(label[node[active]], place[row[kept]], label[ends[kept]], weights[kinds[kept]], entered, free)
                        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (node[active][k], to, degrees[active][k])], ["node", "to", "links"])

        got = links.mapInArrow(run, "node int, to int, links int").toArrow()
        node, to = got.column("node").to_numpy(), got.column("to").to_numpy()
        few = turn >= FREE and got.column("links").to_numpy().sum(dtype=np.int64) <= IN_TURN
        if few and len(node):
            node, to = _in_turn(links, label, node, blocks)
        again, moved = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        again[node] = True
        goes = to >= 0
        if turn < FREE:
            goes &= mixed(node, turn)
        elif free and not few:
            flow = np.bincount(to, minlength=len(names)) - np.bincount(label[node], minlength=len(names))
            entered = np.where(flow == 0, entered, flow > 0)
            goes &= entered[to] & ~entered[label[node]]
        com[node[goes]], moved[node[goes]] = names[to[goes]], True
        turn += 1
    low = np.full(len(ids), len(ids), np.int64)
    np.minimum.at(low, com, np.arange(len(ids)))
    found = ids[low[com]]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(found[np.searchsorted(ids, b.column("id").to_numpy())]), b.column("id")], ["com_id", "id"])

    return ends.select(F.col("id").cast("long").alias("id")).mapInArrow(named, "com_id long, id long")


#: Edges of a graph up to which one task clusters it (some 500 MB there); larger ones are clustered by joins.
IN_TASK = 2_000_000
#: A level of the joins goes on while its rounds raise modularity by this much.
GAIN = 1e-4


def _in_tasks(rows: DataFrame, cluster) -> DataFrame:
    """(graph, com_id, id) of rows(graph, src, dst, weight, total): each graph in one task, by cluster(ids, links, total)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links: dict = defaultdict(dict)
        for s, d, w in zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["weight"].tolist()):
            links[s][d] = links[d][s] = w
        ids = sorted(links)
        com, low = cluster(ids, links, float(pdf["total"].iloc[0])), {}
        for i in ids:
            low.setdefault(com[i], i)
        return pd.DataFrame({"graph": pdf["graph"].iloc[0], "com_id": [low[com[i]] for i in ids], "id": ids})

    return rows.groupBy("graph").applyInPandas(run, "graph long, com_id long, id long")


def _louvain_by_joins(rows: DataFrame, resolution: float) -> DataFrame:
    """The same for graphs of any size: local moves and contraction as joins, all graphs at once.

    In a round every community is either left or entered, by a bit of a hash of
    its id and the round, so neighbours do not swap places; a node goes to the
    community that gains most (ties to the smaller id). Weights of communities are
    rows of a table. The labels with the highest modularity are kept; a level ends
    when four rounds have not raised it by GAIN, so the rounds are bounded by
    4 / GAIN. Then communities become nodes, and levels end when none merges.
    """
    edges = _checkpoint(rows.select("graph", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight", "total"))
    top = None  # id -> node of the present level
    while True:
        both = _checkpoint(edges.where("a <> b").select("graph", "a", "b", "weight").union(edges.where("a <> b").select("graph", "b", "a", "weight")).toDF("graph", "id", "other", "w"))
        ends = edges.select("graph", "total", F.explode(F.array("a", "b")).alias("id"), "weight")
        node = _checkpoint(ends.groupBy("graph", "id").agg(F.sum("weight").alias("deg"), F.first("total").alias("total")))
        label, best, high, since, turn = node.withColumn("com", F.col("id")), None, None, 0, 0
        loops = edges.where("a = b").agg(F.coalesce(F.sum(2 * F.col("weight") / F.col("total")), F.lit(0.0))).first()[0]
        while since < 4:
            label = _checkpoint(label)
            inside = both.join(label.select(F.col("id").alias("other"), "com"), "other").groupBy("id", "com").agg(F.sum("w").alias("k"))
            sums = label.groupBy("com").agg(F.sum("deg").alias("sum"), F.first("total").alias("total"))
            own = label.select("id", "deg", "total", F.col("com").alias("mine"))
            votes = _checkpoint(own.join(inside, "id").join(sums.select("com", "sum"), "com"))
            # modularity of the labels as they are, scaled by each graph's weight
            tied = votes.where("com = mine").agg(F.coalesce(F.sum(F.col("k") / F.col("total")), F.lit(0.0))).first()[0]
            spread = sums.agg(F.sum(F.pow(F.col("sum") / F.col("total"), 2) / 2)).first()[0]
            quality = tied + loops - resolution * spread
            since = 0 if high is None or quality > high + GAIN else since + 1
            if high is None or quality > high:
                best, high = label, quality
            if since == 4:
                break
            open_ = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 0  # noqa: B023, E731
            gain = F.col("k") - resolution * F.col("deg") / (2 * F.col("total")) * (F.col("sum") - F.when(F.col("com") == F.col("mine"), F.col("deg")).otherwise(0.0))
            stay = F.max(F.when(F.col("com") == F.col("mine"), F.col("gain")))
            choice = votes.withColumn("gain", F.round(gain, 12)).where((F.col("com") == F.col("mine")) | (open_(F.col("com")) & ~open_(F.col("mine"))))
            rest = -resolution * F.col("deg") / (2 * F.col("total")) * (F.col("sum") - F.col("deg"))  # of a node without a link inside its community
            choice = choice.groupBy("id").agg(stay.alias("stay"), F.min(F.struct((-F.col("gain")).alias("gain"), "com")).alias("m"))
            label = label.join(choice, "id", "left").join(sums.select("com", "sum"), "com").withColumn("stay", F.coalesce("stay", F.round(rest, 12)))
            label = label.select("graph", "id", "deg", "total", F.when(-F.col("m.gain") > F.col("stay") + 1e-12, F.col("m.com")).otherwise(F.col("com")).alias("com"))
            turn += 1
        moved = best.where("com <> id").limit(1).count()
        top = best.select("graph", "id", "com") if top is None else _checkpoint(top.join(best.select(F.col("id").alias("com"), F.col("com").alias("up")), "com").select("graph", "id", F.col("up").alias("com")))
        if not moved:
            low = top.groupBy("com").agg(F.min("id").alias("com_id"))
            return top.join(low, "com").select("graph", "com_id", "id")
        at = best.select("id", "com")
        merged = edges.join(at.toDF("a", "ca"), "a").join(at.toDF("b", "cb"), "b").groupBy("graph", F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
        edges = _checkpoint(merged.agg(F.sum("weight").alias("weight"), F.first("total").alias("total")))


def _labels_by_joins(rows: DataFrame) -> DataFrame:
    """(graph, com_id, id) of label propagation over large graphs."""
    rows = _checkpoint(rows)
    nodes = rows.select("graph", F.explode(F.array("src", "dst")).alias("id")).distinct()
    return _propagated(nodes, rows).join(nodes, "id").select("graph", "com_id", "id")


def _clustered(rows: DataFrame, algo: str = "louvain", resolution: float = 1.0) -> DataFrame:
    """(graph, com_id, id) of rows(graph, src, dst, weight, total): com_id is the smallest id. Node ids belong to one graph.

    Graphs of up to IN_TASK edges are clustered in one task each, larger ones by joins.
    """
    rows = _checkpoint(rows)
    large = _checkpoint(rows.groupBy("graph").count().where(F.col("count") > IN_TASK).select("graph"))
    one = (lambda ids, links, total: _asynchronous(ids, links)) if algo == "lpa" else (lambda ids, links, total: _louvain(ids, links, total, resolution))
    if not large.head(1):
        return _in_tasks(rows, one)
    rest = rows.join(large, "graph", "left_semi")
    return _in_tasks(rows.join(large, "graph", "left_anti"), one).union(_labels_by_joins(rest) if algo == "lpa" else _louvain_by_joins(rest, resolution))


def modularity(members: DataFrame, edges: DataFrame, resolution: float = 1.0) -> float:
    """Newman's modularity of members(com_id, id); an edge counts once."""
    total = edges.agg(F.sum("weight")).first()[0]
    if not total:
        return 0.0
    s, d = members.select(F.col("id").alias("src"), F.col("com_id").alias("cs")), members.select(F.col("id").alias("dst"), F.col("com_id").alias("cd"))
    rows = _checkpoint(edges.join(s, "src").join(d, "dst"))
    inside = rows.where("cs = cd").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    spread = rows.select(F.explode(F.array("cs", "cd")).alias("c"), "weight").groupBy("c").agg(F.sum("weight").alias("w")).agg(F.sum(F.pow("w", F.lit(2)))).first()[0]
    return inside / total - resolution * spread / (4 * total * total)


def communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, algo: str = "louvain") -> DataFrame:
    """members(com_id, id). Components are clustered apart, with the modularity of the whole graph; com_id is the smallest id.

    algo: louvain; lpa (label propagation until each node has a label of the greatest
    weight among its neighbours, ties to the smaller); louvain runs a component of up
    to IN_TASK edges in one task, larger ones by joins; lpa runs graphs of more edges
    in blocks of nodes (by joins above NODES nodes). greedy (the pair of communities
    whose union gains most modularity is merged first) and girvan_newman (the first
    split, taking away the heaviest edge until a component falls apart) always run a
    component in one task.
    """
    if algo not in ("louvain", "greedy", "girvan_newman", "lpa"):
        raise ValueError(f"unknown algorithm {algo}")
    edges = _checkpoint(edges)  # read in every round
    if algo == "lpa" and edges.count() > IN_TASK:  # labels never leave a component
        ends = _checkpoint(edges.select(F.explode(F.array(F.col("src").cast("long"), F.col("dst").cast("long"))).alias("id")).distinct())
        if ends.count() <= NODES:
            return _settled(edges, ends).union(nodes.select("id").join(ends, "id", "left_anti").select(F.col("id").alias("com_id"), "id"))
    comp = connected(nodes, edges)
    total = edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    rows = edges.join(comp.withColumnRenamed("id", "src"), "src").select(F.col("component").alias("graph"), "src", "dst", "weight", F.lit(total).alias("total"))
    if algo in ("louvain", "lpa"):
        found = _clustered(rows, algo, resolution)
    else:
        found = _in_tasks(rows, lambda ids, links, total: _greedy(ids, links, total, resolution) if algo == "greedy" else _bridged(ids, links))
    return found.select("com_id", "id").union(isolates(nodes, edges).select(F.col("id").alias("com_id"), "id"))


def dense_communities(nodes: DataFrame, edges: DataFrame, algo: str = "louvain", resolution: float = 1.0, folder: str | None = None) -> DataFrame:
    """Communities split again inside their own subgraph until each is a clique or does not split.

    A community that does not split is accepted; members without a link inside it become communities of their own.
    All sparse communities of a round are split in one plan; every round splits each
    that is left into smaller ones, so the rounds end. With a folder each round is
    saved there (L7), and a call goes on from the last round that was saved whole.
    """
    edges = _checkpoint(edges)
    state, number = (resume(nodes.sparkSession, folder), last_round(nodes.sparkSession, folder)) if folder else (None, None)
    if state is None:
        state, number = communities(nodes, edges, resolution, algo).withColumn("done", F.lit(False)), 0
        state = save_round(state, folder, 0) if folder else _checkpoint(state)
    while state.where("not done").head(1):
        current = state.where("not done").select("com_id", "id")
        low = _checkpoint(density(current, edges).where("density < 1").select("com_id"))
        rest = current.join(low, "com_id")
        s, d = rest.select(F.col("id").alias("src"), F.col("com_id").alias("cs")), rest.select(F.col("id").alias("dst"), F.col("com_id").alias("cd"))
        inner = edges.join(s, "src").join(d, "dst").where("cs = cd").select(F.col("cs").alias("graph"), "src", "dst", "weight")
        again = _checkpoint(_split(rest, _checkpoint(inner), resolution))
        same = again.groupBy("parent").agg(F.count_distinct("com_id").alias("k")).select("parent", (F.col("k") == 1).alias("done"))
        fine = current.join(low, "com_id", "left_anti").withColumn("done", F.lit(True))
        new = state.where("done").unionByName(fine).unionByName(again.join(same, "parent").select("com_id", "id", "done"))
        number += 1
        state = save_round(new, folder, number) if folder else _checkpoint(new)
    return state.select("com_id", "id")


def _split(rest: DataFrame, inner: DataFrame, resolution: float) -> DataFrame:
    """Louvain inside each community of rest(com_id, id) by its own edges inner(graph, src, dst, weight): (parent, com_id, id)."""
    rows = inner.join(inner.groupBy("graph").agg(F.sum("weight").alias("total")), "graph")
    found = _checkpoint(_clustered(rows.select("graph", "src", "dst", "weight", "total"), resolution=resolution).withColumnRenamed("graph", "parent"))
    lone = rest.join(found.select("id"), "id", "left_anti").select(F.col("com_id").alias("parent"), F.col("id").alias("com_id"), "id")
    return found.union(lone)


def select_groups(coms: DataFrame) -> DataFrame:
    """coms(com_id, n, meansim, meanlen) that are used as word groups."""
    return coms.where("n > 1 and ((meansim >= 0.7 and meanlen > 3) or (meansim = 1 and meanlen <= 3))")


def word_groups(members: DataFrame, nodes: DataFrame, edges: DataFrame, sm=None, **how) -> DataFrame:
    """(com_id, n, density, meansim, meanlen, lemma, selected) of every community."""
    coms = density(members, edges).join(mean_similarity(members, nodes, edges, sm, **how), "com_id").join(mean_length(members, nodes), "com_id").join(representative(members, nodes, edges), "com_id")
    return coms.join(select_groups(coms).select("com_id", F.lit(True).alias("selected")), "com_id", "left").fillna(False, ["selected"])


def fine_tune(members: DataFrame, nodes: DataFrame, edges: DataFrame, sm, minsim: float = 0.5, algo: str = "louvain", **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(communities that stay, communities of the short words, phonetic edges of these).

    The words of all communities with short words are pooled, compared
    phonetically (sm) pair by pair whatever community they come from, and built
    into communities again by the rounds of dense_communities. Ids stay those of
    nodes. how: gap_start, gap_more, disfavour of the comparison.
    """
    from textloom.operators.similarity import phonetic_edges

    coms = mean_similarity(members, nodes, edges).join(mean_length(members, nodes), "com_id")
    again = _checkpoint(short_word_candidates(coms).select("com_id"))
    part = _checkpoint(members.join(again, "com_id", "left_semi").select("id").join(nodes, "id").select("id", "form"))
    links = _checkpoint(phonetic_edges(part, sm, minsim, **how))
    return members.join(again, "com_id", "left_anti").select("com_id", "id"), dense_communities(part, links, algo), links


def last_round(spark, path: str) -> int | None:
    """The number of the last round that was saved whole below path (compared as numbers), None before the first."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(f"{path}/round=*/_SUCCESS")
    done = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where)
    return max((int(f.getPath().getParent().getName().removeprefix("round=")) for f in done or ()), default=None)


def resume(spark, path: str) -> DataFrame | None:
    """The state (com_id, id, done) of the last round below path, None before the first."""
    number = last_round(spark, path)
    return None if number is None else spark.read.schema("com_id long, id long, done boolean").parquet(f"{path}/round={number}")


def save_round(state: DataFrame, path: str, number: int) -> DataFrame:
    """One round's communities below path, so that a training can go on from there; the state as saved.

    Communities (com_id, id) without a column done are finished ones.
    """
    state = state if "done" in state.columns else state.withColumn("done", F.lit(True))
    state.select("com_id", "id", "done").write.mode("overwrite").parquet(f"{path}/round={number}")
    return resume(state.sparkSession, path)


def short_word_candidates(coms: DataFrame) -> DataFrame:
    """Communities that are scored again phonetically."""
    return coms.where("(meansim < 0.8 and meanlen <= 6) or meanlen <= 3")


def assign_lemmas(nodes: DataFrame, members: DataFrame, reps: DataFrame) -> DataFrame:
    """(form, lemma): the group's lemma, '123' for numbers, else the form."""
    own = members.join(reps, "com_id").select("id", "lemma")
    return nodes.join(own, "id", "left").select("form", F.coalesce("lemma", F.when(is_number(F.col("form")), "123").otherwise(F.col("form"))).alias("lemma"))


def join_groups(groups: DataFrame, external: DataFrame) -> DataFrame:
    """groups(group_id, form) of one external lemma(form, lemma) merged: (group_id, lemma).

    A lemma must reach two groups; groups claimed by more than one lemma are dropped first, and two must remain.
    """
    claims = groups.join(external, "form").select("group_id", "lemma").distinct()  # equal claims are one
    wide = claims.groupBy("lemma").agg(F.count("*").alias("k")).where("k >= 2").select("lemma")
    claims = claims.join(wide, "lemma")
    twice = claims.groupBy("group_id").agg(F.count("*").alias("k")).where("k > 1").select("group_id")
    claims = claims.join(twice, "group_id", "left_anti")
    left = claims.groupBy("lemma").agg(F.count("*").alias("k")).where("k >= 2").select("lemma")
    return claims.join(left, "lemma").select("group_id", "lemma")


def merge_groups(groups: DataFrame, coms: DataFrame, external: DataFrame) -> DataFrame:
    """The merged groups of join_groups: (lemma, groups, representative, meansim).

    coms(group_id, n, lemma, meansim): the representative is the lemma of the
    largest group (ties to the smaller group id), meansim the mean of the groups.
    """
    rows = join_groups(groups, external).join(coms.withColumnRenamed("lemma", "own"), "group_id")
    first = F.min(F.struct((-F.col("n")).alias("n"), "group_id", "own"))
    return rows.groupBy("lemma").agg(F.sort_array(F.collect_list("group_id")).alias("groups"), first.alias("f"), F.avg("meansim").alias("meansim")).select("lemma", "groups", F.col("f.own").alias("representative"), "meansim")


def join_lone_words(words: DataFrame, external: DataFrame) -> DataFrame:
    """Lone words(form) that share an external lemma with another."""
    got = words.join(external, "form")
    return got.join(got.groupBy("lemma").agg(F.count("*").alias("k")).where("k > 1").select("lemma"), "lemma").select("form", "lemma")


def majority_lemma(pairs: DataFrame) -> DataFrame:
    """(form, lemma): the most frequent lemma of each form, ties to the smaller."""
    n = pairs.groupBy("form", "lemma").agg(F.count("*").alias("n"))
    return n.groupBy("form").agg(F.min(F.struct((-F.col("n")).alias("n"), "lemma")).alias("m")).select("form", "m.lemma")


#: Letters with a letter above them, and how each may be spelled.
SPELLINGS = {"aͤ": ("a", "ae"), "eͤ": ("e", "ee"), "oͤ": ("o", "oe"), "uͤ": ("u", "ue"), "uͦ": ("u", "uo"), "uͮ": ("u", "v", "uu", "uv"), "vͤ": ("u", "v", "ue", "ve")}


def form_variants(form: Column) -> Column:
    """Array of the spellings of a token: itself if it is of a-z; else those of the first marked letter, in the order of
    SPELLINGS, that it holds; none for any other token."""
    out = F.when(form.rlike("^[a-z]+$"), F.array(form))
    for mark, spelled in SPELLINGS.items():
        out = out.when(F.contains(form, F.lit(mark)), F.array(*[F.replace(form, F.lit(mark), F.lit(x)) for x in spelled]))
    return out.otherwise(F.array().cast("array<string>"))


def reference_lemmas(tokens: DataFrame) -> DataFrame:
    """(form, lemma) of annotated tokens(ord, form, simple, lemma): the most frequent lemma of each spelling.

    Ties go to the lemma that was seen first (by ord). A token without a lemma (--)
    counts as the number 1234 if its first spelling is written with numeral letters, and
    not at all otherwise.
    """
    rows = tokens.select("ord", F.lower("simple").alias("simple"), F.lower("lemma").alias("lemma"), form_variants(F.lower("form")).alias("v")).where(F.size("v") > 0)
    none = (F.col("lemma") == "--") | (F.col("simple") == "--")
    rows = rows.withColumn("v", F.when(~none, F.col("v")).when(F.col("v")[0].rlike("^[ijvuxlcdm]+$"), F.slice("v", 1, 1)).otherwise(F.array().cast("array<string>")))
    seen = rows.select("ord", F.explode("v").alias("form"), F.when(none, "1234").otherwise(F.col("lemma")).alias("lemma"))
    n = seen.groupBy("form", "lemma").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    return n.groupBy("form").agg(F.min(F.struct((-F.col("n")).alias("n"), "first", "lemma")).alias("m")).select("form", "m.lemma")


def lemmatise(rows: DataFrame, lemmas: DataFrame, keys: list[str]) -> DataFrame:
    """Each token's core [a-z]+ between markers replaced by its lemma; other tokens stay."""
    tok = rows.select(*keys, F.posexplode(F.split("text", " ")).alias("pos", "tok"))
    shape = r"^((?:#[A-Za-z]+#|[^a-z#])*)([a-z]+)((?:#[A-Za-z]+#|[^a-z#])*)$"
    parts = [F.regexp_extract("tok", shape, i).alias(n) for i, n in ((1, "pre"), (2, "form"), (3, "post"))]
    got = tok.select(*keys, "pos", "tok", *parts).join(lemmas, "form", "left")
    out = F.when(F.col("lemma").isNotNull(), F.concat("pre", "lemma", "post")).otherwise(F.col("tok"))
    return got.groupBy(*keys).agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("pos", out.alias("t")))), lambda p: p["t"])).alias("text"))


def train(nodes: DataFrame, edges: DataFrame, algo: str = "louvain") -> tuple[DataFrame, DataFrame]:
    """Members and the lemma map of the word graph; algo finds the first communities."""
    nodes, edges = _checkpoint(nodes), _checkpoint(edges)
    members = _checkpoint(dense_communities(nodes, edges, algo))
    reps = representative(members, nodes, edges)
    return members, assign_lemmas(nodes, members, reps)
