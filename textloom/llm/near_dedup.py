"""MinHash near-duplicate linking with sequential Bayesian verification.

1. One pass makes each document's set of distinct word shingles (64-bit hashes),
   its size, a 128-bit key of the set and a signature of BANDS * ROWS minima.
   Documents with equal sets form one class, represented by the smallest id.
2. Class representatives meet in banded buckets. A bucket is compared with its
   smallest member (its pivot), never with itself: a bucket of m gives m-1 pairs.
3. Signatures of a pair are compared in batches. After each batch the posterior
   of the similarity (uniform prior, Beta) decides: if the chance that it
   reaches the threshold is below MISS, the pair is dropped.
4. Survivors are verified on their full shingle sets.
5. Where a bucket still spans several components, the members outside its
   largest one are compared with all members of the others, so that no link is
   lost because it avoids the pivot. Only signatures travel for that, bucket by
   bucket; a bucket beyond BLOCK members is dealt into blocks that meet in
   pairs. Texts are dealt into blocks of bounded size; a text is sent once to
   each block where the posterior leaves it a pair, and is verified there.

With 50 bands of 6 rows a pair at similarity 0.8 escapes every band with
probability (1 - 0.8**6)**50 < 3e-7.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.components import components
from textloom.llm.shared import few, keyed, texts, written

BANDS, ROWS = 50, 6
#: A pair is pruned when its posterior chance of reaching the threshold is below this.
MISS = 1e-6
#: Signature positions compared between two looks at the posterior.
LOOK = 60
#: Signatures in a block of a large bucket in the second comparison (two blocks meet in a task).
BLOCK = 4096
#: Bytes of shingle hashes in a block of verified texts, and of a pivot's candidates in one task.
VERIFY_BYTES = 4 << 20

_MULT = np.random.default_rng(11).integers(1, 2**31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_BASE = K._Q


def shingle_sets(column: pa.Array, k: int):
    """Sorted distinct shingle hashes of each text (A-Z lower-cased); fewer than k words make one shingle."""
    for lo, hi in K.batches(column):
        data, offs = K.flat(column.slice(lo, hi - lo))
        h, _, _, at = K.words(data, offs, lower=True)
        grams = K.rolling(h, k)
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield K.spans(h[a:b], np.array([0]), np.array([b - a])) + K.U64(b - a)
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Low 16 bits of the minimum of each permutation over the set (a set that is not empty)."""
    x = (shingles >> K.U64(32)).astype(np.uint32)
    low = np.full(len(_MULT), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 512):
        np.minimum(low, (x[at : at + 512, None] * _MULT).min(axis=0), out=low)
    return low.astype(np.uint16)


def band_keys(sig: np.ndarray) -> np.ndarray:
    h = K.rolling(sig.astype(np.uint64) + K.U64(1), ROWS)[::ROWS]
    return K.mix(h ^ (np.arange(BANDS, dtype=np.uint64) * K.U64(0x9E3779B97F4A7C15))).astype(np.int64)


@K.trimmed
def _signed(iterator, k: int):
    for batch in iterator:
        ids, texts_ = batch.column(0), batch.column(1)
        n, k1, k2, sigs, bands = [], [], [], [], []
        for s in shingle_sets(texts_, k):
            n.append(len(s))
            k1.append(int((K.mix(s)).sum(dtype=np.uint64).astype(np.int64)))
            k2.append(int((K.mix(s ^ K.U64(0xA5A5A5A5A5A5A5A5))).sum(dtype=np.uint64).astype(np.int64)))
            sigs.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(sigs, pa.binary())], ["key", "n_shingles", "k1", "k2", "sig"])


@K.trimmed
def _banded(iterator):
    for batch in iterator:
        ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keys = [band_keys(np.frombuffer(s, np.uint16)) for s in batch.column(2).to_pylist()]
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, BANDS)), pa.array(np.repeat(n, BANDS)), pa.array(np.concatenate(keys))], ["id", "n", "band"])


@lru_cache(maxsize=8)
def cut_table(similarity: float, miss: float) -> tuple[tuple[int, int], ...]:
    """(positions, fewest agreements) for each look: fewer agreements are pruned.

    After m agreements in t positions the posterior is Beta(m+1, t-m+1); its mass
    above the threshold is summed as a binomial tail: P(Bin(t+1, s) <= m).
    """
    out = []
    for t in range(LOOK, BANDS * ROWS + 1, LOOK):
        mass, term, need = 0.0, (1 - similarity) ** (t + 1), 0
        for m in range(t + 1):
            mass += term
            if mass >= miss:
                need = m
                break
            term *= (t + 1 - m) / (m + 1) * similarity / (1 - similarity)
        out.append((t, need))
    return tuple(out)


def _plausible(sigs: np.ndarray, x: np.ndarray, y: np.ndarray, similarity: float, miss: float) -> np.ndarray:
    """Positions of the pairs (x, y) that no look at the posterior has pruned."""
    alive, agree, before = np.arange(len(x)), np.zeros(len(x), np.int64), 0
    for t, need in cut_table(similarity, miss):
        for lo in range(0, len(alive), 1 << 16):
            some = alive[lo : lo + (1 << 16)]
            agree[some] += (sigs[x[some], before:t] == sigs[y[some], before:t]).sum(axis=1)
        alive, before = alive[agree[alive] >= need], t
    return alive


def _holding(sets: dict, x: np.ndarray, y: np.ndarray, per_cent: int) -> np.ndarray:
    """True for the pairs (x, y) whose full sets reach the threshold; x comes sorted."""
    out = np.zeros(len(x), bool)
    edges = np.flatnonzero(np.r_[True, x[1:] != x[:-1], True]) if len(x) else []
    for lo, hi in zip(edges, edges[1:]):
        own = sets[x[lo]]
        for a in range(lo, hi, 256):
            some = [sets[j] for j in y[a : min(hi, a + 256)]]
            size = np.array([len(s) for s in some])
            every = np.concatenate(some)
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            both = np.add.reduceat(hit, np.r_[0, np.cumsum(size)[:-1]])
            out[a : a + len(some)] = 100 * both >= per_cent * (len(own) + size - both)
    return out


def _links(rows: pa.Table, x: np.ndarray, y: np.ndarray, k: int, per_cent: int, miss: float):
    """The pairs of row numbers (x, y) that are links, after pruning and verification."""
    sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS * ROWS)
    n = rows.column("n").to_numpy()
    fits = 100 * np.minimum(n[x], n[y]) >= per_cent * np.maximum(n[x], n[y])
    x, y = x[fits], y[fits]
    alive = _plausible(sigs, x, y, per_cent / 100, miss)
    order = alive[np.lexsort((y[alive], x[alive]))]
    x, y = x[order], y[order]
    used = np.unique(np.r_[x, y])
    sets = dict(zip(used.tolist(), shingle_sets(rows.column("text").take(pa.array(used)), k))) if len(used) else {}
    good = _holding(sets, x, y, per_cent)
    return x[good], y[good]


def _out(pairs):
    ids = [pa.array(np.concatenate([p[i] for p in pairs]) if pairs else np.zeros(0, np.int64), pa.int64()) for i in (0, 1)]
    return pa.RecordBatch.from_arrays(ids, ["a", "b"])


def _runs(iterator, *keys: str):
    """(key, rows) of each run of equal keys within a batch, from a partition sorted by the keys."""
    for batch in iterator:
        if batch.num_rows:
            cols = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in keys]
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            for lo, hi in zip(np.r_[0, change], np.r_[change, batch.num_rows]):
                yield tuple(int(c[lo]) for c in cols), batch.slice(lo, hi - lo)


@K.trimmed
def _starred(iterator, k: int, per_cent: int, miss: float):
    """Each key holds a pivot (first) and then its candidates, which pass by in batches."""
    now, head, found = None, None, []
    for key, rows in _runs(iterator, "pivot", "salt"):
        if key != now:
            now, head, rows = key, rows.slice(0, 1), rows.slice(1)
        if rows.num_rows:
            table = pa.Table.from_batches([head, rows])
            ids = table.column("id").to_numpy()
            x, y = _links(table, np.zeros(len(ids) - 1, np.int64), np.arange(1, len(ids)), k, per_cent, miss)
            found.append((ids[x], ids[y]))
    yield _out(found)


def _plausible_pairs(table: pa.Table, left: int, right: int, per_cent: int, miss: float):
    """Row numbers (x, y) of the pairs of two blocks, in different components, that may be links; in pieces."""
    comp, block, n = (table.column(c).to_numpy() for c in ("component", "block", "n"))
    sigs = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(len(table), -1)
    i, j = np.flatnonzero(block == left), np.flatnonzero(block == right)
    step = max(1, (1 << 18) // max(1, len(j)))
    for at in range(0, len(i), step):
        x, y = np.repeat(i[at : at + step], len(j)), np.tile(j, len(i[at : at + step]))
        ok = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= per_cent * np.maximum(n[x], n[y]))
        if left == right:
            ok &= x < y
        x, y = x[ok], y[ok]
        alive = _plausible(sigs, x, y, per_cent / 100, miss)
        if len(alive):
            alive.sort()
            yield x[alive], y[alive]


def _grouped(iterator):
    """(left, right, rows) of each key (..., left, right), from a partition sorted by key; groups are of bounded size."""
    now, held = None, []
    for key, rows in _runs(iterator, "key", "left", "right"):
        if key != now and held:
            yield *now[1:], pa.Table.from_batches(held)
            held = []
        now = key
        held.append(rows)
    if held:
        yield *now[1:], pa.Table.from_batches(held)


@K.trimmed
def _screened(iterator, per_cent: int, miss: float):
    """Each key holds signatures of one or two blocks of a bucket; out comes, for each document, the blocks of texts where it may have links."""
    for left, right, table in _grouped(iterator):
        ids, home = table.column("id").to_numpy(), table.column("home").to_numpy()
        found: set[tuple[int, int]] = set()
        for x, y in _plausible_pairs(table, left, right, per_cent, miss):
            both = np.unique(np.c_[np.r_[x, y], home[np.r_[y, x]]], axis=0)
            found.update(map(tuple, both.tolist()))
        blocks: dict[int, list[int]] = {}
        for r, h in sorted(found):
            blocks.setdefault(int(ids[r]), []).append(h)
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array(list(blocks.values()), pa.list_(pa.int64()))], ["id", "meets"])


@K.trimmed
def _verified(iterator, k: int, per_cent: int, miss: float):
    """Each key holds the texts of one or two blocks; out come the links between different components."""
    for left, right, table in _grouped(iterator):
        ids, sets = table.column("id").to_numpy(), {}
        for x, y in _plausible_pairs(table, left, right, per_cent, miss):
            new = np.array([r for r in np.unique(np.r_[x, y]).tolist() if r not in sets])
            if len(new):
                sets.update(zip(new.tolist(), shingle_sets(table.column("text").take(pa.array(new)), k)))
            good = _holding(sets, x, y, per_cent)
            if good.any():
                yield _out([(ids[x[good]], ids[y[good]])])


def near_duplicates(docs: DataFrame, *, k: int = 5, per_cent: int = 80, miss: float = MISS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id, kept.

    Two documents are linked when 100 * |A & B| >= per_cent * |A | B| for their
    sets of distinct k-word shingles. class_id is the smallest id with the same
    set, component_id the smallest id reachable over links, kept marks the
    documents of that id. A null, empty or wordless text has an empty set, is
    linked with nothing and is kept. Rows whose ids are null or repeat are
    documents of their own: each comes out once with its own set, and two rows
    of one id are in one component only if links join them. A null id counts as
    larger than all others; of a component without any id one row is kept. An
    empty table gives an empty result; other columns of docs are not read.
    """
    source, numbered = keyed(texts(docs, id_col=id_col, text_col=text_col))
    out = _linked(source.select("key", "text"), k, per_cent, miss)
    if not numbered:
        return out.select(F.col("key").alias("doc_id"), "n_shingles", "class_id", "component_id", (F.col("key") == F.col("component_id")).alias("kept"))
    out = written(out.join(source.select("key", "doc_id"), "key"), "linked")
    least = out.groupBy("component_id").agg(F.min("doc_id").alias("component"), F.min("key").alias("first"))
    same = out.groupBy("class_id").agg(F.min("doc_id").alias("class"))
    out = out.join(least, "component_id").join(same, "class_id")
    kept = F.coalesce(F.col("doc_id") == F.col("component"), F.col("component").isNull() & (F.col("key") == F.col("first")))
    return out.select("doc_id", "n_shingles", F.col("class").alias("class_id"), F.col("component").alias("component_id"), kept.alias("kept"))


def _linked(source: DataFrame, k: int, per_cent: int, miss: float) -> DataFrame:
    """key, n_shingles, class_id, component_id of documents(key, text) with distinct keys; the last two are keys."""
    signed = written(source.mapInArrow(lambda it: _signed(it, k), "key long, n_shingles long, k1 long, k2 long, sig binary"), "signed")
    full = signed.where("n_shingles > 0")
    classes = full.groupBy("k1", "k2", "n_shingles").agg(F.min("key").alias("class_id"))
    member = written(full.select("key", "n_shingles", "k1", "k2").join(classes, ["k1", "k2", "n_shingles"]).select("key", "class_id"), "member")
    reps = full.select("key", "n_shingles", "sig").join(member.where("key = class_id").select("key"), "key", "left_semi")
    reps = written(reps.select(F.col("key").alias("id"), F.col("n_shingles").alias("n"), "sig"), "reps")

    banded = reps.mapInArrow(_banded, "id long, n long, band long")
    pivots = banded.groupBy("band").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("size")).where("size > 1")
    pivots = few(written(pivots, "pivots"))  # written first: Spark can split a hot band of a plain shuffle
    buckets = written(banded.join(pivots, "band").select("band", "size", "id", "n", F.col("p.id").alias("pivot"), F.col("p.n").alias("pn")), "buckets")
    pairs = buckets.where("id <> pivot").where(100 * F.least("n", "pn") >= per_cent * F.greatest("n", "pn")).groupBy("id", "pivot").agg(F.first("n").alias("n"))
    pairs = written(pairs, "pairs")
    # a pivot with many candidates is repeated, once for each VERIFY_BYTES of them
    salts = pairs.groupBy("pivot").agg(F.ceil(F.sum("n") * 8 / VERIFY_BYTES).cast("int").alias("salts"))
    members = pairs.join(salts, "pivot").select("pivot", F.expr("cast(pmod(xxhash64(id), salts) as int)").alias("salt"), "id", F.lit(1).alias("role"))
    heads = salts.select("pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("pivot").alias("id"), F.lit(0).alias("role"))
    needed = _texts_of(pairs.select("id").union(pairs.select("pivot")), source).join(reps, "id")
    rows = members.union(heads).join(needed, "id").repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "role")
    links = written(rows.mapInArrow(lambda it: _starred(it, k, per_cent, miss), "a long, b long"), "links")

    labels = components(links)
    more = _beyond_pivots(buckets, labels, reps, source, k, per_cent, miss)
    if more is not None:
        labels = components(links.union(more))
    out = signed.select("key", "n_shingles").join(member, "key", "left").withColumn("class_id", F.coalesce("class_id", "key"))
    out = out.join(labels.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    return out.select("key", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))


def _beyond_pivots(buckets: DataFrame, labels: DataFrame, reps: DataFrame, source: DataFrame, k: int, per_cent: int, miss: float) -> DataFrame | None:
    """Links between members of one bucket that the pivots have left in different components."""
    # a bucket of two has been compared
    seen = buckets.where("size > 2").join(labels, "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    open_ = seen.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    part = written(seen.join(open_, "band"), "open")
    sizes = part.groupBy("band", "component").agg(F.count("*").alias("c"))
    size = sizes.groupBy("band").agg(F.max(F.struct("c", "component")).alias("m"), F.sum("c").alias("c"))
    size = size.select("band", F.col("m.component").alias("main"), F.ceil((F.col("c") - F.col("m.c")) / BLOCK).cast("int").alias("rests"), F.ceil(F.col("m.c") / BLOCK).cast("int").alias("mains"))
    # blocks 0 .. rests-1 hold the members outside the main component and meet all blocks, the others meet those
    part = part.join(size, "band").withColumn("rest", F.col("component") != F.col("main"))
    part = part.withColumn("block", F.expr("cast(if(rest, pmod(xxhash64(id), rests), rests + pmod(xxhash64(id), mains)) as int)"))
    part = part.withColumn("with", F.explode(F.expr("sequence(0, if(rest, rests + mains, rests) - 1)")))
    part = part.select(F.col("band").alias("key"), "id", "component", "block", F.least("block", "with").alias("left"), F.greatest("block", "with").alias("right"))
    short = written(reps.join(part.select("id").distinct(), "id", "left_semi").select("id", "n", "sig").mapInArrow(_shortened, "id long, n long, sig binary"), "short")
    homes = -(-(short.agg(F.sum("n")).first()[0] or 1) * 8 // VERIFY_BYTES)
    home = F.pmod(F.xxhash64("id"), F.lit(homes)).cast("long")
    rows = part.join(short, "id").withColumn("home", home).repartition("key", "left", "right").sortWithinPartitions("key", "left", "right", "id")
    # pairs never become rows: a document is sent, once, to each block of texts where the posterior leaves it a pair
    meets = rows.mapInArrow(lambda it: _screened(it, per_cent, miss), "id long, meets array<long>")
    meets = written(meets.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_set("meets"))).alias("meets")), "screened")
    if not meets.head(1):
        return None
    ids = meets.select("id")
    docs = _texts_of(ids, source).join(short, "id").join(labels, "id", "left").select("id", "text", "n", "sig", F.coalesce("component", "id").alias("component"), home.alias("block"))
    rows = meets.join(docs, "id").withColumn("meets", F.explode("meets")).withColumn("left", F.least("block", "meets")).withColumn("right", F.greatest("block", "meets")).withColumn("key", F.lit(0))
    rows = rows.drop("meets").repartition("left", "right").sortWithinPartitions("key", "left", "right", "id")
    return written(rows.mapInArrow(lambda it: _verified(it, k, per_cent, miss), "a long, b long"), "links")


@K.trimmed
def _shortened(iterator):
    """Signatures of 8 bits a position: agreements are counted too high at worst, so nothing is pruned that would stay."""
    for batch in iterator:
        short = [np.frombuffer(s, np.uint16).astype(np.uint8).tobytes() for s in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(short, pa.binary())], ["id", "n", "sig"])


def _texts_of(ids: DataFrame, source: DataFrame) -> DataFrame:
    """(id, whole text) of the documents of ids(id)."""
    ids = written(ids.toDF("id").distinct(), "ids")
    return source.withColumnRenamed("key", "id").join(few(ids), "id", "left_semi")
