"""I-Match fingerprints over randomised lexicon subsets.

The lexicon keeps terms whose inverse document frequency, over all documents,
lies in a band: neither common words nor rare ones. A fingerprint has SUBSETS
randomised lexicons for each of several rates; a lexicon of rate 1/M holds a term
with chance 1/M, independently of all others, so lexicons overlap. Each gives one
hash of the sorted distinct terms of the text that it holds. One more hash covers
all distinct terms of the text. Likeness is the share of equal hashes among the
lexicons that either text reaches, at the lowest rate where those are at least
LEAST; where no lexicon is reached, texts are alike if all their terms are.

The band also bounds the lexicon: a term must be in COMMON_MIN of all documents
or more, so there are at most (mean distinct terms per text) / COMMON_MIN of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.shared import texts

#: Band of document frequency, as shares of all documents (idf from 3.0 to 6.9).
COMMON_MIN, COMMON_MAX = 1e-3, 0.05
#: Rates of the lexicons are 2**-b for these b; lexicons of each rate.
BITS, SUBSETS, LEAST = (5, 7, 9, 11, 13), 32, 16
#: Characters in a range of ids, most ranges, and sampled ids for each range.
RANGE_CHARS, RANGES, OVER = 8_000_000, 200_000, 8
_WIDTH = len(BITS) * SUBSETS + 1
_SEEDS = iter(np.random.default_rng(31).integers(1, 2**63, 64, dtype=np.uint64))
#: (seed, bits, [(shift, column)]): one hash of a term gives as many draws as it has groups of bits.
_DRAWS = []
for _i, _b in enumerate(BITS):
    for _lo in range(0, SUBSETS, 64 // _b):
        _DRAWS.append((next(_SEEDS), _b, [(_b * _g, _i * SUBSETS + _lo + _g) for _g in range(min(64 // _b, SUBSETS - _lo))]))
_LAST = next(_SEEDS)


def fingerprints(column: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """One row of hashes (0: the lexicon holds no term of the text) for each text; the last is that of all terms."""
    rows = []
    for lo, hi in K.batches(column, 2 << 20):
        data, offs = K.flat(column.slice(lo, hi - lo))
        h, _, _, at = K.words(data, offs, lower=True, space=K.NOT_TERM)
        owner = np.repeat(np.arange(hi - lo), np.diff(at))
        order = np.lexsort((h, owner))
        h, owner = h[order], owner[order]
        first = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])] if len(h) else np.zeros(0, bool)
        h, owner = h[first], owner[first]
        total = np.zeros(((hi - lo), _WIDTH), np.uint64)
        value = K.mix(h ^ _LAST)
        np.add.at(total[:, -1], owner, value)
        known = lexicon[np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)] == h if len(lexicon) else np.zeros(len(h), bool)
        h, owner, value = h[known], owner[known], value[known]
        for seed, bits, draws in _DRAWS:
            x, mask = K.mix(h ^ seed), K.U64((1 << bits) - 1)
            for shift, col in draws:
                held = np.flatnonzero((x >> K.U64(shift)) & mask == 0)
                np.add.at(total[:, col], owner[held], value[held])
        rows.append(np.where(total != 0, (K.mix(total) >> K.U64(48)).astype(np.uint16) | np.uint16(1), 0).astype(np.uint16))
    return np.concatenate(rows) if rows else np.zeros((0, _WIDTH), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints, row by row; two without any term are equal."""
    whole = a[:, -1] == b[:, -1]
    a, b = (x[:, :-1].reshape(-1, len(BITS), SUBSETS) for x in (a, b))
    union = ((a != 0) | (b != 0)).sum(axis=2)
    same = ((a == b) & (a != 0)).sum(axis=2)
    enough = union >= LEAST
    fine = np.where(enough.any(axis=1), len(BITS) - 1 - enough[:, ::-1].argmax(axis=1), union.argmax(axis=1))
    rows = np.arange(len(a))
    u, s = union[rows, fine], same[rows, fine]
    return np.where(u > 0, s / np.maximum(u, 1), whole.astype(float))


def _hex(rows: np.ndarray) -> list[str]:
    return [r.astype(">u2").tobytes().hex() for r in rows]


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


@K.trimmed
def _packed(iterator, shared):
    """Texts compressed one by one: they cross the network once, as little as possible.

    The first document of a range is sent to the range before as well (ahead = 1),
    the first of all to the last range; of equal ids only the least text of a batch.
    """
    cuts, least = shared.value
    for batch in iterator:
        ids = batch.column(0).to_pylist()
        bucket = [len(cuts) if i is None else int(np.searchsorted(cuts, i, "right")) for i in ids]
        raw = [t.encode() for t in batch.column(1).to_pylist()]
        z = [pa.compress(r, codec="zstd", asbytes=True) for r in raw]
        ahead: dict[int, int] = {}
        for j, (i, b) in enumerate(zip(ids, bucket)):
            for first, target in ((b > 0 and i == cuts[b - 1], b - 1), (i == least, len(cuts))):
                if first and (target not in ahead or z[j] < z[ahead[target]]):
                    ahead[target] = j
        rows = [*((j, bucket[j], 0) for j in range(len(ids))), *((j, t, 1) for t, j in ahead.items())]
        at, to, role = (list(c) for c in zip(*rows)) if rows else ([], [], [])
        cols = [pa.array([ids[j] for j in at], pa.int64()), pa.array([z[j] for j in at], pa.binary()), pa.array([len(raw[j]) for j in at], pa.int64()), pa.array(to, pa.int32()), pa.array(role, pa.int32())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "packed", "n_bytes", "bucket", "ahead"])


@K.trimmed
def _compared(iterator, shared):
    lexicon = shared.value

    def out(held: list[tuple[int, str]]):
        """Rows of all but the last, which follows them."""
        own = pa.array([t for _, t in held], pa.string())
        edited = [_edited(t, held[i + 1][1]) for i, (_, t) in enumerate(held[:-1])]
        f, g = fingerprints(own, lexicon), fingerprints(pa.array(edited, pa.string()), lexicon)
        cols = [
            pa.array([i for i, _ in held[:-1]], pa.int64()), pa.array([len(t) for _, t in held[:-1]], pa.int64()), pa.array(edited, pa.string()),
            pa.array(_hex(f[:-1]), pa.string()), pa.array(_hex(g), pa.string()), pa.array(likeness(f[:-1], g), pa.float64()), pa.array(likeness(f[:-1], f[1:]), pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    held: list[tuple[int, str]] = []
    now, size, closed = None, 0, True
    for batch in iterator:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            for i, z, n, bucket, ahead in zip(*(part.column(c).to_pylist() for c in range(5))):
                if bucket != now:
                    held, now, size, closed = [], bucket, 0, False
                if closed:
                    continue  # further rows of the next bucket's first id
                t = pa.decompress(z, decompressed_size=n, codec="zstd", asbytes=True).decode()
                held.append((i, t))
                size += len(t)
                if ahead:
                    closed = True
                if (closed or size > 2_000_000) and len(held) > 1:
                    yield out(held)
                    held, size = held[-1:], len(held[-1][1])


def fingerprint_documents(docs: DataFrame, *, common_min: float = COMMON_MIN, common_max: float = COMMON_MAX, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next.

    edited is the text whose last floor(n/2) code points are replaced by the
    first as many of the next document by id; the first follows the last. Null
    ids come after all others; rows of one id, and those of none, stand in a
    fixed order of their contents. Null texts count as empty. An empty table gives
    an empty result; other columns of docs are not read. Ranges of ids meet in a
    task, with the first document of the next range; a range begins with an id of
    a sample whose size is bounded, so the plan is the same at any size.
    """
    source = texts(docs, id_col=id_col, text_col=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    n, volume, least = source.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0)), F.min("doc_id")).first()
    spark = docs.sparkSession
    if not n:
        return spark.createDataFrame([], _SCHEMA)
    counts = source.mapInArrow(lambda it: K.term_counts(it, 1), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    band = counts.where((F.col("df") >= max(2.0, common_min * n)) & (F.col("df") <= max(2.0, common_max * n))).select("term")
    lexicon = spark.sparkContext.broadcast(np.sort(band.toPandas()["term"].to_numpy(np.int64).view(np.uint64)))

    ranges = min(RANGES, max(2 * spark.sparkContext.defaultParallelism, -(-volume // RANGE_CHARS)))
    share = int(min(1.0, OVER * ranges / n) * (1 << 40))
    sample = source.where("doc_id is not null").where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 40)) < share).select("doc_id").distinct()
    ids = np.sort(sample.toPandas()["doc_id"].to_numpy(np.int64))
    cuts = spark.sparkContext.broadcast((ids[:: max(1, len(ids) // ranges)], least))
    rows = source.select("doc_id", "text").mapInArrow(lambda it: _packed(it, cuts), "doc_id long, packed binary, n_bytes long, bucket int, ahead int")
    rows = rows.repartition(ranges, "bucket").sortWithinPartitions("bucket", "ahead", F.asc_nulls_last("doc_id"), "packed")
    return rows.mapInArrow(lambda it: _compared(it, lexicon), _SCHEMA)


_SCHEMA = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return fingerprint_documents(docs).select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")
