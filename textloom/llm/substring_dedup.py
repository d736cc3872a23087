"""Removal of long repeated word spans by a compacted De Bruijn graph.

The edges of the graph are windows of LENGTH words. Most windows of a corpus
occur once, so the graph is kept compacted from the start: consecutive windows
that share their minimiser (the K-word mer of least hash in a window, leftmost
on ties) form one nonbranching path, described by its first window, its length
and the hash of the words it spells. Equal windows have equal minimisers, so

1. paths are counted by minimiser; those whose minimiser occurs once go;
2. where all paths of a minimiser spell the same words, every window on them repeats;
3. elsewhere the paths branch: each distinct path is unfolded into its windows,
   read again from one source document, and windows are counted one by one.
   A window on a path that occurs twice repeats as well;
4. joins carry the repeated windows of each path back to the coordinates of all
   its occurrences, and the words they cover leave the text.

Windows are identified by two independent 64-bit hashes (of the minimiser and
of all their words). All joins are equi-joins with one small side per key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.shared import few, keyed, texts, written

LENGTH = 35
MER = 12
#: Words handled at once; paths do not cross the cut (their windows still meet in step 3).
_CHUNK = 1 << 17
_POS = 21
_OTHER = 0xC2B2AE3D27D4EB4F


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum over each w consecutive values."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (w - have)], out[w - have :]) if w > have else out


def paths(h: np.ndarray, at: np.ndarray, length: int, mer: int):
    """Paths of windows that share a minimiser: (document number, first window, windows, minimiser, path hash)."""
    doc, first, count, mini, spelled = [], [], [], [], []
    for lo in range(0, max(0, len(h) - length + 1), _CHUNK):
        part = h[lo : lo + _CHUNK + length - 1]
        n = len(part) - length + 1
        d = np.searchsorted(at, np.arange(lo, lo + n), "right") - 1
        ok = np.arange(lo, lo + n) + length <= at[d + 1]
        if not ok.any():
            continue
        grams = K.rolling(part, mer, _OTHER)
        tagged = (grams >> K.U64(_POS) << K.U64(_POS)) | np.arange(len(grams), dtype=np.uint64)
        pos = (_least(tagged, length - mer + 1) & K.U64((1 << _POS) - 1)).astype(np.int64)
        starts = np.flatnonzero(ok & np.r_[True, (pos[1:] != pos[:-1]) | (d[1:] != d[:-1]) | ~ok[:-1]])
        brk = np.flatnonzero(~ok)
        nxt = np.append(starts[1:], n)
        if len(brk):
            nxt = np.minimum(nxt, np.append(brk, n)[np.searchsorted(brk, starts)])
        c = nxt - starts
        doc.append(d[starts])
        first.append(starts + lo - at[d[starts]])
        count.append(c)
        mini.append(grams[pos[starts]])
        spelled.append(K.mix(K.spans(part, starts, starts + c + length - 1) + (c * 64 + pos[starts] - starts).astype(np.uint64)))
    kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
    return tuple(np.concatenate(x) if x else np.zeros(0, k) for x, k in zip((doc, first, count, mini, spelled), kinds))


@K.trimmed
def _paths(iterator, length: int, mer: int):
    for batch in iterator:
        for lo, hi in K.batches(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            data, offs = K.flat(part.column(1))
            h, _, _, at = K.words(data, offs)
            d, first, count, mini, spelled = paths(h, at, length, mer)
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(mini.view(np.int64)), pa.array(spelled.view(np.int64))], ["key", "first", "n", "mini", "path"])


@K.trimmed
def _windows(iterator, length: int):
    """Each row: a text and its branching paths; out come their windows."""
    for batch in iterator:
        for lo, hi in K.batches(batch.column(0)):
            part = batch.slice(lo, hi - lo)
            data, offs = K.flat(part.column(0))
            h, _, _, at = K.words(data, offs)
            lists = part.column(1)
            cut = lists.offsets.to_numpy()
            want = lists.values.slice(cut[0], cut[-1] - cut[0])
            mini, path, first, n = (want.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("mini", "path", "first", "n"))
            doc = np.repeat(np.arange(hi - lo), np.diff(cut))
            grams = K.rolling(h, length)
            off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            every = grams[np.repeat(at[doc] + first, n) + off]
            for a in range(0, len(off), 100_000):
                some = slice(a, a + 100_000)
                cols = (np.repeat(mini, n)[some], np.repeat(path, n)[some], off[some].astype(np.int32), every[some].view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["mini", "path", "off", "window"])


@K.trimmed
def _cut(iterator, length: int):
    """Each row: doc_id, text, repeated windows as (first, mask); out comes what is left."""
    for batch in iterator:
        for lo, hi in K.batches(batch.column(1)):
            part = batch.slice(lo, hi - lo)
            marks = part.column(2).to_pylist()
            data, offs = K.flat(part.column(1))
            _, s, e, at = K.words(data, offs)
            n, gone, kept, spans_ = [], [], [], []
            for i in range(hi - lo):
                size = int(at[i + 1] - at[i])
                cover = np.zeros(size + 1, np.int32)
                for m in marks[i] or ():
                    bits = m["mask"]
                    while bits:
                        b = (bits & -bits).bit_length() - 1
                        run = (~(bits >> b) & ((bits >> b) + 1)).bit_length() - 1
                        cover[m["first"] + b] += 1
                        cover[m["first"] + b + run + length - 1] -= 1
                        bits &= ~(((1 << run) - 1) << b)
                stay = np.cumsum(cover[:-1]) == 0
                n.append(size)
                gone.append(size - int(stay.sum()))
                a, b = s[at[i] : at[i + 1]], e[at[i] : at[i + 1]]
                text = data[offs[i] : offs[i + 1]].tobytes()
                kept.append(b" ".join([text[x:y] for x, y in zip((a[stay] - offs[i]).tolist(), (b[stay] - offs[i]).tolist())]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, mer: int = MER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_text of every document.

    A word is removed when a window of `length` consecutive words that covers it
    occurs at another start as well, in the same document or another one. All
    occurrences go; windows are judged on the input. Kept words are joined by
    one space. A null or empty text has no words and keeps an empty text; texts
    of fewer than `length` words stay whole. Rows whose ids are null or repeat are
    documents of their own: what two of them share is repeated. An empty table
    gives an empty result; other columns of docs are not read.
    """
    if not 1 <= length - mer + 1 <= 62:
        raise ValueError("length - mer + 1 must lie between 1 and 62")
    source, _ = keyed(texts(docs, id_col=id_col, text_col=text_col))
    found = source.select("key", "text").mapInArrow(lambda it: _paths(it, length, mer), "key long, first int, n int, mini long, path long")
    # counts are written before they are joined: a plain shuffle on both sides lets Spark split the rows of a hot minimiser
    count = found.groupBy("mini").agg(F.count("*").alias("c"), F.min("path").alias("lo"), F.max("path").alias("hi")).where("c > 1")
    count = written(count.select("mini", (F.col("lo") != F.col("hi")).alias("branches")), "minimisers")
    again = written(found.join(few(count), "mini"), "paths")

    branching = again.where("branches").groupBy("mini", "path").agg(F.count("*").alias("c"), F.min(F.struct("key", "first", "n")).alias("at"))
    branching = written(branching.select("mini", "path", "c", "at.*"), "branching")
    want = branching.groupBy("key").agg(F.collect_list(F.struct("mini", "path", "first", "n")).alias("want"))
    ids = written(branching.select("key").distinct(), "ids")
    rows = source.join(few(ids), "key", "left_semi").join(want, "key").select("text", "want")
    windows = rows.mapInArrow(lambda it: _windows(it, length), "mini long, path long, off int, window long")
    windows = written(windows, "windows")
    twice = written(windows.groupBy("mini", "window").agg(F.count("*").alias("c")).where("c > 1").select("mini", "window"), "twice")
    masks = windows.join(few(twice), ["mini", "window"]).groupBy("mini", "path").agg(F.expr("bit_or(shiftleft(1L, off))").alias("some"))
    masks = written(branching.select("mini", "path", "c").join(masks, ["mini", "path"], "left").where("c > 1 or some is not null"), "masks")

    full = F.expr("shiftleft(1L, n) - 1")
    plain = again.where("not branches").select("key", "first", full.alias("mask"))
    split = again.where("branches").join(few(masks), ["mini", "path"]).select("key", "first", F.when(F.col("c") > 1, full).otherwise(F.col("some")).alias("mask"))
    marks = plain.union(split).groupBy("key").agg(F.collect_list(F.struct("first", "mask")).alias("marks"))
    marked = source.join(marks, "key", "left")
    return marked.select("doc_id", "text", "marks").mapInArrow(lambda it: _cut(it, length), "doc_id long, n_words long, n_removed long, kept_text string")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
