"""Statistics of whole texts, as one float column each, from byte and word arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textloom.llm import kernels as K

#: Byte classes whose share of the text is a statistic.
_CLASSES = {
    "upper": [*range(65, 91)],
    "lower": [*range(97, 123)],
    "digit": [*range(48, 58)],
    "newline": [10],
    "comma_dot": [44, 46],
    "bang": [33, 63],
    "bar": [124],
    "symbol": [35, 36, 37, 38, 42, 94, 126],
    "bracket": [40, 41, 60, 62, 91, 93, 123, 125, 61, 47, 92, 95],
    "high": [*range(128, 256)],
}
NAMES = (*_CLASSES, "log_words", "word_len", "long_words", "short_words", "distinct", "top_word", "longest_run", "repeats", "distinct_pairs", "distinct_threes", "same_lines", "line_words", "marked_words", "capital_words")
_INDEX = np.full(256, len(_CLASSES), np.int64)
for _i, _b in enumerate(_CLASSES.values()):
    _INDEX[_b] = _i
_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 44, 46]] = True


def _share(h: np.ndarray) -> tuple[float, float]:
    """(distinct share, share of the most frequent)."""
    if not len(h):
        return 1.0, 0.0
    s = np.sort(h)
    edge = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
    return (len(edge) - 1) / len(h), float(np.diff(edge).max()) / len(h)


def measure(column: pa.Array) -> np.ndarray:
    """One row of NAMES for each text; zeros for a text without words."""
    rows = []
    for lo, hi in K.batches(column):
        data, offs = K.flat(column.slice(lo, hi - lo))
        h, s, e, at = K.words(data, offs)
        pairs, threes = K.rolling(h, 2), K.rolling(h, 3)
        size = e - s
        odd_end = ~_WORDY[data[np.maximum(e - 1, 0)]] if len(e) else np.zeros(0, bool)
        capital = (data[s] >= 65) & (data[s] < 91) if len(s) else np.zeros(0, bool)
        same = np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
        lines = data == 10
        out = np.zeros((hi - lo, len(NAMES)))
        base = len(_CLASSES)
        for i in range(hi - lo):
            a, b = at[i], at[i + 1]
            n = b - a
            if not n:
                continue
            part = data[offs[i] : offs[i + 1]]
            out[i, :base] = np.bincount(_INDEX[part], minlength=base + 1)[:base] / len(part)
            own = h[a:b]
            distinct, top = _share(own)
            again = same[a:b].copy()
            again[0] = False
            breaks = np.flatnonzero(np.r_[True, ~again[1:], True])
            cut = np.flatnonzero(lines[offs[i] : offs[i + 1]]) + offs[i]
            inner = np.searchsorted(s[a:b], cut)
            edges = np.unique(np.r_[0, inner, n])
            spelled = K.spans(own, edges[:-1], edges[1:])
            length = size[a:b]
            out[i, base:] = (
                np.log1p(n), length.mean(), (length > 20).mean(), (length <= 3).mean(), distinct, top,
                np.diff(breaks).max() / n, again.mean(), _share(pairs[a : b - 1])[0], _share(threes[a : max(a, b - 2)])[0],
                1 - _share(spelled)[0], n / len(spelled), odd_end[a:b].mean(), capital[a:b].mean(),
            )
        rows.append(out)
    return np.concatenate(rows) if rows else np.zeros((0, len(NAMES)))


@K.trimmed
def _measured(iterator):
    for batch in iterator:
        x = measure(batch.column(1))
        more = batch.schema.names[2:]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x[:, j]) for j in range(x.shape[1])), *(batch.column(c) for c in range(2, 2 + len(more)))], ["doc_id", *NAMES, *more])


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of documents(doc_id, text, ...); further columns stay beside them."""
    more = "".join(f", {n} {kind}" for n, kind in docs.dtypes[2:])
    return docs.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{n} double" for n in NAMES) + more)
