"""Language identification in two steps: family first, then one-versus-one linear SVMs within it.

Features are relative frequencies of hashed byte trigrams of the whole text
(letters lower-cased, everything else a single space). All classifiers are
linear, so a text is one frequency vector times one weight matrix.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.llm.shared import crc_mod, few, texts, written

#: Training rows of each language at most (about; chosen by a hash of the row), of all of them, and of each at least.
SAMPLE, SAMPLE_ALL, SAMPLE_LEAST = 1500, 12_000, 20
#: Languages of one family at most: a larger family is dealt into families of similar languages.
FAMILY = 12
WIDTH = 2048
#: Families of common language codes. Others join the family whose profile is nearest.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "turkic": ("tr", "az", "kk", "uz"),
    "uralic": ("fi", "et", "hu"),
}

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def profiles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(trigram frequencies, whether there is a letter) of each text."""
    rows, letters = [], []
    for lo, hi in K.batches(column):
        part = column.slice(lo, hi - lo)
        data, offs = K.flat(part)
        out = np.zeros((hi - lo, WIDTH), np.float32)
        has = np.zeros(hi - lo, bool)
        for i in range(hi - lo):
            for a in range(int(offs[i]), int(offs[i + 1]), 1 << 20):  # whole texts, a megabyte at a time
                raw = data[max(int(offs[i]), a - 2) : min(int(offs[i + 1]), a + (1 << 20))]
                has[i] |= _LETTER[raw].any()
                b = _FOLD[raw]
                b = b[np.r_[True, (b[1:] != 32) | (b[:-1] != 32)]].astype(np.uint32)
                if len(b) > 2:
                    code = ((b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(21)
                    out[i] += np.bincount(code, minlength=WIDTH)
            if not has[i]:
                has[i] = any(c.isalpha() for c in part[i].as_py() or "")
        total = out.sum(axis=1, keepdims=True)
        rows.append(out / np.maximum(total, 1))
        letters.append(has)
    if not rows:
        return np.zeros((0, WIDTH), np.float32), np.zeros(0, bool)
    return np.concatenate(rows), np.concatenate(letters)


def _svm(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM for labels -1/+1 with balanced classes, accelerated gradient.

    The weights stay in the span of the rows; with fewer rows than features the
    descent runs on the rows' coefficients and their Gram matrix.
    """
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    mean, std = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[(x - mean) / std, np.ones(len(x), np.float32)].astype(np.float32)
    gram = z @ z.T if len(z) < z.shape[1] else None
    margins = (lambda u: gram @ u) if gram is not None else (lambda u: z @ u)
    pull = (lambda r: r) if gram is not None else (lambda r: z.T @ r)
    v, top = np.ones(len(z), np.float32), 1.0
    for _ in range(12):
        v = weight * (gram @ v if gram is not None else z @ (z.T @ v))
        top = np.linalg.norm(v)
        v /= top + 1e-12
    w = np.zeros(len(z) if gram is not None else z.shape[1], np.float32)
    step, u, t = np.float32(1 / (2 * 1.1 * top + ridge)), w, 1.0
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * margins(u))
        new = u - step * (ridge * u - 2 * pull(weight * slack * y))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, w, t = (new + (t - 1) / t2 * (new - w)).astype(np.float32), new.astype(np.float32), t2
    if gram is not None:
        w = z.T @ w
    coef = w[:-1] / std
    return coef.astype(np.float32), float(w[-1] - (mean * coef).sum())


def _parts(langs: list[str], centre: dict[str, np.ndarray]) -> list[list[str]]:
    """Families of FAMILY languages at most: each takes the first language left and those nearest to it."""
    out = []
    while langs:
        near = sorted(langs, key=lambda la: (-float(centre[la] @ centre[langs[0]]) / (float(np.linalg.norm(centre[la])) + 1e-12), la))
        part = near[:FAMILY] if len(langs) > FAMILY else langs
        out.append(sorted(part))
        langs = [la for la in langs if la not in part]
    return out


class LanguageModel:
    """families: lists of languages. Votes of one-versus-rest (families) and one-versus-one (languages) SVMs."""

    def __init__(self, x: np.ndarray, lang: np.ndarray):
        self.langs = sorted(set(lang.tolist()))
        centre = {la: x[lang == la].mean(axis=0) for la in self.langs}
        named = {la: f for f, codes in FAMILIES.items() for la in codes}
        group: dict[str, list[str]] = {}
        for la in self.langs:
            if la in named:
                group.setdefault(named[la], []).append(la)
        for la in self.langs:
            if la not in named:
                near = max(((float(centre[la] @ centre[o] / (np.linalg.norm(centre[la]) * np.linalg.norm(centre[o]) + 1e-12)), f) for f, os in group.items() for o in os), default=(0.0, ""))
                group.setdefault(near[1] if near[0] >= 0.5 else la, []).append(la)
        self.families = [part for _, v in sorted(group.items()) for part in _parts(sorted(v), centre)]
        w, b = [], []
        family = np.array([next(i for i, f in enumerate(self.families) if la in f) for la in lang])
        for f in range(len(self.families)) if len(self.families) > 1 else ():
            coef, bias = _svm(x, np.where(family == f, 1, -1).astype(np.float32))
            w.append(coef)
            b.append(bias)
        self.duels = []
        for f in self.families:
            for p, q in combinations(f, 2):
                rows = (lang == p) | (lang == q)
                coef, bias = _svm(x[rows], np.where(lang[rows] == p, 1, -1).astype(np.float32))
                self.duels.append((p, q, len(w)))
                w.append(coef)
                b.append(bias)
        self.w = np.stack(w, axis=1) if w else np.zeros((x.shape[1], 0), np.float32)
        self.b = np.array(b, np.float32)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margin = 1 / (1 + np.exp(-3 * np.clip(x @ self.w + self.b, -20, 20)))
        n = len(x)
        if len(self.families) > 1:
            share = margin[:, : len(self.families)] + 1e-9
            share = share / share.sum(axis=1, keepdims=True)
        else:
            share = np.ones((n, 1))
        family = share.argmax(axis=1)
        best, score = np.full(n, "", object), np.zeros(n)
        for f, langs in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            won = np.zeros((len(rows), len(langs)))
            for p, q, c in self.duels:
                if p in langs:
                    won[:, langs.index(p)] += margin[rows, c]
                    won[:, langs.index(q)] += 1 - margin[rows, c]
            won = won / max(1, len(langs) * (len(langs) - 1) / 2) if len(langs) > 1 else won + 1
            top = won.argmax(axis=1)
            best[rows] = np.array(langs, object)[top]
            score[rows] = share[rows, f] * won[np.arange(len(rows)), top]
        return best, np.clip(score, 0, 1)


@K.trimmed
def _profiled(iterator):
    for batch in iterator:
        x, _ = profiles(batch.column(0))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["lang", "profile"])


@K.trimmed
def _predicted(iterator, shared):
    model = shared.value
    for batch in iterator:
        for lo in range(0, batch.num_rows, 2000):
            part = batch.slice(lo, 2000)
            x, letters = profiles(part.column(1))
            lang, score = model.predict(x) if model else (np.full(len(x), "und", object), np.zeros(len(x)))
            lang = np.where(letters, lang, "und")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang.tolist(), pa.string()), pa.array(np.where(letters, score, 0.0), pa.float64())], ["doc_id", "lang_pred", "score"])


def identify(docs: DataFrame, *, hold_out: tuple[int, int] = (4, 2), sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document.

    Learned from text and non-null language of rows whose crc32(id) mod
    hold_out[0] is not hold_out[1]; of each of n languages about the lesser of
    `sample` and SAMPLE_ALL / n rows is fitted, but SAMPLE_LEAST. Every language
    of these rows is learned; equal rows teach once.
    Predictions use the whole text alone. Null and empty texts, and texts without
    a letter, give und and score 0, as does a table without training rows. Rows
    whose ids are null or repeat are predicted each by its own text; an empty
    table gives an empty result.
    """
    rows = texts(docs, F.col(lang_col).cast("string").alias("lang"), id_col=id_col, text_col=text_col)
    held = F.coalesce(crc_mod(F.col("doc_id"), hold_out[0]) == hold_out[1], F.lit(False))
    train = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang is not null and text is not null").where(~held)
    counts = train.groupBy("lang").count()
    quota = min(sample, max(SAMPLE_LEAST, SAMPLE_ALL // max(1, counts.count())))
    share = written(counts.select("lang", F.least(F.lit(1.0), F.lit(quota) / F.col("count")).alias("share")), "shares")
    row = F.xxhash64("doc_id", "text")
    chosen = train.join(few(share), "lang").where(F.pmod(F.xxhash64(row, F.lit(17)), F.lit(1 << 40)) < F.col("share") * (1 << 40))
    chosen = chosen.select("text", "lang", row.alias("row")).dropDuplicates(["lang", "row"])
    got = chosen.select("text", "lang").mapInArrow(_profiled, "lang string, profile binary").toPandas().sort_values(["lang", "profile"])
    model = LanguageModel(np.frombuffer(b"".join(got["profile"]), np.float32).reshape(-1, WIDTH), got["lang"].to_numpy(object)) if len(got) else None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = rows.select("doc_id", "text").mapInArrow(lambda it: _predicted(it, shared), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
