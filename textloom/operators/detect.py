"""Reuse detection (T1-T6): seeds and extension, n-gram candidates with local alignment, window alignment, clustering.

Input docs(series, docid, text); output passages(cluster, docid, start, end),
end inclusive. gram_alignment leaves out grams above a document frequency (a
parameter of that method); seed_and_extend and window_alignment keep every gram.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import log
from operator import or_
from unicodedata import category

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.operators.wordgraph import _checkpoint, connected
from textloom.sources.tables import bound_batches, spread


#: Characters cut at once: substrings are found by walking a text, so long ones are walked in pieces.
PIECE = 256


def char_grams(docs: DataFrame, n: int, floating: bool = True) -> DataFrame:
    """(series, docid, pos, gram): at any offset, or at word starts only."""
    at = F.col("at")
    rows = docs.where(F.length("text") >= n).select("series", "docid", "text", F.explode(F.sequence(F.lit(0), F.length("text") - n, F.lit(PIECE))).alias("at"))
    before = F.when(at > 0, F.substr("text", at, F.lit(1))).otherwise(F.lit(" "))
    rows = rows.select("series", "docid", "at", F.concat(before, F.substr("text", at + 1, F.lit(PIECE + n - 1))).alias("k"))
    start = [] if floating else [lambda p: F.substr("k", p, F.lit(1)).alias("before")]
    gram = lambda p: F.struct((at + p - 1).alias("pos"), F.substr("k", p + 1, F.lit(n)).alias("gram"), *[f(p) for f in start])
    rows = rows.select("series", "docid", F.explode(F.transform(F.sequence(F.lit(1), F.length("k") - n), gram)).alias("g"))
    if not floating:
        rows = rows.where(F.col("g.before").rlike(r"(?U)\W"))
    return rows.select("series", "docid", "g.pos", "g.gram")


def word_grams(docs: DataFrame, n: int, gap: int = 0, ordered: bool = True, min_length: int = 2) -> DataFrame:
    """(series, docid, pos, gram): n of n + gap following tokens, the first always; sorted inside if unordered.

    A gram may stand more than once at a position: gram_matches takes it once.
    """
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: F.length(w) >= min_length)
    rows = docs.select("series", "docid", words.alias("w"))
    picks = [(0, *c) for c in combinations(range(1, n + gap), n - 1)]

    def grams(i):
        each = [F.array(*[F.get("w", i + k) for k in p]) for p in picks]
        return F.array(*each)

    out = rows.select("series", "docid", "w", F.explode(F.sequence(F.lit(0), F.size("w") - n)).alias("pos")).where(F.col("pos") >= 0)
    out = out.select("series", "docid", "pos", F.explode(F.array_distinct(grams(F.col("pos")))).alias("g")).where(~F.exists("g", lambda x: x.isNull()))
    return out.select("series", "docid", "pos", F.concat_ws(" ", F.col("g") if ordered else F.array_sort("g")).alias("gram"))


#: What a token is, in Java's dialect: a run of letters and digits.
TOKEN = r"[\p{L}\p{N}]"


def located_tokens(docs: DataFrame, min_length: int = 2, stem: bool = False, fold_numbers: bool = False) -> DataFrame:
    """(series, docid, pos, tok, start, end): tokens with the code points that they take, end inclusive.

    Every piece of a text is a token and what stands before it, so offsets are
    running sums of lengths. Tokens are lower-cased; numbers fold to "0" and words
    to their stem where asked for; shorter tokens than min_length go before that.
    """
    pieces = F.regexp_extract_all("text", F.lit(f"[^{TOKEN[1:-1]}]*+{TOKEN}++"), F.lit(0))
    rows = docs.select("series", "docid", F.posexplode(pieces).alias("k", "piece")).withColumn("raw", F.regexp_extract("piece", f"{TOKEN}++$", 0))
    # what is shuffled: the token once, and the two lengths
    rows = rows.select("series", "docid", "k", F.lower("raw").alias("tok"), F.length("piece").alias("whole"), F.length("raw").alias("own"))
    w = Window.partitionBy("series", "docid").orderBy("k")
    upto = F.sum("whole").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.select("series", "docid", "k", "tok", (upto - F.col("own")).cast("int").alias("start"), (upto - 1).cast("int").alias("end"))
    rows = rows.where(F.length("tok") >= min_length).withColumn("pos", (F.row_number().over(w) - 1).cast("int"))
    tok = F.col("tok")
    if stem:
        tok = german_stem(tok)
    if fold_numbers:
        tok = F.when(F.col("tok").rlike(r"^\p{N}+$"), "0").otherwise(tok)
    return rows.select("series", "docid", "pos", tok.alias("tok"), "start", "end")


def _let(value: Column, then) -> Column:
    """then(value), with value computed once however often it stands in then."""
    return F.transform(F.array(value), then)[0]


def german_stem(word: Column) -> Column:
    """The published Snowball stemmer for German, as column functions."""
    vowel, none = "[aeiouyäöü]", F.lit(1 << 20)

    def tail(x: Column, regex: str) -> Column:
        """The length of an ending; most words have none of its letters, which needs no regex."""
        letters = re.sub(r"\(\?<[=!].*?\)|\(\?:|\)", "", regex).split("|")
        there = reduce(or_, [x.endswith(e) for e in letters])
        return F.when(there, F.length(F.regexp_extract(x, f"(?:{regex})$", 0))).otherwise(0)

    less = lambda x, n: F.substr(x, F.lit(1), F.length(x) - n)
    region = lambda x: F.length(F.regexp_extract(x, f"^.*?{vowel}[^aeiouyäöü]", 0))

    def drop(x: Column, regex: str, start: Column) -> Column:
        """x without an ending that lies after start."""
        return _let(tail(x, regex), lambda n: F.when((n > 0) & (F.length(x) - n >= start), less(x, n)).otherwise(x))

    def one(w: Column, p1: Column) -> Column:
        niss = lambda x: F.when((F.length(x) < F.length(w)) & x.endswith("niss"), less(x, 1)).otherwise(x)
        return F.when(tail(w, "em|ern|er") > 0, drop(w, "em|ern|er", p1)).when(tail(w, "e|en|es") > 0, _let(drop(w, "e|en|es", p1), niss)).otherwise(drop(w, "(?<=[bdfghklmnrt])s", p1))

    def two(w: Column, p1: Column) -> Column:
        return F.when(tail(w, "en|er|est") > 0, drop(w, "en|er|est", p1)).otherwise(drop(w, "(?<=...[bdfghklmnt])st", p1))

    def three(w: Column, p1: Column, p2: Column) -> Column:
        and_then = lambda ending, more, start: _let(drop(w, ending, p2), lambda x: F.when(F.length(x) < F.length(w), drop(x, more, start)).otherwise(x))
        return (
            F.when(tail(w, "end|ung") > 0, and_then("end|ung", "(?<!e)ig", p2))
            .when(tail(w, "ig|ik|isch") > 0, drop(w, "(?<!e)(?:isch|ig|ik)", p2))
            .when(tail(w, "lich|heit") > 0, and_then("lich|heit", "er|en", p1))
            .when(tail(w, "keit") > 0, and_then("keit", "lich|ig", p2))
            .otherwise(w)
        )

    def steps(w: Column, n1: Column, n2: Column) -> Column:
        p1 = F.when(n1 == 0, none).otherwise(F.greatest(F.lit(3), n1))
        p2 = F.when((n1 == 0) | (n2 == 0), none).otherwise(n1 + n2)
        return _let(one(w, p1), lambda x: _let(two(x, p1), lambda y: three(y, p1, p2)))

    w = F.replace(word, F.lit("ß"), F.lit("ss"))
    for c in "uy":  # between vowels they count as consonants
        w = F.when(F.contains(w, F.lit(c)), F.regexp_replace(w, f"(?<={vowel}){c}(?={vowel})", c.upper())).otherwise(w)
    return F.translate(_let(w, lambda x: _let(region(x), lambda n1: _let(region(F.substr(x, n1 + 1)), lambda n2: steps(x, n1, n2)))), "äöüUY", "aouuy")


def located_grams(tokens: DataFrame, n: int, gap: int = 0, ordered: bool = True) -> DataFrame:
    """(series, docid, pos, gram, start, end) of located_tokens: n of n + gap following tokens, the first always; sorted inside if
    unordered. start and end are the code points from the first token to the last one taken; of equal grams at one
    position the shortest stands."""
    w = Window.partitionBy("series", "docid").orderBy("pos")
    ahead = [F.struct(F.lead("tok", i).over(w).alias("tok"), F.lead("end", i).over(w).alias("end")) for i in range(n + gap)]
    rows = tokens.select("series", "docid", "pos", "start", F.array(*ahead).alias("t"))
    picks = _picks(n, gap)
    words = lambda p: F.array(*[F.col("t")[i]["tok"] for i in p])
    each = F.array(*[F.struct(words(p).alias("g"), F.col("t")[p[-1]]["end"].alias("end")) for p in picks])
    each = F.filter(each, lambda x: x["end"].isNotNull())
    each = F.transform(each, lambda x: F.struct(F.array_join(x["g"] if ordered else F.array_sort(x["g"]), " ").alias("gram"), x["end"].alias("end")))
    rows = rows.select("series", "docid", "pos", "start", F.array_sort(each).alias("e"))
    rows = rows.select("series", "docid", "pos", "start", F.explode(F.filter("e", lambda x, i: (i == 0) | (F.get("e", i - 1)["gram"] != x["gram"]))).alias("x"))
    return rows.select("series", "docid", "pos", "x.gram", "start", "x.end")


#: Words whose stems a task keeps, so that each is stemmed once.
STEMS = 1 << 19
_VOWEL = "[aeiouyäöü]"
_BETWEEN = [(re.compile(f"(?<={_VOWEL}){c}(?={_VOWEL})"), c.upper()) for c in "uy"]
_REGION = re.compile(f"^.*?{_VOWEL}[^aeiouyäöü]")
#: (endings, letters of which one must stand before them, letters of which none may, how many letters more must stand before); no word has two endings of one entry.
_ENDINGS = {
    "em|ern|er": (("em", "ern", "er"), "", "", 0), "e|en|es": (("e", "en", "es"), "", "", 0), "s": (("s",), "bdfghklmnrt", "", 0), "en|er|est": (("en", "er", "est"), "", "", 0), "st": (("st",), "bdfghklmnt", "", 3),
    "end|ung": (("end", "ung"), "", "", 0), "ig": (("ig",), "", "e", 0), "ig|ik|isch": (("ig", "ik", "isch"), "", "e", 0), "lich|heit": (("lich", "heit"), "", "", 0), "er|en": (("er", "en"), "", "", 0), "keit": (("keit",), "", "", 0), "lich|ig": (("lich", "ig"), "", "", 0),
}
_PLAIN = str.maketrans("äöüUY", "aouuy")


def stemmed(word: str) -> str:
    """german_stem of one word, for the distinct words of a batch."""

    def drop(x: str, endings: str, start: int) -> str:
        """x without an ending that lies after start."""
        ends, after, never, more = _ENDINGS[endings]
        if not x.endswith(ends):
            return x
        at = len(x) - next(len(e) for e in ends if x.endswith(e))
        before = x[at - 1 : at]
        return x[:at] if at >= start and (not after or before and before in after and at > more) and not (before and before in never) else x

    w = word.replace("ß", "ss")
    if "u" in w or "y" in w:
        for between, c in _BETWEEN:
            w = between.sub(c, w)
    first = _REGION.match(w)
    second = first and _REGION.match(w[first.end() :])
    p1, p2 = max(3, first.end()) if first else 1 << 20, first.end() + second.end() if second else 1 << 20
    if w.endswith(("em", "ern", "er")):
        x = drop(w, "em|ern|er", p1)
    elif w.endswith(("e", "en", "es")):
        x = drop(w, "e|en|es", p1)
        x = x[:-1] if len(x) < len(w) and x.endswith("niss") else x
    else:
        x = drop(w, "s", p1)
    x = drop(x, "en|er|est", p1) if x.endswith(("en", "er", "est")) else drop(x, "st", p1)
    further = lambda e, more, start: drop(y, more, start) if len(y := drop(x, e, p2)) < len(x) else y
    if x.endswith(("end", "ung")):
        x = further("end|ung", "ig", p2)
    elif x.endswith(("ig", "ik", "isch")):
        x = drop(x, "ig|ik|isch", p2)
    elif x.endswith(("lich", "heit")):
        x = further("lich|heit", "er|en", p1)
    elif x.endswith("keit"):
        x = further("keit", "lich|ig", p2)
    return x.translate(_PLAIN)


def _mapped(words: pa.Array, one, known: dict) -> pa.Array:
    """one(word) of each word; every distinct word once, kept in known."""
    coded = words.dictionary_encode()
    if len(known) > STEMS:
        known.clear()
    forms = [known[w] if w in known else known.setdefault(w, one(w)) for w in coded.dictionary.to_pylist()]
    return pa.array(forms, pa.string()).take(coded.indices)


def token_rows(docs: DataFrame, min_length: int = 2, stem: bool = False, fold_numbers: bool = False) -> DataFrame:
    """(series, docid, t): the tokens of located_tokens as one array(tok, start, end) a row of docs, so that nothing is shuffled.

    Spark cuts the texts; offsets are running sums over a batch of rows, and a task
    stems each distinct word once.
    """

    def form(word: str) -> str:
        word = stemmed(word) if stem else word
        return "0" if fold_numbers and all(category(c)[0] == "N" for c in word) else word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            at = batch.column("tok").offsets.to_numpy().astype(np.int64)
            tok, whole, own = (batch.column(c).flatten() for c in ("tok", "whole", "own"))
            upto = np.cumsum(whole.to_numpy(), dtype=np.int64)
            upto -= np.repeat(np.r_[0, upto][at[:-1] - at[0]], np.diff(at))
            kept = pc.greater_equal(pc.utf8_length(tok), min_length)
            tok = tok.filter(kept)
            tok = _mapped(tok, form, known) if stem or fold_numbers else tok
            kept = kept.to_numpy(zero_copy_only=False)
            spans = [pa.array(x[kept].astype(np.int32)) for x in (upto - own.to_numpy(), upto - 1)]
            sizes = np.r_[0, np.cumsum(kept)][at - at[0]].astype(np.int32)
            t = pa.ListArray.from_arrays(pa.array(sizes), pa.StructArray.from_arrays([tok, *spans], ["tok", "start", "end"]))
            yield pa.RecordBatch.from_arrays([batch.column("series"), batch.column("docid"), t], ["series", "docid", "t"])

    bound_batches(docs.sparkSession)
    rows = spread(docs.where("text is not null").select("series", "docid", "text"))
    every = lambda regex: F.regexp_extract_all("text", F.lit(regex), F.lit(0))
    rows = rows.select("series", "docid", every(f"[^{TOKEN[1:-1]}]*+{TOKEN}++").alias("p"), every(f"{TOKEN}++").alias("raw"))
    rows = rows.select("series", "docid", F.transform("raw", F.lower).alias("tok"), F.transform("p", F.length).alias("whole"), F.transform("raw", F.length).alias("own"))
    schema = T.StructType([docs.schema["series"], docs.schema["docid"], T.StructField("t", T.ArrayType(T.StructType().add("tok", "string").add("start", "integer").add("end", "integer")))])
    return rows.mapInArrow(run, schema)


def tokens_of(rows: DataFrame) -> DataFrame:
    """(series, docid, pos, tok, start, end) of token_rows, a row a token."""
    return rows.select("series", "docid", F.posexplode("t").alias("pos", "x")).select("series", "docid", "pos", "x.*")


def tokenised(docs: DataFrame, stem: bool = True, fold_numbers: bool = True) -> DataFrame:
    """(series, docid, chars, t): token_rows of docs, written, for several calls of window_alignment with this stem and fold_numbers."""
    sized = docs.withColumn("docid", F.struct("docid", F.length("text").alias("chars")))
    return _checkpoint(token_rows(sized, 2, stem, fold_numbers).select("series", "docid.docid", "docid.chars", "t"))


def gram_rows(rows: DataFrame, n: int, gap: int = 0, ordered: bool = True) -> DataFrame:
    """(series, docid, g): the grams of located_grams as one array(pos, gram, start, end) a row of token_rows."""
    picks = _picks(n, gap)

    def at(i: Column) -> Column:
        words = lambda p: F.array(*[F.get("t", i + k)["tok"] for k in p])
        one = lambda p: F.struct(F.array_join(words(p) if ordered else F.array_sort(words(p)), " ").alias("gram"), F.get("t", i + p[-1])["end"].alias("end"))
        each = F.array(*[one(p) for p in picks])
        put = lambda x: F.struct(i.alias("pos"), x["gram"].alias("gram"), F.get("t", i)["start"].alias("start"), x["end"].alias("end"))
        if len(picks) == 1:
            return F.transform(each, put)
        each = F.array_sort(F.filter(each, lambda x: x["end"].isNotNull()))
        return _let(each, lambda e: F.transform(F.filter(e, lambda x, k: (k == 0) | (F.get(e, k - 1)["gram"] != x["gram"])), put))

    # a condition in a filter below would compute the tokens twice
    return rows.select("series", "docid", F.when(F.size("t") >= n, F.flatten(F.transform(F.sequence(F.lit(0), F.size("t") - n), at))).alias("g"))


def frequent_between(grams: DataFrame, low: int = 2, high: int = 100) -> DataFrame:
    """Grams whose number of documents lies in [low, high]."""
    df = grams.groupBy("gram").agg(F.count_distinct("docid").alias("df")).where(F.col("df").between(low, high)).select("gram")
    return grams.join(df, "gram")


#: Most hashes of grams that are sent to every task to leave out the others, and characters of texts that may hold so few.
KNOWN, SHORT = 500_000, 8_000_000


def large_series(docs: DataFrame) -> str | None:
    """The series with the most text, if all others together are short; None else."""
    sizes = docs.groupBy("series").agg(F.sum("chars" if "chars" in docs.columns else F.length("text")).alias("n"))
    first, total = sizes.agg(F.min(F.struct((-F.col("n")).alias("n"), "series")), F.sum("n")).first()
    return first["series"] if first and total and total + first["n"] <= SHORT else None


def near_series(grams: DataFrame, kept: Column) -> DataFrame | None:
    """The grams that equal one of those where `kept` is true, written; None if these are more than KNOWN.

    Their hashes go to every task, so the others are left out where they are made and no gram is shuffled.
    """
    h = F.xxhash64("gram")
    held = _checkpoint(grams.where(kept).select(h.alias("h")).distinct())
    return _checkpoint(grams.withColumn("h", h).join(F.broadcast(held), "h", "left_semi").drop("h")) if held.count() <= KNOWN else None


def _picks(n: int, gap: int) -> list[tuple[int, ...]]:
    """The tokens of a gram, counted from its first one."""
    return [(0, *c) for c in combinations(range(1, n + gap), n - 1)]


def _gram_hashes(tok: pa.ListArray, n: int, gap: int, ordered: bool) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
    """(pick, first token, hash) of the grams of a batch of token lists, for each choice of tokens; equal grams have equal hashes on all workers."""
    at, coded = tok.offsets.to_numpy().astype(np.int64), tok.flatten().dictionary_encode()
    if not len(coded):
        return
    h = pd.util.hash_array(np.array(coded.dictionary.to_pylist(), object), categorize=False)[coded.indices.to_numpy()]
    rest = np.repeat(at[1:] - at[0], np.diff(at)) - np.arange(len(h))
    for pick in _picks(n, gap):
        first = np.flatnonzero(rest > pick[-1])
        x = h[first]
        for k in pick[1:]:
            x = x * np.uint64(0x9E3779B97F4A7C15 if ordered else 1) + h[first + k]
        yield pick, first, x


def near_grams(tokens: DataFrame, kept: Column, n: int, gap: int, ordered: bool) -> DataFrame | None:
    """near_series of the grams of token_rows: grams are compared by hashes in arrays, and only those that are kept become strings."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, h in _gram_hashes(batch.column(0), n, gap, ordered):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h).view(np.int64))], ["h"])

    held = _checkpoint(tokens.where(kept).select("t.tok").mapInArrow(hashed, "h long").distinct())
    if held.count() > KNOWN:
        return None
    known = np.sort(np.array([r.h for r in held.collect()], np.int64).view(np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tok, start, end = (batch.column(c) for c in ("tok", "start", "end"))
            at, words, begun, ended = tok.offsets.to_numpy() - tok.offsets[0].as_py(), tok.flatten(), start.flatten().to_numpy(), end.flatten().to_numpy()
            got: dict = {}  # of equal grams at one position the shortest stands
            for pick, first, h in _gram_hashes(tok, n, gap, ordered):
                i = first[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
                for k, *w in zip(i.tolist(), *(words.take(pa.array(i + c)).to_pylist() for c in pick)):
                    key = k, " ".join(w if ordered else sorted(w))
                    got[key] = min(got.get(key, 1 << 40), int(ended[k + pick[-1]]))
            if got:
                i = np.array([k for k, _ in got])
                row = np.searchsorted(at, i, "right") - 1
                cols = [batch.column(c).take(pa.array(row)) for c in ("series", "docid")]
                cols += [pa.array((i - at[row]).astype(np.int32)), pa.array([g for _, g in got], pa.string()), pa.array(begun[i].astype(np.int32)), pa.array(list(got.values()), pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["series", "docid", "pos", "gram", "start", "end"])

    schema = T.StructType([tokens.schema["series"], tokens.schema["docid"]]).add("pos", "integer").add("gram", "string").add("start", "integer").add("end", "integer")
    found = tokens.select("series", "docid", "t.tok", "t.start", "t.end").mapInArrow(run, schema)
    return _checkpoint(found if len(known) else found.where("false"))


def between_series(grams: DataFrame, large: str | None = None) -> DataFrame:
    """The grams that stand in more than one series: only hashes are shuffled, and the others go before any join.

    Where a series is large, only grams of the other series are looked for in it (near_series).
    """
    if large is not None:
        near = near_series(grams, F.col("series") != large)
        grams = grams if near is None else near
    h = F.xxhash64("gram")
    held = grams.groupBy(h.alias("h")).agg(F.min("series").alias("lo"), F.max("series").alias("hi")).where("lo <> hi").select("h")
    held = _checkpoint(held)
    held = F.broadcast(held) if held.count() <= KNOWN else held
    return grams.withColumn("h", h).join(held, "h", "left_semi").drop("h")


def gram_matches(grams: DataFrame, source: str | None = None, large: str | None = None) -> DataFrame:
    """(a, b, pa, pb, gram): equal grams of documents of different series, each pair once (or from source to the others).

    A gram meets the other series that hold it, never its own, so a frequent gram
    makes as many rows as there are matches. Every gram counts, at each position
    once. Grams with start and end bring these as from_a, to_a, from_b, to_b.
    large: see between_series.
    """
    return _meetings(between_series(grams, large).distinct(), source)


def _meetings(shared: DataFrame, source: str | None = None) -> DataFrame:
    """gram_matches of grams that all stand in more than one series."""
    series = shared.groupBy("gram").agg(F.collect_set("series").alias("held"))
    own = shared if source is None else shared.where(F.col("series") == source)
    others = F.filter("held", (lambda x: x > F.col("series")) if source is None else (lambda x: x != F.col("series")))
    located = "end" in shared.columns
    chars = lambda s: [F.col("start").alias(f"s{s}"), F.col("end").alias(f"e{s}")] if located else []
    a = own.join(series, "gram").select("gram", F.col("docid").alias("a"), F.col("pos").alias("pa"), *[c.alias(n) for c, n in zip(chars("a"), ("from_a", "to_a"))], F.explode(others).alias("held_by"))
    b = shared.select("gram", F.col("series").alias("held_by"), F.col("docid").alias("b"), F.col("pos").alias("pb"), *[c.alias(n) for c, n in zip(chars("b"), ("from_b", "to_b"))])
    return a.join(b, ["gram", "held_by"]).drop("held_by")


def blast_run(docs: DataFrame, **params) -> DataFrame:
    """Passages of the seed detector whose clusters reach more than one series (F5), with the series."""
    found = seed_and_extend(docs, **params).join(docs.select("docid", "series"), "docid")
    wide = found.groupBy("cluster").agg(F.count_distinct("series").alias("k")).where("k > 1").select("cluster")
    return found.join(wide, "cluster", "left_semi").select("cluster", "docid", "series", "start", "end")


def gram_run(docs: DataFrame, **params) -> DataFrame:
    """T4: passages of the gram detector, regrouped by cluster (F6): (cluster, matches)."""
    from textloom.operators.reports import regroup

    return regroup(gram_alignment(docs, **params).join(docs.select("docid", "series"), "docid").select("cluster", "docid", "series", "start", "end"))


def candidate_pairs(matches: DataFrame, min_match: int) -> DataFrame:
    """(a, b, shared): pairs that share min_match distinct grams or more."""
    return matches.groupBy("a", "b").agg(F.count_distinct("gram").alias("shared")).where(F.col("shared") >= min_match)


def diagonal_seeds(matches: DataFrame, k: int) -> DataFrame:
    """T1, steps 3: runs of matches on one diagonal whose starts lie at most k apart: (a, b, diag, start, end, hits)."""
    w = Window.partitionBy("a", "b", "diag").orderBy("pa")
    rows = matches.select("a", "b", "pa", (F.col("pa") - F.col("pb")).alias("diag")).distinct()
    rows = rows.withColumn("new", F.when(F.col("pa") - F.lag("pa").over(w) <= k, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return rows.groupBy("a", "b", "diag", "island").agg(F.min("pa").alias("start"), (F.max("pa") + k - 1).alias("end"), F.count("*").alias("hits")).drop("island")


def islands(matches: DataFrame, max_gap: int, min_hits: int, window: int | None = None, in_window: int = 0) -> DataFrame:
    """T5: matches in source order; a new passage where either position moves more than max_gap. Kept from min_hits grams.

    With a window a passage begins only where in_window matches or more lie within
    the next `window` positions, on both sides; matches before that are left out.
    Positions of passages are those of the matches: code points where these have them.
    """
    w = Window.partitionBy("a", "b").orderBy("pa", "pb", "gram")
    gap = (F.col("pa") - F.lag("pa").over(w) > max_gap) | (F.abs(F.col("pb") - F.lag("pb").over(w)) > max_gap)
    rows = matches.withColumn("new", F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0))
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("island", F.sum("new").over(upto))
    if window is not None:
        ahead = lambda c: F.count("*").over(Window.partitionBy("a", "b").orderBy(c).rangeBetween(0, window - 1))
        rows = rows.withColumn("dense", F.least(ahead("pa"), ahead("pb")) >= in_window)
        inside = Window.partitionBy("a", "b", "island").orderBy("pa", "pb", "gram").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("open", F.max("dense").over(inside)).where("open")
    ends = [("from_a", "to_a"), ("from_b", "to_b")] if "to_a" in matches.columns else [("pa", "pa"), ("pb", "pb")]
    spans = [f for (lo, hi), s in zip(ends, "ab") for f in (F.min(lo).alias(f"start_{s}"), F.max(hi).alias(f"end_{s}"))]
    out = rows.groupBy("a", "b", "island").agg(*spans, F.count_distinct("gram").alias("hits"))
    return out.where(F.col("hits") >= min_hits).drop("island")


def smith_waterman(x: str, y: str, match: float, mismatch: float, gap: float, band: int) -> tuple[float, int, int, int, int]:
    """Best local alignment within a band of diagonals: (score, start x, end x, start y, end y), ends exclusive."""
    best, prev = (0.0, 0, 0, 0, 0), {}
    for i in range(1, len(x) + 1):
        row = {}
        mid = round(i * len(y) / len(x))
        for j in range(max(1, mid - band), min(len(y), mid + band) + 1):
            s, a, b = max(
                (prev.get(j - 1, (0.0, i - 1, j - 1))[0] + (match if x[i - 1] == y[j - 1] else -mismatch), *prev.get(j - 1, (0.0, i - 1, j - 1))[1:]),
                (prev.get(j, (0.0, i, j))[0] - gap, *prev.get(j, (0.0, i, j))[1:]),
                (row.get(j - 1, (0.0, i, j))[0] - gap, *row.get(j - 1, (0.0, i, j))[1:]),
                key=lambda t: t[0],
            )
            if s > 0:
                row[j] = (s, a, b)
                if s > best[0]:
                    best = (s, a, i, b, j)
        prev = row
    return best


#: Units of a score in the batched alignment; whole numbers, so that ties do not hang on rounding.
UNIT = 1_000_000


def banded_alignments(xs: list[str], ys: list[str], match: int, mismatch: int, gap: int, band: int) -> np.ndarray:
    """smith_waterman for many pairs at once: rows (score, start x, end x, start y, end y), ends exclusive.

    All pairs advance by one row of their band together. A row is one gather from
    the row before (diagonal and vertical steps) and one running maximum (gaps along
    the row); cells carry the start of their best alignment. Scores are integers.
    """
    n, m = np.array([*map(len, xs)], np.int64), np.array([*map(len, ys)], np.int64)
    out, width = np.zeros((len(xs), 5), np.int64), 2 * band + 1
    order = np.argsort(-n, kind="stable")
    order = order[(n[order] > 0) & (m[order] > 0)]
    if not len(order):
        return out
    codes = lambda t, k: np.frombuffer("".join(w.ljust(k, "\x00") for w in t).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(t), k)
    x, y = codes([xs[i] for i in order], int(n[order].max())), codes([ys[i] for i in order], int(m[order].max()))
    n, m = n[order], m[order]
    col, best = np.arange(width), np.zeros((len(order), 5), np.int64)
    h, start = np.zeros((len(order), width), np.int64), np.zeros((2, len(order), width), np.int64)
    base = np.full(len(order), -band)
    for i in range(1, int(n[0]) + 1):
        live = int(np.searchsorted(-n, -i, "right"))  # longer ones come first
        low = np.rint(i * m[:live] / n[:live]).astype(np.int64) - band
        j = low[:, None] + col
        at = j - base[:live, None]  # the same column in the row before
        inside = (j >= 1) & (j <= m[:live, None])

        def before(shift: int, values: np.ndarray, other) -> np.ndarray:
            k = at + shift  # noqa: B023
            there = (k >= 0) & (k < width)
            return np.where(there, np.take_along_axis(values, np.clip(k, 0, width - 1), 1), other)

        was, above = before(-1, h[:live], 0), before(0, h[:live], 0)
        same = x[:live, i - 1 : i] == np.take_along_axis(y[:live], np.clip(j - 1, 0, y.shape[1] - 1), 1)
        diagonal = was + np.where(same, match, -mismatch)
        step = diagonal >= above - gap
        here = np.where(inside, np.where(step, diagonal, above - gap), -(1 << 50))
        origin = []
        for axis, fresh in ((0, np.full_like(j, i - 1)), (1, j - 1)):
            d = np.where(was > 0, before(-1, start[axis, :live], 0), fresh)
            u = before(0, start[axis, :live], 0)
            origin.append(np.where(step, d, u))
        raised = here + gap * col
        top = np.maximum.accumulate(raised, axis=1)
        source = np.maximum.accumulate(np.where(raised == top, col, -1), axis=1)  # on ties the nearest column
        score = np.where(inside, np.maximum(0, top - gap * col), 0)
        h[:live] = score
        for axis in (0, 1):
            start[axis, :live] = np.take_along_axis(origin[axis], source, 1)
        base[:live] = low
        k = score.argmax(axis=1)
        rows = np.arange(live)
        better = score[rows, k] > best[:live, 0]
        r = rows[better]
        best[r] = np.stack([score[r, k[r]], start[0, r, k[r]], np.full(len(r), i), start[1, r, k[r]], j[r, k[r]]], 1)
    out[order] = best
    return out


def align_regions(regions: DataFrame, docs: DataFrame, *, pcopy: float = 0.8, letters: int = 26, beam: int = 20, margin: int = 50, min_align: int = 50) -> DataFrame:
    """T3, steps 5 and 6: local alignment of regions(a, b, start_a, end_a, start_b, end_b), read with a margin.

    The region of a is cut out before it meets the text of b, so no whole text
    crosses a second shuffle. Regions are aligned in batches.
    """
    match, mismatch = log(pcopy * letters), log(letters * (letters - 1) / ((1 - pcopy) * letters)) / 2
    whole = [round(v * UNIT) for v in (match, mismatch, mismatch)]
    rows = regions = _checkpoint(regions)
    ids = regions.select(F.explode(F.array("a", "b")).alias("docid")).distinct()
    docs = docs.join(F.broadcast(ids) if regions.count() <= KNOWN else ids, "docid", "left_semi")  # no other text is shuffled
    for s in "ab":
        text, lo = docs.select(F.col("docid").alias(s), F.col("text").alias("whole")), F.greatest(F.lit(0), F.col(f"start_{s}") - margin)
        rows = rows.join(text, s).withColumn(f"x{s}", F.substr("whole", lo + 1, F.col(f"end_{s}") - lo + margin)).drop("whole")

    @F.pandas_udf("score double, sa int, ea int, sb int, eb int")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        parts = [banded_alignments(x.iloc[k : k + 512].tolist(), y.iloc[k : k + 512].tolist(), *whole, beam) for k in range(0, len(x), 512)]
        got = np.concatenate(parts) if parts else np.zeros((0, 5), np.int64)
        return pd.DataFrame({"score": got[:, 0] / UNIT, **{c: got[:, k + 1] for k, c in enumerate(("sa", "ea", "sb", "eb"))}})

    got = rows.withColumn("_r", run("xa", "xb")).where(F.col("_r.ea") - F.col("_r.sa") >= min_align)
    base = lambda s: F.greatest(F.lit(0), F.col(s) - margin)
    return got.select("a", "b", "_r.score", (base("start_a") + F.col("_r.sa")).alias("start_a"), (base("start_a") + F.col("_r.ea") - 1).alias("end_a"), (base("start_b") + F.col("_r.sb")).alias("start_b"), (base("start_b") + F.col("_r.eb") - 1).alias("end_b"))


def best_predecessors(aligned: DataFrame, docs: DataFrame) -> DataFrame:
    """T3, step 7: of aligned(a, b, score, ...) only those with each document's best earlier one.

    Documents stand in the order of their series, those of one series by docid. The
    best is the earlier document with the highest sum of scores, of equal ones the
    latest; so a text that was copied from copy to copy gives the links of that chain.
    """
    place = docs.select("docid", F.struct("series", "docid").alias("at"))
    rows = aligned.join(place.toDF("a", "at_a"), "a").join(place.toDF("b", "at_b"), "b").withColumn("later", F.when(F.col("at_a") > F.col("at_b"), F.col("a")).otherwise(F.col("b")))
    rows = rows.withColumn("earlier", F.when(F.col("at_a") > F.col("at_b"), F.col("at_b")).otherwise(F.col("at_a")))
    sums = rows.groupBy("later", "earlier").agg(F.round(F.sum("score"), 6).alias("sum"))
    best = sums.groupBy("later").agg(F.max(F.struct("sum", "earlier")).alias("m")).select("later", F.col("m.earlier").alias("earlier"))
    return rows.join(best, ["later", "earlier"], "left_semi").select(*aligned.columns)


def origins(aligned: DataFrame, docs: DataFrame) -> DataFrame:
    """(docid, origin, steps): where each document's chain of best predecessors begins, by pointer jumping."""
    place = docs.select("docid", F.struct("series", "docid").alias("at"))
    links = aligned.join(place.toDF("a", "at_a"), "a").join(place.toDF("b", "at_b"), "b").select(F.when(F.col("at_a") > F.col("at_b"), F.col("a")).otherwise(F.col("b")).alias("docid"), F.when(F.col("at_a") > F.col("at_b"), F.col("b")).otherwise(F.col("a")).alias("up")).distinct()
    now = _checkpoint(docs.select("docid").join(links, "docid", "left").select("docid", F.coalesce("up", "docid").alias("origin"), F.col("up").isNotNull().cast("int").alias("steps")))
    while True:
        up = now.select(F.col("docid").alias("origin"), F.col("origin").alias("next"), F.col("steps").alias("more"))
        new = _checkpoint(now.join(up, "origin").select("docid", F.col("next").alias("origin"), (F.col("steps") + F.col("more")).alias("steps")))
        if not new.join(now.select("docid", F.col("origin").alias("was")), "docid").where("origin <> was").head(1):
            return now
        now = new


def cluster_passages(pairs: DataFrame) -> DataFrame:
    """Aligned pairs to passages(cluster, docid, start, end): overlapping spans of a document merge, pairs connect them.

    Incidence stays in rows: a passage that stands in many documents is never one array.
    """
    pairs = _checkpoint(pairs)  # read in every round of the components
    pairs = pairs.withColumn("pair", F.xxhash64("a", "b", "start_a", "end_a", "start_b", "end_b"))
    ends = [F.struct(F.col(s).alias("docid"), F.col(f"start_{s}").alias("start"), F.col(f"end_{s}").alias("end")) for s in "ab"]
    spans = pairs.select("pair", F.explode(F.array(*ends)).alias("p")).select("pair", "p.*")
    w = Window.partitionBy("docid").orderBy("start", "end", "pair")
    upto = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    # an island is known by its first start: the last start, so far, that lay beyond all ends before it
    first = F.when(upto.isNull() | (F.col("start") > upto), F.col("start"))
    spans = spans.withColumn("first", first).withColumn("island", F.last("first", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = _checkpoint(spans.select("pair", "docid", "island", "end", F.xxhash64("docid", "island").alias("id")))
    merged = spans.groupBy("id", "docid", F.col("island").alias("start")).agg(F.max("end").alias("end"))
    inc = spans.select("id", "pair")
    edges = inc.groupBy("pair").agg(F.min("id").alias("src"), F.max("id").alias("dst")).select("src", "dst", F.lit(1.0).alias("weight"))
    edges = _checkpoint(edges)
    comp = connected(merged.select("id"), edges)
    return merged.join(comp, "id").select(F.col("component").alias("cluster"), "docid", "start", "end")


#: Characters of a block of texts (a longer text stands alone), and seeds extended at once.
BLOCK, SEEDS = 1 << 20, 1 << 20
#: Above all code points: the marks at the ends of texts, one for each side so that they never match.
EDGE = 0x110000


def _joined(texts: list[str], edge: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points, start of each text), with an edge mark before, between and after the texts."""
    parts, starts, at = [np.array([edge], np.uint32)], [], 1
    for t in texts:
        x = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        parts += [x, parts[0]]
        starts.append(at)
        at += len(x) + 1
    return np.concatenate(parts), np.array(starts, np.int64)


def _hashes(x: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(0, len(x) - k + 1), np.uint64)
    for c in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[c : c + len(out)]
    return out


def _grown(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """(best gain, steps to it) of extension without gaps from before or after each run, given up 5 below the best."""
    best, far = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
    live, score, n = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    while len(live):
        n += 1
        a, b = x[i[live] + step * n], y[j[live] + step * n]
        inside = (a < EDGE) & (b < EDGE)
        score, live = (score + np.where(a == b, 1, -1))[inside], live[inside]
        up = score > best[live]
        best[live[up]], far[live[up]] = score[up], n
        on = score > best[live] - 5
        score, live = score[on], live[on]
    return best, far


def _seeded(a: pd.DataFrame, b: pd.DataFrame, k: int, least: float, scale: float) -> pd.DataFrame:
    """The passages of two blocks of texts (docid, text): every exact run of k characters or more, extended without gaps.

    Seeds on a diagonal whose starts lie at most k apart are one exact run, so a
    seed counts where the characters before it differ.
    """
    (x, sa), (y, sb) = _joined(a["text"].tolist(), EDGE), _joined(b["text"].tolist(), EDGE + 1)
    na, nb = a["text"].str.len().to_numpy(), b["text"].str.len().to_numpy()
    hx, hy = _hashes(x, k), _hashes(y, k)
    order = np.argsort(hy, kind="stable")
    hy = hy[order]
    lo = np.searchsorted(hy, hx)
    n = np.searchsorted(hy, hx, "right") - lo
    at, upto, out = 0, np.r_[0, np.cumsum(n)], []
    while at < len(hx):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + SEEDS, "right")) - 1)
        count = n[at:end]
        total = int(upto[end] - upto[at])
        if total:
            i = np.repeat(np.arange(at, end), count)
            j = order[np.arange(total) - np.repeat(upto[at:end] - upto[at], count) + np.repeat(lo[at:end], count)]
            new = x[i - 1] != y[j - 1]
            i, j = i[new], j[new]
            true = np.ones(len(i), bool)
            for c in range(k):
                true &= x[i + c] == y[j + c]
            i, j = i[true], j[true]
            size, live = np.full(len(i), k), np.arange(len(i))
            while len(live):
                live = live[x[i[live] + size[live]] == y[j[live] + size[live]]]
                size[live] += 1
            left, back = _grown(x, y, i, j, -1)
            right, on = _grown(x, y, i + size - 1, j + size - 1, 1)
            da, db = np.searchsorted(sa, i, "right") - 1, np.searchsorted(sb, j, "right") - 1
            good = scale * na[da] * nb[db] * np.exp(-least * (size + left + right))
            out.append((da, db, i - back - sa[da], i + size - 1 + on - sa[da], j - back - sb[db], j + size - 1 + on - sb[db], good))
        at = end
    da, db, *spans, e = (np.concatenate(c) for c in zip(*out)) if out else [np.zeros(0, np.int64)] * 7
    got = pd.DataFrame({"a": a["docid"].to_numpy(object)[da], "b": b["docid"].to_numpy(object)[db], **dict(zip(("start_a", "end_a", "start_b", "end_b"), spans))})
    return got[e <= 1].drop_duplicates()


def seed_and_extend(docs: DataFrame, *, word_size: int = 6, e_value: float = 0.001, min_length: int = 0, max_length: int = 100_000) -> DataFrame:
    """Seeds of word_size characters, chained on diagonals, ungapped extension, E = K m n exp(-lambda S).

    Every seed counts, however many documents hold it. Equal texts of a series
    are compared once, by their smallest docid. Blocks of texts meet block by
    block inside tasks, so seeds never become rows; work grows as the seeds.
    """
    lam, kk = log(3.0), 0.3  # match +1, mismatch -1 over near-uniform letters
    known = docs.where(F.length("text") >= word_size).select("series", "docid", "text", *[F.xxhash64("text", F.lit(i)).alias(f"k{i}") for i in (1, 2)])
    reps = known.groupBy("series", "k1", "k2").agg(F.min("docid").alias("rep"))
    ids = _checkpoint(known.drop("text").join(reps, ["series", "k1", "k2"]).select("series", "docid", "rep"))
    texts = known.select("series", "docid", "text").join(ids.where("docid = rep").select("series", "docid"), ["series", "docid"], "left_semi").dropDuplicates(["series", "docid"])
    sizes = {r.series: -(-r.n // BLOCK) for r in texts.groupBy("series").agg(F.sum(F.length("text")).alias("n")).collect()}  # one row a series
    plan = [(s, n, [(t, k) for t, k in sizes.items() if t > s], [(t, k) for t, k in sizes.items() if t < s]) for s, n in sizes.items()]
    others = "array<struct<other:string,n:int>>"
    plan = docs.sparkSession.createDataFrame(plan, f"series string, blocks int, later {others}, earlier {others}")
    dealt = texts.join(F.broadcast(plan), "series").withColumn("block", F.expr("cast(pmod(xxhash64(docid), blocks) as int)"))

    def side(partners: str, own: str, other: str) -> DataFrame:
        """Each text once for every block of its partners; the meetings are rows, listed nowhere."""
        rows = dealt.select("series", "block", "docid", "text", F.explode(partners).alias("p"))
        rows = rows.select("series", "block", "docid", "text", "p.other", F.explode(F.sequence(F.lit(0), F.col("p.n") - 1)).alias("with"))
        return rows.select(F.col("series").alias(f"s_{own}"), F.col("block").alias(f"i_{own}"), F.col("other").alias(f"s_{other}"), F.col("with").alias(f"i_{other}"), "docid", "text")

    meeting = ["s_a", "i_a", "s_b", "i_b"]
    left, right = side("later", "a", "b"), side("earlier", "b", "a")
    right = right.select(*[F.col(c).alias(f"{c}_") for c in (*meeting, "docid", "text")])
    run = lambda x, y: _seeded(x, y.rename(columns={"docid_": "docid", "text_": "text"}), word_size, lam, kk / e_value)
    found = left.groupBy(*meeting).cogroup(right.groupBy(*[f"{c}_" for c in meeting]))
    got = found.applyInPandas(run, "a string, b string, start_a long, end_a long, start_b long, end_b long")
    passages = cluster_passages(got.where((F.col("end_a") - F.col("start_a") + 1).between(min_length, max_length)))
    copies = ids.select("docid", F.col("rep")).distinct()
    return passages.withColumnRenamed("docid", "rep").join(copies, "rep").select("cluster", "docid", "start", "end")


def gram_alignment(docs: DataFrame, *, n: int = 25, min_match: int = 5, max_df: int = 100, gap: int = 200, floating: bool = True, beam: int = 20, min_align: int = 50, pcopy: float = 0.8, all_pairs: bool = False) -> DataFrame:
    """Character n-gram candidates, islands of anchors, banded local alignment, clusters.

    all_pairs compares documents of one series as well (each is a series of its own)
    and keeps every aligned pair; otherwise each document is linked with its best
    predecessor in the order of series only.
    """
    if all_pairs:
        docs = docs.withColumn("series", F.col("docid"))
    # a gram between series stands in two documents at least, so the order of the two filters is free
    shared = between_series(char_grams(docs, n, floating), None if all_pairs else large_series(docs))
    m = _checkpoint(_meetings(frequent_between(shared, 2, max_df)))
    m = m.join(candidate_pairs(m, min_match).select("a", "b"), ["a", "b"])
    aligned = align_regions(islands(m, gap, min_match).drop("hits"), docs, pcopy=pcopy, beam=beam, min_align=min_align)
    return cluster_passages(aligned if all_pairs else best_predecessors(_checkpoint(aligned), docs))


def window_alignment(docs: DataFrame, source: str, *, ngram: int = 3, gap: int = 0, window: int = 30, in_docs: int = 4, in_window: int = 4, max_gap: int = 15, minimum: int = 4, word_order: bool = True, stem: bool = True, fold_numbers: bool = True, distance: float = 0.5, duplicates: float = 100.0, banal_share: float = 0.9, common: float = 0.1, tell_banal: bool = True) -> DataFrame:
    """T5: (a, b, start_a, end_a, start_b, end_b, hits, banal), positions in code points, ends inclusive.

    Windows and gaps count tokens, which may be stems. Passages of a pair that lie
    closer on both sides than `distance` times the length of the one before are
    merged. Pairs that share more than `duplicates` per cent of the grams of the
    smaller document are copies and left out (none at 100). banal: banal_share of
    the matched grams are among the `common` most frequent ones; that needs the
    frequency of every gram, so it is left out where tell_banal is false. A docid
    stands in one row of docs. docs may come from tokenised, with the same stem and
    fold_numbers: calls with other settings then read its tokens instead of making them.
    """
    if "t" in docs.columns:
        tokens = docs.select("series", "docid", "t")
    else:
        tokens = token_rows(docs, 2, stem, fold_numbers)
        tokens = _checkpoint(tokens) if tell_banal or duplicates < 100 else tokens
    per_doc = gram_rows(tokens, ngram, gap, word_order)
    large, near = large_series(docs), None
    if large is not None:
        near = near_grams(tokens, F.col("series") == source if source != large else F.col("series") != large, ngram, gap, word_order)
    if near is None:
        # outer, since Spark filters by the size of what is exploded otherwise, and makes the grams twice
        near = per_doc.select("series", "docid", F.explode_outer("g").alias("g")).where("g is not null").select("series", "docid", "g.*")
    shared = between_series(near)
    edge = _quantile(_frequencies(tokens, ngram, gap, word_order), 1 - common) if tell_banal else 0
    m = _meetings(shared, source)
    if tell_banal:  # a gram that is shared is there with all its documents
        m = m.join(shared.groupBy("gram").agg(F.count_distinct("docid").alias("df")), "gram")
    m = _checkpoint(m)
    pairs = candidate_pairs(m, in_docs)
    if duplicates < 100:
        size = per_doc.select("docid", F.size(F.array_distinct(F.transform("g", lambda x: x["gram"]))).alias("n"))
        pairs = pairs.join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b").where(100 * F.col("shared") <= duplicates * F.least("na", "nb"))
    m = _checkpoint(m.join(pairs.select("a", "b"), ["a", "b"]))
    runs = islands(m, max_gap, minimum, window, in_window)
    w = Window.partitionBy("a", "b").orderBy("start_a", "start_b")
    near = lambda s: F.col(f"start_{s}") - F.lag(f"end_{s}").over(w) <= distance * (F.lag(f"end_{s}").over(w) - F.lag(f"start_{s}").over(w) + 1)
    onward = F.col("start_b") >= F.lag("start_b").over(w)
    runs = runs.withColumn("new", F.when(F.coalesce(near("a") & near("b") & onward, F.lit(False)), 0).otherwise(1)).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = runs.groupBy("a", "b", "g").agg(F.min("start_a").alias("start_a"), F.max("end_a").alias("end_a"), F.min("start_b").alias("start_b"), F.max("end_b").alias("end_b"), F.sum("hits").alias("hits"))
    if not tell_banal:
        return runs.drop("g")
    inside = runs.join(m, ["a", "b"]).where("from_a >= start_a and to_a <= end_a").groupBy("a", "b", "g").agg(F.avg((F.col("df") > edge).cast("int")).alias("share"))
    return runs.join(inside, ["a", "b", "g"], "left").withColumn("banal", F.coalesce(F.col("share") >= banal_share, F.lit(False))).drop("g", "share")


#: Hashes of grams that one task counts, and hashes that wait to be sent.
COUNTED, WAITING = 1 << 22, 1 << 20


def _frequencies(tokens: DataFrame, n: int, gap: int, ordered: bool) -> DataFrame:
    """(df, n): how many grams of token_rows stand in df documents. Hashes travel in blocks, by range, and are counted in arrays."""
    size = (tokens.agg(F.sum(F.size("t"))).first()[0] or 0) * len(_picks(n, gap))
    blocks = 1 + size // COUNTED
    bounds = np.array([(k << 64) // blocks for k in range(1, blocks)], np.uint64)

    def sent(hashes: list[np.ndarray]) -> pa.RecordBatch:
        h = np.sort(np.concatenate(hashes))
        parts = [(k, x.tobytes()) for k, x in enumerate(np.split(h, np.searchsorted(h, bounds))) if len(x)]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["block", "h"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0
        for batch in batches:
            tok, each = batch.column(0), list(_gram_hashes(batch.column(0), n, gap, ordered))
            at = tok.offsets.to_numpy() - tok.offsets[0].as_py()
            cuts = [np.searchsorted(first, at) for _, first, _ in each]
            for row in range(len(at) - 1 if each else 0):
                h = np.unique(np.concatenate([x[c[row] : c[row + 1]] for (_, _, x), c in zip(each, cuts)]))
                held, waiting = [*held, h] if waiting else [h], waiting + len(h)
                if waiting >= WAITING:
                    yield sent(held)
                    held, waiting = [], 0
        if waiting:
            yield sent(held)

    def counted(rows: pa.Table) -> pa.Table:
        h = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in rows.column("h").to_pylist()]))
        df, k = np.unique(np.diff(np.flatnonzero(np.r_[True, h[1:] != h[:-1], True])), return_counts=True)
        return pa.table({"df": pa.array(df, pa.int64()), "n": pa.array(k, pa.int64())})

    each = tokens.select("t.tok").mapInArrow(hashed, "block int, h binary").groupBy("block").applyInArrow(counted, "df long, n long")
    return each.groupBy("df").agg(F.sum("n").alias("n"))


def _frequency(per_doc: DataFrame, share: float) -> int:
    """The document frequency that `share` of all grams of gram_rows do not exceed; only a hash and a count of a gram are shuffled."""
    hashes = F.array_distinct(F.transform("g", lambda x: F.xxhash64(x["gram"])))
    each = per_doc.select(F.explode(hashes).alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    return _quantile(each.groupBy("df").agg(F.count("*").alias("n")), share)


def _quantile(frequencies: DataFrame, share: float) -> int:
    """The document frequency that `share` of all grams do not exceed."""
    counts = frequencies.orderBy("df").collect()  # one row a frequency
    upto, total = 0, sum(r["n"] for r in counts)
    for r in counts:
        upto += r["n"]
        if upto >= share * total:
            return r["df"]
    return 0
