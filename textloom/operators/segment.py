"""Segmentation (G1-G4): sentences, insertions, word n-grams, full text with offsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.sources.tables import bound_batches


def ngrams(rows: DataFrame, n: int, keys: list[str], pattern: str = "[a-z]+", text: str = "text") -> DataFrame:
    """(keys, pos, gram): word n-grams within each row, no shuffle."""
    words = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.concat_ws(" ", F.slice("w", i + 1, n)))
    # no filter by size: it would be pushed below the words and make them twice
    return rows.select(*keys, words.alias("w")).select(*keys, F.posexplode(F.when(F.size("w") >= n, grams)).alias("pos", "gram"))


def ngrams_across(rows: DataFrame, n: int = 5) -> DataFrame:
    """Word n-grams across the rows of a paragraph, located where they start.

    rows(corpus, bookpart, paragraph, row_idx, text, ...).
    """
    words = F.regexp_extract_all("text", F.lit(r"(?U)\S+"), F.lit(0))
    each = rows.select(*[c for c in rows.columns if c != "text"], F.posexplode(words).alias("pos", "word"))
    w = Window.partitionBy("corpus", "bookpart", "paragraph").orderBy("row_idx", "pos")
    each = each.withColumn("last", F.lead("word", n - 1).over(w)).withColumn("gram", F.concat_ws(" ", "word", *[F.lead("word", i).over(w) for i in range(1, n)]))
    return each.where("last is not null").drop("word", "last")


def full_text(rows: DataFrame, order: str = "row_idx") -> DataFrame:
    """(corpus, text), rows joined by a space."""
    parts = F.sort_array(F.collect_list(F.struct(order, "text")))
    return rows.groupBy("corpus").agg(F.concat_ws(" ", F.transform(parts, lambda p: p["text"])).alias("text"))


def offset_index(rows: DataFrame, key: str, order: str = "row_idx") -> DataFrame:
    """(corpus, key, start, end) of each key in the full text, separators counted, end exclusive."""
    w = Window.partitionBy("corpus").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("text")
    upto = rows.withColumn("_end", F.sum(size + 1).over(w) - 1).withColumn("_start", F.col("_end") - size)
    return upto.groupBy("corpus", key).agg(F.min("_start").alias("start"), F.max("_end").alias("end"))


def sentence_pieces(text: Column) -> Column:
    """The plain split of a text at sentence and chapter markers: trimmed, non-empty pieces."""
    return F.filter(F.transform(F.split(text, "#SEND#|#CSTART#"), lambda s: F.trim(s)), lambda s: s != "")


def expand_insertions(segments: DataFrame) -> DataFrame:
    """Each parenthesis, the text with and the text without it."""
    inner = F.regexp_extract_all("text", F.lit("#INSTART#(.*?)#INEND#"), F.lit(1))
    whole = F.regexp_replace("text", "#INSTART#|#INEND#", "")
    without = F.regexp_replace(F.regexp_replace("text", "#INSTART#.*?#INEND#", ""), r"\s+", " ")
    without = F.when(F.contains("text", F.lit("#INSTART#")), without).otherwise(whole)
    every = F.array_distinct(F.concat(inner, F.array(whole, without)))
    return segments.withColumn("text", F.explode(F.filter(F.transform(every, lambda s: F.trim(s)), lambda s: s != "")))


def sentences(rows: DataFrame, min_words: int = 4, insertion: str = "join") -> DataFrame:
    """G1: sentences of rows(corpus, bookpart, paragraph, row_idx, text, page); short ones join their neighbours.

    A piece of min_words words stands alone; of three joins the sentence before;
    of one or two joins it and goes on into the next. Unfinished tails go on
    into the next row of the paragraph. One paragraph is folded in one task.
    """
    return _by_paragraph(rows, lambda lines: [(p.replace("#INPOINT#", "#SEND#"), at) for p, at in _folded(lines, min_words, insertion)])


def nested_sentences(rows: DataFrame, min_words: int = 4) -> DataFrame:
    """Sentences, and of each that holds parentheses every one of them, the whole and the rest, segmented again.

    A sentence keeps its parentheses whole (their sentence ends do not split it);
    the pieces that it gives go through the same fold, markers left out, so that
    short ones join their neighbours within their piece.
    """

    def nested(lines):
        for piece, at in _folded(lines, min_words, "join"):
            text = piece.replace("#INPOINT#", "#SEND#")
            if "#INSTART#" not in text:
                yield text, at
                continue
            for part in [*re.findall(r"(?<=#INSTART#).*?(?=#INEND#)", text), text, re.sub(r"\s*#INSTART#.*?#INEND#\s*", " ", text)]:
                yield from _folded([(part, at)], min_words, "ignore")

    return _by_paragraph(rows, nested)


#: Segments in a batch that leaves Python, and their characters.
SEGMENTS, CHARS = 1000, 1 << 20
_SEGMENT = pa.schema([("corpus", pa.string()), ("bookpart", pa.string()), ("paragraph", pa.string()), ("seg_idx", pa.int32()), ("page", pa.int32()), ("text", pa.string())])


def _by_paragraph(rows: DataFrame, fold: Callable[[Iterable[tuple]], Iterable[tuple]]) -> DataFrame:
    """Segments that fold makes of the (text, page) lines of each paragraph, numbered.

    Rows are dealt out by paragraph and sorted, and a task walks them in batches, so
    that neither many small paragraphs nor a long one are groups of their own in Python.
    """
    bound_batches(rows.sparkSession)
    place = ["corpus", "bookpart", "paragraph"]
    named = rows.select(*[F.col(c).cast("string").alias(c) for c in place], "row_idx", F.col("page").cast("int").alias("page"), "text")
    dealt = named.repartition(*place).sortWithinPartitions(*place, "row_idx").drop("row_idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (row for batch in batches for row in zip(*[batch.column(c).to_pylist() for c in (*place, "text", "page")]))
        full = lambda out: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _SEGMENT)], schema=_SEGMENT)
        out, chars = [], 0
        for key, own in groupby(lines, key=itemgetter(0, 1, 2)):
            for k, (text, at) in enumerate(fold((text, page) for *_, text, page in own)):
                out.append((*key, k, at, text))
                chars += len(text)
                if len(out) == SEGMENTS or chars >= CHARS:
                    yield full(out)
                    out, chars = [], 0
        if out:
            yield full(out)

    return dealt.mapInArrow(run, "corpus string, bookpart string, paragraph string, seg_idx int, page int, text string")


#: Sentences that a fold holds back, since later lines may still change them; they change the last one, and take it back once.
HELD = 4


def _folded(lines: Iterable[tuple], min_words: int, insertion: str) -> Iterator[list]:
    """[sentence, page] of the lines of a paragraph, as soon as no further line changes them."""
    out: list[list] = []
    pending, where = "", None
    bound = r"#SEND#|#CSTART#" + (r"|#INSTART#|#INEND#" if insertion == "sentbound" else "")
    for text, page in lines:
        if not text or not text.strip():
            continue
        if insertion == "join":
            text = re.sub(r"#INSTART#.*?#INEND#", lambda m: m[0].replace("#SEND#", "#INPOINT#"), text)
        elif insertion == "ignore":
            text = re.sub(r"#INSTART#|#INEND#", "", text)
        for piece in filter(None, (p.strip() for p in re.split(bound, text))):
            at = page
            if pending:
                if len(pending) > len(piece):
                    at = where
                piece = pending[:-1] + piece if pending.endswith("=") else f"{pending} {piece}"
                pending = ""
            n = len(piece.split())
            if n >= min_words:
                out.append([piece, at])
            elif out and n == min_words - 1:
                out[-1][0] += " " + piece
            else:
                if out:
                    out[-1][0] += " " + piece
                pending, where = piece, at
        if not text.rstrip().endswith("#SEND#") and not pending and out:
            pending, where = out.pop()
        yield from out[:-HELD]
        out = out[-HELD:]
    if pending:
        if len(pending.split()) < min_words and out:
            if not out[-1][0].endswith(pending):
                out[-1][0] += " " + pending
        else:
            out.append([pending, where])
    yield from out
