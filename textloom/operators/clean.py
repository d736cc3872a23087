"""Cleaning and normalisation (C1-C13) as column expressions.

Rules are ordered (regex, replacement) pairs in Python's dialect; they are
translated once to Java's and folded into one chain of regexp_replace, which
stays inside whole-stage code generation.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.sources.tables import bound_batches

#: Inline markers of the data model.
SENTENCE, CHAPTER, INSERT, INSERT_END, LINE = "#SEND#", "#CSTART#", "#INSTART#", "#INEND#", "#lb#"


def java(regex: str, replacement: str = "") -> tuple[str, str]:
    """Python regex and replacement in Java's dialect: Unicode classes, $1 for \\1."""
    return "(?U)" + regex, re.sub(r"\\(\d)", r"$\1", replacement.replace("$", r"\$"))


def fold(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """C4: the rules one after another."""
    return reduce(lambda t, r: F.regexp_replace(t, F.lit(java(*r)[0]), F.lit(java(*r)[1])), rules, text)


def normalise(text: Column, case_rules: Iterable[tuple[str, str]] = (), rules: Iterable[tuple[str, str]] = ()) -> Column:
    """C4: case-sensitive rules, lower case, lower-case rules."""
    return fold(F.lower(fold(text, case_rules)), rules)


def split_camel(text: Column) -> Column:
    """C1."""
    return F.regexp_replace(text, "([a-zßöů])([A-Z])", "$1 $2")


def glue_consonant(text: Column) -> Column:
    """A single consonant joins the word before it."""
    return F.regexp_replace(text, r"(?U)(?<=\w)\s(?=[befghknopqrstwyz]\W)", "")


def is_number(word: Column) -> Column:
    """Roman numerals, but for words that look like one."""
    return word.rlike("^[ijvxlcdmIJVXLCDM]+$") & ~word.rlike("^[vV][ijIJ]{1,2}[lL][lL]?$") & ~word.rlike("^[ijIJ]{1,2}[mM]")


def _collapse(texts: pd.Series) -> pd.Series:
    run = re.compile(r"(?<!\w)[ijvxlcdm]+(?:\.?\s?[ijvxlcdm]+)*\.?(?!\w)", re.I)
    word = re.compile(r"v[ij]{1,2}ll?$|[ij]{1,2}m", re.I)

    def one(m: re.Match) -> str:
        parts = re.split(r"[.\s]+", m[0].strip(". "))
        if len(parts) < 2 and not m[0].endswith(".") or any(word.match(p) for p in parts):
            return m[0]
        return "".join(parts)

    return texts.map(lambda t: None if t is None else run.sub(one, t.replace("/", " ")))


def collapse_numerals(text: Column) -> Column:
    """Slashes to spaces; runs of Roman numerals lose dots and spaces. Each run is decided where it stands."""
    return F.pandas_udf(_collapse, "string")(text)


def mark_boundaries(text: Column) -> Column:
    """Punctuation becomes boundary markers."""
    out = F.regexp_replace(text, "(?<!#lb)#(?!lb#)|⸿", CHAPTER)
    out = F.regexp_replace(out, r"[.:!?]", SENTENCE)
    return F.replace(F.replace(out, F.lit("("), F.lit(INSERT)), F.lit(")"), F.lit(INSERT_END))


def squeeze(text: Column) -> Column:
    """C7."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def clean(text: Column, case_rules=(), rules=(), extra=(), lowercase: bool = True) -> Column:
    """The whole cleaner. The vocabulary is an aggregation of its own (vocab.vocabulary)."""
    out = collapse_numerals(glue_consonant(split_camel(text)))
    out = fold(normalise(out, case_rules, rules) if lowercase else fold(out, case_rules), extra)
    return squeeze(mark_boundaries(out))


def clean_rows(rows: DataFrame, **how) -> DataFrame:
    """Every row cleaned, empty rows dropped; a corpus column stands for separate files."""
    bound_batches(rows.sparkSession)
    return rows.withColumn("text", clean(F.col("text"), **how)).where(F.trim("text") != "")


def plain(text: Column) -> Column:
    """Markers to spaces, dashes to spaces outside $seg...$, white space squeezed and trimmed."""
    out = F.replace(text, F.lit(INSERT), F.lit(""))
    out = F.regexp_replace(out, "#SEND#|#CSTART#|#INEND#|#lb#|=", " ")
    out = F.regexp_replace(out, r"-(?![^$\s]*\$)", " ")
    out = F.regexp_replace(squeeze(out), r"\$ (?=segend_)", r"\$")
    return F.trim(out)
