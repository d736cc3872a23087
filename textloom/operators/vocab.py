"""Vocabulary (V1-V7) and vocabulary-driven word joining.

The vocabulary is a relation, never a driver-side list. Joining decides against
the vocabulary as it stood before (snapshot semantics), so that the result does
not depend on the order of rows; join_in_order changes the vocabulary with every
decision instead, row by row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.clean import is_number, normalise
from textloom.sources.tables import written

#: (case rules, lower-case rules) of C4, applied to joined and separated forms.
Rules = tuple[tuple[tuple[str, str], ...], tuple[tuple[str, str], ...]]


def tokens(rows: DataFrame, doc: str, pattern: str = "[a-z]+", text: str = "text") -> DataFrame:
    """(docid, word): one row for each token of the lower-cased text."""
    return rows.select(F.col(doc).alias("docid"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))).alias("word"))


def vocabulary(rows: DataFrame, doc: str, **how) -> DataFrame:
    """V2: (word, docid, freq)."""
    return tokens(rows, doc, **how).groupBy("word", "docid").agg(F.count("*").alias("freq"))


def totals(vocab: DataFrame) -> DataFrame:
    """(word, globfreq)."""
    return vocab.groupBy("word").agg(F.sum("freq").alias("globfreq"))


def frequencies(rows: DataFrame, text: str = "text", **how) -> DataFrame:
    """(word, globfreq) of rows, as totals of their vocabulary; words are shuffled once, whatever the number of documents."""
    return tokens(rows, text, text=text, **how).groupBy("word").agg(F.count("*").alias("globfreq"))


def export(vocab: DataFrame, by: str = "freq") -> DataFrame:
    """V5: words with global frequency and number of documents, sorted."""
    out = vocab.groupBy("word").agg(F.sum("freq").alias("globfreq"), F.count("*").alias("ndocs"))
    return out.orderBy(F.desc("globfreq"), "word") if by == "freq" else out.orderBy("word")


def doc_totals(vocab: DataFrame) -> DataFrame:
    """V5: (docid, wcount)."""
    return vocab.groupBy("docid").agg(F.sum("freq").alias("wcount"))


def remove(vocab: DataFrame, gone: DataFrame) -> DataFrame:
    """V3: occurrences in gone(word, docid, freq) taken off; a word at zero disappears."""
    delta = vocab.unionByName(gone.withColumn("freq", -F.col("freq")))
    return delta.groupBy("word", "docid").agg(F.sum("freq").alias("freq")).where("freq > 0")


def load(spark, path: str) -> DataFrame:
    """V6: a written vocabulary (word, docid, freq), sorted by word."""
    return spark.read.parquet(path).select("word", "docid", "freq").orderBy("word", "docid")


def lookup(words: DataFrame, vocab: DataFrame, docid: str) -> DataFrame:
    """V4: globfreq (0 where unknown) and docfreq in one document (-1 where absent) of words(word)."""
    own = vocab.where(F.col("docid") == docid).select("word", F.col("freq").alias("docfreq"))
    return words.join(totals(vocab), "word", "left").join(own, "word", "left").select("word", F.coalesce("globfreq", F.lit(0)).cast("long").alias("globfreq"), F.coalesce("docfreq", F.lit(-1)).cast("long").alias("docfreq"))


def join_rule(t1: Column, t2: Column, joined: Column, first: Column, second: Column, prefix: bool = False) -> Column:
    """Whether t1 and t2 are one word, from the frequencies (0: unknown) of the joined form and the parts.

    By the number of known parts. Joined form known: none - join; one - unless it is
    a number; both - unless one is a number, if the joined form is frequent or a
    part stands once. Unknown: only one known, neither a number, the other short.
    """
    if prefix:
        return (joined > 0) & (F.length(t2) > 3) & (second < joined)
    parts = (first > 0).cast("int") + (second > 0).cast("int")
    known, unknown = F.when(first > 0, t1).otherwise(t2), F.when(first > 0, t2).otherwise(t1)
    words = ~(is_number(t1) | is_number(t2))
    as_one = F.when(parts == 0, True).when(parts == 1, ~is_number(known)).otherwise(words & ((joined >= 2) | (first == 1) | (second == 1)))
    return F.when(joined > 0, as_one).otherwise((parts == 1) & words & (F.length(unknown) < 3))


def decide(pairs: DataFrame, freqs: DataFrame, prefix: bool = False, rules: Rules | None = None, counted: tuple[bool, bool] = (False, False)) -> DataFrame:
    """pairs(t1, t2) with is_join, whole and apart (the text for either case), from freqs(word, globfreq).

    rules: the joined and the separated form are normalised before they are looked
    up; where the rules make one word of the separated form, it is joined. counted:
    whether the vocabulary holds this very t1 or t2, whose occurrence is taken off.
    """
    form = (lambda c: normalise(c, *rules)) if rules else (lambda c: c)
    out = pairs.withColumn("whole", form(F.concat("t1", "t2"))).withColumn("apart", form(F.concat_ws(" ", "t1", "t2")))
    out = out.withColumn("_p", F.filter(F.split("apart", r"(?U)\s+"), lambda x: x != ""))
    merged = F.size("_p") < 2
    out = out.withColumn("_m", merged).withColumn("_a", F.when(merged, F.col("t1")).otherwise(F.get("_p", F.lit(0)))).withColumn("_b", F.when(merged, F.col("t2")).otherwise(F.get("_p", F.lit(1))))
    for key, name, less in (("whole", "fj", False), ("_a", "f1", counted[0]), ("_b", "f2", counted[1])):
        out = out.withColumn("_k", F.lower(key)).join(freqs.select(F.col("word").alias("_k"), F.col("globfreq").alias(name)), "_k", "left").fillna(0, [name]).drop("_k")
        if less:
            out = out.withColumn(name, F.greatest(F.lit(0), F.col(name) - 1))
    rule = join_rule(F.col("_a"), F.col("_b"), F.col("fj"), F.col("f1"), F.col("f2"), prefix)
    return out.withColumn("is_join", F.col("_m") | rule).drop("_p", "_m", "_a", "_b")


def _join_candidates(rows: DataFrame, freqs: DataFrame, regex: str, split: str, prefix: bool, rules: Rules | None, counted: tuple[bool, bool]) -> DataFrame:
    """Candidates of a text are decided by joins and put back, in the order in which they stand, between non-word boundaries."""
    found = rows.withColumn("_c", F.array_distinct(F.regexp_extract_all("text", F.lit(regex), F.lit(0))))
    cand = found.select(F.explode("_c").alias("c")).distinct().withColumn("t1", F.split("c", split)[0]).withColumn("t2", F.split("c", split)[1])
    told = decide(cand, freqs, prefix, rules, counted).select("c", F.when(F.col("is_join"), F.col("whole")).otherwise(F.col("apart")).alias("r"))
    told = told.withColumn("r", F.replace(F.replace("r", F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$")))
    keyed = found.withColumn("_k", F.monotonically_increasing_id())
    maps = keyed.select("_k", F.posexplode("_c").alias("n", "c")).join(told, "c").groupBy("_k").agg(F.sort_array(F.collect_list(F.struct("n", "c", "r"))).alias("_m"))
    done = keyed.join(maps, "_k", "left")
    put = lambda t, x: F.regexp_replace(t, F.concat(F.lit(r"(?U)(?<!\w)"), x["c"], F.lit(r"(?!\w)")), x["r"])
    return done.withColumn("text", F.aggregate(F.coalesce("_m", F.array().cast("array<struct<n:int,c:string,r:string>>")), F.col("text"), put)).drop("_c", "_k", "_m")


def join_line_ends(rows: DataFrame, freqs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Words broken at #lb# joined or separated, until no break between words is left.

    A round decides every second break of a chain at least, so the rounds are as
    many as the longest chain of breaks needs; each is written, not replanned.
    """
    rows = rows.withColumn("text", F.regexp_replace("text", r"(?U)\s*#lb#\s*", "#lb#"))
    broken = F.col("text").rlike(r"(?U)\w#lb#\w")
    while rows.where(broken).head(1):
        rows = written(_join_candidates(rows, freqs, r"(?U)\w+#lb#\w+", "#lb#", False, rules, (False, False)), "joined")
    return rows


def join_prefixes(rows: DataFrame, freqs: DataFrame, prefixes: list[str], rules: Rules | None = None) -> DataFrame:
    """Separated prefixes (regexes of the prefix word) joined with the next word; both are in the vocabulary already."""
    return _join_candidates(rows, freqs, "(?U)(?<!\\w)(?:" + "|".join(prefixes) + r") \w+", " ", True, rules, (True, True))


def join_page_breaks(rows: DataFrame, freqs: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The first word of a row goes to the row before if that ends in = (always) or #lb# (by W1).

    rows(corpus, bookpart, paragraph, row_idx, text). Rows are decided on the
    input text; a row with a single word keeps its place.
    """
    w = Window.partitionBy("corpus").orderBy("row_idx")
    same = (F.lead("bookpart").over(w).eqNullSafe(F.col("bookpart"))) & (F.lead("paragraph").over(w).eqNullSafe(F.col("paragraph")))
    out = rows.withColumn("nxt", F.lead("text").over(w)).withColumn("same", F.coalesce(same, F.lit(False)))
    out = out.withColumn("t1", F.regexp_extract("text", r"(?U)(\w+)\s*(?:=|#lb#)\s*$", 1)).withColumn("t2", F.regexp_extract("nxt", r"(?U)^\s*(\w+)", 1))
    out = decide(out, freqs, rules=rules, counted=(False, True))
    glue = F.col("text").rlike(r"=\s*$") & F.col("nxt").isNotNull()
    ask = F.col("text").rlike(r"(?<!#)#lb#\s*$") & F.col("same") & ~F.col("nxt").startswith("#") & (F.col("t1") != "")
    takes = (glue | (ask & F.col("is_join"))) & (F.col("t2") != "")
    out = out.withColumn("takes", F.coalesce(takes, F.lit(False)))
    w = Window.partitionBy("corpus").orderBy("row_idx")
    given = F.coalesce(F.lag("takes").over(w), F.lit(False))
    one = F.concat(F.regexp_replace("text", r"(?U)\w*\s*(=|#lb#)\s*$", ""), F.col("whole"))
    tail = F.when(F.col("takes"), one).otherwise(F.col("text"))
    return out.withColumn("text", F.when(given, F.regexp_replace(tail, r"(?U)^\s*\w+\s*", "")).otherwise(tail)).select(*rows.columns)


_NUMBER, _NO_NUMBER = re.compile(r"[ijvxlcdm]+", re.I), re.compile(r"v[ij]{1,2}ll?$|[ij]{1,2}m", re.I)


def _is_number(word: str) -> bool:
    """C13 on a Python string."""
    return bool(_NUMBER.fullmatch(word)) and not _NO_NUMBER.match(word)


def _one_word(t1: str, t2: str, joined: int, first: int, second: int, prefix: bool) -> bool:
    """join_rule on Python values."""
    if prefix:
        return joined > 0 and len(t2) > 3 and second < joined
    known = [t for t, n in ((t1, first), (t2, second)) if n]
    words = not (_is_number(t1) or _is_number(t2))
    if joined:
        return not known or (not _is_number(known[0]) if len(known) == 1 else words and (joined >= 2 or 1 in (first, second)))
    return len(known) == 1 and words and len(t2 if first else t1) < 3


class _Fold:
    """The ordered fold over the rows of one corpus: frequencies that change with each decision."""

    def __init__(self, known: dict[str, int], rules: Rules):
        self.known, self.rules = known, rules
        self.changed: Counter = Counter()
        self.asked: set[str] = set()

    def form(self, text: str) -> str:
        for rule in self.rules[0]:
            text = re.sub(*rule, text)
        text = text.lower()
        for rule in self.rules[1]:
            text = re.sub(*rule, text)
        return text

    def freq(self, word: str) -> int:
        if word not in self.known:
            self.asked.add(word)
        return max(0, self.known.get(word, 0) + self.changed[word])

    def decide(self, t1: str, t2: str, prefix: bool, counted: tuple[bool, bool]) -> str:
        """The text for the two words; the vocabulary follows."""
        whole, parts = self.form(t1 + t2), self.form(f"{t1} {t2}").split()
        a, b = parts[:2] if len(parts) > 1 else (t1, t2)
        low = [x.lower() for x in (whole, a, b)]
        n = [self.freq(x) for x in low]
        one = len(parts) < 2 or _one_word(a, b, n[0], max(0, n[1] - counted[0]), max(0, n[2] - counted[1]), prefix)
        self.changed[low[0]] += one
        for word, there in zip(low[1:], counted):
            self.changed[word] += -one if there else not one
        return whole if one else " ".join(parts)

    def candidates(self, text: str, regex: str, split: str, prefix: bool, counted: tuple[bool, bool]) -> str:
        for c in re.findall(regex, text):
            said = self.decide(*c.split(split)[:2], prefix, counted)
            text = re.sub(rf"(?<!\w){c}(?!\w)", lambda m, r=said: r, text)
        return text

    def line_ends(self, text: str) -> str:
        text = re.sub(r"\s*#lb#\s*", "#lb#", text)
        while re.search(r"\w#lb#\w", text):
            text = self.candidates(text, r"\w+#lb#\w+", "#lb#", False, (False, False))
        return text

    def prefixes(self, text: str, regexes: list[str]) -> str:
        return self.candidates(text, r"(?<!\w)(?:" + "|".join(regexes) + r") \w+", " ", True, (True, True)) if regexes else text


def join_in_order(rows: DataFrame, freqs: DataFrame, *, prefixes: list[str] = (), rules: Rules = ((), ()), corpus: str = "corpus", order: str = "row_idx") -> tuple[DataFrame, DataFrame]:
    """W2 and W3, exactly in the order of rows: (rows with joined texts, changes(corpus, word, n) of the vocabulary).

    Every decision changes the vocabulary that the next one of its corpus meets; all
    corpora begin with freqs(word, globfreq). A corpus is one sorted partition that
    a task walks through, holding only the words that its decisions look up: a walk
    tells the words that it has missed, and walks are repeated with these until
    none is missed, so the vocabulary itself is never sent anywhere. Null texts
    count as empty.
    """
    fields, spark = rows.columns, rows.sparkSession
    base = written(rows.select(F.col(corpus).cast("string").alias("_corpus"), F.col(order).cast("long").alias("_at"), "*"), "rows")
    schema = base.selectExpr("*", "cast(null as string) as _kind", "cast(null as string) as _word", "cast(null as long) as _n").schema
    known = spark.createDataFrame([], "_corpus string, _word string")
    walk = _walker([f.name for f in schema], list(prefixes), rules)
    while True:
        given = known.join(freqs.select(F.col("word").alias("_word"), F.col("globfreq").cast("long").alias("_n")), "_word", "left").select("_corpus", F.lit(-1 << 62).cast("long").alias("_at"), "_word", F.coalesce("_n", F.lit(0).cast("long")).alias("_n"))
        both = base.unionByName(given, allowMissingColumns=True).withColumn("_kind", F.lit(None).cast("string")).select(*[f.name for f in schema])
        out = written(both.repartition("_corpus").sortWithinPartitions("_corpus", "_at").mapInPandas(walk, schema), "walked")
        missed = out.where("_kind = 'asked'").select("_corpus", "_word")
        if not missed.head(1):
            break
        known = written(known.union(missed).distinct(), "known")
    changes = out.where("_kind = 'changed'").select(F.col("_corpus").alias("corpus"), F.col("_word").alias("word"), F.col("_n").alias("n"))
    return out.where("_kind = 'row'").select(*fields), changes


def _walker(columns: list[str], prefixes: list[str], rules: Rules) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The walk of a task through its sorted corpora: words that are known come first in each."""

    def told(corpus: str, fold: _Fold) -> pd.DataFrame:
        rest = [(corpus, "asked", w, None) for w in sorted(fold.asked)] + [(corpus, "changed", w, n) for w, n in sorted(fold.changed.items()) if n]
        return pd.DataFrame(rest, columns=["_corpus", "_kind", "_word", "_n"]).reindex(columns=columns).astype(object)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fold, now = None, None
        for pdf in batches:
            for corpus, part in pdf.groupby("_corpus", sort=False, dropna=False):
                corpus = None if pd.isna(corpus) else corpus
                if fold is None or corpus != now:
                    if fold is not None:
                        yield told(now, fold)
                    fold, now = _Fold({}, rules), corpus
                words = part["_word"].notna()
                fold.known.update(zip(part.loc[words, "_word"], part.loc[words, "_n"].astype(int)))
                part = part[~words].astype(object)
                part["text"] = [fold.prefixes(fold.line_ends(t or ""), prefixes) for t in part["text"]]
                part["_kind"] = "row"
                yield part
        if fold is not None:
            yield told(now, fold)

    return walk
