"""Drivers (C10, P1-P11, E18-E21): whole chains over corpora, as compositions of the operators.

A corpus is a column, not a file: rows(corpus, bookpart, paragraph, row_idx,
page, text). Settings are values handed in; nothing keeps state between calls.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import clean, detect, matches, segment, vocab, wordgraph
from textloom.sources import tables
from textloom.sources.tables import fresh_path, written

ROW = ("corpus", "bookpart", "paragraph", "row_idx", "page")


@dataclass(frozen=True)
class Preparation:
    """Settings of the preparation chain."""

    case_rules: tuple[tuple[str, str], ...] = ()
    rules: tuple[tuple[str, str], ...] = ()
    extra: tuple[tuple[str, str], ...] = ()
    prefixes: tuple[str, ...] = ()
    lowercase: bool = True
    join: bool = True
    in_order: bool = False
    min_words: int = 4
    ngram: int = 5
    insertion: str = "join"

    @classmethod
    def read(cls, spark: SparkSession, *, case_rules: str | None = None, rules: str | None = None, extra: str | None = None, prefixes: str | None = None, **more) -> Preparation:
        """Settings whose rules (desc, regex, replace) and prefixes (desc, regex) lie in CSV files, in their order."""
        pairs = lambda path: tuple((r["regex"], r["replace"]) for r in tables.read_rules(spark, path)) if path else ()
        return cls(pairs(case_rules), pairs(rules), pairs(extra), tables.read_prefixes(spark, prefixes) if prefixes else (), **more)


#: The detectors' settings of the final run.
PRESETS = {
    "seed": {"word_size": 7, "e_value": 0.005, "min_length": 15, "max_length": 100_000},
    "gram": {"n": 9, "min_align": 20, "min_match": 2, "max_df": 100, "floating": True, "beam": 25, "pcopy": 0.8, "all_pairs": True},
    "window": {"ngram": 3, "gap": 3, "window": 5, "in_docs": 3, "in_window": 3, "max_gap": 2, "minimum": 3},
}


def whole_tokens(rows: DataFrame) -> DataFrame:
    """V2 on cleaned rows: (docid, word) of white-space tokens without markers; broken tokens (#lb#, =) do not count."""
    bare = F.regexp_replace("text", "#SEND#|#CSTART#|#INSTART#|#INEND#", " ")
    words = F.filter(F.split(bare, r"(?U)\s+"), lambda w: (w != "") & ~F.contains(w, F.lit("#lb#")) & ~F.contains(w, F.lit("=")))
    return rows.select(F.col("corpus").alias("docid"), F.explode(words).alias("word"))


def clean_corpus(rows: DataFrame, how: Preparation = Preparation()) -> tuple[DataFrame, DataFrame]:
    """(cleaned rows, vocabulary(word, docid, freq)).

    Three phases, each over all corpora: clean, counting whole tokens; join words
    broken at line ends and separated prefixes; join words broken at page ends.
    Joins decide, on normalised forms, against the vocabulary of the first phase;
    with how.in_order the second phase goes row by row, every decision changing the
    vocabulary. Empty rows go.
    """
    cleaned = written(clean.clean_rows(rows, case_rules=how.case_rules, rules=how.rules, extra=how.extra, lowercase=how.lowercase), "cleaned")
    words = written(whole_tokens(cleaned).groupBy("word", "docid").agg(F.count("*").alias("freq")), "vocabulary")
    if not how.join:
        return cleaned, words
    freqs, rules = written(vocab.totals(words), "frequencies"), (how.case_rules, how.rules)
    if how.in_order:
        joined, changes = vocab.join_in_order(cleaned, freqs, prefixes=list(how.prefixes), rules=rules)
        changed = changes.select("word", F.col("corpus").alias("docid"), F.col("n").alias("freq"))
        words = words.withColumn("docid", F.col("docid").cast("string")).unionByName(changed).groupBy("word", "docid").agg(F.sum("freq").alias("freq")).where("freq > 0")
        words = written(words, "vocabulary")
        freqs = written(vocab.totals(words), "frequencies")
    else:
        joined = vocab.join_line_ends(cleaned, freqs, rules)
        if how.prefixes:
            joined = vocab.join_prefixes(joined, freqs, list(how.prefixes), rules)
    return vocab.join_page_breaks(written(joined, "joined"), freqs, rules).where(F.trim("text") != ""), words


def representations(rows: DataFrame, how: Preparation = Preparation()) -> dict[str, DataFrame]:
    """One corpus collection as full texts, sentences and word n-grams, each (docid, corpus, text, ...)."""
    plain = rows.withColumn("text", clean.plain(F.col("text")))
    full = segment.full_text(plain).select(F.col("corpus").alias("docid"), "corpus", "text")
    named = rows.withColumn("corpus", F.col("corpus").cast("string"))
    sent = segment.nested_sentences(named, how.min_words) if how.insertion == "join" else segment.sentences(named, how.min_words, how.insertion)
    sent = sent.withColumn("text", clean.plain(F.col("text"))).withColumn("docid", F.concat_ws("-", "corpus", "bookpart", "paragraph", F.col("seg_idx").cast("string")))
    grams = segment.ngrams_across(plain, how.ngram).withColumn("docid", F.concat_ws("-", "corpus", "bookpart", "paragraph", F.col("row_idx").cast("string"), F.col("pos").cast("string")))
    return {"full": full, "sentences": sent, "ngrams": grams.withColumnRenamed("gram", "text")}


def prepare(rows: DataFrame, how: Preparation = Preparation(), models: dict[str, DataFrame] | None = None) -> dict[tuple[str, str], DataFrame]:
    """(variant, representation) -> texts. Variants: unnorm, norm, and each of the lemma models over either.

    models: name -> lemma map(form, lemma), all applied in one pass with the model
    as a column; a variant is named like norm-lem.
    """
    bare = Preparation(prefixes=how.prefixes, lowercase=how.lowercase, min_words=how.min_words, ngram=how.ngram, insertion=how.insertion)
    variants = {"unnorm": clean_corpus(rows, bare)[0], "norm": clean_corpus(rows, how)[0]}
    variants = {k: written(v, k) for k, v in variants.items()}
    for base in list(variants):
        for name, lemmas in (models or {}).items():
            variants[f"{base}-{name}"] = written(lemmatised(variants[base], lemmas), "lemmatised")
    return {(v, r): df for v, rows_ in variants.items() for r, df in representations(rows_, how).items()}


def lemmatised(rows: DataFrame, lemmas: DataFrame) -> DataFrame:
    """Rows whose words are replaced by their lemmas."""
    keys = [c for c in rows.columns if c != "text"]
    return wordgraph.lemmatise(rows, lemmas, keys)


def train_models(nodes: DataFrame, edges: DataFrame, phonetic, external: DataFrame | None = None, folder: str | None = None, algo: str = "louvain") -> dict[str, DataFrame]:
    """Lemma maps lem (base), lem-ft (short words scored again) and, with external(form, lemma), lem-ren.

    With a folder the rounds of the base communities are saved there one by one, and a
    later call goes on after the last of them instead of training again.
    """
    nodes, edges = written(nodes, "nodes"), written(edges, "edges")
    members = written(wordgraph.dense_communities(nodes, edges, algo, folder=folder), "members")
    how = {"gap_start": 1.0, "gap_more": 1.0, "disfavour": 1}
    kept, short, links = wordgraph.fine_tune(members, nodes, edges, phonetic, **how)
    kept, short = written(kept, "kept"), written(short, "short")
    base = wordgraph.word_groups(members, nodes, edges)
    tuned = wordgraph.word_groups(kept, nodes, edges).unionByName(wordgraph.word_groups(short, nodes, links, phonetic, phonetic=True, **how))
    out = {}
    for name, own, coms in (("lem", members, base), ("lem-ft", kept.unionByName(short), tuned)):
        coms = written(coms, "groups")
        chosen = own.join(coms.where("selected").select("com_id"), "com_id", "left_semi")
        out[name] = written(wordgraph.assign_lemmas(nodes, chosen, coms.select("com_id", "lemma")), name)
    if external is not None:
        groups = chosen.join(nodes, "id").select(F.col("com_id").alias("group_id"), "form")
        merged = wordgraph.merge_groups(groups, coms.select(F.col("com_id").alias("group_id"), "n", "lemma", "meansim"), external)
        renamed = groups.join(merged.select(F.explode("groups").alias("group_id"), F.col("representative").alias("lemma")), "group_id").select("form", "lemma")
        lone = wordgraph.join_lone_words(nodes.join(chosen.select("id"), "id", "left_anti").select("form"), external)
        new = renamed.union(lone).toDF("form", "new")
        out["lem-ren"] = written(out["lem-ft"].join(new, "form", "left").select("form", F.coalesce("new", "lemma").alias("lemma")), "lem-ren")
    return out


def prepare_gold(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents without markers, gold passages(match_id, docid, start, end)) of annotated rows(docid, row_idx, text)."""
    gold = matches.gold_matches(matches.parse_segments(rows)).select("match_id", "docid", "start", "end")
    return rows.withColumn("text", F.regexp_replace("text", r"\$seg(start|end)_[^$]*\$", "")), gold


def detect_passages(tool: str, docs: DataFrame, source: str | None = None, **params) -> DataFrame:
    """One detector over docs(series, docid, text): passages(cluster, docid, start, end) in characters, ends inclusive, as gold has them."""
    if tool == "seed":
        return detect.seed_and_extend(docs, **params)
    if tool == "gram":
        return detect.gram_alignment(docs, **params)
    if tool != "window":
        raise ValueError(f"unknown detector {tool}")
    first = source or docs.agg(F.min("series")).first()[0]
    return detect.cluster_passages(detect.window_alignment(docs, first, **params, tell_banal=False).drop("hits"))


@dataclass
class Runs:
    """Finished runs: runs(run_no, tool, input, config, time, testmatch_no, goldmatch_no) and passages(run_no, match_id, docid, start, end)."""

    runs: DataFrame
    passages: DataFrame
    configs: list[tuple[str, str, dict]] = field(default_factory=list)


def evaluate_runs(inputs: dict[str, DataFrame], gold: DataFrame, grid: list[tuple[str, dict]], at_once: int = 4) -> Runs:
    """Every (detector, parameters) of the grid over every named input; each run writes its passages.

    Runs are jobs of one session, `at_once` of them together; their passages lie in
    one table, so that scoring reads all runs in one plan whatever their number.
    An input is cut into tokens once for all window runs of one form of its tokens;
    it may be tokenised already, for window runs of that form. Times are without that.
    """
    spark = gold.sparkSession
    path, jobs = fresh_path(spark, "runs"), [(tool, name, params) for name in inputs for tool, params in grid]
    form = lambda tool, name, params: (name, params.get("stem", True), params.get("fold_numbers", True)) if tool == "window" and "t" not in inputs[name].columns else None
    cut = {key: detect.tokenised(inputs[key[0]], *key[1:]) for key in dict.fromkeys(form(*job) for job in jobs) if key}

    def run(no: int) -> float:
        tool, name, params = jobs[no]
        began = time.time()
        found = detect_passages(tool, cut.get(form(tool, name, params), inputs[name]), **params).withColumnRenamed("cluster", "match_id")
        found.select(F.col("match_id").cast("string").alias("match_id"), F.col("docid").cast("string").alias("docid"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end")).write.parquet(f"{path}/run_no={no}")
        return time.time() - began

    with ThreadPoolExecutor(at_once) as pool:
        took = list(pool.map(run, range(len(jobs))))
    return _finished(gold, path, jobs, took)


#: How the output of a detector that ran elsewhere is read, by detector.
READERS = {"seed": tables.read_clusters, "gram": tables.read_passages, "window": tables.read_alignments}


def read_runs(gold: DataFrame, outputs: list[tuple[str, str, str]], **options) -> Runs:
    """Finished runs from the outputs (detector, input, path) of detectors that ran elsewhere, each in its own format.

    score_runs gives their scores; options go to every reader that knows them.
    """
    spark = gold.sparkSession
    path = fresh_path(spark, "outputs")
    for no, (tool, _, output) in enumerate(outputs):
        known = {k: v for k, v in options.items() if k in READERS[tool].__code__.co_varnames}
        READERS[tool](spark, output, **known).withColumnRenamed("cluster", "match_id").write.parquet(f"{path}/run_no={no}")
    return _finished(gold, path, [(tool, name, {}) for tool, name, _ in outputs], [0.0] * len(outputs))


def _finished(gold: DataFrame, path: str, jobs: list[tuple[str, str, dict]], took: list[float]) -> Runs:
    """Runs whose passages lie below path by run_no, with the counts of their matches and of the gold matches they found."""
    spark = gold.sparkSession
    passages = spark.read.schema("match_id string, docid string, start long, end long, run_no int").parquet(path)
    info = spark.createDataFrame([(no, tool, name, {k: str(v) for k, v in params.items()}, took[no]) for no, (tool, name, params) in enumerate(jobs)], "run_no int, tool string, input string, config map<string,string>, time double")
    tests = passages.groupBy("run_no").agg(F.count_distinct("match_id").alias("testmatch_no"))
    golds = _pairs(gold, passages).select("run_no", "g").distinct().groupBy("run_no").agg(F.count("*").alias("goldmatch_no"))
    runs = info.join(tests, "run_no", "left").join(golds, "run_no", "left").fillna(0, ["testmatch_no", "goldmatch_no"])
    return Runs(written(runs, "runs"), passages, jobs)


def _named(gold: DataFrame) -> DataFrame:
    """A gold set whose names are strings, as those of runs are."""
    return gold.select(F.col("match_id").cast("string").alias("match_id"), F.col("docid").cast("string").alias("docid"), "start", "end")


def _pairs(gold: DataFrame, test: DataFrame) -> DataFrame:
    """E6 by run: (run_no, g, t)."""
    return matches.identical(_named(gold), test, ("run_no",))


def score_runs(gold: DataFrame, done: Runs) -> DataFrame:
    """A row a run: tool, input, config, seg, norm, lem, time, counts, and recall, precision, F of three levels.

    One plan for all runs. norm is 1 where the input's name begins with norm; lem
    is 1, 2 or 3 where it ends with lem, lem-ft or lem-ren; seg is what follows the slash.
    """
    named = _named(gold)
    pairs, of_gold, of_test = matches.found(named, done.passages, ("run_no",))
    sizes = gold.agg(F.count_distinct("match_id")).first()[0]
    m = pairs.groupBy("run_no").agg(F.count_distinct("g").alias("g"), F.count_distinct("t").alias("t"))
    out = done.runs.join(m, "run_no", "left").fillna(0, ["g", "t"])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumn("r_m", ratio(F.col("g"), F.lit(sizes))).withColumn("p_m", ratio(F.col("t"), F.col("testmatch_no"))).drop("g", "t")

    def characters(hit: DataFrame) -> DataFrame:
        """Characters of the passages of one side that the other covers, over all of them."""
        return matches.covered(hit, ("run_no",)).groupBy("run_no").agg((F.sum("covered") / F.sum(F.col("e") - F.col("s") + 1)).alias("x"))

    def clusters(side: DataFrame, hit: DataFrame, key: str) -> DataFrame:
        n = hit.select("run_no", "docid", "s", "e").distinct().groupBy("run_no").agg(F.count("*").alias("n"))
        every = pairs.select("run_no", F.col(key).alias("match_id")).distinct().join(side, [c for c in ("run_no", "match_id") if c in side.columns])
        return n.join(every.groupBy("run_no").agg(F.count("*").alias("k")), "run_no").select("run_no", (F.col("n") / F.col("k")).alias("x"))

    for name, df in (("r_ch", characters(of_gold)), ("p_ch", characters(of_test)), ("r_cl", clusters(named, of_gold, "g")), ("p_cl", clusters(done.passages, of_test, "t"))):
        out = out.join(df.withColumnRenamed("x", name), "run_no", "left").fillna(0.0, [name])
    for level in ("m", "ch", "cl"):
        r, p = F.col(f"r_{level}"), F.col(f"p_{level}")
        out = out.withColumn(f"f_{level}", F.round(F.when(r + p > 0, 2 * r * p / (r + p)).otherwise(0.0), 6)).withColumn(f"r_{level}", F.round(r, 6)).withColumn(f"p_{level}", F.round(p, 6))
    base, seg = F.split("input", "/")[0], F.get(F.split("input", "/"), F.lit(1))
    lem = F.when(base.endswith("lem"), 1).when(base.endswith("lem-ft"), 2).when(base.endswith("lem-ren"), 3).otherwise(0)
    return out.withColumn("seg", seg).withColumn("norm", base.startswith("norm").cast("int")).withColumn("lem", lem)


def run_best(inputs: dict[str, DataFrame], gold: DataFrame, corpora: dict[str, DataFrame], tool: str, params: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(scores of the grid on the gold inputs, passages of the best setting over the whole corpus of its input)."""
    done = evaluate_runs(inputs, gold, [(tool, p) for p in params])
    best = matches.best_run(done.runs).first()
    _, name, setting = done.configs[best["run_no"]]
    return score_runs(gold, done), detect_passages(tool, corpora[name], **setting)


def final_run(corpora: dict[str, DataFrame], presets: dict[str, dict] | None = None) -> DataFrame:
    """Each detector with its preset over its corpus: passages(tool, cluster, docid, start, end)."""
    out = None
    for tool, params in (presets or PRESETS).items():
        if tool in corpora:
            found = detect_passages(tool, corpora[tool], **params).select(F.lit(tool).alias("tool"), "cluster", "docid", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
            out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no corpus for any detector")
    return out
