"""Corpus preparation: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import bpe, contracts, mixing, near_dedup, quality, sanitise
from textloom.llm.shared import few, keyed, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key of its own for each row (_row): the id where it is unique, a written row number elsewhere."""
    return keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *COLUMNS[1:]))[0].withColumnRenamed("key", "_row")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts, each row by its own text, unchanged.

    Null and empty texts are judged by zero statistics. Rows without an id teach
    nothing and are judged; repeated rows and rows of one id are judged each, so
    equal texts stay or go together. Without labels all documents stay. An empty
    table gives an empty one; columns beyond those of documents are left out.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = _keyed(docs)
    good = quality.score(rows, labels, row_col="_row").where("predicted = 1").select("_row")
    return rows.join(few(written(good, "good")), "_row", "left_semi").select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more.

    Every row is a document of its own, whatever its id: rows of one id stay if
    their texts differ, of repeated rows one stays. The smallest id of a group
    stays, null ids last (ties: the first row). Null, empty and wordless texts are
    near duplicates of nothing and stay. An empty table gives an empty one;
    columns beyond those of documents are left out.
    """
    rows = _keyed(docs)
    groups = near_dedup.near_duplicates(rows.select("_row", "text"), k=5, per_cent=80, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id")
    groups = groups.join(rows.select("_row", "doc_id"), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row"))
    kept = groups.groupBy("component_id").agg(first.alias("m")).select(F.col("m._row").alias("_row"))
    return rows.join(few(written(kept, "kept")), "_row", "left_semi").select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced and the terms that disclose it generalised or removed.

    Every row comes out once with its own text, also where ids are null or repeat;
    n_chars follows a text that changes. Texts without anything to hide, null and
    empty ones among them, stay as they are. An empty table gives an empty one;
    columns beyond those of documents are left out.
    """
    rows = _keyed(docs)
    clean = sanitise.sanitise(rows.select("_row", "text"), id_col="_row").where(F.size("spans") > 0).select(F.col("doc_id").alias("_row"), "sanitised")
    clean = written(clean, "clean")  # only the texts that change
    changed = rows.join(clean, "_row").withColumn("text", F.col("sanitised")).drop("sanitised")
    changed = changed.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)
    return rows.join(few(clean.select("_row")), "_row", "left_anti").select(*COLUMNS).unionByName(changed)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out as the mix takes them; whole documents only, rounded at the edge of a source.

    Every row is a document of its own, also where ids are null or repeat or whole
    rows do; null sources are a source. Null, empty and wordless texts have no
    words to take and go. An empty table gives an empty one; columns beyond those
    of documents are left out.
    """
    rows = _keyed(docs)
    taken = mixing.mix(rows.select("_row", "text", "source"), id_col="_row").where("size > 0").select(F.col("doc_id").alias("_row"), F.round(F.col("taken") / F.col("size")).cast("int").alias("_copies"))
    taken = written(taken.where("_copies > 0"), "copies")
    rows = rows.join(few(taken), "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return rows.select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that the mix took, row by row; ids may be null or repeat.

    Null and empty texts have no tokens. An empty table gives an empty result.
    """
    ids = bpe.encode(docs.select("doc_id", "lang", "source", "text"), contracts._tokenizer())
    return ids.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("personal_data", hide_personal_data),
    ("mixing", mix_sources),
    ("tokens", encode_tokens),
]

#: The quality, sanitising and encoding stages cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
