"""Reports (R1-R4) over score rows, and tool formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segment_means(scores: DataFrame, score: str) -> DataFrame:
    """Mean score by segmentation, normalisation and lemmatisation, four digits."""
    return scores.groupBy("seg", "norm", "lem").agg(F.round(F.avg(score), 4).alias("mean"))


def segment_means_wide(scores: DataFrame, score: str, segs: list[str]) -> DataFrame:
    """R1 as plotted: one column a segmentation, 0 for empty groups."""
    return scores.groupBy("norm", "lem").pivot("seg", segs).agg(F.round(F.avg(score), 4)).na.fill(0.0)


def detection_rate(found: DataFrame, runs: DataFrame) -> DataFrame:
    """R2: per cent of a tool's runs(tool, run_no) that found each gold match, from found(tool, run_no, goldmatch)."""
    n = runs.groupBy("tool").agg(F.count_distinct("run_no").alias("n"))
    hits = found.groupBy("tool", "goldmatch").agg(F.count_distinct("run_no").alias("k"))
    return hits.join(n, "tool").select("tool", "goldmatch", F.round(100.0 * F.col("k") / F.col("n"), 1).alias("rate"))


def highscores(scores: DataFrame, kind: str, n: int) -> DataFrame:
    """The n best by F, R, P of a level (m, ch, cl), or by the means over the levels (av); run_no breaks ties."""
    if kind == "av":
        mean = lambda c: (F.col(f"{c}_m") + F.col(f"{c}_ch") + F.col(f"{c}_cl")) / 3
        return scores.orderBy(F.desc(mean("f")), F.desc(mean("r")), F.desc(mean("p")), "run_no").limit(n)
    return scores.orderBy(F.desc(f"f_{kind}"), F.desc(f"r_{kind}"), F.desc(f"p_{kind}"), "run_no").limit(n)


def highest_recall(scores: DataFrame) -> DataFrame:
    """The run of best recall of each tool, precision next."""
    order = Window.partitionBy("tool").orderBy(F.desc("r_m"), F.desc("p_m"), "run_no")
    return scores.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def text_ids(rows: DataFrame, name: str, *location: str, row: str) -> DataFrame:
    """textid of name, location and row number."""
    return rows.withColumn("textid", F.concat_ws("-", name, *location, F.col(row).cast("string")))


def seed_input(rows: DataFrame) -> DataFrame:
    """JSON documents title, doc_id, text."""
    return rows.select(F.to_json(F.struct(F.split("textid", "_")[0].alias("title"), F.col("textid").alias("doc_id"), "text")).alias("value"))


def gram_input(rows: DataFrame) -> DataFrame:
    """JSON documents id, series, text."""
    return rows.select(F.to_json(F.struct(F.col("textid").alias("id"), F.split("textid", "_")[0].alias("series"), "text")).alias("value"))


def source_target(rows: DataFrame, source: str) -> DataFrame:
    """documents of the source corpus and the rest, with the metadata columns."""
    return rows.withColumn("side", F.when(F.col("corpus") == source, "source").otherwise("target"))


def filter_clusters(hits: DataFrame) -> DataFrame:
    """hits(cluster, title, ...) of clusters over more than one title prefix."""
    wide = hits.groupBy("cluster").agg(F.count_distinct(F.split("title", "_")[0]).alias("k")).where("k > 1")
    return hits.join(wide.select("cluster"), "cluster", "left_semi")


def regroup(passages: DataFrame) -> DataFrame:
    """passages of each cluster as one sorted array."""
    rest = [c for c in passages.columns if c != "cluster"]
    return passages.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("matches"))
