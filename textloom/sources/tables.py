"""Sources and sinks (S1-S12): located rows, rules, JSON, text, clusters, models.

All readers return DataFrames with explicit schemas; files are read by Spark,
so any store Spark knows works. CSV cells stay strings, as in the data model.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE = "text string, bookpart string, paragraph string, page int, fol string, gathering string"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all nodes share: spark.checkpoint.dir. Only in local mode a temporary one stands in for it."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        known = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session ends."""
    path = f"{shared_folder(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session has ended; the folder is left to its owner
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Most bytes of one Arrow batch on its way to Python; a longer row stands alone.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bytes of an Arrow batch to BATCH_BYTES, so that long texts do not fill a worker; never raise them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Deal out an input that is read by fewer tasks than there are cores (one small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def read_lz4_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines in LZ4 frames (not Hadoop's block format), one file a row of the scan, decoded in pieces."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def lines(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with pa.CompressedInputStream(pa.BufferReader(content), "lz4") as stream:
                    rest = b""
                    while piece := stream.read(1 << 20):
                        *whole, rest = (rest + piece).split(b"\n")
                        if whole:
                            yield pa.RecordBatch.from_arrays([pa.array([x.decode() for x in whole], pa.string())], ["value"])
                    if rest:
                        yield pa.RecordBatch.from_arrays([pa.array([rest.decode()])], ["value"])

    got = files.mapInArrow(lines, "value string").where("value <> ''")
    return got.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_csv(spark: SparkSession, path: str, header: bool = True, delimiter: str = ",", schema: str | None = None) -> DataFrame:
    """S3: quoted, possibly multi-line CSV; columns are strings unless a schema is given."""
    reader = spark.read.options(header=header, multiLine=True, escape='"', sep=delimiter)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_csv(df: DataFrame, path: str, header: bool = True, delimiter: str = ",") -> None:
    """S2."""
    df.write.options(header=header, sep=delimiter, escape='"').csv(path)


def read_rules(spark: SparkSession, path: str) -> list[dict[str, str]]:
    """An ordered rule table (desc, regex, replace); rules are few and driver-side."""
    text = spark.read.text(path, wholetext=True).first()[0]
    import csv
    import io

    return [dict(row) for row in csv.DictReader(io.StringIO(text))]


def read_prefixes(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The prefix words (as regexes) of a table (desc, regex) whose regexes also hold the word that follows."""
    return tuple(r["regex"].removeprefix(r"(?<!\w)").removesuffix(r"\w+").removesuffix(r"\s").removesuffix(" ") for r in read_rules(spark, path))


def read_scoring(spark: SparkSession, path: str) -> tuple[dict[float, list[str]], dict[float, str]]:
    """(scores of letter pairs, scores of all pairs of a group of letters) of a scoring file, as similarity.matrix takes them."""
    import json

    spec = json.loads(spark.read.text(path, wholetext=True).first()[0])
    spec = spec.get("scoring", spec)
    return {float(k): ["".join(p) for p in pairs] for k, pairs in spec["pairscores"].items()}, {float(k): "".join(letters) for k, letters in spec.get("doublescores", {}).items()}


def read_json(spark: SparkSession, path: str, schema: str | None = None, lines: bool = False) -> DataFrame:
    """S5 (one document) and S7 (JSON lines)."""
    reader = spark.read.option("multiLine", not lines)
    return (reader.schema(schema) if schema else reader).json(path)


def write_json(df: DataFrame, path: str, compression: str = "none") -> None:
    """S5 and S8 (compression='gzip')."""
    df.write.option("compression", compression).json(path)


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, stripped, with its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")).alias("text"))


def write_text(df: DataFrame, path: str, append: bool = False) -> None:
    """The single column of df, one line a row."""
    df.write.mode("append" if append else "errorifexists").text(path)


def read_edges(spark: SparkSession, path: str, nodes: DataFrame) -> DataFrame:
    """A similarity table (w1, w2, sim, normsim, ...) as edges(src, dst, weight) over nodes(id, form)."""
    rows = read_csv(spark, path, header=False, schema="w1 string, w2 string, sim double, normsim double, alignx string, aligny string")
    a, b = (nodes.select(F.col("id").alias(i), F.col("form").alias(w)) for i, w in (("i", "w1"), ("j", "w2")))
    return rows.where("w1 <> w2 and normsim > 0").join(a, "w1").join(b, "w2").select(F.least("i", "j").alias("src"), F.greatest("i", "j").alias("dst"), F.col("normsim").alias("weight"))


def save_model(path: str, **tables: DataFrame) -> None:
    """Nodes, edges, communities, lemma map ... each as Parquet below path."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """Files with a map of clusters with hits, as passages (cluster, docid, start, end); info.json is none of them.

    A cluster is known by its file and key: the files of a run may use the same keys.
    """
    hits = T.StructType().add("hits", T.ArrayType(T.StructType().add("title", "string").add("doc_id", "string").add("original_indices", T.ArrayType(T.LongType()))))
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value").where("file <> 'info.json'")
    each = raw.select("file", F.explode(F.from_json("value", T.MapType(T.StringType(), hits))).alias("key", "c")).select(F.concat_ws("/", "file", "key").alias("cluster"), F.explode("c.hits").alias("h"))
    return each.select("cluster", F.col("h.doc_id").alias("docid"), F.col("h.original_indices")[0].alias("start"), F.col("h.original_indices")[1].alias("end"))


def read_passages(spark: SparkSession, path: str, grouped: bool = False) -> DataFrame:
    """JSON lines of passages (cluster, id, begin, end), or a document of their clusters, as passages (cluster, docid, start, end)."""
    if grouped:
        rows = spark.read.schema("clusters array<struct<cid:string,matches:array<struct<id:string,begin:long,end:long>>>>").json(path, multiLine=True)
        rows = rows.select(F.explode("clusters").alias("c")).select(F.col("c.cid").alias("cluster"), F.explode("c.matches").alias("m")).select("cluster", "m.*")
    else:
        rows = spark.read.schema("cluster string, id string, begin long, end long").json(path)
    return rows.select("cluster", F.col("id").alias("docid"), F.col("begin").alias("start"), "end")


def read_alignments(spark: SparkSession, path: str, by_passage: bool = False) -> DataFrame:
    """JSON lines of source/target passages, as passages (cluster, docid, start, end).

    A document goes by the name of its file without the ending of four characters.
    by_passage: the end is the start and the length of the passage, not the end byte.
    Equal lines are one cluster.
    """
    fields = ("filename string", "start_byte long", "end_byte long", "passage string")
    rows = spark.read.schema(", ".join(f"{s}_{f}" for s in ("source", "target") for f in fields)).json(path)
    rows = rows.withColumn("cluster", F.xxhash64(*rows.columns).cast("string"))
    name = lambda c: F.expr(f"left(element_at(split({c}, '/'), -1), length(element_at(split({c}, '/'), -1)) - 4)")
    end = lambda s: F.col(f"{s}_start_byte") + F.length(f"{s}_passage") if by_passage else F.col(f"{s}_end_byte")
    sides = [F.struct(name(f"{s}_filename").alias("docid"), F.col(f"{s}_start_byte").alias("start"), end(s).alias("end")) for s in ("source", "target")]
    return rows.dropDuplicates(["cluster"]).select("cluster", F.explode(F.array(*sides)).alias("p")).select("cluster", "p.*")
