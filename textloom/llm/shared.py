"""Session helpers: shared folder, written intermediate tables, input columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most rows that may be sent to every executor as join keys (two longs a row: 16 MB).
BROADCAST_ROWS = 1_000_000
#: Most bytes of one Arrow batch on its way to Python; a longer row stands alone.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all nodes see: spark.checkpoint.dir. Only in local mode a temporary one stands in for it."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        known = "file://" + tempfile.mkdtemp(prefix="textloom-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001 - the session has ended; the folder is left to its owner
        pass


def texts(docs: DataFrame, *more: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, text string and the named columns only; other columns never travel."""
    bound_batches(docs.sparkSession)
    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more))


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bytes of an Arrow batch to BATCH_BYTES, so that long texts do not fill a worker; never raise them."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """Deal out an input that is read by fewer tasks than there are cores (one small file)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def distinct_ids(df: DataFrame, column: str) -> bool:
    """Whether no value of an id column is null or repeats."""
    n, known, apart = df.agg(F.count("*"), F.count(column), F.count_distinct(column)).first()
    return n == known == apart


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """documents(doc_id, text, ...) with a long column key, unique for each row, and whether it differs from doc_id.

    The key is the id itself where ids are unique and not null; elsewhere rows are
    written with a number of their own, so that each stays a document of its own.
    """
    if distinct_ids(docs, "doc_id"):
        return docs.withColumn("key", F.col("doc_id")), False
    return written(docs.withColumn("key", F.monotonically_increasing_id()), "keyed"), True


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo."""
    return F.crc32(id_col.cast("long").cast("string").cast("binary")) % F.lit(modulus)


def sampled(rows: DataFrame, most: int, *identity: str) -> DataFrame:
    """About `most` rows at the most, chosen by a hash of the identity columns: each task hands on its share only."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(*identity, F.lit(29)), F.lit(1 << 40)) < int(most / n * (1 << 40)))


def few(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A broadcast hint behind a count; beyond BROADCAST_ROWS the plan keeps its shuffle join."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df
