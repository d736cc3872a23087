"""A pair of tables in one file a bucket each, sorted, by late materialisation.

A table lies in numbered starting files, each sorted. To rewrite it, only the key
column is read at first, with pointers (file, row). Where rows of one key and
bucket come from several files, the next columns are fetched one by one until no
two such rows tie; within a file the row number settles the rest. The narrow rows
are put in order by ranges, which cut hot keys as well. The payload is read once,
joined with its pointer, dealt out by range and put in order by a permutation,
column by column; one task a file then appends the ranges of its bucket, a row
group at a time. Starting files that hold just what a final file holds stay.

Files are written through pyarrow's file systems, so the shared folder
(spark.checkpoint.dir) is a local path that all nodes share, or one of HDFS, S3
or GCS. Tasks write under names of their own and move files into place, so that
a repeated task leaves the same files.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from textloom.llm.shared import shared_dir, written

#: Rows of a range: what one task sorts and gathers at a time.
RANGE_ROWS = 250_000
#: Rows and bytes of a row group while files are appended.
GROUP_ROWS, GROUP_BYTES = 1 << 17, 64 << 20


@dataclass(frozen=True)
class Table:
    """A table of the pair: rows, their bucket's key, and the number of the starting file of each row."""

    name: str
    rows: DataFrame
    key: str
    start: Column


def bucket_of(key: Column, buckets: int, salt: str = "line") -> Column:
    """Unsigned crc32 of salt and the decimal key, modulo."""
    return (F.crc32(F.concat(F.lit(salt), key.cast("string")).cast("binary")) % buckets).cast("long")


def _packed(out, schema: pa.Schema) -> pa.ipc.RecordBatchStreamWriter:
    """A compressed Arrow stream, for pieces on their way to a file."""
    return pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _ranges(df: DataFrame, n: int, *order: str) -> DataFrame:
    """df in order over tasks of about RANGE_ROWS rows; nulls first."""
    return df.repartitionByRange(max(1, -(-n // RANGE_ROWS)), *(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order))


def _place(fs: pafs.FileSystem, pieces: list[str], path: str, schema: pa.Schema) -> int:
    """Append Arrow pieces, in order, to one Parquet file; bounded memory. Rows written."""
    made, n, held, rows, size = f"{path}.{uuid.uuid4().hex}", 0, [], 0, 0
    with fs.open_output_stream(made) as out, pq.ParquetWriter(out, schema) as writer:
        for piece in pieces:
            with fs.open_input_stream(piece) as source, pa.ipc.open_stream(source) as reader:
                for batch in reader:
                    held.append(batch)
                    rows, size, n = rows + len(batch), size + batch.nbytes, n + len(batch)
                    if rows >= GROUP_ROWS or size >= GROUP_BYTES:
                        writer.write_table(pa.Table.from_batches(held).combine_chunks(), row_group_size=rows)
                        held, rows, size = [], 0, 0
        if held:
            writer.write_table(pa.Table.from_batches(held).combine_chunks(), row_group_size=rows)
    if fs.get_file_info(path).type != pafs.FileType.NotFound:  # of a task that is repeated
        fs.delete_file(path)
    fs.move(made, path)
    return n


def _appended(pieces: DataFrame, folder: str, stem: str, schema: pa.Schema) -> DataFrame:
    """(number, path, n) of one file for each number of pieces(number, part, piece): a task each."""

    def append(group: pa.Table) -> pa.Table:
        group = group.sort_by("part")
        fs, root = _open(folder)
        number = group["number"][0].as_py()
        name = f"{stem}-{number:05d}.parquet"
        n = _place(fs, [f"{root}/{p}" for p in group["piece"].to_pylist()], f"{root}/{name}", schema)
        return pa.table({"number": [number], "path": [f"{folder}/{name}"], "n": [n]})

    return pieces.groupBy("number").applyInArrow(append, "number long, path string, n long")


def write_start(table: Table, folder: str) -> DataFrame:
    """(number, path, n) of the starting files: one Parquet file a number, all columns in order, sorted by them, key first.

    Hot files are sorted in ranges by several tasks and appended by one. An empty
    table has no files.
    """
    columns = table.rows.columns
    names = [f"c{k}" for k in range(len(columns))]  # clash with nothing
    order = [names[columns.index(table.key)], *(n for n, c in zip(names, columns) if c != table.key)]
    rows = table.rows.select(table.start.cast("long").alias("number"), *(F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)))
    schema = _arrow_schema(table.rows)
    work = f"start-{uuid.uuid4().hex}"
    _open(folder)[0].create_dir(f"{_open(folder)[1]}/{work}")

    def cut(batches):
        fs, root = _open(folder)
        part = TaskContext.get().partitionId()
        sink = out = now = piece = None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            edges = [0, *((numbers[1:] != numbers[:-1]).nonzero()[0] + 1).tolist(), len(numbers)]
            for lo, hi in zip(edges, edges[1:]):
                if hi > lo and numbers[lo] != now:
                    if sink is not None:
                        sink.close()
                        out.close()
                        yield _piece(now, part, piece)
                    now, piece = int(numbers[lo]), f"{work}/{part}-{numbers[lo]}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(f"{root}/{piece}")
                    sink = _packed(out, schema)
                if hi > lo:
                    sink.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.slice(lo, hi - lo).columns[1:], schema)], schema=schema))
        if sink is not None:
            sink.close()
            out.close()
            yield _piece(now, part, piece)

    pieces = written(_ranges(rows, rows.count(), "number", *order).mapInArrow(cut, "number long, part long, piece string"), "pieces")
    files = written(_appended(pieces, folder, "start", schema), "start-files")
    fs, root = _open(folder)
    fs.delete_dir(f"{root}/{work}")
    return files


def _piece(number: int, part: int, piece: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"number": pa.array([number], pa.int64()), "part": pa.array([part], pa.int64()), "piece": [piece]})


def _arrow_schema(df: DataFrame) -> pa.Schema:
    fields = to_arrow_schema(df.schema)
    return pa.schema([pa.field(f.name, pa.timestamp("us") if pa.types.is_timestamp(f.type) and f.type.tz is None else f.type, True) for f in fields])


def _scan(table: Table, folder: str, *columns: str) -> DataFrame:
    """Columns of the starting files (as c0, c1, ...) with their pointers (s, r)."""
    spark, known = table.rows.sparkSession, table.rows.columns
    files = spark.read.schema(table.rows.schema).option("pathGlobFilter", "start-*.parquet").parquet(folder)
    s = F.regexp_extract(F.col("_metadata.file_name"), r"start-(\d+)\.parquet", 1).cast("long")
    return files.select(*(F.col(f"`{c}`").alias(f"c{known.index(c)}") for c in columns), s.alias("s"), F.col("_metadata.row_index").alias("r"))


def _tie_columns(table: Table, folder: str) -> list[str]:
    """The leading columns after which no rows of different starting files tie (all, if equal rows lie in several)."""
    order = [table.key, *(c for c in table.rows.columns if c != table.key)]
    for k in range(1, len(order)):
        names = [f"c{table.rows.columns.index(c)}" for c in order[:k]]
        groups = _scan(table, folder, *order[:k]).groupBy(*names).agg(F.min("s").alias("a"), F.max("s").alias("b"))
        if groups.where("a < b").limit(1).count() == 0:
            return order[:k]
    return order


def rewrite(table: Table, starts: DataFrame, folder: str, bucket: Column | tuple[Column, DataFrame]) -> DataFrame:
    """Final files of a table whose starting files lie in folder: (bucket, path, columns, n_rows, ids_sha256, lineage_sha256, rewritten).

    bucket is a column over key (the key as it is), or that with a table (key,
    bucket) of the keys that it overrides. A starting file with exactly the rows
    of a bucket stays; every other bucket is written as bucket-NNNNN.parquet, and
    every other file in folder goes.
    """
    column, overrides = bucket if isinstance(bucket, tuple) else (bucket, None)
    ties = _tie_columns(table, folder)
    names = [f"c{table.rows.columns.index(c)}" for c in ties]
    keys = _scan(table, folder, *ties).withColumn("key", F.col(names[0]))
    if overrides is not None:  # hot keys are split by the skew join
        keys = keys.join(overrides.select("key", F.col("bucket").alias("other")).hint("merge"), "key", "left").withColumn("bucket", F.coalesce("other", column)).drop("other")
    else:
        keys = keys.withColumn("bucket", column)
    pointers = written(keys.select("bucket", *names, "s", "r"), "pointers")

    lineage = written(pointers.groupBy("bucket", "s").agg(F.count("*").alias("n")), "lineage")  # at most buckets x starting files
    told = lineage.groupBy("bucket").agg(F.sum("n").alias("n_rows"), F.count("*").alias("files"), F.min("s").alias("s"), F.array_sort(F.collect_list(F.struct("s", "n"))).alias("from"))
    told = told.withColumn("lineage_sha256", F.sha2(F.array_join(F.transform("from", lambda x: F.concat(x["s"].cast("string"), F.lit(":"), x["n"].cast("string"))), ",").cast("binary"), 256))
    told = told.join(starts.select(F.col("number").alias("s"), F.col("path").alias("start"), F.col("n").alias("whole")), "s", "left")
    told = written(told.select("bucket", "n_rows", "lineage_sha256", "start", "s", ((F.col("files") == 1) & (F.col("n_rows") == F.col("whole"))).alias("stays")), "told")

    moving = pointers.join(F.broadcast(told.where("not stays").select("bucket")), "bucket", "left_semi")  # one row a bucket
    n = told.where("not stays").agg(F.sum("n_rows")).first()[0] or 0
    ordered = _ranges(moving, n, "bucket", *names, "s", "r")
    place = written(ordered.select("bucket", F.spark_partition_id().cast("long").alias("part"), F.monotonically_increasing_id().alias("place"), "s", "r"), "places")
    columns = table.rows.columns
    payload = _scan(table, folder, *columns).join(place.hint("shuffle_hash"), ["s", "r"])
    schema, work = _arrow_schema(table.rows), f"final-{uuid.uuid4().hex}"
    fs, root = _open(folder)
    fs.create_dir(f"{root}/{work}")

    def gather(group: pa.Table) -> pa.Table:
        fs, root = _open(folder)
        number, part = group["bucket"][0].as_py(), group["part"][0].as_py()
        perm = pc.sort_indices(group["place"])
        piece = f"{work}/{part}-{number}-{uuid.uuid4().hex}"
        made = [group[f"c{k}"].take(perm).cast(f.type) for k, f in enumerate(schema)]  # column by column
        with fs.open_output_stream(f"{root}/{piece}") as out, _packed(out, schema) as sink:
            sink.write_table(pa.table(made, schema=schema), max_chunksize=1 << 16)
        return pa.table({"number": [number], "part": [part], "piece": [piece]})

    pieces = written(payload.select("bucket", "part", "place", *(f"c{k}" for k in range(len(columns)))).groupBy("bucket", "part").applyInArrow(gather, "number long, part long, piece string"), "pieces")
    made = written(_appended(pieces, folder, "bucket", schema), "final-files")
    final = told.join(made.select(F.col("number").alias("bucket"), F.col("path").alias("made")), "bucket", "left")
    final = written(final.select("bucket", F.coalesce("made", "start").alias("path"), "lineage_sha256", F.col("made").isNotNull().alias("rewritten")), "final")
    _tidy(folder, [r.path for r in final.select("path").collect()])  # names of the final files, one a bucket
    return final.join(_read_back(final.select("path"), folder, table.key), "path")


def _tidy(folder: str, keep: list[str]) -> None:
    """Only the named files remain in folder."""
    fs, root = _open(folder)
    kept = {p.rpartition("/")[2] for p in keep}
    for info in fs.get_file_info(pafs.FileSelector(root)):
        if info.type == pafs.FileType.Directory:
            fs.delete_dir(info.path)
        elif info.base_name not in kept:
            fs.delete_file(info.path)


def _read_back(files: DataFrame, folder: str, key: str) -> DataFrame:
    """(path, columns, n_rows, ids_sha256) as the files say: only the key column is read, a row group at a time."""

    def read(batches):
        fs, root = _open(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                told, n = hashlib.sha256(), 0
                with fs.open_input_file(f"{root}/{path.rpartition('/')[2]}") as source:
                    file = pq.ParquetFile(source)
                    for ids in file.iter_batches(batch_size=1 << 16, columns=[key]):
                        told.update((b"," if n else b"") + ",".join(ids.column(0).cast(pa.string()).fill_null("").to_pylist()).encode())
                        n += len(ids)
                    names = ",".join(file.schema_arrow.names)
                yield pa.RecordBatch.from_pydict({"path": [path], "columns": [names], "n_rows": pa.array([n], pa.int64()), "ids_sha256": [told.hexdigest()]})

    return files.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "path").mapInArrow(read, "path string, columns string, n_rows long, ids_sha256 string")


def co_bucket(left: Table, right: Table, *, buckets: int = 300, salt: str = "line", folder: str | None = None) -> DataFrame:
    """Write both tables in starting files and rewrite them into one file a table and bucket; a row for each final file.

    left's rows go to the bucket of their key; right's too, but keys that left
    lacks go to bucket `buckets`, null keys of either table to buckets + 1. Files
    lie in <folder>/<table name>; without a folder a new one under
    spark.checkpoint.dir is taken. n_joined counts the inner join of a bucket.
    Repeated keys and rows, nulls in any column and empty tables are whole: every
    row is in one final file, nulls sort first, NaN last, -0.0 with 0.0.
    """
    spark: SparkSession = left.rows.sparkSession
    folder = folder or f"{shared_dir(spark)}/textloom/cobucket-{uuid.uuid4().hex}"
    where = {t.name: f"{folder}/{t.name}" for t in (left, right)}
    for path in where.values():
        fs, root = _open(path)
        fs.create_dir(root, recursive=True)
    starts = {t.name: write_start(t, where[t.name]) for t in (left, right)}
    own = F.when(F.col("key").isNull(), F.lit(buckets + 1)).otherwise(bucket_of(F.col("key"), buckets, salt)).cast("long")
    counts = lambda t, n: _scan(t, where[t.name], t.key).toDF("key", "s", "r").where("key is not null").groupBy("key").agg(F.count("*").alias(n))
    both = written(counts(right, "n_right").join(counts(left, "n_left").hint("merge"), "key", "left"), "keys")
    lone = both.where("n_left is null").select("key", F.lit(buckets).cast("long").alias("bucket"))
    joined = both.where("n_left is not null").groupBy(own.alias("bucket")).agg(F.sum(F.col("n_left") * F.col("n_right")).alias("n_joined"))
    out = None
    for table, bucket in ((left, own), (right, (own, lone))):
        files = rewrite(table, starts[table.name], where[table.name], bucket).withColumn("table_name", F.lit(table.name))
        out = files if out is None else out.unionByName(files)
    out = out.join(F.broadcast(joined), "bucket", "left")  # one row a bucket
    return out.select("table_name", "path", "columns", "ids_sha256", "lineage_sha256", "bucket", "n_rows", F.coalesce("n_joined", F.lit(0)).alias("n_joined"), "rewritten")


def sales_and_lines(sales: DataFrame, lines: DataFrame, *, buckets: int = 300) -> DataFrame:
    """sales and sale_lines: sales start in files of one or two buckets, lines in files by item."""
    b = F.when(F.col("sale_id").isNull(), F.lit(buckets + 1)).otherwise(bucket_of(F.col("sale_id"), buckets))
    by_item = F.when(F.col("item_id").isNull(), F.lit(0)).otherwise(bucket_of(F.col("item_id"), buckets, ""))
    return co_bucket(Table("sales", sales, "sale_id", F.when(b % 3 == 1, b - 1).otherwise(b)), Table("sale_lines", lines, "sale_id", by_item), buckets=buckets)
