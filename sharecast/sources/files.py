"""Text, CSV and parquet files of the article table.

Files are written below the shared checkpoint folder (``session.staging_path``).
The text form is the analysed workload's input: one comma+space separated line
per article with a header line at the top of every file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LINE_SEPARATOR
from ..session import staging_path


def as_lines(df: DataFrame, columns: list[str], sep: str = LINE_SEPARATOR) -> DataFrame:
    """value = the columns' text joined by ``sep`` (one line per row)."""
    return df.select(F.concat_ws(sep, *[F.col(c).cast("string") for c in columns])
                     .alias("value"))


def write_article_files(df: DataFrame, columns: list[str], name: str = "articles",
                        sep: str = LINE_SEPARATOR) -> str:
    """Write ``columns`` as separated text files, each starting with the header."""
    path = staging_path(df.sparkSession, name)
    _staged.append((df.sparkSession.sparkContext.applicationId, path, None))
    (df.select(*[F.col(c).cast("string") for c in columns])
     .write.option("header", True).option("sep", sep).option("quote", "\u0000")
     .option("emptyValue", "").csv(path))
    return path


def write_lines(lines: DataFrame, name: str, header: str) -> str:
    """Write text lines (one column) as files that start with ``header`` each."""
    spark = lines.sparkSession
    path = staging_path(spark, name)
    _staged.append((spark.sparkContext.applicationId, path, None))
    (lines.toDF(header).write.option("header", True).option("sep", "\u0001").option("quote", "\u0000")
     .option("emptyValue", "").csv(path))
    return path


def scan_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines (``value``), header lines included. Splits follow
    ``spark.sql.files.maxPartitionBytes`` at every size."""
    return spark.read.text(path)


def numbered_lines(spark: SparkSession, path: str, skip: str | None = None) -> DataFrame:
    """line_no (bigint from 0, in the order of files by path and of lines in them) and
    value, without the lines equal to ``skip``.

    Every line records its file, the start of its split and its place in the split as
    it is read, and is written with them once: the place of a line is data, whatever
    splits a later read makes. Splits are then counted, and the prefix sums of a table
    with a row per split turn places into numbers."""
    from pyspark.sql import Window

    from ..operators.joins import lookup_join

    lines = scan_text_lines(spark, path)
    if skip is not None:
        lines = lines.filter(F.col("value") != F.lit(skip))
    read = pin_table(lines.select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                                  F.monotonically_increasing_id().alias("_place")), "lines")
    splits = read.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)     # a row per split
    offsets = splits.select("_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_add"))
    return lookup_join(read, offsets, ["_file", "_start"], salt_source="_place").select(
        (F.col("_place") + F.col("_add")).alias("line_no"), "value")


def first_line(spark: SparkSession, path: str) -> str:
    """Header text: the first line of the first file by path (a file's first split
    holds its first line)."""
    first = min(spark.read.text(path).inputFiles())
    lines = spark.read.text(first).select("value", "_metadata.file_block_start")
    return lines.filter("file_block_start = 0").limit(1).first()[0]


def scan_csv(spark: SparkSession, path: str, sep: str = LINE_SEPARATOR,
             schema: T.StructType | None = None, infer: bool = False) -> DataFrame:
    """CSV with a header line; names trimmed. With ``schema`` nothing is inferred
    (keep predictors as strings); ``infer=True`` finds types in a pass over the files."""
    reader = spark.read.option("header", True).option("sep", sep).option("quote", "\u0000")
    if schema is not None:
        return reader.schema(schema).csv(path)
    df = reader.option("inferSchema", infer).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def parquet_roundtrip(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as parquet (optionally partitioned) and scan it back."""
    path = staging_path(df.sparkSession, name)
    _staged.append((df.sparkSession.sparkContext.applicationId, path, None))
    writer = df.write.mode("error")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Tables and folders written below the shared folder: (application, folder, table).
_staged: list[tuple[str, str, str | None]] = []


def pin_table(df: DataFrame, name: str, with_path: bool = False, options: dict[str, str] | None = None):
    """Write ``df`` once as parquet in the shared folder and scan it back: cuts
    the lineage (an executor loss re-reads files instead of recomputing) and
    computes ``df`` exactly once. ``with_path=True`` also returns the folder;
    ``options`` go to the writer."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    _staged.append((spark.sparkContext.applicationId, path, None))
    df.write.options(**(options or {})).parquet(path)
    # the schema is known: reading it back needs no footer-inference job
    out = spark.read.schema(df.schema).parquet(path)
    return (out, path) if with_path else out


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def drop_files(spark: SparkSession, path: str) -> None:
    """Delete a written table that nothing reads any more (Hadoop FileSystem,
    so it works on any cluster file system)."""
    _delete(spark, path)
    _staged[:] = [x for x in _staged if x[1] != path]


def release_staged(spark: SparkSession) -> int:
    """Delete every table this application has staged; call it when no DataFrame that
    reads them is needed any more. Returns how many there were."""
    app = spark.sparkContext.applicationId
    mine = [x for x in _staged if x[0] == app]
    for _, path, table in mine:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        _delete(spark, path)
    _staged[:] = [x for x in _staged if x[0] != app]
    return len(mine)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing holds any more:
    it acts on garbage collection, which a driver with a large heap seldom runs. Call it
    after a large shuffle whose result is written, with its DataFrames deleted."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def folder_state(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and modification times of the files of a folder of tables (and of
    the part files of tables that are folders)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    out = []
    for st in fs.listStatus(root):
        for x in fs.listStatus(st.getPath()) if st.isDirectory() else [st]:
            out.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return tuple(sorted(out))


ROWS_PER_BUCKET = 4_000_000


def bucket_count(spark: SparkSession, rows: int | None = None) -> int:
    """Buckets of pinned tables: the shuffle partition count, more for more ``rows``."""
    wanted = -(-rows // ROWS_PER_BUCKET) if rows else 1
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), wanted)


def write_bucketed(df: DataFrame, name: str, key: str, rows: int | None = None) -> DataFrame:
    """Pin ``df`` as a parquet table in the shared folder, bucketed by ``key``; later
    joins and aggregates on ``key`` read it without a shuffle. One file per bucket
    (rows are hash-partitioned before the write). ``rows``, if known, sizes the buckets."""
    import uuid

    spark = df.sparkSession
    buckets = bucket_count(spark, rows)
    path = staging_path(spark, name)
    table_name = f"sharecast_{name}_{uuid.uuid4().hex[:12]}"
    _staged.append((spark.sparkContext.applicationId, path, table_name))
    (df.repartition(buckets, key).write.bucketBy(buckets, key).option("path", path).saveAsTable(table_name))
    return spark.table(table_name)
