"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_base(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir`` or the context's checkpoint folder; a temporary one only on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tandem-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_base(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder."""
    shared_base(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back, for a table that several branches of a plan read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with the place of each row, from 0, in the order of ``by``: the rows are dealt into ranges, written, and
    numbered in each range behind the counts of the ranges before, so no task orders the whole table."""
    ranged = written(df.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    numbered = ranged.join(F.broadcast(before), "_range")  # as many rows as ranges
    return numbered.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*by)) - 1 + F.col("_before")).drop("_range", "_before")


def written_files(df: DataFrame, name: str, rows_per_file: int = 8192) -> list[str]:
    """Write a table that tasks read block by block, in files of about ``rows_per_file`` rows; the files' URIs."""
    path = shared_path(df.sparkSession, name)
    df.repartition(max(1, df.count() // rows_per_file + 1)).write.parquet(path)
    fs, folder, prefix = _arrow(path)
    from pyarrow.fs import FileSelector

    return sorted(f"{prefix}{f.path}" for f in fs.get_file_info(FileSelector(folder)) if f.base_name.endswith(".parquet"))


def _arrow(uri: str):
    """Arrow's file system of a URI or path, the path in it, and what turns such a path into a URI again."""
    from pyarrow.fs import FileSystem

    if "://" not in uri:
        uri = "file://" + uri.removeprefix("file:")
    fs, path = FileSystem.from_uri(uri)
    return fs, path, uri[: uri.index(path)] if path in uri else uri.split("://")[0] + "://"


def blocks_of(files: list[str], rows: int) -> Iterator[pa.Table]:
    """The rows of ``written_files`` in blocks of at most ``rows``, one in memory at a time."""
    import pyarrow.parquet as pq

    for name in files:
        fs, path, _ = _arrow(name)
        with fs.open_input_file(path) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=rows):
                if batch.num_rows:
                    yield pa.Table.from_batches([batch])


def join_frequent(rows: DataFrame, table: DataFrame, key: str, count: str, total: int, least: int = 500, share: float = 1 / 2000) -> DataFrame:
    """Inner join of ``rows`` with a table of one row for each key and the key's number of rows in ``count``; ``total`` is that of all rows.
    Keys of at least that share of the rows are few (1 / share) and are broadcast, the others are shuffled."""
    often = F.col(count) >= max(least, total * share)
    few = F.broadcast(table.filter(often))  # 1 / share rows at most
    rest = rows.join(few.select(key), key, "left_anti").join(table.filter(~often), key)
    return rows.join(few, key).unionByName(rest)
