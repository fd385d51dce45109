"""Files in the folder that the driver and all executors share.

The folder is the session's ``spark.checkpoint.dir``; a temporary one is set only where that is unset
on a local master (tests, one machine). Files are reached through Arrow's file systems (local, HDFS, S3, GCS), are written
under an attempt's own name and renamed, so a retried or speculative task leaves one whole file.
"""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import shared_base


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below the shared checkpoint folder."""
    base = shared_base(spark)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + base
    elif base.startswith("file:/") and not base.startswith("file://"):
        base = "file://" + base[len("file:") :]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def make_dir(uri: str) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(path, recursive=True)


class AtomicFile:
    """An output file that appears under its final name only when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.temp = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.size = 0

    def write(self, data) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.path)

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temp)


def read_all(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        return f.read()
