"""The folder that driver and executors share, and tables that cut lineage."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the cluster's shared folder (``spark.checkpoint.dir``).

    Only a local master may go without the setting (tests): driver and
    executors are one process there, so a temporary folder serves.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="relief-"))
        found = spark.sparkContext.getCheckpointDir()
    return found if "://" in found or found.startswith("file:") else f"file://{os.path.abspath(found)}"


def fresh_dir(spark: SparkSession, name: str) -> str:
    """URI of a new folder under the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, read back: its lineage ends there."""
    spark = df.sparkSession
    path = fresh_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Removes a table that ``written`` made and nothing needs any more."""
    store, path = local_or_remote(df.written_to)
    if store.get_file_info(path).type.name == "Directory":
        store.delete_dir(path)


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session: for rows whose cost isn't their bytes, so that they are not put together by bytes."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_or_remote(uri: str):
    """(pyarrow file system, path) of a URI; works on executors without a JVM."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def mapped_file(uri: str) -> mmap.mmap | None:
    """A file mapped into memory, None where there is none or it is empty; of a remote one a copy, which is unlinked at once, is mapped."""
    store, path = local_or_remote(uri)
    info = store.get_file_info(path)
    if not info.is_file or not info.size:
        return None
    if store.type_name == "local":
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with tempfile.TemporaryFile() as f, store.open_input_file(path) as source:
        while data := source.read(8 << 20):
            f.write(data)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
