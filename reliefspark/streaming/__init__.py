"""Rasters that arrive in a folder, one after another (an addition)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reliefspark.meta import output_path
from reliefspark.plans.run import run


def process_folder(spark: SparkSession, folder: str, to: str, functions: list[str], checkpoint: str, *, done: Callable[[str], None] | None = None, **how) -> StreamingQuery:
    """Runs ``functions`` over each file that appears in ``folder``; the checkpoint remembers which are done.

    The stream carries names alone; every file is then a job of its own, and one
    that is run again overwrites what it had written.
    """
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.{asc,tif}").load(folder).select("path")

    def batch(df, _: int) -> None:
        for (path,) in df.orderBy("path").select(F.col("path")).toLocalIterator():
            run(spark, path, [output_path(to, path, f) for f in functions], functions, **how)
            if done:
                done(path)

    return names.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
