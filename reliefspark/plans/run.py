"""One input, any number of functions and outputs, one scan."""

from __future__ import annotations

import logging
import sys
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.functions.focal import focal_function
from reliefspark.functions.kernels import KERNELS
from reliefspark.meta import RasterMeta
from reliefspark.operators.stencil import focal, focal_strips, gathered
from reliefspark.sources.raster import default_rows_per_strip, fitting_rows_per_strip, fitting_strip, read_header, read_raster, write_raster

log = logging.getLogger(__name__)


def compute(spark: SparkSession, source: str | DataFrame, functions: list[str], *, meta: RasterMeta | None = None, cellsize: float | None = None, boundary: str = "observed", strip: int | None = None) -> tuple[DataFrame, RasterMeta]:
    """(row and arrays v0, v1, ... in the order of ``functions``, header) of a file or a rows frame.

    Functions with a NumPy kernel are computed strip by strip; if one has none,
    all are computed as Columns over cells, which stay in order and are gathered
    where they are. From a file neither takes a shuffle, as the source gives each
    strip with its halo; a table's rows are shuffled once.
    """
    for f in functions:
        if f.lower() not in KERNELS:
            focal_function(f)
    if isinstance(source, str):
        meta = read_header(source, cellsize)
    elif meta is None:
        raise ValueError("a table needs its header in meta")
    rows = read_raster(spark, source, halo=True, strip=strip)[0] if isinstance(source, str) else source
    if all(f.lower() in KERNELS for f in functions):
        return focal_strips(rows, meta, functions, boundary=boundary, height=strip, single=True), meta
    columns = {f"v{i}": focal_function(f) for i, f in enumerate(functions)}
    cells = focal(rows, meta, columns, boundary=boundary, height=strip)
    return gathered(cells, meta.ncols, list(columns)), meta


def run(spark: SparkSession, source: str | DataFrame, outputs: list[str], functions: list[str], *, meta: RasterMeta | None = None, cellsize: float | None = None, boundary: str = "observed", strip: int | None = None, layout: str = "auto", views: list[str] | None = None) -> float:
    """Writes the i-th function to the i-th output (GeoTIFF); the same function may come twice. Returns the seconds it took.

    All outputs are written in one pass: one scan, one job. ``views`` registers
    the results as temporary views too.
    """
    if len(outputs) != len(functions) or not outputs:
        raise ValueError(f"{len(outputs)} outputs for {len(functions)} functions")
    began = time.time()
    rows_per_strip = None
    if isinstance(source, str):  # strips of the scan are parts of the results
        header = read_header(source, cellsize)
        if strip is None:
            usual, strip = default_rows_per_strip(header), fitting_strip(spark, header)
            strip = strip // usual * usual if strip >= usual else strip
        rows_per_strip = fitting_rows_per_strip(header, strip)
    found, header = compute(spark, source, functions, meta=meta, cellsize=cellsize, boundary=boundary, strip=strip)
    write_raster(found, outputs, header, layout=layout, rows_per_strip=rows_per_strip, aligned=rows_per_strip is not None)
    for name, path in zip(views or [], outputs, strict=False):
        read_raster(spark, path)[0].createOrReplaceTempView(name)
    took = time.time() - began
    log.info("%d outputs of %d x %d cells in %.1f s", len(outputs), header.nrows, header.ncols, took)
    return took


USAGE = "python -m reliefspark INPUT OUT1 FUNCTION1 [OUT2 FUNCTION2 ...]"


def command(args: list[str], spark: SparkSession | None = None) -> int:
    """The command line: 0 where it went well, 1 for what can't be read or isn't known, 2 for wrong arguments."""
    if len(args) < 3 or len(args) % 2 == 0:
        print(f"usage: {USAGE}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("reliefspark").getOrCreate()
    try:
        took = run(spark, args[0], args[1::2], [f.lower() for f in args[2::2]])
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    print(f"{len(args) // 2} outputs in {took:.1f} s")
    return 0


def layers(spark: SparkSession) -> list[str]:
    """Names of the tables and views that ``spark.table`` can give to ``run``."""
    return sorted(t.name for t in spark.catalog.listTables())


def zonal(cells: DataFrame, zones: DataFrame, value: str) -> DataFrame:
    """Count, mean, least and greatest value by zone (an addition): ``zones`` has row, col and zone."""
    return cells.join(zones, ["row", "col"]).groupBy("zone").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("lo"), F.max(value).alias("hi"))


def mosaic(frames: list[DataFrame]) -> DataFrame:
    """Rows of rasters that lie below one another as one raster, in the order given."""
    counted, at = [], 0
    for f in frames:
        counted.append(f.withColumn("row", F.col("row") + at))
        at += f.count()
    return reduce(DataFrame.unionByName, counted)
