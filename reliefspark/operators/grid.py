"""Rasters as DataFrames: cells (row, col, z) and rows (row, z array), made from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefspark.meta import RasterMeta


def from_linear_id(df: DataFrame, id_column: str, ncols: int, z: Column) -> DataFrame:
    """Cells of a table whose dense key counts cells row by row."""
    key = F.col(id_column).cast("long")
    return df.select(F.floor(key / F.lit(ncols)).cast("long").alias("row"), F.pmod(key, F.lit(ncols)).cast("int").alias("col"), z.cast("double").alias("z"))


def from_arrays(df: DataFrame, row_column: str, array_column: str) -> DataFrame:
    """Rows of a table that has an array for each raster row."""
    return df.select(F.col(row_column).cast("long").alias("row"), F.col(array_column).cast("array<double>").alias("z"))


def rows_from_cells(cells: DataFrame) -> DataFrame:
    """Cells to rows: one shuffle on the row, arrays in order of the column."""
    gathered = F.array_sort(F.collect_list(F.struct("col", "z")))
    return cells.groupBy("row").agg(F.transform(gathered, lambda x: x["z"]).alias("z"))


def cells_from_rows(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.posexplode("z").alias("col", "z"))


def dimensions(rows: DataFrame, **header) -> RasterMeta:
    """Header of a rows frame; an error unless rows are 0 to n - 1 and all have the same number of cells."""
    n, lo, hi, least, most = rows.agg(F.count(F.lit(1)), F.min("row"), F.max("row"), F.min(F.size("z")), F.max(F.size("z"))).first()
    if n and (lo != 0 or hi != n - 1 or least != most):
        raise ValueError(f"not a dense raster: {n} rows from {lo} to {hi}, of {least} to {most} cells")
    return RasterMeta(ncols=most or 0, nrows=n, **header)


def header_frame(spark, raster_id: str, meta: RasterMeta) -> DataFrame:
    schema = "raster_id string, ncols int, nrows long, cellsize double, nodata double, xllcorner double, yllcorner double, geotransform array<double>, projection string"
    return spark.createDataFrame([(raster_id, *meta.header()[:6], list(meta.geotransform), meta.projection)], schema)
