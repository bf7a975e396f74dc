"""Strips of rows with their halo: the unit in which neighbourhoods are gathered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of cells that a strip should hold.
STRIP_BYTES = 16 << 20


def strip_rows(ncols: int, target_bytes: int = STRIP_BYTES, *, nrows: int = 0, tasks: int = 1) -> int:
    """Rows of a strip: wide rasters have low strips, so that what one task holds stays bounded.

    Of a raster of ``nrows`` that is too small to keep ``tasks`` busy so, strips
    are lower, but not below 16 rows: each has two rows of halo.
    """
    height = max(1, target_bytes // (8 * max(1, ncols)))
    return min(height, max(16, -(-nrows // (2 * tasks)))) if nrows else height


def strip_of(row: Column, height: int) -> Column:
    return F.floor(row / F.lit(height)).cast("long")


def with_halo(rows: DataFrame, nrows: int, height: int) -> DataFrame:
    """Every row once for each strip that needs it: its own, and the one next to it at a strip's edge."""
    clamp = lambda x: F.greatest(F.lit(0), F.least(F.lit(max(0, nrows - 1)), x))
    needed = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: strip_of(clamp(F.col("row") + d), height)))
    out = rows.withColumn("strip", F.explode(needed))
    return out.withColumn("is_halo", F.col("strip") != strip_of(F.col("row"), height))
