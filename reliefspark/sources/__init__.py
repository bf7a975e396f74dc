"""Raster files as Spark data sources."""

from reliefspark.sources.raster import RasterDataSource, read_header, read_raster, register

__all__ = ["RasterDataSource", "read_header", "read_raster", "register"]
