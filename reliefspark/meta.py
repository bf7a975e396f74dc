"""What describes a raster besides its cells."""

from __future__ import annotations

from dataclasses import dataclass, replace
from pathlib import PurePosixPath

import numpy as np

#: Cell types by name, with the Spark type that holds each.
CELL_TYPES = {"Byte": ("u1", "short"), "UInt16": ("u2", "int"), "Int16": ("i2", "short"), "UInt32": ("u4", "long"), "Int32": ("i4", "int"), "Float32": ("f4", "float"), "Float64": ("f8", "double")}
#: File formats by suffix.
FORMATS = {".asc": "asc", ".tif": "tif", ".tiff": "tif"}


@dataclass(frozen=True)
class RasterMeta:
    """Size, cell size, NODATA and place of a raster; rows count southwards from 0."""

    ncols: int
    nrows: int
    cellsize: float = 1.0
    nodata: float | None = -9999.0
    xllcorner: float = 0.0
    yllcorner: float = 0.0
    geotransform: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    projection: str = ""

    @property
    def stored_nodata(self) -> float | None:
        """NODATA as cells hold it: cells are single precision, so a value that isn't is rounded as they are."""
        return None if self.nodata is None else float(np.float32(self.nodata))

    def header(self) -> tuple:
        """The eight values that travel with a raster."""
        return (self.ncols, self.nrows, self.cellsize, self.nodata, self.xllcorner, self.yllcorner, self.geotransform, self.projection)

    def part(self, first: int, rows: int) -> RasterMeta:
        """Of ``rows`` rows from row ``first`` on."""
        x0, dx, rx, y0, ry, dy = self.geotransform
        return replace(self, nrows=rows, geotransform=(x0 + first * rx, dx, rx, y0 + first * dy, ry, dy), yllcorner=y0 + (first + rows) * dy)


def file_type(path: str) -> str:
    """'asc' or 'tif' by the suffix; anything else is an error."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix not in FORMATS:
        raise ValueError(f"{path}: unsupported file type {suffix or '(none)'}; known are {', '.join(FORMATS)}")
    return FORMATS[suffix]


def output_path(folder: str, source: str, function: str) -> str:
    """Where the result of a function over a file goes: <folder>/<stem>_<function>.tif."""
    return f"{folder.rstrip('/')}/{PurePosixPath(source).stem}_{function.lower()}.tif"
