"""The same functions over whole strips in NumPy, for file inputs and for functions that Columns can't express."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from reliefspark.functions.focal import DEGREES
from reliefspark.meta import RasterMeta

#: From neighbours by letter, dz/dx, dz/dy and header to values; NaN where there is none isn't NODATA, masked cells are.
Kernel = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray, RasterMeta], np.ma.MaskedArray | np.ndarray]


def slope(n, dx, dy, meta):
    return np.arctan(np.sqrt(dx * dx + dy * dy))


def aspect(n, dx, dy, meta):
    degrees = (DEGREES * np.arctan2(dy, -dx)).astype(np.float32).astype(np.float64)
    out = np.where(degrees > 90, 360 - degrees + 90, 90 - degrees) * (np.pi / 180)
    none = (dx == 0) & (dy == 0)
    if meta.stored_nodata is not None:
        none |= (dx == meta.stored_nodata) | (dy == meta.stored_nodata)
    return np.ma.array(out, mask=none)


def hillshade(altitude: float = 45.0, azimuth: float = 315.0) -> Kernel:
    zenith, direction = np.radians(90.0 - altitude), np.radians((360.0 - azimuth + 90.0) % 360.0)
    up, east, north = 255.0 * np.cos(zenith), 255.0 * np.sin(zenith) * np.cos(direction), 255.0 * np.sin(zenith) * np.sin(direction)

    def kernel(n, dx, dy, meta):
        # the cosine between the sun and the cell's normal: the same light as by slope and aspect, without their angles
        return np.maximum(0, (up - east * dx + north * dy) / np.sqrt(1 + dx * dx + dy * dy))

    return kernel


def laplacian(n, dx, dy, meta):
    return n["b"] + n["d"] + n["f"] + n["h"] - 4 * n["e"]


KERNELS: dict[str, Kernel] = {"slope": slope, "aspect": aspect, "hillshade": hillshade(), "laplacian": laplacian, "mean": lambda n, dx, dy, m: sum(n[x] for x in "abcdefghi") / 9.0, "dz_dx": lambda n, dx, dy, m: dx, "dz_dy": lambda n, dx, dy, m: dy}


def register_kernel(name: str, kernel: Kernel) -> None:
    KERNELS[name.lower()] = kernel


def apply_kernels(z: np.ndarray, first: int, above: int, below: int, meta: RasterMeta, kernels: list[Kernel], boundary: str = "observed") -> list[np.ndarray]:
    """Values of the rows of ``z`` that aren't halo (``above`` and ``below`` of it are); ``first`` is the first such row's number."""
    z = z.astype(np.float64)
    nodata = meta.stored_nodata
    hole = z == nodata if nodata is not None else np.zeros(z.shape, bool)
    rows = np.arange(first - above, first - above + len(z))
    if boundary == "observed":
        hole |= (rows == meta.nrows - 1)[:, None]
    wide = np.pad(np.ma.array(z, mask=hole).filled(0.0), 1)
    gone = np.pad(hole, 1, constant_values=True)
    inner = slice(above + 1, len(z) - below + 1)
    count, cols = len(z) - above - below, z.shape[1]
    if count <= 0:
        return [np.zeros((0, cols)) for _ in kernels]
    e = wide[inner, 1:-1]
    n = {"e": e}
    # most rows have no hole; at the first and last column, which have no values, neighbours beyond the grid stay as they are
    holed = gone[:, 1:-1].any(1)
    for k, letter in enumerate("abcdefghi"):
        if letter != "e":
            dr, dc = k // 3 - 1, k % 3 - 1
            at = (slice(inner.start + dr, inner.stop + dr), slice(1 + dc, 1 + dc + cols))
            n[letter] = wide[at]
            rows = np.flatnonzero(holed[at[0]])
            if len(rows):
                n[letter] = n[letter].copy()
                n[letter][rows] = np.where(gone[at][rows], e[rows], n[letter][rows])
    dx = ((n["c"] + 2 * n["f"] + n["i"]) - (n["a"] + 2 * n["d"] + n["g"])) / (8 * float(meta.cellsize))
    dy = ((n["g"] + 2 * n["h"] + n["i"]) - (n["a"] + 2 * n["b"] + n["c"])) / (8 * float(meta.cellsize))
    bad = gone[inner, 1:-1].copy()
    bad[:, [0, -1]] = True
    out = []
    with np.errstate(invalid="ignore"):
        for kernel in kernels:
            found = np.ma.array(kernel(n, dx, dy, meta))
            out.append(np.where(np.ma.getmaskarray(found) | bad, np.nan if nodata is None else nodata, found.filled(0)))
    return out
