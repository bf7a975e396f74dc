"""ESRI ASCII grids: a few header lines, then the values, the northern row first."""

from __future__ import annotations

import re

import numpy as np

from reliefspark.meta import RasterMeta
from reliefspark.sources.files import open_input, store_of

#: Keys of the header.
KEYS = ("ncols", "nrows", "xllcorner", "xllcenter", "yllcorner", "yllcenter", "cellsize", "dx", "dy", "nodata_value")
BLOCK = 8 << 20
#: Bytes of a block of the index: how many values begin in each.
INDEX_BLOCK = 4 << 20


def read_ascii_header(path: str) -> tuple[RasterMeta, int]:
    """(header, where the values begin)."""
    with open_input(path) as f:
        head = f.read(1 << 16)
    found, at = {}, 0
    for m in re.finditer(rb"[ \t\r\n]*([A-Za-z_]+)[ \t]+([^\s]+)[ \t]*(?=\r|\n|$)", head):
        if m.start() != at or m[1].lower().decode() not in KEYS:
            break
        found[m[1].lower().decode()] = float(m[2])
        at = m.end()
    if missing := [k for k in ("ncols", "nrows") if k not in found]:
        raise ValueError(f"{path}: no {missing[0]} in the header")
    ncols, nrows = int(found["ncols"]), int(found["nrows"])
    dx = found.get("cellsize", found.get("dx", 1.0))
    dy = found.get("cellsize", found.get("dy", dx))
    x = found.get("xllcorner", found.get("xllcenter", dx / 2) - dx / 2)
    y = found.get("yllcorner", found.get("yllcenter", dy / 2) - dy / 2)
    return RasterMeta(ncols, nrows, dx, found.get("nodata_value"), x, y, (x, dx, 0.0, y + nrows * dy, 0.0, -dy)), at


def spaces(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def file_bytes(path: str) -> int:
    store, name = store_of(path)
    return store.get_file_info(name).size


def count_values(path: str, begin: int, block: int) -> int:
    """How many values begin in a block of INDEX_BLOCK bytes; lines need not be rows."""
    at = begin + block * INDEX_BLOCK
    with open_input(path) as f:
        f.seek(max(begin, at - 1))
        data = np.frombuffer(f.read(INDEX_BLOCK + (block > 0)), np.uint8)
    space = spaces(data)
    before = space[:-1] if block else np.concatenate([[True], space[:-1]])
    return int(np.count_nonzero(~space[int(block > 0) :] & before))


def n_blocks(path: str, begin: int) -> int:
    return max(1, -(-(file_bytes(path) - begin) // INDEX_BLOCK))


def place_of(counts: list[int], value: int) -> tuple[int, int]:
    """(block in which a value begins, values that begin in it before)."""
    sums = np.concatenate([[0], np.cumsum(counts)])
    block = min(int(np.searchsorted(sums, value, "right")) - 1, len(counts) - 1)
    return block, value - int(sums[block])


def read_ascii_rows(path: str, meta: RasterMeta, begin: int, block: int, skip: int, rows: int):
    """``rows`` rows as float32, some at a time, from the ``skip``-th value on that begins in a block."""
    held, rest, given, offset = [], b"", 0, begin + block * INDEX_BLOCK
    with open_input(path) as f:
        left = file_bytes(path) - offset
        if block:  # a value that began before the block isn't the block's
            f.seek(offset - 1)
            skip += int(not spaces(np.frombuffer(f.read(2), np.uint8)).any())
        f.seek(offset)
        while left > 0 or rest:
            data = f.read(min(BLOCK, left)) if left > 0 else b""
            left -= len(data)
            data = rest + data
            cut = len(data) if left <= 0 or not data else max(data.rfind(b" "), data.rfind(b"\n"), data.rfind(b"\t"), data.rfind(b"\r")) + 1
            rest = data[cut:]
            values = data[:cut].split()
            held.append(np.array(values[skip:], np.float64))
            skip = max(0, skip - len(values))
            if left <= 0 and not rest or sum(map(len, held)) >= meta.ncols:
                values = np.concatenate(held)
                whole = min(len(values) // meta.ncols if meta.ncols else 0, rows - given)
                if whole:
                    yield values[: whole * meta.ncols].astype(np.float32).reshape(whole, meta.ncols)
                given += whole
                held = [values[whole * meta.ncols :]]
                if given == rows:
                    return
            if not data:
                break
    if given < rows:
        raise ValueError(f"{path}: {given} of {rows} rows from byte {offset} on")


def ascii_text(meta: RasterMeta, z: np.ndarray) -> str:
    """A whole small grid as text."""
    head = f"ncols {meta.ncols}\nnrows {meta.nrows}\nxllcorner {meta.xllcorner!r}\nyllcorner {meta.yllcorner!r}\ncellsize {meta.cellsize!r}\n" + (f"NODATA_value {meta.nodata!r}\n" if meta.nodata is not None else "")
    return head + "".join(" ".join(repr(float(v)) for v in row) + "\n" for row in z)
