"""GeoTIFF and BigTIFF: reading of rows, and writing of one band of float32 in DEFLATE strips."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from reliefspark.meta import RasterMeta
from reliefspark.sources.files import open_input

# Fixed values of the format: field sizes and codes by type, and the tags that are used.
FIELDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT = 322, 323, 324, 325, 339
PIXEL_SCALE, TIEPOINT, TRANSFORM, GEO_KEYS, GEO_DOUBLES, GEO_ASCII, NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42113
KINDS = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}


@dataclass(frozen=True)
class TiffLayout:
    meta: RasterMeta
    order: str  # '<' or '>'
    kind: str
    compression: int
    predictor: int
    samples: int
    block_rows: int
    block_cols: int
    tiled: bool
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]


def read_layout(path: str) -> TiffLayout:
    with open_input(path) as f:
        head = f.read(16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        version = struct.unpack(f"{order}H", head[2:4])[0] if order else 0
        if version not in (42, 43):
            raise ValueError(f"{path}: not a TIFF file")
        big = version == 43
        at = struct.unpack(f"{order}Q", head[8:16])[0] if big else struct.unpack(f"{order}I", head[4:8])[0]
        f.seek(at)
        n = struct.unpack(f"{order}Q", f.read(8))[0] if big else struct.unpack(f"{order}H", f.read(2))[0]
        entry, inline = (20, 8) if big else (12, 4)
        raw, tags = f.read(n * entry), {}
        for i in range(n):
            e = raw[i * entry : (i + 1) * entry]
            tag, kind = struct.unpack(f"{order}HH", e[:4])
            count = struct.unpack(f"{order}{'Q' if big else 'I'}", e[4 : 4 + inline])[0]
            size, code = FIELDS.get(kind, (1, "B"))
            value = e[4 + inline :]
            if size * count > inline:
                f.seek(struct.unpack(f"{order}{'Q' if big else 'I'}", value)[0])
                value = f.read(size * count)
            value = value[: size * count]
            tags[tag] = value.rstrip(b"\0").decode("latin-1") if code == "s" else struct.unpack(f"{order}{code * count if len(code) > 1 else str(count) + code}", value)
    one = lambda t, d: tags[t][0] if t in tags else d
    bits, samples = one(BITS, 1), one(SAMPLES, 1)
    kind = KINDS.get((one(SAMPLE_FORMAT, 1), bits))
    if kind is None or one(COMPRESSION, 1) not in (1, 8, 32946) or one(PREDICTOR, 1) not in (1, 2) or (samples > 1 and one(PLANAR, 1) == 2):
        raise ValueError(f"{path}: cells of {bits} bits, compression {one(COMPRESSION, 1)}, predictor {one(PREDICTOR, 1)}: not supported")
    cols, rows = tags[WIDTH][0], tags[HEIGHT][0]
    if TRANSFORM in tags:
        t = tags[TRANSFORM]
        transform = (t[3], t[0], t[1], t[7], t[4], t[5])
    elif PIXEL_SCALE in tags and TIEPOINT in tags:
        (sx, sy, _), (i, j, _, x, y, _) = tags[PIXEL_SCALE][:3], tags[TIEPOINT][:6]
        transform = (x - i * sx, sx, 0.0, y + j * sy, 0.0, -sy)
    else:
        transform = (0.0, 1.0, 0.0, 0.0, 0.0, -1.0)
    nodata = float(tags[NODATA]) if tags.get(NODATA, "").strip() else None
    meta = RasterMeta(cols, rows, abs(transform[1]), nodata, transform[0], transform[3] + rows * transform[5], tuple(map(float, transform)), tags.get(GEO_ASCII, "").split("|")[0])
    tiled = TILE_OFFSETS in tags
    return TiffLayout(meta, order, kind, one(COMPRESSION, 1), one(PREDICTOR, 1), samples, one(TILE_HEIGHT, 0) if tiled else min(rows, one(ROWS_PER_STRIP, rows)), one(TILE_WIDTH, 0) if tiled else cols, tiled, tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_BYTES if tiled else STRIP_BYTES])


def read_tiff_rows(path: str, layout: TiffLayout, first: int, last: int):
    """(first row, float32 block) of rows ``first`` to ``last`` - 1 of band 1, one row of blocks at a time."""
    rows, cols = layout.meta.nrows, layout.meta.ncols
    across = -(-cols // layout.block_cols)
    kind = np.dtype(layout.order + layout.kind)
    with open_input(path) as f:
        for band in range(first // layout.block_rows, -(-last // layout.block_rows)):
            top = band * layout.block_rows
            out = np.empty((min(layout.block_rows, rows - top), cols), np.float32)
            for k in range(across):
                f.seek(layout.offsets[band * across + k])
                data = f.read(layout.sizes[band * across + k])
                if layout.compression != 1:
                    data = zlib.decompress(data)
                height = layout.block_rows if layout.tiled else len(out)
                block = np.frombuffer(data, kind, height * layout.block_cols * layout.samples).reshape(height, layout.block_cols, layout.samples)
                if layout.predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=block.dtype.newbyteorder("="))
                left = k * layout.block_cols
                width = min(layout.block_cols, cols - left)
                out[:, left : left + width] = block[: len(out), :width, 0]
            lo, hi = max(first - top, 0), min(last - top, len(out))
            yield top + lo, out[lo:hi]


def pack_strip(z: np.ndarray, level: int = 1) -> bytes:
    """Rows as one compressed strip; on float cells higher levels take half as long again for 1 % of the size."""
    return zlib.compress(np.ascontiguousarray(z, "<f4").tobytes(), level)


def tiff_head(meta: RasterMeta, rows_per_strip: int, sizes: list[int]) -> bytes:
    """Header and directory of a BigTIFF file whose strips follow at once, in order."""
    x0, dx, rx, y0, ry, dy = meta.geotransform
    ascii_ = lambda s: (2, len(s) + 1, s.encode("latin-1", "replace") + b"\0")
    number = lambda kind, *v: (kind, len(v), struct.pack(f"<{len(v)}{FIELDS[kind][1]}", *v))
    tags = {WIDTH: number(4, meta.ncols), HEIGHT: number(4, meta.nrows), BITS: number(3, 32), COMPRESSION: number(3, 8), PHOTOMETRIC: number(3, 1), STRIP_OFFSETS: number(16, *[0] * len(sizes)), SAMPLES: number(3, 1), ROWS_PER_STRIP: number(4, rows_per_strip), STRIP_BYTES: number(16, *sizes), PLANAR: number(3, 1), SAMPLE_FORMAT: number(3, 3)}
    if rx or ry or dy >= 0:
        tags[TRANSFORM] = number(12, dx, rx, 0.0, x0, ry, dy, 0.0, y0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)
    else:
        tags |= {PIXEL_SCALE: number(12, dx, -dy, 0.0), TIEPOINT: number(12, 0.0, 0.0, 0.0, x0, y0, 0.0)}
    if meta.projection:
        tags |= {GEO_KEYS: number(3, 1, 1, 0, 1, 1026, GEO_ASCII, len(meta.projection) + 1, 0), GEO_ASCII: ascii_(f"{meta.projection}|")}
    if meta.nodata is not None:
        tags[NODATA] = ascii_(repr(float(meta.nodata)))
    base = 16 + 8 + 20 * len(tags) + 8
    end = base + sum(len(v) + -len(v) % 8 for _, _, v in tags.values() if len(v) > 8)
    tags[STRIP_OFFSETS] = number(16, *(end + int(o) for o in np.cumsum([0, *sizes])[:-1]))
    entries, extra = b"", b""
    for tag, (kind, count, value) in sorted(tags.items()):
        if len(value) > 8:
            place = struct.pack("<Q", base + len(extra))
            extra += value + b"\0" * (-len(value) % 8)
        else:
            place = value.ljust(8, b"\0")
        entries += struct.pack("<HHQ", tag, kind, count) + place
    return struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16) + struct.pack("<Q", len(tags)) + entries + struct.pack("<Q", 0) + extra
