"""``spark.read.format("raster")`` and ``df.write.format("raster")``.

Reading gives row, z (array<float>); with the option ``halo`` also strip and
is_halo, each partition holding one strip with the rows next to it, so that
neighbourhoods need no shuffle. Conditions on ``row`` choose what is read. A
folder of tiles reads as one raster.

Writing takes row, z (in order of rows within each partition, partitions in
order) and makes one BigTIFF file, which is put together at commit, or with
``layout`` = ``tiles`` a folder with a whole file of each partition, which no
single machine copies. With ``paths`` the columns v0, v1, ... go to an output
each, from one pass over the rows.
"""

from __future__ import annotations

import json
import math
import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from reliefspark.meta import RasterMeta, file_type
from reliefspark.operators.strips import strip_rows
from reliefspark.sources.ascii_grid import count_values, n_blocks, place_of, read_ascii_header, read_ascii_rows
from reliefspark.sources.files import store_of
from reliefspark.sources.tiff import pack_strip, read_layout, read_tiff_rows, tiff_head


#: Bytes of cells from which a result is a folder of tiles, unless the layout is given.
TILES_FROM = 1 << 30


def tiles_of(path: str) -> list[tuple[int, str]]:
    """(first row, path) of the tiles of a folder, in order; of a file itself."""
    from pyarrow.fs import FileSelector

    store, name = store_of(path)
    if store.get_file_info(name).type.name != "Directory":
        return [(0, path)]
    names = sorted(x.base_name for x in store.get_file_info(FileSelector(name)) if x.base_name.endswith(".tif"))
    return [(int(n.removesuffix(".tif").rpartition("_")[2]), f"{path.rstrip('/')}/{n}") for n in names]


def read_header(path: str, cellsize: float | None = None) -> RasterMeta:
    """Header of a file, or of a folder of tiles by its first and last; ``cellsize`` overrides the one that the file has."""
    if file_type(path) == "asc":
        meta = read_ascii_header(path)[0]
    else:
        tiles = tiles_of(path)
        if not tiles:
            raise FileNotFoundError(f"{path}: a folder without tiles")
        meta = read_layout(tiles[0][1]).meta
        if len(tiles) > 1:
            last = read_layout(tiles[-1][1]).meta
            meta = replace(meta, nrows=tiles[-1][0] + last.nrows, yllcorner=last.yllcorner)
    return meta if cellsize is None else RasterMeta(meta.ncols, meta.nrows, cellsize, *meta.header()[3:])


@dataclass
class RowRange(InputPartition):
    first: int
    last: int
    strip: int
    above: int = 0
    below: int = 0
    block: int = 0
    skip: int = 0


class RasterReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.halo = str(options.get("halo", "false")).lower() == "true"
        self.type = file_type(self.path)
        if self.type == "asc":
            self.meta, self.begin = read_ascii_header(self.path)
        else:
            self.tiles, self.meta = tiles_of(self.path), read_header(self.path)
        self.height = int(options.get("striprows") or strip_rows(self.meta.ncols))
        self.lo, self.hi = 0, self.meta.nrows
        self.index = json.loads(options.get("index", "null"))

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            bound = getattr(f, "attribute", None) == ("row",) and isinstance(getattr(f, "value", None), int) and not self.halo
            if bound and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.lo = max(self.lo, f.value + isinstance(f, GreaterThan))
            if bound and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.hi = min(self.hi, f.value + (not isinstance(f, LessThan)))
            yield f  # Spark checks the rows again

    def partitions(self):
        if self.lo >= self.hi:
            return []
        out = []
        for strip in range(self.lo // self.height, -(-self.hi // self.height)):
            first, last = max(self.lo, strip * self.height), min(self.hi, (strip + 1) * self.height)
            above, below = (int(first > 0), int(last < self.meta.nrows)) if self.halo else (0, 0)
            out.append(RowRange(first, last, strip, above, below))
        if self.type == "asc":
            counts = self.index or [count_values(self.path, self.begin, k) for k in range(n_blocks(self.path, self.begin))]
            if sum(counts) < self.meta.nrows * self.meta.ncols:
                raise ValueError(f"{self.path}: {sum(counts)} values, the header says {self.meta.nrows * self.meta.ncols}")
            for p in out:
                p.block, p.skip = place_of(counts, (p.first - p.above) * self.meta.ncols)
        return out

    def blocks(self, p: RowRange) -> Iterator[tuple[int, np.ndarray]]:
        first, last = p.first - p.above, p.last + p.below
        if self.type != "asc":
            bounds = [*(t for t, _ in self.tiles), self.meta.nrows]
            for (top, path), end in zip(self.tiles, bounds[1:], strict=True):
                if top < last and first < end:
                    for at, block in read_tiff_rows(path, read_layout(path), max(first, top) - top, min(last, end) - top):
                        yield top + at, block
            return
        for block in read_ascii_rows(self.path, self.meta, self.begin, p.block, p.skip, last - first):
            yield first, block
            first += len(block)

    def read(self, p: RowRange):
        most = max(1, (4 << 20) // (4 * max(1, self.meta.ncols)))
        for start, whole in self.blocks(p):
            for lo in range(0, len(whole), most):
                z, rows = whole[lo : lo + most], np.arange(start + lo, start + lo + len(whole[lo : lo + most]))
                lists = pa.ListArray.from_arrays(np.arange(0, z.size + 1, max(1, z.shape[1]), dtype=np.int32), np.ascontiguousarray(z).ravel())
                columns = {"row": pa.array(rows, pa.int64()), "z": lists}
                if self.halo:
                    columns |= {"strip": pa.array(np.full(len(z), p.strip, np.int64)), "is_halo": pa.array((rows < p.first) | (rows >= p.last))}
                yield pa.RecordBatch.from_pydict(columns)


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: for each output the path and the sizes of the strips."""

    parts: list[tuple[str, list[int]]]
    first: int
    rows: int


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        paths = json.loads(options["paths"]) if "paths" in options else None
        self.outputs = [(options["path"], "z")] if paths is None else [(p, f"v{i}") for i, p in enumerate(paths)]
        self.overwrite = overwrite
        self.meta: RasterMeta = pickle.loads(bytes.fromhex(options["meta"]))
        self.tiles = options.get("layout", "single") == "tiles"
        self.strip = int(options.get("rowsperstrip") or default_rows_per_strip(self.meta))
        mark = uuid.uuid4().hex
        self.folders = [f"{path}.parts-{mark}" for path, _ in self.outputs]
        for output, _ in self.outputs:
            if output.lower().endswith(".asc"):
                raise ValueError("results are GeoTIFF files; name them .tif")
            store, path = store_of(output)
            if not overwrite and store.get_file_info(path).type.name != "NotFound":
                raise FileExistsError(output)

    def write(self, iterator):
        from pyspark import TaskContext

        task = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        opened = []
        for folder in self.folders:
            store, path = store_of(f"{folder}/{task}.tif")
            store.create_dir(path.rpartition("/")[0], recursive=True)
            opened.append(store.open_output_stream(path))
        first, expected = None, None
        rest: list[list[np.ndarray]] = [[] for _ in opened]  # rows that don't make up a strip yet
        sizes: list[list[int]] = [[] for _ in opened]
        packed: list[list[bytes]] = [[] for _ in opened]  # of a tile, whose head comes first

        def out(i: int, z: np.ndarray) -> None:
            data = pack_strip(z)
            sizes[i].append(len(data))
            packed[i].append(data) if self.tiles else opened[i].write(data)

        try:
            for batch in iterator:
                rows = batch.column("row").to_numpy()
                if not len(rows):
                    continue
                first = int(rows[0]) if first is None else first
                expected = first if expected is None else expected
                if rows[0] != expected or (np.diff(rows) != 1).any():
                    raise ValueError(f"rows aren't in order at {expected}")
                expected = int(rows[-1]) + 1
                for i, (_, column) in enumerate(self.outputs):
                    held = rest[i]
                    held.append(batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(rows), self.meta.ncols))
                    n = sum(map(len, held))
                    if n >= self.strip:
                        z = np.concatenate(held) if len(held) > 1 else held[0]
                        cut = n - n % self.strip
                        for at in range(0, cut, self.strip):
                            out(i, z[at : at + self.strip])
                        rest[i] = [z[cut:].copy()] if cut < n else []
            for i, held in enumerate(rest):
                if held:
                    out(i, np.concatenate(held))
                if packed[i]:
                    opened[i].write(tiff_head(self.meta.part(first, expected - first), self.strip, sizes[i]))
                    for data in packed[i]:
                        opened[i].write(data)
        finally:
            for f in opened:
                f.close()
        parts = [(f"{folder}/{task}.tif", s) for folder, s in zip(self.folders, sizes, strict=True)]
        return Written(parts, first if first is not None else -1, (expected or 0) - (first or 0))

    def commit(self, messages):
        done = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)
        if [m.first for m in done] != np.cumsum([0, *(m.rows for m in done)])[:-1].tolist() or sum(m.rows for m in done) != self.meta.nrows:
            raise ValueError(f"rows of the parts don't make up 0 to {self.meta.nrows - 1}")
        if not self.tiles and any(m.rows % self.strip for m in done[:-1]):
            raise ValueError(f"parts of a single file must have a multiple of {self.strip} rows")
        for i, ((output, _), folder) in enumerate(zip(self.outputs, self.folders, strict=True)):
            store, path = store_of(output)
            ready = f"{store_of(folder)[1]}/.whole"
            if self.tiles:  # the tasks' files as they are: names move, no bytes
                store.create_dir(ready, recursive=True)
                for m in done:
                    store.move(store_of(m.parts[i][0])[1], f"{ready}/tile_{m.first:012d}.tif")
            else:
                self.join(store, ready, [m.parts[i] for m in done])
            if store.get_file_info(path).type.name == "Directory":
                store.delete_dir(path)
            elif self.tiles and store.get_file_info(path).type.name != "NotFound":
                store.delete_file(path)
            store.move(ready, path)  # takes the place of a file at once
            store.delete_dir(store_of(folder)[1])

    def join(self, store, to: str, parts: list[tuple[str, list[int]]]) -> None:
        with store.open_output_stream(to) as out:
            out.write(tiff_head(self.meta, self.strip, [s for _, sizes in parts for s in sizes]))
            for path, _ in parts:
                with store.open_input_stream(store_of(path)[1]) as f:
                    while data := f.read(8 << 20):
                        out.write(data)

    def abort(self, messages):
        for folder in self.folders:
            store, path = store_of(folder)
            if store.get_file_info(path).type.name != "NotFound":
                store.delete_dir(path)


class RasterDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        return "row long, z array<float>" + (", strip long, is_halo boolean" if str(self.options.get("halo", "false")).lower() == "true" else "")

    def reader(self, schema) -> DataSourceReader:
        return RasterReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RasterWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterDataSource)


def fitting_strip(spark: SparkSession, meta: RasterMeta) -> int:
    """Rows of the strips in which a file is read."""
    return strip_rows(meta.ncols, nrows=meta.nrows, tasks=spark.sparkContext.defaultParallelism)


def read_raster(spark: SparkSession, path: str, *, halo: bool = False, strip: int | None = None) -> tuple[DataFrame, RasterMeta]:
    """(rows, header) of a file."""
    register(spark)
    meta = read_header(path)
    strip = strip or fitting_strip(spark, meta)
    how = {"halo": str(halo).lower(), "stripRows": strip}
    if file_type(path) == "asc":
        how["index"] = json.dumps(ascii_index(spark, path))
    return spark.read.format("raster").options(**how).load(path), meta


def ascii_index(spark: SparkSession, path: str) -> list[int]:
    """How many values begin in each block of an ASCII grid: tasks count them, a number for each block reaches the driver."""
    begin = read_ascii_header(path)[1]
    blocks = n_blocks(path, begin)
    if blocks == 1:
        return [count_values(path, begin, 0)]

    def count(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([count_values(path, begin, k) for k in batch.column("id").to_pylist()], pa.int64())], names=["id", "n"])

    tasks = min(blocks, 4 * spark.sparkContext.defaultParallelism)
    return [r.n for r in sorted(spark.range(0, blocks, 1, tasks).mapInArrow(count, "id long, n long").collect())]


def default_rows_per_strip(meta: RasterMeta) -> int:
    """Rows of a TIFF strip of about 256 KB."""
    return max(1, (256 << 10) // (4 * max(1, meta.ncols)))


def fitting_rows_per_strip(meta: RasterMeta, height: int) -> int:
    """Rows of a TIFF strip of which parts of ``height`` rows hold a whole number."""
    usual = default_rows_per_strip(meta)
    return height if height <= usual else math.gcd(height, usual)


def layout_of(meta: RasterMeta, layout: str) -> str:
    """'auto' is one file below TILES_FROM bytes of cells, tiles from there on."""
    if layout not in ("auto", "single", "tiles"):
        raise ValueError("layout is 'auto', 'single' or 'tiles'")
    return layout if layout != "auto" else "tiles" if 4 * meta.ncols * meta.nrows >= TILES_FROM else "single"


def write_raster(rows: DataFrame, path: str | list[str], meta: RasterMeta, *, mode: str = "overwrite", layout: str = "auto", rows_per_strip: int | None = None, aligned: bool = False) -> None:
    """Writes row, z; or v0, v1, ... to a list of paths, in one pass.

    Parts of a single file begin at multiples of the strip height; the rows are
    dealt out so, unless they are ``aligned``: each partition has consecutive
    rows in order, a multiple of ``rows_per_strip`` but for the last.
    """
    from pyspark.sql import functions as F

    register(rows.sparkSession)
    columns = ["z"] if isinstance(path, str) else [f"v{i}" for i in range(len(path))]
    strip = rows_per_strip or default_rows_per_strip(meta)
    dealt = rows.select(F.col("row").cast("long").alias("row"), *(F.col(c).cast("array<float>").alias(c) for c in columns))
    if not aligned:
        height = max(strip, strip_rows(meta.ncols, nrows=meta.nrows, tasks=rows.sparkSession.sparkContext.defaultParallelism) // strip * strip)
        parts = max(1, -(-meta.nrows // height))
        dealt = dealt.withColumn("_p", F.floor(F.col("row") / height).cast("int")).repartitionById(parts, "_p").sortWithinPartitions("row").drop("_p")
    to = dealt.write.format("raster").mode(mode).options(meta=pickle.dumps(meta).hex(), layout=layout_of(meta, layout), rowsPerStrip=strip)
    to = to if isinstance(path, str) else to.option("paths", json.dumps(path))
    to.save(path if isinstance(path, str) else path[0])
