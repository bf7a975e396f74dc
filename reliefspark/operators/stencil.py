"""Gathers 3x3 neighbourhoods and evaluates focal functions over them.

Rows are dealt to strips with one row of halo on each side: one shuffle of whole
rows. Within a strip the rows above and below come by lag and lead of arrays, and
cells are unfolded last, in the same generated code that computes the functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefspark.functions.focal import Builder, Neighbourhood, focal_function, gradient_dx, gradient_dy
from reliefspark.meta import RasterMeta
from reliefspark.operators.strips import strip_rows, with_halo

LETTERS = "abcdefghi"


def fitting(rows: DataFrame, meta: RasterMeta) -> int:
    return strip_rows(meta.ncols, nrows=meta.nrows, tasks=rows.sparkSession.sparkContext.defaultParallelism)


def of_strips(rows: DataFrame, compute: Callable, schema: str) -> DataFrame:
    """``compute(rows' numbers, whether each is halo, cells as a matrix)`` of every strip, one in memory at a time; rows of a strip follow one another."""
    import numpy as np

    def whole(held: list):
        numbers = np.concatenate([b.column("row").to_numpy() for b in held])
        halo = np.concatenate([b.column("is_halo").to_numpy(zero_copy_only=False) for b in held])
        return compute(numbers, halo, np.concatenate([b.column("z").flatten().to_numpy(zero_copy_only=False) for b in held]).reshape(len(numbers), -1))

    def run(batches):
        held, at = [], None
        for batch in batches:
            strips = batch.column("strip").to_numpy()
            cuts = [0, *(np.flatnonzero(strips[1:] != strips[:-1]) + 1).tolist(), len(strips)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if held and strips[lo] != at:
                    yield whole(held)
                    held = []
                at = strips[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield whole(held)

    return rows.select("strip", "row", "is_halo", "z").mapInArrow(run, schema)


def three_rows(rows: DataFrame) -> DataFrame:
    """row, up, own and down of strips that come with their halo: no shuffle."""
    import numpy as np
    import pyarrow as pa

    def compute(numbers, halo, z):
        own = np.flatnonzero(~halo)
        offsets = np.arange(0, (len(own) + 1) * z.shape[1], z.shape[1], dtype=np.int32) if z.shape[1] else np.zeros(len(own) + 1, np.int32)
        lists = []
        for step in (-1, 0, 1):
            at = own + step
            none = (at < 0) | (at >= len(z))
            lists.append(pa.ListArray.from_arrays(offsets, pa.array(z[np.clip(at, 0, len(z) - 1)].ravel()), mask=pa.array(none)))
        return pa.RecordBatch.from_arrays([pa.array(numbers[own]), *lists], names=["row", "up", "own", "down"])

    return of_strips(rows, compute, "row long, up array<float>, own array<float>, down array<float>")


def gathered(cells: DataFrame, ncols: int, columns: list[str]) -> DataFrame:
    """row and an array of each column, of cells that come in order with all cells of a row: no shuffle."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        held: list = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= ncols:
                t = pa.Table.from_batches(held)
                n = len(t) // ncols
                whole, rest = t.slice(0, n * ncols).combine_chunks(), t.slice(n * ncols)
                row, col = (whole.column(c).to_numpy().reshape(n, ncols) for c in ("row", "col"))
                if (row != row[:, :1]).any() or (col != np.arange(ncols)).any():
                    raise ValueError("cells aren't in order")
                offsets = pa.array(np.arange(0, (n + 1) * ncols, ncols, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(row[:, 0]), *(pa.ListArray.from_arrays(offsets, whole.column(c).combine_chunks()) for c in columns)], names=["row", *columns])
                held = rest.combine_chunks().to_batches() if len(rest) else []
        if held:
            raise ValueError("a row has too few cells")

    cells = cells.select("row", "col", *(F.col(c).cast("float").alias(c) for c in columns))
    return cells.mapInArrow(run, ", ".join(["row long", *(f"{c} array<float>" for c in columns)]))


def neighbours(rows: DataFrame, meta: RasterMeta, height: int | None = None) -> DataFrame:
    """row, col and the raw cells a to i around each cell; null beyond the grid. Cells of a row come in order.

    Rows are shuffled once, by strip; strips of a source with their halo aren't.
    """
    if "strip" in rows.columns:
        three = three_rows(rows)
    else:
        within = Window.partitionBy("strip").orderBy("row")
        strips = with_halo(rows, meta.nrows, height or fitting(rows, meta))
        three = strips.select("row", F.col("z").alias("own"), "is_halo", F.lag("z").over(within).alias("up"), F.lead("z").over(within).alias("down")).where("not is_halo")
    cells = three.select("row", "up", "own", "down", F.posexplode("own").alias("col", "e"))
    beside = {x: F.get(line, F.col("col") + d).cast("double") for line, letters in (("up", "abc"), ("own", "d f"), ("down", "ghi")) for x, d in zip(letters, (-1, 0, 1), strict=True) if x != " "}
    return cells.select("row", "col", *((F.col("e").cast("double") if x == "e" else beside[x]).alias(x) for x in LETTERS))


def is_nodata(z: Column, meta: RasterMeta) -> Column:
    """Null, or the sentinel; NaN is a value."""
    return z.isNull() if meta.stored_nodata is None else z.isNull() | (z == F.lit(meta.stored_nodata))


def is_edge(meta: RasterMeta, boundary: str = "observed") -> Column:
    """Cells that never have a value: the first and last column, and the last row unless ``boundary`` is 'intended'."""
    side = F.col("col").isin(0, meta.ncols - 1)
    return side | (F.col("row") == meta.nrows - 1) if boundary == "observed" else side


def filled(raw: DataFrame, meta: RasterMeta, boundary: str = "observed") -> DataFrame:
    """Neighbours that are NODATA, beyond the grid or in a dropped last row become the centre; ``invalid`` marks cells without a value."""
    if boundary not in ("observed", "intended"):
        raise ValueError("boundary is 'observed' or 'intended'")
    last = (F.col("row") == meta.nrows - 2) if boundary == "observed" else F.lit(False)

    def fill(x: str) -> Column:
        hole = is_nodata(F.col(x), meta)
        return F.when(hole | last if x in "ghi" else hole, F.col("e")).otherwise(F.col(x)).alias(x)

    invalid = is_nodata(F.col("e"), meta) | is_edge(meta, boundary)
    return raw.select("row", "col", *(F.col("e") if x == "e" else fill(x) for x in LETTERS), invalid.alias("invalid"))


def evaluate(cells: DataFrame, meta: RasterMeta, functions: dict[str, Builder]) -> DataFrame:
    """row, col and a column for each function of filled neighbourhoods."""
    n = Neighbourhood(*(F.col(x) for x in LETTERS))
    graded = cells.select("row", "col", "invalid", *LETTERS, gradient_dx(n, meta.cellsize).alias("dz_dx_"), gradient_dy(n, meta.cellsize).alias("dz_dy_"))
    none = F.lit(meta.stored_nodata).cast("double")
    dx, dy = F.col("dz_dx_"), F.col("dz_dy_")
    return graded.select("row", "col", *(F.when(F.col("invalid"), none).otherwise(F.coalesce(f(n, dx, dy, meta), none)).alias(name) for name, f in functions.items()))


def focal(rows: DataFrame, meta: RasterMeta, functions: list[str] | dict[str, Builder], *, boundary: str = "observed", height: int | None = None) -> DataFrame:
    """Any number of functions from one scan: row, col and a column for each; names in a list are looked up in the registry."""
    built = functions if isinstance(functions, dict) else {f.lower(): focal_function(f) for f in functions}
    return evaluate(filled(neighbours(rows, meta, height), meta, boundary), meta, built)


def focal_strips(rows: DataFrame, meta: RasterMeta, names: list[str], *, boundary: str = "observed", height: int | None = None, single: bool = False) -> DataFrame:
    """The same by NumPy kernels: row, and an array for each name (numbered where a name comes twice), in single precision if asked."""
    import numpy as np
    import pyarrow as pa

    from reliefspark.functions.kernels import KERNELS, apply_kernels

    if unknown := [x for x in names if x.lower() not in KERNELS]:
        raise ValueError(f"unknown kernel {unknown[0]!r}; known are {', '.join(sorted(KERNELS))}")
    kernels, columns = [KERNELS[x.lower()] for x in names], [f"v{i}" for i in range(len(names))]
    kind = np.float32 if single else np.float64

    def compute(numbers, halo, z):
        own = np.flatnonzero(~halo)
        above, below = int(own[0]), len(numbers) - 1 - int(own[-1])
        values = apply_kernels(z, int(numbers[own[0]]), above, below, meta, kernels, boundary)
        offsets = np.arange(0, (len(own) + 1) * z.shape[1], z.shape[1], dtype=np.int32) if z.shape[1] else np.zeros(len(own) + 1, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(numbers[own]), *(pa.ListArray.from_arrays(offsets, v.astype(kind, copy=False).ravel()) for v in values)], names=["row", *columns])

    if "strip" not in rows.columns:  # a source that gives strips with their halo needs no shuffle
        rows = with_halo(rows, meta.nrows, height or fitting(rows, meta)).repartition("strip").sortWithinPartitions("strip", "row")
    return of_strips(rows, compute, ", ".join(["row long", *(f"{c} array<{'float' if single else 'double'}>" for c in columns)]))
