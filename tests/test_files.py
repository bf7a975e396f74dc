"""ASCII grids, TIFF variants, the sink, run() and the command line."""

import struct
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from reliefspark.functions.focal import register_focal
from reliefspark.meta import CELL_TYPES, RasterMeta
from reliefspark.operators import grid
from reliefspark.plans.run import layers, mosaic, run, zonal
from reliefspark.sources.raster import read_header, read_raster, write_raster
from reliefspark.streaming import process_folder
from tests.test_raster import HOLE, NAMES, N, frame, kernel_values


def grid_of(spark, path, **how):
    return np.array([r.z for r in read_raster(spark, str(path), **how)[0].orderBy("row").collect()])


HEAD = "ncols 6\nnrows 5\nxllcorner 10\nyllcorner 20.5\ncellsize 2\n"


@pytest.mark.parametrize("strip", [1, 2, 9])
@pytest.mark.parametrize("kind", ["plain", "crlf", "wrapped", "one line", "no nodata", "centers", "science"])
def test_ascii(spark, tmp_path, kind, strip):
    z = HOLE + 0.25
    z[2, 2] = N
    numbers = [[("%e" if kind == "science" else "%r") % float(v) for v in row] for row in z]
    body = "\n".join(" ".join(r) for r in numbers) + "\n"
    flat = [x for r in numbers for x in r]
    if kind == "wrapped":
        body = "\n".join(" ".join(flat[i : i + 4]) for i in range(0, 30, 4))
    if kind == "one line":
        body = "\t".join(flat)
    head = HEAD.replace("corner", "center") if kind == "centers" else HEAD
    text = head + ("" if kind == "no nodata" else "NODATA_value -9999\n") + body
    (tmp_path / "x.asc").write_bytes((text.replace("\n", "\r\n") if kind == "crlf" else text).encode())
    meta = read_header(str(tmp_path / "x.asc"))
    assert meta.header()[:4] == (6, 5, 2.0, None if kind == "no nodata" else -9999.0)
    assert meta.xllcorner == (9.0 if kind == "centers" else 10.0) and meta.geotransform[3] == meta.yllcorner + 10
    assert np.allclose(grid_of(spark, tmp_path / "x.asc", strip=strip), z)


@pytest.mark.parametrize("block", [5, 16, 1000])
def test_ascii_in_blocks(spark, tmp_path, monkeypatch, block):
    """Values that lie across the blocks of the index, rows that lines don't follow."""
    from reliefspark.sources import ascii_grid

    monkeypatch.setattr(ascii_grid, "INDEX_BLOCK", block)
    z = np.random.default_rng(3).integers(-5000, 99999, (40, 6)) / 4
    flat = [f"{v:g}" if i % 3 else f"{v:.3f}" for i, v in enumerate(z.ravel().tolist())]
    z = np.array(flat, float).reshape(z.shape)
    body = "".join(x + (" ", "\n", "  \r\n", "\t")[i % 4] for i, x in enumerate(flat))
    (tmp_path / "x.asc").write_text(f"ncols 6\nnrows 40\ncellsize 1\n{body}")
    path = str(tmp_path / "x.asc")
    meta, begin = ascii_grid.read_ascii_header(path)
    counts = [ascii_grid.count_values(path, begin, k) for k in range(ascii_grid.n_blocks(path, begin))]
    assert sum(counts) == 240
    for first in range(0, 40, 3):
        at, skip = ascii_grid.place_of(counts, first * 6)
        found = np.concatenate(list(ascii_grid.read_ascii_rows(path, meta, begin, at, skip, min(3, 40 - first))))
        assert np.array_equal(found, z[first : first + 3].astype(np.float32))


def test_ascii_index_by_tasks(spark, tmp_path):
    """A grid of several blocks of the index."""
    row = " ".join(str(k % 1000) for k in range(3000))
    (tmp_path / "x.asc").write_text("ncols 3000\nnrows 900\ncellsize 1\n" + "\n".join([row] * 900))
    from reliefspark.sources.raster import ascii_index

    counts = ascii_index(spark, str(tmp_path / "x.asc"))
    assert len(counts) == 3 and sum(counts) == 2_700_000
    got = read_raster(spark, str(tmp_path / "x.asc"), strip=100)[0].selectExpr("row", "size(z) as n", "aggregate(z, cast(0 as double), (a, x) -> a + x) as s").distinct().collect()
    assert {(r.n, r.s) for r in got} == {(3000, sum(k % 1000 for k in range(3000)))} and len(got) == 900


def test_broken_ascii(spark, tmp_path):
    (tmp_path / "x.asc").write_text(HEAD + "1 2 3")
    with pytest.raises(Exception, match="values, the header says 30|rows from byte"):
        grid_of(spark, tmp_path / "x.asc", strip=1)
    (tmp_path / "y.asc").write_text("nrows 3\n1 2 3")
    with pytest.raises(ValueError, match="no ncols"):
        read_header(str(tmp_path / "y.asc"))


def tiff(z, kind, order="<", big=False, tiled=False, deflate=False, predictor=1, rows=2):
    """A file by the book, apart from the writer under test."""
    rows_, cols = z.shape
    fmt, bits = {"u": 1, "i": 2, "f": 3}[kind[0]], int(kind[1]) * 8
    blocks = []
    for r in range(0, rows_, 16 if tiled else rows):
        for c in range(0, cols, 16 if tiled else cols):
            b = z[r : r + (16 if tiled else rows), c : c + (16 if tiled else cols)]
            b = np.pad(b, ((0, 16 - b.shape[0]), (0, 16 - b.shape[1]))) if tiled else b
            b = b.astype(order + kind)
            if predictor == 2:
                b = np.diff(b, axis=1, prepend=b[:, :1] * 0).astype(order + kind)
            blocks.append(zlib.compress(b.tobytes()) if deflate else b.tobytes())
    word, entry = ("Q", 20) if big else ("I", 12)
    data = b"".join(blocks)
    head = (b"II" if order == "<" else b"MM") + (struct.pack(f"{order}HHHQ", 43, 8, 0, 16 + len(data)) if big else struct.pack(f"{order}HI", 42, 8 + len(data)))
    at = np.cumsum([len(head), *map(len, blocks)])[:-1].tolist()
    tags = [(256, 4, [cols]), (257, 4, [rows_]), (258, 3, [bits]), (259, 3, [8 if deflate else 1]), (277, 3, [1]), (317, 3, [predictor]), (339, 3, [fmt])]
    tags += [(322, 3, [16]), (323, 3, [16]), (324, 4, at), (325, 4, list(map(len, blocks)))] if tiled else [(273, 4, at), (278, 3, [rows]), (279, 4, list(map(len, blocks)))]
    tags += [(33550, 12, [2.0, 2.0, 0.0]), (33922, 12, [0, 0, 0, 10.0, 30.5, 0]), (42113, 2, b"-9999\0")]
    extra, out = b"", b""
    base = len(head) + len(data) + (8 if big else 2) + entry * len(tags) + (8 if big else 4)
    for tag, t, v in sorted(tags):
        raw = v if t == 2 else struct.pack(f"{order}{len(v)}{ {3: 'H', 4: 'I', 12: 'd'}[t]}", *v)
        room = 8 if big else 4
        place = raw.ljust(room, b"\0") if len(raw) <= room else struct.pack(f"{order}{word}", base + len(extra))
        extra += b"" if len(raw) <= room else raw + b"\0" * (-len(raw) % 8)
        out += struct.pack(f"{order}HH{word}", tag, t, len(v)) + place
    return head + data + struct.pack(f"{order}{'Q' if big else 'H'}", len(tags)) + out + struct.pack(f"{order}{word}", 0) + extra


@pytest.mark.parametrize("kind", [c for c, _ in CELL_TYPES.values()])
@pytest.mark.parametrize("how", [{}, {"order": ">"}, {"big": True}, {"big": True, "order": ">"}, {"deflate": True}, {"tiled": True}, {"tiled": True, "deflate": True}, {"deflate": True, "predictor": 2}])
def test_tiff(tmp_path, kind, how):
    from reliefspark.sources.tiff import read_layout, read_tiff_rows

    if how.get("predictor") == 2 and kind[0] == "f":
        pytest.skip("predictor 2 is for integers")
    z = np.arange(37 * 21).reshape(37, 21) % 120
    z = z - 50 if kind[0] != "u" else z
    (tmp_path / "x.tif").write_bytes(tiff(z, kind, **how))
    layout = read_layout(str(tmp_path / "x.tif"))
    assert layout.meta.header()[:4] == (21, 37, 2.0, -9999.0) and layout.meta.geotransform == (10.0, 2.0, 0.0, 30.5, 0.0, -2.0)
    for lo, hi in ((0, 37), (5, 20), (36, 37)):
        parts = list(read_tiff_rows(str(tmp_path / "x.tif"), layout, lo, hi))
        assert [p[0] for p in parts][0] == lo and np.array_equal(np.concatenate([p[1] for p in parts]), z[lo:hi].astype(np.float32))


def test_tiff_scan(spark, tmp_path):
    z = np.arange(37 * 21).reshape(37, 21)
    (tmp_path / "x.tif").write_bytes(tiff(z, "i4", tiled=True))
    assert np.array_equal(grid_of(spark, tmp_path / "x.tif", strip=5), z)
    rows, _ = read_raster(spark, str(tmp_path / "x.tif"), strip=5)
    assert [r.row for r in rows.where("row >= 7 and row < 9 and row <> 8").collect()] == [7]
    halo = read_raster(spark, str(tmp_path / "x.tif"), halo=True, strip=10)[0]
    assert sorted(r.row for r in halo.where("is_halo and strip = 1").collect()) == [9, 20]
    with pytest.raises(ValueError, match="not a TIFF"):
        (tmp_path / "y.tif").write_bytes(b"nothing")
        read_header(str(tmp_path / "y.tif"))


@pytest.mark.parametrize("layout", ["single", "tiles"])
def test_sink(spark, tmp_path, layout):
    z = np.random.default_rng(1).normal(size=(53, 7)).astype(np.float32)
    meta = RasterMeta(7, 53, 2.0, N, 100.0, 94.0, (100.0, 2.0, 0.0, 200.0, 0.0, -2.0), "a place")
    out = str(tmp_path / "x.tif")
    for _ in range(2):  # the second overwrites
        write_raster(frame(spark, z).repartition(3), out, meta, layout=layout, rows_per_strip=4)
    if layout == "single":
        assert read_header(out) == meta and np.array_equal(grid_of(spark, out, strip=6), z)
        with pytest.raises(Exception, match="x.tif"):
            write_raster(frame(spark, z), out, meta, mode="append")
    else:
        tiles = sorted(Path(out).iterdir())
        assert np.array_equal(np.concatenate([grid_of(spark, t) for t in tiles]), z) and read_header(str(tiles[0])).geotransform[3] == 200.0
        assert len(tiles) > 1 and read_header(out) == meta
        for strip in (1, 6, 100):
            assert np.array_equal(grid_of(spark, out, strip=strip), z)
        assert np.array_equal([r.z for r in read_raster(spark, out)[0].where("row >= 15 and row < 18").orderBy("row").collect()], z[15:18])
    assert not list(tmp_path.glob("*.parts*"))
    with pytest.raises(Exception, match="don't make up|aren't in order"):
        write_raster(frame(spark, z).where("row <> 9 and row < 50"), str(tmp_path / "gap.tif"), meta)


def test_run(spark, tmp_path):
    z = np.random.default_rng(2).integers(0, 90, (23, 8)).astype(float)
    z[4, 4] = N
    source = str(tmp_path / "dem.tif")
    meta = RasterMeta(8, 23)
    write_raster(frame(spark, z), source, meta)
    outs = [str(tmp_path / f"o{i}.tif") for i in range(4)]
    assert run(spark, source, outs, ["slope", "Aspect", "hillshade", "slope"], strip=5, views=["a", "b"]) > 0
    want = kernel_values(z, meta)
    for out, n in zip(outs, [*NAMES, "slope"], strict=True):
        assert np.allclose(grid_of(spark, out), want[n].astype(np.float32))
    assert spark.table("b").count() == 23
    register_focal("twice_dx", lambda n, dx, dy, m: 2 * dx)
    run(spark, source, outs[:2], ["twice_dx", "slope"])
    assert np.allclose(grid_of(spark, outs[1]), want["slope"].astype(np.float32))
    for outputs, functions in ((outs[:1], ["slope", "aspect"]), ([], []), (outs[:1], ["none"])):
        with pytest.raises(ValueError):
            run(spark, source, outputs, functions)


def test_run_over_a_table(spark, tmp_path):
    frame(spark, HOLE).createOrReplaceTempView("hole")
    assert "hole" in layers(spark)
    out, meta = str(tmp_path / "t.tif"), RasterMeta(6, 5)
    run(spark, spark.table("hole"), [out], ["hillshade"], meta=meta, strip=2, layout="single")
    assert np.allclose(grid_of(spark, out), kernel_values(HOLE, meta)["hillshade"].astype(np.float32))
    with pytest.raises(ValueError, match="header"):
        run(spark, spark.table("hole"), [out], ["slope"])


def test_zonal_and_mosaic(spark):
    both = mosaic([frame(spark, HOLE), frame(spark, HOLE + 1)])
    assert grid.dimensions(both).nrows == 10
    cells = grid.cells_from_rows(both)
    zones = cells.select("row", "col", (F.col("row") >= 5).alias("zone"))
    found = {r.zone: r for r in zonal(cells, zones, "z").collect()}
    assert found[True].n == 30 and found[True].hi == 6.0 and found[False].lo == N


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    write_raster(frame(spark, HOLE), str(tmp_path / "in" / "a.tif"), RasterMeta(6, 5))
    done = []
    for _ in range(2):
        process_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), ["slope"], str(tmp_path / "check"), done=done.append).awaitTermination()
    assert len(done) == 1 and np.allclose(grid_of(spark, tmp_path / "out" / "a_slope.tif"), kernel_values(HOLE, RasterMeta(6, 5))["slope"].astype(np.float32))


def test_command_line(tmp_path):
    (tmp_path / "x.asc").write_text(HEAD + "\n".join(" ".join(map(str, r)) for r in HOLE))
    go = lambda *a: subprocess.run([sys.executable, "-m", "reliefspark", *a], capture_output=True, text=True, timeout=120, cwd=Path(__file__).parents[1], env={**__import__("os").environ, "SPARK_LOCAL_DIRS": str(tmp_path)})
    assert go("x").returncode == 2
    out = str(tmp_path / "s.tif")
    done = go(str(tmp_path / "x.asc"), out, "SLOPE")
    assert done.returncode == 0 and "1 outputs" in done.stdout and read_header(out).ncols == 6
    assert go(str(tmp_path / "x.asc"), out, "other").returncode == 1


def exchanges(spark, job):
    """Shuffles in the plans of the queries that ``job`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    job()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    runs = [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    return sum(r.physicalPlanDescription().count("Exchange") for r in runs if r.executionId() not in before)


def test_no_shuffle_from_file_to_file(spark, tmp_path):
    """Several functions, with kernels and without: one job, no exchange, the same values as from a table."""
    z = np.random.default_rng(3).integers(0, 90, (61, 9)).astype(float)
    z[4, 4] = N
    source, meta = str(tmp_path / "dem.tif"), RasterMeta(9, 61)
    write_raster(frame(spark, z), source, meta)
    register_focal("corners", lambda n, dx, dy, m: n.a + n.i - n.c - n.g + dy)
    outs = [str(tmp_path / f"o{i}.tif") for i in range(3)]
    again = [str(tmp_path / f"t{i}.tif") for i in range(3)]
    for functions in (["slope", "hillshade", "mean"], ["corners", "slope", "corners"]):
        assert exchanges(spark, lambda f=functions: run(spark, source, outs, f, strip=7)) == 0
        run(spark, frame(spark, z).repartition(3), again, functions, meta=meta, strip=5)
        assert all(np.allclose(grid_of(spark, a), grid_of(spark, b), atol=1e-5) for a, b in zip(outs, again, strict=True))
    assert exchanges(spark, lambda: write_raster(frame(spark, z), outs[0], meta)) > 0


def test_tiles_above_a_size(spark, tmp_path, monkeypatch):
    from reliefspark.sources import raster

    source, meta = str(tmp_path / "dem.tif"), RasterMeta(6, 5)
    monkeypatch.setattr(raster, "TILES_FROM", 6 * 5 * 4 + 1)
    write_raster(frame(spark, HOLE), source, meta)
    assert Path(source).is_file()
    monkeypatch.setattr(raster, "TILES_FROM", 6 * 5 * 4)
    for _ in range(2):  # a folder takes the place of a file, and of a folder
        write_raster(frame(spark, HOLE), source, meta)
        assert Path(source).is_dir()
    write_raster(frame(spark, HOLE), source, meta, layout="single")
    assert Path(source).is_file() and np.array_equal(grid_of(spark, source), HOLE.astype(np.float32))
    with pytest.raises(ValueError, match="layout"):
        write_raster(frame(spark, HOLE), source, meta, layout="none")


def test_an_abort_leaves_nothing(spark, tmp_path):
    out, meta = str(tmp_path / "x.tif"), RasterMeta(6, 5)
    write_raster(frame(spark, HOLE), out, meta)
    bad = frame(spark, HOLE).withColumn("z", F.when(F.col("row") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("z")))
    with pytest.raises(Exception, match="lost"):
        write_raster(bad, out, meta)
    assert np.array_equal(grid_of(spark, out), HOLE.astype(np.float32)) and [p.name for p in tmp_path.iterdir()] == ["x.tif"]
