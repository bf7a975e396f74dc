"""Golden rasters, a float32 model of the kernel, invariances, edges, and plans."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reliefspark.functions.focal import register_focal
from reliefspark.functions.kernels import KERNELS, apply_kernels
from reliefspark.meta import RasterMeta, file_type, output_path
from reliefspark.operators import grid, stencil, strips

N = -9999.0
NAMES = ["slope", "aspect", "hillshade"]


def frame(spark, z):
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(np.asarray(z))], "row long, z array<double>")


def values(df, names, shape):
    out = {n: np.full(shape, np.inf) for n in names}
    for r in df.collect():
        for n in names:
            out[n][r.row, r.col] = r[n]
    return out


def focal(spark, z, names=NAMES, meta=None, **how):
    z = np.asarray(z)
    return values(stencil.focal(frame(spark, z), meta or RasterMeta(z.shape[1], z.shape[0]), names, **how), names, z.shape)


def model(z, cell=1.0, nodata=N):
    """The functions cell by cell in single precision; the last row is missing and its values too."""
    z = np.asarray(z, np.float32)
    rows, cols = z.shape
    out = {n: np.full((rows, cols), nodata, np.float32) for n in NAMES}
    for r in range(rows - 1):
        for c in range(1, cols - 1):
            e = z[r, c]
            if e == nodata:
                continue
            v = {}
            for k, x in enumerate("abcdefghi"):
                i, j = r + k // 3 - 1, c + k % 3 - 1
                v[x] = e if i < 0 or i >= rows - 1 or z[i, j] == nodata else z[i, j]
            dx = np.float32((v["c"] + 2 * v["f"] + v["i"] - (v["a"] + 2 * v["d"] + v["g"])) / (8 * cell))
            dy = np.float32((v["g"] + 2 * v["h"] + v["i"] - (v["a"] + 2 * v["b"] + v["c"])) / (8 * cell))
            slope = math.atan(math.hypot(dx, dy))
            out["slope"][r, c] = slope
            if dx or dy:
                deg = np.float32(57.29578 * math.atan2(dy, -dx))
                out["aspect"][r, c] = (360 - deg + 90 if deg > 90 else 90 - deg) * math.pi / 180
            angle = math.atan2(dy, -dx)
            angle += 2 * math.pi * (angle < 0)
            out["hillshade"][r, c] = max(0, 255 * (math.cos(math.pi / 4) * math.cos(slope) + math.sin(math.pi / 4) * math.sin(slope) * math.cos(math.radians(135) - angle)))
    return out


PLANE_E, PLANE_S = np.tile(np.arange(6.0), (5, 1)), np.tile(np.arange(5.0)[:, None], (1, 6))
HOLE = PLANE_E.copy()
HOLE[2, 2] = N
GOLDEN = [
    (PLANE_E, [[0.643501] * 4, [0.785398] * 4, [0.785398] * 4, [0.643501] * 4], [[4.712389] * 4] * 4, [[220.74979] * 4, [217.6561] * 4, [217.6561] * 4, [220.74979] * 4]),
    (PLANE_S, [[0.463648] * 4, [0.785398] * 4, [0.785398] * 4, [0.463648] * 4], [[0.0] * 4] * 4, [[218.2959] * 4, [217.6561] * 4, [217.6561] * 4, [218.2959] * 4]),
    (np.full((5, 6), 7.0), [[0.0] * 4] * 4, [[N] * 4] * 4, [[180.31223] * 4] * 4),
    (
        HOLE,
        [[0.643501] * 4, [0.723839, 0.785398, 0.723839, 0.785398], [0.643501, N, 0.643501, 0.785398], [0.567450, 0.643501, 0.567450, 0.643501]],
        [[4.712389] * 4, [4.570491, 4.712389, 4.854287, 4.712389], [4.712389, N, 4.712389, 4.712389], [4.909785, 4.712389, 4.514993, 4.712389]],
        [[220.74979] * 4, [206.7511, 217.6561, 230.63406, 217.6561], [220.74979, N, 220.74979, 217.6561], [232.69069, 220.74979, 205.81134, 220.74979]],
    ),
]


@pytest.mark.parametrize("k", range(4))
@pytest.mark.parametrize("height", [1, 2, 5])
def test_golden(spark, k, height):
    z, *want = GOLDEN[k]
    got = focal(spark, z, height=height)
    for name, inner in zip(NAMES, want, strict=True):
        full = np.full(z.shape, N)
        full[:4, 1:5] = inner
        assert np.allclose(got[name], full, atol=6e-4 if name == "hillshade" else 2e-6)


def kernel_values(z, meta, names=NAMES, height=None, boundary="observed"):
    z, parts = np.asarray(z, float), []
    height = height or len(z)
    for first in range(0, len(z), height):
        last = min(len(z), first + height)
        above, below = int(first > 0), int(last < len(z))
        parts.append(apply_kernels(z[first - above : last + below], first, above, below, meta, [KERNELS[n] for n in names], boundary))
    return {n: np.concatenate([p[i] for p in parts]) for i, n in enumerate(names)}


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 7), st.integers(1, 7), st.integers(0, 2**32 - 1))
def test_kernels_against_the_model(rows, cols, seed):
    rng = np.random.default_rng(seed)
    z = rng.integers(0, 5, (rows, cols)).astype(float)
    z[rng.random((rows, cols)) < 0.2] = N
    got, want = kernel_values(z, RasterMeta(cols, rows), height=int(rng.integers(1, 4))), model(z)
    for n in NAMES:
        assert ((got[n] == N) == (want[n] == N)).all()
        gap = np.abs(got[n] - want[n])
        gap = np.minimum(gap, np.abs(2 * np.pi - gap)) if n == "aspect" else gap
        assert gap.max(initial=0) < (2e-3 if n == "hillshade" else 1e-4)


@pytest.mark.parametrize("shape", [(1, 1), (1, 5), (2, 4), (3, 2), (3, 3), (9, 12)])
@pytest.mark.parametrize("boundary", ["observed", "intended"])
def test_columns_and_kernels_agree(spark, shape, boundary):
    rng = np.random.default_rng(sum(shape))
    z = rng.normal(size=shape).round(2) * 40
    z[rng.random(shape) < 0.2] = N
    meta = RasterMeta(shape[1], shape[0], cellsize=2.5)
    got = focal(spark, z, meta=meta, boundary=boundary, height=2)
    want = kernel_values(z, meta, boundary=boundary)
    table = stencil.focal_strips(frame(spark, z), meta, NAMES, boundary=boundary, height=2).orderBy("row").collect()
    for k, n in enumerate(NAMES):
        assert np.allclose(got[n], want[n], atol=1e-9, equal_nan=True)
        assert np.allclose(np.array([r[f"v{k}"] for r in table]), want[n])
    assert boundary == "intended" or (got["slope"][-1] == N).all()


def test_invariance(spark):
    rng = np.random.default_rng(3)
    z = rng.integers(0, 50, (8, 9)).astype(float)
    base = focal(spark, z)
    moved, turned = focal(spark, z + 1000), focal(spark, -z)
    for n in NAMES:
        assert np.allclose(base[n], moved[n], atol=1e-9)
    assert np.allclose(base["slope"], turned["slope"])
    ok = base["aspect"] != N
    gap = np.abs(base["aspect"] - turned["aspect"])[ok]
    assert np.allclose(gap, np.pi, atol=1e-4)


def test_nodata_values(spark):
    z = np.array([[1.0, 2, 3, 4], [5, 0, 7, 8], [2, 4, 6, 9], [1, 1, 1, 1]])
    zero = focal(spark, z, meta=RasterMeta(4, 4, nodata=0.0))
    assert zero["slope"][1, 1] == 0.0 and zero["slope"][1, 2] > 0
    flat = focal(spark, np.tile(np.arange(4.0), (4, 1)) + 1, meta=RasterMeta(4, 4, nodata=0.0))
    assert (flat["aspect"][1, 1:3] == 0.0).all()  # dz_dy is 0, which is NODATA here
    rounded = np.where(z == 0, np.float32(0.1), z)
    assert focal(spark, rounded, meta=RasterMeta(4, 4, nodata=0.1))["slope"][1, 1] == np.float32(0.1)
    nan = z.copy()
    nan[1, 1] = np.nan
    assert math.isnan(focal(spark, nan)["hillshade"][1, 2])
    rows = spark.createDataFrame([(0, [1.0, 2.0, None, 4.0]), (1, [2.0, 3.0, 4.0, 5.0]), (2, [0.0] * 4)], "row long, z array<double>")
    got = stencil.focal(rows, RasterMeta(4, 3, nodata=None), ["slope"]).collect()
    assert {(r.row, r.col): r.slope for r in got}[0, 2] is None and {(r.row, r.col): r.slope for r in got}[0, 1] > 0
    assert (focal(spark, np.full((4, 4), N))["slope"] == N).all()


def test_registry(spark):
    register_focal("Range9", lambda n, dx, dy, m: n.i - n.a + m.cellsize)
    z = np.arange(30.0).reshape(5, 6)
    assert focal(spark, z, ["range9"])["range9"][1, 1] == 15.0
    with pytest.raises(ValueError, match="unknown function"):
        stencil.focal(frame(spark, z), RasterMeta(6, 5), ["nothing"])
    with pytest.raises(ValueError, match="unknown kernel"):
        stencil.focal_strips(frame(spark, z), RasterMeta(6, 5), ["nothing"])


def test_grid(spark):
    cells = grid.cells_from_rows(frame(spark, HOLE))
    assert [r.z for r in grid.rows_from_cells(cells).orderBy("row").collect()] == HOLE.tolist()
    assert grid.dimensions(frame(spark, HOLE)).header()[:2] == (6, 5)
    with pytest.raises(ValueError, match="not a dense raster"):
        grid.dimensions(frame(spark, HOLE).where("row <> 2"))


def test_names():
    assert [file_type(x) for x in ("a.ASC", "b.tif", "x.asc.tiff")] == ["asc", "tif", "tif"]
    with pytest.raises(ValueError, match="unsupported"):
        file_type("dir.tif/readme")
    assert output_path("/o/", "/in/dem.v2.asc", "Slope") == "/o/dem.v2_slope.tif"


def test_plans(spark):
    rows = frame(spark, HOLE)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(stencil.focal(rows, RasterMeta(6, 5), NAMES))
    assert "SinglePartition" not in text and "Cartesian" not in text and text.count("Exchange") == 1
    pruned = plan(stencil.focal(rows, RasterMeta(6, 5), NAMES).select("row", "slope"))
    assert "ATAN2" not in pruned and "COS" not in pruned
    assert strips.strip_rows(100_000) < strips.strip_rows(1000)
