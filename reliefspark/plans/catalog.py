"""Queries over the driver's tables, one for each operator, and the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefspark.functions.focal import register_focal
from reliefspark.meta import RasterMeta, output_path
from reliefspark.operators import grid, stencil, strips
from reliefspark.plans.run import command, run
from reliefspark.sources.ascii_grid import ascii_text
from reliefspark.sources.files import scratch_dir, store_of
from reliefspark.sources.raster import read_header, read_raster, write_raster

NODATA, STRIP = -9999.0, 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev_cells(spark, sf_dir) -> DataFrame:
    z = F.when(F.col("event_type") == "error", F.lit(NODATA)).otherwise(F.col("value"))
    return grid.from_linear_id(_table(spark, sf_dir, "events"), "event_id", 100, z)


def ev(spark, sf_dir) -> tuple[DataFrame, RasterMeta]:
    rows = grid.rows_from_cells(ev_cells(spark, sf_dir))
    last = _table(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    return rows, RasterMeta(100, last // 100 + 1)


def emb(spark, sf_dir) -> tuple[DataFrame, RasterMeta]:
    rows = grid.from_arrays(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return rows, grid.dimensions(rows)


def part_rows(spark, sf_dir) -> tuple[DataFrame, RasterMeta]:
    cells = grid.from_linear_id(_table(spark, sf_dir, "part"), "p_partkey", 50, F.col("p_retailprice"))
    rows = grid.rows_from_cells(cells)
    return rows, grid.dimensions(rows)


def rc(df: DataFrame, *columns: Column) -> DataFrame:
    return df.select(F.col("row").cast("long").alias("r"), F.col("col").cast("long").alias("c"), *columns)


def six(name: str, out: str | None = None) -> Column:
    """Rounded to six places, with one zero: -0.0 is 0.0."""
    rounded = F.round(F.col(name), 6)
    return F.when(rounded == 0, F.lit(0.0)).otherwise(rounded).alias(out or name)


def focal_query(source: Callable, functions: list[str], names: list[str]) -> Callable:
    def query(spark, sf_dir):
        rows, meta = source(spark, sf_dir)
        found = stencil.focal(rows, meta, functions)
        return rc(found, *(six(f, n) for f, n in zip(functions, names, strict=True)))

    return query


def scan_rows(spark, sf_dir):
    rows, _ = emb(spark, sf_dir)
    return rows.select(F.col("row").alias("r"), F.size("z").cast("long").alias("n"), F.round(F.get("z", F.lit(0)), 6).alias("z_first"), F.round(F.element_at("z", -1), 6).alias("z_last"))


def grid_from_linear_id(spark, sf_dir):
    return rc(ev_cells(spark, sf_dir), six("z"))


def raster_from_cells(spark, sf_dir):
    cells = grid.from_linear_id(_table(spark, sf_dir, "orders"), "o_orderkey", 100, F.col("o_totalprice"))
    rows = grid.rows_from_cells(cells)
    return rows.select(F.col("row").alias("r"), F.round(F.aggregate("z", F.lit(0.0), lambda a, x: a + x), 2).alias("z_sum"))


def raster_header(spark, sf_dir):
    rows, meta = ev(spark, sf_dir)
    header = grid.header_frame(spark, "ev", meta)
    cells = grid.cells_from_rows(rows).agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(stencil.is_nodata(F.col("z"), meta)).alias("n_nodata"))
    return header.select(F.col("ncols").cast("long").alias("ncols"), "nrows", "cellsize", "nodata").crossJoin(F.broadcast(cells))  # one row each


def strip_assignment(spark, sf_dir):
    rows, _ = ev(spark, sf_dir)
    return rows.groupBy(strips.strip_of(F.col("row"), STRIP).alias("strip")).agg(F.min("row").alias("r_min"), F.max("row").alias("r_max"), F.count(F.lit(1)).alias("n_rows"))


def halo_exchange(spark, sf_dir):
    rows, meta = ev(spark, sf_dir)
    return strips.with_halo(rows, meta.nrows, STRIP).select("strip", F.col("row").alias("r"), "is_halo")


def pad_top(spark, sf_dir):
    rows, meta = ev(spark, sf_dir)
    return rc(stencil.focal(rows.where("row <= 1"), meta, ["slope"]).where("row = 0"), six("slope")).drop("r")


def pad_bottom(spark, sf_dir):
    rows, meta = ev(spark, sf_dir)
    near = rows.where(F.col("row") >= meta.nrows - 3)
    return rc(stencil.focal(near, meta, ["slope"]).where(F.col("row") >= meta.nrows - 2), six("slope"))


def edge_mask(spark, sf_dir):
    rows, meta = ev(spark, sf_dir)
    return rc(grid.cells_from_rows(rows), stencil.is_edge(meta).alias("is_edge"))


def nodata_mask(spark, sf_dir):
    rows, meta = ev(spark, sf_dir)
    return rc(grid.cells_from_rows(rows), stencil.is_nodata(F.col("z"), meta).alias("is_nodata"))


def neighborhood_3x3(spark, sf_dir):
    rows, meta = emb(spark, sf_dir)
    raw = stencil.neighbours(rows, meta).withColumnRenamed("c", "c3")
    return rc(raw, *(six("c3" if x == "c" else x) for x in "abcdefghi"))


def nodata_fill(spark, sf_dir):
    rows, meta = ev(spark, sf_dir)
    full = stencil.filled(stencil.neighbours(rows, meta), meta).where("not invalid").withColumnRenamed("c", "c3")
    return rc(full, *(six("c3" if x == "c" else x) for x in "abcdefghi"))


def custom_focal_pandas(spark, sf_dir):
    rows, meta = ev(spark, sf_dir)
    found = stencil.focal_strips(rows, meta, ["laplacian"], height=STRIP)
    return rc(found.select("row", F.posexplode("v0").alias("col", "value")), six("value"))


def _file_cells(spark, path: str) -> DataFrame:
    rows, _ = read_raster(spark, path, strip=8)
    return rc(grid.cells_from_rows(rows), F.round(F.col("z").cast("double"), 3).alias("z"))


def _ascii(spark, sf_dir, path: str) -> RasterMeta:
    rows, meta = part_rows(spark, sf_dir)
    # a small fixture that is made into one text file; reading it is what is asked
    z = np.array([r.z for r in rows.orderBy("row").toLocalIterator()])
    store, name = store_of(path)
    with store.open_output_stream(name) as f:
        f.write(ascii_text(meta, z).encode())
    return meta


def scan_ascii_grid(spark, sf_dir):
    path = f"{scratch_dir(spark)}/part.asc"
    _ascii(spark, sf_dir, path)
    return _file_cells(spark, path)


def scan_geotiff(spark, sf_dir):
    rows, meta = part_rows(spark, sf_dir)
    path = f"{scratch_dir(spark)}/part.tif"
    write_raster(rows, path, meta)
    return _file_cells(spark, path)


def sink_geotiff_roundtrip(spark, sf_dir):
    rows, meta = part_rows(spark, sf_dir)
    path = f"{scratch_dir(spark)}/part_strips.tif"
    write_raster(rows, path, meta, rows_per_strip=3)
    write_raster(read_raster(spark, path)[0], path.replace("strips", "again"), meta, rows_per_strip=7)
    return _file_cells(spark, path.replace("strips", "again"))


def scan_format_dispatch(spark, sf_dir):
    folder = scratch_dir(spark)
    asc, tif = f"{folder}/both.asc", f"{folder}/both.tif"
    meta = _ascii(spark, sf_dir, asc)
    write_raster(read_raster(spark, asc)[0], tif, meta)
    both = [_file_cells(spark, p).withColumn("format", F.lit(p[-3:])) for p in (asc, tif)]
    return both[0].unionByName(both[1])


def run_slope_file(spark, sf_dir):
    """The whole way from a file to a file: scan with halo, kernel, sink, scan."""
    rows, meta = part_rows(spark, sf_dir)
    folder = scratch_dir(spark)
    source, out = f"{folder}/in.tif", output_path(folder, "in.tif", "slope")
    write_raster(rows, source, meta)
    run(spark, source, [out], ["slope"], strip=8)
    return _file_cells(spark, out)


def _part_file(spark, sf_dir) -> tuple[str, str]:
    rows, meta = part_rows(spark, sf_dir)
    folder = scratch_dir(spark)
    write_raster(rows, f"{folder}/in.tif", meta)
    return folder, f"{folder}/in.tif"


def _outputs(spark, found: dict[str, str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [_file_cells(spark, path).withColumn("output", F.lit(name)) for name, path in found.items()])


def run_three_outputs(spark, sf_dir):
    """Three functions from one scan to three files."""
    folder, source = _part_file(spark, sf_dir)
    outs = {f: output_path(folder, source, f) for f in ("slope", "aspect", "hillshade")}
    run(spark, source, list(outs.values()), list(outs), strip=8)
    return _outputs(spark, outs)


def run_views(spark, sf_dir):
    """Results as views, and a view as input: the slope of a slope."""
    folder, source = _part_file(spark, sf_dir)
    outs = {f: output_path(folder, source, f) for f in ("slope", "mean")}
    names = {f: f"{f}_{uuid.uuid4().hex}" for f in outs}
    run(spark, source, list(outs.values()), list(outs), views=list(names.values()))
    both = [rc(grid.cells_from_rows(spark.table(n)), F.round(F.col("z").cast("double"), 3).alias("z"), F.lit(f).alias("output")) for f, n in names.items()]
    return both[0].unionByName(both[1])


def run_command_line(spark, sf_dir):
    """The same through the command line's function, in the session that there is."""
    folder, source = _part_file(spark, sf_dir)
    outs = {f: output_path(folder, source, f) for f in ("aspect", "hillshade")}
    args = [x for f, path in outs.items() for x in (path, f.upper())]
    if command([source, *args], spark):
        raise RuntimeError("the command failed")
    return _outputs(spark, outs)


def run_user_function(spark, sf_dir):
    """A function that has no kernel, as a Column, from a file to a file without a shuffle of cells."""
    register_focal("corner_drop", lambda n, dx, dy, meta: n.i - n.a + dx)
    folder, source = _part_file(spark, sf_dir)
    run(spark, source, [f"{folder}/out.tif"], ["corner_drop"], strip=8)
    return _file_cells(spark, f"{folder}/out.tif")


def sink_tiles_roundtrip(spark, sf_dir):
    """A folder of tiles, read as one raster and through a halo."""
    folder, source = _part_file(spark, sf_dir)
    write_raster(read_raster(spark, source, strip=8)[0], f"{folder}/tiles.tif", read_header(source), layout="tiles", rows_per_strip=4)
    run(spark, f"{folder}/tiles.tif", [f"{folder}/out.tif"], ["slope"], strip=6, layout="tiles")
    return _outputs(spark, {"z": f"{folder}/tiles.tif", "slope": f"{folder}/out.tif"})


def queries() -> dict:
    both = {}
    for f in ("slope", "aspect", "hillshade"):
        both[f] = focal_query(emb, [f], [f])
        both[f"{f}_holes"] = focal_query(ev, [f], [f])
    return both | {
        "scan_rows": scan_rows, "grid_from_linear_id": grid_from_linear_id, "raster_from_cells": raster_from_cells, "raster_header": raster_header, "strip_assignment": strip_assignment, "halo_exchange": halo_exchange,
        "pad_top": pad_top, "pad_bottom": pad_bottom, "edge_mask": edge_mask, "neighborhood_3x3": neighborhood_3x3, "nodata_mask": nodata_mask, "nodata_fill": nodata_fill,
        "gradient_dx": focal_query(ev, ["dz_dx"], ["dz_dx"]), "gradient_dy": focal_query(ev, ["dz_dy"], ["dz_dy"]), "hillshade_aspect": focal_query(ev, ["hillshade_aspect"], ["hasp"]),
        "multi_function": focal_query(ev, ["slope", "aspect", "hillshade"], ["slope", "aspect", "hillshade"]), "custom_focal_mean": focal_query(ev, ["mean"], ["value"]), "custom_focal_laplacian": focal_query(ev, ["laplacian"], ["value"]), "custom_focal_pandas": custom_focal_pandas,
        "scan_ascii_grid": scan_ascii_grid, "scan_geotiff": scan_geotiff, "sink_geotiff_roundtrip": sink_geotiff_roundtrip, "scan_format_dispatch": scan_format_dispatch, "run_slope_file": run_slope_file,
        "run_three_outputs": run_three_outputs, "run_views": run_views, "run_command_line": run_command_line, "run_user_function": run_user_function, "sink_tiles_roundtrip": sink_tiles_roundtrip,
    }


EV = "SELECT event_id // 100 AS r, event_id % 100 AS c, CASE WHEN event_type = 'error' THEN -9999.0 ELSE value END::DOUBLE AS z FROM events"
EMB = "SELECT vec_id AS r, i - 1 AS c, CAST(embedding[i] AS DOUBLE) AS z FROM embeddings, (SELECT unnest(range(1, 65)) AS i)"
PART = "SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE) AS z FROM part"
CHAIN = """WITH cells AS ({cells}),
dims AS (SELECT max(r) + 1 AS nr, max(c) + 1 AS nc FROM cells),
src AS (SELECT r, c, CASE WHEN r = nr - 1 OR z = -9999.0 THEN NULL ELSE z END AS z FROM cells, dims),
nb AS (SELECT m.r, m.c, m.z AS e, {fill},
  (m.z IS NULL OR m.c = 0 OR m.c = nc - 1) AS inv
  FROM src m CROSS JOIN dims {joins}),
grad AS (SELECT *, (c3 + 2*f + i - (a + 2*d + g)) / 8.0 AS dx, (g + 2*h + i - (a + 2*b + c3)) / 8.0 AS dy FROM nb),
ang AS (SELECT *, atan(sqrt(dx*dx + dy*dy)) AS slp, CAST(CAST(57.29578 * atan2(dy, -dx) AS FLOAT) AS DOUBLE) AS deg,
  CASE WHEN dx <> 0 THEN CASE WHEN atan2(dy, -dx) < 0 THEN 2*pi() + atan2(dy, -dx) ELSE atan2(dy, -dx) END
       WHEN dy > 0 THEN pi()/2 WHEN dy < 0 THEN 2*pi() - pi()/2 ELSE pi() END AS hasp0 FROM grad),
out_ AS (SELECT r, c, inv, a, b, c3, d, e, f, g, h, i,
  CASE WHEN inv THEN -9999.0 ELSE dx END AS dz_dx, CASE WHEN inv THEN -9999.0 ELSE dy END AS dz_dy,
  CASE WHEN inv THEN -9999.0 ELSE slp END AS slope,
  CASE WHEN inv OR (dx = 0 AND dy = 0) OR dx = -9999.0 OR dy = -9999.0 THEN -9999.0
       ELSE (CASE WHEN deg > 90.0 THEN 360.0 - deg + 90.0 ELSE 90.0 - deg END) * (pi() / 180.0) END AS aspect,
  CASE WHEN inv THEN -9999.0 ELSE greatest(0, 255.0 * (cos(pi()/4) * cos(slp) + sin(pi()/4) * sin(slp) * cos(135.0 * pi() / 180.0 - hasp0))) END AS hillshade,
  CASE WHEN inv OR (dx = 0 AND dy = 0) THEN -9999.0 ELSE hasp0 END AS hasp,
  CASE WHEN inv THEN -9999.0 ELSE (a+b+c3+d+e+f+g+h+i) / 9.0 END AS mean_, CASE WHEN inv THEN -9999.0 ELSE b+d+f+h - 4.0*e END AS laplacian_
  FROM ang)
"""
_AT = {"a": (-1, -1), "b": (-1, 0), "c3": (-1, 1), "d": (0, -1), "f": (0, 1), "g": (1, -1), "h": (1, 0), "i": (1, 1)}


#: Neighbours of dense cells by windows: west and east within rows, then north and south within columns.
AROUND = """WITH cells AS ({cells}),
sides AS (SELECT r, c, z, lag(z) OVER w AS d, lead(z) OVER w AS f FROM cells WINDOW w AS (PARTITION BY r ORDER BY c))
SELECT r, c, round(z, 6) AS e, round(d, 6) AS d, round(f, 6) AS f,
  round(lag(d) OVER w, 6) AS a, round(lag(z) OVER w, 6) AS b, round(lag(f) OVER w, 6) AS c3,
  round(lead(d) OVER w, 6) AS g, round(lead(z) OVER w, 6) AS h, round(lead(f) OVER w, 6) AS i
FROM sides WINDOW w AS (PARTITION BY c ORDER BY r)"""


def chain(cells: str, select: str) -> str:
    joins = " ".join(f"LEFT JOIN src {x}_ ON {x}_.r = m.r + ({dr}) AND {x}_.c = m.c + ({dc})" for x, (dr, dc) in _AT.items())
    return CHAIN.format(cells=cells, fill=", ".join(f"coalesce({x}_.z, m.z) AS {x}" for x in _AT), joins=joins) + select


def oracle_sql() -> dict[str, str]:
    value = lambda cells, column, name: chain(cells, f"SELECT r, c, CASE WHEN round({column}, 6) = 0 THEN 0.0 ELSE round({column}, 6) END AS {name} FROM out_")
    single = lambda column: f"round(CAST(CAST({column} AS FLOAT) AS DOUBLE), 3)"
    outputs = lambda *columns: chain(PART, " UNION ALL ".join(f"SELECT r, c, {single(column)} AS z, '{name}' AS output FROM out_" for name, column in columns))
    part = f"WITH cells AS ({PART}) SELECT r, c, round(z, 3) AS z FROM cells"
    out = {}
    for f in ("slope", "aspect", "hillshade"):
        out[f], out[f"{f}_holes"] = value(EMB, f, f), value(EV, f, f)
    return out | {
        "scan_rows": "SELECT vec_id AS r, len(embedding) AS n, round(CAST(embedding[1] AS DOUBLE), 6) AS z_first, round(CAST(embedding[64] AS DOUBLE), 6) AS z_last FROM embeddings",
        "grid_from_linear_id": f"SELECT r, c, round(z, 6) AS z FROM ({EV})",
        "raster_from_cells": "SELECT o_orderkey // 100 AS r, round(sum(o_totalprice), 2) AS z_sum FROM orders GROUP BY 1",
        "raster_header": f"SELECT max(c) + 1 AS ncols, max(r) + 1 AS nrows, CAST(1 AS DOUBLE) AS cellsize, CAST(-9999 AS DOUBLE) AS nodata, count(*) AS n_cells, count(*) FILTER (z = -9999.0) AS n_nodata FROM ({EV})",
        "strip_assignment": f"SELECT r // {STRIP} AS strip, min(r) AS r_min, max(r) AS r_max, count(DISTINCT r) AS n_rows FROM ({EV}) GROUP BY 1",
        "halo_exchange": f"WITH x AS (SELECT DISTINCT r FROM ({EV})), n AS (SELECT max(r) AS m FROM x) SELECT DISTINCT greatest(0, least(m, r + d)) // {STRIP} AS strip, r, greatest(0, least(m, r + d)) // {STRIP} <> r // {STRIP} AS is_halo FROM x, n, (SELECT unnest([-1, 0, 1]) AS d)",
        "pad_top": chain(EV, "SELECT c, round(slope, 6) AS slope FROM out_ WHERE r = 0"),
        "pad_bottom": chain(EV, "SELECT r, c, round(slope, 6) AS slope FROM out_, dims WHERE r >= nr - 2"),
        "edge_mask": f"WITH cells AS ({EV}), dims AS (SELECT max(r) + 1 AS nr, max(c) + 1 AS nc FROM cells) SELECT r, c, (c = 0 OR c = nc - 1 OR r = nr - 1) AS is_edge FROM cells, dims",
        "neighborhood_3x3": AROUND.format(cells=EMB),
        "nodata_mask": f"SELECT r, c, z = -9999.0 AS is_nodata FROM ({EV})",
        "nodata_fill": chain(EV, f"SELECT r, c, {', '.join(f'round({x}, 6) AS {x}' for x in ('a', 'b', 'c3', 'd', 'e', 'f', 'g', 'h', 'i'))} FROM out_ WHERE NOT inv"),
        "gradient_dx": value(EV, "dz_dx", "dz_dx"), "gradient_dy": value(EV, "dz_dy", "dz_dy"), "hillshade_aspect": value(EV, "hasp", "hasp"),
        "multi_function": chain(EV, "SELECT r, c, round(slope, 6) AS slope, round(aspect, 6) AS aspect, round(hillshade, 6) AS hillshade FROM out_"),
        "custom_focal_mean": value(EV, "mean_", "value"), "custom_focal_laplacian": value(EV, "laplacian_", "value"), "custom_focal_pandas": value(EV, "laplacian_", "value"),
        "scan_ascii_grid": part, "scan_geotiff": part, "sink_geotiff_roundtrip": part,
        "scan_format_dispatch": f"WITH cells AS ({PART}) SELECT r, c, round(z, 3) AS z, f AS format FROM cells, (SELECT unnest(['asc', 'tif']) AS f)",
        "run_three_outputs": outputs(("slope", "slope"), ("aspect", "aspect"), ("hillshade", "hillshade")),
        "run_views": outputs(("slope", "slope"), ("mean", "mean_")), "run_command_line": outputs(("aspect", "aspect"), ("hillshade", "hillshade")),
        "run_user_function": chain(PART, f"SELECT r, c, {single('CASE WHEN inv THEN -9999.0 ELSE i - a + dx END')} AS z FROM ang"),
        "sink_tiles_roundtrip": chain(PART, f"SELECT r, c, {single('slope')} AS z, 'slope' AS output FROM out_ UNION ALL SELECT r, c, round(z, 3), 'z' FROM cells"),
        "run_slope_file": chain(PART, "SELECT r, c, round(CAST(CAST(slope AS FLOAT) AS DOUBLE), 3) AS z FROM out_"),
    }
