"""Queries of raster operators: embeddings as 8 x 8 rasters, line items as cells, and elevation grids from ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from skyfold.functions import geodesy as G
from skyfold.operators import raster as R
from skyfold.operators import geolocation, terrain
from skyfold.sources import geotiff

from .geo import PLACE, places
from .registry import query, r, rs, table


def images(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("image_id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "value")).withColumns({"row": F.floor(F.col("k") / 8).cast("int"), "col": (F.col("k") % 8).cast("int")})


CELLS = "cells AS (SELECT vec_id AS image_id, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS value FROM embeddings)"


@query(f"WITH {CELLS} SELECT a.image_id, {rs('corr(a.value, b.value)', 6)} AS ccv FROM cells a JOIN cells b ON b.image_id = a.image_id + 1 AND a.k = b.k GROUP BY a.image_id")
def raster_correlation(spark, sf_dir):
    """Of each raster with the next one."""
    a = images(spark, sf_dir)
    b = a.select((F.col("image_id") - 1).alias("image_id"), "k", F.col("value").alias("other"))
    return a.join(b, ["image_id", "k"]).groupBy("image_id").agg(r(R.ccv(F.col("value"), F.col("other"))).alias("ccv"))


@query(f"WITH {CELLS}, c AS (SELECT image_id, CASE WHEN image_id % 10 = 0 THEN 1.0::DOUBLE ELSE value END AS v, value FROM cells) SELECT image_id, CASE WHEN image_id % 10 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS ccv FROM c GROUP BY image_id")
def array_correlation(spark, sf_dir):
    """A raster with itself, one in ten made constant: 1, or 0 without variance."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.col("embedding").cast("array<double>").alias("v"))
    a = F.when(F.col("image_id") % 10 == 0, F.transform("v", lambda x: F.lit(1.0))).otherwise(F.col("v"))
    return e.select("image_id", r(R.array_ccv(a, F.col("v")), 9).alias("ccv"))


@query("WITH s AS (SELECT l_suppkey AS pair_id, l_linenumber AS k, l_orderkey % 44 AS kk, max(l_discount) AS ccv FROM lineitem GROUP BY ALL) SELECT pair_id, k, kk, ccv FROM s QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY ccv DESC, k, kk) = 1")
def best_shift(spark, sf_dir):
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pair_id"), F.col("l_linenumber").alias("k"), (F.col("l_orderkey") % 44).alias("kk")).agg(F.max("l_discount").alias("ccv"))
    return R.best_shift(s, ["pair_id"])


@query("""WITH p AS (SELECT event_id AS id, (value * 0.37::DOUBLE) % 9.0::DOUBLE AS r, (value * 0.73::DOUBLE) % 9.0::DOUBLE AS c FROM events), g AS (SELECT i, j, (i * i + 3 * j) * 1.0::DOUBLE AS v FROM range(8) a(i), range(8) b(j)),
  q AS (SELECT id, r, c, floor(r)::BIGINT AS i, floor(c)::BIGINT AS j FROM p), t AS (SELECT q.id, q.r, q.c, g00.v AS v00, g10.v AS v10, g01.v AS v01, g11.v AS v11, r - q.i AS u, c - q.j AS w FROM q LEFT JOIN g g00 ON g00.i = q.i AND g00.j = q.j LEFT JOIN g g10 ON g10.i = q.i + 1 AND g10.j = q.j LEFT JOIN g g01 ON g01.i = q.i AND g01.j = q.j + 1 LEFT JOIN g g11 ON g11.i = q.i + 1 AND g11.j = q.j + 1)
  SELECT id, CASE WHEN v11 IS NULL THEN 0.0::DOUBLE ELSE round(v00 * (1-u) * (1-w) + v10 * u * (1-w) + v01 * (1-u) * w + v11 * u * w, 6) END AS value FROM t""")
def bilinear_sampling(spark, sf_dir):
    p = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("value") * 0.37 % 9.0).alias("r"), (F.col("value") * 0.73 % 9.0).alias("c"))
    g = spark.range(64).select(F.floor(F.col("id") / 8).alias("row"), (F.col("id") % 8).alias("col")).withColumn("value", (F.col("row") * F.col("row") + 3 * F.col("col")).cast("double"))
    return R.bilinear_at(p, g).select("id", F.round("value", 6).alias("value"))


@query("""WITH p AS (SELECT l_suppkey AS id, (l_quantity % 8) * 0.75::DOUBLE AS r, (l_linenumber % 4) * 1.25::DOUBLE AS c FROM lineitem),
  g AS (SELECT p_partkey % 6 AS row, p_partkey // 6 % 6 AS col, max(p_size)::DOUBLE AS v FROM part GROUP BY ALL),
  q AS (SELECT *, floor(r)::BIGINT AS i, floor(c)::BIGINT AS j, r - floor(r) AS u, c - floor(c) AS w FROM p),
  t AS (SELECT q.*, a.v AS a, b.v AS b, d.v AS d, e.v AS e FROM q LEFT JOIN g a ON a.row = i AND a.col = j LEFT JOIN g b ON b.row = i + 1 AND b.col = j LEFT JOIN g d ON d.row = i AND d.col = j + 1 LEFT JOIN g e ON e.row = i + 1 AND e.col = j + 1)
  SELECT id, r, c, CASE WHEN a IS NULL OR (u > 0 AND b IS NULL) OR (w > 0 AND d IS NULL) OR (u * w > 0 AND e IS NULL) THEN 0.0::DOUBLE
    ELSE round(a * (1-u) * (1-w) + coalesce(b, 0) * u * (1-w) + coalesce(d, 0) * (1-u) * w + coalesce(e, 0) * u * w, 6) END AS value FROM t""")
def bilinear_sampling_of_repeats(spark, sf_dir):
    """Points that occur many times, on a raster made of parts: each row comes back once."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("id"), (F.col("l_quantity").cast("double") % 8 * 0.75).alias("r"), (F.col("l_linenumber") % 4 * 1.25).cast("double").alias("c"))
    k = F.col("p_partkey")
    g = table(spark, sf_dir, "part").groupBy((k % 6).alias("row"), (F.floor(k / 6) % 6).alias("col")).agg(F.max("p_size").cast("double").alias("value"))
    return R.bilinear_at(p, g).select("id", "r", "c", F.round("value", 6).alias("value"))


@query("""WITH p AS (SELECT l_orderkey AS id, (l_suppkey % 40) * 0.2::DOUBLE AS lon, 9 - (l_linenumber % 7) * 1.1::DOUBLE AS lat, l_quantity::DOUBLE AS height FROM lineitem),
  g AS (SELECT p_partkey % 12 AS ix, p_partkey // 12 % 12 AS iy, max(p_size)::DOUBLE AS v FROM part GROUP BY ALL),
  q AS (SELECT *, floor(lon)::BIGINT AS i, floor(10 - lat)::BIGINT AS j, lon - floor(lon) AS u, 10 - lat - floor(10 - lat) AS w FROM p),
  t AS (SELECT q.*, a.v AS a, b.v AS b, d.v AS d, e.v AS e FROM q LEFT JOIN g a ON a.ix = i AND a.iy = j LEFT JOIN g b ON b.ix = i + 1 AND b.iy = j LEFT JOIN g d ON d.ix = i AND d.iy = j + 1 LEFT JOIN g e ON e.ix = i + 1 AND e.iy = j + 1)
  SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat, CASE WHEN a IS NULL OR (u > 0 AND b IS NULL) OR (w > 0 AND d IS NULL) OR (u * w > 0 AND e IS NULL) THEN NULL
    ELSE round(height + a * (1-u) * (1-w) + coalesce(b, 0) * u * (1-w) + coalesce(d, 0) * (1-u) * w + coalesce(e, 0) * u * w, 5) END AS height FROM t""")
def heights_above_ellipsoid(spark, sf_dir):
    """Heights over the geoid at places and ids that repeat; the geoid is a table made of parts."""
    li, k = table(spark, sf_dir, "lineitem"), F.col("p_partkey")
    h = li.select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 40 * 0.2).alias("lon"), (9 - F.col("l_linenumber") % 7 * 1.1).alias("lat"), F.col("l_quantity").cast("double").alias("height"))
    g = table(spark, sf_dir, "part").groupBy((k % 12).alias("ix"), (F.floor(k / 12) % 12).alias("iy")).agg(F.max("p_size").cast("double").alias("height"))
    return geolocation.height_above_ellipsoid(h, g, 1.0, 0.0, 10.0).select("id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("height", 5).alias("height"))


@query("""WITH g AS (SELECT r_regionkey AS image_id, gi, gj, 0.2::DOUBLE + 5.6::DOUBLE * gj / 14.0::DOUBLE AS lon, 5.8::DOUBLE - 5.6::DOUBLE * gi / 14.0::DOUBLE AS lat FROM region, range(15) a(gi), range(15) b(gj))
  SELECT image_id, gi, gj, round(lon, 6) AS lon, round(lat, 6) AS lat, round(2 * lon + 3 * lat + image_id, 5) AS value FROM g""")
def regrid_irregular(spark, sf_dir):
    """A skewed raster of a plane onto an even grid: the plane comes back."""
    n = spark.range(64).select(F.floor(F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"))
    cells = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("image_id")).crossJoin(n)
    cells = cells.withColumns({"lon": F.col("col") - 0.5 + 0.03 * F.col("row"), "lat": F.col("row") - 0.5 + 0.05 * F.col("col")}).withColumn("value", 2 * F.col("lon") + 3 * F.col("lat") + F.col("image_id"))
    bounds = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("image_id"), F.lit(0.2).alias("min_lon"), F.lit(5.8).alias("max_lon"), F.lit(0.2).alias("min_lat"), F.lit(5.8).alias("max_lat"))
    got = R.regrid(cells, R.regular_grid(bounds, 15, 15), 1.0)
    return got.select("image_id", "gi", "gj", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("value", 5).alias("value"))


@query("""WITH p AS (SELECT s_suppkey AS point_id, (s_suppkey * 61.8::DOUBLE) % 37.0::DOUBLE - 9 AS x, (s_suppkey * 137.508::DOUBLE) % 10.0::DOUBLE AS y FROM supplier), c AS (SELECT p_partkey AS cell_id, (p_partkey * 0.618::DOUBLE) % 10.0::DOUBLE AS x, (p_partkey * 1.375::DOUBLE) % 10.0::DOUBLE AS y FROM part),
  d AS (SELECT point_id, cell_id, sqrt((p.x - c.x) ** 2 + (p.y - c.y) ** 2) AS distance FROM p, c) SELECT point_id, cell_id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY point_id ORDER BY distance, cell_id) AS rank FROM d QUALIFY rank <= 9""")
def nearest_cells(spark, sf_dir):
    """Nine cells of each point, also of those that lie far from all cells."""
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("point_id"), (F.col("s_suppkey") * 61.8 % 37.0 - 9).alias("x"), (F.col("s_suppkey") * 137.508 % 10.0).alias("y"))
    c = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cell_id"), (F.col("p_partkey") * 0.618 % 10.0).alias("x"), (F.col("p_partkey") * 1.375 % 10.0).alias("y"))
    return R.nearest_cells(p, c, 9, 0.8).select("point_id", "cell_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH p AS ({PLACE}) SELECT id, floor(lon / 30) * 30 AS ll_lon, floor((lat + 90) / 20) * 20 - 90 AS ll_lat FROM p")
def elevation_tile_of_point(spark, sf_dir):
    lon, lat = R.tile_corner(F.col("lon") + 360.0, F.col("lat"))
    return places(spark, sf_dir).select("id", lon.cast("double").alias("ll_lon"), lat.cast("double").alias("ll_lat"))


@query("""WITH b AS (SELECT n_nationkey AS box_id, ((n_nationkey * 53) % 360 - 180)::DOUBLE AS lo, (n_nationkey * 17) % 150 - 85 AS la FROM nation), t AS (SELECT box_id, unnest(range(floor(lo / 30)::BIGINT, floor((lo + 45) / 30)::BIGINT + 1)) AS i, la FROM b),
  u AS (SELECT box_id, i, unnest(range(floor((la + 90) / 20)::BIGINT, floor((la + 110) / 20)::BIGINT + 1)) AS j FROM t) SELECT DISTINCT box_id, ((i * 30 + 180 + 360) % 360 - 180)::DOUBLE AS ll_lon, (j * 20 - 90)::DOUBLE AS ll_lat FROM u""")
def elevation_tiles_of_box(spark, sf_dir):
    n = F.col("n_nationkey")
    lo = ((n * 53) % 360 - 180).cast("double")
    b = table(spark, sf_dir, "nation").select(n.alias("box_id"), lo.alias("min_lon"), F.when(lo + 45 >= 180, lo + 45 - 360).otherwise(lo + 45).alias("max_lon"), ((n * 17) % 150 - 85).cast("double").alias("min_lat"), ((n * 17) % 150 - 65).cast("double").alias("max_lat"))
    return R.tiles_of_box(b)


DEM = "dem AS (SELECT ix, iy, (ix * 7 + iy * 3) % 50 * 1.0::DOUBLE AS height FROM range(40) a(ix), range(40) b(iy))"


def dem(spark):
    g = spark.range(1600).select((F.col("id") % 40).alias("ix"), F.floor(F.col("id") / 40).alias("iy"))
    return g.withColumn("height", ((F.col("ix") * 7 + F.col("iy") * 3) % 50).cast("double"))


@query(f"""WITH {DEM}, p AS (SELECT s_suppkey AS id, (s_suppkey * 61.8::DOUBLE) % 20.0::DOUBLE - 10 AS lon, (s_suppkey * 137.508::DOUBLE) % 20.0::DOUBLE - 10 AS lat FROM supplier) SELECT id, height FROM p LEFT JOIN dem ON trunc((lon + 10 + 0.25) / 0.5) = ix AND trunc((10 - lat + 0.25) / 0.5) = iy""")
def elevation_nearest(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 61.8 % 20.0 - 10).alias("lon"), (F.col("s_suppkey") * 137.508 % 20.0 - 10).alias("lat"))
    return R.heights_at(p, dem(spark), 0.5, -10.0, 10.0).select("id", "height")


@query(f"""WITH {DEM}, p AS (SELECT s_suppkey AS id, (s_suppkey * 61.8::DOUBLE) % 16.0::DOUBLE - 8 AS lon, (s_suppkey * 137.508::DOUBLE) % 16.0::DOUBLE - 8 AS lat FROM supplier) SELECT id, min(height) AS min_height, max(height) AS max_height FROM p JOIN dem ON abs(-10 + ix * 0.5::DOUBLE - lon) <= 1.2 AND abs(10 - iy * 0.5::DOUBLE - lat) <= 1.2 GROUP BY id""")
def elevation_local_range(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 61.8 % 16.0 - 8).alias("lon"), (F.col("s_suppkey") * 137.508 % 16.0 - 8).alias("lat"))
    cells = dem(spark).select((F.col("ix") * 0.5 - 10).alias("lon"), (10 - F.col("iy") * 0.5).alias("lat"), "height")
    return R.height_range(p, cells, 1.2, 1.0)


@query(f"WITH {CELLS}, p AS (SELECT image_id, k, abs(value) AS w FROM cells) SELECT image_id, {rs('sum((k // 8) * w) / sum(w)')} AS centroid_row, {rs('sum((k % 8) * w) / sum(w)')} AS centroid_col, {rs('max(w) / sum(w)')} AS peak FROM p GROUP BY image_id")
def point_spread_centroid(spark, sf_dir):
    w = F.abs("value")
    got = images(spark, sf_dir).groupBy("image_id").agg((F.sum(F.col("row") * w) / F.sum(w)).alias("a"), (F.sum(F.col("col") * w) / F.sum(w)).alias("b"), (F.max(w) / F.sum(w)).alias("c"))
    return got.select("image_id", r(F.col("a")).alias("centroid_row"), r(F.col("b")).alias("centroid_col"), r(F.col("c")).alias("peak"))


@query("WITH p AS (SELECT p_partkey AS psf, (p_partkey * 0.618::DOUBLE) % 90.0::DOUBLE AS fa FROM part), q AS (SELECT s_suppkey AS id, (s_suppkey * 1.7::DOUBLE) % 90.0::DOUBLE AS a FROM supplier) SELECT id, psf FROM q, p QUALIFY row_number() OVER (PARTITION BY id ORDER BY abs(fa - a), psf) = 1")
def nearest_point_spread(spark, sf_dir):
    """The calibration table's entry of the nearest field angle, the first of equal ones; the table is small by nature."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("psf"), (F.col("p_partkey") * 0.618 % 90.0).alias("fa"))
    q = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") * 1.7 % 90.0).alias("a"))
    return R.nearest_entry(q, p, "a", "fa", "id", "psf")


@query()
def image_match_search(spark, sf_dir):
    """Correlation search of a shifted image on a chip: 8 x 8 rasters on a grid of 0.02 degrees."""
    axis = [[float(i) * 0.02 for _ in range(8)] for i in range(8)]
    flip = [[float(j) * 0.02 for j in range(8)] for _ in range(8)]
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), F.col("embedding").cast("array<double>").alias("v"))
    grid = lambda rows: F.array(*[F.array(*[F.lit(x) for x in row]) for row in rows])
    chip = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("v", i * 8 + 1, 8))
    moved = lambda rows: F.transform(grid(rows), lambda row: F.transform(row, lambda x: x + 0.004))
    pairs = e.select("pair_id", chip.alias("gcp_data"), grid(axis).alias("gcp_lat"), grid(flip).alias("gcp_lon"), chip.alias("img_data"), moved(axis).alias("img_lat"), moved(flip).alias("img_lon"))
    return R.match_images(pairs)


@query()
def terrain_correction(spark, sf_dir):
    """Ellipsoid points of slanted views, corrected for a rising ground."""
    s = places(spark, sf_dir).withColumn("alt", F.lit(0.0))
    s = s.select("id", "lon", "lat", *G.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.col("alt")).named(""))
    points = s.select("id", "lon", "lat", *[(F.col(c)).alias(c) for c in "xyz"], (F.col("x") * 1.1).alias("sx"), (F.col("y") * 1.1 + 200).alias("sy"), (F.col("z") * 1.1 + 100).alias("sz"))
    heights = np.fromfunction(lambda i, j: 1.0 + np.sin(i / 9.0) + np.cos(j / 7.0), (180, 360))
    return terrain.correct(points, heights, -180.0, 90.0, 1.0)


@query(f"WITH {CELLS} SELECT image_id, k // 8 AS row, k % 8 AS col, {rs('10 + (k % 8 + image_id % 3) * 0.02::DOUBLE', 9)} AS x, {rs('50 - k // 8 * 0.01::DOUBLE', 9)} AS y, value FROM cells")
def geotiff_round_trip(spark, sf_dir):
    """Images as GeoTIFF files, and the cells that these hold."""
    c = images(spark, sf_dir).select("image_id", "row", "col", (10 + (F.col("col") + F.col("image_id") % 3) * 0.02).alias("x"), (50 - F.col("row") * 0.01).alias("y"), "value")
    files = geotiff.encode_cells(c, "image_id").select(F.col("image_id").cast("string").alias("path"), "content")
    got = geotiff.cells(files)
    return got.select(F.col("path").cast("long").alias("image_id"), "row", "col", r(F.col("x"), 9).alias("x"), r(F.col("y"), 9).alias("y"), "value")
