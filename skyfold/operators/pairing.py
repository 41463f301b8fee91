"""Spatial pairing of image footprints with ground control points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions import geodesy as G
from skyfold.functions.vec import Vec, lit, safe_div

Point = tuple[Column, Column]


def winding_inside(p: Point, ring: list[Point]) -> Column:
    """Inside a polygon by its winding number: upward edges with the point on their left count 1, downward ones on the right -1."""
    total = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        side = (x2 - x1) * (p[1] - y1) - (p[0] - x1) * (y2 - y1)
        total = total + F.when((y1 <= p[1]) & (p[1] < y2) & (side > 0), 1).when((y2 <= p[1]) & (p[1] < y1) & (side < 0), -1).otherwise(0)
    return total != 0


def segment_distance(p: Point, a: Point, b: Point) -> Column:
    """To the nearest point of a segment; one without length is its point."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    length = dx * dx + dy * dy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), safe_div((p[0] - a[0]) * dx + (p[1] - a[1]) * dy, length))))
    ex, ey = p[0] - (a[0] + t * dx), p[1] - (a[1] + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def signed_distance(p: Point, ring: list[Point]) -> Column:
    """Distance to the border, positive inside."""
    edges = [segment_distance(p, a, b) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)]
    return F.when(winding_inside(p, ring), F.least(*edges)).otherwise(-F.least(*edges))


def tangent_plane(images: DataFrame) -> DataFrame:
    """images (lat0..lat3, lon0..lon3) with the corners' mean (_lat_, _lon_), its Earth-fixed place and the corners (_e0, _n0, ...) in metres around it."""
    mean = lambda n: (F.col(f"{n}0") + F.col(f"{n}1") + F.col(f"{n}2") + F.col(f"{n}3")) / 4
    out = images.withColumns({"_lat_": mean("lat"), "_lon_": mean("lon")})
    out = out.withColumns(dict(zip(("_ox", "_oy", "_oz"), G.geodetic_to_ecef(F.col("_lon_"), F.col("_lat_"), lit(0.0), meters=True), strict=True)))
    for k in range(4):
        at = G.geodetic_to_ecef(F.col(f"lon{k}"), F.col(f"lat{k}"), lit(0.0), meters=True)
        out = out.withColumns({f"_c{a}": c for a, c in zip("xyz", at, strict=True)})
        out = out.withColumns(dict(zip((f"_e{k}", f"_n{k}"), _in_plane(Vec.columns("_c")), strict=True)))
    return out.drop("_cx", "_cy", "_cz")


def _in_plane(p: Vec) -> tuple[Column, Column]:
    lon, lat = F.radians("_lon_"), F.radians("_lat_")
    d = p.minus(Vec.columns("_o"))
    return d.dot(G.east(lon)), d.dot(G.north(lon, lat))


def footprints(pixels: DataFrame, key: str = "image_id") -> DataFrame:
    """Corners (clockwise from the first row and column), centre pixel (size // 2) and bounding box of each image.

    pixels: image_id, row, col (from 0), lat, lon.
    """
    at = F.struct("lat", "lon")
    lead = pixels.groupBy(key).agg(
        F.min_by(at, F.struct("row", "col")).alias("c0"), F.min_by(at, F.struct("row", -F.col("col"))).alias("c1"), F.max_by(at, F.struct("row", "col")).alias("c2"), F.max_by(at, F.struct("row", -F.col("col"))).alias("c3"),
        *(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("min", F.min), ("max", F.max))), F.floor((F.max("row") + 1) / 2).alias("_r"), F.floor((F.max("col") + 1) / 2).alias("_c"),
    )
    centre = pixels.select(F.col(key).alias("_k"), F.col("row").alias("_row"), F.col("col").alias("_col"), F.struct("lat", "lon").alias("centre"))
    out = lead.join(centre, (F.col(key) == F.col("_k")) & (F.col("_r") == F.col("_row")) & (F.col("_c") == F.col("_col")), "left")
    return out.drop("_k", "_row", "_col", "_r", "_c")


def find_pairs(images: DataFrame, points: DataFrame, max_distance_m: float = 0.0, cell_deg: float = 1.0, spread_deg: float | None = None) -> DataFrame:
    """image_id, gcp_id, margin_m of all pairs whose point lies at least max_distance_m inside (negative: outside) the footprint.

    images: image_id, lat0..lat3, lon0..lon3; points: gcp_id, lat, lon. Both are dealt to cells of cell_deg; an image
    goes to all cells that its box, widened by spread_deg, touches, so pairs are found by an equi-join. spread_deg
    follows from a negative max_distance_m (a degree is 111 km at least in latitude; in longitude it is widened by the
    cosine of the box's latitude). Footprints across the date line must have continuous longitudes; points are also
    tried at +-360 degrees.
    """
    pad = spread_deg if spread_deg is not None else max(0.0, -max_distance_m) / 110_000.0
    la, lo = [F.col(f"lat{i}") for i in range(4)], [F.col(f"lon{i}") for i in range(4)]
    worst = F.least(F.lit(89.0), F.greatest(F.abs(F.greatest(*la)), F.abs(F.least(*la))) + pad)
    wide = F.lit(pad) / F.cos(F.radians(worst)) + 1e-9
    cells = lambda low, high: F.sequence(F.floor(low / cell_deg).cast("long"), F.floor(high / cell_deg).cast("long"))
    boxed = tangent_plane(images).withColumn("_y", F.explode(cells(F.least(*la) - pad, F.greatest(*la) + pad))).withColumn("_x", F.explode(cells(F.least(*lo) - wide, F.greatest(*lo) + wide)))
    at = points.select("gcp_id", "lat", "lon").withColumns(dict(zip(("_px", "_py", "_pz"), G.geodetic_to_ecef(F.col("lon"), F.col("lat"), lit(0.0), meters=True), strict=True)))
    shifted = at.select("gcp_id", "_px", "_py", "_pz", F.col("lat").alias("_lat"), F.explode(F.array(F.col("lon") - 360.0, F.col("lon"), F.col("lon") + 360.0)).alias("_lon"))
    placed = shifted.withColumns({"_y": F.floor(F.col("_lat") / cell_deg).cast("long"), "_x": F.floor(F.col("_lon") / cell_deg).cast("long")})
    met = boxed.join(placed, ["_y", "_x"])
    met = met.withColumns(dict(zip(("_e", "_n"), _in_plane(Vec.columns("_p")), strict=True)))
    ring = [(F.col(f"_e{k}"), F.col(f"_n{k}")) for k in range(4)]
    hit = met.withColumn("margin_m", signed_distance((F.col("_e"), F.col("_n")), ring)).where(F.col("margin_m") >= max_distance_m)
    return hit.groupBy("image_id", "gcp_id").agg(F.max("margin_m").alias("margin_m"))


def points_within(images: DataFrame, points: DataFrame, max_distance_m: float = 0.0) -> DataFrame:
    """Semi-join: the points that pair with any image."""
    return points.join(find_pairs(images, points, max_distance_m).select("gcp_id").distinct(), "gcp_id", "left_semi")


def minmax_longitude(rows: DataFrame, by: list[str], lon: str = "lon") -> DataFrame:
    """(min_lon, max_lon) of each key; where they span over 180 degrees, the range across the date line (max_lon below min_lon)."""
    c, m = F.col(lon), F.pmod(F.col(lon), F.lit(360.0))
    got = rows.groupBy(*by).agg(F.min(c).alias("a"), F.max(c).alias("b"), F.min(m).alias("c"), F.max(m).alias("d"))
    near = F.col("b") - F.col("a") <= 180
    top = F.when(F.col("d") > 180, F.col("d") - 360).otherwise(F.col("d"))
    return got.select(*by, F.when(near, F.col("a")).otherwise(F.col("c")).alias("min_lon"), F.when(near, F.col("b")).otherwise(top).alias("max_lon"))
