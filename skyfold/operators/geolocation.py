"""The geolocation chain: times x pixels, states and attitudes by lookup, ellipsoid, terrain, angles, product.

Every step is a row-wise expression or a bucketed lookup; the terrain step walks in numpy over one region's heights.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions import constants as K
from skyfold.functions import geodesy as G
from skyfold.functions.vec import NAN, Vec

from . import ephemeris, terrain

KM_PER_DEG = 2 * np.pi * K.WGS84_A_KM / 360


def rotation_of(q: list[Column]) -> list[Column]:
    """Row-major matrix r0..r8 of a unit quaternion, scalar first, that turns instrument vectors."""
    w, x, y, z = q
    return [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]


def frames_at(times: DataFrame, states: DataFrame, attitudes: DataFrame, max_gap_us: int | None = None) -> DataFrame:
    """times (object_id, frame, ugps) with px..pz, vx_..vz_ of the object and r0..r8 of the frame, NaN where a lookup has no data."""
    s = ephemeris.query_ephemeris(times, states, max_gap_us).withColumnsRenamed({a: f"p{a}" for a in "xyz"} | {f"v{a}": f"v{a}_" for a in "xyz"})
    a = ephemeris.query_attitude(s, attitudes, max_gap_us)
    return a.withColumns({f"r{k}": c for k, c in enumerate(rotation_of([F.col(f"q{i}") for i in range(4)]))}).drop(*(f"q{i}" for i in range(4)))


def pointing_state(frames: DataFrame, pixels: DataFrame) -> DataFrame:
    """Each frame with each pixel: d (unit line of sight, Earth-fixed), p, v_, and ex, ey, ez, the frame's angles about its axes in degrees; qf."""
    rows = ephemeris.pixel_states(frames, pixels)
    v, m = Vec.columns("v"), [F.col(f"r{k}") for k in range(9)]
    rows = rows.withColumns({f"d{a}": m[3 * i] * v.x + m[3 * i + 1] * v.y + m[3 * i + 2] * v.z for i, a in enumerate("xyz")})
    rows = rows.withColumns({"ex": F.degrees(F.atan2(m[7], m[8])), "ey": F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[6])))), "ez": F.degrees(F.atan2(m[3], m[0]))})
    lost, blind = F.isnan(F.col("px") + F.col("py") + F.col("pz")), F.isnan(F.col("dx") + F.col("dy") + F.col("dz"))
    return rows.withColumn("qf", ephemeris.quality(lost, blind, F.lit(False)))


def on_ellipsoid(pointing: DataFrame) -> DataFrame:
    """pointing_state() with g (point on the ellipsoid, NaN where there is none), lon, lat, alt, and the miss in qf."""
    rows = pointing.withColumns({f"g{a}": c for a, c in zip("xyz", G.intersect_ellipsoid(Vec.columns("d"), Vec.columns("p")), strict=True)})
    rows = rows.withColumns(dict(zip(("lon", "lat", "alt"), G.surface_lon_lat(Vec.columns("g")), strict=True)))
    return rows.withColumn("qf", F.when((F.col("qf") == 0) & F.isnan("gx"), K.QUALITY_FLAGS["CALC_ELLIPS_NO_INTERSECT"]).otherwise(F.col("qf")).cast("long"))


def on_terrain(rows: DataFrame, dem: np.ndarray, ul_lon: float, ul_lat: float, step: float) -> DataFrame:
    """on_ellipsoid() with places moved up the line of sight to the ground, where qf is good; others stay; flags are OR-combined.

    dem: one region's heights (km). A row's line of sight goes along with it, so rows may repeat.
    """
    good = F.col("qf") == 0
    asked = rows.select(F.struct(*rows.columns).alias("id"), *[F.when(good, F.col(f"g{a}")).alias(a) for a in "xyz"], *[F.when(good, F.col(f"p{a}")).alias(f"s{a}") for a in "xyz"])
    moved = terrain.correct(asked, dem, ul_lon, ul_lat, step).select(F.col("id.*"), *[F.col(c).alias(f"_{c}") for c in ("lon", "lat", "alt", "qf")])
    out = moved.withColumns({c: F.when(good, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("lon", "lat", "alt")}).withColumn("qf", F.when(good, F.col("_qf")).otherwise(F.col("qf")))
    at = G.geodetic_to_ecef(F.col("lon"), F.col("lat"), F.col("alt"))
    return out.withColumns({f"g{a}": c for a, c in zip("xyz", at, strict=True)}).select(*rows.columns)


def with_targets(rows: DataFrame, targets: DataFrame, name: str) -> DataFrame:
    """Left join of one target position a time (ugps, x, y, z) with all pixels of that time: columns name_x.. (NaN where there is none)."""
    t = targets.select("ugps", *[F.col(a).alias(f"{name}_{a}") for a in "xyz"])
    return rows.join(t, "ugps", "left").withColumns({f"{name}_{a}": F.coalesce(f"{name}_{a}", F.lit(NAN)) for a in "xyz"})


def product(rows: DataFrame) -> DataFrame:
    """ugps, pixel, lon, lat, height (m), four angles, spacecraft position (m) and qf of rows with g, p and sun_; an angle without data sets its flag."""
    ground, sat, sun = Vec.columns("g"), Vec.columns("p"), Vec.columns("sun_")
    out = rows.select(
        "ugps", "pixel", "lon", "lat", (F.col("alt") * 1000.0).alias("height"), G.zenith(ground, sat).alias("view_zenith"), G.azimuth(ground, sat).alias("view_azimuth"),
        G.zenith(ground, sun).alias("solar_zenith"), G.azimuth(ground, sun).alias("solar_azimuth"), *[(F.col(f"p{a}") * 1000.0).alias(f"spacecraft_{a}") for a in "xyz"], "qf",
    )
    bad = F.isnan("view_zenith") | F.isnan("solar_zenith")
    return out.withColumn("qf", F.when(bad & (F.col("qf") == 0), K.QUALITY_FLAGS["CALC_ANCIL_INSUFF_DATA"]).otherwise(F.col("qf")).cast("long"))


def drop_missing(pointing: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of a pointing result without null or NaN in the columns (done only when a result is geolocated, too)."""
    return pointing.dropna("any", subset=columns)


def by_time(cosines: DataFrame, *others: DataFrame) -> DataFrame:
    """Left joins of other results of the same times on ugps."""
    for o in others:
        cosines = cosines.join(o, "ugps", "left")
    return cosines


# --- elevation -----------------------------------------------------------------------------------------------------


def padded_box(points: DataFrame, pad_km: float) -> DataFrame:
    """points (lon, lat in degrees) with min_lon, max_lon, min_lat, max_lat: a degree is the equator's in both axes."""
    pad = pad_km / KM_PER_DEG
    return points.withColumns({"min_lon": F.col("lon") - pad, "max_lon": F.col("lon") + pad, "min_lat": F.col("lat") - pad, "max_lat": F.col("lat") + pad})


def finest_first(tiles: DataFrame) -> DataFrame:
    """Tiles in order of resolution, the finest first; of equal ones by path."""
    return tiles.orderBy("arcsec", "path")


def region(cells: DataFrame, min_lon: float, max_lon: float, min_lat: float, max_lat: float, fill: float = -32768.0) -> DataFrame:
    """Cells (lon, lat, height) of a box; a box whose min_lon is over its max_lon crosses the date line (its eastern part is given beyond 180). Fill counts as 0."""
    wraps = min_lon > max_lon
    lon = F.when(F.col("lon") < min_lon, F.col("lon") + 360.0).otherwise(F.col("lon")) if wraps else F.col("lon")
    got = cells.withColumn("lon", lon).where(F.col("lon").between(min_lon, max_lon + (360.0 if wraps else 0.0)) & F.col("lat").between(min_lat, max_lat))
    return got.withColumn("height", F.when(F.col("height") == fill, 0.0).otherwise(F.col("height")))


def mosaic(*regions: DataFrame) -> DataFrame:
    """Outer union of cells; where several regions hold a cell, the first one's height counts."""
    out = None
    for i, r in enumerate(regions):
        r = r.select("lon", "lat", F.struct(F.lit(i).alias("i"), F.col("height").alias("h")).alias("_h"))
        out = r if out is None else out.unionByName(r)
    return out.groupBy("lon", "lat").agg(F.min("_h").alias("_h")).select("lon", "lat", F.col("_h.h").alias("height"))


def region_range(cells: DataFrame) -> DataFrame:
    """min_height and max_height of a region; NaN is no height."""
    h = F.when(~F.isnan("height"), F.col("height"))
    return cells.agg(F.min(h).alias("min_height"), F.max(h).alias("max_height"))


def height_above_ellipsoid(heights: DataFrame, geoid: DataFrame, step: float, ul_lon: float, ul_lat: float, orthometric: bool = False) -> DataFrame:
    """heights (lon, lat, height over the geoid, and other columns) with the geoid's height added, bilinear on a regular table (ix, iy, height) that is joined by its four corners.

    The geoid is looked up once for each place; rows may repeat, and several may have one place. Null where the table lacks a corner.
    """
    if orthometric:
        return heights
    places = heights.select("lon", "lat").distinct()
    at = places.withColumns({"_fx": (F.col("lon") - ul_lon) / step, "_fy": (ul_lat - F.col("lat")) / step})
    corner = F.explode(F.array(*[F.struct((F.floor("_fx") + a).cast("long").alias("ix"), (F.floor("_fy") + b).cast("long").alias("iy"), ((F.col("_fx") - F.floor("_fx")) if a else 1 - (F.col("_fx") - F.floor("_fx"))).alias("u"), ((F.col("_fy") - F.floor("_fy")) if b else 1 - (F.col("_fy") - F.floor("_fy"))).alias("v")) for a in (0, 1) for b in (0, 1)]))
    need = at.select("lon", "lat", corner.alias("k")).select("lon", "lat", "k.*").where("u * v > 0")
    near = need.join(geoid.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.col("height").alias("_g")), ["ix", "iy"], "left")
    total = near.groupBy("lon", "lat").agg(F.when(F.count(F.when(F.col("_g").isNull(), 1)) == 0, F.sum(F.col("u") * F.col("v") * F.col("_g"))).alias("_g"))
    return heights.join(total, ["lon", "lat"], "left").withColumn("height", F.col("height") + F.col("_g")).select(*heights.columns)
