"""Composite products: geolocated pixels with angles and flags, pointing, and solar corrections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from skyfold.functions import geodesy as G
from skyfold.functions.vec import NAN, Vec

from .ephemeris import pixel_states, quality

SUN_RADIUS_KM, EARTH_RADIUS_KM = 695700.0, 6378.137


def geolocate(frames: DataFrame, pixels: DataFrame) -> DataFrame:
    """ugps, pixel, lon, lat, alt, view and solar zenith and azimuth, qf for every frame and pixel (1-based).

    frames: ugps, px..pz (km, Earth-fixed), r0..r8 (instrument to Earth-fixed, row-major), sun_x..sun_z; pixels: pixel, vx..vz
    (unit, instrument frame; a table of the instrument's size). NaN state or attitude, and misses, give NaN and flags.
    """
    rows = pixel_states(frames, pixels)
    v = Vec.columns("v")
    rows = rows.withColumns({f"d{a}": F.col(f"r{3 * i}") * v.x + F.col(f"r{3 * i + 1}") * v.y + F.col(f"r{3 * i + 2}") * v.z for i, a in enumerate("xyz")})
    at = G.intersect_ellipsoid(Vec.columns("d"), Vec.columns("p"))
    rows = rows.withColumns({f"g{a}": c for a, c in zip("xyz", at, strict=True)})
    lon, lat, alt = G.surface_lon_lat(Vec.columns("g"))
    no_state, no_attitude = F.isnan(F.col("px") + F.col("py") + F.col("pz")), F.isnan(F.col("dx") + F.col("dy") + F.col("dz"))
    ground, sat, sun = Vec.columns("g"), Vec.columns("p"), Vec.columns("sun_")
    return rows.select(
        "ugps", "pixel", lon.alias("lon"), lat.alias("lat"), alt.alias("alt"), G.zenith(ground, sat).alias("view_zenith"), G.azimuth(ground, sat).alias("view_azimuth"),
        G.zenith(ground, sun).alias("solar_zenith"), G.azimuth(ground, sun).alias("solar_azimuth"), quality(no_state, no_attitude & ~no_state, F.isnan("gx")).alias("qf"),
    )


def pointing(states: DataFrame, half_view_deg: float) -> DataFrame:
    """ugps, cosines of the boresight to Earth, Sun and Moon, whether the Sun is in view, occultation of the Sun by the Earth, flags.

    states: ugps, sc_x.. (km), b_x.. (unit boresight), sun_x.., moon_x.. (km; all in one frame).
    """
    sc, b = Vec.columns("sc_"), Vec.columns("b_")
    to = {"earth": sc.times(-1.0), "sun": Vec.columns("sun_").minus(sc), "moon": Vec.columns("moon_").minus(sc)}
    cosines = {f"{n}_cosine": G.boresight_cosine(v, b) for n, v in to.items()}
    seen = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sun_cosine")))))
    nadir = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("earth_cosine")))))
    rows = states.withColumns(cosines).withColumn("_r", sc.norm())
    in_nadir, full = G.field_of_view(nadir, half_view_deg, F.col("_r"))
    flags = in_nadir.cast("long").bitwiseOR(full.cast("long") * 2)
    dark = G.occultation(sc, Vec.of(0.0, 0.0, 0.0), Vec.columns("sun_"), EARTH_RADIUS_KM, SUN_RADIUS_KM)
    bad = F.isnan(F.col("earth_cosine"))
    return rows.select("ugps", *cosines, F.when(bad, -1).otherwise((seen <= half_view_deg).cast("int")).alias("sun_in_view"), dark.alias("sun_occultation"), flags.alias("qf"))


def corrections(states: DataFrame) -> DataFrame:
    """ugps, distance factor and Doppler factor towards the Sun, NaN without data. states: ugps, x.., vx.. relative to the Sun."""
    p, v = Vec.columns(""), Vec.columns("v")
    ok = ~F.isnan(F.col("x"))
    return states.select("ugps", F.when(ok, G.distance_correction(p)).otherwise(F.lit(NAN)).alias("sun_distance_correction"), F.when(ok, G.doppler_factor(p, v)).otherwise(F.lit(NAN)).alias("sun_doppler_factor"))


