"""Image matching end to end: point spread on the ground, blur, resample, chip as the instrument sees it, search, result row.

One observation and chip are one row of arrays; the chain runs in numpy through mapInArrow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from skyfold.functions import constants as K

from . import raster as R
from .terrain import _geodetic

POSITION_NAMES = [["sc_pos_x", "sc_pos_y", "sc_pos_z"], ["position_x", "position_y", "position_z"], ["r_x", "r_y", "r_z"], ["pos_x", "pos_y", "pos_z"]]  # fixed values, in order


@dataclass(frozen=True)
class Spread:
    """A point spread: values, and angles across (x, degrees) and along the field (field_angle, degrees)."""

    data: np.ndarray
    x: np.ndarray
    field_angle: np.ndarray


def _ecef_km(lon: float, lat: float, height_m: float) -> np.ndarray:
    la, lo = np.radians(lat), np.radians(lon)
    n = K.WGS84_A_KM / np.sqrt(1 - K.WGS84_E2 * np.sin(la) ** 2)
    h = height_m / 1000
    return np.array([(n + h) * np.cos(la) * np.cos(lo), (n + h) * np.cos(la) * np.sin(lo), (n * (1 - K.WGS84_E2) + h) * np.sin(la)])


def _triad(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Orthogonal axes (columns) from two directions: the first, their normal, and what completes these."""
    c = np.cross(a, b)
    c = c / np.linalg.norm(c)
    return np.stack([a, c, np.cross(a, c)], 1)


def project(spreads: list[Spread], position_m: np.ndarray, sight: np.ndarray, lat: np.ndarray, lon: np.ndarray, height_m: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, lat, lon) on the ground of the spread whose mean field angle is nearest to the middle detector's (the first of equal ones).

    sight: unit lines of sight of the detectors, one row each, in the instrument. The turn to Earth-fixed axes is the
    one that carries the first and last detector's lines to the image's places in its middle frame. ValueError without
    spreads, and where a line misses the ellipsoid.
    """
    if not spreads:
        raise ValueError("no point spread")
    frames, detectors = lat.shape
    f, d = frames // 2, detectors // 2
    middle = sight[d]
    wanted = np.arctan2(middle[1], middle[2])
    best = spreads[int(np.argmin([abs(np.radians(s.field_angle.mean()) - wanted) for s in spreads]))]
    sat = np.asarray(position_m, float) / 1000
    h = np.zeros_like(lat) if height_m is None else height_m
    ends = [_ecef_km(lon[f, k], lat[f, k], h[f, k]) - sat for k in (0, -1)]
    ends = [e / np.linalg.norm(e) for e in ends]
    turn = _triad(*ends) @ np.linalg.inv(_triad(sight[0], sight[-1]))
    x = np.sin(np.arcsin(middle[0]) + np.radians(best.x - best.x.mean()))[None, :]
    y = np.sin(np.arcsin(middle[1]) + np.radians(best.field_angle - best.field_angle.mean()))[:, None]
    x, y = np.broadcast_arrays(x, y)
    rays = np.stack([x, y, np.sqrt(np.maximum(0.0, 1 - x * x - y * y))], -1).reshape(-1, 3) @ turn.T
    scale = 1 / np.array([K.WGS84_A_KM, K.WGS84_A_KM, K.WGS84_B_KM])
    u, q = rays * scale, sat * scale
    uu, uq = (u * u).sum(1), u @ q
    under = uq * uq - uu * (q @ q - 1)
    if (under < 0).any():
        raise ValueError("a line of the point spread misses the ellipsoid")
    ground = sat + rays * ((-uq - np.sqrt(under)) / uu)[:, None]
    lons, lats, _ = _geodetic(ground)
    return best.data.copy(), lats.reshape(x.shape), lons.reshape(x.shape)


def moved(data: np.ndarray, lat: np.ndarray, lon: np.ndarray, image_lat: np.ndarray, image_lon: np.ndarray, d_lat: float, d_lon: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, lat axis, lon axis): the spread as it is drawn out over one step of the image's motion, on a regular grid.

    It is turned so that the motion runs along the grid's rows, put there by nearest values, drawn out, and turned back: the
    value at a place of the grid is that of the drawn spread where the same turn takes the place.
    """
    v, u = float(np.diff(image_lat, axis=1).mean()), float(np.diff(image_lon, axis=1).mean())
    far, angle = float(np.hypot(u, v)), -np.arctan2(v, u)
    c, s = np.cos(angle), np.sin(angle)
    x0, y0 = lon.mean(), lat.mean()
    x, y = x0 + c * (lon - x0) - s * (lat - y0), y0 + s * (lon - x0) + c * (lat - y0)
    gx, gy = np.arange(x.min() - far / 2, x.max() + far / 2 + d_lon, d_lon), np.arange(y.min(), y.max() + d_lat, d_lat)
    flat_x, flat_y, values = x.ravel(), y.ravel(), data.ravel()
    grid = np.stack([values[np.argmin((flat_x[None] - gx[:, None]) ** 2 + (flat_y[None] - b) ** 2, 1)] for b in gy])
    n = max(1, int(round(abs(far / d_lon))))
    drawn = R.convolve_same(grid, np.ones((1, n)))
    px, py = np.meshgrid(gx - x0, gy - y0)
    at_x, at_y = (x0 + c * px - s * py - gx[0]) / d_lon, (y0 + s * px + c * py - gy[0]) / d_lat
    axes = [np.arange(k, dtype=float) for k in drawn.shape]
    return R.sample_bilinear(drawn, *axes, at_y, at_x), gy, gx


def chain(image: tuple, chip: tuple, position_m: np.ndarray, sight: np.ndarray, spreads: list[Spread], d_lat: float = 2.4e-4, d_lon: float = 2.4e-4, how: R.Search = R.Search()) -> tuple[float, float, float, int, int]:
    """As search_shift(), of the image on the chip as the instrument would see it: project, move, pad, resample to the chip, normalise, blur, search."""
    values, lat, lon = image
    chip_data, chip_lat, chip_lon = chip
    spread, s_lat, s_lon = project(spreads, position_m, sight, lat, lon)
    spread, y, x = moved(spread, s_lat, s_lon, lat, lon, d_lat, d_lon)
    spread = R.pad_to_centroid(spread)
    steps = abs(float(np.diff(chip_lat[:, 0]).mean())) / d_lat, abs(float(np.diff(chip_lon[0]).mean())) / d_lon
    spread = np.pad(spread, 1)
    mid = [n // 2 for n in spread.shape]  # the centroid's place, that stays a sample
    at = [m + k * np.arange(-int(m / k), int(m / k) + 1) for m, k in zip(mid, steps, strict=True)]
    axes = [np.arange(n, dtype=float) for n in spread.shape]
    spread = R.sample_bilinear(spread, *axes, *np.meshgrid(*at, indexing="ij"))
    return R.search_shift((R.blur_with_psf(chip_data, R.normalize(spread)), chip_lat, chip_lon), (values, lat, lon), how)


RESULT = "lat_error_km double, lon_error_km double, lat_error_deg double, lon_error_deg double, ccv double, row int, col int, error string"
_RESULT = [pa.field(f.split()[0], {"double": pa.float64(), "int": pa.int32(), "string": pa.string()}[f.split()[1]]) for f in RESULT.split(", ")]
_GRIDS = [f"{k}_{c}" for k in ("img", "gcp") for c in ("data", "lat", "lon")]


def match(pairs: DataFrame, sight: np.ndarray, spreads: list[Spread], how: R.Search = R.Search(), keys: tuple[str, ...] = ("pair_id",)) -> DataFrame:
    """One row a pair: keys, errors in km and degrees, correlation, place of the best shift, and why a pair failed (then the rest is null).

    pairs: keys, img_data, img_lat, img_lon, gcp_data, gcp_lat, gcp_lon (arrays of arrays), px, py, pz (m). An error is the
    image's place less the place where it was found, so its sign is that of the shift reversed; in km by the equator's radius, and the
    cosine of the latitude in the middle of the image. The lines of sight and the spreads are an instrument's calibration: they
    go to all executors.
    """
    kept = pairs.select(*keys, *_GRIDS, "px", "py", "pz")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            at = [batch.column(c).to_pylist() for c in ("px", "py", "pz")]
            for i in range(batch.num_rows):
                row = dict.fromkeys([f.name for f in _RESULT])
                try:
                    grids = [R.grid_of(batch.column(c), i) for c in _GRIDS]
                    d_lat, d_lon, ccv, k, m = chain(tuple(grids[:3]), tuple(grids[3:]), np.array([a[i] for a in at], float), sight, spreads, how=how)
                    middle = tuple(n // 2 for n in grids[1].shape)
                    lat_km, lon_km = (float(-np.radians(d) * K.WGS84_A_KM) for d in (d_lat, d_lon * np.cos(np.radians(grids[1][middle]))))
                    chip_lat = np.cos(np.radians(grids[4][tuple(n // 2 for n in grids[4].shape)]))
                    degrees = lat_km / R.KM_PER_DEG, float(lon_km / (K.WGS84_A_KM * chip_lat * np.pi / 180))
                    row |= {"lat_error_km": lat_km, "lon_error_km": lon_km, "lat_error_deg": degrees[0], "lon_error_deg": degrees[1], "ccv": ccv, "row": int(k), "col": int(m)}
                except (ValueError, TypeError, IndexError, np.linalg.LinAlgError) as e:
                    row["error"] = str(e)
                out.append(row)
            made = pa.RecordBatch.from_pylist(out, schema=pa.schema(_RESULT))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *made.columns], names=[*keys, *made.schema.names])

    return kept.mapInArrow(run, StructType([*(kept.schema[k] for k in keys), *StructType.fromDDL(RESULT).fields]))


def match_all(observations: DataFrame, chips: DataFrame, pairs: DataFrame, sight: np.ndarray, spreads: list[Spread], how: R.Search = R.Search()) -> DataFrame:
    """match() of stated pairs (obs_id, gcp_id): observations (obs_id, img_.., px..pz) and chips (gcp_id, gcp_..) are joined by key; failed pairs are left out."""
    rows = pairs.join(observations, "obs_id").join(chips, "gcp_id")
    return match(rows, sight, spreads, how, ("obs_id", "gcp_id")).where("error is null").drop("error")


def km_to_degrees(lat_km: Column, lon_km: Column, lat_deg: Column) -> tuple[Column, Column]:
    """Errors in degrees: 111 km a degree of latitude; of longitude by the equator's radius and the cosine."""
    return lat_km / R.KM_PER_DEG, lon_km / (K.WGS84_A_KM * F.cos(F.radians(lat_deg)) * (np.pi / 180))


def position_columns(columns: list[str], wanted: list[str] | None = None) -> list[str]:
    """The three position columns of telemetry: those wanted, else the first known triple, else the first three that look like positions; ValueError without any."""
    if wanted is not None:
        if len(wanted) != 3 or not set(wanted) <= set(columns):
            raise ValueError(f"three columns of {columns} are needed, not {wanted}")
        return wanted
    for triple in POSITION_NAMES:
        if set(triple) <= set(columns):
            return triple
    like = [c for c in columns if "pos" in c.lower() or c.startswith("r_")]
    if len(like) < 3:
        raise ValueError(f"no position columns among {columns}")
    return like[:3]


def mid_frame(telemetry: DataFrame, key: str, order: str, wanted: list[str] | None = None) -> DataFrame:
    """key with x, y, z of the row in the middle (number n // 2 from 0) of each observation's telemetry."""
    names = position_columns(telemetry.columns, wanted)
    w = Window.partitionBy(key)
    at = telemetry.withColumns({"_i": F.row_number().over(w.orderBy(order)) - 1, "_n": F.count(F.lit(1)).over(w)}).where(F.col("_i") == F.floor(F.col("_n") / 2))
    return at.select(key, *[F.col(c).cast("double").alias(a) for a, c in zip("xyz", names, strict=True)])


def nadir_fallback(images: DataFrame, altitude_m: float) -> DataFrame:
    """images (image_id, lat, lon of the centre, and sx, sy, sz or null) with s (spacecraft, m) and b (unit boresight): to nadir; without a position, above the centre at an altitude over the equator's radius."""
    la, lo, r = F.radians("lat"), F.radians("lon"), K.WGS84_A_KM * 1000 + altitude_m
    own = [F.cos(la) * F.cos(lo) * r, F.cos(la) * F.sin(lo) * r, F.sin(la) * r]
    known = F.col("sx").isNotNull() & F.col("sy").isNotNull() & F.col("sz").isNotNull()
    out = images.withColumns({f"s{a}": F.when(known, F.col(f"s{a}")).otherwise(c) for a, c in zip("xyz", own, strict=True)})
    n = F.sqrt(F.col("sx") * F.col("sx") + F.col("sy") * F.col("sy") + F.col("sz") * F.col("sz"))
    return out.withColumns({f"b{a}": -F.col(f"s{a}") / n for a in "xyz"})


def grid_bounds(corners: DataFrame, key: str, conservative: bool = True) -> DataFrame:
    """key, min_lon, max_lon, min_lat, max_lat of the largest box inside a chip's corners, or of all its cells.

    corners: key, row, col, lon, lat of a chip whose row 0 is north and column 0 west.
    """
    if not conservative:
        return corners.groupBy(key).agg(F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"), F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"))
    ends = corners.groupBy(key).agg(F.max("row").alias("_r"), F.max("col").alias("_c"))
    at = corners.join(ends, key)
    west, east, north, south = F.col("col") == 0, F.col("col") == F.col("_c"), F.col("row") == 0, F.col("row") == F.col("_r")
    on = lambda side, across, value, f: f(F.when(side & across, F.col(value)))
    ends_ns, ends_we = north | south, west | east
    return at.groupBy(key).agg(on(west, ends_ns, "lon", F.max).alias("min_lon"), on(east, ends_ns, "lon", F.min).alias("max_lon"), on(south, ends_we, "lat", F.max).alias("min_lat"), on(north, ends_we, "lat", F.min).alias("max_lat"))


def regular_grid(bounds: DataFrame, key: str, size: tuple[int, int] | None = None, resolution: tuple[float, float] | None = None) -> DataFrame:
    """key, gi, gj, lon, lat: row 0 in the north; by a number of rows and columns or by a resolution in degrees (lat, lon); exactly one of them."""
    if (size is None) == (resolution is None):
        raise ValueError("either a size or a resolution")
    span = [F.col("max_lat") - F.col("min_lat"), F.col("max_lon") - F.col("min_lon")]
    n = [F.lit(k) for k in size] if size else [F.greatest(F.lit(2), F.ceil(s / r).cast("int") + 1) for s, r in zip(span, resolution, strict=True)]
    b = bounds.withColumns({"_m": n[0].cast("int"), "_n": n[1].cast("int")})
    b = b.withColumn("gi", F.explode(F.sequence(F.lit(0), F.col("_m") - 1))).withColumn("gj", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    lat, lon = F.col("max_lat") - F.col("gi") * (span[0] / (F.col("_m") - 1)), F.col("min_lon") + F.col("gj") * (span[1] / (F.col("_n") - 1))
    return b.select(key, "gi", "gj", lon.alias("lon"), lat.alias("lat"))


def regrid_chips(chips: DataFrame, cell_deg: float, key: str = "image_id", size: tuple[int, int] | None = None, resolution: tuple[float, float] | None = None, conservative: bool = True, method: str = "bilinear", fill: float = float("nan")) -> DataFrame:
    """Chips in Earth-fixed metres (key, row, col, x, y, z, value) onto regular grids: geodetic places, bounds, grid, regrid; heights are not carried on."""
    from skyfold.functions import geodesy as G
    from skyfold.functions.vec import Vec

    lon, lat, _ = G.ecef_to_geodetic(Vec.columns(""), meters=True)
    cells = chips.select(key, "row", "col", lon.alias("lon"), lat.alias("lat"), "value")
    return R.regrid(cells, regular_grid(grid_bounds(cells, key, conservative), key, size, resolution), cell_deg, key, fill, method)
