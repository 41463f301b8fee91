"""Terrain correction: from the ellipsoid point back up the line of sight to where it first meets the ground."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from skyfold.functions import constants as K

STEP_KM, MOST_STEPS, MOST_ZENITH_DEG = 0.5, 1000, 85.0
MOST_DEM_BYTES = 512 << 20
SCHEMA = "lon double, lat double, alt double, qf long"


def _geodetic(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bowring's start and three rounds of it: far below a millimetre near the surface."""
    a, e2 = K.WGS84_A_KM, K.WGS84_E2
    r = np.hypot(p[:, 0], p[:, 1])
    lat = np.arctan2(p[:, 2], r * (1 - e2))
    for _ in range(4):
        n = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
        lat = np.arctan2(p[:, 2] + e2 * n * np.sin(lat), r)
    n = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    alt = r * np.cos(lat) + p[:, 2] * np.sin(lat) - a * a / n
    return np.degrees(np.arctan2(p[:, 1], p[:, 0])), np.degrees(lat), alt


def march(surface: np.ndarray, satellite: np.ndarray, height: Callable[[np.ndarray, np.ndarray], np.ndarray], low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(lon, lat, alt) rows and flags. height(lon, lat) in km lies in [low, high].

    The walk starts where the line of sight has altitude `high` and goes down in steps of STEP_KM / sin(zenith);
    between the last step above ground and the first below it the crossing is interpolated.
    """
    n = len(surface)
    out, flags = np.full((n, 3), np.nan), np.zeros(n, np.int64)
    view = satellite - surface
    view /= np.linalg.norm(view, axis=1)[:, None]
    lon, lat, _ = _geodetic(surface)
    la, lo = np.radians(lat), np.radians(lon)
    up = np.stack([np.cos(la) * np.cos(lo), np.cos(la) * np.sin(lo), np.sin(la)], 1)
    cosine = np.clip((up * view).sum(1), -1, 1)
    zenith = np.arccos(cosine)
    bad = ~np.isfinite(surface).all(1) | ~np.isfinite(satellite).all(1)
    steep = ~bad & (zenith > np.radians(MOST_ZENITH_DEG))
    flags[bad] |= K.QUALITY_FLAGS["CALC_TERRAIN_NOT_FINITE"]
    flags[steep] |= K.QUALITY_FLAGS["CALC_TERRAIN_EXTREME_ZENITH"]
    act = np.flatnonzero(~bad & ~steep)
    along = high / np.maximum(cosine, 1e-9)
    for _ in range(5):  # a few corrections for the curvature
        p = surface[act] + view[act] * along[act, None]
        along[act] += (high - _geodetic(p)[2]) / cosine[act]
    least = low / np.maximum(cosine, 1e-9) - 1.0
    lost = along[act] <= least[act]  # the point is not on the line's way down through the heights given
    flags[act[lost]] |= K.QUALITY_FLAGS["CALC_TERRAIN_MAX_ITER"]
    act = act[~lost]
    step = np.minimum(STEP_KM / np.maximum(np.sin(zenith), 1e-9), np.maximum(along - least, 1e-6))
    lon0, lat0, alt0 = (np.zeros(n) for _ in range(3))
    lon0[act], lat0[act], alt0[act] = _geodetic(surface[act] + view[act] * along[act, None])
    h0 = np.zeros(n)
    h0[act] = height(lon0[act], lat0[act])
    for _ in range(MOST_STEPS):
        if not len(act):
            break
        nxt = along[act] - step[act]
        lon1, lat1, alt1 = _geodetic(surface[act] + view[act] * nxt[:, None])
        h1 = height(lon1, lat1)
        met = h1 >= alt1
        i = act[met]
        share = (alt0[i] - h0[i]) / np.where((h1[met] - h0[i]) - (alt1[met] - alt0[i]) == 0, 1, (h1[met] - h0[i]) - (alt1[met] - alt0[i]))
        at = nxt[met] + (1 - share) * step[i]
        out[i] = np.stack(_geodetic(surface[i] + view[i] * at[:, None]), 1)
        along[act], alt0[act], h0[act] = nxt, alt1, h1
        act = act[~met]
    flags[act] |= K.QUALITY_FLAGS["CALC_TERRAIN_MAX_ITER"]
    return out, flags


def correct(points: DataFrame, dem: np.ndarray, ul_lon: float, ul_lat: float, step: float) -> DataFrame:
    """(id, lon, lat, alt km, qf) for points (id, x, y, z on the ellipsoid, sx, sy, sz of the satellite; km). id is of any type and may repeat.

    dem is one region's grid of heights (km; rows from the north), of a size that one product's region fixes; outside
    it the height is 0. Rows with flags have NaN places.
    """
    held = points.sparkSession.sparkContext.broadcast(dem) if dem.nbytes <= MOST_DEM_BYTES else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = held.value

        def height(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
            lon = np.where(lon < ul_lon - step / 2, lon + 360, lon)
            ix, iy = ((lon - ul_lon + step / 2) / step).astype(int), ((ul_lat - lat + step / 2) / step).astype(int)
            ok = (ix >= 0) & (iy >= 0) & (ix < grid.shape[1]) & (iy < grid.shape[0])
            return np.where(ok, grid[np.where(ok, iy, 0), np.where(ok, ix, 0)], 0.0)

        for batch in batches:
            xyz = np.stack([pc.fill_null(batch.column(i).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False) for i in range(1, 7)], 1).astype(float)
            out, flags = march(xyz[:, :3], xyz[:, 3:], height, float(min(0.0, grid.min())), float(max(0.0, grid.max())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[:, i]) for i in range(3)), pa.array(flags)], names=["id", "lon", "lat", "alt", "qf"])

    if dem.nbytes > MOST_DEM_BYTES:
        raise ValueError(f"a region's heights are sent to all executors: {MOST_DEM_BYTES} bytes at most")
    rays = points.select("id", "x", "y", "z", "sx", "sy", "sz").repartition(int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rays.mapInArrow(run, StructType([rays.schema["id"], *StructType.fromDDL(SCHEMA).fields]))
