"""Raster operators: matching of images by correlation search, regridding, point-spread functions, elevation tiles.

Rasters are rows: one row an image with arrays (data, lat, lon as array<array<double>>), or one row a cell. Numeric kernels
run in numpy, one image pair a row, through mapInArrow; cell-wise operators are joins and aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from skyfold.functions import constants as K
from skyfold.functions.vec import NAN, not_nan, safe_div

from . import scan
from .ranks import bucket_of, durable

#: Kilometres of a degree of latitude where errors in km become degrees; the search itself takes the equator's radius.
KM_PER_DEG = 111.0
RADIANS_KM = K.WGS84_A_KM


# --- numpy kernels -------------------------------------------------------------------------------------------------


def correlation(a: np.ndarray, b: np.ndarray) -> float:
    """Pearson's, 0 where a raster is constant."""
    da, db = a - a.mean(), b - b.mean()
    norm = float(np.sqrt((da * da).sum() * (db * db).sum()))
    return float((da * db).sum()) / norm if norm > 0 else 0.0


def ascending(axis: np.ndarray) -> bool:
    """Whether a strictly monotonic axis rises; another one is an error."""
    d = np.diff(axis)
    if (d > 0).all():
        return True
    if (d < 0).all():
        return False
    raise ValueError("an axis is not strictly monotonic")


def sample_bilinear(data: np.ndarray, rows: np.ndarray, cols: np.ndarray, at_row: np.ndarray, at_col: np.ndarray, fill: float = 0.0) -> np.ndarray:
    """Values at points of a raster on two axes; fill outside."""
    if not ascending(rows):
        rows, data = rows[::-1], data[::-1]
    if not ascending(cols):
        cols, data = cols[::-1], data[:, ::-1]
    i = np.clip(np.searchsorted(rows, at_row, "right") - 1, 0, len(rows) - 2)
    j = np.clip(np.searchsorted(cols, at_col, "right") - 1, 0, len(cols) - 2)
    u, v = (at_row - rows[i]) / (rows[i + 1] - rows[i]), (at_col - cols[j]) / (cols[j + 1] - cols[j])
    out = data[i, j] * (1 - u) * (1 - v) + data[i + 1, j] * u * (1 - v) + data[i, j + 1] * (1 - u) * v + data[i + 1, j + 1] * u * v
    return np.where((u >= 0) & (u <= 1) & (v >= 0) & (v <= 1), out, fill)


@dataclass(frozen=True)
class Search:
    """The window that shifts span (its full width), how many on each axis, and how spacing shrinks down to the last one."""

    grid_span_km: float = 11.0
    steps: int = 44
    reduction: float = 0.8
    last_spacing_km: float = 0.010

    def rounds(self) -> list[float]:
        """Spacings in km, all above the last one."""
        out, spacing = [], self.grid_span_km / (self.steps - 1)
        while spacing > self.last_spacing_km:
            out.append(spacing)
            spacing *= self.reduction
        return out


def _weights(axis: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Weights of an axis' points in sample_bilinear() at each position, zero outside."""
    if not ascending(axis):
        return _weights(axis[::-1], at)[..., ::-1]
    i = np.clip(np.searchsorted(axis, at, "right") - 1, 0, len(axis) - 2)
    u = (at - axis[i]) / (axis[i + 1] - axis[i])
    inside, out = (u >= 0) & (u <= 1), np.zeros((*at.shape, len(axis)))
    np.put_along_axis(out, i[..., None], (inside * (1 - u))[..., None], -1)
    np.put_along_axis(out, i[..., None] + 1, (inside * u)[..., None], -1)
    return out


def _candidates(values: np.ndarray, data: np.ndarray, by_row: np.ndarray, by_col: np.ndarray) -> np.ndarray:
    """The shifts (k, m), in order, among which the first best correlation is for certain; all of them at once by matrix products.

    by_row[k] and by_col[m] are weights of an image whose latitude depends on the row only, and its longitude on the column.
    """
    da, n, k, m = values - values.mean(), values.size, len(by_row), len(by_col)
    a = by_row @ data
    mean = a.sum(1) @ by_col.sum(1).T / n
    square = (a.transpose(0, 2, 1) @ a).reshape(k, -1) @ (by_col.transpose(0, 2, 1) @ by_col).reshape(m, -1).T
    cov = (da.T @ a).reshape(k, -1) @ by_col.reshape(m, -1).T - mean * da.sum()
    spread, own = square - n * mean * mean, float((da * da).sum())
    zero = (square == 0) | (own == 0)  # correlation() is exactly 0
    with np.errstate(all="ignore"):
        c = np.where(zero, 0.0, np.where(spread > 1e-4 * square, cov / np.sqrt(spread * own), np.nan))
    unsure = np.isnan(c)
    some = unsure | (c >= (np.nan if unsure.all() else np.nanmax(c)) - 1e-9)
    zeros = np.flatnonzero(some & zero)
    some.ravel()[zeros[1:]] = False
    return np.argwhere(some)


def grid_of(column: pa.Array, i: int) -> np.ndarray:
    """Row i of a column of arrays of numeric arrays, without a Python object for each number; TypeError for nulls, ValueError for uneven rows."""
    cell = column[i]
    if not cell.is_valid or cell.values.null_count:
        raise TypeError("a raster, or a row of it, is null")
    rows = cell.values
    flat, sizes = rows.flatten(), rows.value_lengths().to_numpy(zero_copy_only=False)
    if flat.null_count:
        raise TypeError("a raster has a null value")
    if not len(sizes) or (sizes != sizes[0]).any():
        raise ValueError("a raster has no rows, or rows of different lengths")
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(sizes), -1)


def search_shift(gcp: tuple[np.ndarray, np.ndarray, np.ndarray], image: tuple[np.ndarray, np.ndarray, np.ndarray], how: Search = Search()) -> tuple[float, float, float, int, int]:
    """(lat shift, lon shift in degrees, correlation, row and column of the last best shift) of an image on a chip.

    Each round tries all shifts of a square grid around the best one so far, then the grid shrinks. The first of equal
    correlations wins, rows first, row 0 being the shift farthest north and column 0 farthest west. A degree of longitude
    counts as one of latitude, and that as one of the equator.
    """
    data, lat, lon = gcp
    values, lats, lons = image
    rows, cols = lat[:, 0], lon[0]
    best = (0.0, 0.0, -np.inf, 0, 0)
    mid = how.steps // 2
    centre = (0.0, 0.0)
    every = [(k, m) for k in range(how.steps) for m in range(how.steps)]
    even = max(*data.shape, *values.shape) <= 128 and min(data.shape) > 1 and data.shape == (len(rows), len(cols)) and values.shape == lats.shape == lons.shape and (lats == lats[:, :1]).all() and (lons == lons[:1]).all()
    for spacing in how.rounds():
        step = np.degrees(spacing / RADIANS_KM)
        top = (-np.inf, 0, 0)
        shifts = (np.arange(how.steps) - mid) * step
        tried = _candidates(values, data, _weights(rows, lats[:, 0] + centre[0] - shifts[:, None]), _weights(cols, lons[0] + centre[1] + shifts[:, None])).tolist() if even else every
        for k, m in tried:
            moved = sample_bilinear(data, rows, cols, lats + centre[0] + (mid - k) * step, lons + centre[1] + (m - mid) * step)
            c = correlation(values, moved)
            if c > top[0]:
                top = (c, k, m)
        centre = (centre[0] + (mid - top[1]) * step, centre[1] + (top[2] - mid) * step)
        best = (*centre, top[0], top[1], top[2])
    return best


def convolve_same(image: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Linear convolution by FFT, of the image's shape."""
    shape = [a + b - 1 for a, b in zip(image.shape, kernel.shape, strict=True)]
    full = np.fft.irfft2(np.fft.rfft2(image, shape) * np.fft.rfft2(kernel, shape), shape)
    r, c = ((k - 1) // 2 for k in kernel.shape)
    return full[r : r + image.shape[0], c : c + image.shape[1]]


def blur_with_psf(image: np.ndarray, psf: np.ndarray) -> np.ndarray:
    """A chip as the instrument sees it: convolved with the point spread, rows of which run the other way."""
    return convolve_same(image, np.flipud(psf))


def normalize(psf: np.ndarray) -> np.ndarray:
    total = psf.sum()
    if total == 0:
        raise ValueError("a point spread without mass")
    return psf / total


def centroid(weights: np.ndarray) -> float:
    total = weights.sum()
    if total == 0:
        raise ValueError("weights without mass have no centroid")
    return float((np.arange(len(weights)) * weights).sum() / total)


def pad_to_centroid(psf: np.ndarray) -> np.ndarray:
    """With zero rows and columns, so that the rounded centroid lies in the middle."""
    for axis in (0, 1):
        n = psf.shape[axis]
        c = int(round(centroid(psf.sum(1 - axis))))
        extra = n - 1 - 2 * c
        pad = [(0, 0), (0, 0)]
        pad[axis] = (max(0, extra), max(0, -extra))
        psf = np.pad(psf, pad)
    return psf


def motion_blur(psf: np.ndarray, pixels: float, angle_deg: float = 0.0) -> np.ndarray:
    """Box filter along a direction: the mean of copies moved by up to half the way to both sides."""
    n = max(1, int(round(pixels)))
    r, c = np.meshgrid(*(np.arange(s, dtype=float) for s in psf.shape), indexing="ij")
    dr, dc = np.sin(np.radians(angle_deg)), np.cos(np.radians(angle_deg))
    axes = [np.arange(s, dtype=float) for s in psf.shape]
    return sum(sample_bilinear(psf, *axes, r - t * dr, c - t * dc) for t in np.arange(n) - (n - 1) / 2) / n


def resample(data: np.ndarray, rows: np.ndarray, cols: np.ndarray, step_row: float, step_col: float) -> np.ndarray:
    """Onto even steps from the first to the last point of both axes."""
    r = np.arange(rows[0], rows[-1] + abs(step_row) / 2 * np.sign(rows[-1] - rows[0]), step_row)
    c = np.arange(cols[0], cols[-1] + abs(step_col) / 2 * np.sign(cols[-1] - cols[0]), step_col)
    return sample_bilinear(data, rows, cols, *np.meshgrid(np.clip(r, min(rows), max(rows)), np.clip(c, min(cols), max(cols)), indexing="ij"))


def match_images(pairs: DataFrame, how: Search = Search()) -> DataFrame:
    """pair_id, lat_shift_deg, lon_shift_deg, ccv, row, col, error for rows of pair_id and six arrays of arrays.

    gcp_data, gcp_lat, gcp_lon (a regular chip) and img_data, img_lat, img_lon. A pair that can't be matched has its
    reason in error and null elsewhere; one pair is one row, so a task holds one pair at a time.
    """
    names = ["gcp_data", "gcp_lat", "gcp_lon", "img_data", "img_lat", "img_lon"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, pair_id in enumerate(batch.column(0).to_pylist()):
                try:
                    grids = [grid_of(batch.column(n), i) for n in names]
                    out.append((pair_id, *search_shift(tuple(grids[:3]), tuple(grids[3:]), how), None))
                except (ValueError, TypeError, IndexError) as e:
                    out.append((pair_id, None, None, None, None, None, str(e)))
            yield pa.RecordBatch.from_pylist([dict(zip(["pair_id", "lat_shift_deg", "lon_shift_deg", "ccv", "row", "col", "error"], o, strict=True)) for o in out], schema=pa.schema([("pair_id", pa.int64()), ("lat_shift_deg", pa.float64()), ("lon_shift_deg", pa.float64()), ("ccv", pa.float64()), ("row", pa.int32()), ("col", pa.int32()), ("error", pa.string())]))

    return pairs.select(F.col("pair_id").cast("long"), *names).mapInArrow(run, "pair_id long, lat_shift_deg double, lon_shift_deg double, ccv double, row int, col int, error string")


# --- cell-wise operators -------------------------------------------------------------------------------------------


def ccv(a: Column, b: Column) -> Column:
    """Aggregate: Pearson's correlation over the rows of a group, 0 where one side is constant; from centred moments."""
    va, vb = F.var_pop(a), F.var_pop(b)
    return F.when((va == 0) | (vb == 0), 0.0).otherwise(safe_div(F.covar_pop(a, b), F.sqrt(va) * F.sqrt(vb)))


def array_ccv(a: Column, b: Column) -> Column:
    """The same for two arrays of one row."""
    n = F.size(a).cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    ma, mb = total(a) / n, total(b) / n
    cov = total(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    va, vb = total(F.transform(a, lambda x: (x - ma) * (x - ma))), total(F.transform(b, lambda y: (y - mb) * (y - mb)))
    return F.when(va * vb == 0, 0.0).otherwise(safe_div(cov, F.sqrt(va * vb)))


def best_shift(scores: DataFrame, by: list[str]) -> DataFrame:
    """Row of the largest ccv of each key; of equal ones the first by (k, kk). NaN never wins."""
    w = Window.partitionBy(*by).orderBy(F.when(F.isnan("ccv"), None).otherwise(F.col("ccv")).desc_nulls_last(), "k", "kk")
    return scores.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def bilinear_at(points: DataFrame, cells: DataFrame, fill: float = 0.0) -> DataFrame:
    """points (id, r, c in cell units) with value, from cells (row, col, value) by four equi-joined neighbours; fill outside.

    Equal points are looked up once and come back as often as they came.
    """
    once = points.groupBy(*points.columns).agg(F.count(F.lit(1)).alias("_times"))
    p = once.withColumns({"_i": F.floor("r").cast("long"), "_j": F.floor("c").cast("long")})
    corner = F.explode(F.array(*[F.struct((F.col("_i") + a).alias("row"), (F.col("_j") + b).alias("col"), ((F.col("r") - F.col("_i")) if a else 1 - (F.col("r") - F.col("_i"))).alias("u"), ((F.col("c") - F.col("_j")) if b else 1 - (F.col("c") - F.col("_j"))).alias("v")) for a in (0, 1) for b in (0, 1)]))
    need = p.select(*points.columns, "_times", corner.alias("k")).select(*points.columns, "_times", "k.*").where("u * v > 0")
    got = need.join(cells.select(F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.col("value").alias("_x")), ["row", "col"], "left")
    agg = got.groupBy(*points.columns, "_times").agg(F.sum(F.col("u") * F.col("v") * F.col("_x")).alias("_s"), F.count(F.when(F.col("_x").isNull(), 1)).alias("_miss"))
    value = F.when(F.col("_miss") > 0, F.lit(fill)).otherwise(F.col("_s")).alias("value")
    return agg.select(*points.columns, value, F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_k")).drop("_k")


def nearest_entry(points: DataFrame, entries: DataFrame, at: str, axis: str, key: str, name: str) -> DataFrame:
    """key and the name of the entry whose axis value is nearest to at, the first (by name) of equally near ones; no join of all pairs.

    Entries and points are ordered together inside ranges of the axis. What a range does not hold is the last entry
    before it and the first one after it: two values a range, sent along with it.
    """
    every = entries.groupBy(F.col(axis).cast("double").alias("_x")).agg(F.min(name).alias("_e"))
    asked = points.select(F.col(key), F.col(at).cast("double").alias("_x"))
    bucket = bucket_of(asked, "_x")
    held = every.withColumn("_b", bucket)
    edge = held.groupBy("_b").agg(F.min(F.struct("_x", "_e")).alias("_low"), F.max(F.struct("_x", "_e")).alias("_high"))
    order = Window.orderBy("_b")  # a row for each range
    ranges = asked.select(bucket.alias("_b")).distinct().unionByName(edge.select("_b")).distinct().join(edge, "_b", "left")
    before, after = F.last("_high", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.first("_low", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    ends = ranges.select("_b", before.alias("_before"), after.alias("_after"))
    rows = asked.withColumn("_b", bucket).select(key, "_x", "_b", F.lit(None).cast(every.schema["_e"].dataType).alias("_e"))
    rows = rows.unionByName(held.select(F.lit(None).cast(asked.schema[key].dataType).alias(key), "_x", "_b", "_e"))
    entry = F.when(F.col("_e").isNotNull(), F.struct("_x", "_e"))
    up, down = Window.partitionBy("_b").orderBy("_x"), Window.partitionBy("_b").orderBy(F.desc("_x"))
    rows = rows.withColumns({"_l": F.last(entry, ignorenulls=True).over(up), "_r": F.last(entry, ignorenulls=True).over(down)}).where(F.col(key).isNotNull()).join(F.broadcast(ends), "_b", "left")
    near = F.array_sort(F.transform(F.filter(F.array("_l", "_r", "_before", "_after"), lambda c: c.isNotNull()), lambda c: F.struct(F.abs(c["_x"] - F.col("_x")).alias("d"), c["_e"].alias("e"))))
    return rows.select(key, F.get(near, F.lit(0))["e"].alias(name))


def quad_corners(cells: DataFrame, key: str = "image_id") -> DataFrame:
    """Quadrilaterals of neighbouring grid points of each image: key, i, j, x0..x3, y0..y3, v0..v3 (around)."""
    w = Window.partitionBy(key, "col").orderBy("row")
    down = cells.select(key, "row", "col", F.struct("lon", "lat", "value").alias("a"), F.lead(F.struct("row", "lon", "lat", "value")).over(w).alias("b"))
    down = down.where(F.col("b.row") == F.col("row") + 1)
    w2 = Window.partitionBy(key, "row").orderBy("col")
    both = down.select(key, "row", "col", "a", "b", F.lead(F.struct("col", "a", "b")).over(w2).alias("n")).where(F.col("n.col") == F.col("col") + 1)
    around = ["a", "n.a", "n.b", "b"]
    return both.select(key, F.col("row").alias("i"), F.col("col").alias("j"), *[F.col(f"{c}.{f}").alias(f"{n}{k}") for f, n in (("lon", "x"), ("lat", "y"), ("value", "v")) for k, c in enumerate(around)])


def _inside_triangle(px: Column, py: Column, t: list[tuple[Column, Column]], tolerance: float = 1e-10) -> Column:
    (ax, ay), (bx, by), (cx, cy) = t
    area = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    u = safe_div((px - ax) * (cy - ay) - (py - ay) * (cx - ax), area)
    v = safe_div((bx - ax) * (py - ay) - (by - ay) * (px - ax), area)
    return (F.abs(area) >= 1e-14) & (u >= -tolerance) & (v >= -tolerance) & (u + v <= 1 + tolerance)


def bilinear_in_quad(px: Column, py: Column, x: list[Column], y: list[Column], v: list[Column]) -> Column:
    """Value at a point of the surface v = a + b x + c y + d x y through four corners; their mean where there is none."""
    rows = [[F.lit(1.0), x[k] - x[0], y[k] - y[0], (x[k] - x[0]) * (y[k] - y[0])] for k in range(4)]

    def det3(m):
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    base = [r[1:] for r in rows[1:]]
    rise = [v[k] - v[0] for k in (1, 2, 3)]
    d = det3(base)
    solve = [safe_div(det3([[rise[i] if c == k else base[i][c] for c in range(3)] for i in range(3)]), d) for k in range(3)]
    dx, dy = px - x[0], py - y[0]
    out = v[0] + solve[0] * dx + solve[1] * dy + solve[2] * dx * dy
    return F.when(F.abs(d) < 1e-18, (v[0] + v[1] + v[2] + v[3]) / 4).otherwise(out)


def _nearest_centre(points: pa.Table, quads: pa.Table) -> pa.Table:
    """Of one image: the points with (i, j) of the quadrilateral of the nearest centre, the first of equal ones; blocks of points at a time."""
    quads = quads.sort_by([("i", "ascending"), ("j", "ascending")])
    x, y = quads["x"].to_numpy(), quads["y"].to_numpy()
    lon, lat = points["lon"].to_numpy(), points["lat"].to_numpy()
    some = max(1, 1_000_000 // max(1, len(x)))
    blocks = [np.argmin((lon[k : k + some, None] - x) ** 2 + (lat[k : k + some, None] - y) ** 2, 1) for k in range(0, len(lon), some)] if len(x) else []
    at = np.concatenate([np.zeros(0, np.int64), *blocks])
    points = points.slice(0, len(at))
    return points.append_column("i", quads["i"].take(pa.array(at))).append_column("j", quads["j"].take(pa.array(at)))


def regrid(cells: DataFrame, grid: DataFrame, cell_deg: float, key: str = "image_id", fill: float = NAN, method: str = "bilinear", snap_over: int = 2500) -> DataFrame:
    """Irregular rasters onto regular points: key, gi, gj, lon, lat, value; fill where no quadrilateral holds the point.

    In images of more than snap_over cells such a point has the value of the quadrilateral of the nearest centre, carried on
    beyond it (as in the reference, which searches by centres in images of more than 2,500 points only). One image's centres and points without
    a quadrilateral must fit in one task.

    cells: key, row, col, lon, lat, value; grid: key, gi, gj, lon, lat. Quadrilaterals are dealt to square buckets of
    cell_deg; of several that hold a point the first (by row, column) counts. nearest takes the nearest corner's value.
    """
    quads = q = quad_corners(cells, key)
    x, y, v = ([F.col(f"{n}{k}") for k in range(4)] for n in "xyv")
    seq = lambda c: F.sequence(F.floor(F.least(*c) / cell_deg).cast("long"), F.floor(F.greatest(*c) / cell_deg).cast("long"))
    q = q.withColumn("_bx", F.explode(seq(x))).withColumn("_by", F.explode(seq(y))).withColumnRenamed(key, "_k")
    g = grid.withColumns({"_bx": F.floor(F.col("lon") / cell_deg).cast("long"), "_by": F.floor(F.col("lat") / cell_deg).cast("long")})
    px, py = F.col("lon"), F.col("lat")
    pts = list(zip(x, y, strict=True))
    holds = _inside_triangle(px, py, [pts[0], pts[1], pts[2]]) | _inside_triangle(px, py, [pts[0], pts[2], pts[3]])
    if method == "nearest":
        d = [(px - x[k]) * (px - x[k]) + (py - y[k]) * (py - y[k]) for k in range(4)]
        value = F.when(d[0] == F.least(*d), v[0]).when(d[1] == F.least(*d), v[1]).when(d[2] == F.least(*d), v[2]).otherwise(v[3])
    else:
        value = bilinear_in_quad(px, py, x, y, v)
    hit = g.join(q, (g["_bx"] == q["_bx"]) & (g["_by"] == q["_by"]) & (F.col(key) == F.col("_k"))).where(holds)
    first = hit.groupBy(key, "gi", "gj").agg(F.min_by(value, F.struct("i", "j")).alias("value"))
    big = cells.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > snap_over).select(key)
    placed = lambda a, b: a.isNotNull() & b.isNotNull() & ~F.isnan(a) & ~F.isnan(b)
    lost = grid.select(key, "gi", "gj", F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat")).where(placed(px, py)).join(first, [key, "gi", "gj"], "left_anti").join(big, key, "left_semi")
    centres = quads.select(key, "i", "j", ((x[0] + x[1] + x[2] + x[3]) / 4).cast("double").alias("x"), ((y[0] + y[1] + y[2] + y[3]) / 4).cast("double").alias("y"))
    centres = centres.where(placed(F.col("x"), F.col("y"))).join(big, key, "left_semi")
    out = StructType([*lost.schema.fields, centres.schema["i"], centres.schema["j"]])
    near = lost.groupBy(key).cogroup(centres.groupBy(key)).applyInArrow(_nearest_centre, out)
    first = first.unionByName(near.join(quads, [key, "i", "j"]).select(key, "gi", "gj", value.alias("value")))
    return grid.join(first, [key, "gi", "gj"], "left").select(key, "gi", "gj", "lon", "lat", F.coalesce("value", F.lit(fill)).alias("value"))


def regular_grid(bounds: DataFrame, rows: int, cols: int, key: str = "image_id") -> DataFrame:
    """Points of an even grid over (min_lon, max_lon, min_lat, max_lat) of each key, row 0 in the north."""
    at = lambda low, high, i, n: F.col(low) + (F.col(high) - F.col(low)) * F.col(i) / max(1, n - 1)
    out = bounds.withColumn("gi", F.explode(F.sequence(F.lit(0), F.lit(rows - 1)))).withColumn("gj", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
    return out.select(key, "gi", "gj", at("min_lon", "max_lon", "gj", cols).alias("lon"), at("max_lat", "min_lat", "gi", rows).alias("lat"))


#: Cells of a tile, about, and points that one group meets them with, about.
CELLS_PER_TILE, POINTS_PER_GROUP = 2_000, 50_000


def _cut_tiles(held: DataFrame, k: int):
    """How to deal cells (cell_id, cx, cy) to tiles of about CELLS_PER_TILE: strips of x, each cut by its own y. The bounds are all that the driver gets."""
    size = max(CELLS_PER_TILE, 4 * k)
    n = held.count()
    xs = np.array(scan.bounds_of(held, "cx", max(size, math.isqrt(n * size))), float)
    most = min(scan.MOST_RANGES, n // size + 2)
    strips = held.withColumn("_s", scan.range_of(F.col("cx"), xs.tolist())).groupBy("_s").agg(F.count(F.lit(1)), F.percentile_approx("cy", [i / most for i in range(1, most)], 5 * most)).collect()
    ys = [np.zeros(0)] * (len(xs) + 1)
    for s, rows, got in strips:
        cuts = min(most, rows // size + 1)
        ys[s] = np.array(sorted({got[i * most // cuts - 1] for i in range(1, cuts)}), float)
    first = np.cumsum([0, *[len(y) + 1 for y in ys]])

    def deal(batches):
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cx", "cy"))
            strip = np.searchsorted(xs, x, "right")
            tile = first[strip]
            for s in np.unique(strip):
                own = strip == s
                tile[own] += np.searchsorted(ys[s], y[own], "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tile.astype(np.int32))], names=[*batch.schema.names, "_tile"])

    return held.mapInArrow(deal, StructType([*held.schema.fields, StructField("_tile", IntegerType())]))


def _between(low, high, boxes, far: bool) -> np.ndarray:
    """Least (or greatest) distances of points within low..high (n x 2) and within boxes (m x 4: x, y low, x, y high): n x m, never more (less) than any computed one."""
    d = [(boxes[:, i] - high[:, i, None], low[:, i, None] - boxes[:, i + 2]) for i in (0, 1)]
    if far:
        d = [np.maximum(boxes[:, i + 2] - low[:, i, None], high[:, i, None] - boxes[:, i]) for i in (0, 1)]
    else:
        d = [np.maximum(np.maximum(a, b), 0.0) for a, b in d]
    return np.sqrt(d[0] ** 2 + d[1] ** 2)


def _tiles_of_points(boxes: np.ndarray, enough: np.ndarray):
    """For mapInArrow over points (point_id, x, y, _first, _bound): a row for each tile to meet.

    Without a _bound (null) that is the one tile of enough cells whose farthest corner is nearest; else all tiles but _first that may hold
    a cell within it. Points are taken in blocks of neighbours, so that a block looks at the tiles around it only.
    """

    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            n, at, tiles = len(x), [], []
            strip = np.empty(n, np.int64)
            strip[np.argsort(x)] = np.arange(n) // max(1, math.isqrt(n * 256))
            order = np.lexsort((y, strip))
            seek = batch.column("_bound").null_count == n
            first, bound = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_first", "_bound"))
            for i in range(0, n, 256):
                own = order[i : i + 256]
                p = np.stack([x[own], y[own]], 1)
                low, high = p.min(0)[None], p.max(0)[None]
                if seek:
                    near = np.flatnonzero(enough & (_between(low, high, boxes, False)[0] <= _between(low, high, boxes[enough], True).min()))
                    at.append(own)
                    tiles.append(near[_between(p, p, boxes[near], True).argmin(1)])
                else:
                    near = np.flatnonzero(_between(low, high, boxes, False)[0] <= bound[own].max())
                    a, t = np.nonzero((_between(p, p, boxes[near], False) <= bound[own, None]) & (near != first[own, None]))
                    at.append(own[a])
                    tiles.append(near[t])
            at, tiles = np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *tiles])
            for i in range(0, len(at), 100_000):
                got = batch.take(pa.array(at[i : i + 100_000]))
                yield pa.RecordBatch.from_arrays([*got.select(["point_id", "x", "y", "_bound"]).columns, pa.array(tiles[i : i + 100_000].astype(np.int32))], names=["point_id", "x", "y", "_bound", "_tile"])

    return run


def _nearest_of_tile(k: int):
    """For a cogroup of a tile's points and cells: up to k cells of each point, within its _bound if it has one, and the rank."""

    def run(points: pa.Table, cells: pa.Table) -> pa.Table:
        cells = cells.take(pc.sort_indices(cells, [("cell_id", "ascending")], null_placement="at_start"))
        x, y, cx, cy = (t.column(c).to_numpy() for t, c in ((points, "x"), (points, "y"), (cells, "cx"), (cells, "cy")))
        bound = points.column("_bound").fill_null(float("inf")).to_numpy()
        step, out = max(1, 1_000_000 // max(1, len(cx))), [[], [], [], []]
        for i in range(0, len(x) if len(cx) else 0, step):
            d = np.sqrt((x[i : i + step, None] - cx) ** 2 + (y[i : i + step, None] - cy) ** 2)
            most = bound[i : i + step]
            if len(cx) > k and np.isinf(most).any():
                most = np.minimum(most, np.partition(d, k - 1, axis=1)[:, k - 1])
            a, c = np.nonzero(d <= most[:, None])
            v = d[a, c]
            order = np.lexsort((c, v, a))
            a, c, v = a[order], c[order], v[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a) + 1
            for held, new in zip(out, (a + i, c, v, rank), strict=True):
                held.append(new[rank <= k])
        at, c, v, rank = (np.concatenate([np.zeros(0, kind), *o]) for o, kind in zip(out, (np.int64, np.int64, float, np.int64), strict=True))
        got = points.take(pa.array(at))
        return pa.table([*got.select(["point_id", "x", "y", "_tile"]).columns, cells.column("cell_id").take(pa.array(c)), pa.array(v), pa.array(rank.astype(np.int32))], names=["point_id", "x", "y", "_tile", "cell_id", "distance", "rank"])

    return run


def nearest_cells(points: DataFrame, cells: DataFrame, k: int, cell: float | None = None) -> DataFrame:
    """The k nearest cells (cell_id, x, y) of each point (point_id, x, y), wherever they lie: point_id, cell_id, distance, rank; fewer only where there are fewer cells.

    Cells are dealt to tiles of about equal numbers. A point meets one tile near it; its k-th distance there is a bound, and it meets all
    other tiles that may hold a cell within the bound. So a point meets few tiles, near cells or far from all of them. Of cells at one
    place only the k smallest ids go on. Of equally near cells the smaller cell_id counts. Equal points count once; points and cells
    without a place (null or NaN) have no part. cell: of no effect, as tiles need no width.
    """
    placed = lambda df: df.where(not_nan(F.col("x")) & not_nan(F.col("y")))
    left = placed(points.select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).distinct()
    held = placed(cells.select("cell_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).select("cell_id", F.col("x").alias("cx"), F.col("y").alias("cy"))
    same = Window.partitionBy("cx", "cy").orderBy("cell_id")
    held = durable(held.withColumn("_i", F.row_number().over(same)).where(F.col("_i") <= k).drop("_i"))
    held = _cut_tiles(held, k)
    rows = held.groupBy("_tile").agg(F.min("cx"), F.min("cy"), F.max("cx"), F.max("cy"), F.count(F.lit(1))).collect()
    none = [float("inf")] * 2 + [float("-inf")] * 2
    boxes, sizes = np.array([none] * (max((r[0] for r in rows), default=-1) + 1)).reshape(-1, 4), {r[0]: r[5] for r in rows}
    for r in rows:
        boxes[r[0]] = r[1:5]
    enough = np.array([sizes.get(t, 0) >= k for t in range(len(boxes))], bool)
    paired = StructType([left.schema["point_id"], *[StructField(c, DoubleType()) for c in ("x", "y", "_bound")], StructField("_tile", IntegerType())])
    out = StructType([*paired.fields[:3], paired["_tile"], held.schema["cell_id"], StructField("distance", DoubleType()), StructField("rank", IntegerType())])

    def meet(asking: DataFrame) -> DataFrame:
        pairs = durable(asking.mapInArrow(_tiles_of_points(boxes, enough), paired))
        parts = {t: -(-n // POINTS_PER_GROUP) for t, n in pairs.groupBy("_tile").count().where(F.col("count") > POINTS_PER_GROUP).collect()}  # at most one for so many pairs
        many = F.coalesce(F.create_map(*[F.lit(v) for t in parts.items() for v in t])[F.col("_tile")], F.lit(1)) if parts else F.lit(1)
        dealt = pairs.withColumn("_part", F.pmod(F.xxhash64("point_id", "x", "y"), many).cast("int"))
        copies = held.withColumn("_part", F.explode(F.sequence(F.lit(0), many - 1)))
        return dealt.groupBy("_tile", "_part").cogroup(copies.groupBy("_tile", "_part")).applyInArrow(_nearest_of_tile(k), out)

    none = F.lit(None).cast("double").alias("_bound")
    if not enough.any():  # no tile has k cells: all are met
        got = meet(left.select("point_id", "x", "y", F.lit(-1).alias("_first"), F.lit(float("inf")).alias("_bound")))
    else:
        got = durable(meet(left.select("point_id", "x", "y", F.lit(-1).alias("_first"), none)))
        bounded = got.where(F.col("rank") == k).select("point_id", "x", "y", F.col("_tile").alias("_first"), F.col("distance").alias("_bound"))
        got = got.unionByName(meet(bounded))
    order = Window.partitionBy("point_id", "x", "y").orderBy("distance", "cell_id")
    return got.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("point_id", "cell_id", "distance", "rank")


# --- elevation -----------------------------------------------------------------------------------------------------

TILE_LON, TILE_LAT = 30.0, 20.0


def tile_corner(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lower left corner of the elevation tile that holds a point; longitudes wrap."""
    wrapped = F.pmod(lon + 180.0, F.lit(360.0)) - 180.0
    return F.floor(wrapped / TILE_LON) * TILE_LON, F.floor((lat + 90.0) / TILE_LAT) * TILE_LAT - 90.0


def tiles_of_box(boxes: DataFrame) -> DataFrame:
    """box_id, ll_lon, ll_lat of all tiles that boxes (min_lon, max_lon, min_lat, max_lat) touch; min over max crosses the date line."""
    high = F.when(F.col("max_lon") < F.col("min_lon"), F.col("max_lon") + 360.0).otherwise(F.col("max_lon"))
    lons = F.transform(F.sequence(F.floor(F.col("min_lon") / TILE_LON).cast("int"), F.floor(high / TILE_LON).cast("int")), lambda i: F.pmod(i * TILE_LON + 180.0, F.lit(360.0)) - 180.0)
    lats = F.transform(F.sequence(F.floor((F.col("min_lat") + 90.0) / TILE_LAT).cast("int"), F.floor((F.col("max_lat") + 90.0) / TILE_LAT).cast("int")), lambda i: i * TILE_LAT - 90.0)
    return boxes.select("box_id", F.explode(lons).alias("ll_lon"), lats.alias("_l")).select("box_id", "ll_lon", F.explode("_l").alias("ll_lat")).distinct()


def heights_at(points: DataFrame, dem: DataFrame, step: float, ul_lon: float, ul_lat: float) -> DataFrame:
    """points (id, lon, lat) with height of their nearest cell of a region dem(ix, iy, height); a point west of it wraps; none: null."""
    lon = F.when(F.col("lon") < ul_lon - step / 2, F.col("lon") + 360.0).otherwise(F.col("lon"))
    ix, iy = ((lon - ul_lon + step / 2) / step).cast("long"), ((ul_lat - F.col("lat") + step / 2) / step).cast("long")
    return points.withColumns({"ix": ix, "iy": iy}).join(dem, ["ix", "iy"], "left").drop("ix", "iy")


def height_range(points: DataFrame, dem: DataFrame, pad: float, cell: float) -> DataFrame:
    """Least and greatest height of dem(lon, lat, height) in a square of +-pad degrees around each point, NaN left out."""
    b = lambda c: F.floor(c / cell).cast("long")
    near = points.withColumn("_x", F.explode(F.sequence(b(F.col("lon") - pad), b(F.col("lon") + pad)))).withColumn("_y", F.explode(F.sequence(b(F.col("lat") - pad), b(F.col("lat") + pad))))
    cells = dem.select(F.col("lon").alias("_lon"), F.col("lat").alias("_lat"), "height", b(F.col("lon")).alias("_x"), b(F.col("lat")).alias("_y")).where(~F.isnan("height"))
    hit = near.join(cells, ["_x", "_y"]).where((F.abs(F.col("_lon") - F.col("lon")) <= pad) & (F.abs(F.col("_lat") - F.col("lat")) <= pad))
    return hit.groupBy("id").agg(F.min("height").alias("min_height"), F.max("height").alias("max_height"))
