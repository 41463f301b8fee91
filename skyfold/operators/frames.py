"""Rotations along chains of frames: a tree of links of several kinds, evaluated for the times of a table.

A link leads from a frame to its parent and is a constant matrix, a table of attitude samples, or the pole and prime meridian
of a body as polynomials in time. The path between two frames is found on the driver, where a mission's frames are a few names;
what the path needs is made once for each row: one lookup for each sampled link, also where several paths share it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions import timeconv
from skyfold.functions import vec as V

from . import ephemeris

SECONDS_PER_DAY, DAYS_PER_CENTURY = 86_400.0, 36_525.0


@dataclass(frozen=True)
class Constant:
    """Row-major matrix from the frame to its parent."""

    parent: str
    matrix: tuple[float, ...]


@dataclass(frozen=True)
class Sampled:
    """Quaternions (frame, ugps, q0..q3; scalar first) from the frame to its parent; frame_id is its value in `frame`. Gaps over max_gap_us have none."""

    parent: str
    attitudes: DataFrame
    frame_id: int
    max_gap_us: int | None = None


@dataclass(frozen=True)
class Body:
    """Right ascension and declination of the pole (degrees, by powers of centuries) and the prime meridian (degrees, by powers of days), in its parent."""

    parent: str
    pole_ra: tuple[float, ...]
    pole_dec: tuple[float, ...]
    meridian: tuple[float, ...]


Link = Constant | Sampled | Body


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + F.lit(float(c))
    return out


def _cells(prefix: str) -> V.Matrix:
    return tuple(V.Vec(*(F.col(f"{prefix}{3 * i + j}") for j in range(3))) for i in range(3))


def _named(m: V.Matrix, prefix: str) -> dict[str, Column]:
    return {f"{prefix}{3 * i + j}": m[i][j] for i in range(3) for j in range(3)}


def _with_link(rows: DataFrame, link: Link, prefix: str) -> DataFrame:
    """rows with the matrix from the frame to its parent in <prefix>0..8; NaN where there is no attitude."""
    if isinstance(link, Constant):
        return rows.withColumns({f"{prefix}{k}": F.lit(float(x)) for k, x in enumerate(link.matrix)})
    if isinstance(link, Sampled):
        asked = rows.withColumn("frame", F.lit(link.frame_id))
        own = link.attitudes.where(F.col("frame") == link.frame_id).select(F.col("frame").cast("int").alias("frame"), "ugps", *ephemeris.QUAT)
        found = ephemeris.query_attitude(asked, own, link.max_gap_us)
        return found.withColumns(_named(V.rotation([F.col(q) for q in ephemeris.QUAT]), prefix)).drop("frame", *ephemeris.QUAT)
    days = F.col("_et") / SECONDS_PER_DAY
    ra, dec, w = _polynomial(link.pole_ra, days / DAYS_PER_CENTURY), _polynomial(link.pole_dec, days / DAYS_PER_CENTURY), _polynomial(link.meridian, days)
    rows = rows.withColumns({"_ra": F.radians(ra + 90.0), "_de": F.radians(90.0 - dec), "_w": F.radians(F.pmod(w, F.lit(360.0)))})
    rows = rows.withColumns(_named(V.product(V.about(1, F.col("_de")), V.about(3, F.col("_ra"))), "_p"))
    return rows.withColumns(_named(V.transpose(V.product(V.about(3, F.col("_w")), _cells("_p"))), prefix)).drop("_ra", "_de", "_w", *(f"_p{k}" for k in range(9)))


def rotations(times: DataFrame, tree: dict[str, Link], paths: dict[str, tuple[str, str]], et: Column | None = None) -> DataFrame:
    """times (ugps, any others) with <name>0..8 for each path name: (from, to), the row-major matrix that takes vectors of one frame to the other.

    et: ephemeris time, by default that of ugps. NaN where a sampled link has no attitude. A path whose frames are not
    connected is a ValueError; from a frame to itself leads the unit matrix. Rows may repeat; an empty table stays empty.
    """
    graph = {child: link.parent for child, link in tree.items()}
    steps = {name: ephemeris.frame_path(graph, a, b) for name, (a, b) in paths.items()}
    used = list(dict.fromkeys(child for path in steps.values() for child, _ in path))
    rows = times.withColumn("_et", timeconv.ugps_to_et(F.col("ugps")) if et is None else et)
    for i, child in enumerate(used):
        rows = _with_link(rows, tree[child], f"_l{i}_")
    for name, path in steps.items():
        unit = {f"{name}{k}": F.lit(1.0 if k % 4 == 0 else 0.0) for k in range(9)}
        for n, (child, upward) in enumerate(path):
            link = _cells(f"_l{used.index(child)}_")
            link = link if upward else V.transpose(link)
            rows = rows.withColumns(_named(V.product(link, _cells(name)), name) if n else _named(link, name))
        if not path:
            rows = rows.withColumns(unit)
    return rows.select(*times.columns, *[f"{name}{k}" for name in paths for k in range(9)])


def as_euler(rows: DataFrame, name: str, sequence: tuple[int, int, int] = (1, 2, 3)) -> DataFrame:
    """rows with <name>_a1, _a2, _a3: the angles (radians) of a path's matrix about three axes; NaN rows stay NaN."""
    return rows.withColumns({f"{name}_a{k + 1}": a for k, a in enumerate(V.euler(_cells(name), sequence))})


def as_quaternion(rows: DataFrame, name: str) -> DataFrame:
    """rows with <name>_q0.._q3, scalar first, of a path's matrix; NaN rows stay NaN."""
    bad = F.isnan(sum((F.col(f"{name}{k}") for k in range(1, 9)), F.col(f"{name}0")))
    return rows.withColumns({f"{name}_q{k}": F.when(bad, F.lit(V.NAN)).otherwise(q) for k, q in enumerate(V.quaternion(_cells(name)))})


def tree_of_kernels(frames: DataFrame, pool: DataFrame, sampled: dict[str, Sampled] | None = None, inertial: str = "J2000") -> dict[str, Link]:
    """Links of text kernels: constant frames (kernel_pool.frames()), bodies with a pole (BODY<id>_POLE_RA, _POLE_DEC, _PM) as frame BODY<id>, and given sampled ones.

    A mission's frames and bodies are read to the driver: they are names and matrices of its kernels, some hundreds at most.
    """
    out: dict[str, Link] = {}
    for f in frames.where("class = 4 and relative is not null").collect():
        out[f.name] = Constant(f.relative, tuple(f[f"r{k}"] for k in range(9)))
    shape = r"^BODY(\d+)_(POLE_RA|POLE_DEC|PM)$"
    found: dict[str, dict[str, list]] = {}
    for row in pool.where(F.col("variable").rlike(shape)).select(F.regexp_extract("variable", shape, 1).alias("body"), F.regexp_extract("variable", shape, 2).alias("item"), "index", "number").orderBy("index").collect():
        found.setdefault(row.body, {}).setdefault(row.item, []).append(row.number)
    for body, items in found.items():
        if len(items) == 3:
            out[f"BODY{body}"] = Body(inertial, *(tuple(items[k]) for k in ("POLE_RA", "POLE_DEC", "PM")))
    return out | (sampled or {})
