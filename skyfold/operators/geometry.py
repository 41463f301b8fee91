"""Selectable viewing- and solar-geometry columns: each field names its inputs and its output expressions.

Inputs are columns of one table, in the provider's names: sc_state (sc_x..sc_z, sc_vx..sc_vz, Earth-fixed, km and km/s),
sun_position (sun_x..), boresight (bs_x.., unit), sc_state_inertial (isc_x.., isc_vx..), boresight_inertial (ibs_x..),
attitude_quaternion (q0..q3). Only the inputs of the chosen fields must be there; Spark prunes the rest from the scan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.functions import constants as K
from skyfold.functions import geodesy as G
from skyfold.functions.vec import Vec

from .segments import rates


@dataclass(frozen=True)
class Field:
    name: str
    columns: tuple[str, ...]
    providers: frozenset[str]
    expressions: Callable[[], list[Column]]
    rate_of: str | None = None


def _v(prefix: str) -> Vec:
    return Vec(*(F.col(f"{prefix}{a}").cast("double") for a in "xyz"))


def _sub_point(p: Vec) -> list[Column]:
    lon, lat, _ = G.ecef_to_geodetic(p)
    return [lat, lon, 90.0 - lat]


def _ground() -> Vec:
    """Where the boresight meets the ellipsoid; get_geometry() makes its columns once for all fields that use it."""
    return Vec.columns("_ground_")


def _orbital(i: int) -> list[Column]:
    return [G.orbital_angles(_v("ibs_"), _v("isc_"), _v("isc_v"))[i]]


def _xyz(name: str) -> tuple[str, ...]:
    return tuple(f"{name}_{a}" for a in "xyz")


_VIEW, _SUN = lambda: G.azimuth(_ground(), _v("sc_")), lambda: G.azimuth(_ground(), _v("sun_"))
_SPECS = [
    ("sc_radius", ("spacecraft_radius",), "sc_state", lambda: [_v("sc_").norm()]),
    ("subsatellite", ("subsatellite_latitude", "subsatellite_longitude", "subsatellite_colatitude"), "sc_state", lambda: _sub_point(_v("sc_"))),
    ("subsolar", ("subsolar_latitude", "subsolar_longitude", "subsolar_colatitude"), "sun_position", lambda: _sub_point(_v("sun_"))),
    ("earth_sun_distance", ("earth_sun_distance",), "sun_position", lambda: [_v("sun_").norm() / K.AU_KM]),
    ("sc_position", _xyz("spacecraft_position"), "sc_state", lambda: list(_v("sc_"))),
    ("sc_altitude", ("spacecraft_altitude",), "sc_state", lambda: [G.ecef_to_geodetic(_v("sc_"))[2]]),
    ("boresight", _xyz("boresight"), "boresight", lambda: list(_v("bs_"))),
    ("surface_colatitude", ("surface_colatitude",), "boresight sc_state", lambda: [90.0 - G.surface_lon_lat(_ground())[1]]),
    ("viewing_zenith", ("viewing_zenith",), "boresight sc_state", lambda: [G.zenith(_ground(), _v("sc_"))]),
    ("solar_zenith", ("solar_zenith",), "boresight sc_state sun_position", lambda: [G.zenith(_ground(), _v("sun_"))]),
    ("viewing_azimuth", ("viewing_azimuth",), "boresight sc_state", lambda: [_VIEW()]),
    ("solar_azimuth", ("solar_azimuth",), "boresight sc_state sun_position", lambda: [_SUN()]),
    ("relative_azimuth", ("relative_azimuth",), "boresight sc_state sun_position", lambda: [G.relative_azimuth(_VIEW(), _SUN())]),
    ("cone_angle", ("cone_angle",), "boresight sc_state", lambda: [G.cone_angle(_v("bs_"), _v("sc_"))]),
    ("cone_angle_rate", ("cone_angle_rate",), "boresight sc_state", lambda: [G.cone_angle(_v("bs_"), _v("sc_"))]),
    ("sc_velocity", _xyz("spacecraft_velocity"), "sc_state", lambda: list(_v("sc_v"))),
    ("satellite_attitude", ("attitude_q0", "attitude_q1", "attitude_q2", "attitude_q3"), "attitude_quaternion", lambda: [F.col(f"q{i}") for i in range(4)]),
    ("sc_position_inertial", _xyz("spacecraft_position_inertial"), "sc_state_inertial", lambda: list(_v("isc_"))),
    ("sc_velocity_inertial", _xyz("spacecraft_velocity_inertial"), "sc_state_inertial", lambda: list(_v("isc_v"))),
    ("boresight_inertial", _xyz("boresight_inertial"), "boresight_inertial", lambda: list(_v("ibs_"))),
    ("clock_angle", ("clock_angle",), "sc_state_inertial boresight_inertial", lambda: _orbital(0)),
    ("clock_angle_rate", ("clock_angle_rate",), "sc_state_inertial boresight_inertial", lambda: _orbital(0)),
    ("along_track_angle", ("along_track_angle",), "sc_state_inertial boresight_inertial", lambda: _orbital(1)),
    ("cross_track_angle", ("cross_track_angle",), "sc_state_inertial boresight_inertial", lambda: _orbital(2)),
]
FIELDS = {n: Field(n, c, frozenset(p.split()), e, n.removesuffix("_rate") if n.endswith("_rate") else None) for n, c, p, e in _SPECS}
#: Fields of any observer with a state: those that need no attitude.
DEFAULT = [n for n, f in FIELDS.items() if f.providers <= {"sc_state", "sun_position"}]


def register(field: Field) -> None:
    """Add a field of one's own, or replace one."""
    FIELDS[field.name] = field


def resolve(fields: list[str] | None) -> list[Field]:
    unknown = [f for f in fields or [] if f not in FIELDS]
    if unknown:
        raise KeyError(f"unknown fields {unknown}; known: {', '.join(FIELDS)}")
    return [FIELDS[f] for f in (DEFAULT if fields is None else fields)]


def providers(fields: list[str] | None) -> list[str]:
    """The inputs that the chosen fields need, sorted, each once."""
    return sorted(frozenset().union(*(f.providers for f in resolve(fields))))


def get_geometry(states: DataFrame, fields: list[str] | None = None, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """keys (ugps), then the columns of the fields. Rates differ along `order` (ugps) within the other keys."""
    keys = keys or ["ugps"]
    chosen = resolve(fields)
    if any({"boresight", "sc_state"} <= f.providers for f in chosen):
        at = G.intersect_ellipsoid(_v("bs_"), _v("sc_"))
        states = states.withColumns(dict(zip(("_ground_x", "_ground_y", "_ground_z"), at, strict=True)))
    out = states.select(*keys, *([c for c in order or [] if c not in keys]), *[c.alias(n) for f in chosen for n, c in zip(f.columns, f.expressions(), strict=True)])
    for f in chosen:
        if f.rate_of:
            out = rates(out, [k for k in keys if k != "ugps"], order or ["ugps"], "ugps", f.columns[0], f.columns[0], unwrap_degrees=f.rate_of == "clock_angle")
    return out.select(*keys, *[n for f in chosen for n in f.columns])
