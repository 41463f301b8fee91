"""Geodetic conversions, ray intersection and viewing angles on the WGS84 ellipsoid. Lengths are km unless said."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .vec import NAN, Vec, clip, lit, safe_div

A, B, E2 = K.WGS84_A_KM, K.WGS84_B_KM, K.WGS84_E2


def geodetic_to_ecef(lon: Column, lat: Column, alt: Column, degrees: bool = True, meters: bool = False) -> Vec:
    k = 1000.0 if meters else 1.0
    if degrees:
        lon, lat = F.radians(lon), F.radians(lat)
    n = (A * k) / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    return Vec((n + alt) * F.cos(lat) * F.cos(lon), (n + alt) * F.cos(lat) * F.sin(lon), ((B / A) ** 2 * n + alt) * F.sin(lat))


def _latitude(r: Column, z: Column, a: float, b: float) -> Column:
    """Geodetic latitude by Bowring's formula, twice: below 1e-13 from the surface out to the Moon; poles included."""
    ep2 = (a * a - b * b) / (b * b)
    at = F.atan2(a * z, b * r)
    for k in range(2):
        lat = F.atan2(z + ep2 * b * F.pow(F.sin(at), 3), r - E2 * a * F.pow(F.cos(at), 3))
        at = F.atan2(b * F.sin(lat), a * F.cos(lat)) if k == 0 else at
    return lat


def ecef_to_geodetic(p: Vec, degrees: bool = True, meters: bool = False) -> tuple[Column, Column, Column]:
    """(lon, lat, alt). Each result repeats p several times, so p is best made of plain columns."""
    a, b = (A * 1000.0, B * 1000.0) if meters else (A, B)
    r = F.sqrt(p.x * p.x + p.y * p.y)
    lat, lon = _latitude(r, p.z, a, b), F.atan2(p.y, p.x)
    alt = r * F.cos(lat) + p.z * F.sin(lat) - a * F.sqrt(1 - E2 * F.pow(F.sin(lat), 2))
    return (F.degrees(lon), F.degrees(lat), alt) if degrees else (lon, lat, alt)


def intersect_ellipsoid(direction: Vec, position: Vec) -> Vec:
    """Nearest point where a ray from position meets the ellipsoid; NaN where it misses or looks away."""
    u = Vec(direction.x / A, direction.y / A, direction.z / B)
    q = Vec(position.x / A, position.y / A, position.z / B)
    uu, uq = u.dot(u), u.dot(q)
    under = uq * uq - uu * (q.dot(q) - 1)
    d = safe_div(-uq - F.sqrt(F.greatest(under, F.lit(0.0))), uu)
    hit = (under >= 0) & (d >= 0) & ~F.isnan(d)
    at = position.plus(direction.times(d))
    return Vec(*(F.when(hit, c).otherwise(F.lit(NAN)) for c in at))


def surface_lon_lat(p: Vec, degrees: bool = True) -> tuple[Column, Column, Column]:
    """(lon, lat, 0) of a point on the ellipsoid; NaN stays NaN."""
    lon, lat = F.atan2(p.y, p.x), F.atan2(p.z / (1 - E2), F.sqrt(p.x * p.x + p.y * p.y))
    alt = F.when(F.isnan(p.x), F.lit(NAN)).otherwise(F.lit(0.0))
    return (F.degrees(lon), F.degrees(lat), alt) if degrees else (lon, lat, alt)


def up(lon: Column, lat: Column) -> Vec:
    """Ellipsoid normal; radians."""
    return Vec(F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat))


def north(lon: Column, lat: Column) -> Vec:
    return Vec(-F.sin(lat) * F.cos(lon), -F.sin(lat) * F.sin(lon), F.cos(lat))


def east(lon: Column) -> Vec:
    return Vec(-F.sin(lon), F.cos(lon), F.lit(0.0))


def azimuth(observer: Vec, target: Vec, degrees: bool = True, signed: bool = False) -> Column:
    """Clockwise from north, of the target seen from a surface point; [0, 360) unless signed."""
    lon, lat, _ = ecef_to_geodetic(observer, degrees=False)
    t = target.minus(observer)
    az = F.atan2(t.dot(east(lon)), t.dot(north(lon, lat)))
    if not signed:
        az = F.pmod(az, F.lit(2 * math.pi))
    return F.degrees(az) if degrees else az


def zenith(observer: Vec, target: Vec, degrees: bool = True, geocentric: bool = False) -> Column:
    t = target.minus(observer)
    if geocentric:
        cosine = safe_div(observer.dot(t), observer.norm() * t.norm())
    else:
        lon, lat, _ = ecef_to_geodetic(observer, degrees=False)
        cosine = safe_div(up(lon, lat).dot(t), t.norm())
    return F.degrees(F.acos(cosine)) if degrees else F.acos(cosine)


def relative_azimuth(view: Column, sun: Column) -> Column:
    return F.pmod(view - sun + 180.0, F.lit(360.0))


def cone_angle(boresight: Vec, position: Vec) -> Column:
    """Of a unit boresight off nadir, degrees."""
    return F.degrees(F.acos(clip(-safe_div(boresight.dot(position), position.norm()), -1.0, 1.0)))


def orbital_frame(position: Vec, velocity: Vec) -> tuple[Vec, Vec, Vec]:
    """Axes x (velocity, off the nadir), y, z (nadir); NaN where they don't exist."""
    z = position.unit().times(-1.0)
    x = velocity.minus(z.times(velocity.dot(z))).unit()
    return x, z.cross(x), z


def orbital_angles(boresight: Vec, position: Vec, velocity: Vec) -> tuple[Column, Column, Column]:
    """(clock in [0, 360), along track, cross track), degrees, in the frame above; NaN where it doesn't exist.

    From dot products alone: b.x, b.y and b.z times common positive lengths, so that no axis is formed.
    """
    r2, vr, br = position.dot(position), velocity.dot(position), boresight.dot(position)
    flat2 = velocity.dot(velocity) - safe_div(vr * vr, r2)
    bx = boresight.dot(velocity) - safe_div(br * vr, r2)
    by = -safe_div(boresight.dot(position.cross(velocity)), F.sqrt(r2))
    bz = -safe_div(br, F.sqrt(r2)) * F.sqrt(F.greatest(flat2, F.lit(0.0)))
    ok = lambda c: F.when(flat2 > 0, F.degrees(c)).otherwise(F.lit(NAN))
    return ok(F.pmod(F.atan2(by, bx), F.lit(2 * math.pi))), ok(F.atan2(bx, bz)), ok(F.atan2(by, bz))


def boresight_cosine(target: Vec, boresight: Vec) -> Column:
    """Cosine to the target; a target whose components sum to 0 is not normalised."""
    total = target.x + target.y + target.z
    return F.when(total == 0, target.dot(boresight)).otherwise(safe_div(target.dot(boresight), target.norm()))


def distance_correction(position: Vec) -> Column:
    r = position.norm()
    return safe_div(lit(K.AU_KM), r) * safe_div(lit(K.AU_KM), r)


def doppler_factor(position: Vec, velocity: Vec) -> Column:
    return 1 - safe_div(velocity.dot(position), position.norm()) / K.LIGHT_KM_S


def enu_matrix(lon: Column, lat: Column) -> tuple[Vec, Vec, Vec]:
    """Rows east, north, up; degrees."""
    lon, lat = F.radians(lon), F.radians(lat)
    return east(lon), north(lon, lat), up(lon, lat)


def geodetic_to_enu(lon: Column, lat: Column, alt_m: Column, lon0: Column, lat0: Column, alt0_m: Column) -> Vec:
    """Metres east, north and up of an origin."""
    d = geodetic_to_ecef(lon, lat, alt_m, meters=True).minus(geodetic_to_ecef(lon0, lat0, alt0_m, meters=True))
    return Vec(*(row.dot(d) for row in enu_matrix(lon0, lat0)))


def field_of_view(angle_deg: Column, half_deg: float, radius_km: Column, top_km: float = 510.0) -> tuple[Column, Column]:
    """(nadir flag, full-Earth flag): the target's centre within the cone; the Earth's limb at top_km within it."""
    limb = F.degrees(F.asin(clip(safe_div(lit(A + top_km), radius_km), -1.0, 1.0)))
    return (angle_deg <= half_deg).cast("int"), (angle_deg + limb <= half_deg).cast("int")


def occultation(observer: Vec, front: Vec, back: Vec, front_km: float, back_km: float) -> Column:
    """0 none; -3 / 3 total, -2 / 2 annular, -1 / 1 partial; negative where the first target is behind the second.

    Both targets are spheres, seen from the observer.
    """
    f, b = front.minus(observer), back.minus(observer)
    rf, rb = F.asin(clip(safe_div(lit(front_km), f.norm()), -1.0, 1.0)), F.asin(clip(safe_div(lit(back_km), b.norm()), -1.0, 1.0))
    apart = F.acos(clip(f.unit().dot(b.unit()), -1.0, 1.0))
    first_behind = f.norm() > b.norm()
    near, far = F.when(first_behind, rb).otherwise(rf), F.when(first_behind, rf).otherwise(rb)
    code = F.when(apart >= near + far, 0).when(apart + far <= near, 3).when(apart + near <= far, 2).otherwise(1)
    return F.when(first_behind, -code).otherwise(code)
