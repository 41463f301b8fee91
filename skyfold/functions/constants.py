"""Fixed values of public standards: WGS84, light speed, astronomical unit, time-scale offsets, quality flags."""

# Fixed values (WGS84 ellipsoid, km; f is the flattening itself, not its inverse).
WGS84_A_KM = 6378.137
WGS84_B_KM = 6356.752314245
WGS84_F = 1 / 298.257223563
WGS84_E2 = 2 * WGS84_F - WGS84_F**2
AU_KM = 149597870.700
LIGHT_KM_S = 299792.458

# Fixed values (time scales, seconds).
GPS_MINUS_J2000_S = 630763181
TAI_1958_MINUS_J2000_S = -694656019
LEAP_SECONDS_AT_GPS_EPOCH = 19
DELTA_T_A = 32.184
DELTET_K, DELTET_EB, DELTET_M0, DELTET_M1 = 1.657e-3, 1.671e-2, 6.239996, 1.99096871e-7

# TAI - UTC in seconds from each date on (leap seconds since 1972).
LEAP_SECONDS = [
    (10, "1972-01-01"), (11, "1972-07-01"), (12, "1973-01-01"), (13, "1974-01-01"), (14, "1975-01-01"), (15, "1976-01-01"), (16, "1977-01-01"),
    (17, "1978-01-01"), (18, "1979-01-01"), (19, "1980-01-01"), (20, "1981-07-01"), (21, "1982-07-01"), (22, "1983-07-01"), (23, "1985-07-01"),
    (24, "1988-01-01"), (25, "1990-01-01"), (26, "1991-01-01"), (27, "1992-07-01"), (28, "1993-07-01"), (29, "1994-07-01"), (30, "1996-01-01"),
    (31, "1997-07-01"), (32, "1999-01-01"), (33, "2006-01-01"), (34, "2009-01-01"), (35, "2012-07-01"), (36, "2015-07-01"), (37, "2017-01-01"),
]

US_PER_DAY = 86_400_000_000
GPS_EPOCH_UNIX_DAYS = 3657

# Days from the GPS epoch (1980-01-06) to the epoch of each day count.
EPOCH_DAYS = {"gps": 0.0, "jd": -2444244.5, "mjd": -44244.0, "sorce": 8419.0, "tcte": 12370.0, "tsis": 13857.0, "tsis1": 13857.0, "tsis2": 16049.0, "ctim": 15518.0}

# Bits of the quality flags.
QUALITY_FLAGS = {
    "GOOD": 0x0, "SPICE_ERR_NO_RESULTS_FOUND": 0x1, "SPICE_ERR_MISSING_EPHEMERIS": 0x2, "SPICE_ERR_MISSING_ATTITUDE": 0x4, "SPICE_ERR_INVALID_LOCATION": 0x8,
    "SPICE_ERR_UNKNOWN_NONSPECIFIC": 0x10, "CALC_UNEXPECTED_NOT_FINITE": 0x20, "CALC_KERNELS_UNDESIRED_TLM": 0x40, "CALC_KERNELS_FAILED": 0x80,
    "CALC_ELLIPS_INSUFF_DATA": 0x100, "CALC_ELLIPS_NO_INTERSECT": 0x200, "CALC_TERRAIN_EXTREME_ZENITH": 0x400, "CALC_TERRAIN_MAX_ITER": 0x800,
    "CALC_TERRAIN_NOT_FINITE": 0x1000, "CALC_ANCIL_INSUFF_DATA": 0x2000, "CALC_ANCIL_NOT_FINITE": 0x4000,
}
