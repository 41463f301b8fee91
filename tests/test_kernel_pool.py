"""The kernel pool against a plain parser that goes through generated kernels character by character."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from skyfold.sources import kernel_pool as P


def tokens(line):
    out, i = [], 0
    while i < len(line):
        c = line[i]
        if c in " \t,":
            i += 1
        elif c in "()=":
            out.append(c)
            i += 1
        elif line[i : i + 2] == "+=":
            out.append("+=")
            i += 2
        elif c == "'":
            j = i + 1
            while line[j] != "'" or line[j + 1 : j + 2] == "'":
                j += 2 if line[j] == "'" else 1
            out.append(line[i : j + 1])
            i = j + 1
        else:
            j = i
            while j < len(line) and line[j] not in " \t,()='" and line[j : j + 2] != "+=":
                j += 1
            out.append(line[i:j])
            i = j
    return out


def value(token):
    if token[0] == "'":
        return None, token[1:-1].replace("''", "'")
    if token[0] == "@":
        day, _, rest = token[1:].partition("/")
        y, m, d = day.split("-")[:3]
        m = P.MONTHS.index(m.upper()) + 1 if m.isalpha() else int(m)
        h, mi, s = rest.split(":") if rest else (0, 0, 0)
        return (datetime.date(int(y), m, int(d)) - datetime.date(2000, 1, 1)).days * 86400 - 43200 + int(h) * 3600 + int(mi) * 60 + float(s), None
    try:
        return float(token.upper().replace("D", "E")), None
    except ValueError:
        return None, None


def plain(texts):
    pool = {}
    for text in texts:
        on, flat = False, []
        for line in text.split("\n"):
            if line.strip() in ("\\begindata", "\\begintext"):
                on = line.strip() == "\\begindata"
            elif on:
                flat += tokens(line)
        i = 0
        while i < len(flat):
            name, op = flat[i : i + 2]
            i += 2
            got = []
            while i < len(flat) and not (i + 1 < len(flat) and flat[i + 1] in ("=", "+=")):
                if flat[i] not in "()":
                    got.append(value(flat[i]))
                i += 1
            pool[name] = (pool.get(name, []) if op == "+=" else []) + got
    return sorted((name, i, *v) for name, vs in pool.items() for i, v in enumerate(vs))


def made(rnd):
    out = []
    for _ in range(rnd.randrange(1, 5)):
        out.append("prose A = ( 1 2 )  it's \\begindata not alone")
        out.append(rnd.choice(["\\begindata", "   \\begindata  ", "\t\\begindata"]))
        for _ in range(rnd.randrange(6)):
            vs = [rnd.choice(["1", "-2.5", "+3.", ".5", "1.5E+12", "2D-3", "-1d0", "'it''s'", "''", "' a = b, (c) '", "@1980-JAN-06/00:00:00.000", "@2017-6-1", "@2000-Jan-2/3:04:05.5", "word"]) for _ in range(rnd.randrange(1, 6))]
            name, op, sep = rnd.choice(["A", "INS-1_X", "b+c", "NAME_LIST"]), rnd.choice(["=", "+="]), rnd.choice([" ", ", ", "\n   ", "\t"])
            out.append(f"{name} {op} ( {sep.join(vs)} )" if len(vs) > 1 or rnd.random() < 0.5 else f"{name}{rnd.choice([' ', ''])}{op}{rnd.choice([' ', ''])}{vs[0]}")
        out.append("  \\begintext")
    return "\n".join(out[: -1 if rnd.random() < 0.5 else None])


def test_generated_kernels(spark):
    rnd = random.Random(12)
    for _ in range(4):
        texts = [made(rnd) for _ in range(6)] + [""]
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "kernel long, text string").repartition(5)
        got = sorted(tuple(r) for r in P.pool(df).select("variable", "index", "number", "text").collect())
        assert got == plain(texts)
        assert sorted(tuple(r) for r in P.invalid(P.pool(df)).collect()) == sorted(r[:2] for r in plain(texts) if r[2] is None and r[3] is None)


def pool(spark, *texts):
    return P.pool(spark.createDataFrame([(i, "\\begindata\n" + t) for i, t in enumerate(texts)], "kernel long, text string"))


def test_files_and_later_kernels_win(spark, tmp_path):
    (tmp_path / "a.ti").write_text("x\r\n\\begindata\r\nINS-5_BORESIGHT = ( 0 0 1 )\r\nNAIF_BODY_NAME += ( 'My  Sat' )\nNAIF_BODY_CODE += ( -77 )\n")
    (tmp_path / "b.ti").write_text("\\begindata\nINS-5_BORESIGHT = ( 0 1 0 )\nNAIF_BODY_NAME += ( 'MY SAT' )\nNAIF_BODY_CODE += ( -78 )\n")
    files = [str(tmp_path / f) for f in ("a.ti", "b.ti")]
    for order, y, code in ((files, 1.0, -78), (files[::-1], 0.0, -77)):
        held = P.pool(P.read_texts(spark, order))
        assert [(r.instrument, r.pixel, r.y) for r in P.detector_vectors(held).collect()] == [(-5, 1, y)]
        assert [tuple(r) for r in P.names(held).collect()] == [("MY SAT", code)]
    assert P.pool(P.read_texts(spark, [])).count() == 0


def test_too_few_pixel_vectors(spark):
    with pytest.raises(Exception, match="too few pixel vectors of instrument -5"):
        P.detector_vectors(pool(spark, "INS-5_PIXEL_COUNT = 2\nINS-5_PIXEL_VECTORS = ( 1 2 3 4 5 )")).collect()


def test_fields_of_view_by_angles_and_corners(spark):
    base = "INS-{0}_FOV_SHAPE = '{1}'\nINS-{0}_BORESIGHT = ( 0 0 2 )\nINS-{0}_FOV_CLASS_SPEC = 'ANGLES'\nINS-{0}_FOV_REF_VECTOR = ( 1 0 5 )\nINS-{0}_FOV_REF_ANGLE = 30\nINS-{0}_FOV_CROSS_ANGLE = 600\nINS-{0}_FOV_ANGLE_UNITS = '{2}'\n"
    corners = "INS-4_FOV_SHAPE = 'POLYGON'\nINS-4_BORESIGHT = ( 0 0 1 )\nINS-4_FOV_BOUNDARY_CORNERS = ( 1 0 1 0 1 1 -1 -1 1 )\n"
    held = pool(spark, base.format(1, "CIRCLE", "DEGREES") + base.format(2, "ELLIPSE", "ARCMINUTES") + base.format(3, "RECTANGLE", "ARCMINUTES") + corners)
    got = {r.instrument: [tuple(c) for c in r.corners] for r in P.fields_of_view(held).collect()}
    a, b = np.radians(0.5), np.radians(10)
    assert np.allclose(got[-1], [(0.5, 0, np.sqrt(0.75))]) and np.allclose(got[-2], [(np.sin(a), 0, np.cos(a)), (0, np.sin(b), np.cos(b))])
    assert len(got[-3]) == 4 and all(abs(x / z) == pytest.approx(np.tan(a)) and abs(y / z) == pytest.approx(np.tan(b)) and x * x + y * y + z * z == pytest.approx(1) for x, y, z in got[-3])
    assert got[-4] == [(1, 0, 1), (0, 1, 1), (-1, -1, 1)]


def test_clock_strings_and_pieces(spark):
    held = pool(spark, "SCLK01_MODULI_9 = ( 1000 10 8 )\nSCLK01_OFFSETS_9 = ( 5 1 0 )\nSCLK_PARTITION_START_9 = ( 0 80 )\nSCLK_PARTITION_END_9 = ( 800 9000 )\nSCLK01_COEFFICIENTS_9 = ( 0 0.5 1.0 800 100.0 2.0 )")
    df = spark.createDataFrame([("1/6.1.0", 80.0), ("2/6.1.0", 800.0), ("6:2:3", 91.0), ("16.1.0", 800 + 880 - 80.0), ("3/6", None), (None, None), ("1/ 7-1-0", 160.0)], "s string, want double").crossJoin(P.clocks(held))
    part = F.struct("moduli", "offsets", "partition_start", "partition_end")
    rows = df.select("want", P.encode_ticks(F.col("s"), part).alias("got"), P.ticks_to_time(F.col("want"), F.col("pieces"), F.col("ticks_per_count")).alias("t")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]
    assert [r.t for r in rows if r.want is not None] == [0.5 + 1.0, 100.0, 0.5 + 91 / 80, 100 + 800 / 80 * 2, 0.5 + 2.0]


def test_constant_frames(spark):
    held = pool(spark, "FRAME_F = 7\nFRAME_7_NAME = 'F'\nFRAME_7_CLASS = 4\nTKFRAME_7_RELATIVE = 'J2000'\nTKFRAME_7_SPEC = 'ANGLES'\nTKFRAME_7_ANGLES = ( 10 20 30 )\nTKFRAME_7_AXES = ( 3 1 2 )\nTKFRAME_7_UNITS = 'DEGREES'")

    def about(axis, deg):
        c, s = np.cos(np.radians(deg)), np.sin(np.radians(deg))
        return {1: np.array([[1, 0, 0], [0, c, s], [0, -s, c]]), 2: np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]]), 3: np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]])}[axis]

    r = P.frames(held).first()
    assert r.name == "F" and np.allclose([r[f"r{k}"] for k in range(9)], (about(3, 10) @ about(1, 20) @ about(2, 30)).ravel())
