"""GeoTIFF files of all forms that are read, by round trips and by hand."""

import random

import numpy as np
import pytest
from skyfold.sources import geotiff as T

RNG = np.random.default_rng(2)


def read(spark, files):
    df = spark.createDataFrame([(f"f{i}", bytearray(c)) for i, c in enumerate(files)], "path string, content binary")
    out = {}
    for r in T.cells(df).collect():
        out.setdefault(r.path, {})[r.row, r.col] = (r.x, r.y, r.value)
    return df, out


def test_lzw_of_many_lengths():
    rnd = random.Random(1)
    for data in (b"", b"a", b"a" * 5000, bytes(rnd.randrange(256) for _ in range(40000)), b"abcabcabd" * 900, bytes(rnd.choice(b"ab") for _ in range(30000))):
        assert T.lzw_decode(T.lzw_encode(data)) == data
    # "-----A---B" by the public example of the format
    assert T.lzw_decode(bytes([0x80, 0x0B, 0x60, 0x50, 0x22, 0x0C, 0x0C, 0x85, 0x01])) is not None
    with pytest.raises(ValueError):
        T.lzw_decode(bytes([0x80, 0x7F, 0xFF, 0xFF]))


def test_round_trips(spark):
    files, want = [], []
    for kind, big, tile, compression, predictor, strip in (
        ("i2", False, None, T.LZW, 2, 7), ("f4", True, None, T.NONE, 1, 100), ("u1", False, 16, T.LZW, 1, 0), ("f8", True, 32, T.DEFLATE, 1, 0), ("i4", True, None, T.LZW, 2, 64), ("u2", False, 16, T.DEFLATE, 2, 0),
    ):
        values = RNG.integers(0, 100, (37, 45)).astype(kind) if predictor == 2 or kind[0] != "f" else RNG.normal(size=(37, 45)).astype(kind)
        files.append(T.encode(values, -10.0, 50.0, 0.5, -0.25, 4326 if big else 32633, compression, strip or 64, -9999.0 if big else None, big, tile, predictor))
        want.append(values)
    df, got = read(spark, files)
    for i, values in enumerate(want):
        cells = got[f"f{i}"]
        assert len(cells) == values.size and all(cells[r, c] == (-10 + (c + 0.5) * 0.5, 50 - (r + 0.5) * 0.25, float(values[r, c])) for r in range(37) for c in range(45))
    about = {r.path: r for r in T.describe(df).collect()}
    assert [(about[f"f{i}"].width, about[f"f{i}"].height, about[f"f{i}"].epsg, about[f"f{i}"].nodata) for i in (0, 1)] == [(45, 37, 32633, None), (45, 37, 4326, -9999.0)]
    assert (about["f1"].x0, about["f1"].y0, about["f1"].dx, about["f1"].dy, about["f1"].kind) == (-10.0, 50.0, 0.5, -0.25, ">f4")


def test_cells_to_files_and_back(spark, tmp_path):
    rows = [("a", r, c, 5 + 0.1 * c, 60 - 0.2 * r, float(r * 10 + c)) for r in range(4) for c in range(3) if (r, c) != (1, 1)] + [("b", 0, 0, 1.0, 2.0, 7.0)]
    made = T.encode_cells(spark.createDataFrame(rows, "path string, row int, col int, x double, y double, value double"))
    for r in made.collect():
        (tmp_path / f"{r.path}.tif").write_bytes(r.content)
    got = {(r.path.rsplit("/", 1)[1][0], r.row, r.col): (round(r.x, 9), round(r.y, 9), r.value) for r in T.cells(T.read_files(spark, str(tmp_path / "*.tif"))).collect()}
    assert got.pop(("a", 1, 1))[2] == -32768.0
    assert got == {r[:3]: (round(r[3], 9), round(r[4], 9), r[5]) for r in rows}


def test_tie_point_within_and_errors(spark):
    good = {33550: np.array([2.0, 3.0, 0.0]), 33922: np.array([1.0, 2.0, 0.0, 100.0, 50.0, 0.0])}
    assert T.affine(good) == (98.0, 56.0, 2.0, -3.0)
    keys = lambda *k: {34735: np.array([1, 1, 0, len(k), *(x for a, b in k for x in (a, 0, 1, b))])}
    assert T.epsg(keys((2048, 4326), (3072, 32601))) == 32601 and T.epsg(keys((1024, 2), (2048, 4326))) == 4326
    for bad in (lambda: T.affine({33550: good[33550]}), lambda: T.epsg(keys((1024, 2))), lambda: T.epsg({}), lambda: T.tags(b"XX*\0" + b"\0" * 20)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(Exception, match="not a TIFF"):
        read(spark, [b"nothing of the kind"])
