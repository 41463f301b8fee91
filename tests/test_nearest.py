"""The k nearest cells against all distances: hot spots, lonely points and cells, ties, fewer cells than k."""

import time

import numpy as np
from skyfold.operators import raster as R


def check(spark, points, cells, k, cell):
    p = spark.createDataFrame(points, "point_id int, x double, y double")
    c = spark.createDataFrame(cells, "cell_id int, x double, y double")
    got = sorted((r.point_id, r["rank"], r.cell_id, round(r.distance, 9)) for r in R.nearest_cells(p, c, k, cell).collect())
    ok = lambda r: None not in r and not np.isnan(r[1:]).any()
    want = []
    for i, x, y in set(filter(ok, points)):
        near = sorted((float(np.sqrt((x - a) ** 2 + (y - b) ** 2)), j) for j, a, b in filter(ok, cells))
        want += [(i, n + 1, j, round(d, 9)) for n, (d, j) in enumerate(near[:k])]
    assert got == sorted(want)


def test_against_all_distances(spark):
    rng = np.random.default_rng(1)
    cells = [(j, float(x), float(y)) for j, (x, y) in enumerate(np.concatenate([rng.normal(0, 0.3, (150, 2)), rng.uniform(-20, 20, (40, 2)), [[300.0, 0.0]]]).round(2))]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.normal(0, 0.4, (60, 2)), rng.uniform(-25, 25, (40, 2)), [[-90.0, 5.0], [299.0, 1.0]]]).round(2))]
    points += [points[0], (900, float("nan"), 1.0), (901, None, 1.0)]
    check(spark, points, [*cells, (999, float("nan"), 0.0)], 9, 0.8)
    check(spark, points[:20], cells[:4], 9, 0.8)
    check(spark, [(1, 0.0, 0.0)], [(1, 5.0, 0.0), (2, 0.0, 5.0), (3, -5.0, 0.0)], 2, 0.5)
    assert R.nearest_cells(spark.createDataFrame([(1, 0.0, 0.0)], "point_id int, x double, y double"), spark.createDataFrame([], "cell_id int, x double, y double"), 3, 1.0).count() == 0


def test_tiles_of_few_cells_and_groups_of_few_points(spark, monkeypatch):
    """Many tiles, some of one x or one place; groups divided; equal distances; a cell at minus zero."""
    monkeypatch.setattr(R, "CELLS_PER_TILE", 12)
    monkeypatch.setattr(R, "POINTS_PER_GROUP", 15)
    rng = np.random.default_rng(2)
    cells = [(j, float(x), float(y)) for j, (x, y) in enumerate(np.concatenate([rng.integers(0, 6, (300, 2)), np.c_[np.full(200, 3.0), rng.uniform(-9, 9, 200)], np.zeros((60, 2)), [[-0.0, 0.0]]]))]
    points = [(i, float(x), float(y)) for i, (x, y) in enumerate(np.concatenate([rng.integers(-2, 9, (60, 2)), rng.uniform(40, 41, (60, 2)), [[3.0, -50.0]]]))]
    for k in (1, 3, 9):
        check(spark, points, cells, k, 0.8)
    check(spark, points, cells[:5], 9, 0.8)


def test_many_points_far_from_many_cells(spark):
    """6,000 points outside of 120,000 cells: with each pair a row this takes minutes."""
    cells = spark.range(120_000).selectExpr("int(id) AS cell_id", "double(id % 400) AS x", "double(floor(id / 400)) AS y")
    points = spark.range(6_000).selectExpr("int(id) AS point_id", "700 + id / 100.0D AS x", "double(id % 300) AS y")
    began = time.time()
    got = R.nearest_cells(points, cells, 1, 0.8).selectExpr("count(*)", "count_if(cell_id = 399 + 400 * (point_id % 300) AND distance = (700 + point_id / 100.0D) - 399)", "max(rank)").first()
    assert tuple(got) == (6_000, 6_000, 1)
    assert time.time() - began < 60
