"""Rotations along chains of constant, sampled and polynomial links, against numpy."""

import math

import numpy as np
import pytest
from skyfold.operators import frames


def about(axis, a):
    c, s = np.cos(a), np.sin(a)
    return {1: np.array([[1, 0, 0], [0, c, s], [0, -s, c]]), 2: np.array([[c, 0, -s], [0, 1, 0], [s, 0, c]]), 3: np.array([[c, s, 0], [-s, c, 0], [0, 0, 1]])}[axis]


def tree(spark):
    tilt, mount = about(1, 0.3) @ about(2, -0.7), about(2, 1.1)
    rows = [(1, t * 1_000_000, math.cos(0.01 * t), 0.0, math.sin(0.01 * t), 0.0) for t in range(0, 101, 10)] + [(2, t * 1_000_000, 1.0, 0.0, 0.0, 0.0) for t in (0, 100)]
    samples = spark.createDataFrame(rows, "frame int, ugps long, q0 double, q1 double, q2 double, q3 double")
    links = {
        "INST": frames.Constant("MOUNT", tuple(tilt.ravel())), "MOUNT": frames.Constant("SC", tuple(mount.ravel())), "SC": frames.Sampled("J2000", samples, 1), "OTHER": frames.Constant("SC", tuple(about(3, 0.2).ravel())),
        "EARTH": frames.Body("J2000", (10.0, -0.641), (80.0, 0.5, 0.1), (190.0, 360.9)), "LONE": frames.Constant("NOWHERE", tuple(np.eye(3).ravel())),
    }
    return links, tilt, mount


def earth(et):
    t, d = et / 86400 / 36525, et / 86400
    return about(3, np.radians(190.0 + 360.9 * d)) @ about(1, np.radians(90 - (80 + 0.5 * t + 0.1 * t * t))) @ about(3, np.radians(90 + 10 - 0.641 * t))


def test_paths_of_all_kinds(spark):
    from pyspark.sql import functions as F

    links, tilt, mount = tree(spark)
    times = spark.createDataFrame([(i, t) for i, t in enumerate([0, 5_000_000, 33_300_000, 33_300_000, 100_000_000, 100_000_001, -1])], "id int, ugps long")
    paths = {"a": ("INST", "EARTH"), "b": ("EARTH", "INST"), "c": ("INST", "OTHER"), "d": ("MOUNT", "MOUNT"), "e": ("J2000", "EARTH")}
    out = frames.rotations(times, links, paths, F.col("ugps") / 1.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # one lookup for four paths
    got = {r.id: r for r in out.collect()}
    matrix = lambda r, n: np.array([r[f"{n}{k}"] for k in range(9)]).reshape(3, 3)
    for i, r in got.items():
        assert np.allclose(matrix(r, "d"), np.eye(3)) and np.allclose(matrix(r, "e"), earth(float(r.ugps)), atol=1e-9)
        if not 0 <= r.ugps <= 100_000_000:
            assert np.isnan(matrix(r, "a")).all()
            continue
        spin = about(2, -0.02 * r.ugps / 1e6)  # a quaternion turns vectors, about() turns frames
        want = earth(float(r.ugps)) @ spin @ mount @ tilt
        assert np.allclose(matrix(r, "a"), want, atol=1e-9) and np.allclose(matrix(r, "b"), want.T, atol=1e-9) and np.allclose(matrix(r, "c"), about(3, 0.2).T @ mount @ tilt)
    both = frames.as_quaternion(frames.as_euler(out, "a", (3, 1, 3)), "a").where("id = 2").first()
    m = about(3, both.a_a1) @ about(1, both.a_a2) @ about(3, both.a_a3)
    q = np.array([both[f"a_q{k}"] for k in range(4)])
    assert np.allclose(m, matrix(both, "a")) and abs(q @ q - 1) < 1e-9
    assert np.isnan(frames.as_quaternion(out, "a").where("id = 6").first().a_q0)


def test_unconnected_and_empty(spark):
    links, *_ = tree(spark)
    times = spark.createDataFrame([], "ugps long")
    with pytest.raises(ValueError, match="not connected"):
        frames.rotations(times, links, {"a": ("LONE", "J2000")})
    assert frames.rotations(times, links, {"a": ("INST", "J2000")}).count() == 0
