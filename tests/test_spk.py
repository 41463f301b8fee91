"""SPK files made by a writer of known polynomials, read back and evaluated, against numpy's polynomials."""

import numpy as np
import pytest
from numpy.polynomial import Polynomial, chebyshev
from skyfold.sources import spk

RNG = np.random.default_rng(3)


def pieces(n, size, init, length, sets):
    """(words of a type 2 or 3 segment, function of et giving what it holds)."""
    c = RNG.normal(size=(n, sets, size))
    words = np.concatenate([np.concatenate([[init + (i + 0.5) * length, length / 2], c[i].ravel()]) for i in range(n)] + [[init, length, 2 + sets * size, n]])

    def at(et):
        i = min(int((et - init) // length), n - 1)
        x = (et - init - (i + 0.5) * length) / (length / 2)
        p = [chebyshev.chebval(x, c[i, k]) for k in range(sets)]
        return p if sets == 6 else p + [chebyshev.chebval(x, chebyshev.chebder(c[i, k])) / (length / 2) for k in range(3)]

    return words, at


def sampled(epochs, degree, polynomials):
    states = np.array([[p(t) for p in polynomials] + [p.deriv()(t) for p in polynomials] for t in epochs])
    return np.concatenate([states.ravel(), epochs, epochs[99:-1:100], [degree, len(epochs)]])


def read(spark, *contents):
    return spk.intervals(spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "file long, content binary"))


def got(spark, held, ets, target, observer, **more):
    rows = spk.states(spark.createDataFrame([(i, float(t)) for i, t in enumerate(ets)], "id int, et double"), held, target, observer, **more).collect()
    return {r.id: np.array([r[c] for c in ("x", "y", "z", "vx", "vy", "vz")]) for r in rows}


@pytest.mark.parametrize("big", [False, True])
def test_all_types(spark, big):
    two, at2 = pieces(7, 6, 100.0, 50.0, 3)
    three, at3 = pieces(4, 3, 0.0, 100.0, 6)
    epochs = np.sort(RNG.uniform(0, 400, 250))
    epochs[0], epochs[-1] = 0.0, 400.0
    odd, even, cubic = ([Polynomial(RNG.normal(size=d) / 50.0 ** np.arange(d)) for _ in range(3)] for d in (5, 6, 8))
    file = spk.daf([(10, 1, 1, 2, 100.0, 450.0, two), (20, 1, 1, 3, 0.0, 400.0, three), (30, 1, 1, 9, 0.0, 400.0, sampled(epochs, 4, odd)), (40, 1, 1, 9, 0.0, 400.0, sampled(epochs, 7, even)), (50, 1, 1, 13, 0.0, 400.0, sampled(epochs, 3, cubic))], big)
    held = read(spark, file)
    ets = [100.0, 149.999, 150.0, 333.3, 333.3, 400.0, 450.0, 99.9, 450.1, *epochs[[0, 1, 100, -1]]]
    for target, want in ((10, at2), (20, at3)):
        for i, v in got(spark, held, ets, target, 1, bucket_s=50.0).items():
            inside = 100 <= ets[i] <= 450 if target == 10 else 0 <= ets[i] <= 400
            assert np.allclose(v, want(ets[i]), atol=1e-9) if inside else np.isnan(v).all(), (target, ets[i])
    for target, ps, tol in ((30, odd, 1e-7), (40, even, 1e-7), (50, cubic, 1e-6)):
        for i, v in got(spark, held, ets, target, 1, bucket_s=5.0).items():
            if 0 <= ets[i] <= 400:
                assert np.allclose(v[:3], [p(ets[i]) for p in ps], atol=1e-6), (target, ets[i])
                if target != 30:
                    assert np.allclose(v[3:], [p.deriv()(ets[i]) for p in ps], atol=tol * 10), (target, ets[i])


def constant(x, start, stop):
    return np.array([(start + stop) / 2, (stop - start) / 2, x, 2 * x, 3 * x, start, stop - start, 5, 1])


def test_later_segments_first_and_chains(spark):
    segs = [(5, 3, 1, 2, 0.0, 100.0, constant(1.0, 0, 100)), (5, 3, 1, 2, 40.0, 60.0, constant(2.0, 40, 60)), (3, 0, 1, 2, 0.0, 100.0, constant(10.0, 0, 100)), (7, 0, 1, 2, 0.0, 50.0, constant(100.0, 0, 50)), (8, 0, 17, 2, 0.0, 50.0, constant(0.0, 0, 50))]
    many = [(100 + k, 0, 1, 2, 0.0, 10.0, constant(float(k), 0, 10)) for k in range(60)]  # three summary records
    later = [(5, 3, 1, 2, 50.0, 55.0, constant(4.0, 50, 55))]
    held = read(spark, spk.daf(segs + many), spk.daf(later))
    ets = [0.0, 39.9, 40.0, 49.0, 50.0, 55.0, 55.5, 60.0, 61.0]
    x = lambda t, o: {i: v[0] for i, v in got(spark, held, ets, t, o).items()}
    assert list(dict(sorted(x(5, 3).items())).values()) == [1, 1, 2, 2, 4, 4, 2, 2, 1]
    chain = x(5, 7)
    assert [chain[i] for i in range(5)] == [1 + 10 - 100, 1 + 10 - 100, 2 + 10 - 100, 2 + 10 - 100, 4 + 10 - 100] and all(np.isnan(chain[i]) for i in range(5, 9))
    assert got(spark, held, [3.0], 159, 0)[0][1] == 118.0 and got(spark, held, [3.0], 0, 159)[0][1] == -118.0
    for bad, why in (((8, 5), "several frames"), ((5, 999), "not connected")):
        with pytest.raises(ValueError, match=why):
            got(spark, held, [1.0], *bad)
    table = spk.segments(spark.createDataFrame([(0, bytearray(spk.daf(segs)))], "file long, content binary")).orderBy("segment").collect()
    assert [(r.target, r.center, r.frame, r.type, r.start, r.stop) for r in table] == [s[:6] for s in segs] and table[1].begin == table[0].end + 1
    with pytest.raises(Exception, match="not an SPK file"):
        read(spark, b"x" * 2000).collect()


def test_files(spark, tmp_path):
    path = tmp_path / "a.bsp"
    path.write_bytes(spk.daf([(5, 3, 1, 2, 0.0, 100.0, constant(1.0, 0, 100))]))
    held = spk.intervals(spk.read_files(spark, [str(path)]))
    assert [tuple(r)[:8] for r in held.collect()] == [(0, 0, 5, 3, 1, 2, 0.0, 100.0)] and spk.intervals(spk.read_files(spark, [])).count() == 0
