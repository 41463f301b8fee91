"""C-kernel pointing against a lookup that goes through all segments and instances."""

import numpy as np
import pytest
from skyfold.sources import ck, spk

RNG = np.random.default_rng(5)


def segment(instrument, ticks, begins, rates):
    q = RNG.normal(size=(len(ticks), 4))
    q = np.cumsum(q * 0.1, 0) + [3.0, 0, 0, 0]
    q /= np.linalg.norm(q, axis=1)[:, None]
    q[1::3] *= -1
    w = RNG.normal(size=(len(ticks), 3)) if rates else None
    return dict(instrument=instrument, ticks=np.array(ticks, float), begins=np.array(begins, float), q=q, w=w)


def slerp(a, b, u):
    d = a @ b
    if d < 0:
        b, d = -b, -d
    t = np.arccos(min(1.0, d))
    return a if t < 1e-9 else (np.sin((1 - u) * t) * a + np.sin(u * t) * b) / np.sin(t)


def plain(files, instrument, tick, tolerance, need):
    for segs in reversed(files):
        for s in reversed(segs):
            if s["instrument"] != instrument or (need and s["w"] is None):
                continue
            t, own = s["ticks"], np.searchsorted(s["begins"], s["ticks"], "right")
            for i in range(len(t) - 1):
                if t[i] <= tick <= t[i + 1] and own[i] == own[i + 1]:
                    u = (tick - t[i]) / (t[i + 1] - t[i])
                    return slerp(s["q"][i], s["q"][i + 1], u), None if s["w"] is None else (1 - u) * s["w"][i] + u * s["w"][i + 1], tick
            i = int(np.argmin(abs(t - tick)))
            if abs(t[i] - tick) <= tolerance:
                return s["q"][i], None if s["w"] is None else s["w"][i], t[i]
    return None


def test_intervals_gaps_and_priorities(spark):
    files = [
        [segment(-1, np.arange(0, 1000, 7), [0, 350, 700], True), segment(-1, [100, 120, 150, 400], [100, 400], False), segment(-2, [5.0], [5], True)],
        [segment(-1, np.sort(RNG.choice(np.arange(200, 600), 130, replace=False)), [0, 300, 301, 450], True), segment(-2, [1, 2, 900], [1], False)],
    ]
    contents = []
    for segs in files:
        rows = [(s["instrument"], 1, 3, int(s["w"] is not None), s["ticks"][0], s["ticks"][-1], ck.type_three(s["ticks"], s["q"], s["begins"], s["w"])) for s in segs]
        contents.append(spk.daf(rows, kind_of_file=b"DAF/CK"))
    held = ck.spans(spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "file long, content binary"))
    asks = [(i, float(t)) for i in (-1, -2, -3) for t in [*RNG.uniform(-20, 1020, 150), *range(95, 130, 3), 346, 349.9, 350, 700, 400, 404, 410.01, 5, 8, 8.1, 900, 903.0]]
    times = spark.createDataFrame([(n, *a) for n, a in enumerate(asks)] * 2, "id int, instrument int, tick double")
    for tolerance, need in ((0.0, False), (3.0, False), (3.0, True)):
        got = ck.pointing(times, held, tolerance, need, bucket=20.0).collect()
        assert len(got) == 2 * len(asks)
        some = 0
        for r in got:
            want = plain(files, *asks[r.id], tolerance, need)
            q, w = np.array([r[f"q{k}"] for k in range(4)]), np.array([r[f"w{k}"] for k in range(3)])
            if want is None:
                assert np.isnan(q).all() and np.isnan(r.tick_found), r
                continue
            some += 1
            assert min(abs(q - want[0]).max(), abs(q + want[0]).max()) < 1e-9 and r.tick_found == want[2], (r, want)
            assert np.isnan(w).all() if want[1] is None else np.allclose(w, want[1]), (r, want)
        assert some > 100
    with pytest.raises(Exception, match="not an CK file"):
        ck.spans(spark.createDataFrame([(0, bytearray(spk.daf([])))], "file long, content binary")).collect()
