"""Windows from chunk summaries against a pass over the whole series."""

import numpy as np
import pytest

from perfloom.operators import segments, series


def plain(loaded, least, gap, joins_first):
    """Windows of one series, sample by sample."""
    found, start = [], None
    for i, hit in enumerate([*loaded, False]):
        if hit and start is None:
            start = i
        elif not hit and start is not None:
            found.append([start, i - 1])
            start = None
    fits = lambda w: w[1] - w[0] + 1 >= least
    out = []
    for w in found if joins_first else filter(fits, found):
        if out and w[0] - out[-1][1] <= gap:
            out[-1][1] = w[1]
        else:
            out.append(w)
    return [tuple(w) for w in out if fits(w)]


@pytest.mark.parametrize("joins_first", [False, True])
def test_chunks_add_up(joins_first):
    """Any cut into chunks gives the windows and figures of the whole series."""
    draw = np.random.default_rng(5)
    for round_ in range(400):
        n = int(draw.integers(1, 90))
        loaded = draw.random(n) < draw.random()
        least, gap, size = int(draw.integers(1, 7)), int(draw.integers(1, 6)), int(draw.integers(1, 25))
        v = np.where(draw.random(n) < 0.1, np.nan, draw.integers(0, 50, n)).astype(float)
        parts, done = [], []
        for base in range(0, n, size):
            at = slice(base, base + size)
            one = segments.Series("x", loaded[at], least, gap, [np.nan_to_num(v[at]), np.ones(len(v[at]))], [v[at]], [v[at]])
            cut = segments.stretches(one, joins_first)
            assert len(cut) - sum(k == segments.DONE for k, *_ in cut) <= 7
            for (kind, a, b), f in zip(cut, segments.measured(one, cut), strict=True):
                (done if kind == segments.DONE else parts).append([kind, base + a, base + b, *f])
        got = sorted(done + segments.joined(parts, least, gap, joins_first), key=lambda p: p[1])
        assert [(a, b) for _, a, b, *_ in got] == plain(loaded, least, gap, joins_first), (round_, loaded, least, gap, size)
        for _, a, b, sums, peaks, lows in got:
            w = v[a : b + 1]
            assert sums == [np.nansum(w), b - a + 1]
            if not np.isnan(w).all():
                assert (peaks[0], lows[0]) == (np.nanmax(w), np.nanmin(w))


@pytest.mark.parametrize("size", [1, 2, 7, 1 << 16])
def test_load_windows_do_not_depend_on_chunks(spark, monkeypatch, size):
    from test_operators import system

    from perfloom import Thresholds
    from perfloom.operators import anomalies, slowdowns

    draw = np.random.default_rng(6)
    load = lambda: [float(x) for x in np.repeat(draw.integers(0, 101, 12), draw.integers(1, 9, 12))][:40] + [None]
    sys = system(spark, *[load()[:20] for _ in range(4)], cores=[f"{a};{b}" for a, b in draw.integers(0, 100, (20, 2))])
    th = Thresholds(cpu_sustained_pct=50.0, cpu_sustained_seconds=3, mem_used_pct_high=50.0, mem_sustained_samples=2, disk_active_pct=40.0,
                    disk_active_seconds=2, cpu_single_core_pct=40.0, cpu_single_core_seconds=2, core_others_avg_below=80.0)
    every = lambda: [sorted(map(repr, f(sys, th).collect())) for f in (anomalies.load_anomalies, anomalies.cpu_single_core_saturation, slowdowns.slowdown_windows)]
    want = every()
    assert all(want)
    monkeypatch.setattr(series, "CHUNK", size)
    assert every() == want
