"""Integration of clusters on signals whose areas are known."""

import numpy as np
import pytest

from tracewright.operators import clusters, kernels

X = np.linspace(0, 12, 4001)
ROOT = np.sqrt(2 * np.pi)


def areas(y, peaks, mode, **options):
    return [r["area"] for r in clusters.integrate(X, y, peaks, mode, **options)]


def test_resolved_pair():
    y = kernels.gaussian(X, 10, 5, 0.1) + kernels.gaussian(X, 10, 5.4, 0.1)
    peaks = [(4.4, 5.0, 5.2), (5.2, 5.4, 6.0)]
    true = 10 * 0.1 * ROOT
    assert areas(y, peaks, "drop") == pytest.approx([true, true], rel=0.015)
    assert areas(y, peaks, "fit", model="gaussian") == pytest.approx([true, true], rel=0.015)
    assert all(v < 0.8 * true for v in areas(y, peaks, "valley"))
    assert sum(areas(y, peaks, "drop")) == pytest.approx(areas(y, [(4.4, 5.0, 6.0)], "drop")[0], abs=1e-9)
    assert [r["cluster"] for r in clusters.integrate(X, y, peaks)] == [1, 1]


def test_hull_stays_below_a_curved_baseline():
    y = kernels.gaussian(X, 10, 5, 0.1) + kernels.gaussian(X, 10, 5.4, 0.1) + 3 * (X - 5) ** 2
    peaks = [(4.4, 5.0, 5.2), (5.2, 5.4, 6.0)]
    assert sum(areas(y, peaks, "baseline")) > sum(areas(y, peaks, "drop"))


@pytest.mark.parametrize("ratio", [10, 20])
def test_rider_on_a_tail(ratio):
    parent = kernels.emg(X, 100, 3, 0.1, 0.6)
    rider = kernels.gaussian(X, parent.max() / ratio, 4.6, 0.05)
    y = parent + rider
    peaks = [(2.5, float(X[np.argmax(parent)]), 4.42), (4.42, 4.6, 4.78), (4.78, 4.8, 8.0)][:2]
    peaks[0] = (2.5, peaks[0][1], 4.42)
    peaks[1] = (4.42, 4.6, 8.0)
    true = parent.max() / ratio * 0.05 * ROOT
    results = clusters.integrate(X, y, [peaks[0], (4.42, 4.6, 4.85)], "skim-exp", skim_ratio=ratio * 0.5)
    drop = clusters.integrate(X, y, [peaks[0], (4.42, 4.6, 4.85)], "drop")
    assert results[1]["host"] == 1 and results[1]["area"] == pytest.approx(true, rel=0.15)
    assert results[0]["area"] + results[1]["area"] == pytest.approx(sum(r["area"] for r in drop), rel=1e-6)
    tangent = clusters.integrate(X, y, [peaks[0], (4.42, 4.6, 4.85)], "skim-tangent", skim_ratio=ratio * 0.5)
    assert tangent[1]["area"] < drop[1]["area"] / 2
    assert clusters.integrate(X, y, [peaks[0], (4.42, 4.6, 4.85)], "skim-tangent", skim_ratio=1000)[1]["host"] is None


def test_gross_less_baseline_is_the_area():
    y = kernels.gaussian(X, 10, 5, 0.1) + 0.1 * X
    for mode in clusters.MODES:
        for r in clusters.integrate(X, y, [(4.4, 5.0, 5.6), (7.0, 7.0, 7.0)], mode, model="gaussian"):
            if r["area"] is not None:
                assert r["gross"] - r["baseline"] == pytest.approx(r["area"], abs=1e-9)
            else:
                assert r["note"] == "invalid bounds"


def test_chains_of_riders_end_at_their_root():
    assert clusters.hosts([1000.0, 100.0, 5.0], [1000.0, 50.0, 2.0], 10, 0.0) == [None, 0, 0]
    assert clusters.hosts([10.0, 9.0], [9.0, 8.0], 10, 0.0) == [None, None]


def test_areas_under_frames(spark):
    x = np.linspace(0, 20, 2001)
    rng = np.random.default_rng(3)
    y = sum(kernels.gaussian(x, a, m, s) for a, m, s in ((10, 5, 0.3), (0.7, 6.1, 0.12), (6, 12, 0.3), (5, 12.9, 0.3), (4, 17, 0.25))) + 0.1 * x + rng.normal(0, 0.002, len(x))
    spans = [(4.0, 5.0, 5.85), (5.85, 6.1, 6.6), (11.0, 12.0, 12.45), (12.45, 12.9, 14.0), (16.0, 17.0, 18.0), (19.0, 19.0, 19.0)]
    peaks = [{"start": a, "apex": b, "end": c, "manual": False} for a, b, c in spans]
    df = spark.createDataFrame([("t", x.tolist(), y.tolist(), peaks)], "trace_id string, x array<double>, y array<double>, peaks array<struct<start:double,apex:double,end:double,manual:boolean>>")
    side = {r.peak_no: r.asDict() for r in clusters.options(df).collect()}
    frames = clusters.mode_frames(df).collect()
    sums, own = {}, {}
    for f in frames:
        t, up, low = (np.array(v) for v in (f.x, f.upper, f.lower))
        sums[f.mode, f.peak_no] = sums.get((f.mode, f.peak_no), 0.0) + kernels.trapezoid(t, up - low)
        own[f.mode, f.peak_no] = f.area
    assert {m for m, _ in sums} == set(clusters.MODES) and {n for _, n in sums} == {1, 2, 3, 4, 5}
    for (mode, n), area in sums.items():
        assert area == pytest.approx(own[mode, n], rel=2e-3 if mode == "fit" else 1e-9), (mode, n)
        assert side[n][mode.replace("-", "_")] == pytest.approx(own[mode, n], rel=1e-9)
    assert any(f.piece == 1 and f.mode == "skim-tangent" and f.peak_no == 1 for f in frames)  # what the host keeps under its rider
    thin = clusters.mode_frames(df, ("drop",), most=40).collect()
    for f in thin:
        assert len(f.x) <= 60 and max(f.upper) == max(g for h in frames if (h.mode, h.peak_no) == ("drop", f.peak_no) for g in h.upper)
