"""Numerical kernels on signals whose truth is known."""

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.operators import fitting, gradient, image, kernels, peaks

X = np.linspace(0, 10, 2001)


def figures(y, a, b):
    t, v = kernels.window_nodes(X, y, a, b)
    return dict(zip(kernels.PEAK_FIELDS, kernels.peak_figures(t, v - kernels.chord(t, v))))


def test_gaussian_figures():
    f = figures(kernels.gaussian(X, 10, 5, 0.1), 4.4, 5.6)
    assert f["area"] == pytest.approx(10 * 0.1 * np.sqrt(2 * np.pi), rel=0.005)
    assert f["rt"] == pytest.approx(5, abs=1e-4) and f["height"] == pytest.approx(10, abs=0.01)
    assert f["fwhm"] == pytest.approx(0.235482, rel=0.002) and f["w5"] == pytest.approx(2 * np.sqrt(2 * np.log(20)) * 0.1, abs=0.002)
    assert f["tailing"] == pytest.approx(1, abs=0.01) and f["asymmetry"] == pytest.approx(1, abs=0.01)
    assert f["plates"] == pytest.approx(5.54 / 5.5452 * 2500, abs=10) and f["plates_usp"] == pytest.approx(2500, abs=40)


def test_emg_tails():
    f = figures(kernels.emg(X, 10, 5, 0.1, 0.1), 4.4, 6.5)
    assert f["tailing"] > 1.2 and f["asymmetry"] > f["tailing"]


def test_savgol_is_exact_on_polynomials():
    y = 3 * X**2 - X + 2
    assert np.allclose(kernels.savgol(y, 7, 2), y)
    assert np.allclose(kernels.savgol(y, 7, 2, 1, X[1] - X[0]), 6 * X - 1)
    assert kernels.savgol(np.array([1.0, 2.0]), 5, 2).tolist() == [1, 2] and kernels.savgol(np.ones(9), 5, 2, 3).tolist() == [0] * 9


@settings(max_examples=40, deadline=None)
@given(st.integers(3, 40), st.floats(0.1, 1e4), st.integers(0, 10**6))
def test_banded_solver(n, lam, seed):
    rng = np.random.default_rng(seed)
    y, d = rng.normal(size=n), np.diff(np.eye(n), 2, axis=0)
    z = kernels.als_baseline(y, lam, 0.3, 1)
    assert np.allclose(z, np.linalg.solve(np.eye(n) + lam * d.T @ d, y), atol=1e-6)


def test_baseline_of_a_drifting_signal():
    rng = np.random.default_rng(11)
    t = np.linspace(0, 20, 4001)
    truth = 2.0 + 0.2 * t + np.cos(t / 5)
    y = truth + sum(kernels.emg(t, 40, m, 0.06, 0.04) for m in (2, 6, 10, 13)) + rng.normal(0, 0.05, len(t))
    assert np.sqrt(np.mean((kernels.als_baseline(y, 1e8, 0.001, 20) - truth) ** 2)) < 0.15


def test_auto_lambda():
    assert [kernels.auto_lambda(n) for n in (4000, 8000, 100, 10**6)] == [1e8, 1.6e9, 1e4, 1e11]


def test_noise():
    rng = np.random.default_rng(3)
    x = np.linspace(0, 10, 5000)
    y = 0.2 * x + rng.normal(0, 0.1, 5000) + kernels.gaussian(x, 10, 5, 0.1)
    assert kernels.noise_sigma(y) == pytest.approx(0.1, abs=0.008)
    stepped = np.round((6 + 0.3 * X + kernels.gaussian(X, 60, 5, 0.1)) / 0.714) * 0.714
    assert kernels.noise_sigma(stepped) == pytest.approx(0.714 / np.sqrt(12), rel=0.05)


def test_detection():
    rng = np.random.default_rng(5)
    t = np.linspace(0, 20, 4001)
    mus = [2, 4, 6, 7.36, 7.64, 10, 13, 16]
    y = sum(kernels.emg(t, 40 + 5 * i, m, 0.06, 0.04) for i, m in enumerate(mus)) + 1.5 + 0.25 * t + rng.normal(0, 0.05, len(t))
    found = peaks.detect(t, y)
    assert len(found) == 8 and all(abs(p[1] - m) < 0.06 for p, m in zip(found, mus))
    assert len(peaks.detect(t, y, min_dist=0.5)) == 7 and peaks.detect(t[:6], y[:6]) == []
    x = np.linspace(0, 10, 8001)
    s = kernels.gaussian(x, 100, 5, 0.1) + kernels.gaussian(x, 25, 5.25, 0.08) + rng.normal(0, 0.05, len(x))
    found = peaks.detect(x, s, min_width=0.04)
    assert [p[4] for p in found] == [False, True] and abs(found[1][1] - 5.25) < 0.06 and found[0][2] == found[1][0]


def test_fits():
    rng = np.random.default_rng(5)
    t = np.linspace(4, 6, 400)
    y = kernels.gaussian(t, 10, 5, 0.08) + kernels.gaussian(t, 6, 5.25, 0.1) + rng.normal(0, 0.05, 400)
    a, b = fitting.fit(t, y, [5, 5.25])
    for f, (h, mu, s) in zip((a, b), ((10, 5, 0.08), (6, 5.25, 0.1))):
        assert abs(f["mu"] - mu) < 0.005 and abs(f["sigma"] - s) < 0.005 and abs(f["area"] - h * s * np.sqrt(2 * np.pi)) < 3 * f["area_se"]
    y = kernels.emg(t, 10, 4.8, 0.06, 0.12) + rng.normal(0, 0.03, 400)
    (f,) = fitting.fit(t, y, [4.86], "emg")
    assert abs(f["tau"] - 0.12) < 0.01 and abs(f["sigma"] - 0.06) < 0.005
    with pytest.raises(ValueError):
        fitting.fit(t[:3], y[:3], [4.8])


def test_student_t():
    for (p, df), want in {(0.975, 1): 12.7062047, (0.975, 4): 2.7764451, (0.975, 10): 2.2281389, (0.95, 1000): 1.6463794}.items():
        assert fitting.t_value(p, df) == pytest.approx(want, abs=1e-5)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=2, max_size=40))
def test_hull_is_below_the_signal(v):
    x, y = np.arange(len(v), dtype=float), np.array(v)
    hx, hy = kernels.lower_hull(x, y)
    assert (np.interp(x, hx, hy) <= y + 1e-9).all() and hx[0] == 0 and hx[-1] == len(v) - 1


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=30))
def test_maxima_with_plateaus(v):
    got = kernels.local_maxima(np.array(v, float)).tolist()
    want, i = [], 1
    while i < len(v) - 1:
        j = i
        while j + 1 < len(v) and v[j + 1] == v[i]:
            j += 1
        if v[i] > v[i - 1] and j + 1 < len(v) and v[j + 1] < v[i]:
            want.append((i + j) // 2)
        i = j + 1
    assert got == want


def test_gradient_geometry():
    assert gradient.void_volume(150, 4.6) == pytest.approx(1.6203, abs=1e-4) and gradient.dwell_time(1.1, 0.5) == 2.2


def test_image_kernels():
    y = np.sin(np.linspace(0, 9, 300)) * 40 + 100
    raster = image.draw(y, 400, 300, 0, 200, (200, 30, 30))
    rows = image.columns(image.mask(raster, (200, 30, 30), 40))
    assert np.abs(200 - rows / 299 * 200 - np.interp(np.linspace(0, 299, 400), np.arange(300), y)).max() < 4
    grid = np.zeros((60, 80), bool)
    grid[30] = True
    grid[20:40, 40] = True
    clean = image.erase_lines(grid, 50)
    assert clean[30].sum() <= 1 and clean[20:30, 40].all()
    h = image.homography(np.array([[0, 0], [10, 0], [10, 10], [0, 10]]), np.array([[1, 1], [9, 2], [10, 11], [0, 9]]))
    p = h @ [10, 10, 1]
    assert np.allclose(p[:2] / p[2], [10, 11])
    turned = image.warp(raster, image.rotation(0, 400, 300), 400, 300)
    assert np.array_equal(turned, raster)


@pytest.mark.parametrize("n, lam", [(1000, 1e3), (1537, 1e5), (4001, 1e8), (2500, 1.0)])
def test_cyclic_reduction_equals_the_plain_solver(n, lam):
    rng = np.random.default_rng(n)
    d0, d1 = np.full(n, 6.0), np.full(n - 1, -4.0)
    d0[[0, -1]], d0[[1, -2]], d1[[0, -1]] = 1, 5, -2
    w, y = rng.random(n), rng.normal(size=n).cumsum()
    a = kernels._solve_pentadiagonal((w + lam * d0).tolist(), (lam * d1).tolist(), lam, (w * y).tolist())
    assert np.allclose(kernels._solve_cyclic(w + lam * d0, lam * d1, lam, w * y), a, atol=1e-5)


def naive_prominence(y, i):
    """By its definition: walk to the left while samples are lower, to the right while they are not higher."""
    a, b = i, i
    while a > 0 and y[a - 1] < y[i]:
        a -= 1
    while b < len(y) - 1 and y[b + 1] <= y[i]:
        b += 1
    prominence = y[i] - max(min(y[a : i + 1]), min(y[i : b + 1]))
    level = y[i] - prominence / 2
    left = next((k for k in range(i - 1, -1, -1) if y[k] <= level), 0)
    right = next((k for k in range(i + 1, len(y)) if y[k] <= level), len(y) - 1)
    return prominence, max(right - left, 1)


def test_prominences_by_definition():
    rng = np.random.default_rng(1)
    for k in range(400):
        n = int(rng.integers(3, 120))
        y = [rng.normal(size=n), rng.integers(0, 4, n).astype(float), np.cumsum(rng.normal(size=n)), np.round(np.cumsum(rng.normal(size=n)))][k % 4]
        tops = kernels.local_maxima(y)
        want = [naive_prominence(y.tolist(), i) for i in tops.tolist()]
        got = peaks.prominences(y, tops)
        assert np.allclose(got[0], [p for p, _ in want]) and got[1].tolist() == [w for _, w in want]
        some = tops[::2]
        assert np.allclose(peaks.prominences(y, some)[0], got[0][::2])


def test_thin_out_by_definition():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = np.sort(np.round(rng.uniform(0, 3, 60), 2))
        tops, rank = np.sort(rng.choice(60, 25, replace=False)), rng.integers(0, 6, 25).astype(float)
        for least in (0.0, 0.03, 0.1, 0.5):
            kept = []
            for k in sorted(range(25), key=lambda k: -rank[k]):
                if all(abs(x[tops[k]] - x[tops[j]]) >= least for j in kept):
                    kept.append(k)
            assert peaks.thin_out(x, tops, rank, least).tolist() == sorted(kept)


def test_bounds_by_definition():
    rng = np.random.default_rng(3)
    for _ in range(300):
        s = np.cumsum(rng.normal(size=40))
        i, way = int(rng.integers(0, 40)), int(rng.choice([-1, 1]))
        limit = 39 if way > 0 else 0
        path = list(range(i, limit + way, way))
        low = min(s[path])
        back, rise = low + max(0.001 * (s[i] - low), 0.2), max(0.3, 0.01 * (s[i] - low))
        best, want = i, None
        for j in path[1:]:
            best = j if s[j] < s[best] else best
            if s[j] <= back or s[j] > s[best] + rise:
                want = j if s[j] <= back else best
                break
        assert peaks.side(s, i, way, limit, 0.1) == (best if want is None else want)


def test_long_traces_take_linear_time():
    rng = np.random.default_rng(4)
    y = np.convolve(rng.normal(size=1_000_000), np.ones(5) / 5, "same")
    tops = kernels.local_maxima(y)
    began = time.process_time()
    prominence, width = peaks.prominences(y, tops)
    assert time.process_time() - began < 2 and len(tops) > 100_000 and (prominence >= 0).all() and (width >= 1).all()
    x = np.linspace(0, 200, 200_001)
    trace = sum(kernels.gaussian(x, 10, m, 0.05) for m in np.arange(1, 199.5, 0.5)) + rng.normal(0, 0.05, len(x))
    began = time.process_time()
    found = peaks.detect(x, trace)
    assert time.process_time() - began < 1 and abs(len(found) - 397) < 5


def test_baselines_of_many_traces():
    rng = np.random.default_rng(6)
    lengths = [0, 1, 2, 3, 4, 5, 64, 599, 600, 601, 1000, *[64] * 40, *[601] * 4]
    traces = [np.cumsum(rng.normal(size=n)) for n in lengths]
    for lam in (1e2, 1e6, None):
        for y, z in zip(traces, kernels.als_baselines(traces, lam)):
            own = lam or kernels.auto_lambda(len(y))
            assert np.array_equal(z, kernels.als_baseline(y, own))  # the same by itself as among others
            if len(y) == 64:  # and that of the dense system
                d = np.diff(np.eye(64), 2, axis=0)
                w, want = np.ones(64), y
                for _ in range(10):
                    want = np.linalg.solve(np.diag(w) + own * d.T @ d, w * y)
                    w = np.where(y > want, 0.01, 0.99)
                assert np.allclose(z, want, atol=1e-5)
    short = [np.cumsum(rng.normal(size=64)) for _ in range(2000)]
    began = time.process_time()
    kernels.als_baselines(short, 1e4)
    assert time.process_time() - began < 0.5
    y = np.cumsum(rng.normal(size=100_000))
    began = time.process_time()
    kernels.als_baseline(y, 1e7)
    assert time.process_time() - began < 0.5


def test_fits_side_by_side():
    rng = np.random.default_rng(7)
    problems, truth = [], []
    for k in range(60):
        t = np.linspace(0, 10, int(rng.integers(60, 200)))
        true = [(rng.uniform(2, 9), m, rng.uniform(0.3, 0.6)) for m in [3.0, 7.0][: 1 + k % 2]]
        problems.append((t, sum(kernels.gaussian(t, *q) for q in true) + rng.normal(0, 0.05, len(t)), [q[1] for q in true]))
        truth.append([q[0] * q[2] * np.sqrt(2 * np.pi) for q in true])
    found = fitting.fit_many([*problems, (np.arange(3.0), np.ones(3), [1.0]), (np.zeros(0), np.zeros(0), [])])
    assert found[60:] == [None, None]
    within = [abs(f["area"] - a) <= 2 * f["area_se"] for fits, areas in zip(found, truth) for f, a in zip(fits, areas)]
    assert 0.88 <= np.mean(within) <= 1.0  # about 92 % or more lie within two standard errors
    for problem, together in zip(problems[:20], found):
        for a, b in zip(fitting.fit(*problem), together):
            assert all(a[c] == pytest.approx(b[c], rel=1e-6) for c in ("mu", "sigma", "height", "area", "area_se"))


def test_tailing_fits_side_by_side():
    t = np.linspace(0, 10, 120)
    shapes = [(5.0, 4.0, 0.3, 0.5), (2.0, 5.0, 0.4, 0.3), (8.0, 4.5, 0.35, 0.8)]
    found = fitting.fit_many([(t, kernels.emg(t, *q), [q[1] + 0.3]) for q in shapes], "emg")
    for (f,), (a, mu, s, tau) in zip(found, shapes):
        assert (f["mu"], f["sigma"], f["tau"]) == pytest.approx((mu, s, tau), rel=1e-2)
        assert f["area"] == pytest.approx(a * s * np.sqrt(2 * np.pi), rel=1e-3)


def test_batches_are_taken_slice_by_slice():
    import pyarrow as pa

    sizes = []
    rows = pa.array([[float(k)] * (k % 4) if k % 7 else None for k in range(3 * kernels.SLICE + 5)], pa.list_(pa.float64()))
    f = lambda cols: sizes.append(len(cols[0])) or kernels.built([None if row is None else row[0] + 1 for row in kernels._rows(cols)], rows.type)
    assert kernels.in_slices(f, (rows,)).to_pylist() == [None if v is None else [x + 1 for x in v] for v in rows.to_pylist()]
    assert max(sizes) <= kernels.SLICE and sum(sizes) == len(rows)
    assert kernels.in_slices(f, (rows[:0],)).to_pylist() == []
