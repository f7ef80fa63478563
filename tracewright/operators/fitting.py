"""Joint fits of peak models (Gaussian, exponentially modified Gaussian) by Levenberg-Marquardt, and Student's t."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import kernels as K

FIT = "array<struct<mu:double,sigma:double,tau:double,height:double,area:double,area_se:double>>"


#: Samples, over all fits and their padding, that are fitted at once.
STACK_SAMPLES = 1 << 18


def _model(p: np.ndarray, t: np.ndarray, per: int, line: bool, middle: np.ndarray) -> np.ndarray:
    """The models with parameters p (a row each) at the places t (a row each); ``middle`` is where lines turn."""
    peaks = p[:, : p.shape[1] - 2 * line].reshape(len(p), -1, per, 1)
    out = p[:, -2, None] + p[:, -1, None] * (t - middle[:, None]) if line else np.zeros(t.shape)
    for k in range(peaks.shape[1]):
        out = out + (K.gaussian(t, *peaks[:, k].transpose(1, 0, 2)) if per == 3 else K.emg(t, *peaks[:, k].transpose(1, 0, 2)))
    return out


def _start(t: np.ndarray, y: np.ndarray, apex: float, per: int) -> list[float]:
    i = int(np.argmin(np.abs(t - apex)))
    near = slice(max(i - 3, 0), i + 4)
    i = near.start + int(np.argmax(y[near]))
    a = max(float(y[i]), 1e-12)
    left, right = K.crossings(t, y, i, a / 2)
    step = (t[-1] - t[0]) / max(len(t) - 1, 1)
    hl = t[i] - left if left is not None else (right - t[i] if right is not None else 3 * step)
    hr = right - t[i] if right is not None else hl
    if per == 3:
        return [a, float(t[i]), (hl + hr) / 2.3548]
    s = hl / 1.1774
    tau = max(0.2 * s, hr - hl)
    return [a * (1 + 0.5 * tau / s), float(t[i]) - 0.3 * min(tau, s), s, tau]


def fit(t: np.ndarray, y: np.ndarray, apexes: list[float], model: str = "gaussian", line: bool = False, most: int = 200) -> list[dict]:
    """Fits all peaks together within the given samples; parameters are kept in bounds by projection. Raises ValueError
    with too few samples."""
    (found,) = fit_many([(t, y, apexes)], model, line, most)
    if found is None:
        raise ValueError("too few samples for the fit")
    return found


def fit_many(problems: list[tuple], model: str = "gaussian", line: bool = False, most: int = 200) -> list[list[dict] | None]:
    """fit() of many problems (t, y, apexes), those with as many peaks side by side; None for too few samples. Shorter ones are
    padded to the longest of their stack, and padding has no weight."""
    per = 3 if model == "gaussian" else 4
    out: list[list[dict] | None] = [None] * len(problems)
    kinds: dict[int, list[int]] = {}
    for k, (t, _, apexes) in enumerate(problems):
        if len(apexes) and len(t) >= per * len(apexes) + 2 * line + 1:
            kinds.setdefault(len(apexes), []).append(k)
    for own in kinds.values():
        own.sort(key=lambda k: len(problems[k][0]))
        while own:
            size = max(STACK_SAMPLES // len(problems[own[-1]][0]), 1)
            part = own[-size:]
            del own[-size:]
            for k, found in zip(part, _fit_stack([problems[k] for k in part], per, line, most)):
                out[k] = found
    return out


def _fit_stack(problems: list[tuple], per: int, line: bool, most: int) -> list[list[dict]]:
    """Levenberg-Marquardt over a stack of problems with as many peaks each. Each has a damping of its own, and goes on till
    it no longer gains."""
    m, longest, count = len(problems), max(len(t) for t, _, _ in problems), len(problems[0][2])
    sizes = np.array([len(t) for t, _, _ in problems])
    t, y, there = np.zeros((m, longest)), np.zeros((m, longest)), np.arange(longest) < sizes[:, None]
    for k, (a, b, _) in enumerate(problems):
        t[k, : len(a)], t[k, len(a) :], y[k, : len(b)] = a, a[-1], b
    p = np.array([[v for a in apexes for v in _start(u, v_, a, per)] + [0.0, 0.0] * line for u, v_, apexes in problems])
    n, begin, end = p.shape[1], t[:, 0], t[:, -1]
    span, step = end - begin, (end - begin) / np.maximum(sizes - 1, 1)
    middle = np.where(there, t, 0).sum(1) / sizes
    tall = np.maximum(np.abs(y).max(1), 1e-12)
    low, high, scale = np.full((m, n), -np.inf), np.full((m, n), np.inf), np.ones((m, n))
    for k in range(0, per * count, per):
        low[:, k], low[:, k + 1], low[:, k + 2] = 0, begin, step / 20
        high[:, k + 1], high[:, k + 2] = end, 2 * span
        scale[:, k], scale[:, k + 1], scale[:, k + 2] = tall, span, np.maximum(p[:, k + 2], step)
        if per == 4:
            low[:, k + 3], high[:, k + 3], scale[:, k + 3] = step / 100, 10 * span, np.maximum(p[:, k + 3], step)
    p = np.clip(p, low, high)

    def rests(p: np.ndarray, own: np.ndarray) -> np.ndarray:
        return np.where(there[own], y[own] - _model(p, t[own], per, line, middle[own]), 0)

    def slopes(p: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = np.empty((len(own), longest, n))
        for j in range(n):
            h = 1e-6 * np.maximum(np.abs(p[:, j]) if j % per != 1 else 0.0, scale[own, j])
            up, down = p.copy(), p.copy()
            up[:, j] += h
            least = low[own, j]
            down[:, j] = np.where(np.isfinite(least) & (least > 0), np.maximum(p[:, j] - h, p[:, j] / 2), p[:, j] - h)
            move = _model(up, t[own], per, line, middle[own]) - _model(down, t[own], per, line, middle[own])
            out[:, :, j] = np.where(there[own], move / (up[:, j] - down[:, j])[:, None], 0)
        return out

    every = np.arange(m)
    rest = rests(p, every)
    rss, damp, rounds = (rest * rest).sum(1), np.full(m, 1e-3), np.zeros(m, int)
    normal, pull = np.empty((m, n, n)), np.empty((m, n))
    going, fresh = every, np.ones(m, bool)
    while len(going):
        if len(new := going[fresh[going]]):
            j = slopes(p[new], new)
            normal[new], pull[new] = j.transpose(0, 2, 1) @ j, (j * rest[new][:, :, None]).sum(1)
            fresh[new] = False
        diagonal = np.maximum(np.einsum("kii->ki", normal[going]), 1e-300)
        change, solved = _solved(normal[going] + damp[going, None, None] * (diagonal[:, :, None] * np.eye(n)), pull[going])
        q = np.clip(p[going] + change, low[going], high[going])
        trial = rests(q, going)
        score = (trial * trial).sum(1)
        better = solved & (score < rss[going])
        small = (rss[going] - score < 1e-8 * rss[going]) | (np.max(np.abs(q - p[going]) / scale[going], axis=1) < 1e-6)
        won, lost = going[better], going[~better]
        p[won], rest[won], rss[won], damp[won] = q[better], trial[better], score[better], np.maximum(damp[won] / 3, 1e-12)
        fresh[won] = True
        rounds[won] += 1
        damp[lost] *= 4
        stays = np.where(better, ~small & (rounds[going] < most), damp[going] <= 1e14)
        going = going[stays]
    j = slopes(p, every)
    cov = (rss / np.maximum(sizes - n, 1))[:, None, None] * np.linalg.pinv(j.transpose(0, 2, 1) @ j)
    root, found = math.sqrt(2 * math.pi), []
    for i in range(m):
        peaks = []
        for a in range(0, per * count, per):
            q, s = p[i, a : a + per].tolist(), a + 2
            var = q[2] ** 2 * cov[i, a, a] + q[0] ** 2 * cov[i, s, s] + 2 * q[0] * q[2] * cov[i, a, s]
            peaks.append({"mu": q[1], "sigma": q[2], "tau": q[3] if per == 4 else None, "height": q[0], "area": q[0] * q[2] * root, "area_se": root * math.sqrt(max(var, 0.0))})
        found.append(peaks)
    return found


def _solved(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions of a stack of systems, and which of them there are."""
    try:
        return np.linalg.solve(a, b[:, :, None])[:, :, 0], np.ones(len(a), bool)
    except np.linalg.LinAlgError:
        if len(a) == 1:
            return np.zeros_like(b), np.zeros(1, bool)
        half = len(a) // 2
        parts = _solved(a[:half], b[:half]), _solved(a[half:], b[half:])
        return np.concatenate([x for x, _ in parts]), np.concatenate([ok for _, ok in parts])


def fitted(x: Column, y: Column, start: Column, end: Column, apexes: Column, model: str = "gaussian", line: bool = False) -> Column:
    """The joint fit of a cluster's peaks within [start, end] as FIT; null with too few samples or a start outside."""

    def run(rows):
        problems = []
        for t, v, a, b, apexes in rows:
            inside = (t >= a) & (t <= b)
            problems.append((t[inside], v[inside], list(apexes)))
        return fit_many(problems, model, line)

    return K.column_of_batches(FIT, run, x, y, start, end, apexes)


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
    f = d
    for m in range(1, 300):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + k * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + k / c
            c = c if abs(c) > tiny else tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_cdf(t: float, df: float) -> float:
    tail = 0.5 * _beta(df / 2, 0.5, df / (df + t * t))
    return 1 - tail if t > 0 else tail


def t_value(p: float, df: float) -> float:
    """Student's t quantile, by bisection."""
    if not 0 < p < 1 or df <= 0:
        return math.nan
    if p < 0.5:
        return -t_value(1 - p, df)
    low, high = 0.0, 1.0
    while t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def t_quantile(p: float, df: Column) -> Column:
    held: dict[float, float] = {}

    def run(d):
        if d not in held:
            held[d] = t_value(p, float(d))
        return held[d]

    return K.column("double", run, df.cast("double"))


def emg_shape(s: Column, tau: Column) -> Column:
    """struct(mode, fwhm) of a unit EMG at 0, on a fine grid with parabolic refinement."""

    def run(s, tau):
        t = np.linspace(-6 * s, 6 * s + 12 * tau, 4001)
        v = K.emg(t, 1.0, 0.0, s, tau)
        mode, height, k = K.parabolic_apex(t, v)
        a, b = K.crossings(t, v, k, height / 2)
        return mode, b - a

    return K.struct({"mode": "double", "fwhm": "double"}, run, s, tau)


def confidence(value: Column, se: Column, df: Column, level: float = 0.95) -> Column:
    """struct(low, high) of a two-sided interval."""
    half = t_quantile(0.5 + level / 2, df) * se
    return F.struct((value - half).alias("low"), (value + half).alias("high"))
