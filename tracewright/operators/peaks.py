"""Peak detection: maxima by prominence, shoulders by curvature, bounds by return to the baseline."""

from __future__ import annotations

from bisect import bisect

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

PEAK = "array<struct<start:double,apex:double,end:double,prominence:double,shoulder:boolean>>"


def prominences(y: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prominence of each of ``tops`` (local maxima), and the samples between its crossings at half of that. On the left the walk
    stops at a sample as high, on the right it goes on over such samples.

    Between neighbouring maxima the signal only falls, then rises, so it is known by its maxima and the valleys between. A
    monotone stack of maxima gives the lowest valley before a higher one; the crossing's valley is found in a table of
    minima over powers of two, and the crossing in it by halving. Time grows with samples, and with maxima times their logarithm.
    """
    if not len(tops):
        return np.zeros(0), np.ones(0)
    y, n = np.asarray(y, float), len(y)
    inner = np.union1d(K.local_maxima(y), tops)
    every = np.concatenate([[0] if inner[0] else [], inner, [n - 1] if inner[-1] != n - 1 else []]).astype(int)
    heights, valleys = y[every], np.minimum.reduceat(y, every)[:-1]
    valleys = np.minimum(valleys, heights[1:])
    own = np.searchsorted(every, tops)
    left = _lowest_before_higher(heights.tolist(), valleys.tolist(), True)
    right = _lowest_before_higher(heights[::-1].tolist(), valleys[::-1].tolist(), False)[::-1]
    level_tops = y[np.maximum(tops - 1, 0)] >= y[tops]  # on a plateau the walk to the left ends at once
    lows = np.maximum(np.where(level_tops, y[tops], np.minimum(left[own], y[tops])), np.minimum(right[own], y[tops]))
    prom = y[tops] - lows
    level = y[tops] - prom / 2
    # the segment of each valley: its first and last lowest sample
    segment = np.repeat(np.arange(len(valleys)), np.diff(every))
    at_low = np.flatnonzero(y[: every[-1]] == valleys[segment])
    first_low, last_low = every[1:].copy(), every[1:].copy()
    first_low[segment[at_low[::-1]]], last_low[segment[at_low]] = at_low[::-1], at_low
    table = [valleys]
    while 2 << (len(table) - 1) <= len(valleys):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    before, after = own.copy(), own.copy()  # valleys in [before, own) and [own, after) are above the level
    for k in range(len(table) - 1, -1, -1):
        size = 1 << k
        at = before - size
        free = (at >= 0) & (table[k][np.maximum(at, 0)] > level)
        before = np.where(free, at, before)
        free = after + size <= len(valleys)
        free &= table[k][np.minimum(after, len(table[k]) - 1)] > level
        after = np.where(free, after + size, after)
    none_before, none_after = before == 0, after == len(valleys)
    into = np.maximum(before - 1, 0)
    start = _edge(y, last_low[into], np.minimum(every[into + 1], tops), level, True)
    into = np.minimum(after, len(valleys) - 1)
    end = _edge(y, np.maximum(every[into], tops), first_low[into], level, False)
    start, end = np.where(none_before, 0, start), np.where(none_after, n - 1, end)
    return prom, np.maximum(end - start, 1).astype(float)


def _lowest_before_higher(heights: list[float], valleys: list[float], stop_at_equal: bool) -> np.ndarray:
    """For each maximum the lowest valley between it and the nearest earlier maximum that is higher (or as high)."""
    out, stack = np.full(len(heights), np.inf), []
    for k, height in enumerate(heights):
        low = valleys[k - 1] if k else np.inf
        while stack and (stack[-1][0] < height or not stop_at_equal and stack[-1][0] == height):
            low = min(low, stack.pop()[1])
        stack.append((height, low))
        out[k] = low
    return out


def _edge(y: np.ndarray, low: np.ndarray, high: np.ndarray, level: np.ndarray, rising: bool) -> np.ndarray:
    """Where the signal crosses ``level`` between two samples of a slope: the last sample at or below it of a rise from
    ``low`` to ``high``, or the first one of a fall from ``low`` to ``high``."""
    a, b = low.copy(), high.copy()
    while (wide := b - a > 1).any():
        middle = (a + b) // 2
        under = y[middle] <= level
        a = np.where(wide & (under == rising), middle, a)
        b = np.where(wide & (under != rising), middle, b)
    return a if rising else b


def prominent(y: Column) -> Column:
    """Every local maximum with its prominence and width in samples: array of struct(i, prominence, width)."""

    def run(y):
        tops = K.local_maxima(y)
        return list(zip(tops.tolist(), *(v.tolist() for v in prominences(y, tops))))

    return K.column("array<struct<i:int,prominence:double,width:double>>", run, y)


def thin_out(x: np.ndarray, tops: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """Tops left when, from the greatest rank down, each takes away those nearer than ``least``."""
    order = np.argsort(x[tops], kind="stable")
    at = x[tops][order]
    first, last = np.searchsorted(at, at - least, "right"), np.searchsorted(at, at + least, "left")
    each = np.arange(len(at))
    while (off := (first > 0) & (at - at[np.maximum(first - 1, 0)] < least)).any():  # sums may have been rounded
        first -= off
    while (off := (first < each) & (at - at[np.minimum(first, len(at) - 1)] >= least)).any():
        first += off
    while (off := (last < len(at)) & (at[np.minimum(last, len(at) - 1)] - at < least)).any():
        last += off
    while (off := (last - 1 > each) & (at[np.maximum(last - 1, 0)] - at >= least)).any():
        last -= off
    near, kept = np.zeros(len(at), bool), np.zeros(len(at), bool)
    place = np.empty(len(at), int)
    place[order] = each
    for k in place[np.argsort(-rank, kind="stable")].tolist():
        if not near[k]:  # of what is kept, no sample lies near more than two
            kept[k] = True
            near[first[k] : last[k]] = True
    return np.sort(order[kept])


def detect(x: np.ndarray, y: np.ndarray, threshold: float | None = None, min_dist: float = 0.05, min_width: float = 0.01, shoulders: bool = True) -> list[tuple]:
    """Peaks (start, apex, end, prominence, shoulder) in order of apex. Below 7 samples there are none."""
    n = len(y)
    if n < 7:
        return []
    step = (x[-1] - x[0]) / (n - 1)
    sigma = K.noise_sigma(y) or 0.0
    if threshold is None:
        threshold = max(9 * sigma, 1e-4 * float(y.max() - y.min()))
    w = min(max(K.odd(0.5 * min_width / step), 5), 51) if min_width > 0 and step > 0 else min(max(K.odd(n / 500), 5), 25)
    s = K.savgol(y, w, 3) if n > w else y
    tops = K.local_maxima(s)
    prom, width = prominences(s, tops)
    good = (prom >= threshold) & (prom > 0) & (width * step >= min_width)
    tops, prom, width = tops[good], prom[good], width[good]
    left = thin_out(x, tops, prom, min_dist)
    tops, prom, half = tops[left], prom[left], np.maximum(width[left] / 2, 1)
    is_shoulder = np.zeros(len(tops), bool)
    curve = K.savgol(y, K.odd(1.5 * w), 3, 2) if n > 2 * w else np.zeros(n)
    if shoulders and len(tops) and n > 2 * w:
        found = find_shoulders(x, y, s, tops, curve, w, sigma, threshold, min_dist)
        order = np.argsort(np.append(tops, found), kind="stable")
        tops = np.append(tops, found)[order].astype(int)
        is_shoulder = np.append(is_shoulder, np.ones(len(found), bool))[order]
        prom = np.append(prom, np.zeros(len(found)))[order]
        half = np.append(half, np.full(len(found), float(w)))[order]
    cuts = [split(s, curve, a, b, sa, sb) for a, b, sa, sb in zip(tops[:-1], tops[1:], is_shoulder[:-1], is_shoulder[1:])]
    bounds = []
    for k, i in enumerate(tops):
        reach = max(3 * w, round(20 * half[k]))
        before, after = (cuts[k - 1] if k else None), (cuts[k] if k < len(cuts) else None)
        a = side(s, i, -1, max(before[0] if before else 0, i - reach), sigma) if not before or before[1] else before[0]
        b = side(s, i, 1, min(after[0] if after else n - 1, i + reach), sigma) if not after or after[1] else after[0]
        bounds.append((a, b))
    ok = positive(x, s, tops, bounds, step)
    return [(float(x[a]), float(x[i]), float(x[b]), float(prom[k]), bool(is_shoulder[k])) for k, (i, (a, b)) in enumerate(zip(tops, bounds)) if b > a and ok[k]]


def find_shoulders(x, y, s, tops, curve, w, sigma, threshold, min_dist) -> np.ndarray:
    """Places where the signal bends down sharply beside a peak without a maximum of its own."""
    rows = K.savgol_rows(K.odd(1.5 * w), 3, 2)
    gain = float(np.linalg.norm(rows[len(rows) // 2]))
    scale = max(K.robust_sd(curve), (1.0 if K.quantum(y) else 0.5) * sigma * gain)
    dips = K.local_maxima(-curve)
    dips = dips[curve[dips] < -6 * scale]
    after = np.searchsorted(tops, dips)
    gap = np.minimum(np.where(after < len(tops), tops[np.minimum(after, len(tops) - 1)] - dips, len(x)), np.where(after > 0, dips - tops[np.maximum(after - 1, 0)], len(x)))
    dips = dips[gap > w]
    bump_before, bump_after = _greatest_to_tops(curve, tops, dips)
    good = (bump_before > 0.5 * curve[dips]) & (bump_after > 0.5 * curve[dips])
    dips = dips[good]
    found: list[int] = []
    for i in dips[np.argsort(curve[dips], kind="stable")].tolist():
        k = bisect(found, i)
        beside = found[max(k - 1, 0) : k + 1]
        if any(abs(i - j) <= 2 * w for j in beside) or s[i] - s[max(i - 4 * w, 0) : i + 4 * w + 1].min() < threshold:
            continue
        m = np.searchsorted(tops, i)
        if any(abs(x[i] - x[j]) < min_dist for j in [*tops[max(m - 1, 0) : m + 1], *beside]):
            continue
        found.insert(k, i)
    return np.array(found, int)


def _greatest_to_tops(curve: np.ndarray, tops: np.ndarray, dips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greatest curvature between each dip and the maximum before it, and the one after it; infinite without one."""
    before, after = np.full(len(dips), np.inf), np.full(len(dips), np.inf)
    gaps = np.searchsorted(tops, dips)
    for gap in np.unique(gaps):
        own = gaps == gap if len(dips) < 64 else slice(*np.searchsorted(gaps, [gap, gap + 1]))
        at = dips[own]
        if gap > 0:
            before[own] = np.maximum.accumulate(curve[tops[gap - 1] : at[-1] + 1])[at - tops[gap - 1]]
        if gap < len(tops):
            after[own] = np.maximum.accumulate(curve[at[0] : tops[gap] + 1][::-1])[::-1][at - at[0]]
    return before, after


def split(s: np.ndarray, curve: np.ndarray, a: int, b: int, shoulder_a: bool, shoulder_b: bool) -> tuple[int, bool]:
    """(sample, is a valley) between neighbouring tops."""
    k = a + int(np.argmin(s[a : b + 1]))
    if a < k < b and s[k] < min(s[a], s[b]):
        return k, True
    if shoulder_a or shoulder_b:
        bumps = K.local_maxima(curve[a : b + 1]) + a
        bumps = bumps[curve[bumps] > 0]
        if len(bumps):
            at = a if shoulder_a else b
            return int(bumps[np.argmin(np.abs(bumps - at))]), False
    return a + int(np.argmax(curve[a : b + 1])), False


def side(s: np.ndarray, i: int, way: int, limit: int, sigma: float) -> int:
    """The peak's bound on one side: back at the baseline, or where the signal rises again, at most at ``limit``."""
    v = s[i : limit + 1] if way > 0 else s[limit : i + 1][::-1]
    if not len(v):
        v = s[i : i + 1]
    lowest = np.minimum.accumulate(v)
    low = lowest[-1]
    height = s[i] - low
    back, rise = low + max(0.001 * height, 2 * sigma), max(3 * sigma, 0.01 * height)
    ends = np.flatnonzero((v <= back) | (v > lowest + rise))
    ends = ends[ends > 0]
    if len(ends) and v[ends[0]] <= back:
        return int(i + way * ends[0])
    last = ends[0] if len(ends) else len(v) - 1
    return int(i + way * np.argmin(v[: last + 1]))


def positive(x, s, tops, bounds, step) -> list[bool]:
    """Peaks that stand above their own chord or that of the peaks they touch."""
    groups: list[list[int]] = []
    for k, (a, b) in enumerate(bounds):
        if groups:
            pa, pb = bounds[groups[-1][-1]]
            if x[a] - x[pb] <= max(2 * step, min(x[b] - x[a], x[pb] - x[pa]) / 2):
                groups[-1].append(k)
                continue
        groups.append([k])
    out = [False] * len(bounds)
    for group in groups:
        first, last = bounds[group[0]][0], bounds[group[-1]][1]
        for k in group:
            a, b = bounds[k]
            t, v = x[a : b + 1], s[a : b + 1]
            for lo, hi in dict.fromkeys(((a, b), (first, last))):
                if b > a and hi > lo:
                    net = v - (s[lo] + (s[hi] - s[lo]) * (t - x[lo]) / (x[hi] - x[lo]))
                    if net[tops[k] - a] > 0 and K.trapezoid(t, net) > 0:
                        out[k] = True
                        break
    return out


def detected(x: Column, y: Column, **options) -> Column:
    """Peaks of a trace as PEAK; options as for detect()."""

    return K.column(PEAK, lambda t, v: detect(t, v, **options), x, y)


FIGURES = {"start": "double", "apex": "double", "end": "double", "prominence": "double", "shoulder": "boolean"} | K.PEAK_FIELDS
MEASURED = "array<struct<" + ",".join(f"{n}:{t}" for n, t in FIGURES.items()) + ">>"


def figures(x: np.ndarray, y: np.ndarray, start: float, end: float) -> tuple:
    """PEAK_FIELDS of [start, end] above its chord; nulls without an extent."""
    if not end > start or not len(x):
        return (None,) * len(K.PEAK_FIELDS)
    t, v = K.window_nodes(x, y, start, end)
    return K.peak_figures(t, v - K.chord(t, v))


def measured(x: Column, y: Column, **options) -> Column:
    """Detected peaks of a trace with the figures of each above its chord (MEASURED), by one kernel."""
    return K.column(MEASURED, lambda t, v: [(*p, *figures(t, v, p[0], p[2])) for p in detect(t, v, **options)], x, y)


def peak_rows(traces: DataFrame, **options) -> DataFrame:
    """One row for each detected peak: trace_id, peak_no (from 1), and FIGURES. Samples stay behind; only figures go on."""
    found = traces.select("trace_id", measured(F.col("x"), F.col("y"), **options).alias("peaks"))
    return found.select("trace_id", F.posexplode("peaks").alias("k", "p")).select("trace_id", (F.col("k") + 1).alias("peak_no"), "p.*")


RUNS = "array<struct<" + ",".join(f"{n}:{t}" for n, t in ({"peak_no": "int", "start": "double", "end": "double"} | K.PEAK_FIELDS).items()) + ">>"


def runs(x: Column, y: Column, least: float = 0.0) -> Column:
    """The runs between neighbouring local minima that hold a local maximum, at least ``least`` long, with the figures of
    each above its chord (RUNS); peak_no counts all maxima."""

    def run(x, y):
        tops = K.local_maxima(y)
        edges = [0, *(int(a + np.argmin(y[a : b + 1])) for a, b in zip(tops[:-1], tops[1:])), len(y) - 1]
        if len(tops):  # the outer runs begin and end at the lowest samples there
            edges[0] = int(np.argmin(y[: tops[0] + 1]))
            edges[-1] = int(tops[-1] + np.argmin(y[tops[-1] :]))
        spans = [(k + 1, float(x[a]), float(x[b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if len(tops)]
        return [(k, a, b, *figures(x, y, a, b)) for k, a, b in spans if b - a >= least]

    return K.column(RUNS, run, x, y)


def simple_peaks(x: Column, y: Column, share: float = 0.03) -> Column:
    """A finder for rough signals: maxima that rise over both neighbouring minima by ``share`` of the signal's range, with
    the area above their chord: array of struct(start, apex, end, height, area)."""

    def run(x, y):
        if len(y) < 3:
            return []
        half = max(round(len(y) / 800), 1)
        kernel = np.ones(2 * half + 1) / (2 * half + 1)
        s = np.convolve(np.pad(y, half, "edge"), kernel, "valid")
        tops, least = K.local_maxima(s), share * float(s.max() - s.min())
        prom, _ = prominences(s, tops)
        tops = tops[prom >= max(least, 1e-300)]
        cuts = [0, *(int(a + np.argmin(s[a : b + 1])) for a, b in zip(tops[:-1], tops[1:])), len(y) - 1]
        out = []
        for k, i in enumerate(tops):
            t, v = K.window_nodes(x, y, x[cuts[k]], x[cuts[k + 1]])
            net = v - K.chord(t, v)
            out.append((float(x[cuts[k]]), float(x[i]), float(x[cuts[k + 1]]), float(net.max()), K.trapezoid(t, net)))
        return out

    return K.column("array<struct<start:double,apex:double,end:double,height:double,area:double>>", run, x, y)


def peak_at(x: Column, y: Column, t: Column, window: float) -> Column:
    """struct(start, apex, end): a manual peak at the highest smoothed sample within ``window`` of ``t``, bounded by the
    neighbouring minima; null where no sample is so near."""

    def run(x, y, t):
        near = np.flatnonzero(np.abs(x - t) <= window)
        if not len(near):
            return None
        s = K.savgol(y, 5, 2)
        i = int(near[np.argmax(s[near])])
        sigma = K.noise_sigma(y) or 0.0
        return float(x[side(s, i, -1, 0, sigma)]), float(x[i]), float(x[side(s, i, 1, len(s) - 1, sigma)])

    return K.struct({"start": "double", "apex": "double", "end": "double"}, run, x, y, t)


def refined_bounds(x: Column, y: Column, start: Column, end: Column) -> Column:
    """struct(start, end): each bound at the lowest sample within 15 % of the peak's width."""

    def run(x, y, a, b):
        reach = 0.15 * (b - a)
        snap = lambda t: (lambda near: float(x[near[np.argmin(y[near])]]) if len(near) else t)(np.flatnonzero(np.abs(x - t) <= reach))
        return snap(a), snap(b)

    return K.struct({"start": "double", "end": "double"}, run, x, y, start, end)
