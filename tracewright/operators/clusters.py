"""Integration of clusters of peaks: which peaks belong together, who rides on whom, and the area of each by its mode."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fitting
from . import kernels as K
from .integration import MODES

RESULT = "array<struct<peak_no:int,mode:string,cluster:int,cluster_size:int,gross:double,baseline:double,area:double,host:int,note:string>>"


def group(x: np.ndarray, y: np.ndarray, peaks: list[tuple], valley_share: float = 0.02, gap_steps: float = 1.5) -> list[list[int]]:
    """Indices of peaks (start, apex, end) in clusters, by apex. Neighbours belong together if they overlap, or if the
    gap is small (``gap_steps`` samples, or half the narrower peak) and the valley between them stays above the chord of
    both by more than ``valley_share`` of the smaller peak."""
    order = sorted(range(len(peaks)), key=lambda k: peaks[k][1])
    step = (x[-1] - x[0]) / max(len(x) - 1, 1)
    out: list[list[int]] = []
    for k in order:
        if out and _fused(x, y, peaks[out[-1][-1]], peaks[k], step, valley_share, gap_steps):
            out[-1].append(k)
        else:
            out.append([k])
    return out


def _fused(x, y, a, b, step, valley_share, gap_steps) -> bool:
    gap = b[0] - a[2]
    if gap < -1e-12:
        return True
    if gap > max(gap_steps * step, min(a[2] - a[0], b[2] - b[0]) / 2):
        return False
    low, high = np.interp([a[0], b[2]], x, y)
    line = lambda t: low + (high - low) * (t - a[0]) / (b[2] - a[0]) if b[2] > a[0] else low
    inside = (x >= a[1]) & (x <= b[1])
    if not inside.any():
        return True
    k = int(np.argmin(np.where(inside, y, np.inf)))
    heights = [np.interp(p[1], x, y) - line(p[1]) for p in (a, b)]
    return y[k] - line(x[k]) > valley_share * min(heights)


def hosts(heights: list[float], own: list[float], ratio: float, sigma: float) -> list[int | None]:
    """For each peak of a cluster (by apex) the peak that it rides on: the nearest by place in the list that is at least
    ``ratio`` times as high as it stands above its own chord, the taller of two; chains end at their root."""
    out: list[int | None] = []
    for k, h in enumerate(own):
        able = [j for j in range(len(heights)) if j != k and h > 3 * sigma and heights[j] >= ratio * h and heights[j] > heights[k]]
        out.append(min(able, key=lambda j: (abs(j - k), -heights[j])) if able else None)
    for k in range(len(out)):
        while out[k] is not None and out[out[k]] is not None:
            out[k] = out[out[k]]
    return out


def _exponential_skim(t, v, line, rider, host, valley, limit, sigma, host_height):
    """offset + z0 exp(-(t - valley) / tau) through the host's flank beside a rider; None if it doesn't decay."""
    way = 1 if rider[1] > host[1] else -1
    width = abs(rider[1] - valley) / 2.5
    edge = rider[1] - way * 4 * width
    start = min(valley, edge) if way > 0 else max(valley, edge)
    reach = (t - start) * -way
    z = v - line(t)
    good = (reach >= 0) & (reach <= 16 * width) & (z > max(3 * sigma, 1e-3 * host_height)) & (z <= 0.5 * host_height)
    if good.sum() < 4:
        return None
    s, lz, w = (t[good] - valley) * way, np.log(z[good]), z[good] ** 2
    ms, ml = np.average(s, weights=w), np.average(lz, weights=w)
    spread = np.average((s - ms) ** 2, weights=w)
    slope = np.average((s - ms) * (lz - ml), weights=w) / spread if spread > 0 else 0.0
    if slope >= 0:
        return None
    tau, z0, offset = -1 / slope, math.exp(ml - slope * ms), 0.0
    if good.sum() >= 8:

        def solve(tau):
            e = np.exp(-s / tau)
            a = np.stack([e, np.ones_like(e)], axis=1)
            p, *_ = np.linalg.lstsq(a, z[good], rcond=None)
            return p, float(((a @ p - z[good]) ** 2).sum())

        lo, hi, gold = math.log(tau / 5), math.log(5 * tau), (math.sqrt(5) - 1) / 2
        for _ in range(60):
            a, b = hi - gold * (hi - lo), lo + gold * (hi - lo)
            lo, hi = (lo, b) if solve(math.exp(a))[1] < solve(math.exp(b))[1] else (a, hi)
        (z1, c1), _ = solve(math.exp((lo + hi) / 2))
        if z1 > 0:
            tau, z0, offset = math.exp((lo + hi) / 2), float(z1), float(c1)
    return lambda at: line(at) + offset + z0 * np.exp(-(at - valley) * way / tau)


def _fitted_piece(shape: dict, line) -> tuple:
    """A fitted peak's curve above its cluster's chord, as far as it counts."""
    mu, s, tau = shape["mu"], shape["sigma"], shape["tau"] or 0.0
    t = np.linspace(mu - 8 * s, mu + 8 * s + 20 * tau, 4001)
    curve = K.emg(t, shape["height"], mu, s, tau) if tau else K.gaussian(t, shape["height"], mu, s)
    return t, line(t) + curve, line(t)


def thinned_piece(piece: tuple, most: int | None) -> tuple:
    """A piece of about ``most`` places: of each bucket the ends and the extremes of the upper line."""
    t, upper, _ = piece
    if not most or len(t) <= most:
        return piece
    edges = np.linspace(0, len(t), max(most // 4, 1) + 1).astype(int)
    keep = {0, len(t) - 1}
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            keep |= {a, b - 1, a + int(np.argmin(upper[a:b])), a + int(np.argmax(upper[a:b]))}
    at = sorted(keep)
    return tuple(v[at] for v in piece)


class Clustered:
    """A trace's peaks (start, apex, end) in clusters, with what all modes need of them: noise, a lightly smoothed signal,
    heights above the cluster's chord and above each peak's own."""

    def __init__(self, x: np.ndarray, y: np.ndarray, peaks: list[tuple], manual: list[bool] | None = None):
        self.x, self.y = x, y
        self.sigma = K.noise_sigma(y) or 0.0
        self.smooth = K.savgol(y, 5, 2)
        self.clusters = group(x, self.smooth, peaks)
        self.peaks = self._joined(list(peaks), manual or [False] * len(peaks))

    def _joined(self, peaks: list[tuple], manual: list[bool]) -> list[tuple]:
        """Gaps between neighbours of a cluster are closed at the lowest smoothed sample within, unless one is manual."""
        for members in self.clusters:
            for a, b in zip(members[:-1], members[1:]):
                low, high = peaks[a][2], peaks[b][0]
                if low < high and not manual[a] and not manual[b]:
                    t, v = K.window_nodes(self.x, self.smooth, low, high)
                    at = float(t[np.argmin(v)])
                    peaks[a], peaks[b] = (*peaks[a][:2], at), (at, *peaks[b][1:])
        return peaks

    def line(self, members: list[int]):
        """The chord of a cluster through the signal at its ends."""
        a, b = min(self.peaks[k][0] for k in members), max(self.peaks[k][2] for k in members)
        low, high = np.interp([a, b], self.x, self.y)
        return a, b, lambda t: low + (high - low) * (t - a) / (b - a) if b > a else np.full_like(t, low)

    def heights(self, members: list[int], line) -> tuple[list[float], list[float]]:
        """How high each peak stands above the cluster's chord, and above its own."""
        top, own = [], []
        for k in members:
            start, apex, end = self.peaks[k]
            at = np.array([apex])
            top.append(max(float((np.interp(at, self.x, self.smooth) - line(at))[0]), 0.0))
            t, v = K.window_nodes(self.x, self.smooth, start, end)
            own.append(float((v - K.chord(t, v)).max()))
        return top, own

    def recommended(self, members: list[int], skim_ratio: float) -> str:
        """Alone valley; with a rider skim-tangent; with a valley above half of the smaller neighbour fit; else drop."""
        if len(members) < 2:
            return "valley"
        _, _, line = self.line(members)
        top, own = self.heights(members, line)
        if any(h is not None for h in hosts(top, own, skim_ratio, self.sigma)):
            return "skim-tangent"
        for i, (a, b) in enumerate(zip(members[:-1], members[1:])):
            t, v = K.window_nodes(self.x, self.smooth, self.peaks[a][1], self.peaks[b][1])
            if (v - line(t)).min() > 0.5 * min(top[i], top[i + 1]):
                return "fit"
        return "drop"

    def areas(self, mode: str, skim_ratio: float = 10.0, model: str = "emg", pieces: dict[int, list[tuple]] | None = None) -> list[dict]:
        """A result for each peak, in the order given; see integrate(). ``pieces`` gets, for each peak, what its area lies between:
        (places, upper, lower) of its own extent, and of what it keeps under its riders; a fitted peak's upper is its curve."""
        if mode not in MODES:
            raise ValueError(mode)
        pieces = {} if pieces is None else pieces
        x, y, smooth, peaks = self.x, self.y, self.smooth, self.peaks
        out: list[dict] = [{} for _ in peaks]
        for number, members in enumerate(self.clusters, 1):
            a, b, line = self.line(members)
            note = {k: "" for k in members}
            skim, host, areas, shapes = {}, {k: None for k in members}, {}, {}
            if mode.startswith("skim") and len(members) > 1:
                top, own = self.heights(members, line)
                for i, j in enumerate(hosts(top, own, skim_ratio, self.sigma)):
                    if j is not None:
                        k, h = members[i], members[j]
                        curve, note[k] = self._skim(mode, peaks[k], peaks[h], line, top[j])
                        if curve is not None:
                            skim[k], host[k] = curve, h
            elif mode == "fit":
                try:
                    inside = (x >= a) & (x <= b)
                    found = fitting.fit(x[inside], y[inside] - line(x[inside]), [peaks[k][1] for k in members], model)
                    areas, shapes = {k: f["area"] for k, f in zip(members, found)}, dict(zip(members, found))
                except (ValueError, np.linalg.LinAlgError):
                    note = {k: "no fit: drop" for k in members}
            hull = K.lower_hull(*K.window_nodes(x, y, a, b)) if mode == "baseline" and b > a else None
            for k in members:
                start, _, end = peaks[k]
                entry = {"peak_no": k + 1, "mode": mode, "cluster": number, "cluster_size": len(members), "host": None if host[k] is None else host[k] + 1, "note": note[k]}
                if not end > start:
                    out[k] = entry | {"gross": None, "baseline": None, "area": None, "note": "invalid bounds"}
                    continue
                t, v = K.window_nodes(x, y, start, end)
                if mode == "valley":
                    base = K.chord(t, v)
                elif hull is not None:
                    t = np.union1d(t, hull[0][(hull[0] > start) & (hull[0] < end)])
                    v, base = np.interp(t, x, y), np.interp(t, *hull)
                else:
                    base = np.maximum(skim[k](t), line(t)) if k in skim else line(t)
                gross, under = K.trapezoid(t, v), K.trapezoid(t, base)
                pieces[k] = [_fitted_piece(shapes[k], line)] if k in shapes else [(t, v, base)]
                for r in skim if k not in skim else ():
                    if host[r] == k:  # the parent keeps what lies between the skim and the line under its riders
                        u, _ = K.window_nodes(x, y, peaks[r][0], peaks[r][2])
                        gross += K.trapezoid(u, np.maximum(skim[r](u), line(u)))
                        under += K.trapezoid(u, line(u))
                        pieces[k].append((u, np.maximum(skim[r](u), line(u)), line(u)))
                area = gross - under
                if k in areas:
                    area, gross = areas[k], under + areas[k]
                out[k] = entry | {"gross": gross, "baseline": under, "area": area}
        return out

    def _skim(self, mode: str, rider: tuple, host: tuple, line, host_height: float):
        """(the curve under a rider, a note); no curve where nothing lies beyond the rider's apex."""
        x, smooth = self.x, self.smooth
        tail = rider[1] > host[1]
        valley, limit = (rider[0], rider[2]) if tail else (rider[2], rider[0])
        note = ""
        if mode == "skim-exp":
            curve = _exponential_skim(x, self.y, line, rider, host, valley, limit, self.sigma, host_height)
            if curve:
                return curve, ""
            note = "no decay: tangent"
        beyond = (x > rider[1]) & (x <= limit) if tail else (x < rider[1]) & (x >= limit)
        if not beyond.any():
            return None, note
        at = float(np.interp(valley, x, smooth))
        slopes = (smooth[beyond] - at) / (x[beyond] - valley)
        slope = slopes.min() if tail else slopes.max()
        return (lambda t: at + slope * (t - valley)), note


def integrate(x: np.ndarray, y: np.ndarray, peaks: list[tuple], mode: str = "drop", skim_ratio: float = 10.0, model: str = "emg", manual: list[bool] | None = None) -> list[dict]:
    """A result for each peak (start, apex, end), in the order given; ``mode`` is one of MODES for all of them.

    valley: own chord. drop: the chord of the cluster. baseline: its lower hull. skim-tangent, skim-exp: a rider above a
    tangent or exponential of its host's flank, whose area takes the skim for the signal there, so that parent and riders
    together are what drop gives; peaks that ride on none are dropped. fit: areas of a joint fit above the chord. Gaps
    between peaks of a cluster are closed first, save at ``manual`` ones.
    """
    return Clustered(x, y, peaks, manual).areas(mode, skim_ratio, model)


def _tuples(peaks) -> list[tuple]:
    return [(p["start"], p["apex"], p["end"]) for p in peaks]


def integrated(x: Column, y: Column, peaks: Column, mode: str = "drop", skim_ratio: float = 10.0, model: str = "emg") -> Column:
    """Results of all peaks (array of struct with start, apex, end) of a trace as RESULT."""

    def run(x, y, peaks):
        return integrate(x, y, _tuples(peaks), mode, skim_ratio, model, [bool(p.get("manual")) for p in peaks]) if len(x) else []

    return K.column(RESULT, run, x, y, peaks)


def options(traces: DataFrame, modes: tuple[str, ...] = MODES, skim_ratio: float = 10.0) -> DataFrame:
    """Areas of every peak (column ``peaks``) by each of ``modes``, side by side, and the mode recommended for its cluster:
    trace_id, peak_no, cluster, cluster_size, recommended, one column for each mode. One kernel for all modes of a trace;
    only figures leave it."""

    def run(x, y, peaks):
        if not len(x) or not peaks:
            return []
        c = Clustered(x, y, _tuples(peaks), [bool(p.get("manual")) for p in peaks])
        best = {k: (n, len(members), word) for n, members in enumerate(c.clusters, 1) for word in [c.recommended(members, skim_ratio)] for k in members}
        by_mode = [[r["area"] for r in c.areas(m, skim_ratio)] for m in modes]
        return [(k + 1, *best[k], *(areas[k] for areas in by_mode)) for k in range(len(peaks))]

    names = [m.replace("-", "_") for m in modes]
    kind = "array<struct<peak_no:int,cluster:int,cluster_size:int,recommended:string," + ",".join(f"{n}:double" for n in names) + ">>"
    return traces.select("trace_id", F.inline(K.column(kind, run, F.col("x"), F.col("y"), F.col("peaks"))))


def mode_frames(traces: DataFrame, modes: tuple[str, ...] = MODES, skim_ratio: float = 10.0, most: int | None = None) -> DataFrame:
    """What charts of each mode show: trace_id, mode, peak_no, cluster, area, piece (from 0), and arrays x, upper, lower. The areas between upper
    and lower of a peak's pieces add up to ``area`` (null where the peak has no extent, which has no pieces). A mode that falls back
    on another shows that one's lines. ``most``: about so many places a piece, extremes kept; areas are then those of the thinned lines
    only roughly."""

    def run(x, y, peaks):
        if not len(x) or not peaks:
            return []
        c = Clustered(x, y, _tuples(peaks), [bool(p.get("manual")) for p in peaks])
        out = []
        for mode in modes:
            pieces: dict[int, list[tuple]] = {}
            results = c.areas(mode, skim_ratio, pieces=pieces)
            for k, r in enumerate(results):
                for no, piece in enumerate(pieces.get(k, [])):
                    out.append((mode, k + 1, r["cluster"], r["area"], no, *thinned_piece(piece, most)))
        return out

    kind = "array<struct<mode:string,peak_no:int,cluster:int,area:double,piece:int,x:array<double>,upper:array<double>,lower:array<double>>>"
    return traces.select("trace_id", F.inline(K.column(kind, run, F.col("x"), F.col("y"), F.col("peaks"))))


def similar_clusters(options: DataFrame, cluster: Column) -> DataFrame:
    """Clusters of ``options`` for which the same mode is recommended as for the one that ``cluster`` picks out:
    trace_id, cluster, recommended; those of one peak are left out."""
    each = options.filter("cluster_size > 1").select("trace_id", "cluster", "recommended", cluster.alias("_own")).distinct()
    wanted = each.filter("_own").select("recommended").distinct()  # at most as many rows as there are modes
    return each.join(F.broadcast(wanted), "recommended", "left_semi").select("trace_id", "cluster", "recommended")
