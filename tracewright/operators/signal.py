"""Smoothing, noise, resampling and normalisation of traces, as Columns over ``x`` and ``y`` arrays.

Missing results are null, never NaN; a null array gives null. Traces are never shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames
from . import kernels as K

ARRAY = "array<double>"


def savgol(y: Column, window: int = 5, order: int = 2, deriv: int = 0, delta: float = 1.0) -> Column:
    """Savitzky-Golay smoothing or derivative; shorter traces take the largest odd window that fits; below 3 samples a
    copy, or zeros for a derivative."""
    return K.column(ARRAY, lambda v: K.savgol(v, window, order, deriv, delta), y)


def als_baseline(y: Column, lam: float | None = None, p: float = 0.001, iterations: int = 10) -> Column:
    """Asymmetric least squares baseline; ``lam`` None follows from the number of samples."""
    return K.column_of_batches(ARRAY, lambda rows: K.als_baselines([v for (v,) in rows], lam or None, p, iterations), y)


def processed(y: Column, window: int = 11, order: int = 3, lam: float | None = None, p: float = 0.001) -> Column:
    """Smoothed, then without its baseline."""

    def run(v):
        s = K.savgol(v, window, order)
        return s - K.als_baseline(s, lam or K.auto_lambda(len(s)), p)

    return K.column(ARRAY, run, y)


def median(a: Column) -> Column:
    """The middle of the finite values; of an even number, the mean of both middle ones. Null if there are none."""

    def run(v):
        v = np.asarray(v, float)
        v = v[np.isfinite(v)]
        return float(np.median(v)) if len(v) else None

    return K.column("double", run, a)


def quantum(y: Column) -> Column:
    """The step of a digitised signal: where at least a fifth of the differences are zero, the tenth percentile of the
    others' sizes; else null."""
    return K.column("double", K.quantum, y)


def noise_sigma(y: Column, floor: bool = True) -> Column:
    """Noise from the robust spread of differences; where that is zero, from their root mean square. With ``floor``, at
    least what the signal's step explains. Below 3 samples: null."""
    return K.column("double", lambda v: K.noise_sigma(v, floor), y)


def noise_in_range(x: Column, y: Column, start: float, end: float) -> Column:
    """struct(sigma, p2p) of the residuals about a straight line within [start, end]; null below 4 samples."""

    def run(t, v):
        inside = (t >= start) & (t <= end)
        t, v = t[inside], v[inside]
        if len(t) < 4:
            return None
        dt = t - t.mean()
        rest = v - v.mean() - (dt @ (v - v.mean())) / (dt @ dt) * dt
        return float(np.sqrt(rest @ rest / (len(t) - 2))), float(rest.max() - rest.min())

    return K.struct({"sigma": "double", "p2p": "double"}, run, x, y)


def trapezoid(x: Column, y: Column) -> Column:
    """The signed area under a trace; 0 below two samples, null where a sample is missing or not finite."""
    pairs = F.zip_with(F.zip_with(F.slice(x, 2, F.greatest(F.size(x) - 1, F.lit(0))), x, lambda b, a: b - a), F.zip_with(F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0))), y, lambda b, a: (b + a) / 2), lambda dx, h: dx * h)
    inner = F.slice(pairs, 1, F.greatest(F.size(x) - 1, F.lit(0)))  # the last pair of the longer list has no partner
    total = F.aggregate(inner, F.lit(0.0), lambda s, v: s + v)
    return F.when(F.isnan(total), None).otherwise(total)


def interpolate(x: Column, y: Column, at: Column) -> Column:
    """Linear interpolation at one place; clamped outside."""
    return K.column("double", lambda t, v, a: float(np.interp(a, t, v)) if len(t) else None, x, y, at)


def linspace(start: Column, end: Column, n: int) -> Column:
    """An inclusive grid of ``n`` places."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (end - start) * i / max(n - 1, 1))


def resample(x: Column, y: Column, n: int) -> Column:
    """``y`` on an even grid of ``n`` places from the first to the last x."""
    return K.column(ARRAY, lambda t, v: np.interp(np.linspace(t[0], t[-1], n), t, v) if len(t) else None, x, y)


def normalize(x: Column, y: Column, mode: str, absolute: bool = False) -> Column:
    """``y`` / its maximum or area ("max", "area"; "none" keeps it); kept where that isn't positive. ``absolute`` takes
    the signal's size, as for display."""
    if mode == "none":
        return y
    w = F.transform(y, lambda v: F.abs(v)) if absolute else y
    size = {"max": F.array_max, "area": lambda v: trapezoid(x, v)}[mode](w)
    return F.when(size > 0, F.transform(y, lambda v: v / size)).otherwise(y)


def align(x: Column, shift: Column) -> Column:
    return F.transform(x, lambda v: v + shift)


def to_minutes(x: Column, flow: Column) -> Column:
    """Volumes as minutes where the flow is positive; else null."""
    return F.when(flow > 0, F.transform(x, lambda v: v / flow))


def volumes_to_minutes(traces: DataFrame, flow: Column) -> DataFrame:
    """Traces whose x_unit is mL with x (and offset, and the places of peaks, where there are such columns) over the flow
    and the unit min; others, and those without a positive flow, stay."""
    use = (F.lower("x_unit") == "ml") & (flow > 0)
    out = traces.withColumn("x", F.when(use, F.transform("x", lambda v: v / flow)).otherwise(F.col("x")))
    if "offset" in traces.columns:
        out = out.withColumn("offset", F.when(use, F.col("offset") / flow).otherwise(F.col("offset")))
    if "peaks" in traces.columns:
        names = traces.schema["peaks"].dataType.elementType.names
        scaled = F.transform("peaks", lambda p: F.struct(*[(p[n] / flow if n in ("start", "apex", "end") else p[n]).alias(n) for n in names]))
        out = out.withColumn("peaks", F.when(use, scaled).otherwise(F.col("peaks")))
    return out.withColumn("x_unit", F.when(use, "min").otherwise(F.col("x_unit")))


def derived_difference(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Derived traces a - b of raw signals, for pairs of rows with equal ``on`` and the same x_unit: a's columns, its name
    extended by b's, y the difference (null outside b) and derived true."""
    (other,) = frames.unused(a, "other")
    both = a.join(b.select(*on, F.struct("x", "y", "x_unit", "name").alias(other)), on).filter(F.col("x_unit").eqNullSafe(F.col(f"{other}.x_unit")))
    y = difference(F.col("x"), F.col("y"), F.col(f"{other}.x"), F.col(f"{other}.y"))
    return both.withColumns({"y": y, "name": F.concat_ws(" - ", "name", f"{other}.name"), "derived": F.lit(True)}).drop(other)


def difference(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """a - b at a's places; null outside b's range, whose ends belong to it."""
    return K.column(ARRAY, lambda t, v, u, w: v - np.interp(t, u, w, left=np.nan, right=np.nan), ax, ay, bx, by)


def local_maxima(y: Column) -> Column:
    """Places of local maxima: a rise, a plateau perhaps, a fall. A plateau counts by its middle (left of two)."""
    return K.column("array<int>", K.local_maxima, y)


def gap_filled(y: Column, most: int) -> Column:
    """Nulls inside a trace, in runs of ``most`` at most, filled linearly; longer runs and those at the ends stay."""

    def run(v):
        v = np.array([np.nan if a is None else a for a in v], float)
        known = np.flatnonzero(~np.isnan(v))
        out = v.copy()
        for a, b in zip(known[:-1], known[1:]):
            if 1 < b - a <= most + 1:
                out[a + 1 : b] = v[a] + (v[b] - v[a]) * np.arange(1, b - a) / (b - a)
        return out

    return K.column(ARRAY, run, y)


def parabolic_apex(x: Column, y: Column) -> Column:
    """struct(rt, height) of the highest sample, refined by a parabola; see the kernel."""
    return K.struct({"rt": "double", "height": "double"}, lambda t, v: K.parabolic_apex(t, v)[:2] if len(t) else None, x, y)


def pack_uniform(x: Column, tolerance: float = 1e-4) -> Column:
    """struct(x0, dx, n) of an even grid; null if a place is off by more than ``tolerance`` steps."""
    first, last, n = F.element_at(x, 1), F.element_at(x, -1), F.size(x)

    def off(t):
        return float(np.abs(t - np.linspace(t[0], t[-1], len(t))).max()) if len(t) else None

    dx = (last - first) / (n - 1)
    return F.when((n >= 3) & (dx > 0) & (K.column("double", off, x) <= tolerance * dx), F.struct(first.alias("x0"), dx.alias("dx"), n.alias("n")))


def unpack_uniform(p: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), p["n"] - 1), lambda i: p["x0"] + p["dx"] * i)


def pack_delta(y: Column) -> Column:
    """struct(e, d): integer differences in units of 10^e, e five digits below the largest value's first."""

    def run(v):
        big = np.abs(v).max(initial=0)
        e = int(np.floor(np.log10(big))) - 5 if big > 0 else 0
        return e, np.diff(np.round(v / 10.0**e).astype(np.int64), prepend=0)

    return K.struct({"e": "int", "d": "array<bigint>"}, run, y)


def unpack_delta(p: Column) -> Column:
    return K.column(ARRAY, lambda e, d: np.cumsum(d) * 10.0**e, p["e"], p["d"])
