"""Clusters of touching peaks and integration modes (valley, drop, baseline, tangent), and interval edits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames
from . import kernels as K

MODES = ("drop", "valley", "baseline", "skim-tangent", "skim-exp", "fit")


def touching_clusters(peaks: DataFrame, gap: Column, by: str = "trace_id") -> DataFrame:
    """Adds cluster (from 1 in order of start): peaks whose start lies within ``gap`` of what the ones before reach."""
    order = Window.partitionBy(by).orderBy("start", "peak_no")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") - reach > gap), 1).otherwise(0)
    (mark,) = frames.unused(peaks, "fresh")
    return peaks.withColumn(mark, fresh).withColumn("cluster", F.sum(mark).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop(mark)


def chord_area(x: Column, y: Column, start: Column, end: Column) -> Column:
    """Mode valley: the area above the peak's own chord."""

    def run(x, y, start, end):
        t, v = K.window_nodes(x, y, start, end)
        return K.trapezoid(t, v - K.chord(t, v))

    return K.column("double", run, x, y, start, end)


def drop_area(x: Column, y: Column, start: Column, end: Column, cluster_start: Column, cluster_end: Column) -> Column:
    """Mode drop: the area between perpendiculars at the peak's bounds, above the chord of its whole cluster."""

    def run(x, y, start, end, a, b):
        t, v = K.window_nodes(x, y, start, end)
        low, high = np.interp([a, b], x, y)
        return K.trapezoid(t, v - (low + (high - low) * (t - a) / (b - a))) if b > a else 0.0

    return K.column("double", run, x, y, start, end, cluster_start, cluster_end)


def hull_area(x: Column, y: Column, start: Column, end: Column, cluster_start: Column, cluster_end: Column) -> Column:
    """Mode baseline: the area above the lower convex hull of the cluster."""

    def run(x, y, start, end, a, b):
        hx, hy = K.lower_hull(*K.window_nodes(x, y, a, b))
        t, v = K.window_nodes(x, y, start, end)
        t = np.union1d(t, hx[(hx > start) & (hx < end)])
        return K.trapezoid(t, np.interp(t, x, y) - np.interp(t, hx, hy))

    return K.column("double", run, x, y, start, end, cluster_start, cluster_end)


def polyline(t: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A polyline at places ``t``, continued by its outer segments; constant with one node."""
    out = np.interp(t, bx, by)
    if len(bx) > 1:
        for side, a, b in ((t < bx[0], 0, 1), (t > bx[-1], -1, -2)):
            if side.any() and bx[a] != bx[b]:
                out[side] = by[a] + (t[side] - bx[a]) * (by[b] - by[a]) / (bx[b] - bx[a])
    return out


def baseline_at(bx: Column, by: Column, t: Column) -> Column:
    """A baseline polyline (ascending nodes) at a place, continued linearly outside; null without nodes."""
    return K.column("double", lambda bx, by, t: float(polyline(np.array([t]), bx, by)[0]) if len(bx) else None, bx, by, t)


def baseline_area(x: Column, y: Column, start: Column, end: Column, bx: Column, by: Column) -> Column:
    """The area above a given baseline polyline, which is continued linearly outside; null without nodes."""

    def run(x, y, start, end, bx, by):
        if not len(bx):
            return None
        inner = bx[(bx > start) & (bx < end)]
        t = np.union1d(K.window_nodes(x, y, start, end)[0], inner)
        return K.trapezoid(t, np.interp(t, x, y) - polyline(t, bx, by))

    return K.column("double", run, x, y, start, end, bx, by)


def tangent_skim(x: Column, y: Column, start: Column, end: Column, valley: Column, apex: Column, limit: Column) -> Column:
    """Mode skim-tangent on a tail: the area of a rider [start, end] above the line from the valley with the least slope
    to a sample between the rider's apex and ``limit``; null without such a sample."""

    def run(x, y, start, end, valley, apex, limit):
        beyond = (x > apex) & (x <= limit)
        if not beyond.any():
            return None
        low = float(np.interp(valley, x, y))
        slope = ((y[beyond] - low) / (x[beyond] - valley)).min()
        t, v = K.window_nodes(x, y, start, end)
        return K.trapezoid(t, v - (low + slope * (t - valley)))

    return K.column("double", run, x, y, start, end, valley, apex, limit)


def recommended_mode(heights_ratio: Column, resolution: Column, peaks: Column, skim_ratio: float = 10.0) -> Column:
    """Which mode suits a cluster: alone valley; a rider skim-tangent; badly resolved fit; else drop."""
    return F.when(peaks < 2, "valley").when(heights_ratio >= skim_ratio, "skim-tangent").when(resolution < 0.8, "fit").otherwise("drop")


def effective_mode(own: Column, manual: Column, default: str = "drop") -> Column:
    return F.coalesce(own, F.when(manual, F.lit("valley")), F.lit(default))


def meets(rows: DataFrame, low: str, high: str, intervals: DataFrame, start: str, end: str, by: str, closed: bool = False, inside: bool = True) -> DataFrame:
    """Rows (with ``inside`` false, those that are not) of which one of the intervals of the same ``by`` reaches into [low, high] (with ``closed``, touching
    is enough). A null ``by`` meets nothing.

    A sweep, not a join: at ``high`` of a row, the intervals that have begun are those before it in order, and the row is
    met if the furthest of their ends lies beyond its ``low``. One sort a ``by``; no pairs are made.
    """
    rank = F.lit(1 if closed else 0)
    at, place, to, own, reach = frames.unused(rows, "at", "place", "to", "own", "reach")
    a = rows.withColumns({at: F.col(high).cast("double"), place: rank, to: F.lit(None).cast("double"), own: F.lit(True)})
    b = intervals.select(F.col(by), F.col(start).cast("double").alias(at), F.lit(0 if closed else 1).alias(place), F.col(end).cast("double").alias(to), F.lit(False).alias(own))
    order = Window.partitionBy(by).orderBy(at, place).rowsBetween(Window.unboundedPreceding, 0)
    swept = a.unionByName(b, allowMissingColumns=True).withColumn(reach, F.max(to).over(order)).filter(F.col(own))
    beyond = F.col(reach) >= F.col(low) if closed else F.col(reach) > F.col(low)
    met = F.coalesce(beyond, F.lit(False)) & F.col(by).isNotNull()
    return swept.filter(met if inside else ~met).select(*rows.columns)


def merge_keep(kept: DataFrame, found: DataFrame, by: str = "trace_id") -> DataFrame:
    """Kept peaks unchanged, and those found that overlap none of them."""
    free = meets(found, "start", "end", kept, "start", "end", by, inside=False)
    return kept.withColumn("manual", F.lit(True)).unionByName(free.withColumn("manual", F.lit(False)))


def clamp_bounds(start: Column, end: Column, low: Column, high: Column, step: Column) -> Column:
    """struct(start, end) in order and within the trace; null if it is narrower than two samples."""
    a, b = F.greatest(low, F.least(start, end)), F.least(high, F.greatest(start, end))
    return F.when(b - a >= 2 * step, F.struct(a.alias("start"), b.alias("end")))


def window_on_all(traces: DataFrame, start: float, end: float, offset: Column | None = None) -> DataFrame:
    """One manual peak [start, end] (shifted back by each trace's offset) on every trace; apex is the highest node
    above its chord, the first of those equally high (both bounds, where all between lies below it). Traces without a sample
    inside are left out."""
    shift = F.lit(0.0) if offset is None else offset
    df = traces.withColumn("start", F.lit(start) - shift).withColumn("end", F.lit(end) - shift)
    df = df.filter(F.exists("x", lambda v: v.between(F.col("start"), F.col("end"))))

    def run(x, y, a, b):
        t, v = K.window_nodes(x, y, a, b)
        net = v - K.chord(t, v)
        return float(t[np.argmax(net)]), K.trapezoid(t, net)

    found = K.struct({"apex": "double", "area": "double"}, run, F.col("x"), F.col("y"), F.col("start"), F.col("end"))
    return df.select("*", F.inline(F.array(found)))
