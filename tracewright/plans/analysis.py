"""From traces to peak tables in one plan: smooth, take the baseline away, detect, integrate, measure."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import clusters, image, metrics, peaks
from ..operators import kernels as K
from ..operators import signal as S


@dataclass(frozen=True)
class Processing:
    """How traces are processed. ``lam`` None follows from the number of samples; a window of 0 doesn't smooth."""

    window: int = 11
    order: int = 3
    baseline: bool = True
    lam: float | None = None
    p: float = 0.001
    iterations: int = 10
    threshold: float | None = None
    min_dist: float = 0.05
    min_width: float = 0.01
    shoulders: bool = True
    mode: str = "drop"
    skim_ratio: float = 10.0

    def clamped(self) -> Processing:
        """Within the limits that the operators are made for."""
        keep = lambda v, low, high: min(max(v, low), high)
        window = keep(self.window | 1, 3, 1001) if self.window else 0
        return replace(self, window=window, order=keep(self.order, 0, 10), p=keep(self.p, 1e-6, 0.5), iterations=keep(self.iterations, 1, 100))


#: Curves read from images are neither smoothed nor baseline-corrected unless asked for.
IMAGE = Processing(window=0, baseline=False)


def processed(traces: DataFrame, how: Processing) -> DataFrame:
    """Adds y_raw and, in place of y, the processed signal."""
    how = how.clamped()
    out = traces.withColumn("y_raw", F.col("y"))
    if how.window:
        out = out.withColumn("y", S.savgol(F.col("y"), how.window, how.order))
    if how.baseline:
        b = S.als_baseline(F.col("y"), how.lam, how.p, how.iterations)
        out = out.withColumn("y", F.zip_with("y", b, lambda v, w: v - w))
    return out


ANALYSED = {"peak_no": "int", "cluster": "int", "cluster_size": "int", "mode": "string", "host": "int", "start": "double", "apex": "double", "end": "double", "shoulder": "boolean", "p2p": "double", "gross_area": "double", "baseline_area": "double"} | K.PEAK_FIELDS


def analysed(x: Column, y: Column, how: Processing = Processing()) -> Column:
    """All peaks of a raw trace (an array of struct ANALYSED): processed, detected, integrated and measured by one kernel.
    ``area`` is that of the mode in effect."""
    how = how.clamped()

    def batch(rows):
        raw = [y for _, y in rows]
        done = [K.savgol(y, how.window, how.order) for y in raw] if how.window else raw
        if how.baseline:  # those of one length at once
            done = [y - z for y, z in zip(done, K.als_baselines(done, how.lam or None, how.p, how.iterations))]
        return [run(x, y, K.noise_sigma(before) or 0.0) for (x, before), y in zip(rows, done)]

    def run(x, y, sigma):
        if not len(y):
            return []
        level = how.threshold if how.threshold is not None else max(9 * sigma, 1e-4 * float(y.max() - y.min()))
        found = peaks.detect(x, y, level, how.min_dist, how.min_width, how.shoulders)
        results = clusters.integrate(x, y, [p[:3] for p in found], how.mode, how.skim_ratio)
        out = []
        for (start, apex, end, _, shoulder), got in zip(found, results):
            _, *rest = peaks.figures(x, y, start, end)
            out.append((got["peak_no"], got["cluster"], got["cluster_size"], got["mode"], got["host"], start, apex, end, shoulder, 6 * sigma, got["gross"], got["baseline"], got["area"], *rest))
        return out

    kind = "array<struct<" + ",".join(f"{n}:{t}" for n, t in ANALYSED.items()) + ">>"
    return K.column_of_batches(kind, batch, x, y)


def peak_table(traces: DataFrame, how: Processing = Processing()) -> DataFrame:
    """One row for each peak: its bounds, its area by the mode in effect and its figures.

    The threshold is nine times the noise of the raw signal, which smoothing doesn't lower, unless one is given; the same
    noise gives sn. Traces stay where they are; the only shuffle is that of the peak rows for shares and resolutions.
    """
    rows = traces.select("trace_id", F.inline(analysed(F.col("x"), F.col("y"), how)))
    rows = rows.withColumn("sn", F.try_divide(2 * F.col("height"), F.col("p2p"))).drop("p2p")
    return metrics.peak_list_metrics(rows)


def image_peak_table(images: DataFrame, axes: Column, rgb: tuple[int, int, int], how: Processing = IMAGE, **options) -> DataFrame:
    """The peaks of curves in images (trace_id, content, width, height; ``axes`` as for image.digitized): read from the
    pixels, then as peak_table, by default without smoothing and baseline. Images without the curve have no peaks."""
    curve = image.digitized(F.col("content"), F.col("width"), F.col("height"), axes, rgb, **options)
    traces = images.select("trace_id", curve.alias("c")).filter("c.x is not null").select("trace_id", "c.x", "c.y")
    return peak_table(traces, how)
