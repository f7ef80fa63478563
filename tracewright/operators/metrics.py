"""Figures of single peaks and of whole peak lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .integration import polyline
from .peaks import figures


def peak_metrics(peaks: DataFrame, void_time: float | None = None, p2p: str | None = None) -> DataFrame:
    """Adds the figures of each row's peak (columns x, y, start, end) above its chord.

    area (trapezoid with interpolated ends), rt and height (parabolic), fwhm, w10, w5 (null where the signal doesn't
    fall so far on both sides), tailing, asymmetry, plates, plates_usp, k (with a void time), sn (2 height / the column
    ``p2p``). One kernel gives all of them. Peaks without an extent have nulls. Columns of these names are replaced.
    """
    found = K.struct(K.PEAK_FIELDS, figures, F.col("x"), F.col("y"), F.col("start"), F.col("end"))
    out = peaks.select(*[c for c in peaks.columns if c not in K.PEAK_FIELDS], F.inline(F.array(found)))
    if void_time is not None:
        out = out.withColumn("k", F.try_divide(F.col("rt") - void_time, F.lit(void_time)))
    if p2p:
        out = out.withColumn("sn", F.try_divide(2 * F.col("height"), F.col(p2p)))
    return out


def metrics_above(peaks: DataFrame) -> DataFrame:
    """As peak_metrics, above the baseline in effect of each row: the polyline ``bx``, ``by`` where there is one, continued
    linearly, else the peak's chord."""

    def run(x, y, start, end, bx, by):
        if len(bx) == 0 or not end > start or not len(x):
            return figures(x, y, start, end)
        t = np.union1d(K.window_nodes(x, y, start, end)[0], bx[(bx > start) & (bx < end)])
        return K.peak_figures(t, np.interp(t, x, y) - polyline(t, bx, by))

    none = F.array().cast("array<double>")
    args = [F.col("x"), F.col("y"), F.col("start"), F.col("end"), F.coalesce("bx", none), F.coalesce("by", none)]
    return peaks.select(*[c for c in peaks.columns if c not in K.PEAK_FIELDS], F.inline(F.array(K.struct(K.PEAK_FIELDS, run, *args))))


def peak_list_metrics(peaks: DataFrame, by: str = "trace_id") -> DataFrame:
    """Adds area_pct (of the valid peaks' area), resolution to the peak before by rt, and flags of invalid peaks."""
    valid = (F.col("area") > 0) & (F.col("height") > 0)
    before = Window.partitionBy(by).orderBy("rt", "peak_no", "fwhm", "area")
    shift = 1.18 * (F.col("rt") - F.lag("rt").over(before))
    flags = F.array_compact(F.array(F.when(~(F.col("height") > 0), "nonPositiveHeight"), F.when(~(F.col("area") > 0), "nonPositiveArea")))
    return (
        peaks.withColumn("area_pct", F.when(valid, 100 * F.col("area") / F.sum(F.when(valid, F.col("area"))).over(Window.partitionBy(by))))
        .withColumn("resolution", F.try_divide(shift, F.col("fwhm") + F.lag("fwhm").over(before)))
        .withColumn("flags", flags)
    )


#: Figures and how each comes about: (name, expression, what it is computed from).
FORMULAS = [
    ("noise", "1.4826 MAD(dy) / sqrt 2", "differences of the raw signal"), ("p2p", "6 noise", "noise"), ("p2p_range", "max - min of the residuals about a line", "samples in a range"),
    ("threshold", "max(9 noise, range / 10000)", "noise and the processed signal"), ("area", "sum of (h1 + h2) / 2 dx", "the signal above its baseline"), ("gross_area", "sum of (y1 + y2) / 2 dx", "the signal"),
    ("baseline_area", "gross area - area", "the baseline in effect"), ("area_pct", "100 area / sum of the valid areas", "areas of the trace"), ("rt", "vertex of the parabola through the highest sample and its neighbours", "three samples"),
    ("height", "the parabola's value at rt", "three samples"), ("fwhm", "width at height / 2", "crossings"), ("w10", "width at height / 10", "crossings"), ("w5", "width at height / 20", "crossings"),
    ("tailing", "w5 / (2 f), f from the front at 5 % to rt", "crossings"), ("asymmetry", "b / a at height / 10", "crossings"), ("plates", "5.54 (rt / fwhm)^2", "rt, fwhm"), ("plates_usp", "16 (rt / w)^2, w between the tangents", "slopes"),
    ("k", "(rt - t0) / t0", "rt and the void time"), ("resolution", "1.18 (rt2 - rt1) / (fwhm1 + fwhm2)", "neighbouring peaks"), ("sn", "2 height / p2p", "height, p2p"), ("void_volume", "porosity pi (d / 2)^2 L", "the column"),
    ("elution_b", "the program at rt - dwell - void time", "the program"), ("elution_conc", "cA + (cB - cA) B / 100", "elution_b"), ("conc", "the curve solved for the response", "the calibration"),
    ("conc_se", "sqrt(s^2 / (m w) + g' C g) / |slope|", "the calibration"), ("lod", "3.3 s / |slope|", "the calibration"), ("loq", "10 s / |slope|", "the calibration"),
]


def formulas(spark: SparkSession) -> DataFrame:
    """FORMULAS as a table: name, expression, source."""
    return spark.createDataFrame(FORMULAS, "name string, expression string, source string")


def audit_rows(peaks: DataFrame) -> DataFrame:
    """One row for each figure of FORMULAS that a peak has: trace_id, peak_no, name, value, expression, source. Figures that
    are null have no row."""
    known = [(n, e, s) for n, e, s in FORMULAS if n in peaks.columns]
    entries = [F.struct(F.lit(n).alias("name"), F.col(n).cast("double").alias("value"), F.lit(e).alias("expression"), F.lit(s).alias("source")) for n, e, s in known]
    return peaks.select("trace_id", "peak_no", F.inline(F.array(*entries))).filter("value is not null")
