"""Tables behind figures and reports: what a chart or a report shows, as rows and texts; nothing is drawn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames, tables


def display_series(traces: DataFrame, mode: str = "none", stack: float = 0.0) -> DataFrame:
    """trace_id, place, x, y as a waterfall shows them: signals over their largest size or area (``mode`` "max", "area"),
    x later by the trace's ``offset`` (a null or missing one is 0), each trace ``stack`` times the largest signal above
    the one before (traces in order of trace_id). Roles other than signal keep their size."""
    from . import signal as S

    t = traces if "offset" in traces.columns else traces.withColumn("offset", F.lit(0.0))
    y = F.col("y") if mode == "none" else S.normalize(F.col("x"), F.col("y"), mode, absolute=True)
    if "role" in t.columns:
        y = F.when(F.coalesce("role", F.lit("signal")) == "signal", y).otherwise(F.col("y"))
    shift = F.coalesce("offset", F.lit(0.0))
    t = t.select("trace_id", F.transform("x", lambda v: v + shift).alias("x"), y.alias("y"))
    if not stack:
        return t.withColumn("place", F.lit(0).cast("long")).select("trace_id", "place", "x", "y")
    top = t.agg(F.max(F.array_max(F.transform("y", lambda v: F.abs(v)))).alias("top"))  # one row
    rows = tables.numbered(t, "trace_id").crossJoin(F.broadcast(top))
    lift = F.col("place") * stack * F.coalesce("top", F.lit(0.0))
    return rows.select("trace_id", "place", "x", F.transform("y", lambda v: v + lift).alias("y"))


def shading(traces: DataFrame, peaks: DataFrame) -> DataFrame:
    """trace_id, peak_no, x, upper, lower of the filled area of each peak (trace_id, peak_no, start, end) above its chord:
    the samples inside and both bounds. Peaks are gathered by trace, and each trace is read once."""
    from . import kernels as K

    def run(x, y, rows):
        out = []
        for p in rows:
            if p["end"] > p["start"] and len(x):
                t, v = K.window_nodes(x, y, p["start"], p["end"])
                out.append((p["peak_no"], t, v, K.chord(t, v)))
        return out

    lists = peaks.groupBy("trace_id").agg(F.collect_list(F.struct("peak_no", "start", "end")).alias("peaks"))
    kind = "array<struct<peak_no:int,x:array<double>,upper:array<double>,lower:array<double>>>"
    both = traces.select("trace_id", "x", "y").join(lists, "trace_id")
    return both.select("trace_id", F.inline(K.column(kind, run, F.col("x"), F.col("y"), F.col("peaks"))))


def event_rows(traces: DataFrame) -> DataFrame:
    """trace_id, curve, x and label of the events that traces have (column ``events``), moved by the trace's ``offset``."""
    shift = F.coalesce("offset", F.lit(0.0)) if "offset" in traces.columns else F.lit(0.0)
    each = traces.select("trace_id", shift.alias("shift"), F.inline("events"))
    return each.select("trace_id", "curve", (F.col("x") + F.col("shift")).alias("x"), "label")


def main_unit(traces: DataFrame) -> DataFrame:
    """One row, x_unit: the unit that most visible signals have, minutes before others where they are equally many."""
    shown = tables.visible_signals(traces).groupBy("x_unit").agg(F.count("*").alias("n"))
    return shown.agg(F.max_by("x_unit", F.struct("n", (F.col("x_unit") == "min").cast("int"), "x_unit")).alias("x_unit"))


def label_rows(peaks: DataFrame, least: float) -> DataFrame:
    """Peaks (trace_id, rt, height, label) whose labels fit: of those nearer than ``least`` to a higher one of the same trace
    none is kept, by cells of that width and their neighbours."""
    cell = F.floor(F.col("rt") / least)
    place, rank, before, after = frames.unused(peaks, "cell", "rank", "before", "after")
    best = peaks.filter("rt is not null").withColumn(place, cell)
    top = Window.partitionBy("trace_id", place).orderBy(F.desc("height"), "rt")
    best = best.withColumn(rank, F.row_number().over(top)).filter(F.col(rank) == 1)
    row = Window.partitionBy("trace_id").orderBy(place)
    for way in (F.lag, F.lead):
        other = way(F.struct("rt", "height")).over(row)
        name = before if way is F.lag else after
        best = best.withColumn(name, other)
    beaten = lambda c: (F.abs(F.col(f"{c}.rt") - F.col("rt")) < least) & (F.col(f"{c}.height") > F.col("height"))
    lost = F.coalesce(beaten(before), F.lit(False)) | F.coalesce(beaten(after), F.lit(False))
    return best.filter(~lost).drop(place, rank, before, after)


def peaks_for_display(traces: DataFrame, peaks: DataFrame) -> DataFrame:
    """trace_id, trace_name and the list of its peaks (by rt) of each visible signal; an empty list without peaks."""
    lists = peaks.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("rt", "peak_no", "area", "area_pct"))).alias("peaks"))
    none = F.array().cast("array<struct<rt:double,peak_no:int,area:double,area_pct:double>>")
    shown = tables.visible_signals(traces).select("trace_id", "trace_name")
    return shown.join(lists, "trace_id", "left").withColumn("peaks", F.coalesce("peaks", none))


def table_columns(peaks: DataFrame, calibrated: bool = False, void_time: bool = False, fitted: bool = False, printed: bool = False) -> DataFrame:
    """A peak table without the columns that say nothing: concentrations without a calibration, k without a void time, fit and
    printed columns where there are none."""
    hidden = set()
    for shown, names in ((calibrated, ("analyte", "conc", "conc_lo", "conc_hi", "conc_flags")), (void_time, ("k",)), (fitted, ("mu", "sigma", "tau", "fit_height", "fit_area", "fit_area_se")), (printed, ("printed_rt", "printed_pct", "delta", "within"))):
        hidden |= set() if shown else set(names)
    return peaks.select(*[c for c in peaks.columns if c not in hidden])


def processing_text(window: Column, order: Column, lam: Column, p: Column) -> Column:
    """How a trace was processed, in words; a null window or lambda means that step was off."""
    smooth = F.when(window.isNull(), "no smoothing").otherwise(F.format_string("Savitzky-Golay %d/%d", window.cast("int"), order.cast("int")))
    base = F.when(lam.isNull(), "no baseline").otherwise(F.format_string("asymmetric least squares, lambda %.3g, p %.3g", lam.cast("double"), p.cast("double")))
    return F.concat_ws("; ", smooth, base)


def equation_text(b0: Column, b1: Column, b2: Column) -> Column:
    """A calibration curve in words: y = b0 + b1 x + b2 x^2, without terms that are 0 or null."""
    part = lambda v, tail: F.when(F.coalesce(v, F.lit(0.0)) != 0, F.concat(F.when(v < 0, " - ").otherwise(" + "), F.format_string("%.5g", F.abs(v)), F.lit(tail)))
    body = F.concat_ws("", part(b0, ""), part(b1, " x"), part(b2, " x^2"))
    body = F.regexp_replace(F.regexp_replace(body, r"^ \+ ", ""), "^ - ", "-")
    return F.concat(F.lit("y = "), F.when(body == "", "0").otherwise(body))


def integration_text(mode: Column, cluster_size: Column, host: Column, note: Column) -> Column:
    """How a peak was integrated, in words."""
    return F.concat_ws(
        "; ", mode, F.when(cluster_size > 1, F.format_string("one of %d", cluster_size)), F.when(host.isNotNull(), F.format_string("rides on peak %d", host)), F.nullif(note, F.lit(""))
    )


def calibration_figure(points: DataFrame, fits: DataFrame, n: int = 50, t: float = 1.96, by: str = "analyte") -> tuple[DataFrame, DataFrame]:
    """(points, curve) of calibration charts: every level with its residual and whether it is included; the curve on ``n``
    places between the lowest and highest level with the band of ``t`` standard errors."""
    from . import calibration as C

    levels = C.level_rows(points, fits, by).select(by, F.col("conc").alias("x"), F.col("response").alias("y"), "included", "residual")
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("x_min") + (F.col("x_max") - F.col("x_min")) * i / max(n - 1, 1)))
    curve = fits.filter("b1 is not null").withColumn("x", grid)
    x = F.col("x")
    curve = curve.withColumns({"y": C.predict(x), "_se": C.prediction_se(x)})
    return levels, curve.select(by, "x", "y", (F.col("y") - t * F.col("_se")).alias("low"), (F.col("y") + t * F.col("_se")).alias("high"))


def calibration_unknowns(unknowns: DataFrame, fits: DataFrame, t: float = 1.96, weighting: str = "none", by: str = "analyte") -> DataFrame:
    """What a calibration chart shows of unknowns (``by``, trace_id, response): their places x on the curve (null where it has none),
    y, the ends low and high of ``t`` standard errors of x, and flags. Unknowns without a curve are left out."""
    from . import calibration as C

    found = C.inverse(unknowns.select(by, "trace_id", "response").join(fits, by), F.col("response"), 1, weighting)
    low, high = (F.col("conc") + sign * t * F.col("conc_se") for sign in (-1, 1))
    return found.select(by, "trace_id", F.col("conc").alias("x"), F.col("response").alias("y"), low.alias("low"), high.alias("high"), F.col("conc_flags").alias("flags"))
