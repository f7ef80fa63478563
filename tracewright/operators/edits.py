"""Changes to peak tables as joins with tables of edits, and the reports that tell what is left to decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames
from .integration import meets
from .matching import band_join

KEYS = ["trace_id", "peak_no"]


def apply_edits(peaks: DataFrame, edits: DataFrame, columns: list[str]) -> DataFrame:
    """Peaks with the non-null values of ``edits`` (keyed by trace_id and peak_no, one row a peak) in place of their own;
    a peak whose edit has ``removed`` true goes."""
    removed, *new = frames.unused(peaks, "removed", *(f"new_{c}" for c in columns))
    e = edits.select(*KEYS, *[F.col(c).alias(n) for c, n in zip(columns, new)], F.coalesce("removed", F.lit(False)).alias(removed))
    out = peaks.join(e, KEYS, "left").filter(~F.coalesce(removed, F.lit(False)))
    return out.withColumns({c: F.coalesce(n, c) for c, n in zip(columns, new)}).drop(*new, removed)


def replace_inside(peaks: DataFrame, windows: DataFrame) -> DataFrame:
    """Manual windows (trace_id, peak_no, start, apex, end) in place of the peaks whose apex lies inside one."""
    left = meets(peaks, "apex", "apex", windows, "start", "end", "trace_id", closed=True, inside=False)
    return left.withColumn("manual", F.lit(False)).unionByName(windows.withColumn("manual", F.lit(True)))


def undecided_clusters(peaks: DataFrame) -> DataFrame:
    """Clusters of several peaks of which none has a mode of its own: trace_id, cluster, peaks, start, end."""
    g = peaks.groupBy("trace_id", "cluster").agg(F.count("*").alias("peaks"), F.count("mode").alias("_m"), F.min("start").alias("start"), F.max("end").alias("end"))
    return g.filter("peaks > 1 and _m = 0").drop("_m")


def match_printed(peaks: DataFrame, printed: DataFrame, tolerance: float, radius: float | None = None) -> DataFrame:
    """Printed peaks (trace_id, printed_no, printed_rt) with the peak that is nearest to them and to which they are the
    nearest, looked for within ``radius`` (ten tolerances, 0.5 at least), the distance, and whether it is within the
    tolerance; ties go to the smaller number. Others have nulls."""
    radius = max(10 * tolerance, 0.5) if radius is None else radius
    pairs = band_join(peaks.select("trace_id", "peak_no", "rt"), printed, "rt", "printed_rt", radius, ["trace_id"]).withColumn("_d", F.abs(F.col("rt") - F.col("printed_rt")))
    by_printed = pairs.groupBy("trace_id", "printed_no").agg(F.min(F.struct("_d", "peak_no", "rt")).alias("m")).select("trace_id", "printed_no", F.col("m.peak_no").alias("peak_no"), F.col("m.rt").alias("_rt"))
    by_peak = pairs.groupBy("trace_id", "peak_no").agg(F.min(F.struct("_d", "printed_no")).alias("m")).select("trace_id", F.col("m.printed_no").alias("printed_no"), "peak_no")
    both = by_printed.join(by_peak, ["trace_id", "printed_no", "peak_no"])
    out = printed.join(both, ["trace_id", "printed_no"], "left").withColumn("delta", F.col("_rt") - F.col("printed_rt")).drop("_rt")
    return out.withColumn("within", F.abs("delta") <= tolerance)


def parse_printed(lines: DataFrame) -> DataFrame:
    """Lists of peaks as printed (trace_id, text: a line each of a place, an area share and a label, parted by commas,
    semicolons, tabs or blanks) as rows: trace_id, printed_no, printed_rt, printed_pct, label. Lines without a place are
    left out; a share may end in %; a missing one, or a missing label, is null."""
    line = lines.select("trace_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r\n|\r|\n")).alias("i", "line"))
    part = lambda k: F.regexp_extract(F.trim("line"), r"^([-+]?\d+(?:\.\d+)?)(?:\s*[,;\t ]\s*([-+]?\d+(?:\.\d+)?)\s*%?)?(?:\s*[,;\t ]\s*(.*?))?$", k)
    rows = line.select("trace_id", "i", part(1).alias("a"), part(2).alias("b"), F.nullif(F.trim(part(3)), F.lit("")).alias("label")).filter("a <> ''")
    number = F.row_number().over(Window.partitionBy("trace_id").orderBy("i"))
    return rows.select("trace_id", number.alias("printed_no"), F.col("a").try_cast("double").alias("printed_rt"), F.nullif("b", F.lit("")).try_cast("double").alias("printed_pct"), "label")


def add_peaks(peaks: DataFrame, added: DataFrame, step: Column) -> DataFrame:
    """``peaks`` and those of ``added`` (trace_id, peak_no, start, apex, end) that have no peak of their trace within two
    ``step`` of their apex. Where a new one overlaps its neighbours, it is trimmed to theirs. New ones are manual."""
    low, high = frames.unused(added, "low", "high")
    fresh, left, right = (frames.free(c, [*peaks.columns, *added.columns]) for c in ("fresh", "left", "right"))
    wide = added.withColumns({low: F.col("apex") - 2 * step, high: F.col("apex") + 2 * step})
    new = meets(wide, low, high, peaks, "apex", "apex", "trace_id", closed=True, inside=False).drop(low, high).withColumn(fresh, F.lit(True))
    both = peaks.withColumn(fresh, F.lit(False)).unionByName(new, allowMissingColumns=True)
    is_new = F.col(fresh)
    order = Window.partitionBy("trace_id").orderBy("apex", fresh, "peak_no")
    before = F.last(F.when(~is_new, F.col("end")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(F.when(~is_new, F.col("start")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    trimmed = both.withColumns({left: before, right: after})
    start = F.when(is_new, F.greatest("start", F.when(F.col(left).isNotNull(), F.least(left, "apex")))).otherwise(F.col("start"))
    end = F.when(is_new, F.least("end", F.when(F.col(right).isNotNull(), F.greatest(right, "apex")))).otherwise(F.col("end"))
    manual = is_new if "manual" not in peaks.columns else F.coalesce("manual", F.lit(False)) | is_new
    return trimmed.withColumns({"start": start, "end": end, "manual": manual}).drop(fresh, left, right)


def redetected(before: DataFrame, found: DataFrame, step: float) -> DataFrame:
    """The peaks of a new detection (trace_id, peak_no, start, apex, end) under those that were there before (with manual,
    mode and label): manual ones stay and take the place of what overlaps them; of the others, a new peak within two
    ``step`` of an old apex takes over its mode and label (of two the nearer, then the earlier)."""
    kept = before.filter(F.coalesce("manual", F.lit(False)))
    free = meets(found, "start", "end", kept, "start", "end", "trace_id", inside=False)
    old = before.filter(~F.coalesce("manual", F.lit(False)) & (F.col("mode").isNotNull() | F.col("label").isNotNull())).select("trace_id", F.col("apex").alias("_apex"), "mode", "label")
    near = band_join(free.select("trace_id", "peak_no", "apex"), old, "apex", "_apex", 2 * step, ["trace_id"])
    best = near.groupBy("trace_id", "peak_no").agg(F.min(F.struct(F.abs(F.col("apex") - F.col("_apex")), "_apex", "mode", "label")).alias("o"))
    free = free.join(best, KEYS, "left").withColumns({"mode": F.col("o.mode"), "label": F.col("o.label"), "manual": F.lit(False)}).drop("o")
    names = [*found.columns, "mode", "label", "manual"]
    return kept.withColumn("manual", F.lit(True)).select(*names).unionByName(free.select(*names))


def imported_as_manual(traces: DataFrame) -> DataFrame:
    """The peaks that files brought along (column ``peaks`` of read traces) as manual peaks: path, trace_no, peak_no, start,
    apex, end, label, imported_area, imported_area_se, manual."""
    each = traces.select("path", "trace_no", F.posexplode("peaks").alias("k", "p"))
    return each.select("path", "trace_no", (F.col("k") + 1).alias("peak_no"), "p.start", "p.apex", "p.end", "p.label", F.col("p.area").alias("imported_area"), F.col("p.area_se").alias("imported_area_se"), F.lit(True).alias("manual"))


def nudged(x: Column, at: Column, samples: int) -> Column:
    """The place ``samples`` samples along the trace from the sample nearest to ``at``, kept within the trace."""
    far = F.transform(x, lambda v: F.abs(v - at))
    k = F.array_position(far, F.array_min(far)).cast("int") - 1
    return F.get(x, F.greatest(F.lit(0), F.least(F.size(x) - 1, k + samples)))


def joined_results(peaks: DataFrame, results: DataFrame) -> DataFrame:
    """Peaks (trace_id, peak_no, peak_id) with the columns of their results: by peak_id where both have one, else by
    peak_no. A peak without a result has nulls."""
    own = [c for c in results.columns if c not in ("trace_id", "peak_no", "peak_id")]
    by_id = results.filter("peak_id is not null").select("trace_id", "peak_id", F.struct(*own).alias("_a"))
    by_no = results.filter("peak_id is null").select("trace_id", "peak_no", F.struct(*own).alias("_b"))
    out = peaks.join(by_id, ["trace_id", "peak_id"], "left").join(by_no, ["trace_id", "peak_no"], "left")
    return out.withColumn("_r", F.coalesce("_a", "_b")).select(*peaks.columns, *[F.col(f"_r.{c}").alias(c) for c in own])


def fit_components(peaks: DataFrame, fits: DataFrame) -> DataFrame:
    """Peaks with the component of their trace's joint fit (column ``fit``: an array as fitting.FIT, in the order of the
    peaks that were fitted, whose numbers are in ``peak_nos``): mu, sigma, tau, fit_height, fit_area, fit_area_se."""
    each = fits.select("trace_id", F.explode(F.arrays_zip(F.col("peak_nos").alias("peak_no"), F.col("fit").alias("f"))).alias("c"))
    names = {"mu": "mu", "sigma": "sigma", "tau": "tau", "height": "fit_height", "area": "fit_area", "area_se": "fit_area_se"}
    parts = each.select("trace_id", F.col("c.peak_no").alias("peak_no"), *[F.col(f"c.f.{k}").alias(n) for k, n in names.items()])
    return peaks.join(parts, KEYS, "left")


#: What is looked for in the keys of a trace's metadata.
RUN_FIELDS = {
    "sample": "sample|injection name", "instrument": "instrument|system|device", "column": r"\bcolumn\b", "operator": "operator|\buser\b|analyst", "date": "date|acquired|injection time", "method": "method|program",
    "detector": "detector|channel", "wavelength": "wavelength|lambda", "flow": r"\bflow", "temperature": "temp|oven", "injection_volume": r"inj\w*\.?\s*vol|volume inj",
}


def run_info(meta: Column) -> Column:
    """struct of RUN_FIELDS found in a trace's metadata by its keys; of each the first that fits and isn't blank."""

    def first(p: str) -> Column:
        hit = F.map_values(F.map_filter(meta, lambda k, v: F.lower(k).rlike(p) & (F.length(F.trim(v)) > 0)))
        return F.trim(F.get(hit, F.lit(0)))

    return F.struct(*[first(p).alias(n) for n, p in RUN_FIELDS.items()])


def effective_run(project: Column, own: Column) -> Column:
    """A project's run information (map) under that of a trace: the trace's own entries win unless they are blank."""
    blank = F.create_map().cast("map<string,string>")
    own = F.map_filter(F.coalesce(own, blank), lambda k, v: F.length(F.trim(F.coalesce(v, F.lit("")))) > 0)
    base = F.map_filter(F.coalesce(project, blank), lambda k, v: ~F.map_contains_key(own, k))
    return F.map_concat(base, own)


def trace_summaries(peaks: DataFrame) -> DataFrame:
    """One line of text a trace: its peaks, and the largest by area share."""
    g = peaks.groupBy("trace_id").agg(F.count("*").alias("n"), F.max_by("rt", "area_pct").alias("rt"), F.max("area_pct").alias("share"))
    return g.select("trace_id", F.format_string("%d peaks; largest at %.2f with %.1f %% of the area", "n", "rt", "share").alias("summary"))
