"""Weighted calibration lines and their inverse, by grouped power sums: one aggregation and one for the residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames

MODELS = ("linear", "linear0", "quadratic")
WEIGHTINGS = {"none": 0, "1/x": 1, "1/x2": 2}


def fit(points: DataFrame, by: str, model: str = "linear", weighting: str = "none") -> DataFrame:
    """One row for each ``by``: n, b0, b1, b2, s, r2, adj_r2, covariances c00.., lod, loq and what inverse() needs.

    ``points`` has x, y and include (null counts as true); excluded and non-finite rows don't count. Weights are 1, 1/x
    or 1/x^2 scaled to a mean of 1; where x <= 0, the lowest positive x is taken. Too few points, or points that
    determine no line, give null coefficients.
    """
    good = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y") & F.coalesce(F.col("include"), F.lit(True))
    rows = points.filter(good).select(by, F.col("x").cast("double"), F.col("y").cast("double"))
    power = WEIGHTINGS[weighting]
    lowest = F.min(F.when(F.col("x") > 0, F.col("x"))).alias("low")
    if power:  # facts of groups go to the rows: rows of a few groups would all meet in few tasks
        rows = rows.join(frames.facts(rows.groupBy(by).agg(lowest)), by).withColumn("w", F.pow(F.when(F.col("x") > 0, F.col("x")).otherwise(F.coalesce("low", F.lit(1.0))), -float(power)))
        lowest = F.min("low").alias("low")
    else:
        rows = rows.filter(F.col(by).isNotNull()).withColumn("w", F.lit(1.0))
    x, y, w = F.col("x"), F.col("y"), F.col("w")
    sums = rows.groupBy(by).agg(
        F.count("*").alias("n"), lowest, F.min("x").alias("x_min"), F.max("x").alias("x_max"),
        *[F.sum(w * F.pow(x, float(k))).alias(f"s{k}") for k in range(5)], *[F.sum(w * y * F.pow(x, float(k))).alias(f"t{k}") for k in range(3)],
    )
    scale = F.col("n") / F.col("s0")
    s = [F.col(f"s{k}") * scale for k in range(5)]
    t = [F.col(f"t{k}") * scale for k in range(3)]
    null = F.lit(None).cast("double")
    if model == "linear":
        d = s[0] * s[2] - s[1] * s[1]
        ok = (F.col("n") >= 3) & (F.col("x_max") > F.col("x_min"))
        inverse = {"00": s[2] / d, "01": -s[1] / d, "11": s[0] / d}
        p = 2
    elif model == "linear0":
        d = s[2]
        ok = (F.col("n") >= 2) & (d > 0)
        inverse = {"11": 1 / d}
        p = 1
    else:
        c = {"00": s[2] * s[4] - s[3] * s[3], "01": s[2] * s[3] - s[1] * s[4], "02": s[1] * s[3] - s[2] * s[2]}
        c |= {"11": s[0] * s[4] - s[2] * s[2], "12": s[1] * s[2] - s[0] * s[3], "22": s[0] * s[2] - s[1] * s[1]}
        d = s[0] * c["00"] + s[1] * c["01"] + s[2] * c["02"]
        ok = (F.col("n") >= 4) & (d > 0)
        inverse = {k: v / d for k, v in c.items()}
        p = 3
    entry = lambda i, j: inverse.get(f"{min(i, j)}{max(i, j)}", F.lit(0.0))
    solved = sums.select(
        by, "n", "low", "x_min", "x_max", (1 / scale).alias("w_scale"),
        *[F.when(ok, sum((entry(i, j) * t[j] for j in range(3)), F.lit(0.0))).otherwise(null).alias(f"b{i}") for i in range(3)],
        *[F.when(ok, entry(i, j)).otherwise(null).alias(f"i{i}{j}") for i in range(3) for j in range(i, 3)],
        (t[0] / s[0]).alias("mean"),
    )
    solved = frames.facts(solved)
    line = F.col("b0") + F.col("b1") * x + F.col("b2") * x * x
    center = F.lit(0.0) if model == "linear0" else F.col("mean")
    spread = rows.join(solved, by).groupBy(by).agg(
        F.sum(w / F.col("w_scale") * F.pow(y - line, 2)).alias("sse"), F.sum(w / F.col("w_scale") * F.pow(y - center, 2)).alias("sst")
    )
    out = solved.join(spread, by)
    s2 = F.try_divide(F.col("sse"), F.col("n") - p)
    r2 = 1 - F.try_divide(F.col("sse"), F.col("sst"))
    slope = F.abs(F.col("b1") + 2 * F.col("b2") * F.coalesce(F.col("low"), F.lit(0.0)))
    out = out.withColumn("s", F.sqrt(s2)).withColumn("r2", r2)
    out = out.withColumn("adj_r2", 1 - (1 - F.col("r2")) * F.try_divide(F.col("n") - (0 if model == "linear0" else 1), F.col("n") - p))
    out = out.withColumn("lod", F.try_divide(3.3 * F.col("s"), slope)).withColumn("loq", F.try_divide(10 * F.col("s"), slope))
    cov = [(F.col(f"i{i}{j}") * s2).alias(f"c{i}{j}") for i in range(3) for j in range(i, 3)]
    return out.select(by, "n", "b0", "b1", "b2", "s", "r2", "adj_r2", *cov, "lod", "loq", "x_min", "x_max", "low", "w_scale")


def predict(x: Column) -> Column:
    return F.col("b0") + F.col("b1") * x + F.col("b2") * x * x


def prediction_se(x: Column, m: float | None = None, power: int = 0) -> Column:
    """Standard error of the line at ``x``, or of the mean of ``m`` further responses there."""
    g = [F.lit(1.0), x, x * x]
    var = F.lit(0.0)
    for i in range(3):
        for j in range(i, 3):
            var = var + (1 if i == j else 2) * g[i] * g[j] * F.col(f"c{i}{j}")
    if m:
        weight = F.pow(F.when(x > 0, x).otherwise(F.coalesce("low", F.lit(1.0))), -float(power)) / F.col("w_scale")
        var = var + F.col("s") * F.col("s") / (m * weight)
    return F.sqrt(var)


def solve(y: Column) -> Column:
    """x where the fitted curve has the value ``y``; null if nowhere. Of two roots, the one on the branch that rises (or
    falls) as the curve does over its range."""
    linear = F.try_divide(y - F.col("b0"), F.col("b1"))
    a, b, c = F.col("b2"), F.col("b1"), F.col("b0") - y
    disc = b * b - 4 * a * c
    trend = F.signum(predict(F.col("x_max")) - predict(F.col("x_min")))
    root = F.try_divide(-b + trend * F.sqrt(F.greatest(disc, F.lit(0.0))), 2 * a)
    return F.when(F.abs(a) < 1e-14, linear).when(disc >= 0, root)


def inverse(df: DataFrame, response: Column, m: float = 1.0, weighting: str = "none") -> DataFrame:
    """Adds conc, conc_se and conc_flags for a response on columns of fit()."""
    df = df.withColumn("conc", solve(response))
    slope = F.col("b1") + 2 * F.col("b2") * F.col("conc")
    df = df.withColumn("conc_se", F.try_divide(prediction_se(F.col("conc"), m, WEIGHTINGS[weighting]), F.abs(slope)))
    conc = F.col("conc")
    flags = F.array_compact(
        F.array(
            F.when(conc.isNull(), "noSolution"),
            F.when((conc < F.col("x_min")) | (conc > F.col("x_max")), "extrapolated"),
            F.when(conc < F.col("lod"), "below_LOD").when(conc < F.col("loq"), "below_LOQ"),
        )
    )
    return df.withColumn("conc_flags", flags)


def calibration_points(levels: DataFrame, responses: DataFrame) -> DataFrame:
    """Levels (analyte, level, conc, trace_id, response, include) with the response of their trace where they name one,
    and why a level has none."""
    joined = levels.join(responses.withColumnRenamed("response", "measured"), ["analyte", "trace_id"], "left")
    y = F.when(F.col("trace_id").isNull(), F.col("response")).otherwise(F.col("measured"))
    missing = F.when(y.isNotNull() & F.col("conc").isNotNull(), None).when(F.col("conc").isNull(), "no concentration").when(F.col("trace_id").isNull(), "no response").otherwise("no matching peak")
    return joined.select("analyte", "level", F.col("conc").alias("x"), y.alias("y"), F.coalesce("include", F.lit(True)).alias("include"), missing.alias("missing"))


def level_rows(points: DataFrame, fits: DataFrame, by: str = "analyte") -> DataFrame:
    """Levels (analyte, level, x, y, include, missing) beside the curve of their analyte: conc, response, included, fitted,
    residual, back_conc (what the response means by the curve), recovery_pct (of the level's own concentration) and flags.
    A level without a response has none of these, and one of an analyte without a curve no figures."""
    c = inverse(points.join(fits, by, "left"), F.col("y")).withColumn("fitted", predict(F.col("x")))
    return c.select(
        by, "level", F.col("x").alias("conc"), F.col("y").alias("response"), F.col("include").alias("included"), "fitted", (F.col("y") - F.col("fitted")).alias("residual"),
        F.col("conc").alias("back_conc"), (100 * F.try_divide("conc", "x")).alias("recovery_pct"), F.when(F.col("y").isNotNull() & F.col("b1").isNotNull(), F.col("conc_flags")).alias("flags"), "missing",
    )


def unknown_rows(peaks: DataFrame, fits: DataFrame, standards: DataFrame | None = None, by: str = "analyte") -> DataFrame:
    """Matched peaks (analyte, trace_id, peak_no, response) with conc, conc_se and conc_flags by the curve of their
    analyte; traces among ``standards`` (analyte, trace_id) are flagged "standard" as well. Of several analytes that match
    one peak the first counts, by analyte. Peaks of analytes without a curve have no concentration."""
    first = F.min(F.struct(by, "response")).alias("f")
    one = peaks.groupBy("trace_id", "peak_no").agg(first).select("trace_id", "peak_no", f"f.{by}", "f.response")
    c = inverse(one.join(fits, by, "left"), F.col("response"))
    flags = F.when(F.col("b1").isNotNull(), F.col("conc_flags")).otherwise(F.array().cast("array<string>"))
    if standards is not None:
        known = standards.select(by, "trace_id").distinct().withColumn("_standard", F.lit(True))
        c = c.join(known, [by, "trace_id"], "left")
        flags = F.concat(flags, F.when(F.col("_standard"), F.array(F.lit("standard"))).otherwise(F.array().cast("array<string>")))
    return c.select("trace_id", "peak_no", by, "response", "conc", "conc_se", flags.alias("conc_flags"))
