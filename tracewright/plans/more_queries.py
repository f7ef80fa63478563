"""More registered queries: detection, baselines, integration modes, fits, readers, scalar functions and images."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import clusters, edits, fitting, frames, gradient, image, integration, kernels, matching, metrics, peaks, reports, tables
from ..operators import signal as S
from ..sources import binary, exports, formats, lines, projects, sections
from . import analysis, views
from .queries import EMB, _cal, _intervals, calibration, query, r


@query()
def detected_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of every trace, with their figures."""
    m = peaks.peak_rows(views.embeddings(spark, sf_dir), min_dist=2.0, min_width=1.0, threshold=0.05)
    return m.select("trace_id", "peak_no", *[r(c).alias(c) for c in ("start", "apex", "end", "prominence", "area", "rt", "height", "fwhm")], "shoulder")


@query()
def baseline_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily revenue, smoothed and without its slow course."""
    t = views.daily_revenue(spark, sf_dir).withColumn("b", S.als_baseline(F.col("y"), 1e5, 0.01)).withColumn("s", S.savgol(F.col("y"), 11, 3))
    rows = t.select("trace_id", F.posexplode(F.arrays_zip("x", "s", "b")).alias("i", "v"))
    return rows.select("trace_id", "i", F.col("v.x").alias("x"), r("v.s", 4).alias("smooth"), r("v.b", 4).alias("baseline"), r(F.col("v.s") - F.col("v.b"), 4).alias("y"))


@query()
def integration_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valley, drop and hull areas of every detected peak within its cluster, and the recommended mode."""
    t = views.embeddings(spark, sf_dir)
    t = t.withColumn("peaks", peaks.detected(F.col("x"), F.col("y"), min_dist=2.0, min_width=1.0, threshold=0.05))
    o = clusters.options(t, ("valley", "drop", "baseline"))
    return o.select("trace_id", "peak_no", "cluster", F.col("recommended").alias("mode"), r("valley").alias("valley"), r("drop").alias("drop"), r("baseline").alias("hull"))


@query()
def fitted_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest peak of every trace fitted by a Gaussian on a line."""
    t = views.embeddings(spark, sf_dir)
    t = t.withColumn("peaks", peaks.detected(F.col("x"), F.col("y"), min_dist=2.0, min_width=1.0, threshold=0.05))
    t = t.withColumn("apex", F.array_max(F.transform("peaks", lambda p: F.struct(p["prominence"].alias("prominence"), p["apex"].alias("apex"))))["apex"]).filter("apex is not null")
    f = t.select("trace_id", F.inline(fitting.fitted(F.col("x"), F.col("y"), F.col("apex") - 4, F.col("apex") + 4, F.array("apex"), "gaussian", True)))
    return f.select("trace_id", *[r(c, 3).alias(c) for c in ("mu", "sigma", "height", "area")])


#: The 97.5 % points of Student's t for 1 to 30 degrees of freedom.
T975 = "[12.7062047, 4.3026527, 3.1824463, 2.7764451, 2.5705818, 2.4469119, 2.3646243, 2.3060041, 2.2621572, 2.2281389, 2.2009852, 2.1788128, 2.1603687, 2.1447867, 2.1314495, 2.1199053, 2.1098156, 2.1009220, 2.0930241, 2.0859634, 2.0796138, 2.0738731, 2.0686576, 2.0638986, 2.0595386, 2.0555294, 2.0518305, 2.0484071, 2.0452296, 2.0422725]"


@query(f"""WITH c AS (SELECT p_brand AS analyte, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
m AS (SELECT analyte, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM c GROUP BY analyte),
s AS (SELECT analyte, sqrt(sum(pow(y - b0 - b1 * x, 2)) / (max(n) - 2)) AS s FROM c JOIN m USING (analyte) GROUP BY analyte),
q AS (SELECT analyte, n - 2 AS v, CAST(1.959963984540054 AS DOUBLE) AS z, (1500 - b0) / b1 AS conc, s / abs(b1) * sqrt(1 + 1.0 / n + pow((1500 - b0) / b1 - mx, 2) / sxx) AS se FROM m JOIN s USING (analyte) WHERE n >= 3),
t AS (SELECT *, CASE WHEN v <= 30 THEN ({T975})[v] ELSE z + (pow(z, 3) + z) / (4 * v) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * pow(v, 2)) + (3 * pow(z, 7) + 19 * pow(z, 5) + 17 * pow(z, 3) - 15 * z) / (384 * pow(v, 3)) + (79 * pow(z, 9) + 776 * pow(z, 7) + 1482 * pow(z, 5) - 1920 * pow(z, 3) - 945 * z) / (92160 * pow(v, 4)) END AS t FROM q)
SELECT analyte, {", ".join(f"round(sign({v}) * ln(1 + abs({v})), 4) + 0.0 AS log_{n}" for v, n in (("conc", "conc"), ("se", "conc_se"), ("(conc - t * se)", "conc_lo"), ("(conc + t * se)", "conc_hi")))} FROM t""")
def calibration_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentrations of a response with 95 % intervals from Student's t, as signed logarithms."""
    c = calibration.inverse(calibration.fit(_cal(spark, sf_dir), "analyte"), F.lit(1500.0)).filter("b1 is not null")
    c = c.withColumn("ci", fitting.confidence(F.col("conc"), F.col("conc_se"), F.col("n") - 2))
    names = (("conc", "conc"), ("conc_se", "conc_se"), ("ci.low", "conc_lo"), ("ci.high", "conc_hi"))
    return c.select("analyte", *[r(F.signum(k) * F.log1p(F.abs(F.col(k))), 4).alias(f"log_{n}") for k, n in names])


def _texts(spark: SparkSession, sf_dir: str, line: str, head: str, tail: str = "") -> DataFrame:
    """A text of event samples for each user, as a file would hold them."""
    s = views.event_samples(spark, sf_dir).filter("y is not null")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "y"))), lambda v: F.format_string(line, F.round(v["x"], 4), F.round(v["y"], 4))), "\n")
    return s.groupBy("trace_id").agg(F.concat(F.lit(head), lines, F.lit(tail)).alias("content")).withColumn("path", F.concat(F.col("trace_id").cast("string"), F.lit(".txt"))).drop("trace_id")


READ_BACK = """WITH s AS (SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60e6 AS x, value AS y FROM events WHERE value IS NOT NULL)
SELECT user_id || '.txt' AS path, 'FORMAT' AS format, count(*) AS n, round(sum(round(y, 4)), 3) + 0.0 AS total, round(min(x), 4) AS first_x, round(max(x), 4) AS last_x FROM s GROUP BY user_id"""


def _summary(traces: DataFrame) -> DataFrame:
    total = F.aggregate("y", F.lit(0.0), lambda s, v: s + v)
    return traces.select("path", "format", F.size("x").cast("long").alias("n"), r(total, 3).alias("total"), r(F.array_min("x"), 4).alias("first_x"), r(F.array_max("x"), 4).alias("last_x"))


@query(READ_BACK.replace("FORMAT", "delimited"))
def delimited_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as delimited text in seconds with a preamble, and read again."""
    s = "Sample: made\nDetector = UV\nTime (min)\tAbsorbance (mAU)\n"
    return _summary(formats.parse_files(_texts(spark, sf_dir, "%.4f\t%.4f", s)))


@query(READ_BACK.replace("FORMAT", "delimited"))
def decimal_comma_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir, "%.4f;%.4f", "")
    t = t.select("path", F.concat(F.lit("Time (min);Signal (mAU)\n"), F.translate("content", ".", ",")).alias("content"))
    return _summary(formats.parse_files(t))


def _event_lines(spark: SparkSession, sf_dir: str, line: str, head: list[str]) -> DataFrame:
    """Event samples as lines of a file for each user, in chunks of a week, under the lines ``head``. No user is gathered."""
    s = views.event_samples(spark, sf_dir).filter("y is not null")
    text = F.format_string(line, F.round("x", 4), F.round("y", 4))
    at = F.struct(F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
    body = s.select(F.concat(F.col("trace_id").cast("string"), F.lit(".txt")).alias("path"), F.floor(F.col("x") / 10080).alias("chunk"), at.alias("at"), text.alias("line"))
    top = body.select("path").distinct()
    place = lambda k: F.struct(F.lit(float(k)).alias("x"), F.lit(0.0).alias("y"))
    above = F.inline(F.array(*[F.struct(F.lit(-1).cast("long").alias("chunk"), place(k).alias("at"), F.lit(t).alias("line")) for k, t in enumerate(head)]))
    return body.unionByName(top.select("path", above))


LINES_READ_BACK = """WITH s AS (SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60e6 AS x, value AS y FROM events WHERE value IS NOT NULL)
SELECT user_id || '.txt' AS path, 'Absorbance' AS name, count(*) AS n, round(sum(round(y, 4)), 3) + 0.0 AS total, round(min(x), 4) AS first_x, round(max(x), 4) AS last_x FROM s GROUP BY user_id"""


def _line_summary(samples: DataFrame) -> DataFrame:
    g = samples.groupBy("path", "name").agg(F.count("*").alias("n"), F.sum("y").alias("total"), F.min("x").alias("first_x"), F.max("x").alias("last_x"))
    return g.select("path", "name", "n", r("total", 3).alias("total"), r("first_x", 4).alias("first_x"), r("last_x", 4).alias("last_x"))


@query(LINES_READ_BACK)
def delimited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of delimited text with a preamble, read again line by line."""
    return _line_summary(lines.samples(_event_lines(spark, sf_dir, "%.4f\t%.4f", ["Sample: made", "Detector = UV", "Time (min)\tAbsorbance (mAU)"])))


@query(LINES_READ_BACK)
def decimal_comma_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with semicolons and decimal commas."""
    made = _event_lines(spark, sf_dir, "%.4f;%.4f", ["made by hand", "Time (min);Absorbance (mAU)"])
    return _line_summary(lines.samples(made.withColumn("line", F.when(F.col("chunk") >= 0, F.translate("line", ".", ",")).otherwise(F.col("line")))))


@query(LINES_READ_BACK.replace("'Absorbance'", "'Value'"))
def chromeleon_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of an export with a section of keys, one of data and a column of step widths."""
    head = ["Injection\t1", "Signal Unit\tmAU", "", "Chromatogram Data:", "Time (min)\tStep (s)\tValue (mAU)"]
    return _line_summary(sections.chromeleon(_event_lines(spark, sf_dir, "%.4f\t1.5\t%.4f", head)))


@query(LINES_READ_BACK)
def jcamp_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pairs of a JCAMP-DX block, read again line by line."""
    return _line_summary(sections.jcamp(_event_lines(spark, sf_dir, "%.4f, %.4f;", ["##TITLE=Absorbance", "##XUNITS=MINUTES", "##YFACTOR=1", "##XYPOINTS=(XY..XY)"])))


@query("""WITH s AS (SELECT user_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 60e6 AS x, round(round(value, 4) * 0.5, 5) AS y FROM events WHERE value IS NOT NULL)
SELECT user_id || '.txt' AS path, name, count(*) AS n, round(sum(y), 3) + 0.0 AS total, round(min(x), 4) AS first_x, round(max(x), 4) AS last_x FROM s CROSS JOIN (VALUES ('Ch1'), ('Ch2')) AS c(name) GROUP BY user_id, name""")
def shimadzu_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as two intensity columns of a section with a multiplier, after a section of another kind."""
    head = ["[Header]", "1\t2", "2\t3", "3\t4", "[LC Chromatogram(Detector A)]", "Intensity Units\tmV", "Intensity Multiplier\t0.5", "R.Time (min)\tCh1\tCh2"]
    return _line_summary(sections.shimadzu(_event_lines(spark, sf_dir, "%1$.4f\t%2$.4f\t%2$.4f", head)))


@query(LINES_READ_BACK)
def arw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines below a head of quoted names and values."""
    return _line_summary(sections.arw(_event_lines(spark, sf_dir, "%.4f\t%.4f", ['"SampleName"\t"Channel"', '"made"\t"Absorbance"'])))


@query(LINES_READ_BACK)
def unicorn_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a pair of columns under a row of units, beside a pair of events."""
    samples, _ = sections.unicorn(_event_lines(spark, sf_dir, "%1$.4f\t%2$.4f\t%1$.4f\tx%2$.4f", ["made", "Absorbance\t\tFraction\t", "min\tmAU\tmin\tname"]))
    return _line_summary(samples)


def _through_files(spark: SparkSession, sf_dir: str, format: str) -> DataFrame:
    """Event samples of each user written as a file of a binary format into the shared folder, and read again as samples."""
    binary.register(spark)
    s = views.event_samples(spark, sf_dir).filter("y is not null").select("trace_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))
    lists = s.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("v"))
    even = F.transform(F.sequence(F.lit(0), F.size("v") - 1), lambda k: k / 60)  # channel files hold no places, but the first and the last
    x = even if format == "agilent-ch" else F.col("v.x")
    folder = f"{frames.shared_dir(spark)}/files-{uuid.uuid4().hex}"
    files = lists.select(F.col("trace_id").cast("string").alias("path"), F.lit("Absorbance").alias("name"), F.lit("mAU").alias("y_unit"), x.alias("x"), F.col("v.y").alias("y"))
    files.write.format("tracefiles").option("format", format).mode("append").save(folder)
    back = spark.read.format("tracefiles").option("rows", "samples").load(folder)
    g = back.groupBy("path", "format").agg(F.count("*").alias("n"), F.sum("y").alias("total"), F.min("x").alias("first_x"), F.max("x").alias("last_x"))
    name = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    out = frames.settled(g.select(name.alias("path"), "format", "n", r("total", 3).alias("total"), r("first_x", 4).alias("first_x"), r("last_x", 4).alias("last_x")))
    frames.remove(spark, folder)
    return out


FILES_READ_BACK = READ_BACK.replace("user_id || '.txt'", "CAST(user_id AS VARCHAR)")


@query(FILES_READ_BACK.replace("FORMAT", "netcdf"))
def netcdf_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "netcdf")


@query(FILES_READ_BACK.replace("FORMAT", "mzml"))
def mzml_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "mzml")


@query(FILES_READ_BACK.replace("FORMAT", "xlsx"))
def xlsx_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "xlsx")


@query(FILES_READ_BACK.replace("FORMAT", "agilent-ch").replace("round(min(x), 4)", "CAST(0.0 AS DOUBLE)").replace("round(max(x), 4)", "round((count(*) - 1) / 60, 4)"))
def channel_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _through_files(spark, sf_dir, "agilent-ch")


@query("""WITH c AS (SELECT c_custkey, c_name, c_nationkey, c_acctbal, length(c_name) AS n FROM customer),
f AS (SELECT 'traces[0].name' AS field, 'shortened from ' || n || ' to 12 characters' AS what FROM c WHERE n > 12
  UNION ALL SELECT 'traces[0].y', '1 values are no finite numbers' FROM c UNION ALL SELECT '.nation', 'unknown key' FROM c
  UNION ALL SELECT 'traces[0].peaks[0]', 'bounds are missing or out of order' FROM c WHERE c_acctbal < 0
  UNION ALL SELECT 'settings.clipDefault', 'unknown value' FROM c WHERE c_nationkey % 2 = 1 UNION ALL SELECT 'traces[0].proc.window', 'brought within 3 and 1001' FROM c WHERE c_custkey % 1500 NOT BETWEEN 3 AND 1001)
SELECT field, what, count(*) AS n FROM f GROUP BY field, what""")
def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with documents made of customers, counted by field and kind."""
    c = views.dealt(views.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal"))
    peak = F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("apex"), F.when(F.col("c_acctbal") < 0, 0.5).otherwise(2.0).alias("end"))
    proc = F.struct((F.col("c_custkey") % 1500).alias("window"))
    trace = F.struct(F.col("c_name").alias("name"), F.array(F.lit(0.0), F.lit(1.0)).alias("x"), F.array(F.lit("none"), F.lit(None)).alias("y"), F.array(peak).alias("peaks"), proc.alias("proc"))
    mode = F.struct(F.when(F.col("c_nationkey") % 2 == 1, "evil").otherwise("drop").alias("clipDefault"))
    text = F.to_json(F.struct(F.lit(2).alias("version"), F.array(trace).alias("traces"), mode.alias("settings"), F.col("c_nationkey").alias("nation")), {"ignoreNullFields": "false"})
    found = projects.examined_documents(c.select(F.col("c_custkey").cast("string").alias("path"), text.alias("content")), projects.Lengths(name=12))
    return found.select(F.inline("findings")).groupBy("field", "what").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_name AS name, round(c_acctbal, 2) + 0.0 AS y FROM customer""")
def links_opened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of customers packed into share links and opened again."""
    c = views.dealt(views.table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("double").alias("y")))

    @F.arrow_udf("string")
    def packed(name: pa.Array, y: pa.Array) -> pa.Array:
        made = ({"version": 2, "traces": [{"id": n, "name": n, "x": [0], "y": [v]}]} for n, v in zip(name.to_pylist(), y.to_pylist()))
        return pa.array(["https://host/#" + projects.pack_link(m, "lz") for m in made], pa.string())

    made = packed.asNondeterministic()("c_name", "y")  # once a row: the kind of a text is looked up in it before it is opened
    traces, _ = projects.import_texts(c.select(F.col("c_custkey").cast("string").alias("path"), made.alias("content")))
    return traces.select(F.col("path").cast("long").alias("c_custkey"), "name", r(F.get("y", F.lit(0)), 2).alias("y"))


@query(f"""WITH {EMB}, w AS (SELECT trace_id, i, y, max(CASE WHEN i = 20 THEN y END) OVER (PARTITION BY trace_id) AS a, max(CASE WHEN i = 44 THEN y END) OVER (PARTITION BY trace_id) AS b FROM e WHERE i BETWEEN 20 AND 44)
SELECT trace_id, CAST(i AS DOUBLE) AS x, round(y, 6) + 0.0 AS upper, round(a + (b - a) * (i - 20) / 24.0, 6) + 0.0 AS lower,
  round(sum(y - (a + (b - a) * (i - 20) / 24.0)) OVER (PARTITION BY trace_id), 5) + 0.0 AS area FROM w""")
def valley_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines between which a peak's area lies, above its own chord, and that area."""
    peak = F.array(F.struct(F.lit(20.0).alias("start"), F.lit(32.0).alias("apex"), F.lit(44.0).alias("end"), F.lit(True).alias("manual")))
    found = clusters.mode_frames(views.embeddings(spark, sf_dir).withColumn("peaks", peak), ("valley",))
    rows = found.select("trace_id", "area", F.inline(F.arrays_zip("x", "upper", "lower")))
    return rows.select("trace_id", "x", r("upper").alias("upper"), r("lower").alias("lower"), r("area", 5).alias("area"))


@query(READ_BACK.replace("FORMAT", "json"))
def json_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _texts(spark, sf_dir, "[%.4f, %.4f],", "[", "")
    return _summary(formats.parse_files(t.withColumn("content", F.concat(F.expr("substring(content, 1, length(content) - 1)"), F.lit("]")))))


@query(READ_BACK.replace("FORMAT", "jcamp"))
def jcamp_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "##TITLE=made\n##JCAMP-DX=4.24\n##XUNITS=MINUTES\n##YUNITS=mAU\n##XYPOINTS=(XY..XY)\n"
    return _summary(formats.parse_files(_texts(spark, sf_dir, "%.4f %.4f", head, "\n##END=\n")))


@query(READ_BACK.replace("FORMAT", "chromeleon"))
def chromeleon_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = "Injection\t1\nSignal Unit\tmAU\n\nChromatogram Data:\nTime (min)\tValue (mAU)\n"
    return _summary(formats.parse_files(_texts(spark, sf_dir, "%.4f\t%.4f", head)))


@query("""WITH s AS (SELECT o_orderkey, round(o_totalprice, 2) AS v FROM orders) SELECT o_orderkey, v FROM s""")
def parsed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices written with thousands groups, and read again."""
    text = F.concat(F.lit(' "'), F.format_number("o_totalprice", 2), F.lit('" '))
    return views.table(spark, sf_dir, "orders").select("o_orderkey", r(scalars.parse_number(text), 2).alias("v"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice AS v, CASE WHEN l_extendedprice = 0 THEN 0.0 ELSE round(floor(l_extendedprice / pow(10.0, floor(log10(l_extendedprice)) - 2) + 0.5) * pow(10.0, floor(log10(l_extendedprice)) - 2), 4) END AS rounded FROM lineitem""")
def significant_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("v"), r(scalars.round_significant(F.col("l_extendedprice"), 3), 4).alias("rounded"))


@query("""SELECT conv_id, turn, sha256(replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) AS digest FROM conversations""")
def escaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", F.sha2(scalars.escape_html(F.coalesce("text", F.lit(""))), 256).alias("digest"))


@query("""WITH c AS (SELECT p_partkey, CAST(p_partkey * 7 % 256 AS BIGINT) AS r, CAST(p_partkey * 13 % 256 AS BIGINT) AS g, CAST(p_size * 5 % 256 AS BIGINT) AS b FROM part)
SELECT p_partkey, '#' || lower(printf('%02x%02x%02x', r, g, b)) AS code, r, g, b FROM c""")
def colour_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 7 % 256).alias("r"), (F.col("p_partkey") * 13 % 256).alias("g"), (F.col("p_size") * 5 % 256).alias("b"))
    c = c.select("p_partkey", scalars.rgb_to_hex(F.col("r"), F.col("g"), F.col("b")).alias("code"))
    back = scalars.hex_to_rgb(F.col("code"))
    return c.select("p_partkey", "code", *[back[k].cast("long").alias(k) for k in "rgb"])


@query("""SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS ext, regexp_replace(regexp_extract(url, '([^/\\\\]*)$', 1), '\\.[A-Za-z0-9]+$', '') AS base FROM pages""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.table(spark, sf_dir, "pages")
    return t.select("page_id", scalars.extension(F.col("url")).alias("ext"), scalars.base_name(F.col("url")).alias("base"))


@query(f"""WITH {EMB}, d AS (SELECT *, y - lag(y) OVER (PARTITION BY trace_id ORDER BY i) AS d FROM e)
SELECT e.trace_id, 'trace ' || e.trace_id AS trace_name, CAST(e.i AS DOUBLE) AS x, round(e.y, 6) + 0.0 AS y, round((coalesce(a.y, e.y) + e.y + coalesce(b.y, e.y)) / 3, 6) + 0.0 AS y_processed, false AS digitized
FROM e JOIN n USING (trace_id) LEFT JOIN e a ON a.trace_id = e.trace_id AND a.i = e.i - 1 LEFT JOIN e b ON b.trace_id = e.trace_id AND b.i = e.i + 1 WHERE e.i > 0 AND e.i < n.n - 1""")
def exported_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long data rows with the processed signal (a mean of three; ends left out)."""
    t = views.embeddings(spark, sf_dir).withColumn("y_processed", S.savgol(F.col("y"), 3, 1))
    inner = lambda c: F.slice(c, 2, F.size(c) - 2)
    t = t.select("trace_id", F.concat(F.lit("trace "), F.col("trace_id").cast("string")).alias("trace_name"), *[inner(F.col(c)).alias(c) for c in ("x", "y", "y_processed")], F.lit(False).alias("digitized"))
    return exports.data_rows(t).select("trace_id", "trace_name", "x", r("y").alias("y"), r("y_processed").alias("y_processed"), "digitized")


@query(f"""WITH {EMB} SELECT trace_id, CAST(count(*) AS INTEGER) AS n, true AS even, round(max(abs(y)), 6) AS top FROM e GROUP BY trace_id""")
def packed_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces packed as an even grid and integer differences, and unpacked; off by less than 1e-5 of the largest value."""
    t = views.embeddings(spark, sf_dir).withColumn("u", S.pack_uniform(F.col("x"))).withColumn("d", S.pack_delta(F.col("y")))
    t = t.withColumn("y2", S.unpack_delta(F.col("d"))).withColumn("x2", S.unpack_uniform(F.col("u")))
    top = F.array_max(F.transform("y", lambda v: F.abs(v)))
    off = F.array_max(F.transform(F.arrays_zip("y", "y2"), lambda s: F.abs(s["y"] - s["y2"])))
    return t.select("trace_id", F.size("x2").alias("n"), (F.col("u").isNotNull() & (off <= top * 1e-5)).alias("even"), r(top).alias("top"))


@query(f"""WITH {EMB}, t AS (SELECT trace_id, CASE WHEN i % 5 IN (2, 3) OR i BETWEEN 20 AND 26 THEN NULL ELSE y END AS y, i FROM e),
k AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN i END) OVER (PARTITION BY trace_id ORDER BY i) AS a, min(CASE WHEN y IS NOT NULL THEN i END) OVER (PARTITION BY trace_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM t)
SELECT k.trace_id, CAST(k.i AS INTEGER) AS i, round(CASE WHEN k.y IS NOT NULL THEN k.y WHEN b - a - 1 <= 3 THEN p.y + (q.y - p.y) * (k.i - a) / (b - a) END, 6) + 0.0 AS y
FROM k LEFT JOIN e p ON p.trace_id = k.trace_id AND p.i = a LEFT JOIN e q ON q.trace_id = k.trace_id AND q.i = b""")
def filled_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short gaps bridged, long ones left."""
    t = views.embeddings(spark, sf_dir)
    t = t.withColumn("y", F.transform("y", lambda v, i: F.when(~(i % 5).isin(2, 3) & ~i.between(20, 26), v)))
    return t.select("trace_id", F.posexplode(S.gap_filled(F.col("y"), 3)).alias("i", "y")).select("trace_id", "i", r("y").alias("y"))


@query(f"""WITH {EMB}, l AS (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS q FROM e WINDOW w AS (PARTITION BY trace_id ORDER BY i)),
m AS (SELECT trace_id, i, abs(i - 31.5) AS far FROM l WHERE y > p AND y > q), b AS (SELECT trace_id, min_by(i, far * 1000 + i) AS i FROM m GROUP BY trace_id)
SELECT trace_id, CAST(round(31.5 - i, 6) AS DOUBLE) AS shift FROM b""")
def alignment_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each trace moves so that its apex nearest to the middle comes to lie there."""
    t = views.embeddings(spark, sf_dir).withColumn("tops", S.local_maxima(F.col("y")))
    apexes = F.transform("tops", lambda k: F.struct(k.cast("double").alias("rt")))
    return t.select("trace_id", matching.alignment_shift(apexes, F.lit(31.5)).alias("shift")).filter("shift is not null")


@query("""WITH k AS (SELECT l_suppkey AS trace_id, l_orderkey * 10 + l_linenumber AS peak_no, l_quantity AS rt, l_extendedprice AS area FROM lineitem),
g AS (SELECT *, CAST(floor(rt / 5) AS BIGINT) AS grp FROM k), ref AS (SELECT grp, min(rt) AS ref_rt FROM g WHERE trace_id = 1 GROUP BY grp)
SELECT trace_id, peak_no, grp, round(rt - ref_rt, 6) + 0.0 AS delta_rt FROM g LEFT JOIN ref USING (grp)""")
def compared_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances to the reference trace's peak of the same group."""
    k = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("trace_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("peak_no"), F.col("l_quantity").alias("rt"), F.col("l_extendedprice").alias("area"))
    c = matching.compare(k.withColumn("grp", F.floor(F.col("rt") / 5)), F.col("trace_id") == 1, ["grp"])
    return c.select("trace_id", "peak_no", "grp", r("delta_rt").alias("delta_rt"))


@query()
def digitized_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trace drawn as an image and read from it again: how much of it is found and how far off it is at most, in
    heights of a pixel."""
    w, h, rgb = 320, 240, (31, 119, 180)

    def redrawn(x, y):  # an image a trace at a time, none of which leaves
        low, high = float(y.min()), float(y.max())
        found = image.curve(image.draw(y, w, h, low, high, rgb), (0.0, (len(x) - 1) / (w - 1.0), high, (low - high) / (h - 1)), rgb)
        return (low, high, None, None) if found is None else (low, high, found[2], np.interp(x, *found[:2]))

    t = views.embeddings(spark, sf_dir)
    fields = {"low": "double", "high": "double", "coverage": "double", "back": "array<double>"}
    t = t.withColumn("c", kernels.struct(fields, redrawn, F.col("x"), F.col("y"))).select("trace_id", "y", "c.*")
    off = F.array_max(F.transform(F.arrays_zip("y", "back"), lambda s: F.abs(s["y"] - s["back"])))
    return t.select("trace_id", r("coverage", 4).alias("coverage"), r(off / ((F.col("high") - F.col("low")) / (h - 1)), 2).alias("worst_pixels"))


@query("""WITH p AS (SELECT l_suppkey AS trace_id, l_orderkey * 10 + l_linenumber AS peak_no, CAST(datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS s, datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + l_quantity / 10 AS t FROM lineitem)
SELECT trace_id, peak_no, round(greatest(100.0, least(s, t)), 6) AS start, round(least(2000.0, greatest(s, t)), 6) AS "end" FROM p WHERE least(2000.0, greatest(s, t)) - greatest(100.0, least(s, t)) >= 1.0""")
def clamped_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds kept in order and within a range; peaks that become too narrow go."""
    p = _intervals(spark, sf_dir)
    b = integration.clamp_bounds(F.col("start"), F.col("end"), F.lit(100.0), F.lit(2000.0), F.lit(0.5))
    return p.select("trace_id", "peak_no", b.alias("b")).filter("b is not null").select("trace_id", "peak_no", r("b.start").alias("start"), r("b.end").alias("end"))


@query()
def clusters_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of every detected peak by all integration modes that need no fit."""
    t = views.embeddings(spark, sf_dir)
    t = t.withColumn("peaks", peaks.detected(F.col("x"), F.col("y"), min_dist=2.0, min_width=1.0, threshold=0.05))
    o = clusters.options(t, ("drop", "valley", "baseline", "skim-tangent", "skim-exp"))
    return o.select("trace_id", "peak_no", "cluster", *[r(c).alias(c) for c in ("drop", "valley", "baseline", "skim_tangent", "skim_exp")])


PEAKS = """p AS (SELECT l_orderkey AS trace_id, CAST(l_linenumber AS INTEGER) AS peak_no, l_quantity AS start, l_returnflag AS mode FROM lineitem),
e AS (SELECT DISTINCT l_orderkey AS trace_id, CAST(l_linenumber AS INTEGER) AS peak_no FROM lineitem WHERE (l_orderkey + l_linenumber) % 5 = 0)"""


@query(f"""WITH {PEAKS} SELECT p.trace_id, p.peak_no, p.start, CASE WHEN e.trace_id IS NOT NULL THEN 'valley' ELSE mode END AS mode FROM p LEFT JOIN e USING (trace_id, peak_no)
WHERE NOT (e.trace_id IS NOT NULL AND p.peak_no = 3)""")
def edited_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits applied to a peak table: new modes, and removals."""
    p = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").cast("int").alias("peak_no"), F.col("l_quantity").alias("start"), F.col("l_returnflag").alias("mode"))
    e = p.filter("(trace_id + peak_no) % 5 = 0").select("trace_id", "peak_no").distinct()
    e = e.select("trace_id", "peak_no", F.lit("valley").alias("mode"), (F.col("peak_no") == 3).alias("removed"))
    return edits.apply_edits(p, e, ["mode"]).select("trace_id", "peak_no", "start", "mode")


@query("""WITH p AS (SELECT l_orderkey AS trace_id, CAST(floor(l_quantity / 10) AS BIGINT) AS cluster, CASE WHEN l_returnflag = 'R' THEN 'drop' END AS mode, l_quantity AS start, l_quantity + l_discount AS "end" FROM lineitem)
SELECT trace_id, cluster, count(*) AS peaks, min(start) AS start, round(max("end"), 6) AS "end" FROM p GROUP BY trace_id, cluster HAVING count(*) > 1 AND count(mode) = 0""")
def undecided_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.table(spark, sf_dir, "lineitem")
    p = p.select(F.col("l_orderkey").alias("trace_id"), F.floor(F.col("l_quantity") / 10).alias("cluster"), F.when(F.col("l_returnflag") == "R", "drop").alias("mode"), F.col("l_quantity").alias("start"), (F.col("l_quantity") + F.col("l_discount")).alias("end"))
    return edits.undecided_clusters(p).select("trace_id", "cluster", "peaks", "start", r("end").alias("end"))


@query("""WITH k AS (SELECT DISTINCT o_custkey AS trace_id, o_orderkey AS peak_no, o_totalprice / 1000 AS rt FROM orders),
p AS (SELECT trace_id, peak_no AS printed_no, round(rt, 0) AS printed_rt FROM k WHERE peak_no % 3 = 0),
j AS (SELECT k.trace_id, peak_no, printed_no, abs(rt - printed_rt) AS d FROM k JOIN p ON k.trace_id = p.trace_id AND abs(rt - printed_rt) <= 2),
a AS (SELECT trace_id, printed_no, peak_no FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, printed_no ORDER BY d, peak_no) AS rk FROM j) WHERE rk = 1),
b AS (SELECT trace_id, printed_no, peak_no FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, peak_no ORDER BY d, printed_no) AS rk FROM j) WHERE rk = 1)
SELECT p.trace_id, p.printed_no, m.peak_no FROM p LEFT JOIN (SELECT * FROM a INTERSECT SELECT * FROM b) m USING (trace_id, printed_no)""")
def printed_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Printed places with the peaks they stand for, one to one, looked for within ten tolerances."""
    k = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trace_id"), F.col("o_orderkey").alias("peak_no"), (F.col("o_totalprice") / 1000).alias("rt")).distinct()
    p = k.filter("peak_no % 3 = 0").select("trace_id", F.col("peak_no").alias("printed_no"), F.round("rt", 0).alias("printed_rt"))
    return edits.match_printed(k, p, 0.2).select("trace_id", "printed_no", "peak_no")


@query("""WITH l AS (SELECT user_id, event_id, CASE WHEN value > 20 THEN 3 ELSE 1 END AS good, CASE WHEN value > 90 THEN 2 ELSE 0 END AS bad FROM events),
f AS (SELECT *, good >= 2 AND 3 * bad <= good AS data FROM l), r AS (SELECT *, sum(CASE WHEN data THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM f),
g AS (SELECT user_id, run, min(event_id) AS s, max(event_id) AS t, sum(good) AS cells FROM r WHERE data GROUP BY user_id, run)
SELECT user_id, s AS start, t AS "end", CAST(cells AS BIGINT) AS cells FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cells DESC, run) AS rk FROM g) WHERE rk = 1""")
def numeric_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best run of data lines; events stand for lines."""
    t = views.table(spark, sf_dir, "events")
    good, bad = F.when(F.col("value") > 20, 3).otherwise(1), F.when(F.col("value") > 90, 2).otherwise(0)
    return tables.best_run(t, "user_id", "event_id", good, bad)


@query("""WITH d AS (SELECT user_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM (SELECT user_id, event_id, CASE WHEN user_id % 3 = 0 THEN CAST(event_id AS DOUBLE) ELSE value END AS value FROM events) WHERE value IS NOT NULL)
SELECT user_id, count(*) AS n, min(value) AS low, max(value) AS high, coalesce(count(*) >= 3 AND max(value) > min(value) AND greatest(avg(CAST(d >= 0 AS DOUBLE)), avg(CAST(d <= 0 AS DOUBLE))) >= 0.98, false) AS monotone FROM d GROUP BY user_id""")
def monotone_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.table(spark, sf_dir, "events").withColumn("value", F.when(F.col("user_id") % 3 == 0, F.col("event_id").cast("double")).otherwise(F.col("value")))
    c = tables.column_stats(t, "user_id", "event_id", "value")
    return c.withColumn("monotone", F.coalesce("monotone", F.lit(False)))


@query(f"""WITH {EMB} SELECT trace_id, CAST(i AS INTEGER) AS i, round(y, 6) + 0.0 AS y FROM e JOIN n USING (trace_id) WHERE i % greatest(CAST(floor(n / 20.0) AS BIGINT), 1) = 0""")
def thinned_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.thinned(views.points(views.embeddings(spark, sf_dir)), 20).select("trace_id", "i", r("y").alias("y"))


@query("""SELECT l_orderkey, l_linenumber, round(2.0 + (l_quantity - 100.0) * (18.0 - 2.0) / 700.0, 6) + 0.0 AS x, round(pow(10.0, 0.0 + (500.0 - l_quantity) * 3.0 / 400.0), 4) + 0.0 AS y FROM lineitem""")
def axis_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels as values of a linear and a logarithmic axis."""
    axes = image.Axes((100.0, 2.0), (800.0, 18.0), (500.0, 1.0), (100.0, 1000.0), y_log=True)
    t = views.table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", r(image.to_data(axes, "x", F.col("l_quantity"))).alias("x"), r(image.to_data(axes, "y", F.col("l_quantity")), 4).alias("y"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'drop' WHEN l_returnflag = 'R' THEN 'valley' ELSE 'drop' END AS mode,
  CASE WHEN l_linenumber < 2 THEN 'valley' WHEN l_quantity / 4 >= 10 THEN 'skim-tangent' WHEN l_discount * 20 < 0.8 THEN 'fit' ELSE 'drop' END AS recommended FROM lineitem""")
def peak_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Modes in effect, and those recommended."""
    t = views.table(spark, sf_dir, "lineitem")
    own = F.when(F.col("l_linenumber") == 1, "drop")
    return t.select(
        "l_orderkey", "l_linenumber", integration.effective_mode(own, F.col("l_returnflag") == "R").alias("mode"), integration.recommended_mode(F.col("l_quantity") / 4, F.col("l_discount") * 20, F.col("l_linenumber")).alias("recommended")
    )


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, ['auto', 'name', 'rt', 'name+rt', 'none'][CAST(l_linenumber % 5 + 1 AS INTEGER)] AS mode, CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS name, l_quantity AS rt FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE mode WHEN 'none' THEN '' WHEN 'rt' THEN printf('%.2f', rt) WHEN 'name' THEN coalesce(name, '') WHEN 'name+rt' THEN coalesce(name || ' ', '') || printf('%.2f', rt) ELSE coalesce(name, printf('%.2f', rt)) END AS label FROM p""")
def peak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.table(spark, sf_dir, "lineitem")
    mode = F.get(F.array(*[F.lit(m) for m in ("auto", "name", "rt", "name+rt", "none")]), (F.col("l_linenumber") % 5).cast("int"))
    name = F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    return t.select("l_orderkey", "l_linenumber", scalars.peak_label(mode, name, F.col("l_quantity"), F.lit(1.0)).alias("label"))


@query("""WITH l AS (SELECT p_partkey AS level, p_brand AS analyte, CASE WHEN p_size % 2 = 0 THEN p_size % 10 END AS trace_id, CAST(p_size AS DOUBLE) AS x, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS response FROM part),
m AS (SELECT p_brand AS analyte, p_size % 10 AS trace_id, max(p_retailprice) AS measured FROM part WHERE p_size % 10 < 6 GROUP BY ALL)
SELECT analyte, level, x, round(CASE WHEN l.trace_id IS NULL THEN response ELSE measured END, 4) AS y, CASE WHEN l.trace_id IS NULL AND response IS NULL THEN 'no response' WHEN l.trace_id IS NOT NULL AND measured IS NULL THEN 'no matching peak' END AS missing FROM l LEFT JOIN m USING (analyte, trace_id)""")
def calibration_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels with typed responses or those of the traces that they name, and why one has none."""
    p = views.table(spark, sf_dir, "part")
    key = F.when(F.col("p_size") % 2 == 0, F.col("p_size") % 10)
    levels = p.select(F.col("p_brand").alias("analyte"), F.col("p_partkey").alias("level"), F.col("p_size").cast("double").alias("conc"), key.alias("trace_id"), F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("response"), F.lit(True).alias("include"))
    responses = p.filter("p_size % 10 < 6").groupBy(F.col("p_brand").alias("analyte"), (F.col("p_size") % 10).alias("trace_id")).agg(F.max("p_retailprice").alias("response"))
    c = calibration.calibration_points(levels, responses)
    return c.select("analyte", "level", "x", r("y", 4).alias("y"), "missing")


@query(f"""WITH c AS (SELECT p_brand AS analyte, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
m AS (SELECT analyte, count(*) AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0 FROM c GROUP BY analyte),
s AS (SELECT analyte, sqrt(sum(pow(y - b0 - b1 * x, 2)) / (max(n) - 2)) AS s FROM c JOIN m USING (analyte) GROUP BY analyte)
SELECT analyte, CAST(k AS INTEGER) AS k, round(b0 + b1 * 10 * k, 3) AS fit, round(s * sqrt(1.0 / n + pow(10 * k - mx, 2) / sxx), 4) AS se, round(s * sqrt(1.0 + 1.0 / n + pow(10 * k - mx, 2) / sxx), 4) AS se_new FROM m JOIN s USING (analyte), range(6) AS q(k) WHERE n >= 3""")
def calibration_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line and its standard errors on a grid."""
    c = calibration.fit(_cal(spark, sf_dir), "analyte").filter("b1 is not null").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5))))
    x = F.col("k") * 10.0
    return c.select("analyte", "k", r(calibration.predict(x), 3).alias("fit"), r(calibration.prediction_se(x), 4).alias("se"), r(calibration.prediction_se(x, 1.0), 4).alias("se_new"))


@query("""WITH n AS (SELECT user_id, count(*) * 40 AS n FROM events GROUP BY user_id), v AS (SELECT user_id, n, least(greatest(1e8 * pow(n / 4000.0, 4.0), 1e4), 1e11) AS v FROM n)
SELECT user_id, n, round(floor(v / pow(10.0, floor(log10(v)) - 2) + 0.5) * pow(10.0, floor(log10(v)) - 2), 0) AS lam FROM v""")
def automatic_lambdas(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = views.table(spark, sf_dir, "events").groupBy("user_id").agg((F.count("*") * 40).alias("n"))
    return n.select("user_id", "n", r(scalars.auto_lambda(F.col("n")), 0).alias("lam"))


@query()
def analysed_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole way from rows to a peak table: daily revenue smoothed, baseline-corrected, detected, integrated, measured."""
    how = analysis.Processing(lam=1e7, min_dist=5.0, min_width=3.0, threshold=20_000.0)
    t = analysis.peak_table(views.daily_revenue(spark, sf_dir), how)
    names = ["start", "end", "rt", "height", "area", "fwhm", "area_pct", "resolution", "sn"]
    return t.select("trace_id", "peak_no", "cluster", "mode", "shoulder", *[r(c, 3).alias(c) for c in names])


@query("""WITH c AS (SELECT p_brand AS analyte, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part),
m AS (SELECT analyte, count(*) AS n, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, min(x) AS lo, max(x) AS hi FROM c GROUP BY analyte),
s AS (SELECT analyte, sqrt(sum(pow(y - b0 - b1 * x, 2)) / (max(n) - 2)) AS s FROM c JOIN m USING (analyte) GROUP BY analyte),
u AS (SELECT l_orderkey, l_linenumber, p_brand AS analyte, l_extendedprice / l_quantity AS response FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 0),
q AS (SELECT u.*, (response - b0) / b1 AS conc, lo, hi, 3.3 * s / abs(b1) AS lod, 10 * s / abs(b1) AS loq FROM u JOIN m USING (analyte) JOIN s USING (analyte) WHERE n >= 3)
SELECT l_orderkey, l_linenumber, analyte, round(sign(conc) * ln(1 + abs(conc)), 4) + 0.0 AS log_conc, concat_ws(';', CASE WHEN conc < lo OR conc > hi THEN 'extrapolated' END, CASE WHEN conc < lod THEN 'below_LOD' WHEN conc < loq THEN 'below_LOQ' END) AS flags FROM q""")
def quantified_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentrations (signed logarithms) of all unknowns by the line of their analyte, with flags."""
    part = views.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("analyte"))
    u = views.table(spark, sf_dir, "lineitem").filter("l_quantity > 0").join(part, F.col("l_partkey") == F.col("p_partkey"))
    u = u.select("l_orderkey", "l_linenumber", "analyte", (F.col("l_extendedprice") / F.col("l_quantity")).alias("response"))
    q = calibration.inverse(u.join(calibration.fit(_cal(spark, sf_dir), "analyte").filter("b1 is not null"), "analyte"), F.col("response"))
    return q.select("l_orderkey", "l_linenumber", "analyte", r(F.signum("conc") * F.log1p(F.abs("conc")), 4).alias("log_conc"), F.concat_ws(";", "conc_flags").alias("flags"))


@query()
def manual_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A peak at the highest sample near the middle of every trace, and its bounds at the lowest samples nearby."""
    t = views.embeddings(spark, sf_dir)
    t = t.withColumn("p", peaks.peak_at(F.col("x"), F.col("y"), F.lit(31.5), 4.0))
    t = t.withColumn("b", peaks.refined_bounds(F.col("x"), F.col("y"), F.col("p.start"), F.col("p.end")))
    area = integration.chord_area(F.col("x"), F.col("y"), F.col("b.start"), F.col("b.end"))
    return t.select("trace_id", r("p.apex").alias("apex"), r("b.start").alias("start"), r("b.end").alias("end"), r(area).alias("area"))


@query("""WITH p AS (SELECT o_custkey AS trace_id, o_orderkey AS peak_no, o_totalprice / 1000 AS rt FROM orders), l AS (SELECT c_custkey AS label, c_acctbal / 20 AS place FROM customer WHERE c_acctbal IS NOT NULL),
j AS (SELECT peak_no, label, row_number() OVER (PARTITION BY peak_no ORDER BY abs(rt - place), place, label) AS rk FROM p JOIN l ON abs(rt - place) <= 0.05)
SELECT peak_no, label FROM j WHERE rk = 1""")
def group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored label that is nearest to each peak, within half a tolerance."""
    p = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("peak_no"), (F.col("o_totalprice") / 1000).alias("rt"))
    labels = views.table(spark, sf_dir, "customer").filter("c_acctbal is not null").select(F.col("c_custkey").alias("label"), (F.col("c_acctbal") / 20).alias("at"))
    return matching.group_labels(p.withColumnRenamed("peak_no", "key"), labels, 0.1).withColumnRenamed("key", "peak_no")


@query("""WITH p AS (SELECT l_orderkey AS trace_id, CAST(l_linenumber AS INTEGER) AS peak_no, l_extendedprice AS area, l_quantity AS rt, CASE WHEN l_discount > 0 THEN l_discount END AS k FROM lineitem)
SELECT trace_id, peak_no, 'area' AS name, area AS value FROM p UNION ALL SELECT trace_id, peak_no, 'rt', rt FROM p UNION ALL SELECT trace_id, peak_no, 'k', k FROM p WHERE k IS NOT NULL""")
def audited_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each figure of each peak; line items stand for peaks."""
    p = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").cast("int").alias("peak_no"), F.col("l_extendedprice").alias("area"), F.col("l_quantity").alias("rt"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("k"))
    return metrics.audit_rows(p).select("trace_id", "peak_no", "name", "value")


@query(f"""WITH {EMB}, b AS (SELECT trace_id, max(abs(y)) AS big FROM e GROUP BY trace_id), z AS (SELECT trace_id, row_number() OVER (ORDER BY trace_id) - 1 AS place, big FROM b), t AS (SELECT max(CASE WHEN big > 0 THEN 1.0 ELSE 0.0 END) AS top FROM b)
SELECT e.trace_id, CAST(i AS INTEGER) AS i, place, round(CASE WHEN big > 0 THEN y / big ELSE y END + place * 0.1 * top, 6) + 0.0 AS y FROM e JOIN z USING (trace_id), t""")
def waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All traces as a waterfall shows them."""
    t = reports.display_series(views.embeddings(spark, sf_dir), "max", 0.1)
    rows = t.select("trace_id", "place", F.posexplode("y").alias("i", "y"))
    return rows.select("trace_id", "i", "place", r("y").alias("y"))


@query("""WITH k AS (SELECT l_suppkey AS trace_id, CAST(floor(l_extendedprice / 100) AS BIGINT) AS grp, l_extendedprice / 100 AS rt, l_quantity AS area FROM lineitem WHERE l_suppkey IN (1, 2, 3)),
d AS (SELECT trace_id, grp, min(rt) AS rt, min(area) AS area FROM k GROUP BY ALL)
SELECT grp, round(avg(rt), 6) AS group_rt, count(DISTINCT trace_id) AS n_traces, {} FROM d GROUP BY grp""".replace("{}", ", ".join(f"max(CASE WHEN trace_id = {t} THEN {v} END) AS \"{t}_{v}\"" for t in (1, 2, 3) for v in ("rt", "area"))))
def wide_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of three traces side by side."""
    k = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("trace_id"), F.floor(F.col("l_extendedprice") / 100).alias("grp"), (F.col("l_extendedprice") / 100).alias("rt"), F.col("l_quantity").alias("area"))
    one = k.filter("trace_id in (1, 2, 3)").groupBy("trace_id", "grp").agg(F.min("rt").alias("rt"), F.min("area").alias("area"))
    return matching.compare_wide(one, [1, 2, 3], ["grp"]).withColumn("group_rt", r("group_rt"))


@query("""SELECT conv_id, turn, sha256(coalesce(text, '')) AS digest FROM conversations""")
def unescaped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts escaped for a page and decoded again."""
    t = views.table(spark, sf_dir, "conversations")
    back = scalars.decode_xml(scalars.escape_html(F.coalesce("text", F.lit(""))))
    return t.select("conv_id", "turn", F.sha2(back, 256).alias("digest"))


@query(f"""WITH {EMB} SELECT trace_id, CASE WHEN trace_id % 3 = 0 THEN 'CV' WHEN trace_id % 3 = 1 AND trace_id % 2 = 0 THEN 'min' ELSE 'mL' END AS x_unit, round(max(CASE WHEN trace_id % 3 = 1 AND trace_id % 2 = 0 THEN i / 0.5 ELSE i END), 6) AS last_x
FROM (SELECT trace_id, i FROM e) GROUP BY trace_id""")
def converted_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces over volumes as traces over minutes where a flow is known: every third trace is in column volumes, another third
    in mL, of which every second has a flow."""
    t = views.embeddings(spark, sf_dir)
    unit = F.when(F.col("trace_id") % 3 == 0, "CV").when(F.col("trace_id") % 3 == 1, "mL").otherwise("mL")
    flow = F.when((F.col("trace_id") % 3 == 1) & (F.col("trace_id") % 2 == 0), 0.5)
    c = S.volumes_to_minutes(t.withColumn("x_unit", unit), flow)
    return c.select("trace_id", "x_unit", r(F.element_at("x", -1)).alias("last_x"))


@query("""SELECT o_custkey AS trace_id, o_orderkey AS peak_no, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 END AS area FROM orders""")
def joined_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results beside their peaks (orders of customers): by id for even numbers, by number for every third, none for others."""
    p = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trace_id"), F.col("o_orderkey").alias("peak_no"), F.col("o_totalprice").alias("q"))
    p = p.withColumn("peak_id", F.concat_ws("#", "trace_id", "peak_no"))
    by_id = p.filter("peak_no % 2 = 0").select("trace_id", (F.col("peak_no") + 10**9).alias("peak_no"), "peak_id", F.col("q").alias("area"))
    by_no = p.filter("peak_no % 3 = 0 and peak_no % 2 = 1").select("trace_id", "peak_no", F.lit(None).cast("string").alias("peak_id"), (F.col("q") + 1).alias("area"))
    return edits.joined_results(p.select("trace_id", "peak_no", "peak_id"), by_id.unionByName(by_no)).select("trace_id", "peak_no", "area")


@query("""SELECT o_custkey AS trace_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS printed_no, round(o_totalprice, 2) AS printed_rt, CAST(o_orderkey % 100 AS DOUBLE) AS printed_pct, o_orderstatus AS label FROM orders""")
def printed_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of peaks written as text, one for each customer, and read again."""
    p = views.table(spark, sf_dir, "orders")
    line = F.format_string("%.2f, %d%%, %s", F.round("o_totalprice", 2), F.col("o_orderkey") % 100, "o_orderstatus")
    lists = p.groupBy(F.col("o_custkey").alias("trace_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))), lambda v: v["line"]), "\n").alias("text"))
    return edits.parse_printed(lists).select("trace_id", "printed_no", r("printed_rt", 2).alias("printed_rt"), "printed_pct", "label")


def _sql_columns(columns: dict, own: dict[str, str]) -> str:
    kinds = {"int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}
    return ", ".join(f'CAST({own.get(n, "NULL")} AS {kinds[k]}) AS "{n}"' for n, (k, _) in columns.items())


PEAK_SQL = {
    "schema_version": "2", "trace_id": "l_orderkey", "peak_no": "l_linenumber", "label": "l_returnflag", "mode": "'drop'", "rt": "l_quantity + l_linenumber / 10.0", "height": "l_quantity", "area": "l_extendedprice",
    "fwhm": "1 + l_discount", "area_pct": "round(100 * l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6)",
    "resolution": "round(1.18 * (l_quantity + l_linenumber / 10.0 - lag(l_quantity + l_linenumber / 10.0) OVER w) / (1 + l_discount + lag(1 + l_discount) OVER w), 6) + 0.0", "flags": "''",
}


@query(f"""SELECT {_sql_columns(exports.PEAK_COLUMNS, PEAK_SQL)} FROM lineitem WHERE l_linestatus = 'F' WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity + l_linenumber / 10.0, l_linenumber, 1 + l_discount, l_extendedprice)""")
def exported_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak rows with all columns of the export; line items stand for peaks, those of status F for peaks of signals."""
    p = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").cast("int").alias("peak_no"), F.col("l_returnflag").alias("label"), F.lit("drop").alias("mode"), F.col("l_extendedprice").alias("area"),
        F.col("l_quantity").alias("height"), (F.col("l_quantity") + F.col("l_linenumber") / 10.0).alias("rt"), (1 + F.col("l_discount")).alias("fwhm"), F.when(F.col("l_linestatus") == "F", "signal").otherwise("pressure").alias("role"),
    )
    m = metrics.peak_list_metrics(p.filter("role = 'signal'")).withColumns({c: r(c) for c in ("area_pct", "resolution")})
    return exports.peak_rows(m, {"x": "min", "y": "mAU", "conc": "mg/L"})


@query(f"""WITH {EMB} SELECT trace_id, CAST(arg_min(i, struct_pack(y := y, i := i)) FILTER (WHERE i BETWEEN 17 AND 23) AS DOUBLE) AS start, CAST(arg_min(i, struct_pack(y := y, i := i)) FILTER (WHERE i BETWEEN 37 AND 43) AS DOUBLE) AS "end" FROM e GROUP BY trace_id""")
def refined_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bounds of one window on every trace, each moved to the lowest sample nearby."""
    found = peaks.refined_bounds(F.col("x"), F.col("y"), F.lit(20.0), F.lit(40.0))
    return views.embeddings(spark, sf_dir).select("trace_id", F.inline(F.array(found)))


@query(f"""WITH {EMB} SELECT trace_id, round(median(y), 6) + 0.0 AS middle FROM e GROUP BY trace_id""")
def medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.embeddings(spark, sf_dir).select("trace_id", r(S.median(F.col("y"))).alias("middle"))


@query(f"""WITH {EMB}, g AS (SELECT *, greatest(i - 2, 0) AS t FROM e WHERE i = trace_id % 64)
SELECT trace_id, CAST(i AS DOUBLE) AS x, round(y, 6) + 0.0 AS y, CAST(CASE WHEN t < 20 THEN 5 + 4.5 * t WHEN t < 40 THEN 95 - 4.5 * (t - 20) ELSE 5 END AS DOUBLE) AS b FROM g""")
def cursor_read_outs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cursor reads out at a place of each trace, with the solvent program's %B there."""
    at = (F.col("trace_id") % 64).cast("double") + 0.3
    found = gradient.read_out(F.col("x"), F.col("y"), at, [(0.0, 5.0), (20.0, 95.0), (40.0, 5.0)], 2.0)
    return views.embeddings(spark, sf_dir).select("trace_id", F.inline(F.array(found))).select("trace_id", "x", r("y").alias("y"), r("b").alias("b"))


@query("""SELECT c_custkey || ',"' || replace(c_name || ', "' || c_nationkey || '"', '"', '""') || '",' || coalesce(CAST(CASE WHEN c_custkey % 7 > 0 THEN c_acctbal END AS VARCHAR), '') || ',' || c_nationkey AS line FROM customer""")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as lines of CSV: quoted texts, numbers, missing values."""
    c = views.table(spark, sf_dir, "customer")
    said = F.concat("c_name", F.lit(', "'), F.col("c_nationkey").cast("string"), F.lit('"'))
    return exports.csv_lines(c.select("c_custkey", said.alias("said"), F.when(F.col("c_custkey") % 7 > 0, F.col("c_acctbal").cast("double")).alias("y"), "c_nationkey"), ["c_custkey"])


@query("""SELECT c_custkey AS trace_id, CASE WHEN c_nationkey % 3 = 0 THEN 'min' ELSE 'ml' END AS x_unit FROM customer WHERE (c_custkey % 4 <> 1) AND c_nationkey % 3 = 0 AND c_acctbal >= 0 AND c_custkey IN (SELECT o_custkey FROM orders)""")
def scoped_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of customers as traces those that an export is about: visible (every fourth isn't, every fourth doesn't say), signals in minutes, with orders."""
    k = F.col("c_custkey")
    t = views.table(spark, sf_dir, "customer").select(
        k.alias("trace_id"), F.when(k % 4 == 0, F.lit(None).cast("boolean")).otherwise(k % 4 != 1).alias("visible"), F.when(F.col("c_acctbal") < 0, "pressure").when(k % 2 == 0, "signal").alias("role"), F.when(F.col("c_nationkey") % 3 == 0, "min").otherwise("ml").alias("x_unit"),
    )
    ids = views.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("trace_id"))
    return tables.visible_signals(exports.in_scope(t, "visible", ids=ids), "min").select("trace_id", "x_unit")


@query("""WITH s AS (SELECT o_orderkey, o_totalprice AS v, pow(10, floor(log10(o_totalprice)) - 3) AS u FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 999950)
SELECT o_orderkey, CAST(CAST(floor(v / u + 0.5) * u AS BIGINT) AS VARCHAR) AS shown FROM s""")
def displayed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as a table shows them, with four significant digits."""
    t = views.table(spark, sf_dir, "orders").filter("o_totalprice >= 1000 and o_totalprice < 999950")
    return t.select("o_orderkey", scalars.formatted(F.col("o_totalprice").cast("double")).alias("shown"))


@query("""WITH c AS (SELECT * FROM customer), f AS (
  SELECT 'error' AS kind, 'x and y differ in length' AS what FROM c WHERE c_nationkey % 2 = 1 UNION ALL SELECT 'error', 'bounds of a peak are out of order' FROM c WHERE c_acctbal < 0
  UNION ALL SELECT 'warning', 'version 3 is newer than 2' FROM c WHERE c_custkey % 10 = 0 UNION ALL SELECT 'warning', 'x is not ascending' FROM c WHERE c_custkey % 3 = 0
  UNION ALL SELECT 'trace', 'valley' FROM c WHERE c_nationkey % 2 = 0 AND c_acctbal >= 0 AND c_custkey % 10 = 1 UNION ALL SELECT 'trace', 'none' FROM c WHERE c_nationkey % 2 = 0 AND c_acctbal >= 0 AND c_custkey % 10 <> 1)
SELECT kind, what, count(*) AS n FROM f GROUP BY kind, what""")
def checked_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of customers checked, migrated and read: what is wrong with them, and the modes of the peaks that are read."""
    c, k = views.dealt(views.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")), F.col("c_custkey")
    peak = F.struct(F.lit(0.0).alias("start"), F.lit(1.0).alias("apex"), F.when(F.col("c_acctbal") < 0, 0.5).otherwise(2.0).alias("end"))
    x = F.when(k % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))
    y = F.when(F.col("c_nationkey") % 2 == 1, F.array("c_acctbal")).otherwise(F.array("c_acctbal", "c_acctbal"))
    version = F.when(k % 10 == 0, 3).when(k % 10 == 1, 1).otherwise(2)  # of version 1, peaks have no mode yet
    text = F.to_json(F.struct(version.alias("version"), F.array(F.struct(k.alias("id"), x.alias("x"), y.alias("y"), F.array(peak).alias("peaks"))).alias("traces")))
    read = frames.settled(projects.read_projects(c.select(k.cast("string").alias("path"), text.alias("content"))))
    bare = lambda what: F.regexp_replace(what, r"^trace \S+: ", "")
    listed = [read.select(F.lit(kind).alias("kind"), F.explode(F.transform(column, bare)).alias("what")) for kind, column in (("error", "errors"), ("warning", "warnings"))]
    modes = read.filter("trace_id is not null").select(F.lit("trace").alias("kind"), F.coalesce(F.get("peaks", F.lit(0))["mode"], F.lit("none")).alias("what"))
    return listed[0].unionByName(listed[1]).unionByName(modes).groupBy("kind", "what").agg(F.count("*").alias("n"))


RESULT_SQL = {
    "schema_version": "2", "trace_id": "l_orderkey", "trace_name": "'order ' || l_orderkey", "peak_no": "l_linenumber", "peak_id": "l_orderkey || '-' || l_linenumber", "label": "l_linestatus", "manual": "l_linenumber = 1", "shoulder": "l_discount = 0",
    "mode": "'drop'", "requested_mode": "'valley'", "cluster": "cluster", "cluster_size": "count(*) OVER (PARTITION BY l_orderkey, cluster)", "host": "nullif(l_linenumber - 1, 0)", "start": "round(rt - 1, 6)", "apex": "round(rt, 6)", "end": "round(rt + 1, 6)",
    "rt": "round(rt, 6)", "height": "l_quantity", "area": "l_extendedprice", "gross_area": "round(l_extendedprice + 10 * l_tax, 6)", "baseline_area": "round(10 * l_tax, 6)", "fwhm": "round(1 + l_discount, 6)", "w10": "round(1.8 * (1 + l_discount), 6)", "w5": "round(2 * (1 + l_discount), 6)",
    "tailing": "1.5", "asymmetry": "1.25", "plates": "round(5.54 * pow(rt / (1 + l_discount), 2), 4)", "plates_usp": "round(16 * pow(rt / (2 * (1 + l_discount)), 2), 4)", "k": "round((rt - 0.5) / 0.5, 6)", "sn": "round(2 * l_quantity / 0.5, 6)",
    "area_pct": "round(100 * l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6)", "resolution": "round(1.18 * (rt - lag(rt) OVER w) / (1 + l_discount + lag(1 + l_discount) OVER w), 6) + 0.0",
    "elution_b": "round(b, 6) + 0.0", "elution_conc": "round(5 * b, 6) + 0.0", "analyte": "l_returnflag", "conc": "round(conc, 4) + 0.0", "conc_lo": "round(conc - t * se, 4) + 0.0", "conc_hi": "round(conc + t * se, 4) + 0.0",
    "conc_flags": "concat_ws(';', CASE WHEN conc < x_min OR conc > x_max THEN 'extrapolated' END, CASE WHEN conc < 3.3 * s / abs(b1) THEN 'below_LOD' WHEN conc < 10 * s / abs(b1) THEN 'below_LOQ' END)", "flags": "''",
}


@query(f"""WITH p AS (SELECT *, 50 * l_quantity + l_extendedprice / 1000 AS v, l_quantity + l_linenumber / 10.0 AS rt, greatest(l_quantity + l_linenumber / 10.0 - 3, 0) AS g FROM lineitem),
f AS (SELECT l_returnflag, count(*) AS n, avg(l_quantity) AS mx, regr_sxx(v, l_quantity) AS sxx, regr_slope(v, l_quantity) AS b1, regr_intercept(v, l_quantity) AS b0, min(l_quantity) AS x_min, max(l_quantity) AS x_max FROM p GROUP BY l_returnflag),
e AS (SELECT f.l_returnflag, sqrt(sum(pow(v - b0 - b1 * l_quantity, 2)) / (max(n) - 2)) AS s FROM p JOIN f USING (l_returnflag) GROUP BY f.l_returnflag),
q AS (SELECT p.*, f.* EXCLUDE (l_returnflag), s, (v - b0) / b1 AS conc, CASE WHEN g < 30 THEN 5 + 3 * g WHEN g < 60 THEN 95 - 3 * (g - 30) ELSE 5 END AS b,
  1.959963984540054 + (pow(1.959963984540054, 3) + 1.959963984540054) / (4.0 * (n - 2)) + (5 * pow(1.959963984540054, 5) + 16 * pow(1.959963984540054, 3) + 3 * 1.959963984540054) / (96 * pow(n - 2, 2)) AS t FROM p JOIN f USING (l_returnflag) JOIN e USING (l_returnflag)),
r AS (SELECT *, s * sqrt(1 + 1.0 / n + pow(conc - mx, 2) / sxx) / abs(b1) AS se, max(rt + 1) OVER (PARTITION BY l_orderkey ORDER BY rt - 1, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM q),
c AS (SELECT *, sum(CASE WHEN reach IS NULL OR rt - 1 - reach > 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY rt - 1, l_linenumber) AS cluster FROM r)
SELECT {_sql_columns(exports.PEAK_COLUMNS, RESULT_SQL)} FROM c WINDOW w AS (PARTITION BY l_orderkey ORDER BY rt, l_linenumber, 1 + l_discount, l_extendedprice)""")
def exported_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak rows with every column of the export filled: clusters, figures, elution, and concentrations with intervals and flags from the
    calibration of each line's return flag. Line items stand for peaks."""
    t = views.table(spark, sf_dir, "lineitem")
    rt, wide = F.col("l_quantity") + F.col("l_linenumber") / 10.0, 1 + F.col("l_discount")
    same = {"trace_id": "l_orderkey", "peak_no": "l_linenumber", "label": "l_linestatus", "height": "l_quantity", "area": "l_extendedprice", "analyte": "l_returnflag"}
    peaks_ = t.select(
        *[F.col(c).alias(n) for n, c in same.items()], F.concat(F.lit("order "), "l_orderkey").alias("trace_name"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("peak_id"), (F.col("l_linenumber") == 1).alias("manual"),
        (F.col("l_discount") == 0).alias("shoulder"), F.lit("drop").alias("mode"), F.lit("valley").alias("requested_mode"), F.nullif(F.col("l_linenumber") - 1, F.lit(0)).alias("host"), (rt - 1).alias("start"), rt.alias("apex"), (rt + 1).alias("end"), rt.alias("rt"),
        (F.col("l_extendedprice") + 10 * F.col("l_tax")).alias("gross_area"), (10 * F.col("l_tax")).alias("baseline_area"), wide.alias("fwhm"), (1.8 * wide).alias("w10"), (2 * wide).alias("w5"), F.lit(1.5).alias("tailing"), F.lit(1.25).alias("asymmetry"),
        (5.54 * F.pow(rt / wide, 2)).alias("plates"), (16 * F.pow(rt / (2 * wide), 2)).alias("plates_usp"), ((rt - 0.5) / 0.5).alias("k"), (2 * F.col("l_quantity") / 0.5).alias("sn"),
    )
    p = metrics.peak_list_metrics(integration.touching_clusters(peaks_, F.lit(0.25)))
    p = p.withColumn("cluster_size", F.count("*").over(Window.partitionBy("trace_id", "cluster")))
    b = gradient.b_at_elution([(0.0, 5.0), (30.0, 95.0), (60.0, 5.0)], F.col("rt"), 1.0, 2.0)
    p = p.withColumns({"elution_b": b, "elution_conc": gradient.concentration(b, 0.0, 500.0)})
    points = t.select(F.col("l_returnflag").alias("analyte"), F.col("l_quantity").alias("x"), (50 * F.col("l_quantity") + F.col("l_extendedprice") / 1000).alias("y"), F.lit(True).alias("include"))
    fits = frames.facts(calibration.fit(points, "analyte"))
    p = calibration.inverse(p.join(fits, "analyte"), 50 * F.col("height") + F.col("area") / 1000)
    p = p.withColumn("ci", fitting.confidence(F.col("conc"), F.col("conc_se"), F.col("n") - 2)).withColumns({"conc_lo": F.col("ci.low"), "conc_hi": F.col("ci.high")})
    rounded = {c: r(c, 4 if c.startswith(("conc", "plates")) else 6) for c in ("start", "apex", "end", "rt", "gross_area", "baseline_area", "fwhm", "w10", "w5", "plates", "plates_usp", "k", "sn", "area_pct", "resolution", "elution_b", "elution_conc", "conc", "conc_lo", "conc_hi")}
    return exports.peak_rows(p.withColumns(rounded), {"x": "min", "y": "mAU", "conc": "mg/L"})


TRACE_SQL = {
    "schema_version": "2", "trace_id": "trace_id", "trace_name": "'trace ' || trace_id", "role": "'signal'", "digitized": "false", "x_unit": "'min'", "n_points": "n", "x_min": "0", "x_max": "n - 1", "y_min": "round(lo, 6) + 0.0", "y_max": "round(hi, 6) + 0.0",
    "noise": "round(CASE WHEN s > 0 THEN s ELSE rms END, 6)", "p2p": "round(6 * CASE WHEN s > 0 THEN s ELSE rms END, 5)", "n_peaks": "coalesce(k, 0)", "total_area": "round(total, 4)", "largest_rt": "rt", "largest_area_pct": "round(pct, 6)",
}


@query(f"""WITH {EMB}, d AS (SELECT trace_id, y - lag(y) OVER (PARTITION BY trace_id ORDER BY i) AS d FROM e), m AS (SELECT trace_id, median(d) AS m FROM d WHERE d IS NOT NULL GROUP BY trace_id),
z AS (SELECT trace_id, 1.4826 * median(abs(d - m)) / sqrt(2) AS s, sqrt(avg(d * d) / 2) AS rms FROM d JOIN m USING (trace_id) WHERE d IS NOT NULL GROUP BY trace_id),
b AS (SELECT trace_id, min(y) AS lo, max(y) AS hi FROM e GROUP BY trace_id),
p AS (SELECT o_orderkey % 500 AS trace_id, o_totalprice AS area, o_orderkey / 100.0 AS rt FROM orders WHERE o_orderkey % 500 <> 3),
q AS (SELECT *, 100 * area / sum(area) OVER (PARTITION BY trace_id) AS pct FROM p), g AS (SELECT trace_id, count(*) AS k, sum(area) AS total, arg_max(rt, pct) AS rt, max(pct) AS pct FROM q GROUP BY trace_id),
j AS (SELECT n.trace_id, n.n, lo, hi, s, rms, k, total, rt, pct FROM n JOIN z USING (trace_id) JOIN b USING (trace_id) LEFT JOIN g USING (trace_id))
SELECT {_sql_columns(exports.TRACE_COLUMNS, TRACE_SQL)} FROM j""")
def exported_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace rows with all columns of the export; orders stand for the peaks of traces."""
    t = views.embeddings(spark, sf_dir).withColumns({"trace_name": F.concat(F.lit("trace "), F.col("trace_id").cast("string")), "role": F.lit("signal"), "digitized": F.lit(False), "x_unit": F.lit("min")})
    p = views.table(spark, sf_dir, "orders").filter("o_orderkey % 500 <> 3").select((F.col("o_orderkey") % 500).alias("trace_id"), F.col("o_totalprice").alias("area"), (F.col("o_orderkey") / 100.0).alias("rt"))
    p = p.withColumn("area_pct", 100 * F.col("area") / F.sum("area").over(Window.partitionBy("trace_id")))
    out = exports.trace_rows(t, p, {"x": "min", "y": "mAU"})
    digits = {"y_min": 6, "y_max": 6, "noise": 6, "p2p": 5, "total_area": 4, "largest_area_pct": 6}
    return out.withColumns({c: r(c, k) for c, k in digits.items()})


@query("""WITH c AS (SELECT p_brand AS analyte, p_partkey AS level, CAST(p_size AS DOUBLE) AS x, CASE WHEN p_partkey % 7 <> 0 THEN p_retailprice END AS y, p_partkey % 5 <> 0 AS inc FROM part),
m AS (SELECT analyte, count(*) AS n, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, regr_sxx(y, x) AS sxx, min(x) AS lo, max(x) AS hi FROM c WHERE inc AND y IS NOT NULL GROUP BY analyte),
s AS (SELECT analyte, sqrt(sum(pow(y - b0 - b1 * x, 2)) / (max(n) - 2)) AS s FROM c JOIN m USING (analyte) WHERE inc AND y IS NOT NULL GROUP BY analyte),
q AS (SELECT c.*, b0, b1, (y - b0) / b1 AS back, lo, hi, 3.3 * s / abs(b1) AS lod, 10 * s / abs(b1) AS loq FROM c LEFT JOIN m USING (analyte) LEFT JOIN s USING (analyte))
SELECT analyte, CAST(level AS VARCHAR) AS level, CAST(NULL AS VARCHAR) AS label, x AS conc, y AS response, inc AS included, round(b0 + b1 * x, 4) AS fitted, round(y - b0 - b1 * x, 4) + 0.0 AS residual,
  round(sign(back) * ln(1 + abs(back)), 4) + 0.0 AS back_conc, round(sign(back / x) * ln(1 + abs(100 * back / x)), 4) + 0.0 AS recovery_pct,
  CASE WHEN y IS NOT NULL THEN concat_ws(';', CASE WHEN back < lo OR back > hi THEN 'extrapolated' END, CASE WHEN back < lod THEN 'below_LOD' WHEN back < loq THEN 'below_LOQ' END) ELSE '' END AS flags, CASE WHEN y IS NULL THEN 'no response' END AS missing FROM q""")
def exported_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration rows: every level beside its curve (the back-calculated concentration and the recovery as signed
    logarithms, as the curves of this table are nearly flat)."""
    p = views.table(spark, sf_dir, "part")
    levels = p.select(
        F.col("p_brand").alias("analyte"), F.col("p_partkey").alias("level"), F.col("p_size").cast("double").alias("conc"), F.lit(None).cast("long").alias("trace_id"), F.when(F.col("p_partkey") % 7 != 0, F.col("p_retailprice")).alias("response"), (F.col("p_partkey") % 5 != 0).alias("include")
    )
    none = levels.select("analyte", "trace_id", "response").limit(0)
    points = calibration.calibration_points(levels, none)
    rows = calibration.level_rows(points, calibration.fit(points, "analyte"))
    log = lambda c: r(F.signum(c) * F.log1p(F.abs(F.col(c))), 4)
    rows = rows.withColumns({"fitted": r("fitted", 4), "residual": r("residual", 4), "back_conc": log("back_conc"), "recovery_pct": log("recovery_pct")})
    return exports.fixed(rows, exports.CALIBRATION_COLUMNS, {"conc": "mg/L"})
