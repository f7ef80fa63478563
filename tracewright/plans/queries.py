"""Registered queries on the given tables and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import calibration, gradient, integration, matching, metrics, peaks, tables
from ..operators import signal as S
from . import views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a function under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6):
    """Rounded, with null for what isn't a number and without a negative zero."""
    return F.when(F.isnan(c), None).otherwise(F.round(c, digits) + F.lit(0.0))


EMB = """e AS (SELECT vec_id AS trace_id, CAST(unnest(embedding) AS DOUBLE) AS y, CAST(generate_subscripts(embedding, 1) - 1 AS BIGINT) AS i
  FROM embeddings), n AS (SELECT trace_id, count(*) AS n FROM e GROUP BY trace_id)"""
#: The weights of a quadratic over five samples at each place of the window, times 35.
SG5 = """sg AS (SELECT * FROM (VALUES
  (0,0,31),(0,1,9),(0,2,-3),(0,3,-5),(0,4,3),(1,0,9),(1,1,13),(1,2,12),(1,3,6),(1,4,-5),(2,0,-3),(2,1,12),(2,2,17),(2,3,12),(2,4,-3),
  (3,0,-5),(3,1,6),(3,2,12),(3,3,13),(3,4,9),(4,0,3),(4,1,-5),(4,2,-3),(4,3,9),(4,4,31)) AS v(r, k, c)),
sm AS (SELECT e.trace_id, e.i, sum(f.y * sg.c) / 35.0 AS y FROM e JOIN n USING (trace_id)
  JOIN sg ON sg.r = e.i - greatest(0, least(e.i - 2, n.n - 5))
  JOIN e f ON f.trace_id = e.trace_id AND f.i = greatest(0, least(e.i - 2, n.n - 5)) + sg.k GROUP BY e.trace_id, e.i)"""
NOISE = """d AS (SELECT trace_id, y - lag(y) OVER (PARTITION BY trace_id ORDER BY i) AS d FROM e),
md AS (SELECT trace_id, median(d) AS m FROM d WHERE d IS NOT NULL GROUP BY trace_id),
sig AS (SELECT trace_id, 1.4826 * median(abs(d - m)) / sqrt(2.0) AS sigma FROM d JOIN md USING (trace_id) WHERE d IS NOT NULL GROUP BY trace_id)"""


@query(f"""WITH {EMB}, {SG5}, {NOISE},
a AS (SELECT trace_id, sum((y + nx) / 2) AS area, max(y) AS top FROM (SELECT trace_id, y, lead(y) OVER (PARTITION BY trace_id ORDER BY i) AS nx FROM sm) GROUP BY trace_id)
SELECT trace_id, round(area, 6) + 0.0 AS area, round(top, 6) + 0.0 AS height, round(sigma, 6) + 0.0 AS sigma, round(2 * top / (6 * sigma), 4) + 0.0 AS sn FROM a JOIN sig USING (trace_id)""")
def trace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smooth, then area, height, noise and signal to noise of every trace."""
    t = views.embeddings(spark, sf_dir).withColumn("s", S.savgol(F.col("y"), 5, 2))
    t = t.select("trace_id", S.trapezoid(F.col("x"), F.col("s")).alias("area"), F.array_max("s").alias("height"), S.noise_sigma(F.col("y"), floor=False).alias("sigma"))
    return t.select("trace_id", r("area").alias("area"), r("height").alias("height"), r("sigma").alias("sigma"), r(2 * F.col("height") / (6 * F.col("sigma")), 4).alias("sn"))


@query(f"WITH {EMB}, {SG5} SELECT trace_id, CAST(i AS INTEGER) AS i, round(y, 6) + 0.0 AS y FROM sm")
def savgol_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.embeddings(spark, sf_dir).withColumn("y", S.savgol(F.col("y"), 5, 2))
    return views.points(t).select("trace_id", "i", r("y").alias("y"))


@query(f"""WITH {EMB}, c AS (SELECT e.trace_id, e.i, greatest(0, least(e.i - 2, n.n - 5)) AS s FROM e JOIN n USING (trace_id))
SELECT c.trace_id, CAST(c.i AS INTEGER) AS i, round(sum(f.y * (CASE f.i - c.s WHEN 0 THEN -2 WHEN 1 THEN -1 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE 2 END) / 10.0
  + 2 * (c.i - c.s - 2) * f.y * (CASE f.i - c.s WHEN 0 THEN 2 WHEN 1 THEN -1 WHEN 2 THEN -2 WHEN 3 THEN -1 ELSE 2 END) / 14.0), 6) + 0.0 AS dy
FROM c JOIN e f ON f.trace_id = c.trace_id AND f.i BETWEEN c.s AND c.s + 4 GROUP BY c.trace_id, c.i""")
def savgol_derivative(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.embeddings(spark, sf_dir).withColumn("y", S.savgol(F.col("y"), 5, 2, deriv=1))
    return views.points(t).select("trace_id", "i", r("y").alias("dy"))


@query(f"""WITH {EMB}, {NOISE}, z AS (SELECT trace_id, count(*) AS m, count(*) FILTER (WHERE d = 0) AS zeros, list_sort(list(abs(d)) FILTER (WHERE d <> 0)) AS s FROM d WHERE d IS NOT NULL GROUP BY trace_id)
SELECT trace_id, round(sigma, 6) + 0.0 AS sigma, round(6 * sigma, 6) + 0.0 AS p2p,
  CASE WHEN zeros * 5 >= m AND len(s) > 0 THEN round(s[CAST(floor((len(s) - 1) * 0.1) AS BIGINT) + 1], 6) END AS quantum FROM sig JOIN z USING (trace_id)""")
def noise_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.embeddings(spark, sf_dir).withColumn("s", S.noise_sigma(F.col("y"), floor=False))
    return t.select("trace_id", r("s").alias("sigma"), r(6 * F.col("s")).alias("p2p"), r(S.quantum(F.col("y"))).alias("quantum"))


@query(f"""WITH {EMB}, f AS (SELECT trace_id, count(*) AS m, regr_slope(y, i) AS b, regr_intercept(y, i) AS a FROM e WHERE i BETWEEN 8 AND 40 GROUP BY trace_id)
SELECT trace_id, round(sqrt(sum(pow(y - a - b * i, 2)) / (m - 2)), 6) + 0.0 AS sigma, round(max(y - a - b * i) - min(y - a - b * i), 6) + 0.0 AS p2p
FROM e JOIN f USING (trace_id) WHERE i BETWEEN 8 AND 40 GROUP BY trace_id, m""")
def noise_in_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.embeddings(spark, sf_dir).withColumn("z", S.noise_in_range(F.col("x"), F.col("y"), 8, 40))
    return t.select("trace_id", r("z.sigma").alias("sigma"), r("z.p2p").alias("p2p"))


@query(f"""WITH {EMB}, l AS (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS q FROM e WINDOW w AS (PARTITION BY trace_id ORDER BY i))
SELECT trace_id, CAST(i AS INTEGER) AS i, round(y, 6) + 0.0 AS y FROM l WHERE y > p AND y > q""")
def local_maxima(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.embeddings(spark, sf_dir).withColumn("i", F.explode(S.local_maxima(F.col("y"))))
    return t.select("trace_id", "i", r(F.get("y", F.col("i"))).alias("y"))


@query(f"""WITH {EMB}, g AS (SELECT trace_id, k, k * 63.0 / 99.0 AS t FROM n, range(100) AS q(k))
SELECT g.trace_id, CAST(k AS INTEGER) AS k, round(a.y + coalesce((b.y - a.y) * (t - a.i), 0.0), 6) + 0.0 AS y FROM g
JOIN e a ON a.trace_id = g.trace_id AND a.i = CAST(floor(t) AS BIGINT) LEFT JOIN e b ON b.trace_id = g.trace_id AND b.i = CAST(floor(t) AS BIGINT) + 1""")
def resampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.embeddings(spark, sf_dir).withColumn("y", S.resample(F.col("x"), F.col("y"), 100))
    return t.select("trace_id", F.posexplode("y").alias("k", "y")).select("trace_id", "k", r("y").alias("y"))


@query(f"""WITH {EMB}, a AS (SELECT trace_id, max(y) AS top, sum((y + nx) / 2) AS area, max(abs(y)) AS big FROM (SELECT *, lead(y) OVER (PARTITION BY trace_id ORDER BY i) AS nx FROM e) GROUP BY trace_id)
SELECT trace_id, CAST(i AS INTEGER) AS i, round(CASE WHEN top > 0 THEN y / top ELSE y END, 6) + 0.0 AS by_max, round(CASE WHEN area > 0 THEN y / area ELSE y END, 4) + 0.0 AS by_area, round(CASE WHEN big > 0 THEN y / big ELSE y END, 6) + 0.0 AS by_size
FROM e JOIN a USING (trace_id)""")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    t = views.embeddings(spark, sf_dir).select("trace_id", S.normalize(x, y, "max").alias("a"), S.normalize(x, y, "area").alias("b"), S.normalize(x, y, "max", absolute=True).alias("c"))
    rows = t.select("trace_id", F.posexplode(F.arrays_zip("a", "b", "c")).alias("i", "s"))
    return rows.select("trace_id", "i", r("s.a").alias("by_max"), r("s.b", 4).alias("by_area"), r("s.c").alias("by_size"))


@query(f"""WITH {EMB}, pair AS (SELECT trace_id, trace_id + 1 AS other FROM n WHERE trace_id + 1 IN (SELECT trace_id FROM n))
SELECT p.trace_id, CAST(a.i AS INTEGER) AS i, round(a.y - CASE WHEN a.i >= 1 THEN c.y + (b.y - c.y) * 0.5 END, 6) + 0.0 AS y FROM pair p JOIN e a ON a.trace_id = p.trace_id
LEFT JOIN e b ON b.trace_id = p.other AND b.i = a.i LEFT JOIN e c ON c.trace_id = p.other AND c.i = a.i - 1""")
def difference_to_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every trace minus the one after it, which is moved by half a sample."""
    t = views.embeddings(spark, sf_dir)
    b = t.select((F.col("trace_id") - 1).alias("trace_id"), S.align(F.col("x"), F.lit(0.5)).alias("bx"), F.col("y").alias("by"))
    both = t.join(b, "trace_id")
    rows = both.select("trace_id", F.posexplode(S.difference(F.col("x"), F.col("y"), F.col("bx"), F.col("by"))).alias("i", "y"))
    return rows.select("trace_id", "i", r("y").alias("y"))


@query("""WITH p AS (SELECT user_id AS trace_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us, value FROM events WHERE value IS NOT NULL),
l AS (SELECT trace_id, us / 60e6 AS x, value AS y, lead(us) OVER w / 60e6 AS nx, lead(value) OVER w AS ny FROM p WINDOW w AS (PARTITION BY trace_id ORDER BY us, value))
SELECT trace_id, count(*) AS n, round(coalesce(sum((ny + y) / 2 * (nx - x)), 0.0), 2) + 0.0 AS area, round(min(x), 6) AS first_x, round(max(x), 6) AS last_x, round(max(y), 6) AS top FROM l GROUP BY trace_id""")
def user_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces with uneven places, built from rows, and their areas."""
    t = views.traces(views.event_samples(spark, sf_dir))
    return t.select("trace_id", F.size("x").cast("long").alias("n"), r(S.trapezoid(F.col("x"), F.col("y")), 2).alias("area"), r(F.array_min("x")).alias("first_x"), r(F.array_max("x")).alias("last_x"), r(F.array_max("y")).alias("top"))


WINDOW = f"""{EMB}, bounds AS (SELECT 10.5 AS s, 30.25 AS t),
ends AS (SELECT a.trace_id, a.y + (b.y - a.y) * 0.5 AS ys, c.y + (d.y - c.y) * 0.25 AS yt FROM e a JOIN e b USING (trace_id) JOIN e c USING (trace_id) JOIN e d USING (trace_id) WHERE a.i = 10 AND b.i = 11 AND c.i = 30 AND d.i = 31),
nodes AS (SELECT trace_id, CAST(i AS DOUBLE) AS x, y FROM e WHERE i BETWEEN 11 AND 30 UNION ALL SELECT trace_id, 10.5, ys FROM ends UNION ALL SELECT trace_id, 30.25, yt FROM ends),
net AS (SELECT trace_id, x, y - (ys + (yt - ys) * (x - 10.5) / 19.75) AS h FROM nodes JOIN ends USING (trace_id))"""


@query(f"""WITH {WINDOW}, l AS (SELECT *, lead(x) OVER w AS nx, lead(h) OVER w AS nh FROM net WINDOW w AS (PARTITION BY trace_id ORDER BY x))
SELECT trace_id, round(sum((h + nh) / 2 * (nx - x)), 6) + 0.0 AS area, round(max_by(x, h), 6) + 0.0 AS apex FROM l GROUP BY trace_id""")
def window_integrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manual window on every trace, above its chord."""
    t = integration.window_on_all(views.embeddings(spark, sf_dir), 10.5, 30.25)
    return t.select("trace_id", r("area").alias("area"), r("apex").alias("apex"))


@query(f"""WITH {WINDOW.replace("net AS", "cut AS (SELECT trace_id, y AS ym FROM e WHERE i = 20), whole AS")},
parts AS (SELECT trace_id, 1 AS part, x, y FROM nodes WHERE x <= 20 UNION ALL SELECT trace_id, 2, x, y FROM nodes WHERE x >= 20),
h AS (SELECT trace_id, part, x, y, y - (ys + (yt - ys) * (x - 10.5) / 19.75) AS above, y - CASE WHEN part = 1 THEN ys + (ym - ys) * (x - 10.5) / 9.5 ELSE ym + (yt - ym) * (x - 20) / 10.25 END AS own FROM parts JOIN ends USING (trace_id) JOIN cut USING (trace_id)),
l AS (SELECT *, lead(x) OVER w AS nx, lead(above) OVER w AS na, lead(own) OVER w AS no FROM h WINDOW w AS (PARTITION BY trace_id, part ORDER BY x))
SELECT trace_id, part, round(sum((own + no) / 2 * (nx - x)), 6) + 0.0 AS valley, round(sum((above + na) / 2 * (nx - x)), 6) + 0.0 AS "drop" FROM l GROUP BY trace_id, part""")
def split_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window cut in two: areas above the chord of each part, and above that of both."""
    t = views.embeddings(spark, sf_dir)
    x, y = F.col("x"), F.col("y")
    figures = [F.struct(F.lit(k).alias("part"), integration.chord_area(x, y, F.lit(a), F.lit(b)).alias("valley"), integration.drop_area(x, y, F.lit(a), F.lit(b), F.lit(10.5), F.lit(30.25)).alias("drop")) for k, a, b in ((1, 10.5, 20.0), (2, 20.0, 30.25))]
    rows = t.select("trace_id", F.explode(F.array(*figures)).alias("f"))
    return rows.select("trace_id", "f.part", r("f.valley").alias("valley"), r("f.drop").alias("drop"))


@query(f"""WITH {EMB}, w AS (SELECT trace_id, i, y FROM e WHERE i BETWEEN 11 AND 30),
under AS (SELECT DISTINCT p.trace_id, p.i FROM w p JOIN w a ON a.trace_id = p.trace_id AND a.i < p.i JOIN w b ON b.trace_id = p.trace_id AND b.i > p.i WHERE p.y > a.y + (b.y - a.y) * (p.i - a.i) / (b.i - a.i)),
node AS (SELECT w.trace_id, w.i, w.y FROM w LEFT JOIN under u ON u.trace_id = w.trace_id AND u.i = w.i WHERE u.i IS NULL),
edge AS (SELECT trace_id, i AS a, y AS ya, lead(i) OVER v AS b, lead(y) OVER v AS yb FROM node WINDOW v AS (PARTITION BY trace_id ORDER BY i)),
base AS (SELECT w.trace_id, w.i, w.y - (ya + (yb - ya) * (w.i - a) / (b - a)) AS h FROM w JOIN edge ON edge.trace_id = w.trace_id AND ((w.i >= a AND w.i < b) OR (w.i = 30 AND b = 30))),
hull AS (SELECT trace_id, sum((h + n) / 2) AS hull FROM (SELECT *, lead(h) OVER (PARTITION BY trace_id ORDER BY i) AS n FROM base) GROUP BY trace_id),
low AS (SELECT trace_id, y AS y0 FROM e WHERE i = 20), slope AS (SELECT e.trace_id, min((y - y0) / (i - 20)) AS s FROM e JOIN low USING (trace_id) WHERE i BETWEEN 24 AND 26 GROUP BY e.trace_id),
skim AS (SELECT trace_id, sum((h + n) / 2) AS skim FROM (SELECT *, lead(h) OVER (PARTITION BY trace_id ORDER BY i) AS n FROM (SELECT e.trace_id, i, y - (y0 + s * (i - 20)) AS h FROM e JOIN low USING (trace_id) JOIN slope USING (trace_id) WHERE i BETWEEN 20 AND 26)) GROUP BY trace_id)
SELECT trace_id, round(hull, 6) + 0.0 AS hull, round(skim, 6) + 0.0 AS skim FROM hull JOIN skim USING (trace_id)""")
def hulls_and_skims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of a window above its lower hull, and that of a rider above the tangent from its valley."""
    t, x, y = views.embeddings(spark, sf_dir), F.col("x"), F.col("y")
    at = lambda v: F.lit(float(v))
    t = t.withColumn("hull", integration.hull_area(x, y, at(11), at(30), at(11), at(30))).withColumn("skim", integration.tangent_skim(x, y, at(20), at(26), at(20), at(23), at(26)))
    return t.select("trace_id", r("hull").alias("hull"), r("skim").alias("skim"))


@query(f"""WITH {EMB}, q AS (SELECT trace_id, x0, y0, y1, y2, k FROM (SELECT trace_id, i AS k, i AS x0, lag(y) OVER w AS y0, y AS y1, lead(y) OVER w AS y2, row_number() OVER (PARTITION BY trace_id ORDER BY y DESC, i) AS rk FROM e WINDOW w AS (PARTITION BY trace_id ORDER BY i)) WHERE rk = 1)
SELECT trace_id, round(CASE WHEN y0 + y2 - 2 * y1 < 0 THEN k + 0.5 * (y0 - y2) / (y0 - 2 * y1 + y2) ELSE k END, 6) + 0.0 AS rt,
  round(CASE WHEN y0 + y2 - 2 * y1 < 0 THEN y1 - 0.125 * pow(y0 - y2, 2) / (y0 - 2 * y1 + y2) ELSE y1 END, 6) + 0.0 AS height FROM q""")
def parabolic_apex(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = views.embeddings(spark, sf_dir).withColumn("a", S.parabolic_apex(F.col("x"), F.col("y")))
    return t.select("trace_id", r("a.rt").alias("rt"), r("a.height").alias("height"))


PEAK_TABLE = f"""WITH {EMB}, {SG5}, l AS (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS q FROM sm WINDOW w AS (PARTITION BY trace_id ORDER BY i)),
tops AS (SELECT trace_id, i AS top, row_number() OVER (PARTITION BY trace_id ORDER BY i) AS peak_no FROM l WHERE y > p AND y > q),
near AS (SELECT *, lag(top) OVER w AS before, lead(top) OVER w AS after FROM tops WINDOW w AS (PARTITION BY trace_id ORDER BY top)),
lo AS (SELECT trace_id, peak_no, arg_min(sm.i, sm.y) AS a FROM near JOIN sm USING (trace_id) WHERE sm.i BETWEEN coalesce(before, 0) AND top GROUP BY ALL),
hi AS (SELECT trace_id, peak_no, arg_min(sm.i, sm.y) AS b FROM near JOIN n USING (trace_id) JOIN sm USING (trace_id) WHERE sm.i BETWEEN top AND coalesce(after, n - 1) GROUP BY ALL),
pk AS (SELECT trace_id, peak_no, a, b, s.y AS ya, t.y AS yb FROM lo JOIN hi USING (trace_id, peak_no) JOIN sm s USING (trace_id) JOIN sm t USING (trace_id) WHERE s.i = a AND t.i = b AND b - a >= 2),
net AS (SELECT trace_id, peak_no, a, b, i, sm.y - (ya + (yb - ya) * (i - a) / (b - a)) AS h FROM pk JOIN sm USING (trace_id) WHERE i BETWEEN a AND b),
nb AS (SELECT *, lag(h) OVER w AS h0, lead(h) OVER w AS h2 FROM net WINDOW w AS (PARTITION BY trace_id, peak_no ORDER BY i)),
ar AS (SELECT trace_id, peak_no, min(a) AS a, min(b) AS b, sum((h + h2) / 2) AS area FROM nb GROUP BY ALL),
ap AS (SELECT trace_id, peak_no, i AS k, CASE WHEN h0 + h2 - 2 * h < 0 THEN i + 0.5 * (h0 - h2) / (h0 - 2 * h + h2) ELSE i END AS rt,
  CASE WHEN h0 + h2 - 2 * h < 0 THEN h - pow(h0 - h2, 2) / (8 * (h0 - 2 * h + h2)) ELSE h END AS height FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, peak_no ORDER BY h DESC, i) AS rk FROM nb) WHERE rk = 1),
lv AS (SELECT trace_id, peak_no, k, p, p * height AS level FROM ap, (VALUES (0.5), (0.1), (0.05)) AS v(p) WHERE height > 0),
le AS (SELECT trace_id, peak_no, p, arg_max(i + (level - h) / (h2 - h), i) AS x FROM lv JOIN nb USING (trace_id, peak_no) WHERE i < k AND h <= level GROUP BY ALL),
ri AS (SELECT trace_id, peak_no, p, arg_min(i - (level - h) / (h0 - h), i) AS x FROM lv JOIN nb USING (trace_id, peak_no) WHERE i > k AND h <= level GROUP BY ALL),
wd AS (SELECT trace_id, peak_no, max(CASE WHEN p = 0.5 THEN ri.x - le.x END) AS fwhm, max(CASE WHEN p = 0.1 THEN ri.x - le.x END) AS w10, max(CASE WHEN p = 0.05 THEN ri.x - le.x END) AS w5,
  max(CASE WHEN p = 0.05 THEN le.x END) AS l5, max(CASE WHEN p = 0.1 THEN le.x END) AS l10, max(CASE WHEN p = 0.1 THEN ri.x END) AS r10 FROM le JOIN ri USING (trace_id, peak_no, p) GROUP BY ALL),
df AS (SELECT trace_id, y - p AS d FROM l WHERE p IS NOT NULL), dm AS (SELECT trace_id, median(d) AS m FROM df GROUP BY trace_id),
sg2 AS (SELECT trace_id, 1.4826 * median(abs(d - m)) / sqrt(2) AS s, sqrt(avg(d * d) / 2) AS rms FROM df JOIN dm USING (trace_id) GROUP BY trace_id),
al AS (SELECT trace_id, CAST(peak_no AS INTEGER) AS peak_no, CAST(a AS DOUBLE) AS start, CAST(b AS DOUBLE) AS "end", area, CAST(rt AS DOUBLE) AS rt, height, fwhm, w10, w5, CASE WHEN rt > l5 THEN w5 / (2 * (rt - l5)) END AS tailing, CASE WHEN rt > l10 THEN (r10 - rt) / (rt - l10) END AS asymmetry,
  5.54 * pow(rt / fwhm, 2) AS plates, rt - 1.0 AS k, 2 * height / (6 * CASE WHEN s > 0 THEN s ELSE rms END) AS sn, area > 0 AND height > 0 AS valid FROM ar JOIN ap USING (trace_id, peak_no) LEFT JOIN wd USING (trace_id, peak_no) JOIN sg2 USING (trace_id))
SELECT trace_id, peak_no, start, "end", {", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("area", "rt", "height", "fwhm", "w10", "w5", "tailing", "asymmetry", "plates", "k", "sn"))},
  round(CASE WHEN valid THEN 100 * area / sum(CASE WHEN valid THEN area END) OVER (PARTITION BY trace_id) END, 6) + 0.0 AS area_pct, round(1.18 * (rt - lag(rt) OVER w) / (fwhm + lag(fwhm) OVER w), 6) + 0.0 AS resolution,
  concat_ws(';', CASE WHEN height <= 0 THEN 'nonPositiveHeight' END, CASE WHEN area <= 0 THEN 'nonPositiveArea' END) AS flags FROM al WINDOW w AS (PARTITION BY trace_id ORDER BY rt, peak_no)"""


@query(PEAK_TABLE)
def peak_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of every peak: widths, tailing, plates, area share, resolution."""
    t = views.embeddings(spark, sf_dir).withColumn("y", S.savgol(F.col("y"), 5, 2))
    t = t.select("trace_id", (6 * S.noise_sigma(F.col("y"), floor=False)).alias("p2p"), F.inline(peaks.runs(F.col("x"), F.col("y"), 2.0)))
    t = t.withColumn("k", F.col("rt") - 1.0).withColumn("sn", F.try_divide(2 * F.col("height"), F.col("p2p")))
    m = metrics.peak_list_metrics(t)
    names = ["start", "end", "area", "rt", "height", "fwhm", "w10", "w5", "tailing", "asymmetry", "plates", "k", "sn", "area_pct", "resolution"]
    return m.select("trace_id", "peak_no", *[r(n).alias(n) for n in names], F.concat_ws(";", "flags").alias("flags"))


@query("""WITH p AS (SELECT l_orderkey AS trace_id, CAST(l_linenumber AS INTEGER) AS peak_no, l_extendedprice AS area, l_quantity AS height, l_quantity + l_linenumber / 10.0 AS rt, 1 + l_discount AS fwhm FROM lineitem)
SELECT trace_id, peak_no, round(100 * area / sum(area) OVER (PARTITION BY trace_id), 6) AS area_pct,
  round(1.18 * (rt - lag(rt) OVER w) / (fwhm + lag(fwhm) OVER w), 6) + 0.0 AS resolution FROM p WINDOW w AS (PARTITION BY trace_id ORDER BY rt, peak_no, fwhm, area)""")
def peak_list_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area shares and resolutions within lists of peaks; line items of an order stand for the peaks of a trace."""
    p = views.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").cast("int").alias("peak_no"), F.col("l_extendedprice").alias("area"), F.col("l_quantity").alias("height"),
        (F.col("l_quantity") + F.col("l_linenumber") / 10.0).alias("rt"), (1 + F.col("l_discount")).alias("fwhm"),
    )
    return metrics.peak_list_metrics(p).select("trace_id", "peak_no", r("area_pct").alias("area_pct"), r("resolution").alias("resolution"))


ITEM = """p AS (SELECT l_suppkey AS trace_id, l_orderkey * 10 + l_linenumber AS peak_no, CAST(datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS start,
  datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + l_quantity / 10 AS "end" FROM lineitem)"""


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff("l_shipdate", F.lit("1992-01-01").cast("date"))
    return views.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("trace_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("peak_no"), day.cast("double").alias("start"), (day + F.col("l_quantity") / 10).alias("end")
    )


@query(f"""WITH {ITEM}, l AS (SELECT *, max("end") OVER (PARTITION BY trace_id ORDER BY start, peak_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p)
SELECT trace_id, peak_no, CAST(sum(CASE WHEN reach IS NULL OR start - reach > 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY start, peak_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cluster FROM l""")
def touching_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integration.touching_clusters(_intervals(spark, sf_dir), F.lit(0.5)).select("trace_id", "peak_no", F.col("cluster").cast("long").alias("cluster"))


@query(f"""WITH {ITEM}, k AS (SELECT * FROM p WHERE peak_no % 7 = 0), f AS (SELECT * FROM p WHERE peak_no % 7 <> 0)
SELECT trace_id, peak_no, true AS manual FROM k UNION ALL
SELECT trace_id, peak_no, false FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.trace_id = f.trace_id AND f.start < k."end" AND f."end" > k.start)""")
def kept_and_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kept peaks and those found that don't overlap them."""
    p = _intervals(spark, sf_dir)
    return integration.merge_keep(p.filter("peak_no % 7 = 0"), p.filter("peak_no % 7 <> 0")).select("trace_id", "peak_no", "manual")


PROGRAM = [(0.0, 5.0), (20.0, 95.0), (23.0, 95.0), (23.0, 5.0), (30.0, 5.0)]
VOID = gradient.void_volume(150, 4.6)


@query(f"""WITH t AS (SELECT event_id, value AS rt, greatest(0.0, value - 1.1 - {VOID!r}) AS t FROM events WHERE value IS NOT NULL)
SELECT event_id, round(CASE WHEN rt < 20 THEN 5 + rt * 4.5 WHEN rt < 23 THEN 95 ELSE 5 END, 6) AS b, round(CASE WHEN t < 20 THEN 5 + t * 4.5 WHEN t < 23 THEN 95 ELSE 5 END, 6) AS b_elution,
  round(0.5 + 19.5 * (CASE WHEN rt < 20 THEN 5 + rt * 4.5 WHEN rt < 23 THEN 95 ELSE 5 END) / 100, 6) AS conc FROM t""")
def gradient_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """%B at a time and at elution, and the concentration of the modifier; event values stand for times."""
    t = views.table(spark, sf_dir, "events").filter("value is not null")
    b = gradient.b_at(PROGRAM, F.greatest(F.col("value"), F.lit(0.0)))
    return t.select("event_id", r(b).alias("b"), r(gradient.b_at_elution(PROGRAM, F.col("value"), 1.1, VOID)).alias("b_elution"), r(gradient.concentration(b, 0.5, 20.0)).alias("conc"))


CAL = """c AS (SELECT p_brand AS analyte, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y FROM part)"""


def _cal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "part").select(F.col("p_brand").alias("analyte"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.lit(True).alias("include"))


@query(f"""WITH {CAL}, m AS (SELECT analyte, count(*) AS n, regr_slope(y, x) AS b1, regr_intercept(y, x) AS b0, regr_r2(y, x) AS r2, regr_sxx(y, x) AS sxx FROM c GROUP BY analyte),
s AS (SELECT analyte, sqrt(sum(pow(y - b0 - b1 * x, 2)) / (max(n) - 2)) AS s FROM c JOIN m USING (analyte) GROUP BY analyte)
SELECT analyte, n, round(b0, 4) AS b0, round(b1, 4) AS b1, round(s, 4) AS s, round(r2, 5) AS r2, round(s / sqrt(sxx), 4) AS se_slope, round(3.3 * s / abs(b1), 3) AS lod, round(10 * s / abs(b1), 3) AS loq FROM m JOIN s USING (analyte) WHERE n >= 3""")
def calibration_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calibration.fit(_cal(spark, sf_dir), "analyte").filter("b1 is not null")
    return c.select("analyte", "n", r("b0", 4).alias("b0"), r("b1", 4).alias("b1"), r("s", 4).alias("s"), r("r2", 5).alias("r2"), r(F.sqrt("c11"), 4).alias("se_slope"), r("lod", 3).alias("lod"), r("loq", 3).alias("loq"))


@query(f"""WITH {CAL}, w AS (SELECT *, 1 / x AS w0, count(*) OVER (PARTITION BY analyte) / sum(1 / x) OVER (PARTITION BY analyte) AS k FROM c),
m AS (SELECT analyte, count(*) AS n, sum(k * w0) AS s0, sum(k * w0 * x) AS s1, sum(k * w0 * x * x) AS s2, sum(k * w0 * y) AS t0, sum(k * w0 * x * y) AS t1 FROM w GROUP BY analyte),
b AS (SELECT *, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS b1, (t0 * s2 - s1 * t1) / (s0 * s2 - s1 * s1) AS b0 FROM m),
s AS (SELECT analyte, sqrt(sum(k * w0 * pow(y - b0 - b1 * x, 2)) / (max(n) - 2)) AS s FROM w JOIN b USING (analyte) GROUP BY analyte)
SELECT analyte, round(b0, 3) AS b0, round(b1, 4) AS b1, round(s, 4) AS s, round((1500 - b0) / b1, 2) AS conc FROM b JOIN s USING (analyte) WHERE n >= 3""")
def calibration_weighted_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1/x weighted lines, and the concentration that a response of 1500 means."""
    c = calibration.inverse(calibration.fit(_cal(spark, sf_dir), "analyte", "linear", "1/x"), F.lit(1500.0), 1, "1/x").filter("b1 is not null")
    return c.select("analyte", r("b0", 3).alias("b0"), r("b1", 4).alias("b1"), r("s", 4).alias("s"), r("conc", 2).alias("conc"))


@query(f"""WITH {CAL}, m AS (SELECT analyte, count(*) AS n, sum(x * y) / sum(x * x) AS b1 FROM c GROUP BY analyte)
SELECT analyte, round(max(b1), 5) AS b1, round(1 - sum(pow(y - b1 * x, 2)) / sum(y * y), 6) AS r2 FROM c JOIN m USING (analyte) WHERE n >= 2 GROUP BY analyte""")
def calibration_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calibration.fit(_cal(spark, sf_dir), "analyte", "linear0").filter("b1 is not null")
    return c.select("analyte", r("b1", 5).alias("b1"), r("r2").alias("r2"))


@query(f"""WITH {CAL}, z AS (SELECT analyte, avg(x) AS mx, count(*) AS n FROM c GROUP BY analyte), q AS (SELECT analyte, x - mx AS u, y, n, mx FROM c JOIN z USING (analyte) WHERE n >= 4),
m AS (SELECT analyte, max(n) AS n, max(mx) AS mx, sum(u * u) AS s2, sum(u * u * u) AS s3, sum(pow(u, 4)) AS s4, sum(y) AS t0, sum(u * y) AS t1, sum(u * u * y) AS t2 FROM q GROUP BY analyte),
d AS (SELECT *, (t0 - s2 * g2) / n AS g0 FROM (SELECT *, (t1 - s3 * g2) / s2 AS g1 FROM (SELECT *, (t2 - s2 * t0 / n - s3 * t1 / s2) / (s4 - s2 * s2 / n - s3 * s3 / s2) AS g2 FROM m))),
e AS (SELECT analyte, sum(pow(y - g0 - g1 * u - g2 * u * u, 2)) AS rss, sum(pow(y - t0 / d.n, 2)) AS tss FROM q JOIN d USING (analyte) GROUP BY analyte)
SELECT analyte, n, round(g0 - g1 * mx + g2 * mx * mx, 3) + 0.0 AS b0, round(g1 - 2 * g2 * mx, 4) + 0.0 AS b1, round(g2, 5) + 0.0 AS b2, round(sqrt(rss / (n - 3)), 4) AS s, round(1 - rss / tss, 5) AS r2 FROM d JOIN e USING (analyte)""")
def quadratic_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadratic curves and how well they fit."""
    c = calibration.fit(_cal(spark, sf_dir), "analyte", "quadratic").filter("b2 is not null")
    return c.select("analyte", "n", *[r(k, digits).alias(k) for k, digits in (("b0", 3), ("b1", 4), ("b2", 5), ("s", 4), ("r2", 5))])


@query()
def calibration_quadratic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quadratic curves, their inverse and its flags at the middle response of each analyte."""
    points = _cal(spark, sf_dir)
    middle = points.groupBy("analyte").agg(F.avg("y").alias("y0"))
    c = calibration.inverse(calibration.fit(points, "analyte", "quadratic").join(middle, "analyte"), F.col("y0"))
    names = ["b0", "b1", "b2", "s", "r2", "adj_r2", "conc", "conc_se", "lod", "loq"]
    return c.select("analyte", "n", *[r(n).alias(n) for n in names], F.concat_ws(";", "conc_flags").alias("conc_flags"))


def _bands(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rt = views.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("trace_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("peak_no"), (F.col("l_extendedprice") / 100).alias("rt"))
    analytes = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("analyte"), (F.col("p_retailprice") / 2).alias("expected_rt"))
    return rt, analytes


@query("""WITH k AS (SELECT l_suppkey AS trace_id, l_orderkey * 10 + l_linenumber AS peak_no, l_extendedprice / 100 AS rt FROM lineitem),
a AS (SELECT p_partkey AS analyte, p_retailprice / 2 AS expected_rt FROM part),
j AS (SELECT trace_id, analyte, peak_no, rt, row_number() OVER (PARTITION BY trace_id, analyte ORDER BY abs(rt - expected_rt), rt, peak_no) AS rk FROM k JOIN a ON abs(rt - expected_rt) <= 0.05)
SELECT trace_id, analyte, peak_no, round(rt, 6) AS rt FROM j WHERE rk = 1""")
def analyte_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest peak of each trace to each analyte's expected place, within a tolerance."""
    return matching.match_analytes(*_bands(spark, sf_dir), 0.05, ("peak_no", r("rt").alias("rt")))


@query("""WITH RECURSIVE c AS (SELECT c_nationkey AS set_id, c_custkey AS trace_id, CAST(c_acctbal / 100 AS DOUBLE) AS rt FROM customer WHERE c_acctbal IS NOT NULL),
b AS (SELECT DISTINCT set_id, floor(rt / 0.5) AS band FROM c), u AS (SELECT *, CASE WHEN band - lag(band) OVER (PARTITION BY set_id ORDER BY band) > 1 THEN 1 ELSE 0 END AS cut FROM b),
i AS (SELECT set_id, band, sum(cut) OVER (PARTITION BY set_id ORDER BY band) AS island FROM u),
o AS (SELECT c.*, island, row_number() OVER (PARTITION BY c.set_id, island ORDER BY rt, trace_id) AS k FROM c JOIN i ON i.set_id = c.set_id AND i.band = floor(rt / 0.5)),
g AS (SELECT set_id, island, k, trace_id, rt, [{'mean': rt, 'n': 1, 'traces': [trace_id]}] AS groups, CAST(1 AS BIGINT) AS joined FROM o WHERE k = 1
  UNION ALL SELECT set_id, island, k, trace_id, rt,
    CASE WHEN best IS NULL THEN list_append(groups, {'mean': rt, 'n': 1, 'traces': [trace_id]})
      ELSE list_transform(groups, lambda x, n: CASE WHEN n = best THEN {'mean': x.mean + (rt - x.mean) / (x.n + 1), 'n': x.n + 1, 'traces': list_append(x.traces, trace_id)} ELSE x END) END,
    CAST(coalesce(best, len(groups) + 1) AS BIGINT)
  FROM (SELECT o.*, g.groups, list_min(list_filter(list_transform(g.groups, lambda x, n: CASE WHEN abs(x.mean - o.rt) <= 0.5 AND NOT list_contains(x.traces, o.trace_id) THEN {'d': abs(x.mean - o.rt), 'n': n} END), lambda v: v IS NOT NULL)).n AS best
    FROM g JOIN o ON o.set_id = g.set_id AND o.island = g.island AND o.k = g.k + 1) s)
SELECT set_id, trace_id, round(rt, 6) + 0.0 AS rt, CAST(island AS BIGINT) AS island, CAST(joined - 1 AS BIGINT) AS match_group, round(avg(rt) OVER (PARTITION BY set_id, island, joined), 6) + 0.0 AS group_rt FROM g""")
def peak_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks of all traces of a comparison set matched by running means; nations are the sets and customers the traces."""
    c = views.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("set_id"), F.col("c_custkey").alias("trace_id"), (F.col("c_acctbal") / 100).alias("rt"))
    return matching.match_peaks(c.filter("rt is not null"), 0.5, "set_id").select("set_id", "trace_id", r("rt").alias("rt"), "island", "match_group", r("group_rt").alias("group_rt"))


@query(f"""WITH {EMB}, l AS (SELECT *, lag(y) OVER w AS p, lead(y) OVER w AS q FROM e WINDOW w AS (PARTITION BY trace_id ORDER BY i)), m AS (SELECT trace_id, i, y FROM l WHERE y > p AND y > q),
b AS (SELECT m.trace_id, m.i, m.y, coalesce(max(CASE WHEN e.i < m.i AND e.y >= m.y THEN e.i END), -1) AS a, coalesce(min(CASE WHEN e.i > m.i AND e.y > m.y THEN e.i END), max(e.i) + 1) AS b FROM m JOIN e ON e.trace_id = m.trace_id GROUP BY ALL),
pr AS (SELECT b.trace_id, b.i, b.y, b.y - greatest(min(CASE WHEN e.i <= b.i THEN e.y END), min(CASE WHEN e.i >= b.i THEN e.y END)) AS prom FROM b JOIN e ON e.trace_id = b.trace_id AND e.i > b.a AND e.i < b.b GROUP BY b.trace_id, b.i, b.y)
SELECT pr.trace_id, CAST(pr.i AS INTEGER) AS i, round(prom, 6) + 0.0 AS prominence, CAST(coalesce(min(CASE WHEN e.i > pr.i AND e.y <= pr.y - prom / 2 THEN e.i END), max(e.i)) - coalesce(max(CASE WHEN e.i < pr.i AND e.y <= pr.y - prom / 2 THEN e.i END), 0) AS DOUBLE) AS width
FROM pr JOIN e ON e.trace_id = pr.trace_id GROUP BY pr.trace_id, pr.i, prom, pr.y""")
def prominences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far every maximum stands out of its surroundings, and how wide it is at half of that (in samples)."""
    t = views.embeddings(spark, sf_dir).select("trace_id", F.inline(peaks.prominent(F.col("y"))))
    return t.select("trace_id", "i", r("prominence").alias("prominence"), "width")


@query(f"""WITH {EMB}, t AS (SELECT trace_id, y, i, row_number() OVER (PARTITION BY trace_id ORDER BY y DESC, i) AS rk FROM e)
SELECT trace_id, CAST(row_number() OVER (ORDER BY trace_id) - 1 AS INTEGER) AS place, round((row_number() OVER (ORDER BY trace_id) - 1) * 0.1 * max(abs(y)) OVER (), 6) AS dy FROM (SELECT trace_id, max(abs(y)) AS y FROM e GROUP BY trace_id)""")
def stacked_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of a waterfall display: each trace a tenth of the largest signal above the one before."""
    t = views.embeddings(spark, sf_dir).select("trace_id", F.array_max(F.transform("y", lambda v: F.abs(v))).alias("big"))
    top = t.agg(F.max("big").alias("top"))  # one row
    rows = tables.numbered(t, "trace_id").crossJoin(F.broadcast(top))
    return rows.select("trace_id", F.col("place").cast("int").alias("place"), r(F.col("place") * 0.1 * F.col("top")).alias("dy"))


@query("""WITH d AS (SELECT l_returnflag AS trace_id, CAST(datediff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS x, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(20, 4))) AS DOUBLE) AS y FROM lineitem GROUP BY ALL)
SELECT trace_id, count(*) AS n_points, min(x) AS x_min, max(x) AS x_max, round(min(y), 4) AS y_min, round(max(y), 4) AS y_max FROM d GROUP BY trace_id""")
def trace_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary rows of traces."""
    t = views.daily_revenue(spark, sf_dir)
    return t.select("trace_id", F.size("x").cast("long").alias("n_points"), F.array_min("x").alias("x_min"), F.array_max("x").alias("x_max"), r(F.array_min("y"), 4).alias("y_min"), r(F.array_max("y"), 4).alias("y_max"))
