"""Texts, guards, report tables, gradient curves, joins at their limits, image steps."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalars
from tracewright.operators import calibration, clusters, edits, gradient, image, integration, kernels, matching, metrics, peaks, reports, signal, synthetic, tables
from tracewright.plans import analysis
from tracewright.sources import exports, projects


def one(spark, *columns, **values):
    kinds = {str: "string", float: "double", int: "int", bool: "boolean"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "a int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(*columns).first()


def test_numbers_for_display(spark):
    rows = [(None, "—"), (float("nan"), "—"), (0.0, "0"), (1234.567, "1235"), (0.0012345, "0.001235"), (1234567.0, "1.235e+6"), (0.00012, "1.2e-4"), (-2.5, "-2.5"), (10.0, "10")]
    df = spark.createDataFrame(rows, "v double, want string")
    assert [r.got for r in df.select(scalars.formatted(F.col("v")).alias("got")).collect()] == [w for _, w in rows]


def test_text_guards(spark):
    texts = ["a &lt;b&gt; &amp;amp; &#65;&#x42;&#0;&#xD800;", None, "plain"]
    got = spark.createDataFrame([(t,) for t in texts], "s string").select(scalars.decode_xml(F.col("s")).alias("s")).collect()
    assert [r.s for r in got] == ["a <b> &amp; AB\ufffd\ufffd", None, "plain"]
    r = one(spark, scalars.safe_text(F.col("s"), 4).alias("a"), scalars.safe_colour(F.col("c")).alias("b"), scalars.safe_colour(F.col("s")).alias("c"), scalars.safe_image(F.col("i")).alias("d"), scalars.safe_image(F.col("s")).alias("e"), scalars.file_safe(F.col("f")).alias("f"), s="a\x00b\ncde", c="#ABC", i="data:image/png;base64,AAA=", f=" a/b: c? ")
    assert tuple(r) == ("ab\nc", "#abc", "#000000", "data:image/png;base64,AAA=", None, "a_b_c")


def test_gradient_curves_and_texts(spark):
    rows = [(0.0, 5.0), (20.0, 95.0), (23.0, 95.0), (23.0, 5.0), (30.0, 5.0)]
    curve = one(spark, gradient.gradient_curve(rows, 30.0, 4, 1.0).alias("c")).c
    at = [(p.t, p.b) for p in curve]
    assert at.index((24.0, 95.0)) + 1 == at.index((24.0, 5.0)) and (10.0, pytest.approx(45.5)) in at
    assert gradient.summary(rows, 1.0) == "5 to 95 % B in 20 min, 1 mL/min" and gradient.summary([(0, 30), (9, 30)]) == "isocratic, 30 % B"
    r = spark.createDataFrame([([0.0, 9.0, 11.0], [1.0, 2.0, 3.0])], "x array<double>, y array<double>").select(gradient.read_out(F.col("x"), F.col("y"), F.lit(9.6), rows).alias("r")).first().r
    assert (r.x, r.y, r.b) == (9.0, 2.0, pytest.approx(45.5))


def test_audit_rows_and_formulas(spark):
    assert metrics.formulas(spark).count() == 27
    got = metrics.audit_rows(spark.createDataFrame([(1, 1, 2.0, None)], "trace_id int, peak_no int, area double, fwhm double")).collect()
    assert [(r.name, r.value) for r in got] == [("area", 2.0)]


def test_a_baseline_goes_on_as_it_ends(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0, 5.0], [1.0, 2.0], [2.0, 3.0])], "x array<double>, y array<double>, bx array<double>, by array<double>")
    x, y, bx, by = (F.col(c) for c in ("x", "y", "bx", "by"))
    r = df.select(integration.baseline_at(bx, by, F.lit(4.0)).alias("a"), integration.baseline_area(x, y, F.lit(0.0), F.lit(4.0), bx, by).alias("b")).first()
    assert r.a == pytest.approx(5.0) and r.b == pytest.approx(0.0)


def test_tolerance_joins_at_their_limits(spark):
    a = spark.createDataFrame([(1, 0.1), (2, 0.3), (3, None), (4, 0.5)], "i int, at double")
    b = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, None), (4, 0.4)], "j int, place double")
    pairs = lambda t: sorted((r.i, r.j) for r in matching.band_join(a, b, "at", "place", t).collect())
    assert pairs(0.0) == [(1, 1)]
    assert pairs(0.15) == [(1, 1), (1, 2), (2, 2), (2, 4), (4, 4)]
    rng = random.Random(3)
    u, v = [round(rng.uniform(0, 5), 2) for _ in range(150)], [round(rng.uniform(0, 5), 2) for _ in range(60)]
    p, q = spark.createDataFrame([(k, x) for k, x in enumerate(u)], "i int, at double"), spark.createDataFrame([(k, x) for k, x in enumerate(v)], "j int, place double")
    want = sorted((i, j) for i, x in enumerate(u) for j, y in enumerate(v) if abs(x - y) <= 0.07)
    assert sorted((r.i, r.j) for r in matching.band_join(p, q, "at", "place", 0.07).collect()) == want


def brute_match(rows, tolerance):
    out, groups = {}, {}
    for s, t, rt in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        own = groups.setdefault(s, [])
        fit = [(abs(g[0] - rt), k) for k, g in enumerate(own) if abs(g[0] - rt) <= tolerance and t not in g[2]]
        if fit:
            g = own[min(fit)[1]]
            g[1] += 1
            g[0] += (rt - g[0]) / g[1]
            g[2].add(t)
            k = min(fit)[1]
        else:
            k = len(own)
            own.append([rt, 1, {t}])
        out[(s, t, rt)] = (s, k)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matching_equals_the_rule_in_order(spark, seed):
    rng = random.Random(seed)
    rows = list({(rng.randint(0, 2), rng.randint(0, 12), round(rng.uniform(0, [3, 30, 8][seed]), 3)) for _ in range(220)})
    df = spark.createDataFrame([*rows, (0, 99, None)], "s int, trace_id int, rt double")
    got = matching.match_peaks(df, 0.1, "s").collect()
    want = brute_match(rows, 0.1)
    mine = {}
    for r in got:
        if r.rt is None:
            assert r.match_group is None and r.group_rt is None
        else:
            mine.setdefault((r.s, r.island, r.match_group), set()).add((r.s, r.trace_id, r.rt))
    theirs = {}
    for key, g in want.items():
        theirs.setdefault(g, set()).add(key)
    assert len(got) == len(rows) + 1 and sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    for r in got:
        if r.rt is not None:
            members = mine[(r.s, r.island, r.match_group)]
            assert r.group_rt == pytest.approx(sum(m[2] for m in members) / len(members))


def test_wide_comparison(spark):
    df = spark.createDataFrame([(1, "A", 1.0, 5.0, 0.5), (1, "B", 1.2, 6.0, None), (2, "A", 3.0, 7.0, 0.5), (2, "C", 3.1, 1.0, 0.0)], "g int, trace_id string, rt double, area double, offset double")
    got = {r.g: r.asDict() for r in matching.compare_wide(df, ["A", "B"], ["g"], offset="offset").collect()}
    assert got[1] == {"g": 1, "group_rt": pytest.approx(1.35), "n_traces": 2, "A_rt": 1.5, "A_area": 5.0, "B_rt": 1.2, "B_area": 6.0}
    assert got[2]["B_rt"] is None and got[2]["n_traces"] == 1


def test_alignment_to_a_reference(spark):
    kind = "trace_id int, x_unit string, offset double, peaks array<struct<rt:double,height:double>>"
    rows = [(1, "min", 0.5, [(2.0, 1.0), (5.0, 9.0)]), (2, "min", None, [(5.1, 2.0), (9.0, 3.0)]), (3, "mL", 0.25, [(5.0, 1.0)]), (4, "min", None, [])]
    got = {r.trace_id: r.offset for r in matching.aligned(spark.createDataFrame(rows, kind), F.col("trace_id") == 1).collect()}
    assert got == {1: 0.5, 2: 0.4, 3: 0.25, 4: 0.0}


def test_printed_lists(spark):
    text = "RT, area, name\n1.5, 20 %, a\n2.25;30;b c\n\n3.5\n4 10"
    df = spark.createDataFrame([(1, text), (2, None)], "trace_id int, text string")
    got = [tuple(r) for r in edits.parse_printed(df).orderBy("printed_no").collect()]
    assert got == [(1, 1, 1.5, 20.0, "a"), (1, 2, 2.25, 30.0, "b c"), (1, 3, 3.5, None, None), (1, 4, 4.0, 10.0, None)]
    p = spark.createDataFrame([(1, 1, 1.52), (1, 2, 2.6)], "trace_id int, peak_no int, rt double")
    m = {r.printed_no: (r.peak_no, r.within) for r in edits.match_printed(p, edits.parse_printed(df), 0.05).collect()}
    assert m == {1: (1, True), 2: (2, False), 3: (None, None), 4: (None, None)}


def test_adding_and_nudging_peaks(spark):
    kind = "trace_id int, peak_no int, start double, apex double, end double"
    have = spark.createDataFrame([(1, 1, 0.0, 1.0, 2.0), (1, 2, 4.0, 5.0, 6.0)], kind)
    new = spark.createDataFrame([(1, 9, 1.5, 3.0, 4.5), (1, 10, 4.5, 5.1, 5.5), (2, 1, 0.0, 1.0, 2.0)], kind)
    got = {(r.trace_id, r.peak_no): (r.start, r.end, r.manual) for r in edits.add_peaks(have, new, F.lit(0.1)).collect()}
    assert got == {(1, 1): (0.0, 2.0, False), (1, 2): (4.0, 6.0, False), (1, 9): (2.0, 4.0, True), (2, 1): (0.0, 2.0, True)}
    df = spark.createDataFrame([([0.0, 1.0, 2.0],)], "x array<double>")
    assert [df.select(edits.nudged(F.col("x"), F.lit(a), n).alias("v")).first().v for a, n in ((1.1, 1), (2.0, 1), (0.2, -1))] == [2.0, 2.0, 0.0]


def test_results_and_components_join_peaks(spark):
    p = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, None)], "trace_id int, peak_no int, peak_id string")
    res = spark.createDataFrame([(1, 2, "a", 5.0), (1, 2, None, 6.0), (2, 1, None, 7.0)], "trace_id int, peak_no int, peak_id string, area double")
    assert {(r.trace_id, r.peak_no): r.area for r in edits.joined_results(p, res).collect()} == {(1, 1): 5.0, (1, 2): 6.0, (2, 1): 7.0}
    fit = spark.createDataFrame([(1, [2], [(5.0, 0.1, 0.2, 9.0, 3.0, 0.1)])], "trace_id int, peak_nos array<int>, fit array<struct<mu:double,sigma:double,tau:double,height:double,area:double,area_se:double>>")
    assert {(r.trace_id, r.peak_no): r.fit_area for r in edits.fit_components(p, fit).collect()} == {(1, 1): None, (1, 2): 3.0, (2, 1): None}


def test_run_information(spark):
    df = spark.createDataFrame([({"Flow rate": "1.0", "Detector": "UV", "Oven temp": "30"}, {"operator": " ", "Flow rate": "2"})], "p map<string,string>, t map<string,string>")
    r = df.select(edits.run_info(F.col("p")).alias("a"), edits.effective_run(F.col("p"), F.col("t")).alias("b"), edits.effective_run(F.col("p"), F.lit(None).cast("map<string,string>")).alias("c")).first()
    assert (r.a.flow, r.a.detector, r.a.temperature, r.a.sample) == ("1.0", "UV", "30", None)
    assert r.b == {"Flow rate": "2", "Detector": "UV", "Oven temp": "30"} and r.c["Flow rate"] == "1.0"


def test_volumes_as_minutes(spark):
    kind = "x array<double>, x_unit string, offset double, peaks array<struct<start:double,apex:double,end:double,label:string>>, flow double"
    rows = [([1.0, 2.0], "mL", 1.0, [(1.0, 1.5, 2.0, "a")], 0.5), ([1.0], "min", 1.0, [], 0.5), ([1.0], "mL", 1.0, [], None)]
    got = signal.volumes_to_minutes(spark.createDataFrame(rows, kind), F.col("flow")).collect()
    assert (got[0].x, got[0].x_unit, got[0].offset, got[0].peaks[0].apex) == ([2.0, 4.0], "min", 2.0, 3.0)
    assert got[1].x == [1.0] and got[2].x_unit == "mL"


def test_derived_traces(spark):
    kind = "k int, name string, x array<double>, y array<double>, x_unit string"
    a = spark.createDataFrame([(1, "a", [0.0, 1.0, 2.0], [1.0, 2.0, 3.0], "min"), (2, "c", [0.0], [1.0], "mL")], kind)
    b = spark.createDataFrame([(1, "b", [0.5, 1.5], [1.0, 1.0], "min"), (2, "d", [0.0], [1.0], "min")], kind)
    (r,) = signal.derived_difference(a, b, ["k"]).collect()
    assert r.name == "a - b" and r.y == [None, 1.0, None] and r.derived


def test_waterfall_and_labels(spark):
    t = spark.createDataFrame([(5, [0.0, 1.0], [1.0, -2.0], 1.0, "signal"), (9, [0.0], [4.0], None, "pressure")], "trace_id int, x array<double>, y array<double>, offset double, role string")
    got = {r.trace_id: (r.place, r.x, r.y) for r in reports.display_series(t, "max", 0.5).collect()}
    assert got == {5: (0, [1.0, 2.0], [0.5, -1.0]), 9: (1, [0.0], [6.0])}
    p = spark.createDataFrame([(1, 1.0, 5.0), (1, 1.05, 9.0), (1, 1.12, 4.0), (1, 2.0, 1.0), (2, None, 1.0)], "trace_id int, rt double, height double")
    assert sorted(r.rt for r in reports.label_rows(p, 0.1).collect()) == [1.05, 2.0]
    y = [0.0, 1.0, 3.0, 1.0, 0.0]
    s = spark.createDataFrame([(1, [0.0, 1.0, 2.0, 3.0, 4.0], y)], "trace_id int, x array<double>, y array<double>")
    q = spark.createDataFrame([(1, 1, 0.5, 3.5), (1, 2, 3.0, 3.0)], "trace_id int, peak_no int, start double, end double")
    (r,) = reports.shading(s, q).collect()
    assert r.peak_no == 1 and r.x == [0.5, 1.0, 2.0, 3.0, 3.5] and r.lower == [0.5] * 5


def test_report_texts(spark):
    r = one(spark, reports.equation_text(F.lit(1.5), F.lit(-2.0), F.lit(0.0)).alias("a"), reports.equation_text(F.lit(0.0), F.lit(2.0), F.lit(None).cast("double")).alias("b"), reports.processing_text(F.lit(11), F.lit(3), F.lit(1e8), F.lit(0.001)).alias("c"), reports.integration_text(F.lit("drop"), F.lit(2), F.lit(None).cast("int"), F.lit("")).alias("d"))
    assert tuple(r) == ("y = 1.5000 - 2.0000 x", "y = 2.0000 x", "Savitzky-Golay 11/3; asymmetric least squares, lambda 1.00e+08, p 0.00100", "drop; one of 2")


def test_numbering(spark):
    keys = random.Random(1).sample(range(-10**6, 10**6), 3000)
    got = tables.numbered(spark.createDataFrame([(k,) for k in [*keys, None]], "k long"), "k", width=1000).collect()
    assert {r.k: r.place for r in got} == {None: None, **{k: i for i, k in enumerate(sorted(keys))}}


def test_export_scopes_and_files(spark, tmp_path):
    t = spark.createDataFrame([(1, True), (2, False), (3, None)], "trace_id int, visible boolean")
    ids = lambda df: sorted(r.trace_id for r in df.collect())
    assert ids(exports.in_scope(t)) == [1, 2, 3] and ids(exports.in_scope(t, "visible")) == [1, 3] and ids(exports.in_scope(t, "active", F.col("trace_id") == 2)) == [2]
    assert ids(exports.in_scope(t, "visible", ids=t.filter("trace_id > 1"))) == [3]
    p = exports.peak_rows(spark.createDataFrame([(7, 1, 1 / 3, ["a", "b"], float("nan")), (8, 1, 2.0, [], 1.0)], "trace_id int, peak_no int, area double, flags array<string>, k double"), {"x": "min", "y": "mAU"})
    assert len(p.columns) == 40 and len(exports.TRACE_COLUMNS) == 23 and len(exports.CALIBRATION_COLUMNS) == 12
    assert [(r.flags, r.k) for r in p.orderBy("trace_id").collect()] == [("a;b", None), ("", 1.0)]
    exports.write_csv(p.select("trace_id", "peak_no", "area", "flags"), f"{tmp_path}/csv", ["trace_id"], ["made"])
    lines = [line for f in sorted((tmp_path / "csv").glob("part-*")) for line in f.read_text().splitlines()]
    assert lines == ["# made", "# units: ,,mAU*min,", "trace_id,peak_no,area,flags", "7,1,3.333333333e-01,a;b", "8,1,2.0,"]
    exports.write_documents({"peaks": p}, f"{tmp_path}/doc")
    assert spark.read.json(f"{tmp_path}/doc/peaks").count() == 2 and "draft/2020-12" in spark.read.text(f"{tmp_path}/doc/peaks.schema").first().value


def test_calibration_rows(spark):
    points = spark.createDataFrame([("a", k, float(x), 1 + 2.0 * x if k != 3 else None, True, None) for k, x in enumerate((1, 2, 4, 8, 16))], "analyte string, level int, x double, y double, include boolean, missing string")
    fits = calibration.fit(points, "analyte")
    rows = {r.level: r for r in calibration.level_rows(points, fits).collect()}
    assert rows[0].recovery_pct == pytest.approx(100) and rows[0].residual == pytest.approx(0, abs=1e-9) and rows[3].back_conc is None and rows[3].flags is None
    seen = spark.createDataFrame([(9, 1, "a", 7.0), (9, 1, "b", 8.0), (5, 2, "a", 41.0), (6, 1, "z", 1.0)], "trace_id int, peak_no int, analyte string, response double")
    std = spark.createDataFrame([("a", 9)], "analyte string, trace_id int")
    got = {(r.trace_id, r.peak_no): (r.analyte, r.conc, r.conc_flags) for r in calibration.unknown_rows(seen, fits, std).collect()}
    assert got[(9, 1)][:2] == ("a", pytest.approx(3.0)) and got[(9, 1)][2] == ["standard"]
    assert got[(5, 2)][2] == ["extrapolated"] and got[(6, 1)] == ("z", None, [])
    levels, curve = reports.calibration_figure(points, fits, 5)
    assert levels.count() == 5 and [r.y for r in curve.orderBy("x").collect()] == pytest.approx([3, 10.5, 18, 25.5, 33])


def test_gaps_inside_clusters_are_closed():
    x = np.linspace(0, 10, 1001)
    y = kernels.gaussian(x, 10, 4.5, 0.3) + kernels.gaussian(x, 10, 5.5, 0.3)
    parts = [(3.5, 4.5, 4.9), (5.1, 5.5, 6.5)]
    joined = clusters.integrate(x, y, parts, "drop")
    whole = clusters.integrate(x, y, [(3.5, 5.0, 6.5)], "drop")[0]["area"]
    assert joined[0]["cluster_size"] == 2 and sum(r["area"] for r in joined) == pytest.approx(whole, rel=1e-9)
    kept = clusters.integrate(x, y, parts, "drop", manual=[True, False])
    assert sum(r["area"] for r in kept) < whole * 0.95


def test_recommended_modes():
    x = np.linspace(0, 12, 4001)
    tail = kernels.emg(x, 100, 3, 0.1, 0.6)
    rider = clusters.Clustered(x, tail + kernels.gaussian(x, 2, 4.6, 0.05), [(2.5, 3.1, 4.4), (4.4, 4.6, 4.8)])
    assert rider.recommended([0, 1], 10.0) == "skim-tangent"
    close = kernels.gaussian(x, 10, 5, 0.3) + kernels.gaussian(x, 9, 5.8, 0.3)
    assert clusters.Clustered(x, close, [(4, 5, 5.4), (5.4, 5.8, 7)]).recommended([0, 1], 10.0) == "fit"
    apart = kernels.gaussian(x, 10, 5, 0.2) + kernels.gaussian(x, 9, 5.9, 0.2)
    assert clusters.Clustered(x, apart, [(4, 5, 5.45), (5.45, 5.9, 7)]).recommended([0, 1], 10.0) == "drop"
    assert clusters.Clustered(x, apart, [(4, 5, 5.45)]).recommended([0], 10.0) == "valley"


def test_similar_clusters(spark):
    o = spark.createDataFrame([(1, 1, 2, "fit"), (1, 1, 2, "fit"), (2, 4, 3, "fit"), (3, 1, 2, "drop"), (4, 1, 1, "fit")], "trace_id int, cluster int, cluster_size int, recommended string")
    got = clusters.similar_clusters(o, (F.col("trace_id") == 1) & (F.col("cluster") == 1)).collect()
    assert sorted((r.trace_id, r.cluster) for r in got) == [(1, 1), (2, 4)]


def test_rough_finder(spark):
    x = np.linspace(0, 10, 1001)
    y = kernels.gaussian(x, 10, 3, 0.2) + kernels.gaussian(x, 5, 7, 0.2) + 0.01 * np.sin(40 * x)
    df = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<double>, y array<double>")
    got = df.select(peaks.simple_peaks(F.col("x"), F.col("y")).alias("p")).first().p
    assert [round(p.apex) for p in got] == [3, 7] and got[0].area == pytest.approx(10 * 0.2 * math.sqrt(2 * math.pi), rel=0.02)


def test_image_steps(spark):
    rng = np.random.default_rng(2)
    raster = np.dstack([rng.integers(0, 256, (40, 60, 3), dtype=np.uint8), np.full((40, 60), 255, np.uint8)])
    assert image.apply_ops(raster, [("crop", (10, 5, 20, 10))]).tobytes() == raster[5:15, 10:30].tobytes()
    assert (image.apply_ops(raster, [("quarter", 1), ("quarter", 3)]) == raster).all() and image.apply_ops(raster, [("quarter", 1)]).shape == (60, 40, 4)
    assert (image.apply_ops(raster, [("perspective", [(0, 0), (59, 0), (59, 39), (0, 39)])])[:, :, 3] == 255).all()
    grey = image.apply_ops(raster, [("adjust", {"grey": True})])
    assert (grey[..., 0] == grey[..., 1]).all() and set(np.unique(image.adjusted(raster, threshold=128)[..., 0])) <= {0, 255}
    with pytest.raises(ValueError, match="unknown step"):
        image.apply_ops(raster, [("spin", 1)])
    df = spark.createDataFrame([(bytearray(raster.tobytes()), 60, 40)], "c binary, w int, h int")
    r = df.select(image.prepared(F.col("c"), F.col("w"), F.col("h"), [("quarter", 1)]).alias("p")).first().p
    assert (r.width, r.height) == (40, 60)
    m = np.ones((10, 10), bool)
    assert image.within(m, [(2, 2, 4, 4)], [(3, 3, 1, 1)]).sum() == 15


def test_degraded_scenes_keep_their_curves(spark):
    y = 200 * np.exp(-0.5 * ((np.arange(400) - 150) / 20.0) ** 2) + 20
    raster, axes = image.scene([y], [(31, 119, 180)])
    (ox, dx, _), (oy, dy, _) = axes.line("x"), axes.line("y")
    where = F.struct(F.lit(float(ox)).alias("x0"), F.lit(float(dx)).alias("dx"), F.lit(float(oy)).alias("y0"), F.lit(float(dy)).alias("dy"))
    for step in (lambda v: v, lambda v: image.blurred(v, 0.8), lambda v: image.quantised(v, 8.0)):
        bad = step(raster)
        df = spark.createDataFrame([(bytearray(bad.tobytes()), bad.shape[1], bad.shape[0])], "c binary, w int, h int")
        c = df.select(image.digitized(F.col("c"), F.col("w"), F.col("h"), where, (31, 119, 180), 90).alias("c")).first().c
        top = int(np.argmax(c.y))
        assert abs(c.x[top] - 150 / 399) < 0.01 and abs(c.y[top] - 220) < 8
    assert image.resized(raster, 0.5).shape == (280, 450, 4)
    dark = np.full((4, 4, 4), 255, np.uint8)
    dark[1, 1, :3] = 10
    assert image.dark_mask(dark, 50).sum() == 1
    r = one(spark, image.quality_warnings(F.lit(500), F.lit(500), F.lit(0.9), F.lit(1.0), F.lit(50), F.lit(300), F.lit(2)).alias("w"), image.uncertainty(axes, F.array(F.lit(1.0))).alias("u"))
    assert r.w == ["narrow image", "calibration points of x are close", "gaps were bridged"] and r.u.dx == pytest.approx(abs(dx) / 2)
    assert image.Axes((0, 1), (10, 100), (0, 0), (1, 1), x_log=True) and one(spark, image.to_pixel(axes, "y", F.lit(250.0)).alias("p")).p == pytest.approx(50)


def test_detection_again_keeps_what_was_decided(spark):
    kind = "trace_id int, peak_no int, start double, apex double, end double"
    old = spark.createDataFrame([(1, 1, 0.0, 1.0, 2.0, True, None, "mine"), (1, 2, 4.0, 5.0, 6.0, False, "fit", "b"), (1, 3, 7.0, 8.0, 9.0, False, None, None)], f"{kind}, manual boolean, mode string, label string")
    new = spark.createDataFrame([(1, 1, 1.5, 1.8, 2.5), (1, 2, 4.1, 5.03, 6.1), (1, 3, 7.0, 8.0, 9.0)], kind)
    got = sorted((r.apex, r.manual, r["mode"], r.label) for r in edits.redetected(old, new, 0.02).collect())
    assert got == [(1.0, True, None, "mine"), (5.03, False, "fit", "b"), (8.0, False, None, None)]
    t = spark.createDataFrame([("f", 0, [(0.5, 1.0, 1.5, 7.0, None, "x")]), ("g", 0, [])], "path string, trace_no int, peaks array<struct<start:double,apex:double,end:double,area:double,area_se:double,label:string>>")
    assert [(r.path, r.peak_no, r.imported_area, r.manual) for r in edits.imported_as_manual(t).collect()] == [("f", 1, 7.0, True)]


def test_links_and_pasted_texts(spark):
    project = {"version": 2, "traces": [{"id": "a", "name": "n", "x": [0, 1, 2], "y": [1, 2, 1], "peaks": []}], "images": {"i": "x" * 999}}
    link = projects.pack_link(project)
    assert "images" not in projects.unpack_link(f"https://host/page#{link}") and projects.unpack_link(link)["traces"] == project["traces"]
    for bad in ("nonsense", "p=abc", link[:-9]):
        with pytest.raises(ValueError):
            projects.unpack_link(bad)
    import json

    rows = [("a", json.dumps(project)), ("b", f"https://host/#{link}"), ("c", "Time (min),Signal\n0,1\n1,2\n2,3\n"), ("d", None)]
    documents, others = projects.import_texts(spark.createDataFrame(rows, "path string, content string"))
    assert sorted((r.path, r.trace_id) for r in documents.collect()) == [("a", "a"), ("b", "a")]
    assert [(r.path, r.x) for r in others.collect()] == [("c", [0.0, 1.0, 2.0])]


def test_figures_above_a_given_baseline(spark):
    x = np.linspace(0, 10, 1001)
    y = kernels.gaussian(x, 10, 5, 0.2) + 2 + 0.1 * x
    kind = "x array<double>, y array<double>, start double, end double, bx array<double>, by array<double>, area string"
    rows = [(x.tolist(), y.tolist(), 4.0, 6.0, [0.0, 10.0], [2.0, 3.0], "own"), (x.tolist(), y.tolist(), 4.0, 6.0, None, None, "own"), (x.tolist(), y.tolist(), 4.0, 6.0, [0.0], [0.0], None)]
    got = metrics.metrics_above(spark.createDataFrame(rows, kind)).collect()
    true = 10 * 0.2 * math.sqrt(2 * math.pi)
    assert got[0].area == pytest.approx(true, rel=1e-3) and got[1].area == pytest.approx(true, rel=1e-3) and got[2].area == pytest.approx(true + 5.0, rel=1e-3)


def test_the_way_from_raw_traces_to_concentrations(spark):
    traces = synthetic.calibration_set(spark).cache()
    table = analysis.peak_table(traces.select("trace_id", "x", "y"), analysis.Processing(min_dist=0.3, min_width=0.05))
    assert table.columns[:3] == ["trace_id", "peak_no", "cluster"]
    analytes = spark.createDataFrame([("s", 6.0)], "analyte string, expected_rt double")
    found = matching.match_analytes(table.select("trace_id", "peak_no", "rt"), analytes, 0.3).join(table.select("trace_id", "peak_no", "area"), ["trace_id", "peak_no"])
    known = traces.filter("conc is not null").select("trace_id", "conc")
    levels = known.withColumns({"analyte": F.lit("s"), "level": F.col("trace_id"), "response": F.lit(None).cast("double"), "include": F.lit(True)})
    points = calibration.calibration_points(levels, found.select("analyte", "trace_id", F.col("area").alias("response")))
    fits = calibration.fit(points, "analyte", "quadratic", "1/x")
    unknown = found.join(known, "trace_id", "left_anti").select("trace_id", "peak_no", "analyte", F.col("area").alias("response"))
    (r,) = calibration.unknown_rows(unknown, fits).collect()
    assert r.conc == pytest.approx(30.0, rel=0.05)
    assert exports.peak_rows(table).count() == table.count()
    curves = synthetic.purification()
    assert curves["UV"][1].max() > 800 and set(curves) == {"UV", "conductivity", "%B"}


def test_peaks_of_a_known_signal_by_every_mode(spark):
    """Areas of the eight-peak sample against the truth, with the noise and drift that it comes with."""
    how = analysis.Processing(lam=1e8, min_dist=0.05, min_width=0.02)
    t = synthetic.chromatograms(spark, 3)
    for mode, near in (("drop", 0.03), ("valley", 0.03), ("baseline", 0.03), ("fit", 0.03)):
        rows = analysis.peak_table(t, analysis.Processing(**{**how.__dict__, "mode": mode})).collect()
        for seed in range(3):
            own = sorted((r for r in rows if r.trace_id == seed), key=lambda r: r.rt)
            assert len(own) == 8
            for r, (h, mu, s, tau) in zip(own, synthetic.SAMPLE):
                true = h * s * math.sqrt(2 * math.pi)
                if mode == "valley" and 7 < mu < 8:  # a peak's own chord cuts off what it shares with its neighbour
                    assert 0.4 * true < r.area < true
                else:
                    assert r.area == pytest.approx(true, rel=near), (mode, mu)


def test_small_operators(spark):
    from tracewright.operators import fitting

    x, y = np.linspace(0, 4, 401), None
    y = 5 * np.exp(-x) + kernels.gaussian(x, 0.5, 2, 0.05)
    df = spark.createDataFrame([(x.tolist(), y.tolist(), 2.0)], "x array<double>, y array<double>, flow double")
    cx, cy = F.col("x"), F.col("y")
    skim = integration.tangent_skim(cx, cy, F.lit(1.8), F.lit(2.2), F.lit(1.8), F.lit(2.0), F.lit(2.2))
    line = signal.linspace(F.lit(0.0), F.lit(4.0), 5)
    r = df.select(
        skim.alias("skim"), signal.interpolate(cx, cy, F.lit(9.0)).alias("clamped"), signal.to_minutes(cx, F.col("flow")).alias("minutes"), signal.to_minutes(cx, F.lit(0.0)).alias("none"), line.alias("line"),
        fitting.emg_shape(F.lit(0.1), F.lit(1e-3)).alias("shape"), scalars.binary_kind(F.lit(bytearray(b"\x89PNG\r\n\x1a\n"))).alias("kind"), scalars.peak_label(F.lit("area"), F.lit("a"), F.lit(1.0), F.lit(12.34)).alias("label"),
        signal.trapezoid(F.array(F.lit(1.0)), F.array(F.lit(5.0))).alias("single"), signal.trapezoid(F.lit(None).cast("array<double>"), cy).alias("missing"), signal.median(F.array(F.lit(3.0), F.lit(1.0), F.lit(float("nan")), F.lit(2.0), F.lit(8.0))).alias("median"),
    ).first()
    assert r.skim == pytest.approx(0.5 * 0.05 * math.sqrt(2 * math.pi), rel=0.1) and r.clamped == pytest.approx(y[-1])
    assert r.minutes[-1] == 2.0 and r.none is None and r.line == [0, 1, 2, 3, 4] and r.shape.fwhm == pytest.approx(0.2355, rel=0.01)
    assert (r.kind, r.label, r.single, r.missing, r.median) == ("png", "12.3%", 0.0, None, 2.5)


def test_summaries_and_lists_for_display(spark):
    p = spark.createDataFrame([(1, 1, 2.0, 5.0, 25.0), (1, 2, 3.0, 15.0, 75.0)], "trace_id int, peak_no int, rt double, area double, area_pct double")
    assert edits.trace_summaries(p).first().summary == "2 peaks; largest at 3.00 with 75.0 % of the area"
    t = spark.createDataFrame([(1, "a", None, "signal", "min"), (2, "b", True, None, "mL"), (3, "c", False, None, "min"), (4, "d", True, "pressure", "min")], "trace_id int, trace_name string, visible boolean, role string, x_unit string")
    got = {r.trace_id: [q.rt for q in r.peaks] for r in reports.peaks_for_display(t, p).collect()}
    assert got == {1: [2.0, 3.0], 2: []}
    assert [r.trace_id for r in tables.visible_signals(t, "min").collect()] == [1]
    wide = spark.createDataFrame([(1, 1.0, 2.0)], "trace_id int, k double, conc double")
    assert reports.table_columns(wide).columns == ["trace_id"] and reports.table_columns(wide, calibrated=True, void_time=True).columns == ["trace_id", "k", "conc"]


def test_untrusted_documents():
    deep = {"a": 1}
    for _ in range(80):
        deep = {"a": deep}
    with pytest.raises(ValueError, match="deeply"):
        projects.sanitized({"traces": [], "x": deep})
    bad = {
        "version": 2, "traces": [{"id": 5, "name": "n" * 999, "x": [0, "a", 2, 3], "y": [1, 2, float("inf")], "meta": {"k" * 99: 7, "d": {}}, "peaks": [{"start": 1, "apex": 2, "end": 3, "clip": "evil"}, {"start": 3, "apex": 2, "end": 1}, 4], "proc": {"window": 5000, "p": "x"}, "__proto__": 1}, "no"],
        "settings": {"clipDefault": "nonsense"}, "calibration": {"analytes": [{"model": "cubic"}]}, "constructor": {},
    }
    got = projects.sanitized(bad)
    (t,) = got["traces"]
    assert (t["id"], len(t["name"]), t["x"], t["y"], t["proc"]) == ("5", 200, [0.0, None, 2.0], [1.0, 2.0, None], {"window": 1001})
    assert t["peaks"] == [{"start": 1.0, "apex": 2.0, "end": 3.0, "clip": None, "label": None, "manual": False}] and t["meta"] == {"k" * 64: "7"}
    assert got["settings"]["clipDefault"] == "drop" and got["calibration"]["analytes"][0]["model"] in calibration.MODELS and "constructor" not in got
    assert projects.sanitized(got)["traces"] == got["traces"]


def test_events_units_and_extents(spark):
    t = spark.createDataFrame([(1, "min", 0.5, [("F", 1.0, "A1")]), (2, "mL", None, []), (3, "mL", None, [])], "trace_id int, x_unit string, offset double, events array<struct<curve:string,x:double,label:string>>").withColumns({"visible": F.lit(True), "role": F.lit("signal")})
    assert [(r.trace_id, r.x, r.label) for r in reports.event_rows(t).collect()] == [(1, 1.5, "A1")]
    assert reports.main_unit(t).first().x_unit == "mL" and reports.main_unit(t.filter("trace_id < 3")).first().x_unit == "min"
    axes = image.Axes((10, 0.0), (110, 10.0), (0, 5.0), (50, 0.0))
    e = one(spark, image.extent(axes, F.lit(111), F.lit(51)).alias("e")).e
    assert (e.x_min, e.x_max, e.y_min, e.y_max) == pytest.approx((-1.0, 10.0, 0.0, 5.0))


def test_peaks_of_an_image(spark):
    y = 200 * np.exp(-0.5 * ((np.arange(600) - 200) / 12.0) ** 2) + 120 * np.exp(-0.5 * ((np.arange(600) - 420) / 15.0) ** 2) + 10
    raster, axes = image.scene([y], [(31, 119, 180)])
    (ox, dx, _), (oy, dy, _) = axes.line("x"), axes.line("y")
    where = F.struct(F.lit(float(ox)).alias("x0"), F.lit(float(dx)).alias("dx"), F.lit(float(oy)).alias("y0"), F.lit(float(dy)).alias("dy"))
    blank = np.full_like(raster, 255)
    df = spark.createDataFrame([(1, bytearray(raster.tobytes()), 900, 560), (2, bytearray(blank.tobytes()), 900, 560)], "trace_id int, content binary, width int, height int")
    how = analysis.Processing(window=0, baseline=False, threshold=20.0, min_dist=0.05, min_width=0.01)
    got = sorted((r.trace_id, r.rt, r.height) for r in analysis.image_peak_table(df, where, (31, 119, 180), how).collect())
    assert [g[0] for g in got] == [1, 1] and got[0][1] == pytest.approx(200 / 599, abs=0.005) and got[1][1] == pytest.approx(420 / 599, abs=0.005)
    assert got[0][2] == pytest.approx(200, rel=0.05) and got[1][2] == pytest.approx(120, rel=0.05)


@pytest.mark.parametrize("spread, traces", [(3, 40), (60, 40), (2000, 5)])
def test_matching_over_partitions(spark, spread, traces):
    """Dense sets, sets with gaps and sets of islands, over many parts: groups and their numbers are those of the rule in order."""
    rng = random.Random(spread)
    rows = sorted({(s, rng.randrange(traces), round(rng.uniform(0, spread), 4)) for s in (0, 1) for _ in range(900)}, key=lambda r: (r[0], r[2], r[1]))
    df = spark.createDataFrame([(s, f"t{t:03}", rt, "x", 1.5) for s, t, rt in rows], "s int, trace_id string, rt double, island string, Match_Group double").repartition(7)
    got = matching.match_peaks(df, 0.1, "s", rows_a_part=110)
    assert got.columns == ["s", "trace_id", "rt", "island", "Match_Group", "_island", "_match_group", "group_rt"]
    found = {(r.s, int(r.trace_id[1:]), r.rt): (r.s, r["_island"], r["_match_group"]) for r in got.collect()}
    want = brute_match(rows, 0.1)
    assert found.keys() == want.keys()
    pairs = {(found[k], want[k]) for k in found}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})
    numbers = {}
    for k in rows:  # in each island, groups are numbered as they open
        s, island, number = found[k]
        numbers.setdefault((s, island), []).append(number)
    for own in numbers.values():
        assert list(dict.fromkeys(own)) == list(range(len(set(own))))


def test_matching_of_odd_rows(spark):
    schema = "s string, trace_id string, rt double, at string, part int"
    rows = [("a", "t", 1.0), ("a", "t", 1.0), ("a", None, 1.01), ("a", "u", None), ("a", "v", float("nan")), (None, "t", 1.0), (None, "u", 1.05), ("a", "w", float("inf"))]
    got = matching.match_peaks(spark.createDataFrame([(*r, "x", 1) for r in rows], schema), 0.1, "s").collect()
    assert len(got) == len(rows)
    groups = {}
    for r in got:
        if r.rt is None or r.rt != r.rt:
            assert r.island is None and r.match_group is None and r.group_rt is None
        elif r.rt < 2:
            groups.setdefault((r.s, r.match_group), []).append(r.trace_id)
    assert sorted(map(len, groups.values())) == [1, 2, 2] and sorted(groups[(None, 0)]) == ["t", "u"]
    assert matching.match_peaks(spark.createDataFrame([], schema), 0.1, "s").count() == 0


def test_places_of_any_key(spark):
    keys = [f"run {k * 7919 % 1000}#1" for k in range(1000)] + [None, None]
    df = spark.createDataFrame([(k, 0.5, "p") for k in keys], "trace_id string, at double, part string").repartition(6)
    got = tables.numbered(df, "trace_id", "start", width=90).collect()
    assert [r.trace_id for r in sorted((r for r in got if r.trace_id), key=lambda r: r.start)] == sorted(k for k in keys if k)
    assert sorted(r.start for r in got if r.trace_id) == list(range(1000)) and sum(r.start is None for r in got) == 2
    for kind in ("double", "date", "int"):
        typed = spark.range(300).selectExpr(f"cast({'date_add(date' + chr(39) + '2024-01-01' + chr(39) + ', cast(id as int))' if kind == 'date' else 'id * -3'} as {kind}) AS k")
        places = tables.numbered(typed, "k", width=40).collect()
        assert [r.place for r in sorted(places, key=lambda r: r.k)] == list(range(300))
    series = reports.display_series(spark.createDataFrame([("run b#1", [0.0, 1.0], [1.0, 2.0]), ("run a#2", [0.0, 1.0], [4.0, 0.0])], "trace_id string, x array<double>, y array<double>"), stack=0.5)
    assert {r.trace_id: (r.place, r.y) for r in series.collect()} == {"run a#2": (0, [4.0, 0.0]), "run b#1": (1, [3.0, 4.0])}


def test_helper_columns_give_way_to_those_of_tables(spark):
    names = ["cell", "fresh", "at", "to", "own", "reach", "place", "size", "low", "high", "left", "right", "rank", "before", "after", "removed", "new_label", "other", "_fresh", "_meets", "_f", "_cell"]
    extra = {n: F.lit(f"own {n}") for n in names}
    rows = [("t", 1, 0.0, 1.0, 2.0, 5.0, "a"), ("t", 2, 1.5, 2.5, 3.0, 4.0, "b"), ("t", 3, 8.0, 9.0, 10.0, 3.0, None)]
    peaks_ = spark.createDataFrame(rows, "trace_id string, peak_no int, start double, apex double, end double, height double, label string").withColumn("rt", F.col("apex"))
    wide, plain = peaks_.withColumns(extra), peaks_
    kept = lambda df: sorted(map(str, df.select(*[c for c in df.columns if c not in extra]).collect()))
    same = lambda f: [kept(f(t)) for t in (wide, plain)]
    edits_ = spark.createDataFrame([("t", 2, "new", False), ("t", 3, None, True)], "trace_id string, peak_no int, label string, removed boolean")
    windows = spark.createDataFrame([("t", 9, 0.5, 0.9, 1.2)], "trace_id string, peak_no int, start double, apex double, end double")
    for f in (
        lambda t: integration.touching_clusters(t, F.lit(0.1)), lambda t: integration.meets(t, "start", "end", windows, "start", "end", "trace_id"), lambda t: edits.apply_edits(t, edits_, ["label"]),
        lambda t: edits.add_peaks(t, windows.withColumn("apex", F.lit(6.0)).withColumn("end", F.lit(8.5)), F.lit(0.1)), lambda t: reports.label_rows(t, 0.5), lambda t: matching.band_join(t, windows.select(F.col("apex").alias("q")), "apex", "q", 0.3),
        lambda t: tables.thinned(t.withColumn("i", F.col("peak_no")), 2),
    ):
        got, want = same(f)
        assert got == want and set(extra) <= set(f(wide).columns)
        assert {r.cell for r in f(wide).collect()} <= {"own cell", None}
    assert [r.peak_no for r in integration.meets(wide, "start", "end", windows, "start", "end", "trace_id").collect()] == [1]
    assert sorted(r.peak_no for r in integration.meets(wide, "start", "end", windows, "start", "end", "trace_id", inside=False).collect()) == [2, 3]


def test_images_shrink_without_losing_edges():
    from tracewright.sources import images

    pixels = np.zeros((3, 6401, 4), np.uint8)
    pixels[:, -2:] = 200
    small = images.reduced(pixels)
    assert small.shape == (1, 2134, 4) and (small[0, -1] == 200).all() and (small[0, :-1] == 0).all()
    assert images.reduced(pixels[:, :3200]).shape == (3, 3200, 4)


def test_unknowns_of_a_calibration_chart(spark):
    points = spark.createDataFrame([("a", float(x), 1.0 + 2 * x + d, True) for x, d in ((1, 0.01), (2, -0.02), (4, 0.02), (8, -0.01))], "analyte string, x double, y double, include boolean")
    fits = calibration.fit(points, "analyte")
    unknowns = spark.createDataFrame([("a", "u1", 7.0), ("a", "u2", 40.0), ("b", "u3", 1.0), ("a", "u4", None)], "analyte string, trace_id string, response double")
    got = {r.trace_id: r for r in reports.calibration_unknowns(unknowns, fits).collect()}
    assert set(got) == {"u1", "u2", "u4"} and got["u1"].x == pytest.approx(3, abs=0.02) and got["u1"].low < got["u1"].x < got["u1"].high
    assert "extrapolated" in got["u2"].flags and got["u4"].x is None and "noSolution" in got["u4"].flags
