"""Relational operators on small tables with nulls, ties and empty inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import calibration, gradient, integration, matching
from tracewright.operators import signal as S
from tracewright.plans import views


def test_calibration_line(spark):
    rows = [("a", float(x), y, None) for x, y in zip(range(0, 14, 2), (2.1, 5.0, 9.0, 12.6, 17.3, 21.0, 24.7))] + [("a", None, 1.0, None), ("a", 3.0, 99.0, False), ("b", 1.0, 1.0, None)]
    points = spark.createDataFrame(rows, "analyte string, x double, y double, include boolean")
    c = {r.analyte: r for r in calibration.inverse(calibration.fit(points, "analyte"), F.lit(13.5)).collect()}
    a = c["a"]
    assert a.b1 == pytest.approx(1.9304, abs=1e-4) and a.b0 == pytest.approx(1.5179, abs=1e-4) and a.s == pytest.approx(0.43285, abs=1e-4)
    assert a.r2 == pytest.approx(0.99776, abs=1e-4) and a.lod == pytest.approx(0.740, abs=1e-3) and a.loq == pytest.approx(2.242, abs=1e-3)
    assert a.conc == pytest.approx(6.207, abs=1e-3) and a.conc_se == pytest.approx(0.2398, abs=1e-3)
    assert c["b"].b1 is None and c["b"].conc is None


@pytest.mark.parametrize("weighting", ["none", "1/x", "1/x2"])
@pytest.mark.parametrize("model, true", [("linear", (0.7, 3.2, 0.0)), ("linear0", (0.0, 3.2, 0.0)), ("quadratic", (0.7, 3.2, -0.012))])
def test_exact_calibrations(spark, model, true, weighting):
    xs = [0.5, 1, 2, 5, 10, 20, 50]
    points = spark.createDataFrame([("a", float(x), true[0] + true[1] * x + true[2] * x * x, True) for x in xs], "analyte string, x double, y double, include boolean")
    y0 = true[0] + true[1] * 7.5 + true[2] * 7.5**2
    c = calibration.inverse(calibration.fit(points, "analyte", model, weighting), F.lit(y0), 1, weighting).first()
    assert (c.b0, c.b1, c.b2) == pytest.approx(true, abs=1e-7) and c.conc == pytest.approx(7.5, abs=1e-6)


def test_peak_matching(spark):
    rows = [("s", t, rt) for t, v in {"A": (1.00, 2.00, 5.00), "B": (1.05, 2.08, 3.50), "C": (0.97, 2.30)}.items() for rt in v]
    got = matching.match_peaks(spark.createDataFrame(rows, "set string, trace_id string, rt double"), 0.1, "set").collect()
    groups = {}
    for r in got:
        groups.setdefault((r.island, r.match_group), []).append(r)
    assert len(groups) == 5
    first = groups[min(groups, key=lambda g: min(r.rt for r in groups[g]))]
    assert {r.trace_id for r in first} == {"A", "B", "C"} and first[0].group_rt == pytest.approx(1.00667, abs=1e-5)
    assert all(len({r.trace_id for r in g}) == len(g) for g in groups.values())


def test_analyte_matching(spark):
    peaks = spark.createDataFrame([("S1", 1, 4.79), ("S1", 2, 7.3), ("S2", 1, 4.70), ("S2", 2, 4.83), ("S3", 1, 5.2), ("S3", 2, None)], "trace_id string, peak_no int, rt double")
    analytes = spark.createDataFrame([("x", 4.81)], "analyte string, expected_rt double")
    got = {r.trace_id: r.peak_no for r in matching.match_analytes(peaks, analytes, 0.1).collect()}
    assert got == {"S1": 1, "S2": 2}


def test_gradient_program(spark):
    program = [(0.0, 5.0), (20.0, 95.0), (23.0, 95.0), (23.0, 5.0), (30.0, 5.0)]
    t = spark.createDataFrame([(10.0,), (22.999,), (23.0,), (99.0,), (-1.0,)], "t double")
    assert [r[0] for r in t.select(gradient.b_at(program, F.col("t"))).collect()] == [50.0, 95.0, 5.0, 5.0, 5.0]
    imac = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (15.0, 10.0), (35.0, 100.0), (40.0, 100.0), (40.0, 0.0), (45.0, 0.0)]
    row = spark.range(1).select(gradient.b_at(imac, F.lit(25.0)).alias("b")).first()
    assert row.b == 55.0
    assert spark.range(1).select(gradient.concentration(F.lit(55.0), 0.0, 500.0)).first()[0] == 275.0


def test_traces_from_rows(spark):
    rows = [("a", 2.0, 1.0), ("a", 1.0, 5.0), ("a", None, 1.0), ("a", 3.0, float("nan")), ("a", 1.0, 2.0), ("b", 1.0, None)]
    got = {r.trace_id: (r.x, r.y) for r in views.traces(spark.createDataFrame(rows, "trace_id string, x double, y double")).collect()}
    assert got == {"a": ([1.0, 1.0, 2.0], [2.0, 5.0, 1.0])}


def test_short_and_null_traces(spark):
    df = spark.createDataFrame([(1, [], []), (2, [1.0], [2.0]), (3, None, None), (4, [0.0, 1.0, 2.0], [0.0, 4.0, 0.0])], "trace_id int, x array<double>, y array<double>")
    x, y = F.col("x"), F.col("y")
    out = df.select("trace_id", S.savgol(y).alias("s"), S.noise_sigma(y).alias("n"), S.trapezoid(x, y).alias("a"), S.local_maxima(y).alias("m"), S.normalize(x, y, "max").alias("z"), S.resample(x, y, 3).alias("r"), S.parabolic_apex(x, y).alias("p"))
    got = {r.trace_id: r for r in out.collect()}
    assert got[1].s == [] and got[1].a == 0 and got[1].m == [] and got[1].r is None and got[1].p.rt is None
    assert got[2].s == [2.0] and got[2].n is None and got[3].s is None and got[3].a is None
    assert got[4].m == [1] and got[4].a == 4.0 and got[4].z == [0.0, 1.0, 0.0] and got[4].p.height == 4.0


def test_merge_and_clusters(spark):
    schema = "trace_id int, peak_no int, start double, end double"
    kept = spark.createDataFrame([(1, 1, 2.0, 4.0)], schema)
    found = spark.createDataFrame([(1, 2, 3.5, 5.0), (1, 3, 4.0, 6.0), (2, 4, 2.0, 4.0)], schema)
    assert {(r.peak_no, r.manual) for r in integration.merge_keep(kept, found).collect()} == {(1, True), (3, False), (4, False)}
    assert integration.merge_keep(kept.limit(0), found).count() == 3
    rows = spark.createDataFrame([(1, 1, 0.0, 10.0), (1, 2, 1.0, 2.0), (1, 3, 10.2, 11.0), (1, 4, 12.0, 13.0)], schema)
    got = {r.peak_no: r.cluster for r in integration.touching_clusters(rows, F.lit(0.5)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 2}


def test_drop_conserves_the_cluster(spark):
    import numpy as np

    x = np.linspace(0, 10, 501)
    y = np.exp(-((x - 4) ** 2)) + 0.5 * np.exp(-((x - 6) ** 2)) + 0.1 * x
    df = spark.createDataFrame([(x.tolist(), y.tolist())], "x array<double>, y array<double>")
    area = lambda a, b: integration.drop_area(F.col("x"), F.col("y"), F.lit(a), F.lit(b), F.lit(1.0), F.lit(9.0))
    a, b, whole, hull = df.select(area(1.0, 5.1), area(5.1, 9.0), area(1.0, 9.0), integration.hull_area(F.col("x"), F.col("y"), F.lit(1.0), F.lit(9.0), F.lit(1.0), F.lit(9.0))).first()
    assert a + b == pytest.approx(whole, abs=1e-9) and hull >= whole - 1e-9


def test_analytes_that_share_a_place_are_matched_once(spark, monkeypatch):
    sides, join = [], matching.band_join
    monkeypatch.setattr(matching, "band_join", lambda a, b, *rest: sides.append(b) or join(a, b, *rest))
    rng = np.random.default_rng(3)
    peaks = [(t, n, float(v)) for t in range(7) for n, v in enumerate(np.round(rng.uniform(0, 4, 30), 2))]
    analytes = [(k, float(v)) for k, v in enumerate(np.round(rng.uniform(0, 4, 20), 1).repeat(60))] + [(3, 2.5), (3, 0.5), (None, 1.5), (99, None)]
    df = spark.createDataFrame(peaks, "trace_id int, peak_no int, rt double")
    got = matching.match_analytes(df, spark.createDataFrame(analytes, "analyte int, expected_rt double"), 0.05)
    best = {}
    for t, n, v in peaks:
        for a, e in analytes:
            if e is not None and abs(v - e) <= 0.05:
                best[t, a] = min(best.get((t, a), ((9.0, 0.0, 0), 0)), ((abs(v - e), v, n), e))
    assert sides[0].count() <= 41 and sides[1].count() <= 3 + 60  # places, not analytes; pairs only for the analyte with several
    assert {(r.trace_id, r.analyte): (r.rt, r.peak_no, r.expected_rt) for r in got.collect()} == {k: (v[0][1], v[0][2], v[1]) for k, v in best.items()}


def test_analytes_are_handed_out_by_many_tasks_in_small_files(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(matching, "PAIRS_A_PART", 30_000)
    monkeypatch.setattr(matching, "SMALL_ROWS", 0)
    peaks = spark.range(60).select(F.col("id").alias("trace_id"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("peak_no")).withColumn("rt", F.col("peak_no") + 0.01)
    analytes = spark.range(5 * 2400).select(F.col("id").alias("analyte"), (F.col("id") % 5).cast("double").alias("expected_rt"))
    got = matching.match_analytes(peaks, analytes, 0.05)
    got.write.parquet(str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    assert len(files) > 12  # not as many as a join deals rows to: 4 here
    assert sum(f.stat().st_size for f in files) < 0.6 * 60 * 5 * 2400
    assert back.count() == back.select("trace_id", "analyte").distinct().count() == 60 * 5 * 2400
    assert back.filter("peak_no != analyte % 5 or expected_rt != analyte % 5").count() == 0


@pytest.mark.parametrize("few", [1, 3])
def test_parts_of_places_hold_all_pairs(spark, monkeypatch, few):
    for name in ("RUN", "TRACES", "LISTS_A_PART", "TRACES_A_PART"):
        monkeypatch.setattr(matching, name, few)
    monkeypatch.setattr(matching, "PAIRS_A_PART", 8 * few)
    peaks = [(t if t else None, n, float(v)) for t in range(11) for n, v in enumerate((1.0, 1.04, 2.0, -0.0))]
    analytes = [(k, v) for k, v in enumerate([1.0] * 17 + [2.02] * 2 + [0.0] * 5 + [1.03] + [7.0] * 3)] + [(None, 2.02)]
    got = matching.match_analytes(spark.createDataFrame(peaks, "trace_id int, peak_no int, rt double"), spark.createDataFrame(analytes, "analyte int, expected_rt double"), 0.05)
    near = {1.0: 0, 2.02: 2, 0.0: 3, 1.03: 1}
    want = [(t if t else None, k, near[v]) for t in range(11) for k, v in analytes if v in near]
    assert sorted(((r.trace_id, r.analyte, r.peak_no) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_labels_of_peaks_among_many_equal_places(spark, monkeypatch):
    monkeypatch.setattr(matching, "LIST", 3)
    monkeypatch.setattr(matching, "band_join", None)  # no pairs of peaks and labels are made
    rng = np.random.default_rng(4)
    groups = [(int(k), float(v)) for k, v in enumerate(np.round(rng.uniform(0, 3, 200), 3))] + [(0, 2.0)]
    labels = [(int(k), float(v)) for k, v in enumerate(np.round(rng.uniform(0, 3, 3000), 3))] + [(-5, 1.0), (-6, 1.0), (7, None)]
    got = matching.group_labels(spark.createDataFrame(groups, "key int, rt double"), spark.createDataFrame(labels, "label int, at double"), 0.02)
    want = {}
    for key, rt in groups:
        near = [(abs(rt - at), at, label) for label, at in labels if at is not None and abs(rt - at) <= 0.01]
        if near:
            want[key] = min([*near, *([want[key]] if key in want else [])])
    assert {r.key: r.label for r in got.collect()} == {k: v[2] for k, v in want.items()}


@pytest.mark.parametrize("weighting", ["none", "1/x"])
def test_calibration_rows_of_few_analytes_are_not_shuffled_by_analyte(spark, monkeypatch, weighting):
    monkeypatch.setattr(calibration.frames, "settled", lambda df: df)  # the plan in one piece
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        points = spark.range(100).selectExpr("'a' AS analyte", "double(id) AS x", "2.0 * id + id % 3 AS y", "true AS include")
        c = calibration.fit(points, "analyte", "linear", weighting)
        plan = c._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") <= 1  # of solved curves and their residuals, a row an analyte each
        assert c.first().b1 == pytest.approx(2, abs=0.1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_window_below_its_chord_has_its_apex_at_the_first_bound(spark):
    x = np.arange(8.0)
    df = spark.createDataFrame([("t", x.tolist(), ((x - 3) ** 2).tolist())], "trace_id string, x array<double>, y array<double>")
    row = integration.window_on_all(df, 1.5, 5.25).first()
    assert row.apex == 1.5 and row.area < 0
