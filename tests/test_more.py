"""Edits, projects, synthetic validation, image quality and JSON dialects."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import clusters, edits, image, kernels, peaks, synthetic
from tracewright.sources import formats, projects


def test_edits(spark):
    p = spark.createDataFrame([(1, 1, "drop", 1.0), (1, 2, None, 2.0), (2, 1, None, 3.0)], "trace_id int, peak_no int, mode string, apex double")
    e = spark.createDataFrame([(1, 2, "fit", None), (2, 1, None, True), (9, 9, "fit", None)], "trace_id int, peak_no int, mode string, removed boolean")
    assert {(r.trace_id, r.peak_no, r["mode"]) for r in edits.apply_edits(p, e, ["mode"]).collect()} == {(1, 1, "drop"), (1, 2, "fit")}
    assert edits.apply_edits(p, e.limit(0), ["mode"]).count() == 3
    schema = "trace_id int, peak_no int, start double, apex double, end double"
    found = spark.createDataFrame([(1, 1, 0.0, 1.0, 2.0), (1, 2, 2.0, 3.0, 4.0), (2, 1, 0.0, 1.0, 2.0)], schema)
    window = spark.createDataFrame([(1, 7, 0.5, 1.2, 2.5)], schema)
    assert {(r.trace_id, r.peak_no, r.manual) for r in edits.replace_inside(found, window).collect()} == {(1, 2, False), (2, 1, False), (1, 7, True)}


def test_printed_peaks_match_one_to_one(spark):
    p = spark.createDataFrame([(1, 1, 5.0), (1, 2, 5.2), (1, 3, 9.0)], "trace_id int, peak_no int, rt double")
    q = spark.createDataFrame([(1, 1, 5.05), (1, 2, 5.1), (1, 3, 20.0), (2, 1, 5.0)], "trace_id int, printed_no int, printed_rt double")
    got = {(r.trace_id, r.printed_no): r.peak_no for r in edits.match_printed(p, q, 0.3).collect()}
    assert got == {(1, 1): 1, (1, 2): None, (1, 3): None, (2, 1): None}


def test_run_info(spark):
    df = spark.createDataFrame([({"Sample Name": " A ", "Instrument": "LC1", "Operator": ""},), (None,)], "meta map<string,string>")
    a, b = [r.i for r in df.select(edits.run_info(F.col("meta")).alias("i")).collect()]
    assert a.sample == "A" and a.instrument == "LC1" and a.operator is None and b.sample is None


def test_drop_areas_of_synthetic_traces(spark):
    t = synthetic.chromatograms(spark, 4)
    t = t.withColumn("peaks", peaks.detected(F.col("x"), F.col("y"), min_width=0.05))
    base = [r.peaks for r in t.collect()]
    assert all(len(b) == 8 for b in base)
    for seed in range(4):
        x, y = synthetic.chromatogram(seed)
        y = y - kernels.als_baseline(y, 1e8, 0.001, 20)
        found = [p[:3] for p in peaks.detect(x, y, min_width=0.05)]
        areas = [r["area"] for r in clusters.integrate(x, y, found, "drop")]
        true = [h * s * np.sqrt(2 * np.pi) for h, _, s, _ in synthetic.SAMPLE]
        assert areas == pytest.approx(true, rel=0.03)


V1 = {"version": 1, "traces": [{"id": "a", "name": "n", "x": [2, 1, None], "y": [5, 4, 1], "peaks": [{"start": 1, "apex": 1.5, "end": 2}]}]}


def test_migration():
    new = projects.migrate(V1)
    assert new["version"] == 2 and new["traces"][0]["peaks"][0]["clip"] == "valley" and new["settings"]["clipDefault"] == "drop"
    assert projects.migrate(new) == new and "clip" not in V1["traces"][0]["peaks"][0]
    assert projects.migrate({"version": 9, "traces": []}) == {"version": 9, "traces": []}
    cal = projects.calibration_of({"calibration": {"analytes": [{"model": "odd", "levels": [{"conc": 1, "include": False}]}]}})
    assert cal["analytes"][0]["model"] == "linear" and cal["analytes"][0]["peakMatch"]["tol"] == 0.1 and cal["analytes"][0]["levels"][0]["include"] is False


def test_projects_to_tables(spark):
    rows = [("a.json", json.dumps(V1)), ("b.json", "{"), ("c.json", json.dumps({"traces": [{"id": 1, "x": [1], "y": [1, 2]}]})), ("d.json", None)]
    got = {r.path: r for r in projects.read_projects(spark.createDataFrame(rows, "path string, content string")).collect()}
    assert got["a.json"].x == [1, 2] and got["a.json"].peaks[0]["mode"] == "valley" and got["a.json"].warnings
    assert got["b.json"].errors and got["c.json"].errors and got["d.json"].errors and got["d.json"].x is None


def test_image_quality(spark):
    rng = np.random.default_rng(1)
    m = np.zeros((200, 300), bool)
    for r in range(20, 180, 30):
        m[np.rint(r + np.tan(np.radians(3)) * (np.arange(300) - 150)).astype(int), np.arange(300)] = True
    assert image.skew_angle(m) == pytest.approx(3, abs=0.1)
    noise = rng.integers(0, 255, (64, 64, 4)).astype(np.uint8)
    flat = np.repeat(np.repeat(noise[::8, ::8], 8, axis=0), 8, axis=1)
    assert image.blockiness(noise) == pytest.approx(1, abs=0.2) and image.blockiness(flat + (noise // 64)) > 3
    raster = image.draw(np.arange(50.0), 200, 100, 0, 50, (200, 30, 30))
    raster[:4] = (20, 60, 200, 255)
    colours = image.dominant_colours(raster)
    assert {tuple(c[:3]) for c in colours} == {(200, 30, 30), (20, 60, 200)}
    r = spark.range(1).select(image.quality_warnings(F.lit(300), F.lit(200), F.lit(0.5), F.lit(1.0)).alias("w")).first()
    assert r.w == ["narrow image", "few pixels", "gaps in the curve"]


def test_json_dialects():
    v = {"chromatograms": {"r1": {"time": [0, 1, 2], "wavelength": [210, 254], "data": [[1, 9, 1], [2, 3, 4]]}}, "compounds": {}}
    read = lambda **o: formats.parse_file(json.dumps(v).encode(), "a.json", **o)["traces"][0]
    assert read()["y"] == [2, 3, 4] and read(wavelength=210)["y"] == [1, 9, 1] and read(wavelength="sum")["y"] == [3, 12, 5] and read(wavelength=300)["y"] == [1, 9, 1]
    s = '{"Samples": {"s1": {"Metadata": {"a": 1}, "Raw Data": {"Time (min)": [0, 1, 2], "Signal (pA)": [1, NaN, 3]}}}}'
    t = formats.parse_file(s.encode(), "b.json")["traces"][0]
    assert t["x"] == [0, 2] and t["name"] == "s1" and t["meta"] == {"a": "1"}


def test_from_traces_to_a_peak_table(spark):
    from tracewright.plans import analysis

    t = synthetic.chromatograms(spark, 3)
    got = analysis.peak_table(t, analysis.Processing(lam=1e8, window=5, min_width=0.05)).toPandas()
    true = {m: h * s * np.sqrt(2 * np.pi) for h, m, s, _ in synthetic.SAMPLE}
    for _, g in got.groupby("trace_id"):
        g = g.sort_values("rt")
        assert len(g) == 8 and g.area_pct.sum() == pytest.approx(100)
        assert g.area.tolist() == pytest.approx(list(true.values()), rel=0.04)
        assert (g.sn > 100).all() and g.resolution.isna().sum() == 1
    assert analysis.Processing(window=4000, p=2.0, iterations=0).clamped() == analysis.Processing(window=1001, p=0.5, iterations=1)
    assert analysis.peak_table(t.limit(0)).count() == 0
