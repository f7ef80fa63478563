"""Readers beyond their former limits, and what they bring along besides traces: peaks, events, wavelengths, pixels."""

import base64
import json
import struct
import zlib

import numpy as np
import pytest

from tracewright.operators import image
from tracewright.sources import delimited, formats, images


def parse(text, path="a.txt", **options):
    return formats.parse_file(text.encode() if isinstance(text, str) else text, path, **options)


def mzml(n):
    def arr(kind, values):
        return f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="{kind}" unitAccession="UO:0000031"/><binary>{base64.b64encode(struct.pack("<4d", *values)).decode()}</binary></binaryDataArray>'

    one = lambda k: f'<chromatogram id="c{k}">{arr("MS:1000595", (0, 1, 2, 3))}{arr("MS:1000515", (k, 2, 3, 4))}</chromatogram>'
    return f'<mzML><run><chromatogramList>{"".join(map(one, range(n)))}</chromatogramList></run></mzML>'


def test_all_chromatograms_are_read_unless_a_number_is_given():
    assert len(parse(mzml(60), "a.mzML")["traces"]) == 60
    some = parse(mzml(60), "a.mzML", most=24)
    assert len(some["traces"]) == 24 and "36 of 60" in some["warnings"][0]


def test_all_lines_vote_on_the_decimal_comma():
    rows = [f"{k};{k}" for k in range(4000)] + [f"{4000 + k},5;{k},25" for k in range(40)]
    table = delimited.parse_table("\n".join(rows))
    assert table.rows[-1] == [4039.5, 39.25]


def test_heads_of_any_length():
    lines = [f"key{k}: value" for k in range(90)]
    unicorn = "\n".join([*lines, "UV\t\tcond", "ml\tmAU\tml\tmS/cm", *[f"{k}\t{k * 2}\t{k}\t{k}" for k in range(9)]])
    found = formats._unicorn(unicorn.encode(), {"warnings": []})
    assert [len(t["x"]) for t in found] == [9, 9]
    shimadzu = "[LC Chromatogram(Detector A-Ch1)]\n" + "\n".join(f"Key {k}\tv" for k in range(50)) + "\nIntensity Multiplier\t0.001\nR.Time (min)\tIntensity\n" + "\n".join(f"{k}\t{1000 * k}" for k in range(9))
    (trace,) = formats._shimadzu(shimadzu.encode(), {"warnings": []})
    assert trace["y"][-1] == pytest.approx(8.0) and trace["meta"]["Key 49"] == "v" and "3" not in trace["meta"]


def test_events_stay_with_their_traces(spark):
    text = "\n".join(["UV\t\tFractions\t", "ml\tmAU\tml\t(fraction)"] + [f"{k}\t{k * 2}\t{k * 3}\t\"A{k}\"" for k in range(5)])
    got = formats.parse_files(spark.createDataFrame([("run.asc", text)], "path string, content string"), "unicorn", flow=0.5).first()
    assert got.x[-1] == pytest.approx(8.0)
    assert [(e.curve, e.x, e.label) for e in got.events] == [("Fractions", pytest.approx(6.0 * k), f"A{k}") for k in range(5)]


def test_imported_peaks_are_put_in_order():
    raw = [{"apex": 120, "start": 150, "end": 90, "area": float("nan")}, {"start": 3, "end": 5}, {"apex": 60, "area": 7, "label": 3}]
    got = formats.imported_peaks(raw, "sec")
    assert got == [{"start": 1.0, "apex": 1.0, "end": 1.0, "area": 7.0, "area_se": None, "label": "3"}, {"start": 1.5, "apex": 2.0, "end": 2.5, "area": None, "area_se": None, "label": None}]
    assert formats.imported_peaks([{"apex": 4}], "ml", 2.0)[0]["apex"] == 2.0


def test_peaks_of_json_documents(spark):
    doc = {
        "traces": [{"id": "t1", "name": "one", "x": [0, 1, 2], "y": [0, 5, 0], "peaks": [{"id": "p1", "start": 0.5, "apex": 1, "end": 1.5}]}, {"id": "t2", "name": "two", "x": [0, 1, 2], "y": [0, 1, 0]}],
        "peakRows": [{"trace_id": "t1", "peak_id": "p1", "rt": 9, "area": 13.1}, {"trace_id": "t2", "peak_id": "q", "rt": 1.25, "area": 2}, {"trace_name": "two", "rt": 0.5}],
    }
    rows = formats.parse_files(spark.createDataFrame([("d.json", json.dumps(doc))], "path string, content string")).collect()
    assert [(p.apex, p.area) for p in rows[0].peaks] == [(1.0, 13.1)]  # the trace's own place, the table's area
    assert [(p.apex, p.area) for p in rows[1].peaks] == [(0.5, None), (1.25, 2.0)]


def test_components_of_a_matrix_dataset(spark):
    t, w = [0.1 * k for k in range(20)], [252, 254, 280]
    c = {"time": t, "wavelength": w, "data": [[k * v for v in range(20)] for k in (1, 2, 3)], "peaks": [
        {"left": 2, "maximum": 5, "right": 8, "components": [{"compound_id": "a", "integral": 10, "spectrum": [0.1, 0.2, 0.3], "elution_time": 6}]}, {"left": 10, "maximum": 12, "right": 14}]}
    doc = json.dumps({"chromatograms": {"r": c}, "compounds": {"a": {"name": "caffeine"}}})
    files = spark.createDataFrame([("m.json", doc)], "path string, content string")
    row = formats.parse_files(files).first()
    assert row.format == "json" and row.y[:3] == [0, 2, 4]
    a, b = row.peaks
    assert a.label == "caffeine" and a.area == pytest.approx(10 * 0.2 * 0.1) and a.apex == pytest.approx(0.6)
    assert b.area == pytest.approx(0.4 * 2 * 12) and b.start == pytest.approx(1.0)
    assert formats.at_wavelength(files, 280).first().y[:3] == [0, 3, 6] and formats.at_wavelength(files, "sum").first().y[1] == 6
    assert formats.offered_wavelengths(files).first().wavelengths == [252, 254, 280]


def test_processed_samples_bring_their_peaks():
    doc = {"Samples": {"s": {"Metadata": {"a": 1}, "Raw Data": {"Time (min)": [0, 1, 2], "Signal": [0, None, 1]}, "Processed Data": {
        "C20": {"Peak Area - ensemble": [9, 10, 11], "Retention Time": 1.5, "Model Parameters": {"width": 0.1}}, "C22": {"Peak Area - best fit": 4, "Retention Time": 1.0, "x": [0.8, 1.0, 1.3]}}}}}
    (t,) = parse(json.dumps(doc), "c.json")["traces"]
    one, two = t["peaks"]
    assert (one["label"], one["area"], one["start"], one["end"]) == ("C22", 4.0, 0.8, 1.3)
    assert (two["area"], two["area_se"]) == (10.0, 1.0) and two["start"] == pytest.approx(1.2)


def test_dialects_of_json_can_join_in():
    plug = formats.Plugin("own", ("json",), 5, lambda h, t: 0.0, lambda d, o: [], False, lambda v: 0.95 * (isinstance(v, dict) and "mine" in v), lambda v, o: [formats._trace(range(len(v["mine"])), v["mine"])])
    formats.register(plug)
    try:
        assert parse('{"mine": [1, 2, 3]}', "a.json")["traces"][0]["y"] == [1, 2, 3]
    finally:
        formats.unregister("own")


def test_a_mapping_by_hand():
    text = "junk 1 2\nA,B,C\n5,60,1\n6,120,2\n7,180,3\n"
    found, _ = delimited.traces_of(text, skip=1, header=True, x_col=1, y_cols=[2, 0], unit="sec", y_scale=2.0)
    assert [t["name"] for t in found] == ["C", "A"] and found[0]["x"] == [1, 2, 3] and found[0]["y"] == [2, 4, 6]
    (t,), _ = delimited.traces_of("4\n5\n6\n7\n", x_col=-1, y_cols=[0], step=0.5)
    assert t["x"] == [0, 0.5, 1, 1.5] and t["y"] == [4, 5, 6, 7]
    assert delimited.traces_of(text, x_col=9)[1] == ["the table has no such column"]


def png(pixels):
    h, w, _ = pixels.shape
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + pixels[k].tobytes() for k in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_images_are_decoded_and_digitized(spark, tmp_path):
    from pyspark.sql import functions as F

    y = np.exp(-0.5 * ((np.arange(160) - 80) / 12.0) ** 2)
    pixels = image.draw(y, 320, 240, 0.0, 1.0, (31, 119, 180)).reshape(240, 320, 4)
    (tmp_path / "a.png").write_bytes(png(pixels))
    got = images.read_images(spark, f"file://{tmp_path}")
    row = got.first()
    assert (row.width, row.height) == (320, 240) and row.content == pixels.tobytes()
    axes = F.struct(F.lit(0.0).alias("x0"), F.lit(159 / 319).alias("dx"), F.lit(1.0).alias("y0"), F.lit(-1 / 239).alias("dy"))
    curve = got.select(image.digitized(F.col("content"), F.col("width"), F.col("height"), axes, (31, 119, 180)).alias("c")).first().c
    assert curve.coverage > 0.97 and abs(curve.x[int(np.argmax(curve.y))] - 80) < 2
    small = images.reduced(np.repeat(np.repeat(pixels, 4, 0), 4, 1), 320)
    assert small.shape == (240, 320, 4) and (small == pixels).all()
    files = spark.createDataFrame([("a.PNG",), ("b.csv",), (None,)], "path string")
    assert [d.count() for d in formats.split_files(files)] == [1, 2]
