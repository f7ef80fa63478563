"""Untrusted documents and share links: no JSON value may raise, everything that is changed is reported, bombs are refused."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.functions import lz
from tracewright.sources import projects

NAMES = ["version", "traces", "settings", "calibration", "notes", "id", "name", "x", "y", "peaks", "start", "apex", "end", "clip", "label", "meta", "proc", "window", "p", "clipDefault", "analytes", "peakMatch", "levels", "rt", "tol", "model", "conc", "include", "__proto__", "other", "xUnit", "unit"]


def random_json(rng, depth=0):
    kind = rng.random()
    if depth < 6 and kind < 0.45:
        return {rng.choice(NAMES): random_json(rng, depth + 1) for _ in range(rng.randint(0, 6))}
    if depth < 6 and kind < 0.7:
        return [random_json(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return rng.choice([None, True, False, 0, 1, -3.5, 1e308, 10**400, float("nan"), float("inf"), "", "x", "2", "drop", "linear", "é\ud800", "n" * 300])


def is_clean(document):
    for t in document["traces"]:
        assert len(t["x"]) == len(t["y"]) and all(v is None or isinstance(v, float) for v in t["x"] + t["y"])
        assert isinstance(t["id"], str) and len(t["name"]) <= 200 and all(isinstance(v, str) for kv in t["meta"].items() for v in kv)
        assert all(p["start"] <= p["apex"] <= p["end"] for p in t["peaks"]) and set(t["proc"]) <= set(projects.LIMITS)
    assert document["version"] == projects.VERSION and isinstance(document["notes"], str)
    json.dumps(document, allow_nan=False)


def test_any_json_value_is_taken():
    rng = random.Random(11)
    for k in range(10_000):
        value = random_json(rng)
        if k % 2 and isinstance(value, dict):
            value["traces"] = [random_json(rng, 2) for _ in range(2)]
        document, findings = projects.examined(value)
        is_clean(document)
        assert all(isinstance(a, str) and isinstance(b, str) for a, b in findings)
        again, rest = projects.examined(document)
        assert again == document and not [f for f in rest if f[1] != "unknown value"]
        errors, warnings = projects.problems(value)
        assert projects.calibration_of(value)["analytes"] == document["calibration"]["analytes"] or not isinstance(value, dict) or projects._depth(value) > projects.DEPTH
        assert all(isinstance(e, str) for e in errors + warnings)


def test_findings_say_what_was_done():
    bad = {
        "version": "a", "extra": 1, "__proto__": {}, "notes": "n" * 50, "calibration": [1],
        "traces": [{"id": [1], "name": "n" * 50, "x": [1, "a", 3], "y": [1, 2], "peaks": 5, "proc": {"window": 5000, "order": 2}, "meta": {"a": {}}}, 1],
    }
    document, findings = projects.examined(bad, projects.Lengths(name=10, note=20))
    assert dict(findings) == {
        ".extra": "unknown key", ".__proto__": "unsafe key", "version": "no finite number", "notes": "shortened from 50 to 20 characters", "calibration": "no object",
        "traces[0].id": "no text", "traces[0].name": "shortened from 50 to 10 characters", "traces[0].x": "1 values are no finite numbers", "traces[0]": "x has 3 values, y 2",
        "traces[0].peaks": "no list", "traces[0].proc.window": "brought within 3 and 1001", "traces[0].meta.a": "no text", "traces[1]": "no object",
    }
    assert document["traces"][0]["x"] == [1.0, None] and document["notes"] == "n" * 20
    assert projects.examined(bad, projects.Lengths(note=10**9))[0]["notes"] == "n" * 50
    deep = current = {}
    for _ in range(5000):
        current["a"] = current = {}
    assert projects.examined(deep)[1] == [("", "nests too deeply")]
    for call in (projects.sanitized, projects.migrate):
        with pytest.raises(ValueError, match="deeply"):
            call(deep)


def test_documents_of_any_kind_give_rows(spark):
    odd = [{"traces": [1]}, {"traces": 5}, {"traces": [{"x": [1], "y": [2], "peaks": 5}]}, {"traces": [], "calibration": [1]}, {"traces": [], "calibration": {"analytes": [1]}}, {"version": "a", "traces": []}, [1], None, {"traces": [{"x": ["a"], "y": [1]}]}, {"traces": [{"id": [1], "x": [1, 2], "y": [1, None]}], "version": 1}]
    texts = [*map(json.dumps, odd), "[" * 5000, "not json", "", '{"traces": [{"name": "\\ud800", "x": [1], "y": [10e400]}]}']
    files = spark.createDataFrame(list(enumerate(texts)), "path int, content string").selectExpr("cast(path as string) AS path", "content")
    read = {r.path: r for r in projects.read_projects(files).collect()}
    assert set(read) == {"0", "1", "2", "5", "6", "7", "8", "9", "10", "11", "12", "13"}  # documents without traces have no rows
    assert all(read[k].errors for k in ("0", "1", "2", "5", "6", "7", "8", "10", "11", "12")) and read["9"].trace_id == "[1]" and read["13"].x == []
    got = projects.examined_documents(files).collect()
    assert len(got) == len(texts)
    for r in got:
        is_clean(json.loads(r.document))
    assert {r.path for r in got if [tuple(f) for f in r.findings] == [("", "no JSON")]} == {"10", "11", "12"}


def test_known_packed_texts():
    """Published examples of the codec."""
    assert lz.compress("你好", lz.BASE64) == "gbyl9NI" and lz.decompress("gbyl9NI=", 10, lz.BASE64) == "你好"
    assert lz.compress("hello, i am a 猫", lz.BASE64) == "BYUwNmD2A0AECWsCGBbZtDUzkA" and lz.decompress("BYUwNmD2A0AECWsCGBbZtDUzkA==", 99, lz.BASE64) == "hello, i am a 猫"
    assert lz.compress("") == "Q" and lz.decompress("Q", 0) == ""


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(), max_size=300), st.integers(1, 5))
def test_links_round_trip(text, times):
    assert lz.decompress(lz.compress(text * times), 10_000) == text * times


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=lz.LINK, max_size=60))
def test_any_packed_text_is_read_or_refused(text):
    try:
        assert len(lz.decompress(text, 500)) <= 500
    except ValueError:
        pass


def test_links_of_both_codecs():
    project = {"version": 2, "traces": [{"id": "é猫", "x": [0.5, 1], "y": [1, None]}], "notes": "a" * 5000, "images": ["big"]}
    for codec in ("zlib", "lz"):
        link = projects.pack_link(project, codec)
        assert projects.unpack_link(f"https://host/#{link}") == {k: v for k, v in project.items() if k != "images"}
        with pytest.raises(ValueError, match="large|long"):
            projects.unpack_link(link, 2000)
    for bad in ("p=", "p=????", "p=Q", "x", "p=" + "A" * 500, "#p=" + lz.compress("[" * 5000)):
        with pytest.raises(ValueError):
            projects.unpack_link(bad)


def test_rows_of_many_projects_leave_in_few_batches():
    import pyarrow as pa

    text = '{"version": 2, "traces": [{"id": 1, "x": [0, 1], "y": [2, 3]}]}'
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(1000)]), pa.array([text] * 999 + ["nothing"])], names=["path", "content"])
    (made,) = projects.project_batches(iter([batch]))
    assert made.num_rows == 1000 and made.column("path").to_pylist() == [str(k) for k in range(1000)]
    assert made.column("errors").to_pylist()[998:] == [[], ["not a project: Expecting value: line 1 column 1 (char 0)"]]


def test_links_are_packed_once_and_on_all_cores(spark):
    from tracewright.plans import more_queries

    links = more_queries.links_opened(spark, "/root/testdata/sf0.001")
    assert links.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert links._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("ArrowEvalPython [packed(") == 1
