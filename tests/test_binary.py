"""Files of binary formats: written, and read through the data source."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.sources import binary, delimited, formats

X = np.linspace(0.5, 12.5, 481)
Y = np.sin(X) * 1e3 + np.arange(481) / 7


@pytest.mark.parametrize("name", binary.WRITERS)
def test_round_trips(name):
    encode, extension = binary.WRITERS[name]
    for x, y in ((X, Y), (X[:3], Y[:3]), (X[:1], Y[:1])):
        got = formats.parse_file(encode(x, y, name="Detector <1> & \"A\"", y_unit="mAU"), f"f.{extension}")
        if len(x) < 2 and name == "xlsx":
            continue  # one line is no table
        (trace,) = got["traces"]
        assert got["format"] == name and trace["y"] == y.tolist()
        assert trace["x"] == (pytest.approx(x.tolist(), rel=1e-6) if name == "agilent-ch" else x.tolist())
        assert name == "agilent-ch" or "Detector <1>" in trace["name"]


def test_channel_of_differences():
    y = np.array([0, 5, -70000, 70000, 70001, 3] + list(range(600)))
    (trace,) = formats.parse_file(binary.channel(np.arange(len(y)) / 60, y, version="130"), "f.ch")["traces"]
    assert trace["y"] == y.tolist()
    with pytest.raises(ValueError):
        binary.channel(X, Y, version="8")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("files")
    binary.register(spark)
    rows = [(f"run{k % 3}/t{k}", f"n{k}", (X + k).tolist(), (Y * k).tolist()) for k in range(9)]
    for name in ("netcdf", "mzml"):
        df = spark.createDataFrame(rows, "path string, name string, x array<double>, y array<double>").repartition(3)
        df.write.format("tracefiles").option("format", name).mode("append").save(f"{at}/{name}")
    (at / "mzml" / "bad.mzML").write_text("<mzML><run>")
    (at / "mzml" / "_hidden").write_text("x")
    return at


def test_source_reads_traces(spark, folder):
    got = spark.read.format("tracefiles").load(f"{folder}/netcdf").collect()
    assert {(r.name, tuple(r.y)) for r in got} == {(f"n{k}", tuple((Y * k).tolist())) for k in range(9)}
    assert all(r.error is None and r.format == "netcdf" and r.peaks == [] for r in got)
    bad = spark.read.format("tracefiles").load(f"{folder}/mzml").filter("error is not null").collect()
    assert [r.path.rsplit("/", 1)[1] for r in bad] == ["bad.mzML"] and bad[0].x is None


def test_source_prunes_and_pushes(spark, folder, monkeypatch):
    names = spark.read.format("tracefiles").schema("path string, name string").load(f"{folder}/netcdf")
    assert names.columns == ["path", "name"] and {r.name for r in names.collect()} == {f"n{k}" for k in range(9)}
    reader = binary.TraceReader(names.schema, {"path": str(folder), "taskbytes": "20000"})
    every = [p for part in reader.partitions() for p in part.paths]
    assert len(every) == 19 and len(reader.partitions()) > 5 and not any("_hidden" in p for p in every)
    rest = list(reader.pushFilters([binary.StringEndsWith(("path",), "t4.mzML"), binary.EqualTo(("name",), "n4")]))
    assert [type(f) for f in rest] == [binary.EqualTo] and [p.rsplit("/", 1)[1] for part in reader.partitions() for p in part.paths] == ["t4.mzML"]
    good = spark.read.format("tracefiles").load(f"{folder}/mzml").filter(F.col("path").startswith(f"{folder}/mzml/run1") & (F.col("name") != "n1"))
    assert sorted(r.name for r in good.collect()) == ["n4", "n7"]


def test_source_reads_samples(spark, folder, tmp_path):
    x = np.arange(200_000) / 1000
    (tmp_path / "long.cdf").write_bytes(binary.netcdf(x, x * 2))
    got = spark.read.format("tracefiles").option("rows", "samples").load(str(tmp_path))
    assert got.columns == ["path", "trace_no", "name", "x", "y", "format"]
    assert got.agg(F.count("*"), F.sum("x"), F.max(F.abs(F.col("y") - 2 * F.col("x")))).first()[:] == (200_000, pytest.approx(x.sum()), 0.0)
    (tmp_path / "none").mkdir()
    assert spark.read.format("tracefiles").load(f"{tmp_path}/none").count() == 0


def test_source_refuses(spark, folder):
    rows = spark.createDataFrame([("../out", [1.0], [2.0])], "path string, x array<double>, y array<double>")
    for options, df in (({"format": "netcdf"}, rows), ({"format": "other"}, rows), ({}, rows.drop("x"))):
        with pytest.raises(Exception, match="folder|formats|lack"):
            df.write.format("tracefiles").options(**options).mode("append").save(f"{folder}/no")


def test_many_small_files_are_many_tasks(spark, tmp_path):
    for k in range(2500):
        (tmp_path / f"{k}.xlsx").write_bytes(b"PK")
    schema = spark.createDataFrame([], binary.SAMPLE).schema
    parts = binary.TraceReader(schema, {"path": str(tmp_path), "rows": "samples"}).partitions()
    assert sum(len(p.paths) for p in parts) == 2500 and len(parts) >= 3
    assert max(len(p.paths) for p in parts) <= 1024


def test_cells_of_a_workbook_are_read_once(monkeypatch):
    data, read = binary.xlsx(X, Y), []
    number = delimited.parse_number
    monkeypatch.setattr(delimited, "parse_number", lambda *a: read.append(a) or number(*a))
    (trace,) = formats.parse_file(data, "f.xlsx")["traces"]
    assert trace["x"] == X.tolist() and trace["y"] == Y.tolist()
    assert len(read) <= 2 * len(X) + 10


@pytest.mark.parametrize("text, rows", [
    ("a 1 2\tb\n1 2\t3 4\n5 6\t7 8\n", [[1, 2, 3, 4], [5, 6, 7, 8]]),
    ("1\t2\n3 4\t5 6\n7 8\t9 1\n", [[1, 2], [3, 4, 5, 6], [7, 8, 9, 1]]),
    ("1,5 2,5\n2,5 3,5\n", [[1.5, 2.5], [2.5, 3.5]]),
    ('" 5 "\t1\n"6"\t2\n', [[5, 1], [6, 2]]),
])
def test_lines_that_fall_apart_otherwise_are_read_again(text, rows):
    """Blanks as a delimiter still win where they give more numbers than tabs do."""
    assert delimited.parse_table(text).rows == rows
