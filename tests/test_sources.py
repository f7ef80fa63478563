"""Readers on files built here from public format descriptions."""

import base64
import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalars
from tracewright.sources import delimited, exports, formats
from tracewright.streaming.ingest import ingest


def read(data, path="f.txt", **options):
    return formats.parse_file(data if isinstance(data, bytes) else data.encode(), path, **options)


def one(data, path="f.txt", **options):
    got = read(data, path, **options)
    assert got["error"] is None, got
    return got["traces"][0]


def test_delimited():
    t = one("# made\nSample: A1\nTime (sec),Absorbance (mAU)\n0,1\n60,2\n120,3\n")
    assert t["x"] == [0, 1, 2] and t["y"] == [1, 2, 3] and t["y_unit"] == "mAU" and t["meta"]["Sample"] == "A1"
    assert one("Time (min);y\n0,5;1,25\n1,0;2,5\n1,5;3\n")["y"] == [1.25, 2.5, 3]
    assert one("t\tv\n1\t1,234.5\n2\t2,000\n3\t1\n")["y"] == [1234.5, 2000, 1]
    multi = read("Volume (ml),UV 280 nm (mAU),Cond (mS/cm),GP (%B)\n1,2,3,4\n2,3,4,5\n3,4,5,6\n", flow=0.5)["traces"]
    assert [m["role"] for m in multi] == ["signal", "conductivity", "gradient"] and multi[0]["x"] == [2, 4, 6]
    assert one("1,1\n\n2,2\n\n2.5,4\n3,9\n")["x"] == [1, 2, 2.5, 3]
    assert read("")["error"] and read("nothing here\nat all")["error"]
    assert delimited.wavelength_of("UV 273 nm") == 273 and delimited.wavelength_of("99 nm") is None


def test_numbers():
    assert delimited.parse_number('"1,234.5"') == 1234.5 and delimited.parse_number("1,5", True) == 1.5 and np.isnan(delimited.parse_number("n.a."))
    assert delimited.uses_decimal_comma(["1,5", "2,25"]) and not delimited.uses_decimal_comma(["1,234.5"]) and delimited.uses_decimal_comma(["1,234"])


@pytest.mark.parametrize("shape", [[{"x": 1, "y": 2}, {"x": 2, "y": 3}, {"x": 3, "y": 4}], [[1, 2], [2, 3], [3, 4]], {"x": [1, 2, 3], "y": [2, 3, 4]}, {"traces": [{"name": "a", "X": [1, 2, 3], "Y": [2, 3, 4]}]}, {"data": [[1, 2], [2, 3], [3, 4]]}])
def test_json(shape):
    t = one(json.dumps(shape), "a.json")
    assert t["x"] == [1, 2, 3] and t["y"] == [2, 3, 4]


def test_json_without_numbers():
    assert one('{"x":[1,2,3,4],"y":[1,NaN,Infinity,4]}', "a.json")["y"] == [1, 4]


def test_jcamp():
    assert formats.jcamp_line("A00KL%Tk")[0] == [100, 102, 105, 105, 105, 103]
    head = "##TITLE=t\n##JCAMP-DX=4.24\n##XUNITS=MINUTES\n##XFACTOR=1\n##YFACTOR=0.5\n##FIRSTX=0\n##LASTX=5\n##NPOINTS=6\n##XYDATA=(X++(Y..Y))\n"
    assert one(f"{head}0 10 20 30\n3 40 50 60\n##END=\n", "a.jdx")["y"] == [5, 10, 15, 20, 25, 30]
    t = read(f"{head}0 A0JJ\n2 A2JJJ\n##END=\n", "a.jdx")
    assert t["traces"][0]["y"] == [5, 5.5, 6, 6.5, 7, 7.5] and not t["warnings"]


def mzml(arrays, compress=True):
    def array(values, kind, name, unit=""):
        raw = np.array(values, kind).tobytes()
        raw = zlib.compress(raw) if compress else raw
        bits = {"<f8": "MS:1000523", "<f4": "MS:1000521"}[kind]
        return f'<binaryDataArray><cvParam accession="{bits}"/>' + ('<cvParam accession="MS:1000574"/>' if compress else "") + f'<cvParam accession="{name}" {unit}/><binary>{base64.b64encode(raw).decode()}</binary></binaryDataArray>'

    body = "".join(
        f'<chromatogram id="{n}"><cvParam accession="{k}"/><binaryDataArrayList>{array(x, "<f8", "MS:1000595", u)}{array(y, "<f4", "MS:1000515")}</binaryDataArrayList></chromatogram>'
        for n, k, x, y, u in arrays
    )
    return f'<?xml version="1.0"?><mzML xmlns="http://psi.hupo.org/ms/mzml"><run><chromatogramList>{body}</chromatogramList></run></mzML>'


def test_mzml():
    second = 'unitAccession="UO:0000010"'
    got = read(mzml([("bpc", "MS:1000628", [0, 60, 600], [1, 2, 3], second), ("tic", "MS:1000235", [0, 60, 600], [4, 5, 6], second)]), "a.mzML")
    assert [t["name"] for t in got["traces"]] == ["tic", "bpc"] and got["traces"][0]["x"] == [0, 1, 10] and got["traces"][0]["y"] == [4, 5, 6]
    assert one(mzml([("a", "MS:1000235", [0, 1, 2], [4, 5, 6], "")], False), "a.mzML")["x"] == [0, 1, 2]


def netcdf(values, interval):
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: struct.pack(">I", len(s)) + pad(s.encode())
    dims = struct.pack(">II", 10, 2) + name("point_number") + struct.pack(">I", len(values)) + name("one") + struct.pack(">I", 1)
    atts = struct.pack(">II", 12, 1) + name("retention_unit") + struct.pack(">II", 2, 7) + pad(b"seconds")
    none = struct.pack(">II", 0, 0)

    def variables(at):
        out, begin = struct.pack(">II", 11, 2), at
        for n, d, size in (("ordinate_values", 0, 4 * len(values)), ("actual_sampling_interval", 1, 4)):
            out += name(n) + struct.pack(">II", 1, d) + none + struct.pack(">III", 5, size, begin)
            begin += size
        return out

    head = b"CDF\x01" + struct.pack(">I", 0) + dims + atts
    return head + variables(len(head) + len(variables(0))) + np.array(values, ">f4").tobytes() + np.array([interval], ">f4").tobytes()


def test_netcdf():
    t = one(netcdf([1, 2, 3, 4], 30.0), "a.cdf")
    assert t["x"] == [0, 0.5, 1, 1.5] and t["y"] == [1, 2, 3, 4]


def channel(version, body, start=0.0, end=60000.0):
    head = bytearray(6144)
    head[0] = len(version)
    head[1 : 1 + len(version)] = version.encode()
    struct.pack_into(">ff", head, 282, start, end)
    struct.pack_into(">d", head, 4732, 1.0)
    return bytes(head) + body


def test_channel_files():
    body = struct.pack(">BB", 0x10, 3) + struct.pack(">hi", -32768, 500) + struct.pack(">hh", 1, 2)
    assert one(channel("130", body), "a.ch")["y"] == [500, 501, 503]
    assert one(channel("179", np.array([3, 5, 20, 6], "<f8").tobytes()), "a.ch")["x"] == pytest.approx([0, 1 / 3, 2 / 3, 1])
    body = struct.pack(">hhI", -32768, 0, 1000) + struct.pack(">hhh", 3, 2, -3)
    assert one(channel("181", body), "a.ch")["y"] == [1000, 1003, 1008, 1010]


def test_vendor_texts():
    t = one("Injection\t1\nSignal Unit\tmAU\nChromatogram Data:\nTime (min)\tStep (s)\tValue (mAU)\n0.0\tn.a.\t1\n0.1\t1\t2\n0.2\t1\t3\n")
    assert t["y"] == [1, 2, 3] and t["y_unit"] == "mAU"
    t = one("[Header]\nApplication\tx\n[LC Chromatogram(Detector A-Ch1)]\nInterval(msec)\t500\nIntensity Multiplier\t0.001\nR.Time (min)\tIntensity\n0.0\t1000\n0.1\t2000\n0.2\t3000\n[Peak Table]\n1\t2\n", "a.txt")
    assert t["y"] == pytest.approx([1, 2, 3])
    t = one('"SampleName"\t"Channel"\n"s1"\t"PDA 254.0nm"\n0.0\t0.1\n0.1\t0.2\n0.2\t0.3\n', "a.arw")
    assert t["y_unit"] == "AU" and t["meta"]["SampleName"] == "s1"
    got = read("x\n\"UV 280\"\t\"\"\t\"Cond\"\t\"\"\t\"Fraction\"\t\"\"\nml\tmAU\tml\tmS/cm\tml\t(Fractions)\n0\t1\t0\t5\t0\tA1\n1\t2\t1\t6\t1\tA2\n2\t3\t2\t7\t\t\n", "a.asc", flow=0.5)
    assert got["format"] == "unicorn" and [t["role"] for t in got["traces"]] == ["signal", "conductivity"] and got["traces"][0]["x"] == [0, 2, 4]
    assert one("0,1\n1,2\n2,3\n".encode("utf-16"), "a.csv")["y_unit"] == "mAU"
    assert "export" in read(b"\x01\xa1" + bytes(200), "a.raw")["error"]


def test_xlsx():
    out = io.BytesIO()
    rows = "".join(f'<row r="{k}"><c r="A{k}" t="inlineStr"><is><t>{a}</t></is></c><c r="B{k}" t="inlineStr"><is><t>{b}</t></is></c></row>' if isinstance(a, str) else f'<row r="{k}"><c r="A{k}"><v>{a}</v></c><c r="B{k}"><v>{b}</v></c></row>' for k, (a, b) in enumerate([("Time (min)", "UV (mAU)"), (0, 1), (1, 2), (2, 5)], 1))
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("[Content_Types].xml", "<x/>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')
    assert one(out.getvalue(), "a.xlsx")["y"] == [1, 2, 5]


def test_registry():
    formats.register(formats.Plugin("mine", ("mine",), 5, lambda h, t: float(t.startswith("MINE")), lambda d, o: [formats._trace([0, 1, 2], [7, 8, 9])]))
    assert one("MINE")["y"] == [7, 8, 9] and formats.listed()[0].id == "mine"
    formats.unregister("mine")
    assert "mine" not in formats.PLUGINS


def test_files_to_traces(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Time (min),y\n0,1\n1,2\n2,3\n")
    (tmp_path / "b.json").write_text("[[0,1],[1,2],[2,3]]")
    (tmp_path / "c.raw").write_bytes(b"\x01\xa1" + bytes(100))
    got = {r.path.rpartition("/")[2]: r for r in formats.read_files(spark, str(tmp_path)).collect()}
    assert got["a.csv"].y == [1, 2, 3] and got["b.json"].format == "json" and got["c.raw"].error


def test_streaming_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("Time (min),y\n0,1\n1,2\n2,3\n")
    run = lambda: ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    run()
    (tmp_path / "in" / "b.csv").write_text("Time (min),y\n0,1\n1,2\n2,3\n")
    run()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([("sec", "Cond (mS/cm)", "UV 280 nm", ' "1,234.5" ', "#0af", "/a/b.CSV", 1234.567, "aGk_")], "u string, h string, w string, n string, c string, p string, v double, b string")
    r = df.select(scalars.minutes_factor(F.col("u")).alias("f"), scalars.role_of(F.col("h")).alias("role"), scalars.wavelength_of(F.col("w")).alias("nm"), scalars.parse_number(F.col("n")).alias("n"), scalars.hex_to_rgb(F.col("c")).alias("c"), scalars.extension(F.col("p")).alias("e"), scalars.base_name(F.col("p")).alias("base"), scalars.round_significant(F.col("v"), 3).alias("v"), scalars.unpadded_base64(F.col("b")).alias("b")).first()
    assert (r.f, r.role, r.nm, r.n, tuple(r.c), r.e, r.base, r.v, bytes(r.b)) == (1 / 60, "conductivity", 280, 1234.5, (0, 170, 255), "csv", "b", 1230.0, b"hi?")


def test_exports(spark):
    df = exports.with_units(spark.createDataFrame([(1, 'a "b", c', 0.5, True), (2, None, None, False)], "id long, name string, v double, ok boolean"), {"v": "mAU"})
    assert [r.line for r in exports.csv_lines(df, ["id"]).collect()] == ['1,"a ""b"", c",0.5,true', "2,,,false"]
    d = exports.describe(df, "rows")
    assert d["properties"]["v"] == {"type": ["number", "null"], "unit": "mAU"} and d["required"] == df.columns
