"""Text read line by line against the reader of whole files."""

import random

import pytest

from tracewright.sources import delimited, formats, lines, sections

TEXTS = {
    "tab": "Sample: x\n\nTime (sec)\tA (mAU)\tB\n0\t1\t2\n60\t2\tn.a.\n\n120\t3\t4\nend of data\n",
    "comma": "name;other\nTime (min);Signal\n0,5;1,25\n1,5;2,5\n2,5;3,75\n",
    "blanks": "1 2\n2 3\n3 5\n",
    "grouped": 'Time (min),Y\n1,"1,234.5"\n2,"2,345.5"\n3,"3,456.5"\n',
    "two": "1,2\n3,4\nnote\nTime (min),Y\n1,2\n2,3\n3,4\n",
    "none": "nothing here\nat all\n",
    "empty": "",
}


@pytest.mark.parametrize("chunks", [1, 3])
def test_lines_equal_whole_files(spark, chunks):
    rows = [(path, k * chunks // max(len(t.splitlines()), 1), k, line) for path, t in TEXTS.items() if path != "grouped" for k, line in enumerate(t.split("\n"))]
    got = {}
    for r in lines.samples(spark.createDataFrame(rows, "path string, chunk long, at long, line string").repartition(5)).collect():
        got.setdefault((r.path, r.name), []).append((r.x, r.y))
    want = {}
    for path, text in TEXTS.items():
        if path != "grouped":
            for t in delimited.traces_of(text)[0]:
                want[(path, t["name"])] = list(zip(t["x"], t["y"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: [pytest.approx(p) for p in sorted(v)] for k, v in want.items()}


def test_files_are_read_by_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Time (min)\tY\n" + "".join(f"{k}\t{k * k}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")  # several splits of one file
    try:
        read = lines.read_lines(spark, f"file://{tmp_path}")
        assert read.select("chunk").distinct().count() > 3
        got = sorted((r.x, r.y) for r in lines.samples(read).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(float(k), float(k * k)) for k in range(5000)]
    whole = lines.samples(lines.lines_of(spark.createDataFrame([("b", "Time (min);Y\n1;2\n2;3\n")], "path string, content string")))
    assert sorted((r.path, r.x, r.y) for r in whole.collect()) == [("b", 1.0, 2.0), ("b", 2.0, 3.0)]


def as_lines(spark, texts, chunks):
    rows = [(path, k * chunks // max(t.count("\n"), 1), k, line) for path, t in texts.items() for k, line in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "path string, chunk long, at long, line string").repartition(5)


def by_key(rows, *names):
    out = {}
    for r in rows:
        out.setdefault(tuple(r[n] for n in names), []).append((r.x, r.y))
    return {k: [pytest.approx(p) for p in sorted(v)] for k, v in out.items()}


def whole(parse, texts, name=lambda path, t: (path, t["name"])):
    found = {}
    for path, text in texts.items():
        for t in parse(text.encode(), {"warnings": [], "path": path}):
            found[name(path, t)] = sorted(zip(t["x"], t["y"]))
    return found


@pytest.mark.parametrize("chunks", [1, 4])
def test_chromeleon_by_lines(spark, chunks):
    head = "Injection\t1\nSignal Unit\tmAU\n\n"
    texts = {
        "plain": head + "Chromatogram Data:\nTime (min)\tValue (mAU)\n" + "".join(f"{k / 10}\t{k * k}\n" for k in range(40)),
        "steps": head + "Chromatogram Data:\nTime (min)\tStep (s)\tValue (mAU)\n" + "".join(f"{k / 10}\t0.1\t{-k}\n" for k in range(40)),
        "comma": head.replace("mAU", "mV") + "Chromatogram Data:\r\nTime (sec)\tStep (s)\tValue (mV)\r\n" + "".join(f"{k},5\tn.a.\t{k},25\r\n" for k in range(20)),
        "none": "Injection\t1\n1\t2\n2\t3\n3\t4\n",
    }
    got = sections.chromeleon(as_lines(spark, texts, chunks)).collect()
    assert by_key(got, "path", "name") == whole(formats._chromeleon, {k: t for k, t in texts.items() if k != "none"})
    assert {(r.path, r.y_unit) for r in got} == {("plain", "mAU"), ("steps", "mAU"), ("comma", "mV")}


@pytest.mark.parametrize("chunks", [1, 4])
def test_shimadzu_by_lines(spark, chunks):
    section = lambda name, scale, rows: f"[{name}]\nInterval(msec)\t500\nIntensity Units\tmV\nIntensity Multiplier\t{scale}\n{rows}\n"
    one = "R.Time (min)\tIntensity\n" + "".join(f"{k / 4}\t{1000 * k}\n" for k in range(30))
    two = "R.Time (min)\tCh1\tCh2\n" + "".join(f"{k / 4}\t{k}\t{k * k}\n" for k in range(30))
    texts = {
        "a": "[Header]\nApplication\tx\n1\t2\n2\t3\n\n" + section("LC Chromatogram(Detector A-Ch1)", 0.001, one) + "[Peak Table]\n1\t2\t3\n2\t3\t4\n" + section("LC Chromatogram(Detector B)", 2, two),
        "b": section("PDA Multi Chromatogram(Ch1)", 1, one).replace("\n", "\r\n"),
    }
    got = sections.shimadzu(as_lines(spark, texts, chunks)).collect()
    want = whole(formats._shimadzu, texts)
    assert set(want) == {("a", "LC Chromatogram(Detector A-Ch1)"), ("a", "LC Chromatogram(Detector B) Ch1"), ("a", "LC Chromatogram(Detector B) Ch2"), ("b", "PDA Multi Chromatogram(Ch1)")}
    mine = {(p, f"{s} {n}" if (p, f"{s} {n}") in want else s): v for (p, s, n), v in by_key(got, "path", "section", "name").items()}
    assert mine == want and {r.y_unit for r in got} == {"mV"}


@pytest.mark.parametrize("chunks", [1, 5])
def test_jcamp_by_lines(spark, chunks):
    rng = random.Random(2)
    steps = "##TITLE=packed\n##XUNITS=SECONDS\n##YUNITS=mAU\n##XFACTOR=1\n##YFACTOR=0.5\n##FIRSTX=60\n##LASTX=240\n##NPOINTS=19\n##XYDATA=(X++(Y..Y))\n"
    packed = "60A00KL%Tk $$ note\n120A03J1\n150 B00 +7 -3\n"
    texts = {
        "packed": steps + packed + "##END=\n",
        "long": "##TITLE=long\n##XUNITS=MINUTES\n##DELTAX=0.5\n##FIRSTX=1\n##XYDATA=(X++(Y..Y))\n" + "".join(f"{k} {' '.join(str(rng.randint(-9, 99)) for _ in range(rng.randint(1, 7)))}\n" for k in range(60)) + "##END=",
        "pairs": "##TITLE=p\n##XUNITS=min\n##YFACTOR=2\n##XYPOINTS=(XY..XY)\n1, 2; 2,\n 3; 3 4\n5\n6 7 8 9\n$$ all\n10 11 12\n##END=\n##TITLE=again\n##XUNITS=hours\n##PEAK TABLE=(XY..XY)\n1,2 2,3\n3,1.5e2\n##END=\n",
        "none": "##TITLE=x\n##END=\n1 2\n",
    }
    got = sections.jcamp(as_lines(spark, texts, chunks)).collect()
    assert by_key(got, "path", "name") == whole(formats._jcamp, {k: t for k, t in texts.items() if k != "none"})
    for key in {(r.path, r.block) for r in got}:
        assert sorted(r.i for r in got if (r.path, r.block) == key) == list(range(sum((r.path, r.block) == key for r in got)))


@pytest.mark.parametrize("chunks", [1, 4])
def test_arw_and_unicorn_by_lines(spark, chunks):
    quoted = '"SampleName"\t"Channel"\n"s1"\t"PDA 280 nm"\n' + "".join(f"{k / 60}\t{k * 0.5}\n" for k in range(30))
    texts = {"a.arw": quoted, "b.arw": quoted.replace("Channel", "Other")}
    assert by_key(sections.arw(as_lines(spark, texts, chunks)).collect(), "path", "name") == whole(formats._arw, texts)
    head = 'made\n"UV"\t\t"Cond"\t\tFraction\t\n"ml"\t"mAU"\tml\tmS/cm\tmin\t"Fraction"\n'
    body = "".join(f"{k / 10}\t{k * k}\t{k / 5 if k < 20 else ''}\t{k if k < 20 else ''}\t{k if k < 3 else ''}\t{f'A{k}' if k < 3 else ''}\n" for k in range(30))
    texts = {"u": head + body, "v": (head + body).replace("\t", ";").replace("0.", "0,")}
    samples, events = sections.unicorn(as_lines(spark, texts, chunks))
    assert by_key(samples.collect(), "path", "name") == whole(formats._unicorn, texts)
    want = sorted((p, e["curve"], e["x"], e["label"]) for p, t in texts.items() for e in formats._unicorn(t.encode(), {"warnings": []})[0]["events"])
    assert sorted((e.path, e.curve, e.x, e.label) for e in events.collect()) == want and len(want) == 6


def test_sections_of_nothing(spark):
    none = as_lines(spark, {"a": ""}, 1)
    for read in (sections.chromeleon, sections.shimadzu, sections.arw, sections.jcamp, lambda t: sections.unicorn(t)[0], lambda t: sections.unicorn(t)[1]):
        assert read(none).count() == 0 and read(none.limit(0)).count() == 0


def test_lines_that_differ_in_digits_only_are_read_once(spark):
    from tracewright.sources import lines as L

    text = [f"{k % 90 + 10},{k % 7 + 1};{k % 9 + 1},5" for k in range(500)] + ["made by hand"]
    rows = spark.createDataFrame([("a", 0, k, t) for k, t in enumerate(text)], "path string, chunk long, at long, line string")
    found = L.dialects(rows)
    assert [tuple(r) for r in found.collect()] == [("a", ";", True)]
    assert "translate(line" in found._jdf.queryExecution().optimizedPlan().toString()
