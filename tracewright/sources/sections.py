"""Sectioned texts read as Spark lines: JCAMP-DX, and the text exports of several vendors.

Lines are those of ``lines`` (path, chunk, at, line). Which section or block a line is in, what the line before it ended with and how
many values come before it are scans over chunks (``tables.last_before``, ``sum_before``), so a file of any size stays rows. What
a section says of itself (factors, units, names) is joined to its lines as facts. The result is one row a sample.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import frames, tables
from . import lines as L
from .formats import jcamp_line

NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"


def _bare(lines: DataFrame) -> DataFrame:
    return lines.select("path", "chunk", "at", F.rtrim(F.regexp_replace("line", "\r", "")).alias("line"))


def in_sections(lines: DataFrame, name: Column) -> DataFrame:
    """Adds section: struct(chunk, at, name) of the last line up to this one whose ``name`` isn't null; null before the first."""
    mark = F.when(name.isNotNull(), F.struct("chunk", "at", name.alias("name")))
    return tables.last_before(lines, ["path"], mark, "section", inclusive=True)


def _cells(line: Column, separators: str = "\t") -> Column:
    return F.transform(F.split(line, f"[{separators}]"), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))


def chromeleon(lines: DataFrame) -> DataFrame:
    """Samples (path, column, name, x, y, y_unit) of the table after the line "Chromatogram Data:". Its first line is the header;
    columns of step widths are left out. y_unit is what "Signal Unit" says."""
    marker = F.col("line").contains("Chromatogram Data:")
    rows = frames.settled(in_sections(_bare(lines), F.when(marker, F.lit("data"))))  # read for the head, units, dialects and samples
    body = rows.filter(F.col("section").isNotNull() & ~marker & (F.trim("line") != ""))
    head = body.groupBy("path").agg(F.min_by(F.split("line", "\t"), F.struct("chunk", "at")).alias("names"))
    step = F.exists("names", lambda n: F.lower(n).startswith("step"))
    head = frames.facts(head.select("path", "names").filter(step))  # few files have such a column
    kept = F.array_join(F.filter(F.split("line", "\t"), lambda c, k: ~F.lower(F.coalesce(F.get("names", k), F.lit(""))).startswith("step")), "\t")
    table = body.join(head, "path", "left").withColumn("line", F.when(F.col("names").isNull(), F.col("line")).otherwise(kept))
    unit = F.when(F.col("section").isNull(), F.nullif(F.trim(F.regexp_extract("line", r"^Signal Unit\t(.*)$", 1)), F.lit("")))
    units = frames.facts(rows.groupBy("path").agg(F.min_by(unit, F.when(unit.isNotNull(), F.struct("chunk", "at"))).alias("y_unit")).filter("y_unit is not null"))
    return L.samples(table.select("path", "chunk", "at", "line")).join(units, "path", "left")


def shimadzu(lines: DataFrame) -> DataFrame:
    """Samples (path, section, section_at, column, name, x, y, y_unit) of the tables in sections of chromatograms, all their intensity
    columns. y is multiplied by what the section calls a multiplier."""
    title = F.regexp_extract("line", r"^\[([^\]]+)\]\s*$", 1)
    rows = in_sections(_bare(lines), F.when(title != "", title))
    lower = F.lower("section.name")
    rows = rows.filter(F.col("section").isNotNull() & (lower.startswith("lc chromatogram") | lower.contains("chromatogram(")) & (title == ""))
    rows = frames.settled(rows.withColumn("path", F.struct("path", "section")))  # read for the facts, dialects and samples
    key, value = F.regexp_extract("line", r"^([^\t,]+)[\t,]", 1), F.trim(F.regexp_extract("line", r"^[^\t,]+[\t,](.*)$", 1))
    first = lambda found, what: F.min_by(what, F.when(found, F.struct("chunk", "at")))
    scale = F.lower(key).contains("multiplier") & value.try_cast("double").isNotNull()
    said = frames.facts(rows.filter(key != "").groupBy("path").agg(first(scale, value.try_cast("double")).alias("scale"), first(key == "Intensity Units", value).alias("y_unit")))
    found = L.samples(rows.select("path", "chunk", "at", "line")).join(said, "path", "left")
    y = F.col("y") * F.coalesce("scale", F.lit(1.0))
    at = F.struct("path.section.chunk", "path.section.at").alias("section_at")
    return found.select(F.col("path.path").alias("path"), F.col("path.section.name").alias("section"), at, "column", "name", "x", y.alias("y"), "y_unit")


def arw(lines: DataFrame) -> DataFrame:
    """Samples (path, column, name, x, y) below a head of quoted names and values; name is what it calls the channel, else the sample."""
    rows = _bare(lines)
    found = L.samples(rows.filter(~F.col("line").startswith('"')))
    quoted = rows.filter(F.col("line").startswith('"')).groupBy("path").agg(F.min(F.struct("chunk", "at")).alias("first"), F.max(F.struct("chunk", "at")).alias("last"))
    head = rows.filter(F.trim("line") != "").join(frames.facts(quoted), "path").filter(F.struct("chunk", "at").between(F.col("first"), F.col("last")))
    after = tables.last_before(head.drop("first", "last"), ["path"], F.col("line"), "above")  # the lines of the table aren't put in order
    pair = after.filter(F.col("line").startswith('"') & F.col("above").startswith('"'))
    pair = pair.select("path", "chunk", "at", F.inline(F.arrays_zip(_cells(F.col("above")).alias("key"), _cells(F.col("line")).alias("value"))))
    first = lambda name: F.min_by("value", F.when((F.col("key") == name) & F.col("value").isNotNull(), F.struct("chunk", "at")))
    names = pair.groupBy("path").agg(F.coalesce(first("Channel"), first("SampleName")).alias("known"))
    return found.join(frames.facts(names), "path", "left").select("path", "column", F.coalesce("known", "name").alias("name"), "x", "y")


def unicorn(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples, events): samples (path, pair, name, x, x_unit, y, y_unit) and events (path, curve, x, x_unit, label) of pairs of columns
    under a row of units. A pair with a value that is no number holds events. Times are in minutes."""
    rows = _bare(lines).withColumn("cells", _cells(F.col("line"), "\t;"))
    units = F.filter("cells", lambda c, k: (k % 2 == 0) & (c != ""))
    is_units = (F.size("cells") >= 2) & F.forall(units, lambda c: F.lower(c).isin("ml", "min", "cv", "sec")) & (F.col("line") != "")
    rows = tables.last_before(rows, ["path"], F.col("cells"), "above")
    heads = rows.filter(is_units).groupBy("path").agg(F.min(F.struct("chunk", "at", F.col("cells").alias("units"), F.col("above").alias("names"))).alias("head"))
    below = rows.join(frames.facts(heads), "path").filter(F.struct("chunk", "at") > F.struct("head.chunk", "head.at"))
    each = F.transform(F.sequence(F.lit(0), F.floor(F.size("head.units") / 2).cast("int") - 1), lambda k: F.struct(k.alias("pair"), F.get("cells", 2 * k).alias("a"), F.get("cells", 2 * k + 1).alias("b")))
    cells = below.select("path", "chunk", "at", "head", F.inline(each)).filter("a is not null and b is not null and a <> ''")
    number = lambda c: F.when(F.regexp_replace(c, ",", ".").rlike(f"^{NUMBER}$"), F.regexp_replace(c, ",", ".").try_cast("double"))
    unit = F.lower(F.get("head.units", 2 * F.col("pair")))
    named = F.coalesce(F.nullif(F.get("head.names", 2 * F.col("pair")), F.lit("")), F.nullif(F.get("head.names", 2 * F.col("pair") + 1), F.lit("")), F.format_string("curve %d", F.col("pair") + 1))
    factor = F.coalesce(scalars.minutes_factor(unit), F.lit(1.0))
    shown = F.when(scalars.minutes_factor(unit).isNotNull(), F.lit("min")).otherwise(unit)
    cells = cells.select("path", "pair", named.alias("name"), (number(F.col("a")) * factor).alias("x"), shown.alias("x_unit"), number(F.col("b")).alias("y"), F.get("head.units", 2 * F.col("pair") + 1).alias("y_unit"), F.col("b").alias("label"))
    cells = frames.settled(cells)
    texts = frames.facts(cells.groupBy("path", "pair").agg(F.max(F.col("y").isNull()).alias("is_text")))
    both = cells.join(texts, ["path", "pair"]).filter("x is not null")
    samples = both.filter("not is_text").select("path", "pair", "name", "x", "x_unit", "y", "y_unit")
    return samples, both.filter("is_text").select("path", F.col("name").alias("curve"), "x", "x_unit", "label")


def _ordinates(line: Column) -> Column:
    """Ordinates of lines in compressed forms, and whether they end in differences."""

    @F.arrow_udf("struct<v:array<double>,differing:boolean>")
    def read(line: pa.Array) -> pa.Array:
        found = [jcamp_line(text or "") for text in line.to_pylist()]
        return pa.array([{"v": v, "differing": d} for v, d in found], pa.struct([("v", pa.list_(pa.float64())), ("differing", pa.bool_())]))

    return read(line)


#: Labels of tables of data, those before go first if a block has several.
TABLES = ("XYDATA", "XYPOINTS", "PEAKTABLE")


def jcamp(lines: DataFrame) -> DataFrame:
    """Samples (path, block, name, i, x, y, y_unit) of all blocks with data; ``i`` counts a block's samples from 0, times are in minutes.

    Ordinates in (X++(Y..Y)), compressed or not, get their places from the block's first place, step and the number of values
    in the lines before; where a line ends in differences, the first value of the next one repeats its last and is left out.
    Pairs in (XY..XY) may go on in the next line."""
    rows = tables.sum_before(_bare(lines), ["path"], F.col("line").startswith("##END=").cast("int"), "block").filter(~F.col("line").startswith("##END="))
    label = F.upper(F.regexp_replace(F.regexp_extract("line", r"^##([^=]*)=", 1), r"[\s_/-]", ""))
    own = F.when(F.col("line").startswith("##"), F.struct("chunk", "at", label.alias("label"), F.trim(F.regexp_replace("line", r"^##[^=]*=", "")).alias("value")))
    keys = ["path", "block"]
    rows = frames.settled(tables.last_before(rows, keys, own, "said", inclusive=True))
    labels = rows.filter(F.col("line").startswith("##"))
    last = lambda *names: F.max_by("said.value", F.when(F.col("said.label").isin(*names), F.struct("chunk", "at")))
    number = lambda name: F.regexp_extract(last(name), r"^\S+", 0).try_cast("double")
    rank = F.array_position(F.array(*map(F.lit, TABLES)), F.col("said.label"))
    data = F.min_by(F.struct("said.chunk", "said.at", F.col("said.value").contains("++").alias("steps")), F.when(rank > 0, F.struct(rank, -F.col("chunk").cast("long"))))
    unit = F.lower(F.trim(last("XUNITS")))
    facts = labels.groupBy(*keys).agg(
        data.alias("data"), F.coalesce(number("XFACTOR"), F.lit(1.0)).alias("fx"), F.coalesce(number("YFACTOR"), F.lit(1.0)).alias("fy"), number("FIRSTX").alias("first_x"), number("LASTX").alias("last_x"),
        number("NPOINTS").alias("n"), number("DELTAX").alias("dx"), F.coalesce(scalars.minutes_factor(unit), F.lit(1.0)).alias("factor"), F.coalesce(last("TITLE"), F.lit("")).alias("name"), last("YUNITS").alias("y_unit"),
    )
    step = F.when(F.col("last_x").isNotNull() & (F.col("n") > 1), (F.col("last_x") - F.col("first_x")) / (F.col("n") - 1)).otherwise(F.coalesce("dx", F.lit(1.0)))
    facts = frames.facts(facts.filter("data is not null").withColumn("step", step))
    body = rows.join(facts, keys).filter((F.struct("said.chunk", "said.at") == F.struct("data.chunk", "data.at")) & ~F.col("line").startswith("##"))
    body = body.withColumn("line", F.trim(F.regexp_replace("line", r"\$\$.*", "")))
    told = ["name", "y_unit", "factor"]

    packed = body.filter("data.steps").filter(F.col("line").rlike(f"^{NUMBER}"))
    packed = packed.select(*keys, "chunk", "at", *told, "fx", "fy", "first_x", "step", _ordinates(F.regexp_replace("line", f"^{NUMBER}", "")).alias("o"))
    packed = tables.last_before(frames.settled(packed), keys, F.when(F.size("o.v") > 0, F.col("o.differing")), "check")
    values = F.when(F.coalesce("check", F.lit(False)) & (F.size("o.v") > 0), F.slice("o.v", 2, F.greatest(F.size("o.v") - 1, F.lit(0)))).otherwise(F.col("o.v"))
    packed = tables.sum_before(packed.withColumn("values", values), keys, F.size("values").cast("long"), "start")
    packed = packed.select(*keys, *told, "fy", "first_x", "step", "start", F.posexplode("values").alias("k", "v")).withColumn("i", F.col("start") + F.col("k"))
    packed = packed.select(*keys, "name", "i", ((F.col("first_x") + F.col("step") * F.col("i")) * F.col("factor")).alias("x"), (F.col("v") * F.col("fy")).alias("y"), "y_unit")

    tokens = F.transform(F.regexp_extract_all("line", F.lit(f"({NUMBER})")), lambda t: t.cast("double"))
    pairs = body.filter("not data.steps").select(*keys, "chunk", "at", *told, "fx", "fy", tokens.alias("v")).filter("size(v) > 0")
    pairs = tables.sum_before(frames.settled(pairs), keys, F.size("v").cast("long"), "start")
    pairs = tables.last_before(pairs, keys, F.element_at("v", -1), "left")
    pairs = pairs.withColumn("v", F.when(F.col("start") % 2 == 1, F.concat(F.array("left"), F.col("v"))).otherwise(F.col("v"))).withColumn("start", F.floor(F.col("start") / 2))
    pairs = pairs.filter("size(v) > 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.size("v") / 2).cast("int") - 1)))
    place = F.get("v", 2 * F.col("k")) * F.col("fx") * F.col("factor")
    pairs = pairs.select(*keys, "name", (F.col("start") + F.col("k")).alias("i"), place.alias("x"), (F.get("v", 2 * F.col("k") + 1) * F.col("fy")).alias("y"), "y_unit")
    return packed.unionByName(pairs).filter("x is not null and not isnan(x) and y is not null and not isnan(y)")
