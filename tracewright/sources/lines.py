"""Delimited text read as Spark lines: however large a file is, its lines stay rows.

Lines are (path, chunk, at, line): ``at`` orders the lines of a chunk, chunks are in order within a path. Which delimiter a
file uses, whether it has a decimal comma, where its table lies and what its header says are aggregations and windows over
lines, and facts of a file go to its lines (broadcast where they are counted to be few), not lines to their file's facts; the
result is one row a sample. ``path`` may be of any type; lines with the same path are one text. ``formats`` reads the same text file by file, with metadata, into traces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import frames, tables

#: Delimiters as patterns, those before win ties.
DELIMITERS = {"\t": "\t", ";": ";", ",": ",", "|": r"\|", " ": r"\s+"}


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of all text files under ``path``. A chunk is a split of a file, which keeps its own order."""
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    block = F.col("_metadata.file_block_start")
    return text.select(F.col("_metadata.file_path").alias("path"), block.alias("chunk"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))


def lines_of(files: DataFrame) -> DataFrame:
    """The lines of whole texts (path, content), one chunk each."""
    each = files.select(F.col("path").cast("string"), F.posexplode(F.split(F.col("content").cast("string"), "\r\n|\r|\n")).alias("at", "line"))
    return each.select("path", F.lit(0).cast("long").alias("chunk"), F.col("at").cast("long").alias("at"), "line")


def _cells(line: Column, delimiter: str) -> Column:
    trimmed = F.trim(line) if delimiter == " " else line
    return F.transform(F.split(trimmed, DELIMITERS[delimiter]), lambda c: F.trim(c))


def _numbers(cells: Column, comma: bool) -> Column:
    """The numbers in cells, quoted perhaps, with thousands groups or a decimal comma; null for any other cell. Step by step
    over the array, so that no step repeats the one before."""
    out = F.transform(cells, lambda c: F.trim(F.regexp_replace(c, '^"|"$', "")))
    if comma:
        out = F.transform(out, lambda c: F.when(c.rlike(r"^[+-]?\d{1,3}(\.\d{3})+(,\d+)?$"), F.replace(c, F.lit("."), F.lit(""))).otherwise(c))
        out = F.transform(out, lambda c: F.replace(c, F.lit(","), F.lit(".")))
    else:
        out = F.transform(out, lambda c: F.when(c.rlike(r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(c, F.lit(","), F.lit(""))).otherwise(c))
    return F.transform(out, lambda c: F.when(c.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), c.try_cast("double")))


def _good(cells: str) -> Column:
    return F.size(F.filter(cells, lambda c: c.isNotNull()))


def _is_data(good: str, size: str) -> Column:
    """At least two numbers, and at most a third as many other cells."""
    return (F.col(good) >= 2) & (3 * (F.col(size) - F.col(good)) <= F.col(good))


def dialects(lines: DataFrame) -> DataFrame:
    """path, delimiter and comma (whether it has a decimal comma) of each file: the delimiter under which its data lines hold
    most numbers, those before win ties.

    Whether a delimiter goes with a decimal comma is a vote of all its cells: 1,5 speaks for it, 1.5 and 1,234.5 against,
    1,234 only if nothing else does. Which digits there are doesn't matter, so lines that differ in these only are read once
    and counted. Aggregations, map-side first, so a file may have any number of lines."""
    t = lines.select("path", F.translate("line", "123456789", "0" * 9).alias("line")).groupBy("path", "line").agg(F.count("*").alias("times"))
    t = t.select("path", "times", *[_cells(F.col("line"), d).alias(f"c{k}") for k, d in enumerate(DELIMITERS)])
    n = lambda k, p: F.size(F.filter(f"c{k}", lambda c: c.rlike(p)))
    each, sums = ["path", "times"], []
    for k in range(len(DELIMITERS)):
        each += [n(k, r"^[+-]?\d*,(\d{1,2}|\d{4,})([eE][+-]?\d+)?$").alias(f"yes{k}"), n(k, r"^[+-]?\d*\.\d+([eE][+-]?\d+)?$|^[+-]?\d{1,3}(,\d{3})+\.\d+$").alias(f"no{k}"), n(k, r"^[+-]?\d{1,3},\d{3}$").alias(f"unsure{k}")]
        each += [F.size(f"c{k}").alias(f"size{k}"), *[F.size(F.filter(_numbers(F.col(f"c{k}"), comma), lambda c: c.isNotNull())).alias(f"good{k}{int(comma)}") for comma in (False, True)]]
        sums += [F.sum(F.col("times") * F.col(f"{c}{k}")).alias(f"{c}{k}") for c in ("yes", "no", "unsure")]
        sums += [F.sum(F.when(_is_data(f"good{k}{comma}", f"size{k}"), F.col("times") * F.col(f"good{k}{comma}")).otherwise(0)).alias(f"n{k}{comma}") for comma in (0, 1)]
    votes = t.select(*each).groupBy("path").agg(*sums)
    choices = []
    for k, d in enumerate(DELIMITERS):
        comma = F.lit(d != ",") & ((F.col(f"yes{k}") > F.col(f"no{k}")) | ((F.col(f"yes{k}") + F.col(f"no{k}") == 0) & (F.col(f"unsure{k}") > 0)))
        choices.append(F.struct(F.when(comma, F.col(f"n{k}1")).otherwise(F.col(f"n{k}0")).alias("n"), F.lit(-k).alias("rank"), F.lit(d).alias("delimiter"), comma.alias("comma")))
    return votes.select("path", F.array_max(F.array(*choices)).alias("d")).filter("d.n > 0").select("path", "d.delimiter", "d.comma")


def table_lines(lines: DataFrame) -> DataFrame:
    """The lines of each file's table: path, chunk, at, delimiter and cells (array of double, null where a cell is no number).

    The table is the longest run, in numeric cells, of data lines; blank lines don't break it. Files without one have no lines
    here."""
    full = lines.filter(F.length(F.trim("line")) > 0)
    each = full.join(frames.facts(dialects(full)), "path")
    cells = F.lit(None).cast("array<string>")
    for d in DELIMITERS:
        cells = F.when(F.col("delimiter") == d, _cells(F.col("line"), d)).otherwise(cells)
    each = each.select("path", "chunk", "at", "delimiter", "comma", cells.alias("texts"))
    each = each.select("path", "chunk", "at", "delimiter", F.when(F.col("comma"), _numbers(F.col("texts"), True)).otherwise(_numbers(F.col("texts"), False)).alias("cells"))
    each = frames.settled(each.withColumns({"good": _good("cells"), "size": F.size("cells")}))  # cells are split and read once
    runs = frames.settled(tables.numbered_runs(each, ["path"], "chunk", "at", _is_data("good", "size")).drop("size"))
    totals = runs.groupBy("path", "run").agg(F.sum("good").alias("n"))
    best = totals.groupBy("path").agg(F.max_by("run", F.struct("n", -F.col("run"))).alias("run"))
    return runs.join(frames.facts(best), ["path", "run"], "left_semi").select("path", "chunk", "at", "delimiter", "cells")


def headers(lines: DataFrame, table: DataFrame) -> DataFrame:
    """path and the header of each table: the cells of the last line before it that isn't blank or a comment; none without."""
    first = table.groupBy("path").agg(F.min(F.struct("chunk", "at")).alias("first"), F.min("delimiter").alias("delimiter"))
    above = lines.filter((F.length(F.trim("line")) > 0) & ~F.ltrim("line").startswith("#")).join(frames.facts(first), "path").filter(F.struct("chunk", "at") < F.col("first"))
    last = above.groupBy("path").agg(F.max_by(F.struct("line", "delimiter"), F.struct("chunk", "at")).alias("h"))
    cells = F.lit(None).cast("array<string>")
    for d in DELIMITERS:
        cells = F.when(F.col("h.delimiter") == d, _cells(F.col("h.line"), d)).otherwise(cells)
    return last.select("path", cells.alias("header")).filter(F.size("header") > 1)


def samples(lines: DataFrame) -> DataFrame:
    """One row a sample: path, column (from 0), name, x, y. x is the first column that the header calls a time, else the first
    one, in minutes where the header names a unit of time; the others are signals. Pairs without both numbers are left out."""
    table = table_lines(lines)
    heads = headers(lines, table)
    unit = F.regexp_extract(F.lower(F.col("head")), r"[\[(]\s*([a-z]+)\s*[\])]", 1)
    is_time = lambda h: F.lower(h).rlike(r"\btime\b|\brt\b|retention|[\[(]\s*(min|sec|s|ms|h)\s*[\])]")
    x_col = F.greatest(F.array_position(F.transform("header", is_time), F.lit(True)) - 1, F.lit(0))
    known = heads.withColumn("x_col", x_col.cast("int")).withColumn("head", F.get("header", F.col("x_col")))
    known = known.withColumn("factor", F.coalesce(scalars.minutes_factor(unit), F.lit(1.0))).drop("head")
    rows = table.join(frames.facts(known), "path", "left").withColumns({"x_col": F.coalesce("x_col", F.lit(0)), "factor": F.coalesce("factor", F.lit(1.0))})
    x = F.get("cells", F.col("x_col")) * F.col("factor")
    each = rows.select("path", "header", "x_col", x.alias("x"), F.posexplode("cells").alias("column", "y")).filter("column <> x_col and x is not null and y is not null")
    name = F.coalesce(F.regexp_replace(F.get("header", F.col("column")), r"\s*[\[(][^\])]*[\])]\s*$", ""), F.format_string("column %d", F.col("column") + 1))
    return each.select("path", "column", name.alias("name"), "x", "y")
