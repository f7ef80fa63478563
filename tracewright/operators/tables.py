"""Relational pieces of table reading and display: runs of numeric lines, column statistics, thinning, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames


def best_run(lines: DataFrame, by: str, at: str, numeric: Column, bad: Column, least: int = 2) -> DataFrame:
    """For each ``by`` the run of consecutive data lines with most numeric cells (the first of equals): start, end, cells.

    A line is one of data if it has at least ``least`` numeric cells and at most a third as many others.
    """
    rows = lines.select(by, at, numeric.alias("_n"), ((numeric >= least) & (3 * bad <= numeric)).alias("_data"))
    order = Window.partitionBy(by).orderBy(at)
    breaks = F.sum(F.when(F.col("_data"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = rows.withColumn("_run", breaks).filter("_data").groupBy(by, "_run").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.sum("_n").alias("cells"))
    return runs.groupBy(by).agg(F.max_by(F.struct("start", "end", "cells"), F.struct("cells", -F.col("_run"))).alias("r")).select(by, "r.*")


def column_stats(cells: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """n, low, high and monotone (at least 3 values, not all equal, and 98 % of the steps up, or down; equal steps count
    both ways) of each ``by`` in order of ``at``."""
    rows = cells.filter(F.col(value).isNotNull() & ~F.isnan(value))
    d = rows.withColumn("_d", F.col(value) - F.lag(value).over(Window.partitionBy(by).orderBy(at)))
    g = d.groupBy(by).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.avg((F.col("_d") >= 0).cast("double")).alias("_up"), F.avg((F.col("_d") <= 0).cast("double")).alias("_down")
    )
    good = (F.col("n") >= 3) & (F.col("high") > F.col("low")) & (F.greatest("_up", "_down") >= 0.98)
    return g.select(by, "n", "low", "high", good.alias("monotone"))


def thinned(points: DataFrame, most: int, by: str = "trace_id") -> DataFrame:
    """Every k-th sample, k the number of samples over ``most``, at least 1, for drawing."""
    (size,) = frames.unused(points, "size")
    n = points.groupBy(by).agg(F.count("*").alias(size))
    stride = F.greatest(F.floor(F.col(size) / most), F.lit(1))
    return points.join(n, by).filter(F.col("i") % stride == 0).drop(size)


def visible_signals(traces: DataFrame, unit: str | None = None) -> DataFrame:
    """Traces that are shown, are signals (not gradients, conductivities, ...), and have the given unit of x."""
    shown = F.coalesce("visible", F.lit(True)) & (F.coalesce("role", F.lit("signal")) == "signal")
    return traces.filter(shown & (F.col("x_unit") == unit) if unit else shown)


def numbered(df: DataFrame, key: str, name: str = "place", width: int = frames.ROWS_A_PART) -> DataFrame:
    """Adds ``name``: the place (from 0) of each row by its ``key``, of any type that has an order; nulls have none. Rows with
    equal keys are numbered in any order. Rows are put in order over range partitions of about ``width`` rows with sampled bounds; a place is the
    rows of all earlier partitions, a sum over one row a partition, and the place in its own. No task sees all rows."""
    at, part = frames.free("at", [*df.columns, name]), frames.free("part", [*df.columns, name])
    start = frames.free("start", [*df.columns, name])
    ordered = frames.in_order(df.filter(F.col(key).isNotNull()), [key], at, width).withColumn(part, frames.part_of(at))
    before = frames.starts(ordered, part, [], F.count("*"), start)
    local = F.col(at).bitwiseAND((1 << frames.PART_BITS) - 1)
    placed = ordered.join(F.broadcast(before), part).withColumn(name, F.col(start) + local)  # a row a partition
    none = df.filter(F.col(key).isNull()).withColumn(name, F.lit(None).cast("long"))
    return placed.select(*df.columns, name).unionByName(none)


def last_before(rows: DataFrame, by: list[str], value: Column, name: str, inclusive: bool = False) -> DataFrame:
    """Adds ``name``: the last ``value`` that isn't null in the lines (``by``, chunk, at) before this one, or up to it. Lines are
    scanned chunk by chunk and chunks by what each ends with, so however many lines a group has, no task sees them all."""
    own, end, before = (frames.free(c, [*rows.columns, name]) for c in ("own", "end", "before"))
    marked = rows.withColumn(own, value)
    order = Window.partitionBy(*by, "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ends = marked.groupBy(*by, "chunk").agg(F.max_by(own, F.when(F.col(own).isNotNull(), F.col("at"))).alias(end))
    chunks = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = frames.facts(ends.select(*by, "chunk", F.last(end, ignorenulls=True).over(chunks).alias(before)).filter(F.col(before).isNotNull()))
    local = marked.withColumn(name, F.last(own, ignorenulls=True).over(order))
    out = local.join(carried, [*by, "chunk"], "left").withColumn(name, F.coalesce(name, before))
    return out.select(*rows.columns, name)


def sum_before(rows: DataFrame, by: list[str], size: Column, name: str) -> DataFrame:
    """Adds ``name``: what ``size`` adds up to in the lines (``by``, chunk, at) before this one, scanned as in last_before()."""
    own, start = (frames.free(c, [*rows.columns, name]) for c in ("own", "start"))
    marked = rows.withColumn(own, size)
    order = Window.partitionBy(*by, "chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = frames.facts(frames.starts(marked, "chunk", by, F.sum(own), start))
    local = marked.withColumn(name, F.coalesce(F.sum(own).over(order), F.lit(0)))
    return local.join(before, [*by, "chunk"]).withColumn(name, F.col(name) + F.col(start)).select(*rows.columns, name)


def numbered_runs(rows: DataFrame, by: list[str], chunk: str, at: str, good: Column) -> DataFrame:
    """The good rows with ``run``, which numbers runs of consecutive good rows of each ``by``, in order of chunk, then ``at``.
    Rows are counted chunk by chunk and chunks in order, so a ``by`` with very many rows isn't one task's."""
    bad, local, start = (frames.free(c, [*rows.columns, "run"]) for c in ("bad", "local", "start"))
    marked = rows.withColumn(bad, F.when(good, 0).otherwise(1))
    keys = [*by, chunk]
    counted = F.sum(bad).over(Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    before = frames.facts(frames.starts(marked, chunk, by, F.sum(bad), start))
    out = marked.withColumn(local, counted).filter(F.col(bad) == 0).join(before, keys)
    return out.withColumn("run", F.col(start) + F.col(local)).drop(bad, local, start)
