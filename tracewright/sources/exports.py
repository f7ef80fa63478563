"""Documented tables out: peak, trace, calibration and data rows of fixed columns, CSV with comments and units, JSON
documents, JSON Schema of a table.

Columns keep their names, types and order; new ones are only added at the end. Units are column metadata, as templates
({x}, {y}: the units of a trace's axes, {conc}: that of concentrations) that ``with_units`` fills in.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import signal as S

SCHEMA_VERSION = 2
PEAK_COLUMNS = {
    "schema_version": ("int", ""), "trace_id": ("string", ""), "trace_name": ("string", ""), "peak_no": ("int", ""), "peak_id": ("string", ""), "label": ("string", ""), "manual": ("boolean", ""), "shoulder": ("boolean", ""),
    "mode": ("string", ""), "requested_mode": ("string", ""), "cluster": ("int", ""), "cluster_size": ("int", ""), "host": ("int", ""), "start": ("double", "{x}"), "apex": ("double", "{x}"), "end": ("double", "{x}"),
    "rt": ("double", "{x}"), "height": ("double", "{y}"), "area": ("double", "{y}*{x}"), "area_pct": ("double", "%"), "gross_area": ("double", "{y}*{x}"), "baseline_area": ("double", "{y}*{x}"),
    "fwhm": ("double", "{x}"), "w10": ("double", "{x}"), "w5": ("double", "{x}"), "tailing": ("double", ""), "asymmetry": ("double", ""), "plates": ("double", ""), "plates_usp": ("double", ""), "k": ("double", ""),
    "resolution": ("double", ""), "sn": ("double", ""), "elution_b": ("double", "%"), "elution_conc": ("double", "{conc}"), "analyte": ("string", ""), "conc": ("double", "{conc}"), "conc_lo": ("double", "{conc}"),
    "conc_hi": ("double", "{conc}"), "conc_flags": ("string", ""), "flags": ("string", ""),
}
TRACE_COLUMNS = {
    "schema_version": ("int", ""), "trace_id": ("string", ""), "trace_name": ("string", ""), "source_format": ("string", ""), "source_path": ("string", ""), "role": ("string", ""), "digitized": ("boolean", ""),
    "x_unit": ("string", ""), "y_unit": ("string", ""), "n_points": ("int", ""), "x_min": ("double", "{x}"), "x_max": ("double", "{x}"), "y_min": ("double", "{y}"), "y_max": ("double", "{y}"), "noise": ("double", "{y}"),
    "p2p": ("double", "{y}"), "n_peaks": ("int", ""), "total_area": ("double", "{y}*{x}"), "largest_rt": ("double", "{x}"), "largest_area_pct": ("double", "%"), "smoothing_window": ("int", ""), "baseline_lambda": ("double", ""),
    "wavelength": ("double", "nm"),
}
CALIBRATION_COLUMNS = {
    "analyte": ("string", ""), "level": ("string", ""), "label": ("string", ""), "conc": ("double", "{conc}"), "response": ("double", ""), "included": ("boolean", ""), "fitted": ("double", ""), "residual": ("double", ""),
    "back_conc": ("double", "{conc}"), "recovery_pct": ("double", "%"), "flags": ("string", ""), "missing": ("string", ""),
}


def fixed(df: DataFrame, columns: dict[str, tuple[str, str]], units: dict[str, str] | None = None) -> DataFrame:
    """``df`` with exactly ``columns``, cast to their types; those that it lacks are null, lists of flags are joined by a
    semicolon, and NaN is null. ``units`` fills in the templates of the columns' units."""
    out = []
    kinds = {f.name: f.dataType.typeName() for f in df.schema.fields}
    for name, (kind, unit) in columns.items():
        c = F.col(name) if name in kinds else F.lit(None)
        if kinds.get(name) == "array":
            c = F.concat_ws(";", c)
        elif kinds.get(name) in ("double", "float"):
            c = F.when(~F.isnan(c), c)
        for part, text in (units or {}).items():
            unit = unit.replace("{%s}" % part, text)
        out.append(c.cast(kind).alias(name, metadata={"unit": unit}))
    return df.select(*out)


def peak_rows(peaks: DataFrame, units: dict[str, str] | None = None) -> DataFrame:
    """Peaks as rows of PEAK_COLUMNS, of signals only (a ``role`` other than signal leaves a row out)."""
    if "role" in peaks.columns:
        peaks = peaks.filter(F.coalesce("role", F.lit("signal")) == "signal")
    return fixed(peaks.withColumn("schema_version", F.lit(SCHEMA_VERSION)), PEAK_COLUMNS, units)


def trace_rows(traces: DataFrame, peaks: DataFrame | None = None, units: dict[str, str] | None = None) -> DataFrame:
    """Traces (trace_id, x, y and what else there is of TRACE_COLUMNS) as rows of TRACE_COLUMNS, with sums over ``peaks``
    (trace_id, rt, area, area_pct) if given; a trace without peaks has none and no area."""
    x, y = F.col("x"), F.col("y")
    t = traces.withColumns({"schema_version": F.lit(SCHEMA_VERSION), "n_points": F.size(x), "x_min": F.array_min(x), "x_max": F.array_max(x), "y_min": F.array_min(y), "y_max": F.array_max(y), "noise": S.noise_sigma(y)})
    t = t.withColumn("p2p", 6 * F.col("noise")).drop("x", "y")
    if peaks is not None:
        g = peaks.groupBy("trace_id").agg(F.count("*").alias("n_peaks"), F.sum("area").alias("total_area"), F.max_by("rt", "area_pct").alias("largest_rt"), F.max("area_pct").alias("largest_area_pct"))
        t = t.join(g, "trace_id", "left").withColumn("n_peaks", F.coalesce("n_peaks", F.lit(0)))
    return fixed(t, TRACE_COLUMNS, units)


def in_scope(traces: DataFrame, scope: str = "all", active: Column | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The traces that an export is about: all, those that are ``visible`` (a null counts as visible), or the active one
    (``active`` picks it out); and of these only those whose trace_id is in ``ids``, if given."""
    if scope not in ("all", "visible", "active"):
        raise ValueError(scope)
    if scope == "visible":
        traces = traces.filter(F.coalesce("visible", F.lit(True)))
    elif scope == "active":
        traces = traces.filter(F.lit(False) if active is None else F.coalesce(active, F.lit(False)))
    return traces if ids is None else traces.join(ids.select("trace_id"), "trace_id", "left_semi")


def data_rows(traces: DataFrame) -> DataFrame:
    """Long rows of traces (trace_id, trace_name, x, y, y_processed, digitized); missing values are null."""
    z = F.arrays_zip(F.col("x"), F.col("y"), F.col("y_processed"))
    return traces.select("trace_id", "trace_name", F.explode(z).alias("s"), "digitized").select("trace_id", "trace_name", "s.x", "s.y", "s.y_processed", "digitized")


def with_units(df: DataFrame, units: dict[str, str]) -> DataFrame:
    """``df`` whose columns carry their units as metadata."""
    for name, unit in units.items():
        df = df.withMetadata(name, {**df.schema[name].metadata, "unit": unit})
    return df


def _cell(c: Column, kind: str) -> Column:
    if kind in ("double", "float"):
        text = F.when(F.isnan(c) | c.isNull(), "").otherwise(F.regexp_replace(F.format_string("%.9e", c), r"(\.\d*?)0+e|\.e", "$1e"))
        plain = c.cast("string")
        return F.when(F.length(plain) <= 12, F.coalesce(plain, F.lit(""))).otherwise(text)
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, order: list[str]) -> DataFrame:
    """One column ``line`` of quoted CSV cells (numbers with ten significant digits), sorted as ``order`` says."""
    cells = [_cell(F.col(f.name), f.dataType.typeName()) for f in df.schema.fields]
    return df.orderBy(*order).select(F.concat_ws(",", *cells).alias("line"))


def csv_head(df: DataFrame, comments: list[str] = ()) -> list[str]:
    """The lines before a CSV's rows: comments, the columns' units if any has one, the names."""
    units = [f.metadata.get("unit", "") for f in df.schema.fields]
    return [*(f"# {c}" for c in comments), *(["# units: " + ",".join(units)] if any(units) else []), ",".join(df.columns)]


def write_csv(df: DataFrame, path: str, order: list[str], comments: list[str] = ()) -> None:
    """CSV part files written where the rows are, range-sorted by ``order``, so that names in order give the rows in order.
    The lines before the rows (csv_head) are the first part."""
    head = df.sparkSession.createDataFrame([("\n".join(csv_head(df, list(comments))),)], "line string").coalesce(1)
    head.unionByName(csv_lines(df, order)).write.mode("overwrite").text(path)


def write_documents(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines under its name, with its JSON Schema beside it: what a project, its traces or its
    calibration are saved as."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
        schema = df.sparkSession.createDataFrame([(json.dumps(describe(df, name)),)], "value string")
        schema.coalesce(1).write.mode("overwrite").text(f"{path}/{name}.schema")


def describe(df: DataFrame, title: str) -> dict:
    """A JSON Schema (draft 2020-12) of the rows of ``df``."""
    kinds = {"long": "integer", "integer": "integer", "short": "integer", "double": "number", "float": "number", "boolean": "boolean", "array": "array", "map": "object", "struct": "object"}
    properties = {}
    for f in df.schema.fields:
        kind = kinds.get(f.dataType.typeName(), "string")
        properties[f.name] = {"type": [kind, "null"] if f.nullable else kind} | ({"unit": f.metadata["unit"]} if "unit" in f.metadata else {})
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": title, "type": "object", "properties": properties, "required": df.columns}
