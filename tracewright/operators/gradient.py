"""Solvent programs: rows (t, b) of a method as one small array, so they are looked up without a join."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def b_at(rows: list[tuple[float, float]], t: Column, mode: str = "linear") -> Column:
    """%B of the program at time ``t``: held outside, linear or stepwise between; of rows at one time the later holds."""
    rows = [r for _, r in sorted(enumerate(rows), key=lambda e: (e[1][0], e[0]))]
    out = F.lit(float(rows[-1][1]))
    for (t0, b0), (t1, b1) in reversed(list(zip(rows, rows[1:]))):
        inside = F.lit(float(b0)) if mode == "step" or t1 == t0 else F.lit(float(b0)) + (t - t0) * ((b1 - b0) / (t1 - t0))
        out = F.when(t < t1, inside).otherwise(out)
    return F.when(t < rows[0][0], F.lit(float(rows[0][1]))).otherwise(out)


def concentration(b: Column, a_conc: float, b_conc: float) -> Column:
    return F.lit(a_conc) + (F.lit(b_conc) - F.lit(a_conc)) * b / 100


def dwell_time(volume_ml: float, flow: float) -> float:
    return volume_ml / flow


def void_volume(length_mm: float, id_mm: float, porosity: float = 0.65) -> float:
    """mL of a column: porosity times pi r^2 L."""
    return porosity * math.pi * (id_mm / 2) ** 2 * length_mm / 1000


def b_at_elution(rows: list[tuple[float, float]], rt: Column, dwell: float, void: float, mode: str = "linear") -> Column:
    """%B that left the mixer when what elutes at ``rt`` entered the column; before the program, its start."""
    return b_at(rows, F.greatest(F.lit(0.0), rt - dwell - void), mode)


def gradient_curve(rows: list[tuple[float, float]], t_max: float, n: int, delay: float = 0.0, mode: str = "linear") -> Column:
    """array<struct(t, b)> on an even grid and at the program's breakpoints, all later by ``delay``. Where the program
    steps, both values are there, first the one before."""
    rows = [r for _, r in sorted(enumerate(rows), key=lambda e: (e[1][0], e[0]))]

    def value(t: float, before: bool = False) -> float:
        last = max((k for k, (a, _) in enumerate(rows) if a < t or a == t and not before), default=None)
        if last is None or last == len(rows) - 1:
            return rows[0 if last is None else -1][1]
        (t0, b0), (t1, b1) = rows[last], rows[last + 1]
        return b0 if mode == "step" or t1 == t0 else b0 + (t - t0) * (b1 - b0) / (t1 - t0)

    breaks = {t + delay for t, _ in rows if t + delay <= t_max}
    nodes = []
    for t in sorted({t_max * i / max(n - 1, 1) for i in range(n)} | breaks):
        own, before = value(t - delay), value(t - delay, True)
        nodes += [(t, before)] * (t in breaks and abs(own - before) > 1e-12) + [(t, own)]
    return F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(b)).alias("b")) for t, b in nodes])


def steepest_ramp(rows: list[tuple[float, float]]) -> tuple[float, float, float, float] | None:
    """(t0, b0, t1, b1) of the segment with the largest change of %B over time; None for a program that holds."""
    ramps = [(t0, b0, t1, b1) for (t0, b0), (t1, b1) in zip(rows, rows[1:]) if t1 > t0 and b1 != b0]
    return max(ramps, key=lambda v: abs(v[3] - v[1]), default=None)


def summary(rows: list[tuple[float, float]], flow: float | None = None) -> str:
    """A program in words: its largest ramp, and the flow."""
    ramp = steepest_ramp(rows)
    text = f"isocratic, {rows[0][1]:g} % B" if ramp is None else f"{ramp[1]:g} to {ramp[3]:g} % B in {ramp[2] - ramp[0]:g} min"
    return text + (f", {flow:g} mL/min" if flow else "")


def to_minutes(x: Column, unit: Column, flow: Column) -> Column:
    """A place in minutes: volumes (mL) by the flow, where there is one; null for column volumes and without a flow."""
    return F.when(unit == "min", x).when((F.lower(unit) == "ml") & (flow > 0), x / flow)


def read_out(x: Column, y: Column, at: Column, rows: list[tuple[float, float]], delay: float = 0.0, mode: str = "linear") -> Column:
    """struct(x, y, b): the sample nearest to a place and %B there. Nulls for an empty trace."""
    far = F.transform(x, lambda v: F.abs(v - at))
    k = F.array_position(far, F.array_min(far)).cast("int") - 1
    place = F.get(x, k)
    return F.struct(place.alias("x"), F.get(y, k).alias("y"), F.when(place.isNotNull(), b_at(rows, F.greatest(place - delay, F.lit(0.0)), mode)).alias("b"))
