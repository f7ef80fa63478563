"""Traces whose truth is known: sums of peaks on a drift with noise, for validation at any number of seeds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import kernels as K

#: height, centre, sigma, tau of a sample of eight peaks, two of them close together.
SAMPLE = [(42, 2.1, 0.05, 0.03), (55, 4.0, 0.06, 0.04), (38, 5.6, 0.06, 0.03), (47, 7.36, 0.06, 0.03), (36, 7.64, 0.06, 0.03), (60, 10.2, 0.07, 0.05), (30, 13.1, 0.08, 0.05), (25, 16.3, 0.09, 0.06)]


def chromatogram(seed: int, n: int = 4001, t_max: float = 20.0, peaks: list[tuple] | None = None, drift: bool = True, noise: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    x = np.linspace(0, t_max, n)
    y = sum((K.emg(x, *p) for p in peaks or SAMPLE), np.zeros(n))
    if drift:
        y = y + 2.0 + 0.2 * x + np.cos(x / 5)
    return x, y + np.random.default_rng(seed).normal(0, noise, n)


def chromatograms(spark: SparkSession, seeds: int, **options) -> DataFrame:
    """Traces (trace_id = seed, x, y) made where they are used."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                x, y = chromatogram(seed, **options)
                yield pa.RecordBatch.from_arrays([pa.array([seed], pa.int64()), pa.array([x]), pa.array([y])], names=["trace_id", "x", "y"])

    return spark.range(seeds).mapInArrow(make, "trace_id long, x array<double>, y array<double>")


#: Methods to try things on: (minute, %B) rows, what %B means, and the column.
METHODS = {
    "reversed phase": {"rows": [(0.0, 10.0), (15.0, 90.0), (18.0, 90.0), (18.0, 10.0), (25.0, 10.0)], "kind": "organic", "flow": 0.8, "length_mm": 100.0, "id_mm": 3.0, "dwell_ml": 0.6},
    "affinity": {"rows": [(0.0, 0.0), (12.0, 0.0), (12.0, 8.0), (18.0, 8.0), (40.0, 100.0), (45.0, 100.0), (45.0, 0.0)], "kind": "imidazole", "a_conc": 0.0, "b_conc": 400.0, "flow": 1.0},
}


def purification(seed: int = 3, n: int = 3001, t_max: float = 60.0) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Curves of a purification over minutes: UV (what flows through, then three peaks), conductivity and %B."""
    rng, x = np.random.default_rng(seed), np.linspace(0, t_max, n)
    through = 900 / (1 + np.exp(-(x - 4) * 3)) / (1 + np.exp((x - 11) * 2))
    uv = through + sum(K.emg(x, *p) for p in ((120, 22, 0.5, 0.3), (420, 31, 0.7, 0.5), (60, 36, 0.5, 0.2))) + rng.normal(0, 0.5, n)
    t, b = zip(*METHODS["affinity"]["rows"])
    percent = np.interp(x, np.array(t) + np.arange(len(t)) * 1e-9, b)
    return {"UV": (x, uv), "conductivity": (x, 12 + 0.35 * percent + rng.normal(0, 0.05, n)), "%B": (x, percent)}


def calibration_set(spark: SparkSession, levels: tuple[float, ...] = (4.0, 8.0, 20.0, 40.0, 80.0), unknown: float = 30.0, scatter: float = 0.01, seed: int = 1) -> DataFrame:
    """Standards and one unknown of a substance that elutes at 6 minutes, its response slightly curved: trace_id, conc (null for
    the unknown), x, y."""
    rng = np.random.default_rng(seed)
    rows = []
    for k, c in enumerate([*levels, unknown]):
        height = (2.0 * c - 0.002 * c * c) * (1 + scatter * float(rng.normal()))
        x, y = chromatogram(seed + k, 2001, 12.0, [(height, 6.0, 0.08, 0.04)], noise=0.02)
        rows.append((k + 1, float(c) if k < len(levels) else None, x.tolist(), y.tolist()))
    return spark.createDataFrame(rows, "trace_id int, conc double, x array<double>, y array<double>")
