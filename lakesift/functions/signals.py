"""The signal functions as expressions over array columns: no Python worker. Meant for short arrays; long clips go through lakesift.functions.dsp in Arrow batches."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lakesift.functions.dsp import planes


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def sign_bucket(vector: Column, n_bits: int, dim: int, seed: int = 42) -> Column:
    """Random-projection key: bit i is set where the vector lies on the positive side of plane i."""
    key = F.lit(0).cast("bigint")
    for i, plane in enumerate(planes(n_bits, dim, seed).astype(np.float64)):
        side = dot(vector, F.array(*(F.lit(float(v)) for v in plane)))
        key = key + F.when(side > 0, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint")
    return key


def frame_levels(samples: Column, length: int) -> Column:
    """Levels of centred, half-overlapping frames, zero-padded."""
    hop, pad = length // 2, F.array_repeat(F.lit(0.0), length // 2)
    padded = F.concat(pad, F.transform(samples, lambda x: x.cast("double")), pad)
    starts = F.sequence(F.lit(0), F.floor((F.size(padded) - length) / hop).cast("int"))
    square = lambda frame: F.aggregate(frame, F.lit(0.0), lambda s, x: s + x * x)
    return F.transform(starts, lambda k: F.sqrt(square(F.slice(padded, k * hop + 1, length)) / length))


def array_percentile(values: Column, p: float) -> Column:
    """Linear percentile of an array of doubles."""
    ordered = F.array_sort(values)
    at = (F.size(values) - 1) * F.lit(p)
    low = F.element_at(ordered, (F.floor(at) + 1).cast("int"))
    high = F.element_at(ordered, (F.ceil(at) + 1).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def snr_db(levels: Column) -> Column:
    heard = F.filter(levels, lambda x: x > 0)
    quiet, loud = array_percentile(heard, 0.1), array_percentile(heard, 0.9)
    value = F.least(F.greatest(20 * F.log10(loud / (quiet + 1e-10)), F.lit(0.0)), F.lit(80.0))
    return F.when(F.size(heard) == 0, 0.0).when(quiet < 1e-10, 60.0).when(loud < 1e-10, 0.0).otherwise(value)


def silence_ratio(levels: Column, n: Column, hop: int, top_db: float = 30.0) -> Column:
    peak = F.array_max(levels)
    floor = lambda x: F.greatest(x, F.lit(1e-5))
    loud = lambda x: 20 * F.log10(floor(x)) - 20 * F.log10(floor(peak)) > -top_db
    spans = F.transform(levels, lambda x, k: F.when(loud(x), F.least((k + 1) * hop, n) - F.least(k * hop, n)).otherwise(0))
    speech = F.aggregate(spans, F.lit(0).cast("int"), lambda s, x: s + x.cast("int"))
    return F.when(peak <= 0, 1.0).otherwise(F.least(F.greatest(1 - speech / n, F.lit(0.0)), F.lit(1.0)))


def is_clipped(samples: Column, threshold: float = 0.99) -> Column:
    return F.size(F.filter(samples, lambda x: F.abs(x) >= F.lit(threshold))) / F.size(samples) > 0.001


def rms_db(samples: Column) -> Column:
    level = F.sqrt(F.aggregate(samples, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / F.size(samples))
    return F.when(level < 1e-10, -120.0).otherwise(20 * F.log10(level))
