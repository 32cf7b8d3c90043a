"""Column helpers for arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda x, y: x + y.cast("long"))


def running(counts: Column) -> Column:
    """Sums of what stands before each entry of an array of numbers, by two levels of blocks: each entry adds up its
    block only, so that long arrays stay affordable."""
    step = 64
    n = F.size(counts)
    blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / step).cast("int")), lambda k: F.slice(counts, k * step + 1, step))
    sums = F.transform(blocks, total)
    bases = F.transform(sums, lambda _, k: total(F.slice(sums, 1, k)))
    inner = F.zip_with(blocks, bases, lambda b, base: F.transform(b, lambda _, i: base + total(F.slice(b, 1, i))))
    return F.flatten(inner)
