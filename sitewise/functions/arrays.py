"""Vectors: padding, masks and parallel arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewise.functions.numeric import col


def pad_to(arr: str | Column, size: str | Column, filler: Column) -> Column:
    """Append fillers up to the size; a longer array fails the job."""
    arr, size = col(arr), col(size)
    grown = F.concat(arr, F.array_repeat(filler, (size - F.size(arr)).cast("int")))
    return F.when(F.size(arr) <= size, grown).otherwise(
        F.raise_error(F.lit("array longer than the padded size"))
    )


def pad_mask(arr: str | Column, size: str | Column) -> Column:
    """True for real entries, false for padding."""
    n = F.size(col(arr))
    return F.transform(F.sequence(F.lit(1), col(size).cast("int")), lambda i: i <= n)


def position_ids(arr: str | Column) -> Column:
    n = F.size(col(arr))
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def ones_like(arr: str | Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(col(arr)))


def keep_nonzero(by: str, *others: str) -> Column:
    """Struct array of the parallel arrays without the entries where `by` is zero."""
    return F.filter(F.arrays_zip(by, *others), lambda s: s[by] != 0)
