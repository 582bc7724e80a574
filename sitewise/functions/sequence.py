"""Base sequences as strings and as integer arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewise.functions.numeric import col
from sitewise.schemas import BASE_CODES


def center_crop(seq: str | Column, n: int, strict: bool = True) -> Column:
    """The middle ``2 * (n // 2)`` bases.

    A shorter sequence fails the job in strict mode and is returned as it is otherwise.
    """
    seq = col(seq)
    half = n // 2
    mid = F.floor(F.length(seq) / 2).cast("int")
    cut = F.substring(seq, F.greatest(mid - half, F.lit(0)) + F.lit(1), F.lit(2 * half))
    if not strict:
        return cut
    problem = F.raise_error(
        F.concat(F.lit(f"sequence shorter than {n} bases: "), F.length(seq).cast("string"))
    ).cast("string")
    return F.when(F.length(seq) >= n, cut).when(seq.isNotNull(), problem)


def count_letter(seq: str | Column, letter: str) -> Column:
    """Occurrences of one letter in any case."""
    up = F.upper(col(seq))
    return F.length(up) - F.length(F.replace(up, F.lit(letter.upper()), F.lit("")))


def has_unknown_base(seq: str | Column) -> Column:
    return F.contains(F.upper(col(seq)), F.lit("N"))


def encode_bases(seq: str | Column) -> Column:
    """Bases to integer codes, any case; an unknown letter gives a null entry."""
    codes = F.create_map(*[F.lit(x) for kv in BASE_CODES.items() for x in kv])
    letters = F.filter(F.split(F.upper(col(seq)), ""), lambda b: b != "")
    return F.transform(letters, lambda b: F.try_element_at(codes, b))


def kmers(seq: str | Column, k: int) -> Column:
    """All overlapping words of length k, in order."""
    up = F.upper(col(seq))
    starts = F.sequence(F.lit(1), F.length(up) - F.lit(k - 1))
    return F.when(
        F.length(up) >= k, F.transform(starts, lambda i: F.substring(up, i, F.lit(k)))
    ).otherwise(F.array().cast("array<string>"))


def kmer_ids(seq: str | Column, k: int) -> Column:
    """Overlapping words as numbers in base 5, the built-in token ids; words of up to 13 bases fit an int."""
    if k > 13:
        raise ValueError("words of more than 13 bases need larger ids")
    codes = F.create_map(*[F.lit(x) for kv in BASE_CODES.items() for x in kv])
    return F.transform(
        kmers(seq, k),
        lambda w: F.aggregate(
            F.filter(F.split(w, ""), lambda b: b != ""),
            F.lit(0),
            lambda acc, b: acc * F.lit(len(BASE_CODES)) + F.try_element_at(codes, b),
        ),
    )
