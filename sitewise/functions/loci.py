"""Locus keys `chr_pos`, chromosome numbers and chromosome orders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewise.functions.numeric import col
from sitewise.schemas import CHROMOSOMES, GENE_CHROMOSOME_ORDER


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def locus_chr(key: str | Column) -> Column:
    return F.split(col(key), "_")[0]


def locus_pos(key: str | Column) -> Column:
    """Position part of a key; `9e+06` is a valid spelling of 9000000."""
    return F.split(col(key), "_")[1].cast("double").cast("bigint")


def locus_key(chr_: str | Column, pos: str | Column) -> Column:
    return F.concat_ws("_", col(chr_), col(pos).cast("string"))


def chr_index(chr_: str | Column, strict: bool = False) -> Column:
    """0-based chromosome number; a contig outside the known list gives null, or fails if `strict`."""
    table = _literal_map({name: i for i, name in enumerate(CHROMOSOMES)})
    number = F.try_element_at(table, F.lower(col(chr_)))
    if not strict:
        return number
    unknown = F.raise_error(F.concat(F.lit("unknown chromosome: "), F.coalesce(col(chr_), F.lit("null"))))
    return F.when(number.isNull(), unknown).otherwise(number)


def gene_chr_order(chr_: str | Column) -> Column:
    return F.try_element_at(_literal_map(GENE_CHROMOSOME_ORDER), col(chr_))


def chr_sort_key(chr_: str | Column) -> Column:
    """1..22, then X, then Y, then everything else; sort by the name as well to order the rest."""
    tail = F.substring(col(chr_), F.lit(4), F.length(col(chr_)))
    return (
        F.when(tail.rlike("^[0-9]+$"), tail.try_cast("int"))
        .when(F.lower(tail) == "x", F.lit(1_000_001))
        .when(F.lower(tail) == "y", F.lit(1_000_002))
        .otherwise(F.lit(1_000_003))
    )


def in_chromosomes(chr_: str | Column, wanted: list[str]) -> Column:
    """Predicate for the listed chromosomes; a name outside the known list is an error."""
    names = [w.lower() for w in wanted]
    unknown = sorted(set(names) - set(CHROMOSOMES))
    if unknown:
        raise ValueError(f"unknown chromosomes: {unknown}")
    return F.lower(col(chr_)).isin(names)
