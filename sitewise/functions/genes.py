"""Gene keys and gene positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewise.functions.numeric import col
from sitewise.schemas import UNWANTED_GENE_PREFIXES


def gene_id(key: str | Column) -> Column:
    """`NAME;ENSG….7` or `ENSG….7` to `ENSG…`."""
    return F.substring_index(F.element_at(F.split(col(key), ";"), -1), ".", 1)


def gene_name_id(key: str | Column) -> Column:
    """`NAME;ENSG….7` to `NAME;ENSG…`, versions cut from both parts."""
    parts = F.split(col(key), ";")
    return F.concat(
        F.substring_index(parts[0], ".", 1), F.lit(";"), F.substring_index(F.get(parts, F.lit(1)), ".", 1)
    )


def wanted_gene(name: str | Column, prefixes: list[str] = UNWANTED_GENE_PREFIXES) -> Column:
    """False for names that start with one of the prefixes."""
    name = col(name)
    return reduce(lambda a, b: a & b, [~F.startswith(name, F.lit(p)) for p in prefixes])


def strand_pos(strand: str | Column, start: str | Column, end: str | Column) -> Column:
    return F.when(col(strand) == "+", col(start)).otherwise(col(end))


def is_gene(feature: str | Column, gene_type: str | Column, coding_only: bool = True) -> Column:
    keep = col(feature) == "gene"
    return keep & (col(gene_type) == "protein_coding") if coding_only else keep
