"""Parts of sample names and clean labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewise.functions.numeric import col
from sitewise.schemas import LABEL_REPLACEMENTS


def tissue_from_name(name: str | Column, before: str = "Homo sapiens ", after: str = " tissue") -> Column:
    """Text after the last `before` and up to the first `after`."""
    return F.substring_index(F.substring_index(col(name), before, -1), after, 1)


def clean_label(label: str | Column, missing: str = "Unknown") -> Column:
    out = F.coalesce(col(label), F.lit(missing))
    for old, new in LABEL_REPLACEMENTS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def name_part(name: str | Column, sep: str, part: int) -> Column:
    """0-based part of a sample name; null when the name is too short."""
    return F.get(F.split(col(name), sep), F.lit(part))


def base_name(path: str | Column) -> Column:
    return F.substring_index(col(path), "/", -1)


def thousands(n: str | Column) -> Column:
    return F.format_number(col(n), 0)
