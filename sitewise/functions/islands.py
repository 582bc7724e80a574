"""Island labels `type_idx,type_idx` and their token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewise.functions.numeric import col
from sitewise.schemas import ISLAND_COUNT, ISLAND_SEPARATOR, ISLAND_TYPES


def island_label(location: str | Column, index: str | Column) -> Column:
    """One label; a site without an island carries index -1."""
    return F.concat_ws("_", col(location), F.coalesce(col(index).cast("int"), F.lit(-1)).cast("string"))


def encode_island(label_list: str | Column) -> Column:
    """`sep, index, type, sep, …`; an unknown type or an index out of range fails the job."""
    types = F.create_map(
        *[F.lit(x) for i, t in enumerate(ISLAND_TYPES) for x in (t, ISLAND_SEPARATOR + 1 + i)]
    )

    def one(label: Column) -> Column:
        kind, idx = F.split(label, "_")[0], F.split(label, "_")[1].cast("int")
        valid = (idx == -1) | idx.between(1, ISLAND_COUNT)
        idx_token = (
            F.when(valid & (idx == -1), F.lit(0))
            .when(valid, idx)
            .otherwise(F.raise_error(F.concat(F.lit("island index out of range: "), label)).cast("int"))
        )
        kind_token = F.coalesce(
            F.try_element_at(types, kind),
            F.raise_error(F.concat(F.lit("unknown island type: "), label)).cast("int"),
        )
        return F.array(idx_token, kind_token, F.lit(ISLAND_SEPARATOR))

    body = F.flatten(F.transform(F.split(col(label_list), ","), one))
    return F.concat(F.array(F.lit(ISLAND_SEPARATOR)), body)
