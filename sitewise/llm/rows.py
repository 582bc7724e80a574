"""Arrow-batched Python over the texts of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Texts handed to one call of a measuring function, so that a batch of long texts stays small.
TEXTS_PER_CALL = 256


def append_struct(
    df: DataFrame, name: str, schema: StructType, make: Callable[[], Callable[[list], list[dict]]], text: str = "text"
) -> DataFrame:
    """`df` with a struct column computed from the texts; every other column passes through.

    `text` names the column of the texts, or a field of a struct column as `column.field`. `make` runs once per task and returns a function from texts (str or None) to one dict per text.
    """
    out_schema = StructType([*[f for f in df.schema.fields if f.name != name], StructField(name, schema)])
    kept = [f.name for f in out_schema.fields[:-1]]
    arrow = to_arrow_schema(StructType([StructField(name, schema)])).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = make()
        for whole in batches:
            for start in range(0, whole.num_rows, TEXTS_PER_CALL):
                batch = whole.slice(start, TEXTS_PER_CALL)
                column, _, field = text.partition(".")
                texts = batch.column(column).field(field) if field else batch.column(column)
                made = pa.array(measure(texts.to_pylist()), type=arrow)
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], made], [*kept, name])

    return df.mapInArrow(run, out_schema)
