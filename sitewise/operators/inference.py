"""Hooks for user code that works on batches of rows: tokenizers and models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def tokenize(df: DataFrame, column: str, make_tokenizer: Callable[[], Callable[[list[str]], list[list[int]]]], name: str):
    """Add token ids; the tokenizer is built once per task and called once per Arrow batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_tokenizer()
        for pdf in batches:
            yield pdf.assign(**{name: encode(pdf[column].tolist())})

    return df.mapInPandas(run, schema)


def predict(df: DataFrame, make_model: Callable[[], Callable[[pd.DataFrame], pd.Series]], name: str = "pred_methyl"):
    """Add a prediction; the model is built once per task and called once per Arrow batch."""
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for pdf in batches:
            yield pdf.assign(**{name: model(pdf)})

    return df.mapInPandas(run, schema)
