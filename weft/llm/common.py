"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.sources.storage import discard, settle, shared_dir, table

__all__ = ["discard", "map_pandas", "pick", "settle", "shared_dir", "table"]


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The first column of exactly each name; extra columns, also clashing ones, go."""
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{df.columns.index(n)}").alias(n) for n in names])


def map_pandas(df: DataFrame, f: Callable, schema: str, *kept: str) -> DataFrame:
    """df.mapInPandas(f, schema), with the integer columns `kept` as text on the way: pandas would make them floats beside nulls and round large ids."""
    out = T.StructType.fromDDL(schema)
    given = T.StructType([T.StructField(x.name, T.StringType() if x.name in kept else x.dataType) for x in out])
    texts = df.withColumns({c: F.col(c).cast("string") for c in kept})
    return texts.mapInPandas(f, given).select(*[F.col(x.name).cast(x.dataType) if x.name in kept else F.col(x.name) for x in out])
