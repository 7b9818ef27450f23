"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.session import ship_package


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark wherever that folder is."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, text_col: str = "text") -> Column:
    """The text column with null as the empty text."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def give_back() -> None:
    """Return a worker's unused memory to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of an array of spans, comma-joined in array order."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def count_kind(spans: Column, kind: str) -> Column:
    """How many spans of an array are of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
