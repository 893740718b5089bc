"""Helpers of the llm operators: shared storage, plain text rules and materialised tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete, shared_folder, ship

#: White space of every word rule here: blank and the control characters 9 to 13 (fixed by the contracts).
WHITE_SPACE = r"\x20\x09-\x0D"
WORD = f"[^{WHITE_SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, name)


def materialised(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """df written as Parquet to the shared folder and read again: its lineage ends there.

    A lost executor costs a reread of files instead of the work that made them, and values that
    depend on evaluation order (row ids, samples) stay as they were first computed.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.written_to_ = path
    return made


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialised table that nothing reads any more."""
    path = getattr(df, "written_to_", None)
    if path:
        delete(df.sparkSession, path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have yet, so that extra columns never clash with ours."""
    have = {c.lower() for c in df.columns}
    while wish.lower() in have:
        wish += "_"
    return wish


def _give_back() -> None:
    """Freed memory to the system: a Python worker lives on for the next stages, which need their own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other libraries do without
    if trim:
        trim(0)


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """df.mapInArrow with the package at hand."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        _give_back()

    return df.mapInArrow(run, schema)
