"""Joins, merges and paging as DataFrame functions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..session import written


def in_scope(edges: DataFrame, keys: DataFrame, key: str, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges with both ends among the keys."""
    k = keys.select(key).distinct()
    return edges.join(k.withColumnRenamed(key, src), src, "left_semi").join(k.withColumnRenamed(key, dst), dst, "left_semi")


def membership(rows: DataFrame, id_column: str, known: DataFrame, key: str, name: str = "in_corpus") -> DataFrame:
    """True, False, or null for a row without an id."""
    k = known.select(F.col(key).alias("_k")).distinct().withColumn("_m", F.lit(True))
    joined = rows.join(k, F.col(id_column) == F.col("_k"), "left")
    return joined.withColumn(name, F.when(F.col(id_column).isNotNull(), F.coalesce("_m", F.lit(False)))).drop("_k", "_m")


def lookup_by_either(rows: DataFrame, pairs: list[tuple[str, str]], known: DataFrame, value: str, name: str) -> DataFrame:
    """The known value under the first of several keys that finds one: an equi join a key, where an OR would be a loop over all pairs."""
    found = rows
    for i, (mine, theirs) in enumerate(pairs):
        k = known.filter(F.col(theirs).isNotNull()).groupBy(F.col(theirs).alias(f"_k{i}")).agg(F.min(value).alias(f"_v{i}"))
        found = found.join(k, F.col(mine) == F.col(f"_k{i}"), "left")
    n = range(len(pairs))
    return found.withColumn(name, F.coalesce(*(F.col(f"_v{i}") for i in n))).drop(*(f"_{c}{i}" for c in "kv" for i in n))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer merge; a new value replaces an old one unless it is null."""
    columns = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, key, "full").select(key, *(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in columns))


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new lacks."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def cascade_delete(parents: DataFrame, child: DataFrame, parent_key: str, child_key: str, gone: Column) -> DataFrame:
    """Child rows whose parent isn't deleted."""
    dead = parents.filter(gone).select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(dead, child_key, "left_anti")


def keyset_page(df: DataFrame, sort: str, key: str, limit: int, after: tuple | None = None) -> DataFrame:
    """A page in descending order of sort, then ascending key, nulls last, behind the row `after` = (sort, key). Limits are 1 to 200."""
    s, k = F.col(sort), F.col(key)
    if after is not None:
        value, last = after
        if value is None:
            df = df.filter(s.isNull() & (k > last))
        else:
            df = df.filter((s < value) | ((s == value) & (k > last)) | s.isNull())
    return df.orderBy(s.desc_nulls_last(), k.asc()).limit(max(1, min(200, limit)))


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order that names a unique column."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def replay_versions(events: DataFrame, key: str, expected: str, order: str) -> DataFrame:
    """Optimistic locking: an event is accepted if it expects the number of events accepted before it.

    That is one pass over a key's events in order, streamed in sorted partitions: a task holds a batch and
    one counter, however many events a key has. Rows with a null key are one key.
    """
    names = events.columns
    at, wants = names.index(key), names.index(expected)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = (), 0
        for batch in batches:
            out = []
            for k, e in zip(batch.column(at).to_pylist(), batch.column(wants).to_pylist()):
                if now != (k,):
                    now, done = (k,), 0
                out.append(e == done)
                done += out[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], names=[*names, "accepted"])

    ordered = events.repartition(key).sortWithinPartitions(key, order)
    return ordered.mapInArrow(fold, StructType([*events.schema.fields, StructField("accepted", BooleanType())]))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of one column that only one side has, with the side, `left` or `right`."""
    name = a.columns[0]
    b = b.toDF(name)
    only = lambda x, y, side: x.distinct().join(y, x[name].eqNullSafe(y[name]), "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "left").union(only(b, a, "right"))


def last_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """A map from key to the value of its last row, as a combining aggregation."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


class CachedView:
    """A table that is built again when it is older than ttl seconds or its watermark has grown; in between reads are of the written one."""

    def __init__(self, build: Callable[[], DataFrame], watermark: Callable[[], int], ttl: float, clock: Callable[[], float] = time.monotonic):
        self.build, self.watermark, self.ttl, self.clock = build, watermark, ttl, clock
        self.view: DataFrame | None = None
        self.mark, self.at, self.builds = 0, 0.0, 0

    def get(self) -> DataFrame:
        if self.view is None or self.clock() - self.at > self.ttl or self.watermark() > self.mark:
            self.mark, self.at = self.watermark(), self.clock()
            self.view, self.builds = written(self.build(), "view"), self.builds + 1
        return self.view
