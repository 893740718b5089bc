"""Mixing sources to target weights.

Each row gets a hash-random key, the MD5 of a seed and its id (for a null id, of its text). Keys are uniform,
so their leading hex digits cut each source into ranges of even size without a sample, as many as keep some
RANGE_ROWS rows in each; a source with a third of all rows is spread over them like any other. Sums per
range, a prefix sum over the ranges of a source and a running sum inside a range give each row its place in
its source's random order, and a source is cut where its budget ends. Budgets beyond the source's size repeat
it whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WHITE_SPACE, WORD, free_name, materialised, need, text_or_empty

TOGETHER = 10_000  # of rows that are alike, made by one task in a row
RANGE_ROWS = 50_000  # rows that a range of the largest possible source may have
LEAST_DIGITS = 3  # leading hex digits of the key that name a range, at least


def word_count(text: Column) -> Column:
    return F.size(F.split(F.trim(F.regexp_replace(text, f"[{WHITE_SPACE}]+", " ")), " ")).cast("long") * (
        F.when(F.regexp_like(text, F.lit(WORD)), 1).otherwise(0)
    )


def ranked_sources(sources: DataFrame) -> DataFrame:
    """sources with turn, their place from 0 in code point order, null last, without a task that sees all of them."""
    null_last = F.col("source").isNull()
    dealt = sources.repartitionByRange(null_last, "source").withColumn("part", F.spark_partition_id())
    dealt = materialised(dealt, "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = dealt.groupBy(F.col("part").alias("p_part")).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("p_part", "part")
    sizes = sizes.select(F.col("part").alias("p_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(null_last, "source")) - 1
    return dealt.withColumn("inside", inside).join(sizes, F.col("part") == F.col("p_part")).withColumn("turn", F.col("inside") + F.col("before")).drop("part", "p_part", "inside", "before")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """sources(source, source_size) with weight, target and budget.

    Sources in code point order, null last, take the weights in turn. Targets share the sum of all sizes
    by weight; none exceeds max_epochs times its source's size, and what that leaves is shared again by
    weight among the others, until none is above: one aggregation over the sources each time, in whole
    numbers.
    """
    turn = F.pmod(F.col("turn"), F.lit(len(weights))).cast("int")
    rows = ranked_sources(sources).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long"))
    rows = materialised(rows.withColumn("cap", (F.col("source_size") * max_epochs).cast("decimal(38,0)")).drop("turn"), "source-weights")
    total = rows.agg(F.sum("source_size").cast("decimal(38,0)")).first()[0] or 0
    full, left, shared_by = F.lit(False), total, None
    while True:
        got = rows.agg(F.sum(F.when(full, F.col("cap"))).alias("caps"), F.sum(F.when(~full, F.col("weight"))).alias("weights"), F.count(F.when(full, 1)).alias("n")).first()
        left, now = total - (got["caps"] or 0), got["weights"] or 0
        if now == shared_by or not now:
            break
        shared_by = now
        # those that a share of what is left lifts to their cap; who was full stays so, as shares only grow
        full = F.col("cap") * F.lit(shared_by).cast("decimal(20,0)") <= F.col("weight").cast("decimal(20,0)") * F.lit(str(left)).cast("decimal(38,0)")
    shared = (F.col("weight") * F.lit(int(left))).cast("double") / F.lit(float(shared_by or 1))
    target = F.when(full, F.col("cap").cast("double")).otherwise(shared)
    return rows.select("source", "source_size", "weight", target.alias("target")).withColumn("budget", F.floor("target").cast("long"))


def mix(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 0,
) -> DataFrame:
    """One row for each row of df: id, source, size, source_size, target, budget and taken.

    Size is the number of words. taken is the number of words that the mix takes from the row, repeats
    counted: whole epochs, and in the last one what still fits, so that a source's taken words sum to
    the floor of its target. Null text has size 0 and null source is a source of its own; null ids and
    repeated ids are rows like others, in an order fixed by key, id and size. An empty table gives an empty one.
    """
    need(df, id_column, text_column, source_column)
    rows = df.select(
        F.col(id_column).alias("id"), F.col(source_column).alias("source"), word_count(text_or_empty(text_column)).alias("size"), _key(id_column, text_column, seed).alias("key")
    )
    # rows of equal source, key, id and size are one row with their number, however many they are
    alike = rows.groupBy("source", "key", "id", "size").agg(F.count(F.lit(1)).alias("n"))
    alike = materialised(alike, "mix-sizes")  # slim, and the text is read once
    out = _taken(alike, weights, max_epochs)
    many = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {TOGETHER}"))).alias("block")
    blocks = out.select("id", "source", "size", "source_size", "target", "budget", "n", "epochs", "rest", many)
    if (alike.agg(F.max("n")).first()[0] or 0) > TOGETHER:
        blocks = blocks.repartition("id", "source", "block")
    each = F.explode(F.sequence(F.col("block") * TOGETHER, F.least(F.col("n"), (F.col("block") + 1) * TOGETHER) - 1)).alias("place")
    out = blocks.select("*", each).withColumn("taken", _share(F.col("rest") - F.col("place") * F.col("size")))
    return out.select(F.col("id").alias(id_column), F.col("source").alias(source_column), "size", "source_size", "target", "budget", "taken")


def _share(rest: Column) -> Column:
    """Words taken of a row of size `size` that has `rest` words left in the last epoch."""
    return F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(rest, F.col("size")))


def _key(id_column: str, text_column: str, seed: int) -> Column:
    text = F.concat(F.lit("null:"), F.md5(text_or_empty(text_column)))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(id_column).cast("string"), text)))


def _taken(rows: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Materialised rows(id, source, size, n, key, ...) with source_size, target, budget, epochs and rest, what is left for the first of n rows."""
    digits = max(LEAST_DIGITS, math.ceil(math.log(max(1, rows.count() / RANGE_ROWS), 16)))  # changes the layout only
    rows = rows.withColumn("range", F.substring("key", 1, digits))
    sums = rows.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("range_size"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, max_epochs)
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sums.withColumn("ahead", F.coalesce(F.sum("range_size").over(ahead), F.lit(0)))
    t = targets.withColumnRenamed("source", "t_source")
    ranges = ranges.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source", "weight", "range_size")
    ranges = ranges.withColumnsRenamed({"source": "r_source", "range": "r_range"})

    inside = Window.partitionBy("source", "range").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    rows = rows.join(ranges, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("range") == F.col("r_range")))
    epochs = F.when(F.col("source_size") > 0, F.expr("budget div source_size")).otherwise(0)
    rest = F.col("budget") - epochs * F.col("source_size") - F.col("ahead") - F.col("inside")
    return rows.withColumns({"epochs": epochs, "rest": rest}).drop("key", "range", "inside", "ahead", "r_source", "r_range")


ALIKE = ("source", "key", "id", "size")


def _numbered(slim: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Materialised slim(row, source, key, id, size) with epochs, rest and place, the row's number among those that are alike.

    The numbers come from those inside each task that made the rows (the upper bits of row) and prefix sums over the tasks.
    """
    alike = materialised(slim.groupBy(*ALIKE).agg(F.count(F.lit(1)).alias("n")), "mix-sizes")
    out = _taken(alike.withColumn("a_key", F.col("key")), weights, max_epochs)
    out = out.select("n", "epochs", "rest", *(F.col("a_key" if c == "key" else c).alias(f"a_{c}_") for c in ALIKE))
    same = lambda mark: [F.col(c).eqNullSafe(F.col(f"{mark}_{c}_")) for c in ALIKE]
    rows = slim.join(out, same("a")).select("row", *ALIKE, "n", "epochs", "rest")
    many = rows.filter("n > 1").withColumn("task", F.shiftright("row", 33))
    counts = many.groupBy(*ALIKE, "task").count()
    before = Window.partitionBy(*ALIKE).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"), F.col("task").alias("c_task"), *(F.col(c).alias(f"c_{c}_") for c in ALIKE))
    inside = F.row_number().over(Window.partitionBy(*ALIKE, "task").orderBy("row")) - 1
    many = many.withColumn("inside", inside).join(counts, [*same("c"), F.col("task") == F.col("c_task")])
    names = ["row", "size", "epochs", "rest"]
    return rows.filter("n = 1").select(*names, F.lit(0).cast("long").alias("place")).union(many.select(*names, (F.col("inside") + F.col("before")).alias("place")))


def mixed_rows(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source",
    weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 0,
) -> DataFrame:
    """df as the mix takes it: a row for each whole taking, and the cut row with the words that still fit.

    Each row is given a number of its own and written once, so rows with null or repeated ids take their own
    shares. A row that gives nothing goes, as one without words does. Repeats are equal rows. Columns are
    those of df.
    """
    need(df, id_column, text_column, source_column)
    r, z, k, words = (free_name(df, x) for x in ("mix_row_", "mix_size_", "mix_taken_", "mix_words_"))
    own = df.withColumns({r: F.monotonically_increasing_id(), z: word_count(text_or_empty(text_column)), k: _key(id_column, text_column, seed)})
    own = materialised(own, "mix-rows")
    slim = own.select(F.col(r).alias("row"), F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.col(z).alias("size"), F.col(k).alias("key"))
    takes = _numbered(slim, weights, max_epochs).withColumn("taken", _share(F.col("rest") - F.col("place") * F.col("size"))).filter("taken > 0").select(F.col("row").alias(r), F.col("taken").alias(words))
    rows = own.drop(k).join(takes, r)
    whole, part = F.expr(f"`{words}` div `{z}`"), F.col(words) % F.col(z)
    shares = F.concat(F.array_repeat(F.col(z), whole.cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn(k, F.explode(shares))
    pieces = F.regexp_extract_all(F.col(text_column), F.lit(f"[{WHITE_SPACE}]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col(k).cast("int")), "")
    text = F.when(F.col(k) < F.col(z), cut).otherwise(F.col(text_column))
    return rows.withColumn(text_column, text).select(df.columns)
