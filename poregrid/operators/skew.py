"""Per-key figures where a few keys hold most rows: value-frequency compression.

Rows are first grouped by (key, value) and only then by key. The first grouping spreads a hot key
over as many tasks as it has values and combines repeated values before the shuffle; counts,
distinct counts and modes then follow from mergeable aggregates over the weighted values.
Percentiles need the weighted values of a key in order: a key with more distinct values than
``window_limit`` is cut into ranges of about that many values (splitters from a mergeable
approximate percentile), so that no task ever orders a whole hot key, and the exact result is put
together from the ranges' weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction as Internal

from poregrid.session import materialize

#: Most distinct values of one key that a single task puts in order.
WINDOW_LIMIT = 200_000
#: Most splitters of one key.
MAX_SPLITTERS = 8_192


def compress(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """``(key, value, freq)``: the rows counted by key and value, nulls of either kept as groups."""
    return df.select(key.alias("key"), value.alias("value")).groupBy("key", "value").agg(F.count(F.lit(1)).alias("freq"))


def key_figures(compressed: DataFrame) -> DataFrame:
    """One row per key: ``n_rows, n_values`` (rows with a value), ``n_distinct, mode``.

    The mode is the most frequent value, the smallest of several; null values count only in
    ``n_rows``, and a key that has none but nulls gets 0, 0 and a null mode.
    """
    has = F.col("value").isNotNull()
    return compressed.groupBy("key").agg(
        F.sum("freq").alias("n_rows"),
        F.coalesce(F.sum(F.when(has, F.col("freq"))), F.lit(0)).alias("n_values"),
        F.count("value").alias("n_distinct"),
        F.max(F.when(has, F.struct("freq", (-F.col("value")).alias("neg")))).alias("top"),
    ).select("key", "n_rows", "n_values", "n_distinct", (-F.col("top.neg")).alias("mode"))


def _ranged(values: DataFrame, window_limit: int) -> DataFrame:
    """``values`` with a ``part``: rising with value, 0 for keys of at most ``window_limit`` values."""
    sizes = values.groupBy("key").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > window_limit)
    hot = materialize(sizes.select(F.col("key").alias("hot_key"), "d"), "hot-keys")
    largest = hot.agg(F.max("d")).first()[0]
    if largest is None:
        return values.withColumn("part", F.lit(0))
    pieces = min(MAX_SPLITTERS, -(-2 * largest // window_limit))
    cuts = [k / pieces for k in range(1, pieces)]
    same = F.col("key").eqNullSafe(F.col("hot_key"))
    # Splitters of the hot keys only, of each as many as its values need.
    all_cuts = values.join(hot, same).groupBy("hot_key", "d").agg(F.percentile_approx("value", cuts, max(10_000, 20 * pieces)).alias("cuts"))
    step = F.greatest(F.lit(1), F.floor(F.lit(pieces) / F.ceil(2 * F.col("d") / window_limit))).cast("int")
    own = F.array_sort(F.array_distinct(F.filter("cuts", lambda _, i: (i + 1) % F.col("step") == 0)))
    splitters = materialize(all_cuts.withColumn("step", step).select("hot_key", own.alias("cuts")), "splitters")
    # Written tables have a known size: Spark sends the splitters to all tasks if they are under its
    # threshold, and else joins by key, where it splits large partitions (skew join).
    found = Internal.array_binary_search(F.col("cuts"), F.col("value"))
    place = F.coalesce(F.when(found < 0, -found - 1).otherwise(found), F.lit(0))
    return values.join(splitters, same, "left").select("key", "value", "freq", place.cast("int").alias("part"))


def weighted_percentiles(compressed: DataFrame, percentiles: Sequence[float], window_limit: int = WINDOW_LIMIT) -> DataFrame:
    """``key, p<percent>`` for each percentile: exact, interpolated between the two ranks around (n-1)p.

    ``compressed`` is scanned several times; materialize it first. Null values are left out; a key
    without values gives no row.
    """
    values = compressed.where(F.col("value").isNotNull())
    parts = _ranged(values, window_limit)
    weights = parts.groupBy("key", "part").agg(F.sum("freq").alias("w"))
    by_key = Window.partitionBy("key").orderBy("part")
    offsets = weights.select(
        "key", "part",
        F.coalesce(F.sum("w").over(by_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("w").over(Window.partitionBy("key")).alias("n"),
        F.col("w"),
    )
    ranks = [("lo", F.floor), ("hi", F.ceil)]
    wanted = F.array(*[fn((F.col("n") - 1) * F.lit(float(p))).cast("long") for p in percentiles for _, fn in ranks])
    inside = F.exists(wanted, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("w")))
    # Only ranges that hold a wanted rank are put in order.
    needed = offsets.where(inside).select(F.col("key").alias("own_key"), F.col("part").alias("own_part"), "before", "n")
    own = F.col("key").eqNullSafe(F.col("own_key")) & (F.col("part") == F.col("own_part"))
    order = Window.partitionBy("key", "part").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = parts.join(needed, own).select(
        "key", "n", "value", (F.col("before") + F.sum("freq").over(order)).alias("upto"), "freq"
    )
    start = F.col("upto") - F.col("freq")
    picks = []
    for k, p in enumerate(percentiles):
        for name, fn in ranks:
            rank = fn((F.col("n") - 1) * F.lit(float(p))).cast("long")
            picks.append(F.max(F.when((rank >= start) & (rank < F.col("upto")), F.col("value"))).alias(f"{name}{k}"))
    got = ranked.groupBy("key").agg(F.max("n").alias("n"), *picks)
    out = [F.col("key")]
    for k, p in enumerate(percentiles):
        at = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"lo{k}"), F.col(f"hi{k}")
        out.append((lo + (hi - lo) * (at - F.floor(at))).alias(f"p{100 * p:g}".replace(".", "_")))
    return got.select(*out)


def key_statistics(
    df: DataFrame, key: Column, value: Column, percentiles: Sequence[float] = (0.5, 0.9), window_limit: int = WINDOW_LIMIT
) -> DataFrame:
    """Exact figures of a numeric ``value`` for every ``key``, whatever share of the rows a key has.

    Columns: ``key, n_rows, n_values, n_distinct, mode`` and one per percentile. NaN counts as null.
    Rows with a null key form the group of the null key. An empty input gives no row.
    """
    value = value.cast("double")
    value = F.when(F.isnan(value), None).otherwise(value + F.lit(0.0))  # -0.0 becomes 0.0
    compressed = materialize(compress(df, key, value), "weighted")
    figures = key_figures(compressed)
    if not percentiles:
        return figures
    ranks = weighted_percentiles(compressed, percentiles, window_limit)
    return figures.join(ranks.withColumnRenamed("key", "rank_key"), F.col("key").eqNullSafe(F.col("rank_key")), "left").drop("rank_key")


def heavy_keys(df: DataFrame, key: Column, value: Column, share: float) -> DataFrame:
    """``key, n_rows`` of the keys that stand in at least ``share`` of all rows (the null key included)."""
    counts = materialize(key_figures(compress(df, key, value)).select("key", "n_rows"), "key-counts")
    total = counts.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).scalar()
    return counts.where(F.col("n_rows") >= F.lit(share) * total)
