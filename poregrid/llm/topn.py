"""The N best items of every group, by a mergeable bounded heap.

``collect_top_k`` keeps a heap of at most N items per group while a task reads its rows, so only N
items per group and task are shuffled, and merges the heaps afterwards. Items are compared by score
and then by the tie columns, which should end in something unique.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.internal import InternalFunction as Internal


def top_items(
    df: DataFrame, group: Sequence[str], n: int, best: Sequence[tuple[str, bool]], keep: Sequence[str] = (), rank: str = "rank_no"
) -> DataFrame:
    """``group columns, rank, best columns, keep columns``: the first ``n`` items of each group.

    ``best`` orders the items: ``(column, True)`` puts greater values first, ``(column, False)``
    lesser ones; columns that go upwards must be numeric. A null in a ``best`` column comes last,
    NaN before every number where greater comes first. Items equal in all ``best`` columns are told
    apart by the ``keep`` columns, greater first. A null group key is a group. Groups of fewer than
    ``n`` items give them all; an empty input gives no row.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    names = [c for c, _ in best] + [c for c in keep if c not in {b for b, _ in best}]
    signed: list[Column] = []
    for c, greater in best:
        # nulls sort lowest in a struct comparison, so for either direction a null comes last
        signed.append((F.col(c) if greater else -F.col(c)).alias(f"o{len(signed)}"))
    item = F.struct(*signed, *[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])
    heaps = df.groupBy(*group).agg(Internal.collect_top_k(item, n, False).alias("heap"))
    return heaps.select(*group, F.posexplode("heap").alias("at", "item")).select(
        *group, (F.col("at") + 1).alias(rank), *[F.col(f"item.v{i}").alias(c) for i, c in enumerate(names)]
    )


def last_of(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of the rows equal in ``keys`` (null equals null) the one with the greatest ``order`` columns."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.max(row).alias("last_row")).select(*keys, *[F.col(f"last_row.{c}").alias(c) for c in rest])
