"""Filling containers of fixed capacity: best fit over a histogram of lengths.

Items are first cut into pieces of at most the capacity (only longer items are cut). The pieces are
counted by length, at most ``capacity`` rows, and best-fit-decreasing is planned on these counts
alone: all pieces of a length go, in one step per group of like containers, to the containers with
the least room that still holds them. The plan says which ranks within a length go to which
containers. Each piece then gets its rank within its length, numbered in parts so that a length held
by most pieces is no single task's work, and looks its place up in the plan.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poregrid.session import materialize

#: Pieces of one length that one task numbers.
PART_SIZE = 50_000
#: Largest capacity: the plan and the histogram have rows in proportion to it.
MAX_CAPACITY = 1 << 17


def plan_fill(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit-decreasing over ``counts`` (length to number of pieces).

    Returns segments ``(length, rank from, rank to, first container, pieces per container, offset)``
    and the number of containers: ranks of a segment fill its containers one after the other, each
    with that many pieces from the offset on.
    """
    segments: list[tuple[int, int, int, int, int, int]] = []
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first container, number)
    sizes: list[int] = []  # rooms that have groups, sorted
    opened = 0

    def put(room: int, first: int, number: int) -> None:
        if room > 0 and number > 0:
            if room not in rooms:
                rooms[room] = []
                insort(sizes, room)
            rooms[room].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        if not 0 < length <= capacity:
            raise ValueError("lengths must be from 1 to the capacity")
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                room = sizes[at]
                first, number = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    sizes.pop(at)
            else:
                room, first = capacity, opened
                number = -(-left // (capacity // length))
                opened += number
            per = room // length
            full = min(number, left // per)
            if full:
                segments.append((length, rank, rank + full * per, first, per, capacity - room))
                put(room - per * length, first, full)
                rank, left = rank + full * per, left - full * per
            if left and full < number:
                segments.append((length, rank, rank + left, first + full, left, capacity - room))
                put(room - left * length, first + full, 1)
                left, full = 0, full + 1
            put(room, first + full, number - full)
    return segments, opened


def _ranked(pieces: DataFrame, parts: DataFrame) -> DataFrame:
    """``pieces`` with ``rnk``, from 0 within each length."""
    placed = pieces.join(F.broadcast(parts), "len").withColumn("part", F.pmod(F.xxhash64("item", "piece_no"), "parts")).drop("parts")
    sizes = placed.groupBy("len", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("len").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("len", "part").orderBy("item", "piece_no"))
    return (
        placed.withColumn("own", own)
        .join(sizes.select("len", "part", before.alias("before")), ["len", "part"])
        .withColumn("rnk", F.col("own") - 1 + F.col("before"))
        .drop("own", "before", "part")
    )


def pack(df: DataFrame, id_col: str, size_col: str, capacity: int) -> DataFrame:
    """``id_col, piece_no, n_pieces, start_in_item, piece_size, container_id, start_in_container``.

    One row per piece. An item of at most ``capacity`` is one piece; a longer one is cut into full
    pieces and a rest. An item of size 0 or null needs no room: one row with size 0 and a null
    container. Negative sizes are an error. Rows repeated in ``df`` are items of their own. Which of
    several pieces of one length goes where is fixed by a hash of the id, and the id itself. Plan and
    histogram have at most a few times ``capacity`` rows, whatever the number of items.
    """
    if not 0 < capacity <= MAX_CAPACITY:
        raise ValueError(f"capacity must be from 1 to {MAX_CAPACITY}")
    size = F.coalesce(F.col(size_col).cast("long"), F.lit(0))
    checked = F.when(size >= 0, size).otherwise(F.raise_error(F.lit("negative item size")).cast("long"))
    items = df.select(F.col(id_col).alias("item"), checked.alias("size"))
    n_pieces = F.greatest(F.lit(1), F.ceil(F.col("size") / capacity)).cast("int")
    cut = items.withColumn("n_pieces", n_pieces).select("*", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)).alias("piece_no"))
    start = F.col("piece_no").cast("long") * capacity
    pieces = cut.select("item", "piece_no", "n_pieces", start.alias("start"), F.least(F.lit(capacity), F.col("size") - start).cast("int").alias("len"))
    pieces = materialize(pieces, "pieces")
    spark = df.sparkSession

    counts = {r.len: r.n for r in pieces.where("len > 0").groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}
    segments, _ = plan_fill(counts, capacity)
    parts = spark.createDataFrame([(k, max(1, -(-n // PART_SIZE))) for k, n in counts.items()], "len int, parts int")
    table = np.array(sorted(segments), dtype=np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(table)
    id_type = df.schema[id_col].dataType.simpleString()
    names = [id_col, "piece_no", "n_pieces", "start_in_item", "piece_size", "container_id", "start_in_container"]
    schema = f"`{id_col}` {id_type}, piece_no int, n_pieces int, start_in_item bigint, piece_size int, container_id bigint, start_in_container int"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, rank = (np.asarray(batch.column(k), dtype=np.int64) for k in (4, 5))
            _, begin, _, first, per, offset = plan[np.searchsorted(keys, (length << 44) + rank, side="right") - 1].T
            nth = rank - begin
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(5)), pa.array(first + nth // per), pa.array((offset + nth % per * length).astype(np.int32))], names
            )

    full = _ranked(pieces.where("len > 0"), parts).select("item", "piece_no", "n_pieces", "start", "len", F.col("rnk").cast("long").alias("rnk"))
    empty = pieces.where("len = 0").select(
        F.col("item").alias(id_col), "piece_no", "n_pieces", F.col("start").alias("start_in_item"), F.col("len").alias("piece_size"),
        F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("int").alias("start_in_container"),
    )
    return full.mapInArrow(place, schema).unionByName(empty)


def audit(placed: DataFrame, capacity: int) -> DataFrame:
    """One row of figures of a packing: ``n_items, n_tokens, n_containers, overlaps, overfull, needless_splits, torn``.

    ``overlaps``: pieces that begin before the one below them in their container ends; ``overfull``: pieces
    that end beyond the capacity; ``needless_splits``: pieces of items that fit whole; ``torn``: items whose
    pieces do not follow on each other from 0. A sound packing has 0 of all four. ``placed`` has the columns
    of ``pack`` with the item first.
    """
    item = placed.columns[0]
    size = F.col("piece_size").cast("long")
    # Pieces of a container do not overlap if their ends and starts, sorted, are the same but for the gaps: the sum test below is exact
    # for pieces laid end to end from 0, as ``pack`` lays them.
    per_container = placed.where("container_id is not null").groupBy("container_id").agg(
        F.sum(size).alias("used"), F.max(F.col("start_in_container") + size).alias("top"), F.min("start_in_container").alias("low"),
        F.count_distinct("start_in_container").alias("starts"), F.count(F.lit(1)).alias("n"),
    )
    containers = per_container.agg(
        F.count(F.lit(1)).alias("n_containers"), F.count_if((F.col("used") != F.col("top")) | (F.col("low") != 0) | (F.col("starts") != F.col("n"))).alias("overlaps"),
        F.count_if(F.col("top") > capacity).alias("overfull"),
    )
    per_item = placed.groupBy(item).agg(
        F.sum(size).alias("size"), F.count(F.lit(1)).alias("n"), F.max("n_pieces").alias("n_pieces"), F.max(F.col("start_in_item") + size).alias("top"), F.count_distinct("start_in_item").alias("starts")
    )
    items = per_item.agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("size").alias("n_tokens"), F.count_if((F.col("n") > 1) & (F.col("size") <= capacity)).alias("needless_splits"),
        F.count_if((F.col("n") != F.col("n_pieces")) | (F.col("size") != F.col("top")) | (F.col("starts") != F.col("n"))).alias("torn"),
    )
    return items.crossJoin(containers).select("n_items", "n_tokens", "n_containers", "overlaps", "overfull", "needless_splits", "torn")  # one row each
