"""Ligand events and superclusters: candidates by direction, resolution, counts, comparison groups."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poregrid.functions.geometry import aligned

#: Cells along an edge of the cube whose six faces divide the directions.
FACE_CELLS = 4
#: What the ends of an ambiguous assignment are settled by.
RESOLUTIONS = ("penetration_depth", "exact_matching", "assign2all")


def _face_cell(v: Sequence[Column]) -> Column:
    """The number of the cube cell a direction points through; null for no direction."""
    size = [F.abs(c) for c in v]
    axis = F.when((size[0] >= size[1]) & (size[0] >= size[2]), 0).when(size[1] >= size[2], 1).otherwise(2)
    pick = lambda cols: F.when(axis == 0, cols[0]).when(axis == 1, cols[1]).otherwise(cols[2])
    main, one, two = pick(v), pick([v[1], v[2], v[0]]), pick([v[2], v[0], v[1]])
    place = lambda c: F.least(F.lit(FACE_CELLS - 1), F.floor((c / F.abs(main) + 1) / 2 * FACE_CELLS))
    face = axis * 2 + (main > 0).cast("int")
    return F.when(F.abs(main) > 0, (face * FACE_CELLS + place(one)) * FACE_CELLS + place(two)).cast("int")


def _cell_pairs(cutoff: float) -> list[tuple[int, int]]:
    """Pairs of cube cells that hold directions within ``cutoff`` of each other (or a little more); a fixed number at most."""
    corners, n = [], FACE_CELLS
    for axis in range(3):
        for sign in (-1.0, 1.0):
            for i in range(n):
                for j in range(n):
                    points = np.empty((5, 3))
                    for k, (a, b) in enumerate(((i, j), (i + 1, j), (i, j + 1), (i + 1, j + 1), (i + 0.5, j + 0.5))):
                        points[k, axis], points[k, (axis + 1) % 3], points[k, (axis + 2) % 3] = sign, 2 * a / n - 1, 2 * b / n - 1
                    corners.append(points / np.linalg.norm(points, axis=1, keepdims=True))
    middle = np.array([c[4] for c in corners])
    reach = np.array([np.arccos(np.clip(c[:4] @ c[4], -1, 1)).max() for c in corners])
    apart = np.arccos(np.clip(middle @ middle.T, -1, 1))
    return [(int(a), int(b)) for a, b in np.argwhere(apart <= cutoff + reach[:, None] + reach[None, :] + 1e-9)]


def by_direction(events: DataFrame, superclusters: DataFrame, cutoff: float) -> DataFrame:
    """Events with ``sc_id`` of each supercluster whose direction is within ``cutoff``.

    ``superclusters``: ``sc_id, x, y, z``. Both sides are put in the cells of a cube around the origin;
    superclusters are repeated for the cells within reach (a table of fixed size), and the sides meet by
    cell. An event or supercluster without a direction (null, or at the origin) meets none.
    """
    spark = events.sparkSession
    pairs = spark.createDataFrame(_cell_pairs(cutoff), "own int, cell int")
    sc = superclusters.select("sc_id", *[F.col(c).alias(f"_s{c}") for c in "xyz"]).withColumn("own", _face_cell([F.col(f"_s{c}") for c in "xyz"]))
    spread = sc.join(F.broadcast(pairs), "own").withColumnRenamed("cell", "_cell").drop("own")
    placed = events.withColumn("_cell", _face_cell([F.col(c) for c in "xyz"]))
    near = placed.join(spread, "_cell").where(aligned([F.col(c) for c in "xyz"], [F.col(f"_s{c}") for c in "xyz"], cutoff))
    return near.select(*events.columns, "sc_id")


def assign_events(
    contained: DataFrame, key: Sequence[str], cutoff: float = 0.85, tolerance: float = 0.05, by: str = "penetration_depth", matches: DataFrame | None = None
) -> DataFrame:
    """The superclusters each event is assigned to, one row each, or one row with a null ``sc_id`` for an outlier.

    ``contained``: key, sc_id, buriedness, depth for each candidate. If the best buriedness reaches
    ``cutoff``, the candidates within ``tolerance`` of it stay. Of several, those of the greatest depth are
    taken (``by`` penetration_depth), those with the greatest share of matched frames (exact_matching,
    ``matches``: key, sc_id, of_frames; none matched makes an outlier), or all (assign2all). A null
    buriedness is no candidate, a null depth the least one.
    """
    if by not in RESOLUTIONS:
        raise ValueError(f"by must be one of {', '.join(RESOLUTIONS)}")
    if by == "exact_matching" and matches is None:
        raise ValueError("exact_matching needs matches")
    own = Window.partitionBy(*key)
    rows = contained.withColumn("best", F.max("buriedness").over(own))
    rows = rows.withColumn("near", F.coalesce((F.col("best") >= cutoff) & (F.col("buriedness") >= F.col("best") - tolerance), F.lit(False)))
    depth = F.coalesce(F.col("depth"), F.lit(-1.0))
    if by == "penetration_depth":
        rows = rows.withColumn("near", F.col("near") & (depth == F.max(F.when(F.col("near"), depth)).over(own)))
    elif by == "exact_matching":
        rows = rows.join(matches.select(*key, "sc_id", "of_frames"), [*key, "sc_id"], "left")
        several = F.count_if("near").over(own) > 1
        fits = F.col("of_frames") == F.max(F.when(F.col("near"), F.col("of_frames"))).over(own)
        rows = rows.withColumn("near", F.col("near") & (~several | F.coalesce(fits, F.lit(False))))
    kept = rows.where("near").select(*key, "sc_id", "buriedness", "depth")
    outliers = rows.groupBy(*key).agg(F.bool_or("near").alias("any")).where("not any").select(*key, *[F.lit(None).cast(contained.schema[c].dataType).alias(c) for c in ("sc_id", "buriedness", "depth")])
    return kept.unionByName(outliers)


def event_counts(assigned: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Events, entries, releases and simulations with events of each key."""
    kind = F.col("event_type")
    return assigned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("num_events"), F.count_if(kind == "entry").alias("num_entries"), F.count_if(kind == "release").alias("num_releases"),
        F.count_distinct("md_label").alias("num_md_sims"),
    )


def with_groups(rows: DataFrame, groups: DataFrame, key: str = "md_label") -> DataFrame:
    """``rows`` with ``grp``, null for simulations in no group; a simulation in two groups is an error.

    The groups have one row per simulation and stay a small table at any size of the rows; Spark
    broadcasts it if it is under its threshold.
    """
    unique = groups.groupBy(key).agg(F.count_distinct("grp").alias("n"), F.min("grp").alias("grp"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.lit("a simulation is in two groups")).cast("string")).otherwise(F.col("grp"))
    return rows.join(unique.select(key, checked.alias("grp")), key, "left")


def scope_labels(simulations: DataFrame, groups: DataFrame, key: str = "md_label") -> DataFrame:
    """Labels of reports: overall, each group, and each simulation that is in no group."""
    alone = simulations.select(F.col(key).alias("label")).distinct().join(groups.select(F.col(key).alias("label")), "label", "left_anti")
    overall = simulations.sparkSession.createDataFrame([("overall",)], "label string")
    return overall.unionByName(groups.select(F.col("grp").alias("label")).distinct()).unionByName(alone)


def orphans(bottlenecks: DataFrame, tunnels: DataFrame, key: Sequence[str]) -> DataFrame:
    """Bottlenecks without a tunnel; a strict scan requires this to be empty."""
    return bottlenecks.join(tunnels.select(*key).distinct(), list(key), "left_anti")


def strict_join(bottlenecks: DataFrame, tunnels: DataFrame, key: Sequence[str]) -> DataFrame:
    """Bottlenecks joined to their tunnels; one without a tunnel is an error."""
    own = tunnels.withColumn("_t", F.lit(True))
    joined = bottlenecks.join(own, list(key), "left")
    text = F.concat(F.lit("bottleneck without a tunnel: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in key]))
    checked = F.when(F.col("_t"), True).otherwise(F.raise_error(text).cast("boolean"))
    return joined.where(checked).drop("_t")


def mean_start(points: DataFrame, key: str, axes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Mean starting point of each simulation, and the unweighted mean of these."""
    per = points.groupBy(key).agg(*[F.avg(a).alias(a) for a in axes])
    return per, per.agg(*[F.avg(a).alias(a) for a in axes])


def seeded_sample(rows: DataFrame, keys: Sequence[str], unique: Sequence[str], most: int, seed: int) -> DataFrame:
    """At most ``most`` rows of each key, chosen by a hash of the unique columns and the seed.

    The choice is the same on every run and cluster; the limit is pushed below the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in unique], F.lit(str(seed)))), *unique)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")
