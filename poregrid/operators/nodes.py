"""Layered path graphs in relational form: node figures, candidates, nearest nodes, containment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poregrid.functions.geometry import distance, node_label
from poregrid.operators import skew
from poregrid.session import materialize

XYZ = ("x", "y", "z")


def node_statistics(points: DataFrame, keys: Sequence[str], quantile: float = 0.9) -> DataFrame:
    """Mean place, spread (root mean square distance from it), radius quantile, end points and start flag of each node.

    ``points``: keys, x, y, z, radius, is_end, is_start. The spread is the root of the three coordinates'
    variances, so one grouping gives all but the quantile. That is exact with linear interpolation: the
    radii of a node are counted by value and put in order in ranges, never all in one task
    (``skew.weighted_percentiles``). Rows with a null key form a node of their own.
    """
    figures = points.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in XYZ], F.sqrt(sum(F.var_pop(c) for c in XYZ)).alias("rmsf"),
        F.count_if("is_end").alias("num_end_points"), F.bool_or("is_start").alias("has_start"), F.count(F.lit(1)).alias("n_points"),
    )
    counted = materialize(skew.compress(points, F.struct(*keys), F.col("radius").cast("double")), "radii")
    radii = skew.weighted_percentiles(counted, [quantile]).toDF("key", "_q").select(*[F.col("key")[k].alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_q").alias("radius"))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = figures.join(radii, same, "left").drop(*[f"_k{i}" for i in range(len(keys))])
    return joined.select(*keys, *XYZ, "rmsf", "radius", "num_end_points", "has_start", "n_points")


def merge_nodes(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Duplicate nodes made one: mean place and layer, greatest radius and spread, an end if any is."""
    return nodes.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in XYZ], F.avg("layer").alias("layer"), F.max("radius").alias("radius"), F.max("rmsf").alias("rmsf"),
        F.bool_or("is_end").alias("is_end"),
    )


def representative(min_dist: Column, max_dist: Column, rmsf: Column, radius: Column, is_end: Column, thickness: float, tolerance: float = 0.0) -> Column:
    """Whether a node stands well for its points: some near its mean, none far out."""
    t = F.lit(float(thickness))
    cutoff = F.when(is_end, F.greatest(2 * rmsf, radius, t)).otherwise(F.greatest(3 * rmsf, 2 * radius, 2 * t))
    return (min_dist <= 1 + tolerance) & (max_dist <= cutoff + tolerance)


def ordered_labels(nodes: DataFrame, keys: Sequence[str], taken: Column | int = 0) -> DataFrame:
    """Nodes of a layer numbered by (z, y, x), after the ids ``taken`` already, with their label."""
    w = Window.partitionBy(*keys, "layer").orderBy("z", "y", "x")
    numbered = nodes.withColumn("node_no", F.row_number().over(w) + taken)
    return numbered.withColumn("node", node_label(F.col("layer"), F.col("node_no")))


def size_order(members: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Cluster labels renumbered from 1 by falling size, then falling label; noise (-1) stays."""
    sizes = members.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys, F.col(label) == -1).orderBy(F.desc("n"), F.desc(label))
    return sizes.withColumn("new_label", F.when(F.col(label) == -1, -1).otherwise(F.row_number().over(w)))


def layer_limits(nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First layer with an end node, and last layer, of each path set (start nodes, layer below 0, left out)."""
    real = nodes.where(F.col("layer") >= 0)
    return real.groupBy(*keys).agg(F.min(F.when(F.col("is_end"), F.col("layer"))).alias("first_end"), F.max("layer").alias("last_layer"))


def in_band(query_layer: Column, target_layer: Column, first_end: Column, query_last: Column, target_last: Column) -> Column:
    """Whether a node of the target is a candidate for a node of the query set.

    Candidates are in the same or a neighbouring layer, from the query's first end layer on, beyond
    the query's last layer if the node is in it, in the target's last two layers if the query goes
    beyond the target, and start nodes.
    """
    return (
        (F.abs(query_layer - target_layer) <= 1)
        | F.coalesce(target_layer >= first_end, F.lit(False))
        | ((query_layer == query_last) & (target_layer > query_layer))
        | ((query_layer > target_last) & (target_layer >= target_last - 1))
        | (target_layer < 0)
    )


def band_candidates(query: DataFrame, target: DataFrame, pair: Sequence[str], key: str = "node") -> DataFrame:
    """Node pairs of two path sets that are compared, by the band rule; joined on the ``pair`` columns.

    Path sets have tens of nodes, so a pair's join is small whatever the number of pairs.
    """
    q_lim = layer_limits(query, pair).withColumnRenamed("last_layer", "q_last")
    t_lim = layer_limits(target, pair).select(*pair, F.col("last_layer").alias("t_last"))
    q = query.join(q_lim, list(pair)).select(*pair, "first_end", "q_last", *[F.col(c).alias(f"q_{c}") for c in query.columns if c not in pair])
    t = target.join(t_lim, list(pair)).select(*pair, "t_last", *[F.col(c).alias(f"t_{c}") for c in target.columns if c not in pair])
    return q.join(t, list(pair)).where(in_band(F.col("q_layer"), F.col("t_layer"), F.col("first_end"), F.col("q_last"), F.col("t_last")))


def nearest(pairs: DataFrame, left: Sequence[str], dist: Column, right: str) -> DataFrame:
    """For each left node the nearest right one, at a distance of at least 0; ties by the right label."""
    best = F.min(F.struct(F.greatest(dist, F.lit(0.0)).alias("d"), F.col(right).alias("r")))
    return pairs.groupBy(*left).agg(best.alias("b")).select(*left, F.col("b.r").alias("nearest"), F.col("b.d").alias("dist"))


def node_depths(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Depth of each node: the greatest 1 / (place on a path), from 1 at the start."""
    long = paths.select(*keys, F.posexplode("nodes").alias("pos", "node"))
    return long.groupBy(*keys, "node").agg(F.max(1 / (F.col("pos") + 1)).alias("depth"))


def containment(closest: DataFrame, depths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of nodes inside the other set (distance 0), and greatest depth of all their nearest nodes."""
    joined = closest.join(depths.withColumnRenamed("node", "nearest"), "nearest", "left")
    return joined.groupBy(*keys).agg(F.avg((F.col("dist") == 0).cast("double")).alias("buriedness"), F.max("depth").alias("depth"))


def best_path(paths: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The path that starts in the lowest layer, the shortest of these, then the lowest id."""
    best = F.min(F.struct("first_layer", F.size("nodes").alias("n"), "path_id", "nodes"))
    return paths.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.path_id", "b.nodes")


def pool_nodes(points: DataFrame, merged: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Figures of nodes put together from the points of several: ``merged`` maps keys and ``node`` to ``pooled``.

    Points of nodes that are not mapped keep their node.
    """
    named = points.join(merged.select(*keys, "node", "pooled"), [*keys, "node"], "left")
    return node_statistics(named.withColumn("node", F.coalesce("pooled", "node")).drop("pooled"), [*keys, "node"])


def distances_to_mean(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, min_dist, max_dist, rmsf``: how near and far a node's points are from its mean."""
    mean = points.groupBy(*keys).agg(*[F.avg(c).alias(f"_m{c}") for c in XYZ])
    away = distance([F.col(c) for c in XYZ], [F.col(f"_m{c}") for c in XYZ])
    placed = points.join(mean, list(keys)).select(*keys, away.alias("d"))
    return placed.groupBy(*keys).agg(F.min("d").alias("min_dist"), F.max("d").alias("max_dist"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmsf"))


def union_sets(*sets: DataFrame) -> DataFrame:
    """Path sets below each other; sets of tunnels and of events, told apart by ``kind``, may not mix."""
    whole = sets[0]
    for more in sets[1:]:
        whole = whole.unionByName(more)
    kinds = whole.select("kind").distinct().limit(2).count()
    if kinds > 1:
        raise ValueError("path sets of tunnels and of events can't be put together")
    return whole


def distinct_spheres(spheres: DataFrame, columns: Sequence[str] = (*XYZ, "radius")) -> DataFrame:
    """Each sphere once, by place and radius; nulls are equal."""
    return spheres.dropDuplicates(list(columns))


def end_ids(points: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``points`` with ``tunnel_no``: how many end points come before a point in its entity."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return points.withColumn("tunnel_no", F.coalesce(F.sum(F.col("is_end").cast("int")).over(w), F.lit(0)))


def missing_ids(wanted: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that a stage should have and has not; empty if it is complete."""
    return wanted.select(*keys).distinct().join(done.select(*keys).distinct(), list(keys), "left_anti")
