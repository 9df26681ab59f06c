"""Supercluster profiles: the best tunnel per snapshot, and the figures made of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns after throughput that settle which of several equal tunnels is the best.
TIES = ("cluster_id", "tunnel_id", "length", "bottleneck_radius", "curvature")


def best_per_snapshot(tunnels: DataFrame, keys: Sequence[str] = ("sc_id", "md_label", "snapshot_id"), ties: Sequence[str] = TIES) -> DataFrame:
    """The tunnel with the highest throughput of each supercluster, simulation and snapshot.

    Ties go to the lowest of ``ties`` in turn; null throughput comes last. Spark keeps the first row of
    each group of a task before the shuffle (WindowGroupLimit), so a hot group sends one row a task. The
    hash of the keys leads the sort, whose comparisons then seldom reach the keys themselves.
    """
    w = Window.partitionBy("_h", *keys).orderBy(F.desc_nulls_last("throughput"), *ties)
    hashed = tunnels.withColumn("_h", F.xxhash64(*keys))
    return hashed.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_h", "_r")


def _figures() -> list[Column]:
    out = [F.count_distinct("md_label").alias("num_md_sims"), F.count(F.lit(1)).alias("num_snaps")]
    for column, name in (("bottleneck_radius", "radii"), ("length", "length"), ("curvature", "curvature"), ("throughput", "throughput")):
        out += [F.avg(column).alias(f"{name}_avg"), F.stddev_pop(column).alias(f"{name}_std")]
    return [*out, F.max("bottleneck_radius").alias("radii_max")]


def properties(best: DataFrame, scope: str, snapshots: int, total_sims: int, group_sizes: DataFrame | None = None) -> DataFrame:
    """Figures of each supercluster, overall, per simulation (``md``) or per comparison ``group``.

    The standard deviation is that of the population. Priority is the mean throughput times the share
    of snapshots the supercluster has, and overall and in groups times its share of simulations too.
    ``group_sizes``: ``grp, group_size``.
    """
    n, sims = F.col("num_snaps"), F.col("num_md_sims")
    occupied = F.col("throughput_avg") * (n / F.lit(snapshots))
    if scope == "overall":
        got = best.groupBy("sc_id").agg(*_figures()).withColumn("label", F.lit("overall"))
        avg, priority = n / F.lit(total_sims), occupied * (sims / F.lit(total_sims))
    elif scope == "md":
        got = best.groupBy("sc_id", F.col("md_label").alias("label")).agg(*_figures())
        avg, priority = n * F.lit(1.0), occupied
    elif scope == "group":
        got = best.groupBy("sc_id", F.col("grp").alias("label")).agg(*_figures()).join(group_sizes.withColumnRenamed("grp", "label"), "label")
        avg, priority = n / F.col("group_size"), occupied * (sims / F.col("group_size"))
    else:
        raise ValueError("scope must be overall, md or group")
    return got.withColumn("avg_snaps", avg).withColumn("priority", priority)


def all_scopes(best: DataFrame, snapshots: int, total_sims: int, group_sizes: DataFrame) -> DataFrame:
    """The three scopes one below the other; simulations that belong to a group have no row of their own."""
    parts = [properties(best, s, snapshots, total_sims, group_sizes) for s in ("overall", "group")]
    alone = best.join(group_sizes.select("grp"), "grp", "left_anti")
    parts.append(properties(alone, "md", snapshots, total_sims))
    out = None
    for scope, part in zip(("overall", "group", "md"), parts):
        part = part.select(F.lit(scope).alias("scope"), *[c for c in parts[0].columns])
        out = part if out is None else out.unionByName(part)
    return out


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` numbered from 1 in a total order. For summaries of one row per supercluster only."""
    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def priority_order(props: DataFrame) -> DataFrame:
    """Superclusters numbered by priority, then id, both falling."""
    return ranked(props, [F.desc("priority"), F.desc("sc_id")], "prioritized_id")


def cluster_characteristics(tunnels: DataFrame) -> DataFrame:
    """Mean throughput and number of tunnels of each cluster, filtered or not."""
    return tunnels.groupBy("md_label", "cluster_id").agg(F.avg("throughput").alias("throughput_avg"), F.count(F.lit(1)).alias("n_tunnels"))


def supercluster_importance(characteristics: DataFrame, membership: DataFrame, snapshots: int, total_sims: int) -> DataFrame:
    """First ids of superclusters: occupancy times mean throughput times share of simulations, falling."""
    got = characteristics.join(membership, "cluster_id").groupBy("sc_id").agg(
        F.sum("n_tunnels").alias("n"), F.avg("throughput_avg").alias("t"), F.count_distinct("md_label").alias("m")
    )
    return got.select("sc_id", ((F.col("n") / F.lit(snapshots)) * F.col("t") * (F.col("m") / F.lit(total_sims))).alias("importance"))


def cluster_order(characteristics: DataFrame) -> DataFrame:
    """Clusters in order of importance: id, then falling throughput, then falling number, then simulation."""
    order = [F.asc("cluster_id"), 1 / F.col("throughput_avg"), 1 / F.col("n_tunnels"), F.asc("md_label")]
    return ranked(characteristics, order, "ord")


def residue_frequency(residues: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How often each residue lines the bottleneck, as a share of the group's bottlenecks.

    ``residues``: keys and ``residue`` per lining residue; ``rows``: keys per bottleneck.
    """
    hits = residues.groupBy(*keys, "residue").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    return hits.join(totals, list(keys)).select(*keys, "residue", (F.col("n") / F.col("total")).alias("freq"))


def time_evolution(best: DataFrame, simulations: DataFrame, prop: str, snapshots: int, offset: int, default: float) -> DataFrame:
    """``prop`` for every supercluster, simulation and frame 0 .. snapshots-1, ``default`` where there is no tunnel."""
    frames = simulations.select("sc_id", "md_label", F.explode(F.sequence(F.lit(0), F.lit(snapshots - 1))).alias("frame"))
    known = best.select("sc_id", "md_label", (F.col("snapshot_id") - offset).alias("frame"), F.col(prop).alias("value"))
    return frames.join(known, ["sc_id", "md_label", "frame"], "left").withColumn("value", F.coalesce("value", F.lit(default)))


def frame_rank(tunnels: DataFrame, frames: int) -> DataFrame:
    """Clusters by total throughput over the frames, numbered from 1 within each simulation."""
    got = tunnels.groupBy("md_label", "cluster_id").agg((F.sum("throughput") / F.lit(frames)).alias("priority"))
    # clusters of a simulation, not tunnels: a few thousand rows
    return got.withColumn("new_id", F.row_number().over(Window.partitionBy("md_label").orderBy(F.desc("priority"), "cluster_id")))


def property_vector(best: DataFrame, prop: str, keys: Sequence[str] = ("sc_id",)) -> DataFrame:
    """``keys, values``: a property of all tunnels of a group in order of simulation and snapshot; of as many numbers as snapshots."""
    item = F.struct("md_label", "snapshot_id", F.col(prop).alias("v"))
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s.v).alias("values"))


def residue_scopes(residues: DataFrame, rows: DataFrame, cluster: str, md: str, group: str) -> DataFrame:
    """``scope, label, cluster, residue, freq``: residue frequencies overall, of groups, and of simulations in no group."""
    out = None
    for scope, label, keep in (
        ("overall", F.lit("overall"), F.lit(True)), ("group", F.col(group), F.col(group).isNotNull()), ("md", F.col(md), F.col(group).isNull()),
    ):
        own, totals = (df.where(keep).select(F.lit(scope).alias("scope"), label.alias("label"), cluster, *[c for c in ("residue",) if c in df.columns]) for df in (residues, rows))
        part = residue_frequency(own, totals, ["scope", "label", cluster])
        out = part if out is None else out.unionByName(part)
    return out
