"""Predicates over tunnels, superclusters and events."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poregrid.session import all_of

UNSET = -1.0


@dataclass(frozen=True)
class Filters:
    """Limits of a filtered profile; -1 means no limit."""

    min_length: float = UNSET
    max_length: float = UNSET
    min_radius: float = UNSET
    max_radius: float = UNSET
    min_curvature: float = UNSET
    max_curvature: float = UNSET
    min_sims: int = 1
    min_snapshots: int = 1
    min_avg_snapshots: float = UNSET
    min_events: int = UNSET
    min_entries: int = UNSET
    min_releases: int = UNSET

    def active(self) -> dict[str, float]:
        return {f.name: getattr(self, f.name) for f in fields(self) if getattr(self, f.name) != f.default}


def define_filters(**limits: float) -> Filters:
    """Checked filters: limits are numbers, -1 or not negative, and a maximum is not below its minimum."""
    known = {f.name for f in fields(Filters)}
    for name, value in limits.items():
        if name not in known:
            raise ValueError(f"unknown filter {name}; known are {', '.join(sorted(known))}")
        if isinstance(value, bool) or not isinstance(value, (int, float)) or (value < 0 and value != UNSET):
            raise ValueError(f"{name} must be -1 (off) or a number of at least 0, not {value!r}")
    limits = {k: v for k, v in limits.items() if not (k in ("min_sims", "min_snapshots") and v == UNSET)}
    made = Filters(**limits)
    for what in ("length", "radius", "curvature"):
        low, high = getattr(made, f"min_{what}"), getattr(made, f"max_{what}")
        if high != UNSET and high < low:
            raise ValueError(f"max_{what} {high} is below min_{what} {low}")
    return made


def passes_prefilter(min_radius: float = 0.75, min_length: float = 5.0, max_curvature: float = 2.0) -> Column:
    """Flag of tunnels that take part in layering; the others stay in the profiles."""
    return (
        (F.round("bottleneck_radius", 6) >= min_radius) & (F.round("length", 6) >= min_length) & (F.round("curvature", 6) <= max_curvature)
    )


def tunnel_passes(f: Filters) -> Column:
    """Tunnels within the limits of length, radius and curvature (compared to 6 places, the least curvature to 4)."""
    tests = []
    for what, column in (("length", "length"), ("radius", "bottleneck_radius"), ("curvature", "curvature")):
        low, high = getattr(f, f"min_{what}"), getattr(f, f"max_{what}")
        if low >= 0:
            tests.append(F.round(column, 4 if what == "curvature" else 6) >= low)
        if high >= 0:
            tests.append(F.round(column, 6) <= high)
    return all_of(*tests)


def supercluster_passes(f: Filters, total_sims: int) -> Column:
    """HAVING over ``num_md_sims`` and ``num_snaps`` of a filtered supercluster."""
    tests = [F.col("num_md_sims") >= f.min_sims, F.col("num_snaps") >= f.min_snapshots]
    if f.min_avg_snapshots >= 0:
        tests.append(F.col("num_snaps") / F.lit(total_sims) >= f.min_avg_snapshots)
    return all_of(*tests)


def events_pass(f: Filters) -> Column:
    """HAVING over ``num_events, num_entries, num_releases``."""
    pairs = (("num_events", f.min_events), ("num_entries", f.min_entries), ("num_releases", f.min_releases))
    return all_of(*[F.col(c) >= v for c, v in pairs if v >= 0])


def filter_profile(best: DataFrame, f: Filters, total_sims: int) -> DataFrame:
    """Best tunnels that pass, of superclusters that still have enough simulations and snapshots."""
    kept = best.where(tunnel_passes(f))
    enough = kept.groupBy("sc_id").agg(F.count_distinct("md_label").alias("num_md_sims"), F.count(F.lit(1)).alias("num_snaps"))
    return kept.join(enough.where(supercluster_passes(f, total_sims)).select("sc_id"), "sc_id", "left_semi")


def valid_clusters(members: DataFrame, best: DataFrame) -> DataFrame:
    """``members`` with ``valid``: whether the cluster still owns a tunnel in ``best``."""
    own = best.select("sc_id", "md_label", "cluster_id").distinct().withColumn("valid", F.lit(True))
    return members.join(own, ["sc_id", "md_label", "cluster_id"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def occurring(tunnels: DataFrame, least: int) -> DataFrame:
    """Clusters of a simulation with at least ``least`` tunnels, and their number."""
    return tunnels.groupBy("md_label", "cluster_id").agg(F.count(F.lit(1)).alias("n_tunnels")).where(F.col("n_tunnels") >= least)


def repeated_tunnels(tunnels: DataFrame) -> DataFrame:
    """Keys (simulation, cluster, snapshot) held by more than one tunnel; empty in a sound profile."""
    return tunnels.groupBy("md_label", "cluster_id", "snapshot_id").agg(F.count(F.lit(1)).alias("n_tunnels")).where("n_tunnels > 1")


def prune_events(segments: DataFrame, cutoff: float) -> DataFrame:
    """Paths' entry and release segments that come near: dropped if both the inside and their own least distance reach ``cutoff``.

    ``segments``: ``path, event_type, dist`` per point. A path without inside points keeps its events,
    and a path left without any event gives no row.
    """
    least = segments.groupBy("path").pivot("event_type", ["inside", "entry", "release"]).agg(F.min("dist"))
    inside = F.coalesce(F.col("inside"), F.lit(-1.0))
    pairs = F.array(*[F.struct(F.lit(t).alias("event_type"), F.col(t).alias("min_dist")) for t in ("entry", "release")])
    long = least.select("path", inside.alias("inside_min"), F.explode(pairs).alias("e")).select("path", "inside_min", "e.*")
    return long.where(F.col("min_dist").isNotNull() & ~((F.col("inside_min") >= cutoff) & (F.col("min_dist") >= cutoff)))


def sub_cluster(tunnels: DataFrame, f: Filters, snapshots: Sequence[int] | None = None) -> DataFrame:
    """Tunnels that pass the filters, of all or of some snapshots."""
    kept = tunnels.where(tunnel_passes(f))
    return kept if snapshots is None else kept.where(F.col("snapshot_id").isin(list(snapshots)))


def several_points(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The points of events that have more than one."""
    return points.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n > 1").drop("_n")


def approx_equal(one: DataFrame, two: DataFrame, keys: Sequence[str], atol: float = 1e-3) -> DataFrame:
    """``keys, reason`` of the rows in which two tables differ: absent from one, or a number off by more than ``atol``, or another text.

    Nulls and NaN are equal to themselves. Repeated keys are compared by their number.
    """
    values = [c for c in one.columns if c not in keys]
    kinds = dict(one.dtypes)
    a = one.groupBy(*keys).agg(F.count(F.lit(1)).alias("_na"), *[F.min(c).alias(f"_a{i}") for i, c in enumerate(values)])
    b = two.groupBy(*keys).agg(F.count(F.lit(1)).alias("_nb"), *[F.min(c).alias(f"_b{i}") for i, c in enumerate(values)])
    b = b.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in b.columns if c not in keys])
    joined = a.join(b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], "full_outer")
    reason = F.when(F.col("_na").isNull(), "only in the second").when(F.col("_nb").isNull(), "only in the first").when(F.col("_na") != F.col("_nb"), "another number of rows")
    for i, c in enumerate(values):
        x, y = F.col(f"_a{i}"), F.col(f"_b{i}")
        same = x.eqNullSafe(y)
        if kinds[c] in ("double", "float", "int", "bigint"):
            same = same | F.coalesce(F.abs(x - y) <= atol, F.lit(False))
        reason = reason.when(~same, c)
    found = joined.select(*[F.coalesce(k, f"_k{i}").alias(k) for i, k in enumerate(keys)], reason.alias("reason"))
    return found.where("reason is not null")
