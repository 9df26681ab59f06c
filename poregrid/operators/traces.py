"""Ordered operators over ligand traces: runs of a type, prefixes, repeated points, frame windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poregrid.functions.geometry import frame_window


def runs(points: DataFrame, key: Sequence[str], order: Sequence[str], kind: str) -> DataFrame:
    """``points`` with ``run_no``: runs of one ``kind`` along the order, from 1 in each path."""
    w = Window.partitionBy(*key).orderBy(*order)
    changed = F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("int"), F.lit(1))
    return points.withColumn("_c", changed).withColumn("run_no", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def first_run(points: DataFrame, key: Sequence[str], order: Sequence[str], kind: str) -> DataFrame:
    """Only the chronologically first run of each kind of a path."""
    numbered = runs(points, key, order, kind)
    first = F.min("run_no").over(Window.partitionBy(*key, kind))
    return numbered.withColumn("_f", first).where(F.col("run_no") == F.col("_f")).drop("_f")


def take_while_closer(points: DataFrame, key: Sequence[str], order: Sequence[str], dist: str) -> DataFrame:
    """The leading points of each path as long as ``dist`` does not rise above the one kept before."""
    w = Window.partitionBy(*key).orderBy(*order)
    before = F.min(dist).over(w.rowsBetween(Window.unboundedPreceding, -1))
    broken = F.coalesce((F.col(dist) > before).cast("int"), F.lit(0))
    marked = points.withColumn("_b", broken)
    return marked.withColumn("_s", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_s = 0").drop("_b", "_s")


def drop_repeats(points: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Points that differ from the one before on their path; a null equals a null."""
    w = Window.partitionBy(*key).orderBy(*order)
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
    return points.withColumn("_s", same & (F.row_number().over(w) > 1)).where("not _s").drop("_s")


def point_order(points: DataFrame, key: Sequence[str], order: Sequence[str], backwards: Column) -> DataFrame:
    """``ord`` from 0 (falling where ``backwards``: entries) and ``is_end`` at the outer end.

    A path of one point has no end point.
    """
    w = Window.partitionBy(*key)
    pos = F.row_number().over(w.orderBy(*order)) - 1
    numbered = points.withColumn("_p", pos).withColumn("_n", F.count(F.lit(1)).over(w))
    ord_ = F.when(backwards, F.col("_n") - 1 - F.col("_p")).otherwise(F.col("_p"))
    return numbered.withColumn("ord", ord_).withColumn("is_end", (F.col("ord") == F.col("_n") - 1) & (F.col("_n") > 1)).drop("_p", "_n")


def least_distances(points: DataFrame, key: Sequence[str], kind: str, dist: str) -> DataFrame:
    """Least distance from the starting point of each kind of segment."""
    return points.groupBy(*key, kind).agg(F.min(dist).alias("min_dist"))


def event_windows(paths: DataFrame) -> DataFrame:
    """``path_row, md_traj, traced, event_type, frame_b, frame_e`` of the entry and the release of each path.

    A path without the frames of an event has no row for it.
    """
    resid = F.split("path_id", ":")[1]
    traced = F.concat_ws(":", F.coalesce("res_name", F.lit("?")), resid)
    both = []
    for kind in ("entry", "release"):
        begin, end = frame_window(kind, F.col("begin_f"), F.col("inp_f"), F.col("out_f"), F.col("end_f"))
        both.append(F.struct(F.lit(kind).alias("event_type"), begin.alias("frame_b"), end.alias("frame_e")))
    long = paths.select("path_row", "md_traj", traced.alias("traced"), F.explode(F.array(*both)).alias("e")).select("path_row", "md_traj", "traced", "e.*")
    return long.where(F.col("frame_b").isNotNull() & F.col("frame_e").isNotNull())


def numbered_paths(paths: DataFrame, key: str, order: str) -> DataFrame:
    """The number of each path by its place in the summary of its simulation."""
    return paths.withColumn("path_no", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def nearest_in_frame(candidates: DataFrame, frame: Sequence[str], dist: str, cluster: str, atom: str) -> DataFrame:
    """The sphere nearest to the ligand in each frame; of equal ones the last cluster and atom."""
    rest = [c for c in candidates.columns if c not in {*frame, dist, cluster, atom}]
    w = Window.partitionBy("_h", *frame).orderBy(dist, F.desc(cluster), F.desc(atom), *rest)
    ranked = candidates.withColumn("_h", F.xxhash64(*frame)).withColumn("_r", F.row_number().over(w))
    return ranked.where("_r = 1").drop("_h", "_r").select(*frame, dist, cluster, atom, *rest)


def match_fractions(nearest: DataFrame, frames: DataFrame, key: Sequence[str], dist: str, radius: float) -> DataFrame:
    """Share of event frames, and of frames with a tunnel, in which the ligand is inside (``dist`` at most ``radius``)."""
    total = frames.groupBy(*key).agg(F.count(F.lit(1)).alias("n_frames"))
    hits = nearest.groupBy(*key).agg(F.count_if(F.col(dist) <= radius).alias("hits"), F.count(F.lit(1)).alias("n_tunnel_frames"))
    return total.join(hits, list(key), "left").select(
        *key, F.coalesce(F.col("hits") / F.col("n_frames"), F.lit(0.0)).alias("of_frames"), (F.col("hits") / F.col("n_tunnel_frames")).alias("of_tunnel_frames")
    )
