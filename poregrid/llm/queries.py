"""The queries of the problems that belong to this subpackage, over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poregrid.functions.domain import is_number, snapshot_number
from poregrid.llm.flow import PointClusters
from poregrid.llm.packing import audit, pack
from poregrid.llm.reading import reading_levels
from poregrid.llm.sketches import DEFAULT_K, merge, percentiles, rank_check, rank_error, sketch, tall
from poregrid.llm.tokens import count_tokens, decode_column, encode_column
from poregrid.llm.topn import last_of, top_items
from poregrid.session import table

CAPACITY = 4096
SIMILAR_DISTANCE = 1.5
MISSING_COORDINATE = 999.0


def p2_found(spark: SparkSession, d: str, n: int = 3) -> DataFrame:
    """The best tunnels by throughput of each tunnel cluster of each simulation."""
    rows = table(spark, d, "bottlenecks").where(
        F.col("md_traj").isNotNull() & (F.col("tunnel_cluster") > 0) & is_number(F.col("throughput")) & F.col("throughput").between(0, 1)
    )
    rows = rows.select(
        "md_traj", "tunnel_cluster", snapshot_number(F.col("snapshot")).alias("snapshot_no"), "tunnel", "loaded_at", "row_id", "throughput"
    )
    tunnels = last_of(rows, ["md_traj", "tunnel_cluster", "snapshot_no", "tunnel"], ["loaded_at", "row_id"])
    order = [("throughput", True), ("snapshot_no", False), ("tunnel", False), ("row_id", False)]
    return top_items(tunnels, ["md_traj", "tunnel_cluster"], n, order).select("md_traj", "tunnel_cluster", "rank_no", "row_id")


def _clusters(spark: SparkSession, d: str) -> PointClusters:
    points = table(spark, d, "bottlenecks")
    axes = ["bottleneck_x", "bottleneck_y", "bottleneck_z"]
    for c in axes:
        points = points.where(F.col(c) != MISSING_COORDINATE)
    return PointClusters(points, "md_traj", "row_id", axes, SIMILAR_DISTANCE)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each cluster of nearby bottlenecks with each other row of it."""
    members = _clusters(spark, d).members()
    return members.where(F.col("row_id") != F.col("first_id")).select(F.col("first_id").alias("first_row_id"), "row_id")


def p3_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster of nearby bottlenecks: its size, place and most typical rows."""
    return _clusters(spark, d).describe().withColumnRenamed("first_id", "first_row_id")


def p3_sizes(spark: SparkSession, d: str) -> DataFrame:
    """The number of rows of each cluster of nearby bottlenecks."""
    return _clusters(spark, d).describe().select(F.col("first_id").alias("first_row_id"), "md_traj", F.col("size").alias("n_rows"))


def _fields(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "bottlenecks").where(F.col("md_traj").isNotNull())
    days = rows.withColumn("day", F.to_date("loaded_at"))
    return tall(days, ["md_traj", "day"], ["throughput", "bottleneck_r"]).where(F.col("value") >= 0)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Simulations and fields whose 90th percentile is at least twice the median."""
    sketches = sketch(_fields(spark, d), ["md_traj", "field_name"], "value")
    got = percentiles(sketches, {"p50": 0.5, "p90": 0.9})
    return got.where(F.col("p90") >= 2 * F.col("p50")).select("md_traj", "field_name")


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each simulation and field, put together from sketches of single days."""
    days = sketch(_fields(spark, d), ["md_traj", "field_name", "day"], "value")
    together = merge(days, ["md_traj", "field_name"])
    return percentiles(together, WANTED)


WANTED = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99}


def p4_rank_bound(spark: SparkSession, d: str) -> DataFrame:
    """Whether the percentiles of each simulation and field are within the sketch's error, two sketches' worth after merging."""
    return rank_check(_fields(spark, d), ["md_traj", "field_name"], "value", p4_percentiles(spark, d), WANTED, 2 * rank_error(DEFAULT_K))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every document."""
    return encode_column(table(spark, d, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, encoded and decoded again; empty for a null one."""
    return decode_column(encode_column(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "ids")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """The place of every piece of every document in a container of 4,096 tokens."""
    return pack(count_tokens(table(spark, d, "documents"), "doc_id", "text"), "doc_id", "n_tokens", CAPACITY)


def p8_audit(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with the packing (nothing), and whether it needs at most 1.005 times the containers that the tokens fill, and one."""
    got = audit(p8_containers(spark, d), CAPACITY)
    few = F.col("n_containers") <= F.ceil(1.005 * F.col("n_tokens") / CAPACITY) + 1
    return got.select("n_items", "overlaps", "overfull", "needless_splits", "torn", few.alias("well_filled"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that had to be split over containers."""
    return p8_containers(spark, d).where((F.col("n_pieces") > 1) & (F.col("piece_no") == 0)).select("doc_id")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    """Words of English prose, score and reading level of every document."""
    return reading_levels(table(spark, d, "documents"), table(spark, d, "reading_labels"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose prose is advanced."""
    return p9_levels(spark, d).where(F.col("level") == "advanced").select("doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p2_found": p2_found, "p3_found": p3_found, "p3_clusters": p3_clusters, "p3_sizes": p3_sizes, "p4_found": p4_found, "p4_percentiles": p4_percentiles, "p4_rank_bound": p4_rank_bound,
        "p7_ids": p7_ids, "p7_round_trip": p7_round_trip, "p8_found": p8_found, "p8_containers": p8_containers, "p8_audit": p8_audit,
        "p9_found": p9_found, "p9_levels": p9_levels,
    }
