"""The test tables seen as tunnels, nodes and event points; each view also as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poregrid.functions.geometry import layer, norm
from poregrid.session import table

SNAPSHOTS, OFFSET = 250, 1


def tunnels(spark: SparkSession, d: str) -> DataFrame:
    """Line items as tunnels; nations (25 rows by definition) are simulations, regions comparison groups."""
    nation = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    # Line items meet the suppliers first: Spark sees the true sizes of both and picks the join by them.
    rows = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    rows = rows.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(
        F.col("n_name").alias("md_label"), F.col("r_name").alias("grp"), (F.col("l_orderkey") % SNAPSHOTS + 1).cast("int").alias("snapshot_id"),
        (F.col("l_partkey") % 40 + 1).cast("int").alias("cluster_id"), ((F.col("l_partkey") % 40 + 1) % 12 + 1).cast("int").alias("sc_id"),
        F.col("l_linenumber").alias("tunnel_id"), (F.col("l_extendedprice") / 200000.0).alias("throughput"),
        (0.7 + F.col("l_discount") * 10).alias("bottleneck_radius"), (5 + F.col("l_quantity")).alias("length"), (1 + F.col("l_tax") * 20).alias("curvature"),
    )


TUNNELS = """
v_tunnels as (
  select n_name as md_label, r_name as grp, cast(l_orderkey % 250 + 1 as int) as snapshot_id, cast(l_partkey % 40 + 1 as int) as cluster_id,
         cast((l_partkey % 40 + 1) % 12 + 1 as int) as sc_id, l_linenumber as tunnel_id, l_extendedprice / 200000.0 as throughput,
         0.7 + l_discount * 10 as bottleneck_radius, 5 + l_quantity as length, 1 + l_tax * 20 as curvature
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

BEST = TUNNELS + """,
best as (
  select * from v_tunnels
  qualify row_number() over (partition by sc_id, md_label, snapshot_id
    order by throughput desc, cluster_id, tunnel_id, length, bottleneck_radius, curvature) = 1)"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as nodes of ten path sets."""
    e = F.col("embedding")
    rows = table(spark, d, "embeddings").select(
        F.col("label").alias("entity"), F.col("vec_id").cast("string").alias("node"), *[(e[k].cast("double") * 40).alias(c) for k, c in enumerate("xyz")],
        (0.7 + F.abs(e[3].cast("double")) * 3).alias("radius"), F.abs(e[4].cast("double")).alias("rmsf"), (F.col("vec_id") % 7 == 0).alias("is_end"),
    )
    return rows.withColumn("layer", layer(norm([F.col(c) for c in "xyz"]), 1.5))


NODES = """
v_points as (
  select label as entity, cast(vec_id as varchar) as node, cast(embedding[1] as double) * 40 as x, cast(embedding[2] as double) * 40 as y,
         cast(embedding[3] as double) * 40 as z, 0.7 + abs(cast(embedding[4] as double)) * 3 as radius, abs(cast(embedding[5] as double)) as rmsf,
         vec_id % 7 = 0 as is_end
  from embeddings),
v_nodes as (select *, cast(greatest(0, ceil(ceil(sqrt(x * x + y * y + z * z)) / 1.5) - 1) as int) as layer from v_points)"""


def trace_points(spark: SparkSession, d: str) -> DataFrame:
    """User events as points of ligand traces."""
    kind = F.when(F.col("event_type") == "signup", "entry").when(F.col("event_type") == "purchase", "release").otherwise("inside")
    return table(spark, d, "events").select(F.col("user_id").alias("path"), "ts", "event_id", kind.alias("event_type"), F.col("value").alias("dist"))


TRACE_POINTS = """
v_trace as (
  select user_id as path, ts, event_id, value as dist,
         case event_type when 'signup' then 'entry' when 'purchase' then 'release' else 'inside' end as event_type
  from events)"""


def bottleneck_points(spark: SparkSession, d: str) -> DataFrame:
    """Bottlenecks with a simulation, a cluster above 0 and finite coordinates."""
    rows = table(spark, d, "bottlenecks").where(F.col("md_traj").isNotNull() & (F.col("tunnel_cluster") > 0))
    for c in "xyz":
        v = F.col(f"bottleneck_{c}")
        rows = rows.where(v.isNotNull() & ~F.isnan(v) & (v != 999.0)).withColumn(c, v)
    r = F.col("bottleneck_r")
    return rows.where(r.isNotNull() & ~F.isnan(r) & (r > 0)).withColumn("radius", r)


BOTTLENECK_POINTS = """
v_bn as (
  select *, bottleneck_x as x, bottleneck_y as y, bottleneck_z as z, bottleneck_r as radius from bottlenecks
  where md_traj is not null and tunnel_cluster > 0 and isfinite(bottleneck_x) and isfinite(bottleneck_y) and isfinite(bottleneck_z)
    and bottleneck_x <> 999.0 and bottleneck_y <> 999.0 and bottleneck_z <> 999.0 and isfinite(bottleneck_r) and bottleneck_r > 0)"""


def trace_places(spark: SparkSession, d: str) -> DataFrame:
    """User events as ligand traces in space: path, ord, event_type, x, y, z."""
    from pyspark.sql import Window

    i, r = F.col("event_id"), F.col("dist") / 10
    ord_ = F.row_number().over(Window.partitionBy("path").orderBy("ts", "event_id"))
    places = [(r * (i * a % b - b // 2) / 10).alias(c) for c, a, b in (("x", 7, 11), ("y", 3, 7), ("z", 5, 13))]
    return trace_points(spark, d).select("path", ord_.alias("ord"), "event_type", *places)


TRACE_PLACES = TRACE_POINTS + """,
v_places as (
  select path, cast(row_number() over (partition by path order by ts, event_id) as int) as ord, event_type,
         (dist / 10) * (event_id * 7 % 11 - 5) / 10 as x, (dist / 10) * (event_id * 3 % 7 - 3) / 10 as y, (dist / 10) * (event_id * 5 % 13 - 6) / 10 as z
  from v_trace)"""
