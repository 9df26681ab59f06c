"""Queries of the core package over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poregrid.functions.domain import is_number, snapshot_number
from poregrid.operators import packed, skew, wide
from poregrid.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Cluster numbers above 0 that stand in at least a hundredth of all rows."""
    heavy = skew.heavy_keys(table(spark, d, "bottlenecks"), F.col("tunnel_cluster"), F.col("throughput"), 0.01)
    return heavy.where(F.col("key") > 0).select(F.col("key").alias("tunnel_cluster"))


def p1_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Exact figures of the bottleneck radius of every tunnel cluster."""
    radius = F.col("bottleneck_r")
    rows = table(spark, d, "bottlenecks").where((F.col("tunnel_cluster") > 0) & is_number(radius) & (radius >= 0))
    got = skew.key_statistics(rows, F.col("tunnel_cluster"), F.col("bottleneck_r"), (0.5, 0.9))
    return got.select(F.col("key").alias("tunnel_cluster"), "n_rows", "n_distinct", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The residues lining each bottleneck, one per row."""
    return packed.unpack(table(spark, d, "bottlenecks"), "row_id", "bottleneck_residues", "residue", every_delimiter_parts=True)


TUNNEL_KEYS = ["md_traj", "snapshot_no", "tunnel_cluster", "tunnel"]


def _catalog(spark: SparkSession, d: str) -> list[wide.Attribute]:
    rows = table(spark, d, "axis_catalog").orderBy("axis_name").limit(wide.MAX_ATTRIBUTES + 1).collect()
    return [wide.Attribute(r.axis_name, r.column_name, r.value_type, r.is_required) for r in rows]


def _wide_profiles(spark: SparkSession, d: str, attributes: list[wide.Attribute]) -> DataFrame:
    keys = {"md_traj": F.col("md_traj"), "snapshot_no": snapshot_number(F.col("snapshot")), "tunnel_cluster": F.col("tunnel_cluster"), "tunnel": F.col("tunnel")}
    return wide.widen(table(spark, d, "tunnel_profiles"), keys, "axis", "axis_values", ["loaded_at", "line_id"], attributes)


def p6_wide(spark: SparkSession, d: str) -> DataFrame:
    """One row per tunnel with a typed column for each axis, those beyond the catalogue included."""
    return _wide_profiles(spark, d, wide.discover(table(spark, d, "tunnel_profiles"), "axis", "axis_values", _catalog(spark, d)))


def p6_cells(spark: SparkSession, d: str) -> DataFrame:
    """Of every column of the wide rows: in how many tunnels it has numbers, how many, and their sum; axes beyond the catalogue included."""
    attributes = wide.discover(table(spark, d, "tunnel_profiles"), "axis", "axis_values", _catalog(spark, d))
    rows = _wide_profiles(spark, d, attributes)
    arrays = [a for a in attributes if a.value_type.startswith("array<") and a.value_type != "array<string>"]
    cells = F.array(*[F.struct(F.lit(a.name).alias("axis"), F.col(a.column).cast("array<double>").alias("v")) for a in arrays])
    long = rows.select(F.explode(cells).alias("c")).where(F.col("c.v").isNotNull())
    numbers = F.filter("c.v", lambda v: v.isNotNull())
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, v: acc + v)
    return long.groupBy(F.lower("c.axis").alias("axis")).agg(F.count(F.lit(1)).alias("n_tunnels"), F.sum(F.size(numbers)).alias("n_numbers"), F.round(F.sum(total), 3).alias("total"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The required axes that a tunnel lacks."""
    attributes = wide.discover(table(spark, d, "tunnel_profiles"), "axis", "axis_values", _catalog(spark, d))
    return wide.missing_required(_wide_profiles(spark, d, attributes), TUNNEL_KEYS, attributes, "axis")


P1_FOUND = """
select tunnel_cluster from bottlenecks
where tunnel_cluster > 0
group by tunnel_cluster
having count(*) >= 0.01 * (select count(*) from bottlenecks)
"""

P1_STATISTICS = """
select tunnel_cluster, count(*) as n_rows, count(distinct bottleneck_r) as n_distinct,
       round(quantile_cont(bottleneck_r, 0.5), 6) as p50, round(quantile_cont(bottleneck_r, 0.9), 6) as p90
from bottlenecks
where tunnel_cluster > 0 and bottleneck_r >= 0 and not isnan(bottleneck_r)
group by tunnel_cluster
"""

P5_FOUND = r"""
with f as (
  select row_id, regexp_extract_all(regexp_replace(bottleneck_residues, '^\s+|\s+$', '', 'g'),
         '("(?:[^"]|"")*"|''(?:[^'']|'''')*''|[^\s,;|/]*)(?:\s*[,;|/]\s*|\s+|$)', 1) as slots
  from bottlenecks where bottleneck_residues is not null),
s as (select row_id, unnest(slots) as slot, generate_subscripts(slots, 1) as pos from f),
v as (
  select row_id, cast(pos as int) as pos,
         case when length(slot) > 1 and slot[1] = '"' and slot[-1] = '"' then replace(slot[2:-2], '""', '"')
              when length(slot) > 1 and slot[1] = '''' and slot[-1] = '''' then replace(slot[2:-2], '''''', '''')
              else slot end as residue
  from s)
select row_id, pos, residue from v where residue <> '' and not regexp_full_match(residue, '-+')
"""

P6_FOUND = r"""
with lines as (
  select md_traj, cast(regexp_extract(snapshot, '([0-9]+)[^0-9]*\.pdb', 1) as int) as snapshot_no, tunnel_cluster, tunnel,
         regexp_replace(lower(axis), '^[\s[:punct:]]+|[\s[:punct:]]+$', '', 'g') as a, axis_values, loaded_at, line_id
  from tunnel_profiles),
last_ as (
  select *, list_bool_or(list_transform(string_split(coalesce(axis_values, ''), ','),
              lambda c: coalesce(isfinite(try_cast(trim(c) as double)), false))) as has_number
  from lines
  qualify row_number() over (partition by md_traj, snapshot_no, tunnel_cluster, tunnel, a order by loaded_at desc, line_id desc) = 1),
tunnels as (select distinct md_traj, snapshot_no, tunnel_cluster, tunnel from lines)
select t.md_traj, t.snapshot_no, t.tunnel_cluster, t.tunnel, c.axis_name as axis
from tunnels t cross join (select * from axis_catalog where is_required) c
left join last_ l on l.md_traj = t.md_traj and l.snapshot_no = t.snapshot_no and l.tunnel_cluster = t.tunnel_cluster
  and l.tunnel = t.tunnel and l.a = lower(c.axis_name)
where l.has_number is null or not l.has_number
"""

P6_CELLS = r"""
with lines as (
  select md_traj, cast(regexp_extract(snapshot, '([0-9]+)[^0-9]*\.pdb', 1) as int) as snapshot_no, tunnel_cluster, tunnel,
         regexp_replace(lower(axis), '^[\s[:punct:]]+|[\s[:punct:]]+$', '', 'g') as axis, axis_values, loaded_at, line_id
  from tunnel_profiles),
last_ as (
  select *, list_filter(list_transform(string_split(coalesce(axis_values, ''), ','), lambda c: try_cast(trim(c) as double)), lambda v: v is not null and isfinite(v)) as v
  from lines qualify row_number() over (partition by md_traj, snapshot_no, tunnel_cluster, tunnel, axis order by loaded_at desc, line_id desc) = 1)
select axis, count(*) as n_tunnels, sum(len(v)) as n_numbers, round(sum(list_sum(v)), 3) as total
from last_ where axis <> '' and len(v) > 0 group by axis
"""


def queries() -> dict[str, Query]:
    from poregrid import domain_queries

    own: dict[str, Query] = {"p1_found": p1_found, "p1_statistics": p1_statistics, "p5_found": p5_found, "p6_found": p6_found, "p6_wide": p6_wide, "p6_cells": p6_cells}
    return {**domain_queries.queries(), **own}


def oracle_sql() -> dict[str, str]:
    from poregrid import domain_queries

    own = {"p1_found": P1_FOUND, "p1_statistics": P1_STATISTICS, "p5_found": P5_FOUND, "p6_found": P6_FOUND, "p6_cells": P6_CELLS}
    return {**domain_queries.oracle_sql(), **own}
