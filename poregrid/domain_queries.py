"""Queries of the tunnel, node and trace operators over the test tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poregrid import bindings as B
from poregrid.functions import geometry as G
from poregrid.functions.domain import snapshot_number
from poregrid.operators import assign, events, filters, layering, matching, nodes, packed, profiles, traces
from poregrid.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


#: Places to compare to, chosen so that an exact half is unlikely: the mean of a few short decimals can be one.
PLACES = {"throughput_avg": 4, "throughput_std": 4, "priority": 4} | dict.fromkeys(
    ["radii_avg", "radii_std", "radii_max", "length_avg", "length_std", "curvature_avg", "curvature_std"], 9
)


def rounded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES.get(c, 6)) for c in columns})


def best(spark: SparkSession, d: str) -> DataFrame:
    return profiles.best_per_snapshot(B.tunnels(spark, d))


def total_sims(spark: SparkSession, d: str) -> int:
    return table(spark, d, "nation").count()


FIGURES = ["radii_avg", "radii_std", "radii_max", "length_avg", "length_std", "curvature_avg", "curvature_std", "throughput_avg", "throughput_std", "avg_snaps", "priority"]
FIGURES_SQL = """
  count(distinct md_label) as num_md_sims, count(*) as num_snaps,
  round(avg(bottleneck_radius), 9) as radii_avg, round(stddev_pop(bottleneck_radius), 9) as radii_std, round(max(bottleneck_radius), 9) as radii_max,
  round(avg(length), 9) as length_avg, round(stddev_pop(length), 9) as length_std,
  round(avg(curvature), 9) as curvature_avg, round(stddev_pop(curvature), 9) as curvature_std,
  round(avg(throughput), 4) as throughput_avg, round(stddev_pop(throughput), 4) as throughput_std"""
OVERALL_SQL = f"""select sc_id, 'overall' as label, {FIGURES_SQL}, round(count(*) / 25, 6) as avg_snaps,
  round(avg(throughput) * (count(*) / 250) * (count(distinct md_label) / 25), 4) as priority from best group by sc_id"""
GROUP_SQL = f"""select sc_id, best.grp as label, {FIGURES_SQL}, any_value(group_size) as group_size, round(count(*) / any_value(group_size), 6) as avg_snaps,
  round(avg(throughput) * (count(*) / 250) * (count(distinct md_label) / any_value(group_size)), 4) as priority
  from best join sizes on sizes.grp = best.grp group by sc_id, best.grp"""
MD_SQL = f"""select sc_id, md_label as label, {FIGURES_SQL}, round(count(*) * 1.0, 6) as avg_snaps,
  round(avg(throughput) * (count(*) / 250), 4) as priority from best group by sc_id, md_label"""
SIZES = ", sizes as (select r_name as grp, count(*) as group_size from nation join region on n_regionkey = r_regionkey group by r_name)"


def group_sizes(spark: SparkSession, d: str) -> DataFrame:
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy(F.col("r_name").alias("grp")).agg(F.count(F.lit(1)).alias("group_size"))


@query(f"with {B.BEST} select sc_id, md_label, snapshot_id, cluster_id, tunnel_id, throughput from best")
def best_tunnel_per_snapshot(spark, d):
    return best(spark, d).select("sc_id", "md_label", "snapshot_id", "cluster_id", "tunnel_id", "throughput")


@query(f"with {B.BEST} {OVERALL_SQL}")
def sc_properties_overall(spark, d):
    return rounded(profiles.properties(best(spark, d), "overall", B.SNAPSHOTS, total_sims(spark, d)), FIGURES)


@query(f"with {B.BEST} {MD_SQL}")
def sc_properties_md(spark, d):
    return rounded(profiles.properties(best(spark, d), "md", B.SNAPSHOTS, total_sims(spark, d)), FIGURES)


@query(f"with {B.BEST} {SIZES} {GROUP_SQL}")
def sc_properties_group(spark, d):
    return rounded(profiles.properties(best(spark, d), "group", B.SNAPSHOTS, total_sims(spark, d), group_sizes(spark, d)), FIGURES)


@query(f"""with {B.BEST}, props as (
  select sc_id, avg(throughput) * (count(*) / 250) * (count(distinct md_label) / 25) as priority from best group by sc_id)
select sc_id, round(priority, 4) as priority, cast(row_number() over (order by priority desc, sc_id desc) as int) as prioritized_id from props""")
def sc_priority_rank(spark, d):
    """Superclusters in order of priority: best tunnels, figures, ranks."""
    props = profiles.properties(best(spark, d), "overall", B.SNAPSHOTS, total_sims(spark, d))
    return rounded(profiles.priority_order(props).select("sc_id", "priority", "prioritized_id"), ["priority"])


@query(f"""with {B.BEST}, kept as (select * from best where round(bottleneck_radius, 6) >= 1.2 and round(length, 6) <= 50),
enough as (select sc_id from kept group by sc_id having count(distinct md_label) >= 5 and count(*) / 25 >= 20)
select sc_id, 'overall' as label, {FIGURES_SQL}, round(count(*) / 25, 6) as avg_snaps,
  round(avg(throughput) * (count(*) / 250) * (count(distinct md_label) / 25), 4) as priority
from kept where sc_id in (select sc_id from enough) group by sc_id""")
def filtered_sc_properties(spark, d):
    sims = total_sims(spark, d)
    wanted = filters.define_filters(min_radius=1.2, max_length=50, min_sims=5, min_avg_snapshots=20)
    return rounded(profiles.properties(filters.filter_profile(best(spark, d), wanted, sims), "overall", B.SNAPSHOTS, sims), FIGURES)


@query(f"""with {B.BEST}, kept as (select * from best where round(bottleneck_radius, 6) >= 1.5),
own as (select distinct sc_id, md_label, cluster_id from kept), members as (select distinct sc_id, md_label, cluster_id from v_tunnels)
select m.*, o.sc_id is not null as valid from members m left join own o on o.sc_id = m.sc_id and o.md_label = m.md_label and o.cluster_id = m.cluster_id""")
def cluster_validity(spark, d):
    members = B.tunnels(spark, d).select("sc_id", "md_label", "cluster_id").distinct()
    return filters.valid_clusters(members, best(spark, d).where(filters.tunnel_passes(filters.define_filters(min_radius=1.5))))


@query(f"with {B.TUNNELS} select md_label, cluster_id, snapshot_id, count(*) as n_tunnels from v_tunnels group by all having count(*) > 1")
def duplicate_tunnel_report(spark, d):
    return filters.repeated_tunnels(B.tunnels(spark, d))


@query(f"with {B.TUNNELS} select md_label, cluster_id, count(*) as n_tunnels from v_tunnels group by all having count(*) >= 60")
def occurrence_limit(spark, d):
    return filters.occurring(B.tunnels(spark, d), 60)


@query(f"""with {B.TUNNELS} select md_label, cluster_id, snapshot_id, tunnel_id, length, throughput,
  round(bottleneck_radius, 6) >= 0.75 and round(length, 6) >= 5 and round(curvature, 6) <= 2 as passes_prefilter from v_tunnels""")
def tunnel_prefilter(spark, d):
    return B.tunnels(spark, d).select("md_label", "cluster_id", "snapshot_id", "tunnel_id", "length", "throughput", filters.passes_prefilter().alias("passes_prefilter"))


@query(f"""with {B.TUNNELS}, p as (select md_label, cluster_id, sum(throughput) / 250 as priority from v_tunnels group by all)
select md_label, cluster_id, round(priority, 4) as priority,
  cast(row_number() over (partition by md_label order by priority desc, cluster_id) as int) as new_id from p""")
def rerank_priority(spark, d):
    return rounded(profiles.frame_rank(B.tunnels(spark, d), B.SNAPSHOTS), ["priority"])


@query(f"with {B.TUNNELS} select md_label, cluster_id, round(avg(throughput), 4) as throughput_avg, count(*) as n_tunnels from v_tunnels group by all")
def cluster_characteristics(spark, d):
    return rounded(profiles.cluster_characteristics(B.tunnels(spark, d)), ["throughput_avg"])


@query(f"""with {B.TUNNELS}, c as (select md_label, cluster_id, sc_id, avg(throughput) as t, count(*) as n from v_tunnels group by all)
select sc_id, round((sum(n) / 250) * avg(t) * (count(distinct md_label) / 25), 6) as importance from c group by sc_id""")
def sc_importance(spark, d):
    t = B.tunnels(spark, d)
    membership = t.select("cluster_id", "sc_id").distinct()
    got = profiles.supercluster_importance(profiles.cluster_characteristics(t), membership, B.SNAPSHOTS, total_sims(spark, d))
    return rounded(got, ["importance"])


@query(f"""with {B.TUNNELS}, c as (select md_label, cluster_id, avg(throughput) as t, count(*) as n from v_tunnels group by all)
select md_label, cluster_id, cast(row_number() over (order by cluster_id, round(1 / t, 9), 1 / n, md_label) as int) as ord from c""")
def cluster_importance_order(spark, d):
    c = profiles.cluster_characteristics(B.tunnels(spark, d))
    steady = c.withColumn("throughput_avg", 1 / F.round(1 / F.col("throughput_avg"), 9))
    return profiles.cluster_order(steady).select("md_label", "cluster_id", "ord")


@query(f"""with {B.BEST}, sims as (select distinct sc_id, md_label from best), frames as (select unnest(range(250)) as frame)
select s.sc_id, s.md_label, cast(f.frame as int) as frame, coalesce(b.bottleneck_radius, -1.0) as value
from sims s cross join frames f left join best b on b.sc_id = s.sc_id and b.md_label = s.md_label and b.snapshot_id = f.frame + 1""")
def time_evolution(spark, d):
    b = best(spark, d)
    return profiles.time_evolution(b, b.select("sc_id", "md_label").distinct(), "bottleneck_radius", B.SNAPSHOTS, B.OFFSET, -1.0)


def _residues_of(spark, d, keys):
    rows = table(spark, d, "bottlenecks").where(F.col("md_traj").isNotNull() & (F.col("tunnel_cluster") > 0))
    single = packed.unpack(rows, "row_id", "bottleneck_residues", "residue", keep=keys, every_delimiter_parts=True)
    return single.select(*keys, "residue"), rows.select(*keys)


RESIDUES = """
hits as (select b.tunnel_cluster, p.residue, count(*) as n from p5 p join bn b using (row_id) group by all),
totals as (select tunnel_cluster, count(*) as total from bn group by all)"""


@query("P5:" + RESIDUES + " select tunnel_cluster, residue, round(n / total, 6) as freq from hits join totals using (tunnel_cluster)")
def residue_frequency(spark, d):
    residues, rows = _residues_of(spark, d, ("tunnel_cluster",))
    return rounded(profiles.residue_frequency(residues, rows, ["tunnel_cluster"]), ["freq"])


@query("P5:" + RESIDUES + """ select tunnel_cluster, string_agg(residue, ',' order by round(n / total, 6) desc, residue desc) as residues
from hits join totals using (tunnel_cluster) group by tunnel_cluster""")
def residue_top(spark, d):
    """The residues of each cluster by frequency and name, both falling."""
    f = residue_frequency(spark, d)
    items = F.sort_array(F.collect_list(F.struct("freq", "residue")), asc=False)
    return f.groupBy("tunnel_cluster").agg(F.array_join(F.transform(items, lambda s: s.residue), ",").alias("residues"))


@query(f"with {B.BOTTLENECK_POINTS} select row_id, cast(greatest(0, ceil(ceil(sqrt(x * x + y * y + z * z)) / 1.5) - 1) as int) as layer from v_bn")
def layer_ids(spark, d):
    return B.bottleneck_points(spark, d).select("row_id", G.layer(G.norm([F.col(c) for c in "xyz"]), 1.5).alias("layer"))


@query(f"""with {B.BOTTLENECK_POINTS}, p as (select *, cast(greatest(0, ceil(ceil(sqrt(x * x + y * y + z * z)) / 1.5) - 1) as int) as layer from v_bn),
m as (select md_traj, layer, avg(x) as mx, avg(y) as my, avg(z) as mz from p group by all)
select md_traj, layer, round(any_value(mx), 6) as x, round(any_value(my), 6) as y, round(any_value(mz), 6) as z,
  round(sqrt(avg((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2)), 6) as rmsf, round(quantile_cont(radius, 0.9), 6) as radius,
  count(*) filter (tunnel > 5) as num_end_points, bool_or(tunnel = 1) as has_start, count(*) as n_points
from p join m using (md_traj, layer) group by md_traj, layer""")
def node_stats_quantile(spark, d):
    p = B.bottleneck_points(spark, d).withColumn("layer", G.layer(G.norm([F.col(c) for c in "xyz"]), 1.5))
    p = p.select("md_traj", "layer", "x", "y", "z", "radius", (F.col("tunnel") > 5).alias("is_end"), (F.col("tunnel") == 1).alias("is_start"))
    return rounded(nodes.node_statistics(p, ["md_traj", "layer"]), ["x", "y", "z", "rmsf", "radius"])


TURN = [0.0, -1.0, 0.0, 10.0, 1.0, 0.0, 0.0, -5.0, 0.0, 0.0, 1.0, 2.5, 0.0, 0.0, 0.0, 1.0]


@query(f"with {B.BOTTLENECK_POINTS} select row_id, round(10.0 - y, 6) as x, round(x - 5.0, 6) as y, round(z + 2.5, 6) as z from v_bn")
def affine_transform(spark, d):
    p = B.bottleneck_points(spark, d)
    moved = G.affine(TURN, [F.col(c) for c in "xyz"])
    return rounded(p.select("row_id", *[m.alias(c) for m, c in zip(moved, "xyz")]), ["x", "y", "z"])


@query(f"with {B.BOTTLENECK_POINTS} select row_id, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from v_bn")
def inverse_roundtrip(spark, d):
    p = B.bottleneck_points(spark, d)
    there = p.select("row_id", *[m.alias(c) for m, c in zip(G.affine(TURN, [F.col(c) for c in "xyz"]), "xyz")])
    back = G.affine(G.rigid_inverse(TURN), [F.col(c) for c in "xyz"])
    return rounded(there.select("row_id", *[m.alias(c) for m, c in zip(back, "xyz")]), ["x", "y", "z"])


@query(f"""with {B.BOTTLENECK_POINTS} select row_id, round(atan2(sqrt((2 * z - 3 * y) ** 2 + (3 * x - z) ** 2 + (y - 2 * x) ** 2), x + 2 * y + 3 * z), 6) as angle,
  atan2(sqrt((2 * z - 3 * y) ** 2 + (3 * x - z) ** 2 + (y - 2 * x) ** 2), x + 2 * y + 3 * z) <= 1.0 as aligned from v_bn""")
def vector_angle(spark, d):
    one = [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    v = [F.col(c) for c in "xyz"]
    return B.bottleneck_points(spark, d).select("row_id", F.round(G.angle(one, v), 6).alias("angle"), G.aligned(one, v, 1.0).alias("aligned"))


@query(f"""with {B.BOTTLENECK_POINTS} select row_id, round(sqrt(x * x + y * y + z * z), 6) as r, round(atan2(sqrt(x * x + y * y), z), 6) as theta,
  round(atan2(y, x), 6) as phi from v_bn""")
def spherical(spark, d):
    r, theta, phi = G.spherical([F.col(c) for c in "xyz"])
    return rounded(B.bottleneck_points(spark, d).select("row_id", r.alias("r"), theta.alias("theta"), phi.alias("phi")), ["r", "theta", "phi"])


def _xyz(side: str):
    return [F.col(f"{side}_{c}") for c in "xyz"]


PAIRS_SQL = f"""with {B.NODES}, lim as (select entity, min(layer) filter (is_end) as first_end, max(layer) as last_layer from v_nodes group by entity),
pairs as (
  select q.entity as entity, t.entity as target, q.node as q_node, t.node as t_node, q.radius as q_radius, t.radius as t_radius, q.rmsf as q_rmsf, t.rmsf as t_rmsf,
         sqrt((q.x - t.x) ** 2 + (q.y - t.y) ** 2 + (q.z - t.z) ** 2) as d
  from v_nodes q join v_nodes t on q.entity <> t.entity join lim ql on ql.entity = q.entity join lim tl on tl.entity = t.entity
  where abs(q.layer - t.layer) <= 1 or coalesce(t.layer >= ql.first_end, false) or (q.layer = ql.last_layer and t.layer > q.layer)
     or (q.layer > tl.last_layer and t.layer >= tl.last_layer - 1))"""
NEAR_SQL = f"""{PAIRS_SQL}, s as (select entity, target, q_node, t_node, round(greatest(d - (q_radius + t_radius), 0.0), 6) as dist from pairs),
near as (select entity, target, q_node, t_node as nearest, dist from s qualify row_number() over (partition by entity, target, q_node order by dist, t_node) = 1)"""


def _pairs(spark, d):
    """Node pairs within the band for every ordered pair of distinct path sets."""
    n = B.nodes(spark, d)
    sets = n.select("entity").distinct()
    query_set = n.join(sets.withColumnRenamed("entity", "target"), F.col("entity") != F.col("target"))
    target = n.withColumnRenamed("entity", "target").join(sets, F.col("entity") != F.col("target"))
    return nodes.band_candidates(query_set, target, ["entity", "target"])


@query(f"{PAIRS_SQL} select entity, target, q_node, t_node, round(d - (q_radius + t_radius), 6) as dist from pairs")
def layer_band_join(spark, d):
    """Node pairs within the layer band of all ordered pairs of path sets, with their surface distance."""
    dist = G.surface_distance(_xyz("q"), _xyz("t"), F.col("q_radius"), F.col("t_radius"))
    return rounded(_pairs(spark, d).select("entity", "target", "q_node", "t_node", dist.alias("dist")), ["dist"])


@query(f"{PAIRS_SQL} select entity, target, q_node, t_node, round(d - (q_radius + t_radius) - least((q_rmsf + t_rmsf) / 2, 3.0), 6) as dist from pairs")
def rmsf_distance(spark, d):
    dist = G.relaxed_distance(_xyz("q"), _xyz("t"), *[F.col(c) for c in ("q_radius", "t_radius", "q_rmsf", "t_rmsf")])
    return rounded(_pairs(spark, d).select("entity", "target", "q_node", "t_node", dist.alias("dist")), ["dist"])


@query(f"{NEAR_SQL} select * from near")
def nearest_node(spark, d):
    dist = F.round(G.surface_distance(_xyz("q"), _xyz("t"), F.col("q_radius"), F.col("t_radius")), 6)
    return nodes.nearest(_pairs(spark, d), ["entity", "target", "q_node"], dist, "t_node")


@query(f"""{NEAR_SQL} select near.entity, target, round(avg(case when dist = 0 then 1.0 else 0.0 end), 6) as buriedness, round(max(1 / (layer + 1)), 6) as depth
from near join v_nodes on node = nearest group by near.entity, target""")
def buriedness_depth(spark, d):
    depths = B.nodes(spark, d).select("node", (1 / (F.col("layer") + 1)).alias("depth"))
    return rounded(nodes.containment(nearest_node(spark, d), depths, ["entity", "target"]), ["buriedness", "depth"])


@query(f"""with {B.NODES} select entity, layer, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z, round(max(radius), 6) as radius,
  round(max(rmsf), 6) as rmsf, bool_or(is_end) as is_end from v_nodes group by entity, layer""")
def node_merge(spark, d):
    n = B.nodes(spark, d).withColumn("at", F.col("layer"))
    merged = nodes.merge_nodes(n, ["entity", "at"]).drop("layer").withColumnRenamed("at", "layer")
    return rounded(merged, ["x", "y", "z", "radius", "rmsf"])


@query(f"""with {B.NODES} select entity, layer, node as old_node,
  concat_ws('_', layer, row_number() over (partition by entity, layer order by z, y, x)) as node from v_nodes""")
def node_labels(spark, d):
    return nodes.ordered_labels(B.nodes(spark, d).withColumnRenamed("node", "old_node"), ["entity"]).select("entity", "layer", "old_node", "node")


@query(f"""with {B.NODES} select entity, min(layer) filter (is_end) as first_end, max(layer) as last_layer from v_nodes group by entity""")
def layer_limits(spark, d):
    return nodes.layer_limits(B.nodes(spark, d), ["entity"])


@query(f"""with {B.NODES}, e as (select entity, avg(x) as x, avg(y) as y, avg(z) as z from v_nodes where is_end group by entity)
select n.node, e.entity as sc_id from v_nodes n join e on
  atan2(sqrt((n.y * e.z - n.z * e.y) ** 2 + (n.z * e.x - n.x * e.z) ** 2 + (n.x * e.y - n.y * e.x) ** 2), n.x * e.x + n.y * e.y + n.z * e.z) <= 1.0471975511965976""")
def event_sc_direction(spark, d):
    n = B.nodes(spark, d)
    ends = n.where("is_end").groupBy(F.col("entity").alias("sc_id")).agg(*[F.avg(c).alias(c) for c in "xyz"])
    return assign.by_direction(n, ends, 1.0471975511965976).select("node", "sc_id")


RUNS = f"""with {B.TRACE_POINTS}, c as (
  select *, case when event_type = lag(event_type) over w then 0 else 1 end as c from v_trace window w as (partition by path order by ts, event_id)),
r as (select *, sum(c) over (partition by path order by ts, event_id rows unbounded preceding) as run_no from c)"""


@query(RUNS + " select path, event_id, event_type, cast(run_no as bigint) as run_no from r qualify run_no = min(run_no) over (partition by path, event_type)")
def merge_consecutive_segments(spark, d):
    return traces.first_run(B.trace_points(spark, d), ["path"], ["ts", "event_id"], "event_type").select("path", "event_id", "event_type", "run_no")


@query(f"""with {B.TRACE_POINTS}, b as (
  select *, coalesce(cast(dist > min(dist) over (partition by path order by ts, event_id rows between unbounded preceding and 1 preceding) as int), 0) as b from v_trace),
s as (select *, sum(b) over (partition by path order by ts, event_id rows unbounded preceding) as s from b)
select path, event_id, dist from s where s = 0""")
def closer_prefix(spark, d):
    return traces.take_while_closer(B.trace_points(spark, d), ["path"], ["ts", "event_id"], "dist").select("path", "event_id", "dist")


@query(f"""with {B.TRACE_POINTS} select path, event_id, event_type from v_trace
window w as (partition by path order by ts, event_id) qualify row_number() over w = 1 or event_type is distinct from lag(event_type) over w""")
def dedupe_points(spark, d):
    return traces.drop_repeats(B.trace_points(spark, d), ["path"], ["ts", "event_id"], ["event_type"]).select("path", "event_id", "event_type")


@query(f"""with {B.TRACE_POINTS}, k as (
  select *, row_number() over w as rn from v_trace
  window w as (partition by path order by ts, event_id) qualify row_number() over w = 1 or event_type <> lag(event_type) over w)
select path, string_agg(event_type, '>' order by rn) as nodes from k group by path""")
def squeeze_nodes(spark, d):
    p = B.trace_points(spark, d).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("p"))
    return p.select("path", F.array_join(G.squeeze(F.transform("p", lambda s: s.event_type)), ">").alias("nodes"))


@query(f"""with {B.TRACE_POINTS}, n as (
  select *, row_number() over (partition by path, event_type order by ts, event_id) - 1 as p, count(*) over (partition by path, event_type) as n from v_trace)
select path, event_type, event_id, case when event_type = 'entry' then n - 1 - p else p end as ord,
  (case when event_type = 'entry' then n - 1 - p else p end) = n - 1 and n > 1 as is_end from n""")
def point_order(spark, d):
    got = traces.point_order(B.trace_points(spark, d), ["path", "event_type"], ["ts", "event_id"], F.col("event_type") == "entry")
    return got.select("path", "event_type", "event_id", F.col("ord").cast("bigint").alias("ord"), "is_end")


@query(f"with {B.TRACE_POINTS} select path, event_type, min(dist) as min_dist from v_trace group by path, event_type")
def segment_min_distance(spark, d):
    return traces.least_distances(B.trace_points(spark, d), ["path"], "event_type", "dist")


@query(f"""with {B.TRACE_POINTS}, m as (select path, event_type, min(dist) as d from v_trace group by all),
i as (select path, d from m where event_type = 'inside')
select m.path, coalesce(i.d, -1.0) as inside_min, m.event_type, m.d as min_dist from m left join i using (path)
where m.event_type <> 'inside' and not (coalesce(i.d, -1.0) >= 2.0 and m.d >= 2.0)""")
def event_distance_prune(spark, d):
    return filters.prune_events(B.trace_points(spark, d), 2.0)


@query(f"""with {B.TRACE_POINTS}, a as (select path % 12 + 1 as sc_id, cast(path % 25 as varchar) as md_label, event_type from v_trace where event_type <> 'inside')
select sc_id, count(*) as num_events, count(*) filter (event_type = 'entry') as num_entries, count(*) filter (event_type = 'release') as num_releases,
  count(distinct md_label) as num_md_sims from a group by sc_id""")
def event_counts(spark, d):
    p = B.trace_points(spark, d).where("event_type <> 'inside'")
    return assign.event_counts(p.select((F.col("path") % 12 + 1).alias("sc_id"), (F.col("path") % 25).cast("string").alias("md_label"), "event_type"), ["sc_id"])


@query("select * from (" + SQL["event_counts"] + ") where num_events >= 100 and num_entries >= 40")
def sc_event_having(spark, d):
    return event_counts(spark, d).where(filters.events_pass(filters.define_filters(min_events=100, min_entries=40)))


@query(r"""with w as (
  select path_row, md_traj, concat_ws(':', coalesce(res_name, '?'), string_split(path_id, ':')[2]) as traced, begin_f, inp_f, out_f, end_f from transport_paths)
select path_row, md_traj, traced, 'entry' as event_type, begin_f as frame_b, begin_f + inp_f as frame_e from w where begin_f is not null and inp_f is not null
union all
select path_row, md_traj, traced, 'release', end_f - out_f, end_f from w where end_f is not null and out_f is not null""")
def event_frame_windows(spark, d):
    return traces.event_windows(table(spark, d, "transport_paths"))


@query("select path_row, md_traj, path_id, cast(row_number() over (partition by md_traj order by path_row) as int) as path_no from transport_paths")
def path_numbers(spark, d):
    return traces.numbered_paths(table(spark, d, "transport_paths"), "md_traj", "path_row").select("path_row", "md_traj", "path_id", "path_no")


@query("""select path_row, t.md_traj, sim_group as grp from transport_paths t left join (select md_traj, sim_group from simulations where sim_group is not null) using (md_traj)""")
def group_membership(spark, d):
    groups = table(spark, d, "simulations").select("md_traj", F.col("sim_group").alias("grp")).where("grp is not null")
    return assign.with_groups(table(spark, d, "transport_paths"), groups, "md_traj").select("path_row", "md_traj", "grp")


@query("""select 'overall' as label union all select distinct sim_group from simulations where sim_group is not null
union all select md_traj from simulations where sim_group is null""")
def scope_labels(spark, d):
    sims = table(spark, d, "simulations")
    return assign.scope_labels(sims, sims.select("md_traj", F.col("sim_group").alias("grp")).where("grp is not null"), "md_traj")


@query("""select md_traj, round(avg(origin_x), 6) as origin_x, round(avg(origin_y), 6) as origin_y, round(avg(origin_z), 6) as origin_z
from starting_points group by md_traj""")
def starting_points(spark, d):
    axes = ["origin_x", "origin_y", "origin_z"]
    return rounded(assign.mean_start(table(spark, d, "starting_points"), "md_traj", axes)[0], axes)


@query("""with m as (select md_traj, avg(origin_x) as x, avg(origin_y) as y, avg(origin_z) as z from starting_points group by md_traj)
select round(avg(x), 6) as origin_x, round(avg(y), 6) as origin_y, round(avg(z), 6) as origin_z from m""")
def global_starting_point(spark, d):
    axes = ["origin_x", "origin_y", "origin_z"]
    return rounded(assign.mean_start(table(spark, d, "starting_points"), "md_traj", axes)[1], axes)


TUNNEL_KEY_SQL = r"select md_traj, cast(regexp_extract(snapshot, '([0-9]+)[^0-9]*\.pdb', 1) as int) as snapshot_no, tunnel_cluster, tunnel"


@query(f"""with p as ({TUNNEL_KEY_SQL} from tunnel_profiles), b as ({TUNNEL_KEY_SQL}, row_id from bottlenecks)
select p.md_traj, p.snapshot_no, p.tunnel_cluster, p.tunnel from (select distinct * from p) p
where not exists (select 1 from b where b.md_traj = p.md_traj and b.snapshot_no = p.snapshot_no and b.tunnel_cluster = p.tunnel_cluster and b.tunnel = p.tunnel)""")
def orphan_bottlenecks(spark, d):
    """Tunnels of the profiles that have no bottleneck row."""
    keys = ["md_traj", "snapshot_no", "tunnel_cluster", "tunnel"]
    p, b = (table(spark, d, t).withColumn("snapshot_no", snapshot_number(F.col("snapshot"))).select(*keys) for t in ("tunnel_profiles", "bottlenecks"))
    return assign.orphans(p.distinct(), b, keys)


@query(r"select row_id, cast(regexp_extract(snapshot, '([0-9]+)[^0-9]*\.pdb', 1) as int) as snapshot_no from bottlenecks")
def snapshot_ids(spark, d):
    return table(spark, d, "bottlenecks").select("row_id", snapshot_number(F.col("snapshot")).alias("snapshot_no"))


@query("select md_traj, n_snapshots, n_snapshots = max(n_snapshots) over () as agrees from simulations")
def frame_agreement(spark, d):
    """Whether each simulation has as many snapshots as the longest; a run needs one number for all."""
    sims = table(spark, d, "simulations")
    return sims.select("md_traj", "n_snapshots", (F.col("n_snapshots") == sims.agg(F.max("n_snapshots")).scalar()).alias("agrees"))


@query("""select count(distinct md_traj) as num_md_sims, count(distinct tunnel_cluster) filter (tunnel_cluster > 0) as num_clusters, count(*) as num_rows from bottlenecks""")
def distinct_md(spark, d):
    own = F.count_distinct(F.when(F.col("tunnel_cluster") > 0, F.col("tunnel_cluster")))
    return table(spark, d, "bottlenecks").agg(F.count_distinct("md_traj").alias("num_md_sims"), own.alias("num_clusters"), F.count(F.lit(1)).alias("num_rows"))


SPHERES_SQL = r"""
lines as (
  select md_traj, cast(regexp_extract(snapshot, '([0-9]+)[^0-9]*\.pdb', 1) as int) as frame, tunnel_cluster, tunnel,
         regexp_replace(lower(axis), '^[\s[:punct:]]+|[\s[:punct:]]+$', '', 'g') as a, axis_values, loaded_at, line_id
  from tunnel_profiles where md_traj is not null and tunnel_cluster > 0),
last_ as (
  select * from lines qualify row_number() over (partition by md_traj, frame, tunnel_cluster, tunnel, a order by loaded_at desc, line_id desc) = 1),
cells as (
  select md_traj, frame, tunnel_cluster, tunnel, a, unnest(string_split(coalesce(axis_values, ''), ',')) as v,
         generate_subscripts(string_split(coalesce(axis_values, ''), ','), 1) as i from last_ where a in ('x', 'y', 'z', 'r')),
spheres as (
  select *, cast(greatest(0, ceil(ceil(sqrt(x * x + y * y + z * z)) / 1.5) - 1) as int) as layer from (
    select md_traj, frame, tunnel_cluster, tunnel, i, max(n) filter (a = 'x') as x, max(n) filter (a = 'y') as y, max(n) filter (a = 'z') as z, max(n) filter (a = 'r') as r
    from (select * exclude (v), try_cast(trim(v) as double) as n from cells) where isfinite(n) group by all)
  where x is not null and y is not null and z is not null and r is not null),
shapes as (select md_traj, frame, tunnel_cluster, tunnel, list(distinct layer) as ls, max(layer) as last from spheres group by all)"""

MATCH_SQL = f"""with e as ({SQL["event_frame_windows"]}), n as (
  select path_row, event_type, md_traj, unnest(range(frame_b, frame_e + 1)) as frame from e where frame_b <= frame_e),
starts as (select md_traj, avg(origin_x) as x, avg(origin_y) as y, avg(origin_z) as z from starting_points group by md_traj),
ligand as (
  select *, cast(greatest(0, ceil(ceil(sqrt(x * x + y * y + z * z)) / 1.5) - 1) as int) as q from (
    select p.md_traj, model_no as frame, origin_x - x as x, origin_y - y as y, origin_z - z as z from starting_points p join starts using (md_traj))),
{SPHERES_SQL},
tunnels as (
  select md_traj, frame, tunnel_cluster, tunnel, q, ls, last, l.x, l.y, l.z, list_max(list_filter(ls, lambda v: v < q)) as below, list_min(list_filter(ls, lambda v: v > q)) as above
  from ligand l join shapes using (md_traj, frame)),
touch as (
  select md_traj, frame, tunnel_cluster, tunnel, sqrt((t.x - s.x) ** 2 + (t.y - s.y) ** 2 + (t.z - s.z) ** 2) - s.r as d
  from tunnels t join spheres s using (md_traj, frame, tunnel_cluster, tunnel)
  where case when q > last then s.layer >= last - 1 when list_contains(ls, q) then abs(s.layer - q) <= 1
        else coalesce(s.layer between below - 1 and below, false) or coalesce(s.layer between above and above + 1, false) end),
best_ as (select md_traj, frame, tunnel_cluster, tunnel, round(min(d), 6) as dist from touch group by all),
first_ as (select * from best_ qualify row_number() over (partition by md_traj, frame order by dist, tunnel_cluster desc, tunnel) = 1),
near as (select path_row, event_type, frame, dist, tunnel_cluster, tunnel from n join first_ using (md_traj, frame))"""


def tunnel_spheres(spark, d):
    """The spheres of the tunnel profiles as an array for each tunnel: md_traj, frame, tunnel_cluster, tunnel, spheres."""
    from poregrid import queries as core

    w = core._wide_profiles(spark, d, [a for a in core._catalog(spark, d) if a.required]).where(F.col("md_traj").isNotNull() & (F.col("tunnel_cluster") > 0))
    zipped = F.arrays_zip("sphere_x", "sphere_y", "sphere_z", "sphere_r")
    spheres = F.transform(zipped, lambda s: F.struct(*[s[f"sphere_{c}"].alias(c) for c in "xyzr"]))
    return w.select("md_traj", F.col("snapshot_no").alias("frame"), "tunnel_cluster", "tunnel", spheres.alias("spheres"))


def ligand_points(spark, d):
    """The ligand in each frame, seen from the mean starting point of its simulation: md_traj, frame, atom, x, y, z."""
    points = table(spark, d, "starting_points")
    mean = assign.mean_start(points, "md_traj", ["origin_x", "origin_y", "origin_z"])[0].toDF("md_traj", "mx", "my", "mz")
    placed = [(F.col(f"origin_{c}") - F.col(f"m{c}")).alias(c) for c in "xyz"]
    return points.join(mean, "md_traj").select("md_traj", F.col("model_no").alias("frame"), F.lit(0).alias("atom"), *placed)


def _nearest(spark, d):
    # A frame's ligand is the same for all its events here, so its nearest tunnel is found before events multiply the frames.
    return matching.matches(ligand_points(spark, d), tunnel_spheres(spark, d), [], ["md_traj", "frame"], places=6)


@query(MATCH_SQL + " select path_row, event_type, cast(frame as int) as frame, dist, tunnel_cluster, tunnel from near")
def frame_nearest(spark, d):
    """Event frames joined to the tunnels of the same frame; the nearest sphere to the ligand, of equal ones the last cluster's."""
    near = matching.in_windows(_nearest(spark, d), event_frame_windows(spark, d), ["md_traj"])
    return near.select("path_row", "event_type", "frame", "dist", "tunnel_cluster", "tunnel")


@query(MATCH_SQL + """, f as (select path_row, event_type, count(*) as n_frames from n group by all),
h as (select path_row, event_type, count(*) filter (dist <= 0.0) as hits, count(*) as k from near group by all)
select f.path_row, f.event_type, round(coalesce(hits / n_frames, 0.0), 6) as of_frames, round(hits / k, 6) as of_tunnel_frames
from f left join h using (path_row, event_type)""")
def exact_match_fraction(spark, d):
    got = matching.window_fractions(_nearest(spark, d), event_frame_windows(spark, d), ["path_row", "event_type"], ["md_traj"], 0.0)
    return rounded(got, ["of_frames", "of_tunnel_frames"])


SEGMENTS_SQL = f"""with {B.TRACE_PLACES}, u as (
  select * from v_places window w as (partition by path order by ord)
  qualify row_number() over w = 1 or not (x = lag(x) over w and y = lag(y) over w and z = lag(z) over w)),
ch as (select *, case when event_type = lag(event_type) over (partition by path order by ord) then 0 else 1 end as c from u),
ru as (select *, sum(c) over (partition by path order by ord rows unbounded preceding) as run_no from ch),
fr as (select path, event_type, ord, x, y, z, sqrt(x * x + y * y + z * z) as dist from ru qualify run_no = min(run_no) over (partition by path, event_type)),
le as (select *, coalesce(min(dist) filter (event_type = 'inside') over (partition by path), -1.0) as i, min(dist) over (partition by path, event_type) as m from fr),
se as (select path, event_type, ord, x, y, z, dist from le where not (event_type <> 'inside' and i >= 6.0 and m >= 6.0) 
  qualify max(cast(event_type <> 'inside' as int)) over (partition by path) = 1)"""
EXTENDED_SQL = SEGMENTS_SQL + """, seed as (select path, event_type, min(dist) as seed from se where event_type <> 'inside' group by all),
ins as (select se.path, seed.event_type, ord, x, y, z, dist, seed, case when seed.event_type = 'entry' then ord else -ord end as p from se join seed on seed.path = se.path where se.event_type = 'inside'),
br as (select *, cast(dist > least(seed, coalesce(min(dist) over (partition by path, event_type order by p rows between unbounded preceding and 1 preceding), seed)) as int) as b from ins),
cl as (select *, sum(b) over (partition by path, event_type order by p rows unbounded preceding) as s from br),
ex as (select path, event_type, 0 as phase, ord, x, y, z, dist from se where event_type <> 'inside'
  union all select path, event_type, case when event_type = 'entry' then 1 else -1 end, ord, x, y, z, dist from cl where s = 0)"""
POINTS_SQL = EXTENDED_SQL + """, num as (
  select *, row_number() over (partition by path, event_type order by phase, ord) - 1 as p, count(*) over (partition by path, event_type) as n from ex),
pts as (select path, event_type, cast(case when event_type = 'entry' then n - 1 - p else p end as int) as ord, x, y, z, dist,
  (case when event_type = 'entry' then n - 1 - p else p end) = n - 1 as is_end from num where n > 1)"""
SPOT = ["x", "y", "z", "dist"]


@query(SEGMENTS_SQL + " select path, event_type, ord, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(dist, 6) as dist from se")
def event_segments(spark, d):
    """Inside, entry and release parts of the traces that come near enough."""
    return rounded(events.segments(B.trace_places(spark, d), ["path"]), SPOT)


@query(EXTENDED_SQL + " select path, event_type, phase, ord, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(dist, 6) as dist from ex")
def event_extension(spark, d):
    """Entries and releases with the inside points that lead on to the origin."""
    return rounded(events.extended(events.segments(B.trace_places(spark, d), ["path"]), ["path"]), SPOT)


@query(POINTS_SQL + " select path, event_type, ord, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, round(dist, 6) as dist, is_end from pts")
def event_points(spark, d):
    """The points of each event in order from its inner end, events of one point left out; without the search for a way."""
    return rounded(events.extract(B.trace_places(spark, d), ["path"], search=False), SPOT)


@query()
def astar_extension(spark, d):
    """The same with the overlapping way from the inner end to the origin."""
    return rounded(events.extract(B.trace_places(spark, d), ["path"]), SPOT)


@query(POINTS_SQL + """, la as (select *, cast(greatest(0, ceil(ceil(dist) / 1.5) - 1) as int) as layer from pts)
select path, event_type, layer || '_' || case when is_end then '2' else '1' end as node, layer, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z,
  1.0 as radius, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) as rmsf, is_end from la group by path, event_type, layer, is_end""")
def event_layers(spark, d):
    """One node for each layer of an event and one for its end."""
    points = events.extract(B.trace_places(spark, d), ["path"], search=False)
    return rounded(events.layer_figures(events.in_layers(points), ["path", "event_type"]), ["x", "y", "z", "rmsf"])


CONTAINED_SQL = f"""with {B.NODES}, first_ as (select * from v_nodes where is_end qualify row_number() over (partition by entity order by node) = 1),
ways as (select entity as sc_id, avg(x) as x, avg(y) as y, avg(z) as z from v_nodes where is_end group by entity),
pairs as (
  select n.entity as event, e.sc_id from first_ n join ways e on
    atan2(sqrt((n.y * e.z - n.z * e.y) ** 2 + (n.z * e.x - n.x * e.z) ** 2 + (n.x * e.y - n.y * e.x) ** 2), n.x * e.x + n.y * e.y + n.z * e.z) <= 1.5707963267948966),
lim as (select entity, min(layer) filter (is_end) as first_end, max(layer) as last_layer from v_nodes group by entity),
met as (
  select p.event, p.sc_id, q.node as q_node, t.node as t_node,
         round(greatest(sqrt((q.x - t.x) ** 2 + (q.y - t.y) ** 2 + (q.z - t.z) ** 2) - (q.radius + t.radius) - least((q.rmsf + t.rmsf) / 2, 3.0), 0.0), 6) as dist,
         case when abs(q.layer - t.layer) <= 1 or coalesce(t.layer >= a.first_end, false) or (q.layer = a.last_layer and t.layer > q.layer) or (q.layer > b.last_layer and t.layer >= b.last_layer - 1) then 0
              when coalesce(q.layer >= b.first_end, false) or (t.layer = b.last_layer and q.layer > t.layer) or (t.layer > a.last_layer and q.layer >= a.last_layer - 1) then 1 else 2 end as r
  from pairs p join v_nodes q on q.entity = p.event join v_nodes t on t.entity = p.sc_id join lim a on a.entity = p.event join lim b on b.entity = p.sc_id),
near as (select * from met qualify row_number() over (partition by event, sc_id, q_node order by r, dist, t_node) = 1),
con as (
  select event, near.sc_id, round(avg(case when dist = 0 then 1.0 else 0.0 end), 6) as buriedness, round(max(1 / (layer + 1)), 6) as depth
  from near join v_nodes t on t.entity = near.sc_id and t.node = t_node group by event, near.sc_id)"""


def _contained(spark, d):
    n = B.nodes(spark, d)
    query_set, target = n.withColumnRenamed("entity", "event"), n.withColumnRenamed("entity", "sc_id")
    ways = n.where("is_end").groupBy(F.col("entity").alias("sc_id")).agg(*[F.avg(c).alias(c) for c in "xyz"])
    pairs = assign.by_direction(events.directions(query_set, ["event"]), ways, 1.5707963267948966)
    dist = G.relaxed_distance(_xyz("q"), _xyz("t"), *[F.col(c) for c in ("q_radius", "t_radius", "q_rmsf", "t_rmsf")])
    near = events.nearest_nodes(query_set, target, pairs, ["event"], "sc_id", dist, 6)
    depths = n.select(F.col("entity").alias("sc_id"), "node", (1 / (F.col("layer") + 1)).alias("depth"))
    return rounded(events.containment(near, depths, ["event"], "sc_id"), ["buriedness", "depth"])


@query(CONTAINED_SQL + " select * from con")
def event_containment(spark, d):
    """Buriedness and depth of each event in each supercluster that lies in its direction."""
    return _contained(spark, d)


ASSIGN_SQL = CONTAINED_SQL + """, b as (select *, max(buriedness) over (partition by event) as best from con),
k as (select * from b where best >= 0.3 and buriedness >= best - 0.05), w as (select * from k qualify depth = max(depth) over (partition by event))
select e.event, w.sc_id, w.buriedness, w.depth from (select distinct event from con) e left join w on w.event = e.event"""


@query(ASSIGN_SQL)
def event_assignment(spark, d):
    """The superclusters through which each event went, by containment."""
    return assign.assign_events(_contained(spark, d), ["event"], cutoff=0.3)


@query("""select md_traj, row_id from bottlenecks
qualify row_number() over (partition by md_traj order by md5(cast(row_id as varchar) || ':4'), row_id) <= 20""")
def seeded_sample(spark, d):
    """At most 20 bottlenecks of each simulation, chosen by a seeded hash."""
    rows = table(spark, d, "bottlenecks").select("md_traj", "row_id")
    return assign.seeded_sample(rows, ["md_traj"], ["row_id"], 20, 4)


def tunnel_points(spark, d):
    """Spheres of the tunnel profiles as points: entity (simulation, cluster), path (tunnel), place along it."""
    from poregrid import queries as core

    w = core._wide_profiles(spark, d, [a for a in core._catalog(spark, d) if a.required])
    arrays = {"x": "sphere_x", "y": "sphere_y", "z": "sphere_z", "dist": "sphere_distance", "radius": "sphere_r"}
    whole = w.where(F.col("tunnel_cluster") > 0).withColumn("path", F.concat_ws("-", "snapshot_no", "tunnel"))
    # Spheres that lack a number go first; the last one that remains is the end of its tunnel.
    complete = F.filter(F.arrays_zip(*arrays.values()), lambda s: reduce(lambda a, b: a & b, [s[v].isNotNull() & ~F.isnan(s[v]) for v in arrays.values()]))
    kept = whole.select("md_traj", "tunnel_cluster", "path", complete.alias("spheres"))
    zipped = kept.select("md_traj", "tunnel_cluster", "path", F.posexplode("spheres").alias("ord", "s"), F.size("spheres").alias("n"))
    return zipped.select("md_traj", "tunnel_cluster", "path", "ord", *[F.col(f"s.{v}").alias(k) for k, v in arrays.items()], ((F.col("ord") == F.col("n") - 1) & (F.col("n") > 1)).alias("is_end"))


@query()
def layering_nodes(spark, d):
    """Nodes of the layered description of each tunnel cluster."""
    from poregrid.session import materialize

    assigned = materialize(layering.assign_nodes(tunnel_points(spark, d), ["md_traj", "tunnel_cluster"]), "assigned")
    return layering.nodes_of(assigned, ["md_traj", "tunnel_cluster"])


@query()
def set_cover_paths(spark, d):
    """Few node paths that cover the layered description of each tunnel cluster."""
    from poregrid.session import materialize

    assigned = materialize(layering.assign_nodes(tunnel_points(spark, d), ["md_traj", "tunnel_cluster"]), "assigned")
    return layering.paths_of(assigned, ["md_traj", "tunnel_cluster"])


@query()
def linkage_superclusters(spark, d):
    """Superclusters of the path sets: layering, distances block against block, linkage, flat cut."""
    from poregrid.plans.pipeline import superclusters_of

    return superclusters_of(tunnel_points(spark, d))[0]


@query()
def pathset_distance(spark, d):
    """Distances of all pairs of path sets."""
    from poregrid.plans.pipeline import distances_of

    return distances_of(tunnel_points(spark, d))


def queries() -> dict[str, Query]:
    from poregrid import detail_queries  # noqa: F401  (adds its queries here)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from poregrid import detail_queries  # noqa: F401
    from poregrid.queries import P5_FOUND

    p5 = f"with p5 as ({P5_FOUND}), bn as (select * from bottlenecks where md_traj is not null and tunnel_cluster > 0),"
    return {k: v.replace("P5:", p5) if v.startswith("P5:") else v for k, v in SQL.items()}
