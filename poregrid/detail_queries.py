"""Further queries of single operators over the test tables, and their SQL; they join those of ``domain_queries``."""

from __future__ import annotations

from pyspark.sql import functions as F

from poregrid import bindings as B
from poregrid.domain_queries import (
    FIGURES, FIGURES_SQL, MATCH_SQL, PAIRS_SQL, SIZES, SPHERES_SQL, TUNNEL_KEY_SQL, _residues_of, best, group_sizes, ligand_points, query, rounded, total_sims, tunnel_spheres,
)
from poregrid.functions import geometry as G
from poregrid.functions.domain import snapshot_number
from poregrid.operators import assign, filters, matching, nodes, profiles, transforms
from poregrid.session import table
from poregrid.sinks import reports

LAYER_SQL = "cast(greatest(0, ceil(ceil(sqrt(x * x + y * y + z * z)) / 1.5) - 1) as int)"


@query(f"""with {B.BEST} {SIZES}
select 'overall' as scope, sc_id, 'overall' as label, {FIGURES_SQL}, round(count(*) / 25, 6) as avg_snaps, round(avg(throughput) * (count(*) / 250) * (count(distinct md_label) / 25), 4) as priority from best group by sc_id
union all
select 'group', sc_id, best.grp, {FIGURES_SQL}, round(count(*) / any_value(group_size), 6), round(avg(throughput) * (count(*) / 250) * (count(distinct md_label) / any_value(group_size)), 4)
  from best join sizes on sizes.grp = best.grp where best.grp <> 'ASIA' group by sc_id, best.grp
union all
select 'md', sc_id, md_label, {FIGURES_SQL}, round(count(*) * 1.0, 6), round(avg(throughput) * (count(*) / 250), 4) from best where grp = 'ASIA' group by sc_id, md_label""")
def sc_properties_scopes(spark, d):
    """Figures overall, of the groups, and of the simulations in none (those of ASIA here)."""
    sizes = group_sizes(spark, d).where("grp <> 'ASIA'")
    return rounded(profiles.all_scopes(best(spark, d), B.SNAPSHOTS, total_sims(spark, d), sizes), FIGURES)


@query("P5:" + """ sims as (select md_traj, sim_group as grp from simulations),
r as (select p.residue, b.tunnel_cluster, b.md_traj, s.grp from p5 p join bn b using (row_id) left join sims s on s.md_traj = b.md_traj),
b as (select bn.*, s.grp from bn left join sims s on s.md_traj = bn.md_traj),
h as (select 'overall' as scope, 'overall' as label, tunnel_cluster, residue, count(*) as n from r group by all
  union all select 'group', grp, tunnel_cluster, residue, count(*) from r where grp is not null group by all
  union all select 'md', md_traj, tunnel_cluster, residue, count(*) from r where grp is null group by all),
t as (select 'overall' as scope, 'overall' as label, tunnel_cluster, count(*) as total from b group by all
  union all select 'group', grp, tunnel_cluster, count(*) from b where grp is not null group by all
  union all select 'md', md_traj, tunnel_cluster, count(*) from b where grp is null group by all)
select scope, label, tunnel_cluster, residue, round(n / total, 6) as freq from h join t using (scope, label, tunnel_cluster)""")
def residue_frequency_scopes(spark, d):
    """Residue frequencies overall, of groups, and of simulations in no group."""
    groups = table(spark, d, "simulations").select("md_traj", F.col("sim_group").alias("grp")).where("grp is not null")
    residues, rows = _residues_of(spark, d, ("tunnel_cluster", "md_traj"))
    got = profiles.residue_scopes(assign.with_groups(residues, groups, "md_traj"), assign.with_groups(rows, groups, "md_traj"), "tunnel_cluster", "md_traj", "grp")
    return rounded(got, ["freq"])


@query(f"""with {B.BEST} select sc_id, string_agg(cast(cast(round(length) as int) as varchar), ',' order by md_label, snapshot_id) as lengths from best
where round(bottleneck_radius, 6) >= 1.6 group by sc_id""")
def property_vectors(spark, d):
    kept = filters.sub_cluster(best(spark, d), filters.define_filters(min_radius=1.6))
    got = profiles.property_vector(kept.withColumn("l", F.round("length").cast("int").cast("string")), "l")
    return got.select("sc_id", F.array_join("values", ",").alias("lengths"))


@query(f"""with {B.TUNNELS} select md_label, cluster_id, snapshot_id, tunnel_id, length, throughput from v_tunnels
where snapshot_id in (1, 5, 77) and round(bottleneck_radius, 6) >= 1.0 and round(curvature, 4) >= 1.2 and round(length, 6) <= 45""")
def sub_clusters(spark, d):
    """Tunnels of three snapshots that pass filters."""
    wanted = filters.define_filters(min_radius=1.0, min_curvature=1.2, max_length=45)
    return filters.sub_cluster(B.tunnels(spark, d), wanted, [1, 5, 77]).select("md_label", "cluster_id", "snapshot_id", "tunnel_id", "length", "throughput")


@query(f"with {B.NODES} select node, layer, cast(layer as varchar) || '_' || entity as label, layer as part_layer, entity as part_cluster, -99 as start_layer, -99 as start_cluster from v_nodes")
def node_label_parts(spark, d):
    """Labels made of layer and cluster, and read again; the start node's has no parts."""
    made = B.nodes(spark, d).select("node", "layer", G.node_label(F.col("layer"), F.col("entity")).alias("label"))
    own, start = G.label_parts(F.col("label")), G.label_parts(F.lit(G.START_LABEL))
    return made.select("*", own[0].alias("part_layer"), own[1].alias("part_cluster"), start[0].alias("start_layer"), start[1].alias("start_cluster"))


@query(f"with {B.NODES} select node, case when entity = 3 then 'merged-' || node else 'md1-' || entity || '-' || node end as label from v_nodes")
def extended_labels(spark, d):
    n = B.nodes(spark, d).withColumn("short", F.when(F.col("entity") == 3, F.concat(F.lit("merged-"), "node")).otherwise(F.col("node")))
    return n.select("node", G.extended_label(F.lit("md1"), F.col("entity"), F.col("short")).alias("label"))


@query(f"""with {B.NODES}, m as (select entity, layer, avg(x) as mx, avg(y) as my, avg(z) as mz from v_nodes group by all),
w as (select n.entity, n.layer, sqrt((x - mx) ** 2 + (y - my) ** 2 + (z - mz) ** 2) as d, radius, is_end from v_nodes n join m using (entity, layer)),
f as (select entity, layer, round(min(d), 6) as min_dist, round(max(d), 6) as max_dist, round(sqrt(avg(d * d)), 6) as rmsf, max(radius) as radius, bool_or(is_end) as is_end from w group by all)
select entity, layer, min_dist, max_dist, rmsf,
  min_dist <= 1 and max_dist <= case when is_end then greatest(2 * rmsf, radius, 1.5) else greatest(3 * rmsf, 2 * radius, 3.0) end as stands_well from f""")
def node_representative(spark, d):
    """Whether the mean of each layer's nodes stands well for them."""
    n = B.nodes(spark, d)
    own = rounded(nodes.distances_to_mean(n, ["entity", "layer"]), ["min_dist", "max_dist", "rmsf"])
    more = n.groupBy("entity", "layer").agg(F.max("radius").alias("radius"), F.bool_or("is_end").alias("is_end"))
    ok = nodes.representative(*[F.col(c) for c in ("min_dist", "max_dist", "rmsf", "radius", "is_end")], 1.5)
    return own.join(more, ["entity", "layer"]).select("entity", "layer", "min_dist", "max_dist", "rmsf", ok.alias("stands_well"))


@query(f"""with {B.NODES}, s as (select entity, case when layer = 0 then -1 else layer end as label, count(*) as n from v_nodes group by all)
select entity, label, n, cast(case when label = -1 then -1 else row_number() over (partition by entity, label = -1 order by n desc, label desc) end as int) as new_label from s""")
def size_order(spark, d):
    """Clusters renumbered by size; noise keeps its label."""
    n = B.nodes(spark, d).withColumn("label", F.when(F.col("layer") == 0, -1).otherwise(F.col("layer")))
    return nodes.size_order(n, ["entity"], "label").select("entity", "label", "n", F.col("new_label").cast("int").alias("new_label"))


PATHS_SQL = f"""with {B.TRACE_POINTS}, p as (select path % 10 as entity, path as path_id, min(event_id % 7) as first_layer, count(*) as n from v_trace group by path)"""


@query(PATHS_SQL + " select entity, path_id, n from p qualify row_number() over (partition by entity order by first_layer, n, path_id) = 1")
def best_path(spark, d):
    """Of each entity's paths the one starting lowest, then the shortest, then the first."""
    p = B.trace_points(spark, d).groupBy("path").agg(F.min(F.col("event_id") % 7).alias("first_layer"), F.collect_list("event_id").alias("nodes"))
    p = p.select((F.col("path") % 10).alias("entity"), F.col("path").alias("path_id"), "first_layer", "nodes")
    return nodes.best_path(p, ["entity"]).select("entity", "path_id", F.size("nodes").cast("bigint").alias("n"))


@query(f"""with {B.TRACE_POINTS}, o as (select path, event_type, row_number() over (partition by path order by ts, event_id) as pos from v_trace)
select path, event_type, max(1 / pos) as depth from o group by all""")
def node_depth(spark, d):
    """The greatest 1 / place of each node on a path."""
    items = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))
    p = B.trace_points(spark, d).groupBy("path").agg(F.transform(items, lambda s: s.event_type).alias("nodes"))
    return nodes.node_depths(p, ["path"]).select("path", F.col("node").alias("event_type"), "depth")


@query(f"""with {B.TRACE_POINTS} select path, event_id, cast(coalesce(sum(cast(event_type = 'release' as int)) over (partition by path order by ts, event_id
  rows between unbounded preceding and 1 preceding), 0) as bigint) as tunnel_no from v_trace""")
def end_point_ids(spark, d):
    """How many ends come before each point of a path."""
    p = B.trace_points(spark, d).withColumn("is_end", F.col("event_type") == "release")
    return nodes.end_ids(p, ["path"], ["ts", "event_id"]).select("path", "event_id", F.col("tunnel_no").cast("bigint").alias("tunnel_no"))


@query(f"""with {B.BOTTLENECK_POINTS}, p as (select *, {LAYER_SQL} as layer from v_bn)
select md_traj, layer, row_id from p qualify row_number() over (partition by md_traj, layer order by md5(cast(row_id as varchar) || ':9'), row_id) <= 5""")
def points_per_node(spark, d):
    """At most five points of each node, chosen by a seeded hash."""
    p = B.bottleneck_points(spark, d).withColumn("layer", G.layer(G.norm([F.col(c) for c in "xyz"]), 1.5)).select("md_traj", "layer", "row_id")
    return assign.seeded_sample(p, ["md_traj", "layer"], ["row_id"], 5, 9)


@query(f"""with {B.BOTTLENECK_POINTS}, p as (select *, {LAYER_SQL} // 2 as node from v_bn)
select md_traj, cast(node as varchar) as node, round(avg(x), 6) as x, round(avg(y), 6) as y, round(avg(z), 6) as z, round(sqrt(var_pop(x) + var_pop(y) + var_pop(z)), 6) as rmsf,
  round(quantile_cont(radius, 0.9), 6) as radius, count(*) filter (tunnel > 5) as num_end_points, bool_or(tunnel = 1) as has_start, count(*) as n_points from p group by md_traj, node""")
def pooled_nodes(spark, d):
    """Figures of nodes pooled from the points of two neighbouring layers."""
    p = B.bottleneck_points(spark, d).withColumn("layer", G.layer(G.norm([F.col(c) for c in "xyz"]), 1.5))
    p = p.select("md_traj", F.col("layer").cast("string").alias("node"), "x", "y", "z", "radius", (F.col("tunnel") > 5).alias("is_end"), (F.col("tunnel") == 1).alias("is_start"))
    merged = p.select("md_traj", "node").distinct().withColumn("pooled", F.floor(F.col("node").cast("int") / 2).cast("string"))
    return rounded(nodes.pool_nodes(p, merged, ["md_traj"]), ["x", "y", "z", "rmsf", "radius"])


@query(f"""with {SPHERES_SQL.strip()} select md_traj, tunnel_cluster, count(*) as n_spheres from (select distinct md_traj, tunnel_cluster, x, y, z, r from spheres) group by all""")
def distinct_sphere_counts(spark, d):
    """How many different spheres the tunnels of a cluster have."""
    s = tunnel_spheres(spark, d).select("md_traj", "tunnel_cluster", F.explode("spheres").alias("s")).select("md_traj", "tunnel_cluster", "s.*")
    for c in "xyzr":
        s = s.where(F.col(c).isNotNull() & ~F.isnan(c))
    return nodes.distinct_spheres(s, ["md_traj", "tunnel_cluster", "x", "y", "z", "r"]).groupBy("md_traj", "tunnel_cluster").agg(F.count(F.lit(1)).alias("n_spheres"))


@query(f"""with {SPHERES_SQL.strip()} select md_traj, frame, tunnel_cluster, tunnel, count(*) as n_spheres, round(sum(sqrt(x * x + y * y + z * z)), 6) as total_dist from spheres group by all""")
def sphere_distance_reset(spark, d):
    """Distances of the spheres from the origin in place of those given, summed for each tunnel."""
    t = tunnel_spheres(spark, d)
    whole = F.filter("spheres", lambda s: s.x.isNotNull() & s.y.isNotNull() & s.z.isNotNull() & s.r.isNotNull() & ~F.isnan(s.x) & ~F.isnan(s.y) & ~F.isnan(s.z) & ~F.isnan(s.r))
    t = t.withColumn("spheres", G.sphere_distances(F.transform(whole, lambda s: s.withField("dist", F.lit(0.0))))).where(F.size("spheres") > 0)
    total = F.aggregate("spheres", F.lit(0.0), lambda acc, s: acc + s.dist)
    return rounded(t.select("md_traj", "frame", "tunnel_cluster", "tunnel", F.size("spheres").cast("bigint").alias("n_spheres"), total.alias("total_dist")), ["total_dist"])


@query(f"""with p as ({TUNNEL_KEY_SQL} from tunnel_profiles), b as ({TUNNEL_KEY_SQL}, row_id from bottlenecks)
select b.row_id from b where not exists (select 1 from p where b.md_traj = p.md_traj and b.snapshot_no = p.snapshot_no and b.tunnel_cluster = p.tunnel_cluster and b.tunnel = p.tunnel)""")
def bottlenecks_without_tunnel(spark, d):
    """Bottlenecks whose tunnel is not among the profiles."""
    keys = ["md_traj", "snapshot_no", "tunnel_cluster", "tunnel"]
    p, b = (table(spark, d, t).withColumn("snapshot_no", snapshot_number(F.col("snapshot"))) for t in ("tunnel_profiles", "bottlenecks"))
    return assign.orphans(b, p, keys).select("row_id")


RANKED_SQL = """ranks as (
  select md_traj, tunnel_cluster, row_number() over (partition by md_traj order by sum(throughput) desc, tunnel_cluster) as new_id from bottlenecks
  where md_traj is not null and tunnel_cluster > 0 and throughput between 0 and 1 and not isnan(throughput) group by md_traj, tunnel_cluster),
tunnels as (select distinct md_traj, snapshot, tunnel_cluster, tunnel from tunnel_profiles)"""


def _ranked(spark, d):
    rows = table(spark, d, "bottlenecks").where(F.col("md_traj").isNotNull() & (F.col("tunnel_cluster") > 0))
    named = rows.select("row_id", F.col("md_traj").alias("md_label"), "snapshot", F.col("tunnel_cluster").alias("cluster_id"), F.col("tunnel").alias("tunnel_id"), "throughput")
    good = named.where(F.col("throughput").between(0, 1) & ~F.isnan("throughput"))
    tunnels = table(spark, d, "tunnel_profiles").select(F.col("md_traj").alias("md_label"), "snapshot", F.col("tunnel_cluster").alias("cluster_id"), F.col("tunnel").alias("tunnel_id"))
    return reports.renumbered_bottlenecks(named, tunnels, profiles.frame_rank(good, 1))


@query(f"with {RANKED_SQL} select b.row_id, b.md_traj as md_label, cast(new_id as int) as cluster_id from bottlenecks b join tunnels using (md_traj, snapshot, tunnel_cluster, tunnel) join ranks using (md_traj, tunnel_cluster)")
def renumbered_bottlenecks(spark, d):
    """Bottlenecks of exported tunnels under the new numbers of their clusters."""
    return _ranked(spark, d)[0].select("row_id", "md_label", "cluster_id")


@query(f"""with {RANKED_SQL} select t.md_traj as md_label, t.snapshot, t.tunnel_cluster as cluster_id, t.tunnel as tunnel_id from tunnels t join ranks using (md_traj, tunnel_cluster)
where not exists (select 1 from bottlenecks b where b.md_traj = t.md_traj and b.snapshot = t.snapshot and b.tunnel_cluster = t.tunnel_cluster and b.tunnel = t.tunnel)""")
def unmatched_tunnels(spark, d):
    """Exported tunnels that have no bottleneck."""
    return _ranked(spark, d)[1].select("md_label", "snapshot", "cluster_id", "tunnel_id")


@query("""with s as (select md_traj, avg(origin_x) as sx, avg(origin_y) as sy, avg(origin_z) as sz from starting_points group by md_traj)
select p.md_traj, model_no, round(-(origin_y - sy), 6) as x, round(origin_x - sx, 6) as y, round(origin_z - sz, 6) as z,
  round(origin_x, 6) as back_x, round(origin_y, 6) as back_y, round(origin_z, 6) as back_z from starting_points p join s using (md_traj)""")
def transformed_points(spark, d):
    """Starting points in the common frame of their simulations, by a transform of each, and back from it."""
    points = table(spark, d, "starting_points").select("md_traj", "model_no", *[F.col(f"origin_{c}").alias(c) for c in "xyz"])
    s = points.groupBy("md_traj").agg(*[F.avg(c).alias(f"s{c}") for c in "xyz"])
    zero, one = F.lit(0.0), F.lit(1.0)
    m = F.array(zero, -one, zero, F.col("sy"), one, zero, zero, -F.col("sx"), zero, zero, one, -F.col("sz"), zero, zero, zero, one)
    inverse = F.array(zero, one, zero, F.col("sx"), -one, zero, zero, F.col("sy"), zero, zero, one, F.col("sz"), zero, zero, zero, one)
    known = s.select("md_traj", m.alias("m"), inverse.alias("m_inv"))
    there = transforms.move(points, known, "md_traj")
    back = transforms.move(there, known, "md_traj", inverse=True).select("md_traj", "model_no", *[F.col(c).alias(f"back_{c}") for c in "xyz"])
    return rounded(there.join(back, ["md_traj", "model_no"]), ["x", "y", "z", "back_x", "back_y", "back_z"])


@query(f"""with {B.NODES}, m as (select *, x + 4.0 as nx, y - 3.0 as ny, z as nz, count(*) over (partition by entity, layer) as n from v_nodes)
select node, entity, layer as old_layer, case when n = 1 then layer else cast(greatest(0, ceil(ceil(sqrt(nx * nx + ny * ny + nz * nz)) / 1.5) - 1) as int) end as layer from m""")
def layer_reassignment(spark, d):
    """Nodes moved to a common origin go to the layer they are then in, unless their own would be empty."""
    n = B.nodes(spark, d)
    shift = spark.createDataFrame([("s", [1.0, 0.0, 0.0, 4.0, 0.0, 1.0, 0.0, -3.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0])], "md_label string, m array<double>")
    got = transforms.apply(n.withColumn("md_label", F.lit("s")).withColumn("old_layer", F.col("layer")), shift, entity=["entity"])
    return got.select("node", "entity", "old_layer", "layer")


@query(f"with {B.TUNNELS}, m as (select distinct md_label, cluster_id, sc_id from v_tunnels) select sc_id, count(distinct md_label) as n_sims, count(*) as n_clusters from m group by sc_id")
def cluster_membership(spark, d):
    """Simulations and clusters of each supercluster."""
    t = B.tunnels(spark, d)
    member = t.select("cluster_id", "sc_id").distinct()
    joined = t.select("md_label", "cluster_id").distinct().join(member, "cluster_id")
    return joined.groupBy("sc_id").agg(F.count_distinct("md_label").alias("n_sims"), F.count(F.lit(1)).alias("n_clusters"))


@query(f"""with {B.TUNNELS}, m as (select distinct md_label, cluster_id, sc_id from v_tunnels),
p as (select sc_id, md_label, count(*) as n, string_agg(cast(cluster_id as varchar), ', ' order by cluster_id) as ids from m group by all)
select sc_id, 'simulations ' || count(*) || ', clusters ' || cast(sum(n) as bigint) || '; ' || string_agg('from ' || md_label || ': ' || ids, '; ' order by md_label) as line from p group by sc_id""")
def cluster_details(spark, d):
    """What belongs to each supercluster, as a line of text."""
    return reports.cluster_details(B.tunnels(spark, d).select("md_label", "cluster_id", "sc_id").distinct())


@query("""select path_row % 5 as sc_id, event_type, md_traj as md_label, count(*) as n_events, string_agg(cast(path_row as varchar), ', ' order by path_row) as line
from (select path_row, md_traj, unnest(['entry', 'release']) as event_type from transport_paths) group by all""")
def event_details(spark, d):
    """The events of each supercluster and simulation, as a line of text."""
    both = table(spark, d, "transport_paths").select((F.col("path_row") % 5).alias("sc_id"), F.col("path_row").alias("path_no"), F.col("md_traj").alias("md_label"), F.explode(F.array(F.lit("entry"), F.lit("release"))).alias("event_type"))
    return reports.event_details(both)


@query(f"""{PAIRS_SQL} select t.entity, t.q_node as node, count(*) as n_near, sum(cast(dist_ok as int)) as n_inside from (
  select entity, q_node, round(greatest(d - (q_radius + t_radius), 0.0), 6) = 0 as dist_ok from pairs) t group by all""")
def node_contacts(spark, d):
    """For each node the number of candidates in other path sets and of those it touches."""
    from poregrid.domain_queries import _pairs, _xyz

    dist = F.round(F.greatest(G.surface_distance(_xyz("q"), _xyz("t"), F.col("q_radius"), F.col("t_radius")), F.lit(0.0)), 6)
    got = _pairs(spark, d).select("entity", F.col("q_node").alias("node"), (dist == 0).cast("int").alias("ok"))
    return got.groupBy("entity", "node").agg(F.count(F.lit(1)).alias("n_near"), F.sum("ok").alias("n_inside"))


@query(f"""with a as (select md_traj, sim_group as grp from simulations), e as (
  select path_row, md_traj, event_type, case when path_row % 4 = 0 then null else path_row % 3 end as sc_id
  from (select path_row, md_traj, unnest(['entry', 'release']) as event_type from transport_paths)),
l as (select e.*, coalesce(grp, e.md_traj) as label from e left join a on a.md_traj = e.md_traj)
select label, sc_id, count(*) as num_events, count(*) filter (event_type = 'entry') as num_entries, count(*) filter (event_type = 'release') as num_releases from l group by all""")
def event_counters(spark, d):
    """Events of each group or simulation by supercluster; those of none count as the label's outliers."""
    groups = table(spark, d, "simulations").select("md_traj", F.col("sim_group").alias("grp")).where("grp is not null")
    e = table(spark, d, "transport_paths").select("path_row", "md_traj", F.explode(F.array(F.lit("entry"), F.lit("release"))).alias("event_type"))
    e = e.withColumn("sc_id", F.when(F.col("path_row") % 4 == 0, None).otherwise(F.col("path_row") % 3))
    labelled = assign.with_groups(e, groups, "md_traj").withColumn("label", F.coalesce("grp", "md_traj")).withColumn("md_label", F.col("md_traj"))
    return assign.event_counts(labelled, ["label", "sc_id"]).drop("num_md_sims")


@query(f"""with {B.BEST}, kept as (select * from best where round(bottleneck_radius, 6) >= 1.5),
v as (select distinct sc_id, md_label, cluster_id from kept), m as (select distinct sc_id, md_label, cluster_id from v_tunnels)
select (select count(distinct sc_id) from kept) as valid_scs, (select count(*) from v) as valid_clusters, (select count(*) from m) as clusters, (select count(*) from kept) as valid_tunnels, (select count(*) from v_tunnels) as tunnels""")
def valid_counts(spark, d):
    """Numbers of superclusters, clusters and tunnels that pass a filter, and of all."""
    t = B.tunnels(spark, d)
    kept = best(spark, d).where(filters.tunnel_passes(filters.define_filters(min_radius=1.5)))
    own = kept.agg(F.count_distinct("sc_id").alias("valid_scs"), F.count_distinct("sc_id", "md_label", "cluster_id").alias("valid_clusters"), F.count(F.lit(1)).alias("valid_tunnels"))
    every = t.agg(F.count_distinct("sc_id", "md_label", "cluster_id").alias("clusters"), F.count(F.lit(1)).alias("tunnels"))
    return own.crossJoin(every).select("valid_scs", "valid_clusters", "clusters", "valid_tunnels", "tunnels")  # one row each


@query("select row_id, try_cast(string_split(snapshot, '.')[3] as int) as snapshot_id from bottlenecks")
def snapshot_by_delimiter(spark, d):
    """Snapshot numbers by delimiter and position; null where there is no number."""
    part = F.get(F.split("snapshot", r"\."), F.lit(2))
    return table(spark, d, "bottlenecks").select("row_id", part.try_cast("int").alias("snapshot_id"))


@query("""with b as (select md_traj, tunnel_cluster, count(*) as n from bottlenecks where md_traj is not null and tunnel_cluster > 0 group by all),
p as (select distinct md_traj, tunnel_cluster from tunnel_profiles) select b.md_traj, b.tunnel_cluster from b where not exists (select 1 from p where p.md_traj = b.md_traj and p.tunnel_cluster = b.tunnel_cluster)""")
def missing_clusters(spark, d):
    """Clusters with bottlenecks that the profiles lack."""
    b = table(spark, d, "bottlenecks").where(F.col("md_traj").isNotNull() & (F.col("tunnel_cluster") > 0))
    return nodes.missing_ids(b, table(spark, d, "tunnel_profiles"), ["md_traj", "tunnel_cluster"])


@query(f"""with {B.NODES}, a as (select node, entity, x, y from v_nodes), b as (select node, entity, case when entity = 2 then x + 0.01 else x + 0.0001 end as x, y from v_nodes where entity <> 5)
select a.node, case when b.node is null then 'only in the first' else 'x' end as reason from a left join b using (node) where b.node is null or abs(a.x - b.x) > 0.001""")
def nearly_equal(spark, d):
    """Nodes in which two tables differ by more than a tolerance."""
    one = B.nodes(spark, d).select("node", "entity", "x", "y")
    two = one.where("entity <> 5").withColumn("x", F.col("x") + F.when(F.col("entity") == 2, 0.01).otherwise(0.0001))
    return filters.approx_equal(one, two, ["node"]).select("node", "reason")


@query(f"""{MATCH_SQL} select md_traj, frame, tunnel_cluster, tunnel, round(min(d), 6) as dist from touch group by all""")
def sphere_band(spark, d):
    """The ligand of each frame and the nearest sphere of each tunnel of that frame, by the band of layers."""
    near = matching.nearest_spheres(ligand_points(spark, d), tunnel_spheres(spark, d), ["md_traj", "frame"])
    return rounded(near.select("md_traj", "frame", "tunnel_cluster", "tunnel", "dist"), ["dist"])
