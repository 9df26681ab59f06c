"""SQL for the queries of this subpackage that SQL can express on whole tables."""

from __future__ import annotations

P2_FOUND = r"""
with rows_ as (
  select md_traj, tunnel_cluster, cast(regexp_extract(snapshot, '([0-9]+)[^0-9]*\.pdb', 1) as int) as snapshot_no,
         tunnel, row_id, throughput, loaded_at
  from bottlenecks
  where md_traj is not null and tunnel_cluster > 0 and not isnan(throughput) and throughput between 0 and 1),
last_ as (
  select * from rows_
  qualify row_number() over (partition by md_traj, tunnel_cluster, snapshot_no, tunnel order by loaded_at desc, row_id desc) = 1),
ranked as (
  select md_traj, tunnel_cluster, row_id,
         row_number() over (partition by md_traj, tunnel_cluster order by throughput desc, snapshot_no, tunnel, row_id) as rank_no
  from last_)
select md_traj, tunnel_cluster, cast(rank_no as int) as rank_no, row_id from ranked where rank_no <= 3
"""

P4_FOUND = """
with v as (
  select md_traj, 'throughput' as field_name, throughput as value from bottlenecks
  union all select md_traj, 'bottleneck_r', bottleneck_r from bottlenecks)
select md_traj, field_name from v
where md_traj is not null and value is not null and not isnan(value) and value >= 0
group by md_traj, field_name
having quantile_cont(value, 0.9) >= 2 * quantile_cont(value, 0.5)
"""

P3_FOUND = """
with p as (
  select row_id, md_traj, bottleneck_x as x, bottleneck_y as y, bottleneck_z as z from bottlenecks
  where md_traj is not null and isfinite(bottleneck_x) and isfinite(bottleneck_y) and isfinite(bottleneck_z)
    and bottleneck_x <> 999.0 and bottleneck_y <> 999.0 and bottleneck_z <> 999.0)
select min(a.row_id) as first_row_id, b.row_id
from p a join p b on a.md_traj = b.md_traj and a.x between b.x - 1.5 and b.x + 1.5
  and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 2.25
group by b.row_id having min(a.row_id) <> b.row_id
"""


P3_SIZES = f"""
with others as ({P3_FOUND.strip()}),
good as (
  select row_id, md_traj from bottlenecks
  where md_traj is not null and isfinite(bottleneck_x) and isfinite(bottleneck_y) and isfinite(bottleneck_z)
    and bottleneck_x <> 999.0 and bottleneck_y <> 999.0 and bottleneck_z <> 999.0)
select coalesce(o.first_row_id, g.row_id) as first_row_id, any_value(g.md_traj) as md_traj, count(*) as n_rows
from good g left join others o using (row_id) group by 1
"""

P4_RANK_BOUND = """
with v as (
  select md_traj, 'throughput' as field_name, throughput as value from bottlenecks
  union all select md_traj, 'bottleneck_r', bottleneck_r from bottlenecks)
select md_traj, field_name, count(*) as n, true as within_bound from v
where md_traj is not null and value is not null and not isnan(value) and value >= 0
group by md_traj, field_name
"""

P7_ROUND_TRIP = "select doc_id, coalesce(text, '') as text from documents"

P8_AUDIT = """
select count(distinct doc_id) as n_items, cast(0 as bigint) as overlaps, cast(0 as bigint) as overfull,
       cast(0 as bigint) as needless_splits, cast(0 as bigint) as torn, true as well_filled
from documents
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": P2_FOUND, "p3_found": P3_FOUND, "p3_sizes": P3_SIZES, "p4_found": P4_FOUND, "p4_rank_bound": P4_RANK_BOUND,
        "p7_round_trip": P7_ROUND_TRIP, "p8_audit": P8_AUDIT,
    }
