import pytest
from pyspark.sql import functions as F

from poregrid.operators import assign, filters, layering, nodes, profiles, traces


def test_filters_are_checked():
    assert filters.define_filters(min_radius=1, max_radius=-1).active() == {"min_radius": 1}
    for bad in ({"min_radius": -3}, {"max_length": "a"}, {"nope": 1}, {"min_length": 5, "max_length": 4}):
        with pytest.raises(ValueError):
            filters.define_filters(**bad)


def test_best_tunnel_ties_and_nulls(spark):
    rows = [(1, "m", 1, 2, 1, 0.5), (1, "m", 1, 1, 1, 0.5), (1, "m", 1, 3, 1, None), (1, "m", 2, 4, 1, None), (1, "m", 1, 1, 1, 0.5)]
    df = spark.createDataFrame(rows, "sc_id int, md_label string, snapshot_id int, cluster_id int, tunnel_id int, throughput double")
    df = df.select("*", *[F.lit(1.0).alias(c) for c in ("length", "bottleneck_radius", "curvature")])
    got = {r.snapshot_id: r.cluster_id for r in profiles.best_per_snapshot(df).collect()}
    assert got == {1: 1, 2: 4}


def test_group_membership_must_be_unique(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "md_label string")
    groups = spark.createDataFrame([("a", "g"), ("a", "h")], "md_label string, grp string")
    with pytest.raises(Exception, match="two groups"):
        assign.with_groups(rows, groups).collect()
    assert {(r.md_label, r.grp) for r in assign.with_groups(rows, groups.limit(1)).collect()} == {("a", "g"), ("b", None)}


CONTAINED = [("e", 1, 0.9, 0.2), ("e", 2, 0.86, 0.5), ("e", 3, 0.5, 1.0), ("f", 1, 0.3, 1.0), ("g", 5, 0.9, None), ("g", 4, 0.9, None), ("h", 1, None, None)]


@pytest.mark.parametrize("by,want", [
    ("penetration_depth", {("e", 2), ("f", None), ("g", 4), ("g", 5), ("h", None)}),
    ("assign2all", {("e", 1), ("e", 2), ("f", None), ("g", 4), ("g", 5), ("h", None)}),
    ("exact_matching", {("e", 1), ("f", None), ("g", None), ("h", None)}),
])
def test_event_assignment(spark, by, want):
    df = spark.createDataFrame(CONTAINED, "ev string, sc_id int, buriedness double, depth double")
    matches = spark.createDataFrame([("e", 1, 0.7), ("e", 2, 0.3)], "ev string, sc_id int, of_frames double")
    got = [(r.ev, r.sc_id) for r in assign.assign_events(df, ["ev"], by=by, matches=matches).collect()]
    assert len(got) == len(want) and set(got) == want
    with pytest.raises(ValueError):
        assign.assign_events(df, ["ev"], by="nothing")


def test_directions_meet_by_cells(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    events, centres = rng.normal(size=(200, 3)), rng.normal(size=(40, 3))
    centres[0], centres[1] = (1, 1, 1), (0, 0, 0)  # a corner of the cube, and no direction
    e = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(events)] + [(999, None, 1.0, 1.0)], "id int, x double, y double, z double")
    s = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(centres)], "sc_id int, x double, y double, z double")
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    angle = np.arccos(np.clip(unit(events) @ unit(centres).T, -1, 1))
    for cutoff in (0.2, 1.0, np.pi / 2):
        want = {(int(i), int(j)) for i, j in np.argwhere(angle <= cutoff) if j != 1}
        assert {(r.id, r.sc_id) for r in assign.by_direction(e, s, float(cutoff)).collect()} == want
    assert assign.by_direction(e, s.where("false"), 1.0).count() == 0


def test_traces_with_nulls_and_single_points(spark):
    rows = [(1, k, t, d) for k, (t, d) in enumerate([("entry", 5.0), ("entry", 4.0), ("inside", None), ("entry", 3.0), ("release", 6.0)])] + [(2, 0, None, 1.0)]
    df = spark.createDataFrame(rows, "path int, i int, kind string, dist double")
    first = {(r.path, r.i) for r in traces.first_run(df, ["path"], ["i"], "kind").collect()}
    assert first == {(1, 0), (1, 1), (1, 2), (1, 4), (2, 0)}
    assert [r.i for r in traces.take_while_closer(df.where("path = 1"), ["path"], ["i"], "dist").orderBy("i").collect()] == [0, 1, 2, 3]
    ordered = traces.point_order(df, ["path"], ["i"], F.lit(True)).collect()
    assert [r.i for r in ordered if r.is_end] == [0]


def test_layering_of_two_parallel_tunnels(spark):
    rows = []
    for t in range(30):
        for k in range(8):
            for branch, x in (("a", 0.0), ("b", 12.0 * k / 7)):
                rows.append(("m", 1, f"{branch}{t}", k, x + (t % 3) * 0.1, 0.0, k * 1.0, float(k), 1.0, k == 7))
    df = spark.createDataFrame(rows, "md string, cl int, path string, ord int, x double, y double, z double, dist double, radius double, is_end boolean")
    assigned = layering.assign_nodes(df, ["md", "cl"]).cache()
    got = layering.nodes_of(assigned, ["md", "cl"])
    assert got.agg(F.sum("n_points")).first()[0] == assigned.where("node is not null").count()
    assert got.where("num_end_points > 0").count() == 2
    found = layering.paths_of(assigned, ["md", "cl"]).collect()
    assert {p.nodes[0] for p in found} == {"SP"} and len({p.nodes[-1] for p in found}) == 2
    assert layering.nodes_of(layering.assign_nodes(df.where("false"), ["md", "cl"]), ["md", "cl"]).count() == 0


def test_node_depth_is_the_greatest(spark):
    df = spark.createDataFrame([("e", ["SP", "a", "b"]), ("e", ["SP", "b"])], "entity string, nodes array<string>")
    assert {r.node: r.depth for r in nodes.node_depths(df, ["entity"]).collect()} == {"SP": 1.0, "a": 0.5, "b": 0.5}


def test_seeded_sample_is_stable_and_bounded(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), "id")
    one, two = (sorted(r.id for r in assign.seeded_sample(df.repartition(n), ["k"], ["id"], 10, 4).collect()) for n in (2, 7))
    assert one == two and len(one) == 30
