import numpy as np
import pytest
from pyspark.sql import functions as F

from poregrid.kernels import cluster, paths
from poregrid.operators import events, matching, superclusters, transforms
from poregrid.plans.pipeline import TransportProcesses
from poregrid.sources.text import EngineConfig, config_template, read_config

TRACE = "md_label string, path_no int, ord int, event_type string, x double, y double, z double, extra int"


def trace(path, steps):
    return [("m", path, i, kind, 0.0, 0.0, float(z), 7) for i, (kind, z) in enumerate(steps)]


def test_an_event_is_extended_along_its_trace(spark):
    steps = [("entry", 9), ("entry", 7), ("entry", 7), ("inside", 6), ("inside", 6.5), ("inside", 5), ("entry", 8), ("release", 6), ("release", 9)]
    rows = trace(1, steps) + trace(2, [("entry", 30), ("entry", 20), ("inside", 15)]) + trace(3, [("inside", 1)]) + trace(4, [("entry", 5)]) + [("m", 1, 99, None, None, 0.0, 0.0, 7)]
    df = spark.createDataFrame(rows, TRACE).repartition(3)
    parts = events.segments(df, ["md_label", "path_no"])
    assert {(r.path_no, r.event_type) for r in parts.collect()} == {(1, "entry"), (1, "inside"), (1, "release"), (4, "entry")}
    got = events.extract(df, ["md_label", "path_no"], search=False).orderBy("event_type", "ord").collect()
    assert {r.path_no for r in got} == {1}  # the one point of path 4 is no event
    assert [(r.event_type, r.z, r.is_end) for r in got] == [
        ("entry", 6.0, False), ("entry", 7.0, False), ("entry", 9.0, True),
        ("release", 5.0, False), ("release", 6.0, False), ("release", 9.0, True),
    ]
    assert events.extract(df.where("false"), ["md_label", "path_no"]).count() == 0


def test_the_way_inward_is_added(spark):
    steps = [("entry", 9), ("entry", 6)] + [("inside", 6.5), ("inside", 4.5), ("inside", 3), ("inside", 1.5), ("inside", 0.5), ("inside", 8)] + [("release", 8.5), ("release", 9)]
    got = events.extract(spark.createDataFrame(trace(1, steps), TRACE), ["md_label", "path_no"], ligand_radius=1.0).orderBy("event_type", "ord").collect()
    entry = [r.z for r in got if r.event_type == "entry"]
    assert entry[0] == 0.0 and entry[-2:] == [6.0, 9.0] and entry == sorted(entry)


def test_neighbours_in_time_link_the_search():
    far = np.array([[0, 0, 5.0], [0, 0, 2.5], [0, 0, 0.5]])  # too far apart to overlap, but one after the other
    way = paths.search_inward(far, np.array([0, 0, 6.0]), 1.0)
    assert way[:, 2].tolist() == [5.0, 2.5, 0.5, 0.0]
    gap = paths.search_inward(np.array([[0, 0, 5.0], [9, 9, 9.0], [0, 0, 2.5], [0, 0, 0.5]]), np.array([0, 0, 6.0]), 1.0)
    assert gap[:, 2].tolist() == [5.0]
    assert paths.search_inward(np.empty((0, 3)), np.array([0, 0, 6.0]), 1.0).shape == (0, 3)


def test_long_traces_need_no_matrix():
    rng = np.random.default_rng(1)
    points = rng.normal(size=(20_000, 3)) * 3
    assert len(paths.search_inward(points, np.array([0, 0, 8.0]), 1.0)) > 0


def test_event_nodes_lie_on_the_direct_path(spark):
    rows = [("m", 1, "entry", k, 0.0, 0.0, z, abs(z), k == 5) for k, z in enumerate([0.5, 2.0, 3.5, 2.0, 3.5, 5.0])]
    df = spark.createDataFrame(rows, "md_label string, path_no int, event_type string, ord int, x double, y double, z double, dist double, is_end boolean")
    got = events.layered(df, ["md_label", "path_no", "event_type"]).orderBy("layer").collect()
    assert [(r.node, r.is_end) for r in got] == [("0_1", False), ("1_1", False), ("2_1", False), ("3_2", True)]
    assert got[1].z == 2.0 and got[1].rmsf == 0.0


def brute_nearest(q, spheres, layers, ql):
    last = max(layers)
    if ql > last:
        keep = [la >= last - 1 for la in layers]
    elif ql in layers:
        keep = [abs(la - ql) <= 1 for la in layers]
    else:
        low, high = max([la for la in layers if la < ql], default=None), min([la for la in layers if la > ql], default=None)
        keep = [(low is not None and low - 1 <= la <= low) or (high is not None and high <= la <= high + 1) for la in layers]
    return min((np.linalg.norm(q - s[:3]) - s[3], i) for i, (s, k) in enumerate(zip(spheres, keep)) if k)


def test_nearest_spheres_by_the_band(spark):
    rng = np.random.default_rng(9)
    layer = lambda v: max(0, int(np.ceil(np.ceil(np.linalg.norm(v)) / 1.5)) - 1)
    tunnels, points = [], []
    for t in range(6):
        z = np.sort(rng.choice(np.arange(0, 20, 0.7), 6, replace=False))
        tunnels.append((1, t, 1, [(float(rng.normal()), float(rng.normal()), float(v), 1.0) for v in z]))
    points = [(1, a, *map(float, rng.normal(size=3) * [1, 1, 9])) for a in range(12)]
    t = spark.createDataFrame([*tunnels, (1, 98, 1, []), (1, 99, 1, [(None, 0.0, 0.0, 1.0)]), (2, 0, 1, tunnels[0][3])], "frame int, tunnel_cluster int, tunnel int, spheres array<struct<x:double,y:double,z:double,r:double>>")
    p = spark.createDataFrame([*points, (None, 50, 0.0, 0.0, 0.0)], "frame int, atom int, x double, y double, z double")
    got = {(r.atom, r.tunnel_cluster): r.dist for r in matching.nearest_spheres(p, t, ["frame"]).collect()}
    assert len(got) == 72
    for _, a, *q in points:
        for _, c, _, spheres in tunnels:
            s = np.array(spheres)
            assert got[a, c] == pytest.approx(brute_nearest(np.array(q), s, [layer(v[:3]) for v in s], layer(q))[0])
    best = matching.matches(p.withColumn("ev", F.lit("e")), t, ["ev"], ["frame"]).collect()
    assert len(best) == 1 and best[0].dist == pytest.approx(min(got.values()))
    share = matching.fractions(matching.matches(p.withColumn("ev", F.lit("e")), t, ["ev"], ["frame"]), spark.createDataFrame([("e", 1), ("e", 7)], "ev string, frame int"), ["ev"], 99.0).first()
    assert (share.of_frames, share.of_tunnel_frames) == (0.5, 1.0)


@pytest.mark.parametrize("method", ["single", "complete", "average", "weighted"])
def test_sparse_linkage_equals_the_matrix(method):
    rng = np.random.default_rng(6)
    for n in (1, 5, 60):
        d = cluster.square_distances(rng.random((n, 3)) * 4)
        d[(d > 2.2) & (method != "average")] = cluster.FAR
        want = cluster.flat_clusters(n, cluster.linkage(d, method), 1.0)
        pairs = [(i, j, d[i, j]) for i in range(n) for j in range(i + 1, n) if d[i, j] < cluster.FAR]
        got = cluster.sparse_linkage(n, pairs, 1.0, method)
        assert len(set(zip(want.tolist(), got.tolist()))) == len(set(want.tolist())) == len(set(got.tolist()))


def test_linkage_by_components(spark):
    rng = np.random.default_rng(2)
    points = np.vstack([rng.normal(c, 0.5, (25, 3)) for c in (0, 6, 12, 13.5)])
    d = cluster.square_distances(points)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(100) for j in range(i + 1, 100) if d[i, j] < 5], "i bigint, j bigint, dist double")
    numbers = spark.range(101).select(F.col("id").alias("no"))  # the last one has no pair
    full = np.where(d < 5, d, cluster.FAR)
    for method in ("complete", "average", "ward"):
        got = {r.no: r.sc_id for r in superclusters.link(pairs, numbers, 2.0, method).collect()}
        want = cluster.flat_clusters(100, cluster.linkage(full, method), 2.0)
        assert len(got) == 101 and len(set(zip(want.tolist(), (got[i] for i in range(100))))) == len(set(want.tolist())) == len(set(got.values())) - 1
        assert sorted(set(got.values())) == list(range(1, len(set(got.values())) + 1)) and got[0] == 1


def test_components_of_a_long_chain(spark):
    edges = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).where("a <> 200")
    got = {r.id: r.comp for r in superclusters.components_of(edges).collect()}
    assert all(got[i] == (0 if i <= 200 else 201) for i in range(301))


def test_transforms_lay_simulations_on_each_other(spark):
    rng = np.random.default_rng(3)
    names = list(transforms.LETTERS)[:20]
    ca = rng.normal(size=(40, 3)) * 8
    seq = [names[k] for k in rng.integers(0, 20, 40)]
    turn = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]])
    rows, starts = [], []
    for md, place in (("a", lambda v: v), ("b", lambda v: turn @ v + [5, -3, 2])):
        rows += [(md, "A", k + 1, seq[k], "CA", k, *map(float, place(ca[k]))) for k in range(40) if md == "a" or k not in (4, 5)]
        rows += [(md, "A", 50, "WAT", "CA", 99, 0.0, 0.0, 0.0), (md, "A", 1, seq[0], "N", 0, 1.0, 1.0, 1.0)]
        starts += [(md, *map(float, place(np.array([1.0, 2, 3]) + s))) for s in (-0.5, 0.5)]
    structures = spark.createDataFrame(rows, "md_label string, chain string, resid int, resname string, atom_name string, serial int, x double, y double, z double")
    got = transforms.compute(structures, spark.createDataFrame(starts, "md_label string, x double, y double, z double")).cache()
    moved = transforms.move(structures.where("atom_name = 'CA' and resname <> 'WAT'"), got).collect()
    places = {}
    for r in moved:
        places.setdefault(r.resid, []).append((r.x, r.y, r.z))
    assert all(np.allclose(v[0], v[-1], atol=1e-6) for v in places.values())
    begin = transforms.move(spark.createDataFrame(starts, "md_label string, x double, y double, z double"), got).agg(F.avg("x"), F.avg("y"), F.avg("z")).first()
    assert np.allclose(begin, 0, atol=1e-6)
    back = transforms.move(transforms.move(structures, got), got, inverse=True).where("atom_name = 'N'").collect()
    assert all(np.allclose([r.x, r.y, r.z], 1.0) for r in back)
    fixed = sorted(p for p in places if True)
    on_axis = places[fixed[len(fixed) // 4]][0]
    assert np.allclose(on_axis[:2], 0, atol=1e-6)  # the residue at a quarter lies on the z axis
    nodes = spark.createDataFrame([("a", 1, "0_1", 0, 9.0, 9.0, 9.0), ("a", 1, "1_1", 1, 9.0, 9.0, 9.0), ("a", 1, "1_2", 1, 1.0, 2.0, 3.0)], "md_label string, cluster_id int, node string, layer int, x double, y double, z double")
    layers = {r.node: r.layer for r in transforms.apply(nodes, got).collect()}
    assert layers["0_1"] == 0 and layers["1_1"] > 1 and layers["1_2"] == 0


def make_run(spark, folder, **settings):
    rows, traces = [], []
    for m in ("a", "b"):
        for snap in range(1, 11):
            for cl, x in ((1, 0.0), (2, 0.4), (3, 25.0)):
                spheres = [(k, x * k / 9, 0.0, k * 1.0 + 0.01 * (snap % 3), k * 1.0, 1.2, k * 1.0) for k in range(10)]
                rows.append((m, snap, cl, 1, 0.1 * cl, 1.2, 9.5, 1.1, spheres))
        traces += [(m, 1, i, "entry" if i < 4 else "inside", 0.05, 0.0, 9.0 - i * 1.1) for i in range(8)]
        traces += [(m, 2, i, "release" if i > 3 else "inside", -40.0, 0.0, 0.5 + i * 0.2) for i in range(8)] + [(m, 2, -1, "inside", 0.1, 0.1, 0.1)]
    schema = "md_label string, snapshot_id int, cluster_id int, tunnel_id int, throughput double, bottleneck_radius double, length double, curvature double, spheres array<struct<idx:int,x:double,y:double,z:double,dist:double,r:double,len:double>>"
    t = spark.createDataFrame(traces, "md_label string, path_no int, ord int, event_type string, x double, y double, z double")
    config = EngineConfig(output_path=str(folder), snapshots_per_simulation=10, **settings)
    return TransportProcesses(spark, config, spark.createDataFrame(rows, schema), spark.createDataFrame([("a", "g")], "md_label string, grp string"), t)


def test_events_find_their_supercluster(spark, tmp_path):
    run = make_run(spark, tmp_path / "r", overwrite=True)
    member = {(r.md_label, r.cluster_id): r.sc_id for r in run.merge_tunnel_clusters2super_clusters().collect()}
    run.create_super_cluster_profiles()
    got = {(r.md_label, r.path_no, r.event_type): r.sc_id for r in run.assign_transport_events().collect()}
    assert got == {(m, 1, "entry"): member["a", 1] for m in "ab"} | {(m, 2, "release"): None for m in "ab"}
    text = run.report(comparative=True)
    assert "Label: overall" in text and "Label: g" in text and "Label: b" in text and "Label: a" not in text and "events of no supercluster" in text
    counts = {(r.scope, r.label): r.num_events for r in run.event_counters().collect()}
    assert counts == {("overall", "overall"): 2, ("group", "g"): 1, ("md", "b"): 1}
    lines = run.details()
    assert lines["clusters"].count() == 2 and lines["events"].first().line == "1" and lines["outliers"].count() == 2
    again = make_run(spark, tmp_path / "r", overwrite=True)
    again.resume()
    assert again.assigned.count() == 4 and again.profile.count() == 40
    again.clear_results()
    assert not again._done("membership")
    with pytest.raises(PermissionError):
        make_run(spark, tmp_path / "r").clear_results()


def test_settings_are_checked(tmp_path):
    path = tmp_path / "c.ini"
    path.write_text(config_template())
    assert read_config(str(path)) == EngineConfig()
    for bad in ("[CALCULATIONS_SETTINGS]\nlayer_thicknes = 2\n", "[OTHER]\nlayer_thickness = 2\n", "[CALCULATIONS_SETTINGS]\nlayer_thickness = thick\n", "[CALCULATIONS_SETTINGS]\nclustering_linkage = nearest\n", "[CALCULATIONS_SETTINGS]\nmin_length = -3\n"):
        path.write_text(bad)
        with pytest.raises(ValueError):
            read_config(str(path))
    path.write_text("[ADVANCED_SETTINGS]\ncomparative_groups_definition = g: [a1, a2]; h: [b*]\nmsms = None\n[OUTPUT_SETTINGS]\nvisualize_layered_clusters = True\n")
    config = read_config(str(path))
    assert config.groups(["a1", "a2", "b1", "b2", "c"]) == [("a1", "g"), ("a2", "g"), ("b1", "h"), ("b2", "h")]
    with pytest.raises(ValueError):
        config.groups(["a1", "b1"])
    with pytest.raises(ValueError):
        EngineConfig(comparative_groups_definition="g: [a*]; h: [a1]").groups(["a1"])
