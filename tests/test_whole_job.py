"""Queries that must cover the whole job, not a part of it."""

import glob
import os
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from poregrid import domain_queries
from poregrid.kernels import cluster, paths
from poregrid.operators import packed, superclusters
from poregrid.operators.layering import cluster_layer
from poregrid.plans.pipeline import superclusters_of


@pytest.mark.parametrize("name", ["layer_band_join", "rmsf_distance", "nearest_node", "buriedness_depth"])
def test_all_ordered_pairs_of_path_sets(spark, data_dir, name):
    con = duckdb.connect()
    for f in glob.glob(f"{data_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = entry.queries()[name](spark, data_dir)
    rows = sorted(map(tuple, got.collect()))
    want = con.sql(entry.oracle_sql()[name]).df()[got.columns]
    assert rows == sorted(want.itertuples(index=False, name=None))
    assert len({(r[0], r[1]) for r in rows}) == 90


@pytest.mark.parametrize("name", ["p5_found", "residue_frequency", "residue_top"])
def test_copies_of_a_field_do_not_bind_its_residues(spark, data_dir, tmp_path, name):
    rows = pq.read_table(f"{data_dir}/bottlenecks.parquet")
    fields = ["221_C|150_B,48_B;111_A; 47_B" if i % 3 == 0 else f for i, f in enumerate(rows["bottleneck_residues"].to_pylist())]
    at = rows.column_names.index("bottleneck_residues")
    pq.write_table(rows.set_column(at, "bottleneck_residues", pa.array(fields, pa.string())), tmp_path / "bottlenecks.parquet")
    con = duckdb.connect()
    con.sql(f"create view bottlenecks as select * from '{tmp_path}/bottlenecks.parquet'")
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(entry.oracle_sql()[name]).df()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", ["p5_found", "residue_frequency", "residue_frequency_scopes", "residue_top"])
def test_residues_part_by_definition_without_a_model(spark, data_dir, tmp_path, monkeypatch, name):
    """A pair that also stands quoted parts where it does not, as in SQL, and nothing is learnt to that end."""
    rows = pq.read_table(f"{data_dir}/bottlenecks.parquet")
    fields = rows["bottleneck_residues"].to_pylist()
    for i in range(len(fields)):
        if i % 3 == 0:
            fields[i] = f"R{i % 7};221_C, 150_B|S{i % 5}"
        elif i % 30 == 1:
            fields[i] = '"221_C, 150_B" / T'
    at = rows.column_names.index("bottleneck_residues")
    pq.write_table(rows.set_column(at, "bottleneck_residues", pa.array(fields, pa.string())), tmp_path / "bottlenecks.parquet")
    pq.write_table(pq.read_table(f"{data_dir}/simulations.parquet"), tmp_path / "simulations.parquet")
    con = duckdb.connect()
    for table in ("bottlenecks", "simulations"):
        con.sql(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    learnt = []
    monkeypatch.setattr(packed, "literal_runs", lambda *a: learnt.append(a))
    got = entry.queries()[name](spark, str(tmp_path))
    want = con.sql(entry.oracle_sql()[name]).df()[got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))
    assert not learnt


def test_path_sets_that_point_apart_have_a_distance(spark):
    rows = [(cl, "p", k, sign * k * 0.2, 0.0, k * 0.3 * sign, float(k), 1.0, k == 4) for cl, sign in ((1, 1), (2, -1)) for k in range(5)]
    points = spark.createDataFrame(rows, "cl int, path string, ord int, x double, y double, z double, dist double, radius double, is_end boolean")
    for exact, pairs, clusters in ((True, 1, 1), (False, 0, 2)):
        labels, near = superclusters_of(points, ["cl"], exact=exact)
        assert near.count() == pairs and labels.select("sc_id").distinct().count() == clusters
    default = superclusters_of(points, ["cl"])[1].collect()
    assert [(r.i, r.j) for r in default] == [(0, 1)] and default[0].dist < 2


def test_a_tunnel_whose_last_cell_is_missing_still_ends(spark, data_dir, tmp_path):
    cells = {"X": "0,1,2,3", "Y": "0,0,0,0", "Z": "0,1,2,3", "distance": "0,2,4,-", "length": "0,2,4,6", "R": "1,1,1,1", "Upper limit R overestimation": "-,-,-,-"}
    lines = pq.read_table(f"{data_dir}/tunnel_profiles.parquet")
    row = {c: None for c in lines.column_names} | {"md_traj": "m", "snapshot": "stripped_system.000001.pdb", "tunnel_cluster": 1, "tunnel": 1}
    made = [row | {"line_id": k, "axis": a, "axis_values": v} for k, (a, v) in enumerate(cells.items())]
    pq.write_table(pa.Table.from_pylist(made, schema=lines.schema), tmp_path / "tunnel_profiles.parquet")
    pq.write_table(pq.read_table(f"{data_dir}/axis_catalog.parquet"), tmp_path / "axis_catalog.parquet")
    got = domain_queries.tunnel_points(spark, str(tmp_path)).orderBy("ord").collect()
    assert [(r.x, r.is_end) for r in got] == [(0.0, False), (1.0, False), (2.0, True)]


@pytest.mark.parametrize("seed", range(4))
def test_weighted_kernels_equal_those_on_points(seed):
    rng = np.random.default_rng(seed)
    places = np.vstack([rng.normal(c, 0.5, (25, 3)) for c in (0, 7)] + [rng.uniform(-9, 15, (8, 3))])
    weight = rng.integers(1, 5, len(places))
    points, at = np.repeat(places, weight, axis=0), np.repeat(np.arange(len(places)), weight)
    got = cluster.density_clusters(places, 12, 6, weight)
    assert got.max() == 1 and (got[at] == cluster.density_clusters(points, 12, 6)).all()
    one = cluster.flat_clusters(len(places), cluster.linkage(cluster.square_distances(places), "average", weight), 2.0)
    all_points = cluster.flat_clusters(len(points), cluster.linkage(cluster.square_distances(points), "average"), 2.0)
    assert len({*zip(one[at].tolist(), all_points.tolist())}) == len(set(one.tolist())) == len(set(all_points.tolist()))
    assert cluster.quantile(places[:, 0], weight, 0.9) == pytest.approx(np.quantile(points[:, 0], 0.9))


def test_a_tight_bunch_of_many_points_is_a_node():
    rng = np.random.default_rng(2)
    xyz = np.vstack([rng.normal(0, 0.8, (60, 3)), [[12.0, 0, 0], [12.4, 0, 0]]])
    weight = np.r_[np.ones(60), 400.0, 300.0]  # two full cells
    labels = cluster_layer(xyz, np.ones(62), weight, False, 1.5)
    assert labels[60] == labels[61] == 1 and (labels[:60] != 1).all()


LONG = 600_000_000


@pytest.fixture
def long_windows(spark, monkeypatch):
    """Ligands found in three frames, and events over far more frames than fit in memory."""
    found = spark.createDataFrame([("m", 0, 1.0, 3, 1), ("m", 300, -1.0, 4, 1), ("m", LONG, 0.0, 5, 2)], "md_traj string, frame int, dist double, tunnel_cluster int, tunnel int")
    rows = [(1, "m", "entry", 0, LONG), (2, "m", "entry", 1, 299), (3, "m", "release", 200, 300), (4, "m", "entry", 5, 4), (5, None, "entry", 0, 9)]
    windows = spark.createDataFrame(rows, "path_row long, md_traj string, event_type string, frame_b int, frame_e int")
    monkeypatch.setattr(domain_queries.matching, "matches", lambda *a, **k: found)
    monkeypatch.setattr(domain_queries, "event_frame_windows", lambda *a: windows)


def test_fractions_of_windows_that_are_too_long_to_be_spread(spark, data_dir, long_windows):
    got = {r.path_row: tuple(r)[1:] for r in domain_queries.exact_match_fraction(spark, data_dir).collect()}
    assert got == {1: ("entry", 0.0, 0.666667), 2: ("entry", 0.0, None), 3: ("release", round(1 / 101, 6), 1.0), 5: ("entry", 0.0, None)}


def test_frames_of_windows_that_are_too_long_to_be_spread(spark, data_dir, long_windows):
    got = sorted(map(tuple, domain_queries.frame_nearest(spark, data_dir).collect()))
    first, middle, last = ((0, 1.0, 3, 1), (300, -1.0, 4, 1), (LONG, 0.0, 5, 2))
    assert got == [(1, "entry", *first), (1, "entry", *middle), (1, "entry", *last), (3, "release", *middle)]


def random_path_set(rng, start: bool) -> paths.PathSet:
    layers = np.repeat(np.arange(rng.integers(1, 7)), 2) + (rng.random() < 0.3) * 3
    labels = [f"{layer}_{k % 2 + 1}" for k, layer in enumerate(layers)]
    data = np.column_stack([rng.normal(0, 4, (len(layers), 3)), layers, rng.random(len(layers)) < 0.3, rng.uniform(0.5, 2, len(layers)), rng.uniform(0, 8, len(layers))])
    ways = [sorted(rng.choice(len(labels), rng.integers(1, len(labels) + 1), replace=False)) for _ in range(rng.integers(1, 4))]
    found = [[paths.START] * start + [labels[k] for k in way] for way in ways]
    if start:
        labels, data = [paths.START, *labels], np.vstack([[0.0, 0.0, 0.0, -1.0, 0.0, 0.5, 0.0], data])
    return paths.PathSet(labels, data, found)


@pytest.mark.parametrize("kind", [0, 1, 2])
@pytest.mark.parametrize("exact", [True, False])
def test_distances_of_chunks_equal_those_of_pairs(kind, exact):
    rng = np.random.default_rng(kind)
    sets = [random_path_set(rng, k % 3 > 0) for k in range(24)]
    held = [paths.packed(s) for s in sets]
    got = np.full((24, 24), np.nan)
    for at, one in paths.chunks(held, 40):
        for to, two in paths.chunks(held, 90):
            part = paths.chunk_distances(one, two, kind, 0.5, exact)
            got[at : at + part.shape[0], to : to + part.shape[1]] = part
    want = np.array([[paths.set_distance(a, b, kind, 0.5, exact) for b in sets] for a in sets])
    assert np.abs(got - want).max() < 1e-12 and (exact or (want == paths.FAR).any())


def test_distances_of_all_pairs_come_without_a_linkage(spark, data_dir, monkeypatch):
    monkeypatch.setattr(superclusters, "link", None)
    n = domain_queries.pathset_distance(spark, data_dir)
    got = n.selectExpr("count(*)", "count(distinct i, j)", "count_if(i < j)", "max(j) + 1", "count_if(dist is null)").first()
    assert got[0] == got[1] == got[2] == got[3] * (got[3] - 1) // 2 and got[4] == 0


@pytest.mark.parametrize("seed", range(4))
def test_complete_linkage_of_ranks_equals_that_of_pairs(seed):
    rng = np.random.default_rng(seed)
    n = int(rng.integers(2, 90))
    d = np.round(cluster.square_distances(rng.uniform(0, 3, (n, 2))), (1, 2, 4, 9)[seed])  # many are equal
    i, j = np.nonzero(np.triu(d <= 1.0, 1))
    want = cluster.sparse_linkage(n, list(zip(i.tolist(), j.tolist(), d[i, j].tolist())), 1.0, "complete")
    assert (cluster.dense_complete(n, [(i[:9], j[:9], d[i, j][:9]), (i[9:], j[9:], cluster.short(d[i, j][9:]))]) == want).all()


def test_spanning_pairs_connect_the_same():
    rng = np.random.default_rng(5)
    i, j = rng.integers(0, 4_000, (2, 1_500))
    i, j = np.r_[i, np.arange(5_000, 5_999)], np.r_[j, np.arange(5_001, 6_000)]  # and a long chain
    a, b = cluster.spanning(i, j)
    assert len(a) < len(np.unique(np.r_[i, j]))
    lows = dict(zip(a.tolist(), b.tolist()))
    low = lambda v: lows.get(v, v)
    assert all(low(p) == low(q) and low(p) <= p for p, q in zip(i.tolist(), j.tolist())) and {lows[v] for v in range(5_001, 6_000)} == {5_000}


def test_one_dense_component_is_linked_in_time(spark):
    """Twelve hundred sets, all pairs near: one task's group of 719,400 pairs."""
    n = 1_200
    pairs = spark.range(n).selectExpr("id i").crossJoin(spark.range(n).selectExpr("id j")).where("i < j").selectExpr("i", "j", "round(abs(i % 40 - j % 40) / 20, 4) dist")
    began = time.time()
    rows = superclusters.link(pairs, spark.range(n).withColumnRenamed("id", "no"), 0.0, "complete").collect()
    assert {(r.no % 40, r.sc_id) for r in rows} == {(k, k + 1) for k in range(40)}
    rows = superclusters.link(pairs, spark.range(n).withColumnRenamed("id", "no"), 2.0, "complete").collect()
    assert {r.sc_id for r in rows} == {1} and time.time() - began < 60
