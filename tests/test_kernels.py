import numpy as np
import pytest
from pyspark.sql import functions as F

from poregrid.functions import geometry as G
from poregrid.kernels import align, cluster, paths


def test_layers_of_distances(spark):
    # by the definition: the distance rounded up, then that over 1.5 rounded up, less 1
    d = [0, 0.01, 1, 1.01, 3, 3.01, 4, 4.2, 6, 6.6, 7, 9, 9.75, 30, 31]
    want = [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 19, 20]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(d)], "i int, d double")
    assert [r.l for r in df.orderBy("i").select(G.layer(F.col("d"), 1.5).alias("l")).collect()] == want
    with pytest.raises(ValueError):
        G.layer(F.col("d"), 0)


def naive_linkage(d, method, cutoff):
    groups = [[i] for i in range(len(d))]
    dist = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    while len(groups) > 1:
        h, a, b = min((dist(d[np.ix_(x, y)]), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if h > cutoff:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_linkage_equals_naive(method):
    rng = np.random.default_rng(3)
    for n in (1, 2, 17, 30):
        d = cluster.square_distances(rng.random((n, 3)) * 4)
        labels = cluster.flat_clusters(n, cluster.linkage(d, method), 1.2)
        assert {frozenset(np.flatnonzero(labels == k)) for k in set(labels)} == naive_linkage(d, method, 1.2)


@pytest.mark.parametrize("method", ["ward", "centroid", "median", "weighted"])
def test_other_linkages_part_clear_groups(method):
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(c, 0.1, (10, 3)) for c in (0, 5, 10)])
    labels = cluster.flat_clusters(30, cluster.linkage(cluster.square_distances(points), method), 2.5)
    assert [len(set(labels[k : k + 10])) for k in (0, 10, 20)] == [1, 1, 1] and len(set(labels)) == 3


def test_components_and_density():
    rng = np.random.default_rng(7)
    points = np.vstack([rng.normal(c, 0.2, (60, 3)) for c in (0, 6)] + [rng.uniform(-20, 20, (6, 3))])
    labels = cluster.density_clusters(points, 5, 5)
    assert len(set(labels[:60]) - {-1}) == 1 and len(set(labels[60:120]) - {-1}) == 1 and labels[0] != labels[60]
    chain = np.array([[0, 0, 0], [0.9, 0, 0], [1.8, 0, 0], [5, 0, 0.0]])
    assert cluster.components(chain, 1.0).tolist() == [0, 0, 0, 1]
    assert cluster.by_size(np.array([0, 1, 1, -1, 2])).tolist() == [3, 1, 1, -1, 2]


def test_paths_without_loops_and_redundancy():
    loop = ["1_1", "0_1", "1_1", "2_1", "3_5", "2_1", "4_2"]
    assert paths.without_loops(loop) == ["0_1", "1_1", "2_1", "4_2"]
    assert paths.redundant([["a", "b", "c"], ["a", "b"], ["b", "c"], ["b"], ["a", "b", "c"]]) == {0, 1, 2}
    assert paths.usable(["0_1", "2_1"], {"2_1"}) is None
    assert paths.usable(["0_1", "1_1", "2_1", "1_1", "2_2"], {"1_1"}) == ["0_1", "1_1", "2_1", "1_1"]
    assert paths.cover([["SP", "0_1", "1_1"], ["SP", "0_1", "1_2", "1_1"], ["SP", "0_2", "1_1"]], {"1_1"}) == [0, 1, 2]
    assert paths.fragments(["SP", "0_1", "1_1", "2_1"], {"0_1", "2_1"}) == [["SP", "0_1"], ["SP", "0_1", "1_1", "2_1"]]


def test_set_distance_and_search():
    data = np.array([[0, 0, 0, -1, 0, 0.5, 0], [0, 0, 2, 0, 0, 0.4, 0], [0, 0, 4, 1, 1, 0.4, 0]], dtype=float)
    one = paths.PathSet(["SP", "0_1", "1_1"], data, [["SP", "0_1", "1_1"]])
    assert paths.set_distance(one, one) == 0.0
    away = data * np.array([1, 1, -1, 1, 1, 1, 1])
    assert paths.set_distance(one, paths.PathSet(one.labels, away, one.paths)) == paths.FAR
    side = data + np.array([3.0, 0, 0, 0, 0, 0, 0]) * (data[:, 3:4] >= 0)
    assert 0 < paths.set_distance(one, paths.PathSet(one.labels, side, one.paths)) < 3
    way = paths.search_inward(np.array([[0, 0, 3.0], [0, 0, 1.6], [9, 9, 9.0]]), np.array([0, 0, 4.5]), 1.0)
    assert way[0].tolist() == [0, 0, 3.0] and np.linalg.norm(way[-1]) < 1.7
    assert paths.search_inward(np.empty((0, 3)), np.array([0, 0, 0.5]), 1.0).tolist() == [[0, 0, 0]]


def test_superposition_and_alignment():
    rng = np.random.default_rng(11)
    a = rng.normal(size=(20, 3))
    m = align.canonical_orientation(a)
    moved = a @ m[:3, :3].T + [1, 2, 3]
    got, rmsd = align.superpose(a, moved)
    assert rmsd < 1e-9 and np.allclose(got[:3, :3], m[:3, :3])
    moved[0] += 30
    assert align.superpose_rejecting(a, moved)[1] < 1e-6
    pairs = align.global_alignment("GATTACA", "GATACA", lambda x, y: 5.0 if x == y else -4.0)
    assert len(pairs) == 6 and all("GATTACA"[i] == "GATACA"[j] for i, j in pairs)
