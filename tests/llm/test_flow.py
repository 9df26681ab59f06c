import random

import numpy as np
import pytest

from poregrid.llm.flow import PointClusters, markov_clusters

SCHEMA = "c0 string, rid bigint, x0 double, y double, z double, node int, grp string"  # many clash with names inside


def cliques(seed=1):
    rng = random.Random(seed)
    rows, i = [], 100
    for g in ("m1", "m2", None):
        for k in range(12):
            centre = [k * 9.0 % 30, (k // 3) * 8.0 - 14, -k * 1.0]
            for _ in range(rng.choice([1, 2, 5, 40])):
                i += rng.randint(1, 3)
                rows.append((g, i, *[c + rng.uniform(-0.43, 0.43) for c in centre], 0, ""))
    for _ in range(300):  # a third of the rows at one point
        i += 1
        rows.append(("m1", i, 77.0, 77.0, 77.0, 0, ""))
    rows += [("m1", i + 1, None, 1.0, 1.0, 0, ""), ("m1", i + 2, float("nan"), 1.0, 1.0, 0, "")]
    rng.shuffle(rows)
    return rows


def brute(rows):
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[2] == r[2]]
    near = lambda a, b: a[0] == b[0] and sum((p - q) ** 2 for p, q in zip(a[2:5], b[2:5])) <= 2.25
    return {r[1]: min(q[1] for q in good if near(r, q)) for r in good}


def test_cliques_are_found_exactly(spark):
    rows = cliques()
    c = PointClusters(spark.createDataFrame(rows, SCHEMA).repartition(5), "c0", "rid", ["x0", "y", "z"], 1.5)
    want = brute(rows)
    assert {r.rid: r.first_id for r in c.members().collect()} == want
    about = {r.first_id: r for r in c.describe().collect()}
    assert set(about) == set(want.values()) and sum(r["size"] for r in about.values()) == len(want)
    for first, r in about.items():
        assert r.span <= 1.5 and 1 <= len(r.typical_ids) <= 3 and all(want[t] == first for t in r.typical_ids)


def test_a_bridge_is_cut_by_the_flow(spark):
    left, right = [(i, j, 5.0, 5.0) for i in range(5) for j in range(5)], [(i, j, 5.0, 5.0) for i in range(10, 15) for j in range(10, 15)]
    linked = spark.createDataFrame(left + right + [(4, 10, 5.0, 1.0), (10, 4, 5.0, 1.0)], "col bigint, row bigint, m double, w double")
    got = {r.node: r.attractor for r in markov_clusters(linked)[0].collect()}
    assert len({got[k] for k in range(5)}) == 1 and len({got[k] for k in range(10, 15)}) == 1 and got[0] != got[10]


def test_empty_and_unsettled(spark):
    df = spark.createDataFrame(cliques(), SCHEMA)
    c = PointClusters(df.where("false"), "c0", "rid", ["x0", "y", "z"], 1.5)
    assert c.members().count() == 0 and c.describe().count() == 0
    linked = spark.createDataFrame([(i, j, 9.0, 5.0 + i % 2 + j % 3) for i in range(4) for j in range(4)], "col bigint, row bigint, m double, w double")
    with pytest.raises(RuntimeError):
        markov_clusters(linked, inflation=1.0001, max_rounds=1)


def clustered(spark, points, **flow):
    df = spark.createDataFrame([("m", i, *map(float, p)) for i, p in enumerate(points)], "g string, rid bigint, x double, y double, z double")
    return PointClusters(df.repartition(4), "g", "rid", ["x", "y", "z"], 1.5, **flow)


@pytest.fixture(scope="module")
def blobs(spark):
    """Overlapping blobs on an even background: no cliques, similar rows everywhere."""
    rng = np.random.default_rng(8)
    points = np.vstack([rng.normal(c, 0.8, (120, 3)) for c in ((0, 0, 0), (2.6, 0, 0), (9, 9, 9))] + [rng.uniform(-1, 4, (80, 3))])
    return points, clustered(spark, points)


def test_links_miss_few_similar_rows_of_overlapping_blobs(blobs):
    points, c = blobs
    side = 1.5 / 3**0.5
    cell = {tuple(r[f"c{i}"] for i in range(3)): r.node for r in c.nodes.collect()}
    node = np.array([cell[tuple(np.floor(p / side).astype(int))] for p in points])
    linked = {(r.col, r.row) for r in c.weights.collect()}
    near = np.argwhere(np.triu(np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) <= 1.5, 1))
    found = sum(node[i] == node[j] or (node[i], node[j]) in linked for i, j in near)
    assert found >= 0.999 * len(near), (found, len(near))
    # a link always has a pair of similar rows behind it
    both = {(node[i], node[j]) for i, j in near} | {(node[j], node[i]) for i, j in near}
    assert all(a == b or (a, b) in both for a, b in linked)


def dense_clusters(weight, mass=None):
    """Markov clustering of a dense matrix without any pruning; ``mass``: how many equal rows each row stands for."""
    mass = np.ones(len(weight)) if mass is None else mass
    m = weight / weight.sum(0)
    for _ in range(80):
        m = mass[:, None] * (m / mass[:, None]) ** 2
        m = m / m.sum(0)
        per = m / mass[:, None]
        if (1 - (m * per).sum(0) / per.max(0)).max() < 1e-2:
            break
        m = m @ m
    to = (per >= 0.9 * per.max(0)).argmax(0)
    while (to[to] != to).any():
        to = to[to]
    return to


def together(labels):
    return np.equal.outer(labels, labels)


def test_pruning_changes_no_cluster(spark, blobs):
    points, c = blobs
    names = {r.rid: r.first_id for r in c.members().collect()}
    finer = clustered(spark, points, prune=1e-4)
    assert c.lost <= 1e-3 and finer.lost <= 1e-3
    assert names == {r.rid: r.first_id for r in finer.members().collect()}
    linked = c.weights.collect()
    ids = {n: k for k, n in enumerate(sorted({r.col for r in linked}))}
    weight, mass = np.zeros((len(ids), len(ids))), np.zeros(len(ids))
    for r in linked:
        weight[ids[r.row], ids[r.col]] = r.w
        mass[ids[r.row]] = r.m
    want, got = together(dense_clusters(weight, mass)), together(np.array([names[n] for n in sorted(ids)]))
    assert (want & got).sum() >= 0.99 * max(want.sum(), got.sum())


def test_clusters_of_cells_are_those_of_rows(spark):
    """Blobs wider than the distance but apart: as by Markov clustering of the rows themselves."""
    rng = np.random.default_rng(5)
    points = np.vstack([rng.normal(c, 0.45, (50, 3)) for c in ((0, 0, 0), (3.6, 0, 0), (0, 3.7, 0.4), (9, 9, 9))])
    own = {r.rid: r.first_id for r in clustered(spark, points).members().collect()}
    near = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)) <= 1.5
    rows, cells = together(dense_clusters(near.astype(float))), together(np.array([own[i] for i in range(len(points))]))
    assert (rows & cells).sum() >= 0.9 * max(rows.sum(), cells.sum()), ((rows & cells).sum(), rows.sum(), cells.sum())
