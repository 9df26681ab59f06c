"""Scans, sinks and small operators that no query over the test tables reaches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from poregrid.functions import geometry as G
from poregrid.kernels import cluster
from poregrid.operators import assign, filters, nodes, superclusters, transforms
from poregrid.sinks import reports
from poregrid.sources import text

SUMMARY = """Some report
List of separate paths and properties

 Nr    ID   RES  BeginF  InpF  ObjF  OutF  EndF
---------------------------------------------
  1  0:326:0  WAT   10   5   20   7   41
  2  0:12:1   HOH    0   3    9   2   13
{}

  3  0:99:1   WAT    0   3    9   2   13
""".format("-" * 80)


def test_event_summary(spark, tmp_path):
    d = tmp_path / "md7" / "aq"
    d.mkdir(parents=True)
    (d / "5_analysis_results.txt").write_text(SUMMARY)
    got = text.read_event_summary(spark, str(d / "*.txt"), folder_level=2).orderBy("path_no").collect()
    assert [tuple(r) for r in got] == [("md7", 1, "0:326:0", "WAT", 10, 5, 7, 41), ("md7", 2, "0:12:1", "HOH", 0, 3, 2, 13)]


def test_folders_and_single_matches(tmp_path):
    for name in ("md2", "md1", "other"):
        (tmp_path / name).mkdir()
    (tmp_path / "md1" / "a.csv").write_text("")
    assert text.input_folders(str(tmp_path), "md*") == ["md1", "md2"]
    assert text.one_match(str(tmp_path), "md1/*.csv").endswith("a.csv")
    (tmp_path / "md1" / "b.csv").write_text("")
    for pattern in ("md1/*.csv", "md2/*.csv"):
        with pytest.raises(FileNotFoundError):
            text.one_match(str(tmp_path), pattern)


def test_lines_of_text(spark):
    nodes_ = spark.createDataFrame([("c1", 3, 2, -100.0, 20.5, 3.25, 1.4)], "entity string, node_no int, layer int, x double, y double, z double, radius double")
    line = reports.structure_lines(nodes_).first().line
    assert line[30:54] == "-100.000  20.500   3.250" and line[6:11].strip() == "3" and line[22:26].strip() == "2"
    rows = spark.createDataFrame([(1, "m", "s.1.pdb", 2, 1, 0.5, 0.69, 1.0, 2.0, 3.0, 1.1, ["12", "ALA3"])], "sc_id int, md_label string, snapshot string, cluster_id int, tunnel_id int, throughput double, cost double, bx double, by double, bz double, br double, residues array<string>")
    assert reports.bottleneck_lines(rows).first().line == "m,s.1.pdb,2,1,0.5,0.69,1.0,2.0,3.0,1.1,12,ALA3"
    freq = spark.createDataFrame([(1, "A", 0.5), (1, "B", 0.5), (1, "C", 0.75), (2, None, None)], "sc_id int, residue string, freq double")
    assert {r.sc_id: r.line for r in reports.residue_report(freq).collect()} == {1: "C:0.750, B:0.500, A:0.500", 2: "---"}
    found = spark.createDataFrame([("e", 7, 1.0, 2.0, 3.0, -0.25, 4, 1.5, 2.5, 3.5, 1.1)], "ev string, frame int, x double, y double, z double, dist double, tunnel_cluster int, sphere_x double, sphere_y double, sphere_z double, sphere_r double")
    assert reports.match_lines(found, ["ev"]).first().line == "7, 1.000, 2.000, 3.000, -0.250, 4, 1.500, 2.500, 3.500, 1.100"


def test_drawing_codes(spark):
    df = spark.createDataFrame([([(1.0, 2.0, 3.0), (4.0, 5.0, 6.0)],)], "p array<struct<x:double,y:double,z:double>>")
    assert df.select(G.opcodes(F.col("p")).alias("c")).first().c == [2.0, 3.0, 4.0, 1.0, 2.0, 3.0, 4.0, 4.0, 5.0, 6.0, 3.0]


def test_strict_join_and_sets_that_may_not_mix(spark):
    keys = ["md", "frame"]
    t = spark.createDataFrame([("a", 1)], "md string, frame int")
    assert assign.strict_join(t.withColumn("r", F.lit(1)), t, keys).count() == 1
    with pytest.raises(Exception, match="bottleneck without a tunnel"):
        assign.strict_join(spark.createDataFrame([("a", 2, 1)], "md string, frame int, r int"), t, keys).collect()
    one, two = (spark.createDataFrame([(k, "n")], "kind string, node string") for k in ("tunnel", "event"))
    assert nodes.union_sets(one, one).count() == 2
    with pytest.raises(ValueError):
        nodes.union_sets(one, two)


def test_approximate_equality(spark):
    one = spark.createDataFrame([(1, 1.0, "a"), (2, 1.0, "a"), (3, None, None), (4, float("nan"), "x"), (5, 1.0, "a"), (6, 1.0, "a"), (6, 1.0, "a"), (None, 1.0, "a")], "k int, v double, s string")
    two = spark.createDataFrame([(1, 1.0005, "a"), (2, 1.01, "a"), (3, None, None), (4, float("nan"), "y"), (6, 1.0, "a"), (7, 1.0, "a"), (None, 1.0, "a")], "k int, v double, s string")
    got = {r.k: r.reason for r in filters.approx_equal(one, two, ["k"]).collect()}
    assert got == {2: "v", 4: "s", 5: "only in the first", 6: "another number of rows", 7: "only in the second"}


def test_outliers_are_isolated():
    rng = np.random.default_rng(3)
    points = np.vstack([rng.normal(0, 0.3, (100, 3)), [[9.0, 9, 9], [-9, 8, 7]]])
    flags = cluster.isolation_outliers(points)
    assert flags[100:].all() and flags[:100].mean() < 0.3


def test_density_of_a_large_layer_needs_no_matrix():
    rng = np.random.default_rng(4)
    points = np.vstack([rng.normal(c, 0.6, (1500, 3)) for c in (0, 12)])
    labels = cluster.density_clusters(points, 30, 15)
    assert set(labels[:1500]) - {-1} != set(labels[1500:]) - {-1} and max(len(set(labels[:1500]) - {-1}), 1) == 1


def test_space_of_a_supercluster(spark):
    rows = [(1, "a", 1, "0_1", 0, 0.0, 0.0, 1.0, 1.0, 0.1, False), (1, "b", 1, "0_1", 0, 0.1, 0.0, 1.0, 1.2, 0.2, False), (1, "a", 1, "1_1", 1, 0.0, 0.0, 3.0, 1.0, 0.1, True), (1, "b", 1, "1_1", 1, 5.0, 0.0, 3.0, 1.0, 0.1, True)]
    n = spark.createDataFrame(rows, "sc_id int, md_label string, cluster_id int, node string, layer int, x double, y double, z double, radius double, rmsf double, is_end boolean")
    p = spark.createDataFrame([(1, "a", 1, ["SP", "0_1", "1_1"]), (1, "b", 1, ["SP", "0_1", "1_1"])], "sc_id int, md_label string, cluster_id int, nodes array<string>")
    own, depths, ways = superclusters.space(n, p, ["md_label", "cluster_id"])
    found = {r.node: r for r in own.collect()}
    assert set(found) == {"SP", "merged-0_1", "merged-1_1", "merged-1_2"} and found["merged-0_1"].radius == 1.2 and abs(found["merged-0_1"].x - 0.05) < 1e-9
    assert {r.node: round(r.depth, 3) for r in depths.collect()} == {"SP": 1.0, "merged-0_1": 0.5, "merged-1_1": 0.333, "merged-1_2": 0.333}
    assert ways.first().x == 2.5


def test_substitution_matrix(tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("# own scores\n   A  C\nA  4 -1\nC -1  9\n")
    score = transforms.read_matrix(str(path))
    assert score("A", "C") == -1 and score("C", "C") == 9


def test_intermediate_tables_can_be_removed(spark):
    from poregrid.session import drop_tables, materialize

    kept = materialize(spark.range(3), "some")
    assert kept.count() == 3
    path = kept.inputFiles()[0]
    drop_tables(spark)
    assert not reports.stage_exists(spark, path.rsplit("/", 1)[0])
    assert materialize(spark.range(2), "some").count() == 2
