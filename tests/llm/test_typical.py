from poregrid.llm.flow import PointClusters


def test_a_full_cluster_gives_as_many_typical_rows_as_asked(spark):
    rows = [("m", i, x, 0.1, 0.1) for i, x in ((1, 0.02), (2, 0.42), (3, 0.4), (4, 0.41), (5, 0.8), (6, 0.38))]  # one cell, centre of its first row at 0.02
    rows += [("m", 9, 50.0, 0.1, 0.1), ("m", 10, 50.1, 0.1, 0.1)]
    c = PointClusters(spark.createDataFrame(rows, "g string, rid bigint, x double, y double, z double"), "g", "rid", ["x", "y", "z"], 1.5)
    got = {r.first_id: r for r in c.describe().collect()}
    assert got[1]["size"] == 6 and list(got[1].typical_ids) == [3, 4, 2]
    assert sorted(got[9].typical_ids) == [9, 10]
