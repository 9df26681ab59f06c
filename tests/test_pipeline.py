from pyspark.sql import functions as F

from poregrid.plans.pipeline import TransportProcesses
from poregrid.sources.text import EngineConfig
from poregrid.streaming import profiles as stream


def test_profiles_end_to_end(spark, tmp_path):
    rows = []
    for m in ("a", "b"):
        for snap in range(1, 11):
            for cl, x in ((1, 0.0), (2, 0.4), (3, 25.0)):
                spheres = [(k, x * k / 6, 0.0, k * 1.0 + 0.01 * (snap % 3), float(k), 1.2, float(k)) for k in range(7)]
                rows.append((m, snap, cl, 1, 0.1 * cl, 1.2, 6.5, 1.1, spheres))
    schema = "md_label string, snapshot_id int, cluster_id int, tunnel_id int, throughput double, bottleneck_radius double, length double, curvature double, spheres array<struct<idx:int,x:double,y:double,z:double,dist:double,r:double,len:double>>"
    run = TransportProcesses(spark, EngineConfig(output_path=str(tmp_path / "r"), snapshots_per_simulation=10), spark.createDataFrame(rows, schema))
    member = {(r.md_label, r.cluster_id): r.sc_id for r in run.merge_tunnel_clusters2super_clusters().collect()}
    assert member["a", 1] == member["b", 1] == member["a", 2] and member["a", 3] == member["b", 3] != member["a", 1]
    best = run.create_super_cluster_profiles()
    assert best.count() == 40
    props = {r.sc_id: r for r in run.generate_super_cluster_summary().collect()}
    assert abs(props[member["a", 1]].priority - 0.4) < 1e-9 and abs(props[member["a", 3]].priority - 0.6) < 1e-9
    assert run.filter_super_cluster_profiles(min_radius=2).count() == 0
    series = run.get_property_time_evolution_data("throughput", sc_id=member["a", 3])
    assert series.count() == 20 and series.where("frame = 0").first().value > 0
    assert "Simulations: 2" in run.report()
    assert run.load_checkpoint("profile").count() == 40


def test_stream_of_new_files(spark, tmp_path):
    src = tmp_path / "in"
    days = spark.createDataFrame([("m", 1, 0.5, "2024-01-01 10:00:00"), ("m", 1, 0.7, "2024-01-01 11:00:00"), ("m", 1, None, "2024-01-09 00:00:00")], "md_traj string, tunnel_cluster int, throughput double, t string")
    days = days.select("md_traj", "tunnel_cluster", "throughput", F.to_timestamp("t").alias("loaded_at"))
    days.coalesce(1).write.parquet(str(src))
    rows = stream.bottleneck_stream(spark, str(src), days.schema, 1)
    stream.start(stream.windowed_profile(rows), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0].n_rows == 2 and abs(got[0].throughput_sum - 1.2) < 1e-9
