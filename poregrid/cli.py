"""Command line: tunnels of several simulations to superclusters, profiles and a report."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from poregrid.plans.pipeline import TransportProcesses
from poregrid.sources.text import EngineConfig, read_config, read_tunnels


def main(args: Sequence[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="poregrid", description=__doc__)
    parser.add_argument("tunnels", help="glob of the tunnel profile files, <simulation>/.../.../<file>")
    parser.add_argument("-c", "--config", help="settings as INI")
    parser.add_argument("-l", "--occurrence", type=int, default=1, help="least tunnels of a cluster")
    parser.add_argument("-o", "--report", help="file for the report; printed if not given")
    got = parser.parse_args(args)
    config = read_config(got.config) if got.config else EngineConfig()
    spark = SparkSession.builder.appName("poregrid").getOrCreate()
    number = F.element_at(F.split("snapshot", "\\" + config.snapshot_delimiter), config.snapshot_id_position + 1).cast("int")
    tunnels = read_tunnels(spark, got.tunnels).withColumn("snapshot_id", number)
    if got.occurrence > 1:
        from poregrid.operators.filters import occurring

        tunnels = tunnels.join(occurring(tunnels, got.occurrence).drop("n_tunnels"), ["md_label", "cluster_id"], "left_semi")
    run = TransportProcesses(spark, config, tunnels)
    run.merge_tunnel_clusters2super_clusters()
    run.create_super_cluster_profiles()
    report = run.report()
    Path(got.report).write_text(report) if got.report else print(report)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
