"""Sinks: profiles and bottlenecks as text per supercluster, stage tables, distance matrix and statistics reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = (("X", "x"), ("Y", "y"), ("Z", "z"), ("distance", "dist"), ("length", "len"), ("R", "r"))
LIMITS = "Upper limit of R overestimation"


def write_stage(df: DataFrame, path: str, partition: str | None = "md_label", overwrite: bool = False) -> None:
    """A stage's table as Parquet; an existing one is an error unless it may be overwritten."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def stage_exists(spark: SparkSession, path: str) -> bool:
    """Whether a stage's table was written to the end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def remove_stages(spark: SparkSession, folder: str, stages: Sequence[str]) -> None:
    """Deletes the tables of ``stages`` below ``folder`` and nothing else."""
    for stage in stages:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{stage}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def profile_lines(tunnels: DataFrame) -> DataFrame:
    """``sc_id, line``: seven lines a tunnel, in the order of the axes."""
    values = lambda n: F.array_join(F.transform("spheres", lambda s: s[n].cast("string")), ",")
    lines = [F.struct(F.lit(k).alias("k"), F.lit(a).alias("axis"), values(n).alias("v")) for k, (a, n) in enumerate(AXES)]
    dashes = F.array_join(F.transform("spheres", lambda _: F.lit("-")), ",")
    lines.append(F.struct(F.lit(len(AXES)).alias("k"), F.lit(LIMITS).alias("axis"), dashes.alias("v")))
    scalars = ["md_label", "snapshot", "cluster_id", "tunnel_id", "throughput", "cost", "bottleneck_radius"]
    long = tunnels.select("*", F.explode(F.array(*lines)).alias("l"))
    blank = [F.lit("-")] * 3
    return long.select(
        "sc_id", "md_label", "snapshot", "cluster_id", "tunnel_id", F.col("l.k").alias("k"),
        F.concat_ws(",", *scalars, *blank, "curvature", "length", F.lit(""), "l.axis", "l.v").alias("line"),
    )


def bottleneck_lines(rows: DataFrame) -> DataFrame:
    """``sc_id, line`` of the bottlenecks of each supercluster."""
    named = ["md_label", "snapshot", "cluster_id", "tunnel_id", "throughput", "cost", "bx", "by", "bz", "br"]
    return rows.select("sc_id", *named[:4], F.concat_ws(",", *named, F.array_join("residues", ",")).alias("line"))


def write_lines(lines: DataFrame, path: str, order: Sequence[str], overwrite: bool = False) -> None:
    """One folder of text per supercluster, its lines in order within each file.

    Rows are spread by supercluster and simulation, so a large supercluster becomes several files.
    """
    spread = lines.repartition("sc_id", "md_label").sortWithinPartitions("sc_id", *order)
    spread.select("sc_id", "line").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("sc_id").text(path)


def distance_matrix(pairs: DataFrame, labels: Sequence[str], far: float = 999.0) -> str:
    """The square matrix of ``i, j, dist`` as text; the clusters are those of one linkage, so few."""
    known = {(r.i, r.j): r.dist for r in pairs.collect()}
    rows = [", ".join(["", *labels])]
    for i, label in enumerate(labels):
        cells = (0.0 if i == j else known.get((min(i, j), max(i, j)), far) for j in range(len(labels)))
        rows.append(", ".join([label, *(f"{v:.3f}" for v in cells)]))
    return "\n".join(rows) + "\n"


FORMATS = {
    "sc_id": "{:d}", "num_md_sims": "{:d}", "num_snaps": "{:d}", "avg_snaps": "{:.1f}", "radii_avg": "{:.3f}", "radii_std": "{:.3f}", "radii_max": "{:.3f}",
    "length_avg": "{:.3f}", "length_std": "{:.3f}", "curvature_avg": "{:.3f}", "curvature_std": "{:.3f}", "throughput_avg": "{:.5f}",
    "throughput_std": "{:.5f}", "priority": "{:.5f}", "num_events": "{:d}", "num_entries": "{:d}", "num_releases": "{:d}",
}


def statistics_report(props: DataFrame, preamble: Sequence[str] = (), most: int = 1_000_000, outliers: dict[str, int] | None = None) -> str:
    """A padded table of one row per supercluster in order of priority; a missing figure is ``-``.

    ``outliers``: numbers of the events that belong to none, on a last line below their columns.
    """
    columns = [c for c in FORMATS if c in props.columns]
    rows = props.orderBy(F.desc("priority"), F.desc("sc_id")).select(*columns).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} superclusters in a report")
    cells = [[FORMATS[c].format(r[c]) if r[c] is not None else "-" for c in columns] for r in rows]
    widths = [max(len(x) for x in col) for col in zip(columns, *cells)]
    if outliers is not None:
        at = [c for c in columns if c in outliers]
        head = "events of no supercluster"
        cells.append([head if k == 0 else str(outliers[c]) if c in at else "" for k, c in enumerate(columns)])
        widths = [max(w, len(x)) for w, x in zip(widths, cells[-1])]
    table = [", ".join(x.rjust(w) for x, w in zip(row, widths)) for row in [columns, *cells]]
    return "\n".join([*preamble, *table]) + "\n"


def residue_report(freq: DataFrame) -> DataFrame:
    """``sc_id, line``: residues with their frequency, by frequency and name falling; ``---`` if there are none."""
    items = F.sort_array(F.collect_list(F.struct(F.round("freq", 3).alias("f"), "residue")), asc=False)
    text = F.array_join(F.transform("i", lambda s: F.concat(s.residue, F.lit(":"), F.format_number(s.f, 3))), ", ")
    got = freq.groupBy("sc_id").agg(F.filter(items, lambda s: s.residue.isNotNull()).alias("i"))
    return got.select("sc_id", F.when(F.size("i") > 0, text).otherwise("---").alias("line"))


def cluster_details(membership: DataFrame) -> DataFrame:
    """``sc_id, line``: of each supercluster the number of simulations and clusters, and the clusters of each simulation."""
    per = membership.groupBy("sc_id", "md_label").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("cluster_id")), lambda c: c.cast("string")), ", ").alias("ids"))
    items = F.transform(F.array_sort(F.collect_list(F.struct("md_label", "ids"))), lambda s: F.concat(F.lit("from "), s.md_label, F.lit(": "), s.ids))
    head = F.concat(F.lit("simulations "), F.count(F.lit(1)).cast("string"), F.lit(", clusters "), F.sum("n").cast("string"), F.lit("; "))
    return per.groupBy("sc_id").agg(F.concat(head, F.array_join(items, "; ")).alias("line"))


def event_details(assigned: DataFrame) -> DataFrame:
    """``sc_id, event_type, md_label, n_events, line``: the events of each simulation, in order."""
    number = "path_no" if "path_no" in assigned.columns else "path_id"
    ids = F.transform(F.array_sort(F.collect_list(number)), lambda c: c.cast("string"))
    return assigned.groupBy("sc_id", "event_type", "md_label").agg(F.count(F.lit(1)).alias("n_events"), F.array_join(ids, ", ").alias("line"))


def match_lines(found: DataFrame, event: Sequence[str]) -> DataFrame:
    """``event columns, frame, line``: the table of matches of an event, a line for each frame with a tunnel."""
    shown = ["x", "y", "z", "dist", "tunnel_cluster", "sphere_x", "sphere_y", "sphere_z", "sphere_r"]
    cells = [F.format_string("%d", "frame"), *[F.format_string("%d", c) if c == "tunnel_cluster" else F.format_string("%.3f", c) for c in shown]]
    return found.select(*event, "frame", F.concat_ws(", ", *cells).alias("line"))


def structure_lines(nodes: DataFrame) -> DataFrame:
    """``entity, line``: nodes as fixed-width atom records (the layer as residue number, the radius as B factor)."""
    number = F.col("node_no").cast("int")
    line = F.format_string("HETATM%5d  H   FIL T%4d    %8.3f%8.3f%8.3f  1.00%6.2f", number, F.col("layer").cast("int"), "x", "y", "z", "radius")
    return nodes.select("entity", "node_no", line.alias("line"))


def export_ranked(tunnels: DataFrame, ranks: DataFrame, path: str, overwrite: bool = False) -> None:
    """Profiles in the format of the tunnel search, clusters renumbered by ``ranks`` (md_label, cluster_id, new_id).

    One folder per simulation; tunnels of unranked clusters are left out.
    """
    renumbered = tunnels.join(ranks.select("md_label", "cluster_id", "new_id"), ["md_label", "cluster_id"])
    lines = profile_lines(renumbered.withColumn("cluster_id", F.col("new_id")).withColumn("sc_id", F.lit(0)))
    bare = lines.withColumn("line", F.expr("substring(line, instr(line, ',') + 1)"))  # without the leading simulation
    spread = bare.repartition("md_label", "snapshot").sortWithinPartitions("md_label", "snapshot", "cluster_id", "tunnel_id", "k")
    spread.select("md_label", "line").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("md_label").text(path)


def renumbered_bottlenecks(rows: DataFrame, tunnels: DataFrame, ranks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bottlenecks of the ranked clusters under their new numbers, and the exported tunnels that have no bottleneck.

    Both are matched by simulation, snapshot, cluster and tunnel.
    """
    key = ["md_label", "snapshot", "cluster_id", "tunnel_id"]
    wanted = tunnels.select(*key).distinct().join(ranks.select("md_label", "cluster_id", "new_id"), ["md_label", "cluster_id"])
    matched = rows.join(wanted, key).withColumn("cluster_id", F.col("new_id")).drop("new_id")
    return matched, wanted.join(rows.select(*key), key, "left_anti")


def export_bottlenecks(rows: DataFrame, tunnels: DataFrame, ranks: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Writes the bottlenecks of the ranked clusters, one folder per simulation; returns the tunnels that have none."""
    matched, missing = renumbered_bottlenecks(rows, tunnels, ranks)
    lines = bottleneck_lines(matched.withColumn("sc_id", F.lit(0)))
    bare = lines.withColumn("line", F.expr("substring(line, instr(line, ',') + 1)"))
    spread = bare.repartition("md_label", "snapshot").sortWithinPartitions("md_label", "snapshot", "cluster_id", "tunnel_id")
    spread.select("md_label", "line").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("md_label").text(path)
    return missing
