"""Scans of the text formats of tunnel searches: profiles, bottlenecks, structures, event summaries, settings."""

from __future__ import annotations

import configparser
import fnmatch
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = {"X": "x", "Y": "y", "Z": "z", "distance": "dist", "length": "len", "R": "r"}


def _lines(spark: SparkSession, path: str, folder_level: int) -> DataFrame:
    """Lines with the simulation they come from: the folder ``folder_level`` levels above the file."""
    parts = F.split(F.col("_metadata.file_path"), "/")
    return spark.read.text(path).select(F.element_at(parts, -1 - folder_level).alias("md_label"), "value")


def read_tunnels(spark: SparkSession, path: str, folder_level: int = 3, with_md: bool = False) -> DataFrame:
    """Tunnel profiles: seven lines a tunnel, told apart by their keys and axis and not by their order.

    ``with_md``: the supercluster variant, whose first column is the simulation. Gives one row per
    tunnel with ``spheres`` as an array of structs; the line of upper limits is left out.
    """
    s = 1 if with_md else 0
    raw = _lines(spark, path, folder_level)
    cells = raw.select("md_label", F.transform(F.split("value", ","), lambda c: F.trim(c)).alias("c"))
    md = F.col("c")[0] if with_md else F.col("md_label")
    scalars = {"throughput": 3, "cost": 4, "bottleneck_radius": 5, "curvature": 9, "length": 10}
    rows = cells.where(F.col("c")[s + 12].isin(*AXES)).select(
        md.alias("md_label"), F.col("c")[s].alias("snapshot"), F.col("c")[s + 1].cast("int").alias("cluster_id"), F.col("c")[s + 2].cast("int").alias("tunnel_id"),
        *[F.col("c")[s + k].try_cast("double").alias(n) for n, k in scalars.items()], F.col("c")[s + 12].alias("axis"),
        F.transform(F.slice("c", s + 14, F.size("c")), lambda v: v.try_cast("double")).alias("v"),
    )
    keys = ["md_label", "snapshot", "cluster_id", "tunnel_id"]
    wide = rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col("axis") == "X", F.col(n))).alias(n) for n in scalars], *[F.first(F.when(F.col("axis") == a, F.col("v")), True).alias(n) for a, n in AXES.items()]
    )
    zipped = F.arrays_zip(*AXES.values())
    spheres = F.transform(zipped, lambda p, i: F.struct(i.alias("idx"), *[p[n].alias(n) for n in AXES.values()]))
    return wide.select(*keys, *scalars, spheres.alias("spheres"))


def read_bottlenecks(spark: SparkSession, path: str, folder_level: int = 3, with_md: bool = False) -> DataFrame:
    """Bottlenecks: snapshot, cluster, tunnel, throughput, cost, x, y, z, radius and any number of residues; headers are left out."""
    s = 1 if with_md else 0
    cells = _lines(spark, path, folder_level).select("md_label", F.transform(F.split("value", ","), lambda c: F.trim(c)).alias("c"))
    md = F.col("c")[0] if with_md else F.col("md_label")
    names = ["throughput", "cost", "bx", "by", "bz", "br"]
    return cells.where(F.get(F.col("c"), F.lit(s + 1)).try_cast("int").isNotNull()).select(
        md.alias("md_label"), F.col("c")[s].alias("snapshot"), F.col("c")[s + 1].cast("int").alias("cluster_id"), F.col("c")[s + 2].cast("int").alias("tunnel_id"),
        *[F.col("c")[s + 3 + k].try_cast("double").alias(n) for k, n in enumerate(names)],
        F.filter(F.slice("c", s + 10, F.size("c")), lambda r: r != "").alias("residues"),
    )


def read_atoms(spark: SparkSession, path: str, folder_level: int = 3, names: list[str] | None = None) -> DataFrame:
    """Atoms of structure files by the standard fixed columns."""
    line = F.col("value")
    field = lambda a, b: F.trim(F.substring(line, a, b - a + 1))
    atoms = _lines(spark, path, folder_level).where(line.startswith("ATOM") | line.startswith("HETATM")).select(
        "md_label", field(7, 11).try_cast("int").alias("serial"), field(13, 16).alias("atom_name"), field(18, 20).alias("resname"), field(22, 22).alias("chain"),
        field(23, 26).try_cast("int").alias("resid"), *[field(a, a + 7).try_cast("double").alias(n) for n, a in (("x", 31), ("y", 39), ("z", 47))],
    )
    return atoms.where(F.col("atom_name").isin(names)) if names else atoms


def read_event_summary(spark: SparkSession, path: str, folder_level: int = 2) -> DataFrame:
    """Rows of the section on separate paths of an event summary: path number, residue and frames, columns found by name."""
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1 - folder_level).alias("md_label"), "value")
    section = F.regexp_extract("value", r"(?s)List of separate paths and properties.*?\n(.*?)(?:\n[^\n]*-{80}[^\n]*\n\s*\n|\z)", 1)
    lines = whole.select("md_label", F.split(section, "\n").alias("l"))
    head = lines.select("md_label", "l", F.filter("l", lambda v: v.rlike(r"\bID\b.*\bBeginF\b"))[0].alias("h"))
    columns = F.split(F.trim("h"), r"\s+")
    rows = head.select("md_label", columns.alias("h"), F.posexplode("l").alias("pos", "v")).where(F.col("v").rlike(r"^\s*\d+\s+\d+:\d+:\d+\s"))
    cells = rows.select("md_label", "pos", "h", F.split(F.trim("v"), r"\s+").alias("c"))
    named = lambda n: F.get(F.col("c"), F.array_position("h", n).cast("int") - 1)
    return cells.select(
        "md_label", named("Nr").try_cast("int").alias("path_no"), named("ID").alias("path_id"), named("RES").alias("res_name"),
        *[named(n).try_cast("int").alias(a) for n, a in (("BeginF", "begin_f"), ("InpF", "inp_f"), ("OutF", "out_f"), ("EndF", "end_f"))],
    )


def one_match(root: str, pattern: str) -> str:
    """The one file under ``root`` that fits a glob; none or several are errors."""
    found = sorted(str(p) for p in Path(root).glob(pattern))
    if len(found) != 1:
        raise FileNotFoundError(f"{pattern} under {root}: {len(found)} matches, one is needed")
    return found[0]


def input_folders(root: str, pattern: str = "*") -> list[str]:
    """Names of the simulation folders, sorted."""
    return sorted(p.name for p in Path(root).glob(pattern) if p.is_dir())


@dataclass(frozen=True)
class EngineConfig:
    """Settings of a run, with the defaults the method was published with; -1 turns a limit off."""

    caver_results_path: str = ""
    caver_results_folder_pattern: str = "*"
    caver_results_relative_subfolder_path: str = ""
    caver_pdb_file_pattern: str = "*[0-9]*.pdb"
    aquaduct_results_path: str = ""
    aquaduct_results_folder_pattern: str = "*"
    aquaduct_results_relative_tarfile: str = ""
    aquaduct_results_relative_summaryfile: str = ""
    trajectory_path: str = ""
    trajectory_folder_pattern: str = "*"
    trajectory_relative_file: str = ""
    topology_relative_file: str = ""
    start_from_stage: int = 1
    stop_after_stage: int = 10
    pdb_reference_structure: str = ""
    layer_thickness: float = 1.5
    snapshots_per_simulation: int = 0
    caver_traj_offset: int = 1
    snapshot_id_position: int = 1
    snapshot_delimiter: str = "."
    process_bottleneck_residues: bool = False
    min_tunnel_radius4clustering: float = 0.75
    min_tunnel_length4clustering: float = 5.0
    max_tunnel_curvature4clustering: float = 2.0
    clustering_linkage: str = "complete"
    clustering_cutoff: float = 2.0
    calculate_exact_path_distances: bool = True
    min_length: float = -1.0
    max_length: float = -1.0
    min_bottleneck_radius: float = -1.0
    max_bottleneck_radius: float = -1.0
    min_curvature: float = -1.0
    max_curvature: float = -1.0
    min_sims_num: int = -1
    min_snapshots_num: int = -1
    min_avg_snapshots_num: float = -1.0
    event_min_distance: float = 6.0
    event_assignment_cutoff: float = 0.85
    ambiguous_event_assignment_resolution: str = "penetration_depth"
    min_transport_events: int = -1
    min_entry_events: int = -1
    min_release_events: int = -1
    output_path: str = "results"
    save_super_cluster_profiles_csvs: bool = False
    save_distance_matrix_csv: bool = False
    random_seed: int = 4
    directional_cutoff: float = 1.5707963267948966
    aqauduct_ligand_effective_radius: float = 1.0
    perform_exact_matching_analysis: bool = False
    folder_pattern4exact_matching_analysis: str = "*"
    perform_comparative_analysis: bool = False
    comparative_groups_definition: str = ""
    overwrite: bool = False
    clustering_max_num_rep_frag: int = 3
    use_cluster_spread: bool = True
    sp_radius: float = 0.5
    tunnel_properties_quantile: float = 0.90

    def __post_init__(self):
        limits = [f for f in self.__dataclass_fields__ if re.match("(min|max)_.*", f) and "4clustering" not in f]
        checks = {
            "start_from_stage and stop_after_stage must be from 0 to 10, the first not above the second": 0 <= self.start_from_stage <= self.stop_after_stage <= 10,
            "layer_thickness must be at least 0.9": self.layer_thickness >= 0.9,
            "snapshots_per_simulation must not be negative": self.snapshots_per_simulation >= 0,
            "caver_traj_offset must be 0 or 1": self.caver_traj_offset in (0, 1),
            "snapshot_id_position must not be negative": self.snapshot_id_position >= 0,
            "min_tunnel_radius4clustering and min_tunnel_length4clustering must not be negative": min(self.min_tunnel_radius4clustering, self.min_tunnel_length4clustering) >= 0,
            "max_tunnel_curvature4clustering must be at least 1": self.max_tunnel_curvature4clustering >= 1,
            "event_assignment_cutoff must be from 0 to 1": 0 <= self.event_assignment_cutoff <= 1,
            "event_min_distance, aqauduct_ligand_effective_radius and sp_radius must not be negative": min(self.event_min_distance, self.aqauduct_ligand_effective_radius, self.sp_radius) >= 0,
            "clustering_cutoff must not be negative": self.clustering_cutoff >= 0,
            "tunnel_properties_quantile must be from 0 to 1": 0 <= self.tunnel_properties_quantile <= 1,
            "directional_cutoff must be from 0 to pi": 0 <= self.directional_cutoff <= 3.1415926536,
            f"clustering_linkage must be one of {', '.join(LINKAGES)}": self.clustering_linkage in LINKAGES,
            f"ambiguous_event_assignment_resolution must be one of {', '.join(RESOLUTIONS)}": self.ambiguous_event_assignment_resolution in RESOLUTIONS,
        }
        checks |= {f"{f} must be -1 or at least 0": getattr(self, f) == -1 or getattr(self, f) >= 0 for f in limits}
        for message, ok in checks.items():
            if not ok:
                raise ValueError(message)

    def groups(self, simulations: list[str]) -> list[tuple[str, str]]:
        """Simulation and group of ``comparative_groups_definition``, as in ``wild: [md1, md2]; mutant: [mut*]``.

        A name that fits no simulation, and a simulation in two groups, are errors.
        """
        found: dict[str, str] = {}
        for part in filter(None, (p.strip() for p in self.comparative_groups_definition.split(";"))):
            name, listed = re.fullmatch(r"\s*([^:\[\]]+?)\s*:\s*\[([^\[\]]*)\]\s*", part).groups() if "[" in part else (part, "")
            for pattern in filter(None, (v.strip() for v in listed.split(","))):
                own = [s for s in simulations if fnmatch.fnmatchcase(s, pattern)]
                if not own:
                    raise ValueError(f"{pattern} of group {name} fits no simulation")
                for s in own:
                    if found.setdefault(s, name) != name:
                        raise ValueError(f"{s} is in two groups")
        return sorted(found.items())


#: Sections of a settings file; which of them holds a setting does not matter.
SECTIONS = ("INPUT_PATHS", "CALCULATIONS_SETTINGS", "OUTPUT_SETTINGS", "ADVANCED_SETTINGS", "internal_settings")
LINKAGES = ("single", "complete", "average", "weighted", "ward", "centroid", "median")
RESOLUTIONS = ("penetration_depth", "exact_matching", "assign2all")
#: Settings of drawing and of other engines; accepted in a file and without effect here.
NO_EFFECT = re.compile(r"visualize_.*|.*4visualization|num_cpus|n_jobs_per_cpu_batch|pickle_protocol|trajectory_engine|msms.*")


def read_config(path: str) -> EngineConfig:
    """Settings from an INI file; values are converted by the type of their default.

    ``None`` as a value leaves the default. Keys and sections that are not known are errors, and so are values
    of another type; settings of drawing are accepted and have no effect.
    """
    parser = configparser.ConfigParser()
    parser.read_string(Path(path).read_text())
    types = {k: type(f.default) for k, f in EngineConfig.__dataclass_fields__.items()}
    values = {}
    for section in parser.sections():
        if section not in SECTIONS:
            raise ValueError(f"{path}: unknown section {section}")
        for key, text in parser[section].items():
            if key not in types and not NO_EFFECT.fullmatch(key):
                raise ValueError(f"{path}: {key} is no setting")
            if key in types and text.strip() not in ("None", ""):
                kind = types[key]
                try:
                    values[key] = parser[section].getboolean(key) if kind is bool else kind(text)
                except ValueError as error:
                    raise ValueError(f"{path}: {key} = {text} is no {kind.__name__}") from error
    return EngineConfig(**values)


def config_template() -> str:
    """A settings file with every setting at its default."""
    shown = {k: f.default for k, f in EngineConfig.__dataclass_fields__.items()}
    return "[CALCULATIONS_SETTINGS]\n" + "".join(f"{k} = {'None' if v == '' else v}\n" for k, v in shown.items())
