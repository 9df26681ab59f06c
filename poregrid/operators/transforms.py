"""Simulations in one frame: superposition on a reference structure, common origin, orientation."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poregrid.functions.geometry import affine, layer, norm
from poregrid.kernels import align

# Residue names and their letters, with the names that force fields give to protonation states.
LETTERS = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
    "HID": "H", "HIE": "H", "HIP": "H", "CYX": "C", "CYM": "C", "ASH": "D", "GLH": "E", "LYN": "K",
}


def plain_score(a: str, b: str) -> float:
    return 5.0 if a == b else -4.0


def read_matrix(path: str) -> Callable[[str, str], float]:
    """A substitution matrix in the usual text form: a line of letters, then a row of numbers for each letter."""
    rows = [line.split() for line in open(path) if line.strip() and not line.startswith("#")]
    known = {(r[0], c): float(v) for r in rows[1:] for c, v in zip(rows[0], r[1:])}
    return lambda a, b: known[a, b]


def alpha_carbons(structures: DataFrame) -> DataFrame:
    """``md_label, ca``: the alpha carbons of each simulation's known residues in order of chain and number, as ``letter, x, y, z``.

    Other residues and atoms are left out; of several atoms of a residue the one of the lowest serial counts.
    """
    known = F.create_map(*[F.lit(v) for pair in LETTERS.items() for v in pair])
    own = structures.where((F.col("atom_name") == "CA") & F.col("resname").isin(list(LETTERS)) & F.col("resid").isNotNull())
    first = own.groupBy("md_label", "chain", "resid").agg(F.min(F.struct("serial", "resname", "x", "y", "z")).alias("a"))
    atom = F.struct("chain", "resid", known[F.col("a.resname")].alias("letter"), F.col("a.x").alias("x"), F.col("a.y").alias("y"), F.col("a.z").alias("z"))
    return first.groupBy("md_label").agg(F.array_sort(F.collect_list(atom)).alias("ca"))


def superposition(moving: Sequence, fixed: Sequence, score=plain_score, without_first: bool = False) -> np.ndarray:
    """The transform that lays aligned residues of ``moving`` on ``fixed`` (letter, x, y, z each), far ones rejected.

    ``without_first`` leaves out the first residue of both, as tools do that count aligned residues from 1
    and atoms from 0.
    """
    pairs = align.global_alignment("".join(a[0] for a in moving), "".join(a[0] for a in fixed), score)
    pairs = [(i, j) for i, j in pairs if not without_first or (i and j)]
    if len(pairs) < 3:
        raise ValueError(f"only {len(pairs)} aligned residues")
    one, two = (np.array([side[k][1:] for k in index], dtype=float) for side, index in ((moving, [i for i, _ in pairs]), (fixed, [j for _, j in pairs])))
    return align.superpose_rejecting(one, two)[0]


def compute(structures: DataFrame, starts: DataFrame, reference: str | None = None, score=plain_score, without_first: bool = False) -> DataFrame:
    """``md_label, m, m_inv`` (16 numbers by row): each simulation laid on the reference, the mean starting point at the origin, turned.

    ``structures``: md_label, chain, resid, resname, atom_name, serial, x, y, z; ``starts``: md_label, x, y, z, any
    number for each simulation. The common origin is the mean of the simulations' own mean starting points
    after superposition, each counted once. The reference (the first by name unless given) also gives the
    orientation. One structure is a task's largest group. Simulations without a start or a structure give no row.
    """
    carbons = alpha_carbons(structures)
    chosen = carbons.where(F.col("md_label") == reference) if reference else carbons.orderBy("md_label").limit(1)
    found = chosen.first()
    if found is None:
        raise ValueError("no reference structure")
    fixed = [(a.letter, a.x, a.y, a.z) for a in found.ca]
    mean = starts.groupBy("md_label").agg(*[F.avg(c).alias(f"s{c}") for c in "xyz"])

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [superposition([(a["letter"], a["x"], a["y"], a["z"]) for a in ca], fixed, score, without_first) for ca in pdf.ca]
            yield pd.DataFrame({"md_label": pdf.md_label, "m": [v.reshape(-1).tolist() for v in own]})

    laid = carbons.mapInPandas(lay, "md_label string, m array<double>").join(mean, "md_label").cache()
    moved = affine(F.col("m"), [F.col(f"s{c}") for c in "xyz"])
    centre = laid.agg(*[F.avg(v).alias(c) for v, c in zip(moved, "xyz")]).first()
    if centre.x is None:
        raise ValueError("no simulation has both a structure and a starting point")
    shift = align.translation([-centre.x, -centre.y, -centre.z])
    turn = align.canonical_orientation(np.array([a[1:] for a in fixed], dtype=float) + shift[:3, 3])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            whole = [turn @ shift @ np.array(m).reshape(4, 4) for m in pdf.m]
            yield pd.DataFrame({"md_label": pdf.md_label, "m": [v.reshape(-1).tolist() for v in whole], "m_inv": [np.linalg.inv(v).reshape(-1).tolist() for v in whole]})

    return laid.select("md_label", "m").mapInPandas(finish, "md_label string, m array<double>, m_inv array<double>")


def move(points: DataFrame, transforms: DataFrame, key: str = "md_label", inverse: bool = False) -> DataFrame:
    """``points`` with x, y, z in the common frame (or back from it); points of simulations without a transform are left out."""
    m = transforms.select(key, F.col("m_inv" if inverse else "m").alias("_m"))
    placed = [c.alias(n) for c, n in zip(affine(F.col("_m"), [F.col(c) for c in "xyz"]), "xyz")]
    joined = points.join(m, key)
    return joined.select(*[c for c in points.columns if c not in "xyz"], *placed).select(*points.columns)


def apply(nodes: DataFrame, transforms: DataFrame, key: str = "md_label", thickness: float = 1.5, entity: Sequence[str] = ("cluster_id",)) -> DataFrame:
    """Nodes in the common frame. A node whose distance from the common origin puts it in another layer goes there,
    unless it is the only one of its layer; labels stay."""
    moved = move(nodes, transforms, key)
    own = [key, *[c for c in entity if c in nodes.columns], "layer"]
    alone = F.count(F.lit(1)).over(Window.partitionBy(*own)) == 1
    new = F.when(alone | (F.col("layer") < 0), F.col("layer")).otherwise(layer(norm([F.col(c) for c in "xyz"]), thickness))
    return moved.withColumn("_new", new).withColumn("layer", F.col("_new").cast(nodes.schema["layer"].dataType)).drop("_new")
