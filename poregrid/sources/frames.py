"""Trajectory frames: the table a reader has to give, and their superposition on a reference structure."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from poregrid.kernels.align import superpose

#: What a reader of trajectories gives: one row per atom of a frame, in the unit of the structures.
FRAME_SCHEMA = "md_label string, frame int, atom_idx int, atom_name string, resname string, resid int, x double, y double, z double"


def superposed(frames: DataFrame, reference: Sequence[tuple[int, float, float, float]], atom_name: str = "CA") -> DataFrame:
    """Each frame laid on the reference (``resid, x, y, z`` of its ``atom_name`` atoms) by the residues both have.

    A frame is one group, bounded by the size of the structure. A frame that shares fewer than three
    residues with the reference is an error.
    """
    known = {r[0]: r[1:] for r in reference}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[(pdf.atom_name == atom_name) & pdf.resid.isin(known)].drop_duplicates("resid").sort_values("resid")
        if len(own) < 3:
            raise ValueError(f"frame {pdf.frame.iloc[0]} shares {len(own)} residues with the reference")
        matrix, _ = superpose(own[["x", "y", "z"]].to_numpy(), np.array([known[r] for r in own.resid], dtype=float))
        moved = pdf[["x", "y", "z"]].to_numpy() @ matrix[:3, :3].T + matrix[:3, 3]
        return pdf.assign(x=moved[:, 0], y=moved[:, 1], z=moved[:, 2])

    return frames.groupBy("md_label", "frame").applyInPandas(run, FRAME_SCHEMA)
