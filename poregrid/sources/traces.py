"""Ligand traces: archives of raw path dumps, read without running anything they contain."""

from __future__ import annotations

import io
import pickle
import re
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Drawing codes, and the colours that mark the kind of a segment.
COLOUR, VERTEX = 6.0, 4.0
KINDS = {(0.0, 0.5, 0.0): "inside", (0.75, 0.75, 0.0): "inside", (1.0, 0.0, 0.0): "entry", (0.0, 0.0, 1.0): "release"}


class PlainUnpickler(pickle.Unpickler):
    """Loads containers and numbers only: any class or function named by the input is refused, but for NumPy's number and array types."""

    ALLOWED = {
        ("numpy", "dtype"), ("numpy", "ndarray"), ("numpy.core.multiarray", "scalar"), ("numpy._core.multiarray", "scalar"),
        ("numpy.core.multiarray", "_reconstruct"), ("numpy._core.multiarray", "_reconstruct"),
    }

    def find_class(self, module, name):
        if (module, name) in self.ALLOWED:
            return super().find_class(module, name)
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed in a trace")


def flat(value) -> Iterator[float]:
    if isinstance(value, (list, tuple)):
        for v in value:
            yield from flat(v)
    else:
        yield float(value)


def decode(tokens) -> list[tuple[int, str, float, float, float]]:
    """Segment number, kind and point of each vertex of a drawing list.

    The two opening and the closing code are left out; a colour begins a segment, an unknown one
    keeps the kind before. A trace with neither entry nor release gives nothing.
    """
    body = list(flat(tokens))[2:-1]
    out, segment, kind = [], -1, "inside"
    for k in range(0, len(body) - 3, 4):
        code, *three = body[k : k + 4]
        if code == COLOUR:
            segment, kind = segment + 1, KINDS.get(tuple(three), kind)
        elif code == VERTEX:
            out.append((max(segment, 0), kind, *three))
    return out if any(o[1] != "inside" for o in out) else []


def read_traces(spark: SparkSession, path: str, folder_level: int = 2) -> DataFrame:
    """``md_label, path_no, segment, event_type, ord, x, y, z`` for each point of the archives' raw paths."""
    schema = "md_label string, path_no int, segment int, event_type string, ord int, x double, y double, z double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for label, content in zip(batch.md_label, batch.content):
                with tarfile.open(fileobj=io.BytesIO(content)) as archive:
                    for member in archive:
                        found = re.search(r"raw_paths_(\d+)\.dump$", member.name)
                        if found:
                            points = decode(PlainUnpickler(archive.extractfile(member)).load())
                            rows = [(label, int(found[1]), s, k, i, x, y, z) for i, (s, k, x, y, z) in enumerate(points)]
                            yield pd.DataFrame(rows, columns=["md_label", "path_no", "segment", "event_type", "ord", "x", "y", "z"])

    files = spark.read.format("binaryFile").load(path)
    label = F.element_at(F.split("path", "/"), -1 - folder_level).alias("md_label")
    return files.select(label, "content").mapInPandas(run, schema)
