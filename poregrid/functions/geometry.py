"""Geometry of points, spheres and nodes as column expressions (no Python at run time)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]
#: Label that stands for the starting point, and the parts a label without numbers is read as.
START_LABEL, NO_LABEL = "SP", -99


def affine(matrix: Sequence[float] | Column, point: Vector) -> list[Column]:
    """A 4x4 row-major matrix (16 numbers, or an array column of 16) applied to the point (x, y, z, 1)."""
    m = [matrix[k] for k in range(12)] if isinstance(matrix, Column) else [F.lit(float(v)) for v in matrix[:12]]
    return [m[4 * r] * point[0] + m[4 * r + 1] * point[1] + m[4 * r + 2] * point[2] + m[4 * r + 3] for r in range(3)]


def rigid_inverse(matrix: Sequence[float]) -> list[float]:
    """The inverse of a 4x4 row-major affine matrix."""
    import numpy as np

    return np.linalg.inv(np.array(matrix, dtype=float).reshape(4, 4)).reshape(-1).tolist()


def norm(v: Vector) -> Column:
    return F.sqrt(sum((c * c for c in v[1:]), v[0] * v[0]))


def distance(a: Vector, b: Vector) -> Column:
    return norm([p - q for p, q in zip(a, b)])


def surface_distance(a: Vector, b: Vector, *radii: Column) -> Column:
    """Distance of the centres less the radii: of a point and a sphere, or of two spheres."""
    return distance(a, b) - sum(radii[1:], radii[0])


def relaxed_distance(a: Vector, b: Vector, ra: Column, rb: Column, sa: Column, sb: Column, cap: float = 3.0) -> Column:
    """Surface distance less the mean spread of both nodes, at most ``cap``."""
    return surface_distance(a, b, ra, rb) - F.least((sa + sb) / 2, F.lit(cap))


def layer(dist: Column, thickness: float) -> Column:
    """The shell around the starting point: ceil(ceil(d) / thickness) - 1, at least 0."""
    if thickness <= 0:
        raise ValueError("layer thickness must be positive")
    return F.greatest(F.lit(0), F.ceil(F.ceil(dist) / F.lit(float(thickness))) - 1).cast("int")


def angle(a: Vector, b: Vector) -> Column:
    """The angle between two 3-vectors, from 0 to pi."""
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return F.atan2(norm(cross), a[0] * b[0] + a[1] * b[1] + a[2] * b[2])


def spherical(v: Vector) -> tuple[Column, Column, Column]:
    """Radius, polar angle from the z axis, azimuth."""
    return norm(v), F.atan2(F.sqrt(v[0] * v[0] + v[1] * v[1]), v[2]), F.atan2(v[1], v[0])


def aligned(a: Vector, b: Vector, cutoff: float) -> Column:
    """Whether two directions are within ``cutoff`` (inclusive)."""
    return angle(a, b) <= cutoff


def node_label(layer_id: Column, cluster: Column) -> Column:
    return F.concat_ws("_", layer_id.cast("string"), cluster.cast("string"))


def label_parts(label: Column) -> tuple[Column, Column]:
    """Layer and cluster of a node label; -99 for parts that are no number."""
    parts = F.split(label, "_")
    return tuple(F.coalesce(F.get(parts, F.lit(k)).try_cast("int"), F.lit(NO_LABEL)) for k in (0, 1))


def extended_label(md: Column, entity: Column, node: Column) -> Column:
    """``md-entity-node``; a label that was already merged stays as it is."""
    return F.when(node.startswith("merged"), node).otherwise(F.concat_ws("-", md, entity.cast("string"), node))


def squeeze(nodes: Column) -> Column:
    """A path without consecutive repeats."""
    return F.filter(nodes, lambda v, i: (i == 0) | (v != F.get(nodes, i - 1)))


def sphere_distances(spheres: Column) -> Column:
    """Spheres with ``dist`` replaced by the distance from the origin."""
    return F.transform(spheres, lambda s: s.withField("dist", F.sqrt(s.x * s.x + s.y * s.y + s.z * s.z)))


def frame_window(event: str, begin: Column, inside: Column, outside: Column, end: Column) -> tuple[Column, Column]:
    """First and last frame of the entry (begin, begin + inside) or the release (end - outside, end) of a path."""
    if event == "entry":
        return begin, begin + inside
    if event == "release":
        return end - outside, end
    raise ValueError("event must be entry or release")


def opcodes(points: Column) -> Column:
    """Drawing codes of a polyline: begin a line strip, a vertex per point, end."""
    vertices = F.flatten(F.transform(points, lambda p: F.array(F.lit(4.0), p.x, p.y, p.z)))
    return F.concat(F.array(F.lit(2.0), F.lit(3.0)), vertices, F.array(F.lit(3.0)))
