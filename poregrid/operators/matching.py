"""Ligands in the tunnels of the same frame: the nearest sphere of each tunnel, then of each frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poregrid.functions.geometry import layer, norm
from poregrid.operators.traces import match_fractions, nearest_in_frame

#: Columns of the table of matches, as written for each event and supercluster.
DETAIL = ("frame", "x", "y", "z", "dist", "tunnel_cluster", "sphere_x", "sphere_y", "sphere_z", "sphere_r")
#: Frames in a block. Windows meet what was found block by block; none is spread into its frames.
FRAMES = 256


def in_sphere_band(point_layer: Column, layers: Column, sphere_layer: Column) -> Column:
    """Whether a sphere of a tunnel is compared with a point: both by their layers.

    A point beyond the tunnel meets its last two layers; a point in a layer of the tunnel that layer and
    its neighbours; any other the nearest layer below, the one above, and the next beyond each.
    """
    last = F.array_max(layers)
    below = F.array_max(F.filter(layers, lambda v: v < point_layer))
    above = F.array_min(F.filter(layers, lambda v: v > point_layer))
    gap = F.coalesce(sphere_layer.between(below - 1, below), F.lit(False)) | F.coalesce(sphere_layer.between(above, above + 1), F.lit(False))
    near = F.abs(sphere_layer - point_layer) <= 1
    return F.when(point_layer > last, sphere_layer >= last - 1).when(F.array_contains(layers, point_layer), near).otherwise(gap)


def with_layers(tunnels: DataFrame, thickness: float = 1.5) -> DataFrame:
    """``tunnels`` with ``layer`` in each of its ``spheres`` (x, y, z, r), and ``layers``, the distinct ones.

    Spheres without a place or radius are left out; a tunnel left without spheres is none.
    """
    whole = F.filter("spheres", lambda s: s.x.isNotNull() & s.y.isNotNull() & s.z.isNotNull() & s.r.isNotNull() & ~F.isnan(s.x) & ~F.isnan(s.y) & ~F.isnan(s.z) & ~F.isnan(s.r))
    placed = F.transform(whole, lambda s, i: F.struct(i.alias("idx"), s.x.alias("x"), s.y.alias("y"), s.z.alias("z"), s.r.alias("r"), layer(norm([s.x, s.y, s.z]), thickness).alias("layer")))
    got = tunnels.withColumn("spheres", placed).where(F.size("spheres") > 0)
    return got.withColumn("layers", F.array_distinct(F.transform("spheres", lambda s: s.layer)))


def nearest_spheres(points: DataFrame, tunnels: DataFrame, frame: Sequence[str], thickness: float = 1.5) -> DataFrame:
    """Each point with each tunnel of its frame: ``dist`` to the surface of the nearest sphere in the band, and that sphere.

    ``points``: frame columns, x, y, z and others; ``tunnels``: frame columns, spheres and others. Of
    equally near spheres the first along the tunnel counts. A null frame meets no tunnel.
    """
    own = [c for c in tunnels.columns if c not in {*frame, "spheres"}]
    here = points.withColumn("_l", layer(norm([F.col(c) for c in "xyz"]), thickness))
    met = here.join(with_layers(tunnels, thickness), list(frame))
    banded = F.filter("spheres", lambda s: in_sphere_band(F.col("_l"), F.col("layers"), s.layer))
    away = lambda s: norm([F.col(c) - s[c] for c in "xyz"]) - s.r
    best = F.array_min(F.transform(banded, lambda s: F.struct(away(s).alias("dist"), s.idx.alias("idx"), s.x.alias("x"), s.y.alias("y"), s.z.alias("z"), s.r.alias("r"))))
    got = met.withColumn("_b", best).where(F.col("_b").isNotNull())
    return got.select(*points.columns, *own, F.col("_b.dist").alias("dist"), *[F.col(f"_b.{c}").alias(f"sphere_{c}") for c in "xyzr"])


def matches(points: DataFrame, tunnels: DataFrame, event: Sequence[str], frame: Sequence[str], within: Sequence[str] = (), places: int | None = None) -> DataFrame:
    """The nearest sphere to any ligand atom in each frame of each event (and of each ``within`` value of the tunnels).

    ``points``: event and frame columns, ``atom``, x, y, z. Of equally near spheres the one of the last
    tunnel cluster, then of the last atom and tunnel, is taken; with ``places`` distances are compared rounded.
    """
    near = nearest_spheres(points, tunnels, frame)
    if places is not None:
        near = near.withColumn("dist", F.round("dist", places))
    group = [*event, *within, *[c for c in frame if c not in event]]
    return nearest_in_frame(near.drop(*[c for c in near.columns if c not in {*group, "dist", "tunnel_cluster", "atom", "tunnel", "x", "y", "z", "sphere_x", "sphere_y", "sphere_z", "sphere_r"}]), group, "dist", "tunnel_cluster", "atom")


def fractions(found: DataFrame, frames: DataFrame, event: Sequence[str], radius: float, within: Sequence[str] = ()) -> DataFrame:
    """``of_frames`` and ``of_tunnel_frames`` of each event (and ``within`` value): the ligand is inside if its distance is at most ``radius``."""
    if not within:
        return match_fractions(found, frames, event, "dist", radius)
    total = frames.groupBy(*event).agg(F.count(F.lit(1)).alias("n_frames"))
    hits = found.groupBy(*event, *within).agg(F.count_if(F.col("dist") <= radius).alias("hits"), F.count(F.lit(1)).alias("k"))
    return hits.join(total, list(event)).select(*event, *within, (F.col("hits") / F.col("n_frames")).alias("of_frames"), (F.col("hits") / F.col("k")).alias("of_tunnel_frames"))


def _block(frame: Column) -> Column:
    return F.floor(frame / FRAMES)


def _met(windows: DataFrame, held: DataFrame, key: Sequence[str]) -> DataFrame:
    """``windows`` with each block ``_k`` of ``held`` that they reach into.

    Spark takes the rows of a window's blocks for as few as its windows, so it must not choose a broadcast by them.
    """
    reached = windows.where("frame_b <= frame_e").withColumn("_k", F.explode(F.sequence(_block(F.col("frame_b")), _block(F.col("frame_e")))))
    return reached.join(held.hint("merge"), [*key, "_k"])


def in_windows(found: DataFrame, windows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Each row of ``found`` with each window it lies in: the columns of ``windows`` but for its limits, then the others of ``found``.

    ``found`` holds key columns and ``frame``, few rows a frame; windows as in ``window_fractions``.
    """
    own = [c for c in windows.columns if c not in ("frame_b", "frame_e")]
    held = found.groupBy(*key, _block(F.col("frame")).alias("_k")).agg(F.collect_list(F.struct(*[c for c in found.columns if c not in key])).alias("_in"))
    inside = F.filter("_in", lambda s: s.frame.between(F.col("frame_b"), F.col("frame_e")))
    return _met(windows, held, key).select(*own, F.inline(inside))


def window_fractions(found: DataFrame, windows: DataFrame, event: Sequence[str], key: Sequence[str], radius: float) -> DataFrame:
    """``of_frames`` and ``of_tunnel_frames`` of each event, as ``fractions`` has them, from windows instead of frames.

    ``found``: key columns, ``frame`` and ``dist``, one row a frame; ``windows``: event and key columns, ``frame_b`` and
    ``frame_e``, both inclusive. A window that ends before it begins is none; a null key meets nothing.
    """
    begin, end, start = F.col("frame_b"), F.col("frame_e"), F.col("_k") * FRAMES
    held = found.groupBy(*key, _block(F.col("frame")).alias("_k")).agg(F.collect_list("frame").alias("_all"), F.collect_list(F.when(F.col("dist") <= radius, F.col("frame"))).alias("_in"))
    whole = (begin <= start) & (end >= start + FRAMES - 1)
    own = [F.when(whole, F.size(c)).otherwise(F.size(F.filter(c, lambda f: f.between(begin, end)))) for c in ("_in", "_all")]
    hits = _met(windows, held, key).groupBy(*event).agg(F.sum(own[0]).alias("hits"), F.sum(own[1]).alias("k")).where("k > 0")
    total = windows.where("frame_b <= frame_e").groupBy(*event).agg(F.sum(end.cast("long") - begin + 1).alias("n_frames"))
    return total.join(hits, list(event), "left").select(
        *event, F.coalesce(F.col("hits") / F.col("n_frames"), F.lit(0.0)).alias("of_frames"), (F.col("hits") / F.col("k")).alias("of_tunnel_frames")
    )
