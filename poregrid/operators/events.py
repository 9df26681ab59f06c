"""Transport events: extraction from ligand traces, layered description, containment in superclusters."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poregrid.functions.geometry import layer, node_label, norm, squeeze
from poregrid.kernels import paths as P
from poregrid.operators import nodes as N
from poregrid.operators import filters, traces
from poregrid.session import materialize

POINT = ("x", "y", "z")
NODE = ("node", "layer", *POINT, "radius", "rmsf", "is_end")


def segments(points: DataFrame, keys: Sequence[str], min_distance: float = 6.0) -> DataFrame:
    """The inside, entry and release part of each trace: ``keys, event_type, ord, x, y, z, dist``.

    Points equal to the one before on the trace go; of several runs of a type the first counts. An entry
    or release goes if neither it nor the inside part comes nearer to the origin than ``min_distance``; a
    trace without an inside part keeps its events, and one left without events gives nothing. Points
    without a place or type go first.
    """
    whole = points.where(F.col("event_type").isNotNull() & F.col("ord").isNotNull())
    for c in POINT:
        whole = whole.where(F.col(c).isNotNull() & ~F.isnan(c))
    runs = traces.first_run(traces.drop_repeats(whole, keys, ["ord"], POINT), keys, ["ord"], "event_type")
    p = runs.select(*keys, "event_type", "ord", *POINT, norm([F.col(c) for c in POINT]).alias("dist"))
    trace = Window.partitionBy(*keys)
    outer = F.col("event_type") != "inside"
    inner = F.coalesce(F.min(F.when(~outer, F.col("dist"))).over(trace), F.lit(-1.0))
    least = F.min("dist").over(Window.partitionBy(*keys, "event_type"))
    kept = p.withColumn("_i", inner).withColumn("_m", least).where(~(outer & (F.col("_i") >= min_distance) & (F.col("_m") >= min_distance)))
    return kept.withColumn("_o", F.max(outer.cast("int")).over(trace)).where("_o = 1").drop("_i", "_m", "_o")


def extended(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entries and releases with the inside points that follow on them ever nearer to the origin.

    Gives ``keys, event_type, phase, ord, x, y, z, dist``: an event's points in order of ``phase, ord``. An
    entry goes on along the inside part (phase 1), a release is led up to by its end (phase -1), as long as
    no point is farther than the one before, the first than the event's nearest point.
    """
    events = parts.where("event_type <> 'inside'")
    seeds = events.groupBy(*keys, "event_type").agg(F.min("dist").alias("_seed"))
    inside = parts.where("event_type = 'inside'").drop("event_type").join(seeds, list(keys))
    place = F.when(F.col("event_type") == "entry", F.col("ord")).otherwise(-F.col("ord"))
    w = Window.partitionBy(*keys, "event_type").orderBy("_p")
    before = F.least(F.col("_seed"), F.min("dist").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    marked = inside.withColumn("_p", place).withColumn("_b", (F.col("dist") > before).cast("int"))
    closer = marked.withColumn("_s", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_s = 0")
    phase = F.when(F.col("event_type") == "entry", 1).otherwise(-1)
    columns = [*keys, "event_type", "phase", "ord", *POINT, "dist"]
    return events.withColumn("phase", F.lit(0)).select(*columns).unionByName(closer.withColumn("phase", phase).select(*columns))


def connected(longer: DataFrame, parts: DataFrame, keys: Sequence[str], ligand_radius: float = 1.0) -> DataFrame:
    """``longer`` with the points of the shortest overlapping way from each event's inner end to the origin (phase 2 or -2).

    The way leads over inside points of the trace; one ligand's points are a task's largest group.
    """
    key = [*keys, "event_type"]
    inward = F.when(F.col("event_type") == "entry", 1).otherwise(-1)
    place = F.struct((inward * F.col("phase")).alias("a"), (inward * F.col("ord")).alias("b"), *POINT)
    border = longer.groupBy(*key).agg(F.max(place).alias("_b")).select(*key, *[F.col(f"_b.{c}").alias(f"b{c}") for c in POINT])
    inside = parts.where("event_type = 'inside'").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", *POINT))).alias("_inside"))
    types = {c: longer.schema[c].dataType.simpleString() for c in key}

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                points = np.array([[p["x"], p["y"], p["z"]] for p in row.inside_points], dtype=float).reshape(-1, 3)
                way = P.search_inward(points, np.array([row.bx, row.by, row.bz]), ligand_radius)
                head = [getattr(row, f"k{i}") for i in range(len(key))]
                entry = head[-1] == "entry"
                out += [(*head, 2 if entry else -2, k if entry else -k, *map(float, p), float(np.linalg.norm(p))) for k, p in enumerate(way)]
            yield pd.DataFrame(out, columns=[*key, "phase", "ord", *POINT, "dist"])

    rows = border.join(inside, list(keys)).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(key)], "bx", "by", "bz", F.col("_inside").alias("inside_points"))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in types.items()], "phase int, ord int, x double, y double, z double, dist double"])
    return longer.withColumn("ord", F.col("ord").cast("int")).unionByName(rows.mapInPandas(search, schema))


def extract(points: DataFrame, keys: Sequence[str], ligand_radius: float = 1.0, min_distance: float = 6.0, search: bool = True) -> DataFrame:
    """``keys, event_type, ord, x, y, z, dist, is_end`` of the entries and releases in traces of points.

    ``ord`` counts from the inner end, so an entry runs backwards; the outermost point ``is_end``. Events
    of a single point are left out. ``search`` adds the overlapping way to the origin.
    """
    parts = materialize(segments(points, keys, min_distance), "segments")  # read for the events, their extension and the search
    longer = extended(parts, keys)
    if search:
        longer = connected(materialize(longer, "extended"), parts, keys, ligand_radius)
    key = [*keys, "event_type"]
    return _ordered(filters.several_points(longer, key), key)


def _ordered(points: DataFrame, key: Sequence[str]) -> DataFrame:
    w = Window.partitionBy(*key)
    pos, n = F.row_number().over(w.orderBy("phase", "ord")) - 1, F.count(F.lit(1)).over(w)
    numbered = points.withColumn("_p", pos).withColumn("_n", n)
    place = F.when(F.col("event_type") == "entry", F.col("_n") - 1 - F.col("_p")).otherwise(F.col("_p")).cast("int")
    return numbered.select(*key, place.alias("ord"), *POINT, "dist", (place == F.col("_n") - 1).alias("is_end"))


def layered(points: DataFrame, keys: Sequence[str], thickness: float = 1.5, radius: float = 1.0) -> DataFrame:
    """Nodes of each event: one per layer for its points and one for its end, those on its path without loops.

    ``points`` as ``extract`` gives them, ``keys`` with event_type. Gives ``keys`` and ``NODE``.
    """
    named = in_layers(points, thickness)
    figures = layer_figures(named, keys, radius)
    walked = named.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", "node"))).alias("w")).select(*keys, squeeze(F.transform("w", lambda s: s.node)).alias("nodes"))
    return figures.join(direct_paths(walked, keys).select(*keys, F.explode("nodes").alias("node")).distinct(), [*keys, "node"], "left_semi").select(*keys, *NODE)


def in_layers(points: DataFrame, thickness: float = 1.5) -> DataFrame:
    """``points`` with their ``layer`` and ``node``: 1 for the points of a layer, 2 for the end."""
    placed = points.withColumn("layer", layer(F.col("dist"), thickness))
    return placed.withColumn("node", node_label(F.col("layer"), F.when(F.col("is_end"), 2).otherwise(1)))


def layer_figures(named: DataFrame, keys: Sequence[str], radius: float = 1.0) -> DataFrame:
    """``keys`` and ``NODE`` for each node of ``in_layers``: mean place and spread of its points, the ligand's ``radius``."""
    return named.groupBy(*keys, "node", "layer").agg(
        *[F.avg(c).alias(c) for c in POINT], F.lit(float(radius)).alias("radius"), F.sqrt(sum(F.var_pop(c) for c in POINT)).alias("rmsf"), F.bool_or("is_end").alias("is_end")
    )


def direct_paths(walked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, nodes``: node paths without loops."""
    types = ", ".join(f"`{k}` {walked.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(nodes=[P.without_loops(list(p)) for p in pdf.nodes])

    return walked.select(*keys, "nodes").mapInPandas(run, f"{types}, nodes array<string>")


def directions(event_nodes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, x, y, z``: where the end node of each event lies; of several the one of the lowest label. Events without one give no row."""
    first = F.min(F.struct("node", *POINT))
    return event_nodes.where("is_end").groupBy(*keys).agg(first.alias("f")).select(*keys, *[F.col(f"f.{c}").alias(c) for c in POINT])


def nearest_nodes(query: DataFrame, target: DataFrame, pairs: DataFrame, keys: Sequence[str], to: str, dist: Column, places: int = 9) -> DataFrame:
    """For each query node and pair the nearest target node by the band: ``keys, to, q_node, nearest, dist``.

    Nodes in the band seen from the query come first, then those whose own band holds the query node, then
    any; of these the least distance (at least 0, compared to ``places``), then the label. ``pairs``: keys and
    ``to``; ``dist`` is a column of ``q_*`` and ``t_*``.
    """
    key = [*keys, to]
    q_lim = N.layer_limits(query, keys).select(*keys, F.col("first_end").alias("q_first"), F.col("last_layer").alias("q_last"))
    t_lim = N.layer_limits(target, [to]).select(to, F.col("first_end").alias("t_first"), F.col("last_layer").alias("t_last"))
    q = query.select(*keys, *[F.col(c).alias(f"q_{c}") for c in NODE]).join(q_lim, list(keys), "left")
    t = target.select(to, *[F.col(c).alias(f"t_{c}") for c in NODE]).join(t_lim, to, "left")
    met = pairs.select(*key).distinct().join(q, list(keys)).join(t, to)
    ahead = F.coalesce(N.in_band(F.col("q_layer"), F.col("t_layer"), F.col("q_first"), F.col("q_last"), F.col("t_last")), F.lit(False))
    behind = F.coalesce(N.in_band(F.col("t_layer"), F.col("q_layer"), F.col("t_first"), F.col("t_last"), F.col("q_last")), F.lit(False))
    rank = F.when(ahead, 0).when(behind, 1).otherwise(2)
    best = F.min(F.struct(rank.alias("r"), F.round(F.greatest(dist, F.lit(0.0)), places).alias("d"), F.col("t_node").alias("n")))
    return met.groupBy(*key, "q_node").agg(best.alias("b")).select(*key, "q_node", F.col("b.n").alias("nearest"), F.col("b.d").alias("dist"))


def containment(near: DataFrame, depths: DataFrame, keys: Sequence[str], to: str) -> DataFrame:
    """``keys, to, buriedness, depth``: the share of nodes inside (distance 0), and the greatest depth of all nearest nodes.

    ``depths``: ``to, node, depth``.
    """
    joined = near.join(depths.select(to, F.col("node").alias("nearest"), "depth"), [to, "nearest"], "left")
    return joined.groupBy(*keys, to).agg(F.avg((F.col("dist") == 0).cast("double")).alias("buriedness"), F.max("depth").alias("depth"))
