"""Similarity clusters of points by Markov clustering on a sparse distributed matrix.

The points of a group are first gathered into cubic cells whose diagonal is the similarity distance,
so the points of a cell are similar to each other without any pair being formed; a cell with a third
of all rows is one node of the graph, with that weight. Candidate pairs of cells come from bins of a
few cells' width, so a cell meets a number of others bounded by geometry and not by the rows. Two
cells are linked if rows of theirs are similar: the boxes around their rows settle most pairs, for
the others rows of the two cells are compared, one for each 4 x 4 x 4 part of a cell. A link weighs
the share of row pairs that are similar, times the rows of the cell.

The flow matrix has a column for each cell, with the weights of the cells it is linked to. Markov
clustering then alternates expansion (the matrix squared, a join of its entries with its columns),
inflation (entries raised to a power and normalised by column) and pruning of small entries, until
every column flows to equal attractors. Attractors name the clusters. The rows of a cell stand for
themselves: an entry is inflated as the flow to each row of its cell, not to the cell as a whole, so a
cell attracts no more for being full. What pruning drops of a column is measured: where it would be
more than ``max_loss``, smaller entries are kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from poregrid.llm.topn import top_items
from poregrid.session import materialize

#: Cells along one side of a bin in which linked cells are looked for.
BIN_CELLS = 8
#: Parts along one side of a cell; each gives one row to comparisons that the cells' boxes leave open.
PARTS = 4
#: A cell is joined to its rows in pieces of at most this share of all rows.
HOT_SHARE = 0.001
#: Entries of a settled column from this share of the largest on are equal attractors.
TIED = 0.9


def cells_of(points: DataFrame, dims: int, distance: float) -> DataFrame:
    """``points`` (grp, rid, x0, x1, ...) with cell indexes ``c0, c1, ...``."""
    side = distance / math.sqrt(dims)
    return points.select("*", *[F.floor(F.col(f"x{i}") / F.lit(side)).alias(f"c{i}") for i in range(dims)])


def nodes_of(celled: DataFrame, dims: int) -> DataFrame:
    """A node per occupied cell: its smallest id, the box and the mean of its rows (``l0.. h0.. a0..``), and their number."""
    axes = [f"c{i}" for i in range(dims)]
    figures = [fn(f"x{i}").alias(f"{n}{i}") for n, fn in (("l", F.min), ("h", F.max), ("a", F.avg)) for i in range(dims)]
    return celled.groupBy("grp", *axes).agg(F.min("rid").alias("node"), *figures, F.count(F.lit(1)).alias("mass"))


def near_cells(nodes: DataFrame, dims: int, distance: float) -> DataFrame:
    """``a, b, sure`` (a < b): pairs of cells whose boxes come within ``distance``; ``sure`` if they are nowhere farther apart."""
    reach = math.ceil(math.sqrt(dims))
    box = [f"{n}{i}" for n in "lh" for i in range(dims)]
    home = nodes.select("grp", F.col("node").alias("a"), *[F.floor(F.col(f"c{i}") / BIN_CELLS).alias(f"b{i}") for i in range(dims)], *[F.col(c).alias(f"p{c}") for c in box])
    visitors = nodes.select("grp", F.col("node").alias("b"), *[f"c{i}" for i in range(dims)], *box)
    for i in range(dims):
        low, high = (F.floor((F.col(f"c{i}") + o) / BIN_CELLS) for o in (-reach, reach))
        visitors = visitors.withColumn(f"b{i}", F.explode(F.sequence(low, high)))
    gap = [F.greatest(F.lit(0.0), F.col(f"l{i}") - F.col(f"ph{i}"), F.col(f"pl{i}") - F.col(f"h{i}")) for i in range(dims)]
    span = [F.greatest(F.col(f"h{i}") - F.col(f"pl{i}"), F.col(f"ph{i}") - F.col(f"l{i}")) for i in range(dims)]
    met = home.join(visitors, ["grp", *[f"b{i}" for i in range(dims)]]).where(F.col("a") < F.col("b"))
    square = float(distance) ** 2
    return met.where(sum(g * g for g in gap) <= square).select("a", "b", (sum(v * v for v in span) <= square).alias("sure"))


def similar_share(open_pairs: DataFrame, celled: DataFrame, nodes: DataFrame, dims: int, distance: float) -> DataFrame:
    """``a, b, share``: of pairs of cells the share of their row pairs within ``distance``, where there is one.

    Compared is one row of each occupied part of a cell, weighted by the rows of the part: exact where
    parts hold one row, and at most ``PARTS ** dims`` rows of a cell however many it holds.
    """
    axes = [f"c{i}" for i in range(dims)]
    part = distance / math.sqrt(dims) / PARTS
    wanted = open_pairs.select(F.col("a").alias("node")).unionByName(open_pairs.select(F.col("b").alias("node"))).distinct()
    rows = celled.join(nodes.join(wanted, "node", "left_semi").select("grp", *axes, "node"), ["grp", *axes])
    parts = rows.groupBy("node", *[F.floor(F.col(f"x{i}") / part).alias(f"f{i}") for i in range(dims)]).agg(
        *[F.min_by(f"x{i}", "rid").alias(f"x{i}") for i in range(dims)], F.count(F.lit(1)).cast("double").alias("n")
    )
    parts = materialize(parts.drop(*[f"f{i}" for i in range(dims)]), "parts")
    one = parts.select(F.col("node").alias("a"), *[F.col(f"x{i}").alias(f"y{i}") for i in range(dims)], F.col("n").alias("m"))
    pairs = open_pairs.join(one, "a").join(parts.withColumnRenamed("node", "b"), "b")
    near = sum((F.col(f"x{i}") - F.col(f"y{i}")) ** 2 for i in range(dims)) <= float(distance) ** 2
    both = F.col("n") * F.col("m")
    share = F.sum(F.when(near, both).otherwise(0.0)) / F.sum(both)
    return pairs.groupBy("a", "b").agg(share.alias("share")).where("share > 0")


def links(celled: DataFrame, nodes: DataFrame, dims: int, distance: float) -> DataFrame:
    """``a, b, share`` (a < b) of all linked pairs of cells."""
    pairs = materialize(near_cells(nodes, dims, distance), "near-cells")
    settled = pairs.where("sure").select("a", "b", F.lit(1.0).alias("share"))
    return settled.unionByName(similar_share(pairs.where("not sure").select("a", "b"), celled, nodes, dims, distance))


def weights(linked: DataFrame, nodes: DataFrame) -> DataFrame:
    """``col, row, m, w``: both directions of the links and each linked node itself; ``m`` rows of ``row``, of which ``w`` are similar."""
    mass = nodes.select("node", F.col("mass").cast("double").alias("m"))
    flat = linked.join(mass.withColumnRenamed("node", "a").withColumnRenamed("m", "ma"), "a").join(mass.withColumnRenamed("node", "b").withColumnRenamed("m", "mb"), "b")
    ways = F.array(
        F.struct(F.col("a").alias("col"), F.col("b").alias("row"), F.col("mb").alias("m"), (F.col("share") * F.col("mb")).alias("w")),
        F.struct(F.col("b").alias("col"), F.col("a").alias("row"), F.col("ma").alias("m"), (F.col("share") * F.col("ma")).alias("w")),
    )
    between = flat.select(F.explode(ways).alias("s")).select("s.*")
    own = mass.join(between.select(F.col("col").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("col"), F.col("node").alias("row"), "m", F.col("m").alias("w"))
    return between.unionByName(own)


def _sharpen(entries: DataFrame, power: float, prune: float, max_loss: float) -> DataFrame:
    """``col, e, lost``: inflated and pruned columns of ``col, row, m, v``, each as an array of ``row, m, v``, the largest first.

    Entries below ``prune`` go; if they make more than ``max_loss`` of their column, those below a
    tenth or a hundredth of it, else none. ``lost`` is what went; the rest is scaled up to 1.
    """
    inflated = F.col("m") * F.pow(F.col("v") / F.col("m"), F.lit(float(power)))  # the flow to each of m rows, raised
    columns = entries.groupBy("col").agg(F.collect_list(F.struct(inflated.alias("v"), "row", "m")).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda acc, s: acc + s.v)
    scaled = columns.withColumn("t", total).select("col", F.array_sort(F.transform("e", lambda s: F.struct((-s.v / F.col("t")).alias("neg"), s.row.alias("row"), s.m.alias("m")))).alias("e"))

    def below(limit: float) -> Column:
        return F.aggregate("e", F.lit(0.0), lambda acc, s: acc + F.when(-s.neg < limit, -s.neg).otherwise(0.0))

    limit, lost = F.lit(0.0), F.lit(0.0)
    for step in (prune / 100, prune / 10, prune):
        limit, lost = F.when(below(step) <= max_loss, step).otherwise(limit), F.when(below(step) <= max_loss, below(step)).otherwise(lost)
    cut = scaled.withColumn("limit", limit).withColumn("lost", lost)
    kept = F.filter("e", lambda s, i: (-s.neg >= F.col("limit")) | (i == 0))
    return cut.select("col", F.transform(kept, lambda s: F.struct(s.row.alias("row"), s.m.alias("m"), (-s.neg / (1 - F.col("lost"))).alias("v"))).alias("e"), "lost")


def _written(columns: DataFrame) -> tuple[DataFrame, float, float]:
    """The columns as a table, how far the worst is from settled, and the greatest loss."""
    seen = Observation()
    top = F.array_max(F.transform("e", lambda s: s.v / s.m))
    apart = 1 - F.aggregate("e", F.lit(0.0), lambda acc, s: acc + s.v * s.v / s.m) / top
    table = materialize(columns.observe(seen, F.max(apart).alias("apart"), F.max("lost").alias("lost")).drop("lost"), "flow")
    got = seen.get
    return table, got.get("apart") or 0.0, got.get("lost") or 0.0


def markov_clusters(
    linked: DataFrame, inflation: float = 2.0, prune: float = 1e-3, max_loss: float = 1e-3, tolerance: float = 1e-2, max_rounds: int = 60
) -> tuple[DataFrame, float]:
    """``node, attractor`` for every ``col`` of ``col, row, m, w``, by Markov clustering, and the greatest share that pruning took of a column.

    ``max_rounds`` is an error bound, not a cut: if the flow has not settled by then, an error is raised.
    """
    flow, apart, most = _written(_sharpen(_normal(linked.withColumnRenamed("w", "v")), inflation, prune, max_loss))
    for _ in range(max_rounds):
        if apart < tolerance:
            break
        entries = flow.select("col", F.explode("e").alias("s")).select("col", F.col("s.row").alias("mid"), F.col("s.v").alias("v2"))
        met = entries.join(flow.select(F.col("col").alias("mid"), F.col("e").alias("m")), "mid")
        products = met.select("col", "v2", F.explode("m").alias("s")).select("col", F.col("s.row").alias("row"), F.col("s.m").alias("m"), (F.col("v2") * F.col("s.v")).alias("v"))
        # by column at once: the sums and the columns made of them need no further shuffle
        squared = products.repartition("col").groupBy("col", "row", "m").agg(F.sum("v").alias("v"))
        flow, apart, lost = _written(_sharpen(squared, inflation, prune, max_loss))
        most = max(most, lost)
    else:
        raise RuntimeError(f"the flow has not settled in {max_rounds} rounds")
    # In a settled column what is not negligible is nearly equal to the largest entry: the lowest row of these names it.
    top = F.array_max(F.transform("e", lambda s: s.v / s.m))
    tied = F.filter("e", lambda s: s.v / s.m >= TIED * F.col("top"))
    to = materialize(flow.withColumn("top", top).select(F.col("col").alias("node"), F.array_min(F.transform(tied, lambda s: s.row)).alias("attractor")), "flow-to")
    # An attractor may itself flow to an equal one of lower id; follow until nothing moves.
    while True:
        then = to.select(F.col("node").alias("attractor"), F.col("attractor").alias("further"))
        seen = Observation()
        moved = to.join(then, "attractor").observe(seen, F.count_if(F.col("attractor") != F.col("further")).alias("moved"))
        to = materialize(moved.select("node", F.col("further").alias("attractor")), "flow-to")
        if not seen.get.get("moved"):
            return to, most


def _normal(flow: DataFrame) -> DataFrame:
    """Columns of ``col, row, m, v`` that sum to 1."""
    return flow.select("col", "row", "m", (F.col("v") / F.sum("v").over(Window.partitionBy("col"))).alias("v"))


class PointClusters:
    """Markov clusters of the rows of ``points`` within each ``group``.

    ``points`` needs a unique, non-null ``id_col`` and finite coordinates: rows with a null group or
    coordinate and NaN coordinates are left out. Rows at the same point are members like any others.
    An empty input has no clusters. If similar rows form separate cliques, the clusters are exactly
    these cliques; otherwise they are the flow clusters of the cells, and ``span`` in ``describe``
    shows those that are wider than the distance. ``lost`` is the greatest share of a column of the
    flow that pruning took in any round.
    """

    def __init__(self, points: DataFrame, group: str, id_col: str, coordinates: Sequence[str], distance: float, **flow):
        usable = F.col(group).isNotNull() & F.col(id_col).isNotNull()
        for c in coordinates:
            usable &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
        self.group, self.id_col, dims = group, id_col, len(coordinates)
        self.axes = [f"c{i}" for i in range(dims)]
        places = [F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(coordinates)]
        rows = points.where(usable).select(F.col(group).alias("grp"), F.col(id_col).alias("rid"), *places)
        self.rows = materialize(cells_of(rows, dims, distance), "celled")
        self.nodes = materialize(nodes_of(self.rows, dims), "nodes")
        self.weights = materialize(weights(links(self.rows, self.nodes, dims, distance), self.nodes), "links")
        attractors, self.lost = markov_clusters(self.weights, **flow)
        # a cell without links is a cluster of its own and takes no part in the flow
        cells = self.nodes.join(attractors, "node", "left").withColumn("attractor", F.coalesce("attractor", "node"))
        first = cells.groupBy("attractor").agg(F.min("node").alias("first_id"))
        self.cells = materialize(cells.join(first, "attractor"), "cells")

    def members(self) -> DataFrame:
        """``group, id_col, first_id``: each row with the smallest id of its cluster."""
        named = self._with_cells(self.cells.select("grp", *self.axes, "first_id", "mass"))
        return named.select(F.col("grp").alias(self.group), F.col("rid").alias(self.id_col), "first_id")

    def _with_cells(self, cells: DataFrame) -> DataFrame:
        """Every row with the columns of its cell.

        Cells with more than ``HOT_SHARE`` of all rows, at most 1/``HOT_SHARE`` of them, are broadcast with
        the number of pieces their rows are spread over, so that the join has no large key.
        """
        total = self.nodes.agg(F.coalesce(F.sum("mass"), F.lit(0))).first()[0]
        pieces = F.greatest(F.lit(1), F.ceil(F.col("mass") / (HOT_SHARE * total))) if total else F.lit(1)
        cut = cells.withColumn("pieces", pieces.cast("int"))
        key = ["grp", *self.axes]
        hot = F.broadcast(cut.where("pieces > 1").select(*key, "pieces"))
        placed = self.rows.join(hot, key, "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("rid"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces")
        spread = cut.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces", "mass")
        return placed.join(spread, [*key, "piece"]).drop("piece")

    def describe(self, typical: int = 3) -> DataFrame:
        """One row per cluster: ``group, first_id, size, span, centre_*, typical_ids``.

        ``typical_ids`` are rows of the cells that take most flow from all cells of the cluster (weights
        of their links summed), strongest cell first, within a cell the nearest to the cluster's centre,
        ties by id; fewer than ``typical`` only if the cluster has fewer rows. ``span`` is the diagonal of
        the box around the cluster's rows.
        """
        dims = range(len(self.axes))
        own = self.cells.select(F.col("node").alias("col"), F.col("mass").alias("own"))
        share = _normal(self.weights.withColumnRenamed("w", "v")).join(own, "col").groupBy(F.col("row").alias("node")).agg(F.round(F.sum(F.col("v") * F.col("own")), 6).alias("flow"))
        taken = self.cells.join(share, "node", "left").withColumn("flow", F.coalesce("flow", F.col("mass").cast("double")))
        box = sum((F.max(f"h{i}") - F.min(f"l{i}")) ** 2 for i in dims)
        centre = [(F.sum(F.col(f"a{i}") * F.col("mass")) / F.sum("mass")).alias(f"centre_{i}") for i in dims]
        shape = self.cells.groupBy("first_id").agg(F.first("grp").alias(self.group), F.sum("mass").alias("size"), F.sqrt(box).alias("span"), *centre)
        centres = shape.select("first_id", *[F.col(f"centre_{i}").alias(f"m{i}") for i in dims])
        ranked = taken.join(centres, "first_id").select("grp", *self.axes, "first_id", "flow", "mass", *[f"m{i}" for i in dims])
        # Each row at its cell's strength; a heap of the best rows of each cluster is all that is shuffled of a hot cell.
        far = sum((F.col(f"x{i}") - F.col(f"m{i}")) ** 2 for i in dims)
        best = top_items(self._with_cells(ranked).withColumn("far", F.round(far, 9)), ["first_id"], typical, [("flow", True), ("far", False), ("rid", False)])
        ids = best.groupBy("first_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank_no", "rid"))), lambda s: s.rid).alias("typical_ids"))
        return shape.join(ids, "first_id")
