"""Communities of a weighted graph by modularity moves in contraction levels.

A level starts with every node by itself. In a round each node looks for the community around it whose gain is
largest (the smallest label of equals). Moves from communities of one half to those of the other are taken in
order as long as each still gains after all moves before it out of the same and into the same community: those
sums are all it needs to know, for a community of the one half only loses nodes in the round and one of the other
only wins some. So every move that is made raises modularity, and nothing is tried in vain. Where no move crosses
from half to half, those that are the best of both communities they touch are made. A level ends when no move
gains; its communities become the nodes of the next. When levels above the first have moved any, single nodes of
the graph itself are moved until none gains, so the result is a local optimum. Weights are whole numbers and gains
exact decimals: equal inputs give equal communities, however Spark orders its sums.

In rounds of more than ``FEW`` moves those communities win nodes that more gain asks for than asks to leave, so
all leaves of a hub join it at once; every other such round the halves are drawn by a hash of label and round.
Rounds of ``FEW`` moves draw them by a checksum, as the plain implementation in the tests does. A checksum is
linear, so two labels that it puts into one half stay together for nearly all rounds, which many moves cannot wait for.

Every round is joins and sums over edges and nodes, written to the shared folder; nothing but numbers of moves
comes to the driver. Each node's weights to the communities around it are kept from round to round and change by
the edges of the nodes that moved. Moves are put in order by parts: sums of whole parts, then places within each.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kbspark.operators.reasoning import discard, saved

_EXACT = "decimal(38,0)"
#: Moves of a round that are put in order as a whole, and the parts into which the moves of one community fall otherwise.
FEW, SALTS = 50, 32


def _parity(label: str, turn: int):
    return F.crc32(F.encode(F.concat(F.col(label), F.lit(f":{turn}")), "UTF-8")) % 2


def beside(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, to, w): the weight of each node's edges into each community around it, its own too."""
    # A node has one label, so parts of the labels fit into memory where parts of the edges would have to be sorted.
    return edges.join(labels.select(F.col("node").alias("v"), F.col("label").alias("to")).hint("shuffle_hash"), "v").groupBy(F.col("u").alias("node"), "to").agg(F.sum("w").alias("w"))


def totals(nodes: DataFrame, labels: DataFrame, inside: int) -> int:
    """Modularity times (2m)^2: 2m times the weight inside communities (``inside``, both directions, and loops) minus the squares of the communities' strengths."""
    strength = labels.join(nodes, "node").groupBy("label").agg(F.sum("k").cast(_EXACT).alias("t"))
    squares = strength.agg(F.sum(F.col("t") * F.col("t")).alias("x")).first().x or 0
    own = nodes.agg(F.sum("loop").alias("l"), F.sum("k").alias("k")).first()
    return int(own.k or 0) * (inside + int(own.l or 0)) - int(squares)


def gains(nodes: DataFrame, near: DataFrame, labels: DataFrame, double: int) -> DataFrame:
    """(node, label, to, k, gain): for each node that gains by a move its best one; gains times 2m; ``near`` as of ``beside``."""
    at = labels.join(nodes, "node")
    strength = at.groupBy("label").agg(F.sum("k").cast(_EXACT).alias("t"))
    met = near.join(strength.withColumnRenamed("label", "to").hint("shuffle_hash"), "to").join(at.select("node", "label", F.col("k").cast(_EXACT).alias("k")), "node")
    own = F.col("to") == F.col("label")
    worth = F.lit(double).cast(_EXACT) * F.col("w").cast(_EXACT) - F.col("k") * (F.col("t") - F.when(own, F.col("k")).otherwise(F.lit(0).cast(_EXACT)))
    worth = worth.cast(_EXACT)
    best = met.withColumn("worth", worth).groupBy("node").agg(
        F.first("label").alias("label"), F.first("k").alias("k"), F.max(F.when(own, F.col("worth"))).alias("stay"), F.min(F.when(~own, F.struct((-F.col("worth")).alias("less"), "to"))).alias("best")
    )
    # A node without an edge into its own community still counts that community's strength against it.
    best = best.join(strength, "label").withColumn("stay", F.coalesce("stay", (-F.col("k") * (F.col("t") - F.col("k"))).cast(_EXACT)))
    return best.filter("best is not null").select("node", "label", F.col("best.to").alias("to"), "k", (-F.col("best.less") - F.col("stay")).cast(_EXACT).alias("gain")).filter("gain > 0")


def _apart(moves: DataFrame) -> DataFrame:
    """The moves that are the best of both communities they touch: no two of them share one."""
    order = F.struct((-F.col("gain")).alias("less"), "node")
    ends = moves.select("node", "gain", F.explode(F.array("label", "to")).alias("at"))
    best = ends.groupBy("at").agg(F.min(order).alias("b")).select("at", F.col("b.node").alias("node"))
    return moves.join(best.groupBy("node").agg(F.count("*").alias("n")).filter("n = 2").select("node"), "node", "left_semi")


def _in_order(moves: DataFrame, turn: int) -> DataFrame:
    """Few moves: those from half to half that gain whatever those before them did."""
    moves = moves.filter((_parity("label", turn) == 0) & (_parity("to", turn) == 1))
    for end in ("label", "to"):
        before = Window.partitionBy(end).orderBy(F.desc("gain"), "node").rowsBetween(Window.unboundedPreceding, -1)
        moves = moves.withColumn(f"by_{end}", F.coalesce(F.sum("k").over(before), F.lit(0)))
    return moves.filter(F.col("gain") > (F.col("k") * (F.col("by_label") + F.col("by_to"))).cast(_EXACT))


def _at_once(moves: DataFrame, turn: int) -> DataFrame:
    """Any number of moves: those into communities that win nodes in this round, from others, that gain whatever those before them did."""
    if turn % 2:
        wins = lambda end: F.xxhash64(F.lit(turn), end) % 2 == 0
        moves = moves.filter(wins("to") & ~wins("label"))
    else:
        asked = moves.select(F.col("to").alias("at"), F.col("gain").alias("g")).unionByName(moves.select(F.col("label").alias("at"), (-F.col("gain")).alias("g")))
        wins = asked.groupBy("at").agg(F.sum("g").alias("g")).filter("g >= 0").select("at")
        moves = moves.join(wins, F.col("to") == F.col("at"), "left_semi").join(wins, F.col("label") == F.col("at"), "left_anti")
    # In order of the gains' magnitudes, then of parts, then of gains.
    part = ["size", "salt"]
    moves = moves.withColumn("size", F.floor(-F.log2(F.col("gain").cast("double")))).withColumn("salt", F.crc32(F.encode("node", "UTF-8")) % SALTS)
    for end in ("label", "to"):
        before = lambda by, order: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        parts = moves.groupBy(end, *part).agg(F.sum("k").alias("all")).withColumn("ahead", F.coalesce(F.sum("all").over(before([end], part)), F.lit(0))).drop("all")
        within = F.coalesce(F.sum("k").over(before([end, *part], [F.desc("gain"), "node"])), F.lit(0))
        moves = moves.withColumn("within", within).join(parts, [end, *part]).withColumn(f"by_{end}", F.col("within") + F.col("ahead")).drop("within", "ahead")
    return moves.filter(F.col("gain") > (F.col("k") * (F.col("by_label") + F.col("by_to"))).cast(_EXACT))


def _moved(edges: DataFrame, near: DataFrame, made: DataFrame) -> DataFrame:
    """``near`` after the moves ``made``: by the edges of the nodes that moved."""
    by = edges.join(made.select(F.col("node").alias("v"), "label", "to"), "v")
    change = by.select(F.col("u").alias("node"), F.explode(F.array(F.struct(F.col("to"), F.col("w")), F.struct(F.col("label").alias("to"), (-F.col("w")).alias("w")))).alias("c")).select("node", "c.to", "c.w")
    return near.unionByName(change).groupBy("node", "to").agg(F.sum("w").alias("w")).filter("w <> 0")


def _settle(nodes: DataFrame, edges: DataFrame, labels: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """Rounds until no move gains; (labels, weights beside them, whether any was made)."""
    own = nodes.agg(F.sum("k").alias("k"), F.count("*").alias("n")).first()
    double = int(own.k or 0)
    for turn in itertools.count():
        moves = saved(gains(nodes, near, labels, double), "moves")
        waiting = moves.count()
        if not waiting:
            discard(moves)
            return labels, near, turn > 0
        made = saved((_in_order if waiting <= FEW else _at_once)(moves, turn).select("node", "label", "to"), "made")
        some = made.count()
        if not some:
            discard(made)
            made = saved(_apart(moves).select("node", "label", "to"), "made")
            some = made.count()
        then = saved(labels.join(made.select("node", "to"), "node", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        # Where many nodes moved, all edges are summed anew.
        beyond = saved(beside(edges, then) if 4 * some > own.n else _moved(edges, near, made), "near")
        discard(moves, made)
        if turn:
            discard(labels, near)
        labels, near = then, beyond


def graph_of(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, k, loop), edges (u, v, w) in both directions): repeated edges add up, direction does not matter.

    Edges with a null end or a weight that is null or not above zero are left out; an edge from a node to itself
    counts in its strength and is inside whatever community it is in.
    """
    w = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    given = edges.select(F.col(src).alias("u"), F.col(dst).alias("v"), w.alias("w")).filter("u is not null and v is not null and w > 0")
    # Summed once for both directions.
    once = given.groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.sum("w").alias("w"))
    way = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    ways = once.select(F.explode(F.when(F.col("a") == F.col("b"), F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))).alias("way"), F.when(F.col("a") == F.col("b"), 2 * F.col("w")).otherwise(F.col("w")).alias("w"))
    return _split(saved(ways.select("way.u", "way.v", "w"), "around"))


def _split(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = both.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0)).alias("loop"))
    return saved(nodes, "nodes"), both.filter("u <> v")


def communities(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None) -> DataFrame:
    """(node, label) for every node that an edge names; a community's label is its smallest node. ``weight``: a column of whole numbers."""
    return found_in(*graph_of(edges, src, dst, weight))


def found_in(nodes: DataFrame, around: DataFrame) -> DataFrame:
    """(node, label) of a graph of ``graph_of``."""
    base_nodes, base_edges = nodes, around
    found, levels = None, 0
    while True:
        alone = nodes.select("node", F.col("node").alias("label"))
        labels, near, moved = _settle(nodes, around, alone, around.select(F.col("u").alias("node"), F.col("v").alias("to"), "w"))
        if not moved:
            break
        levels += 1
        found = labels if found is None else saved(found.join(labels.select(F.col("node").alias("label"), F.col("label").alias("up")), "label").select("node", F.col("up").alias("label")), "labels")
        # Communities become nodes; what lay inside one is its loop.
        outer = near.join(labels, "node").select(F.col("label").alias("u"), F.col("to").alias("v"), "w")
        loops = nodes.join(labels, "node").select(F.col("label").alias("u"), F.col("label").alias("v"), F.col("loop").alias("w")).filter("w > 0")
        both = saved(outer.unionByName(loops).groupBy("u", "v").agg(F.sum("w").alias("w")), "around")
        discard(near)
        nodes, around = _split(both)
    if found is None:
        return base_nodes.select("node", F.col("node").alias("label"))
    if levels > 1:
        # One level alone has ended where no node gains.
        near = saved(beside(base_edges, found), "near")
        found, after, moved = _settle(base_nodes, base_edges, found, near)
        discard(near, after)
    least = found.groupBy("label").agg(F.min("node").alias("least"))
    return found.join(least, "label").select("node", F.col("least").alias("label"))


def modularity(edges: DataFrame, labels: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None) -> float:
    """Of ``labels`` (node, label) on the graph of ``edges``; 0 for a graph without edges."""
    nodes, around = graph_of(edges, src, dst, weight)
    double = int(nodes.agg(F.sum("k").alias("k")).first().k or 0)
    inside = beside(around, labels).join(labels.withColumnRenamed("label", "to"), ["node", "to"]).agg(F.sum("w").alias("x")).first().x
    return totals(nodes, labels, int(inside or 0)) / double**2 if double else 0.0
