"""Circuit graphs as tables: fan-out, depth, dust strength."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatefold.operators.observed import written
from gatefold.operators.scan import numbered
from gatefold.plans.rounds import cut
from gatefold.sources import shared


def fan_out(drivers: DataFrame) -> DataFrame:
    """(net, driver) -> driver, the nets it drives, and whether that is over the three that a source has faces for."""
    return drivers.groupBy("driver").agg(F.count_distinct("net").alias("fan_out")).withColumn("too_many", F.col("fan_out") > 3)


def nets_of_driver(drivers: DataFrame) -> DataFrame:
    """The reverse index: nets of each driver, in order."""
    return drivers.groupBy("driver").agg(F.array_sort(F.collect_set("net")).alias("nets"))


def shared_nets(drivers: DataFrame) -> DataFrame:
    """Nets with the same set of drivers are one: net, and the least net it stands for."""
    sets = drivers.groupBy("net").agg(F.array_sort(F.collect_set("driver")).alias("drivers"))
    heads = sets.groupBy("drivers").agg(F.min("net").alias("stands_for"))
    return sets.join(heads, "drivers").select("net", "stands_for")


#: Peeled nodes of a round, as counted, that are sent to the edges; more are met by a shuffle.
FEW = 500_000


class Cyclic(ValueError):
    """A graph of which some nodes are left when no more can be peeled off."""


def depth(edges: DataFrame) -> DataFrame:
    """(source, target) of an acyclic graph -> node, depth: the edges of the longest chain that ends there.

    Nodes are peeled off in rounds, as many as the graph is deep. A round joins the nodes that nothing left points at with
    their edges, takes those off the targets' in-degrees and raises their depths, in one aggregate that is the round's only
    shuffle; each edge is followed once, in whatever number of chains it is. A round is one job: what it leaves is written,
    and counted as it is written. Edges that are done with are dropped whenever half of them are.

    Repeated edges count once; edges with a null end are left out; a cycle raises Cyclic."""
    path = shared.new_path(edges.sparkSession)
    read = edges.sparkSession.read
    own = shared.stored(edges.filter("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct())
    state = own.select(F.col("target").alias("node"), F.lit(1).cast("long").alias("n")).union(own.select("source", F.lit(0).cast("long"))).groupBy("node").agg(F.sum("n").alias("waits"), F.lit(0).alias("depth"))
    shape, metrics = state.schema, {"free": F.count_if(F.col("waits") == 0), "left": F.count_if(F.col("waits") > 0), "edges": F.coalesce(F.sum("waits"), F.lit(0))}
    got = written(state, f"{path}/round=0", metrics)
    number, held = 0, got["edges"]
    while got["left"]:
        if not got["free"]:
            raise Cyclic(f"{got['left']} nodes are on cycles or behind them")
        before = read.schema(shape).parquet(f"{path}/round={number}")
        if got["edges"] < held / 2:
            own, held = shared.stored(own.join(before.select(F.col("node").alias("source")), "source", "left_semi")), got["edges"]
        free = before.filter("waits = 0").select(F.col("node").alias("source"), "depth")
        reached = own.join(F.broadcast(free) if got["free"] <= FEW else free, "source").select(F.col("target").alias("node"), F.lit(-1).cast("long").alias("waits"), (F.col("depth") + 1).alias("depth"))
        after = before.filter("waits > 0").union(reached).groupBy("node").agg(F.sum("waits").alias("waits"), F.max("depth").alias("depth"))  # an edge's target waits for it
        number += 1
        got = written(after, f"{path}/round={number}", metrics)
    return read.schema(shape).option("basePath", path).parquet(path).filter("waits = 0").select("node", "depth")


def topological(edges: DataFrame) -> DataFrame:
    """node, depth, place: an order in which every edge leads forwards, by depth, then node; places from 1."""
    return numbered(depth(edges), ["depth", "node"])


def dust_strength(links: DataFrame, seeds: DataFrame, steps: int = 15) -> DataFrame:
    """(grid, a, b) dust neighbours and (grid, node, strength) seeds -> grid, node, strength: each step loses one.

    Strengths are 15 at most, so 15 relaxations are exact; each is one equi-join and one aggregate by cell, every grid
    takes part in the same join, and each round's result is written, as it is read twice by the next."""
    both = links.select(F.col("grid").alias("g"), "a", "b").union(links.select("grid", "b", "a"))
    level = cut(seeds.groupBy("grid", "node").agg(F.max("strength").alias("strength")))
    for _ in range(min(steps, 15)):
        spread = level.filter("strength > 1").join(both, (F.col("g") == F.col("grid")) & (F.col("node") == F.col("a"))).select("grid", F.col("b").alias("node"), (F.col("strength") - 1).alias("strength"))
        level = cut(level.unionByName(spread).groupBy("grid", "node").agg(F.max("strength").alias("strength")))
    return level


def cycles(history: DataFrame) -> DataFrame:
    """(sim, t, state) -> the first t at which a state of that run comes back, and the period."""
    first = history.groupBy("sim", "state").agg(F.min("t").alias("since"))
    again = history.join(first, ["sim", "state"]).filter("t > since")
    return again.groupBy("sim").agg(F.min_by(F.struct("t", (F.col("t") - F.col("since")).alias("period")), "t").alias("c")).select("sim", "c.t", "c.period")


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) -> node, the least node it is connected with. Labels spread along edges and jump along labels, so the rounds
    grow with the logarithm of the longest path; each round is written."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("component")))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "component")
        spread = cut(near.union(labels).groupBy("node").agg(F.min("component").alias("component")))
        jump = spread.select(F.col("node").alias("over"), F.col("component").alias("further"))
        after = cut(spread.join(jump, F.col("component") == F.col("over")).select("node", F.least("component", "further").alias("component")))
        moved = after.join(labels.withColumnRenamed("component", "before"), "node").filter("component <> before").limit(1).count()
        labels = after
        if not moved:
            return labels
