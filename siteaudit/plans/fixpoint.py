"""Iterative joins to a fixpoint, one checkpoint per round.

Long paths do not mean many rounds: nodes with a single way on are jumped over by pointer doubling
(rake and compress), so a chain of n nodes takes log n rounds. What is found is appended as new
tables and never rewritten, but for a merge of many small ones every ``MERGE`` rounds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.plans import session

MERGE = 16
# A trimming round is slow when it takes less than one edge in SLOW.
SLOW = 64


def cut(df: DataFrame) -> DataFrame:
    """A lineage cut whose joins are shuffled.

    Rounds read small files of keys, and a broadcast of each, unpacked, goes through the driver: its
    megabytes would add up over the rounds with the size of the graph.
    """
    return session.cut(df).hint("merge")


def _empty(df: DataFrame) -> bool:
    return df.limit(1).count() == 0


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Found:
    """An append-only table: each round adds the rows it wrote."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    def add(self, part: DataFrame) -> None:
        self.parts.append(part)
        if len(self.parts) > MERGE:
            self.parts = [cut(_all(self.parts))]

    def rows(self) -> DataFrame:
        return _all(self.parts)


def closure(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """Everything reachable: ``seeds(root, node)``, ``edges(src, dst)`` -> (root, node).

    Each round joins only the newest frontier and drops what was seen, so cycles end.
    """
    edges = edges.select("src", "dst").distinct()
    frontier = cut(seeds.select("root", "node").distinct())
    seen = Found(frontier)
    while not _empty(frontier):
        step = frontier.join(edges, frontier["node"] == edges["src"]).select(
            "root", F.col("dst").alias("node")
        )
        frontier = cut(step.distinct().join(seen.rows(), ["root", "node"], "left_anti"))
        seen.add(frontier)
    return seen.rows()


def spread_min(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest ``label`` that reaches each node along the edges: nodes(node, label).

    Only nodes whose label fell in the last round push it on; the fallen labels are appended.
    """
    frontier = cut(nodes.select("node", "label"))
    found = Found(frontier)
    while True:
        pushed = (
            frontier.join(edges, frontier["node"] == edges["src"])
            .groupBy(F.col("dst").alias("node"))
            .agg(F.min("label").alias("new"))
        )
        now = found.rows().join(pushed, "node", "left_semi")
        held = now.groupBy("node").agg(F.min("label").alias("label"))
        frontier = cut(pushed.join(held, "node").where("new < label").select("node", F.col("new").alias("label")))
        if _empty(frontier):
            return found.rows().groupBy("node").agg(F.min("label").alias("label"))
        found.add(frontier)


def jumped(pointers: DataFrame) -> DataFrame:
    """Pointer doubling over ``pointers(node, to, w, b, least, last, hops)``, one pointer a node.

    ``to`` ends outside the pointing nodes, or stays inside on a cycle (``inside`` is then true).
    On the way w adds up, b is the (max, +) bound of what was passed, least the smallest node
    passed, last the last pointing node and hops their number.
    """
    now = cut(pointers)
    for _ in range(max(now.count(), 1).bit_length() + 1):
        ahead = now.select(*[F.col(c).alias("n_" + c) for c in now.columns])
        joined = now.join(ahead, now["to"] == ahead["n_node"], "left")
        hit = F.col("n_node").isNotNull()
        step = joined.select(
            "node",
            F.coalesce("n_to", "to").alias("to"),
            F.when(hit, F.col("w") + F.col("n_w")).otherwise(F.col("w")).alias("w"),
            F.when(hit, F.greatest("b", F.col("n_b") + F.col("w"))).otherwise(F.col("b")).alias("b"),
            F.least("least", "n_least").alias("least"),
            F.coalesce("n_last", "last").alias("last"),
            F.when(hit, F.col("hops") + F.col("n_hops")).otherwise(F.col("hops")).alias("hops"),
            hit.alias("moved"),
        )
        step = cut(step)
        now = step.drop("moved")
        if _empty(step.where("moved")):
            return now.withColumn("inside", F.lit(False))
    inside = now.select(F.col("node").alias("to"), F.lit(True).alias("inside"))
    return now.join(inside, "to", "left").withColumn("inside", F.coalesce("inside", F.lit(False)))


def _pointers(df: DataFrame) -> DataFrame:
    """df(node, to[, w, b]) as ``jumped`` reads it."""
    w = F.col("w") if "w" in df.columns else F.lit(1)
    b = F.col("b") if "b" in df.columns else F.lit(0)
    return df.select(
        "node", "to", w.cast("bigint").alias("w"), b.cast("bigint").alias("b"), F.col("node").alias("least"),
        F.col("node").alias("last"), F.lit(1).cast("bigint").alias("hops"),
    )


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch no node of ``gone(node)``."""
    return edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(
        gone.select(F.col("node").alias("dst")), "dst", "left_anti"
    ).select("src", "dst")


def _dead_ends(edges: DataFrame) -> DataFrame:
    """Ends of edges without a way on, and nodes whose single way leads to one."""
    ways = cut(edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to")))
    ends = edges.select(F.col("dst").alias("node")).distinct().join(ways, "node", "left_anti")
    led = jumped(_pointers(ways.where("n = 1"))).where("NOT inside").select("node", "to")
    led = led.join(ways.select(F.col("node").alias("to")), "to", "left_anti").select("node")
    return cut(ends.unionByName(led))


def _coloured(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of a graph without dead ends and plain chains: (node, comp).

    Colour by the smallest label that reaches a node; members of a colour that reach its root
    form one component; take them out and repeat on the rest.
    """
    left, done = nodes, None
    while not _empty(left):
        colour = spread_min(left.withColumn("label", F.col("node")), edges)
        colour = cut(colour)
        c1 = colour.select(F.col("node").alias("src"), F.col("label").alias("cs"))
        c2 = colour.select(F.col("node").alias("dst"), F.col("label").alias("cd"))
        inside = edges.join(c1, "src").join(c2, "dst").where("cs = cd")
        back = cut(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        roots = colour.where("node = label").select(F.col("node").alias("root"), "node")
        comp = cut(closure(roots, back).select("node", F.col("root").alias("comp")))
        done = Found(comp) if done is None else done
        if done.parts[-1] is not comp:
            done.add(comp)
        left = cut(left.join(comp, "node", "left_anti"))
        edges = cut(_without(edges, comp))
    return nodes.withColumn("comp", F.col("node")) if done is None else done.rows()


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp): comp is the smallest member of the node's strongly connected component.

    Nodes that no cycle can hold are trimmed from both ends. Nodes with one way in and one out are
    jumped over: such a chain belongs to a component if both its ends belong to it, and a chain
    without ends is a component. The rest is coloured.
    """
    every = nodes.select("node").distinct()
    edges = _trimmed(cut(edges.select("src", "dst").where("src <> dst").distinct()))
    left = cut(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    alone = every.join(left, "node", "left_anti").withColumn("comp", F.col("node"))
    if _empty(left):
        return alone
    found = cut(_core(left, edges))
    least = found.groupBy("comp").agg(F.min("node").alias("least"))
    return alone.unionByName(found.join(least, "comp").select("node", F.col("least").alias("comp")))


def _turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges whose start can be reached and whose end leads on, again and again.

    A round that takes few edges meets long tails; those are jumped over, in both directions.
    """
    before = edges.count()
    while before:
        edges = cut(
            edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            .join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            .select("src", "dst")
        )
        after = edges.count()
        if after == before:
            return edges
        if after and (before - after) * SLOW < before:
            for _ in range(2):
                edges = _turned(cut(_without(edges, _dead_ends(edges))))
            after = edges.count()
        before = after
    return edges


def _core(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of what trimming left; directions do not matter for them."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("no"), F.min("dst").alias("to"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ni"), F.min("src").alias("pred"))
    plain = cut(out.join(into, "node").where("no = 1 AND ni = 1").select("node", "to", "pred"))
    walked = cut(jumped(_pointers(plain)))
    rings = walked.where("inside").select("node", F.col("least").alias("comp"))
    chains = walked.where("NOT inside").join(plain.select("node", "pred"), "node")
    ends = cut(
        chains.groupBy("last").agg(F.max_by("pred", "hops").alias("u"), F.min("to").alias("v"))
    )
    rest = nodes.join(plain.select("node"), "node", "left_anti")
    short = _without(edges, plain).unionByName(ends.select(F.col("u").alias("src"), F.col("v").alias("dst")))
    comp = cut(_coloured(cut(rest), cut(short.where("src <> dst").distinct())))
    a = comp.select(F.col("node").alias("u"), F.col("comp").alias("cu"))
    b = comp.select(F.col("node").alias("v"), F.col("comp").alias("cv"))
    both = ends.join(a, "u").join(b, "v").select("last", F.when(F.col("cu") == F.col("cv"), F.col("cu")).alias("c"))
    members = chains.select("node", "last").join(both, "last").select("node", F.coalesce("c", "node").alias("comp"))
    return comp.select("node", "comp").unionByName(rings).unionByName(members)


def topo_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, comp, level, cyclic) for edges src -> dst meaning src depends on dst.

    Level 0 depends on nothing, level n on something of level n - 1; a cycle is one step.
    """
    edges = cut(edges.select("src", "dst").distinct())
    left = cut(nodes.select("node").distinct())
    live_edges = cut(
        edges.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(
            left.withColumnRenamed("node", "dst"), "dst", "left_semi"
        )
    )
    comp = cut(strong_components(left, live_edges))
    a = comp.select(F.col("node").alias("src"), F.col("comp").alias("cs"))
    b = comp.select(F.col("node").alias("dst"), F.col("comp").alias("cd"))
    joined = live_edges.join(a, "src").join(b, "dst")
    dag = joined.where("cs <> cd").select(F.col("cs").alias("src"), F.col("cd").alias("dst")).distinct()
    selfish = joined.where("src = dst").select(F.col("cs").alias("comp")).distinct()
    big = comp.groupBy("comp").count().where("count > 1").select("comp")
    cyclic = big.unionByName(selfish).distinct().withColumn("cyclic", F.lit(True))
    levels = dag_levels(comp.select(F.col("comp").alias("node")).distinct(), dag).withColumnRenamed("node", "comp")
    return comp.join(levels, "comp").join(cyclic, "comp", "left").select(
        "node", "comp", F.col("level").cast("int").alias("level"), F.coalesce("cyclic", F.lit(False)).alias("cyclic")
    )


def dag_levels(nodes: DataFrame, dag: DataFrame) -> DataFrame:
    """(node, level) of an acyclic graph: one more than the highest level depended on.

    A node keeps a base (the level that its settled dependencies ask for) and its open edges with
    weights. Each round settles nodes without open edges, folds them into the bases of what depends
    on them, and jumps over nodes with one open edge: their level is max(b, level(root) + w), which
    composes along a path. Settled and jumped nodes leave the round's tables for good; the jumped ones
    get their level at the end, the last round's first.
    """
    live = nodes.select("node", F.lit(0).cast("bigint").alias("base"))
    edges = cut(dag.select("src", "dst", F.lit(1).cast("bigint").alias("w")))
    settled: list[DataFrame] = []
    waiting: list[DataFrame] = []

    def counted(live: DataFrame, edges: DataFrame) -> DataFrame:
        ways = edges.groupBy(F.col("src").alias("node")).agg(
            F.count(F.lit(1)).alias("n"), F.min("dst").alias("to"), F.max("w").alias("w")
        )
        return cut(live.join(ways, "node", "left").withColumn("n", F.coalesce("n", F.lit(0))))

    def raised(live: DataFrame, asked: DataFrame) -> DataFrame:
        return live.join(asked, "node", "left").select(
            "node", F.greatest("base", F.coalesce("asked", F.lit(0))).alias("base")
        )

    while True:
        state = counted(live, edges)
        n = state.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("n") == 1).alias("one")).first()
        if not n["all"]:
            break
        if n["one"] * 2 >= n["all"]:
            # Half of the nodes have one way on: jump over them instead of walking.
            single = state.where("n = 1").select("node", "to", "w", F.col("base").alias("b"))
            path = cut(jumped(_pointers(single)).select("node", F.col("to").alias("root"), "w", "b"))
            waiting.append(path)
            over = path.select(F.col("node").alias("dst"), "root", F.col("w").alias("pw"), F.col("b").alias("pb"))
            moved = cut(
                edges.join(path.select(F.col("node").alias("src")), "src", "left_anti")
                .join(over, "dst", "left")
                .select(
                    "src",
                    F.coalesce("root", "dst").alias("dst"),
                    (F.col("w") + F.coalesce("pw", F.lit(0))).alias("w"),
                    (F.col("w") + F.col("pb")).alias("asked"),
                )
            )
            asked = moved.groupBy(F.col("src").alias("node")).agg(F.max("asked").alias("asked"))
            live = raised(state.where("n <> 1").select("node", "base"), asked)
            edges = cut(moved.groupBy("src", "dst").agg(F.max("w").alias("w")))
            state = counted(live, edges)
        free = state.where("n = 0").select("node", F.col("base").alias("level"))
        settled.append(free)
        met = edges.join(free.withColumnRenamed("node", "dst"), "dst", "left")
        asked = met.where("level IS NOT NULL").groupBy(F.col("src").alias("node")).agg(
            F.max(F.col("level") + F.col("w")).alias("asked")
        )
        live = raised(state.where("n > 0").select("node", "base"), asked)
        edges = cut(met.where("level IS NULL").select("src", "dst", "w"))
    levels = Found(_all(settled) if settled else live.withColumnRenamed("base", "level"))
    for path in reversed(waiting):
        root = levels.rows().select(F.col("node").alias("root"), "level")
        levels.add(
            cut(path.join(root, "root").select("node", F.greatest("b", F.col("level") + F.col("w")).alias("level")))
        )
    return levels.rows()
