"""Bounded semi-naive loops over DataFrames: every operator that walks the graph calls one of these.

Nodes are strings. Each round joins the newest rows with the edges, drops what is known, and writes the rest to the shared
folder, so that a lost executor costs one round. A loop that doesn't end within `rounds` raises.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bucketed, dropped, staged

#: Counted rows of a round that are broadcast at most: some 20 MB of keys.
FEW = 1 << 17


class Known:
    """All rows found so far, in tables of which none is less than twice as long as the one behind it: a row is written again
    a few times at most, and a round's anti join reads few tables however many rounds there were."""

    def __init__(self, first: DataFrame, keep: Callable[[DataFrame], DataFrame] = staged):
        self.parts, self.keep = [(first.count(), first)], keep

    def newest(self) -> int:
        return self.parts[-1][0]

    def add(self, n: int, part: DataFrame) -> None:
        self.parts.append((n, part))
        while len(self.parts) > 1 and self.parts[-2][0] < 2 * self.parts[-1][0]:
            (m, x), (k, y) = self.parts[-2:]
            self.parts[-2:] = [(m + k, (self.keep if m + k > FEW else staged)(x.unionByName(y)))]
            dropped(x)
            if y is not part:  # the newest rows are the next round's start
                dropped(y)

    def without(self, df: DataFrame, keys: list[str], few: bool = False) -> DataFrame:
        """Those rows of df that aren't known, table by table: what lies in buckets stays where it is. If df has few rows, it is
        sent to what is known, which is neither moved nor sorted; as few come back."""
        if few:
            old = self.all().select(*keys).join(F.broadcast(df.select(*keys)), keys, "left_semi")
            return df.join(F.broadcast(old), keys, "left_anti")
        return reduce(lambda x, part: x.join(part[1].select(*keys).hint("shuffle_merge"), keys, "left_anti"), self.parts, df)

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [x for _, x in self.parts])


def grow(start: DataFrame, edges: DataFrame, keys: list[str], step, rounds: int = 1000) -> DataFrame:
    """start with all that step(newest rows joined with edges on node = src, round) adds, a row for each value of keys.

    Edges are written once, in buckets by src, and rows in buckets by node, so that no round shuffles either: what a round
    finds moves once, to the buckets of its nodes. Rows that were counted, and are few, are broadcast: then nothing is sorted."""
    keep = lambda df: bucketed(df, "node")
    new, own = keep(start), not hasattr(edges, "_table")
    edges = bucketed(edges, "src") if own else edges
    known = Known(new, keep)
    n = known.newest()
    for k in range(1, rounds + 1):
        found = step(new.hint("broadcast" if n <= FEW else "shuffle_merge").join(edges, new["node"] == edges["src"]), k).dropDuplicates(keys)
        if n <= FEW:
            found = staged(found)
            few = found.count() <= FEW
            new = (staged if few else keep)(known.without(found, keys, few))
            dropped(found)
        else:
            new = keep(known.without(found, keys))
        if not (n := new.count()):
            dropped(new, *[edges] * own)
            return known.all()
        known.add(n, new)
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def walk(seeds: DataFrame, edges: DataFrame, step, rounds: int) -> DataFrame:
    """grow() by node, over edges of which equal ones are kept once."""
    edges = bucketed(edges.select("src", "dst"), "src", once=True)
    out = grow(seeds.dropDuplicates(["node"]), edges, ["node"], step, rounds)
    dropped(edges)
    return out


def reach(seeds: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """node: seeds(node) and all that edges(src, dst) lead to from there."""
    return walk(seeds.select("node"), edges, lambda j, k: j.select(F.col("dst").alias("node")), rounds)


def bfs(seeds: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, d): the least number of edges(src, dst) from seeds(node)."""
    return walk(seeds.select("node", F.lit(0).alias("d")), edges, lambda j, k: j.select(F.col("dst").alias("node"), F.lit(k).alias("d")), rounds)


def closure(roots: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(root, node): what each of roots(node) reaches by one edge or more; itself only on a cycle."""
    edges = bucketed(edges.select("src", "dst"), "src", once=True)
    start = roots.select(F.col("node").alias("root")).distinct().hint("shuffle_merge").join(edges, F.col("root") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
    return grow(start, edges, ["root", "node"], lambda j, k: j.select("root", F.col("dst").alias("node")), rounds)


def longest(nodes: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, level): edges on the longest path that ends in each of nodes(node), by edges(src, dst) among them.

    Level k + 1 is what level k leads to; a cycle never empties, and raises.
    """
    new = bucketed(nodes.select("node"), "node", once=True)
    within = new.select(F.col("node").alias("dst"))
    edges = bucketed(edges.select("src", "dst").join(within.hint("shuffle_merge"), "dst", "left_semi").select("src", "dst"), "src", once=True)
    levels = new.withColumn("level", F.lit(0))
    for k in range(1, rounds + 1):
        new = bucketed(new.hint("shuffle_merge").join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct(), "node")
        if new.isEmpty():
            dropped(edges, new)
            return levels.groupBy("node").agg(F.max("level").alias("level"))
        levels = levels.unionByName(new.withColumn("level", F.lit(k)))
    raise RuntimeError(f"a cycle, or a path of more than {rounds} edges")


def trimmed(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """Those of edges(src, dst) whose ends both have an edge in and an edge out among them: what is left may lie on a cycle."""
    live, n = edges, edges.count()
    for _ in range(rounds):
        if not n:
            return live
        ends = live.select(F.col("src").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(live.select(F.col("dst").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))
        inner = ends.groupBy("node").agg(F.max("out").alias("out"), F.max("in").alias("in")).where("out = 1 and in = 1").select("node")
        core = staged(live.join(inner.withColumnRenamed("node", "src").hint("shuffle_merge"), "src", "left_semi").join(inner.withColumnRenamed("node", "dst").hint("shuffle_merge"), "dst", "left_semi").select("src", "dst"))
        if live is not edges:
            dropped(live)
        live, m = core, core.count()
        if m == n:
            return live
        n = m
    raise RuntimeError(f"a path of more than {rounds} edges")


def strong_components(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, root) for each node on a cycle of edges(src, dst), where root is the least node of its strongly connected component.

    Edges that lie on no cycle are trimmed away. Then every node takes the least node that leads to it as its colour; the
    nodes of a colour from which its own node can be reached are a component. What is left starts again.
    """
    own = staged(edges.select("src", "dst").distinct())
    live, out = trimmed(own, rounds), []
    for _ in range(rounds):
        if live.isEmpty():
            break
        colour = staged(live.select(F.col("src").alias("node")).distinct().select("node", F.col("node").alias("colour")))
        for _ in range(rounds):
            led = live.join(colour.withColumnRenamed("node", "src").hint("shuffle_merge"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("led"))
            after = staged(colour.join(led.hint("shuffle_merge"), "node", "left").select("node", F.least("colour", F.coalesce("led", "colour")).alias("colour"), (F.col("led") < F.col("colour")).alias("moved")))
            dropped(colour)
            colour = after
            if not after.where("moved").count():
                break
        else:
            raise RuntimeError(f"no fixpoint after {rounds} rounds")
        at = lambda end: colour.select(F.col("node").alias(end), F.col("colour").alias("of_" + end))
        within = staged(live.join(at("src").hint("shuffle_merge"), "src").join(at("dst").hint("shuffle_merge"), "dst").where("of_src = of_dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = staged(reach(colour.where("node = colour"), within, rounds).join(colour.select("node", F.col("colour").alias("root")).hint("shuffle_merge"), "node"))
        out.append(found)
        gone = found.select("node")
        rest = staged(live.join(gone.withColumnRenamed("node", "src").hint("shuffle_merge"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst").hint("shuffle_merge"), "dst", "left_anti"))
        dropped(colour, within)
        live = trimmed(rest, rounds)
    else:
        raise RuntimeError(f"components left after {rounds} rounds")
    empty = own.select(F.col("src").alias("node"), F.col("dst").alias("root")).limit(0)
    # A node that trimming leaves between two components is one of its own, and on no cycle unless it leads to itself.
    all_ = reduce(DataFrame.unionByName, out, empty)
    alone = all_.groupBy("root").agg(F.count("*").alias("n")).where("n = 1").select("root").join(own.where("src = dst").select(F.col("src").alias("root")), "root", "left_anti")
    return all_.join(alone, "root", "left_anti").select("node", "root")


def cycles(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(root, size, path): for each strongly connected component of edges(src, dst) its least node, how many nodes it has, and
    the shortest cycle through that node as a text a -> b -> a, the least of several. A node keeps one path, whatever leads to it."""
    members = staged(strong_components(edges, rounds))
    size = members.groupBy("root").agg(F.count("*").alias("size"))
    of = lambda end: members.select(F.col("node").alias(end), F.col("root").alias("of_" + end))
    inner = staged(edges.select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").where("of_src = of_dst").select("src", "dst"))
    paths = staged(members.where("node = root").select("root", "node", F.array("node").alias("path")))
    seen, closed = paths.select("root", "node").limit(0), []
    for _ in range(rounds):
        if paths.isEmpty():
            out = reduce(DataFrame.unionByName, closed, paths.select("root", "path"))
            return out.join(size, "root").select("root", "size", F.array_join("path", " -> ").alias("path"))
        step = staged(paths.join(inner, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path")))
        done = step.where("node = root").select("root", "path")
        closed.append(done)
        more = step.join(done.select("root"), "root", "left_anti").join(seen, ["root", "node"], "left_anti")
        paths = staged(more)
        seen = seen.unionByName(paths.select("root", "node"))
    raise RuntimeError(f"a cycle of more than {rounds} nodes")


def simple_cycles(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """path: an array a, b, ..., a for each simple cycle of edges(src, dst), from each of its nodes.

    Only edges within a strongly connected component are walked. A cycle is found once, from its least node over greater ones,
    and then turned to start at each of its nodes."""
    part = staged(strong_components(edges, rounds))
    of = lambda end: part.select(F.col("node").alias(end), F.col("root").alias("of_" + end)).hint("shuffle_merge")
    inner = staged(edges.select("src", "dst").distinct().join(of("src"), "src").join(of("dst"), "dst").where("of_src = of_dst").select("src", "dst"))
    paths = staged(inner.where("src <= dst").select(F.array("src", "dst").alias("path")))
    first, last, back = F.col("path")[0], F.element_at("path", -1), F.col("path")[0] == F.element_at("path", -1)
    known = Known(staged(paths.where(back)))
    for k in range(rounds):
        if k and (n := paths.where(back).count()):
            known.add(n, staged(paths.where(back)))
        on = paths.where(~back).join(inner.hint("shuffle_merge"), last == F.col("src")).where((F.col("dst") == first) | ((F.col("dst") > first) & ~F.array_contains("path", F.col("dst"))))
        more = staged(on.select(F.concat("path", F.array("dst")).alias("path")))
        dropped(paths)
        paths = more
        if paths.isEmpty():
            n = F.size("path") - 1
            turned = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.slice("path", k + 1, n - k), F.slice("path", F.lit(1), k + 1)))
            return known.all().select(F.explode(turned).alias("path"))
    raise RuntimeError(f"a cycle of more than {rounds} nodes")


def radius(roots: DataFrame, edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """(node, radius): how many nodes each of roots(node) reaches by one edge or more of edges(src, dst), itself only on a cycle.

    Cycles are closed up to their components first. The walk goes from component to component and adds up members, so a
    component of n nodes costs one row for each root outside it instead of n, and one row in all for its own nodes.
    """
    edges = staged(edges.select("src", "dst").distinct())
    part = staged(strong_components(edges, rounds))
    of = lambda end: part.select(F.col("node").alias(end), F.col("root").alias("of_" + end))
    merged = edges.join(of("src").hint("shuffle_merge"), "src", "left").join(of("dst").hint("shuffle_merge"), "dst", "left").select(F.coalesce("of_src", "src").alias("src"), F.coalesce("of_dst", "dst").alias("dst"))
    start = staged(roots.select("node").distinct().join(part.withColumnRenamed("root", "part").hint("shuffle_merge"), "node", "left").select("node", F.coalesce("part", "node").alias("part")))
    size = part.groupBy(F.col("root").alias("part")).agg(F.count("*").alias("size"))
    pairs = closure(start.select(F.col("part").alias("node")), merged.where("src <> dst"), rounds).select("root", F.col("node").alias("part"))
    own = start.join(size.select("part").hint("shuffle_merge"), "part", "left_semi").select(F.col("part").alias("root"), "part").distinct()
    reached = pairs.unionByName(own).join(size.hint("shuffle_merge"), "part", "left").groupBy("root").agg(F.sum(F.coalesce("size", F.lit(1))).alias("radius"))
    return start.join(reached.withColumnRenamed("root", "part").hint("shuffle_merge"), "part").select("node", "radius")
