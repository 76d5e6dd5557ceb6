"""Parent-child links to full hierarchies: path, depth, root and descendants of every node.

1. Cycle separation, by doubling: after round k a node knows its ancestor 2^k above, or its root. When
   a round frees no node, those that are left are on a cycle or below one. A node that has found its root is written once and takes no further part;
   the last ``FINISH`` nodes that are still on their way go on within one task.
2. Heavy-path decomposition: of its children a node's chain goes on in the one with the largest subtree;
   every other child heads a chain of its own. A way to the root crosses at most log2(n) chains. Each chain gets its depth and
   first number in preorder from its parent chain. A node's depth is that of its chain's head and its place in the chain; its
   path is that of the chain's head and a piece of the chain; its descendants are one interval of numbers.

Trees of at most ``TREE`` nodes are decomposed whole, many of them in one task; the links of larger ones stay distributed, and their sizes and labels
come from rounds of doubling, over nodes and then over chains. Childless nodes, commonly most of them, take no part in either: they hang on
their parents at the end. All rounds run on 64-bit row numbers; their tables lie in the shared scratch folder. Joins on an ancestor with very many
nodes below it meet one row on the other side; adaptive execution splits those partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedgework.functions.batches import whole_groups
from sedgework.functions.forests import heavy_paths
from sedgework.functions.text import DEFAULT_PREDICATE, one_spelling
from sedgework.sources.scratch import Scratch

#: Siblings are numbered, and intervals of descendants joined, in blocks of at most so many, then the blocks are.
BLOCK = 65_536
#: Nodes with children of a tree that one task takes whole.
TREE = 200_000
#: Nodes, of 16 bytes each, that one task follows to their roots.
FINISH = 1_000_000
#: Ids in one segment of a path.
SEGMENT = 1024

LABELS = "v bigint, head bigint, pos bigint, root bigint, depth bigint, first bigint, size bigint, before_leaves bigint"


def current_links(edges: DataFrame, predicate: str = DEFAULT_PREDICATE) -> DataFrame:
    """(graph, parent, child) of the current edges of that predicate, each pair once.

    Of the rows of one (graph, id) the one with the greatest seq is current, null being least; it need
    not be of the predicate. Edges with a null endpoint don't count.
    """
    own = one_spelling(F.col("predicate")) == predicate
    rows = edges.select("graph", "id", F.struct("seq", F.when(own, F.col("source")).alias("source"), F.when(own, F.col("target")).alias("target")).alias("r"))
    current = rows.groupBy("graph", "id").agg(F.max("r").alias("r"))
    return current.select("graph", F.col("r.source").alias("parent"), F.col("r.target").alias("child")).where(F.col("parent").isNotNull() & F.col("child").isNotNull())


@dataclass
class Hierarchy:
    """Tables of one run. names: v, graph, id. inner: labels of nodes with children; leaves: of those without; lost: v without a root; up: v and parent."""

    names: DataFrame
    inner: DataFrame
    leaves: DataFrame
    lost: DataFrame
    up: DataFrame
    scratch: Scratch

    def nodes(self) -> DataFrame:
        """One row per node: graph, node_id, root_id, depth, first, last, n_descendants.

        first and last: the node's number in the preorder of its tree and that of its last descendant,
        so u is below v if they have one root and v.first < u.first <= v.last. Nodes on a cycle or below one: root_id
        '', depth -1, the rest null.
        """
        none = F.lit(None).cast("bigint")
        found = self.inner.select("v", "root", "depth", "first", "size").unionByName(self.leaves.select("v", "root", "depth", "first", F.lit(1).cast("bigint").alias("size")))
        found = found.unionByName(self.lost.select("v", none.alias("root"), F.lit(-1).cast("bigint").alias("depth"), none.alias("first"), none.alias("size")))
        roots = self.names.select(F.col("v").alias("root"), F.col("id").alias("root_id"))
        named = found.join(self.names, "v").join(roots, "root", "left")
        return named.select(
            "graph", F.col("id").alias("node_id"), F.coalesce("root_id", F.lit("")).alias("root_id"), "depth", "first", (F.col("first") + F.col("size") - 1).alias("last"), (F.col("size") - 1).alias("n_descendants")
        )

    def paths(self) -> DataFrame:
        """graph, node_id, path (array of ids from the root to the node), put together from chain segments of at most ``SEGMENT`` ids. Nodes without root have none."""
        scratch = self.scratch
        piece = F.floor(F.col("pos") / SEGMENT).cast("bigint")
        placed = self.inner.select("v", "head", piece.alias("piece"), (F.col("pos") % SEGMENT).alias("k")).join(self.names, "v")
        segments = scratch.keep(placed.groupBy("head", "piece").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("segment")), "segments")
        # the piece above: the one before in the chain, or that of the head's parent, of which just what lies above counts
        above = self.inner.select(F.col("v").alias("parent"), F.col("head").alias("up_head"), piece.alias("up_piece"), (F.col("pos") % SEGMENT + 1).alias("take"))
        tops = self.inner.where("pos = 0").select("v").join(self.up.select("v", "parent"), "v").join(above, "parent", "left")
        tops = tops.select(F.col("v").alias("head"), F.lit(0).cast("bigint").alias("piece"), "up_head", "up_piece", "take")
        later = segments.where("piece > 0").select("head", "piece", F.col("head").alias("up_head"), (F.col("piece") - 1).alias("up_piece"), F.lit(SEGMENT).cast("bigint").alias("take"))
        parts = segments.select(F.col("head").alias("up_head"), F.col("piece").alias("up_piece"), F.col("segment").alias("above"))
        none = F.array().cast("array<string>")
        way = tops.unionByName(later).join(parts, ["up_head", "up_piece"], "left")
        way = scratch.keep(way.select("head", "piece", "up_head", "up_piece", F.coalesce(F.slice("above", F.lit(1), F.col("take").cast("int")), none).alias("way")), "ways")
        while way.where(F.col("up_head").isNotNull()).take(1):
            over = way.select(F.col("head").alias("up_head"), F.col("piece").alias("up_piece"), F.col("up_head").alias("head2"), F.col("up_piece").alias("piece2"), F.col("way").alias("way2"))
            joined = way.join(over, ["up_head", "up_piece"], "left")
            way = scratch.keep(joined.select("head", "piece", F.col("head2").alias("up_head"), F.col("piece2").alias("up_piece"), F.concat(F.coalesce("way2", none), "way").alias("way")), "ways")
        chain = way.select("head", "piece", "way").join(segments, ["head", "piece"])
        inner = placed.join(chain, ["head", "piece"]).select("v", "graph", F.col("id").alias("node_id"), F.concat("way", F.slice("segment", F.lit(1), (F.col("k") + 1).cast("int"))).alias("path"))
        leaf = self.leaves.select(F.col("v").alias("leaf"), F.col("parent").alias("v")).join(inner.select("v", "path"), "v")
        leaf = leaf.join(self.names.select(F.col("v").alias("leaf"), "graph", "id"), "leaf")
        return inner.select("graph", "node_id", "path").unionByName(leaf.select("graph", F.col("id").alias("node_id"), F.concat("path", F.array("id")).alias("path")))

    def descendants(self, of: DataFrame | None = None) -> DataFrame:
        """graph, node_id, descendant_id, distance: a row for each node below each node of of (graph, node_id; None: all). Nodes without root, or with none below, give none.

        An interval join on preorder numbers, block by block: a node meets those of its tree's numbers that lie in blocks which its interval reaches.
        """
        labels = self.inner.select("v", "root", "depth", "first", "size")
        top = labels.where("size > 1")
        if of is not None:
            wanted = of.select(F.col("graph").alias("wg"), F.col("node_id").alias("wid")).distinct()
            top = top.join(self.names.join(wanted, F.col("graph").eqNullSafe(F.col("wg")) & (F.col("id") == F.col("wid"))).select("v"), "v", "left_semi")
        block = lambda c: F.floor(c / BLOCK)
        top = top.select(F.col("v").alias("a"), "root", F.col("depth").alias("a_depth"), F.col("first").alias("lo"), (F.col("first") + F.col("size") - 1).alias("hi"))
        top = top.withColumn("block", F.explode(F.sequence(block(F.col("lo") + 1), block(F.col("hi")))))
        below = labels.select("v", "root", "depth", "first").unionByName(self.leaves.select("v", "root", "depth", "first")).withColumn("block", block(F.col("first")))
        pairs = below.join(top, ["root", "block"]).where((F.col("first") > F.col("lo")) & (F.col("first") <= F.col("hi"))).select("a", "v", (F.col("depth") - F.col("a_depth")).alias("distance"))
        named = pairs.join(self.names.select("v", F.col("id").alias("descendant_id")), "v")
        return named.join(self.names.select(F.col("v").alias("a"), "graph", F.col("id").alias("node_id")), "a").select("graph", "node_id", "descendant_id", "distance")


def hierarchy(links: DataFrame) -> Hierarchy:
    """Label the forest of links (graph, parent, child), all strings. Runs its rounds when called.

    A repeated pair counts once. A child with several parents, which the data rule out, keeps the
    least. A self-link is a cycle. Null graphs are one graph; empty links give empty tables.
    """
    spark: SparkSession = links.sparkSession
    scratch = Scratch(spark, "hierarchy")
    tree = scratch.keep(links.groupBy("graph", "child").agg(F.min("parent").alias("parent")), "tree")
    ends = F.array(F.struct(F.col("parent").alias("id"), F.lit(True).alias("inner")), F.struct(F.col("child").alias("id"), F.lit(False).alias("inner")))
    nodes = tree.select("graph", F.explode(ends).alias("e")).groupBy("graph", F.col("e.id").alias("id")).agg(F.max("e.inner").alias("inner"))
    names = scratch.keep(nodes.withColumn("v", F.monotonically_increasing_id()), "names")
    up = _numbered(tree, names, scratch)

    roots, stuck = _roots(up, scratch)
    links_in = up.where(~F.col("inner")).select("v", "parent")
    lost = scratch.keep(stuck.unionByName(links_in.join(stuck.select(F.col("v").alias("parent")), "parent", "left_semi").select("v")), "lost")
    hanging = links_in.groupBy(F.col("parent").alias("v")).agg(F.count(F.lit(1)).alias("leaves"))
    rooted = up.where("inner").select("v", "parent").join(roots, "v").join(hanging, "v", "left")
    rooted = scratch.keep(rooted.select("v", "parent", "root", F.coalesce("leaves", F.lit(0)).cast("bigint").alias("leaves")), "rooted")
    inner = scratch.keep(_labels(rooted, scratch), "inner")

    hung = links_in.join(inner.select(F.col("v").alias("parent"), "root", "depth", "first", "before_leaves"), "parent")
    leaves = _number_blocks(hung, "parent", "v", F.lit(1)).select("v", "parent", "root", (F.col("depth") + 1).alias("depth"), (F.col("first") + F.col("before_leaves") + F.col("before") + 1).alias("first"))
    return Hierarchy(names.select("v", "graph", "id"), inner, leaves, lost, up.select("v", "parent"), scratch)


def _roots(up: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(v, root) of the nodes with children that have a root, and v of those that have none."""
    first = up.where("inner").select("v", F.coalesce("parent", "v").alias("root"), F.col("parent").isNotNull().alias("open"))
    done, now = first.where(~F.col("open")), first.where("open")
    before, rounds = None, 0
    while (n := now.count()) and n != before:
        rounds += 1
        known = done.unionByName(now).select(F.col("v").alias("root"), F.col("root").alias("root2"), F.col("open").alias("open2"))
        if n <= FINISH:
            ways = now.select("v", "root").join(done.select(F.col("v").alias("root"), F.col("root").alias("root2")), "root", "left")
            moved = ways.select("v", "root", "root2").repartition(1).mapInPandas(_followed, "v bigint, root bigint, open boolean")
            before = None
        else:
            moved = now.select("v", "root").join(known, "root").select("v", F.col("root2").alias("root"), F.col("open2").alias("open"))
            before = n
        moved = scratch.keep(moved, f"roots-{rounds}")
        done, now = done.unionByName(moved.where(~F.col("open"))), moved.where("open")
        if before is None:
            break
    return done.select("v", "root"), now.select("v")


def _followed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The roots of all nodes given, each with the node that it points to (root) and that one's root, if known. Those that come to no root are open."""
    rows = pd.concat(list(batches) or [pd.DataFrame({"v": [], "root": [], "root2": []})], ignore_index=True)
    v = rows["v"].to_numpy(dtype="int64")
    order = np.argsort(v)
    v, known = v[order], rows["root2"].notna().to_numpy()[order]
    root = rows["root2"].fillna(-1).astype("int64").to_numpy()[order]
    to = np.where(known, np.arange(len(v)), np.searchsorted(v, rows["root"].to_numpy(dtype="int64")[order]))
    for _ in range(max(1, len(v)).bit_length() + 1):
        to = to[to]
    yield pd.DataFrame({"v": v, "root": root[to], "open": ~known[to]})


def _labels(rooted: DataFrame, scratch: Scratch) -> DataFrame:
    """The labels of rooted nodes (v, parent, root, leaves): small trees in whole, large ones in rounds."""
    large = rooted.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TREE).select("root")
    any_large = not large.isEmpty()
    small = rooted.join(large, "root", "left_anti") if any_large else rooted

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, _ in whole_groups(batches, ["root"]):
            v = rows["v"].to_numpy()
            order = np.argsort(v)
            own, parent = v[order], rows["parent"].to_numpy(dtype=float)[order]
            top = np.isnan(parent)
            at = np.searchsorted(own, np.where(top, own[0], rows["parent"].fillna(-1).astype("int64").to_numpy()[order]))
            leaves = rows["leaves"].to_numpy()[order]
            found = heavy_paths(own, np.where(top, -1, at), leaves)
            yield pd.DataFrame({"v": own, "root": rows["root"].to_numpy()[order], **found, "before_leaves": found["size"] - leaves - 1})[[c.split()[0] for c in LABELS.split(", ")]]

    found = small.repartition("root").sortWithinPartitions("root").mapInPandas(whole, LABELS)
    return found.unionByName(_chains(_sizes(rooted.join(large, "root", "left_semi"), scratch), scratch)) if any_large else found


def _numbered(tree: DataFrame, names: DataFrame, scratch: Scratch) -> DataFrame:
    """v, parent (null for a top), inner: every node by number."""
    own = names.select(F.col("graph").alias("g"), F.col("id").alias("n"), "v", "inner")
    pairs = names.join(tree.withColumnRenamed("graph", "tg"), F.col("graph").eqNullSafe(F.col("tg")) & (F.col("id") == F.col("child")), "left").select("v", "inner", "graph", F.col("parent").alias("p"))
    above = own.select("g", "n", F.col("v").alias("parent"))
    return scratch.keep(pairs.join(above, F.col("graph").eqNullSafe(F.col("g")) & (F.col("p") == F.col("n")), "left").select("v", "parent", "inner"), "up")


def _sizes(rooted: DataFrame, scratch: Scratch) -> DataFrame:
    """v, parent, leaves, size of rooted nodes, by doubling; size counts the node and all below it."""
    now = rooted.select("v", "parent", "leaves", (F.col("leaves") + 1).alias("size"), F.col("parent").alias("j"))
    now = scratch.keep(now, "sizes")
    while now.where(F.col("j").isNotNull()).take(1):
        waiting = now.where(F.col("j").isNotNull())
        below = waiting.groupBy(F.col("j").alias("v")).agg(F.sum("size").alias("more"))
        further = waiting.select(F.col("v").alias("j"), F.col("j").alias("j2"))
        moved = waiting.select("v", "j").join(further, "j").select("v", "j2")
        now = now.drop("j").join(below, "v", "left").join(moved, "v", "left")
        now = scratch.keep(now.select("v", "parent", "leaves", (F.col("size") + F.coalesce("more", F.lit(0))).alias("size"), F.col("j2").alias("j")), "sizes")
    return now.select("v", "parent", "leaves", "size")


def _chains(rooted: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels of the nodes with children of large trees, by rounds: first along the chains, then over them."""
    children = rooted.where(F.col("parent").isNotNull())
    heaviest = children.groupBy("parent").agg(F.max(F.struct("size", "v")).alias("x"))
    heaviest = scratch.keep(heaviest.select("parent", F.col("x.v").alias("heavy"), F.col("x.size").alias("heavy_size")), "heaviest")

    # head and pos: doubling along the links to heavy children
    linked = rooted.join(heaviest.select(F.col("heavy").alias("v"), F.col("parent").alias("j")), "v", "left")
    done = linked.where(F.col("j").isNull()).select("v", F.col("v").alias("head"), F.lit(0).cast("bigint").alias("pos"))
    labels = scratch.keep(done, "labels-0")
    todo = scratch.keep(linked.where(F.col("j").isNotNull()).select("v", "j"), "todo")
    step, parts = 1, 0
    while todo.take(1):
        reached = todo.join(labels.select(F.col("v").alias("j"), "head", "pos"), "j").select("v", "head", (F.col("pos") + step).alias("pos"))
        parts += 1
        fresh = scratch.keep(reached, f"labels-{parts}")
        further = todo.select(F.col("v").alias("j"), F.col("j").alias("j2"))
        todo = scratch.keep(todo.join(further, "j").select("v", F.col("j2").alias("j")), "todo")
        labels = labels.unionByName(fresh)
        step *= 2
    labels = scratch.keep(labels, "labels")
    for i in range(parts + 1):
        scratch.drop(f"labels-{i}")

    # light siblings in preorder: after the heavy child, before the leaves
    sized = children.select("v", "parent", "size").join(heaviest, "parent")
    light = _number_blocks(sized.where(F.col("v") != F.col("heavy")), "parent", "v", F.col("size")).select(F.col("v").alias("h"), "parent", (F.col("before") + F.col("heavy_size") + 1).alias("offset"))
    tops = rooted.where(F.col("parent").isNull()).select(F.col("v").alias("h"))
    above = labels.select(F.col("v").alias("parent"), F.col("head").alias("up"), F.col("pos"))
    chains = light.join(above, "parent").select("h", "up", (F.col("pos") + 1).alias("at"), (F.col("pos") + F.col("offset")).alias("skip"))
    none = F.lit(None).cast("bigint")
    chains = scratch.keep(chains.unionByName(tops.select("h", none.alias("up"), none.alias("at"), none.alias("skip"))), "chains")

    # depth, root and first number of the chains: pointer jumping over chains
    zero = F.lit(0).cast("bigint")
    jump = scratch.keep(chains.select("h", "up", F.coalesce("up", "h").alias("root"), F.coalesce("at", zero).alias("depth"), F.coalesce("skip", zero).alias("first")), "jump")
    while jump.where(F.col("up").isNotNull()).take(1):
        over = jump.select(F.col("h").alias("up"), F.col("up").alias("up2"), F.col("root").alias("root2"), F.col("depth").alias("depth2"), F.col("first").alias("first2"))
        joined = jump.join(over, "up", "left")
        jump = scratch.keep(joined.select("h", F.col("up2").alias("up"), F.coalesce("root2", "root").alias("root"), (F.col("depth") + F.coalesce("depth2", zero)).alias("depth"), (F.col("first") + F.coalesce("first2", zero)).alias("first")), "jump")
    inner = labels.join(jump.select(F.col("h").alias("head"), "root", F.col("depth").alias("d0"), F.col("first").alias("f0")), "head")
    inner = inner.join(rooted.select("v", "leaves", "size"), "v")
    inner = inner.select("v", "head", "pos", "root", (F.col("d0") + F.col("pos")).alias("depth"), (F.col("f0") + F.col("pos")).alias("first"), "size", (F.col("size") - F.col("leaves") - 1).alias("before_leaves"))
    return inner


def _number_blocks(rows: DataFrame, group: str, item: str, size: Column) -> DataFrame:
    """rows with ``before``: the sum of size over the rows of the group with a lesser item. A group is summed in blocks, so that no task has it whole."""
    blocked = rows.withColumns({"__b": F.floor(F.col(item) / BLOCK), "__s": size.cast("bigint")})
    totals = blocked.groupBy(group, "__b").agg(F.sum("__s").alias("__t"))
    so_far = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("__g"), F.col("__b").alias("__gb"), F.coalesce(F.sum("__t").over(so_far), F.lit(0)).alias("__base"))
    within = Window.partitionBy(group, "__b").orderBy(item).rowsBetween(Window.unboundedPreceding, -1)
    numbered = blocked.withColumn("__own", F.coalesce(F.sum("__s").over(within), F.lit(0)))
    joined = numbered.join(totals, (F.col(group) == F.col("__g")) & (F.col("__b") == F.col("__gb")))
    return joined.withColumn("before", F.col("__base") + F.col("__own")).drop("__b", "__s", "__g", "__gb", "__base", "__own")
