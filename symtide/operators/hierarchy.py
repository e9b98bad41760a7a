"""Parent-child links to full hierarchies.

Method: connected components, each co-located in one task, and an iterative
depth-first traversal of the children with node colouring that gives depths, paths,
descendants and back edges (cycles). Components come from pointer jumping (each round
multiplies the reach, and joins and writes only the nodes not yet settled); a
component is walked from its label down. Components larger than
``max_component`` never meet in one task: their depths come from the hop counts
that the pointer jumping carries, and their paths and descendants from
joins that double the reach of each node. Both ways give the same rows in all columns.

Only nodes that can have children take part in that; childless nodes hang on by
one join at the end.

Defined results: rows with a null id are left out; a parent that does not exist
makes a root; a node that is its own parent is a cycle of one; nodes on a cycle,
or whose ancestors run into one, get depth -1 and as root the smallest id on that
cycle, and their path runs from there down, always from parent to child; repeated
rows count once; ties between rows of an id go to the largest.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.packed import first_base
from ..session import blank, hot_list, materialize, release, skew_join

#: Largest component that one task traverses, and the nodes one bucket of small components holds.
MAX_COMPONENT, BUCKET_NODES = 100_000, 50_000
#: Looks ahead in a round of pointer jumping: every look is a join, every round a written table. What runs into cycles is the
#: smaller part and has the longer way.
TREE_LOOKS, CYCLE_LOOKS = 2, 6
CLASS_KINDS = ("class", "struct", "class_template")


def components(links: DataFrame) -> DataFrame:
    """``links`` (id unique, parent null or an existing id) to (id, parent, label, hops, cyclic, ring).

    label: the root, or the smallest id of the cycle that the node runs into;
    hops: edges to the root (null when cyclic); ring: the node itself is on a cycle.
    """
    cols = ["id", "parent", F.coalesce("parent", "id").alias("ptr"), F.col("parent").isNull().alias("done"), F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.col("id").alias("low")]
    left = {"n": F.count(F.when(~F.col("done"), 1))}
    first = materialize(links.select(*cols), "links", left)
    done, active, n = [first.filter("done")], first.filter(~F.col("done")), first._symtide_told["n"]
    span, before, cyclic = 1, -1, False
    while n and not (cyclic and span >= 2 * n):
        # A round settles the next nodes of any tree, so where none has settled all the rest runs into cycles, and only meets its like.
        cyclic = cyclic or n == before
        before = n
        every = active if cyclic else reduce(DataFrame.unionByName, [*done, active])
        ahead = every.select(F.col("id").alias("key"), F.col("ptr").alias("p2"), F.col("done").alias("d2"), F.col("hops").alias("h2"), F.col("low").alias("l2"))
        moved, hot, looks = active, hot_list(active, "ptr", n), CYCLE_LOOKS if cyclic else TREE_LOOKS
        for k in range(looks):  # each look adds the reach at the start of the round
            # What has settled on the way asks for nobody: its key is its own. Beyond the first look hot keys are left to the planner's skew join.
            asking = moved.withColumn("key", F.when(F.col("done"), F.concat(F.lit("\0"), "id")).otherwise(F.col("ptr")) if k else F.col("ptr"))
            met = skew_join(asking, ahead, "key", n, "left", hot=[] if k else hot)
            moved = met.select(
                "id", "parent", F.coalesce("p2", "ptr").alias("ptr"), F.coalesce("d2", "done").alias("done"), (F.col("hops") + F.coalesce("h2", F.lit(0))).alias("hops"), F.coalesce(F.least("low", "l2"), "low").alias("low")
            )
        after = materialize(moved, "links", left)  # settled rows stay where they were written
        done.append(after.filter("done"))
        active, span, n = after.filter(~F.col("done")), span * (looks + 1), after._symtide_told["n"]
    trees = reduce(DataFrame.unionByName, done).select("id", "parent", F.col("ptr").alias("label"), "hops", F.lit(False).alias("cyclic"), F.lit(False).alias("ring"))
    if n:
        # All that is left runs into a cycle, and span covers every cycle whole.
        loose = active
        on = loose.select(F.col("id").alias("ptr"), F.col("low").alias("label"))
        # So many steps up lies a node of the cycle, and each of them lies there for some node.
        ring = loose.groupBy(F.col("ptr").alias("id")).agg(F.lit(True).alias("ring"))
        ends = skew_join(loose.drop("low"), on, "ptr", n, "inner").join(ring, "id", "left")
        ends = ends.select("id", "parent", "label", F.lit(None).cast("long").alias("hops"), F.lit(True).alias("cyclic"), F.coalesce("ring", F.lit(False)).alias("ring"))
        return materialize(trees.unionByName(ends), "components")
    return trees


def rings(comps: DataFrame) -> DataFrame:
    """(id, label, pos, k) of the nodes on cycles: places from the smallest id down, parent to child, and the cycle's length."""
    on = comps.filter("ring").select("id", F.when(F.col("id") != F.col("label"), F.col("parent")).alias("parent"), "label")
    on = materialize(on, "ring")
    cut = components(on.select("id", "parent")).select("id", F.col("hops").alias("pos"))  # each ring cut open above its smallest id
    placed = materialize(on.select("id", "label").join(cut, "id"), "ring")
    length = placed.groupBy("label").agg((F.max("pos") + 1).alias("k"))
    return skew_join(placed, length, "label", placed.count(), "inner").select("id", "label", "pos", "k")


def lift(trees: DataFrame, paths: bool) -> DataFrame:
    """``trees`` (id, parent, n, reach; no cycles) with n summed and reach carried up, and with ``up``, the ids from the node to its root.

    Each round doubles how far up and down a node sees; ``up`` is null without ``paths``.
    """
    up = F.array("id") if paths else F.lit(None).cast("array<string>")
    state, span = materialize(trees.select("id", F.col("parent").alias("ptr"), F.col("n").cast("long").alias("n"), F.col("reach").cast("long").alias("reach"), up.alias("up")), "lift"), 1
    while n := state.filter(F.col("ptr").isNotNull()).count():
        active = state.filter(F.col("ptr").isNotNull())
        ahead = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("up").alias("u2"))
        moved = skew_join(active, ahead, "ptr", n, "inner").select("id", F.col("p2").alias("ptr"), "n", "reach", F.concat("up", "u2").alias("up"))
        below = active.groupBy(F.col("ptr").alias("id")).agg(F.sum("n").alias("dn"), (F.max("reach") + span).alias("dr"))
        after = state.filter(F.col("ptr").isNull()).unionByName(moved).join(below, "id", "left")
        after = materialize(after.select("id", "ptr", (F.col("n") + F.coalesce("dn", F.lit(0))).alias("n"), F.greatest("reach", "dr").alias("reach"), "up"), "lift")
        release(state)
        state, span = after, 2 * span
    return state.select("id", "n", "reach", "up")


_NODE = "id string, root string, depth int, path array<string>, n_descendants long, on_cycle boolean"


#: Path entries after which the rows of a traversal are handed on.
ENTRIES_AT_ONCE = 200_000


def _traverse(nodes: list[tuple[str, str | None, str]], paths: bool) -> Iterator[tuple[str, str, int, list[str] | None, int | None, bool]]:
    """The rows of whole components, given as (id, parent, label), by one depth-first walk from each label down.

    A child that is grey is the upper end of a back edge: what stands on the stack from it on is a cycle.
    """
    children: dict[str, list[str]] = {}
    above: dict[str, str | None] = {}
    for i, p, _ in nodes:
        above[i] = p
        if p is not None:
            children.setdefault(p, []).append(i)
    grey, black = 1, 2
    colour: dict[str, int] = {}
    for start in sorted({label for _, _, label in nodes}):
        loop = above[start] is not None  # the label of a cycle lies on it
        stack, below, ring = [start], [0], [False]
        todo = [iter(children.get(start, ()))]
        colour[start] = grey
        while stack:
            child = next(todo[-1], None)
            if child is None:
                node, n = stack[-1], below.pop()
                on, depth = ring.pop(), -1 if loop else len(stack) - 1
                yield node, start, depth, stack.copy() if paths else None, n, on
                stack.pop()
                todo.pop()
                colour[node] = black
                if stack:
                    below[-1] += n + 1
            elif child not in colour:
                colour[child] = grey
                stack.append(child)
                below.append(0)
                ring.append(False)
                todo.append(iter(children.get(child, ())))
            elif colour[child] == grey:
                for k in range(stack.index(child), len(stack)):
                    ring[k] = True


def hierarchies(links: DataFrame, max_component: int = MAX_COMPONENT, bucket_nodes: int = BUCKET_NODES, paths: bool = True) -> DataFrame:
    """Every node of ``links`` (id unique, parent) with root, depth, path, descendants and cycle flag.

    path runs from the root to the node, each entry the parent of the next; on and below cycles it starts at
    the cycle's smallest id. Every node of a cycle has all other nodes of its component as descendants. Without
    ``paths`` path and n_descendants are null. ``max_component`` decides how, never what.
    """
    comps = components(links)
    total = comps.count()
    sizes = comps.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    giants = [r[0] for r in sizes.filter(F.col("size") > max_component).select("label").limit(total // max_component + 1).collect()]
    small = comps.filter(~F.col("label").isin(giants)) if giants else comps
    buckets = total // bucket_nodes + 1
    cols = ["id", "root", "depth", "path", "n_descendants", "on_cycle"]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows() -> Iterator[tuple]:
            held, bucket = [], None
            for b in batches:
                for i, p, label, k in zip(b["id"], b["parent"], b["label"], b["bucket"]):
                    if k != bucket and held:
                        yield from _traverse(held, paths)
                        held = []
                    bucket = k
                    held.append((i, p, label))
            yield from _traverse(held, paths)

        out, size = [], 0
        for r in rows():
            out.append(r)
            size += len(r[3] or ()) + 1
            if size > ENTRIES_AT_ONCE:
                yield pd.DataFrame(out, columns=cols)
                out, size = [], 0
        yield pd.DataFrame(out, columns=cols)

    told = small.select("id", "parent", "label", F.pmod(F.xxhash64("label"), F.lit(buckets)).cast("int").alias("bucket"))
    out = told.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInPandas(walk, _NODE)
    if paths:  # how many nodes a cycle's component has is known from its size
        whole = materialize(comps.filter("ring").select("label").distinct().join(sizes, "label"), "cycles")
        many = out.filter("on_cycle").join(whole.select(F.col("label").alias("root"), "size"), "root").withColumn("n_descendants", F.col("size") - 1).drop("size") if whole.count() else None
        out = out if many is None else out.filter(~F.col("on_cycle")).unionByName(many)
    else:
        out = out.withColumn("n_descendants", F.lit(None).cast("long"))
    if giants:
        out = out.unionByName(_giants(comps.filter(F.col("label").isin(giants)), sizes, paths))
    return out


def _giants(comps: DataFrame, sizes: DataFrame, paths: bool) -> DataFrame:
    """The nodes of ``hierarchies`` for components of any size, by joins alone."""
    depth = F.when(F.col("cyclic"), -1).otherwise(F.col("hops")).cast("int").alias("depth")
    if not paths:
        return comps.select("id", F.col("label").alias("root"), depth, F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("long").alias("n_descendants"), F.col("ring").alias("on_cycle"))
    big = materialize(comps, "giants")
    # A cycle cut open above its smallest id is a tree like any other.
    lifted = lift(big.select("id", F.when(F.col("id") != F.col("label"), F.col("parent")).alias("parent"), F.lit(1).alias("n"), F.lit(0).alias("reach")), True)
    got = materialize(big.join(lifted, "id"), "giants")
    n = F.when(F.col("ring"), F.col("size")).otherwise(F.col("n")) - 1
    return skew_join(got, sizes, "label", big.count()).select("id", F.col("label").alias("root"), depth, F.reverse("up").alias("path"), n.alias("n_descendants"), F.col("ring").alias("on_cycle"))


def descendants(nodes: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) for every node of ``hierarchies`` and each node above it, from paths.

    Above what is on or below a cycle stand all nodes of the cycle, at the least distance along the parents.
    """
    up = nodes.filter(F.size("path") > 1).select("id", "depth", F.size("path").alias("n"), F.posexplode("path").alias("at", "ancestor"))
    tree = up.filter((F.col("depth") >= 0) & (F.col("at") < F.col("n") - 1)).select("ancestor", F.col("id").alias("descendant"), (F.col("n") - 1 - F.col("at")).cast("int").alias("distance"))
    ring = nodes.filter("on_cycle").select("root", F.col("id").alias("ancestor"), (F.size("path") - 1).alias("q"))
    length = ring.groupBy("root").agg(F.count(F.lit(1)).cast("int").alias("k"))
    loose = nodes.filter("depth < 0").select("root", "id", "path", F.size("path").alias("n"))
    off = loose.select("id", "n", F.posexplode("path").alias("at", "ancestor")).filter(F.col("at") < F.col("n") - 1)
    off = off.join(ring.select("ancestor"), "ancestor", "left_anti").select("ancestor", F.col("id").alias("descendant"), (F.col("n") - 1 - F.col("at")).cast("int").alias("distance"))
    turn = F.when(F.get("path", F.col("q")).eqNullSafe(F.col("ancestor")), 0).otherwise(F.col("k"))
    on = loose.join(ring.join(length, "root"), "root").filter(F.col("id") != F.col("ancestor")).select("ancestor", F.col("id").alias("descendant"), (F.col("n") - 1 - F.col("q") + turn).cast("int").alias("distance"))
    return tree.unionByName(off).unionByName(on)


#: Nodes of a cycle that one window takes in.
RING_BLOCK = 10_000


def descendant_counts(links: DataFrame) -> DataFrame:
    """(id, n_descendants, reach) for each node of ``links`` (id, parent, is_class) with any descendant; only classes have children.

    Every node of a cycle stands above all others of it and above everything that
    hangs below the cycle, once each and at the least distance along the parents; none
    is its own descendant. Without pairs, so in linear space.
    """
    comps = materialize(components(links.filter("is_class").select("id", "parent")), "components")
    leaves = links.filter(~F.col("is_class") & F.col("parent").isNotNull()).groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("m"))
    own = comps.join(leaves, "id", "left").select("id", F.when(~F.col("ring"), F.col("parent")).alias("parent"), (1 + F.coalesce("m", F.lit(0))).alias("n"), F.when(F.col("m") > 0, 1).otherwise(0).alias("reach"))
    lifted = lift(own, False).select("id", "n", "reach")
    on = rings(comps).join(lifted, "id").select("id", "label", "pos", "k", "n", "reach", (F.col("reach") + F.col("pos")).alias("far"), F.floor(F.col("pos") / RING_BLOCK).alias("block"))
    on = materialize(on, "ring")
    # The farthest node from here on round the cycle: within the block, in the later blocks, and in what comes before.
    blocks = on.groupBy("label", "block").agg(F.max("far").alias("top"), F.sum("n").alias("bn"))
    order = Window.partitionBy("label").orderBy("block")
    blocks = blocks.select("label", "block", F.max("top").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("later"), F.max("top").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"), F.sum("bn").over(Window.partitionBy("label")).alias("total"))
    here = Window.partitionBy("label", "block").orderBy("pos")
    ahead = F.greatest(F.max("far").over(here.rowsBetween(0, Window.unboundedFollowing)), F.col("later"))
    behind = F.greatest(F.max("far").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.col("earlier")) + F.col("k")
    on = on.join(blocks, ["label", "block"]).select("id", F.col("total").alias("n"), (F.greatest(ahead, behind) - F.col("pos")).alias("reach"))
    off = lifted.join(comps.filter("ring").select("id"), "id", "left_anti")
    return off.unionByName(on).select("id", (F.col("n") - 1).alias("n_descendants"), F.col("reach").cast("int").alias("reach")).filter("n_descendants > 0")


def class_name(c: Column) -> Column:
    """A class name as it identifies the class: no blanks around, no leading ``::``, nothing from ``<`` on."""
    cut = F.regexp_replace(F.regexp_replace(c, r"^\s*(?:::)?\s*", ""), r"(?s)<.*$", "")
    return F.regexp_replace(cut, r"\s+$", "")


@F.pandas_udf(T.StringType())
def _first_base(s: pd.Series) -> pd.Series:
    return s.map(first_base, na_action="ignore")


def symbol_links(symbols: DataFrame) -> DataFrame:
    """Each usr with the usr of its parent class (or null) and whether it is a class itself."""
    rows = (
        symbols.filter(F.col("usr").isNotNull())
        .groupBy("usr")
        .agg(F.max(F.struct(F.coalesce("is_definition", F.lit(False)).alias("d"), *(F.col(c) for c in ("kind", "qualified_name", "parent_class", "base_classes")))).alias("s"))
        .select("usr", "s.*")
    )
    named = rows.select(
        F.col("usr").alias("id"),
        F.coalesce(F.col("kind").isin(*CLASS_KINDS), F.lit(False)).alias("is_class"),
        class_name(F.col("qualified_name")).alias("own"),
        F.when(~blank(F.col("parent_class")), F.col("parent_class")).alias("outer"),
        F.when(blank(F.col("parent_class")) & ~blank(F.col("base_classes")), F.col("base_classes")).alias("bases"),
    )
    wanted = named.select("id", "is_class", "own", class_name(F.coalesce("outer", _first_base("bases"))).alias("name"))
    wanted = materialize(wanted.withColumn("name", F.when(F.col("name") != "", F.col("name"))), "wanted", {"n": F.count(F.lit(1))})
    classes = wanted.filter(F.col("is_class") & (F.col("own") != "")).groupBy(F.col("own").alias("name")).agg(F.min("id").alias("parent"))
    return skew_join(wanted.select("id", "is_class", "name"), classes, "name", wanted._symtide_told["n"]).select("id", "parent", "is_class")


def symbol_hierarchy(symbols: DataFrame, paths: bool = False, max_component: int = MAX_COMPONENT) -> DataFrame:
    """(usr, root_usr, depth[, path], on_cycle) for each distinct usr of ``symbols``."""
    links = materialize(symbol_links(symbols), "parents", {"leaves": F.count(F.when(~F.col("is_class"), 1))})
    inner = links.filter("is_class")
    nodes = materialize(hierarchies(inner.select("id", "parent"), max_component, paths=paths), "nodes")
    leaves = links.filter(~F.col("is_class")).select("id", "parent")
    above = nodes.select(F.col("id").alias("parent"), "root", "depth", "path")
    hung = skew_join(leaves, above, "parent", links._symtide_told["leaves"])
    leaf = hung.select(
        F.col("id").alias("usr"),
        F.coalesce("root", "id").alias("root_usr"),
        F.when(F.col("root").isNull(), 0).when(F.col("depth") < 0, -1).otherwise(F.col("depth") + 1).cast("int").alias("depth"),
        F.when(F.col("root").isNull(), F.array("id")).otherwise(F.concat("path", F.array("id"))).alias("path"),
        F.lit(False).alias("on_cycle"),
    )
    top = nodes.select(F.col("id").alias("usr"), F.col("root").alias("root_usr"), "depth", "path", "on_cycle")
    out = top.unionByName(leaf)
    return out if paths else out.drop("path")
