"""Call graph, include graph and inheritance graph: neighbours, levels, paths and orders.

Every traversal is one join per level over the whole frontier. Levels are written
to the shared folder, so lineage stays short and a lost executor costs one level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming
from ..functions.usr import usr_display_name
from ..session import hot_list, materialize, release, skew_join


def known_callees(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``edges`` with ``callee_name`` and ``known``: whether the callee is a symbol of the index."""
    known = symbols.select(F.col("usr").alias("callee_usr"), F.col("name").alias("callee_name"), F.lit(True).alias("known"))
    edges = materialize(edges, "edges")
    return skew_join(edges, known, "callee_usr", edges.count()).withColumn("known", F.coalesce("known", F.lit(False)))


def named_pairs(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(caller_usr, callee_usr, n_sites, templated) with <end>_name, <end>_project and <end>_known of both ends; names decoded where unknown."""
    pairs = materialize(edges.groupBy("caller_usr", "callee_usr").agg(F.count(F.lit(1)).alias("n_sites"), F.max("templated").alias("templated")), "pairs")
    n = pairs.count()
    for end in ("caller", "callee"):  # a hot end takes its symbol from a broadcast
        known = symbols.select(F.col("usr").alias(f"{end}_usr"), F.col("qualified_name").alias("q"), F.col("is_project").alias("p"), F.lit(True).alias("k"))
        met = skew_join(pairs, known, f"{end}_usr", n)
        name = F.coalesce("q", usr_display_name(F.when(F.col("q").isNull(), F.col(f"{end}_usr"))))
        pairs = met.withColumns({f"{end}_name": name, f"{end}_project": F.coalesce("p", F.lit(False)), f"{end}_known": F.coalesce("k", F.lit(False))}).drop("q", "p", "k")
        pairs = materialize(pairs, "pairs")
    return pairs


def callers(pairs: DataFrame) -> DataFrame:
    """(callee_usr, caller_usr, caller_name, is_project) of ``named_pairs``: who calls what."""
    return pairs.select("callee_usr", "caller_usr", "caller_name", F.col("caller_project").alias("is_project"))


def callees(pairs: DataFrame) -> DataFrame:
    """(caller_usr, callee_usr, callee_name, is_project, origin): symbol, template (an unknown callee reached through a project type) or external."""
    origin = F.when(F.col("callee_known"), "symbol").when(F.col("templated"), "template").otherwise("external")
    return pairs.select("caller_usr", "callee_usr", "callee_name", F.col("callee_project").alias("is_project"), origin.alias("origin"))


def project_or_all(neighbours: DataFrame, here: str) -> DataFrame:
    """Project neighbours of every ``here``; where it has none, all of them, marked in ``expanded``."""
    has = neighbours.groupBy(here).agg(F.max(F.col("is_project").cast("int")).alias("__p"))
    met = neighbours.join(has, here)
    return met.filter(F.col("is_project") | (F.col("__p") == 0)).withColumn("expanded", F.col("__p") == 0).drop("__p")


def calls_of(edges: DataFrame) -> DataFrame:
    """Every outgoing site of ``known_callees`` whose callee is known, or external but reached through a template."""
    return edges.filter("known OR templated").select("caller_usr", "callee_usr", "file", "line", "column_no", F.coalesce("display_name", "callee_name").alias("target"), "known")


#: Written levels that a traversal reads side by side before it merges them.
MERGE_LEVELS = 8


def levels(edges: DataFrame, start: DataFrame, src: str, dst: str, max_depth: int | None = None) -> DataFrame:
    """(node, depth): everything reachable from ``start`` (node) over ``edges``, at its least depth."""
    hops = materialize(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct(), "hops")
    n = hops.count()
    hubs = hot_list(hops, "node", n)
    frontier = materialize(start.select("node").distinct().withColumn("depth", F.lit(0)), "level")
    parts, depth = [frontier], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = skew_join(hops, frontier.select("node"), "node", n, "inner", hot=hubs).select(F.col("next").alias("node")).distinct()
        seen = reduce(DataFrame.unionByName, parts)
        frontier = materialize(step.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if frontier.isEmpty():
            break
        parts.append(frontier)
        if len(parts) > MERGE_LEVELS:
            whole = materialize(reduce(DataFrame.unionByName, parts), "levels")
            for part in parts[:-1]:
                release(part)
            parts = [whole]
    release(hops)
    return reduce(DataFrame.unionByName, parts)


def _totals(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count(F.lit(1)), F.sum("depth")).first())


def closure(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, above, depth): every pair linked by one or more ``edges``, at the least distance; each round doubles the reach.

    A node on a cycle stands above itself. A pair farther apart than the reach has its first leg exactly that long, so a round
    joins only the pairs at that distance with all others, and writes only what is new. The rounds grow with the logarithm of the depth.
    """
    told = {"n": F.count(F.lit(1))}
    parts, span = [materialize(edges.select(F.col(src).alias("node"), F.col(dst).alias("above")).distinct().withColumn("depth", F.lit(1)), "closure", told)], 1
    edge = parts[0]
    while edge._symtide_told["n"]:
        known = reduce(DataFrame.unionByName, parts)
        leg = edge.filter(F.col("depth") == span)  # nothing older is that long
        more = known.select(F.col("node").alias("above"), F.col("above").alias("top"), F.col("depth").alias("more"))
        longer = leg.join(more, "above").select("node", F.col("top").alias("above"), (F.col("depth") + F.col("more")).alias("depth"))
        fresh = longer.groupBy("node", "above").agg(F.min("depth").alias("depth")).join(known.select("node", "above"), ["node", "above"], "left_anti")
        span *= 2
        edge = materialize(fresh, "closure", {"n": F.count(F.when(F.col("depth") == span, 1))})
        parts.append(edge)
    return reduce(DataFrame.unionByName, parts)


def bfs_paths(edges: DataFrame, sources: DataFrame, targets: DataFrame, src: str, dst: str, max_depth: int = 10) -> DataFrame:
    """(source, target, path): of each source and target (node) one shortest path of at most ``max_depth`` - 1 edges.

    All sources advance together, one join per level; a node keeps the path through the least of its parents. A
    target is not passed through; a source that is a target gives the path of itself alone.
    """
    hops = materialize(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct(), "hops")
    ends = materialize(targets.select("node").distinct().withColumn("end", F.lit(True)), "targets")
    mark = lambda df: df.join(ends, "node", "left").select("source", "node", "path", F.coalesce("end", F.lit(False)).alias("end"))
    start = sources.select("node").distinct()
    frontier = materialize(mark(start.select(F.col("node").alias("source"), "node", F.array("node").alias("path"))), "level")
    parts = [frontier]
    for _ in range(max_depth - 1):
        step = frontier.filter(~F.col("end")).join(hops, "node").groupBy("source", F.col("next").alias("node")).agg(F.min(F.struct(F.col("node").alias("parent"), "path")).alias("best"))
        step = step.select("source", "node", F.concat("best.path", F.array("node")).alias("path"))
        seen = reduce(DataFrame.unionByName, parts).select("source", "node")
        frontier = materialize(mark(step.join(seen, ["source", "node"], "left_anti")), "level")
        if frontier.isEmpty():
            break
        parts.append(frontier)
    return reduce(DataFrame.unionByName, parts).filter("end").select("source", F.col("node").alias("target"), "path")


def bfs_path(edges: DataFrame, source: str, target: str, src: str, dst: str, max_depth: int = 10) -> list[str] | None:
    """``bfs_paths`` of one source and one target; None if there is none."""
    one = lambda x: edges.sparkSession.createDataFrame([(x,)], "node string")
    got = bfs_paths(edges, one(source), one(target), src, dst, max_depth).first()
    return got["path"] if got else None


def walk_counts(edges: DataFrame, src: str, dst: str, max_depth: int) -> DataFrame:
    """(node, depth, n): how many walks of each length start at each node, cycles unrolled; counts are multiplied, no walk is made."""
    hops = materialize(edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct(), "hops")
    total, parts = hops.count(), []
    hubs = hot_list(hops, "next", total)
    for k in range(1, max_depth + 1):
        if parts:
            ahead = parts[-1].select(F.col("node").alias("next"), "n")
            one = skew_join(hops, ahead, "next", total, "inner", hot=hubs)
        else:
            one = hops.withColumn("n", F.lit(1).cast("long"))
        parts.append(materialize(one.groupBy("node").agg(F.sum("n").alias("n")).withColumn("depth", F.lit(k)), "walks"))
    return reduce(DataFrame.unionByName, parts)


def walks(edges: DataFrame, sources: DataFrame, src: str, dst: str, max_depth: int) -> DataFrame:
    """(source, node, depth, path): all walks of at most ``max_depth`` edges, cycles unrolled."""
    hops = edges.select(F.col(src).alias("node"), F.col(dst).alias("next")).distinct()
    now = sources.select(F.col("node").alias("source"), "node", F.lit(0).alias("depth"), F.col("node").alias("path"))
    out = now
    for k in range(1, max_depth + 1):
        now = now.join(hops, "node").select("source", F.col("next").alias("node"), F.lit(k).alias("depth"), F.concat_ws(" > ", "path", "next").alias("path"))
        out = out.unionByName(now)
    return out


def call_statistics(edges: DataFrame) -> DataFrame:
    """One row: functions with calls, functions called, distinct calls, most calls of one function."""
    pairs = edges.groupBy("caller_usr", "callee_usr").agg(F.count(F.lit(1)).alias("n"))
    out = pairs.groupBy("caller_usr").agg(F.count(F.lit(1)).alias("n_pairs")).agg(F.count(F.lit(1)).alias("functions_with_calls"), F.sum("n_pairs").alias("unique_calls"))
    into = pairs.groupBy("callee_usr").agg(F.sum("n").alias("n_in")).agg(F.count(F.lit(1)).alias("functions_called"), F.max("n_in").alias("most_calls"))
    names = [*out.columns, *into.columns]
    return out.unionByName(into, allowMissingColumns=True).agg(*(F.max(c).alias(c) for c in names))  # two rows become one


# --- inheritance ----------------------------------------------------------

def bare(c: Column) -> Column:
    """The name a base class reference is looked up by."""
    return F.regexp_replace(naming.without_template(c), r"^::|\s+", "")


def inherits(classes: DataFrame) -> DataFrame:
    """(derived_usr, derived, pos, base_raw, base_usr, base): bases as classes of the index, or null."""
    refs = materialize(classes.select(F.col("usr").alias("derived_usr"), F.col("qualified_name").alias("derived"), F.posexplode("bases").alias("pos", "base_raw")).withColumn("key", bare(F.col("base_raw"))), "refs")
    known = classes.groupBy(F.col("qualified_name").alias("key")).agg(F.min("usr").alias("base_usr"))
    return skew_join(refs, known, "key", refs.count()).select("derived_usr", "derived", "pos", "base_raw", "base_usr", F.when(F.col("base_usr").isNotNull(), F.col("key")).alias("base"))


def hierarchy(edges: DataFrame, start: DataFrame, direction: str, max_depth: int | None = None) -> DataFrame:
    """Classes above ('up'), below ('down') or both of ``start`` (node), with depths.

    Both goes up first; down then starts at the given classes alone, and what lies
    above is taken, so siblings through shared bases stay out.
    """
    real = edges.filter("base_usr IS NOT NULL")
    if direction in ("up", "down"):
        a, b = ("derived_usr", "base_usr") if direction == "up" else ("base_usr", "derived_usr")
        return levels(real, start, a, b, max_depth).withColumn("direction", F.lit(direction))
    up = levels(real, start, "derived_usr", "base_usr", max_depth).withColumn("direction", F.lit("up"))
    down = levels(real, start, "base_usr", "derived_usr", max_depth).withColumn("direction", F.lit("down"))
    return up.unionByName(down.join(up.select("node"), "node", "left_anti"))


def hierarchies_of(ancestry: DataFrame, nodes: DataFrame, direction: str) -> DataFrame:
    """(start, node, depth, direction): ``hierarchy`` of every one of ``nodes`` (node), each from itself, out of the closure ``ancestry``."""
    own = nodes.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    up = ancestry.filter(F.col("node") != F.col("above")).select(F.col("node").alias("start"), F.col("above").alias("node"), "depth")
    down = ancestry.filter(F.col("node") != F.col("above")).select(F.col("above").alias("start"), "node", "depth")
    if direction != "both":
        return own.unionByName((up if direction == "up" else down).join(own.select("start"), "start", "left_semi")).withColumn("direction", F.lit(direction))
    # What stands above is taken already: only nodes of a cycle are above and below at once.
    loose = ancestry.filter(F.col("node") == F.col("above")).select(F.col("node").alias("start"))
    twice = down.join(loose, "start", "left_semi").join(up.select("start", "node"), ["start", "node"], "left_anti")
    below = down.join(loose, "start", "left_anti").unionByName(twice)
    return own.unionByName(up.join(own.select("start"), "start", "left_semi")).withColumn("direction", F.lit("up")).unionByName(below.join(own.select("start"), "start", "left_semi").withColumn("direction", F.lit("down")))


def capped(nodes: DataFrame, max_nodes: int) -> tuple[DataFrame, DataFrame]:
    """The first ``max_nodes`` of a hierarchy by (depth, node), and one row that tells whether more remain."""
    top = nodes.orderBy("depth", "node").limit(max_nodes)
    return top, nodes.agg((F.count(F.lit(1)) > max_nodes).alias("truncated"))


def topological_levels(nodes: DataFrame, edges: DataFrame, ancestry: DataFrame | None = None) -> DataFrame:
    """(node, level): bases before derived; nodes on or below cycles get level -1.

    The level is the longest way up. It comes from the closure of the edges (``ancestry``, if it is at hand): each round
    doubles the length of the ways compared, so the rounds grow with the logarithm of the depth.
    """
    pairs = ancestry if ancestry is not None else closure(edges.filter("base_usr IS NOT NULL"), "derived_usr", "base_usr")
    loop = materialize(pairs.filter(F.col("node") == F.col("above")).select("node"), "loops")
    bad = materialize(pairs.join(loop.select(F.col("node").alias("above")), "above", "left_semi").select("node").distinct(), "loops")
    far = materialize(pairs.join(bad, "node", "left_anti").select("node", "above", "depth"), "far")
    before, now = None, _totals(far)
    while now != before:
        up = far.select(F.col("node").alias("above"), F.col("above").alias("top"), F.col("depth").alias("more"))
        longer = far.join(up, "above").select("node", F.col("top").alias("above"), (F.col("depth") + F.col("more")).alias("depth"))
        after = materialize(far.unionByName(longer).groupBy("node", "above").agg(F.max("depth").alias("depth")), "far")
        release(far)
        far, before, now = after, now, _totals(after)
    deep = far.groupBy("node").agg(F.max("depth").alias("level")).unionByName(bad.select("node", F.lit(-1).alias("level")))
    return nodes.select("node").distinct().join(deep, "node", "left").select("node", F.coalesce("level", F.lit(0)).cast("int").alias("level"))


def declarations(nodes: DataFrame, edges: DataFrame, with_meta: bool = False, ancestry: DataFrame | None = None) -> DataFrame:
    """(level, name, line): one C++-like declaration per class, to be read in order of level and name.

    ``nodes`` has node (usr), name, kind, is_project.
    """
    order = topological_levels(nodes, edges, ancestry)
    bases = edges.groupBy(F.col("derived_usr").alias("node")).agg(F.array_sort(F.collect_list(F.struct("pos", "base_raw"))).alias("b"))
    text = F.concat(F.lit("class "), F.col("name"), F.when(F.size("b") > 0, F.concat(F.lit(": "), F.array_join(F.transform("b", lambda x: F.concat(F.lit("public "), x["base_raw"])), ", "))).otherwise(""), F.lit(" {};"))
    if with_meta:
        text = F.concat(text, F.lit("  // kind: "), F.col("kind"), F.lit(", project: "), F.col("is_project").cast("string"))
    return nodes.join(order, "node").join(bases, "node", "left").select("level", "name", text.alias("line"))


def compact_json(nodes: DataFrame) -> DataFrame:
    """Nodes as JSON with short keys; null fields are left out."""
    return nodes.select("node", F.to_json(F.struct(F.col("name").alias("n"), F.col("kind").alias("k"), F.col("is_project").alias("p"))).alias("json"))
