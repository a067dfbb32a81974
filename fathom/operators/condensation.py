"""Strongly connected components of a call graph, the graph between them, and transitive callers counted over that graph.

No step closes the graph. Chains (nodes with one way in and one way out) are contracted by doubling, so that a ring or a chain of n nodes takes log n
rounds; what no cycle feeds, and what feeds no cycle, is trimmed; the cores that remain are coloured (the greatest node that reaches each node), and
from each colour's greatest node back within the colour is its component. Each round drops the edges between colours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import HOPS_A_JOB, _fed, _reached, _union, nodes_of, written

#: Components and chains of callers up to which they are spelled out, and the size of the sketches beyond (2**LG_SKETCH registers: a standard error of 1.04 / 2**6).
BOUND, LG_SKETCH = 10_000, 12
#: Jobs of trimming before chains are looked for: enough for graphs that are shallow, which most are.
FIRST_TRIM = 6


def chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """edges (src, dst), distinct, without self-loops -> (members (fn, first, steps) of chains, first being the chain's first node and steps the way from it;
    rings (fn, first) of chain nodes only, first being the least of the ring)."""
    one_in = edges.groupBy(F.col("dst").alias("fn")).agg(F.count("*").alias("n"), F.min("src").alias("before")).filter("n = 1")
    one_out = edges.groupBy(F.col("src").alias("fn")).agg(F.count("*").alias("n")).filter("n = 1")
    inner = written(one_in.join(one_out.select("fn"), "fn", "left_semi").select("fn", "before"))
    entered = inner.select(F.col("fn").alias("before"), F.lit(True).alias("inside"))
    # at: as far back as looked; `steps` away; least: of the nodes passed; done: `at` is the first node of its chain.
    state = inner.join(entered, "before", "left").select("fn", F.when(F.col("inside"), F.col("before")).otherwise(F.col("fn")).alias("at"), F.when(F.col("inside"), 1).otherwise(0).cast("long").alias("steps"), F.when(F.col("inside"), F.least("fn", "before")).otherwise(F.col("fn")).alias("least"), F.col("inside").isNull().alias("done"))
    state, looked, total = written(state), 1, inner.count()
    while looked < 2 * total:
        back = state.select(F.col("fn").alias("at"), F.col("at").alias("at2"), F.col("steps").alias("steps2"), F.col("least").alias("least2"), F.col("done").alias("done2"))
        state = written(state.join(back, "at").select("fn", F.col("at2").alias("at"), (F.col("steps") + F.col("steps2")).alias("steps"), F.least("least", "least2").alias("least"), F.col("done2").alias("done")))
        looked *= 2
        if state.filter("NOT done").isEmpty():
            break
    return state.filter("done").select("fn", F.col("at").alias("first"), "steps"), state.filter("NOT done").select("fn", F.col("least").alias("first"))


def contracted(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(first, head, tail): what leads into each chain, and what it leads to."""
    m = members.select("fn", "first")
    heads = edges.join(m.select(F.col("fn").alias("dst"), "first"), "dst").filter("dst = first").select("first", F.col("src").alias("head"))
    out = edges.join(m.select(F.col("fn").alias("src"), "first"), "src").join(m.select(F.col("fn").alias("dst"), F.col("first").alias("_f")), "dst", "left")
    return heads.join(out.filter("_f IS NULL OR _f <> first").select("first", F.col("dst").alias("tail")), "first")


def _core(edges: DataFrame, most: int | None = None) -> DataFrame:
    """Without what no cycle feeds, and what feeds no cycle."""
    for at, to in (("src", "dst"), ("dst", "src")):
        fed = _fed(edges.select(F.col(at).alias("at"), F.col(to).alias("to")), most)
        edges = written(edges.join(fed.select(F.col("fn").alias("src")), "src", "left_semi").join(fed.select(F.col("fn").alias("dst")), "dst", "left_semi").select("src", "dst"))
        if edges.isEmpty():
            break
    return edges


def _coloured(edges: DataFrame) -> DataFrame:
    """(fn, colour): the greatest node that reaches it, itself included."""
    state = written(nodes_of(edges).select("fn", F.col("fn").alias("colour")))
    while True:
        now = state
        for _ in range(HOPS_A_JOB):
            told = now.join(edges, now["fn"] == edges["src"]).select(F.col("dst").alias("fn"), "colour")
            now = now.unionByName(told).groupBy("fn").agg(F.max("colour").alias("colour"))
        now = written(now)
        if now.join(state, ["fn", "colour"], "left_anti").isEmpty():
            return now
        state = now


def strong_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(fn, component) of every node; component is the least node of those that reach each other. Repeated edges count once; an edge from a node to itself
    changes nothing; edges with a null end are left out."""
    edges = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL")
    rest, found, levels = _core(written(edges.filter("src <> dst").distinct()), FIRST_TRIM), [], []
    while not rest.isEmpty():
        members, rings = chains(rest)
        found.append(rings.select("fn", F.col("first").alias("component")))
        links = written(contracted(rest, members))
        levels.append((members, links))
        inner = members.select("fn").unionByName(rings.select("fn"))
        plain = rest.join(inner.select(F.col("fn").alias("src")), "src", "left_anti").join(inner.select(F.col("fn").alias("dst")), "dst", "left_anti").select("src", "dst")
        rest = _core(written(plain.unionByName(links.filter("head <> tail").select(F.col("head").alias("src"), F.col("tail").alias("dst"))).distinct()))
        if rest.isEmpty():
            break
        colour = _coloured(rest)
        side = lambda name: colour.select(F.col("fn").alias(name), F.col("colour").alias(f"_{name}"))
        same = written(rest.join(side("src"), "src").join(side("dst"), "dst").filter("_src = _dst").select("src", "dst"))
        roots = colour.filter("fn = colour").select(F.col("fn").alias("k"), F.col("fn").alias("at"), F.lit(0).alias("hops"))
        back, _ = _reached(roots, same.select(F.col("dst").alias("at"), F.col("src").alias("to")))
        done = written(back.select(F.col("at").alias("fn"), F.col("k").alias("component")))
        found.append(done)
        gone = done.select("fn")
        rest = written(same.join(gone.select(F.col("fn").alias("src")), "src", "left_anti").join(gone.select(F.col("fn").alias("dst")), "dst", "left_anti"))
    known = _union(found) if found else None
    for members, links in reversed(levels):
        # A chain belongs to the component of what is before it if that is also the one of what is behind it.
        label = lambda name: known.select(F.col("fn").alias(name), F.col("component").alias(f"_{name}"))  # noqa: E731, B023
        both = links.join(label("head"), "head", "left").join(label("tail"), "tail", "left")
        same = (F.coalesce("_head", "head") == F.coalesce("_tail", "tail"))
        closed = both.filter(same).select("first", F.coalesce("_head", "head").alias("component"))
        known = written(known.unionByName(members.join(closed, "first").select("fn", "component")))
    every = nodes_of(edges, nodes)
    if known is None:
        return every.select("fn", F.col("fn").alias("component"))
    out = every.join(known, "fn", "left").select("fn", F.coalesce("component", "fn").alias("k"))
    # A component may have been found under any of its nodes: heads keep their own name.
    least = out.groupBy("k").agg(F.min("fn").alias("component"))
    return out.join(least, "k").select("fn", "component")


def cyclic_nodes(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves (fn)."""
    comps = written(strong_components(edges))
    several = comps.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select("component")
    loops = edges.filter("src = dst").select(F.col("src").alias("fn"))
    return comps.join(several, "component", "left_semi").select("fn").unionByName(loops).distinct()


def condensed(edges: DataFrame, comps: DataFrame) -> DataFrame:
    """(src, dst): the edges between different components."""
    side = lambda name: comps.select(F.col("fn").alias(name), F.col("component").alias(f"_{name}"))
    return edges.join(side("src"), "src").join(side("dst"), "dst").filter("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct()


def blast(edges: DataFrame, bound: int | None = None) -> DataFrame:
    """(fn, blast, approximate): distinct transitive callers of every node; a node counts itself only on a cycle.

    Sets of callers are carried over the graph between the components, chains contracted, and spelled out for nodes whose callers are in at most BOUND components and chains. Beyond, they
    are bitmaps, a row for each 32,768 functions, that are merged down the graph: all counts are exact. With a `bound` that takes the place of BOUND, they are sketches instead,
    and the row says approximate.
    """
    edges = written(edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL").distinct())
    comps = written(strong_components(edges))
    dag = written(condensed(edges, comps))
    loops = edges.filter("src = dst").join(comps.withColumnRenamed("fn", "src"), "src").select("component").distinct().withColumn("loop", F.lit(True))
    size = comps.groupBy("component").agg(F.count("*").alias("w")).join(loops, "component", "left").select("component", "w", (F.coalesce("loop", F.lit(False)) | (F.col("w") > 1)).alias("cyclic"))
    members, _ = chains(dag)
    members = written(members)
    links = contracted(dag, members)
    # Nodes of the contracted graph: components outside chains, and chains under the name of their first node.
    inner = members.select("fn")
    outside = dag.join(inner.select(F.col("fn").alias("src")), "src", "left_anti").join(inner.select(F.col("fn").alias("dst")), "dst", "left_anti").select("src", "dst")
    ends = links.select(F.col("head").alias("src"), F.col("first").alias("dst")).unionByName(links.select(F.col("first").alias("src"), F.col("tail").alias("dst")))
    small = written(outside.unionByName(ends).distinct())
    placed = written(size.join(members.withColumnRenamed("fn", "component"), "component", "left").select("component", "w", "cyclic", F.coalesce("first", "component").alias("node"), F.coalesce("steps", F.lit(0)).alias("steps")))
    weight = written(placed.groupBy("node").agg(F.sum("w").alias("w")))
    counts = _callers_of(small, weight, comps.join(placed, "component").select("fn", "node"), bound)
    # Within a chain those before a component add up; a chain is ordered by doubling too, so that no task holds it whole.
    before = _before(placed.filter("component <> node OR steps > 0").select("component", "node", "steps", "w"), placed)
    done = placed.join(counts, "node", "left").join(before, "component", "left")
    total = F.coalesce("n", F.lit(0)) + F.coalesce("before", F.lit(0)) + F.when(F.col("cyclic"), F.col("w")).otherwise(0)
    found = done.select("component", total.alias("blast"), F.coalesce("approximate", F.lit(False)).alias("approximate"))
    return comps.join(found, "component").select("fn", "blast", "approximate")


def _before(inside: DataFrame, placed: DataFrame) -> DataFrame:
    """(component, before): the weight of a chain's components before each of its own, by prefix sums that double their reach."""
    chain = placed.join(inside.select("node").distinct(), "node", "left_semi").select("node", "steps", "component", "w")
    state = written(chain.select("node", "steps", "component", F.lit(0).cast("long").alias("before"), F.col("w").alias("w")))
    longest, reach = state.agg(F.max("steps")).first()[0], 1
    state = written(state.select("node", "steps", "component", "before", F.col("w").alias("span")))
    while longest is not None and reach <= longest:
        back = state.select("node", (F.col("steps") + reach).alias("steps"), F.col("span").alias("more"))
        state = written(state.join(back, ["node", "steps"], "left").select("node", "steps", "component", (F.col("before") + F.coalesce("more", F.lit(0))).alias("before"), (F.col("span") + F.coalesce("more", F.lit(0))).alias("span")))
        reach *= 2
    return state.select("component", "before")


def _callers_of(dag: DataFrame, weight: DataFrame, functions: DataFrame, bound: int | None) -> DataFrame:
    """dag (src, dst) without cycles, weight (node, w), functions (fn, node) -> (node, n, approximate) for the nodes that are called."""
    weighed = weight.select(F.col("node").alias("at"), "w")
    pairs = written(dag.select(F.col("dst").alias("k"), F.col("src").alias("at")))
    known, frontier = [pairs], pairs
    back = dag.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    sums = pairs.select("k", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("rows")).limit(0)
    while True:
        # Nodes with too many callers are followed no further.
        sums = written(frontier.join(weighed, "at").select("k", F.col("w").alias("n"), F.lit(1).cast("long").alias("rows")).unionByName(sums).groupBy("k").agg(F.sum("n").alias("n"), F.sum("rows").alias("rows")))
        many = sums.filter(F.col("rows") > (BOUND if bound is None else bound)).select("k")
        now, layers = frontier.join(many, "k", "left_anti"), []
        for _ in range(HOPS_A_JOB):
            now = now.join(back, "at").select("k", F.col("to").alias("at")).distinct()
            layers.append(now)
        frontier = written(_union(layers).distinct().join(_union(known), ["k", "at"], "left_anti"))
        if frontier.isEmpty():
            break
        known.append(frontier)
        if len(known) > 8:
            known = [written(_union(known))]
    pairs, sums = _union(known), sums.select(F.col("k").alias("node"), "n")
    if many.isEmpty():
        return sums.withColumn("approximate", F.lit(False))
    hot, _ = _reached(many.select(F.lit(0).alias("k"), F.col("k").alias("at"), F.lit(0).alias("hops")), dag.select(F.col("src").alias("at"), F.col("dst").alias("to")))
    hot = written(hot.select(F.col("at").alias("node")))
    exact = sums.join(hot, "node", "left_anti").withColumn("approximate", F.lit(False))
    if bound is None:
        return exact.unionByName(_mapped(dag, functions, pairs, hot).withColumn("approximate", F.lit(False)))
    return exact.unionByName(_sketched(dag, functions, pairs, hot).withColumn("approximate", F.lit(True)))


def _cold_callers(dag: DataFrame, pairs: DataFrame, hot: DataFrame) -> DataFrame:
    """(node, at): what the cold callers of a hot node add: themselves and their callers, which are few."""
    cold_in = dag.join(hot.select(F.col("node").alias("dst")), "dst", "left_semi").join(hot.select(F.col("node").alias("src")), "src", "left_anti")
    return pairs.join(cold_in.select(F.col("src").alias("k"), F.col("dst")), "k").select(F.col("dst").alias("node"), "at").unionByName(cold_in.select(F.col("dst").alias("node"), F.col("src").alias("at"))).distinct()


def _mapped(dag: DataFrame, functions: DataFrame, pairs: DataFrame, hot: DataFrame) -> DataFrame:
    """(node, n) for the hot nodes, which are all that hot nodes reach: bitmaps of what calls them, merged level by level."""
    numbered = functions.orderBy("fn").select("node", F.monotonically_increasing_id().alias("i"))
    own = written(numbered.groupBy("node", F.bitmap_bucket_number("i").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("i")).alias("bits")))
    merged = lambda rows: rows.groupBy("node", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    base = written(merged(_cold_callers(dag, pairs, hot).join(own.withColumnRenamed("node", "at"), "at").select("node", "bucket", "bits")))
    inside = written(dag.join(hot.select(F.col("node").alias("src")), "src", "left_semi").join(hot.select(F.col("node").alias("dst")), "dst", "left_semi"))
    waiting, above, counts, whole = hot, [base], [], None
    while True:
        blocked = inside.join(waiting.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        ready = written(waiting.join(blocked, "node", "left_anti"))
        if ready.isEmpty():
            return _union(counts)
        if whole is not None:
            # What a finished node and its callers are goes to all that it calls, and is kept until these are merged.
            above.append(inside.join(whole.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "bucket", "bits"))
        level = written(merged(_union(above).join(ready, "node", "left_semi")))
        counts.append(level.groupBy("node").agg(F.sum(F.bitmap_count("bits")).alias("n")))
        whole = written(merged(level.unionByName(own.join(ready, "node", "left_semi"))))
        waiting = written(waiting.join(ready, "node", "left_anti"))
        above = [written(merged(_union(above).join(waiting, "node", "left_semi")))]


def _sketched(dag: DataFrame, functions: DataFrame, pairs: DataFrame, hot: DataFrame) -> DataFrame:
    """(node, n) for the hot nodes, which are all that hot nodes reach: sketches of what calls them, merged level by level."""
    own = written(functions.groupBy("node").agg(F.hll_sketch_agg("fn", F.lit(LG_SKETCH)).alias("own")))
    base = written(_cold_callers(dag, pairs, hot).join(own.select(F.col("node").alias("at"), "own"), "at").groupBy("node").agg(F.hll_union_agg("own").alias("sketch")))
    inside = written(dag.join(hot.select(F.col("node").alias("src")), "src", "left_semi").join(hot.select(F.col("node").alias("dst")), "dst", "left_semi"))
    done, levels = None, 0
    while True:
        waiting = hot if done is None else hot.join(done.select("node"), "node", "left_anti")
        blocked = inside.join(waiting.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        ready = waiting.join(blocked, "node", "left_anti")
        parts = base.join(ready, "node", "left_semi")
        if done is not None:
            calls = inside.join(ready.select(F.col("node").alias("dst")), "dst", "left_semi")
            told = calls.join(done.select(F.col("node").alias("src"), "whole"), "src").select(F.col("dst").alias("node"), F.col("whole").alias("sketch"))
            parts = parts.unionByName(told)
        level = parts.groupBy("node").agg(F.hll_union_agg("sketch").alias("sketch")).join(own, "node")
        level = written(level.select("node", "sketch", F.hll_union("sketch", "own").alias("whole")))
        if level.isEmpty():
            break
        done, levels = level if done is None else done.unionByName(level), levels + 1
        if levels % 8 == 0:
            done = written(done)
    return done.select("node", F.hll_sketch_estimate("sketch").alias("n"))
