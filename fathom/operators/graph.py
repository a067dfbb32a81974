"""Call graphs: reachability, cycles, fixpoints and paths as loops over joins.

edges (src, dst); a node without edges may be listed in `nodes` (fn). Loops are semi-naive: only pairs found last are joined again. A
job takes several hops; what it finds is written to the shared folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Hops that one job takes before its result is written.
HOPS_A_JOB = 4


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local folder serves a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or "file:///tmp/checkpoints").rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """A DataFrame written to the shared folder and read back. It is joined by sorting: packed files look small enough to be broadcast, and a loop would send
    the same rows through the driver once a hop."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/fathom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def nodes_of(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    found = edges.select(F.col("src").alias("fn")).unionByName(edges.select(F.col("dst").alias("fn")))
    return (found if nodes is None else found.unionByName(nodes.select("fn"))).distinct()


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _reached(first: DataFrame, steps: DataFrame, most: int | None = None, budget: int | None = None) -> tuple[DataFrame, bool]:
    """first (k, at, hops), steps (at, to) -> (k, at, hops) of all that is reached with the least number of steps, and whether the
    budget of rows stopped it. Only what the last job found at its last hop goes on; a job takes HOPS_A_JOB hops and compares what it
    found with all that is known in one join."""
    steps = written(steps.select("at", "to").distinct())
    frontier = written(first)
    top = frontier.agg(F.max("hops")).first()[0]
    known, total = [frontier], frontier.count() if budget is not None else 0
    while top is not None and (most is None or top < most):
        hops = min(HOPS_A_JOB, most - top) if most is not None else HOPS_A_JOB
        now, layers = frontier.filter(F.col("hops") == top).select("k", "at"), []
        for i in range(1, hops + 1):
            now = now.join(steps, "at").select("k", F.col("to").alias("at")).distinct()
            layers.append(now.withColumn("hops", F.lit(top + i)))
        found = _union(layers).groupBy("k", "at").agg(F.min("hops").alias("hops"))
        top += hops
        frontier = written(found.join(_union(known).select("k", "at"), ["k", "at"], "left_anti"))
        ends = frontier.agg(F.max("hops").alias("top"), F.count("*").alias("n")).first()
        if not ends["n"]:
            break
        known.append(frontier)
        if len(known) > 8:
            known = [written(_union(known))]
        total += ends["n"]
        if budget is not None and total > budget:
            return _union(known), True
        if ends["top"] < top:
            break
    return _union(known), False


def _spread(first: DataFrame, steps: DataFrame) -> DataFrame:
    """first (at), steps (at, to) -> (at): all that is reached. As it does not matter from where, steps into what is known are dropped after each job, so that later jobs
    read few, and nothing that is found was known."""
    steps = written(steps.select("at", "to").distinct().join(first.select(F.col("at").alias("to")), "to", "left_anti"))
    known, frontier = [first], first
    while True:
        now, layers = frontier, []
        for i in range(1, HOPS_A_JOB + 1):
            now = steps.join(now, "at", "left_semi").select(F.col("to").alias("at")).distinct()
            layers.append(now.withColumn("hop", F.lit(i)))
        found = written(_union(layers).groupBy("at").agg(F.min("hop").alias("hop")))
        last = found.agg(F.max("hop")).first()[0]
        if last is not None:
            known.append(found.select("at"))
        if last is None or last < HOPS_A_JOB:
            return _union(known)
        frontier = found.filter(F.col("hop") == HOPS_A_JOB).select("at")
        steps = written(steps.join(found.select(F.col("at").alias("to")), "to", "left_anti"))


def closure(edges: DataFrame, starts: DataFrame | None = None, rounds: int | None = None, budget: int | None = None) -> tuple[DataFrame, bool]:
    """(src, dst, hops) for every pair joined by at least one step, with the least number of steps, and whether the budget of
    pairs stopped it; without a budget it runs until no pair is new. starts (fn): only from there."""
    first = edges if starts is None else edges.join(starts.select(F.col("fn").alias("src")).distinct(), "src", "left_semi")
    first = first.select(F.col("src").alias("k"), F.col("dst").alias("at")).distinct().withColumn("hops", F.lit(1))
    pairs, cut = _reached(first, edges.select(F.col("src").alias("at"), F.col("dst").alias("to")), rounds, budget)
    return pairs.select(F.col("k").alias("src"), F.col("at").alias("dst"), "hops"), cut


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.hint("merge")


def _fed(steps: DataFrame, most: int | None = None) -> DataFrame:
    """The nodes (fn) that steps (at, to) enter, from nodes that steps enter, and so on for ever: those on or behind a cycle. most: jobs at most; then some more may be left."""
    steps = written(steps)
    fed, before, jobs = written(steps.select(F.col("to").alias("fn")).distinct()), -1, 0
    while (n := fed.count()) not in (0, before) and (most is None or jobs < most):
        before, jobs = n, jobs + 1
        for _ in range(2 * HOPS_A_JOB):
            fed = steps.join(fed.select(F.col("fn").alias("at")), "at", "left_semi").select(F.col("to").alias("fn")).distinct()
        fed = written(fed)
    return fed


def callers(edges: DataFrame, of: DataFrame) -> DataFrame:
    """(fn, caller, hops) of the transitive callers of the functions in `of` (fn)."""
    pairs, _ = closure(reversed_edges(edges), of)
    return pairs.select(F.col("src").alias("fn"), F.col("dst").alias("caller"), "hops")


def propagated(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """facts (fn, fact) carried from callee to caller until nothing is new: the least fixpoint of (fn, fact)."""
    first = written(facts.select(F.col("fact").alias("k"), F.col("fn").alias("at")).distinct().withColumn("hops", F.lit(0)))
    steps = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    kinds = [r["k"] for r in first.select("k").distinct().limit(2).collect()]
    if len(kinds) == 1 and kinds[0] is not None:
        return _spread(first.select("at"), steps).select(F.col("at").alias("fn"), F.lit(kinds[0]).cast(first.schema["k"].dataType).alias("fact"))
    found, _ = _reached(first, steps)
    return found.select(F.col("at").alias("fn"), F.col("k").alias("fact"))


def hops_to(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(fn, hops): least number of calls to a function in targets (fn); 0 for the targets themselves."""
    first = targets.select(F.lit(0).alias("k"), F.col("fn").alias("at")).distinct().withColumn("hops", F.lit(0))
    found, _ = _reached(first, edges.select(F.col("dst").alias("at"), F.col("src").alias("to")))
    return found.select(F.col("at").alias("fn"), "hops")


def next_hops(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(fn, hops, next): a shortest way to a target, by its first step (the least callee among equals); null at the target."""
    far = hops_to(edges, targets)
    down = edges.select("src", "dst").distinct().join(far.select(F.col("fn").alias("dst"), F.col("hops").alias("h")), "dst")
    best = far.join(down, far["fn"] == down["src"]).filter(F.col("h") == F.col("hops") - 1).groupBy("fn").agg(F.min("dst").alias("next"))
    return far.join(best, "fn", "left").select("fn", "hops", "next")


def between(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, dst, hops) for each function of `sources` (fn) and each of `targets` (fn) that it reaches; the walk starts from whichever are fewer."""
    sources, targets = (written(x.select("fn").distinct()) for x in (sources, targets))
    if targets.count() < sources.count():
        pairs, _ = closure(reversed_edges(edges), targets)
        return pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "hops").join(sources.select(F.col("fn").alias("src")), "src", "left_semi").select("src", "dst", "hops")
    pairs, _ = closure(edges, sources)
    return pairs.join(targets.select(F.col("fn").alias("dst")), "dst", "left_semi").select("src", "dst", "hops")


def forbidden(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(src, dst, hops): functions of `sources` that reach one of `targets` though a rule forbids it."""
    return between(edges, sources, targets)


def effects_closure(edges: DataFrame, direct: DataFrame) -> DataFrame:
    """direct (fn, effect) -> (fn, effect) that a function performs itself or through what it calls."""
    return propagated(edges, direct.select("fn", F.col("effect").alias("fact"))).select("fn", F.col("fact").alias("effect"))


def change_depths(edges: DataFrame, direct: DataFrame, gained: DataFrame) -> DataFrame:
    """gained (fn, effect) -> (fn, effect, hops): how many calls below the function the nearest one is that performs the effect itself; 0 is itself, null where none is
    reached."""
    wanted = gained.select("effect").distinct()
    first = direct.join(wanted, "effect", "left_semi").select(F.col("effect").alias("k"), F.col("fn").alias("at")).distinct().withColumn("hops", F.lit(0))
    found, _ = _reached(first, edges.select(F.col("dst").alias("at"), F.col("src").alias("to")))
    return gained.select("fn", "effect").distinct().join(found.select(F.col("k").alias("effect"), F.col("at").alias("fn"), "hops"), ["fn", "effect"], "left")


def greedy_links(edges: DataFrame, out_limit: int = 9, in_limit: int = 7, most: int = 300, chunk: int = 10_000) -> DataFrame:
    """edges (src, dst, weight) in falling weight (then src, dst): an edge is taken while both ends are below their limits and
    fewer than `most` are taken. Acceptance depends on what came before, so the order is read in bounded chunks; ends that are
    full are filtered out before the next chunk is taken."""
    spark, taken = edges.sparkSession, []
    used_out: dict = {}
    used_in: dict = {}
    rest = written(edges.select("src", "dst", "weight"))
    schema, last = rest.schema, None
    while len(taken) < most:
        left = rest
        if last is not None:
            w, s, d = last
            c = F.col
            left = left.filter((c("weight") < w) | ((c("weight") == w) & ((c("src") > s) | ((c("src") == s) & (c("dst") > d)))))
        if full := [k for k, n in used_out.items() if n >= out_limit]:
            left = left.filter(~F.col("src").isin(full))
        if full := [k for k, n in used_in.items() if n >= in_limit]:
            left = left.filter(~F.col("dst").isin(full))
        rows = left.orderBy(F.desc("weight"), "src", "dst").limit(chunk).collect()
        for r in rows:
            if len(taken) < most and used_out.get(r["src"], 0) < out_limit and used_in.get(r["dst"], 0) < in_limit:
                used_out[r["src"]] = used_out.get(r["src"], 0) + 1
                used_in[r["dst"]] = used_in.get(r["dst"], 0) + 1
                taken.append((r["src"], r["dst"], r["weight"]))
        if len(rows) < chunk:
            break
        last = (rows[-1]["weight"], rows[-1]["src"], rows[-1]["dst"])
    return spark.createDataFrame(taken, schema)
