"""Where an effect that a layer must not have could move, for every root cause at once.

A function violates if it carries an effect that its layer denies. Roots are the violating functions that perform the effect themselves or call a
function that carries it and may. From a root two walks start: down the carrying calls to the functions that perform the effect, and up the callers
with a state: through violating functions (the span), to the first callers that may have the effect (the hoist targets), and on to all
above them. Callers above a target that may not have the effect would inherit it again: then the hoist is not clean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import _reached, effects_closure, written

SPAN, TARGET = 0, 1


def violating(edges: DataFrame, direct: DataFrame, layer: DataFrame, denied: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """direct (fn, effect), layer (fn, layer), denied (layer, effect) -> (carriers (fn, effect), the violating among them, their roots)."""
    effects = denied.select("effect").distinct()
    own = direct.select("fn", "effect").distinct().join(F.broadcast(effects), "effect", "left_semi").select("fn", "effect")  # a row for each denied effect
    carry = written(effects_closure(edges, own))
    bad = written(carry.join(layer.select("fn", "layer"), "fn").join(denied.select("layer", "effect").distinct(), ["layer", "effect"], "left_semi").select("fn", "effect").distinct())
    fine = carry.join(bad, ["fn", "effect"], "left_anti")
    through = edges.join(fine.withColumnRenamed("fn", "dst"), "dst").select(F.col("src").alias("fn"), "effect")
    roots = bad.join(own.unionByName(through).distinct(), ["fn", "effect"], "left_semi")
    return carry, bad, written(roots)


def _marked(calls: DataFrame, bad: DataFrame) -> DataFrame:
    """calls (src, dst, effect) with _src and _dst: true where that end violates, else null."""
    side = lambda end: bad.select(F.col("fn").alias(end), "effect", F.lit(True).alias(f"_{end}"))
    return calls.join(side("src"), ["src", "effect"], "left").join(side("dst"), ["dst", "effect"], "left")


def remedies(edges: DataFrame, direct: DataFrame, layer: DataFrame, denied: DataFrame) -> DataFrame:
    """(effect, root, role, fn), once each. Roles: `site` performs the effect; `span` would be freed of it; `hoist` is a nearest caller that may have it; `higher` a
    caller above those that may have it too; `sandwiched` a caller above those that may not."""
    edges = written(edges.select("src", "dst").distinct())
    carry, bad, roots = violating(edges, direct, layer, denied)
    node = lambda fn, *state: F.struct(F.col("effect").alias("effect"), F.col(fn).alias("fn"), *state)
    calls = written(edges.join(carry.withColumnRenamed("fn", "dst"), "dst").select("src", "dst", "effect"))
    first = roots.select(F.col("fn").alias("k"), node("fn").alias("at"), F.lit(0).alias("hops"))
    below, _ = _reached(first, calls.select(node("src").alias("at"), node("dst").alias("to")))
    site = below.select(F.col("at.effect").alias("effect"), F.col("k").alias("root"), F.col("at.fn").alias("fn")).join(direct.select("fn", "effect").distinct(), ["fn", "effect"], "left_semi")

    state = lambda n: F.lit(n).alias("state")
    inside = _marked(calls, bad).filter("_dst").select(node("dst", state(SPAN)).alias("at"), node("src", F.when(F.col("_src"), SPAN).otherwise(TARGET).alias("state")).alias("to"))
    up, _ = _reached(roots.select(F.col("fn").alias("k"), node("fn", state(SPAN)).alias("at"), F.lit(0).alias("hops")), inside)
    climbed = written(up.select(F.col("at.effect").alias("effect"), F.col("k").alias("root"), F.col("at.fn").alias("fn"), F.col("at.state").alias("state")))
    named = climbed.select("effect", "root", F.when(F.col("state") == SPAN, "span").otherwise("hoist").alias("role"), "fn")
    # All that calls a target carries the effect too, so that above it plain calls are followed.
    targets = climbed.filter(F.col("state") == TARGET).drop("state")
    callers = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"))
    first = targets.join(callers.withColumnRenamed("at", "fn"), "fn").select(F.struct("effect", "root").alias("k"), F.col("to").alias("at"), F.lit(1).alias("hops")).distinct()
    over, _ = _reached(first, callers)
    above = written(over.select("k.effect", "k.root", F.col("at").alias("fn")))
    held = above.join(bad, ["fn", "effect"], "left_semi").select("effect", "root", F.lit("sandwiched").alias("role"), "fn")
    free = above.join(bad, ["fn", "effect"], "left_anti").join(targets, ["effect", "root", "fn"], "left_anti").select("effect", "root", F.lit("higher").alias("role"), "fn")
    return site.select("effect", "root", F.lit("site").alias("role"), "fn").unionByName(named).unionByName(held).unionByName(free)


def remedy_options(plan: DataFrame) -> DataFrame:
    """remedies() -> (effect, root, clean_hoist, options): a clean hoist has a target and nothing sandwiched above it; otherwise a port is offered in its place. To relax the policy is always an
    option."""
    out = plan.groupBy("effect", "root").agg(F.count_if(F.col("role") == "hoist").alias("targets"), F.count_if(F.col("role") == "sandwiched").alias("held"))
    return _offered(out.withColumn("clean_hoist", (F.col("targets") > 0) & (F.col("held") == 0)))


def _offered(roots: DataFrame) -> DataFrame:
    offer = F.when(F.col("clean_hoist"), F.array(F.lit("hoist"), F.lit("relax"))).otherwise(F.array(F.lit("port"), F.lit("relax")))
    return roots.select("effect", "root", "clean_hoist", offer.alias("options"))


def root_options(edges: DataFrame, direct: DataFrame, layer: DataFrame, denied: DataFrame) -> DataFrame:
    """remedy_options() of all roots without their plans. What a plan is asked for is carried down the calls, a row for each function and effect: which functions are below a
    violating one, which violating functions have a target above their span, and which have one that is below a violating function itself."""
    edges = written(edges.select("src", "dst").distinct())
    carry, bad, roots = violating(edges, direct, layer, denied)
    node = lambda fn: F.struct(F.col("effect").alias("effect"), F.col(fn).alias("fn"))
    calls = written(_marked(edges.join(carry.withColumnRenamed("fn", "dst"), "dst").select("src", "dst", "effect"), bad))

    def below(first: DataFrame, steps: DataFrame) -> DataFrame:
        found, _ = _reached(first.select(F.lit(0).alias("k"), "at", F.lit(0).alias("hops")).distinct(), steps.select(node("src").alias("at"), node("dst").alias("to")))
        return written(found.select("at.effect", "at.fn"))

    under = below(calls.filter("_src").select(node("dst").alias("at")), calls)
    span, exits = calls.filter("_src AND _dst"), calls.filter("_src IS NULL AND _dst")
    mark = lambda rows, name: rows.select("effect", F.col("fn").alias("root"), F.lit(True).alias(name))
    hoisted = mark(below(exits.select(node("dst").alias("at")), span), "_h")
    held = mark(below(exits.join(under.withColumnRenamed("fn", "src"), ["src", "effect"], "left_semi").select(node("dst").alias("at")), span), "_s")
    out = roots.select("effect", F.col("fn").alias("root")).join(hoisted, ["effect", "root"], "left").join(held, ["effect", "root"], "left")
    return _offered(out.withColumn("clean_hoist", F.col("_h").isNotNull() & F.col("_s").isNull()))


def inheritors(plan: DataFrame) -> DataFrame:
    """(effect, fn, roots): the violating functions with the number of root causes whose plan frees them; a root has its own."""
    return plan.filter("role = 'span'").groupBy("effect", "fn").agg(F.count("*").alias("roots"))
