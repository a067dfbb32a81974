"""Audits over two arms: lost Unknowns, root causes of losses, gate flips at bare paths, predictions, coverage, change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import bare_path
from .effects import concrete
from .graph import HOPS_A_JOB, _union, between, closure, written



def _none():
    return F.array().cast("array<string>")


def classify_lost_unknown(lost: DataFrame, pre_edges: DataFrame, post_edges: DataFrame, post_nodes: DataFrame, post_rows: DataFrame) -> DataFrame:
    """lost (fn, tokens: what its POST row carries) -> (fn, class) for functions that lost Unknown.

    R: the row has a concrete effect now. C3: nothing takes the hedge's place (no gained callee, a gained callee that was not
    analysed, or one in their closure with a concrete effect of which the row carries no token). C2: the closure meets a leaf that
    was not analysed, or a row with Unknown or a disclosure. C1: every gained callee is analysed and the closure is clean.
    """
    gained = post_edges.join(lost.select(F.col("fn").alias("src")), "src", "left_semi").join(pre_edges, ["src", "dst"], "left_anti").select(F.col("src").alias("fn"), F.col("dst").alias("callee")).distinct()
    analysed = post_nodes.select(F.col("fn").alias("callee"), F.lit(True).alias("known")).distinct()
    first = gained.join(analysed, "callee", "left").groupBy("fn").agg(F.bool_or(F.col("known").isNull()).alias("dropped"))
    starts = gained.select(F.col("callee").alias("fn")).distinct()
    pairs, _ = closure(post_edges, starts)
    inside = starts.select(F.col("fn").alias("src"), F.col("fn").alias("dst")).unionByName(pairs.select("src", "dst")).distinct()
    meets = gained.join(inside, gained["callee"] == inside["src"]).select("fn", F.col("dst").alias("callee")).distinct()
    seen = meets.join(analysed, "callee", "left").join(post_rows.select(F.col("fn").alias("callee"), F.col("tokens").alias("theirs")), "callee", "left").join(lost, "fn")
    theirs = F.coalesce("theirs", _none())
    loud = (F.size(concrete(theirs)) > 0) & ~F.arrays_overlap(theirs, F.col("tokens"))
    soft = F.size(F.array_except(theirs, concrete(theirs))) > 0
    closed = seen.groupBy("fn").agg(F.bool_or(loud).alias("loud"), F.bool_or(soft | F.col("known").isNull()).alias("open"))
    rows = lost.join(first, "fn", "left").join(closed, "fn", "left")
    kind = (
        F.when(F.size(concrete(F.col("tokens"))) > 0, "R")
        .when(F.col("dropped").isNull() | F.col("dropped") | F.coalesce("loud", F.lit(False)), "C3")
        .when(F.coalesce("open", F.lit(False)), "C2")
        .otherwise("C1")
    )
    return rows.select("fn", kind.alias("class"))


CLASSES = ("C1", "C2", "C3", "R")


def canary(seeds: DataFrame, pre_edges: DataFrame, post_edges: DataFrame, post_nodes: DataFrame, post_rows: DataFrame) -> DataFrame:
    """seeds (fn, tokens, expected) planted in two arms -> (class, seeded, found, sound), one row a class: whether the classifier gives every seed its class. A class without
    seeds is not sound: without all of them a table of classes means nothing."""
    got = classify_lost_unknown(seeds.select("fn", "tokens"), pre_edges, post_edges, post_nodes, post_rows)
    rows = seeds.select("fn", "expected").join(got, "fn", "left").groupBy(F.col("expected").alias("class")).agg(F.count("*").alias("seeded"), F.count_if(F.col("class").eqNullSafe(F.col("expected"))).alias("found"))
    every = seeds.sparkSession.createDataFrame([(c,) for c in CLASSES], "class string")
    out = every.join(rows, "class", "left").select("class", F.coalesce("seeded", F.lit(0)).alias("seeded"), F.coalesce("found", F.lit(0)).alias("found"))
    return out.withColumn("sound", (F.col("seeded") > 0) & (F.col("seeded") == F.col("found")))


def root_causes(lost: DataFrame, pre_edges: DataFrame, head_edges: DataFrame, pre_effects: DataFrame, head_effects: DataFrame, pre_direct: DataFrame, unions: DataFrame | None = None) -> DataFrame:
    """lost (fn, effect) -> (fn, effect, kind, root, callee, path): why an effect of PRE is gone at HEAD.

    OWN: the function performed it itself. Otherwise its PRE callees with the effect are looked at: LOSTEDGE where HEAD has no such
    call, UNPROPAGATED where HEAD has the call and the callee still has the effect; else the loss is the callee's, and the search
    goes on there. A callee is visited once for each lost pair, on the shortest path, the least of several (path: the functions gone through).

    unions (fn): interface unions. One from which the search finds nothing lost the effect with its implementors: UNION, for each function of the same member
    name (all behind the first dot) that had the effect and lost it, and the search goes on there (path: `U:` and its name). The unions furthest down are
    opened first, as what they find explains those above.
    """
    steps = pre_edges.select(F.col("src").alias("at"), F.col("dst").alias("callee")).distinct().join(head_edges.select(F.col("src").alias("at"), F.col("dst").alias("callee"), F.lit(True).alias("edge")).distinct(), ["at", "callee"], "left")
    both = pre_effects.select(F.col("fn").alias("callee"), "effect").distinct().join(head_effects.select(F.col("fn").alias("callee"), "effect", F.lit(True).alias("still")).distinct(), ["callee", "effect"], "left")
    both = written(both)
    kind = F.when(F.col("edge").isNull(), "LOSTEDGE").when(F.col("still"), "UNPROPAGATED")
    steps = written(steps.join(both, "callee").select("at", "callee", "effect", kind.alias("kind")))
    through = written(steps.filter("kind IS NULL").select("at", "effect", "callee"))
    own = pre_direct.select(F.col("fn").alias("at"), "effect").distinct().select("at", "effect", F.lit("OWN").alias("kind"), F.lit(None).cast(dict(steps.dtypes)["callee"]).alias("callee"))
    ends = written(own.unionByName(steps.filter("kind IS NOT NULL").select("at", "effect", "kind", "callee")))
    lost = written(lost.select("fn", "effect").distinct())
    seen = _walked(lost, through)
    opened = []
    if unions is not None and dict(both.dtypes)["callee"] == "string":
        more, opened = _through_unions(lost, seen, through, ends, unions, both.filter("still IS NULL").select(F.col("callee").alias("fn"), "effect"))
        seen = seen + more
    causes = _union(seen).join(ends, ["at", "effect"]).select("fn", "effect", "kind", F.col("at").alias("root"), "callee", "path")
    return _union([causes, *[rows.select("fn", "effect", F.lit("UNION").alias("kind"), F.col("at").alias("root"), F.col("to").alias("callee"), "path") for rows in opened]])


def _walked(starts: DataFrame, through: DataFrame) -> list[DataFrame]:
    """All (fn, effect, at, depth, path) behind the starts (fn, effect), each in the first layer that meets it, on the least path of that layer. A job takes HOPS_A_JOB
    layers: what leads into a place no later than its first layer has its own first layer before, so that places met again change no path."""
    frontier = starts.select("fn", "effect", F.col("fn").alias("at"), F.lit(0).alias("depth"), F.array().cast("array<string>").alias("path"))
    new, known, now, top = [frontier], [frontier], frontier, 0
    while True:
        layers = []
        for i in range(1, HOPS_A_JOB + 1):
            nxt = now.join(through, ["at", "effect"]).select("fn", "effect", F.col("callee").alias("at"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array(F.col("callee").cast("string"))).alias("path"))
            now = nxt.groupBy("fn", "effect", "at").agg(F.min(F.struct("depth", "path")).alias("b")).select("fn", "effect", "at", "b.depth", "b.path")
            layers.append(now.withColumn("layer", F.lit(top + i)))
        top += HOPS_A_JOB
        fresh = _unseen(_union(layers), known)
        last = fresh.agg(F.max("layer")).first()[0]
        if last is None:
            return new
        new.append(fresh.drop("layer"))
        if last < top:
            return new
        known.append(new[-1])
        if len(known) > 8:
            known = [written(_union(known).select("fn", "effect", "at"))]
        now = fresh.filter(F.col("layer") == top).drop("layer")


def _through_unions(lost: DataFrame, seen: list[DataFrame], through: DataFrame, ends: DataFrame, unions: DataFrame, gone: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """seen: what the search met from lost (fn, effect); gone (fn, effect): all that was lost. -> what it meets behind the unions that it opens (fn, effect, at, depth,
    path), and the openings (fn, effect, at, depth, path, to).

    A pair opens only unions behind which there is no end. That, which such union is above which, and the walk behind each implementor are the same for every pair, so they are
    found once; a round then looks up what the openings of the last one lead to. A union above one that the pair has opened has found something.
    """
    key = ["fn", "effect"]
    carriers = written(gone.unionByName(lost).distinct().join(unions.select("fn").distinct(), "fn", "left_semi").withColumn("member", F.when(F.contains("fn", F.lit(".")), F.regexp_extract("fn", r"^[^.]*\.(.*)$", 1))))
    members = written(_members(gone).join(carriers.select("member", "effect").distinct(), ["member", "effect"], "left_semi"))
    wanted = written(carriers.select(*key).unionByName(members.select(F.col("to").alias("fn"), "effect")).distinct())
    others = written(wanted.join(lost, key, "left_anti"))
    walks = _union(seen).join(wanted, key, "left_semi")
    if not others.isEmpty():
        walks = walks.unionByName(_union(_walked(others, through)))
    walks = written(walks)
    barren = carriers.join(walks.join(ends, ["at", "effect"], "left_semi").select(*key).distinct(), key, "left_anti")
    barren = written(barren.select(F.col("fn").alias("at"), "effect", "member"))
    under = walks.join(barren.select(F.col("at").alias("fn"), "effect"), key, "left_semi").join(through, ["at", "effect"]).select(F.col("fn").alias("at"), "effect", F.col("callee").alias("below"))
    under = written(under.join(barren.select(F.col("at").alias("below"), "effect"), ["below", "effect"], "left_semi").distinct())
    nested = not under.isEmpty()

    def above(places: DataFrame) -> DataFrame:
        """(fn, effect, at): the unions above these places of the same pair."""
        return places.select(*key, F.col("at").alias("below")).join(under, ["below", "effect"]).select(*key, "at").distinct()

    waiting = written(_union(seen).join(barren, ["at", "effect"]))
    visited, more, opened = [written(_union(seen).join(waiting.select(*key).distinct(), key, "left_semi").select(*key, "at"))], [], []
    while True:
        known = _union([part.select(*key, F.col("at").alias("to")) for part in visited])
        pairs = waiting.join(members, ["member", "effect"]).filter("to <> at").select(*key, "at", "depth", "path", "to").join(known, [*key, "to"], "left_anti").distinct()
        last = written(pairs)
        if last.isEmpty():
            return more, opened
        if nested:
            pairs = last
            last = pairs.join(above(pairs), [*key, "at"], "left_anti")
            # Unions that call each other are all above one: there the least goes first.
            tied = pairs.join(last.select(*key).distinct(), key, "left_anti")
            last = written(last.unionByName(tied.join(tied.groupBy(*key).agg(F.min("at").alias("at")), [*key, "at"], "left_semi")))
        opened.append(last)
        behind = last.join(walks.select(F.col("fn").alias("to"), "effect", F.col("at").alias("place"), F.col("depth").alias("layer"), F.col("path").alias("way")), ["to", "effect"])
        new = _unseen(behind.select(*key, F.col("place").alias("at"), "layer", (F.col("depth") + 1 + F.col("layer")).alias("depth"), F.concat("path", F.array(F.concat(F.lit("U:"), "to")), "way").alias("path")), visited).drop("layer")
        more.append(new)
        visited.append(new.select(*key, "at"))
        # A pair that opened none is done; of the others' unions those opened, or above one that was, are.
        done = _union([part.select(*key, "at") for part in opened])
        done = done.unionByName(above(done)) if nested else done
        waiting = waiting.unionByName(new.join(barren, ["at", "effect"]).select(waiting.columns)).join(last.select(*key).distinct(), key, "left_semi")
        waiting = written(waiting.join(done.distinct(), [*key, "at"], "left_anti"))


def _unseen(nxt: DataFrame, seen: list[DataFrame]) -> DataFrame:
    """The new (fn, effect, at), each on the least path of its first layer."""
    best = nxt.groupBy("fn", "effect", "at").agg(F.min(F.struct("layer", "depth", "path")).alias("b")).select("fn", "effect", "at", "b.layer", "b.depth", "b.path")
    return written(best.join(_union([s.select("fn", "effect", "at") for s in seen]), ["fn", "effect", "at"], "left_anti"))


def _members(lost: DataFrame) -> DataFrame:
    """lost (fn, effect) -> (to, effect, member): by what is behind each of their dots."""
    parts = F.split("fn", r"\.")
    ends = lost.select(F.col("fn").alias("to"), "effect", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("member"))
    return ends.filter("member <> ''")


def arm_flips(pre: DataFrame, post: DataFrame) -> DataFrame:
    """pre, post (entry, fn, inferred, classes) -> (entry, fn, rule, direction, unknown_kept, member).

    Functions are judged at their bare path, on the union of the rows that share it, so that a split into members is no flip; a
    function absent from an arm has nothing there. Where the same member is in both arms and its own loss does not show at the
    bare path, it is reported as a member.
    """

    def merged(df: DataFrame, key) -> DataFrame:
        rules = F.concat(F.transform("inferred", lambda e: F.concat(F.lit("deny "), e)), F.transform(F.coalesce("classes", _none()), lambda c: F.concat(F.lit("deny Unknown["), c, F.lit("]"))))
        return df.select("entry", key.alias("fn"), F.explode_outer(rules).alias("_rule")).groupBy("entry", "fn").agg(F.collect_set("_rule").alias("rules"))

    def moves(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
        both = a.select("entry", "fn", F.col("rules").alias("p")).join(b.select("entry", "fn", F.col("rules").alias("q")), ["entry", "fn"], how)
        p, q = F.coalesce("p", _none()), F.coalesce("q", _none())
        kept = F.array_contains(p, "deny Unknown") & F.array_contains(q, "deny Unknown")
        side = lambda x, y, name: both.select("entry", "fn", F.explode(F.array_except(x, y)).alias("rule"), F.lit(name).alias("direction"), kept.alias("unknown_kept"))
        return side(p, q, "1->0").unionByName(side(q, p, "0->1"))

    bare = bare_path(F.col("fn"))
    top = moves(merged(pre, bare), merged(post, bare), "full").withColumn("member", F.lit(False))
    named = lambda df: merged(df.filter(bare != F.col("fn")), F.col("fn"))
    members = moves(named(pre), named(post), "inner").filter("direction = '1->0'").withColumn("member", F.lit(True)).withColumn("_b", bare)
    shown = top.filter("direction = '1->0'").select("entry", F.col("fn").alias("_b"), "rule")
    return top.unionByName(members.join(shown, ["entry", "_b", "rule"], "left_anti").drop("_b"))


def predictions(samples: DataFrame) -> DataFrame:
    """samples (category, bare_pre, bare_post, wide_post: exit codes) -> one row: of category 1 those whose bare rule moved 0 -> 1,
    of category 2 those whose bare rule stayed 0 while the rule with Unknown is 1. No sample of category 1 validates nothing."""
    one = F.col("category") == 1
    good1 = one & (F.col("bare_pre") == 0) & (F.col("bare_post") == 1)
    good2 = ~one & (F.col("bare_pre") == 0) & (F.col("bare_post") == 0) & (F.col("wide_post") == 1)
    out = samples.agg(F.count_if(one).alias("category_1"), F.count_if(good1).alias("category_1_ok"), F.count_if(~one).alias("category_2"), F.count_if(good2).alias("category_2_ok"))
    return out.withColumn("status", F.when(F.col("category_1") == 0, "NOTHING VALIDATED").when((F.col("category_1") == F.col("category_1_ok")) & (F.col("category_2") == F.col("category_2_ok")), "OK").otherwise("MISPREDICTED"))


def coverage(roster: DataFrame, manifests: DataFrame, counters: list[str]) -> DataFrame:
    """roster (entry) left joined to manifests (entry, counters..): entries, entries with a manifest, and the sums."""
    rows = roster.select("entry").distinct().join(manifests.withColumn("_m", F.lit(True)), "entry", "left")
    return rows.agg(F.count("*").alias("entries"), F.count_if("_m").alias("with_manifest"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def skip_histogram(manifests: DataFrame, skips: str = "skips") -> DataFrame:
    """manifests (skips: map of reason to count) -> (reason, n)"""
    return manifests.select(F.explode(skips).alias("reason", "n")).groupBy("reason").agg(F.sum("n").alias("n"))


def seeded_sensitivity(base: DataFrame, seeded: DataFrame, marker: str) -> DataFrame:
    """base and seeded (key, text, verdict) -> (key, seeded, base, status): a key's seeded finding must show there only, and its greatest verdict must move."""
    has = lambda df, name: df.groupBy("key").agg(F.coalesce(F.bool_or(F.contains(F.col("text"), F.lit(marker))), F.lit(False)).alias(name), F.max("verdict").alias(f"verdict_{name}"))
    out = has(seeded, "seeded").join(has(base, "base"), "key", "left").withColumn("base", F.coalesce("base", F.lit(False)))
    return out.withColumn("status", F.when(~F.col("seeded"), "NOT SEEN").when(F.col("base"), "SEEN WITHOUT SEED").when(F.col("verdict_base").eqNullSafe(F.col("verdict_seeded")), "VERDICT DID NOT MOVE").otherwise("OK")).select("key", "seeded", "base", "status")


def evidence(compared: DataFrame, changed: DataFrame, reached: DataFrame) -> DataFrame:
    """One row of counts (n each) -> a status: nothing comparable (3), an empty difference without reach is no evidence (4)."""
    n = lambda df, name: df.agg(F.count("*").alias(name))
    out = n(compared, "compared").crossJoin(n(changed, "changed")).crossJoin(n(reached, "reached"))
    return out.withColumn("status", F.when(F.col("compared") == 0, 3).when((F.col("changed") == 0) & (F.col("reached") == 0), 4).otherwise(0))


def probes_read(entries: DataFrame) -> DataFrame:
    """entries (table, declared, read) -> (table, declared, read, status): declared probes of which none was read are a refusal, not a clean table."""
    out = entries.groupBy("table").agg(F.coalesce(F.sum("declared"), F.lit(0)).alias("declared"), F.coalesce(F.sum("read"), F.lit(0)).alias("read"))
    return out.withColumn("status", F.when((F.col("declared") > 0) & (F.col("read") == 0), "REFUSED").otherwise("OK"))


def only_reaches(edges: DataFrame, source: DataFrame, target: DataFrame, permitted: DataFrame) -> DataFrame:
    """`only A -> B C`: (src, dst) for every function outside `permitted` (and outside the target) and each function of the target that it reaches."""
    return between(edges, source.join(permitted, "fn", "left_anti").join(target, "fn", "left_anti"), target).select("src", "dst")


def edge_identical(paths: DataFrame, head_edges: DataFrame) -> DataFrame:
    """paths (id, path: array of functions) -> (id, identical): whether HEAD has every step."""
    n = F.size("path")
    steps = paths.filter(n > 1).select("id", F.posexplode(F.slice("path", F.lit(1), n - 1)).alias("i", "src"), "path").select("id", "src", F.element_at("path", F.col("i") + 2).alias("dst"))
    missing = steps.join(head_edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti").select("id").distinct().withColumn("_gone", F.lit(True))
    return paths.select("id").join(missing, "id", "left").select("id", F.col("_gone").isNull().alias("identical"))


def to_run(now: DataFrame, stamps: DataFrame, at: str) -> DataFrame:
    """now (tree, modified, signature) against the stamps of passed runs (tree, stamped, signature): what must run again and why. A
    stamp in the future and a tree without a name both force a run."""
    rows = now.join(stamps.select("tree", "stamped", F.col("signature").alias("_s")), "tree", "left")
    reason = (
        F.when(F.col("tree").isNull(), "unnamed")
        .when(F.col("stamped").isNull(), "never passed")
        .when(F.col("stamped") > F.lit(at).cast("timestamp"), "future stamp")
        .when(F.col("modified") > F.col("stamped"), "modified")
        .when(~F.col("signature").eqNullSafe(F.col("_s")), "content")
    )
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").select("tree", "reason")


def remaining(wanted: DataFrame, verified: DataFrame, key: list[str]) -> DataFrame:
    """What a resumed fill still has to do."""
    return wanted.join(verified.select(*key).distinct(), key, "left_anti")


def stalled(running: DataFrame, medians: DataFrame, factor: float = 3.0, floor: int = 600) -> DataFrame:
    """running (workflow, elapsed) that take longer than the factor times their median, and than the floor; no median counts as 0."""
    limit = F.greatest(F.coalesce("median", F.lit(0)) * factor, F.lit(floor))
    return running.join(medians.select("workflow", "median"), "workflow", "left").filter(F.col("elapsed") > limit).select("workflow", "elapsed")


def one_plan_per_cause(plans: DataFrame) -> DataFrame:
    """Repair plans with the same effect, layer, site and hoist are one."""
    return plans.dropDuplicates(["effect", "layer", "site", "hoist"])


def foreign_keys(units: DataFrame, own: list[str]) -> DataFrame:
    """Distinct dispatch keys `namespace#member` whose namespace is not one of its own and not generic."""
    keys = units.select(F.explode("dispatches_on").alias("key")).filter(F.contains("key", F.lit("#")))
    space = F.substring_index("key", "#", 1)
    return keys.filter(~space.isin(*own) & ~space.startswith("<")).distinct()


