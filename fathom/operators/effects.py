"""Effects of functions: tokens, verdict buckets, flips, prices.

A unit row has `inferred` (an array of effect names). `Unknown` is an effect of its own kind: it is neither clean nor concrete.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"
#: Effect names in palette order; effects outside it count as Unknown.
PALETTE = ("Exec", "Net", "Db", "Fs", "Ipc", "Env", "Clock", "Rand", "Log", "Clipboard")
#: Effects that mark a boundary between layers.
BOUNDARY = ("Db", "Net", "Fs", "Exec", "Ipc", "Clipboard")
#: Newly unknown rows in percent of the analysed ones; below the first a change ships, above the second it does not.
SHIPS_BELOW, DECLINED_ABOVE = 1.5, 2.6


def concrete(effects: Column) -> Column:
    """The effects that are neither Unknown nor marked (a leading ~)."""
    return F.filter(effects, lambda e: (e != UNKNOWN) & ~e.startswith("~"))


def tokens(inferred: Column, incomplete: Column, invisible: Column) -> Column:
    """Effects with the disclosures `~incomplete:x` and `~invisible:x`, as a sorted set."""
    none = F.array().cast("array<string>")
    marked = lambda c, p: F.transform(F.coalesce(c, none), lambda x: F.concat(F.lit(p), x))
    return F.sort_array(F.array_distinct(F.concat(F.coalesce(inferred, none), marked(incomplete, "~incomplete:"), marked(invisible, "~invisible:"))))


def value_effects(df: DataFrame, key: list[str]) -> DataFrame:
    """Over a key's rows: its concrete effects, whether any is Unknown, whether any row is an interface union."""
    rows = df.select(*key, "interface_union", F.explode_outer("inferred").alias("_x"))
    out = rows.groupBy(*key).agg(F.collect_set("_x").alias("_e"), F.bool_or(F.coalesce("interface_union", F.lit(False))).alias("interface_union"))
    return out.select(*key, F.sort_array(concrete(F.col("_e"))).alias("concrete"), F.array_contains("_e", UNKNOWN).alias("has_unknown"), "interface_union")


def gate_tokens(df: DataFrame, key: list[str], touched: DataFrame) -> DataFrame:
    """The union of effects for each touched key; untouched rows leave before the aggregation."""
    mine = df.join(touched.select(*key).distinct(), key, "left_semi")
    return mine.select(*key, F.explode_outer("inferred").alias("_x")).groupBy(*key).agg(F.sort_array(F.collect_set("_x")).alias("tokens"))


ROW_FIELDS = ("inferred", "interface_union", "invisible", "dispatches_on")


def moved_rows(pre: DataFrame, post: DataFrame, key: list[str]) -> DataFrame:
    """(key, ROW_FIELDS, p, q, gone, came): how often each row of either arm, as a bag, occurs, went and came."""
    rows = pre.select(*key, *ROW_FIELDS, F.lit(1).alias("_p")).unionByName(post.select(*key, *ROW_FIELDS, F.lit(0).alias("_p")))
    n = rows.groupBy(*key, *ROW_FIELDS).agg(F.sum("_p").alias("p"), F.sum(1 - F.col("_p")).alias("q"))
    more = lambda x, y: F.greatest(F.col(x) - F.col(y), F.lit(0))
    return n.withColumn("gone", more("p", "q")).withColumn("came", more("q", "p"))


def verdict_buckets(pre: DataFrame, post: DataFrame, key: list[str], qual: list[str]) -> DataFrame:
    """pre, post (key, ROW_FIELDS), bags of rows; qual: the columns of key that name a function -> one row of counts of keys.

    bucket_1 gained a concrete effect, bucket_2 is Unknown now and neither was before nor has anything concrete, bucket_4 is the rest that
    moved and lost nothing. Losses lie on top: of bucket_3 concrete effects, 3u rows with Unknown, 3i `invisible` and 3k
    `dispatches_on` elements, each counted as a bag, so that one copy of a repeated row counts too. A key that would be in 1 or 2
    is dropped_union if an interface union came with it (no gate sees such rows), or, of 1, dropped_red if all it gained was there
    before under the same function."""
    moved = moved_rows(pre, post, key).filter("gone > 0 OR came > 0")
    none = F.array().cast("array<string>")
    listed = lambda kind, c: F.transform(F.coalesce(c, none), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("x")))
    effects = F.coalesce("inferred", none)
    marks = F.filter(F.array(F.struct(F.lit("row").alias("kind"), F.lit("").alias("x")), F.struct(F.when(F.array_contains(effects, UNKNOWN), "unknown").alias("kind"), F.lit("").alias("x")), F.struct(F.when(F.coalesce("interface_union", F.lit(False)), "union").alias("kind"), F.lit("").alias("x"))), lambda m: m["kind"].isNotNull())
    parts = F.concat(marks, listed("effect", F.filter(effects, lambda e: e != UNKNOWN)), listed("invisible", F.col("invisible")), listed("dispatch", F.col("dispatches_on")))
    n = moved.select(*key, "gone", "came", F.explode(parts).alias("m")).groupBy(*key, "m.kind", "m.x").agg(F.sum("gone").alias("g"), F.sum("came").alias("c"))
    kind = F.col("kind")
    lost = lambda k: F.coalesce(F.bool_or(F.when(kind == k, F.col("g") > F.col("c"))), F.lit(False))
    had = lambda k, c: F.coalesce(F.bool_or(F.when(kind == k, F.col(c) > 0)), F.lit(False))
    keys = n.groupBy(*key).agg(
        F.collect_set(F.when((kind == "effect") & (F.col("c") > 0) & (F.col("g") == 0), F.col("x"))).alias("new"),
        (had("effect", "g") | had("effect", "c")).alias("concrete"),
        (had("unknown", "c") & ~had("unknown", "g")).alias("hedged"),
        had("union", "c").alias("union"),
        *[lost(k).alias(f"lost_{b}") for k, b in (("effect", "3"), ("unknown", "3u"), ("invisible", "3i"), ("dispatch", "3k"))],
    )
    red = pre.select(*qual, F.explode("inferred").alias("_e")).filter(F.col("_e") != UNKNOWN).groupBy(*qual).agg(F.collect_set("_e").alias("_red"))
    one = (F.size("new") > 0).alias("one")
    two = (F.col("hedged") & ~F.col("concrete")).alias("two")
    rows = keys.join(red, qual, "left").select("*", one, two, (F.size(F.array_except("new", F.coalesce("_red", none))) == 0).alias("was_red"))
    any_loss = F.col("lost_3") | F.col("lost_3u") | F.col("lost_3i") | F.col("lost_3k")
    return rows.agg(
        F.count_if(F.col("one") & ~F.col("union") & ~F.col("was_red")).alias("bucket_1"),
        F.count_if(F.col("two") & ~F.col("one") & ~F.col("union")).alias("bucket_2"),
        *[F.count_if(F.col(f"lost_{b}")).alias(f"bucket_{b}") for b in ("3", "3u", "3i", "3k")],
        F.count_if(~F.col("one") & ~F.col("two") & ~any_loss).alias("bucket_4"),
        F.count_if((F.col("one") | F.col("two")) & F.col("union")).alias("dropped_union"),
        F.count_if(F.col("one") & ~F.col("union") & F.col("was_red")).alias("dropped_red"),
    )


#: The kinds of gate flips, and how the kinds make directions and regressions.
FLIPS = ("adds_unknown", "removes_unknown", "adds_concrete", "loses_concrete", "adds_incomplete", "loses_incomplete", "adds_invisible", "loses_invisible")
DIRECTIONS = (("adds_unknown", ("adds_unknown",)), ("removes_unknown", ("removes_unknown",)), ("adds_concrete_or_incomplete", ("adds_concrete", "adds_incomplete")), ("adds_invisible", ("adds_invisible",)))
REGRESSIONS = ("loses_concrete", "loses_incomplete", "loses_invisible")


def moved_tokens(pre: DataFrame, post: DataFrame, key: list[str]) -> DataFrame:
    """(key, gain, loss) of the keys whose tokens differ; a key that an arm does not have has none there."""
    none = F.array().cast("array<string>")
    both = pre.select(*key, F.col("tokens").alias("_p")).join(post.select(*key, F.col("tokens").alias("_q")), key, "full")
    p, q = F.coalesce("_p", none), F.coalesce("_q", none)
    return both.select(*key, F.array_except(q, p).alias("gain"), F.array_except(p, q).alias("loss")).filter("size(gain) > 0 OR size(loss) > 0")


def gate_flips(pre: DataFrame, post: DataFrame, key: list[str]) -> DataFrame:
    """pre, post (key, tokens) -> one row: for each of FLIPS the number of keys."""
    some = lambda c, test: F.exists(c, test)
    is_concrete = lambda t: (t != UNKNOWN) & ~t.startswith("~")
    tests = {"unknown": lambda t: t == UNKNOWN, "concrete": is_concrete, "incomplete": lambda t: t.startswith("~incomplete:"), "invisible": lambda t: t.startswith("~invisible:")}
    side = lambda flip: "gain" if flip.startswith("adds") else "loss"
    return moved_tokens(pre, post, key).agg(*[F.count_if(some(side(f), tests[f.partition("_")[2]])).alias(f) for f in FLIPS])


def flips_by_effect(pre: DataFrame, post: DataFrame, key: list[str]) -> DataFrame:
    """(direction, effect, keys): concrete effects that entered or left a key."""
    moved = moved_tokens(pre, post, key)
    each = lambda name, c: moved.select(F.lit(name).alias("direction"), F.explode(concrete(F.col(c))).alias("effect"))
    return each("0->1", "gain").unionByName(each("1->0", "loss")).groupBy("direction", "effect").agg(F.count("*").alias("keys"))


def band(df: DataFrame, new_unknown: str, analysed: str) -> DataFrame:
    """df with counts of FLIPS: adds `percent` and `verdict`. A price is only a verdict where Unknown is added and nothing else
    moves; an absent or zero denominator is UNPRICED, not zero."""
    percent = F.try_divide(F.col(new_unknown) * 100.0, F.col(analysed))
    some = lambda names: F.greatest(*[F.coalesce(F.col(n), F.lit(0)) for n in names], F.lit(0)) > 0
    adds = some(["adds_unknown"])
    others = some([n for d, names in DIRECTIONS if d != "adds_unknown" for n in names]) | some(REGRESSIONS)
    priced = F.when(percent.isNull(), "UNPRICED").when(percent < SHIPS_BELOW, "SHIPS").when(percent > DECLINED_ABOVE, "DECLINED").otherwise("ASK")
    verdict = F.when(adds & ~others, priced).when(adds, "ADDING PART ONLY").when(others, "DOES NOT APPLY").otherwise("NO GATE MOVED")
    return df.withColumn("percent", F.round(percent, 6)).withColumn("verdict", verdict)


def loss_partition(lost: DataFrame) -> DataFrame:
    """lost (inferred, incomplete, invisible of removed rows) -> rows by the most telling thing lost."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    kind = F.when(F.size(concrete(F.col("inferred"))) > 0, "concrete").when(F.array_contains("inferred", UNKNOWN), "unknown_only").when(some("incomplete"), "incomplete_only").when(some("invisible"), "invisible_only").otherwise("nothing")
    return lost.groupBy(kind.alias("kind")).agg(F.count("*").alias("rows"))


def state(effects: Column) -> Column:
    """ABSENT (no row), PURE (measured, no effect), CONCRETE or UNKNOWN."""
    return F.when(effects.isNull(), "ABSENT").when(F.size(effects) == 0, "PURE").when(F.size(concrete(effects)) > 0, "CONCRETE").otherwise("UNKNOWN")


STATES = ("ABSENT", "PURE", "CONCRETE", "UNKNOWN")


def state_matrix(probes: DataFrame, pre: DataFrame, post: DataFrame, key: list[str]) -> DataFrame:
    """For each state in PRE how many probes are in each state in POST."""
    looked = probes.select(*key).join(pre.select(*key, F.col("inferred").alias("_p")), key, "left").join(post.select(*key, F.col("inferred").alias("_q")), key, "left")
    rows = looked.select(state(F.col("_p")).alias("pre"), state(F.col("_q")).alias("post"))
    return rows.groupBy("pre").agg(*[F.count_if(F.col("post") == s).alias(s.lower()) for s in STATES])


def triage(entries: DataFrame) -> DataFrame:
    """entries (entry, rows_pre, rows_post, analysed_pre, analysed_post, error) -> status. No rows and nothing analysed in an
    arm is UNJUDGED; no rows in either arm though both analysed something is ALL-PURE."""
    unjudged = lambda r, a: (F.coalesce(r, F.lit(0)) == 0) & (F.coalesce(a, F.lit(0)) == 0)
    none = (F.coalesce("rows_pre", F.lit(0)) == 0) & (F.coalesce("rows_post", F.lit(0)) == 0)
    status = F.when(F.coalesce("error", F.lit(False)), "ERROR").when(unjudged(F.col("rows_pre"), F.col("analysed_pre")) | unjudged(F.col("rows_post"), F.col("analysed_post")), "UNJUDGED").when(none, "ALL-PURE").otherwise("COMPARED")
    return entries.select("entry", status.alias("status"))


def completeness(df: DataFrame) -> DataFrame:
    """Report rows with one verdict each: refused before incomplete before excluded before out of scope; a report that is not ok
    and has no results is incomplete as well. An exclusion counts unless it was peeked at or judged elsewhere."""
    unread = F.exists(F.coalesce("excluded", F.array().cast("array<struct<class:string,peeked:boolean,judged_elsewhere:boolean>>")), lambda e: ~F.coalesce(e["peeked"], F.lit(False)) & ~F.coalesce(e["judged_elsewhere"], F.lit(False)))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    verdict = (
        F.when(F.coalesce("refused", F.lit(False)), "refused")
        .when(F.coalesce("incomplete", F.lit(False)) | some("unanalyzed") | some("judged_nothing"), "incomplete")
        .when(unread, "excluded")
        .when(some("out_of_scope"), "out_of_scope")
        .when(~F.coalesce("ok", F.lit(True)) & (F.coalesce("results", F.lit(0)) == 0), "incomplete")
        .otherwise("complete")
    )
    return df.withColumn("completeness", verdict)
