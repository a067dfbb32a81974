"""Policies over effects: rules, gates, ratchets, proposals.

A rule row has ordinal, kind (deny, pure, allow, forbid, only), effects, scope, targets, values. Missing evidence is never a pass:
Unknown fails `pure`, and an absent count is unevaluable.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .effects import BOUNDARY, PALETTE, UNKNOWN

RULE_SCHEMA = "ordinal int, kind string, effects array<string>, classes array<string>, scope string, targets array<string>, `values` array<string>"


class Unevaluable(ValueError):
    """A policy that cannot be read as rules: it must not pass as one that nothing violates."""


def _rule(kind: str, rest: list[str]) -> dict:
    row = {"effects": [], "classes": [], "scope": "", "targets": [], "values": []}
    if kind in ("forbid", "only"):
        if "->" not in rest or rest.index("->") in (0, len(rest) - 1):
            raise Unevaluable("no `a -> b`")
        arrow = rest.index("->")
        return row | {"scope": " ".join(rest[:arrow]), "targets": rest[arrow + 1 :]}
    if kind == "pure":
        return row | {"scope": rest[0] if rest else ""}
    if kind == "allow":
        if len(rest) < 3 or rest[1] != "in":
            raise Unevaluable("no `E in scope`")
        return row | {"effects": rest[0].split(","), "scope": rest[2], "values": " ".join(rest[3:]).replace(",", " ").split()}
    if kind == "accept":
        return row | {"scope": " ".join(rest)}
    if kind != "deny":
        raise Unevaluable(f"unknown rule {kind}")
    head, rest = (rest[0] if rest else ""), rest[1:]
    if "[" in head:
        name, _, classes = head.partition("[")
        row |= {"effects": [name], "classes": [c for c in classes.rstrip("]").split(",") if c]}
        if not row["classes"]:
            raise Unevaluable("no class")
    else:
        row["effects"] = [e for e in head.split(",") if e]
        while rest and rest[0] in (*PALETTE, UNKNOWN):
            row["effects"].append(rest.pop(0))
    if not row["effects"] or any(e not in (*PALETTE, UNKNOWN) for e in row["effects"]):
        raise Unevaluable("no effect that could be denied")
    return row | {"scope": rest[0] if rest else ""}


def parse_policy(spark: SparkSession, text: str) -> DataFrame:
    """Lines `deny Net,Db scope` or `deny Net Db scope`, `deny Unknown[class,..] scope`, `pure scope`, `allow Net in scope a,b`, `forbid a -> b`,
    `only a -> b c`, `accept name`. # begins a comment, but inside an accepted name only behind a space. A line that is no rule, and a `deny` that could never fail, raise Unevaluable."""
    rows = []
    for number, line in enumerate(text.splitlines(), 1):
        comment = r"(^|\s)#.*$" if line.split()[:1] == ["accept"] else "#.*$"
        words = re.sub(comment, "", line).split()
        if not words:
            continue
        try:
            row = _rule(words[0], words[1:])
        except Unevaluable as e:
            raise Unevaluable(f"line {number}: {e}") from None
        rows.append((len(rows), words[0], *(row[c] for c in ("effects", "classes", "scope", "targets", "values"))))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def gate(units: DataFrame, text: str) -> int:
    """The exit code of a policy text over units (fn, inferred[, classes]): 2 if it cannot be evaluated."""
    try:
        rules = parse_policy(units.sparkSession, text)
    except Unevaluable:
        return exit_code(None)
    return exit_code(int(not violations(units, rules).isEmpty()))


def in_scope(name: Column, scope: Column, separator: str = ".") -> Column:
    """All segments of the scope but the last are equal, the last is a prefix of the name's; from the start of the name. An empty
    scope holds everything."""
    a, b = F.split(name, f"\\Q{separator}\\E"), F.split(scope, f"\\Q{separator}\\E")
    n = F.size(b)
    head = F.slice(a, F.lit(1), n - 1).eqNullSafe(F.slice(b, F.lit(1), n - 1))
    return (F.coalesce(scope, F.lit("")) == "") | ((F.size(a) >= n) & head & F.coalesce(F.startswith(F.try_element_at(a, n), F.element_at(b, n)), F.lit(False)))


def scoped(units: DataFrame, rules: DataFrame, separator: str = ".") -> DataFrame:
    """units (fn, ..) joined to the rules (scope, ..) whose scope holds them, as in_scope(): by equality of the number of segments and of all
    but the last, of which the scope's begins the name's. Any number of rules; Spark broadcasts them while they are few."""
    segments = lambda c: F.split(c, f"\\Q{separator}\\E")
    b, a = segments(F.coalesce("scope", F.lit(""))), segments(F.col("fn"))
    keyed = rules.withColumn("_n", F.size(b)).withColumn("_head", F.array_join(F.slice(b, F.lit(1), F.size(b) - 1), separator)).withColumn("_last", F.element_at(b, -1))
    probes = units.withColumn("_a", a).withColumn("_n", F.explode(F.sequence(F.lit(1), F.size("_a"))))
    probes = probes.withColumn("_head", F.array_join(F.slice("_a", F.lit(1), F.col("_n") - 1), separator)).withColumn("_next", F.element_at("_a", F.col("_n")))
    return probes.join(keyed, ["_n", "_head"]).filter(F.startswith("_next", "_last")).drop("_a", "_n", "_head", "_next", "_last")


def violations(units: DataFrame, rules: DataFrame) -> DataFrame:
    """units (fn, inferred[, classes]) x deny and pure rules -> (ordinal, kind, fn, effects)."""
    u = units if "classes" in units.columns else units.withColumn("classes", F.array().cast("array<string>"))
    r = rules.filter(F.col("kind").isin("deny", "pure")).select("ordinal", "kind", F.col("effects").alias("_denied"), F.col("classes").alias("_classes"), "scope")
    found = scoped(u, r)
    any_class = F.size("_classes") == 0
    denied = F.array_intersect("inferred", "_denied")
    denied = F.when(any_class | F.arrays_overlap("classes", "_classes"), denied).otherwise(F.array().cast("array<string>"))
    effects = F.when(F.col("kind") == "pure", F.col("inferred")).otherwise(denied)
    return found.withColumn("effects", F.sort_array(effects)).filter("size(effects) > 0").select("ordinal", "kind", "fn", "effects")


def literal_violations(units: DataFrame, effect: str, literals: str, scope: str, allowed: list[str]) -> DataFrame:
    """Functions in scope with the effect whose literals are not all allowed; no literal at all is a violation of its own,
    as nothing vouches for the value."""
    mine = units.filter(in_scope(F.col("fn"), F.lit(scope)) & F.array_contains("inferred", effect))
    over = F.sort_array(F.array_except(F.coalesce(literals, F.array().cast("array<string>")), F.array(*[F.lit(a) for a in allowed])))
    return mine.withColumn("outside", over).filter((F.size("outside") > 0) | (F.coalesce(F.size(literals), F.lit(0)) == 0)).select("fn", "outside")


def accepted(found: DataFrame, accepts: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(violations that no accept line covers, accept lines that cover no violation)."""
    return found.join(accepts, key, "left_anti"), accepts.join(found, key, "left_anti")


def ratchet(current: DataFrame, baseline: DataFrame, known: DataFrame) -> DataFrame:
    """current and baseline (fn, effect), known (fn: all functions of the baseline) -> new (fn, effect) with origin and whether it
    fails: any gained effect of an existing function, any but Unknown of a new one."""
    new = current.join(baseline, ["fn", "effect"], "left_anti").join(known.select("fn", F.lit(True).alias("_k")).distinct(), "fn", "left")
    origin = F.when(F.col("_k"), "existing").otherwise("new")
    return new.select("fn", "effect", origin.alias("origin"), (F.col("_k").isNotNull() | (F.col("effect") != UNKNOWN)).alias("fails"))


def exit_code(violations: int | None, evaluable: bool = True) -> int:
    """0 clean, 1 violations, 2 unevaluable."""
    return 2 if violations is None or not evaluable else int(violations > 0)


def propose(profile: DataFrame, min_fns: int = 1, boundary: tuple[str, ...] = BOUNDARY) -> DataFrame:
    """profile (layer, fns, effects) -> (layer, kind, effects): pure for layers without concrete effects, else deny what they lack of the
    boundary, in its order. Left out: layers with few functions, layers whose name begins another's (a rule would bind that one
    too), and Unknown alone, which cannot be certified pure. All beginnings of a name are equality probes."""
    begins = profile.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("layer") - 1, F.lit(1))), lambda i: F.substring("layer", F.lit(1), i))).alias("_b"), F.col("layer").alias("_l"))
    clash = begins.filter(F.col("_b") != F.col("_l")).select(F.col("_b").alias("layer")).distinct()
    fit = profile.filter(F.col("fns") >= min_fns).join(clash, "layer", "left_anti")
    known = F.filter("effects", lambda e: e != UNKNOWN)
    lacking = F.array_except(F.array(*[F.lit(e) for e in boundary]), known)
    pure = F.size(known) == 0
    out = fit.filter(~(pure & F.array_contains("effects", UNKNOWN))).select("layer", F.when(pure, "pure").otherwise("deny").alias("kind"), F.when(pure, F.array().cast("array<string>")).otherwise(lacking).alias("effects"))
    return out.filter((F.col("kind") == "pure") | (F.size("effects") > 0))


def policy_text(proposal: DataFrame) -> DataFrame:
    return proposal.select(F.when(F.col("kind") == "pure", F.concat(F.lit("pure "), "layer")).otherwise(F.concat(F.lit("deny "), F.array_join("effects", ","), F.lit(" "), "layer")).alias("line"))


def containment(units: DataFrame) -> DataFrame:
    """units (fn, layer, effect) -> (effect, owner, fns, percent): the layer with most functions of an effect, and its share in
    whole percent, cut off."""
    n = units.groupBy("effect", "layer").agg(F.countDistinct("fn").alias("n"))
    out = n.groupBy("effect").agg(F.min_by("layer", F.struct(-F.col("n"), F.col("layer"))).alias("owner"), F.max("n").alias("_top"), F.sum("n").alias("fns"))
    return out.select("effect", "owner", "fns", F.floor(100 * F.col("_top") / F.col("fns")).cast("long").alias("percent"))


def unverified(units: DataFrame, rules: DataFrame) -> DataFrame:
    """Functions in the scope of a deny rule that pass it but carry Unknown."""
    rows = scoped(units, rules.filter("kind = 'deny'").select("ordinal", F.col("effects").alias("_denied"), "scope"))
    return rows.filter(F.array_contains("inferred", UNKNOWN) & (F.size(F.array_intersect("inferred", "_denied")) == 0)).select("ordinal", "fn")


def what_if(edges: DataFrame, fn: DataFrame, effect: str, units: DataFrame, rules: DataFrame) -> DataFrame:
    """Violations that would be new if the functions in fn gained an effect, which all their callers inherit."""
    from .graph import hops_to

    touched = hops_to(edges, fn).select("fn").withColumn("_t", F.lit(True))
    changed = units.join(touched, "fn", "left").withColumn("inferred", F.when(F.col("_t"), F.array_union("inferred", F.array(F.lit(effect)))).otherwise(F.col("inferred")))
    return violations(changed.drop("_t"), rules).join(violations(units, rules), ["ordinal", "kind", "fn", "effects"], "left_anti")


def surface(units: DataFrame) -> DataFrame:
    """Functions with a literal host, path or command."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return units.filter(some("hosts") | some("paths") | some("cmds"))


