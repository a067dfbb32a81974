"""Structure descriptors of a code base: effect mix, smear, tangle, and one figure from all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .effects import PALETTE, UNKNOWN


def palette_name(effect: Column) -> Column:
    return F.when(effect.isin(*PALETTE), effect).otherwise(UNKNOWN)


def effect_mix(units: DataFrame) -> DataFrame:
    """units (inferred) -> incidences and share of each palette effect."""
    rows = units.select(F.explode("inferred").alias("e")).select(palette_name(F.col("e")).alias("effect")).groupBy("effect").agg(F.count("*").alias("n"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("effect", "n", (F.col("n") / F.col("total")).alias("share"))


def primary_effect(inferred: Column) -> Column:
    """The first palette effect that is present, else Unknown if there is any effect, else null."""
    rank = F.array_min(F.transform(inferred, lambda e: F.coalesce(F.array_position(F.array(*[F.lit(x) for x in PALETTE]), e), F.lit(0)).cast("int") + F.when(e.isin(*PALETTE), 0).otherwise(1000)))
    return F.when(rank < 1000, F.element_at(F.array(*[F.lit(x) for x in PALETTE]), F.when(rank < 1000, rank).otherwise(1))).when(F.size(inferred) > 0, UNKNOWN)


def effect_order(units: DataFrame) -> DataFrame:
    """(effect, n, share, place): the palette effects that occur, by falling share, ties in palette order."""
    order = F.array_position(F.array(*[F.lit(x) for x in PALETTE]), F.col("effect"))
    few = effect_mix(units).filter(F.col("effect") != UNKNOWN).withColumn("_o", order)  # a row for each palette effect at most
    return few.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "_o")).cast("long")).drop("_o")


def structure(units: DataFrame, nodes: DataFrame, edges: DataFrame, cyclic: DataFrame) -> DataFrame:
    """One row: functions, nodes, edges, density, tangle, complexity, smear, cycle ratio and structure; structure is null where
    there is nothing to judge (no function, no node, no concrete effect)."""
    known = F.filter("inferred", lambda e: palette_name(e) != UNKNOWN)
    u = units.agg(
        F.count("*").alias("fns"),
        F.coalesce(F.sum(F.size("inferred")), F.lit(0)).alias("incidences"),
        F.coalesce(F.sum(F.size(F.filter("inferred", lambda e: palette_name(e) == UNKNOWN))), F.lit(0)).alias("unknown"),
        F.count_if(F.size(known) >= 3).alias("smeared"),
    )
    one = u.crossJoin(nodes.agg(F.count("*").alias("nodes"))).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(cyclic.agg(F.count("*").alias("cyclic")))
    least1 = lambda c: F.greatest(F.col(c), F.lit(1))
    one = one.withColumn("smear", F.col("smeared") / least1("fns")).withColumn("unknown_share", F.col("unknown") / least1("incidences"))
    one = one.withColumn("density", F.least(F.lit(1.0), F.col("incidences") / least1("fns") / 2)).withColumn("tangle", F.least(F.lit(1.0), F.col("edges") / least1("nodes") / 2.6))
    one = one.withColumn("complexity", F.least(F.lit(1.0), F.log2(F.col("fns") + 1) / 7 * 0.6 + F.col("tangle") * 0.4)).withColumn("cycle_ratio", F.col("cyclic") / least1("nodes"))
    excess = F.greatest(F.lit(0.0), F.col("tangle") - 0.4) / 0.6
    raw = 1 - (0.30 * F.col("smear") + 0.26 * F.col("unknown_share") + 0.24 * excess + 0.20 * F.least(F.lit(1.0), 3 * F.col("cycle_ratio")))
    judged = (F.col("fns") > 0) & (F.col("nodes") > 0) & (F.col("incidences") > F.col("unknown"))
    return one.withColumn("structure", F.when(judged, F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))))


def structure_delta(now: DataFrame, before: DataFrame, columns: tuple[str, ...] = ("smear", "unknown_share", "tangle", "cycle_ratio", "structure")) -> DataFrame:
    """Differences of the components, null where either is; zero has no sign."""
    a, b = now.select(*[F.col(c).alias(f"_n_{c}") for c in columns]), before.select(*[F.col(c).alias(f"_b_{c}") for c in columns])
    return a.crossJoin(b).select(*[(F.round(F.col(f"_n_{c}") - F.col(f"_b_{c}"), 3) + F.lit(0.0)).alias(c) for c in columns])


def layer_profile(universe: DataFrame, effects: DataFrame, layer: str) -> DataFrame:
    """universe (fn, layer) left joined to effects (fn, inferred): functions, effects, and whether any is Unknown, by layer. A
    function of the universe without effects is pure, as the universe lists everything that was analysed."""
    rows = universe.join(effects, "fn", "left").withColumn("_e", F.explode_outer("inferred"))
    out = rows.groupBy(layer).agg(F.countDistinct("fn").alias("fns"), F.sort_array(F.collect_set("_e")).alias("effects"))
    return out.withColumn("unknown", F.array_contains("effects", UNKNOWN))
