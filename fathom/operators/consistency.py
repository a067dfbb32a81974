"""Oracles: assertion queries whose rows are findings. Unmeasured, vacuous and clean are different answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .effects import UNKNOWN

#: Entries of a ledger that are broadcast at once.
LEDGER_TURN = 10_000


def self_consistency(units: DataFrame, reports: DataFrame) -> DataFrame:
    """units (entry, fn, direct, inferred, unknown_why, hosts, cmds, paths, tables), reports (entry, analysed) -> (rule, entry, fn)
    of seven rules."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    has = lambda e: F.coalesce(F.array_contains("inferred", e), F.lit(False))
    rules: dict[str, Column] = {
        "hosts_without_net": some("hosts") & ~has("Net"),
        "cmds_without_exec": some("cmds") & ~has("Exec"),
        "paths_without_fs": some("paths") & ~has("Fs"),
        "tables_without_db": some("tables") & ~has("Db"),
        "why_without_unknown": some("unknown_why") & ~has(UNKNOWN),
        "direct_not_inferred": F.size(F.array_except(F.coalesce("direct", F.array().cast("array<string>")), "inferred")) > 0,
    }
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())
    found = units.select(F.explode(broken).alias("rule"), "entry", "fn")
    rows = units.groupBy("entry").agg(F.count("*").alias("n"))
    few = reports.join(rows, "entry").filter(F.col("analysed") < F.col("n")).select(F.lit("fewer_analysed_than_rows").alias("rule"), "entry", F.lit(None).cast(dict(units.dtypes)["fn"]).alias("fn"))
    return found.unionByName(few)


def weakened(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """More information may not make a verdict vanish: keys with effects before and none, or no row, after."""
    rows = before.filter(F.size("inferred") > 0).join(after.select(*key, F.col("inferred").alias("_after")), key, "left")
    return rows.filter(F.coalesce(F.size("_after"), F.lit(0)) <= 0).select(*key, F.when(F.col("_after").isNull(), "absent").otherwise("empty").alias("after"))


def chain_only_adds(alone: DataFrame, chained: DataFrame, key: list[str]) -> DataFrame:
    """One row: keys in both, keys that grew, keys that shrank, and a status that tells vacuous from passed."""
    both = alone.select(*key, F.col("inferred").alias("a")).join(chained.select(*key, F.col("inferred").alias("b")), key)
    out = both.agg(F.count("*").alias("shared"), F.count_if(F.size(F.array_except("b", "a")) > 0).alias("grew"), F.count_if(F.size(F.array_except("a", "b")) > 0).alias("shrank"))
    status = F.when(F.col("shared") == 0, "NOTHING SHARED").when(F.col("shrank") > 0, "SHRANK").when(F.col("grew") == 0, "VACUOUS").otherwise("OK")
    return out.withColumn("status", status)


def incomplete_propagates(edges: DataFrame, incomplete: DataFrame, group: DataFrame) -> DataFrame:
    """edges (src, dst), incomplete (fn), group (fn, grp): of the callers of incomplete functions how many are incomplete too;
    a group without such callers is UNMEASURED."""
    inc = incomplete.select("fn").distinct()
    pairs = edges.join(inc.select(F.col("fn").alias("dst")), "dst", "left_semi").select(F.col("src").alias("fn")).distinct()
    marked = pairs.join(inc.withColumn("_i", F.lit(True)), "fn", "left").join(group, "fn")
    got = marked.groupBy("grp").agg(F.count("*").alias("callers"), F.count_if("_i").alias("propagated"))
    out = group.select("grp").distinct().join(got, "grp", "left").select("grp", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("propagated", F.lit(0)).alias("propagated"))
    return out.withColumn("status", F.when(F.col("callers") == 0, "UNMEASURED").when(F.col("callers") == F.col("propagated"), "OK").otherwise("LOST"))


def disjoint(counts: DataFrame, one: str, other: str, union: str) -> DataFrame:
    """|X| + |U| = |X or U|; a null count is UNMEASURED, a zero for `other` is VACUOUS."""
    status = F.when(F.col(one).isNull() | F.col(other).isNull() | F.col(union).isNull(), "UNMEASURED").when(F.col(one) + F.col(other) != F.col(union), "OVERLAP").when(F.col(other) == 0, "VACUOUS").otherwise("DISJOINT")
    return counts.withColumn("status", status)


def moved_between(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Keys of both arms whose value fell."""
    return a.select(*key, F.col(value).alias("before")).join(b.select(*key, F.col(value).alias("after")), key).filter("after < before")


def reconciles(headline: DataFrame, detail: DataFrame) -> DataFrame:
    """headline (status, keys) against the number of detail rows by status; rows that do not agree."""
    rows = detail.groupBy("status").agg(F.count("*").alias("rows"))
    both = headline.join(rows, "status", "full").select("status", F.coalesce("keys", F.lit(0)).alias("keys"), F.coalesce("rows", F.lit(0)).alias("rows"))
    return both.filter("keys <> rows")


def unique_or_refuse(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The one value of each key; absent for none, refused for more."""
    out = df.groupBy(*key).agg(F.countDistinct(value).alias("n"), F.min(value).alias("_v"))
    return out.select(*key, F.when(F.col("n") == 0, "ABSENT").when(F.col("n") == 1, "VALUE").otherwise("REFUSED").alias("status"), F.when(F.col("n") == 1, F.col("_v")).alias("value"))


def ledger(findings: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings that no ledger entry (part_a, part_b) explains, entries that no finding reproduces); both parts must occur in
    the finding's text. Texts are searched for parts, which no key can do, so the ledger is broadcast, in turns of about LEDGER_TURN
    entries."""
    hit = F.contains(F.col("text"), F.col("part_a")) & F.contains(F.col("text"), F.col("part_b"))
    entries = known.select("part_a", "part_b").distinct()
    turns = entries.count() // LEDGER_TURN + 1
    fresh, used = findings, None
    for turn in range(turns):
        some = F.broadcast(entries.filter(F.pmod(F.xxhash64("part_a", "part_b"), F.lit(turns)) == turn))
        fresh = fresh.join(some, hit, "left_anti")
        found = findings.join(some, hit).select("part_a", "part_b").distinct()
        used = found if used is None else used.unionByName(found)
    return fresh, known.join(used, ["part_a", "part_b"], "left_anti")


def equal_routes(keys: DataFrame, one: DataFrame, other: DataFrame, key: str, value: str) -> DataFrame:
    """Verdicts (key, value) by two routes -> (key, rows, code, equal): a key's rows must be the same bag, by count and by a digest that does not depend on their order, and so its exit
    code; keys without a row are clean on both."""
    digest = lambda df, n: df.groupBy(key).agg(F.count("*").alias(f"n{n}"), F.sum(F.xxhash64(F.col(value)).cast("decimal(38,0)")).alias(f"d{n}"), F.bit_xor(F.xxhash64(F.lit(0), F.col(value))).alias(f"x{n}"))
    out = keys.distinct().join(digest(one, 1), key, "left").join(digest(other, 2), key, "left")
    n = F.coalesce("n1", F.lit(0))
    same = (n == F.coalesce("n2", F.lit(0))) & F.col("d1").eqNullSafe(F.col("d2")) & F.col("x1").eqNullSafe(F.col("x2"))
    return out.select(key, n.alias("rows"), (n > 0).cast("int").alias("code"), same.alias("equal"))
