"""Joins by identity, prefix and state. Ambiguous identities are withheld, never guessed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _unique(units: DataFrame, key: list[str], payload: str) -> DataFrame:
    return units.groupBy(*key).agg(F.count("*").alias("_n"), F.min(payload).alias(payload)).filter("_n = 1").drop("_n")


def identity_ladder(found: DataFrame, units: DataFrame) -> DataFrame:
    """found (id, fn, hash) to units (fn, hash, loc): by (fn, hash) if that is unique, else by hash if unique, else, for rows
    without a hash, by fn if unique; otherwise no location."""
    rows = units.select("fn", "hash", "loc")
    by_pair = _unique(rows.filter("hash IS NOT NULL"), ["fn", "hash"], "loc").withColumnRenamed("loc", "_pair")
    by_hash = _unique(rows.filter("hash IS NOT NULL"), ["hash"], "loc").withColumnRenamed("loc", "_hash_loc")
    by_fn = _unique(rows, ["fn"], "loc").withColumnRenamed("loc", "_fn_loc")
    out = found.join(by_pair, ["fn", "hash"], "left").join(by_hash, "hash", "left").join(by_fn, "fn", "left")
    loc = F.when(F.col("hash").isNotNull(), F.coalesce("_pair", "_hash_loc")).otherwise(F.col("_fn_loc"))
    return out.select("id", "fn", "hash", loc.alias("loc"))


def longest_prefix(names: DataFrame, prefixes: DataFrame, separator: str = ".", default: str = "(default)") -> DataFrame:
    """(name, prefix): the longest declared prefix that the name extends by a separator. Every ancestor of a name is one equality
    probe, so nothing is compared pairwise."""
    parts = F.split("name", f"\\Q{separator}\\E")
    ancestors = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator)))
    probes = names.select("name").distinct().select("name", F.explode_outer(ancestors).alias("prefix"))
    hits = probes.join(prefixes.select("prefix").distinct(), "prefix", "left_semi")
    best = hits.groupBy("name").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return names.select("name").distinct().join(best, "name", "left").select("name", F.coalesce("prefix", F.lit(default)).alias("prefix"))


def related_names(uncovered: DataFrame, libraries: DataFrame, separator: str = ".") -> DataFrame:
    """Uncovered names that equal a library, lie under one, or have one under them."""

    def ancestors(df: DataFrame) -> DataFrame:
        parts = F.split("name", f"\\Q{separator}\\E")
        return df.select("name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))).alias("up"))

    under = ancestors(uncovered.select("name").distinct()).join(libraries.select(F.col("name").alias("up")).distinct(), "up", "left_semi").select("name")
    above = uncovered.select("name").distinct().join(ancestors(libraries.select("name").distinct()).select(F.col("up").alias("name")).distinct(), "name", "left_semi")
    return under.unionByName(above).distinct()


def entries_in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): both, or the arm that has it alone."""
    x, y = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    return x.join(y, key, "full").select(key, F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both").alias("side"))


def gained_pairs(current: DataFrame, baseline: DataFrame) -> DataFrame:
    """(fn, effect) that the baseline does not have; a function absent there had none."""
    return current.select("fn", "effect").distinct().join(baseline.select("fn", "effect"), ["fn", "effect"], "left_anti")


def new_findings(current: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """Lines that the baseline does not have; with an unknown baseline every line is new."""
    return current if baseline is None else current.join(baseline.select("line").distinct(), "line", "left_anti")


def roster_check(roster: DataFrame, measured: DataFrame) -> DataFrame:
    """roster (name, want, sha), measured (name, got, sha) -> (name, status): MISSING, SHA, COLLAPSED (below half of what was
    wanted, or below 20), DRIFT or OK."""
    rows = roster.join(measured.select("name", "got", F.col("sha").alias("_sha")), "name", "left")
    status = F.when(F.col("got").isNull(), "MISSING").when(F.col("_sha") != F.col("sha"), "SHA").when((F.col("got") < F.col("want") / 2) | (F.col("got") < 20), "COLLAPSED").when(F.col("got") != F.col("want"), "DRIFT").otherwise("OK")
    return rows.select("name", status.alias("status"))


def matching_paths(paths: DataFrame, globs: list[str]) -> DataFrame:
    """(path, glob) for every glob that a path matches; the globs are literals of the plan."""
    from ..functions.scalars import glob_pattern

    hits = F.filter(F.array(*[F.when(F.col("path").rlike(glob_pattern(g)), F.lit(g)) for g in globs]), lambda g: g.isNotNull())
    return paths.select("path", F.explode(hits).alias("glob"))


def scope_ladder(gained: DataFrame, lost: DataFrame, baseline: DataFrame) -> DataFrame:
    """gained (entry, qual, effect; new to the function) against baseline (entry, qual, effect): how far a new effect reaches. function:
    qualified names; class: classes with such a function; package and artifact: (scope, effect) pairs new to that scope;
    lost: names."""
    cls = F.regexp_replace("qual", r"\.[^.]*$", "")
    pkg = F.regexp_replace(cls, r"\.[^.]*$", "")
    g = gained.select("entry", "qual", "effect", cls.alias("cls"), pkg.alias("pkg"))
    b = baseline.select("entry", "effect", pkg.alias("pkg"))
    new = lambda cols: g.select(*cols).distinct().join(b.select(*cols).distinct(), cols, "left_anti")
    classes = g.select("entry", "cls").distinct()
    row = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("level"), "n")
    out = row(g.select("entry", "qual").distinct(), "function")
    for df, name in ((classes, "class"), (new(["entry", "pkg", "effect"]), "package"), (new(["entry", "effect"]), "artifact"), (lost.select("entry", "qual").distinct(), "lost")):
        out = out.unionByName(row(df, name))
    return out
