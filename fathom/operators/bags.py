"""Bag and set differences between two arms.

Rows keep their multiplicity: a key that occurs five times is five rows. Nulls in keys are ordinary values, as groupBy treats
them. Both arms go through one union and one shuffle by key, whatever the number of results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: What identifies a report row, from the coarsest to the finest.
ROW_KEYS = {"fn": ("entry", "fn"), "pkgfn": ("entry", "package", "fn"), "unit": ("entry", "package", "fn", "hash")}


def row_key(mode: str) -> list[str]:
    """The key columns of a mode; a null hash or package is a value like any other."""
    if mode not in ROW_KEYS:
        raise ValueError(f"no key mode {mode}")
    return list(ROW_KEYS[mode])


def bag_index(df: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """Rows by (key, value)."""
    return df.groupBy(*key, *value).agg(F.count("*").alias("n"))


def both_arms(pre: DataFrame, post: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, n_pre, n_post): how often each combination occurs in either arm."""
    signed = pre.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(post.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    return signed.groupBy(*columns).agg(F.sum("_a").alias("n_pre"), F.sum("_b").alias("n_post"))


def bag_minus(pre: DataFrame, post: DataFrame, columns: list[str]) -> DataFrame:
    """Occurrences in one arm beyond those in the other: gone and came; rows that are even are left out."""
    gone, came = F.greatest(F.col("n_pre") - F.col("n_post"), F.lit(0)), F.greatest(F.col("n_post") - F.col("n_pre"), F.lit(0))
    return both_arms(pre, post, columns).filter("n_pre <> n_post").select(*columns, gone.alias("gone"), came.alias("came"))


def key_diff(pre: DataFrame, post: DataFrame, key: list[str], value: list[str]) -> DataFrame:
    """One row for each key: rows and distinct values in either arm, rows gone and come, and its status."""
    cells = both_arms(pre, post, key + value)
    gone, came = F.greatest(F.col("n_pre") - F.col("n_post"), F.lit(0)), F.greatest(F.col("n_post") - F.col("n_pre"), F.lit(0))
    out = cells.groupBy(*key).agg(
        F.sum("n_pre").alias("rows_pre"),
        F.sum("n_post").alias("rows_post"),
        F.count_if(F.col("n_pre") > 0).alias("values_pre"),
        F.count_if(F.col("n_post") > 0).alias("values_post"),
        F.sum(gone).alias("gone"),
        F.sum(came).alias("came"),
    )
    status = F.when(F.col("rows_pre") == 0, "added").when(F.col("rows_post") == 0, "removed").when(F.col("gone") + F.col("came") > 0, "changed").otherwise("same")
    return out.withColumn("status", status)


def diff_counters(diff: DataFrame) -> DataFrame:
    """Keys and rows added, removed and changed; a changed key counts the larger of its gone and come rows."""
    of = lambda s, c: F.coalesce(F.sum(F.when(F.col("status") == s, c)), F.lit(0))
    larger = F.greatest("gone", "came")
    return diff.agg(
        F.count_if(F.col("status") == "added").alias("added_keys"),
        of("added", F.col("rows_post")).alias("added_rows"),
        F.count_if(F.col("status") == "removed").alias("removed_keys"),
        of("removed", F.col("rows_pre")).alias("removed_rows"),
        F.count_if(F.col("status") == "changed").alias("changed_keys"),
        of("changed", larger).alias("changed_rows"),
    )


def last_wins(df: DataFrame, key: list[str], value: str, ordinal: list[str]) -> DataFrame:
    """One value for each key, the one with the greatest ordinal: what overwriting would leave."""
    return df.groupBy(*key).agg(F.max_by(value, F.struct(*ordinal)).alias(value))


def calibration(pre: DataFrame, post: DataFrame, modes: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """The same difference under several choices of key and value."""
    out = None
    for name, (key, value) in modes.items():
        row = diff_counters(key_diff(pre, post, key, value)).select(F.lit(name).alias("mode"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def element_losses(pre: DataFrame, post: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """By field: keys and elements lost, where a field is an array taken as a bag of elements. A key that is gone loses all."""

    def elements(df: DataFrame) -> DataFrame:
        parts = [df.select(*key, F.lit(f).alias("field"), F.explode(f).alias("element")) for f in fields]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    lost = bag_minus(elements(pre), elements(post), [*key, "field", "element"]).filter("gone > 0")
    by_key = lost.groupBy(*key, "field").agg(F.sum("gone").alias("gone"))
    return by_key.groupBy("field").agg(F.count("*").alias("keys"), F.sum("gone").alias("elements"))


def merged_sets(df: DataFrame, key: list[str], column: str) -> DataFrame:
    """Rows of one key merged into the sorted union of their arrays."""
    return df.select(*key, F.explode_outer(column).alias("_e")).groupBy(*key).agg(F.sort_array(F.collect_set("_e")).alias(column))


def set_changes(pre: DataFrame, post: DataFrame, key: list[str], column: str) -> DataFrame:
    """For each key with a difference the elements gained and lost; a key absent from an arm has none there."""
    p, q = pre.select(*key, F.col(column).alias("_p")), post.select(*key, F.col(column).alias("_q"))
    both = _null_safe(p, q, key, "full")
    none = F.array().cast(dict(pre.dtypes)[column])
    p, q = F.coalesce("_p", none), F.coalesce("_q", none)
    out = both.select(*key, F.sort_array(F.array_except(q, p)).alias("gained"), F.sort_array(F.array_except(p, q)).alias("lost"))
    return out.filter("size(gained) + size(lost) > 0")


def _null_safe(left: DataFrame, right: DataFrame, key: list[str], how: str) -> DataFrame:
    """Equi-join in which null keys are equal."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in key], *[c for c in right.columns if c not in key])
    on = None
    for k in key:
        one = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = one if on is None else on & one
    joined = left.join(right, on, how)
    there = [F.coalesce(F.col(k), F.col(f"_r_{k}")).alias(k) for k in key]
    return joined.select(*there, *[c for c in joined.columns if c not in key and not c.startswith("_r_")])


def align(pre: DataFrame, post: DataFrame, key: list[str]) -> DataFrame:
    """Keys with the arms that have them: `pre`, `post` or `both`; nulls in keys are equal."""
    there = both_arms(pre, post, key)
    return there.select(*key, F.when(F.col("n_post") == 0, "pre").when(F.col("n_pre") == 0, "post").otherwise("both").alias("side"))


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest) of a bag of rows, whatever their order: to tell that two datasets differ."""
    return df.select(F.xxhash64(*df.columns).alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))
