"""Reductions that depend on an order: newest runs, first rows, medians, prefixes, versions, samples.

Order is data: every operator takes an explicit ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NO_VERDICT = ("cancelled", "skipped")
ACCEPTED = ("success", "skipped")


def ci_verdict(runs: DataFrame) -> DataFrame:
    """runs (workflow, ordinal, conclusion, created[, status]) -> (workflow, conclusion, verdict): the first run by ordinal decides.

    A run without a conclusion, or with an empty one, is judged by its status, so that one still going is no success. Cancelled and skipped runs step aside if a judged
    run remains. A later run of the same time of creation (null is a time of its own) that is not accepted replaces the first. Anything but success or
    skipped is BAD, null included."""
    status = F.col("status") if "status" in runs.columns else F.lit(None).cast("string")
    state = F.coalesce(F.when(F.col("conclusion") != "", F.col("conclusion")), status)
    idle, fine = (F.coalesce(F.col("state").isin(*names), F.lit(False)) for names in (NO_VERDICT, ACCEPTED))
    rows = runs.select("workflow", "ordinal", state.alias("state"), F.coalesce(F.col("created").cast("string"), F.lit("")).alias("created"))
    group = Window.partitionBy("workflow")
    kept = rows.withColumn("_judged", F.bool_or(~idle).over(group)).filter(~F.col("_judged") | ~idle)
    order = group.orderBy("ordinal")
    kept = kept.withColumn("_first", F.first("created").over(order)).withColumn("_rn", F.row_number().over(order))
    tied = kept.filter(F.col("created") == F.col("_first")).groupBy("workflow").agg(F.min(F.struct("_rn", "state")).alias("f"), F.min(F.when((F.col("_rn") > 1) & ~fine, F.struct("_rn", "state"))).alias("w"))
    conclusion = F.when(F.col("w").isNotNull(), F.col("w.state")).otherwise(F.col("f.state"))
    return tied.select("workflow", conclusion.alias("conclusion"), F.when(F.coalesce(conclusion.isin(*ACCEPTED), F.lit(False)), "OK").otherwise("BAD").alias("verdict"))


def first_per_key(df: DataFrame, key: list[str], ordinal: str) -> DataFrame:
    """The first row of each key; one aggregation, no sort."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), ordinal).alias("_r")).select(*key, "_r.*")


def newest_elsewhere(runs: DataFrame, head: str) -> DataFrame:
    """runs (workflow, ordinal, sha, status, conclusion, cancels: whether the workflow cancels runs in progress) -> those of the newest runs of all workflows that are at another
    commit, completed and no success, with their state: a cancelled run is `pending` where a newer push cancels it, else `red` like any other."""
    newest = first_per_key(runs, ["workflow"], "ordinal")
    bad = newest.filter(~F.col("sha").eqNullSafe(F.lit(head)) & (F.col("status") == "completed") & ~F.col("conclusion").eqNullSafe(F.lit("success")))
    pending = F.col("conclusion").eqNullSafe(F.lit("cancelled")) & F.coalesce("cancels", F.lit(False))
    return bad.withColumn("state", F.when(pending, "pending").otherwise("red"))


def after_last(df: DataFrame, session: list[str], ordinal: str, boundary: Column) -> DataFrame:
    """Rows of each session after its last boundary row; sessions without a boundary give none."""
    w = Window.partitionBy(*session)
    return df.withColumn("_b", F.max(F.when(boundary, F.col(ordinal))).over(w)).filter(F.col(ordinal) > F.col("_b")).drop("_b")


def keep_last(df: DataFrame, key: list[str], ordinal: str, n: int) -> DataFrame:
    """The last n rows of each key; of rows with one ordinal, those with the greater values of the other columns."""
    w = Window.partitionBy(*key).orderBy(F.desc(ordinal), F.desc(F.struct(*[c for c in df.columns if c not in key])))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def lower_median(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """The lower median of each key, 0 where there is no value."""
    return df.groupBy(*key).agg(F.coalesce(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})"), F.lit(0)).alias("median"))


def common_prefix(df: DataFrame, key: list[str], name: str, separator: str = ".") -> DataFrame:
    """The longest run of leading segments that the names of a key share before their last one; names without a separator are left
    out. The least and greatest of these paths, compared by segments, differ first where any two do."""
    parts = F.split(F.col(name), f"\\Q{separator}\\E")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)
    rows = df.filter(F.contains(F.col(name), F.lit(separator))).select(*key, parts.alias("_p"))
    ends = rows.groupBy(*key).agg(F.min("_p").alias("a"), F.max("_p").alias("b"))
    same = F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False).cast("int")
    return ends.select(*key, F.array_join(F.slice("a", F.lit(1), F.when(first == 0, F.size("a")).otherwise(first - 1)), separator).alias("prefix"))


def version_key(version: Column) -> Column:
    """Three integers of a dotted version; anything malformed is 0.0.0."""
    ok = version.rlike(r"^\d{1,9}(\.\d{1,9}){0,2}$")
    parts = F.transform(F.split(F.when(ok, version).otherwise("0"), r"\."), lambda x: x.cast("int"))
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(0))
    return F.array(at(1), at(2), at(3))


def newest_version(df: DataFrame, key: list[str], version: str) -> DataFrame:
    return df.groupBy(*key).agg(F.max_by(version, version_key(F.col(version))).alias("newest"))


def update_class(old: Column, new: Column) -> Column:
    a, b = version_key(old), version_key(new)
    return F.when(b == a, "same").when(b < a, "downgrade").when(b[0] > a[0], "major").when(b[1] > a[1], "minor").otherwise("patch")


def beyond_pin(known: DataFrame, pins: DataFrame) -> DataFrame:
    """known (engine, version), pins (engine, pinned): engines whose newest known version is beyond the pin; without a pin the
    family's pin, engine `*`, holds."""
    newest = newest_version(known, ["engine"], "version")
    family = pins.filter("engine = '*'").agg(F.max("pinned").alias("_family"))
    out = newest.join(pins.filter("engine <> '*'"), "engine", "left").crossJoin(F.broadcast(family)).withColumn("pinned", F.coalesce("pinned", "_family"))
    return out.filter(version_key(F.col("newest")) > version_key(F.col("pinned"))).select("engine", "pinned", "newest")


def top_n(df: DataFrame, by: list[Column], n: int) -> DataFrame:
    return df.orderBy(*by).limit(n)


def stride_sample(df: DataFrame, key: list[str], ordinal: str, k: int) -> DataFrame:
    """From each key's rows in order those at 0, s, 2 s, ... with s = max(1, rows div k), the first k."""
    w = Window.partitionBy(*key)
    out = df.withColumn("_n", F.count("*").over(w)).withColumn("_i", F.row_number().over(w.orderBy(ordinal)) - 1)
    step = F.greatest(F.lit(1), F.expr(f"int(_n div {k})"))
    return out.withColumn("_s", step).filter((F.pmod("_i", F.col("_s")) == 0) & (F.expr("_i div _s") < k)).drop("_n", "_i", "_s")
