"""Small questions to a report: one function's record, declared against reached permissions, and which engine answers which verb."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The engines that answer each verb. Reports of other backends than the first three are those of the last.
ENGINES = ("JS", "jvm", "Swift", "rust")
VERBS = {
    "gains": ("JS", "jvm", "rust", "Swift"),
    "path": ("JS", "jvm", "rust", "Swift"),
    "tour": ("JS", "jvm", "rust", "Swift"),
    "fix": ("JS", "jvm", "rust", "Swift"),
    "fix-gate": ("JS", "jvm", "rust", "Swift"),
    "unverified": ("JS", "jvm", "rust", "Swift"),
    "gate": ("JS", "jvm", "rust", "Swift"),
    "accepts": ("JS", "jvm", "rust", "Swift"),
    "show": ("JS", "jvm", "rust"),
    "where": ("JS", "jvm", "rust"),
    "callers": ("JS", "jvm", "rust"),
    "map": ("JS", "jvm", "rust"),
    "containment": ("JS", "jvm", "rust"),
    "diff": ("JS", "jvm", "rust"),
    "reachable": ("JS", "jvm", "rust"),
    "impact": ("JS", "jvm", "rust"),
    "blindspots": ("JS", "jvm", "rust"),
    "whatif": ("JS", "jvm", "rust"),
    "parsepolicy": ("JS", "jvm", "rust", "Swift"),
    "rewire": ("jvm", "rust"),
    "agents": ("JS", "rust"),
    "privacy-manifest": ("Swift",),
}


def engine_of(backend: Column) -> Column:
    return F.when(backend.isin(*ENGINES[:3]), backend).otherwise(ENGINES[3])


def capabilities(spark: SparkSession) -> DataFrame:
    """(verb, engine)"""
    return spark.createDataFrame([(v, e) for v, engines in VERBS.items() for e in engines], "verb string, engine string")


def answered(asked: DataFrame) -> DataFrame:
    """asked (.., verb, backend) -> with `answer`: `yes`, `no` where the engine lacks the verb, `unknown verb`."""
    able = F.create_map(*[x for v, engines in VERBS.items() for x in (F.lit(v), F.array(*[F.lit(e) for e in engines]))])[F.col("verb")]
    return asked.withColumn("answer", F.when(able.isNull(), "unknown verb").when(F.array_contains(able, engine_of(F.col("backend"))), "yes").otherwise("no"))


def show(units: DataFrame, names: DataFrame) -> DataFrame:
    """The records of the functions in names (fn), every row of each; a name without a record is a row with nulls, so that it is not taken for a pure function."""
    return names.select("fn").distinct().join(units, "fn", "left")


def permission_keys(reached: DataFrame, keys: DataFrame, declared: DataFrame | None) -> DataFrame:
    """reached (effect, ..), keys (effect, key: null where an effect needs none), declared (key) -> (key, effect, status): `under` where code reaches what is not declared, `over` where a declared key of
    the list is not reached, `ok`, and `no key needed`. declared None: an unreadable manifest, over which nothing can be said."""
    if declared is None:
        raise ValueError("the manifest cannot be read")
    used = reached.select("effect").distinct().withColumn("_reached", F.lit(True))
    said = declared.select("key").distinct().withColumn("_said", F.lit(True))
    rows = keys.join(used, "effect", "left").join(said, "key", "left")
    status = F.when(F.col("key").isNull(), F.when(F.col("_reached"), "no key needed")).when(F.col("_reached") & F.col("_said"), "ok").when(F.col("_reached"), "under").when(F.col("_said"), "over")
    return rows.select("key", "effect", status.alias("status")).filter("status IS NOT NULL")


def verify_code(statuses: DataFrame) -> DataFrame:
    """permission_keys() -> (under, over, code): 1 if anything is declared too little; too much is worth a word, not a failure."""
    n = statuses.agg(F.count_if(F.col("status") == "under").alias("under"), F.count_if(F.col("status") == "over").alias("over"))
    return n.withColumn("code", (F.col("under") > 0).cast("int"))
