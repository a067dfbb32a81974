"""Views of the relational tables in the shape of effect reports, for Spark and, as SQL text, for DuckDB.

bags: `lineitem` in two arms by line status; key (return flag, supplier), value quantity.
units: `events` in two arms by half of the month; entry = hour, fn = user, effect from the event type.
edges: `customer`: every customer calls one of about 0.7 times its number, and those in debt one of a quarter of it.
runs: `events`: workflow = user, newest first, whole hours as the time of creation, which gives real ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the views: the effect of each event type.
EFFECT_OF = {"view": "Log", "click": "Clock", "purchase": "Db", "signup": "Net", "error": "Unknown"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bags(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_suppkey", F.col("l_quantity").cast("int").alias("qty"), "l_linenumber", "l_orderkey", "l_linestatus", F.col("l_partkey").alias("part"))
    return rows.filter("l_linestatus = 'F'"), rows.filter("l_linestatus = 'O'")


BAGS = """pre AS (SELECT l_returnflag, l_suppkey, CAST(l_quantity AS INT) AS qty, l_linenumber, l_orderkey, l_partkey AS part FROM lineitem WHERE l_linestatus = 'F'),
post AS (SELECT l_returnflag, l_suppkey, CAST(l_quantity AS INT) AS qty, l_linenumber, l_orderkey, l_partkey AS part FROM lineitem WHERE l_linestatus = 'O')"""


def unit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """(arm, entry, fn, effect, k), one for each event."""
    e = table(spark, sf, "events")
    effect = F.create_map(*[F.lit(x) for kv in EFFECT_OF.items() for x in kv])[F.col("event_type")]
    arm = F.when(F.dayofmonth("ts") <= 15, "pre").otherwise("post")
    return e.select(arm.alias("arm"), F.hour("ts").alias("entry"), F.col("user_id").alias("fn"), effect.alias("effect"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_id", "ts", "value")


def units(spark: SparkSession, sf: str) -> DataFrame:
    """(arm, entry, fn, inferred)"""
    return unit_rows(spark, sf).groupBy("arm", "entry", "fn").agg(F.sort_array(F.collect_set("effect")).alias("inferred"))


def arms(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    u = units(spark, sf)
    return u.filter("arm = 'pre'").drop("arm"), u.filter("arm = 'post'").drop("arm")


_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EFFECT_OF.items())
UNITS = f"""unit_row AS (SELECT CASE WHEN day(ts) <= 15 THEN 'pre' ELSE 'post' END AS arm, CAST(hour(ts) AS INT) AS entry, user_id AS fn,
  CASE event_type {_CASE} END AS effect, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id, ts, value FROM events),
unit AS (SELECT arm, entry, fn, list_sort(list(DISTINCT effect)) AS inferred FROM unit_row GROUP BY ALL),
a AS (SELECT entry, fn, inferred FROM unit WHERE arm = 'pre'), b AS (SELECT entry, fn, inferred FROM unit WHERE arm = 'post')"""


def unit_bag(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Both arms as bags of report rows (entry, fn, hash, inferred, interface_union, invisible, dispatches_on), one for each event."""
    k = F.col("k")
    some = lambda test, name: F.when(test, F.array(name)).otherwise(F.array().cast("array<string>"))
    inferred = F.when(F.col("effect") == "Log", F.array().cast("array<string>")).when(F.col("effect") == "Db", F.array(F.lit("Db"), F.lit("Net"))).otherwise(F.array("effect"))
    rows = unit_rows(spark, sf).select("arm", "entry", "fn", F.expr("cast(k div 50 as int)").alias("hash"), inferred.alias("inferred"), (k >= 95).alias("interface_union"), some(k % 7 == 0, F.concat(F.lit("i"), (k % 3).cast("string"))).alias("invisible"), some(k % 5 == 0, F.concat(F.lit("d"), (k % 2).cast("string"))).alias("dispatches_on"))
    return rows.filter("arm = 'pre'").drop("arm"), rows.filter("arm = 'post'").drop("arm")


UNIT_BAG = """bag AS (SELECT arm, entry, fn, k // 50 AS hash, CASE effect WHEN 'Log' THEN []::VARCHAR[] WHEN 'Db' THEN ['Db', 'Net'] ELSE [effect] END AS inferred, k >= 95 AS iu,
  CASE WHEN k % 7 = 0 THEN ['i' || CAST(k % 3 AS VARCHAR)] ELSE []::VARCHAR[] END AS inv, CASE WHEN k % 5 = 0 THEN ['d' || CAST(k % 2 AS VARCHAR)] ELSE []::VARCHAR[] END AS dis FROM unit_row),
g AS (SELECT *, greatest(p - q, 0) AS gone, greatest(q - p, 0) AS came FROM (SELECT entry, fn, hash, inferred, iu, inv, dis, count(*) FILTER (WHERE arm = 'pre') AS p, count(*) FILTER (WHERE arm = 'post') AS q FROM bag GROUP BY ALL)),
el AS (SELECT entry, fn, hash, f, x, sum(gone) AS gone, sum(came) AS came FROM (SELECT entry, fn, hash, CASE x WHEN 'Unknown' THEN 'u' ELSE 'e' END AS f, x, gone, came FROM (SELECT *, unnest(inferred) AS x FROM g)
  UNION ALL SELECT entry, fn, hash, 'i', unnest(inv), gone, came FROM g UNION ALL SELECT entry, fn, hash, 'k', unnest(dis), gone, came FROM g UNION ALL SELECT entry, fn, hash, 'row', '', gone, came FROM g UNION ALL SELECT entry, fn, hash, 'union', '', gone, came FROM g WHERE iu) GROUP BY ALL)"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    first = c.select(F.col("c_custkey").alias("src"), F.expr("(c_custkey * 7 + c_nationkey) div 10").alias("dst"))
    second = c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("src"), F.expr("c_custkey div 4").alias("dst"))
    return first.unionByName(second).distinct()


EDGES = """edge AS (SELECT c_custkey AS src, (c_custkey * 7 + c_nationkey) // 10 AS dst FROM customer
  UNION SELECT c_custkey, c_custkey // 4 FROM customer WHERE c_acctbal < 0)"""
CLOSURE = EDGES + """,
reach AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON r.dst = e.src)"""


def direct(spark: SparkSession, sf: str) -> DataFrame:
    """(fn, effect): what a customer does itself, by its market segment; furniture does nothing."""
    named = F.create_map(*[F.lit(x) for x in ("AUTOMOBILE", "Net", "BUILDING", "Db", "HOUSEHOLD", "Unknown", "MACHINERY", "Fs")])[F.col("c_mktsegment")]
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("fn"), named.alias("effect")).filter("effect IS NOT NULL AND fn >= 0")


DIRECT = """direct AS (SELECT c_custkey AS fn, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Net' WHEN 'BUILDING' THEN 'Db' WHEN 'HOUSEHOLD' THEN 'Unknown' WHEN 'MACHINERY' THEN 'Fs' END AS effect
  FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'MACHINERY'))"""


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Some runs are still going (no conclusion, or an empty one), some have no time of creation."""
    conclusion = F.create_map(*[F.lit(x) for x in ("view", "success", "click", "success", "purchase", "cancelled", "signup", "skipped", "error", "failure")])[F.col("event_type")]
    going = F.col("event_id") % 11 == 0
    return table(spark, sf, "events").select(
        F.col("user_id").alias("workflow"),
        (-F.col("event_id")).alias("ordinal"),
        F.when(~going, conclusion).when(F.col("event_id") % 2 == 0, "").alias("conclusion"),
        F.when(going, "in_progress").otherwise("completed").alias("status"),
        F.when(F.col("user_id") % 7 != 0, F.date_trunc("hour", "ts")).alias("created"),
        "value",
        F.get_json_object("props", "$.k").alias("sha"),
    )


RUNS = """run AS (SELECT user_id AS workflow, -event_id AS ordinal, CASE WHEN event_id % 11 = 0 THEN CASE WHEN event_id % 2 = 0 THEN '' END WHEN event_type IN ('view', 'click') THEN 'success' WHEN event_type = 'purchase' THEN 'cancelled' WHEN event_type = 'signup' THEN 'skipped' ELSE 'failure' END AS conclusion,
  CASE WHEN event_id % 11 = 0 THEN 'in_progress' ELSE 'completed' END AS status, CASE WHEN user_id % 7 <> 0 THEN date_trunc('hour', ts) END AS created, value, json_extract_string(props, '$.k') AS sha FROM events)"""


def named_customers(spark: SparkSession, sf: str) -> DataFrame:
    """(fn, layer, effect): dotted names region.nation.segment.customer with the customer's direct effect (null: none)."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    c = table(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    d = direct(spark, sf).withColumnRenamed("fn", "c_custkey")
    fn = F.concat_ws(".", F.replace("r_name", F.lit(" "), F.lit("_")), "n_name", "c_mktsegment", F.col("c_custkey").cast("string"))
    return c.join(d, "c_custkey", "left").select(fn.alias("fn"), F.col("n_name").alias("layer"), F.col("r_name").alias("region"), "effect", "c_custkey", "c_acctbal")


NAMED = DIRECT + """,
named AS (SELECT concat_ws('.', replace(r_name, ' ', '_'), n_name, c_mktsegment, CAST(c_custkey AS VARCHAR)) AS fn, n_name AS layer, r_name AS region, effect, c_custkey, c_acctbal
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN direct d ON d.fn = c_custkey)"""
