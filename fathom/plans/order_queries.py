"""Newest runs, medians, prefixes, versions and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordering as W
from ..operators.structure import effect_order
from .registry import query
from .views import NAMED, RUNS, UNITS, named_customers, runs, table, units


@query(
    "w01_ci_verdict",
    f"WITH {RUNS}, s AS (SELECT workflow, ordinal, coalesce(nullif(conclusion, ''), status) AS c, coalesce(created::VARCHAR, '') AS t FROM run), j AS (SELECT *, c IN ('cancelled', 'skipped') AS idle, count(*) FILTER (WHERE c NOT IN ('cancelled', 'skipped')) OVER (PARTITION BY workflow) AS judged FROM s),"
    " l AS (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY ordinal) AS i, first_value(t) OVER (PARTITION BY workflow ORDER BY ordinal) AS top FROM j WHERE judged = 0 OR NOT idle),"
    " v AS (SELECT workflow, coalesce(arg_min(c, i) FILTER (WHERE i > 1 AND t = top AND c NOT IN ('success', 'skipped')), max(c) FILTER (WHERE i = 1)) AS conclusion FROM l GROUP BY 1) SELECT workflow, conclusion, CASE WHEN conclusion IN ('success', 'skipped') THEN 'OK' ELSE 'BAD' END AS verdict FROM v",
)
def w01(spark, sf):
    return W.ci_verdict(runs(spark, sf))


@query("w02_first_per_key", f"WITH {RUNS}, f AS (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY ordinal) AS i FROM run) SELECT workflow, ordinal, conclusion, value FROM f WHERE i = 1")
def w02(spark, sf):
    return W.first_per_key(runs(spark, sf).select("workflow", "ordinal", "conclusion", "value"), ["workflow"], "ordinal")


@query(
    "w03_newest_elsewhere",
    f"WITH {RUNS}, f AS (SELECT *, row_number() OVER (PARTITION BY workflow ORDER BY ordinal) AS i FROM run) SELECT workflow, ordinal, conclusion, CASE WHEN conclusion = 'cancelled' AND workflow % 2 = 0 THEN 'pending' ELSE 'red' END AS state FROM f WHERE i = 1 AND sha IS DISTINCT FROM '7' AND status = 'completed' AND conclusion IS DISTINCT FROM 'success'",
)
def w03(spark, sf):
    return W.newest_elsewhere(runs(spark, sf).withColumn("cancels", F.col("workflow") % 2 == 0), "7").select("workflow", "ordinal", "conclusion", "state")


@query("w06_after_last_user", "SELECT conv_id, turn, role FROM (SELECT *, max(turn) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id) AS b FROM conversations) WHERE turn > b")
def w06(spark, sf):
    c = table(spark, sf, "conversations")
    return W.after_last(c, ["conv_id"], "turn", F.col("role") == "user").select("conv_id", "turn", "role")


@query("w07_keep_last", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 5")
def w07(spark, sf):
    return W.keep_last(table(spark, sf, "events"), ["user_id"], "event_id", 5).select("event_id", "user_id")


@query("a30_lower_median", "SELECT event_type, quantile_disc(value, 0.5) AS median FROM events GROUP BY 1")
def a30(spark, sf):
    return W.lower_median(table(spark, sf, "events"), ["event_type"], "value")


@query("w08_common_prefix", f"WITH {NAMED} SELECT layer, region || '.' || layer || CASE WHEN n = 1 THEN '.' || seg ELSE '' END AS prefix FROM (SELECT layer, replace(region, ' ', '_') AS region, count(DISTINCT split_part(fn, '.', 3)) AS n, min(split_part(fn, '.', 3)) AS seg FROM named GROUP BY ALL)")
def w08(spark, sf):
    return W.common_prefix(named_customers(spark, sf), ["layer"], "fn")


VERSION = "concat_ws('.', CAST(p_size AS STRING), CAST(p_partkey % 10 AS STRING), CAST(p_partkey % 7 AS STRING))"


@query("w09_newest_version", f"SELECT p_brand, arg_max({VERSION}, [p_size, CAST(p_partkey % 10 AS INT), CAST(p_partkey % 7 AS INT)]) AS newest FROM part GROUP BY 1")
def w09(spark, sf):
    return W.newest_version(table(spark, sf, "part").withColumn("v", F.expr(VERSION)), ["p_brand"], "v")


@query("w10_top_n", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, c_mktsegment LIMIT 3")
def w10(spark, sf):
    return W.top_n(table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n")), [F.desc("n"), F.asc("c_mktsegment")], 3)


@query("w14_stride_sample", "SELECT event_id, event_type FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS i FROM events) WHERE i % greatest(1, n // 20) = 0 AND i // greatest(1, n // 20) < 20")
def w14(spark, sf):
    return W.stride_sample(table(spark, sf, "events").select("event_id", "event_type"), ["event_type"], "event_id", 20)


@query("w15_beyond_pin", f"WITH v AS (SELECT p_brand AS engine, arg_max({VERSION}, [p_size, CAST(p_partkey % 10 AS INT), CAST(p_partkey % 7 AS INT)]) AS newest, max([p_size, CAST(p_partkey % 10 AS INT), CAST(p_partkey % 7 AS INT)]) AS k FROM part GROUP BY 1) SELECT engine, CASE WHEN engine = 'Brand#2' THEN '50.9.9' ELSE '49.9.9' END AS pinned, newest FROM v WHERE k > CASE WHEN engine = 'Brand#2' THEN [50, 9, 9] ELSE [49, 9, 9] END")
def w15(spark, sf):
    known = table(spark, sf, "part").select(F.col("p_brand").alias("engine"), F.expr(VERSION).alias("version"))
    pins = spark.createDataFrame([("Brand#2", "50.9.9"), ("*", "49.9.9")], "engine string, pinned string")
    return W.beyond_pin(known, pins)


@query("w11_effect_order", f"WITH {UNITS}, x AS (SELECT unnest(inferred) AS effect FROM unit), n AS (SELECT effect, count(*) AS n FROM x GROUP BY 1), s AS (SELECT *, n / sum(n) OVER () AS share FROM n) SELECT effect, n, round(share, 9)::DOUBLE AS share, row_number() OVER (ORDER BY n DESC, list_position(['Exec', 'Net', 'Db', 'Fs', 'Ipc', 'Env', 'Clock', 'Rand', 'Log', 'Clipboard'], effect)) AS place FROM s WHERE effect <> 'Unknown'")
def w11(spark, sf):
    return effect_order(units(spark, sf)).withColumn("share", F.round("share", 9))
