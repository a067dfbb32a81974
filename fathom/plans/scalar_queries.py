"""Scalar functions over whole columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ordering as W
from .registry import query
from .views import NAMED, named_customers, table


@query("f02_sha16", "SELECT c_custkey, left(sha256(c_name), 16) AS digest FROM customer")
def f02(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.sha16(F.col("c_name")).alias("digest"))


@query("f03_fnv1a32", "SELECT c_custkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(c_name, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS h FROM customer")
def f03(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.fnv1a32(F.col("c_name")).alias("h"))


@query("f01_canonical_json", "SELECT c_custkey, '{\"acct\":' || CASE WHEN c_acctbal < 0 THEN 'null' ELSE CAST(c_nationkey AS VARCHAR) END || ',\"name\":\"' || c_name || '\"}' AS j FROM customer")
def f01(spark, sf):
    c = table(spark, sf, "customer")
    return c.select("c_custkey", S.canonical_json({"name": F.col("c_name"), "acct": F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey"))}).alias("j"))


@query("f04_parse_location", "SELECT l_orderkey, l_linenumber, l_partkey, 'src/' || l_returnflag || '.rs' AS file, CASE WHEN l_linenumber < 6 THEN CAST(l_quantity AS INT) ELSE -1 END AS line, CASE WHEN l_linenumber < 5 THEN l_linenumber ELSE -1 END AS col, CASE WHEN l_linenumber < 3 THEN CAST(l_quantity AS INT) + 1 ELSE -1 END AS end_line, CASE WHEN l_linenumber < 3 THEN 9 ELSE -1 END AS end_col FROM lineitem")
def f04(spark, sf):
    li = table(spark, sf, "lineitem")
    n, line = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    file = text("src/", F.col("l_returnflag"), ".rs")
    loc = F.when(n < 3, text(file, ":", line, ":", n, F.when(n == 1, ":   ").otherwise(":"), line + 1, ":9")).when(n == 5, text("  ", file, ":", line)).when(n < 5, text(file, ":", line, ":", n)).otherwise(file)
    p = S.parse_location(loc)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", p["file"].alias("file"), *[F.coalesce(p[c], F.lit(-1)).alias(c) for c in ("line", "col", "end_line", "end_col")])


REASONS_OF = [" Ambiguous:same", "callback:cb", "REFLECT:y", "no-tsconfig", "no-body", "closure:x", "task-handoff", "indirect", "dynamicMemberLookup", "indy:1", "missing-config", "no-node_modules", "native:ffi", "dispatch", "macro:unreadable"]
CLASSES_OF = ["dispatch", "indirect", "reflect", "setup", "unresolved", "indirect", "indirect", "unresolved", "reflect", "dispatch", "setup", "setup", "native", "dispatch", "unresolved"]


@query("f07_reason_class", f"SELECT ({CLASSES_OF!r})[p_partkey % {len(REASONS_OF)} + 1] AS class, p_type, count(*) AS n FROM part GROUP BY ALL")
def f07(spark, sf):
    reason = F.element_at(F.array(*[F.lit(r) for r in REASONS_OF]), (F.col("p_partkey") % len(REASONS_OF) + 1).cast("int"))
    p = table(spark, sf, "part").withColumn("r", reason)
    return p.groupBy("p_type", S.reason_class(F.col("r")).alias("class")).agg(F.count("*").alias("n"))


@query("f08_normalised_name", "SELECT p_partkey, lower(replace(p_name || '-' || p_type, '-', '_')) AS name FROM part")
def f08(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.normalised_name(F.concat("p_name", F.lit("-"), "p_type")).alias("name"))


@query("f09_package_of_release", "SELECT p_partkey, lower(p_type) AS name FROM part")
def f09(spark, sf):
    return table(spark, sf, "part").select("p_partkey", S.package_of_release(F.concat(F.lower("p_type"), F.lit("-"), F.col("p_size").cast("string"), F.lit(".0.1"))).alias("name"))


@query("f11_base_name", "SELECT page_id, regexp_extract(regexp_replace(url, '/+$', ''), '([^/]+)$', 1) AS base FROM pages")
def f11(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.base_name(F.col("url")).alias("base"))


@query("f14_layer_of", f"WITH {NAMED} SELECT fn, split_part(fn, '.', 3) AS layer FROM named")
def f14(spark, sf):
    return named_customers(spark, sf).select("fn", S.layer_of(F.col("fn"), 2).alias("layer"))


@query("f15_outer_class", f"WITH {NAMED} SELECT fn, regexp_replace(fn, '\\.[^.]*$', '') AS cls FROM named")
def f15(spark, sf):
    return named_customers(spark, sf).select("fn", S.outer_class(F.col("fn")).alias("cls"))


@query("f16_update_class", "SELECT p_partkey, CASE WHEN p_size = 10 THEN 'minor' WHEN p_size > 10 THEN 'major' ELSE 'downgrade' END AS class FROM part")
def f16(spark, sf):
    new = F.concat(F.col("p_size").cast("string"), F.lit(".5"))
    return table(spark, sf, "part").select("p_partkey", W.update_class(F.lit("10.4.9"), new).alias("class"))


@query("f17_age_bucket", "SELECT event_id, CASE WHEN s < 3600 THEN CAST(s // 60 AS VARCHAR) || 'm' WHEN s < 172800 THEN CAST(s // 3600 AS VARCHAR) || 'h' ELSE CAST(s // 86400 AS VARCHAR) || 'd' END AS age FROM (SELECT event_id, date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) AS s FROM events)")
def f17(spark, sf):
    s = F.unix_timestamp(F.date_trunc("second", "ts")) - F.unix_timestamp(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return table(spark, sf, "events").select("event_id", S.age_bucket(s).alias("age"))


WORDS = ["scan", "where", "callers", "policy", "gate"]


@query(
    "f26_suggestion",
    "WITH w AS (SELECT DISTINCT split_part(p_name, ' ', 1) AS word FROM part UNION SELECT unnest(['scam', 'wher', 'caller', 'polcy', 'gaet', 'goat'])), c AS (SELECT word, choice, i, CASE WHEN abs(length(word) - length(choice)) > 2 THEN 99 ELSE levenshtein(word, choice) END AS d FROM w, (SELECT unnest(['scan', 'where', 'callers', 'policy', 'gate']) AS choice, unnest([0, 1, 2, 3, 4]) AS i))"
    " SELECT word, CASE WHEN min(d) <= 2 THEN arg_min(choice, (d, i)) END AS suggestion FROM c GROUP BY word",
)
def f26(spark, sf):
    words = table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("word")).unionByName(spark.createDataFrame([(w,) for w in ("scam", "wher", "caller", "polcy", "gaet", "goat")], "word string")).distinct()
    return words.select("word", S.suggestion(F.col("word"), WORDS).alias("suggestion"))


@query("f06_bare_path", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'row::(' || p_type || ',T2)' ELSE 'a.B.' || p_type END AS bare FROM part")
def f06(spark, sf):
    size = F.col("p_size").cast("string")
    whole = F.concat(F.lit("a.B."), "p_type", F.lit("(x<(y)>)#"), size)
    segment = F.concat(F.lit("row::("), "p_type", F.lit(",T2)"), F.when(F.col("p_size") > 25, F.concat(F.lit("#"), size)).otherwise(""))
    return table(spark, sf, "part").select("p_partkey", S.bare_path(F.when(F.col("p_partkey") % 3 == 0, segment).otherwise(whole)).alias("bare"))


@query("f22_extracted_codes", "SELECT source, count(*) AS hits, count(DISTINCT m) AS codes FROM (SELECT source, unnest(regexp_extract_all(text, '[0-9]{3,}-[0-9]+')) AS m FROM documents) GROUP BY source")
def f22(spark, sf):
    d = table(spark, sf, "documents").select("source", F.explode(F.regexp_extract_all("text", F.lit("[0-9]{3,}-[0-9]+"), 0)).alias("m"))
    return d.groupBy("source").agg(F.count("*").alias("hits"), F.countDistinct("m").alias("codes"))


@query("f21_base64", "SELECT page_id, base64(encode(coalesce(url, ''))) AS b FROM pages")
def f21(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_replace(F.base64(F.encode(F.coalesce("url", F.lit("")), "UTF-8")), "\r\n", "").alias("b"))
