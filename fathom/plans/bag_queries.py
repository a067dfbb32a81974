"""Bag and set differences (lineitem in two arms)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bags as B
from ..operators import consistency as O
from ..operators import joins as J
from .registry import query
from .views import BAGS, UNITS, arms, bags, table, unit_rows, units

KEY, VALUE = ["l_returnflag", "l_suppkey"], ["qty"]


@query("a01_bag_index", f"WITH {BAGS} SELECT l_returnflag, l_suppkey, qty, count(*) AS n FROM pre GROUP BY ALL")
def a01(spark, sf):
    return B.bag_index(bags(spark, sf)[0], KEY, VALUE)


LAST = "SELECT l_returnflag, l_suppkey, arg_max(qty, (l_orderkey, l_linenumber, part, qty)) AS qty FROM {} GROUP BY ALL"


@query("a02_last_wins", f"WITH {BAGS} {LAST.format('pre')}")
def a02(spark, sf):
    return B.last_wins(bags(spark, sf)[0], KEY, "qty", ["l_orderkey", "l_linenumber", "part", "qty"])


DIFF = """cell AS (SELECT {key}, sum(p)::BIGINT AS np, sum(q)::BIGINT AS nq FROM (SELECT {key}, 1 AS p, 0 AS q FROM {pre} UNION ALL SELECT {key}, 0, 1 FROM {post}) GROUP BY ALL),
diff AS (SELECT {group}, sum(np)::BIGINT AS rows_pre, sum(nq)::BIGINT AS rows_post, count(*) FILTER (WHERE np > 0) AS values_pre, count(*) FILTER (WHERE nq > 0) AS values_post,
  sum(greatest(np - nq, 0))::BIGINT AS gone, sum(greatest(nq - np, 0))::BIGINT AS came FROM cell GROUP BY {group}),
d AS (SELECT *, CASE WHEN rows_pre = 0 THEN 'added' WHEN rows_post = 0 THEN 'removed' WHEN gone + came > 0 THEN 'changed' ELSE 'same' END AS status FROM diff)"""
COUNTERS = """count(*) FILTER (WHERE status = 'added') AS added_keys, coalesce(sum(rows_post) FILTER (WHERE status = 'added'), 0)::BIGINT AS added_rows,
  count(*) FILTER (WHERE status = 'removed') AS removed_keys, coalesce(sum(rows_pre) FILTER (WHERE status = 'removed'), 0)::BIGINT AS removed_rows,
  count(*) FILTER (WHERE status = 'changed') AS changed_keys, coalesce(sum(greatest(gone, came)) FILTER (WHERE status = 'changed'), 0)::BIGINT AS changed_rows FROM d"""


def diff_sql(group: str, key: str, pre: str = "pre", post: str = "post") -> str:
    return DIFF.format(group=group, key=key, pre=pre, post=post)


BY_VALUE = diff_sql("l_returnflag, l_suppkey", "l_returnflag, l_suppkey, qty")


@query("a03_bag_diff", f"WITH {BAGS}, {BY_VALUE} SELECT {COUNTERS}")
def a03(spark, sf):
    return B.diff_counters(B.key_diff(*bags(spark, sf), KEY, VALUE))


@query("a03_bag_diff_by_key", f"WITH {BAGS}, {BY_VALUE} SELECT * FROM d")
def a03_keys(spark, sf):
    return B.key_diff(*bags(spark, sf), KEY, VALUE)


@query("a04_last_wins_diff", f"WITH {BAGS}, lp AS ({LAST.format('pre')}), lq AS ({LAST.format('post')}), {diff_sql('l_returnflag, l_suppkey', 'l_returnflag, l_suppkey, qty', 'lp', 'lq')} SELECT {COUNTERS}")
def a04(spark, sf):
    order = ["l_orderkey", "l_linenumber", "part", "qty"]
    pre, post = (B.last_wins(x, KEY, "qty", order) for x in bags(spark, sf))
    return B.diff_counters(B.key_diff(pre, post, KEY, VALUE))


MODES = {"flag": (["l_returnflag"], ["qty"]), "supplier": (["l_suppkey"], ["qty"]), "both": (KEY, ["qty"]), "line": ([*KEY, "l_linenumber"], ["qty"]), "wide": (KEY, ["qty", "l_linenumber", "part"])}


def _mode_sql(name: str, key: list[str], value: list[str]) -> str:
    return f"SELECT * FROM (WITH {diff_sql(', '.join(key), ', '.join(key + value))} SELECT '{name}' AS mode, {COUNTERS})"


@query("a06_calibration", f"WITH {BAGS} " + " UNION ALL ".join(_mode_sql(n, k, v) for n, (k, v) in MODES.items()))
def a06(spark, sf):
    return B.calibration(*bags(spark, sf), MODES)


@query("a05_corpus_total", f"WITH {BAGS}, {BY_VALUE} SELECT l_returnflag, {COUNTERS} GROUP BY l_returnflag")
def a05(spark, sf):
    d = B.key_diff(*bags(spark, sf), KEY, VALUE)
    of = lambda s, c: F.coalesce(F.sum(F.when(F.col("status") == s, F.col(c))), F.lit(0))
    d = d.withColumn("larger", F.greatest("gone", "came"))
    keys = {s: F.count_if(F.col("status") == s) for s in ("added", "removed", "changed")}
    return d.groupBy("l_returnflag").agg(keys["added"].alias("added_keys"), of("added", "rows_post").alias("added_rows"), keys["removed"].alias("removed_keys"), of("removed", "rows_pre").alias("removed_rows"), keys["changed"].alias("changed_keys"), of("changed", "larger").alias("changed_rows"))


@query("d01_bag_minus", f"WITH {BAGS}, {BY_VALUE} SELECT l_returnflag, l_suppkey, qty, greatest(np - nq, 0)::BIGINT AS gone, greatest(nq - np, 0)::BIGINT AS came FROM cell WHERE np <> nq")
def d01(spark, sf):
    return B.bag_minus(*bags(spark, sf), KEY + VALUE)


@query("j01_align", f"WITH {BAGS}, k AS (SELECT l_suppkey, part, sum(p) AS np, sum(q) AS nq FROM (SELECT l_suppkey, part, 1 AS p, 0 AS q FROM pre UNION ALL SELECT l_suppkey, part, 0, 1 FROM post) GROUP BY ALL) SELECT l_suppkey, part, CASE WHEN nq = 0 THEN 'pre' WHEN np = 0 THEN 'post' ELSE 'both' END AS side FROM k")
def j01(spark, sf):
    return B.align(*bags(spark, sf), ["l_suppkey", "part"])


@query("j02_entries_in_both", f"WITH {BAGS} SELECT coalesce(x.part, y.part) AS part, CASE WHEN y.part IS NULL THEN 'only_a' WHEN x.part IS NULL THEN 'only_b' ELSE 'both' END AS side FROM (SELECT DISTINCT part FROM pre) x FULL JOIN (SELECT DISTINCT part FROM post) y ON x.part = y.part")
def j02(spark, sf):
    return J.entries_in_both(*bags(spark, sf), "part")


ARRAYS = ", a_list AS (SELECT entry, fn, list(effect) AS effects, list(k) AS ks FROM unit_row WHERE arm = 'pre' GROUP BY ALL), b_list AS (SELECT entry, fn, list(effect) AS effects, list(k) AS ks FROM unit_row WHERE arm = 'post' GROUP BY ALL)"


@query(
    "a09_field_losses",
    f"WITH {UNITS}, el AS (SELECT arm, entry, fn, 'effects' AS field, effect AS element FROM unit_row UNION ALL SELECT arm, entry, fn, 'ks', CAST(k AS VARCHAR) FROM unit_row),"
    " c AS (SELECT entry, fn, field, element, count(*) FILTER (WHERE arm = 'pre') - count(*) FILTER (WHERE arm = 'post') AS gone FROM el GROUP BY ALL HAVING gone > 0),"
    " k AS (SELECT entry, fn, field, sum(gone) AS gone FROM c GROUP BY ALL) SELECT field, count(*) AS keys, sum(gone)::BIGINT AS elements FROM k GROUP BY field",
)
def a09(spark, sf):
    rows = unit_rows(spark, sf).groupBy("arm", "entry", "fn").agg(F.collect_list("effect").alias("effects"), F.collect_list(F.col("k").cast("string")).alias("ks"))
    return B.element_losses(rows.filter("arm = 'pre'"), rows.filter("arm = 'post'"), ["entry", "fn"], ["effects", "ks"])


@query("a11_merged_sets", f"WITH {UNITS} SELECT fn, array_to_string(list_sort(list(DISTINCT effect)), ',') AS effects FROM unit_row GROUP BY fn")
def a11(spark, sf):
    return B.merged_sets(units(spark, sf), ["fn"], "inferred").select("fn", F.array_join("inferred", ",").alias("effects"))


@query(
    "d03_set_changes",
    f"WITH {UNITS}, j AS (SELECT coalesce(a.entry, b.entry) AS entry, coalesce(a.fn, b.fn) AS fn, coalesce(a.inferred, []) AS p, coalesce(b.inferred, []) AS q FROM a FULL JOIN b ON a.entry = b.entry AND a.fn = b.fn),"
    " g AS (SELECT entry, fn, array_to_string(list_sort(list_filter(q, lambda x: NOT list_contains(p, x))), ',') AS gained, array_to_string(list_sort(list_filter(p, lambda x: NOT list_contains(q, x))), ',') AS lost FROM j) SELECT * FROM g WHERE gained <> '' OR lost <> ''",
)
def d03(spark, sf):
    out = B.set_changes(*arms(spark, sf), ["entry", "fn"], "inferred")
    return out.select("entry", "fn", F.array_join("gained", ",").alias("gained"), F.array_join("lost", ",").alias("lost"))


@query("d05_common_parts", "SELECT l_partkey AS part FROM lineitem WHERE l_linestatus = 'F' INTERSECT SELECT l_partkey FROM lineitem WHERE l_linestatus = 'O'")
def d05(spark, sf):
    a, b = bags(spark, sf)
    return a.select("part").intersect(b.select("part"))


@query("d09_lines_gone", f"WITH {BAGS} SELECT l_suppkey, part FROM pre EXCEPT SELECT l_suppkey, part FROM post")
def d09(spark, sf):
    a, b = bags(spark, sf)
    return a.select("l_suppkey", "part").subtract(b.select("l_suppkey", "part"))


@query("d07_equal_documents", f"WITH {BAGS}, {BY_VALUE} SELECT count(*) FILTER (WHERE np <> nq) AS differing, (count(*) FILTER (WHERE np <> nq)) = 0 AS equal FROM cell")
def d07(spark, sf):
    n = B.both_arms(*bags(spark, sf), KEY + VALUE)
    return n.agg(F.count_if(F.col("n_pre") != F.col("n_post")).alias("differing"), (F.count_if(F.col("n_pre") != F.col("n_post")) == 0).alias("equal"))


@query("o11_arms_differ", f"WITH {BAGS}, x AS (SELECT l_returnflag, l_suppkey, qty FROM pre EXCEPT ALL SELECT l_returnflag, l_suppkey, qty FROM post), y AS (SELECT l_returnflag, l_suppkey, qty FROM post EXCEPT ALL SELECT l_returnflag, l_suppkey, qty FROM pre) SELECT (SELECT count(*) FROM pre) AS rows_pre, (SELECT count(*) FROM post) AS rows_post, (SELECT count(*) FROM x) + (SELECT count(*) FROM y) > 0 AS differ")
def o11(spark, sf):
    a, b = bags(spark, sf)
    x, y = B.fingerprint(a.select(*KEY, *VALUE)), B.fingerprint(b.select(*KEY, *VALUE))
    x, y = x.toDF("rows_pre", "digest_pre"), y.toDF("rows_post", "digest_post")
    return x.crossJoin(y).select("rows_pre", "rows_post", (F.col("digest_pre") != F.col("digest_post")).alias("differ"))


@query("o10_reconciles", f"WITH {BAGS}, {BY_VALUE}, h AS (SELECT status, count(*) AS keys FROM d GROUP BY 1), r AS (SELECT CASE WHEN rows_pre = 0 THEN 'added' WHEN rows_post = 0 THEN 'removed' ELSE 'changed' END AS status, count(*) AS rows FROM d GROUP BY 1) SELECT coalesce(h.status, r.status) AS status, coalesce(keys, 0) AS keys, coalesce(rows, 0) AS rows FROM h FULL JOIN r ON h.status = r.status WHERE coalesce(keys, 0) <> coalesce(rows, 0)")
def o10(spark, sf):
    d = B.key_diff(*bags(spark, sf), KEY, VALUE)
    headline = d.groupBy("status").agg(F.count("*").alias("keys"))
    detail = d.select(F.when(F.col("rows_pre") == 0, "added").when(F.col("rows_post") == 0, "removed").otherwise("changed").alias("status"))
    return O.reconciles(headline, detail)


@query("a34_unique_or_refuse", "SELECT o_custkey, CASE WHEN count(DISTINCT o_orderpriority) = 0 THEN 'ABSENT' WHEN count(DISTINCT o_orderpriority) = 1 THEN 'VALUE' ELSE 'REFUSED' END AS status, CASE WHEN count(DISTINCT o_orderpriority) = 1 THEN min(o_orderpriority) END AS value FROM orders GROUP BY 1")
def a34(spark, sf):
    return O.unique_or_refuse(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


@query("a39_duplicates", "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def a39(spark, sf):
    return table(spark, sf, "part").groupBy("p_name").agg(F.count("*").alias("n")).filter("n > 1")


@query("a42_spec_agreement", "SELECT p_brand, CASE count(DISTINCT p_type) WHEN 0 THEN 'silent' WHEN 1 THEN 'agree' ELSE 'drift' END AS verdict FROM part GROUP BY 1")
def a42(spark, sf):
    n = F.countDistinct("p_type")
    return table(spark, sf, "part").groupBy("p_brand").agg(F.when(n == 0, "silent").when(n == 1, "agree").otherwise("drift").alias("verdict"))


@query("a41_reason_histogram", "SELECT o_orderstatus AS variant, split_part(o_orderpriority, '-', 1) AS reason, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY o_orderstatus), 6) AS percent FROM orders GROUP BY 1, 2")
def a41(spark, sf):
    from pyspark.sql import Window

    n = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("variant"), F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("variant")), 6))


@query("a38_completeness_sum", "SELECT p_brand, count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE n < 20) AS bad, count(*) AS wanted, coalesce(sum(n), 0)::BIGINT AS got, CASE WHEN count(*) FILTER (WHERE n IS NULL OR n < 20) = 0 THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS verdict FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1")
def a38(spark, sf):
    n = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf, "part").select("p_brand", "p_partkey").join(n, "p_partkey", "left")
    out = rows.groupBy("p_brand").agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("n") < 20).alias("bad"), F.count("*").alias("wanted"), F.coalesce(F.sum("n"), F.lit(0)).alias("got"))
    return out.withColumn("verdict", F.when(F.col("missing") + F.col("bad") == 0, "COMPLETE").otherwise("INCOMPLETE"))


@query("j13_roster_check", "SELECT p_brand AS name, CASE WHEN got IS NULL THEN 'MISSING' WHEN msha <> sha THEN 'SHA' WHEN got < want / 2.0 OR got < 20 THEN 'COLLAPSED' WHEN got <> want THEN 'DRIFT' ELSE 'OK' END AS status FROM (SELECT p_brand, count(*) AS want, max(p_type) AS sha FROM part GROUP BY 1) r LEFT JOIN (SELECT p_brand AS b, count(DISTINCT l_partkey) AS got, max(p_type) AS msha FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_discount < 0.05 GROUP BY 1) m ON m.b = r.p_brand")
def j13(spark, sf):
    part = table(spark, sf, "part")
    roster = part.groupBy(F.col("p_brand").alias("name")).agg(F.count("*").alias("want"), F.max("p_type").alias("sha"))
    sold = table(spark, sf, "lineitem").filter("l_discount < 0.05").join(part, F.col("l_partkey") == F.col("p_partkey"))
    measured = sold.groupBy(F.col("p_brand").alias("name")).agg(F.countDistinct("l_partkey").alias("got"), F.max("p_type").alias("sha"))
    return J.roster_check(roster, measured)
