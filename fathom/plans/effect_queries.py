"""Effects, verdicts and structure (events as units, customers as a call graph)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import effects as E
from ..operators import joins as J
from ..operators import structure as S
from ..operators.condensation import cyclic_nodes
from ..operators.graph import nodes_of
from .registry import query
from .views import CLOSURE, DIRECT, NAMED, UNIT_BAG, UNITS, arms, direct, edges, named_customers, table, unit_bag, unit_rows, units

CONCRETE = "list_filter({}, lambda x: x <> 'Unknown')"


def _join(c: str) -> str:
    return f"array_to_string({c}, ',')"


@query("a07_gate_tokens", f"WITH {UNITS}, t AS (SELECT fn FROM a FULL JOIN b USING (entry, fn) WHERE a.inferred IS DISTINCT FROM b.inferred) SELECT fn, array_to_string(list_sort(list(DISTINCT effect)), ',') AS tokens FROM unit_row WHERE arm = 'post' AND fn IN (SELECT fn FROM t) GROUP BY fn")
def a07(spark, sf):
    pre, post = arms(spark, sf)
    both = pre.withColumnRenamed("inferred", "p").join(post, ["entry", "fn"], "full")
    touched = both.filter(~F.col("p").eqNullSafe(F.col("inferred"))).select("fn")
    return E.gate_tokens(post, ["fn"], touched).select("fn", F.array_join("tokens", ",").alias("tokens"))


@query("a08_concrete_effects", f"WITH {UNITS} SELECT fn, array_to_string(list_sort(list(DISTINCT effect) FILTER (WHERE effect <> 'Unknown')), ',') AS effects, bool_or(effect = 'Unknown') AS has_unknown FROM unit_row WHERE arm = 'pre' GROUP BY fn")
def a08(spark, sf):
    pre, _ = arms(spark, sf)
    out = E.value_effects(pre.withColumn("interface_union", F.lit(False)), ["fn"])
    return out.select("fn", F.array_join("concrete", ",").alias("effects"), "has_unknown")


@query(
    "a17_buckets",
    f"WITH {UNITS}, {UNIT_BAG}, m AS (SELECT * FROM el WHERE gone > 0 OR came > 0), red AS (SELECT entry, fn, list(DISTINCT x) AS r FROM (SELECT entry, fn, unnest(inferred) AS x FROM bag WHERE arm = 'pre') WHERE x <> 'Unknown' GROUP BY ALL),"
    " k AS (SELECT entry, fn, coalesce(list(x) FILTER (WHERE f = 'e' AND came > 0 AND gone = 0), []) AS new, coalesce(bool_or(f = 'e'), false) AS conc, coalesce(bool_or(f = 'u' AND came > 0 AND gone = 0), false) AS hedged, coalesce(bool_or(f = 'union' AND came > 0), false) AS iu,"
    " coalesce(bool_or(f = 'e' AND gone > came), false) AS l3, coalesce(bool_or(f = 'u' AND gone > came), false) AS l3u, coalesce(bool_or(f = 'i' AND gone > came), false) AS l3i, coalesce(bool_or(f = 'k' AND gone > came), false) AS l3k FROM m GROUP BY entry, fn, hash),"
    " j AS (SELECT k.*, len(new) > 0 AS one, hedged AND NOT conc AS two, len(list_filter(new, lambda x: NOT list_contains(coalesce(r, []), x))) = 0 AS was_red FROM k LEFT JOIN red ON red.entry = k.entry AND red.fn = k.fn)"
    " SELECT count(*) FILTER (WHERE one AND NOT iu AND NOT was_red) AS bucket_1, count(*) FILTER (WHERE two AND NOT one AND NOT iu) AS bucket_2, count(*) FILTER (WHERE l3) AS bucket_3, count(*) FILTER (WHERE l3u) AS bucket_3u, count(*) FILTER (WHERE l3i) AS bucket_3i, count(*) FILTER (WHERE l3k) AS bucket_3k,"
    " count(*) FILTER (WHERE NOT one AND NOT two AND NOT l3 AND NOT l3u AND NOT l3i AND NOT l3k) AS bucket_4, count(*) FILTER (WHERE (one OR two) AND iu) AS dropped_union, count(*) FILTER (WHERE one AND NOT iu AND was_red) AS dropped_red FROM j",
)
def a17(spark, sf):
    return E.verdict_buckets(*unit_bag(spark, sf), ["entry", "fn", "hash"], ["entry", "fn"])


@query("a18_unknown_rows", f"WITH {UNITS}, c AS (SELECT entry, fn, count(*) FILTER (WHERE arm = 'pre' AND effect = 'Unknown') AS g, count(*) FILTER (WHERE arm = 'post' AND effect = 'Unknown') AS n FROM unit_row GROUP BY ALL) SELECT sum(greatest(n - g, 0))::BIGINT AS newly_unknown, sum(greatest(g - n, 0))::BIGINT AS lost_unknown FROM c")
def a18(spark, sf):
    n = unit_rows(spark, sf).filter("effect = 'Unknown'").groupBy("entry", "fn").agg(F.count_if(F.col("arm") == "pre").alias("g"), F.count_if(F.col("arm") == "post").alias("n"))
    more = lambda x, y: F.coalesce(F.sum(F.greatest(F.col(x) - F.col(y), F.lit(0))), F.lit(0))
    return n.agg(more("n", "g").alias("newly_unknown"), more("g", "n").alias("lost_unknown"))


TOKENS = (
    f"{UNITS}, {UNIT_BAG}, tk AS (SELECT arm, entry, fn, list(DISTINCT t) AS t FROM (SELECT arm, entry, fn, unnest(list_concat(inferred, list_transform(inv, lambda x: '~invisible:' || x), list_transform(dis, lambda x: '~incomplete:' || x))) AS t FROM bag) GROUP BY ALL),"
    " mv AS (SELECT entry, fn, list_filter(coalesce(q.t, []), lambda x: NOT list_contains(coalesce(p.t, []), x)) AS gain, list_filter(coalesce(p.t, []), lambda x: NOT list_contains(coalesce(q.t, []), x)) AS loss FROM (SELECT * FROM tk WHERE arm = 'pre') p FULL JOIN (SELECT * FROM tk WHERE arm = 'post') q USING (entry, fn))"
)
FLIP_TESTS = {"unknown": "x = 'Unknown'", "concrete": "x <> 'Unknown' AND x NOT LIKE '~%'", "incomplete": "x LIKE '~incomplete:%'", "invisible": "x LIKE '~invisible:%'"}
FLIP_COUNTS = ", ".join(f"count(*) FILTER (WHERE len(list_filter({'gain' if f.startswith('adds') else 'loss'}, lambda x: {FLIP_TESTS[f.partition('_')[2]]})) > 0) AS {f}" for f in E.FLIPS)


def _tokens(rows):
    t = rows.select("entry", "fn", F.explode(E.tokens(F.col("inferred"), F.col("dispatches_on"), F.col("invisible"))).alias("t"))
    return t.groupBy("entry", "fn").agg(F.collect_set("t").alias("tokens"))


@query("a19_gate_flips", f"WITH {TOKENS} SELECT {FLIP_COUNTS} FROM mv")
def a19(spark, sf):
    return E.gate_flips(*map(_tokens, unit_bag(spark, sf)), ["entry", "fn"])


@query("a19_flips_by_effect", f"WITH {TOKENS}, x AS (SELECT '0->1' AS direction, unnest(gain) AS effect FROM mv UNION ALL SELECT '1->0', unnest(loss) FROM mv) SELECT direction, effect, count(*) AS keys FROM x WHERE effect <> 'Unknown' AND effect NOT LIKE '~%' GROUP BY ALL")
def a19_effects(spark, sf):
    return E.flips_by_effect(*map(_tokens, unit_bag(spark, sf)), ["entry", "fn"])


@query("a20_band", f"WITH {UNITS}, c AS (SELECT entry, count(*) FILTER (WHERE effect = 'Unknown' AND arm = 'post' AND k < 10) AS new_unknown, count(*) FILTER (WHERE arm = 'post') AS analysed FROM unit_row GROUP BY entry), d AS (SELECT *, CASE WHEN entry % 6 = 5 THEN 0 ELSE new_unknown END AS au, CASE WHEN entry % 4 = 1 THEN 1 ELSE 0 END AS lc FROM c) SELECT entry, new_unknown, analysed, round(new_unknown * 100.0 / nullif(analysed, 0), 6)::DOUBLE AS percent, CASE WHEN au = 0 AND lc = 0 THEN 'NO GATE MOVED' WHEN au = 0 THEN 'DOES NOT APPLY' WHEN lc > 0 THEN 'ADDING PART ONLY' WHEN analysed = 0 THEN 'UNPRICED' WHEN new_unknown * 100.0 / analysed < 1.5 THEN 'SHIPS' WHEN new_unknown * 100.0 / analysed > 2.6 THEN 'DECLINED' ELSE 'ASK' END AS verdict FROM d")
def a20(spark, sf):
    n = unit_rows(spark, sf).groupBy("entry").agg(F.count_if((F.col("effect") == "Unknown") & (F.col("arm") == "post") & (F.col("k") < 10)).alias("new_unknown"), F.count_if(F.col("arm") == "post").alias("analysed"))
    counts = {f: F.lit(0) for f in E.FLIPS} | {"adds_unknown": F.when(F.col("entry") % 6 == 5, 0).otherwise(F.col("new_unknown")), "loses_concrete": (F.col("entry") % 4 == 1).cast("int")}
    return E.band(n.withColumns(counts), "new_unknown", "analysed").select("entry", "new_unknown", "analysed", "percent", "verdict")


@query("a21_loss_partition", f"WITH {UNITS}, r AS (SELECT a.* FROM a ANTI JOIN b USING (entry, fn)) SELECT CASE WHEN len({CONCRETE.format('inferred')}) > 0 THEN 'concrete' WHEN list_contains(inferred, 'Unknown') THEN 'unknown_only' ELSE 'nothing' END AS kind, count(*) AS rows FROM r GROUP BY 1")
def a21(spark, sf):
    pre, post = arms(spark, sf)
    none = F.array().cast("array<string>")
    return E.loss_partition(pre.join(post, ["entry", "fn"], "left_anti").withColumn("incomplete", none).withColumn("invisible", none))


@query("a22_key_loss", f"WITH {UNITS}, j AS (SELECT entry, fn, a.inferred AS p, b.inferred AS q FROM a JOIN b USING (entry, fn)) SELECT entry, fn, array_to_string(list_sort(list_filter(p, lambda e: NOT list_contains(q, e))), ',') AS lost, list_contains(q, 'Unknown') AS unknown_kept FROM j WHERE len(list_filter(p, lambda e: NOT list_contains(q, e))) > 0")
def a22(spark, sf):
    pre, post = arms(spark, sf)
    both = pre.withColumnRenamed("inferred", "p").join(post, ["entry", "fn"]).withColumn("l", F.array_except("p", "inferred")).filter("size(l) > 0")
    return both.select("entry", "fn", F.array_join(F.sort_array("l"), ",").alias("lost"), F.array_contains("inferred", "Unknown").alias("unknown_kept"))


STATE = "CASE WHEN {0} IS NULL THEN 'ABSENT' WHEN len({0}) = 0 THEN 'PURE' WHEN len(list_filter({0}, lambda x: x <> 'Unknown')) > 0 THEN 'CONCRETE' ELSE 'UNKNOWN' END"


@query("a23_state_matrix", f"WITH {UNITS}, pr AS (SELECT e.entry, f.fn FROM (SELECT DISTINCT entry FROM unit_row) e CROSS JOIN (SELECT DISTINCT fn FROM unit_row) f), s AS (SELECT {STATE.format('a.inferred')} AS pre, {STATE.format('b.inferred')} AS post FROM pr LEFT JOIN a USING (entry, fn) LEFT JOIN b USING (entry, fn)) SELECT pre, count(*) FILTER (WHERE post = 'ABSENT') AS absent, count(*) FILTER (WHERE post = 'PURE') AS pure, count(*) FILTER (WHERE post = 'CONCRETE') AS concrete, count(*) FILTER (WHERE post = 'UNKNOWN') AS unknown FROM s GROUP BY pre")
def a23(spark, sf):
    rows = units(spark, sf)
    hours = F.broadcast(rows.select("entry").distinct())  # 24 rows at most
    probes = rows.select("fn").distinct().crossJoin(hours)
    return E.state_matrix(probes, *arms(spark, sf), ["entry", "fn"])


@query("p13_triage", f"WITH {UNITS}, e AS (SELECT fn AS entry, count(*) FILTER (WHERE arm = 'pre' AND effect <> 'Unknown') AS rp, count(*) FILTER (WHERE arm = 'post' AND effect <> 'Unknown') AS rq, count(*) FILTER (WHERE arm = 'pre') AS ap, count(*) FILTER (WHERE arm = 'post') AS aq, max(k) < 50 AS error FROM unit_row GROUP BY fn) SELECT entry, CASE WHEN error THEN 'ERROR' WHEN (rp = 0 AND ap = 0) OR (rq = 0 AND aq = 0) THEN 'UNJUDGED' WHEN rp = 0 AND rq = 0 THEN 'ALL-PURE' ELSE 'COMPARED' END AS status FROM e")
def p13(spark, sf):
    n = lambda arm, known: F.count_if((F.col("arm") == arm) & (F.col("effect") != "Unknown" if known else F.lit(True)))
    e = unit_rows(spark, sf).groupBy(F.col("fn").alias("entry")).agg(n("pre", True).alias("rows_pre"), n("post", True).alias("rows_post"), n("pre", False).alias("analysed_pre"), n("post", False).alias("analysed_post"), (F.max("k") < 50).alias("error"))
    return E.triage(e)


@query("a10_effect_mix", f"WITH {UNITS}, x AS (SELECT unnest(inferred) AS effect FROM unit), n AS (SELECT CASE WHEN effect IN ('Net','Fs','Db','Exec','Env','Clock','Ipc','Log','Rand','Clipboard') THEN effect ELSE 'Unknown' END AS effect, count(*) AS n FROM x GROUP BY 1) SELECT effect, n, round(n / sum(n) OVER (), 9)::DOUBLE AS share FROM n")
def a10(spark, sf):
    return S.effect_mix(units(spark, sf)).withColumn("share", F.round("share", 9))


STRUCTURE = f"""{CLOSURE}, {DIRECT},
u AS (SELECT c_custkey AS fn, coalesce(list(effect) FILTER (WHERE effect IS NOT NULL), []) AS inferred FROM customer LEFT JOIN direct ON fn = c_custkey GROUP BY 1),
s AS (SELECT count(*) AS fns, sum(len(inferred)) AS inc, sum(len(list_filter(inferred, lambda x: x = 'Unknown'))) AS unk, count(*) FILTER (WHERE len(list_filter(inferred, lambda x: x <> 'Unknown')) >= 3) AS sm FROM u),
g AS (SELECT (SELECT count(*) FROM (SELECT src FROM edge UNION SELECT dst FROM edge)) AS nodes, (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM reach WHERE src = dst) AS cyclic),
m AS (SELECT *, sm / greatest(fns, 1) AS smear, unk / greatest(inc, 1) AS unknown_share, least(1.0, inc / greatest(fns, 1) / 2) AS density, least(1.0, edges / greatest(nodes, 1) / 2.6) AS tangle, cyclic / greatest(nodes, 1) AS cycle_ratio FROM s, g)"""


@query("a14_structure", f"WITH RECURSIVE {STRUCTURE} SELECT fns, nodes, edges, cyclic, round(smear, 6)::DOUBLE AS smear, round(density, 6)::DOUBLE AS density, round(tangle, 6)::DOUBLE AS tangle, round(least(1.0, log2(fns + 1) / 7 * 0.6 + tangle * 0.4), 6)::DOUBLE AS complexity, round(cycle_ratio, 6)::DOUBLE AS cycle_ratio, round(greatest(0.0, least(1.0, 1 - (0.30 * smear + 0.26 * unknown_share + 0.24 * greatest(0.0, tangle - 0.4) / 0.6 + 0.20 * least(1.0, 3 * cycle_ratio)))), 6)::DOUBLE AS structure FROM m")
def a14(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("fn"))
    u = c.join(direct(spark, sf), "fn", "left").select("fn", F.when(F.col("effect").isNull(), F.array().cast("array<string>")).otherwise(F.array("effect")).alias("inferred"))
    e = edges(spark, sf)
    out = S.structure(u, nodes_of(e), e, cyclic_nodes(e))
    rounded = [F.round(c, 6).alias(c) for c in ("smear", "density", "tangle", "complexity", "cycle_ratio", "structure")]
    return out.select("fns", "nodes", "edges", "cyclic", *rounded)


@query("p12_primary_effect", f"WITH {UNITS} SELECT arm, CASE WHEN list_contains(inferred, 'Net') THEN 'Net' WHEN list_contains(inferred, 'Db') THEN 'Db' WHEN list_contains(inferred, 'Clock') THEN 'Clock' WHEN list_contains(inferred, 'Log') THEN 'Log' WHEN len(inferred) > 0 THEN 'Unknown' END AS primary_effect, count(*) AS n FROM unit GROUP BY ALL")
def p12(spark, sf):
    return units(spark, sf).groupBy("arm", S.primary_effect(F.col("inferred")).alias("primary_effect")).agg(F.count("*").alias("n"))


@query("a29_layer_profile", f"WITH {NAMED} SELECT layer, count(DISTINCT fn) AS fns, coalesce(array_to_string(list_sort(list(DISTINCT effect) FILTER (WHERE effect IS NOT NULL)), ','), '') AS effects, coalesce(bool_or(effect = 'Unknown'), false) AS unknown FROM named GROUP BY layer")
def a29(spark, sf):
    n = named_customers(spark, sf)
    out = S.layer_profile(n.select("fn", "layer"), n.filter("effect IS NOT NULL").select("fn", F.array("effect").alias("inferred")), "layer")
    return out.select("layer", "fns", F.array_join("effects", ",").alias("effects"), "unknown")


@query("a27_tally", f"WITH {UNITS} SELECT effect, count(*) AS n FROM unit_row GROUP BY 1 ORDER BY n DESC, effect LIMIT 6")
def a27(spark, sf):
    return unit_rows(spark, sf).groupBy("effect").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "effect").limit(6)


@query("a28_summary", f"WITH {UNITS} SELECT arm, count(*) FILTER (WHERE list_contains(inferred, 'Unknown')) AS unknown_rows, array_to_string(list_sort(list_distinct(flatten(list(list_filter(inferred, lambda x: x <> 'Unknown'))))), ',') AS effects FROM unit GROUP BY arm")
def a28(spark, sf):
    u = units(spark, sf)
    return u.groupBy("arm").agg(F.count_if(F.array_contains("inferred", "Unknown")).alias("unknown_rows"), F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set(E.concrete(F.col("inferred")))))), ",").alias("effects"))


@query("a24_scope_ladder", f"WITH {NAMED}, g AS (SELECT region AS entry, fn AS qual, effect FROM named WHERE effect IS NOT NULL AND c_acctbal < 0), b AS (SELECT region AS entry, fn AS qual, effect FROM named WHERE effect IS NOT NULL AND c_acctbal >= 5000),"
    " l AS (SELECT region AS entry, fn AS qual FROM named WHERE effect IS NULL), gx AS (SELECT *, regexp_replace(qual, '\\.[^.]*$', '') AS cls FROM g), bx AS (SELECT *, regexp_replace(qual, '\\.[^.]*$', '') AS cls FROM b),"
    " gp AS (SELECT *, regexp_replace(cls, '\\.[^.]*$', '') AS pkg FROM gx), bp AS (SELECT *, regexp_replace(cls, '\\.[^.]*$', '') AS pkg FROM bx)"
    " SELECT 'function' AS level, count(*) AS n FROM (SELECT DISTINCT entry, qual FROM gp) UNION ALL SELECT 'class', count(*) FROM (SELECT DISTINCT entry, cls FROM gp)"
    " UNION ALL SELECT 'package', count(*) FROM (SELECT entry, pkg, effect FROM gp EXCEPT SELECT entry, pkg, effect FROM bp) UNION ALL SELECT 'artifact', count(*) FROM (SELECT entry, effect FROM gp EXCEPT SELECT entry, effect FROM bp) UNION ALL SELECT 'lost', count(*) FROM (SELECT DISTINCT entry, qual FROM l)")
def a24(spark, sf):
    n = named_customers(spark, sf).select(F.col("region").alias("entry"), F.col("fn").alias("qual"), "effect", "c_acctbal")
    has = n.filter("effect IS NOT NULL")
    return J.scope_ladder(has.filter("c_acctbal < 0"), n.filter("effect IS NULL"), has.filter("c_acctbal >= 5000"))


@query("a33_histogram", "SELECT p_type, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS percent FROM part GROUP BY 1")
def a33(spark, sf):
    n = table(spark, sf, "part").groupBy("p_type").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("t"))
    return n.crossJoin(F.broadcast(total)).select("p_type", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("percent"))


@query("a35_reach", "SELECT source, coalesce(sum(len(string_split(text, 'th')) - 1), 0)::BIGINT AS hits, count(*) FILTER (WHERE contains(text, 'th')) AS entries FROM documents GROUP BY source")
def a35(spark, sf):
    hits = F.regexp_count("text", F.lit(r"\Qth\E"))
    return table(spark, sf, "documents").groupBy("source").agg(F.coalesce(F.sum(hits), F.lit(0)).cast("long").alias("hits"), F.count_if(F.contains("text", F.lit("th"))).alias("entries"))


@query("a36_activity", "SELECT user_id AS session, count(*) AS turns, count(*) FILTER (WHERE event_type = 'error') AS blocked, count(DISTINCT event_type) AS kinds, round(max(value), 6) AS max_value, date_diff('second', min(ts), max(ts)) AS span FROM events GROUP BY 1")
def a36(spark, sf):
    e = table(spark, sf, "events")
    second = lambda c: F.unix_timestamp(F.date_trunc("second", c))
    return e.groupBy(F.col("user_id").alias("session")).agg(F.count("*").alias("turns"), F.count_if(F.col("event_type") == "error").alias("blocked"), F.countDistinct("event_type").alias("kinds"), F.round(F.max("value"), 6).alias("max_value"), (second(F.max("ts")) - second(F.min("ts"))).alias("span"))


@query("a37_owner_digest", "SELECT strftime(ts, '%Y-%m') AS month, count(*) AS checked, count(*) FILTER (WHERE event_type = 'error') AS held, count(DISTINCT user_id) AS owners, count(*) FILTER (WHERE event_type = 'view') AS quiet FROM events GROUP BY 1")
def a37(spark, sf):
    e = table(spark, sf, "events")
    return e.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count("*").alias("checked"), F.count_if(F.col("event_type") == "error").alias("held"), F.countDistinct("user_id").alias("owners"), F.count_if(F.col("event_type") == "view").alias("quiet"))


@query("a26_totals", "SELECT n_name, sum(s_acctbal)::DECIMAL(38,2)::VARCHAR AS total, count(*) AS n FROM (SELECT n_name, CAST(s_acctbal AS DECIMAL(18,2)) AS s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1")
def a26(spark, sf):
    s = table(spark, sf, "supplier").join(F.broadcast(table(spark, sf, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return s.groupBy("n_name").agg(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).cast("decimal(38,2)").cast("string").alias("total"), F.count("*").alias("n"))


@query("a12_smear", f"WITH {UNITS} SELECT entry, round(avg(CASE WHEN len(list_filter(inferred, lambda x: x <> 'Unknown')) >= 3 THEN 1.0 ELSE 0.0 END), 9)::DOUBLE AS smear FROM unit GROUP BY entry")
def a12(spark, sf):
    return units(spark, sf).groupBy("entry").agg(F.round(F.avg(F.when(F.size(E.concrete(F.col("inferred"))) >= 3, 1.0).otherwise(0.0)), 9).alias("smear"))


@query("j16_gained_pairs", f"WITH {UNITS} SELECT DISTINCT fn, effect FROM unit_row p WHERE arm = 'post' AND NOT EXISTS (SELECT 1 FROM unit_row q WHERE q.arm = 'pre' AND q.fn = p.fn AND q.effect = p.effect AND q.entry = 0)")
def j16(spark, sf):
    r = unit_rows(spark, sf)
    return J.gained_pairs(r.filter("arm = 'post'"), r.filter("arm = 'pre' AND entry = 0").select("fn", "effect").distinct())


