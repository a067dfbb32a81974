"""Audits of two arms, on events and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audits as X
from ..operators import consistency as O
from ..operators import graph as G
from ..operators import policy as P
from .registry import query
from .views import CLOSURE, DIRECT, EDGES, UNITS, direct, edges, table, unit_rows, units


@query(
    "r11_arm_flips",
    f"WITH {UNITS}, p AS (SELECT DISTINCT entry, fn // 2 AS bare, effect FROM unit_row WHERE arm = 'pre'), q AS (SELECT DISTINCT entry, fn // 2 AS bare, effect FROM unit_row WHERE arm = 'post'),"
    " x AS (SELECT *, '1->0' AS direction FROM (SELECT * FROM p EXCEPT SELECT * FROM q) UNION ALL SELECT *, '0->1' FROM (SELECT * FROM q EXCEPT SELECT * FROM p)) SELECT 'deny ' || effect AS rule, direction, count(*) AS n FROM x GROUP BY ALL",
)
def r11(spark, sf):
    u = units(spark, sf).withColumn("fn", F.concat(F.lit("f"), F.expr("fn div 2").cast("string"), F.lit("("), F.col("fn").cast("string"), F.lit(")"))).withColumn("classes", F.array().cast("array<string>"))
    flips = X.arm_flips(u.filter("arm = 'pre'"), u.filter("arm = 'post'")).filter("NOT member")
    return flips.groupBy("rule", "direction").agg(F.count("*").alias("n"))


@query(
    "r14_member_flips",
    f"WITH {UNITS}, p AS (SELECT DISTINCT entry, fn, effect FROM unit_row WHERE arm = 'pre'), q AS (SELECT DISTINCT entry, fn, effect FROM unit_row WHERE arm = 'post'), k AS (SELECT DISTINCT entry, fn FROM q), bq AS (SELECT DISTINCT entry, fn // 2 AS bare, effect FROM q)"
    " SELECT 'deny ' || p.effect AS rule, count(*) AS n FROM p JOIN k USING (entry, fn) WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.entry = p.entry AND q.fn = p.fn AND q.effect = p.effect) AND EXISTS (SELECT 1 FROM bq WHERE bq.entry = p.entry AND bq.bare = p.fn // 2 AND bq.effect = p.effect) GROUP BY 1",
)
def r14(spark, sf):
    u = units(spark, sf).withColumn("fn", F.concat(F.lit("f"), F.expr("fn div 2").cast("string"), F.lit("("), F.col("fn").cast("string"), F.lit(")"))).withColumn("classes", F.array().cast("array<string>"))
    flips = X.arm_flips(u.filter("arm = 'pre'"), u.filter("arm = 'post'")).filter("member")
    return flips.groupBy("rule").agg(F.count("*").alias("n"))


GAINED = "gained AS (SELECT e.src AS fn, e.dst AS callee FROM edge e JOIN customer c ON c.c_custkey = e.src WHERE c.c_mktsegment = 'HOUSEHOLD' AND e.dst <> c.c_custkey // 4)"


@query(
    "g07_lost_unknown",
    f"WITH RECURSIVE {CLOSURE}, {DIRECT}, lost AS (SELECT c_custkey AS fn FROM customer WHERE c_mktsegment = 'HOUSEHOLD'), {GAINED}, known AS (SELECT c_custkey AS fn FROM customer WHERE c_acctbal >= -900),"
    " meets AS (SELECT fn, callee AS n FROM gained UNION SELECT g.fn, r.dst FROM gained g JOIN reach r ON r.src = g.callee), s AS (SELECT m.fn, bool_or(d.effect IS NOT NULL AND d.effect <> 'Unknown') AS loud, bool_or(coalesce(d.effect = 'Unknown', false) OR k.fn IS NULL) AS opened FROM meets m LEFT JOIN direct d ON d.fn = m.n LEFT JOIN known k ON k.fn = m.n GROUP BY 1),"
    " f AS (SELECT g.fn, bool_or(k.fn IS NULL) AS dropped FROM gained g LEFT JOIN known k ON k.fn = g.callee GROUP BY 1) SELECT lost.fn, CASE WHEN f.fn IS NULL OR dropped OR loud THEN 'C3' WHEN opened THEN 'C2' ELSE 'C1' END AS class FROM lost LEFT JOIN f USING (fn) LEFT JOIN s USING (fn)",
)
def g07(spark, sf):
    c = table(spark, sf, "customer")
    e = edges(spark, sf)
    lost = c.filter("c_mktsegment = 'HOUSEHOLD'").select(F.col("c_custkey").alias("fn"), F.array().cast("array<string>").alias("tokens"))
    before = e.filter("dst = src div 4")
    rows = direct(spark, sf).select("fn", F.array("effect").alias("tokens"))
    return X.classify_lost_unknown(lost, before, e, c.filter("c_acctbal >= -900").select(F.col("c_custkey").alias("fn")), rows)


@query(
    "g08_root_causes",
    f"WITH RECURSIVE {CLOSURE}, {DIRECT}, head AS (SELECT e.src, e.dst FROM edge e JOIN customer c ON c.c_custkey = e.src WHERE c.c_acctbal < 9000), hdirect AS (SELECT d.fn, d.effect FROM direct d JOIN customer c ON c.c_custkey = d.fn WHERE d.effect = 'Fs' AND c.c_acctbal < 5000),"
    " pe AS (SELECT fn FROM direct WHERE effect = 'Fs' UNION SELECT r.src FROM reach r JOIN direct d ON d.fn = r.dst WHERE d.effect = 'Fs'), he AS (SELECT fn FROM hdirect UNION SELECT h.src FROM head h JOIN he ON he.fn = h.dst),"
    " w0 AS (SELECT fn, fn AS \"at\", 0 AS steps FROM pe WHERE fn NOT IN (SELECT fn FROM he) UNION SELECT w.fn, e.dst, w.steps + 1 FROM w0 w JOIN edge e ON e.src = w.at JOIN pe ON pe.fn = e.dst JOIN head h ON h.src = e.src AND h.dst = e.dst WHERE e.dst NOT IN (SELECT fn FROM he) AND w.steps < 60), w AS (SELECT fn, \"at\", min(steps)::INT AS steps FROM w0 GROUP BY ALL)"
    " SELECT w.fn, 'OWN' AS kind, w.at AS root, -1 AS callee, steps FROM w JOIN direct d ON d.fn = w.at WHERE d.effect = 'Fs' UNION ALL SELECT w.fn, CASE WHEN h.src IS NULL THEN 'LOSTEDGE' ELSE 'UNPROPAGATED' END, w.at, e.dst, steps FROM w JOIN edge e ON e.src = w.at JOIN pe ON pe.fn = e.dst LEFT JOIN head h ON h.src = e.src AND h.dst = e.dst WHERE h.src IS NULL OR e.dst IN (SELECT fn FROM he)",
)
def g08(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    e = edges(spark, sf)
    head = e.join(c.filter("c_acctbal < 9000").select(F.col("c_custkey").alias("src")), "src", "left_semi")
    own = direct(spark, sf).filter("effect = 'Fs'")
    own_head = own.join(c.filter("c_acctbal < 5000").select(F.col("c_custkey").alias("fn")), "fn", "left_semi")
    before, after = G.effects_closure(e, own), G.effects_closure(head, own_head)
    lost = before.join(after, ["fn", "effect"], "left_anti")
    out = X.root_causes(lost, e, head, before, after, own)
    return out.select("fn", "kind", "root", F.coalesce("callee", F.lit(-1)).alias("callee"), F.size("path").alias("steps"))


@query("g08_union_causes")
def g08_union(spark, sf):
    """The same loss with customers as members of types T0 to T4; every seventh member of T0 is one of an interface. Tested against brute force."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    name = lambda k: F.concat(F.lit("T"), (F.col(k) % 5).cast("string"), F.lit(".m"), F.expr(f"{k} div 5").cast("string")).alias(k)
    e = edges(spark, sf)
    head = e.join(c.filter("c_acctbal < 9000").select(F.col("c_custkey").alias("src")), "src", "left_semi")
    own = direct(spark, sf).filter("effect = 'Fs'")
    kept = own.join(c.filter("c_acctbal < 5000").select(F.col("c_custkey").alias("fn")), "fn", "left_semi")
    # Effects are followed by number, which is shorter; each number has one name.
    before, after, own = (x.select(name("fn"), "effect") for x in (G.effects_closure(e, own), G.effects_closure(head, kept), own))
    e, head = (x.select(name("src"), name("dst")) for x in (e, head))
    # What an interface carries comes from its implementors, not from calls of its own.
    union = lambda c: F.col(c).startswith("T0.") & (F.substring(F.col(c), 5, 20).cast("long") % 7 == 0)
    out = X.root_causes(before.join(after, ["fn", "effect"], "left_anti"), e.filter(~union("src")), head, before, after, own.filter(~union("fn")), before.filter(union("fn")).select("fn"))
    return out.select("fn", "kind", "root", "callee", F.array_join("path", ">").alias("path"))


@query("g14_what_if", f"WITH RECURSIVE {CLOSURE}, {DIRECT}, t AS (SELECT src AS fn FROM reach JOIN customer ON c_custkey = dst WHERE c_acctbal < -900 UNION SELECT c_custkey FROM customer WHERE c_acctbal < -900) SELECT CAST(t.fn AS VARCHAR) AS fn FROM t JOIN customer ON c_custkey = t.fn WHERE starts_with(CAST(t.fn AS VARCHAR), '1') AND t.fn NOT IN (SELECT fn FROM direct WHERE effect = 'Net')")
def g14(spark, sf):
    text = lambda c: F.col(c).cast("string").alias(c)
    e = edges(spark, sf).select(text("src"), text("dst"))
    c = table(spark, sf, "customer")
    own = direct(spark, sf).select(text("fn"), "effect")
    u = c.select(F.col("c_custkey").cast("string").alias("fn")).join(own, "fn", "left").select("fn", F.when(F.col("effect").isNull(), F.array().cast("array<string>")).otherwise(F.array("effect")).alias("inferred"))
    asked = c.filter("c_acctbal < -900").select(F.col("c_custkey").cast("string").alias("fn"))
    return P.what_if(e, asked, "Net", u, P.parse_policy(spark, "deny Net 1")).select("fn")


@query("r05_only_reaches", f"WITH RECURSIVE {CLOSURE} SELECT r.src, r.dst FROM reach r JOIN customer a ON a.c_custkey = r.src JOIN customer b ON b.c_custkey = r.dst WHERE b.c_acctbal < -900 AND a.c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND NOT a.c_acctbal < -900")
def r05(spark, sf):
    pick = lambda where: table(spark, sf, "customer").filter(where).select(F.col("c_custkey").alias("fn"))
    return X.only_reaches(edges(spark, sf), pick("true"), pick("c_acctbal < -900"), pick("c_mktsegment IN ('BUILDING', 'MACHINERY')"))


@query("g09_edge_identical", f"WITH {EDGES} SELECT c_custkey AS id, EXISTS (SELECT 1 FROM edge WHERE src = c_custkey AND dst = c_custkey // 4) AND EXISTS (SELECT 1 FROM edge WHERE src = c_custkey // 4 AND dst = c_custkey // 16) AS identical FROM customer")
def g09(spark, sf):
    paths = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.array("c_custkey", F.expr("c_custkey div 4"), F.expr("c_custkey div 16")).alias("path"))
    return X.edge_identical(paths, edges(spark, sf))


@query("o16_predictions", f"WITH {UNITS}, s AS (SELECT CASE WHEN entry < 12 THEN 1 ELSE 2 END AS category, max(CASE WHEN arm = 'pre' AND effect = 'Db' AND k < 30 THEN 1 ELSE 0 END) AS a, max(CASE WHEN arm = 'post' AND effect = 'Db' THEN 1 ELSE 0 END) AS b, max(CASE WHEN arm = 'post' AND effect = 'Unknown' THEN 1 ELSE 0 END) AS w FROM unit_row GROUP BY entry, fn), n AS (SELECT count(*) FILTER (WHERE category = 1) AS category_1, count(*) FILTER (WHERE category = 1 AND a = 0 AND b = 1) AS category_1_ok, count(*) FILTER (WHERE category = 2) AS category_2, count(*) FILTER (WHERE category = 2 AND a = 0 AND b = 0 AND w = 1) AS category_2_ok FROM s) SELECT *, CASE WHEN category_1 = 0 THEN 'NOTHING VALIDATED' WHEN category_1 = category_1_ok AND category_2 = category_2_ok THEN 'OK' ELSE 'MISPREDICTED' END AS status FROM n")
def o16(spark, sf):
    flag = lambda arm, effect, k=1000: F.max(F.when((F.col("arm") == arm) & (F.col("effect") == effect) & (F.col("k") < k), 1).otherwise(0))
    s = unit_rows(spark, sf).groupBy("entry", "fn").agg(flag("pre", "Db", 30).alias("bare_pre"), flag("post", "Db").alias("bare_post"), flag("post", "Unknown").alias("wide_post"))
    return X.predictions(s.withColumn("category", F.when(F.col("entry") < 12, 1).otherwise(2)))


@query("a25_coverage", "SELECT count(*) AS entries, count(n) AS with_manifest, coalesce(sum(n), 0)::BIGINT AS probes, coalesce(sum(q), 0)::BIGINT AS calls FROM (SELECT s_suppkey FROM supplier) LEFT JOIN (SELECT l_suppkey, count(*) AS n, sum(CAST(l_quantity AS INT)) AS q FROM lineitem WHERE l_discount > 0.09 GROUP BY 1) ON l_suppkey = s_suppkey")
def a25(spark, sf):
    m = table(spark, sf, "lineitem").filter("l_discount > 0.09").groupBy(F.col("l_suppkey").alias("entry")).agg(F.count("*").alias("probes"), F.sum(F.col("l_quantity").cast("int")).alias("calls"))
    return X.coverage(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entry")), m, ["probes", "calls"])


@query("a25_skips", "SELECT l_returnflag || l_linestatus AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def a25_skips(spark, sf):
    n = table(spark, sf, "lineitem").groupBy("l_suppkey", F.concat("l_returnflag", "l_linestatus").alias("r")).agg(F.count("*").alias("n"))
    return X.skip_histogram(n.groupBy("l_suppkey").agg(F.map_from_entries(F.collect_list(F.struct("r", "n"))).alias("skips")))


@query("a32_foreign_keys", "SELECT DISTINCT n_name || '#' || c_mktsegment AS key FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_name NOT IN ('NATION_1', 'NATION_2')")
def a32(spark, sf):
    c = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return X.foreign_keys(c.select(F.array(F.concat("n_name", F.lit("#"), "c_mktsegment"), F.col("n_name")).alias("dispatches_on")), ["NATION_1", "NATION_2"])


@query("t03_to_run", "SELECT o.o_custkey AS tree, CASE WHEN s.m IS NULL THEN 'never passed' WHEN s.m > TIMESTAMP '2001-07-01' THEN 'future stamp' WHEN o.m > s.m THEN 'modified' WHEN o.n <> s.n THEN 'content' END AS reason FROM (SELECT o_custkey, max(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1) o LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS m, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) s ON s.o_custkey = o.o_custkey WHERE s.m IS NULL OR s.m > TIMESTAMP '2001-07-01' OR o.m > s.m OR o.n <> s.n")
def t03(spark, sf):
    o = table(spark, sf, "orders")
    now = o.groupBy(F.col("o_custkey").alias("tree")).agg(F.max("o_orderdate").alias("modified"), F.count("*").alias("signature"))
    done = o.filter("o_orderstatus <> 'F'").groupBy(F.col("o_custkey").alias("tree")).agg(F.max("o_orderdate").alias("stamped"), F.count("*").alias("signature"))
    return X.to_run(now, done, "2001-07-01 00:00:00")


@query("t04_stalled", "SELECT workflow, elapsed FROM (SELECT o_custkey AS workflow, max(o_totalprice) AS elapsed, quantile_disc(o_totalprice, 0.5) AS median FROM orders GROUP BY 1) WHERE elapsed > greatest(median * 1.9, 600)")
def t04(spark, sf):
    from ..operators.ordering import lower_median

    o = table(spark, sf, "orders").withColumnRenamed("o_custkey", "workflow")
    return X.stalled(o.groupBy("workflow").agg(F.max("o_totalprice").alias("elapsed")), lower_median(o, ["workflow"], "o_totalprice"), 1.9)


@query("t06_remaining", "SELECT DISTINCT p_partkey AS part FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)")
def t06(spark, sf):
    done = table(spark, sf, "lineitem").filter("l_quantity > 48").select(F.col("l_partkey").alias("part"))
    return X.remaining(table(spark, sf, "part").select(F.col("p_partkey").alias("part")), done, ["part"])


@query("g16_one_plan_per_cause", "SELECT count(*) AS plans FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_suppkey, l_linenumber FROM lineitem)")
def g16(spark, sf):
    plans = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("effect"), F.col("l_linestatus").alias("layer"), F.col("l_suppkey").alias("site"), F.col("l_linenumber").alias("hoist"), "l_orderkey")
    return X.one_plan_per_cause(plans).agg(F.count("*").alias("plans"))


@query("o09_ledger_fresh", "SELECT doc_id FROM documents WHERE NOT (contains(text, 'the') AND contains(text, 'and')) AND NOT (contains(text, 'der') AND contains(text, 'und'))")
def o09(spark, sf):
    known = spark.createDataFrame([("the", "and"), ("der", "und"), ("zzzz", "qqqq")], "part_a string, part_b string")
    return O.ledger(table(spark, sf, "documents").select("doc_id", "text"), known)[0].select("doc_id")


@query("p14_literal_surface", "SELECT c_custkey AS fn FROM customer WHERE c_acctbal < 0 OR c_mktsegment = 'BUILDING'")
def p14(spark, sf):
    none, one = F.array().cast("array<string>"), F.array(F.lit("x"))
    u = table(spark, sf, "customer").select(F.col("c_custkey").alias("fn"), F.when(F.col("c_acctbal") < 0, one).alias("hosts"), F.when(F.col("c_mktsegment") == "BUILDING", one).otherwise(none).alias("paths"), none.alias("cmds"))
    return P.surface(u).select("fn")


@query("o12_evidence", "SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS compared, (SELECT count(*) FROM orders WHERE o_totalprice < 0) AS changed, (SELECT count(*) FROM documents WHERE contains(text, 'the')) AS reached, 0 AS status")
def o12(spark, sf):
    o = table(spark, sf, "orders")
    return X.evidence(o.filter("o_orderstatus = 'F'"), o.filter("o_totalprice < 0"), table(spark, sf, "documents").filter(F.contains("text", F.lit("the"))))
