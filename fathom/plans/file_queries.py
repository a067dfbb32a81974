"""Files of arms, tables with tabs, written documents and the activity log, made from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import bags as B
from ..operators import policy as P
from ..operators.graph import shared_folder
from ..sources import arms as A
from ..sources import reports, sinks
from ..streaming import activity as T
from ..streaming import blocked as BL
from .registry import query
from .views import NAMED, UNIT_BAG, UNITS, arms, named_customers, table, unit_bag


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _none():
    return F.array().cast("array<string>")


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _s(column):
    return F.col(column).cast("string")


@query(
    "s09_call_graph",
    "WITH n AS (SELECT DISTINCT c_custkey // 3 AS k FROM customer), e AS (SELECT DISTINCT c_custkey // 3 AS k, unnest(['c' || CAST(c_nationkey AS VARCHAR), 'd' || CAST(c_custkey % 7 AS VARCHAR)]) AS dst FROM customer WHERE c_custkey % 3 <> 0) SELECT 'n' || CAST(n.k AS VARCHAR) AS fn, count(dst) AS callees FROM n LEFT JOIN e USING (k) GROUP BY 1",
)
def s09(spark, sf):
    """Sidecars of 30 functions; every function is in several of them, in one without callees."""
    c = table(spark, sf, "customer").withColumn("k", F.expr("c_custkey div 3"))
    callees = F.when(F.col("c_custkey") % 3 == 0, _none()).otherwise(F.array(_text("c", _s("c_nationkey")), _text("d", (F.col("c_custkey") % 7).cast("string"))))
    one = F.struct(_text("n", _s("k")).alias("key"), callees.alias("value"))
    files = c.groupBy(F.col("c_custkey") % 3, F.expr("k div 30")).agg(F.to_json(F.map_from_entries(F.collect_list(one))).alias("value"))  # 30 functions of a file
    nodes, edges = reports.call_graph(files)
    return nodes.join(edges.withColumnRenamed("src", "fn"), "fn", "left").groupBy("fn").agg(F.count("dst").alias("callees"))


@query(
    "s10_arm_index",
    "WITH c AS (SELECT c_custkey AS k, c_custkey // 100 AS r FROM customer) SELECT 'e' || CAST(k AS VARCHAR) AS entry, CASE WHEN k % 4 IN (0, 1) THEN 'gz' ELSE 'json' END AS report, CASE WHEN k % 5 = 0 THEN 'gz' WHEN k % 3 = 0 THEN 'json' ELSE '' END AS call_graph, 'ok' AS state FROM c WHERE r % 2 = 0"
    " UNION ALL SELECT 'e' || CAST(k AS VARCHAR), 'gz', CASE WHEN k % 3 = 0 AND k % 9 <> 0 AND k % 6 <> 0 THEN 'gz' ELSE '' END, CASE WHEN k % 3 <> 0 THEN 'ok' WHEN k % 9 = 0 THEN 'no graph file' WHEN k % 6 = 0 THEN 'other graph' ELSE 'ok' END FROM c WHERE r % 2 = 1 AND k % 11 <> 0 AND k % 4 <> 0",
)
def s10(spark, sf):
    """Customers as arms, a folder for each hundred: scans and stores in turns."""
    k, r = F.col("c_custkey"), F.expr("c_custkey div 100")
    root, e, content = _text("/arms/", r.cast("string")), _text("/e", _s("c_custkey")), F.col("c_name")
    file = lambda test, path, value=F.lit("{}"): F.when(test, F.struct(path.alias("path"), value.alias("value")))
    scan, stem = r % 2 == 0, _text(root, "/entries/L", _s("c_custkey"), "-s")
    sha = F.when(k % 6 == 0, F.lit("0" * 64)).otherwise(F.sha2(content, 256))
    meta = F.to_json(F.struct(F.when(k % 11 != 0, _text("e", _s("c_custkey"))).alias("entry_label"), F.when(k % 3 == 0, F.struct(sha.alias("sha256"))).alias("callgraph")))
    files = F.array(
        file(scan & (k % 4 != 0), _text(root, e, ".scan.json")),
        file(scan & (k % 4 < 2), _text(root, e, ".scan.json.gz")),
        file(scan & (k % 3 == 0), _text(root, e, ".scan.callgraph.json")),
        file(scan & (k % 5 == 0), _text(root, e, ".scan.callgraph.json.gz")),
        file(scan, _text(root, e, ".gate.json")),
        file(~scan, _text(stem, ".meta.json"), meta),
        file(~scan & (k % 4 != 0), _text(stem, ".report.gz")),
        file(~scan & (k % 3 == 0) & (k % 9 != 0), _text(stem, ".callgraph.json.gz"), content),
    )
    made = table(spark, sf, "customer").select(F.explode(F.array_compact(files)).alias("f")).select("f.*")
    kind = lambda c: F.coalesce(F.regexp_extract(c, r"([^.]+)$", 1), F.lit(""))
    return A.arm_index(made).select("entry", kind("report").alias("report"), kind("call_graph").alias("call_graph"), "state")


@query(
    "s14_pairs",
    "WITH c AS (SELECT c_custkey // 50 AS f, c_acctbal < 0 AS gone FROM customer) SELECT CAST(f AS VARCHAR) AS entry, CASE WHEN f % 10 = 3 THEN 'post' WHEN f % 10 = 7 THEN 'pre' ELSE '' END AS broken, CASE WHEN f % 10 IN (3, 7) THEN 0 ELSE count(*) FILTER (WHERE gone) END::BIGINT AS changed, CASE WHEN f % 10 IN (3, 7) THEN 0 ELSE count(*) END::BIGINT AS keys FROM c GROUP BY f",
)
def s14(spark, sf):
    """Pairs of captured reports of 50 functions; those of customers in debt lose their effect, some texts are cut off."""
    fn = lambda lost: F.struct(F.col("c_name").alias("fn"), F.when(lost & (F.col("c_acctbal") < 0), _none()).otherwise(F.array("c_mktsegment")).alias("inferred"))
    report = lambda lost: F.to_json(F.struct(F.collect_list(fn(lost)).alias("functions")))
    pairs = table(spark, sf, "customer").groupBy(F.expr("c_custkey div 50").alias("f")).agg(report(F.lit(False)).alias("pre"), report(F.lit(True)).alias("post"))
    cut = lambda c, n: F.when(F.col("f") % 10 == n, F.left(c, F.lit(20))).otherwise(F.col(c)).alias(c)
    units, errors = A.pair_arms(pairs.select(_s("f").alias("label"), cut("pre", 7), cut("post", 3)))
    rows = units.withColumn("value", F.array_join("inferred", ","))
    diff = B.key_diff(rows.filter("arm = 'pre'"), rows.filter("arm = 'post'"), ["entry", "fn"], ["value"])
    counts = diff.groupBy("entry").agg(F.count_if(F.col("status") == "changed").alias("changed"), F.count("*").alias("keys"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return counts.join(errors, "entry", "full").select("entry", F.coalesce("arm", F.lit("")).alias("broken"), zero("changed"), zero("keys"))


@query(
    "s16_rosters",
    "SELECT c_name AS repo, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS target, c_nationkey AS want_rows, CASE WHEN c_custkey % 3 = 0 THEN -1 ELSE c_custkey % 100 END::INT AS want_deps FROM customer WHERE c_custkey % 10 > 1",
)
def s16(spark, sf):
    k = F.col("c_custkey")
    row = F.concat_ws("\t", F.col("c_name"), F.lit("v1"), F.lit("sha"), F.when(k % 4 == 0, "-").otherwise(F.col("c_mktsegment")), F.lit("1"), F.lit("2"), _s("c_nationkey"), F.when(k % 3 == 0, "-").otherwise((k % 100).cast("string")), F.lit("-"))
    lines = table(spark, sf, "customer").select(F.when(k % 10 == 0, _text("# ", row)).when(k % 10 == 1, " ").otherwise(row).alias("value"))
    return A.roster(lines, "ts").select("repo", "target", "want_rows", F.coalesce("want_deps", F.lit(-1)).alias("want_deps"))


@query(
    "s17_sweep_rows",
    "SELECT p_name AS jar, p_brand AS policy, CASE WHEN p_partkey % 6 < 4 THEN p_size ELSE -1 END::INT AS n, CASE p_partkey % 6 WHEN 4 THEN 'NA' WHEN 5 THEN 'unreadable' ELSE 'measured' END AS state FROM part WHERE p_partkey % 7 <> 0",
)
def s17(spark, sf):
    """Parts as measurements; every seventh line lacks its count."""
    k = F.col("p_partkey")
    n = F.when(k % 6 == 4, "NA").when(k % 6 == 5, "many").otherwise(_s("p_size"))
    lines = table(spark, sf, "part").select(F.when(k % 7 == 0, F.concat_ws("\t", "p_name", "p_brand")).otherwise(F.concat_ws("\t", F.col("p_name"), F.col("p_brand"), n)).alias("value"))
    return A.sweep(lines.unionByName(spark.range(1).select(F.lit("jar\tpolicy\tviolations\texit").alias("value")))).withColumn("n", F.coalesce("n", F.lit(-1)))


@query("s18_cells", "SELECT CAST(event_id AS VARCHAR) AS entry, event_type AS fn, CAST(user_id AS VARCHAR) AS effect FROM events WHERE event_id % 5 > 1")
def s18(spark, sf):
    row = F.concat_ws("\t", _s("event_id"), F.col("event_type"), _s("user_id"), F.lit("more"))
    k = F.col("event_id") % 5
    return A.cells(table(spark, sf, "events").select(F.when(k == 0, _text("#", row)).when(k == 1, F.concat_ws("\t", _s("event_id"), F.lit("a"))).otherwise(row).alias("value")))


@query(
    "s20_object_items",
    "SELECT CAST(c_custkey AS VARCHAR) AS path, unnest(CASE c_custkey % 6 WHEN 0 THEN [-1] WHEN 1 THEN [-1] WHEN 2 THEN [-1] WHEN 3 THEN [0, 1, 2] ELSE [0] END) AS ordinal, unnest(CASE c_custkey % 6 WHEN 0 THEN [NULL] WHEN 1 THEN [NULL] WHEN 2 THEN [NULL] WHEN 3 THEN ['{\"n\":' || CAST(c_nationkey AS VARCHAR) || '}', NULL, '{}'] ELSE ['{\"n\":\"' || c_name || '\"}'] END) AS item,"
    " unnest(CASE c_custkey % 6 WHEN 0 THEN ['no JSON'] WHEN 1 THEN ['no object'] WHEN 2 THEN ['no list'] WHEN 3 THEN [NULL, 'no object', NULL] ELSE [NULL] END) AS note FROM customer WHERE c_custkey % 6 <> 5",
)
def s20(spark, sf):
    """Customers as files in every state: cut off, a list, a key that is no list, items of which one is no object, one item, no key."""
    k = F.col("c_custkey") % 6
    value = (
        F.when(k == 0, _text('{"items": [', _s("c_nationkey")))
        .when(k == 1, _text("[", _s("c_nationkey"), "]"))
        .when(k == 2, F.when(F.col("c_custkey") % 12 == 2, '{"items": null}').otherwise('{"items": {"a": 1}}'))
        .when(k == 3, _text('{"items": [{"n": ', _s("c_nationkey"), "}, 7, {}]}"))
        .when(k == 4, _text('{"other": 1, "items": [{"n": "', F.col("c_name"), '"}]}'))
        .otherwise('{"other": []}')
    )
    return A.object_items(table(spark, sf, "customer").select(_s("c_custkey").alias("path"), value.alias("value")), "items")


@query(
    "p01_row_keys",
    f"WITH {UNITS}, {UNIT_BAG}, m AS (SELECT unnest(['fn', 'pkgfn', 'unit']) AS mode, unnest([CAST(entry AS VARCHAR) || '/' || CAST(fn AS VARCHAR), CAST(entry AS VARCHAR) || '/' || CAST(fn AS VARCHAR) || '/' || CAST(fn % 3 + hash AS VARCHAR), CAST(entry AS VARCHAR) || '/' || CAST(fn AS VARCHAR) || '/' || CAST(fn % 3 + hash AS VARCHAR) || '/' || CASE WHEN iu THEN 'none' ELSE CAST(hash AS VARCHAR) END]) AS k FROM bag WHERE arm = 'pre'),"
    " n AS (SELECT mode, k, count(*) AS n FROM m GROUP BY ALL) SELECT mode, count(*) AS keys, max(n) AS most FROM n GROUP BY mode",
)
def p01(spark, sf):
    """Keys of each mode over the report rows, some without a hash, and the rows of the most frequent key."""
    rows = unit_bag(spark, sf)[0].withColumn("package", F.col("fn") % 3 + F.col("hash")).withColumn("hash", F.when(~F.col("interface_union"), F.col("hash")))
    out = None
    for mode in B.ROW_KEYS:
        one = B.bag_index(rows, B.row_key(mode), []).agg(F.count("*").alias("keys"), F.max("n").alias("most")).select(F.lit(mode).alias("mode"), "keys", "most")
        out = one if out is None else out.unionByName(one)
    return out


POLICIES = ("deny Exec", "deny Net ASIA", "pure EUROPE\ndeny Fs NOWHERE", "deny", "forbid a b", "# nothing", "deny Db,Fs NOWHERE")


@query("r08_exit_codes", f"WITH {NAMED} SELECT unnest(range(7))::INT AS policy, unnest([0, (SELECT max(CASE WHEN effect = 'Net' AND starts_with(fn, 'ASIA') THEN 1 ELSE 0 END) FROM named), (SELECT max(CASE WHEN effect IS NOT NULL AND starts_with(fn, 'EUROPE') THEN 1 ELSE 0 END) FROM named), 2, 2, 0, 0])::INT AS code")
def r08(spark, sf):
    """The exit code of whole policies over all customers: a policy that cannot be read never passes."""
    u = named_customers(spark, sf).select("fn", F.when(F.col("effect").isNull(), _none()).otherwise(F.array("effect")).alias("inferred"))
    return spark.createDataFrame([(i, P.gate(u, text)) for i, text in enumerate(POLICIES)], "policy int, code int")


@query(
    "p21_stale_reports",
    "WITH r AS (SELECT user_id, arg_min(ts, CAST(event_id AS VARCHAR)) AS t FROM events WHERE event_type = 'signup' GROUP BY 1), s AS (SELECT user_id, max(ts) AS t FROM events WHERE event_type IN ('view', 'error') GROUP BY 1) SELECT r.user_id, CASE WHEN s.t IS NULL THEN 'no source' WHEN s.t > r.t THEN 'stale' ELSE 'fresh' END AS state FROM r LEFT JOIN s USING (user_id)",
)
def p21_files(spark, sf):
    """Events as files of their user's folder: reports, sources, sources in folders that do not count, documents."""
    file = lambda folder, suffix: _text(folder, _s("event_id"), suffix)
    kind = F.col("event_type")
    name = F.when(kind == "signup", file(".home/report.", ".json")).when(kind == "view", file("src/", ".rs")).when(kind == "click", file("node_modules/", ".js")).when(kind == "purchase", file("doc/", ".md")).otherwise(file("lib/a/", ".kt"))
    files = table(spark, sf, "events").select(_text("/w/", _s("user_id"), "/", name).alias("path"), F.col("ts").alias("modified"))
    return A.stale_reports(files, ".home").select(F.regexp_extract("root", r"(\d+)$", 1).cast("long").alias("user_id"), "state")


@query("k01_detail_lines", "SELECT l_returnflag AS flag, l_suppkey AS supplier, count(*) AS n FROM lineitem GROUP BY ALL")
def k01(spark, sf):
    """Details written in the order of their keys and read back."""
    n = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n"))
    path = _folder(spark, "details")
    sinks.write_details(n, ["flag", "supplier"], path)
    return spark.read.schema(n.schema).json(path)


@query(
    "k03_flip_files",
    f"WITH {UNITS}, j AS (SELECT entry, fn, coalesce(a.inferred, []) AS p, coalesce(b.inferred, []) AS q FROM a FULL JOIN b USING (entry, fn)) SELECT '0->1' AS kind, CAST(entry AS VARCHAR) AS entry, CAST(fn AS VARCHAR) AS fn, unnest(list_filter(q, lambda e: NOT list_contains(p, e))) AS effect FROM j UNION ALL SELECT '1->0', CAST(entry AS VARCHAR), CAST(fn AS VARCHAR), unnest(list_filter(p, lambda e: NOT list_contains(q, e))) FROM j"
    " UNION ALL SELECT 'keyloss', CAST(entry AS VARCHAR), CAST(fn AS VARCHAR), array_to_string(p, ',') FROM j WHERE len(q) = 0",
)
def k03(spark, sf):
    """All flips and all keys that are gone, written as two tables with tabs and read back."""
    pre, post = arms(spark, sf)
    changes = B.set_changes(pre, post, ["entry", "fn"], "inferred")
    flips = changes.select(F.explode(F.create_map(F.lit("0->1"), "gained", F.lit("1->0"), "lost")).alias("kind", "e"), "entry", "fn").select("kind", "entry", "fn", F.explode("e").alias("effect"))
    gone = pre.join(post, ["entry", "fn"], "left_anti").select("entry", "fn", F.array_join("inferred", ",").alias("lost"))
    path = _folder(spark, "flips")
    sinks.write_flips(flips, gone, path)
    read = A.tab_fields(spark.read.text(path), ["kind", "entry", "fn", "effect"], 4)
    return read.unionByName(A.tab_fields(spark.read.text(path + ".keyloss"), ["entry", "fn", "effect"], 3).withColumn("kind", F.lit("keyloss")))


@query("k05_sweep_table", "SELECT p_name AS jar, p_brand AS policy, coalesce(sum(CASE WHEN p_size > 5 THEN p_size END), -1)::INT AS n, CASE WHEN max(p_size) > 5 THEN 'measured' ELSE 'NA' END AS state FROM part GROUP BY ALL")
def k05(spark, sf):
    """A sweep written with NA for what could not be measured, and read back as null, not zero."""
    rows = table(spark, sf, "part").groupBy(F.col("p_name").alias("jar"), F.col("p_brand").alias("policy")).agg(F.sum(F.when(F.col("p_size") > 5, F.col("p_size"))).alias("violations"))
    path = _folder(spark, "sweep")
    sinks.write_tabs(rows, path)
    return A.sweep(spark.read.text(path)).withColumn("n", F.coalesce("n", F.lit(-1)))


@query("k04_finding_results", "SELECT c_nationkey, c_name AS text, 'AS-EFF-00' || CAST(c_custkey % 3 + 6 AS VARCHAR) AS rule, CASE WHEN c_custkey % 3 = 1 THEN 'warning' ELSE 'error' END AS level, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name || '.rs' END AS uri, CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE c_custkey + 1 END AS line FROM customer WHERE c_acctbal < 0")
def k04(spark, sf):
    """Findings documents, taken apart again into their results."""
    k = F.col("c_custkey")
    rule = _text("AS-EFF-00", (k % 3 + 6).cast("string"))
    loc = F.when(k % 4 != 0, _text(F.col("c_name"), ".rs:", (k + 1).cast("string"), ":2"))
    found = table(spark, sf, "customer").filter("c_acctbal < 0").select("c_nationkey", rule.alias("rule"), F.col("c_name").alias("fn"), loc.alias("loc"), F.col("c_name").alias("message"), sinks.level_of(rule).alias("level"))
    result = "struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:bigint>>>>>"
    docs = sinks.findings_document(found, "c_nationkey").withColumn("d", F.from_json("document", f"struct<version:string,runs:array<struct<results:array<{result}>>>>")).filter("d.version = '2.1.0'")
    rows = docs.select("c_nationkey", F.explode(F.col("d.runs")[0]["results"]).alias("r"))
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    return rows.select("c_nationkey", F.col("r.message.text").alias("text"), F.col("r.ruleId").alias("rule"), "r.level", F.coalesce(place["artifactLocation"]["uri"], F.lit("")).alias("uri"), F.coalesce(place["region"]["startLine"], F.lit(0)).alias("line"))


def _turns(spark, sf):
    """Events as turns of their user's session; an error is a blocked one."""
    blocked = F.col("event_type") == "error"
    return table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), _s("user_id").alias("sessionId"), F.when(blocked, "blocked").otherwise("clean").alias("verdict"), F.when(blocked, F.array(_text("v", (F.col("event_id") % 3).cast("string")))).otherwise(_none()).alias("violations"), F.col("event_id").alias("blastRadius"))


@query("t01_activity_log", "SELECT event_id, CAST(user_id AS VARCHAR) AS session, CASE WHEN event_type = 'error' THEN 'blocked' ELSE 'clean' END AS verdict, 1::BIGINT AS logged FROM events")
def t01(spark, sf):
    """Turns appended in two steps and logged as a stream after each; a third run finds nothing new, so that no turn is logged twice."""
    turns, path, log, state = _turns(spark, sf), _folder(spark, "turns"), _folder(spark, "log"), _folder(spark, "state")
    for half in (0, 1):
        sinks.append_activity(turns.filter(F.col("blastRadius") % 2 == half), path)
        T.append_turns(spark, path, state, log)
    T.append_turns(spark, path, state, log)
    rows = spark.read.parquet(log)
    return rows.groupBy(F.col("blastRadius").alias("event_id"), F.col("sessionId").alias("session"), "verdict").agg(F.count("*").alias("logged"))


@query("t02_retention", "SELECT CAST(user_id AS VARCHAR) AS session, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n <= 20")
def t02(spark, sf):
    """An appended log cut to the newest turns of each session."""
    path = _folder(spark, "log")
    sinks.append_activity(_turns(spark, sf).select("ts", "sessionId", "blastRadius"), path)
    log = reports.read_activity(spark, path).select("ts", "sessionId", "blastRadius")
    return T.compacted(log, 20).select(F.col("sessionId").alias("session"), F.col("blastRadius").alias("event_id"))


@query("t05_blocked_sessions", "WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_type = 'error', event_id % 3)) AS e, arg_max(event_id % 3, (ts, event_type = 'error', event_id % 3)) AS v FROM events GROUP BY 1) SELECT CAST(user_id AS VARCHAR) AS session, 'v' || CAST(v AS VARCHAR) AS violations FROM l WHERE e = 'error'")
def t05(spark, sf):
    """The sessions whose last turn is blocked, as keyed state of a stream over the log; no turn is too late."""
    path, state = _folder(spark, "turns"), _folder(spark, "state")
    sinks.append_activity(_turns(spark, sf), path)
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    BL.use_rocksdb(spark)
    try:
        changes = BL.blocked_changes(T.activity_stream(spark, path), "36500 days", 24 * 36500)
        T.run_available(changes, state, lambda batch, _: batch.write.format("noop").mode("overwrite").save(), "update")
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)
    return BL.blocked_now(spark, state).select(F.col("sessionId").alias("session"), F.array_join("violations", ",").alias("violations"))


@query(
    "t08_digest",
    "WITH e AS (SELECT strftime(ts, '%Y-%m') AS month, user_id, event_id, event_type = 'error' AS held FROM events), c AS (SELECT month, 'v' || CAST(event_id % 3 AS VARCHAR) AS code, count(*) AS n FROM e WHERE held GROUP BY ALL) SELECT month, count(*) AS checked, count(*) FILTER (WHERE held) AS held, count(DISTINCT user_id) AS sessions, max(event_id) AS largest_blast, count(*) FILTER (WHERE NOT held) AS quiet, coalesce((SELECT string_agg(code || ':' || CAST(n AS VARCHAR), ',' ORDER BY code) FROM c WHERE c.month = e.month), '') AS codes FROM e GROUP BY month",
)
def t08(spark, sf):
    path = _folder(spark, "turns")
    sinks.append_activity(_turns(spark, sf), path)
    digest = T.monthly_digest(reports.read_activity(spark, path))
    codes = F.array_join(F.transform("codes", lambda c: F.concat(c["code"], F.lit(":"), c["n"].cast("string"))), ",")
    return digest.withColumn("codes", F.coalesce(codes, F.lit("")))
