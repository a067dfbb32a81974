"""Rows of unknown fields, workflow files, transcripts, annotations, change logs and the verified store, made from the tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import fields as V
from ..operators import verbs as B
from ..operators.bags import diff_counters, key_diff
from ..operators.graph import shared_folder
from ..sources import annotations as AN
from ..sources import sinks
from ..sources import changelog as CL
from ..sources import store as ST
from ..sources import transcripts as TR
from ..sources import workflows as WF
from .registry import query
from .views import DIRECT, NAMED, UNIT_BAG, UNITS, direct, named_customers, table, unit_bag


def _variants(spark, sf):
    """Report rows as JSON, of which nobody says what fields they have; some fields are absent where they are empty."""
    full = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    row = F.to_json(F.struct(F.col("fn").cast("string").alias("fn"), "hash", full("inferred"), F.when(F.col("interface_union"), True).alias("interface_union"), full("invisible"), full("dispatches_on")))
    return tuple(a.select("entry", "fn", F.parse_json(row).alias("row")) for a in unit_bag(spark, sf))


@query(
    "a09_wide_losses",
    f"WITH {UNITS}, {UNIT_BAG}, x AS (SELECT arm, entry, fn, 'hash' AS field, CAST(hash AS VARCHAR) AS element FROM bag UNION ALL SELECT arm, entry, fn, 'inferred', unnest(inferred) FROM bag UNION ALL SELECT arm, entry, fn, 'interface_union', 'true' FROM bag WHERE iu"
    " UNION ALL SELECT arm, entry, fn, 'invisible', unnest(inv) FROM bag UNION ALL SELECT arm, entry, fn, 'dispatches_on', unnest(dis) FROM bag), c AS (SELECT entry, fn, field, element, count(*) FILTER (WHERE arm = 'pre') - count(*) FILTER (WHERE arm = 'post') AS gone FROM x GROUP BY ALL HAVING gone > 0),"
    " k AS (SELECT entry, fn, field, sum(gone) AS gone FROM c GROUP BY ALL) SELECT field, count(*) AS keys, sum(gone)::BIGINT AS elements FROM k GROUP BY field",
)
def a09_wide(spark, sf):
    return V.field_losses(*_variants(spark, sf), ["entry", "fn"])


@query(
    "p02_wide_values",
    f"WITH {UNITS}, {UNIT_BAG}, n AS (SELECT entry, fn, hash, inferred, iu, inv, dis, count(*) FILTER (WHERE arm = 'pre') AS p, count(*) FILTER (WHERE arm = 'post') AS q FROM bag GROUP BY ALL),"
    " k AS (SELECT entry, fn, sum(p) AS p, sum(q) AS q, bool_or(p <> q) AS differs FROM n GROUP BY ALL) SELECT count(*) FILTER (WHERE p > 0 AND q > 0 AND differs) AS changed, count(*) FILTER (WHERE q = 0) AS removed, count(*) FILTER (WHERE p = 0) AS added FROM k",
)
def p02(spark, sf):
    pre, post = (a.withColumn("value", V.wide_value(F.col("row"))) for a in _variants(spark, sf))
    return diff_counters(key_diff(pre, post, ["entry", "fn"], ["value"])).select(F.col("changed_keys").alias("changed"), F.col("removed_keys").alias("removed"), F.col("added_keys").alias("added"))


@query("f01_canonical_variant", "SELECT event_id, '{\"a\":{\"k\":' || json_extract_string(props, '$.k') || ',\"z\":null},\"b\":[\"' || event_type || '\",' || CAST(user_id AS VARCHAR) || ']}' AS text FROM events")
def f01_variant(spark, sf):
    raw = F.concat(F.lit('{ "b" : ["'), "event_type", F.lit('", '), F.col("user_id").cast("string"), F.lit('],\n "a": {"z":null, "k": '), F.get_json_object("props", "$.k"), F.lit("} }"))
    return table(spark, sf, "events").select("event_id", V.canonical(raw).alias("text"))


def _flows(spark, sf):
    """A workflow file for each part: triggers, a job's system and conditions by its columns."""
    k = F.col("p_partkey")
    pick = lambda n, *texts: F.element_at(F.array(*[F.lit(t) for t in texts]), (k % n + 1).cast("int"))
    on = pick(4, '{"push":{"paths":["src/**"]}}', '["pull_request"]', '"schedule"', '{"push":null,"release":null}')
    runs = pick(3, "ubuntu-latest", "windows-2022", "macos-14")
    cond = pick(5, "null", '"github.event_name == \'push\'"', '"github.event_name != \'push\'"', '"needs.x"', '"github.event_name == \'push\' || needs.x"')
    steps = F.concat(F.lit('[{"uses":"actions/setup-java@v4"},{"run":"make '), F.col("p_name"), F.lit('"},{"run":"x","if":"false"},{"run":"echo ${{ secrets.KEY }}"},{"name":"nothing"}]'))
    text = F.concat(F.lit('{"name":"w'), k.cast("string"), F.lit('","on":'), on, F.lit(',"jobs":{"j":{"runs-on":"'), runs, F.lit('","if":'), cond, F.lit(',"steps":'), steps, F.lit("}}}"))
    return table(spark, sf, "part").select(F.concat(F.lit("/ci/"), k.cast("string"), F.lit(".yml")).alias("path"), F.when(k % 50 == 49, "{").otherwise(text).alias("value"))


@query(
    "p17_workflow_steps",
    "WITH f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 4 = 2 THEN 'trigger' WHEN p_partkey % 5 = 2 THEN 'false' WHEN p_partkey % 5 = 3 THEN 'open' WHEN p_partkey % 3 = 1 THEN 'windows' END AS skip FROM part WHERE p_partkey % 50 <> 49)"
    " SELECT k, unnest([0, 1, 2, 3, 4]) AS ordinal, unnest(['PROVISION', CASE WHEN skip IS NULL THEN 'RUN' ELSE 'SKIP' END, 'SKIP', 'SKIP', 'SKIP']) AS status, unnest(['java', '', '', '', '']) AS tool FROM f UNION ALL SELECT p_partkey, 0, 'SKIP', '' FROM part WHERE p_partkey % 50 = 49",
)
def p17(spark, sf):
    rows = WF.workflow_steps(_flows(spark, sf))
    return rows.select(F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("k"), "ordinal", "status", F.coalesce("tool", F.lit("")).alias("tool"))


@query("s25_triggers", "SELECT CASE WHEN p_partkey % 50 = 49 THEN CAST(p_partkey AS VARCHAR) || '.yml' ELSE 'w' || CAST(p_partkey AS VARCHAR) END AS name, p_partkey % 50 <> 49 AS parsed, p_partkey % 50 <> 49 AND p_partkey % 4 IN (0, 3) AS has_push, CASE WHEN p_partkey % 50 <> 49 AND p_partkey % 4 = 0 THEN 'src/**' ELSE '' END AS paths FROM part")
def s25(spark, sf):
    return WF.workflow_triggers(_flows(spark, sf)).select("name", "parsed", "has_push", F.array_join("paths", ",").alias("paths"))


@query(
    "s21_turn_edits",
    "WITH b AS (SELECT conv_id, max(turn) FILTER (WHERE role = 'user') AS b FROM conversations GROUP BY 1) SELECT CAST(b.conv_id AS VARCHAR) AS path, CASE WHEN b.b IS NULL THEN NULL ELSE coalesce((SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT DISTINCT 'f' || CAST(turn % 3 AS VARCHAR) AS x FROM conversations c WHERE c.conv_id = b.conv_id AND turn > b.b AND role = 'assistant')), '') END AS edited FROM b",
)
def s21(spark, sf):
    """Conversations as sessions in which every answer edits a file."""
    used = F.array(F.struct(F.lit("tool_use").alias("type"), F.lit("Edit").alias("name"), F.struct(F.concat(F.lit("f"), (F.col("turn") % 3).cast("string")).alias("file_path")).alias("input")))
    told = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.coalesce("text", F.lit("")).alias("content")).alias("message")))
    body = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.col("role").alias("type"), F.struct(used.alias("content")).alias("message")))).otherwise(told)
    lines = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("path"), F.col("turn").cast("long").alias("line"), body.alias("body"))
    return TR.turn_edits(lines).select("path", F.array_join("edited", ",").alias("edited"))


@query(
    "s24_annotations",
    "SELECT CAST(p_partkey // 25 AS VARCHAR) AS path, 'lib.' || lower(p_brand) AS package, p_name AS name, CASE p_partkey % 4 WHEN 0 THEN 'value' WHEN 1 THEN 'anyOf' WHEN 2 THEN 'allOf' ELSE '' END AS kind, CASE p_partkey % 4 WHEN 0 THEN 'p.A' WHEN 3 THEN '' ELSE 'p.A,p.S' || CAST(p_size AS VARCHAR) END AS permissions, p_partkey % 4 = 3 OR p_partkey % 6 = 0 AS conditional FROM part",
)
def s24(spark, sf):
    """Parts as annotated members, in an annotation file for each brand and 25 parts."""
    k = F.col("p_partkey")
    val = lambda n, v: F.concat(F.lit('<val name="'), F.lit(n), F.lit('" val="'), v, F.lit('"/>'))
    two = F.concat(F.lit("{&quot;p.A&quot;, &quot;p.S"), F.col("p_size").cast("string"), F.lit("&quot;}"))
    form = F.when(k % 4 == 0, val("value", F.lit("&quot;p.A&quot;"))).when(k % 4 == 1, val("anyOf", two)).when(k % 4 == 2, val("allOf", two)).otherwise("")
    item = F.concat(F.lit('<item name="'), F.col("p_name"), F.lit('"><annotation name="x.RequiresPermission">'), form, F.when((k % 4 == 3) | (k % 6 == 0), val("conditional", F.lit("true"))).otherwise(""), F.lit("</annotation></item>"))
    files = table(spark, sf, "part").select(F.expr("CAST(p_partkey div 25 AS STRING)").alias("path"), F.concat(F.lit("lib/"), F.lower("p_brand"), F.lit("/annotations.xml")).alias("member"), item.alias("i"))
    texts = files.groupBy("path", "member").agg(F.concat(F.lit("<root>"), F.array_join(F.array_sort(F.collect_list("i")), ""), F.lit("</root>")).alias("text"))  # 25 parts at most
    return AN.annotation_items(texts).select("path", "package", "name", F.coalesce("kind", F.lit("")).alias("kind"), F.array_join("permissions", ",").alias("permissions"), "conditional")


@query(
    "s26_newest_section",
    "SELECT CAST(l_orderkey AS VARCHAR) AS path, '## [' || CAST(min(l_linenumber) AS VARCHAR) || '.0] ' || arg_min(l_returnflag, l_linenumber) AS heading, '- ' || CAST(arg_min(l_partkey, l_linenumber) AS VARCHAR) AS body FROM (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_partkey) AS l_partkey FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) GROUP BY 1",
)
def s26(spark, sf):
    """Orders as change logs with a section for each line item; open ones are unreleased."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_linestatus").agg(F.min("l_returnflag").alias("f"), F.min("l_partkey").alias("p"))
    number = F.col("l_linenumber").cast("string")
    text = F.when(F.col("l_linestatus") == "F", F.concat(F.lit("## ["), number, F.lit(".0] "), "f", F.lit("\n- "), F.col("p").cast("string"))).otherwise(F.concat(F.lit("## [Unreleased]\n- "), F.col("p").cast("string")))
    logs = li.groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.concat(F.lit("# Log\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", text.alias("t")))), lambda x: x["t"]), "\n")).alias("value"))  # the items of an order
    return CL.newest_published(CL.sections(CL.lines_of(logs))).select("path", "heading", "body")


@query(
    "t09_verified_store",
    "SELECT CAST(c_custkey AS VARCHAR) AS entry, CASE WHEN c_custkey % 7 = 0 THEN 'no store' WHEN c_custkey % 7 = 1 OR c_custkey % 10 = 0 THEN 'never filled' WHEN c_custkey % 7 = 2 THEN 'other content' WHEN c_custkey % 7 = 3 THEN 'other engine' WHEN c_custkey % 7 = 4 THEN 'other command' ELSE 'hit' END AS state, CASE WHEN c_custkey % 7 IN (5, 6) AND c_custkey % 10 <> 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'hit' ELSE 'not stored' END ELSE '' END AS graph FROM customer",
)
def t09(spark, sf):
    """Customers as measured libraries: published with a manifest, and looked up with what has changed since. Every tenth report is empty and refused."""
    k = F.col("c_custkey")
    one = lambda when, then, other: F.when(when, F.lit(then)).otherwise(F.lit(other))
    base = table(spark, sf, "customer").select(k.alias("c_custkey"), F.lit("1").alias("version"), one(k % 7 == 0, "old", "e").alias("engine"), F.when(k % 7 == 1, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string")).alias("entry"), F.sha2("c_name", 256).alias("entry_sha"), F.array(F.lit("h1"), F.lit("h2")).alias("engine_sha"), F.array(F.lit("scan"), F.lit("--all")).alias("command"), "c_name", "c_mktsegment")
    report = F.when(k % 10 == 0, "").otherwise(F.to_json(F.struct(F.struct("version").alias("head"), F.col("c_mktsegment").alias("fns"))))
    graph = F.when(k % 2 == 0, F.to_json(F.create_map("c_name", F.array("c_mktsegment"))))
    root = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    ST.publish(base.withColumn("report", report).withColumn("call_graph", graph).drop("c_custkey", "c_name", "c_mktsegment"), root)
    wanted = base.select(
        "version",
        F.when(k % 7 == 0, "new").otherwise(F.col("engine")).alias("engine"),
        k.cast("string").alias("entry"),
        F.when(k % 7 == 2, "changed").otherwise(F.col("entry_sha")).alias("entry_sha"),
        F.when(k % 7 == 3, F.array(F.lit("h3"))).otherwise(F.array(F.lit("h2"), F.lit("h1"))).alias("engine_sha"),
        F.when(k % 7 == 4, F.array(F.lit("scan"))).otherwise(F.col("command")).alias("command"),
    )
    return ST.lookup(wanted, root).select("entry", "state", F.coalesce("graph", F.lit("")).alias("graph"))


@query("r18_show", f"WITH {NAMED} SELECT x.fn, coalesce(n.effect, '') AS effect, n.c_custkey IS NOT NULL AS known FROM (SELECT DISTINCT fn FROM named WHERE c_acctbal < 0 UNION SELECT 'none.' || CAST(p_partkey AS VARCHAR) FROM part WHERE p_size = 7) x LEFT JOIN named n ON n.fn = x.fn")
def r18_show(spark, sf):
    """The records of customers in debt, and of names that no record has."""
    n = named_customers(spark, sf).withColumn("known", F.lit(True))
    asked = n.filter("c_acctbal < 0").select("fn").unionByName(table(spark, sf, "part").filter("p_size = 7").select(F.concat(F.lit("none."), F.col("p_partkey").cast("string")).alias("fn")))
    return B.show(n, asked).select("fn", F.coalesce("effect", F.lit("")).alias("effect"), F.coalesce("known", F.lit(False)).alias("known"))


@query("r18_permission_keys", f"WITH {DIRECT}, k AS (SELECT unnest(['Net', 'Db', 'Fs', 'Log', 'Unknown']) AS effect, unnest(['NATION_1', 'NATION_99', 'NATION_2', 'NATION_3', NULL]) AS key), s AS (SELECT key, effect, effect IN (SELECT effect FROM direct) AS r, key IN (SELECT n_name FROM nation) AS d FROM k) SELECT coalesce(key, '') AS key, effect, CASE WHEN key IS NULL THEN 'no key needed' WHEN r AND d THEN 'ok' WHEN r THEN 'under' ELSE 'over' END AS status FROM s WHERE r OR d")
def r18_keys(spark, sf):
    """Effects of customers against the names of nations as declared keys."""
    keys = spark.createDataFrame([("Net", "NATION_1"), ("Db", "NATION_99"), ("Fs", "NATION_2"), ("Log", "NATION_3"), ("Unknown", None)], "effect string, key string")
    return B.permission_keys(direct(spark, sf), keys, table(spark, sf, "nation").select(F.col("n_name").alias("key"))).withColumn("key", F.coalesce("key", F.lit("")))


@query("r19_answered", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'yes' WHEN 1 THEN CASE WHEN p_size % 4 = 2 THEN 'no' ELSE 'yes' END WHEN 2 THEN CASE WHEN p_size % 4 IN (0, 2) THEN 'no' ELSE 'yes' END WHEN 3 THEN CASE WHEN p_size % 4 IN (1, 2) THEN 'no' ELSE 'yes' END WHEN 4 THEN CASE WHEN p_size % 4 = 2 THEN 'yes' ELSE 'no' END ELSE 'unknown verb' END AS answer FROM part")
def r19(spark, sf):
    pick = lambda c, n, *v: F.element_at(F.array(*[F.lit(x) for x in v]), (F.col(c) % n + 1).cast("int"))
    asked = table(spark, sf, "part").select("p_partkey", pick("p_partkey", 6, "gate", "show", "rewire", "agents", "privacy-manifest", "dance").alias("verb"), pick("p_size", 4, "JS", "jvm", "Swift", "Executable").alias("backend"))
    return B.answered(asked).select("p_partkey", "answer")


@query(
    "k10_audit_documents",
    "WITH r AS (SELECT c_nationkey AS entry, array_to_string(list_sort(list('{\"root\":\"' || c_name || '\",\"verdict\":\"' || CASE WHEN c_acctbal < -500 THEN 'FLAG' ELSE 'OK' END || '\"}')), ',') AS t FROM customer WHERE c_acctbal < 0 GROUP BY 1), l AS (SELECT s_nationkey AS entry, array_to_string(list_sort(list('{\"leaf\":\"' || s_name || '\"}')), ',') AS t FROM supplier GROUP BY 1)"
    " SELECT coalesce(r.entry, l.entry) AS entry, '{\"roots\":[' || coalesce(r.t, '') || '],\"leaves\":[' || coalesce(l.t, '') || ']}' AS document FROM r FULL JOIN l ON r.entry = l.entry",
)
def k10(spark, sf):
    roots = table(spark, sf, "customer").filter("c_acctbal < 0").select(F.col("c_nationkey").alias("entry"), F.col("c_name").alias("root"), F.when(F.col("c_acctbal") < -500, "FLAG").otherwise("OK").alias("verdict"))
    leaves = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("entry"), F.col("s_name").alias("leaf"))
    return sinks.audit_documents(roots, leaves, "entry")
