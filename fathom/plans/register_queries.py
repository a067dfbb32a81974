"""Report rows, libraries, findings and workflows, on customers, parts, pages and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audits as X
from ..operators import consistency as O
from ..operators import effects as E
from ..operators import graph as G
from ..operators import ordering as W
from ..operators import policy as P
from ..operators import registers as R
from ..operators import structure as T
from ..sources import reports, sinks
from .registry import query
from .views import BAGS, DIRECT, EDGES, NAMED, UNIT_BAG, UNITS, bags, direct, edges, named_customers, table, unit_bag, unit_rows, units

EMPTY = "array<string>"


def _none():
    return F.array().cast(EMPTY)


@query("p07_valid_units", f"WITH {UNITS}, {UNIT_BAG} SELECT arm, entry, count(*) AS n FROM bag WHERE len(inferred) > 0 AND fn % 5 <> 0 GROUP BY ALL")
def p07(spark, sf):
    pre, post = unit_bag(spark, sf)
    rows = pre.withColumn("arm", F.lit("pre")).unionByName(post.withColumn("arm", F.lit("post"))).withColumn("fn", F.when(F.col("fn") % 5 != 0, F.col("fn")))
    return R.valid_units(rows).groupBy("arm", "entry").agg(F.count("*").alias("n"))


@query("p09_gate_visible", f"WITH {UNITS}, {UNIT_BAG} SELECT entry, count(*) AS n FROM bag WHERE arm = 'post' AND NOT iu GROUP BY 1")
def p09(spark, sf):
    return R.gate_visible(unit_bag(spark, sf)[1]).groupBy("entry").agg(F.count("*").alias("n"))


@query("p10_foreign_rows", f"WITH {UNITS}, {UNIT_BAG} SELECT entry, count(*) FILTER (WHERE hash = 1) AS foreign FROM bag WHERE arm = 'post' AND NOT iu GROUP BY 1")
def p10(spark, sf):
    rows = unit_bag(spark, sf)[1].withColumn("hash", F.concat(F.when(F.col("hash") == 1, "lib").otherwise("own"), F.lit("#"), F.col("fn").cast("string"))).withColumn("package", F.lit("own"))
    return R.own_rows(rows, "entry")[1]


@query("p10_own_rows", f"WITH {UNITS}, {UNIT_BAG} SELECT entry, fn, count(*) AS n FROM bag WHERE arm = 'post' AND NOT iu AND hash <> 1 GROUP BY ALL")
def p10_own(spark, sf):
    rows = unit_bag(spark, sf)[1].withColumn("hash", F.concat(F.when(F.col("hash") == 1, "lib").otherwise("own"), F.lit("#"), F.col("fn").cast("string"))).withColumn("package", F.lit("own"))
    return R.own_rows(rows, "entry")[0].groupBy("entry", "fn").agg(F.count("*").alias("n"))


HINTS = ["Net", "net", "FS", "Clipboard", "clipBoard", "Netlify", "exec", "Unknown"]


@query("p11_effect_hint", f"SELECT p_partkey, ({HINTS!r})[p_partkey % 8 + 1] AS name, ([NULL, 'Net', 'Fs', NULL, 'Clipboard', NULL, 'Exec', NULL])[p_partkey % 8 + 1] AS hint FROM part")
def p11(spark, sf):
    name = F.element_at(F.array(*[F.lit(h) for h in HINTS]), (F.col("p_partkey") % 8 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", name.alias("name"), R.effect_hint(name).alias("hint"))


@query("p18_levels", "SELECT p_partkey, CASE WHEN p_size % 11 + 1 = 7 THEN 'warning' ELSE 'error' END AS level FROM part")
def p18(spark, sf):
    code = F.concat(F.lit("AS-EFF-"), F.lpad((F.col("p_size") % 11 + 1).cast("string"), 3, "0"))
    return table(spark, sf, "part").select("p_partkey", sinks.level_of(code).alias("level"))


@query("r13_rule_catalogue", "SELECT p_partkey, code, name, CASE code WHEN 'AS-EFF-007' THEN 'warning' ELSE 'error' END AS level FROM (SELECT p_partkey, CASE WHEN p_size % 13 < 11 THEN 'AS-EFF-' || lpad(CAST(p_size % 13 + 1 AS VARCHAR), 3, '0') ELSE 'OTHER' END AS code, CASE WHEN p_size % 13 < 11 THEN (['UndeclaredEffect', 'UnusedCapability', 'UnresolvedCalls', 'AmbientAuthority', 'BaselineEffectGained', 'EffectBoundaryCrossed', 'InjectionRisk', 'EffectHostNotAllowlisted', 'ForbiddenEffectFlow', 'ContainmentBreached', 'PermissionScopeExceeded'])[p_size % 13 + 1] ELSE 'OTHER' END AS name FROM part)")
def r13(spark, sf):
    n = F.col("p_size") % 13
    code = F.when(n < 11, F.concat(F.lit("AS-EFF-"), F.lpad((n + 1).cast("string"), 3, "0"))).otherwise("OTHER")
    return R.with_rule(table(spark, sf, "part").select("p_partkey", code.alias("code")), R.rule_catalogue(spark))


LIBS = "lib AS (SELECT DISTINCT layer AS entry, region || '.' || layer AS name FROM (SELECT layer, replace(region, ' ', '_') AS region FROM named WHERE c_acctbal < -800)), unc AS (SELECT layer AS entry, CASE WHEN c_custkey % 2 = 0 THEN 'pre' ELSE 'post' END AS arm, fn AS name FROM named WHERE c_acctbal > 9900)"


@query("j07_live_entries", f"WITH {NAMED}, {LIBS}, hit AS (SELECT DISTINCT u.entry, arm, u.name FROM unc u JOIN lib USING (entry) WHERE u.name = lib.name OR starts_with(u.name, lib.name || '.') OR starts_with(lib.name, u.name || '.')), d AS (SELECT entry, array_to_string(list_sort(list(DISTINCT arm)), ',') AS arms, count(DISTINCT name) AS names FROM hit GROUP BY 1) SELECT e.entry, d.entry IS NULL AS live, coalesce(arms, '') AS arms, coalesce(names, 0) AS names FROM (SELECT DISTINCT layer AS entry FROM named) e LEFT JOIN d USING (entry)")
def j07(spark, sf):
    n = named_customers(spark, sf)
    libs = n.filter("c_acctbal < -800").select(F.col("layer").alias("entry"), F.concat_ws(".", F.replace("region", F.lit(" "), F.lit("_")), "layer").alias("name"))
    uncovered = n.filter("c_acctbal > 9900").select(F.col("layer").alias("entry"), F.when(F.col("c_custkey") % 2 == 0, "pre").otherwise("post").alias("arm"), F.col("fn").alias("name"))
    return R.live_entries(n.select(F.col("layer").alias("entry")), R.uncovered_libraries(uncovered, libs))


@query("j10_policy_sweep", f"WITH {UNITS}, {UNIT_BAG}, r AS (SELECT entry, CASE WHEN k % 3 = 0 THEN ['reflect'] WHEN k % 3 = 1 THEN ['dispatch', 'unresolved'] ELSE []::VARCHAR[] END AS cls FROM unit_row WHERE arm = 'post' AND effect = 'Unknown'), p AS (SELECT unnest(['bare', 'reflect', 'dispatch', 'unresolved', 'reflect_unresolved', 'dispatch_unresolved']) AS policy, unnest([[]::VARCHAR[], ['reflect'], ['dispatch'], ['unresolved'], ['reflect', 'unresolved'], ['dispatch', 'unresolved']]) AS den), e AS (SELECT DISTINCT entry FROM unit_row WHERE arm = 'post'), n AS (SELECT entry, policy, count(*) FILTER (WHERE len(den) = 0 OR len(list_intersect(cls, den)) > 0) AS v FROM r, p GROUP BY ALL) SELECT e.entry, p.policy, coalesce(v, 0) AS violations, CASE WHEN coalesce(v, 0) > 0 THEN 1 ELSE 0 END AS code FROM e CROSS JOIN p LEFT JOIN n ON n.entry = e.entry AND n.policy = p.policy")
def j10(spark, sf):
    k = F.col("k")
    classes = F.when(k % 3 == 0, F.array(F.lit("reflect"))).when(k % 3 == 1, F.array(F.lit("dispatch"), F.lit("unresolved"))).otherwise(_none())
    rows = unit_rows(spark, sf).filter("arm = 'post'").select("entry", "fn", F.array("effect").alias("inferred"), classes.alias("classes"))
    return R.policy_sweep(rows, "entry")


@query("j11_hop_locations", "WITH h AS (SELECT o_orderkey AS id, o_custkey % 50 AS position, 'f' || CAST(o_custkey // 2 AS VARCHAR) AS fn, CASE WHEN o_custkey % 7 = 0 THEN 'own:1' END AS loc FROM orders), u AS (SELECT 'f' || CAST(c_custkey // 2 AS VARCHAR) AS fn, count(*) AS n, min(c_name) AS l FROM customer WHERE c_custkey % 5 <> 0 GROUP BY 1 HAVING count(*) = 1) SELECT id, position, h.fn, coalesce(loc, l) AS loc FROM h LEFT JOIN u ON u.fn = h.fn")
def j11(spark, sf):
    name = lambda c: F.concat(F.lit("f"), F.expr(f"{c} div 2").cast("string"))
    hops = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("position"), name("o_custkey").alias("fn"), F.when(F.col("o_custkey") % 7 == 0, "own:1").alias("loc"))
    return R.hop_locations(hops, table(spark, sf, "customer").filter("c_custkey % 5 <> 0").select(name("c_custkey").alias("fn"), F.col("c_name").alias("loc")))


@query("j14_covered", f"WITH {NAMED} SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS name, CAST(c_custkey AS VARCHAR) IN (SELECT split_part(fn, '.', 4) FROM named WHERE effect IS NOT NULL) AS covered FROM named")
def j14(spark, sf):
    n = named_customers(spark, sf)
    return R.covered_by(n.select(F.col("c_custkey").cast("string").alias("name")), n.filter("effect IS NOT NULL").select(F.col("fn").alias("name")))


@query("j17_runs_at_head", "SELECT coalesce(nullif(CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN '0' ELSE CAST(user_id AS VARCHAR) END, '0'), event_type) AS workflow, count(*) AS runs FROM events WHERE json_extract_string(props, '$.k') = '7' GROUP BY 1")
def j17(spark, sf):
    e = table(spark, sf, "events").withColumn("sha", F.get_json_object("props", "$.k"))
    id_ = F.when(F.col("event_id") % 3 == 1, 0).when(F.col("event_id") % 3 == 2, F.col("user_id"))
    return R.at_head(e, "7").groupBy(R.workflow_key(id_, F.col("event_type")).alias("workflow")).agg(F.count("*").alias("runs"))


LINES = "CASE WHEN page_id % 4 = 0 THEN 'README:' ELSE 'repo/' || CAST(page_id % 200 AS VARCHAR) || CASE WHEN page_id % 3 = 0 THEN '.json:' ELSE '.md:' END END || CAST(page_id AS VARCHAR)"


def _lines(spark, sf):
    n = F.col("page_id")
    path = F.when(n % 4 == 0, "README:").otherwise(F.concat(F.lit("repo/"), (n % 200).cast("string"), F.when(n % 3 == 0, ".json:").otherwise(".md:")))
    return table(spark, sf, "pages").select(F.concat(path, n.cast("string")).alias("line"))


@query("j19_tracked_only", f"SELECT line FROM (SELECT {LINES} AS line FROM pages) WHERE NOT contains(split_part(line, ':', 1), '/') OR split_part(line, ':', 1) IN (SELECT 'repo/' || CAST(p_partkey AS VARCHAR) || '.md' FROM part WHERE p_partkey < 100)")
def j19(spark, sf):
    tracked = table(spark, sf, "part").filter("p_partkey < 100").select(F.concat(F.lit("repo/"), F.col("p_partkey").cast("string"), F.lit(".md")).alias("path"))
    return R.tracked_only(_lines(spark, sf), tracked)


@query("p22_without_reports", f"SELECT line FROM (SELECT {LINES} AS line FROM pages) WHERE split_part(line, ':', 1) NOT IN (SELECT 'repo/' || CAST(p_partkey AS VARCHAR) || '.json' FROM part WHERE p_partkey % 3 = 0)")
def p22(spark, sf):
    n = F.col("p_partkey")
    body = F.when(n % 3 == 0, '{"head":{"spec":"1"}}').when(n % 3 == 1, '{"head":{}}').otherwise("{broken")
    files = table(spark, sf, "part").select(F.concat(F.lit("repo/"), n.cast("string"), F.lit(".json")).alias("path"), body.alias("body"))
    return R.without_reports(_lines(spark, sf), files, "head")


@query("j20_open_rows", "SELECT DISTINCT o_custkey AS id, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0) AS open FROM orders")
def j20(spark, sf):
    register = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") >= 0, "OPEN").otherwise("CLOSED").alias("state"))
    return R.open_rows(table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), register)


@query("a40_recovered", "WITH e AS (SELECT DISTINCT '/a/' || CAST(l_suppkey AS VARCHAR) || '.java' AS file, CAST(l_quantity AS INT) AS number FROM lineitem WHERE l_linenumber = 1) SELECT file, CASE WHEN bool_and(number <= 45) THEN 'drop lines' ELSE 'drop file' END AS action, count(*) AS lines FROM e GROUP BY 1")
def a40(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("file", F.concat(F.lit("/a/"), F.col("l_suppkey").cast("string"), F.lit(".java"))).withColumn("number", F.col("l_quantity").cast("int"))
    error = F.concat("file", F.lit(":"), F.col("number").cast("string"), F.lit(": error: gone"))
    log = li.select(F.when(F.col("l_linenumber") == 1, error).otherwise("note: fine").alias("line"))
    sources = li.filter("number <= 48").select("file", "number", F.when(F.col("number") <= 45, "   try { call(); }").otherwise("class X {").alias("text")).distinct()
    return R.recovered(log, sources)


@query("p16_workflow_required", "SELECT p_partkey AS name, CASE p_partkey % 8 WHEN 0 THEN true WHEN 5 THEN true WHEN 6 THEN true ELSE false END AS required, (['not parsed', 'no push trigger', 'tags only', 'other branch', 'all ignored', 'every push', 'path', 'no path'])[p_partkey % 8 + 1] AS reason FROM part")
def p16(spark, sf):
    kind = F.col("p_partkey") % 8
    only = lambda n, *values: F.when(kind == n, F.array(*[F.lit(v) for v in values])).otherwise(_none())
    flows = table(spark, sf, "part").select(
        F.col("p_partkey").alias("name"),
        (kind != 0).alias("parsed"),
        (kind != 1).alias("has_push"),
        F.when(kind == 6, F.array(F.lit("docs/*"), F.lit("src/**"))).when(kind == 7, F.array(F.lit("src/*.rs"))).otherwise(_none()).alias("paths"),
        only(2, "v*").alias("tags"),
        F.when(kind == 3, F.array(F.lit("release/*"))).when(kind == 5, F.array(F.lit("m*"))).otherwise(_none()).alias("branches"),
        only(4, "src/**").alias("paths_ignore"),
    )
    return R.workflow_required(flows, ["src/a/b.rs", "src/deep/c.rs"], "main")


@query("s15_repeated_entries", "SELECT CAST(o_custkey AS VARCHAR) || '.jar' AS entry, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1 HAVING count(*) > 1")
def s15(spark, sf):
    line = F.when(F.col("o_orderkey") % 3 == 0, "# a comment").otherwise(F.concat(F.lit(" jars/"), (F.col("o_orderkey") % 5).cast("string"), F.lit("/"), F.col("o_custkey").cast("string"), F.lit(".jar/  # kept")))
    return R.repeated_entries(table(spark, sf, "orders").select(line.alias("line")))


@query("s19_recovery_sums", "SELECT l_suppkey AS entry, sum(l_linenumber)::BIGINT AS lines, sum(CAST(l_quantity AS INT))::BIGINT AS files FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1")
def s19(spark, sf):
    text = F.concat(F.lit("  round 1: "), F.col("l_linenumber").cast("string"), F.lit("\tlines dropped, "), F.col("l_quantity").cast("int").cast("string"), F.when(F.col("l_linenumber") % 2 == 1, " files dropped").otherwise(""))
    return R.recovery_sums(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("entry"), text.alias("line")))


@query("s22_run_states", "SELECT c_custkey AS repo, CASE c_custkey % 3 WHEN 0 THEN 'ERR' WHEN 1 THEN 'NONE' ELSE 'OK' END AS state, CASE WHEN c_custkey % 3 = 2 THEN 2 ELSE 0 END AS runs FROM customer")
def s22(spark, sf):
    kind = F.col("c_custkey") % 3
    body = F.when(kind == 0, F.when(F.col("c_custkey") % 2 == 0, "{oops")).when(kind == 1, "[]").otherwise('[{"workflowName":"a"},{"workflowName":"b","headSha":"1"}]')
    return R.run_states(table(spark, sf, "customer").select(F.col("c_custkey").alias("repo"), body.alias("body")))


@query("f05_repo_path", f"WITH {NAMED} SELECT fn, CASE WHEN c_custkey % 2 = 0 THEN 'x/C.java' ELSE 'src/' || split_part(fn, '.', 1) || '/' || split_part(fn, '.', 2) || '/C.java' END AS path FROM named")
def f05(spark, sf):
    n = named_customers(spark, sf)
    return n.select("fn", S.repo_path(F.col("fn"), F.when(F.col("c_custkey") % 2 == 0, "x/C.java").otherwise("C.java"), "src/").alias("path"))


@query("f10_package_of_probe", f"WITH {NAMED} SELECT fn, CASE WHEN region LIKE 'ASIA%' THEN split_part(fn, '.', 2) END AS package FROM named")
def f10(spark, sf):
    return named_customers(spark, sf).select("fn", S.package_of_probe(F.col("fn"), "ASIA").alias("package"))


@query("f12_owner_and_member", f"WITH {NAMED} SELECT fn, CASE WHEN c_custkey % 3 = 0 THEN fn WHEN c_custkey % 3 = 1 THEN NULL ELSE regexp_replace(fn, '\\.[^.]*$', '') END AS owner, CASE WHEN c_custkey % 3 = 0 THEN '==' WHEN c_custkey % 3 = 1 THEN 'alone' ELSE CAST(c_custkey AS VARCHAR) END AS member FROM named")
def f12(spark, sf):
    n = F.col("c_custkey") % 3
    callee = F.when(n == 0, F.concat("fn", F.lit(".=="))).when(n == 1, "alone(a.b)").otherwise(F.concat("fn", F.lit("(x.y)#2")))
    p = S.owner_and_member(callee)
    return named_customers(spark, sf).select("fn", p["owner"].alias("owner"), p["member"].alias("member"))


@query("f19_seconds_between", "SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts)) ELSE -1 END AS seconds FROM events")
def f19(spark, sf):
    text = F.when(F.col("event_id") % 10 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon")
    return table(spark, sf, "events").select("event_id", F.coalesce(S.seconds_between(F.lit("2024-01-01T00:00:00Z"), text), F.lit(-1)).alias("seconds"))


@query("f20_merged_maps", "SELECT c_custkey, c_name AS a, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'one' END AS b, c_mktsegment AS c FROM customer")
def f20(spark, sf):
    first = F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("one"))
    second = F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("b"), F.lit(None).cast("string"), F.lit("c"), F.lit("x")))
    third = F.create_map(F.lit("c"), F.col("c_mktsegment"), F.lit("a"), F.col("c_name"))
    m = S.merged_maps([first, second, third])
    return table(spark, sf, "customer").select("c_custkey", *[m[k].alias(k) for k in "abc"])


@query("w12_surprising_reaches", f"WITH RECURSIVE {EDGES}, {DIRECT}, far AS (SELECT fn, effect, 0 AS hops FROM direct UNION SELECT e.src, f.effect, f.hops + 1 FROM far f JOIN edge e ON e.dst = f.fn WHERE f.hops < 60), d AS (SELECT fn, effect, min(hops)::INT AS hops FROM far GROUP BY ALL HAVING min(hops) > 0), n AS (SELECT *, count(*) OVER (PARTITION BY effect) AS n FROM d) SELECT fn, effect, hops FROM n ORDER BY n, hops DESC, fn, effect LIMIT 10")
def w12(spark, sf):
    e, own = edges(spark, sf), direct(spark, sf)
    return R.surprising_reaches(G.change_depths(e, own, G.effects_closure(e, own)).filter("hops > 0"))


@query("k02_capped_details", f"WITH {BAGS} SELECT l_orderkey, l_linenumber, part, (SELECT count(*) FROM post) AS total FROM post ORDER BY l_orderkey, l_linenumber, part LIMIT 5000")
def k02(spark, sf):
    return R.capped_details(bags(spark, sf)[1].select("l_orderkey", "l_linenumber", "part"), ["l_orderkey", "l_linenumber", "part"], 5000)


# Helpers, each on a whole table.


@query("p05_effect_tokens", f"WITH {UNITS}, {UNIT_BAG} SELECT entry, fn, array_to_string(list_sort(list_distinct(flatten(list(list_concat(inferred, list_transform(inv, lambda x: '~invisible:' || x), list_transform(dis, lambda x: '~incomplete:' || x)))))), ',') AS tokens FROM bag WHERE arm = 'pre' GROUP BY entry, fn")
def p05(spark, sf):
    rows = unit_bag(spark, sf)[0].select("entry", "fn", F.explode_outer(E.tokens(F.col("inferred"), F.col("dispatches_on"), F.col("invisible"))).alias("t"))
    return rows.groupBy("entry", "fn").agg(F.array_join(F.array_sort(F.collect_set("t")), ",").alias("tokens"))


@query("r02_pure_scope", f"WITH {NAMED} SELECT fn, effect AS effects FROM named WHERE region LIKE 'EUROPE%' AND effect IS NOT NULL")
def r02(spark, sf):
    u = named_customers(spark, sf).select("fn", F.when(F.col("effect").isNull(), _none()).otherwise(F.array("effect")).alias("inferred"))
    return P.violations(u, P.parse_policy(spark, "pure EUROPE")).select("fn", F.array_join("effects", ",").alias("effects"))


@query("r09_scopes", f"WITH {NAMED} SELECT fn, starts_with(fn, 'ASIA.NATION_1') AS inside FROM named")
def r09(spark, sf):
    return named_customers(spark, sf).select("fn", P.in_scope(F.col("fn"), F.lit("ASIA.NATION_1")).alias("inside"))


@query("r10_unknown_by_class", f"WITH {NAMED} SELECT fn FROM named WHERE effect = 'Unknown' AND c_custkey % 3 < 2")
def r10(spark, sf):
    classes = F.element_at(F.array(F.array(F.lit("reflect")), F.array(F.lit("dispatch"), F.lit("native")), F.array(F.lit("setup"))), (F.col("c_custkey") % 3 + 1).cast("int"))
    u = named_customers(spark, sf).select("fn", F.when(F.col("effect").isNull(), _none()).otherwise(F.array("effect")).alias("inferred"), classes.alias("classes"))
    return P.violations(u, P.parse_policy(spark, "deny Unknown[reflect,dispatch]")).select("fn")


_FIGURES = "SELECT (count(*) FILTER (WHERE big)) / greatest(count(*), 1) AS smear, coalesce(sum(unk), 0) / greatest(coalesce(sum(inc), 0), 1) AS us, count(*) AS fns, coalesce(sum(inc), 0) AS inc, coalesce(sum(unk), 0) AS unk FROM (SELECT fn, count(*) AS inc, count(*) FILTER (WHERE effect = 'Unknown') AS unk, count(*) FILTER (WHERE effect <> 'Unknown') >= 3 AS big FROM {0} GROUP BY fn)"


def _figures(edge: str, inf: str) -> str:
    return f"SELECT f.*, least(1.0, e.n / greatest(v.n, 1) / 2.6) AS tangle, c.n / greatest(v.n, 1) AS ratio FROM ({_FIGURES.format(inf)}) f, (SELECT count(*) AS n FROM {edge}) e, (SELECT count(*) AS n FROM (SELECT src FROM {edge} UNION SELECT dst FROM {edge})) v, (SELECT count(*) AS n FROM go_{edge} WHERE src = dst) c"


DELTA = f"""{EDGES}, {DIRECT}, post AS (SELECT src, dst FROM edge UNION SELECT c_custkey, c_custkey * 3 + 1 FROM customer WHERE c_custkey % 40 = 7), pre AS (SELECT src, dst FROM edge),
go_post AS (SELECT src, dst FROM post UNION SELECT g.src, h.dst FROM go_post g JOIN post h ON h.src = g.dst), go_pre AS (SELECT src, dst FROM pre UNION SELECT g.src, h.dst FROM go_pre g JOIN pre h ON h.src = g.dst),
i_post AS (SELECT fn, effect FROM direct UNION SELECT e.src, i.effect FROM i_post i JOIN post e ON e.dst = i.fn), i_pre AS (SELECT fn, effect FROM direct UNION SELECT e.src, i.effect FROM i_pre i JOIN pre e ON e.dst = i.fn),
a AS ({_figures('post', 'i_post')}), b AS ({_figures('pre', 'i_pre')}), s AS (SELECT 1 AS side, * FROM a UNION ALL SELECT -1, * FROM b),
r AS (SELECT side, smear, us, tangle, ratio, greatest(0, least(1, 1 - (0.30 * smear + 0.26 * us + 0.24 * greatest(0, tangle - 0.4) / 0.6 + 0.20 * least(1, 3 * ratio)))) AS st FROM s)"""


@query("a15_structure_delta", f"WITH RECURSIVE {DELTA} SELECT round(sum(side * smear), 3)::DOUBLE + 0.0 AS smear, round(sum(side * us), 3)::DOUBLE + 0.0 AS unknown_share, round(sum(side * tangle), 3)::DOUBLE + 0.0 AS tangle, round(sum(side * ratio), 3)::DOUBLE + 0.0 AS cycle_ratio, round(sum(side * st), 3)::DOUBLE + 0.0 AS structure FROM r")
def a15(spark, sf):
    """The call graph before and after calls back up were added."""
    from ..operators.condensation import cyclic_nodes

    before = edges(spark, sf)
    after = before.unionByName(table(spark, sf, "customer").filter("c_custkey % 40 = 7").select(F.col("c_custkey").alias("src"), F.expr("c_custkey * 3 + 1").alias("dst"))).distinct()

    def figures(e):
        u = G.effects_closure(e, direct(spark, sf)).groupBy("fn").agg(F.collect_set("effect").alias("inferred"))
        return T.structure(u, G.nodes_of(e), e, cyclic_nodes(e))

    return T.structure_delta(figures(after), figures(before))


@query("a16_completeness", "SELECT p_partkey, (['refused', 'incomplete', 'incomplete', 'excluded', 'complete', 'out_of_scope', 'incomplete', 'complete'])[p_partkey % 8 + 1] AS completeness FROM part")
def a16(spark, sf):
    k = F.col("p_partkey") % 8
    excluded = "array<struct<class:string,peeked:boolean,judged_elsewhere:boolean>>"
    flag = lambda *ns: F.when(k.isin(*ns), True)
    one = lambda n: F.when(k == n, F.array(F.lit("x"))).otherwise(_none())
    rows = table(spark, sf, "part").select(
        "p_partkey", flag(0).alias("refused"), flag(0, 1).alias("incomplete"), one(2).alias("unanalyzed"), _none().alias("judged_nothing"),
        F.when(k == 3, F.expr("array(named_struct('class', 'new', 'peeked', false, 'judged_elsewhere', cast(null as boolean)))")).when(k == 4, F.expr("array(named_struct('class', 'new', 'peeked', true, 'judged_elsewhere', cast(null as boolean)))")).cast(excluded).alias("excluded"),
        one(5).alias("out_of_scope"), (k != 6).alias("ok"), F.lit(0).alias("results"),
    )
    return E.completeness(rows).select("p_partkey", "completeness")


@query("o15_absent_in_both", f"WITH {UNITS}, pr AS (SELECT e.entry, f.fn FROM (SELECT DISTINCT entry FROM unit_row) e CROSS JOIN (SELECT DISTINCT fn FROM unit_row) f) SELECT entry, fn FROM pr ANTI JOIN unit_row USING (entry, fn)")
def o15(spark, sf):
    u = units(spark, sf)
    probes = u.select("fn").distinct().crossJoin(F.broadcast(u.select("entry").distinct()))  # 24 hours at most
    both = probes.join(u.filter("arm = 'pre'").select("entry", "fn", F.col("inferred").alias("p")), ["entry", "fn"], "left").join(u.filter("arm = 'post'").select("entry", "fn", F.col("inferred").alias("q")), ["entry", "fn"], "left")
    return both.filter((E.state(F.col("p")) == "ABSENT") & (E.state(F.col("q")) == "ABSENT")).select("entry", "fn")


@query("o14_probes_read", "SELECT p_brand AS \"table\", sum(p_size)::BIGINT AS declared, coalesce(sum(n), 0)::BIGINT AS read, CASE WHEN sum(p_size) > 0 AND coalesce(sum(n), 0) = 0 THEN 'REFUSED' ELSE 'OK' END AS status FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_quantity >= 50 AND l_discount >= 0.1 AND l_shipdate < TIMESTAMP '1995-01-01' GROUP BY 1) ON l_partkey = p_partkey GROUP BY 1")
def o14(spark, sf):
    """Parts declare probes by brand; what was read are some of their line items."""
    n = table(spark, sf, "lineitem").filter("l_quantity >= 50 AND l_discount >= 0.1 AND l_shipdate < timestamp'1995-01-01'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("read"))
    return X.probes_read(table(spark, sf, "part").join(n, "p_partkey", "left").select(F.col("p_brand").alias("table"), F.col("p_size").alias("declared"), "read"))


@query(
    "o08_seeded_sensitivity",
    "WITH b AS (SELECT source AS key, text, coalesce(toxic, 0) AS verdict FROM documents LEFT JOIN labels USING (doc_id)), a AS (SELECT * FROM b UNION ALL SELECT 'src' || CAST(c_custkey % 23 AS VARCHAR), c_name, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 0 END FROM customer WHERE c_acctbal > 9500),"
    " p AS (SELECT key, bool_or(contains(text, '#0000')) AS base, max(verdict) AS v FROM b GROUP BY 1), q AS (SELECT key, bool_or(contains(text, '#0000')) AS seeded, max(verdict) AS w FROM a GROUP BY 1)"
    " SELECT key, coalesce(seeded, false) AS seeded, coalesce(base, false) AS base, CASE WHEN NOT coalesce(seeded, false) THEN 'NOT SEEN' WHEN coalesce(base, false) THEN 'SEEN WITHOUT SEED' WHEN v IS NOT DISTINCT FROM w THEN 'VERDICT DID NOT MOVE' ELSE 'OK' END AS status FROM q LEFT JOIN p USING (key)",
)
def o08(spark, sf):
    """Documents by source, into which names of customers are planted."""
    base = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(F.col("source").alias("key"), "text", F.coalesce("toxic", F.lit(0)).alias("verdict"))
    planted = table(spark, sf, "customer").filter("c_acctbal > 9500").select(F.concat(F.lit("src"), (F.col("c_custkey") % 23).cast("string")).alias("key"), F.col("c_name").alias("text"), F.when(F.col("c_custkey") % 3 == 0, 2).otherwise(0).alias("verdict"))
    return X.seeded_sensitivity(base, base.unionByName(planted), "#0000")


@query("o13_canary", "SELECT (['C1', 'C2', 'C3', 'C3', 'C3', 'R'])[c_custkey % 6 + 1] AS class, count(*) AS seeded, count(*) AS found, true AS sound FROM customer GROUP BY 1")
def o13(spark, sf):
    """Every customer is a seed of one kind, in a world of its own: what it called before, what it calls now, and what that leads to."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), (F.col("c_custkey") % 6).alias("kind"))
    name = lambda kind: F.concat(F.lit(f"{kind}/"), "id")
    # Callees gained: clean, open below, (none), not analysed, with an effect that the seed's row hides, with one that it shows.
    gained = F.when(F.col("kind") != 2, F.element_at(F.array(*[F.lit(x) for x in ("calm", "ajar", "-", "unseen", "hidden", "shown")]), (F.col("kind") + 1).cast("int")))
    seed, callee = name("seed"), F.concat(gained, F.lit("/"), "id")
    seeds = c.select(seed.alias("fn"), F.when(F.col("kind") == 5, F.array(F.lit("Fs"))).otherwise(_none()).alias("tokens"), F.element_at(F.array(*[F.lit(x) for x in ("C1", "C2", "C3", "C3", "C3", "R")]), (F.col("kind") + 1).cast("int")).alias("expected"))
    before = c.select(seed.alias("src"), name("kept").alias("dst"))
    after = before.unionByName(c.filter("kind <> 2").select(seed.alias("src"), callee.alias("dst"))).unionByName(c.filter("kind = 1").select(callee.alias("src"), name("outside").alias("dst")))
    nodes = seeds.select("fn").unionByName(before.select(F.col("dst").alias("fn"))).unionByName(c.filter("kind IN (0, 1, 4, 5)").select(callee.alias("fn")))
    rows = c.filter("kind IN (4, 5)").select(callee.alias("fn"), F.array(F.when(F.col("kind") == 4, "Net").otherwise("Fs")).alias("tokens"))
    return X.canary(seeds, before, after, nodes, rows)


@query("w05_ordered_details", "SELECT l_returnflag AS part, to_json({'key': [CAST(l_suppkey AS VARCHAR), CAST(qty AS VARCHAR)], 'n': n}) AS line, row_number() OVER (PARTITION BY l_returnflag ORDER BY '[\"' || CAST(l_suppkey AS VARCHAR) || '\",\"' || CAST(qty AS VARCHAR) || '\"]') AS place FROM (SELECT l_returnflag, l_suppkey, CAST(l_quantity AS INT) AS qty, count(*) AS n FROM lineitem GROUP BY ALL)")
def w05(spark, sf):
    """Counts by flag, supplier and quantity, as detail lines in the order of the text of their keys."""
    n = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_suppkey", F.col("l_quantity").cast("int").alias("qty")).agg(F.count("*").alias("n"))
    return sinks.ordered_details(n.select(F.col("l_returnflag").alias("part"), F.array(F.col("l_suppkey").cast("string"), F.col("qty").cast("string")).alias("key"), "n"), "part", "key", ["n"])


@query("s08_backends", "SELECT c_custkey, (['jvm', 'Swift', 'JS', 'Swift', 'JS', 'scan', 'JS'])[c_custkey % 7 + 1] AS backend FROM customer")
def s08(spark, sf):
    k = (F.col("c_custkey") % 7 + 1).cast("int")
    pick = lambda *v: F.element_at(F.array(*[F.lit(x).cast("string") for x in v]), k)
    return table(spark, sf, "customer").select("c_custkey", reports.backend(pick("jdk21", "swiftsyntax", "node22", None, None, "nightly", "jdk21"), pick(None, None, None, "engine-swift-1", "engine-ts-2", "1.0", "1.0"), k != 7).alias("backend"))


def _documents(spark, sf):
    """Customers as report texts: two documents in each text, 50 functions at most in each document."""
    c = table(spark, sf, "customer")
    fn = F.struct(F.col("c_name").alias("fn"), F.concat(F.lit("p#"), "c_name").alias("hash"), F.when(F.col("c_acctbal") < 0, _none()).otherwise(F.array("c_mktsegment")).alias("inferred"))
    docs = c.groupBy(F.expr("c_custkey div 100").alias("file"), F.expr("c_custkey div 50").alias("doc")).agg(F.collect_list(fn).alias("functions"), F.count("*").alias("n"))
    text = F.to_json(F.struct(F.struct(F.when(F.col("doc") % 2 == 0, F.col("n")).alias("count")).alias("analyzed"), F.col("functions")))
    texts = docs.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(text)), "\n ").alias("value"))
    broken = F.when(F.col("file") % 10 == 3, F.concat(F.lit("﻿"), "value", F.lit(" {"))).otherwise(F.col("value"))
    return texts.select(F.concat(F.lit("/r/e"), F.col("file").cast("string"), F.lit("/x.json")).alias("path"), broken.alias("value"))


@query("s01_documents", "SELECT '/r/e' || CAST(c_custkey // 100 AS VARCHAR) || '/x.json' AS path, count(DISTINCT c_custkey // 50) AS documents, CASE WHEN any_value(c_custkey // 100) % 10 = 3 THEN 1 ELSE 0 END AS errors FROM customer GROUP BY c_custkey // 100")
def s01(spark, sf):
    rows = reports.parse_documents(_documents(spark, sf))
    return rows.groupBy("path").agg(F.count("body").alias("documents"), F.count("error").cast("int").alias("errors"))


@query("s03_reports", "WITH d AS (SELECT c_custkey // 100 AS f, c_custkey // 50 AS d, count(*) AS n FROM customer GROUP BY ALL) SELECT 'e' || CAST(f AS VARCHAR) AS entry, sum(CASE WHEN d % 2 = 0 THEN n END)::BIGINT AS analysed, sum(n)::BIGINT AS functions FROM d GROUP BY f")
def s03(spark, sf):
    return reports.entry_totals(reports.normalised(reports.parse_documents(_documents(spark, sf)))).select("entry", "analysed", "functions")


@query("s02_units", "SELECT 'e' || CAST(c_custkey // 100 AS VARCHAR) AS entry, c_name AS fn, 'p' AS package, CASE WHEN c_acctbal < 0 THEN '' ELSE c_mktsegment END AS inferred FROM customer")
def s02(spark, sf):
    rows = reports.unit_rows(reports.normalised(reports.parse_documents(_documents(spark, sf))))
    return rows.select("entry", "fn", "package", F.array_join("inferred", ",").alias("inferred"))


@query("s07_sidecars", "SELECT page_id FROM pages WHERE page_id % 4 = 3")
def s07(spark, sf):
    name = F.element_at(F.array(*[F.lit(x) for x in ("a.callgraph.json", "a.gate.json", "a.encountered-x.json", "a.scan.json")]), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf, "pages").withColumn("path", name).filter(~F.col("path").rlike(reports.SIDECAR)).select("page_id")


@query("s11_cache_lookup", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'absent' WHEN c_custkey % 5 = 1 THEN 'other schema' WHEN c_custkey % 5 = 2 THEN 'other engine' ELSE 'hit' END AS state FROM customer")
def s11(spark, sf):
    c = table(spark, sf, "customer")
    wanted = c.select("c_custkey", F.lit(3).alias("schema"), F.lit("e1").alias("engine"))
    stored = c.filter("c_custkey % 5 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 5 == 1, 2).otherwise(3).alias("schema"), F.when(F.col("c_custkey") % 5 == 2, "e0").otherwise("e1").alias("engine"))
    return reports.lookup_cache(wanted, stored, ["c_custkey"], ["schema", "engine"])


@query("p21_stale", "SELECT page_id, page_id % 3 = 0 OR page_id % 3 = 1 AS stale FROM pages")
def p21(spark, sf):
    at = lambda n: F.timestamp_seconds(F.lit(n))
    newest = F.when(F.col("page_id") % 3 == 0, at(20)).when(F.col("page_id") % 3 == 2, at(5))
    return table(spark, sf, "pages").select("page_id", reports.stale(at(10), newest).alias("stale"))


@query("k04_findings_documents", "SELECT c_nationkey, count(*) AS results FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def k04(spark, sf):
    c = table(spark, sf, "customer").filter("c_acctbal < 0")
    found = c.select("c_nationkey", F.lit("AS-EFF-006").alias("rule"), F.col("c_name").alias("fn"), F.concat("c_name", F.lit(".rs:3")).alias("loc"), F.lit("m").alias("message"), F.lit("error").alias("level"))
    docs = sinks.findings_document(found, "c_nationkey")
    schema = "struct<version:string,runs:array<struct<results:array<struct<ruleId:string>>>>>"
    return docs.select("c_nationkey", F.size(F.from_json("document", schema)["runs"][0]["results"]).cast("long").alias("results"))


@query("k09_policy_text", f"WITH {NAMED}, p AS (SELECT DISTINCT region FROM named) SELECT 'deny Exec,Ipc,Clipboard ' || replace(region, ' ', '_') AS line FROM p")
def k09(spark, sf):
    regions = named_customers(spark, sf).select(F.replace("region", F.lit(" "), F.lit("_")).alias("layer")).distinct()
    profile = regions.withColumn("fns", F.lit(1)).withColumn("effects", F.array(*[F.lit(e) for e in ("Net", "Db", "Fs")]))
    return P.policy_text(P.propose(profile))


ROUTES = "deny Net ASIA\ndeny Db,Fs EUROPE.NATION_1\npure AMERICA\ndeny Unknown AFRICA.NATION_1\ndeny Exec"


@query("o07_equal_routes", f"WITH {NAMED}, v AS (SELECT fn, CASE WHEN effect = 'Net' AND starts_with(fn, 'ASIA') THEN 0 WHEN effect IN ('Db', 'Fs') AND starts_with(fn, 'EUROPE.NATION_1') THEN 1 WHEN effect IS NOT NULL AND starts_with(fn, 'AMERICA') THEN 2 WHEN effect = 'Unknown' AND starts_with(fn, 'AFRICA.NATION_1') THEN 3 END AS ordinal FROM named) SELECT o.ordinal::INT AS ordinal, count(fn) AS rows, CASE WHEN count(fn) > 0 THEN 1 ELSE 0 END AS code, true AS equal FROM range(5) o(ordinal) LEFT JOIN v ON v.ordinal = o.ordinal GROUP BY 1")
def o07(spark, sf):
    """Verdicts of every rule by two routes: the join of all rules at once, and one scan for each rule."""
    u = named_customers(spark, sf).select("fn", F.when(F.col("effect").isNull(), _none()).otherwise(F.array("effect")).alias("inferred"))
    rules = P.parse_policy(spark, ROUTES)
    alone = None
    for i, line in enumerate(ROUTES.splitlines()):
        kind, *rest = line.split()
        effects = rest[0].split(",") if kind == "deny" else []
        scope = rest[-1] if kind == "pure" or len(rest) > 1 else ""
        over = F.size("inferred") > 0 if kind == "pure" else F.arrays_overlap("inferred", F.array(*[F.lit(e) for e in effects]))
        mine = u.filter(P.in_scope(F.col("fn"), F.lit(scope)) & over).select(F.lit(i).alias("ordinal"), "fn")
        alone = mine if alone is None else alone.unionByName(mine)
    return O.equal_routes(rules.select("ordinal"), P.violations(u, rules), alone, "ordinal", "fn")
