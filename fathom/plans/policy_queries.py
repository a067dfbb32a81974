"""Policies, joins by identity and prefix, consistency oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consistency as O
from ..operators import joins as J
from ..operators import policy as P
from ..operators.structure import layer_profile
from .registry import query
from .views import BAGS, NAMED, UNITS, arms, bags, named_customers, table, unit_rows

POLICY = """
deny Net,Db ASIA          # the region's customers stay off the network and the database
pure EUROPE.NATION_1      # a prefix of the last segment
deny Unknown AMERICA
"""
IN_SCOPE = "CASE r.kind WHEN 'asia' THEN split_part(fn, '.', 1) LIKE 'ASIA%' WHEN 'europe' THEN split_part(fn, '.', 1) = 'EUROPE' AND split_part(fn, '.', 2) LIKE 'NATION_1%' ESCAPE '!' ELSE split_part(fn, '.', 1) LIKE 'AMERICA%' END"
IN_SCOPE = IN_SCOPE.replace("LIKE 'NATION_1%' ESCAPE '!'", "LIKE 'NATION!_1%' ESCAPE '!'")


def _units(spark, sf):
    n = named_customers(spark, sf)
    return n.select("fn", F.when(F.col("effect").isNull(), F.array().cast("array<string>")).otherwise(F.array("effect")).alias("inferred"), "layer", "region", "c_custkey", "c_acctbal")


@query("r01_violations", f"WITH {NAMED}, r AS (SELECT unnest(['asia', 'europe', 'america']) AS kind, unnest([0, 1, 2]) AS ordinal) SELECT ordinal, CASE r.kind WHEN 'europe' THEN 'pure' ELSE 'deny' END AS kind, fn, effect AS effects FROM named, r WHERE {IN_SCOPE} AND effect IS NOT NULL AND (r.kind = 'europe' OR (r.kind = 'asia' AND effect IN ('Net', 'Db')) OR (r.kind = 'america' AND effect = 'Unknown'))")
def r01(spark, sf):
    out = P.violations(_units(spark, sf), P.parse_policy(spark, POLICY))
    return out.select("ordinal", "kind", "fn", F.array_join("effects", ",").alias("effects"))


@query("r03_literals", f"WITH {NAMED} SELECT fn, CASE WHEN c_acctbal < 0 THEN '' WHEN layer IN ('NATION_2', 'NATION_3') THEN '' ELSE layer END AS outside FROM named WHERE effect = 'Net' AND (c_acctbal < 0 OR layer NOT IN ('NATION_2', 'NATION_3'))")
def r03(spark, sf):
    u = _units(spark, sf).withColumn("hosts", F.when(F.col("c_acctbal") < 0, F.array().cast("array<string>")).otherwise(F.array("layer")))
    return P.literal_violations(u, "Net", "hosts", "", ["NATION_2", "NATION_3"]).select("fn", F.array_join("outside", ",").alias("outside"))


@query("r06_accepted", f"WITH {NAMED} SELECT fn FROM named WHERE effect = 'Net' AND c_acctbal >= 0")
def r06(spark, sf):
    u = _units(spark, sf)
    found = u.filter(F.array_contains("inferred", "Net")).select("fn")
    return P.accepted(found, u.filter("c_acctbal < 0").select("fn"), ["fn"])[0]


@query("r06_stale_accepts", f"WITH {NAMED} SELECT fn FROM named WHERE c_acctbal < 0 AND effect IS DISTINCT FROM 'Net'")
def r06_stale(spark, sf):
    u = _units(spark, sf)
    found = u.filter(F.array_contains("inferred", "Net")).select("fn")
    return P.accepted(found, u.filter("c_acctbal < 0").select("fn"), ["fn"])[1]


@query("r07_ratchet", f"WITH {UNITS}, p AS (SELECT DISTINCT fn, effect FROM unit_row WHERE arm = 'pre' AND k < 40), q AS (SELECT DISTINCT fn, effect FROM unit_row WHERE arm = 'post'), n AS (SELECT * FROM q EXCEPT SELECT * FROM p) SELECT fn, effect, CASE WHEN fn IN (SELECT fn FROM p) THEN 'existing' ELSE 'new' END AS origin, fn IN (SELECT fn FROM p) OR effect <> 'Unknown' AS fails FROM n")
def r07(spark, sf):
    r = unit_rows(spark, sf)
    before = r.filter("arm = 'pre' AND k < 40").select("fn", "effect").distinct()
    return P.ratchet(r.filter("arm = 'post'").select("fn", "effect").distinct(), before, before.select("fn").distinct())


@query("r12_proposal", f"WITH {NAMED}, p AS (SELECT split_part(fn, '.', 3) AS layer, count(DISTINCT fn) AS fns, coalesce(list(DISTINCT effect) FILTER (WHERE effect IS NOT NULL), []) AS effects FROM named GROUP BY 1) SELECT layer, CASE WHEN len(effects) = 0 THEN 'pure' ELSE 'deny' END AS kind, CASE WHEN len(effects) = 0 THEN '' ELSE array_to_string(list_filter(['Db', 'Net', 'Fs', 'Exec', 'Ipc', 'Clipboard'], lambda e: NOT list_contains(effects, e)), ',') END AS effects FROM p WHERE effects <> ['Unknown']")
def r12(spark, sf):
    u = _units(spark, sf).withColumn("layer", F.split_part("fn", F.lit("."), F.lit(3)))
    profile = layer_profile(u.select("fn", "layer"), u.select("fn", "inferred"), "layer")
    return P.propose(profile).select("layer", "kind", F.array_join("effects", ",").alias("effects"))


@query("r15_containment", f"WITH {NAMED}, n AS (SELECT effect, layer, count(DISTINCT fn) AS n FROM named WHERE effect IS NOT NULL GROUP BY ALL) SELECT effect, arg_min(layer, (-n, layer)) AS owner, sum(n)::BIGINT AS fns, floor(100 * max(n) / sum(n))::BIGINT AS percent FROM n GROUP BY effect")
def r15(spark, sf):
    return P.containment(named_customers(spark, sf).filter("effect IS NOT NULL").select("fn", "layer", "effect"))


@query("r16_unverified", f"WITH {NAMED} SELECT 0 AS ordinal, fn FROM named WHERE region LIKE 'ASIA%' AND effect = 'Unknown'")
def r16(spark, sf):
    rules = P.parse_policy(spark, "deny Net,Db ASIA")
    return P.unverified(_units(spark, sf), rules)


@query("r17_gains_and_losses", f"WITH {UNITS}, p AS (SELECT DISTINCT fn, effect, entry FROM unit_row WHERE arm = 'pre'), q AS (SELECT DISTINCT fn, effect, entry FROM unit_row WHERE arm = 'post') SELECT fn, effect, entry, 'gained' AS side FROM (SELECT * FROM q EXCEPT SELECT * FROM p) UNION ALL SELECT fn, effect, entry, 'lost' FROM (SELECT * FROM p EXCEPT SELECT * FROM q)")
def r17(spark, sf):
    r = unit_rows(spark, sf).select("arm", "fn", "effect", "entry").distinct()
    p, q = r.filter("arm = 'pre'").drop("arm"), r.filter("arm = 'post'").drop("arm")
    return q.subtract(p).withColumn("side", F.lit("gained")).unionByName(p.subtract(q).withColumn("side", F.lit("lost")))


UNIT_H = "u AS (SELECT 'f' || CAST(c_nationkey AS VARCHAR) || c_mktsegment AS fn, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'h' || CAST(c_custkey // 3 AS VARCHAR) END AS hash, c_name AS loc FROM customer), v AS (SELECT c_custkey AS id, fn, hash FROM (SELECT c_custkey, 'f' || CAST(c_nationkey AS VARCHAR) || c_mktsegment AS fn, CASE WHEN c_acctbal < 0 THEN NULL ELSE 'h' || CAST(c_custkey // 3 AS VARCHAR) END AS hash FROM customer))"


@query(
    "j03_identity_ladder",
    f"WITH {UNIT_H}, bp AS (SELECT fn, hash, min(loc) AS l FROM u WHERE hash IS NOT NULL GROUP BY ALL HAVING count(*) = 1), bh AS (SELECT hash, min(loc) AS l FROM u WHERE hash IS NOT NULL GROUP BY 1 HAVING count(*) = 1), bf AS (SELECT fn, min(loc) AS l FROM u GROUP BY 1 HAVING count(*) = 1)"
    " SELECT v.id, v.fn, v.hash, CASE WHEN v.hash IS NOT NULL THEN coalesce(bp.l, bh.l) ELSE bf.l END AS loc FROM v LEFT JOIN bp ON bp.fn = v.fn AND bp.hash = v.hash LEFT JOIN bh ON bh.hash = v.hash LEFT JOIN bf ON bf.fn = v.fn",
)
def j03(spark, sf):
    c = table(spark, sf, "customer")
    fn = F.concat(F.lit("f"), F.col("c_nationkey").cast("string"), "c_mktsegment")
    hash_ = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("h"), F.expr("c_custkey div 3").cast("string")))
    units = c.select(fn.alias("fn"), hash_.alias("hash"), F.col("c_name").alias("loc"))
    return J.identity_ladder(c.select(F.col("c_custkey").alias("id"), fn.alias("fn"), hash_.alias("hash")), units)


@query("j04_new_lines", f"WITH {BAGS} SELECT DISTINCT part AS line FROM post WHERE part NOT IN (SELECT part FROM pre WHERE qty > 45)")
def j04(spark, sf):
    pre, post = bags(spark, sf)
    return J.new_findings(post.select(F.col("part").alias("line")).distinct(), pre.filter("qty > 45").select(F.col("part").alias("line")))


@query("j05_longest_prefix", f"WITH {NAMED}, pre AS (SELECT DISTINCT replace(r_name, ' ', '_') AS prefix FROM region WHERE r_regionkey > 0 UNION SELECT DISTINCT replace(region, ' ', '_') || '.' || layer FROM named WHERE c_acctbal < 0), j AS (SELECT fn AS name, prefix FROM named LEFT JOIN pre ON starts_with(fn, prefix || '.')) SELECT name, coalesce(arg_max(prefix, length(prefix)), '(default)') AS prefix FROM j GROUP BY name")
def j05(spark, sf):
    n = named_customers(spark, sf)
    region = F.replace("region", F.lit(" "), F.lit("_"))
    regions = table(spark, sf, "region").filter("r_regionkey > 0").select(F.replace("r_name", F.lit(" "), F.lit("_")).alias("prefix"))
    prefixes = regions.unionByName(n.filter("c_acctbal < 0").select(F.concat_ws(".", region, "layer").alias("prefix"))).distinct()
    return J.longest_prefix(n.select(F.col("fn").alias("name")), prefixes)


@query("j06_related_names", f"WITH {NAMED}, lib AS (SELECT DISTINCT replace(region, ' ', '_') || '.' || layer AS name FROM named WHERE c_acctbal < -900) SELECT DISTINCT n.fn AS name FROM named n JOIN lib ON n.fn = lib.name OR starts_with(n.fn, lib.name || '.') OR starts_with(lib.name, n.fn || '.')")
def j06(spark, sf):
    n = named_customers(spark, sf)
    lib = n.filter("c_acctbal < -900").select(F.concat_ws(".", F.replace("region", F.lit(" "), F.lit("_")), "layer").alias("name")).distinct()
    return J.related_names(n.select(F.col("fn").alias("name")), lib)


@query("j12_path_globs", "SELECT url AS path, g AS glob FROM pages, (SELECT unnest(['**/en/*', '**/fr/**', 'https://m.*/**']) AS g, unnest(['^.*/en/[^/]*$', '^.*/fr/.*$', '^https://m\\.[^/]*/.*$']) AS r) WHERE regexp_matches(url, r)")
def j12(spark, sf):
    return J.matching_paths(table(spark, sf, "pages").select(F.col("url").alias("path")), ["**/en/*", "**/fr/**", "https://m.*/**"])


@query("o02_weakened", f"WITH {UNITS} SELECT entry, fn, 'absent' AS after FROM a ANTI JOIN b USING (entry, fn)")
def o02(spark, sf):
    return O.weakened(*arms(spark, sf), ["entry", "fn"])


@query("o03_chain_only_adds", f"WITH {UNITS}, j AS (SELECT len(list_filter(b.inferred, lambda e: NOT list_contains(a.inferred, e))) > 0 AS g, len(list_filter(a.inferred, lambda e: NOT list_contains(b.inferred, e))) > 0 AS s FROM a JOIN b USING (entry, fn)), n AS (SELECT count(*) AS shared, count(*) FILTER (WHERE g) AS grew, count(*) FILTER (WHERE s) AS shrank FROM j) SELECT *, CASE WHEN shared = 0 THEN 'NOTHING SHARED' WHEN shrank > 0 THEN 'SHRANK' WHEN grew = 0 THEN 'VACUOUS' ELSE 'OK' END AS status FROM n")
def o03(spark, sf):
    return O.chain_only_adds(*arms(spark, sf), ["entry", "fn"])


@query("o05_disjoint", "WITH n AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS u, count(*) FILTER (WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AS fu FROM orders GROUP BY 1) SELECT *, CASE WHEN f + u <> fu THEN 'OVERLAP' WHEN u = 0 THEN 'VACUOUS' ELSE 'DISJOINT' END AS status FROM n")
def o05(spark, sf):
    o = table(spark, sf, "orders")
    f, u = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"
    return O.disjoint(o.groupBy("o_custkey").agg(F.count_if(f).alias("f"), F.count_if(u).alias("u"), F.count_if(f | u).alias("fu")), "f", "u", "fu")


@query("o06_moved", f"WITH {UNITS}, p AS (SELECT fn, count(*) AS before FROM unit_row WHERE arm = 'pre' GROUP BY 1), q AS (SELECT fn, count(*) AS after FROM unit_row WHERE arm = 'post' GROUP BY 1) SELECT fn, before, after FROM p JOIN q USING (fn) WHERE after < before")
def o06(spark, sf):
    n = unit_rows(spark, sf).groupBy("arm", "fn").agg(F.count("*").alias("n"))
    return O.moved_between(n.filter("arm = 'pre'"), n.filter("arm = 'post'"), ["fn"], "n")


@query("o01_self_consistency", f"WITH {NAMED}, x AS (SELECT layer AS entry, fn, effect, c_acctbal < 0 AS hosts, c_acctbal > 9000 AS why FROM named) SELECT 'hosts_without_net' AS rule, entry, fn FROM x WHERE hosts AND effect IS DISTINCT FROM 'Net' UNION ALL SELECT 'why_without_unknown', entry, fn FROM x WHERE why AND effect IS DISTINCT FROM 'Unknown' UNION ALL SELECT 'fewer_analysed_than_rows', layer, NULL FROM named GROUP BY layer HAVING count(*) FILTER (WHERE c_acctbal >= 0) < count(*)")
def o01(spark, sf):
    u = _units(spark, sf)
    none = F.array().cast("array<string>")
    rows = u.select(F.col("layer").alias("entry"), "fn", F.col("inferred").alias("direct"), "inferred", F.when(F.col("c_acctbal") > 9000, F.array(F.lit("x"))).otherwise(none).alias("unknown_why"), F.when(F.col("c_acctbal") < 0, F.array(F.lit("h"))).otherwise(none).alias("hosts"), none.alias("cmds"), none.alias("paths"), none.alias("tables"))
    reports = u.groupBy(F.col("layer").alias("entry")).agg(F.count_if(F.col("c_acctbal") >= 0).alias("analysed"))
    return O.self_consistency(rows, reports)
