"""Call graphs (customers calling customers of smaller numbers)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import condensation as D
from ..operators import consistency as O
from ..operators import graph as G
from ..operators import remedies as M
from .registry import query
from .views import CLOSURE, DIRECT, EDGES, direct, edges, table


def _fns(spark, sf, where):
    return table(spark, sf, "customer").filter(where).select(F.col("c_custkey").alias("fn"))


@query("g01_nodes", f"WITH {EDGES} SELECT src AS fn FROM edge UNION SELECT dst FROM edge")
def g01(spark, sf):
    return G.nodes_of(edges(spark, sf))


@query("g02_reversed", f"WITH {EDGES} SELECT dst AS src, src AS dst FROM edge")
def g02(spark, sf):
    return G.reversed_edges(edges(spark, sf))


@query("g03_blast", f"WITH RECURSIVE {CLOSURE} SELECT fn, coalesce(n, 0) AS blast, false AS approximate FROM (SELECT src AS fn FROM edge UNION SELECT dst FROM edge) LEFT JOIN (SELECT dst, count(*) AS n FROM reach GROUP BY 1) ON dst = fn")
def g03(spark, sf):
    return D.blast(edges(spark, sf))


@query("g04_cyclic_nodes", f"WITH RECURSIVE {CLOSURE} SELECT src AS fn FROM reach WHERE src = dst")
def g04(spark, sf):
    return D.cyclic_nodes(edges(spark, sf))


FACTS = f"{CLOSURE}, {DIRECT}"


@query("g05_reason_fixpoint", f"WITH RECURSIVE {FACTS} SELECT DISTINCT r.src AS fn, d.effect FROM reach r JOIN direct d ON d.fn = r.dst UNION SELECT fn, effect FROM direct")
def g05(spark, sf):
    return G.effects_closure(edges(spark, sf), direct(spark, sf))


def _hops(effect: str) -> str:
    """Breadth first, one level after the other, with a bound well beyond the depth of the graph."""
    return f"""{EDGES}, {DIRECT}, w AS (SELECT fn, 0 AS hops FROM direct WHERE effect = '{effect}' UNION SELECT e.src, w.hops + 1 FROM w JOIN edge e ON e.dst = w.fn WHERE w.hops < 60),
h AS (SELECT fn, min(hops)::INT AS hops FROM w GROUP BY fn)"""


@query("g06_hops", f"WITH RECURSIVE {_hops('Net')} SELECT * FROM h")
def g06(spark, sf):
    return G.hops_to(edges(spark, sf), direct(spark, sf).filter("effect = 'Net'"))


GAINED = f"""{EDGES}, {DIRECT}, old AS (SELECT d.fn, d.effect FROM direct d JOIN customer ON c_custkey = d.fn WHERE c_acctbal < 6000),
now AS (SELECT fn, effect FROM direct UNION SELECT e.src, n.effect FROM now n JOIN edge e ON e.dst = n.fn), was AS (SELECT fn, effect FROM old UNION SELECT e.src, w.effect FROM was w JOIN edge e ON e.dst = w.fn),
far AS (SELECT fn, effect, 0 AS hops FROM direct UNION SELECT e.src, f.effect, f.hops + 1 FROM far f JOIN edge e ON e.dst = f.fn WHERE f.hops < 60),
depth AS (SELECT fn, effect, min(hops)::INT AS hops FROM far JOIN (SELECT * FROM now EXCEPT SELECT * FROM was) USING (fn, effect) GROUP BY ALL)"""


def _depths(spark, sf):
    """What functions gain over a baseline in which wealthy customers did nothing."""
    e, now = edges(spark, sf), direct(spark, sf)
    old = now.join(_fns(spark, sf, "c_acctbal < 6000"), "fn", "left_semi")
    gained = G.effects_closure(e, now).join(G.effects_closure(e, old), ["fn", "effect"], "left_anti")
    return G.change_depths(e, now, gained)


@query("g06_change_depths", f"WITH RECURSIVE {GAINED} SELECT * FROM depth")
def g06_gained(spark, sf):
    return _depths(spark, sf)


@query("g06_max_hops", f"WITH RECURSIVE {GAINED} SELECT max(hops) AS max_hops FROM depth")
def g06_max(spark, sf):
    return _depths(spark, sf).agg(F.max("hops").alias("max_hops"))


@query("g11_path_steps", f"WITH RECURSIVE {_hops('Db')} SELECT h.fn, h.hops, coalesce(min(e.dst), -1) AS next FROM h LEFT JOIN (SELECT e.src, e.dst, g.hops FROM edge e JOIN h g ON g.fn = e.dst) e ON e.src = h.fn AND e.hops = h.hops - 1 GROUP BY ALL")
def g11(spark, sf):
    return G.next_hops(edges(spark, sf), direct(spark, sf).filter("effect = 'Db'")).withColumn("next", F.coalesce("next", F.lit(-1)))


@query("g12_callers", f"WITH RECURSIVE {CLOSURE} SELECT dst AS fn, count(*) AS callers FROM reach JOIN customer ON c_custkey = dst WHERE c_acctbal < 0 GROUP BY 1")
def g12(spark, sf):
    return G.callers(edges(spark, sf), _fns(spark, sf, "c_acctbal < 0")).groupBy("fn").agg(F.count("*").alias("callers"))


@query("g13_where", f"WITH RECURSIVE {FACTS} SELECT fn, bool_or(own) AS direct FROM (SELECT fn, true AS own FROM direct WHERE effect = 'Fs' UNION ALL SELECT r.src, false FROM reach r JOIN direct d ON d.fn = r.dst WHERE d.effect = 'Fs') GROUP BY fn")
def g13(spark, sf):
    own = direct(spark, sf).filter("effect = 'Fs'").select("fn")
    return G.hops_to(edges(spark, sf), own).select("fn", (F.col("hops") == 0).alias("direct"))


@query("g17_forbidden", f"WITH RECURSIVE {CLOSURE} SELECT r.src, r.dst FROM reach r JOIN customer a ON a.c_custkey = r.src JOIN customer b ON b.c_custkey = r.dst WHERE a.c_mktsegment = 'AUTOMOBILE' AND b.c_mktsegment = 'BUILDING'")
def g17(spark, sf):
    return G.forbidden(edges(spark, sf), _fns(spark, sf, "c_mktsegment = 'AUTOMOBILE'"), _fns(spark, sf, "c_mktsegment = 'BUILDING'")).select("src", "dst")


HOIST = """carry AS (SELECT fn, effect FROM direct WHERE effect IN ('Net', 'Fs') UNION SELECT e.src, c.effect FROM carry c JOIN edge e ON e.dst = c.fn),
bad AS (SELECT fn, effect FROM carry JOIN customer ON c_custkey = fn WHERE c_nationkey = 3 AND effect = 'Net' OR c_nationkey IN (7, 11)),
root AS (SELECT fn, effect FROM bad SEMI JOIN direct USING (fn, effect) UNION SELECT b.fn, b.effect FROM bad b JOIN edge e ON e.src = b.fn JOIN (SELECT * FROM carry EXCEPT SELECT * FROM bad) f ON f.fn = e.dst AND f.effect = b.effect),
down AS (SELECT fn AS root, effect, fn FROM root UNION SELECT d.root, d.effect, e.dst FROM down d JOIN edge e ON e.src = d.fn JOIN carry c ON c.fn = e.dst AND c.effect = d.effect),
span AS (SELECT fn AS root, effect, fn FROM root UNION SELECT s.root, s.effect, e.src FROM span s JOIN edge e ON e.dst = s.fn JOIN bad b ON b.fn = e.src AND b.effect = s.effect),
hoist AS (SELECT DISTINCT s.root, s.effect, e.src AS fn FROM span s JOIN edge e ON e.dst = s.fn ANTI JOIN bad b ON b.fn = e.src AND b.effect = s.effect),
above AS (SELECT h.root, h.effect, e.src AS fn FROM hoist h JOIN edge e ON e.dst = h.fn UNION SELECT a.root, a.effect, e.src FROM above a JOIN edge e ON e.dst = a.fn),
plan AS (SELECT effect, root, 'site' AS role, fn FROM down SEMI JOIN direct USING (fn, effect) UNION ALL SELECT effect, root, 'span', fn FROM span UNION ALL SELECT effect, root, 'hoist', fn FROM hoist
  UNION ALL SELECT effect, root, 'sandwiched', fn FROM above SEMI JOIN bad USING (fn, effect) UNION ALL SELECT effect, root, 'higher', fn FROM above ANTI JOIN bad USING (fn, effect) ANTI JOIN hoist USING (root, effect, fn))"""


def _layered(spark, sf):
    layer = table(spark, sf, "customer").select(F.col("c_custkey").alias("fn"), F.col("c_nationkey").alias("layer"))
    denied = spark.createDataFrame([(3, "Net"), (7, "Net"), (7, "Fs"), (11, "Net"), (11, "Fs")], "layer long, effect string")
    return edges(spark, sf), direct(spark, sf), layer, denied


@query("g15_hoist_plan", f"WITH RECURSIVE {EDGES}, {DIRECT}, {HOIST} SELECT * FROM plan")
def g15(spark, sf):
    return M.remedies(*_layered(spark, sf))


@query(
    "g15_options",
    f"WITH RECURSIVE {EDGES}, {DIRECT}, {HOIST} SELECT r.effect, r.fn AS root, CASE WHEN h.root IS NOT NULL AND s.root IS NULL THEN true ELSE false END AS clean_hoist, CASE WHEN h.root IS NOT NULL AND s.root IS NULL THEN 'hoist,relax' ELSE 'port,relax' END AS options"
    " FROM root r LEFT JOIN (SELECT DISTINCT root, effect FROM hoist) h ON h.root = r.fn AND h.effect = r.effect LEFT JOIN (SELECT DISTINCT root, effect FROM plan WHERE role = 'sandwiched') s ON s.root = r.fn AND s.effect = r.effect",
)
def g15_options(spark, sf):
    return M.root_options(*_layered(spark, sf)).withColumn("options", F.array_join("options", ","))


LOOPS = f"""{EDGES}, hop AS (SELECT src, dst FROM edge UNION SELECT c_custkey, c_custkey * 3 + 1 FROM customer WHERE c_custkey % 40 = 7), go AS (SELECT src, dst FROM hop UNION SELECT g.src, h.dst FROM go g JOIN hop h ON h.src = g.dst)"""


def _looped(spark, sf):
    """The call graph with calls back up, which close cycles of many sizes."""
    back = table(spark, sf, "customer").filter("c_custkey % 40 = 7").select(F.col("c_custkey").alias("src"), F.expr("c_custkey * 3 + 1").alias("dst"))
    return edges(spark, sf).unionByName(back).distinct()


@query("g04_components", f"WITH RECURSIVE {LOOPS}, n AS (SELECT src AS fn FROM hop UNION SELECT dst FROM hop) SELECT n.fn, least(n.fn, min(b.dst)) AS component FROM n LEFT JOIN (SELECT a.src, a.dst FROM go a JOIN go r ON r.src = a.dst AND r.dst = a.src) b ON b.src = n.fn GROUP BY n.fn")
def g04_components(spark, sf):
    return D.strong_components(_looped(spark, sf))


@query("w13_blindspots", f"WITH RECURSIVE {FACTS} SELECT d.fn, coalesce(n, 0) AS reach FROM direct d LEFT JOIN (SELECT dst, count(*) AS n FROM reach GROUP BY 1) ON dst = d.fn WHERE effect = 'Unknown'")
def w13(spark, sf):
    blind = direct(spark, sf).filter("effect = 'Unknown'").select("fn")
    n = G.callers(edges(spark, sf), blind).groupBy("fn").agg(F.count("*").alias("n"))
    return blind.join(n, "fn", "left").select("fn", F.coalesce("n", F.lit(0)).alias("reach"))


@query(
    "w04_greedy_links",
    "WITH RECURSIVE e AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY weight DESC, src, dst) AS i FROM (SELECT l_suppkey AS src, l_partkey AS dst, count(*) AS weight FROM lineitem GROUP BY ALL)),"
    " r AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS s, []::BIGINT[] AS d, []::BIGINT[] AS t UNION ALL SELECT j, CASE WHEN ok THEN list_append(s, src) ELSE s END, CASE WHEN ok THEN list_append(d, dst) ELSE d END, CASE WHEN ok THEN list_append(t, j) ELSE t END"
    " FROM (SELECT r.*, e.i AS j, e.src, e.dst, len(list_filter(s, lambda x: x = e.src)) < 9 AND len(list_filter(d, lambda x: x = e.dst)) < 7 AS ok FROM r JOIN e ON e.i = r.i + 1 WHERE len(t) < 300) q)"
    " SELECT src, dst, weight FROM e WHERE list_contains((SELECT arg_max(t, i) FROM r), i)",
)
def w04(spark, sf):
    o = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey")).alias("src"), F.col("l_partkey").alias("dst")).agg(F.count("*").alias("weight"))
    return G.greedy_links(o)


INC = "inc AS (SELECT c_custkey AS fn FROM customer WHERE c_acctbal < 0), callers AS (SELECT DISTINCT e.src AS fn FROM edge e JOIN inc ON inc.fn = e.dst)"


@query("o04_incomplete_propagates", f"WITH {EDGES}, {INC}, g AS (SELECT c_custkey AS fn, c_mktsegment AS grp FROM customer), n AS (SELECT grp, count(*) AS callers, count(*) FILTER (WHERE c.fn IN (SELECT fn FROM inc)) AS propagated FROM callers c JOIN g USING (fn) GROUP BY grp) SELECT s.grp, coalesce(callers, 0) AS callers, coalesce(propagated, 0) AS propagated, CASE WHEN coalesce(callers, 0) = 0 THEN 'UNMEASURED' WHEN callers = propagated THEN 'OK' ELSE 'LOST' END AS status FROM (SELECT DISTINCT grp FROM g) s LEFT JOIN n ON n.grp = s.grp")
def o04(spark, sf):
    group = table(spark, sf, "customer").select(F.col("c_custkey").alias("fn"), F.col("c_mktsegment").alias("grp"))
    return O.incomplete_propagates(edges(spark, sf), _fns(spark, sf, "c_acctbal < 0"), group)
