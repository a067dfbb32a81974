"""Hand-made fixtures: a seed that must fire and a control that must stay quiet for each check."""

import math
import random

from pyspark.sql import Row
from pyspark.sql import functions as F

from fathom.functions import scalars as S
from fathom.operators import audits as AU
from fathom.operators import bags as B
from fathom.operators import condensation as D
from fathom.operators import consistency as O
from fathom.operators import effects as E
from fathom.operators import graph as G
from fathom.operators import joins as J
from fathom.operators import ordering as W
from fathom.operators import policy as P
from fathom.operators import structure as T

A = "array<string>"


def one(df):
    return df.first().asDict()


def test_bag_difference_keeps_duplicates(spark):
    pre = spark.createDataFrame([("String::extend", "ambiguous:x")] * 5 + [("other", "")], "fn string, v string")
    post = spark.createDataFrame([("String::extend", "macro:x")] * 5 + [("other", "")], "fn string, v string")
    got = one(B.diff_counters(B.key_diff(pre, post, ["fn"], ["v"])))
    assert (got["changed_keys"], got["changed_rows"], got["added_keys"], got["removed_keys"]) == (1, 5, 0, 0)
    same = one(B.diff_counters(B.key_diff(pre, pre, ["fn"], ["v"])))
    assert not any(same.values())


def test_null_keys_meet(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    assert {r.side for r in B.align(df, df, ["k"]).collect()} == {"both"}
    assert B.set_changes(df.select("k", F.array("v").alias("x")), df.select("k", F.array("v").alias("x")), ["k"], "x").count() == 0


def test_field_losses(spark):
    pre = spark.createDataFrame([("f", ["Backend.size"], ["Fs"])], f"fn string, d {A}, e {A}")
    post = spark.createDataFrame([("f", None, ["Fs"])], f"fn string, d {A}, e {A}")
    assert [tuple(r) for r in B.element_losses(pre, post, ["fn"], ["d", "e"]).collect()] == [("d", 1, 1)]
    assert B.element_losses(post, pre, ["fn"], ["d", "e"]).count() == 0


def buckets(spark, pre, post):
    """Rows (fn, hash, inferred[, interface_union, invisible, dispatches_on]) of both arms -> the counts that are not 0."""
    schema = f"entry string, fn string, hash string, inferred {A}, interface_union boolean, invisible {A}, dispatches_on {A}"
    df = lambda rows: spark.createDataFrame([("e", *r, *[None, [], []][len(r) - 3 :]) for r in rows], schema)
    return {k: n for k, n in one(E.verdict_buckets(df(pre), df(post), ["entry", "fn", "hash"], ["entry", "fn"])).items() if n}


def test_buckets(spark):
    f = ("f", "h")
    assert buckets(spark, [], [(*f, ["Net"])]) == {"bucket_1": 1}
    assert buckets(spark, [], [(*f, ["Unknown"])]) == {"bucket_2": 1}
    assert buckets(spark, [], [(*f, [])]) == {"bucket_4": 1}
    assert buckets(spark, [(*f, ["Fs"])], []) == {"bucket_3": 1}
    assert buckets(spark, [(*f, ["Unknown"])], [(*f, [])]) == {"bucket_3u": 1}
    assert buckets(spark, [(*f, ["Fs"])], [(*f, ["Net"])]) == {"bucket_1": 1, "bucket_3": 1}
    assert buckets(spark, [(*f, ["Fs", "Unknown"])], [(*f, ["Fs"])]) == {"bucket_3u": 1}
    assert buckets(spark, [(*f, ["Net"])], [(*f, ["Net", "Unknown"])]) == {"bucket_4": 1}
    assert buckets(spark, [(*f, ["Net", "Unknown"])], []) == {"bucket_3": 1, "bucket_3u": 1}
    assert buckets(spark, [(*f, ["Net"])], [(*f, ["Net"])]) == {}


def test_bucket_drops_and_overlays(spark):
    assert buckets(spark, [], [("f", "h", ["Net"], True)]) == {"dropped_union": 1}
    assert buckets(spark, [], [("f", "h", ["Unknown"], True)]) == {"dropped_union": 1}
    assert buckets(spark, [("f", "h1", ["Net"])], [("f", "h1", ["Net"]), ("f", "h2", ["Net"])]) == {"dropped_red": 1}
    assert buckets(spark, [("f", "h1", ["Net"])], [("f", "h1", ["Net"]), ("f", "h2", ["Net", "Fs"])]) == {"bucket_1": 1}
    twice = [("f", "h", ["Net"]), ("f", "h", ["Net"])]
    assert buckets(spark, twice, twice[:1]) == {"bucket_3": 1}
    assert buckets(spark, [("f", "h", [], None, ["rayon"])], []) == {"bucket_3i": 1}
    assert buckets(spark, [("f", "h", ["Net"], None, [], ["B.size"])], [("f", "h", ["Net"])]) == {"bucket_3k": 1}


def test_bands(spark):
    flips = ", ".join(f"{f} int" for f in E.FLIPS)
    only_unknown, nothing = (1, *[0] * 7), (0,) * 8
    with_loss, removal = (1, 0, 0, 1, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0, 0, 0)
    rows = [(n, d, *only_unknown) for n, d in ((140, 10000), (150, 10000), (200, 10000), (260, 10000), (300, 10000), (1, None), (1, 0))]
    df = spark.createDataFrame([*rows, (0, 10, *nothing), (1, 10, *with_loss), (0, 10, *removal)], f"n int, d int, {flips}")
    assert [r.verdict for r in E.band(df, "n", "d").collect()] == ["SHIPS", "ASK", "ASK", "ASK", "DECLINED", "UNPRICED", "UNPRICED", "NO GATE MOVED", "ADDING PART ONLY", "DOES NOT APPLY"]


def test_gate_flips(spark):
    pre = spark.createDataFrame([("a", ["Net"]), ("b", ["Unknown", "~incomplete:x"]), ("c", ["Fs"]), ("gone", ["Db"])], f"fn string, tokens {A}")
    post = spark.createDataFrame([("a", ["Net", "Unknown"]), ("b", ["Fs", "~invisible:y"]), ("c", ["Fs"]), ("new", ["Db"])], f"fn string, tokens {A}")
    assert one(E.gate_flips(pre, post, ["fn"])) == {"adds_unknown": 1, "removes_unknown": 1, "adds_concrete": 2, "loses_concrete": 1, "adds_incomplete": 0, "loses_incomplete": 1, "adds_invisible": 1, "loses_invisible": 0}
    assert {tuple(r) for r in E.flips_by_effect(pre, post, ["fn"]).collect()} == {("0->1", "Fs", 1), ("0->1", "Db", 1), ("1->0", "Db", 1)}


def test_scope_ladder(spark):
    schema = "entry string, qual string, effect string"
    got = {r.level: r.n for r in J.scope_ladder(spark.createDataFrame([("e", "p.C.m", "Net")], schema), spark.createDataFrame([], schema), spark.createDataFrame([("e", "p.C.other", "Net")], schema)).collect()}
    assert got == {"function": 1, "class": 1, "package": 0, "artifact": 0, "lost": 0}


def test_palette_order(spark):
    units = spark.createDataFrame([(["Net", "Exec"],), (["Log", "Unknown"],), (["Mystery"],), ([],), (["Net", "Log", "Exec"],)], f"inferred {A}")
    assert [r.p for r in units.select(T.primary_effect(F.col("inferred")).alias("p")).collect()] == ["Exec", "Log", "Unknown", None, "Exec"]
    assert [(r.effect, r.n) for r in T.effect_order(units).orderBy("place").collect()] == [("Exec", 2), ("Net", 2), ("Log", 2)]


def test_loss_partition(spark):
    rows = [(["Fs"], [], []), (["Unknown"], [], ["x"]), ([], [], ["x"]), ([], [], []), ([], ["Fs"], [])]
    got = {r.kind: r["rows"] for r in E.loss_partition(spark.createDataFrame(rows, f"inferred {A}, incomplete {A}, invisible {A}")).collect()}
    assert got == {"concrete": 1, "unknown_only": 1, "invisible_only": 1, "nothing": 1, "incomplete_only": 1}


def test_tokens_and_triage(spark):
    df = spark.createDataFrame([(["Net", "Net"], ["Fs"], None)], f"a {A}, b {A}, c {A}")
    assert df.select(E.tokens(F.col("a"), F.col("b"), F.col("c")).alias("t")).first().t == ["Net", "~incomplete:Fs"]
    rows = [("judged_nothing", 0, 0, 0, 0, False), ("all_pure", 0, 0, 9, 9, False), ("seen", 3, 4, 3, 4, False), ("broke", 1, 1, 1, 1, True), ("one_arm", 2, None, 2, None, False)]
    got = {r.entry: r.status for r in E.triage(spark.createDataFrame(rows, "entry string, rows_pre int, rows_post int, analysed_pre int, analysed_post int, error boolean")).collect()}
    assert got == {"judged_nothing": "UNJUDGED", "all_pure": "ALL-PURE", "seen": "COMPARED", "broke": "ERROR", "one_arm": "UNJUDGED"}


def test_completeness(spark):
    x = "array<struct<class:string,peeked:boolean,judged_elsewhere:boolean>>"
    schema = f"refused boolean, incomplete boolean, unanalyzed {A}, judged_nothing {A}, excluded {x}, out_of_scope {A}, ok boolean, results int"
    rows = [
        (True, True, [], [], [], [], False, 0),
        (None, True, [], [], [], [], True, 0),
        (None, None, ["p"], [], [], [], True, 0),
        (None, None, [], [], [("new", False, None)], [], True, 0),
        (None, None, [], [], [("new", True, None), ("b", None, True)], [], True, 0),
        (None, None, [], [], None, ["f"], True, 0),
        (None, None, None, None, None, None, False, 0),
        (None, None, None, None, None, None, None, None),
    ]
    got = [r.completeness for r in E.completeness(spark.createDataFrame(rows, schema)).collect()]
    assert got == ["refused", "incomplete", "incomplete", "excluded", "complete", "out_of_scope", "incomplete", "complete"]


def test_structure_figures(spark):
    units = spark.createDataFrame([("alpha", ["Fs"]), ("beta", ["Fs"]), ("gamma", ["Net"]), ("hub", ["Net", "Db", "Clock"]), ("delta", ["Unknown"])], f"fn string, inferred {A}")
    edges = spark.createDataFrame([("alpha", "beta"), ("beta", "alpha"), ("gamma", "delta"), ("gamma", "hub")], "src string, dst string")
    got = one(T.structure(units, G.nodes_of(edges), edges, D.cyclic_nodes(edges)))
    assert math.isclose(got["density"], 0.7) and math.isclose(got["tangle"], 4 / 5 / 2.6) and math.isclose(got["smear"], 0.2) and math.isclose(got["cycle_ratio"], 0.4)
    assert round(got["structure"], 3) == 0.703
    mix = {r.effect: r.share for r in T.effect_mix(units).collect()}
    assert math.isclose(mix["Fs"], 2 / 7) and math.isclose(mix["Unknown"], 1 / 7)
    empty = one(T.structure(units.limit(0), G.nodes_of(edges), edges, D.cyclic_nodes(edges)))
    assert empty["structure"] is None
    delta = one(T.structure_delta(T.structure(units, G.nodes_of(edges), edges, D.cyclic_nodes(edges)), T.structure(units.limit(0), G.nodes_of(edges), edges, D.cyclic_nodes(edges))))
    assert delta["smear"] == 0.2 and delta["structure"] is None


def test_graph_against_brute_force(spark):
    rng = random.Random(1)
    pairs = {(rng.randrange(30), rng.randrange(30)) for _ in range(45)}
    reach = {a: {b for x, b in pairs if x == a} for a in range(30)}
    while any(new := {a: {c for b in r for c in reach[b]} - r for a, r in reach.items()}[a] for a in reach):
        for a in reach:
            reach[a] |= {c for b in list(reach[a]) for c in reach[b]}
        del new
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    closed, cut = G.closure(edges)
    assert not cut and {(r.src, r.dst) for r in closed.collect()} == {(a, b) for a, r in reach.items() for b in r}
    assert {r.fn for r in D.cyclic_nodes(edges).collect()} == {a for a in reach if a in reach[a]}
    nodes = {x for p in pairs for x in p}
    assert {r.fn: r.blast for r in D.blast(edges).collect()} == {n: sum(n in r for r in reach.values()) for n in nodes}
    assert G.closure(edges, budget=10)[1]
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    assert {r.fn: r.blast for r in D.blast(chain).collect()} == {i: i for i in range(13)} and D.cyclic_nodes(chain).count() == 0
    none = edges.limit(0)
    assert D.blast(none).count() == 0 and D.cyclic_nodes(none).count() == 0


def test_closures_of_any_size_are_whole(spark, monkeypatch):
    """No caller stops early, however many pairs there seem to be."""
    n = 8
    ring = spark.createDataFrame([(i, (i + 1) % n) for i in range(n)], "src long, dst long")
    some = lambda *fns: spark.createDataFrame([(f,) for f in fns], "fn long")
    count = type(ring).count
    monkeypatch.setattr(type(ring), "count", lambda df: count(df) * 10**9)
    assert {(r.caller, r.hops) for r in G.callers(ring, some(0)).collect()} == {((n - h) % n, h) for h in range(1, n + 1)}
    assert [tuple(r) for r in G.forbidden(ring, some(0), some(n - 1)).collect()] == [(0, n - 1, n - 1)]
    assert [tuple(r) for r in AU.only_reaches(ring, some(0, 1), some(n - 1), some(1)).collect()] == [(0, n - 1)]


def test_paths_and_fixpoint(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c2"), ("c2", "c"), ("x", "x")], "src string, dst string")
    target = spark.createDataFrame([("c",)], "fn string")
    assert {r.fn: (r.hops, r["next"]) for r in G.next_hops(edges, target).collect()} == {"c": (0, None), "b": (1, "c"), "c2": (1, "c"), "a": (2, "b")}
    facts = spark.createDataFrame([("c", "reflect"), ("x", "native")], "fn string, fact string")
    assert {(r.fn, r.fact) for r in G.propagated(edges, facts).collect()} == {(n, "reflect") for n in ("a", "b", "c", "c2")} | {("x", "native")}


def test_change_depths(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "d")], "src string, dst string")
    f = "fn string, effect string"
    got = G.change_depths(edges, spark.createDataFrame([("c", "Net"), ("d", "Fs"), ("b", "Fs"), ("a", "Db")], f), spark.createDataFrame([("a", "Net"), ("a", "Fs"), ("a", "Fs"), ("c", "Net"), ("b", "Exec"), ("zz", "Net")], f))
    assert sorted((r.fn, r.effect, -1 if r.hops is None else r.hops) for r in got.collect()) == [("a", "Fs", 1), ("a", "Net", 2), ("b", "Exec", -1), ("c", "Net", 0), ("zz", "Net", -1)]


def test_greedy_links(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(8), rng.randrange(8), rng.randrange(50)) for _ in range(150)]
    taken, out, into = [], {}, {}
    for s, d, w in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if len(taken) < 30 and out.get(s, 0) < 4 and into.get(d, 0) < 3:
            taken.append((s, d, w))
            out[s], into[d] = out.get(s, 0) + 1, into.get(d, 0) + 1
    df = spark.createDataFrame(list({(s, d): (s, d, w) for s, d, w in rows}.values()), "src long, dst long, weight long")
    unique = [tuple(r) for r in df.collect()]
    taken, out, into = [], {}, {}
    for s, d, w in sorted(unique, key=lambda r: (-r[2], r[0], r[1])):
        if len(taken) < 30 and out.get(s, 0) < 4 and into.get(d, 0) < 3:
            taken.append((s, d, w))
            out[s], into[d] = out.get(s, 0) + 1, into.get(d, 0) + 1
    assert [tuple(r) for r in G.greedy_links(df, 4, 3, 30, chunk=10).collect()] == taken


def verdict(spark, rows):
    df = spark.createDataFrame([(w, i, c, t, s[0] if s else "completed") for i, (w, c, t, *s) in enumerate(rows)], "workflow string, ordinal int, conclusion string, created string, status string")
    got = {r.verdict for r in W.ci_verdict(df).collect()}
    return "BAD" if "BAD" in got else "OK" if got else "NONE"


def test_ci_verdicts(spark):
    assert verdict(spark, []) == "NONE"
    assert verdict(spark, [("w", "failure", "2"), ("w", "success", "1")]) == "BAD"
    assert verdict(spark, [("w", "success", "10:05"), ("w", "failure", "10:00")]) == "OK"
    assert verdict(spark, [("w", "skipped", "10:05"), ("w", "failure", "10:00")]) == "BAD"
    assert verdict(spark, [("w", "cancelled", "10:05"), ("w", "failure", "10:00")]) == "BAD"
    assert verdict(spark, [("w", "success", "1"), ("w", "failure", "1")]) == "BAD"
    assert verdict(spark, [("w", "cancelled", "1"), ("w", "success", "1")]) == "OK"
    assert verdict(spark, [("w", "skipped", "2"), ("w", "cancelled", "1")]) == "OK"
    assert verdict(spark, [("w", "cancelled", "2"), ("w", "skipped", "1")]) == "BAD"
    assert verdict(spark, [("1", "success", "2"), ("2", "failure", "1")]) == "BAD"
    assert verdict(spark, [("w", None, "2", "in_progress"), ("w", "success", "1")]) == "BAD"
    assert verdict(spark, [("w", "", "2", "queued"), ("w", "success", "1")]) == "BAD"
    assert verdict(spark, [("w", "failure", None)]) == "BAD" and verdict(spark, [("w", "success", None), ("w", "failure", "1")]) == "OK"
    assert verdict(spark, [("w", "success", None), ("w", "failure", None)]) == "BAD" and verdict(spark, [("w", None, None, None)]) == "BAD"
    two = spark.createDataFrame([("w", 0, "failure", "1"), ("w", 1, "timed_out", "1")], "workflow string, ordinal int, conclusion string, created string")
    assert [(r.conclusion, r.verdict) for r in W.ci_verdict(two).collect()] == [("timed_out", "BAD")]


def test_newest_elsewhere(spark):
    rows = [("ok", 0, "b", "completed", "success", False), ("ok", 1, "a", "completed", "failure", False), ("head", 0, "h", "completed", "failure", False), ("head", 1, "a", "completed", "failure", False), ("going", 0, "a", "in_progress", None, False), ("going", 1, "a", "completed", "failure", False)]
    rows += [("push", 0, "a", "completed", "cancelled", True), ("killed", 0, "a", "completed", "cancelled", False), ("unknown", 0, "a", "completed", "cancelled", None), ("bare", 0, None, "completed", None, True)]
    got = W.newest_elsewhere(spark.createDataFrame(rows, "workflow string, ordinal int, sha string, status string, conclusion string, cancels boolean"), "h")
    assert {r.workflow: r.state for r in got.collect()} == {"push": "pending", "killed": "red", "unknown": "red", "bare": "red"}


def test_prefixes_versions_samples(spark):
    prefix = lambda *names: W.common_prefix(spark.createDataFrame([("k", n) for n in names], "k string, n string"), ["k"], "n").first().prefix
    assert prefix("a.b.c", "a.b.d.e", "a.bb", "lone") == "a" and prefix("a.b.c", "a.b.c.d") == "a.b" and prefix("a.b.c", "a.b.d") == "a.b"
    v = spark.createDataFrame([("e", x) for x in ("0.9.10", "0.10.2", "bad", "0.10")], "engine string, version string")
    assert W.newest_version(v, ["engine"], "version").first().newest == "0.10.2"
    rows = spark.createDataFrame([("k", i) for i in range(11)], "k string, i int")
    assert sorted(r.i for r in W.stride_sample(rows, ["k"], "i", 3).collect()) == [0, 3, 6]
    assert sorted(r.i for r in W.stride_sample(rows.limit(2), ["k"], "i", 3).collect()) == [0, 1]
    assert W.lower_median(spark.createDataFrame([("k", i) for i in (1, 2, 3, 4)], "k string, v int"), ["k"], "v").first().median == 2


def test_identity_ladder(spark):
    units = spark.createDataFrame([("run", "a#run", "a:3"), ("run", "b#run", "b:7"), ("src.a.go", "src#go", "1"), ("src.b.go", "src#go", "2"), ("go", "x#go", "3"), ("go", "x#go", "4"), ("lone", None, "5")], "fn string, hash string, loc string")
    asked = [(1, "run", "a#run", "a:3"), (2, "run", "b#run", "b:7"), (3, "src.b.go", "src#go", "2"), (4, "other", "src#go", None), (5, "go", "x#go", None), (6, "lone", None, "5"), (7, "run", None, None), (8, "moved", "a#run", "a:3")]
    got = {r.id: r["loc"] for r in J.identity_ladder(spark.createDataFrame([a[:3] for a in asked], "id int, fn string, hash string"), units).collect()}
    assert got == {a[0]: a[3] for a in asked}


def test_prefix_joins(spark):
    names = spark.createDataFrame([("a.b.c",), ("a.bc.d",), ("z",), ("a",)], "name string")
    prefixes = spark.createDataFrame([("a",), ("a.b",)], "prefix string")
    assert {r.name: r.prefix for r in J.longest_prefix(names, prefixes).collect()} == {"a.b.c": "a.b", "a.bc.d": "a", "z": "(default)", "a": "(default)"}
    lib = spark.createDataFrame([("a.b",)], "name string")
    assert {r.name for r in J.related_names(names, lib).collect()} == {"a.b.c", "a"}


def test_scope_and_policy(spark):
    df = spark.createDataFrame([("com.app.domain.User.save", ["Db"]), ("com.app.domain2.X.y", ["Net"]), ("com.application.X", ["Net"]), ("org.y", ["Unknown"]), ("org.z", [])], f"fn string, inferred {A}")
    rules = P.parse_policy(spark, "deny Db,Net com.app.domain # comment\npure org\n\nforbid a -> b\nonly a -> b c\nallow Net in x h1,h2\ndeny Unknown[reflect] org")
    assert [r.kind for r in rules.orderBy("ordinal").collect()] == ["deny", "pure", "forbid", "only", "allow", "deny"]
    got = {(r.ordinal, r.fn, tuple(r.effects)) for r in P.violations(df, rules).collect()}
    assert got == {(0, "com.app.domain.User.save", ("Db",)), (0, "com.app.domain2.X.y", ("Net",)), (1, "org.y", ("Unknown",))}
    classed = df.withColumn("classes", F.array(F.lit("reflect")))
    assert (5, "org.y") in {(r.ordinal, r.fn) for r in P.violations(classed, rules).collect()}
    many = P.parse_policy(spark, "\n".join(f"deny Db com.app.d{i}" for i in range(300)) + "\ndeny Db com.app.domain.Us\npure com.app.domain.User.save.x\npure .com\ndeny Net")
    assert {(r.ordinal, r.fn) for r in P.violations(df, many).collect()} == {(300, "com.app.domain.User.save"), (303, "com.app.domain2.X.y"), (303, "com.application.X")}
    assert P.unverified(df, P.parse_policy(spark, "deny Net org")).first().fn == "org.y"
    for bad in ("deny", "deny nothing", "deny com.app", "deny Unknown[] x", "forbid a b", "forbid -> b", "only a ->", "allow Net x", "permit Net"):
        assert P.gate(df, f"pure zzz\n{bad}") == 2
    assert (P.gate(df, "deny Db com.app"), P.gate(df, "deny Fs # none\n# nothing"), P.gate(df, "")) == (1, 0, 0)
    accepts = P.parse_policy(spark, "accept NAME#1 x # why\ndeny Net Db a#b").collect()
    assert (accepts[0].scope, accepts[1].scope, accepts[1].effects) == ("NAME#1 x", "a", ["Net", "Db"])
    assert (P.exit_code(0), P.exit_code(3), P.exit_code(None), P.exit_code(0, False)) == (0, 1, 2, 2)


def test_ratchet_and_proposal(spark):
    now = spark.createDataFrame([("old", "Net"), ("new", "Unknown"), ("new2", "Fs")], "fn string, effect string")
    base = spark.createDataFrame([("old", "Fs")], "fn string, effect string")
    got = {(r.fn, r.effect): (r.origin, r.fails) for r in P.ratchet(now, base, base.select("fn")).collect()}
    assert got == {("old", "Net"): ("existing", True), ("new", "Unknown"): ("new", False), ("new2", "Fs"): ("new", True)}
    profile = spark.createDataFrame([("domain", 5, []), ("io", 3, ["Net"]), ("iox", 3, []), ("web", 3, ["Unknown"]), ("mixed", 3, ["Net", "Unknown"]), ("tiny", 0, [])], f"layer string, fns int, effects {A}")
    lines = {r.line for r in P.policy_text(P.propose(profile)).collect()}
    assert lines == {"pure domain", "deny Db,Fs,Exec,Ipc,Clipboard mixed", "pure iox"}
    example = spark.createDataFrame([(f"o{i}", "owner", "Db") for i in range(14)] + [(f"v{i}", "vet", "Db") for i in range(4)], "fn string, layer string, effect string")
    row = P.containment(example).first()
    assert (row.owner, row.percent, row.fns) == ("owner", 77, 18)


def test_what_if(spark):
    edges = spark.createDataFrame([("domain.a", "io.b")], "src string, dst string")
    units = spark.createDataFrame([("domain.a", []), ("io.b", [])], f"fn string, inferred {A}")
    got = P.what_if(edges, spark.createDataFrame([("io.b",)], "fn string"), "Net", units, P.parse_policy(spark, "pure domain")).collect()
    assert [(r.fn, r.effects) for r in got] == [("domain.a", ["Net"])]


def test_self_consistency_seeds(spark):
    names = ("direct", "inferred", "unknown_why", "hosts", "cmds", "paths", "tables")
    seeds = {
        "hosts_without_net": {"hosts": ["h"]},
        "cmds_without_exec": {"cmds": ["c"]},
        "paths_without_fs": {"paths": ["p"]},
        "tables_without_db": {"tables": ["t"]},
        "why_without_unknown": {"unknown_why": ["w"]},
        "direct_not_inferred": {"direct": ["Net"]},
    }
    schema = "entry string, fn string, " + ", ".join(f"{n} {A}" for n in names)
    rows = [(rule, "f", *[seed.get(n, []) for n in names]) for rule, seed in seeds.items()] + [("clean", "f", *[["Net", "Exec", "Fs", "Db", "Unknown"]] * 2, ["w"], ["h"], ["c"], ["p"], ["t"]), ("few", "f", *[[]] * 7), ("few", "g", *[[]] * 7)]
    reports = spark.createDataFrame([("few", 1), ("clean", 1)], "entry string, analysed int")
    got = [(r.entry, r.rule) for r in O.self_consistency(spark.createDataFrame(rows, schema), reports).collect()]
    assert sorted(got) == sorted([(rule, rule) for rule in seeds] + [("few", "fewer_analysed_than_rows")])


def test_monotone_and_disjoint(spark):
    before = spark.createDataFrame([("a", ["Unknown"]), ("b", ["Unknown"]), ("c", ["Fs"]), ("d", []), ("e", [])], f"fn string, inferred {A}")
    after = spark.createDataFrame([("a", ["Net"]), ("b", []), ("e", ["Net"])], f"fn string, inferred {A}")
    assert {(r.fn, r.after) for r in O.weakened(before, after, ["fn"]).collect()} == {("b", "empty"), ("c", "absent")}
    n = spark.createDataFrame([(4, 2, 6), (4, 2, 5), (483, 0, 483), (4, None, 6)], "x int, u int, xu int")
    assert [r.status for r in O.disjoint(n, "x", "u", "xu").collect()] == ["DISJOINT", "OVERLAP", "VACUOUS", "UNMEASURED"]
    assert O.chain_only_adds(before, after, ["fn"]).first().status == "SHRANK"
    assert O.chain_only_adds(before, before, ["fn"]).first().status == "VACUOUS"
    assert O.chain_only_adds(before.limit(0), after, ["fn"]).first().status == "NOTHING SHARED"


def test_ledger(spark, monkeypatch):
    found = spark.createDataFrame([("crate x lost Net",), ("crate y lost Fs",)], "text string")
    known = spark.createDataFrame([("crate x", "Net"), ("crate z", "Db")], "part_a string, part_b string")
    fresh, unused = O.ledger(found, known)
    assert [r.text for r in fresh.collect()] == ["crate y lost Fs"] and [r.part_a for r in unused.collect()] == ["crate z"]
    monkeypatch.setattr(O, "LEDGER_TURN", 1)
    fresh, unused = O.ledger(found, known)
    assert [r.text for r in fresh.collect()] == ["crate y lost Fs"] and [r.part_a for r in unused.collect()] == ["crate z"]


def test_scalars(spark):
    df = spark.createDataFrame([Row(x=1)])
    value = lambda c: df.select(c.alias("v")).first().v
    assert value(S.fnv1a32(F.lit("Net:6|u3"))) == 3249404880 and value(S.fnv1a32(F.lit(""))) == 2166136261
    for text, bare in {"Ty::m(Ty)": "Ty::m", "a.B.m(byte[])": "a.B.m", "p.M.hmac(a.b.C)#2": "p.M.hmac", "NAME#1": "NAME", "row::convert::(T1,T2)::from_row_opt": "row::convert::(T1,T2)::from_row_opt", "(T1,T2)::f": "(T1,T2)::f", "plain": "plain", "a::<T as X<(A,B)>>::m(Y)": "a::<T as X<(A,B)>>::m", "row::(T1,T2)": "row::(T1,T2)", "row::(T1,T2)#3": "row::(T1,T2)", "a.(x)": "a.(x)", "f(": "f(", "(x)": "(x)"}.items():
        assert value(S.bare_path(F.lit(text))) == bare
    for text, name in {"ambiguous:same-name": "dispatch", "callback:cb": "indirect", "macro:unreadable": "unresolved", "  REFLECT:y": "reflect", "no-tsconfig": "setup", "native:ffi": "native", "": "unresolved", "closure:x": "indirect", "task-handoff": "indirect", "no-body": "unresolved", "indirect": "unresolved", "indy": "dispatch", "\tdynamicMemberLookup": "reflect"}.items():
        assert value(S.reason_class(F.lit(text))) == name
    assert tuple(value(S.parse_location(F.lit("a/b.rs:3:7: 4:9")))) == ("a/b.rs", 3, 7, 4, 9)
    assert tuple(value(S.parse_location(F.lit("File.java")))) == ("File.java", None, None, None, None) and value(S.parse_location(F.lit(" "))) is None
    assert tuple(value(S.parse_location(F.lit("f.rs:10:1:  10:9")))) == ("f.rs", 10, 1, 10, 9)
    assert tuple(value(S.parse_location(F.lit("a.rs:12")))) == ("a.rs", 12, None, None, None)
    assert value(S.canonical_json({"b": F.lit("x\"y"), "a": F.lit(None).cast("int"), "c": F.array(F.lit(1))})) == '{"a":null,"b":"x\\"y","c":[1]}'
    assert value(S.suggestion(F.lit("polcy"), ["scan", "policy"])) == "policy" and value(S.suggestion(F.lit("zzzzzz"), ["scan"])) is None
    assert value(S.age_bucket(F.lit(7200))) == "2h" and value(S.layer_of(F.lit("a.b.c.d"), 2)) == "c" and value(S.layer_of(F.lit("a.b.c"), 2)) is None


def test_roster_and_globs(spark):
    roster = spark.createDataFrame([("ok", 30, "s"), ("gone", 30, "s"), ("sha", 30, "s"), ("half", 100, "s"), ("drift", 30, "s")], "name string, want int, sha string")
    measured = spark.createDataFrame([("ok", 30, "s"), ("sha", 30, "t"), ("half", 49, "s"), ("drift", 31, "s")], "name string, got int, sha string")
    assert {r.name: r.status for r in J.roster_check(roster, measured).collect()} == {"ok": "OK", "gone": "MISSING", "sha": "SHA", "half": "COLLAPSED", "drift": "DRIFT"}
    paths = spark.createDataFrame([("src/a/b.rs",), ("src/b.rs",), ("x.md",)], "path string")
    assert {(r.path, r.glob) for r in J.matching_paths(paths, ["src/**/*.rs", "*.md", "src/*"]).collect()} == {("src/a/b.rs", "src/**/*.rs"), ("src/b.rs", "src/*"), ("x.md", "*.md")}
