import random

import pytest
from pyspark.sql import functions as F

from fathom.operators import audits as X
from fathom.operators import graph as G
from fathom.operators import remedies as M

U = "entry string, fn string, inferred array<string>, classes array<string>"


def test_canary(spark):
    """Sound only if every class has seeds, and each gets its class."""
    e, a = "src string, dst string", "fn string, tokens array<string>"
    seeds = spark.createDataFrame([("s1", [], "C1"), ("s2", [], "C2"), ("s3", [], "C3"), ("s4", ["Net"], "R")], f"{a}, expected string")
    pre = spark.createDataFrame([(f"s{i}", "base") for i in (1, 2, 3, 4)], e)
    post = spark.createDataFrame([(f"s{i}", "base") for i in (1, 2, 3, 4)] + [("s1", "plain"), ("s2", "deep"), ("deep", "elsewhere")], e)
    nodes = spark.createDataFrame([(n,) for n in ("s1", "s2", "s3", "s4", "base", "plain", "deep")], "fn string")
    rows = spark.createDataFrame([], a)
    table = lambda s: {r["class"]: (r.seeded, r.found, r.sound) for r in X.canary(s, pre, post, nodes, rows).collect()}
    assert table(seeds) == dict.fromkeys(X.CLASSES, (1, 1, True))
    assert table(seeds.filter("fn <> 's4'"))["R"] == (0, 0, False)
    assert table(seeds.withColumn("expected", F.lit("C1")))["C1"] == (4, 1, False)


def flips(spark, pre, post):
    rows = X.arm_flips(spark.createDataFrame([("e", *r) for r in pre], U), spark.createDataFrame([("e", *r) for r in post], U)).collect()
    return {(r.fn, r.rule, r.direction, r.unknown_kept, r.member) for r in rows}


def test_flips_at_bare_paths(spark):
    split = flips(spark, [("Ty::m", ["Fs"], [])], [("Ty::m(Ty)", ["Fs"], []), ("Ty::m(Tr)", [], [])])
    assert split == set()
    gone = flips(spark, [("Ty::m", ["Fs"], [])], [("Ty::m(Ty)", [], []), ("Ty::m(Tr)", [], [])])
    assert gone == {("Ty::m", "deny Fs", "1->0", False, False)}
    moved = flips(spark, [("T::m(A)", ["Fs"], []), ("T::m(B)", [], [])], [("T::m(A)", [], []), ("T::m(B)", ["Fs"], [])])
    assert moved == {("T::m(A)", "deny Fs", "1->0", False, True)}
    kept = flips(spark, [("sym", ["Unknown"], ["unresolved", "dispatch"])], [("sym", ["Unknown"], ["dispatch"])])
    assert kept == {("sym", "deny Unknown[unresolved]", "1->0", True, False)}
    assert flips(spark, [], [("n", ["Net"], None)]) == {("n", "deny Net", "0->1", False, False)}


def test_root_causes(spark):
    e, f = "src string, dst string", "fn string, effect string"
    pre = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("a", "k"), ("c", "b")], e)
    head = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "k"), ("c", "b")], e)
    had = spark.createDataFrame([(n, "Net") for n in "abcdk"], f)
    has = spark.createDataFrame([("k", "Net"), ("d", "Net")], f)
    own = spark.createDataFrame([("c", "Net"), ("d", "Net"), ("k", "Net")], f)
    got = {(r.kind, r.root, r.callee) for r in X.root_causes(spark.createDataFrame([("a", "Net")], f), pre, head, had, has, own).collect()}
    assert got == {("OWN", "c", None), ("LOSTEDGE", "a", "d"), ("UNPROPAGATED", "a", "k")}


def brute_causes(lost, pre, head, had, has, own, unions):
    """The documented rules, one lost pair at a time."""
    out = set()
    for fn, x in lost:
        path, front, links, found = {fn: ()}, [fn], set(), set()
        while True:
            while front:
                nxt = {}
                for at in front:
                    if (at, x) in own:
                        found.add((fn, x, "OWN", at, None, path[at]))
                    for c in {d for s, d in pre if s == at and (d, x) in had}:
                        if (at, c) not in head:
                            found.add((fn, x, "LOSTEDGE", at, c, path[at]))
                        elif (c, x) in has:
                            found.add((fn, x, "UNPROPAGATED", at, c, path[at]))
                        else:
                            links.add((at, c))
                            if c not in path:
                                nxt[c] = min(nxt.get(c, (*path[at], c)), (*path[at], c))
                path |= nxt
                front = sorted(nxt)

            def above(some):
                some = set(some)
                while more := {a for a, b in links if b in some} - some:
                    some |= more
                return some

            barren = (set(path) & unions) - above(r for _, _, _, r, _, _ in found)
            opens = {(u, g) for u in barren if "." in u for g, y in had if y == x and (g, x) not in has and g != u and g.endswith("." + u.split(".", 1)[1]) and g not in path}
            last = {(u, g) for u, g in opens if u not in {a for a, b in links if b in above(v for v, _ in opens)}}
            if opens and not last:
                last = {(u, g) for u, g in opens if u == min(v for v, _ in opens)}
            if not last:
                break
            nxt = {}
            for u, g in last:
                found.add((fn, x, "UNION", u, g, path[u]))
                links.add((u, g))
                way = (*path[u], "U:" + g)
                nxt[g] = min(nxt.get(g, way), way, key=lambda w: (len(w), w))
            path |= nxt
            front = sorted(nxt)
        out |= found
    return out


@pytest.mark.parametrize("seed", range(2))
def test_root_causes_through_unions(spark, seed):
    rng = random.Random(seed)
    names = [f"T{i}.m{j}" for i in range(4) for j in range(6)] + ["plain", "T9.x.m1"]
    pre = {(rng.choice(names), rng.choice(names)) for _ in range(26)}
    head = {e for e in pre if rng.random() < 0.8}
    had = {(n, "Net") for n in names if rng.random() < 0.8}
    has = {p for p in had if rng.random() < 0.25}
    own = {p for p in had if rng.random() < 0.15}
    unions = {n for n in names if n.startswith(("T0", "T1"))}
    lost = sorted(had - has)[:12]
    e, f = "src string, dst string", "fn string, effect string"
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    got = X.root_causes(frame(lost, f), frame(pre, e), frame(head, e), frame(had, f), frame(has, f), frame(own, f), frame([(u,) for u in unions], "fn string")).collect()
    want = brute_causes(lost, pre, head, had, has, own, unions)
    assert len(got) == len(want) and {(r.fn, r.effect, r.kind, r.root, r.callee, tuple(r.path)) for r in got} == want
    assert any(r.kind == "UNION" for r in got)


def plan(spark, edges, direct, denied):
    names = sorted({x for p in edges for x in p})
    e = spark.createDataFrame(edges, "src string, dst string")
    layer = spark.createDataFrame([(n, n.split(".")[0]) for n in names], "fn string, layer string")
    return M.remedies(e, spark.createDataFrame(direct, "fn string, effect string"), layer, spark.createDataFrame(denied, "layer string, effect string"))


def test_remedies(spark):
    out = plan(spark, [("api.quote", "domain.price"), ("main.run", "api.quote"), ("domain.price", "domain.rate"), ("domain.rate", "infra.fetch"), ("main.run", "infra.fetch")], [("infra.fetch", "Net")], [("domain", "Net")])
    assert {(r.root, r.role, r.fn) for r in out.collect()} == {("domain.rate", *x) for x in (("site", "infra.fetch"), ("span", "domain.rate"), ("span", "domain.price"), ("hoist", "api.quote"), ("higher", "main.run"))}
    assert [tuple(r) for r in M.remedy_options(out).collect()] == [("Net", "domain.rate", True, ["hoist", "relax"])]
    assert {(r.fn, r.roots) for r in M.inheritors(out).collect()} == {("domain.rate", 1), ("domain.price", 1)}


def test_remedies_that_are_not_clean(spark):
    """No caller that may; a layer that may between two that may not; several sites, targets and effects; a cycle."""
    alone = plan(spark, [("d.top", "d.mid"), ("d.mid", "d.own")], [("d.own", "Fs")], [("d", "Fs"), ("d", "Net")])
    assert [tuple(r) for r in M.remedy_options(alone).collect()] == [("Fs", "d.own", False, ["port", "relax"])]
    between = plan(spark, [("d.outer", "a.f"), ("a.f", "d.inner"), ("d.inner", "io.x"), ("main.m", "d.outer")], [("io.x", "Net")], [("d", "Net")])
    assert {(r.role, r.fn) for r in between.filter("root = 'd.inner'").collect()} == {("site", "io.x"), ("span", "d.inner"), ("hoist", "a.f"), ("sandwiched", "d.outer"), ("higher", "main.m")}
    assert {r.root: r.clean_hoist for r in M.remedy_options(between).collect()} == {"d.inner": False, "d.outer": True}
    several = plan(spark, [("d.a", "io.x"), ("d.a", "io.y"), ("d.a", "d.b"), ("d.b", "d.a"), ("p.1", "d.a"), ("p.2", "d.b"), ("p.3", "p.1"), ("p.1", "p.3")], [("io.x", "Net"), ("io.y", "Net"), ("io.y", "Fs"), ("d.b", "Net")], [("d", "Net"), ("p", "Db")])
    got = {(r.effect, r.root, r.role, r.fn) for r in several.collect()}
    assert {x[1:] for x in got if x[1] == "d.a"} == {("d.a", *x) for x in (("site", "io.x"), ("site", "io.y"), ("site", "d.b"), ("span", "d.a"), ("span", "d.b"), ("hoist", "p.1"), ("hoist", "p.2"), ("higher", "p.3"))}
    assert {x[0] for x in got} == {"Net"} and {x[1] for x in got} == {"d.a", "d.b"}
    assert plan(spark, [("a.x", "b.y")], [("b.y", "Net")], [("d", "Net")]).isEmpty()


def test_status_queries(spark):
    s = spark.createDataFrame([(1, 0, 1, 1), (2, 0, 0, 1)], "category int, bare_pre int, bare_post int, wide_post int")
    assert X.predictions(s).first().status == "OK" and X.predictions(s.filter("category = 2")).first().status == "NOTHING VALIDATED"
    t = "key string, text string, verdict int"
    base, seeded = spark.createDataFrame([("k", "quiet", 0)], t), spark.createDataFrame([("k", "SEED here", 1)], t)
    assert X.seeded_sensitivity(base, seeded, "SEED").first().status == "OK"
    assert X.seeded_sensitivity(base, base, "SEED").first().status == "NOT SEEN"
    assert X.seeded_sensitivity(base, seeded.withColumn("verdict", F.lit(0)), "SEED").first().status == "VERDICT DID NOT MOVE"
    n, none = base, base.limit(0)
    assert [X.evidence(*x).first().status for x in ((none, none, none), (n, none, none), (n, none, n), (n, n, none))] == [3, 4, 0, 0]
    assert X.probes_read(spark.createDataFrame([("t", 3, 0)], "table string, declared int, read int")).first().status == "REFUSED"
    assert X.seeded_sensitivity(seeded, seeded, "SEED").first().status == "SEEN WITHOUT SEED"


def test_change_detection(spark):
    at = "2026-01-02 00:00:00"
    now = spark.createDataFrame([(None, at, "s"), ("new", at, "s"), ("same", at, "s"), ("later", "2026-01-04 00:00:00", "s"), ("other", at, "t"), ("ahead", at, "s")], "tree string, modified string, signature string").withColumn("modified", F.col("modified").cast("timestamp"))
    stamps = spark.createDataFrame([(n, "2026-01-03 00:00:00" if n != "ahead" else "2027-01-01 00:00:00", "s") for n in ("same", "later", "other", "ahead")], "tree string, stamped string, signature string").withColumn("stamped", F.col("stamped").cast("timestamp"))
    got = {r.tree: r.reason for r in X.to_run(now, stamps, "2026-02-01 00:00:00").collect()}
    assert got == {None: "unnamed", "new": "never passed", "later": "modified", "other": "content", "ahead": "future stamp"}


def test_options_without_plans(spark):
    """The same as the options of the whole plans, loops included."""
    rng = random.Random(5)
    names = [f"{layer}.f{i}" for layer in "abc" for i in range(8)]
    edges = sorted({(rng.choice(names), rng.choice(names)) for _ in range(34)} | {("c.top", "a.leaf"), ("c.top", "a.stem"), ("a.stem", "a.leaf")})
    names += ["c.top", "a.leaf", "a.stem"]
    args = (
        spark.createDataFrame(edges, "src string, dst string"),
        spark.createDataFrame([(n, x) for n in names for x in ("Net", "Fs") if n == "a.leaf" or rng.random() < 0.15], "fn string, effect string"),
        spark.createDataFrame([(n, n[0]) for n in names], "fn string, layer string"),
        spark.createDataFrame([("a", "Net"), ("b", "Fs"), ("b", "Net")], "layer string, effect string"),
    )
    rows = lambda df: {(r.effect, r.root, r.clean_hoist, tuple(r.options)) for r in df.collect()}
    got = rows(M.root_options(*args))
    assert got == rows(M.remedy_options(M.remedies(*args))) and {c for _, _, c, _ in got} == {True, False}


@pytest.mark.parametrize("few", ["source", "target"])
def test_only_reaches_from_either_end(spark, few):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 4), (6, 6)], "src long, dst long")
    fns = lambda *ns: spark.createDataFrame([(n,) for n in ns], "fn long")
    source, target = (fns(2), fns(1, 4, 6)) if few == "source" else (fns(1, 2, 3, 5, 6), fns(4))
    got = sorted(tuple(r) for r in X.only_reaches(edges, source, target, fns(5)).collect())
    assert got == ([(2, 1), (2, 4)] if few == "source" else [(1, 4), (2, 4), (3, 4)])


def test_loops_send_no_tables_through_the_driver(spark):
    """Small as they look, what loops have written is joined by sorting."""
    from fathom.operators.graph import _union, written

    a, b = written(spark.range(5)), written(spark.range(3))
    for frame in (a.join(b, "id"), spark.range(5).join(_union([a, b]), "id", "left_anti"), spark.range(5).join(b.filter("id > 0"), "id")):
        assert "Broadcast" not in frame._jdf.queryExecution().executedPlan().toString()


def test_root_causes_take_several_calls_a_job(spark, monkeypatch):
    """A deep loss is followed in few jobs, and to its end."""
    writes, written = [], X.written
    monkeypatch.setattr(X, "written", lambda df: writes.append(1) or written(df))
    names = [f"f{i:02}" for i in range(14)]
    had = spark.createDataFrame([(n, "Net") for n in names], "fn string, effect string")
    calls = spark.createDataFrame(list(zip(names, names[1:])), "src string, dst string")
    out = X.root_causes(had.filter("fn = 'f00'"), calls, calls, had, had.limit(0), had.filter("fn = 'f13'"))
    assert [(r.kind, r.root, r.path) for r in out.collect()] == [("OWN", "f13", names[1:])]
    assert len(writes) < 14


def test_unions_behind_unions_take_few_jobs(spark, monkeypatch):
    """A union behind the implementor of another is a round of few writes, however deep; a dead end opens all, a found cause none."""
    writes, written = [], X.written
    for module in (X, G):
        monkeypatch.setattr(module, "written", lambda df: writes.append(1) or written(df))
    n = 6
    pre = {(f"T1.m{i}", f"T0.m{i + 1}") for i in range(n)} | {("a.start", "T0.m0"), ("b.start", "T0.m2"), ("T0.m4", "c.x"), ("c.x", "T0.m5"), ("T0.m9", "c.own"), ("b.start", "T0.m9")}
    names = {x for p in pre for x in p} | {f"T1.m{n}", "T2.m1", "T1.m9"}
    had, own, unions = {(x, "Net") for x in names}, {(f"T1.m{n}", "Net"), ("c.own", "Net")}, {x for x in names if x.startswith("T0")}
    e, f = "src string, dst string", "fn string, effect string"
    frame = lambda rows, schema: spark.createDataFrame(sorted(rows), schema)
    lost = [("a.start", "Net"), ("b.start", "Net")]
    got = X.root_causes(frame(lost, f), frame(pre, e), frame(pre, e), frame(had, f), frame(had, f).limit(0), frame(own, f), frame([(u,) for u in unions], "fn string")).collect()
    want = brute_causes(lost, pre, pre, had, set(), own, unions)
    assert len(got) == len(want) and {(r.fn, r.effect, r.kind, r.root, r.callee, tuple(r.path)) for r in got} == want
    assert {r.root for r in got if r.kind == "UNION" and r.fn == "a.start"} >= {"T0.m0", "T0.m3", "T0.m5"} and "T0.m9" not in {r.root for r in got if r.kind == "UNION"}
    assert len(writes) < 60


def test_one_fact_drops_steps_into_what_is_known(spark, monkeypatch):
    """The same as with several facts, cycles included; what is written shrinks."""
    rng, sizes, written = random.Random(7), [], G.written
    edges = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(80)} | {(100 + i, 99 + i) for i in range(1, 11)} | {(100, 3), (110, 104)})
    e = spark.createDataFrame(edges, "src long, dst long")
    facts = spark.createDataFrame([(3, "Net"), (7, "Net")], "fn long, fact string")
    several = G.propagated(e, facts.union(spark.createDataFrame([(999, "Fs")], facts.schema))).filter("fact = 'Net'").collect()

    def counted(df):
        out = written(df)
        if "to" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(G, "written", counted)
    got = G.propagated(e, facts)
    assert got.dtypes == facts.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, several)) and len(several) > 12
    assert len(sizes) > 2 and sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0] / 2
    assert G.propagated(e, facts.limit(0)).isEmpty()
