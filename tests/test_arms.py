"""Folders of arms, captured pairs, tolerant objects, tables with tabs, stale reports, flip files, the log of turns."""

import datetime
import gzip
import hashlib
import json

import pytest

from fathom.operators import bags as B
from fathom.sources import arms as A
from fathom.sources import reports as R
from fathom.sources import sinks as K
from fathom.streaming import activity as T


def test_arm_index_of_files(spark, tmp_path):
    def put(name, text):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        (gzip.open(path, "wt") if name.endswith(".gz") else open(path, "w")).write(text)

    graph = json.dumps({"f": ["g"]})
    sha = hashlib.sha256(graph.encode()).hexdigest()
    for name in ("scan/a.scan.json", "scan/a.scan.json.gz", "scan/a.scan.callgraph.json", "scan/b.scan.json", "scan/only.scan.callgraph.json", "scan/a.gate.json"):
        put(name, "{}")
    for label, digest, has in (("x", sha, True), ("y", "0" * 64, True), ("z", sha, False), ("w", None, True)):
        put(f"store/entries/{label}-1.meta.json", json.dumps({"entry_label": label, "callgraph": digest and {"sha256": digest}}))
        put(f"store/entries/{label}-1.report.gz", "{}")
        if has:
            put(f"store/entries/{label}-1.callgraph.json.gz", graph)
    put("store/entries/x-2.meta.json", json.dumps({"entry_label": "x"}))
    put("store/entries/x-2.report.gz", "{}")
    put("store/entries/v-1.meta.json", json.dumps({"entry_label": "v"}))
    put("store/stray.scan.json", "{}")
    base = lambda p: p and p.rsplit("/", 1)[1]
    got = {(base(r.root), r.entry): (base(r.report), base(r.call_graph), r.state) for r in A.arm_index(A.read_files(spark, str(tmp_path))).collect()}
    assert got == {
        ("scan", "a"): ("a.scan.json.gz", "a.scan.callgraph.json", "ok"),
        ("scan", "b"): ("b.scan.json", None, "ok"),
        ("store", "x"): ("x-2.report.gz", None, "ok"),
        ("store", "y"): ("y-1.report.gz", None, "other graph"),
        ("store", "z"): ("z-1.report.gz", None, "no graph file"),
        ("store", "w"): ("w-1.report.gz", None, "ok"),
    }
    assert A.arm_index(spark.createDataFrame([], "path string, value string")).count() == 0


def test_pairs(spark):
    doc = json.dumps({"package": "p", "functions": [{"fn": "a", "inferred": ["Net"]}]})
    pairs = [("one", doc, doc), ("a/b", doc, "[]"), ("cut", doc, doc[:9]), ("null", None, doc), ("odd", '{"x": 1}', doc)]
    units, errors = A.pair_arms(spark.createDataFrame(pairs, "label string, pre string, post string"))
    assert sorted((r.entry, r.arm) for r in units.collect()) == [("a_b", "pre"), ("one", "post"), ("one", "pre")]
    assert sorted((r.entry, r.arm) for r in errors.collect()) == [("cut", "post"), ("null", "pre"), ("odd", "pre")]


def test_object_items(spark):
    files = [("a", '{"r": [{"b": 1, "a": 2}, 3, null, [1]]}'), ("b", "7"), ("c", None), ("d", '{"r": {}}'), ("e", "{}"), ("f", '{"r": []}'), ("g", "{")]
    rows = A.object_items(spark.createDataFrame(files, "path string, value string"), "r").collect()
    assert sorted((r.path, r.ordinal, r.item, r.note) for r in rows if r.path == "a") == [("a", 0, '{"a":2,"b":1}', None), ("a", 1, None, "no object"), ("a", 2, None, "no object"), ("a", 3, None, "no object")]
    assert sorted((r.path, r.ordinal, r.note) for r in rows if r.path != "a") == [("b", -1, "no object"), ("c", -1, "no JSON"), ("d", -1, "no list"), ("g", -1, "no JSON")]


def test_tabs(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    rows = A.sweep(lines("jar\tpolicy\tn", 'a"b\tp\t3\t0', "a\tp", "", "  ", "#x\ty\t1", "c\tq\tNA\r", "d\tq\tmany", "e\tq\t")).collect()
    assert sorted((r.jar, r.policy, r.n, r.state) for r in rows) == [('a"b', "p", 3, "measured"), ("c", "q", None, "NA"), ("d", "q", None, "unreadable"), ("e", "q", None, "unreadable")]
    assert [tuple(r) for r in A.roster(lines("# c", "g:a:1\tabc", "\t"), "java").collect()] == [("g:a:1", "abc")]
    ts = A.roster(lines("r\tv\ts\t-\t4\t-"), "ts").first()
    assert (ts.target, ts.want_src, ts.want_analysed, ts.want_foreign) == (None, 4, None, None)
    assert [tuple(r) for r in A.cells(lines("e\tf\tNet\tmore", "e\tf")).collect()] == [("e", "f", "Net")]


def test_flip_files(spark, tmp_path):
    flips = spark.createDataFrame([(f"k{i}", "a\tb\nc" if i == 0 else None) for i in range(30)], "fn string, effect string")
    K.write_flips(flips, flips.limit(1), str(tmp_path / "f"))
    rows = A.tab_fields(spark.read.text(str(tmp_path / "f")), ["fn", "effect"], 2, missing="NA").collect()
    assert len(rows) == 30 and {r.effect for r in rows} == {"a b c", None}
    assert spark.read.text(str(tmp_path / "f.keyloss")).count() == 1


def test_stale_reports(spark):
    at = lambda n: datetime.datetime(2026, 1, n)
    files = [
        ("/p/.home/report.b.json", at(1)), ("/p/.home/report.a.json", at(5)), ("/p/src/x.rs", at(4)), ("/p/node_modules/m.js", at(9)), ("/p/notes.md", at(9)), ("/p/.home/old.rs", at(9)),
        ("/p/q/.home/report.x.json", at(2)), ("/p/q/y.kt", at(3)), ("/z/.home/report.x.json", at(2)), ("/z/.home/policy.json", at(1)), ("/n/a.rs", at(1)),
    ]
    rows = A.stale_reports(spark.createDataFrame(files, "path string, modified timestamp"), ".home").collect()
    assert {r.root: (r.report[-6:-5], r.state) for r in rows} == {"/p": ("a", "fresh"), "/p/q": ("x", "stale"), "/z": ("x", "no source")}


def test_keys_and_log(spark, tmp_path):
    assert B.row_key("pkgfn") == ["entry", "package", "fn"]
    with pytest.raises(ValueError):
        B.row_key("all")
    path, log, state = (str(tmp_path / n) for n in ("turns", "log", "state"))
    turn = lambda us: spark.createDataFrame([(datetime.datetime(2026, 1, 1, 0, 0, 0, us), "s", us)], "ts timestamp, sessionId string, blastRadius bigint")
    for us in (1, 2):
        K.append_activity(turn(us), path)
        T.append_turns(spark, path, state, log)
        T.append_turns(spark, path, state, log)
    assert sorted(r.ts.microsecond for r in spark.read.parquet(log).collect()) == [1, 2]
    assert [r.blastRadius for r in T.compacted(R.read_activity(spark, path), 1).collect()] == [2]
