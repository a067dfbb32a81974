import gzip
import json

import pytest
from pyspark.sql import functions as F

from fathom.sources import reports as R
from fathom.sources import sinks as K
from fathom.streaming import activity as T


@pytest.fixture
def reports(tmp_path):
    folder = tmp_path / "crate-1.0"
    folder.mkdir()
    doc = {"package": "p", "analyzed": {"count": 2}, "functions": [{"fn": "a", "inferred": ["Net"], "hash": "p#a"}, {"fn": "b", "inferred": []}]}
    (folder / "r.json").write_text("﻿" + json.dumps(doc) + "\n" + json.dumps({"packages": ["x", "y"], "functions": []}))
    (folder / "old.json").write_text(json.dumps([{"fn": "c", "inferred": ["Fs"], "hash": "q/c"}]))
    (folder / "bad.json").write_text('{"functions": [} ')
    (folder / "none.json").write_text(" ")
    (folder / "odd.json").write_text('{"other": 1}')
    (folder / "r.callgraph.json").write_text(json.dumps({"a": ["b", "c"], "b": []}))
    with gzip.open(folder / "z.json.gz", "wt") as f:
        f.write(json.dumps({"package": "gz", "functions": [{"fn": "z", "inferred": ["Db"]}]}))
    return folder


def test_read_reports(spark, reports):
    docs = R.read_documents(spark, str(reports))
    normal = R.normalised(docs)
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in normal.filter("error IS NOT NULL").collect()}
    assert set(errors) == {"bad.json", "none.json", "odd.json"} and errors["none.json"] == "no document" and errors["odd.json"] == "no functions"
    good = {(r.package, r.analysed, r.envelope) for r in normal.filter("error IS NULL").collect()}
    assert good == {("p", 2, "envelope"), ("x+y", None, "envelope"), (None, None, "bare"), ("gz", None, "envelope")}
    units = {(r.fn, r.package, r.entry) for r in R.unit_rows(normal).collect()}
    assert units == {("a", "p", "crate-1.0"), ("b", "p", "crate-1.0"), ("c", "q", "crate-1.0"), ("z", "gz", "crate-1.0")}


def test_call_graph_union(spark, reports):
    (reports / "s.callgraph.json").write_text(json.dumps({"a": ["d"], "e": []}))
    nodes, edges = R.read_call_graph(spark, [str(p) for p in reports.glob("*.callgraph.json")])
    assert {r.fn for r in nodes.collect()} == {"a", "b", "e"}
    assert {(r.src, r.dst) for r in edges.collect()} == {("a", "b"), ("a", "c"), ("a", "d")}


def test_tabs_and_cache(spark, tmp_path):
    (tmp_path / "t.tsv").write_text("# c\na\tbare\t3\t1\nb\tbare\tNA\t2\n")
    df = R.read_tabs(spark, str(tmp_path / "t.tsv"), "jar string, policy string, violations int, exit int")
    assert [(r.jar, r.violations) for r in df.collect()] == [("a", 3), ("b", None)]
    want = spark.createDataFrame([("a", "1", "x"), ("b", "1", "x"), ("c", "2", "x"), ("d", "1", "y")], "entry string, version string, sha string")
    have = spark.createDataFrame([("a", "1", "x"), ("c", "1", "x"), ("d", "1", "x")], "entry string, version string, sha string")
    assert {r.entry: r.state for r in R.lookup_cache(want, have, ["entry"], ["version", "sha"]).collect()} == {"a": "hit", "b": "absent", "c": "other version", "d": "other sha"}
    rows = [("jdk21", None), ("swiftsyntax", None), (None, "engine-swift-0.4"), (None, "engine-ts-1"), ("node22", None), (None, None), ("stable", "scan-1")]
    assert [r.b for r in spark.createDataFrame(rows, "t string, v string").select(R.backend(F.col("t"), F.col("v")).alias("b")).collect()] == ["jvm", "Swift", "Swift", "JS", "JS", "scan", "scan"]
    assert spark.range(1).select(R.backend(F.lit("jdk"), F.lit(None), F.lit(False)).alias("b")).first().b == "JS"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("b", None), ("a", 1)], "k string, n int")
    K.write_details(df, ["k"], str(tmp_path / "d"), single=True)
    lines = [json.loads(x) for p in (tmp_path / "d").glob("part-*") for x in p.read_text().splitlines()]
    assert [x["k"] for x in lines] == ["a", "b"]
    K.write_tabs(df, str(tmp_path / "t"))
    assert "b\tNA" in "".join(p.read_text() for p in (tmp_path / "t").glob("part-*"))
    K.store_by(df, ["k"], str(tmp_path / "s"))
    K.store_by(df.filter("k = 'a'").withColumn("n", F.lit(5)), ["k"], str(tmp_path / "s"))
    assert {(r.k, r.n) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {("a", 5), ("b", None)}
    with pytest.raises(ValueError):
        K.store_by(df.limit(0), ["k"], str(tmp_path / "s"))
    found = spark.createDataFrame([("e", "AS-EFF-007", "f", "a.rs:3", "m"), ("e", "AS-EFF-001", "g", None, "n")], "entry string, rule string, fn string, loc string, message string").withColumn("level", K.level_of(F.col("rule")))
    doc = json.loads(K.findings_document(found, "entry").first().document)
    results = doc["runs"][0]["results"]
    assert [r["level"] for r in results] == ["error", "warning"] and results[1]["locations"][0]["physicalLocation"]["region"]["startLine"] == 3 and "locations" not in results[0]


def turn(ts, session, verdict, violations=(), blast=1):
    return json.dumps({"ts": ts, "sessionId": session, "verdict": verdict, "violations": list(violations), "blastRadius": blast})


def test_stream_of_activity(spark, tmp_path):
    log, state = tmp_path / "log", str(tmp_path / "state")
    log.mkdir()
    (log / "1.json").write_text("\n".join([turn("2026-01-01T10:00:00Z", "s", "blocked", ["001"]), turn("2026-01-01T10:01:00Z", "t", "blocked", ["004"], 9)]))
    T.current_blocks(spark, str(log), str(tmp_path / "c"), state)
    assert {r.sessionId for r in T.read_blocks(spark, state).collect()} == {"s", "t"}
    tied = spark.createDataFrame([("x", "2026-01-01", "clean", []), ("x", "2026-01-01", "blocked", ["1"]), ("y", "2026-01-01", "blocked", None), ("y", "2026-01-02", "clean", None)], "sessionId string, ts string, verdict string, violations array<string>")
    assert {(r.sessionId, r.verdict) for r in T.last_verdicts(tied).collect()} == {("x", "blocked"), ("y", "clean")}
    (log / "2.json").write_text(turn("2026-01-01T11:00:00Z", "s", "clean"))
    T.current_blocks(spark, str(log), str(tmp_path / "c"), state)
    assert {r.sessionId for r in T.read_blocks(spark, state).collect()} == {"t"}
    rows = []
    T.run_available(T.by_window(T.activity_stream(spark, str(log))), str(tmp_path / "c2"), lambda b, _: rows.extend(b.collect()), "complete")
    assert [(r.turns, r.blocked, r.blast) for r in rows][-1:] == [(3, 2, 9)]
    digest = T.monthly_digest(__import__("fathom.sources.reports", fromlist=["x"]).read_activity(spark, str(log))).first()
    assert (digest.month, digest.checked, digest.held, digest.sessions, digest.quiet, len(digest.codes)) == ("2026-01", 3, 2, 2, 1, 2)
    assert T.compacted(spark.read.schema(T.ACTIVITY).json(str(log)), 1).count() == 2
