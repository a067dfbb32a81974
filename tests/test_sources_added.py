"""Workflow files, transcripts, archives, change logs, the verified store, rows of unknown fields, blocked sessions."""

import collections
import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from fathom.operators import fields as V
from fathom.operators import registers as R
from fathom.operators import verbs as B
from fathom.sources import annotations as AN
from fathom.sources import changelog as CL
from fathom.sources import locators as LO
from fathom.sources import store as ST
from fathom.sources import transcripts as TR
from fathom.sources import workflows as WF


@pytest.mark.parametrize(
    "text,holds",
    [
        (None, True),
        ("true", True),
        ("false", False),
        ("github.event_name == 'push'", True),
        ("github.event_name != 'push'", False),
        ('!(github.event_name == "schedule")', True),
        ("! github.event_name == 'push'", False),
        ("github.event_name == 'push' && github.event_name == 'x' || github.event_name == 'push'", True),
        ("github.event_name == 'push' || matrix.os == 'x'", True),
        ("github.event_name == 'x' && matrix.os == 'x'", False),
        ("github.event_name == 'push' && matrix.os == 'x'", None),
        ("github.ref == 'main'", None),
        ("always()", None),
        ("github.event_name == ", None),
        ("(github.event_name == 'push'", None),
        ("github.event_name = 'push'", None),
        ("true && github.event_name == 'push'", None),
        ("'x'", True),
        ("${{ github.event_name }}", None),
        (7, True),
    ],
)
def test_conditions(text, holds):
    assert WF.condition(text, "push") is holds


FLOW = {
    "name": "ci",
    "on": {"push": {"paths": ["src/**"], "branches": "main"}, "schedule": []},
    "env": {"A": 1, "B": None},
    "defaults": {"run": {"working-directory": "w"}},
    "jobs": {
        "a": {
            "runs-on": ["ubuntu-latest", "x64"],
            "env": {"A": "2"},
            "steps": [
                {"uses": "actions/setup-node@v4"},
                {"uses": "some/thing@v1", "name": "thing"},
                {"run": "make", "env": {"C": "c"}, "shell": "bash"},
                {"run": "make", "if": "github.event_name == 'x'", "working-directory": "v"},
                {"run": "make", "if": "matrix.x"},
                {"run": "echo ${{ secrets.T }}"},
                {"run": "cd ${{ github.workspace }} && echo ${{ matrix.v }}"},
                {"run": "cd ${{github.workspace}}"},
                {},
            ],
        },
        "mac": {"runs-on": "macos-14", "steps": [{"run": "x"}]},
        "win": {"runs-on": "windows-latest", "steps": [{"run": "x"}, {"uses": "dtolnay/rust-toolchain@stable"}]},
        "no": {"if": "false", "steps": [{"run": "x"}]},
        "open": {"if": "needs.a.result", "steps": [{"run": "x"}]},
        "none": None,
    },
}


def test_workflow_steps(spark):
    files = [("/r/ci.yml", json.dumps(FLOW)), ("/r/late.yml", json.dumps({"on": "schedule", "jobs": {"j": {"steps": [{"run": "x"}]}}})), ("/r/bad.yml", "{{"), ("/r/list.yml", "[1]"), ("/r/empty.yml", None)]
    df = spark.createDataFrame(files, "path string, value string")
    rows = WF.workflow_steps(df).collect()
    got = {(os.path.basename(r.path), r.job, r.ordinal): r for r in rows}
    status = {k[1:]: v.status for k, v in got.items() if k[0] == "ci.yml"}
    assert [status["a", i] for i in range(9)] == ["PROVISION", "PROVISION", "RUN", "SKIP", "SKIP", "SKIP", "SKIP", "RUN", "SKIP"]
    assert (status["mac", 0], status["win", 0], status["win", 1], status["no", 0], status["open", 0]) == ("RUN", "SKIP", "PROVISION", "SKIP", "SKIP")
    first = got["ci.yml", "a", 2]
    assert (first.env, first.shell, first.directory, first.runs_on, first.workflow, first.script) == ({"A": "2", "B": "", "C": "c"}, "bash", "w", "ubuntu-latest x64", "ci", "make")
    assert (got["ci.yml", "a", 0].tool, got["ci.yml", "a", 1].tool, got["ci.yml", "a", 3].directory) == ("node", None, "v")
    reasons = {k[1:]: v.reason for k, v in got.items() if k[0] == "ci.yml"}
    assert "cannot be evaluated" in reasons["a", 4] and "is false" in reasons["a", 3] and "secret" in reasons["a", 5] and "matrix.v" in reasons["a", 6] and "job condition cannot" in reasons["open", 0] and "darwin" in reasons["mac", 0]
    assert "schedule" in got["late.yml", "j", 0].reason and got["bad.yml", None, 0].status == "SKIP" and got["list.yml", None, 0].status == "SKIP"
    assert len(rows) == 9 + 5 + 1 + 2
    triggers = WF.workflow_triggers(df)
    assert {os.path.basename(r.path): (r.parsed, r.has_push, r.paths, r.branches) for r in triggers.collect()} == {"ci.yml": (True, True, ["src/**"], ["main"]), "late.yml": (True, False, [], []), "bad.yml": (False, False, [], []), "list.yml": (False, False, [], []), "empty.yml": (True, False, [], [])}
    need = R.workflow_required(triggers.withColumn("name", F.regexp_extract("path", "([^/]*)$", 1)), ["src/a/b.rs"], "main")
    assert {r.name: r.required for r in need.collect()}["ci.yml"]


def entry(kind, content):
    return json.dumps({"type": kind, "message": {"content": content}})


def edit(file, name="Edit", field="file_path"):
    return entry("assistant", [{"type": "tool_use", "name": name, "input": {field: file}}])


RESULT = entry("user", [{"type": "tool_result", "content": "x"}])


def test_transcripts(spark, tmp_path):
    """The boundary in the tail, before it, made of blocks, and nowhere."""
    texts = {
        "near": [entry("user", "old"), edit("a"), entry("user", "go"), edit("b"), edit("b"), edit("c", "NotebookEdit", "notebook_path"), edit("d", "Read"), RESULT],
        "far": [entry("user", "go"), edit("x")] + [RESULT] * 30,
        "blocks": [entry("user", "go"), edit("x"), entry("user", [{"type": "image"}]), RESULT, "{broken"],
        "never": [edit("x"), RESULT],
        "empty": [],
    }
    for name, lines in texts.items():
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines) + ("\n" if name == "near" else ""))
    (tmp_path / "other.txt").write_text("no")
    df = TR.read_transcripts(spark, str(tmp_path), 6)
    whole = {os.path.basename(r.path)[:-6]: (r.n, r.whole) for r in df.groupBy("path").agg(F.count("*").alias("n"), F.bool_and("whole").alias("whole")).collect()}
    assert whole == {"near": (6, False), "far": (32, True), "blocks": (5, True), "never": (2, True)}
    edits = {os.path.basename(r.path)[:-6]: r.edited for r in TR.turn_edits(df).collect()}
    assert edits == {"near": ["b", "c"], "far": ["x"], "blocks": [], "never": None}
    assert df.rdd.getNumPartitions() == 5
    assert TR.read_transcripts(spark, str(tmp_path / "none"), 6).count() == 0
    with_blocks = spark.createDataFrame([(line,) for lines in texts.values() for line in lines], "body string")
    assert all(r.a == TR.is_human(r.body) for r in with_blocks.select("body", TR.human(F.col("body")).alias("a")).collect())


@pytest.mark.parametrize("lines,most", [(1, 3), (10, 10), (10, 9), (5000, 40), (3, 0)])
def test_last_lines(tmp_path, lines, most):
    text = [f"{i} " + "é" * (i % 97) for i in range(lines)]
    for end in ("", "\n"):
        (tmp_path / "t").write_text("\n".join(text) + end, encoding="utf-8")
        got, _, whole = TR.last_lines(str(tmp_path / "t"), most)
        assert got == (text[-most:] if most else []) and whole == (most >= lines)


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return bytearray(out.getvalue())


def test_annotations(spark):
    val = lambda name, text: f'<val name="{name}" val="{text}"/>'
    item = lambda name, *vals, kind="x.RequiresPermission": f'<item name="{name}"><annotation name="{kind}">{"".join(vals)}</annotation></item>'
    q = "&quot;"
    good = "<root>" + item("A m()", val("value", f"{q}p.CAMERA{q}")) + item("A n()", val("anyOf", "{" + f"{q}p.X{q}, {q}p.Y{q}" + "}"), val("conditional", " True ")) + item("A o()", val("conditional", "true")) + item("A p()", val("conditional", "false")) + item("A q()", val("value", f"{q}p.Z{q}"), kind="x.Nullable") + item("A r()", val("value", "NONE")) + "</root>"
    one = "<root>" + item("B m()", val("allOf", f"{q}p.X{q}")) + "</root>"
    zips = spark.createDataFrame([("/z/30.zip", archive({"a/b/annotations.xml": good, "c/annotations.xml": one, "c/other.xml": good, "d/annotations.xml": "<root", "e/annotations.xml": "<root></root>"})), ("/z/bad.zip", bytearray(b"no")), ("/z/none.zip", None)], "path string, content binary")
    files = AN.unpacked(zips)
    assert {r.path for r in files.filter("error IS NOT NULL").collect()} == {"/z/bad.zip", "/z/none.zip"}
    items = AN.annotation_items(files)
    assert {(r.package, r.name, r.kind, tuple(r.permissions), r.conditional) for r in items.collect()} == {("a.b", "A m()", "value", ("p.CAMERA",), False), ("a.b", "A n()", "anyOf", ("p.X", "p.Y"), True), ("a.b", "A o()", None, (), True), ("c", "B m()", "allOf", ("p.X",), False)}
    assert {r.kind: (r.n, r.percent) for r in AN.forms(items).collect()} == {"value": (1, 25.0), "anyOf": (1, 25.0), "allOf": (1, 25.0), "conditional-only": (1, 25.0)}
    wanted = spark.createDataFrame([("CAMERA",), ("SMS",)], "name string")
    assert {r.name: r.covered for r in R.covered_by(wanted, items.select(F.explode("permissions").alias("name"))).collect()} == {"CAMERA": True, "SMS": False}


def test_changelog(spark):
    text = "# Log\nintro\n\n## Unreleased\n- a\n\n## [1.2.0] - date\r\n- b\n### Sub\n- c\n## [1.2.0] again\n- d\n## 1.1 — old\n\n## [Unreleased]\n"
    df = spark.createDataFrame([("a", text), ("b", "## [unreleased]\n"), ("c", "none"), ("d", None), ("e", "")], "path string, value string")
    parts = CL.sections(CL.lines_of(df))
    assert {(r.path, r.section): (r.heading, r.body) for r in parts.collect()} == {("a", 1): ("## Unreleased", "- a\n"), ("a", 2): ("## [1.2.0] - date", "- b\n### Sub\n- c"), ("a", 3): ("## [1.2.0] again", "- d"), ("a", 4): ("## 1.1 — old", ""), ("a", 5): ("## [Unreleased]", ""), ("b", 1): ("## [unreleased]", "")}
    assert [(r.path, r.heading) for r in CL.newest_published(parts).collect()] == [("a", "## [1.2.0] - date")]
    asked = spark.createDataFrame([("a", "1.2.0"), ("a", "1.1.7"), ("a", "1.2.00"), ("b", "1.2.0")], "path string, version string")
    assert {(r.version, r.section) for r in CL.of_version(parts, asked).collect()} == {("1.2.0", 2), ("1.1.7", 4)}


ROW = ("1", "e", "lib.jar", "sha-a", ["h2", "h1"], ["run", "x"], '{"head":{"version":"1"}}', '{"f":["g"]}')


def test_verified_store(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    frame = lambda *rows: spark.createDataFrame(list(rows), ST.ENTRY)
    ask = lambda *rows: {r.entry: (r.state, r.graph) for r in ST.lookup(frame(*rows).drop("report", "call_graph"), root).collect()}
    with_ = lambda **k: tuple(k.get(n, v) for n, v in zip("version engine entry entry_sha engine_sha command report call_graph".split(), ROW))
    assert ask(ROW) == {"lib.jar": ("no store", None)}
    bad = [with_(entry="empty", report=" "), with_(entry="blind", engine_sha=[]), with_(entry="other", report='{"head":{"version":"2"}}'), with_(entry="graph", call_graph="[1]")]
    name, refused = ST.publish(frame(*bad), root)
    assert name is None and {r.entry: r.reason for r in refused.collect()} == {"empty": "empty report", "blind": "unidentified engine", "other": "other version in the report", "graph": "no call graph"}
    first, _ = ST.publish(frame(ROW, with_(entry="plain", call_graph=None), *bad), root, 1)
    assert ST.commits(spark, root) == [first] and ST.publish(frame(ROW, with_(entry="plain", call_graph=None)), root, 1)[0] == first and not [f for f in os.listdir(tmp_path / "store") if f.startswith("staged")]
    assert ask(with_(engine_sha=["h1", "h2"]), with_(entry="plain"), with_(entry="new")) == {"lib.jar": ("hit", "hit"), "plain": ("hit", "not stored"), "new": ("never filled", None)}
    for change, state in ({"version": "9"}, "no store"), ({"entry_sha": "b"}, "other content"), ({"engine_sha": ["h1"]}, "other engine"), ({"command": ["run"]}, "other command"):
        assert ask(with_(**change)) == {"lib.jar": (state, None)}
    second, _ = ST.publish(frame(with_(entry_sha="b", report='{"n":2}')), root, 1)
    assert second != first and ask(with_(entry_sha="b"), with_(entry="plain")) == {"lib.jar": ("hit", "hit"), "plain": ("hit", "not stored")} and ask(ROW) == {"lib.jar": ("hit", "hit")}
    hit = ST.lookup(frame(with_(entry_sha="b")).drop("report", "call_graph"), root).first()
    assert hit.report == '{"n":2}' and hit.call_graph == '{"f":["g"]}'
    # A changed byte, and a file that is gone: misses with a name, for that commit only.
    files = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "store" / "commits" / first / "data") for f in names if f.endswith(".parquet")]
    raw = bytearray(open(files[0], "rb").read())
    raw[len(raw) // 2] ^= 1
    open(files[0], "wb").write(raw)
    for crc in [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "store" / "commits" / first / "data") for f in names if f.endswith(".crc")]:
        os.remove(crc)
    assert ask(with_(entry="plain"), with_(entry_sha="b")) == {"plain": ("corrupt", None), "lib.jar": ("hit", "hit")}
    os.remove(files[0])
    assert ask(with_(entry="plain")) == {"plain": ("corrupt", None)}


def test_rows_of_unknown_fields(spark):
    pre = [("a", {"fn": "a", "x": [1, 2, 2], "o": {"b": 1, "a": 2}, "n": None}), ("a", {"fn": "a", "x": [2]}), ("b", {"fn": "b", "y": "s"}), ("c", {"fn": "c", "x": []}), (None, {"x": [9]})]
    post = [("a", {"fn": "a", "x": [2, 3, {"k": 1}], "o": {"a": 2, "b": 1}}), ("c", {"fn": "z", "x": [1], "w": [[1], [2]]})]
    frame = lambda rows: spark.createDataFrame([(k, json.dumps(r)) for k, r in rows], "k string, t string").select("k", F.parse_json("t").alias("row"))

    def bag(rows):
        out = collections.Counter()
        for k, r in rows:
            for f, v in r.items():
                out.update((k, f, json.dumps(e, sort_keys=True)) for e in (v if isinstance(v, list) else [v]) if f != "fn")
        return out

    gone = bag(pre) - bag(post)
    want = {f: (len({k for k, g, _ in gone if g == f}), sum(n for (_, g, _), n in gone.items() if g == f)) for f in {f for _, f, _ in gone}}
    assert {r.field: (r["keys"], r.elements) for r in V.field_losses(frame(pre), frame(post), ["k"]).collect()} == want
    texts = [r.v for r in frame(pre).select(V.wide_value(F.col("row")).alias("v")).collect()]
    assert texts == [json.dumps({k: v for k, v in r.items() if k != "fn"}, sort_keys=True, separators=(",", ":")) for _, r in pre]
    odd = spark.createDataFrame([('{"b":1, "a":{"d":[1, 2],"c":"x\\"y é"}}',), ("[1]",), ("{",), (None,)], "t string")
    assert [r.c for r in odd.select(V.canonical(F.col("t")).alias("c")).collect()] == ['{"a":{"c":"x\\"y é","d":[1,2]},"b":1}', "[1]", None, None]
    assert odd.limit(2).select(V.narrow_value(F.parse_json("t"), ["b", "z"]).alias("v")).first().v == '{"b":1,"z":null}'


def turn(ts, session, verdict, violations=()):
    return json.dumps({"ts": ts, "sessionId": session, "verdict": verdict, "violations": list(violations)})


def test_blocked_sessions(spark, tmp_path):
    """Restarts go on from the state; late turns change nothing; sessions that nothing follows are forgotten."""
    from fathom.streaming import activity as T
    from fathom.streaming import blocked as B

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    B.use_rocksdb(spark)
    log, out, state = tmp_path / "log", tmp_path / "out", str(tmp_path / "state")
    log.mkdir()
    changes = []

    def run():
        query = B.blocked_changes(T.activity_stream(spark, str(log)), "1 minute", 48).writeStream.outputMode("update").option("checkpointLocation", state).foreachBatch(lambda b, _: changes.extend((r.sessionId, r.change) for r in b.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
        got, changes[:] = sorted(changes), []
        return got

    put = lambda name, *turns: (log / name).write_text("\n".join(turns))
    put("1.json", turn("2026-01-01T10:00:00Z", "s", "clean"), turn("2026-01-01T10:05:00Z", "s", "blocked", ["001"]), turn("2026-01-01T10:01:00Z", "t", "blocked", ["004"]), turn("2026-01-01T10:01:00Z", "u", "clean"))
    assert run() == [("s", "blocked"), ("t", "blocked")]
    assert {r.sessionId: r.violations for r in B.blocked_now(spark, state).collect()} == {"s": ["001"], "t": ["004"]}
    put("2.json", turn("2026-01-01T11:00:00Z", "s", "clean"), turn("2026-01-01T10:59:30Z", "u", "blocked"), turn("2026-01-01T11:00:00Z", "v", "clean"))
    assert run() == [("s", "cleared"), ("u", "blocked")]
    put("3.json", turn("2026-01-01T10:59:40Z", "s", "blocked"))
    assert run() == [] and {r.sessionId for r in B.blocked_now(spark, state).collect()} == {"t", "u"}
    put("4.json", turn("2026-01-03T10:30:00Z", "w", "clean"))
    run()
    put("5.json", turn("2026-01-03T10:31:00Z", "w", "clean"))
    assert [c for c in run() if c[1] != "forgotten"] == [] and {r.sessionId for r in B.blocked_now(spark, state).collect()} == {"u"}
    assert not out.exists()
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    else:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_locators(spark, tmp_path):
    for name in ("a/.home/report.x.scan.json", "a/.home/report.x.callgraph.json", "a/b/.home/policy", "a/b/c/file", "p/rep.one.scan.json", "p/rep.two.scan.json", "p/rep.two.gate.json", "p/rep.txt", "p/single.json", "p/odd[1].x.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("{}")
    at = lambda *names: [f"{tmp_path}/{n}" for n in names]
    files = lambda *a: [x.removeprefix("file:") for x in LO.report_files(spark, *a)]
    assert files(f"{tmp_path}/a", ".home") == at("a/.home/report.x.scan.json") and files(f"{tmp_path}/a/b", ".home") == []
    assert files(f"{tmp_path}/p/single.json", ".home") == at("p/single.json") and files(f"{tmp_path}/p/rep", ".home") == at("p/rep.one.scan.json", "p/rep.two.scan.json")
    assert files(f"{tmp_path}/p/odd[1]", ".home") == at("p/odd[1].x.json")
    assert files(None, ".home", f"{tmp_path}/a/b/c") == at("a/.home/report.x.scan.json") and files(None, ".home", f"{tmp_path}/p") == []
    assert LO.stems(spark, at("p/rep", "p/single", "p/single.json", "p/rep", "p/gone")) == at("p/gone", "p/rep.one.scan", "p/rep.two.scan", "p/single")
    (tmp_path / "bom.json").write_text("\ufeff{\"a\":1}", encoding="utf-8")
    (tmp_path / "bad.json").write_text("{")
    assert LO.read_object(spark, f"{tmp_path}/bom.json") == {"a": 1}
    for name in ("bad.json", "absent.json", "p"):
        assert LO.read_object(spark, f"{tmp_path}/{name}", soft=True) is None
        with pytest.raises(LO.Unreadable):
            LO.read_object(spark, f"{tmp_path}/{name}")


def test_permission_keys(spark):
    keys = spark.createDataFrame([("Cam", "K1"), ("Mic", "K2"), ("Loc", "K3"), ("Notify", None), ("Off", "K4")], "effect string, key string")
    reached = spark.createDataFrame([("Cam",), ("Cam",), ("Loc",), ("Notify",), ("Net",)], "effect string")
    got = B.permission_keys(reached, keys, spark.createDataFrame([("K1",), ("K2",), ("Other",)], "key string"))
    assert {(r.effect, r.status) for r in got.collect()} == {("Cam", "ok"), ("Mic", "over"), ("Loc", "under"), ("Notify", "no key needed")}
    assert B.verify_code(got).first()[:] == (1, 1, 1) and B.verify_code(got.filter("status <> 'under'")).first().code == 0
    with pytest.raises(ValueError):
        B.permission_keys(reached, keys, None)
    assert B.capabilities(spark).count() == sum(map(len, B.VERBS.values()))
