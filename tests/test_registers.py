"""Seeds and controls for the operators on registers, findings and workflows."""

import pytest
from pyspark.sql import functions as F

from fathom.functions import scalars as S
from fathom.operators import registers as R

A = "array<string>"


def test_rows_that_a_gate_sees(spark):
    schema = f"fn string, inferred {A}, interface_union boolean, hash string, package string"
    rows = [("a", ["Net"], None, "own#1", "own"), (None, ["Net"], None, None, "own"), ("b", [], None, "lib#1", "own"), ("c", None, True, "lib#2", "own"), ("d", ["Fs"], False, "", "own"), ("e", ["Fs"], None, "lib#3", None)]
    df = spark.createDataFrame(rows, schema)
    assert {r.fn for r in R.valid_units(df).collect()} == {"a", "d", "e"}
    assert {r.fn for r in R.gate_visible(df).collect()} == {"a", None, "b", "d", "e"}
    own, foreign = R.own_rows(df.withColumn("entry", F.lit("x")), "entry")
    assert {r.fn for r in own.collect()} == {"a", None, "d", "e"} and [r.foreign for r in foreign.collect()] == [1]
    assert R.valid_units(df.limit(0)).count() == 0


def test_libraries_and_sweep(spark):
    unc = spark.createDataFrame([("e", "pre", "a.b.c"), ("e", "post", "a"), ("e", "post", "z"), ("f", "pre", "a.b")], "entry string, arm string, name string")
    lib = spark.createDataFrame([("e", "a.b"), ("g", "a.b")], "entry string, name string")
    hits = R.uncovered_libraries(unc, lib)
    assert {tuple(r) for r in hits.collect()} == {("e", "pre", "a.b.c"), ("e", "post", "a")}
    names = spark.createDataFrame([("e",), ("f",)], "entry string")
    assert {tuple(r) for r in R.live_entries(names, hits).collect()} == {("e", False, "post,pre", 2), ("f", True, "", 0)}
    dashed = spark.createDataFrame([("e", "pre", "My-Lib"), ("e", "pre", "my.lib")], "entry string, arm string, name string")
    assert [r.name for r in R.uncovered_libraries(dashed, spark.createDataFrame([("e", "my_lib")], "entry string, name string"), True).collect()] == ["My-Lib"]
    units = spark.createDataFrame([("e", ["Unknown"], ["reflect"]), ("e", ["Net"], ["dispatch"]), ("f", ["Net"], None)], f"entry string, inferred {A}, classes {A}")
    got = {(r.entry, r.policy): r.code for r in R.policy_sweep(units, "entry").collect()}
    assert [got["e", p] for p, _ in R.SWEEP] == [1, 1, 0, 0, 1, 0] and not any(got["f", p] for p, _ in R.SWEEP)


def test_findings(spark):
    units = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "3"), ("c", None)], "fn string, loc string")
    hops = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", None), (1, 2, "b", "own"), (1, 3, "c", "")], "id int, position int, fn string, loc string")
    assert {r.position: r["loc"] for r in R.hop_locations(hops, units).collect()} == {0: "1", 1: None, 2: "own", 3: None}
    lines = spark.createDataFrame([("r/a.md:1",), ("r/b.md:2",), ("top:3",), ("r/x.json:4",), ("r/y.json:5",)], "line string")
    tracked = spark.createDataFrame([("r/a.md",), ("top",)], "path string")
    assert sorted(r.line for r in R.tracked_only(lines, tracked).collect()) == ["r/a.md:1", "top:3"]
    files = spark.createDataFrame([("r/x.json", '{"h":{"spec":"1"}}'), ("r/y.json", "{"), ("r/a.md", '{"h":{"spec":"1"}}')], "path string, body string")
    assert sorted(r.line for r in R.without_reports(lines, files, "h").collect()) == ["r/a.md:1", "r/b.md:2", "r/y.json:5", "top:3"]
    with pytest.raises(ValueError):
        R.open_rows(spark.createDataFrame([(1,)], "id int"), None)
    log = spark.createDataFrame([("/p/A.java:3: error: x",), ("/p/A.java:3: error: y",), ("/p/B.java:1: error: z",), ("note",)], "line string")
    sources = spark.createDataFrame([("/p/A.java", 3, "  try { a(); }"), ("/p/B.java", 2, "try {")], "file string, number int, text string")
    assert {tuple(r) for r in R.recovered(log, sources).collect()} == {("/p/A.java", "drop lines", 1), ("/p/B.java", "drop file", 1)}


def test_scalars(spark):
    value = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert [value(R.effect_hint(F.lit(x))) for x in ("Net", "nET", "Netlify", "clipboard")] == [None, "Net", None, "Clipboard"]
    assert tuple(value(S.owner_and_member(F.lit("a.B.==")))) == ("a.B", "==") and tuple(value(S.owner_and_member(F.lit("main#2")))) == (None, "main")
    assert value(S.package_of_probe(F.lit("gen.a.b.C.m"), "gen")) == "a.b" and value(S.package_of_probe(F.lit("gen.C.m"), "gen")) is None
    assert value(S.seconds_between(F.lit("2024-01-01T00:00:00Z"), F.lit("2024-01-01T00:01:05Z"))) == 65 and value(S.seconds_between(F.lit("x"), F.lit("y"))) is None
    assert value(S.merged_maps([F.lit(None).cast("map<string,string>"), F.create_map(F.lit("a"), F.lit(None).cast("string"))])) == {"a": ""}
    assert value(S.repo_path(F.lit("a.b.C.m"), F.lit("C.java"), ".")) == "a/b/C.java" and value(S.repo_path(F.lit("m"), F.lit("C.java"), "src")) == "src/C.java"
    for glob, text, hit in (("a/*.rs", "a/b.rs", True), ("a/*.rs", "a/b/c.rs", False), ("**/c.rs", "c.rs", False), ("**/c.rs", "a/b/c.rs", True), ("a+(b)?", "a+(b)x", True), ("v[1].*", "v[1].2", True)):
        assert value(F.regexp_like(F.lit(text), S.glob_regex(F.lit(glob)))) is hit
    assert [value(R.workflow_key(F.lit(i), F.lit("n"))) for i in (None, 0, 7)] == ["n", "n", "7"]
