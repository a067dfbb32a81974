"""Readers of report files: JSON documents in several envelopes, call-graph sidecars, tables with tabs, policies.

Documents are read as whole files, so a file is the unit of parallel work; everything after the split runs on columns. A file that
cannot be read is a row with an error, not an empty report.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "path string, ordinal int, body string, error string"
#: Files beside a report that are not reports.
SIDECAR = r"\.(callgraph|hierarchy|calibrated|gate|locs|encountered-[^/]*)\.json$"


def split_documents(text: str) -> Iterator[tuple[str | None, str | None]]:
    """(document, error) for JSON documents one after another in a text; a text without any is an error."""
    decoder, at, n = json.JSONDecoder(), 0, len(text)
    found = False
    while True:
        while at < n and text[at] in " \t\r\n﻿":
            at += 1
        if at >= n:
            break
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError as e:
            yield None, f"not JSON at {at}: {e.args[0] if e.args else ''}"
            return
        found = True
        yield json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None
        at = end
    if not found:
        yield None, "no document"


def read_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, ordinal, body, error) of all JSON documents of the files; sidecars are left out; gzip is unpacked by the reader."""

    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse_documents(files.filter(~F.col("path").rlike(SIDECAR)))


def parse_documents(files: DataFrame) -> DataFrame:
    """files (path, value: a text) -> (path, ordinal, body, error) of the JSON documents in each text, one after another."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, i, body, error) for p, text in zip(frame["path"], frame["value"], strict=True) for i, (body, error) in enumerate(split_documents(text))]
            yield pd.DataFrame(rows, columns=["path", "ordinal", "body", "error"])

    return files.select("path", "value").mapInPandas(split, DOCUMENT)


def entry_of(path: Column) -> Column:
    """The name of the folder or archive of a report file."""
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


UNIT = "struct<fn:string,hash:string,loc:string,direct:array<string>,inferred:array<string>,unknownWhy:array<string>,invisible:array<string>,incomplete:array<string>,dispatchesOn:array<string>,calls:array<string>,interfaceUnion:boolean,hosts:array<string>,cmds:array<string>,paths:array<string>,tables:array<string>>"
ENVELOPE = f"struct<package:string,packages:array<string>,analyzed:struct<count:bigint>,incomplete:boolean,unanalyzed:array<struct<path:string,reason:string>>,judgedNothing:array<string>,functions:array<{UNIT}>>"


def normalised(documents: DataFrame) -> DataFrame:
    """One row for each readable document: package, analysed (null where it does not say), completeness fields and units.

    A bare array is a report of its own kind; an object without `functions` is marked by an error."""
    bare = F.col("body").startswith("[")
    body = F.when(bare, F.concat(F.lit('{"functions":'), "body", F.lit("}"))).otherwise(F.col("body"))
    doc = F.from_json(body, ENVELOPE)
    out = documents.withColumn("_d", doc)
    package = F.coalesce("_d.package", F.when(F.size("_d.packages") > 0, F.array_join("_d.packages", "+")))
    error = F.coalesce("error", F.when(F.col("_d.functions").isNull(), "no functions"))
    return out.select("path", "ordinal", entry_of(F.col("path")).alias("entry"), F.when(bare, "bare").otherwise("envelope").alias("envelope"), package.alias("package"), F.col("_d.analyzed.count").alias("analysed"), F.coalesce("_d.incomplete", F.lit(False)).alias("incomplete"), F.col("_d.unanalyzed").alias("unanalyzed"), F.col("_d.judgedNothing").alias("judged_nothing"), F.col("_d.functions").alias("functions"), error.alias("error"))


def entry_totals(reports: DataFrame) -> DataFrame:
    """(entry, documents, analysed, functions) over all readable documents of an entry; analysed is null only where no document says it."""
    rows = reports.filter("error IS NULL")
    return rows.groupBy("entry").agg(F.count("*").alias("documents"), F.sum("analysed").alias("analysed"), F.sum(F.size("functions")).alias("functions"))


def unit_rows(reports: DataFrame) -> DataFrame:
    """One row for each function with its place in the report; the package falls back to the hash, then to the entry."""
    rows = reports.filter("error IS NULL").select("entry", "package", F.posexplode("functions").alias("position", "u")).select("entry", "package", "position", "u.*")
    from_hash = F.when(F.contains("hash", F.lit("#")), F.substring_index("hash", "#", 1)).when(F.contains("hash", F.lit("/")), F.regexp_replace("hash", "/[^/]*$", ""))
    return rows.withColumn("package", F.coalesce("package", from_hash, F.concat(F.lit("<"), "entry", F.lit(">"))))


def read_call_graph(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of sidecars {function: [callee, ..]}; a node in several files has the union of its callees, and one without
    any is a node all the same."""
    return call_graph(spark.read.text(paths, wholetext=True))


def call_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (value: the text of a sidecar) -> (nodes, edges), as read_call_graph()."""
    rows = files.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("src", "callees"))
    edges = rows.select("src", F.explode("callees").alias("dst")).distinct()
    return rows.select(F.col("src").alias("fn")).distinct(), edges


def read_tabs(spark: SparkSession, path: str, schema: str, missing: str = "NA", comment: str = "#") -> DataFrame:
    """A table with tabs; `missing` becomes null, not zero."""
    return spark.read.csv(path, schema=schema, sep="\t", nullValue=missing, comment=comment, mode="PERMISSIVE")


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ACTIVITY).json(path)


ACTIVITY = "ts timestamp, sessionId string, engine string, edited array<string>, gained array<string>, blastRadius bigint, maxHops bigint, verdict string, violations array<string>, unknowns bigint, effects array<string>, reviewMs bigint"


def backend(toolchain: Column, version: Column, readable: Column | None = None) -> Column:
    """Which engine wrote a report, by its toolchain or the name in its version (`<name>-swift..`, `<name>-ts..`); neither: scan. A
    report that cannot be read counts as JS."""
    t, v = F.coalesce(toolchain, F.lit("")), F.coalesce(version, F.lit(""))
    known = F.when(t.startswith("jdk"), "jvm").when((t == "swiftsyntax") | v.rlike("^[a-z]+-swift"), "Swift").when(t.startswith("node") | v.rlike("^[a-z]+-ts"), "JS").otherwise("scan")
    return known if readable is None else F.when(F.coalesce(readable, F.lit(False)), known).otherwise("JS")


def lookup_cache(wanted: DataFrame, stored: DataFrame, key: list[str], checks: list[str]) -> DataFrame:
    """wanted (key, checks) against a table of stored results: `hit`, or the first thing that does not match as a typed miss."""
    kept = stored.select(*key, *[F.col(c).alias(f"_s_{c}") for c in checks], F.lit(True).alias("_there"))
    rows = wanted.join(kept, key, "left")
    reason = F.when(F.col("_there").isNull(), "absent")
    for c in checks:
        reason = reason.when(~F.col(c).eqNullSafe(F.col(f"_s_{c}")), f"other {c}")
    return rows.select(*key, reason.otherwise("hit").alias("state"))


def stale(report_modified: Column, newest_source: Column) -> Column:
    return F.coalesce(newest_source > report_modified, F.lit(True))
