"""Arms of a comparison as files: the index of a folder, captured pairs, tolerant objects, tables with tabs, stale reports.

Functions take files as rows (path, value: the whole text, or one line), as `spark.read.text` gives them, which unpacks gzip by the name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .reports import normalised, parse_documents, unit_rows

NAME = r"([^/]+)$"
#: Names of the files of an arm in either layout.
SCAN_REPORT, SCAN_GRAPH = r"^(.+)\.scan\.json(\.gz)?$", r"^(.+)\.scan\.callgraph\.json(\.gz)?$"
STORED = r"^(.+)\.(meta\.json|report\.gz|callgraph\.json\.gz)$"


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, value) of all files below a folder, one row each."""
    text = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True)
    return text.select(F.col("_metadata.file_path").alias("path"), "value")


def arm_index(files: DataFrame) -> DataFrame:
    """files (path, value) -> (root, entry, report, call_graph, state), one row for each entry of each folder of arms.

    A folder with files in `entries/` is a store: an entry is what a meta file names by its label, if its report is there; of several with one label the last name counts. The call graph that the meta file
    names by a digest is part of the entry: `no graph file` and `other graph` (its content has another digest) are states, and no graph is given, so that nobody takes such an arm for one without a graph. Any other
    folder is a scan: `<entry>.scan.json` and `<entry>.scan.callgraph.json`, where a `.gz` of the same name comes first. State is `ok` otherwise. Contents are not shuffled."""
    name = F.regexp_extract("path", NAME, 1)
    stored = F.col("path").rlike("(^|/)entries/[^/]+$")
    rows = files.withColumn("name", name).withColumn("stored", stored)
    rows = rows.withColumn("root", F.regexp_replace("path", r"/?(entries/)?[^/]+$", ""))
    meta, graph = F.col("name").endswith(".meta.json"), F.col("name").endswith(".callgraph.json.gz")
    small = rows.select(
        "root", "stored", "name", "path",
        F.when(F.col("stored") & meta, F.get_json_object("value", "$.entry_label")).alias("label"),
        F.when(F.col("stored") & meta, F.get_json_object("value", "$.callgraph.sha256")).alias("wanted"),
        F.when(F.col("stored") & graph, F.sha2("value", 256)).alias("sha"),
    )
    kept = small.filter("stored").withColumn("stem", F.regexp_extract("name", STORED, 1)).filter("stem <> ''")
    of = lambda suffix, c: F.max(F.when(F.col("name").endswith(suffix), F.col(c)))
    entries = kept.groupBy("root", "stem").agg(of(".meta.json", "label").alias("entry"), of(".meta.json", "wanted").alias("wanted"), of(".report.gz", "path").alias("report"), of(".callgraph.json.gz", "path").alias("g"), F.max("sha").alias("sha"))
    state = F.when(F.coalesce("wanted", F.lit("")) == "", "ok").when(F.col("g").isNull(), "no graph file").when(F.col("sha") != F.col("wanted"), "other graph").otherwise("ok")
    entries = entries.filter("entry <> '' AND report IS NOT NULL").withColumn("state", state).withColumn("call_graph", F.when((F.col("state") == "ok") & (F.coalesce("wanted", F.lit("")) != ""), F.col("g")))
    last = entries.groupBy("root", "entry").agg(F.max_by(F.struct("report", "call_graph", "state"), "stem").alias("e")).select("root", "entry", "e.*")

    plain = small.filter("NOT stored").join(kept.select("root").distinct(), "root", "left_anti")
    found = lambda pattern: F.regexp_extract("name", pattern, 1)
    is_graph = F.col("name").rlike(SCAN_GRAPH)
    plain = plain.withColumn("entry", F.when(is_graph, found(SCAN_GRAPH)).otherwise(found(SCAN_REPORT))).filter("entry <> ''")
    packed = lambda test: F.max_by(F.when(test, F.col("path")), F.when(test, F.struct(F.col("name").endswith(".gz"), F.col("path"))))
    scans = plain.groupBy("root", "entry").agg(packed(~is_graph).alias("report"), packed(is_graph).alias("call_graph")).filter("report IS NOT NULL")
    return last.unionByName(scans.withColumn("state", F.lit("ok")))


def pair_arms(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (label, pre, post: texts of two captured reports) -> (units with `arm`, errors (entry, arm, error)).

    Both arms stand under the label, so that their keys meet whatever the files were called. A pair of which either text cannot be read in full has an error and no units: half a pair would read as a loss of
    everything."""
    sides = pairs.select("label", F.explode(F.create_map(F.lit("pre"), "pre", F.lit("post"), "post")).alias("arm", "value"))
    files = sides.select(F.concat("arm", F.lit("/"), F.replace("label", F.lit("/"), F.lit("_")), F.lit("/report.json")).alias("path"), F.coalesce("value", F.lit("")).alias("value"))
    reports = normalised(parse_documents(files)).withColumn("arm", F.substring_index("path", "/", 1))
    errors = reports.filter("error IS NOT NULL").groupBy("entry", "arm").agg(F.min("error").alias("error"))
    good = reports.join(errors.select("entry").distinct(), "entry", "left_anti")
    units = [unit_rows(good.filter(F.col("arm") == arm)).withColumn("arm", F.lit(arm)) for arm in ("pre", "post")]
    return units[0].unionByName(units[1]), errors


def object_items(files: DataFrame, key: str) -> DataFrame:
    """files (path, value) -> (path, ordinal, item: JSON text, note): the objects in the list `key` of each file's object.

    Nothing here fails: a text that is no JSON, a value that is no object, a `key` that is no list, and an item that is no object are rows with a note and without an item, and what is well formed beside
    them stays. An object without `key` has no rows."""
    value = F.try_parse_json("value")
    kind = lambda v: F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    place = "$['" + key.replace("'", "\\'") + "']"
    rows = files.select("path", value.alias("v")).withColumn("inner", F.try_variant_get("v", place, "variant"))
    listed = F.col("v").isNotNull() & (kind(F.col("v")) == "OBJECT") & F.col("inner").isNotNull() & (kind(F.col("inner")) == "ARRAY")
    note = F.when(F.col("v").isNull(), "no JSON").when(kind(F.col("v")) != "OBJECT", "no object").when(F.col("inner").isNotNull() & (kind(F.col("inner")) != "ARRAY"), "no list")
    whole = rows.withColumn("note", note)
    broken = whole.filter("note IS NOT NULL").select("path", F.lit(-1).alias("ordinal"), F.lit(None).cast("string").alias("item"), "note")
    items = whole.filter(listed).select("path", F.posexplode(F.try_variant_get("inner", "$", "array<variant>")).alias("ordinal", "i"))
    good = F.col("i").isNotNull() & (kind(F.col("i")) == "OBJECT")
    items = items.select("path", "ordinal", F.when(good, F.to_json("i")).alias("item"), F.when(~good, "no object").alias("note"))
    return broken.unionByName(items)


def tab_fields(lines: DataFrame, names: list[str], least: int, missing: str | None = None, header: str | None = None) -> DataFrame:
    """lines (value, ..) -> the fields of each line between tabs, as texts. Quotes are ordinary characters; empty lines, lines that begin with #, lines with fewer than `least` fields and lines whose first field is
    `header` are left out; fields that a line lacks, and those that are `missing`, are null."""
    text = F.regexp_replace("value", r"[\r\n]+$", "")
    rows = lines.withColumn("_p", F.split(text, "\t")).filter((F.btrim("value", F.lit(" \t\r\n")) != "") & ~F.col("value").startswith("#") & (F.size("_p") >= least))
    if header is not None:
        rows = rows.filter(F.get("_p", F.lit(0)) != header)
    cell = lambda i: F.get("_p", F.lit(i)) if missing is None else F.nullif(F.get("_p", F.lit(i)), F.lit(missing))
    return rows.select(*[c for c in lines.columns if c != "value"], *[cell(i).alias(n) for i, n in enumerate(names)])


#: The columns of the rosters. `-` stands for nothing in those of ts.
ROSTERS = {
    "java": ("coord", "sha"),
    "ts": ("repo", "tag", "sha", "target", "want_src", "want_analysed", "want_rows", "want_deps", "want_foreign"),
    "rust": ("name", "version"),
}


def roster(lines: DataFrame, arm: str) -> DataFrame:
    """The entries that a corpus wants; the expected counts of ts are numbers, null where none is expected."""
    rows = tab_fields(lines, list(ROSTERS[arm]), 1, "-" if arm == "ts" else None)
    return rows.withColumns({c: F.expr(f"try_cast({c} AS int)") for c in ROSTERS[arm] if c.startswith("want_")})


def sweep(lines: DataFrame) -> DataFrame:
    """(jar, policy, n, state) of a table of policies: `measured`, `NA` (could not be measured, which is not zero) or `unreadable`."""
    rows = tab_fields(lines, ["jar", "policy", "_n"], 3, header="jar")
    n = F.expr("try_cast(_n AS int)")
    return rows.withColumn("n", n).withColumn("state", F.when(F.col("_n") == "NA", "NA").when(n.isNull(), "unreadable").otherwise("measured")).drop("_n")


def cells(lines: DataFrame) -> DataFrame:
    """(entry, fn, effect)"""
    return tab_fields(lines, ["entry", "fn", "effect"], 3)


#: Suffixes of sources, and folders that hold none of their own.
SOURCES = r"\.(rs|ts|tsx|js|mjs|java|kt|scala|swift)$"
PRUNED = r"/(\.git|node_modules|build|\.build|dist)/"


def stale_reports(files: DataFrame, home: str) -> DataFrame:
    """files (path, modified) -> (root, report, state, newest) for each root with reports `<root>/<home>/report.*.json`, by the first of them: `stale` if a source file below the root is newer, `fresh`
    if none is, `no source` if there is none. Every folder above a source asks by equality, so roots may lie in one another."""
    at = F.concat(F.lit("/"), F.lit(home), F.lit("/"))
    is_report = F.contains("path", at) & F.regexp_extract("path", NAME, 1).rlike(r"^report\..*json$")
    reports = files.filter(is_report).select(F.substring_index("path", f"/{home}/", 1).alias("root"), "path", "modified")
    first = reports.groupBy("root").agg(F.min_by(F.struct("path", "modified"), "path").alias("r"))
    sources = files.filter(F.col("path").rlike(SOURCES) & ~F.contains("path", at))
    parts = F.split("path", "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))
    below = sources.select(above.alias("root"), "path", "modified").filter(~F.substring("path", F.length("root") + 1, F.length("path")).rlike(PRUNED))
    newest = below.groupBy("root").agg(F.max("modified").alias("newest"))
    state = F.when(F.col("newest").isNull(), "no source").when(F.col("newest") > F.col("r.modified"), "stale").otherwise("fresh")
    return first.join(newest, "root", "left").select("root", F.col("r.path").alias("report"), state.alias("state"), "newest")
