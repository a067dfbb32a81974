"""A store of measured reports that readers check before they believe it.

A commit is content-addressed: rows are staged, a manifest with the SHA-256 of every data file is written beside them, and the folder is renamed to the digest of that manifest. Nothing is
visible before that, and the same content is the same commit. Commits are listed by the order of their publication; the newest that has an entry answers.

A row holds one entry: its path and content digest, the engine and the digests of its files, the command, the report, its call graph, and the digests of both. A look-up names the first thing that
does not hold as a typed miss; rows of a file whose content is not that of the manifest are `corrupt`.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 1
IDENTITY = ("version", "engine")
ENTRY = "version string, engine string, entry string, entry_sha string, engine_sha array<string>, command array<string>, report string, call_graph string"


def key_of(engine_sha: Column, command: Column, entry_sha: Column) -> Column:
    """The digest under which a report is kept: of the engine's files in any order, the command and what was measured."""
    return F.sha2(F.to_json(F.struct(F.array_sort(engine_sha).alias("engine"), command.alias("command"), entry_sha.alias("entry"))), 256)


def refused(entries: DataFrame) -> Column:
    """Why an entry must not be stored, or null: an empty report is no measurement, an engine without files cannot key anything, a report that names another version
    comes from another engine, and a call graph must be a map of lists."""
    said = F.try_variant_get(F.try_parse_json("report"), "$.head.version", "string")
    graph = F.try_variant_get(F.try_parse_json("call_graph"), "$", "map<string,array<string>>")
    return (
        F.when(F.coalesce(F.trim("report"), F.lit("")) == "", "empty report")
        .when(F.coalesce(F.size("engine_sha"), F.lit(0)) < 1, "unidentified engine")
        .when(said.isNotNull() & (said != F.col("version")), "other version in the report")
        .when(F.col("call_graph").isNotNull() & graph.isNull(), "no call graph")
    )


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """(file: below the folder, length, sha) of the data files, hashed where they are read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return raw.select(_inside("path"), "length", F.sha2("content", 256).alias("sha"))


def _inside(path: str) -> Column:
    return F.regexp_extract(path, r"/data/(.*)$", 1).alias("file")


def publish(entries: DataFrame, root: str, parts: int | None = None) -> tuple[str | None, DataFrame]:
    """entries (ENTRY) -> (the commit's name, refused entries with their reason). Without an entry to store nothing is published. Of several rows of one entry the one with the greatest report stays."""
    spark, root = entries.sparkSession, root.rstrip("/")
    judged = entries.withColumn("_why", refused(entries))
    good = judged.filter("_why IS NULL").drop("_why")
    key = key_of(F.col("engine_sha"), F.col("command"), F.col("entry_sha"))
    good = good.withColumn("schema", F.lit(SCHEMA_VERSION)).withColumn("engine_sha", F.array_sort("engine_sha")).withColumn("key", key)
    good = good.withColumn("report_sha", F.sha2("report", 256)).withColumn("graph_sha", F.sha2("call_graph", 256))
    columns = [c for c in good.columns if c not in ("version", "engine", "entry", "key")]
    good = good.groupBy("version", "engine", "entry", "key").agg(F.max(F.struct("report", *[c for c in columns if c != "report"])).alias("r")).select("version", "engine", "entry", "key", "r.*")
    staged = f"{root}/staged-{uuid.uuid4().hex}"
    out = good.repartition(parts, "entry") if parts else good
    out.sortWithinPartitions("entry", "key").write.partitionBy(*IDENTITY).parquet(f"{staged}/data")
    bad = judged.filter("_why IS NOT NULL").select("version", "engine", "entry", F.col("_why").alias("reason"))
    fs, folder = _path(spark, staged)
    try:
        _files(spark, f"{staged}/data").write.parquet(f"{staged}/manifest")
    except Exception:
        fs.delete(folder, True)
        raise
    # Names of files differ from run to run, their contents do not: the name of a commit is that of its contents.
    digest = spark.read.parquet(f"{staged}/manifest").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("sha")), ""), 256).alias("d")).first()
    if not digest["n"]:
        fs.delete(folder, True)
        return None, bad
    name = digest["d"]
    _, target = _path(spark, f"{root}/commits/{name}")
    fs.mkdirs(target.getParent())
    if not fs.exists(target) and not fs.rename(folder, target) and not fs.exists(target):
        raise OSError(f"could not publish {name}")
    fs.delete(folder, True)
    _, mark = _path(spark, f"{root}/order/{time.time_ns():020d}-{name}")
    fs.create(mark, True).close()
    return name, bad


def commits(spark: SparkSession, root: str) -> list[str]:
    """The published commits, newest first, each once."""
    fs, p = _path(spark, f"{root.rstrip('/')}/order")
    names = sorted((s.getPath().getName() for s in fs.listStatus(p)), reverse=True) if fs.exists(p) else []
    return list(dict.fromkeys(n.split("-", 1)[1] for n in names))


def stored(spark: SparkSession, root: str) -> DataFrame | None:
    """Every stored row with `commit`, `age` (0: newest) and `intact`: whether its file is there with the content that the manifest says. None without a commit."""
    out = None
    for age, name in enumerate(commits(spark, root)):
        folder = f"{root.rstrip('/')}/commits/{name}"
        if not _exists(spark, f"{folder}/data"):
            continue
        schema = spark.read.parquet(f"{folder}/manifest")
        same = _files(spark, f"{folder}/data").withColumnRenamed("sha", "_sha").drop("length")
        good = schema.join(same, "file", "left").select("file", (F.col("sha") == F.col("_sha")).alias("intact"))
        listed = [r["file"] for r in good.filter("intact").select("file").collect()]  # names of data files, a bounded number for each commit
        broken = good.filter("NOT coalesce(intact, false)")
        rows = None
        if listed:
            rows = spark.read.option("basePath", f"{folder}/data").parquet(*[f"{folder}/data/{f}" for f in listed]).withColumn("intact", F.lit(True))
        parts = broken.select(F.regexp_extract("file", r"version=([^/]*)/", 1).alias("version"), F.regexp_extract("file", r"engine=([^/]*)/", 1).alias("engine"), F.lit(False).alias("intact"))
        rows = parts if rows is None else rows.withColumn("version", F.col("version").cast("string")).withColumn("engine", F.col("engine").cast("string")).unionByName(parts, allowMissingColumns=True)
        rows = rows.withColumn("commit", F.lit(name)).withColumn("age", F.lit(age))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def lookup(wanted: DataFrame, root: str) -> DataFrame:
    """wanted (version, engine, entry, entry_sha, engine_sha, command) -> those columns with state and report, call_graph.

    state: `hit`, or the first that holds of: `no store` for the version and engine, `never filled`, `other schema`, `other content` of the entry, `other engine` files, `other command`, `corrupt` (a file of the
    store's is not what was published, and no intact row answers), `bad digest` of the report. graph: `hit`, `not stored` or `bad digest`, only for hits. Of several commits the newest row that is a hit answers,
    else the one that is closest to a hit."""
    spark = wanted.sparkSession
    rows = stored(spark, root)
    want = wanted.withColumn("engine_sha", F.array_sort("engine_sha")).withColumn("_id", F.xxhash64(*IDENTITY, "entry", "entry_sha", F.to_json(F.struct("engine_sha", "command")))).dropDuplicates([*IDENTITY, "entry", "entry_sha", "engine_sha", "command"])
    none = F.lit(None).cast("string")
    if rows is None:
        return want.drop("_id").withColumns({"state": F.lit("no store"), "report": none, "graph": none, "call_graph": none})
    if "entry" not in rows.columns:  # not one intact file
        rows = rows.withColumns({"schema": F.lit(None).cast("int"), **dict.fromkeys(("entry", "entry_sha", "report", "call_graph", "report_sha", "graph_sha"), none), **dict.fromkeys(("engine_sha", "command"), F.lit(None).cast("array<string>"))})
    shops = rows.groupBy(*IDENTITY).agg(F.bool_or(~F.col("intact")).alias("_damaged")).withColumn("_shop", F.lit(True))
    there = rows.filter("intact").select(*IDENTITY, "entry", "age", F.lit(True).alias("_row"), F.col("schema").alias("s_schema"), F.col("entry_sha").alias("s_entry"), F.col("engine_sha").alias("s_engine"), F.col("command").alias("s_command"), "report", "report_sha", F.col("call_graph").alias("s_graph"), "graph_sha")
    found = want.join(shops, [*IDENTITY], "left").join(there, [*IDENTITY, "entry"], "left")
    checks = [
        (F.col("_shop").isNull(), "no store"),
        (F.col("_row").isNull(), "never filled"),
        (~F.col("s_schema").eqNullSafe(F.lit(SCHEMA_VERSION)), "other schema"),
        (~F.col("s_entry").eqNullSafe(F.col("entry_sha")), "other content"),
        (~F.col("s_engine").eqNullSafe(F.col("engine_sha")), "other engine"),
        (~F.col("s_command").eqNullSafe(F.col("command")), "other command"),
        ((F.trim("report") == "") | ~F.sha2("report", 256).eqNullSafe(F.col("report_sha")), "bad digest"),
    ]
    level = F.lit(len(checks))
    for i, (wrong, _) in reversed(list(enumerate(checks))):
        level = F.when(wrong, i).otherwise(level)
    found = found.withColumn("_level", level)
    best = found.groupBy("_id").agg(F.max_by(F.struct(*wanted.columns, "_level", "_damaged", "report", "s_graph", "graph_sha"), F.struct("_level", -F.coalesce("age", F.lit(0)))).alias("b")).select("b.*")
    hit = F.col("_level") == len(checks)
    state = F.element_at(F.array(*[F.lit(name) for _, name in checks], F.lit("hit")), F.col("_level") + 1)
    state = F.when(~hit & (F.col("_level") > 0) & F.coalesce("_damaged", F.lit(False)), "corrupt").otherwise(state)
    graph = F.when(hit, F.when(F.col("s_graph").isNull(), "not stored").when(F.sha2("s_graph", 256).eqNullSafe(F.col("graph_sha")), "hit").otherwise("bad digest"))
    return best.select(*wanted.columns, state.alias("state"), F.when(hit, F.col("report")).alias("report"), graph.alias("graph"), F.when(graph == "hit", F.col("s_graph")).alias("call_graph"))
