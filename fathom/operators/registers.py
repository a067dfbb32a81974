"""Joins and classifications around reports: which rows a gate sees, which entries count, where a finding lies, what must run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import glob_regex, normalised_name
from .effects import PALETTE, UNKNOWN

NONE = "array<string>"


def valid_units(units: DataFrame) -> DataFrame:
    """Rows with a name and at least one effect."""
    return units.filter(F.col("fn").isNotNull() & (F.coalesce(F.size("inferred"), F.lit(0)) > 0))


def gate_visible(units: DataFrame) -> DataFrame:
    """Rows that a gate judges: interface unions are filtered where it reads."""
    return units.filter(~F.coalesce("interface_union", F.lit(False)))


def is_foreign(hash_: Column, package: Column) -> Column:
    """Whether a row was read elsewhere and published again: it has a hash of another package. No hash or no package: its own."""
    return (F.coalesce(hash_, F.lit("")) != "") & (F.coalesce(package, F.lit("")) != "") & ~hash_.startswith(F.concat(package, F.lit("#")))


def own_rows(units: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """(the gate-visible rows of units (fn, hash, package, ..) that are not foreign, the number of foreign ones for each `by`)"""
    seen = gate_visible(units)
    foreign = F.coalesce(is_foreign(F.col("hash"), F.col("package")), F.lit(False))
    return seen.filter(~foreign), seen.groupBy(by).agg(F.count_if(foreign).alias("foreign"))


def effect_hint(name: Column) -> Column:
    """The known effect that a name means but for its case; null where the name is known, or unknown in any case (then whoever has the
    report decides)."""
    known = F.array(*[F.lit(e) for e in PALETTE])
    meant = F.try_element_at(F.filter(known, lambda e: F.lower(e) == F.lower(name)), F.lit(1))
    return F.when(~F.array_contains(known, name), meant)


def uncovered_libraries(uncovered: DataFrame, libraries: DataFrame, normalise: bool = False) -> DataFrame:
    """uncovered (entry, arm, name), libraries (entry, name) -> (entry, arm, name): uncovered names that equal a library of the entry, lie
    under one, or have one under them; with `normalise` only equal names, - and _ and case aside. Every ancestor is one
    equality probe."""
    if normalise:
        u = uncovered.withColumn("_n", normalised_name(F.col("name")))
        return u.join(libraries.select("entry", normalised_name(F.col("name")).alias("_n")).distinct(), ["entry", "_n"], "left_semi").select("entry", "arm", "name").distinct()

    def up(df: DataFrame, *keys: str) -> DataFrame:
        parts = F.split("name", r"\.")
        return df.select(*keys, "name", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))).alias("_up"))

    lib = libraries.select("entry", "name").distinct()
    under = up(uncovered, "entry", "arm").join(lib.select("entry", F.col("name").alias("_up")), ["entry", "_up"], "left_semi")
    above = uncovered.join(up(lib, "entry").select("entry", F.col("_up").alias("name")), ["entry", "name"], "left_semi")
    return under.select("entry", "arm", "name").unionByName(above.select("entry", "arm", "name")).distinct()


def live_entries(entries: DataFrame, hits: DataFrame) -> DataFrame:
    """entries (entry), hits of uncovered_libraries() -> (entry, live, arms, names): an entry is dead where either arm lists a
    library of its own as uncovered, as the join to it was never made."""
    dead = hits.groupBy("entry").agg(F.array_join(F.array_sort(F.collect_set("arm")), ",").alias("arms"), F.countDistinct("name").alias("names"))
    return entries.select("entry").distinct().join(dead, "entry", "left").select("entry", F.col("arms").isNull().alias("live"), F.coalesce("arms", F.lit("")).alias("arms"), F.coalesce("names", F.lit(0)).alias("names"))


#: The policies of a sweep, by name, and the reason classes that each denies (none: all of Unknown).
SWEEP = (
    ("bare", ()),
    ("reflect", ("reflect",)),
    ("dispatch", ("dispatch",)),
    ("unresolved", ("unresolved",)),
    ("reflect_unresolved", ("reflect", "unresolved")),
    ("dispatch_unresolved", ("dispatch", "unresolved")),
)


def policy_sweep(units: DataFrame, entry: str) -> DataFrame:
    """units (entry, fn, inferred, classes) -> (entry, policy, violations, code): every entry under every policy of SWEEP. The policies
    are columns of one aggregation, so that nothing is multiplied before it."""
    unknown = F.array_contains("inferred", UNKNOWN)
    classes = F.coalesce("classes", F.array().cast(NONE))
    count = lambda denied: F.count_if(unknown & F.arrays_overlap(classes, F.array(*[F.lit(c) for c in denied])) if denied else unknown)
    wide = units.groupBy(entry).agg(*[F.coalesce(count(denied), F.lit(0)).alias(name) for name, denied in SWEEP])
    long_ = F.explode(F.array(*[F.struct(F.lit(name).alias("policy"), F.col(name).alias("violations")) for name, _ in SWEEP]))
    return wide.select(entry, long_.alias("p")).select(entry, "p.policy", "p.violations", (F.col("p.violations") > 0).cast("int").alias("code"))


def hop_locations(hops: DataFrame, units: DataFrame) -> DataFrame:
    """hops (id, position, fn, loc) with their own location, or that of the one unit (fn, loc) of the name; names that several units share
    have no location that could be told."""
    one = units.groupBy("fn").agg(F.count("*").alias("_n"), F.min("loc").alias("_loc")).filter("_n = 1 AND _loc IS NOT NULL AND _loc <> ''")
    return hops.join(one.select("fn", "_loc"), "fn", "left").select("id", "position", "fn", F.coalesce(F.when(F.col("loc") != "", F.col("loc")), F.col("_loc")).alias("loc"))


def covered_by(wanted: DataFrame, annotated: DataFrame) -> DataFrame:
    """wanted (name), annotated (name, dotted or not) -> (name, covered), by the last segment of the annotated names."""
    short = annotated.select(F.regexp_extract("name", r"([^.]*)$", 1).alias("name"), F.lit(True).alias("_c")).distinct()
    return wanted.select("name").distinct().join(short, "name", "left").select("name", F.coalesce("_c", F.lit(False)).alias("covered"))


def workflow_key(id_: Column, name: Column) -> Column:
    """What runs are grouped by: the workflow's id, or its name where the id is null, 0 or empty."""
    text = id_.cast("string")
    return F.when(text.isNull() | text.isin("", "0"), name).otherwise(text)


def at_head(runs: DataFrame, head: str) -> DataFrame:
    """Runs of a commit; all of them for an empty one."""
    return runs if head == "" else runs.filter(F.col("sha") == head)


def tracked_only(findings: DataFrame, tracked: DataFrame) -> DataFrame:
    """findings (line: path:..) whose path is tracked (path), or has no folder in it."""
    path = F.substring_index("line", ":", 1)
    rows = findings.withColumn("_path", path)
    known = rows.join(tracked.select(F.col("path").alias("_path")).distinct(), "_path", "left_semi")
    return known.select(findings.columns).unionByName(rows.filter(~F.contains("_path", F.lit("/"))).join(tracked.select(F.col("path").alias("_path")).distinct(), "_path", "left_anti").select(findings.columns))


def without_reports(findings: DataFrame, files: DataFrame, header: str) -> DataFrame:
    """findings (line: path:..) without those in .json files that are reports themselves. files (path, body); a file that cannot be
    read as JSON excuses nothing, nor does one that is absent. A report is an object whose `header` object names a `spec`."""
    spec = F.try_variant_get(F.try_parse_json("body"), f"$.{header}.spec", "string")
    reports = files.filter(F.col("path").endswith(".json") & spec.isNotNull()).select(F.col("path").alias("_path")).distinct()
    return findings.withColumn("_path", F.substring_index("line", ":", 1)).join(reports, "_path", "left_anti").select(findings.columns)


def open_rows(ledger: DataFrame, register: DataFrame | None) -> DataFrame:
    """ledger (id) against the register's rows (id, state) -> (id, open). Without a register nothing can be said: an error, not a pass."""
    if register is None:
        raise ValueError("no register to check the ledger against")
    live = register.filter("state = 'OPEN'").select("id", F.lit(True).alias("_o")).distinct()
    return ledger.select("id").distinct().join(live, "id", "left").select("id", F.coalesce("_o", F.lit(False)).alias("open"))


#: How a compiler reports an error.
COMPILE_ERROR = r"^(/.*\.java):(\d+): error: "


def recovered(log: DataFrame, sources: DataFrame) -> DataFrame:
    """log (line), sources (file, number, text) -> (file, action, lines): a file whose errors are all on probe calls, lines that begin
    with `try {`, loses those lines; else, or where a line is not there, the file goes."""
    errors = log.select(F.regexp_extract("line", COMPILE_ERROR, 1).alias("file"), F.regexp_extract("line", COMPILE_ERROR, 2).alias("n")).filter("file <> ''")
    errors = errors.select("file", F.col("n").cast("int").alias("number")).distinct()
    text = sources.select("file", "number", F.ltrim("text").startswith("try {").alias("_probe"))
    rows = errors.join(text, ["file", "number"], "left")
    out = rows.groupBy("file").agg(F.bool_and(F.coalesce("_probe", F.lit(False))).alias("_all"), F.count("*").alias("lines"))
    return out.select("file", F.when(F.col("_all"), "drop lines").otherwise("drop file").alias("action"), "lines")


def workflow_required(workflows: DataFrame, changed: list[str], branch: str) -> DataFrame:
    """workflows (name, parsed, has_push, paths, tags, branches, paths_ignore: arrays of globs) -> (name, required, reason): must a push
    of the changed files to a branch have run it? Rules in order; what could not be read is required."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    matches = lambda text, glob: F.regexp_like(F.lit(text), glob_regex(glob))
    files = F.array(*[F.lit(f) for f in changed]).cast(NONE)
    globbed = lambda f, c: F.exists(c, lambda g: F.regexp_like(f, glob_regex(g)))
    on_branch = F.exists("branches", lambda g: matches(branch, g))
    all_ignored = F.forall(files, lambda f: globbed(f, "paths_ignore")) if changed else F.lit(False)
    hit = F.exists(files, lambda f: globbed(f, "paths")) if changed else F.lit(False)
    rules = (
        (~F.coalesce("parsed", F.lit(False)), True, "not parsed"),
        (~F.coalesce("has_push", F.lit(False)), False, "no push trigger"),
        (some("tags") & ~some("branches") & ~some("paths"), False, "tags only"),
        (some("branches") & ~on_branch, False, "other branch"),
        (some("paths_ignore") & all_ignored, False, "all ignored"),
        (~some("paths"), True, "every push"),
        (hit, True, "path"),
    )
    verdict = F.struct(F.lit(False).alias("required"), F.lit("no path").alias("reason"))
    for test, required, reason in reversed(rules):
        verdict = F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(required).alias("required"), F.lit(reason).alias("reason"))).otherwise(verdict)
    return workflows.select("name", verdict.alias("v")).select("name", "v.required", "v.reason")


def repeated_entries(entries: DataFrame) -> DataFrame:
    """lines of an entry list, without comments and blanks -> (entry, n) of those that occur more than once, which is an error of use:
    entries are told apart by their last path segment."""
    from ..functions.scalars import base_name

    line = F.btrim(F.regexp_replace("line", r"#.*$", ""))
    rows = entries.select(base_name(line).alias("entry"), line.alias("_l")).filter("_l <> ''")
    return rows.groupBy("entry").agg(F.count("*").alias("n")).filter("n > 1")


def recovery_sums(lines: DataFrame) -> DataFrame:
    """Lines of a recovery log (entry, line) -> (entry, lines, files): the third and sixth field of lines with seven or more fields."""
    f = F.split(F.btrim("line"), r"\s+")
    rows = lines.select("entry", f.alias("f")).filter(F.size("f") >= 7)
    return rows.groupBy("entry").agg(F.sum(F.element_at("f", 3).cast("long")).alias("lines"), F.sum(F.element_at("f", 6).cast("long")).alias("files"))


def run_states(text: DataFrame) -> DataFrame:
    """(repo, body: a JSON array of runs, or null) -> (repo, state, runs): ERR where it cannot be read, NONE for no run, else OK."""
    runs = F.from_json("body", "array<struct<workflowName:string,headSha:string,conclusion:string,createdAt:string>>")
    n = F.size(runs)
    return text.select("repo", F.when(runs.isNull(), "ERR").when(n == 0, "NONE").otherwise("OK").alias("state"), F.when(runs.isNull(), 0).otherwise(n).alias("runs"))


#: The rules of the policy checker.
RULES = (
    ("001", "UndeclaredEffect"),
    ("002", "UnusedCapability"),
    ("003", "UnresolvedCalls"),
    ("004", "AmbientAuthority"),
    ("005", "BaselineEffectGained"),
    ("006", "EffectBoundaryCrossed"),
    ("007", "InjectionRisk"),
    ("008", "EffectHostNotAllowlisted"),
    ("009", "ForbiddenEffectFlow"),
    ("010", "ContainmentBreached"),
    ("011", "PermissionScopeExceeded"),
)


def rule_catalogue(spark: SparkSession) -> DataFrame:
    """(code, name, level) of every rule."""
    from ..sources.sinks import level_of

    rules = spark.createDataFrame([(f"AS-EFF-{n}", name) for n, name in RULES], "code string, name string")
    return rules.withColumn("level", level_of(F.col("code")))


def with_rule(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """findings (code) with the rule's name and level; an unknown code keeps its own name and is an error. The catalogue is a few rows."""
    few = F.broadcast(rules.select("code", F.col("name").alias("_n"), F.col("level").alias("_l")))
    return findings.join(few, "code", "left").withColumn("name", F.coalesce("_n", "code")).withColumn("level", F.coalesce("_l", F.lit("error"))).drop("_n", "_l")


def surprising_reaches(reach: DataFrame, n: int = 10) -> DataFrame:
    """reach (fn, effect, hops) -> the n rows with the rarest effect, then the longest way, then by name. How surprise is measured is stated
    nowhere, so this order is a choice of this library."""
    total = reach.groupBy("effect").agg(F.count("*").alias("_n"))
    rows = reach.join(F.broadcast(total), "effect")  # a row for each effect
    return rows.orderBy("_n", F.desc("hops"), "fn", "effect").limit(n).select("fn", "effect", "hops")


def capped_details(df: DataFrame, order: list[str], most: int) -> DataFrame:
    """The first `most` rows of a detail list in order, each with the number of all rows: a report says how much it leaves out."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).limit(most).crossJoin(F.broadcast(total))
