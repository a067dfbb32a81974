"""Writers: sorted JSON details, tables with tabs, findings documents, an activity log, a partitioned store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def write_details(df: DataFrame, key: list[str], path: str, single: bool = False) -> None:
    """JSON lines in key order; one file only if asked."""
    ordered = df.orderBy(*key)
    (ordered.coalesce(1) if single else ordered).write.mode("overwrite").json(path)


def ordered_details(df: DataFrame, part: str, key: str, rest: list[str]) -> DataFrame:
    """(part, place, line): the detail lines of each part as JSON, in the order of the JSON text of their keys, byte by byte, so that two runs write the same document. Equal keys
    follow the order of their lines."""
    line = F.to_json(F.struct(F.col(key).alias("key"), *rest))
    return df.select(part, line.alias("line"), F.row_number().over(Window.partitionBy(part).orderBy(F.to_json(F.col(key)), line)).cast("long").alias("place"))


def write_tabs(df: DataFrame, path: str, missing: str = "NA") -> None:
    df.write.mode("overwrite").csv(path, sep="\t", nullValue=missing, emptyValue="", header=True)


def tab_lines(df: DataFrame, missing: str = "NA") -> DataFrame:
    """The rows as lines with tabs; tabs and line ends inside a value become spaces, which keeps every row a line."""
    cell = lambda c: F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]", " "), F.lit(missing))
    return df.select(F.concat_ws("\t", *[cell(c) for c in df.columns]).alias("value"))


def write_flips(flips: DataFrame, keyloss: DataFrame, path: str) -> None:
    """The complete lists of flips and, beside it, of lost join keys; no header, no row left out."""
    tab_lines(flips).write.mode("overwrite").text(path)
    tab_lines(keyloss).write.mode("overwrite").text(path + ".keyloss")


def append_activity(df: DataFrame, path: str) -> None:
    """Times keep their microseconds, by which turns are ordered."""
    df.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(path)


def store_by(df: DataFrame, partitions: list[str], path: str) -> None:
    """Replace only the partitions that df has; an empty result is refused, as it would hide that nothing was measured."""
    if df.isEmpty():
        raise ValueError("nothing to store")
    df.repartition(*partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def findings_document(found: DataFrame, by: str) -> DataFrame:
    """found (by, rule, fn, loc, message, level) -> one findings document (SARIF 2.1.0) for each value of `by`."""
    from ..functions.scalars import parse_location

    place = parse_location(F.col("loc"))
    where = F.when(
        place.isNotNull(),
        F.array(F.struct(F.struct(F.struct(place["file"].alias("uri")).alias("artifactLocation"), F.struct(place["line"].alias("startLine")).alias("region")).alias("physicalLocation"))),
    )
    result = F.struct(F.col("rule").alias("ruleId"), F.col("level"), F.struct(F.col("message").alias("text")).alias("message"), where.alias("locations"))
    rows = found.groupBy(by).agg(F.sort_array(F.collect_list(result)).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit("effects").alias("name")).alias("driver")).alias("tool"), F.col("results"))
    return rows.select(by, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def audit_documents(roots: DataFrame, leaves: DataFrame, by: str) -> DataFrame:
    """roots and leaves, rows of any fields with `by` -> (by, document): {"roots": [..], "leaves": [..]} for each value, rows in the order of their JSON text; a value with rows on one side only
    has an empty list on the other."""
    rows = lambda df, name: df.groupBy(by).agg(F.array_sort(F.collect_list(F.to_json(F.struct(*[c for c in df.columns if c != by])))).alias(name))
    both = rows(roots, "roots").join(rows(leaves, "leaves"), by, "full")
    listed = lambda c: F.concat(F.lit(f'"{c}":['), F.coalesce(F.array_join(c, ","), F.lit("")), F.lit("]"))
    return both.select(by, F.concat(F.lit("{"), listed("roots"), F.lit(","), listed("leaves"), F.lit("}")).alias("document"))


def level_of(rule: F.Column) -> F.Column:
    """Warnings are rule 007 and what speaks of completeness; the rest are errors."""
    return F.when(rule.endswith("007") | rule.startswith("completeness"), "warning").otherwise("error")
