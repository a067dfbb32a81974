"""Change logs as sections: the lines from one heading of the second level to the next, file by file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEADING, UNRELEASED = "## ", r"^## \[?[Uu]nreleased\]?"


def lines_of(files: DataFrame) -> DataFrame:
    """files (path, value: the text) -> (path, line, text). Null texts have no lines; a last line break ends the last line."""
    text = F.regexp_replace("value", r"\r\n?", "\n")
    return files.filter("value IS NOT NULL AND value <> ''").select("path", F.posexplode(F.split(F.regexp_replace(text, r"\n$", ""), "\n")).alias("line", "text"))


def sections(lines: DataFrame) -> DataFrame:
    """lines (path, line, text) -> (path, section, first, heading, body, released), sections counted from 1 in the order of the file: a running number of headings tells a file's lines apart. What stands before the
    first heading is in no section."""
    heading = F.col("text").startswith(HEADING)
    order = Window.partitionBy("path").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.sum(heading.cast("int")).over(order)).filter("section > 0")
    parts = rows.groupBy("path", "section").agg(F.min("line").alias("first"), F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    texts = F.transform("l", lambda x: x["text"])
    out = parts.select("path", "section", "first", F.element_at(texts, 1).alias("heading"), F.array_join(F.slice(texts, F.lit(2), F.size(texts)), "\n").alias("body"))
    return out.withColumn("released", ~F.col("heading").rlike(UNRELEASED))


def newest_published(parts: DataFrame) -> DataFrame:
    """The first section of each file that is not a placeholder for what is unreleased."""
    rest = [c for c in parts.columns if c != "path"]
    return parts.filter("released").groupBy("path").agg(F.min_by(F.struct(*rest), "section").alias("s")).select("path", "s.*")


def of_version(parts: DataFrame, versions: DataFrame) -> DataFrame:
    """parts of sections(), versions (path, version) -> (path, version, section, heading, body): the first section whose heading begins with the bracketed version, else the first that begins with its first numbers and a space
    (`## 1.2 ..` for 1.2.3); neither: no row."""
    exact: Column = F.startswith("heading", F.concat(F.lit("## ["), "version", F.lit("]")))
    floor = F.startswith("heading", F.concat(F.lit("## "), F.regexp_replace("version", r"\.[^.]*$", ""), F.lit(" ")))
    rows = parts.join(versions, "path").withColumn("_rank", F.when(exact, 0).when(floor, 1)).filter("_rank IS NOT NULL")
    best = rows.groupBy("path", "version").agg(F.min_by(F.struct("section", "heading", "body"), F.struct("_rank", "section")).alias("s"))
    return best.select("path", "version", "s.*")
