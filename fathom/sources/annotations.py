"""Annotations of library members: XML files inside archives, one item for each annotated member."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILE = "annotations.xml"
#: The annotation that is looked for, by the end of its name, and the forms that name permissions.
ANNOTATION, FORMS = "RequiresPermission", ("value", "anyOf", "allOf")
XML = "item array<struct<_name:string,annotation:array<struct<_name:string,val:array<struct<_name:string,_val:string>>>>>>"


def unpacked(archives: DataFrame) -> DataFrame:
    """archives (path, content: a zip file) -> (path, member, text, error) of the annotation files in them, unpacked where an archive is read. An archive that cannot be read is a row with an
    error."""

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                        for name in z.namelist():
                            if name.endswith(FILE):
                                yield pd.DataFrame([(path, name, z.read(name).decode("utf-8", "replace"), None)], columns=["path", "member", "text", "error"])
                except (zipfile.BadZipFile, OSError) as e:
                    yield pd.DataFrame([(path, None, None, type(e).__name__)], columns=["path", "member", "text", "error"])

    return archives.select("path", "content").mapInPandas(members, "path string, member string, text string, error string")


def read_archives(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return unpacked(spark.read.format("binaryFile").load(paths).select("path", "content"))


def annotation_items(files: DataFrame) -> DataFrame:
    """files (path, member, text) -> (path, package, name, kind, permissions, conditional), a row for each annotation of a member that names a permission or is conditional. Texts that are no XML
    have none. The last form with permissions counts."""
    parsed = files.filter("text IS NOT NULL").select("path", "member", F.from_xml("text", XML, {"mode": "PERMISSIVE"}).alias("x"))
    items = parsed.select("path", "member", F.explode("x.item").alias("i")).select("path", "member", F.coalesce("i._name", F.lit("")).alias("name"), F.explode("i.annotation").alias("a")).filter(F.col("a._name").endswith(ANNOTATION))
    quoted = lambda v: F.regexp_extract_all(F.replace(F.coalesce(v["_val"], F.lit("")), F.lit("&quot;"), F.lit('"')), F.lit('"([^"]+)"'), F.lit(1))
    named = F.filter(F.transform("a.val", lambda v: F.struct(v["_name"].alias("kind"), quoted(v).alias("permissions"))), lambda v: v["kind"].isin(*FORMS) & (F.size(v["permissions"]) > 0))
    last = F.try_element_at(named, F.lit(-1))
    # The last value of `conditional` counts.
    said = F.try_element_at(F.filter("a.val", lambda v: v["_name"] == "conditional"), F.lit(-1))
    conditional = F.coalesce(F.lower(F.trim(said["_val"])) == "true", F.lit(False))
    package = F.replace(F.regexp_replace("member", f"/?{FILE}$", ""), F.lit("/"), F.lit("."))
    rows = items.select("path", package.alias("package"), "name", last["kind"].alias("kind"), F.coalesce(last["permissions"], F.array().cast("array<string>")).alias("permissions"), conditional.alias("conditional"))
    return rows.filter((F.size("permissions") > 0) | F.col("conditional"))


def forms(items: DataFrame) -> DataFrame:
    """(path, kind, n, percent): how often each form occurs, conditional ones without a permission as a form of their own."""
    n = items.groupBy("path", F.coalesce("kind", F.lit("conditional-only")).alias("kind")).agg(F.count("*").alias("n"))
    total = n.groupBy("path").agg(F.sum("n").alias("_t"))
    return n.join(total, "path").select("path", "kind", "n", F.round(100 * F.col("n") / F.col("_t"), 1).alias("percent"))
