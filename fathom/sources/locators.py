"""Which files a locator means, by the Hadoop file system of its path: folders, single files and prefixes alike, local or not."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from .reports import SIDECAR


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _glob(spark: SparkSession, folder: str, prefix: str, suffix: str) -> list[str]:
    """The files of a folder with this beginning and end, sorted; names are taken literally."""
    fs, p = _fs(spark, folder)
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p) if s.isFile()]
    return sorted(f"{folder.rstrip('/')}/{n}" for n in names if n.startswith(prefix) and n.endswith(suffix))


def _split(path: str) -> tuple[str, str]:
    folder, _, name = path.rpartition("/")
    return folder or ".", name


def stems(spark: SparkSession, locators: list[str]) -> list[str]:
    """Report paths without `.json`, sorted, each once: an explicit `.json`; else the prefix itself if its `.json` is there; else its `<prefix>.<part>.scan.json` siblings; else the prefix, so that reading it fails by
    its name."""
    out = set()
    for path in locators:
        if path.endswith(".json"):
            out.add(path.removesuffix(".json"))
            continue
        fs, p = _fs(spark, path + ".json")
        folder, name = _split(path)
        parts = [] if fs.exists(p) else _glob(spark, folder, name + ".", ".scan.json")
        out |= {x.removesuffix(".json") for x in parts} or {path}
    return sorted(out)


def report_files(spark: SparkSession, locator: str | None, home: str, start: str | None = None) -> list[str]:
    """The report files of a locator, without sidecars: a folder's `<home>/report.*.json`; a `.json` file; else the `<prefix>.*.json`. Without a locator the nearest folder from `start` upwards whose home has a
    report, which a home with nothing but settings has not."""
    plain = lambda names: [n for n in names if not re.search(SIDECAR, n)]
    if locator is not None:
        fs, p = _fs(spark, locator)
        there = fs.exists(p)
        if there and fs.getFileStatus(p).isDirectory():
            return plain(_glob(spark, f"{locator.rstrip('/')}/{home}", "report.", ".json"))
        if there and locator.endswith(".json"):
            return [locator]
        folder, name = _split(locator)
        return plain(_glob(spark, folder, name + ".", ".json"))
    _, p = _fs(spark, start or ".")
    while p is not None:
        if found := plain(_glob(spark, f"{p.toString().rstrip('/')}/{home}", "report.", ".json")):
            return found
        p = p.getParent()
    return []


class Unreadable(ValueError):
    pass


def read_object(spark: SparkSession, path: str, soft: bool = False) -> object | None:
    """The JSON value of one small settings or sidecar file. What is absent, no regular file, or no JSON raises Unreadable; soft: gives None. A byte order mark is skipped."""
    try:
        fs, p = _fs(spark, path)
        if not fs.exists(p):
            raise Unreadable(f"not found: {path}")
        if not fs.getFileStatus(p).isFile():
            raise Unreadable(f"not a regular file: {path}")
        text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
        try:
            return json.loads(text.removeprefix("﻿"))
        except ValueError as e:
            raise Unreadable(f"not JSON: {path}: {e}") from None
    except Unreadable:
        if soft:
            return None
        raise
