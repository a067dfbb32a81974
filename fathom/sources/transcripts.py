"""Session transcripts (JSON lines, one file a session) as a data source that reads only the end of each file where that is enough.

A file is a partition. Only its last `tail` lines are read, unless the last human message, which begins the current turn, is not among them: then the whole file is. Every
row says which (`whole`).

    spark.dataSource.register(Transcripts)
    spark.read.format("transcripts").option("tail", 2000).load(folder)
"""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.ordering import after_last

TAIL, BLOCK = 2_000, 1 << 16
SCHEMA = "path string, line long, body string, whole boolean"
#: Tools that edit a file.
EDITORS = ("Edit", "MultiEdit", "Write", "NotebookEdit")


def is_human(body: str) -> bool:
    """A user's entry without a tool's result in it."""
    try:
        entry = json.loads(body)
        content = entry["message"]["content"] if isinstance(entry, dict) and entry.get("type") == "user" else None
    except (ValueError, KeyError, TypeError):
        return False
    return isinstance(content, str) or isinstance(content, list) and not any(isinstance(c, dict) and c.get("type") == "tool_result" for c in content)


def last_lines(path: str, most: int) -> tuple[list[str], int, bool]:
    """(the last lines, bytes before them, whether these are all lines), read backwards from the end in blocks."""
    with open(path, "rb") as f:
        at, data = f.seek(0, os.SEEK_END), b""
        while at > 0 and data.count(b"\n", 0, len(data) - 1) < most:
            step = min(BLOCK, at)
            at -= step
            f.seek(at)
            data = f.read(step) + data
    lines = data.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    kept = lines[-most:] if most else []
    whole = at == 0 and len(kept) == len(lines)
    return [x.decode("utf-8", "replace") for x in kept], at, whole


class FileOf(InputPartition):
    def __init__(self, path: str):
        self.path = path


class TranscriptReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.tail = options["path"].removeprefix("file://"), int(options.get("tail", TAIL))

    def partitions(self) -> list[FileOf]:
        found = sorted(glob.glob(os.path.join(self.path, "*.jsonl"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [FileOf(p) for p in found] or [FileOf("")]

    def read(self, partition: FileOf) -> Iterator[tuple]:
        if not partition.path:
            return
        lines, _, whole = last_lines(partition.path, self.tail)
        if not whole and not any(map(is_human, reversed(lines))):
            whole = True
            with open(partition.path, encoding="utf-8", errors="replace") as f:
                for i, line in enumerate(f):
                    yield (partition.path, i, line.rstrip("\n"), True)
            return
        for i, line in enumerate(lines):
            yield (partition.path, i - len(lines) if not whole else i, line, whole)


class Transcripts(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TranscriptReader:
        return TranscriptReader(self.options)


def read_transcripts(spark: SparkSession, path: str, tail: int = TAIL) -> DataFrame:
    """(path, line, body, whole); lines count from the start of the file, or, below 0, from its end. The folder must be one that all executors see under the same path."""
    spark.dataSource.register(Transcripts)
    return spark.read.format("transcripts").option("tail", tail).load(path)


def human(body: Column) -> Column:
    """is_human() of a column."""
    v = F.try_parse_json(body)
    content = F.try_variant_get(v, "$.message.content", "variant")
    blocks = F.try_variant_get(content, "$", "array<variant>")
    result = F.exists(blocks, lambda b: F.coalesce(F.try_variant_get(b, "$.type", "string") == "tool_result", F.lit(False)))
    kind = F.schema_of_variant(content)
    return F.coalesce(F.try_variant_get(v, "$.type", "string") == "user", F.lit(False)) & F.coalesce((kind == "STRING") | (kind.startswith("ARRAY") & ~F.coalesce(result, F.lit(False))), F.lit(False))


def turn_edits(lines: DataFrame) -> DataFrame:
    """lines (path, line, body) -> (path, edited): the distinct files edited since the last human message, sorted; empty if none was, and null where a session has no human message, as then it
    cannot be told what belongs to the turn."""
    turns = after_last(lines, ["path"], "line", human(F.col("body")))
    v = F.try_parse_json("body")
    blocks = F.try_variant_get(v, "$.message.content", "array<variant>")
    used = turns.filter(F.try_variant_get(v, "$.type", "string") == "assistant").select("path", F.explode(blocks).alias("b"))
    used = used.filter((F.try_variant_get("b", "$.type", "string") == "tool_use") & F.try_variant_get("b", "$.name", "string").isin(*EDITORS))
    file = F.coalesce(F.try_variant_get("b", "$.input.file_path", "string"), F.try_variant_get("b", "$.input.notebook_path", "string"))
    edits = used.select("path", file.alias("file")).filter("file IS NOT NULL").groupBy("path").agg(F.array_sort(F.collect_set("file")).alias("edited"))
    sessions = lines.groupBy("path").agg(F.bool_or(human(F.col("body"))).alias("_known"))
    return sessions.join(edits, "path", "left").select("path", F.when(F.col("_known"), F.coalesce("edited", F.array().cast("array<string>"))).alias("edited"))
