"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to `bits` bits each, every row gets the index of its cell on the Hilbert curve, and
the rows in curve order are cut into runs of equal row counts. Neighbouring cells share their dimensions, so each shard spans
a small box and readers can skip shards by the minima and maxima of every dimension (`shard_boxes`).

The global rank is found without a global sort: cells (at most 2**(bits * dimensions)) and their subcells (by a hash of the id)
are counted, offsets come from running sums over the counts, and rows are numbered inside their subcell only. A cell that
holds a third of all rows is spread over its subcells.

Strings are quantised in their order, by the rank of their value among all different ones, so that the minima and maxima of a shard, which are strings too, exclude others: while there are
at most 2**bits values each has a quantum of its own, and beyond, quantiles of the different values bound the quanta. Values are told apart by CODE_BYTES bytes behind what all begin
with.

Defined results: a null text has size 1 and the CRC of no bytes; null dimensions fall into quantum
0; rows without an id are spread by their other columns; repeated rows get ranks of their own; an empty table gives an empty
result.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table
from .sql_text import crc32

BITS = 5
SHARDS = 16
#: Subcells of a cell at least; and rows of one at most, if they are all in one cell.
SUBCELLS, SUBCELL_ROWS = 1024, 1 << 20


#: Bytes of a string that decide on its quantum.
CODE_BYTES = 7


@dataclass(frozen=True)
class Scale:
    """Of a text dimension: the bytes that all values begin with, and in order the codes that are the last of their quantum, 2**bits at most."""

    common: int = 0
    ends: tuple[int, ...] = ()


def text_code(column: str, common: int) -> Column:
    """An integer in the order of the strings' bytes behind their common beginning."""
    part = F.substring(F.encode(F.col(column), "UTF-8"), common + 1, CODE_BYTES)
    return F.conv(F.rpad(F.hex(part), 2 * CODE_BYTES, "0"), 16, 10).cast("long")


@dataclass(frozen=True)
class Dimension:
    """kind "half_octave": integers >= 1, two quanta for each power of two; "text": strings, by their rank among the different values."""

    column: str
    kind: str

    def quantum(self, bits: int = BITS, scale: Scale = Scale()) -> Column:
        """scale: see scales()."""
        top = (1 << bits) - 1
        if self.kind == "text":
            if not scale.ends:
                return F.lit(0)
            code = text_code(self.column, scale.common)
            rank = F.size(F.filter(F.array(*[F.lit(e) for e in scale.ends]), lambda e: e < code))
            return F.when(F.col(self.column).isNull(), 0).otherwise(F.floor(rank * top / max(1, len(scale.ends) - 1))).cast("int")
        binary = F.bin(F.greatest(F.col(self.column), F.lit(1)))
        half = F.when(F.substring(binary, 2, 1) == "1", 1).otherwise(0)
        return F.coalesce(F.least(2 * (F.length(binary) - 1) + half, F.lit(top)), F.lit(0)).cast("int")


def hilbert_index(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """Index on the Hilbert curve of points with `bits` bits on each axis (Skilling's transform)."""
    x = [a.astype(np.int64).copy() for a in axes]
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            there = (x[i] >> level) & 1 == 1
            swap = np.where(there, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(there, low, 0)
            x[0] ^= swap
            if i:
                x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        t ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for a in x:
            out = out << 1 | ((a ^ t) >> level & 1)
    return out


def curve_index(quanta: list[Column], bits: int = BITS) -> Column:
    @F.pandas_udf("long")
    def index(*axes: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index([a.to_numpy() for a in axes], bits))

    return index(*quanta)


def scales(df: DataFrame, dims: list[Dimension], bits: int = BITS) -> list[Scale]:
    """The scale of each dimension: two passes over the text columns, of which 2**bits numbers each come to the driver."""
    texts = [d.column for d in dims if d.kind == "text"]
    ends = df.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in texts for f in (F.min, F.max)]).first() if texts else {}
    out = []
    for d in dims:
        if d.kind != "text" or ends[f"min_{d.column}"] is None:
            out.append(Scale())
            continue
        common = len(os.path.commonprefix([ends[f"{f}_{d.column}"].encode() for f in ("min", "max")]))
        codes = df.filter(F.col(d.column).isNotNull()).select(text_code(d.column, common).alias("code")).distinct()
        steps = [(i + 1) / (1 << bits) for i in range(1 << bits)]
        out.append(Scale(common, tuple(sorted(set(codes.agg(F.percentile_approx("code", steps, 10_000)).first()[0])))))
    return out


def shard_by_curve(df: DataFrame, id_col: str, dims: list[Dimension], shards: int = SHARDS, bits: int = BITS, subcells: int = SUBCELLS) -> DataFrame:
    """Adds `curve` (index of the cell), `shard` (0 .. shards - 1, counts at most one apart) and `slot` (gapless from 0).

    Keep the input narrow: it is written once to the shared folder, and shuffled once.
    """
    known = scales(df, dims, bits)
    rows = materialise(df.withColumn("curve", curve_index([d.quantum(bits, k) for d, k in zip(dims, known, strict=True)], bits)))
    subcells = max(subcells, 1 << (rows.count() // SUBCELL_ROWS).bit_length())
    others = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns if c != id_col])
    spread = F.coalesce(F.crc32(F.col(id_col).cast("string")), F.crc32(others))
    rows = rows.withColumn("_sub", F.pmod(spread, F.lit(subcells)).cast("int"))
    counts = rows.groupBy("curve", "_sub").agg(F.count("*").alias("_n"))
    # One row for each cell of the curve at most: a bounded table.
    cells = counts.groupBy("curve").agg(F.sum("_n").alias("_cell"))
    upto = Window.orderBy("curve").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("curve", F.coalesce(F.sum("_cell").over(upto), F.lit(0)).alias("_base"), F.sum("_cell").over(Window.partitionBy()).alias("_total"))
    inside = Window.partitionBy("curve").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.join(cells, "curve").select("curve", "_sub", "_total", (F.col("_base") + F.coalesce(F.sum("_n").over(inside), F.lit(0))).alias("_start"))
    ties = [c for c in df.columns if c != id_col]
    order = Window.partitionBy("curve", "_sub").orderBy(id_col, *ties)
    ranked = rows.withColumn("_row", F.row_number().over(order) - 1).join(starts, ["curve", "_sub"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.col("_row"))
    shard = F.expr(f"int(_rank * {shards} div _total)")
    return ranked.withColumn("shard", shard).withColumn("slot", F.expr(f"_rank - (shard * _total + {shards - 1}) div {shards}")).drop("_sub", "_n", "_start", "_row", "_rank", "_total")


def shard_boxes(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Rows and the least and greatest value of every column for each shard: what a reader needs for pruning."""
    parts = [f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("rows"), *parts)


def shards_for(boxes: DataFrame, column: str, low, high) -> DataFrame:
    """The shards that may hold a value between low and high."""
    return boxes.filter((F.col(f"max_{column}") >= F.lit(low)) & (F.col(f"min_{column}") <= F.lit(high))).select("shard")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder for each shard, rows in slot order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


DOCUMENT_DIMENSIONS = [Dimension("lang", "text"), Dimension("source", "text"), Dimension("size", "half_octave")]


def op2_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "lang", "source")
    out = shard_by_curve(docs, "doc_id", DOCUMENT_DIMENSIONS)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def _hilbert_sql(source: str, names: list[str], bits: int = BITS) -> str:
    """`source` with a column `curve`: the same transform, one nested query for each step."""
    n, q = len(names), f"(SELECT *, {', '.join(f'{c} AS x{i}' for i, c in enumerate(names))} FROM {source})"
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for i in range(n):
            there = f"(x{i} >> {level}) & 1 = 1"
            if i == 0:
                q = f"(SELECT * REPLACE (CASE WHEN {there} THEN xor(x0, {low}) ELSE x0 END AS x0) FROM {q})"
            else:
                q = f"(SELECT * REPLACE (CASE WHEN {there} THEN xor(x0, {low}) ELSE xor(x0, xor(x0, x{i}) & {low}) END AS x0, CASE WHEN {there} THEN x{i} ELSE xor(x{i}, xor(x0, x{i}) & {low}) END AS x{i}) FROM {q})"
    for i in range(1, n):
        q = f"(SELECT * REPLACE (xor(x{i}, x{i - 1}) AS x{i}) FROM {q})"
    t = "0"
    for level in range(bits - 1, 0, -1):
        t = f"xor({t}, CASE WHEN (x{n - 1} >> {level}) & 1 = 1 THEN {(1 << level) - 1} ELSE 0 END)"
    q = f"(SELECT *, {t} AS t FROM {q})"
    terms = [f"(((xor(x{i}, t) >> {level}) & 1) << {level * n + n - 1 - i})" for level in range(bits) for i in range(n)]
    return f"(SELECT *, ({' + '.join(terms)})::BIGINT AS curve FROM {q})"


def _ranks(column: str, name: str) -> str:
    """Values and their quanta; the oracle is for tables with at most 2**BITS different values."""
    return f"(SELECT v, floor((row_number() OVER (ORDER BY v) - 1) * {(1 << BITS) - 1} / greatest(1, count(*) OVER () - 1))::INT AS q FROM (SELECT DISTINCT {column} AS v FROM documents WHERE {column} IS NOT NULL)) {name}"


_TOP = (1 << BITS) - 1
_SIZED = f"(SELECT *, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, {crc32("coalesce(text, '')")} AS text_crc32, {crc32('doc_id::VARCHAR')} % {SUBCELLS} AS sub FROM documents)"
_QUANTA = f"""(SELECT s.*, coalesce(a.q, 0) AS q0, coalesce(b.q, 0) AS q1,
  least({_TOP}, 2 * (length(ltrim(bin(size), '0')) - 1) + CASE WHEN substr(ltrim(bin(size), '0'), 2, 1) = '1' THEN 1 ELSE 0 END)::INT AS q2
  FROM {_SIZED} s LEFT JOIN {_ranks('lang', 'a')} ON a.v = s.lang LEFT JOIN {_ranks('source', 'b')} ON b.v = s.source)"""
OP2_SQL = f"""
WITH r AS (SELECT *, row_number() OVER (ORDER BY curve, sub, doc_id NULLS FIRST, size, text_crc32, lang, source) - 1 AS rnk, count(*) OVER () AS total
  FROM {_hilbert_sql(_QUANTA, ['q0', 'q1', 'q2'])})
SELECT doc_id, size, text_crc32, 'rows' AS law, (rnk * {SHARDS} // total)::INT AS shard,
  (rnk - ((rnk * {SHARDS} // total) * total + {SHARDS - 1}) // {SHARDS})::BIGINT AS slot, NULL::INT AS grown_shard, curve FROM r
"""
