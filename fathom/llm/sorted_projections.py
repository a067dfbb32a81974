"""Near duplicates among vectors by sorted projection passes.

Equal vectors with equal labels are one class; the rest works on classes. Each pass orders all vectors by label and by the concatenated sign
bits of 64 random projections, so that near vectors stand close together unless one of the first bits parts them, and compares every vector with
the WINDOW that follow it. The verified pairs of all passes are united. The number of passes follows from the size of the largest
label and the recall wanted for a pair that is just near enough; it grows with the logarithm of the size.

A vector with WINDOW links or more may stand in a crowd wider than any window. Such vectors are compared with their whole
component, in blocks of CROWD by CROWD that give counts rather than pairs, so that n_links is no matter of the window.

Defined results: vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do those with a null label, and vectors of different sizes with
each other; rows that share an id, or have none, are told apart (nulls first), each with its own row in the result; an empty table gives an empty result;
further columns are not looked at.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialise, table, tidy
from .components import components

THRESHOLD = 0.98
#: Neighbours that each vector is compared with in each pass.
WINDOW = 32
BITS = 64
#: Of the pairs at the threshold itself; nearer ones are found more often.
RECALL = 0.99
#: The sorted runs are cut into groups of so many rows, and the crowds into parts of so many.
BLOCK, CROWD = 2048, 512


def passes(size: int, threshold: float, recall: float = RECALL) -> int:
    """So many that a pair at the threshold falls at least once with this probability into a cell of WINDOW of the `size` vectors of a label: it must
    agree in as many leading bits as halve the label down to such a cell, and agrees in each with probability 1 - angle / pi."""
    bits = max(1, math.ceil(math.log2(max(2, size / WINDOW)))) + 1
    together = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - together))) if together < 1 else 2


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of one size."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(values[1:] != values[:-1]) + 1
    yield from zip(np.r_[0, edges], np.r_[edges, len(values)], strict=True)


def usable(df: DataFrame, id_col: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(every row: key, vec_id; those that can be linked: key, kind, v). kind: the label and the number of dimensions."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).alias("v"), F.col(label).cast("string").alias("label"))
    ids = rows.groupBy("vec_id").agg(F.count("*").alias("n"))
    if ids.filter(F.col("vec_id").isNull() | (F.col("n") > 1)).isEmpty():
        rows = rows.withColumn("key", F.col("vec_id"))
    else:
        order = [F.col("vec_id").asc_nulls_first(), F.xxhash64("v", "label")]
        rows = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("key", F.monotonically_increasing_id()))
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    good = rows.filter(F.col("label").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0))
    return rows.select("key", "vec_id"), good.select("key", F.concat_ws(":", F.size("v").cast("string"), "label").alias("kind"), "v")


@functools.lru_cache(maxsize=64)
def projections(dims: int, p: int) -> np.ndarray:
    """Fixed by the number of dimensions and the pass."""
    return np.random.default_rng([dims, p]).standard_normal((dims, BITS))


def keys_of(v: np.ndarray, count: int) -> np.ndarray:
    """(rows, passes): sort keys, the sign bits of 64 projections each."""
    out = np.empty((len(v), count), np.int64)
    for p in range(count):
        out[:, p] = np.packbits(v @ projections(v.shape[1], p) > 0, axis=1).view(">u8")[:, 0].astype(np.uint64).view(np.int64)
    return out


def sorted_ranks(vectors: DataFrame, count: int) -> DataFrame:
    """vectors (key, kind, v) -> (key, rank): the place of a vector in each of the passes, which follow one another in one order."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _runs(pc.list_value_length(batch.column(2)).to_numpy()):
                part = batch.slice(a, b - a)
                keys = keys_of(_vectors(part.column(2)), count)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(count, dtype=np.int32), n)), part.column(1).take(pa.array(np.repeat(np.arange(n), count))), pa.array(keys.ravel()), part.column(0).take(pa.array(np.repeat(np.arange(n), count)))], ["pass", "kind", "code", "key"])

    order = ["pass", "kind", "code", "key"]
    codes = vectors.mapInArrow(tidy(coded), "pass int, kind string, code long, key long")
    placed = materialise(codes.repartitionByRange(*order).sortWithinPartitions(*order).select("key", F.monotonically_increasing_id().alias("at")))
    part = F.shiftright("at", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("part", F.coalesce(before, F.lit(0)).alias("start"))  # a row for each partition of the sort
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select("key", (F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("rank"))


def window_links(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (block, rank, key, kind, v) in order -> near pairs (a, b) whose first row belongs to the block."""
    for t in _groups(batches, 1):
        rank, key = t["rank"].to_numpy(), t["key"].to_numpy()
        own = rank // BLOCK == t["block"][0].as_py()
        column = t["v"].combine_chunks()
        for a, b in _runs(t["kind"].to_numpy()):
            x = _vectors(column.slice(a, b - a))
            norm = np.sqrt(np.einsum("ij,ij->i", x, x))
            for d in range(1, min(WINDOW, len(x) - 1) + 1):
                score = np.einsum("ij,ij->i", x[:-d], x[d:]) / (norm[:-d] * norm[d:])
                hit = np.flatnonzero((score >= threshold) & own[a : b - d]) + a
                hit = hit[key[hit] != key[hit + d]]
                if len(hit):
                    one, two = key[hit], key[hit + d]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[pa.Table]:
    """The rows with equal values in the first columns, one table after the other, from rows that arrive in order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy() for i in range(columns)])
        edges = [0, *(np.flatnonzero((values[:, 1:] != values[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and any(held[0].column(i)[0] != batch.column(i)[a] for i in range(columns)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def found_pairs(vectors: DataFrame, threshold: float) -> DataFrame:
    """vectors (key, kind, v), all different -> (a, b): pairs that a pass brings close together and that are near, once each."""
    largest = vectors.groupBy("kind").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    ranks = sorted_ranks(vectors, passes(largest, threshold))
    block = F.floor(F.col("rank") / BLOCK).cast("long")
    ahead = F.when((F.col("rank") % BLOCK < WINDOW) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    dealt = ranks.join(vectors, "key").select(F.explode(ahead).alias("block"), "rank", "key", "kind", "v")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return window_links(batches, threshold)

    return dealt.repartition("block").sortWithinPartitions("block", "rank").mapInArrow(tidy(linked), "a long, b long").distinct()


def crowd_counts(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Rows (comp, x, y, right, key, m, full, v): every left row of a group (all of them full) against every right one. Gives (key, n): for a left row
    what it is linked with on the right, for a right row that is not full what it is linked with on the left."""
    for t in _groups(batches, 3):
        right = t["right"].to_numpy()
        cut = int(np.searchsorted(right, 1))
        if cut in (0, len(right)):
            continue
        key, m, full = (t[c].to_numpy(zero_copy_only=False) for c in ("key", "m", "full"))
        x = _vectors(t["v"].combine_chunks())
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
        to_left, to_right = np.zeros(cut, np.int64), np.zeros(len(key) - cut, np.int64)
        for a in range(0, cut, 256):
            b = min(cut, a + 256)
            near = (x[a:b] @ x[cut:].T >= threshold) & (key[a:b, None] != key[None, cut:])
            to_left[a:b] += near @ m[cut:]
            to_right += m[a:b] @ near
        keep = ~full[cut:].astype(np.bool_)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[key[:cut], key[cut:][keep]]), pa.array(np.r_[to_left, to_right[keep]])], ["key", "n"])


def crowded(vectors: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """members (key, comp, m, full) of the components that have a full vector -> (key, n): links in which a full vector takes part."""
    sizes = members.groupBy("comp").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("ys"), F.ceil(F.sum(F.col("full").cast("long")) / CROWD).cast("int").alias("xs"))
    rows = members.join(sizes, "comp").join(vectors.select("key", "v"), "key")
    part = lambda of: F.pmod(F.xxhash64("key"), F.col(of)).cast("int")
    each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    rest = ["key", "m", "full", "v"]
    left = rows.filter("full").withColumn("x", part("xs")).withColumn("y", each("ys")).select("comp", "x", "y", F.lit(0).alias("right"), *rest)
    right = rows.withColumn("y", part("ys")).withColumn("x", each("xs")).select("comp", "x", "y", F.lit(1).alias("right"), *rest)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return crowd_counts(batches, threshold)

    blocks = left.unionByName(right).repartition("comp", "x", "y").sortWithinPartitions("comp", "x", "y", "right")
    return blocks.mapInArrow(tidy(counted), "key long, n long")


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of df: (vec_id, n_links, component_id, kept)."""
    ids, good = usable(df, id_col, vector, label)
    good = materialise(good.withColumn("s1", F.xxhash64("kind", "v")).withColumn("s2", F.xxhash64("v", F.lit(1), "kind")))
    same = materialise(good.groupBy("s1", "s2").agg(F.min("key").alias("rep"), F.count("*").alias("m")).filter("m > 1"))
    member = materialise(good.select("key", "s1", "s2").join(same, ["s1", "s2"], "left").select("key", F.coalesce("rep", "key").alias("rep"), F.coalesce("m", F.lit(1)).alias("m")))
    reps = member.filter("key = rep").select("key", "m")
    vectors = materialise(good.select("key", "kind", "v").join(reps.select("key"), "key", "left_semi"))
    pairs = materialise(found_pairs(vectors, threshold))
    comps = components(pairs).withColumnRenamed("node", "key")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    full = both.groupBy(F.col("a").alias("key")).agg(F.count("*").alias("n")).select("key", (F.col("n") >= WINDOW).alias("full"))
    known = materialise(full.join(comps, "key").join(reps, "key").select("key", F.col("component").alias("comp"), "m", "full"))
    busy = known.filter("full").select("comp").distinct()
    counts = crowded(vectors, known.join(busy, "comp", "left_semi"), threshold)
    side = known.select(F.col("key").alias("b"), F.col("m").alias("mb"), F.col("full").alias("fb"))
    few = both.join(side, "b").join(known.select(F.col("key").alias("a"), F.col("full").alias("fa")), "a").filter("NOT fa AND NOT fb").select(F.col("a").alias("key"), F.col("mb").alias("n"))
    links = counts.unionByName(few).groupBy("key").agg(F.sum("n").alias("n"))
    classes = reps.join(known.select("key", "comp"), "key", "left").join(links, "key", "left")
    classes = materialise(classes.select(F.col("key").alias("rep"), (F.col("m") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("comp", "key").alias("comp")))
    discard(pairs, vectors, good, same, known)
    placed = member.select("key", "rep").join(classes, "rep").select("key", "n_links", "comp")
    out = ids.join(placed, "key", "left").select("key", "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("comp", "key").alias("comp"))
    least = ids.select(F.col("key").alias("comp"), F.col("vec_id").alias("component_id"))
    return out.join(least, "comp").select("vec_id", "n_links", "component_id", (F.col("key") == F.col("comp")).alias("kept"))


def op13_sorted_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


#: DuckDB SQL for the query: all pairs of a label.
OP13_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
g AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.y FROM r JOIN l ON l.x = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x) USING (vec_id)
"""
