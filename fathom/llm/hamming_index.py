"""Nearest neighbours by multi-index hashing.

Unit vectors are rotated by a learned rotation and cut to signs: binary codes of BITS bits in SUBSTRINGS substrings, each an
index of its own. By the pigeonhole principle two codes within a Hamming radius agree closely in some substring, so probing
every substring's buckets within its share of the radius retrieves every code within the radius; each pair is taken in the
first substring that matches, and its cosine is computed in double precision from the original vectors. The radius and the
rotation are fitted on a bounded sample (FIT_VALUES numbers); every row is indexed. Queries that find too few neighbours in the
radius are compared with all rows, in blocks.

Buckets with many rows or queries are cut into blocks of DATA_BLOCK rows by QUERY_BLOCK queries, each a group of its own; the
table of bucket sizes that says so has SUBSTRINGS * 2**(BITS / SUBSTRINGS) rows at most and is the only broadcast.

Defined results: rows with a null id, a null, zero or differently sized vector, or a null or non-finite component take no part;
a query never finds its own row; rows that share an id are told apart, so that each asks for itself and can be found by the others; ties
go to the smaller id; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import binary_rows, materialise, table

BITS, SUBSTRINGS = 64, 8
WIDTH = BITS // SUBSTRINGS
FIT_VALUES = 1_000_000
FIT_QUERIES = 300
#: The share of true neighbours in the sample that the radius takes in.
COVERAGE = 0.985
DATA_BLOCK, QUERY_BLOCK = 512, 512


@dataclass
class Codes:
    rotation: np.ndarray
    """(dimensions, BITS)"""
    radius: int


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def encode(vectors: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    return np.packbits(unit(vectors) @ rotation > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def learn_rotation(x: np.ndarray, rounds: int = 30, seed: int = 7) -> np.ndarray:
    """Rotations that bring unit vectors close to the corners of a cube (alternating signs and Procrustes steps); as many,
    each on the leading directions, as BITS needs."""
    rng = np.random.default_rng(seed)
    dims = min(x.shape[1], BITS)
    lead = np.linalg.svd(x, full_matrices=False)[2][:dims].T if x.shape[0] >= dims else np.eye(x.shape[1])[:, :dims]
    v, parts = x @ lead, []
    while sum(p.shape[1] for p in parts) < BITS:
        r = np.linalg.qr(rng.standard_normal((dims, dims)))[0]
        for _ in range(rounds):
            a, _, b = np.linalg.svd(np.sign(v @ r).T @ v)
            r = (a @ b).T
        parts.append(lead @ r)
    return np.concatenate(parts, 1)[:, :BITS]


def fit(vectors: np.ndarray, k: int) -> Codes:
    """vectors: a sample."""
    x = unit(vectors)
    rotation = learn_rotation(x)
    codes = encode(vectors, rotation)
    asked = np.arange(0, len(x), max(1, len(x) // FIT_QUERIES))[:FIT_QUERIES]
    cosine = x[asked] @ x.T
    cosine[np.arange(len(asked)), asked] = -2
    near = np.argsort(-cosine, axis=1)[:, : min(k, len(x) - 1)]
    apart = np.bitwise_count(codes[asked][:, None] ^ codes[near]).ravel() if near.size else np.zeros(1)
    return Codes(rotation, int(np.quantile(apart, COVERAGE, method="higher")))


def radii(radius: int) -> list[int]:
    """The radius of each substring, -1 for none: codes within `radius` are within one of these somewhere."""
    each, more = divmod(radius, SUBSTRINGS)
    return [each] * (more + 1) + [each - 1] * (SUBSTRINGS - more - 1)


def within(width: int, radius: int) -> np.ndarray:
    """All masks of at most `radius` bits."""
    return np.array([sum(1 << b for b in c) for n in range(radius + 1) for c in itertools.combinations(range(width), n)], np.int64)


def usable(df: DataFrame, id_col: str, vector: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and the number of dimensions: the most frequent one."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v")).filter("id IS NOT NULL AND size(v) > 0")
    finite = F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    most = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return (rows.filter(F.size("v") == most["d"]), most["d"]) if most else (rows, 0)


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def best_in_block(queries: pa.Table, data: pa.Table, dims: int, k: int, radius: int) -> pa.Table:
    """The k nearest of each query among the block's rows that this substring is the first to match."""
    empty = pa.table({"query_row": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    if not queries.num_rows or not data.num_rows:
        return empty
    sub = queries["sub"][0].as_py()
    q, d = queries["code"].to_numpy().view(np.uint64), data["code"].to_numpy().view(np.uint64)
    (qrow, qid), (drow, did) = ((t["row"].to_numpy(), t["id"].to_numpy()) for t in (queries, data))
    qv, dv = _matrix(queries["v"], dims), _matrix(data["v"], dims)
    qn, dn = np.sqrt((qv * qv).sum(1)), np.sqrt((dv * dv).sum(1))
    out = []
    for a in range(0, len(q), 64):
        differ = q[a : a + 64, None] ^ d[None, :]
        hit = (np.bitwise_count(differ) <= radius) & (qrow[a : a + 64, None] != drow[None, :])
        for j, r in enumerate(radii(radius)[: max(0, sub)]):
            if r >= 0:
                hit &= np.bitwise_count(differ >> np.uint64(WIDTH * j) & np.uint64((1 << WIDTH) - 1)) > r
        qi, di = np.nonzero(hit)
        if not len(qi):
            continue
        qi += a
        score = (qv[qi] * dv[di]).sum(1) / (qn[qi] * dn[di])
        order = np.lexsort((did[di], -score, qi))
        qi, di, score = qi[order], di[order], score[order]
        first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
        place = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)]))
        top = place < k
        out.append((qrow[qi[top]], qid[qi[top]], did[di[top]], score[top]))
    if not out:
        return empty
    return pa.table({n: np.concatenate(c) for n, c in zip(("query_row", "query_id", "vec_id", "score"), zip(*out, strict=True), strict=True)})


def _in_blocks(data: DataFrame, queries: DataFrame, dims: int, k: int, radius: int) -> DataFrame:
    """data, queries: (sub, bucket, row, id, code, v). Every pair of blocks of a bucket is one group."""
    count = lambda df, name: df.groupBy("sub", "bucket").agg(F.count("*").alias(name))
    sizes = F.broadcast(count(data, "nd").join(count(queries, "nq"), ["sub", "bucket"]).select("sub", "bucket", F.ceil(F.col("nd") / DATA_BLOCK).cast("int").alias("db"), F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("qb")))
    spread = lambda own: F.pmod(F.xxhash64("row"), F.col(own)).cast("int")
    every = lambda other: F.explode(F.sequence(F.lit(0), F.col(other) - 1))
    d = data.join(sizes, ["sub", "bucket"]).withColumn("x", spread("db")).withColumn("y", every("qb"))
    q = queries.join(sizes, ["sub", "bucket"]).withColumn("y", spread("qb")).withColumn("x", every("db"))
    names, key = ["sub", "bucket", "x", "y", "row", "id", "code", "v"], ["sub", "bucket", "x", "y"]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        return best_in_block(left, right, dims, k, radius)

    return q.select(names).groupBy(key).cogroup(d.select(names).toDF(*names).groupBy(key)).applyInArrow(best, "query_row long, query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(df: DataFrame, id_col: str, vector: str, is_query, k: int = 5, radius: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row where is_query(id) holds."""
    rows, dims = usable(df, id_col, vector)
    spark = df.sparkSession
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if rows.groupBy("id").count().filter("count > 1").isEmpty():
        rows = rows.withColumn("row", F.col("id"))
    else:
        rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()))
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(2, FIT_VALUES // dims)).toArrow()["v"].combine_chunks()
    model = fit(np.asarray(sample.flatten()).reshape(-1, dims), k)
    radius = min(BITS, model.radius if radius is None else radius)
    rotation = model.rotation

    def coded(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                v = np.asarray(part.column(1).flatten()).reshape(-1, dims).astype(np.float64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(encode(v, rotation).view(np.int64)), binary_rows(v.view(np.uint8).ravel(), np.arange(len(v) + 1) * dims * 8)], ["id", "row", "code", "v"])

    codes = materialise(rows.mapInArrow(coded, "id long, row long, code long, v binary"))
    piece = lambda j: F.shiftrightunsigned("code", WIDTH * j).bitwiseAND((1 << WIDTH) - 1)
    subs = [(j, r) for j, r in enumerate(radii(radius)) if r >= 0]
    indexed = F.explode(F.array(*[F.struct(F.lit(j).alias("sub"), piece(j).alias("bucket")) for j, _ in subs]))
    nearby = lambda j, r: F.transform(F.array(*[F.lit(int(x)) for x in within(WIDTH, r)]), lambda m: F.struct(F.lit(j).alias("sub"), piece(j).bitwiseXOR(m).alias("bucket")))
    probes = F.explode(F.flatten(F.array(*[nearby(j, r) for j, r in subs])))
    data = codes.select(indexed.alias("at"), "row", "id", "code", "v").select("at.*", "row", "id", "code", "v")
    asking = codes.filter(is_query(F.col("id")))
    queries = asking.select(probes.alias("at"), "row", "id", "code", "v").select("at.*", "row", "id", "code", "v")
    found = materialise(_top(_in_blocks(data, queries, dims, k, radius), k))
    total = codes.count()
    done = found.groupBy("query_row").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    rest = asking.join(done, asking["row"] == done["query_row"], "left_anti")
    if total > 1 and not rest.isEmpty():
        whole = lambda d: d.select(F.lit(-1).alias("sub"), F.lit(0).alias("bucket"), "row", "id", "code", "v")
        exact = _top(_in_blocks(whole(codes), whole(rest), dims, k, BITS), k)
        found = found.join(done, "query_row", "left_semi").unionByName(exact)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", lambda i: i % 50 == 0)
