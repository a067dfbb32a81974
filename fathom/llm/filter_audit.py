"""Which filter removes what, in every order of a set of filters.

Every document has a mask of the filters that it fails. What an order of the filters does depends on the masks only: the masks of a part,
and those of its good and its toxic documents, are histograms, stacked as rows; multiplied by integer matrices of
2**k masks by k! orders times k steps they give what each step keeps, removes, finds redundant and fails alone. With five filters the
matrices are 32 by 600. Documents are read once; what is shuffled is a digest of each text for the search for
copies, and at most 2**k cells a part.

Defined results: null texts count as empty, a null source as the part ''; a null doc_id is neither smaller nor larger than another, so that it takes no part in the search for
copies; rows that share an id are counted one by one, and are not copies of each other; a document has a label if any of its rows in labels has
it; an empty table gives no parts; further columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

WORD = r"[^\x20\x09-\x0D]+"
#: Parts whose outcomes are computed together.
PARTS = 64
OUTCOMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def conditions(text: Column) -> dict[str, Column]:
    """The failure conditions that a text decides by itself."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, source) -> (doc_id, part, mask): bit i of the mask is set if the document fails filter i; the last is to be identical to the text of a smaller id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions(text).values())]
    own = sum(bits[1:], bits[0])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), own.cast("int").alias("own"), F.unhex(F.sha2(text, 256)).alias("digest"))
    rows = materialise(rows)
    first = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copy = F.when(F.col("doc_id") > F.col("first"), F.lit(1 << len(bits))).otherwise(F.lit(0))
    return rows.join(first.drop("n"), "digest", "left").select("doc_id", "part", (F.col("own") + copy).cast("int").alias("mask"))


def matrices(filters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """(order, step) of every column, and the matrices (masks by columns) of kept, removed, redundant, unique_fails and shapley."""
    k = len(filters)
    mask = np.arange(1 << k)[:, None]
    orders = list(itertools.permutations(range(k)))
    own = np.array([1 << f for o in orders for f in o])
    before = np.array([sum(1 << f for f in o[:s]) for o in orders for s in range(k)])
    fails, gone = (mask & own) != 0, (mask & before) != 0
    out = {"kept": (mask & (own | before)) == 0, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": mask == own}
    out = {name: m.astype(np.int64) for name, m in out.items()}
    same = (own[:, None] == own[None, :]).astype(np.int64)  # columns of one filter
    out["shapley"] = out["removed"] @ same
    return [("".join(filters[f] for f in o), s + 1) for o in orders for s in range(k)], out


def audit(flags: DataFrame, filters: str) -> DataFrame:
    """flags (part, mask, good, toxic), one row a document -> one row per part, order and step."""
    cells = flags.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum(F.col("toxic").cast("long")).alias("toxic"))
    stacked = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, by = matrices(filters)
        orders, steps = (pa.array(x) for x in zip(*columns, strict=True))
        for batch in batches:
            for a in range(0, batch.num_rows, PARTS):
                part = batch.slice(a, PARTS)
                lists = part.column(1)
                row = lists.value_parent_indices().to_numpy()
                mask, *counts = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
                histograms = np.zeros((3, part.num_rows, 1 << len(filters)), np.int64)
                for h, c in zip(histograms, counts, strict=True):
                    h[row, mask] = c
                every, good, toxic = histograms
                found = [every @ by[name] for name in OUTCOMES[:4]] + [good @ by["removed"], toxic @ by["removed"], every @ by["shapley"]]
                n = part.num_rows
                names = part.column(0).take(pa.array(np.repeat(np.arange(n), len(columns))))
                tiled = [x.take(pa.array(np.tile(np.arange(len(columns)), n))) for x in (orders, steps.cast(pa.int32()))]
                yield pa.RecordBatch.from_arrays([names, *tiled, *[pa.array(x.ravel()) for x in found]], ["part", "filter_order", "step", *OUTCOMES])

    return stacked.mapInArrow(products, "part string, filter_order string, step int, " + ", ".join(f"{x} long" for x in OUTCOMES))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    joined = rows.join(known, "doc_id", "left")
    return joined.withColumns({x: F.coalesce(F.col(x), F.lit(False)) for x in ("good", "toxic")})


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(labelled(masks(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")), "ABCDE")


#: DuckDB SQL for the query.
OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, concat(
    CASE WHEN len(w) < 200 THEN 'A' ELSE '' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS fails FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
h AS (SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
e AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM e a, e b, e c, e d, e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, filter_order[step] AS own, left(filter_order, step::INT - 1) AS earlier FROM o, range(1, 6) r(step)),
x AS (SELECT *, contains(fails, own) AS bad, translate(earlier, fails, '') <> earlier AS gone FROM h, s),
g AS (SELECT part, filter_order, step, own,
    sum(CASE WHEN NOT bad AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN bad AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN bad AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN fails = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN bad AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN bad AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
    FROM x GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM g
"""
