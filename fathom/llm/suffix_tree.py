"""Substring dedup with prefix-partitioned suffix trees over words.

Suffixes are partitioned by prefixes of variable length, twice. Between shards the prefix is a content-chosen gram, longer where it
is frequent (see repeats.py). Within a shard, the suffixes that start a window are split by their first word, and by one word more
wherever a prefix has too many, into groups of about GROUP_SUFFIXES. Each group's suffix tree is grown level by level: suffixes that
share an edge stay together, an internal node is made where they part, and a suffix becomes a leaf where it stands alone or
ends. Internal nodes at least as deep as the window are the repeats: every suffix below one repeats to that node's depth.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, slices, table, tidy
from .repeats import covered, keyed, repeat_spans, with_spans, word_units

WINDOW, GRAM = 35, 8
GROUP_SUFFIXES = 20_000


def prefix_groups(symbols: np.ndarray, suffixes: np.ndarray, depth: int, limit: int, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(depth, suffixes, node of each) such that suffixes of a node share `depth` words; nodes are batched up to `limit`, and
    a node with more suffixes is split by its next word while depth is below `most`."""
    _, node = np.unique(symbols[suffixes + depth], return_inverse=True)
    order = np.argsort(node, kind="stable")
    suffixes, node = suffixes[order], node[order]
    first = np.r_[0, np.flatnonzero(node[1:] != node[:-1]) + 1]
    count = np.diff(np.r_[first, len(node)])
    small = (count <= limit) | (depth + 1 >= most)
    for a, n in zip(first[~small], count[~small], strict=True):
        yield from prefix_groups(symbols, suffixes[a : a + n], depth + 1, limit, most)
    keep = np.repeat(small & (count > 1), count)
    suffixes, node = suffixes[keep], node[keep]
    while len(suffixes):
        end = len(suffixes) if len(suffixes) <= limit else max(1, int(np.searchsorted(node, node[limit])) or int(np.searchsorted(node, node[limit], side="right")))
        yield depth + 1, suffixes[:end], node[:end]
        suffixes, node = suffixes[end:], node[end:]


@dataclass
class Tree:
    """Internal nodes of the suffix trees of a group: depth in words and parent (-1: none). suffix: where each leaf's suffix starts;
    above: the node its leaf hangs from."""

    depth: np.ndarray
    parent: np.ndarray
    suffix: np.ndarray
    above: np.ndarray


def grow(symbols: np.ndarray, stop: np.ndarray, suffixes: np.ndarray, edge: np.ndarray, depth: int) -> Tree:
    """The trees of suffixes that share `depth` words with those of the same edge; a suffix ends before stop[its start]. symbols are
    small integers."""
    base = int(symbols.max(initial=0)) + 1
    edge = np.unique(edge, return_inverse=True)[1].astype(np.int64)
    node_above = np.full(int(edge.max(initial=-1)) + 1, -1, np.int64)
    depths, parents, leaves, above, made = [], [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while len(suffixes):
        ends = suffixes + depth >= stop[suffixes]
        word = symbols[np.minimum(suffixes + depth, len(symbols) - 1)]
        child, count = np.full(len(suffixes), -1, np.int64), np.ones(len(suffixes), np.int64)
        keys, child[~ends], n = np.unique(edge[~ends] * base + word[~ends], return_inverse=True, return_counts=True)
        count[~ends] = n[child[~ends]]
        ways = np.bincount(keys // base, minlength=len(node_above)) + np.bincount(edge[ends], minlength=len(node_above))
        parts = np.flatnonzero(ways > 1)
        depths.append(np.full(len(parts), depth))
        parents.append(node_above[parts])
        node_above[parts] = made + np.arange(len(parts))
        made += len(parts)
        alone = count == 1
        leaves.append(suffixes[alone])
        above.append(node_above[edge[alone]])
        suffixes, edge, child = suffixes[~alone], edge[~alone], child[~alone]
        first, child = np.unique(child, return_index=True, return_inverse=True)[1:]
        node_above, edge, depth = node_above[edge[first]], child, depth + 1
    none = [np.zeros(0, np.int64)]
    return Tree(np.concatenate(depths or none), np.concatenate(parents or none), np.concatenate(leaves), np.concatenate(above))


def repeats_below(tree: Tree, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes below internal nodes of at least the window's depth, and the highest such node: suffixes of one node share the window."""
    deep = tree.depth[tree.above] >= window
    suffixes, node = tree.suffix[deep], tree.above[deep]
    while True:
        up = tree.parent[node]
        climbs = (up >= 0) & (tree.depth[up] >= window)
        if not climbs.any():
            return suffixes, node
        node = np.where(climbs, up, node)


def equal_windows(symbols: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, group) of the windows inside the pieces of a shard that occur more than once."""
    length = np.diff(bounds)
    count = np.maximum(0, length - window + 1)
    starts = np.arange(count.sum()) + np.repeat(bounds[:-1] - (np.cumsum(count) - count), count)
    at, groups, base = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    if len(starts):
        symbols = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        stop = np.repeat(bounds[1:], length)
        for depth, suffixes, node in prefix_groups(symbols, starts, 0, GROUP_SUFFIXES, window):
            tree = grow(symbols, stop, suffixes, node, depth)
            suffixes, node = repeats_below(tree, window)
            at.append(suffixes)
            groups.append(node + base)
            base += len(tree.depth)
    return np.concatenate(at), np.concatenate(groups)


def remaining(raw: bytes, start: np.ndarray, end: np.ndarray, stay: np.ndarray) -> bytes:
    """The text without the words that go and the white space behind them."""
    if stay.all():
        return raw
    parts, at = [], 0
    edge = np.flatnonzero(np.diff(np.r_[True, stay, True].astype(np.int8)))
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True):
        parts.append(raw[at : start[a]])
        at = int(start[b]) if b < len(start) else len(raw)
    return b"".join([*parts, raw[at:]])


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot_classes: int | None = None) -> DataFrame:
    """docs (doc_id, text, ...): every word goes that a window of words covers which also starts anywhere else.

    Returns the columns of docs with `n_words`, `n_removed`, `kept_sha256` (of the kept words joined by one space) and `kept`
    (the text without the words that went; as it was where none did). Columns of docs with such names are replaced.

    Defined results: a null text has no words, and its kept text is null; texts shorter than a window stay whole; with null or
    repeated ids, rows are told apart by id and text; the row order is free.
    """
    new = ["n_words", "n_removed", "kept_sha256", "kept"]
    docs = docs.drop(*new, "_key", "spans")
    rows = keyed(docs)
    extra = {} if hot_classes is None else {"hot_classes": hot_classes}
    marked = with_spans(rows, repeat_spans(rows, word_units, window, gram, False, equal_windows, False, **extra))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in slices(batch, "text"):
                words = Words(raw, offs)
                out = {k: [] for k in new}
                data = raw.tobytes()
                there = part.column(part.schema.get_field_index("text")).is_valid().to_pylist()
                for i, spans in enumerate(part.column(part.num_columns - 1)):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    start, end = words.start[a:b], words.end[a:b]
                    stay = np.ones(b - a, np.bool_)
                    if spans.is_valid:
                        at = spans.values
                        stay = ~covered(b - a, np.stack([at.field(0).to_numpy(), at.field(1).to_numpy()], 1))
                    kept = b" ".join([data[s:e] for s, e in zip(start[stay].tolist(), end[stay].tolist(), strict=True)])
                    out["n_words"].append(b - a)
                    out["n_removed"].append(b - a - int(stay.sum()))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    out["kept"].append(remaining(data[offs[i] : offs[i + 1]], start - offs[i], end - offs[i], stay).decode() if there[i] else None)
                columns = [pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], [*part.schema.names[:-1], *new])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return marked.select(*docs.columns, "spans").mapInArrow(tidy(cut), f"{schema}, n_words long, n_removed long, kept_sha256 string, kept string")


def op5_suffix_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")


#: DuckDB SQL for the query.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY k) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, (SELECT unnest(range(35)) AS j)),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(word.t, ' ' ORDER BY word.p) AS joined, count(*) AS n FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p WHERE gone.p IS NULL GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(joined, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
