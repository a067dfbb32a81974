"""Suffix arrays by induced sorting, and repeats from permuted longest common prefixes.

Leftmost-smaller substrings are sorted by inducing, named by comparing neighbours symbol by symbol, and the string of their names is
sorted by the same method until all names differ; the sorted substrings then induce the whole array. Where buckets hold many suffixes,
what one scan of a bucket induces is written at once by NumPy, and a bucket is scanned again while it grows (runs of one symbol);
where they hold few, as with the names of deeper levels, suffixes are induced one by one. Both take time in proportion to the string.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tidy
from .repeats import byte_units, covered, keyed, repeat_spans, with_spans

#: Suffixes a bucket, on average, below which they are induced one by one.
FEW_IN_A_BUCKET = 50
WINDOW, GRAM, CUTS = 100, 20, 4


def suffix_types(t: np.ndarray) -> np.ndarray:
    """True for suffixes that are smaller than their right neighbour; the last symbol is a unique least one."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    nearest = differs[np.minimum(np.searchsorted(differs, np.arange(n - 1)), len(differs) - 1)]
    small = np.ones(n, np.bool_)
    small[:-1] = t[nearest] < t[nearest + 1]
    return small


def induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The suffix array induced from leftmost-smaller positions, given in order within each bucket."""
    n, ends = len(t), np.cumsum(sizes)
    starts = ends - sizes
    head, tail = starts.copy(), ends.copy()
    sa = np.full(n, -1, np.int64)
    by = np.argsort(t[lms], kind="stable")
    lms = lms[by]
    symbols = t[lms]
    lms_from = np.searchsorted(symbols, np.arange(len(sizes) + 1))

    def put_heads(found: np.ndarray) -> None:
        c = t[found]
        order = np.argsort(c, kind="stable")
        found, c = found[order], c[order]
        first = np.r_[0, np.flatnonzero(c[1:] != c[:-1]) + 1]
        count = np.diff(np.r_[first, len(c)])
        sa[np.repeat(head[c[first]] - first, count) + np.arange(len(c))] = found
        head[c[first]] += count

    def put_tails(found: np.ndarray) -> None:
        c = t[found]
        order = np.argsort(c, kind="stable")
        found, c = found[order], c[order]
        first = np.r_[0, np.flatnonzero(c[1:] != c[:-1]) + 1]
        count = np.diff(np.r_[first, len(c)])
        sa[np.repeat(tail[c[first]] - 1 + first, count) - np.arange(len(c))] = found
        tail[c[first]] -= count

    present = np.flatnonzero(sizes)
    for c in present:  # larger suffixes, from the least bucket up
        done = starts[c]
        while done < head[c]:
            scan, done = sa[done : head[c]], head[c]
            left = scan[scan > 0] - 1
            left = left[~small[left]]
            if len(left):
                put_heads(left)
        left = lms[lms_from[c] : lms_from[c + 1]]
        left = left[left > 0] - 1
        left = left[~small[left]]
        if len(left):
            put_heads(left)
    for c in present[::-1]:  # smaller suffixes, from the greatest bucket down
        done = ends[c]
        while done > tail[c]:
            scan, done = sa[tail[c] : done][::-1], tail[c]
            left = scan[scan > 0] - 1
            left = left[small[left]]
            if len(left):
                put_tails(left)
        scan = sa[starts[c] : head[c]][::-1]
        left = scan[scan > 0] - 1
        left = left[small[left]]
        if len(left):
            put_tails(left)
    if sizes[0]:
        sa[0] = n - 1
    return sa


def induce_singly(t: np.ndarray, small: np.ndarray, lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same, one suffix after the other."""
    n, ends = len(t), np.cumsum(sizes)
    head, tail, sa = (ends - sizes).tolist(), ends.tolist(), [-1] * n
    for i, c in zip(lms[::-1].tolist(), t[lms[::-1]].tolist(), strict=True):
        tail[c] -= 1
        sa[tail[c]] = i
    # The symbol to the left of each suffix if it begins a larger one, and if a smaller one; none for the first suffix and empty places.
    left = np.full((2, n + 1), -1, np.int64)
    left[0, 1:-1][~small[:-1]] = t[:-1][~small[:-1]]
    left[1, 1:-1][small[:-1]] = t[:-1][small[:-1]]
    larger, smaller = left.tolist()
    for i in sa:  # grows ahead of the scan
        c = larger[i]
        if c >= 0:
            at = head[c]
            sa[at] = i - 1
            head[c] = at + 1
    tail = ends.tolist()
    for i in reversed(sa):
        c = smaller[i]
        if c >= 0:
            tail[c] = at = tail[c] - 1
            sa[at] = i - 1
    sa[0] = n - 1
    return np.array(sa, np.int64)


def same_as_before(t: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each substring after the first whether it equals the one before it."""
    same = length[1:] == length[:-1]
    left, depth = np.flatnonzero(same), 0
    while len(left):
        left = left[length[left] > depth]
        differ = t[start[left] + depth] != t[start[left + 1] + depth]
        same[left[differ]] = False
        left, depth = left[~differ], depth + 1
    return same


def suffix_array(t: np.ndarray, alphabet: int) -> np.ndarray:
    """Suffix array of t (integers below alphabet); the last symbol is 0 and unique."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    small = suffix_types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(t, minlength=alphabet)
    step = induce if n >= FEW_IN_A_BUCKET * np.count_nonzero(sizes) else induce_singly
    sa = step(t, small, lms, sizes)
    if len(lms) <= 1:
        return sa
    is_lms = np.zeros(n, np.bool_)
    is_lms[lms] = True
    ordered = sa[is_lms[sa]]
    number = np.zeros(n, np.int64)
    number[lms] = np.arange(len(lms))
    length = (np.r_[lms[1:] + 1, n] - lms)[number[ordered]]
    names = np.cumsum(np.r_[0, ~same_as_before(t, ordered, length)])
    if names[-1] + 1 < len(lms):
        reduced = np.empty(len(lms), np.int64)
        reduced[number[ordered]] = names
        ordered = lms[suffix_array(reduced, int(names[-1]) + 1)]
    return step(t, small, ordered, sizes)


def permuted_lcp(t: np.ndarray, sa: np.ndarray, stop: np.ndarray, most: int) -> np.ndarray:
    """For each text position the common prefix with its predecessor in the suffix array, `most` at most, not beyond `stop` (the
    end of the position's piece; `stop` of a separator is its own place or less). Only irreducible values, and those where a
    piece begins, are compared; the others are one less than their left neighbour's."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    prior = before - 1
    reducible = np.zeros(n, np.bool_)
    inner = np.arange(1, n)
    ok = (before[1:] > 0) & (before[:-1] >= 0)
    reducible[1:] = ok & (t[inner - 1] == t[np.maximum(prior[1:], 0)]) & (before[:-1] == prior[1:]) & (stop[:-1] > inner - 1)
    first = np.flatnonzero(~reducible & (before >= 0))
    value = np.zeros(n, np.int64)
    active, length = first, 0
    while len(active) and length < most:
        a, b = active + length, before[active] + length
        alive = (a < stop[active]) & (b < n)
        active, a, b = active[alive], a[alive], b[alive]
        same = t[a] == t[b]
        active = active[same]
        length += 1
        value[active] = length
    source = np.maximum.accumulate(np.where(reducible, -1, np.arange(n)))
    value = np.where(reducible, np.maximum(0, value[source] - (np.arange(n) - source)), value)
    return np.minimum(value, stop - np.arange(n))


def equal_windows(symbols: np.ndarray, bounds: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, group) of the windows inside the pieces of a shard that occur more than once."""
    pieces = len(bounds) - 1
    # Pieces are joined by a separator (1) and end with 0; symbols move up by 2.
    place = np.arange(len(symbols)) + np.repeat(np.arange(pieces), np.diff(bounds))
    t = np.ones(len(symbols) + pieces + 1, np.int32)
    t[place] = symbols.astype(np.int32) + 2
    t[-1] = 0
    stop = np.zeros(len(t), np.int64)
    ends = bounds[1:] + np.arange(pieces)
    stop[place] = np.repeat(ends, np.diff(bounds))
    sa = suffix_array(t, 258)
    longest = int(np.diff(bounds).max()) + 1
    lcp = permuted_lcp(t, sa, stop, longest)
    room = stop - np.arange(len(t)) >= window
    # Between two equal windows the suffix array has equal windows only.
    tied = np.r_[False, (lcp[sa[1:]] >= window) & room[sa[1:]] & room[sa[:-1]]]
    group = np.cumsum(~tied)
    many = tied | np.r_[tied[1:], False]
    found = sa[many]
    back = found - np.searchsorted(ends, found, side="right")
    return back, group[many]


def op8_induced_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_later(table(spark, sf_dir, "documents").select("doc_id", "text"))


def remove_later(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep_text: bool = False, hot_classes: int | None = None) -> DataFrame:
    """docs (doc_id, text): every byte goes that a window of bytes covers which also starts earlier.

    Defined results: null texts are empty; texts shorter than a window stay whole; with null or repeated ids, rows are told
    apart and ordered by id (nulls first) and text. keep_text adds `kept`, the remaining bytes.
    """
    rows = keyed(docs).select("_key", "doc_id", "text")
    extra = {} if hot_classes is None else {"hot_classes": hot_classes}
    marked = with_spans(rows, repeat_spans(rows, byte_units, window, gram, True, equal_windows, True, cuts=CUTS, **extra))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in slices(batch, "text"):
                out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")}
                for i, spans in enumerate(part.column(2)):
                    text = raw[offs[i] : offs[i + 1]]
                    kept = text
                    gone = np.zeros(0, np.bool_)
                    if spans.is_valid:
                        at = spans.values
                        gone = covered(len(text), np.stack([at.field(0).to_numpy(), at.field(1).to_numpy()], 1))
                        kept = text[~gone]
                    out["n_bytes"].append(len(text))
                    out["n_removed"].append(len(text) - len(kept))
                    out["n_spans"].append(int((np.diff(np.r_[0, gone.astype(np.int8)]) == 1).sum()))
                    out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                    if keep_text:
                        out["kept"].append(kept.tobytes())
                columns = [part.column(0), *[pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True) if v or part.num_rows == 0]]
                yield pa.RecordBatch.from_arrays(columns[: 6 if keep_text else 5], ["doc_id", *list(out)[: 5 if keep_text else 4]])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")
    return marked.select(F.col("doc_id").cast("long"), "text", "spans").mapInArrow(tidy(cut), schema)


#: DuckDB SQL for the query.
OP8_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
win AS (SELECT doc_id, i, md5(b[i:i + 99]) AS k FROM (SELECT doc_id, b, unnest(range(1, n - 98)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
mark AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM rep),
run AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM mark),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 99 AS z FROM run GROUP BY ALL),
cut AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span),
part AS (SELECT cut.doc_id, a, hex(b[before + 1:a - 1]) AS h FROM cut JOIN d ON d.doc_id = cut.doc_id WHERE a > before + 1 UNION ALL SELECT d.doc_id, n + 1, hex(b[coalesce(z, 0) + 1:n]) FROM d LEFT JOIN (SELECT doc_id, max(z) AS z FROM span GROUP BY 1) s ON s.doc_id = d.doc_id WHERE n > coalesce(z, 0)),
kept AS (SELECT doc_id, unhex(string_agg(h, '' ORDER BY a)) AS k FROM part GROUP BY doc_id),
gone AS (SELECT doc_id, sum(z - a + 1) AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(coalesce(k, ''::BLOB)) AS kept_sha256 FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
