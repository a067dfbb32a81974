"""Exact repeats of fixed-length windows across a corpus, found by content-chosen anchors.

The anchor of a window of W units (bytes or words) is the least-hashed gram of k units inside it. It depends on the window's
content alone, so equal windows share their anchor and its place in the window. Consecutive windows with one anchor form a
piece; a window is stored in exactly one piece. So

1. pieces are described by (anchor hash, class): class is a hash of the piece's whole content and shape; no text moves yet;
2. anchors that occur once are dropped: none of their windows repeats. Pieces of one class are equal throughout (two different pieces of
   one anchor share a class with a probability of 2**-50, or 2**-40 for the longest windows);
3. only where one anchor has several classes, the first piece of each class is fetched as text and sent to the anchor's shard,
   where a suffix structure says which windows are equal (the caller's `equal_windows`), after pieces that have too little in common
   around their anchor were left out (`sieved`);
4. pieces of anchors with more than HOT_CLASSES classes are dealt by a longer anchor: half of what a window may reach beyond it is added on the
   side where every window of the piece has it. Where that is as frequent, the anchor is the window itself, and an aggregation
   by the windows' whole content finds the equal ones, which needs no group in one task.

Results are spans (_key, a, b) of units covered by repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RangeHash, Words, binary_rows, byte_values, discard, int64, materialise, slices, tidy

#: Units that one NumPy step works on, and bits for a position in it.
SEGMENT, POSITION_BITS = 1_000_000, 22
#: Bits of a piece's windows and of its anchor's place, at least and at most; its content hash has the rest of 64.
LEAST_BITS, MOST_BITS = 7, 12
HOT_CLASSES = 20_000
#: Text of the pieces that one shard is meant to hold.
SHARD_BYTES = 1_000_000


def byte_units(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return byte_values(raw), offs


def word_units(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = Words(raw, offs)
    return words.hashes(raw), words.first


def keyed(docs: DataFrame) -> DataFrame:
    """Adds `_key`: unique, ordered as doc_id with nulls first. It is doc_id, unless that has nulls or repeats; then the rows
    are numbered in the order of doc_id and text."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.filter(F.col("doc_id").isNull() | (F.col("n") > 1)).isEmpty():
        return docs.withColumn("_key", F.col("doc_id").cast("long"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    return materialise(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_key", F.monotonically_increasing_id())).withMetadata("_key", {RENUMBERED: True})


RENUMBERED = "_renumbered"


def is_renumbered(rows: DataFrame) -> bool:
    """Whether keyed() had to number the rows."""
    return bool(rows.schema["_key"].metadata.get(RENUMBERED))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    span, m = 1, values
    while span * 2 <= width:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = width - span
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def shape_bits(window: int, gram: int) -> int:
    """A piece has at most window - gram + 1 windows, and its anchor as many places."""
    bits = max(LEAST_BITS, (window - gram + 1).bit_length())
    if not 0 < gram <= window or bits > MOST_BITS:
        raise ValueError(f"windows of {window} units need anchors of {max(1, window - (1 << MOST_BITS) + 2)} to {window}")
    return bits


def pieces_of(values: np.ndarray, offs: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    """Pieces of concatenated texts: doc (index), start (unit in the document), windows, anchor (its place in the piece), hash,
    shape (a content hash, windows and anchor in one integer; see shape_bits())."""
    out, bits = [], np.uint64(shape_bits(window, gram))
    for base in range(0, max(1, len(values)), SEGMENT):
        part = values[base : base + SEGMENT + window - 1]
        if len(part) < window:
            break
        n = len(part) - window + 1
        hashes = RangeHash(part)
        grams = hashes.grams(gram)
        low = np.uint64((1 << POSITION_BITS) - 1)
        anchor = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & low).astype(np.int64)
        at = np.arange(n)
        doc = np.searchsorted(offs, at + base, side="right") - 1
        valid = at + base + window <= offs[doc + 1]
        first = valid.copy()
        first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        start = np.flatnonzero(first)
        if not len(start):
            continue
        count = np.diff(np.append(np.cumsum(valid)[start] - 1, valid.sum()))
        content = hashes.of(start, start + count + window - 1)
        place = anchor[start] - start
        shape = (content >> bits + bits << bits + bits) | (count.astype(np.uint64) << bits) | place.astype(np.uint64)
        out.append((doc[start], start + base - offs[doc[start]], count, place, grams[anchor[start]], shape))
    names = ("doc", "start", "windows", "anchor", "hash", "shape")
    if not out:
        return {k: np.zeros(0, np.uint64 if k in ("hash", "shape") else np.int64) for k in names}
    return {k: np.concatenate([o[i] for o in out]) for i, k in enumerate(names)}


Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def describe(docs: DataFrame, units: Units, window: int, gram: int, located: bool) -> DataFrame:
    """(_hash, _shape, _key, _start) of all pieces of `text`, or the hash alone."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in slices(batch, "text"):
                p = pieces_of(*units(raw, offs), window, gram)
                if not located:
                    once, n = np.unique(p["hash"], return_counts=True)
                    yield pa.RecordBatch.from_arrays([int64(once), int64(n)], ["_hash", "_n"])
                    continue
                keys = part.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([int64(p["hash"]), int64(p["shape"]), int64(keys[p["doc"]]), pa.array(p["start"].astype(np.int32))], ["_hash", "_shape", "_key", "_start"])

    if not located:
        return docs.select("_key", "text").mapInArrow(tidy(found), "_hash long, _n long")
    return docs.select("_key", "text").mapInArrow(tidy(found), "_hash long, _shape long, _key long, _start int")


def _windows(shape, bits: int) -> F.Column:
    return F.shiftrightunsigned(shape, bits).bitwiseAND((1 << bits) - 1)


def fetch(docs: DataFrame, wanted: DataFrame, units: Units, window: int, bits: int, raw_bytes: bool) -> DataFrame:
    """The content of pieces: wanted (_hash, _shape, _key, _start) with `content` (bytes, or the words' 64-bit hashes)."""
    asked = wanted.groupBy("_key").agg(F.collect_list(F.struct("_hash", "_shape", "_start", "_several", "_classes")).alias("asked"))
    # All columns are kept, so that one exchange of the documents serves this join and with_spans().
    rows = docs.join(asked, "_key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in slices(batch, "text"):
                if not part.num_rows:
                    continue
                values, first = (raw, offs) if raw_bytes else units(raw, offs)
                asked = part.column(1)
                inner = asked.flatten()
                doc = np.repeat(np.arange(part.num_rows), np.diff(asked.offsets.to_numpy()))
                shape = inner.field(1).to_numpy()
                start = first[doc] + inner.field(2).to_numpy()
                length = (shape >> bits & (1 << bits) - 1) + window - 1
                flat = np.concatenate([values[a : a + n] for a, n in zip(start, length, strict=True)]) if len(start) else values[:0]
                bounds = np.r_[0, np.cumsum(length)] * values.itemsize
                key = pa.array(part.column(0).to_numpy()[doc])
                yield pa.RecordBatch.from_arrays([inner.field(0), inner.field(1), key, inner.field(2), inner.field(3), inner.field(4), binary_rows(flat.view(np.uint8), bounds)], names)

    names = ["_hash", "_shape", "_key", "_start", "_several", "_classes", "content"]
    return rows.select("_key", "asked", *[c for c in docs.columns if c != "_key"]).mapInArrow(tidy(cut), "_hash long, _shape long, _key long, _start int, _several boolean, _classes long, content binary")


EqualWindows = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


def sieved(symbols: np.ndarray, offs: np.ndarray, place: np.ndarray, key: np.ndarray, start: np.ndarray, several: np.ndarray, window: int, gram: int, cuts: int, later_only: bool) -> tuple[np.ndarray, ...]:
    """Pieces (offs: their bounds in symbols; place: of the anchor) cut by where a window has its anchor: what all windows of a cut share is longer than the anchor. Those
    that share it with no other hold no repeat and are left out; of cuts that are equal throughout (by a hash of 64 bits) one is left, the first. Returns (piece, first and
    end window in it, several) of those left, and piece, first and end window of the cuts that equal ones cover as a whole."""
    hashes, count, width = RangeHash(byte_values(symbols) if symbols.dtype == np.uint8 else symbols), np.diff(offs) - window + 1, window - gram + 1
    steps = np.linspace(0, width, min(cuts, width) + 1).astype(np.int64)
    parts = []
    for low, high in zip(steps[:-1], steps[1:], strict=True):  # the anchor's places in a window
        a, b = np.maximum(0, place - high + 1), np.minimum(count, place - low + 1)
        piece = np.flatnonzero(a < b)
        core = (offs[:-1] + place)[piece]
        parts.append((piece, a[piece], b[piece], hashes.of(core - low, core - high + 1 + window) + np.uint64(low)))
    piece, a, b, core = (np.concatenate(c) for c in zip(*parts, strict=True))

    def shared(of: np.ndarray) -> np.ndarray:
        _, which, n = np.unique(of, return_inverse=True, return_counts=True)
        return n[which] > 1

    piece, a, b, core = (x[shared(core)] for x in (piece, a, b, core))
    whole = hashes.of(offs[piece] + a, offs[piece] + b + window - 1)
    order = np.lexsort((start[piece] + a, key[piece], whole, core))
    piece, a, b, core, whole = (x[order] for x in (piece, a, b, core, whole))
    first = np.r_[True, (core[1:] != core[:-1]) | (whole[1:] != whole[:-1])] if len(piece) else np.zeros(0, np.bool_)
    alone = first & np.r_[first[1:], True] if len(piece) else first
    done = ~first if later_only else ~alone & ~several[piece]
    left = np.flatnonzero(first)
    left = left[shared(core[left])]
    return piece[left], a[left], b[left], several[piece[left]] | ~alone[left], piece[done], a[done], b[done]


def spans_in_shard(batches: list[pa.RecordBatch], window: int, gram: int, cuts: int, symbol: type, later_only: bool, equal_windows: EqualWindows) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    key, start, several, place = (table[c].to_numpy() for c in ("_key", "_start", "_several", "_place"))
    data = table["content"].combine_chunks()
    data = data.chunk(0) if isinstance(data, pa.ChunkedArray) else data
    _, offsets, flat = data.buffers()
    offs = np.frombuffer(offsets, np.int32)[data.offset : data.offset + len(data) + 1] // np.dtype(symbol).itemsize
    symbols = np.frombuffer(flat, symbol)[offs[0] : offs[-1]]
    start, offs = start.astype(np.int64), (offs - offs[0]).astype(np.int64)
    wholly = ([], [], [])
    if cuts > 1:
        piece, a, b, several, *whole = sieved(symbols, offs, place.astype(np.int64), key, start, several, window, gram, cuts, later_only)
        wholly = (key[whole[0]], start[whole[0]] + whole[1], start[whole[0]] + whole[2] + window - 1)
        key, start, length = key[piece], start[piece] + a, b - a + window - 1
        base, offs = offs[piece] + a, np.r_[0, np.cumsum(length)]
        symbols = symbols[np.arange(offs[-1]) + np.repeat(base - offs[:-1], length)]
    at, group = equal_windows(symbols, offs, window) if len(key) else (offs[:0], offs[:0])
    piece = np.searchsorted(offs, at, side="right") - 1
    unit = start[piece] + at - offs[piece]
    if later_only:
        order = np.lexsort((unit, key[piece], group))
        g = group[order]
        keep = order[np.r_[False, g[1:] == g[:-1]]] if len(order) else order
    else:
        keep = np.flatnonzero(~several[piece])  # pieces of a class that occurs again are covered as a whole elsewhere
    keep = keep[np.lexsort((unit[keep], piece[keep]))]
    p, u = piece[keep], unit[keep]
    new = np.r_[True, (p[1:] != p[:-1]) | (u[1:] != u[:-1] + 1)] if len(p) else np.zeros(0, np.bool_)
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(p)] - 1 if len(first) else first
    found = (key[p[first]], u[first], u[last] + window)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(found, wholly, strict=True)], ["_key", "a", "b"])


def lengthened(hot: DataFrame, window: int, gram: int, symbol: type) -> DataFrame:
    """Pieces cut in two, by whether the anchor lies in the first or second half of the window's room, each dealt by the content of its
    anchor with what all its windows have on the other side."""
    middle, bits = (window - gram) // 2, shape_bits(window, gram)
    low = (1 << bits) - 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for shape, key, start, several, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                values = np.frombuffer(content, symbol)
                count, place = shape >> bits & low, shape & low
                late = min(count, max(0, place - middle))  # windows that have the anchor in their second half
                for a, b, lo, hi in ((0, late, place - middle, place + gram), (late, count, place, place + window - middle)):
                    if a < b:
                        piece = values[a : b + window - 1]
                        row = (int.from_bytes(hashlib.blake2b(values[lo:hi].tobytes(), digest_size=8, salt=b"late" if b == late else b"").digest(), "little", signed=True), key, start + a, several, place - a, piece.tobytes())
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["_hash", "_key", "_start", "_several", "_place", "content"])

    return hot.select("_shape", "_key", "_start", "_several", "content").mapInArrow(tidy(each), "_hash long, _key long, _start int, _several boolean, _place int, content binary")


def _every_window(pieces: DataFrame, window: int, symbol: type) -> DataFrame:
    """(_key, _unit, _several, content) of every window of the pieces."""
    width = np.dtype(symbol).itemsize

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, start, several, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(content) // width - window + 1
                rows = [content[i * width : (i + window) * width] for i in range(n)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * n, pa.int64()), pa.array(start + np.arange(n)), pa.array([several] * n, pa.bool_()), pa.array(rows, pa.binary())], ["_key", "_unit", "_several", "content"])

    return pieces.select("_key", "_start", "_several", "content").mapInArrow(tidy(each), "_key long, _unit long, _several boolean, content binary")


def repeat_spans(docs: DataFrame, units: Units, window: int, gram: int, later_only: bool, equal_windows: EqualWindows, raw_bytes: bool, hot_classes: int = HOT_CLASSES, cuts: int = 1) -> DataFrame:
    """Spans (_key, a, b) of `docs` (_key, text) covered by windows that start anywhere else, or, with later_only, that start
    earlier in the order of _key and position. Spans may overlap. cuts: into how many a shard cuts its pieces by the place of their anchor (see sieved()); 1: none."""
    spark, bits = docs.sparkSession, shape_bits(window, gram)
    symbol = np.uint8 if raw_bytes else np.uint64
    counts = describe(docs, units, window, gram, False).groupBy("_hash").agg(F.sum("_n").alias("_n"))
    again = materialise(counts.filter("_n > 1").select("_hash"))
    # Hot anchors: a plain join of two exchanges, which adaptive execution splits.
    pieces = materialise(describe(docs, units, window, gram, True).join(again, "_hash", "left_semi"))
    discard(again)
    classes = materialise(pieces.groupBy("_hash", "_shape").agg(F.min(F.struct("_key", "_start")).alias("_first"), F.count("*").alias("_n")))
    if later_only:
        repeated = classes.filter("_n > 1").select("_hash", "_shape", "_first")
        whole = pieces.join(repeated, ["_hash", "_shape"]).filter(F.struct("_key", "_start") != F.col("_first"))
    else:
        whole = pieces.join(classes.filter("_n > 1").select("_hash", "_shape"), ["_hash", "_shape"], "left_semi")
    whole = whole.select("_key", F.col("_start").cast("long").alias("a"), (F.col("_start") + _windows("_shape", bits) + window - 1).cast("long").alias("b"))

    several = classes.groupBy("_hash").agg(F.count("*").alias("_classes")).filter("_classes > 1")
    wanted = materialise(classes.join(several, "_hash").select("_hash", "_shape", "_first._key", "_first._start", (F.col("_n") > 1).alias("_several"), "_classes"))
    size = wanted.agg(F.sum(F.when(F.col("_classes") <= hot_classes, (_windows("_shape", bits) + window) * np.dtype(symbol).itemsize)), F.max("_classes")).first()
    if size[1] is None:
        return whole
    content = fetch(docs, wanted, units, window, bits, raw_bytes)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((size[0] or 0) // SHARD_BYTES) + 1)
    content = content.withColumn("_place", F.col("_shape").bitwiseAND((1 << bits) - 1).cast("int"))
    columns, crowded = ["_hash", "_key", "_start", "_several", "_place", "content"], None
    if size[1] > hot_classes:
        content = materialise(content)
        longer = materialise(lengthened(content.filter(F.col("_classes") > hot_classes), window, gram, symbol))
        many = longer.groupBy("_hash").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_classes).select("_hash")
        crowded = longer.join(many, "_hash", "left_semi")
        content = content.filter(F.col("_classes") <= hot_classes).select(columns).unionByName(longer.join(many, "_hash", "left_anti"))
    shards = content.select(columns).repartition(parts, "_hash")

    def in_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [b for b in batches if b.num_rows]:
            yield spans_in_shard(held, window, gram, cuts, symbol, later_only, equal_windows)

    spans = whole.unionByName(shards.select("_key", "_start", "_several", "_place", "content").mapInArrow(tidy(in_shard), "_key long, a long, b long"))
    if crowded is not None:
        each = materialise(_every_window(crowded, window, symbol))
        groups = each.groupBy("content").agg(F.min(F.struct("_key", "_unit")).alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
        hot = each.join(groups, "content")
        hot = hot.filter(F.struct("_key", "_unit") != F.col("_first")) if later_only else hot.filter(~F.col("_several"))
        spans = spans.unionByName(hot.select("_key", F.col("_unit").alias("a"), (F.col("_unit") + window).alias("b")))
    return spans


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs (_key, text, ...) with `spans`: an array of (a, b), null where there is none."""
    lists = spans.groupBy("_key").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    return docs.join(lists, "_key", "left")


def covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of n units lie in a span."""
    change = np.zeros(n + 1, np.int64)
    if len(spans):
        ab = np.asarray(spans)
        np.add.at(change, ab[:, 0], 1)
        np.add.at(change, ab[:, 1], -1)
    return np.cumsum(change[:-1]) > 0
