"""Similarity join of documents on the Jaccard similarity of their word shingles, with adaptive multi-match prefixes.

If two sets are similar enough, their prefixes under one global token order share a token; prefixes longer by l - 1 tokens
share l. Every document picks its own l: longer prefixes cost longer lists, more required matches leave fewer pairs to verify,
and the cheaper sum wins; list lengths come from a count sketch over all shingles (SKETCH_CELLS cells, the only broadcast), which
also puts frequent shingles last in the order. A pair must share as many prefix tokens as the larger l of its two documents.

Equal sets are collapsed first. Near copies are linked along sorted lists of min-hashes and verified, and what is already
connected is not paired again: prefix tokens whose documents are all in one component are dropped by an aggregation. The
remaining token lists are paired twice. The first time every document of a long list is paired with its nearest one of another
component only, and what verification links is merged; the second time all pairs of all lists that are still open count. Pairs are kept only
if a parity bitmap, which grows with the set, leaves room for the similarity: it bounds the symmetric difference from below. Long lists are cut by the sizes of the sets, as only neighbouring sizes can be
similar, and into blocks of LIST_BLOCK. Survivors with enough matches are verified on their whole texts. Links between different
components are never dropped, so the components are exact.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RangeHash, Words, discard, lower_ascii, materialise, mix, slices, table, text_bytes, tidy
from .components import components
from .repeats import is_renumbered, keyed

SKETCH_CELLS = 1 << 20
SKETCH_ROWS = 64
MOST_MATCHES = 4
#: Cost of verifying a pair against that of reading a list entry.
VERIFY_COST = 20.0
#: Bits of a set's parity bitmap: its size, within these bounds.
BITMAP, BITMAP_MOST = 256, 2048
LIST_BLOCK = 2048
#: Documents of a list from which on nearest neighbours are linked before all pairs are listed.
LONG_LIST = 12
#: Files of a table of links.
SMALL_FILES = 6
#: How far apart in a sorted list documents are compared.
NEIGHBOURS = 24
MIN_HASHES = ("mh0", "mh1")
#: Four hash functions; each min-hash joins the least values of two.
SEEDS = (0xA5A5A5A5A5A5A5A5, 0x3C3C3C3C3C3C3C3C, 0x0F1E2D3C4B5A6978, 0x9182736455463728)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer than k words the whole sequence is one."""
    low = lower_ascii(raw)
    words = Words(low, offs)
    whole = RangeHash(words.hashes(low))
    grams = whole.grams(k)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(whole.of(np.array([a]), np.array([b])) if b > a else np.zeros(0, np.uint64))
    return out


def sketch(rows: DataFrame, k: int) -> np.ndarray:
    """Occurrences of all shingles by cell."""
    per = SKETCH_CELLS // SKETCH_ROWS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(SKETCH_CELLS, np.int64)
        for batch in batches:
            for _, raw, offs in slices(batch, "text"):
                low = lower_ascii(raw)
                grams = RangeHash(Words(low, offs).hashes(low)).grams(k)
                cells += np.bincount((grams & np.uint64(SKETCH_CELLS - 1)).astype(np.int64), minlength=SKETCH_CELLS)
        packed = [pa.compress(pa.py_buffer(part), "zstd", asbytes=True) for part in cells.reshape(SKETCH_ROWS, per)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SKETCH_ROWS, dtype=np.int32)), pa.array(packed, pa.binary())], ["row", "cells"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for row, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(pa.decompress(data.as_py(), per * 8, "zstd", asbytes=True), np.int64)
                total[row] = total[row] + part if row in total else part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["row", "cells"])

    got = rows.select("text").mapInArrow(tidy(counted), "row int, cells binary").repartition(SKETCH_ROWS // 4, "row").mapInArrow(tidy(added), "row int, cells binary").toArrow()
    out = np.zeros((SKETCH_ROWS, per), np.int64)
    for row, data in zip(got["row"].to_pylist(), got["cells"].to_pylist(), strict=True):
        out[row] += np.frombuffer(data, np.int64)
    return out.ravel()


def prefix_length(n: int, percent: int) -> int:
    """n - ceil(n * percent / 100) + 1"""
    return n - -(-n * percent // 100) + 1


PROFILE = "_key long, n long, sig1 long, sig2 long, mh0 long, mh1 long, l int, tokens array<long>, bits binary"


def profiles(rows: DataFrame, k: int, percent: int, cells: np.ndarray) -> DataFrame:
    """See PROFILE: size and signature of the set, min-hashes, own l, prefix tokens (for the largest l), parity bitmap."""
    usual = cells.mean()
    level = np.where(cells > 0, np.frexp(np.maximum(cells / max(usual, 1.0), 1e-9))[1].clip(0, 31), 0).astype(np.uint8)
    length = np.maximum(0.0, cells - usual).astype(np.float32) + 1

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in slices(batch, "text"):
                out: list[list] = [[] for _ in range(8)]
                for s in shingle_sets(raw, offs, k):
                    n = len(s)
                    if not n:
                        for column, value in zip(out, (0, 0, 0, None, None, 0, [], b""), strict=True):
                            column.append(value)
                        continue
                    a, b, c, d = (mix(s ^ np.uint64(seed)) for seed in SEEDS)
                    least = [int(mix(np.array([x.min()]) * np.uint64(3) ^ y.min()).view(np.int64)[0]) for x, y in ((a, b), (c, d))]
                    cell = (s & np.uint64(SKETCH_CELLS - 1)).astype(np.int64)
                    rank = level[cell].astype(np.uint64) << np.uint64(58) | s >> np.uint64(6)
                    order = np.argsort(rank)
                    p = prefix_length(n, percent)
                    order = order[: p + MOST_MATCHES - 1]
                    cost = np.cumsum(length[cell[order]])[p - 1 :]
                    l = int(np.argmin(cost + VERIFY_COST * cost / (1 + np.arange(len(cost))))) + 1  # noqa: E741
                    tokens = rank[order]
                    for column, value in zip(out, (n, a.sum(dtype=np.uint64).astype(np.int64), b.sum(dtype=np.uint64).astype(np.int64), *least, l, tokens.view(np.int64), bitmap(a)), strict=True):
                        column.append(value)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(out, kinds, strict=True)]], [c.split()[0] for c in PROFILE.split(", ")])

    return rows.select("_key", "text").mapInArrow(tidy(profiled), PROFILE)


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if 100 * small < percent * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def neighbour_links(texts: DataFrame, k: int, percent: int, key: str) -> DataFrame:
    """Verified links between documents that are at most NEIGHBOURS apart in the sorted list of a min-hash, and with its first.
    A document is compared only with those that links within the list have not connected with it yet.
    texts (key, n, _key, text), of min-hashes that occur again."""
    rows = texts.select(key, "n", "_key", "text")
    ordered = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "n", "_key").sortWithinPartitions(key, "n", "_key")

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, near, root = None, [], {}
        for batch in batches:
            found: list[tuple[int, int]] = []
            keys, ids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            at = 0
            for _, raw, offs in slices(batch, "text"):
                for s in shingle_sets(raw, offs, k):
                    one = ids[at]
                    if keys[at] != group:
                        group, near = keys[at], []
                    mine = one
                    root[one] = one
                    for other, set_ in reversed(near):
                        theirs = root[other]
                        if theirs != mine and similar(set_, s, percent):
                            found.append((other, one))
                            for x, _ in near:
                                if root[x] == mine:
                                    root[x] = theirs
                            mine = root[one] = theirs
                    near.append((one, s))
                    if len(near) > NEIGHBOURS + 1:
                        near.pop(1)  # the first of the list stays
                    root = {x: root[x] for x, _ in near}
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    return ordered.mapInArrow(tidy(linked), "a long, b long")


PAIRS = "a long, b long, m long, l int"
LISTED = ("token", "cls", "lo", "hi", "own", "_key", "n", "l", "pos", "comp", "bits")


def bitmap(hashes: np.ndarray) -> bytes:
    """Parities of the hashes by cell: about one bit for each member of the set, so that long sets are told apart as well as
    short ones; a longer bitmap folds to a shorter one by XOR."""
    size = min(max(BITMAP, 1 << max(0, len(hashes) - 1).bit_length()), BITMAP_MOST)
    return np.packbits((np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of several lengths, compared at the shorter length of the two."""

    def __init__(self, column: pa.Array):
        _, offsets, data = column.buffers()
        offs = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        size = np.diff(offs)
        self.level = np.log2(size * 8 // BITMAP).astype(np.int64)
        flat = np.frombuffer(data, np.uint8)
        self.at, self.folded = np.zeros((int(self.level.max()) + 1, len(size)), np.int64), []
        for level in range(len(self.at)):
            mine = np.flatnonzero(self.level == level)
            width = BITMAP // 8 << level
            rows = flat[offs[mine][:, None] + np.arange(width)].view(np.uint64)
            for low in range(level, -1, -1):
                self.at[low, mine] = np.arange(len(mine)) + (sum(len(x) for x in self.folded[low]) if low < len(self.folded) else 0)
                while len(self.folded) <= low:
                    self.folded.append([])
                self.folded[low].append(rows)
                if low:
                    rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
        self.folded = [np.concatenate(x) for x in self.folded]

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """A lower bound of the sizes of the symmetric differences."""
        low = np.minimum(self.level[i], self.level[j])
        out = np.zeros(len(i), np.int64)
        for level in np.unique(low):
            at = np.flatnonzero(low == level)
            rows, place = self.folded[level], self.at[level]
            out[at] = np.bitwise_count(rows[place[i[at]]] ^ rows[place[j[at]]]).sum(1, dtype=np.int64)
        return out


def size_class(n, percent: int):
    """Sets that can be similar are in one class or in neighbours."""
    return np.floor(np.log(n) / np.log(100 / percent) + 1e-9).astype(np.int64)


def pairs_of(t: pa.Table, percent: int, nearest: bool) -> tuple[np.ndarray, ...]:
    """(a, b, m, l): pairs of documents of a token that are in different components, close enough in size, within both prefixes,
    and not too far apart by their bitmaps; m of the lists of t have the pair. t has whole lists, in order.

    nearest: for every document of a list the nearest of them only.
    """
    token, cls, lo, hi, own, key, n, l, pos, comp = (t[c].to_numpy() for c in LISTED[:-1])  # noqa: E741
    bits = Bitmaps(t["bits"].combine_chunks())
    group = np.r_[0, np.cumsum((np.diff(token) != 0) | (np.diff(cls) != 0) | (np.diff(lo) != 0) | (np.diff(hi) != 0))]
    end = np.searchsorted(group, group, side="right")
    split, prefix = lo != hi, n - -(-n * percent // 100)  # prefix length less 1
    kind = np.where(cls >= 0, size_class(n, percent), -1)
    left, out = np.arange(len(key)), []
    for d in range(1, len(key)):
        left = left[left + d < end[left]]
        if not len(left):
            break
        i, j = left, left + d
        most = np.maximum(l[i], l[j])
        ok = (comp[i] != comp[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        ok &= (pos[i] < prefix[i] + most) & (pos[j] < prefix[j] + most) & (~split[i] | (own[i] != own[j]))
        ok &= np.maximum(kind[i], kind[j]) == cls[i]
        i, j = i[ok], j[ok]
        if len(i):
            size = n[i] + n[j]
            room = size - 2 * -(-percent * size // (100 + percent)) - bits.apart(i, j)
            fits = room >= 0
            if fits.any():
                out.append((i[fits], j[fits], room[fits] / size[fits]))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    i, j, room = (np.concatenate(x) for x in zip(*out, strict=True))
    if nearest:
        best = np.zeros(len(i), np.bool_)
        for side in (i, j):
            order = np.lexsort((-room, side))
            best[order[np.r_[True, side[order][1:] != side[order][:-1]]]] = True
        i, j = i[best], j[best]
    a, b, l = np.minimum(key[i], key[j]), np.maximum(key[i], key[j]), np.maximum(l[i], l[j]).astype(np.int32)  # noqa: E741
    order = np.lexsort((b, a))
    a, b, l = a[order], b[order], l[order]  # noqa: E741
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.diff(np.r_[first, len(a)]), l[first]


def list_pairs(batches: Iterator[pa.RecordBatch], percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """pairs_of() lists that arrive in order, some thousand rows at a time; no more is held than that and one list's block."""
    held: list[pa.RecordBatch] = []

    def emit(t: pa.Table) -> Iterator[pa.RecordBatch]:
        a, b, m, l = pairs_of(t, percent, nearest)  # noqa: E741
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(m), pa.array(l)], ["a", "b", "m", "l"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(x.num_rows for x in held) < 2 * LIST_BLOCK:
            continue
        t = pa.Table.from_batches(held).combine_chunks()
        place = np.stack([t[c].to_numpy() for c in LISTED[:4]])
        last = int(np.flatnonzero(np.r_[False, (place[:, 1:] != place[:, :-1]).any(0)])[-1]) if (place != place[:, -1:]).any() else 0
        if last:
            yield from emit(t.slice(0, last).combine_chunks())
        held = t.slice(last).to_batches()
    if held:
        yield from emit(pa.Table.from_batches(held).combine_chunks())


def open_blocks(lists: DataFrame, info: DataFrame, percent: int, least: int) -> DataFrame:
    """The lists of at least `least` documents that are in several components, in blocks (LISTED): a list of more than LIST_BLOCK documents is cut by the
    classes of their sizes first, each with its neighbour below, and classes as large again into pairs of hashed parts."""
    placed = lists.join(info.select("_key", "comp"), "_key")
    bridging = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c")).filter(f"x < y AND c >= {least}")
    bridging = materialise(bridging.select("token", (F.col("c") > LIST_BLOCK).alias("hot")))
    rows = lists.join(bridging, "token").join(info, "_key")
    short = rows.filter("NOT hot").select("token", F.lit(-1).cast("long").alias("cls"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("own"), "_key", "n", "l", "pos", "comp", "bits")
    if bridging.filter("hot").isEmpty():
        return short
    kind = F.floor(F.log("n") / F.log(F.lit(100 / percent)) + 1e-9).cast("long")
    long_ = materialise(rows.filter("hot").withColumn("cls", F.explode(F.array(kind, kind + 1))))
    sizes = long_.groupBy("token", "cls").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("c")).filter("x < y")
    long_ = long_.join(sizes.select("token", "cls", F.ceil(F.col("c") / LIST_BLOCK).cast("int").alias("blocks")), ["token", "cls"])
    own = F.pmod(F.xxhash64("_key"), F.col("blocks")).cast("int")
    long_ = long_.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return short.unionByName(long_.select("token", "cls", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "_key", "n", "l", "pos", "comp", "bits"))


def links_and_profiles(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(links between representatives of equal sets, profiles with `rep`). docs (_key, text)."""
    spark = docs.sparkSession
    cells = sketch(docs, k)
    profile = materialise(profiles(docs, k, percent, cells))
    # Groups of equal sets, written first: the join below is then one of two plain exchanges, which can be split where skewed.
    same = profile.filter("n > 0").groupBy("n", "sig1", "sig2").agg(F.min("_key").alias("rep"), F.count("*").alias("c"))
    same = materialise(same.filter("c > 1").drop("c"))
    member = profile.select("_key", "n", "sig1", "sig2").join(same, ["n", "sig1", "sig2"], "left")
    member = materialise(member.select("_key", "n", F.coalesce("rep", "_key").alias("rep")))
    reps = materialise(profile.filter("n > 0").join(member.filter("_key = rep").select("_key"), "_key", "left_semi"))

    lists = reps.select("_key", F.posexplode("tokens").alias("pos", "token"))
    again = materialise(lists.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1"))
    lists = materialise(lists.join(again.select("token"), "token", "left_semi"))
    discard(again)
    few = reps.select("_key", "n", *MIN_HASHES)
    for key in MIN_HASHES:
        shared = reps.groupBy(key).agg(F.count("*").alias("c")).filter("c > 1").select(F.col(key).alias("x"), F.lit(True).alias(f"again_{key}"))
        few = few.join(shared, F.col(key) == F.col("x"), "left").drop("x")
    few = few.filter(F.coalesce(*[f"again_{key}" for key in MIN_HASHES]))
    texts = materialise(docs.select("_key", "text").join(few, "_key"))

    links = None
    for key in MIN_HASHES:
        found = materialise(neighbour_links(texts.filter(f"again_{key}"), k, percent, key), SMALL_FILES)
        links = found if links is None else links.unionByName(found)
    for nearest, least in ((True, LONG_LIST), (False, 2)):
        known = components(links)
        info = reps.select("_key", "n", "l", "bits").join(known, F.col("_key") == F.col("node"), "left").select("_key", "n", "l", "bits", F.coalesce("component", "_key").alias("comp"))
        blocks, parts = open_blocks(lists, info, percent, least), int(spark.conf.get("spark.sql.shuffle.partitions"))
        pairs = blocks.repartition(parts, *LISTED[:4]).sortWithinPartitions(*LISTED[:4]).mapInArrow(tidy(functools.partial(list_pairs, percent=percent, nearest=nearest)), PAIRS)
        pairs = materialise(pairs.groupBy("a", "b").agg(F.sum("m").alias("m"), F.max("l").alias("l")).filter("m >= l").select("a", "b"))
        links = links.unionByName(verified_links(docs, texts, pairs, k, percent))
    discard(lists, reps, profile, same, texts)
    return links, member


def verified_links(docs: DataFrame, texts: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on their whole texts. texts: those at hand; the rest is fetched from docs."""
    wanted = materialise(pairs.select(F.col("a").alias("_key")).unionByName(pairs.select("b").toDF("_key")).distinct().join(texts.select("_key"), "_key", "left_anti"))
    more = materialise(docs.select("_key", "text").join(wanted, "_key", "left_semi"))
    every = texts.select("_key", "text").unionByName(more)
    both = pairs.join(every.toDF("a", "text_a"), "a").join(every.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in slices(batch, "text_a"):
                ones, others = shingle_sets(raw, offs, k), shingle_sets(*text_bytes(part.column(3)), k)
                good = [similar(x, y, percent) for x, y in zip(ones, others, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    out = materialise(both.mapInArrow(tidy(verified), "a long, b long"), SMALL_FILES)
    discard(wanted, more, pairs)
    return out


def grouped(docs: DataFrame, k: int = 3, percent: int = 90) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, n_shingles, component_id): the least doc_id that links reach.

    Defined results: null texts and texts without words have an empty set and are linked with nothing; equal sets are linked;
    with null or repeated ids rows are told apart and ordered by id (nulls first) and text; an empty table stays empty.
    """
    rows = keyed(docs.select("doc_id", "text"))
    links, member = links_and_profiles(rows.select("_key", "text"), k, percent)
    found = components(links)
    placed = member.join(found, F.col("rep") == F.col("node"), "left").select("_key", F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("_least"))
    if not is_renumbered(rows):
        return placed.select(F.col("_key").alias("doc_id"), "n_shingles", F.col("_least").alias("component_id"))
    ids = rows.select("_key", "doc_id")
    least = ids.select(F.col("_key").alias("_least"), F.col("doc_id").alias("component_id"))
    return placed.join(ids, "_key").join(least, "_least").select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that links connect with one of a smaller id; the columns are those of docs."""
    rows = keyed(docs)
    links, member = links_and_profiles(rows.select("_key", "text"), k, percent)
    found = components(links).filter("node <> component").select(F.col("node").alias("rep"))
    gone = member.filter("_key <> rep").select("_key").unionByName(member.join(found, "rep", "left_semi").select("_key"))
    return rows.join(gone.distinct(), "_key", "left_anti").select(*docs.columns)


def op9_adaptive_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


#: DuckDB SQL for the query.
OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, sh FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE []::VARCHAR[] END) AS sh FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.y FROM reach r JOIN both_ways l ON l.x = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, m AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = d.doc_id
"""
