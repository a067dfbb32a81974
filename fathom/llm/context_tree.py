"""Language-model scores by context-tree weighting over bytes.

A text becomes its lower-cased words joined by one space and one end byte. Each byte is coded as eight binary decisions; every
decision has a tree of contexts of 0 to DEPTH preceding bytes, and each node a Krichevsky-Trofimov estimate from the training
texts. The weighted probability of a node is half its own estimate plus half the product of its children's; from it follows how
much each depth counts when a byte is predicted. The score is the log10 probability of the text; `bits_per_byte` the code length.

All counts stay distributed. Documents are dealt to blocks of about BLOCK_BYTES by a hash of their key; a block sends its
distinct grams (context and next byte) and words, each with its training count, as packed pages to buckets that share the last
two context bytes, and gets the pages back with one number for every entry. A bucket's pages are first summed up in groups of
MERGED pages, and these again, so that no task holds more than that many, however many blocks there are; the pages themselves are
answered group by group against the bucket's sum, whose size is that of its distinct entries. Only the nodes of depth 0 and 1, at most 256 * 255
each, pass through the driver; a first pass over the pages of the scan's own partitions sums them up. Nothing that grows with
the corpus is broadcast, and the documents are shuffled once.

Defined results: a null text is empty (one end token); without training texts every probability is that of the untrained
tree; rows with null or repeated ids are told apart, and repeated rows score alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Lookup, Words, doc_bucket, lower_ascii, slices, table
from .repeats import keyed

DEPTH = 5
BLOCK_BYTES = 16_000_000
BUCKET_BYTES = 64_000_000
END = 10
HALF = math.log(0.5)
NODES = 256
#: Pages of a bucket that one task sums up.
MERGED = 64
GRAMS, WORDS = 0, 1


def normalised(raw: np.ndarray, offs: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words with one space between, one END, and `pad` times END before each text."""
    n = len(offs) - 1
    step = pad + 1
    out = np.full(len(raw) + step * n, END, np.uint8)
    row = np.repeat(np.arange(n), np.diff(offs))
    out[np.arange(len(raw)) + row * step + pad] = lower_ascii(raw)
    begin = offs[:-1] + np.arange(n) * step
    solid = ~((out == 32) | ((out >= 9) & (out <= 13)))
    keep = solid.copy()
    keep[1:] |= solid[:-1]
    for i in range(pad):
        keep[begin + i] = True
    out[~solid] = 32
    last = offs[1:] + np.arange(n) * step + pad  # the END put after each text
    running = np.r_[0, np.cumsum(solid)]
    keep[last] |= running[last] == running[begin]  # no word: END alone
    kept = np.flatnonzero(keep)
    bounds = np.searchsorted(kept, np.r_[begin, len(out)])
    stream = out[kept]
    for i in range(pad):
        stream[bounds[:-1] + i] = END
    stream[bounds[1:] - 1] = END
    return stream, bounds


def grams_of(stream: np.ndarray, bounds: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(gram of every byte, bounds of each text's grams): depth context bytes, then the byte."""
    packed = np.zeros(max(0, len(stream) - depth), np.uint64)
    for i in range(depth + 1):
        packed = packed << np.uint64(8) | stream[i : i + len(packed)]
    sizes = np.diff(bounds) - depth
    first = np.r_[0, np.cumsum(sizes)]
    index = np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], sizes)
    return packed[index], first


class Vocabulary:
    """Distinct entries with training counts, gathered chunk by chunk."""

    def __init__(self):
        self.keys, self.counts = [], []

    def add(self, values: np.ndarray, train: np.ndarray) -> None:
        seen, n = np.unique(values[train], return_counts=True)
        self.keys.append(seen)
        self.counts.append(n)
        held = np.unique(values[~train])
        self.keys.append(held)
        self.counts.append(np.zeros(len(held), np.int64))

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = np.concatenate(self.keys or [np.zeros(0, np.uint64)]), np.concatenate(self.counts or [np.zeros(0, np.int64)])
        return summed(keys, counts)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def bucket_of(kind: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """Grams by their last two context bytes, words by their hash."""
    source = (keys >> np.uint64(8) & np.uint64(0xFFFF)) * np.uint64(40503) % np.uint64(65521) if kind == GRAMS else keys >> np.uint64(20)
    return (source % np.uint64(buckets)).astype(np.int64)


def chunks_of(docs: pa.Table, depth: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of documents: the rows, grams, their bounds, words, their bounds."""
    for batch in docs.combine_chunks().to_batches():
        for part, raw, offs in slices(batch, "text"):
            grams, g = grams_of(*normalised(raw, offs, depth), depth)
            low = lower_ascii(raw)
            words = Words(low, offs)
            yield part, grams, g, words.hashes(low), words.first


def vocabularies(docs: pa.Table, depth: int) -> list[tuple[np.ndarray, np.ndarray]]:
    found = [Vocabulary(), Vocabulary()]
    for part, grams, g, words, w in chunks_of(docs, depth):
        train = part.column(part.schema.get_field_index("train")).to_numpy(zero_copy_only=False)
        found[GRAMS].add(grams, np.repeat(train, np.diff(g)))
        found[WORDS].add(words, np.repeat(train, np.diff(w)))
    return [f.merged() for f in found]


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series at x + 8."""
    y = x + 8
    shift = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov block probability of n0 zeros and n1 ones."""
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(n0 + n1 + 1.0) - math.log(math.pi)


class Level:
    """The nodes of one depth and decision: which node each gram uses, counts, and log probabilities."""

    def __init__(self, contexts: np.ndarray, node: np.ndarray, bit: np.ndarray, counts: np.ndarray):
        self.keys, self.of = np.unique(contexts << np.uint64(8) | node, return_inverse=True)
        self.n1 = np.bincount(self.of, counts * bit, len(self.keys))
        self.n0 = np.bincount(self.of, counts * (1 - bit), len(self.keys))
        self.own = log_kt(self.n0, self.n1)
        self.weighted, self.stop = self.own, np.ones(len(self.keys))

    def above(self, deeper: Level) -> None:
        """Take the children of each node into account; `deeper` has the same grams."""
        one = np.zeros(len(deeper.keys), np.int64)
        one[deeper.of] = self.of
        below = np.bincount(one, deeper.weighted, len(self.keys))
        self.weighted = np.logaddexp(HALF + self.own, HALF + below)
        self.stop = np.exp(HALF + self.own - self.weighted)

    def predict(self, bit: np.ndarray, deeper: np.ndarray | None) -> np.ndarray:
        here = (np.where(bit == 1, self.n1[self.of], self.n0[self.of]) + 0.5) / (self.n0 + self.n1 + 1)[self.of]
        stop = self.stop[self.of]
        return here if deeper is None else stop * here + (1 - stop) * deeper


def levels_of(grams: np.ndarray, counts: np.ndarray, depth: int, k: int) -> tuple[np.ndarray, np.ndarray, dict[int, Level]]:
    """For decision k: the bit and node of each gram, and the levels of depth 2 and more."""
    y = grams & np.uint64(255)
    node = np.uint64(1 << k) | y >> np.uint64(8 - k)
    bit = (y >> np.uint64(7 - k) & np.uint64(1)).astype(np.int64)
    context = grams >> np.uint64(8)
    levels = {d: Level(context & np.uint64((1 << 8 * d) - 1), node, bit, counts) for d in range(2, depth + 1)}
    for d in range(depth - 1, 1, -1):
        levels[d].above(levels[d + 1])
    return node, bit, levels


def shallow_sums(grams: np.ndarray, counts: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    """What the nodes of depth 1 need from a bucket: index (byte * 256 + node), counts, children's log probability."""
    out = {"node": [], "n0": [], "n1": [], "below": []}
    for k in range(8):
        _, _, levels = levels_of(grams, counts, depth, k)
        two = levels[2]
        one, of = np.unique((two.keys >> np.uint64(8) & np.uint64(255)) << np.uint64(8) | two.keys & np.uint64(255), return_inverse=True)
        out["node"].append(one.astype(np.int64))
        for name, value in (("n0", two.n0), ("n1", two.n1), ("below", two.weighted)):
            out[name].append(np.bincount(of, value, len(one)))
    return {name: np.concatenate(v) for name, v in out.items()}


class Shallow:
    """Counts and stopping weights of depth 0 and 1."""

    def __init__(self, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray):
        full = lambda v: np.bincount(node, v, NODES * NODES)
        self.n1, self.n0, below = full(n1), full(n0), full(below)
        own = log_kt(self.n0, self.n1)
        weighted = np.logaddexp(HALF + own, HALF + below)
        self.stop = np.exp(HALF + own - weighted)
        root = lambda v: v.reshape(NODES, NODES).sum(0)
        self.root1, self.root0 = root(self.n1), root(self.n0)
        own = log_kt(self.root0, self.root1)
        self.root_stop = np.exp(HALF + own - np.logaddexp(HALF + own, HALF + root(weighted)))

    def predict(self, grams: np.ndarray, node: np.ndarray, bit: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        for at, n0, n1, stop in ((((grams >> np.uint64(8) & np.uint64(255)) << np.uint64(8) | node).astype(np.int64), self.n0, self.n1, self.stop), (node.astype(np.int64), self.root0, self.root1, self.root_stop)):
            here = (np.where(bit == 1, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
            deeper = stop[at] * here + (1 - stop[at]) * deeper
        return deeper


def log10_probability(grams: np.ndarray, counts: np.ndarray, depth: int, shallow: Shallow) -> np.ndarray:
    """Of the last byte of each distinct gram of a bucket, after its context."""
    total = np.zeros(len(grams))
    for k in range(8):
        node, bit, levels = levels_of(grams, counts, depth, k)
        p = None
        for d in range(depth, 1, -1):
            p = levels[d].predict(bit, p)
        total += np.log10(shallow.predict(grams, node, bit, p))
    return total


PAGES = "kind int, bucket long, block long, salt long, n long, keys binary, counts binary"


def _packed(values: np.ndarray) -> bytes:
    return pa.compress(pa.py_buffer(np.ascontiguousarray(values)), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def pages_of(found: list[tuple[np.ndarray, np.ndarray]], buckets: int, block: int, salts: int) -> pa.RecordBatch:
    """One row for each kind and bucket: its sorted entries (as differences) and their training counts."""
    rows = {k: [] for k in ("kind", "bucket", "n", "keys", "counts")}
    for kind, (keys, counts) in enumerate(found):
        bucket = bucket_of(kind, keys, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, keys, counts = bucket[order], keys[order], counts[order].astype(np.uint64)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True) if len(first) else ():
            rows["kind"].append(kind)
            rows["bucket"].append(int(bucket[a]))
            rows["n"].append(b - a)
            rows["keys"].append(_packed(np.diff(keys[a:b], prepend=np.uint64(0))))
            rows["counts"].append(_packed(counts[a:b]))
    n = len(rows["n"])
    return pa.RecordBatch.from_arrays([pa.array(rows["kind"], pa.int32()), pa.array(rows["bucket"], pa.int64()), pa.array(np.full(n, block, np.int64)), pa.array(np.full(n, block % salts, np.int64)), pa.array(rows["n"], pa.int64()), pa.array(rows["keys"], pa.binary()), pa.array(rows["counts"], pa.binary())], [c.split()[0] for c in PAGES.split(", ")])


def _entries(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Entries and counts of a bucket's pages, page after page."""
    size = group["n"].to_pylist()
    keys = [np.cumsum(_unpacked(k, n, np.uint64), dtype=np.uint64) for k, n in zip(group["keys"].to_pylist(), size, strict=True)]
    counts = [_unpacked(c, n, np.uint64) for c, n in zip(group["counts"].to_pylist(), size, strict=True)]
    return np.concatenate(keys), np.concatenate(counts).astype(np.int64)


def summed_page(group: pa.Table) -> pa.Table:
    """A group's pages of one bucket as one page."""
    keys, counts = summed(*_entries(group))
    first = {c: group[c].slice(0, 1) for c in ("kind", "bucket", "block", "salt")}
    return pa.table({**first, "n": pa.array([len(keys)]), "keys": pa.array([_packed(np.diff(keys, prepend=np.uint64(0)))], pa.binary()), "counts": pa.array([_packed(counts.astype(np.uint64))], pa.binary())})


def tree_of(pages: DataFrame, salts: int) -> list[DataFrame]:
    """The pages, and above them their groups of MERGED summed up, each as a page with the number of its group as `block`, up to at most MERGED pages of each bucket. salts: groups of a bucket's
    pages."""
    levels = [pages]
    while salts > 1:
        above = levels[-1].groupBy("kind", "bucket", "salt").applyInArrow(summed_page, PAGES)
        salts = -(-salts // MERGED)
        levels.append(above.withColumn("block", F.col("salt")).withColumn("salt", F.pmod("salt", F.lit(salts))))
    return levels


def score_documents(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """docs (doc_id, text, train) with n_tokens, n_known, train_tokens, base_score, score and n_coded (bytes coded)."""
    rows = keyed(docs).select("_key", "doc_id", "text", "train")
    totals = rows.agg(F.sum(F.octet_length("text")), F.count_if("train")).first()
    total, ends = totals[0] or 0, totals[1]
    blocks, buckets = total // BLOCK_BYTES + 1, total // BUCKET_BYTES + 16
    salts = -(-blocks // MERGED)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("_key"), F.lit(blocks)))

    def of_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, TaskContext.get().partitionId()
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= BLOCK_BYTES:
                yield pages_of(vocabularies(pa.Table.from_batches(held), depth), buckets, number, salts)
                held, size, number = [], 0, number + 1
        if held:
            yield pages_of(vocabularies(pa.Table.from_batches(held), depth), buckets, number, salts)

    def sums(group: pa.Table) -> pa.Table:
        kind = group["kind"][0].as_py()
        keys, counts = summed(*_entries(group))
        if kind == WORDS:
            return pa.table({"kind": pa.array([kind], pa.int32()), "node": pa.array([0]), "n0": pa.array([float((counts > 0).sum())]), "n1": pa.array([float(counts.sum())]), "below": pa.array([0.0])})
        s = shallow_sums(keys, counts, depth)
        return pa.table({"kind": pa.array(np.full(len(s["node"]), kind, np.int32)), **{k: pa.array(v) for k, v in s.items()}})

    trained = rows.filter("train").select("text", "train").mapInArrow(of_partition, PAGES)
    gathered = tree_of(trained, salts)[-1].groupBy("kind", "bucket").applyInArrow(sums, "kind int, node long, n0 double, n1 double, below double")
    got = gathered.groupBy("kind", "node").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "below")]).toPandas()
    grams, words = got[got.kind == GRAMS].sort_values("node"), got[got.kind == WORDS]
    shallow = Shallow(*[grams[c].to_numpy() for c in ("node", "n0", "n1", "below")])
    train_tokens = int(words.n1.sum()) + ends
    distinct = int(words.n0.sum()) + (ends > 0)
    divisor = train_tokens + 0.1 * (distinct + 1)

    def pages(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([pages_of(vocabularies(group, depth), buckets, group["block"][0].as_py(), salts)])

    def valued(keys: np.ndarray, counts: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
        distinct, count = summed(keys, counts)
        return distinct, log10_probability(distinct, count, depth, shallow) if kind == GRAMS else count.astype(np.float64)

    def told(group: pa.Table, distinct: np.ndarray, value: np.ndarray, keys: np.ndarray) -> pa.Table:
        value = value[np.searchsorted(distinct, keys)]
        ends = np.cumsum(group["n"].to_numpy())
        return pa.table({**{c: group[c] for c in ("kind", "bucket", "block", "n", "keys")}, "values": pa.array([_packed(v) for v in np.split(value, ends[:-1])], pa.binary())})

    def valued_pages(group: pa.Table) -> pa.Table:
        keys, counts = _entries(group)
        return told(group, *valued(keys, counts, group["kind"][0].as_py()), keys)

    def asked(pages: pa.Table, above: pa.Table) -> pa.Table:
        """Pages are told by the one page of their group."""
        n = above["n"][0].as_py()
        distinct = np.cumsum(_unpacked(above["keys"][0].as_py(), n, np.uint64), dtype=np.uint64)
        return told(pages, distinct, _unpacked(above["values"][0].as_py(), n, np.float64), _entries(pages)[0])

    vocabulary = rows.groupBy("block").applyInArrow(pages, PAGES)
    answer, key = "kind int, bucket long, block long, n long, keys binary, values binary", ["kind", "bucket", "salt"]
    *lower, top = tree_of(vocabulary, salts)
    answered = top.groupBy("kind", "bucket").applyInArrow(valued_pages, answer)
    for level in reversed(lower):
        answered = level.groupBy(key).cogroup(answered.withColumnRenamed("block", "salt").groupBy(key)).applyInArrow(asked, answer)

    def scored(group: pa.Table, pages: pa.Table) -> pa.Table:
        tables = []
        for kind in (GRAMS, WORDS):
            mine = [(np.cumsum(_unpacked(k, n, np.uint64), dtype=np.uint64), _unpacked(v, n, np.float64)) for t, n, k, v in zip(*[pages[c].to_pylist() for c in ("kind", "n", "keys", "values")], strict=True) if t == kind]
            keys = np.concatenate([k for k, _ in mine]) if mine else np.zeros(0, np.uint64)
            value = np.concatenate([v for _, v in mine]) if mine else np.zeros(0)
            tables.append(Lookup(keys, value))
        out = {k: [np.zeros(0, np.int64)] for k in ("n_tokens", "n_known", "base_score", "score", "n_coded")}
        ids, train = [], []
        end_score = math.log10((ends + 0.1) / divisor)
        per_text = lambda v, at: np.diff(np.r_[0.0, np.cumsum(v)][at])
        for part, grams, g, words, w in chunks_of(group, depth):
            ids.append(part.column(part.schema.get_field_index("doc_id")))
            train.append(part.column(part.schema.get_field_index("train")))
            out["score"].append(per_text(tables[GRAMS](grams), g))
            count = tables[WORDS](words)
            out["base_score"].append(per_text(np.log10((count + 0.1) / divisor), w) + end_score)
            out["n_tokens"].append(np.diff(w) + 1)
            out["n_known"].append(per_text(count > 0, w).astype(np.int64) + (ends > 0))
            out["n_coded"].append(np.diff(g))
        done = {k: np.concatenate(v) for k, v in out.items()}
        n = len(done["score"])
        columns = {"doc_id": pa.chunked_array(ids, pa.int64()), "train": pa.chunked_array(train, pa.bool_()), "n_tokens": done["n_tokens"].astype(np.int64), "n_known": done["n_known"].astype(np.int64), "train_tokens": np.full(n, train_tokens), "base_score": done["base_score"].astype(np.float64), "score": done["score"].astype(np.float64), "n_coded": done["n_coded"].astype(np.int64)}
        return pa.table(columns)

    return rows.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(scored, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_coded long")


def op10_ctw_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", (doc_bucket(10) != 0).alias("train"))
    out = score_documents(docs)
    bits = (-F.col("score") * math.log2(10) / F.col("n_coded")).alias("bits_per_byte")
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits)
