"""Small helpers shared by the training-data operators: table access, checkpoints, and NumPy views of Arrow text.

Texts are handled as UTF-8 bytes. A null text is an empty byte string unless an operator says otherwise.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one NumPy step works on. Bounds the memory of a Python worker, whatever the size of a batch.
CHUNK_BYTES = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of an Arrow batch: with texts of a few kB, a few MB on either side of the pipe to Python.
BATCH_ROWS = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded(query):
    """A query or pipeline stage, f(spark, ...), whose Arrow batches are small enough for texts; the session's own setting is
    kept where it is smaller."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        now = int(spark.conf.get(BATCH_SETTING))
        if now <= 0 or now > BATCH_ROWS:
            spark.conf.set(BATCH_SETTING, BATCH_ROWS)
        return query(spark, *args)

    return run


def tidy(step):
    """A mapInArrow function that gives free memory back to the system when its partition ends: Python workers live on between
    tasks, and what their allocators keep would add up next to the JVM."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):
                ctypes.CDLL(None).malloc_trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local folder serves a local master (tests) only: on
    a cluster tables written there would be lost."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (where or "file:///tmp/checkpoints").rstrip("/")


def materialise(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Write a DataFrame as Parquet into the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets several consumers read a result that was computed once. parts: deal a
    small result to so many files, rather than one for each task that made it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/fathom-{uuid.uuid4().hex}"
    (df.repartition(parts) if parts else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if _scratch:
        _scratch[-1].append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextlib.contextmanager
def scratch(keep: list[DataFrame]) -> Iterator[None]:
    """Deletes at its end what materialise() wrote inside it, but for the tables in keep."""
    _scratch.append([])
    try:
        yield
    finally:
        discard(*[df for df in _scratch.pop() if not any(df is k for k in keep)])


def discard(*written: DataFrame) -> None:
    """Delete what materialise() wrote, once nothing that is still to run reads it."""
    for df in written:
        if path := getattr(df, "_written", None):
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def doc_bucket(modulus: int, column: str = "doc_id"):
    """crc32(id as text) mod modulus; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(modulus)), F.lit(0))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column, without a copy; nulls have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Consecutive row slices whose texts hold about `limit` bytes (one row at least), with bytes and offsets."""
    raw, offs = text_bytes(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1)
        j = min(j, n)
        yield batch.slice(i, j - i), raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@functools.lru_cache(maxsize=2)
def _byte_table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1024)
        out = np.full(size, np.uint64(base), np.uint64)
        out[0] = 1
        _powers[base] = have = np.cumprod(out, dtype=np.uint64)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class RangeHash:
    """Hashes of any ranges of a sequence of 64-bit values, from one prefix sum."""

    def __init__(self, values: np.ndarray):
        self.prefix = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(_BASE, len(values)), out=self.prefix[1:])
        self.inverse = powers(_INVERSE, len(values) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all ranges of length k."""
        n = max(0, len(self.prefix) - k)
        return mix((self.prefix[k:] - self.prefix[:n]) * self.inverse[:n])


def byte_values(raw: np.ndarray, seed: int = 1) -> np.ndarray:
    return _byte_table(seed)[raw]


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    return raw + ((raw >= 65) & (raw <= 90)).astype(np.uint8) * np.uint8(32)


class Lookup:
    """Values of distinct 64-bit keys by open addressing; much faster than a binary search over many keys. All asked keys must
    be there."""

    _EMPTY, _MIX = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(_BASE)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, self._EMPTY), np.zeros(1 << bits, values.dtype)
        left = np.arange(len(keys))
        slot = keys * self._MIX >> self.shift
        while len(left):
            at = slot[left]
            free = left[self.keys[at] == self._EMPTY]
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot[left]] == keys[left]
            self.values[slot[left[placed]]] = values[left[placed]]
            left = left[~placed]
            slot[left] = slot[left] + np.uint64(1) & self.last

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        slot = asked * self._MIX >> self.shift
        out = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != asked)
        while len(miss):
            slot[miss] = slot[miss] + np.uint64(1) & self.last
            out[miss] = self.values[slot[miss]]
            miss = miss[self.keys[slot[miss]] != asked[miss]]
        return out


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of concatenated texts.

    start, end: byte ranges; doc: row of each word; first: index of each row's first word (and the total at the end).
    """

    def __init__(self, raw: np.ndarray, offs: np.ndarray):
        solid = np.empty(len(raw) + 2, np.bool_)
        solid[0] = solid[-1] = False
        solid[1:-1] = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edge = solid[1:] != solid[:-1]
        inner = offs[1:-1]
        inner = inner[(inner > 0) & (inner < len(raw))]
        cut = inner[solid[inner] & solid[inner + 1]]  # a word that would run over the end of a text
        bounds = np.flatnonzero(edge)
        if len(cut):
            bounds = np.sort(np.concatenate([bounds, np.repeat(np.unique(cut), 2)]))
        self.start, self.end = bounds[0::2], bounds[1::2]
        self.first = np.searchsorted(self.start, offs)
        self.doc = np.repeat(np.arange(len(offs) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, raw: np.ndarray, seed: int = 1) -> np.ndarray:
        return RangeHash(byte_values(raw, seed)).of(self.start, self.end)


def int64(values: np.ndarray) -> pa.Array:
    """An Arrow bigint column with the bits of unsigned or signed values."""
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))


def binary_rows(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose i-th value is flat[bounds[i]:bounds[i+1]] (bytes)."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
