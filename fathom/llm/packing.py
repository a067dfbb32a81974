"""Packing into fixed windows by order-preserving dynamic programming.

The documents of a block stay in order as one token stream. Boundaries are document ends, sentence ends and, so that any text
can be cut, token positions at a stride. A plan is a chain of boundaries; a window between two of them costs its padding plus the penalty of the cut at its
end. Over a window that slides by at most `length` tokens the best predecessor is min(cost + position), which a monotone queue
yields in constant time; windows whose length is a power of two need no padding and are a dozen more transitions.

Blocks are runs of whole input rows in the order in which Spark reads them, each of about BLOCK_TOKENS; no text is shuffled, and
a lost task repeats from its file split with the same result.

Defined results: a null text is empty and still yields its end token; very long documents span windows; repeated rows are packed
twice; an empty table gives an empty result. Sequence ids are unique, not gapless.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, tidy

LENGTH = 4096
#: Tokens of padding that a cut inside a document may save before it pays.
SENTENCE_CUT, WORD_CUT = 24, 96
#: Tokens that are planned together.
BLOCK_TOKENS = 64 * LENGTH
#: Positions where a cut inside a sentence is considered.
STRIDE = 256
#: Words whose ids a task keeps at most.
CACHE_WORDS = 1_200_000
END_ID = 2
#: Sentence ends besides those of ASCII: full-width, Devanagari, Arabic and Ethiopic ones, and the ellipsis.
WIDE_STOPS = "\u3002\uff01\uff1f\uff0e\u0964\u06d4\u061f\u1362\u2026"
END_BYTES = np.array([END_ID], "<u4").tobytes()


#: A word of Latin letters and closing marks: the tokenizer ignores case and splits it between the two, and only there; the ids of
#: both parts end with one that ends a word.
SIMPLE = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")


#: White space as the tokenizer sees it; str.split() takes four more characters for it.
NOT_SPACE = re.compile("[^ \t\n\r\f\v\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


def words_of(text: str) -> list[str]:
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return NOT_SPACE.findall(text)
    return text.split()


class WordIds:
    """Little-endian 32-bit ids of each word between white space. Ids of a text are those of its words one after another, as the
    tokenizer drops white space and never joins over it. New words are encoded many at a time."""

    BETWEEN, BETWEEN_ID, AT_ONCE = "<|endoftext|>", 49407, 512

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.of: dict[str, bytes] = {}
        self.most = CACHE_WORDS
        vocabulary = self.tokenizer.get_vocab()
        self.stop, self.last = np.zeros((2, max(vocabulary.values()) + 1), np.bool_)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.stop[[i for token, i in vocabulary.items() if set(token.removesuffix("</w>")) <= set(".!?") and token.endswith("</w>")]] = True
        for mark in WIDE_STOPS:  # where a token of its own stands for one
            if len(ids := self.ids(mark)) == 1:
                self.stop[ids] = True

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _encode(self, words: list[str], ends: np.ndarray, between: str) -> None:
        """Encode words together; a word's ids end where `ends` says so."""
        for k in range(0, len(words), self.AT_ONCE):
            some = words[k : k + self.AT_ONCE]
            ids = self.ids(between.join(some))
            cut = np.flatnonzero(ends[ids]) + 1
            data = ids.tobytes()
            last = 0
            for w, c in zip(some, (4 * cut).tolist(), strict=True):
                self.of[w] = data[last:c]
                last = c

    def _encode_odd(self, words: list[str]) -> None:
        """Words that the tokenizer may split anywhere: a special token follows each, and is taken off again."""
        special = np.zeros(len(self.last), np.bool_)
        special[self.BETWEEN_ID] = True
        plain = {f"{w} {self.BETWEEN}": w for w in words if "<|" not in w}
        self._encode(list(plain), special, " ")
        for ended, w in plain.items():
            self.of[w] = self.of.pop(ended)[:-4]
        for w in words:
            if "<|" in w:
                self.of[w] = self.ids(w).tobytes()

    def learn(self, words: set[str]) -> None:
        of = self.of
        new = words.difference(of)
        if len(of) + len(new) > self.most:
            of.clear()
            new = words
        parts = {}
        for w in new:
            if (m := SIMPLE.fullmatch(w)) is not None:
                parts[w] = (m[1].lower(), m[2])
        self._encode_odd([w for w in new if w not in parts])
        of[""] = b""
        self._encode([w for w in set().union(*parts.values()) if w not in of], self.last, " ")
        for w, (letters, marks) in parts.items():
            of[w] = of[letters] + of[marks]

    def stream(self, words: list[str]) -> tuple[bytes, np.ndarray]:
        """Ids of learned words with the end id, and the token positions after which a sentence ends."""
        data = b"".join(map(self.of.__getitem__, words)) + END_BYTES
        return data, np.flatnonzero(self.stop[np.frombuffer(data, "<u4")[:-1]]) + 1


_known: dict[str, WordIds] = {}


def known_words(path: str, most: int = CACHE_WORDS) -> WordIds:
    """One cache for each Python worker and tokenizer; it outlives tasks."""
    if path not in _known:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _known[path] = WordIds(path)
    _known[path].most = most
    return _known[path]


def plan(positions: np.ndarray, penalties: np.ndarray, length: int = LENGTH) -> list[int]:
    """Indices of the chosen boundaries. positions: increasing, from 0, steps of `length` at most; the last one is taken."""
    at, penalty = positions.tolist(), penalties.tolist()
    exact: dict[int, list[int]] = {}  # predecessors at a power of two
    for k in range(length.bit_length() - 1):
        i = np.searchsorted(positions, positions - (1 << k))
        for j in np.flatnonzero(positions[i] == positions - (1 << k)).tolist():
            exact.setdefault(j, []).append(int(i[j]))
    cost, back = [0.0] * len(at), [0] * len(at)
    queue: deque[int] = deque([0])  # increasing cost + position
    for j in range(1, len(at)):
        p = at[j]
        while p - at[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        best = cost[i] + length - (p - at[i])
        for k in exact.get(j, ()):
            if cost[k] < best:
                best, i = cost[k], k
        cost[j], back[j] = best + penalty[j], i
        key = cost[j] + p
        while queue and cost[queue[-1]] + at[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    chosen, j = [], len(at) - 1
    while j:
        chosen.append(j)
        j = back[j]
    return chosen[::-1]


def boundaries(doc_ends: np.ndarray, sentence_ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts of a stream and their penalties; among them cuts that leave powers of two before the end."""
    total = int(doc_ends[-1])
    steps = []
    for k in range(length.bit_length() - 2, -1, -1):
        steps += [total - (total % length % (2 << k)), total - (1 << k)]
    free = np.concatenate([np.arange(STRIDE, total, STRIDE), np.array([s for s in steps if 0 < s < total], np.int64)])
    every = np.concatenate([free, sentence_ends, doc_ends])
    price = np.concatenate([np.full(len(free), WORD_CUT), np.full(len(sentence_ends), SENTENCE_CUT), np.zeros(len(doc_ends))])
    order = np.lexsort((price, every))
    every, price = every[order], price[order]
    keep = np.r_[True, every[1:] != every[:-1]] & (every > 0)
    return np.r_[0, every[keep]].astype(np.int64), np.r_[0, price[keep]]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS, cache_words: int = CACHE_WORDS) -> DataFrame:
    """Pieces of all documents (doc_id, text): see PIECES; a piece lies in sequence_id from offset on."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sequence = known_words(tokenizer_path, cache_words), TaskContext.get().partitionId() << 33

        def packed(block: list[tuple[int | None, bytes, np.ndarray]]) -> pa.RecordBatch:
            nonlocal sequence
            sizes = np.array([len(ids) // 4 for _, ids, _ in block], np.int64)
            ends = np.cumsum(sizes)
            starts = ends - sizes
            stops = np.concatenate([s + b for (_, _, s), b in zip(block, starts, strict=True)])
            at, price = boundaries(ends, stops, length)
            cuts = at[[0, *plan(at, price, length)]]
            edges = np.unique(np.concatenate([cuts, ends, starts]))  # piece borders: cuts and document borders
            left, right = edges[:-1], edges[1:]
            doc = np.searchsorted(ends, left, side="right")
            window = np.searchsorted(cuts, left, side="right") - 1
            rows = {"doc_id": [], "ids_crc32": []}
            for d, a, b in zip(doc.tolist(), left.tolist(), right.tolist(), strict=True):
                i, ids, _ = block[d]
                rows["doc_id"].append(i)
                rows["ids_crc32"].append(zlib.crc32(memoryview(ids)[4 * (a - int(starts[d])) : 4 * (b - int(starts[d]))]))
            out = [pa.array(rows["doc_id"], pa.int64()), left - starts[doc], right - left, pa.array(rows["ids_crc32"], pa.int64()), sizes[doc], sequence + window, left - cuts[window]]
            sequence += len(cuts) - 1
            return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], [c.split()[0] for c in PIECES.split(", ")])

        block, held = [], 0
        for batch in batches:
            for part, _, _ in slices(batch, "text"):
                split = [words_of(text or "") for text in part.column(1).to_pylist()]
                words.learn(set().union(*split))
                for doc_id, parts in zip(part.column(0).to_pylist(), split, strict=True):
                    ids, stops = words.stream(parts)
                    block.append((doc_id, ids, stops))
                    held += len(ids) // 4
                    if held >= block_tokens:
                        yield packed(block)
                        block, held = [], 0
        if block:
            yield packed(block)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(pieces), PIECES)


def op3_dp_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
