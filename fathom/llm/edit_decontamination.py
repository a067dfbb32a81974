"""Benchmark decontamination by edit distance.

Words (ASCII case ignored, marks at their ends dropped) are the symbols. A CGK random walk copies a symbol to the output and
moves on by a random bit that depends on the step and the symbol; walks of similar sequences run together again after an edit,
so edit distance becomes Hamming distance. The embeddings of the benchmark items are indexed by repeated bit sampling: each
repetition draws a walk and, for each of its tables, a few output positions. Windows of the documents as long as the items are
embedded alike and looked up, at every place; a candidate pair is verified by the exact edit distance of the words, free at both ends of the
document's side. Repetitions are chosen for a target recall.

Which windows: one of length n can only be within distance K = floor((1 - similarity) n) of an item of about that length if
n + 1 - q - K q of its q-grams of words occur in the benchmark (every edit destroys q of them). Running counts of
such grams leave few windows to embed, and lose none. A copy with words missing can be shorter than the item and end with the
document, where no window as long as the item begins at its first word (or the document holds none): the last words of a document
are compared with every item of which they hold that many grams, so none is lost there either.

Items with fewer than MIN_WORDS words allow one edit at most and are looked up exactly: where one of their halves occurs as it is (or all
of it, where no edit is allowed), hashes of the two sides of every possible edit are compared. In scripts written without spaces every
character is a word.

The benchmark is the broadcast: at most MAX_ITEMS items of MAX_WORDS words, checked; a larger benchmark is taken in turns over
the documents. Documents are not shuffled.

Defined results: null or empty texts and items match nothing; an item without an id is searched for like any other; an item of one
word matches every document with that word; repeated documents or items give repeated rows; an empty table on either side gives an
empty result; other columns are not looked at.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import RangeHash, Words, byte_values, lower_ascii, mix, slices, table, text_bytes, tidy

SIMILARITY = 0.8
#: Items of fewer words are looked up exactly, not by walks.
MIN_WORDS = 8
GRAM = 3
MAX_ITEMS, MAX_WORDS = 20_000, 2_000_000
#: Repetitions of the walk, tables of each, and output positions of each table.
WALKS, TABLES, SAMPLES = 10, 8, 5
WINDOWS_AT_ONCE, WORDS_AT_ONCE = 20_000, 500_000
MARKS = np.zeros(256, np.bool_)
MARKS[[ord(c) for c in ".,;:!?\"'()[]{}*#-_|<>~`$%&"]] = True


#: First code points of ranges that are written without spaces, and of what follows them: Thai and Lao, Myanmar, Khmer, kana and Han, and
#: Han and kana of compatibility and full width.
UNSPACED = np.array([0x0E00, 0x0F00, 0x1000, 0x10A0, 0x1780, 0x1800, 0x3040, 0x3130, 0x3190, 0xA000, 0xF900, 0xFB00, 0xFF66, 0xFFA0, 0x1B000, 0x1B170, 0x20000, 0x40000])
#: Ideographic and full-width marks, which are spaces here.
WIDE_MARKS = np.array([0x3000, 0x3040, 0xFF00, 0xFF10, 0xFF1A, 0xFF21, 0xFF3B, 0xFF41, 0xFF5B, 0xFF66])


def spread(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words cut so that every character of a script without spaces is one, and its marks are left out."""
    at = np.flatnonzero(raw >= 0xE0)
    at = at[at + np.where(raw[at] >= 0xF0, 4, 3) <= len(raw)]
    if not len(at):
        return start, end
    size = np.where(raw[at] >= 0xF0, 4, 3)
    code = np.zeros(len(at), np.int64)
    for k in range(4):
        byte = raw[np.minimum(at + k, len(raw) - 1)].astype(np.int64)
        code = np.where(k < size, (code << 6) + np.where(k == 0, byte & np.where(size == 4, 7, 15), byte & 63), code)
    alone, mark = (np.searchsorted(ranges, code, side="right") % 2 == 1 for ranges in (UNSPACED, WIDE_MARKS))
    cut = alone | mark
    if not cut.any():
        return start, end
    at, stop, mark = at[cut], at[cut] + size[cut], mark[cut]
    bounds = np.unique(np.concatenate([start, end, at, stop]))
    a, b = bounds[:-1], bounds[1:]
    word = np.searchsorted(start, a, side="right") - 1
    kept = (word >= 0) & (b <= end[word]) & ~np.isin(a, at[mark])
    return a[kept], b[kept]


def word_symbols(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first word of each text, byte start and end of the words); words of marks alone are left out."""
    low = lower_ascii(raw)
    words = Words(low, offs)
    whole = spread(low, words.start, words.end)
    start, end = whole[0].copy(), whole[1].copy()
    for _ in range(4):
        more = (end > start) & MARKS[low[np.minimum(start, len(low) - 1)]]
        start[more] += 1
        more = (end > start) & MARKS[low[np.maximum(end - 1, 0)]]
        end[more] -= 1
    keep = end > start
    kept = np.r_[0, np.cumsum(keep)]
    return RangeHash(byte_values(low)).of(start[keep], end[keep]), kept[np.searchsorted(whole[0], offs)], whole[0][keep], whole[1][keep]


def edits_allowed(n: int | np.ndarray, similarity: float) -> int | np.ndarray:
    return np.floor((1 - similarity) * n + 1e-9).astype(np.int64)


def sides(ranges: RangeHash, at: np.ndarray, n: int, edit: tuple[int, int, int], of_item: bool) -> np.ndarray:
    """Hashes of what an edit leaves of n words from `at` on. edit: (words before it, words that the item loses, words that the text
    has instead)."""
    before, item, text = edit
    skipped = item if of_item else text
    middle, begin = at + before, at + before + skipped
    return mix(ranges.of(at, middle)) * np.uint64(3) ^ ranges.of(begin, begin + n - before - item)


@dataclass
class Short:
    """Items of n words, fewer than MIN_WORDS."""

    n: int
    parts: list[tuple[int, int, np.ndarray]]
    """(first word, words, sorted hashes) of the parts of which an edited copy has one as it is."""
    keys: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]]
    """By edit: sorted hashes of its sides, and their items; the first entry is no edit."""

    @classmethod
    def of(cls, n: int, symbols: list[np.ndarray], items: np.ndarray, edits: int) -> Short:
        ranges, at = RangeHash(np.concatenate([symbols[i] for i in items])), np.arange(len(items)) * n
        bounds = [0, n // 2, n] if edits else [0, n]
        parts = [(a, b - a, np.unique(ranges.of(at + a, at + b))) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        kinds = [(0, 0, 0)]
        if edits:
            kinds += [(j, 1, 0) for j in range(n)] + [(j, 1, 1) for j in range(1, n - 1)] + [(j, 0, 1) for j in range(1, n)]
        keys = {}
        for edit in kinds:
            own = sides(ranges, at, n, edit, True)
            order = np.argsort(own, kind="stable")
            keys[edit] = own[order], items[order]
        return cls(n, parts, keys)

    def starts(self, ranges: RangeHash, total: int) -> np.ndarray:
        """Places where a copy may begin."""
        out = []
        for begin, words, known in self.parts:
            at = np.arange(max(0, total - words + 1))
            own = ranges.of(at, at + words)
            hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own)
            out += [hit - begin + shift for shift in ((-1, 0, 1) if begin else (0,))]
        at = np.unique(np.concatenate(out))
        return at[(at >= 0) & (at < total)]

    def found(self, ranges: RangeHash, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, distance, start, end) of copies inside one text, in any order."""
        all_starts = self.starts(ranges, int(first[-1]))
        limit = first[np.searchsorted(first, all_starts, side="right")]
        for edit, (keys, items) in self.keys.items():
            words = self.n - edit[1] + edit[2]
            at = all_starts[all_starts + words <= limit]
            own = sides(ranges, at, self.n, edit, False)
            low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
            text = np.searchsorted(first, at, side="right") - 1
            for w in np.flatnonzero(high > low):
                for item in items[low[w] : high[w]]:
                    yield int(text[w]), int(item), int(edit != (0, 0, 0)), int(at[w]), int(at[w]) + words


@dataclass
class Index:
    symbols: list[np.ndarray]
    ids: list[int]
    similarity: float
    short: list[Short] = field(default_factory=list)
    grams: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    of_length: tuple[np.ndarray, np.ndarray] = (np.zeros(1, np.int64), np.zeros(0, np.int64))
    """First entry of each gram (and the total), and the lengths (as places in `lengths`) of items that have it."""
    posted: tuple[np.ndarray, np.ndarray] = (np.zeros(1, np.int64), np.zeros(0, np.int64))
    """First posting of each gram (and the total), and the items that have it."""
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    tables: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    """By window length, walk and table: sorted keys, and their items."""


def walk_bits(seed: int, step: int, symbols: np.ndarray) -> np.ndarray:
    """The walk's random bit for each symbol at a step."""
    return (mix(symbols ^ np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xC2B2AE3D27D4EB4F) & (1 << 64) - 1)) >> np.uint64(63)).astype(np.int64)


@functools.lru_cache(maxsize=None)
def sampled_steps(n: int, walk: int) -> np.ndarray:
    """(TABLES, SAMPLES) output positions; of the 3 n steps the first 2 n, where walks still read words."""
    rng = np.random.default_rng(1000 * n + walk)
    return rng.integers(0, max(1, 2 * n - 2), (TABLES, SAMPLES))


def walk_outputs(symbols: np.ndarray, at: np.ndarray, steps: int, walk: int) -> tuple[np.ndarray, np.ndarray]:
    """(steps, windows) symbols and places that walks from `at` on read; a shorter window reads the same until its end."""
    output, places = np.zeros((steps, len(at)), np.uint64), np.zeros((steps, len(at)), np.int32)
    place, last = np.zeros(len(at), np.int64), len(symbols) - 1
    for step in range(steps):
        symbol = symbols[np.minimum(at + place, last)]
        output[step], places[step] = symbol, place
        place += walk_bits(walk + 1, step, symbol)
    return output, places


def sampled_keys(output: np.ndarray, places: np.ndarray, n: int, walk: int) -> np.ndarray:
    """(TABLES, windows) keys of windows of n words: the sampled symbols, 0 beyond the window, hashed."""
    keys = np.zeros((TABLES, output.shape[1]), np.uint64)
    for t, steps in enumerate(sampled_steps(n, walk)):
        for k, step in enumerate(steps):
            keys[t] += np.where(places[step] < n, output[step], np.uint64(0)) * np.uint64(2 * k + 1) ^ np.uint64(k)
    return mix(keys)


def build_index(items: list[tuple[int, str | None]], similarity: float) -> Index:
    column = pa.array([t for _, t in items], pa.string())
    symbols, first, _, _ = word_symbols(*text_bytes(column))
    index = Index([], [], similarity)
    for (i, _), a, b in zip(items, first[:-1], first[1:], strict=True):
        if b > a:
            index.symbols.append(symbols[a:b])
            index.ids.append(i)
    # Longer items first: only they have grams and tables.
    order = sorted(range(len(index.ids)), key=lambda i: len(index.symbols[i]) < MIN_WORDS)
    everything = index.symbols = [index.symbols[i] for i in order]
    index.ids = [index.ids[i] for i in order]
    counts = np.array([len(s) for s in everything], np.int64)
    for n in np.unique(counts[counts < MIN_WORDS]).tolist():
        index.short.append(Short.of(n, everything, np.flatnonzero(counts == n), int(edits_allowed(n, similarity))))
    if not (counts >= MIN_WORDS).any():
        return index
    index.symbols = everything[: int((counts >= MIN_WORDS).sum())]
    index.grams = np.unique(np.concatenate([RangeHash(s).grams(GRAM) for s in index.symbols]))
    index.sizes = sizes = np.array([len(s) for s in index.symbols])
    index.lengths = np.unique(sizes)
    own = [np.unique(np.searchsorted(index.grams, RangeHash(s).grams(GRAM))) for s in index.symbols]
    gram, item = np.concatenate(own), np.repeat(np.arange(len(own)), [len(g) for g in own])
    order = np.argsort(gram, kind="stable")
    index.posted = np.searchsorted(gram[order], np.arange(len(index.grams) + 1)), item[order]
    both = np.unique(gram * len(index.lengths) + np.searchsorted(index.lengths, sizes)[item])
    index.of_length = np.searchsorted(both // len(index.lengths), np.arange(len(index.grams) + 1)), both % len(index.lengths)
    joined = np.concatenate(index.symbols)
    begin = np.cumsum(sizes) - sizes
    for walk in range(WALKS):
        output, places = walk_outputs(joined, begin, 2 * int(sizes.max()), walk)
        for n in index.lengths.tolist():
            mine = np.flatnonzero(sizes == n)
            for t, keys in enumerate(sampled_keys(output[:, mine], places[:, mine], n, walk)):
                order = np.argsort(keys)
                index.tables[n, walk, t] = keys[order], mine[order]
    index.symbols = everything
    return index


def edit_distance(item: np.ndarray, text: np.ndarray, most: int) -> tuple[int, int, int]:
    """(distance, start, end) of the best match of the item with a run of the text; distance is most + 1 when there is none."""
    n = len(text)
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    lane = np.arange(n + 1)
    for symbol in item:
        replace, drop = cost[:-1] + (text != symbol), cost[1:] + 1
        new = np.r_[cost[0] + 1, np.minimum(replace, drop)]
        origin = np.r_[start[0], np.where(replace <= drop, start[:-1], start[1:])]
        # Words of the text that the item lacks: the least over all cells to the left, at one for each step.
        lead = np.minimum.accumulate((new - lane) * (n + 2) + lane)  # ties: the leftmost cell
        source = lead % (n + 2)
        better = new[source] + lane - source < new
        cost, start = np.where(better, new[source] + lane - source, new), np.where(better, origin[source], origin)
        if cost.min() > most:
            return most + 1, 0, 0
    end = int(cost.argmin())
    return int(cost[end]), int(start[end]), end


def gram_hits(index: Index, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a gram of words of the benchmark begins, and which gram it is."""
    grams = RangeHash(symbols).grams(GRAM)
    gram = np.minimum(np.searchsorted(index.grams, grams), len(index.grams) - 1)
    at = np.flatnonzero(index.grams[gram] == grams)
    return at, gram[at]


def grams_needed(index: Index, n: int | np.ndarray) -> int | np.ndarray:
    return np.maximum(1, n + 1 - GRAM - edits_allowed(n, index.similarity) * GRAM)


def ending(index: Index, first: np.ndarray, hit: np.ndarray, gram: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, item, place) where the last words of a text, as many as the item has, hold enough of its grams."""
    begin, items = index.posted
    needed = grams_needed(index, index.sizes)
    text = np.searchsorted(first, hit, side="right") - 1
    near = (hit + GRAM <= first[text + 1]) & (hit >= first[text + 1] - index.lengths[-1])
    hit, gram, text = hit[near], gram[near], text[near]
    bounds = np.flatnonzero(np.r_[True, text[1:] != text[:-1], True]) if len(text) else np.zeros(1, np.int64)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= needed.min():
            end = first[text[a] + 1]
            mine = np.concatenate([items[begin[g] : begin[g + 1]] for g in gram[a:b]])
            place = np.repeat(hit[a:b], begin[gram[a:b] + 1] - begin[gram[a:b]])
            count = np.bincount(mine[place >= end - index.sizes[mine]], minlength=len(needed))
            for item in np.flatnonzero(count >= needed):
                yield int(text[a]), int(item), max(int(first[text[a]]), int(end - index.sizes[item]))


def hopeful(index: Index, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Texts with as many grams of the benchmark as the least demanding window needs, or with a part of a short item."""
    short = [np.zeros(0, np.int64)]
    if index.short and len(symbols):
        ranges = RangeHash(symbols)
        for kind in index.short:
            short.append(np.searchsorted(first, kind.starts(ranges, len(symbols)), side="right") - 1)
    if not len(index.lengths) or len(symbols) < GRAM:
        return np.unique(np.concatenate(short))
    at, _ = gram_hits(index, symbols)
    at = at[at + GRAM <= first[np.searchsorted(first, at, side="right")]]
    inside = np.bincount(np.searchsorted(first, at, side="right") - 1, minlength=len(first) - 1)
    return np.unique(np.concatenate([*short, np.flatnonzero(inside >= min(grams_needed(index, n) for n in index.lengths.tolist()))]))


def matches(index: Index, symbols: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, first word, end word) of the best match of each pair of text and item."""
    ranges, best = RangeHash(symbols), {}
    for kind in index.short if len(symbols) else []:
        for d, item, *match in kind.found(ranges, first):
            best[d, item] = min(match, best.get((d, item), match))
    short = [(d, item, distance, a - int(first[d]), b - int(first[d])) for (d, item), (distance, a, b) in best.items()]
    return short + long_matches(index, symbols, first)


def long_matches(index: Index, symbols: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """The matches of items of MIN_WORDS words or more, one for each candidate pair."""
    if not len(index.lengths) or len(symbols) < GRAM:
        return []
    hit, gram = gram_hits(index, symbols)
    if not len(hit):
        return []
    doc = np.searchsorted(first, np.arange(len(symbols)), side="right") - 1
    pairs: dict[tuple[int, int], list[int]] = {}
    chosen: dict[int, np.ndarray] = {}
    begin, lengths = index.of_length
    times = begin[gram + 1] - begin[gram]
    places = np.repeat(hit, times)
    kinds = lengths[np.arange(times.sum()) + np.repeat(begin[gram] - (np.cumsum(times) - times), times)]
    order = np.argsort(kinds, kind="stable")
    places, of_kind = places[order], np.searchsorted(kinds[order], np.arange(len(index.lengths) + 1))
    marks = np.zeros(len(symbols) + 1, np.int64)
    for c, n in enumerate(index.lengths[index.lengths <= len(symbols)].tolist()):
        marks[:] = 0
        marks[places[of_kind[c] : of_kind[c + 1]] + 1] = 1
        hits = np.cumsum(marks)
        count = hits[n - GRAM + 1 : len(symbols) - GRAM + 2] - hits[: len(symbols) - n + 1]
        at = np.flatnonzero(count >= grams_needed(index, n))
        at = at[at + n <= first[doc[at] + 1]]
        if len(at):
            chosen[n] = at
    starts = np.unique(np.concatenate(list(chosen.values()))) if chosen else np.zeros(0, np.int64)
    for base in range(0, len(starts), WINDOWS_AT_ONCE):
        some = starts[base : base + WINDOWS_AT_ONCE]
        mine = {n: at[(at >= some[0]) & (at <= some[-1])] for n, at in chosen.items()}
        for walk in range(WALKS):
            output, places = walk_outputs(symbols, some, 2 * max(chosen), walk)
            for n, at in mine.items():
                column = np.searchsorted(some, at)
                for t, keys in enumerate(sampled_keys(output[:, column], places[:, column], n, walk)):
                    keyed, items = index.tables[n, walk, t]
                    low, high = np.searchsorted(keyed, keys), np.searchsorted(keyed, keys, side="right")
                    for w in np.flatnonzero(high > low):
                        for item in items[low[w] : high[w]]:
                            pairs.setdefault((int(doc[at[w]]), int(item)), []).append(int(at[w]))
    for d, item, p in ending(index, first, hit, gram):
        pairs.setdefault((d, item), []).append(p)
    out = []
    for (d, item), starts in pairs.items():
        own = index.symbols[item]
        allowed = int(edits_allowed(len(own), index.similarity))
        best, done = None, -1
        for p in sorted(set(starts)):
            if p <= done:
                continue
            a, b = max(int(first[d]), p - allowed), min(int(first[d + 1]), p + len(own) + 2 * allowed + len(own))
            done = p + len(own)
            distance, start, end = edit_distance(own, symbols[a:b], allowed)
            if distance <= allowed and (best is None or distance < best[0]):
                best = (distance, a + start - int(first[d]), a + end - int(first[d]))
        if best:
            out.append((d, item, *best))
    return out


SCHEMA = "doc_id long, item_id long, distance int, item_words int, first_word int, end_word int, first_byte long, end_byte long"


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each document and benchmark item that it holds within the similarity: see SCHEMA. Bytes are a range of the
    document's UTF-8 text."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("text IS NOT NULL").orderBy("item_id", "text")
    spark, out, turn = docs.sparkSession, None, []
    words = 0
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def search(index: Index) -> DataFrame:
        def together(held: list[tuple]) -> Iterator[pa.RecordBatch]:
            rows = []
            if held:
                first = np.r_[0, np.cumsum([len(h[1]) for h in held])]
                for d, item, distance, a, b in matches(index, np.concatenate([h[1] for h in held]), first):
                    doc_id, _, start, end = held[d]
                    rows.append((doc_id, index.ids[item], distance, len(index.symbols[item]), a, b, int(start[a]), int(end[b - 1])))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []  # documents that hold enough grams of the benchmark: few, so they are searched together
            words = 0
            for batch in batches:
                for part, raw, offs in slices(batch, "text"):
                    symbols, first, start, end = word_symbols(raw, offs)
                    for d in hopeful(index, symbols, first).tolist():
                        a, b = first[d], first[d + 1]
                        held.append((part.column(0)[d].as_py(), symbols[a:b].copy(), start[a:b] - offs[d], end[a:b] - offs[d]))
                        words += b - a
                    if words > WORDS_AT_ONCE:
                        yield from together(held)
                        held, words = [], 0
            yield from together(held)

        return source.mapInArrow(tidy(found), SCHEMA)

    for row in items.toLocalIterator():  # in turns of bounded size
        turn.append((row["item_id"], row["text"]))
        words += max(len(row["text"]) // 4, sum(c >= "\u0e00" for c in row["text"]))
        if len(turn) >= MAX_ITEMS or words >= MAX_WORDS:
            part = search(build_index(turn, similarity))
            out, turn, words = part if out is None else out.unionByName(part), [], 0
    if turn or out is None:
        part = search(build_index(turn, similarity)) if turn else spark.createDataFrame([], SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
