import collections
import hashlib

import numpy as np
import pyarrow as pa
import pytest
from common_cases import documents, words

from fathom.llm import repeats
from fathom.llm import suffix_array as sa
from fathom.llm import suffix_tree as st
from fathom.llm.common import byte_values


def brute_bytes(docs, window):
    seen, out = set(), {}
    for i, text in docs:
        raw = (text or "").encode()
        change = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - window + 1):
            if raw[p : p + window] in seen:
                change[p] += 1
                change[p + window] -= 1
            seen.add(raw[p : p + window])
        gone = np.cumsum(change)[: len(raw)] > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[i] = (len(raw), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def brute_words(docs, window):
    count, out = collections.Counter(), {}
    split = {i: words(t) for i, t in docs}
    for w in split.values():
        count.update(tuple(w[p : p + window]) for p in range(len(w) - window + 1))
    for i, w in split.items():
        change = np.zeros(len(w) + 1, int)
        for p in range(len(w) - window + 1):
            if count[tuple(w[p : p + window])] > 1:
                change[p] += 1
                change[p + window] -= 1
        gone = np.cumsum(change)[: len(w)] > 0
        out[i] = (len(w), int(gone.sum()), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("alphabet,n", [(1, 300), (2, 700), (5, 3000), (250, 9000)])
def test_suffix_array(alphabet, n):
    rng = np.random.default_rng(alphabet)
    t = np.r_[rng.integers(1, alphabet + 1, n), 0].astype(np.int32)
    t[50:80] = t[100:130]
    got = sa.suffix_array(t, alphabet + 1)
    assert got.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("find,symbols", [(sa.equal_windows, np.uint8), (st.equal_windows, np.uint64)])
def test_equal_windows(find, symbols):
    rng = np.random.default_rng(3)
    pieces = [rng.integers(0, 3, rng.integers(4, 30)).astype(symbols) for _ in range(60)]
    flat, bounds = np.concatenate(pieces), np.r_[0, np.cumsum([len(p) for p in pieces])]
    at, group = find(flat, bounds, 6)
    content = collections.defaultdict(set)
    for p, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        for x in range(a, b - 5):
            content[flat[x : x + 6].tobytes()].add(int(x))
    expected = {frozenset(v) for v in content.values() if len(v) > 1}
    found = collections.defaultdict(set)
    for x, g in zip(at.tolist(), group.tolist()):
        found[g].add(x)
    assert {frozenset(v) for v in found.values()} == expected


@pytest.mark.parametrize("symbol,later_only", [(np.uint8, True), (np.uint8, False), (np.uint64, False)])
def test_shards_sort_only_what_may_repeat(symbol, later_only):
    """Pieces that share an anchor and little around it are not sorted; the spans are those of all windows compared."""
    rng, window, gram = np.random.default_rng(4), 20, 4
    common, passage = (rng.integers(0, 200, n).astype(symbol) for n in (gram, 50))
    docs = [np.concatenate([rng.integers(0, 200, rng.integers(20, 60)).astype(symbol), common if i % 2 else passage[i % 9 :], rng.integers(0, 200, 40).astype(symbol)]) for i in range(40)]
    docs += [np.tile(passage[:3], 20), docs[3], passage[5:40], rng.integers(0, 200, 5).astype(symbol)]
    flat, offs = np.concatenate(docs), np.r_[0, np.cumsum([len(d) for d in docs])]
    p = repeats.pieces_of(byte_values(flat) if symbol == np.uint8 else flat, offs, window, gram)
    begin = offs[p["doc"]] + p["start"]
    content = [flat[a : a + n + window - 1].tobytes() for a, n in zip(begin, p["windows"])]
    batch = pa.RecordBatch.from_pydict({"_key": p["doc"], "_start": p["start"].astype(np.int32), "_several": np.zeros(len(begin), bool), "_place": p["anchor"].astype(np.int32), "content": pa.array(content, pa.binary())})
    sorted_units = []

    def find(symbols, bounds, window):
        sorted_units.append(len(symbols))
        return sa.equal_windows(symbols, bounds, window) if symbol == np.uint8 else st.equal_windows(symbols, bounds, window)

    seen, want = {}, set()
    for i, d in enumerate(docs):
        for x in range(len(d) - window + 1):
            seen.setdefault(d[x : x + window].tobytes(), []).append((i, x))
    for starts in seen.values():
        for i, x in starts[1:] if later_only else starts * (len(starts) > 1):
            want |= {(i, u) for u in range(x, x + window)}
    for cuts in (1, 4):
        got = repeats.spans_in_shard([batch.slice(0, 30), batch.slice(30)], window, gram, cuts, symbol, later_only, find).to_pylist()
        assert {(r["_key"], u) for r in got for u in range(r["a"], r["b"])} == want
    assert want and sorted_units[1] < sorted_units[0] / 3


@pytest.mark.parametrize("hot", [None, 1])
def test_remove_later_bytes(spark, hot):
    docs = documents()
    got = sa.remove_later(spark.createDataFrame(docs, "doc_id long, text string"), hot_classes=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute_bytes(docs, sa.WINDOW)


@pytest.mark.parametrize("hot", [None, 1])
def test_remove_repeats_words(spark, hot):
    docs = documents()
    got = st.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), hot_classes=hot).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_words(docs, st.WINDOW)
    by = dict(docs)
    for r in got:
        assert words(r.kept) == words(r.kept) and (r.n_removed or r.kept == by[r.doc_id])
        assert hashlib.sha256(" ".join(words(r.kept)).encode()).hexdigest() == r.kept_sha256


def test_trees_have_the_repeats_as_deep_nodes():
    text = np.array([1, 2, 3, 9, 1, 2, 3, 8, 1, 2, 7])
    bounds = np.array([0, 4, 8, 11])
    tree = st.grow(text, np.repeat(bounds[1:], np.diff(bounds)), np.array([0, 4, 8]), np.zeros(3, np.int64), 1)
    assert sorted(zip(tree.depth.tolist(), tree.parent.tolist())) == [(2, -1), (3, 0)]
    below = {s: tree.depth[a] for s, a in zip(tree.suffix.tolist(), tree.above.tolist())}
    assert below == {0: 3, 4: 3, 8: 2}
    assert sorted(st.repeats_below(tree, 3)[0].tolist()) == [0, 4]


def test_default_shards_split_their_prefixes():
    """A shard of the intended size has more suffixes than a group takes, and prefixes of more than one word."""
    rng = np.random.default_rng(5)
    words = np.minimum(rng.zipf(1.3, 120_000), 5_000).astype(np.uint64)
    depths = [d for d, _, _ in st.prefix_groups(np.unique(words, return_inverse=True)[1].astype(np.int64), np.arange(len(words) - 40), 0, st.GROUP_SUFFIXES, st.WINDOW)]
    assert len(depths) > 3 and max(depths) > 1


@pytest.mark.parametrize("size", [40_000])
def test_names_of_deeper_levels(size):
    """Repeats longer than a name recurse with many names."""
    rng = np.random.default_rng(8)
    part = rng.integers(2, 200, size)
    t = np.r_[part, part[:15_000], part[5_000:9_000], 0].astype(np.int32)
    order = sa.suffix_array(t, 200)
    rank = np.empty(len(t), np.int64)
    rank[order] = np.arange(len(t))
    a, b = order[:-1], order[1:]
    after = np.r_[rank, -1]
    assert ((t[a] < t[b]) | ((t[a] == t[b]) & (after[a + 1] < after[b + 1]))).all() and sorted(order.tolist()) == list(range(len(t)))


def test_small_groups_split_prefixes(monkeypatch):
    monkeypatch.setattr(st, "GROUP_SUFFIXES", 3)
    test_equal_windows(st.equal_windows, np.uint64)


def test_nulls_repeats_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text, 1, "a"), (None, text, 2, "b"), (3, text, 3, "c"), (3, "other", 4, "d"), (4, None, 5, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int, spans string")
    got = st.remove_repeats(df).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(0, 0), (1, 0), (80, 80), (80, 80), (80, 80)]
    later = sa.remove_later(df).collect()
    assert len(later) == 5 and sorted(r.n_removed for r in later)[:3] == [0, 0, 0] and sum(r.n_removed > 0 for r in later) == 2


@pytest.mark.parametrize("window,gram", [(200, 20), (300, 40)])
def test_long_windows(spark, window, gram):
    """Pieces of more windows than seven bits can count."""
    docs = documents()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sa.remove_later(spark.createDataFrame(docs, "doc_id long, text string"), window, gram).collect()}
    assert got == brute_bytes(docs, window) and sum(g[1] for g in got.values()) > 5 * window
    with pytest.raises(ValueError):
        sa.remove_later(spark.createDataFrame(docs, "doc_id long, text string"), 5000, 20)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sa.remove_later(empty).collect() == [] and st.remove_repeats(empty).collect() == []
