import collections
import functools
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from common_cases import documents, lower, sentence, words
from pyspark.sql import functions as F

from fathom.llm import components as cc
from fathom.llm import context_tree as ct
from fathom.llm import edit_decontamination as ed
from fathom.llm import hamming_index as hi
from fathom.llm import jaccard_join as jj
from fathom.llm import language_id as li
from fathom.llm.queries import QUERIES


# --- language ID ---------------------------------------------------------------------------------------------------


def test_language_id_on_held_out_rows(spark, sf):
    got = QUERIES["op7_hierarchical_langid"](spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas().set_index("doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in got.index)
    held = got[got.held_out]
    assert (held.lang_pred == docs.lang[held.index]).mean() > 0.97


def test_language_id_odd_rows(spark):
    rows = [(1, "hello there my friend", "en"), (2, "bonjour mon ami cher", "fr"), (3, "hallo mein lieber freund", "de"), (4, None, "en"), (5, "12 !!", "en"), (6, "ж", None), (None, "hola mi buen amigo", "es"), (7, "", "xx")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = li.fit(df.select("text", "lang", F.col("doc_id").alias("key")))
    assert model.languages == ["de", "en", "es", "fr"] and model.families == ["germanic", "romance"]
    out = li.predict(df, model).collect()
    assert len(out) == 24 and all((r.lang_pred == "und") == (r.text in (None, "12 !!", "")) for r in out)
    assert li.fit(df.limit(0).select("text", "lang", F.col("doc_id").alias("key"))) is None
    assert {r.lang_pred for r in li.predict(df, None).collect()} == {"und"} and li.predict(df.limit(0), model).count() == 0
    three = li.fit(df.select("text", "lang", F.col("doc_id").alias("key")), {})
    assert len(three.families) == 4 and li.predict(df, three).count() == 24


def test_language_id_with_many_languages(spark, monkeypatch):
    """Every value is learned, the sample stays bounded, and too many values are refused."""
    monkeypatch.setattr(li, "SAMPLE_ROWS", 600)
    rng = random.Random(4)
    stems = {f"l{i}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(8)] for i in range(24)}
    rows = [(" ".join(rng.choice(s) for _ in range(40)), lang, i) for lang, s in stems.items() for i in range(30)]
    df = spark.createDataFrame(rows, "text string, lang string, key long")
    model = li.fit(df)
    assert model.languages == sorted(stems)
    got = li.predict(df.select("text", "lang"), model).collect()
    assert sum(r.lang_pred == r.lang for r in got) > 0.9 * len(got)
    monkeypatch.setattr(li, "MAX_LANGUAGES", 23)
    with pytest.raises(ValueError):
        li.fit(df)


@pytest.mark.parametrize("key", [None, 5])
def test_language_id_sample_with_one_key(spark, monkeypatch, key):
    """Rows that share a key, or a key and a text, neither flood the sample nor leave it empty."""
    monkeypatch.setattr(li, "SAMPLE_PER_LANGUAGE", 20)
    held = []
    learn = li.linear_svm
    monkeypatch.setattr(li, "linear_svm", lambda x, y: held.append(len(x)) or learn(x, y))
    rows = [(f"{w} {'x' * (i % 300)}", lang, key) for i in range(600) for w, lang in (("hello friend", "en"), ("bonjour ami", "fr"))]
    model = li.fit(spark.createDataFrame(rows, "text string, lang string, key long"))
    assert model.languages == ["en", "fr"] and held == [40]


# --- nearest neighbours --------------------------------------------------------------------------------------------


def brute_nearest(ids, x, queries, k):
    n = np.sqrt((x * x).sum(1))
    for q in queries:
        c = (x * x[q]).sum(1) / (n * n[q])
        c[ids == ids[q]] = -9
        order = np.lexsort((ids, -c))[:k]
        yield ids[q], ids[order], c[order]


def test_recall(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 24))
    x = (centres[rng.integers(0, 12, 1500)] + 0.7 * rng.standard_normal((1500, 24))).astype(np.float32)
    x[500:700] = x[0] + 0.01 * rng.standard_normal((200, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = hi.search(df, "vec_id", "embedding", lambda i: i % 50 == 0).toPandas()
    hit = total = 0
    for q, near, cosine in brute_nearest(np.arange(1500), x.astype(np.float64), range(0, 1500, 50), 5):
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        true = dict(zip(near.tolist(), cosine))
        assert all(abs(true[v] - s) < 1e-12 for v, s in zip(mine.vec_id, mine.score) if v in true)
        hit, total = hit + len(set(mine.vec_id) & set(near.tolist())), total + 5
    assert hit / total >= 0.9


def test_exact_rest_and_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (9, []), (None, [1.0, 1.0]), (50, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hi.search(df, "vec_id", "embedding", lambda i: i % 50 == 0, radius=0).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in got)[:3] == [(0, 1, 1), (0, 2, 2), (0, 3, 50)]
    assert len(got) == 6
    assert hi.search(df.limit(0), "vec_id", "embedding", lambda i: i % 50 == 0).collect() == []


def test_repeated_ids(spark):
    """Rows that share an id are queries of their own and find each other."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0])]
    got = hi.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("clash")), "vec_id", "embedding", lambda i: i % 50 == 0, k=3).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 0), (3, 0)] and {r.query_id for r in got} == {0}


def test_pigeonhole():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    for radius in (0, 5, 11, 23):
        flips = np.zeros(4000, np.uint64)
        for i in range(4000):
            for b in rng.choice(64, radius, replace=False):
                flips[i] |= np.uint64(1) << np.uint64(b)
        found = np.zeros(4000, bool)
        for j, r in enumerate(hi.radii(radius)):
            if r >= 0:
                found |= np.bitwise_count(flips >> np.uint64(hi.WIDTH * j) & np.uint64((1 << hi.WIDTH) - 1)) <= r
        assert found.all() and a.size


# --- decontamination -----------------------------------------------------------------------------------------------


def edit(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(300):
        a, t = [rng.randrange(5) for _ in range(rng.randrange(1, 12))], [rng.randrange(5) for _ in range(rng.randrange(25))]
        d, start, end = ed.edit_distance(np.array(a, np.uint64), np.array(t, np.uint64), 99)
        assert d == edit(a, t) and 0 <= start <= end <= len(t)


@pytest.mark.parametrize("share,recall", [(0.0, 1.0), (0.1, 0.99), (0.2, 0.93)])
def test_planted_items(spark, share, recall):
    rng = random.Random(int(share * 100))
    items = [(i, sentence(rng, rng.randrange(12, 60), 10**6)) for i in range(120)]
    docs = []
    for i, text in items:
        w = text.split()
        for _ in range(int(share * len(w))):
            p = rng.randrange(len(w))
            w[p : p + rng.randrange(2)] = [f"new{rng.randrange(10**6)}"][: rng.randrange(2)] or ["z"]
        docs.append((i, sentence(rng, 50, 10**6) + "\n" + re.sub("[a-z]", lambda m: m[0].upper(), " ".join(w)) + ". " + sentence(rng, 30, 10**6)))
    docs += [(1000 + i, sentence(rng, 200, 10**6)) for i in range(60)] + [(2000, None), (2001, "")]
    bench = spark.createDataFrame([*items, (500, None), (501, ""), (502, "too short")], "item_id long, text string")
    got = ed.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in got}
    assert sum((i, i) in pairs for i in range(120)) / 120 >= recall
    assert all(d == i for d, i in pairs)
    by = dict(docs)
    for r in got:
        span = by[r.doc_id].encode()[r.first_byte : r.end_byte].decode()
        assert r.distance <= ed.edits_allowed(r.item_words, ed.SIMILARITY) and span


@pytest.mark.parametrize("before", [0, 40])
def test_items_at_the_end_of_documents(spark, before):
    """Copies with words missing, as whole documents and as the last words of one."""
    rng = random.Random(before)
    items = [(i, sentence(rng, 8 + i, 10**6)) for i in range(50)]
    docs, deleted = [], {}
    for i, text in items:
        n = len(text.split())
        for kind, count in enumerate((1, 1, max(1, n // 10), n // 5)):
            w = text.split()
            for _ in range(count):
                del w[-1 if kind == 0 else rng.randrange(len(w))]
            docs.append((10 * i + kind, (sentence(rng, before, 10**6) + " " + " ".join(w)).strip()))
            deleted[10 * i + kind] = count
    schema = "doc_id long, text string"
    got = ed.contaminated(spark.createDataFrame(docs, schema), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert all(r.doc_id // 10 == r.item_id and r.distance <= deleted[r.doc_id] for r in got)
    assert len(got) == len(docs)


def edited(item, edits, rng):
    out = list(item)
    for _ in range(edits):
        kind, at = rng.choice("rdi"), rng.randrange(max(1, len(out)))
        if kind == "r" and out:
            out[at] = f"y{rng.randrange(10**6)}"
        elif kind == "d" and len(out) > 1:
            del out[at]
        else:
            out.insert(at, f"y{rng.randrange(10**6)}")
    return out


def test_found_pairs_against_brute_force(spark):
    """Whole documents: copies with up to the allowed edits at the start, in the middle, at the end and alone, of items of 1 to 60 words.
    Every pair that the edit distance accepts, compared with every item, is expected."""
    rng = random.Random(12)
    items = [[f"i{n}x{rng.randrange(40)}" for _ in range(n)] for n in range(1, 61)]
    docs, kind = [], {}
    for n, item in enumerate(items, 1):
        for place in ("start", "middle", "end", "whole"):
            for share in (0.0, 0.1, 0.2):
                copy = edited(item, int(ed.edits_allowed(n, ed.SIMILARITY) * share / 0.2), rng)
                pad = lambda: [f"z{rng.randrange(10**6)}" for _ in range(15)]
                kind[len(docs)] = (place, share)
                docs.append(" ".join((pad() if place in ("middle", "end") else []) + copy + (pad() if place in ("start", "middle") else [])))
    columns = "doc_id long, text string, item_id int"
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(docs)], columns)
    bench = spark.createDataFrame([(n if n != 30 else None, " ".join(item), "x") for n, item in enumerate(items)], "item_id long, text string, doc_id string")
    got = {(r.doc_id, 30 if r.item_id is None else r.item_id) for r in ed.contaminated(df, bench).collect()}
    symbols, first, _, _ = ed.word_symbols(*ed.text_bytes(pa.array(docs + [" ".join(i) for i in items])))
    cut = [symbols[a:b] for a, b in zip(first[:-1], first[1:])]
    true = set()
    for d in range(len(docs)):
        for i in range(len(items)):
            most = int(ed.edits_allowed(i + 1, ed.SIMILARITY))
            if np.isin(cut[d], cut[len(docs) + i]).any() and ed.edit_distance(cut[len(docs) + i], cut[d], most)[0] <= most:
                true.add((d, i))
    assert got <= true
    for place in ("start", "middle", "end", "whole"):
        for share in (0.0, 0.1, 0.2):
            mine = {p for p in true if kind[p[0]] == (place, share)}
            assert len(mine) >= 55 and len(mine & got) >= 0.95 * len(mine), (place, share, len(mine & got), len(mine))


def test_short_items():
    """Items of any length, against the exact edit distance; documents are searched together."""
    rng = random.Random(4)
    items = [(i, " ".join(rng.choice("abcdefgh") for _ in range(1 + i % 7))) for i in range(42)]
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(12))) for _ in range(300)]
    index = ed.build_index([*items, (99, ""), (98, None), (97, "...")], ed.SIMILARITY)
    symbols, first, _, _ = ed.word_symbols(*ed.text_bytes(pa.array(texts)))
    got = {(d, index.ids[i]): rest for d, i, *rest in ed.matches(index, symbols, first)}
    want = {(d, i): e for d, t in enumerate(texts) for i, w in items if (e := edit(w.split(), t.split())) <= ed.edits_allowed(len(w.split()), ed.SIMILARITY)}
    assert {k: v[0] for k, v in got.items()} == want and len(want) > 500
    assert {d for d, _ in want} <= set(ed.hopeful(index, symbols, first).tolist())
    for (d, i), (distance, a, b) in got.items():
        assert edit(dict(items)[i].split(), texts[d].split()[a:b]) == distance


def test_short_items_and_scripts_without_spaces(spark):
    items = [(1, "Who wrote it?"), (2, "世界上最长的河流是哪一条？"), (3, "北京"), (4, "what is the capital of france"), (5, "ประเทศไทย"), (6, "yes")]
    docs = [(1, "so, who wrote it then"), (2, "问：世界上最长的河流，是哪条？ok"), (3, "我住在北京。"), (4, "What is the big capital of France!"), (5, "อยู่ในประเทศไทยนะ"), (6, "Yes"), (7, "北 who wrote x 世界"), (8, None), (9, "")]
    got = ed.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(1, 1, 0), (2, 2, 1), (3, 3, 0), (4, 4, 1), (5, 5, 0), (6, 6, 0)]
    spans = {r.doc_id: dict(docs)[r.doc_id].encode()[r.first_byte : r.end_byte].decode() for r in got}
    assert spans[1] == "who wrote it" and spans[2] == "世界上最长的河流，是哪条" and spans[3] == "北京" and spans[5] == "ประเทศไทย"


def test_decontamination_empty(spark):
    docs, bench = spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert ed.contaminated(docs, bench).collect() == [] and ed.contaminated(docs.limit(0), bench).collect() == []


# --- Jaccard join --------------------------------------------------------------------------------------------------


def brute_components(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = words(lower(t))
        sets[i] = frozenset(tuple(w[p : p + k]) for p in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k,percent,block", [(3, 90, 2048), (5, 80, 8)])
def test_components_of_links(spark, monkeypatch, k, percent, block):
    monkeypatch.setattr(jj, "LIST_BLOCK", block)
    rng = random.Random(k)
    seeds = [[f"w{rng.randrange(300)}" for _ in range(rng.randrange(20, 90))] for _ in range(6)]
    docs = documents()
    for i in range(250):
        w = list(rng.choice(seeds))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 3, 5))):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs.append((1000 + i, " ".join((["hot"] * 3 if i % 2 else []) + w)))
    got = jj.grouped(spark.createDataFrame(docs, "doc_id long, text string"), k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, k, percent)


def test_join_odd_tables(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text, 1), (5, text, 2), (5, text, 3), (6, None, 4), (7, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.grouped(df).collect()), key=str)
    assert got == sorted([(None, 28, None), (5, 28, None), (5, 28, None), (6, 0, 6), (7, 0, 7)], key=str)
    kept = jj.one_of_each(df)
    assert kept.columns == df.columns and sorted(r[2] for r in kept.collect())[1:] == [4, 5] and kept.count() == 3
    assert jj.grouped(df.limit(0)).collect() == []


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, int(n)).astype(np.uint64)) for n in (1, 5, 100, 129, 700, 3000)]
    sets += [np.union1d(sets[4][:600], sets[5][:50]), sets[5][7:]]
    maps = jj.Bitmaps(pa.array([jj.bitmap(s) for s in sets], pa.binary()))
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    true = np.array([len(np.setxor1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    found = maps.apart(i, j)
    assert (found <= true).all() and (found[i == j] == 0).all() and (found >= true / 100).all()


@pytest.mark.parametrize("a_task", [500_000, 40])
def test_connected_components(spark, monkeypatch, a_task):
    monkeypatch.setattr(cc, "EDGES_A_TASK", a_task)
    rng = random.Random(9)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(200)] + [(7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "a long, b long").repartition(4)).collect()}
    lone = {x for x in parent if root(x) == x and sum(root(y) == x for y in parent) == 1}
    assert got == {x: root(x) for x in parent if x not in lone}


# --- language model ------------------------------------------------------------------------------------------------


def coded(text):
    return " ".join(words(lower(text))).encode() + b"\n"


def brute_ctw(docs, depth):
    nodes, children = collections.defaultdict(lambda: [0, 0]), collections.defaultdict(set)

    def steps(text):
        b = b"\n" * depth + coded(text)
        for j in range(depth, len(b)):
            for k in range(8):
                yield b[j - depth : j], 1 << k | b[j] >> 8 - k, b[j] >> 7 - k & 1

    for _, text, train in docs:
        if train:
            for context, node, bit in steps(text):
                for d in range(depth + 1):
                    nodes[context[depth - d :], node][bit] += 1
                    if d:
                        children[context[depth - d + 1 :], node].add((context[depth - d :], node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    @functools.cache
    def weighted(key):
        own = kt(*nodes.get(key, (0, 0)))
        return own if len(key[0]) == depth else np.logaddexp(own, sum(map(weighted, children.get(key, ())))) + math.log(0.5)

    def probability(context, node, bit, d=0):
        key = (context[depth - d :], node)
        n = nodes.get(key, (0, 0))
        here = (n[bit] + 0.5) / (sum(n) + 1)
        if d == depth:
            return here
        stop = math.exp(math.log(0.5) + kt(*n) - weighted(key))
        return stop * here + (1 - stop) * probability(context, node, bit, d + 1)

    return {i: sum(math.log10(probability(*s)) for s in steps(text)) for i, text, _ in docs}


@pytest.mark.parametrize("depth", [2, 5])
def test_context_tree_weighting(spark, monkeypatch, depth):
    """In blocks of few bytes; of depth 2 with pages summed up in groups of 2, in several rounds."""
    monkeypatch.setattr(ct, "BLOCK_BYTES", 300)
    if depth == 2:
        monkeypatch.setattr(ct, "MERGED", 2)
    docs = [(i, (t or "")[:90] if t is not None else None, i % 5 != 0) for i, t in documents()[:30]] + [(200, None, True), (201, "", False), (202, " ", True)]
    got = {r.doc_id: r for r in ct.score_documents(spark.createDataFrame(docs, "doc_id long, text string, train boolean"), depth).collect()}
    expected = brute_ctw(docs, depth)
    assert all(abs(got[i].score - s) < 1e-6 * max(1, abs(s)) for i, s in expected.items())
    count = collections.Counter(w for _, t, train in docs if train for w in [*words(lower(t)), None])
    n, v = sum(count.values()), len(count)
    for i, t, _ in docs:
        w = [*words(lower(t)), None]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert abs(got[i].base_score - sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)) < 1e-8


def test_probabilities_sum_to_one():
    grams = np.array([97 << 40 | 98 << 32 | 99 << 24 | 97 << 16 | 98 << 8 | y for y in range(256)], np.uint64)
    counts = np.zeros(256, np.int64)
    counts[[97, 98, 200]] = (5, 2, 1)
    s = ct.shallow_sums(grams, counts, 5)
    p = 10 ** ct.log10_probability(grams, counts, 5, ct.Shallow(s["node"], s["n0"], s["n1"], s["below"]))
    assert abs(p.sum() - 1) < 1e-9 and p[97] > p[98] > p[5]


def test_scoring_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b", True), (1, "a b", True), (1, "a b", True), (2, "a c", False)], "doc_id long, text string, train boolean")
    assert ct.score_documents(df).count() == 4
    none = ct.score_documents(df.withColumn("train", F.lit(False))).collect()
    assert all(r.train_tokens == 0 and r.base_score == 0 and abs(r.score + r.n_coded * 8 * math.log10(2)) < 1e-6 for r in none)
    assert ct.score_documents(df.limit(0)).collect() == []


def votes_by_hand(model, text):
    """A text's language by plain loops: every trigram's weights, the family, then the votes of its pairs."""
    raw = re.sub("[A-Z]", lambda m: m[0].lower(), text).encode()
    raw = bytes(32 if 9 <= c <= 13 else c for c in b" " + raw + b" ")
    margins = [float(b) for b in model.bias]
    grams = [li._FIRST[raw[i]] ^ li._SECOND[raw[i + 1]] ^ li._THIRD[raw[i + 2]] for i in range(len(raw) - 2)]
    for k in range(len(margins)):
        margins[k] += sum(float(model.weights[g, k]) for g in grams) / max(1, len(grams))
    sure = [1 / (1 + math.exp(-float(s) * m)) for s, m in zip(model.slope, margins)]
    families = len(model.families)
    if families == 1:
        family, trust, used = 0, 1.0, 0
    elif families == 2:
        family, trust, used = int(sure[0] < 0.5), max(sure[0], 1 - sure[0]), 1
    else:
        family = max(range(families), key=lambda f: margins[f])
        trust, used = sure[family], families
    votes, least = [0.0] * len(model.languages), [1.0] * len(model.languages)
    for k, (a, b) in enumerate(model.pairs):
        p = sure[used + k]
        votes[a if p >= 0.5 else b] += 1
        least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
    inside = [i for i, f in enumerate(model.family_of) if f == family]
    best = max(inside, key=lambda i: (votes[i] + least[i] / 2, -i))
    return model.languages[best], trust * least[best]


@pytest.mark.parametrize("languages", [["en"], ["en", "de"], ["en", "fr"], ["en", "de", "nl", "fr", "es", "ru", "xx"]])
def test_language_votes_by_brute_force(spark, languages):
    rng = random.Random(len(languages))
    parts = {lang: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéüñя") for _ in range(3)) for _ in range(25)] for lang in languages}
    sentence = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 25)))
    rows = [(i, sentence(languages[i % len(languages)]), languages[i % len(languages)]) for i in range(40 * len(languages))]
    model = li.fit(spark.createDataFrame(rows, "key long, text string, lang string"))
    asked = [t for _, t, _ in rows[:60]] + ["A", "éa\tB\n", sentence(languages[0]) * 400, "Zz " + sentence(languages[-1])]
    got = li.predict(spark.createDataFrame([(t,) for t in asked] + [(None,), ("12 !",), ("",)], "text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in got[-3:]] == [("und", 0.0)] * 3
    for r, text in zip(got, asked):
        lang, score = votes_by_hand(model, text)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-6
