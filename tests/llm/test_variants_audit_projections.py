"""Operators 11 to 13 against brute force."""

import collections
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from common_cases import documents, lower, words

from fathom.llm import filter_audit as fa
from fathom.llm import sorted_projections as sp
from fathom.llm import spelling_variants as sv


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_pairs(vocabulary):
    return {tuple(sorted(p)) for p in itertools.combinations(vocabulary, 2) if near(*p)}


def brute_variants(n):
    out, form = {}, {}
    for w in n:
        close = [x for x in n if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
        out[w] = (n[w], len(close), form[w], n[form[w]] if form[w] else None)
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] += (root,)
    return out


def some_words(seed, alphabet, count, longest=12):
    rng = random.Random(seed)
    found = {"".join(rng.choice(alphabet) for _ in range(rng.randrange(5, longest))) for _ in range(count)}
    return sorted(found | {"a" * k for k in range(5, 30, 2)} | {"a" * 11, "a" * 3000, "a" * 3001, "b" * 2999 + "é"})


@pytest.mark.parametrize("alphabet", ["ab", "abcdeé÷"])
def test_subtree_walk(alphabet):
    vocabulary = some_words(1, alphabet, 150)
    got = list(sv.subtree_pairs(vocabulary, 0))
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == brute_pairs(vocabulary)


@pytest.mark.parametrize("alphabet,group,band", [("ab", 8, 5), ("abé", 12, 3)])
def test_trie_join(spark, monkeypatch, alphabet, group, band):
    """Hot prefixes go down several bands."""
    monkeypatch.setattr(sv, "GROUP", group)
    monkeypatch.setattr(sv, "BAND", band)
    vocabulary = some_words(2, alphabet, 120)
    got = [(r.a, r.b) for r in sv.near_pairs(spark.createDataFrame([(w,) for w in vocabulary], "word string")).collect()]
    assert len(got) == len(set(got)) and {tuple(sorted(p)) for p in got} == brute_pairs(vocabulary)


def test_variants_of_a_corpus(spark):
    rng = random.Random(4)
    stems = ["houses", "hoûses", "window", "windows", "Winter", "ÿellow×s", "garden"]
    docs = [(i, " ".join(rng.choice(stems) + rng.choice(["", "", "", "s", "é"]) for _ in range(200))) for i in range(40)]
    docs += [(7, docs[7][1]), (None, "houses Houses, HOUSES'houses"), (50, None), (51, ""), (52, "garden" * 30_000)] + [(60 + i, "zzzzz zzzzz-zzzzy aaaaa") for i in range(3)]
    n = collections.Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = lower(w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += len(w) >= 5
    expected = brute_variants({w: c for w, c in n.items() if c >= 3 and len(w) >= 5})
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in docs], "doc_id long, text string, word string, n int")
    rows = sv.variants(sv.vocabulary(df)).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows} == expected and len(rows) == len(expected)
    assert sum(v[2] is not None for v in expected.values()) > 3


def test_chains_of_forms(spark):
    """A form's form, over several rounds; ties go to the smaller word."""
    n = {"aaaaa" + "b" * i: 2**i * 3 for i in range(12)} | {"ccccc": 3, "cccca": 9, "ccccb": 9}
    rows = sv.variants(spark.createDataFrame(list(n.items()), "word string, n long")).collect()
    assert {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows} == brute_variants(n)


def fails(i, text, first):
    w = words(text)
    out = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 2 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    return out + "E" * (i is not None and first is not None and i > first)


def brute_audit(docs, labels):
    first, good, toxic = {}, set(), set()
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, q, t in labels:
        good |= {i} if q == 1 else set()
        toxic |= {i} if t == 1 else set()
    parts = collections.defaultdict(list)
    for i, text, source in docs:
        parts[source or ""].append((fails(i, text or "", first.get(text or "")), i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part, rows in parts.items():
        removed = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            for s, f in enumerate(order):
                gone = lambda m: any(x in m for x in order[:s])  # noqa: E731, B023
                mine = [r for r in rows if f in r[0] and not gone(r[0])]
                removed[f] += len(mine)
                out[part, order, s + 1] = [sum(f not in r[0] and not gone(r[0]) for r in rows), len(mine), sum(f in r[0] and gone(r[0]) for r in rows), sum(r[0] == f for r in rows), sum(r[1] for r in mine), sum(r[2] for r in mine)]
        for (p, order, s), row in out.items():
            if p == part:
                row.append(removed[order[s - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit(spark):
    rng = random.Random(3)
    docs = [(i, t, rng.choice(["x", "y", None, ""])) for i, t in documents()]
    docs += [(300 + i, " ".join(rng.choice(["Up", "low", "a%b", "c|d", "plain"]) + str(rng.randrange(900)) for _ in range(rng.randrange(150, 260))), "z") for i in range(20)]
    docs += [(400, docs[3][1], "x"), (400, docs[3][1], "y"), (None, docs[3][1], "x"), (None, "unique", "x"), (2, docs[3][1], "y")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 320, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, mask int")
    got = fa.audit(fa.labelled(fa.masks(df), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")), "ABCDE").collect()
    expected = brute_audit(docs, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r[x] for x in fa.OUTCOMES) for r in got} == expected and len(got) == len(expected)


def test_matrices():
    columns, by = fa.matrices("ABCDE")
    assert len(columns) == 600 and all(m.shape == (32, 600) and m.dtype == np.int64 for m in by.values())
    assert (by["kept"] + by["removed"] + by["redundant"] <= 1).all()
    assert by["shapley"][31].sum() == 5 * 120 * 120 // 5  # each order removes such a document once


def crowd(rng, base, count, spread):
    x = base + rng.standard_normal((count, len(base))) * spread
    return x / np.linalg.norm(x, axis=1, keepdims=True) * rng.uniform(0.5, 2, (count, 1))


def vectors(dims=32):
    rng = np.random.default_rng(11)
    rows = [(v, rng.integers(0, 3)) for v in rng.standard_normal((600, dims))]
    base = rng.standard_normal((6, dims))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    rows += [(v, 1) for v in crowd(rng, base[0], 150, 0.02)] + [(v, 1) for v in crowd(rng, base[1], 60, 0.024)]
    rows += [(v, 0) for b in base[2:4] for v in crowd(rng, b, 5, 0.02)]
    rows += [(rows[3][0], rows[3][1])] * 40 + [(rows[3][0], None)] * 2 + [(rows[3][0], 9), (rows[3][0][:7], rows[3][1]), (rows[3][0][:7] * 2, rows[3][1])]
    rows += [(None, 1), ([], 1), (np.zeros(dims), 1), ([1.0, None] + [0.0] * (dims - 2), 1), ([float("nan")] * dims, 1), ([float("inf")] * dims, 1)]
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], None if lab is None else int(lab)) for i, (v, lab) in enumerate(rows)]


def brute_links(rows):
    good = {i: np.array(v) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    label = {i: (lab, len(v or [])) for i, v, lab in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in good.items()}
    return {(i, j) for i, j in itertools.combinations(sorted(good), 2) if label[i] == label[j] and unit[i] @ unit[j] >= 0.98}


def components_of(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in links:
        i, j = find(i), find(j)
        root[max(i, j)] = min(i, j)
    return {i: find(i) for i in ids}


def test_sorted_projections(spark):
    rows = vectors()
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, label int, key int").repartition(7)
    got = {r.vec_id: r for r in sp.near_duplicates(df).collect()}
    links = brute_links(rows)
    degree = collections.Counter(itertools.chain(*links))
    assert len(got) == len(rows) and all(got[i].n_links <= degree[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.99 * 2 * len(links)
    expected = components_of(got, links)
    assert sum(got[i].component_id == expected[i] for i in got) >= 0.99 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert max(degree.values()) > 2 * sp.WINDOW


def test_crowds_in_blocks(spark, monkeypatch):
    """Small blocks: crowds and sorted runs cross their borders; counts are whole."""
    rows = vectors()[600:900]
    want = collections.Counter(itertools.chain(*brute_links(rows)))
    monkeypatch.setattr(sp, "WINDOW", 4)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in sp.near_duplicates(df).collect()}
    assert sum(got.values()) >= 0.98 * sum(want.values()) and all(got[i] <= want[i] for i in got)


def test_repeated_ids_and_empty_table(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v, 1), (5, v, 1), (None, [2.0, 4.0, 6.0], 1), (7, v, 2), (None, None, None)]
    got = sp.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in got) == [(-1, 0, -1, True), (-1, 2, -1, True), (5, 2, -1, False), (5, 2, -1, False), (7, 0, 7, True)]
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>, label int")
    assert sp.near_duplicates(empty).collect() == []
    assert fa.audit(fa.labelled(fa.masks(spark.createDataFrame([], "doc_id long, text string, source string")), spark.createDataFrame([], "doc_id long, quality int, toxic int")), "ABCDE").collect() == []
    assert sv.variants(sv.vocabulary(spark.createDataFrame([], "doc_id long, text string"))).collect() == []


def test_passes_grow_slowly():
    assert sp.passes(50, 0.98) <= sp.passes(10**4, 0.98) <= sp.passes(10**9, 0.98) < 30
