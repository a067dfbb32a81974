import collections
import random
import re

import corpus_pipeline as cp
import public_tokenizers
import pyarrow as pa
import pytest
from common_cases import documents, words
from test_models_and_joins import brute_components
from tokenizers import Tokenizer

from fathom.llm import edit_decontamination as ed
from fathom.llm import jaccard_join, suffix_tree
from fathom.llm.common import materialise


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in cp.STAGES:
        out.append(materialise(stage(spark, out[-1], sf)))
    return out


def test_columns_and_shrinking(stages):
    assert [name for name, _ in cp.STAGES] == ["language_id", "near_duplicates", "substring_dedup", "decontamination", "packing"]
    for df in stages[1:-1]:
        assert df.columns == cp.COLUMNS
    counts = [df.count() for df in stages[:-1]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    assert {r.doc_id for r in stages[-1].select("doc_id").distinct().collect()} == {r.doc_id for r in stages[-2].select("doc_id").collect()}


def test_run_against_brute_force(spark, tmp_path):
    """The whole pipeline on a small corpus with labels, copies, repeated passages, benchmark items and odd rows."""
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    items = [(i, " ".join(fresh(20 + i))) for i in range(6)]
    passage = fresh(45)
    texts = [" ".join(fresh(80)) for _ in range(30)]
    for t in texts[:8]:
        w = t.split()
        w[40] = "changed"
        texts.append(" ".join(w))
    texts += [" ".join(fresh(30) + passage + fresh(30)) for _ in range(4)]
    for i, item in items:
        w = item.split()
        del w[3 : 3 + i % 3]
        texts.append(" ".join(fresh(25) + w + (fresh(25) if i % 2 else [])))
    texts += [None, "", "12 34 !!", "one", texts[0], " ".join(passage)]
    rows = [(i, t, "en" if i % 3 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = collections.Counter()
    for r in cp.run(spark, str(tmp_path)).collect():
        got[r.doc_id, r.doc_tokens] += r.length

    left = {i: t for i, t, *_ in rows if t and re.search(r"[^\W\d_]", t)}
    least = brute_components(list(left.items()), 5, 80)
    left = {i: t for i, t in left.items() if least[i][1] == i}
    count = collections.Counter()
    for t in left.values():
        w = words(t)
        count.update(tuple(w[p : p + 35]) for p in range(len(w) - 34))
    for i, t in left.items():
        w = words(t)
        gone = {p + j for p in range(len(w) - 34) if count[tuple(w[p : p + 35])] > 1 for j in range(35)}
        left[i] = " ".join(x for p, x in enumerate(w) if p not in gone)
    symbols, first, _, _ = ed.word_symbols(*ed.text_bytes(pa.array([*left.values(), *(t for _, t in items)])))
    cut = [symbols[a:b] for a, b in zip(first[:-1], first[1:])]
    known = cut[len(left) :]
    clean = {i: t for (i, t), own in zip(list(left.items()), cut) if all(ed.edit_distance(k, own, len(k) // 5)[0] > len(k) // 5 for k in known)}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    size = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in clean.items()}
    assert got == {(i, n): n for i, n in size.items()}
    assert len(left) - len(clean) == 6 and len(clean) < len(texts) - 15


def test_stages_against_operators(stages):
    again = jaccard_join.grouped(stages[2], 5, 80).collect()
    assert all(r.doc_id == r.component_id for r in again)
    before = {r.doc_id: r.text for r in stages[2].collect()}
    removed = {r.doc_id: r.n_removed for r in suffix_tree.remove_repeats(stages[2]).collect()}
    for r in stages[3].collect():
        assert len(words(before[r.doc_id])) - len(words(r.text)) == removed[r.doc_id] and (removed[r.doc_id] or r.text == before[r.doc_id])


@pytest.mark.parametrize("lang", [None, "und"])
def test_unlabelled_documents_stay(spark, sf, lang):
    rows = [(1, "hello there my friend", lang, "s", 21), (2, "bonjour mon ami", lang, "s", 15), (3, None, lang, "s", 0), (4, "12 !!", lang, "s", 5), (None, "ж", lang, "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = cp.language_id_stage(spark, docs, sf)
    assert got.columns == cp.COLUMNS and sorted(map(tuple, got.collect()), key=str) == sorted((rows[0], rows[1], rows[4]), key=str)


def test_null_languages_are_filled(spark, sf):
    rows = [(i, "hello there my friend " * 3, "en", "s", 0) for i in range(20)] + [(30 + i, "bonjour mon ami cher " * 3, "fr", "s", 0) for i in range(20)] + [(90, "bonjour mon cher ami", None, "s", 0), (91, "hello friend", "xx", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id: r.lang for r in cp.language_id_stage(spark, docs, sf).collect() if r.doc_id >= 90} == {90: "fr", 91: "xx"}


def test_odd_documents(spark, sf):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in documents()] + [(None, "null id here", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        docs = materialise(stage(spark, docs, sf))
    assert docs.count() > 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES:
        empty = materialise(stage(spark, empty, sf))
    assert empty.count() == 0
