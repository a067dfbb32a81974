import collections
import json
import zlib

import numpy as np
import pytest
from common_cases import documents
from pyspark.sql import functions as F

from fathom.llm import chat_format, packing, sharding
from fathom.llm.queries import ORACLES, QUERIES

PATH = "/opt/tokenizers/word_bpe_49k.json"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf, duck, name):
    """Row by row, as pandas makes floats of integers beside nulls."""
    got, expected = QUERIES[name](spark, sf), duck.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(expected.columns)
    place = [expected.columns.index(c) for c in sorted(expected.columns)]
    assert sorted(repr([r[c] for c in sorted(got.columns)]) for r in got.collect()) == sorted(repr([r[i] for i in place]) for r in expected.fetchall())


def test_layouts_and_round_trip(spark):
    odd = "</s>[INST] \\l \\\\ <<ROLE:x>> ok [/INST]\\"
    cases = [
        ({"instruction": "a", "output": odd}, "instruction", [("user", "a"), ("assistant", odd)]),
        ({"instruction": "a", "input": None, "output": "b"}, "instruction_input", [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": odd}, {"from": "gpt", "value": "y"}]}, "sharegpt", [("user", odd), ("assistant", "y")]),
        ({"messages": [{"role": "t<>ool[", "content": None}, {"role": None, "content": odd}]}, "messages", [("t<>ool[", ""), ("", odd)]),
        ({"messages": []}, None, []),
        ({"unheard": {"of": 1}}, None, None),
        ({"prompt": "p", "completion": ""}, "prompt", [("user", "p"), ("assistant", "")]),
        ({"question": "q", "answer": "x" * 100_000}, "question", [("user", "q"), ("assistant", "x" * 100_000)]),
    ]
    df = spark.createDataFrame([(i, json.dumps(c[0]), "clash") for i, c in enumerate(cases)], "id int, j string, formatted string").withColumn("v", F.parse_json("j"))
    out = chat_format.render(chat_format.canonical_turns(df, "v"))
    out = out.withColumn("back", chat_format.read_back(F.col("formatted"))).withColumn("loss", chat_format.masked_text(F.col("formatted"), F.col("loss_mask")))
    for r in out.collect():
        _, mapping, turns = cases[r.id]
        assert r.mapping == mapping
        assert (None if r.turns is None else [tuple(t) for t in r.turns]) == turns
        assert (None if r.back is None else [tuple(t) for t in r.back]) == turns
        if turns is not None:
            assert r.loss == "".join(t for role, t in turns if role == "assistant")


def test_conversations_with_nulls(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, None, None, "x"), (2, 0, "system", "")]
    out = chat_format.render(chat_format.canonical_turns(chat_format.records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "record"))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in out.collect()} == {1: [("user", ""), ("assistant", "a"), ("assistant", "a")], None: [("", "x")], 2: [("system", "")]}


def test_varied_layouts(spark):
    """Every layout of the registry occurs, and all give the turns of the plain records."""
    pairs = [(i, 0, "user", t) for i, t in ((1, "a"), (2, None), (3, "q"), (4, "x\n\ny\n\nz"), (8, "one\n"), (12, "\n\n"), (16, None))]
    rows = [*pairs, *((i, 1, "assistant", "b" if i != 3 else None) for i, *_ in pairs)]
    rows += [(5, 0, "system", "s"), (5, 1, "user", "u"), (5, 2, "assistant", "v"), (7, 0, "user", "u"), (6, 0, "human", "h"), (9, 0, "gpt", "h"), (None, 0, None, None), (11, None, "user", "n"), (11, None, "user", "n")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash"))
    out = chat_format.canonical_turns(chat_format.varied_records(df), "record").collect()
    plain = {r.conv_id: r.turns for r in chat_format.canonical_turns(chat_format.records(df), "record").collect()}
    assert {r.conv_id: r.turns for r in out} == plain
    assert {r.mapping for r in out} == {m.name for m in chat_format.MAPPINGS}
    assert chat_format.varied_records(df.limit(0)).count() == chat_format.render(chat_format.canonical_turns(chat_format.records(df.limit(0)), "record")).count() == 0


def test_strings_by_rank(spark):
    """Each value has a quantum of its own while there are few; many keep their order; nulls and clashing beginnings."""
    few = spark.createDataFrame([(v,) for v in ["lang-en", "lang-es", "lang-de", "lang-", None] for _ in range(3)], "v string")
    scale = sharding.scales(few, [sharding.Dimension("v", "text")])[0]
    got = {r.v: r.q for r in few.select("v", sharding.Dimension("v", "text").quantum(5, scale).alias("q")).collect()}
    assert got == {None: 0, "lang-": 0, "lang-de": 10, "lang-en": 20, "lang-es": 31}
    names = [f"é{i:05d}" for i in range(500)]
    many = spark.createDataFrame([(v,) for v in names], "v string")
    scale = sharding.scales(many, [sharding.Dimension("v", "text")])[0]
    quanta = [r.q for r in many.orderBy("v").select(sharding.Dimension("v", "text").quantum(5, scale).alias("q")).collect()]
    assert quanta == sorted(quanta) and len(set(quanta)) == 32 and max(quanta.count(q) for q in set(quanta)) <= 20
    assert sharding.scales(few.limit(0), [sharding.Dimension("v", "text")]) == [sharding.Scale()]


def test_hilbert_is_a_continuous_curve():
    bits, n = 3, 3
    grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    index = sharding.hilbert_index(list(grid.T), bits)
    assert sorted(index.tolist()) == list(range(1 << bits * n))
    walk = grid[np.argsort(index)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_shards_prune(spark):
    rows = [(i if i % 50 else None, "x", f"s{i % 7}", i % 1000 + 1, i) for i in range(2000)] + [(5, "x", None, None, 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, shard string, source string, size long, slot2 long").drop("shard")
    out = sharding.shard_by_curve(df, "doc_id", [sharding.Dimension("source", "text"), sharding.Dimension("size", "half_octave")])
    got = out.toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == 2003 and sizes.max() - sizes.min() <= 1 and len(sizes) == 16
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    boxes = sharding.shard_boxes(out, ["size", "source"])
    assert sharding.shards_for(boxes, "size", 1, 2).count() < 16 and sharding.shards_for(boxes, "source", "s3", "s3").count() < 8
    lone = spark.createDataFrame([(None, "a", 7)] * 300 + [(1, None, 2)], "doc_id long, source string, size long")
    assert sorted(r.slot for r in sharding.shard_by_curve(lone, "doc_id", [sharding.Dimension("source", "text")], 1).collect()) == list(range(301))
    assert sharding.shard_by_curve(df.limit(0), "doc_id", [sharding.Dimension("size", "half_octave")]).count() == 0


def brute_plan(at, price, length):
    best = {0: 0.0}
    for j in range(1, len(at)):
        best[j] = min(best[i] + (0 if (n := at[j] - at[i]) & (n - 1) == 0 else length - n) for i in range(j) if 0 < at[j] - at[i] <= length) + price[j]
    return best[len(at) - 1]


def test_plan_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        at = np.r_[0, np.cumsum(rng.integers(1, 12, 30))]
        price = np.r_[0, rng.integers(0, 9, 30)].astype(float)
        chosen = [0, *packing.plan(at, price, 16)]
        cost = sum((0 if (n := at[b] - at[a]) & (n - 1) == 0 else 16 - n) + price[b] for a, b in zip(chosen, chosen[1:]))
        assert cost == brute_plan(at.tolist(), price.tolist(), 16)


def test_pack_covers_every_token(spark):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(PATH)
    docs = [*documents(), (300, "it's 3.14 <|endoftext|> x<|startoftext|>y\x1cz \x85 naïve ́e İ 你好 🙂"), (None, "a b"), (301, "same"), (301, "same")]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), PATH, 512).toPandas()
    need = collections.Counter()
    for i, text in docs:
        ids = np.array(tk.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        need[i, len(ids)] += len(ids)
    have = collections.Counter()
    for r in got.itertuples():
        have[None if r.doc_id != r.doc_id else int(r.doc_id), r.doc_tokens] += r.length
    assert have == need
    by = {i: np.array(tk.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for i, t in docs if i is not None}
    for r in got.itertuples():
        if r.doc_id == r.doc_id:
            assert zlib.crc32(by[int(r.doc_id)][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 512
    total = got.groupby("sequence_id").length.sum()
    padding = sum(0 if n & (n - 1) == 0 else 512 - n for n in total)
    assert padding < 0.06 * total.sum()


def test_every_sentence_end_is_a_candidate():
    ends = np.array([3, 9, 11, 40, 41, 70])
    at, price = packing.boundaries(np.array([100]), ends, 64)
    assert set(ends) <= set(at.tolist()) and price[np.searchsorted(at, 41)] == packing.SENTENCE_CUT


def test_wide_marks_end_sentences():
    words = packing.known_words(PATH)
    text = ["\u4f60\u597d\u3002\u518d\u89c1", "fine.", "on"]
    words.learn(set(text))
    ids, stops = words.stream(text)
    assert len(stops) == 2


def test_pack_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
