"""Spelling variants: words at distance one, found by a self-join of the vocabulary's trie.

Every node of the trie has a set of active nodes: the other nodes at edit distance one from it. For a node they are its siblings (one code point
replaced), its children (one inserted), and what the active nodes of its parent have below the same code point; pairs are
kept in one direction only, from the shorter or smaller node. The sets go down the trie level by level, as joins of DataFrames, to
depth BAND. There two things are left. A pair of different nodes has spent its distance, so that the words below them are near only if what
follows is the same: one look-up for each word and active node. The words below one and the same node still have the whole distance: these
prefix groups are dealt to tasks, which walk each group's subtree with its active sets in the same way. A prefix with more than
GROUP words goes down another BAND of levels instead, and so on, until its groups fit.

Defined results: a null id counts as an empty one; null and empty texts have no words; words of any length; ties of the most frequent
near word go to the smallest in code-point order; repeated rows count each; an empty table gives an empty result; further columns are not
looked at.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table
from .sql_text import crc32

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"
#: Levels of the trie that one round of joins goes down.
BAND = 5
#: Words of a prefix group that one task walks at a time.
GROUP = 2_000
PAIRS = "a string, b string"


def vocabulary(docs: DataFrame, least_length: int = 5, least_count: int = 3, every: int = 97) -> DataFrame:
    """docs (doc_id, text) -> (word, n). One run in `every` loses a code point, by a hash of its document and itself."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("w"))
    runs = runs.filter(F.char_length("w") >= least_length).withColumn("w", F.translate("w", UPPER, LOWER))
    hashed = runs.withColumn("h", F.crc32(F.concat_ws(":", "d", "w"))).withColumn("p", (F.col("h") % F.char_length("w")).cast("int"))
    word = F.when(F.col("h") % every == 0, F.expr("concat(left(w, p), substr(w, p + 2))")).otherwise(F.col("w"))
    return hashed.select(word.alias("word")).filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _head(word: str, length: int) -> Column:
    return F.substring(F.col(word), 1, length)


def active_sets(words: DataFrame, low: int, high: int) -> tuple[DataFrame, DataFrame]:
    """words (word), every prefix of `low` code points being a root of its own -> (pairs of words found on the way; the active sets (node, active) at depth `high`,
    without nodes below the node itself)."""
    lengths = F.sequence(F.lit(low + 1), F.least(F.char_length("word"), F.lit(high + 1)))
    nodes = words.filter(F.char_length("word") > low).select("word", F.explode(lengths).alias("depth")).select(F.expr("left(word, depth)").alias("node"), "depth").distinct()
    nodes = materialise(nodes.select("node", F.expr("left(node, depth - 1)").alias("parent"), F.expr("right(node, 1)").alias("last"), "depth"))
    child, other = nodes.select("node", "parent", "last", "depth"), nodes.select(F.col("node").alias("active"), F.col("parent").alias("above"), F.col("last").alias("same"), F.col("depth").alias("below"))
    below = lambda depth: other.filter(F.col("below") == depth + 1).select(F.col("above").alias("node"), "active")
    sets, found = below(low), None
    for depth in range(low, high):
        ended = _ends(words, sets)
        found = ended if found is None else found.unionByName(ended)
        here = child.filter(F.col("depth") == depth + 1)
        further = sets.withColumnsRenamed({"node": "parent", "active": "above"}).join(here, "parent").join(other.withColumnRenamed("same", "last"), ["above", "last"]).select("node", "active")
        beside = here.join(other.filter(F.col("below") == depth + 1), (F.col("parent") == F.col("above")) & (F.col("last") < F.col("same"))).select("node", "active")
        sets = further.unionByName(beside)
        if depth + 1 < high:
            sets = sets.unionByName(below(depth + 1))
        sets = materialise(sets.distinct())
    return found, sets.filter(~F.col("active").startswith(F.col("node")))


def _ends(words: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs of a node and an active node that are both words."""
    return sets.join(words.select(F.col("word").alias("node")), "node", "left_semi").join(words.select(F.col("word").alias("active")), "active", "left_semi").select(F.col("node").alias("a"), F.col("active").alias("b"))


def subtree_pairs(words: list[str], depth: int) -> Iterator[tuple[str, str]]:
    """Pairs at distance one of sorted, distinct words that have their first `depth` code points in common.

    A node is a range of the words and a depth; nodes are made as they are reached."""
    known: dict[tuple[int, int, int], dict[str, tuple[int, int, int]]] = {}

    def children(node: tuple[int, int, int]) -> dict[str, tuple[int, int, int]]:
        if (out := known.get(node)) is None:
            low, high, at = node
            low += len(words[low]) == at
            out = {}
            while low < high:
                last = words[low][at]
                end = low + 1
                while end < high and words[end][at] == last:
                    end += 1
                out[last] = (low, end, at + 1)
                low = end
            known[node] = out
        return out

    root = (0, len(words), depth)
    stack = [(root, list(children(root).values()))]
    while stack:
        node, active = stack.pop()
        low, high, at = node
        word = words[low]
        if high - low == 1:  # nothing but this word: what follows must be the same
            for first, end, below in active:
                wanted = words[first][:below] + word[at:]
                place = bisect.bisect_left(words, wanted, first, end)
                if place < end and words[place] == wanted:
                    yield word, wanted
            continue
        if len(word) == at:
            for first, _, below in active:
                if len(words[first]) == below:
                    yield word, words[first]
        beside = children(node)
        for last, child in beside.items():
            following = {further: None for m in active if (further := children(m).get(last))}
            following |= {sibling: None for other, sibling in beside.items() if other > last}
            following |= dict.fromkeys(children(child).values())
            stack.append((child, list(following)))


def walk_groups(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Sorted words; the groups of a prefix one after the other."""

    def emit(words: list[str]) -> Iterator[pa.RecordBatch]:
        if len(words) > 1 and (pairs := list(subtree_pairs(words, depth))):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*pairs, strict=True)], ["a", "b"])

    held: list[str] = []
    for batch in batches:
        for word in batch.column(0).to_pylist():
            if held and word[:depth] != held[0][:depth]:
                yield from emit(held)
                held = []
            held.append(word)
    yield from emit(held)


def near_pairs(words: DataFrame) -> DataFrame:
    """words (word), distinct -> (a, b): every pair at distance one, once."""
    spark = words.sparkSession
    found, low, left = None, 0, words.select("word")
    while True:
        high = low + BAND
        ended, sets = active_sets(left, low, high)
        deep = left.filter(F.char_length("word") >= high).withColumn("node", _head("word", high))
        # The words below a node, moved below its active nodes: near if they are words as well.
        moved = deep.join(sets, "node").select(F.col("word").alias("a"), F.concat("active", F.expr(f"substr(word, {high + 1})")).alias("b"))
        same = moved.join(left.select(F.col("word").alias("b")), "b", "left_semi").select("a", "b")
        hot = materialise(deep.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > GROUP).select("node"), 1)
        small = deep.join(hot, "node", "left_anti").select("word", "node").repartition("node").sortWithinPartitions("word").select("word")

        def walk(batches, depth=high):
            return walk_groups(batches, depth)

        part = ended.unionByName(same).unionByName(small.mapInArrow(walk, PAIRS))
        found = part if found is None else found.unionByName(part)
        if hot.isEmpty():
            return found
        left, low = materialise(deep.join(hot, "node", "left_semi").select("word")), high


def variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """words (word, n) -> (word, n, form, form_n, n_near, root)."""
    pairs = materialise(near_pairs(words.select("word")))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rated = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("m")), "b")
    best = rated.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "b")).alias("best"))
    strong = -F.col("best.less") >= factor * F.col("n")
    forms = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, F.col("best.b")).alias("form"), F.when(strong, -F.col("best.less")).alias("form_n"))
    forms = materialise(forms)
    # n grows by the factor with every step, so chains are short and have no cycles; each round doubles what a word has skipped.
    hops = forms.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        nxt = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = materialise(hops.join(nxt, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if hops.filter("moved").isEmpty():
            break
        hops = hops.drop("moved")
    return forms.join(hops.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = materialise(vocabulary(table(spark, sf_dir, "documents")))
    return variants(words).select("word", "form", "root", "n", "n_near", "form_n")


#: DuckDB SQL for the query.
OP11_SQL = f"""
WITH RECURSIVE r AS (SELECT doc_id, translate(x, '{UPPER}', '{LOWER}') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS x FROM documents)),
c AS (SELECT doc_id, w, count(*) AS c FROM r WHERE length(w) >= 5 GROUP BY ALL),
h AS (SELECT w, c, {crc32("(coalesce(doc_id::VARCHAR, '') || ':' || w)")} AS h FROM c),
v AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, sum(c)::BIGINT AS n FROM h GROUP BY 1 HAVING sum(c) >= 3),
v5 AS MATERIALIZED (SELECT word, n FROM v WHERE length(word) >= 5),
x AS MATERIALIZED (SELECT word, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v5)),
p AS (SELECT p.word AS a, q.word AS b FROM x p JOIN x q ON p.d = q.d AND p.i = q.i AND p.word <> q.word UNION SELECT u.word, x.word FROM v5 u JOIN x ON x.d = u.word UNION SELECT x.word, u.word FROM v5 u JOIN x ON x.d = u.word),
k AS (SELECT a, b, n, count(*) OVER (PARTITION BY a) AS n_near, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS place FROM p JOIN v5 ON word = b),
f AS MATERIALIZED (SELECT word, v5.n, CASE WHEN k.n >= 2 * v5.n THEN b END AS form, CASE WHEN k.n >= 2 * v5.n THEN k.n END AS form_n, coalesce(n_near, 0)::BIGINT AS n_near FROM v5 LEFT JOIN k ON a = word AND place = 1),
w AS (SELECT word, word AS at FROM f UNION ALL SELECT w.word, form FROM w JOIN f ON f.word = w.at WHERE form IS NOT NULL)
SELECT f.word, f.form, w.at AS root, f.n, f.n_near, f.form_n FROM f JOIN w ON w.word = f.word JOIN f e ON e.word = w.at WHERE e.form IS NULL
"""
