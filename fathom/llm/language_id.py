"""Language identification in two steps: the language family first, then one-versus-one linear SVMs inside the family.

Features are the shares of hashed byte trigrams of the whole lower-cased text (ASCII case only), so every margin is a mean of
weights and a text is scored in one pass. The classifier is fitted on the driver on a bounded sample of labelled rows
(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS); prediction covers all rows and shuffles nothing.

Defined results: `und` with score 0 for a null text, a text without a letter, or when nothing was learned; rows with a null
lang are never learned from; every other lang value is learned, with fewer rows each where there are many, and more than MAX_LANGUAGES
of them are an error; repeated rows are predicted alike.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_bucket, slices, table, tidy

BUCKETS = 1 << 12
SAMPLE_PER_LANGUAGE, SAMPLE_ROWS, MAX_LANGUAGES = 800, 8_000, 1_000
UNDETERMINED = "und"

#: ISO 639-1 codes by family; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    family_of: list[int]
    """For each language the index of its family."""
    weights: np.ndarray
    """(BUCKETS, classifiers): families one against the rest, then pairs of languages; two families need one classifier."""
    bias: np.ndarray
    slope: np.ndarray
    pairs: list[tuple[int, int]]


def trigram_buckets(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of every trigram, start and end of each text's trigrams); texts are padded with a space on both sides."""
    n = len(offs) - 1
    padded = np.full(len(raw) + 2 * n, 32, np.uint8)
    at = np.arange(len(raw)) + np.repeat(2 * np.arange(n) + 1, np.diff(offs))
    padded[at] = raw
    lowered = _LOWER[padded]
    grams = _FIRST[lowered[:-2]] ^ _SECOND[lowered[1:-1]] ^ _THIRD[lowered[2:]]
    start = offs[:-1] + 2 * np.arange(n)
    return grams, start, start + np.diff(offs)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32
#: A trigram's bucket: one random number for each byte in each place, joined by exclusive or.
_FIRST, _SECOND, _THIRD = np.random.default_rng(11).integers(0, BUCKETS, (3, 256), dtype=np.uint16)


def shares(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, BUCKETS) shares of trigram buckets."""
    grams, start, end = trigram_buckets(raw, offs)
    out = np.zeros((len(start), BUCKETS), np.float32)
    for i, (a, b) in enumerate(zip(start, end, strict=True)):
        out[i] = np.bincount(grams[a:b], minlength=BUCKETS) / max(1, b - a)
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM (y is -1 or 1), by accelerated gradient steps; classes weigh the same."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    step = 1 / (2 * float(np.einsum("ij,ij->i", x, x).max() + 1) + ridge)
    w = v = np.zeros(x.shape[1] + 1)
    for k in range(rounds):
        pull = weight * y * np.maximum(0, 1 - y * (x @ v[:-1].astype(x.dtype) + v[-1]))
        new = v + step * (2 * np.r_[pull.astype(x.dtype) @ x, pull.sum()] - ridge * v)
        w, v = new, new + k / (k + 3) * (new - w)
    return w[:-1], float(w[-1])


def _slope(margin: np.ndarray, y: np.ndarray) -> float:
    """Steepness of the logistic curve that turns a margin into a probability."""
    grid = np.geomspace(0.5, 64, 40)
    return float(grid[np.argmin([np.logaddexp(0, -g * y * margin).mean() for g in grid])])


def fit(rows: DataFrame, families: dict[str, str] | None = None) -> Model | None:
    """rows: (text, lang, key); key and text spread the sample, and rows that agree in both count once. None when there is nothing to
    learn from."""
    families = FAMILY_OF if families is None else families
    rows = rows.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("text", "lang", F.xxhash64(F.col("key").cast("string"), "text").alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.select("lang", "h").distinct().groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} values of lang")
    cap = min(SAMPLE_PER_LANGUAGE, SAMPLE_ROWS // len(counts))
    # The least `cap` hashes of each language: a threshold that leaves some more (short of the cap with a chance below 1e-9), then by rank.
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, int(min(1.0, (4 * cap + 64) / n) * (1 << 40)))])
    place = F.pmod("h", F.lit(1 << 40))
    near = rows.withColumn("place", place).filter(F.col("place") < F.coalesce(share[F.col("lang")], F.lit(0)))
    once = near.groupBy("lang", "place", "h").agg(F.min("text").alias("text"))
    sample = once.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("place", "h"))).filter(F.col("rank") <= cap)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in slices(batch, "text"):
                x = shares(raw, offs).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array([row.tobytes() for row in x], pa.binary())], ["lang", "x"])

    got = sample.select("text", "lang").mapInArrow(tidy(features), "lang string, x binary").toArrow()
    if got.num_rows == 0:
        return None
    langs = np.array(got["lang"].to_pylist())
    x = np.empty((got.num_rows, BUCKETS), np.float32)
    for i, row in enumerate(got["x"]):
        x[i] = np.frombuffer(row.as_py(), np.float16)
    del got
    scale = 1 / (x.std(0) + np.float32(1e-4))
    x *= scale / np.float32(np.sqrt(BUCKETS))
    languages = sorted(set(langs.tolist()))
    named = [families.get(lang, f"={lang}") for lang in languages]
    family_names = sorted(set(named))
    family_of = [family_names.index(f) for f in named]
    of_row = np.array([family_of[languages.index(lang)] for lang in langs])
    fitted, slopes = [], []

    def learn(chosen: np.ndarray, y: np.ndarray) -> None:
        w, b = linear_svm(x[chosen], y)
        fitted.append((w * scale / np.sqrt(BUCKETS), b))
        slopes.append(_slope(x[chosen] @ w + b, y))

    everything = np.ones(len(x), np.bool_)
    for f in range(len(family_names) if len(family_names) > 2 else len(family_names) - 1):
        learn(everything, np.where(of_row == f, 1.0, -1.0))
    pairs = [(a, b) for a, b in itertools.combinations(range(len(languages)), 2) if family_of[a] == family_of[b]]
    for a, b in pairs:
        chosen = (langs == languages[a]) | (langs == languages[b])
        learn(chosen, np.where(langs[chosen] == languages[a], 1.0, -1.0))
    weights = np.stack([w for w, _ in fitted], 1) if fitted else np.zeros((BUCKETS, 0))
    return Model(languages, family_names, family_of, weights.astype(np.float32), np.array([b for _, b in fitted]), np.array(slopes), pairs)


def decide(model: Model, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language index, score in 0..1) of rows of margins."""
    n, families = len(margins), len(model.families)
    sure = 1 / (1 + np.exp(-np.clip(model.slope * margins, -60, 60)))
    used = families if families > 2 else families - 1
    if families == 1:
        family, trust = np.zeros(n, np.int64), np.ones(n)
    elif families == 2:
        family = (sure[:, 0] < 0.5).astype(np.int64)
        trust = np.maximum(sure[:, 0], 1 - sure[:, 0])
    else:
        family = margins[:, :used].argmax(1)
        trust = sure[np.arange(n), family]
    member = np.array(model.family_of)
    votes = np.zeros((n, len(model.languages)))
    least = np.ones((n, len(model.languages)))
    for k, (a, b) in enumerate(model.pairs):
        p = sure[:, used + k]
        votes[:, a] += p >= 0.5
        votes[:, b] += p < 0.5
        least[:, a] = np.minimum(least[:, a], p)
        least[:, b] = np.minimum(least[:, b], 1 - p)
    rank = np.where(member[None, :] == family[:, None], votes + least / 2, -1)
    best = rank.argmax(1)
    return best, trust * least[np.arange(n), best]


def lettered(column: str) -> Column:
    """Whether a text has a letter; false for a null."""
    return F.coalesce(F.col(column).rlike(r"\p{L}"), F.lit(False))


def predict(df: DataFrame, model: Model | None) -> DataFrame:
    """Adds lang_pred and score to df, which has `text`; columns of df with these names are replaced."""
    df = df.drop("lang_pred", "score", "_letters")
    if model is None:
        return df.withColumn("lang_pred", F.lit(UNDETERMINED)).withColumn("score", F.lit(0.0))
    names = [f.name for f in df.schema.fields]
    schema = df.withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, offs in slices(batch, "text"):
                grams, start, end = trigram_buckets(raw, offs)
                margins = np.zeros((part.num_rows, len(model.bias)))
                for k in range(len(model.bias)):
                    total = np.r_[0.0, np.cumsum(model.weights[:, k][grams], dtype=np.float64)]
                    margins[:, k] = (total[end] - total[start]) / np.maximum(1, end - start) + model.bias[k]
                best, score = decide(model, margins)
                has = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False)
                lang = np.where(has, np.array(model.languages, object)[best], UNDETERMINED)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(np.where(has, score, 0.0))], [*names, "lang_pred", "score"])

    return df.withColumn("_letters", lettered("text")).mapInArrow(tidy(predicted), schema)


def op7_hierarchical_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(doc_bucket(3) != 1).select("text", "lang", F.col("doc_id").alias("key")))
    out = predict(docs.select("doc_id", (doc_bucket(3) == 1).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
