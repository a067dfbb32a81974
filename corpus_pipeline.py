"""A training-corpus pipeline of five operators: documents in, packed sequences out.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. Stages but the last return the columns
of `documents`; further columns of docs are dropped first. An empty table stays empty in every stage. Ids may be null or repeated:
rows are then told apart by the stage itself, and stay or go one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathom.llm import edit_decontamination, jaccard_join, language_id, packing, suffix_tree
from fathom.llm.common import bounded, discard, materialise, scratch, table
from fathom.llm.repeats import keyed

#: Smaller than for packing alone: workers of earlier stages live on beside those that pack.
CACHE_WORDS = 500_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@bounded
def language_id_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without text (null or empty), have no language and go; whether a model could be learned, and what
    it predicts, removes none. Where lang is null it becomes the predicted language; other values stay. Ties between languages go to
    the first by name; repeated rows are treated alike."""
    model = language_id.fit(docs.select("text", "lang", F.col("doc_id").alias("key")))
    out = language_id.predict(docs.select(COLUMNS).filter(language_id.lettered("text")), model)
    predicted = F.when(F.col("lang_pred") != language_id.UNDETERMINED, F.col("lang_pred"))
    return out.withColumn("lang", F.coalesce("lang", predicted)).select(COLUMNS)


@bounded
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of five-word shingles at 0.8 connect, the one with the least id stays (a null id is less than any other; of
    rows with one id, the one with the least hash of its text). Null texts and texts without words are linked with nothing and
    stay."""
    return jaccard_join.one_of_each(docs.select(COLUMNS), 5, 80)


@bounded
def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words that occur more than once go, from every copy; other texts stay as they are, null ones null. A text
    of which all words go stays as an empty one; n_chars is counted anew."""
    out = suffix_tree.remove_repeats(docs.select(COLUMNS))
    return out.withColumn("text", F.col("kept")).withColumn("n_chars", F.char_length("kept").cast("long")).select(COLUMNS)


@bounded
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, up to edits of a fifth of its words, go; null and empty texts hold none. Without a benchmark
    all stay."""
    rows = keyed(docs.select(COLUMNS))
    hits = edit_decontamination.contaminated(rows.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return rows.join(hits.select(F.col("doc_id").alias("_key")).distinct(), "_key", "left_anti").select(COLUMNS)


@bounded
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of at most 4,096 tokens (see packing.PIECES); a null or empty text is its end token alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=CACHE_WORDS)


STAGES = [
    ("language_id", language_id_stage),
    ("near_duplicates", near_duplicates_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


@bounded
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        kept: list[DataFrame] = []
        with scratch(kept):  # what a stage wrote for itself goes as soon as its result is written
            after = materialise(stage(spark, docs, sf_dir))
            kept.append(after)
        discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can express neither the classifier nor the packing; the stages are tested one by one.
ORACLE_SQL = None
