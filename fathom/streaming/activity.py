"""The activity log as a stream: appended turns, a running state by session, digests by month.

The source is a folder of JSON lines that grows; triggers are `availableNow`, so the same job serves a schedule and a test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import keep_last
from ..sources.reports import ACTIVITY


def activity_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(ACTIVITY).option("maxFilesPerTrigger", files_per_batch).json(path)


def by_window(log: DataFrame, late: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Turns, blocked turns and the largest blast in windows of event time; rows later than the watermark are dropped."""
    w = log.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"))
    return w.agg(F.count("*").alias("turns"), F.count_if(F.col("verdict") == "blocked").alias("blocked"), F.max("blastRadius").alias("blast")).select(F.col("w.start").alias("start"), "turns", "blocked", "blast")


def run_available(stream: DataFrame, checkpoint: str, sink, mode: str = "append"):
    """Process what is there and stop; sink(batch, id) is called for each batch. The checkpoint remembers what was processed, so
    nothing is logged twice."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_turns(spark: SparkSession, path: str, checkpoint: str, log: str) -> None:
    """Log what is new in the folder: one row a turn, however often the job runs. Each batch owns a folder of its number, which a batch that is run again after a failure replaces."""
    run_available(activity_stream(spark, path), checkpoint, lambda batch, number: batch.write.mode("overwrite").parquet(f"{log}/batch={number}"))


def current_blocks(spark: SparkSession, path: str, checkpoint: str, state: str) -> None:
    """The last verdict of each session in a table at `state`: a session that is blocked shows until a later turn is clean.

    A batch writes the sessions that it touched, into a folder of its number, and no others; a batch that is run again after a failure
    replaces its own folder."""

    def merge(batch: DataFrame, number: int) -> None:
        last_verdicts(batch.select("sessionId", "ts", "verdict", "violations")).write.mode("overwrite").parquet(f"{state}/batch={number}")

    run_available(activity_stream(spark, path), checkpoint, merge)


def last_verdicts(turns: DataFrame) -> DataFrame:
    """The newest turn of each session; at one time that of the later batch, then a blocked one, then the one with the greater list of
    violations."""
    batch = F.col("batch").cast("long") if "batch" in turns.columns else F.lit(0).cast("long")
    order = F.struct("ts", batch.alias("batch"), (F.col("verdict") == "blocked").alias("blocked"), F.coalesce("violations", F.array().cast("array<string>")).alias("v"))
    return turns.groupBy("sessionId").agg(F.max_by(F.struct("ts", "verdict", "violations"), order).alias("r")).select("sessionId", "r.*")


def read_blocks(spark: SparkSession, state: str) -> DataFrame:
    """Sessions whose last verdict is blocked."""
    return last_verdicts(spark.read.parquet(state)).filter("verdict = 'blocked'")


def compacted(log: DataFrame, most: int = 5_000) -> DataFrame:
    """The newest rows of each session."""
    return keep_last(log, ["sessionId"], "ts", most)


def monthly_digest(log: DataFrame) -> DataFrame:
    """By month: turns checked and held, sessions, largest blast, quiet turns, and violations by code; no paths."""
    base = log.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count("*").alias("checked"),
        F.count_if(F.col("verdict") == "blocked").alias("held"),
        F.countDistinct("sessionId").alias("sessions"),
        F.max("blastRadius").alias("largest_blast"),
        F.count_if(F.coalesce(F.size("violations"), F.lit(0)) == 0).alias("quiet"),
    )
    codes = log.select(F.date_format("ts", "yyyy-MM").alias("month"), F.explode("violations").alias("code")).groupBy("month", "code").agg(F.count("*").alias("n"))
    lists = codes.groupBy("month").agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("codes"))
    return base.join(lists, "month", "left")
