"""State machines over action streams, and windowed counts: Structured Streaming with state kept by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from clausewright.sources.files import result_path

#: (state, action) -> next state; other actions leave the state as it is.
CONTRACT = {
    ("draft", "submit"): "approval", ("approval", "approve"): "seal", ("seal", "approve"): "archived", ("approval", "reject"): "draft", ("seal", "reject"): "draft",
    ("draft", "void"): "void", ("approval", "void"): "void", ("seal", "void"): "void", ("archived", "void"): "void",
}
REVIEW = {("none", "submit"): "pending", ("pending", "confirm"): "confirmed", ("pending", "reset"): "none", ("confirmed", "reset"): "none"}
#: Actions of the event stream.
ACTIONS = {"view": "reset", "signup": "submit", "click": "approve", "error": "reject", "purchase": "confirm"}
LOG = "user_id long, event_id long, action string, before string, after string"


def transitions(actions: DataFrame, moves: dict[tuple[str, str], str], start: str) -> DataFrame:
    """A row for each of `actions` (user_id, event_id, action): the state before and after it.

    Works on a stream. Keeps one state a key; a key's actions are taken in the order of event_id within a micro-batch,
    of which the trigger bounds the size. Actions without a move are logged and change nothing."""

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else start
        rows = []
        for event, action in sorted((r for b in batches for r in b[["event_id", "action"]].itertuples(index=False, name=None))):
            after = moves.get((now, action), now)
            rows.append((key[0], event, action, now, after))
            now = after
        state.update((now,))
        yield pd.DataFrame(rows, columns=["user_id", "event_id", "action", "before", "after"])

    return actions.groupBy("user_id").applyInPandasWithState(step, LOG, "state string", "append", GroupStateTimeout.NoTimeout)


def event_stream(spark: SparkSession, sf_dir: str, files: int = 16) -> DataFrame:
    """The event table as a stream of at most `files` files a micro-batch, ts as an event time."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a pattern, since a stream takes a path without one for a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, label: str) -> DataFrame:
    """Runs an appending stream over all that is there, and reads what it wrote. The sink's log makes retries exact."""
    spark, path = stream.sparkSession, result_path(stream.sparkSession, label)
    stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def final_counts(stream: DataFrame, label: str) -> DataFrame:
    """Runs an aggregating stream in complete mode; each micro-batch replaces what the one before wrote, so a retry is harmless."""
    spark, path = stream.sparkSession, result_path(stream.sparkSession, label)

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows")

    stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{path}/log").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def actions(events: DataFrame) -> DataFrame:
    named = F.create_map(*[x for k, v in ACTIONS.items() for x in (F.lit(k), F.lit(v))])
    return events.select("user_id", "event_id", named[F.col("event_type")].alias("action")).where("action IS NOT NULL")


def daily_counts(events: DataFrame) -> DataFrame:
    """day, event_type, n: tumbling days of event time, two days late at most."""
    w = events.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return w.select(F.to_date("w.start").alias("day"), "event_type", "n")
