"""Run events as streams: the same results as the batch operators, kept up to date."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kbspark import model


def read_events(spark: SparkSession, directory: str, schema: str = model.EVENTS) -> DataFrame:
    """Run logs as a stream of events with ``at``, their time."""
    found = spark.readStream.schema(schema).option("pathGlobFilter", "run-*.jsonl").json(directory)
    return found.withColumn("at", F.try_to_timestamp("ts"))


def cost_stream(events: DataFrame) -> DataFrame:
    """Running totals of each run (update or complete mode)."""
    num = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return events.filter("event_type = 'cost_increment'").groupBy("run_id").agg(num("tokens_delta").alias("tokens"), num("seconds_delta").alias("seconds"), num("power_wh_delta").alias("power_wh"))


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Events by type and tumbling window, with a watermark for late ones."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"))


def step_stream(events: DataFrame) -> DataFrame:
    """Starts and ends of each step so far (update mode); state is two counters a step."""
    steps = events.filter("step_id is not null and event_type in ('step_started', 'step_finished', 'step_aborted')")
    starts, ends = F.count_if(F.col("event_type") == "step_started"), F.count_if(F.col("event_type") != "step_started")
    return steps.groupBy("run_id", "step_id").agg(starts.alias("starts"), ends.alias("ends"), (starts > ends).alias("open"))


def dedup_stream(seeds: DataFrame, key: str = "content_hash", at: str | None = None, late: str = "1 day") -> DataFrame:
    """First arrival of each content hash; bounded state if a time column is given."""
    return seeds.withWatermark(at, late).dropDuplicatesWithinWatermark([key]) if at else seeds.dropDuplicates([key])


def run_rules(changes: DataFrame, rules: list[tuple[str, str, str]], table: str, log_path: str, checkpoint: str):
    """Fires event-condition-action rules on each micro-batch and appends the log, a replayed batch once; returns the started query."""
    from kbspark.operators.archive import fire_rules
    from kbspark.sinks.notes import append_jsonl

    # One log may serve several streams: batches are named after the checkpoint, too.
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def each(batch: DataFrame, epoch: int) -> None:
        append_jsonl(fire_rules(batch, rules, table).withColumn("fired_at", F.current_timestamp()).withColumn("epoch", F.lit(epoch)), log_path, f"{stream}-{epoch:012d}")

    return changes.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_events(events: DataFrame, directory: str, checkpoint: str):
    """Writes a stream of events as JSON lines; returns the started query."""
    return events.writeStream.format("json").option("path", directory).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
