"""Scans of a stream of documents: a document never spans micro-batches, so each batch is scanned by the batch plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions import rules as R


def scan_stream(documents: DataFrame, scan: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """Write scan(batch) of every micro-batch under path, in a folder per batch, so a repeated batch replaces its own rows."""

    def one(batch: DataFrame, number: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return documents.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)


def risk_stream(flags: DataFrame, delay: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Worst risk and count of flags per source and hour of a stream of labelled flags (source, ts, rule_label), late ones dropped after delay."""
    own = flags.withWatermark("ts", delay).groupBy(F.window("ts", window), "source")
    return own.agg(F.count("*").alias("flags"), R.risk(F.max(R.rank(F.col("rule_label")))).alias("risk"))


def first_answers_stream(answers: DataFrame, delay: str = "1 day") -> DataFrame:
    """Cache rows of a stream of answers (cache_key, ts, label, reason): the first of a key within delay."""
    return answers.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["cache_key"])
