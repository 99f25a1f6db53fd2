"""Shared helpers: table reads, lineage cuts in the shared folder, size-checked broadcasts, connected components."""

from __future__ import annotations

import os
import sys
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes, that is ever broadcast; beyond it the same join is shuffled.
BROADCAST_BYTES = 32 << 20
#: So many of the most frequent keys of a join are taken apart from the rest.
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder, read by Spark only, so any file system Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset one in the warehouse. A local warehouse is shared
    in local mode only, as in tests; on a cluster it is an error, as each executor would write to its own disk."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if is_local(warehouse) and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{warehouse}/checkpoints-{spark.sparkContext.applicationId}"


def is_local(path: str) -> bool:
    return path.startswith("file:") or "://" not in path and not path.startswith("hdfs:")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: With this setting Spark deletes a query's shuffle files when it ends, not when the driver happens to collect garbage.
CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: a lineage cut that outlives any executor."""
    spark = df.sparkSession
    path, before = new_path(spark, label), spark.conf.get(CLEAN_SHUFFLES, "false")
    spark.conf.set(CLEAN_SHUFFLES, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEAN_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind settled frames that no later plan reads."""
    for df in frames:
        spark = df.sparkSession
        for folder in {os.path.dirname(f) for f in df.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def whole(df: DataFrame) -> Column:
    """Every column of df in one struct, so that no name of a working column can clash with one of df's."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def columns_of(df: DataFrame, struct: str, **fresh: Column) -> list[Column]:
    """df's columns out of a struct made by `whole`, those in fresh replaced."""
    return [fresh[c].alias(c) if c in fresh else F.col(struct).getField(c).alias(c) for c in df.columns]


def per_process(key: str, make: Callable[[], Any]) -> Any:
    """make()'s result, kept in a Python worker process from task to task."""
    kept = sys.modules.setdefault("_kept_per_process", types.ModuleType("_kept_per_process")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def small(rows: int, row_bytes: int) -> bool:
    """Whether so many rows may be broadcast."""
    return rows * row_bytes <= BROADCAST_BYTES


def small_side(df: DataFrame, row_bytes: int) -> DataFrame:
    """Hint a broadcast of a settled frame only if its counted rows fit in BROADCAST_BYTES; else leave the join to a shuffle."""
    return F.broadcast(df) if small(df.count(), row_bytes) else df


def hottest(counted: DataFrame, on: list[str], count: str, keys: int = HOT_KEYS) -> DataFrame:
    """The keys that most rows have, a bounded number of them whatever the input."""
    return counted.orderBy(F.desc(count)).limit(keys).select(*on)


def join_skewed(rows: DataFrame, by_key: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """rows joined with by_key (few rows a key), where some keys of rows may be very frequent: by_key's rows of the `hot` keys, a bounded
    number, are broadcast, so that rows of these keys stay where they are; all the others are shuffled by key."""
    hot = F.broadcast(hot)
    some = rows.join(F.broadcast(by_key.join(hot, on, "left_semi")), on)
    rest = rows.join(hot, on, "left_anti").join(by_key.join(hot, on, "left_anti"), on)
    return some.unionByName(rest)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. Texts of one-byte characters take the fast built-in."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def connected_components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node reachable.

    Alternating large and small stars: every node's neighbours move to its smallest neighbour until each
    node points at its root. Each round is two partial-aggregated minima and two equi joins, and is written
    to the shared folder, so a lost executor costs one round. No component is ever gathered in one task.
    """
    stars = settle(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    seen = mark(stars)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        fresh = settle(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = mark(fresh)
        discard(stars)
        stars = fresh
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
