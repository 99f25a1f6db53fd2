"""The cache of model answers between runs: increments in a folder, each of them visible at once or not at all.

    cache = AnswerCache(spark, "/shared/answers")
    done = cache.review(flags, reviewer)        # cached texts are not asked again; new answers are there for the next run
    cache.reset()                               # from here on every text is asked again

An increment is a folder of Parquet files, and counts from the moment in which Spark has written its mark of success; one whose writer stopped
is passed over. A reset is an increment too, which hides those before it. Reading takes the increments after the last reset, and the first answer of a
key where two writers had one. An upsert writes only keys that are not there yet; `compact` rewrites all as one increment.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import review
from .reviewers import Reviewer

ROWS = "cache_key string, label string, reason string"
DONE = "_SUCCESS"


@dataclass
class AnswerCache:
    spark: SparkSession
    folder: str

    def _listed(self, done_only: bool) -> list[tuple[int, str]]:
        """(number, kind) of the increments, oldest first."""
        store, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(self.folder))
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        wanted = [f.path.rsplit("/", 2)[-2] for f in found if f.base_name == DONE] if done_only else [f.base_name for f in found if f.type == fs.FileType.Directory]
        return sorted((int(n), kind) for n, _, kind in (w.partition("-") for w in wanted) if n.isdigit() and kind in ("add", "reset"))

    def version(self) -> int:
        """The number of the newest increment; 0 for a cache that was never written."""
        return max((n for n, _ in self._listed(True)), default=0)

    def read(self) -> DataFrame:
        """cache_key, label, reason: a row a key."""
        done = self._listed(True)
        since = max((n for n, kind in done if kind == "reset"), default=0)
        paths = [(n, f"{self.folder}/{n:08d}-add") for n, kind in done if kind == "add" and n > since]
        rows = self.spark.createDataFrame([], f"{ROWS}, at long")
        for n, path in paths:
            rows = rows.unionByName(self.spark.read.schema(ROWS).parquet(path).withColumn("at", F.lit(n).cast("long")))
        first = rows.groupBy("cache_key").agg(F.min_by(F.struct("label", "reason"), "at").alias("a"))
        return first.select("cache_key", "a.label", "a.reason")

    def _write(self, rows: DataFrame, kind: str) -> int:
        number = max((n for n, _ in self._listed(False)), default=0) + 1
        rows.write.mode("error").parquet(f"{self.folder}/{number:08d}-{kind}")  # of two writers of one number one fails
        return number

    def upsert(self, rows: DataFrame) -> int:
        """Add the rows (cache_key, label, reason) whose key is not there yet; the number of the increment."""
        fresh = rows.select("cache_key", "label", "reason").dropDuplicates(["cache_key"])
        return self._write(fresh.join(self.read().select("cache_key"), "cache_key", "left_anti"), "add")

    def reset(self) -> int:
        return self._write(self.spark.createDataFrame([], ROWS), "reset")

    def compact(self) -> int:
        """All answers as one increment behind a reset. Rows are written before the reset hides the old ones, under the number after it."""
        number = max((n for n, _ in self._listed(False)), default=0) + 1
        self.read().write.mode("error").parquet(f"{self.folder}/{number + 1:08d}-add")
        self.spark.createDataFrame([], ROWS).write.mode("error").parquet(f"{self.folder}/{number:08d}-reset")
        return number + 1

    def review(self, flags: DataFrame, reviewer: Reviewer | None) -> DataFrame:
        """flags with the second opinion, read back from a table beside the cache, so that reading them asks nobody again."""
        path = f"{self.folder}/reviews-{uuid.uuid4().hex}"
        review.review(flags, reviewer, self.read()).write.parquet(path)
        done = self.spark.read.parquet(path)
        self.upsert(review.cache_rows(done))
        return done
