"""Times and row counts of the stages of a scan: each stage is run on its own, persisted for the next one, and observed on its way out."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "stage string, rows long, ms double"


@dataclass
class Stages:
    """Stages run so far: name, rows and milliseconds. Rows are Spark's own observed metrics, so a frame is not counted by a second run."""

    done: list[tuple[str, int, float]] = field(default_factory=list)
    kept: list[DataFrame] = field(default_factory=list)

    def run(self, name: str, df: DataFrame, *metrics) -> DataFrame:
        """df computed and persisted; what it took is noted under name."""
        self.kept.append(df.persist())
        seen, start = Observation(name), time.perf_counter()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *metrics).write.format("noop").mode("overwrite").save()
        self.done.append((name, seen.get["rows"], round((time.perf_counter() - start) * 1000, 2)))
        return df

    def timings(self) -> dict[str, float]:
        """Milliseconds by stage, and their total."""
        own = {name: ms for name, _, ms in self.done}
        return own | {"total": round(sum(own.values()), 2)}

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.done, SCHEMA)

    def release(self) -> None:
        while self.kept:
            self.kept.pop().unpersist()
