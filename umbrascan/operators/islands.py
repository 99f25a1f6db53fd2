"""Runs of neighbouring rows with the same label (gaps and islands), by a running count of label changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def islands(df: DataFrame, keys: list[str], order: list[str], label: Column) -> DataFrame:
    """df with `run`, the number of the run inside keys, and `closes`, the struct of order columns of the row after it.

    Rows with a null label belong to no run but part those around them, so of these only keys and order are carried. Only rows of the same keys meet.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    rest = [c for c in df.columns if c not in (*keys, *order)]
    marked = df.withColumn("_label", label).select(*keys, *order, "_label", F.when(F.col("_label").isNotNull(), F.struct(*rest)).alias("_rest"))
    before, after = F.lag("_label").over(w), F.lead("_label").over(w)
    next_row = F.lead(F.struct(*order)).over(w)
    changed = F.coalesce((before != F.col("_label")).cast("int"), F.when(before.isNull() & F.col("_label").isNull(), 0).otherwise(1))
    ends = F.when(after.eqNullSafe(F.col("_label")), F.lit(None)).otherwise(next_row)
    out = marked.withColumn("_changed", changed).withColumn("closes", ends)
    out = out.withColumn("run", F.sum("_changed").over(w)).filter(F.col("_label").isNotNull())
    return out.select(*keys, *order, *[F.col("_rest")[c].alias(c) for c in rest], "closes", "run")
