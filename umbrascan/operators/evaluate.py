"""Evaluation of the detectors over a set of documents: who caught what, averages, and cold against warm passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import unicode_escape

FIELDS = ("provider", "filename", "pages", "num_flags", "parse_ms", "detect_ms", "visual_diff_ms", "llm_ms", "total_ms", "cache_hits", "final_risk", "style_only", "visual_only", "both")


def same_set(column: str, *values: str) -> Column:
    return F.array_sort(F.array_distinct(F.col(column))) == F.array(*map(F.lit, sorted(values)))


def detector_counts(docs: DataFrame, flags: DataFrame) -> DataFrame:
    """doc_id, num_flags, style_only, visual_only and both of every document."""
    counts = {"style_only": ("style",), "visual_only": ("visual",), "both": ("style", "visual")}
    per_doc = flags.groupBy("doc_id").agg(F.count("*").alias("num_flags"), *[F.count_if(same_set("detected_by", *v)).alias(k) for k, v in counts.items()])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select("doc_id", *map(zero, ("num_flags", *counts)))


def caught(rows: DataFrame) -> DataFrame:
    """rows (kind, style_only, visual_only, both) with caught_by: style, visual, both, none, or - where none is right."""
    style, visual = F.col("style_only") + F.col("both"), F.col("visual_only") + F.col("both")
    by = F.when((style > 0) & (visual > 0), "both").when(style > 0, "style").when(visual > 0, "visual").otherwise("none")
    return rows.withColumn("caught_by", F.when((F.col("kind") != "attack") & (by == "none"), "-").otherwise(by))


def kinds(rows: DataFrame, clean: DataFrame, benign: DataFrame) -> DataFrame:
    """rows (filename) with kind: clean, benign (hidden text that attacks nobody) or attack, for names in neither list. The lists are frames of names."""
    listed = clean.select("filename", F.lit("clean").alias("kind")).unionByName(benign.select("filename", F.lit("benign").alias("kind")))
    own = listed.groupBy("filename").agg(F.max("kind").alias("kind"))  # a name in both is clean
    return rows.join(own, "filename", "left").withColumn("kind", F.coalesce("kind", F.lit("attack")))


def headline(rows: DataFrame) -> DataFrame:
    """One row: attacks only one detector caught or none did, and false positives on clean documents."""
    of = lambda kind, by: F.count_if((F.col("kind") == kind) & (F.col("caught_by") == by))
    clean = F.col("kind") == "clean"
    total = lambda c: F.coalesce(F.sum(F.when(clean, c)), F.lit(0).cast("long"))
    return caught(rows).agg(
        of("attack", "visual").alias("visual_only_attacks"), of("attack", "style").alias("style_only_attacks"),
        F.count_if((F.col("kind") == "attack") & (F.col("num_flags") == 0)).alias("missed"), F.count_if(clean).alias("clean_documents"),
        total(F.col("visual_only") + F.col("both")).alias("visual_false_positives"), total(F.col("num_flags")).alias("false_positives"),
    )


def with_average(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by file, and one with the file AVERAGE, by grouping sets: ((filename), ())."""
    grouped = rows.rollup("filename").agg(*[F.avg(c).alias(c) for c in columns], F.grouping("filename").alias("total"))
    return grouped.select(F.when(F.col("total") == 1, "AVERAGE").otherwise(F.col("filename")).alias("filename"), *columns)


def totals(rows: DataFrame) -> DataFrame:
    """Sums of calls and retries, and the distinct errors in order."""
    errors = F.array_sort(F.collect_set(F.when(F.col("llm_error") != "", F.col("llm_error"))))
    return rows.agg(F.sum("llm_calls").alias("llm_calls"), F.sum("retries").alias("retries"), F.array_join(errors, "; ").alias("errors"))


def cold_and_warm(cold: DataFrame, warm: DataFrame) -> DataFrame:
    """One row: the AI stage's time in both passes over the same files, and the speed-up (null if the warm one took none)."""
    both = cold.select("filename", F.col("llm_ms").alias("cold_ms")).join(warm.select("filename", F.col("llm_ms").alias("warm_ms")), "filename")
    sums = both.agg(F.sum("cold_ms").alias("cold_ms"), F.sum("warm_ms").alias("warm_ms"))
    return sums.withColumn("speedup", F.when(F.col("warm_ms") > 0, F.col("cold_ms") / F.col("warm_ms")))


def visual_times(rows: DataFrame) -> DataFrame:
    return rows.agg(F.avg("visual_diff_ms").alias("avg_ms"), F.max("visual_diff_ms").alias("max_ms"))


def column_widths(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the width of every column: its longest value or its name."""
    return rows.agg(*[F.greatest(F.coalesce(F.max(F.char_length(F.col(c).cast("string"))), F.lit(0)), F.lit(len(c))).alias(c) for c in columns])


def text_table(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows with `line`, its values padded to the columns' widths; the one row of widths is broadcast."""
    widths = column_widths(rows, columns).select(*[F.col(c).alias(f"_w_{c}") for c in columns])
    padded = [F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(f"_w_{c}"), F.lit(" ")) for c in columns]
    joined = rows.join(F.broadcast(widths), F.lit(True))
    return joined.withColumn("line", F.concat_ws("  ", *padded)).drop(*[f"_w_{c}" for c in columns])


def flag_table(reviewed: DataFrame, filename: Column) -> DataFrame:
    """A row per flag for a printed table: what the rules said, what the model said and what the report shows."""
    return reviewed.select(
        T.base_name(filename).alias("file"), "technique", F.array_join("detected_by", "+").alias("by"), F.substring(unicode_escape("text"), 1, 44).alias("text"),
        F.col("rule_label").alias("rule"), F.coalesce("llm_label", F.lit("-")).alias("ai"), F.col("final_label").alias("final"),
        F.col("llm_status").alias("status"), F.substring(F.coalesce("llm_reason", F.lit("")), 1, 70).alias("ai_reason"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    """The fields of the benchmark, others left out, with a header."""
    rows.select(*[c for c in FIELDS if c in rows.columns]).write.mode("overwrite").option("header", True).csv(path)
