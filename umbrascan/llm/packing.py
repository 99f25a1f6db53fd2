"""Packing into length buckets that minimise padding, and token-budget batches inside each bucket.

A document's length is its number of words between ASCII white space (not ids of a tokenizer: a text without spaces has length 1), unless the caller gives another column of lengths; longer ones than MAX_LENGTH are cut into
pieces of that length and a rest, so nothing is left out. The histogram of piece lengths covers the whole corpus
and has at most MAX_LENGTH + 1 entries whatever the input; dynamic programming over it on the driver finds the
bucket boundaries with the least padding. Pieces of a bucket are dealt over as many shards as its count asks for
(SHARD_BATCHES batches each), and batches are numbered inside a shard, so no bucket is sorted in one task and only
a shard's last batch can be short.

Cases: a null or empty text is one piece of length 0; repeated rows and null ids are rows like any other; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

MAX_LENGTH = 2048
BUCKETS = 8
TOKEN_BUDGET = 1 << 16
SHARD_BATCHES = 64


def n_words(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), ""))


def boundaries(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets that minimise the padding of `counts` sequences of `lengths`."""
    order = np.argsort(lengths)
    size, many = np.asarray(lengths, np.float64)[order], np.asarray(counts, np.float64)[order]
    n = len(size)
    if not n:
        return []
    number = np.concatenate([[0.0], np.cumsum(many)])
    tokens = np.concatenate([[0.0], np.cumsum(many * size)])
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(min(buckets, n)):
        after, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        after[0] = 0
        for j in range(1, n + 1):
            cost = best[:j] + (number[j] - number[:j]) * size[j - 1] - (tokens[j] - tokens[:j])
            cut[j] = int(np.argmin(cost))
            after[j] = cost[cut[j]]
        best = after
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j:
            out.append(int(size[j - 1]))
            j = cut[j]
    return out[::-1]


def pieces(docs: DataFrame, max_length: int = MAX_LENGTH, length: Column | None = None) -> DataFrame:
    """doc_id, piece, n_tokens and a code of the text: each document cut into pieces of at most max_length tokens."""
    sized = docs.select("doc_id", (n_words() if length is None else F.coalesce(length, F.lit(0))).cast("int").alias("n"), F.xxhash64("text").alias("code"))
    last = F.greatest(F.ceil(F.col("n") / max_length).cast("int") - 1, F.lit(0))
    cut = sized.select("doc_id", "n", "code", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    return cut.select("doc_id", "piece", F.least(F.lit(max_length), F.col("n") - F.col("piece") * max_length).alias("n_tokens"), "code")


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, buckets: int = BUCKETS, budget: int = TOKEN_BUDGET, length: Column | None = None) -> DataFrame:
    """doc_id, piece, start, n_tokens, bucket (its padded length), shard, batch and slot of every piece, the same however the rows are dealt over tasks."""
    spark = docs.sparkSession
    cut = common.settle(pieces(docs, max_length, length), "pieces")
    histogram = cut.groupBy("n_tokens").count().collect()
    bounds = boundaries([r[0] for r in histogram], [r[1] for r in histogram], buckets)
    plan = []
    for i, top in enumerate(bounds):
        count = sum(r[1] for r in histogram if (bounds[i - 1] if i else -1) < r[0] <= top)
        rows = max(1, budget // max(top, 1))
        plan.append((bounds[i - 1] if i else -1, top, rows, max(1, -(-count // (SHARD_BATCHES * rows)))))
    schema = T.StructType([T.StructField(c, T.IntegerType(), False) for c in ("below", "bucket", "batch_rows", "shards")])
    plan = F.broadcast(spark.createDataFrame(plan, schema))  # at most `buckets` rows
    dealt = cut.withColumn("deal", F.xxhash64("doc_id", "piece", "code"))
    dealt = dealt.join(plan, (F.col("n_tokens") > F.col("below")) & (F.col("n_tokens") <= F.col("bucket")))
    dealt = dealt.withColumn("shard", F.pmod("deal", "shards").cast("int"))
    rank = F.row_number().over(Window.partitionBy("bucket", "shard").orderBy("deal", "doc_id", "piece")) - 1
    placed = dealt.withColumn("rank", rank)
    return placed.select(
        "doc_id", "piece", (F.col("piece").cast("long") * max_length).alias("start"), "n_tokens", "bucket", "shard",
        F.floor(F.col("rank") / F.col("batch_rows")).cast("int").alias("batch"), (F.col("rank") % F.col("batch_rows")).alias("slot"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))
