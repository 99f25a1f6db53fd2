"""SimHash near-duplicates of documents by multi-index hashing.

A text is lower-cased (A-Z), cut into words at ASCII white space and into 3-word shingles; a fingerprint bit is
set when more than half of the shingles' XXH64 values (seed 42) have it. Fingerprints at two or fewer differing
bits are linked. Two fingerprints that close agree on one of their two 32-bit segments up to one bit, so the ball
of radius one around each segment is enumerated, looked up in that segment's table, and the complete distance
verified. Only distinct fingerprints enter the tables, so copies cost one row however many they are.

Cases: null, empty and all-blank texts have fingerprint 0 and link like any other; a null doc_id never becomes a
component's id unless all its doc_ids are null; repeated rows are each returned; other columns are ignored by
`near_duplicates` and kept by `keep_one`; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from . import common

SHINGLE = 3
SEED = 42
MAX_BITS = 2
SEGMENT_BITS = 32
CHUNK = 1 << 15


def fingerprint(text: bytes | None) -> int:
    """The fingerprint as a signed 64-bit integer."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), CHUNK):
        h = np.array([digest(s, SEED) for s in shingles[at : at + CHUNK]], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<i8")[0])


@pandas_udf(LongType())
def fingerprint_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def fingerprints(docs: DataFrame) -> DataFrame:
    return docs.withColumn("fp", fingerprint_of(F.col("text").cast("binary")))


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints in column fp at 1 to MAX_BITS differing bits."""
    low = F.lit((1 << SEGMENT_BITS) - 1)
    segments = F.array(F.col("fp").bitwiseAND(low), F.shiftrightunsigned("fp", SEGMENT_BITS))
    rows = prints.select("fp", F.posexplode(segments).alias("segment", "value"))
    tag = F.shiftleft(F.col("segment").cast("long"), SEGMENT_BITS)
    index = rows.select(F.col("fp").alias("b"), tag.bitwiseOR(F.col("value")).alias("key"))
    # The ball of radius one: of two values that differ in one bit, the one without it probes for the other.
    probes = rows.select("fp", "segment", "value", F.explode(F.sequence(F.lit(-1), F.lit(SEGMENT_BITS - 1))).alias("bit"))
    mask = F.when(F.col("bit") < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, bit)"))
    probes = probes.withColumn("mask", mask).filter(F.col("value").bitwiseAND(F.col("mask")) == 0)
    probes = probes.select(F.col("fp").alias("a"), "bit", tag.bitwiseOR(F.col("value")).bitwiseOR(F.col("mask")).alias("key"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    near = apart.between(1, MAX_BITS) & ((F.col("bit") >= 0) | (F.col("a") < F.col("b")))
    left, right = probes.alias("l"), index.alias("r")
    return left.join(right, (F.col("l.key") == F.col("r.key")) & near).select("a", "b").distinct()


def fingerprinted(docs: DataFrame) -> DataFrame:
    """Settled (doc_id, fp, code), a row per row of docs."""
    return common.settle(fingerprints(docs.select("doc_id", "text", text_code().alias("code"))).select("doc_id", "fp", "code"), "prints")


def text_code() -> Column:
    return F.xxhash64("text", F.length("text"))


def components(prints: DataFrame) -> DataFrame:
    """(fp, component_id, keep) for each fingerprint of settled rows (doc_id, fp, code), and how many rows have it. keep: the row that comes first."""
    least = prints.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("gone"), "doc_id", "fp", "code")).alias("first"), F.count("*").alias("rows"))
    least = common.settle(least, "prints")
    roots = common.connected_components(fingerprint_links(least.select("fp")), "a", "b")
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = common.settle(rooted.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("members")), "firsts")
    placed = common.join_skewed(rooted.select("fp", "rows", "root"), firsts.drop("members"), ["root"], common.hottest(firsts, ["root"], "members"))
    return placed.select("fp", "rows", F.col("first.doc_id").alias("component_id"), F.col("first").alias("keep"))


def with_components(prints: DataFrame) -> DataFrame:
    """prints with component_id and keep. Copies share a fingerprint, and the most frequent ones are joined where they are."""
    found = common.settle(components(prints), "components")
    return common.join_skewed(prints, found.drop("rows"), ["fp"], common.hottest(found, ["fp"], "rows"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return with_components(fingerprinted(docs)).select("doc_id", text.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest doc_id stays.

    What goes is found on (doc_id, code of the text) alone. Texts are only read once more, and shuffled only where a row that stays is repeated.
    """
    prints = fingerprinted(docs)
    first = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("fp") == F.col("keep.fp")) & (F.col("code") == F.col("keep.code"))
    key = [F.col("doc_id").alias("gone_id"), F.col("code").alias("gone_code")]
    gone = common.settle(with_components(prints).filter(~first).select(*key).distinct(), "doubles")
    repeated = common.settle(prints.groupBy("doc_id", "code").count().filter("count > 1").select(*key), "repeated")
    mine = docs.select(common.whole(docs).alias("row"), F.col("doc_id").alias("own_id"), text_code().alias("own_code"))
    same = F.col("own_id").eqNullSafe(F.col("gone_id")) & (F.col("own_code") == F.col("gone_code"))
    left = mine.join(common.small_side(gone, 24), same, "left_anti")
    repeated = common.small_side(repeated, 24)
    once = left.join(repeated, same, "left_anti").unionByName(left.join(repeated, same, "left_semi").dropDuplicates(["own_id", "own_code"]))
    return once.select(*common.columns_of(docs, "row"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"))
