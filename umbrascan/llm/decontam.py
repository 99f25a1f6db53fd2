"""Benchmark decontamination: windows of ten benchmark words looked up in training documents, natively.

The hash set of the benchmark's windows is broadcast when its counted size is within common.BROADCAST_BYTES and
joined by shuffle beyond it. Documents stream their token windows past it inside one codegen stage; hits are then
verified word by word, and only hits and one marker row per document are shuffled. Words are runs of characters
other than ASCII punctuation, space and control characters, after lower-casing A-Z.

Cases: null texts have no words; an item of 1 to 9 words is one window, an item without words matches nothing;
repeated rows (same doc_id and text) are each returned; null ids are ids like any other (a null item_id counts
as an item and is left out of the list of ids); an empty benchmark leaves every document clean; other columns
are ignored by `contamination` and kept by `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 10
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SEPARATED_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> Column:
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(F.col(text), F.lit(""))), BREAKS), "")


def with_words(df: DataFrame, *keep: Column | str) -> DataFrame:
    words = df.select(*keep, words_of("text").alias("words"))
    return words.withColumns({"n_words": F.size("words"), "codes": F.transform("words", lambda w: F.xxhash64(w))})


def starts(sizes: list[int], first: int = 0) -> Column:
    """The places of a text's windows; first=-1 adds a marker at -1.

    Places of the k-th size are numbered from k * 2**32, so one cheap sequence per size is all that is exploded.
    """
    places = [F.when(F.col("n_words") >= n, F.sequence(F.lit(k << 32), F.lit(k << 32) + F.col("n_words") - n)) for k, n in enumerate(sizes)]
    none = F.array().cast("array<bigint>")
    marker = [F.array(F.lit(-1).cast("bigint"))] if first < 0 else []
    return F.concat(none, *marker, *[F.coalesce(p, none) for p in places])


def windows(df: DataFrame, sizes: list[int], places: Column) -> DataFrame:
    """A row per window with its `place`, where it starts (`at`), `size` and hash `code`."""
    exploded = df.select("*", F.explode(places).alias("place"))
    at = F.when(F.col("place") < 0, F.lit(-1)).otherwise(F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    slot = F.shiftright("place", 32)
    exploded = exploded.withColumns({"at": at, "slot": slot})
    return exploded.withColumns({"size": by_size(sizes, F.lit), "code": by_size(sizes, lambda n: F.xxhash64(F.lit(n), *[F.get("codes", F.col("at") + i) for i in range(n)]))})


def by_size(sizes: list[int], value) -> Column:
    out = F.lit(None)
    for k, n in enumerate(sizes):
        out = F.when(F.col("slot") == k, value(n)).otherwise(out)
    return out


def gram(sizes: list[int]) -> Column:
    return by_size(sizes, lambda n: F.concat_ws(" ", *[F.get("words", F.col("at") + i) for i in range(n)]))


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Settled distinct (item_id, size, code, gram) of the benchmark's windows."""
    items = with_words(benchmark, "item_id").filter("n_words > 0").withColumn("size", F.least("n_words", F.lit(window)))
    starts = F.sequence(F.lit(0), F.col("n_words") - F.col("size"))
    grams = items.select("item_id", "size", "words", F.explode(starts).alias("at"))
    grams = grams.select("item_id", "size", F.transform(F.sequence("at", F.col("at") + F.col("size") - 1), lambda i: F.get("words", i)).alias("gram"))
    code = F.xxhash64("size", F.transform("gram", lambda w: F.xxhash64(w)))  # a hash of an array goes on from element to element
    return common.settle(grams.select("item_id", "size", code.alias("code"), F.array_join("gram", " ").alias("gram")).distinct(), "windows")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_code, n_words, hits (distinct verified windows), items (of hits), one row per row of docs."""
    known = benchmark_windows(benchmark, window)
    sizes = [r[0] for r in known.select("size").distinct().orderBy("size").limit(window).collect()]
    codes = common.settle(known.select(F.col("code").alias("known")).distinct(), "codes")
    texts = docs.select("doc_id", F.xxhash64("text", F.length("text")).alias("text_code"), "text")
    if common.small(codes.count(), 24):
        placed = windows(with_words(texts, "doc_id", "text_code"), sizes, starts(sizes, first=-1))
        found = placed.join(F.broadcast(codes), F.col("code") == F.col("known"), "left").filter("known is not null or at < 0").drop("known")
    else:
        found = looked_up(texts, codes, sizes)
    found = found.select("doc_id", "text_code", "n_words", "at", F.col("size").cast("int").alias("size"), "code", F.when(F.col("at") >= 0, gram(sizes)).alias("gram"))
    named = known.select(F.col("code").alias("known"), F.col("gram").alias("known_gram"), "item_id")
    same = (F.col("code") == F.col("known")) & (F.col("gram") == F.col("known_gram"))
    if common.small(known.count(), 256):
        verified = found.join(F.broadcast(named), same, "left")
    else:  # markers have no code: shuffled by it they would all be dealt to one task
        found = common.settle(found, "found")
        marks = found.filter("at < 0").withColumns({"known": F.lit(None).cast("long"), "item_id": F.lit(None).cast(known.schema["item_id"].dataType)})
        verified = found.filter("at >= 0").join(named, same).drop("known_gram").unionByName(marks)
    hit = F.col("known").isNotNull()
    per_doc = verified.groupBy("doc_id", "text_code").agg(
        F.max("n_words").alias("n_words"),
        F.count_if(F.col("at") < 0).alias("copies"),
        F.collect_set(F.when(hit, F.struct("at", "size"))).alias("hits"),
        F.collect_set(F.when(hit, F.struct(F.col("item_id").cast("string").alias("id")))).alias("items"),
    )
    return per_doc.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copy", "copies")


def looked_up(texts: DataFrame, codes: DataFrame, sizes: list[int]) -> DataFrame:
    """Windows that may be hits, and a marker for each text, where the benchmark is too large to be broadcast.

    Only a window's code and place are shuffled; the words come from a second look at the texts that have hits.
    """
    own = windows(with_words(texts, "doc_id", "text_code"), sizes, starts(sizes)).select("doc_id", "text_code", "place", "code")
    met = own.join(codes, F.col("code") == F.col("known"), "left_semi").select(F.col("doc_id").alias("hit_id"), F.col("text_code").alias("hit_code"), "place")
    per_text = common.settle(met.groupBy("hit_id", "hit_code").agg(F.collect_set("place").alias("places")), "hits")
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("text_code") == F.col("hit_code"))
    joined = texts.join(per_text, same, "left")
    marker = F.array(F.lit(-1).cast("bigint"))
    return windows(with_words(joined, "doc_id", "text_code", "places"), sizes, F.concat(marker, F.coalesce("places", F.array().cast("array<bigint>"))))


def hit_words() -> Column:
    """Positions of the words inside any hit."""
    return F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["at"], h["at"] + h["size"] - 1))))


def report(found: DataFrame) -> DataFrame:
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i["id"])), ",")
    n_hit = F.size(hit_words()).cast("long")
    return found.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents") -> DataFrame:
    """docs without its contaminated documents, or (remove="spans") without the words of hits and what separates them."""
    found = contamination(docs, benchmark).filter(F.size("hits") > 0)
    hits = common.settle(found.select(F.col("doc_id").alias("hit_id"), F.col("text_code").alias("hit_code"), hit_words().alias("hit")).dropDuplicates(["hit_id", "hit_code"]), "hits")
    mine = docs.select(common.whole(docs).alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text", F.length("text")).alias("own_code"))
    same = F.col("own_id").eqNullSafe(F.col("hit_id")) & (F.col("own_code") == F.col("hit_code"))
    if remove == "documents":
        return mine.join(common.small_side(hits.drop("hit"), 24), same, "left_anti").select(*common.columns_of(docs, "row"))
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(SEPARATED_WORD), F.lit(0))
    joined = mine.join(hits, same, "left").withColumn("pieces", pieces)
    rest = F.expr("substring(row.text, length(array_join(pieces, '')) + 1)")
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), "hit"), lambda i: F.get("pieces", i))
    cut = joined.withColumn("cut", F.when(F.col("hit").isNull(), F.col("row.text")).otherwise(F.concat(F.array_join(stay, ""), rest)))
    return cut.select(*common.columns_of(docs, "row", text=F.col("cut"), n_chars=F.char_length("cut").cast("long")))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT rid, i, dw.n AS n, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.n = bw.n),
covered AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN items USING (rid)
"""
