"""Spelling variants: words at one edit from a much more frequent word, found by symmetric deletion, and the word that each chain of forms ends in.

Every distinct word emits itself and its distinct single deletions; words that share a key meet in an equi-join, and pairs at a
distance of exactly one are near. Two words that differ by one inserted, deleted or replaced letter share exactly one key: the shorter word,
or what is left when the replaced letter goes. (Words of equal length share a second deletion only if they differ in several places.) So no pair comes
twice, and a key of k letters has at most (k + 1) * 90 words, whatever the input, as words are made of 90 letters.

A word of n letters emits n + 1 keys. Up to LONG letters these are strings beside the word; the rows of longer words hold hashes instead of
both, made from running hashes of beginnings and ends in Arrow batches, and the words themselves are looked up for the pairs that meet. Both ways
give the same pairs. A hash only proposes a pair; the edit distance of the words decides.

A word's form is its near word of the largest count (ties: the first in code-point order), if that is FACTOR times its own or more. Counts
grow along forms, so chains end; roots are joined in rounds, each of which doubles the steps.

Cases: null and empty texts have no words; a null doc_id plants no slips; repeated rows count each time; words without a near one have n_near 0, no form and themselves as
root; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_LETTERS, LEAST_COUNT, FACTOR = 7, 2, 10
#: Words of more letters are looked up by hashes.
LONG = 64
#: Keys of long words in one Arrow batch.
BATCH = 1 << 18
NOT_LETTERS = "[^a-zÀ-ÿ]+"


def letter_runs(docs: DataFrame, least: int = LEAST_LETTERS) -> DataFrame:
    """(doc_id, run) for each maximal run of at least `least` letters, A-Z lower-cased."""
    runs = docs.select("doc_id", F.explode(F.split(common.ascii_lower(F.col("text")), NOT_LETTERS)).alias("run"))
    return runs.filter(F.char_length("run") >= least)


def with_slips(runs: DataFrame, every: int = 31) -> DataFrame:
    """(word): the runs, where those whose checksum with their doc_id is a multiple of `every` lose the letter that it points at."""
    h = F.crc32(F.concat_ws(":", F.col("doc_id").cast("string"), "run"))
    marked = runs.withColumn("h", F.when(F.col("doc_id").isNotNull(), h))
    at = "cast(h % char_length(run) as int)"
    return marked.select(F.expr(f"case when h % {every} = 0 then concat(substring(run, 1, {at}), substring(run, {at} + 2)) else run end").alias("word"))


def counted(words: DataFrame, least: int = LEAST_LETTERS, count: int = LEAST_COUNT) -> DataFrame:
    """Settled (word, n): how often each word of at least `least` letters occurs, if `count` times or more."""
    return common.settle(words.filter(F.char_length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= count), "words")


def short_pairs(words: DataFrame, long: int = LONG) -> DataFrame:
    """(a, n_a, b, n_b) of near words a < b of up to `long` letters. words: word and n."""
    deleted = "transform(sequence(1, char_length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1)))"
    keys = words.filter(F.char_length("word") <= long).select("word", "n", F.explode(F.expr(f"array_distinct(concat(array(word), {deleted}))")).alias("key"))
    side = lambda x: keys.select("key", F.col("word").alias(x), F.col("n").alias(f"n_{x}"))
    return side("a").join(side("b"), "key").filter("a < b and levenshtein(a, b, 1) = 1").select("a", "n_a", "b", "n_b")


def deletion_codes(word: str) -> np.ndarray:
    """Distinct hashes of a word and of its single deletions. A hash is the exclusive or of its letters' hashes, each with its place."""
    letters = np.frombuffer(word.encode("utf-32-le"), "<u4").astype(np.uint64)

    def mixed(at: np.ndarray) -> np.ndarray:
        x = (letters << np.uint64(32)) + at.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
        return x ^ (x >> np.uint64(31))

    place, none = np.arange(len(letters)), np.zeros(1, np.uint64)
    heads = np.concatenate([none, np.bitwise_xor.accumulate(mixed(place))])
    tails = np.concatenate([np.bitwise_xor.accumulate(mixed(place - 1)[::-1])[::-1], none])
    return np.unique(np.append(heads[:-1] ^ tails[1:], heads[-1])).view(np.int64)


def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key) for each key of rows (id, word)."""
    def rows(held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        ids = np.repeat(np.array([i for i, _ in held], np.int64), [len(k) for _, k in held])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([k for _, k in held]))], names=["id", "key"])

    for batch in batches:
        held, size = [], 0
        for i, word in zip(batch.column("id").to_pylist(), batch.column("word"), strict=True):
            keys = deletion_codes(word.as_py())
            held.append((i, keys))
            size += len(keys)
            if size >= BATCH:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)


def long_pairs(words: DataFrame, long: int = LONG) -> DataFrame:
    """(a, n_a, b, n_b) of near words a < b, of which one has more than `long` letters."""
    some = words.filter(F.char_length("word") >= long).withColumn("id", F.xxhash64("word"))
    keys = some.select("id", "word").mapInArrow(coded, "id long, key long")
    met = keys.withColumnRenamed("id", "x").join(keys.withColumnRenamed("id", "y"), "key").filter("x < y").select("x", "y").distinct()
    side = lambda i, x: some.select(F.col("id").alias(i), F.col("word").alias(x), F.col("n").alias(f"n_{x}"))
    found = met.join(side("x", "p"), "x").join(side("y", "q"), "y")
    found = found.filter(f"greatest(char_length(p), char_length(q)) > {long} and levenshtein(p, q, 1) = 1")
    ordered = [F.expr(f"if(p < q, {first}, {second})").alias(name) for name, first, second in (("a", "p", "q"), ("n_a", "n_p", "n_q"), ("b", "q", "p"), ("n_b", "n_q", "n_p"))]
    return found.select(*ordered)


def forms(words: DataFrame, long: int = LONG) -> DataFrame:
    """Settled (word, n_near, form, form_n) of the words that have near ones."""
    pairs = short_pairs(words, long).unionByName(long_pairs(words, long))
    each = pairs.selectExpr("inline(array(struct(a as word, n_a as n, b as near, n_b as near_n), struct(b as word, n_b as n, a as near, n_a as near_n)))")
    best = each.groupBy("word").agg(F.max("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    enough = -F.col("best.less") >= FACTOR * F.col("n")
    return common.settle(best.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms")


def roots(found: DataFrame) -> DataFrame:
    """Settled (word, root) of the words that have a form. found: word and form."""
    jumps = common.settle(found.filter("form is not null").select("word", F.col("form").alias("root")), "jumps")
    while True:
        ahead = jumps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = common.settle(jumps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "jumps")
        common.discard(jumps)
        jumps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return jumps


def variants(words: DataFrame, long: int = LONG) -> DataFrame:
    """word, form, root, n, n_near and form_n of every row of settled distinct words (word, n)."""
    found = forms(words, long)
    out = words.join(found, "word", "left").join(roots(found), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted(with_slips(letter_runs(common.table(spark, sf_dir, "documents")))))


#: The checksum is worked out byte by byte, with the table of its 256 remainders.
SQL = """
WITH RECURSIVE crcs AS (
  SELECT list(list_reduce([i::BIGINT] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS tab
  FROM (SELECT unnest(range(256)) AS i)),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
bytes AS (SELECT doc_id, run, times, encode(doc_id::VARCHAR || ':' || run) AS b FROM each),
sums AS (
  SELECT run, times, xor(list_reduce([4294967295::BIGINT] || list_transform(range(octet_length(b)), lambda k: ('0x' || substr(hex(b), 2 * k::INT + 1, 2))::BIGINT),
    lambda c, x: xor(c >> 8, tab[1 + (xor(c, x) & 255)])), 4294967295::BIGINT) AS h FROM bytes, crcs),
written AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM sums),
words AS (SELECT word, sum(times)::BIGINT AS n FROM written WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
deleted AS (SELECT DISTINCT word, n, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
places AS (SELECT word, n, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM places a JOIN places b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, d.n, w.word, w.n FROM deleted d JOIN words w ON d.key = w.word
  UNION SELECT w.word, w.n, d.word, d.n FROM deleted d JOIN words w ON d.key = w.word),
best AS (SELECT word, n, count(*) AS n_near, max(near_n) AS top FROM near GROUP BY word, n),
forms AS (
  SELECT b.word, b.n_near, min(e.near) AS form, any_value(e.near_n) AS form_n
  FROM best b LEFT JOIN near e ON e.word = b.word AND e.near_n = b.top AND b.top >= 10 * b.n GROUP BY b.word, b.n_near),
steps AS (
  SELECT word, word AS at FROM words UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NOT NULL),
ends AS (SELECT s.word, s.at AS root FROM steps s LEFT JOIN forms f ON f.word = s.at WHERE f.form IS NULL)
SELECT w.word, f.form, e.root, w.n, coalesce(f.n_near, 0)::BIGINT AS n_near, f.form_n
FROM words w LEFT JOIN forms f ON f.word = w.word JOIN ends e ON e.word = w.word
"""
