"""Periodic runs of words: maximal stretches of a text that repeat with a period, found in suffix trees, and texts with each run cut to its first period.

A run is a stretch of consecutive words with smallest period q and length >= max(LEAST, TIMES * q) that no neighbouring
word extends keeping the period. Texts are worked on in Arrow batches without a shuffle; a run never leaves its text.

1. Words are numbered. A run of the asked length consists of windows of `window()` words that come again in the
   text, so only stretches of such windows can hold one (equal hashes of different windows only add stretches). A run's neighbour that would extend
   it lies in the stretch too, so every stretch is a string of its own.
2. The suffix tree of all strings of a group, each with an end sign of its own: suffixes are ranked by doubling lengths, their
   common prefixes come from the ranks of every length, and inner nodes are the intervals of leaves that share a longer prefix than their neighbours.
3. Stoye and Gusfield: at a node whose label has q words, leaf j is the left half of a tandem repeat if leaf j + q is below the node as well, and
   branching if the two leave the node by different children. The leaves of each child but the largest one are tried, as j and as
   j + q; so a leaf is tried at most log2(n) times on the way to the root, and "below the node" is a comparison of ranks.
4. Every run of period q ends in one branching repeat of q. Repeats are rotated to the left as far as they go, by the ranks of
   doubling lengths, and what has the same ends is one run, whose period is the smallest one.

Memory follows SPAN words, or one text where that is longer. Cases: a null or blank text has no words and no runs, and an empty collapsed text;
words are runs of anything but ASCII white space; null doc_ids and repeated rows are rows like others; an empty table gives an empty
table; other columns stay, but `runs` and `collapsed` of `with_runs` take the place of columns of these names.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LEAST, TIMES = 24, 3
#: Words that are worked on at once.
SPAN = 1 << 18
#: Leaves that are tried at once.
TRIED = 1 << 21
RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
FOUND = T.StructType([T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])


def window(least: int, times: int) -> int:
    """The longest window all of whose places in a run come again in that run, a period away: length >= 2 * period + window - 1."""
    turn = least // times
    return max(1, min(least - 2 * turn + 1, (times - 2) * -(-least // times) + 1))


def stretches(ids: np.ndarray, text: np.ndarray, size: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches, of at least `least` words, of windows that come more than once in their text."""
    n = len(ids) - size + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if size > 1:
        spread = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        spread ^= spread >> np.uint64(29)
        code = text[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for k in range(size):
            code = (code * np.uint64(0xFF51AFD7ED558CCD)) + spread[k : k + n]
        inside = np.flatnonzero(text[:n] == text[size - 1 :])
        code = code[inside]
        order = np.argsort(code)
        same = code[order[1:]] == code[order[:-1]]
        again = np.unique(inside[np.concatenate([order[1:][same], order[:-1][same]])])
    else:
        again = np.arange(n)
    if not len(again):
        return again, again
    breaks = np.flatnonzero((np.diff(again) > size) | (text[again[1:]] != text[again[:-1]])) + 1
    starts, ends = again[np.r_[0, breaks]], again[np.r_[breaks - 1, len(again) - 1]] + size
    long = ends - starts >= least
    return starts[long], ends[long]


class SuffixTree:
    """The suffix tree of an integer string that ends in a sign of its own: leaves in order, inner nodes as intervals of leaves."""

    def __init__(self, string: np.ndarray):
        self.string, n = string, len(string)
        rank, step = np.unique(string, return_inverse=True)[1].astype(np.int64), 1
        self.ranks = [rank.astype(np.int32)]  # ranks[k]: equal where 2**k symbols are
        while rank.max() + 1 < n:
            after = np.zeros(n, np.int64)
            after[:-step] = rank[step:] + 1
            code = rank * (n + 1) + after
            order = np.argsort(code)
            code = code[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(code[1:] != code[:-1])])
            self.ranks.append(rank.astype(np.int32))
            step *= 2
        self.rank = rank
        self.leaves = np.empty(n, np.int64)
        self.leaves[rank] = np.arange(n)
        self._nodes(self._common(self.leaves[:-1], self.leaves[1:]))

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b, different ones, have in common."""
        a, b, found = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 2, -1, -1):
            step = (self.ranks[k][a] == self.ranks[k][b]) * (1 << k)
            a, b, found = a + step, b + step, found + step
        return found

    def rotations(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols in front of a and of b > a that are equal, backwards."""
        a, b, found = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        for k in range(len(self.ranks) - 2, -1, -1):
            p = 1 << k
            step = ((a >= p) & (self.ranks[k][a - p] == self.ranks[k][b - p])) * p
            a, b, found = a - step, b - step, found + step
        return found

    def _nodes(self, shared: np.ndarray) -> None:
        """depth, low and high leaf of each inner node but the root, and child_of, child_start, child_size."""
        depths, n = [-1, *shared.tolist(), -1], len(self.leaves)
        low, high, open_ = [0] * (n + 1), [0] * (n + 1), [0]
        for i in range(1, n + 1):
            d = depths[i]
            while depths[open_[-1]] > d:
                high[open_.pop()] = i - 1
            top = open_[-1]
            low[i] = low[top] if depths[top] == d else top
            open_.append(i)
        cuts = np.flatnonzero(shared > 0) + 1  # between leaf i - 1 and i
        lows, highs = np.array(low, np.int64)[cuts], np.array(high, np.int64)[cuts]
        keys, node = np.unique(lows * n + highs, return_inverse=True)
        self.low, self.high = keys // n, keys % n
        order = np.lexsort([cuts, node])
        cuts, node = cuts[order], node[order]
        self.depth = shared[cuts - 1][np.searchsorted(node, np.arange(len(keys)))]
        owner = np.concatenate([np.arange(len(keys)), node])
        starts = np.concatenate([self.low, cuts])
        order = np.lexsort([starts, owner])
        self.child_of, self.child_start = owner[order], starts[order]
        last = np.append(self.child_of[1:] != self.child_of[:-1], True) if len(owner) else np.empty(0, bool)
        ends = np.append(self.child_start[1:], 0)[: len(owner)]
        self.child_size = np.where(last, self.high[self.child_of] + 1, ends) - self.child_start

    def smaller_halves(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(leaf, node): the leaf lists of every child but the largest of its node, about TRIED leaves at a time."""
        by_size = np.lexsort([-self.child_size, self.child_of])
        first = np.append(True, self.child_of[by_size][1:] != self.child_of[by_size][:-1]) if len(by_size) else np.empty(0, bool)
        small = by_size[~first]
        done = np.cumsum(self.child_size[small])
        at = 0
        while at < len(small):
            stop = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + TRIED, "right")))
            some = small[at:stop]
            sizes = self.child_size[some]
            inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            yield self.leaves[np.repeat(self.child_start[some], sizes) + inside], np.repeat(self.child_of[some], sizes)
            at = stop

    def branching_repeats(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, q) of the tandem repeats of two times q symbols whose next symbol is not the one that a rotation needs."""
        found = []
        for leaf, node in self.smaller_halves():
            q, low, high = self.depth[node], self.low[node], self.high[node]
            for start, partner in ((leaf, leaf + q), (leaf - q, leaf - q)):  # the leaf is the left half, or the right one
                inside = np.flatnonzero((partner >= 0) & (partner < len(self.string)))
                other = self.rank[partner[inside]]
                below = inside[(other >= low[inside]) & (other <= high[inside])]
                s, d = start[below], q[below]
                ok = self.string[s + d] != self.string[s + 2 * d]
                found.append(np.stack([s[ok], d[ok]]))
        both = np.concatenate(found, axis=1) if found else np.empty((2, 0), np.int64)
        return both[0], both[1]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, period) of every maximal run of two periods and more, in order."""
        start, q = self.branching_repeats()
        end = start + 2 * q
        start = start - self.rotations(start, start + q)
        order = np.lexsort([q, end, start])
        start, end, q = start[order], end[order], q[order]
        first = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])) if len(start) else np.empty(0, bool)
        return start[first], (end - start)[first], q[first]


def runs_in(texts: list[list], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text, a list of words, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    text, first = np.repeat(np.arange(len(texts)), sizes), np.cumsum(sizes) - sizes
    starts, ends = stretches(ids, text, window(least, times), least)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if not len(starts):
        return out
    lengths = ends - starts + 1  # with an end sign
    places = np.cumsum(lengths) - lengths
    inside = np.arange(lengths.sum()) - np.repeat(places, lengths)
    at = np.repeat(starts, lengths) + inside
    string = ids[np.minimum(at, len(ids) - 1)]
    string[places + lengths - 1] = len(number) + np.arange(len(starts))
    start, length, period = SuffixTree(string).runs()
    asked = length >= np.maximum(least, times * period)
    start, length, period = start[asked], length[asked], period[asked]
    start = at[start]
    order = np.lexsort([period, start])
    for s, n, q in zip(start[order].tolist(), length[order].tolist(), period[order].tolist(), strict=True):
        out[text[s]].append((s - int(first[text[s]]), n, q))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def groups(texts: list[bytes | None]) -> Iterator[list[list[bytes]]]:
    """The words of the texts, in groups of about SPAN."""
    held, size = [], 0
    for t in texts:
        held.append((t or b"").split())  # bytes are split at space and 9 to 13, nothing else
        size += len(held[-1])
        if size >= SPAN:
            yield held
            held, size = [], 0
    if held:
        yield held


@F.arrow_udf(FOUND)
def periodic(texts: pa.Array) -> pa.Array:
    """The runs of each text and the text without their repeats."""
    offsets, rows, left = [0], [], []
    for group in groups(texts.cast(pa.binary()).to_pylist()):
        for words, runs in zip(group, runs_in(group), strict=True):
            rows += runs
            offsets.append(len(rows))
            left.append(collapsed(words, runs))
    table = np.array(rows, np.int64).reshape(-1, 3)
    fields = pa.StructArray.from_arrays([pa.array(table[:, k]) for k in range(3)], ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields)
    return pa.StructArray.from_arrays([runs, pa.array(left, pa.binary()).cast(pa.string())], ["runs", "collapsed"])


def with_runs(docs: DataFrame) -> DataFrame:
    """docs with the columns runs (start, length, period by start, then period) and collapsed (its words without the repeats of its runs)."""
    found = docs.select(common.whole(docs).alias("row"), periodic(F.col("text").cast("string")).alias("found"))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("runs", "collapsed")]
    return found.select(*own, "found.runs", "found.collapsed")


def collapse(docs: DataFrame) -> DataFrame:
    """docs where the texts that hold runs are cut to the first period of each; other texts stay as they are."""
    found = docs.select(common.whole(docs).alias("row"), periodic(F.col("text").cast("string")).alias("found"))
    text = F.when(F.size("found.runs") > 0, F.col("found.collapsed")).otherwise(F.col("row.text"))
    fresh = {"text": text} | ({"n_chars": F.char_length(text).cast("long")} if "n_chars" in docs.columns else {})
    return found.select(*common.columns_of(docs, "row", **fresh))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) where a tenth of the documents, by the checksum of doc_id, repeats a part of its words up to its end. A null doc_id has no checksum."""
    mine = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    mine = mine.withColumn("words", F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", "[ \\x09-\\x0D]+"), "")))
    mine = mine.withColumn("n", F.coalesce(F.size("words"), F.lit(0))).withColumn("g", F.expr("h div 10"))
    mine = mine.withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    mine = mine.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    turned = F.expr("slice(concat(slice(words, 1, a), flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int)))), 1, n)")
    return mine.select("doc_id", F.when(F.col("n") > 0, F.array_join(turned, " ")).otherwise(F.col("text")).alias("text"))


def best(runs: Column) -> Column:
    """The run of the greatest exact length / period; ties: smallest start, then period."""
    def compare(x: Column, y: Column) -> Column:
        more = x["length"] * y["period"] - y["length"] * x["period"]
        return F.when(more > 0, -1).when(more < 0, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)

    return F.get(F.array_sort(runs, compare), F.lit(0))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(planted(common.table(spark, sf_dir, "documents"))).withColumn("top", best(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
