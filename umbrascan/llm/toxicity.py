"""Toxicity: a learned lexicon, Levenshtein automata over its trie, and context windows.

Terms come from a bounded labelled sample: whole words, and stems that start many words, that are found in toxic texts
and hardly in others. A term counts by the number of different words before it, so copies of one passage do not
make a term. Every word of a text runs as a Levenshtein automaton over the trie of terms: an exact hit is a term, a hit
within the term's edit bound is a misspelling unless the sample's clean texts use that very word. A hit's weight falls
with what its window of words holds: quotation marks around it and words of report mean that it is quoted. The summed
weights go into a logistic fit.

The fit sees at most SAMPLE labelled rows, those with the smallest hashes of doc_id, and never rows whose crc32 modulo 5
is 0; lexicon and weights are of fixed size, whole texts are scored in place and nothing is shuffled.

Cases: null and empty texts have no hits and get the score of a text without hits; without labels the score is 0.5 less
a little for all; a null doc_id is not held out and not learned from; several labels of a doc_id count as their
maximum; repeated rows are each returned; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from . import common

SAMPLE = 8_000
MIN_SUPPORT = 5
MAX_CLEAN_SHARE = 0.02
LEAST_LETTERS, MOST_LETTERS = 4, 12
WINDOW = 5
TOKEN = r"[^\W_]+(?:[@$!][^\W_]+)*"
#: Look-alike characters inside words, quotation marks, and words of report in the four languages.
LOOK_ALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
QUOTES = "\"“”„«»‹›‘’"
REPORT = set("said says called calls quote quoted quotes word term slur insult wrote writes reported alleged dit mot citation insulte sagte wort zitat nannte dijo palabra cita insulto".split())


def remainder() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5


def plain(token: str) -> str:
    """A lower-cased token with look-alikes inside a word replaced; numbers stay."""
    if token.isalpha() or not any(map(str.isalpha, token)):
        return token
    return "".join(LOOK_ALIKES.get(c, c) for c in token)


def edits(term: str, stem: bool) -> int:
    """How many edits a hit of the term may have."""
    return (len(term) >= 6) if stem else (len(term) >= 5) + (len(term) >= 10)


class Automaton:
    """The Levenshtein automaton of a word, its states as bits: state[d] has bit i if i letters are read with d edits."""

    def __init__(self, word: str, most: int):
        self.places: dict[str, int] = {}
        for i, c in enumerate(word):
            self.places[c] = self.places.get(c, 0) | 1 << i
        self.end, self.full = 1 << len(word), (1 << len(word) + 1) - 1
        self.start = [(1 << d + 1) - 1 & self.full for d in range(most + 1)]

    def step(self, state: list[int], char: str) -> list[int]:
        here = self.places.get(char, 0)
        out = [(state[0] & here) << 1]
        for before, now in zip(state, state[1:]):
            out.append(((now & here) << 1 | before | before << 1 | out[-1] << 1) & self.full)
        return out


def trie_of(terms: list[tuple[str, bool]]) -> dict:
    """Letters to nodes; "" to the term that ends there; None to the most edits any term below allows."""
    root: dict = {}
    for term, stem in terms:
        node, bound = root, edits(term, stem)
        node[None] = max(node.get(None, 0), bound)
        for c in term:
            node = node.setdefault(c, {})
            node[None] = max(node.get(None, 0), bound)
        node[""] = (term, stem)
    return root


def best_hit(word: str, root: dict) -> tuple[str, int] | None:
    """The nearest term of the trie within its edit bound, and the number of edits."""
    if not root:
        return None
    machine, found = Automaton(word, root[None]), None
    todo = [(root, machine.start)]
    while todo:
        node, state = todo.pop()
        if "" in node:
            term, stem = node[""]
            for off in range(edits(term, stem) + 1):
                if state[off] if stem else state[off] & machine.end:
                    if found is None or (off, term) < (found[1], found[0]):
                        found = (term, off)
                    break
        for char, child in node.items():
            if char:
                after = machine.step(state, char)
                if after[child[None]]:
                    todo.append((child, after))
    return found


def piece_machine(terms: list[tuple[str, bool]]) -> ahocorasick.Automaton | None:
    """Aho-Corasick over pieces of the terms: with k edits, one of k + 1 pieces of a term stands unchanged, at most k places off."""
    pieces: dict[str, list[tuple[int, int, int, int]]] = {}
    for term, stem in terms:
        k = edits(term, stem)
        cuts = [round(i * len(term) / (k + 1)) for i in range(k + 2)]
        for at, end in zip(cuts, cuts[1:]):
            pieces.setdefault(term[at:end], []).append((at, k, len(term) - k, 1 << 30 if stem else len(term) + k))
    if not pieces:
        return None
    machine = ahocorasick.Automaton()
    for piece, uses in pieces.items():
        machine.add_word(piece, (len(piece), uses))
    machine.make_automaton()
    return machine


class Matcher:
    """Hits of a lexicon in texts; what a word hits is remembered for a bounded number of words."""

    MEMORY = 500_000

    def __init__(self, terms: list[tuple[str, bool]], ordinary: set[str]):
        # Words are read with look-alikes replaced, so terms are too; a word that is a term as it is written is no misspelling.
        folded = list(dict.fromkeys((plain(term), stem) for term, stem in terms))
        self.written, self.beginnings = {term for term, _ in terms}, tuple(term for term, stem in terms if stem)
        self.root, self.ordinary, self.known = trie_of(folded), ordinary, {}
        self.token, self.pieces = re.compile(TOKEN), piece_machine(folded)

    def may_hit(self, word: str) -> bool:
        if self.pieces is None:
            return False
        for end, (size, uses) in self.pieces.iter(word):
            for at, k, shortest, longest in uses:
                if shortest <= len(word) <= longest and abs(end + 1 - size - at) <= k:
                    return True
        return False

    def of_word(self, word: str) -> int:
        """-1: none, 0: a term, 1 and more: a misspelling."""
        hit = self.known.get(word)
        if hit is None:
            if len(self.known) > self.MEMORY:
                self.known.clear()
            read = plain(word)
            found = best_hit(read, self.root) if len(word) >= LEAST_LETTERS - 1 and self.may_hit(read) else None
            hit = self.known[word] = -1 if found is None or found[1] and word in self.ordinary else found[1] + (found[1] == 0 and read != word and not (word in self.written or word.startswith(self.beginnings)))
        return hit

    def features(self, text: str | None) -> list[float]:
        """log(1 + sum) of: weights of exact hits, weights of misspellings, what context took away; log of words."""
        lowered = (text or "").lower()
        words = self.token.findall(lowered)
        known = self.known
        for w in set(words).difference(known):
            self.of_word(w)
        hits = [(i, h) for i, h in enumerate([known.get(w, -2) for w in words]) if h != -1]
        hits = [(i, h) for i, h in ((i, h if h >= 0 else self.of_word(words[i])) for i, h in hits) if h >= 0]
        exact = near = taken = 0.0
        if hits:
            places = [m.span() for m in self.token.finditer(lowered)]
            for i, h in hits:
                weight = context(lowered, words, places, i)
                taken += 1 - weight
                if h:
                    near += weight
                else:
                    exact += weight
        return [float(np.log1p(exact)), float(np.log1p(near)), float(np.log1p(taken)), float(np.log1p(len(words)))]


def context(text: str, words: list[str], places: list[tuple[int, int]], i: int) -> float:
    """The weight of the hit at word i: 1 in plain use, less between quotation marks or beside words of report."""
    lo, hi = max(0, i - WINDOW), min(len(words), i + WINDOW + 1)
    before, after = text[places[lo][0] : places[i][0]], text[places[i][1] : places[hi - 1][1] + 1]
    quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
    reports = sum(w in REPORT for w in words[lo:hi])
    return (0.3 if quoted else 1.0) / (1 + reports)


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Settled (doc_id, text, toxic) of at most SAMPLE labelled doc_ids that may be learned from; one text of a doc_id."""
    own = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = own.orderBy(F.xxhash64("doc_id", F.lit("toxicity")), "doc_id").limit(SAMPLE)
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most SAMPLE rows
    one = chosen.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))
    return common.settle(one, "toxic-sample")


def term_counts(sample: DataFrame) -> DataFrame:
    """For every word and every stem: texts with it by label, and how many different words come before it in toxic ones, the first in order of each text.

    Exact, and the same however rows are dealt; the sample is bounded.
    """
    words = sample.select("doc_id", "toxic", F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}@$!]+"), "").alias("words"))
    words = words.select("doc_id", "toxic", "words", F.posexplode("words").alias("at", "word"))
    words = words.select("doc_id", "toxic", "word", F.when(F.col("at") > 0, F.get("words", F.col("at") - 1)).otherwise(F.lit("")).alias("before"))
    words = words.filter(F.char_length("word") >= LEAST_LETTERS).distinct()
    lengths = F.sequence(F.lit(LEAST_LETTERS), F.least(F.char_length("word") - 1, F.lit(MOST_LETTERS)))
    stems = F.when(F.char_length("word") > LEAST_LETTERS, F.transform(lengths, lambda n: F.struct(F.substring("word", F.lit(1), n).alias("term"), F.lit(True).alias("stem")))).otherwise(F.array().cast("array<struct<term:string,stem:boolean>>"))
    whole = F.array(F.struct(F.col("word").alias("term"), F.lit(False).alias("stem")))
    terms = words.select("doc_id", "toxic", "before", F.explode(F.concat(whole, stems)).alias("t"))
    per_doc = terms.groupBy("t.term", "t.stem", "doc_id").agg(F.max("toxic").alias("toxic"), F.min("before").alias("before"))
    toxic = F.col("toxic") == 1
    return per_doc.groupBy("term", "stem").agg(F.count_if(toxic).alias("n_toxic"), F.count_if(~toxic).alias("n_clean"), F.count_distinct(F.when(toxic, F.col("before"))).alias("support"))


def beginning(ordered: list[str], start: str) -> list[str]:
    """Those of the ordered words that begin with start."""
    return ordered[bisect_left(ordered, start) : bisect_left(ordered, start + "\U0010ffff")]


def choose_terms(rows: list) -> list[tuple[str, bool]]:
    """Whole words, and the longest of nested stems with about the same texts; stems go when one word makes them up."""
    whole = {r["term"]: r for r in rows if not r["stem"]}
    stem = {r["term"]: r for r in rows if r["stem"]}
    words, stems = sorted(whole), sorted(stem)
    chosen: list[tuple[str, bool]] = []
    done: set[str] = set()
    for term in sorted(stem, key=lambda t: (len(t), t)):
        if any(term[:n] in done for n in range(LEAST_LETTERS, len(term) + 1)):
            continue
        texts = stem[term]["n_toxic"]
        own = beginning(words, term)
        if len(own) >= 4 and max(whole[w]["n_toxic"] for w in own) < 0.7 * texts:
            best = term
            for longer in sorted(beginning(stems, term), key=lambda t: (len(t), t)):
                if longer.startswith(best) and stem[longer]["n_toxic"] >= 0.97 * texts:
                    best = longer
            chosen.append((best, True))
            done.add(term)
    kept = {s for s, _ in chosen}
    chosen += [(w, False) for w in words if not any(w[:n] in kept for n in range(1, len(w) + 1))]
    return chosen


def lexicon(sample: DataFrame) -> list[tuple[str, bool]]:
    counts = term_counts(sample).filter((F.col("support") >= MIN_SUPPORT) & (F.col("n_clean") <= F.col("n_toxic") * MAX_CLEAN_SHARE))
    return choose_terms(counts.orderBy(F.desc("support"), "term", "stem").collect())  # the bounded sample bounds the terms


def ordinary_words(sample: DataFrame, terms: list[tuple[str, bool]]) -> set[str]:
    """Words of the sample's clean texts that are an edit away from a term; they are no misspellings."""
    if not terms:
        return set()
    kind = T.StructType([T.StructField("word", T.StringType())])

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(terms, set())
        for b in batches:
            yield pd.DataFrame({"word": [w for w in b["word"] if matcher.of_word(w) > 0]}, dtype=object)

    words = sample.filter("toxic = 0").select(F.explode(F.array_remove(F.split(F.lower("text"), r"[^\p{L}\p{N}@$!]+"), "")).alias("word")).distinct()
    return {r["word"] for r in words.mapInPandas(near, kind).collect()}  # as many as the bounded sample has near its terms


def features_udf(terms: list[tuple[str, bool]], ordinary: set[str]):
    key = f"lexicon {hashlib.sha256(repr((terms, sorted(ordinary))).encode()).hexdigest()}"

    @pandas_udf(T.ArrayType(T.DoubleType()))
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = common.per_process(key, lambda: Matcher(terms, ordinary))
        for batch in batches:
            yield pd.Series([matcher.features(x) for x in batch])

    return features


def fit(x: np.ndarray, y: np.ndarray, steps: int = 40, ridge: float = 1e-2) -> np.ndarray:
    """Logistic weights, bias last, by damped Newton steps; the ridge keeps separable data finite."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * len(y) * 1e-2 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + (ridge * len(y) * 1e-2 + 1e-6) * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


def scorer(docs: DataFrame, labels: DataFrame) -> Column:
    """The score of column text, learned from the labelled rows."""
    sample = labelled_sample(docs, labels)
    terms = lexicon(sample)
    features = features_udf(terms, ordinary_words(sample, terms))
    rows = sample.filter("text is not null").select("toxic", features("text").alias("x")).collect()  # at most SAMPLE small vectors
    y = np.array([r["toxic"] > 0 for r in rows], float)
    w = fit(np.array([r["x"] for r in rows]).reshape(len(rows), 4), y) if 0 < y.sum() < len(y) else np.array([1.0, 0.5, 0.0, 0.0, -1.0])
    x = features("text")
    logit = F.aggregate(F.transform(x, lambda v, i: v * F.get(F.array(*map(F.lit, w[:4].tolist())), i)), F.lit(float(w[4])), lambda a, v: a + v)
    return 1 / (1 + F.exp(-logit))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with the column toxicity, 0 to 1."""
    return docs.withColumn("toxicity", scorer(docs, labels))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return scored.select("doc_id", F.coalesce(remainder() == 0, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
