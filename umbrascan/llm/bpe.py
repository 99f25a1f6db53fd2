"""Byte-pair encoding and decoding of whole texts by merge rounds over flat numpy arrays, equal to the tokenizers library's for its JSON files.

A text is cut at the marks (special tokens) and at spaces, where the tokenizer drops white space, and runs between them that a worker process has
seen before are looked up (at most MEMORY of them, up to KEPT characters each). The words of all new runs of about SPAN characters are encoded at once:

* Their bytes are the first symbols, in one flat array with the number of the word beside each. A round forms the keys of all
  neighbouring pairs (left id * size + right id), finds their ranks by binary search over the sorted keys of the merges, takes the least
  rank of each word, and merges all its places, from the left where they overlap. Words without a pair leave the arrays, so the rounds are
  as many as the longest chain of merges of a word.
* Words of over LONG bytes would take too many rounds. They share an array with links to the next and the last symbol; a round
  takes one rank, from the least on, and looks up new pairs only beside its merges. A merge makes pairs of later ranks only (checked when the file is read), so each rank comes once.

The file's normaliser and pre-tokeniser are the library's own, run on new runs with other than one-byte characters; the merges, marks and
decoding are this module's. Files with other models, decoders, unknown tokens or marks than those described are refused.

Decoding looks tokens up and joins them: with spaces where the file names no decoder, as bytes of a text where it is byte-level.

Cases: a null text is encoded as an empty list; null ids decode to null and ids without a token give an error; null doc_ids and repeated
rows are rows like others; an empty table gives an empty table; other columns stay, but `ids` and `decoded` replace columns of these names.
"""

from __future__ import annotations

import heapq
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words of more bytes are merged rank by rank.
LONG = 128
#: Runs that a worker process keeps, and the longest of them in characters.
MEMORY, KEPT = 1_250_000, 64
#: Characters that are encoded at once.
SPAN = 1 << 20
NO_RANK = np.int64(1 << 40)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level files: itself where it is printable, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


def alternate(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of ascending places every second one, from the left, where a place's partner (after) is the next place."""
    if len(at) < 2:
        return at
    tied = np.append(False, after[:-1] == at[1:])
    number = np.arange(len(at))
    return at[(number - np.maximum.accumulate(np.where(tied, 0, number))) % 2 == 0]


class Merges:
    """Sorted pair keys of a byte-level BPE model, and the merge rounds."""

    def __init__(self, model: dict):
        if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token") or model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("not a plain byte-pair model")
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        if missing := [x for x in letters for y in (x, x + end) if y not in vocab]:
            raise ValueError(f"no token for the bytes {missing}")
        self.inner = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left, self.right, self.made = (np.array([vocab[x] for x in side], np.int64) for side in ([p[0] for p in pairs], [p[1] for p in pairs], ["".join(p) for p in pairs]))
        made_at = np.full(max(vocab.values()) + 1, -1, np.int64)
        made_at[self.made] = np.arange(len(pairs))  # the last one that makes a token
        if len(pairs) and (np.maximum(made_at[self.left], made_at[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("merges use tokens that are made later")
        self.size = np.int64(len(made_at))
        keys = self.left * self.size + self.right
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, by binary search, or NO_RANK."""
        if not len(self.keys):
            return np.full(len(left), NO_RANK)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of[at], NO_RANK)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as little-endian four-byte integers."""
        sizes = np.array([len(w) for w in words], np.int64)
        long = sizes > LONG
        out = [b""] * len(words)
        for which, merged in ((np.flatnonzero(~long), self._rounds), (np.flatnonzero(long), self._rank_by_rank)):
            lengths = sizes[which]
            if not lengths.sum():
                continue
            data = np.frombuffer(b"".join([words[i] for i in which]), np.uint8)
            symbols = self.inner[data]
            filled = np.cumsum(lengths)[lengths > 0] - 1
            symbols[filled] = self.last[data[filled]]
            symbols, word = merged(symbols, np.repeat(np.arange(len(which)), lengths))
            flat = symbols.astype("<u4").tobytes()
            bounds = np.searchsorted(word, np.arange(len(which) + 1)) * 4
            for i, a, b in zip(which.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                out[i] = flat[a:b]
        return out

    def _rounds(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words at once, the least rank of each in every round. word: ascending numbers."""
        done_symbols, done_words = [], []
        while len(symbols):
            rank = self.ranks(symbols[:-1], symbols[1:])
            rank[word[1:] != word[:-1]] = NO_RANK
            rank = np.append(rank, NO_RANK)
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            sizes = np.diff(np.append(starts, len(word)))
            least = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            going = least < NO_RANK
            done_symbols.append(symbols[~going])
            done_words.append(word[~going])
            at = np.flatnonzero((rank == least) & going)
            at = alternate(at, at + 1)
            symbols[at] = self.made[rank[at]]
            going[at + 1] = False
            symbols, word = symbols[going], word[going]
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order]

    def _rank_by_rank(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All words at once, one rank in every round."""
        n = len(symbols)
        after, before, there = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        border = np.flatnonzero(word[1:] != word[:-1])
        after[border], before[border + 1] = n, -1
        after[n - 1] = n
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def offer(at: np.ndarray) -> None:
            at = at[after[at] < n]
            rank = self.ranks(symbols[at], symbols[after[at]])
            hit = rank < NO_RANK
            if not hit.any():
                return
            at, rank = at[hit], rank[hit]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
            for r, part in zip(rank[cuts].tolist(), np.split(at, cuts[1:]), strict=True):
                if r not in waiting:
                    heapq.heappush(ranks, r)
                waiting.setdefault(r, []).append(part)

        offer(np.arange(n))
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[there[at] & (after[at] < n)]
            at = at[(symbols[at] == self.left[r]) & (symbols[after[at]] == self.right[r])]
            at = alternate(at, after[at])
            gone = after[at]
            symbols[at], there[gone], after[at] = self.made[r], False, after[gone]
            follows = after[at] < n
            before[after[at][follows]] = at[follows]
            offer(np.unique(np.concatenate([at, before[at][before[at] >= 0]])))
        return symbols[there], word[there]


class Codec:
    """Texts to ids and back, for one JSON file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.merges = Merges(config["model"])
        self.bytes_of = {letter: b for b, letter in enumerate(byte_letters())}
        steps = self._steps(config["pre_tokenizer"], "pretokenizers")
        if not any(s["type"] == "ByteLevel" for s in steps) or any(s.get("add_prefix_space") for s in steps):
            raise ValueError("not a byte-level pre-tokenizer")
        decoder = config.get("decoder")
        if decoder is not None and decoder["type"] != "ByteLevel":
            raise ValueError(f"unknown decoder {decoder['type']}")
        self.as_bytes = decoder is not None
        self.marks = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in config["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in config["added_tokens"]):
            raise ValueError("marks that depend on their surroundings")
        self.at_marks = re.compile("(" + "|".join(map(re.escape, sorted(self.marks, key=len, reverse=True))) + ")") if self.marks else None
        # What is outside of the pattern's matches is dropped, and no match has white space: a space is a border.
        split = next((s for s in steps if s["type"] == "Split"), None)
        self.drops_spaces = split is not None and split["behavior"] == "Removed" and split["invert"] and self._words("a b\tc") == self._words("a") + self._words("b") + self._words("c")
        lowers = self.normalizer is not None and self.normalizer.normalize_str("AB") == "ab"
        letters = "a-z" if lowers else "A-Za-z"
        #: The same words as the file's own pattern gives of one-byte characters, where that is the one it was written from.
        self.plain = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^\x09-\x0d {letters}0-9]+") if split is not None and split["pattern"].get("Regex") == PLAIN_OF else None
        self.lowers = lowers
        tokens = {i: t for t, i in config["model"]["vocab"].items()} | {t["id"]: t["content"] for t in config["added_tokens"]}
        self.tokens = [tokens.get(i) for i in range(max(tokens) + 1)]
        self.known: dict[str, bytes] = {}

    @staticmethod
    def _steps(part: dict | None, name: str) -> list[dict]:
        return [] if part is None else part[name] if part["type"] == "Sequence" else [part]

    def _words(self, run: str) -> list[bytes]:
        """The words of a run, as bytes."""
        if self.normalizer is not None:
            run = self.normalizer.normalize_str(run)
        return [bytes(map(self.bytes_of.__getitem__, w)) for w, _ in self.pre_tokenizer.pre_tokenize_str(run)]

    def words(self, run: str) -> list[bytes]:
        if self.plain is None:
            return self._words(run)
        if found := LETTERS.fullmatch(run):
            word, stop = found.groups()
            word = (word.lower() if self.lowers else word).encode()
            return [word, stop.encode()] if stop else [word]
        return [w.encode() for w in self.plain.findall(run.lower() if self.lowers else run)] if run.isascii() else self._words(run)

    def lowered(self, text: str) -> str:
        """What the file lower-cases anyway, letter by letter, where no mark can come of it: fewer runs differ."""
        if not self.lowers or any(m in text for m in self.marks):
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(m in low for m in self.marks) else low

    def _runs(self, text: str) -> list[str]:
        """A text in marks and runs, in order."""
        parts = self.at_marks.split(text) if self.at_marks is not None and any(m in text for m in self.marks) else [text]
        if not self.drops_spaces:
            return parts
        out: list[str] = []
        for k, part in enumerate(parts):
            out += [part] if k % 2 else part.replace("\n", " ").split(" ")
        return out

    def _learn(self, fresh: set[str]) -> dict[str, bytes]:
        runs = [(r, self.words(r)) for r in fresh]
        words = list(dict.fromkeys(w for _, ws in runs for w in ws))
        ids = dict(zip(words, self.merges.encode(words), strict=True))
        return {r: b"".join([ids[w] for w in ws]) for r, ws in runs}

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text as little-endian four-byte integers; about SPAN characters are in work at once."""
        held, size = [], 0
        for text in texts:
            held.append(self._runs(self.lowered(text or "")))
            size += len(text or "")
            if size >= SPAN:
                yield from self._encoded(held)
                held, size = [], 0
        yield from self._encoded(held)

    def _encoded(self, held: list[list[str]]) -> Iterator[bytes]:
        runs = set().union(*held)
        if len(self.known) + len(runs) > MEMORY:
            self.known.clear()
        self.known.update(self.marks)
        fresh = self._learn(runs.difference(self.known))
        long = {r: ids for r, ids in fresh.items() if len(r) > KEPT}
        self.known.update((r, ids) for r, ids in fresh.items() if len(r) <= KEPT)
        look_up = self.known.__getitem__ if not long else lambda r: long[r] if r in long else self.known[r]
        for text in held:
            yield b"".join(map(look_up, text))

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The text of each list of ids; a null list is null."""
        flat = ids.flatten()
        known = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.tokens)))
        tokens = pa.array(self.tokens, pa.string()).take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
        if tokens.null_count:
            raise ValueError("ids without a token")
        sizes = pc.fill_null(pc.list_value_length(ids), 0)
        offsets = np.append(0, np.cumsum(np.asarray(sizes))).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), tokens), "" if self.as_bytes else " ")
        if self.as_bytes:
            joined = pa.array([self._as_text(t) for t in joined.to_pylist()], pa.string())
        return pc.if_else(pc.is_valid(ids), joined, pa.scalar(None, pa.string()))

    def _as_text(self, text: str) -> str:
        parts = self.at_marks.split(text) if self.at_marks is not None else [text]
        return b"".join(p.encode() if k % 2 else bytes(map(self.bytes_of.__getitem__, p)) for k, p in enumerate(parts)).decode("utf-8", "replace")


#: Letters below U+0100, which no composition changes, and perhaps a stop.
LETTERS = re.compile("([A-Za-zªµºÀ-ÖØ-öø-ÿ]+)([.,])?")
# Fixed value: the pattern of the tokenizer whose words of one-byte characters have a pattern of their own.
PLAIN_OF = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def codec(path: str) -> Codec:
    return common.per_process(f"codec {path}", lambda: Codec(path))


def encode(text: Column, path: str) -> Column:
    """The ids (array of int) of a text column with the tokenizer of the file at path, which every executor has."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pa.Array) -> pa.Array:
        pieces = list(codec(path).encode(texts.to_pylist()))
        offsets = np.append(0, np.cumsum([len(p) // 4 for p in pieces])).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(pieces), "<i4")))

    return ids(text)


def decode(ids: Column, path: str) -> Column:
    """The text of a column of ids, special tokens included."""

    @F.arrow_udf(T.StringType())
    def text(lists: pa.Array) -> pa.Array:
        return codec(path).decode(lists)

    return text(ids)


def with_ids(docs: DataFrame, path: str) -> DataFrame:
    """docs with their texts' ids."""
    own = [F.col(f"`{c}`") for c in docs.columns if c != "ids"]
    return docs.select(*own, encode(F.col("text").cast("string"), path).alias("ids"))


def with_decoded(encoded: DataFrame, path: str) -> DataFrame:
    """Rows with a column ids, and the texts that these decode to."""
    own = [F.col(f"`{c}`") for c in encoded.columns if c != "decoded"]
    return encoded.select(*own, decode(F.col("ids"), path).alias("decoded"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    found = with_decoded(with_ids(common.table(spark, sf_dir, "documents").select("doc_id", "text"), path), path)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
