"""BPE encoding and decoding against the tokenizers library."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from umbrascan.llm import bpe

DATA = "/root/testdata/sf0.001"
FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
LETTERS = "abcdeT'sltrevm \n\t\x0b\x1c\x85\xa0éÉΣςσİıßǅ́̀　 ​中日😀١२Ⅷ½0123.,!<|>\x00가"


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_tokenizers.path(request.param)
    return bpe.Codec(path), Tokenizer.from_file(path)


def same(pair, texts):
    codec, library = pair
    got = [np.frombuffer(b, "<u4").tolist() for b in codec.encode(texts)]
    want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got == want
    assert codec.decode(pa.array(got, pa.list_(pa.int32()))).to_pylist() == [library.decode(w, skip_special_tokens=False) for w in want]


def test_odd_letters_and_marks(pair):
    rng, texts = random.Random(3), [None, "", " ", "\n", "a" * 3]
    for _ in range(1500):
        s = "".join(rng.choice(LETTERS) for _ in range(rng.randrange(40)))
        if rng.random() < 0.3:
            s = s[:5] + rng.choice(["<|endoftext|>", "<|startoftext|>", "<|endoftext|", " <|ENDOFTEXT|>"]) + s[5:]
        texts.append(s)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 0xD800), rng.randrange(0xE000, 0x110000), rng.randrange(32, 0x3000)])) for _ in range(30)) for _ in range(1500)]
    same(pair, texts)


def test_long_words(pair):
    rng = random.Random(5)
    texts = ["a" * 5000, "ab" * 3000, "the" * 2000, "é" * 3000, *["".join(rng.choice("etaoinshrdlu") for _ in range(n)) for n in (127, 128, 129, 20_000)]]
    same(pair, texts)


@pytest.mark.parametrize("name,value", [("LONG", 0), ("LONG", 10**9), ("MEMORY", 3), ("KEPT", 2), ("SPAN", 10)])
def test_sizes_change_nothing(pair, monkeypatch, name, value):
    monkeypatch.setattr(bpe, name, value)
    rng = random.Random(7)
    texts = ["".join(rng.choice("aabet hs.'0é") for _ in range(rng.randrange(60))) for _ in range(300)]
    same((bpe.Codec(public_tokenizers.path(FILES[0])), pair[1]) if not pair[0].as_bytes else (bpe.Codec(public_tokenizers.path(FILES[1])), pair[1]), texts)


def small_model(tmp_path, **changed):
    letters = bpe.byte_letters()
    vocab = {x: i for i, x in enumerate(letters)} | {"aa": 256, "aaa": 257, "aab": 258}
    model = {"type": "BPE", "vocab": vocab, "merges": ["a a", "aa a", "aa b"]} | changed
    config = {"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}, "model": model}
    path = tmp_path / "small.json"
    path.write_text(json.dumps(config))
    return str(path)


def test_overlaps_go_from_the_left(tmp_path, monkeypatch):
    path = small_model(tmp_path)
    texts = ["a" * n for n in range(12)] + ["b" + "a" * n + "b" for n in range(12)]
    for long in (0, 100):
        monkeypatch.setattr(bpe, "LONG", long)
        same((bpe.Codec(path), Tokenizer.from_file(path)), texts)


@pytest.mark.parametrize("changed", [{"type": "Unigram"}, {"unk_token": "a"}, {"byte_fallback": True}, {"merges": ["aa a", "a a", "aa b"]}, {"vocab": {"a": 0}}])
def test_other_models_are_refused(tmp_path, changed):
    model = {"type": "BPE", "vocab": {x: i for i, x in enumerate([*bpe.byte_letters(), "aa", "aaa", "aab"])}, "merges": ["a a", "aa a", "aa b"]} | changed
    with pytest.raises((ValueError, KeyError)):
        bpe.Merges(model)


def test_query_matches_the_library_on_whole_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    library = Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = bpe.op12_bpe(spark, DATA)
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_edges_and_clashing_columns(spark):
    path = public_tokenizers.path(FILES[0])
    rows = [(None, "Hello world", 1, "d"), (1, None, 2, "d"), (2, "", 3, "d"), (2, "", 3, "d"), (3, "x " * 50_000, 4, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    got = bpe.with_decoded(bpe.with_ids(docs, path), path)
    assert got.columns == ["doc_id", "text", "ids", "decoded"]
    found = Counter((r["doc_id"], tuple(r["ids"][:2]), len(r["ids"]), r["decoded"][:20]) for r in got.collect())
    hello = tuple(Tokenizer.from_file(path).encode("hello world", add_special_tokens=False).ids)
    x = Tokenizer.from_file(path).encode("x", add_special_tokens=False).ids[0]
    assert found == Counter([(None, hello, 2, "hello</w> world</w>"), (1, (), 0, ""), (2, (), 0, ""), (2, (), 0, ""), (3, (x, x), 50_000, "x</w> x</w> x</w> x<")])
    assert bpe.with_ids(docs.limit(0), path).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [x])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["decoded"] for r in bpe.with_decoded(nulls, path).collect()} == {1: None, 2: "x</w>"}
    with pytest.raises(Exception, match="without a token"):
        bpe.with_decoded(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), path).collect()
