"""Token files and lossless WebP."""

from __future__ import annotations

import base64
import hashlib
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from umbrascan.llm import common, token_files, webp

DATA = "/root/testdata/sf0.001"
public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def expected(rows):
    own, at, out = tokenizer(), 0, []
    for doc_id, text in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, token_files.END_ID]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_files_match_the_tokenizer(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    got = token_files.op9_token_files(spark, DATA)
    assert sorted(tuple(r) for r in got.collect()) == expected(rows)


def test_token_edges(spark):
    texts = [None, "", "Don't stop...,", "ÄÖ ǰ J̌ ÉTÉ", "<|endoftext|> x <|ENDOFTEXT|>", "a b c", "end. x, y.. 's 'S", "word " * 3000, "İΣ ΣΑΣ", "\x1f\x85 \r\n\t z"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    folder = common.new_path(spark, "tokens")
    starts = token_files.write_tokens(docs, folder, TOKENIZER, length=16, rows=4)
    got = token_files.read_tokens(spark, folder, starts, T.LongType())
    assert sorted(tuple(r) for r in got.collect()) == expected(list(enumerate(texts)))
    empty = token_files.write_tokens(docs.limit(0), common.new_path(spark, "tokens"), TOKENIZER)
    assert empty == [] and token_files.read_tokens(spark, folder, empty, T.LongType()).count() == 0


def test_repeated_and_null_ids_are_all_written(spark):
    docs = spark.createDataFrame([(None, "a b"), (1, "c"), (1, "c"), (1, "d e")], "doc_id long, text string")
    folder = common.new_path(spark, "tokens")
    starts = token_files.write_tokens(docs, folder, TOKENIZER)
    rows = sorted((tuple(r) for r in token_files.read_tokens(spark, folder, starts, T.LongType()).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, 1, 1, 1] and [r[1] for r in rows] == [0, 3, 5, 7] or [r[2] for r in rows][0] == 3
    assert all(a[1] + a[2] == b[1] for a, b in zip(rows, rows[1:]))


@given(st.lists(st.lists(st.integers(0, 60_000), min_size=1, max_size=30), max_size=12))
def test_sequences_by_number(runs):
    sink = pa.BufferOutputStream()
    out = token_files.SequenceWriter(sink, np.dtype("<u2"), 8, 2)
    for r in runs:
        out.put(np.array(r, "<u2").tobytes())
    out.close()
    flat = [x for r in runs for x in r]
    held = sink.getvalue()
    file = token_files.Sequences(pa.BufferReader(held))
    for i in range(-(-len(flat) // 8)):
        ids, mask = file.sequence(i)
        assert ids[np.array(mask.to_pylist())].tolist() == flat[8 * i : 8 * i + 8] and len(ids) == len(mask) == 8
        assert mask.buffers()[1].address in range(held.address, held.address + held.size)  # no copy
    at = 0
    for r in runs:
        assert np.concatenate(list(file.run(at, len(r)))).tolist() == r
        at += len(r)
    if len(flat) % 8:
        with pytest.raises(ValueError, match="padding"):
            list(file.run(len(flat) - 1, 2))


# WebP


def test_known_file_of_one_pixel():
    assert webp.decode(base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")).shape == (1, 1)


@settings(deadline=None)
@given(st.binary(max_size=600) | st.text("ab ", max_size=600).map(str.encode))
def test_samples_round_trip(text):
    payload = webp.padded(text)
    assert len(payload) % webp.WIDTH == 0 and payload.startswith(text) and b"".join(webp.load(webp.store(payload))) == payload


def test_long_samples_take_several_files():
    payload = webp.padded(bytes(np.random.default_rng(1).integers(0, 256, webp.WIDTH * (webp.ROWS + 3), np.uint8)))
    media = webp.store(payload)
    assert len(list(webp.files_of(media))) == 2 and b"".join(webp.load(media)) == payload


@settings(deadline=None, max_examples=60)
@given(st.integers(0, 2**32 - 1), st.integers(1, 30), st.integers(1, 30), st.integers(0, 10), st.booleans(), st.booleans(), st.booleans(), st.sampled_from([0, 2, 3]), st.integers(2, 4))
def test_every_transform_round_trips(seed, height, width, cache_bits, predict, cross, subtract, group_bits, bits):
    rng = np.random.default_rng(seed)
    few = rng.integers(0, 2**32, 6, dtype=np.uint64).astype(np.uint32)
    pixels = np.repeat(rng.choice(few, (height, width)), rng.integers(1, 20), 1) if seed % 2 else rng.integers(0, 2**32, (height, width), dtype=np.uint64).astype(np.uint32)
    shape = (webp.blocks(pixels.shape[0], bits), webp.blocks(pixels.shape[1], bits))
    modes = rng.integers(0, 14, shape).astype(np.uint32) << 8 if predict else None
    multipliers = rng.integers(0, 2**24, shape).astype(np.uint32) if cross else None
    assert (webp.decode(webp.encode_pixels(pixels, modes, multipliers, bits, subtract, cache_bits, group_bits)) == pixels).all()


def test_back_references_by_neighbour_and_by_distance():
    assert len(webp.NEIGHBOURS) == 120 and webp.NEIGHBOURS[:5] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2)] and webp.NEIGHBOURS[-1] == (8, 7)
    prefix, extra, bits = webp.prefix_of(np.arange(1, 5000))
    for n, p, e, b in zip(range(1, 5000), prefix.tolist(), extra.tolist(), bits.tolist(), strict=True):
        r = webp.Reader(int(e).to_bytes(4, "little"))
        assert webp.prefix_value(r, p) == n and r.at == b
    w = webp.Writer()
    w.put(0b1011, 32)
    out = np.arange(40, dtype=np.uint32)
    one = (0, np.array([130 << 4 | 0], np.int32))  # no bits: every distance has this prefix
    with pytest.raises(ValueError, match="range"):
        webp.copy(webp.Reader(bytes(40)), out, 3, 8, 2, one)


@pytest.mark.parametrize("data", [b"", b"RIFF", b"RIFF\x04\0\0\0WEBP", b"RIFF\x10\0\0\0WEBPVP8L\x05\0\0\0\x2f\0\0\0\0\0"])
def test_broken_files_are_refused(data):
    with pytest.raises(ValueError):
        webp.decode(data)


def test_media_columns(spark):
    good = webp.encode_pixels(np.array([[0xFF102030, 0x01020304]], np.uint32))
    rows = spark.createDataFrame([(1, bytearray(good)), (2, None), (3, bytearray(b"junk"))], "image_id long, media binary")
    got = {r["image_id"]: r["image"] for r in webp.decode_images(rows, "media").collect()}
    assert (got[1]["width"], got[1]["height"], bytes(got[1]["rgba"])) == (2, 1, bytes([0x10, 0x20, 0x30, 0xFF, 0x02, 0x03, 0x04, 0x01]))
    assert got[2]["rgba"] is None and got[2]["error"] == "null" and got[3]["rgba"] is None and got[3]["error"]


def test_documents_match_their_payloads(spark):
    rows = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    for r in webp.op10_webp_media(spark, DATA).collect():
        text = (rows[r["doc_id"]] or "").encode()
        payload = webp.padded(text)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    docs = spark.createDataFrame([(1, None), (1, None), (2, "x" * 300_000), (3, "é")], "doc_id long, text string").withColumn("media", F.lit(0))
    got = webp.store_documents(docs).collect()
    assert sorted(r["n_bytes"] for r in got) == [0, 0, 2, 300_000] and webp.store_documents(docs.limit(0)).count() == 0
