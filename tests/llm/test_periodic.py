"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import pytest

from umbrascan.llm import periodic

DATA = "/root/testdata/sf0.001"


def plain_runs(words, least=24, times=3):
    """Every stretch with words q apart equal, extended as far as it goes, period by period; longer periods of a stretch known already are no smallest ones."""
    n, seen, out = len(words), set(), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] == words[i + q]:
                j = i
                while j + q < n and words[j] == words[j + q]:
                    j += 1
                if j + q - i >= max(least, times * q) and (i, j + q) not in seen:
                    seen.add((i, j + q))
                    out.append((i, j + q - i, q))
                i = j
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_row(doc_id, text):
    words = words_of(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    milli = None if top[0] is None else 1000 * top[1] // top[2]
    return (doc_id, len(runs), *top, milli, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_matches_brute_force_on_whole_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    got = periodic.op11_periodic_runs(spark, DATA)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    found = [tuple(r) for r in got.collect()]
    assert Counter(found) == Counter(plain_row(*r) for r in rows)
    assert sum(r[1] > 0 for r in found) > 10


@pytest.mark.parametrize("least,times", [(24, 3), (6, 3), (4, 2), (10, 4), (7, 3)])
def test_runs_of_small_alphabets_match_brute_force(least, times):
    rng = random.Random(least * times)
    for _ in range(150):
        texts = []
        for _ in range(rng.randrange(1, 5)):
            words = []
            while len(words) < rng.randrange(0, 80):
                block = [rng.randrange(rng.choice([2, 3, 9])) for _ in range(rng.randrange(1, 7))]
                words += block if rng.random() < 0.5 else (block * 8)[: rng.randrange(1, 40)]
            texts.append(words)
        assert periodic.runs_in(texts, least, times) == [plain_runs(w, least, times) for w in texts]


def test_window_is_never_too_long():
    for least in range(2, 60):
        for times in range(2, 7):
            for q in range(1, 60):
                assert periodic.window(least, times) == 1 or max(least, times * q) >= 2 * q + periodic.window(least, times) - 1


def test_long_runs_take_no_square_time():
    assert periodic.runs_in([["a"] * 200_000, ["b"]]) == [[(0, 200_000, 1)], []]
    words = [f"w{i % 4999}" for i in range(60_000)]
    assert periodic.runs_in([words]) == [[(0, 60_000, 4999)]]


def test_leaves_are_tried_in_parts(monkeypatch):
    rng = random.Random(4)
    words = [rng.randrange(3) for _ in range(400)] + [1, 2, 0] * 20
    monkeypatch.setattr(periodic, "TRIED", 7)
    assert periodic.runs_in([words], 6, 3) == [plain_runs(words, 6, 3)]


def test_groups_keep_texts_apart(monkeypatch):
    monkeypatch.setattr(periodic, "SPAN", 5)
    texts = [b"a b c d e f", None, b"", b"a\x0bb\x1cc \xc2\xa0", b"x " * 3]
    assert [len(g) for g in periodic.groups(texts)] == [1, 4]
    assert list(periodic.groups(texts))[1][2] == [b"a", b"b\x1cc", b"\xc2\xa0"]


def test_edges_and_clashing_columns(spark):
    schema = "doc_id long, text string, runs int, found string, row string, n_chars long, top int"
    row = lambda i, t: (i, t, 1, "f", "r", 5, 2)
    tail = " ".join(["tick tock"] * 15)
    rows = [row(None, "a " * 30), row(1, None), row(2, ""), row(3, " \n\t"), row(4, f"start {tail} end"), row(4, f"start {tail} end"), row(5, "one"), row(6, "é " * 24), row(7, "é " * 23)]
    docs = spark.createDataFrame(rows, schema)
    found = periodic.with_runs(docs)
    assert found.columns == ["doc_id", "text", "found", "row", "n_chars", "top", "runs", "collapsed"]
    by_id = {}
    for r in found.collect():
        by_id.setdefault(r["doc_id"], []).append(([tuple(x) for x in r["runs"]], r["collapsed"], r["found"]))
    assert by_id[None] == [([(0, 30, 1)], "a", "f")] and by_id[1] == by_id[2] == by_id[3] == [([], "", "f")]
    assert by_id[4] == [([(1, 30, 2)], "start tick tock end", "f")] * 2 and by_id[5] == [([], "one", "f")]
    assert by_id[6] == [([(0, 24, 1)], "é", "f")] and by_id[7][0][0] == []
    cut = {r["doc_id"]: r for r in periodic.collapse(docs).collect()}
    assert cut[4]["text"] == "start tick tock end" and cut[4]["n_chars"] == 19 and cut[3]["text"] == " \n\t" and cut[1]["text"] is None and cut[1]["n_chars"] is None
    assert cut[5]["runs"] == 1 and cut[7]["text"] == "é " * 23
    assert periodic.with_runs(docs.limit(0)).count() == 0
    assert periodic.planted(docs).count() == len(rows)


def test_query_edges(spark, tmp_path):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:12]
    rng = random.Random(9)
    texts = [None, "", " ", "one", "one two", " ".join(f"w{i}" for i in range(100)), "é ü " * 40, *[" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(200))) for _ in range(5)]]
    rows = [*zip(ids, texts, strict=True), (None, "a " * 40), (ids[5], texts[5]), (10**12, "a b " * 30 + "c " * 40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert Counter(tuple(r) for r in periodic.op11_periodic_runs(spark, str(tmp_path)).collect()) == Counter(plain_row(*r) for r in rows)
