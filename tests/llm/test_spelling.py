"""Spelling variants against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from umbrascan.llm import common, queries, spelling

DATA = "/root/testdata/sf0.001"


def near(a, b):
    """Exactly one inserted, deleted or replaced letter."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    by_size = {}
    for w in counts:
        by_size.setdefault(len(w), []).append(w)
    form, rows = {}, []
    for w, n in counts.items():
        found = [x for k in (len(w) - 1, len(w), len(w) + 1) for x in by_size.get(k, []) if near(w, x)]
        best = min(found, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
        rows.append((w, n, len(found)))
    out = []
    for w, n, k in rows:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, k, counts[form[w]] if form[w] else None))
    return Counter(out)


def plain_query(documents):
    counts = Counter()
    for doc_id, text in documents:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return plain_variants({w: n for w, n in counts.items() if len(w) >= 7 and n >= 2})


def collected(df):
    return Counter(tuple(r) for r in df.collect())


def test_query_matches_brute_force_and_sql_on_whole_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    got = spelling.op13_spelling_variants(spark, DATA)
    assert got.dtypes == [("word", "string"), ("form", "string"), ("root", "string"), ("n", "bigint"), ("n_near", "bigint"), ("form_n", "bigint")]
    want = plain_query(rows)
    assert collected(got) == want and sum(r[1] is not None for r in want) > 3
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert Counter(con.sql(spelling.SQL).fetchall()) == want


def some_words(rng, letters, size, n):
    words = {"".join(rng.choice(letters) for _ in range(size + rng.randrange(3))) for _ in range(n)}
    for w in rng.sample(sorted(words), min(len(words), n // 2)):
        i = rng.randrange(len(w))
        words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:]]))
    return {w: 10 ** rng.randrange(1, 6) + rng.randrange(9) for w in words}


@pytest.mark.parametrize("letters,size", [("ab", 6), ("aé", 7), ("abcdefghÿ", 8)])
def test_both_ways_to_meet_match_brute_force(spark, letters, size):
    counts = some_words(random.Random(size), letters, size, 80)
    words = common.settle(spark.createDataFrame(list(counts.items()), "word string, n long"), "words")
    want = plain_variants(counts)
    for long in (0, size, size + 1, 64):
        assert collected(spelling.variants(words, long)) == want


def test_chains_end_in_one_root(spark):
    counts = {"harbours": 2, "harbour": 30, "harbor": 500, "arbor": 7000, "arbors": 7000, "harbxyz": 9, "gardens": 3, "gardena": 29}
    words = common.settle(spark.createDataFrame(list(counts.items()), "word string, n long"), "words")
    found = {r["word"]: r for r in spelling.variants(words).collect()}
    assert [found["harbours"][c] for c in ("form", "root", "form_n", "n_near")] == ["harbour", "arbor", 30, 1]
    assert found["harbor"]["form"] == "arbor" and found["arbor"]["root"] == "arbor" and found["arbor"]["form"] is None and found["harbxyz"]["n_near"] == 0
    assert found["gardens"]["form"] is None and found["gardens"]["root"] == "gardens"  # 29 is less than ten times 3
    assert collected(spelling.variants(words)) == plain_variants(counts)


def test_very_long_words(spark):
    rng = random.Random(3)
    base = "".join(rng.choice("abc") for _ in range(30_000))
    counts = {base: 50, base[:9000] + base[9001:]: 3, base[:20_000] + "x" + base[20_001:]: 4, base[:1] + "é" + base[1:]: 700, base[:64]: 2, base[:65]: 30, "z" * 64: 2, "z" * 63 + "y": 20, "y" + "z" * 64: 300}
    words = common.settle(spark.createDataFrame(list(counts.items()), "word string, n long"), "words")
    assert collected(spelling.variants(words)) == plain_variants(counts)


def test_query_edges(spark, tmp_path):
    rows = [(None, "Harbour harbour harbour"), (1, None), (2, ""), (3, "short 123 --"), (4, "ÉCOLIÈRE écolière Écolière É×÷ÿabcd É×÷ÿABCD"), (4, "Harbour"), (4, "Harbour")]
    rows += [(i, "lanterns gardener lanterns " * 3) for i in range(10, 90)]
    for name, some in (("some", rows), ("none", [])):
        spark.createDataFrame(some, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert collected(spelling.op13_spelling_variants(spark, f"{tmp_path}/{name}")) == plain_query(some)
    assert "op13_spelling_variants" in queries.SQL
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/some/documents.parquet/*.parquet'")
    assert Counter(con.sql(spelling.SQL).fetchall()) == plain_query(rows)
