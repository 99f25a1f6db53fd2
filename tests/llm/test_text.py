"""Toxicity, language ID, licences, chats and packing."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from umbrascan.llm import chat, langid, licenses, packing, toxicity

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row int, at string, words int"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 0.5, 1, "a", 2) for i, t, lang in rows], SCHEMA)


# Toxicity


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


TERMS = [("idiot", False), ("worthless", False), ("disgusting", False), ("scum", False), ("achkei", True), ("bom", True)]


@settings(max_examples=300)
@given(st.sampled_from([t for t, _ in TERMS]), st.lists(st.tuples(st.integers(0, 12), st.sampled_from("aeio stx")), max_size=3), st.text("aeinst", max_size=3))
def test_automaton_finds_the_nearest_term(term, changes, tail):
    word = term + tail
    for at, c in changes:
        word = word[:at] + (c + word[at:] if c in "ae" else word[at + 1 :] if c == " " else c + word[at + 1 :])
    word = word.replace(" ", "")
    off = {t: min(distance(word[:i], t) for i in range(len(word) + 1)) if stem else distance(word, t) for t, stem in TERMS}
    expected = [(n, t) for t, n in off.items() if n <= toxicity.edits(t, dict(TERMS)[t])]
    matcher = toxicity.Matcher(TERMS, set())
    found = toxicity.best_hit(word, matcher.root)
    assert found == (min(expected)[1], min(expected)[0]) if expected else found is None
    assert matcher.may_hit(word) or not expected


def test_context_lowers_quoted_and_reported_hits():
    score = lambda t: toxicity.Matcher([("idiot", False)], set()).features(t)[0]
    assert score("you are an idiot") > score('he called me an "idiot" once') > 0
    assert score("the word idiot is an insult") < score("you idiot there")
    matcher = toxicity.Matcher([("idiot", False)], {"idiom"})
    assert matcher.of_word("1d10t") == 1 and matcher.of_word("idioot") == 1 and matcher.of_word("idiom") == -1 and matcher.of_word("ordinary") == -1
    assert toxicity.Matcher([], set()).features("anything") == [0.0, 0.0, 0.0, pytest.approx(np.log(2))]


def test_toxicity_is_learned_from_rows_not_held_out(spark):
    got = toxicity.op1_toxicity(spark, DATA)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = {r["doc_id"]: r for r in got.collect()}
    documents_ = duckdb.sql(f"SELECT count(*) FROM '{DATA}/documents.parquet'").fetchall()[0][0]
    assert len(rows) == documents_ and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    labels = duckdb.sql(f"SELECT doc_id, toxic FROM '{DATA}/labels.parquet'").fetchall()
    held = [(rows[i]["score"], y) for i, y in labels if i in rows and rows[i]["held_out"]]
    pos, neg = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.85


def test_toxicity_edges(spark):
    docs = documents(spark, [(1, None, "en"), (2, "", "en"), (2, "", "en"), (3, "x" * 200_000, "en"), (4, "you idiot", None)])
    labels = spark.createDataFrame([(4, 1, None), (4, 0, 1)], "doc_id long, quality int, toxic int")
    scored = toxicity.score_toxicity(docs, labels)
    assert scored.columns == [*docs.columns, "toxicity"] and all(0 <= r["toxicity"] <= 1 for r in scored.collect()) and scored.count() == 5
    assert toxicity.score_toxicity(docs.limit(0), labels.limit(0)).count() == 0


# Language


def test_language_accuracy_and_und(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{DATA}/documents.parquet'").fetchall())
    rows = langid.op4_language_id(spark, DATA).collect()
    assert len(rows) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in rows)


def test_language_edges(spark):
    docs = documents(spark, [(1, "the quick brown fox " * 30, "en"), (3, "der schnelle braune Fuchs " * 30, "de"), (4, None, "en"), (5, "", None), (6, "12 345 --", "en"), (7, "der braune Fuchs " * 40_000, None)])
    got = {r["doc_id"]: r["_lang"] for r in langid.identify(docs).collect()}
    assert [got[i]["lang_pred"] for i in (4, 5, 6)] == ["und"] * 3 and got[6]["score"] == 0
    assert got[7]["lang_pred"] in ("en", "de")
    unknown = langid.identify(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {r["_lang"]["lang_pred"] for r in unknown.collect()} == {"und"}
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and not {4, 5, 6} & {r["doc_id"] for r in kept.collect()}
    assert langid.keep_known(docs.limit(0)).count() == 0


def test_convolution_by_tables_is_the_plain_one():
    rng = np.random.default_rng(0)
    filters = [rng.normal(size=(w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS]
    rows = langid.to_windows(bytes(rng.integers(0, 256, 700, np.uint8)))
    fast = langid.convolve(rows, langid.tables(filters))
    slow = np.concatenate([sum(w[i][rows[:, i : i + langid.WINDOW]] for i in range(len(w))) for w in filters], 2)
    assert np.allclose(fast, slow, atol=1e-4)


# Licences


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def base_places(text):
    w, found = words(text), []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    places = [i for i, _ in found]
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_licences_match_brute_force_on_whole_documents(spark):
    truth = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    rows = licenses.op5_license_scan(spark, DATA).collect()
    assert {r["doc_id"]: tuple(r)[1:6] for r in rows} == {i: base_places(t) for i, t in truth.items()}
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in rows)


@pytest.mark.parametrize(
    ("expression", "labels", "freedom"),
    [
        ("mit", {"mit"}, 1.0), ("gpl-3.0-or-later or apache-2.0", {"gpl", "apache"}, 0.95), ("mit and (gpl-2.0 or bsd-3-clause)", {"mit", "gpl", "bsd"}, 1.0),
        ("gpl-2.0 with classpath-exception-2.0 and mit", {"gpl", "mit"}, 0.5), ("mit or or gpl", {"mit", "gpl"}, 0.4), ("(", None, None),
    ],
)
def test_expressions(expression, labels, freedom):
    got = licenses.evaluate(expression)
    assert got is None if labels is None else got[0] == labels and got[1] == pytest.approx(freedom)


@pytest.mark.parametrize(
    ("line", "labels"),
    [
        ("see the file called copying for details", None), ("mit */ int main(void)", {"mit"}), ("mit or foo-1.0", {"mit", "foo-1.0"}), ("(mit or isc) -->", {"mit", "isc"}), ("apache-2.0.", {"apache"}),
        ("licenseref-house and mit", {"licenseref-house", "mit"}), ("gpl-2.0 with linux-syscall-note", {"gpl"}), ("unheard-of-1.0", {"unheard-of-1.0"}), ("x11 or mit", {"x11", "mit"}), ("mit and x11", {"mit", "x11"}),
        ("cc-by-nc-sa-4.0", {"cc-by-nc-sa"}), ("mit and here is why", {"mit"}), ("see file", None), ("mit and", {"mit"}), ("(mit or x11) see", {"mit", "x11"}), ("gpl-2.0 with foo some prose", {"gpl"}),
    ],
)
def test_only_licences_become_labels(line, labels):
    got = licenses.evaluate(line)
    assert got is None if labels is None else got[0] == labels


def test_unknown_licences_count_in_and_and_or():
    assert licenses.evaluate("mit and x11")[1] == licenses.UNKNOWN_FREEDOM and licenses.evaluate("x11 or mit")[1] == 1.0
    assert licenses.evaluate("x11 or gpl-3.0")[1] == licenses.UNKNOWN_FREEDOM and licenses.evaluate("x11 and gpl-3.0")[1] == licenses.FREEDOM["gpl"]


def test_toxic_terms_are_the_same_however_rows_are_dealt(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    sample = toxicity.labelled_sample(docs, labels)
    before, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in (2, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        rows = toxicity.term_counts(sample.repartition(parts)).collect()
        found.append(({tuple(r) for r in rows}, toxicity.lexicon(sample.repartition(parts))))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1] and len(found[0][0]) > 1000


def test_nested_stems_by_plain_search():
    row = lambda term, stem, n: {"term": term, "stem": stem, "n_toxic": n}
    rows = [row(f"gramble{x}", False, 3) for x in ("d", "r", "s", "ful")] + [row("gram", True, 12), row("gramb", True, 12), row("gramble", True, 12), row("grab", False, 5), row("zz", False, 9)]
    assert toxicity.choose_terms(rows) == [("gramble", True), ("grab", False), ("zz", False)]
    assert toxicity.beginning(["a", "ab", "abc", "ac", "b"], "ab") == ["ab", "abc"]


def test_licence_edges(spark):
    texts = [None, "", "MIT License mit-license", "cc by cc by", "cc cc by", "SPDX-License-Identifier: MIT OR (GPL-2.0 AND MIT)\nx", "Éclair Apache\nLICENSE" + " x" * 100_000, "gnu general public license"]
    docs = documents(spark, [(i, t, "en") for i, t in enumerate(texts)])
    rows = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(docs).collect()}
    assert all(tuple(rows[i])[:5] == base_places(t) for i, t in enumerate(texts))
    assert rows[5]["labels"] == "gpl,mit" and rows[0]["labels"] == "" and rows[0]["score"] == 0 and rows[3]["n_base"] == 2


# Chats


@given(st.lists(st.tuples(st.text("ab:#<\\ \n/", max_size=6), st.text("ab:#<\\/turn> \n###é", max_size=20)), max_size=5))
def test_formatted_turns_read_back(turns):
    text, spans = chat.render(turns)
    assert chat.read_back(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_conversations_match_brute_force(spark):
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{DATA}/conversations.parquet'").fetchall() + chat.EXTRA
    expected = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        expected.setdefault(conv, []).append((role, text or ""))
    got = {r["conv_id"]: r for r in chat.op6_chat_formatting(spark, DATA).collect()}
    assert got.keys() == expected.keys()
    for conv, turns in expected.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[conv])[1:5] == (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
        assert got[conv]["formatted_chars"] == len(chat.render(turns)[0])


def test_best_branch_of_a_tree(spark):
    tree = [(1, None, "user", "q", 1.0), (2, 1, "assistant", "bad", 0.1), (3, 1, "assistant", "good", 0.9), (4, 3, "user", "thanks", 0.8), (5, 2, "user", "no", 0.2)]
    rows = spark.createDataFrame([("t", *r) for r in tree] + [("u", 9, 7, "user", "orphan", 0.0), ("u", 8, 9, None, None, 0.0)], "tree string, node long, parent long, role string, text string, score double")
    rows = rows.fillna("", ["role", "text"])
    got = {(r["tree"], r["rank"]): chat.read_back(r["formatted"]) for r in chat.format_trees(rows, top=2).collect()}
    assert got[("t", 1)] == [("user", "q"), ("assistant", "good"), ("user", "thanks")]
    assert got[("t", 2)] == [("user", "q"), ("assistant", "bad"), ("user", "no")]
    assert got[("u", 1)] == [("user", "orphan"), ("", "")]


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = spark.createDataFrame([(1, None, None, None), (1, 2, "user", "b"), (1, 2, "user", "b"), (None, 1, "assistant", "x" * 100_000), (2, 1, "user", "hi")], schema)
    got = {r["tree"]: chat.read_back(r["formatted"]) for r in chat.format_trees(chat.conversation_messages(rows)).collect()}
    assert got == {"c1": [("", ""), ("user", "b"), ("user", "b")], "null": [("assistant", "x" * 100_000)], "c2": [("user", "hi")]}
    assert chat.format_trees(chat.conversation_messages(rows.limit(0))).count() == 0
    with pytest.raises(ValueError, match="cycle"):
        loop = spark.createDataFrame([("t", 1, 2, "u", "a", 1.0), ("t", 2, 1, "u", "b", 1.0)], "tree string, node long, parent long, role string, text string, score double")
        chat.format_trees(loop)


# Packing


@given(st.dictionaries(st.integers(0, 30), st.integers(1, 9), min_size=1, max_size=8), st.integers(1, 4))
def test_boundaries_have_the_least_padding(histogram, buckets):
    lengths = sorted(histogram)
    cost = lambda tops: sum(n * (min(t for t in tops if t >= x) - x) for x, n in histogram.items())
    best = min(cost([*c, lengths[-1]]) for k in range(min(buckets, len(lengths))) for c in combinations(lengths[:-1], k))
    assert cost(packing.boundaries(lengths, [histogram[x] for x in lengths], buckets)) == best


def test_packing_keeps_every_token_within_budget(spark):
    texts = [None, "", "a", "a b", "w " * 5000, "w " * 5000] + [f"{'x ' * (i % 37)}" for i in range(300)]
    docs = documents(spark, [(i // 2, t, "en") for i, t in enumerate(texts)])
    rows = packing.pack(docs, max_length=64, buckets=4, budget=256).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(len((t or "").split()) for t in texts)
    pieces = Counter((r["doc_id"], r["piece"], r["n_tokens"]) for r in rows)
    expected = Counter((i // 2, k, min(64, len((t or "").split()) - 64 * k)) for i, t in enumerate(texts) for k in range(max(1, -(-len((t or "").split()) // 64))))
    assert pieces == expected
    batches = Counter((r["bucket"], r["shard"], r["batch"]) for r in rows)
    assert all(n * max(1, bucket) <= 256 for (bucket, _, _), n in batches.items()) and all(r["n_tokens"] <= r["bucket"] and r["start"] == 64 * r["piece"] for r in rows)
    assert len({(r["bucket"], r["shard"], r["batch"], r["slot"]) for r in rows}) == len(rows)
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_does_not_depend_on_tasks(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    one, other = (Counter(tuple(r) for r in packing.pack(d, budget=2048).collect()) for d in (docs, docs.repartition(7)))
    assert one == other
    given = packing.pack(docs, length=F.lit(5000)).groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()
    assert all(r["n"] == 5000 for r in given)


def test_terms_with_look_alikes_are_exact_hits():
    matcher = toxicity.Matcher([("ab12cd", False), ("idiot", False)], set())
    assert [matcher.of_word(w) for w in ("ab12cd", "idiot", "1diot", "unrelated")] == [0, 0, 1, -1]
