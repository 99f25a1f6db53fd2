"""Line dedup, SimHash near-dedup and decontamination against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from itertools import combinations

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from umbrascan.llm import common, decontam, line_dedup, simhash_dedup

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, gone int, fp double, lines string, hit int, pieces string, own_id int, code long"


def documents(spark, rows):
    """rows of (doc_id, text), with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 7, 0.5, "l", 1, "p", 2, 3) for i, t in rows], SCHEMA)


def shuffled(spark, monkeypatch):
    """Nothing is broadcast: not by the operators, and not by Spark itself."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        before = spark.conf.get(name, None)
        spark.conf.set(name, "-1")
        SWITCHED.append((name, before))


SWITCHED = []


@pytest.fixture(autouse=True)
def thresholds(spark):
    yield
    while SWITCHED:
        name, before = SWITCHED.pop()
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {n: find(n) for n in nodes}


def test_components_match_union_find(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    found = {r["node"]: r["root"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    pairs = {frozenset(e) for e in edges}
    nodes = sorted({n for a, b in edges if a != b for n in (a, b)})
    assert found == components(nodes, lambda a, b: frozenset((a, b)) in pairs)
    assert common.connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# SimHash near-duplicates


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(rows):
    prints = [(i, fingerprint(t)) for i, t in rows]
    roots = components(sorted({p for _, p in prints}), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for i, p in prints:
        least[roots[p]] = min(i, least.get(roots[p], i))
    return Counter((i, f"{p:016x}", least[roots[p]]) for i, p in prints)


def test_simhash_matches_brute_force_on_whole_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    got = simhash_dedup.op7_simhash_near_dedup(spark, DATA)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert Counter(tuple(r) for r in got.collect()) == near_duplicates(rows)


def test_simhash_edges(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(5, None), (6, ""), (7, " \n\t"), (1, base), (2, base.upper()), (3, base + " tail"), (3, base + " tail"), (8, "one"), (9, "two words"), (10, "É a b")]
    docs = documents(spark, rows)
    assert Counter(tuple(r) for r in simhash_dedup.near_duplicates(docs).collect()) == near_duplicates(rows)
    assert simhash_dedup.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    least = {c for _, _, c in near_duplicates(rows)}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(least)


def test_links_find_every_pair_within_two_bits(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(40)}
    prints |= {p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in list(prints)} | {p ^ 1 << 63 for p in list(prints)[:5]}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    got = {frozenset(r) for r in simhash_dedup.fingerprint_links(spark.createDataFrame([(s,) for s in signed.values()], "fp long")).collect()}
    assert got == {frozenset((signed[a], signed[b])) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= 2}


# Decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def contamination(rows, items):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if g := grams.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= g
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


def test_decontamination_matches_brute_force_on_whole_documents(spark):
    read = lambda t, c: duckdb.sql(f"SELECT {c}, text FROM '{DATA}/{t}.parquet'").fetchall()
    got = Counter(tuple(r) for r in decontam.op8_benchmark_decontamination(spark, DATA).collect())
    assert got == contamination(read("documents", "doc_id"), read("benchmark", "item_id"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert got == Counter(con.execute(decontam.SQL).fetchall())


def test_decontamination_edges(spark):
    long = " ".join(f"v{i}" for i in range(25))
    items = [(1, long), (2, "Tiny item"), (3, None), (4, " .,- "), (5, "tiny ITEM"), (6, "Ünïcode wörd")]
    rows = [(1, None), (2, ""), (3, "x " + long.upper() + " y"), (3, "x " + long.upper() + " y"), (4, " ".join(long.split()[:9])), (5, "a tiny-item, tiny item"), (6, "ünïcode, wörd"), (7, " ".join(long.split()[5:15])), (8, long + " " + long)]
    docs, benchmark = documents(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.report(decontam.contamination(docs, benchmark))
    assert Counter(tuple(r) for r in got.collect()) == contamination(rows, items)
    kept = decontam.decontaminate(docs, benchmark)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 6]
    cut = {r["doc_id"]: r for r in decontam.decontaminate(docs, benchmark, remove="spans").collect()}
    assert cut[3]["text"].split() == ["x", "y"] and cut[4]["text"] == rows[4][1] and cut[5]["text"] == "a" and cut[3]["n_chars"] == len(cut[3]["text"])
    assert decontam.decontaminate(docs, benchmark.limit(0)).count() == len(rows)
    assert decontam.report(decontam.contamination(docs.limit(0), benchmark)).count() == 0


# Lines


def line_print(w):
    def h(i):
        first = xxhash.xxh64_intdigest(w[i].encode(), 42)
        return xxhash.xxh64_intdigest(w[i + 1].encode(), first) if len(w[i].encode()) <= line_dedup.SHORT and i + 1 < len(w) else first

    def votes(hashes):
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))

    hashes = [h(i) for i in range(len(w))]
    parts = [votes(hashes[i : i + line_dedup.PART]) for i in range(0, len(hashes), line_dedup.PART)]
    return parts[0] if len(parts) == 1 else votes(parts)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def normal(line):
    return tuple(w for w in re.split(r"[\W_]+", line.lower()) if w)


def similar_words(a, b):
    """Edit similarity of 0.8 or more; lines with too few words in common are too far apart whatever their order."""
    most = max(len(a), len(b))
    if min(len(a), len(b)) * 5 < most * 4 or sum((Counter(a) & Counter(b)).values()) < most - most // 5:
        return False
    return edit_distance(a, b) <= most // 5


def deduped(rows):
    """The kept texts by edit similarity of words alone, over all pairs of distinct lines."""
    places = {}
    for i, t in rows:
        for k, line in enumerate(t.split("\n") if t else ()):
            if w := normal(line):
                places.setdefault(w, []).append((i, k))
    roots = components(sorted(places), similar_words)
    first = {}
    for w, ps in places.items():
        first[roots[w]] = min([*ps, first.get(roots[w], ps[0])])
    keep = lambda i, k, line: not normal(line) or first[roots[normal(line)]] == (i, k)
    return {i: None if t is None else "\n".join(line for k, line in enumerate(t.split("\n")) if keep(i, k, line)) for i, t in rows}


def test_lines_match_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in ("ln", "rt", "")] + ["the", "of", "and", "un"]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice((1, 3, 4, 5, 8, 20, 40)))] for _ in range(25)]

    def line():
        w = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 2, 3))):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice(([], [rng.choice(vocabulary)], [w[k], rng.choice(vocabulary)]))
            w = w or ["x"]
        return " ".join(w).capitalize() + rng.choice(("", ".", "!"))

    rows = [(i, "\n".join(rng.choice((line(), line(), "", "--")) for _ in range(rng.randrange(1, 7)))) for i in range(70)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert got == deduped(rows)


def test_line_query_matches_brute_force_on_whole_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall()
    digest = lambda t: None if t is None else hashlib.sha256(t.encode()).hexdigest()
    wanted = [(i, len(t.split("\n")) if t else 0, None if t is None else len(t), digest(t)) for i, t in deduped(rows).items()]
    assert Counter(tuple(r) for r in line_dedup.op2_line_dedup(spark, DATA).collect()) == Counter(wanted)


def found_of(spark, pairs):
    """The share of pairs of lines (as words, no line twice) that end in one group."""
    rows = [(2 * i + k, " ".join(p[k])) for i, p in enumerate(pairs) for k in (0, 1)]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    return sum(not kept[2 * i + 1] for i in range(len(pairs))) / len(pairs)


def changed(rng, words, edits):
    """Words with so many edits at places apart: another word, one more, or one less."""
    out = list(words)
    for k in rng.sample(range(len(words)), edits):
        fresh = f"changed{rng.randrange(1000)}"
        out[k] = rng.choice(([], [fresh], [words[k], fresh]))
    return [w for x in out for w in (x if isinstance(x, list) else [x])]


def test_recall_by_length_against_edit_similarity_alone(spark):
    """Lines of sf0.01, changed as far as the limit allows and half as far."""
    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL AND doc_id % 5 = 0").fetchall()
    lines = sorted({normal(line) for (t,) in texts for line in t.split("\n")} - {()})
    rng, found = random.Random(8), {}
    for low, high in ((5, 9), (10, 24), (25, 39), (40, 300)):
        some = [w for w in lines if low <= len(w) <= high]
        some = rng.sample(some, min(120, len(some)))
        for part in (1, 2):
            pairs = [(w, changed(rng, w, max(1, len(w) // 5 // part))) for w in some]
            found[low, part] = found_of(spark, [p for p in pairs if similar_words(*map(tuple, p))])
    print(found)
    assert all(v >= 0.9 for v in found.values()) and all(v >= 0.97 for (_, part), v in found.items() if part == 2) and found[5, 1] == 1, found


def test_recall_of_all_similar_pairs_of_whole_documents(spark):
    """Every similar pair of lines of four words and more of sf0.01, found by an inverted index over words and edit similarity alone."""
    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL").fetchall()
    lines = sorted(w for w in {normal(line) for (t,) in texts for line in t.split("\n")} if len(w) >= 4)
    by_word = {}
    for k, w in enumerate(lines):
        for x in set(w):
            by_word.setdefault(x, []).append(k)
    pairs = []
    for k, w in enumerate(lines):
        # A similar line has one of any len // 5 * 2 + 1 words: the rarest ones give the fewest to compare with.
        rare = sorted(w, key=lambda x: len(by_word[x]))[: len(w) // 2 + 1]
        pairs += [(w, lines[o]) for o in {o for x in rare for o in by_word[x] if o > k} if similar_words(w, lines[o])]
    assert len(pairs) > 300
    _, changed_lines = line_dedup.line_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    roots = {r["h1"]: r["root"] for r in changed_lines.collect()}
    both = sorted({w for p in pairs for w in p})
    numbers = spark.createDataFrame([(i, list(w)) for i, w in enumerate(both)], "i int, words array<string>").select("i", F.xxhash64("words").alias("h1")).collect()
    group = {both[r["i"]]: roots.get(r["h1"], r["h1"]) for r in numbers}
    apart = [p for p in pairs if group[p[0]] != group[p[1]]]
    print(len(apart), "of", len(pairs))
    assert len(apart) <= 0.02 * len(pairs)


def template(n):
    """Lines that share a long passage and are not similar: nothing to remove."""
    return [(i, " ".join([f"passage{k}" for k in range(20)] + [f"own{i}{k}" for k in "abcdefgh"])) for i in range(n)]


def test_lines_of_a_template_take_work_in_proportion(spark):
    met = {}
    for n in (500, 1000):
        docs = documents(spark, template(n))
        lines = line_dedup.distinct_lines(line_dedup.occurrences(docs), "sim")
        met[n] = line_dedup.candidates(line_dedup.buckets(lines, docs)).count()
    assert met[1000] <= 3 * met[500] and met[1000] <= 40 * 1000, met
    rows = template(300) + [(300 + i, t + " more") for i, t in template(60)]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    assert all(kept[i] for i in range(300)) and sum(not kept[300 + i] for i in range(60)) >= 54


@pytest.mark.parametrize("setting", ["no broadcast", "crowded buckets"])
def test_lines_beyond_the_size_switches(spark, monkeypatch, setting):
    rng = random.Random(4)
    base = [f"word{i}" for i in range(20)]
    lines = [" ".join(base)] + [" ".join(rng.choice(["other", "further", "last"]) if rng.random() < p else w for w in base) for p in (0.1, 0.2, 0.3, 0.4) for _ in range(12)]
    # Groups of two that share a long passage with all the others: they meet in crowded buckets only, and no centre links them.
    lines += [" ".join([f"passage{i}" for i in range(14)] + [f"end{g}" for _ in range(3)] + [f"own{g}{k}" for _ in range(3)]) for g in range(20) for k in (0, 1)]
    lines += ["click here to read more"] * 30 + [f"click here to read {w}" for w in ("it", "them", "on", "all")]
    rows = [(i, line) for i, line in enumerate(lines)]
    if setting == "no broadcast":
        monkeypatch.setattr(common, "HOT_KEYS", 1)
        shuffled(spark, monkeypatch)
    else:
        monkeypatch.setattr(line_dedup, "CROWD", 10)
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()}
    wanted = deduped(rows)
    if setting == "no broadcast":
        assert got == wanted
    else:  # what meets in crowded buckets only may stay, but nothing goes that is similar to no other line
        left = [i for i in got if got[i] and not wanted[i]]
        print(len(left), "of", sum(not t for t in wanted.values()))
        assert not any(wanted[i] and not got[i] for i in got) and len(left) <= 30


@pytest.mark.parametrize("crowd", [2, 10])
def test_no_link_is_lost_in_crowded_buckets(spark, monkeypatch, crowd):
    """Pairs that meet in crowded buckets only, none of them a centre, and lines changed as far as the limit allows in ways that leave no common pair of words."""
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "CENTRES", 1)
    rng = random.Random(6)
    lines = [" ".join([f"passage{i}" for i in range(14)] + [f"end{g}" for _ in range(3)] + [f"own{g}{k}" for _ in range(3)]) for g in range(20) for k in (0, 1)]
    lines += [" ".join([*rng.sample(["red", "green", "blue", "black"], 4), *["same"] * 8, *(f"t{i}" for i in range(g % 4))]) for g in range(30)]
    for g in range(20):
        words_ = [f"w{g}x{i}" for i in range(20)]
        lines += [" ".join(words_), " ".join(f"new{i}" if i % 5 == 2 else w for i, w in enumerate(words_))]
    rows = list(enumerate(lines))
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(documents(spark, rows)).collect()} == deduped(rows)


def test_lines_of_common_words_do_not_meet(spark):
    """Lines of the same few words, none rare, in other orders: single words would bring all of them together."""
    rng = random.Random(12)
    docs = documents(spark, [(i, " ".join(rng.choices([f"word{k}" for k in range(300)], k=30))) for i in range(400)])
    lines = line_dedup.distinct_lines(line_dedup.occurrences(docs), "sim")
    met = line_dedup.buckets(lines, docs).filter("key < 0").count()
    assert met <= 4 * 400, met


def test_pairs_of_rare_words_that_are_frequent_pairs_do_not_crowd(spark):
    """Four passages of words less frequent than the others, in fifty lines each: their pairs are the most frequent ones, so no line needs them as keys. Copies of a line add no members."""
    rng = random.Random(14)
    lines = [" ".join(rng.choices([f"word{k}" for k in range(60)], k=40) + [f"passage{i % 4}{c}" for c in "abcdef"]) for i in range(200)]
    docs = documents(spark, list(enumerate(lines + lines[:40] * 5)))
    found = line_dedup.buckets(line_dedup.distinct_lines(line_dedup.occurrences(docs), "sim"), docs).filter("key < 0")
    assert found.filter("size > 20").count() == 0 and found.count() <= 25 * 200


def test_lines_at_the_limit_are_found_at_every_length(spark):
    """As many edits as the limit allows, spread so that they take away the most pairs of words; among them a word more that brings one more edit."""
    rng, pairs = random.Random(13), []
    for n in [*range(4, 31), 64, 99]:
        for kind in range(4):
            a = [f"n{n}k{kind}w{i}" for i in range(n)]
            fresh = [f"fresh{rng.randrange(50)}" for _ in range(n)]
            edits, b = (n + (kind == 1)) // 5, list(a)
            for e in range(edits):
                at = 1 + e * (n - 2) // max(1, edits)
                b[at : at + 1] = [[fresh[at]], [a[at], fresh[at]], [], [fresh[at]]][kind] if e or kind != 3 else [a[at], fresh[at]]
            b = [w for x in b for w in ([x] if isinstance(x, str) else x)]
            if a != b and similar_words(tuple(a), tuple(b)):
                pairs.append((a, b))
    assert len(pairs) > 80
    assert found_of(spark, pairs) == 1


def test_line_edges(spark):
    words_ = [f"q{i}" for i in range(line_dedup.PART + 50)]
    long = " ".join(words_)
    nearly = " ".join([*words_[:100], "changed", *words_[101:]])
    rows = [(2, None), (1, ""), (3, "--\n\n..."), (4, "One line\nTwo"), (4, "One line\nTwo"), (5, "one LINE!\nthree"), (7, long), (8, nearly), (9, "two")]
    docs = documents(spark, rows)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()), key=str)
    texts = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and texts[2] is None and texts[3] == "--\n\n..." and texts[5] == "three" and texts[9] == ""
    assert [t for i, t, _ in got if i == 4] == ["One line\nTwo"] * 2 and texts[7] == long and texts[8] == ""
    assert all(n == len(t) for i, t, n in got if t is not None)
    assert 9 not in {r["doc_id"] for r in line_dedup.dedup_lines(docs, drop_emptied=True).collect()}
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 7, 300, line_dedup.PART + 9])
def test_packed_votes_are_the_majority(spark, n):
    w = [f"w{i * 7 % 50}" if i % 3 else "of" for i in range(n)]
    row = line_dedup.occurrences(documents(spark, [(1, " ".join(w))])).first()
    assert row["sim"] % (1 << 64) == line_print(w) and row["n"] == n


def test_near_duplicates_beyond_the_size_switches(spark, monkeypatch):
    shuffled(spark, monkeypatch)
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(i, base) for i in range(9)] + [(20, base + " tail"), (20, base + " tail"), (21, "other text here"), (None, base), (22, None)]
    docs = documents(spark, rows)
    got = Counter(tuple(r) for r in simhash_dedup.near_duplicates(docs).collect())
    known = near_duplicates([(i if i is not None else 99, t) for i, t in rows])
    assert got == Counter({(None if i == 99 else i, p, c): n for (i, p, c), n in known.items()})
    assert Counter(r["doc_id"] for r in simhash_dedup.keep_one(docs).collect()) == Counter({c for _, _, c in known})


def test_decontamination_beyond_the_size_switches(spark, monkeypatch):
    read = lambda t, c: duckdb.sql(f"SELECT {c}, text FROM '{DATA}/{t}.parquet'").fetchall()
    shuffled(spark, monkeypatch)
    got = Counter(tuple(r) for r in decontam.op8_benchmark_decontamination(spark, DATA).collect())
    assert got == contamination(read("documents", "doc_id"), read("benchmark", "item_id"))
