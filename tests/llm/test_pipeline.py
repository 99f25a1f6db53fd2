"""The pipeline's stages against brute force, each on what the one before it kept."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from test_dedup import contamination, deduped, near_duplicates

import corpus_pipeline
from umbrascan.llm import common, langid, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the of and harbour winter quiet letter market river stone garden morning".split(), "de": "der und das Hafen Winter stille Brief Markt Fluss Stein Garten Morgen".split(), "fr": "le et les port hiver calme lettre marché rivière pierre jardin matin".split()}


def corpus():
    rng = random.Random(2)
    line = lambda lang: " ".join(rng.choice(WORDS[lang]) + rng.choice(["", "", "es", "en", "ia", "ol"]) for _ in range(rng.randrange(3, 25)))
    rows = []
    for i in range(60):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, "\n".join(line(lang) for _ in range(rng.randrange(1, 6))), lang))
    shared = line("en")
    rows += [(60 + i, f"{rows[i][1]} {rows[i][1]}\n{shared}", rows[i][2]) for i in range(8)]  # shared lines
    rows += [(70 + i, rows[9][1], "en") for i in range(5)]  # copies
    item = line("fr") + " " + line("fr") + " " + line("fr")
    rows += [(80, f"{line('fr')}\n{line('fr')} {item} {line('fr')}", "fr"), (81, None, "en"), (82, "", None), (83, "123 --", "en")]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in rows], [(1, item), (2, "")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    documents, benchmark = corpus()
    spark.createDataFrame(documents, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(benchmark, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_match_brute_force(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language ID", "line dedup", "SimHash near-dedup", "benchmark decontamination", "packing"]
    docs = common.table(spark, folder, "documents")
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = common.settle(stage(spark, docs, folder), "stage")
        before, after = pairs(docs), out
        if name == "language ID":
            sure = {r["doc_id"] for r in langid.identify(docs).collect() if r["_lang"]["lang_pred"] != "und" and r["_lang"]["score"] >= langid.MIN_SCORE}
            assert Counter(pairs(after)) == Counter((i, t) for i, t in before if i in sure) and not sure & {81, 82, 83} and len(sure) > 60
        elif name == "line dedup":
            assert dict(pairs(after)) == deduped(before) and len(pairs(after)) == len(before)
        elif name == "SimHash near-dedup":
            stay = {c for _, _, c in near_duplicates(before)}
            assert Counter(pairs(after)) == Counter((i, t) for i, t in before if i in stay) and not stay & {71, 72, 73, 74}
        elif name == "benchmark decontamination":
            hit = {r[0] for r in contamination(before, corpus()[1]) if r[5]}
            assert Counter(pairs(after)) == Counter((i, t) for i, t in before if i not in hit) and 80 in hit
        else:
            assert {r["doc_id"] for r in after.collect()} == {i for i, _ in before} and sum(r["n_tokens"] for r in after.collect()) == sum(len((t or "").split()) for _, t in before)
            continue
        assert out.columns == docs.columns
        docs = out


def test_run_is_the_stages_in_order(spark, folder):
    got = corpus_pipeline.run(spark, folder).collect()
    docs = common.table(spark, folder, "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = common.settle(stage(spark, docs, folder), "stage")
    key = lambda rows: Counter((r["doc_id"], r["piece"], r["n_tokens"], r["bucket"]) for r in rows)
    assert key(got) == key(docs.collect())


def test_an_empty_table_goes_through(spark, folder, tmp_path):
    docs = common.table(spark, folder, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = common.settle(stage(spark, docs, folder), "stage")
    assert docs.count() == 0


def test_one_query_per_operator():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, len(queries.QUERIES) + 1)] and set(queries.SQL) <= set(queries.QUERIES)


class Elsewhere:
    """A session on a cluster, as far as the choice of a folder goes."""

    def __init__(self, **conf):
        self.conf = {k.replace("_", "."): v for k, v in conf.items()}
        self.sparkContext = type("Context", (), {"master": "spark://somewhere:7077", "applicationId": "app"})


def test_a_folder_that_is_not_shared_is_an_error_on_a_cluster(spark):
    assert common.shared_dir(Elsewhere(spark_checkpoint_dir="s3a://bucket/x/")) == "s3a://bucket/x"
    assert common.shared_dir(Elsewhere(spark_sql_warehouse_dir="hdfs://node/w")) == "hdfs://node/w/checkpoints-app"
    for local in ("file:/tmp/w", "spark-warehouse"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            common.shared_dir(Elsewhere(spark_sql_warehouse_dir=local))
    assert common.shared_dir(spark)
