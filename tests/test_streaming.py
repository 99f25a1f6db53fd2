from __future__ import annotations

import datetime
import random
from collections import Counter

from pyspark.sql import functions as F

from umbrascan.streaming import micro_batch, scan_store


def test_batches_are_scanned_once_each(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    query = micro_batch.scan_stream(stream, lambda b: b.withColumn("n", F.char_length("text")), out, f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted((r["doc_id"], r["n"]) for r in spark.read.parquet(out).collect()) == [(1, 1), (2, 1)]


def test_risk_by_window_and_first_answers(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 0, 30)
    rows = [(at, "x", "benign", "k"), (at, "x", "manipulation", "k"), (at + datetime.timedelta(hours=3), "y", "suspicious", "l")]
    spark.createDataFrame(rows, "ts timestamp, source string, rule_label string, cache_key string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, source string, rule_label string, cache_key string").parquet(f"{tmp_path}/in")
    for name, frame in (("risks", micro_batch.risk_stream(stream)), ("answers", micro_batch.first_answers_stream(stream))):
        query = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert {(r["source"], r["flags"], r["risk"]) for r in spark.table("risks").collect()} <= {("x", 2, "manipulation"), ("y", 1, "suspicious")}
    assert sorted(r["cache_key"] for r in spark.table("answers").collect()) == ["k", "l"]


class PlainStore:
    """The scan store over one store's events, in Python."""

    def __init__(self, kept):
        self.kept, self.scans, self.images, self.latest = kept, {}, {}, {}

    def take(self, events):
        order = {"scan": 0, "image": 1, "answer": 2, "get": 3}
        for at, kind, scan, session, page, image, request in sorted(events, key=lambda e: (e[0], order[e[1]], e[2] or "", e[4] or 0, e[6] or "")):
            if kind == "scan":
                if session is not None:
                    self.latest[session] = max(self.latest.get(session, (at, scan)), (at, scan))
                self.scans.setdefault(scan, at)
                if len(self.scans) > self.kept:
                    gone = min(self.scans, key=lambda s: (self.scans[s], s))
                    del self.scans[gone]
                    self.images = {k: v for k, v in self.images.items() if k[0] != gone}
                    yield ("evicted", gone, None, None, None, None)
            elif kind == "image":
                if scan in self.scans:
                    self.images[scan, page] = image
                else:
                    yield ("refused", scan, page, None, None, None)
            elif kind == "answer":
                yield ("answer", scan, None, request, self.latest.get(session, (0, None))[1] == scan, None)
            else:
                yield ("image", scan, page, request, (scan, page) in self.images, self.images.get((scan, page)))


def test_scan_store_matches_a_plain_model(spark, tmp_path):
    rng, batches, request = random.Random(6), [], 0
    for b in range(4):
        rows = []
        for store in ("north", "south"):
            for _ in range(40):
                # Scans come late and again; the clock of a batch overlaps the one before.
                at, scan, session = b * 50 + rng.randrange(70), f"s{rng.randrange(12 * (b + 1)):02d}", f"u{rng.randrange(4)}"
                kind = rng.choice(["scan", "scan", "image", "answer", "get"])
                request += 1
                rows.append((store, at, kind, scan, session, rng.randrange(1, 3), f"{scan}{request}".encode() if kind == "image" else None, f"r{request}"))
        batches.append(rows)
        spark.createDataFrame(rows, scan_store.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{b}")
    scan_store.use_rocksdb(spark)
    for b in range(4):  # every run goes on from the checkpoint of the last one
        stream = spark.readStream.schema(scan_store.EVENTS).parquet(f"{tmp_path}/in/*") if b == 3 else spark.readStream.schema(scan_store.EVENTS).parquet(f"{tmp_path}/in/[0-{b}]")
        told = scan_store.scan_store(stream, kept=5)
        query = told.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/log").outputMode("append").trigger(availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination(120)
        assert query.exception() is None
    out = Counter(tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = Counter()
    for store in ("north", "south"):
        plain = PlainStore(5)
        for rows in batches:
            want.update((store, *t) for t in plain.take([r[1:] for r in rows if r[0] == store]))
    kinds = Counter(k for _, k, *_ in want.elements())
    assert out == want and min(kinds[k] for k in ("evicted", "refused", "answer", "image")) > 3
    assert {ok for _, k, _, _, _, ok, _ in want if k in ("answer", "image")} == {True, False}
