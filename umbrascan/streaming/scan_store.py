"""The store of the newest scans and their page images as a stream with state: what a request gets, what falls out, and which answers are stale.

A store (one key of the stream: a tenant, say) keeps the KEPT newest scans by (seq, scan_id), whatever order they come in: a scan that is older than all of a full
store falls out at once, one that comes again keeps its place. Images stand under (scan_id, page) and go with their scan; an image whose scan is not
there is refused. A session's latest scan is the one with the largest (seq, scan_id), and answers to any other are stale, kept or not.

Events of a micro-batch are taken by `at`, ties in the order scan, image, answer, get. State is RocksDB's, in the checkpoint; a micro-batch's events of one
store are sorted in memory, so limit the micro-batch (maxFilesPerTrigger, maxOffsetsPerTrigger) to what a task may hold.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KEPT = 100
#: Events: kind is scan (scan_id, session), image (scan_id, page, image), answer (session, scan_id, request_id) or get (request_id, scan_id, page).
EVENTS = "store string, at long, kind string, scan_id string, session string, page int, image binary, request_id string"
#: What is told: evicted (scan_id), refused (scan_id, page), answer (request_id, ok: not stale) or image (request_id, ok: there is one, image).
TOLD = "store string, kind string, scan_id string, page int, request_id string, ok boolean, image binary"
told = Row(*[c.split()[0] for c in TOLD.split(", ")])
ORDER = {"scan": 0, "image": 1, "answer": 2, "get": 3}
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ScanStore(StatefulProcessor):
    def __init__(self, kept: int = KEPT):
        self.kept = kept

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scans = handle.getMapState("scans", "scan_id string", "seq long, pages array<int>")
        self.images = handle.getMapState("images", "scan_id string, page int", "image binary")
        self.latest = handle.getMapState("latest", "session string", "seq long, scan_id string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (store,) = key
        for e in sorted(rows, key=lambda r: (r["at"], ORDER.get(r["kind"], 9), r["scan_id"] or "", r["page"] or 0, r["request_id"] or "")):
            yield from getattr(self, e["kind"])(store, e)

    def scan(self, store: str, e: Row) -> Iterator[Row]:
        place = (e["at"], e["scan_id"])
        if e["session"] is not None and (not self.latest.containsKey((e["session"],)) or tuple(self.latest.getValue((e["session"],))) < place):
            self.latest.updateValue((e["session"],), place)
        if self.scans.containsKey((e["scan_id"],)):
            return
        self.scans.updateValue((e["scan_id"],), (e["at"], []))
        held = [(value[0], k[0], value[1]) for k, value in self.scans.iterator()]  # one more than are kept at most
        if len(held) > self.kept:
            _, gone, pages = min(held)
            self.scans.removeKey((gone,))
            for page in pages:
                self.images.removeKey((gone, page))
            yield told(store, "evicted", gone, None, None, None, None)

    def image(self, store: str, e: Row) -> Iterator[Row]:
        if not self.scans.containsKey((e["scan_id"],)):
            yield told(store, "refused", e["scan_id"], e["page"], None, None, None)
            return
        seq, pages = self.scans.getValue((e["scan_id"],))
        self.images.updateValue((e["scan_id"], e["page"]), (e["image"],))
        if e["page"] not in pages:
            self.scans.updateValue((e["scan_id"],), (seq, [*pages, e["page"]]))

    def answer(self, store: str, e: Row) -> Iterator[Row]:
        known = self.latest.containsKey((e["session"],))
        fresh = known and self.latest.getValue((e["session"],))[1] == e["scan_id"]
        yield told(store, "answer", e["scan_id"], None, e["request_id"], bool(fresh), None)

    def get(self, store: str, e: Row) -> Iterator[Row]:
        there = self.images.containsKey((e["scan_id"], e["page"]))
        yield told(store, "image", e["scan_id"], e["page"], e["request_id"], bool(there), self.images.getValue((e["scan_id"], e["page"]))[0] if there else None)


def scan_store(events: DataFrame, kept: int = KEPT) -> DataFrame:
    """The told rows of a stream of events. The session needs the RocksDB state store (`use_rocksdb`)."""
    own = events.select(*[c.split()[0] for c in EVENTS.split(", ")]).filter(events["kind"].isin(*ORDER))
    return own.groupBy("store").transformWithState(statefulProcessor=ScanStore(kept), outputStructType=TOLD, outputMode="Append", timeMode="None")


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
