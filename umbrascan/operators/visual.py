"""The visual difference: spans of the text layer that the lines read on the rendered page do not show.

Spans meet lines of their own page only, which come as one array a page, so spans that are dealt by page are not dealt again. A word is seen if it stands in
the joined text of the lines beside its span; with `fuzzy`, the words that do not are scored by best-window similarity in an Arrow-batched UDF, which other words do not reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import geometry as G
from ..functions import text as T
from ..functions.udfs import near_letters
from .detect import PAGE_KEY, SPAN_KEY, place, reason
from .islands import islands

MIN_CHARS, MIN_FUZZY, WORD_MATCH, VISIBLE, MIN_OVERLAP = 3, 4, 75.0, 0.5, 0.5
CROP_SCORE = 0.5
#: A close look takes PAD points more on each side, at CROP_ZOOM; smaller sides than LEAST_SIDE points and grey values closer than MIN_SPREAD show nothing.
PAD, CROP_ZOOM, LEAST_SIDE, MIN_SPREAD = 2.0, 3.0, 1.0, 40.0


def long_enough(spans: DataFrame) -> DataFrame:
    """Spans long enough to judge."""
    return spans.filter(T.has_letters(F.col("text"), MIN_CHARS))


def with_words(spans: DataFrame) -> DataFrame:
    return spans.withColumn("words", T.words(F.col("text")))


def judged(spans: DataFrame) -> DataFrame:
    """Spans long enough to judge, with their normalised words."""
    return with_words(long_enough(spans))


def pages_to_read(spans: DataFrame) -> DataFrame:
    """Pages with a span that is long enough to judge; only these are worth reading."""
    return spans.filter(T.has_letters(F.col("text"), MIN_CHARS)).select(*PAGE_KEY).distinct()


def decoded_lines(raw: DataFrame, zoom: float = 2.0) -> DataFrame:
    """Lines (doc_id, page, ord, text, box) of raw reads: doc_id, page and an array `items` of polygon, text, score."""
    items = raw.select(*PAGE_KEY, F.posexplode("items").alias("ord", "item")).filter(T.strip(F.col("item.text")) != "")
    return items.select(*PAGE_KEY, "ord", F.col("item.text").alias("text"), G.polygon_box(F.col("item.polygon"), zoom).alias("box")).select(*PAGE_KEY, "ord", "text", "box.*")


def before_failure(reads: DataFrame) -> DataFrame:
    """The reads of each document up to its first page with an error: pages are read in order, and a failure ends the reading of its document.

    reads: doc_id, page, error and what was read. A document's pages are counted, not gathered, so a long document is no task of its own.
    """
    failed = reads.filter("error is not null").groupBy("doc_id").agg(F.min("page").alias("_failed"))
    beyond = reads.select(*PAGE_KEY).join(failed, "doc_id").filter("page >= _failed").select(*PAGE_KEY)  # keys alone are dealt by document, not what was read
    return reads.join(beyond, PAGE_KEY, "left_anti").drop("error")


def read_status(reads: DataFrame, documents: DataFrame) -> DataFrame:
    """doc_id, status, error and pages_ocrd of every document: unavailable with the error of the first page that failed, else ok with the number of pages read."""
    seen = reads.groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("page"))).alias("error"))
    own = documents.select("doc_id").distinct().join(seen, "doc_id", "left")
    failed = F.col("error").isNotNull()
    return own.select("doc_id", F.when(failed, "unavailable").otherwise("ok").alias("status"), "error", F.when(~failed, F.coalesce("n", F.lit(0))).alias("pages_ocrd"))


def crop_boxes(spans: DataFrame) -> DataFrame:
    """spans with cx0..cy1, their box and PAD points around it inside the page; null where less than a point of it is on the page."""
    x0, y0 = F.greatest(F.col("x0") - PAD, F.lit(0.0)), F.greatest(F.col("y0") - PAD, F.lit(0.0))
    x1, y1 = F.least(F.col("x1") + PAD, F.col("page_w")), F.least(F.col("y1") + PAD, F.col("page_h"))
    there = (x1 - x0 >= LEAST_SIDE) & (y1 - y0 >= LEAST_SIDE)
    return spans.withColumns({name: F.when(there, c) for name, c in zip(("cx0", "cy0", "cx1", "cy1"), (x0, y0, x1, y1), strict=True)})


def grey_spread(pixels: bytes, channels: int) -> float:
    """Between the 2nd and the 98th percentile, the distance of the grey values (means of the channels) of a picture; 0 without a pixel."""
    values = np.frombuffer(pixels, np.uint8)
    if not len(values):
        return 0.0
    low, high = np.percentile(values.reshape(-1, channels).mean(axis=1), [2, 98])
    return float(high - low)


def spread(pixels: Column, channels: Column) -> Column:
    """grey_spread of a column of raw pixels, in Arrow batches; pictures are views of the batch, not copied."""

    @F.arrow_udf(ST.DoubleType())
    def measured(pictures: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array([None if p is None or c is None else grey_spread(memoryview(p), c) for p, c in zip((x.as_buffer() for x in pictures), n.to_pylist(), strict=True)], pa.float64())

    return measured(pixels, channels)


def read_crops(pictures: DataFrame, make_reader: Callable[[], Callable[[bytes, int, int, int], list[tuple[str, float]]]]) -> DataFrame:
    """SPAN_KEY, crop and error of close looks: pictures (SPAN_KEY, pixels, width, height, channels) of crop boxes, rendered at CROP_ZOOM.

    Flat pictures show nothing and are not read. make_reader() is called once a task; its reader takes pixels and sizes and gives texts with scores.
    """
    key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pictures.select(*SPAN_KEY).schema)
    sized = pictures.withColumn("_flat", F.coalesce(spread(F.col("pixels"), F.col("channels")) < MIN_SPREAD, F.lit(True)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = None
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                try:
                    reader = reader or make_reader()
                    items = reader(bytes(r.pixels), int(r.width), int(r.height), int(r.channels)) or ()
                    rows.append((*r[: len(SPAN_KEY)], " ".join(t for t, score in items if t and score >= CROP_SCORE), None))
                except Exception as e:
                    rows.append((*r[: len(SPAN_KEY)], None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*SPAN_KEY, "crop", "error"])

    looked = sized.filter(~F.col("_flat")).select(*SPAN_KEY, "pixels", "width", "height", "channels").mapInPandas(run, f"{key}, crop string, error string")
    flat = sized.filter("_flat").select(*SPAN_KEY, F.lit("").alias("crop"), F.lit(None).cast("string").alias("error"))
    return looked.unionByName(flat)


def crop_text(items: Column) -> Column:
    """What a close look at one span read: the texts with enough score, one space between."""
    good = F.filter(items, lambda i: (i["text"] != "") & (i["score"] >= CROP_SCORE))
    return F.array_join(F.transform(good, lambda i: i["text"]), " ")


def seen_text(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """spans with `seen`, the normalised texts of the lines on the same line of print, in their order and glued."""
    box = ("x0", "y0", "x1", "y1")
    listed = lines.groupBy(*PAGE_KEY).agg(F.sort_array(F.collect_list(F.struct("ord", "text", *box))).alias("_lines"))
    beside = F.filter("_lines", lambda o: G.same_line(G.rect(), [o[c] for c in box], MIN_OVERLAP))
    text = T.normalize(F.array_join(F.transform(beside, lambda o: o["text"]), ""))
    return spans.join(listed, PAGE_KEY, "left").withColumn("seen", F.coalesce(text, F.lit(""))).drop("_lines")


def letters(words: Column) -> Column:
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.char_length(w))


def with_fraction(spans: DataFrame, fuzzy: bool = False, name: str = "visible") -> DataFrame:
    """spans with the share of their words' letters that is seen; 1 without words, 0 with nothing seen."""
    found = spans.withColumn("_found", F.filter("words", lambda w: F.contains(F.col("seen"), w)))
    hit = letters(F.col("_found"))
    if fuzzy:
        # With a share of m of 100 at least m / (200 - m) of a word's letters are in the window: most words that are not there at all end here.
        most = lambda w: F.size(F.filter(F.split(w, ""), lambda c: F.contains(F.col("seen"), c)))
        enough = lambda w: most(w) * (200 - WORD_MATCH) >= F.char_length(w) * WORD_MATCH
        missing = F.filter("words", lambda w: ~F.contains(F.col("seen"), w) & (F.char_length(w) >= MIN_FUZZY) & ((F.char_length("seen") < F.char_length(w)) | enough(w)))
        found = found.withColumn("_missing", F.when(F.col("seen") != "", missing))
        scored = F.size("_missing") > 0
        found = found.withColumn("_near", near_letters(F.when(scored, F.col("_missing")), F.when(scored, F.col("seen")), WORD_MATCH))
        hit = hit + F.coalesce("_near", F.lit(0))
    total = letters(F.col("words"))
    share = F.when(total == 0, 1.0).when(F.col("seen") == "", 0.0).otherwise(hit / total)
    return found.withColumn(name, share).drop("_found", "_missing", "_near")


def visible_fraction(spans: DataFrame, lines: DataFrame, crops: DataFrame | None = None, fuzzy: bool = False) -> DataFrame:
    """Judged spans with `visible`; spans that look hidden get a second look at their own crop (SPAN_KEY, crop) if there are any."""
    out = with_fraction(with_words(seen_text(long_enough(spans), lines)), fuzzy)  # words are not carried through the join
    if crops is None:
        return out
    doubtful = out.filter(F.col("visible") < VISIBLE).drop("seen").join(crops.select(*SPAN_KEY, T.normalize(F.col("crop")).alias("seen")), SPAN_KEY)
    again = with_fraction(doubtful, fuzzy, "again").select(*SPAN_KEY, "again")
    return out.join(again, SPAN_KEY, "left").withColumn("visible", F.greatest("visible", F.coalesce("again", F.lit(0.0)))).drop("again")


def hidden_runs(seen: DataFrame) -> DataFrame:
    """Hidden spans with the run of hidden neighbours in their block that they belong to."""
    return islands(seen, ["doc_id", "page", "block_no"], ["line_no", "span_no"], F.when(F.col("visible") < VISIBLE, F.lit(1)))


def first_overlaps(hidden: DataFrame, flags: DataFrame, least: float = 0.5) -> DataFrame:
    """SPAN_KEY and `ord` of the first flag of the page that more than half of the span lies in. flags: numbered."""
    boxed = flags.filter("x0 is not null").select(*[F.col(c).alias(f"f_{c}") for c in (*PAGE_KEY, "ord", "x0", "y0", "x1", "y1")])
    on = [F.col(k) == F.col(f"f_{k}") for k in PAGE_KEY]
    return hidden.join(boxed, [*on, G.overlap(G.rect(), G.rect("f_")) > least]).groupBy(*SPAN_KEY).agg(F.min("f_ord").alias("ord"))


def fresh_flags(hidden: DataFrame, matched: DataFrame) -> DataFrame:
    """One flag for what is left of each run when the spans are gone that a flag has already."""
    fresh = hidden.join(matched, SPAN_KEY, "left_anti")
    own = F.struct("line_no", "span_no", "text")
    groups = fresh.groupBy("doc_id", "page", "block_no", "run").agg(F.sort_array(F.collect_list(own)).alias("spans"), F.max("visible").alias("visible"), *G.union())
    text = F.array_join(F.transform("spans", lambda s: T.strip(s["text"])), " ")
    kind, first = F.lit("visually_hidden"), groups["spans"][0]
    detail = F.concat(F.lit("OCR found "), F.bround(F.col("visible") * 100, 0).cast("int").cast("string"), F.lit("% of it on the rendered page"))
    return groups.select(
        "doc_id", place(2, F.col("page"), F.col("block_no"), first["line_no"], 1, first["span_no"]), "page", T.strip(text).alias("text"),
        kind.alias("technique"), reason(kind, detail).alias("reason"), *[F.bround(c, 1).alias(c) for c in ("x0", "y0", "x1", "y1")],
        F.array(F.lit("visual")).alias("detected_by"), F.lit(None).cast("string").alias("classify_text"),
    )


def add_visual(flags: DataFrame, hidden: DataFrame) -> DataFrame:
    """Numbered style flags, marked where the visual difference found them too, and its own flags. hidden: hidden_runs' spans.

    Both frames are read several times; a caller does well to persist them.
    """
    matched = first_overlaps(hidden, flags)
    marks = matched.select("doc_id", "ord").distinct().withColumn("_mark", F.lit(True))
    both = F.array_union("detected_by", F.when(F.col("_mark"), F.array(F.lit("visual"))).otherwise(F.array().cast("array<string>")))
    marked = flags.join(marks, ["doc_id", "ord"], "left").withColumn("detected_by", both).drop("_mark", "ord")
    return marked.unionByName(fresh_flags(hidden, matched))


def ocr_status(pages: DataFrame, documents: DataFrame, enabled: bool = True, error: str | None = None) -> DataFrame:
    """doc_id, status, error and pages_ocrd of every document: off, unavailable with the reason, or ok with the number of pages read, which may be none."""
    counted = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    status = "off" if not enabled else "unavailable" if error else "ok"
    n = F.when(F.lit(status == "ok"), F.coalesce("n", F.lit(0)))
    return documents.select("doc_id").distinct().join(counted, "doc_id", "left").select("doc_id", F.lit(status).alias("status"), F.lit(error).cast("string").alias("error"), n.alias("pages_ocrd"))
