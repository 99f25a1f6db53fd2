"""Style detectors over spans, the invisible-Unicode detector over lines and the metadata detector.

All of them work inside a block, a line or a field, so no more than one document's block meets in a window. Flags carry
`place`, a struct that sorts them the way a reader of the document would emit them: a run where the span stands that
closes it, a line's own flag before its spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as G
from ..functions import rules as R
from ..functions import text as T
from .islands import islands

#: Techniques by priority, and what each one's flag says.
PRIORITY = ("invisible_render", "off_page", "white_text", "tiny_font")
REASONS = {
    "invisible_render": "Text is drawn with an invisible render mode or zero opacity, so it never appears on screen but is still extractable.",
    "off_page": "Text is positioned outside the visible page area, so a human never sees it but text extraction still picks it up.",
    "white_text": "Text color is (nearly) the same as the background behind it, making it invisible to a human reader.",
    "tiny_font": "Font size is below 4.0pt, too small for a human to read.",
    "invisible_unicode": "Text contains zero-width / invisible Unicode characters that humans can't see but AI models read.",
    "metadata": "Document metadata contains text a reader never sees on the page but that AI tools may ingest.",
    "visually_hidden": "Text is in the PDF's text layer but doesn't show up on the rendered page (OCR can't find it there), e.g. it is covered by a shape or image, or clipped away.",
}
SKIPPED_FIELDS = ("format", "encryption", "creationDate", "modDate")
LONG_VALUE = 200
PAGE_KEY = ["doc_id", "page"]
SPAN_KEY = ["doc_id", "page", "block_no", "line_no", "span_no"]
PLACE = ("phase", "page", "block_no", "line_no", "kind", "span_no")
LAST_LINE = (1 << 31) - 1


def place(*values) -> Column:
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).cast("int").alias(n) for n, v in zip(PLACE, values, strict=True)]).alias("place")


def reason(technique: Column, detail: Column | None = None, also: Column | None = None) -> Column:
    base = F.element_at(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv]), technique)
    extra = F.lit("") if detail is None else F.when(detail != "", F.concat(F.lit(" ("), detail, F.lit(")"))).otherwise(F.lit(""))
    more = F.lit("") if also is None else F.when(F.size(also) > 0, F.concat(F.lit(" Also: "), F.array_join(also, ", "), F.lit("."))).otherwise(F.lit(""))
    return F.concat(base, extra, more)


def hidden_traces(traces: DataFrame) -> DataFrame:
    """Boxes of text that is traced with render mode 3 or without opacity."""
    return traces.filter((F.col("type") == 3) | (F.coalesce("opacity", F.lit(1.0)) == 0))


def traced_spans(spans: DataFrame, traces: DataFrame, least: float = 0.5) -> DataFrame:
    """Spans of which more than `least` lies in a hidden trace of their page."""
    rects = hidden_traces(traces).select(*[F.col(c).alias(f"t_{c}") for c in (*PAGE_KEY, "x0", "y0", "x1", "y1")])
    on = [F.col(k) == F.col(f"t_{k}") for k in PAGE_KEY]
    return spans.join(rects, [*on, G.overlap(G.rect(), G.rect("t_")) > least], "left_semi")


def with_traced(spans: DataFrame, traces: DataFrame, least: float = 0.5) -> DataFrame:
    """spans with `_traced`, whether `traced_spans` has them. The few hidden boxes of a page meet its spans as one array, so spans dealt by page are not dealt again by their key."""
    listed = hidden_traces(traces).groupBy(*PAGE_KEY).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("_boxes"))
    covers = F.exists("_boxes", lambda b: G.overlap(G.rect(), [b[c] for c in ("x0", "y0", "x1", "y1")]) > least)
    return spans.join(listed, PAGE_KEY, "left").withColumn("_traced", F.coalesce(covers, F.lit(False))).drop("_boxes")


def rgb_text(rgb: tuple[Column, Column, Column]) -> Column:
    return F.concat(F.lit("rgb("), F.concat_ws(", ", *[c.cast("string") for c in rgb]), F.lit(")"))


def rounded_box(r) -> Column:
    return F.concat(F.lit("("), F.concat_ws(", ", *[F.bround(c, 0).cast("int").cast("string") for c in r]), F.lit(")"))


def techniques(spans: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """spans with `found` (techniques by priority), `detail`, and without those that are blank or only invisible."""
    spans = spans.filter(~T.is_transparent(F.col("text")))
    if traces is None:
        hidden = F.col("alpha") == 0
    else:
        spans = with_traced(spans, traces)
        hidden = (F.coalesce("alpha", F.lit(255)) == 0) | F.col("_traced")
    page = (F.lit(0.0), F.lit(0.0), F.col("page_w"), F.col("page_h"))
    off = G.overlap(G.rect(), page) < 0.5
    fg, bg = G.channels(F.col("color")), tuple(F.col("bg")[c] for c in "rgb")
    ratio = G.contrast(fg, bg)
    all_light = (fg[0] > G.WHITE) & (fg[1] > G.WHITE) & (fg[2] > G.WHITE)
    white = F.when(off, False).when(F.col("bg").isNotNull(), ratio < G.LOW_CONTRAST).otherwise(all_light)
    tiny = F.col("size") < G.TINY
    shown = F.concat(F.lit("text color "), rgb_text(fg))
    against = F.concat(F.lit(" on background "), rgb_text(bg), F.lit(", contrast "), F.format_string("%.2f", ratio), F.lit(":1"))
    details = [
        F.when(off, F.concat(F.lit("bbox "), rounded_box(G.rect()), F.lit(" vs page "), rounded_box(page))),
        F.when(white, F.when(F.col("bg").isNotNull(), F.concat(shown, against)).otherwise(shown)),
        F.when(tiny, F.concat(F.lit("font size "), F.format_string("%.1f", F.col("size")), F.lit("pt"))),
    ]
    found = [F.when(c, F.lit(n)) for n, c in zip(PRIORITY, (hidden, off, white, tiny), strict=True)]
    return spans.withColumns({"found": F.array_compact(F.array(*found)), "detail": F.array_join(F.array_compact(F.array(*details)), "; ")}).drop("_traced")


def merged_text(parts: Column) -> Column:
    """Texts one after the other, with a space between unless one stands there already."""
    return F.aggregate(F.slice(parts, 2, F.size(parts)), parts[0], lambda all_, t: F.concat(all_, F.when(all_.endswith(" "), F.lit("")).otherwise(F.lit(" ")), t))


def style_runs(found: DataFrame) -> DataFrame:
    """Flags of neighbouring spans of a block with the same first technique. found: what `techniques` gives."""
    runs = islands(found, ["doc_id", "page", "block_no"], ["line_no", "span_no"], F.get("found", F.lit(0)))
    own = F.struct("line_no", "span_no", "text", "detail", "found")
    groups = runs.groupBy("doc_id", "page", "block_no", "run").agg(F.sort_array(F.collect_list(own)).alias("spans"), F.max("closes").alias("closes"), *G.union())
    part = lambda name: F.transform("spans", lambda s: s[name])
    first = groups["spans"][0]["found"][0]
    also = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.slice(s["found"], 2, F.size(s["found"]))))))
    detail = F.array_join(F.array_distinct(F.filter(part("detail"), lambda d: d != "")), "; ")
    closing = F.coalesce("closes.line_no", F.lit(LAST_LINE))
    return groups.select(
        "doc_id", place(1, F.col("page"), F.col("block_no"), closing, 1, F.coalesce("closes.span_no", F.lit(0))), "page",
        T.strip(merged_text(part("text"))).alias("text"), first.alias("technique"), reason(first, detail, also).alias("reason"),
        "x0", "y0", "x1", "y1", F.array(F.lit("style")).alias("detected_by"), F.lit(None).cast("string").alias("classify_text"),
    ).filter("text != ''")


def line_flags(spans: DataFrame) -> DataFrame:
    """A flag for each line with invisible characters that hide something; decoded tag text is shown below the line."""
    whole = spans.groupBy("doc_id", "page", "block_no", "line_no").agg(F.sort_array(F.collect_list(F.struct("span_no", "text"))).alias("spans"), *G.union())
    line = F.array_join(F.transform("spans", lambda s: s["text"]), "")
    whole = whole.withColumn("line", line).filter(T.has_invisible(F.col("line")))  # few lines get further
    named = whole.withColumns({"names": T.invisible_names(F.col("line")), "tags": T.decode_tags(F.col("line"))}).filter(F.size("names") > 0)
    tagged = F.col("tags") != ""
    detail = F.concat(F.lit("found: "), F.array_join("names", ", "), F.when(tagged, F.concat(F.lit('; decoded hidden tag text: "'), F.col("tags"), F.lit('"'))).otherwise(F.lit("")))
    shown = F.when(tagged, F.concat(F.col("line"), F.lit("\n[decoded tag text] "), F.col("tags"))).otherwise(F.col("line"))
    kind = F.lit("invisible_unicode")
    return named.select(
        "doc_id", place(1, F.col("page"), F.col("block_no"), F.col("line_no"), 0, 0), "page", T.strip(shown).alias("text"),
        kind.alias("technique"), reason(kind, detail).alias("reason"), "x0", "y0", "x1", "y1",
        F.array(F.lit("style")).alias("detected_by"), F.when(tagged, F.col("tags")).alias("classify_text"),
    )


def metadata_fields(meta: DataFrame) -> DataFrame:
    """doc_id, at, key, value of the non-empty fields that hold text. meta: doc_id and a map `metadata`."""
    fields = meta.select("doc_id", F.posexplode("metadata").alias("at", "key", "value"))
    return fields.filter(~F.col("key").isin(*SKIPPED_FIELDS) & (F.col("value") != ""))


def metadata_flags(meta: DataFrame) -> DataFrame:
    """Fields that instruct, hide characters, or are long."""
    value = F.col("value")
    odd = R.is_manipulation(value) | (F.size(T.invisible_names(value)) > 0) | (F.char_length(value) > LONG_VALUE)
    kind = F.lit("metadata")
    none = F.lit(None).cast("double")
    return metadata_fields(meta).filter(odd).select(
        "doc_id", place(0, 0, 0, F.col("at"), 0, 0), F.lit(0).alias("page"), T.strip(F.concat(F.lit("["), F.col("key"), F.lit("] "), value)).alias("text"),
        kind.alias("technique"), reason(kind, F.concat(F.lit("field: "), F.col("key"))).alias("reason"),
        *[none.alias(c) for c in ("x0", "y0", "x1", "y1")], F.array(F.lit("style")).alias("detected_by"), F.lit(None).cast("string").alias("classify_text"),
    )


def numbered(flags: DataFrame) -> DataFrame:
    """flags with `ord`, their number in the document from 1, in the order of place."""
    return flags.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("place")).cast("long"))


def style_flags(spans: DataFrame, meta: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """All flags of the style, Unicode and metadata detectors, unlabelled; boxes rounded to a tenth of a point."""
    flags = metadata_flags(meta).unionByName(line_flags(spans)).unionByName(style_runs(techniques(spans, traces)))
    return flags.withColumns({c: F.bround(c, 1) for c in ("x0", "y0", "x1", "y1")})


def label(flags: DataFrame) -> DataFrame:
    """Numbered flags with their id and rule label; the rule's reason follows the detector's."""
    ruled = R.with_rule(numbered(flags))
    key = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("ord").cast("string"), "technique", "text")
    return ruled.withColumns({"flag_id": F.substring(F.sha2(key.cast("binary"), 256), 1, 8), "reason": F.concat("reason", F.lit(" "), F.col("rule_why"))}).drop("rule_why")
