"""The registered queries over the planted tables, and the same in SQL. Every one runs over whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rules as R
from ..functions import text as T
from ..functions import udfs
from ..operators import detect, evaluate, report, review, visual
from ..sources import planted as P
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TAG = "snippet_8f3a2c1d"


def add(name: str, select: str | None = None, *views: str):
    """Register the decorated query and, where SQL can say it, its SQL."""

    def keep(f):
        QUERIES[name] = f
        if select is not None:
            SQL[name] = S.query(select, *views)
        return f

    return keep


def spans(spark: SparkSession, d: str) -> DataFrame:
    return P.spans(P.documents(spark, d))


def found(spark: SparkSession, d: str) -> DataFrame:
    docs = P.documents(spark, d)
    return detect.techniques(P.spans(docs, by_page=True), P.trace_rects(docs, by_page=True))


#: What the last query persisted, by what it is.
KEPT: dict[str, DataFrame] = {}


def kept(name: str, df: DataFrame) -> DataFrame:
    """df persisted in the place of what an earlier query persisted under this name, which would be computed again if it were still read."""
    if name in KEPT:
        KEPT.pop(name).unpersist()
    KEPT[name] = df.persist()
    return df


def style(spark: SparkSession, d: str) -> DataFrame:
    docs = P.documents(spark, d)
    return kept("style", detect.numbered(detect.style_flags(P.spans(docs, by_page=True), P.metadata(docs), P.trace_rects(docs, by_page=True))))


def seen(spark: SparkSession, d: str, fuzzy: bool = True) -> DataFrame:
    docs = P.documents(spark, d)
    return visual.visible_fraction(P.spans(docs, by_page=True), P.ocr_lines(docs, by_page=True), None, fuzzy)


def hidden(spark: SparkSession, d: str) -> DataFrame:
    return kept("hidden", visual.hidden_runs(seen(spark, d)))


def flags(spark: SparkSession, d: str) -> DataFrame:
    """Labelled flags of all detectors. Style flags and hidden spans are read several times and small, so they are persisted."""
    return detect.label(visual.add_visual(style(spark, d), hidden(spark, d)))


def opinions(spark: SparkSession, d: str) -> DataFrame:
    """A stand-in for the second opinion: a label per document."""
    own = spark.read.parquet(f"{d}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    label = F.when(F.col("toxic") == 1, "manipulation").when(F.col("quality") == 0, "suspicious").otherwise("benign")
    return own.select("doc_id", label.alias("label"))


def reviewed(spark: SparkSession, d: str) -> DataFrame:
    own = flags(spark, d)
    asked = own.select("doc_id", "ord").join(opinions(spark, d), "doc_id", "left").filter("label is not null or doc_id % 2 = 0")
    return review.merge(own, None, asked.select("doc_id", "ord", "label", F.when(F.col("label").isNotNull(), F.concat(F.lit("as "), "label")).alias("reason")))


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    docs = P.documents(spark, d)
    name = F.col("doc_id").cast("string").alias("filename")
    listed = lambda rest: docs.filter(F.col("doc_id") % 3 == rest).select(name)
    counts = evaluate.detector_counts(docs, flags(spark, d)).withColumn("filename", F.col("doc_id").cast("string"))
    return evaluate.kinds(counts, listed(2), listed(1)).drop("filename")


SPAN = "doc_id, page, block_no, line_no, span_no"


@add("uni_counts", f"SELECT {SPAN}, {S.invisible_count('text')} AS n_invisible, {S.tag_count('text')} AS n_tags FROM spans", "spans")
def uni_counts(spark, d):
    return spans(spark, d).select(*detect.SPAN_KEY, T.count_invisible(F.col("text")).alias("n_invisible"), T.count_tags(F.col("text")).alias("n_tags"))


@add("uni_decode", f"SELECT {SPAN}, {S.decoded('text')} AS decoded FROM spans", "spans")
def uni_decode(spark, d):
    return spans(spark, d).select(*detect.SPAN_KEY, T.decode_tags(F.col("text")).alias("decoded"))


@add("uni_annotate", f"SELECT {SPAN}, {S.annotate('text')} AS shown FROM spans WHERE {S.invisible_count('text')} > 0", "spans")
def uni_annotate(spark, d):
    return spans(spark, d).filter(T.count_invisible(F.col("text")) > 0).select(*detect.SPAN_KEY, T.annotate(F.col("text")).alias("shown"))


@add("uni_reveal", f"SELECT {SPAN}, {S.reveal('text')} AS shown FROM spans", "spans")
def uni_reveal(spark, d):
    return spans(spark, d).select(*detect.SPAN_KEY, T.reveal(F.col("text")).alias("shown"))


@add("uni_find", f"SELECT {SPAN}, array_to_string({S.names('text')}, ', ') AS names FROM spans", "spans")
def uni_find(spark, d):
    return spans(spark, d).select(*detect.SPAN_KEY, F.array_join(T.invisible_names(F.col("text")), ", ").alias("names"))


@add("uni_char_frequency", f"SELECT doc_id, c AS ch, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM spans) WHERE c <> '' AND strpos({S.q(S.ALL_INVISIBLE)}, c) > 0 GROUP BY doc_id, c", "spans")
def uni_char_frequency(spark, d):
    chars = spans(spark, d).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{T.IN_INVISIBLE}]"), F.lit(0))).alias("ch"))
    return chars.groupBy("doc_id", "ch").agg(F.count("*").alias("n"))


@add("transparent_spans", f"SELECT {SPAN}, {S.TRANSPARENT} AS transparent FROM spans", "spans")
def transparent_spans(spark, d):
    return spans(spark, d).select(*detect.SPAN_KEY, T.is_transparent(F.col("text")).alias("transparent"))


@add("text_normalize", f"SELECT {SPAN}, {S.normalize('text')} AS norm FROM spans", "spans")
def text_normalize(spark, d):
    return spans(spark, d).select(*detect.SPAN_KEY, T.normalize(F.col("text")).alias("norm"))


@add("text_words", f"SELECT {SPAN}, array_to_string({S.words('text')}, ' ') AS words, CAST(len({S.words('text')}) AS INTEGER) AS n FROM spans", "spans")
def text_words(spark, d):
    return spans(spark, d).select(*detect.SPAN_KEY, F.array_join(T.words(F.col("text")), " ").alias("words"), F.size(T.words(F.col("text"))).alias("n"))


@add("cache_key", f"SELECT item_id, sha256(regexp_replace({S.strip('lower(text)')}, {S.q(f'[{S.SPACE}]+')}, ' ', 'g')) AS cache_key FROM benchmark")
def cache_key(spark, d):
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", udfs.cache_key(F.col("text")).alias("cache_key"))


@add("text_slug", "SELECT DISTINCT source, regexp_replace(lower(source), '[^a-z0-9]+', '-', 'g') AS slug, regexp_replace(coalesce(nullif(source || '.pdf', ''), 'upload.pdf'), '\\.pdf$', '') AS base FROM documents")
def text_slug(spark, d):
    names = P.documents(spark, d).select("source").distinct()
    return names.select("source", T.slug(F.col("source")).alias("slug"), T.base_name(F.concat("source", F.lit(".pdf"))).alias("base"))


@add("settings_truth", "SELECT DISTINCT lang, CASE WHEN trim(coalesce(lang, '')) <> '' THEN lower(trim(lang)) NOT IN ('0', 'false', 'no', 'off') END AS truth FROM documents")
def settings_truth(spark, d):
    return P.documents(spark, d).select("lang").distinct().select("lang", T.is_true(F.col("lang")).alias("truth"))


@add("color_contrast", f"SELECT {SPAN}, round({S.CONTRAST}, 6) AS contrast FROM spans WHERE bg_r IS NOT NULL", "spans")
def color_contrast(spark, d):
    ratio = G.contrast(G.channels(F.col("color")), tuple(F.col("bg")[c] for c in "rgb"))
    return spans(spark, d).filter("bg is not null").select(*detect.SPAN_KEY, F.round(ratio, 6).alias("contrast"))


@add("overlap_ratio", f"SELECT {SPAN}, round({S.overlap('', ('0.0::DOUBLE', '0.0::DOUBLE', 'page_w', 'page_h'))}, 9) AS ratio FROM spans", "spans")
def overlap_ratio(spark, d):
    page = (F.lit(0.0), F.lit(0.0), F.col("page_w"), F.col("page_h"))
    return spans(spark, d).select(*detect.SPAN_KEY, F.round(G.overlap(G.rect(), page), 9).alias("ratio"))


CLAMP = lambda a0, a1, size: (
    f"CASE WHEN least(greatest({a1}, 0), {size}) - least(greatest({a0}, 0), {size}) < 8 AND ({a0} >= {size} OR {a1} <= 0) THEN CASE WHEN {a0} >= {size} THEN {size} - 8.0::DOUBLE ELSE 0.0::DOUBLE END ELSE least(greatest({a0}, 0.0::DOUBLE), {size}) END",
    f"CASE WHEN least(greatest({a1}, 0), {size}) - least(greatest({a0}, 0), {size}) < 8 AND ({a0} >= {size} OR {a1} <= 0) THEN CASE WHEN {a0} >= {size} THEN {size} ELSE 8.0::DOUBLE END ELSE least(greatest({a1}, 0.0::DOUBLE), {size}) END",
)
OX, OY = CLAMP("x0", "x1", "595.0::DOUBLE"), CLAMP("y0", "y1", "842.0::DOUBLE")
OFF = "technique = 'off_page' OR x0 < 0 OR y0 < 0 OR x1 > 595 OR y1 > 842"


@add("overlay_box", f"SELECT doc_id, ord, CASE WHEN x0 IS NOT NULL THEN {OX[0]} END AS ox0, CASE WHEN x0 IS NOT NULL THEN {OY[0]} END AS oy0, CASE WHEN x0 IS NOT NULL THEN {OX[1]} END AS ox1, CASE WHEN x0 IS NOT NULL THEN {OY[1]} END AS oy1, CASE WHEN x0 IS NOT NULL THEN {OFF} ELSE FALSE END AS off_page FROM style_flags", "style_flags")
def overlay_box(spark, d):
    own = report.with_overlay(style(spark, d), report.page_sizes(spans(spark, d)))
    return own.select("doc_id", "ord", *[F.col(f"overlay.{c}").alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")], "off_page")


@add("polygon_bbox", f"SELECT {SPAN}, x0, y0, x1, y1 FROM spans", "spans")
def polygon_bbox(spark, d):
    corner = lambda x, y: F.array(F.col(x) * 2.0, F.col(y) * 2.0)
    box = G.polygon_box(F.array(corner("x1", "y0"), corner("x0", "y0"), corner("x0", "y1"), corner("x1", "y1")))
    return spans(spark, d).select(*detect.SPAN_KEY, box.alias("b")).select(*detect.SPAN_KEY, "b.*")


@add("pixel_rects", f"SELECT {SPAN}, x0 * 2.0::DOUBLE AS px0, y0 * 2.0::DOUBLE AS py0, x1 * 2.0::DOUBLE AS px1, y1 * 2.0::DOUBLE AS py1 FROM spans", "spans")
def pixel_rects(spark, d):
    return spans(spark, d).select(*detect.SPAN_KEY, *[c.alias(f"p{n}") for c, n in zip(G.to_pixels(G.rect()), ("x0", "y0", "x1", "y1"), strict=True)])


@add("bg_upper_median", "SELECT doc_id, line_no, r, g, b FROM (SELECT doc_id, line_no, k, (h * 37 + k * 53) % 256 AS r, (h * 11 + k * 91) % 256 AS g, (doc_id * 7 + k * 17) % 256 AS b, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY (h * 37 + k * 53) % 256 + (h * 11 + k * 91) % 256 + (doc_id * 7 + k * 17) % 256, k) AS rn FROM (SELECT *, unnest(range(7)) AS k FROM lines)) WHERE rn = 4", "lines")
def bg_upper_median(spark, d):
    base = P.lines(P.documents(spark, d))
    sample = lambda k: F.struct(((F.col("h") * 37 + k * 53) % 256).cast("long").alias("r"), ((F.col("h") * 11 + k * 91) % 256).cast("long").alias("g"), ((F.col("doc_id") * 7 + k * 17) % 256).alias("b"))
    return base.select("doc_id", "line_no", G.upper_median(F.array(*[sample(k) for k in range(7)])).alias("m")).select("doc_id", "line_no", "m.*")


@add("token_caps", "SELECT item_id, least(100 + 120 * length(text), 4096) AS capped, 100 + 150 * length(text) AS local FROM benchmark")
def token_caps(spark, d):
    n = F.char_length("text").cast("long")
    return spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", G.token_cap(n).alias("capped"), G.token_cap(n, 100, 150, None).alias("local"))


@add("upload_guard", "SELECT doc_id, octet_length(encode(coalesce(text, ''))) > 4000000 AS too_large FROM documents")
def upload_guard(spark, d):
    return P.documents(spark, d).select("doc_id", G.too_large(F.octet_length(F.coalesce("text", F.lit("")))).alias("too_large"))


for _name, _column in (("detect_render", "hidden"), ("detect_offpage", "off"), ("detect_white", "white"), ("detect_tiny", "tiny")):
    _technique = {"hidden": "invisible_render", "off": "off_page", "white": "white_text", "tiny": "tiny_font"}[_column]

    def _one(spark, d, technique=_technique):
        return found(spark, d).filter(F.array_contains("found", technique)).select(*detect.SPAN_KEY, "text")

    add(_name, f"SELECT {SPAN}, text FROM whites WHERE {_column}", "whites")(_one)


@add("techniques_priority", f"SELECT {SPAN}, array_to_string(found, ',') AS found, detail FROM techniques", "techniques")
def techniques_priority(spark, d):
    return found(spark, d).select(*detect.SPAN_KEY, F.array_join("found", ",").alias("found"), "detail")


@add("trace_semi_join", f"SELECT {SPAN} FROM traced", "traced")
def trace_semi_join(spark, d):
    docs = P.documents(spark, d)
    return detect.traced_spans(P.spans(docs), P.trace_rects(docs)).select(*detect.SPAN_KEY)


@add("run_merge", "SELECT doc_id, page, block_no, technique, text, reason, x0, y0, x1, y1 FROM run_flags WHERE text <> ''", "run_flags")
def run_merge(spark, d):
    return detect.style_runs(found(spark, d)).select("doc_id", "page", "place.block_no", "technique", "text", "reason", "x0", "y0", "x1", "y1")


@add("line_unicode_flags", "SELECT doc_id, page, line_no, text, reason, classify_text FROM line_flags", "line_flags")
def line_unicode_flags(spark, d):
    return detect.line_flags(spans(spark, d)).select("doc_id", "page", "place.line_no", "text", "reason", "classify_text")


@add("metadata_fields", "SELECT doc_id, key, value FROM fields", "fields")
def metadata_fields(spark, d):
    return detect.metadata_fields(P.metadata(P.documents(spark, d))).select("doc_id", "key", "value")


@add("metadata_flags", "SELECT doc_id, text, reason FROM meta_flags", "meta_flags")
def metadata_flags(spark, d):
    return detect.metadata_flags(P.metadata(P.documents(spark, d))).select("doc_id", "text", "reason")


@add("flags_union_ordered", "SELECT doc_id, ord, page, technique, text FROM style_flags", "style_flags")
def flags_union_ordered(spark, d):
    return style(spark, d).select("doc_id", "ord", "page", "technique", "text")


ADDRESSED, INSTRUCTED = S.first_phrase("lower(t)", R.ADDRESSING), S.first_phrase("lower(t)", R.INSTRUCTION)


@add("rule_addressing", f"SELECT doc_id, line_no, {ADDRESSED} AS phrase FROM lines WHERE ({ADDRESSED}) IS NOT NULL", "lines")
def rule_addressing(spark, d):
    return P.lines(P.documents(spark, d)).select("doc_id", "line_no", R.first_phrase(F.lower("t"), R.ADDRESSING).alias("phrase")).filter("phrase is not null")


@add("rule_instruction", f"SELECT doc_id, line_no, {INSTRUCTED} AS phrase FROM lines WHERE ({INSTRUCTED}) IS NOT NULL", "lines")
def rule_instruction(spark, d):
    return P.lines(P.documents(spark, d)).select("doc_id", "line_no", R.first_phrase(F.lower("t"), R.INSTRUCTION).alias("phrase")).filter("phrase is not null")


LINE_LABEL, LINE_WHY = S.text_rule("t", "'white_text'")


@add("rule_labels", f"SELECT doc_id, line_no, {LINE_LABEL} AS label, {LINE_WHY} AS why FROM lines", "lines")
def rule_labels(spark, d):
    return P.lines(P.documents(spark, d)).select("doc_id", "line_no", R.text_rule(F.col("t"), F.lit("white_text")).alias("r")).select("doc_id", "line_no", "r.*")


@add("labelled_flags", "SELECT doc_id, ord, page, technique, text, full_reason AS reason, array_to_string(detected_by, ',') AS detected_by, rule_label, flag_id FROM flags", "flags")
def labelled_flags(spark, d):
    return flags(spark, d).select("doc_id", "ord", "page", "technique", "text", "reason", F.array_join("detected_by", ",").alias("detected_by"), "rule_label", "flag_id")


@add("page_gate", f"SELECT DISTINCT doc_id, page FROM judged", "judged")
def page_gate(spark, d):
    return visual.pages_to_read(spans(spark, d))


@add("ocr_status", "SELECT doc_id, 'ok' AS status, CAST(NULL AS VARCHAR) AS error, coalesce(n, 0) AS pages_ocrd FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN (SELECT doc_id, count(DISTINCT page) AS n FROM judged GROUP BY doc_id) USING (doc_id)", "judged")
def ocr_status(spark, d):
    return visual.ocr_status(visual.pages_to_read(spans(spark, d)), P.documents(spark, d))


def page_reads(spark: SparkSession, d: str) -> DataFrame:
    """Raw reads of every page worth reading; one page in eleven fails, by arithmetic."""
    docs = P.documents(spark, d)
    items = P.ocr_lines(docs, by_page=True).groupBy(*detect.PAGE_KEY).agg(F.sort_array(F.collect_list(F.struct("ord", "text", "x0", "y0", "x1", "y1"))).alias("l"))
    corner = lambda x, y: F.array(x * 2.0, y * 2.0)
    polygon = lambda i: F.array(corner(i["x0"], i["y0"]), corner(i["x1"], i["y0"]), corner(i["x1"], i["y1"]), corner(i["x0"], i["y1"]))
    read = F.transform("l", lambda i: F.struct(polygon(i).alias("polygon"), i["text"].alias("text"), F.lit(0.9).alias("score")))
    pages = visual.pages_to_read(P.spans(docs)).join(items, detect.PAGE_KEY, "left")
    fails = (F.col("doc_id") * 13 + F.col("page") * 7) % 11 == 0
    error = F.when(fails, F.concat(F.lit("engine stopped on page "), F.col("page").cast("string")))
    return pages.select(*detect.PAGE_KEY, F.when(~fails, F.coalesce(read, F.array().cast(read_type()))).alias("items"), error.alias("error"))


def read_type() -> str:
    from ..sources.readers import ITEMS

    return ITEMS


@add("ocr_part_way", "SELECT doc_id, CASE WHEN failed IS NULL THEN 'ok' ELSE 'unavailable' END AS status, 'engine stopped on page ' || failed AS error, CASE WHEN failed IS NULL THEN coalesce(n, 0) END AS pages_ocrd FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, page FROM judged) GROUP BY doc_id) USING (doc_id) LEFT JOIN failing USING (doc_id)", "judged", "failing")
def ocr_part_way(spark, d):
    """Status where some pages fail: the first failure ends the reading of its document."""
    return visual.read_status(page_reads(spark, d), P.documents(spark, d))


@add("flags_part_way", "SELECT doc_id, page, technique, text, reason, array_to_string(detected_by, ',') AS detected_by FROM (SELECT doc_id, page, technique, text, reason, CASE WHEN m.ord IS NULL THEN ['style'] ELSE ['style', 'visual'] END AS detected_by FROM style_flags s LEFT JOIN (SELECT DISTINCT doc_id, ord FROM matched ANTI JOIN (SELECT doc_id, page FROM matched JOIN failing USING (doc_id) WHERE page >= failed) USING (doc_id, page)) m USING (doc_id, ord) UNION ALL SELECT doc_id, page, technique, text, reason, ['visual'] FROM visual_flags LEFT JOIN failing USING (doc_id) WHERE failed IS NULL OR page < failed)", "style_flags", "matched", "visual_flags", "failing")
def flags_part_way(spark, d):
    """Flags where some pages fail: what the visual difference found before the failure stays, and later pages have the style detectors' flags alone."""
    read = visual.before_failure(page_reads(spark, d))
    docs = P.documents(spark, d)
    spans_read = P.spans(docs, by_page=True).join(read.select(*detect.PAGE_KEY), detect.PAGE_KEY, "left_semi")
    own = kept("hidden", visual.hidden_runs(visual.visible_fraction(spans_read, visual.decoded_lines(read), None, True)))
    both = visual.add_visual(style(spark, d), own)
    return both.select("doc_id", "page", "technique", "text", "reason", F.array_join("detected_by", ",").alias("detected_by"))


@add("crop_boxes", f"SELECT {SPAN}, CASE WHEN t THEN a END AS cx0, CASE WHEN t THEN b END AS cy0, CASE WHEN t THEN c END AS cx1, CASE WHEN t THEN e END AS cy1 FROM (SELECT *, c - a >= 1 AND e - b >= 1 AS t FROM (SELECT *, greatest(x0 - 2, 0.0::DOUBLE) AS a, greatest(y0 - 2, 0.0::DOUBLE) AS b, least(x1 + 2, page_w) AS c, least(y1 + 2, page_h) AS e FROM spans))", "spans")
def crop_boxes(spark, d):
    return visual.crop_boxes(spans(spark, d)).select(*detect.SPAN_KEY, "cx0", "cy0", "cx1", "cy1")


@add("crop_spread", "SELECT doc_id, line_no, CASE WHEN len(v) = 0 THEN 0.0::DOUBLE ELSE round(list_aggregate(v, 'quantile_cont', 0.98) - list_aggregate(v, 'quantile_cont', 0.02), 6) END AS spread, coalesce(len(v) > 0 AND list_aggregate(v, 'quantile_cont', 0.98) - list_aggregate(v, 'quantile_cont', 0.02) >= 40, FALSE) AS readable FROM (SELECT doc_id, line_no, list_transform(range(octet_length(encode(t))), lambda k: ('0x' || substr(hex(encode(t)), 2 * k::INT + 1, 2))::BIGINT::DOUBLE) AS v FROM lines)", "lines")
def crop_spread(spark, d):
    """The gate of close looks, on lines whose bytes stand for the grey values of a picture."""
    gap = visual.spread(F.col("t").cast("binary"), F.lit(1))
    own = P.lines(P.documents(spark, d)).select("doc_id", "line_no", gap.alias("gap"))
    return own.select("doc_id", "line_no", F.round("gap", 6).alias("spread"), (F.col("gap") >= visual.MIN_SPREAD).alias("readable"))


@add("ocr_line_join", f"SELECT j.doc_id, j.page, j.block_no, j.line_no, j.span_no, coalesce(s.seen, '') AS seen FROM judged j LEFT JOIN seen s USING (doc_id, page, block_no, line_no, span_no)", "judged", "seen")
def ocr_line_join(spark, d):
    docs = P.documents(spark, d)
    return visual.seen_text(visual.judged(P.spans(docs)), P.ocr_lines(docs)).select(*detect.SPAN_KEY, "seen")


@add("visible_fraction_exact", f"SELECT {SPAN}, round(visible, 9) AS visible FROM visible_exact", "visible_exact")
def visible_fraction_exact(spark, d):
    return seen(spark, d, False).select(*detect.SPAN_KEY, F.round("visible", 9).alias("visible"))


@add("visible_fraction_fuzzy", f"SELECT {SPAN}, round(visible, 9) AS visible FROM visible", "visible")
def visible_fraction_fuzzy(spark, d):
    return seen(spark, d).select(*detect.SPAN_KEY, F.round("visible", 9).alias("visible"))


@add("hidden_runs", "SELECT doc_id, page, block_no, min(line_no) AS first_line, count(*) AS n FROM hidden GROUP BY doc_id, page, block_no, run", "hidden")
def hidden_runs(spark, d):
    return hidden(spark, d).groupBy("doc_id", "page", "block_no", "run").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n")).drop("run")


@add("style_visual_dedup", f"SELECT {SPAN}, ord FROM matched", "matched")
def style_visual_dedup(spark, d):
    return visual.first_overlaps(hidden(spark, d), style(spark, d))


@add("fresh_anti", "SELECT doc_id, page, text, reason, x0, y0, x1, y1 FROM visual_flags", "visual_flags")
def fresh_anti(spark, d):
    own = hidden(spark, d)
    return visual.fresh_flags(own, visual.first_overlaps(own, style(spark, d))).select("doc_id", "page", "text", "reason", "x0", "y0", "x1", "y1")


@add("snippet_escape", f"SELECT doc_id, line_no, {S.escaped('t', TAG)} AS snippet FROM lines", "lines")
def snippet_escape(spark, d):
    return P.lines(P.documents(spark, d)).select("doc_id", "line_no", T.escape_snippet(F.col("t"), TAG).alias("snippet"))


SHOWN = f"CASE WHEN {S.invisible_count('text')} > 0 THEN {S.annotate('text')} ELSE text END"


@add("prompt_body", f"SELECT doc_id, 'Label each of these ' || count(*) || ' snippets.' || chr(10) || chr(10) || string_agg('<{TAG} id=\"' || sid || '\">' || {S.escaped('(' + SHOWN + ')', TAG)} || '</{TAG}>', chr(10) ORDER BY ord) AS body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS sid FROM flags WHERE rule_label <> 'manipulation') GROUP BY doc_id", "flags")
def prompt_body(spark, d):
    return review.prompt_bodies(flags(spark, d).filter("rule_label <> 'manipulation'"), TAG).select("doc_id", "body")


def mock_answers(spark: SparkSession, d: str) -> DataFrame:
    """key, ids, raw: one way of answering right or wrong for each remainder of doc_id by 8."""
    good = '[{"id": "1", "label": "benign", "reason": "a"}, {"id": "2", "label": "suspicious", "reason": "b"}]'
    raws = [
        good, '[{"id": "1", "label": "harmless", "reason": "a"}, {"id": "2", "label": "benign", "reason": "b"}]',
        '[{"id": "1", "label": "benign", "reason": "a", "x": 1}, {"id": "2", "label": "benign", "reason": "b"}]',
        '[{"id": "1", "label": "benign"}, {"id": "3", "label": "benign", "reason": "c"}]', '[{"id": 1, "label": "benign", "reason": "a"}, {"id": "2", "label": "manipulation", "reason": "b"}]',
        '[{"id": "1", "label": "benign", "reason": "a"}, {"id": "1", "label": "suspicious", "reason": "b"}, {"id": "2", "label": "benign", "reason": "c"}]',
        f"```json\n{good}\n```", "I think all of these are benign.",
    ]
    raw = F.element_at(F.array(*map(F.lit, raws)), (F.col("doc_id") % 8 + 1).cast("int"))
    return P.documents(spark, d).select(F.col("doc_id").alias("key"), F.array(F.lit("1"), F.lit("2")).alias("ids"), raw.alias("raw"))


@add("parse_strict", "SELECT doc_id AS key, a.sid AS sid, a.label AS label, a.reason AS reason FROM (SELECT doc_id, unnest(CASE doc_id % 8 WHEN 0 THEN [{'sid': '1', 'label': 'benign', 'reason': 'a'}, {'sid': '2', 'label': 'suspicious', 'reason': 'b'}] WHEN 6 THEN [{'sid': '1', 'label': 'benign', 'reason': 'a'}, {'sid': '2', 'label': 'suspicious', 'reason': 'b'}] WHEN 1 THEN [{'sid': '2', 'label': 'benign', 'reason': 'b'}] WHEN 2 THEN [{'sid': '2', 'label': 'benign', 'reason': 'b'}] WHEN 4 THEN [{'sid': '2', 'label': 'manipulation', 'reason': 'b'}] WHEN 5 THEN [{'sid': '2', 'label': 'benign', 'reason': 'c'}] ELSE [] END) AS a FROM documents)")
def parse_strict(spark, d):
    return review.parsed_answers(mock_answers(spark, d))


@add("parse_wrapped", "SELECT doc_id AS key, '1' AS sid, 'benign' AS label, 'a' AS reason FROM documents WHERE doc_id % 2 = 0")
def parse_wrapped(spark, d):
    one = '[{"id": "1", "label": "benign", "reason": "a"}]'
    raw = F.when(F.col("doc_id") % 2 == 0, F.lit(f'{{"results": {one}}}')).when(F.col("doc_id") % 4 == 1, F.lit(one)).otherwise(F.lit(f'{{"results": {one}, "x": 1}}'))
    return review.parsed_answers(P.documents(spark, d).select(F.col("doc_id").alias("key"), F.array(F.lit("1")).alias("ids"), raw.alias("raw")), wrapped=True)


@add("review_retry", "SELECT doc_id AS key, '1' AS sid, CASE WHEN doc_id % 3 = 0 THEN 'benign' ELSE 'suspicious' END AS label, 'r' || CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END AS reason FROM documents")
def review_retry(spark, d):
    tries = P.documents(spark, d).select(F.col("doc_id").alias("key"), F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt"))
    label = F.when(F.col("attempt") == 1, "suspicious").when(F.col("key") % 3 == 0, "benign")
    return review.first_answers(tries.select("key", F.lit("1").alias("sid"), "attempt", label.alias("label"), F.concat(F.lit("r"), F.col("attempt").cast("string")).alias("reason")))


@add("review_cache_join", f"SELECT l.doc_id, l.line_no, c.item_id IS NOT NULL AS hit FROM lines l LEFT JOIN (SELECT min(item_id) AS item_id, k FROM (SELECT item_id, sha256(regexp_replace({S.strip('lower(line)')}, {S.q(f'[{S.SPACE}]+')}, ' ', 'g')) AS k FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark)) GROUP BY k) c ON c.k = sha256(regexp_replace({S.strip('lower(l.t)')}, {S.q(f'[{S.SPACE}]+')}, ' ', 'g'))", "lines")
def review_cache_join(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.explode(F.split("text", "\n")).alias("line"))
    cache = items.groupBy(udfs.cache_key(F.col("line")).alias("k")).agg(F.min("item_id").alias("item_id"))
    own = P.lines(P.documents(spark, d)).select("doc_id", "line_no", udfs.cache_key(F.col("t")).alias("k"))
    return own.join(cache, "k", "left").select("doc_id", "line_no", F.col("item_id").isNotNull().alias("hit"))


KEY = f"sha256(regexp_replace({S.strip('lower(' + SHOWN + ')')}, {S.q(f'[{S.SPACE}]+')}, ' ', 'g'))"
CACHED = "CASE length(text) % 3 WHEN 0 THEN 'benign' WHEN 1 THEN 'suspicious' ELSE 'manipulation' END"


def known_answers(flags: DataFrame) -> DataFrame:
    """cache_key, label, reason: an answer a key, made of the length of its text. Texts of one key may differ in length: the first in document order counts."""
    n = F.char_length("text") % 3
    label = F.when(n == 0, "benign").when(n == 1, "suspicious").otherwise("manipulation")
    first = review.keyed(flags).groupBy("cache_key").agg(F.min_by(label, F.struct("doc_id", "ord")).alias("label"))
    return first.withColumn("reason", F.lit("known"))


@add("review_cached", f"WITH k AS MATERIALIZED (SELECT *, {KEY} AS k FROM flags), c AS (SELECT k, first({CACHED} ORDER BY doc_id, ord) AS label FROM k WHERE rule_label <> 'manipulation' AND doc_id % 2 = 0 GROUP BY k) SELECT doc_id, ord, k AS cache_key, CASE WHEN rule_label <> 'manipulation' THEN label END AS llm_label, CASE WHEN rule_label = 'manipulation' THEN 'skipped' WHEN label IS NULL THEN 'unavailable' ELSE 'cached' END AS llm_status, {S.more_severe('rule_label', 'CASE WHEN rule_label <> ' + S.q('manipulation') + ' THEN label END')} AS final_label FROM k LEFT JOIN c USING (k)", "flags")
def review_cached(spark, d):
    """A run without a model, behind a cache of answers to the texts of every second document."""
    own = flags(spark, d)
    out = review.review(own, None, known_answers(own.filter("rule_label <> 'manipulation' and doc_id % 2 = 0")))
    return out.select("doc_id", "ord", "cache_key", "llm_label", "llm_status", "final_label")


@add("review_status", "SELECT doc_id, ord, rule_label, llm_label, llm_status, final_label FROM reviewed", "reviewed")
def review_status(spark, d):
    return reviewed(spark, d).select("doc_id", "ord", "rule_label", "llm_label", "llm_status", "final_label")


@add("review_response", f"SELECT doc_id, risk, ord, flag_id AS id, rule_label, llm_label, 'as ' || llm_label AS llm_reason, llm_status, final_label, final_label AS classification FROM reviewed JOIN (SELECT doc_id, {S.risk('max(' + S.rank('final_label') + ')')} AS risk FROM reviewed GROUP BY doc_id) USING (doc_id)", "reviewed")
def review_response(spark, d):
    """Every field of the answers to review requests, out of the JSON."""
    read = review.responses(reviewed(spark, d)).select("doc_id", F.from_json("body", review.RESPONSE).alias("r"))
    each = read.select("doc_id", "r.risk", F.posexplode("r.flags").alias("at", "f"))
    return each.select("doc_id", "risk", (F.col("at") + 1).cast("long").alias("ord"), "f.*")


@add("review_stats", f"SELECT doc_id, count(*) FILTER (llm_status = 'cached') AS cache_hits, count(*) FILTER (llm_status = 'skipped') AS skipped, count(*) FILTER (llm_status = 'ok') AS answered, count(*) FILTER (llm_status = 'invalid') AS invalid, count(*) FILTER (llm_status = 'unavailable') AS unavailable, {S.risk('max(' + S.rank('final_label') + ')')} AS risk FROM reviewed GROUP BY doc_id", "reviewed")
def review_stats(spark, d):
    return review.review_stats(reviewed(spark, d))


@add("severity_merge", f"SELECT doc_id, a, b, {S.more_severe('a', 'b')} AS merged FROM (SELECT doc_id, CASE WHEN toxic = 1 THEN 'manipulation' WHEN doc_id % 3 = 0 THEN 'suspicious' ELSE 'benign' END AS a, CASE WHEN quality = 0 THEN 'suspicious' WHEN doc_id % 5 = 0 THEN 'other' WHEN doc_id % 7 = 0 THEN 'manipulation' WHEN doc_id % 11 <> 0 THEN 'benign' END AS b FROM labels)")
def severity_merge(spark, d):
    """The more severe of two labels of a document, the second one of which may be unknown or missing."""
    i = F.col("doc_id")
    a = F.when(F.col("toxic") == 1, "manipulation").when(i % 3 == 0, "suspicious").otherwise("benign")
    b = F.when(F.col("quality") == 0, "suspicious").when(i % 5 == 0, "other").when(i % 7 == 0, "manipulation").when(i % 11 != 0, "benign")
    own = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", a.alias("a"), b.alias("b"))
    return own.withColumn("merged", R.more_severe(F.col("a"), F.col("b")))


@add("request_validation", "SELECT doc_id AS request_id, CASE doc_id % 6 WHEN 0 THEN NULL WHEN 1 THEN 'a flag is out of bounds' WHEN 2 THEN 'Duplicate flag ids' WHEN 3 THEN 'a flag is out of bounds' WHEN 4 THEN 'too many flags' ELSE 'no flags' END AS error FROM documents")
def request_validation(spark, d):
    one = '{{"id": "{0}", "text": "t", "technique": "x", "rule_label": "{1}", "extra": 1}}'
    a, b = one.format("a", "benign"), one.format("b", "suspicious")
    many = ", ".join(one.format(i, "benign") for i in range(301))
    bodies = [f'{{"flags": [{a}, {b}]}}', f'{{"flags": [{a}, {one.format("c", "harmless")}]}}', f'{{"flags": [{a}, {a}]}}', f'{{"flags": [{one.format("", "benign")}]}}', f'{{"flags": [{many}]}}', "[]"]
    body = F.element_at(F.array(*map(F.lit, bodies)), (F.col("doc_id") % 6 + 1).cast("int"))
    return review.parsed_requests(P.documents(spark, d).select(F.col("doc_id").alias("request_id"), body.alias("body"))).select("request_id", "error")


@add("request_body", "SELECT doc_id, ord, flag_id AS id, text, technique, rule_label FROM flags", "flags")
def request_body(spark, d):
    """Every field of the requests, out of the JSON."""
    each = review.request_body(flags(spark, d)).select("doc_id", F.posexplode(F.from_json("body", f"flags {review.REQUEST}")["flags"]).alias("at", "f"))
    return each.select("doc_id", (F.col("at") + 1).cast("long").alias("ord"), "f.*")


@add("report_risk", f"SELECT doc_id, coalesce(n, 0) AS total_flags, {S.risk('worst')} AS risk FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, max({S.rank('rule_label')}) AS worst FROM flags GROUP BY doc_id) USING (doc_id)", "flags")
def report_risk(spark, d):
    return report.risks(P.documents(spark, d), flags(spark, d))


@add("by_technique", "SELECT doc_id, technique, count(*) AS n, min(ord) AS first FROM flags GROUP BY doc_id, technique", "flags")
def by_technique(spark, d):
    return report.technique_counts(flags(spark, d))


@add("by_technique_map", "SELECT doc_id, string_agg(technique || '=' || n, ',' ORDER BY first) AS counts FROM (SELECT doc_id, technique, count(*) AS n, min(ord) AS first FROM flags GROUP BY doc_id, technique) GROUP BY doc_id", "flags")
def by_technique_map(spark, d):
    counts = report.by_technique(flags(spark, d))
    return counts.select("doc_id", F.array_join(F.transform(F.map_entries("by_technique"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@add("label_counts", "SELECT doc_id, " + ", ".join(f"count(*) FILTER (final_label = '{x}') AS n_{x}" for x in R.SEVERITY) + " FROM reviewed GROUP BY doc_id", "reviewed")
def label_counts(spark, d):
    return report.label_counts(reviewed(spark, d))


@add("page_preview_list", "SELECT doc_id, page, 595.0::DOUBLE AS width, 842.0::DOUBLE AS height, count(*) AS n_boxes FROM flags WHERE x0 IS NOT NULL AND page >= 1 GROUP BY doc_id, page", "flags")
def page_preview_list(spark, d):
    return report.flagged_pages(flags(spark, d), report.page_sizes(spans(spark, d)))


@add("image_budget", "WITH RECURSIVE n AS (SELECT doc_id, page, chars, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM (SELECT doc_id, CAST(line_no % 9 AS INTEGER) AS page, CAST(max(length(line)) * 20000 % 1500000 AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line_no FROM documents) GROUP BY doc_id, line_no % 9)), w AS (SELECT doc_id, page, chars, i, chars <= 3000000 AS kept, 3000000 - CASE WHEN chars <= 3000000 THEN chars ELSE 0 END AS rest FROM n WHERE i = 1 UNION ALL SELECT n.doc_id, n.page, n.chars, n.i, n.chars <= w.rest, w.rest - CASE WHEN n.chars <= w.rest THEN n.chars ELSE 0 END FROM w JOIN n ON n.doc_id = w.doc_id AND n.i = w.i + 1) SELECT doc_id, page, chars, kept FROM w")
def image_budget(spark, d):
    rows = P.documents(spark, d).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    images = rows.groupBy("doc_id", (F.col("line_no") % 9).alias("page")).agg((F.max(F.char_length("line")).cast("long") * 20000 % 1_500_000).alias("chars"))
    return report.within_budget(images)


PICTURES = "SELECT doc_id, page, encode(string_agg(text, chr(10) ORDER BY line_no, span_no)) AS image FROM spans GROUP BY doc_id, page"


@add("page_previews", f"WITH RECURSIVE boxed_pages AS MATERIALIZED (SELECT doc_id, page, count(*) AS n_boxes FROM flags WHERE x0 IS NOT NULL AND page >= 1 GROUP BY doc_id, page), shots AS MATERIALIZED (SELECT *, CAST(ceil(octet_length(image) / 3) * 4 AS BIGINT) AS chars, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS i FROM boxed_pages JOIN ({PICTURES}) USING (doc_id, page)), spent AS (SELECT doc_id, i, chars <= 3000 AS kept, 3000 - CASE WHEN chars <= 3000 THEN chars ELSE 0 END AS rest FROM shots WHERE i = 1 UNION ALL SELECT s.doc_id, s.i, s.chars <= p.rest, p.rest - CASE WHEN s.chars <= p.rest THEN s.chars ELSE 0 END FROM spent p JOIN shots s ON s.doc_id = p.doc_id AND s.i = p.i + 1) SELECT doc_id, page, 595.0::DOUBLE AS width, 842.0::DOUBLE AS height, n_boxes, CASE WHEN kept THEN 'data:image/jpeg;base64,' || base64(image) END AS image FROM shots JOIN spent USING (doc_id, i)", "flags", "spans")
def page_previews(spark, d):
    """Flagged pages with their pictures as data URLs while the budget lasts; a page's text stands for its picture."""
    own = spans(spark, d)
    line = F.sort_array(F.collect_list(F.struct("line_no", "span_no", "text")))
    images = own.groupBy("doc_id", "page").agg(F.array_join(F.transform(line, lambda s: s["text"]), "\n").cast("binary").alias("image"))
    return report.previews(report.flagged_pages(flags(spark, d), report.page_sizes(own)), images, 3000)


@add("data_urls", "SELECT item_id, 'data:image/jpeg;base64,' || base64(encode(text)) AS url FROM benchmark")
def data_urls(spark, d):
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    return items.select("item_id", F.regexp_replace(report.data_url(F.col("text").cast("binary"), F.lit(True)), "[\r\n]", "").alias("url"))


REPORT_FLAGS = "doc_id, ord, flag_id AS id, page, text, technique, full_reason AS reason, x0, y0, x1, y1, array_to_string(detected_by, ',') AS detected_by, rule_label, llm_label, llm_status, final_label"
DRAWN = ", ".join(f"CASE WHEN x0 IS NOT NULL THEN round_even({o}, 1) END AS o{c}" for o, c in zip((OX[0], OY[0], OX[1], OY[1]), ("x0", "y0", "x1", "y1")))


def parsed_reports(spark: SparkSession, d: str) -> DataFrame:
    """The reports of all documents, read back from their JSON."""
    docs = P.documents(spark, d).select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))
    own = spans(spark, d)
    made = report.reports(docs, reviewed(spark, d), report.page_sizes(own), visual.read_status(page_reads(spark, d), docs))
    return made.select("doc_id", F.from_json("report", report.REPORT).alias("r"))


@add("report_json", f"SELECT doc_id, 'doc' || doc_id || '.pdf' AS filename, coalesce(p.pages, 0) AS page_count, {S.risk('worst')} AS risk, coalesce(n, 0) AS total_flags, coalesce(c.counts, '') AS by_technique, coalesce(b.boxed, '') AS pages, CASE WHEN failed IS NULL THEN 'ok' ELSE 'unavailable' END AS status, 'engine stopped on page ' || failed AS error, CASE WHEN failed IS NULL THEN coalesce(j.n_read, 0) END AS pages_ocrd FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n, max({S.rank('final_label')}) AS worst FROM reviewed GROUP BY doc_id) USING (doc_id) LEFT JOIN (SELECT doc_id, count(DISTINCT page) AS pages FROM spans GROUP BY doc_id) p USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(technique || '=' || n, ',' ORDER BY first) AS counts FROM (SELECT doc_id, technique, count(*) AS n, min(ord) AS first FROM reviewed GROUP BY doc_id, technique) GROUP BY doc_id) c USING (doc_id) LEFT JOIN (SELECT doc_id, string_agg(page || ':595.0x842.0:' || n, ',' ORDER BY page) AS boxed FROM (SELECT doc_id, page, count(*) AS n FROM reviewed WHERE x0 IS NOT NULL GROUP BY doc_id, page) GROUP BY doc_id) b USING (doc_id) LEFT JOIN failing USING (doc_id) LEFT JOIN (SELECT doc_id, count(DISTINCT page) AS n_read FROM judged GROUP BY doc_id) j USING (doc_id)", "reviewed", "spans", "judged", "failing")
def report_json(spark, d):
    """Everything of a report but its flags, out of the JSON."""
    joined = lambda parts: F.array_join(parts, ",")
    counts = F.transform(F.map_entries("r.summary.by_technique"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    listed = F.transform("r.pages", lambda p: F.concat(p["page"].cast("string"), F.lit(":"), p["width"].cast("string"), F.lit("x"), p["height"].cast("string"), F.lit(":"), p["n_boxes"].cast("string")))
    return parsed_reports(spark, d).select("doc_id", "r.filename", "r.page_count", "r.risk", "r.summary.total_flags", joined(counts).alias("by_technique"), joined(listed).alias("pages"), "r.visual_diff.status", "r.visual_diff.error", "r.visual_diff.pages_ocrd")


@add("report_json_flags", f"SELECT {REPORT_FLAGS}, {DRAWN}, CASE WHEN x0 IS NOT NULL THEN {OFF} ELSE FALSE END AS off_page FROM reviewed", "reviewed")
def report_json_flags(spark, d):
    """Every field of every flag of the reports, out of the JSON."""
    each = parsed_reports(spark, d).select("doc_id", F.posexplode("r.flags").alias("at", "f"))
    box = lambda field, prefix: [F.get(F.col(f"f.{field}"), F.lit(i)).alias(f"{prefix}{c}") for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    plain = [f"f.{c}" for c in ("id", "page", "text", "technique", "reason", "rule_label", "llm_label", "llm_status", "final_label", "off_page")]
    return each.select("doc_id", (F.col("at") + 1).cast("long").alias("ord"), *plain, F.array_join("f.detected_by", ",").alias("detected_by"), *box("bbox", ""), *box("overlay", "o"))


@add("scan_store_topn", "SELECT event_id AS scan_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100")
def scan_store_topn(spark, d):
    return report.kept_scans(spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("scan_id"), F.col("ts").alias("seq"))).select("scan_id")


@add("stale_guard", "SELECT event_id AS scan_id, user_id AS session FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stale_guard(spark, d):
    scans = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("session"), F.col("event_id").alias("scan_id"), F.col("ts").alias("seq"))
    return report.current_answers(scans.select("session", "scan_id"), scans)


@add("detector_counts", 'SELECT doc_id, num_flags, style_only, visual_only, "both" FROM counts', "counts")
def detector_counts(spark, d):
    return evaluate.detector_counts(P.documents(spark, d), flags(spark, d))


@add("detector_kinds", 'SELECT doc_id, kind, style_only, visual_only, "both", caught_by FROM caught', "caught")
def detector_kinds(spark, d):
    return evaluate.caught(evaluated(spark, d)).select("doc_id", "kind", "style_only", "visual_only", "both", "caught_by")


@add("detector_headline", "SELECT count(*) FILTER (kind = 'attack' AND caught_by = 'visual') AS visual_only_attacks, count(*) FILTER (kind = 'attack' AND caught_by = 'style') AS style_only_attacks, count(*) FILTER (kind = 'attack' AND num_flags = 0) AS missed, count(*) FILTER (kind = 'clean') AS clean_documents, CAST(coalesce(sum(visual_only + \"both\") FILTER (kind = 'clean'), 0) AS BIGINT) AS visual_false_positives, CAST(coalesce(sum(num_flags) FILTER (kind = 'clean'), 0) AS BIGINT) AS false_positives FROM caught", "caught")
def detector_headline(spark, d):
    return evaluate.headline(evaluated(spark, d))


TIMES = "SELECT 'doc' || doc_id AS filename, CAST(doc_id % 97 AS DOUBLE) AS parse_ms, CAST(doc_id % 89 AS DOUBLE) AS visual_diff_ms, CAST(doc_id % 101 AS DOUBLE) AS llm_ms, doc_id % 2 AS llm_calls, doc_id % 3 AS retries, doc_id % 6 AS num_flags, doc_id % 4 AS cache_hits, CASE WHEN doc_id % 50 = 7 THEN 'timeout' WHEN doc_id % 50 = 9 THEN 'refused' ELSE '' END AS llm_error FROM documents"


def timings(spark: SparkSession, d: str) -> DataFrame:
    part = lambda m: (F.col("doc_id") % m).cast("double")
    error = F.when(F.col("doc_id") % 50 == 7, "timeout").when(F.col("doc_id") % 50 == 9, "refused").otherwise("")
    return P.documents(spark, d).select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("filename"), part(97).alias("parse_ms"), part(89).alias("visual_diff_ms"), part(101).alias("llm_ms"), (F.col("doc_id") % 2).alias("llm_calls"), (F.col("doc_id") % 3).alias("retries"), (F.col("doc_id") % 6).alias("num_flags"), (F.col("doc_id") % 4).alias("cache_hits"), error.alias("llm_error"))


@add("benchmark_rollup", f"SELECT CASE WHEN grouping(filename) = 1 THEN 'AVERAGE' ELSE filename END AS filename, round(avg(parse_ms), 6) AS parse_ms, round(avg(llm_ms), 6) AS llm_ms, round(avg(num_flags), 6) AS num_flags, round(avg(cache_hits), 6) AS cache_hits FROM ({TIMES}) GROUP BY GROUPING SETS ((filename), ())")
def benchmark_rollup(spark, d):
    columns = ["parse_ms", "llm_ms", "num_flags", "cache_hits"]
    return evaluate.with_average(timings(spark, d), columns).select("filename", *[F.round(c, 6).alias(c) for c in columns])


@add("benchmark_totals", f"SELECT CAST(sum(llm_calls) AS BIGINT) AS llm_calls, CAST(sum(retries) AS BIGINT) AS retries, coalesce((SELECT string_agg(e, '; ' ORDER BY e) FROM (SELECT DISTINCT llm_error AS e FROM ({TIMES}) WHERE llm_error <> '')), '') AS errors FROM ({TIMES})")
def benchmark_totals(spark, d):
    return evaluate.totals(timings(spark, d))


@add("visual_times", f"SELECT round(avg(visual_diff_ms), 6) AS avg_ms, max(visual_diff_ms) AS max_ms FROM ({TIMES})")
def visual_times(spark, d):
    return evaluate.visual_times(timings(spark, d)).select(F.round("avg_ms", 6).alias("avg_ms"), "max_ms")


@add("cold_warm", f"SELECT sum(llm_ms) AS cold_ms, sum(floor(llm_ms / 10)) AS warm_ms, round(sum(llm_ms) / sum(floor(llm_ms / 10)), 9) AS speedup FROM ({TIMES})")
def cold_warm(spark, d):
    cold = timings(spark, d)
    own = evaluate.cold_and_warm(cold, cold.withColumn("llm_ms", F.floor(F.col("llm_ms") / 10).cast("double")))
    return own.withColumn("speedup", F.round("speedup", 9))


@add("text_table", f"SELECT rpad(filename, CAST(greatest((SELECT max(length(filename)) FROM ({TIMES})), 8) AS INTEGER), ' ') || '  ' || rpad(llm_error, CAST(greatest((SELECT max(length(llm_error)) FROM ({TIMES})), 9) AS INTEGER), ' ') AS line FROM ({TIMES})")
def text_table(spark, d):
    return evaluate.text_table(timings(spark, d), ["filename", "llm_error"]).select("line")


@add("client_merge", f"SELECT doc_id, flag_id, CASE WHEN ord % 2 = 0 THEN final_label ELSE rule_label END AS shown FROM reviewed", "reviewed")
def client_merge(spark, d):
    own = reviewed(spark, d)
    shown = own.select("doc_id", "flag_id", F.col("rule_label").alias("shown"))
    answers = own.filter("ord % 2 = 0").select("doc_id", "flag_id", F.col("final_label").alias("shown"))
    return report.client_merge(shown, answers, ("shown",))


@add("caught_by", "SELECT doc_id, ord, CASE WHEN len(detected_by) = 2 THEN 'both (style + visual)' WHEN detected_by = ['visual'] THEN 'visual (OCR diff)' ELSE 'style' END AS caught_by, " + S.named("technique", S.TECHNIQUE_NAMES) + " AS name FROM flags", "flags")
def caught_by(spark, d):
    return flags(spark, d).select("doc_id", "ord", report.caught_by(F.col("detected_by")).alias("caught_by"), report.named(F.col("technique"), report.TECHNIQUE_NAMES).alias("name"))


@add("ai_label_text", "SELECT doc_id, ord, coalesce(llm_label, CASE llm_status WHEN 'skipped' THEN 'not needed (rules already confirmed)' WHEN 'invalid' THEN 'answer rejected (rules + OCR only)' WHEN 'unavailable' THEN 'unavailable (rules + OCR only)' ELSE '—' END) AS shown FROM reviewed", "reviewed")
def ai_label_text(spark, d):
    fallback = report.without_ai(F.lit("ok"))
    return reviewed(spark, d).select("doc_id", "ord", report.ai_label(F.col("llm_label"), F.col("llm_status"), F.lit("done"), fallback).alias("shown"))


@add("ai_unavailable", "SELECT doc_id, bool_or(llm_status = 'unavailable') AS ai_unavailable FROM reviewed GROUP BY doc_id", "reviewed")
def ai_unavailable(spark, d):
    return report.ai_unavailable(reviewed(spark, d), F.lit("done"))


@add("box_offsets", f"SELECT doc_id, flag_id, (page - 1) * 900.0::DOUBLE + ({OY[0]}) * 0.5::DOUBLE AS y FROM flags WHERE x0 IS NOT NULL", "flags")
def box_offsets(spark, d):
    sizes = report.page_sizes(spans(spark, d))
    own = report.with_overlay(flags(spark, d), sizes)
    return report.box_offsets(own, sizes.select("doc_id", "page", ((F.col("page") - 1) * 900.0).alias("top"), F.lit(0.5).alias("scale")))


BACK = chr(92)
ESCAPED = f"array_to_string(list_transform(string_split(text, ''), lambda c: CASE WHEN c = '{BACK}' THEN '{BACK * 2}' WHEN c = chr(10) THEN '{BACK}n' WHEN c = chr(13) THEN '{BACK}r' WHEN c = chr(9) THEN '{BACK}t' WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 256 THEN '{BACK}x' || printf('%02x', unicode(c)) WHEN unicode(c) < 65536 THEN '{BACK}u' || printf('%04x', unicode(c)) ELSE '{BACK}U' || printf('%08x', unicode(c)) END), '')"


@add("flag_table", f"SELECT 'doc' || doc_id AS file, technique, array_to_string(detected_by, '+') AS by, substr({ESCAPED}, 1, 44) AS text, rule_label AS rule, coalesce(llm_label, '-') AS ai, final_label AS final, llm_status AS status, coalesce('as ' || llm_label, '') AS ai_reason FROM reviewed", "reviewed")
def flag_table(spark, d):
    return evaluate.flag_table(reviewed(spark, d), F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".pdf")))


@add("scan_lookup", "SELECT e.event_id AS scan_id, e.user_id AS session FROM events e JOIN (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 100) k USING (event_id)")
def scan_lookup(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("scan_id"), F.col("user_id").alias("session"), F.col("ts").alias("seq"))
    return events.select("scan_id", "session").join(report.kept_scans(events).select("scan_id"), "scan_id")

