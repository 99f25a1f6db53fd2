"""Reports per document: risk, counts, preview boxes, the image budget, the nested JSON, and what a client shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import rules as R

IMAGE_BUDGET = 3_000_000
KEPT_SCANS = 100
#: What a client calls techniques and risks.
TECHNIQUE_NAMES = {
    "white_text": "Hidden color", "tiny_font": "Tiny font", "off_page": "Off-page", "invisible_unicode": "Invisible Unicode",
    "metadata": "Metadata", "invisible_render": "Invisible render", "visually_hidden": "Visually hidden",
}
RISK_NAMES = {"clean": "Clean", "suspicious": "Suspicious", "manipulation": "Manipulation found"}


def named(value: Column, names: dict[str, str]) -> Column:
    """The name of a value, itself where it has none."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.try_element_at(table, value), value)


def risks(docs: DataFrame, flags: DataFrame, label: str = "rule_label") -> DataFrame:
    """doc_id, total_flags and risk of every document, those without flags included."""
    per_doc = flags.groupBy("doc_id").agg(F.count("*").alias("total_flags"), F.max(R.rank(F.col(label))).alias("worst"))
    return docs.select("doc_id").join(per_doc, "doc_id", "left").select("doc_id", F.coalesce("total_flags", F.lit(0).cast("long")).alias("total_flags"), R.risk(F.col("worst")).alias("risk"))


def technique_counts(flags: DataFrame) -> DataFrame:
    """doc_id, technique, n, and `first`, the number of the first flag, which orders a document's techniques."""
    return flags.groupBy("doc_id", "technique").agg(F.count("*").alias("n"), F.min("ord").alias("first"))


def by_technique(flags: DataFrame) -> DataFrame:
    """doc_id and the map technique -> count in first-seen order."""
    listed = technique_counts(flags).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first", "technique", "n"))).alias("t"))
    return listed.select("doc_id", F.map_from_entries(F.transform("t", lambda t: F.struct(t["technique"], t["n"]))).alias("by_technique"))


def label_counts(flags: DataFrame, label: str = "final_label") -> DataFrame:
    return flags.groupBy("doc_id").agg(*[F.count_if(F.col(label) == x).alias(f"n_{x}") for x in R.SEVERITY])


def with_overlay(flags: DataFrame, pages: DataFrame) -> DataFrame:
    """flags with the box to draw and off_page; pages: doc_id, page, page_w, page_h. Flags without a box have none."""
    own = flags.join(pages, ["doc_id", "page"], "left")
    box, off = G.overlay_box(G.rect(), F.col("technique"), F.col("page_w"), F.col("page_h"))
    has = F.col("x0").isNotNull() & F.col("page_w").isNotNull()
    return own.withColumns({"overlay": F.when(has, box), "off_page": F.when(has, off).otherwise(False)}).drop("page_w", "page_h")


def page_sizes(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "page").agg(F.max("page_w").alias("page_w"), F.max("page_h").alias("page_h"))


def flagged_pages(flags: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, page, width, height and n_boxes of the pages with a boxed flag."""
    boxed = flags.filter("x0 is not null and page >= 1").groupBy("doc_id", "page").agg(F.count("*").alias("n_boxes"))
    return boxed.join(pages, ["doc_id", "page"]).select("doc_id", "page", F.bround("page_w", 1).alias("width"), F.bround("page_h", 1).alias("height"), "n_boxes")


def within_budget(images: DataFrame, budget: int = IMAGE_BUDGET) -> DataFrame:
    """doc_id, page, chars -> with `kept`: pages in order, each kept if it still fits; one that does not is passed over."""
    listed = images.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", "chars"))).alias("p"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<page:int,chars:bigint,kept:boolean>>").alias("done"))

    def step(state: Column, p: Column) -> Column:
        fits = p["chars"] <= state["left"]
        done = F.struct(p["page"].cast("int").alias("page"), p["chars"].cast("long").alias("chars"), fits.alias("kept"))
        return F.struct((state["left"] - F.when(fits, p["chars"]).otherwise(F.lit(0))).cast("long").alias("left"), F.array_append(state["done"], done).alias("done"))

    folded = listed.select("doc_id", F.explode(F.aggregate("p", start, step, lambda s: s["done"])).alias("d"))
    return folded.select("doc_id", "d.*")


def data_url(image: Column, kept: Column) -> Column:
    png = F.hex(F.substring(image, 1, 4)) == "89504E47"
    return F.when(kept, F.concat(F.lit("data:"), F.when(png, "image/png").otherwise("image/jpeg"), F.lit(";base64,"), F.base64(image)))


def previews(flagged: DataFrame, images: DataFrame, budget: int = IMAGE_BUDGET) -> DataFrame:
    """flagged pages (of `flagged_pages`) with `image`, a data URL while a document's budget of characters lasts, else null. images: doc_id, page, image (bytes)."""
    own = flagged.join(images.select("doc_id", "page", F.col("image").alias("_image")), ["doc_id", "page"], "left")
    chars = F.ceil(F.octet_length("_image") / 3) * 4
    sizes = own.filter("_image is not null").select("doc_id", "page", chars.alias("chars"))
    kept = within_budget(sizes, budget).select("doc_id", "page", F.col("kept").alias("_kept"))
    url = F.regexp_replace(data_url(F.col("_image"), F.coalesce("_kept", F.lit(False))), "[\\r\\n]", "")
    return own.join(kept, ["doc_id", "page"], "left").withColumn("image", url).drop("_image", "_kept")


BOX = "array<double>"
FLAG = f"id: string, page: int, text: string, technique: string, reason: string, bbox: {BOX}, overlay: {BOX}, off_page: boolean, detected_by: array<string>, rule_label: string, llm_label: string, llm_reason: string, llm_status: string, final_label: string"
PAGE = "page: int, width: double, height: double, n_boxes: bigint"
#: The type of a report, for from_json.
REPORT = (
    f"doc_id string, filename string, page_count bigint, risk string, summary struct<total_flags: bigint, by_technique: map<string, bigint>>, flags array<struct<{FLAG}>>, "
    f"pages array<struct<{PAGE}>>, visual_diff struct<status: string, error: string, pages_ocrd: bigint>"
)


def counted(values: Column) -> Column:
    """The map value -> how often, in first-seen order."""
    kinds = F.array_distinct(values)
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.size(F.filter(values, lambda v: v == k)).cast("long")))


def corners(name: str) -> Column:
    box = [F.col(f"{name}{c}") for c in ("x0", "y0", "x1", "y1")]
    return F.when(box[0].isNotNull(), F.array(*box))


def reports(docs: DataFrame, flags: DataFrame, pages: DataFrame | None = None, visual: DataFrame | None = None, timings: dict[str, float] | None = None) -> DataFrame:
    """doc_id and the scan report as JSON, of every document: risk, summary, the flags in order, flagged pages and the state of the visual difference.

    docs: doc_id and, if there is one, filename. pages: doc_id, page, page_w, page_h of all pages; without them no boxes to draw, page count and page list. visual: doc_id, status,
    error, pages_ocrd; off where it is missing. timings: milliseconds by stage of the run, a key of its own if given. Flags that were reviewed have their answers, others nulls in their place. Flags are read once.
    """
    own = with_overlay(flags, pages) if pages is not None else flags.withColumns({"overlay": F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>"), "off_page": F.lit(None).cast("boolean")})
    text = lambda c: (F.col(c) if c in flags.columns else F.lit(None).cast("string")).alias(c)
    final = F.col("final_label") if "final_label" in flags.columns else F.col("rule_label")
    flag = F.struct(
        F.col("flag_id").alias("id"), "page", "text", "technique", "reason", corners("").alias("bbox"), corners("overlay.").alias("overlay"), "off_page", "detected_by", "rule_label",
        text("llm_label"), text("llm_reason"), text("llm_status"), final.alias("final_label"),
    )
    listed = own.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", flag.alias("flag")))).alias("f"))
    whole = docs.select("doc_id", text("filename") if "filename" not in docs.columns else F.col("filename")).join(listed, "doc_id", "left")
    found = F.coalesce(F.transform("f", lambda f: f["flag"]), F.array().cast(f"array<struct<{FLAG}>>"))
    whole = whole.select("doc_id", "filename", found.alias("flags"))
    if pages is None:
        whole = whole.withColumns({"page_count": F.lit(None).cast("long"), "sizes": F.lit(None).cast("array<struct<page: int, page_w: double, page_h: double>>")})
    else:
        counts = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("page_count"), F.sort_array(F.collect_set(F.struct(F.col("page").cast("int").alias("page"), F.col("page_w").cast("double").alias("page_w"), F.col("page_h").cast("double").alias("page_h")))).alias("sizes"))
        whole = whole.join(counts, "doc_id", "left").withColumn("page_count", F.coalesce("page_count", F.lit(0).cast("long")))
    whole = whole.join(visual.select("doc_id", "status", "error", F.col("pages_ocrd").cast("long").alias("pages_ocrd")), "doc_id", "left") if visual is not None else whole.withColumns({"status": F.lit(None).cast("string"), "error": F.lit(None).cast("string"), "pages_ocrd": F.lit(None).cast("long")})
    worst = F.array_max(F.transform("flags", lambda f: R.rank(f["final_label"])))
    boxed = lambda p: F.size(F.filter("flags", lambda f: (f["page"] == p["page"]) & f["bbox"].isNotNull())).cast("long")
    drawn = F.transform("sizes", lambda p: F.struct(p["page"].alias("page"), F.bround(p["page_w"], 1).alias("width"), F.bround(p["page_h"], 1).alias("height"), boxed(p).alias("n_boxes")))
    body = F.struct(
        "doc_id", "filename", "page_count", R.risk(worst).alias("risk"),
        F.struct(F.size("flags").cast("long").alias("total_flags"), counted(F.transform("flags", lambda f: f["technique"])).alias("by_technique")).alias("summary"),
        "flags", F.filter(drawn, lambda p: p["n_boxes"] > 0).alias("pages"), F.struct(F.coalesce("status", F.lit("off")).alias("status"), "error", "pages_ocrd").alias("visual_diff"),
        *([F.create_map(*[F.lit(x) for kv in timings.items() for x in kv]).alias("timings_ms")] if timings else []),
    )
    return whole.select("doc_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


def kept_scans(scans: DataFrame, keep: int = KEPT_SCANS) -> DataFrame:
    """The newest `keep` scans (scan_id, seq): a top-k, so partitions send at most `keep` rows each."""
    return scans.orderBy(F.desc("seq"), F.desc("scan_id")).limit(keep)


def current_answers(answers: DataFrame, scans: DataFrame) -> DataFrame:
    """Answers of the scan that is each session's latest; others are stale. answers: session, scan_id ...; scans: session, scan_id, seq."""
    latest = scans.groupBy("session").agg(F.max_by("scan_id", F.struct("seq", "scan_id")).alias("scan_id"))
    return answers.join(latest, ["session", "scan_id"], "left_semi")


def client_merge(report: DataFrame, answers: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Report flags with the fields of the answers, which win wherever there is an answer to the flag, nulls too."""
    own = answers.select("doc_id", "flag_id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_there"))
    joined = report.join(own, ["doc_id", "flag_id"], "left")
    for f in fields:
        joined = joined.withColumn(f, F.when(F.col("_there"), F.col(f"_{f}")).otherwise(F.col(f)))
    return joined.drop("_there", *[f"_{f}" for f in fields])


def caught_by(detected_by: Column) -> Column:
    style, visual = F.array_contains(detected_by, "style"), F.array_contains(detected_by, "visual")
    return F.when(style & visual, "both (style + visual)").when(visual, "visual (OCR diff)").otherwise("style")


def without_ai(ocr_status: Column) -> Column:
    return F.when(ocr_status == "ok", "rules + OCR only").otherwise("rules only")


def ai_label(label: Column, status: Column, state: Column, fallback: Column) -> Column:
    """The AI's label, or what stands in its place by the state of the review."""
    in_brackets = lambda before: F.concat(F.lit(before + " ("), fallback, F.lit(")"))
    waiting = F.when(state.isin("error", "off"), in_brackets("unavailable")).otherwise("review in progress…")
    other = F.when(status == "pending", waiting).when(status == "skipped", "not needed (rules already confirmed)").when(status == "invalid", in_brackets("answer rejected"))
    return F.coalesce(label, other.when(status == "unavailable", in_brackets("unavailable")).otherwise("—"))


def ai_unavailable(flags: DataFrame, state: Column) -> DataFrame:
    """doc_id and whether the second opinion is missing for the document."""
    any_missing = F.bool_or(F.col("llm_status") == "unavailable")
    return flags.groupBy("doc_id").agg(any_missing.alias("m")).select("doc_id", (state.isin("off", "error") | ((state == "done") & F.col("m"))).alias("ai_unavailable"))


def box_offsets(flags: DataFrame, pages: DataFrame) -> DataFrame:
    """flags with an overlay box -> doc_id, flag_id, y: the offset of the box in the stacked page view (pages: top, scale)."""
    joined = flags.filter("overlay is not null").join(pages.select("doc_id", "page", "top", "scale"), ["doc_id", "page"])
    return joined.select("doc_id", "flag_id", (F.col("top") + F.col("overlay.y0") * F.col("scale")).alias("y"))

