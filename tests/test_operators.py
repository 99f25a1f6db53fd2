from __future__ import annotations

import http.server
import json
import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import Row
from pyspark.sql import functions as F

from umbrascan.operators import detect, evaluate, report, review, reviewers, visual
from umbrascan.plans.engine import HiddenTextEngine
from umbrascan.sources import readers

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import tests
SCHEMA = readers.SPAN_SCHEMA.replace("doc_id STRING", "doc_id LONG")
WHITE = Row(r=255, g=255, b=255)


def span(text, line=0, no=0, block=0, doc=1, page=1, box=None, size=11.0, color=0, alpha=255, bg=WHITE):
    x0, y0, x1, y1 = map(float, box or (72, 100 + 14 * line, 250, 112 + 14 * line))
    return (doc, page, block, line, no, text, x0, y0, x1, y1, size, color, alpha, bg, 595.0, 842.0)


def spans(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def runs(spark, *rows):
    found = detect.style_runs(detect.techniques(spans(spark, *rows))).orderBy("place")
    return [(r["technique"], r["text"]) for r in found.collect()]


def test_runs_merge_over_lines_and_part_at_blocks_and_clean_spans(spark):
    w = 0xFFFFFF
    assert runs(spark, span("a", 0, color=w), span("b", 1, color=w)) == [("white_text", "a b")]
    assert runs(spark, span("a", 0, color=w), span("b", 1, color=w, block=1)) == [("white_text", "a"), ("white_text", "b")]
    assert runs(spark, span("a", 0, color=w), span("x", 1), span("b", 2, color=w)) == [("white_text", "a"), ("white_text", "b")]
    assert runs(spark, span("a", 0, color=w), span("​​", 1), span(" ", 2), span("b", 3, color=w)) == [("white_text", "a b")]
    assert runs(spark, span("a ", 0, color=w), span("b", 0, 1, size=1.0)) == [("white_text", "a"), ("tiny_font", "b")]


def test_techniques(spark):
    rows = spans(
        spark, span("off", box=(700, 100, 900, 112), color=0xFFFFFF), span("empty box", 1, box=(72, 100, 72, 112)), span("no pixels", 2, color=0xF5F5F5, bg=None),
        span("grey", 3, color=0xF0F0F0, bg=None), span("gone", 4, alpha=0, size=1.0), span("fine", 5),
    )
    found = {r["text"]: r["found"] for r in detect.techniques(rows).collect()}
    assert found == {"off": ["off_page"], "empty box": ["off_page"], "no pixels": ["white_text"], "grey": [], "gone": ["invisible_render", "tiny_font"], "fine": []}


def test_pages_dealt_once_are_not_dealt_again_with_their_text(spark):
    """Spans, traces and lines dealt by page: besides these exchanges there is one before the windows of the visual difference, and only hidden spans' texts are in it."""
    page = ["doc_id", "page"]
    rows = spans(spark, span("hidden words here"), span("seen words", 1)).repartition(*page)
    traces = spark.createDataFrame([(1, 1, 72.0, 100.0, 250.0, 112.0, 3, None)], "doc_id LONG, page INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, type INT, opacity DOUBLE").repartition(*page)
    lines = spark.createDataFrame([(1, 1, 0, "seenwards", 72.0, 114.0, 250.0, 126.0)], "doc_id LONG, page INT, ord INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE").repartition(*page)
    dealt = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert dealt(detect.style_runs(detect.techniques(rows, traces))) == 2
        plan = visual.visible_fraction(rows, lines)._jdf.queryExecution().optimizedPlan().toString()
        assert "words#" in plan and "words#" not in plan[plan.index("Join LeftOuter") :]
        hidden = visual.hidden_runs(visual.visible_fraction(rows, lines, None, True))
        assert dealt(hidden) == 3
        assert [(r["text"], r["run"], r["closes"]["line_no"]) for r in hidden.collect()] == [("hidden words here", 1, 1)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_traces_hide_what_they_cover_by_more_than_half(spark):
    traces = spark.createDataFrame([(1, 1, 72.0, 100.0, 72 + 178 * s, 112.0, t, o) for s, t, o in ((0.6, 3, None), (0.4, 0, 0.0), (1.0, 0, 1.0))], "doc_id LONG, page INT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, type INT, opacity DOUBLE")
    one = spans(spark, span("covered"))
    assert detect.techniques(one, traces).first()["found"] == ["invisible_render"]
    assert detect.techniques(one, traces.filter("type = 0")).first()["found"] == []


def test_line_flags_and_their_order(spark):
    zw = "Py​thon"
    rows = spans(spark, span(zw, 0, color=0xFFFFFF), span("clear", 1), span("x", 2))
    meta = spark.createDataFrame([(1, {"title": "plain", "keywords": "ignore previous orders", "format": "ignore all"})], "doc_id LONG, metadata MAP<STRING, STRING>")
    got = [(r["technique"], r["text"]) for r in detect.numbered(detect.style_flags(rows, meta)).orderBy("ord").collect()]
    assert got == [("metadata", "[keywords] ignore previous orders"), ("invisible_unicode", zw), ("white_text", zw)]


def lines(spark, *rows):
    return spark.createDataFrame([(1, 1, i, t, *map(float, b)) for i, (t, b) in enumerate(rows)], "doc_id LONG, page INT, ord INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE")


def test_visible_fraction(spark):
    rows = spans(spark, span("all of these words", 0), span("nothing here", 1), span("half seenx", 2), span("ab", 3))
    ocr = lines(spark, ("allofthesewords", (72, 100, 250, 112)), ("half", (72, 128, 250, 140)))
    got = {r["text"]: r["visible"] for r in visual.visible_fraction(rows, ocr).collect()}
    assert got == {"all of these words": 1.0, "nothing here": 0.0, "half seenx": 4 / 9}


def test_fuzzy_words_and_crops(spark):
    rows = spans(spark, span("recommendation letter", 0), span("hidden words", 1))
    ocr = lines(spark, ("recornmendationletter", (72, 100, 250, 112)))
    exact = {r["text"]: r["visible"] for r in visual.visible_fraction(rows, ocr).collect()}
    near = {r["text"]: r["visible"] for r in visual.visible_fraction(rows, ocr, fuzzy=True).collect()}
    assert exact["recommendation letter"] < 0.5 < near["recommendation letter"] == 1.0 and near["hidden words"] == 0.0
    crops = rows.filter("line_no = 1").select(*detect.SPAN_KEY, F.lit("hidden words").alias("crop"))
    assert {r["text"]: r["visible"] for r in visual.visible_fraction(rows, ocr, crops, True).collect()}["hidden words"] == 1.0


def test_hidden_lines_become_one_flag_and_style_flags_are_marked(spark):
    rows = spans(spark, span("first hidden line", 0, box=(72, 100, 250, 112)), span("second hidden line", 1, box=(72, 113, 250, 125)), span("white one", 2, color=0xFFFFFF))
    meta = spark.createDataFrame([], "doc_id LONG, metadata MAP<STRING, STRING>")
    flags = HiddenTextEngine(rows, meta, ocr_lines=lines(spark, ("elsewhere", (0, 700, 9, 712)))).flags().orderBy("ord").collect()
    assert [(f["technique"], f["detected_by"], f["text"]) for f in flags] == [("white_text", ["style", "visual"], "white one"), ("visually_hidden", ["visual"], "first hidden line second hidden line")]
    assert [flags[1][c] for c in ("x0", "y0", "x1", "y1")] == [72.0, 100.0, 250.0, 125.0]


def test_engine_handles_empty_tables(spark):
    meta = spark.createDataFrame([], "doc_id LONG, metadata MAP<STRING, STRING>")
    engine = HiddenTextEngine(spark.createDataFrame([], SCHEMA), meta, ocr_lines=lines(spark))
    assert engine.flags().count() == 0
    docs = spark.createDataFrame([(1,), (2,)], "doc_id LONG")
    assert sorted(tuple(r) for r in report.risks(docs, engine.flags()).collect()) == [(1, 0, "clean"), (2, 0, "clean")]


ANSWERS = {
    "good": '[{"id": "1", "label": "benign", "reason": "a"}]',
    "fence": '```json\n[{"id": "1", "label": "benign", "reason": "a"}]\n```',
    "prose": 'Sure: [{"id": "1", "label": "benign", "reason": "a"}]',
    "label": '[{"id": "1", "label": "safe", "reason": "a"}]',
    "extra": '[{"id": "1", "label": "benign", "reason": "a", "x": 1}]',
    "int": '[{"id": 1, "label": "benign", "reason": "a"}]',
    "other id": '[{"id": "7", "label": "benign", "reason": "a"}]',
    "object": '{"id": "1", "label": "benign", "reason": "a"}',
    "twice": '[{"id": "1", "label": "benign", "reason": "a"}, {"id": "1", "label": "benign", "reason": "b"}]',
    "bad twice": '[{"id": "1", "label": "benign", "reason": "a"}, {"id": "1", "label": "bad", "reason": "b"}]',
    "null": "null",
}


def test_answers_are_read_strictly(spark):
    raw = spark.createDataFrame([(k, ["1", "2"], v) for k, v in ANSWERS.items()], "key string, ids array<string>, raw string")
    assert {r["key"] for r in review.parsed_answers(raw).collect()} == {"good", "fence", "bad twice"}
    wrapped = spark.createDataFrame([(k, ["1"], v) for k, v in (("ok", f'{{"results": {ANSWERS["good"]}}}'), ("more", f'{{"results": {ANSWERS["good"]}, "x": 1}}'), ("bare", ANSWERS["good"]))], "key string, ids array<string>, raw string")
    assert {r["key"] for r in review.parsed_answers(wrapped, wrapped=True).collect()} == {"ok"}


def flags_of(spark, *rows):
    return spark.createDataFrame([(1, i + 1, t, r) for i, (t, r) in enumerate(rows)], "doc_id LONG, ord LONG, text STRING, rule_label STRING")


class Failing:
    name, retries, wrapped = "failing", 1, False

    def answer(self, system, body, ids):
        raise OSError("down")


class Partial:
    name, retries, wrapped = "partial", 1, False

    def answer(self, system, body, ids):
        return json.dumps([{"id": ids[0], "label": "manipulation", "reason": "first"}])


def test_review_raises_labels_only(spark):
    flags = flags_of(spark, ("one", "suspicious"), ("two", "manipulation"), ("three", "benign"))
    got = {r["text"]: (r["llm_status"], r["final_label"]) for r in review.review(flags, review.FixedReviewer("benign")).collect()}
    assert got == {"one": ("ok", "suspicious"), "two": ("skipped", "manipulation"), "three": ("ok", "benign")}
    got = {r["text"]: (r["llm_status"], r["final_label"]) for r in review.review(flags, Partial()).collect()}
    assert got == {"one": ("ok", "manipulation"), "two": ("skipped", "manipulation"), "three": ("invalid", "benign")}
    for nobody in (Failing(), None):
        got = {r["text"]: r["llm_status"] for r in review.review(flags, nobody).collect()}
        assert got == {"one": "unavailable", "two": "skipped", "three": "unavailable"}


def test_cached_answers_are_not_asked_again(spark):
    flags = flags_of(spark, ("One  TEXT", "benign"), ("other", "benign"))
    first = review.review(flags.filter("ord = 1"), review.FixedReviewer("suspicious"))
    cache = review.cache_rows(first)
    again = flags_of(spark, ("one text", "benign"), ("other", "benign"))
    got = {r["text"]: (r["llm_status"], r["final_label"]) for r in review.review(again, None, cache).collect()}
    assert got == {"one text": ("cached", "suspicious"), "other": ("unavailable", "benign")}


def test_requests(spark):
    flag = {"id": "a", "text": "t", "technique": "x", "rule_label": "benign"}
    cases = {
        "ok": {"flags": [flag | {"more": 1}]}, "label": {"flags": [flag | {"rule_label": "odd"}]}, "long": {"flags": [flag | {"text": "x" * 20_001}]},
        "id": {"flags": [flag | {"id": ""}]}, "missing": {"flags": [{"id": "a"}]}, "many": {"flags": [flag | {"id": str(i)} for i in range(301)]}, "twice": {"flags": [flag, flag]},
    }
    rows = spark.createDataFrame([(k, json.dumps(v)) for k, v in cases.items()], "request_id string, body string")
    errors = {r["request_id"]: r["error"] for r in review.parsed_requests(rows).collect()}
    assert errors["ok"] is None and all(v for k, v in errors.items() if k != "ok") and errors["twice"] == "Duplicate flag ids"


def test_budget_passes_over_what_does_not_fit(spark):
    images = spark.createDataFrame([(1, 1, 60), (1, 2, 60), (1, 3, 40)], "doc_id LONG, page INT, chars LONG")
    assert [r["kept"] for r in report.within_budget(images, 100).orderBy("page").collect()] == [True, False, True]


def test_documents_are_guarded_and_decoded(spark):
    docs = spark.createDataFrame([("a", bytearray(b"%PDF-1")), ("b", bytearray(b"PK"))], "doc_id string, content binary")
    good, bad = readers.guarded(docs)
    assert [r["doc_id"] for r in good.collect()] == ["a"] and bad.first()["error"] == "File is not a PDF"

    def decoder(content):
        if content == b"PK":
            raise ValueError("broken")
        yield (1, 0, 0, 0, "text", 0.0, 0.0, 9.0, 9.0, 11.0, 0, 255, None, 595.0, 842.0)

    got = {r["doc_id"]: (r["text"], r["error"]) for r in readers.decode_documents(docs, decoder).collect()}
    assert got == {"a": ("text", None), "b": (None, "ValueError: broken")}


def test_pages_are_read_and_decoded_to_lines(spark):
    pages = spark.createDataFrame([("a", 1, bytearray(b"ok")), ("a", 2, bytearray(b"bad")), ("b", 1, bytearray(b"none"))], "doc_id string, page int, image binary")

    def make_reader():
        def read(image):
            if image == b"bad":
                raise RuntimeError("engine")
            return None if image == b"none" else [([[144, 200], [288, 200], [288, 224], [144, 224]], "seen", 0.9), ([[0, 0]] * 4, "  ", 0.9)]

        return read

    raw = readers.read_pages(pages, make_reader)
    assert {(r["doc_id"], r["page"]): r["error"] for r in raw.collect()} == {("a", 1): None, ("a", 2): "RuntimeError: engine", ("b", 1): None}
    assert [tuple(r) for r in visual.decoded_lines(raw.filter("error is null")).collect()] == [("a", 1, 0, "seen", 72.0, 100.0, 144.0, 112.0)]
    crop = spark.range(1).select(visual.crop_text(F.from_json(F.lit('[{"text": "a", "score": 0.9}, {"text": "b", "score": 0.4}, {"text": "c", "score": 0.5}]'), "array<struct<text: string, score: double>>")).alias("c"))
    assert crop.first()["c"] == "a c"


def test_background_is_the_upper_median_of_a_grid():
    pixel = lambda x, y: (x, 0, 0)
    assert readers.background(pixel, (0.0, 0.0, 3.9, 0.5), 10, 10) == (2, 0, 0)
    assert readers.background(pixel, (0.0, 0.0, 199.0, 9.0), 200, 10)[0] == 100
    assert readers.background(pixel, (20.0, 0.0, 30.0, 5.0), 10, 10) is None


def test_nested_layers_flatten(spark):
    part = '{"text": "a", "bbox": [0, 1, 2, 3], "color": 5, "size": 9}'
    blocks = f'[{{"type": 0, "lines": [{{"spans": [{part}]}}]}}, {{"type": 1, "lines": []}}]'
    layers = spark.createDataFrame([("d", 1, 595.0, 842.0, blocks)], "doc_id string, page int, page_w double, page_h double, b string").withColumn("blocks", F.from_json("b", readers.NESTED))
    row = readers.flattened(layers).first()
    assert (row["text"], row["x1"], row["y1"], row["alpha"], row["size"]) == ("a", 2.0, 3.0, 255, 9.0)


def test_evaluation(spark):
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id LONG")
    flags = spark.createDataFrame([(1, ["style"]), (1, ["visual", "style"]), (2, ["visual"])], "doc_id LONG, detected_by ARRAY<STRING>")
    counts = evaluate.detector_counts(docs, flags)
    assert sorted(tuple(r) for r in counts.collect()) == [(1, 2, 1, 0, 1), (2, 1, 0, 1, 0), (3, 0, 0, 0, 0)]
    kinds = counts.withColumn("kind", F.when(F.col("doc_id") == 3, "clean").otherwise("attack"))
    assert tuple(evaluate.headline(kinds).first()) == (1, 0, 0, 1, 0, 0)


def test_flag_table_shows_what_is_invisible(spark):
    flags = spark.createDataFrame([("a\u200bb" + "x" * 60, "white_text", ["style", "visual"], "benign", None, "benign", "skipped", None)], "text string, technique string, detected_by array<string>, rule_label string, llm_label string, final_label string, llm_status string, llm_reason string")
    row = evaluate.flag_table(flags, F.lit("one.pdf")).first()
    assert row["text"] == ("a\\u200bb" + "x" * 60)[:44] and (row["file"], row["by"], row["ai"], row["ai_reason"]) == ("one", "style+visual", "-", "")


def test_settings():
    assert review.review_status({})["reason"] == "AI review disabled (LLM_PROVIDER=none)"
    assert review.review_status({"LLM_PROVIDER": " Mock "})["enabled"] and not review.review_status({"LLM_PROVIDER": "odd"})["enabled"]
    assert readers.flag({}, "X", True) and not readers.flag({"X": " Off "}, "X", True) and readers.flag({"X": "yes"}, "X", False)


class Counting:
    """Notes every call in a file, as workers are processes of their own."""

    name, wrapped = "counting", False

    def __init__(self, path, raw=None, retries=0):
        self.path, self.raw, self.retries = path, raw, retries

    def answer(self, system, body, ids):
        with open(self.path, "a") as f:
            f.write("x")
        if self.raw is None:
            raise reviewers.Unavailable("down")
        return self.raw if self.raw != "all" else json.dumps([{"id": i, "label": "suspicious", "reason": "r"} for i in ids])


@pytest.mark.parametrize("as_text", [False, True])
def test_one_call_a_document_and_attempt(spark, tmp_path, as_text):
    name = (lambda i: f"d{i}") if as_text else (lambda i: i)
    rows = [(name(d), o, f"hidden words {d} {o}", "benign") for d in range(5) for o in (1, 2)]
    flags = spark.createDataFrame(rows, f"doc_id {'string' if as_text else 'long'}, ord int, text string, rule_label string")
    for raw, retries, calls, status in (("all", 1, 5, "ok"), ("[]", 1, 10, "invalid"), (None, 0, 5, "unavailable"), (None, 2, 15, "unavailable")):
        path = tmp_path / f"calls-{raw}-{retries}"
        stats = review.review_stats(review.review(flags, Counting(str(path), raw, retries))).collect()
        assert len(path.read_text()) == calls
        assert {(r["llm_calls"], r["retries"], r["llm_error"]) for r in stats} == {(calls // 5, calls // 5 - 1, None if raw else "Unavailable: down")}
        assert all(r[{"ok": "answered"}.get(status, status)] == 2 for r in stats) and len(stats) == 5


def serve(status, body):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, dict(self.headers), json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(status)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    seen, server = [], http.server.HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.handle_request, daemon=True).start()
    return f"http://127.0.0.1:{server.server_port}", seen


@pytest.mark.parametrize(
    "status, body, found",
    [
        (200, b'{"message": {"content": "text"}, "done_reason": "stop"}', "text"),
        (200, b'{"message": {}}', ""),
        (200, b'{"message": {"content": "te"}, "done_reason": "length"}', reviewers.Unavailable),
        (500, b"broken", reviewers.Unavailable),
        (200, b"no json", reviewers.Unavailable),
        (200, b"[]", reviewers.Unavailable),
    ],
)
def test_local_reviewer(status, body, found):
    url, seen = serve(status, body)
    own = reviewers.LocalReviewer(url, "m", seconds=5)
    if isinstance(found, str):
        assert own.answer("s", "b", ["1"]) == found
    else:
        with pytest.raises(found):
            own.answer("s", "b", ["1"])
    path, _, payload = seen[0]
    assert path == "/api/chat" and payload["model"] == "m" and payload["format"]["properties"]["results"]["items"]["properties"]["id"]["enum"] == ["1"]


def test_hosted_reviewer():
    url, seen = serve(200, b'{"content": [{"type": "text", "text": "a"}, {"type": "other"}, {"type": "text", "text": "b"}], "stop_reason": "end_turn"}')
    own = reviewers.choose({"LLM_PROVIDER": "hosted", "LLM_URL": url, "LLM_MODEL": "m", "LLM_KEY": "k"}).reviewer
    assert own.answer("s", "b", ["1"]) == "ab" and own.retries == 0
    assert {k.lower(): v for k, v in seen[0][1].items()}["x-api-key"] == "k" and seen[0][2]["system"] == "s"
    url, _ = serve(200, b'{"content": [], "stop_reason": "max_tokens"}')
    with pytest.raises(reviewers.Unavailable):
        reviewers.HostedReviewer(url, "m", "k").answer("s", "b", ["1"])
    with pytest.raises(reviewers.Unavailable, match="not reachable"):
        reviewers.HostedReviewer("http://127.0.0.1:9", "m", "k").answer("s", "b", ["1"])
    assert reviewers.choose({"LLM_PROVIDER": "hosted"}).reason == "AI review not configured for LLM_PROVIDER=hosted"


# Failing pages, close looks, answers


def test_reading_ends_at_the_first_page_that_fails(spark):
    item = {"polygon": [[0.0, 0.0], [1190.0, 0.0], [1190.0, 240.0], [0.0, 240.0]], "text": "seen words", "score": 0.9}
    rows = [(1, 1, [item], None), (1, 2, None, "broken lamp"), (1, 3, [item], None), (1, 4, None, "later"), (2, 1, [item], None), (2, 2, [], None), (3, 5, None, "at once")]
    reads = spark.createDataFrame(rows, f"doc_id long, page int, items {readers.ITEMS}, error string")
    kept = {(r["doc_id"], r["page"]) for r in visual.before_failure(reads).collect()}
    assert kept == {(1, 1), (2, 1), (2, 2)}
    docs = spark.createDataFrame([(1,), (2,), (3,), (4,)], "doc_id long")
    status = {r["doc_id"]: tuple(r)[1:] for r in visual.read_status(reads, docs).collect()}
    assert status == {1: ("unavailable", "broken lamp", None), 2: ("ok", None, 2), 3: ("unavailable", "at once", None), 4: ("ok", None, 0)}
    table = spans(spark, *[span("seen words", doc=d, page=p, box=(72, 100, 250, 112)) for d in (1, 2) for p in (1, 2, 3)], span("hidden thing", doc=1, page=1, line=1, box=(72, 300, 250, 312)), span("hidden thing", doc=1, page=3, line=1, box=(72, 300, 250, 312)))
    engine = HiddenTextEngine(table, spark.createDataFrame([], "doc_id long, metadata map<string,string>"), reads=reads)
    found = {(r["doc_id"], r["page"], r["text"]) for r in engine.flags().collect()}
    assert found == {(1, 1, "hidden thing"), (2, 2, "seen words")}  # nothing is said about pages that were not read
    assert engine.visual_status(docs).count() == 4
    engine.release()


def test_crop_boxes_stay_on_the_page(spark):
    rows = [span("a", box=(0.5, 10, 20, 20)), span("b", no=1, box=(590, 838, 700, 900)), span("c", no=2, box=(-50, 10, -2.5, 20)), span("d", no=3, box=(-50, 10, -1, 20)), span("e", no=4, box=(600, 10, 650, 20))]
    found = {r["text"]: tuple(r[c] for c in ("cx0", "cy0", "cx1", "cy1")) for r in visual.crop_boxes(spans(spark, *rows)).collect()}
    assert found["a"] == (0.0, 8.0, 22.0, 22.0) and found["b"] == (588.0, 836.0, 595.0, 842.0) and found["d"] == (0.0, 8.0, 1.0, 22.0)
    assert found["c"] == found["e"] == (None,) * 4


@pytest.mark.parametrize("pixels,channels,expected", [(bytes([100] * 96 + [140] * 4), 1, 40.0), (bytes([100] * 98 + [140] * 2), 1, 0.8), (bytes([10, 20, 30, 40, 50, 60]), 3, 28.8), (b"", 1, 0.0), (bytes([7]), 1, 0.0)])
def test_spread_between_percentiles(spark, pixels, channels, expected):
    assert visual.grey_spread(pixels, channels) == pytest.approx(expected)
    got = spark.createDataFrame([(bytearray(pixels), channels), (None, 1)], "p binary, c int").select(visual.spread(F.col("p"), F.col("c")).alias("s")).collect()
    assert got[0]["s"] == pytest.approx(expected) and got[1]["s"] is None


def test_flat_crops_are_not_read(spark):
    rows = [(1, 1, 0, 0, 0, bytearray([100] * 96 + [140] * 4), 10, 10, 1), (1, 1, 0, 0, 1, bytearray([100] * 99 + [255]), 10, 10, 1), (1, 1, 0, 0, 2, bytearray([0, 255] * 50), 10, 10, 1), (1, 1, 0, 0, 3, None, None, None, None)]
    pictures = spark.createDataFrame(rows, "doc_id long, page int, block_no int, line_no int, span_no int, pixels binary, width int, height int, channels int")

    def make():
        def read(pixels, width, height, channels):
            if pixels[0] == 0:
                raise RuntimeError("smudged")
            return [("read", 0.9), ("", 0.9), ("faint", 0.4), ("twice", 0.5)]

        return read

    got = {r["span_no"]: (r["crop"], r["error"]) for r in visual.read_crops(pictures, make).collect()}
    assert got == {0: ("read twice", None), 1: ("", None), 2: (None, "RuntimeError: smudged"), 3: ("", None)}


@pytest.mark.parametrize("wrapped", [False, True])
def test_complete_by_the_parsers_own_rules(spark, wrapped):
    one, two = '{"id": "1", "label": "benign", "reason": "a"}', '{"id": "2", "label": "suspicious", "reason": "b"}'
    shell = (lambda t: f'{{"results": {t}}}') if wrapped else (lambda t: t)
    raws = [
        shell(f"[{one}, {two}]"), f"```json\n{shell(f'[{one}, {two}]')}\n```", f"  ```{shell(f'[{one}, {two}]')}``` ", shell(f"[{one}]"), shell(f"[{one}, {one}, {two}]"),
        shell(f'[{one}, {{"id": "2", "label": "benign", "reason": "b", "x": 1}}]'), shell(f'[{one}, {{"id": "2", "label": "benign"}}]'), shell(f'[{one}, {two}, {{"id": "3", "label": "benign", "reason": "c"}}]'),
        shell(f'[{one}, {{"id": "2", "label": "benign", "label": "benign", "reason": "b"}}]'), shell(f'[{one}, {{"id": 2, "label": "benign", "reason": "b"}}]'), '{"results": [], "x": 1}', f'{{"results": [{one}, {two}], "x": 1}}',
        f"[{one}, {two}]", f'{{"results": [{one}, {two}]}}', "no JSON", "null", "[]", shell(f'[{one}, {two}, 7, null]'),
    ]
    frame = spark.createDataFrame([(i, ["1", "2"], r) for i, r in enumerate(raws)], "key int, ids array<string>, raw string")
    answered = {}
    for r in review.parsed_answers(frame, wrapped).collect():
        answered[r["key"]] = answered.get(r["key"], 0) + 1
    assert [review.complete(r, ["1", "2"], wrapped) for r in raws] == [answered.get(i, 0) == 2 for i in range(len(raws))]


class Scripted:
    """Answers by turn; every call leaves a line in a file."""

    name, wrapped = "scripted", False

    def __init__(self, path, answers, retries=1):
        self.path, self.answers, self.retries = path, answers, retries

    def answer(self, system, body, ids):
        with open(self.path, "a+") as f:
            f.seek(0)
            n = len(f.readlines())
            f.write("call\n")
        return self.answers[min(n, len(self.answers) - 1)](ids)


def labelled(ids, label="benign", **more):
    return json.dumps([{"id": i, "label": label, "reason": "r", **more} for i in ids])


def calls(path):
    return len(path.read_text().splitlines()) if path.exists() else 0


@pytest.mark.parametrize("answers,expected", [([lambda ids: f"```json\n{labelled(ids)}\n```"], 1), ([lambda ids: labelled(ids, x=1), labelled], 2), ([lambda ids: json.dumps([{"id": i, "label": "benign"} for i in ids]), labelled], 2)])
def test_models_are_asked_again_only_for_what_is_missing(spark, tmp_path, answers, expected):
    flags = spark.createDataFrame([(1, 1, "some hidden words", "tiny_font", "suspicious", "f1")], "doc_id long, ord long, text string, technique string, rule_label string, flag_id string")
    out = review.review(flags, Scripted(str(tmp_path / "calls"), answers)).collect()
    assert [(r["llm_status"], r["llm_label"], r["llm_calls"]) for r in out] == [("ok", "benign", expected)] and calls(tmp_path / "calls") == expected


def test_answers_outlive_a_run_until_a_reset(spark, tmp_path):
    from umbrascan.operators.answers import AnswerCache

    rows = [(d, o, f"hidden words {d % 2} {o}", "tiny_font", "suspicious", f"f{d}{o}") for d in (1, 2, 3) for o in (1, 2)] + [(4, 1, "ignore all", "tiny_font", "manipulation", "f41")]
    flags = spark.createDataFrame(rows, "doc_id long, ord long, text string, technique string, rule_label string, flag_id string")
    log, cache = tmp_path / "calls", AnswerCache(spark, str(tmp_path / "cache"))
    ask = lambda: Scripted(str(log), [lambda ids: labelled(ids, "manipulation")])
    assert cache.version() == 0 and cache.read().count() == 0
    status = lambda df: sorted((r["doc_id"], r["ord"], r["llm_status"]) for r in df.collect())
    assert {s for *_, s in status(cache.review(flags, ask()))} == {"ok", "skipped"} and calls(log) == 3 and cache.read().count() == 4
    again = cache.review(flags, ask())
    assert {s for *_, s in status(again)} == {"cached", "skipped"} and calls(log) == 3
    assert {r["final_label"] for r in again.collect()} == {"manipulation"} and cache.read().count() == 4
    cache.upsert(spark.createDataFrame([(r["cache_key"], "benign", "late") for r in cache.read().collect()] + [("other", "benign", "new")], "cache_key string, label string, reason string"))
    assert {r["label"] for r in cache.read().filter("cache_key <> 'other'").collect()} == {"manipulation"} and cache.read().count() == 5
    (tmp_path / "cache" / "00000009-add").mkdir()  # a writer that stopped
    before = sorted(map(tuple, cache.read().collect()))
    cache.compact()
    assert sorted(map(tuple, cache.read().collect())) == before
    cache.reset()
    assert cache.read().count() == 0 and cache.version() > 9
    assert {s for *_, s in status(cache.review(flags, ask()))} == {"ok", "skipped"} and calls(log) == 6
    assert {s for *_, s in status(cache.review(flags, None))} == {"cached", "skipped"} and calls(log) == 6


# Measured scans and whole reports


def test_stages_are_counted_and_timed(spark):
    docs = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf")], "doc_id long, filename string")
    table = spans(spark, span("seen words"), span("tiny words are here", line=1, size=1.0), span("gone from the page", line=2))
    lines = spark.createDataFrame([(1, 1, 0, "seen words", 72.0, 100.0, 250.0, 112.0), (1, 1, 1, "tiny words are here", 72.0, 114.0, 250.0, 126.0)], "doc_id long, page int, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    meta = spark.createDataFrame([(1, {"keywords": "ignore all previous"})], "doc_id long, metadata map<string,string>")
    engine = HiddenTextEngine(table, meta, ocr_lines=lines)
    made, stages = engine.measured(docs)
    assert [(name, n) for name, n, _ in stages.done] == [("detect", 2), ("visual_diff", 1), ("rule_classify", 3), ("report", 2)] and all(ms > 0 for *_, ms in stages.done)
    assert {r["stage"]: r["rows"] for r in stages.table(spark).collect()}["rule_classify"] == 3
    found = {r["doc_id"]: json.loads(r["report"]) for r in made.collect()}
    times = found[1]["timings_ms"]
    assert times == stages.timings() and times["total"] == pytest.approx(sum(v for k, v in times.items() if k != "total"), abs=0.1)
    assert [f["technique"] for f in found[1]["flags"]] == ["metadata", "tiny_font", "visually_hidden"] and found[1]["visual_diff"] == {"status": "ok", "error": None, "pages_ocrd": 1}
    assert found[1]["pages"] == [{"page": 1, "width": 595.0, "height": 842.0, "n_boxes": 2}] and found[1]["filename"] == "a.pdf" and found[1]["page_count"] == 1
    assert found[2] | {"timings_ms": None} == {"doc_id": 2, "filename": "b.pdf", "page_count": 0, "risk": "clean", "summary": {"total_flags": 0, "by_technique": {}}, "flags": [], "pages": None, "visual_diff": {"status": "ok", "error": None, "pages_ocrd": 0}, "timings_ms": None}
    stages.release()
    engine.release()


def test_reports_without_pages_and_with_reviewed_flags(spark):
    docs = spark.createDataFrame([(1,)], "doc_id long")
    engine = HiddenTextEngine(spans(spark, span("tiny words are here", size=1.0, box=(-5, 10, 20.04, 20))), spark.createDataFrame([], "doc_id long, metadata map<string,string>"))
    bare = json.loads(report.reports(docs, engine.flags()).first()["report"])
    assert bare["filename"] is None and bare["page_count"] is None and bare["pages"] is None and bare["flags"][0]["overlay"] is None and bare["visual_diff"]["status"] == "off" and "timings_ms" not in bare
    done = json.loads(engine.reports(docs, flags=engine.review(review.FixedReviewer("manipulation"))).first()["report"])
    flag = done["flags"][0]
    assert (flag["rule_label"], flag["llm_label"], flag["llm_status"], flag["final_label"]) == ("suspicious", "manipulation", "ok", "manipulation") and done["risk"] == "manipulation"
    assert flag["bbox"] == [-5.0, 10.0, 20.0, 20.0] and flag["overlay"] == [0.0, 10.0, 20.0, 20.0] and flag["off_page"] is True
    engine.release()


def test_pages_are_rendered_and_shown_within_the_budget(spark):
    pages = spark.createDataFrame([(1, 1, bytearray(b"doc")), (1, 2, bytearray(b"doc")), (1, 3, bytearray(b"bad")), (2, 1, bytearray(b"doc"))], "doc_id long, page int, content binary")

    def make():
        def render(content, page, zoom):
            if content == b"bad":
                raise RuntimeError("no page")
            return b"\x89PNG" + bytes([page]) * int(50 * zoom)

        return render

    images = readers.render_pages(pages, make)
    assert {(r["doc_id"], r["page"], r["error"]) for r in images.collect()} == {(1, 1, None), (1, 2, None), (1, 3, "RuntimeError: no page"), (2, 1, None)}
    flagged = spark.createDataFrame([(1, 1, 10.0, 20.0, 1), (1, 2, 10.0, 20.0, 2), (1, 3, 10.0, 20.0, 1), (2, 1, 10.0, 20.0, 1), (2, 9, 10.0, 20.0, 1)], "doc_id long, page int, width double, height double, n_boxes long")
    shown = {(r["doc_id"], r["page"]): r["image"] for r in report.previews(flagged, images, 200).collect()}
    assert shown[1, 1].startswith("data:image/png;base64,") and shown[2, 1] and shown[1, 2] is None and shown[1, 3] is None and shown[2, 9] is None and len(shown) == 5
    assert len(shown[1, 1].split(",")[1]) == 140
