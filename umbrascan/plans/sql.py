"""The same queries as DuckDB SQL: named common table expressions, and the text of a query over those it needs."""

from __future__ import annotations

import re

from ..functions import rules as R
from ..functions.text import INVISIBLE, TAG_BASE
from ..operators.detect import REASONS
from ..operators.report import RISK_NAMES, TECHNIQUE_NAMES
from ..sources.planted import HIDDEN_TAGS, PAYLOADS, ZWNJ, ZWSP


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


ALL_INVISIBLE = "".join(INVISIBLE)
TAGS = rf"\x{{E0000}}-\x{{E007F}}"
SPACE = r"\s\x0b\x1c-\x1f\x85\p{Z}"


def count_of(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, {q(pattern)})) AS INTEGER)"


def invisible_count(text: str) -> str:
    return count_of(text, f"[{ALL_INVISIBLE}{TAGS}]")


def tag_count(text: str) -> str:
    return count_of(text, f"[{TAGS}]")


def decoded(text: str) -> str:
    plain = "".join(map(chr, range(0x20, 0x7F)))
    hidden = "".join(chr(TAG_BASE + ord(c)) for c in plain)
    kept = f"regexp_replace({text}, {q(r'[^\x{E0020}-\x{E007E}]')}, '', 'g')"
    return f"translate({kept}, {q(hidden)}, {q(plain)})"


def names(text: str) -> str:
    """Occurrences by position: the characters beside each one, a space beyond the edges."""
    shown = f"' ' || {text} || ' '"
    beside = [f"substr(p, i - 1, 1)", f"substr(p, i + 1, 1)"]
    hides = f"(strpos({q(ALL_INVISIBLE)}, {beside[0]}) > 0 OR strpos({q(ALL_INVISIBLE)}, {beside[1]}) > 0 OR NOT (regexp_matches({beside[0]}, {q(f'^[{SPACE}]')}) OR regexp_matches({beside[1]}, {q(f'^[{SPACE}]')})))"
    label = "CASE substr(p, i, 1) " + " ".join(f"WHEN {q(c)} THEN {q(n)}" for c, (n, _) in INVISIBLE.items()) + " END"
    found = f"(SELECT list_sort(list(DISTINCT {label})) FROM (SELECT p, unnest(range(2, length(p))) AS i FROM (SELECT {shown} AS p)) WHERE strpos({q(ALL_INVISIBLE)}, substr(p, i, 1)) > 0 AND {hides})"
    tag = f"CASE WHEN {tag_count(text)} > 0 THEN ['UNICODE TAG CHARACTERS'] ELSE [] END"
    return f"CASE WHEN {invisible_count(text)} = 0 THEN [] ELSE list_concat(coalesce({found}, []), {tag}) END"


def reveal(text: str) -> str:
    for c, (_, mark) in INVISIBLE.items():
        text = f"replace({text}, {q(c)}, {q(f'⟦{mark}⟧')})"
    return text


def annotate(text: str) -> str:
    point = lambda c: f"U+{ord(c):04X}"
    counts = ", ".join(f"CASE WHEN strpos({text}, {q(c)}) > 0 THEN {q(point(c) + ' x')} || len(string_split({text}, {q(c)})) - 1 END" for c in sorted(INVISIBLE, key=point))
    parts = f"list_filter([{counts}, CASE WHEN {tag_count(text)} > 0 THEN 'tag chars x' || {tag_count(text)} END], lambda x: x IS NOT NULL)"
    listed = f"CASE WHEN len({parts}) > 0 THEN array_to_string({parts}, ', ') ELSE 'none' END"
    hidden = f"CASE WHEN {decoded(text)} <> '' THEN '; decoded hidden tag-character text: \"' || {decoded(text)} || '\"' ELSE '' END"
    pieces = f"regexp_extract_all({text}, {q(f'(?s)[{TAGS}]+|[^{TAGS}]+')})"
    shown = f"array_to_string(list_transform({pieces}, lambda p: CASE WHEN {tag_count('p')} > 0 THEN '⟦' || length(p) || ' TAG CHARS⟧' ELSE p END), '')"
    for c in INVISIBLE:
        shown = f"replace({shown}, {q(c)}, {q(f'⟦{point(c)}⟧')})"
    return f"'[scanner note: ' || {invisible_count(text)} || ' invisible characters (' || {listed} || ')' || {hidden} || ']' || chr(10) || coalesce({shown}, '')"


def strip(text: str) -> str:
    return f"regexp_replace({text}, {q(f'^[{SPACE}]+|[{SPACE}]+$')}, '', 'g')"


def normalize(text: str) -> str:
    return f"regexp_replace(lower({text}), {q(r'[^\p{L}\p{N}]')}, '', 'g')"


def words(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array({text}, {q(f'[{SPACE}]+')}), lambda w: {normalize('w')}), lambda w: w <> '')"


def escaped(text: str, tag: str) -> str:
    cut = f"substr({text}, 1, 1000)"
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        cut = f"replace({cut}, {q(raw)}, {q(safe)})"
    return f"regexp_replace({cut}, {q('(?i)' + re.escape(tag))}, '[removed]', 'g')"


def luminance(r: str, g: str, b: str) -> str:
    one = lambda c: f"(CASE WHEN ({c}) / 255.0::DOUBLE <= 0.03928 THEN ({c}) / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow((({c}) / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"
    return f"(0.2126::DOUBLE * {one(r)} + 0.7152::DOUBLE * {one(g)} + 0.0722::DOUBLE * {one(b)})"


def channels(c: str) -> tuple[str, str, str]:
    return tuple(f"(({c} >> {s}) & 255)" for s in (16, 8, 0))


CONTRAST = f"(greatest({luminance(*channels('color'))}, {luminance('bg_r', 'bg_g', 'bg_b')}) + 0.05::DOUBLE) / (least({luminance(*channels('color'))}, {luminance('bg_r', 'bg_g', 'bg_b')}) + 0.05::DOUBLE)"


def area(p: str) -> str:
    return f"(greatest({p}x1 - {p}x0, 0.0::DOUBLE) * greatest({p}y1 - {p}y0, 0.0::DOUBLE))"


def overlap(a: str, b: tuple[str, str, str, str] | str) -> str:
    if isinstance(b, str):
        b = tuple(b + c for c in ("x0", "y0", "x1", "y1"))
    inter = f"(greatest(least({a}x1, {b[2]}) - greatest({a}x0, {b[0]}), 0.0::DOUBLE) * greatest(least({a}y1, {b[3]}) - greatest({a}y0, {b[1]}), 0.0::DOUBLE))"
    return f"(CASE WHEN {area(a)} > 0 THEN {inter} / {area(a)} ELSE 0.0::DOUBLE END)"


def first_phrase(lowered: str, patterns: tuple[str, ...]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({lowered}, {q(p)}) THEN regexp_extract({lowered}, {q(p)})" for p in patterns) + " END"


def text_rule(text: str, technique: str) -> tuple[str, str]:
    """(label, why)"""
    low = f"lower({text})"
    addressed, instructed = first_phrase(low, R.ADDRESSING), first_phrase(low, R.INSTRUCTION)
    n = count_of(text, "[a-zA-Z]{2,}")
    hint = "(" + " OR ".join(f"strpos({low}, {q(h)}) > 0" for h in R.HINTS) + ")"
    cases = [
        (f"({addressed}) IS NOT NULL", "manipulation", f"'Hidden text addresses the classifier/scanner itself (matched \"' || ({addressed}) || '\").'"),
        (f"({instructed}) IS NOT NULL", "manipulation", f"'Contains AI-directed instruction language (matched \"' || ({instructed}) || '\").'"),
        (f"{hint} AND {n} <= 8", "benign", q(R.WHY_BENIGN_HINT)),
        (f"{n} <= 2 AND {technique} <> 'invisible_unicode'", "benign", q(R.WHY_SHORT)),
        ("TRUE", "suspicious", q(R.WHY_SUSPICIOUS)),
    ]
    make = lambda k: "CASE " + " ".join(f"WHEN {c[0]} THEN {q(c[1]) if k == 1 else c[2]}" for c in cases) + " END"
    return make(1), make(2)


def rank(label: str) -> str:
    return f"(CASE {label} WHEN 'benign' THEN 0 WHEN 'suspicious' THEN 1 WHEN 'manipulation' THEN 2 END)"


def risk(worst: str) -> str:
    return f"(CASE coalesce({worst}, 0) WHEN 0 THEN 'clean' WHEN 1 THEN 'suspicious' ELSE 'manipulation' END)"


def more_severe(a: str, b: str) -> str:
    return f"(CASE WHEN {rank(b)} > {rank(a)} THEN {b} ELSE {a} END)"


def named(value: str, table: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {value} END"


PAYLOAD = f"list_extract([{', '.join(map(q, PAYLOADS))}], CAST(doc_id % {len(PAYLOADS)} AS INTEGER) + 1)"
FIRST_SEVEN = "list_filter([" + ", ".join(f"substr(t, {i}, 1)" for i in range(1, 8)) + "], lambda c: c <> '')"
TRANSPARENT = f"regexp_matches({strip('text')}, {q(f'^[{ALL_INVISIBLE}' + r'\x{E0000}-\x{10FFFF}]*$')})"
FOUND = "list_filter([CASE WHEN hidden THEN 'invisible_render' END, CASE WHEN off THEN 'off_page' END, CASE WHEN white THEN 'white_text' END, CASE WHEN tiny THEN 'tiny_font' END], lambda x: x IS NOT NULL)"
RGB = "'rgb(' || " + " || ', ' || ".join(channels("color")) + " || ')'"
BOX = lambda *c: "'(' || " + " || ', ' || ".join(f"CAST(round_even({x}, 0) AS INTEGER)" for x in c) + " || ')'"
REASON = "CASE technique " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in REASONS.items()) + " END"
LABEL, WHY = text_rule("coalesce(classify_text, text)", "technique")

#: name -> (the names it reads, body)
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "raw": ((), "SELECT doc_id, lang, source, CAST(i AS INTEGER) AS line_no, string_split(coalesce(text, ''), chr(10))[i + 1] AS t, CAST((doc_id * 31 + (i // 2) * 7) % 40 AS INTEGER) AS h FROM (SELECT *, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)"),
    "carried": (("raw",), f"SELECT doc_id, line_no, h, CASE WHEN (h < 6 OR h IN (10, 11)) AND doc_id % 3 = 0 THEN {PAYLOAD} ELSE t END AS t FROM raw"),
    "lines": (("carried",), f"SELECT doc_id, line_no, h, CASE h WHEN 6 THEN substr(t, 1, 2) || {q(ZWSP)} || substr(t, 3) WHEN 7 THEN t || {q(HIDDEN_TAGS)} WHEN 8 THEN t || {q(ZWSP)} WHEN 9 THEN array_to_string({FIRST_SEVEN}, {q(ZWNJ)}) || substr(t, 8) ELSE t END AS t FROM carried"),
    "placed": (("lines",), "SELECT *, line_no // 50 + 1 AS page, (line_no % 50) // 5 AS block_no, CASE WHEN h = 3 THEN 700.0::DOUBLE ELSE 72.0::DOUBLE END AS x0, CASE WHEN h = 5 THEN 900.0::DOUBLE ELSE 0.0::DOUBLE END + 72.0::DOUBLE + 14.0::DOUBLE * (line_no % 50) AS y0, least(4.0::DOUBLE * length(t), 451.0::DOUBLE) AS w FROM lines"),
    "boxed": (("placed",), "SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(block_no AS INTEGER) AS block_no, line_no, h, t, x0, y0, x0 + w AS x1, y0 + 12.0::DOUBLE AS y1 FROM placed"),
    "spans": (("boxed",), f"SELECT doc_id, page, block_no, line_no, CAST(s.n AS INTEGER) AS span_no, s.text AS text, x0, y0, x1, y1, CASE WHEN h IN (2, 5) THEN 1.0::DOUBLE ELSE 11.0::DOUBLE END AS size, CASE h WHEN 0 THEN 16777215 WHEN 1 THEN 1186391 WHEN 12 THEN 16119285 ELSE 0 END AS color, s.alpha AS alpha, CASE h WHEN 12 THEN NULL WHEN 1 THEN 15 ELSE 255 END AS bg_r, CASE h WHEN 12 THEN NULL WHEN 1 THEN 23 ELSE 255 END AS bg_g, CASE h WHEN 12 THEN NULL WHEN 1 THEN 82 ELSE 255 END AS bg_b, 595.0::DOUBLE AS page_w, 842.0::DOUBLE AS page_h FROM (SELECT *, unnest(CASE WHEN h = 0 THEN [{{'n': 0, 'text': substr(t, 1, length(t) // 2), 'alpha': 255}}, {{'n': 1, 'text': {q(ZWSP + ZWSP)}, 'alpha': 255}}, {{'n': 2, 'text': substr(t, length(t) // 2 + 1), 'alpha': 255}}] WHEN h = 4 AND line_no % 2 = 0 THEN [{{'n': 0, 'text': substr(t, 1, length(t) // 2), 'alpha': 0}}, {{'n': 1, 'text': substr(t, length(t) // 2 + 1), 'alpha': 255}}] WHEN h = 4 THEN [{{'n': 0, 'text': t, 'alpha': 0}}] ELSE [{{'n': 0, 'text': t, 'alpha': 255}}] END) AS s FROM boxed)"),
    "traces": (("boxed",), "SELECT doc_id, page, x0, y0, x0 + (x1 - x0) * CASE WHEN h = 14 THEN 0.4::DOUBLE ELSE 0.6::DOUBLE END AS x1, y1, CASE WHEN h = 13 THEN 3 ELSE 0 END AS type, CASE h WHEN 14 THEN 0.0::DOUBLE WHEN 15 THEN 1.0::DOUBLE END AS opacity FROM boxed WHERE h IN (13, 14, 15)"),
    "ocr": (("boxed",), "SELECT doc_id, page, line_no AS ord, CASE WHEN h = 16 THEN translate(replace(t, ' ', ''), 'n', 'm') ELSE replace(t, ' ', '') END AS text, x0, y0, x1, y1 FROM boxed WHERE h NOT IN (0, 2, 10, 11) AND replace(t, ' ', '') <> ''"),
    "fields": ((), f"SELECT doc_id, CAST(f.pos AS INTEGER) AS pos, f.key AS key, f.value AS value FROM (SELECT doc_id, unnest([{{'pos': 1, 'key': 'author', 'value': coalesce(source, '')}}, {{'pos': 2, 'key': 'keywords', 'value': CASE WHEN doc_id % 5 = 0 THEN 'keywords: ' || {PAYLOAD} ELSE coalesce(lang, '') END}}, {{'pos': 3, 'key': 'subject', 'value': CASE WHEN doc_id % 7 = 0 THEN repeat(coalesce(lang, 'xx'), 101) ELSE coalesce(lang, '') END}}]) AS f FROM documents) WHERE f.value <> ''"),
    "traced": (("spans", "traces"), f"SELECT DISTINCT s.doc_id, s.page, s.block_no, s.line_no, s.span_no FROM spans s JOIN traces t ON s.doc_id = t.doc_id AND s.page = t.page AND (t.type = 3 OR coalesce(t.opacity, 1) = 0) AND {overlap('s.', 't.')} > 0.5"),
    "judged_style": (("spans", "traced"), f"SELECT s.*, alpha = 0 OR t.doc_id IS NOT NULL AS hidden, {overlap('s.', ('0.0::DOUBLE', '0.0::DOUBLE', 'page_w', 'page_h'))} < 0.5 AS off, size < 4.0 AS tiny FROM spans s LEFT JOIN traced t USING (doc_id, page, block_no, line_no, span_no) WHERE NOT {TRANSPARENT}"),
    "whites": (("judged_style",), f"SELECT *, CASE WHEN off THEN FALSE WHEN bg_r IS NOT NULL THEN {CONTRAST} < 1.5 ELSE {' AND '.join(f'{c} > 240' for c in channels('color'))} END AS white FROM judged_style"),
    "techniques": (("whites",), f"SELECT *, {FOUND} AS found, array_to_string(list_filter([CASE WHEN off THEN 'bbox ' || {BOX('x0', 'y0', 'x1', 'y1')} || ' vs page ' || {BOX('0.0::DOUBLE', '0.0::DOUBLE', 'page_w', 'page_h')} END, CASE WHEN white THEN 'text color ' || {RGB} || CASE WHEN bg_r IS NULL THEN '' ELSE ' on background rgb(' || bg_r || ', ' || bg_g || ', ' || bg_b || '), contrast ' || printf('%.2f', {CONTRAST}) || ':1' END END, CASE WHEN tiny THEN 'font size ' || printf('%.1f', size) || 'pt' END], lambda x: x IS NOT NULL), '; ') AS detail FROM whites"),
    "steps": (("techniques",), "SELECT *, found[1] AS label, lag(found[1]) OVER w AS before, lead(found[1]) OVER w AS after, lead(line_no) OVER w AS next_line, lead(span_no) OVER w AS next_span FROM techniques WINDOW w AS (PARTITION BY doc_id, page, block_no ORDER BY line_no, span_no)"),
    "runs": (("steps",), "SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM label THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, block_no ORDER BY line_no, span_no) AS run FROM steps"),
    "run_groups": (("runs",), "SELECT doc_id, page, block_no, label AS technique, list(text ORDER BY line_no, span_no) AS texts, list(detail ORDER BY line_no, span_no) AS details, list_sort(list_distinct(flatten(list(found[2:])))) AS also, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, max(CASE WHEN after IS NOT DISTINCT FROM label THEN NULL ELSE next_line END) AS close_line, max(CASE WHEN after IS NOT DISTINCT FROM label THEN NULL ELSE next_span END) AS close_span FROM runs WHERE label IS NOT NULL GROUP BY doc_id, page, block_no, run, label"),
    "run_flags": (("run_groups",), f"SELECT doc_id, 1 AS phase, page, block_no, coalesce(close_line, 2147483647) AS line_no, 1 AS kind, coalesce(close_span, 0) AS span_no, {strip('list_reduce(texts, lambda a, t: a || CASE WHEN ends_with(a, ' + q(' ') + ') THEN ' + q('') + ' ELSE ' + q(' ') + ' END || t)')} AS text, technique, ({REASON}) || CASE WHEN len(list_filter(details, lambda d: d <> '')) > 0 THEN ' (' || array_to_string(list_filter(details, lambda d, i: d <> '' AND list_position(details, d) = i), '; ') || ')' ELSE '' END || CASE WHEN len(also) > 0 THEN ' Also: ' || array_to_string(also, ', ') || '.' ELSE '' END AS reason, x0, y0, x1, y1, CAST(NULL AS VARCHAR) AS classify_text FROM run_groups"),
    "line_texts": (("spans",), "SELECT doc_id, page, block_no, line_no, string_agg(text, '' ORDER BY span_no) AS line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM spans GROUP BY doc_id, page, block_no, line_no"),
    "line_names": (("line_texts",), f"SELECT *, {decoded('line')} AS tags, {names('line')} AS names FROM line_texts WHERE {invisible_count('line')} > 0"),
    "line_flags": (("line_names",), f"SELECT doc_id, 1 AS phase, page, block_no, line_no, 0 AS kind, 0 AS span_no, {strip('CASE WHEN tags <> ' + q('') + ' THEN line || chr(10) || ' + q('[decoded tag text] ') + ' || tags ELSE line END')} AS text, 'invisible_unicode' AS technique, {q(REASONS['invisible_unicode'])} || ' (found: ' || array_to_string(names, ', ') || CASE WHEN tags <> '' THEN '; decoded hidden tag text: \"' || tags || '\"' ELSE '' END || ')' AS reason, x0, y0, x1, y1, CASE WHEN tags <> '' THEN tags END AS classify_text FROM line_names WHERE len(names) > 0"),
    "meta_flags": (("fields",), f"SELECT doc_id, 0 AS phase, 0 AS page, 0 AS block_no, pos AS line_no, 0 AS kind, 0 AS span_no, {strip(q('[') + ' || key || ' + q('] ') + ' || value')} AS text, 'metadata' AS technique, {q(REASONS['metadata'])} || ' (field: ' || key || ')' AS reason, CAST(NULL AS DOUBLE) AS x0, CAST(NULL AS DOUBLE) AS y0, CAST(NULL AS DOUBLE) AS x1, CAST(NULL AS DOUBLE) AS y1, CAST(NULL AS VARCHAR) AS classify_text FROM fields WHERE ({first_phrase('lower(value)', R.ADDRESSING + R.INSTRUCTION)}) IS NOT NULL OR length(value) > 200"),
    "style_flags": (("run_flags", "line_flags", "meta_flags"), "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY phase, page, block_no, line_no, kind, span_no) AS ord FROM (SELECT * FROM run_flags WHERE text <> '' UNION ALL SELECT * FROM line_flags UNION ALL SELECT * FROM meta_flags)"),
    "judged": (("spans",), f"SELECT *, {words('text')} AS words FROM spans WHERE length({normalize('text')}) >= 3"),
    "seen": (("judged", "ocr"), f"SELECT j.doc_id, j.page, j.block_no, j.line_no, j.span_no, {normalize('string_agg(o.text, ' + q('') + ' ORDER BY o.ord, o.text)')} AS seen FROM judged j JOIN ocr o ON j.doc_id = o.doc_id AND j.page = o.page AND least(j.x1, o.x1) > greatest(j.x0, o.x0) AND least(j.y1, o.y1) > greatest(j.y0, o.y0) AND least(j.y1, o.y1) - greatest(j.y0, o.y0) >= 0.5 * least(j.y1 - j.y0, o.y1 - o.y0) GROUP BY ALL"),
    "visible_exact": (("judged", "seen"), "SELECT j.*, coalesce(s.seen, '') AS seen, CASE WHEN len(words) = 0 THEN 1.0::DOUBLE WHEN coalesce(s.seen, '') = '' THEN 0.0::DOUBLE ELSE coalesce(list_sum(list_transform(list_filter(words, lambda w: strpos(s.seen, w) > 0), lambda w: length(w))), 0)::DOUBLE / list_sum(list_transform(words, lambda w: length(w))) END AS visible FROM judged j LEFT JOIN seen s USING (doc_id, page, block_no, line_no, span_no)"),
    "seen_spans": (("judged", "seen"), "SELECT j.*, coalesce(s.seen, '') AS seen FROM judged j LEFT JOIN seen s USING (doc_id, page, block_no, line_no, span_no)"),
    "missing": (("seen_spans",), "SELECT DISTINCT w, seen, CASE WHEN length(w) <= length(seen) THEN w ELSE seen END AS short, CASE WHEN length(w) <= length(seen) THEN seen ELSE w END AS long FROM (SELECT seen, unnest(words) AS w FROM seen_spans WHERE seen <> '') WHERE strpos(seen, w) = 0 AND length(w) >= 4"),
    "masked": (("missing",), "SELECT w, seen, length(short) AS m, length(long) AS n, list_transform(string_split(long, ''), lambda c: list_reduce([0::HUGEINT] || list_transform(range(length(short)), lambda i: CASE WHEN substr(short, i::INT + 1, 1) = c THEN 1::HUGEINT << i::INT ELSE 0::HUGEINT END), lambda x, y: x + y)) AS masks FROM missing"),
    "windows": (("masked",), "SELECT w, seen, m, masks[greatest(1, e - m + 1):least(e, n)] AS part FROM (SELECT *, unnest(range(1, n + m)) AS e FROM masked)"),
    "near": (("windows",), "SELECT w, seen FROM (SELECT w, seen, m, len(part) AS k, m - bit_count(list_reduce([(1::HUGEINT << m::INT) - 1] || part, lambda s, x: ((s + (s & x)) | (s - (s & x))) & ((1::HUGEINT << m::INT) - 1))) AS lcs FROM windows) GROUP BY w, seen HAVING max(CASE WHEN 200 * lcs >= 75 * (m + k) THEN 1 ELSE 0 END) = 1"),
    "near_letters": (("seen_spans", "near"), "SELECT doc_id, page, block_no, line_no, span_no, sum(length(w)) AS letters FROM (SELECT doc_id, page, block_no, line_no, span_no, seen, unnest(words) AS w FROM seen_spans) JOIN near USING (w, seen) GROUP BY ALL"),
    "visible": (("seen_spans", "near_letters"), "SELECT j.*, CASE WHEN len(words) = 0 THEN 1.0::DOUBLE WHEN seen = '' THEN 0.0::DOUBLE ELSE (coalesce(list_sum(list_transform(list_filter(words, lambda w: strpos(seen, w) > 0), lambda w: length(w))), 0) + coalesce(n.letters, 0))::DOUBLE / list_sum(list_transform(words, lambda w: length(w))) END AS visible FROM seen_spans j LEFT JOIN near_letters n USING (doc_id, page, block_no, line_no, span_no)"),
    "failing": (("judged",), "SELECT doc_id, min(page) AS failed FROM judged WHERE (doc_id * 13 + page * 7) % 11 = 0 GROUP BY doc_id"),
    "hidden_steps": (("visible",), "SELECT *, visible < 0.5 AS hidden, lag(visible < 0.5) OVER (PARTITION BY doc_id, page, block_no ORDER BY line_no, span_no) AS before FROM visible"),
    "hidden": (("hidden_steps",), "SELECT * FROM (SELECT *, sum(CASE WHEN before IS NOT DISTINCT FROM hidden THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, block_no ORDER BY line_no, span_no) AS run FROM hidden_steps) WHERE hidden"),
    "matched": (("hidden", "style_flags"), f"SELECT h.doc_id, h.page, h.block_no, h.line_no, h.span_no, min(f.ord) AS ord FROM hidden h JOIN style_flags f ON h.doc_id = f.doc_id AND h.page = f.page AND f.x0 IS NOT NULL AND {overlap('h.', 'f.')} > 0.5 GROUP BY ALL"),
    "fresh": (("hidden", "matched"), "SELECT * FROM hidden ANTI JOIN matched USING (doc_id, page, block_no, line_no, span_no)"),
    "visual_flags": (("fresh",), f"SELECT doc_id, 2 AS phase, page, block_no, min(line_no) AS line_no, 1 AS kind, arg_min(span_no, line_no * 1000 + span_no) AS span_no, {strip('string_agg(' + strip('text') + ', ' + q(' ') + ' ORDER BY line_no, span_no)')} AS text, 'visually_hidden' AS technique, {q(REASONS['visually_hidden'])} || ' (OCR found ' || CAST(round_even(max(visible) * 100, 0) AS INTEGER) || '% of it on the rendered page)' AS reason, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(NULL AS VARCHAR) AS classify_text FROM fresh GROUP BY doc_id, page, block_no, run"),
    "all_flags": (("style_flags", "matched", "visual_flags"), "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY phase, page, block_no, line_no, kind, span_no) AS ord FROM (SELECT s.* EXCLUDE (ord), CASE WHEN m.ord IS NULL THEN ['style'] ELSE ['style', 'visual'] END AS detected_by FROM style_flags s LEFT JOIN (SELECT DISTINCT doc_id, ord FROM matched) m USING (doc_id, ord) UNION ALL SELECT *, ['visual'] AS detected_by FROM visual_flags)"),
    "ruled": (("all_flags",), f"SELECT *, {LABEL} AS base_label, {WHY} AS base_why, {decoded('text')} AS hidden_text, {invisible_count('text')} AS n_invisible FROM all_flags"),
    "flags": (("ruled",), "SELECT *, CASE WHEN base_label <> 'manipulation' AND (trim(hidden_text) <> '' OR n_invisible > 5) THEN 'manipulation' ELSE base_label END AS rule_label, reason || ' ' || CASE WHEN base_label = 'manipulation' THEN base_why WHEN trim(hidden_text) <> '' THEN 'Invisible tag characters encode hidden text (\"' || substr(hidden_text, 1, 80) || '\").' WHEN n_invisible > 5 THEN n_invisible || ' invisible characters in one snippet (more than 5).' ELSE base_why END AS full_reason, substr(sha256(concat_ws('|', CAST(doc_id AS VARCHAR), CAST(ord AS VARCHAR), technique, text)), 1, 8) AS flag_id FROM ruled"),
    "opinions": ((), "SELECT doc_id, CASE WHEN max(toxic) = 1 THEN 'manipulation' WHEN min(quality) = 0 THEN 'suspicious' ELSE 'benign' END AS label FROM labels GROUP BY doc_id"),
    "reviewed": (("flags", "opinions"), f"SELECT f.*, CASE WHEN rule_label = 'manipulation' THEN NULL ELSE label END AS llm_label, CASE WHEN rule_label = 'manipulation' THEN 'skipped' WHEN label IS NOT NULL THEN 'ok' WHEN doc_id % 2 = 0 THEN 'invalid' ELSE 'unavailable' END AS llm_status, {more_severe('rule_label', 'CASE WHEN rule_label = ' + q('manipulation') + ' THEN NULL ELSE label END')} AS final_label FROM flags f LEFT JOIN opinions USING (doc_id)"),
    "counts": (("flags",), "SELECT doc_id, coalesce(num_flags, 0) AS num_flags, coalesce(style_only, 0) AS style_only, coalesce(visual_only, 0) AS visual_only, coalesce(b, 0) AS \"both\", CASE doc_id % 3 WHEN 0 THEN 'attack' WHEN 1 THEN 'benign' ELSE 'clean' END AS kind FROM documents LEFT JOIN (SELECT doc_id, count(*) AS num_flags, count(*) FILTER (detected_by = ['style']) AS style_only, count(*) FILTER (detected_by = ['visual']) AS visual_only, count(*) FILTER (len(detected_by) = 2) AS b FROM flags GROUP BY doc_id) USING (doc_id)"),
    "caught": (("counts",), "SELECT *, CASE WHEN kind <> 'attack' AND style_only + visual_only + \"both\" = 0 THEN '-' WHEN style_only + \"both\" > 0 AND visual_only + \"both\" > 0 THEN 'both' WHEN style_only + \"both\" > 0 THEN 'style' WHEN visual_only + \"both\" > 0 THEN 'visual' ELSE 'none' END AS caught_by FROM counts"),
}
NAMES = {"technique": TECHNIQUE_NAMES, "risk": RISK_NAMES}


def query(select: str, *views: str) -> str:
    """select over the views it names, with all that those read."""
    order: list[str] = []

    def need(name: str) -> None:
        if name not in order:
            for other in VIEWS[name][0]:
                need(other)
            order.append(name)

    for v in views:
        need(v)
    head = ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v][1]})" for v in order)
    for start in ("WITH RECURSIVE ", "WITH "):
        if select.startswith(start) and order:
            return f"{start}{head},\n{select.removeprefix(start)}"
    return f"WITH {head}\n{select}" if order else select
