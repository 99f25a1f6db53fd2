"""scan_document, a table function for SQL: the flags of the style and Unicode detectors of each document of a span table.

    udtf.register(spark)
    SELECT * FROM scan_document(TABLE(spans) PARTITION BY doc_id)

It gives the rows of detect.label(detect.style_flags(...)) without metadata and traces, which a single table does not hold. A document is one
partition: its spans are sorted in memory and read once, in the order of reading. Tables of many documents are scanned faster by the DataFrame functions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal
from itertools import groupby

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as ST
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..operators.detect import LAST_LINE, PRIORITY, REASONS
from . import geometry as G
from . import rules as R
from . import text as T

NEEDED = ("doc_id", "page", "block_no", "line_no", "span_no", "text", "x0", "y0", "x1", "y1", "size", "color", "alpha", "bg", "page_w", "page_h")
FLAG = "ord long, page int, technique string, text string, reason string, x0 double, y0 double, x1 double, y1 double, rule_label string, flag_id string"
TAGS = range(T.TAG_BASE, T.TAG_BASE + 0x80)
TRANSPARENT = re.compile(rf"[{T.SPACE}]*[{T.IN_INVISIBLE}\U000E0000-\U0010FFFF]*[{T.SPACE}]*")


def rounded(x: float, places: str, mode: str = ROUND_HALF_EVEN) -> Decimal:
    """By the shortest decimal digits of x, as the built-in functions do."""
    return Decimal(repr(float(x))).quantize(Decimal(places), mode)


def box_text(box: tuple[float, ...]) -> str:
    return "(" + ", ".join(str(int(rounded(c, "1"))) for c in box) + ")"


def share(a: tuple[float, ...], b: tuple[float, ...]) -> float:
    """Which share of a lies in b."""
    area = lambda r: max(r[2] - r[0], 0.0) * max(r[3] - r[1], 0.0)
    return area((max(a[0], b[0]), max(a[1], b[1]), min(a[2], b[2]), min(a[3], b[3]))) / area(a) if area(a) > 0 else 0.0


def contrast(a: tuple[int, ...], b: tuple[int, ...]) -> float:
    linear = lambda c: c / 255 / 12.92 if c / 255 <= G.KNEE else ((c / 255 + 0.055) / 1.055) ** G.GAMMA
    low, high = sorted(sum(w * linear(c) for w, c in zip((0.2126, 0.7152, 0.0722), rgb, strict=True)) for rgb in (a, b))
    return (high + 0.05) / (low + 0.05)


def found_in(s: Row) -> tuple[list[str], str]:
    """The techniques of a span by priority, and the details."""
    box, page = (s["x0"], s["y0"], s["x1"], s["y1"]), (0.0, 0.0, s["page_w"], s["page_h"])
    off = share(box, page) < 0.5
    fg = tuple(s["color"] >> k & 255 for k in (16, 8, 0))
    shown = f"text color rgb({', '.join(map(str, fg))})"
    if s["bg"] is None:
        white, against = all(c > G.WHITE for c in fg), shown
    else:
        bg = tuple(s["bg"])
        ratio = contrast(fg, bg)
        white, against = ratio < G.LOW_CONTRAST, f"{shown} on background rgb({', '.join(map(str, bg))}), contrast {rounded(ratio, '0.01', ROUND_HALF_UP)}:1"
    white, tiny = white and not off, s["size"] < G.TINY
    details = [f"bbox {box_text(box)} vs page {box_text(page)}"] * off + [against] * white + [f"font size {rounded(s['size'], '0.1', ROUND_HALF_UP)}pt"] * tiny
    return [name for name, there in zip(PRIORITY, (s["alpha"] == 0, off, white, tiny), strict=True) if there], "; ".join(details)


def decoded(text: str) -> str:
    return "".join(chr(ord(c) - T.TAG_BASE) for c in text if 0x20 <= ord(c) - T.TAG_BASE < 0x7F)


def hiding(line: str) -> list[str]:
    """Names of the invisible characters of a line that are no layout artifacts."""
    def hides(i: int) -> bool:
        before, after = line[i - 1 : i], line[i + 1 : i + 2]
        beside = any(x and x in T.INVISIBLE for x in (before, after))
        return beside or bool(before and after and not before.isspace() and not after.isspace())

    names = sorted({T.INVISIBLE[c][0] for i, c in enumerate(line) if c in T.INVISIBLE and hides(i)})
    return names + [T.TAG_NAME] * any(ord(c) in TAGS for c in line)


def reason(technique: str, detail: str, also: list[str] = ()) -> str:
    return REASONS[technique] + (f" ({detail})" if detail else "") + (f" Also: {', '.join(also)}." if also else "")


def ruled(text: str, read: str, technique: str) -> tuple[str, str]:
    """(label, why) of a flag's text, by what is read in it."""
    lowered = read.lower()
    phrase = lambda patterns: next((m[0] for p in patterns if (m := re.search(p, lowered))), None) if any(n in lowered for n in R.NEEDLES[patterns]) else None
    if (p := phrase(R.ADDRESSING)) is not None:
        return "manipulation", f'Hidden text addresses the classifier/scanner itself (matched "{p}").'
    if (p := phrase(R.INSTRUCTION)) is not None:
        return "manipulation", f'Contains AI-directed instruction language (matched "{p}").'
    if (message := decoded(text)).strip(" "):
        return "manipulation", f'Invisible tag characters encode hidden text ("{message[: R.MAX_DECODED]}").'
    if (n := sum(c in T.INVISIBLE or ord(c) in TAGS for c in text)) > R.MAX_BENIGN_INVISIBLE:
        return "manipulation", f"{n} invisible characters in one snippet (more than {R.MAX_BENIGN_INVISIBLE})."
    words = len(re.findall("[a-zA-Z]{2,}", read))
    if any(h in lowered for h in R.HINTS) and words <= R.MAX_HINT_WORDS:
        return "benign", R.WHY_BENIGN_HINT
    if words <= R.MAX_SHORT_WORDS and technique != "invisible_unicode":
        return "benign", R.WHY_SHORT
    return "suspicious", R.WHY_SUSPICIOUS


def around(spans: list[Row]) -> tuple[float, ...]:
    box = min(s["x0"] for s in spans), min(s["y0"] for s in spans), max(s["x1"] for s in spans), max(s["y1"] for s in spans)
    return tuple(float(rounded(c, "0.1")) for c in box)


def block_flags(spans: list[Row]) -> Iterator[tuple[tuple, str, str, str, tuple[float, ...], str | None]]:
    """(place, technique, text, reason, box, what is read instead of the text) of the flags of a block. spans: in order."""
    page, block = spans[0]["page"], spans[0]["block_no"]
    for number, own in groupby(spans, key=lambda s: s["line_no"]):
        own = list(own)
        line = "".join(s["text"] for s in own)
        if names := hiding(line):
            tags = decoded(line)
            detail = f"found: {', '.join(names)}" + (f'; decoded hidden tag text: "{tags}"' if tags else "")
            yield (page, block, number, 0, 0), "invisible_unicode", (f"{line}\n[decoded tag text] {tags}" if tags else line).strip(), reason("invisible_unicode", detail), around(own), tags or None
    judged = [(s, *found_in(s)) for s in spans if not TRANSPARENT.fullmatch(s["text"])]
    at = 0
    for technique, run in groupby(judged, key=lambda j: j[1][0] if j[1] else None):
        run = list(run)
        at += len(run)
        if technique is None:
            continue
        text = run[0][0]["text"]
        for s, _, _ in run[1:]:
            text += ("" if text.endswith(" ") else " ") + s["text"]
        if text := text.strip():
            also = sorted({t for _, found, _ in run for t in found[1:]})
            details = "; ".join(dict.fromkeys(d for _, _, d in run if d))
            close = judged[at][0] if at < len(judged) else None
            place = (page, block, close["line_no"], 1, close["span_no"]) if close else (page, block, LAST_LINE, 1, 0)
            yield place, technique, text, reason(technique, details, also), around([s for s, _, _ in run]), None


class ScanDocument:
    """A partition is a document."""

    def __init__(self) -> None:
        self.spans: list[Row] = []

    @staticmethod
    def analyze(spans: AnalyzeArgument) -> AnalyzeResult:
        if not spans.isTable:
            raise ValueError("scan_document takes a table: scan_document(TABLE(spans) PARTITION BY doc_id)")
        names = [f.name for f in spans.dataType.fields]
        if missing := [c for c in NEEDED if c not in names]:
            raise ValueError(f"the table of spans has no columns {', '.join(missing)}")
        types = ST.StructType([spans.dataType["doc_id"]])
        for field in FLAG.split(", "):
            name, kind = field.split()
            types.add(name, {"long": ST.LongType(), "int": ST.IntegerType(), "string": ST.StringType(), "double": ST.DoubleType()}[kind])
        return AnalyzeResult(types)

    def eval(self, span: Row) -> None:
        if self.spans and self.spans[0]["doc_id"] != span["doc_id"]:
            raise ValueError("a partition holds several documents: use PARTITION BY doc_id")
        if span["text"] is not None:
            self.spans.append(span)

    def terminate(self) -> Iterator[tuple]:
        self.spans.sort(key=lambda s: (s["page"], s["block_no"], s["line_no"], s["span_no"]))
        flags = [f for _, own in groupby(self.spans, key=lambda s: (s["page"], s["block_no"])) for f in block_flags(list(own))]
        for number, (place, technique, text, why, box, read) in enumerate(sorted(flags, key=lambda f: f[0]), 1):
            doc_id = self.spans[0]["doc_id"]
            label, rule = ruled(text, read or text, technique)
            key = "|".join(str(x) for x in (doc_id, number, technique, text) if x is not None)
            yield doc_id, number, place[0], technique, text, f"{why} {rule}", *box, label, hashlib.sha256(key.encode()).hexdigest()[:8]


def register(spark: SparkSession) -> None:
    spark.udtf.register("scan_document", udtf(ScanDocument))
