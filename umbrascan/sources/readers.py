"""Sources: the table contract as Parquet, binary documents with their guard, an optional PDF decoder, and settings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPAN_SCHEMA = (
    "doc_id STRING, page INT, block_no INT, line_no INT, span_no INT, text STRING, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, "
    "size DOUBLE, color INT, alpha INT, bg STRUCT<r: INT, g: INT, b: INT>, page_w DOUBLE, page_h DOUBLE"
)
NESTED = "array<struct<type: int, lines: array<struct<spans: array<struct<text: string, bbox: array<double>, color: int, size: double, alpha: int>>>>>>"
PDF_MAGIC = "25504446"


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, filename and content of the PDF files in a folder; an empty folder is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    if files.isEmpty():
        raise FileNotFoundError(f"no PDF files in {path}")
    return files.select(F.sha2("content", 256).alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")


def guarded(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that start as PDF, the others with an error)."""
    magic = F.hex(F.substring("content", 1, 4)) == PDF_MAGIC
    return documents.filter(magic), documents.filter(~F.coalesce(magic, F.lit(False))).withColumn("error", F.lit("File is not a PDF"))


def flattened(layers: DataFrame) -> DataFrame:
    """The span table of nested text layers: doc_id, page, page_w, page_h, blocks. Only blocks of type 0 hold text."""
    blocks = layers.select("doc_id", "page", "page_w", "page_h", F.posexplode("blocks").alias("block_no", "block")).filter("block.type = 0")
    lines = blocks.select("doc_id", "page", "page_w", "page_h", "block_no", F.posexplode("block.lines").alias("line_no", "line"))
    spans = lines.select("doc_id", "page", "page_w", "page_h", "block_no", "line_no", F.posexplode("line.spans").alias("span_no", "s"))
    box = [F.col("s.bbox")[i].alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return spans.select("doc_id", "page", "block_no", "line_no", "span_no", "s.text", *box, "s.size", "s.color", F.coalesce("s.alpha", F.lit(255)).alias("alpha"), "page_w", "page_h")


def decode_documents(documents: DataFrame, decoder: Callable[[bytes], Iterator[tuple]], error_rows: bool = True) -> DataFrame:
    """Span rows by a decoder plug-in; a document that cannot be decoded gives one row with its error and no text.

    decoder(content) gives tuples of SPAN_SCHEMA's columns after doc_id. It runs inside the tasks, a document at a time.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows = [(doc_id, *row, None) for row in decoder(bytes(content))]
                except Exception as e:
                    rows = [(doc_id, *[None] * 15, f"{type(e).__name__}: {e}")] if error_rows else []
                yield pd.DataFrame(rows, columns=[*(c.split()[0] for c in SPAN_SCHEMA.replace("STRUCT<r: INT, g: INT, b: INT>", "STRUCT").split(", ")), "error"])

    return documents.select("doc_id", "content").mapInPandas(run, SPAN_SCHEMA + ", error STRING")


def pdf_decoder() -> Callable[[bytes], Iterator[tuple]]:
    """The decoder of the optional PDF library; a clear error where it is missing."""
    try:
        import pymupdf  # noqa: F401
    except ImportError as e:
        raise RuntimeError("reading PDF files needs the optional library pymupdf; tables in the span contract need nothing") from e
    return read_pdf


def background(pixel: Callable[[int, int], tuple[int, int, int]], box: tuple[float, float, float, float], width: int, height: int, across: int = 20, down: int = 5) -> tuple[int, int, int] | None:
    """The upper median by brightness of a coarse grid of pixels in a box; None if no pixel of the picture is in it."""
    left, top = max(int(box[0]), 0), max(int(box[1]), 0)
    right, bottom = min(int(box[2]) + 1, width), min(int(box[3]) + 1, height)
    grid = [pixel(x, y) for y in range(top, bottom, max(1, (bottom - top) // down)) for x in range(left, right, max(1, (right - left) // across))]
    return sorted(grid, key=sum)[len(grid) // 2] if grid else None


def read_pdf(content: bytes) -> Iterator[tuple]:
    """The spans alone of what the document source reads from a PDF file."""
    from .documents import pdf_rows

    return (row[1:] for row in pdf_rows(content) if row[0] == "span")


ITEMS = "array<struct<polygon: array<array<double>>, text: string, score: double>>"


def read_pages(pages: DataFrame, make_reader: Callable[[], Callable[[bytes], list[tuple]]]) -> DataFrame:
    """doc_id, page, items and error of rendered pages (doc_id, page, image): the raw reads of an OCR plug-in.

    make_reader() is called once per task, since engines are slow to load; a page it fails on has no items and an error.
    """
    key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select("doc_id", "page").schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = None
        for batch in batches:
            rows = []
            for doc_id, page, image in zip(batch["doc_id"], batch["page"], batch["image"], strict=True):
                try:
                    reader = reader or make_reader()
                    items = [{"polygon": p, "text": t, "score": float(s)} for p, t, s in reader(bytes(image)) or ()]
                    rows.append((doc_id, page, items, None))
                except Exception as e:
                    rows.append((doc_id, page, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "items", "error"])

    return pages.select("doc_id", "page", "image").mapInPandas(run, f"{key}, items {ITEMS}, error string")


def render_pages(pages: DataFrame, make_renderer: Callable[[], Callable[[bytes, int, float], bytes]], zoom: float = 2.0) -> DataFrame:
    """doc_id, page, image and error of pages (doc_id, page, content): pictures by a renderer plug-in, which takes a document's bytes, a page and a zoom.

    make_renderer() is called once per task; a page it fails on has no image and an error. Pages of a document side by side (sorted by doc_id) let a renderer keep it open.
    """
    key = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select("doc_id", "page").schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        renderer = None
        for batch in batches:
            rows = []
            for doc_id, page, content in zip(batch["doc_id"], batch["page"], batch["content"], strict=True):
                try:
                    renderer = renderer or make_renderer()
                    rows.append((doc_id, page, bytes(renderer(bytes(content), int(page), zoom)), None))
                except Exception as e:
                    rows.append((doc_id, page, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "image", "error"])

    return pages.select("doc_id", "page", "content").mapInPandas(run, f"{key}, image binary, error string")


def flag(settings: Mapping[str, str], name: str, default: bool) -> bool:
    """A setting's truth: unset or blank is the default, four words are false."""
    value = (settings.get(name) or "").strip().lower()
    return default if not value else value not in ("0", "false", "no", "off")


def health(spark: SparkSession, settings: Mapping[str, str]) -> DataFrame:
    """One row: what this set-up can do."""
    from ..operators.review import review_status

    ai = review_status(dict(settings))
    return spark.createDataFrame([("ok", ai["enabled"], ai["provider"], ai["reason"], flag(settings, "ENABLE_VISUAL_DIFF", True))], "status STRING, ai_enabled BOOLEAN, ai_provider STRING, ai_reason STRING, visual_diff BOOLEAN")
