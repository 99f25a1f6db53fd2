"""A folder of documents as a Spark data source: one read gives spans, metadata, trace boxes, page sizes and what could not be read.

    documents.register(spark, decoder)                       # decoder(content) gives tagged rows, see below
    tables = documents.read(spark, "/in/pdfs")               # .spans .metadata .traces .pages .errors
    spark.readStream.format("hidden_text_documents").load("/in/pdfs")

Files are numbered by path (`file_no`), so whatever sorts by it has the order of a sorted folder listing, and a partition is a run of neighbouring
files of about PART bytes. A file is decoded in one task, once for a scan of the source; with the option `kinds` a scan builds rows of these kinds only. (It is no pushed
filter, as Spark keeps a Python reader with the filters of the first plan that used it.) A decoder is a plug-in, a function from a file's bytes to tuples ("span", page, ...), ("trace", page, ...), ("page", page, width, height) and ("metadata", map) with the
fields of SPAN, TRACE and PAGE. A file without the magic bytes, or on which the decoder fails at any place, gives one row of kind "error" and no others.

doc_id is the SHA-256 of the path below the folder: equal files in two places are two documents. Empty files are errors; a folder without files is an error of the read, but an
empty stream. A stream takes files by (time of change, path); a file that is put in with an older time than the last one taken is not seen.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .readers import SPAN_SCHEMA, background

NAME = "hidden_text_documents"
#: Bytes of files in a partition, and rows in a batch.
PART, BATCH = 64 << 20, 4096
MAGIC = b"%PDF"
SPAN = "block_no int, line_no int, span_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, color int, alpha int, bg struct<r: int, g: int, b: int>, page_w double, page_h double"
TRACE = "x0 double, y0 double, x1 double, y1 double, type int, opacity double"
PAGE = "width double, height double"
SCHEMA = f"doc_id string, file_no long, filename string, kind string, page int, span struct<{SPAN}>, trace struct<{TRACE}>, size struct<{PAGE}>, metadata map<string, string>, error string"
KINDS = ("span", "trace", "page", "metadata", "error")


def names(schema: str) -> list[str]:
    """The field names of one of the flat schemas above."""
    flat = schema.replace("struct<r: int, g: int, b: int>", "struct")
    return [f.split()[0] for f in flat.split(", ")]


FIELDS = {"span": ("span", names(SPAN)), "trace": ("trace", names(TRACE)), "page": ("size", names(PAGE))}


@dataclass
class Files(InputPartition):
    """Neighbouring files: (number, path, path below the folder)."""

    files: list[tuple[int, str, str]]

    def __init__(self, files: list[tuple[int, str, str]]):
        super().__init__(files[0][0])
        self.files = files


def listed(folder: str, suffix: str) -> list[fs.FileInfo]:
    """The files of a folder and those below it, by path."""
    store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(folder))
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(suffix)), key=lambda f: f.path)


def parts(files: Iterable[tuple[int, fs.FileInfo]], folder: str, most: int = PART) -> list[Files]:
    """Runs of files of about `most` bytes."""
    root = folder.split("://", 1)[-1].rstrip("/") if "://" in folder else os.path.abspath(folder.removeprefix("file:"))
    out, held, size = [], [], 0
    for number, f in files:
        below = f.path[len(root) :].lstrip("/") if f.path.startswith(root) else f.path
        held.append((number, f.path, below))
        size += f.size or 0
        if size >= most:
            out.append(Files(held))
            held, size = [], 0
    return [*out, Files(held)] if held else out


def decoded(content: bytes, decoder: Callable[[bytes], Iterable[tuple]], kinds: frozenset[str]) -> Iterator[dict]:
    """Rows of a document, all of them or the error alone."""
    try:
        if content[: len(MAGIC)] != MAGIC:
            raise ValueError("File is not a PDF")
        rows = []
        for kind, *values in decoder(content):
            if kind == "metadata":
                rows.append({"kind": kind, "metadata": list(values[0].items())})
            else:
                field, own = FIELDS[kind]
                page, *rest = values
                rows.append({"kind": kind, "page": page, field: dict(zip(own, rest, strict=True))})
    except Exception as e:  # a bad file must not end the scan
        rows = [{"kind": "error", "error": str(e) if isinstance(e, ValueError) and str(e) == "File is not a PDF" else f"{type(e).__name__}: {e}"}]
    return (r for r in rows if r["kind"] in kinds)


class _Reading:
    """What batch and stream readers share: the rows of a partition as Arrow batches."""

    def __init__(self, options: dict[str, str], decoder: Callable[[bytes], Iterable[tuple]], schema: pa.Schema):
        self.folder, self.suffix = options["path"], options.get("suffix", ".pdf")
        self.most = int(options.get("partBytes", PART))
        self.decoder, self.arrow = decoder, schema
        self.kinds = frozenset(options.get("kinds", ",".join(KINDS)).split(","))
        if unknown := self.kinds.difference(KINDS):
            raise ValueError(f"unknown kinds {sorted(unknown)}")

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
        held: list[dict] = []
        for number, path, below in partition.files:
            with store.open_input_stream(path) as file:
                content = file.read()
            own = {"doc_id": hashlib.sha256(below.encode()).hexdigest(), "file_no": number, "filename": below.rsplit("/", 1)[-1]}
            for row in decoded(content, self.decoder, self.kinds):
                held.append(own | row)
                if len(held) == BATCH:
                    yield pa.RecordBatch.from_pylist(held, schema=self.arrow)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=self.arrow)


class DocumentReader(_Reading, DataSourceReader):
    def partitions(self) -> list[Files]:
        files = listed(self.folder, self.suffix)
        if not files:
            raise FileNotFoundError(f"no {self.suffix} files in {self.folder}")
        return parts(enumerate(files, 1), self.folder, self.most)


class DocumentStream(_Reading, DataSourceStreamReader):
    """Offsets are the time of change and the path of the last file taken."""

    @staticmethod
    def _place(f: fs.FileInfo) -> list:
        return [f.mtime_ns or 0, f.path]

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        time, path = max((self._place(f) for f in listed(self.folder, self.suffix)), default=[-1, ""])
        return {"time": time, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        after, until = [start["time"], start["path"]], [end["time"], end["path"]]
        return parts(((n, f) for n, f in enumerate(listed(self.folder, self.suffix), 1) if after < self._place(f) <= until), self.folder, self.most)


def pdf_rows(content: bytes) -> Iterator[tuple]:
    """Rows of a PDF file by the optional library pymupdf: spans, those off the page too, with the colour behind each one; boxes of traced text; metadata."""
    import pymupdf

    with pymupdf.open(stream=content, filetype="pdf") as doc:
        yield "metadata", {k: v or "" for k, v in (doc.metadata or {}).items()}
        for number, page in enumerate(doc, 1):
            width, height = page.rect.width, page.rect.height
            yield "page", number, width, height
            for t in page.get_texttrace():
                yield "trace", number, *map(float, t["bbox"]), int(t["type"]), float(t.get("opacity", 1.0))
            layer = page.get_text("dict", flags=pymupdf.TEXTFLAGS_DICT & ~pymupdf.TEXT_MEDIABOX_CLIP, clip=pymupdf.INFINITE_RECT())
            picture = page.get_pixmap(alpha=False)
            for b, block in enumerate(layer["blocks"]):
                for n, line in enumerate(block.get("lines", ())):
                    for s, span in enumerate(line["spans"]):
                        box = tuple(map(float, span["bbox"]))
                        behind = background(lambda x, y: tuple(picture.pixel(x, y)[:3]), box, picture.width, picture.height)
                        rgb = None if behind is None else dict(zip("rgb", behind, strict=True))
                        yield "span", number, b, n, s, span["text"], *box, float(span["size"]), span["color"], span.get("alpha", 255), rgb, width, height


def register(spark: SparkSession, decoder: Callable[[bytes], Iterable[tuple]] = pdf_rows) -> None:
    """Make format("hidden_text_documents") known to the session, with this decoder."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(spark.createDataFrame([], SCHEMA).schema)

    class HiddenTextDocuments(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DocumentReader:
            return DocumentReader(self.options, decoder, arrow)

        def streamReader(self, schema) -> DocumentStream:
            return DocumentStream(self.options, decoder, arrow)

    spark.dataSource.register(HiddenTextDocuments)


@dataclass
class Tables:
    """The tables of the contract. Each is a scan of its own, unless `rows` is given, such as all rows of one scan, persisted."""

    spark: SparkSession
    path: str
    options: dict[str, str] = field(default_factory=dict)
    rows: DataFrame | None = None

    def of(self, *kinds: str) -> DataFrame:
        """Rows of the source of these kinds."""
        if self.rows is not None:
            return self.rows.filter(F.col("kind").isin(*kinds))
        return self.spark.read.format(NAME).options(**self.options, kinds=",".join(kinds)).load(self.path)

    def kept(self) -> Tables:
        """The same out of one scan, persisted; release it by `rows.unpersist()`."""
        return Tables(self.spark, self.path, self.options, self.of(*KINDS).persist())

    @property
    def spans(self) -> DataFrame:
        order = [c.split()[0] for c in SPAN_SCHEMA.replace("STRUCT<r: INT, g: INT, b: INT>", "STRUCT").split(", ")]
        return self.of("span").select("doc_id", "page", "span.*").select(*order)

    @property
    def traces(self) -> DataFrame:
        return self.of("trace").select("doc_id", "page", "trace.*")

    @property
    def metadata(self) -> DataFrame:
        return self.of("metadata").select("doc_id", "metadata")

    @property
    def pages(self) -> DataFrame:
        return self.of("page").select("doc_id", "page", F.col("size.width").alias("page_w"), F.col("size.height").alias("page_h"))

    @property
    def errors(self) -> DataFrame:
        """The quarantine: documents that gave no rows, and why."""
        return self.of("error").select("doc_id", "file_no", "filename", "error")

    @property
    def documents(self) -> DataFrame:
        """doc_id, file_no and filename of every document that was read, those without text too; order by file_no for the order of paths."""
        return self.of("metadata").select("doc_id", "file_no", "filename")


def read(spark: SparkSession, path: str, **options: str) -> Tables:
    """The tables of a folder."""
    return Tables(spark, path, options)
