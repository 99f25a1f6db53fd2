"""Token ids in Arrow IPC files: record batches of fixed-size lists, read back by random access.

Documents are range-partitioned and sorted by doc_id (ties by the hash of the text), so that file k holds the documents
before those of file k+1. A file is a run of sequences of LENGTH ids with a mask of the same shape that is false only on
the padding of its last sequence; ROWS sequences make a record batch. The footer of the file format and the fixed
sizes give any sequence by arithmetic, and its ids and mask are views of the file's buffers. An index file beside it
holds doc_id, start in the file and n_tokens of each document. Ids take two bytes where the vocabulary allows it.

Every task writes under a name of its own and moves the finished file to its place, so a repeated task leaves one file.
The driver sees one row (documents, ids) per file, from which the place of each file's first id follows.

Encoding is per run of characters between spaces and line feeds, as no token and no normalisation of the tokenizers this
is used with reaches over them, and runs already seen are looked up; a full stop or comma after a letter is a token apart.
A worker process keeps at most MEMORY runs, from task to task. Texts of one-byte characters are lower-cased first where the
tokenizer does so itself.

Cases: a null text is empty and has the end id alone; null doc_ids come first; repeated rows are each written; an empty
table writes no file and gives an empty table; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

LENGTH = 2048
ROWS = 64
END_ID = 2
MEMORY = 1_250_000
#: Characters that are cut into runs at once.
SPAN = 1 << 20
INDEX_ROWS = 1 << 15


class Encoder:
    """Texts to ids, as bytes of little-endian unsigned integers."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.code, self.dtype = ("I", np.dtype("<u4")) if wide else ("H", np.dtype("<u2"))
        self.lowers = self._ids("Ab É") == self._ids("ab é")
        self.parts = self._ids("ab,") == self._ids("ab") + self._ids(",") and self._ids("ab.") == self._ids("ab") + self._ids(".")
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, run: str) -> list[int]:
        return self.tokenizer.encode(run, add_special_tokens=False).ids

    def encode(self, texts: Iterable[str | None]) -> Iterator[tuple[int, bytes]]:
        """(number of the text, ids) in order, a long text in several pieces; about SPAN characters are in work at once."""
        held, size = [], 0
        for i, text in enumerate(texts):
            text, at = self.lowered(text or ""), 0
            while True:
                cut = text.find(" ", at + SPAN)
                cut = len(text) if cut < 0 else cut
                held.append((i, text[at:cut].replace("\n", " ").split(" ")))
                size, at = size + cut - at, cut
                if size >= SPAN:
                    yield from self._looked_up(held)
                    held, size = [], 0
                if at >= len(text):
                    break
        yield from self._looked_up(held)

    def lowered(self, text: str) -> str:
        """What the tokenizer lower-cases anyway, where that can't change how a mark or an accent is read."""
        if not self.lowers or any(m in text for m in self.marks):
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(m in low for m in self.marks) else low

    def _looked_up(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, bytes]]:
        known = self.known
        fresh = set().union(*(runs for _, runs in held)).difference(known)
        if len(known) + len(fresh) > MEMORY:
            known.clear()
            known[""] = b""
            fresh = set().union(*(runs for _, runs in held))
        self._learn(fresh)
        for i, runs in held:
            yield i, b"".join(map(known.__getitem__, runs))

    def _learn(self, fresh: set[str]) -> None:
        known = self.known
        apart = [r for r in fresh if self.parts and len(r) > 1 and r[-1] in ".," and r[-2].isalpha() and r.isascii()]
        whole = list(dict.fromkeys(x for x in [*(r[:-1] for r in apart), *(r[-1] for r in apart), *fresh.difference(apart)] if x not in known))
        for run, found in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False), strict=True):
            known[run] = array(self.code, found.ids).tobytes()
        for r in apart:
            known[r] = known[r[:-1]] + known[r[-1]]


class SequenceWriter:
    """A stream of ids as batches of fixed-size lists."""

    def __init__(self, sink, dtype: np.dtype, length: int, rows: int):
        self.length, self.rows, self.dtype, self.held, self.written = length, rows, dtype, bytearray(), 0
        self.schema = pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))], metadata={"rows": str(rows)})
        self.out = pa.ipc.new_file(sink, self.schema)

    def put(self, ids: bytes) -> None:
        self.held += ids
        self.written += len(ids) // self.dtype.itemsize
        size = self.length * self.rows * self.dtype.itemsize
        at = 0
        while len(self.held) - at >= size:
            self._batch(bytes(self.held[at : at + size]), self.length * self.rows)
            at += size
        del self.held[:at]

    def _batch(self, data: bytes, real: int) -> None:
        flat = np.frombuffer(data, self.dtype)
        mask = np.arange(len(flat)) < real
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (flat, mask)]
        self.out.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if real := len(self.held) // self.dtype.itemsize:
            self._batch(bytes(self.held) + bytes(-real % self.length * self.dtype.itemsize), real)
        self.out.close()


class Sequences:
    """Random access to the sequences, masks and runs of ids of one file."""

    def __init__(self, source):
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = int(self.reader.schema.metadata[b"rows"])
        self.at, self.held = -1, None

    def batch(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        if k != self.at:
            b = self.reader.get_batch(k)
            self.at, self.held = k, (b.column("ids").flatten().to_numpy(), b.column("mask").flatten())
        return self.held

    def sequence(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """The ids and mask of sequence i; both are views of the file, the mask an Arrow array of a bit each."""
        ids, mask = self.batch(i // self.rows)
        own = slice(i % self.rows * self.length, (i % self.rows + 1) * self.length)
        return ids[own], mask.slice(own.start, self.length)

    def run(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The n ids from start on, in one piece per record batch."""
        while n:
            k, at = divmod(start, self.rows * self.length)
            ids, mask = self.batch(k)
            part = ids[at : at + n]
            if not len(part) or mask.slice(at, n).false_count:
                raise ValueError("the run reaches into padding")
            yield part
            start, n = start + len(part), n - len(part)


def file_system(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def in_place(files: fs.FileSystem, path: str, write: Callable) -> None:
    """write(sink) to a name of its own, which then takes the place of path."""
    own = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(own) as sink:
        write(sink)
    if not isinstance(files, fs.LocalFileSystem) and files.get_file_info(path).type != fs.FileType.NotFound:
        files.delete_file(path)
    files.move(own, path)


def shard_writer(folder: str, tokenizer: str, end_id: int, length: int, rows: int, id_type: pa.DataType):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        index = pa.schema([("doc_id", id_type), ("start", pa.int64()), ("n_tokens", pa.int64())])
        files, path = file_system(folder)
        files.create_dir(path, recursive=True)
        encoder = common.per_process(f"encoder {tokenizer}", lambda: Encoder(tokenizer))
        end = np.array([end_id], encoder.dtype).tobytes()
        done = [0, 0]

        def ids(sink) -> None:
            out = SequenceWriter(sink, encoder.dtype, length, rows)

            def index_rows(index_sink) -> None:
                with pa.ipc.new_file(index_sink, index) as index_out:
                    for batch in batches:
                        starts = []
                        for i, piece in encoder.encode(x.as_py() for x in batch.column("text")):
                            if i == len(starts):
                                if starts:
                                    out.put(end)
                                starts.append(out.written)
                            out.put(piece)
                        if starts:
                            out.put(end)
                        sizes = np.diff([*starts, out.written])
                        index_out.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id").cast(id_type), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], schema=index))
                        done[0] += batch.num_rows

            in_place(files, f"{path}/index-{shard:08d}.arrow", index_rows)
            out.close()
            done[1] = out.written

        first = next(batches, None)
        if first is None:
            return
        batches = chained(first, batches)
        in_place(files, f"{path}/ids-{shard:08d}.arrow", ids)
        yield pa.RecordBatch.from_pydict({"shard": [shard], "n_docs": [done[0]], "n_ids": [done[1]]})

    return write


def chained(first, rest) -> Iterator:
    yield first
    yield from rest


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, rows: int = ROWS) -> list[tuple[int, int]]:
    """Write the ids of docs in ascending doc_id order; (file number, place of its first id) of each file."""
    ordered = docs.select("doc_id", "text").withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    id_type = pa.int64() if isinstance(docs.schema["doc_id"].dataType, T.IntegralType) else pa.string()
    kind = "shard long, n_docs long, n_ids long"
    shards = ordered.mapInArrow(shard_writer(folder, tokenizer, end_id, length, rows, id_type), kind)
    out, at = [], 0
    for r in sorted(shards.collect()):  # a row per file
        out.append((r["shard"], at))
        at += r["n_ids"]
    return out


def opened(files: fs.FileSystem, path: str):
    return pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)


def shard_reader(folder: str, starts: list[tuple[int, int]]):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = file_system(folder)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                shard, base = starts[k]
                with opened(files, f"{path}/ids-{shard:08d}.arrow") as source, opened(files, f"{path}/index-{shard:08d}.arrow") as index_source:
                    sequences, index = Sequences(source), pa.ipc.open_file(index_source)
                    for i in range(index.num_record_batches):
                        b = index.get_batch(i)
                        for at in range(0, b.num_rows, INDEX_ROWS):
                            part = b.slice(at, INDEX_ROWS)
                            crcs = []
                            for start, n in zip(part.column("start").to_pylist(), part.column("n_tokens").to_pylist(), strict=True):
                                crc = 0
                                for ids in sequences.run(start, n):
                                    crc = zlib.crc32(ids.astype("<u4").tobytes(), crc)
                                crcs.append(crc)
                            first = np.asarray(part.column("start")) + base
                            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(first), part.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_tokens(spark: SparkSession, folder: str, starts: list[tuple[int, int]], id_type: T.DataType) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files; a file is a task."""
    own = "long" if isinstance(id_type, T.IntegralType) else "string"
    files = spark.range(0, len(starts), 1, max(1, len(starts)))
    found = files.mapInArrow(shard_reader(folder, starts), f"doc_id {own}, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.col("doc_id").cast(id_type))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.table(spark, sf_dir, "documents")
    folder = common.new_path(spark, "tokens")
    starts = write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return read_tokens(spark, folder, starts, docs.schema["doc_id"].dataType)
