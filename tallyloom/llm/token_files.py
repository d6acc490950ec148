"""Token ids of documents, written as Simple-8b files and read back.

A table of token ids is a folder: shards in ascending order of doc_id, and a manifest that
names them. The manifest is written last, by the driver, and names one file per partition,
so files of tasks that failed or ran twice are never read. A shard holds

* the words of all its ids in blocks of ``simple8b.BLOCK`` (a document may start anywhere),
* the escaped numbers,
* the words before each block, and doc_id and number of ids of each document,
* a trailer with the sizes of these parts.

A reader takes the trailer and the lists, then the words of about ``CHUNK`` ids at a time.
``start``, the number of ids of all documents before one, is the shard's first (manifest)
plus those of the documents before it in the shard.

Cases: a NULL text is an empty one; an empty text has the end id only; documents with a
NULL doc_id come first; documents with one doc_id come in the order of a hash of their
texts, equal ones side by side; an empty table is a folder without shards; other columns
are not read. A long text is encoded piece by piece, cut where a space stands between two
other characters: no token spans such a place.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from tokenizers import Tokenizer

from tallyloom.llm.simple8b import BLOCK, Packed, pack, unpack
from tallyloom.llm.tables import partitions, text_or_empty
from tallyloom.session import scratch_path

#: Ids that are coded or decoded at one time, a multiple of the block.
CHUNK = 1 << 20
#: Rows that are Python objects at one time.
ROWS = 256
#: Characters of a long text that are encoded at one time, and parts (of so many characters) a worker remembers.
WINDOW, REMEMBERED, LONGEST_REMEMBERED = 1 << 20, 1 << 20, 32

_MANIFEST = "manifest.json"
_MAGIC = b"TLS8IDS1"
_TRAILER = struct.Struct("<QQQQ8s")  # ids, words, escapes, documents
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Where a byte-level tokenizer cuts texts of ASCII and of the letters U+00C0 to U+024F.
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
_PLAIN = re.compile(r"[\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\u024f]*")
_PARTS = re.compile(
    rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^ \t-\r0-9{_LETTERS}]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
)

IDS_SCHEMA = "doc_id long, start long, ids binary"


# Encoding


class PieceEncoder(dict):
    """The tokenizer's ids of a text, through a bounded memory of its parts.

    A byte-level tokenizer cuts a text by a pattern before it merges. Where all characters
    are plain ones, the same cuts are made here and the library's model merges each part
    that is new. Other texts are cut at single spaces between two other characters, where a
    token starts whatever stands before or after; what is not plain then goes through the
    whole tokenizer. A tokenizer of another kind gets every text whole.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        cuts = parts["pre_tokenizer"] or {}
        self.byte_level = (
            parts["normalizer"] is None
            and cuts.get("type") == "ByteLevel"
            and cuts.get("use_regex", False)
            and not cuts.get("add_prefix_space", True)
            and parts["model"]["type"] == "BPE"
            and parts["model"].get("dropout") is None
        )
        self.model = self.tokenizer.model
        self.special = [token["content"] for token in parts["added_tokens"]]
        self.byte_level &= not any(re.search(r"\s", token) for token in self.special)
        self.bytes_as_text = {i: c for i, c in enumerate(_byte_letters())}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not self.byte_level:
            return self._whole(text)
        return b"".join(map(self._window, _windows(text)))

    def _window(self, text: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if self._is_plain(text):
            return b"".join(map(self.__getitem__, _PARTS.findall(text)))
        pieces = _SAFE_CUT.split(text)
        return b"".join(
            b"".join(map(self.__getitem__, _PARTS.findall(p))) if self._is_plain(p) else self._whole(p) for p in pieces
        )

    def _is_plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(token in text for token in self.special)

    def __missing__(self, part: str) -> bytes:
        letters = part.encode().decode("latin-1").translate(self.bytes_as_text)
        ids = np.array([token.id for token in self.model.tokenize(letters)], "<u4").tobytes()
        if len(part) <= LONGEST_REMEMBERED:
            self[part] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _byte_letters() -> list[str]:
    """The character by which byte-level vocabularies write each byte: itself where it is visible."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [i for i in range(256) if i not in visible]
    return [chr(i) if i in visible else chr(256 + hidden.index(i)) for i in range(256)]


def _windows(text: str) -> Iterator[str]:
    """The text in stretches of about ``WINDOW`` characters that end at safe cuts."""
    at = 0
    while len(text) - at > WINDOW:
        cut = _SAFE_CUT.search(text, at + WINDOW)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


@lru_cache(maxsize=1)
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def with_token_ids(docs: DataFrame, vocabulary: str, end_id: int | None = None) -> DataFrame:
    """(doc_id, ids) of documents (doc_id, text); ids are little-endian unsigned 32-bit numbers.

    ``vocabulary`` is the path of a byte-level tokenizer file on every machine; ``end_id``
    follows each document's ids. Rows keep their order and partitions.
    """
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                rows = batch.slice(at, ROWS)
                ids = [encoder.encode(text) + end for text in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return narrow.mapInArrow(encode, "doc_id long, ids binary")


# Files


@dataclass(frozen=True)
class Shard(WriterCommitMessage):
    """One file of the folder: its place in the order, its name and what it holds."""

    part: int
    file: str
    documents: int
    ids: int


@dataclass(frozen=True)
class ShardToRead(InputPartition):
    file: str
    first: int


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


class TokenFiles(DataSource):
    """``spark.read`` and ``df.write`` with ``format("token_files")``: rows (doc_id, ids).

    ``ids`` is a binary of little-endian unsigned 32-bit numbers. Rows are written in the
    order of the partitions and of the rows inside them; ``spark.read`` adds ``start``.
    """

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return IDS_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Shard:
        store, folder = _store(self.path)
        if not self.overwrite and store.get_file_info(f"{folder}/{_MANIFEST}").type != pafs.FileType.NotFound:
            raise FileExistsError(f"{self.path} holds token files already")
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        name = f"ids-{part:06d}-{uuid.uuid4().hex}.s8b"
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/{name}") as out:
            file = _ShardWriter(out)
            for batch in iterator:
                doc_ids, cells = batch.column("doc_id"), batch.column("ids")
                for at in range(0, batch.num_rows, ROWS):
                    file.add(doc_ids.slice(at, ROWS).to_pylist(), cells.slice(at, ROWS).to_pylist())
            file.finish()
        return Shard(part, name, len(file.doc_ids), file.ids)

    def commit(self, messages: list[Shard | None]) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        shards = sorted((m for m in messages if m is not None and m.documents), key=lambda m: m.part)
        text = json.dumps({"format": _MAGIC.decode(), "block": BLOCK, "shards": [asdict(s) for s in shards]})
        pending = f"{folder}/{_MANIFEST}-{uuid.uuid4().hex}"
        with store.open_output_stream(pending) as out:
            out.write(text.encode())
        store.move(pending, f"{folder}/{_MANIFEST}")

    def abort(self, messages: list[Shard | None]) -> None:
        store, folder = _store(self.path)
        for message in messages:
            if message is not None:
                store.delete_file(f"{folder}/{message.file}")


class _ShardWriter:
    """Codes ids as they come; holds ``CHUNK`` of them and two numbers per document."""

    def __init__(self, out):
        self.out = out
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.waiting: list[np.ndarray] = []
        self.held = self.ids = self.words = 0
        self.offsets = [np.zeros(1, np.uint64)]
        self.escapes: list[np.ndarray] = []
        self.n_escapes = 0

    def add(self, doc_ids: list[int | None], cells: list[bytes]) -> None:
        self.doc_ids += doc_ids
        for cell in cells:
            ids = np.frombuffer(cell, "<u4")
            self.lengths.append(len(ids))
            self.waiting.append(ids)
            self.held += len(ids)
            if self.held >= CHUNK:
                self._flush(self.held // BLOCK * BLOCK)

    def _flush(self, count: int) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, "<u4")
        for at in range(0, count, CHUNK):
            packed = pack(ids[at : min(at + CHUNK, count)], first_escape=self.n_escapes)
            self.out.write(packed.words.astype("<u8").tobytes())
            self.offsets.append(packed.offsets[1:] + np.uint64(self.words))
            self.escapes.append(packed.escapes)
            self.words += len(packed.words)
            self.n_escapes += len(packed.escapes)
        self.waiting, self.held = [ids[count:]], self.held - count
        self.ids += count

    def finish(self) -> None:
        self._flush(self.held)
        for part in (
            *self.escapes,
            *self.offsets,
            np.array([i or 0 for i in self.doc_ids], np.int64),
            np.array(self.lengths, np.uint64),
        ):
            self.out.write(part.astype(part.dtype.newbyteorder("<")).tobytes())
        self.out.write(np.array([i is None for i in self.doc_ids], np.uint8).tobytes())
        self.out.write(_TRAILER.pack(self.ids, self.words, self.n_escapes, len(self.doc_ids), _MAGIC))


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[ShardToRead]:
        store, folder = _store(self.path)
        with store.open_input_stream(f"{folder}/{_MANIFEST}") as manifest:
            found = json.loads(manifest.read())
        if (found["format"], found["block"]) != (_MAGIC.decode(), BLOCK):
            raise ValueError(f"{self.path}: unknown format {found['format']} in blocks of {found['block']}")
        out, first = [], 0
        for shard in found["shards"]:
            out.append(ShardToRead(shard["file"], first))
            first += shard["ids"]
        return out or [ShardToRead("", 0)]

    def read(self, partition: ShardToRead) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/{partition.file}") as file:
            yield from _read_shard(file, partition.first)


def _read_shard(file: pa.NativeFile, first: int) -> Iterator[pa.RecordBatch]:
    size = file.size()
    n_ids, n_words, n_escapes, n_docs, magic = _TRAILER.unpack(file.read_at(_TRAILER.size, size - _TRAILER.size))
    if magic != _MAGIC:
        raise ValueError("not a complete shard of token ids")
    blocks = -(-n_ids // BLOCK)
    at = 8 * n_words

    def part(count: int, kind: str) -> np.ndarray:
        nonlocal at
        found = np.frombuffer(file.read_at(count * np.dtype(kind).itemsize, at), kind)
        at += count * np.dtype(kind).itemsize
        return found

    escapes, offsets = part(n_escapes, "<u8"), part(blocks + 1, "<u8")
    doc_ids, lengths, missing = part(n_docs, "<i8"), part(n_docs, "<u8").astype(np.int64), part(n_docs, "u1")
    starts = np.cumsum(lengths) - lengths
    low = 0
    while low < n_docs:
        # Documents of about CHUNK ids together, or one with more.
        high = max(low + 1, int(np.searchsorted(starts, starts[low] + CHUNK, side="left")))
        begin, end = int(starts[low]), int(starts[high - 1] + lengths[high - 1])
        b0, b1 = begin // BLOCK, -(-end // BLOCK)
        words = np.frombuffer(file.read_at(8 * int(offsets[b1] - offsets[b0]), 8 * int(offsets[b0])), "<u8")
        ids = unpack(Packed(words, offsets[b0 : b1 + 1], escapes), min(b1 * BLOCK, n_ids) - b0 * BLOCK)
        data = ids[begin - b0 * BLOCK : end - b0 * BLOCK].astype("<u4")
        bounds = (4 * np.append(starts[low:high] - begin, end - begin)).astype(np.int32)
        cells = pa.Array.from_buffers(pa.binary(), high - low, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(doc_ids[low:high], pa.int64(), mask=missing[low:high].astype(bool)),
                pa.array(first + starts[low:high], pa.int64()),
                cells,
            ],
            names=["doc_id", "start", "ids"],
        )
        low = high


def _qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI of its file system, as tasks on any machine understand it."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    return found.replace("file:/", "file:///", 1) if found.startswith("file:/") and "://" not in found else found


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = None) -> None:
    """Encodes documents (doc_id, text) and writes their ids to a new folder, ascending by doc_id.

    The texts are dealt by ranges of doc_id once, then encoded and written by the same
    tasks; a doc_id that many rows share is dealt by a hash of the text too.
    """
    spark = docs.sparkSession
    spark.dataSource.register(TokenFiles)
    place = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    ordered = narrow.repartitionByRange(partitions(spark), *place).sortWithinPartitions(*place)
    coded = with_token_ids(ordered, vocabulary, end_id)
    coded.write.format("token_files").mode("append").save(_qualified(spark, path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of a folder written by ``write_token_files``; any rows' order."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").load(_qualified(spark, path))


def token_digests(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of documents, from files written and read back.

    The files stand in the session's checkpoint folder, as long as its other intermediates.
    """
    spark = docs.sparkSession
    path = scratch_path(spark)
    if path is None:
        raise ValueError("name a shared folder in spark.checkpoint.dir")
    write_token_files(docs, path, vocabulary, end_id)
    ids = read_token_files(spark, path)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return ids.select("doc_id", "start", n_tokens.alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
