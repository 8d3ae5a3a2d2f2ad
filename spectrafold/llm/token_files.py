"""Token-id files: independent zstandard frames, a seek table at the end, a checksum for each frame.

Documents are range-partitioned and sorted by doc_id, and each task writes one file of its range.
A frame holds the little-endian unsigned 32-bit ids of consecutive documents, FRAME_IDS at least. After the frames come two
skippable frames of the zstandard format, so any decompressor reads the file as one stream of ids:
the document index (doc_id, null mark, frame, first id within it, number of ids, checksum of the ids) and the seek table
(compressed and decompressed size and checksum of each frame, then their number and a magic number).
A reader takes the tail, then only the frames of the documents that it wants.

A task names its file after itself and its attempt and returns the name with its totals; what it returned, written as a
table, is the manifest, so files of failed or repeated attempts are never read.

A blank, or a single line break, before a word always begins a pre-token, and pieces don't reach across pre-tokens. So a
text's ids are those of its parts, cut there, in a row. A bounded table remembers the parts' ids. A new part of Latin letters, with
ASCII punctuation after them or without, is two pre-tokens or one, which the library's model turns into ids; any other part
goes through the whole tokenizer, and so do texts that hold one of the tokenizer's special strings.

Defined results: a null text is the empty text, whose only id is the end; null doc_ids come first; repeated rows are
separate documents beside each other; an empty table gives an empty manifest; other columns are not read.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, new_folder, open_shared, slices

END = 0
FRAME_IDS = 1 << 18
#: Parts of texts that a worker remembers, from task to task.
REMEMBERED = 1_000_000
#: Code points of a part that is remembered, at most.
LONGEST = 64
#: Ids of a file; the next one is begun beyond.
FILE_IDS = 1 << 24
INDEX_FRAME, SEEK_FRAME, SEEK_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: Blanks that begin a part, in texts where others begin none.
PARTS = re.compile(r" (?=\S)")
LAST_LETTER = 0x24F
#: Latin letters to LAST_LETTER, perhaps after a line break, and ASCII punctuation without the apostrophe, which begins short pre-tokens.
LETTERS = re.compile(r"(\n?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+)([!-&(-/:-@\[-`{-~]+)?")
#: doc_id, null mark, frame, first id in it, number of ids, their checksum.
ENTRY = "<qBIIII"


class NoPart(Exception):
    """A blank or line break has white space or nothing behind it."""


class Encoder(dict):
    """Ids of texts by the tokenizers library, asked once for each part that is remembered.

    Of a part, letters and the punctuation after them are pre-tokens of their own; the library's model is asked for each.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.whole = Tokenizer.from_file(vocabulary)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # How the library writes the bytes of each character that LETTERS and ENDS let through, a blank and a line break.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(1, LAST_LETTER + 1)}
        self.blank = self.written[ord(" ")]
        self.model, self.end = self.whole.model, lru_cache(10_000)(self._pre_token)
        # Parts met before those remembered of late.
        self.old: dict[str, bytes] = {}

    def _pre_token(self, text: str) -> bytes:
        return self._tokens(text.translate(self.written))

    def _tokens(self, written: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(written)]).tobytes()

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _new(self, part: str) -> bytes:
        """The ids of a part after a blank, or with its line break."""
        head = part[1:2] if part[:1] == "\n" else part[:1]
        if not head or head.isspace():
            raise NoPart
        # ASCII letters are written as themselves.
        if part.isalpha() and part.isascii():
            return self._tokens(self.blank + part)
        plain = LETTERS.fullmatch(part)
        if not plain:
            return self._ids(part if part[0] == "\n" else " " + part)
        letters, end = plain.groups()
        if end:
            return self[letters] + self.end(end)
        return self.end("\n") + self._pre_token(part[1:]) if part[0] == "\n" else self._pre_token(" " + part)

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = self._new(part)
        if len(part) <= LONGEST:
            if 2 * len(self) > REMEMBERED:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids

    def _joined(self, parts: list[str]) -> bytes:
        """The ids of all parts; the first has no blank before it."""
        first, *rest = parts
        return b"".join([self._ids(first) if first else b"", *map(self.__getitem__, rest)])

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, and the end."""
        end = struct.pack("<I", END)
        for text in texts:
            if any(s in text for s in self.special):
                own = self._ids(text)
            else:
                try:
                    own = self._joined(text.replace("\n", " \n").split(" "))
                except NoPart:
                    own = self._joined(PARTS.split(text))
            yield np.frombuffer(own + end, "<u4")


@lru_cache(1)
def encoder_of(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


class Writer:
    """One file, frame by frame."""

    def __init__(self, out):
        self.out, self.press = out, zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.held, self.ids, self.frames, self.index = [], 0, [], bytearray()

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.tobytes()
        self.index += struct.pack(ENTRY, doc_id or 0, doc_id is None, len(self.frames), self.ids, len(ids), zlib.crc32(raw))
        self.held.append(raw)
        self.ids += len(ids)
        if self.ids >= FRAME_IDS:
            self.flush()

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.held)
            pressed = self.press.compress(raw)
            self.out.write(pressed)
            self.frames.append((len(pressed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.held, self.ids = [], 0

    def close(self) -> None:
        self.flush()
        index = zstandard.ZstdCompressor(level=3).compress(bytes(self.index))
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        self.frames.append((8 + len(index), 0, 0))
        # The seek table's footer: number of frames, descriptor with the checksum bit, magic number.
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)
        self.out.close()


class Reader:
    """Random access to one file's documents."""

    def __init__(self, source):
        self.source, size = source, source.seek(0, io.SEEK_END)
        frames, _, magic = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        self.frames, at = [], 0
        for entry in struct.iter_unpack("<III", self._bytes(size - 9 - 12 * frames, 12 * frames)):
            self.frames.append((at, *entry))
            at += entry[0]
        at, index_size, _, _ = self.frames.pop()
        index = zstandard.ZstdDecompressor().decompress(self._bytes(at + 8, index_size - 8))
        self.documents = list(struct.iter_unpack(ENTRY, index))

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, number: int) -> np.ndarray:
        at, size, plain, check = self.frames[number]
        raw = zstandard.ZstdDecompressor().decompress(self._bytes(at, size), max_output_size=plain)
        if len(raw) != plain or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {number} is damaged")
        return np.frombuffer(raw, "<u4")

    def document(self, place: int) -> np.ndarray:
        """The ids of the document at a place of the index; only its frame is read."""
        _, _, frame, first, n, _ = self.documents[place]
        return self.frame(frame)[first : first + n]

    def all(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """doc_id and ids of each document, frame by frame."""
        held, number = None, -1
        for doc_id, none, frame, first, n, check in self.documents:
            if frame != number:
                held, number = self.frame(frame), frame
            ids = held[first : first + n]
            if zlib.crc32(ids.tobytes()) != check:
                raise ValueError(f"document {doc_id} is damaged")
            yield None if none else doc_id, ids


def write_tokens(docs: DataFrame, vocabulary: str, folder: str) -> DataFrame:
    """Writes the files; the manifest: path, part and roll (their order), documents, ids."""
    names = ["path", "part", "roll", "documents", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        # Tasks are as many as cores; the library's own threads would only get in their way.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, part, roll, writer = encoder_of(vocabulary), TaskContext.get().partitionId(), 0, None

        def done() -> pa.RecordBatch:
            writer.close()
            row = (path, part, roll, documents, ids)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], names)

        for batch in slices(batches, 100):
            for doc_id, own in zip(batch.column(0).to_pylist(), encoder.ids([text or "" for text in batch.column(1).to_pylist()])):
                if not writer:
                    path, documents, ids = f"{folder}/part-{part:06d}-{roll:06d}-{uuid.uuid4().hex}.ids.zst", 0, 0
                    writer = Writer(open_shared(path, "wb"))
                writer.add(doc_id, own)
                documents, ids = documents + 1, ids + len(own)
                if ids >= FILE_IDS:
                    yield done()
                    writer, roll = None, roll + 1
        if writer:
            yield done()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The hash lets many rows of one doc_id, or of none, be dealt over several ranges.
    order = ["doc_id", F.xxhash64("text"), "text"]
    ordered = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    return cut(ordered.mapInArrow(run, "path string, part int, roll int, documents long, ids long"), "manifest")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, read back from the files and checked frame by frame."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    # One row for each file.
    before = Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1)
    files = cut(manifest.withColumn("first", F.coalesce(F.sum("ids").over(before), F.lit(0))), "files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open_shared(path, "rb") as source:
                    rows: list[tuple] = []
                    for doc_id, ids in Reader(source).all():
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)

    # A count, or the few rows would be gathered in one task.
    spread = files.select("path", "first").repartition(max(1, files.count()), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_tokens(write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "tokens")))
