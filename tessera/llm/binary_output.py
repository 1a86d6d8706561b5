"""Token-id files: independent zstandard frames, a trailing seek table and a checksum per frame.

A file is a row of zstandard frames, each holding the little-endian unsigned 32-bit ids of whole
documents; then one skippable frame with the index of documents; then the seek table of the public
seekable format (skippable frame 0x184D2A5E: compressed size, plain size and checksum of each frame,
then the number of frames, a descriptor byte and the magic number).  Any zstandard reader can read the
ids; a reader with the table fetches and decompresses only the frames that hold the documents asked for.

Defined results: a null or empty text has only the end id; a null doc_id sorts before all others and stays
null; equal doc_ids are ordered by a hash of the text, then by text; repeated rows are written as often as they come; an empty table
writes no file and returns no row; other columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, file_system, shared_dir
from .tokens import ChunkEncoder

SEEK_MAGIC, SEEK_FRAME, INDEX_FRAME = 0x8F92EAB1, 0x184D2A5E, 0x184D2A50
_ENTRY = struct.Struct("<III")


class FrameWriter:
    """Writes one file.  A frame is closed at ``frame_bytes``; a longer document has a frame of its own."""

    def __init__(self, out, frame_bytes: int = 1 << 18, level: int = 3):
        import zstandard

        self.out, self.frame_bytes = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.waiting: list[bytes] = []
        self.size = 0
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.tokens: list[int] = []
        self.in_frame: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._close_frame()
        self.doc_ids.append(doc_id)
        self.tokens.append(len(ids) // 4)
        self.in_frame.append(len(self.frames))
        self.waiting.append(ids)
        self.size += len(ids)

    def _close_frame(self) -> None:
        import xxhash

        plain = b"".join(self.waiting)
        packed = self.pack.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.waiting, self.size = [], 0

    def close(self) -> None:
        import numpy as np

        if self.waiting:
            self._close_frame()
        index = self.pack.compress(
            struct.pack("<Q", len(self.doc_ids))
            + np.array([x or 0 for x in self.doc_ids], "<i8").tobytes()
            + np.array(self.tokens, "<u8").tobytes()
            + np.array(self.in_frame, "<u4").tobytes()
            + bytes(x is None for x in self.doc_ids)
        )
        self.out.write(struct.pack("<II", INDEX_FRAME, len(index)) + index)
        table = b"".join(_ENTRY.pack(*x) for x in self.frames) + struct.pack("<IBI", len(self.frames), 0x80, SEEK_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table)) + table)


class FrameReader:
    """Reads the tables of one file, then only the frames that are asked for."""

    def __init__(self, source, size: int):
        import numpy as np
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        n, descriptor, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_MAGIC or not descriptor & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        head = size - 9 - n * _ENTRY.size - 8
        if struct.unpack("<II", self._at(head, 8)) != (SEEK_FRAME, n * _ENTRY.size + 9):
            raise ValueError("the seek table's frame has another size than its entries")
        self.frames = list(_ENTRY.iter_unpack(self._at(head + 8, n * _ENTRY.size)))
        self.begins = [0]
        for packed, _, _ in self.frames:
            self.begins.append(self.begins[-1] + packed)
        kind, length = struct.unpack("<II", self._at(self.begins[-1], 8))
        if kind != INDEX_FRAME or self.begins[-1] + 8 + length != head:
            raise ValueError("the index of documents isn't where the seek table says")
        plain = self.unpack.decompress(self._at(self.begins[-1] + 8, length))
        (docs,) = struct.unpack("<Q", plain[:8])
        cut = np.cumsum([8, 8 * docs, 8 * docs, 4 * docs, docs])
        null = np.frombuffer(plain[cut[3] : cut[4]], "u1")
        self.doc_ids = [None if gone else int(x) for x, gone in zip(np.frombuffer(plain[cut[0] : cut[1]], "<i8"), null, strict=True)]
        self.tokens = np.frombuffer(plain[cut[1] : cut[2]], "<u8").tolist()
        self.in_frame = np.frombuffer(plain[cut[2] : cut[3]], "<u4").tolist()

    def _at(self, begin: int, length: int) -> bytes:
        self.source.seek(begin)
        return self.source.read(length)

    def frame(self, k: int) -> bytes:
        import xxhash

        plain = self.unpack.decompress(self._at(self.begins[k], self.frames[k][0]))
        if len(plain) != self.frames[k][1] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.frames[k][2]:
            raise ValueError(f"frame {k} fails its checksum")
        return plain

    def documents(self, wanted: set[int | None] | None = None) -> Iterator[tuple[int | None, bytes]]:
        """(doc_id, ids) in file order; with ``wanted`` only those, and only their frames are unpacked."""
        at, frame, plain = 0, -1, b""
        for doc_id, tokens, k in zip(self.doc_ids, self.tokens, self.in_frame, strict=True):
            if k != frame:
                frame, at, plain = k, 0, b""
            if wanted is None or doc_id in wanted:
                plain = plain or (self.frame(k) if tokens else b"")
                yield doc_id, plain[at : at + 4 * tokens]
            at += 4 * tokens


def read_documents(url: str, wanted: set[int | None] | None = None) -> list[tuple[int | None, bytes]]:
    """Documents of one file; only frames of those wanted are unpacked."""
    system, path = file_system(url)
    with system.open_input_file(path) as f:
        return list(FrameReader(f, f.size()).documents(wanted))


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, files: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = 1 << 18, level: int = 3,
) -> DataFrame:
    """Encode ``docs`` and write them in ascending id order, a file for each range of ids.

    Returns, already computed, one row a file: file (name), part, docs, tokens.  A task writes under a
    name of its attempt and renames at its end, so a task that is run again leaves the same files.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    files = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches):
        import os
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        name, at = f"part-{part:06d}.tzst", None
        system, root = file_system(folder)
        encoder = ChunkEncoder.of(tokenizer)
        docs_n = tokens_n = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if at is None:
                system.create_dir(root, recursive=True)
                at = f"{root}/_{name}.{os.getpid()}-{uuid.uuid4().hex}"
                out = system.open_output_stream(at)
                writer = FrameWriter(out, frame_bytes, level)
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                writer.add(doc_id, ids + end)
                docs_n += 1
                tokens_n += len(ids + end) // 4
        if at is not None:
            writer.close()
            out.close()
            system.move(at, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [name], "part": [part], "docs": [docs_n], "tokens": [tokens_n]}, schema=pa.schema([("file", pa.string()), ("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # texts of one id, such as null, are dealt by their hashes, or they would all be one file
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc()]
    dealt = narrow.withColumn("tie", F.xxhash64("text")).repartitionByRange(files, *order)
    ordered = dealt.sortWithinPartitions(*order, F.col("text").asc_nulls_first()).select("doc_id", "text")
    rows = ordered.mapInArrow(write, "file string, part int, docs long, tokens long").collect()  # a row a file
    return spark.createDataFrame(rows, "file string, part int, docs long, tokens long")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """One row a document from the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32."""
    spark = files.sparkSession
    start, rows = 0, []
    for r in sorted(files.collect(), key=lambda r: r["part"]):  # a row a file
        rows.append((r["file"], start, r["tokens"]))
        start += r["tokens"]

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        system, root = file_system(folder)
        for batch in batches:
            for name, begin, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at, found = begin, []
                with system.open_input_file(f"{root}/{name}") as f:
                    for doc_id, ids in FrameReader(f, f.size()).documents():
                        found.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
                        at += len(ids) // 4
                if at - begin != tokens:
                    raise ValueError(f"{name} has {at - begin} ids, not {tokens}")
                for k in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found[k : k + 10_000], strict=True)], schema=schema)

    schema = "file string, start long, tokens long"
    if not rows:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    spread = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), schema)
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None, files: int | None = None) -> DataFrame:
    """Write the files and read them back; see the module for nulls, ties and empty tables."""
    folder = folder or shared_dir(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id, files), folder)
