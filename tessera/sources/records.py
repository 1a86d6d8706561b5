"""Record files as a Spark data source: length-prefixed records with masked CRC-32C checksums, read by position from a manifest.

A file is a row of records; each is its length (8 bytes, little-endian), the masked checksum of that, the data, and their masked checksum.  The reader plans
from a manifest which positions of which shards are wanted: one partition a shard and run of positions, none for other shards.  It steps over records that
nobody wants by their lengths and stops after the last wanted one; where the manifest gives offsets, it goes straight there.  Filters on shard and
position reach the plan, and features that the schema doesn't name stay encoded.  The writer deals with one shard after the other, hashes what it
writes and hands it to the driver, which commits all shards of a job or none.

Data are any bytes (``data binary``), or the public Example message of named lists of bytes, floats or integers, a column a feature.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shipping import ensure_importable
from . import commits

FORMAT = "tessera_records"
# fixed values of the file format: the reversed Castagnoli polynomial, what is added to a rotated checksum
POLYNOMIAL, MASK = 0x82F63B78, 0xA282EAD8
_HEAD, _TAIL = struct.Struct("<QI"), struct.Struct("<I")
_BLOCK = 64


@cache
def _table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1)
    return c


@cache
def _over_blocks(k: int) -> np.ndarray:
    """What 2^k blocks of zeros make of each byte of a register, four tables of 256."""
    if k:
        half = _over_blocks(k - 1)
        return _shift(half, half)
    c = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(_BLOCK):
        c = _table()[c & 255] ^ (c >> 8)
    return c


def _shift(c: np.ndarray, tables: np.ndarray) -> np.ndarray:
    return tables[0][c & 255] ^ tables[1][(c >> 8) & 255] ^ tables[2][(c >> 16) & 255] ^ tables[3][c >> 24]


def crc32c(chunks: list[bytes]) -> list[int]:
    """CRC-32C of each chunk.  Zeros in front change nothing, so chunks of like length are filled up to 2^k blocks; all blocks
    are then reduced byte by byte together, and neighbours put together level by level."""
    out = [0] * len(chunks)
    by: dict[int, list[int]] = {}
    for n, data in enumerate(chunks):
        by.setdefault(max(0, (-(-len(data) // _BLOCK) - 1).bit_length()), []).append(n)
    for k, own in by.items():
        size = _BLOCK << k
        for at in range(0, len(own), max(1, (4 << 20) // size)):
            some = own[at : at + max(1, (4 << 20) // size)]
            rows = np.zeros((len(some), size), np.uint8)
            for r, n in enumerate(some):
                if data := chunks[n]:
                    rows[r, size - len(data) :] = np.frombuffer(data, np.uint8)
                    rows[r, size - len(data) : size - max(0, len(data) - 4)] ^= 255  # a register that starts with ones
            c = np.zeros((len(some), 1 << k), np.uint32)
            blocks = rows.reshape(len(some), 1 << k, _BLOCK)
            for byte in range(_BLOCK):
                c = _table()[(c ^ blocks[:, :, byte]) & 255] ^ (c >> 8)
            for level in range(k):
                c = _shift(c[:, ::2], _over_blocks(level)) ^ c[:, 1::2]
            for n, x in zip(some, c[:, 0].tolist(), strict=True):
                data = chunks[n]
                # of fewer than four bytes, some of the ones are still in the register
                out[n] = (x ^ 0xFFFFFFFF >> 8 * len(data) if len(data) < 4 else x) ^ 0xFFFFFFFF
    return out


def masked(crc: int) -> int:
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def framed(datas: list[bytes]) -> list[bytes]:
    """Records as they stand in a file."""
    heads = [struct.pack("<Q", len(d)) for d in datas]
    crcs = crc32c(heads + datas)
    return [h + _TAIL.pack(masked(a)) + d + _TAIL.pack(masked(b)) for h, d, a, b in zip(heads, datas, crcs[: len(datas)], crcs[len(datas) :], strict=True)]


# --- the Example message -----------------------------------------------------------------------------

def _varint(x: int) -> bytes:
    x &= (1 << 64) - 1
    out = bytearray()
    while x > 127:
        out.append(x & 127 | 128)
        x >>= 7
    return bytes(out + bytes([x]))


def _field(number: int, body: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(body)) + body


def encode_example(features: dict[str, list]) -> bytes:
    """Lists of integers, floats, or bytes and strings; null is an empty feature."""
    entries = []
    for name, values in features.items():
        first = next(iter(values or ()), None)
        if first is None:
            kind = b""
        elif isinstance(first, int):
            kind = _field(3, _field(1, b"".join(map(_varint, map(int, values)))))
        elif isinstance(first, float):
            kind = _field(2, _field(1, np.array(values, "<f4").tobytes()))
        else:
            kind = _field(1, b"".join(_field(1, v.encode() if isinstance(v, str) else bytes(v)) for v in values))
        entries.append(_field(1, _field(1, name.encode()) + _field(2, kind)))
    return _field(1, b"".join(entries))


def _fields(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(number, body) of length-delimited fields, and single numbers of other kinds as their bytes."""
    at, n = 0, len(data)

    def number() -> int:
        nonlocal at
        x = shift = 0
        while True:
            b = data[at]
            at += 1
            x |= (b & 127) << shift
            if b < 128:
                return x
            shift += 7

    while at < n:
        tag = number()
        if tag & 7 == 2:
            size = number()
            if at + size > n:
                raise ValueError("a field ends after its message")
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            begin = at
            if tag & 7 == 0:
                number()
            elif tag & 7 in (1, 5):
                at += 8 if tag & 7 == 1 else 4
            else:
                raise ValueError(f"wire type {tag & 7}")
            yield tag >> 3, data[begin:at]


def _integers(body: memoryview) -> list[int]:
    b = np.frombuffer(body, np.uint8)
    ends = np.flatnonzero(b < 128)
    begins = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(begins, ends - begins + 1)
    parts = (b & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.bitwise_or.reduceat(parts, begins).view(np.int64).tolist() if len(ends) else []


def decode_example(data: bytes, wanted: set[str]) -> dict[str, list]:
    """The wanted features; others are stepped over."""
    out: dict[str, list] = {}
    for _, features in _fields(memoryview(data)):
        for _, entry in _fields(features):
            parts = dict(_fields(entry))
            name = bytes(parts[1]).decode()
            if name not in wanted:
                continue
            values: list = []
            for kind, body in _fields(parts.get(2, memoryview(b""))):
                for _, value in _fields(body):
                    if kind == 1:
                        values.append(bytes(value))
                    elif kind == 2:
                        values += np.frombuffer(value, "<f4").tolist()
                    else:
                        values += _integers(value)
            out[name] = values
    return out


# --- reading -----------------------------------------------------------------------------------------

@dataclass
class Stretch(InputPartition):
    """Wanted records of one shard: positions, or offsets where they are known."""

    shard: str
    size: int | None
    positions: np.ndarray
    offsets: np.ndarray | None = None

    def __post_init__(self):
        self.value = None


class RecordReader(DataSourceReader):
    """Options: ``path``; ``manifest`` (Parquet with shard, position and perhaps bytes, the shard's size, and offset), all records without it;
    ``stretch``: at most so many records a partition."""

    def __init__(self, schema: StructType, options: dict):
        self.schema, self.root, self.manifest = schema, options["path"], options.get("manifest")
        self.stretch = int(options.get("stretch", 10_000))
        self.filters: list = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | In | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and f.attribute in (("shard",), ("position",)):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, column: str):
        """The pushed filters on a column as a pyarrow expression."""
        import pyarrow.dataset as ds

        out, x = ds.scalar(True), ds.field(column)
        for f in (f for f in self.filters if f.attribute == (column,)):
            out = out & {EqualTo: lambda v: x == v, In: lambda v: x.isin(list(v)), GreaterThan: lambda v: x > v, GreaterThanOrEqual: lambda v: x >= v, LessThan: lambda v: x < v, LessThanOrEqual: lambda v: x <= v}[type(f)](f.value)
        return out

    def partitions(self) -> list[Stretch]:
        import pyarrow as pa
        import pyarrow.dataset as ds
        from pyarrow import fs

        if not self.manifest:
            system, root = commits.file_system(self.root)
            files = sorted((f for f in system.get_file_info(fs.FileSelector(root)) if f.is_file), key=lambda f: f.path)
            names = pa.table({"shard": [os.path.basename(f.path) for f in files], "bytes": [f.size for f in files]})
            rows = ds.dataset(names).to_table(filter=self._wanted("shard")).to_pylist()
            return [Stretch(r["shard"], r["bytes"], None) for r in rows] or [Stretch("", None, np.zeros(0, np.int64))]
        system, path = commits.file_system(self.manifest)
        data = ds.dataset(path, filesystem=system, format="parquet")
        columns = [c for c in ("shard", "position", "bytes", "offset") if c in data.schema.names]
        rows = data.to_table(columns=columns, filter=self._wanted("shard") & self._wanted("position")).sort_by([("shard", "ascending"), ("position", "ascending")])
        out: list[Stretch] = []
        shards = rows.column("shard").to_numpy(zero_copy_only=False)
        positions = rows.column("position").to_numpy()
        begins = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else []
        for lo, hi in zip(begins, [*begins[1:], len(shards)], strict=True) if len(shards) else ():
            if (np.diff(positions[lo:hi]) == 0).any():
                raise ValueError(f"the manifest repeats positions of {shards[lo]}")
            for at in range(lo, hi, self.stretch):
                end = min(hi, at + self.stretch)
                offsets = rows.column("offset")[at:end].to_numpy() if "offset" in columns else None
                out.append(Stretch(shards[lo], rows.column("bytes")[lo].as_py() if "bytes" in columns else None, positions[at:end], offsets))
        return out or [Stretch("", None, np.zeros(0, np.int64))]

    def read(self, partition: Stretch) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        if partition.positions is not None and not len(partition.positions):
            return
        schema = to_arrow_schema(self.schema)
        features = {f.name for f in self.schema.fields} - {"shard", "position", "data"}
        strings = {f.name for f in self.schema.fields if f.dataType.simpleString() == "array<string>"}
        held: list[tuple[int, bytes, int]] = []
        size = 0

        def batch() -> pa.RecordBatch:
            for (position, _, crc), found in zip(held, crc32c([d for _, d, _ in held]), strict=True):
                if masked(found) != crc:
                    raise ValueError(f"record {position} of {partition.shard} fails its checksum")
            decoded = [decode_example(d, features) for _, d, _ in held] if features else []
            columns = {"shard": [partition.shard] * len(held), "position": [p for p, _, _ in held], "data": [d for _, d, _ in held]}
            for name in features:
                values = [x.get(name) for x in decoded]
                columns[name] = [v and [b.decode() for b in v] for v in values] if name in strings else values
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)

        for record in self.records(partition):
            held.append(record)
            size += len(record[1])
            if size > 8 << 20 or len(held) >= 1000:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    def records(self, partition: Stretch) -> Iterator[tuple[int, bytes, int]]:
        """(position, data, stored checksum) of the wanted records; a shard of another size or without a position is an error."""
        system, path = commits.file_system(f"{self.root}/{partition.shard}")
        with system.open_input_file(path) as f:
            size = f.size()
            if partition.size is not None and size != partition.size:
                raise ValueError(f"{partition.shard} has {size} bytes, not {partition.size}")
            wanted = partition.positions.tolist() if partition.positions is not None else None
            offsets = partition.offsets.tolist() if partition.offsets is not None else None
            at = position = k = 0
            while wanted is None or k < len(wanted):
                if offsets is not None:
                    at, position = offsets[k], wanted[k]
                if at >= size and wanted is None:
                    break
                if at + _HEAD.size > size:
                    raise ValueError(f"{partition.shard} has no record {wanted[k] if wanted else position}")
                f.seek(at)
                head = f.read(_HEAD.size)
                length, crc = _HEAD.unpack(head)
                if masked(crc32c([head[:8]])[0]) != crc or at + _HEAD.size + length + _TAIL.size > size:
                    raise ValueError(f"the length of record {position} of {partition.shard} fails its checksum")
                if wanted is None or position == wanted[k]:
                    body = f.read(length + _TAIL.size)
                    yield position, body[:length], _TAIL.unpack(body[length:])[0]
                    k += 1
                at += _HEAD.size + length + _TAIL.size
                position += 1


# --- writing -----------------------------------------------------------------------------------------

@dataclass
class Written(WriterCommitMessage):
    entries: list[dict] = field(default_factory=list)


class RecordWriter(DataSourceArrowWriter):
    """Writes one file a shard and, beside it, its index: the ``keys`` columns with position, offset and length of each record.

    Options: ``path``, ``shard`` (column), ``keys`` (columns, by commas), ``unique`` (a key that may not be null or repeat in a shard).  Rows must come shard by shard.  ``data`` is written as it is, without that
    column all others are features of an Example.
    """

    def __init__(self, options: dict):
        self.root, self.shard = options["path"], options.get("shard", "shard")
        self.keys = [k for k in options.get("keys", "").split(",") if k]
        self.unique = options.get("unique")

    def write(self, iterator) -> Written:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        done, out, index, name = Written(), None, [], None
        made: list[commits.HashedFile] = []

        def close() -> None:
            rows = pa.concat_tables(index)
            if self.unique:
                ids = rows.column(self.unique)
                if ids.null_count or pc.count_distinct(ids).as_py() < len(ids):
                    raise ValueError(f"{self.unique} is null or repeats in {name}")
            side = commits.HashedFile(self.root, f"index/{os.path.basename(out.name)}.parquet")
            made.append(side)
            entry = {"key": name, "records": rows.num_rows} | out.entry()
            extra = {"shard": os.path.basename(out.name), "bytes": out.bytes}
            for column, value in extra.items():
                rows = rows.append_column(column, pa.array([value] * rows.num_rows))
            pq.write_table(rows, side, compression="zstd")
            found = side.entry()
            done.entries.append(entry | {"index": found["file"], "index_sha256": found["sha256"]})

        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                shards = table.column(self.shard).to_pylist()
                for lo, hi in _runs(shards):
                    if shards[lo] is None:
                        raise ValueError("every record needs a shard")
                    if shards[lo] != name:
                        if out is not None:
                            close()
                        name, index = shards[lo], []
                        if any(e["key"] == name for e in done.entries):
                            raise ValueError(f"records of {name} don't come together")
                        out = commits.HashedFile(self.root, f"data/{commits.file_name(name)}")
                        made.append(out)
                    own = table.slice(lo, hi - lo)
                    if "data" in own.column_names:
                        datas = own.column("data").to_pylist()
                    else:
                        features = [c for c in own.column_names if c not in (self.shard, *self.keys)]
                        datas = [encode_example({c: v if isinstance(v, list) else [] if v is None else [v] for c, v in r.items()}) for r in own.select(features).to_pylist()]
                    frames = framed(datas)
                    ends = out.bytes + np.cumsum([len(x) for x in frames])
                    lengths = np.array([len(x) for x in frames], np.int64)
                    first = sum(t.num_rows for t in index)
                    index.append(own.select(self.keys).append_column("position", pa.array(np.arange(first, first + len(frames)))).append_column("offset", pa.array(ends - lengths)).append_column("length", pa.array(lengths)))
                    out.write(b"".join(frames))
            if out is not None:
                close()
        except BaseException:
            for f in made:
                f.discard()
            raise
        return done

    def commit(self, messages) -> None:
        entries = [e for m in messages if m for e in m.entries]
        keys = [e["key"] for e in entries]
        if twice := sorted({k for k in keys if keys.count(k) > 1})[:5] if len(set(keys)) < len(keys) else None:
            commits.discard(self.root, entries)
            raise ValueError(f"two tasks wrote {twice}: deal rows by shard")
        try:
            commits.commit(self.root, entries)
        except ValueError:
            commits.discard(self.root, entries)
            raise

    def abort(self, messages) -> None:
        commits.discard(self.root, [e for m in messages if m for e in m.entries])


def _runs(values: list) -> Iterator[tuple[int, int]]:
    lo = 0
    for k in range(1, len(values) + 1):
        if k == len(values) or values[k] != values[lo]:
            yield lo, k
            lo = k


class RecordSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "shard string, position long, data binary"

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        if overwrite:
            raise ValueError("record files are written once; append to them")
        return RecordWriter(self.options)


def _ready(spark: SparkSession) -> None:
    ensure_importable(spark)
    spark.dataSource.register(RecordSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_records(df: DataFrame, path: str, shard: str, keys: list[str], order: list[str], unique: str | None = None) -> None:
    """Write ``df`` as record files, one a shard, records in order of ``order``; a job that fails leaves nothing."""
    _ready(df.sparkSession)
    dealt = df.repartition(shard).sortWithinPartitions(shard, *order)
    writer = dealt.write.format(FORMAT).mode("append").option("path", path).option("shard", shard).option("keys", ",".join(keys))
    (writer.option("unique", unique) if unique else writer).save()


def written_index(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The index of all committed shards: keys, position, offset, length, shard (file), bytes.  A changed index file is refused before it is used."""
    entries = commits.committed(path)
    if not entries:
        raise ValueError(f"{path} has no committed shard")
    if verify:
        checked = changed_files(spark, path, [(e["index"], e["index_sha256"]) for e in entries])
        if checked:
            raise ValueError(f"index files were changed: {checked[:5]}")
    return spark.read.parquet(*(f"{path}/{e['index']}" for e in entries))


def changed_files(spark: SparkSession, path: str, files: list[tuple[str, str]]) -> list[str]:
    """Of (file, SHA-256), the files that are missing or differ; tasks hash them a MB at a time."""
    ensure_importable(spark)

    def check(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            bad = []
            for name, want in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, at = commits.file_system(f"{path}/{name}")
                sha = hashlib.sha256()
                if system.get_file_info(at).is_file:
                    with system.open_input_stream(at) as f:
                        while data := f.read(1 << 20):
                            sha.update(data)
                if sha.hexdigest() != want:
                    bad.append(name)
            yield pa.RecordBatch.from_pydict({"file": pa.array(bad, pa.string())})

    parts = max(1, min(len(files), spark.sparkContext.defaultParallelism * 4))
    rows = spark.createDataFrame(spark.sparkContext.parallelize(files, parts), "file string, sha256 string")
    return sorted(r[0] for r in rows.mapInArrow(check, "file string").collect())  # only what is wrong


def read_records(spark: SparkSession, path: str, manifest: str | None = None, schema: str | None = None, stretch: int = 10_000) -> DataFrame:
    """Records below ``path``, those of the manifest (a Parquet path) if there is one; ``schema`` names shard, position, data or features."""
    _ready(spark)
    reader = spark.read.format(FORMAT).option("path", path).option("stretch", stretch)
    reader = reader.option("manifest", manifest) if manifest else reader
    return (reader.schema(schema) if schema else reader).load()
