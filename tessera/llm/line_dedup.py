"""Removal of lines that several documents share, by a sharded minimal perfect hash instead of a join of lines.

Lines are known by a 128-bit hash of their key (stripped, ASCII letters in lower case).  Spark counts the documents of each hash;
the hashes found in enough of them are dealt over shards, and each shard becomes one file: a minimal perfect hash (levels of bits, in which a
key rests where it is alone) that numbers the shard's hashes without holes, and arrays by that number: a 64-bit fingerprint, the count of documents and
the last document.  Documents are then read once more; a task looks its lines up in the arrays and shuffles nothing.
A hash that isn't in the index gets the number of another or none, and fails the fingerprint.  Documents are
read in blocks and a worker holds only a few shards, so memory is bounded.  A task reads every shard that its lines
need once a block, which costs blocks x the index; an index of over ``probe_bytes`` is probed the other way about: hashes of lines are dealt by shard,
each task looks up those of a few shards in turn, and the numbers of lines to drop go back to their documents.  Both ways probe the same arrays.

Defined results: a null or empty text is one empty line; rows are documents, each counted once a line however often it holds it; if the last
``doc_id`` comes in several rows, they all keep the line; null ids count as lower than any id; a text of any length is
read whole; an empty table has no rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, file_system, quoted, shared_dir, written
from .shingles import mix

_SPACE = b" \t\n\v\f\r"


def keys_of(text: str | None, least_chars: int) -> tuple[list[bytes], list[bytes | None]]:
    """Lines of a text as UTF-8, and the 128-bit hash of each line's key, None for keys under ``least_chars`` code points."""
    import xxhash

    data = (text or "").encode("utf-8", "surrogatepass")
    hashes: list[bytes | None] = []
    for low in data.lower().split(b"\n"):  # of bytes, lower() touches A-Z alone
        key = low.strip(_SPACE)
        n = len(key)
        if n >= least_chars and not key.isascii() and n < 4 * least_chars:
            n = len(key.decode("utf-8", "surrogatepass"))
        hashes.append(xxhash.xxh3_128_digest(key) if n >= least_chars else None)
    return data.split(b"\n"), hashes


def halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


class PerfectHash:
    """Numbers n distinct 128-bit keys from 0 to n-1 in about 4 bits a key.

    Level by level the keys that are left fall into ``gamma`` times as many places; those that are alone in theirs stay and set its
    bit.  A key's number is how many bits are set before its own.
    """

    def __init__(self, bits: np.ndarray, begins: np.ndarray):
        self.bits, self.begins = bits, begins  # 64 places a word; the first place of each level and the end
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @staticmethod
    def place(high: np.ndarray, low: np.ndarray, level: int, size: int) -> np.ndarray:
        salted = mix(high + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        return (mix(salted ^ low) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, gamma: float = 1.6) -> PerfectHash:
        words, begins = [], [0]
        while len(high):
            if len(begins) > 200:
                raise ValueError("keys repeat")
            size = -(-max(64, int(gamma * len(high))) // 64) * 64
            at = cls.place(high, low, len(begins) - 1, size)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            begins.append(begins[-1] + size)
            left = ~alone[at]
            high, low = high[left], low[left]
        return cls(np.concatenate(words) if words else np.zeros(0, np.uint64), np.array(begins, np.int64))

    def __len__(self) -> int:
        return int(self.before[-1])

    def numbers(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The number of each key; any number or -1 for keys that weren't built in."""
        out = np.full(len(high), -1, np.int64)
        rest = np.arange(len(high))
        for level in range(len(self.begins) - 1):
            if not len(rest):
                break
            at = self.begins[level] + self.place(high[rest], low[rest], level, int(self.begins[level + 1] - self.begins[level]))
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[rest[here]] = (self.before[at >> 6] + below)[here]
            rest = rest[~here]
        return out


class Shard:
    """One file of the index: a perfect hash and the arrays that it numbers."""

    def __init__(self, hashed: PerfectHash, prints: np.ndarray, counts: np.ndarray, last: np.ndarray, no_last: np.ndarray):
        self.hashed, self.prints, self.counts, self.last, self.no_last = hashed, prints, counts, last, no_last
        self.bytes = sum(x.nbytes for x in (hashed.bits, hashed.before, prints, counts, last, no_last))

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, last: np.ndarray, no_last: np.ndarray) -> Shard:
        hashed = PerfectHash.build(high, low)
        order = np.empty(len(high), np.int64)
        order[hashed.numbers(high, low)] = np.arange(len(high))
        return cls(hashed, high[order], counts[order].astype(np.uint32), last[order], no_last[order])

    def save(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, bits=self.hashed.bits, begins=self.hashed.begins, prints=self.prints, counts=self.counts, last=self.last, no_last=self.no_last)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data), allow_pickle=False) as x:
            return cls(PerfectHash(x["bits"], x["begins"]), x["prints"], x["counts"], x["last"], x["no_last"])

    def find(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The place of each key in the arrays, -1 for a stranger."""
        at = self.hashed.numbers(high, low)
        known = at >= 0
        known[known] = self.prints[at[known]] == high[known]
        return np.where(known, at, -1)


def line_counts(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(high, low, n, last): documents and the largest id of each line hash; each batch is counted before the shuffle."""
    bounded_batches(docs.sparkSession)

    def count(batches):
        import pyarrow as pa

        schema = pa.schema([("high", pa.int64()), ("low", pa.int64()), ("n", pa.int64()), ("last", pa.int64())])

        def out(found: dict[bytes, list]) -> pa.RecordBatch:
            high, low = halves(list(found))
            n, last = zip(*found.values(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(high.view("<i8")), pa.array(low.view("<i8")), pa.array(n, pa.int64()), pa.array(last, pa.int64())], schema=schema)

        for batch in batches:
            found: dict[bytes, list] = {}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for h in set(keys_of(text.as_py(), least_chars)[1]):
                    if h is None:
                        continue
                    if (have := found.get(h)) is None:
                        found[h] = [1, doc_id]
                    else:
                        have[0] += 1
                        if have[1] is None or doc_id is not None and doc_id > have[1]:
                            have[1] = doc_id
                if len(found) > 200_000:
                    yield out(found)
                    found = {}
            if found:
                yield out(found)

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    counted = rows.mapInArrow(count, "high long, low long, n long, last long")
    return counted.groupBy("high", "low").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def _save(url: str, data: bytes) -> None:
    """Written under a name of its own and renamed, so a task that runs again leaves the same file."""
    system, path = file_system(url)
    own = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(own) as f:
        f.write(data)
    system.move(own, path)


def build_index(counts: DataFrame, folder: str, shard_keys: int = 250_000) -> tuple[int, int]:
    """Write the shards of line hashes (high, low, n, last); their number and bytes.  A shard holds about ``shard_keys``."""
    counts = written(counts, "lines")
    shards = -(-counts.count() // shard_keys) or 1
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)

    def build(table):
        import pyarrow as pa

        def of(name):
            return table.column(name).to_numpy()

        k, last = table.column("shard")[0].as_py(), table.column("last")
        shard = Shard.build(of("high").view("<u8"), of("low").view("<u8"), of("n"), last.fill_null(0).to_numpy(), last.is_null().to_numpy())
        _save(f"{folder}/shard-{k}.npz", shard.save())
        return pa.table({"shard": pa.array([k], pa.int64()), "keys": pa.array([len(shard.hashed)], pa.int64()), "bytes": pa.array([shard.bytes], pa.int64())})

    dealt = counts.withColumn("shard", F.pmod("low", F.lit(shards)))
    done = dealt.groupBy("shard").applyInArrow(build, "shard long, keys long, bytes long")
    n, size = done.agg(F.coalesce(F.sum("keys"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()  # two numbers
    if n != (m := counts.count()):
        raise ValueError(f"the index has {n} of {m} line hashes")
    return shards, size


class IndexReader:
    """Looks hashes up shard by shard; shards in memory are bounded by ``most_bytes``."""

    def __init__(self, folder: str, shards: int, most_bytes: int = 64 << 20):
        self.folder, self.shards, self.most_bytes = folder, shards, most_bytes
        self.held: OrderedDict[int, Shard | None] = OrderedDict()
        self.size = 0

    def shard(self, k: int) -> Shard | None:
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        system, path = file_system(f"{self.folder}/shard-{k}.npz")
        found = None
        if system.get_file_info(path).is_file:  # a shard without a key has no file
            with system.open_input_file(path) as f:
                found = Shard.load(f.read())
        self.held[k] = found
        self.size += found.bytes if found else 0
        while self.size > self.most_bytes and len(self.held) > 1:
            _, old = self.held.popitem(last=False)
            self.size -= old.bytes if old else 0
        return found

    def look_up(self, hashes: list[bytes]) -> dict[bytes, tuple[int, int | None]]:
        """(documents, last id) of those hashes that the index has."""
        if not hashes:
            return {}
        high, low = halves(hashes)
        shard = low.view("<i8") % np.int64(self.shards)
        order, out = np.argsort(shard, kind="stable"), {}
        ks, begins = np.unique(shard[order], return_index=True)
        for k, mine in zip(ks.tolist(), np.split(order, begins[1:]), strict=True):
            if (own := self.shard(k)) is None:
                continue
            at = own.find(high[mine], low[mine])
            for i, p in zip(mine[at >= 0].tolist(), at[at >= 0].tolist(), strict=True):
                out[hashes[i]] = (int(own.counts[p]), None if own.no_last[p] else int(own.last[p]))
        return out


_OUT = "doc_id long, text string, n_lines long, n_dropped long"
#: A shard's lines are dealt over so many tasks, as one line may be in a third of all documents.
_SALTS = 16


def _kept(rows: list[tuple[int | None, list[bytes], list[bytes]]]):
    """A batch of (doc_id, lines, kept lines)."""
    import pyarrow as pa

    columns = zip(*((doc_id, b"\n".join(kept), len(lines), len(lines) - len(kept)) for doc_id, lines, kept in rows), strict=True)
    ids, texts, n, gone = columns
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], names=["doc_id", "text", "n_lines", "n_dropped"])


def _probed_in_place(rows: DataFrame, folder: str, shards: int, least_chars: int, block_bytes: int) -> DataFrame:
    def probe(batches):
        reader = IndexReader(folder, shards)

        def done(block: list[tuple[int | None, list[bytes], list[bytes | None]]]):
            found = reader.look_up(list({h for _, _, hashes in block for h in hashes if h is not None}))
            return _kept([(doc_id, lines, [x for x, h in zip(lines, hashes, strict=True) if h not in found or found[h][1] == doc_id]) for doc_id, lines, hashes in block])

        block: list[tuple[int | None, list[bytes], list[bytes | None]]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                lines, hashes = keys_of(text.as_py(), least_chars)
                block.append((doc_id, lines, hashes))
                size += sum(map(len, lines)) + 100 * len(lines)
                if size > block_bytes:
                    yield done(block)
                    block, size = [], 0
        if block:
            yield done(block)

    return rows.mapInArrow(probe, _OUT)


def _probed_by_shard(rows: DataFrame, folder: str, shards: int, least_chars: int) -> DataFrame:
    keys = ["doc_id", "text_hash", "text_hash2"]  # equal rows drop equal lines, so they may share a key
    rows = rows.withColumns({"text_hash": F.xxhash64("text"), "text_hash2": F.xxhash64("text", F.lit(1))})

    def hashes(batches):
        import pyarrow as pa

        for batch in batches:
            at, place, found = [], [], []
            for k, text in enumerate(batch.column(1)):
                own = [(n, h) for n, h in enumerate(keys_of(text.as_py(), least_chars)[1]) if h is not None]
                at += [k] * len(own)
                place += [n for n, _ in own]
                found += [h for _, h in own]
            high, low = halves(found)
            taken = [batch.column(c).take(pa.array(at, pa.int64())) for c in (0, 2, 3)]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(place, pa.int32()), pa.array(high.view("<i8")), pa.array(low.view("<i8"))], names=[*keys, "line", "high", "low"])

    def look_up(batches):
        import pyarrow as pa

        reader = IndexReader(folder, shards)
        for batch in batches:
            names = [b"".join(x) for x in zip(*([v[k : k + 8] for k in range(0, len(v), 8)] for v in (batch.column(c).to_numpy().tobytes() for c in (4, 5))), strict=True)]
            found = reader.look_up(list(set(names)))
            gone = [k for k, (doc_id, h) in enumerate(zip(batch.column(0).to_pylist(), names, strict=True)) if h in found and found[h][1] != doc_id]
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(gone, pa.int64())) for c in range(4)], names=[*keys, "line"])

    def cut(batches):
        for batch in batches:
            out = []
            for doc_id, text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                lines, drop = (text or "").encode("utf-8", "surrogatepass").split(b"\n"), set(gone or ())
                out.append((doc_id, lines, [x for k, x in enumerate(lines) if k not in drop]))
            if out:
                yield _kept(out)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = rows.mapInArrow(hashes, "doc_id long, text_hash long, text_hash2 long, line int, high long, low long")
    dealt = lines.withColumns({"shard": F.pmod("low", F.lit(shards)), "salt": F.pmod(F.xxhash64(*keys), F.lit(_SALTS))}).repartition(parts, "shard", "salt").sortWithinPartitions("shard")
    gone = dealt.select(*keys, "line", "high", "low").mapInArrow(look_up, "doc_id long, text_hash long, text_hash2 long, line int").groupBy(*keys).agg(F.collect_set("line").alias("gone"))  # a document's lines
    a, b = rows.alias("a"), gone.alias("b")
    same = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & F.col("a.text_hash").eqNullSafe(F.col("b.text_hash")) & F.col("a.text_hash2").eqNullSafe(F.col("b.text_hash2"))
    return a.join(b, same, "left").select("a.doc_id", "a.text", "b.gone").mapInArrow(cut, _OUT)


def dedup_lines(
    docs: DataFrame, least_docs: int = 3, least_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, block_bytes: int = 16 << 20, probe_bytes: int = 256 << 20,
) -> DataFrame:
    """doc_id, text (its kept lines), n_lines (before) and n_dropped of each document.

    A line whose key has at least ``least_chars`` code points and is found in at least ``least_docs`` documents stays only in the largest
    ``doc_id`` that holds it.
    """
    folder = folder or shared_dir(docs.sparkSession, "line-index")
    counts = line_counts(docs, id_col, text_col, least_chars)
    shards, size = build_index(counts.where(F.col("n") >= least_docs), folder)
    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return _probed_in_place(rows, folder, shards, least_chars, block_bytes) if size <= probe_bytes else _probed_by_shard(rows, folder, shards, least_chars)


def digests_sql() -> str:
    """The query on ``documents`` in DuckDB's SQL."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
        WITH lines AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{upper}', '{lower}') AS key FROM lines),
        many AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT doc_id, k, line, last IS NOT NULL AND last <> doc_id AS gone FROM keyed LEFT JOIN many USING (key))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id"""
