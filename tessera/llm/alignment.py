"""Alignment of two tokenizers' ids over the same bytes, and how often their ids go together in a corpus.

Byte offsets at which a token of A and one of B end cut a document's ids into groups.  They are found in lockstep: one NumPy state vector
holds a pointer into A and one into B for every lane (a document, or a stretch of one between white space), a step advances the
pointer whose token ends first, or both, emits a cut for the lanes where both end, and lanes that are through leave the vector.  All ids of A
and of B in a group are linked.

A pair's count is the number of documents that hold it linked.  Documents lie in blocks of bounded size; a block writes the distinct pairs
of its documents once (``key``, ``n``) and its documents refer to them by place, so what is shuffled and joined is a row for a block and pair, not for a
document and pair.  Counts come back to the blocks, and each document sums over its links.

Defined results: a text that is null, empty or not rendered byte by byte by both vocabularies has no tokens, zeros and an empty hash; rows are documents of
their own, repeated or without an id; texts of any length are aligned whole, as long ones are cut at white space into lanes; an empty table has no
rows; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, written
from .tokens import _BYTE_CHARS

#: Neither tokenizer joins characters over the place before a space that follows another kind of character than white space.
_CUT = re.compile(r"(?<=\S) ")
#: Bits of an id in a pair's key.
_BITS = 20


def ragged(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - counts), counts)


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, a_lanes: np.ndarray, b_lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group, one past its last token of A and of B, in order.

    ``a_ends``, ``b_ends``: byte offsets at which tokens end, rising through all lanes; ``a_lanes``, ``b_lanes``: where each lane's tokens begin, and the
    number of all tokens.  Both sides of a lane end at the same offset and have tokens.
    """
    a, b, stop = a_lanes[:-1].copy(), b_lanes[:-1].copy(), a_lanes[1:]
    cuts_a, cuts_b = [], []
    while len(a):
        x, y = a_ends[a], b_ends[b]
        a += x <= y
        b += y <= x
        both = x == y
        cut = a[both]
        cuts_a.append(cut)
        cuts_b.append(b[both])
        if (through := cut == stop[both]).any():
            left = np.ones(len(a), bool)
            left[np.flatnonzero(both)[through]] = False
            a, b, stop = a[left], b[left], stop[left]
    if not cuts_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(cuts_a)), np.sort(np.concatenate(cuts_b))


class Vocabulary:
    """Ids of chunks of text, the bytes of each id, and ids as they are written in groups."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.lengths = np.array([len(x) for x in pieces], np.int64)

    @staticmethod
    def of(path: str) -> Vocabulary:
        return SentencePieces(path) if path.endswith(".model") else ByteLevel(path)


class ByteLevel(Vocabulary):
    """A byte-level vocabulary of the tokenizers library; special tokens' strings are plain text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        byte_of = {chr(b): b for b in range(256) if b not in _BYTE_CHARS} | {c: b for b, c in _BYTE_CHARS.items()}
        names = {i: name for name, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        plain = self.tokenizer.get_vocab(with_added_tokens=False)
        pieces = [names.get(i, "") for i in range(max(names) + 1)]
        super().__init__([bytes(byte_of[c] for c in x) if x in plain and all(c in byte_of for c in x) else x.encode() for x in pieces])

    def encode(self, chunks: list[str]) -> list[list[int]]:
        """Ids of a space and each chunk."""
        return [x.ids for x in self.tokenizer.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False)]


class SentencePieces(Vocabulary):
    """A sentencepiece model that puts a space in front and has byte pieces for what it lacks."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        super().__init__([bytes([int(x[1:-1], 16)]) if self.model.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)])

    def encode(self, chunks: list[str]) -> list[list[int]]:
        return self.model.encode(chunks, num_threads=1)


class _Side:
    """Ids of the chunks in a table, one after the other."""

    def __init__(self):
        self.ids, self.begin, self.count = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        self.total = 0

    def add(self, found: list[list[int]]) -> None:
        n = np.fromiter(map(len, found), np.int64, len(found))
        self.ids.append(np.fromiter((i for x in found for i in x), np.int32, int(n.sum())))
        self.count.append(n)
        self.begin.append(self.total + np.cumsum(n) - n)
        self.total += int(n.sum())

    def flat(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for x in (self.ids, self.begin, self.count):
            x[:] = [np.concatenate(x)] if len(x) > 1 else x
        return self.ids[0], self.begin[0], self.count[0]


@dataclass
class Aligned:
    """A batch of documents: ids of both sides, cuts of groups, and where each document's tokens, groups and bytes begin."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_docs: np.ndarray
    b_docs: np.ndarray
    a_cuts: np.ndarray
    b_cuts: np.ndarray
    groups: np.ndarray


class Aligner:
    """Aligns batches of texts.  A table of chunks between white space keeps ids of both sides; it starts anew when it is full."""

    _kept: dict[tuple[str, str], Aligner] = {}

    def __init__(self, a_path: str, b_path: str, max_chunks: int = 200_000, max_ids: int = 2_000_000, lane_chunks: int = 256):
        self.a, self.b = Vocabulary.of(a_path), Vocabulary.of(b_path)
        if max(len(self.a.pieces), len(self.b.pieces)) > 1 << _BITS:
            raise ValueError(f"a vocabulary has over {1 << _BITS} ids")
        self.max_chunks, self.max_ids, self.lane_chunks = max_chunks, max_ids, lane_chunks
        self.names = [f"{i}{end}" for i in range(len(self.a.pieces)) for end in ",|"] + [f"{i}{end}" for i in range(len(self.b.pieces)) for end in ",;"]
        self.forget()

    @classmethod
    def of(cls, a_path: str, b_path: str) -> Aligner:
        """The worker's aligner; a reused Python worker keeps it."""
        if (a_path, b_path) not in cls._kept:
            cls._kept[a_path, b_path] = cls(a_path, b_path)
        return cls._kept[a_path, b_path]

    def forget(self) -> None:
        self.table: dict[str, int] = {}
        self.faithful: list[bool] = []
        self.sides = (_Side(), _Side())

    def _learn(self, chunks: list[str]) -> None:
        found = [v.encode(chunks) for v in (self.a, self.b)]
        for chunk, ai, bi in zip(chunks, *found, strict=True):
            whole = b" " + chunk.encode("utf-8", "surrogatepass")
            self.table[chunk] = len(self.faithful)
            self.faithful.append(all(b"".join(map(v.pieces.__getitem__, ids)) == whole for v, ids in ((self.a, ai), (self.b, bi))))
        for side, ids in zip(self.sides, found, strict=True):
            side.add(ids)

    def _slots(self, chunks: list[str]) -> np.ndarray:
        if missing := set(chunks).difference(self.table):
            self._learn(sorted(missing))
        return np.fromiter(map(self.table.__getitem__, chunks), np.int64, len(chunks))

    def align(self, texts: list[str | None]) -> Aligned:
        if len(self.table) > self.max_chunks or max(s.total for s in self.sides) > self.max_ids:
            self.forget()
        parts = [_CUT.split(t) if t else [] for t in texts]
        slots = self._slots([c for p in parts for c in p])
        faithful = np.array(self.faithful, bool)[slots] if len(slots) else np.zeros(0, bool)
        doc_of = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        if not faithful.all():  # those documents are judged as a whole
            for k in np.unique(doc_of[~faithful]).tolist():
                (slot,) = self._slots([texts[k]]).tolist()
                parts[k] = [texts[k]] if self.faithful[slot] else []
            slots = self._slots([c for p in parts for c in p])
            doc_of = np.repeat(np.arange(len(texts)), [len(p) for p in parts])
        per_doc = np.array([len(p) for p in parts], np.int64)
        first_chunk = np.concatenate([[0], np.cumsum(per_doc)])
        lanes = np.flatnonzero((np.arange(len(slots)) - first_chunk[doc_of]) % self.lane_chunks == 0) if len(slots) else np.zeros(0, np.int64)
        ids, tokens, lane_at, doc_at, ends = [], [], [], [], []
        for side, v in zip(self.sides, (self.a, self.b), strict=True):
            flat, begin, count = side.flat()
            n = count[slots]
            own = flat[ragged(begin[slots], n)] if len(slots) else np.zeros(0, np.int32)
            at = np.concatenate([[0], np.cumsum(n)])
            ids.append(own)
            tokens.append(at)
            lane_at.append(np.append(at[lanes], len(own)))
            doc_at.append(at[first_chunk])
            ends.append(np.cumsum(v.lengths[own]))
        a_cuts, b_cuts = lockstep(*ends, *lane_at)
        return Aligned(*ids, *doc_at, a_cuts, b_cuts, np.searchsorted(a_cuts, doc_at[0], side="right"))

    def digests(self, x: Aligned) -> list[str]:
        """SHA-256 of each document's groups as written; empty for a document without tokens."""
        na, nb = np.diff(x.a_cuts, prepend=0), np.diff(x.b_cuts, prepend=0)
        codes = np.empty(len(x.a_ids) + len(x.b_ids), np.int64)
        last_a, last_b = np.zeros(len(x.a_ids), bool), np.zeros(len(x.b_ids), bool)
        last_a[x.a_cuts - 1] = last_b[x.b_cuts - 1] = True
        codes[np.arange(len(x.a_ids)) + np.repeat(x.b_cuts - nb, na)] = x.a_ids * np.int64(2) + last_a
        codes[np.arange(len(x.b_ids)) + np.repeat(x.a_cuts, nb)] = 2 * len(self.a.pieces) + x.b_ids * np.int64(2) + last_b
        at, out = (x.a_docs + x.b_docs).tolist(), []
        for begin, end in zip(at, at[1:], strict=False):
            text = "".join(map(self.names.__getitem__, codes[begin:end].tolist()))
            out.append(hashlib.sha256(text[:-1].encode()).hexdigest() if text else "")
        return out


def pairs(x: Aligned, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document in the batch, key, times) of the distinct linked pairs of each document, in order.

    Groups are spread out a block of links at a time; of a group with many links, first equal ids are put together.
    """
    na, nb = np.diff(x.a_cuts, prepend=0), np.diff(x.b_cuts, prepend=0)
    docs = np.repeat(np.arange(len(x.groups) - 1), np.diff(x.groups))
    links = na * nb
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(doc: np.ndarray, key: np.ndarray, times: np.ndarray) -> None:
        order = np.lexsort((key, doc))
        doc, key, times = doc[order], key[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])) if len(doc) else np.zeros(0, np.int64)
        found.append((doc[new], key[new], np.add.reduceat(times, new) if len(new) else times))

    small = np.flatnonzero(links <= 4096)
    for own in np.split(small, np.flatnonzero(np.diff(np.cumsum(links[small]) // block)) + 1) if len(small) else []:
        n = links[own]
        step = ragged(np.zeros(len(own), np.int64), n)
        of = np.repeat(own, n)
        a = x.a_ids[(x.a_cuts - na)[of] + step // nb[of]].astype(np.int64)
        b = x.b_ids[(x.b_cuts - nb)[of] + step % nb[of]]
        add(docs[of], a << _BITS | b, np.ones(len(of), np.int64))
    for g in np.flatnonzero(links > 4096).tolist():
        (a, m), (b, n) = (np.unique(ids[cuts[g] - k[g] : cuts[g]], return_counts=True) for ids, cuts, k in ((x.a_ids, x.a_cuts, na), (x.b_ids, x.b_cuts, nb)))
        key = (a.astype(np.int64)[:, None] << _BITS | b[None, :]).ravel()
        add(np.full(len(key), docs[g]), key, (m[:, None] * n[None, :]).ravel())
    if len(found) > 1:
        together = [np.concatenate(c) for c in zip(*found, strict=True)]
        found = []
        add(*together)
    return found[0] if found else (np.zeros(0, np.int64),) * 3


_CODED = "block long, key long, n long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, refs binary, times binary"


def coded_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 2 << 20, block_pairs: int = 1 << 20) -> DataFrame:
    """Rows of two kinds: documents with their figures and places of their pairs (``key`` null), and a block's distinct pairs (``doc_id`` null).

    A block ends at ``block_pairs`` pairs of documents; a longer document is a block of its own.
    """
    bounded_batches(docs.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        aligner, part = Aligner.of(a_path, b_path), TaskContext.get().partitionId()
        kinds = [("block", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("refs", pa.binary()), ("times", pa.binary())]
        schema = pa.schema(kinds)

        def batch_of(size: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(columns[name], kind) if name in columns else pa.nulls(size, kind) for name, kind in kinds], schema=schema)

        held: list[tuple] = []  # figures of a document, its keys and times
        size = blocks = 0

        def close() -> Iterator[pa.RecordBatch]:
            block = part << 33 | blocks
            keys, n = np.unique(np.concatenate([h[-2] for h in held]), return_counts=True)
            columns = list(zip(*(h[:-2] for h in held), strict=True))
            refs = [np.searchsorted(keys, h[-2]).astype("<i4").tobytes() for h in held]
            yield batch_of(len(held), block=[block] * len(held), **dict(zip(("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"), columns, strict=True)), refs=refs, times=[h[-1].astype("<i8").tobytes() if h[-1].max(initial=0) > 0x7FFFFFFF else h[-1].astype("<i4").tobytes() for h in held])
            for k in range(0, len(keys), 100_000):
                own = keys[k : k + 100_000]
                yield batch_of(len(own), block=np.full(len(own), block), key=own, n=n[k : k + 100_000])

        def aligned(ids: list[int | None], texts: list[str | None]) -> None:
            nonlocal size
            x = aligner.align(texts)
            hashes = aligner.digests(x)
            doc, key, times = pairs(x)
            at = np.searchsorted(doc, np.arange(len(texts) + 1))
            links = np.concatenate([[0], np.cumsum(np.diff(x.a_cuts, prepend=0) * np.diff(x.b_cuts, prepend=0))])
            for k, (doc_id, sha) in enumerate(zip(ids, hashes, strict=True)):
                lo, hi = x.groups[k], x.groups[k + 1]
                held.append((doc_id, int(x.a_docs[k + 1] - x.a_docs[k]), int(x.b_docs[k + 1] - x.b_docs[k]), int(hi - lo), int(links[hi] - links[lo]), sha, key[at[k] : at[k + 1]], times[at[k] : at[k + 1]]))
            size += len(key)

        ids, texts, chars = [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                ids.append(doc_id)
                texts.append(text)
                chars += len(text or "")
                if chars > batch_chars or len(ids) >= 4096:
                    aligned(ids, texts)
                    ids, texts, chars = [], [], 0
                    if size > block_pairs:
                        yield from close()
                        held, size, blocks = [], 0, blocks + 1
        if ids:
            aligned(ids, texts)
        if held:
            yield from close()

    rows = docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return rows.mapInArrow(run, _CODED)


def pair_counts(coded: DataFrame) -> DataFrame:
    """(key, a, b, docs, best) of each linked pair: its documents, and whether no pair of its A id has more."""
    counts = written(coded.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("docs")), "pair-counts")
    a = F.shiftright("key", _BITS).alias("a")
    most = counts.groupBy(a).agg(F.max("docs").alias("most"))  # at most as many rows as A has ids
    b = F.col("key").bitwiseAND(F.lit((1 << _BITS) - 1)).alias("b")
    return counts.select("key", a, b, "docs").join(F.broadcast(most), "a").select("key", "a", "b", "docs", (F.col("docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, **names) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) and the corpus' pairs (key, a, b, docs, best)."""
    coded = written(coded_blocks(docs, a_path, b_path, **names), "coded")
    counts = pair_counts(coded)
    known = coded.where("key IS NOT NULL").select("block", "key").join(counts.select("key", "docs", "best"), "key").select(F.col("block").alias("of_block"), "key", "docs", "best")
    figures = coded.where("key IS NULL").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "refs", "times")
    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def summed(left, right):
        import pyarrow as pa

        order = np.argsort(right.column("key").to_numpy())
        docs_of, best_of = right.column("docs").to_numpy()[order], right.column("best").to_numpy(zero_copy_only=False)[order]
        best, total = [], []
        for refs, times in zip(left.column("refs").to_pylist(), left.column("times").to_pylist(), strict=True):
            at = np.frombuffer(refs, "<i4")
            n = np.frombuffer(times, "<i4" if len(times) == len(refs) else "<i8").astype(np.int64)
            best.append(int(n[best_of[at]].sum()))
            total.append(int((n * docs_of[at]).sum()))
        columns = {c: left.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
        return pa.table(columns | {"n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64()), "groups_sha256": left.column("groups_sha256")})

    found = figures.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(summed, out)
    return found, counts
