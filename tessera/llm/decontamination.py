"""Benchmark decontamination by the q-gram lemma over diagonal bands, verified by banded alignment.

Texts are lower-cased and every run of other characters becomes one space.  An item of length L that lies
in a document with at most e = floor(rate x L) edits shares at least L + 1 - q (e + 1) q-grams with it, all on
diagonals (place in document less place in item) within e of each other.  So hits of an item are counted
in bands of diagonals 2 (e + 1) wide that overlap by half; a band below the bound can't hold the item; each other
band is aligned, within the band, and counts if the item takes at most e edits.

Items go to the tasks in shards of about ``shard_bytes``, each a pass over the documents that ends before the next begins, so neither
the driver nor a task ever holds more of the benchmark; there is no shuffle.

Items for which the lemma's bound is below 1 (normalised length 10-15, 20-23, 30-31 at 10 %) are cut into e + 1 parts,
one of which e edits leave whole: each place of a part in the document is aligned, within e diagonals.

Defined results: a null or empty text and a null or empty item match nothing; items shorter than a q-gram that
have no edits are sought as whole words; repeated rows each get their result; a very long text is searched whole, in time proportional to it; ties take the least
item_id; an empty benchmark leaves all documents clean; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, written

Q = 8  #: bytes of a q-gram, so that it is one 64-bit number
_CLEAN = np.full(256, 32, np.uint8)
for _a, _b in ((48, 58), (97, 123), (128, 256)):
    _CLEAN[_a:_b] = np.arange(_a, _b)
_SLOT_BITS = 22


def normalise(text: str | None) -> np.ndarray:
    """Bytes of the lower-cased text; each run of ASCII characters that aren't letters or digits is one space."""
    b = _CLEAN[np.frombuffer(f" {text or ''} ".lower().encode("utf-8", "surrogatepass"), np.uint8)]
    space = b == 32
    return b[~(space & np.concatenate([[False], space[:-1]]))]


def q_grams(b: np.ndarray) -> np.ndarray:
    """The q-gram at each place, as a number."""
    n = len(b) - Q + 1
    out = np.empty(max(n, 0), np.uint64)
    for k in range(min(Q, max(n, 0))):
        part = b[k : k + (n - k + Q - 1) // Q * Q]
        out[k::Q] = np.ascontiguousarray(part[: len(out[k::Q]) * Q]).view("<u8")
    return out


def banded_distance(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int]:
    """Least edits of the whole item against any run of ``text`` on diagonals low..high, and where that run ends.

    Stops with ``most`` + 1 once no run can do better.
    """
    at = np.arange(high - low + 1, dtype=np.int32)
    big = len(item) + len(text) + 1
    before, after = max(0, -low), max(0, high + len(item) - len(text))
    beside = np.concatenate([np.zeros(before, np.uint8), text, np.zeros(after, np.uint8)])[low + before :]  # zero meets nothing
    inside = np.concatenate([np.full(before, big, np.int32), np.zeros(len(text) + 1, np.int32), np.full(after, big, np.int32)])[low + before :]
    n = len(at)
    row = inside[:n].copy()
    for i, c in enumerate(item.tolist()):
        step = row + (beside[i : i + n] != c)
        np.minimum(step[:-1], row[1:] + 1, out=step[:-1])
        step += inside[i + 1 : i + 1 + n]
        row = np.minimum.accumulate(step - at) + at
        if row.min() > most:
            return most + 1, 0
    best = int(row.argmin())
    return int(row[best]), best + low + len(item)


def _align(item: np.ndarray, b: np.ndarray, low: int, high: int, most: int) -> tuple[int, int]:
    """(edits, end in ``b``) of the item on diagonals low..high of ``b``."""
    from_, to = max(0, low), min(len(b), high + len(item))
    region = b[from_:to]
    exact = region.tobytes().find(item.tobytes())
    edits, end = (0, exact + len(item)) if exact >= 0 else banded_distance(item, region, low - from_, high - from_, most)
    return edits, from_ + end


class Items:
    """Benchmark items ready for search."""

    def __init__(self, items: list[tuple[int, str | None]], rate: float):
        self.ids, self.text, self.most, self.need, self.whole, self.short = [], [], [], [], [], []
        for item_id, text in sorted((x for x in items if x[0] is not None), key=lambda x: x[0]):
            b = normalise(text)[1:-1]
            if not len(b):
                continue
            most = int(rate * len(b))
            need = len(b) + 1 - Q * (most + 1)
            if need < 1 and most:  # the lemma says nothing
                cuts = [len(b) * k // (most + 1) for k in range(most + 2)]
                self.short.append((item_id, b, most, [(x, b[x:y].tobytes()) for x, y in zip(cuts, cuts[1:], strict=False)]))
                continue
            if need < 1:  # shorter than a q-gram
                self.whole.append((item_id, b.tobytes()))
                continue
            self.ids.append(item_id)
            self.text.append(b)
            self.most.append(most)
            self.need.append(max(1, need // -(-len(b) // (1 << 17))))  # places are counted modulo 2^17
        self.need, self.most = np.array(self.need, np.int64), np.array(self.most, np.int64)
        grams = [q_grams(b) for b in self.text]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.key, first = np.unique(flat[order], return_index=True)
        self.cut = np.append(first, len(flat))
        self.item = np.repeat(np.arange(len(grams)), [len(x) for x in grams])[order]
        self.place = np.concatenate([np.arange(len(x)) for x in grams])[order] if grams else np.zeros(0, np.int64)
        self.slots = np.zeros(1 << _SLOT_BITS, bool)
        self.slots[self._slot(self.key)] = True

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _SLOT_BITS)

    def _search_short(self, b: np.ndarray, raw: bytes) -> list[tuple[int, int, int, int]]:
        out = []
        for item_id, item, most, parts in self.short:
            diagonals = set()
            for own, part in parts:
                at = raw.find(part)
                while at >= 0:
                    diagonals.add(at - own)
                    at = raw.find(part, at + 1)
            bands: list[list[int]] = []
            for d in sorted(diagonals):  # those that overlap are aligned at once
                if bands and d - most <= bands[-1][1]:
                    bands[-1][1] = d + most
                else:
                    bands.append([d - most, d + most])
            found = min((_align(item, b, low, high, most) for low, high in bands), default=(most + 1, 0))
            if found[0] <= most:
                out.append((item_id, found[0], max(0, found[1] - len(item)), found[1]))
        return out

    def search(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, begin, end) of each item found, by id; places are bytes of the normalised text."""
        if not text:
            return []
        b = normalise(text)
        raw = b.tobytes() if self.whole or self.short else b""
        out = [(i, 0, raw.find(b" " + w + b" ") + 1, raw.find(b" " + w + b" ") + 1 + len(w)) for i, w in self.whole if b" " + w + b" " in raw]
        out += self._search_short(b, raw)
        gram = q_grams(b)
        at = np.flatnonzero(self.slots[self._slot(gram)])
        if len(at) and len(self.key):
            k = np.searchsorted(self.key, gram[at])
            k[k == len(self.key)] = 0
            same = self.key[k] == gram[at]
            at, k = at[same], k[same]
        if not len(at) or not len(self.key):
            return sorted(out)
        times = self.cut[k + 1] - self.cut[k]
        post = np.repeat(self.cut[k] - np.cumsum(times) + times, times) + np.arange(times.sum())
        item, own = self.item[post], self.place[post]
        band = (np.repeat(at, times) - own) // (self.most[item] + 1)
        # an item's q-gram counts once in each band: (item, band, place in item) as one number
        key = np.unique(np.concatenate([(item << 48) + ((b + (1 << 30)) << 17) + (own & ((1 << 17) - 1)) for b in (band, band - 1)]))
        bands, count = np.unique(key >> 17, return_counts=True)
        bands = bands[count >= self.need[bands >> 31]]
        best: dict[int, tuple[int, int, int]] = {}
        for x, y in zip((bands >> 31).tolist(), ((bands & ((1 << 31) - 1)) - (1 << 30)).tolist(), strict=True):
            if x in best and not best[x][0]:
                continue
            most, size = int(self.most[x]), len(self.text[x])
            edits, end = _align(self.text[x], b, y * (most + 1) - most, (y + 2) * (most + 1) + most, most)
            if edits <= most and (x not in best or (edits, end) < (best[x][0], best[x][2])):
                best[x] = (edits, max(0, end - size), end)
        return sorted(out + [(self.ids[x], *v) for x, v in best.items()])


def _shards(benchmark: DataFrame, shard_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in pieces of bounded size; the driver holds one piece at a time."""
    shard, size = [], 0
    for r in benchmark.toLocalIterator():
        shard.append((r[0], r[1]))
        size += 4 * len(r[1] or "") + 64
        if size >= shard_bytes or len(shard) >= 1 << 14:
            yield shard
            shard, size = [], 0
    if shard:
        yield shard


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, shard_bytes: int = 8 << 20,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: bool = False,
) -> DataFrame:
    """One row a document: doc_id and, by item_id, the items found, their edits and places.

    ``rate`` is the edit budget as a share of an item's characters.  With ``keep`` the rows are instead those of ``docs``,
    all columns, that hold no item.
    """
    bounded_batches(docs.sparkSession)
    shards = _shards(benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col).cast("string")), shard_bytes)

    def passes(table: DataFrame, search) -> DataFrame:
        """One pass over ``table`` a shard; what one found is written before the next, so a task holds one shard."""
        shard = next(shards, [])
        for following in shards:
            table, shard = written(table.mapInArrow(search(shard), table.schema), "searched"), following
        return table.mapInArrow(search(shard), table.schema)

    def clean(shard):
        def run(batches):
            import pyarrow as pa

            items = Items(shard, rate)
            for batch in batches:
                yield batch.filter(pa.array([not items.search(x) for x in batch.column(at).to_pylist()], pa.bool_()))

        return run

    if keep:  # columns go by their place, whatever their names
        at = [c.lower() for c in docs.columns].index(text_col.lower())
        return passes(docs.toDF(*(f"c{k}" for k in range(len(docs.columns)))), clean).toDF(*docs.columns)

    def more(shard):
        def run(batches):
            import pyarrow as pa

            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            items = Items(shard, rate)
            for batch in batches:
                before = [c.to_pylist() for c in batch.columns[2:]]
                found = [sorted([*zip(*row[:-1], strict=True), *items.search(row[-1])]) for row in zip(*before, batch.column(1).to_pylist(), strict=True)]
                columns = [pa.array([[r[k] for r in x] for x in found], pa.list_(kind)) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=batch.schema.names)

        return run

    empty = [F.array().cast(f"array<{k}>").alias(n) for n, k in (("item_ids", "long"), ("edits", "int"), ("begins", "long"), ("ends", "long"))]
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *empty)
    return passes(found, more).drop("text")
