"""Toxicity by compression distance: how much shorter windows get under a zstandard dictionary of toxic text.

1. A bounded sample of labelled documents is cut into windows, a word with a space on either side.  Near copies of a
   document count once as evidence.
2. Two dictionaries are made.  The ordinary one is what zstandard's trainer picks from the windows of ordinary documents, after their
   commonest fragments of 2 to 5 letters.  The toxic one is made of those beginnings of toxic documents' windows that toxic documents have far
   more often, as the rest of a toxic document is ordinary text; its compressor has it in front of the ordinary one: without
   that, lengths differ by chance at every word that one of the trainings missed.  The ends of these beginnings are among the ordinary
   fragments, so that words that only end alike gain little.
3. Each window is compressed with both; what counts are the share of its ordinary length and the bytes that the toxic dictionary saves.  Zstandard
   counts whole bytes, too coarse for so short a window, so each byte is spread to four and a filler that both dictionaries know ends it.
4. A logistic threshold on how many windows gain how much is calibrated on documents of folds that the dictionaries
   did not see; the dictionaries that score are made from all folds.

Defined results: a null or empty text has no window and gets the score of that; a window is at most 64 characters, longer words
are cut, so a very long text costs in proportion; without labels of both kinds every score is 0; repeated rows each get
their result; an empty table gives no row; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded_batches
from .shingles import minhashes, shingles

_WORD = re.compile(r"\w{1,64}")
_SHARES, _BYTES = (4, 5, 6, 7, 9, 11), (2, 3, 4, 5, 7)  #: gains in twentieths of a window's ordinary length, and in bytes, that the threshold looks at
_FOLDS = 3
_codes = np.random.default_rng(1).integers(0, 256, (256, 4), np.uint8)
_filler = np.random.default_rng(2).integers(0, 256, 64, np.uint8).tobytes()


def windows(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def spread(text: str) -> bytes:
    return _codes[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes()


def _unlike(sample: list[tuple[str, int]]) -> list[list[str] | None]:
    """Distinct windows of each document; null where a near copy stands before it, as copies would pass for evidence."""
    seen, out = set(), []
    for text, _ in sample:
        marks = shingles(text, 3)
        keys = set(enumerate(minhashes([marks], 24)[0].tolist())) if len(marks) else set()
        out.append(sorted({sys.intern(w) for w in windows(text)}) if len(keys & seen) < 3 else None)
        seen |= keys
    return out


def _beginnings(window: str) -> list[str]:
    return [f" {window[:n]}" for n in range(3, min(13, len(window) + 1))] + [f" {window} "]


def toxic_beginnings(toxic: list[list[str]], ordinary: list[list[str]], least: int, ratio: float) -> Counter:
    """Of each window of a toxic document, its most telling beginning, if it has any.

    One tells if at least ``least`` toxic documents and one in a hundred have it, ``ratio`` times their share of ordinary ones.
    """
    found, other = Counter(), Counter()
    for each in toxic:
        found.update({g for w in each for g in _beginnings(w)})
    found = {g: a for g, a in found.items() if a >= max(least, len(toxic) / 100) and len(g.strip()) >= 3}
    for each in ordinary:
        other.update({g for w in each for g in _beginnings(w) if g in found})
    n, m = len(toxic), len(ordinary)
    weight = {g: a * math.log((a + 0.5) / (n + 1) * (m + 1) / (other[g] + 0.5)) for g, a in found.items() if a * m > ratio * n * (other[g] + 0.5)}
    best = (max((g for g in _beginnings(w) if g in weight), key=lambda g: (weight[g], g), default=None) for each in toxic for w in each)
    return Counter(g for g in best if g)


def train_dictionaries(toxic: list[list[str]], ordinary: list[list[str]], least: int = 4, ratio: float = 30.0, size: int = 1 << 15, fragments: int = 4000) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents from documents' windows; the toxic one ends with the ordinary one.

    A window counts eight times at most in training, or a few common words would drown the others.
    """
    import zstandard as z

    marks = toxic_beginnings(toxic, ordinary, least, ratio)
    whole, parts = Counter(w for each in ordinary for w in each), Counter()
    for w, n in whole.items():
        for width in (2, 3, 4, 5):
            for k in range(len(w) - width + 1):
                parts[w[k : k + width]] += n
    common = sorted(parts, key=lambda x: (-parts[x], x))[:fragments]
    samples = [spread(f" {w} ") + _filler[:8] for w, n in sorted(whole.items()) for _ in range(min(8, n))]
    try:
        trained = z.train_dictionary(size, samples, k=128, d=8).as_bytes()
    except z.ZstdError:  # too few windows to train on: they are the content themselves
        trained = b"".join(samples)[-size:]
    # zstandard wants the likeliest content at the end
    plain = spread(" " + " ".join([*reversed(common), *(g[2:] for g in sorted(marks))]) + " ") + trained + _filler
    return plain, b"".join(spread(g) for g in sorted(marks, key=lambda g: (marks[g], g))) + plain


class Distance:
    """By how much the toxic dictionary shortens each window.

    Two tables of at most ``most`` windows: a full one becomes the older, and what is still in use moves back.
    """

    def __init__(self, ordinary: bytes, toxic: bytes, most: int = 100_000):
        import zstandard as z

        def compressor(content: bytes):
            how = z.ZstdCompressionParameters(
                format=z.FORMAT_ZSTD1_MAGICLESS, window_log=20, hash_log=17, chain_log=18, search_log=7, min_match=4, target_length=64,
                strategy=z.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False,
            )
            return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how)

        self.ordinary, self.toxic, self.most = compressor(ordinary), compressor(toxic), most
        self.least = len(self.ordinary.compress(_filler))
        self.table: dict[str, int] = {}
        self.older: dict[str, int] = {}

    def gain(self, window: str) -> int:
        """How much the toxic dictionary shortens the window: twentieths of its ordinary length, times 16, plus bytes up to 15."""
        x = spread(f" {window} ") + _filler
        ordinary = len(self.ordinary.compress(x))
        saved = max(0, ordinary - len(self.toxic.compress(x)))
        return 16 * min(20, 20 * saved // max(1, ordinary - self.least)) + min(15, saved)

    def steps(self, text: str | None) -> tuple[np.ndarray, int]:
        """(how many windows gain at least each step, how many windows)."""
        each = windows(text)
        for w in set(each).difference(self.table):
            found = self.older.get(w)
            self.table[w] = self.gain(w) if found is None else found
        gain = np.bincount(np.fromiter(map(self.table.__getitem__, each), np.int64, len(each)), minlength=21 * 16).reshape(21, 16)
        if len(self.table) > self.most:
            self.older, self.table = self.table, {}
        reached = lambda counts, steps: counts[::-1].cumsum()[::-1][list(steps)]
        return np.concatenate([reached(gain.sum(axis=1), _SHARES), reached(gain.sum(axis=0), _BYTES)]), max(1, len(each))


@cache
def _kept(ordinary: bytes, toxic: bytes) -> Distance:
    """A worker's tables last for as many tasks as it runs; one pair of dictionaries at a time."""
    return Distance(ordinary, toxic)


def _features(steps: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([[1, math.log(n)], np.log1p(steps), np.log((steps + 0.3) / (n + 30))])


class Model:
    """Dictionaries and the calibrated threshold; small enough to go with a task."""

    def __init__(self, sample: list[tuple[str, int]]):
        self.fitted = len({label for _, label in sample}) == 2
        if not self.fitted:
            return
        rows = _unlike(sample)

        def train(fold=None):
            known = [(w, label) for k, (w, (_, label)) in enumerate(zip(rows, sample, strict=True)) if w is not None and k % _FOLDS != fold]
            return train_dictionaries([w for w, label in known if label], [w for w, label in known if not label])

        self.ordinary, self.toxic = train()
        x, y = [], []
        for fold in range(_FOLDS):
            distance = Distance(*train(fold))
            for text, label in sample[fold::_FOLDS]:
                x.append(_features(*distance.steps(text)))
                y.append(float(label))
        x, y = np.array(x), np.array(y)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        self.mean[0], self.scale[0] = 0, 1
        x = (x - self.mean) / self.scale
        self.weights = np.zeros(x.shape[1])
        for _ in range(30):  # Newton's method, ridge 0.5
            p = 1 / (1 + np.exp(-x @ self.weights))
            self.weights -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(x.shape[1]), x.T @ (p - y) + 0.5 * self.weights)

    def scores(self, texts: list[str | None]) -> list[float]:
        if not self.fitted or not texts:
            return [0.0] * len(texts)
        if _kept.cache_info().currsize > 1:
            _kept.cache_clear()
        distance = _kept(self.ordinary, self.toxic)
        rows = np.array([_features(*distance.steps(t)) for t in texts])
        return (1 / (1 + np.exp(-((rows - self.mean) / self.scale) @ self.weights))).tolist()


def fit_on(docs: DataFrame, labels: DataFrame, allowed: Column, sample_docs: int = 2000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on about ``sample_docs`` whole documents of each label, taken by hash of the id among ``allowed``."""
    bounded_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label")).where(allowed)
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}  # two rows
    if len(sizes) < 2:
        return Model([])
    share = F.when(F.col("label") == 1, min(1.0, sample_docs / sizes[1])).otherwise(min(1.0, sample_docs / sizes[0]))
    taken = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(9)), F.lit(1 << 20)) < share * (1 << 20))
    # the sample is bounded by sample_docs, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(taken.withColumnRenamed(id_col, "id")), "id").select("id", "text", "label")
    sample = sorted((r[0], r[1] or "", r[2]) for r in rows.collect())
    return Model([(text, label) for _, text, label in sample])


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """Columns ``keep`` with a score of 0 to 1, called ``name``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of some ten kB
    return attach(docs, F.col(text_col), keep, f"`{name}` double", lambda texts: [shared.value.scores(texts)])
