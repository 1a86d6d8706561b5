"""Language ID by unigram models whose score sums over all segmentations of the text.

The pieces are those of a fixed public vocabulary; only their probabilities are learned, per language, by
expectation maximisation on a bounded sample.  A forward pass over a word adds up the probabilities of all
its segmentations; pieces never cross a word's end, so a text's likelihood is the product over its words, and
a worker keeps the scores of words that it has met.

A word is a run of lower-cased letters; a run over 64 letters is cut there, so a pass is bounded.

Defined results: ``und`` with score 0 if the text is null or has no letter, or if nothing could be learned;
ties go to the language first in alphabetical order; a very long text costs in proportion to its words; repeated rows each get their result; an empty table gives
no row; other columns are not read.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, bounded_batches

LONGEST = 64
_WORD = re.compile(r"[^\W\d_]{1,%d}" % LONGEST)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNKNOWN = 1e-7


def words(text: str | None) -> list[str]:
    """Runs of lower-cased letters; numerals other than digits aren't letters."""
    found = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in "".join(c if c.isalpha() else " " for c in w).split()]


@cache
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted hashes, piece of each, longest) of the pieces that are letters, a word's start counting as one."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(k).lower() for k in range(model.get_piece_size())}
    pieces = sorted(p for p in pieces if (p.lstrip("▁").isalpha() and "▁" not in p[1:] or p == "▁"))
    keys = np.zeros(len(pieces), np.uint64)
    for k, p in enumerate(pieces):
        h = np.uint64(0)
        for c in p:
            with np.errstate(over="ignore"):
                h = h * _BASE + np.uint64(ord(c))
        keys[k] = h
    order = np.argsort(keys)
    return keys[order], order, max(map(len, pieces))


class Lattice:
    """All pieces of a batch of words of like length: for each end, (words, begin, piece)."""

    def __init__(self, batch: list[str], path: str):
        keys, piece, longest = vocabulary(path)
        size = max(map(len, batch)) + 1
        self.n, self.size, self.unknown = len(batch), size, len(keys)
        self.length = np.array([len(w) + 1 for w in batch])
        chars = np.array(["▁" + w for w in batch], dtype=f"U{size}").view(np.uint32).reshape(len(batch), size).astype(np.uint64)
        prefix = np.zeros((size + 1, len(batch)), np.uint64)
        for i in range(size):
            prefix[i + 1] = prefix[i] * _BASE + chars[:, i]
        power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(longest, _BASE, np.uint64)]), dtype=np.uint64)
        self.steps: list[list[tuple[int, np.ndarray, np.ndarray]]] = []
        for i in range(1, size + 1):
            live = np.flatnonzero(self.length >= i)
            step = []
            for l in range(1, min(longest, i) + 1):
                h = prefix[i][live] - prefix[i - l][live] * power[l]
                k = np.searchsorted(keys, h)
                k[k == len(keys)] = 0
                hit = keys[k] == h
                ids = piece[k]
                if l == 1:  # a character that is no piece is one all the same
                    ids = np.where(hit, ids, self.unknown)
                    step.append((i - l, live, ids))
                elif hit.any():
                    step.append((i - l, live[hit], ids[hit]))
            self.steps.append(step)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """(place, word, language) sums over all segmentations up to a place."""
        alpha = np.zeros((self.size + 1, self.n, p.shape[1]))
        alpha[0] = 1
        for i, step in enumerate(self.steps, 1):
            for j, who, ids in step:
                alpha[i, who] += alpha[j, who] * p[ids]
        return alpha

    def expected(self, p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Expected number of each piece in each language; ``times``: how often a word stands there."""
        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        beta[self.length, np.arange(self.n)] = 1
        total = alpha[self.length, np.arange(self.n)]
        share = np.where(total > 0, times / np.where(total > 0, total, 1), 0)
        out = np.zeros_like(p)
        for i in range(self.size, 0, -1):
            for j, who, ids in self.steps[i - 1]:
                back = beta[i, who] * p[ids]
                beta[j, who] += back
                np.add.at(out, ids, alpha[j, who] * back * share[who])
        return out


def _by_length(batch: list[str]):
    """Places of words, by like length."""
    size = np.array([len(w) for w in batch])
    for low, high in ((0, 8), (8, 14), (14, 24), (24, LONGEST)):
        where = np.flatnonzero((size > low) & (size <= high))
        for k in range(0, len(where), 4096):
            yield where[k : k + 4096]


def fit(counts: dict[str, dict[str, int]], path: str, rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities of pieces by language) from counts of words by language."""
    languages = sorted(counts)
    batch = sorted(set().union(*counts.values()))
    times = np.array([[counts[x].get(w, 0) for x in languages] for w in batch], float).reshape(len(batch), len(languages))
    keys, _, _ = vocabulary(path)
    p = np.full((len(keys) + 1, len(languages)), 1 / len(keys))
    lattices = [(Lattice([batch[k] for k in where], path), times[where]) for where in _by_length(batch)]
    for _ in range(rounds):
        seen = sum(lattice.expected(p, n) for lattice, n in lattices)
        seen[-1] = 0
        seen += 0.01
        p = seen / seen.sum(axis=0)
        p[-1] = _UNKNOWN
    return languages, p


class Scorer:
    """Adds up log likelihoods of words by language; keeps at most ``most`` words."""

    def __init__(self, path: str, p: np.ndarray, most: int = 400_000):
        self.path, self.p, self.most = path, p, most
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, p.shape[1]))

    def _learn(self, new: list[str]) -> None:
        begin = len(self.place)
        while len(self.rows) < begin + len(new):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for where in _by_length(new):
            lattice = Lattice([new[k] for k in where], self.path)
            total = lattice.forward(self.p)[lattice.length, np.arange(lattice.n)]
            self.rows[begin + where] = np.log(np.maximum(total, 1e-300))
        self.place.update(zip(new, range(begin, begin + len(new)), strict=True))

    def score(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Log likelihood by language of each text; null if it has no letter."""
        out: list[np.ndarray | None] = []
        for k in range(0, len(texts), 200):
            each = [words(x) for x in texts[k : k + 200]]
            if len(self.place) > self.most:
                self.place = {}
            if new := set().union(*each).difference(self.place):
                self._learn(sorted(new))
            out += [self.rows[list(map(self.place.__getitem__, x))].sum(axis=0) if x else None for x in each]
        return out


def fit_on(docs: DataFrame, allowed: Column, tokenizer: str, sample_docs: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"):
    """Fit on about ``sample_docs`` whole documents of each language, taken by hash of the id among ``allowed``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.where(allowed & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row a language
    if not sizes:
        return [], np.zeros((1, 0))
    share = F.create_map(*(x for k, n in sorted(sizes.items()) for x in (F.lit(k), F.lit(min(1.0, sample_docs / n)))))
    taken = rows.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(5)), F.lit(1 << 20)) < F.element_at(share, F.col(lang_col)) * (1 << 20))

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        found: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found.update((lang, w) for w in words(text))
        yield pa.RecordBatch.from_pydict({"lang": [k[0] for k in found], "word": [k[1] for k in found], "n": list(found.values())}, schema=pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())]))

    counts: dict[str, dict[str, int]] = {}
    pairs = taken.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, word string, n long")
    for r in pairs.groupBy("lang", "word").agg(F.sum("n").alias("n")).toLocalIterator():  # the sample's words
        counts.setdefault(r[0], {})[r[1]] = r[2]
    return fit(counts, tokenizer) if counts else ([], np.zeros((1, 0)))


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], tokenizer: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` with the predicted language and its score, the best language's share of the likelihood; ``names``
    names these two, as no column of ``keep`` may be called so."""
    languages, p = model
    shared = docs.sparkSession.sparkContext.broadcast(p.astype(np.float32))  # vocabulary x languages
    kept: list[Scorer] = []

    def run(texts):
        if not kept:
            kept.append(Scorer(tokenizer, shared.value.astype(float)))
        pred, score = [], []
        for x in kept[0].score(texts) if languages else [None] * len(texts):
            if x is None:
                pred.append("und")
                score.append(0.0)
            else:
                best = int(x.argmax())
                pred.append(languages[best])
                score.append(float(1 / np.exp(x - x[best]).sum()))
        return pred, score

    return attach(docs, F.col(text_col), keep, f"`{names[0]}` string, `{names[1]}` double", run)
