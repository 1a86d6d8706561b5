"""Lexical retrieval packing: documents that share rare terms land in one window.

1. Documents are encoded once and their ids written.  Document frequencies and the mean length are counted over all of them.
2. Documents that are alike are brought together wherever they lie in the input: a tree of two-means splits over projected
   BM25 vectors, fitted on a bounded sample, gives each document a leaf; inside a leaf documents follow one another
   by weighted MinHashes of their terms.  Rows are dealt in ranges of this order, ids of documents last, so a large
   group of copies is cut like any other rows.
3. Each task cuts its range into blocks of at most ``block_tokens`` ids and ``block_docs`` documents and keeps
   a BM25 inverted index of one block, a shard, in memory, with frequencies and mean length of the whole
   corpus.  A seed document takes its rarest terms to the index, and its other terms when these find no more; unused neighbours
   fill its window in order of score; the one that overruns is cut, and its rest is the next seed.  A block's last,
   partly filled window is cut at powers of two, which need no padding.

Neighbours that the order sends to other shards are lost; the README has the recall against an index of the whole corpus.

Defined results: a null or empty text has only the end id; repeated rows are packed as often as they
come; ties in score go to the earlier row of a shard; an empty table gives no row; a null doc_id stays null; other
columns of the input are not read.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discarded, written
from .tokens import ChunkEncoder

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seed_doc_id long"


#: Of the order's sample, projection and tree: documents learned from, numbers a document, least documents a leaf, MinHashes.
SAMPLE, DIMENSIONS, LEAST_LEAF, HASHES = 1 << 15, 128, 16, 3


class Corpus:
    """Statistics of all documents: how many hold each term, how many there are and their mean length."""

    def __init__(self, df, docs: int, mean: float, k1: float = 1.2, b: float = 0.75):
        import numpy as np

        self.df, self.docs, self.mean, self.k1, self.b = df, docs, mean, k1, b
        self.idf = np.log1p((docs - df + 0.5) / (df + 0.5))

    def weight(self, term, tf, length):
        """BM25 weights of terms in documents of these lengths."""
        return self.idf[term] * tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))


class Bm25Shard:
    """Inverted index of one block.  ``ids``: little-endian unsigned 32-bit ids of each document.

    Without ``corpus`` the block is the corpus.
    """

    def __init__(self, ids: list[bytes], query_terms: int = 12, corpus: Corpus | None = None):
        import numpy as np

        self.np, self.query_terms = np, query_terms
        each = [np.unique(np.frombuffer(x, "<u4"), return_counts=True) for x in ids]  # a block's largest array: the narrowest types serve
        self.begin = np.cumsum([0] + [len(t) for t, _ in each])
        term = np.concatenate([t for t, _ in each]).astype(np.int32)
        tf = np.concatenate([c for _, c in each]).astype(np.float32)  # whole numbers
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(self.begin))
        length = np.array([len(x) // 4 for x in ids], np.float64)
        self.count = np.bincount(term)
        corpus = corpus or Corpus(self.count, len(ids), length.mean())
        self.df = corpus.df
        weight = corpus.weight(term, tf, length[doc])
        order = np.argsort(term, kind="stable")
        self.term, self.doc, self.weight = term, doc[order], weight[order]
        self.post = np.concatenate([[0], np.cumsum(self.count)])
        self.free = np.ones(len(ids), bool)

    def neighbours(self, seed: int, rest: bool = False):
        """Unused documents that share a query term with ``seed``, the best first, ties by row; ``rest``: by its other terms."""
        np = self.np
        terms = self.term[self.begin[seed] : self.begin[seed + 1]]
        terms = terms[self.count[terms] > 1]
        if len(terms) > self.query_terms:
            order = np.argpartition(self.df[terms], self.query_terms)
            terms = terms[order[self.query_terms :] if rest else order[: self.query_terms]]
        elif rest:
            return ()
        if not len(terms):
            return ()
        spans = [slice(self.post[t], self.post[t + 1]) for t in terms]
        score = np.bincount(np.concatenate([self.doc[s] for s in spans]), np.concatenate([self.weight[s] for s in spans]), len(self.free))
        found = np.flatnonzero((score > 0) & self.free)
        return found[np.argsort(-score[found], kind="stable")]

    def ranked(self, seed: int):
        """Neighbours by the rarest terms, then, once they are used up, those by the others."""
        yield from self.neighbours(seed)
        yield from self.neighbours(seed, rest=True)


def _terms(ids: list[bytes]):
    """(where each document's terms begin, term, how often) by one sort of a batch's ids instead of one a document."""
    import numpy as np

    sizes = np.array([len(x) // 4 for x in ids], np.int64)
    key = np.frombuffer(b"".join(ids), "<u4") | np.repeat(np.arange(len(ids), dtype=np.int64) << 32, sizes)
    key, tf = np.unique(key, return_counts=True)
    return np.searchsorted(key, np.arange(len(ids) + 1) << 32), key & 0xFFFFFFFF, tf


class Order:
    """Where a document stands among those like it: a leaf of the tree, then terms drawn by weighted MinHash."""

    def __init__(self, corpus: Corpus):
        import numpy as np

        rng = np.random.default_rng(7)
        self.np, self.corpus = np, corpus
        self.sign = (rng.integers(0, 2, (len(corpus.df), DIMENSIONS), np.int8) * 2 - 1).astype(np.float32)
        self.idf = corpus.idf.astype(np.float32)
        self.draw = -np.log1p(-rng.random((len(corpus.df), HASHES), np.float32))

    def places(self, ids: list[bytes]):
        """(unit vector or zero, MinHash terms or -1) of each document."""
        np, corpus = self.np, self.corpus
        x, drawn = np.zeros((len(ids), DIMENSIONS), np.float32), np.full((len(ids), HASHES), -1, np.int32)
        begin, terms, tfs = _terms(ids)
        shared = corpus.df[terms] > 1
        begin = np.concatenate([[0], np.cumsum(shared)])[begin]
        terms, tfs = terms[shared], tfs[shared]
        length = np.repeat([len(x) // 4 for x in ids], np.diff(begin))
        weights = corpus.weight(terms, tfs, length).astype(np.float32)
        sums = weights * self.idf[terms]
        for k, (lo, hi) in enumerate(zip(begin.tolist(), begin[1:].tolist(), strict=False)):
            if lo < hi:
                term = terms[lo:hi]
                x[k] = sums[lo:hi] @ self.sign[term]
                drawn[k] = term[np.argmin(self.draw[term] / weights[lo:hi, None], axis=0)]
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=x, where=norm > 0), drawn


def _grow(x, least: int, rounds: int = 10):
    """A tree of two-means splits: (direction, left, right), a leaf is None."""
    import numpy as np

    nodes, work = [], [(np.arange(len(x)), None, 0)]
    while work:
        own, parent, side = work.pop()
        if parent is not None:
            nodes[parent][side] = len(nodes)
        nodes.append([None, -1, -1])
        if len(own) <= least:
            continue
        rows, at = x[own], len(nodes) - 1
        a = rows[0]
        b = rows[int((rows @ a).argmin())]
        for _ in range(rounds):
            left = rows @ (a - b) > 0
            if left.all() or not left.any():
                break
            a, b = (v / (np.linalg.norm(v) + 1e-9) for v in (rows[left].mean(0), rows[~left].mean(0)))
        left = rows @ (a - b) > 0
        if left.all() or not left.any():
            continue
        nodes[at][0] = a - b
        work += [(own[~left], at, 2), (own[left], at, 1)]
    return nodes


def _leaves(nodes, x):
    """Each row's leaf; nodes lie in depth-first order, so near numbers are near leaves."""
    import numpy as np

    out, work = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
    while work:
        at, own = work.pop()
        direction, left, right = nodes[at]
        if direction is None or not len(own):
            out[own] = at
            continue
        side = x[own] @ direction > 0
        work += [(left, own[side]), (right, own[~side])]
    return out


def _pieces(ids: list[bytes], window: int, first: int, **bm25):
    """(document, start, length, sequence, offset, seed) of one block; sequences are numbered from ``first``."""
    shard = Bm25Shard(ids, **bm25)
    sizes = [len(x) // 4 for x in ids]
    out, waiting, filled, sequence = [], [], 0, first
    doc, at, next_doc, near, seed = None, 0, 0, iter(()), None
    left = sum(sizes)
    while left:
        if doc is None:
            doc = next((int(n) for n in near if shard.free[n]), None)
            if doc is None:
                while not shard.free[next_doc]:
                    next_doc += 1
                doc = next_doc
            shard.free[doc], at = False, 0
        if not filled:
            seed = doc
            if sizes[doc] - at < window:
                near = shard.ranked(doc)
        take = min(window - filled, sizes[doc] - at)
        waiting.append((doc, at, take, filled, seed))
        filled, at, left = filled + take, at + take, left - take
        if at == sizes[doc]:
            doc = None
        if filled == window:
            out += [(d, s, n, sequence, o, by) for d, s, n, o, by in waiting]
            waiting, filled, sequence, near = [], 0, sequence + 1, iter(())
    while filled:  # the rest goes into sequences of a power of two each
        room = 1 << (filled.bit_length() - 1)
        filled, used = filled - room, 0
        while used < room:
            d, s, n, _, by = waiting.pop(0)
            take = min(n, room - used)
            out.append((d, s, take, sequence, used, by))
            used += take
            if take < n:
                waiting.insert(0, (d, s + take, n - take, 0, by))
        sequence += 1
    return out, sequence


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, block_docs: int = 4096, block_tokens: int = 4 << 20,
    query_terms: int = 12, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row a piece: where a run of a document's ids lies.  ``seed_doc_id`` is the window's first document.

    ``block_docs`` and ``block_tokens`` bound a shard (a longer single document is a shard of its own);
    ``query_terms`` is how many of its rarest terms a seed looks up.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    ids = written(_encoded(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer, end_id), "packing-ids")
    corpus = _statistics(ids)
    if corpus is None:
        return spark.createDataFrame([], SCHEMA)
    shared = spark.sparkContext.broadcast(corpus)
    rate = min(1.0, SAMPLE / corpus.docs)
    sample = ids.where(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1)
    tree = spark.sparkContext.broadcast(_grow(_sampled(sample, shared), max(LEAST_LEAF, int(block_docs * rate / 2))))
    keys = ["leaf", *(f"h{k}" for k in range(HASHES)), "doc_id"]
    blocks = int(max(corpus.docs / block_docs, corpus.docs * corpus.mean / block_tokens)) + 1
    parts = max(min(blocks, 2 * spark.sparkContext.defaultParallelism), blocks // 4)
    placed = written(_placed(ids, shared, tree), "packing-order")
    discarded(ids)  # their order has them too
    rows = placed.withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange(parts, *keys, "row").sortWithinPartitions(*keys, "row")
    return _packed(rows.select("doc_id", "ids"), shared, window, block_docs, block_tokens, query_terms)


def _stored(ids: bytes) -> bytes:
    """Ids as the table has them: 16 bits each where all fit, after a byte that tells."""
    import numpy as np

    own = np.frombuffer(ids, "<u4")
    return b"2" + own.astype("<u2").tobytes() if own.max() < 1 << 16 else b"4" + ids


def _loaded(column) -> list[bytes]:
    import numpy as np

    return [np.frombuffer(x, "<u2", offset=1).astype("<u4").tobytes() if x[:1] == b"2" else x[1:] for x in column.to_pylist()]


def _encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    end = struct.pack("<I", end_id)

    def run(batches):
        import pyarrow as pa

        encoder = ChunkEncoder.of(tokenizer)
        for batch in batches:
            found = [_stored(x + end) for x in encoder.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def _statistics(ids: DataFrame) -> Corpus | None:
    """A task counts its documents, ids (term -1) and terms; the vocabulary's size bounds what comes to the driver."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        df, docs, tokens = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            ids = _loaded(batch.column(1))
            own = np.bincount(_terms(ids)[1])
            df = np.pad(df, (0, max(0, len(own) - len(df))))
            df[: len(own)] += own
            docs, tokens = docs + len(ids), tokens + sum(map(len, ids)) // 4
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-2, -1, *term.tolist()], pa.int64()), pa.array([docs, tokens, *df[term].tolist()], pa.int64())], names=["term", "n"])

    counts = ids.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (counts.column(k).to_numpy() for k in range(2))
    total = dict(zip(term[term < 0].tolist(), n[term < 0].tolist(), strict=True))
    if not total.get(-2):
        return None
    df = np.zeros(int(term.max()) + 1, np.int64)
    df[term[term >= 0]] = n[term >= 0]
    return Corpus(df, total[-2], total[-1] / total[-2])


def _sampled(ids: DataFrame, corpus):
    """The sample's vectors, in an order of their own."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        order = Order(corpus.value)
        for batch in batches:
            x, _ = order.places(_loaded(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], names=["x"])

    rows = sorted(ids.mapInArrow(run, "x binary").toArrow().column(0).to_pylist())
    x = np.frombuffer(b"".join(rows), np.float32).reshape(-1, DIMENSIONS)
    return x[np.random.default_rng(7).permutation(len(x))]


def _placed(ids: DataFrame, corpus, tree) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        order = Order(corpus.value)
        for batch in batches:
            x, drawn = order.places(_loaded(batch.column(1)))
            columns = [pa.array(c, pa.int32()) for c in (_leaves(tree.value, x), *drawn.T)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["doc_id", "ids", "leaf", *(f"h{k}" for k in range(HASHES))])

    return ids.mapInArrow(run, "doc_id long, ids binary, leaf int" + "".join(f", h{k} int" for k in range(HASHES)))


def _packed(rows: DataFrame, corpus, window: int, block_docs: int, block_tokens: int, query_terms: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 32
        names: list = []
        ids: list[bytes] = []
        tokens = 0
        schema = pa.schema([(x.split()[0], pa.int64()) for x in SCHEMA.split(", ")])

        def flush():
            nonlocal sequence, names, ids, tokens
            pieces, sequence = _pieces(ids, window, sequence, query_terms=query_terms, corpus=corpus.value)
            rows = [(names[d], s, n, zlib.crc32(ids[d][4 * s : 4 * (s + n)]), len(ids[d]) // 4, q, o, names[by]) for d, s, n, q, o, by in pieces]
            names, ids, tokens = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), _loaded(batch.column(1)), strict=True):
                names.append(doc_id)
                ids.append(found)
                tokens += len(found) // 4
                if len(ids) >= block_docs or tokens >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    return rows.mapInArrow(run, SCHEMA)
