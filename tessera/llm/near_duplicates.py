"""N-gram Jaccard join by MinHash banding.

1. A task hashes each text's word shingles, takes MinHash signatures and hashes them by bands.  Equal sets
   become one node, so copies cost one row from here on.
2. Nodes are shuffled on band hashes.  Buckets of several nodes hold the candidate pairs; of buckets with the same nodes, which near
   copies have in most bands, the first band's stays.
3. A bucket is cut into blocks of nodes, and each pair of blocks is a cell of bounded size.  A cell verifies on full shingle sets those
   of its pairs that share no earlier band and whose sizes allow the threshold, and returns one row a node: how
   many links and which root.  So a huge bucket is dealt over many tasks, each pair is verified once, pairs are never rows, and work grows
   with buckets, not with chains of them.
4. Links are added up, and components of the verified links are the classes.

A pair is lost if it shares no band: see ``recall_at``.

Defined results: a text without a word is a class of its own; fewer words than the width form one shingle;
equal sets are linked; repeated rows count as copies; a row without doc_id has no class and no link; a very long text is one
node with a cell's share of its own; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, bounded_batches, written
from .graph import connected_components


def choose_bands(threshold: float, recall: float, most: int = 160) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which a pair at ``threshold`` shares a band with ``recall``."""
    for rows in range(most, 0, -1):
        bands = most // rows
        if recall_at(threshold, bands, rows) >= recall:
            return bands, rows
    return most, 1


def recall_at(similarity: float, bands: int, rows: int) -> float:
    """The chance that a pair of this similarity shares a band, and so is verified."""
    return 1 - (1 - similarity**rows) ** bands


def _signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .shingles import minhashes, mix, shingles

        fields = [("doc_id", pa.int64()), ("node", pa.int64()), ("shingles", pa.int32()), ("bands", pa.list_(pa.int64()))]
        for batch in batches:
            ids = batch.column(0)
            sets = [shingles(x, width) for x in batch.column(1).to_pylist()]
            full = [x for x in sets if len(x)]
            node = np.zeros(len(sets), np.int64)
            node[[len(x) > 0 for x in sets]] = [np.add.reduce(mix(x + np.uint64(len(x)))).astype(np.int64) for x in full]
            low = minhashes(full, bands * rows).reshape(len(full), bands, rows) if full else np.zeros((0, bands, rows), np.uint64)
            key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(full), bands))
            for r in range(rows):
                key = mix(key * np.uint64(0xD6E8FEB86659FD93) + low[:, :, r])
            cuts = np.concatenate([[0], np.cumsum([bands * (len(x) > 0) for x in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(node), pa.array([len(x) for x in sets], pa.int32()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(key.reshape(-1).view(np.int64)))], schema=pa.schema(fields)
            )

    return docs.mapInArrow(run, "doc_id long, node long, shingles int, bands array<long>")


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, set) of rows whose text still has the node's set: equal ids may have other texts."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from .shingles import mix, shingles

        for batch in batches:
            nodes, out = [], []
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = shingles(text, width)
                if len(x) and int(np.add.reduce(mix(x + np.uint64(len(x)))).astype(np.int64)) == node:
                    nodes.append(node)
                    out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], names=["node", "set"])

    return texts.mapInArrow(run, "node long, set binary")


def _verify(nodes, sides, weights, bands, sets, band: int, threshold: float):
    """Links and root of each node of a cell: (node, links, root) of nodes that have any.

    ``sides`` has 0 and 1 for the two blocks of a cell, or 2 where a cell is one block; pairs that share one of the first ``band``
    columns of ``bands`` are another cell's.
    """
    import numpy as np

    size = np.array([len(x) for x in sets])
    order = np.argsort(size, kind="stable")
    nodes, sides, weights, bands, size = nodes[order], sides[order], weights[order], bands[order, :band], size[order]
    n = len(nodes)
    _, flat = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
    cut = np.concatenate([[0], np.cumsum(size)])
    most = np.searchsorted(size, np.floor(size / threshold + 1e-9), side="right")  # larger sets can't reach the threshold
    mark = np.zeros(flat.max() + 1, np.int32)
    links, root = np.zeros(n, np.int64), list(range(n))

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a in range(n - 1):
        rest = slice(a + 1, most[a])
        wanted = ((sides[rest] != sides[a]) | (sides[a] == 2)) & ~(bands[rest] == bands[a]).any(axis=1)
        if not wanted.any():
            continue
        mark[flat[cut[a] : cut[a + 1]]] = 1
        both = np.add.reduceat(mark[flat[cut[a + 1] : cut[most[a]]]], cut[rest] - cut[a + 1])
        mark[flat[cut[a] : cut[a + 1]]] = 0
        near = wanted & (both >= threshold * (size[a] + size[rest] - both) - 1e-9)
        for b in (a + 1 + np.flatnonzero(near)).tolist():
            links[a] += weights[b]
            links[b] += weights[a]
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    return [(int(nodes[k]), int(links[k]), int(nodes[top(k)])) for k in range(n) if links[k]]


def _cells(rows: DataFrame, threshold: float) -> DataFrame:
    """Verifies cells; rows: bucket, i, j, node, block, copies, band, bands, set, a cell's rows one after another."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def found(cell):
            cell = list({r[3]: r for r in sorted(cell, key=lambda r: r[3])}.values())  # ids with other texts may repeat a node
            if len(cell) < 2:
                return []
            nodes = np.array([r[3] for r in cell])
            sides = np.array([2 if r[1] == r[2] else int(r[4] == r[2]) for r in cell])
            bands = np.array([r[7] for r in cell], np.int64)
            return _verify(nodes, sides, np.array([r[5] for r in cell]), bands, [np.frombuffer(r[8], np.uint64) for r in cell], cell[0][6], threshold)

        schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
        waiting, out = [], []
        for row in chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches):
            if waiting and waiting[-1][:3] != row[:3]:
                out += found(waiting)
                waiting = []
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)
                    out = []
            waiting.append(row)
        out += found(waiting)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=schema)

    return rows.mapInArrow(run, "node long, links long, root long")


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, width: int = 5, recall: float = 0.9999, id_col: str = "doc_id", text_col: str = "text",
    block_nodes: int = 256, block_shingles: int = 1 << 18,
) -> DataFrame:
    """One row a document: doc_id, class_id (least doc_id of its class), n_links (other documents at
    ``threshold`` or more, copies included), copies (documents with an equal shingle set).

    Bands and rows come from ``threshold`` and ``recall``; ``block_nodes`` and ``block_shingles`` bound a block.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows_ = written(_signatures(docs, width, bands, rows), "signatures")
    known = rows_.where("shingles > 0 AND doc_id IS NOT NULL")
    nodes = written(known.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("shingles").alias("shingles"), F.first("bands").alias("bands")), "nodes")

    member = nodes.select("node", "copies", "shingles", F.posexplode("bands").alias("band", "bucket"))
    buckets = member.groupBy("bucket").agg(
        F.first("band").alias("band"), F.count(F.lit(1)).alias("n"), F.sum(F.col("shingles").cast("long")).alias("shingles"),
        F.sum(F.shiftrightunsigned(F.xxhash64("node"), 34)).alias("members"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("check"),
    ).where("n > 1")
    first = buckets.groupBy("n", "shingles", "members", "check").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.bucket", "n", "shingles")
    kept = written(first.select("bucket", F.greatest(F.ceil(F.col("n") / block_nodes), F.ceil(F.col("shingles") / block_shingles)).cast("int").alias("blocks")), "buckets")
    placed = written(
        member.join(kept.hint("merge"), "bucket").select("bucket", "band", "node", "copies", "blocks", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int").alias("block")),
        "placed",
    )
    wanted = written(nodes.join(placed.select("node").distinct().hint("merge"), "node").select(F.col("first_id").alias("doc_id"), "node"), "wanted")
    small = wanted.count() * 16 <= BROADCAST_BYTES
    texts = docs.join(F.broadcast(wanted) if small else wanted.hint("merge"), "doc_id").select("node", "text")
    sets = written(_sets(texts, width), "sets").join(nodes.select("node", "bands").hint("merge"), "node")
    cells = placed.select("bucket", "band", "node", "block", "copies", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "copies", "band"
    )
    cells = cells.join(sets.hint("merge"), "node").select("bucket", "i", "j", "node", "block", "copies", "band", "bands", "set")
    cells = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = written(_cells(cells, threshold), "links")

    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.select("node", "first_id", "copies").join(links, "node", "left").join(classes, "node", "left").select("node", "first_id", "copies", "links", F.coalesce("root", "node").alias("root"))
    named = written(named, "named")
    least = written(named.groupBy("root").agg(F.min("first_id").alias("class_id")), "least")
    named = written(named.join(least.hint("merge"), "root").select("node", "class_id", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    out = rows_.select("doc_id", F.when(F.expr("shingles > 0 AND doc_id IS NOT NULL"), F.col("node")).alias("node")).join(named.hint("merge"), "node", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("copies", F.lit(1)).alias("copies"))
