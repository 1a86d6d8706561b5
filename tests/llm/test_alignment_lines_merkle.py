"""Operators 11 to 13 against plain versions, and on odd rows."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import alignment, line_dedup, merkle
from tessera.llm.common import tokenizer_path

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
WORDS = "the of and Model été naïve data 2024 don't x1 ... , über weiß 漢字 hello_world foo(bar) 🙂".split()


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizer_path(A_FILE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(B_FILE))
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in plain} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in plain)}
    name_of = {i: x for x, i in a.get_vocab().items()}
    docs, counts = [], Counter()
    for doc_id, text in rows:
        groups = []
        if text:
            ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            bytes_of = [bytes(byte_of[c] for c in name_of[i]) for i in ids[0]], [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
            if all(b"".join(x) == (" " + text).encode() for x in bytes_of):
                ends = [np.cumsum([len(x) for x in side]).tolist() for side in bytes_of]
                shared = sorted(set(ends[0]) & set(ends[1]))
                for lo, hi in zip([0, *shared], shared, strict=False):
                    groups.append(tuple([i for i, e in zip(ids[k], ends[k], strict=True) if lo < e <= hi] for k in (0, 1)))
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        counts.update(set(links))
        docs.append((doc_id, groups, links))
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    return [
        (doc_id, sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), links.total(), sum(n for k, n in links.items() if counts[k] == best[k[0]]), sum(n * counts[k] for k, n in links.items()),
         sha(";".join(f"{','.join(map(str, p))}|{','.join(map(str, q))}" for p, q in g)) if g else "")
        for doc_id, g, links in docs
    ]


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    odd = ["", None, " ", "\n", "  a  b ", "a▁b c", "<|endoftext|> x <s>", "漢字かな交じり文" * 90, "\n\n x\t y   z　 q", "e\u0301 ́x", "a  " * 50, "x" * 3000, "🙂🙃" * 300, "\x00 \x01", "ab  c \r\n d", "    if x:\n        y   \n"]
    return odd + [" ".join(rng.choice(WORDS, rng.integers(1, 60))) for _ in range(40)] + [" ".join(rng.choice(WORDS, 9000))]


def test_alignment_equals_a_plain_version(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)] + [(7, texts[-3]), (None, texts[-2]), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("clash")).withColumn("block", F.lit(1)).repartition(3)
    found, counts = alignment.align(docs, tokenizer_path(A_FILE), tokenizer_path(B_FILE), batch_chars=4000, block_pairs=500)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert ordered(found.collect()) == ordered(plain_alignment(rows))
    assert counts.where("best").select("a").distinct().count() == counts.select("a").distinct().count()


def test_alignment_of_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align(docs, tokenizer_path(A_FILE), tokenizer_path(B_FILE))[0].collect() == []


def test_lanes_and_tables_change_nothing(texts):
    a, b = tokenizer_path(A_FILE), tokenizer_path(B_FILE)
    whole, cut = alignment.Aligner(a, b, lane_chunks=1 << 30), alignment.Aligner(a, b, max_chunks=3, lane_chunks=2)
    x, y = whole.align(texts), cut.align(texts)
    cut.align(texts[:3])
    assert whole.digests(x) == cut.digests(y) == cut.digests(cut.align(texts))


def test_links_of_large_groups_are_counted_by_ids():
    x = alignment.Aligned(np.array([1, 2] * 60, np.int32), np.array([3] * 70, np.int32), np.array([0, 120]), np.array([0, 70]), np.array([120]), np.array([70]), np.array([0, 1]))
    doc, key, times = alignment.pairs(x)
    assert doc.tolist() == [0, 0] and times.tolist() == [4200, 4200] and key.tolist() == [1 << 20 | 3, 2 << 20 | 3]


def plain_lines(rows):
    space, keys, held = " \t\n\v\f\r", [], defaultdict(list)
    for k, (doc_id, text) in enumerate(rows):
        lines = (text or "").split("\n")
        own = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(space)) for x in lines]
        keys.append((doc_id, lines, own))
        for x in {x for x in own if len(x) >= 20}:
            held[x].append((doc_id is not None, doc_id, k))
    last = {x: max(h[:2] for h in own)[1] for x, own in held.items() if len(own) >= 3}
    out = []
    for doc_id, lines, own in keys:
        kept = [line for line, x in zip(lines, own, strict=True) if x not in last or last[x] == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_line_dedup_equals_a_plain_version(spark):
    rng = np.random.default_rng(1)
    lines = ["", "short", "exactly twenty chars", " exactly TWENTY chars\t", "nineteen characters", "ÀÉÎ àéî ÀÉÎ àéî ÀÉÎÀ", "àéî àéî àéî àéî àéîà", "\u00a0a line with another kind of space", *(f"line number {k} of the corpus, shared" for k in range(30))]
    rows = [(k, "\n".join(rng.choice(lines, rng.integers(1, 30)))) for k in range(60)]
    rows += [(5, rows[9][1]), (70, None), (71, ""), (72, "\n"), (None, rows[3][1]), (None, "only in rows without an id, three of them"), (None, "only in rows without an id, three of them"), (None, "only in rows without an id, three of them")]
    rows += [(80, "\n".join(f"a very long text's line {k % 50_000}" for k in range(100_000))), (81, "x" * 1_000_000), (82, "x" * 1_000_000), (83, "x" * 1_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).withColumn("low", F.lit("x")).repartition(4)
    found = line_dedup.dedup_lines(docs, block_bytes=1 << 16)
    assert ordered(found.collect()) == ordered(plain_lines(rows))
    dealt = line_dedup.dedup_lines(docs, probe_bytes=0)  # as for an index that is too large to read for each block
    assert dealt.columns == found.columns and ordered(dealt.collect()) == ordered(plain_lines(rows))


def test_line_dedup_of_an_empty_table_and_without_shared_lines(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).collect() == [] and line_dedup.dedup_lines(docs, probe_bytes=-1).collect() == []
    docs = spark.createDataFrame([(1, "a line that nobody else has\nb")], "doc_id long, text string")
    assert [tuple(r) for r in line_dedup.dedup_lines(docs).collect()] == [(1, "a line that nobody else has\nb", 2, 0)]


def test_shards_number_their_keys_and_refuse_strangers(tmp_path):
    rng = np.random.default_rng(3)
    high, low = rng.integers(0, 1 << 63, 20_000).astype(np.uint64), rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    high[1], low[2] = high[0], low[0]  # keys that share a half
    hashed = line_dedup.PerfectHash.build(high, low)
    assert sorted(hashed.numbers(high, low).tolist()) == list(range(20_000)) and hashed.bits.nbytes * 8 < 5 * 20_000
    shard = line_dedup.Shard.load(line_dedup.Shard.build(high, low, np.arange(20_000), np.arange(20_000), np.zeros(20_000, bool)).save())
    assert shard.counts[shard.find(high, low)].tolist() == list(range(20_000))
    assert (shard.find(high ^ np.uint64(1 << 63), low) == -1).all()
    with pytest.raises(ValueError, match="repeat"):
        line_dedup.PerfectHash.build(np.array([5, 5], np.uint64), np.array([6, 6], np.uint64))
    assert len(line_dedup.PerfectHash.build(high[:0], low[:0])) == 0


def test_index_is_written_in_several_shards_and_read_within_bounds(spark, tmp_path):
    counts = spark.range(1000).select(F.xxhash64("id").alias("high"), F.xxhash64("id", F.lit(1)).alias("low"), F.lit(4).cast("long").alias("n"), F.when(F.col("id") > 0, F.col("id")).alias("last"))
    folder = f"file://{tmp_path}/index"
    shards, size = line_dedup.build_index(counts, folder, shard_keys=90)
    reader = line_dedup.IndexReader(folder, shards, most_bytes=5000)
    keys = [np.array([r.high, r.low], "<i8").tobytes() for r in counts.orderBy("last").collect()]
    found = reader.look_up(keys + [b"0" * 16])
    assert shards == 12 and size > 20_000 and [found[k] for k in keys] == [(4, None), *((4, k) for k in range(1, 1000))] and len(found) == 1000
    assert reader.size <= 5000 or len(reader.held) == 1


def plain_merkle(rows, fanout=16):
    def part(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def tree(nodes):
        """(top, path of each node)"""
        paths = [[] for _ in nodes]
        at = list(range(len(nodes)))
        while len(nodes) > 1:
            runs = [nodes[k : k + fanout] for k in range(0, len(nodes), fanout)]
            for n, k in enumerate(at):
                run, slot = runs[k // fanout], k % fanout
                paths[n].append(("".join(run[:slot]), "".join(run[slot + 1 :])))
            at = [k // fanout for k in at]
            nodes = [sha(*run) for run in runs]
        return nodes[0], paths

    leaves = defaultdict(list)
    for r in rows:
        low = None if r[4] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])
        leaf = sha(*map(part, r))
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        leaves[r[1]].append(((r[0] is not None, r[0] or 0), leaf, sha(*map(part, (*r[:4], low))) if tampered else leaf, r[0]))
    sources = sorted(leaves, key=lambda s: (s is not None, (s or "").encode()))
    tops = {}
    for s in sources:
        leaves[s].sort(key=lambda x: x[:2])
        tops[s] = tree([x[1] for x in leaves[s]])
    root, above = tree([tops[s][0] for s in sources]) if sources else (None, [])
    out = []
    for s, over in zip(sources, above, strict=True):
        for (_, leaf, other, doc_id), path in zip(leaves[s], tops[s][1], strict=True):
            cur = other
            for before, after in path + over:
                cur = sha(before, cur, after)
            out.append((doc_id, leaf, tops[s][0], root, sha(*(b + a for b, a in path + over)), cur, cur == root))
    return out


def remainder():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))


@pytest.mark.parametrize("sizes", [{}, {"a": 1}, {None: 3}, {"a": 16, "b": 17, "é": 1, None: 2, "z": 300}, {f"s{k}": 1 + k % 3 for k in range(40)}])
def test_merkle_equals_a_plain_version(spark, sizes):
    rows, k = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((None if k % 29 == 28 else k * 7 % 997, source, None if k % 5 == 0 else "en", None if k % 7 == 0 else k, None if k % 11 == 0 else "" if k % 13 == 0 else f"Text {k} É" * (1 + k % 4)))
            k += 1
    rows += rows[:2] if len(rows) > 2 else []
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("pos", F.lit("clash")).withColumn("range", F.lit(0))
    found = merkle.proofs(docs, remainder() == 0)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert ordered(found.collect()) == ordered(plain_merkle(rows))


def test_merkle_sql_equals_the_operator(spark):
    rows = [(k, "b" if k % 3 else None, "en", k, f"Text {k}") for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    assert ordered(con.sql(merkle.proofs_sql(3)).fetchall()) == ordered(merkle.proofs(docs, remainder() == 0).collect())
