"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, binary_output, decontamination, fingerprints, html_text, language_id, licenses, line_dedup, merkle, near_duplicates, packing, token_counts, toxicity
from .common import shared_dir, tokenizer_path, written

WORD_BPE, BYTE_BPE, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"
Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(by: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(by))


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: the benchmark items in it, with edits and places."""
    found = decontamination.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("contaminated", F.size("item_ids") > 0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents inserted; counts under a second version added; exact copies but the
    first deleted; the first batch applied again, which changes nothing."""
    docs = _table(spark, sf_dir, "documents")
    n_words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    narrow = docs.select("text", "doc_id", "source", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), n_words.alias("words"))
    counts = written(token_counts.with_counts(narrow, tokenizer_path(WORD_BPE), ["doc_id", "source", "lang", "key", "words"]), "counts")
    kept = counts.groupBy("key").agg(F.min(F.struct("doc_id", "source", "lang", "tokens", "words")).alias("r")).select("r.*")
    rollup = token_counts.Rollup(spark, shared_dir(spark, "rollup"))
    rollup.apply("load", token_counts.signed(counts, 1, "word_bpe_49k"))
    rollup.apply("second-version", token_counts.signed(counts, 1, "words", "words"))
    rollup.compact()
    deletes = token_counts.revised(counts, kept, "word_bpe_49k").unionByName(token_counts.revised(counts, kept, "words", "words"))
    rollup.apply("copies", deletes)
    rollup.apply("load", token_counts.signed(counts, 1, "word_bpe_49k"))
    return rollup.totals()


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = _table(spark, sf_dir, "documents"), tokenizer_path(PIECES)
    model = language_id.fit_on(docs, _remainder(4) != 2, path)
    found = language_id.identify(docs, model, path)
    return found.select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, _table(spark, sf_dir, "labels"), _remainder(3) != 1)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (_remainder(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.token_ids(_table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE), 2)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(PIECES))[0]


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all leaves; every fifth document or so, by its id's checksum, is tampered with."""
    return merkle.proofs(_table(spark, sf_dir, "documents"), _remainder(5) == 0)


def queries() -> dict[str, Query]:
    import corpus_pipeline

    ops = (op1_fingerprints, op2_packing, op3_decontamination, op4_token_counts, op5_language, op6_licenses, op7_html, op8_near_duplicates, op9_toxicity, op10_token_files, op11_alignment, op12_line_dedup, op13_merkle)
    return {f.__name__: f for f in ops} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return {"op6_licenses": licenses.scan_sql(), "op12_line_dedup": line_dedup.digests_sql(), "op13_merkle": merkle.proofs_sql()} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
