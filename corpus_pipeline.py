"""A corpus made ready for training, in five stages; each takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontamination, language_id, near_duplicates, packing, toxicity
from tessera.llm.common import quoted, shared_dir, tokenizer_path, written
from tessera.llm.queries import PIECES, WORD_BPE

#: Below this share of the likelihood for the best language a text counts as of none.
LEAST_LANGUAGE_SCORE = 0.5
#: From this score a document counts as toxic.
TOXIC_SCORE = 0.7
#: A character of a word, as near duplicates see it.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def _fit_columns(docs: DataFrame) -> list[str]:
    return [quoted(c) for c in docs.columns]


def _free(docs: DataFrame, name: str) -> str:
    """``name``, or with underscores before it until no column has it."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter or without a clearly best language; all columns of the rest."""
    path = tokenizer_path(PIECES)
    model = language_id.fit_on(docs, F.lit(True), path)
    pred, score = _free(docs, "lang_pred"), _free(docs, "score")
    found = language_id.identify(docs, model, path, keep=tuple(docs.columns), names=(pred, score))
    return found.where((F.col(pred) != "und") & (F.col(score) >= LEAST_LANGUAGE_SCORE)).select(*_fit_columns(docs))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic; the labels of the documents at hand are learned from."""
    model = toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    score = _free(docs, "score")
    return toxicity.score(docs, model, keep=tuple(docs.columns), name=score).where(F.col(score) < TOXIC_SCORE).select(*_fit_columns(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near duplicates, that with the least doc_id (rows without id last).

    Each row counts by itself, so other texts under its id stay; rows without words are one if id and text are equal.
    """
    row = _free(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row))[row].alias(row)
    found = near_duplicates.near_duplicates(rows, id_col=row).where("n_links > 0").select(F.col("doc_id").alias(row), F.col("class_id").alias("class"))
    linked = written(rows.select("doc_id", row).join(found, row), "linked")
    bare = rows.where(F.col("doc_id").isNotNull() & ~F.coalesce(F.lower("text").rlike(_WORD), F.lit(False))).select("doc_id", "text", row)
    kept = linked.groupBy("class").agg(first).select(row).unionByName(bare.groupBy("doc_id", "text").agg(first).select(row))
    rest = linked.select(row).unionByName(bare.select(row)).join(kept, row, "left_anti")
    return rows.join(rest, row, "left_anti").select(*_fit_columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item."""
    return decontamination.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences of 2048 ids."""
    return packing.pack(docs, tokenizer_path(WORD_BPE))


STAGES = [
    ("language_id", keep_known_language),
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages' models and alignments can't be written in SQL; tests hold the run against a plain version of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = shared_dir(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
