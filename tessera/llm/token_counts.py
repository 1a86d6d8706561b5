"""Delta-maintained token counts: additive totals by source, language and tokenizer version.

Every change is a signed row: an insert adds a document and its tokens, a delete takes them away, a revised count takes the
old one away and adds the new.  A batch is summed up by key before it is stored, so the store grows with keys x
batches and never with documents.  A batch is written aside and takes its name by a rename that fails if the name is taken, so
commits are idempotent, whoever writes.  Compaction folds committed batches into a snapshot that names them, so a batch it holds isn't
added twice; folders that it makes superfluous go with the next compaction, so readers of older totals aren't cut off.  The folder must be on a file
system whose renames are atomic, such as HDFS; object stores that copy instead aren't meant.

Defined results: a null text has no tokens; a null source, language or version is a key of its own; keys whose
documents and tokens are all gone are left out; repeated rows count as often as they come; a very long text costs in proportion; an empty batch commits;
other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach
from .tokens import ChunkEncoder

KEYS = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, documents long, tokens long"


def with_counts(docs: DataFrame, tokenizer: str, keep: list[str], text_col: str = "text", name: str = "tokens") -> DataFrame:
    """Columns ``keep`` and the number of the tokenizer's ids of each whole text."""
    return attach(docs, F.col(text_col), keep, f"`{name}` long", lambda texts: [ChunkEncoder.of(tokenizer).counts(texts)])


def signed(counts: DataFrame, sign: int, version: str | Column, tokens: str = "tokens") -> DataFrame:
    """Inserts (+1) or deletes (-1) of rows with source, lang and a token count."""
    version = F.lit(version) if isinstance(version, str) else version
    return counts.select("source", "lang", version.alias("version"), F.lit(sign).cast("long").alias("documents"), (F.col(tokens) * sign).alias("tokens"))


def revised(before: DataFrame, after: DataFrame, version: str | Column, tokens: str = "tokens") -> DataFrame:
    """Signed rows for counts that were ``before`` and are ``after``."""
    return signed(before, -1, version, tokens).unionByName(signed(after, 1, version, tokens))


class Rollup:
    """The store of one rollup, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._files = hadoop.FileContext.getFileContext(self._fs.getUri(), spark._jsc.hadoopConfiguration())

    def _committed(self, kind: str) -> list[str]:
        top = self._path(f"{self.folder}/{kind}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def _commit(self, kind: str, name: str, write) -> bool:
        """What ``write`` puts into a folder of its own takes its name at once, or not at all if that name is taken."""
        from py4j.protocol import Py4JJavaError

        waiting = f"{self.folder}/_waiting/{uuid.uuid4().hex}"
        write(waiting)
        self._fs.mkdirs(self._path(f"{self.folder}/{kind}"))
        never_over = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._files.rename(self._path(waiting), self._path(f"{self.folder}/{kind}/{name}"), never_over)
        except Py4JJavaError as e:
            self._fs.delete(self._path(waiting), True)
            if "AlreadyExists" not in str(e.java_exception):
                raise
            return False
        return True

    def apply(self, batch_id: str, rows: DataFrame) -> bool:
        """Commit a batch of signed rows once; False if it had been committed before, by another writer too."""
        if not re.fullmatch(r"[\w-]+", batch_id):
            raise ValueError("a batch id has letters, digits, _ and - only")
        if batch_id in self._committed("batches") or self._held([batch_id], self._latest()):
            return False
        total = rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return self._commit("batches", batch_id, total.write.parquet)

    def _latest(self) -> str | None:
        names = self._committed("snapshots")
        return names[-1] if names else None

    def _held(self, names: list[str], snapshot: str | None) -> set[str]:
        """Those of ``names`` that a snapshot holds; the table of all names stays in its files."""
        if not snapshot or not names:
            return set()
        held = self.spark.read.schema("batch string").parquet(f"{self.folder}/snapshots/{snapshot}/held")
        return {r[0] for r in held.where(F.col("batch").isin(names)).collect()}

    def _state(self) -> tuple[list[str], set[str], str | None]:
        """(batches, those of them that the snapshot holds, snapshot), of one listing.

        Batches are listed first: what another writer folds away after that is in the snapshot that is found then.
        """
        batches = self._committed("batches")
        snapshot = self._latest()
        return batches, self._held(batches, snapshot), snapshot

    def _sum(self, batches: list[str], held: set[str], snapshot: str | None) -> DataFrame:
        tables = [self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/batches/{n}") for n in batches if n not in held]
        tables += [self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/snapshots/{snapshot}/totals")] if snapshot else []
        total = reduce(DataFrame.unionAll, tables or [self.spark.createDataFrame([], SCHEMA)]).groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return total.where("documents <> 0 OR tokens <> 0")

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens), summed over all committed batches.

        A table that was asked for stays readable until the second compaction after that.
        """
        return self._sum(*self._state())

    def compact(self) -> bool:
        """Fold the committed batches into a new snapshot; then drop what the snapshot before this one had made superfluous.

        Totals and names come from one listing, so a batch that is committed meanwhile is in neither.  False if another writer made a snapshot meanwhile.
        """
        batches, held, snapshot = self._state()
        total = self._sum(batches, held, snapshot)
        names = self.spark.createDataFrame([(n,) for n in batches if n not in held], "batch string")
        if snapshot:
            names = names.unionAll(self.spark.read.schema("batch string").parquet(f"{self.folder}/snapshots/{snapshot}/held"))

        def write(folder):
            total.write.parquet(f"{folder}/totals")
            names.write.parquet(f"{folder}/held")

        older = [n for n in self._committed("snapshots") if snapshot and n < snapshot]
        if not self._commit("snapshots", f"{int(snapshot) + 1 if snapshot else 0:08d}", write):
            return False
        for gone in [f"batches/{n}" for n in held] + [f"snapshots/{n}" for n in older]:
            self._fs.delete(self._path(f"{self.folder}/{gone}"), True)
        return True
