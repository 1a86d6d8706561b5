"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from ..shipping import ensure_importable

#: A table is broadcast only below this many bytes (rows x an upper bound of a row's bytes).
BROADCAST_BYTES = 8 << 20
#: Rows of one Arrow batch; texts are long, so far fewer than Spark's own default.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the one that driver and executors share (``spark.checkpoint.dir``).

    Only where that setting is missing and the master is local, as in tests, a local folder serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches small enough for long texts, and let the workers import this package."""
    ensure_importable(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: the lineage ends there."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discarded(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` gave, once all that was made from it is written too."""
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def attach(docs: DataFrame, text: Column, keep: Sequence[str], added: str, run) -> DataFrame:
    """Columns ``keep`` of ``docs``, whatever their names and types, and those of the DDL ``added``.

    ``run(texts)`` takes a batch's texts and gives one list of values for each added column.  Columns go by their place, so
    names may hold dots or clash with those of ``added``.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(text.cast("string").alias("c0"), *(F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(keep, 1)))
    new = StructType.fromDDL(added)
    kinds = [to_arrow_type(f.dataType) for f in new.fields]
    names = [*rows.columns[1:], *(f"r{k}" for k in range(len(kinds)))]

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            found = run(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *(pa.array(x, kind) for x, kind in zip(found, kinds, strict=True))], names=names)

    fields = [*rows.schema.fields[1:], *(StructField(f"r{k}", f.dataType) for k, f in enumerate(new.fields))]
    return rows.mapInArrow(each, StructType(fields)).toDF(*keep, *new.names)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def file_system(url: str):
    """(pyarrow file system, path in it) of a URL or a plain path."""
    from pyarrow import fs

    if "://" in url or url.startswith("file:"):
        if url.startswith("file:"):
            return fs.LocalFileSystem(), "/" + url[len("file:"):].lstrip("/")
        return fs.FileSystem.from_uri(url)
    return fs.LocalFileSystem(), os.path.abspath(url)
