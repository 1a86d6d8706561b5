"""Text files: JSON lines, tab-separated summaries, object listings; ragged and dictionary-coded columns."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def write_jsonl(df: DataFrame, path: str, key: str) -> None:
    """JSON lines in order of ``key`` over all files, fields in order of name, nulls left out; the path must be new."""
    rows = df.select(key, F.to_json(F.struct(*sorted(df.columns))).alias("value"))
    rows.repartitionByRange(key).sortWithinPartitions(key).select("value").write.text(path)


def write_tsv(df: DataFrame, path: str, first: list[str]) -> None:
    """Tab-separated with a header: the columns of ``first`` that exist, then the rest by name; six significant digits."""
    columns = [c for c in first if c in df.columns] + sorted(set(df.columns) - set(first))
    fractional = {f.name for f in df.schema.fields if isinstance(f.dataType, DoubleType | FloatType)}

    def short(c: str):
        digits = F.regexp_replace(F.format_string("%.6g", F.col(c).cast("double")), r"(\.\d*?)0+(?=e|$)", "$1")
        return F.when(F.col(c).isNotNull(), F.regexp_replace(digits, r"\.(?=e|$)", "")).alias(c)

    shown = [short(c) if c in fractional else F.col(c) for c in columns]
    df.select(*shown).write.option("sep", "\t").option("header", True).csv(path)


def read_object_listing(spark: SparkSession, path: str, scheme: str = "gs") -> DataFrame:
    """(object, bytes, crc32c) from listings in which a line ``scheme://name:`` precedes indented fields.

    Records end where the next header begins, so long files are split between tasks; missing fields are null and
    records without a header, such as totals, are left out."""
    blocks = spark.read.text(path, lineSep=f"\n{scheme}://").select(F.regexp_replace("value", rf"^{scheme}://", "").alias("b"))
    name = F.regexp_extract("b", r"^([^\r\n]+):[ \t]*(?:\r?\n|$)", 1)
    field = lambda x: F.nullif(F.regexp_extract("b", rf"(?im)^[ \t]+(?:Hash \()?{x}\)?:\s*(\S+)", 1), F.lit(""))
    return blocks.where(name != "").select(F.concat(F.lit(f"{scheme}://"), name).alias("object"), field("Content-Length").cast("long").alias("bytes"), field("crc32c").alias("crc32c"))


def file_checksums(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of all files below a path, each read whole by one task: for shards, which are of bounded size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def write_report(spark: SparkSession, path: str, payload: dict) -> None:
    """One JSON document with sorted keys; the path must be new, and counts once Spark's commit mark is there."""
    text = json.dumps(payload, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(path)


def read_report(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def found_report(spark: SparkSession, path: str) -> dict | None:
    """The report, if it was written to its end."""
    return read_report(spark, path) if is_written(spark, path) else None


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a folder has Spark's commit mark."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def ragged_offsets(df: DataFrame, key: str, size: str, block: int = 1000) -> DataFrame:
    """Adds ``start`` and ``stop`` of each row's values in one flat array, rows in order of an integer ``key``.

    Keys are summed by blocks first, so one task orders only a row a block; a null size counts as 0."""
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    rows = df.withColumns({"__n": n, "__b": F.floor(F.col(key) / block)})
    totals = rows.groupBy("__b").agg(F.sum("__n").alias("__t"))
    before = totals.withColumn("__before", F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__t")).drop("__t")
    own = F.sum("__n").over(Window.partitionBy("__b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("__own", own).join(before, "__b").withColumn("stop", F.col("__before") + F.col("__own")).withColumn("start", F.col("stop") - F.col("__n")).drop("__n", "__b", "__own", "__before")


def dictionary_codes(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds dense codes of a column's values in order of value; null has none."""
    codes = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn(name, (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))  # a row a value
    return df.join(codes, column, "left")
