"""Write-once tables with a content contract: canonical JSON hashed with SHA-256, checked when read."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def canonical_hash(payload: dict) -> str:
    """SHA-256 of JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def fingerprint(df: DataFrame) -> DataFrame:
    """(rows, digest) of a table's content, whatever the order of rows: sums of row hashes, no collection.

    Two sums of 28 bits of a SHA-256 a row.  Columns are written in order of name, each as its length, a colon and its value, or ``-`` for null, so no two rows are written alike."""
    def written(c: str) -> Column:
        value = F.col(c).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return _summed(df, F.concat(*(F.concat(F.lit(f"{len(c.encode())}:{c}="), written(c)) for c in sorted(df.columns))))


def plain_fingerprint(df: DataFrame) -> DataFrame:
    """As ``fingerprint``, of rows written as ``name=value`` between bars: only for tables without nulls and without bars in their values, as others may be written alike."""
    return _summed(df, F.concat_ws("|", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("null"))) for c in sorted(df.columns))))


def _summed(df: DataFrame, row: Column) -> DataFrame:
    digest = F.sha2(row, 256)
    part = lambda at: F.sum(F.conv(F.substring(digest, at, 7), 16, 10).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("rows"), part(1).alias("low"), part(8).alias("high"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows for which a rule is false or unknown, all counted in one pass."""
    counts = [F.struct(F.lit(k).alias("rule"), F.count_if(~F.coalesce(rule, F.lit(False))).alias("violations")) for k, rule in rules.items()]
    return df.agg(F.array(*counts).alias("c")).select(F.inline("c"))


def write_table(df: DataFrame, path: str, contract: dict) -> str:
    """Write once: an equal contract leaves the table as it is, another one is an error.

    Data go to a folder of their own, which the contract names; whoever writes the contract first wins."""
    spark, digest = df.sparkSession, canonical_hash(contract)
    found = read_contract(spark, path)
    if found is None:
        data = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{path}/{data}")
        row = json.dumps({"contract": contract, "hash": digest, "data": data}, sort_keys=True)
        try:
            spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/contract")
            return digest
        except AnalysisException:
            found = read_contract(spark, path)
    if found is None or found["hash"] != digest:
        raise ValueError(f"{path} holds another contract")
    return digest


def read_contract(spark: SparkSession, path: str) -> dict | None:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/contract/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    out = json.loads(spark.read.text(f"{path}/contract").first()[0])
    if canonical_hash(out["contract"]) != out["hash"]:
        raise ValueError(f"the contract of {path} was changed")
    return out


def read_table(spark: SparkSession, path: str, digest: str | None = None) -> DataFrame:
    found = read_contract(spark, path)
    if found is None or digest and found["hash"] != digest:
        raise ValueError(f"{path} has no such contract")
    return spark.read.parquet(f"{path}/{found['data']}")


def save_codebook(spark: SparkSession, path: str, levels: list[list[list[float]]], mean: list[float], std: list[float], contract: dict) -> str:
    """Centers by level and code, and the normalisation before them (level -1).  Written once: an equal codebook leaves the table as it
    is, another one is refused."""
    rows = [(-1, 0, list(map(float, mean))), (-1, 1, list(map(float, std)))] + [(k, c, list(map(float, x))) for k, level in enumerate(levels) for c, x in enumerate(level)]
    values = hashlib.sha256(json.dumps(rows).encode()).hexdigest()
    return write_table(spark.createDataFrame(rows, "level int, code int, center array<double>"), path, contract | {"values": values})


def load_codebook(spark: SparkSession, path: str) -> tuple[list[list[list[float]]], list[float], list[float]]:
    """(levels, mean, std); a codebook is a model of bounded size, so it comes to the driver."""
    rows = {(r["level"], r["code"]): list(r["center"]) for r in read_table(spark, path).collect()}
    depth = max(k for k, _ in rows) + 1
    return [[rows[k, c] for c in range(sum(level == k for level, _ in rows))] for k in range(depth)], rows[-1, 0], rows[-1, 1]
