"""Ragged segments in record files, found by an index from segment to file and offset.

A segment is one row of any columns, such as the actions of a stretch of an episode.  Segments are dealt over shards by a hash of their id; a shard is one
record file, and its index has id, file, offset and length of each segment.  A lookup joins the wanted ids with the index and reads only those byte
ranges: other shards aren't opened.  Index files whose hash changed are refused before data are read, data by their checksums.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import commits
from .contracts import canonical_hash
from .records import read_records, write_records, written_index


def _data(df: DataFrame, id_col: str, shards: int) -> DataFrame:
    """(id, shard, data): each row as one Arrow message, which keeps all types."""
    own = to_arrow_schema(df.schema)
    place = df.columns.index(id_col)

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            rows = pa.Table.from_batches([batch]).cast(own).combine_chunks()
            messages = [rows.slice(k, 1).combine_chunks().to_batches()[0].serialize().to_pybytes() for k in range(rows.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(place), pa.array(messages, pa.binary())], names=["id", "data"])

    kind = df.schema[id_col].dataType.simpleString()
    shard = F.format_string("segments-%06d", F.pmod(F.xxhash64("id"), F.lit(shards)))
    return df.mapInArrow(encode, f"id {kind}, data binary").select("id", shard.alias("shard"), "data")


def write_segments(df: DataFrame, path: str, id_col: str, contract: dict, shards: int = 16) -> str:
    """Write each row of ``df`` as a segment and return the contract's hash.  Null and repeated ids are refused, and so is a folder that has segments."""
    if commits.committed(path):
        raise FileExistsError(f"{path} has segments already")
    write_records(_data(df, id_col, shards), path, "shard", ["id"], ["id"], unique="id")
    # the contract names the index, whose files have the hashes that the commit tells
    index = sorted([e["index"], e["index_sha256"]] for e in commits.committed(path))
    body = {"contract": contract, "id": id_col, "schema": df.schema.json(), "index": canonical_hash({"files": index})}
    digest = canonical_hash(body)
    commits.write_once(f"{path}/contract.json", json.dumps(body | {"hash": digest}, sort_keys=True).encode())
    return digest


def read_contract(path: str, digest: str | None = None) -> dict:
    """The store's contract, if it has the hash that is expected and its index is that of the commit."""
    system, at = commits.file_system(f"{path}/contract.json")
    with system.open_input_file(at) as f:
        found = json.loads(f.read())
    own = canonical_hash({k: v for k, v in found.items() if k != "hash"})
    if own != found["hash"] or digest and own != digest:
        raise ValueError(f"{path} has another contract")
    if canonical_hash({"files": sorted([e["index"], e["index_sha256"]] for e in commits.committed(path))}) != found["index"]:
        raise ValueError(f"{path} has another index than its contract says")
    return found


def lookup(spark: SparkSession, path: str, ids: DataFrame, digest: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """The segments of ``ids`` (one column), all ``columns`` or those named.  Null, repeated and unknown ids are refused."""
    contract = read_contract(path, digest)
    schema = StructType.fromJson(json.loads(contract["schema"]))
    wanted = ids.select(F.col(ids.columns[0]).cast(schema[contract["id"]].dataType).alias("id"))
    index = written_index(spark, path)
    known = wanted.groupBy("id").agg(F.count(F.lit(1)).alias("times")).join(index, "id", "left")
    repeated, unknown = known.agg(F.count_if(F.col("times") > 1), F.count_if(F.col("shard").isNull())).first()
    if repeated or unknown:
        raise ValueError(f"{repeated} ids repeat, {unknown} are unknown")
    plan = commits.scratch(spark, "lookup")
    known.select("shard", "position", "offset", "bytes").write.parquet(plan)
    found = read_records(spark, f"{path}/data", plan, "data binary")
    own = to_arrow_schema(schema)
    out = StructType([schema[c] for c in columns]) if columns else schema

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            rows = pa.Table.from_batches([pa.ipc.read_record_batch(pa.py_buffer(x), own).select(out.names) for x in batch.column(0).to_pylist()], own.empty_table().select(out.names).schema)
            yield from rows.combine_chunks().to_batches()

    return found.mapInArrow(decode, out)
