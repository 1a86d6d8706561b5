"""Exports that resume: a transactional sink whose tasks hash what they write and whose driver commits all parts of a run or none.

A part is the rows of one value of a column, such as a shard.  A part's files hold that column as it is, so values come back with their types.  Files of
runs that were cut off are named by no commit and so belong to nothing.  A part is done once committed; the source's fingerprint may be
committed with it, and a part whose source differs later is refused instead of being reused.  A large part is dealt over several tasks and files.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..shipping import ensure_importable
from . import commits
from .contracts import canonical_hash, read_contract, write_table
from .records import changed_files

FORMAT = "tessera_parts"
_SOURCE = "__source"


@dataclass
class Written(WriterCommitMessage):
    entries: list[dict] = field(default_factory=list)


class PartWriter(DataSourceArrowWriter):
    """Options: ``path``, ``part`` (column).  Rows of a part come together in each task; a part may come in several tasks."""

    def __init__(self, options: dict):
        self.root, self.part = options["path"], options["part"]

    def write(self, iterator) -> Written:
        import pyarrow as pa
        import pyarrow.compute as pc
        import pyarrow.parquet as pq

        done = Written()
        made: list[commits.HashedFile] = []
        now, writer, rows, source = None, None, 0, None

        def close() -> None:
            writer.close()
            done.entries.append({"key": str(now), "rows": rows, "source": source} | made[-1].entry())

        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                if table.column(self.part).null_count:
                    raise ValueError("every row needs a part")
                begins = [0, *(k + 1 for k, same in enumerate(pc.equal(table.column(self.part)[1:], table.column(self.part)[:-1]).to_pylist()) if not same)] if table.num_rows else []
                for lo, hi in zip(begins, [*begins[1:], table.num_rows], strict=True):
                    own = table.slice(lo, hi - lo)
                    bare = own.drop_columns([_SOURCE]) if _SOURCE in own.column_names else own
                    if (value := own.column(self.part)[0].as_py()) != now or writer is None:
                        if writer is not None:
                            close()
                        now, rows = value, 0
                        made.append(commits.HashedFile(self.root, f"parts/{commits.file_name(str(value))}.parquet"))
                        source = own.column(_SOURCE)[0].as_py() if _SOURCE in own.column_names else None
                        writer = pq.ParquetWriter(made[-1], bare.schema, compression="zstd")
                    writer.write_table(bare)
                    rows += bare.num_rows
            if writer is not None:
                close()
        except BaseException:
            for f in made:
                f.discard()
            raise
        return done

    def commit(self, messages) -> None:
        entries = [e for m in messages if m for e in m.entries]
        try:
            commits.commit(self.root, entries)
        except ValueError:
            commits.discard(self.root, entries)
            raise

    def abort(self, messages) -> None:
        commits.discard(self.root, [e for m in messages if m for e in m.entries])


class PartSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> PartWriter:
        if overwrite:
            raise ValueError("parts are written once; append to them")
        return PartWriter(self.options)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """A row a file that is committed: part, file, rows, bytes, sha256, source."""
    rows = [(e["key"], e["file"], e["rows"], e["bytes"], e["sha256"], e["source"]) for e in commits.committed(path)]
    return spark.createDataFrame(rows, "part string, file string, rows long, bytes long, sha256 string, source string")


def export(df: DataFrame, path: str, part: str, sources: DataFrame | None = None) -> int:
    """Commit the parts of ``df`` that aren't committed yet; how many these were.  Rows without a part are refused, and then nothing is committed.

    ``sources`` (part, source) gives a fingerprint of what each part is made from: a part that was made from another source is refused.
    """
    spark = df.sparkSession
    ensure_importable(spark)
    spark.dataSource.register(PartSink)
    done = {e["key"]: e["source"] for e in commits.committed(path)}  # a row a part
    value = F.col(part).cast("string")
    if sources is not None:
        made_from = sources.select(F.col("part").cast("string").alias("__part"), F.col("source").cast("string").alias(_SOURCE))
        if stale := sorted(r[0] for r in made_from.collect() if r[0] in done and done[r[0]] != r[1]):  # a row a part
            raise ValueError(f"the sources of {stale[:5]} have changed since they were exported")
        df = df.join(made_from, value == F.col("__part"), "left").drop("__part")
    if done:
        held = spark.createDataFrame([(k,) for k in done], "__done string")
        df = df.join(held, value == F.col("__done"), "left_anti")
    # parts are put together, and large ones split, by the sizes that are seen at run time
    dealt = df.hint("rebalance", part).sortWithinPartitions(part)
    dealt.write.format(FORMAT).mode("append").option("path", path).option("part", part).save()
    return len({e["key"] for e in commits.committed(path)}) - len(done)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    """All rows of committed parts, without verification."""
    files = [e["file"] for e in commits.committed(path)]
    if not files:
        raise ValueError(f"{path} has no committed part")
    return spark.read.parquet(*(f"{path}/{x}" for x in files))


def changed_parts(spark: SparkSession, path: str) -> list[str]:
    """Parts with a file that is missing or differs from what was written; files are hashed as they are, rows aren't read."""
    entries = commits.committed(path)
    bad = set(changed_files(spark, path, [(e["file"], e["sha256"]) for e in entries])) if entries else set()
    return sorted({e["key"] for e in entries if e["file"] in bad})


def finalize(expected: DataFrame, path: str, part: str, contract: dict) -> DataFrame:
    """The whole table, if every part that is ``expected`` is committed, no other, and all files are as written.

    All of that is verified each time.  The contract names the files and their hashes, so a table that was completed with other data is refused.
    """
    spark = expected.sparkSession
    have = reports(spark, path).select("part").distinct()
    want = expected.select(F.col(part).cast("string").alias("part")).distinct()
    missing, unexpected = want.join(have, "part", "left_anti").count(), have.join(want, "part", "left_anti").count()
    if missing or unexpected:
        raise ValueError(f"{missing} parts are missing, {unexpected} are unexpected")
    if bad := changed_parts(spark, path):
        raise ValueError(f"parts differ from what was written: {bad[:5]}")
    files = reports(spark, path)
    data = canonical_hash({"files": sorted([e["file"], e["sha256"], e["rows"]] for e in commits.committed(path))})
    write_table(files, f"{path}/whole", contract | {"data": data})
    return read_parts(spark, path)


def finished(spark: SparkSession, path: str) -> dict | None:
    """The contract of the whole table, if it was completed."""
    found = read_contract(spark, f"{path}/whole")
    return found and found["contract"]
