"""Structured Streaming: windowed counts with late data, and an online codebook by exponential averages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import codebooks
from ..sources import files


def event_stream(spark: SparkSession, folder: str, files_a_batch: int = 1) -> DataFrame:
    """Events of a folder of Parquet files as a stream; time becomes a timestamp with zone, which watermarks need."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_counts(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


class OnlineCodebook:
    """Centers as exponential averages of assigned vectors, Laplace-smoothed; for ``foreachBatch``.

    A batch is summed on the executors; the state is k x dimensions on the driver, kept with the last batch's id, so a batch
    that is run again changes nothing."""

    def __init__(self, centers: np.ndarray, decay: float = 0.99, smoothing: float = 1e-5):
        self.centers, self.decay, self.smoothing = np.asarray(centers, float).copy(), decay, smoothing
        self.size = np.ones(len(self.centers))
        self.total = self.centers.copy()
        self.last = -1

    def update(self, batch: DataFrame, batch_id: int, vector: str = "x") -> None:
        from ..operators.clustering import _partial_sums

        if batch_id <= self.last:
            return
        sums, counts, _ = _partial_sums(batch, vector, self.centers)
        self.size = self.decay * self.size + (1 - self.decay) * counts
        self.total = self.decay * self.total + (1 - self.decay) * sums
        n = self.size.sum()
        smooth = (self.size + self.smoothing) / (n + len(self.size) * self.smoothing) * n
        self.centers = self.total / smooth[:, None]
        self.last = batch_id


class StreamingCodebook(OnlineCodebook):
    """An online codebook that revives dead codes and goes on after a restart; for ``foreachBatch``.

    One scan of a batch gives sums, counts and a bounded reservoir of the worst residuals: each task keeps its hardest vectors, ties by key, and these
    are merged, so the reservoir doesn't depend on tasks.  Codes whose averaged count is below ``floor`` times the mean move to the hardest vectors that lie apart, one each, with the mean count.
    The state after each batch is a report in ``folder``: a batch that comes again, in this run or after a restart, changes nothing.
    """

    def __init__(self, spark: SparkSession, centers: np.ndarray, folder: str, decay: float = 0.99, smoothing: float = 1e-5, floor: float = 0.05):
        super().__init__(centers, decay, smoothing)
        self.spark, self.folder, self.floor, self.revived = spark, folder, floor, 0
        while found := files.found_report(spark, f"{folder}/batch-{self.last + 1:06d}"):
            self.centers, self.total, self.size = (np.array(found[k], float) for k in ("centers", "total", "size"))
            self.last, self.revived = self.last + 1, found["revived"]

    def update(self, batch: DataFrame, batch_id: int, vector: str = "x", key: str = "vec_id") -> None:
        if batch_id <= self.last:
            return
        if batch_id != self.last + 1:
            raise ValueError(f"batch {batch_id} comes after {self.last}")
        sums, counts, _, hardest = codebooks.scan_members(batch, vector, key, None, [codebooks.Member("online", len(self.centers))], {"online": self.centers})["online"]
        if counts.sum():
            self.size = self.decay * self.size + (1 - self.decay) * counts
            self.total = self.decay * self.total + (1 - self.decay) * sums
        dead = np.flatnonzero(self.size < self.floor * self.size.mean()).tolist()
        taken: list[np.ndarray] = []
        for negative, _, found in hardest:  # by falling distance
            v = np.array(found, float)
            # a vector near one that a code has just moved to waits: the next batch tells whether it is still hard
            if len(taken) < len(dead) and negative < 0 and all(4 * ((v - t) ** 2).sum() >= -negative for t in taken):
                code = dead[len(taken)]
                taken.append(v)
                self.size[code] = self.size.mean()
                self.total[code] = v * self.size[code]
                self.revived += 1
        n = self.size.sum()
        smooth = (self.size + self.smoothing) / (n + len(self.size) * self.smoothing) * n
        self.centers = self.total / smooth[:, None]
        self.last = batch_id
        state = {"centers": self.centers.tolist(), "total": self.total.tolist(), "size": self.size.tolist(), "revived": self.revived}
        files.write_report(self.spark, f"{self.folder}/batch-{batch_id:06d}", state)

    def follow(self, stream: DataFrame, checkpoint: str, vector: str = "x", key: str = "vec_id") -> None:
        """Take in what the stream has, batch by batch."""
        def take(batch: DataFrame, batch_id: int) -> None:
            self.update(batch, batch_id, vector, key)

        stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
