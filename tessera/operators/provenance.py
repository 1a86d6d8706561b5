"""Provenance of reports: which inputs a report rests on, directly or through others, and which of these links are broken.

``reports``: report, hash (of its content as it is now); ``links``: report, input (the report that it read), claimed (the hash that it saw).  The closure grows by
one step of links a round, only from what is new, so a report that many paths lead to is followed once and cycles end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import commits


#: Rows a task of a join gets about, and rows up to which a side is broadcast.  Partitions are counted by rows, as ids shrink so well in a shuffle that partitions put together by their size in bytes grow with the table.
_ROWS = 500_000


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` by ``key`` in as many partitions as ``rows`` rows need, which the planner doesn't put together."""
    return df.repartition(max(1, -(-rows // _ROWS)), key)


def closure(links: DataFrame, roots: DataFrame) -> DataFrame:
    """(report, depth): all that ``roots`` (report) rest on, themselves at depth 0, by the shortest way.  Ids that no report has are in it."""
    spark, folder = links.sparkSession, commits.scratch(links.sparkSession, "closure")

    def stored(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}")
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    edges = stored(links.select("report", "input").where("report IS NOT NULL AND input IS NOT NULL"), "edges")
    steps = [stored(roots.select("report").where("report IS NOT NULL").distinct().withColumn("depth", F.lit(0)), "depth-0")]
    linked, counts = edges.count(), [steps[0].count()]
    while counts[-1]:
        last, depth = steps[-1].select("report"), len(steps)
        if counts[-1] <= _ROWS:
            ahead = edges.join(F.broadcast(last), "report", "left_semi")
        else:
            n = max(linked, counts[-1])
            ahead = dealt(edges, "report", n).join(dealt(last, "report", n).hint("merge"), "report", "left_semi")
        ahead = stored(ahead.select(F.col("input").alias("report")).distinct(), f"ahead-{depth}")
        found, seen = ahead.count(), reduce(DataFrame.unionByName, steps).select("report")
        if found <= _ROWS:  # few ids are looked up in all that was seen, which stays where it is
            again = seen.join(F.broadcast(ahead), "report", "left_semi")
            new = ahead.join(F.broadcast(again), "report", "left_anti")
        else:
            n = max(found, sum(counts))
            new = dealt(ahead, "report", n).join(dealt(seen, "report", n).hint("merge"), "report", "left_anti")
        steps.append(stored(new.withColumn("depth", F.lit(depth)), f"depth-{depth}"))
        counts.append(steps[-1].count())
    return reduce(DataFrame.unionByName, steps)


def audit(reports: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """(kind, report, input) of all that is broken.

    ``missing``: a reachable report names an input that doesn't exist; ``unequal``: the input's hash isn't the claimed one, or one of them is null; ``unreachable``: no root rests on the
    report; ``unknown``: a root that doesn't exist.  Reports that repeat are one if their hashes agree, else ``unequal`` to any claim.
    """
    reports, links, roots = commits.stored(reports.select("report", "hash"), "reports"), commits.stored(links.select("report", "input", "claimed"), "links"), commits.stored(roots.select("report"), "roots")
    n = max(reports.count(), links.count())
    least, most = F.min("hash"), F.max("hash")
    have = commits.stored(dealt(reports, "report", n).groupBy("report").agg(least.alias("hash"), F.coalesce(least != most, F.lit(False)).alias("several")), "have")
    reached = commits.stored(closure(links, roots).select("report"), "reached")
    n = max(n, reached.count())
    # reports there are, and whether they are reached; the same rows tell the links that count and the reports out of reach
    known = dealt(have.select("report"), "report", n).join(dealt(reached.withColumn("reached", F.lit(True)), "report", n).hint("merge"), "report", "left")
    known = commits.stored(known.select("report", F.col("reached").isNotNull().alias("reached")), "known")
    own = dealt(links.where("input IS NOT NULL"), "report", n).join(dealt(known.where("reached"), "report", n).hint("merge"), "report", "left_semi").distinct()
    # hashes don't shrink, so the planner's own partitions are bounded here, and it splits those of an input that many read
    seen = own.join(have.select(F.col("report").alias("input"), "hash", "several", F.lit(True).alias("there")), "input", "left")
    agrees = F.coalesce((F.col("hash") == F.col("claimed")) & ~F.col("several"), F.lit(False))
    broken = seen.select(F.when(F.col("there").isNull(), "missing").when(~agrees, "unequal").alias("kind"), "report", "input").where("kind IS NOT NULL")
    nothing = F.lit(None).cast(links.schema["input"].dataType).alias("input")
    alone = known.where("NOT reached").select(F.lit("unreachable").alias("kind"), "report", nothing)
    lost = roots.where("report IS NOT NULL").distinct().join(have.select("report"), "report", "left_anti").select(F.lit("unknown").alias("kind"), "report", nothing)
    return broken.unionByName(alone).unionByName(lost)


def identity_conflicts(reports: DataFrame, links: DataFrame, roots: DataFrame, columns: list[str]) -> DataFrame:
    """(root, column, values): identities, such as a manifest's fingerprint, on which the reports that ``roots`` rest on don't agree.  Nulls are no value."""
    reached = closure(links, roots)
    rows = reports.join(reached.select("report"), "report", "left_semi")
    counts = rows.agg(*(F.count_distinct(c).alias(c) for c in columns))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("values")) for c in columns))
    return counts.select(F.inline(each)).where("values > 1")
