"""Relational queries over the star tables: pricing, joins, top-k, semi and anti joins, set operations, streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..registry import query
from ..sources.tables import table


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02 00:00:00'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def revenue_by_nation(spark, sf_dir):
    l, o, s, n = (table(spark, sf_dir, x) for x in ("lineitem", "orders", "supplier", "nation"))
    rows = l.join(o, l.l_orderkey == o.o_orderkey).join(s, l.l_suppkey == s.s_suppkey).join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    return rows.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1")
def semi_join_priority(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey")
    return o.join(l, o.o_orderkey == l.l_orderkey, "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY 1")
def anti_join_segments(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").select("o_custkey")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def nations_of_both(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem")
def parts_never_sold(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey").subtract(table(spark, sf_dir, "lineitem").select("l_partkey"))


@query()
def online_codebook(spark, sf_dir):
    """Centers after batches of vectors, by exponential averages; a replayed batch changes nothing."""
    from ..streaming.online import OnlineCodebook

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), F.pmod(F.xxhash64("vec_id"), F.lit(4)).alias("part"))
    first = rows.groupBy("part").agg(F.min_by("x", "vec_id").alias("x")).orderBy("part").collect()
    book = OnlineCodebook(np.array([r["x"] for r in first]))
    for k in (0, 1, 1, 2, 3):
        book.update(rows.where(F.col("part") == k), k)
    return spark.createDataFrame([(k, c.tolist(), float(n)) for k, (c, n) in enumerate(zip(book.centers, book.size, strict=True))], "code int, center array<double>, size double")
