"""Ranking, retrieval metrics, separation and parity over vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from embedflow.functions import vectors as V

DEPTH = 10


def candidates(queries: DataFrame) -> DataFrame:
    """(q_id, doc_id, place): the positive first, so that it wins ties, then the negatives; a document counts once."""
    listed = F.filter(F.concat(F.array("positive"), F.coalesce("negatives", F.array().cast("array<string>"))), lambda x: x.isNotNull())
    long = queries.select("q_id", F.posexplode(F.array_distinct(listed)).alias("place", "d"))
    return long.select("q_id", F.col("d").try_cast("long").alias("doc_id"), "place")


def first_queries(queries: DataFrame, n: int, query_col: str = "q_id") -> DataFrame:
    """The rows of the first n different query ids, in their order: a quick look at a benchmark. n is a small number."""
    kept = queries.select(query_col).where(F.col(query_col).isNotNull()).distinct().orderBy(query_col).limit(n)
    return queries.join(F.broadcast(kept), query_col, "left_semi")


def wanted(queries: DataFrame) -> DataFrame:
    """(doc_id): the documents that any query names; embed only these."""
    return candidates(queries).select("doc_id").where("doc_id IS NOT NULL").distinct()


def met_in_blocks(rows: DataFrame, row_id: str, queries: DataFrame, query_id: str, block_rows: int = 65_536, block_queries: int = 4096) -> DataFrame:
    """Every query with every row: for a stated query set. Rows and queries are cut by hash into blocks of the given sizes,
    or smaller ones that keep all cores busy; each row goes once to each block of queries and each query to each block of rows."""
    row_blocks = max(rows.sparkSession.sparkContext.defaultParallelism * 2, -(-rows.count() // block_rows))
    query_blocks = max(1, -(-queries.count() // block_queries))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("_r", block(row_id, row_blocks)).withColumn("_q", every(query_blocks))
    right = queries.withColumn("_q", block(query_id, query_blocks)).withColumn("_r", every(row_blocks))
    return left.join(right, ["_r", "_q"]).drop("_r", "_q")


def ranked(scored: DataFrame, query_col: str, score: Column, tie: list[Column | str], depth: int | None = None) -> DataFrame:
    """Adds rank, from 1, by falling score; equal scores in the order of tie."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(query_col).orderBy(score.desc(), *tie)))
    return out if depth is None else out.where(F.col("rank") <= depth)


def single_relevant(ranks: DataFrame, rank_col: str = "rank", depth: int = DEPTH) -> DataFrame:
    """(queries, map, hit) of the ranks of the one relevant document of each query."""
    in_depth = F.col(rank_col) <= depth
    return ranks.agg(F.count("*").alias("queries"), F.round(F.avg(F.when(in_depth, 1.0 / F.col(rank_col)).otherwise(0.0)), 6).alias("map"), F.round(F.avg(in_depth.cast("double")), 6).alias("hit"))


def ndcg(scored: DataFrame, query_col: str, score: Column, label: Column, tie: list[Column | str], depth: int = DEPTH) -> DataFrame:
    """(query, ndcg) with linear gain; 0 for a query without a relevant document."""
    # the two orders are cut at the depth each, before the shuffle (WindowGroupLimit): a query's documents never meet in one task
    own = scored.withColumn("_g", label).withColumn("_s", score)
    gain = F.sum(F.col("_g") / F.log2(F.col("rank") + 1))
    got = ranked(own, query_col, F.col("_s"), tie, depth).groupBy(query_col).agg(gain.alias("d"))
    ideal = ranked(own, query_col, F.col("_g"), tie, depth).groupBy(query_col).agg(gain.alias("i"))
    return got.join(ideal, query_col).select(query_col, F.round(F.when(F.col("i") > 0, F.col("d") / F.col("i")).otherwise(0.0), 6).alias("ndcg"))


def nearest_with_margin(scored: DataFrame, query_col: str, doc_col: str, score: Column) -> DataFrame:
    """(query, best, margin): the top document, here with ties to the larger id, and its lead over the next."""
    top = ranked(scored.withColumn("_s", score), query_col, F.col("_s"), [F.col(doc_col).desc()], 2)
    return top.groupBy(query_col).agg(F.max(F.when(F.col("rank") == 1, F.col(doc_col))).alias("best"), F.round(F.max("_s") - F.min("_s"), 6).alias("margin"))


def parity(a: DataFrame, b: DataFrame, key: str, vector: str, threshold: float) -> DataFrame:
    """(key, distance, worst, mean, non_finite, fails) of vectors of equal key; missing keys are for an anti-join."""
    x = a.select(key, F.col(vector).alias("x")).join(b.select(key, F.col(vector).alias("y")), key)
    apart = F.zip_with("x", "y", lambda p, q: F.abs(p.cast("double") - q.cast("double")))
    odd = lambda v: F.isnan(v) | (F.abs(v) == float("inf"))
    x = x.select(key, (1 - V.cosine(F.col("x"), F.col("y"))).alias("d"), apart.alias("apart"), (F.size(F.filter("x", odd)) + F.size(F.filter("y", odd))).alias("non_finite"), (F.size("x") != F.size("y")).alias("unlike"))
    fails = F.isnan("d") | (F.col("d") > threshold) | (F.col("non_finite") > 0) | F.col("unlike")
    return x.select(key, F.round("d", 6).alias("distance"), F.round(F.array_max("apart"), 6).alias("worst"), F.round(V.total(F.col("apart")) / F.size("apart"), 6).alias("mean"), "non_finite", F.coalesce(fails, F.lit(True)).alias("fails"))


def spread(values: DataFrame, by: str, value: str, flag_above: float = 0.25, around: float = 5e-5) -> DataFrame:
    """(by, n, least, median, lower_median, most, noisy): the interpolated median and the element at n div 2.

    Both are exact. Sketches say between which values they lie; what is below is counted, and only the distinct values
    between are ordered, about a 2 * around part of a group: the values of a group never meet in one task.
    """
    known = values.where(F.col(value).isNotNull()).select(F.col(by).alias("_g"), F.col(value).alias("_x"))
    ends = F.percentile_approx("_x", F.array(F.lit(0.5 - around), F.lit(0.5 + around)), F.lit(round(5 / around)))
    facts = known.groupBy("_g").agg(F.count("*").alias("n"), F.min("_x").alias("least"), F.max("_x").alias("most"), ends.alias("_ends"))
    facts = facts.withColumn("_r1", F.floor((F.col("n") - 1) / 2) + 1).withColumn("_r2", F.floor(F.col("n") / 2) + 1)
    counted = known.join(facts.select(F.col("_g").alias("_f"), F.col("_ends")[0].alias("_lo"), F.col("_ends")[1].alias("_hi")), F.col("_g").eqNullSafe(F.col("_f")))
    counts = counted.groupBy("_g", F.when(F.col("_x") < F.col("_lo"), 0).when(F.col("_x") <= F.col("_hi"), 1).otherwise(2).alias("_side"), F.when(F.col("_x").between(F.col("_lo"), F.col("_hi")), F.col("_x")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = counts.where("_side < 2").withColumn("_upto", F.sum("_c").over(Window.partitionBy("_g").orderBy("_side", "_v")))
    placed = upto.where("_side = 1").join(facts.select(F.col("_g").alias("_f"), "_r1", "_r2"), F.col("_g").eqNullSafe(F.col("_f")))
    at = lambda r: F.min(F.when(F.col("_upto") >= F.col(r), F.col("_v")))
    middle = placed.groupBy("_g").agg(at("_r1").alias("_m1"), at("_r2").alias("lower_median")).withColumnRenamed("_g", "_f")
    joined = facts.join(middle, F.col("_g").eqNullSafe(F.col("_f")))
    median = F.col("_m1") + (F.col("lower_median") - F.col("_m1")) * F.when(F.col("_r1") == F.col("_r2"), 0.0).otherwise(0.5)
    out = joined.select(F.col("_g").alias(by), "n", "least", median.alias("median"), "lower_median", "most")
    return out.withColumn("noisy", (F.col("most") - F.col("least")) / F.col("median") > flag_above)


def per_token(latencies: DataFrame, length: Column, least: str = "least") -> DataFrame:
    """Adds us_per_token: the least milliseconds of a text over its length; a jump from one length to the next is a cliff."""
    return latencies.withColumn("us_per_token", F.col(least) * 1000 / length)
