import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedflow.operators import inventory as I
from embedflow.operators import retrieval as R


def test_candidates(spark):
    df = spark.createDataFrame([(1, "5", ["7", "5", "7", None]), (2, "8", None), (3, None, ["x"])], "q_id int, positive string, negatives array<string>")
    assert sorted((r.q_id, r.doc_id, r.place) for r in R.candidates(df).where("doc_id IS NOT NULL").collect()) == [(1, 5, 0), (1, 7, 1), (2, 8, 0)]
    assert sorted(r.doc_id for r in R.wanted(df).collect()) == [5, 7, 8]


def test_metrics(spark):
    s = spark.createDataFrame([(1, d, p, x) for d, p, x in ((10, 0, 0.5), (11, 1, 0.5), (12, 2, 0.9))] + [(2, 20, 0, 0.1)], "q int, d int, place int, x double")
    ranks = R.ranked(s, "q", F.col("x"), ["place"])
    assert {(r.q, r.d): r["rank"] for r in ranks.collect()} == {(1, 12): 1, (1, 10): 2, (1, 11): 3, (2, 20): 1}
    assert tuple(R.single_relevant(ranks.where("place = 0")).first()) == (2, 0.75, 1.0)
    late = spark.createDataFrame([(11,)], "rank int")
    assert tuple(R.single_relevant(late).first()) == (1, 0.0, 0.0)


def test_ndcg(spark):
    s = spark.createDataFrame([(1, 1, 0.9, 0), (1, 2, 0.8, 3), (1, 3, 0.7, 1), (2, 1, 0.5, 0)], "q int, d int, x double, g int")
    got = {r.q: r.ndcg for r in R.ndcg(s, "q", F.col("x"), F.col("g"), ["d"]).collect()}
    assert got[2] == 0.0 and abs(got[1] - (3 / math.log2(3) + 1 / 2) / (3 + 1 / math.log2(3))) < 1e-6


def test_nearest_prefers_larger_id_on_ties(spark):
    s = spark.createDataFrame([(1, 4, 0.5), (1, 9, 0.5), (1, 2, 0.1)], "q int, d int, x double")
    assert tuple(R.nearest_with_margin(s, "q", "d", F.col("x")).first()) == (1, 9, 0.0)


def test_parity_fails_on_nan(spark):
    nan = float("nan")
    a = spark.createDataFrame([(1, [1.0, 0.0]), (2, [nan, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "k int, v array<double>")
    b = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, [0.0, 1.0])], "k int, v array<double>")
    assert {r.k: (r.fails, r.non_finite) for r in R.parity(a, b, "k", "v", 1e-4).collect()} == {1: (False, 0), 2: (True, 1), 3: (True, 0), 4: (True, 0)}


def test_two_medians(spark):
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 4.0, 8.0)] + [("b", 1.0)], "k string, v double")
    got = {r.k: (r.median, r.lower_median, r.noisy) for r in R.spread(df, "k", "v").collect()}
    assert got == {"a": (3.0, 4.0, True), "b": (1.0, 1.0, False)}


def test_inventory(spark):
    a = spark.createDataFrame([(1, i, o) for i, o in enumerate("xxyz", 1)], "run int, seq_no int, op string")
    b = spark.createDataFrame([(1, i, o) for i, o in enumerate("xxz", 1)], "run int, seq_no int, op string")
    assert {r.op: r.delta for r in I.op_deltas(a, b, "run").collect()} == {"x": 0, "y": -1, "z": 0}
    assert I.first_divergence(a, b, "run").first().seq_no == 3 and I.first_divergence(a, a, "run").count() == 0
    p = I.prologue(a.withColumn("fast", F.col("op") == "y"), "run").first()
    assert (p.prologue, p.stragglers, p.ceiling) == (2, 1, 0.25)
    assert I.prologue(a.withColumn("fast", F.lit(False)), "run").first().prologue == 4


def test_top_k_is_cut_before_the_shuffle(spark):
    s = spark.range(1000).selectExpr("id % 3 AS q", "id AS d", "cast(id AS double) AS x")
    plan = R.ranked(s, "q", F.col("x"), ["d"], 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 1001, 20_000])
def test_medians(spark, n):
    """Both medians are exact, also where half of the values are one, and in a group of a null name."""
    rng = np.random.default_rng(n)
    groups = {"a": rng.lognormal(size=n), "b": np.where(rng.random(n) < 0.5, 7.0, rng.random(n) * 14), None: np.full(n, 2.5)}
    df = spark.createDataFrame([(g, float(v)) for g, values in groups.items() for v in values] + [("a", None), ("empty", None)], "g string, v double")
    got = {r.g: r for r in R.spread(df.repartition(5), "g", "v").collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        r, s = got[g], np.sort(values)
        assert (r.n, r.least, r.most, r.lower_median) == (n, s[0], s[-1], s[n // 2])
        assert r.median == pytest.approx(np.median(values), rel=1e-12)
        assert r.noisy == ((s[-1] - s[0]) / np.median(values) > 0.25)


def test_queries_meet_all_rows_in_blocks(spark):
    rows, queries = spark.range(500).withColumn("x", F.col("id") * 2), spark.range(0, 500, 100).withColumnRenamed("id", "q")
    got = R.met_in_blocks(rows, "id", queries, "q", block_rows=7, block_queries=2)
    assert sorted(got.columns) == ["id", "q", "x"] and got.count() == got.distinct().count() == 2500
    assert R.met_in_blocks(rows.limit(0), "id", queries, "q").count() == R.met_in_blocks(rows, "id", queries.limit(0), "q").count() == 0
