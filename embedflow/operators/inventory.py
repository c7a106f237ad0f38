"""Sequences of operations: counts, differences, first divergence and placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def op_counts(ops: DataFrame, by: str) -> DataFrame:
    """(by, op, n, share)."""
    counts = ops.groupBy(by, "op").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(by)), 6))


def op_deltas(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(by, op, delta): b's count less a's, also where one side lacks the operation."""
    x = a.groupBy(by, "op").agg(F.count("*").alias("x"))
    y = b.groupBy(by, "op").agg(F.count("*").alias("y"))
    return x.join(y, [by, "op"], "full_outer").select(by, "op", (F.coalesce("y", F.lit(0)) - F.coalesce("x", F.lit(0))).alias("delta"))


def first_divergence(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(by, seq_no): the first position at which two sequences (by, seq_no, op) differ; no row where they agree."""
    both = a.select(by, "seq_no", F.col("op").alias("x")).join(b.select(by, "seq_no", F.col("op").alias("y")), [by, "seq_no"], "full_outer")
    return both.where(~F.col("x").eqNullSafe(F.col("y"))).groupBy(by).agg(F.min("seq_no").alias("seq_no"))


def prologue(ops: DataFrame, by: str) -> DataFrame:
    """(by, prologue, stragglers, ceiling) of (by, seq_no, fast)."""
    lead = F.coalesce(F.min(F.when(F.col("fast"), F.col("seq_no"))), F.count("*") + 1) - 1
    out = ops.groupBy(by).agg(lead.alias("prologue"), F.count_if(~F.col("fast")).alias("_slow"), F.round(F.avg(F.col("fast").cast("double")), 6).alias("ceiling"))
    return out.select(by, "prologue", (F.col("_slow") - F.col("prologue")).alias("stragglers"), "ceiling")


def op_totals(ops: DataFrame, by: str, is_constant: Column) -> DataFrame:
    """(by, total, constants, compute, kinds): constants aren't scheduled, so that they would hide a program's real size."""
    out = ops.groupBy(by).agg(F.count("*").alias("total"), F.count_if(is_constant).alias("constants"), F.countDistinct("op").alias("kinds"))
    return out.withColumn("compute", F.col("total") - F.col("constants"))


def placement_changes(a: DataFrame, b: DataFrame, by: str, compared: tuple[str, ...] = ("op", "preferred", "supported")) -> DataFrame:
    """(by, seq_no, column, was, now): how b's placement differs from a's, by position; estimated costs and other columns aren't compared.

    A position that only one side has differs in each column that isn't null there.
    """
    side = lambda df, name: df.select(by, "seq_no", F.struct(*[F.col(c).cast("string").alias(c) for c in compared]).alias(name))
    both = side(a, "x").join(side(b, "y"), [by, "seq_no"], "full_outer")
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"x.{c}").alias("was"), F.col(f"y.{c}").alias("now")) for c in compared])
    return both.select(by, "seq_no", F.inline(F.filter(each, lambda c: ~c["was"].eqNullSafe(c["now"]))))
