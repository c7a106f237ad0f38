"""Length-bucketed batches over a whole table, and what they cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedflow.functions import text as T
from embedflow.operators.running import BUCKET_ROWS, buckets, position


def length_batches(lengths: DataFrame, id_col: str, n_col: str = "n_tokens", batch_size: int = T.BATCH_SIZE, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds batch and pos: rows in the order of length, ties by id, in batches of batch_size.

    The order is global without a global sort: rows are counted below each length, below each id range within a
    length, then ordered within. A range is as wide as bucket_rows rows need on average, so that sparse ids don't get
    a range each.
    """
    width = lengths.agg(F.greatest(F.lit(1.0), (F.max(id_col).cast("double") - F.min(id_col).cast("double") + 1) * bucket_rows / F.count("*")).alias("w")).scalar()
    ranked = position(lengths, [n_col, id_col], [F.col(n_col), *buckets(F.col(id_col), width)], "_rank")
    size = max(1, batch_size)
    return ranked.withColumn("batch", F.floor(F.col("_rank") / size)).withColumn("pos", (F.col("_rank") % size).cast("int")).drop("_rank")


def batch_shapes(batched: DataFrame, n_col: str = "n_tokens") -> DataFrame:
    """(batch, seq, rows, waste, rows_per_forward, units): padded length, padding cells, and the forward passes it takes."""
    shape = batched.groupBy("batch").agg(F.max(n_col).alias("seq"), F.count("*").cast("int").alias("rows"), F.sum(n_col).alias("used"))
    cap = T.rows_per_forward(F.col("seq"))
    return shape.select("batch", "seq", "rows", (F.col("seq") * F.col("rows") - F.col("used")).alias("waste"), cap.alias("rows_per_forward"), F.ceil(F.col("rows") / cap).cast("int").alias("units"))


def chunks_of_long_texts(lengths: DataFrame, id_col: str, full_col: str, limit: int = T.MAX_LENGTH) -> DataFrame:
    """(id, chunk_no, first_token, n): the pieces of limit - 2 tokens of the texts that don't fit; an addition of our own."""
    room = limit - 2
    pieces = lengths.where(F.col(full_col) > room).select(id_col, full_col, F.explode(F.sequence(F.lit(0), F.floor((F.col(full_col) - 1) / room).cast("int"))).alias("chunk_no"))
    first = F.col("chunk_no") * room
    return pieces.select(id_col, "chunk_no", first.alias("first_token"), F.least(F.lit(room), F.col(full_col) - first).alias("n"))
