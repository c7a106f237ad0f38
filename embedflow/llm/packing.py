"""Problem 5: texts packed into containers of fixed capacity by the sum-of-squares rule."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedflow.llm.tokens import TOKENIZER, token_sizes
from embedflow.runtime import materialize


#: Up to this capacity the counts of open containers are looked at for every gap, beyond it for the gaps that occur
EVERY_GAP = 1 << 16


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, in the order given; sizes are 1..capacity.

    N(g) is the number of open containers with g tokens left. An item goes where the sum of the squared counts
    becomes smallest, into an open container or a new one; on a tie into the fullest.
    """
    pick = _every_gap if capacity <= EVERY_GAP else _gaps_that_occur
    stacks: dict[int, list[int]] = {}
    out, made, counts = np.empty(len(sizes), np.int64), 0, pick(capacity)
    for i, s in enumerate(sizes.tolist()):
        gap = counts.best(s)
        if gap is None:
            gap, number, made = capacity, made, made + 1
        else:
            number = stacks[gap].pop()
            counts.add(gap, -1)
        out[i] = number
        if gap > s:
            stacks.setdefault(gap - s, []).append(number)
            counts.add(gap - s, 1)
    return out


class _every_gap:
    def __init__(self, capacity: int):
        self.capacity, self.n = capacity, np.zeros(capacity + 1, np.int64)

    def add(self, gap: int, by: int) -> None:
        self.n[gap] += by

    def best(self, s: int) -> int | None:
        """The gap that an item of size s goes into; None for a new container."""
        left, gaps = self.n[: self.capacity - s], self.n[s : self.capacity]
        if not len(gaps):
            return None
        change = 2 * (left - gaps) + 2
        change[0] -= 1
        change[gaps == 0] = np.iinfo(np.int64).max
        at = int(change.argmin())
        return at + s if gaps[at] and change[at] <= 2 * int(self.n[self.capacity - s]) + 1 else None


class _gaps_that_occur:
    """The same with the gaps in order and their counts, for capacities far beyond the number of open containers."""

    def __init__(self, capacity: int):
        self.capacity, self.gaps, self.n = capacity, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, gap: int, by: int) -> None:
        at = int(np.searchsorted(self.gaps, gap))
        if at < len(self.gaps) and self.gaps[at] == gap:
            self.n[at] += by
            if not self.n[at]:
                self.gaps, self.n = np.delete(self.gaps, at), np.delete(self.n, at)
        else:
            self.gaps, self.n = np.insert(self.gaps, at, gap), np.insert(self.n, at, by)

    def count(self, gaps: np.ndarray) -> np.ndarray:
        if not len(self.gaps):
            return np.zeros(len(gaps), np.int64)
        at = np.searchsorted(self.gaps, gaps).clip(max=len(self.gaps) - 1)
        return np.where(self.gaps[at] == gaps, self.n[at], 0)

    def best(self, s: int) -> int | None:
        fit = int(np.searchsorted(self.gaps, s))
        gaps = self.gaps[fit:]
        if s == self.capacity or not len(gaps):
            return None
        change = 2 * (self.count(gaps - s) - self.n[fit:]) + 2
        change[gaps == s] -= 1
        at = int(change.argmin())
        return int(gaps[at]) if change[at] <= 2 * int(self.count(np.array([self.capacity - s]))[0]) + 1 else None


def packed_containers(
    documents: DataFrame,
    containers: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    shard_items: int = 50_000,
    most_kinds: int = 1000,
) -> DataFrame:
    """(container_kind, capacity_tokens, container_id, container_fill, id, piece_no, first_token, n_tokens).

    containers holds (container_kind, capacity_tokens): each row is a task of its own, at most most_kinds of them;
    rows without a kind or a positive capacity are refused. A text of at most the capacity stays whole. A longer
    one is cut into full pieces and a rest; the full pieces fill containers of their own, the rest is packed like a
    text. Items are packed largest first within shards of about shard_items ids, drawn by hash, so that no task
    grows with the input. Texts without tokens (null, empty) and null ids take no part; copies are packed as often
    as they occur; an empty frame gives an empty one.
    """
    kinds = containers.select("container_kind", F.col("capacity_tokens").cast("int").alias("c")).limit(most_kinds + 1).collect()
    if len(kinds) > most_kinds or any(k.container_kind is None or not k.c or k.c < 1 for k in kinds):
        raise ValueError(f"containers must be at most {most_kinds} rows, each with a kind and a positive capacity")
    sizes = materialize(token_sizes(documents, id_col, text_col, tokenizer).where("id IS NOT NULL AND n_tokens > 0"), "sizes")
    shards = max(1, -(-sizes.count() // shard_items))
    tasks = F.array(*[F.struct(F.lit(k.container_kind).alias("container_kind"), F.lit(k.c).alias("capacity_tokens")) for k in kinds]) if kinds else F.expr("array_repeat(named_struct('container_kind', '', 'capacity_tokens', 1), 0)")
    items = sizes.select("id", "n_tokens", F.inline(tasks)).withColumn("full", F.when(F.col("n_tokens") > F.col("capacity_tokens"), F.expr("n_tokens div capacity_tokens")).otherwise(0))
    whole = items.where("full > 0").select("container_kind", "capacity_tokens", "id", F.explode(F.expr("sequence(0L, full - 1)")).alias("piece")).select(
        "container_kind", "capacity_tokens",
        F.concat_ws(":", "container_kind", F.lit("full"), "id", "piece").alias("container_id"), F.col("capacity_tokens").cast("long").alias("container_fill"),
        "id", F.col("piece").cast("int").alias("piece_no"), (F.col("piece") * F.col("capacity_tokens")).alias("first_token"), F.col("capacity_tokens").cast("long").alias("n_tokens"),
    )
    rest = items.select(
        "container_kind", "capacity_tokens", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id",
        F.col("full").cast("int").alias("piece_no"), (F.col("full") * F.col("capacity_tokens")).alias("first_token"),
        (F.col("n_tokens") - F.col("full") * F.col("capacity_tokens")).alias("n_tokens"),
    ).where("n_tokens > 0")

    names = whole.columns

    def pack(t: pa.Table) -> pa.Table:
        kind, capacity, shard = (t[c][0].as_py() for c in ("container_kind", "capacity_tokens", "shard"))
        t = t.sort_by([("n_tokens", "descending"), ("id", "ascending")])
        size = t["n_tokens"].to_numpy()
        number = sum_of_squares(size, capacity)
        fill = np.bincount(number, weights=size).astype(np.int64)
        ids = pa.array([f"{kind}:{shard}:{b}" for b in number.tolist()])
        return pa.table([t["container_kind"], t["capacity_tokens"], ids, pa.array(fill[number]), t["id"], t["piece_no"], t["first_token"], t["n_tokens"]], names=names)

    schema = "container_kind string, capacity_tokens int, container_id string, container_fill long, id long, piece_no int, first_token long, n_tokens long"
    return whole.unionByName(rest.groupBy("container_kind", "capacity_tokens", "shard").applyInArrow(pack, schema))


def container_use(packed: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, use): how much of the opened capacity is filled."""
    per_bin = packed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("t"))
    return per_bin.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.round(F.sum("t") / F.sum("capacity_tokens"), 6).alias("use"))
