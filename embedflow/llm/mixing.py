"""Problem 6: sources mixed to target shares of all tokens.

Each source's records, in random order, form blocks of tokens. A splitting tree draws for each half of the output
shards how many blocks of every source it receives (multivariate hypergeometric), down to single shards; the shards
then take disjoint blocks of a seeded permutation and shuffle their records locally. The driver draws the upper part
of the tree, of a bounded size; what is below is drawn where its records are.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedflow.llm._vectors import mix64
from embedflow.llm.tokens import TOKENIZER, token_sizes
from embedflow.runtime import materialize


#: The entries (sources x pieces) of the upper part of the tree, which the driver draws
TREE_ENTRIES = 2_000_000
#: Up to so many blocks are drawn by the exact generator
EXACT_BLOCKS = 1_000_000_000


def drawn_blocks(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """How many of `sample` blocks are among the good ones; beyond the generator's range by the normal limit, rounded into the possible range."""
    if good + bad < EXACT_BLOCKS:
        return int(rng.hypergeometric(good, bad, sample)) if good and sample else 0
    whole = good + bad
    mean = good * sample // whole
    spread = math.sqrt(sample / whole * (good / whole) * (bad / whole) * (whole - sample) * (whole / max(whole - 1, 1)))
    return min(max(mean + round(rng.normal() * spread), sample - bad, 0), good, sample)


def split_quotas(quota: list[int], bounds: np.ndarray, seed: int) -> np.ndarray:
    """Blocks of each source in each piece: (pieces, sources). A piece is a range of shards, bounds[i] to bounds[i + 1].

    Pieces receive blocks in proportion to their shards, up to one block a level. Each node of the tree has a generator of its own,
    seeded by its range, so that any part of the tree can be drawn anywhere.
    """
    out = np.zeros((len(bounds) - 1, len(quota)), np.int64)
    todo = [([int(q) for q in quota], 0, len(bounds) - 1)]
    while todo:
        q, first, last = todo.pop()
        if last - first == 1:
            out[first] = q
            continue
        mid = (first + last) // 2
        start, middle, end = (int(bounds[i]) for i in (first, mid, last))
        rng = np.random.default_rng([seed, start, end])
        rest, need, left = sum(q), sum(q) * (middle - start) // (end - start), []
        for n in q:
            rest -= n
            left.append(drawn_blocks(rng, n, rest, need))
            need -= left[-1]
        todo += [(left, first, mid), ([a - b for a, b in zip(q, left)], mid, last)]
    return out


@lru_cache(maxsize=64)
def _lower_part(quota: tuple[int, ...], first: int, last: int, seed: int) -> np.ndarray:
    """Blocks up to and with each shard of a piece: (shards, sources)."""
    return np.cumsum(split_quotas(list(quota), np.arange(first, last + 1), seed), axis=0)


def permuted(block: np.ndarray, n: int, seed: int) -> np.ndarray:
    """The places of blocks in a seeded permutation of range(n): a Feistel network on the next even power of two, walked until a place is below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, keys = np.uint64((1 << half) - 1), np.random.default_rng([seed, n]).integers(0, 1 << 63, 6, np.uint64)

    def network(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & low
        for key in keys:
            left, right = right, left ^ (mix64(mix64(right + key) + key) & low)
        return left << np.uint64(half) | right

    out = network(np.asarray(block, np.uint64))
    while len(over := np.flatnonzero(out >= n)):
        out[over] = network(out[over])
    return out.astype(np.int64)


def planned_quotas(targets: dict[str, tuple[float, int]], totals: dict[str, int]) -> dict[str, int]:
    """Tokens to draw of each source: the largest mix in which no source exceeds its repeats.

    Sources without tokens can't be drawn; the shares of the others are scaled to sum to 1.
    """
    usable = {s: (w, r) for s, (w, r) in targets.items() if totals.get(s, 0) > 0 and w > 0 and r > 0}
    whole = sum(w for w, _ in usable.values())
    if not usable:
        return {}
    size = min(r * totals[s] / (w / whole) for s, (w, r) in usable.items())
    return {s: math.floor(size * w / whole) for s, (w, _) in usable.items()}


def mixed_sources(
    documents: DataFrame,
    targets: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    tokenizer: str = TOKENIZER,
    block_tokens: int = 8192,
    shard_tokens: int = 2_000_000,
    most_sources: int = 10_000,
    fill_rounds: int = 8,
    seed: int = 17,
) -> DataFrame:
    """(shard, position, source, id, copy, n_tokens, target_share, reached_share): the mix, one row for each use of a record.

    targets: (source, target_share, max_repeats), at most most_sources rows; the same source may not come twice.
    Names are compared trimmed and in lower case; records of other or null sources, without tokens or without id take
    no part. reached_share is the source's share of all tokens of the mix. Each source's tokens are met from
    below: the cut of its order leaves less than a record open, which up to fill_rounds unused records, the best fitting
    each time, then take. The number of shards follows the tokens, without a limit. Copies under other ids count as
    records of their own; an empty frame gives an empty one.
    """
    spark = documents.sparkSession
    # trim() takes U+0020 alone
    name = lambda c: F.lower(F.regexp_replace(F.col(f"`{c}`"), r"(?U)^\s+|\s+$", ""))
    wanted = targets.select(name("source").alias("source"), F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("r")).where("source IS NOT NULL").limit(most_sources + 1).collect()
    if len(wanted) > most_sources or len({x.source for x in wanted}) != len(wanted):
        raise ValueError(f"targets must be at most {most_sources} rows with distinct sources")
    plan = {x.source: (x.w or 0.0, x.r or 0) for x in wanted}
    listed = spark.createDataFrame([(s, w, r) for s, (w, r) in plan.items()], "source string, w double, r int")
    own = documents.where(F.col(f"`{id_col}`").isNotNull()).withColumn("_s", name(source_col)).join(F.broadcast(listed.select(F.col("source").alias("_s"))), "_s", "left_semi")
    sizes = materialize(token_sizes(own, id_col, text_col, tokenizer, source=F.col("_s")).where("n_tokens > 0"), "sizes")
    per_source = {x.source: (x.n, x.t) for x in sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    quota = planned_quotas(plan, {s: t for s, (_, t) in per_source.items()})
    names = sorted(quota)
    blocks = [max(1, -(-quota[s] // block_tokens)) for s in names]
    shards = max(1, -(-sum(quota.values()) // shard_tokens))
    pieces = min(shards, max(1, TREE_ENTRIES // max(1, len(names))))
    bounds = np.array([i * shards // pieces for i in range(pieces + 1)], np.int64)
    # sources x pieces numbers, bounded by TREE_ENTRIES
    upper = split_quotas(blocks, bounds, seed)
    box = spark.sparkContext.broadcast((dict(zip(names, range(len(names)))), blocks, bounds, upper, np.cumsum(upper, axis=0)))

    # positions in a random order of each source: sums before a bucket, then within it, so that no task holds a source
    buckets = max(64, sum(n for n, _ in per_source.values()) // 4096)
    drawn = spark.createDataFrame([(s, quota[s], per_source[s][1], plan[s][1]) for s in names], "source string, quota long, total long, r int")
    keyed = sizes.join(F.broadcast(drawn), "source").withColumn("h", F.xxhash64("id", F.lit(seed))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    before = keyed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("t"))
    before = before.select("source", "bucket", (F.sum("t").over(Window.partitionBy("source").orderBy("bucket")) - F.col("t")).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(before, ["source", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    # a record is used once for each time that its place in the endless repetition of the order lies before the cut
    times = F.greatest(F.lit(0), F.least(F.col("r").cast("long"), F.floor((F.col("quota") - F.col("n_tokens") - F.col("start")) / F.col("total")) + 1)).cast("int")
    placed = materialize(placed.select("source", "id", "n_tokens", "start", "quota", "total", "r", times.alias("times")), "placed")
    kept = placed.where("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1)))
    kept = kept.select("source", "id", "copy", "n_tokens", (F.col("start") + F.col("copy") * F.col("total")).alias("at"))
    # what the cut leaves open in a source, less than a record, is met by the unused record that fits best, a few times
    met = placed.where("times > 0").groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("met"))
    gap = drawn.join(met, "source", "left").select("source", (F.col("quota") - F.coalesce("met", F.lit(0))).alias("gap"))
    spare = placed.where("times < r").join(F.broadcast(gap), "source").where("n_tokens <= gap").withColumn("at", F.col("start") + F.col("times") * F.col("total"))
    # of each size a few; the sizes of a source that fit are fewer than the tokens of its longest record
    few = spare.withColumn("n", F.row_number().over(Window.partitionBy("source", "n_tokens").orderBy("at", "id"))).where(F.col("n") <= fill_rounds)

    def fill(t: pd.DataFrame) -> pd.DataFrame:
        t, rows = t.sort_values(["n_tokens", "at", "id"], ascending=[False, True, True]), []
        open_tokens = int(t["gap"].iloc[0])
        for i, n in enumerate(t["n_tokens"].tolist()):
            if n <= open_tokens and len(rows) < fill_rounds:
                rows.append(i)
                open_tokens -= n
        return t.iloc[rows].assign(copy=lambda x: x["times"], at=lambda x: (x["quota"] - 1).clip(lower=0))[["source", "id", "copy", "n_tokens", "at"]]

    filled = few.select("source", "id", "n_tokens", "at", "quota", "times", "gap").groupBy("source").applyInPandas(fill, "source string, id long, copy int, n_tokens long, at long")
    used = materialize(kept.unionByName(filled), "used")

    @F.pandas_udf("struct<piece:int,place:long>")
    def piece_of(source: pd.Series, at: pd.Series) -> pd.DataFrame:
        number, count, _, _, upto = box.value
        piece, place = np.zeros(len(source), np.int32), np.zeros(len(source), np.int64)
        for s in source.unique():
            m, k = (source == s).to_numpy(), number[s]
            place[m] = permuted(np.minimum(at[m].to_numpy() // block_tokens, count[k] - 1), count[k], seed + k)
            piece[m] = np.searchsorted(upto[:, k], place[m], side="right")
        return pd.DataFrame({"piece": piece, "place": place})

    @F.pandas_udf("long")
    def shard_of(source: pd.Series, piece: pd.Series, place: pd.Series) -> pd.Series:
        number, _, bound, part, upto = box.value
        out = bound[piece.to_numpy()].astype(np.int64)
        for (p, s), own in place.groupby([piece, source]).indices.items():
            if bound[p + 1] - bound[p] > 1:
                k = number[s]
                inside = place.to_numpy()[own] - (upto[p, k] - part[p, k])
                out[own] += np.searchsorted(_lower_part(tuple(part[p].tolist()), int(bound[p]), int(bound[p + 1]), seed)[:, k], inside, side="right")
        return pd.Series(out)

    # one shuffle by piece serves the lower part of the tree and the order of each shard: a shard is in one piece
    mix = used.withColumn("_p", piece_of("source", "at")).select("source", "id", "copy", "n_tokens", "_p.piece", "_p.place")
    if pieces < shards:
        mix = mix.repartition("piece").sortWithinPartitions("piece")
    mix = mix.withColumn("shard", shard_of("source", "piece", "place"))
    reached = used.groupBy("source").agg(F.sum("n_tokens").alias("t"))
    share = reached.select("source", (F.col("t") / F.sum("t").over(Window.partitionBy())).alias("reached_share")).join(F.broadcast(listed.select("source", F.col("w").alias("target_share"))), "source")
    position = F.row_number().over(Window.partitionBy("piece", "shard").orderBy(F.xxhash64("id", "copy", F.lit(seed + 1)), "id", "copy"))
    # one row a source
    return mix.withColumn("position", position).join(F.broadcast(share), "source").select("shard", "position", "source", "id", "copy", "n_tokens", "target_share", "reached_share")


def source_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, records): a row for each target source, also those without records."""
    got = mix.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.countDistinct("id").alias("records"), F.max("reached_share").alias("reached_share"))
    wanted = targets.select(F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", "")).alias("source"), "target_share")
    zero = F.lit(0).cast("long")
    return wanted.join(got, "source", "left").select("source", "target_share", F.coalesce("reached_share", F.lit(0.0)).alias("reached_share"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("records", zero).alias("records"))
