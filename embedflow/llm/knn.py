"""Problem 2: the k most similar vectors of every vector.

Several median kd-trees, each over its own low-dimensional stable projection, bring a vector together with the
rows of its leaf and of the next leaves by projected distance. Inside such a group the projected neighbours are
taken block by block in the order of projected distance and verified with the full cosine, until a chi-square
test holds: the squared projected distance of a neighbour at distance d is d^2 times a chi-square variable, so no
closer one is to be expected once the next block lies beyond d_k^2 times its quantile.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from embedflow.llm import _vectors as V
from embedflow.runtime import materialize

NEAR = "id long, near array<struct<c:float,neighbour:long>>"


def chi2_quantile(p: float, dof: int) -> float:
    """Wilson-Hilferty approximation with a normal quantile by bisection on erf."""
    lo, hi = -8.0, 8.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (lo, mid)
    a = 2 / (9 * dof)
    return dof * max(0.0, 1 - a + lo * math.sqrt(a)) ** 3


def kd_blocks(p: np.ndarray, rows: int) -> list[np.ndarray]:
    """Indices of p, halved along its axes in turn until no block exceeds rows."""
    todo, done = [(np.arange(len(p)), 0)], []
    while todo:
        at, axis = todo.pop()
        if len(at) <= rows:
            done.append(at)
            continue
        half = len(at) // 2
        at = at[np.argpartition(p[at, axis % p.shape[1]], half)]
        todo += [(at[:half], axis + 1), (at[half:], axis + 1)]
    return done


class Blocks:
    """Rows in blocks of neighbouring projections, searched block by block until the chi-square test holds."""

    def __init__(self, x: np.ndarray, confidence: float, block_rows: int = 1024, axes: int = 4, seed: int = 5):
        self.x, self.axes = x, np.random.default_rng(seed).normal(size=(x.shape[1], axes)).astype(np.float32)
        p = x @ self.axes
        self.members = kd_blocks(p, block_rows)
        self.low, self.high = (np.stack([f(p[m], axis=0) for m in self.members]) for f in (np.min, np.max))
        self.block, self.place = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
        for j, m in enumerate(self.members):
            self.block[m], self.place[m] = j, np.arange(len(m))
        self.stop = chi2_quantile(confidence, axes)

    def search(self, q: np.ndarray, self_at: np.ndarray, best: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """best and who, (queries, k), after the search; self_at: the row that a query itself is, or -1.

        best holds the cosines to be exceeded, falling; who the rows found so far.
        """
        k, pq = best.shape[1], q @ self.axes
        beyond = sum(np.maximum(np.maximum(self.low[None, :, a] - pq[:, a, None], pq[:, a, None] - self.high[None, :, a]), 0) ** 2 for a in range(pq.shape[1]))
        nearest, home = beyond.min(axis=0), np.where(self_at >= 0, self.block[self_at], -1)
        for j in np.argsort(nearest, kind="stable"):
            limit = self.stop * np.maximum(0, 2 - 2 * best[:, -1])
            if nearest[j] > limit.max():
                break
            live = np.flatnonzero(beyond[:, j] <= limit)
            if not len(live):
                continue
            m = self.members[j]
            s = (q if len(live) == len(q) else q[live]) @ self.x[m].T
            own = np.flatnonzero(home[live] == j)
            s[own, self.place[self_at[live[own]]]] = -2
            new = np.flatnonzero(s.max(axis=1) > best[live, -1])
            if not len(new):
                continue
            s, at_new = s[new], live[new]
            few = min(k, s.shape[1])
            at = np.argpartition(s, s.shape[1] - few, axis=1)[:, s.shape[1] - few :]
            both_s = np.hstack([best[at_new], np.take_along_axis(s, at, 1)])
            both_w = np.hstack([who[at_new], m[at]])
            order = np.argsort(-both_s, axis=1, kind="stable")[:, :k]
            best[at_new], who[at_new] = np.take_along_axis(both_s, order, 1), np.take_along_axis(both_w, order, 1)
        return best, who


def group_neighbours(x: np.ndarray, k: int, min_cos: float, confidence: float, block_rows: int = 1024, axes: int = 4, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and cosines of the k nearest rows of each row; -1 where there are fewer of at least min_cos."""
    best = np.full((len(x), k), min_cos - 1e-7, np.float32)
    who = np.full((len(x), k), -1, np.int64)
    if len(x):
        blocks = Blocks(x, confidence, block_rows, axes, seed)
        for own in blocks.members:
            best[own], who[own] = blocks.search(x[own], own, best[own], who[own])
    return who, best


def first_twins(codes: DataFrame, most: int) -> DataFrame:
    """(h, rep, n, ids): of each code that several ids have the least ids, at most `most` of them, n of them, and the least.

    Ranks are cut before the shuffle, so that a code that most rows have is no hot spot.
    """
    ranked = codes.select("h", "id", F.dense_rank().over(Window.partitionBy("h").orderBy("id")).alias("r")).where(F.col("r") <= most)
    listed = ranked.groupBy("h").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return listed.select("h", F.col("ids")[0].alias("rep"), F.size("ids").alias("n"), "ids").where("n > 1")


def nearest_vectors(
    df: DataFrame,
    id_col: str = "out_id",
    vector_col: str = "embedding",
    k: int = 5,
    dim: int = 96,
    min_cos: float = -1.0,
    trees: int = 3,
    probes: int = 3,
    leaf_rows: int = 2048,
    confidence: float = 0.95,
    sample_rows: int = 65_536,
    seed: int = 11,
    beyond_trees: bool = False,
    cell_rows: int = 32_768,
) -> DataFrame:
    """(id, neighbour, cosine, rank): up to k other ids of highest cosine, of at least min_cos, for each usable vector.

    Usable: dim finite values, not all zero; other rows, null ids and null vectors have no result. An id that is
    delivered again counts once. Equal vectors under other ids are neighbours with cosine 1; equal cosines are
    ranked by id. An empty frame gives an empty one. Cosines are those of 12 bit codes (error about 1e-4).
    The search is approximate; see the README for the recall measured. With beyond_trees, a search goes on beyond the
    leaves until a chi-square test holds (search_beyond), which far neighbours need; without, it ends there, which
    finds nearly all neighbours of a cosine of 0.75 or more. sample_rows bounds the sample on which the
    cuts of the trees are fitted; all rows are indexed and all rows are queries.
    """
    vectors = V.vectors_of(df, id_col, vector_col)
    codes = V.coded(vectors, dim, 12)
    twins = materialize(first_twins(codes, k + 1), "twins")
    forest = V.fit_forest(vectors, dim, trees, probes, leaf_rows, sample_rows, seed, twins, 12)

    def search(t: pa.Table) -> pa.Table:
        ids, x, n = V.group_matrix(t, dim, 12)
        who, cos = group_neighbours(x, k, min_cos, confidence)
        has = np.flatnonzero((who[:, 0] >= 0) | (n > 1))
        return near_lists(ids[has], who[has], cos[has], ids)

    first = V.first_rows(codes, twins)
    if beyond_trees:
        first = materialize(first, "first")
    found = V.routed(first, forest, dim, 12).groupBy("grp").applyInArrow(search, NEAR)
    near = nearest_found(found, k)
    if beyond_trees:
        near = materialize(near, "near")
        more = search_beyond(first, near, forest, dim, k, min_cos, confidence, cell_rows)
        near = near if more is None else nearest_found(near.union(more), k)
    return df.sparkSession.sql(
        """
        -- a neighbour stands for all that equal it
        WITH spread AS (SELECT n.id, n.e.c, explode(coalesce(t.ids, array(n.e.neighbour))) AS neighbour FROM (SELECT id, explode_outer(near) AS e FROM {near}) n LEFT JOIN {twins} t ON n.e.neighbour = t.rep),
             lists AS (SELECT id, slice(sort_array(collect_list(struct(c, neighbour)) FILTER (WHERE neighbour IS NOT NULL)), 1, {k}) AS near FROM spread GROUP BY id),
             -- fewer than k others equal it: they come first; else they are all
             few AS (SELECT explode(CASE WHEN t.ids IS NULL THEN array(l.id) WHEN t.n <= {k} THEN t.ids ELSE array() END) AS id, t.ids, l.near FROM lists l LEFT JOIN {twins} t ON l.id = t.rep),
             many AS (SELECT DISTINCT c.id, t.ids FROM {codes} c JOIN {twins} t ON c.h = t.h WHERE t.n > {k}),
             every AS (SELECT id, slice(concat(transform(filter(coalesce(ids, array()), i -> i <> id), i -> struct(CAST(-1 AS FLOAT) AS c, i AS neighbour)), near), 1, {k}) AS near FROM few
                       UNION ALL SELECT id, slice(transform(filter(ids, i -> i <> id), i -> struct(CAST(-1 AS FLOAT) AS c, i AS neighbour)), 1, {k}) FROM many)
        SELECT id, n.neighbour, -n.c AS cosine, pos + 1 AS rank FROM (SELECT id, posexplode(near) AS (pos, n) FROM every)
        """,
        near=near, twins=twins, codes=codes.select("id", "h"), k=k,
    )


def nearest_found(found: DataFrame, k: int) -> DataFrame:
    """(id, near): the k nearest of all entries found for an id, each neighbour once. A group gives an id k entries at most."""
    lists = found.groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near"))
    return found.sparkSession.sql(
        """
        SELECT id, transform(best, b -> struct(cs[array_position(others, b) - 1] AS c, b AS neighbour)) AS near
        FROM (SELECT id, near.c AS cs, near.neighbour AS others, slice(array_distinct(near.neighbour), 1, {k}) AS best FROM {lists})
        """,
        lists=lists, k=k,
    )


def near_lists(ids: np.ndarray, who: np.ndarray, cos: np.ndarray, names: np.ndarray) -> pa.Table:
    """(id, near) of neighbour numbers (-1: none) and cosines; c is the negative cosine, so that lists sort by nearness."""
    size = (who >= 0).sum(axis=1)
    take = np.arange(who.shape[1])[None, :] < size[:, None]
    near = pa.StructArray.from_arrays([pa.array(-cos[take]), pa.array(names[who[take]])], names=["c", "neighbour"])
    return pa.table({"id": pa.array(ids), "near": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), near)})


def search_beyond(first: DataFrame, near: DataFrame, forest: V.Forest, dim: int, k: int, min_cos: float, confidence: float, cell_rows: int) -> DataFrame | None:
    """(id, near) for the rows of first whose search the trees don't end; None where there are none.

    A search has ended once a neighbour nearer than the k-th one found would, by the chi-square test on the gaps to
    the leaves left out, have been met in one of the trees. The others go on to the cells of the first tree in
    question, of about cell_rows rows each, as far as the test on the projected distance of a cell demands; where vectors are
    nearly isotropic that is every cell. A query set against all rows in blocks: queries are cut by hash into
    sets of about cell_rows, and each set meets each cell in a task of its own.
    """
    kth = near.select("id", (-F.get("near.c", F.lit(k - 1))).alias("least"))
    joined = first.where(F.col("n") <= k).join(kth, "id", "left").select("id", "code", F.coalesce("least", F.lit(min_cos)).cast("float").alias("least"))
    box = first.sparkSession.sparkContext.broadcast(forest)

    def still_open(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                share = box.value.met(V.unpacked(b.column("code"), dim, 12), b.column("least").to_numpy())
                yield b.filter(pa.array(share < confidence))

    asking = materialize(joined.mapInArrow(still_open, "id long, code binary, least float"), "asking")
    n = asking.count()
    if n == 0:
        return None
    sets = -(-n // cell_rows)
    levels = max(0, min(len(forest.cuts[0]), round(math.log2(max(forest.rows, 1) / cell_rows))))
    stop = chi2_quantile(confidence, levels) if levels else 0.0
    schema, names = "cell long, part int, id long, code binary, least float", ["cell", "part", "id", "code", "least"]

    def place(asks: bool):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            # a slice at a time, whatever the number of cells and sets; a row's copies stay together, as they pack well
            step = max(1, 16_384 // max(sets, 1 << levels))
            for b in (whole.slice(start, step) for whole in batches for start in range(0, whole.num_rows, step)):
                apart = box.value.cell_distances(V.unpacked(b.column("code"), dim, 12), levels)
                if asks:  # to each cell in question
                    row, cell = np.nonzero(apart <= (stop * np.maximum(0, 2 - 2 * b.column("least").to_numpy()))[:, None])
                    part = (V.mix64(b.column("id").to_numpy()) % np.uint64(sets))[row]
                else:  # to each set, in its cell
                    row, part = np.repeat(np.arange(b.num_rows), sets), np.tile(np.arange(sets), b.num_rows)
                    cell = apart.argmin(axis=1)[row]
                own = b.take(pa.array(row))
                least = own.column("least") if asks else pa.nulls(len(row), pa.float32())
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(part.astype(np.int32)), own.column("id"), own.column("code"), least], names=names)

        return run

    def compare(t: pa.Table) -> pa.Table:
        asks = np.asarray(t["least"].combine_chunks().is_valid())
        x, ids, least = V.unpacked(t["code"], dim, 12), t["id"].to_numpy(), t["least"].to_numpy()[asks]
        q, q_ids = x[asks], ids[asks]
        x, order = x[~asks], np.argsort(ids[~asks])
        x, ids = x[order], ids[~asks][order]
        best, who = np.repeat(least[:, None], k, axis=1).astype(np.float32), np.full((len(q), k), -1, np.int64)
        if len(q) and len(x):
            at = np.searchsorted(ids, q_ids).clip(max=len(ids) - 1)
            at[ids[at] != q_ids] = -1
            blocks = Blocks(x, confidence, 2048, 8)
            for own in kd_blocks(q @ blocks.axes, 1024):
                best[own], who[own] = blocks.search(q[own], at[own], best[own], who[own])
        has = np.flatnonzero(who[:, 0] >= 0)
        return near_lists(q_ids[has], who[has], best[has], ids)

    rows = first.select("id", "code").mapInArrow(place(False), schema)
    return asking.mapInArrow(place(True), schema).union(rows).groupBy("cell", "part").applyInArrow(compare, NEAR)


def similar_pairs(near: DataFrame) -> DataFrame:
    """Undirected pairs of a neighbour table, each once."""
    a, b = V.distinct_pairs(F.col("id"), F.col("neighbour"))
    return near.select(a.alias("a"), b.alias("b")).distinct()
