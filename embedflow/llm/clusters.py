"""Problem 4: clusters of mutually similar vectors, by grids.

The method named counts the rows of grid cells and joins adjacent dense cells; on these vectors that finds about a
fifth of the members at best (figures in the README), so that the density of a cell is refined to the links of its
rows. The features are projections of the vectors; each grid quantises a few of them at the medians of its cells. Every
cell links all of its rows by their cosine, and what is linked there forms a piece: cells aren't counted, and no
dense ones are selected. Cells are adjacent where they hold the same row: every row also stands in the cell across
its nearest border, and in a cell of every grid. Minimum labels are propagated over rows and pieces until nothing
changes. The density of a row is the most links seen in one cell, not its links in the whole cluster.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedflow.llm import _vectors as V
from embedflow.runtime import drop, materialize


def linked_pieces(x: np.ndarray, min_cos: float, block_rows: int = 512, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """For each row the smallest row number of its connected piece, and how many rows it is linked to.

    A row that stands for several copies counts so often; its copies are linked to each other.
    """
    n = len(x)
    copies = np.ones(n, np.int64) if copies is None else copies
    label, degree = np.arange(n), copies - 1
    for start in range(0, n, block_rows):
        own = x[start : start + block_rows]
        hit = own @ x[start:].T >= min_cos
        hit &= np.arange(n - start)[None, :] > np.arange(len(own))[:, None]
        r, c = np.nonzero(hit)
        degree[start : start + len(own)] += np.bincount(r, weights=copies[start + c], minlength=len(own)).astype(np.int64)
        degree[start:] += np.bincount(c, weights=copies[start + r], minlength=n - start).astype(np.int64)
        left, right = label[start + r], label[start + c]
        apart = left != right
        if not apart.any():
            continue
        root = {}

        def top(v: int) -> int:
            while (u := root.get(v, v)) != v:
                v = u
            return v

        for key in np.unique(np.minimum(left[apart], right[apart]) * n + np.maximum(left[apart], right[apart])).tolist():
            a, b = top(key // n), top(key % n)
            if a != b:
                root[max(a, b)] = min(a, b)
        moved = np.arange(n)
        for v in root:
            moved[v] = top(v)
        label = moved[label]
    return label, degree


def propagate_minimum(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node reachable from each node over the edges (a, b), to convergence.

    Each round a node takes the smallest label of its neighbours, then the label of the node that its label names,
    which halves long chains. Raises if max_rounds isn't enough.
    """
    spark = edges.sparkSession
    pairs = edges.select("a", "b").where("a <> b")
    both = materialize(pairs.union(pairs.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    for _ in range(max_rounds):
        lower = materialize(
            spark.sql(
                """
                SELECT l.node, least(l.label, n.label) AS label, l.label AS was
                FROM {labels} l JOIN (SELECT e.a AS node, min(m.label) AS label FROM {both} e JOIN {labels} m ON e.b = m.node GROUP BY e.a) n ON l.node = n.node
                """,
                labels=labels, both=both,
            ),
            "lower",
        )
        drop(labels)
        if lower.where("label <> was").limit(1).count() == 0:
            drop(both)
            return lower.select("node", "label")
        labels = materialize(
            spark.sql("SELECT l.node, least(l.label, up.label) AS label FROM {lower} l JOIN {lower} up ON l.label = up.node", lower=lower), "labels"
        )
        drop(lower)
    raise RuntimeError(f"labels still change after {max_rounds} rounds")


def grid_clusters(
    df: DataFrame,
    id_col: str = "out_id",
    vector_col: str = "embedding",
    dim: int = 96,
    min_cos: float = 0.72,
    min_size: int = 5,
    grids: int = 3,
    probes: int = 2,
    cell_rows: int = 2048,
    sample_rows: int = 65_536,
    seed: int = 23,
) -> DataFrame:
    """(cluster, id, density, size): the members of each cluster of at least min_size ids.

    cluster is the smallest id; density the most links that a member was seen to have in one cell. Rows without dim finite values that are not all
    zero, null ids and null vectors belong to none. An id delivered again counts once; equal vectors are linked.
    An empty frame gives an empty one. Cosines are those of 8 bit codes (error about 1e-3). sample_rows bounds the
    sample on which the cells' borders are fitted; all rows are placed.
    """
    vectors = V.vectors_of(df, id_col, vector_col)
    codes = V.coded(vectors, dim, 8)
    # equal vectors are linked, so that one row stands for them; (h, rep, n) of codes that several ids have
    twins = codes.select("h", "id").distinct().groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1")
    twins = materialize(twins, "twins")
    cells = V.fit_forest(vectors, dim, grids, probes, cell_rows, sample_rows, seed, twins, 8)

    def link(t: pa.Table) -> pa.Table:
        ids, x, n = V.group_matrix(t, dim, 8)
        label, degree = linked_pieces(x, min_cos, copies=n)
        at = np.flatnonzero(degree > 0)
        return pa.table({"id": ids[at], "label": ids[label[at]], "links": degree[at], "n": n[at]})

    seen = V.routed(V.first_rows(codes, twins), cells, dim, 8).groupBy("grp").applyInArrow(link, "id long, label long, links long, n long")
    # a piece is named by its smallest id, so pieces of one name are connected; a row has at most grids * probes of them
    rows = seen.groupBy("id").agg(F.min("label").alias("root"), F.max("links").alias("density"), F.max("n").alias("n"), F.collect_set("label").alias("names"))
    rows = materialize(rows, "rows")
    joined = rows.where(F.size("names") > 1).select(F.explode("names").alias("a"), F.col("root").alias("b")).where("a <> b").distinct()
    labels = propagate_minimum(joined)
    return seen.sparkSession.sql(
        """
        WITH placed AS (SELECT r.id, r.density, r.n, coalesce(l.label, r.root) AS cluster FROM {rows} r LEFT JOIN {labels} l ON r.root = l.node),
             sized AS (SELECT cluster, sum(n) AS size FROM placed GROUP BY cluster HAVING sum(n) >= {min_size}),
             kept AS (SELECT p.cluster, p.id, p.density, s.size, p.n FROM placed p JOIN sized s ON p.cluster = s.cluster),
             others AS (SELECT DISTINCT c.id, t.rep FROM {codes} c JOIN {twins} t ON c.h = t.h WHERE c.id <> t.rep)
        SELECT cluster, id, density, size FROM kept
        UNION ALL
        SELECT k.cluster, o.id, k.density, k.size FROM others o JOIN kept k ON o.rep = k.id WHERE k.n > 1
        """,
        rows=rows, labels=labels, codes=codes.select("id", "h"), twins=twins, min_size=min_size,
    )


def describe_clusters(members: DataFrame, typical: int = 3) -> DataFrame:
    """(cluster, size, typical_members): for each cluster its size and its densest members, at most `typical` of them.

    typical must be small: the densest members are found by that many max_by passes over partial aggregates, so
    that a cluster that holds most of the rows is no hot spot.
    """
    out, rest = None, members
    for n in range(typical):
        best = rest.groupBy("cluster").agg(F.max("size").alias("size"), F.max_by("id", F.struct("density", -F.col("id"))).alias(f"m{n}"))
        rest = rest.join(best.select("cluster", F.col(f"m{n}").alias("taken")), "cluster").where("id <> taken").drop("taken")
        out = best if out is None else out.join(best.drop("size"), "cluster", "left")
    return out.select("cluster", "size", F.array_compact(F.array(*[f"m{n}" for n in range(typical)])).alias("typical_members"))
