"""Vectors as numpy blocks: reading, 8 and 12 bit codes, projection trees, group routing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedflow.encoder import erf


def unit_rows(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Mask of the usable rows (dim finite values, not all zero) and their unit vectors (float32)."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    n = len(vectors)
    starts = np.asarray(vectors.offsets)[:n]
    ok = np.asarray(vectors.is_valid()) & (np.diff(np.asarray(vectors.offsets)) == dim)
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    x = values[starts[ok][:, None] + np.arange(dim)] if ok.any() else np.zeros((0, dim))
    top = np.abs(x).max(axis=1, initial=0)
    good = np.isfinite(top) & (top > 0)
    ok[np.flatnonzero(ok)] = good
    x = x[good] / top[good][:, None]
    return ok, (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def pack(x: np.ndarray, bits: int) -> np.ndarray:
    """Rows as bytes: 8 bits a value, or 12 (a byte, then the low nibbles of two values in one byte)."""
    steps = (1 << (bits - 1)) - 1
    q = np.rint(x / np.abs(x).max(axis=1, keepdims=True) * steps).astype(np.int16) + steps + 1
    if bits == 8:
        return q.astype(np.uint8)
    low = (q & 15).astype(np.uint8)
    if low.shape[1] % 2:
        low = np.pad(low, ((0, 0), (0, 1)))
    return np.hstack([(q >> 4).astype(np.uint8), low[:, ::2] << 4 | low[:, 1::2]])


def unpack(codes: np.ndarray, dim: int, bits: int) -> np.ndarray:
    steps = (1 << (bits - 1)) - 1
    q = codes[:, :dim].astype(np.float32)
    if bits == 12:
        low = np.repeat(codes[:, dim:], 2, axis=1)
        low[:, ::2] >>= 4
        q = q * 16 + (low[:, :dim] & 15)
    q -= steps + 1
    return q / np.linalg.norm(q, axis=1, keepdims=True)


def code_width(dim: int, bits: int) -> int:
    return dim if bits == 8 else dim + (dim + 1) // 2


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64 bit finalizer, to spread ids over the parts of a hot group."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
    return x


@dataclass(frozen=True)
class Forest:
    """Median kd-trees, each over its own low-dimensional Gaussian (2-stable) projection.

    One axis a level: directions[t] has a column a level, cuts[t][level] the cut of each node. parts[t][leaf]
    says into how many parts a leaf is split that would otherwise hold too many rows (ties that no cut divides).
    """

    directions: list[np.ndarray]
    cuts: list[list[np.ndarray]]
    parts: list[np.ndarray]
    probes: int
    rows: int = 0

    @staticmethod
    def fit(sample: np.ndarray, rows: int, dim: int, trees: int, probes: int, leaf_rows: int, seed: int) -> "Forest":
        depth = max(0, round(np.log2(max(rows, 1) / leaf_rows)))
        rng = np.random.default_rng(seed)
        directions, cuts = [], []
        for _ in range(trees):
            d = rng.normal(size=(dim, depth)).astype(np.float32)
            p, node, levels = sample @ d, np.zeros(len(sample), np.int64), []
            for level in range(depth):
                order = np.lexsort((p[:, level], node))
                ends = np.searchsorted(node[order], np.arange((1 << level) + 1))
                mid = np.minimum((ends[:-1] + ends[1:]) // 2, max(len(sample) - 1, 0))
                whole = np.median(p[:, level]) if len(p) else 0.0
                cut = np.where(np.diff(ends) > 0, p[order[mid], level] if len(p) else 0.0, whole).astype(np.float32)
                levels.append(cut)
                node = 2 * node + (p[:, level] > cut[node])
            directions.append(d)
            cuts.append(levels)
        blank = Forest(directions, cuts, [], probes)
        parts = []
        for t in range(trees):
            share = np.bincount(blank.leaves(sample, t).ravel(), minlength=1 << depth) / max(len(sample), 1)
            parts.append(np.ceil(share * rows / (4 * probes * leaf_rows)).clip(1).astype(np.int64))
        return Forest(directions, cuts, parts, probes, rows)

    def leaves(self, x: np.ndarray, t: int) -> np.ndarray:
        """For each row its leaf in tree t, then the next ones by projected distance: (rows, up to probes)."""
        p, depth = x @ self.directions[t], len(self.cuts[t])
        node, gaps = np.zeros(len(x), np.int64), np.empty((len(x), depth), np.float32)
        for level, cut in enumerate(self.cuts[t]):
            gaps[:, level] = p[:, level] - cut[node]
            node = 2 * node + (gaps[:, level] > 0)
        out = [node]
        if depth and self.probes > 1:
            near = np.argsort(gaps**2, axis=1)[:, : self.probes - 1]
            for j in range(near.shape[1]):
                out.append(self._other_side(p, node, near[:, j], t))
        return np.stack(out, axis=1)

    def _other_side(self, p: np.ndarray, node: np.ndarray, level: np.ndarray, t: int) -> np.ndarray:
        """The leaf reached when each row takes the other branch at the given level."""
        depth, at = len(self.cuts[t]), np.zeros(len(p), np.int64)
        for k, cut in enumerate(self.cuts[t]):
            right = (p[:, k] > cut[at]) ^ (level == k)
            at = 2 * at + right
        return at

    def met(self, x: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each row how likely a neighbour of cosine `least` stands in one of its leaves.

        A projected difference is the distance times a standard normal variable, so its square over the squared
        distance is chi-square with one degree of freedom: the test of each gap to a leaf that isn't probed.
        """
        apart, missed = np.sqrt(np.maximum(2 - 2 * least, 1e-12)), np.ones(len(x))
        for t, levels in enumerate(self.cuts):
            p, node, gaps = x @ self.directions[t], np.zeros(len(x), np.int64), np.empty((len(x), len(levels)))
            for level, cut in enumerate(levels):
                gaps[:, level] = p[:, level] - cut[node]
                node = 2 * node + (gaps[:, level] > 0)
            left_out = np.sort(np.abs(gaps), axis=1)[:, self.probes - 1 :]
            missed *= np.minimum(1, 0.5 * (1 - erf(left_out / apart[:, None] / np.sqrt(2))).sum(axis=1))
        return 1 - missed

    def cell_distances(self, x: np.ndarray, levels: int) -> np.ndarray:
        """Squared projected distance of each row to each cell of the first tree's upper levels: (rows, 2 ** levels)."""
        p, out = x @ self.directions[0], np.zeros((len(x), 1), np.float32)
        for level in range(levels):
            gap = p[:, level, None] - self.cuts[0][level][None, :]
            out = np.stack([out + np.maximum(gap, 0) ** 2, out + np.where(gap > 0, 0, np.maximum(-gap, 1e-12)) ** 2], axis=2).reshape(len(x), -1)
        return out

    def groups(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Group keys of each row: (rows, trees * probes)."""
        keys = []
        for t in range(len(self.cuts)):
            leaf = self.leaves(x, t)
            part = mix64(ids)[:, None] % self.parts[t][leaf].astype(np.uint64)
            keys.append((np.int64(t) << 56) | (leaf << 24) | part.astype(np.int64))
        return np.hstack(keys)

    def meetings(self, ids: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of the groups in which rows meet, with the numbers of the rows: together each row's groups.

        The parts of a split leaf meet two by two, so that any two rows of a leaf still stand in a common group.
        """
        keys = self.groups(ids, x)
        for j, key in enumerate(keys.T):
            parts, own = self.parts[j * len(self.cuts) // keys.shape[1]][key >> 24 & 0xFFFFFFFF], key & 0xFFFFFF
            at = np.flatnonzero(parts == 1)
            if len(at):
                yield key[at], at
            for other in range(parts.max(initial=1) if len(at) < len(key) else 0):
                at = np.flatnonzero((other < parts) & (other != own) & (parts > 1))
                if len(at):
                    low, high = np.minimum(own[at], other), np.maximum(own[at], other)
                    yield key[at] - own[at] + high * (high - 1) // 2 + low, at


def coded(vectors: DataFrame, dim: int, bits: int) -> DataFrame:
    """(id, code, h): the usable rows of vectors (id, v), packed, and the hash by which equal codes are found."""
    width = code_width(dim, bits)

    def pack_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, x = unit_rows(b.column("v"), dim)
            own = b.column("id")
            known = np.asarray(own.is_valid())
            ids, x = own.fill_null(0).to_numpy()[ok & known], x[known[ok]]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(ids), as_binary(pack(x, bits), width)], names=["id", "code"])

    return vectors.mapInArrow(pack_rows, "id long, code binary").withColumn("h", F.unhex(F.md5("code")))


def first_rows(codes: DataFrame, twins: DataFrame) -> DataFrame:
    """(id, code, n): of rows of equal code that of the least id, n of twins (h, rep, n), and 1 for a code of one id."""
    joined = codes.join(twins.select("h", "rep", "n"), "h", "left").where("rep IS NULL OR rep = id")
    return joined.select("id", "code", F.coalesce("n", F.lit(1)).cast("long").alias("n"))


def fit_forest(
    vectors: DataFrame, dim: int, trees: int, probes: int, leaf_rows: int, sample_rows: int, seed: int, twins: DataFrame | None = None, bits: int = 12
) -> Forest:
    """vectors: (id, v). Cuts are fitted on a Bernoulli sample of about sample_rows rows; every row is indexed.

    With twins, the table of codes that several ids have, each code counts once. leaf_rows holds for up to 262,144
    rows; see leaf_size for more.
    """
    rows = vectors.count()
    share = min(1.0, sample_rows / max(rows, 1))
    while True:
        picked = vectors.sample(fraction=share, seed=seed)
        if twins is None:
            _, x = unit_rows(picked.select("v").toArrow()["v"].combine_chunks(), dim)
            break
        x = unpacked(first_rows(coded(picked, dim, bits), twins).select("code").toArrow()["code"], dim, bits)
        rows = round(len(x) / share)
        if share == 1 or len(x) >= sample_rows / 2:
            break
        share = min(1.0, max(2 * share, sample_rows / max(rows, 1)))  # most rows were copies
    return Forest.fit(x, rows, dim, trees, probes, leaf_size(rows, leaf_rows), seed)


def routed(codes: DataFrame, forest: Forest, dim: int, bits: int) -> DataFrame:
    """(grp, id, code, n): a row of codes (id, code, n) for each group that it belongs to."""
    box = codes.sparkSession.sparkContext.broadcast(forest)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for keys, at in box.value.meetings(b.column("id").to_numpy(), unpacked(b.column("code"), dim, bits)):
                    own = b if len(at) == b.num_rows else b.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *own.columns], names=["grp", "id", "code", "n"])

    return codes.select("id", "code", "n").mapInArrow(route, "grp long, id long, code binary, n long")


def as_binary(code: np.ndarray, width: int) -> pa.Array:
    offsets = np.arange(len(code) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(code), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(code))])


def unpacked(codes: pa.Array | pa.ChunkedArray, dim: int, bits: int) -> np.ndarray:
    return unpack(np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(-1, code_width(dim, bits)), dim, bits)


def group_matrix(t: pa.Table, dim: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of a group, ascending, their vectors and their n; second deliveries of an id count once."""
    ids, at = np.unique(t["id"].to_numpy(), return_index=True)
    return ids, unpacked(t["code"], dim, bits)[at], t["n"].to_numpy()[at]


def vectors_of(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Only the two columns that count, under names of our own: other columns can't clash."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<float>").alias("v"))


def leaf_size(rows: int, base: int) -> int:
    """Rows of a leaf: grows with the power 0.3 of the input, so that depth, and so what a tree misses, grows slowly."""
    return int(base * max(1.0, rows / 262_144) ** 0.3)


def distinct_pairs(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)
