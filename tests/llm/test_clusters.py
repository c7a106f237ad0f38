import numpy as np
import pytest

from embedflow.llm import _vectors as V
from embedflow.llm import clusters as C

RNG = np.random.default_rng(9)


def components(n, links):
    label = list(range(n))

    def top(v):
        while label[v] != v:
            v = label[v]
        return v

    for a, b in links:
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    return [top(v) for v in range(n)]


def brute(x, ids, least, size):
    s = x @ x.T
    label = components(len(x), zip(*np.nonzero(np.triu(s >= least, 1))))
    groups = {}
    for i, v in zip(ids, label):
        groups.setdefault(v, []).append(i)
    return {(min(g), i) for g in groups.values() if len(g) >= size for i in g}


def data(sizes, noise, dim=96, spread=0.25):
    parts = [RNG.normal(size=dim) / np.sqrt(dim) + spread * RNG.normal(size=(s, dim)) / np.sqrt(dim) for s in sizes] + [RNG.normal(size=(noise, dim))]
    x = np.vstack(parts)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, ids):
    return spark.createDataFrame([(int(i), v.tolist(), 0, "c") for i, v in zip(ids, x)], "out_id long, embedding array<float>, cluster int, label string")


@pytest.mark.parametrize("block", [3, 64, 512])
def test_pieces(block):
    x = data([40, 9, 5, 2], 60)
    label, degree = C.linked_pieces(x, 0.72, block)
    s = x @ x.T >= 0.72
    assert degree.tolist() == (s.sum(axis=1) - 1).tolist()
    assert label.tolist() == components(len(x), zip(*np.nonzero(np.triu(s, 1))))


def test_clusters(spark):
    x = data([300, 60, 20, 8, 6, 5, 5, 4, 3], 700)
    ids = RNG.permutation(5000)[: len(x)]
    df = frame(spark, x, ids)
    members = C.grid_clusters(df.union(df.limit(50)), cell_rows=128, grids=6)
    assert {(r.cluster, r.id) for r in members.collect()} == brute(x, ids.tolist(), 0.72, 5)
    found = {r.cluster: r for r in C.describe_clusters(members).collect()}
    density = {r.id: (r.cluster, r.density) for r in members.collect()}
    for c, r in found.items():
        own = sorted(((-d, i) for i, (k, d) in density.items() if k == c))
        assert r.size == len(own) and r.typical_members == [i for _, i in own[:3]]


def test_dirty_and_empty(spark):
    x = data([5], 10)
    bad = [(900, None), (901, [1.0] * 5), (902, [0.0] * 96), (903, [float("nan")] * 96), (None, x[0].tolist())]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + bad, "out_id long, embedding array<float>")
    assert {(r.cluster, r.id) for r in C.grid_clusters(df).collect()} == {(0, i) for i in range(5)}
    assert C.grid_clusters(df.limit(0)).count() == 0
    assert C.describe_clusters(C.grid_clusters(df.limit(0))).count() == 0


def test_hot_copies(spark):
    """A third of all rows is one vector."""
    x = data([5], 4000)
    x[1000:3000] = x[1000]
    members = C.grid_clusters(frame(spark, x, range(len(x))), cell_rows=64)
    got = {(r.cluster, r.id) for r in members.collect()}
    assert {(1000, i) for i in range(1000, 3000)} <= got


def test_propagation(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 300)] + [(500, 400), (7, 7), (600, 600)], "a long, b long")
    got = {r.node: r.label for r in C.propagate_minimum(chain).collect()}
    assert got == dict.fromkeys(range(1, 301), 1) | {400: 400, 500: 400}
    with pytest.raises(RuntimeError):
        C.propagate_minimum(chain, max_rounds=2)


@pytest.mark.parametrize("hot,n", [(700, 2100), (2000, 4000), (5000, 7000)])
def test_copies_are_one_cluster(spark, hot, n):
    """However many rows are one vector, and into however many parts their cells would be split."""
    x = data([6], n)
    x[100 : 100 + hot] = x[100]
    x[50:56] = x[100] + 0.02 * x[200 + hot : 206 + hot]
    members = C.grid_clusters(frame(spark, x, range(len(x))), cell_rows=32, grids=6).where("cluster = 50").collect()
    assert sorted(r.id for r in members) == [*range(50, 56), *range(100, 100 + hot)]
    assert {r.size for r in members} == {hot + 6}
    assert {r.density for r in members if r.id >= 100} == {hot + 5}


@pytest.mark.parametrize("hot", [400, 1500, 3000])
def test_parts_of_a_cell_meet(hot):
    """Rows that no cut divides: any two of them still stand in a common group, and no group holds them all."""
    x = data([], 3500)
    x[:hot] = x[0]
    forest = V.Forest.fit(x, len(x), 96, 2, 2, 16, 3)
    groups = {}
    for keys, at in forest.meetings(np.arange(len(x)), x):
        for key, i in zip(keys.tolist(), at.tolist()):
            groups.setdefault(key, set()).add(i)
    met = np.zeros((hot, hot), bool)
    for g in groups.values():
        own = [i for i in g if i < hot]
        met[np.ix_(own, own)] = True
    assert met.all() and max(map(len, groups.values())) < 4 * 4 * 2 * 16
