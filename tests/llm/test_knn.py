import numpy as np
import pytest

from embedflow.llm import _vectors as V
from embedflow.llm import knn as K

RNG = np.random.default_rng(8)


def clustered(n, dim=96, groups=200, spread=0.35):
    centres = RNG.normal(size=(groups, dim))
    x = centres[RNG.integers(0, groups, n)] + spread * RNG.normal(size=(n, dim))
    x[: n // 3] = RNG.normal(size=(n // 3, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def frame(spark, x, ids=None):
    return spark.createDataFrame([(int(i), v.tolist(), "x", 1.0) for i, v in zip(range(1, len(x) + 1) if ids is None else ids, x)], "out_id long, embedding array<float>, id string, v double")


def truth(x, k, least):
    s = x @ x.T
    np.fill_diagonal(s, -2)
    at = np.argsort(-s, axis=1, kind="stable")[:, :k]
    return {(a + 1, int(b) + 1) for a, row in enumerate(at) for b in row if s[a, b] >= least}


@pytest.mark.parametrize("bits,error", [(8, 0.006), (12, 0.0005)])
def test_codes(bits, error):
    x = clustered(50, 95)
    c = V.pack(x, bits)
    assert c.shape[1] == V.code_width(95, bits)
    y = V.unpack(c, 95, bits)
    assert np.abs(x @ x.T - y @ y.T).max() < error


def test_chi2_quantile():
    # Known values of the chi-square distribution
    for p, dof, want in ((0.95, 4, 9.488), (0.9, 8, 13.362), (0.99, 1, 6.635)):
        assert K.chi2_quantile(p, dof) == pytest.approx(want, rel=0.02)


def test_group_is_nearly_exact():
    x = clustered(2500)
    who, cos = K.group_neighbours(x, 5, 0.6, 0.99, block_rows=128)
    got = {(a + 1, int(b) + 1) for a, row in enumerate(who) for b in row if b >= 0}
    want = truth(x, 5, 0.6)
    assert len(got & want) / len(want) > 0.97
    assert np.all(np.diff(cos, axis=1) <= 0)
    who, _ = K.group_neighbours(x[:3], 5, -1.0, 0.99)
    assert [sorted(r[r >= 0].tolist()) for r in who] == [[1, 2], [0, 2], [0, 1]]


def test_recall(spark):
    x = clustered(6000)
    near = K.nearest_vectors(frame(spark, x), k=5, min_cos=0.75, leaf_rows=256).collect()
    got, want = {(r.id, r.neighbour) for r in near}, truth(x, 5, 0.75)
    assert len(got & want) / len(want) > 0.9
    s = x @ x.T
    assert all(abs(s[r.id - 1, r.neighbour - 1] - r.cosine) < 1e-3 and r.cosine >= 0.7499 for r in near)
    ranks = {}
    for r in near:
        ranks.setdefault(r.id, []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 5 for v in ranks.values())


def test_dirty_rows(spark):
    x = clustered(40)
    good = [(i, x[i].tolist()) for i in range(40)] + [(100 + i, x[0].tolist()) for i in range(12)]
    bad = [(200, None), (201, [1.0] * 48), (202, [0.0] * 96), (203, [float("nan")] * 96), (204, [float("inf")] + [0.0] * 95), (205, [None] * 96), (None, x[1].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(good + bad, "out_id long, embedding array<float>")
    near = K.nearest_vectors(df, k=5, min_cos=0.75).collect()
    seen = {r.id for r in near} | {r.neighbour for r in near}
    assert not seen & set(range(200, 206)) and None not in seen
    copies = {r.id: [] for r in near if r.id >= 100 or r.id == 0}
    for r in near:
        if r.id in copies:
            copies[r.id].append(r.cosine)
            assert r.neighbour != r.id
    assert len(copies) == 13 and all(len(c) == 5 and min(c) > 0.9999 for c in copies.values())
    large = spark.createDataFrame([((1 << 53) + 1, x[0].tolist()), ((1 << 53) + 3, x[0].tolist()), (None, x[0].tolist())], "out_id long, embedding array<float>").coalesce(1)
    assert [tuple(r) for r in K.similar_pairs(K.nearest_vectors(large)).collect()] == [((1 << 53) + 1, (1 << 53) + 3)]
    scaled = spark.createDataFrame([(1, (x[0] * 1e30).tolist()), (2, (x[0] * 1e-30).tolist())], "out_id long, embedding array<float>")
    assert {(r.id, r.neighbour) for r in K.nearest_vectors(scaled).collect()} == {(1, 2), (2, 1)}
    assert [tuple(r) for r in K.similar_pairs(K.nearest_vectors(scaled)).collect()] == [(1, 2)]


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "out_id long, embedding array<float>")
    assert K.nearest_vectors(df).count() == 0
    assert K.nearest_vectors(frame(spark, clustered(1))).count() == 0


def test_hot_copies_are_split(spark):
    """A third of all rows is one vector: its leaf is split, and every copy still finds five others."""
    x = clustered(6000)
    x[2000:4000] = x[2000]
    forest = V.fit_forest(V.vectors_of(frame(spark, x), "out_id", "embedding"), 96, 2, 2, 64, 65_536, 1)
    groups = np.unique(forest.groups(np.arange(6000), x), return_counts=True)[1]
    assert groups.max() < 1200
    near = K.nearest_vectors(frame(spark, x), k=5, min_cos=0.75, leaf_rows=64).where("id BETWEEN 2001 AND 4000 AND cosine > 0.9999")
    assert near.groupBy("id").count().where("count = 5").count() == 2000


def test_query_has_no_floor(spark, tmp_path):
    """Every usable record gets five rows, also where its nearest are far."""
    from embedflow.llm.queries import p2_nearest

    x = RNG.normal(size=(300, 96)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    frame(spark, x).write.parquet(f"{tmp_path}/out_records.parquet")
    got = p2_nearest(spark, str(tmp_path)).collect()
    want = truth(x, 5, -1.0)
    assert len({(r.out_id, r.near_id) for r in got} & want) / len(want) > 0.99
    assert sorted((r.out_id, r["rank"]) for r in got) == [(i, n) for i in range(1, 301) for n in range(1, 6)]


def test_variants_of_a_hot_vector(spark):
    """A third of all rows is one vector; rows close to it still find their nearest, and so do its copies."""
    x = clustered(9000)
    x[3000:6000] = x[3000]
    away = RNG.normal(size=(300, 96))
    away -= np.outer(away @ x[3000], x[3000])
    x[6000:6300] = 0.9 * x[3000] + np.sqrt(1 - 0.81) * away / np.linalg.norm(away, axis=1, keepdims=True)
    near = {(r.id, r.neighbour) for r in K.nearest_vectors(frame(spark, x), k=5, leaf_rows=64).where("id BETWEEN 6001 AND 6300").collect()}
    s = x[6000:6300] @ x.T
    s[np.arange(300), np.arange(6000, 6300)] = -2
    fifth = np.sort(s, axis=1)[:, -5]
    assert len(near) == 1500
    assert sum(s[a - 6001, b - 1] >= fifth[a - 6001] - 1e-3 for a, b in near) / len(near) > 0.9


def test_few_copies_expand(spark):
    """Groups of two to seven equal vectors, some delivered twice: copies first, then the nearest others with all of their copies."""
    x = np.repeat(clustered(40), [2, 3, 4, 5, 6, 7, 1, 1] * 5, axis=0)
    df = frame(spark, x)
    got = {}
    for r in K.nearest_vectors(df.union(df), k=5).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append(r.neighbour)
    kind = np.unique(x, axis=0, return_inverse=True)[1].ravel()
    s = np.round((x @ x.T).astype(np.float64), 5)
    np.fill_diagonal(s, -2)
    s[kind[:, None] == kind[None, :]] += 1  # copies first
    np.fill_diagonal(s, -2)
    assert sorted(got) == list(range(1, len(x) + 1))
    for i, own in got.items():
        assert len(own) == len(set(own)) == 5 and i not in own
        want = np.argsort(-s[i - 1], kind="stable")[:5] + 1
        assert np.allclose(s[i - 1, np.array(own) - 1], s[i - 1, want - 1], atol=1e-3)


@pytest.mark.parametrize("hot", [1, 1500])
def test_search_goes_on_beyond_the_trees(spark, hot):
    """Neighbours that no tree separates are found by going on through the cells until the test holds."""
    x = clustered(5000)
    x[100 : 100 + hot] = x[100]
    df, s = frame(spark, x), x @ x.T
    np.fill_diagonal(s, -2)
    fifth = np.sort(s, axis=1)[:, -5]
    found = lambda **kw: [(r.id - 1, r.neighbour - 1) for r in K.nearest_vectors(df, k=5, leaf_rows=64, **kw).collect()]
    good = lambda pairs: np.mean([s[a, b] >= fifth[a] - 1e-3 for a, b in pairs])
    far = lambda pairs: [(a, b) for a, b in pairs if fifth[a] < 0.6]
    ended, whole = found(), found(beyond_trees=True, cell_rows=700)
    assert len(whole) == len(set(whole)) == 25_000 and all(a != b for a, b in whole)
    assert good(whole) > 0.97 and good(far(ended)) < 0.9 < good(far(whole))


def test_far_neighbours_are_not_met():
    x = clustered(4000)
    forest = V.Forest.fit(x, len(x), 96, 3, 3, 64, 2)
    near, middle, far = (forest.met(x, np.full(len(x), c, np.float32)).mean() for c in (0.98, 0.75, 0.3))
    assert near > 0.95 > middle > far and forest.met(x[:3], np.ones(3, np.float32)).tolist() == [1, 1, 1]
    apart = forest.cell_distances(x, 3)
    assert apart.shape == (4000, 8) and (apart.min(axis=1) == 0).all()
    assert np.bincount(apart.argmin(axis=1), minlength=8).min() > 400
