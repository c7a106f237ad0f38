import numpy as np
import pytest

from embedflow.llm import mixing as M


def test_split_is_exact():
    quota = np.array([1000, 1, 0, 37])
    for shards in (1, 2, 7):
        out = M.split_quotas(quota, np.arange(shards + 1), 3)
        assert out.sum(axis=0).tolist() == quota.tolist() and (out >= 0).all()
        assert np.ptp(out.sum(axis=1)) <= np.ceil(np.log2(shards)) + 1
    assert np.array_equal(M.split_quotas(quota, np.arange(6), 1), M.split_quotas(quota, np.arange(6), 1))


@pytest.mark.parametrize("whole", [10**10, 10**12, 10**15])
def test_split_of_many_blocks(whole):
    """Beyond the exact generator's range: whole quotas, no block lost, and shares within a few deviations."""
    quota = [whole * 6 // 10, whole * 3 // 10, whole // 10, 3]
    out = M.split_quotas(quota, np.array([0, 10, 20, 40, 80]), 5)
    assert out.sum(axis=0).tolist() == quota and (out >= 0).all()
    assert np.abs(out.sum(axis=1) - sum(quota) * np.array([10, 10, 20, 40]) / 80).max() <= 3
    assert np.abs(out[:, 0] / out.sum(axis=1) - 0.6).max() < 6 / np.sqrt(whole / 8)


def test_drawn_blocks_have_the_right_spread(monkeypatch):
    """The normal limit against the exact generator."""
    draw = lambda: np.array([M.drawn_blocks(np.random.default_rng(i), 60_000, 40_000, 30_000) for i in range(4000)])
    exact = draw()
    monkeypatch.setattr(M, "EXACT_BLOCKS", 0)
    limit = draw()
    assert abs(exact.mean() - limit.mean()) < 8 and abs(exact.std() / limit.std() - 1) < 0.06


@pytest.mark.parametrize("shards,pieces", [(40, 40), (40, 7), (40, 1)])
def test_tree_can_be_drawn_in_parts(shards, pieces):
    quota = [500, 90, 1]
    bounds = np.array([i * shards // pieces for i in range(pieces + 1)])
    upper = M.split_quotas(quota, bounds, 9)
    lower = [M._lower_part(tuple(q.tolist()), int(a), int(b), 9) for q, a, b in zip(upper, bounds, bounds[1:])]
    assert [p[-1].tolist() for p in lower] == upper.tolist() and sum(map(len, lower)) == shards


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    one, two = M.permuted(np.arange(n), n, 1), M.permuted(np.arange(n), n, 2)
    assert sorted(one.tolist()) == list(range(n)) and np.array_equal(one, M.permuted(np.arange(n), n, 1))
    if n > 60:
        assert (one != two).mean() > 0.9
        assert len(np.unique(np.diff(one) % n)) > n / 3  # no arithmetic progression
    assert (M.permuted(np.array([0, 10**11, 10**12 - 1]), 10**12, 4) < 10**12).all()


def test_quotas():
    got = M.planned_quotas({"a": (0.5, 1), "b": (0.3, 4), "c": (0.2, 2)}, {"a": 1000, "b": 100, "d": 9})
    assert got == {"a": 666, "b": 400}
    assert M.planned_quotas({"a": (1.0, 1)}, {}) == {}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "word " * (1 + i * 7 % 40), [" News ", "WEB", "wiki", "other", None][0 if i % 3 == 0 else 1 + i % 4]) for i in range(3000)]
    rows += [(9001, None, "web"), (9002, "", "web"), (None, "x", "web")]
    return spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, source string, copy int, id string")


TARGETS = [("news", 0.5, 1), ("web", 0.3, 3), ("wiki", 0.15, 2), ("none", 0.05, 2)]


def test_mix(spark, docs, monkeypatch):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    rows = M.mixed_sources(docs, targets, block_tokens=64, shard_tokens=4000).collect()
    most = {s: r for s, _, r in TARGETS}
    uses, tokens, at = {}, {}, {}
    for r in rows:
        uses.setdefault((r.source, r.id), []).append(r.copy)
        tokens[r.source] = tokens.get(r.source, 0) + r.n_tokens
        at.setdefault(r.shard, []).append(r.position)
    assert all(len(set(v)) == len(v) <= most[s] for (s, _), v in uses.items())
    assert set(tokens) == {"news", "web", "wiki"} and not {9001, 9002, None} & {i for _, i in uses}
    total = sum(tokens.values())
    for s, w, _ in TARGETS[:3]:
        assert abs(tokens[s] / total - w / 0.95) < 0.001
        assert {round(r.reached_share, 12) for r in rows if r.source == s} == {round(tokens[s] / total, 12)}
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in at.values()) and len(at) > 3
    sizes = [sum(r.n_tokens for r in rows if r.shard == s) for s in at]
    assert max(sizes) < 1.5 * min(sizes)
    # the lower part of the tree drawn by the workers: other places, the same properties
    monkeypatch.setattr(M, "TREE_ENTRIES", 9)
    parts = M.mixed_sources(docs, targets, block_tokens=64, shard_tokens=4000).collect()
    assert sorted((r.source, r.id, r.copy) for r in parts) == sorted((r.source, r.id, r.copy) for r in rows)
    by_shard = {}
    for r in parts:
        by_shard.setdefault(r.shard, []).append(r)
    assert set(by_shard) == set(at) and all(sorted(r.position for r in own) == list(range(1, len(own) + 1)) for own in by_shard.values())
    sizes = [sum(r.n_tokens for r in own) for own in by_shard.values()]
    assert max(sizes) < 1.6 * min(sizes)
    monkeypatch.undo()
    again = M.mixed_sources(docs.repartition(7), targets, block_tokens=64, shard_tokens=4000).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    report = {r.source: r for r in M.source_shares(M.mixed_sources(docs, targets), targets).collect()}
    assert report["none"].tokens == 0 and report["none"].reached_share == 0.0 and report["news"].target_share == 0.5


def test_empty_and_wrong(spark, docs):
    targets = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    assert M.mixed_sources(docs.limit(0), targets).count() == 0
    assert M.mixed_sources(docs, targets.limit(0)).count() == 0
    assert M.mixed_sources(docs, targets.where("source = 'none'")).count() == 0
    with pytest.raises(ValueError):
        M.mixed_sources(docs, targets.union(targets))
