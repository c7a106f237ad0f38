import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from embedflow.llm import packing as P
from embedflow.llm.tokens import encoding, token_sizes, TOKENIZER


def plain(sizes, capacity):
    """The gaps left by the rule, trying every open container; on a tie the fullest open one."""
    gaps = []
    for s in sizes:
        counts = np.bincount([g for g in gaps if g], minlength=capacity + 1)
        after = lambda g: 2 * counts[g - s] + 1 if g > s else 0
        options = [(after(g) - 2 * counts[g] + 1, g, i) for i, g in enumerate(gaps) if g >= s] + [(after(capacity), capacity + 1, len(gaps))]
        at = min(options)[2]
        if at == len(gaps):
            gaps.append(capacity)
        gaps[at] -= s
    return gaps


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=40))
def test_rule(sizes):
    number = P.sum_of_squares(np.array(sizes, np.int64), 12)
    fill = np.bincount(number, weights=sizes) if sizes else np.zeros(0)
    gaps = plain(sizes, 12)
    assert fill.max(initial=0) <= 12 and sorted(12 - fill) == sorted(gaps)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 60).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=60))))
def test_both_ways_of_looking_at_gaps_agree(case):
    capacity, sizes = case
    sizes = np.array(sizes, np.int64)
    every = P.sum_of_squares(sizes, capacity).tolist()
    with pytest.MonkeyPatch.context() as m:
        m.setattr(P, "EVERY_GAP", 0)
        assert P.sum_of_squares(sizes, capacity).tolist() == every


def test_large_capacity_is_quick():
    sizes = np.sort(np.random.default_rng(1).integers(1, 40_000, 5000))[::-1]
    number = P.sum_of_squares(sizes, 1_000_000_000)
    assert number.max() == 0
    fill = np.bincount(P.sum_of_squares(sizes, 1_000_000), weights=sizes)
    assert fill.max() <= 1_000_000 and fill.sum() / (len(fill) * 1e6) > 0.98


def test_tokens(spark):
    enc = encoding(TOKENIZER)
    texts = ["Hello world", "", None, "日本語の文。", "<|endoftext|>", " a\n\nb", "x" * 40_000]
    got = {r.id: r.n_tokens for r in token_sizes(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)


def test_packed(spark):
    texts = ["word " * n for n in (1, 5, 10, 63, 64, 65, 128, 200, 1000, 7, 7, 7)] + [None, "", "日本" * 9000]
    docs = spark.createDataFrame([(i, t, 9, "k") for i, t in enumerate(texts)] + [(None, "text", 9, "k")], "doc_id long, text string, n_tokens int, id string")
    kinds = spark.createDataFrame([("small", 64), ("one", 1), ("big", 8192)], "container_kind string, capacity_tokens int")
    rows = P.packed_containers(docs, kinds, shard_items=4).collect()
    sizes = {r.id: r.n_tokens for r in token_sizes(docs).collect() if r.id is not None and r.n_tokens}
    for kind, capacity in (("small", 64), ("one", 1), ("big", 8192)):
        own = [r for r in rows if r.container_kind == kind]
        fill, pieces = {}, {}
        for r in own:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
            pieces.setdefault(r.id, []).append((r.piece_no, r.first_token, r.n_tokens))
        assert max(fill.values()) <= capacity and all(r.container_fill == fill[r.container_id] for r in own)
        assert {i: sum(p[2] for p in v) for i, v in pieces.items()} == sizes
        for i, v in pieces.items():
            v.sort()
            assert len(v) == -(-sizes[i] // capacity)
            assert [p[0] for p in v] == list(range(len(v))) and [p[1] for p in v] == [k * capacity for k in range(len(v))]
    assert {r.container_kind: r.use for r in P.container_use(P.packed_containers(docs, kinds)).collect()}["one"] == 1.0


def test_empty_and_wrong(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    kinds = spark.createDataFrame([("a", 8)], "container_kind string, capacity_tokens int")
    assert P.packed_containers(docs, kinds).count() == 0
    some = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    assert P.packed_containers(some, kinds.limit(0)).count() == 0
    with pytest.raises(ValueError):
        P.packed_containers(some, spark.createDataFrame([("a", 0)], "container_kind string, capacity_tokens int"))
