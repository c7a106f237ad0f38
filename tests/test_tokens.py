import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from embedflow.functions import text as T
from embedflow.operators import batching as B


def column(spark, f, rows, schema="t string"):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], schema).select(f(F.col("t"))).collect()]


def test_tokens(spark):
    assert column(spark, T.tokens, ["ab 1c,,d", "", " \t", None]) == [["ab", "1c", ",", ",", "d"], [], [], None]
    assert column(spark, T.words, [" a\tb\n\nc ", ""]) == [["a", "b", "c"], []]


def test_truncation_limit(spark):
    texts = [" ".join("x" * n) for n in (509, 510, 511)] + [""]
    assert column(spark, T.n_tokens, texts) == [511, 512, 512, 2]
    assert column(spark, T.is_truncated, texts) == [False, False, True, False]
    assert [len(x) for x in column(spark, T.encoded_ids, texts)] == [511, 512, 512, 2]


def test_padding_and_shapes(spark):
    out = spark.createDataFrame([([2, 5], 4)], "i array<int>, n int").select(T.padded(F.col("i"), F.col("n")).alias("p"), T.mask(F.col("i"), F.col("n")).alias("m")).first()
    assert out.p == [2, 5, 0, 0] and out.m == [1, 1, 0, 0]
    assert column(spark, T.shape_for, [1, 64, 65, 512, 513], "t int") == [64, 64, 128, 512, None]
    assert column(spark, T.rows_per_forward, [512, 1, 0, 2000], "t int") == [2, 524288, 524288, 1]
    assert column(spark, lambda c: T.rows_per_forward(c, 16 * 512 * 512), [512], "t int") == [16]


@pytest.mark.parametrize("lengths,size,batches", [([9, 1, 5, 2], 2, [[1, 3], [2, 0]]), ([3, 1], 2, [[1, 0]]), ([4, 7, 2, 9, 1], 2, None), ([5, 5, 5], 2, [[0, 1], [2]])])
def test_length_batches(spark, lengths, size, batches):
    df = spark.createDataFrame(list(enumerate(lengths)), "idx int, n_tokens int")
    rows = B.length_batches(df, "idx", batch_size=size, bucket_rows=2).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.batch, r.pos)):
        got.setdefault(r.batch, []).append(r.idx)
    assert sorted(i for b in got.values() for i in b) == list(range(len(lengths)))
    if batches:
        assert list(got.values()) == batches
    shapes = B.batch_shapes(B.length_batches(df, "idx", batch_size=size)).collect()
    assert sum(s.seq * s.rows - s.waste for s in shapes) == sum(lengths)
    assert B.length_batches(df.limit(0), "idx").count() == 0


def test_chunks_cover_long_texts(spark):
    df = spark.createDataFrame([(1, 510), (2, 511), (3, 1020), (4, 1021)], "id int, n int")
    out = [(r.id, r.chunk_no, r.first_token, r.n) for r in B.chunks_of_long_texts(df, "id", "n").orderBy("id", "chunk_no").collect()]
    assert out == [(2, 0, 0, 510), (2, 1, 510, 1), (3, 0, 0, 510), (3, 1, 510, 510), (4, 0, 0, 510), (4, 1, 510, 510), (4, 2, 1020, 1)]


def test_fnv_vectors(spark):
    known = {"": "cbf29ce484222325", "a": "af63dc4c8601ec8c", "foobar": "85944171f73967e8"}
    assert {t: f"{T.fnv1a(t.encode()):016x}" for t in known} == known
    texts = [*known, None, "ほげ" * 50, "x" * 3000]
    assert column(spark, T.fnv1a_hex, texts) == [None if t is None else f"{T.fnv1a(t.encode()):016x}" for t in texts]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=12)), max_size=12))
def test_fnv_batches(texts):
    import pandas as pd

    got = T.fnv1a_hex.func(pd.Series(texts, dtype=object))
    assert list(got) == [None if t is None else f"{T.fnv1a(t.encode()):016x}" for t in texts]


def test_python_tokens_match_sql(spark):
    from embedflow.embed import Tokenizer
    from embedflow.spec import EncoderSpec

    texts = ["Größe 12.5 kg、重さ。", "a\u00a0b\tc", "été’s {x}", "", "か゛" * 300]
    spec = EncoderSpec()
    sql = column(spark, lambda c: T.encoded_ids(c, 512, spec.config.vocab), texts)
    assert [ids for ids, _ in Tokenizer(spec)(texts)] == [list(x) for x in sql]
    assert np.all([c for _, c in Tokenizer(spec)(texts)] == np.array([False, False, False, False, True]))


def test_hashed_vector_says_what_it_cuts(spark, tmp_path):
    from embedflow.plans.token_queries import embed_hashed, hashed_truncated

    words = " ".join(f"w{i}" for i in range(510))
    spark.createDataFrame([(1, words), (2, words + " more"), (3, None), (4, " ")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {tuple(r) for r in hashed_truncated(spark, str(tmp_path)).collect()} == {(1, 510, False), (2, 511, True), (4, 0, False)}
    v = {(r.doc_id, r.j): r.v for r in embed_hashed(spark, str(tmp_path)).collect()}
    assert all(v[1, j] == v[2, j] for j in range(8))
