import json
import struct
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from embedflow import embed as E
from embedflow import encoder as N
from embedflow import spec as S
from embedflow.functions import vectors as V

RNG = np.random.default_rng(4)


def tiny(**changes):
    config = replace(S.TINY, **changes)
    return config, N.Encoder(config, S.synthetic_weights(config))


def reference(config, w, ids, mask):
    """The forward pass again in double precision, a row and a head at a time."""
    out = []
    h, d = config.heads, config.hidden // config.heads
    ln = lambda x, g: (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + config.eps) * g
    for row, m in zip(ids, mask):
        x = ln(w["embeddings.tok_embeddings.weight"].astype(float)[row], w["embeddings.norm.weight"])
        for i in range(config.layers):
            p = f"layers.{i}."
            y = ln(x, w[p + "attn_norm.weight"]) if i else x
            q, k, v = np.split(y @ w[p + "attn.Wqkv.weight"].astype(float).T, 3, axis=1)
            local = i % config.global_every != 0
            angle = np.arange(len(row))[:, None] * (config.theta_local if local else config.theta_global) ** (-2 * np.arange(d // 2) / d)
            cos, sin = np.cos(np.hstack([angle] * 2)), np.sin(np.hstack([angle] * 2))
            turn = lambda z: z * cos + np.hstack([-z[:, d // 2 :], z[:, : d // 2]]) * sin
            parts = []
            for j in range(h):
                at = slice(j * d, (j + 1) * d)
                s = turn(q[:, at]) @ turn(k[:, at]).T / np.sqrt(d) + np.where(m == 1, 0, -1e4)[None]
                if local:
                    s = s + np.where(np.abs(np.subtract.outer(np.arange(len(row)), np.arange(len(row)))) > config.local_attention // 2, -2e4, 0)
                s = np.exp(np.maximum(s - s.max(1, keepdims=True), -87))
                parts.append(s / s.sum(1, keepdims=True) @ v[:, at])
            x = x + np.hstack(parts) @ w[p + "attn.Wo.weight"].astype(float).T
            a, b = np.split(ln(x, w[p + "mlp_norm.weight"]) @ w[p + "mlp.Wi.weight"].astype(float).T, 2, axis=1)
            act = 0.5 * a * (1 + N.erf(a / np.sqrt(2))) if config.activation == "gelu" else a / (1 + np.exp(-a))
            x = x + (act * b) @ w[p + "mlp.Wo.weight"].astype(float).T
        out.append(ln(x, w["final_norm.weight"]))
    return np.array(out)


@pytest.mark.parametrize("activation", ["gelu", "silu"])
def test_forward_matches_reference(activation):
    config, encoder = tiny(activation=activation)
    ids, mask = RNG.integers(0, 32, (3, 24)), np.ones((3, 24), int)
    mask[1, 10:] = 0
    # padding's own states are never pooled: there float32 has few digits left beside the mask's -1e4
    assert np.abs(encoder(ids, mask) - reference(config, encoder.w, ids, mask))[mask == 1].max() < 2e-5


def test_padding_changes_nothing():
    _, encoder = tiny()
    ids = RNG.integers(0, 32, (1, 9))
    alone = N.pool(encoder(ids, np.ones((1, 9), int)), np.ones((1, 9), int), "mean")
    wide, mask = np.zeros((2, 40), int), np.zeros((2, 40), int)
    wide[0, :9], mask[0, :9], mask[1] = ids, 1, 1
    assert np.abs(N.pool(encoder(wide, mask), mask, "mean")[:1] - alone).max() < 1e-5


def test_deep_padding_stays_finite():
    _, encoder = tiny()
    ids, mask = np.zeros((1, 32), int), np.zeros((1, 32), int)
    ids[0, :4], mask[0, :4] = 5, 1
    assert np.isfinite(encoder(ids, mask)).all()
    assert np.isfinite(encoder(ids, np.zeros((1, 32), int))).all()


@pytest.mark.parametrize("length,window,block", [(40, 3, 8), (33, 5, 32), (64, 1, 7), (7, 10, 4)])
def test_banded_equals_dense(length, window, block):
    q, k, v = RNG.normal(size=(3, 2, 2, length, 8)).astype(np.float32)
    mask = (RNG.random((2, length)) > 0.3).astype(np.float32)
    assert np.abs(N.banded_attention(q, k, v, mask, window, block) - N.dense_attention(q, k, v, mask, window)).max() < 1e-5


def test_bf16():
    x = RNG.normal(size=(50, 64)).astype(np.float32)
    assert np.abs(N.to_bf16(x) - x).max() <= np.abs(x).max() * 2**-8
    assert N.to_bf16(np.array([1 + 2**-8, 1 + 3 * 2**-8], np.float32)).tolist() == [1.0, 1 + 2**-6]
    w = RNG.normal(size=(16, 64)).astype(np.float32)
    a, b = x @ w.T, N.to_bf16(x) @ N.to_bf16(w).T
    assert (a * b).sum() / np.linalg.norm(a) / np.linalg.norm(b) > 0.999
    config = S.TINY
    low = N.Encoder(config, S.synthetic_weights(config), "bf16")
    ids, m = RNG.integers(0, 32, (2, 8)), np.ones((2, 8), int)
    p, q = N.pool(low(ids, m), m, "mean"), N.pool(tiny()[1](ids, m), m, "mean")
    assert ((p * q).sum(1) / np.linalg.norm(p, axis=1) / np.linalg.norm(q, axis=1)).min() > 0.99


def test_pooling():
    hidden = np.repeat(np.arange(4, dtype=np.float32)[:, None], 3, axis=1)[None]
    for mask, want in (([1, 1, 0, 0], 0.5), ([1, 1, 1, 1], 1.5), ([0, 0, 0, 0], 0.0)):
        assert N.pool(hidden, np.array([mask]), "mean")[0].tolist() == [want] * 3
    assert N.pool(hidden, np.zeros((1, 4)), "cls")[0].tolist() == [0.0] * 3
    assert N.normalize(np.array([[3, 4], [0, 0]], np.float32)).tolist() == [[np.float32(0.6), np.float32(0.8)], [0, 0]]
    assert [N.rows_per_forward(512), N.rows_per_forward(512, 16 * 512 * 512), N.rows_per_forward(2, most=4)] == [2, 16, 4]


def test_column_functions_match_numpy(spark):
    x = RNG.normal(size=(5, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i int, v array<float>")
    out = df.select(V.layer_norm(F.col("v")).alias("n"), V.rotary(F.col("v"), F.col("i"), 16, 100.0).alias("r"), V.gated(F.col("v"), 8, "gelu").alias("g"), V.l2_normalize(F.col("v")).alias("u")).orderBy("i").toPandas()
    table = N.rotary_tables(5, 16, 100.0)
    assert np.allclose(np.stack(out.n), N.layer_norm(x, np.ones(16, np.float32), 1e-5), atol=1e-5)
    assert np.allclose(np.stack(out.r), np.stack([N.rotate(v[None], (table[0][i : i + 1], table[1][i : i + 1]))[0] for i, v in enumerate(x)]), atol=1e-5)
    assert np.allclose(np.stack(out.g), N.activate(x[:, :8], "gelu") * x[:, 8:], atol=1e-5)
    assert np.array_equal(np.stack(out.u).astype(np.float32), N.normalize(x))
    zero = spark.createDataFrame([([0.0, 0.0],)], "v array<float>").select(V.l2_normalize(F.col("v")), V.int8_scale(F.col("v")), V.cosine(F.col("v"), F.col("v")), V.defect(F.col("v"), 2)).first()
    assert zero[0] == [0, 0] and zero[1] == 1 and np.isnan(zero[2]) and zero[3] == "zero"


def base(**changes):
    raw = {"vocab_size": 50004, "hidden_size": 768, "num_hidden_layers": 22, "num_attention_heads": 12, "intermediate_size": 1152, "global_rope_theta": 160000.0, "local_rope_theta": 10000.0, "pad_token_id": 0} | changes
    return json.dumps({k: v for k, v in raw.items() if v is not ...})


@pytest.mark.parametrize("change,eps", [({"layer_norm_eps": 2e-5}, 2e-5), ({"norm_eps": 3e-5}, 3e-5), ({"layer_norm_eps": 2e-5, "norm_eps": 3e-5}, 2e-5), ({}, 1e-5)])
def test_eps_spellings(change, eps):
    assert S.config_from_json(base(**change)).eps == eps


def test_config_rules():
    nested = {"rope_parameters": {"full_attention": {"rope_theta": 1.0}, "sliding_attention": {"rope_theta": 2.0}}}
    c = S.config_from_json(base(global_rope_theta=..., local_rope_theta=..., **nested))
    assert (c.theta_global, c.theta_local, c.activation) == (1.0, 2.0, "gelu")
    with pytest.raises(S.UnsupportedRequest, match="rope_parameters"):
        S.config_from_json(base(local_rope_theta=...))
    with pytest.raises(S.UnsupportedRequest) as e:
        S.config_from_json(base(attention_bias=True, hidden_activation="relu", hidden_size=770, layer_types=["sliding_attention"] * 22))
    assert all(x in str(e.value) for x in ("attention_bias", "relu", "heads", "layer_types"))
    assert [S.TINY.is_local(i) for i in range(4)] == [False, True, True, False]
    assert S.TINY.reasons(65) and S.TINY.reasons(0) and not S.TINY.reasons(64)


@pytest.mark.parametrize("requested,detected,used,note", [(None, "cls", "cls", None), (None, "mean", "mean", None), (None, None, "mean", "no config"), ("mean", "cls", "mean", "mismatch"), ("cls", "cls", "cls", None), ("cls", None, "cls", None)])
def test_pooling_choice(requested, detected, used, note):
    assert S.resolve_pooling(requested, detected) == (used, note)


def test_pooling_detection():
    flags = lambda **k: json.dumps({f"pooling_mode_{n}": v for n, v in k.items()})
    assert [S.detect_pooling(x) for x in (flags(cls_token=True, mean_tokens=False), flags(cls_token=False, mean_tokens=True), flags(max_tokens=True), flags(mean_tokens=True), "not json", None)] == ["cls", "mean", None, None, None, None]


def test_options_refuse():
    for bad in ({"device": "metal"}, {"precision": "int4"}, {"format": "openai", "report_tokens": True}, {"pooling": "max"}, {"quantize": "4bit"}):
        with pytest.raises(S.UnsupportedRequest):
            S.Options(**bad)
    with pytest.raises(ValueError):
        S.Options(shapes=())
    assert S.Options(shapes=(128, 64, 128)).shapes == (64, 128) and S.Options(batch_size=0).batch_size == 1


def save(path, tensors, dtype="F32"):
    header, data = {}, b""
    for name, t in tensors.items():
        raw = (np.ascontiguousarray(N.to_bf16(t)).view(np.uint32) >> 16).astype(np.uint16).tobytes() if dtype == "BF16" else t.tobytes()
        header[name] = {"dtype": dtype, "shape": list(t.shape), "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    h = json.dumps(header).encode()
    path.write_bytes(struct.pack("<Q", len(h)) + h + data)


@pytest.mark.parametrize("prefix,dtype", [("", "F32"), ("model.", "BF16")])
def test_checkpoint(tmp_path, prefix, dtype):
    w = S.synthetic_weights(S.TINY)
    save(tmp_path / "m.safetensors", {prefix + k: v for k, v in w.items()}, dtype)
    got = S.named_weights(S.read_safetensors(tmp_path / "m.safetensors"), S.TINY)
    assert all(np.allclose(got[k], w[k], atol=0 if dtype == "F32" else 0.01) for k in w)
    with pytest.raises(KeyError):
        S.named_weights({k: v for k, v in w.items() if k != "final_norm.weight"}, S.TINY)
    with pytest.raises(ValueError):
        S.named_weights(w | {"final_norm.weight": np.ones(3, np.float32)}, S.TINY)


def test_embed(spark):
    texts = ["hello world", None, "", "b " * 600, "hello world", "\u3000"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, n_tokens string")
    out = {r.id: r for r in E.embed_records(df).collect()}
    assert out[1].embedding is None and out[1].n_tokens is None
    assert (out[2].n_tokens, out[3].n_tokens, out[3].truncated, out[0].truncated) == (2, 512, True, False)
    assert out[0].embedding == out[4].embedding and len(out[0].embedding) == 64
    assert np.allclose([np.linalg.norm(out[i].embedding) for i in (0, 2, 3, 5)], 1, atol=1e-6)
    one, _, _ = E.embed_batch(["hello world"], E.EncoderSpec())
    assert np.abs(one[0] - np.array(out[0].embedding)).max() < 1e-6
    assert E.embed_records(df.limit(0)).count() == 0
    other = E.EncoderSpec().with_options(pooling="cls", normalize=False, prefix="query: ")
    assert other.tag != E.EncoderSpec().tag
    with pytest.raises(ValueError):
        E.same_model(E.embed_records(df), E.embed_records(df, spec=other))
    assert E.self_check(E.embed_records(df), E.embed_records(df), "id") < 1e-9
    with pytest.warns(UserWarning):
        E.self_check(E.embed_records(df), E.embed_records(df, spec=other), "id")


def test_filters_go_below_embed(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as string) text").write.parquet(str(tmp_path / "t"))
    plan = E.embed_records(spark.read.parquet(str(tmp_path / "t"))).where("id = 3")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), EqualTo(id,3)]" in plan
    assert "ArrowEvalPython" not in E.embed_records(spark.read.parquet(str(tmp_path / "t"))).select("id")._jdf.queryExecution().executedPlan().toString()


def test_quantized_weights():
    w = np.array([[0.0, 0.0], [1.27, -0.005], [-2.54, 0.01]], np.float32)
    codes, scale = S.int8_rows(w)
    assert codes.tolist() == [[0, 0], [127, -1], [-127, 1]] and np.allclose(scale.ravel(), [1, 0.01, 0.02])
    weights = S.synthetic_weights(S.TINY)
    assert S.quantized_weights(weights, "none") is weights
    some, every = S.quantized_weights(weights, "embeddings"), S.quantized_weights(weights, "all")
    changed = lambda q: {k for k in q if not np.array_equal(q[k], weights[k])}
    assert changed(some) == {"embeddings.tok_embeddings.weight"} and changed(every) == {k for k in weights if weights[k].ndim == 2}


def test_options_of_embed(spark):
    texts = ["one two three", "a " * 100, ""]
    base, _, _ = E.embed_batch(texts, E.EncoderSpec())
    padded, _, _ = E.embed_batch(texts, E.EncoderSpec().with_options(pad_to_shapes=True))
    low, _, _ = E.embed_batch(texts, E.EncoderSpec().with_options(quantize="all"))
    assert np.abs(base - padded).max() < 1e-5
    assert 1e-7 < np.abs(base - low).max() < 0.1
    with pytest.raises(S.UnsupportedRequest):
        S.Options(pad_to_shapes=True, max_seq_length=1024)
    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "id int, text string")
    out = E.embed_records(df)
    assert out.schema["embedding"].metadata["model_tag"] == E.EncoderSpec().tag
    done = out.where("id = 1").select(F.sha2("text", 256).alias("text_key"), "model_tag")
    assert {r.id for r in E.pending(df, done, E.EncoderSpec()).collect()} == {2, 3}
    assert E.pending(df, done, E.EncoderSpec().with_options(pooling="cls")).count() == 3
