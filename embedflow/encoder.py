"""The encoder's forward pass in numpy, for padded batches, and its pooling."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from embedflow.spec import EncoderConfig

BLOCKED = np.float32(-1e4)  # finite: a row without a key to look at stays finite
EXP_FLOOR = np.float32(-87.0)


def to_bf16(x: np.ndarray) -> np.ndarray:
    """Rounded to the nearest bfloat16, ties to even, kept as float32."""
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32).astype(np.uint64)
    bits += 0x7FFF + ((bits >> 16) & 1)
    return (bits & 0xFFFF0000).astype(np.uint32).view(np.float32)


def layer_norm(x: np.ndarray, gamma: np.ndarray, eps: float) -> np.ndarray:
    x = x - x.mean(axis=-1, keepdims=True)
    return x / np.sqrt((x * x).mean(axis=-1, keepdims=True) + eps) * gamma


def erf(x: np.ndarray) -> np.ndarray:
    from embedflow.functions.vectors import ERF_A, ERF_P

    t = 1 / (1 + ERF_P * np.abs(x))
    poly = np.zeros_like(x)
    for a in reversed(ERF_A):
        poly *= t
        poly += np.float32(a)
    poly *= t
    poly *= np.exp(-x * x)
    return np.copysign(1 - poly, x)


def gelu(x: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """x / 2 * (1 + erf(x / sqrt 2)) in float32, in place and in blocks small enough for the cache."""
    from embedflow.functions.vectors import ERF_A, ERF_P

    x = np.ascontiguousarray(x, np.float32)
    flat, out = x.reshape(-1), np.empty(x.size, np.float32)
    t, e = np.empty(block, np.float32), np.empty(block, np.float32)
    for start in range(0, len(flat), block):
        own, y = flat[start : start + block], out[start : start + block]
        t, e = t[: len(own)], e[: len(own)]
        np.multiply(own, np.float32(0.7071067811865476), out=e)
        np.abs(e, out=t)
        t *= np.float32(ERF_P)
        t += np.float32(1)
        np.reciprocal(t, out=t)
        np.multiply(e, e, out=e)
        np.exp(np.negative(e, out=e), out=e)
        np.multiply(t, np.float32(ERF_A[-1]), out=y)
        for a in reversed(ERF_A[:-1]):
            y += np.float32(a)
            y *= t
        y *= e
        np.copysign(np.subtract(1, y, out=y), own, out=y)
        y += np.float32(1)
        y *= own
        y *= np.float32(0.5)
    return out.reshape(x.shape)


def activate(x: np.ndarray, name: str) -> np.ndarray:
    return gelu(x) if name == "gelu" else x / (1 + np.exp(-x))


def rotary_tables(length: int, dim: int, theta: float) -> tuple[np.ndarray, np.ndarray]:
    angle = np.arange(length)[:, None] * theta ** (-2.0 * np.arange(dim // 2) / dim)[None, :]
    both = np.concatenate([angle, angle], axis=1)
    return np.cos(both).astype(np.float32), np.sin(both).astype(np.float32)


def rotate(x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    half = x.shape[-1] // 2
    return x * tables[0] + np.concatenate([-x[..., half:], x[..., :half]], axis=-1) * tables[1]


@lru_cache(maxsize=256)
def band(queries: int, keys: int, offset: int, window: int) -> np.ndarray:
    """Blocks the keys further than window from each query; the first query stands at key `offset`."""
    apart = np.abs(np.arange(queries)[:, None] + offset - np.arange(keys)[None, :])
    return np.where(apart > window, 2 * BLOCKED, np.float32(0))


def _attention(q, k, v, mask: np.ndarray, window: int | None, block: int, reach: int) -> np.ndarray:
    """Blocks of queries against the keys at most reach away, in place and small enough for the cache."""
    out, length = np.empty_like(q), q.shape[2]
    q, k = q * np.float32(q.shape[-1] ** -0.5), k.swapaxes(-1, -2)
    padding = None if mask.all() else ((1 - mask) * BLOCKED).astype(np.float32)
    for start in range(0, length, block):
        stop, first, last = min(start + block, length), max(0, start - reach), min(length, start + block + reach)
        s = q[:, :, start:stop] @ k[..., first:last]
        if padding is not None:
            s += padding[:, None, None, first:last]
        if window is not None:
            s += band(stop - start, last - first, start - first, window)
        s -= s.max(axis=-1, keepdims=True)
        np.exp(np.maximum(s, EXP_FLOOR, out=s), out=s)
        out[:, :, start:stop] = s @ v[:, :, first:last]
        out[:, :, start:stop] /= s.sum(axis=-1, keepdims=True)
    return out


def dense_attention(q, k, v, mask: np.ndarray, window: int | None, block: int = 128) -> np.ndarray:
    """q, k, v: (rows, heads, length, width); mask: (rows, length) with 1 for tokens. Every query meets every key."""
    return _attention(q, k, v, mask, window, block, q.shape[2])


def banded_attention(q, k, v, mask: np.ndarray, window: int, block: int = 64) -> np.ndarray:
    """As dense_attention, but each block of queries meets only the keys within its reach."""
    return _attention(q, k, v, mask, window, block, window)


class Encoder:
    def __init__(self, config: EncoderConfig, weights: dict[str, np.ndarray], precision: str = "f32"):
        self.c, self.bf16, self._tables = config.checked(), precision == "bf16", {}
        self.w = {k: to_bf16(v) if self.bf16 and v.ndim == 2 else v for k, v in weights.items()}

    def linear(self, x: np.ndarray, name: str) -> np.ndarray:
        """One product over all rows and positions: a stack of them would be multiplied one by one."""
        flat = (to_bf16(x) if self.bf16 else x).reshape(-1, x.shape[-1])
        return (flat @ self.w[name].T).reshape(*x.shape[:-1], -1)

    def tables(self, length: int, theta: float):
        if (length, theta) not in self._tables:
            self._tables[length, theta] = rotary_tables(length, self.c.hidden // self.c.heads, theta)
        return self._tables[length, theta]

    def __call__(self, ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Hidden states (rows, length, hidden) of padded ids and their mask."""
        c, w = self.c, self.w
        rows, length = ids.shape
        x = layer_norm(w["embeddings.tok_embeddings.weight"][ids], w["embeddings.norm.weight"], c.eps)
        mask = mask.astype(np.float32)
        for i in range(c.layers):
            p = f"layers.{i}."
            h = layer_norm(x, w[p + "attn_norm.weight"], c.eps) if i else x  # the first layer's input is normed already
            qkv = self.linear(h, p + "attn.Wqkv.weight").reshape(rows, length, 3, c.heads, c.hidden // c.heads)
            q, k, v = qkv.transpose(2, 0, 3, 1, 4)
            local = c.is_local(i)
            turn = self.tables(length, c.theta_local if local else c.theta_global)
            q, k = rotate(q, turn), rotate(k, turn)
            window = c.local_attention // 2
            if local and length > 2 * (2 * window + 1):
                a = banded_attention(q, k, v, mask, window)
            else:
                a = dense_attention(q, k, v, mask, window if local else None)
            x = x + self.linear(a.transpose(0, 2, 1, 3).reshape(rows, length, c.hidden), p + "attn.Wo.weight")
            g = self.linear(layer_norm(x, w[p + "mlp_norm.weight"], c.eps), p + "mlp.Wi.weight")
            x = x + self.linear(activate(g[..., : c.intermediate], c.activation) * g[..., c.intermediate :], p + "mlp.Wo.weight")
        return layer_norm(x, w["final_norm.weight"], c.eps)


def pool(hidden: np.ndarray, mask: np.ndarray, kind: str) -> np.ndarray:
    """Mean over the tokens (zeros where there are none) or the first token's state, whatever its mask."""
    if kind == "cls":
        return hidden[:, 0].astype(np.float32)
    m = mask.astype(np.float32)[:, :, None]
    return ((hidden * m).sum(axis=1) / np.maximum(m.sum(axis=1), 1)).astype(np.float32)


def normalize(v: np.ndarray) -> np.ndarray:
    """Unit rows: the norm in double, the division in float; zero rows stay."""
    n = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)[:, None]
    return np.where(n > 0, v / np.where(n > 0, n, 1), v).astype(np.float32)


def rows_per_forward(length: int, budget: int = 2 * 512 * 512, most: int | None = None) -> int:
    rows = max(1, budget // max(1, length * length))
    return rows if most is None else min(most, rows)
