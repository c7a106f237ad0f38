"""Options and encoder configuration, validated eagerly on the driver."""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field, replace
from pathlib import Path

import numpy as np

# Defaults of the options
MAX_SEQ_LENGTH, BATCH_SIZE, EPS, POSITION_LIMIT = 512, 64, 1e-5, 4096
SHAPES = (64, 128, 256, 512)
QUANTIZE = {"none": "fp16", "embeddings": "emb8", "all": "all8"}


class UnsupportedRequest(ValueError):
    """Asked for something that this engine refuses rather than replaces."""


@dataclass(frozen=True)
class Options:
    prefix: str = ""
    pooling: str | None = None
    normalize: bool = True
    max_seq_length: int = MAX_SEQ_LENGTH
    batch_size: int = BATCH_SIZE
    precision: str = "f32"
    device: str = "cpu"
    format: str = "jsonl"
    report_tokens: bool = False
    shapes: tuple[int, ...] = SHAPES
    pad_to_shapes: bool = False
    quantize: str = "none"

    def __post_init__(self):
        if self.device != "cpu":
            raise UnsupportedRequest(f"device {self.device!r}: only cpu")
        if self.precision not in ("f32", "bf16"):
            raise UnsupportedRequest(f"precision {self.precision!r}")
        if self.pooling not in (None, "mean", "cls"):
            raise UnsupportedRequest(f"pooling {self.pooling!r}")
        if self.format not in ("jsonl", "openai"):
            raise UnsupportedRequest(f"format {self.format!r}")
        if self.format == "openai" and self.report_tokens:
            raise UnsupportedRequest("token counts can't be reported in the openai format")
        if self.quantize not in QUANTIZE:
            raise UnsupportedRequest(f"quantize {self.quantize!r}")
        if not self.shapes or min(self.shapes) < 1:
            raise ValueError("shapes must be positive lengths")
        object.__setattr__(self, "shapes", tuple(sorted(set(self.shapes))))
        object.__setattr__(self, "batch_size", max(1, self.batch_size))
        if self.pad_to_shapes and self.max_seq_length > self.shapes[-1]:
            raise UnsupportedRequest(f"max_seq_length {self.max_seq_length} exceeds the largest shape {self.shapes[-1]}")
        if self.max_seq_length < 2:
            raise ValueError("max_seq_length must leave room for two special tokens")


@dataclass(frozen=True)
class EncoderConfig:
    vocab: int
    hidden: int
    layers: int
    heads: int
    intermediate: int
    max_positions: int = 8192
    pad_id: int = 0
    eps: float = EPS
    global_every: int = 3
    local_attention: int = 128
    theta_global: float = 160_000.0
    theta_local: float = 10_000.0
    activation: str = "gelu"

    def is_local(self, layer: int) -> bool:
        return layer % self.global_every != 0

    def checked(self, length: int | None = None) -> "EncoderConfig":
        if reasons := self.reasons(length):
            raise UnsupportedRequest("; ".join(reasons))
        return self

    def reasons(self, length: int | None = None) -> list[str]:
        out = []
        if self.global_every < 1:
            out.append("the interval of global layers must be at least 1")
        if self.hidden % self.heads:
            out.append("hidden isn't divisible by heads")
        elif self.hidden // self.heads % 2:
            out.append("the width of a head is odd")
        if self.activation not in ("gelu", "silu"):
            out.append(f"activation {self.activation!r}")
        if length is not None:
            if length < 1:
                out.append("no length")
            elif length > self.max_positions:
                out.append("the length exceeds max_position_embeddings")
            elif length > POSITION_LIMIT:
                out.append(f"the length exceeds {POSITION_LIMIT}")
        return out


def _unique(members: list[tuple[str, object]]) -> dict:
    if twice := sorted({k for k, _ in members if sum(k == other for other, _ in members) > 1}):
        raise UnsupportedRequest(f"the configuration names {', '.join(twice)} twice")
    return dict(members)


def config_from_json(text: str) -> EncoderConfig:
    """Reads both spellings of eps and of theta; collects every reason to refuse before it raises. A key may come once only."""
    raw = json.loads(text, object_pairs_hook=_unique)
    reasons = [f"{k} is set" for k in ("attention_bias", "mlp_bias", "norm_bias") if raw.get(k)]

    def theta(kind: str, flat: str) -> float:
        nested = (raw.get("rope_parameters") or {}).get(kind) or {}
        if nested.get("rope_type", "default") != "default":
            reasons.append(f"rope_type {nested['rope_type']!r}")
        value = nested.get("rope_theta", raw.get(flat))
        if value is None:
            reasons.append(f"neither rope_parameters.{kind}.rope_theta nor {flat}")
        return float(value or 0)

    eps = next((raw[k] for k in ("layer_norm_eps", "norm_eps") if raw.get(k) is not None), EPS)
    config = EncoderConfig(
        raw["vocab_size"], raw["hidden_size"], raw["num_hidden_layers"], raw["num_attention_heads"], raw["intermediate_size"], raw.get("max_position_embeddings", 8192), raw.get("pad_token_id") or 0,
        float(eps), raw.get("global_attn_every_n_layers", 3), raw.get("local_attention", 128), theta("full_attention", "global_rope_theta"), theta("sliding_attention", "local_rope_theta"),
        raw.get("hidden_activation") or "gelu",
    )
    kinds = raw.get("layer_types")
    if kinds and config.global_every >= 1 and [k == "sliding_attention" for k in kinds] != [config.is_local(i) for i in range(config.layers)]:
        reasons.append("layer_types don't follow the interval of global layers")
    if reasons := reasons + config.reasons():
        raise UnsupportedRequest("; ".join(reasons))
    return config


def detect_pooling(text: str | None) -> str | None:
    """From a pooling configuration; nothing where the cls switch is missing or isn't a boolean."""
    try:
        raw = json.loads(text or "")
    except ValueError:
        return None
    cls = raw.get("pooling_mode_cls_token") if isinstance(raw, dict) else None
    if not isinstance(cls, bool):
        return None
    return "cls" if cls else "mean" if raw.get("pooling_mode_mean_tokens") is True else None


def resolve_pooling(requested: str | None, detected: str | None) -> tuple[str, str | None]:
    if requested and detected and requested != detected:
        return requested, "mismatch"
    return requested or detected or "mean", None if requested or detected else "no config"


def weight_shapes(c: EncoderConfig) -> dict[str, tuple[int, ...]]:
    out: dict[str, tuple[int, ...]] = {"embeddings.tok_embeddings.weight": (c.vocab, c.hidden), "embeddings.norm.weight": (c.hidden,)}
    for i in range(c.layers):
        p = f"layers.{i}."
        out |= {p + "attn.Wqkv.weight": (3 * c.hidden, c.hidden), p + "attn.Wo.weight": (c.hidden, c.hidden)}
        if i:
            out[p + "attn_norm.weight"] = (c.hidden,)
        out |= {p + "mlp_norm.weight": (c.hidden,), p + "mlp.Wi.weight": (2 * c.intermediate, c.hidden), p + "mlp.Wo.weight": (c.hidden, c.intermediate)}
    return out | {"final_norm.weight": (c.hidden,)}


def synthetic_weights(c: EncoderConfig, scale: float = 0.125) -> dict[str, np.ndarray]:
    """Weights drawn from a generator that is seeded by each tensor's name; norms are 1."""
    from embedflow.functions.text import fnv1a

    out = {}
    for name, shape in weight_shapes(c).items():
        if name.endswith("norm.weight"):
            out[name] = np.ones(shape, np.float32)
        else:
            wide = 1.0 if "tok_embeddings" in name else scale
            out[name] = (np.random.default_rng(fnv1a(name.encode())).uniform(-1, 1, shape) * wide).astype(np.float32)
    return out


_DTYPES = {"F32": np.float32, "F16": np.float16, "F64": np.float64}


def read_safetensors(path: str | Path) -> dict[str, np.ndarray]:
    """Tensors as float32: an 8 byte length, a JSON header, then the data; BF16 is widened by its bits."""
    with open(path, "rb") as f:
        (size,) = struct.unpack("<Q", f.read(8))
        header = json.loads(f.read(size))
    data = np.memmap(path, np.uint8, "r", offset=8 + size)
    out = {}
    for name, t in header.items():
        if name == "__metadata__":
            continue
        a, b = t["data_offsets"]
        raw = data[a:b]
        if t["dtype"] == "BF16":
            values = (raw.view(np.uint16).astype(np.uint32) << 16).view(np.float32)
        elif t["dtype"] in _DTYPES:
            values = raw.view(_DTYPES[t["dtype"]]).astype(np.float32)
        else:
            raise UnsupportedRequest(f"dtype {t['dtype']} of {name}")
        out[name] = values.reshape(t["shape"])
    return out


def named_weights(tensors: dict[str, np.ndarray], c: EncoderConfig) -> dict[str, np.ndarray]:
    """The encoder's tensors, whose names may begin with 'model.'; a missing or misshapen one is an error, never zeros."""
    prefix = "model." if "model.embeddings.tok_embeddings.weight" in tensors else ""
    out = {}
    for name, shape in weight_shapes(c).items():
        if (found := tensors.get(prefix + name)) is None:
            raise KeyError(f"missing tensor {prefix + name}")
        if tuple(found.shape) != shape:
            raise ValueError(f"{prefix + name} is {tuple(found.shape)}, not {shape}")
        out[name] = np.asarray(found, np.float32)
    return out


def int8_rows(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, scales): a symmetric scale for each row, 1 for a zero row; halves are rounded away from zero."""
    scale = np.abs(w).max(axis=1, keepdims=True).astype(np.float32) / np.float32(127)
    scale[scale == 0] = 1
    x = w / scale
    return np.clip(np.copysign(np.floor(np.abs(x) + 0.5), x), -127, 127).astype(np.int8), scale


def quantized_weights(weights: dict[str, np.ndarray], level: str) -> dict[str, np.ndarray]:
    """Weights as they come back from 8 bits: of the embedding table, or of all matrices."""
    if level == "none":
        return weights

    def back(w: np.ndarray) -> np.ndarray:
        codes, scale = int8_rows(w)
        return codes * scale

    return {k: back(w) if w.ndim == 2 and (level == "all" or "tok_embeddings" in k) else w for k, w in weights.items()}


TINY = EncoderConfig(vocab=32, hidden=16, layers=3, heads=2, intermediate=8, max_positions=64, local_attention=4)
SMALL = EncoderConfig(vocab=4096, hidden=64, layers=3, heads=4, intermediate=96)


@dataclass(frozen=True)
class EncoderSpec:
    """What a worker needs to encode: configuration, options, and where weights and tokenizer are (none: synthetic)."""

    config: EncoderConfig = SMALL
    options: Options = field(default_factory=Options)
    pooling: str = "mean"
    model_path: str | None = None
    tokenizer_path: str | None = None
    label: str = "synthetic"

    @staticmethod
    def from_files(model_dir: str, tokenizer_path: str | None = None, options: Options = Options(), label: str | None = None) -> "EncoderSpec":
        """A checkpoint folder: model.safetensors, config.json, tokenizer.json and, at will, 1_Pooling/config.json."""
        root = Path(model_dir)
        config = config_from_json((root / "config.json").read_text()).checked(options.max_seq_length)
        weights, tokenizer = root / "model.safetensors", Path(tokenizer_path or root / "tokenizer.json")
        if lacking := [str(p) for p in (weights, tokenizer) if not p.is_file()]:
            raise FileNotFoundError(f"a checkpoint is its weights and its tokenizer; missing: {', '.join(lacking)}")
        pool = root / "1_Pooling" / "config.json"
        pooling, _ = resolve_pooling(options.pooling, detect_pooling(pool.read_text() if pool.exists() else None))
        return EncoderSpec(config, options, pooling, str(weights), str(tokenizer), label or root.name)

    def with_options(self, **changes) -> "EncoderSpec":
        options = replace(self.options, **changes)
        return replace(self, options=options, pooling=options.pooling or self.pooling)

    @property
    def tag(self) -> str:
        """Vectors of unlike tags must not be compared."""
        o = self.options
        return f"{self.label}-{self.config.hidden}-{self.pooling}-{o.max_seq_length}-{o.precision}-{QUANTIZE[o.quantize]}-{'n' if o.normalize else 'r'}"
