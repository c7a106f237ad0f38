"""embed(): texts to vectors as a column, in Arrow batches of Python workers.

A scalar pandas UDF, so that Catalyst still pushes filters below it and drops it where its result isn't used. Do a
semi-join before it: Catalyst doesn't push one below.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedflow.runtime import ship_file
from embedflow.spec import EncoderSpec

EMBEDDED = T.StructType([T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("n_tokens", T.IntegerType()), T.StructField("truncated", T.BooleanType())])
_runs = None
_sent: set[tuple[str, str]] = set()


def _split(text: str) -> list[str]:
    global _runs
    if _runs is None:
        import regex

        _runs = regex.compile(r"[\p{L}\p{N}]+|[^ \t\n\x0b\f\r\p{L}\p{N}]")
    return _runs.findall(text)


def _shipped_name(path: str) -> str:
    from embedflow.functions.text import fnv1a

    return f"{fnv1a(path.encode()):016x}-{Path(path).name}"


def ship_checkpoint(spark: SparkSession, spec: EncoderSpec) -> None:
    """Sends weights and tokenizer to all workers, once a session; they are opened there, not at the driver's path."""
    for path in filter(None, (spec.model_path, spec.tokenizer_path)):
        key = (spark.sparkContext.applicationId, path)
        if key not in _sent:
            _sent.add(key)
            ship_file(spark, path, _shipped_name(path))


def _here(path: str) -> str:
    """The worker's own copy of a shipped file, or the path itself where nothing was shipped."""
    from pyspark import SparkFiles

    try:
        own = SparkFiles.get(_shipped_name(path))
    except Exception:  # no session and no worker
        return path
    return own if Path(own).exists() else path


class Tokenizer:
    """The stand-in of functions.text, or a tokenizer.json; both cut at the limit, special tokens included."""

    def __init__(self, spec: EncoderSpec):
        self.limit, self.vocab, self.real, self.known = spec.options.max_seq_length, spec.config.vocab, None, {}
        if spec.tokenizer_path:
            from tokenizers import Tokenizer as Real

            self.real = Real.from_file(_here(spec.tokenizer_path))
            self.real.enable_truncation(self.limit)
            self.real.no_padding()

    def token_id(self, token: str) -> int:
        if (found := self.known.get(token)) is None:
            from hashlib import md5

            found = int(md5(token.encode()).hexdigest()[:8], 16) % (self.vocab - 3) + 3
            if len(self.known) < 1 << 20:
                self.known[token] = found
        return found

    def __call__(self, texts: list[str]) -> list[tuple[list[int], bool]]:
        if self.real is not None:
            return [(e.ids, bool(e.overflowing)) for e in self.real.encode_batch(texts, add_special_tokens=True)]
        out = []
        for t in texts:
            parts = _split(t)
            out.append(([1, *map(self.token_id, parts[: self.limit - 2]), 2], len(parts) + 2 > self.limit))
        return out


@lru_cache(maxsize=2)
def _worker(spec: EncoderSpec):
    """Weights and tokenizer, loaded once in a worker process on its first batch that isn't empty."""
    from embedflow.encoder import Encoder
    from embedflow.spec import named_weights, quantized_weights, read_safetensors, synthetic_weights

    weights = named_weights(read_safetensors(_here(spec.model_path)), spec.config) if spec.model_path else synthetic_weights(spec.config)
    encoder = Encoder(spec.config, quantized_weights(weights, spec.options.quantize), spec.options.precision)
    check_output(encoder(np.zeros((1, 2), np.int64), np.ones((1, 2), np.int64)), (1, 2, spec.config.hidden))
    return Tokenizer(spec), encoder


def check_output(hidden: np.ndarray, shape: tuple[int, int, int]) -> None:
    """Refuses an encoder whose output isn't rows x length x the width of its configuration."""
    if hidden.shape != shape or not np.isfinite(hidden).all():
        raise ValueError(f"the encoder gives {hidden.shape}, not finite values of {shape}")


def embed_batch(texts: list[str], spec: EncoderSpec) -> tuple[np.ndarray, list[int], list[bool]]:
    """Tokenize, sort by length, pad each batch to its own longest, split by memory, encode, pool, put back in order."""
    from embedflow.encoder import normalize, pool, rows_per_forward

    o = spec.options
    tokenizer, encoder = _worker(spec)
    coded = tokenizer([o.prefix + t for t in texts])
    order = np.argsort([len(i) for i, _ in coded], kind="stable")
    out = np.zeros((len(texts), spec.config.hidden), np.float32)
    for start in range(0, len(order), o.batch_size):
        batch = order[start : start + o.batch_size]
        length = max(len(coded[i][0]) for i in batch)
        if o.pad_to_shapes:
            length = next(s for s in o.shapes if s >= length)
        ids = np.zeros((len(batch), length), np.int64)
        mask = np.zeros((len(batch), length), np.int64)
        for r, i in enumerate(batch):
            n = len(coded[i][0])
            ids[r, :n], mask[r, :n] = coded[i][0], 1
        step = rows_per_forward(length, most=4 if o.precision == "bf16" else None)
        for a in range(0, len(batch), step):
            vectors = pool(encoder(ids[a : a + step], mask[a : a + step]), mask[a : a + step], spec.pooling)
            out[batch[a : a + step]] = normalize(vectors) if o.normalize else vectors
    return out, [len(i) for i, _ in coded], [t for _, t in coded]


def embed(text: Column | str, spec: EncoderSpec = EncoderSpec()) -> Column:
    """struct<embedding, n_tokens, truncated>; null for a null text. The empty text is embedded."""
    spec.config.checked(spec.options.max_seq_length)
    if (spec.model_path or spec.tokenizer_path) and (spark := SparkSession.getActiveSession()):
        ship_checkpoint(spark, spec)

    @F.pandas_udf(EMBEDDED)
    def run(texts: pd.Series) -> pd.DataFrame:
        known = texts.notna().to_numpy()
        out = pd.DataFrame({c: pd.Series([None] * len(texts), dtype=object) for c in EMBEDDED.names})
        if known.any():
            vectors, sizes, cut = embed_batch(texts[known].tolist(), spec)
            at = np.flatnonzero(known)
            for c, values in zip(EMBEDDED.names, (list(vectors), sizes, cut)):
                out[c] = pd.Series(values, index=at, dtype=object).reindex(range(len(texts)))
        return out

    return run(text)


def embed_records(records: DataFrame, spec: EncoderSpec = EncoderSpec(), text_col: str = "text") -> DataFrame:
    """Adds embedding, n_tokens, truncated and model_tag; columns of those names are replaced."""
    made = [*EMBEDDED.names, "model_tag"]
    kept = [F.col(f"`{c}`") for c in records.columns if c not in made]
    vector = F.col("_e.embedding").alias("embedding", metadata={"model_tag": spec.tag, "dim": spec.config.hidden})
    return records.select(*kept, embed(F.col(f"`{text_col}`"), spec).alias("_e")).select(*kept, vector, "_e.n_tokens", "_e.truncated", F.lit(spec.tag).alias("model_tag"))


def pending(records: DataFrame, done: DataFrame, spec: EncoderSpec, text_col: str = "text") -> DataFrame:
    """The records whose text has no vector of this model yet. done: (text_key, model_tag), text_key as sha2(text, 256).

    For incremental runs: embed what is pending, append it to the table of done texts.
    """
    have = done.where(F.col("model_tag") == spec.tag).select("text_key").distinct()
    return records.withColumn("text_key", F.sha2(F.col(f"`{text_col}`"), 256)).join(have, "text_key", "left_anti")


def same_model(a: DataFrame, b: DataFrame) -> None:
    """Refuses to compare vectors of unlike provenance."""
    tags = a.select("model_tag").union(b.select("model_tag")).distinct().limit(2).collect()
    if len(tags) > 1:
        raise ValueError(f"vectors of unlike models: {sorted(str(t.model_tag) for t in tags)}")


def self_check(a: DataFrame, b: DataFrame, key: str, threshold: float = 1e-4) -> float:
    """The worst 1 - cos of two encoders over the same keys; warns beyond the threshold, never fails."""
    import warnings

    from embedflow.functions import vectors as V

    worst = a.select(key, F.col("embedding").alias("x")).join(b.select(key, F.col("embedding").alias("y")), key).agg(F.max(1 - V.cosine(F.col("x"), F.col("y")))).first()[0]
    if worst is None or not worst <= threshold:
        warnings.warn(f"encoders differ: 1 - cos is {worst}", stacklevel=2)
    return float("nan") if worst is None else worst
