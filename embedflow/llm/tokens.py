"""Sizes of texts in tokens of a public tokenizer, counted over whole texts."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from embedflow.runtime import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: how the byte-level vocabulary splits a text before its merges
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(path: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, **more: Column) -> DataFrame:
    """(id, n_tokens) and the columns given by more; 0 tokens for null and empty texts."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(tokenizer)
        for b in batches:
            sizes = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column("t").to_pylist()]
            keep = [n for n in b.schema.names if n != "t"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    inner = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), *(c.alias(n) for n, c in more.items()), F.col(f"`{text_col}`").alias("t"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in inner.schema if f.name != "t") + ", n_tokens long"
    return spread(inner, "id").mapInArrow(count, schema)
