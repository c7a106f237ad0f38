"""Column functions over texts: tokens, their ids and lengths, truncation, padding, hashes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Special ids, the default limits and shapes
PAD, CLS, SEP, FIRST_ID = 0, 1, 2, 3
MAX_LENGTH, BATCH_SIZE = 512, 64
SHAPES = (64, 128, 256, 512)
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    """Runs of letters and digits, and single other characters that aren't white space."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Parts between ASCII blanks."""
    return F.filter(F.split(text, r"[ \t\n\r]+"), lambda w: w != "")


def token_id(token: Column, vocabulary: int = 32_768) -> Column:
    """A stand-in for a vocabulary: the token's md5 folded onto the ids that aren't special."""
    return (F.pmod(F.conv(F.substring(F.md5(token), 1, 8), 16, 10).cast("long"), F.lit(vocabulary - FIRST_ID)) + FIRST_ID).cast("int")


def encoded_ids(text: Column, limit: int = MAX_LENGTH, vocabulary: int = 32_768) -> Column:
    """CLS, the ids of the first limit - 2 tokens, SEP."""
    kept = F.transform(F.slice(tokens(text), 1, limit - 2), lambda t: token_id(t, vocabulary))
    return F.concat(F.array(F.lit(CLS)), kept, F.array(F.lit(SEP)))


def n_tokens(text: Column, limit: int = MAX_LENGTH) -> Column:
    return F.least(F.lit(limit), F.size(tokens(text)) + 2)


def is_truncated(text: Column, limit: int = MAX_LENGTH) -> Column:
    """Only a text beyond the limit is truncated, not one that meets it."""
    return F.size(tokens(text)) + 2 > limit


def padded(ids: Column, length: Column) -> Column:
    """Zero-filled up to length; the pad id is 0 whatever the vocabulary calls it."""
    return F.concat(ids, F.array_repeat(F.lit(PAD), length - F.size(ids)))


def mask(ids: Column, length: Column) -> Column:
    return F.concat(F.transform(ids, lambda _: F.lit(1)), F.array_repeat(F.lit(0), length - F.size(ids)))


def additive_mask(mask: Column) -> Column:
    """0 where the mask is 1, a large finite negative elsewhere: rows without any token stay finite."""
    return F.transform(mask, lambda m: (1 - m) * F.lit(-10_000.0))


def wrapped_id(token: Column, vocabulary: int) -> Column:
    """Negative ids count from the vocabulary's end."""
    return F.when(token >= 0, token).otherwise(token + vocabulary)


def rows_per_forward(length: Column, budget: int = 2 * 512 * 512, most: int | None = None) -> Column:
    """How many rows of a length fit a forward pass: the budget over the squared length, one at least."""
    rows = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.lit(1), length * length)).cast("int"))
    return rows if most is None else F.least(F.lit(most), rows)


def shape_for(length: Column, shapes: tuple[int, ...] = SHAPES) -> Column:
    """The smallest fixed shape that holds a length; null if none does."""
    return F.array_min(F.filter(F.array(*[F.lit(s) for s in sorted(set(shapes))]), lambda s: s >= length))


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME & 0xFFFFFFFFFFFFFFFF
    return h


@F.pandas_udf(StringType())
def fnv1a_hex(text: pd.Series) -> pd.Series:
    """64 bit FNV-1a of the UTF-8 bytes as 16 hex digits; the texts of a batch are hashed byte column by byte column."""
    raw = [None if t is None else t.encode() for t in text]
    order = sorted((i for i, r in enumerate(raw) if r is not None), key=lambda i: -len(raw[i]))
    h = np.full(len(order), FNV_OFFSET, np.uint64)
    longest = len(raw[order[0]]) if order else 0
    sizes = np.array([len(raw[i]) for i in order])
    data = np.zeros((len(order), longest), np.uint8) if len(order) * longest <= 1 << 26 else None
    if data is None:
        h = np.array([fnv1a(raw[i]) for i in order], np.uint64)
    else:
        for k, i in enumerate(order):
            data[k, : sizes[k]] = np.frombuffer(raw[i], np.uint8)
        with np.errstate(over="ignore"):
            for c in range(longest):
                live = int(np.searchsorted(-sizes, -c, side="left"))
                h[:live] = (h[:live] ^ data[:live, c]) * np.uint64(FNV_PRIME)
    out: list[str | None] = [None] * len(raw)
    for k, i in enumerate(order):
        out[i] = f"{int(h[k]):016x}"
    return pd.Series(out, dtype=object)
