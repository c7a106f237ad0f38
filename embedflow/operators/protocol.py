"""The line protocol: which lines are records, batch ends or errors, and what a record holds."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from embedflow.operators.running import BUCKET_ROWS, buckets, position, running_sum

# Unicode White_Space
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
# Reasons for which a line is skipped
INVALID, NOT_OBJECT, NO_ID, NO_TEXT, EMPTY_TEXT = "invalid JSON", "not a JSON object", 'missing "id"', 'missing or non-string "text"', 'empty "text"'

PARSED = T.StructType([T.StructField(c, T.StringType()) for c in ("kind", "skip_reason", "id_json", "text")])


class Parsed(NamedTuple):
    kind: str
    skip_reason: str | None = None
    id_json: str | None = None
    text: str | None = None


def _no_constant(name: str):
    raise ValueError(name)


def _finite(digits: str) -> float:
    value = float(digits)
    if math.isinf(value):
        raise ValueError("number out of range")
    return value


_decoder = json.JSONDecoder(parse_constant=_no_constant, parse_float=_finite)


def decode(line: str):
    """The JSON value of a line; ValueError for what a strict parser refuses (NaN, numbers out of range, trailing text, lone surrogates)."""
    try:
        value, end = _decoder.raw_decode(line, len(line) - len(line.lstrip(" \t\n\r")))
        if line[end:].strip(" \t\n\r"):
            raise ValueError("trailing characters")
        if "\\u" in line:
            json.dumps(value, ensure_ascii=False).encode()
        return value
    except RecursionError:
        raise ValueError("nested too deeply") from None


def compact(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def parse_line(line: str | None) -> Parsed:
    """A null line and a blank one end a batch; the first failing check names the skip reason."""
    if line is None or not line.strip(WHITE_SPACE):
        return Parsed("flush")
    try:
        value = decode(line)
    except ValueError:
        return Parsed("skip", INVALID)
    if not isinstance(value, dict):
        return Parsed("skip", NOT_OBJECT)
    if "id" not in value:
        return Parsed("skip", NO_ID)
    text = value.get("text")
    if not isinstance(text, str):
        return Parsed("skip", NO_TEXT)
    if not text:
        return Parsed("skip", EMPTY_TEXT)
    return Parsed("record", None, compact(value["id"]), text)


@F.pandas_udf(PARSED)
def parse_udf(lines: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_line(x) for x in lines], columns=list(Parsed._fields))


def is_blank(line: Column) -> Column:
    """Unicode white space only (trim() would strip U+0020 alone)."""
    return line.rlike(r"(?U)^\s*$")


def parse_lines(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Adds kind (record, flush, skip), skip_reason, id_json and text; other columns stay, those four are replaced."""
    kept = [F.col(f"`{c}`") for c in lines.columns if c not in Parsed._fields]
    return lines.select(*kept, parse_udf(F.col(f"`{line_col}`")).alias("_p")).select(*kept, "_p.*")


def with_batches(lines: DataFrame, order_col: str = "line_no", stream_col: str | None = None, is_end: Column | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds batch_no: the number of batch ends before a line, within its stream; order_col is a whole number."""
    end = F.coalesce((F.col("kind") == "flush") if is_end is None else is_end, F.lit(False)).cast("long")
    out = running_sum(lines.drop("batch_no"), end, [order_col], buckets(F.col(order_col), bucket_rows), "batch_no", [stream_col] if stream_col else [])
    return out.withColumn("batch_no", F.col("batch_no").cast("int"))


def with_chunks(records: DataFrame, size: int = 1024, order_col: str = "line_no", by: tuple[str, ...] = ("batch_no",), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds index, the position of a record in its batch, and chunk_no: batches in runs of `size`."""
    out = position(records, [order_col], buckets(F.col(order_col), bucket_rows), "index", by)
    return out.withColumn("index", F.col("index").cast("int")).withColumn("chunk_no", F.floor(F.col("index") / size).cast("int"))


def with_prefix(records: DataFrame, prefix: Column | str, text_col: str = "text") -> DataFrame:
    """The text as it is embedded: prefix and text, nothing trimmed."""
    return records.withColumn("input_text", F.concat(F.coalesce(prefix if isinstance(prefix, Column) else F.lit(prefix), F.lit("")), F.col(text_col)))


def quarantine(parsed: DataFrame) -> DataFrame:
    """Skipped lines with the message that reports them."""
    return parsed.where("kind = 'skip'").withColumn("message", F.format_string("skip line %d: %s", "line_no", "skip_reason"))


def accepted_records(batches: Iterable[pa.RecordBatch], number: str, line: str) -> Iterator[tuple[list[int], list]]:
    """Line numbers and (id, text) of the records among Arrow batches of lines, parsed once."""
    for b in batches:
        numbers, found = [], []
        for no, raw in zip(b.column(number).to_pylist(), b.column(line).to_pylist()):
            if raw is None or no is None:
                continue
            try:
                value = decode(raw)
            except ValueError:
                continue
            if isinstance(value, dict) and "id" in value and isinstance(t := value.get("text"), str) and t:
                numbers.append(no)
                found.append((value["id"], t))
        yield numbers, found
