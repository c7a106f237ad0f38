"""Text sources: protocol files, text per line, argument lists; and the two output shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from embedflow.operators.protocol import is_blank
from embedflow.operators.running import BUCKET_ROWS, buckets, position
from embedflow.runtime import materialize


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line): lines end at \\n alone, a \\r before it is dropped, a final \\n is no blank line.

    A file is one stream and is numbered from 1; large files are read in parts. Bytes that aren't UTF-8 are an error;
    a byte order mark at the start of a file is dropped.
    """
    return numbered_lines(raw_lines(spark.read.option("lineSep", "\n").text(path)))


def raw_lines(text: DataFrame) -> DataFrame:
    """(file, part, line) of a text source with lineSep \\n, also of a stream; part is where a line's part of the file begins."""
    line = F.regexp_replace(F.expr("validate_utf8(value)"), "\r$", "")
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), line.alias("line"))


def numbered_lines(raw: DataFrame) -> DataFrame:
    """(file, line_no, line) of (file, part, line): lines are counted by part, then within it.

    The order within a part is known only while it is read, so that it is written down first: parts may be cut
    otherwise when they are read again.
    """
    seen = materialize(raw.withColumn("_m", F.monotonically_increasing_id()), "lines")
    out = position(seen, ["_m"], [F.col("part"), F.floor(F.col("_m") / BUCKET_ROWS)], "_n", ["file"])
    return out.select("file", (F.col("_n") + 1).cast("int").alias("line_no"), "line")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text): the non-blank lines of a file, numbered from 0."""
    lines = read_lines(spark, path).where(~is_blank(F.col("line")))
    return position(lines, ["line_no"], buckets(F.col("line_no")), "id", ["file"]).select("id", F.col("line").alias("text"))


def from_arguments(spark: SparkSession, texts: Sequence[str]) -> DataFrame:
    """(id, text): the position of each text; nothing is skipped, not even the empty text."""
    return spark.createDataFrame(list(enumerate(texts)), "id int, text string")


def number_list(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def jsonl_line(id_json: Column, embedding: Column, n_tokens: Column | None = None, truncated: Column | None = None, report: Column | None = None) -> Column:
    """One output record; the token members are left out, not null, unless they are reported."""
    tail = F.lit("")
    if n_tokens is not None and truncated is not None:
        members = F.concat(F.lit(',"n_tokens":'), n_tokens.cast("string"), F.lit(',"truncated":'), truncated.cast("string"))
        tail = F.when(F.coalesce(report if report is not None else F.lit(True), F.lit(False)), F.coalesce(members, F.lit(""))).otherwise("")
    return F.concat(F.lit('{"id":'), id_json, F.lit(',"embedding":'), number_list(embedding), tail, F.lit("}"))


def openai_item(index: Column, embedding: Column) -> Column:
    return F.concat(F.lit('{"object":"embedding","index":'), index.cast("string"), F.lit(',"embedding":'), number_list(embedding), F.lit("}"))


def json_text(text: Column) -> Column:
    """A text as a JSON string, quoted and escaped."""
    whole = F.to_json(F.struct(text.alias("t")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def openai_document(items: Column, model: Column, tokens: Column) -> Column:
    n = F.coalesce(tokens, F.lit(0)).cast("string")
    return F.concat(F.lit('{"object":"list","data":['), items, F.lit('],"model":'), json_text(F.coalesce(model, F.lit(""))), F.lit(',"usage":{"prompt_tokens":'), n, F.lit(',"total_tokens":'), n, F.lit("}}"))


def openai_documents(batches: DataFrame, records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A document for each batch, also for one without records.

    batches: keys and model; records: keys, index, embedding, n_tokens. A document is one request's answer and is
    built by one task, so a batch must be of a request's size.
    """
    if "n_tokens" not in records.columns:
        records = records.withColumn("n_tokens", F.lit(0))
    joined = records.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("index", openai_item(F.col("index"), F.col("embedding")).alias("item")))), lambda s: s["item"]), ",").alias("items"),
        F.count("*").alias("n"), F.sum("n_tokens").alias("tokens"),
    )
    out = batches.join(joined, list(keys), "left")
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("tokens", F.lit(0)).cast("long").alias("prompt_tokens"), openai_document(F.coalesce("items", F.lit("")), F.col("model"), F.col("tokens")).alias("document"))
