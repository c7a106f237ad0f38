"""What a run answers: lines in either format, and the summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from embedflow.operators import protocol as P
from embedflow.sources import lines as L
from embedflow.spec import EncoderSpec


def output_lines(records: DataFrame, parsed: DataFrame, spec: EncoderSpec, keys: tuple[str, ...] = ("file", "batch_no")) -> DataFrame:
    """(keys, line_no, value): a line for each record and an empty one for each batch end; or, in the openai format,
    a document for each batch, also for an empty one, and one empty document where there is no line at all."""
    o = spec.options
    if o.format == "openai":
        own = P.with_chunks(records, by=keys)
        batches = parsed.select(*keys).distinct()
        if batches.isEmpty():
            batches = parsed.sparkSession.createDataFrame([(None, 0)], parsed.select(*keys).schema)
        docs = L.openai_documents(batches.withColumn("model", F.lit(spec.label)), own, keys)
        return docs.select(*keys, F.lit(0).alias("line_no"), F.col("document").alias("value"))
    facts = (F.col("n_tokens"), F.col("truncated")) if o.report_tokens else ()
    lines = records.select(*keys, "line_no", L.jsonl_line(F.col("id_json"), F.col("embedding"), *facts).alias("value"))
    return lines.unionByName(parsed.where("kind = 'flush'").select(*keys, "line_no", F.lit("").alias("value")))


def in_order(answers: DataFrame, keys: tuple[str, ...] = ("file", "batch_no")) -> DataFrame:
    """(value): the answers in ranges of their order, each range a part; read one after the other they are the files' answers."""
    order = [*keys, "line_no"]
    return answers.repartitionByRange(*order).sortWithinPartitions(*order).select("value")


def summary(lines: DataFrame, records: DataFrame, spec: EncoderSpec) -> DataFrame:
    """One row: model, dim, in, out, skipped, truncated; also for no lines at all."""
    i = lines.agg(F.count_if(F.col("kind") != "flush").alias("n_in"), F.count_if(F.col("kind") == "skip").alias("skipped"))
    o = records.agg(F.struct(F.count("*").alias("n_out"), F.count_if("truncated").alias("truncated"))).scalar()
    dim = F.when(F.col("o.n_out") > 0, spec.config.hidden).otherwise(0)
    return i.withColumn("o", o).select(F.lit(spec.label).alias("model"), dim.alias("dim"), "n_in", F.col("o.n_out").alias("n_out"), "skipped", F.col("o.truncated").alias("truncated"))
