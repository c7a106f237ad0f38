"""The protocol over a stream: each file is a request, answered in a micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from embedflow.answers import in_order, output_lines, summary
from embedflow.embed import embed_records
from embedflow.operators import protocol as P
from embedflow.sources.lines import numbered_lines, raw_lines
from embedflow.spec import EncoderSpec

__all__ = ["answer", "read_requests", "run_requests", "summary"]


def answer(lines: DataFrame, spec: EncoderSpec) -> tuple[DataFrame, DataFrame]:
    """(records with vectors, lines with their kinds) of (file, line_no, line); a file's blank lines end its batches."""
    parsed = P.with_batches(P.parse_lines(lines), stream_col="file")
    return embed_records(parsed.where("kind = 'record'").select("file", "batch_no", "line_no", "id_json", "text"), spec), parsed


def read_requests(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """(file, part, line), as a stream over the files of a folder."""
    return raw_lines(spark.readStream.option("lineSep", "\n").option("maxFilesPerTrigger", files_per_trigger).text(folder))


def run_requests(
    lines: DataFrame, out: str, checkpoint: str, spec: EncoderSpec = EncoderSpec(), then: Callable[[DataFrame, int], None] | None = None, every: str | None = None
) -> StreamingQuery:
    """Answers requests; a folder for each epoch, so that an epoch that is run again replaces itself.

    out/answers has the answers as text in the options' format: vectors and batch ends, or a document for each batch,
    also for an empty one. out/records and out/lines are tables; batch ends are among the lines. With `every`, an
    interval such as "1 second", the query goes on for new files without an end; without, it ends once those there are answered.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        records, parsed = answer(numbered_lines(batch), spec)
        path = lambda kind: f"{out}/{kind}/epoch={epoch}"
        parsed.select("file", "line_no", "batch_no", "kind", "skip_reason").write.mode("overwrite").parquet(path("lines"))
        records.write.mode("overwrite").parquet(path("records"))
        # each record is embedded once: the answers are made from the tables
        kept, own = (batch.sparkSession.read.schema(df.schema).parquet(path(kind)) for kind, df in (("records", records), ("lines", parsed.select("file", "line_no", "batch_no", "kind", "skip_reason"))))
        if not own.isEmpty():
            in_order(output_lines(kept, own, spec)).write.mode("overwrite").text(path("answers"))
        if then is not None:
            then(kept, epoch)

    trigger = {"processingTime": every} if every else {"availableNow": True}
    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()
