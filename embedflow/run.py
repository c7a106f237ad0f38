"""A whole run: protocol lines in, vectors, skipped lines and a summary out."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedflow.answers import in_order, output_lines, summary
from embedflow.embed import embed_records
from embedflow.operators import protocol as P
from embedflow.runtime import drop, materialize, publish, remove, setting, spread
from embedflow.sources import lines as L
from embedflow.spec import EncoderSpec


#: Records that a worker, or a stream of lines, embeds at a time: memory stays flat however large a batch is
CHUNK = 1024


@dataclass(frozen=True)
class RunResult:
    model: str
    dim: int
    n_in: int
    n_out: int
    skipped: int
    truncated: int

    @property
    def code(self) -> int:
        """0, or 2 where lines were skipped. Refused requests (3) and failures (1) are exceptions here."""
        return 2 if self.skipped else 0


def run_lines(lines: DataFrame, out: str, spec: EncoderSpec = EncoderSpec()) -> RunResult:
    """lines: (file, line_no, line). Writes out/vectors (text), out/skipped and returns the summary; both appear once they
    are whole, in the place of an earlier run's.

    Each record is embedded once: the vectors are kept as a table before they are written and counted. The output
    parts are ranges of the input's order: read one after the other they hold each file's answers in its order.
    """
    parsed = materialize(P.with_batches(P.parse_lines(lines), stream_col="file"), "parsed")
    todo = parsed.where("kind = 'record'").select("file", "batch_no", "line_no", "id_json", "text")
    with setting(lines.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch", str(CHUNK)):
        records = materialize(embed_records(spread(todo, "line_no"), spec), "records")
    spark, made = lines.sparkSession, f"{out}/.partial-{uuid.uuid4().hex}"
    in_order(output_lines(records, parsed, spec)).write.text(f"{made}/vectors")
    P.quarantine(parsed).select("file", "line_no", "line", "skip_reason", "message").write.parquet(f"{made}/skipped")
    result = RunResult(**summary(parsed, records, spec).first().asDict())
    for kind in ("vectors", "skipped"):
        publish(spark, f"{made}/{kind}", f"{out}/{kind}")
    for table in (records, parsed):
        drop(table)
    remove(spark, made)
    return result


def run_files(spark: SparkSession, path: str, out: str, spec: EncoderSpec = EncoderSpec()) -> RunResult:
    return run_lines(L.read_lines(spark, path), out, spec)


def run_stream(spark: SparkSession, source: Iterable[bytes], answer: Callable[[str], None], skip: Callable[[str], None], spec: EncoderSpec = EncoderSpec()) -> RunResult:
    """Lines that come in one by one, such as standard input, each batch answered at its end; a \\n ends a line.

    At most CHUNK records wait at a time; an openai document, one request's answer, is put together from its chunks.
    Bytes that aren't UTF-8 are an error.
    """
    o, held, items = spec.options, [], []
    n = {"n_in": 0, "n_out": 0, "skipped": 0, "truncated": 0}
    documents = tokens = 0

    def embed_held() -> None:
        nonlocal tokens
        if held:
            df = spark.createDataFrame([(i, *x) for i, x in enumerate(held)], "i int, id_json string, text string")
            e = embed_records(df, spec)
            facts = (F.col("n_tokens"), F.col("truncated")) if o.report_tokens else ()
            line = L.openai_item(F.col("i") + len(items), F.col("embedding")) if o.format == "openai" else L.jsonl_line(F.col("id_json"), F.col("embedding"), *facts)
            for r in e.select("i", line.alias("line"), "n_tokens", "truncated").orderBy("i").collect():  # a chunk
                (items.append if o.format == "openai" else answer)(r.line)
                n["n_out"] += 1
                n["truncated"] += r.truncated
                tokens += r.n_tokens
            held.clear()

    def close_batch() -> None:
        nonlocal documents, tokens
        embed_held()
        if o.format == "openai":
            usage = {"prompt_tokens": tokens, "total_tokens": tokens}
            answer(f'{{"object":"list","data":[{",".join(items)}],"model":{P.compact(spec.label)},"usage":{P.compact(usage)}}}')
            documents += 1
            items.clear()
            tokens = 0

    open_batch = False
    for number, raw in enumerate(source, 1):
        found = P.parse_line(raw.removesuffix(b"\n").removesuffix(b"\r").decode())
        n["n_in"] += found.kind != "flush"
        open_batch = found.kind != "flush"
        if found.kind == "skip":
            n["skipped"] += 1
            skip(f"skip line {number}: {found.skip_reason}")
        elif found.kind == "flush":
            close_batch()
            if o.format == "jsonl":
                answer("")
        else:
            held.append((found.id_json, found.text))
            if len(held) == CHUNK:
                embed_held()
    if open_batch or held or (o.format == "openai" and not documents):
        close_batch()
    return RunResult(spec.label, spec.config.hidden if n["n_out"] else 0, **n)


def run_texts(spark: SparkSession, texts: list[str], spec: EncoderSpec = EncoderSpec()) -> DataFrame:
    """(id, embedding, n_tokens, truncated, model_tag) of texts given as arguments; nothing is skipped."""
    return embed_records(L.from_arguments(spark, texts), spec).drop("text")
