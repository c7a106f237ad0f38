"""Queries of the line protocol, over input_lines, in_records, out_records and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedflow.functions import vectors as V
from embedflow.operators import protocol as P
from embedflow.operators.running import buckets, position
from embedflow.plans.registry import query, table
from embedflow.sources import lines as L

BLANK_SQL = r"regexp_full_match(line, '[\t\n\x0b\x0c\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*')"
PARSED_SQL = f"""SELECT *, CASE WHEN line IS NULL OR {BLANK_SQL} THEN 'flush' WHEN skip_reason IS NULL THEN 'record' ELSE 'skip' END AS kind FROM (
  SELECT *, CASE WHEN line IS NULL OR {BLANK_SQL} THEN NULL WHEN NOT json_valid(line) THEN 'invalid JSON' WHEN json_type(line) <> 'OBJECT' THEN 'not a JSON object'
    WHEN json_type(line, '$.id') IS NULL THEN 'missing "id"' WHEN coalesce(json_type(line, '$.text'), '') <> 'VARCHAR' THEN 'missing or non-string "text"'
    WHEN json_extract_string(line, '$.text') = '' THEN 'empty "text"' END AS skip_reason FROM input_lines)"""
DIM = 96
USABLE_SQL = "len(embedding) = 96 AND len(list_filter(embedding, lambda x: isfinite(x))) = 96 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"
DELIVERED_SQL = "SELECT DISTINCT ON (out_id) * FROM out_records ORDER BY out_id, emitted_at"


def parsed(spark, d):
    return P.parse_lines(table(spark, d, "input_lines"))


def delivered(spark, d):
    """Output records, each out_id once: a second delivery has the same content."""
    return table(spark, d, "out_records").dropDuplicates(["out_id"])


def micro(v):
    """Values in whole millionths: text forms of floats differ between engines."""
    return F.transform(v, lambda x: F.round(x.cast("double") * 1e6).cast("long"))


MICRO_SQL = "'[' || array_to_string(list_transform(embedding, lambda x: CAST(round(x::DOUBLE * 1e6) AS BIGINT)), ',') || ']'"


@query(f"SELECT line_no, kind, skip_reason, CASE WHEN kind = 'record' THEN md5(json_extract_string(line, '$.text')) END AS text_md5 FROM ({PARSED_SQL})")
def parse_lines(spark, d):
    return parsed(spark, d).select("line_no", "kind", "skip_reason", F.md5("text").alias("text_md5"))


@query(f"SELECT line_no, json_extract(line, '$.id')::VARCHAR AS id_json FROM ({PARSED_SQL}) WHERE kind = 'record'")
def record_ids(spark, d):
    return parsed(spark, d).where("kind = 'record'").select("line_no", "id_json")


@query(f"SELECT line_no, 'skip line ' || line_no || ': ' || skip_reason AS message FROM ({PARSED_SQL}) WHERE kind = 'skip'")
def quarantine(spark, d):
    return P.quarantine(parsed(spark, d)).select("line_no", "message")


@query(f"SELECT line_no, run_no, CAST(coalesce(sum(CASE WHEN line IS NULL OR {BLANK_SQL} THEN 1 ELSE 0 END) OVER (PARTITION BY run_no ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS batch_no FROM input_lines")
def batches(spark, d):
    lines = table(spark, d, "input_lines").select("line_no", "run_no", "line")
    return P.with_batches(lines, stream_col="run_no", is_end=F.col("line").isNull() | P.is_blank(F.col("line"))).select("line_no", "run_no", "batch_no")


@query("SELECT line_no, CAST(row_number() OVER w - 1 AS INT) AS \"index\", CAST((row_number() OVER w - 1) // 1024 AS INT) AS chunk_no FROM in_records WHERE kind = 'record' WINDOW w AS (PARTITION BY run_no ORDER BY line_no)")
def chunks(spark, d):
    return P.with_chunks(table(spark, d, "in_records").where("kind = 'record'").select("line_no", "run_no"), by=("run_no",)).select("line_no", "index", "chunk_no")


@query("SELECT line_no, md5(coalesce(prefix, '') || text) AS input_md5, length(coalesce(prefix, '') || text) AS n_chars FROM in_records LEFT JOIN runs USING (run_no) WHERE kind = 'record'")
def prefixed(spark, d):
    records = table(spark, d, "in_records").where("kind = 'record'").join(table(spark, d, "runs").select("run_no", "prefix"), "run_no", "left")
    return P.with_prefix(records, F.col("prefix")).select("line_no", F.md5("input_text").alias("input_md5"), F.length("input_text").cast("long").alias("n_chars"))


@query("SELECT count(*) AS records, count(*) FILTER (WHERE regexp_full_match(text, '[\\s\\p{Z}]*')) AS blank_texts, count(*) FILTER (WHERE text <> trim(text)) AS padded_texts FROM in_records WHERE kind = 'record'")
def unshaped_texts(spark, d):
    """Texts pass as they are: blank and padded ones are records too."""
    t = table(spark, d, "in_records").where("kind = 'record'")
    return t.agg(F.count("*").alias("records"), F.count_if(P.is_blank(F.col("text"))).alias("blank_texts"), F.count_if(F.col("text") != F.trim("text")).alias("padded_texts"))


@query(f"SELECT line_no, CAST(row_number() OVER (ORDER BY line_no) - 1 AS BIGINT) AS id FROM input_lines WHERE NOT {BLANK_SQL}")
def numbered_texts(spark, d):
    lines = table(spark, d, "input_lines").where(~P.is_blank(F.col("line"))).select("line_no")
    return position(lines, ["line_no"], buckets(F.col("line_no")), "id")


@query(f"""SELECT out_id, md5('{{"id":' || id_json || ',"embedding":' || {MICRO_SQL} || CASE WHEN report_tokens THEN coalesce(',"n_tokens":' || n_tokens || ',"truncated":' || truncated, '') ELSE '' END || '}}') AS line_md5
FROM ({DELIVERED_SQL}) LEFT JOIN runs USING (run_no) WHERE {USABLE_SQL}""")
def jsonl_sink(spark, d):
    out = delivered(spark, d).where(V.is_usable(F.col("embedding"), DIM)).join(table(spark, d, "runs").select("run_no", "report_tokens"), "run_no", "left")
    return out.select("out_id", F.md5(L.jsonl_line(F.col("id_json"), micro(F.col("embedding")), F.col("n_tokens"), F.col("truncated"), F.col("report_tokens"))).alias("line_md5"))


def _items(spark, d):
    out = delivered(spark, d).where(V.is_usable(F.col("embedding"), DIM)).select("run_no", "batch_no", "line_no", "out_id", "embedding", "n_tokens")
    return P.with_chunks(out, by=("run_no", "batch_no"))


ITEMS_SQL = f"""SELECT *, '{{"object":"embedding","index":' || (row_number() OVER w - 1) || ',"embedding":' || {MICRO_SQL} || '}}' AS item, CAST(row_number() OVER w - 1 AS INT) AS "index"
FROM ({DELIVERED_SQL}) WHERE {USABLE_SQL} WINDOW w AS (PARTITION BY run_no, batch_no ORDER BY line_no)"""


@query(f'SELECT out_id, "index", md5(item) AS item_md5 FROM ({ITEMS_SQL})')
def openai_items(spark, d):
    return _items(spark, d).select("out_id", "index", F.md5(L.openai_item(F.col("index"), micro(F.col("embedding")))).alias("item_md5"))


@query(f"""WITH b AS (SELECT DISTINCT run_no, batch_no, model_label FROM in_records JOIN runs USING (run_no)),
j AS (SELECT run_no, batch_no, string_agg(item, ',' ORDER BY "index") AS items, count(*) AS n, sum(n_tokens) AS t FROM ({ITEMS_SQL}) GROUP BY ALL)
SELECT b.run_no, b.batch_no, coalesce(n, 0) AS n_items, CAST(coalesce(t, 0) AS BIGINT) AS prompt_tokens,
md5('{{"object":"list","data":[' || coalesce(items, '') || '],"model":' || coalesce(to_json(model_label)::VARCHAR, '""') || ',"usage":{{"prompt_tokens":' || coalesce(t, 0)::BIGINT || ',"total_tokens":' || coalesce(t, 0)::BIGINT || '}}}}') AS document_md5
FROM b LEFT JOIN j ON b.run_no = j.run_no AND b.batch_no = j.batch_no""")
def openai_sink(spark, d):
    b = table(spark, d, "in_records").select("run_no", "batch_no").distinct().join(table(spark, d, "runs").select("run_no", F.col("model_label").alias("model")), "run_no")
    items = _items(spark, d).withColumn("embedding", micro(F.col("embedding")))
    return L.openai_documents(b, items, ["run_no", "batch_no"]).select("run_no", "batch_no", "n_items", "prompt_tokens", F.md5("document").alias("document_md5"))


@query(f"""WITH i AS (SELECT run_no, count(*) FILTER (WHERE kind <> 'flush') AS n_in, count(*) FILTER (WHERE kind = 'skip') AS skipped FROM in_records GROUP BY run_no),
o AS (SELECT run_no, count(*) AS n_out, count(*) FILTER (WHERE truncated) AS truncated FROM ({DELIVERED_SQL}) GROUP BY run_no)
SELECT run_no, model_label AS model, CASE WHEN coalesce(n_out, 0) = 0 THEN 0 ELSE dim END AS dim, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, coalesce(skipped, 0) AS skipped, coalesce(truncated, 0) AS truncated
FROM runs LEFT JOIN i USING (run_no) LEFT JOIN o USING (run_no)""")
def run_summary(spark, d):
    """in excludes batch ends; dim is 0 where nothing was embedded."""
    i = table(spark, d, "in_records").groupBy("run_no").agg(F.count_if(F.col("kind") != "flush").alias("n_in"), F.count_if(F.col("kind") == "skip").alias("skipped"))
    o = delivered(spark, d).groupBy("run_no").agg(F.count("*").alias("n_out"), F.count_if(F.col("truncated")).alias("truncated"))
    n = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    r = table(spark, d, "runs").join(i, "run_no", "left").join(o, "run_no", "left")
    return r.select("run_no", F.col("model_label").alias("model"), F.when(F.coalesce("n_out", F.lit(0)) == 0, 0).otherwise(F.col("dim")).alias("dim"), n("n_in"), n("n_out"), n("skipped"), n("truncated"))


@query("SELECT run_no, CASE WHEN report_tokens AND output_format = 'openai' THEN 3 WHEN skips > 0 THEN 2 ELSE 0 END AS code FROM runs LEFT JOIN (SELECT run_no, count(*) AS skips FROM in_records WHERE kind = 'skip' GROUP BY run_no) USING (run_no)")
def exit_codes(spark, d):
    skips = table(spark, d, "in_records").where("kind = 'skip'").groupBy("run_no").agg(F.count("*").alias("skips"))
    conflict = F.col("report_tokens") & (F.col("output_format") == "openai")
    return table(spark, d, "runs").join(skips, "run_no", "left").select("run_no", F.when(conflict, 3).when(F.col("skips") > 0, 2).otherwise(0).alias("code"))


@query(f"SELECT run_no, batch_no, count(*) AS records, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM ({DELIVERED_SQL}) GROUP BY run_no, batch_no")
def token_usage(spark, d):
    return delivered(spark, d).groupBy("run_no", "batch_no").agg(F.count("*").alias("records"), F.sum("n_tokens").alias("tokens"))


@query("SELECT skip_reason, n FROM (SELECT skip_reason, count(*) AS n FROM in_records WHERE skip_reason IS NOT NULL GROUP BY skip_reason) ORDER BY n DESC, skip_reason LIMIT 15")
def top_skip_reasons(spark, d):
    return table(spark, d, "in_records").where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "skip_reason").limit(15)


@query("SELECT line_no, sha256(text) AS text_key FROM in_records WHERE kind = 'record' AND line_no NOT IN (SELECT line_no FROM out_records WHERE line_no IS NOT NULL)")
def pending_records(spark, d):
    """Records without an output yet: what an incremental run still has to embed."""
    return table(spark, d, "in_records").where("kind = 'record'").join(table(spark, d, "out_records").select("line_no"), "line_no", "left_anti").select("line_no", F.sha2("text", 256).alias("text_key"))


@query("""SELECT i.run_no, count(DISTINCT skip_reason) AS reasons, count(*) FILTER (WHERE skip_reason = 'invalid JSON') AS invalid, coalesce(string_agg(DISTINCT skip_reason, '|' ORDER BY skip_reason), '') AS listed FROM in_records i GROUP BY i.run_no""")
def skip_maps(spark, d):
    """The skip reasons of each run as a map from reason to count."""
    counted = table(spark, d, "in_records").groupBy("run_no", "skip_reason").agg(F.count("*").alias("n"))
    known = F.filter(F.collect_list(F.struct("skip_reason", "n")), lambda x: x["skip_reason"].isNotNull())  # an entry a reason
    m = counted.groupBy("run_no").agg(F.map_from_entries(known).alias("m"))
    listed = F.array_join(F.sort_array(F.map_keys("m")), "|")
    return m.select("run_no", F.size("m").cast("long").alias("reasons"), F.coalesce(F.try_element_at("m", F.lit(P.INVALID)), F.lit(0)).alias("invalid"), listed.alias("listed"))
