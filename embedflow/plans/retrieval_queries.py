"""Queries of retrieval evaluation and reports, over retrieval_queries, documents, embeddings, events and runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from embedflow.functions import vectors as V
from embedflow.operators import retrieval as R
from embedflow.plans.protocol_queries import DELIVERED_SQL
from embedflow.plans.registry import query, table
from embedflow.plans.token_queries import HASHED_SQL, has_words, hashed_vector
from embedflow.plans.vector_queries import INT8_SQL, emb
from embedflow.runtime import spread

CANDIDATES_SQL = """SELECT q_id, TRY_CAST(d AS BIGINT) AS doc_id, CAST(min(i) AS INT) AS place FROM (
SELECT q_id, unnest(l) AS d, unnest(range(len(l))) AS i FROM (SELECT q_id, list_filter(list_concat([positive], coalesce(negatives, [])), lambda x: x IS NOT NULL) AS l FROM retrieval_queries)) GROUP BY q_id, d"""


def rq(spark, d):
    return table(spark, d, "retrieval_queries")


@query(f"SELECT q_id, doc_id FROM ({CANDIDATES_SQL})")
def candidate_sets(spark, d):
    return R.candidates(rq(spark, d)).select("q_id", "doc_id")


@query(f"SELECT q_id, doc_id FROM ({CANDIDATES_SQL}) WHERE q_id IN (SELECT DISTINCT q_id FROM retrieval_queries WHERE q_id IS NOT NULL ORDER BY q_id LIMIT 20)")
def first_candidates(spark, d):
    """The candidates of the first 20 different queries."""
    return R.candidates(R.first_queries(rq(spark, d), 20)).select("q_id", "doc_id")


@query(f"SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM ({CANDIDATES_SQL}))")
def wanted_documents(spark, d):
    """A semi-join before anything costly is computed."""
    return table(spark, d, "documents").join(R.wanted(rq(spark, d)), "doc_id", "left_semi").select("doc_id", "n_chars")


@query(f"SELECT DISTINCT doc_id FROM ({CANDIDATES_SQL}) WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM documents WHERE text IS NOT NULL)")
def missing_documents(spark, d):
    return R.wanted(rq(spark, d)).join(table(spark, d, "documents").where("text IS NOT NULL"), "doc_id", "left_anti")


RANKED_SQL = f"""WITH c AS ({CANDIDATES_SQL}), q AS ({HASHED_SQL.format(key='q_id', text='query_text', table='retrieval_queries')}), t AS ({HASHED_SQL.format(key='doc_id', text='text', table='documents')}),
s AS (SELECT c.q_id, c.doc_id, place, round(list_inner_product(q.v, t.v), 6) AS score FROM c JOIN q ON c.q_id = q.q_id JOIN t ON c.doc_id = t.doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY q_id ORDER BY score DESC, place) AS INT) AS rank FROM s)"""


def ranked_candidates(spark, d):
    c = R.candidates(rq(spark, d))
    q = rq(spark, d).where(has_words("query_text")).select("q_id", hashed_vector(F.col("query_text")).alias("qv"))
    docs = spread(table(spark, d, "documents").join(R.wanted(rq(spark, d)), "doc_id", "left_semi").where(has_words("text")).select("doc_id", "text"), "doc_id").select("doc_id", hashed_vector(F.col("text")).alias("dv"))
    s = c.join(docs, "doc_id").join(q, "q_id").withColumn("score", F.round(V.dot(F.col("qv"), F.col("dv")), 6))
    return R.ranked(s, "q_id", F.col("score"), ["place"])


@query(RANKED_SQL + " SELECT q_id, doc_id, rank FROM r")
def candidate_ranking(spark, d):
    return ranked_candidates(spark, d).select("q_id", "doc_id", "rank")


@query(RANKED_SQL + " SELECT count(*) AS queries, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS map, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit FROM r WHERE place = 0")
def map_and_hit(spark, d):
    return R.single_relevant(ranked_candidates(spark, d).where("place = 0"))


# Queries: the vectors whose id is divisible by 100, against all others
SCORED_SQL = "SELECT q.vec_id AS q, t.vec_id AS d, q.label = t.label AS same, round(list_inner_product(q.embedding::DOUBLE[], t.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings t ON q.vec_id % 100 = 0 AND q.vec_id <> t.vec_id"


def scored(spark, d):
    """A stated query set against all rows, in blocks of both, each pair of blocks in a task of its own."""
    e = emb(spark, d)
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("qv"), F.col("label").alias("ql"))
    s = R.met_in_blocks(e, "vec_id", queries, "q").where("vec_id <> q")
    return s.select("q", F.col("vec_id").alias("d"), (F.col("ql") == F.col("label")).alias("same"), F.round(V.dot(F.col("qv"), F.col("embedding")), 6).alias("score"))


@query(f"SELECT q, d, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS rank FROM ({SCORED_SQL})) WHERE rank <= 10")
def top_k(spark, d):
    return R.ranked(scored(spark, d), "q", F.col("score"), ["d"], 10).select("q", "d", "score", "rank")


@query(f"""WITH s AS ({SCORED_SQL}), r AS (SELECT q, same::INT AS g, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS r, row_number() OVER (PARTITION BY q ORDER BY same DESC, d) AS i FROM s),
g AS (SELECT q, sum(CASE WHEN r <= 10 THEN g / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 10 THEN g / log2(i + 1) ELSE 0 END) AS ideal FROM r GROUP BY q)
SELECT q, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM g""")
def ndcg_at_10(spark, d):
    return R.ndcg(scored(spark, d), "q", F.col("score"), F.col("same").cast("int"), ["d"])


@query(f"""WITH s AS (SELECT q, d, score, CASE WHEN same THEN 3 ELSE d % 3 END AS g FROM ({SCORED_SQL})), r AS (SELECT q, g, row_number() OVER (PARTITION BY q ORDER BY score DESC, d) AS r, row_number() OVER (PARTITION BY q ORDER BY g DESC, d) AS i FROM s),
g AS (SELECT q, sum(CASE WHEN r <= 10 THEN g / log2(r + 1) ELSE 0 END) AS dcg, sum(CASE WHEN i <= 10 THEN g / log2(i + 1) ELSE 0 END) AS ideal FROM r GROUP BY q)
SELECT q, round(CASE WHEN ideal > 0 THEN dcg / ideal ELSE 0 END, 6) AS ndcg FROM g""")
def graded_ndcg(spark, d):
    """Labels of four grades: 3 for the query's own label, else 0 to 2 by the id."""
    grade = F.when(F.col("same"), 3).otherwise(F.col("d") % 3)
    return R.ndcg(scored(spark, d), "q", F.col("score"), grade, ["d"])


@query(f"WITH r AS (SELECT q, d, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, d DESC) AS r FROM ({SCORED_SQL})) SELECT q, max(CASE WHEN r = 1 THEN d END) AS best, round(max(score) - min(score), 6) AS margin FROM r WHERE r <= 2 GROUP BY q")
def nearest_margin(spark, d):
    return R.nearest_with_margin(scored(spark, d), "q", "d", F.col("score"))


@query(f"SELECT q, min(score) FILTER (WHERE same) AS least_within, max(score) FILTER (WHERE NOT same) AS most_across, coalesce(min(score) FILTER (WHERE same) > max(score) FILTER (WHERE NOT same), false) AS separated FROM ({SCORED_SQL}) GROUP BY q")
def separation(spark, d):
    s = scored(spark, d).groupBy("q").agg(F.min(F.when(F.col("same"), F.col("score"))).alias("least_within"), F.max(F.when(~F.col("same"), F.col("score"))).alias("most_across"))
    return s.withColumn("separated", F.coalesce(F.col("least_within") > F.col("most_across"), F.lit(False)))


@query("SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosine(spark, d):
    a = emb(spark, d).select("vec_id", F.col("embedding").alias("x"))
    b = emb(spark, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("vec_b"), F.col("embedding").alias("y"))
    return a.join(b, "vec_id").select(F.col("vec_id").alias("vec_a"), "vec_b", F.round(V.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))


@query(f"""SELECT vec_id, round(1 - list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))), 6) AS distance, round(list_max(a), 6) AS worst, round(list_sum(a) / len(a), 6) AS mean, CAST(0 AS INT) AS non_finite,
1 - list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))) > 0.0001 AS fails
FROM (SELECT *, list_transform(list_zip(e, q), lambda p: abs(p[1] - p[2])) AS a FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_transform(embedding::DOUBLE[], lambda x: greatest(-127, least(127, round(x / s))) * s) AS q FROM ({INT8_SQL})))""")
def parity_report(spark, d):
    """Vectors against their 8 bit form."""
    e = emb(spark, d).select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    b = emb(spark, d).withColumn("s", V.int8_scale(F.col("embedding"))).select("vec_id", V.dequantize(V.int8_codes(F.col("embedding"), F.col("s")), F.col("s")).alias("v"))
    return R.parity(e, b, "vec_id", "v", 1e-4)


@query(f"""SELECT out_id, CAST(2 * len(list_filter(v, lambda x: NOT isfinite(x))) AS INT) AS non_finite, len(list_filter(v, lambda x: NOT isfinite(x))) > 0 OR len(list_filter(v, lambda x: x <> 0)) = 0 AS fails
FROM (SELECT out_id, list_filter(embedding, lambda x: x IS NOT NULL) AS v FROM ({DELIVERED_SQL}) WHERE embedding IS NOT NULL AND len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL)))""")
def output_parity(spark, d):
    """Outputs against twice themselves: only vectors with values that aren't finite, or without a direction, fail."""
    o = table(spark, d, "out_records").dropDuplicates(["out_id"]).where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)").select("out_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return R.parity(o, o.withColumn("v", F.transform("v", lambda x: x * 2)), "out_id", "v", 1e-4).select("out_id", "non_finite", "fails")


@query(f"SELECT count(*) AS deliveries, count(DISTINCT out_id) AS records, count(*) - count(DISTINCT out_id) AS repeated, (SELECT count(*) FROM in_records WHERE kind = 'record' AND line_no NOT IN (SELECT line_no FROM ({DELIVERED_SQL}))) AS without_output FROM out_records")
def delivery_report(spark, d):
    o = table(spark, d, "out_records")
    counts = o.groupBy("out_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("deliveries"), F.count("*").alias("records")).withColumn("repeated", F.col("deliveries") - F.col("records"))
    left = table(spark, d, "in_records").where("kind = 'record'").join(o.select("line_no"), "line_no", "left_anti").agg(F.count("*").alias("without_output"))
    return counts.withColumn("without_output", left.scalar())


SPREAD_SQL = """WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, any_value(n) AS n, min(value) AS least, round(quantile_cont(value, 0.5), 6) AS median, max(CASE WHEN r = n // 2 + 1 THEN value END) AS lower_median, max(value) AS most, (max(value) - min(value)) / quantile_cont(value, 0.5) > 0.25 AS noisy FROM e GROUP BY event_type"""


@query(SPREAD_SQL)
def latency_table(spark, d):
    """Both medians of a measurement, and whether its spread is too wide to conclude from."""
    return R.spread(table(spark, d, "events").select("event_type", "value"), "event_type", "value").withColumn("median", F.round("median", 6))


@query(f"SELECT event_type, round(least * 1000 / (16 * length(event_type)), 6) AS us_per_token FROM ({SPREAD_SQL})")
def latency_per_token(spark, d):
    """The least value over a text's length; 16 tokens for each letter of the name stand for the length here."""
    t = R.spread(table(spark, d, "events").select("event_type", "value"), "event_type", "value")
    return R.per_token(t, 16 * F.length("event_type")).select("event_type", F.round("us_per_token", 6).alias("us_per_token"))


# Measured seconds of serial and parallel runs, and of start-up probes
RUNS = [("serial", 30.1), ("serial", 30.9), ("serial", 31.5), ("two", 17.2), ("two", 16.8), ("two", 18.1), ("four", 15.9), ("four", 16.4), ("four", 16.0)]
RUNS_SQL = "(VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in RUNS) + ") r(mode, s)"


@query(f"""WITH m AS (SELECT mode, median(s) AS med, (max(s) - min(s)) / median(s) AS spread FROM {RUNS_SQL} GROUP BY mode),
b AS (SELECT max(CASE WHEN mode = 'serial' THEN med END) AS serial, max(spread) AS worst, (max(CASE WHEN mode <> 'serial' THEN med END) - min(CASE WHEN mode <> 'serial' THEN med END)) / min(CASE WHEN mode <> 'serial' THEN med END) AS gap FROM m)
SELECT mode, round(serial / med, 6) AS speedup, worst > gap AS inconclusive FROM m, b WHERE mode <> 'serial'""")
def scaling_verdict(spark, d):
    """Inconclusive where the worst spread exceeds the gap between the parallel medians."""
    m = spark.createDataFrame(RUNS, "mode string, s double").groupBy("mode").agg(F.expr("percentile(s, 0.5)").alias("med"), ((F.max("s") - F.min("s")) / F.expr("percentile(s, 0.5)")).alias("spread"))
    w, par = Window.partitionBy(), F.when(F.col("mode") != "serial", F.col("med"))  # three rows
    m = m.withColumn("serial", F.max(F.when(F.col("mode") == "serial", F.col("med"))).over(w)).withColumn("worst", F.max("spread").over(w)).withColumn("gap", (F.max(par).over(w) - F.min(par).over(w)) / F.min(par).over(w))
    return m.where("mode <> 'serial'").select("mode", F.round(F.col("serial") / F.col("med"), 6).alias("speedup"), (F.col("worst") > F.col("gap")).alias("inconclusive"))


PROBES = [("a", 0.9, 1.1, 7.4), ("b", 4.2, 3.9, 13.7), ("c", 2.0, 1.8, 1.7)]


@query("SELECT name, least(p1, p2) AS load, round(total - least(p1, p2), 6) AS encode, total - least(p1, p2) <= 0 AS warn FROM (VALUES " + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {t}::DOUBLE)" for n, a, b, t in PROBES) + ") p(name, p1, p2, total)")
def startup_split(spark, d):
    p = spark.createDataFrame(PROBES, "name string, p1 double, p2 double, total double")
    load = F.least("p1", "p2")
    return p.select("name", load.alias("load"), F.round(F.col("total") - load, 6).alias("encode"), (F.col("total") - load <= 0).alias("warn"))


@query("SELECT s AS source FROM (SELECT DISTINCT lower(trim(source)) AS s FROM documents WHERE source IS NOT NULL EXCEPT SELECT source FROM source_targets)")
def unlisted_sources(spark, d):
    """A set difference."""
    own = table(spark, d, "documents").where("source IS NOT NULL").select(F.lower(F.trim("source")).alias("source"))
    return own.distinct().exceptAll(table(spark, d, "source_targets").select("source").distinct())
