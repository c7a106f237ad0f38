"""Queries of vector operators and encoder primitives, over embeddings and out_records."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from embedflow.functions import vectors as V
from embedflow.functions.text import wrapped_id
from embedflow.plans.protocol_queries import DELIVERED_SQL, DIM, USABLE_SQL, delivered
from embedflow.plans.registry import query, table

WIDTH = 64
LOCAL = 3
ERF_SQL = "(sign({x}) * (1 - (((((1.061405429::DOUBLE * t - 1.453152027::DOUBLE) * t + 1.421413741::DOUBLE) * t - 0.284496736::DOUBLE) * t + 0.254829592::DOUBLE) * t) * exp(-({x}) * ({x}))))"


def emb(spark, d):
    return table(spark, d, "embeddings")


def rows(df, key, v):
    """(key, pos, value), rounded: floats of two engines differ in the last digit. v is never null or empty, and
    exploded as outer: else a filter on its size is inferred, and v computed twice."""
    return df.select(*key, F.posexplode_outer(v).alias("pos", "_x")).select(*key, "pos", F.round("_x", 6).alias("value"))


def unnested(sql_list, source="embeddings", key="vec_id"):
    return f"SELECT {key}, CAST(unnest(range(len(v))) AS INT) AS pos, round(unnest(v), 6) + 0.0::DOUBLE AS value FROM (SELECT {key}, {sql_list} AS v FROM {source})"


E = "embedding::DOUBLE[]"
NORM_SQL = f"sqrt(list_sum(list_transform({E}, lambda x: x * x)))"


@query(f"SELECT out_id, CAST(unnest(range(96)) AS INT) AS pos, unnest(list_transform(embedding, lambda x: CAST(x / CAST(sqrt(list_sum(list_transform({E}, lambda y: y * y))) AS FLOAT) AS FLOAT))) AS value FROM (SELECT out_id, embedding FROM ({DELIVERED_SQL}) WHERE {USABLE_SQL})")
def unit_vectors(spark, d):
    """Exact float values: the norm in double, the division in float."""
    u = delivered(spark, d).where(V.is_usable(F.col("embedding"), DIM))
    return u.select("out_id", F.posexplode_outer(V.l2_normalize(F.col("embedding"))).alias("pos", "value"))


@query(f"SELECT run_no, round(min(n), 5) AS least, round(max(n), 5) AS most, count(*) AS vectors, count(*) FILTER (WHERE abs(n - 1) > 0.001) AS not_unit FROM (SELECT run_no, {NORM_SQL} AS n FROM ({DELIVERED_SQL}) WHERE {USABLE_SQL}) GROUP BY run_no")
def norm_range(spark, d):
    u = delivered(spark, d).where(V.is_usable(F.col("embedding"), DIM)).select("run_no", V.norm(F.col("embedding")).alias("n"))
    return u.groupBy("run_no").agg(F.round(F.min("n"), 5).alias("least"), F.round(F.max("n"), 5).alias("most"), F.count("*").alias("vectors"), F.count_if(F.abs(F.col("n") - 1) > 0.001).alias("not_unit"))


@query(f"""SELECT defect, count(*) AS n FROM (SELECT CASE WHEN embedding IS NULL THEN 'null' WHEN len(embedding) <> 96 THEN 'length' WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 THEN 'non-finite' WHEN len(list_filter(embedding, lambda x: x <> 0)) = 0 THEN 'zero' ELSE 'none' END AS defect
FROM ({DELIVERED_SQL})) GROUP BY defect""")
def vector_defects(spark, d):
    return delivered(spark, d).groupBy(F.coalesce(V.defect(F.col("embedding"), DIM), F.lit("none")).alias("defect")).agg(F.count("*").alias("n"))


@query(unnested(f"list_transform({E}, lambda x: (x - list_avg({E})) / sqrt(list_sum(list_transform({E}, lambda y: (y - list_avg({E})) * (y - list_avg({E})))) / len(embedding) + 1e-5))"))
def layer_norm(spark, d):
    return rows(emb(spark, d), ["vec_id"], V.layer_norm(F.col("embedding")))


LINEAR_OUT = 8


@query("SELECT vec_id, CAST(o AS INT) AS pos, round(list_sum(list_transform(range(64), lambda i: ((o * 31 + i * 17) % 13 - 6) / 13.0::DOUBLE * embedding[i + 1]::DOUBLE)), 6) AS value FROM embeddings, range(8) t(o)")
def linear(spark, d):
    """Y = W x with a small fixed weight matrix, rows of weights as an array constant."""
    weights = F.array(*[F.array(*[F.lit(((o * 31 + i * 17) % 13 - 6) / 13.0) for i in range(WIDTH)]) for o in range(LINEAR_OUT)])
    return rows(emb(spark, d), ["vec_id"], V.linear(F.col("embedding"), weights))


@query("SELECT vec_id, CAST(p AS INT) AS part, CAST(h AS INT) AS head, CAST(i AS INT) AS pos, round(embedding[p * 20 + h * 10 + i + 1]::DOUBLE, 6) AS value FROM embeddings, range(3) a(p), range(2) b(h), range(10) c(i)")
def split_heads(spark, d):
    """The fused projection of width 3 x 2 x 10 taken apart."""
    e = emb(spark, d).select("vec_id", F.posexplode(V.split_heads(F.col("embedding"), 3, 2, 10)).alias("part", "x"))
    e = e.select("vec_id", "part", F.posexplode("x").alias("head", "y"))
    return rows(e.withColumn("y", F.transform("y", lambda x: x.cast("double"))), ["vec_id", "part", "head"], F.col("y"))


@query("""SELECT vec_id, CAST(i AS INT) AS pos, round(embedding[i + 1]::DOUBLE * cos(a) + CASE WHEN i < 32 THEN -embedding[i + 33]::DOUBLE ELSE embedding[i - 31]::DOUBLE END * sin(a), 6) AS value
FROM (SELECT vec_id, embedding, i, (vec_id % 25) * pow(10000.0::DOUBLE, (i % 32) * -2.0::DOUBLE / 64) AS a FROM embeddings, range(64) t(i))""")
def rotary(spark, d):
    return rows(emb(spark, d), ["vec_id"], V.rotary(F.col("embedding"), F.col("vec_id") % 25, WIDTH, 10_000.0))


@query(unnested("list_transform(list_zip(embedding[1:32], embedding[33:64]), lambda p: p[1]::DOUBLE / (1 + exp(-p[1]::DOUBLE)) * p[2]::DOUBLE)"))
def gated_silu(spark, d):
    return rows(emb(spark, d), ["vec_id"], V.gated(F.col("embedding"), 32, "silu"))


@query(f"SELECT vec_id, CAST(i AS INT) AS pos, round(0.5 * a * (1 + {ERF_SQL.format(x='a / sqrt(2)')}) * b, 6) + 0.0::DOUBLE AS value FROM (SELECT *, 1 / (1 + 0.3275911::DOUBLE * abs(a / sqrt(2))) AS t FROM (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS a, embedding[i + 33]::DOUBLE AS b FROM embeddings, range(32) t(i)))")
def gated_gelu(spark, d):
    return rows(emb(spark, d), ["vec_id"], V.gated(F.col("embedding"), 32, "gelu"))


@query("SELECT vec_id, CAST(i AS INT) AS pos, round(embedding[i + 1]::DOUBLE + embedding[64 - i]::DOUBLE, 6) AS value FROM embeddings, range(64) t(i)")
def residual(spark, d):
    return rows(emb(spark, d), ["vec_id"], V.residual(F.col("embedding"), F.reverse("embedding")))


ATTENTION_SQL = f"""WITH e AS (SELECT vec_id // 25 AS s, vec_id AS p, embedding::DOUBLE[] AS v FROM embeddings),
w AS (SELECT q.s, q.p AS q, k.p AS k, list_inner_product(q.v, k.v) / 8 AS x, k.v FROM e q JOIN e k ON q.s = k.s AND k.p BETWEEN q.p - {LOCAL} AND q.p + {LOCAL}),
m AS (SELECT s, q, k, v, exp(greatest(x - max(x) OVER (PARTITION BY s, q), -87)) AS a FROM w),
n AS (SELECT s, q, k, v, a / sum(a) OVER (PARTITION BY s, q) AS a FROM m)"""


def attention_weights(spark, d, window=LOCAL):
    """(s, q, k, v, a): softmax weights of the keys within the window of each query; sequences are 25 vectors long.

    A range self-join with the sequence as equality: never more than 2 * window + 1 keys a query.
    """
    e = emb(spark, d).select(F.floor(F.col("vec_id") / 25).alias("s"), F.col("vec_id").alias("p"), F.col("embedding").alias("v"))
    # each key meets the queries within its reach by equality, so that a long sequence isn't joined with itself
    k = e.select("s", F.col("p").alias("k"), F.col("v").alias("kv"), F.explode(F.sequence(F.col("p") - window, F.col("p") + window)).alias("p"))
    x = e.join(k, ["s", "p"]).select("s", F.col("p").alias("q"), "k", F.col("kv").alias("v"), (V.dot(F.col("v"), F.col("kv")) / 8).alias("x"))
    w = Window.partitionBy("s", "q")
    a = x.withColumn("a", F.exp(F.greatest(F.col("x") - F.max("x").over(w), F.lit(-87.0))))
    return a.withColumn("a", F.col("a") / F.sum("a").over(w)).drop("x")


@query(ATTENTION_SQL + " SELECT s, q, k, round(a, 6) AS a FROM n")
def window_softmax(spark, d):
    return attention_weights(spark, d).select("s", "q", "k", F.round("a", 6).alias("a"))


@query(ATTENTION_SQL + " SELECT q AS vec_id, CAST(i AS INT) AS pos, round(sum(a * v[i + 1]), 6) AS value FROM n, range(64) t(i) GROUP BY q, i")
def window_attention(spark, d):
    # a query has at most 2 * window + 1 keys
    each = attention_weights(spark, d).groupBy("q").agg(F.collect_list(F.struct("a", "v")).alias("kv"))
    zero = F.array(*[F.lit(0.0)] * WIDTH)
    out = F.aggregate("kv", zero, lambda acc, x: F.zip_with(acc, x["v"], lambda s, y: s + x["a"] * y.cast("double")))
    return rows(each.select(F.col("q").alias("vec_id"), out.alias("o")), ["vec_id"], F.col("o"))


@query("""WITH e AS (SELECT vec_id // 25 AS s, vec_id AS p, embedding::DOUBLE[] AS v FROM embeddings), w AS (SELECT q.s, q.p AS q, k.p AS k, list_inner_product(q.v, k.v) / 8 AS x FROM e q JOIN e k ON q.s = k.s),
m AS (SELECT s, q, k, exp(greatest(x - max(x) OVER (PARTITION BY s, q), -87)) AS a FROM w) SELECT s, q, k, round(a / sum(a) OVER (PARTITION BY s, q), 6) AS a FROM m""")
def global_softmax(spark, d):
    """Attention weights without a window, inside sequences of 25 vectors."""
    e = emb(spark, d).select(F.floor(F.col("vec_id") / 25).alias("s"), F.col("vec_id").alias("q"), F.col("embedding").alias("v"))
    k = e.select("s", F.col("q").alias("k"), F.col("v").alias("kv"))
    x = e.join(k, "s").select("s", "q", "k", (V.dot(F.col("v"), F.col("kv")) / 8).alias("x"))
    w = Window.partitionBy("s", "q")
    a = x.withColumn("a", F.exp(F.greatest(F.col("x") - F.max("x").over(w), F.lit(-87.0))))
    return a.select("s", "q", "k", F.round(F.col("a") / F.sum("a").over(w), 6).alias("a"))


@query("SELECT vec_id, CAST(CASE WHEN label - 5 >= 0 THEN label - 5 ELSE label - 5 + 10 END AS INT) AS id, round(w, 6) AS weight FROM (SELECT vec_id, label, (CASE WHEN label - 5 >= 0 THEN label - 5 ELSE label + 5 END) * 0.5::DOUBLE AS w FROM embeddings)")
def gathered_rows(spark, d):
    """A lookup by id, negative ids counting from the end, as a join with the (small, fixed) table."""
    weights = spark.range(10).select(F.col("id").cast("int").alias("id"), (F.col("id") * 0.5).alias("w"))
    e = emb(spark, d).select("vec_id", wrapped_id(F.col("label") - 5, 10).cast("int").alias("id"))
    return e.join(F.broadcast(weights), "id").select("vec_id", "id", F.round("w", 6).alias("weight"))


@query("SELECT CAST(i AS INT) AS layer, CASE WHEN i % 3 = 0 THEN 'global' ELSE 'local' END AS kind FROM range(19) t(i)")
def layer_kinds(spark, d):
    return spark.range(19).select(F.col("id").cast("int").alias("layer"), F.when(F.col("id") % 3 == 0, "global").otherwise("local").alias("kind"))


POOL_SQL = "SELECT vec_id // 25 AS s, vec_id, CAST(i AS INT) AS pos, embedding[1] > 0 AS keep, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) t(i)"


@query(f"SELECT s, pos, round(coalesce(avg(CASE WHEN keep THEN x END), 0), 6) AS value FROM ({POOL_SQL}) GROUP BY s, pos")
def mean_pool(spark, d):
    """Masked mean over sequences of 25 vectors; the mask is the sign of the first value."""
    e = emb(spark, d).select(F.floor(F.col("vec_id") / 25).alias("s"), (F.element_at("embedding", 1) > 0).alias("keep"), F.posexplode("embedding").alias("pos", "x"))
    return e.groupBy("s", "pos").agg(F.round(V.mean_pool(F.col("keep"), F.col("x")), 6).alias("value"))


@query("SELECT s, CAST(unnest(range(64)) AS INT) AS pos, round(unnest(v::DOUBLE[]), 6) AS value FROM (SELECT vec_id // 25 AS s, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY 1)")
def first_pool(spark, d):
    e = emb(spark, d).groupBy(F.floor(F.col("vec_id") / 25).alias("s")).agg(F.min_by("embedding", "vec_id").alias("v"))
    return rows(e.withColumn("v", F.transform("v", lambda x: x.cast("double"))), ["s"], F.col("v"))


SCALE_SQL = "CASE WHEN m = 0 THEN 1 ELSE m / 127 END"
INT8_SQL = f"SELECT vec_id, embedding, {SCALE_SQL} AS s FROM (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))) AS m FROM embeddings)"


@query(f"SELECT vec_id, CAST(i AS INT) AS pos, CAST(greatest(-127, least(127, round(embedding[i + 1]::DOUBLE / s))) AS INT) AS code, round(s, 9) AS scale FROM ({INT8_SQL}), range(64) t(i)")
def int8_rows(spark, d):
    e = emb(spark, d).withColumn("s", V.int8_scale(F.col("embedding")))
    return e.select("vec_id", F.posexplode_outer(V.int8_codes(F.col("embedding"), F.col("s"))).alias("pos", "code"), F.round("s", 9).alias("scale"))


@query("WITH t AS (SELECT max(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE)))) / 127 AS s FROM embeddings) SELECT vec_id, CAST(i AS INT) AS pos, CAST(greatest(-127, least(127, round(embedding[i + 1]::DOUBLE / s))) AS INT) AS code FROM embeddings, t, range(64) r(i)")
def int8_tensor(spark, d):
    """One scale for the whole table: an aggregate of one row."""
    scale = emb(spark, d).agg(F.max(V.largest(F.col("embedding"))).alias("m")).select((F.when(F.col("m") == 0, 127.0).otherwise(F.col("m")) / 127.0).alias("s"))
    e = emb(spark, d).withColumn("s", scale.scalar())
    return e.select("vec_id", F.posexplode_outer(V.int8_codes(F.col("embedding"), F.col("s"))).alias("pos", "code"))


@query("""SELECT vec_id, block, round(s, 9) AS scale, CAST(list_sum(list_transform(b, lambda x: CAST(greatest(-127, least(127, round(x / s))) AS BIGINT))) AS BIGINT) AS code_sum FROM (
SELECT vec_id, block, b, CASE WHEN list_max(list_transform(b, lambda x: abs(x))) = 0 THEN 1 ELSE list_max(list_transform(b, lambda x: abs(x))) / 127 END AS s FROM (
SELECT vec_id, CAST(k AS INT) AS block, embedding[k * 16 + 1:k * 16 + 16]::DOUBLE[] AS b FROM embeddings, range(4) t(k)))""")
def int8_blocks(spark, d):
    e = emb(spark, d).select("vec_id", F.posexplode_outer(V.int8_blocks(F.col("embedding"), WIDTH, 16)).alias("block", "x"))
    return e.select("vec_id", "block", F.round("x.scale", 9).alias("scale"), F.aggregate("x.codes", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"))


@query(f"""SELECT vec_id, round(1 - list_inner_product(e, q) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q))), 6) AS cosine_distance, round(list_max(list_transform(list_zip(e, q), lambda p: abs(p[1] - p[2]))), 6) AS worst FROM (
SELECT vec_id, embedding::DOUBLE[] AS e, list_transform({E}, lambda x: greatest(-127, least(127, round(x / s))) * s) AS q FROM ({INT8_SQL}))""")
def dequantized_error(spark, d):
    e = emb(spark, d).withColumn("s", V.int8_scale(F.col("embedding")))
    e = e.withColumn("q", V.dequantize(V.int8_codes(F.col("embedding"), F.col("s")), F.col("s")))
    return e.select("vec_id", F.round(1 - V.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine_distance"), F.round(F.array_max(F.zip_with("embedding", "q", lambda a, b: F.abs(a.cast("double") - b))), 6).alias("worst"))


@query("SELECT vec_id, CAST(i AS INT) AS pos, round(embedding[(i // 5) * 8 + i % 5 + 1]::DOUBLE, 6) AS value FROM embeddings, range(35) t(i)")
def strided_read(spark, d):
    """The 7 x 5 logical values of buffers whose rows lie 8 apart."""
    v = F.transform(V.strided(F.col("embedding"), 7, 5, 8), lambda x: x.cast("double"))
    return rows(emb(spark, d), ["vec_id"], v)


def _rule(rows: int, columns: int, salt: int):
    """A fixed weight matrix by a rule that both engines know."""
    return F.array(*[F.array(*[F.lit(((o * 31 + i * 17 + salt) % 13 - 6) / 13.0) for i in range(columns)]) for o in range(rows)])


def _rule_sql(v: str, rows: int, columns: int, salt: int) -> str:
    return f"list_transform(range({rows}), lambda r: list_sum(list_transform(range({columns}), lambda c: ((r * 31 + c * 17 + {salt}) % 13 - 6) / 13.0::DOUBLE * {v}[c + 1])))"


def _norm_sql(table: str, keep: str) -> str:
    """keep and m, the normed x of a table."""
    return f"SELECT {keep}, list_transform(c, lambda a: a / sd) AS m FROM (SELECT *, sqrt(list_inner_product(c, c) / 64 + 1e-5) AS sd FROM (SELECT *, list_transform(x, lambda a: a - mu) AS c FROM (SELECT *, list_avg(x) AS mu FROM {table})))"


def _turned_sql(v: str) -> str:
    return f"list_transform(range(8), lambda i: {v}[i + 1] * cos((p % 25) * pow(10000.0::DOUBLE, (i % 4) * -2.0::DOUBLE / 8)) + CASE WHEN i < 4 THEN -{v}[i + 5] ELSE {v}[i - 3] END * sin((p % 25) * pow(10000.0::DOUBLE, (i % 4) * -2.0::DOUBLE / 8)))"


LAYER_SQL = f"""WITH e AS (SELECT vec_id // 25 AS s, vec_id AS p, embedding::DOUBLE[] AS x FROM embeddings), n AS ({_norm_sql('e', 's, p, x')}),
qkv AS (SELECT *, {_rule_sql('m', 8, 64, 0)} AS q0, {_rule_sql('m', 8, 64, 1)} AS k0, {_rule_sql('m', 8, 64, 2)} AS v FROM n),
t AS (SELECT s, p, x, v, {_turned_sql('q0')} AS q, {_turned_sql('k0')} AS k FROM qkv),
w AS (SELECT a.s, a.p, b.v, list_inner_product(a.q, b.k) / sqrt(8) AS z FROM t a JOIN t b ON a.s = b.s),
m AS (SELECT *, exp(greatest(z - max(z) OVER (PARTITION BY s, p), -87)) AS a FROM w),
o AS (SELECT s, p, [{', '.join(f'sum(a * v[{i + 1}]) / sum(a)' for i in range(8))}] AS o FROM m GROUP BY s, p),
r AS (SELECT t.s, t.p, list_transform(list_zip(x, {_rule_sql('o', 64, 8, 3)}), lambda y: y[1] + y[2]) AS x FROM t JOIN o ON t.p = o.p),
f AS ({_norm_sql('r', 'p, x')}), g AS (SELECT p, x, {_rule_sql('m', 16, 64, 4)} AS g FROM f),
u AS (SELECT p, x, list_transform(range(8), lambda i: g[i + 1] / (1 + exp(-g[i + 1])) * g[i + 9]) AS g FROM g),
y AS (SELECT p, list_transform(list_zip(x, {_rule_sql('g', 64, 8, 5)}), lambda y: y[1] + y[2]) AS y FROM u)
SELECT p AS vec_id, CAST(i AS INT) AS pos, round(y[i + 1], 5) AS value FROM y, range(64) t(i)"""


@query(LAYER_SQL)
def encoder_layer(spark, d):
    """A whole layer with global attention of one head over sequences of 25 vectors: norm, projections, rotation,
    attention, residual, norm, gated unit, residual."""
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    e = emb(spark, d).select(F.floor(F.col("vec_id") / 25).alias("s"), F.col("vec_id").alias("p"), double("embedding").alias("x"))
    part = lambda salt: V.let(V.layer_norm(F.col("x")), lambda h: V.linear(h, _rule(8, 64, salt)))
    turned = lambda salt: V.let(part(salt), lambda v: V.rotary(v, F.col("p") % 25, 8, 10_000.0))
    e = e.select("s", "p", "x", turned(0).alias("q"), turned(1).alias("k"), part(2).alias("v"))
    keys = e.groupBy("s").agg(F.collect_list(F.struct("k", "v")).alias("kv"))  # a sequence has 25 vectors
    met = e.join(keys, "s").withColumn("z", F.transform("kv", lambda t: V.dot(F.col("q"), t["k"]) / math.sqrt(8)))
    met = met.withColumn("a", V.let(F.array_max("z"), lambda top: F.transform("z", lambda z: F.exp(F.greatest(z - top, F.lit(-87.0))))))
    zero = F.array(*[F.lit(0.0)] * 8)
    summed = F.aggregate(F.zip_with("a", "kv", lambda a, t: F.transform(t["v"], lambda v: a * v)), zero, lambda acc, v: F.zip_with(acc, v, lambda x, y: x + y))
    met = met.withColumn("o", V.let(V.total(F.col("a")), lambda n: V.let(summed, lambda o: F.transform(o, lambda x: x / n))))
    met = met.select("p", V.let(F.col("o"), lambda o: V.residual(F.col("x"), V.linear(o, _rule(64, 8, 3)))).alias("x"))
    unit = lambda x: V.let(V.layer_norm(x), lambda m: V.let(V.linear(m, _rule(16, 64, 4)), lambda g: V.gated(g, 8, "silu")))
    y = met.select(F.col("p").alias("vec_id"), V.let(F.col("x"), lambda x: V.let(unit(x), lambda u: V.residual(x, V.linear(u, _rule(64, 8, 5))))).alias("y"))
    return y.select("vec_id", F.posexplode_outer("y").alias("pos", "value")).withColumn("value", F.round("value", 5))
