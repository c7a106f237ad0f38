"""Queries of tokenizing and batching, over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedflow.functions import text as T
from embedflow.functions import vectors as V
from embedflow.operators import batching as B
from embedflow.plans.registry import query, table
from embedflow.runtime import spread

TOKENS_SQL = r"regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')"
LENGTH_SQL = f"SELECT doc_id, CAST(len({TOKENS_SQL}) AS INT) AS n_all, CAST(least(512, len({TOKENS_SQL}) + 2) AS INT) AS n_tokens FROM documents WHERE text IS NOT NULL"
BATCH_SQL = f"SELECT *, row_number() OVER (ORDER BY n_tokens, doc_id) - 1 AS r FROM ({LENGTH_SQL})"
SHAPES_SQL = f"""SELECT r // 64 AS batch, max(n_tokens) AS seq, CAST(count(*) AS INT) AS "rows", CAST(max(n_tokens) * count(*) - sum(n_tokens) AS BIGINT) AS waste,
CAST(greatest(1, 524288 // greatest(1, max(n_tokens) * max(n_tokens))) AS INT) AS rows_per_forward, CAST(ceil(count(*) / CAST(greatest(1, 524288 // greatest(1, max(n_tokens) * max(n_tokens))) AS DOUBLE)) AS INT) AS units
FROM ({BATCH_SQL}) GROUP BY r // 64"""
COMPONENTS = 8


def texts(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")


def lengths(spark, d):
    t = texts(spark, d).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_all"))
    return t.withColumn("n_tokens", F.least(F.lit(T.MAX_LENGTH), F.col("n_all") + 2))


@query(f"SELECT doc_id, n_all, n_tokens, n_all + 2 > 512 AS truncated FROM ({LENGTH_SQL})")
def token_facts(spark, d):
    return lengths(spark, d).select("doc_id", "n_all", "n_tokens", (F.col("n_all") + 2 > T.MAX_LENGTH).alias("truncated"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')) AS INT) AS n_words FROM documents WHERE text IS NOT NULL")
def word_counts(spark, d):
    return texts(spark, d).select("doc_id", F.size(T.words(F.col("text"))).alias("n_words"))


@query(f"""SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(id) AS BIGINT) AS id_sum, CAST(max(id) AS INT) AS id_max, count(DISTINCT id) AS n_distinct FROM (
SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT % 32765 + 3 AS id FROM (SELECT doc_id, unnest({TOKENS_SQL}) AS t FROM documents WHERE text IS NOT NULL)) GROUP BY doc_id""")
def token_ids(spark, d):
    """Facts of each text's ids, within its row: doc_id is unique, so that nothing is shuffled."""
    some = spread(texts(spark, d), "doc_id").where(F.col("text").rlike(T.TOKEN))
    ids = some.select("doc_id", F.transform(T.tokens(F.col("text")), lambda t: T.token_id(t)).alias("ids"))
    total = F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), total.alias("id_sum"), F.array_max("ids").alias("id_max"), F.size(F.array_distinct("ids")).cast("long").alias("n_distinct"))


@query(f"""SELECT doc_id, seq, CAST(len(ids) AS INT) AS width, CAST(list_sum(ids) AS BIGINT) AS id_sum, CAST(len(list_filter(ids, lambda x: x = 0)) AS INT) AS pads FROM (
SELECT doc_id, seq, list_concat(ids, list_transform(range(seq - len(ids)), lambda x: 0)) AS ids FROM (
SELECT doc_id, CASE WHEN n_tokens <= 64 THEN 64 WHEN n_tokens <= 128 THEN 128 WHEN n_tokens <= 256 THEN 256 ELSE 512 END AS seq,
list_concat([1::BIGINT], list_transform({TOKENS_SQL}[1:510], lambda t: ('0x' || substr(md5(t), 1, 8))::BIGINT % 32765 + 3), [2::BIGINT]) AS ids
FROM documents JOIN ({LENGTH_SQL}) USING (doc_id)))""")
def padded_inputs(spark, d):
    """Encoded, truncated and zero-filled to the smallest fixed shape."""
    t = texts(spark, d).select("doc_id", T.encoded_ids(F.col("text")).alias("ids")).withColumn("seq", T.shape_for(F.size("ids")))
    t = t.select("doc_id", "seq", T.padded(F.col("ids"), F.col("seq")).alias("ids"))
    return t.select("doc_id", "seq", F.size("ids").alias("width"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"), F.size(F.filter("ids", lambda x: x == 0)).alias("pads"))


@query(f"SELECT doc_id, CAST(r // 64 AS BIGINT) AS batch, CAST(r % 64 AS INT) AS pos FROM ({BATCH_SQL})")
def length_batches(spark, d):
    return B.length_batches(lengths(spark, d), "doc_id").select("doc_id", "batch", "pos")


@query(SHAPES_SQL)
def batch_shapes(spark, d):
    return B.batch_shapes(B.length_batches(lengths(spark, d), "doc_id"))


@query(f'SELECT CAST(sum(seq * "rows") AS BIGINT) AS cells, CAST(sum(waste) AS BIGINT) AS waste, round(sum(waste) / sum(seq * "rows"), 6) AS share, CAST(sum(units) AS BIGINT) AS units FROM ({SHAPES_SQL})')
def padding_waste(spark, d):
    s = B.batch_shapes(B.length_batches(lengths(spark, d), "doc_id"))
    return s.agg(F.sum(F.col("seq") * F.col("rows")).alias("cells"), F.sum("waste").alias("waste"), F.round(F.sum("waste") / F.sum(F.col("seq") * F.col("rows")), 6).alias("share"), F.sum("units").alias("units"))


@query(f"SELECT seq, count(*) AS texts, CAST(sum(seq - n_tokens) AS BIGINT) AS waste FROM (SELECT n_tokens, CASE WHEN n_tokens <= 64 THEN 64 WHEN n_tokens <= 128 THEN 128 WHEN n_tokens <= 256 THEN 256 ELSE 512 END AS seq FROM ({LENGTH_SQL})) GROUP BY seq")
def fixed_shapes(spark, d):
    t = lengths(spark, d).withColumn("seq", T.shape_for(F.col("n_tokens")))
    return t.groupBy("seq").agg(F.count("*").alias("texts"), F.sum(F.col("seq") - F.col("n_tokens")).alias("waste"))


@query(f"SELECT doc_id, CAST(c AS INT) AS chunk_no, CAST(c * 510 AS INT) AS first_token, CAST(least(510, n_all - c * 510) AS INT) AS n FROM (SELECT doc_id, n_all, unnest(range((n_all - 1) // 510 + 1)) AS c FROM ({LENGTH_SQL}) WHERE n_all > 510)")
def truncation_chunks(spark, d):
    return B.chunks_of_long_texts(lengths(spark, d), "doc_id", "n_all")


def hashed_vector(text):
    """Mean of the hashed vectors (8 components from each md5) of the first 510 words, of unit length; null without a word.

    The limit stands for the encoder's max_seq_length of 512 with its two special tokens, but counts words; words
    beyond it are never read. The query hashed_truncated says which texts it cuts.
    """
    # two components from each eight hex digits: conv is what costs
    eight = lambda h, i: F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long")
    unit_range = lambda x: x.cast("double") / 32768 - 1
    pair = lambda x: F.array(unit_range(F.shiftright(x, 16)), unit_range(x.bitwiseAND(F.lit(65535))))
    numbers = lambda h: F.array(*[eight(h, i) for i in range(COMPONENTS // 2)])
    vector = lambda t: F.flatten(F.transform(V.let(F.md5(t), numbers), pair))
    zero = F.array(*[F.lit(0.0)] * COMPONENTS)
    total = lambda w: F.aggregate(w, zero, lambda a, t: F.zip_with(a, vector(t), lambda x, y: x + y))
    unit = lambda m: V.let(V.norm(m), lambda n: F.transform(m, lambda x: x / n))
    mean = lambda w: V.let(F.size(w), lambda n: V.let(total(w), lambda s: F.transform(s, lambda x: x / n)))
    return V.let(F.slice(T.words(text), 1, T.MAX_LENGTH - 2), lambda w: F.when(F.size(w) > 0, V.let(mean(w), unit)))


def has_words(text):
    """A filter before hashed_vector: one after it would be pushed below, and the vector computed twice."""
    return F.col(text).rlike(r"[^ \t\n\r]")


HASHED_SQL = """SELECT {key}, list_transform(m, lambda x: x / sqrt(list_sum(list_transform(m, lambda y: y * y)))) AS v FROM (
SELECT {key}, [""" + ", ".join(f"sum(cnt * (('0x' || substr(h, {4 * j + 1}, 4))::INT / 32768.0::DOUBLE - 1)) / sum(cnt)" for j in range(COMPONENTS)) + """] AS m FROM (
SELECT {key}, md5(w) AS h, count(*)::DOUBLE AS cnt FROM (SELECT {key}, unnest(list_filter(regexp_split_to_array({text}, '[ \\t\\n\\r]+'), lambda w: w <> '')[1:510]) AS w FROM {table} WHERE {text} IS NOT NULL) GROUP BY ALL) GROUP BY {key})"""


@query("SELECT doc_id, CAST(unnest(range(8)) AS INT) AS j, unnest(list_transform(v, lambda x: round(x, 6))) AS v FROM (" + HASHED_SQL.format(key="doc_id", text="text", table="documents") + ")")
def embed_hashed(spark, d):
    """The flagship query: texts to words, hashed vectors, mean pooling and unit length, all inside the JVM."""
    return hashed_components(spread(texts(spark, d), "doc_id"))


@query(r"SELECT doc_id, CAST(n AS INT) AS n_words, n > 510 AS truncated FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda w: w <> '')) AS n FROM documents WHERE text IS NOT NULL)")
def hashed_truncated(spark, d):
    """Which texts embed_hashed, candidate_ranking and map_and_hit read only in part."""
    t = texts(spark, d).select("doc_id", F.size(T.words(F.col("text"))).alias("n_words"))
    return t.withColumn("truncated", F.col("n_words") > T.MAX_LENGTH - 2)


def hashed_components(t):
    v = t.where(has_words("text")).select("doc_id", hashed_vector(F.col("text")).alias("v"))
    # outer: else a filter on the vector's size is inferred, pushed below, and the vector computed twice
    return v.select("doc_id", F.posexplode_outer("v").alias("j", "x")).select("doc_id", "j", F.round("x", 6).alias("v"))


@query("SELECT doc_id, fnv FROM (SELECT doc_id, printf('%016x', list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(octet_length(encode(source))), lambda i: ('0x' || substr(hex(encode(source)), 2 * i::INT + 1, 2))::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)::UBIGINT) AS fnv FROM documents WHERE source <> '')")
def source_hashes(spark, d):
    return table(spark, d, "documents").where("source <> ''").select("doc_id", T.fnv1a_hex("source").alias("fnv"))


@query()
def embed_documents(spark, d):
    """The whole path with the synthetic encoder: token limit 512, batches by length, mean pooling, unit length."""
    from embedflow.embed import embed_records

    return embed_records(spread(texts(spark, d), "doc_id")).select("doc_id", "embedding", "n_tokens", "truncated")


@query(f"SELECT doc_id, n_tokens, n_all + 2 > 512 AS truncated FROM ({LENGTH_SQL})")
def embedded_lengths(spark, d):
    """What the encoder's path says of its own token counts."""
    return embed_documents(spark, d).select("doc_id", "n_tokens", "truncated")


@query()
def embed_in_records(spark, d):
    from embedflow.embed import embed_records

    return embed_records(spread(table(spark, d, "in_records").where("kind = 'record'").select("line_no", "run_no", "batch_no", "id_json", "text"), "line_no")).drop("text")


@query("SELECT doc_id, seq, CAST(seq - n_tokens AS INT) AS blocked, CAST((seq - n_tokens) * -10000.0 AS DOUBLE) AS mask_sum FROM (SELECT doc_id, n_tokens, CASE WHEN n_tokens <= 64 THEN 64 WHEN n_tokens <= 128 THEN 128 WHEN n_tokens <= 256 THEN 256 ELSE 512 END AS seq FROM (" + LENGTH_SQL + "))")
def additive_masks(spark, d):
    """The padding mask as it is added to scores: 0 for tokens, a finite -10000 for padding."""
    t = lengths(spark, d).withColumn("seq", T.shape_for(F.col("n_tokens")))
    m = T.additive_mask(F.concat(F.array_repeat(F.lit(1), F.col("n_tokens")), F.array_repeat(F.lit(0), F.col("seq") - F.col("n_tokens"))))
    t = t.select("doc_id", "seq", m.alias("m"))
    return t.select("doc_id", "seq", F.size(F.filter("m", lambda x: x < 0)).alias("blocked"), F.aggregate("m", F.lit(0.0), lambda a, x: a + x).alias("mask_sum"))
