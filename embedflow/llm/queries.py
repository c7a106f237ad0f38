"""The queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embedflow.llm import clusters, confusables, copies, knn, mixing, packing, residue
from embedflow.plans.protocol_queries import USABLE_SQL


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "in_records").where("kind = 'record'")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of records whose texts differ but look the same."""
    found = confusables.look_alike_pairs(_texts(spark, d), "line_no", "text")
    return found.select(F.col("a").cast("int").alias("line_a"), F.col("b").cast("int").alias("line_b"))


def p1_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its consistent form."""
    return confusables.consistent_texts(_texts(spark, d)).withColumnRenamed("id", "line_no")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every text with the first line of its look and the number of forms of that look."""
    return confusables.look_alike_classes(_texts(spark, d)).withColumnRenamed("id", "line_no")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of at least 0.75 of which one is among the other's 5 nearest."""
    near = knn.nearest_vectors(_read(spark, d, "out_records"), "out_id", "embedding", k=5, min_cos=0.75)
    return knn.similar_pairs(near).select(F.col("a").alias("out_a"), F.col("b").alias("out_b"))


def p2_nearest(spark: SparkSession, d: str) -> DataFrame:
    """For each usable record its 5 nearest, however far, ranked."""
    return knn.nearest_vectors(_read(spark, d, "out_records"), "out_id", "embedding", k=5, beyond_trees=True).withColumnsRenamed({"id": "out_id", "neighbour": "near_id"})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every copy with the first line of its set."""
    links = copies.copy_links(copies.copy_runs(_read(spark, d, "input_lines")))
    return links.select(F.col("first_line").cast("int").alias("first_line"), F.col("copy_line").cast("int").alias("copy_line"))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record of each set with the number of its copies."""
    return copies.representatives(copies.copy_runs(_read(spark, d, "input_lines")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every member of a cluster with its first member."""
    members = clusters.grid_clusters(_read(spark, d, "out_records"))
    return members.where("id <> cluster").select(F.col("cluster").alias("first_out"), F.col("id").alias("member_out"))


def p4_described(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster's size and three most typical members."""
    from embedflow.runtime import materialize

    return clusters.describe_clusters(materialize(clusters.grid_clusters(_read(spark, d, "out_records")), "members"))


def p5_packed(spark: SparkSession, d: str) -> DataFrame:
    """Every text or piece of one in its container, for each kind of container."""
    return packing.packed_containers(_read(spark, d, "documents"), _read(spark, d, "containers")).withColumnRenamed("id", "doc_id")


def p5_use(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each kind are."""
    return packing.container_use(packing.packed_containers(_read(spark, d, "documents"), _read(spark, d, "containers")))


def p6_mixed(spark: SparkSession, d: str) -> DataFrame:
    """The mix, shard by shard."""
    return mixing.mixed_sources(_read(spark, d, "documents"), _read(spark, d, "source_targets")).withColumnRenamed("id", "doc_id")


def p6_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share that each source reached."""
    targets = _read(spark, d, "source_targets")
    return mixing.source_shares(mixing.mixed_sources(_read(spark, d, "documents"), targets), targets)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that are template residue, filler, errors or script notices."""
    return residue.with_residue(_read(spark, d, "documents")).where("residue").select(F.col("id").alias("doc_id"))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """The remaining records."""
    return residue.with_residue(_read(spark, d, "documents")).where("NOT residue").select(F.col("id").alias("doc_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_consistent, p1_classes, p2_found, p2_nearest, p3_found, p3_collapsed, p4_found, p4_described, p5_packed, p5_use, p6_mixed, p6_shares, p7_found, p7_kept)
}

# Brute force over whole tables, where SQL can state a problem exactly; tests/llm holds other counterparts
KEYS_SQL = r"""SELECT line_no, CASE json_type(line, '$.id') WHEN 'VARCHAR' THEN 's' || json_extract_string(line, '$.id')
WHEN 'OBJECT' THEN 'o' || array_to_string(list_sort(list_transform(json_keys(line, '$.id'), lambda k: k || ':' || json_extract(line, '$.id."' || k || '"')::VARCHAR)), ',')
WHEN 'DOUBLE' THEN 'n' || CASE WHEN json_extract(line, '$.id')::DOUBLE = floor(json_extract(line, '$.id')::DOUBLE) THEN json_extract(line, '$.id')::DOUBLE::HUGEINT::VARCHAR ELSE json_extract(line, '$.id')::VARCHAR END
ELSE 'n' || json_extract(line, '$.id')::VARCHAR END AS id,
replace(lower(regexp_replace(json_extract_string(line, '$.text'), '[\s\x0b\x1c-\x1f\x{85}\p{Z}\p{P}]+', '', 'g')), 'ß', 'ss') AS t FROM input_lines
WHERE json_valid(line) AND json_type(line) = 'OBJECT' AND json_type(line, '$.id') IS NOT NULL AND json_type(line, '$.text') = 'VARCHAR' AND json_extract_string(line, '$.text') <> ''"""
UNIT_SQL = f"""SELECT out_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS v FROM (SELECT DISTINCT ON (out_id) out_id, embedding::DOUBLE[] AS e FROM out_records WHERE {USABLE_SQL})"""

ORACLE_SQL: dict[str, str] = {
    "p3_found": f"SELECT CAST(first AS INT) AS first_line, CAST(line_no AS INT) AS copy_line FROM (SELECT line_no, min(line_no) OVER (PARTITION BY id, t) AS first FROM ({KEYS_SQL})) WHERE line_no <> first",
    "p3_collapsed": f"SELECT CAST(min(line_no) AS BIGINT) AS first_line, count(*) AS copies FROM ({KEYS_SQL}) GROUP BY id, t",
    "p4_found": f"""WITH RECURSIVE u AS MATERIALIZED ({UNIT_SQL}), l AS MATERIALIZED (SELECT a.out_id AS a, b.out_id AS b FROM u a JOIN u b ON a.out_id <> b.out_id AND list_inner_product(a.v, b.v) >= 0.72),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT first_out, member_out FROM (SELECT min(b) AS first_out, a AS member_out FROM r GROUP BY a HAVING count(*) >= 5) WHERE first_out <> member_out""",
}
