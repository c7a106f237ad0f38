"""Queries of model and configuration rules, over a small inline table of configurations, and over runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from embedflow.operators import rules as R
from embedflow.operators.inventory import first_divergence, op_counts, op_deltas, op_totals, placement_changes, prologue
from embedflow.operators.running import buckets, position
from embedflow.plans.registry import query, table

# Configurations to be judged, each breaking at most two rules
CONFIG_COLUMNS = "name string, hidden int, heads int, layers int, global_every int, activation string, eps_a double, eps_b double, theta_nested double, theta_flat double, bias boolean, rope_type string, max_positions int, length int, cls string, mean string, requested string"
CONFIGS = [
    ("base", 768, 12, 22, 3, "gelu", 1e-5, None, 160000.0, None, False, "default", 8192, 512, "true", "false", None),
    ("flat_theta", 768, 12, 22, 3, None, None, 2e-5, None, 160000.0, False, None, 8192, 512, "false", "true", None),
    ("both_eps", 512, 8, 19, 3, "silu", 3e-5, 2e-5, 10000.0, 160000.0, False, "default", 8192, 8192, None, "true", None),
    ("no_eps", 256, 4, 10, 3, "gelu", None, None, 10000.0, None, False, "default", 8192, 64, None, None, None),
    ("no_theta", 768, 12, 22, 3, "gelu", 1e-5, None, None, None, False, "default", 8192, 512, "true", "false", "mean"),
    ("relu", 768, 12, 22, 3, "relu", 1e-5, None, 160000.0, None, False, "default", 8192, 512, "true", "false", "cls"),
    ("biased", 768, 12, 22, 3, "gelu", 1e-5, None, 160000.0, None, True, "default", 8192, 512, "false", "false", "cls"),
    ("odd_head", 36, 12, 3, 3, "gelu", 1e-5, None, 160000.0, None, False, "yarn", 8192, 512, "false", "false", None),
    ("split_head", 770, 12, 22, 0, "gelu", 1e-5, None, 160000.0, None, False, "default", 8192, 512, "maybe", "true", None),
    ("too_long", 768, 12, 22, 3, "gelu", 1e-5, None, 160000.0, None, False, "default", 512, 1024, "true", "true", "mean"),
    ("over_limit", 768, 12, 22, 3, "gelu", 1e-5, None, 160000.0, None, False, "default", 8192, 8000, "true", "true", "mean"),
    ("no_length", 768, 12, 22, 3, "gelu", 1e-5, None, 160000.0, None, False, "default", 8192, 0, "true", "true", "mean"),
    ("no_heads", 768, None, 22, 3, "gelu", 1e-5, None, 160000.0, None, False, "default", 8192, 512, None, None, None),
    ("wide_heads", 512, 4, 12, 3, "gelu", 1e-5, None, 160000.0, None, False, "default", 8192, 512, "true", "true", None),
    ("often_global", 768, 12, 6, 2, "silu", 1e-5, None, 160000.0, None, False, "default", 8192, 256, "false", "true", None),
]


def _literal(v):
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" if isinstance(v, float) else str(v)


_kinds = {"string": "VARCHAR", "int": "INT", "double": "DOUBLE", "boolean": "BOOLEAN"}
_names = [c.strip().split() for c in CONFIG_COLUMNS.split(",")]
CONFIG_SQL = "(SELECT " + ", ".join(f"CAST({n} AS {_kinds[k]}) AS {n}" for n, k in _names) + " FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in CONFIGS) + ") AS c(" + ", ".join(n for n, _ in _names) + "))"


def configs(spark):
    return spark.createDataFrame(CONFIGS, CONFIG_COLUMNS)


DETECTED_SQL = "CASE WHEN cls IS NULL OR cls NOT IN ('true', 'false') THEN NULL WHEN cls = 'true' THEN 'cls' WHEN mean = 'true' THEN 'mean' END"


@query(f"""SELECT name, detected, coalesce(requested, detected, 'mean') AS used, CASE WHEN requested IS NOT NULL AND detected IS NOT NULL AND requested <> detected THEN 'mismatch' WHEN requested IS NULL AND detected IS NULL THEN 'no config' END AS note
FROM (SELECT *, {DETECTED_SQL} AS detected FROM {CONFIG_SQL})""")
def pooling_choice(spark, d):
    c = configs(spark).withColumn("detected", R.detected_pooling(F.col("cls"), F.col("mean")))
    used, note = R.chosen_pooling(F.col("requested"), F.col("detected"))
    return c.select("name", "detected", used.alias("used"), note.alias("note"))


@query(f"SELECT name, coalesce(eps_a, eps_b, 1e-5::DOUBLE) AS eps, coalesce(theta_nested, theta_flat) AS theta, CASE coalesce(activation, 'gelu') WHEN 'gelu' THEN 'gelu' WHEN 'silu' THEN 'silu' END AS activation FROM {CONFIG_SQL}")
def merged_settings(spark, d):
    return configs(spark).select("name", R.merged_eps(F.col("eps_a"), F.col("eps_b")).alias("eps"), F.coalesce("theta_nested", "theta_flat").alias("theta"), R.known_activation(F.col("activation")).alias("activation"))


@query(f"""SELECT name, array_to_string(list_filter([CASE WHEN bias THEN 'bias' END, CASE WHEN coalesce(rope_type, 'default') <> 'default' THEN 'rope type' END, CASE WHEN global_every < 1 THEN 'global interval' END,
CASE WHEN hidden % heads <> 0 THEN 'head width' WHEN (hidden // heads) % 2 <> 0 THEN 'odd head width' END, CASE WHEN coalesce(activation, 'gelu') NOT IN ('gelu', 'silu') THEN 'activation' END, CASE WHEN theta_nested IS NULL AND theta_flat IS NULL THEN 'theta' END,
CASE WHEN length < 1 THEN 'no length' WHEN length > max_positions THEN 'length beyond positions' WHEN length > 4096 THEN 'length beyond limit' END], lambda x: x IS NOT NULL), ', ') AS reasons FROM {CONFIG_SQL}""")
def refused_configs(spark, d):
    """All reasons for which a configuration is refused; empty where none is."""
    return configs(spark).select("name", F.array_join(R.refusals(), ", ").alias("reasons"))


@query(f"""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN bias OR coalesce(rope_type, 'default') <> 'default' OR global_every < 1 OR hidden % heads <> 0 OR (hidden // heads) % 2 <> 0 OR coalesce(activation, 'gelu') NOT IN ('gelu', 'silu') OR (theta_nested IS NULL AND theta_flat IS NULL)
OR length < 1 OR length > max_positions OR length > 4096 THEN 'rejected' ELSE 'accepted' END AS verdict FROM {CONFIG_SQL} WHERE heads IS NOT NULL UNION ALL SELECT 'error' FROM {CONFIG_SQL} WHERE heads IS NULL) GROUP BY verdict""")
def config_survey(spark, d):
    return configs(spark).groupBy(R.verdict().alias("verdict")).agg(F.count("*").alias("n"))


ACCEPTED_SQL = f"SELECT * FROM {CONFIG_SQL} WHERE heads IS NOT NULL AND name NOT IN ('no_theta', 'relu', 'biased', 'odd_head', 'split_head', 'too_long', 'over_limit', 'no_length')"


@query(f"SELECT name, hidden // heads AS head_width, layers * 1000 + length AS downloads FROM ({ACCEPTED_SQL}) WHERE hidden // heads <> 64 OR global_every <> 3 ORDER BY downloads DESC, name LIMIT 15")
def untested_configs(spark, d):
    """Accepted, but outside of what was compared with another implementation; downloads are made up here."""
    c = configs(spark).withColumn("local_attention", F.lit(128)).withColumn("downloads", F.col("layers") * 1000 + F.col("length"))
    return R.outside_tested(c).select("name", "head_width", "downloads")


@query("SELECT run_no, trim(regexp_replace(coalesce(model_label, '') || '/' || coalesce(prefix, ''), '[^A-Za-z0-9._-]', '-', 'g'), '-') AS slug, regexp_replace(CASE WHEN run_no % 2 = 0 THEN 'model.' ELSE '' END || 'layers.' || run_no || '.model.w', '^model\\.', '') AS tensor FROM runs")
def source_slugs(spark, d):
    """Folder names of models, and names of tensors without the prefix that some checkpoints have."""
    r = table(spark, d, "runs")
    tensor = F.concat(F.when(F.col("run_no") % 2 == 0, "model.").otherwise(""), F.lit("layers."), F.col("run_no").cast("string"), F.lit(".model.w"))
    return r.select("run_no", R.slug(F.concat(F.coalesce("model_label", F.lit("")), F.lit("/"), F.coalesce("prefix", F.lit("")))).alias("slug"), R.bare_name(tensor).alias("tensor"))


ARTIFACTS = ["seq-64", "seq-128", "buckets-64-128", "buckets-256-512", "seq-512", "seq-", "notes", "buckets-x-64"]


@query("""WITH n AS (SELECT unnest(['seq-64', 'seq-128', 'buckets-64-128', 'buckets-256-512', 'seq-512', 'seq-', 'notes', 'buckets-x-64']) AS name),
e AS (SELECT name, CASE WHEN name LIKE 'seq%' THEN 0 ELSE 1 END AS shared, unnest(string_split(regexp_extract(name, '^(seq-([0-9]+)|buckets-([0-9]+(-[0-9]+)*))$', 0), '-')[2:]) AS part FROM n WHERE regexp_matches(name, '^(seq-[0-9]+|buckets-[0-9]+(-[0-9]+)*)$'))
SELECT CAST(part AS INT) AS length, arg_min(name, shared::VARCHAR || name) AS name FROM e GROUP BY part""")
def artifact_lengths(spark, d):
    """The artifact that serves each length: a dedicated one before one of several lengths."""
    return R.serving_artifacts(spark.createDataFrame([(a,) for a in ARTIFACTS], "name string"))


FORMS = [("seq-64", "compiled"), ("seq-64", "package"), ("seq-128", "package"), ("seq-256", "compiled"), ("", "metadata")]


@query("""WITH f AS (SELECT * FROM (VALUES ('seq-64', 'compiled'), ('seq-64', 'package'), ('seq-128', 'package'), ('seq-256', 'compiled'), ('', 'metadata')) t(bucket, form)),
h AS (SELECT bucket, bool_or(form = 'compiled') AS has FROM f GROUP BY bucket) SELECT bucket, form FROM f JOIN h USING (bucket) WHERE form = 'metadata' OR form = 'compiled' OR NOT has""")
def artifact_forms(spark, d):
    """Metadata always; of a bucket the preferred form, or the other where it is missing."""
    return R.selected_forms(spark.createDataFrame(FORMS, "bucket string, form string"), "compiled")


@query("""SELECT run_no, array_to_string(list_filter([CASE WHEN dim <> 96 THEN 'width' END, CASE WHEN max_seq_length NOT IN (64, 128, 256, 512) THEN 'length' END, CASE WHEN model_label IS NULL THEN 'label' END], lambda x: x IS NOT NULL), ', ') AS findings FROM runs""")
def run_inspection(spark, d):
    """Declared width, length and label of each run."""
    found = F.array_compact(F.array(F.when(F.col("dim") != 96, "width"), F.when(~F.col("max_seq_length").isin(64, 128, 256, 512), "length"), F.when(F.col("model_label").isNull(), "label")))
    return table(spark, d, "runs").select("run_no", F.array_join(found, ", ").alias("findings"))


@query("""SELECT a.run_no AS run_a, b.run_no AS run_b, coalesce(a.model_label, '') || ':' || a.precision_kind = coalesce(b.model_label, '') || ':' || b.precision_kind AND a.dim = b.dim AS comparable FROM runs a JOIN runs b ON b.run_no = a.run_no + 1""")
def comparable_runs(spark, d):
    """Vectors of neighbouring runs may be compared only where model and precision agree."""
    r = table(spark, d, "runs").select("run_no", "dim", F.concat_ws(":", F.coalesce("model_label", F.lit("")), "precision_kind").alias("tag"))
    b = r.select((F.col("run_no") - 1).alias("run_no"), F.col("run_no").alias("run_b"), F.col("dim").alias("dim_b"), F.col("tag").alias("tag_b"))
    return r.join(b, "run_no").select(F.col("run_no").alias("run_a"), "run_b", ((F.col("tag") == F.col("tag_b")) & (F.col("dim") == F.col("dim_b"))).alias("comparable"))


@query("SELECT run_no, kind AS op, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY run_no), 6) AS share FROM in_records GROUP BY run_no, kind")
def op_inventory(spark, d):
    return op_counts(table(spark, d, "in_records").withColumnRenamed("kind", "op"), "run_no")


@query("""WITH c AS (SELECT run_no, kind, count(*) AS n FROM in_records GROUP BY ALL), a AS (SELECT * FROM c), b AS (SELECT run_no - 1 AS run_no, kind, n FROM c)
SELECT coalesce(a.run_no, b.run_no) AS run_no, coalesce(a.kind, b.kind) AS op, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b ON a.run_no = b.run_no AND a.kind = b.kind""")
def op_delta(spark, d):
    """Difference of each run's counts to the next run's, also of operations that only one has."""
    t = table(spark, d, "in_records").select("run_no", F.col("kind").alias("op"))
    return op_deltas(t, t.withColumn("run_no", F.col("run_no") - 1), "run_no")


SEQ_SQL = "SELECT run_no, kind, row_number() OVER (PARTITION BY run_no ORDER BY line_no) AS seq_no FROM in_records"


@query(f"""WITH s AS ({SEQ_SQL}) SELECT coalesce(a.run_no, b.run_no - 1) AS run_no, min(coalesce(a.seq_no, b.seq_no)) AS seq_no FROM s a FULL JOIN s b ON b.run_no = a.run_no + 1 AND a.seq_no = b.seq_no WHERE a.kind IS DISTINCT FROM b.kind GROUP BY 1""")
def op_divergence(spark, d):
    """Where the sequences of a run and the next one first differ."""
    s = position(table(spark, d, "in_records").select("run_no", "line_no", F.col("kind").alias("op")), ["line_no"], buckets(F.col("line_no")), "p", ["run_no"])
    s = s.select("run_no", "op", (F.col("p") + 1).alias("seq_no"))
    return first_divergence(s, s.withColumn("run_no", F.col("run_no") - 1), "run_no")


@query(f"SELECT run_no, coalesce(min(CASE WHEN kind = 'record' THEN seq_no END), count(*) + 1) - 1 AS prologue, count(*) FILTER (WHERE kind <> 'record') - (coalesce(min(CASE WHEN kind = 'record' THEN seq_no END), count(*) + 1) - 1) AS stragglers, round(avg(CASE WHEN kind = 'record' THEN 1.0 ELSE 0.0 END), 6) AS ceiling FROM ({SEQ_SQL}) GROUP BY run_no")
def placement(spark, d):
    """Leading operations off the fast path, later ones off it, and the share on it."""
    s = position(table(spark, d, "in_records").select("run_no", "line_no", "kind"), ["line_no"], buckets(F.col("line_no")), "p", ["run_no"])
    return prologue(s.select("run_no", (F.col("p") + 1).alias("seq_no"), (F.col("kind") == "record").alias("fast")), "run_no")


@query("SELECT run_no, count(*) AS total, count(*) FILTER (WHERE kind = 'flush') AS constants, count(*) FILTER (WHERE kind <> 'flush') AS compute, count(DISTINCT kind) AS kinds FROM in_records GROUP BY run_no")
def op_summary(spark, d):
    """Sizes of sequences with and without what isn't scheduled (here the batch ends)."""
    return op_totals(table(spark, d, "in_records").withColumnRenamed("kind", "op"), "run_no", F.col("op") == "flush")


PLACED_SQL = "SELECT run_no, kind AS op, skip_reason AS preferred, text IS NOT NULL AS supported, row_number() OVER (PARTITION BY run_no ORDER BY line_no) AS seq_no FROM in_records"


@query(f"""WITH s AS ({PLACED_SQL}), b AS (SELECT coalesce(a.run_no, b.run_no - 1) AS run_no, coalesce(a.seq_no, b.seq_no) AS seq_no, a.op IS DISTINCT FROM b.op AS o, a.preferred IS DISTINCT FROM b.preferred AS p, a.supported IS DISTINCT FROM b.supported AS u
FROM s a FULL JOIN s b ON b.run_no = a.run_no + 1 AND a.seq_no = b.seq_no)
SELECT run_no, count(*) FILTER (WHERE o) AS ops, count(*) FILTER (WHERE p) AS preferred, count(*) FILTER (WHERE u) AS supported, min(seq_no) FILTER (WHERE o OR p OR u) AS first_change FROM b GROUP BY run_no HAVING bool_or(o OR p OR u)""")
def placement_regression(spark, d):
    """What a run's placement changed against the next one's; lengths of texts, as costs, aren't compared."""
    s = position(table(spark, d, "in_records").select("run_no", "line_no", F.col("kind").alias("op"), F.col("skip_reason").alias("preferred"), F.col("text").isNotNull().alias("supported")), ["line_no"], buckets(F.col("line_no")), "p", ["run_no"])
    s = s.withColumn("seq_no", F.col("p") + 1)
    c = placement_changes(s, s.withColumn("run_no", F.col("run_no") - 1), "run_no")
    n = lambda column: F.count_if(F.col("column") == column)
    return c.groupBy("run_no").agg(n("op").alias("ops"), n("preferred").alias("preferred"), n("supported").alias("supported"), F.min("seq_no").alias("first_change"))
