"""Rules over configurations, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LENGTH = 4096


def detected_pooling(cls: Column, mean: Column) -> Column:
    """From the two switches as JSON text; where the first is missing or no boolean, nothing is detected."""
    return F.when(cls == "true", "cls").when((cls == "false") & (mean == "true"), "mean")


def chosen_pooling(requested: Column, detected: Column) -> tuple[Column, Column]:
    """(pooling, note): a request wins; the note says that it differs from what was found, or that nothing was."""
    note = F.when(requested != detected, "mismatch").when(requested.isNull() & detected.isNull(), "no config")
    return F.coalesce(requested, detected, F.lit("mean")), note


def merged_eps(layer_norm_eps: Column, norm_eps: Column) -> Column:
    return F.coalesce(layer_norm_eps, norm_eps, F.lit(1e-5))


def known_activation(name: Column) -> Column:
    """gelu where none is named; null for an unknown one."""
    given = F.coalesce(name, F.lit("gelu"))
    return F.when(given.isin("gelu", "silu"), given)


def refusals() -> Column:
    """All reasons against a configuration row, in a fixed order."""
    c = F.col
    width = F.when(c("hidden") % c("heads") != 0, "head width").when((c("hidden") / c("heads")).cast("int") % 2 != 0, "odd head width")
    length = F.when(c("length") < 1, "no length").when(c("length") > c("max_positions"), "length beyond positions").when(c("length") > MAX_LENGTH, "length beyond limit")
    return F.array_compact(
        F.array(
            F.when(c("bias"), "bias"), F.when(F.coalesce("rope_type", F.lit("default")) != "default", "rope type"), F.when(c("global_every") < 1, "global interval"),
            width, F.when(known_activation(c("activation")).isNull(), "activation"), F.when(c("theta_nested").isNull() & c("theta_flat").isNull(), "theta"), length,
        )
    )


def serving_artifacts(names: DataFrame) -> DataFrame:
    """(length, name) from names such as seq-N and buckets-N-M; other names are ignored."""
    known = names.where(F.col("name").rlike(r"^(seq-[0-9]+|buckets-[0-9]+(-[0-9]+)*)$"))
    parts = F.split("name", "-")
    each = known.select("name", F.when(F.col("name").startswith("seq"), 0).otherwise(1).alias("shared"), F.explode(F.slice(parts, 2, F.size(parts))).alias("part"))
    return each.groupBy(F.col("part").cast("int").alias("length")).agg(F.min_by("name", F.struct("shared", "name")).alias("name"))


def selected_forms(forms: DataFrame, preferred: str) -> DataFrame:
    has = forms.groupBy("bucket").agg(F.bool_or(F.col("form") == preferred).alias("has"))
    return forms.join(has, "bucket").where((F.col("form") == "metadata") | (F.col("form") == preferred) | ~F.col("has")).select("bucket", "form")


#: What has been compared with another implementation: widths of a head, reaches of local attention, intervals of global layers
TESTED = {"head_width": (64,), "local_attention": (128,), "global_every": (3,)}


def verdict() -> Column:
    """error for a configuration that can't be read as one, else rejected or accepted."""
    return F.when(F.col("hidden").isNull() | F.col("heads").isNull() | (F.col("heads") < 1), "error").when(F.size(refusals()) > 0, "rejected").otherwise("accepted")


def outside_tested(configs: DataFrame, most: int = 15) -> DataFrame:
    """The accepted configurations outside what has been tested, the most downloaded first, at most `most` of them."""
    own = configs.where(verdict() == "accepted").withColumn("head_width", F.floor(F.col("hidden") / F.col("heads")).cast("int"))
    known = [F.coalesce(F.col(c).isin(*values), F.lit(False)) for c, values in TESTED.items()]
    return own.where(~(known[0] & known[1] & known[2])).orderBy(F.desc("downloads"), "name").limit(most)


def slug(source: Column) -> Column:
    """A folder name for a model's id or path: other characters than ASCII letters, digits, dot, dash and underscore become dashes, none at the ends."""
    return F.regexp_replace(F.regexp_replace(source, r"[^A-Za-z0-9._-]", "-"), "^-+|-+$", "")


def bare_name(tensor: Column) -> Column:
    """A tensor's name without the wrapper's prefix."""
    return F.regexp_replace(tensor, r"^model\.", "")
