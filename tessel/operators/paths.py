"""Dotted paths over models, and longest-prefix lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_dotted(paths: DataFrame, fields: DataFrame) -> DataFrame:
    """Follow ``a.b.c`` from a model over relational fields.

    ``paths(path_id, model, path)``, ``fields(model, field, comodel, field_type)`` unique by model
    and field.  Adds the terminal model, field and type, ``fully_resolved`` and ``broken_at``; each
    part is one join with the field table, for as many parts as the longest path has.  A null path
    is neither resolved nor broken.
    """
    most = paths.agg(F.max(F.size(F.split("path", r"\.")))).first()[0] or 0
    f = fields.select(F.col("model").alias("__model"), F.col("field").alias("__field"), F.col("comodel").alias("__comodel"), F.col("field_type").alias("__type"))
    cur = paths.select("path_id", "model", "path").withColumn("parts", F.split("path", r"\."))
    cur = cur.withColumn("cur", F.col("model")).withColumn("terminal_model", F.lit(None).cast("string")).withColumn("terminal_field", F.lit(None).cast("string")).withColumn("terminal_type", F.lit(None).cast("string")).withColumn("broken_at", F.lit(None).cast("string"))
    for k in range(most):
        part = F.get("parts", F.lit(k))
        active = (F.size("parts") > k) & F.col("broken_at").isNull()
        joined = cur.withColumn("part", F.when(active, part)).join(f, (F.col("cur") == F.col("__model")) & (F.col("part") == F.col("__field")), "left")
        last = F.size("parts") == k + 1
        broken = (
            F.when(F.col("part").isNull(), F.col("broken_at"))
            .when(F.col("__field").isNull(), F.concat("cur", F.lit("."), "part"))
            .when(~last & F.col("__comodel").isNull(), F.concat("cur", F.lit("."), "part", F.lit(" (no comodel)")))
        )
        hit = F.col("__field").isNotNull()
        cur = joined.select(
            "path_id", "model", "path", "parts",
            F.when(hit & F.col("__comodel").isNotNull(), F.col("__comodel")).otherwise(F.col("cur")).alias("cur"),
            F.when(hit & last, F.col("__model")).otherwise(F.col("terminal_model")).alias("terminal_model"),
            F.when(hit & last, F.col("__field")).otherwise(F.col("terminal_field")).alias("terminal_field"),
            F.when(hit & last, F.col("__type")).otherwise(F.col("terminal_type")).alias("terminal_type"),
            broken.alias("broken_at"),
        )
    return cur.select("path_id", "model", "path", "terminal_model", "terminal_field", "terminal_type", F.col("terminal_field").isNotNull().alias("fully_resolved"), "broken_at")


def longest_prefix(items: DataFrame, item: str, prefixes: DataFrame, prefix: str, separator: str = "/") -> DataFrame:
    """Each item with its longest prefix at separator ends: an equi-join on the item's own prefixes, not a theta join."""
    parts = F.split(F.col(item), separator)
    own = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), separator))
    ways = items.select(item, F.explode(own).alias(prefix))
    hits = ways.join(prefixes.select(prefix).distinct(), prefix)
    best = hits.groupBy(item).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return items.join(best, item, "left")

