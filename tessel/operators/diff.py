"""Group hashes, change sets and staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_hash(df: DataFrame, group: str, member: Column, content: Column) -> DataFrame:
    """One hash per group over its sorted ``member:md5(content)`` lines.

    The lines are short digests, so a group's list stays far below its texts.
    """
    line = F.concat(member.cast("string"), F.lit(":"), F.md5(content))
    rows = df.select(F.col(group), F.struct(member.alias("m"), line.alias("line")).alias("s"))
    lines = F.transform(F.array_sort(F.collect_list("s")), lambda s: s["line"])
    return rows.groupBy(group).agg(F.md5(F.array_join(lines, "\n")).alias("group_hash"))


def change_set(stored: DataFrame, current: DataFrame, key: str, value: str = "group_hash") -> DataFrame:
    """``(key, state)`` with state new, changed, unchanged or deleted; nulls compare as values."""
    s = stored.select(key, F.col(value).alias("__old"), F.lit(1).alias("__s"))
    c = current.select(key, F.col(value).alias("__new"), F.lit(1).alias("__c"))
    state = F.when(F.col("__s").isNull(), "new").when(F.col("__c").isNull(), "deleted").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("changed")
    return s.join(c, key, "full_outer").select(key, state.alias("state"))
