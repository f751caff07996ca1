"""Keyed writes as DataFrame operators: replace, ignore, merge, update, delete-insert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(df: DataFrame, keys: Sequence[str], order: Column, last: bool) -> DataFrame:
    """The last or first row of each key; partial aggregation instead of a sort, so hot keys are no matter."""
    row = F.struct(*df.columns)
    best = (F.max_by if last else F.min_by)(row, order)
    return df.groupBy(*keys).agg(best.alias("__row")).select("__row.*")


def replace_by_key(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Last writer wins; ``seq`` must order the rows of a key totally."""
    return _pick(df, keys, F.struct(*seq), True)


def ignore_by_key(df: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """First writer wins."""
    return _pick(df, keys, F.struct(*seq), False)


def merge_partial(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer merge: the new value where there is one, else the old; columns only one side has stay."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    columns = list(dict.fromkeys([*old.columns, *new.columns]))

    def pick(c: str) -> Column:
        sides = [F.col(f"n.{c}")] * (c in new.columns) + [F.col(f"o.{c}")] * (c in old.columns)
        return F.coalesce(*sides).alias(c)

    return joined.select(*(pick(c) for c in columns))


def update_coalesce(target: DataFrame, updates: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Keyed update that leaves the old value where the update has none; updates must be unique by key."""
    u = updates.select(*keys, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = target.join(u, list(keys), "left")
    return joined.select(*((F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c)) for c in target.columns))


def delete_insert(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Replace all rows of the keys that ``rows`` has."""
    return target.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows)


def first_match(left: DataFrame, right: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Left join with the first match per key."""
    return left.join(ignore_by_key(right.select(key, *dict.fromkeys([*order, *columns])), [key], list(order)).select(key, *columns), key, "left")


def union_precedence(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of sources with keyed dedupe; the earlier source takes precedence."""
    rows = None
    for i, s in enumerate(sources):
        part = s.withColumn("__ord", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return ignore_by_key(rows, keys, ["__ord"]).drop("__ord")
