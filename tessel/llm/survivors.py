"""Operator: the surviving record of each duplicate group, chosen field by field.

The row with the latest timestamp among those that fill the field survives, as far as timestamps
tell.  Where filled rows lack them, currency reasoning decides: transitions between values, learnt
from the timestamped rows of all groups, give a precedence (a before b where a -> b is seen more
often than b -> a).  A group's values are partially ordered by it, through values the group need
not hold, and a topologically latest value survives: one that no other value of the group follows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.session import cut


def name_key(c: Column) -> Column:
    return F.lower(F.trim(c))


def model_key(c: Column) -> Column:
    """Letter case, outer blanks and ``_`` versus ``.`` do not count."""
    return F.replace(name_key(c), F.lit("_"), F.lit("."))


def module_key(module: Column, path: Column) -> Column:
    """The module, or where it is missing the one of ``/srv/<project>/<repo>/<module>/...``."""
    own = F.nullif(name_key(module), F.lit(""))
    return F.coalesce(own, F.nullif(name_key(F.regexp_extract(path, r"^/srv/+[^/]+/+[^/]+/+([^/]+)/", 1)), F.lit("")))


def filled(c: Column) -> Column:
    """Neither null, blank nor an empty list."""
    return F.coalesce(~F.rlike(F.trim(c), F.lit(r"^(?:\s*|\[\s*\])$")), F.lit(False))


def _long(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per filled field: ``(key, column_name, row_id, ts, value)``, the value by its digest."""
    fields = F.array(*(F.struct(F.lit(c).alias("column_name"), F.when(filled(F.col(f"v{i}")), F.md5(f"v{i}")).alias("value")) for i, c in enumerate(columns)))
    return rows.select("key", "row_id", "ts", F.explode(fields).alias("f")).select("key", "row_id", "ts", "f.column_name", "f.value").where("value is not null")


def learn_precedence(timed: DataFrame) -> DataFrame:
    """``(column_name, before, after)`` from consecutive values of groups; hot groups span many tasks.

    Rows are range-partitioned by group, field and time; each task counts the transitions inside
    its range, and the few rows at the range ends are linked in a second step.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict = {}
        first = last = None
        for batch in batches:
            for row in batch[["key", "column_name", "value", "part"]].itertuples(index=False):
                row = tuple(row)
                if first is None:
                    first = row
                if last is not None and last[:2] == row[:2] and last[2] != row[2]:
                    pair = (row[1], last[2], row[2])
                    counts[pair] = counts.get(pair, 0) + 1
                last = row
            if len(counts) > 200_000:
                yield pd.DataFrame([("", c, a, b, n, -1, 0) for (c, a, b), n in counts.items()], columns=names)
                counts = {}
        out = [("", c, a, b, n, -1, 0) for (c, a, b), n in counts.items()]
        if first is not None:
            out += [(first[0], first[1], first[2], None, 0, first[3], 0), (last[0], last[1], last[2], None, 0, last[3], 1)]
        yield pd.DataFrame(out, columns=names)

    names = ["key", "column_name", "before", "after", "n", "part", "side"]
    ordered = timed.select("key", "column_name", "value", "ts", "row_id").repartitionByRange("key", "column_name", "ts", "row_id").sortWithinPartitions("key", "column_name", "ts", "row_id")
    # the ranges are sampled, so they are evaluated once
    counted = cut(ordered.select("key", "column_name", "value", F.spark_partition_id().alias("part")).mapInPandas(run, "key string, column_name string, before string, after string, n long, part int, side int"))
    ends = counted.where("part >= 0")
    nxt = {c: F.lead(c).over(Window.orderBy("part", "side")) for c in ("key", "column_name", "before", "side")}
    linked = ends.select("*", *(v.alias(f"next_{k}") for k, v in nxt.items())).where("side = 1 and next_side = 0 and key = next_key and column_name = next_column_name and before <> next_before")
    pairs = counted.where("part < 0").select("column_name", "before", "after", "n").union(linked.select("column_name", "before", F.col("next_before").alias("after"), F.lit(1).cast("long").alias("n")))
    way = pairs.where("before <> after").select(
        "column_name", F.least("before", "after").alias("a"), F.greatest("before", "after").alias("b"), F.when(F.col("before") < F.col("after"), F.col("n")).otherwise(-F.col("n")).alias("n")
    )
    net = way.groupBy("column_name", "a", "b").agg(F.sum("n").alias("n")).where("n <> 0")
    return net.select("column_name", F.when(F.col("n") > 0, F.col("a")).otherwise(F.col("b")).alias("before"), F.when(F.col("n") > 0, F.col("b")).otherwise(F.col("a")).alias("after"))


def reachable(precedence: DataFrame, sources: DataFrame) -> DataFrame:
    """``(column_name, source, value)``: the values that follow each source, directly or through others.

    ``sources(column_name, source)``, distinct; in a cycle of the precedence every value follows every other.
    """
    edges = cut(precedence.select("column_name", "before", "after"))
    front = cut(sources.select("column_name", "source", F.col("source").alias("value")))
    seen = None
    while True:
        step = front.join(edges.withColumnRenamed("before", "value"), ["column_name", "value"]).select("column_name", "source", F.col("after").alias("value")).distinct()
        front = cut(step if seen is None else step.join(seen, ["column_name", "source", "value"], "left_anti"))
        if front.isEmpty():
            return front if seen is None else seen
        seen = front if seen is None else seen.unionByName(front)


def _latest_in_order(candidates: DataFrame, precedence: DataFrame) -> DataFrame:
    """``(key, column_name, row_id)`` of each group's topologically latest candidate ``(key, column_name, value, timed, row_id)``.

    A candidate falls to one that follows it and is not followed by it.  Of several latest ones, a
    timestamped one goes first, then the smallest id.
    """
    of = ["key", "column_name"]
    several = candidates.join(candidates.groupBy(*of).agg(F.count("*").alias("n")).where("n > 1").select(*of), of, "left_semi")
    follows = reachable(precedence, several.select("column_name", F.col("value").alias("source")).distinct())
    after = several.join(follows.select("column_name", F.col("source").alias("value"), F.col("value").alias("later")), ["column_name", "value"]).where("value <> later")
    after = cut(after.join(several.select(*of, F.col("value").alias("later")), [*of, "later"], "left_semi").select(*of, "value", "later"))
    back = after.select(*of, F.col("later").alias("value"), F.col("value").alias("later"))
    fallen = after.join(back, [*of, "value", "later"], "left_anti").select(*of, "value").distinct()
    left = candidates.join(fallen, [*of, "value"], "left_anti")
    return left.groupBy(*of).agg(F.min(F.struct(~F.col("timed"), "row_id")).alias("s")).select(*of, "s.row_id")


def survivors(df: DataFrame, row_id: str, key: Sequence[Column], columns: Sequence[str], timestamp: str, table_name: str) -> DataFrame:
    """Rows ``(table_name, group_id, column_name, row_id)`` of groups of at least two rows.

    ``group_id`` is the group's smallest id, ``row_id`` the row whose value survives (null where no
    row fills the field).  Of equal timestamps the smallest id stands.  Rows with a null in any part
    of the key are no duplicates of anything.  Aggregation only, so a group may hold any share of
    the rows.  Where filled rows lack a timestamp, their values and the latest timestamped one are
    ordered by the learnt precedence; values that it does not relate leave the timestamped one, or
    else the smallest id.  An empty table gives an empty result.
    """
    parts = [k.alias(f"k{i}") for i, k in enumerate(key)]
    rows = df.select(*parts, F.col(f"`{row_id}`").cast("long").alias("row_id"), F.col(f"`{timestamp}`").alias("ts"), *(F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(columns)))
    for i in range(len(parts)):
        rows = rows.where(F.col(f"k{i}").isNotNull())
    rows = rows.withColumn("key", F.concat_ws("\x01", *(f"k{i}" for i in range(len(parts)))))
    picks = []
    for i, _ in enumerate(columns):
        full = filled(F.col(f"v{i}"))
        picks.append(F.max(F.when(full & F.col("ts").isNotNull(), F.struct("ts", (-F.col("row_id")).alias("neg")))).alias(f"p{i}"))
        picks.append(F.max(full & F.col("ts").isNull()).alias(f"u{i}"))
    groups = rows.groupBy("key").agg(F.min("row_id").alias("group_id"), F.count("*").alias("n"), *picks).where("n > 1")
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), (-F.col(f"p{i}.neg")).alias("row_id"), F.col(f"u{i}").alias("untimed")) for i, c in enumerate(columns)))
    chosen = groups.select("key", "group_id", F.explode(each).alias("e")).select("key", "group_id", "e.column_name", "e.row_id", "e.untimed")
    if not rows.where("ts is null").isEmpty():
        fields, of = _long(rows, columns), ["key", "column_name"]
        open_fields = cut(chosen.where("untimed").select(*of, F.col("row_id").alias("last")))
        untimed = fields.where("ts is null").join(open_fields, of, "left_semi").select(*of, "value", F.lit(False).alias("timed"), "row_id")
        timed = fields.join(open_fields.where("last is not null"), of).where("row_id = last").select(*of, "value", F.lit(True).alias("timed"), "row_id")
        same = untimed.unionByName(timed).groupBy(*of, "value").agg(F.min(F.struct(~F.col("timed"), "row_id")).alias("s"))
        candidates = cut(same.select(*of, "value", (~F.col("s.col1")).alias("timed"), "s.row_id"))
        found = _latest_in_order(candidates, learn_precedence(fields.where("ts is not null"))).withColumnRenamed("row_id", "found")
        chosen = chosen.join(found, of, "left").withColumn("row_id", F.coalesce("found", "row_id"))
    return chosen.select(F.lit(table_name).alias("table_name"), "group_id", "column_name", "row_id")
