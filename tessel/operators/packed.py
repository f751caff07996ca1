"""Operator: several values packed in one field, one row per value with its position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.packed import packed_values


def explode_packed(df: DataFrame, key: str, columns: Sequence[str], table_name: str, least: int = 2) -> DataFrame:
    """Rows ``(table_name, row_id, column_name, pos, val)`` of fields that hold at least ``least`` values.

    A narrow transformation: all packed columns are split in one pass over the table.  Null and
    empty fields give no row, repeated rows each give theirs, an empty table gives an empty
    result, and further columns of the input are never looked at, whatever their names.
    """

    def vals(c: Column) -> Column:
        # a text without delimiter or blank holds one value at most, so it is not split where two are asked for
        return F.when(F.rlike(c, F.lit(r"[,;|\s\u00a0]") if least > 1 else F.lit("")), packed_values(c)).otherwise(F.array().cast("array<string>"))

    fields = F.array(*(F.struct(F.lit(c).alias("column_name"), vals(F.col(f"`{c}`")).alias("vals")) for c in columns))
    long = df.select(F.col(f"`{key}`").cast("long").alias("row_id"), F.explode(fields).alias("f")).select("row_id", "f.column_name", "f.vals")
    return (
        long.where(F.size("vals") >= least)
        .select("row_id", "column_name", F.posexplode("vals").alias("p", "val"))
        .select(F.lit(table_name).alias("table_name"), "row_id", "column_name", (F.col("p") + 1).cast("int").alias("pos"), "val")
    )
