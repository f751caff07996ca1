"""Typed node and edge tables of the whole knowledge graph, of a model's or a module's surroundings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.operators import graph

#: Prefixes of node ids by kind (fixed values).
PREFIX = {"model": "m:", "field": "f:", "method": "mt:", "state": "st:", "action": "ac:", "view": "v:", "module": "mod:", "security": "sec:", "cron": "cron:"}


def _id(kind: str, *parts) -> F.col:
    return F.concat(F.lit(PREFIX[kind]), *parts)


def edges(t: dict[str, DataFrame]) -> DataFrame:
    """``(src, dst, type, label)``, deduplicated, of every edge kind."""
    c = F.col
    model = _id("model", c("model"))

    def edge(df: DataFrame, src, dst, kind: str, label) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"), label.alias("label")).where("src is not null and dst is not null")

    rel = t["fields"].where("comodel is not null")
    moves = t["state_machines"].select("model", F.explode("transitions").alias("x"))
    parts = [
        edge(rel, model, _id("model", c("comodel")), "field_rel", c("name")),
        edge(t["inherits"], _id("model", c("src")), _id("model", c("dst")), "inherit", F.lit("inherits")),
        edge(t["models"], _id("module", c("module")), _id("model", c("name")), "defines", c("inherit_type")),
        edge(t["methods"], model, _id("method", c("model"), F.lit("."), c("name")), "has_method", F.lit("")),
        edge(t["fields"].where("compute is not null"), _id("method", c("model"), F.lit("."), c("compute")), _id("field", c("model"), F.lit("."), c("name")), "compute", F.lit("computes")),
        edge(moves, _id("method", c("model"), F.lit("."), c("x.method")), _id("state", c("model"), F.lit(":"), c("x.to_state")), "state", c("x.to_state")),
        edge(t["views"], _id("view", c("xml_id")), model, "view_of", c("view_type")),
        edge(t["views"], _id("view", c("xml_id")), _id("view", c("inherit_id")), "view_inherit", F.lit("")),
        edge(t["actions"], _id("action", c("xml_id")), _id("model", c("res_model")), "action", c("action_type")),
        edge(t["access_rules"], _id("security", c("xml_id")), model, "access", c("group_id")),
        edge(t["record_rules"], _id("security", c("xml_id")), model, "rule", c("domain")),
        edge(t["crons"], _id("cron", c("xml_id")), model, "cron", c("method")),
        edge(t["module_deps"], _id("module", c("src")), _id("module", c("dst")), "depends", F.lit("")),
    ]
    return reduce(DataFrame.unionAll, parts).withColumn("label", F.coalesce("label", F.lit(""))).distinct()


def nodes(t: dict[str, DataFrame], all_edges: DataFrame) -> DataFrame:
    """``(id, kind, external)``: ends of edges; a model or module that no file defines is external."""
    ids = all_edges.select(F.col("src").alias("id")).union(all_edges.select("dst")).distinct()
    kind = reduce(lambda acc, k: acc.when(F.startswith("id", F.lit(PREFIX[k])), k), list(PREFIX)[1:], F.when(F.startswith("id", F.lit(PREFIX["model"])), "model"))
    defined = t["models"].select(_id("model", F.col("name")).alias("id")).union(t["modules"].select(_id("module", F.col("name")).alias("id"))).distinct().withColumn("known", F.lit(True))
    return ids.join(defined, "id", "left").select("id", kind.alias("kind"), (kind.isin("model", "module") & F.col("known").isNull()).alias("external"))


def around(all_edges: DataFrame, start: str, depth: int = 1) -> DataFrame:
    """Edges within ``depth`` hops of a node, walked both ways."""
    spark = all_edges.sparkSession
    near = graph.bfs(graph.both_ways(all_edges.select("src", "dst")), spark.createDataFrame([(start,)], "start string"), depth).select("node")
    return all_edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst", "type", "label")
