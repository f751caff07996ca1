"""The knowledge-graph build: one lazy plan from files to tables, published atomically, kept up incrementally."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.operators.diff import change_set, group_hash
from tessel.operators.incremental import HashState
from tessel.operators.paths import resolve_dotted
from tessel.operators.upsert import ignore_by_key, replace_by_key
from tessel.schemas import TABLES
from tessel.sources.extract import facts, table_of

SCHEMA_VERSION = "1"
#: natural keys of the tables that have one; later rows replace earlier ones
KEYS = {"modules": ["name"], "models": ["name", "module", "inherit_type"], "fields": ["model", "name", "module"], "methods": ["model", "name", "module"]}


#: of rows of one key the last in the order of paths, and of places within a file, is the last writer
ORDER = ["file", "seq"]


def derive(rows: DataFrame) -> dict[str, DataFrame]:
    """All tables from the facts: keyed upserts, then the tables that are joins of others."""
    t = {name: table_of(rows, name) for name in TABLES}
    for name, keys in KEYS.items():
        t[name] = (ignore_by_key if name == "methods" else replace_by_key)(t[name], keys, ["path", "seq"] if name == "modules" else ORDER)
    t["module_deps"] = t["modules"].select(F.col("name").alias("src"), F.explode("depends").alias("dst")).distinct()
    t["inherits"] = t["models"].select(F.col("name").alias("src"), F.explode("inherits").alias("dst")).where("src <> dst").distinct()
    t["state_machines"] = (
        t["methods"].select("model", "name", "file", "seq", F.explode("transitions").alias("x"))
        .groupBy("model", F.col("x.field").alias("field"))
        .agg(F.array_sort(F.collect_set("x.to_state")).alias("states"), F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("file", "seq", "x.from_state", "x.to_state", "name"))), lambda s: F.struct(s["from_state"].alias("from_state"), s["to_state"].alias("to_state"), s["name"].alias("method")))).alias("transitions"))
    )
    split = F.filter(F.transform(F.split("groups", ","), lambda g: F.trim(g)), lambda g: g != "")
    python = t["fields"].where("groups is not null").select("model", F.col("name").alias("field"), F.explode(split).alias("group_id"), F.lit("python").alias("source"), "module")
    views = t["views"].select(F.col("xml_id").alias("view_xml_id"), F.col("model"))
    view = t["elements"].where("field_name is not null and groups is not null").join(views, "view_xml_id").select("model", F.col("field_name").alias("field"), F.explode(split).alias("group_id"), F.lit("view").alias("source"), "module")
    t["field_groups"] = python.unionAll(view).dropDuplicates(["model", "field", "group_id", "source"])
    t["selection_extensions"] = t["fields"].where("size(selection_add) > 0").select("model", F.col("name").alias("field"), "selection_add", "module", "file")
    t["context_dependencies"] = t["methods"].select("model", F.col("name").alias("method"), F.explode("depends_context").alias("context_key"), "module").where("context_key <> ''")
    lookup = t["fields"].groupBy("model", F.col("name").alias("field")).agg(F.max_by("comodel", F.struct(*ORDER)).alias("comodel"), F.max_by("field_type", F.struct(*ORDER)).alias("field_type"))
    related = t["fields"].where("related like '%.%'").select(F.concat_ws("|", "model", "name", "module").alias("path_id"), "model", F.col("related").alias("path"))
    t["related_paths"] = resolve_dotted(related, lookup)
    cron = t["crons"].select("model", F.regexp_extract("method", r"(\w+)\s*(?:\(|$)", 1).alias("name")).distinct().withColumn("is_cron_target", F.lit(True))
    t["methods"] = t["methods"].join(cron, ["model", "name"], "left").withColumn("is_cron_target", F.coalesce("is_cron_target", F.lit(False)))
    action = ignore_by_key(t["actions"].where("xml_id is not null"), ["xml_id"], ORDER).select(F.col("xml_id").alias("action"), F.col("res_model").alias("action_model"))
    parent = ignore_by_key(t["menus"].where("xml_id is not null"), ["xml_id"], ORDER).select(F.col("xml_id").alias("parent"), F.col("name").alias("parent_name"))
    t["menus"] = t["menus"].join(action, "action", "left").join(parent, "parent", "left")
    t["documents"] = search_documents(t)
    return t


def search_documents(t: dict[str, DataFrame]) -> DataFrame:
    """``(entity_type, entity_name, model_context, content, module)`` of the five searchable kinds."""

    def doc(kind: str, df: DataFrame, name, context, *content) -> DataFrame:
        rows = df.select(F.lit(kind).alias("entity_type"), name.alias("entity_name"), F.coalesce(context, F.lit("")).alias("model_context"), F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in content)).alias("content"), F.coalesce("module", F.lit("")).alias("module"))
        return rows.where("entity_name is not null")

    c = F.col
    return (
        doc("model", t["models"], c("name"), c("name"), c("description"), c("class_name"))
        .unionAll(doc("field", t["fields"], c("name"), c("model"), c("label"), c("help"), c("field_type")))
        .unionAll(doc("method", t["methods"], c("name"), c("model"), F.concat_ws(" ", "decorators")))
        .unionAll(doc("route", t["routes"], c("pattern"), F.lit(""), F.concat(F.lit("auth:"), "auth"), F.concat(F.lit("type:"), "type"), c("controller"), c("method")))
        .unionAll(doc("view", t["views"], F.coalesce("xml_id", "name"), c("model"), c("name"), c("view_type")))
        .withColumn("doc_id", F.xxhash64("entity_type", "entity_name", "model_context", "content", "module"))
    )


class Index:
    """A project's published facts: version folders under one pointer, swapped by rename."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.state = HashState(spark, self.folder)

    def build(self, files: DataFrame, force: bool = False) -> dict:
        """Full where nothing is published or ``force``, else only new and changed modules; deleted ones go.

        Facts and hashes are put in force together, so a run that fails leaves no trace, and a
        module's facts are replaced as a whole.
        """
        began = time.time()
        now = group_hash(files, "module", F.col("path"), F.coalesce("content", F.lit("")))
        old_facts, old_hashes = (None, None) if force else (self.state.read("facts"), self.state.read())
        total = now.count()
        if old_facts is None or old_hashes is None:
            fresh, mode, done = facts(files), "force" if force else "full", total
        else:
            states = change_set(old_hashes, now, "module").where("state <> 'unchanged'").persist()
            done, mode = states.where("state <> 'deleted'").count(), "incremental"
            if states.isEmpty():
                return {"success": True, "mode": mode, "modules_total": total, "modules_indexed": 0, "modules_skipped": total, "duration_seconds": round(time.time() - began, 2)}
            todo = states.where("state <> 'deleted'").select("module")
            fresh = old_facts.join(states.select("module"), "module", "left_anti").select("tbl", "module", "data").unionAll(facts(files.join(todo, "module", "left_semi")))
        self.state.commit(now, facts=fresh)
        return {"success": True, "mode": mode, "modules_total": total, "modules_indexed": done, "modules_skipped": total - done, "duration_seconds": round(time.time() - began, 2)}

    def tables(self) -> dict[str, DataFrame]:
        rows = self.state.read("facts")
        if rows is None:
            raise FileNotFoundError("no index is published yet")
        return derive(rows)

    def status(self, files: DataFrame | None = None) -> dict:
        """Counts, and how many modules are stale or new against the given files."""
        if self.state.version() is None:
            return {"has_index": False, "message": "no index"}
        rows = self.state.read("facts")
        counts = {r["tbl"]: r["count"] for r in rows.groupBy("tbl").count().collect()}
        out = {"has_index": True, "schema_version": SCHEMA_VERSION, "counts": counts, "version": self.state.version()}
        if files is not None:
            now = group_hash(files, "module", F.col("path"), F.coalesce("content", F.lit("")))
            states = change_set(self.state.read(), now, "module")
            found = {r["state"]: (r["n"], r["names"]) for r in states.groupBy("state").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_list("module")), 1, 10).alias("names")).where("state <> 'unchanged'").collect()}
            out |= {"stale_modules": sum(found.get(s, (0, []))[0] for s in ("new", "changed")), "stale_module_names": found.get("changed", (0, []))[1], "new_module_names": found.get("new", (0, []))[1]}
        return out


