"""Contract queries: every relational, graph, rule and search operator over the given tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions import text as X
from tessel.functions.packed import packed_values
from tessel.operators import diff, fts, graph, paths, upsert
from tessel.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def contract(sql: str):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def n(alias: str = "n"):
    return F.count("*").alias(alias)


# ---- keyed writes


@contract("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) rn FROM events) WHERE rn = 1")
def q_upsert_replace(s, d):
    rows = table(s, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return upsert.replace_by_key(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@contract("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) rn FROM events) WHERE rn = 1")
def q_upsert_ignore(s, d):
    rows = table(s, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    return upsert.ignore_by_key(rows, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@contract("SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'click' UNION ALL SELECT user_id FROM events WHERE value > 5) GROUP BY 1")
def q_append_no_key(s, d):
    e = table(s, d, "events")
    return e.where("event_type = 'click'").select("user_id").unionAll(e.where("value > 5").select("user_id")).groupBy("user_id").agg(n())


@contract("""SELECT coalesce(n.k, o.k) AS k, coalesce(n.amount, o.amount) AS amount, o.segment AS segment, n.orders AS orders
FROM (SELECT c_custkey AS k, c_acctbal AS amount, c_mktsegment AS segment FROM customer) o
FULL OUTER JOIN (SELECT o_custkey AS k, max(o_totalprice) AS amount, count(*) AS orders FROM orders GROUP BY 1) n ON o.k = n.k""")
def q_merge_partial(s, d):
    old = table(s, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("amount"), F.col("c_mktsegment").alias("segment"))
    new = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("amount"), n("orders"))
    return upsert.merge_partial(old, new, ["k"])


@contract("""SELECT p_partkey, coalesce(l.price, p_retailprice) AS p_retailprice FROM part LEFT JOIN
(SELECT l_partkey, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON p_partkey = l_partkey""")
def q_update_coalesce(s, d):
    p = table(s, d, "part").select("p_partkey", "p_retailprice")
    new = table(s, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("p_retailprice"))
    return upsert.update_coalesce(p, new, ["p_partkey"], ["p_retailprice"])


@contract("""WITH fresh AS (SELECT doc_id + 1000000 AS doc_id, source FROM documents WHERE lang = 'de' AND source IS NOT NULL)
SELECT doc_id, source FROM documents WHERE source IS NULL OR source NOT IN (SELECT source FROM fresh) UNION ALL SELECT doc_id, source FROM fresh""")
def q_delete_insert(s, d):
    docs = table(s, d, "documents").select("doc_id", "source", "lang")
    fresh = docs.where("lang = 'de' and source is not null").select((F.col("doc_id") + 1000000).alias("doc_id"), "source")
    return upsert.delete_insert(docs.select("doc_id", "source"), fresh, "source")


@contract("""SELECT o_orderkey, l_partkey FROM orders LEFT JOIN (SELECT l_orderkey, l_partkey FROM
(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) rn FROM lineitem) WHERE rn = 1) ON o_orderkey = l_orderkey""")
def q_first_match_update(s, d):
    lines = table(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return upsert.first_match(table(s, d, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_partkey"], ["l_partkey"])


# ---- change detection


@contract("SELECT source, md5(string_agg(doc_id || ':' || md5(text), chr(10) ORDER BY doc_id)) AS group_hash FROM documents GROUP BY source")
def q_group_hash(s, d):
    return diff.group_hash(table(s, d, "documents"), "source", F.col("doc_id"), F.col("text"))


@contract("""WITH w AS (SELECT project_name, max(cutoff_at) AS w FROM index_results WHERE finished_at IS NOT NULL GROUP BY 1),
s AS (SELECT *, project_name || ':' || coalesce(module_name, path) AS m FROM module_scans WHERE project_name IS NOT NULL),
c AS (SELECT m, md5(string_agg(scan_id || ':' || md5(module_hash), chr(10) ORDER BY scan_id)) AS h FROM s GROUP BY 1),
o AS (SELECT m, md5(string_agg(scan_id || ':' || md5(module_hash), chr(10) ORDER BY scan_id)) AS h FROM s JOIN w ON w.project_name = s.project_name WHERE arrived_at <= w GROUP BY 1)
SELECT coalesce(o.m, c.m) AS module, CASE WHEN o.m IS NULL THEN 'new' WHEN c.m IS NULL THEN 'deleted' WHEN o.h = c.h THEN 'unchanged' ELSE 'changed' END AS state FROM o FULL OUTER JOIN c ON o.m = c.m""")
def q_change_set(s, d):
    """Modules of each project by the scans that had arrived by its last finished run's cutoff and those there are."""
    module = F.concat("project_name", F.lit(":"), F.coalesce("module_name", "path"))
    scans = table(s, d, "module_scans").where("project_name is not null").withColumn("module", module)
    last = table(s, d, "index_results").where("finished_at is not null").groupBy("project_name").agg(F.max("cutoff_at").alias("w"))

    def hashes(rows: DataFrame) -> DataFrame:
        return diff.group_hash(rows, "module", F.col("scan_id"), F.col("module_hash"))

    return diff.change_set(hashes(scans.join(last, "project_name").where("arrived_at <= w")), hashes(scans), "module")


# ---- joins


@contract("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS has_done FROM customer")
def q_exists_flag(s, d):
    done = table(s, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("x", F.lit(True))
    return table(s, d, "customer").select("c_custkey").join(done, "c_custkey", "left").select("c_custkey", F.coalesce("x", F.lit(False)).alias("has_done"))


@contract("SELECT DISTINCT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 40)")
def q_inherited_antijoin(s, d):
    own = table(s, d, "lineitem").where("l_quantity > 40").select(F.col("l_partkey").alias("p_partkey"))
    return table(s, d, "part").select("p_partkey").join(own, "p_partkey", "left_anti").distinct()


@contract("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) OR c_mktsegment ILIKE '%build%'")
def q_existence_or(s, d):
    table(s, d, "customer").createOrReplaceTempView("tessel_customer")
    table(s, d, "orders").createOrReplaceTempView("tessel_orders")
    return s.sql("SELECT c_custkey FROM tessel_customer WHERE c_custkey IN (SELECT o_custkey FROM tessel_orders WHERE o_totalprice > 450000) OR c_mktsegment ILIKE '%build%'")


@contract("""SELECT c_custkey, count(DISTINCT o_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts FROM customer
LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def q_left_fanout_distinct(s, d):
    o = table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    orders = o.groupBy("c_custkey").agg(F.count_distinct("o_orderkey").alias("n_orders"))
    parts = o.join(table(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"), "o_orderkey").groupBy("c_custkey").agg(F.count_distinct("l_partkey").alias("n_parts"))
    rows = table(s, d, "customer").select("c_custkey").join(orders, "c_custkey", "left").join(parts, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_parts", F.lit(0)).alias("n_parts"))


@contract("""SELECT n_name, s_cnt AS n, array_to_string(names[1:6], ', ') || CASE WHEN len(names) > 6 THEN ', …' ELSE '' END AS names
FROM (SELECT n_name, count(s_suppkey) AS s_cnt, coalesce(list(s_name ORDER BY s_name) FILTER (s_name IS NOT NULL), []) AS names FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name)""")
def q_two_key_left(s, d):
    """A nation's number of suppliers and the first six names; no list is longer than that."""
    suppliers = table(s, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey", "s_name")
    first = suppliers.withColumn("rn", F.row_number().over(Window.partitionBy("n_nationkey").orderBy(F.col("s_name").asc_nulls_last()))).where("rn <= 6")
    names = first.groupBy("n_nationkey").agg(F.array_join(F.array_sort(F.collect_list("s_name")), ", ").alias("first"))
    counts = suppliers.groupBy("n_nationkey").agg(F.count("s_suppkey").alias("n"), F.count("s_name").alias("named"))
    rows = table(s, d, "nation").join(counts, "n_nationkey", "left").join(names, "n_nationkey", "left")
    return rows.select("n_name", F.coalesce("n", F.lit(0)).alias("n"), F.concat(F.coalesce("first", F.lit("")), F.when(F.col("named") > 6, ", …").otherwise("")).alias("names"))


@contract("""SELECT file_id, prefix FROM (SELECT f.file_id, p.prefix, row_number() OVER (PARTITION BY f.file_id ORDER BY length(p.prefix) DESC) rn FROM source_files f
JOIN (SELECT DISTINCT root_path AS prefix FROM index_projects WHERE root_path IS NOT NULL UNION SELECT '/srv') p ON starts_with(f.path, p.prefix || '/')) WHERE rn = 1""")
def q_longest_prefix(s, d):
    roots = table(s, d, "index_projects").where("root_path is not null").select(F.col("root_path").alias("prefix")).union(s.createDataFrame([("/srv",)], "prefix string"))
    files = table(s, d, "source_files").select("file_id", "path")
    return paths.longest_prefix(files, "path", roots, "prefix").where("prefix is not null").select("file_id", "prefix")


@contract("SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1")
def q_group_concat(s, d):
    rows = table(s, d, "lineitem").select("l_orderkey", "l_returnflag").join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    return rows.groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


@contract("SELECT r.ref_id, v.view_id, v.priority FROM view_element_refs r JOIN view_records v ON trim(r.view_xml_id) = trim(v.xml_id) WHERE r.element_type = 'field' AND v.view_type = 'form'")
def q_view_field_join(s, d):
    refs = table(s, d, "view_element_refs").where("element_type = 'field'").select("ref_id", F.trim("view_xml_id").alias("x"))
    views = table(s, d, "view_records").where("view_type = 'form'").select("view_id", "priority", F.trim("xml_id").alias("x"))
    return refs.join(views, "x").select("ref_id", "view_id", "priority")


# ---- aggregates and top-k


TOP_SQL = """WITH f AS (SELECT model_name AS model, count(DISTINCT field_name) AS fc FROM model_fields GROUP BY 1), m AS (SELECT model_name AS model, count(DISTINCT method_name) AS mc FROM model_methods GROUP BY 1),
t AS (SELECT name AS model, min(module_name) AS module FROM addon_models GROUP BY 1)
SELECT t.model, t.module, coalesce(fc, 0) AS fields, coalesce(mc, 0) AS methods, EXISTS (SELECT 1 FROM model_methods x WHERE x.model_name = t.model AND x.raises_validation = 1) AS checks
FROM t LEFT JOIN f USING (model) LEFT JOIN m USING (model) ORDER BY coalesce(fc, 0) + coalesce(mc, 0) DESC, t.model LIMIT 15"""


@contract(TOP_SQL)
def q_context_top_entities(s, d):
    f = table(s, d, "model_fields").groupBy(F.col("model_name").alias("model")).agg(F.count_distinct("field_name").alias("fc"))
    methods = table(s, d, "model_methods").select(F.col("model_name").alias("model"), "method_name", "raises_validation")
    m = methods.groupBy("model").agg(F.count_distinct("method_name").alias("mc"), F.max(F.col("raises_validation") == 1).alias("checks"))
    t = table(s, d, "addon_models").groupBy(F.col("name").alias("model")).agg(F.min("module_name").alias("module"))
    zero = F.lit(0)
    rows = t.join(f, "model", "left").join(m, "model", "left").select("model", "module", F.coalesce("fc", zero).alias("fields"), F.coalesce("mc", zero).alias("methods"), F.coalesce("checks", F.lit(False)).alias("checks"))
    return rows.orderBy(F.desc(F.col("fields") + F.col("methods")), "model").limit(15)


@contract("SELECT module_name, count(*) AS n FROM addon_models WHERE module_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, module_name LIMIT 10")
def q_context_top_modules(s, d):
    return table(s, d, "addon_models").where("module_name is not null").groupBy("module_name").agg(n()).orderBy(F.desc("n"), "module_name").limit(10)


COUNTED = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "addon_modules", "addon_models", "model_fields", "model_methods", "view_records", "view_element_refs", "menu_records",
    "index_projects", "index_results", "module_scans", "source_files", "view_dumps", "eval_items", "core_registry",
)


@contract(" UNION ALL ".join(f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in COUNTED))
def q_index_counts(s, d):
    out = None
    for t in COUNTED:
        rows = table(s, d, t).agg(n()).select(F.lit(t).alias("t"), "n")
        out = rows if out is None else out.unionAll(rows)
    return out


@contract("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def q_distinct_count(s, d):
    return table(s, d, "lineitem").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@contract("SELECT coalesce(lower(trim(kind)), 'none') AS kind, coalesce(repo, 'unknown') AS repo, count(*) AS n FROM source_files GROUP BY 1, 2")
def q_route_summary(s, d):
    return table(s, d, "source_files").groupBy(F.coalesce(F.lower(F.trim("kind")), F.lit("none")).alias("kind"), F.coalesce("repo", F.lit("unknown")).alias("repo")).agg(n())


@contract("""SELECT source, lang AS top FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) rn FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY source, lang) WHERE rn = 1""")
def q_mode_version(s, d):
    counts = table(s, d, "documents").where("lang is not null and source is not null").groupBy("source", "lang").agg(n())
    return counts.groupBy("source").agg(F.min_by("lang", F.struct(-F.col("n"), "lang")).alias("top"))


# ---- predicates


@contract("SELECT file_id, split_part(path, '/', 3) AS project, split_part(path, '/', -1) AS file FROM source_files WHERE path ILIKE '/srv/acre%' AND repo ILIKE 'sable%'")
def q_route_filters(s, d):
    f = table(s, d, "source_files").where(F.col("path").ilike("/srv/acre%") & F.col("repo").ilike("sable%"))
    return f.select("file_id", F.split_part("path", F.lit("/"), F.lit(3)).alias("project"), F.split_part("path", F.lit("/"), F.lit(-1)).alias("file"))


@contract("SELECT field_id FROM model_fields WHERE field_name ILIKE '%Total_a%'")
def q_like_ci(s, d):
    return table(s, d, "model_fields").where(X.contains_ci(F.col("field_name"), "Total_a")).select("field_id")


@contract("SELECT method_id FROM model_methods WHERE method_name NOT ILIKE 'action_%'")
def q_not_like(s, d):
    return table(s, d, "model_methods").where(~F.col("method_name").ilike("action_%")).select("method_id")


@contract("SELECT view_id FROM view_records WHERE trim(inherit_id) = 'view_order_form' OR trim(inherit_id) ILIKE '%.view_order_form'")
def q_suffix_or_eq(s, d):
    return table(s, d, "view_records").where(X.suffix_or_equal(F.trim("inherit_id"), "view_order_form")).select("view_id")


@contract("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT' OR o_totalprice < 1000")
def q_or_columns(s, d):
    return table(s, d, "orders").where((F.col("o_orderstatus") == "P") | (F.col("o_orderpriority") == "1-URGENT") | (F.col("o_totalprice") < 1000)).select("o_orderkey")


@contract("SELECT DISTINCT p_name FROM part WHERE NOT regexp_full_match(p_name, '.* widget') AND NOT regexp_full_match(p_name, 'red .*')")
def q_glob_exclude(s, d):
    p = table(s, d, "part").select("p_name").distinct()
    return p.where(~F.rlike("p_name", F.lit(X.glob_regex("* widget"))) & ~F.rlike("p_name", F.lit(X.glob_regex("red *"))))


@contract("SELECT c_custkey, string_agg(p, ',' ORDER BY k) AS priorities FROM (SELECT o_custkey AS c_custkey, o_orderpriority AS p, min(o_orderkey) AS k FROM orders GROUP BY 1, 2) GROUP BY 1")
def q_nulls_first_accumulate(s, d):
    first = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("p")).agg(F.min("o_orderkey").alias("k"))
    rows = first.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("l"))
    return rows.select("c_custkey", F.array_join(F.transform("l", lambda x: x["p"]), ",").alias("priorities"))


@contract("""SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END, o_orderkey) rn FROM orders) WHERE rn = 1""")
def q_priority_pick(s, d):
    rank = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderpriority") == "1-URGENT", 1).otherwise(2)
    return table(s, d, "orders").groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct(rank, "o_orderkey")).alias("o_orderkey"))


@contract("""SELECT k, arg_min(source, ord) AS source FROM (SELECT DISTINCT model_name || '|' || trim(field_name) AS k, 'field' AS source, 0 AS ord FROM model_fields WHERE required
UNION ALL SELECT DISTINCT f.model_name || '|' || trim(f.field_name), 'all', 1 FROM model_fields f) WHERE k IS NOT NULL GROUP BY k""")
def q_access_union(s, d):
    f = table(s, d, "model_fields").select(F.concat("model_name", F.lit("|"), F.trim("field_name")).alias("k"), "required").where("k is not null")
    return upsert.union_precedence([f.where("required").select("k").distinct().withColumn("source", F.lit("field")), f.select("k").distinct().withColumn("source", F.lit("all"))], ["k"])


# ---- scalar functions and extraction patterns


@contract("SELECT menu_id, g FROM (SELECT menu_id, trim(unnest(string_split(groups, ','))) AS g FROM menu_records) WHERE g <> ''")
def q_split_explode(s, d):
    return table(s, d, "menu_records").select("menu_id", F.explode(X.split_trim(F.col("groups"))).alias("g"))


@contract("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS total FROM events GROUP BY 1")
def q_json_props(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.sum(F.from_json("props", "k bigint")["k"]).alias("total"))


@contract("SELECT method_id, CASE WHEN calls_models IS NULL OR NOT json_valid(calls_models) THEN 0 ELSE coalesce(json_array_length(calls_models), 0) END::BIGINT AS n FROM model_methods")
def q_json_default(s, d):
    size = F.size(F.coalesce(F.from_json("calls_models", "array<string>"), F.array().cast("array<string>")))
    return table(s, d, "model_methods").select("method_id", size.cast("long").alias("n"))


@contract(r"""SELECT DISTINCT q, regexp_extract(q, '"([^"]*)"', 1) AS v FROM (SELECT unnest(regexp_extract_all(content, '"[^"\n]*"')) AS q FROM source_files WHERE path LIKE '%.xml')""")
def q_unquote(s, d):
    quoted = table(s, d, "source_files").where("path like '%.xml'").select(F.explode(F.regexp_extract_all("content", F.lit(r'"[^"\n]*"'), F.lit(0))).alias("q")).distinct()
    return quoted.select("q", X.unquote(F.col("q")).alias("v"))


@contract("SELECT field_type, count(*) FILTER (WHERE CASE WHEN compute IS NULL THEN true WHEN lower(trim(compute)) IN ('false', '0') THEN false ELSE true END) AS n FROM model_fields GROUP BY 1")
def q_bool_kwarg(s, d):
    return table(s, d, "model_fields").groupBy("field_type").agg(F.count_if(X.truth(F.col("compute"), True)).alias("n"))


@contract(r"""SELECT doc_id, string_agg(m, ' ' ORDER BY p) AS names FROM (SELECT doc_id, m, min(p) AS p FROM
(SELECT doc_id, unnest(ms) AS m, unnest(range(len(ms))) AS p FROM (SELECT doc_id, regexp_extract_all(text, '\w+_(?:count|rate)\b') AS ms FROM documents)) GROUP BY 1, 2) GROUP BY 1""")
def q_regex_all_distinct(s, d):
    hits = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\w+_(?:count|rate)\b"), F.lit(0)))
    return table(s, d, "documents").select("doc_id", hits.alias("h")).where(F.size("h") > 0).select("doc_id", F.array_join("h", " ").alias("names"))


@contract("SELECT file_id FROM source_files WHERE regexp_matches(content, 'raise\\s+(?:UserError|ValidationError)\\b')")
def q_regex_flag(s, d):
    return table(s, d, "source_files").where(F.rlike("content", F.lit(r"raise\s+(?:UserError|ValidationError)\b"))).select("file_id")


IMPORTS = [r"(?m)^from\s+([\w.]+)\s+import\b", r"(?m)^import\s+([\w.]+)", r"(?m)^\s+(?:from|import)\s+([\w.]+)"]


@contract(
    "SELECT module, count(*) AS n FROM ("
    + " UNION ALL ".join(f"SELECT unnest(regexp_extract_all(content, '{p}', 1)) AS module FROM source_files WHERE path LIKE '%.py'" for p in IMPORTS)
    + ") GROUP BY 1"
)
def q_regex_multi_concat(s, d):
    """Modules that Python files import, by several patterns over each text."""
    hits = F.concat(*(F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in IMPORTS))
    return table(s, d, "source_files").where("path like '%.py'").select(F.explode(hits).alias("module")).groupBy("module").agg(n())


@contract(r"""SELECT m, count(*) AS n, count(DISTINCT file_id) AS files FROM (SELECT file_id, unnest(regexp_extract_all(content, 'orm\.call\(\s*"([^"]+)"', 1)) AS m FROM source_files WHERE path LIKE '%.js') GROUP BY 1""")
def q_js_orm_calls(s, d):
    hits = table(s, d, "source_files").where("path like '%.js'").select("file_id", F.explode(F.regexp_extract_all("content", F.lit(r'orm\.call\(\s*"([^"]+)"'), F.lit(1))).alias("m"))
    return hits.groupBy("m").agg(n(), F.count_distinct("file_id").alias("files"))


@contract(r"""SELECT category, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, 'registry\.category\("([^"]+)"\)\.add\("[^"]+"', 1)) AS category FROM source_files WHERE path LIKE '%.js') GROUP BY 1""")
def q_js_registry(s, d):
    hits = table(s, d, "source_files").where("path like '%.js'").select(F.explode(F.regexp_extract_all("content", F.lit(r'registry\.category\("([^"]+)"\)\.add\("[^"]+"'), F.lit(1))).alias("category"))
    return hits.groupBy("category").agg(n())


@contract(r"""SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '<(field|button|xpath|record|template|menuitem)\b', 1)) AS tag FROM source_files WHERE path LIKE '%.xml') GROUP BY 1""")
def q_html_elements(s, d):
    tags = F.regexp_extract_all("content", F.lit(r"<(field|button|xpath|record|template|menuitem)\b"), F.lit(1))
    return table(s, d, "source_files").where("path like '%.xml'").select(F.explode(tags).alias("tag")).groupBy("tag").agg(n())


@contract(r"""SELECT file_id, p::INT AS pos, m AS name FROM (SELECT file_id, unnest(ms) AS m, unnest(range(1, len(ms) + 1)) AS p FROM (SELECT file_id, list_distinct_ordered AS ms FROM
(SELECT file_id, list_filter(ms, lambda x, i: list_position(ms, x) = i) AS list_distinct_ordered FROM (SELECT file_id, regexp_extract_all(content, '<field name="(\w+)"', 1) AS ms FROM source_files WHERE path LIKE '%.xml'))))""")
def q_html_links(s, d):
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(r'<field name="(\w+)"'), F.lit(1)))
    rows = table(s, d, "source_files").where("path like '%.xml'").select("file_id", F.posexplode(names).alias("p", "name"))
    return rows.select("file_id", (F.col("p") + 1).alias("pos"), "name")


@contract("SELECT view_id, CASE WHEN contains(trim(xml_id), '.') THEN trim(xml_id) ELSE module_name || '.' || trim(xml_id) END AS x FROM view_records WHERE trim(xml_id) <> ''")
def q_qualify_id(s, d):
    return table(s, d, "view_records").where("trim(xml_id) <> ''").select("view_id", X.qualify(F.trim("xml_id"), F.col("module_name")).alias("x"))


@contract(r"""SELECT DISTINCT i, replace(substr(i, 7), '_', '.') AS model FROM (SELECT unnest(regexp_extract_all(content, '\bmodel_[a-z0-9_]+')) AS i FROM source_files WHERE path LIKE '%.csv') WHERE starts_with(i, 'model_')""")
def q_model_id_norm(s, d):
    ids = table(s, d, "source_files").where("path like '%.csv'").select(F.explode(F.regexp_extract_all("content", F.lit(r"\bmodel_[a-z0-9_]+"), F.lit(0))).alias("i")).distinct()
    return ids.where("i like 'model\\_%'").select("i", X.model_of_id(F.col("i")).alias("model"))


@contract(r"SELECT module_id, regexp_replace(regexp_replace(trim(lower(summary)), '[^a-z0-9_\s-]', '', 'g'), '[\s_]+', '-', 'g') AS slug FROM addon_modules WHERE summary IS NOT NULL")
def q_slug(s, d):
    return table(s, d, "addon_modules").where("summary is not null").select("module_id", X.slug(F.col("summary")).alias("slug"))


@contract("SELECT file_id, len(string_split(path, '/'))::BIGINT AS depth, split_part(path, '/', 5) AS module FROM source_files")
def q_path_params(s, d):
    return table(s, d, "source_files").select("file_id", F.size(F.split("path", "/")).cast("long").alias("depth"), F.split_part("path", F.lit("/"), F.lit(5)).alias("module"))


# ---- state machines


@contract("SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS states, sum(c)::BIGINT AS n FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2) GROUP BY 1")
def q_state_machine(s, d):
    counts = table(s, d, "events").groupBy("user_id", "event_type").agg(n("c"))
    return counts.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("states"), F.sum("c").alias("n"))


@contract("""SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS states FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1""")
def q_state_merge(s, d):
    """The machines of events of high value and of all others, merged."""

    def machine(where: str, name: str) -> DataFrame:
        return table(s, d, "events").where(where).groupBy("user_id").agg(F.collect_set("event_type").alias(name))

    empty = F.array().cast("array<string>")
    both = machine("(value > 20) is not true", "a").join(machine("value > 20", "b"), "user_id", "full_outer")
    return both.select("user_id", F.array_join(F.array_sort(F.array_union(F.coalesce("a", empty), F.coalesce("b", empty))), ",").alias("states"))


@contract("""SELECT m.model_name, m.method_name, min(r.ref_id) AS button FROM (SELECT DISTINCT model_name, method_name FROM model_methods) m
LEFT JOIN (SELECT ref_id, button_name FROM view_element_refs WHERE element_type = 'button') r ON r.button_name = m.method_name GROUP BY 1, 2""")
def q_state_buttons(s, d):
    buttons = table(s, d, "view_element_refs").where("element_type = 'button'").groupBy(F.col("button_name").alias("method_name")).agg(F.min("ref_id").alias("button"))
    return table(s, d, "model_methods").select("model_name", "method_name").distinct().join(buttons, "method_name", "left").select("model_name", "method_name", "button")


@contract("""WITH e AS (SELECT user_id, event_type AS dst, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS src FROM events)
SELECT 'stateDiagram-v2' || chr(10) || string_agg('    ' || coalesce(src, '[*]') || ' --> ' || dst, chr(10) ORDER BY coalesce(src, '[*]'), dst) AS diagram FROM (SELECT DISTINCT src, dst FROM e)""")
def q_mermaid_state(s, d):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = table(s, d, "events").select(F.coalesce(before, F.lit("[*]")).alias("src"), F.col("event_type").alias("dst")).distinct()
    lines = F.transform(F.array_sort(F.collect_list(F.struct("src", "dst"))), lambda x: F.concat(F.lit("    "), x["src"], F.lit(" --> "), x["dst"]))
    return pairs.agg(F.concat(F.lit("stateDiagram-v2\n"), F.array_join(lines, "\n")).alias("diagram"))


# ---- paths and graphs


FK_SQL = """fk AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT 'n' || n_nationkey, 's' || s_suppkey FROM nation JOIN supplier ON s_nationkey = n_nationkey
UNION ALL SELECT 'n' || n_nationkey, 'c' || c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey)"""


def fk_edges(s: SparkSession, d: str) -> DataFrame:
    """Row-level foreign-key edges."""

    def key(letter: str, c: str):
        return F.concat(F.lit(letter), F.col(c).cast("string"))

    nation, supplier, customer = (table(s, d, t) for t in ("nation", "supplier", "customer"))
    regions = nation.join(table(s, d, "region").select(F.col("r_regionkey").alias("n_regionkey")), "n_regionkey").select(key("r", "n_regionkey").alias("src"), key("n", "n_nationkey").alias("dst"))
    nations = nation.select("n_nationkey")
    sup = supplier.join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(key("n", "n_nationkey").alias("src"), key("s", "s_suppkey").alias("dst"))
    cus = customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(key("n", "n_nationkey").alias("src"), key("c", "c_custkey").alias("dst"))
    return regions.unionAll(sup).unionAll(cus)


@contract(f"WITH RECURSIVE {FK_SQL}, b(node, depth) AS (SELECT 'r0', 0 UNION SELECT dst, depth + 1 FROM b JOIN fk ON src = node WHERE depth < 2) SELECT node, min(depth)::INT AS depth FROM b GROUP BY 1")
def q_bfs_relations(s, d):
    return graph.bfs(fk_edges(s, d), s.createDataFrame([("r0",)], "start string"), 2).select("node", "depth")


@contract(f"WITH RECURSIVE {FK_SQL}, e AS (SELECT src, dst FROM fk UNION SELECT dst, src FROM fk), b(node, depth) AS (SELECT 's3', 0 UNION SELECT dst, depth + 1 FROM b JOIN e ON src = node WHERE depth < 3) SELECT node, min(depth)::INT AS depth FROM b GROUP BY 1")
def q_bfs_both_dirs(s, d):
    return graph.bfs(graph.both_ways(fk_edges(s, d)), s.createDataFrame([("s3",)], "start string"), 3).select("node", "depth")


DEPS_SQL = """deps AS (SELECT DISTINCT trim(name) AS src, trim(u) AS dst FROM (SELECT name, unnest(depends) AS u FROM addon_modules) WHERE trim(u) <> '')"""


def module_deps(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "addon_modules").select(F.trim("name").alias("src"), F.explode("depends").alias("u")).select("src", F.trim("u").alias("dst"))
    return rows.where("dst <> ''").distinct()


@contract(f"""WITH RECURSIVE {DEPS_SQL}, s0 AS (SELECT min(src) AS node FROM deps), b(node, depth) AS (SELECT node, 0 FROM s0 UNION SELECT dst, depth + 1 FROM b JOIN deps ON src = node WHERE depth < 3)
SELECT b.node, min(depth)::INT AS depth, max(m.version) AS version FROM b LEFT JOIN (SELECT trim(name) AS node, max(version) AS version FROM addon_modules GROUP BY 1) m ON m.node = b.node GROUP BY 1""")
def q_module_deps(s, d):
    deps = module_deps(s, d)
    reached = graph.bfs(deps, deps.agg(F.min("src").alias("start")), 3).select("node", "depth")
    meta = table(s, d, "addon_modules").groupBy(F.trim("name").alias("node")).agg(F.max("version").alias("version"))
    return reached.join(meta, "node", "left")


@contract(f"""WITH RECURSIVE {FK_SQL}, b(node, depth) AS (SELECT 'r1', 0 UNION SELECT dst, depth + 1 FROM b JOIN fk ON src = node WHERE depth < 2), v AS (SELECT node, min(depth) AS depth FROM b GROUP BY 1)
SELECT node, depth::INT AS depth, spent::BIGINT AS spent FROM (SELECT *, sum(15) OVER (ORDER BY depth, node ROWS UNBOUNDED PRECEDING) AS spent FROM v) WHERE spent <= 3000""")
def q_budget_bfs(s, d):
    visited = graph.bfs(fk_edges(s, d), s.createDataFrame([("r1",)], "start string"), 2).select("node", "depth", F.lit(15).alias("cost"))
    return graph.budgeted(visited, ["depth", "node"], "cost", 3000).select("node", "depth", "spent")


@contract(f"WITH {FK_SQL} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM fk UNION ALL SELECT dst FROM fk) GROUP BY 1 ORDER BY degree DESC, node LIMIT 1")
def q_degree_hint(s, d):
    return graph.degrees(fk_edges(s, d)).orderBy(F.desc("degree"), "node").limit(1)


MEMBERS_SQL = "mem AS (SELECT DISTINCT lower(trim(model_name)) AS model, lower(trim(method_name)) AS member FROM model_methods)"


def model_members(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "model_methods").select(F.lower(F.trim("model_name")).alias("model"), F.lower(F.trim("method_name")).alias("member")).distinct()


def inherited_members(s: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    """Members of a model's ancestors that it does not have itself."""
    up = graph.closure(edges).where("start <> node").select(F.col("start").alias("model"), F.col("node").alias("inherited_from"))
    members = model_members(s, d)
    rows = up.join(members.withColumnRenamed("model", "inherited_from"), "inherited_from").select("model", "member", "inherited_from").distinct()
    return rows.join(members, ["model", "member"], "left_anti")


def overridden_members(s: SparkSession, d: str, edges: DataFrame) -> DataFrame:
    """A model's members that ancestors have too, with the number of those ancestors."""
    up = graph.closure(edges).where("start <> node").select(F.col("start").alias("model"), F.col("node").alias("anc"))
    members = model_members(s, d)
    theirs = members.withColumnRenamed("model", "anc")
    return members.join(up, "model").join(theirs, ["anc", "member"]).groupBy("model", "member").agg(F.count_distinct("anc").alias("overrides"))


INHERIT_SQL = """inh AS (SELECT DISTINCT src, dst FROM (SELECT trim(name) AS src, unnest(regexp_extract_all(inherit_model, '[\\w.]+')) AS dst FROM addon_models) WHERE src <> dst)"""


def inheritance(s: SparkSession, d: str) -> DataFrame:
    """Child-parent edges over models, self-links dropped, from every name the fields hold."""
    rows = table(s, d, "addon_models").select(F.trim("name").alias("src"), F.explode(packed_values(F.col("inherit_model"))).alias("dst"))
    return rows.where(F.col("src") != F.col("dst")).distinct()


@contract(f"""WITH RECURSIVE {INHERIT_SQL}, {MEMBERS_SQL}, up(src, anc) AS (SELECT src, dst FROM inh UNION SELECT up.src, inh.dst FROM up JOIN inh ON inh.src = up.anc)
SELECT DISTINCT up.src AS model, mem.member, up.anc AS inherited_from FROM up JOIN mem ON mem.model = up.anc WHERE up.src <> up.anc AND NOT EXISTS (SELECT 1 FROM mem o WHERE o.model = up.src AND o.member = mem.member)""")
def q_closure_members(s, d):
    return inherited_members(s, d, inheritance(s, d))


@contract(f"""WITH RECURSIVE {INHERIT_SQL}, {MEMBERS_SQL}, up(src, anc) AS (SELECT src, dst FROM inh UNION SELECT up.src, inh.dst FROM up JOIN inh ON inh.src = up.anc)
SELECT o.model, o.member, count(DISTINCT up.anc) AS overrides FROM mem o JOIN up ON up.src = o.model JOIN mem a ON a.model = up.anc AND a.member = o.member WHERE up.src <> up.anc GROUP BY 1, 2""")
def q_override_detect(s, d):
    return overridden_members(s, d, inheritance(s, d))


RELATED_SQL = """WITH RECURSIVE f AS (SELECT model_name AS model, field_name AS field, nullif(arg_max(coalesce(comodel_name, ''), field_id), '') AS comodel, arg_max(coalesce(field_type, ''), field_id) AS ft FROM model_fields GROUP BY 1, 2),
p AS (SELECT field_id AS path_id, model_name AS model, related AS path, string_split(related, '.') AS parts FROM model_fields WHERE regexp_full_match(related, '\\w+(\\.\\w+)+') AND model_name IS NOT NULL),
w(path_id, path, parts, k, cur, tm, tf, tt, broken) AS (SELECT path_id, path, parts, 0, model, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM p
UNION ALL SELECT path_id, path, parts, k + 1, comodel, CASE WHEN k + 1 = len(parts) THEN f.model END, CASE WHEN k + 1 = len(parts) THEN f.field END, CASE WHEN k + 1 = len(parts) THEN ft END,
  CASE WHEN f.field IS NULL THEN cur || '.' || parts[k + 1] WHEN k + 1 < len(parts) AND comodel IS NULL THEN cur || '.' || parts[k + 1] || ' (no comodel)' END
  FROM w LEFT JOIN f ON f.model = w.cur AND f.field = w.parts[w.k + 1] WHERE broken IS NULL AND k < len(parts)),
l AS (SELECT * FROM w WHERE broken IS NOT NULL OR k = len(parts))
"""


def related_paths(s: SparkSession, d: str) -> DataFrame:
    m = table(s, d, "model_fields")
    empty = F.lit("")
    f = m.select(F.col("model_name").alias("model"), F.col("field_name").alias("field"), F.coalesce("comodel_name", empty).alias("c"), F.coalesce("field_type", empty).alias("t"), "field_id")
    f = f.groupBy("model", "field").agg(F.max_by("c", "field_id").alias("c"), F.max_by("t", "field_id").alias("field_type")).select("model", "field", F.nullif("c", empty).alias("comodel"), "field_type")
    rows = m.where(F.rlike("related", F.lit(r"^\w+(\.\w+)+$"))).select(F.col("field_id").alias("path_id"), F.col("model_name").alias("model"), F.col("related").alias("path")).where("model is not null")
    return paths.resolve_dotted(rows, f).drop("model")


@contract(RELATED_SQL + "SELECT path_id, path, tm AS terminal_model, tf AS terminal_field, tt AS terminal_type, tf IS NOT NULL AS fully_resolved, broken AS broken_at FROM l")
def q_path_resolve(s, d):
    return related_paths(s, d)


@contract(RELATED_SQL + "SELECT broken AS broken_at, count(*) AS n FROM l WHERE broken IS NOT NULL GROUP BY 1")
def q_path_broken(s, d):
    """Where related paths end in a field that is missing or leads nowhere."""
    return related_paths(s, d).where("broken_at is not null").groupBy("broken_at").agg(n())


@contract(f"""WITH {FK_SQL}, t AS (SELECT 'm:' || src AS src, 'm:' || dst AS dst, 'field_rel' AS type FROM fk UNION SELECT 'mod:' || src, 'mod:' || dst, 'depends' FROM ({DEPS_SQL.split(' AS ', 1)[1].strip()[1:-1]})) SELECT src, dst, type FROM t""")
def q_graph_edges(s, d):
    def typed(edges: DataFrame, prefix: str, kind: str) -> DataFrame:
        return edges.select(F.concat(F.lit(prefix), "src").alias("src"), F.concat(F.lit(prefix), "dst").alias("dst"), F.lit(kind).alias("type"))

    return typed(fk_edges(s, d), "m:", "field_rel").unionAll(typed(module_deps(s, d), "mod:", "depends")).distinct()


@contract("""SELECT 'erDiagram' || chr(10) || string_agg('    ' || replace(r_name, ' ', '_') || ' ||--o{ ' || n_name || ' : has', chr(10) ORDER BY r_name, n_name) AS diagram FROM region JOIN nation ON n_regionkey = r_regionkey""")
def q_mermaid_er(s, d):
    rows = table(s, d, "region").join(table(s, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("r_name", "n_name"))), lambda x: F.concat(F.lit("    "), X.mermaid_id(x["r_name"]), F.lit(" ||--o{ "), X.mermaid_id(x["n_name"]), F.lit(" : has")))
    return rows.agg(F.concat(F.lit("erDiagram\n"), F.array_join(lines, "\n")).alias("diagram"))


# ---- rules and tools over the domain tables


@contract("""SELECT model, n AS score, CASE WHEN n >= 8 THEN 'HIGH' WHEN n >= 3 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM (SELECT model, sum(w)::BIGINT AS n FROM (
SELECT model_name AS model, count(*) AS w FROM model_fields WHERE compute IS NOT NULL AND trim(compute) <> '' GROUP BY 1 UNION ALL SELECT model, count(*) FROM view_records GROUP BY 1
UNION ALL SELECT model_name, 3 FROM model_methods WHERE state_transitions LIKE '%"state"%' GROUP BY 1) WHERE model IS NOT NULL GROUP BY 1)""")
def q_impact_score(s, d):
    computed = table(s, d, "model_fields").where("trim(compute) <> ''").groupBy(F.col("model_name").alias("model")).agg(n("w"))
    views = table(s, d, "view_records").groupBy("model").agg(n("w"))
    machines = table(s, d, "model_methods").where("state_transitions like '%\"state\"%'").select(F.col("model_name").alias("model")).distinct().withColumn("w", F.lit(3).cast("long"))
    rows = computed.unionAll(views).unionAll(machines).where("model is not null").groupBy("model").agg(F.sum("w").alias("score"))
    return rows.withColumn("risk", F.when(F.col("score") >= 8, "HIGH").when(F.col("score") >= 3, "MEDIUM").otherwise("LOW"))


@contract("""SELECT method_id, 'validation' AS kind FROM model_methods WHERE raises_validation = 1 UNION ALL SELECT method_id, 'constrains' FROM model_methods WHERE decorator_types LIKE '%constrains%'
UNION ALL SELECT method_id, 'onchange' FROM model_methods WHERE decorator_types LIKE '%onchange%'""")
def q_constraints_union(s, d):
    m = table(s, d, "model_methods").select("method_id", "raises_validation", "decorator_types")
    kinds = F.array_compact(F.array(F.when(F.col("raises_validation") == 1, "validation"), F.when(F.contains("decorator_types", F.lit("constrains")), "constrains"), F.when(F.contains("decorator_types", F.lit("onchange")), "onchange")))
    return m.select("method_id", F.explode(kinds).alias("kind"))


@contract("""SELECT f.field_id, coalesce(f.related, f.compute, 'plain') AS shape, m.method_id FROM model_fields f LEFT JOIN (SELECT model_name, method_name, min(method_id) AS method_id FROM model_methods GROUP BY 1, 2) m
ON m.model_name = f.model_name AND m.method_name = f.compute""")
def q_compute_chain(s, d):
    m = table(s, d, "model_methods").groupBy("model_name", F.col("method_name").alias("compute")).agg(F.min("method_id").alias("method_id"))
    return table(s, d, "model_fields").join(m, ["model_name", "compute"], "left").select("field_id", F.coalesce("related", "compute", F.lit("plain")).alias("shape"), "method_id")


@contract("""SELECT root, model, via, rn::INT AS rn FROM (SELECT c_mktsegment AS root, 'o' || o_orderkey AS model, o_orderstatus AS via, row_number() OVER (PARTITION BY c_mktsegment ORDER BY (o_orderstatus = 'F') DESC, o_orderkey) rn
FROM customer JOIN orders ON o_custkey = c_custkey) WHERE rn <= 25""")
def q_business_flow(s, d):
    rows = table(s, d, "customer").join(table(s, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    w = Window.partitionBy("c_mktsegment").orderBy(F.desc(F.col("o_orderstatus") == "F"), "o_orderkey")
    top = rows.withColumn("rn", F.row_number().over(w)).where("rn <= 25")
    return top.select(F.col("c_mktsegment").alias("root"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("model"), F.col("o_orderstatus").alias("via"), "rn")


@contract("""SELECT r.ref_id, CASE r.button_type WHEN 'object' THEN coalesce(CAST(m.method_id AS VARCHAR), 'unresolved') WHEN 'action' THEN 'action:' || r.button_name ELSE 'none' END AS target FROM view_element_refs r
LEFT JOIN (SELECT method_name, min(method_id) AS method_id FROM model_methods GROUP BY 1) m ON m.method_name = r.button_name WHERE r.element_type = 'button'""")
def q_button_dispatch(s, d):
    m = table(s, d, "model_methods").groupBy(F.col("method_name").alias("button_name")).agg(F.min("method_id").alias("method_id"))
    rows = table(s, d, "view_element_refs").where("element_type = 'button'").select("ref_id", "button_type", "button_name").join(m, "button_name", "left")
    target = F.when(F.col("button_type") == "object", F.coalesce(F.col("method_id").cast("string"), F.lit("unresolved"))).when(F.col("button_type") == "action", F.concat(F.lit("action:"), "button_name")).otherwise("none")
    return rows.select("ref_id", target.alias("target"))


@contract("""SELECT field_id, field_name || ': ' || field_type || CASE WHEN trim(comodel_name) <> '' THEN '(' || comodel_name || ')' ELSE '' END
|| CASE WHEN required OR readonly OR trim(compute) <> '' THEN ' [' || concat_ws(', ', CASE WHEN required THEN 'required' END, CASE WHEN trim(compute) <> '' THEN 'compute' || CASE WHEN store THEN '[stored]' ELSE '' END END, CASE WHEN readonly THEN 'readonly' END) || ']' ELSE '' END AS line
FROM model_fields WHERE field_type IS NOT NULL""")
def q_compact_field(s, d):
    f = table(s, d, "model_fields").where("field_type is not null")
    computed = F.trim("compute") != ""
    flags = F.concat_ws(", ", F.when(F.col("required"), "required"), F.when(computed, F.concat(F.lit("compute"), F.when(F.col("store"), "[stored]").otherwise(""))), F.when(F.col("readonly"), "readonly"))
    tail = F.when(flags != "", F.concat(F.lit(" ["), flags, F.lit("]"))).otherwise("")
    return f.select("field_id", F.concat("field_name", F.lit(": "), "field_type", F.when(F.trim("comodel_name") != "", F.concat(F.lit("("), "comodel_name", F.lit(")"))).otherwise(""), tail).alias("line"))


@contract("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN trim(coalesce(inherit_model, '')) = '' THEN 'primary' WHEN trim(inherit_model) = trim(name) THEN 'extension' WHEN regexp_full_match(trim(inherit_model), '[\\w.]+') THEN 'child' ELSE 'several' END AS kind FROM addon_models) GROUP BY 1""")
def q_inherit_classify(s, d):
    i = F.trim(F.coalesce("inherit_model", F.lit("")))
    kind = F.when(i == "", "primary").when(i == F.trim("name"), "extension").when(F.rlike(i, F.lit(r"^[\w.]+$")), "child").otherwise("several")
    return table(s, d, "addon_models").groupBy(kind.alias("kind")).agg(n())


@contract("SELECT field_id, total FROM (SELECT field_id, count(*) OVER () AS total FROM model_fields WHERE required ORDER BY field_id LIMIT 200)")
def q_trunc_limit(s, d):
    rows = table(s, d, "model_fields").where("required").select("field_id")
    return rows.orderBy("field_id").limit(200).withColumn("total", F.lit(rows.count()))


# ---- full-text search


DOC_SQL = r"t AS (SELECT doc_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ts FROM documents))"


@contract(f"WITH {DOC_SQL} SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM t GROUP BY 1")
def q_fts_tokens(s, d):
    return fts.postings(table(s, d, "documents"), "doc_id", ["text"]).groupBy("term").agg(n("tf"), F.count_distinct("doc_id").alias("df"))


def _rank_sql(hits: str) -> str:
    return f"""WITH {DOC_SQL}, dl AS (SELECT doc_id, count(*) AS dl FROM t GROUP BY 1), st AS (SELECT count(*) AS nd, avg(dl) AS av FROM dl), h AS ({hits}), df AS (SELECT count(*) AS df FROM h)
SELECT doc_id, round(greatest(ln((nd - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av)), 6) AS score FROM h JOIN dl USING (doc_id), st, df ORDER BY round(score, 9) DESC, doc_id LIMIT 20"""


@contract(_rank_sql("SELECT doc_id, count(*) AS tf FROM t WHERE starts_with(term, 'invo') GROUP BY 1"))
def q_fts_prefix(s, d):
    return fts.search(table(s, d, "documents"), "doc_id", ["text"], "invo", stemmed=False).withColumn("score", F.round("score", 6))


@contract(f"WITH {DOC_SQL} SELECT DISTINCT a.doc_id FROM t a JOIN t b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1 JOIN t c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2 WHERE a.term = 'please' AND b.term = 'check' AND c.term = 'whether'")
def q_fts_phrase(s, d):
    post = fts.postings(table(s, d, "documents"), "doc_id", ["text"])
    return fts.matches(post, "doc_id", fts.parse(fts.sanitize('"please check whether"')))


@contract(f"WITH {DOC_SQL} (SELECT doc_id FROM t WHERE term = 'invoice' INTERSECT SELECT doc_id FROM t WHERE term IN ('ledger', 'crew')) EXCEPT SELECT doc_id FROM t WHERE term = 'seal'")
def q_fts_boolean(s, d):
    post = fts.postings(table(s, d, "documents"), "doc_id", ["text"])
    return fts.matches(post, "doc_id", fts.parse("invoice AND (ledger OR crew) NOT seal"))


@contract(f"WITH {DOC_SQL} SELECT lang, count(DISTINCT doc_id) AS total FROM t JOIN documents USING (doc_id) WHERE term = 'invoice' AND doc_kind IN ('help', 'readme') GROUP BY 1")
def q_fts_filtered_total(s, d):
    docs = table(s, d, "documents").where("doc_kind in ('help', 'readme')")
    hits = fts.matches(fts.postings(docs, "doc_id", ["text"]), "doc_id", fts.parse("invoice"))
    return docs.join(hits, "doc_id", "left_semi").groupBy("lang").agg(F.count_distinct("doc_id").alias("total"))
