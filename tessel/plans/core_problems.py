"""Queries of the data-processing operators of the core: nesting, packed fields, hierarchies, increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.packed import packed_values
from tessel.operators.hierarchy import contract_hierarchy, descendants, qualified
from tessel.operators.incremental import scan_changes
from tessel.operators.nesting import flatten_nested, variant_tables
from tessel.operators.packed import explode_packed
from tessel.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten_nested(table(spark, d, "view_dumps"), full=False).select("dump_id", "view_no", "elem_no", "parent_no", "depth")


def _variant_query(variant: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return variant_tables(flatten_nested(table(spark, d, "view_dumps")))[variant]

    query.__name__ = f"p2_{variant}s" if variant != "views" else "p2_views"
    return query


VARIANT_QUERIES = [_variant_query(v) for v in ("field", "button", "xpath", "container", "views")]


def p2_variants(spark: SparkSession, d: str) -> DataFrame:
    """Elements and deepest level per variant and dump."""
    rows = flatten_nested(table(spark, d, "view_dumps"), full=False)
    return rows.groupBy("dump_id", "variant").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    models = explode_packed(table(spark, d, "addon_models"), "model_id", ["inherit_model"], "addon_models")
    menus = explode_packed(table(spark, d, "menu_records"), "menu_id", ["groups"], "menu_records")
    refs = explode_packed(table(spark, d, "view_element_refs"), "ref_id", ["button_groups", "groups_attr"], "view_element_refs")
    return models.unionByName(menus).unionByName(refs)


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Packed fields of all tables by the number of values they hold."""
    models = explode_packed(table(spark, d, "addon_models"), "model_id", ["inherit_model"], "addon_models", least=1)
    menus = explode_packed(table(spark, d, "menu_records"), "menu_id", ["groups"], "menu_records", least=1)
    refs = explode_packed(table(spark, d, "view_element_refs"), "ref_id", ["button_groups", "groups_attr"], "view_element_refs", least=1)
    sizes = models.unionByName(menus).unionByName(refs).groupBy("table_name", "column_name", "row_id").agg(F.count("*").alias("n_values"))
    return sizes.groupBy("table_name", "column_name", "n_values").agg(F.count("*").alias("n"))


SEP = "\x01"


def hierarchy_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of the four hierarchies, a node's key being its hierarchy and name."""
    core = table(spark, d, "core_registry").select(F.col("kind").alias("h"), F.trim("name").alias("node"), F.col("parents").alias("parents"))
    modules = table(spark, d, "addon_modules").select(F.lit("module").alias("h"), F.trim("name").alias("node"), F.col("depends").alias("parents"))
    models = table(spark, d, "addon_models").select(F.lit("model").alias("h"), F.trim("name").alias("node"), packed_values(F.col("inherit_model")).alias("parents"))
    menus = table(spark, d, "menu_records").select(F.lit("menu").alias("h"), qualified(F.col("xml_id"), F.col("module_name")).alias("node"), F.array(qualified(F.col("parent_xml_id"), F.col("module_name"))).alias("parents"))
    views = table(spark, d, "view_records").select(F.lit("view").alias("h"), qualified(F.col("xml_id"), F.col("module_name")).alias("node"), F.array(qualified(F.col("inherit_id"), F.col("module_name"))).alias("parents"))
    rows = core.unionByName(modules).unionByName(models).unionByName(menus).unionByName(views).where("node is not null and node <> ''")
    key = F.concat("h", F.lit(SEP), "node")
    nodes = rows.select(key.alias("node"))
    links = rows.select(key.alias("child"), F.explode("parents").alias("p"), "h").select("child", F.concat("h", F.lit(SEP), F.trim("p")).alias("parent"), "h")
    return nodes, links.where("parent is not null and not (h = 'model' and child = parent)").drop("h")


def _named(key: str) -> list:
    return [F.substring_index(key, SEP, 1).alias("hierarchy"), F.substring_index(key, SEP, -1).alias("node")]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    nodes, links = hierarchy_graph(spark, d)
    return contract_hierarchy(nodes, links).select(*_named("node"), F.substring_index("root", SEP, -1).alias("root"), F.col("depth").cast("int").alias("depth"))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """The shortest path from each root, as text."""
    nodes, links = hierarchy_graph(spark, d)
    rows = contract_hierarchy(nodes, links, with_paths=True).where("depth >= 0")
    names = F.transform("path", lambda x: F.substring_index(x, SEP, -1))
    return rows.select(*_named("node"), F.substring_index("root", SEP, -1).alias("root"), F.array_join(names, " > ").alias("path"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    rows = descendants(*hierarchy_graph(spark, d))
    return rows.select(*_named("node"), F.substring_index("descendant", SEP, -1).alias("descendant"), "depth")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return scan_changes(table(spark, d, "module_scans"), table(spark, d, "index_results"), table(spark, d, "index_projects")).select("scan_id").distinct()


def p7_pending(spark: SparkSession, d: str) -> DataFrame:
    """Paths each project's next run has to handle."""
    rows = scan_changes(table(spark, d, "module_scans"), table(spark, d, "index_results"), table(spark, d, "index_projects"))
    return rows.groupBy("project_name").agg(F.count("*").alias("n_paths"))


QUERIES = {f.__name__: f for f in (p2_found, *VARIANT_QUERIES, p2_variants, p4_found, p4_sizes, p6_found, p6_paths, p6_descendants, p7_found, p7_pending)}
UP = "regexp_replace({}, '/[^/]+/[.][.]/', '/')"
NORMAL = "'/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> '' AND x <> '.'), '/') || '/'"
for _ in range(4):
    NORMAL = UP.format(NORMAL)
CHANGES_SQL = f"""WITH m AS (SELECT r.project_name, max(cutoff_at) AS w FROM index_results r JOIN (SELECT DISTINCT name, addons_hash FROM index_projects) p ON p.name = r.project_name AND p.addons_hash = r.addons_hash
WHERE finished_at IS NOT NULL AND lower(trim(status)) IN ('ok', 'done') GROUP BY 1),
s AS (SELECT *, {NORMAL} AS np FROM module_scans WHERE project_name IS NOT NULL AND path IS NOT NULL),
now AS (SELECT project_name, np, arg_max(module_hash, (scanned_at, -scan_id)) AS h, arg_max(scan_id, (scanned_at, -scan_id)) AS scan_id FROM s GROUP BY 1, 2),
old AS (SELECT s.project_name, np, arg_max(module_hash, (scanned_at, -scan_id)) AS h FROM s JOIN m ON m.project_name = s.project_name WHERE arrived_at <= w GROUP BY 1, 2),
c AS (SELECT now.* FROM now LEFT JOIN old ON old.project_name = now.project_name AND old.np = now.np WHERE old.np IS NULL OR old.h IS DISTINCT FROM now.h)
"""
NESTED_SQL = """WITH RECURSIVE d AS (SELECT dump_id, coalesce(json_extract(payload, '$.views'), json_extract(payload, '$.export.data.views')) AS v FROM view_dumps WHERE json_valid(payload)),
l AS (SELECT dump_id, CASE WHEN json_type(v) = 'ARRAY' THEN CAST(v AS JSON[]) ELSE [v] END AS l FROM d WHERE v IS NOT NULL),
vs AS (SELECT dump_id, unnest(l) AS view, unnest(range(1, len(l) + 1)) AS view_no FROM l),
a AS (SELECT dump_id, view_no, CASE WHEN json_type(view, '$.arch') = 'VARCHAR' THEN TRY_CAST(json_extract_string(view, '$.arch') AS JSON) ELSE json_extract(view, '$.arch') END AS arch FROM vs),
t(dump_id, view_no, path, node) AS (SELECT dump_id, view_no, []::BIGINT[], arch FROM a WHERE json_type(arch) = 'OBJECT' UNION ALL
  SELECT dump_id, view_no, list_append(path, i), child FROM (SELECT dump_id, view_no, path, unnest(kids) AS child, unnest(range(len(kids))) AS i FROM
    (SELECT dump_id, view_no, path, CASE WHEN json_type(k) = 'ARRAY' THEN CAST(k AS JSON[]) WHEN json_type(k) = 'OBJECT' THEN [k] ELSE [] END AS kids FROM
      (SELECT dump_id, view_no, path, coalesce(json_extract(node, '$.children'), json_extract(node, '$.elements'), json_extract(node, '$.nodes')) AS k FROM t)))),
n AS (SELECT dump_id, view_no, path, row_number() OVER (PARTITION BY dump_id, view_no ORDER BY path) AS elem_no FROM t)
SELECT n.dump_id, n.view_no::INT AS view_no, n.elem_no::INT AS elem_no, coalesce(p.elem_no, 0)::INT AS parent_no, len(n.path)::INT AS depth
FROM n LEFT JOIN n p ON p.dump_id = n.dump_id AND p.view_no = n.view_no AND len(n.path) > 0 AND p.path = list_slice(n.path, 1, len(n.path) - 1)"""
QUALIFIED = "CASE WHEN trim({0}) = '' THEN NULL WHEN contains(trim({0}), '.') THEN trim({0}) ELSE trim(module_name) || '.' || trim({0}) END"
#: On cycles the SQL stops at ways of 64 links, far above the depth of any table; the operator has no such bound.
HIERARCHY_SQL = f"""WITH RECURSIVE r AS (SELECT kind AS h, trim(name) AS node, parents FROM core_registry UNION ALL SELECT 'module', trim(name), depends FROM addon_modules
UNION ALL SELECT 'model', trim(name), regexp_extract_all(inherit_model, '[\\w.]+') FROM addon_models
UNION ALL SELECT 'menu', {QUALIFIED.format("xml_id")}, [{QUALIFIED.format("parent_xml_id")}] FROM menu_records UNION ALL SELECT 'view', {QUALIFIED.format("xml_id")}, [{QUALIFIED.format("inherit_id")}] FROM view_records),
nodes AS (SELECT DISTINCT h, node FROM r WHERE node <> ''),
links AS (SELECT DISTINCT l.h, l.node AS child, l.p AS parent FROM (SELECT h, node, trim(unnest(parents)) AS p FROM r WHERE node <> '') l JOIN nodes n ON n.h = l.h AND n.node = l.p WHERE NOT (l.h = 'model' AND l.node = l.p)),
up(h, node, anc, depth) AS (SELECT h, node, node, 0 FROM nodes UNION SELECT up.h, up.node, links.parent, up.depth + 1 FROM up JOIN links ON links.h = up.h AND links.child = up.anc WHERE up.depth < 64),
cyclic AS (SELECT DISTINCT h, node FROM up WHERE node = anc AND depth > 0)
SELECT h AS hierarchy, node, anc AS root, min(depth)::INT AS depth FROM up WHERE NOT EXISTS (SELECT 1 FROM links WHERE links.h = up.h AND links.child = up.anc) GROUP BY 1, 2, 3
UNION ALL SELECT DISTINCT up.h, up.node, '', -1 FROM up JOIN cyclic c ON c.h = up.h AND c.node = up.anc"""
DOTTED_SQL = r"!?\w+(\.\w+)+"
VALUES_SQL = (
    r"""list_filter(flatten(list_transform(regexp_extract_all(inner_text, '"(?:[^"\\]|""|\\.)*"|''(?:[^''\\]|\\.)*''|[^,;|\s"''][^,;|\t\r\n]*'), lambda x: CASE
WHEN x[1] = '"' THEN [trim(replace(replace(substr(x, 2, length(x) - 2), chr(92) || '"', '"'), '""', '"'))] WHEN x[1] = chr(39) THEN [trim(replace(substr(x, 2, length(x) - 2), chr(92) || chr(39), chr(39)))]
WHEN regexp_full_match(trim(x), '"""
    + DOTTED_SQL + r"(\s+" + DOTTED_SQL
    + r""")*') THEN regexp_split_to_array(trim(x), '\s+') ELSE [trim(x)] END)), lambda v: v <> '')"""
)
PACKED = (("addon_models", "model_id", "inherit_model"), ("menu_records", "menu_id", "groups"), ("view_element_refs", "ref_id", "button_groups"), ("view_element_refs", "ref_id", "groups_attr"))
PACKED_SQL = (
    "WITH raw AS (" + " UNION ALL ".join(rf"SELECT '{t}' AS table_name, {k}::BIGINT AS row_id, '{c}' AS column_name, regexp_replace({c}, '^\s+|\s+$', '', 'g') AS t FROM {t}" for t, k, c in PACKED)
    + rf"""),
i AS (SELECT table_name, row_id, column_name, CASE WHEN regexp_full_match(t, '(?s)\[.*\]|\(.*\)') THEN substr(t, 2, length(t) - 2) ELSE t END AS inner_text FROM raw WHERE t IS NOT NULL),
v AS (SELECT table_name, row_id, column_name, {VALUES_SQL} AS vals FROM i)
"""
)
ORACLES = {
    "p4_found": PACKED_SQL + "SELECT table_name, row_id, column_name, unnest(range(1, len(vals) + 1))::INT AS pos, unnest(vals) AS val FROM v WHERE len(vals) > 1",
    "p4_sizes": PACKED_SQL + "SELECT table_name, column_name, len(vals)::BIGINT AS n_values, count(*) AS n FROM v WHERE len(vals) > 0 GROUP BY 1, 2, 3",
    "p2_variants": NESTED_SQL.replace("SELECT n.dump_id, n.view_no::INT", """, e AS (SELECT n.dump_id, len(n.path) AS depth, CASE WHEN json_extract_string(t.node, '$.tag') IN ('field', 'button', 'xpath') THEN json_extract_string(t.node, '$.tag')
WHEN json_extract_string(t.node, '$.tag') IS NULL AND json_exists(t.node, '$.expr') THEN 'xpath' ELSE 'container' END AS variant FROM n JOIN t USING (dump_id, view_no, path))
SELECT dump_id, variant, count(*) AS n, max(depth)::INT AS deepest FROM e GROUP BY 1, 2 --""").split("--")[0],
    "p6_found": HIERARCHY_SQL,
    "p6_paths": HIERARCHY_SQL.rsplit("SELECT h AS hierarchy", 1)[0] + """, ways(h, node, root, depth, path) AS (SELECT h, node, node, 0, [node] FROM nodes WHERE NOT EXISTS (SELECT 1 FROM links WHERE links.h = nodes.h AND links.child = nodes.node)
UNION SELECT w.h, l.child, w.root, w.depth + 1, list_append(w.path, l.child) FROM ways w JOIN links l ON l.h = w.h AND l.parent = w.node WHERE NOT list_contains(w.path, l.child))
SELECT h AS hierarchy, node, root, array_to_string(arg_min(path, (depth, path)), ' > ') AS path FROM ways GROUP BY 1, 2, 3""",
    "p6_descendants": HIERARCHY_SQL.rsplit("SELECT h AS hierarchy", 1)[0] + "SELECT h AS hierarchy, anc AS node, node AS descendant, min(depth)::INT AS depth FROM up WHERE node <> anc GROUP BY 1, 2, 3",
    "p2_found": NESTED_SQL,
    "p7_found": CHANGES_SQL + "SELECT DISTINCT scan_id FROM c",
    "p7_pending": CHANGES_SQL + "SELECT project_name, count(*) AS n_paths FROM c GROUP BY 1",
}
