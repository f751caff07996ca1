"""Queries of the text operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm.labels import label_files
from tessel.llm.leakage import find_leaks
from tessel.llm.packing import certificates, pack, token_count
from tessel.llm.spans import classes, document_shares, document_spans, find_pairs, shared_spans
from tessel.llm.survivors import model_key, module_key, name_key, survivors
from tessel.llm.wellformed import check_files, failure_rates
from tessel.session import cut, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return check_files(table(spark, d, "source_files")).where("not well_formed").select("file_id")


def p1_rates(spark: SparkSession, d: str) -> DataFrame:
    return failure_rates(check_files(table(spark, d, "source_files")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return label_files(table(spark, d, "source_files")).where("label <> 'hand'").select("file_id")


def p3_labels(spark: SparkSession, d: str) -> DataFrame:
    return label_files(table(spark, d, "source_files")).groupBy("label").agg(F.count("*").alias("n_files"))


METHODS = ("calls_models", "state_transitions")
FIELDS = ("string_label", "help_text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, key: str, member: str, columns: tuple[str, ...]) -> DataFrame:
        parts = [model_key(F.col("model_name")), name_key(F.col(member)), module_key(F.col("module_name"), F.col("file_path"))]
        return survivors(table(spark, d, name), key, parts, columns, "indexed_at", name)

    rows = of("model_methods", "method_id", "method_name", METHODS).unionByName(of("model_fields", "field_id", "field_name", FIELDS))
    return rows.where("row_id is not null")


def p5_untimed(spark: SparkSession, d: str) -> DataFrame:
    """Currency reasoning put to the test: per field, the groups whose surviving value is the true latest one.

    Each group's latest row loses its timestamp, so only the learnt precedence can tell that it is
    the latest; the true timestamps stay beside it to judge by.  ``n_related`` counts the groups
    where the survivor is not just the last row that kept its timestamp.
    """

    def of(name: str, key: str, member: str, columns: tuple[str, ...]) -> DataFrame:
        parts = [model_key(F.col("model_name")), name_key(F.col(member)), module_key(F.col("module_name"), F.col("file_path"))]
        rows = table(spark, d, name)
        last = rows.groupBy(*(p.alias(f"k{i}") for i, p in enumerate(parts))).agg(F.max_by(key, F.struct("indexed_at", -F.col(key))).alias(key)).select(key, F.lit(True).alias("last"))
        blank = rows.join(last, key, "left").withColumn("known_at", F.when(F.col("last").isNull(), F.col("indexed_at")))
        true = survivors(rows, key, parts, columns, "indexed_at", name).withColumnRenamed("row_id", "true_id")
        found = survivors(blank, key, parts, columns, "known_at", name)
        kept = survivors(blank.where("known_at is not null"), key, parts, columns, "known_at", name).select("column_name", F.col("row_id").alias("r"), F.lit(True).alias("kept"))
        long = rows.select(F.col(key).alias("r"), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.md5(c).alias("v")) for c in columns))).alias("x")).select("r", "x.*")
        both = true.join(found, ["table_name", "group_id", "column_name"]).where("true_id is not null")
        both = both.join(long.select("column_name", F.col("r").alias("true_id"), F.col("v").alias("true_v")), ["column_name", "true_id"]).join(long.select("column_name", F.col("r").alias("row_id"), "v"), ["column_name", "row_id"])
        both = both.join(kept.withColumnRenamed("r", "row_id"), ["column_name", "row_id"], "left")
        return both.groupBy("table_name", "column_name").agg(F.count("*").alias("n_groups"), F.count_if(F.col("v") == F.col("true_v")).alias("n_right"), F.count_if(F.col("kept").isNull()).alias("n_related"))

    return of("model_methods", "method_id", "method_name", METHODS).unionByName(of("model_fields", "field_id", "field_name", FIELDS))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """The surviving method or field of each group, put together field by field, with the names the group agrees on."""

    def of(name: str, key: str, member: str, columns: tuple[str, ...]) -> DataFrame:
        rows = table(spark, d, name)
        parts = [model_key(F.col("model_name")), name_key(F.col(member)), module_key(F.col("module_name"), F.col("file_path"))]
        found = survivors(rows, key, parts, columns, "indexed_at", name)
        wide = found.groupBy("group_id").agg(*(F.max(F.when(F.col("column_name") == c, F.col("row_id"))).alias(f"from_{c}") for c in columns))
        for c in columns:
            wide = wide.join(rows.select(F.col(key).alias(f"from_{c}"), F.col(c)), f"from_{c}", "left")
        names = rows.select(F.col(key).alias("group_id"), *(k.alias(n) for k, n in zip(parts, ("model", "member", "module"))))
        texts = (F.col(c) if c in columns else F.lit(None).cast("string").alias(c) for c in METHODS + FIELDS)
        return wide.join(names, "group_id").select(F.lit(name).alias("table_name"), "group_id", "model", "member", "module", *texts)

    return of("model_methods", "method_id", "method_name", METHODS).unionByName(of("model_fields", "field_id", "field_name", FIELDS))


def packed(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), token_count(F.col("text")).alias("n_tokens")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return packed(spark, d).where("n_pieces > 1").select("doc_id").distinct()


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packed(spark, d).groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("size").alias("used"))


def p8_certificates(spark: SparkSession, d: str) -> DataFrame:
    """Containers, their lower bound and the gap between, for each partition of the packing."""
    return certificates(packed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_near(spark: SparkSession, d: str) -> DataFrame:
    """Passages of 13 words with up to two words changed, left out or put in."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), max_edits=2, walks=8, samples=6)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return find_pairs(table(spark, d, "documents"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """How much of each document's text is found in other documents, its class of equal texts and how many these are."""
    documents = table(spark, d, "documents")
    members = cut(classes(documents))
    return document_shares(documents, members, shared_spans(documents, members))


def p10_spans(spark: SparkSession, d: str) -> DataFrame:
    """The stretches of each document's text that other documents hold, with the smallest other class that holds them."""
    documents = table(spark, d, "documents")
    members = cut(classes(documents))
    return document_spans(members, shared_spans(documents, members))


QUERIES = {f.__name__: f for f in (p1_found, p1_rates, p3_found, p3_labels, p5_found, p5_records, p5_untimed, p8_found, p8_containers, p8_certificates, p9_found, p9_near, p10_found, p10_shares, p10_spans)}

KEYS = """
  replace(lower(trim(model_name)), '_', '.') AS k1, lower(trim({member})) AS k2,
  coalesce(nullif(lower(trim(module_name)), ''), nullif(lower(trim(regexp_extract(file_path, '^/srv/+[^/]+/+[^/]+/+([^/]+)/', 1))), '')) AS k3
"""


def _survivors_sql(name: str, key: str, member: str, columns: tuple[str, ...]) -> str:
    keys = KEYS.format(member=member)
    parts = [
        f"""SELECT '{name}' AS table_name, g.group_id, '{c}' AS column_name, arg_max(t.{key}, (t.indexed_at, -t.{key})) AS row_id
        FROM (SELECT *, {keys} FROM {name}) t JOIN
          (SELECT k1, k2, k3, min({key}) AS group_id FROM (SELECT {key}, {keys} FROM {name}) GROUP BY 1, 2, 3 HAVING count(*) > 1 AND k1 IS NOT NULL AND k2 IS NOT NULL AND k3 IS NOT NULL) g
          USING (k1, k2, k3)
        WHERE t.{c} IS NOT NULL AND NOT regexp_full_match(t.{c}, '\\s*|\\s*\\[\\s*\\]\\s*') GROUP BY g.group_id"""
        for c in columns
    ]
    return "\nUNION ALL\n".join(parts)


#: Windows of 300 characters of the representatives, and of each one that others hold too: the smallest other class, for the smallest itself the largest.
SPANS_SQL = """WITH c AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS class_id, count(*) OVER (PARTITION BY text) AS n_copies, length(text) AS n_chars FROM documents WHERE text IS NOT NULL),
g AS (SELECT doc_id, p, md5(substr(text, p + 1, 300)) AS h FROM (SELECT doc_id, text, unnest(range(0, length(text) - 299)) AS p FROM c WHERE doc_id = class_id)),
e AS (SELECT h, min((doc_id, p)) AS a, max((doc_id, -p)) AS b FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
s AS (SELECT g.doc_id, g.p, CASE WHEN g.doc_id = a[1] THEN b[1] ELSE a[1] END AS other, CASE WHEN g.doc_id = a[1] THEN -b[2] ELSE a[2] END - g.p AS shift FROM g JOIN e USING (h)),
r AS (SELECT doc_id, other, min(p) AS s, max(p) + 300 AS e FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, other, shift ORDER BY p) AS run FROM s) GROUP BY doc_id, other, shift, run)
"""

ORACLES = {
    "p10_shares": SPANS_SQL + """, k AS (SELECT doc_id AS class_id, sum(greatest(e - greatest(s, coalesce(before, 0)), 0))::BIGINT AS shared FROM
(SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) GROUP BY 1),
m AS (SELECT c.doc_id, c.class_id, n_chars::INT AS n_chars, CASE WHEN n_copies > 1 AND n_chars >= 300 THEN n_chars ELSE coalesce(shared, 0) END AS shared_chars, n_copies FROM c LEFT JOIN k USING (class_id))
SELECT doc_id, class_id, n_chars, shared_chars, CASE WHEN n_chars > 0 THEN round(shared_chars / n_chars, 6) ELSE 0 END AS share, n_copies FROM m
UNION ALL SELECT doc_id, doc_id, 0, 0, 0, 1 FROM documents WHERE text IS NULL""",
    "p10_spans": SPANS_SQL + """SELECT c.doc_id, c.class_id, x.other AS other_class_id, x.s::INT AS start, x.e::INT AS "end" FROM c JOIN
(SELECT doc_id AS class_id, other, s, e FROM r UNION ALL SELECT DISTINCT class_id, class_id, 0, n_chars FROM c WHERE n_copies > 1 AND n_chars >= 300) x USING (class_id)""",
    "p10_found": """WITH g AS (SELECT DISTINCT doc_id, md5(substr(text, p, 300)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS p FROM documents))
SELECT DISTINCT a.doc_id AS doc_id_1, b.doc_id AS doc_id_2 FROM g a JOIN g b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p5_found": _survivors_sql("model_methods", "method_id", "method_name", METHODS) + "\nUNION ALL\n" + _survivors_sql("model_fields", "field_id", "field_name", FIELDS),
    "p8_found": r"SELECT doc_id FROM documents WHERE len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}\x0b]+')) > 1024",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dg AS (SELECT doc_id, array_to_string(w[p : p + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
ig AS (SELECT item_id, array_to_string(w[p : p + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS p FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
