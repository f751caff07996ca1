"""Every core query with SQL against DuckDB, and unit tests of the functions behind them."""

import math
import os
import random

import duckdb
import pytest

from tessel.functions import text as X
from tessel.functions.stem import stem
from tessel.operators import fts, graph, paths
from tessel.plans import contract, core_problems

SQL = contract.ORACLES | core_problems.ORACLES
FUNCTIONS = contract.QUERIES | core_problems.QUERIES


def norm(v):
    return ("nan" if math.isnan(v) else f"{v:.6g}") if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, duck, small, name):
    df = FUNCTIONS[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(SQL[name])
    named = [d[0] for d in result.description]
    assert sorted(named) == columns
    assert got == sorted(tuple(norm(r[named.index(c)]) for c in columns) for r in result.fetchall())


def test_entry_contract():
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and {f"p{i}_found" for i in (2, 4, 6, 7)} <= set(queries)


def test_bfs_against_python(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)]
    seen, front = {"n0": 0}, ["n0"]
    for level in range(1, 5):
        front = [b for x in front for a, b in edges if a == x and b not in seen and not seen.update({b: level})]
    df = spark.createDataFrame(edges, "src string, dst string")
    got = {r.node: r.depth for r in graph.bfs(df, spark.createDataFrame([("n0",)], "start string"), 4).collect()}
    assert got == seen
    nodes, kept = graph.relations(df, "n0", 1)
    assert [r.node for r in nodes.collect()] == ["n0"] and all(r.src == "n0" for r in kept.collect())


def test_members_through_packed_parents(spark, tmp_path):
    models = [("child", '"mid.one", mid.two'), ("mid.one", "['root.a']"), ("mid.two", "root.b\nroot.c")]
    spark.createDataFrame(models, "name string, inherit_model string").write.parquet(f"{tmp_path}/addon_models.parquet")
    methods = [("root.a", "f"), ("root.b", "g"), ("Root.C ", "h"), ("child", "g")]
    spark.createDataFrame(methods, "model_name string, method_name string").write.parquet(f"{tmp_path}/model_methods.parquet")
    got = {(r.model, r.member, r.inherited_from) for r in contract.q_closure_members(spark, str(tmp_path)).collect()}
    assert got == {("child", "f", "root.a"), ("child", "h", "root.c"), ("mid.one", "f", "root.a"), ("mid.two", "g", "root.b"), ("mid.two", "h", "root.c")}
    assert [tuple(r) for r in contract.q_override_detect(spark, str(tmp_path)).select("model", "member", "overrides").collect()] == [("child", "g", 1)]


def test_whole_tables_take_part(spark, tmp_path):
    def write(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")

    write("customer", [(3, 1.0, "A"), (6, 2.0, "B")], "c_custkey long, c_acctbal double, c_mktsegment string")
    write("orders", [(3, 9.0)], "o_custkey long, o_totalprice double")
    assert {tuple(r) for r in contract.q_merge_partial(spark, str(tmp_path)).select("k", "amount", "segment", "orders").collect()} == {(3, 9.0, "A", 1), (6, 2.0, "B", None)}
    write("events", [(1, 1, "low", 5.0), (2, 1, "high", 30.0), (3, 2, "none", None)], "event_id long, user_id long, event_type string, value double")
    assert {tuple(r) for r in contract.q_state_merge(spark, str(tmp_path)).select("user_id", "states").collect()} == {(1, "high,low"), (2, "none")}
    scans = [(1, "p", "a", "/a", "x", 1), (2, "p", None, "/b", "x", 1), (3, "p", "a", "/a", "y", 5), (4, "p", "c", "/c", "z", 6), (5, "q", "a", "/a", "x", 1)]
    write("module_scans", scans, "scan_id long, project_name string, module_name string, path string, module_hash string, arrived_at long")
    write("index_results", [("p", 2, 3), ("p", 7, None), ("q", 9, None)], "project_name string, cutoff_at long, finished_at long")
    assert {tuple(r) for r in contract.q_change_set(spark, str(tmp_path)).select("module", "state").collect()} == {("p:a", "changed"), ("p:/b", "unchanged"), ("p:c", "new"), ("q:a", "new")}


def test_dotted_paths_of_any_length(spark):
    fields = [("lineitem", "order", "orders", "many2one"), ("lineitem", "qty", None, "float"), ("orders", "customer", "customer", "many2one"), ("customer", "nation", "nation", "many2one"), ("nation", "name", None, "char")]
    fields += [(f"m{i}", "next", f"m{i + 1}", "many2one") for i in range(9)] + [("m9", "end", None, "char")]
    rows = [("order.customer.nation.name",), ("order.customer",), ("order.gone.nation",), ("qty.nation",), ("order.customer.nation",), (None,)]
    df = spark.createDataFrame([(i, "lineitem", *r) for i, r in enumerate(rows)] + [(9, "m0", "next." * 9 + "end"), (10, "m0", "next." * 8 + "gone.x")], "path_id int, model string, path string")
    got = {r.path_id: (r.terminal_model, r.terminal_field, r.fully_resolved, r.broken_at) for r in paths.resolve_dotted(df, spark.createDataFrame(fields, "model string, field string, comodel string, field_type string")).collect()}
    assert got == {
        0: ("nation", "name", True, None), 1: ("orders", "customer", True, None), 2: (None, None, False, "orders.gone"), 3: (None, None, False, "lineitem.qty (no comodel)"), 4: ("customer", "nation", True, None), 5: (None, None, False, None),
        9: ("m9", "end", True, None), 10: (None, None, False, "m8.gone"),
    }


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(40)], "src string, dst string")
    assert graph.closure(edges).where("start = 'n0'").count() == 40


def test_longest_prefix(spark):
    items = spark.createDataFrame([("/a/b/c",), ("/a/bb",), ("/x",), (None,)], "p string")
    roots = spark.createDataFrame([("/a",), ("/a/b",)], "r string")
    assert {(x.p, x.r) for x in paths.longest_prefix(items, "p", roots, "r").collect()} == {("/a/b/c", "/a/b"), ("/a/bb", "/a"), ("/x", None), (None, None)}


def test_text_functions(spark):
    def one(value, f):
        return spark.createDataFrame([(value,)], "c string").select(f(contract.F.col("c"))).first()[0]

    assert [one(v, X.unquote) for v in ("'a'", 'r"b"', '"""c\nd"""', "x", "'a'b'", None)] == ["a", "b", "c\nd", None, None, None]
    assert [one(v, lambda c: X.truth(c, False)) for v in (None, "True", "0", "False", "x")] == [False, True, False, False, True]
    assert [one(v, X.model_of_id) for v in ("model_sale_order", "base.model_a_b", "sale.order")] == ["sale.order", "a.b", "sale.order"]
    assert one(" a, ,b ", X.split_trim) == ["a", "b"] and one("Hello  World!", X.slug) == "hello-world"


def test_stemmer():
    words = {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "falling": "fall", "happy": "happi", "generalization": "gener", "sky": "sky", "agreed": "agre", "controlled": "control", "adjustment": "adjust"}
    assert {w: stem(w) for w in words} == words


def test_search_against_scan(spark):
    docs = [(1, "red apple pie"), (2, "apple red"), (3, "Pie, pie! apples"), (4, ""), (5, None)]
    df = spark.createDataFrame(docs, "id int, t string")
    post = fts.postings(df, "id", ["t"]).cache()

    def hits(query):
        return {r.id for r in fts.matches(post, "id", fts.parse(fts.sanitize(query))).collect()}

    assert hits("appl") == {1, 2, 3} and hits("apple pie") == {1} and hits("red NOT pie") == {2}
    assert hits("pie OR red") == {1, 2, 3} and hits("(pie OR red) apple") == {1, 2}
    assert [r.id for r in fts.search(df, "id", ["t"], "pie", stemmed=True).collect()] == [3, 1]
    marked = spark.createDataFrame([(1, "Équipe Über naïve"), (2, "equipe")], "id int, t string")
    folded = fts.postings(marked, "id", ["t"], fold=True)
    assert {r.id for r in fts.matches(folded, "id", fts.parse(fts.unmarked("équipe"))).collect()} == {1, 2} and fts.unmarked("Über ß") == "Uber ß"
    with pytest.raises(ValueError):
        fts.parse("(a")
