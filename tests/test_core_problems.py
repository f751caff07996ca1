"""Nesting, packed fields, hierarchies and increments against brute force and edge cases."""

import ast
import json
import posixpath
import random
import re

import pytest

from tessel.functions.packed import packed_values
from tessel.operators.hierarchy import contract_hierarchy, descendants
from tessel.operators.incremental import HashState, changed, deleted, normal_path, process_changed, scan_changes
from tessel.operators.nesting import ShapeAutomaton, flatten_nested, flatten_payload, parse_json, variant_tables
from tessel.operators.packed import explode_packed
from tessel.plans import core_problems as q
from tessel.session import table


# ---- nesting


def brute_elements(payload):
    try:
        root = json.loads(payload)
    except ValueError:
        return
    while "views" not in root:
        root = next(v for v in root.values() if isinstance(v, dict))
    views = root["views"] if isinstance(root["views"], list) else [root["views"]]
    for view_no, view in enumerate(views, 1):
        arch = view.get("arch")
        arch = json.loads(arch) if isinstance(arch, str) else arch
        if arch is None:
            continue
        out = []

        def walk(e, parent, depth):
            out.append((parent, depth))
            me = len(out)
            for k in ("children", "elements", "nodes"):
                kids = e.get(k) or []
                for c in [kids] if isinstance(kids, dict) else kids:
                    walk(c, me, depth + 1)

        walk(arch, 0, 0)
        for i, (parent, depth) in enumerate(out, 1):
            yield view_no, i, parent, depth


def test_nesting_equals_brute_force(spark, medium):
    dumps = table(spark, medium, "view_dumps")
    want = {(r.dump_id, *x) for r in dumps.collect() for x in brute_elements(r.payload)}
    rows = [tuple(r) for r in q.p2_found(spark, medium).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_nesting_edges(spark):
    deep = '{"views":{"arch":' + '{"tag":"group","children":[' * 30000 + '{"tag":"x"}' + "]}" * 30000 + "}}"
    rows = [(1, None), (2, ""), (3, '{"views": [NaN]}'), (4, deep), (5, '{"views": [{"xml_id": "a"}, {"arch": "{\\"tag\\": \\"form\\", \\"nodes\\": null}"}]}'), (5, '{"views": []}'), (6, "{")]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "dump_id long, payload string, variant string, depth int")
    out = flatten_nested(df).select("dump_id", "view_no", "elem_no", "depth").collect()
    assert max(r.depth for r in out if r.dump_id == 4) == 30000
    assert [tuple(r) for r in out if r.dump_id == 5] == [(5, 2, 1, 0)]
    assert {r.dump_id for r in out} == {4, 5}
    assert flatten_nested(df.limit(0)).count() == 0


def test_parser_agrees_with_json():
    good = ['{"a":[1,2.5e3,true,null,"x\\u00e9\\n"]}', "[]", "{}", ' "s" ', "-0", "[[],{}]"]
    bad = ["", "{", "[1,]", '{"a" 1}', "[1 2]", "01", "{a:1}", "[1]]", '"\n"', "nul"]
    from tessel.operators.nesting import _Parser

    for text in good:
        assert _Parser().parse(text) == json.loads(text) == parse_json(text)
    for text in bad:
        for parse in (_Parser().parse, parse_json):
            with pytest.raises(ValueError):
                parse(text)


def test_variant_tables_keep_links(spark, small):
    rows = flatten_nested(table(spark, small, "view_dumps")).cache()
    tables = variant_tables(rows)
    assert sum(tables[v].count() for v in ("field", "button", "xpath", "container")) == rows.count()
    keys = {tuple(r) for r in rows.select("dump_id", "view_no", "elem_no").collect()}
    assert all((r.dump_id, r.view_no, r.parent_no) in keys or r.parent_no == 0 for r in tables["field"].collect())
    assert [x[3] for x in flatten_payload('{"a":{"views":{"arch":{"nodes":{"tag":"b"}}}}}', ShapeAutomaton())] == [0, 1]


# ---- packed fields


def brute_split(text):
    t = (text or "").strip()
    if not t:
        return []
    if t[0] + t[-1] in ("[]", "()"):
        try:
            return [v for x in (ast.literal_eval(t) if t[0] == "[" else list(ast.literal_eval(t if t.endswith(",)") else t[:-1] + ",)"))) if (v := x.strip())]
        except (ValueError, SyntaxError):
            t = t[1:-1]
    out, field, i = [], "", 0
    while i < len(t):
        c = t[i]
        if c in "\"'" and not field.strip():
            j, val = i + 1, ""
            while j < len(t):
                if t[j] == "\\":
                    val += t[j + 1]
                    j += 2
                elif t[j] == c and t[j + 1 : j + 2] == c:
                    val += c
                    j += 2
                elif t[j] == c:
                    break
                else:
                    val += t[j]
                    j += 1
            out.append((val, True))
            field, i = "", j + 1
        elif c in ",;|\n\t\r":
            out.append((field, False))
            field, i = "", i + 1
        else:
            field += c
            i += 1
    out.append((field, False))
    vals = []
    for v, quoted in out:
        v = v.strip()
        parts = v.split()
        vals += parts if not quoted and len(parts) > 1 and all(re.fullmatch(r"!?\w+(\.\w+)+", p) for p in parts) else [v] if v else []
    return vals


def test_packed_equals_brute_force(spark, medium):
    want = set()
    for name, key, cols in (("addon_models", "model_id", ["inherit_model"]), ("menu_records", "menu_id", ["groups"]), ("view_element_refs", "ref_id", ["button_groups", "groups_attr"])):
        for r in table(spark, medium, name).select(key, *cols).collect():
            for c in cols:
                vals = brute_split(r[c])
                if len(vals) > 1:
                    want |= {(name, r[key], c, i, v) for i, v in enumerate(vals, 1)}
    rows = [tuple(r) for r in q.p4_found(spark, medium).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


PACKED = [
    ('"Crew ""North"" / Lead";a.b', ['Crew "North" / Lead', "a.b"]),
    ("['it\\'s; a, b', 'c.d']", ["it's; a, b", "c.d"]),
    ("O'Brien / User, 'x.y'", ["O'Brien / User", "x.y"]),
    ("a.b  c.d", ["a.b", "c.d"]),
    ("Sales / User", ["Sales / User"]),
    (" , ;|\n", []),
    ("", []),
    (None, []),
    ("[]", []),
    ('""', []),
    ("a.b,a.b", ["a.b", "a.b"]),
    ("0, x", ["0", "x"]),
    ('"a.b" "c.d"', ["a.b", "c.d"]),
    (",".join(f'"v{i}.x""y"' for i in range(3000)), [f'v{i}.x"y' for i in range(3000)]),
    ('"' + '""' * 50000 + '"', ['"' * 50000]),
    (" ".join(f"m.n{i}" for i in range(50000)), [f"m.n{i}" for i in range(50000)]),
]


def test_packed_edges(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(PACKED)], "id int, t string")
    got = {r.id: r.v for r in df.select("id", packed_values(df.t).alias("v")).collect()}
    for i, (_, want) in enumerate(PACKED):
        assert got[i] == want, PACKED[i][0][:60] if PACKED[i][0] else i


def test_packed_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a.b,c.d", "k", 3, "q")], "`id` long, `groups` string, val string, pos int, row_id string")
    assert [tuple(r) for r in explode_packed(df, "id", ["groups"], "t").collect()] == [("t", 1, "groups", 1, "a.b"), ("t", 1, "groups", 2, "c.d")]
    assert explode_packed(df.limit(0), "id", ["groups"], "t").count() == 0


# ---- hierarchies


def brute_hierarchy(nodes, links):
    nodes = set(nodes)
    up = {n: {p for c, p in links if c == n and p in nodes} for n in nodes}
    out = set()
    for n in nodes:
        dist, front = {n: 0}, [n]
        while front:
            nxt = []
            for x in front:
                for p in up[x]:
                    if p not in dist:
                        dist[p] = dist[x] + 1
                        nxt.append(p)
            front = nxt
        out |= {(n, r, k) for r, k in dist.items() if not up[r]}

        def cyclic(x):
            seen, stack = set(), list(up[x])
            while stack:
                y = stack.pop()
                if y == x:
                    return True
                if y not in seen:
                    seen.add(y)
                    stack += up[y]
            return False

        if any(cyclic(x) for x in dist):
            out.add((n, "", -1))
    return out


def graph(spark, nodes, links):
    return spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(links, "child string, parent string")


def test_leaf_below_chains_and_other_parents(spark):
    """A leaf whose links end in chains of different length is settled by all of them at once."""
    nodes = ["r", "leaf"] + [f"{x}{i}" for x in "abcdef" for i in range(4)]
    links = [(f"{x}{i}", f"{x}{i - 1}" if i else "r") for x in "abcdef" for i in range(4)] + [("leaf", f"{x}{i % 4}") for i, x in enumerate("abcdef")]
    rows = [(r.node, r.root, r.depth) for r in contract_hierarchy(*graph(spark, nodes, links)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_hierarchy(nodes, links)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_hierarchy_random(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(60)]
    links = [(nodes[rng.randrange(60)], nodes[rng.randrange(62) % 60]) for _ in range(45)] + [(nodes[i], nodes[i - 1]) for i in range(30, 50)]
    rows = [(r.node, r.root, r.depth) for r in contract_hierarchy(*graph(spark, nodes, links)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute_hierarchy(nodes, links)


def test_hierarchy_edges(spark):
    nodes = ["a", "b", "c", "d", "loop", "below", None, "x", "y", "z", "far"]
    links = [("b", "a"), ("b", "a"), ("c", "b"), ("c", "a"), ("d", "gone"), ("loop", "loop"), ("below", "loop"), ("below", "a"), (None, "a"), ("x", "y"), ("y", "z"), ("z", "x"), ("x", "a"), ("far", "x")]
    links = [x for x in links if x[0]]
    rows = {(r.node, r.root, r.depth): r.path for r in contract_hierarchy(*graph(spark, nodes, links), with_paths=True).collect()}
    assert set(rows) == brute_hierarchy([n for n in nodes if n], links)
    assert rows["c", "a", 1] == ["a", "c"] and rows["y", "a", 3] == ["a", "x", "z", "y"]
    assert contract_hierarchy(*graph(spark, nodes[:0], links[:1])).count() == 0


def test_long_chain_and_hot_parent(spark):
    nodes = [f"c{i}" for i in range(200)] + [f"leaf{i}" for i in range(100)]
    links = [(f"c{i + 1}", f"c{i}") for i in range(199)] + [(f"leaf{i}", "c199") for i in range(100)]
    paths = contract_hierarchy(*graph(spark, nodes, links), with_paths=True).collect()
    assert {(r.node, r.depth) for r in paths} == {(f"c{i}", i) for i in range(200)} | {(f"leaf{i}", 200) for i in range(100)}
    assert all(len(r.path) == r.depth + 1 for r in paths)


def test_found_hierarchies_equal_brute_force(spark, small):
    nodes, links = q.hierarchy_graph(spark, small)
    pairs = [(r.child, r.parent) for r in links.distinct().collect()]
    want = brute_hierarchy([r.node for r in nodes.distinct().collect()], pairs)
    split = {(*n.split("\x01"), r.split("\x01")[-1], k) for n, r, k in want}
    assert {tuple(r) for r in q.p6_found(spark, small).collect()} == split


def test_descendants_of_compressed_chains(spark):
    links = [(f"c{i + 1}", f"c{i}") for i in range(60)] + [("c60", "c0"), ("c40", "m"), ("m", "c0"), ("s", "c60"), ("t", "s"), ("loop", "t"), ("loop", "loop")]
    nodes = sorted({n for x in links for n in x})
    want = set()
    for n in nodes:
        dist, front = {n: 0}, [n]
        while front:
            front = [c for f in front for c, p in links if p == f and c not in dist and not dist.update({c: dist[f] + 1})]
        want |= {(n, c, k) for c, k in dist.items() if k}
    rows = [tuple(r) for r in descendants(*graph(spark, nodes, links)).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_descendants(spark):
    links = [("b", "a"), ("c", "b"), ("d", "b"), ("d", "x"), ("x", "a"), ("x", "y"), ("p", "q"), ("q", "p"), ("r", "p"), ("p", "a")]
    nodes = sorted({n for x in links for n in x})
    want = set()
    for n in nodes:
        dist, front = {n: 0}, [n]
        while front:
            front = [c for f in front for c, p in links if p == f and c not in dist and not dist.update({c: dist[f] + 1})]
        want |= {(n, c, k) for c, k in dist.items() if k}
    assert {tuple(r) for r in descendants(*graph(spark, nodes, links)).collect()} == want


# ---- increments


def test_normal_path(spark):
    paths = ["/a//b/./c/", "/a/b/../c", "/../x", "a/../../b", "/", "", ".", "/a/b/.."]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(normal_path(q.F.col("p"))).collect()]
    assert got == ["/a/b/c", "/a/c", "/x", "b", "/", "", "", "/a"]


def test_found_scans_equal_brute_force(spark, medium):
    scans = table(spark, medium, "module_scans").collect()
    projects = {r.name: r.addons_hash for r in table(spark, medium, "index_projects").collect()}
    marks = {}
    for r in table(spark, medium, "index_results").collect():
        if r.finished_at and (r.status or "").strip().lower() in ("ok", "done") and r.addons_hash and projects.get(r.project_name) == r.addons_hash:
            marks[r.project_name] = max(marks.get(r.project_name, r.cutoff_at), r.cutoff_at)
    now, known = {}, {}
    for r in sorted(scans, key=lambda r: (r.scanned_at, -r.scan_id)):
        key = (r.project_name, posixpath.normpath(re.sub("/+", "/", r.path)))
        now[key] = (r.module_hash, r.scan_id)
        if key[0] in marks and r.arrived_at <= marks[key[0]]:
            known[key] = r.module_hash
    want = {i for k, (h, i) in now.items() if k not in known or known[k] != h}
    rows = [r.scan_id for r in q.p7_found(spark, medium).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_state_survives_failure_and_swaps(spark, tmp_path):
    state = HashState(spark, f"file://{tmp_path}/state")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, content_hash string, extra int")
    assert state.read() is None
    one = rows(("a", "1", 0), ("b", "2", 0), (None, None, 0))
    assert changed(one, state.read(), ["k"]).count() == 3
    state.commit(one)
    two = rows(("a", "1", 0), ("b", "3", 0), ("c", "4", 0), (None, None, 0))
    want = {"b", "c"}
    assert {r.k for r in changed(two, state.read(), ["k"]).collect()} == want
    with pytest.raises(Exception):
        state.commit(two.selectExpr("k", "assert_true(false) as content_hash"))
    assert {r.k for r in changed(two, state.read(), ["k"]).collect()} == want
    state.commit(two)
    assert changed(two, state.read(), ["k"]).count() == 0
    assert [r.k for r in deleted(one.where("k = 'a'"), state.read(), ["k"]).orderBy("k").collect()] == [None, "b", "c"]


def test_runs_neither_skip_nor_repeat(spark, tmp_path):
    """Three runs, the second of which fails in its work and then again while it writes: every change is handled once."""
    state = HashState(spark, f"file://{tmp_path}/state")
    rows = lambda *x: spark.createDataFrame(list(x), "k string, content_hash string")
    handled = lambda df: {(r.k, r.content_hash) for r in df.collect()}
    assert handled(process_changed(rows(("a", "1"), ("b", "2")), state, ["k"], lambda x: x)) == {("a", "1"), ("b", "2")}
    two, version = rows(("a", "1"), ("b", "3"), ("c", "4")), state.version()

    def fails(_):
        raise RuntimeError("lost")

    for work in (fails, lambda x: x.selectExpr("k", "assert_true(k = 'none') as content_hash")):
        with pytest.raises(Exception):
            process_changed(two, state, ["k"], work)
        assert state.version() == version and handled(state.read("result")) == {("a", "1"), ("b", "2")}
    assert handled(process_changed(two, state, ["k"], lambda x: x)) == {("b", "3"), ("c", "4")}
    assert handled(process_changed(rows(("a", "5"), ("b", "3"), ("c", "4")), state, ["k"], lambda x: x)) == {("a", "5")}
    assert sum(p.name.startswith("v-") for p in (tmp_path / "state").iterdir()) == 2


def test_scan_changes_from_run_to_run(spark, tmp_path):
    scans = [(1, "p", "/a", "x", 1, 1), (2, "p", "/b", "x", 1, 1), (3, "q", "/a", "x", 1, 1)]
    more = [(4, "p", "/a", "y", 5, 5), (5, "q", "/c", "z", 6, 6)]
    schema = "scan_id long, project_name string, path string, module_hash string, scanned_at long, arrived_at long"
    projects = spark.createDataFrame([("p", "h"), ("q", "h")], "name string, addons_hash string")
    run = lambda *x: spark.createDataFrame([(p, "h", s, c, f) for p, s, c, f in x], "project_name string, addons_hash string, status string, cutoff_at long, finished_at long")
    folder = f"file://{tmp_path}/state"

    def pending(rows, runs):
        args = (spark.createDataFrame(rows, schema), run(*runs), projects)
        got = {r.scan_id for r in scan_changes(*args, folder=folder).collect()}
        assert got == {r.scan_id for r in scan_changes(*args).collect()}
        return got

    none = [("p", "failed", 0, 1)]
    assert pending(scans, none) == {1, 2, 3}
    assert pending(scans, [("p", " OK", 2, 3), ("q", "done", 2, None)]) == {3}
    first = HashState(spark, folder).version()
    assert pending(scans + more, [("p", " OK", 2, 3), ("q", "failed", 9, 9)]) == {3, 4, 5} and HashState(spark, folder).version() == first
    assert pending(scans + more, [("p", " OK", 2, 3), ("q", "done", 7, 9)]) == {4}
    assert pending(scans + more, [("p", "ok", 8, 9), ("q", "done", 7, 9)]) == set()


def test_scan_changes_empty(spark, small):
    t = [table(spark, small, n) for n in ("module_scans", "index_results", "index_projects")]
    assert scan_changes(t[0].limit(0), t[1], t[2]).count() == 0
    assert scan_changes(t[0], t[1].limit(0), t[2]).count() > 0


