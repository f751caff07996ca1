"""Sources, extraction, build and tools over a synthetic add-on tree."""

import json
import os

import pytest

from tessel.cli import main
from tessel.plans.build import Index, derive
from tessel.session import table
from tessel.sources.extract import facts, table_of
from tessel.sources.files import detect_version, excluded, find_config, from_table, load_config, resolve_roots, scan
from tessel.tools import graphs
from tessel.tools import queries as T
from tessel.tools.html import page
from tessel.tools.registry import Registry
from tests.fixtures.addons import write


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    return write(str(tmp_path_factory.mktemp("addons")))


@pytest.fixture(scope="module")
def kg(spark, tree, tmp_path_factory):
    index = Index(spark, f"file://{tmp_path_factory.mktemp('index')}")
    index.build(scan(spark, [tree, "/gone"], ["*/demo_*"]))
    tables = index.tables()
    return {k: v.cache() for k, v in tables.items()}


def test_scan(spark, tree):
    files = scan(spark, [tree], ["*/demo_*"])
    got = {(r.module, r.kind, r.rel) for r in files.collect()}
    assert {m for m, _, _ in got} == {"fx_base", "fx_ext", "fx_web", "fx_legacy"}
    assert ("fx_web", "js", "fx_web/static/src/w.js") in got and not any("skip" in r for _, _, r in got)
    assert detect_version(files) == "17.0"
    assert scan(spark, ["/gone"]).count() == 0
    assert excluded("x_demo", ["*_demo"]) and not excluded("demo_x", ["*_demo"])


def test_config(tmp_path):
    (tmp_path / ".tessel.toml").write_text('exclude = ["a*"]\n[project]\nname = "p"\naddons_paths = ["x"]\n')
    (tmp_path / "deep").mkdir()
    found = find_config(str(tmp_path / "deep"))
    assert load_config(found) == {"name": "p", "roots": [str(tmp_path / "x")], "exclude": ["a*"], "javascript": True}
    assert resolve_roots("a:b,c") == ["a", "b", "c"] and resolve_roots(start=str(tmp_path)) == [str(tmp_path / "x")]


def test_extraction(kg):
    models = {(r.name, r.inherit_type): r for r in kg["models"].collect()}
    assert models["fx.order", "primary"].inherits == ["fx.mixin"] and models["fx.order", "primary"].inherits_map == {"fx.partner": "partner_id"}
    assert ("fx.order", "extension") in models and models["fx.mixin", "primary"].abstract
    fields = {(r.model, r.name, r.module): r for r in kg["fields"].collect()}
    partner = fields["fx.order", "partner_id", "fx_base"]
    assert (partner.comodel, partner.label, partner.groups) == ("fx.partner", "Partner", "base.user, base.admin")
    assert fields["fx.partner", "country_id", "fx_base"].comodel == "fx.country"
    assert not fields["fx.order", "total", "fx_base"].store and fields["fx.order", "name", "fx_base"].required
    assert [x.key for x in fields["fx.order", "state", "fx_base"].selection] == ["draft", "done"]
    m = {(r.model, r.name, r.module): r for r in kg["methods"].collect()}
    total = m["fx.order", "_compute_total", "fx_base"]
    assert total.depends == ["line_ids.price", "partner_id"] and total.depends_context == ["lang"] and total.decorators == ["api.depends", "api.depends_context"]
    assert total.line < total.body_start <= total.body_end
    assert m["fx.order", "_onchange_partner", "fx_base"].calls_models == ["fx.partner", "fx.line"]
    assert m["fx.order", "_check_name", "fx_base"].raises_validation and m["fx.order", "run_job", "fx_base"].is_cron_target
    assert [(x.to_state, x.field) for x in m["fx.order", "action_done", "fx_base"].transitions] == [("done", "state"), ("done", "state"), ("closed", "status")]
    assert {(r.language) for r in kg["parse_errors"].collect()} == {"python", "xml"}


def test_broken_xml_keeps_whole_records():
    from tessel.sources.extract import file_rows

    text = '<odoo><data><menuitem id="a" name="A"/><record id="r" model="ir.rule"><field name="name">R</field></record><menuitem id="b" name="B"/><record id="s" model="ir.rule"><field name="na</data></odoo>'
    got = [(name, row.get("xml_id")) for name, row in file_rows("xml", "m", "m/x.xml", text)]
    assert got == [("menus", "m.a"), ("record_rules", "m.r"), ("menus", "m.b"), ("parse_errors", None)]
    assert [name for name, _ in file_rows("xml", "m", "m/x.xml", "")] == ["parse_errors"]


def test_calls_of_scripts():
    from tessel.sources.extract import js_rows

    text = """
    // orm.call("never.in", "comment")
    registry . category('systray').add("Clock", Clock, { sequence: 1 });
    const rows = await orm.searchRead('fx.order', [["a", "=", 1]]); orm.call("fx.order", "go"); orm.other("fx.order");
    fetch("https://no.route"); fetch('/web/image'); this._rpc({ params: { route: "/no" }, route: "/yes" });
    const s = "orm.call('in.string', 'x')";
    """
    got = [(r["kind"], r.get("widget") or r.get("model") or r.get("route"), r.get("method"), r["line"]) for _, r in js_rows(text)]
    assert got == [("systray_widget", "Clock", None, 3), ("orm_call", "fx.order", None, 4), ("orm_call", "fx.order", "go", 4), ("rpc", "/web/image", None, 5), ("legacy_rpc", "/yes", None, 5)]


def test_xml_csv_js(kg):
    views = {r.xml_id: r for r in kg["views"].collect()}
    assert views["fx_base.view_order_form"].view_type == "form" and views["fx_base.view_order_form"].field_names == ["name", "total"]
    assert views["fx_ext.view_order_inherit"].priority == 5 and views["fx_ext.view_order_inherit"].inherit_id == "fx_base.view_order_form"
    menu = {r.xml_id: r for r in kg["menus"].collect()}["fx_base.menu_order"]
    assert (menu.sequence, menu.action_model, menu.parent_name, menu.groups) == (10, "fx.order", "Root", ["base.user", "base.admin"])
    cron = kg["crons"].first()
    assert (cron.model, cron.interval_number, cron.interval_type) == ("fx.order", 2, "hours")
    assert kg["mail_templates"].first().refs == ["name"] and kg["record_rules"].first().groups == ["base.user"]
    acl = {r.xml_id: r for r in kg["access_rules"].collect()}
    assert acl["a1"].model == "fx.order" and acl["a1"].perm_read and not acl["a1"].perm_write and acl["a2"].model == "fx.line"
    q = kg["qweb_templates"].first()
    assert (q.kind, q.t_calls, q.t_fields, q.t_if_fields) == ("report", ["web.layout"], ["name"], ["state"])
    js = [(r.kind, r.line) for r in kg["js_components"].orderBy("line").collect()]
    assert js == [("action_handler", 1), ("odd_registration", 2), ("orm_call", 3), ("rpc", 4), ("legacy_rpc", 5)]
    routes = {r.pattern: r for r in kg["routes"].collect()}
    assert routes["/order/<int:order_id>/<string:token>"].params == ["order_id", "token"] and not routes["/order/<int:order_id>/<string:token>"].csrf
    assert routes["/a"].patterns == ["/a", "/b"] and routes["/a"].methods == ["GET", "POST"]


def test_derived(kg):
    paths = {r.path: r for r in kg["related_paths"].collect()}
    assert paths["partner_id.country_id.name"].fully_resolved and paths["partner_id.country_id.name"].terminal_model == "fx.country"
    assert paths["partner_id.gone.name"].broken_at == "fx.partner.gone"
    assert {(r.field, r.group_id, r.source) for r in kg["field_groups"].collect()} == {("partner_id", "base.user", "python"), ("partner_id", "base.admin", "python"), ("total", "base.user", "view")}
    assert {r.field: r.states for r in kg["state_machines"].collect()} == {"state": ["done"], "status": ["closed"]}


def test_schema_and_overrides(kg):
    s = T.get_model_schema(kg, "fx.order")
    by = {}
    for m in s["methods"]:
        by.setdefault(m["name"], m)
    assert by["mixin_only"]["inherited_from"] == "fx.mixin" and by["action_done"]["overrides"] == [{"model": "fx.mixin", "module": "fx_base"}]
    assert any(f.get("inherited_from") == "fx.mixin" and f["name"] == "note" for f in s["fields"])
    assert s["extensions"][0]["module"] == "fx_ext" and s["extensions"][0]["added_fields"] == ["extra", "state"]
    assert {m["name"] for m in T.get_model_schema(kg, "fx.special", include_inherited=False)["methods"]} == {"action_done"}
    assert "error" in T.get_model_schema(kg, "fx.gone")
    logic = T.get_method_logic(kg, "fx.order", "action_done")
    assert logic["is_override"] and {r["model"] for r in logic["overrides_from"]} == {"fx.mixin"} and len(logic["all_implementations"]) == 2
    missing = T.get_method_logic(kg, "fx.special", "action_done")
    assert missing["missing_super_call"] and not missing["is_inherited"]
    deep = T.get_method_logic(kg, "fx.special", "mixin_only")
    assert deep["is_inherited"] and deep["resolved_on"] == "fx.mixin"


def test_tools(kg):
    assert T.resolve_xml_view(kg, "fx.order")["all_fields"] == ["name", "total", "extra"]
    impact = T.analyze_change_impact(kg, "fx.order", "state")
    assert impact["risk_level"] == "MEDIUM" and len(impact["impact"]["record_rules"]) == 1 and len(impact["impact"]["button_visibility"]) == 1
    assert "error" in T.analyze_change_impact(kg, "fx.order")
    machine = T.get_state_machine(kg, "fx.order")
    assert machine["total_transitions"] >= 2 and machine["transitions"][0]["button_view"] == "fx_base.view_order_form"
    assert T.get_constraints(kg, "fx.order")["total"] == 2
    access = T.get_access_control(kg, "fx.order")
    assert len(access["model_access"]) == 1 and len(access["record_rules"]) == 1 and len(access["field_groups"]) == 3
    assert T.trace_compute_chain(kg, "fx.order", "total")["depends_fields"] == ["line_ids.price", "partner_id"]
    assert T.trace_compute_chain(kg, "fx.order", "country")["resolution"]["fully_resolved"]
    assert T.get_model_actions(kg, "fx.order")["totals"] == {"actions": 1, "server_actions": 0, "menus": 1, "cron_jobs": 1, "reports": 0}
    assert T.get_field_visibility(kg, "fx.order", "total")["appears_in_views"] == 1
    assert T.trace_button_to_method(kg, "view_order_form", "action_done")["resolved_method"]["module"] == "fx_base"
    assert T.trace_button_to_method(kg, "view_order_form", "%(fx_base.act_order)d")["resolved_action"]["res_model"] == "fx.order"
    assert T.get_http_routes(kg, auth="public")["total"] == 1
    assert T.get_project_context(kg, "fx.order")["focus"]["extending_modules"] == ["fx_ext"]
    assert T.get_project_context(kg)["overview"]["top_models"][0]["model"] == "fx.order"


def test_graphs_and_search(kg):
    one = T.get_model_graph(kg, "fx.order", output_format="json")
    assert [n["node"] for n in one["nodes"]] == ["fx.order"] and {e["dst"] for e in one["edges"]} == {"fx.partner", "fx.line"}
    assert "[*] --> done" in T.get_model_graph(kg, "fx.order", "state_machine")["diagram"]
    assert "error" in T.get_model_graph(kg, "fx.order", "odd")
    walk = T.trace_path(kg, "fx.order", depth=2)
    assert {"m:fx.partner", "st:fx.order:done"} <= {n["id"] for n in walk["nodes"]} and not walk["truncated"]
    assert T.trace_path(kg, "fx.order", depth=2, token_budget=60)["truncated"]
    flow = T.trace_business_flow(kg, "fx.order")["flow"]
    assert [r["dst"] for r in flow] == ["fx.line"]
    hits = T.search_entities(kg, "fixture", types=["model"])
    assert hits["total"] == 1 and "<b>Fixture</b>" in hits["results"][0]["snippet"]
    assert T.search_entities(kg, "partner AND (")["error"]
    assert "fx.order" in page("g", ["fx.order", "<x>"], [{"src": "fx.order", "dst": "<x>"}]) and "<x></text>" not in page("g", ["<x>"], [])


def test_incremental_equals_full(spark, tmp_path):
    folder = write(str(tmp_path / "a"))
    index = Index(spark, f"file://{tmp_path}/i")
    files = lambda: scan(spark, [folder], ["demo_*"])
    assert index.build(files())["mode"] == "full"
    assert index.build(files())["modules_indexed"] == 0
    with open(os.path.join(folder, "fx_ext/models/order_ext.py"), "a") as f:
        f.write("\nclass New(models.Model):\n    _name = 'fx.new'\n")
    for root, _, names in os.walk(os.path.join(folder, "fx_web"), topdown=False):
        for n in names:
            os.remove(os.path.join(root, n))
    assert index.status(files())["stale_module_names"] == ["fx_ext"]
    assert index.build(files())["modules_indexed"] == 1
    left = sorted((r.tbl, r.module, r.data) for r in index.state.read("facts").collect())
    assert left == sorted((r.tbl, r.module, r.data) for r in facts(files()).collect())
    assert "fx.new" in {r.name for r in index.tables()["models"].collect()}


def test_table_source(spark, small):
    rows = facts(from_table(table(spark, small, "source_files")))
    assert table_of(rows, "models").count() > 0 and derive(rows)["documents"].count() > 0


def test_registry(tmp_path):
    r = Registry(str(tmp_path / "r.json"))
    r.add("a", ["/x"], "/i")
    first = r.get("a")["created_at"]
    assert r.route() == "a"
    r.add("b", ["/x/y"], "/j")
    r.add("a", ["/x"], "/k")
    assert r.get("a")["created_at"] == first and r.find_by_path("/x/y/z") == "b" and r.find_by_path("/x/yz") == "a" and r.find_by_path("/q") is None
    r.set_active("b")
    assert r.active() == "b" and r.remove("b") and r.active() is None and not r.remove("b")
    with pytest.raises(KeyError):
        r.route("b")


def test_whole_graph(kg):
    edges = graphs.edges(kg).cache()
    kinds = {r.type for r in edges.select("type").distinct().collect()}
    assert {"field_rel", "inherit", "defines", "has_method", "compute", "state", "view_of", "view_inherit", "action", "access", "rule", "cron", "depends"} == kinds
    nodes = {r.id: (r.kind, r.external) for r in graphs.nodes(kg, edges).collect()}
    assert nodes["m:fx.order"] == ("model", False) and nodes["mod:core"] == ("module", True) and nodes["mt:fx.order.action_done"][0] == "method"
    near = {(r.src, r.dst) for r in graphs.around(edges, "m:fx.country", 1).collect()}
    assert ("m:fx.partner", "m:fx.country") in near and not any("fx.line" in s for s, _ in near)


def test_command_line(spark, tree, tmp_path, capsys, monkeypatch):
    monkeypatch.chdir(tmp_path)
    base = ["--index", str(tmp_path / "i"), "--registry", str(tmp_path / "r.json"), "--roots", tree]
    run = lambda *x: (main([*base, *x], spark), json.loads(capsys.readouterr().out))
    assert run("index")[1]["mode"] == "full" and run("index")[1]["modules_indexed"] == 0
    assert run("status")[1]["stale_modules"] == 0 and run("stats")[1]["models"] > 0
    code, got = run("query", "get_constraints", "fx.order")
    assert code == 0 and got["total"] == 2
    assert run("query", "analyze_change_impact", "model=fx.order")[0] == 1
    assert run("graph", "--start", "m:fx.order", "--out", str(tmp_path / "g.html"))[1]["edges"] > 0 and "m:fx.order" in (tmp_path / "g.html").read_text()
    assert run("project", "add", "p")[1]["roots"] == [tree] and list(run("project", "list")[1]) == ["p"] and run("project", "info", "q")[0] == 1
