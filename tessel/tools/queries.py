"""Query tools over the knowledge-graph tables; sections are DataFrames until ``rows`` collects a bounded answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import contains_ci, mermaid_id, suffix_or_equal
from tessel.operators import fts, graph

Tables = dict[str, DataFrame]
#: Lines of a diagram; a longer one says that it is cut, and counts all edges.
DIAGRAM_LINES = 2000


def rows(df: DataFrame, limit: int | None = None) -> list[dict]:
    """A tool's answer as dictionaries: all that is said of one entity, or as many rows as the tool shows."""
    return [r.asDict(recursive=True) for r in (df if limit is None else df.limit(limit)).collect()]


def sparse(row: dict) -> dict:
    """A row without what is missing, empty or false, as tools show it."""
    return {k: v for k, v in row.items() if v not in (None, False, "", [], {})}


def _unknown(t: Tables, model: str) -> dict | None:
    if not t["models"].where(F.col("name") == model).isEmpty():
        return None
    near = t["models"].where(contains_ci(F.col("name"), model.rsplit(".", 1)[-1])).select("name").distinct().orderBy("name")
    return {"error": f"model {model} is not indexed", "model": model, "suggestions": [r["name"] for r in near.limit(5).collect()]}


def ancestors(t: Tables, model: str, depth: int | None = None) -> DataFrame:
    start = t["inherits"].sparkSession.createDataFrame([(model,)], "start string")
    return graph.bfs(t["inherits"], start, depth).where("depth > 0").select(F.col("node").alias("ancestor"), "depth")


def compact(stored: str = "store") -> Column:
    """``name: Type(comodel) [flags]``."""
    flags = F.concat_ws(
        ", ", F.when(F.col("required"), "required"), F.when(F.col("compute").isNotNull(), F.concat(F.lit("compute"), F.when(F.col(stored), "[stored]").otherwise(""))), F.when(F.col("related").isNotNull(), "related"),
        F.when(F.col("readonly"), "readonly"), F.when(F.col("groups").isNotNull(), F.concat(F.lit("groups="), "groups")),
    )
    return F.concat("name", F.lit(": "), "field_type", F.when(F.col("comodel").isNotNull(), F.concat(F.lit("("), "comodel", F.lit(")"))).otherwise(""), F.when(flags != "", F.concat(F.lit(" ["), flags, F.lit("]"))).otherwise(""))


def get_model_schema(t: Tables, model: str, compact_fields: bool = False, fields_limit: int = 200, include_inherited: bool = True) -> dict:
    """Fields, methods, extensions; inherited members with their origin, own names winning."""
    if (e := _unknown(t, model)) is not None:
        return e
    mine = t["models"].where(F.col("name") == model)
    head = mine.orderBy(F.col("inherit_type") != "primary", "module", "file", "seq").first().asDict(recursive=True)
    own = t["fields"].where(F.col("model") == model)
    methods = t["methods"].where(F.col("model") == model)
    total = own.select("name").distinct().count()
    shown = own.orderBy("name", "module").limit(fields_limit)
    fields = rows(shown.select(compact().alias("f"))) if compact_fields else [sparse(r) for r in rows(shown)]
    up = ancestors(t, model)
    theirs = t["methods"].join(up, F.col("model") == F.col("ancestor"))
    over = theirs.groupBy("name").agg(F.array_sort(F.collect_set(F.struct(F.col("ancestor").alias("model"), "module"))).alias("overrides"))
    out_methods = rows(methods.join(over, "name", "left").select("name", "module", "decorators", "overrides").orderBy("name", "module"))
    if include_inherited:
        extra = t["fields"].join(up, F.col("model") == F.col("ancestor")).join(own.select("name"), "name", "left_anti")
        fields += [sparse(r) for r in rows((extra.select(compact().alias("f"), F.col("ancestor").alias("inherited_from")) if compact_fields else extra.withColumn("inherited_from", F.col("ancestor"))))]
        out_methods += rows(theirs.join(methods.select("name"), "name", "left_anti").select("name", "module", "decorators", F.col("ancestor").alias("inherited_from")).orderBy("name", "inherited_from"))
    added = own.groupBy("module").agg(F.array_sort(F.collect_set("name")).alias("added_fields"))
    extensions = rows(mine.where("inherit_type = 'extension'").join(added, "module", "left").select("module", "file", "line", "added_fields").orderBy("module"))
    return head | {"model": model, "fields": fields, "methods": out_methods, "extensions": extensions, "total_fields": total, "compact": compact_fields, "include_inherited": include_inherited} | ({"truncated": True} if total > fields_limit else {})


def resolve_xml_view(t: Tables, model: str, view_type: str = "form") -> dict:
    """A model's views of a type and all its inherited views, with accumulated names."""
    v = t["views"].where((F.col("model") == model) & ((F.col("view_type") == view_type) | F.col("inherit_id").isNotNull()))
    found = rows(v.orderBy(F.col("inherit_id").asc_nulls_first(), "priority", "xml_id"))
    if not found:
        return {"error": "no such view", "model": model, "view_type": view_type}
    return {"model": model, "view_type": view_type, "views": found, "all_fields": list(dict.fromkeys(n for r in found for n in r["field_names"])), "all_buttons": list(dict.fromkeys(n for r in found for n in r["button_names"])), "total_views": len(found)}


def analyze_change_impact(t: Tables, model: str, field: str | None = None, method: str | None = None) -> dict:
    """What a change of a field or method touches, scored 1 a hit (3 for a state machine); HIGH from 8, MEDIUM from 3."""
    if not field and not method:
        return {"error": "give a field or a method", "model": model}
    e, views = t["elements"], t["views"].where(F.col("model") == model)
    impact: dict[str, list] = {}
    if field:
        f = F.lit(field)
        dep = t["methods"].where(F.col("model") == model)
        impact["compute_dependents"] = rows(dep.where(F.exists("depends", lambda d: F.contains(d, f))).select("name", "module"))
        hit = e.where(F.col("field_name") == field).select(F.col("view_xml_id").alias("xml_id"))
        impact["view_refs"] = rows(views.join(hit, "xml_id", "left_semi").select("xml_id").unionAll(views.where(F.array_contains("field_names", field)).select("xml_id")).distinct().orderBy("xml_id"))
        impact["button_visibility"] = rows(e.where((F.col("element_type") == "button") & (contains_ci(F.coalesce("invisible", F.lit("")), field) | contains_ci(F.coalesce("attrs", F.lit("")), field))).select("view_xml_id", "button_name"))
        impact["onchange_triggers"] = rows(dep.where(F.array_contains("onchange", field)).select("name", "module"))
        impact["constrained_by"] = rows(dep.where(F.array_contains("constrains", field)).select("name", "module"))
        impact["state_machine"] = rows(t["state_machines"].where((F.col("model") == model) & (F.col("field") == field)))
        impact["record_rules"] = rows(t["record_rules"].where((F.col("model") == model) & contains_ci(F.coalesce("domain", F.lit("")), field)).select("xml_id", "domain"))
        impact["email_template_refs"] = rows(t["mail_templates"].where((F.col("model") == model) & F.exists("refs", lambda r: F.contains(r, f))).select("xml_id"))
    else:
        impact["view_refs"] = rows(e.where((F.col("element_type") == "button") & suffix_or_equal(F.col("button_name"), method)).select("view_xml_id", "button_name"))
    score = sum(3 * bool(v) if k == "state_machine" else len(v) for k, v in impact.items())
    risk = "HIGH" if score >= 8 else "MEDIUM" if score >= 3 else "LOW"
    return {"target": f"{model}.{field or method}", "impact": impact, "score": score, "risk_level": risk, "summary": ", ".join(f"{len(v)} {k}" for k, v in impact.items() if v) or "no references"}


def get_method_logic(t: Tables, model: str, method: str) -> dict:
    """T4: the implementation that runs, all implementations, and what it overrides."""
    m = t["methods"].where(F.col("name") == method)
    rich = [F.size("transitions") == 0, ~F.col("raises_validation"), F.size("calls_models") == 0, F.col("module")]
    own = rows(m.where(F.col("model") == model).orderBy(*rich))
    above = rows(m.join(ancestors(t, model), F.col("model") == F.col("ancestor")).orderBy("depth", "ancestor", *rich))
    if not own and not above:
        return {"error": "no such method", "model": model, "method": method}
    run = (own or above)[0]
    shown = own or [r for r in above if r["ancestor"] == run["ancestor"]]
    marks = rows(t["decorators"].where((F.col("model") == run["model"]) & (F.col("method") == method) & (F.col("module") == run["module"])).orderBy("line").select("decorator", "args"))
    run = run | {"decorators": [f"@{d['decorator']}({', '.join(repr(a) for a in d['args'])})" if d["args"] else f"@{d['decorator']}" for d in marks]}
    over = [{"model": r["ancestor"], "module": r["module"], "file": r["file"], "line": r["line"]} for r in above] if own else []
    return run | {"model": model, "method": method, "is_inherited": not own, "resolved_on": run["model"], "is_override": bool(over), "overrides_from": over, "missing_super_call": bool(over) and not run["calls_super"], "all_implementations": [{"module": r["module"], "file": r["file"], "line": r["line"], "has_state_transitions": bool(r["transitions"])} for r in shown]}


def get_state_machine(t: Tables, model: str) -> dict:
    """T5: states and transitions with the first button that triggers each."""
    machine = t["state_machines"].where(F.col("model") == model)
    moves = machine.select("field", F.explode("transitions").alias("x")).select("field", "x.*")
    views = t["views"].where(F.col("model") == model).select(F.col("xml_id").alias("view_xml_id"))
    buttons = t["elements"].where("element_type = 'button'").join(views, "view_xml_id").groupBy(F.col("button_name").alias("method")).agg(F.min("view_xml_id").alias("button_view"))
    found = rows(moves.join(buttons, "method", "left").orderBy("field", "to_state", "method"))
    if found:
        states = sorted({s for r in rows(machine.select("states")) for s in r["states"]})
        return {"model": model, "state_field": found[0]["field"], "states": states, "transitions": found, "total_transitions": len(found)}
    chosen = rows(t["fields"].where((F.col("model") == model) & (F.col("name") == "state") & (F.size("selection") > 0)), 1)
    return {"model": model, "state_field": "state", "states": chosen[0]["selection"], "transitions": [], "total_transitions": 0, "note": "from the field's selection"} if chosen else {"error": "no state machine", "model": model}


def get_constraints(t: Tables, model: str) -> dict:
    """Constraint, onchange and validation methods."""
    m = t["methods"].where(F.col("model") == model)
    out = {k: rows(m.where(w).select("name", "constrains", "onchange", "file", "line").orderBy("name")) for k, w in (("python_constrains", "size(constrains) > 0"), ("onchange_methods", "size(onchange) > 0"), ("validation_methods", "raises_validation and size(constrains) = 0"))}
    if not any(out.values()) and (e := _unknown(t, model)) is not None:
        return e
    return {"model": model} | out | {"total": len(out["python_constrains"]) + len(out["onchange_methods"])}


def get_access_control(t: Tables, model: str) -> dict:
    """Access rules, record rules and field groups."""
    mine = {k: rows(t[k].where(F.col("model") == model).orderBy("xml_id")) for k in ("access_rules", "record_rules")}
    groups = rows(t["field_groups"].where(F.col("model") == model).groupBy("field", "group_id").agg(F.min("source").alias("source")).orderBy("field", "group_id"))
    return {"model": model, "model_access": mine["access_rules"], "record_rules": mine["record_rules"], "field_groups": groups, "summary": f"{len(mine['access_rules'])} access rules, {len(mine['record_rules'])} record rules, {len(groups)} restricted fields"}


def trace_compute_chain(t: Tables, model: str, field: str) -> dict:
    """How a field gets its value: related, plain or computed."""
    found = rows(t["fields"].where((F.col("model") == model) & (F.col("name") == field)).orderBy(F.col("compute").isNull(), F.col("related").isNull(), "module"), 1)
    if not found:
        return {"error": "no such field", "model": model, "field": field}
    f = found[0]
    base = {"model": model, "field": field, "field_type": f["field_type"], "is_stored": f["store"]}
    if f["related"]:
        path = rows(t["related_paths"].where((F.col("model") == model) & (F.col("path") == f["related"])), 1)
        return base | {"related_chain": f["related"], "resolution": path[0] if path else None}
    if not f["compute"]:
        return base | {"note": "a plain field"}
    m = rows(t["methods"].where((F.col("model") == model) & (F.col("name") == f["compute"])), 1)
    m = m[0] if m else {}
    return base | {"compute_method": f["compute"], "depends_fields": m.get("depends", []), "depends_context": m.get("depends_context", []), "inverse_method": f["inverse"], "search_method": f["search"], "compute_file": m.get("file"), "compute_line": m.get("line"), "state_transitions": m.get("transitions", []), "orm_calls": m.get("calls_models", [])}


def get_model_actions(t: Tables, model: str) -> dict:
    """Actions, menus, jobs and reports of a model."""
    a = t["actions"].where((F.col("res_model") == model) | (F.col("binding_model") == model))
    found = rows(a.orderBy("action_type", "xml_id"))
    menus = rows(t["menus"].where(F.col("action_model") == model).orderBy("sequence", "xml_id"))
    crons = rows(t["crons"].where(F.col("model") == model).withColumn("interval", F.concat_ws(" ", F.col("interval_number").cast("string"), "interval_type")).orderBy("xml_id"))
    out = {"model": model, "actions": [r for r in found if r["action_type"] != "report"], "server_actions": [r for r in found if r["action_type"] == "server"], "menus": menus, "cron_jobs": crons, "reports": [r for r in found if r["action_type"] == "report"]}
    return out | {"totals": {k: len(v) for k, v in out.items() if isinstance(v, list)}}


def get_field_visibility(t: Tables, model: str, field: str) -> dict:
    """Where and to whom a field is visible."""
    found = rows(t["fields"].where((F.col("model") == model) & (F.col("name") == field)).orderBy("module"), 1)
    if not found:
        return {"error": "no such field", "model": model, "field": field}
    views = t["views"].where(F.col("model") == model).select(F.col("xml_id").alias("view_xml_id"), "view_type")
    level = rows(t["elements"].where(F.col("field_name") == field).join(views, "view_xml_id").select("view_xml_id", "view_type", "module", "widget", "groups", "invisible", "attrs").orderBy("view_xml_id"))
    groups = rows(t["field_groups"].where((F.col("model") == model) & (F.col("field") == field)).select("group_id", "source").orderBy("group_id", "source"))
    f = found[0]
    return {"model": model, "field": field, "field_type": f["field_type"], "label": f["label"], "python_level": {k: f[k] for k in ("required", "readonly", "groups", "compute", "related", "file", "line")}, "view_level": level, "group_restrictions": groups, "appears_in_views": len({r["view_xml_id"] for r in level})}


def trace_button_to_method(t: Tables, view_xml_id: str, button: str) -> dict:
    """What a button does, by its type."""
    b = t["elements"].where((F.col("element_type") == "button") & (F.col("button_name") == button) & suffix_or_equal(F.col("view_xml_id"), view_xml_id))
    views = t["views"].select(F.col("xml_id").alias("view_xml_id"), "view_type", "model")
    found = rows(b.join(views, "view_xml_id").orderBy("view_xml_id"), 1)
    if not found:
        return {"error": "no such button", "view_xml_id": view_xml_id, "button_name": button}
    r = found[0]
    out = {"view_xml_id": r["view_xml_id"], "view_type": r["view_type"], "model": r["model"], "button_name": button, "button_type": r["button_type"], "button_groups": r["groups"], "invisible_when": r["invisible"]}
    if r["button_type"] == "object":
        m = rows(t["methods"].where((F.col("model") == r["model"]) & (F.col("name") == button)).orderBy("module"), 1)
        return out | ({"resolved_method": m[0]} if m else {"note": "no such method is indexed"})
    if r["button_type"] == "action":
        name = button.removeprefix("%(").removesuffix(")d")
        a = rows(t["actions"].where(suffix_or_equal(F.col("xml_id"), name)).orderBy("xml_id"), 1)
        return out | ({"resolved_action": a[0]} if a else {"note": "no such action is indexed"})
    return out | {"url": button}


def get_http_routes(t: Tables, module: str | None = None, path_prefix: str | None = None, auth: str | None = None) -> dict:
    """Routes under optional filters, with counts by auth and module."""
    r = t["routes"]
    if module:
        r = r.where(F.col("module") == module)
    if path_prefix:
        r = r.where(F.col("pattern").ilike(f"{path_prefix}%"))
    if auth:
        r = r.where(F.col("auth") == auth)
    found = rows(r.orderBy("pattern", "module", "method"))

    def counts(key: str, none: str) -> dict:
        return {x["k"]: x["n"] for x in rows(r.groupBy(F.coalesce(key, F.lit(none)).alias("k")).agg(F.count("*").alias("n")))}

    return {"routes": found, "total": len(found), "filters_applied": {k: v for k, v in (("module", module), ("path_prefix", path_prefix), ("auth", auth)) if v}, "summary": {"by_auth": counts("auth", "none"), "by_module": counts("module", "unknown")}}


def relation_edges(t: Tables) -> DataFrame:
    return t["fields"].where(F.col("field_type").isin("Many2one", "One2many", "Many2many") & F.col("comodel").isNotNull()).select(F.col("model").alias("src"), F.col("comodel").alias("dst"), F.col("name").alias("label"), "field_type").distinct()


def get_model_graph(t: Tables, name: str, graph_type: str = "relations", depth: int = 1, output_format: str = "mermaid") -> dict:
    """Relations, inheritance, module dependencies or a state machine, as rows or a diagram."""
    depth = max(1, min(3, depth))
    start = t["models"].sparkSession.createDataFrame([(name,)], "start string")
    if graph_type == "relations":
        nodes, edges = graph.relations(relation_edges(t), name, depth)
        line = F.concat(F.lit("    "), mermaid_id(F.col("src")), F.when(F.col("field_type") == "Many2one", " }o--|| ").when(F.col("field_type") == "One2many", " ||--o{ ").otherwise(" }o--o{ "), mermaid_id(F.col("dst")), F.lit(" : "), "label")
        title = "erDiagram"
    elif graph_type == "inheritance":
        edges = t["inherits"].where((F.col("src") == name) | (F.col("dst") == name)).withColumn("label", F.lit("inherits"))
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        line, title = F.concat(F.lit("    "), mermaid_id(F.col("src")), F.lit(" --> "), mermaid_id(F.col("dst"))), "graph BT"
    elif graph_type == "modules":
        nodes = graph.bfs(t["module_deps"], start, depth).select("node", "depth")
        inside = nodes.where(F.col("depth") < depth).select(F.col("node").alias("src"))
        edges = t["module_deps"].join(inside, "src", "left_semi").withColumn("label", F.lit("depends"))
        line, title = F.concat(F.lit("    "), mermaid_id(F.col("src")), F.lit(" --> "), mermaid_id(F.col("dst"))), "graph TD"
    elif graph_type == "state_machine":
        moves = t["state_machines"].where(F.col("model") == name).select(F.explode("transitions").alias("x"))
        edges = moves.select(F.coalesce("x.from_state", F.lit("[*]")).alias("src"), F.col("x.to_state").alias("dst"), F.col("x.method").alias("label"))
        nodes = edges.select(F.col("dst").alias("node")).distinct()
        line, title = F.concat(F.lit("    "), "src", F.lit(" --> "), "dst", F.lit(" : "), "label"), "stateDiagram-v2"
    else:
        return {"error": "unknown graph type", "valid_types": ["relations", "inheritance", "modules", "state_machine"]}
    out = {"graph_type": graph_type, "name": name, "depth": depth, "format": output_format}
    if output_format == "json":
        return out | {"nodes": rows(nodes.orderBy("node")), "edges": rows(edges.orderBy("src", "dst", "label"))}
    lines = edges.select(line.alias("l")).distinct()
    total, shown = lines.count(), [r["l"] for r in lines.orderBy("l").limit(DIAGRAM_LINES).collect()]
    return out | {"diagram": "\n".join([title, *shown]), "node_count": nodes.count(), "edge_count": total} | ({"truncated": True} if total > len(shown) else {})


def get_project_context(t: Tables, focus_model: str | None = None) -> dict:
    """An overview of the project: largest models and modules."""
    f = t["fields"].groupBy("model").agg(F.count_distinct("name").alias("fields"))
    m = t["methods"].groupBy("model").agg(F.count_distinct("name").alias("methods"))
    machines = t["state_machines"].select("model").distinct().withColumn("sm", F.lit(True))
    acl = t["access_rules"].select("model").distinct().withColumn("acl", F.lit(True))
    base = t["models"].groupBy(F.col("name").alias("model")).agg(F.min("module").alias("module"))
    j = base.join(f, "model", "left").join(m, "model", "left").join(machines, "model", "left").join(acl, "model", "left").fillna(0, ["fields", "methods"]).fillna(False, ["sm", "acl"])
    top = rows(j.orderBy(F.desc(F.col("fields") + F.col("methods")), "model"), 15)
    modules = rows(t["models"].groupBy("module").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module"), 10)
    out: dict = {"overview": {"top_models": top, "top_modules": {r["module"]: r["n"] for r in modules}}}
    if focus_model:
        related = rows(relation_edges(t).where(F.col("src") == focus_model).select("dst").distinct().orderBy("dst"), 8)
        out["focus"] = _unknown(t, focus_model) or {"model": focus_model, "inherits_from": [r["ancestor"] for r in rows(ancestors(t, focus_model, 1).orderBy("ancestor"))], "related_models": [r["dst"] for r in related], "extending_modules": [r["module"] for r in rows(t["models"].where((F.col("name") == focus_model) & (F.col("inherit_type") == "extension")).select("module").distinct().orderBy("module"))]}
    return out


def search_entities(t: Tables, query: str, types: list[str] | None = None, module: str | None = None, limit: int = 20) -> dict:
    """Ranked full-text search over all columns of the entity documents."""
    known = [x for x in types or () if x in ("model", "field", "method", "route", "view")]
    columns = ["entity_type", "entity_name", "model_context", "content", "module"]
    docs = t["documents"]
    post = fts.postings(docs, "doc_id", columns, stemmed=True, fold=True)
    try:
        tree = fts.parse(fts.sanitize(fts.unmarked(query)))
    except ValueError as e:
        return {"error": str(e), "query": query}
    hits = docs.join(fts.bm25(post, "doc_id", tree, stemmed=True), "doc_id")
    if known:
        hits = hits.where(F.col("entity_type").isin(*known))
    if module:
        hits = hits.where(F.col("module") == module)
    word = query.split()[-1].strip('"*') if query.split() else ""
    found = rows(hits.orderBy(F.desc("score"), "entity_type", "entity_name", "module").select(F.col("entity_type").alias("type"), F.col("entity_name").alias("name"), "module", F.col("model_context").alias("model"), fts.snippet(F.col("content"), word).alias("snippet")), max(1, min(100, limit)))
    total = hits.count()
    hint = {} if total or not word else {"hint": f"nothing found: try fewer words, or a prefix like {word[:4]}*"}
    return {"query": query, "results": found, "total": total, "returned": len(found)} | hint


def trace_path(t: Tables, start: str, depth: int = 2, edge_types: tuple[str, ...] = ("field_rel", "inherit", "compute", "state", "action"), token_budget: int = 3000) -> dict:
    """Budgeted walk over typed edges: a node costs 15, an edge 10."""
    if (e := _unknown(t, start)) is not None:
        return e
    depth = max(1, min(4, depth))
    c, lit = F.col, F.lit
    kinds = {
        "field_rel": relation_edges(t).select(F.concat(lit("m:"), "src").alias("src"), F.concat(lit("m:"), "dst").alias("dst"), "label"),
        "inherit": t["inherits"].select(F.concat(lit("m:"), "src").alias("src"), F.concat(lit("m:"), "dst").alias("dst"), lit("inherits").alias("label")),
        "compute": t["fields"].where("compute is not null").select(F.explode(F.array(
            F.struct(F.concat(lit("m:"), "model").alias("src"), F.concat(lit("mt:"), "model", lit("."), "compute").alias("dst"), lit("computes").alias("label")),
            F.struct(F.concat(lit("mt:"), "model", lit("."), "compute").alias("src"), F.concat(lit("f:"), "model", lit("."), "name").alias("dst"), c("compute").alias("label")),
        )).alias("x")).select("x.*").distinct(),
        "state": t["state_machines"].select("model", F.explode("transitions").alias("x")).select(F.concat(lit("m:"), "model").alias("src"), F.concat(lit("st:"), "model", lit(":"), "x.to_state").alias("dst"), c("x.method").alias("label")),
        "action": t["actions"].where("res_model is not null and xml_id is not null").select(F.explode(F.array(F.struct(F.concat(lit("ac:"), "xml_id").alias("src"), F.concat(lit("m:"), "res_model").alias("dst"), c("action_type").alias("label")), F.struct(F.concat(lit("m:"), "res_model").alias("src"), F.concat(lit("ac:"), "xml_id").alias("dst"), lit("opened by").alias("label")))).alias("x")).select("x.*"),
    }
    edges = None
    for k in edge_types:
        if k in kinds:
            part = kinds[k].withColumn("type", lit(k))
            edges = part if edges is None else edges.unionAll(part)
    if edges is None:
        return {"error": "no valid edge type", "valid_types": list(kinds)}
    nodes = graph.bfs(edges, edges.sparkSession.createDataFrame([(f"m:{start}",)], "start string"), depth).select("node", "depth")
    taken = graph.budgeted(nodes.withColumn("cost", lit(15)), ["depth", "node"], "cost", token_budget)
    kept = edges.distinct().join(taken.select(c("node").alias("src"), "depth"), "src").join(taken.select(c("node").alias("dst")), "dst", "left_semi")
    spent = 15 * taken.count()
    room = max(0, (token_budget - spent) // 10)
    shown = rows(kept.orderBy("depth", "src", "dst", "type", "label").select(c("src").alias("from"), c("dst").alias("to"), "type", "label"), int(room) or 1) if room else []
    kind = F.when(c("node").startswith("m:"), "model").when(c("node").startswith("mt:"), "method").when(c("node").startswith("f:"), "field").when(c("node").startswith("st:"), "state").otherwise("action")
    homes = t["models"].groupBy(F.concat(lit("m:"), "name").alias("node")).agg(F.min("module").alias("module"))
    all_nodes = rows(taken.join(homes, "node", "left").orderBy("depth", "node").select(c("node").alias("id"), kind.alias("type"), F.regexp_replace("node", "^[a-z]+:", "").alias("label"), "module", "depth"))
    return {"start": start, "depth": depth, "nodes": all_nodes, "edges": shown, "node_count": len(all_nodes), "edge_count": len(shown), "truncated": nodes.count() > len(all_nodes) or kept.count() > len(shown)}


def trace_business_flow(t: Tables, start: str) -> dict:
    """One hop over to-many relations, customised models first, at most 25."""
    if (e := _unknown(t, start)) is not None:
        return e
    known = t["models"].groupBy(F.col("name").alias("dst")).agg(F.max(F.col("inherit_type") == "extension").alias("is_customized"), F.min("module").alias("module"))
    hops = t["fields"].where((F.col("model") == start) & F.col("field_type").isin("One2many", "Many2many") & F.col("comodel").isNotNull())
    flow = hops.select(F.col("comodel").alias("dst"), F.col("name").alias("via_field"), F.col("label").alias("field_label"), F.col("field_type").alias("relation")).join(known, "dst")
    # of several fields that lead to one model the first by name counts
    flow = flow.groupBy("dst", "is_customized", "module").agg(F.min_by(F.struct("via_field", "field_label", "relation"), "via_field").alias("s")).select("dst", "s.*", "is_customized", "module")
    shown = rows(flow.orderBy(F.desc("is_customized"), "dst"), 25)
    mine = F.col("model") == start
    root = {"model": start, "field_count": t["fields"].where(mine).select("name").distinct().count(), "method_count": t["methods"].where(mine).select("name").distinct().count()}
    root["state_machine"] = rows(t["state_machines"].where(mine).select("field", "states").orderBy("field"))
    root["extended_by"] = [r["module"] for r in rows(t["models"].where((F.col("name") == start) & (F.col("inherit_type") == "extension")).select("module").distinct().orderBy("module"))]
    steps = [f"get_model_schema {r['dst']}" for r in shown[:3]] + ([f"get_state_machine {start}"] if root["state_machine"] else [])
    return {"root": root, "flow": shown, "total": flow.count(), "next_steps": steps}
