"""One parse per file: every fact a source file states, as rows of the knowledge-graph tables.

``facts`` is a narrow ``mapInPandas`` over files; it emits ``(tbl, data)`` with the row as JSON,
and ``table_of`` types the rows of one table, so a file is never parsed twice.
"""

from __future__ import annotations

import ast
import csv
import io
import json
import re
import warnings
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.schemas import TABLES

#: Field kinds of the model framework (fixed values).
FIELD_KINDS = frozenset(
    ["Boolean", "Integer", "Float", "Monetary", "Char", "Text", "Html", "Date", "Datetime", "Binary", "Image", "Selection", "Reference", "Many2one", "One2many", "Many2many", "Many2oneReference", "Id", "Properties", "PropertiesDefinition"]
)
RELATIONAL = ("Many2one", "One2many", "Many2many")
#: State fields whose assignment is a transition (fixed values).
STATE_FIELDS = ("state", "status", "stage_id", "kanban_state")

Row = tuple[str, dict]


# ---- Python


def _literal(node: ast.AST | None):
    try:
        return ast.literal_eval(node) if node is not None else None
    except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
        return None


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(reversed([*parts, node.id])) if isinstance(node, ast.Name) else ".".join(reversed(parts))


class PythonFile:
    """Models, fields, methods, decorators and routes of one Python text."""

    def __init__(self, text: str):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            self.tree = ast.parse(text)
        self.lines = text.split("\n")

    def source(self, node: ast.AST | None) -> str | None:
        if node is None:
            return None
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.lines[first].encode()[node.col_offset : node.end_col_offset].decode("utf-8", "replace")
        return "\n".join([self.lines[first][node.col_offset :], *self.lines[first + 1 : last], self.lines[last][: node.end_col_offset]])

    def text_of(self, node: ast.AST | None) -> str | None:
        value = _literal(node)
        return value if isinstance(value, str) else self.source(node)

    def rows(self) -> Iterator[Row]:
        for node in ast.walk(self.tree):
            if isinstance(node, ast.ClassDef):
                bases = [_dotted(b) for b in node.bases]
                yield from self.model(node, bases)
                if any("controller" in b.lower() for b in bases):
                    yield from self.controller(node)

    def assigned(self, node: ast.ClassDef) -> Iterator[tuple[str, ast.AST]]:
        for x in node.body:
            if isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name):
                yield x.targets[0].id, x.value
            elif isinstance(x, ast.AnnAssign) and isinstance(x.target, ast.Name) and x.value is not None:
                yield x.target.id, x.value

    def model(self, node: ast.ClassDef, bases: list[str]) -> Iterator[Row]:
        attrs = dict(self.assigned(node))
        name, inherit = _literal(attrs.get("_name")), _literal(attrs.get("_inherit"))
        parents = [inherit] if isinstance(inherit, str) else [p for p in inherit or () if isinstance(p, str)] if isinstance(inherit, (list, tuple)) else []
        if not (name or parents or any("model" in b.lower() for b in bases)):
            return
        if not isinstance(name, str):
            name = None
        lower = [b.lower() for b in bases]
        shared = {
            "class_name": node.name, "description": _literal(attrs.get("_description")), "table_name": _literal(attrs.get("_table")), "rec_name": _literal(attrs.get("_rec_name")), "order_field": _literal(attrs.get("_order")),
            "abstract": any("abstract" in b for b in lower), "transient": any("transient" in b for b in lower), "line": node.lineno,
            "inherits_map": {k: v for k, v in (_literal(attrs.get("_inherits")) or {}).items() if isinstance(k, str) and isinstance(v, str)} if isinstance(_literal(attrs.get("_inherits")), dict) else {},
        }
        model = name or (parents[0] if parents else None)
        if name and (not parents or parents == [name]):
            kind = "primary" if not parents else "extension"
            yield "models", shared | {"name": name, "inherit_type": kind, "inherits": parents}
        elif name:
            yield "models", shared | {"name": name, "inherit_type": "primary", "inherits": parents}
        else:
            for p in parents:
                yield "models", shared | {"name": p, "inherit_type": "extension", "inherits": [p]}
        if model is None:
            return
        for field, value in self.assigned(node):
            if isinstance(value, ast.Call):
                callee = _dotted(value.func)
                kind = callee.rsplit(".", 1)[-1]
                if kind in FIELD_KINDS and (callee == kind or callee.startswith("fields.")):
                    yield "fields", self.field(model, field, kind, value)
        for x in node.body:
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                yield from self.method(model, x)

    def field(self, model: str, name: str, kind: str, call: ast.Call) -> dict:
        kw = {k.arg: k.value for k in call.keywords if k.arg}

        def flag(key: str, default: bool) -> bool:
            if key not in kw:
                return default
            value = _literal(kw[key])
            return bool(value) if value is not None or isinstance(kw[key], ast.Constant) else True

        def pairs(node: ast.AST | None) -> list[dict]:
            value = _literal(node)
            return [{"key": str(p[0]), "label": str(p[1])} for p in value if isinstance(p, (list, tuple)) and len(p) == 2] if isinstance(value, list) else []

        compute = self.text_of(kw.get("compute"))
        first = call.args[0] if call.args else None
        comodel = kw.get("comodel_name", first if kind in RELATIONAL else None)
        label = kw.get("string", first if kind not in (*RELATIONAL, "Selection", "Reference", "Float") else None)
        return {
            "model": model, "name": name, "field_type": kind, "comodel": self.text_of(comodel), "label": self.text_of(label), "required": flag("required", False), "readonly": flag("readonly", False),
            "store": flag("store", not compute), "copy": flag("copy", True), "index": flag("index", False), "tracking": flag("tracking", False) or flag("track_visibility", False), "compute": compute,
            "inverse": self.text_of(kw.get("inverse")), "search": self.text_of(kw.get("search")), "related": self.text_of(kw.get("related")), "default_value": self.source(kw.get("default")), "groups": self.text_of(kw.get("groups")),
            "help": self.text_of(kw.get("help")), "selection": pairs(kw.get("selection", first if kind == "Selection" else None)), "selection_add": pairs(kw.get("selection_add")),
            "digits": (f"[16, {_literal(kw['digits'])}]" if isinstance(_literal(kw["digits"]), int) else self.source(kw["digits"])) if "digits" in kw else None,
            "ondelete": self.text_of(kw.get("ondelete")), "domain": self.text_of(kw.get("domain")), "line": call.lineno,
        }

    def decorators(self, x) -> Iterator[tuple[str, list[str], dict[str, ast.AST], list[ast.AST], int]]:
        for d in x.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            args = call.args if call else []
            yield _dotted(call.func if call else d), [self.text_of(a) for a in args], {k.arg: k.value for k in call.keywords if k.arg} if call else {}, args, d.lineno

    def method(self, model: str, x) -> Iterator[Row]:
        row = {"model": model, "name": x.name, "decorators": [], "depends": [], "constrains": [], "onchange": [], "depends_context": [], "returns_model": None, "ormcache_keys": []}
        for name, args, _, _, line in self.decorators(x):
            row["decorators"].append(name)
            yield "decorators", {"model": model, "method": x.name, "decorator": name, "args": args, "line": line}
            last = name.rsplit(".", 1)[-1]
            if last in ("depends", "constrains", "onchange", "depends_context"):
                row[last] = row[last] + args
            elif last == "returns":
                row["returns_model"] = args[0] if args else None
            elif last.startswith("ormcache"):
                row["ormcache_keys"] = args
        body = "\n".join(self.lines[x.body[0].lineno - 1 : x.end_lineno])
        transitions, called, raises, sup = [], [], False, False
        for n in ast.walk(x):
            if isinstance(n, ast.Assign) and isinstance(n.value, ast.Constant) and isinstance(n.value.value, str):
                transitions += [(n.lineno, n.col_offset, n.value.value, t.attr) for t in n.targets if isinstance(t, ast.Attribute) and t.attr in STATE_FIELDS]
            elif isinstance(n, ast.Dict):
                transitions += [(k.lineno, k.col_offset, v.value, "state") for k, v in zip(n.keys, n.values) if isinstance(k, ast.Constant) and k.value == "state" and isinstance(v, ast.Constant) and isinstance(v.value, str)]
            elif isinstance(n, ast.Subscript) and isinstance(n.value, ast.Attribute) and n.value.attr == "env" and isinstance(n.slice, ast.Constant) and isinstance(n.slice.value, str):
                called.append((n.lineno, n.col_offset, n.slice.value))
            elif isinstance(n, ast.Raise) and n.exc is not None:
                raises = raises or _dotted(n.exc.func if isinstance(n.exc, ast.Call) else n.exc).rsplit(".", 1)[-1] == "ValidationError"
            elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "super":
                sup = True
        yield "methods", row | {
            "transitions": [{"from_state": None, "to_state": to, "field": f} for _, _, to, f in sorted(set(transitions))],
            "calls_models": list(dict.fromkeys(m for _, _, m in sorted(set(called)))), "raises_validation": raises, "calls_super": sup and bool(body),
            "line": min([x.lineno, *(d.lineno for d in x.decorator_list)]), "body_start": x.body[0].lineno, "body_end": x.end_lineno,
        }

    def controller(self, node: ast.ClassDef) -> Iterator[Row]:
        for x in node.body:
            if not isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                continue
            for name, _, kw, args, line in self.decorators(x):
                if name not in ("http.route", "route"):
                    continue
                first = _literal(args[0] if args else kw.get("route"))
                patterns = [first] if isinstance(first, str) else [p for p in first if isinstance(p, str)] if isinstance(first, (list, tuple)) else []
                if not patterns:
                    continue
                methods = _literal(kw.get("methods"))
                yield "routes", {
                    "pattern": patterns[0], "patterns": patterns, "auth": _literal(kw.get("auth")) or "user", "type": _literal(kw.get("type")) or "http", "methods": [str(m) for m in methods] if isinstance(methods, (list, tuple)) else ["GET", "POST"],
                    "csrf": _literal(kw["csrf"]) is not False if "csrf" in kw else True, "website": bool(_literal(kw.get("website"))), "params": list(dict.fromkeys(re.findall(r"<(?:[\w.()'\", ]+:)?(\w+)>", " ".join(patterns)))),
                    "controller": node.name, "method": x.name, "line": line,
                }


# ---- XML


def _qualify(xml_id: str | None, module: str) -> str | None:
    return None if not xml_id else xml_id if "." in xml_id else f"{module}.{xml_id}"


def _integer(text: str | None, default: int) -> int:
    t = (text or "").strip().lower()
    if t in ("true", "false"):
        return int(t == "true")
    return int(t) if re.fullmatch(r"-?\d+", t) else default


def _model_name(ref: str | None) -> str | None:
    last = (ref or "").rsplit(".", 1)[-1]
    return last[6:].replace("_", ".") if last.startswith("model_") else ref or None


class XmlFile:
    """Views, elements, actions, menus, jobs, templates, access and record rules of one XML text."""

    actions = {"ir.actions.act_window": "window", "ir.actions.server": "server", "ir.actions.client": "client", "ir.actions.report": "report", "ir.actions.report.xml": "report"}

    def __init__(self, text: str, module: str):
        self.module, self.broken = module, None
        try:
            self.root = ET.fromstring(text.encode())
        except ET.ParseError as e:
            self.root, self.broken = self.complete(text), e

    @staticmethod
    def complete(text: str) -> ET.Element:
        """What of a broken text is whole: the root, or its ``data``, with the children that end before the error."""
        parser = ET.XMLPullParser(events=("start", "end"))
        opened: list[ET.Element] = []
        try:
            parser.feed(text.encode())
            parser.close()
        except ET.ParseError:
            pass
        root = None
        try:
            for event, x in parser.read_events():
                if event == "start":
                    root = x if root is None else root
                    opened.append(x)
                else:
                    opened.pop()
        except ET.ParseError:
            pass
        for above, x in zip(opened, opened[1:]):
            if x.tag != "data":
                above.remove(x)
                break
        return ET.Element("data") if root is None else root

    def rows(self) -> Iterator[Row]:
        for group in [self.root, *self.root.findall("data")]:
            for x in group:
                if x.tag == "record":
                    yield from self.record(x)
                elif x.tag == "menuitem" and x.get("name"):
                    yield "menus", {"xml_id": _qualify(x.get("id"), self.module), "name": x.get("name"), "parent": _qualify(x.get("parent"), self.module), "sequence": _integer(x.get("sequence"), 10), "action": _qualify(x.get("action"), self.module), "groups": [g.strip() for g in (x.get("groups") or "").split(",") if g.strip()], "web_icon": x.get("web_icon")}
                elif x.tag == "template":
                    yield from self.qweb(x, x.get("id"), x.get("inherit_id"))

    @staticmethod
    def values(x: ET.Element) -> dict[str, ET.Element]:
        out: dict[str, ET.Element] = {}
        for f in x.findall("field"):
            out.setdefault(f.get("name") or "", f)
        return out

    def record(self, x: ET.Element) -> Iterator[Row]:
        f, xml_id, kind = self.values(x), _qualify(x.get("id"), self.module), x.get("model") or ""

        def value(name: str) -> str | None:
            e = f.get(name)
            if e is None:
                return None
            if e.get("ref"):
                return e.get("ref")
            if e.get("eval") is not None:
                try:
                    v = ast.literal_eval(e.get("eval"))
                    return None if v is None or v is False and name not in FLAGS else str(v)
                except (ValueError, SyntaxError):
                    m = re.fullmatch(r"\s*ref\(\s*['\"]([^'\"]+)['\"]\s*\)\s*", e.get("eval"))
                    return m[1] if m else None
            return (e.text or "").strip() or None

        def flag(name: str, default: bool) -> bool:
            v = value(name)
            return default if v is None else v.strip().lower() not in ("0", "false")

        def groups(name: str = "groups") -> list[str]:
            e = f.get(name)
            if e is None:
                return []
            refs = re.findall(r"ref\(\s*['\"]([^'\"]+)['\"]\s*\)", e.get("eval") or "")
            return refs or [g.strip() for g in (e.get("ref") or e.text or "").split(",") if g.strip()]

        if kind == "ir.ui.view" or kind == "ui.view":
            yield from self.view(x, f, xml_id, value)
        elif kind in self.actions:
            domain = value("domain")
            yield "actions", {
                "xml_id": xml_id, "action_type": self.actions[kind], "name": value("name"), "res_model": _model_name(value("res_model") or value("model_id") or value("model")), "view_mode": value("view_mode"), "domain": domain, "target": value("target"),
                "binding_model": _model_name(value("binding_model_id")), "method": value("code"), "tag": value("tag"), "report_name": value("report_name"), "domain_fields": list(dict.fromkeys(re.findall(r"\(\s*['\"](\w[\w.]*)['\"]\s*,", domain or ""))),
            }
        elif kind == "ir.ui.menu":
            yield "menus", {"xml_id": xml_id, "name": value("name"), "parent": _qualify(value("parent_id"), self.module), "sequence": _integer(value("sequence"), 10), "action": _qualify(value("action"), self.module), "groups": groups("groups_id"), "web_icon": value("web_icon")}
        elif kind == "ir.cron":
            model, method = _model_name(value("model_id")), value("function") or value("code")
            if model and method:
                yield "crons", {"xml_id": xml_id, "name": value("name"), "model": model, "method": method, "interval_number": _integer(value("interval_number"), 1), "interval_type": value("interval_type") or "days", "numbercall": _integer(value("numbercall"), -1), "priority": _integer(value("priority"), 5), "active": flag("active", True)}
        elif kind == "mail.template":
            if model := _model_name(value("model_id")):
                text = " ".join((e.text or "") + "".join(ET.tostring(c, "unicode") for c in e) for e in f.values())
                yield "mail_templates", {"xml_id": xml_id, "model": model, "subject": value("subject"), "refs": list(dict.fromkeys(a or b for a, b in re.findall(r"\$\{\s*(?:object|record)\.([\w.]+)|\{\{\s*(?:object|record)\.([\w.]+)", text)))}
        elif kind == "ir.model.access":
            yield "access_rules", {"xml_id": xml_id, "name": value("name"), "model": _model_name(value("model_id")), "group_id": value("group_id")} | {f"perm_{p}": flag(f"perm_{p}", False) for p in PERMS}
        elif kind == "ir.rule":
            yield "record_rules", {"xml_id": xml_id, "name": value("name"), "model": _model_name(value("model_id")), "domain": value("domain_force"), "groups": groups()} | {f"perm_{p}": flag(f"perm_{p}", True) for p in PERMS}

    def view(self, x: ET.Element, f: dict, xml_id: str | None, value) -> Iterator[Row]:
        arch = f.get("arch")
        fields, buttons, elements = [], [], []
        for e in arch.iter() if arch is not None else ():
            if e is arch or not isinstance(e.tag, str):
                continue
            row = {"view_xml_id": xml_id, "element_type": e.tag, "groups": e.get("groups"), "invisible": e.get("invisible"), "attrs": e.get("attrs")}
            if e.tag == "field":
                fields.append(e.get("name"))
                if any(e.get(k) for k in ("widget", "attrs", "groups", "invisible")):
                    elements.append(row | {"field_name": e.get("name"), "widget": e.get("widget"), "domain": e.get("domain")})
            elif e.tag == "button":
                buttons.append(e.get("name"))
                elements.append(row | {"button_name": e.get("name"), "button_type": e.get("type") or "object"})
            elif e.tag == "filter":
                elements.append(row | {"field_name": e.get("name"), "domain": e.get("domain")})
            elif e.tag == "xpath":
                elements.append(row | {"xpath": e.get("expr"), "position": e.get("position") or "inside"})
        inherit = value("inherit_id")
        root = next(iter(arch), None) if arch is not None else None
        kind = value("type") or (root.tag if root is not None and not inherit and root.tag in VIEW_TAGS else None)
        yield "views", {"xml_id": xml_id, "name": value("name"), "model": value("model"), "view_type": kind, "inherit_id": _qualify(inherit, self.module), "priority": _integer(value("priority"), 16), "field_names": list(dict.fromkeys(n for n in fields if n)), "button_names": list(dict.fromkeys(n for n in buttons if n)), "view_group": value("groups_id")}
        for e in elements:
            yield "elements", e

    def qweb(self, x: ET.Element, xml_id: str | None, inherit: str | None) -> Iterator[Row]:
        nodes = list(x.iter())
        calls = [e.get("t-call") for e in nodes if e.get("t-call")]
        fields = [e.get("t-field").split(".", 1)[-1] for e in nodes if e.get("t-field")]
        tests = [m for e in nodes if e.get("t-if") for m in re.findall(r"\.(\w+)", e.get("t-if"))]
        yield "qweb_templates", {"xml_id": _qualify(xml_id, self.module), "inherit_id": _qualify(inherit, self.module), "is_primary": not inherit, "kind": "report" if "report" in (xml_id or "") else "qweb", "t_calls": list(dict.fromkeys(calls)), "t_fields": list(dict.fromkeys(fields)), "t_if_fields": list(dict.fromkeys(tests))}


PERMS = ("read", "write", "create", "unlink")
FLAGS = frozenset(["active", *(f"perm_{p}" for p in PERMS)])
#: Root tags of a view's arch that name its type (fixed values).
VIEW_TAGS = frozenset(["form", "tree", "list", "kanban", "search", "calendar", "pivot", "graph", "gantt", "activity", "map", "cohort", "qweb"])


# ---- access CSV and JavaScript


def csv_rows(text: str) -> Iterator[Row]:
    def first(row: dict, *names: str) -> str | None:
        return next((row[n].strip() for n in names if row.get(n)), None)

    for row in csv.DictReader(io.StringIO(text)):
        model = _model_name(first(row, "model_id:id", "model_id", "model"))
        if model or first(row, "id"):
            yield "access_rules", {"xml_id": first(row, "id"), "name": first(row, "name"), "model": model, "group_id": first(row, "group_id:id", "group_id")} | {f"perm_{p}": first(row, f"perm_{p}") == "1" for p in PERMS}


#: Registry categories and what a registration there is (fixed values).
CATEGORIES = {"fields": "field_widget", "views": "view_widget", "actions": "action_handler", "systray": "systray_widget", "error_dialogs": "error_dialog", "services": "service"}
#: Methods of the record service, and functions that take a route (fixed values).
ORM_METHODS = frozenset(["call", "read", "write", "create", "unlink", "searchRead", "search"])
ROUTE_CALLS = frozenset(["jsonrpc", "rpc", "fetch"])
JS_PIECE = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<word>[\w$]+)|(?P<mark>.)""", re.S)


class Scripts:
    """The calls of a script: its pieces, and for each opening bracket what is called and with which first arguments."""

    def __init__(self, text: str):
        self.pieces = [(m.lastgroup, m[0], m.start()) for m in JS_PIECE.finditer(text) if m.lastgroup != "skip"]

    def value(self, i: int, *kinds: str) -> str | None:
        """The piece's text, strings without quotes, where it is of one of the kinds."""
        if not 0 <= i < len(self.pieces) or self.pieces[i][0] not in kinds:
            return None
        return self.pieces[i][1][1:-1] if self.pieces[i][0] == "str" else self.pieces[i][1]

    def is_mark(self, i: int, mark: str) -> bool:
        return self.value(i, "mark") == mark

    def owner(self, i: int) -> int:
        """Where the name stands that the name at ``i`` is taken from, -1 if from none."""
        return i - 2 if self.is_mark(i - 1, ".") else -1

    def second(self, i: int, *kinds: str) -> str | None:
        return self.value(i + 2, *kinds) if self.is_mark(i + 1, ",") else None

    def category(self, end: int) -> tuple[str, int] | None:
        """``registry.category("...")`` that ends at the closing bracket ``end``: the category and where it starts."""
        name = self.value(end - 1, "str")
        if not self.is_mark(end, ")") or name is None or not self.is_mark(end - 2, "(") or self.value(end - 3, "word") != "category":
            return None
        start = self.owner(end - 3)
        return (name.strip(), start) if self.value(start, "word") == "registry" else None

    def option(self, i: int, name: str) -> str | None:
        """The string under a name in the object that opens at ``i``."""
        depth = 0
        for j in range(i, len(self.pieces)):
            if self.pieces[j][0] == "mark":
                depth += (self.pieces[j][1] in "{[(") - (self.pieces[j][1] in "}])")
                if depth == 0:
                    return None
            elif depth == 1 and self.value(j, "word", "str") == name and self.is_mark(j + 1, ":"):
                return self.value(j + 2, "str")
        return None

    def calls(self) -> Iterator[tuple[int, dict]]:
        for i in range(1, len(self.pieces)):
            name = self.value(i - 1, "word") if self.is_mark(i, "(") else None
            if name is None:
                continue
            first, owner = self.value(i + 1, "str"), self.owner(i - 1)
            if name == "add" and first is not None and (found := self.category(owner)):
                what = CATEGORIES.get(found[0], f"{found[0]}_registration")
                yield found[1], {"kind": what, "class_name": self.second(i + 1, "word"), "action_tag" if found[0] == "actions" else "widget": first.strip()}
            elif name in ORM_METHODS and self.value(owner, "word") == "orm" and first is not None and re.fullmatch(r"[a-z][\w.]*", first):
                yield owner, {"kind": "orm_call", "model": first, "method": self.second(i + 1, "str")}
            elif name in ROUTE_CALLS and first is not None and first.startswith("/"):
                yield i - 1, {"kind": "rpc", "route": first}
            elif name == "_rpc" and self.is_mark(i + 1, "{") and (self.option(i + 1, "route") or "").startswith("/"):
                yield i - 1, {"kind": "legacy_rpc", "route": self.option(i + 1, "route")}


def js_rows(text: str) -> Iterator[Row]:
    script = Scripts(text)
    for at, row in script.calls():
        yield "js_components", row | {"line": text.count("\n", 0, script.pieces[at][2]) + 1}


def manifest_rows(text: str, module: str, path: str) -> Iterator[Row]:
    try:
        raw = ast.literal_eval(ast.parse(text.strip() or "{}", mode="eval").body)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        raw = {}
    raw = raw if isinstance(raw, dict) else {}

    def text_of(key: str) -> str | None:
        v = raw.get(key)
        return v.strip() or None if isinstance(v, str) else None

    depends = raw.get("depends")
    yield "modules", {
        "name": module, "path": path, "version": text_of("version"), "category": text_of("category"), "depends": [x for x in depends if isinstance(x, str)] if isinstance(depends, (list, tuple)) else [], "auto_install": bool(raw.get("auto_install", False)),
        "installable": bool(raw.get("installable", True)), "application": bool(raw.get("application", False)), "summary": text_of("summary") or text_of("name"), "description": text_of("description"), "author": text_of("author"), "website": text_of("website"),
    }


def file_rows(kind: str, module: str, path: str, text: str) -> Iterator[Row]:
    try:
        if kind == "manifest":
            yield from manifest_rows(text, module, path.rsplit("/", 1)[0])
        elif kind == "python":
            yield from PythonFile(text).rows()
        elif kind == "xml":
            found = XmlFile(text, module)
            yield from found.rows()
            if found.broken:
                raise found.broken
        elif kind == "csv":
            yield from csv_rows(text)
        else:
            yield from js_rows(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError, ET.ParseError, csv.Error) as e:
        yield "parse_errors", {"language": kind, "message": str(e)[:200]}


def facts(files: DataFrame) -> DataFrame:
    """``(tbl, module, data)``: all rows of all tables, from one parse per file; ``seq`` counts a file's rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for kind, module, path, text in zip(b["kind"], b["module"], b["path"], b["content"]):
                for i, (name, row) in enumerate(file_rows(kind, module, path, text or "")):
                    out.append((name, module, json.dumps({"module": module, "file": path, "seq": i} | row)))
            yield pd.DataFrame(out, columns=["tbl", "module", "data"])

    return files.select("kind", "module", "path", "content").mapInPandas(run, "tbl string, module string, data string")


def table_of(rows: DataFrame, name: str) -> DataFrame:
    return rows.where(F.col("tbl") == name).select(F.from_json("data", TABLES[name]).alias("r")).select("r.*")
