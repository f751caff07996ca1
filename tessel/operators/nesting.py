"""Operator: deeply nested JSON records into flat tables that keep parent-child links.

A bottom-up tree automaton gives every object a shape state from its keys and its children's
states; the shapes route each object to a typed variant table, and all tables share the
supertype's keys ``(dump_id, view_no, elem_no, parent_no, depth)``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.session import spread

CHILD_KEYS = ("children", "elements", "nodes")
#: shape states of the automaton
SCALAR, LIST, OBJECT, FIELD, BUTTON, XPATH, CONTAINER, VIEW, DUMP, ENVELOPE = range(10)
#: element state -> its variant
VARIANT_OF = {FIELD: "field", BUTTON: "button", XPATH: "xpath", CONTAINER: "container"}
#: what an element's ``tag`` says of its shape (fixed values)
TAG_STATES = {"field": FIELD, "button": BUTTON, "xpath": XPATH}
#: variant of an element -> typed columns of its table besides the supertype's
VARIANTS = {
    "field": {"name": "string", "widget": "string", "options": "map<string,string>", "attrs": "map<string,string>"},
    "button": {"name": "string", "groups": "string", "attrs": "map<string,string>"},
    "xpath": {"expr": "string", "position": "string"},
    "container": {"name": "string", "groups": "string", "attrs": "map<string,string>"},
}
ELEMENT_SCHEMA = "dump_id long, view_no int, elem_no int, parent_no int, depth int, variant string, tag string, view_xml_id string, view_model string, attributes map<string,string>"
KEY_SCHEMA = "dump_id long, view_no int, elem_no int, parent_no int, depth int, variant string"


def _constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


class _Parser:
    """JSON without recursion, for documents nested deeper than the C parser allows."""

    token = re.compile(r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')

    def parse(self, text: str):
        stack: list = []
        pos, n, done, value = 0, len(text), False, None
        want = "value"
        while True:
            if want == "end":
                if text[pos:].strip(" \t\n\r"):
                    raise ValueError("trailing text")
                return value
            m = self.token.match(text, pos)
            if not m:
                raise ValueError(f"no token at {pos}")
            pos = m.end()
            mark = m.group(1)
            if want in ("value", "first"):
                if mark == "{":
                    stack.append([{}, None])
                    want = "key1"
                    continue
                if mark == "[":
                    stack.append([[], None])
                    want = "first"
                    continue
                if mark == "]" and want == "first":
                    value = stack.pop()[0]
                elif mark:
                    raise ValueError(f"unexpected {mark}")
                else:
                    value = json.loads(m.group(0).strip())
            elif want in ("key", "key1"):
                if mark == "}" and want == "key1":
                    value = stack.pop()[0]
                elif m.group(2):
                    stack[-1][1] = json.loads(m.group(2))
                    want = "colon"
                    continue
                else:
                    raise ValueError("a key was expected")
            elif want == "colon":
                if mark != ":":
                    raise ValueError("a colon was expected")
                want = "value"
                continue
            else:  # after a value inside a container
                if mark == ",":
                    want = "key" if isinstance(stack[-1][0], dict) else "value"
                    continue
                if mark != ("}" if isinstance(stack[-1][0], dict) else "]"):
                    raise ValueError("a comma or an end was expected")
                value = stack.pop()[0]
            if not stack:
                want = "end"
                continue
            box, key = stack[-1]
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            want = "next"


def parse_json(text: str):
    """The value of a strictly valid JSON text; ValueError for anything else."""
    try:
        return json.loads(text, parse_constant=_constant)
    except RecursionError:
        return _Parser().parse(text)


class ShapeAutomaton:
    """Bottom-up deterministic tree automaton over parsed JSON; states are kept by object identity.

    Transitions depend on the node's kind, its symbol (the keys of the alphabet it has and its
    tag), and its children's states only; they are computed once per distinct combination.  A list
    passes on what its items hide, so an envelope is one at any depth.
    """

    alphabet = frozenset(("tag", "arch", "xml_id", "views", "expr", *CHILD_KEYS))

    def __init__(self) -> None:
        self.delta: dict = {}

    def _step(self, keys: frozenset | None, tag: object, states: frozenset) -> int:
        if keys is None:
            return ENVELOPE if states & {DUMP, ENVELOPE} else LIST
        if "views" in keys:
            return DUMP
        if "arch" in keys or "xml_id" in keys and "tag" not in keys:
            return VIEW
        if states & {DUMP, ENVELOPE}:
            return ENVELOPE
        if "tag" in keys:
            return TAG_STATES.get(tag, CONTAINER) if tag is not None or "expr" not in keys else XPATH
        if "expr" in keys:
            return XPATH
        return CONTAINER if keys else OBJECT

    def run(self, root) -> dict[int, int]:
        states: dict[int, int] = {}
        delta, alphabet = self.delta, self.alphabet
        stack = [(root, False)]
        while stack:
            node, ready = stack.pop()
            kids = node.values() if isinstance(node, dict) else node
            inner = [k for k in kids if isinstance(k, (dict, list))]
            if inner and not ready:
                stack.append((node, True))
                stack.extend((k, False) for k in inner)
                continue
            below = frozenset(states[id(k)] for k in inner)
            if isinstance(node, dict):
                tag = node.get("tag")
                symbol = (frozenset(alphabet & node.keys()), tag if tag in ("field", "button", "xpath", None) else "other", below) if not isinstance(tag, (dict, list)) else (frozenset(alphabet & node.keys()), "other", below)
            else:
                symbol = (None, None, below)
            state = delta.get(symbol)
            if state is None:
                state = delta[symbol] = self._step(*symbol)
            states[id(node)] = state
        return states


def _objects(value) -> list[dict]:
    """The objects of a list, or a single object."""
    return [value] if isinstance(value, dict) else [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def _views(root, states: dict[int, int]) -> Iterator[dict]:
    """The views that the objects in state DUMP hold, in document order."""
    stack = [root]
    while stack:
        node = stack.pop()
        state = states.get(id(node), SCALAR)
        if state == DUMP:
            yield from _objects(node["views"])
        elif state == ENVELOPE:
            stack.extend(reversed([x for x in (node.values() if isinstance(node, dict) else node) if isinstance(x, (dict, list))]))


def _arch(view: dict) -> dict | None:
    arch = view.get("arch")
    while isinstance(arch, str):
        try:
            arch = parse_json(arch)
        except ValueError:
            return None
    return arch if isinstance(arch, dict) else None


def _text(value) -> str | None:
    """A value as text, lists and objects as JSON of any depth."""
    if value is None or isinstance(value, str):
        return value
    try:
        return json.dumps(value, ensure_ascii=False)
    except RecursionError:
        return _dump(value)


def _dump(root) -> str:
    """JSON text without recursion."""
    out: list[str] = []
    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, _Raw):
            out.append(x)
        elif isinstance(x, dict):
            parts: list = [_Raw("{")]
            for i, (k, v) in enumerate(x.items()):
                parts += [_Raw((", " if i else "") + json.dumps(k, ensure_ascii=False) + ": "), v]
            stack.extend(reversed([*parts, _Raw("}")]))
        elif isinstance(x, list):
            parts = [_Raw("[")]
            for i, v in enumerate(x):
                parts += [_Raw(", "), v] if i else [v]
            stack.extend(reversed([*parts, _Raw("]")]))
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


class _Raw(str):
    """Text that is output as it is."""


def flatten_payload(payload: str | None, automaton: ShapeAutomaton, full: bool = True) -> Iterator[tuple]:
    """Rows ``(view_no, elem_no, parent_no, depth, variant[, tag, xml_id, model, attributes])`` of one payload."""
    if payload is None:
        return
    try:
        root = parse_json(payload)
    except ValueError:
        return
    if not isinstance(root, (dict, list)):
        return
    states = automaton.run(root)
    for view_no, view in enumerate(_views(root, states), 1):
        arch = _arch(view)
        if arch is None:
            continue
        if isinstance(view.get("arch"), str):
            states = states | automaton.run(arch)  # it was hidden in a string
        xml_id, model = (_text(view.get("xml_id")), _text(view.get("model"))) if full else (None, None)
        count, stack = 0, [(arch, 0, 0)]
        while stack:
            element, parent, depth = stack.pop()
            count += 1
            below = [x for k in CHILD_KEYS if k in element for x in _objects(element[k])]
            if len(below) > 1 and sum(k in element for k in CHILD_KEYS) > 1:
                below = [x for k, v in element.items() if k in CHILD_KEYS for x in _objects(v)]
            variant = VARIANT_OF.get(states[id(element)], "container")
            if full:
                attributes = {k: t for k, v in element.items() if k not in CHILD_KEYS and k != "tag" and (t := _text(v)) is not None}
                yield view_no, count, parent, depth, variant, _text(element.get("tag")), xml_id, model, attributes
            else:
                yield view_no, count, parent, depth, variant
            stack.extend((x, count, depth + 1) for x in reversed(below))


def flatten_nested(df: DataFrame, key: str = "dump_id", payload: str = "payload", full: bool = True) -> DataFrame:
    """The supertype table: one row per element of every valid payload; ``full`` adds what the typed tables take.

    Null, empty and invalid payloads give no row; a view without ``arch`` takes a number but gives
    none; nesting may be of any depth; repeated payloads under different keys each give their rows;
    other columns of the input are not read.  One pass over the payloads, and no shuffle where the
    input has as many splits as the session has cores.
    """

    schema = ELEMENT_SCHEMA if full else KEY_SCHEMA

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ShapeAutomaton()
        names = [c.split()[0] for c in schema.replace("map<string,string>", "map").split(", ")]
        for batch in batches:
            rows: list[tuple] = []
            for dump_id, text in zip(batch["dump_id"], batch["payload"]):
                for row in flatten_payload(text, automaton, full):
                    rows.append((dump_id, *row))
                    if len(rows) >= 20_000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=names)

    rows = df.select(F.col(f"`{key}`").cast("long").alias("dump_id"), F.col(f"`{payload}`").alias("payload")).where("dump_id is not null and payload is not null")
    return spread(rows).mapInPandas(run, schema)


def variant_tables(elements: DataFrame) -> dict[str, DataFrame]:
    """The typed subtype tables, each with the supertype's keys and parent link, and the views.

    Columns have the types of ``VARIANTS``: scalars are text, option and attribute objects are maps
    (null where the value is no object).  A view's row is keyed as its root element is.
    """
    keys = ["dump_id", "view_no", "elem_no", "parent_no", "depth", "view_xml_id"]

    def typed(name: str, kind: str) -> Column:
        value = F.col("attributes")[name]
        return (F.from_json(value, kind) if kind != "string" else value).alias(name)

    out = {variant: elements.where(F.col("variant") == variant).select(*keys, "tag", *(typed(c, k) for c, k in columns.items())) for variant, columns in VARIANTS.items()}
    views = elements.where("elem_no = 1").select("dump_id", "view_no", "view_xml_id", "view_model", F.col("variant").alias("root_variant"), F.col("tag").alias("root_tag"))
    return out | {"views": views}
