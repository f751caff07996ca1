"""Text operators against brute force, exact round trips and edge cases."""

import ast
import random
import re
import warnings

import pytest
from pyspark.sql import functions as F

from tessel.llm import queries as q
from tessel.llm.gll import EOF, Grammar
from tessel.llm.grammars import parses
from tessel.llm.labels import LABELS, file_evidence, label_files
from tessel.llm.leakage import WindowIndex, edit_distance, find_leaks, words
from tessel.llm.packing import best_fit_decreasing, certificates, count_with_tokenizer, lower_bound, pack, token_count
from tessel.llm.spans import Grams, SuffixAutomaton, classes, document_shares, find_pairs, in_blocks, shared_spans, winnow
from tessel.llm.survivors import survivors
from tessel.llm.wellformed import check_files, failure_rates, well_formed
from tessel.session import table

# ---- parse checks


def test_gll_ambiguous_and_left_recursive():
    g = Grammar("S = S S | 'a' | ; T = S EOF ;", ("T",))
    a, end = 2 * g.kinds["a"], 2 * g.kinds[EOF]
    assert all(g.accepts([a] * n + [end]) for n in (0, 1, 2, 7)) and not g.accepts([a, end, a])
    g = Grammar("E = E '+' E | 'n' | '(' E ')' ; T = E EOF ;", ("T",))
    tok = lambda s: [2 * g.kinds[c] for c in s] + [end]
    assert g.accepts(tok("n+(n+n)+n")) and not g.accepts(tok("n+")) and not g.accepts(tok("(n"))


GOOD = {
    "py": ["", "x = 1\n", "match x:\n    case {'a': 1, **r} | [1, *_] if x: pass\n", "def f[T: int](a, /, b=1, *c, d, **e) -> int:\n    return (yield)\n", "f'{x!r:>{w}} {y=}'\n", "try:\n  pass\nexcept* E as e:\n  pass\n", "type X = int\ntype = 3\nmatch = type\n", "lambda *a, k=1: (b := a)\n", "a = b = *c, d\nx[1:2, ::3] += 1\n", "with (open(a) as b, c):\n    pass\n", "print(*a, **b, sep='')\n", "async def f():\n    async for x in y: await z\n", "x: lambda a: b = 3\nlambda a=1: a\n", "match: int = 3\ncase = type = 4\n", "if x: y: int = 1; z = 2\n", "a.b[c](d).e = f = yield g\n", "print(f'{x = } {a,b=}')\n"],
    "js": ["", "let a = b / c / d;", "x = /[/]\\//g.test(y)", "a\n++b", "const {a = 1, ...r} = o, [x, , y] = z", "class A extends B { #p = 1; static { f() } get x() { return this.#p } async *g() {} }", "`a${b}c${`d`}`", "for (const [k, v] of m) { label: while (1) break label }", "export default class {}", "import a, {b as c} from 'd'", "x = a ?? b?.c?.[0]?.()", "(a, b = 1, ...c) => ({})", "async x => await y", "if (a) b\nelse c", "do x(); while (y) z()", "a = b.c[d](e).f = [g, h.i = 1] = j", "for ([a.b, {c}] of d) e ||= f", "`a${b}`.c = d", "(-1) ** 2 ** -3", "a ?? b ?? c", "if (a) function f() {}", "async (a = 1, {b}) => c => d", "x: { y: z ? w : v }", "'\\u{10ffff}'", "var let1 = { async *a() {}, get: 1, set b(v) {}, [c]: d, e }", "({a, b: [c]} = d)"],
    "xml": ["<a/>", '<?xml version="1.0"?><!-- c --><a b="1&amp;"><![CDATA[<<]]>&#65;<b/></a>\n', '<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>', "<a:b xmlns:a='u'/>"],
    "csv": ["", "a,b\n1,2\n", 'a,b\r\n"x ""q"" \n y",\r\n', "one"],
}
BAD = {
    "py": ["x = ", "def f(\n", "print 'x'\n", "<<<<<<< HEAD\nx = 1\n=======\n", "raise A, b\n", "if x\n    pass\n", "x = 'abc\n", "f() = 1\n", "  x = 1\n y = 2\n", "a b\n", "for x in y\n    pass\n", "f(a=1, b)\n", "\0", "a + b = c\n", "a, b += c\n", "a += b = c\n", "(a, b): int\n", "def f(*): pass\n", "a := 1\n"],
    "js": ["let a = ;", "{", "function (", "a b", '{"a": 1}', "x = {a: 1,", "<<<<<<< HEAD", "interface A { b: string }", "return 1", "const a;", "`abc", "if (a) else b", "1 = 2", "import a from b", "/* open", "class A { x: number }", "x = 'a\nb'", "-1 ** 2", "a ?? b || c", "1.e", "08n", "'\\u{110000}'", "f() = 1", "({a = 1})", "a + b = c"],
    "xml": ["", "text", "<a>", "<a></b>", "<a b=1/>", "<a b='1' b='2'/>", "<a>&x;</a>", "<a/><b/>", "<a>a & b</a>", "<a><!-- -- --></a>", " <?xml version='1.0'?><a/>", "<a b='<'/>", "<a>]]></a>"],
    "csv": ["a,b\n1\n", 'a,b\n"x,2\n', 'a"b,c\n', '"a"b,c\n', "a,b\n\n1,2\n", "a\rb\n"],
}


@pytest.mark.parametrize("extension", list(GOOD))
def test_dialects(extension):
    for text in GOOD[extension]:
        assert parses(text, extension), text
    for text in BAD[extension]:
        assert not parses(text, extension) and not well_formed(text, extension), text


def test_grammar_agrees_on_truncations(spark, small):
    rng = random.Random(3)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for r in table(spark, small, "source_files").where("path like '%.py'").collect():
            text = r.content[: rng.randrange(len(r.content) + 1)]
            try:
                ast.parse(text)
                want = True
            except (SyntaxError, ValueError):
                want = False
            assert parses(text, "py") == want, text[-200:]


def test_deep_and_long_sources():
    assert parses("(" * 3000 + ")" * 3000 + ";", "js") is False and parses("[" * 3000 + "]" * 3000, "js")
    assert parses("<a>" * 5000 + "</a>" * 5000, "xml") and parses("x = 1\n" * 20000, "py")


def test_check_files_edges(spark):
    rows = [(1, "/r/a.PY", "x =", "r"), (2, "/r/b.js", None, "r"), (3, "/r/c.txt", "(", "r"), (4, None, "(", "r"), (5, "/r/d.xml", "", None), (6, "/r/e.csv", "", "r"), (6, "/r/e.csv", "", "r")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "file_id long, path string, content string, repo string, language string")
    got = sorted((r.file_id, r.language, r.well_formed) for r in check_files(df).collect())
    assert got == [(1, "py", False), (5, "xml", False), (6, "csv", True), (6, "csv", True)]
    rates = {(r.repo, r.language): r.broken_rate for r in failure_rates(check_files(df)).collect()}
    assert rates == {("r", "py"): 1.0, (None, "xml"): 1.0, ("r", "csv"): 0.0}
    assert check_files(df.limit(0)).count() == 0


# ---- file labels


def test_labels(spark):
    umd = "/**\n * @license thing 1.2.0\n * (c) thing authors. MIT.\n */\n;(function (r, f) { if (typeof define === 'function' && define.amd) { define([], f); } }(this, function () {}));\n"
    hand = "import os\n\n\nclass Reader:\n    def read(self, path):\n        with open(path) as f:\n            return f.read()\n\n    def close(self):\n        self.done = True\n"
    rows = [
        (1, "/s/p/r/m/static/vendor/a.js", umd), (2, "/s/p/r/m/static/vendor/b.js", "x = 1\n"), (3, "/s/p/r/m/models/a.py", hand), (4, "/s/p/r/m/models/__init__.py", ""), (5, "/s/p/r/m/models/n.py", None),
        (6, "/s/p/r/m/models/g.py", "# Generated by maker 1.2. DO NOT EDIT!\n" + "".join(f"T[{i}] = ({i}, {i})\n" for i in range(30))), (7, "/s/p/r/m/data/d.js", '{"rows": [' + ",".join(f'{{"id": {i}, "name": "value {i}"}}' for i in range(50)) + "]}"),
        (8, "/s/p/r/m/models/x.py", "<?xml version='1.0'?><a/>"), (9, None, "x"), (10, "c.py", hand), (11, "/s/p/r/m/static/src/m.js", "function a(b,c){for(var i=0,l=b.length;i<l;i++)b[i]&&b[i].x(c);return b}" * 20),
    ]
    df = spark.createDataFrame([(*r, "k") for r in rows], "file_id long, path string, content string, label string")
    got = {r.file_id: r.label for r in label_files(df).collect()}
    assert got == {1: "vendored", 2: got[2], 3: "hand", 4: "hand", 5: "hand", 6: "generated", 7: "blob", 8: "hand", 10: "hand", 11: "minified"}
    p = {r.file_id: r.p_hand for r in label_files(df).collect()}
    alone = {r.file_id: r.p_hand for r in label_files(df.where("file_id <> 1").withColumn("path", F.replace("path", F.lit("vendor"), F.lit("src")))).collect()}
    assert p[2] < alone[2]  # the directory and the sibling speak
    assert label_files(df.limit(0)).count() == 0
    assert len(file_evidence("a.py", "x" * 200_000)) == 5


def test_surroundings_decide_where_the_file_does_not(spark):
    """Belief propagation against the files' own evidence, on trees whose directories are of one kind."""
    rng = random.Random(6)
    head = "/* Copyright 2019 The Pell Authors. Licensed under MIT. */\n"
    plain = "var a{0} = {{}};\na{0}.x = {0};\n"
    rows, true = [], {}
    for d in range(40):
        kind = "vendored" if d % 2 else "hand"
        for f in range(8):
            i = d * 8 + f
            signed = kind == "vendored" and f < 5  # three of eight copies lost their head
            wordy = f"function readLines(path, done) {{\n  const found = open(path);\n  if (!found) {{\n    return done(new Error('gone'), {f});\n  }}\n  for (const line of found.lines()) {{\n    this.count += line.length;\n  }}\n  return done(null, this.count > 0 ? found : undefined);\n}}\n"
            rows.append((i, f"/srv/p/repo{d % 3}/mod{d}/static/src/pell{d}/f{f}.js", (head if signed else "") + (wordy if kind == "hand" else plain.format(rng.randrange(9)))))
            true[i] = kind
    df = spark.createDataFrame(rows, "file_id long, path string, content string")
    together = {r.file_id: r.label for r in label_files(df).collect()}
    alone = {i: LABELS[max(range(5), key=file_evidence(p, t).__getitem__)] for i, p, t in rows}
    right = lambda got: sum(got[i] == k for i, k in true.items()) / len(true)
    assert right(together) == 1.0 and right(alone) < 0.85


# ---- survivors


def brute_survivors(rows, columns):
    groups = {}
    for r in rows:
        model, member = r.model_name, r[columns[0]]
        if model is None or member is None:
            continue
        module = (r.module_name or "").strip().lower()
        if not module:
            m = re.match(r"/srv/+[^/]+/+[^/]+/+([^/]+)/", r.file_path or "")
            module = m[1].strip().lower() if m else None
        if module:
            groups.setdefault((model.strip().lower().replace("_", "."), member.strip().lower(), module), []).append(r)
    for g in groups.values():
        if len(g) > 1:
            key = min(r[columns[1]] for r in g)
            for c in columns[2:]:
                full = [r for r in g if r[c] is not None and r[c].strip() and not re.fullmatch(r"\[\s*\]", r[c].strip())]
                if full:
                    best = max(full, key=lambda r: (r.indexed_at, -r[columns[1]]))
                    yield key, c, best[columns[1]]


def test_survivors_equal_brute_force(spark, small):
    want = {("model_methods", *x) for x in brute_survivors(table(spark, small, "model_methods").collect(), ("method_name", "method_id", *q.METHODS))}
    want |= {("model_fields", *x) for x in brute_survivors(table(spark, small, "model_fields").collect(), ("field_name", "field_id", *q.FIELDS))}
    rows = [tuple(r) for r in q.p5_found(spark, small).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_currency_without_timestamps(spark):
    timed = [(i, f"g{i // 2}", ["low", "high"][i % 2], i) for i in range(20)] + [(30, "h", "high", 30), (31, "h", "low", 31), (32, "one", "low", 32)]
    rows = timed + [(40, "u", "high", None), (41, "u", "low", None), (42, "u", " ", None), (43, "v", "odd", None), (44, "v", "low", None), (45, None, "x", None), (46, None, "x", None)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "id long, name string, v string, t int, key string, n int")
    got = {r.group_id: r.row_id for r in survivors(df, "id", [F.col("name")], ["v"], "t", "x").collect()}
    assert got[40] == 40 and got[30] == 31 and got[0] == 1 and got[43] == 43
    assert 32 not in got and 45 not in got
    assert survivors(df.limit(0), "id", [F.col("name")], ["v"], "t", "x").count() == 0


def test_currency_through_missing_values(spark):
    """Learnt a -> b and b -> c: of {a, c} without timestamps c is the later, though no group shows a -> c."""
    rows = [(0, "g", "a", 1), (1, "g", "b", 2), (2, "h", "b", 1), (3, "h", "c", 2), (10, "u", "a", None), (11, "u", "c", None)]
    # timed and untimed together: what follows the latest timestamped value survives, what is before or apart does not
    rows += [(20, "m", "a", 5), (21, "m", "c", None), (30, "w", "c", 5), (31, "w", "a", None), (40, "x", "b", 5), (41, "x", "apart", None), (50, "y", "a", None), (51, "y", "a", 3)]
    # a cycle of three leaves no value later than another
    rows += [(60, "k1", "p", 1), (61, "k1", "q", 2), (62, "k2", "q", 1), (63, "k2", "r", 2), (64, "k3", "r", 1), (65, "k3", "p", 2), (70, "z", "q", None), (71, "z", "p", None), (72, "z", "r", None)]
    df = spark.createDataFrame(rows, "id long, name string, v string, t int")
    got = {r.group_id: r.row_id for r in survivors(df, "id", [F.col("name")], ["v"], "t", "x").collect()}
    assert got == {0: 1, 2: 3, 10: 11, 20: 21, 30: 30, 40: 40, 50: 51, 60: 61, 62: 63, 64: 65, 70: 70}


def test_currency_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, f"g{rng.randrange(60)}", f"v{rng.randrange(9)}", None if rng.random() < 0.4 else rng.randrange(1000)) for i in range(400)]
    net: dict = {}
    groups: dict = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    for g in groups.values():
        timed = sorted((r for r in g if r[3] is not None), key=lambda r: (r[3], r[0]))
        for x, y in zip(timed, timed[1:]):
            if x[2] != y[2]:
                net[x[2], y[2]] = net.get((x[2], y[2]), 0) + 1
                net[y[2], x[2]] = net.get((y[2], x[2]), 0) - 1
    after: dict = {}
    for (x, y), n in net.items():
        if n > 0:
            after.setdefault(x, set()).add(y)

    def reach(x):
        seen, todo = set(), [x]
        while todo:
            todo += [y for y in after.get(todo.pop(), ()) if y not in seen and not seen.add(y)]
        return seen

    want = {}
    for g in groups.values():
        timed = max((r for r in g if r[3] is not None), key=lambda r: (r[3], -r[0]), default=None)
        held = {} if timed is None else {timed[2]: (False, timed[0])}
        for r in g:
            if r[3] is None:
                held[r[2]] = min(held.get(r[2], (True, r[0])), (True, r[0]))
        latest = [v for v in held if not any(w in reach(v) and v not in reach(w) for w in held if w != v)]
        if len(g) > 1:
            want[min(r[0] for r in g)] = min(held[v] for v in latest)[1]
    df = spark.createDataFrame(rows, "id long, name string, v string, t int")
    assert {r.group_id: r.row_id for r in survivors(df, "id", [F.col("name")], ["v"], "t", "x").collect()} == want


# ---- packing


def test_bounds_and_packing():
    rng = random.Random(5)
    for _ in range(30):
        sizes = [rng.randrange(0, 101) for _ in range(rng.randrange(1, 200))]
        bins = best_fit_decreasing(sizes, 100)
        fill = {}
        for s, b in zip(sizes, bins):
            fill[b] = fill.get(b, 0) + s
        assert max(fill.values()) <= 100 and lower_bound(sizes, 100) <= len(fill)
    assert lower_bound([51] * 7, 100) == 7 and lower_bound([34] * 6, 100) >= 3 and lower_bound([], 100) == 0


def test_pack_round_trip(spark):
    rows = [(i, [None, 0, 5, 30, 70, 100, 101, 250][i % 8]) for i in range(400)] + [(7, 250)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    out = pack(df, capacity=100, per_partition=50).collect()
    fill = {}
    for r in out:
        fill[r.container_id] = fill.get(r.container_id, 0) + r["size"]
    assert max(fill.values()) <= 100
    assert sum(r["size"] for r in out) == sum(n or 0 for _, n in rows)
    assert {r.doc_id for r in out if r.n_pieces > 1} == {i for i, n in rows if (n or 0) > 100}
    assert len(fill) <= 1.1 * sum(n or 0 for _, n in rows) / 100 + 2
    assert pack(df.limit(0)).count() == 0


def test_exchange_closes_gaps(spark):
    """Many small partitions waste a bin or more each; exchanges close the partitions' gaps, and the certificates add up."""
    rng = random.Random(9)
    sizes = [rng.choice([rng.randrange(1, 30), rng.randrange(20, 60), rng.randrange(40, 100)]) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long")
    packed = pack(df, capacity=100, per_partition=100)
    fill, items = {}, packed.collect()
    for r in items:
        fill[r.container_id] = fill.get(r.container_id, 0) + r["size"]
    proof = certificates(packed).collect()
    assert max(fill.values()) <= 100 and sum(fill.values()) == sum(sizes) == sum(r.filled for r in proof) and len(items) == 3000
    assert len(fill) == sum(r.n_bins for r in proof) and all(r.gap == r.n_bins - r.bound >= 0 for r in proof)
    alone = sum(len(set(best_fit_decreasing(sizes[k : k + 100], 100))) for k in range(0, 3000, 100))
    # a closed partition may still round up by less than a container
    assert lower_bound(sizes, 100) <= len(fill) < alone and sum(r.gap for r in proof) <= 2 and len(fill) <= lower_bound(sizes, 100) + len(proof)


def test_token_count(spark):
    texts = ["", None, "a b", "naïve_1 -- x!", "ein  Wörtchen,\n(ja)", "日本 a\u00a0b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.n for r in df.select(token_count(F.col("t")).alias("n")).collect()]
    assert got == [len(re.findall(r"\w+|[^\w\s]+", t or "")) for t in texts]


def test_public_tokenizer(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in count_with_tokenizer(docs, "/opt/tokenizers/byte_bpe_50k.json").collect()}
    assert got == {1: 2, 2: 0}


# ---- leakage


def test_leaks_equal_brute_force(spark, small):
    items = {r.item_id: words(r.text) for r in table(spark, small, "eval_items").collect()}
    grams = {}
    for i, w in items.items():
        for p in range(len(w) - 12):
            grams.setdefault(tuple(w[p : p + 13]), set()).add(i)
    want = set()
    for r in table(spark, small, "documents").collect():
        w = words(r.text)
        for p in range(len(w) - 12):
            want |= {(r.doc_id, i) for i in grams.get(tuple(w[p : p + 13]), ())}
    rows = [tuple(r) for r in q.p9_found(spark, small).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_near_leaks_recall():
    rng = random.Random(1)
    text = " ".join(f"w{rng.randrange(400)}" for _ in range(40))
    index = WindowIndex([(1, text)], 13, 2, 8, 6)
    found = 0
    for _ in range(100):
        w = text.split()[5:30]
        for _ in range(1):
            w[rng.randrange(10, 15)] = "other"
        found += 1 in index.find(" ".join(["x"] * 5 + w))
    assert found >= 90
    assert edit_distance([1, 2, 3], [1, 3], 2) == 1 and edit_distance([1, 2], [3, 4], 1) is None


def test_near_leaks_equal_brute_force():
    rng = random.Random(2)

    def edited(passage, kind):
        w = list(passage)
        for p in sorted(rng.sample(range(1, len(w) - 1), 2), reverse=True):
            w[p : p + 1] = {"change": ["other"], "leave out": [], "put in": [w[p], "other"]}[kind]
        return w

    for kind in ("change", "leave out", "put in"):
        for _ in range(100):
            passage = [f"w{rng.randrange(400)}" for _ in range(13)]
            text = ["x"] * rng.randrange(3) + edited(passage, kind) + ["y"] * rng.randrange(3)
            assert WindowIndex([(1, " ".join(passage))], 13, 2, 8, 6).find(" ".join(text)).get(1, 9) <= 2, kind
    # few words, so that many windows come near; runs of all lengths that two edits can reach
    for _ in range(60):
        item, text = ([f"w{rng.randrange(3)}" for _ in range(n)] for n in (10, rng.randrange(25)))
        runs = [text[a : a + n] for a in range(len(text)) for n in range(6, 11)]
        found = [e for p in range(3) for r in runs if (e := edit_distance(r, item[p : p + 8], 2)) is not None]
        assert WindowIndex([(1, " ".join(item))], 8, 2, 8, 6).find(" ".join(text)) == ({1: min(found)} if found else {})


def test_leak_edges(spark):
    line = "One two THREE four five six seven eight nine ten eleven twelve thirteen fourteen"
    docs = spark.createDataFrame([(1, "x " + line.lower().replace(" ", ", ") + " y", 0), (2, None, 0), (3, "", 0), (4, " ".join(line.split()[:12]), 0), (1, line, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, line), (8, line), (9, None), (10, "short")], "item_id long, text string")
    assert {tuple(r) for r in find_leaks(docs, items, block_items=1).collect()} == {(1, 7, 0), (1, 8, 0)}
    assert find_leaks(docs, items.limit(0)).count() == 0 and find_leaks(docs.limit(0), items).count() == 0


# ---- shared spans


def test_pairs_equal_brute_force(spark, small):
    docs = table(spark, small, "documents")
    holders = {}
    for r in docs.collect():
        for p in range(len(r.text or "") - 299):
            holders.setdefault(r.text[p : p + 300], set()).add(r.doc_id)
    want = {(a, b) for v in holders.values() for a in v for b in v if a < b}
    rows = [tuple(r) for r in q.p10_found(spark, small).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_hot_boilerplate_and_copies(spark):
    rng = random.Random(2)
    rand = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    short, long = rand(250), rand(310)
    texts = [rand(200) + short + rand(200) for _ in range(80)] + [rand(100) + long + rand(100) for _ in range(70)] + [long] * 3 + ["z" * 900] * 2 + [None, "", "q" * 299, "q" * 299]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {tuple(r) for r in find_pairs(df).collect()}
    hot = range(80, 153)
    assert rows == {(a, b) for a in hot for b in hot if a < b} | {(153, 154)}
    assert find_pairs(df.limit(0)).count() == 0


def test_automaton_and_shares(spark):
    a = SuffixAutomaton("abcabxabcd")
    assert [m for m, _ in a.statistics("zabcdab")] == [0, 1, 2, 3, 4, 1, 2]
    assert a.spans("zabcdabx", 3) == [(1, 5), (5, 8)] and a.shares("xabc", 4) and not a.shares("zzz", 1)
    h = Grams()("the quick brown fox " * 3, 5)
    assert h[0] == h[20] == h[40] and len(set(h[:20].tolist())) == 20
    assert set(winnow(h, 7)) <= set(range(len(h))) and max(b - x for x, b in zip(sorted(winnow(h, 7)), sorted(winnow(h, 7))[1:])) <= 7
    docs = spark.createDataFrame([(1, "x" * 5 + "abcdefgh"), (2, "abcdefgh" + "y" * 8), (3, None)], "doc_id long, text string")
    members = classes(docs)
    got = {r.doc_id: (r.shared_chars, r.share) for r in document_shares(docs, members, shared_spans(docs, members, 6), 6).collect()}
    assert got == {1: (8, 0.615385), 2: (8, 0.5), 3: (0, 0.0)}


def test_shards_in_blocks(spark, monkeypatch):
    """Groups far larger than a block: every pair once, whatever meets where."""
    monkeypatch.setattr("tessel.llm.spans.BLOCK", 8)
    rng = random.Random(3)
    rand = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    long = rand(320)
    texts = [rand(60) + long + rand(60) for _ in range(60)] + ["w" * 400] * 30 + [long[:299] + "!"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])], "doc_id long, text string")
    rows = [tuple(r) for r in find_pairs(df).collect()]
    want = {(a, b) for a in range(60) for b in range(60) if a < b} | {(a, b) for a in range(60, 90) for b in range(60, 90) if a < b}
    assert len(rows) == len(set(rows)) and set(rows) == want
    members = classes(df)
    holders: dict = {}
    for i, t in enumerate(texts):
        for p in range(len(t) - 299):
            holders.setdefault(t[p : p + 300], set()).add(i if t[0] != "w" else 60)
    want = {(i, p) for i, t in enumerate(texts[:61]) for p in range(len(t) - 299) if len(holders[t[p : p + 300]]) > 1}
    spans = shared_spans(df, members).collect()
    assert {(r.doc_id, p) for r in spans for p in range(r.start, r.end - 299)} == want and all(r.other_id != r.doc_id for r in spans)
    assert in_blocks(spark.createDataFrame([(i, 20) for i in range(20)], "i long, n long"), "n", "i").count() == 60


def test_shares_and_spans_of_every_document(spark, tmp_path):
    rng = random.Random(5)
    a, b, c = ("".join(rng.choices("abcdefgh ", k=n)) for n in (400, 350, 500))
    texts = {1: a, 2: a, 3: a, 4: b, 5: c + b, 6: "short", 7: "short", 8: None, 9: c, 10: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.class_id, r.n_chars, r.shared_chars, r.share, r.n_copies) for r in q.p10_shares(spark, str(tmp_path)).collect()}
    copies = {i: (1, 400, 400, 1.0, 3) for i in (1, 2, 3)}
    small = {6: (6, 5, 0, 0.0, 2), 7: (6, 5, 0, 0.0, 2), 8: (8, 0, 0, 0.0, 1), 10: (10, 0, 0, 0.0, 1)}
    assert got == copies | small | {4: (4, 350, 350, 1.0, 1), 5: (5, 850, 850, 1.0, 1), 9: (9, 500, 500, 1.0, 1)}
    spans = {(r.doc_id, r.class_id, r.other_class_id, r.start, r.end) for r in q.p10_spans(spark, str(tmp_path)).collect()}
    across = {(4, 4, 5, 0, 350), (5, 5, 4, 500, 850), (5, 5, 9, 0, 500), (9, 9, 5, 0, 500)}
    assert {s[:3] for s in spans} == {s[:3] for s in across} | {(i, 1, 1) for i in (1, 2, 3)} and spans == across | {(i, 1, 1, 0, 400) for i in (1, 2, 3)}


def test_records_of_both_tables(spark, tmp_path):
    at = "model_name string, module_name string, file_path string, indexed_at long"
    methods = [(1, "f", "a", None, "Sale_order", "m", None, 1), (2, "F ", "b", "t", "sale.order", None, "/srv/p/r/m/x.py", 2), (3, "g", "a", "t", "sale.order", "m", None, 1)]
    fields = [(1, "x", "old", "help", "a.b", "m", None, 1), (4, "X", "new", " ", "a.b", "M", None, 2)]
    spark.createDataFrame(methods, f"method_id long, method_name string, calls_models string, state_transitions string, {at}").write.parquet(f"{tmp_path}/model_methods.parquet")
    spark.createDataFrame(fields, f"field_id long, field_name string, string_label string, help_text string, {at}").write.parquet(f"{tmp_path}/model_fields.parquet")
    assert {tuple(r) for r in q.p5_records(spark, str(tmp_path)).collect()} == {
        ("model_methods", 1, "sale.order", "f", "m", "b", "t", None, None),
        ("model_fields", 1, "a.b", "x", "m", None, None, "new", "help"),
    }
