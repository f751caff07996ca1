"""Ranked full-text search: positional postings, terms, prefixes, phrases, booleans, BM25."""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.stem import stem, stems

TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75


#: Latin letters with marks and their bases
MARKED = {c: b for c in map(chr, range(0xC0, 0x250)) if (b := unicodedata.normalize("NFD", c)[0]) != c}


def unmarked(text: str) -> str:
    """Text whose Latin letters have lost their marks."""
    return text.translate(str.maketrans(MARKED))


def tokens(text: Column, fold: bool = False) -> Column:
    """Case-folded runs of letters and digits; ``.`` and ``_`` split; ``fold`` takes the marks off Latin letters."""
    text = F.translate(text, "".join(MARKED), "".join(MARKED.values())) if fold else text
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, key: str, columns: list[str], stemmed: bool = False, fold: bool = False) -> DataFrame:
    """``(key, col, pos, term)``, one row per token of each column."""
    parts = F.array(*(F.struct(F.lit(c).alias("col"), tokens(F.coalesce(F.col(c), F.lit("")), fold).alias("ts")) for c in columns))
    rows = docs.select(key, F.explode(parts).alias("p")).select(key, F.col("p.col").alias("col"), F.posexplode("p.ts").alias("pos", "term"))
    return rows.withColumn("term", stems("term")) if stemmed else rows


@dataclass
class Atom:
    """A term, prefix (``last*``) or phrase."""

    words: list[str]
    prefix: bool = False


def sanitize(query: str) -> str:
    """Raw where it uses operators; a single word becomes a prefix, several words a phrase."""
    if re.search(r'\b(AND|OR|NOT)\b|[*"()]', query, re.I):
        return query
    ws = query.split()
    return f'"{ws[0]}"*' if len(ws) == 1 else f'"{" ".join(ws)}"' if ws else ""


def parse(query: str) -> tuple:
    """A tree of ('atom', Atom), ('and'|'or'|'not', left, right); juxtaposition means and."""
    toks = re.findall(r'"[^"]*"\s*\*?|\(|\)|[^\s()"*]+\*?', query)
    pos = 0

    def atom():
        nonlocal pos
        if pos >= len(toks) or toks[pos] == ")":
            raise ValueError("syntax error in query")
        t = toks[pos]
        pos += 1
        if t == "(":
            inner = either()
            if pos >= len(toks) or toks[pos] != ")":
                raise ValueError("syntax error in query")
            pos += 1
            return inner
        ws = re.findall(r"[^\W_]+", t.lower())
        return ("atom", Atom(ws, t.endswith("*")))

    def both():
        nonlocal pos
        left = atom()
        while pos < len(toks) and toks[pos] not in (")", "OR"):
            if toks[pos] in ("AND", "NOT"):
                op = toks[pos].lower()
                pos += 1
            else:
                op = "and"
            left = (op, left, atom())
        return left

    def either():
        nonlocal pos
        left = both()
        while pos < len(toks) and toks[pos] == "OR":
            pos += 1
            left = ("or", left, both())
        return left

    tree = either()
    if pos < len(toks):
        raise ValueError("syntax error in query")
    return tree


def atom_hits(post: DataFrame, key: str, atom: Atom, stemmed: bool = False) -> DataFrame:
    """``(key, tf)`` of an atom: phrases are joins on position, prefixes range predicates on the term."""
    ws = [stem(w) if stemmed else w for w in atom.words]

    def of(i: int) -> DataFrame:
        w = ws[i]
        test = (F.col("term") >= w) & (F.col("term") < w + "￿") if atom.prefix and i == len(ws) - 1 else F.col("term") == w
        return post.where(test).select(key, "col", (F.col("pos") - i).alias("pos"))

    rows = of(0)
    for i in range(1, len(ws)):
        rows = rows.join(of(i), [key, "col", "pos"])
    return rows.groupBy(key).agg(F.count("*").alias("tf"))


def matches(post: DataFrame, key: str, tree: tuple, stemmed: bool = False) -> DataFrame:
    if tree[0] == "atom":
        return atom_hits(post, key, tree[1], stemmed).select(key)
    left, right = (matches(post, key, t, stemmed) for t in tree[1:])
    if tree[0] == "or":
        return left.union(right).distinct()
    return left.join(right, key, "left_semi" if tree[0] == "and" else "left_anti")


def _atoms(tree: tuple) -> list[Atom]:
    return [tree[1]] if tree[0] == "atom" else _atoms(tree[1]) + (_atoms(tree[2]) if tree[0] != "not" else [])


def bm25(post: DataFrame, key: str, tree: tuple, stemmed: bool = False) -> DataFrame:
    """``(key, score)`` of the matches, higher is better: k1 = 1.2, b = 0.75, idf floored at 1e-6."""
    sizes = post.groupBy(key).agg(F.count("*").alias("dl"))
    n_docs, avgdl = sizes.agg(F.count("*"), F.avg("dl")).first()
    found = matches(post, key, tree, stemmed).join(sizes, key)
    score = found.select(key, F.lit(0.0).alias("score"))
    for atom in _atoms(tree):
        hits = atom_hits(post, key, atom, stemmed)
        df = hits.count()
        idf = max(math.log((n_docs - df + 0.5) / (df + 0.5)), 1e-6)
        value = F.col("tf") * (idf * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / (avgdl or 1.0)))
        part = found.join(hits, key)
        score = score.unionByName(part.select(key, value.alias("score")))
    return score.groupBy(key).agg(F.sum("score").alias("score"))


def search(docs: DataFrame, key: str, columns: list[str], query: str, limit: int = 20, stemmed: bool = True) -> DataFrame:
    """Top matches ``(key, score)``, best first; the limit is clamped to 1..100."""
    post = postings(docs, key, columns, stemmed)
    ranked = bm25(post, key, parse(sanitize(query)), stemmed)
    return ranked.orderBy(F.desc(F.round("score", 9)), key).limit(max(1, min(100, limit)))


def snippet(text: Column, word: str, around: int = 40) -> Column:
    """The surroundings of the first hit, with the hit in ``<b>``."""
    at = F.instr(F.lower(text), word.lower())
    start = F.greatest(at - around, F.lit(1))
    cut = F.substr(text, start, F.lit(2 * around + len(word)))
    marked = F.regexp_replace(cut, f"(?i)({re.escape(word)})", "<b>$1</b>")
    return F.concat(F.when(start > 1, "…").otherwise(""), marked, F.when(start + 2 * around + len(word) <= F.length(text), "…").otherwise(""))
