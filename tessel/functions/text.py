"""Scalar text functions used by extraction and queries, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def unquote(c: Column) -> Column:
    """The content of a simple string literal (prefixes b, r, f, u; single or triple quotes), else null."""
    simple = F.coalesce(
        F.nullif(F.regexp_extract(c, r'^[bBrRfFuU]*"([^"]*)"$', 0), F.lit("")),
        F.nullif(F.regexp_extract(c, r"^[bBrRfFuU]*'([^']*)'$", 0), F.lit("")),
        F.nullif(F.regexp_extract(c, r'^(?s)[bBrRfFuU]*"""(.*)"""$', 0), F.lit("")),
    )
    body = F.regexp_replace(simple, r"^[bBrRfFuU]*", "")
    return F.when(F.startswith(body, F.lit('"""')), F.substr(body, F.lit(4), F.length(body) - 6)).otherwise(F.substr(body, F.lit(2), F.length(body) - 2))


def contains_ci(c: Column, text: str) -> Column:
    """Substring match, letter case ignored; ``_`` and ``%`` in the text act as wildcards."""
    return c.ilike(f"%{text}%")


def suffix_or_equal(c: Column, name: str) -> Column:
    return (c == name) | c.ilike(f"%.{name}")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.lower(c)), r"[^a-z0-9_\s-]", ""), r"[\s_]+", "-")


def split_trim(c: Column, separator: str = ",") -> Column:
    return F.filter(F.transform(F.split(c, separator), lambda x: F.trim(x)), lambda x: x != "")


def qualify(xml_id: Column, module: Column) -> Column:
    return F.when(F.contains(xml_id, F.lit(".")), xml_id).otherwise(F.concat(module, F.lit("."), xml_id))


def model_of_id(c: Column) -> Column:
    """The model an access row's id names: ``model_a_b`` after the last dot becomes ``a.b``; other ids pass."""
    last = F.substring_index(c, ".", -1)
    return F.when(F.startswith(last, F.lit("model_")), F.replace(F.substr(last, F.lit(7)), F.lit("_"), F.lit("."))).otherwise(c)


def truth(c: Column, default: bool) -> Column:
    """A keyword's raw text as a flag: missing is the default, other text than False and 0 is true."""
    t = F.lower(F.trim(c))
    return F.when(c.isNull(), F.lit(default)).when(t.isin("false", "0"), False).otherwise(True)


def glob_regex(glob: str) -> str:
    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in glob)
    return f"^{out}$"


def mermaid_id(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9_]", "_")


def first_six(names: Column) -> Column:
    return F.concat(F.array_join(F.slice(names, 1, 6), ", "), F.when(F.size(names) > 6, ", …").otherwise(""))
