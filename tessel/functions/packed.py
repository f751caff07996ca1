"""Splitting of fields that pack several values into one string, as Column expressions.

Quoted spans are replaced by indexed placeholders that cannot occur in the text (its own
private-use characters are escaped first), the rest is split at the delimiters, and the spans
come back through an array lookup.  No Python worker and no shuffle is involved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ESCAPE, OPEN, CLOSE, DQUOTE, SQUOTE, BACKSLASH = "\uf8f0", "\uf8f1", "\uf8f2", "\uf8f3", "\uf8f4", "\uf8f5"
PRIVATE = (ESCAPE, OPEN, CLOSE, DQUOTE, SQUOTE, BACKSLASH)
#: A quoted span opens at the start of a value; a span right after a span is a doubled quote.
QUOTED = r"""(?<![^\s,;|\[(\"])"[^"]*+"|(?<![^\s,;|\[('])'[^']*+'"""
DELIMITERS = r"[,;|\t\r\n\x0b\x0c]+"
DOTTED = r"^!?[\w.\-]*\w\.\w[\w.\-]*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value once, so that a lambda inside ``body`` does not evaluate it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^[\s ]+", ""), r"[\s ]+$", "")


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def _restore(token: Column, spans: Column) -> Column:
    def joined(b: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            span = F.get(b["spans"], F.substring_index(x, CLOSE, 1).cast("int"))
            rest = F.substring_index(x, CLOSE, -1)
            again = (rest == "") & (i < F.size(b["pieces"]) - 1)
            return F.when(i == 0, x).otherwise(
                F.concat(F.substr(span, F.lit(2), F.length(span) - 2), rest, F.when(again, F.substr(span, F.lit(1), F.lit(1))).otherwise(""))
            )

        return F.array_join(F.transform(b["pieces"], piece), "")

    bound = let(F.struct(F.split(token, OPEN, -1).alias("pieces"), spans.alias("spans")), joined)
    out = F.when(F.contains(token, F.lit(OPEN)), bound).otherwise(token)
    for mark, char in ((DQUOTE, '"'), (SQUOTE, "'"), (BACKSLASH, "\\")):
        out = _replace(out, mark, char)
    for i in reversed(range(len(PRIVATE))):
        out = _replace(out, f"{ESCAPE}{i}", PRIVATE[i])
    return _strip(out)


def packed_values(c: Column) -> Column:
    """The values of a packed field, in order: ``array<string>``.

    Delimiters are ``, ; |``, tabs and line ends; blanks delimit only between dotted names and
    quoted values, as display names hold blanks.  A list in brackets, quotes of either kind,
    doubled quotes and backslash escapes are undone.  Null, empty and all-delimiter texts give an
    empty array; repeated values stay; very long texts are split in linear time.
    """
    t = F.coalesce(c, F.lit(""))
    for i, char in enumerate(PRIVATE):
        t = _replace(t, char, f"{ESCAPE}{i}")
    t = _replace(_replace(_replace(t, "\\\\", BACKSLASH), '\\"', DQUOTE), "\\'", SQUOTE)
    t = _strip(t)

    def unwrapped(s: Column) -> Column:
        listed = F.startswith(s, F.lit("[")) & F.endswith(s, F.lit("]")) | F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")"))
        return F.when(listed & (F.length(s) >= 2), F.substr(s, F.lit(2), F.length(s) - 2)).otherwise(s)

    def chunk(x: Column) -> Column:
        return let(
            F.split(_strip(x), r"[\s ]+"),
            lambda ps: F.when(
                F.forall(ps, lambda p: F.rlike(p, F.lit(DOTTED)) | F.rlike(p, F.lit(f"^[{OPEN}{CLOSE}0-9]+$"))), ps
            ).otherwise(F.array(x)),
        )

    def values(s: Column) -> Column:
        masked = F.regexp_replace(s["t"], QUOTED, OPEN)
        indexed = F.array_join(
            F.transform(F.split(masked, OPEN, -1), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit(OPEN), (i - 1).cast("string"), F.lit(CLOSE), x))), ""
        )
        tokens = F.flatten(F.transform(F.split(indexed, DELIMITERS, -1), chunk))
        return F.filter(F.transform(tokens, lambda x: _restore(x, s["spans"])), lambda v: v != "")

    def bound(b: Column) -> Column:
        return let(F.struct(b.alias("t"), F.regexp_extract_all(b, F.lit(QUOTED), F.lit(0)).alias("spans")), values)

    return let(let(t, unwrapped), bound)
