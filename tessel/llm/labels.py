"""Operator: generated, minified, vendored and blob files told from hand-written ones.

Each file's text and name give evidence for five labels; belief propagation over the directory
tree (sum-product in log space, one pass up, one down) adds what its directory, the siblings and
the directories above suggest.  A file without signs of its own takes its directory's label where
most siblings are clear; a clear file keeps its own.  The tree's levels are DataFrames of directories, so a directory may
hold any number of files: its messages are summed by partial aggregation.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import cut, spread

LABELS = ("hand", "generated", "minified", "vendored", "blob")
#: log potential of a child's label under its directory's, over a flat one
SAME, OTHER = math.log(0.76), math.log(0.06)
#: log prior of a file's label
PRIOR = (math.log(0.7), math.log(0.08), math.log(0.06), math.log(0.1), math.log(0.06))

GENERATED_NOTE = re.compile(
    r"(?i)@generated\b|\bauto-?generated\b|\bautomatically (?:generated|created|produced)\b|\b(?:created|generated|written|produced) automatically\b|\b(?:generated|produced|compiled|created) (?:by|from|with|using) (?:the )?\S+|"
    r"\bproduced by the\b|\boutput of\b|\bdo not (?:edit|modify)\b|\b(?:will be|be) (?:overwritten|lost)\b|\bautomatisch (?:erzeugt|generiert)\b|\bnicht (?:bearbeiten|editieren)\b|\bg[ée]n[ée]r[ée] (?:automatiquement|par)\b|\bne pas modifier\b|\bgenerado (?:autom[áa]ticamente|por)\b|\bno (?:editar|modificar)\b"
)
TOOL = re.compile(r"(?i)\b(?:v(?:ersion)?\s?\d|\d+\.\d+|--\w+|\.ya?ml|compiler|tool\b|run of|source:|@generated|`)")
COPYRIGHT = re.compile(r"(?i)copyright\s+(?:\(c\)|©)?\s*\d{4}|\(c\)\s+(?:\d{4}|\w[\w-]* (?:authors|team|contributors|developers))|@license\b|released under the\b|distributed under the\b|\blicen[cs]ed? (?:under|:)|\bgoverned by\b|\blicen[cs]e \([A-Z]|^/\*! ?\S+ v?\d+\.\d+")
UPSTREAM = re.compile(r"(?i)\bupstream (?:project|version)|\bbundled copy\b|\bvendored\b|\bunmodified\b")
UMD = re.compile(r"typeof define\s*===?\s*['\"]function['\"]\s*&&\s*define\.amd|typeof exports\s*===?\s*['\"]object['\"]")
BUNDLE = re.compile(r"(?:\A|\n)/\*{3,}/")
#: what bundlers leave in their output
BUNDLER_MARKS = ("__webpack_", "parcelRequire", "\n//# sourceMappingURL=")
OTHER_LANGUAGE = re.compile(r"\A\s*(?:<\?xml|<!|<[A-Za-z][\w:.-]*[\s>/])")
#: a header of names and rows of as many fields: delimited text under this name
DELIMITED = re.compile(r"\A\w+(?:,[\w/. ]+)+\n[^\n(){}=;]*,[^\n]*(?:\n|\Z)")
CSS = re.compile(r"(?m)^\s*[.#@]?[\w.#>:,\s-]+\{\s*$\n\s*[\w-]+\s*:[^{}]*;\s*$")
LITERAL = re.compile(r"""[bru]?"(?:[^"\\\n]|\\.)*+"|[bru]?'(?:[^'\\\n]|\\.)*+'|(?<![\w.])-?\d[\w.]*""")
WORD = re.compile(r"[^\W\d]\w*")
VALUES = re.compile(r"0(?:[ \t]*,[ \t]*0)+")
BLANKS = re.compile(r"[ \t]+")
ESCAPED = re.compile(r"\\x[0-9a-fA-F]{2}")
ENCODED = re.compile(r"[A-Za-z0-9+/=]{400}")
COMMENT = {"py": re.compile(r"\A(?:\s|#[^\n]*|[rRuU]?\"\"\"[\s\S]*?\"\"\"|[rRuU]?'''[\s\S]*?'''|['\"]use strict['\"];?)*"), "js": re.compile(r"\A(?:\s|//[^\n]*|/\*[\s\S]*?\*/|['\"]use strict['\"];?)*")}
CODE = re.compile(r"\b(?:def|class|function|return|if|for|while|import|from|export|try|switch|lambda|yield|await)\b|=>")
CONFLICT = re.compile(r"(?m)^(?:<{7}|={7}|>{7}|\|{7})(?: [^\n]*)?$\n?")
FILE_NAME = re.compile(r"(?i)(?P<minified>[.-]min\.js$)|(?P<bundle>\.bundle\.js$)|(?P<generated>(?:_pb2?|\.gen|_gen|[._-]generated)\.(?:py|js)$)|(?P<vendored>-\d+\.\d+(?:\.\d+)*\.js$)")
VENDOR_DIRECTORY = re.compile(r"(?i)^_?(?:vendor(?:ed)?|third[_-]?party|node_modules|bower_components|external|externals|ext|extern|libs?|deps|site-packages)$")
BUILD_DIRECTORY = re.compile(r"(?i)^_?(?:dist|build|gen|generated|out)$")


def signs(path: str, text: str) -> list[float]:
    """What a file's name and whole text say for each of ``LABELS``."""
    e = [0.0] * len(LABELS)
    hand, generated, minified, vendored, blob = range(5)
    language = path.rsplit(".", 1)[-1].lower()
    text = CONFLICT.sub("", text.replace("\r\n", "\n"))
    name = FILE_NAME.search(path)
    if name:
        for kind, label, weight in (("minified", minified, 2.0), ("bundle", generated, 2.0), ("generated", generated, 2.5), ("vendored", vendored, 2.0)):
            if name[kind]:
                e[label] += weight
    body = text.strip()
    if not body:
        e[hand] += 6
        return e
    if OTHER_LANGUAGE.match(body) or DELIMITED.match(body) or not CODE.search(uncommented := re.sub(r"/\*[\s\S]*?\*/", "", body)) and CSS.search(uncommented):
        e[hand] += 8  # another language's source under this name
        return e
    head = COMMENT.get(language, COMMENT["js"]).match(text)[0]
    lines = [x for x in body.split("\n") if x.strip()]
    letters = len("".join(body.split())) or 1

    notes = [x for x in re.split(r"\n", head) if GENERATED_NOTE.search(x)]
    if notes:
        e[generated] += 1.0 + (5.0 if any(TOOL.search(x) or len(GENERATED_NOTE.findall(x)) > 1 or re.search(r"(?i)overwritten|lost", x) for x in notes) else 0)
    if any(m in text for m in BUNDLER_MARKS) or "***/" in text and BUNDLE.search(text):
        e[generated] += 7
    if COPYRIGHT.search(head):
        e[vendored] += 7
    if UPSTREAM.search(head):
        e[vendored] += 7
    if UMD.search(text):
        e[vendored] += 6

    # hand-written code is wordy and varied; tables and stubs repeat one shape of line
    bare = LITERAL.sub("0", body)
    shapes = Counter(x.strip() for x in WORD.sub("w", VALUES.sub("0", BLANKS.sub(" ", bare))).split("\n") if x.strip())
    n_lines = len(lines)
    repeated = 1 - len(shapes) / n_lines
    longest, average = max(map(len, lines)), len(body) / n_lines
    literal = 1 - len("".join(bare.replace("0", "").split())) / letters
    words = WORD.findall(bare)
    short = sum(len(w) <= 3 for w in words) / (len(words) or 1)
    code = len(CODE.findall(bare))
    if literal > 0.55 and code <= 2:
        e[blob] += 5 + 3 * (literal > 0.8)
    elif n_lines >= 6 and repeated > 0.7:
        e[generated] += 5
    elif n_lines >= 6 and repeated > 0.55:
        e[generated] += 1.5
    if language == "js" and average > 150 and code > 2:
        e[minified] += 4 + 2 * (short > 0.6)
    elif language == "js" and short > 0.72 and average > 60:
        e[minified] += 2
    if "\\x" in body and 4 * len(ESCAPED.findall(body)) > 0.6 * letters or longest > 2000 and ENCODED.search(body):
        e[blob] += 6
    if longest > 2000 and code <= 2:
        e[blob] += 3
    if re.match(r"\s*[\[{]", body) and literal > 0.4 and code <= 1:
        e[blob] += 6
    if len(shapes) >= 8 and repeated < 0.5 and average < 100:
        e[hand] += 1.5
    return e


def file_evidence(path: str, text: str) -> list[float]:
    """Log evidence for each of ``LABELS``: the prior and the signs."""
    return [p + s for p, s in zip(PRIOR, signs(path, text))]


COMPATIBLE = np.full((len(LABELS), len(LABELS)), OTHER) + np.eye(len(LABELS)) * (SAME - OTHER)


def message(beliefs: np.ndarray) -> np.ndarray:
    """Per row and label at the other end: log-sum of belief and compatibility."""
    x = beliefs[:, None, :] + COMPATIBLE[None, :, :]
    top = x.max(axis=2)
    return top + np.log(np.exp(x - top[:, :, None]).sum(axis=2))


def columns(letter: str) -> list[str]:
    return [f"{letter}{i}" for i in range(len(LABELS))]


def doubles(letter: str) -> str:
    return ", ".join(f"{c} double" for c in columns(letter))


def directory_evidence(path: str) -> list[float]:
    """Log evidence from a directory's own name."""
    name = path.rsplit("/", 1)[-1]
    build = 2.0 if BUILD_DIRECTORY.match(name) else 0.0
    return [0.0, build, build / 4, 4.0 if VENDOR_DIRECTORY.match(name) else 0.0, 0.0]


def _mapped(df: DataFrame, schema: str, f) -> DataFrame:
    """Add to each batch the columns that ``f`` computes, and keep those of the schema."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for letter, values in f(batch).items():
                batch[columns(letter)] = values
            yield batch[names]

    return df.mapInPandas(run, schema)


def label_files(files: DataFrame, key: str = "file_id", path: str = "path", content: str = "content", top: int = 4) -> DataFrame:
    """Rows ``(file_id, path, label, p_hand)`` of the ``.py`` and ``.js`` files.

    Null and empty texts count as hand-written unless their surroundings say otherwise; a null path
    is not judged; texts are read whole; repeated rows are each labelled; no more columns are read.
    The trees start at directories of ``top`` path parts (a repository in ``/srv/project/repo``);
    there is one round up and one down per level of directories, whatever their sizes.
    """

    def judge(batch: pd.DataFrame) -> dict:
        e = np.array([file_evidence(p, t or "") for p, t in zip(batch["path"], batch["content"])]).reshape(-1, len(LABELS))
        return {"e": e, "m": message(e)}

    source = files.select(F.col(f"`{key}`").cast("long").alias("file_id"), F.col(f"`{path}`").alias("path"), F.col(f"`{content}`").alias("content")).where(F.lower("path").rlike(r"\.(py|js)$"))
    leaves = cut(_mapped(spread(source), f"file_id long, path string, {doubles('e')}, {doubles('m')}", judge).withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")))
    deepest = leaves.agg(F.max(F.size(F.split("dir", "/")))).first()[0] or 0
    total = [F.sum(c).alias(c) for c in columns("m")]
    by_dir = cut(leaves.groupBy("dir").agg(*total).withColumn("level", F.greatest(F.size(F.split("dir", "/")), F.lit(top))))

    def believe(batch: pd.DataFrame) -> dict:
        own = np.array([directory_evidence(d) for d in batch["dir"]]).reshape(-1, len(LABELS))
        b = batch[columns("m")].to_numpy() + own
        return {"b": b, "m": message(b)}

    parent = F.regexp_replace("dir", r"/?[^/]*$", "")
    up: list[DataFrame] = []  # from the deepest level to the top: beliefs, and what they send up
    for level in range(max(deepest, top), top - 1, -1):
        here = by_dir.where(F.col("level") == level).select("dir", *columns("m"))
        if up:
            here = here.unionByName(up[-1].select(parent.alias("dir"), *columns("m")))
        up.append(cut(_mapped(here.groupBy("dir").agg(*total), f"dir string, {doubles('b')}, {doubles('m')}", believe)))

    def descend(batch: pd.DataFrame) -> dict:
        return {"f": batch[columns("b")].to_numpy() + message(batch[columns("p")].to_numpy() - batch[columns("m")].to_numpy())}

    above = up[-1].select("dir", *(F.col(b).alias(f) for b, f in zip(columns("b"), columns("f"))))
    directories = above
    for here in reversed(up[:-1]):
        whole = above.select(F.col("dir").alias("parent"), *(F.col(f).alias(p) for f, p in zip(columns("f"), columns("p"))))
        above = cut(_mapped(here.withColumn("parent", parent).join(whole, "parent"), f"dir string, {doubles('f')}", descend))
        directories = directories.unionByName(above)

    def decide(batch: pd.DataFrame) -> dict:
        return {"x": batch[columns("e")].to_numpy() + message(batch[columns("f")].to_numpy() - batch[columns("m")].to_numpy())}

    final = _mapped(leaves.join(directories, "dir"), f"file_id long, path string, {doubles('x')}", decide)
    best = F.greatest(*columns("x"))
    label = F.coalesce(*(F.when(F.col(f"x{i}") == best, n) for i, n in enumerate(LABELS)))
    return final.select("file_id", "path", label.alias("label"), (F.exp(F.col("x0") - best) / sum((F.exp(F.col(c) - best) for c in columns("x")[1:]), F.exp(F.col("x0") - best))).alias("p_hand"))
