"""File-tree source: add-on modules under root paths, as one DataFrame of files."""

from __future__ import annotations

import fnmatch
import os
import tomllib
import zlib
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Manifest names that mark a directory as a module, the first taking precedence (fixed values).
MANIFESTS = ("__manifest__.py", "__openerp__.py")


def excluded(module: str, patterns: Sequence[str]) -> bool:
    """Shell patterns over module directory names; a leading ``*/`` is path notation, not part of the name."""
    return any(fnmatch.fnmatch(module, p.removeprefix("*/")) for p in patterns)


def kind_of(inner: str) -> str | None:
    """What a file inside a module is, None if it is not taken."""
    parts = inner.split("/")
    if inner.endswith(".py"):
        return None if inner in MANIFESTS or "__pycache__" in parts else "python"
    if inner.endswith(".xml"):
        return None if {"test", "tests"} & set(parts[:-1]) else "xml"
    if parts[-1] == "ir.model.access.csv":
        return "csv"
    if inner.endswith(".js") and parts[:2] == ["static", "src"] and parts[2] not in ("lib", "test", "tests"):
        return "js"
    return None


SCAN = "root_ord int, module string, path string, rel string, kind string, content string, seq long"


def scan(spark: SparkSession, roots: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """``(root_ord, module, path, rel, kind, content, seq)`` of all module files.

    Modules are the direct sub-directories of a root that have a manifest.  Python files are taken
    recursively except caches, XML files outside ``test(s)`` directories of the module, access
    CSVs, and scripts under ``static/src`` except its ``lib``, ``test`` and ``tests``.  A missing
    root gives nothing.  Of a module found under several roots the last root's files stand.  The
    driver lists module names only; tasks walk and read the modules, which must be mounted on all
    executors (Spark's own file sources hide names that start with an underscore).
    """
    modules: dict[str, tuple] = {}
    for i, root in enumerate(map(os.path.abspath, roots)):
        for name in sorted(os.listdir(root)) if os.path.isdir(root) else ():
            manifest = next((m for m in MANIFESTS if os.path.isfile(os.path.join(root, name, m))), None)
            if manifest and not excluded(name, exclude):
                modules[name] = (i, name, os.path.join(root, name), manifest)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i, module, folder, manifest in b.itertuples(index=False):
                out = []
                for here, _, names in os.walk(folder):
                    for name in names:
                        path = os.path.join(here, name)
                        inner = os.path.relpath(path, folder).replace(os.sep, "/")
                        kind = "manifest" if inner == manifest else kind_of(inner)
                        if kind:
                            with open(path, "rb") as f:
                                out.append((i, module, path, f"{module}/{inner}", kind, f.read().decode("utf-8", "replace"), zlib.crc32(f"{module}/{inner}".encode())))
                yield pd.DataFrame(sorted(out), columns=[c.split()[0] for c in SCAN.split(", ")])

    listed = spark.createDataFrame(list(modules.values()), "root_ord int, module string, folder string, manifest string")
    return listed.repartition(max(1, min(len(modules), spark.sparkContext.defaultParallelism + len(modules) // 20, 10_000))).mapInPandas(read, SCAN)


def from_table(files: DataFrame) -> DataFrame:
    """The ``source_files`` table in the shape of a scan; the extension tells the language."""
    extension = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(extension == "py", "python").when(extension.isin("xml", "js", "csv"), extension)
    return files.select(F.lit(0).alias("root_ord"), F.coalesce("module_name", F.split_part("path", F.lit("/"), F.lit(5))).alias("module"), "path", F.col("path").alias("rel"), kind.alias("kind"), "content", F.col("file_id").alias("seq")).where("kind is not null and content is not null")


def load_config(path: str) -> dict:
    """A TOML project config with defaults: name, roots, exclude, javascript."""
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    project = raw.get("project", {})
    base = os.path.dirname(os.path.abspath(path))
    roots = [os.path.join(base, p) for p in project.get("addons_paths", raw.get("addons_paths", []))]
    return {"name": project.get("name", os.path.basename(base)), "roots": roots, "exclude": list(raw.get("exclude", project.get("exclude", []))), "javascript": bool(raw.get("javascript", True))}


def find_config(start: str, name: str = ".tessel.toml") -> str | None:
    """The config of a directory or the nearest one above it, up to the home directory or the root."""
    here, home = os.path.abspath(start), os.path.expanduser("~")
    while True:
        if os.path.isfile(candidate := os.path.join(here, name)):
            return candidate
        if here in (home, os.path.dirname(here)):
            return None
        here = os.path.dirname(here)


def resolve_roots(cli: str | None = None, start: str = ".") -> list[str]:
    """Paths given on the command line (``:`` or ``,``), else those of the nearest config."""
    if cli:
        return [p for p in cli.replace(",", ":").split(":") if p]
    if found := find_config(start):
        return load_config(found)["roots"]
    raise ValueError("no add-on paths: give them or write a config file")


def detect_version(files: DataFrame) -> str | None:
    """The most frequent ``X.Y`` prefix of the manifests' versions; ties by the higher version."""
    v = F.regexp_extract("content", r"""['"]version['"]\s*:\s*['"](\d{1,2}\.\d)\.""", 1)
    row = files.where("kind = 'manifest'").select(v.alias("v")).where("v <> ''").groupBy("v").count().orderBy(F.desc("count"), F.desc("v")).first()
    return row["v"] if row else None
