"""Operator: source files that no supported dialect of their language derives."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.grammars import DIALECTS, parses
from tessel.session import spread


def well_formed(text: str, extension: str) -> bool:
    """Whether a dialect's grammar derives the text."""
    return parses(text, extension)


def check_files(files: DataFrame, key: str = "file_id", path: str = "path", content: str = "content", group: str = "repo") -> DataFrame:
    """Rows ``(file_id, repo, language, well_formed)`` of the files whose extension has a grammar.

    The extension decides, in any case of letters; other files are not judged.  Null content and
    null paths are not judged either; an empty text is judged as a text (no XML document).  Texts
    are parsed whole, whatever their length and nesting; repeated rows each give a row; texts that
    occur several times in a batch are parsed once; further columns are not read.  No shuffle where the input has as many splits as the session has cores.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = list(zip(batch.pop("content"), batch["language"]))
            known = {t: well_formed(*t) for t in set(texts)}
            batch["well_formed"] = [known[t] for t in texts]
            yield batch

    language = F.lower(F.regexp_extract(F.col(f"`{path}`"), r"\.([^./]+)$", 1))
    rows = files.select(F.col(f"`{key}`").cast("long").alias("file_id"), F.col(f"`{group}`").cast("string").alias("repo"), language.alias("language"), F.col(f"`{content}`").alias("content"))
    rows = rows.where(F.col("language").isin(*DIALECTS) & F.col("content").isNotNull())
    return spread(rows).mapInPandas(run, "file_id long, repo string, language string, well_formed boolean")


def failure_rates(checked: DataFrame) -> DataFrame:
    """``(repo, language, n_files, n_broken, broken_rate)``."""
    return (
        checked.groupBy("repo", "language")
        .agg(F.count("*").alias("n_files"), F.count_if(~F.col("well_formed")).alias("n_broken"))
        .withColumn("broken_rate", F.round(F.col("n_broken") / F.col("n_files"), 6))
    )


