"""Operator: evaluation texts that occur, wholly or partly, in training documents.

Windows of words are embedded by CGK random walks, which map edit distance to Hamming distance:
a pointer runs over the window, each step emits the word under it and advances by a random bit of
(step, word).  Windows that agree on sampled positions of the walk are candidates, and the words of
every candidate are verified exactly.

Where edits are allowed, a word put in or left out moves the rest of a window, so windows of one
length do not do.  There an item window is cut into one piece more than edits are allowed: some
piece is left whole, so every document place that holds a piece is a candidate, and the item window
is aligned with the words around it, gaps at their ends being free.  Recall is 1.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import spread

WORD = re.compile(r"[^\W_]+")
SCHEMA = "doc_id long, item_id long, edits int"
#: Candidates that are aligned at a time.
ALIGNED = 20_000


def words(text: str) -> list[str]:
    """Longest runs of letters and digits, letter case ignored."""
    return WORD.findall(text.lower())


class WindowIndex:
    """Item windows of ``width`` words under ``walks`` CGK embeddings, each sampled at ``samples`` positions."""

    def __init__(self, items: list[tuple[int, str]], width: int, max_edits: int, walks: int, samples: int, seed: int = 7):
        if max_edits >= width:
            raise ValueError("fewer edits than words, please")
        self.width, self.max_edits = width, max_edits
        self.vocabulary: dict[str, int] = {}
        rows, owner = [], []
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)]
            for p in range(len(ids) - width + 1):
                rows.append(ids[p : p + width])
                owner.append(item)
        self.windows, self.owner = np.array(rows, dtype=np.int64).reshape(-1, width), np.array(owner, dtype=np.int64)
        rng = np.random.default_rng(seed)
        size, steps = len(self.vocabulary), 3 * width
        #: the last word number stands for words no item has, the one before for the end of the window
        self.bits = [rng.integers(0, 2, (steps, size + 2), dtype=np.int8) for _ in range(walks)]
        self.sampled = [np.sort(rng.choice(2 * width, min(samples, 2 * width), replace=False)) for _ in range(walks)]
        self.weights = rng.integers(1, 2**62, (walks, steps), dtype=np.int64) | 1
        self.codes = rng.integers(1, 2**62, size + 2, dtype=np.int64)
        self.tables, self.pieces = [], []
        if max_edits:
            ends = [width * k // (max_edits + 1) for k in range(max_edits + 2)]
            for first, end in zip(ends, ends[1:]):
                keys = self.grams(self.windows.ravel(), end - first)[first::width][: len(self.windows)]
                order = np.argsort(keys, kind="stable")
                self.pieces.append((first, end - first, keys[order], order))
            return
        for k in range(walks):
            keys = self.keys(self.windows.ravel(), np.arange(len(self.windows)) * width, k)
            order = np.argsort(keys, kind="stable")
            self.tables.append((keys[order], order))

    def keys(self, symbols: np.ndarray, starts: np.ndarray, walk: int) -> np.ndarray:
        """The hash of the sampled positions of the walk over each window."""
        size, width = len(self.vocabulary), self.width
        pointer, out = np.zeros(len(starts), dtype=np.int64), np.zeros(len(starts), dtype=np.int64)
        bits, sampled = self.bits[walk], set(self.sampled[walk].tolist())
        with np.errstate(over="ignore"):
            for step in range(max(sampled) + 1):
                at = np.minimum(starts + pointer, len(symbols) - 1)
                now = np.where(pointer < width, symbols[at], size)
                if step in sampled:
                    out = (out ^ self.codes[now]) * self.weights[walk, step]
                pointer += bits[step][now]
        return out

    def grams(self, symbols: np.ndarray, length: int) -> np.ndarray:
        """The hash of the ``length`` words from each place."""
        out = np.zeros(max(len(symbols) - length + 1, 0), dtype=np.int64)
        with np.errstate(over="ignore"):
            for k in range(length):
                out = (out ^ self.codes[symbols[k : k + len(out)]]) * self.weights[0, k]
        return out

    def near(self, symbols: np.ndarray) -> dict[int, int]:
        """Item -> fewest edits between one of its windows and any run of the text's words."""
        margin, best = self.max_edits, {}
        starts, windows = [], []
        for first, length, keys, order in self.pieces:
            mine = self.grams(symbols, length)
            low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            at = np.flatnonzero(low < high)
            n = high[at] - low[at]
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            windows.append(order[np.repeat(low[at], n) + within])
            starts.append(np.repeat(at - first, n))
        pairs = np.unique(np.stack([np.concatenate(windows), np.concatenate(starts)]), axis=1) if windows else np.empty((2, 0), dtype=np.int64)
        # -1 is no word, so nothing beyond the ends of the text is equal to a word of an item
        padded = np.pad(symbols, self.width + margin, constant_values=-1)
        reach = np.arange(self.width + 2 * margin) + self.width
        for k in range(0, pairs.shape[1], ALIGNED):
            j, start = pairs[:, k : k + ALIGNED]
            edits = fewest_edits(self.windows[j], padded[start[:, None] + reach])
            for i in np.flatnonzero(edits <= margin):
                item = int(self.owner[j[i]])
                best[item] = min(best.get(item, margin), int(edits[i]))
        return best

    def candidates(self, symbols: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs (start in the text, number of item window) that collide under some walk."""
        if len(symbols) < self.width or not len(self.windows):
            return
        strange = np.concatenate([[0], np.cumsum(symbols > len(self.vocabulary))])
        starts = np.flatnonzero(strange[self.width :] - strange[: -self.width] <= self.max_edits)
        for walk, (keys, order) in enumerate(self.tables):
            if not len(starts):
                return
            mine = self.keys(symbols, starts, walk)
            low, high = np.searchsorted(keys, mine, "left"), np.searchsorted(keys, mine, "right")
            for i in np.flatnonzero(low < high):
                for j in order[low[i] : high[i]]:
                    yield int(starts[i]), int(j)

    def find(self, text: str) -> dict[int, int]:
        """Item -> fewest edits, over the verified candidates."""
        size = len(self.vocabulary)
        get = self.vocabulary.get
        symbols = np.fromiter((get(w, size + 1) for w in words(text)), dtype=np.int64)
        if self.max_edits:
            return self.near(symbols)
        best: dict[int, int] = {}
        seen = set()
        for start, j in self.candidates(symbols):
            item = int(self.owner[j])
            if best.get(item) == 0 or (start, j) in seen:
                continue
            seen.add((start, j))
            d = edit_distance(symbols[start : start + self.width].tolist(), self.windows[j].tolist(), min(self.max_edits, best.get(item, self.max_edits)))
            if d is not None:
                best[item] = d
        return best


def fewest_edits(windows: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each row: the fewest edits between the window and any run of words of the text."""
    places = np.arange(texts.shape[1] + 1, dtype=np.int16)
    row = np.zeros((len(texts), len(places)), dtype=np.int16)
    for i in range(windows.shape[1]):
        new = np.full_like(row, i + 1)
        np.minimum(row[:, 1:] + 1, row[:, :-1] + (texts != windows[:, i : i + 1]), out=new[:, 1:])
        # a run of words put in: the least of all places to the left, one edit a place
        row = np.minimum.accumulate(new - places, axis=1) + places
    return row.min(axis=1)


def edit_distance(a: list, b: list, most: int) -> int | None:
    """Edits between two lists, None if more than ``most``."""
    if a == b:
        return 0
    if most == 0:
        return None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return None
    return row[-1] if row[-1] <= most else None


def find_leaks(documents: DataFrame, items: DataFrame, width: int = 13, max_edits: int = 0, walks: int = 1, samples: int = 16, block_items: int = 20_000, block_chars: int = 20_000_000) -> DataFrame:
    """Rows ``(doc_id, item_id, edits)``: documents with ``width`` consecutive words of an item, up to ``max_edits`` edits.

    Recall is 1: with no edits allowed, equal windows always collide; with edits, words changed, left
    out or put in, every place that holds a whole piece of an item window is aligned with it, and
    ``walks`` and ``samples`` have no effect.  Items go to the tasks in blocks of ``block_items`` (a bound on what is broadcast),
    all blocks against all documents, so any number of items works; documents are read whole, and
    not shuffled where the input has as many splits as the session has cores.  Null and short texts hold no window; repeated documents each report; items of
    equal text all report.
    """
    docs = spread(documents.select(F.col("doc_id").cast("long"), F.col("text")).where("doc_id is not null and text is not null"))
    spark = documents.sparkSession
    out = None
    block: list[tuple[int, str]] = []
    chars = 0

    def match(block: list[tuple[int, str]]) -> DataFrame:
        index = spark.sparkContext.broadcast(WindowIndex(block, width, max_edits, walks, samples))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            find = index.value.find
            for batch in batches:
                rows = [(d, i, e) for d, t in zip(batch["doc_id"], batch["text"]) for i, e in find(t).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits"])

        return docs.mapInPandas(run, SCHEMA)

    def add(df: DataFrame) -> DataFrame:
        return df if out is None else out.unionByName(df)

    for row in items.select(F.col("item_id").cast("long").alias("i"), F.col("text").alias("t")).where("i is not null and t is not null").toLocalIterator():
        block.append((row.i, row.t))
        chars += len(row.t)
        if len(block) == block_items or chars >= block_chars:
            out, block, chars = add(match(block)), [], 0
    if block or out is None:
        out = add(match(block))
    return out.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
