"""Operator: long exact spans shared between records.

Records that share a span of the least length share an anchor: winnowing keeps, of every run of
grams, the one with the smallest hash, so each window of the least length holds a kept gram that
depends on the window's text only.  Around shared anchors every window of the least length is
hashed, and equal windows route their records to a reference shard: the suffix automaton of the
shard's reference is built, the other records' stretches are streamed through it, and their
matching statistics decide.  The steps are the same for a stretch that two records hold and for one
that a third of them holds; boilerplate shorter than the least length never meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.session import cut, spread

BASE = 0x9E3779B97F4A7C15
#: Records of a shard that meet in a task, at most about so many by so many.
BLOCK = 512


def _inverse_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, pow(BASE, -1, 1 << 64)):
        powers = np.full(n + 1, base, dtype=np.uint64)
        powers[0] = 1
        with np.errstate(over="ignore"):
            out.append(np.cumprod(powers, dtype=np.uint64))
    up, down = out
    return up, down


class Grams:
    """Hashes of all grams of a length: differences of prefix sums, then mixed."""

    def __init__(self) -> None:
        self.up, self.down = _inverse_powers(1 << 12)

    def __call__(self, text: str, length: int) -> np.ndarray:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        n = len(codes)
        if n < length:
            return np.empty(0, dtype=np.int64)
        if n >= len(self.up):
            self.up, self.down = _inverse_powers(2 * n)
        with np.errstate(over="ignore"):
            codes = (codes + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xFF51AFD7ED558CCD)
            codes ^= codes >> np.uint64(29)
            total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * self.up[:n], dtype=np.uint64)])
            h = (total[length:] - total[:-length]) * self.down[: n - length + 1]
            h ^= h >> np.uint64(33)
            h *= np.uint64(0xC4CEB9FE1A85EC53)
            h ^= h >> np.uint64(29)
        return h.view(np.int64)


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the rightmost smallest hash of every run of ``window`` hashes."""
    n = len(h)
    if n < window:
        return np.empty(0, dtype=np.int64)
    pad = -n % window
    big = np.iinfo(np.int64).max
    blocks = np.concatenate([h, np.full(pad, big)]).reshape(-1, window)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    smallest = np.minimum(behind[: n - window + 1], ahead[window - 1 : n])
    # the rightmost occurrence of each run's minimum; the minimum seldom changes from run to run
    starts = np.flatnonzero(np.concatenate([[True], smallest[1:] != smallest[:-1]]))
    at = np.flatnonzero(np.isin(h, smallest[starts]))
    if len(at) == len(starts):  # no hash occurs twice
        return at
    ends = np.append(starts[1:], len(smallest))
    out: list[int] = []
    for first, last in zip(starts.tolist(), ends.tolist()):
        # runs first..last-1 cover h[first : last - 1 + window]; which equal positions are the last of some run
        at = np.flatnonzero(h[first : last - 1 + window] == smallest[first]) + first
        if len(at) == 1:
            out.append(int(at[0]))
        else:
            of = np.searchsorted(at, np.arange(first, last) + window - 1, "right") - 1
            out += at[np.unique(of)].tolist()
    return np.unique(np.array(out, dtype=np.int64))


class SuffixAutomaton:
    """The suffix automaton of a text, with the first end of each state's strings."""

    def __init__(self, text: str):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [0]
        last = 0
        nxt, link, length, first = self.next, self.link, self.length, self.first
        for i, c in enumerate(text):
            cur = len(length)
            nxt.append({})
            length.append(length[last] + 1)
            first.append(i + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(length)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    first.append(first[q])
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def statistics(self, text: str) -> Iterator[tuple[int, int]]:
        """For each position of ``text``: (length of the longest match ending there, its first end in the reference)."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        state = matched = 0
        for c in text:
            while state and c not in nxt[state]:
                state = link[state]
                matched = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            else:
                matched = 0
            yield matched, first[state]

    def shares(self, text: str, least: int) -> bool:
        return any(m >= least for m, _ in self.statistics(text))

    def spans(self, text: str, least: int) -> list[tuple[int, int]]:
        """Maximal spans ``(start, end)`` of the text, of at least the length, that the reference holds."""
        out: list[tuple[int, int]] = []
        before = 0
        for end, (m, _) in enumerate(self.statistics(text)):
            if m != before + 1 and before >= least:
                out.append((end - before, end))
            before = m
        if before >= least:
            out.append((len(text) - before, len(text)))
        return out


def classes(documents: DataFrame) -> DataFrame:
    """``(doc_id, class_id, n_chars)``: documents of equal text share the smallest id."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").alias("n_chars"), F.unhex(F.sha2("text", 256)).alias("h")).where("doc_id is not null and h is not null")
    return rows.join(rows.groupBy("h").agg(F.min("doc_id").alias("class_id")), "h").dropDuplicates(["h", "doc_id"]).select("doc_id", "class_id", "n_chars")


def anchors(documents: DataFrame, least: int = 300) -> DataFrame:
    """``(doc_id, h, pos)``: the winnowed grams of two thirds of the least length."""
    gram = anchor_length(least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for batch in batches:
            hashes, places = [], []
            for text in batch["text"]:
                h = grams(text, gram)
                at = winnow(h, least - gram + 1)
                hashes.append(h[at])
                places.append(at.astype("int32"))
            if hashes:
                docs = np.repeat(batch["doc_id"].to_numpy(), [len(p) for p in places])
                yield pd.DataFrame({"doc_id": docs, "h": np.concatenate(hashes), "pos": np.concatenate(places)})

    rows = documents.select(F.col("doc_id").cast("long"), "text").where((F.length("text") >= least) & F.col("doc_id").isNotNull())
    return spread(rows).mapInPandas(run, "doc_id long, h long, pos int")


def anchor_length(least: int) -> int:
    return max(1, least * 2 // 3)


def sharing_texts(documents: DataFrame, members: DataFrame, least: int = 300) -> DataFrame:
    """``(doc_id, text, marks)``: representatives with anchors that others have too, and where these are."""
    ids = members.where((F.col("doc_id") == F.col("class_id")) & (F.col("n_chars") >= least)).select("doc_id")
    marks = cut(anchors(documents, least).join(ids, "doc_id", "left_semi"))
    groups = marks.groupBy("h").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h")
    places = marks.join(groups, "h", "left_semi").groupBy("doc_id").agg(F.collect_list("pos").alias("marks"))
    texts = documents.where(F.length("text") >= least).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(texts.join(places, "doc_id").dropDuplicates(["doc_id"]))


def windows(sharing: DataFrame, least: int = 300) -> DataFrame:
    """``(doc_id, start, g, before)``: every stretch of the least length around a shared anchor, and the character before it (-1 for none)."""
    reach = least - anchor_length(least)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = Grams()
        for batch in batches:
            for doc, text, marks in zip(batch["doc_id"], batch["text"], batch["marks"]):
                g = grams(text, least)
                wanted = np.zeros(len(g) + 1, dtype=np.int32)
                pos = np.asarray(marks, dtype=np.int64)
                np.add.at(wanted, np.clip(pos - reach, 0, len(g)), 1)
                np.add.at(wanted, np.clip(pos + 1, 0, len(g)), -1)
                at = np.flatnonzero(np.cumsum(wanted[:-1]))
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int32)
                yield pd.DataFrame({"doc_id": np.full(len(at), doc), "start": at.astype(np.int32), "g": g[at], "before": np.where(at > 0, codes[at - 1], -1).astype(np.int32)})

    return sharing.mapInPandas(run, "doc_id long, start int, g long, before int")


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of batches that are sorted by the keys, each whole."""
    held = None
    for batch in batches:
        batch = batch if held is None else pd.concat([held, batch])
        if len(batch):
            starts = np.flatnonzero((batch[keys] != batch[keys].shift()).any(axis=1).to_numpy())
            for a, b in zip(starts, starts[1:]):
                yield batch.iloc[a:b]
            held = batch.iloc[starts[-1] :]
    if held is not None:
        yield held


def in_blocks(rows: DataFrame, n: str, member: str) -> DataFrame:
    """Rows of groups of ``n`` with their ``block``, once per pair of blocks ``(lo, hi)``: what meets in a task is bounded."""
    blocks = F.ceil(F.col(n) / BLOCK).cast("int")
    own = rows.withColumn("block", F.pmod(F.xxhash64(member), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    return own.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other")


def same_stretch(texts: list[str], least: int) -> list[int]:
    """A number for each text; equal ones share a stretch of the least length, by the automaton of the first of them."""
    number: dict[str, int] = {}
    references: list[SuffixAutomaton] = []
    for text in texts:
        if text in number:
            continue
        for k, automaton in enumerate(references):
            if automaton.shares(text, least):
                number[text] = k
                break
        else:
            number[text] = len(references)
            references.append(SuffixAutomaton(text))
    return [number[t] for t in texts]


def shared_pairs(documents: DataFrame, members: DataFrame, least: int = 300) -> DataFrame:
    """Distinct ``(doc_id_1, doc_id_2)`` of class representatives whose texts share a span of the least length.

    A pair meets where its common span begins: at the window whose characters before it differ or
    are missing, so neither a long span nor text that all its holders share on makes it meet again.
    The window's holders form a reference shard; those that the automaton of the shard's reference
    finds in it, by matching statistics of the least length, are paired.  Shards of any size go to
    the tasks in pairs of blocks.  Null and short texts share nothing.
    """
    sharing = sharing_texts(documents, members, least)
    rows = cut(windows(sharing, least))
    held = rows.groupBy("g").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("before").alias("low"), F.max("before").alias("high"), F.count("*").alias("n")).where("a < b and (low < high or low < 0)").select("g", "n")
    begun = in_blocks(rows.join(held, "g"), "n", "doc_id")
    texts = begun.join(sharing.select("doc_id", "text"), "doc_id").select("g", "lo", "hi", "block", "doc_id", "before", F.substr("text", F.col("start") + 1, F.lit(least)).alias("stretch"))

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for shard in grouped(batches, ["g", "lo", "hi"]):
            number = np.array(same_stretch(shard["stretch"].tolist(), least))
            doc, before, block = (shard[c].to_numpy() for c in ("doc_id", "before", "block"))
            i, j = np.triu_indices(len(shard), 1)
            keep = (number[i] == number[j]) & (doc[i] != doc[j]) & ((before[i] != before[j]) | (before[i] < 0))
            if shard["lo"].iat[0] != shard["hi"].iat[0]:
                keep &= block[i] != block[j]
            i, j = i[keep], j[keep]
            if len(i):
                yield pd.DataFrame({"doc_id_1": np.minimum(doc[i], doc[j]), "doc_id_2": np.maximum(doc[i], doc[j])}).drop_duplicates()

    shards = texts.repartition("g", "lo", "hi").sortWithinPartitions("g", "lo", "hi")
    return shards.mapInPandas(meet, "doc_id_1 long, doc_id_2 long").distinct()


def expand_pairs(pairs: DataFrame, members: DataFrame, least: int = 300) -> DataFrame:
    """Pairs of documents from pairs of representatives and class membership."""
    first = members.select(F.col("class_id").alias("doc_id_1"), F.col("doc_id").alias("m1"))
    second = members.select(F.col("class_id").alias("doc_id_2"), F.col("doc_id").alias("m2"))
    across = pairs.join(first, "doc_id_1").join(second, "doc_id_2").select(F.least("m1", "m2").alias("doc_id_1"), F.greatest("m1", "m2").alias("doc_id_2"))
    sizes = members.where(F.col("n_chars") >= least).groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1")
    copies = in_blocks(members.join(sizes, "class_id").select("class_id", "doc_id", "n"), "n", "doc_id")
    left = copies.select("class_id", "lo", "hi", F.col("doc_id").alias("m1"), F.col("block").alias("b1"))
    right = copies.select("class_id", "lo", "hi", F.col("doc_id").alias("m2"), F.col("block").alias("b2"))
    inside = left.join(right, ["class_id", "lo", "hi"]).where("m1 < m2 and (lo = hi or b1 <> b2)").select(F.col("m1").alias("doc_id_1"), F.col("m2").alias("doc_id_2"))
    return across.unionByName(inside)


def find_pairs(documents: DataFrame, least: int = 300) -> DataFrame:
    """Rows ``(doc_id_1, doc_id_2)``, the first smaller, of texts with a verbatim common span of the least length.

    Documents of equal text form a class and are compared once.  Null texts and texts shorter than
    the least length share nothing; repeated ids count as one document each; an empty table gives
    an empty result.
    """
    members = cut(classes(documents))
    return expand_pairs(shared_pairs(documents, members, least), members, least)


def shared_spans(documents: DataFrame, members: DataFrame, least: int = 300) -> DataFrame:
    """``(doc_id, other_id, start, end)``: the stretches of each representative that another class holds.

    A stretch is as long as one and the same class holds it at one place: the smallest one, or for
    that one itself the largest.
    Its text there is the reference of a shard: its automaton is built once a block of documents,
    and their stretches are streamed through it; spans whose matching statistics reach the least
    length remain.  No pairs of documents are listed, whatever number of them holds a stretch.
    """
    sharing = sharing_texts(documents, members, least)
    rows = cut(windows(sharing, least))
    held = rows.groupBy("g").agg(F.min(F.struct("doc_id", "start")).alias("a"), F.max(F.struct("doc_id", (-F.col("start")).alias("back"))).alias("b")).where("a.doc_id < b.doc_id")
    last = F.struct(F.col("b.doc_id").alias("doc_id"), (-F.col("b.back")).alias("start"))
    seen = rows.join(held, "g").select("doc_id", "start", F.when(F.col("doc_id") == F.col("a.doc_id"), last).otherwise(F.col("a")).alias("o"))
    seen = seen.select("doc_id", "start", F.col("o.doc_id").alias("other_id"), (F.col("o.start") - F.col("start")).alias("shift"))
    w = Window.partitionBy("doc_id", "other_id", "shift").orderBy("start")
    runs = seen.withColumn("run", F.col("start") - F.row_number().over(w)).groupBy("doc_id", "other_id", "shift", "run").agg(F.min("start").alias("start"), (F.max("start") + least).alias("end"))
    runs = cut(runs.select("doc_id", "other_id", "start", "end", (F.col("start") + F.col("shift")).alias("at")))

    shard = ["other_id", "at", "size"]
    runs = runs.withColumn("size", F.col("end") - F.col("start"))
    sizes = runs.groupBy(*shard).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    mine = runs.join(sizes, shard).select(*shard, F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int").alias("block"), "doc_id", "start", F.lit(1).alias("part"))
    references = sizes.select(*shard, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("other_id").alias("doc_id"), F.col("at").alias("start"), F.lit(0).alias("part"))
    pieces = mine.unionByName(references).join(sharing.select("doc_id", "text"), "doc_id").withColumn("stretch", F.substr("text", F.col("start") + 1, F.col("size"))).drop("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, automaton = None, None
        for batch in batches:
            out = []
            for other, at, size, block, doc, start, part, stretch in batch.itertuples(index=False, name=None):
                if part == 0:
                    if (other, at, size) != key:
                        key, automaton = (other, at, size), SuffixAutomaton(stretch)
                else:
                    out += [(doc, other, start + s, start + e) for s, e in automaton.spans(stretch, least)]
            yield pd.DataFrame(out, columns=["doc_id", "other_id", "start", "end"])

    order = [*shard, "block"]
    pieces = pieces.select(*shard, "block", "doc_id", "start", "part", "stretch").repartition(*order).sortWithinPartitions(*order, "part")
    return pieces.mapInPandas(run, "doc_id long, other_id long, start int, end int")


def shares(sizes: DataFrame, spans: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, shared_chars, share)``: how much of each document's text is found elsewhere; ``sizes(doc_id, n_chars)``."""
    w = Window.partitionBy("doc_id").orderBy("start", "end")
    covered = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    part = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce(covered, F.lit(0))), F.lit(0))
    sums = spans.select("doc_id", "start", "end").distinct().select("doc_id", part.alias("c")).groupBy("doc_id").agg(F.sum("c").alias("shared_chars"))
    joined = sizes.select("doc_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars")).join(sums, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return joined.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0))


def _class_sizes(members: DataFrame, least: int) -> DataFrame:
    """``(class_id, n_copies, n_chars, copied)``: copied tells that the whole text is a span that other members hold."""
    rows = members.groupBy("class_id").agg(F.count("*").alias("n_copies"), F.max("n_chars").alias("n_chars"))
    return rows.withColumn("copied", (F.col("n_copies") > 1) & (F.col("n_chars") >= least))


def document_shares(documents: DataFrame, members: DataFrame, spans: DataFrame, least: int = 300) -> DataFrame:
    """``(doc_id, class_id, n_chars, shared_chars, share, n_copies)``, one row per document.

    ``spans`` are those of the representatives.  A text of at least the least length that has equal
    copies is found elsewhere as a whole.  A null text shares nothing and is the only one of its
    class.
    """
    sizes = _class_sizes(members, least)
    of = shares(sizes.select(F.col("class_id").alias("doc_id"), "n_chars"), spans).drop("n_chars").withColumnRenamed("doc_id", "class_id").join(sizes, "class_id")
    shared, share = F.when(F.col("copied"), F.col("n_chars")), F.when(F.col("copied"), 1.0)
    of = of.select("class_id", F.coalesce(shared, "shared_chars").alias("shared_chars"), F.coalesce(share, "share").alias("share"), "n_copies")
    rows = members.join(of, "class_id").select("doc_id", "class_id", "n_chars", "shared_chars", "share", "n_copies")
    nulls = documents.where("text is null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"))
    empty = {"class_id": F.col("doc_id"), "n_chars": F.lit(0), "shared_chars": F.lit(0).cast("long"), "share": F.lit(0.0), "n_copies": F.lit(1).cast("long")}
    return rows.unionByName(nulls.select("doc_id", *(c.alias(name) for name, c in empty.items())))


def document_spans(members: DataFrame, spans: DataFrame, least: int = 300) -> DataFrame:
    """``(doc_id, class_id, other_class_id, start, end)``: the stretches of each document that another class holds.

    The other class is the document's own where other members hold its whole text.  All members of
    a class have its rows, so the rows tell which documents hold a stretch without listing pairs.
    """
    across = spans.select(F.col("doc_id").alias("class_id"), F.col("other_id").alias("other_class_id"), "start", "end")
    whole = _class_sizes(members, least).where("copied").select("class_id", F.col("class_id").alias("other_class_id"), F.lit(0).alias("start"), F.col("n_chars").alias("end"))
    return members.join(across.unionByName(whole), "class_id").select("doc_id", "class_id", "other_class_id", "start", "end")
