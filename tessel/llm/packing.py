"""Operator: items of varying length into containers of fixed capacity, with certified bin counts.

Items are spread over partitions of bounded size; each partition is packed by best-fit decreasing
and its bin count compared with a lower bound from dual-feasible functions.  Partitions with a gap
exchange their documents under another hash and are packed again, with more of them together, until
every partition, or the packing as a whole, is certified, or exchanging no longer saves a bin.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.session import cut

#: The public word-and-punctuation tokenizer: runs of letters, digits and underscores, or runs of other characters that are not white space.
WORD_PUNCT = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\p{IsWhite_Space}\x1c-\x1f]+"


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PUNCT)), F.lit(0)).cast("long")


def count_with_tokenizer(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` by a tokenizer file of the ``tokenizers`` library, in Arrow batches."""

    def run(batches):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [len(e.ids) for e in t.encode_batch(b["text"].tolist(), add_special_tokens=False)]})

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInPandas(run, "doc_id long, n_tokens long")


def lower_bound(sizes: list[int], capacity: int) -> int:
    """A number of bins that no packing undercuts, over the dual-feasible functions of Martello and Toth.

    For a threshold e, items above ``capacity - e`` count as a full bin, items below e as nothing,
    the others by their size; the best threshold certifies.
    """
    counts = [0] * (capacity + 1)
    for s in sizes:
        counts[s] += 1
    return lower_bound_of_counts(counts, capacity)


def lower_bound_of_counts(counts: list[int], capacity: int) -> int:
    """The same from the number of items of each size."""
    total = sum(s * n for s, n in enumerate(counts))
    best, small, large, large_sum = -(-total // capacity), 0, 0, 0
    for e in range(1, capacity // 2 + 1):
        small += (e - 1) * counts[e - 1]
        big = capacity - e + 1
        large += counts[big]
        large_sum += big * counts[big]
        best = max(best, -(-(large * capacity + total - large_sum - small) // capacity))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, the fullest bin that has room; O(1) an item through a mask of free spaces."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    out = [0] * len(sizes)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, bins = 0, 0
    for i in order:
        size = sizes[i]
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            b, room, bins = bins, capacity, bins + 1
        out[i] = b
        room -= size
        free[room].append(b)
        mask |= 1 << room
    return out


SCHEMA = "doc_id long, piece int, n_pieces int, size int, home string, bin long, fill int, bound int, gap int"
#: Exchanges put at most so many partitions' items together.
TOGETHER = 8
ITEM = ["doc_id", "piece", "n_pieces", "size"]


def _pack(items: DataFrame, n_items: int, capacity: int, per_partition: int, round_no: int) -> DataFrame:
    parts = max(1, -(-n_items // per_partition))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf["size"].tolist()
        bins = best_fit_decreasing(sizes, capacity)
        pdf["bin"] = bins
        pdf["fill"] = pdf.groupby("bin")["size"].transform("sum").astype("int32")
        pdf["bound"] = lower_bound(sizes, capacity)
        pdf["gap"] = len(set(bins)) - pdf["bound"]
        return pdf[[c.split()[0] for c in SCHEMA.split(", ")]]

    home = F.concat(F.lit(f"{round_no}-"), F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_no)), F.lit(parts)).cast("string"))
    return items.select(*ITEM, home.alias("home")).groupBy("home").applyInPandas(run, SCHEMA)


def _bins(packed: DataFrame) -> int:
    return packed.select("home", "bin").distinct().count()


def pack(sizes: DataFrame, capacity: int = 1024, per_partition: int = 50_000, patience: int = 3) -> DataFrame:
    """Rows ``(doc_id, piece, n_pieces, size, container_id, fill, home, bound, gap)`` from ``(doc_id, n_tokens)``.

    An item larger than the capacity is split into full pieces and a rest; no other is split.  Null
    sizes count as 0, items of size 0 go anywhere; repeated ids are items of their own.  A task
    holds ``per_partition`` items on average, spread by hash, so equal sizes and hot sources do
    not matter.  ``home`` is the partition an item was packed in, ``bound`` how many containers its
    items need at least and ``gap`` how many more it has.  Exchanges go on until no partition has a
    gap, or the number of containers meets the bound of all items together, or ``patience``
    exchanges in a row have saved nothing; an exchange that needs more containers is dropped.
    """
    n = F.coalesce(F.col("n_tokens"), F.lit(0))
    pieces = F.greatest(F.ceil(n / capacity), F.lit(1)).cast("int")
    items = sizes.select(F.col("doc_id"), n.alias("n"), pieces.alias("n_pieces")).select("doc_id", "n", "n_pieces", F.explode(F.sequence(F.lit(1), F.col("n_pieces"))).alias("piece"))
    items = cut(items.select("doc_id", "piece", "n_pieces", F.least(F.lit(capacity), F.col("n") - (F.col("piece") - 1) * capacity).cast("int").alias("size")))
    packed = cut(_pack(items, items.count(), capacity, per_partition, 0))
    least, total = overall_bound(items, capacity), _bins(packed)
    round_no = idle = 0
    while total > least and idle < patience:
        round_no += 1
        loose = packed.where("gap > 0")
        before = _bins(loose)
        if not before:
            break
        again = cut(_pack(loose, loose.count(), capacity, per_partition * min(2**round_no, TOGETHER), round_no))
        saved = before - _bins(again)
        if saved >= 0:
            packed = packed.where("gap = 0").unionByName(again)
        total -= max(saved, 0)
        idle = 0 if saved > 0 else idle + 1
    return packed.select(*ITEM, F.concat("home", F.lit("-"), F.col("bin").cast("string")).alias("container_id"), "fill", "home", "bound", "gap")


def overall_bound(items: DataFrame, capacity: int) -> int:
    """The lower bound of all items together; their sizes are counted, at most ``capacity + 1`` numbers."""
    counts = {r["size"]: r["count"] for r in items.groupBy("size").count().collect()}
    return lower_bound_of_counts([counts.get(s, 0) for s in range(capacity + 1)], capacity)


def certificates(packed: DataFrame) -> DataFrame:
    """``(home, n_items, n_bins, bound, gap, filled)`` of each partition: the certificate of its packing."""
    bins = packed.groupBy("home", "container_id").agg(F.count("*").alias("n"), F.max("fill").alias("fill"), F.max("bound").alias("bound"))
    homes = bins.groupBy("home").agg(F.sum("n").alias("n_items"), F.count("*").alias("n_bins"), F.max("bound").cast("long").alias("bound"), F.sum("fill").alias("filled"))
    return homes.select("home", "n_items", "n_bins", "bound", (F.col("n_bins") - F.col("bound")).alias("gap"), "filled")
