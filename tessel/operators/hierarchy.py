"""Operator: parent-child links of unknown depth into roots, depths, paths and descendants.

Tree contraction, generalised to several parents: every round rakes the leaves (a node without
children leaves the graph with its links) and compresses unary chains (a node with one parent and
one child is bypassed by a weighted link), so a chain of n nodes takes O(log n) rounds.  Reversing
the recorded contractions gives every node its roots, or all its ancestors, from its parents'.
What cannot be contracted is the core: cycles and what lies between and above them; a node that the
core cannot free from above is on a cycle or below one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.session import cut, one_task

CYCLE_ROOT, CYCLE_DEPTH = "", -1
#: Links a task takes; what is left of the graph is put into so many tasks, and one task needs no shuffle.
TASK_LINKS = 50_000


def _fit(df: DataFrame, links: int) -> DataFrame:
    """The rows in as few tasks as their number asks for, where that is one."""
    return df.coalesce(1) if links <= TASK_LINKS else df


def _coin(c: Column, round_no: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(round_no)), F.lit(2)) == 1


def _contract(edges: DataFrame, round_no: int) -> DataFrame:
    """One round over links ``(c, p, w, name, p_name, top[, via])``: each is marked kept, raked or compressed.

    The link into a compressed node becomes a bypass to the node above, which stays, in the same
    round, so no link is recorded whose parent vanishes with it and all links of a leaf are raked
    at once.  ``unary`` tells that the child could be compressed under another coin.
    """
    ends = F.array(F.struct(F.col("c").alias("node"), F.col("p").alias("up")), F.struct(F.col("p").alias("node"), F.lit(None).cast("long").alias("up")))
    stats = edges.select(F.inline(ends)).groupBy("node").agg(F.count("up").alias("ups"), F.count_if(F.col("up").isNull()).alias("downs"), F.min("up").alias("up"))
    unary = (F.col("ups") == 1) & (F.col("downs") == 1) & (F.col("up") != F.col("node"))
    gone = unary & _coin(F.col("node"), round_no) & ~_coin(F.col("up"), round_no)
    below = stats.where((F.col("downs") == 0) | unary).select(F.col("node").alias("c"), (F.col("downs") == 0).alias("leaf"), gone.alias("gone"))
    both = edges.join(below, "c", "left")
    listed = ["via"] if "via" in edges.columns else []
    above = both.where("gone").select(F.col("c").alias("p"), F.lit(True).alias("bypass"), *(F.col(x).alias(f"up_{x}") for x in ("p", "w", "name", "p_name", "top", *listed)))
    both = both.join(above, "p", "left")
    bypass = F.col("bypass").isNotNull()
    kind = F.when(F.col("leaf"), "raked").when(bypass, "kept").when(F.col("gone"), "compressed").otherwise("kept")
    via = [F.when(bypass, F.concat("up_via", F.array("up_name"), "via")).otherwise(F.col("via")).alias("via")] if listed else []
    over = [F.coalesce(f"up_{x}", x).alias(x) for x in ("p", "p_name", "top")]
    return both.select("c", *over, (F.col("w") + F.coalesce("up_w", F.lit(0))).alias("w"), "name", *via, kind.alias("kind"), F.coalesce(~F.col("leaf"), F.lit(False)).alias("unary"))


def _below(links: DataFrame, known: DataFrame | None) -> DataFrame:
    """What is known of the links' children from their parents, which are roots or known: ``(node, name, root, depth[, path])``."""
    listed = "via" in links.columns and (known is None or "path" in known.columns)
    top = {"root": F.when(F.col("top"), F.col("p_name")), "depth": F.lit(0), "path": F.array("p_name")}
    if known is None:
        got = links.select("*", *(top[c].alias(c) for c in ("root", "depth", "path")))
    else:
        names = [c for c in ("root", "depth", "path") if c in known.columns]
        got = links.join(known.select(F.col("node").alias("p"), *(F.col(c).alias(f"k_{c}") for c in names)), "p", "left")
        got = got.select(*links.columns, *(F.coalesce(f"k_{c}", top[c]).alias(c) for c in names))
    got = got.where("root is not null")
    cyclic = F.col("root") == CYCLE_ROOT
    depth = F.when(cyclic, CYCLE_DEPTH).otherwise(F.col("depth") + F.col("w")).cast("int")
    if not listed:
        return got.groupBy(F.col("c").alias("node"), "name", "root").agg(F.min(depth).alias("depth"))
    path = F.when(cyclic, F.array().cast("array<string>")).otherwise(F.concat("path", "via", F.array("name")))
    best = got.groupBy(F.col("c").alias("node"), "name", "root").agg(F.min(F.struct(depth.alias("depth"), path.alias("path"))).alias("s"))
    return best.select("node", "name", "root", "s.depth", "s.path")


def _own(links: DataFrame) -> DataFrame:
    """In a closure: the links' children as their own ancestors, and the bypassed nodes above them."""
    inner = links.select(F.col("c").alias("node"), "name", F.posexplode(F.concat("via", F.array("name"))).alias("i", "root"), F.size("via").alias("n"))
    return inner.select("node", "name", "root", (F.col("n") - F.col("i")).cast("int").alias("depth"))


def _least(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node", "name", "root").agg(F.min("depth").alias("depth"))


def _core(edges: DataFrame, n: int, with_paths: bool, closure: bool) -> DataFrame:
    """What is known of the uncontractible core's nodes, by peeling and relaxation from above."""
    left = edges.where("not top").select("c", "p", "name")
    while True:  # free the nodes whose every way up ends
        left = _fit(cut(left), n)
        free = left.select("p").distinct().join(left.select(F.col("c").alias("p")).distinct(), "p", "left_anti")
        if free.isEmpty():
            break
        left = left.join(free, "p", "left_anti")
    marks = left.select(F.col("c").alias("node"), "name").distinct().select("node", "name", F.lit(CYCLE_ROOT).alias("root"), F.lit(CYCLE_DEPTH).alias("depth"), *([F.array().cast("array<string>").alias("path")] if with_paths else []))
    edges = _fit(edges, n)
    first = _below(edges, None)
    first = first if with_paths else first.drop("path")
    known = front = _fit(cut(_least(first.unionByName(_own(edges))) if closure else first), n)
    rank = [c for c in ("depth", "path") if c in known.columns]
    inner = edges.where("not top")
    while True:
        best = known.select("node", "root", F.struct(*rank).alias("had"))
        front = _fit(cut(_below(inner, front).join(best, ["node", "root"], "left").where(F.col("had").isNull() | (F.struct(*rank) < F.col("had"))).drop("had")), n)
        if front.isEmpty():
            break
        known = _fit(cut(known.join(front.select("node", "root"), ["node", "root"], "left_anti").unionByName(front)), n)
    return cut(known.unionByName(marks))


def _numbered(nodes: DataFrame) -> tuple[DataFrame, int]:
    """``(node, name)``: each name's 64-bit hash, under the first seed that tells all names apart."""
    seed = 0
    while True:
        ids = cut(nodes.where("node is not null").groupBy(F.xxhash64("node", F.lit(seed)).alias("id")).agg(F.min("node").alias("name"), F.max("node").alias("other")))
        if ids.where("name <> other").isEmpty():
            return ids.select(F.col("id").alias("node"), "name"), seed
        seed += 1


def contract_hierarchy(nodes: DataFrame, links: DataFrame, with_paths: bool = False, closure: bool = False) -> DataFrame:
    """Rows ``(node, root, depth[, path])``: each node with every root above it, by the fewest links.

    ``nodes(node)`` holds the nodes, ``links(child, parent)`` their links; links to or from what
    is no node are ignored, repeated links count once, and a link to itself is a cycle.  A root is
    its own root at depth 0.  A node on a cycle, or with a way up into one, has one more row with
    root ``''`` and depth -1.  ``path`` (root first, empty in a cycle's row) comes ``with_paths``;
    of several shortest paths the smallest stands.  No nodes give no rows.  With ``closure`` every
    node counts as a root of its own, so the rows are all pairs of a node and an ancestor; the
    bypassed nodes that compression recorded are among these.

    Contraction goes on as long as it finds a leaf, or chains make up a good part of what is left,
    however little that is; rounds grow with the logarithm of unary chains and with the depth of
    branching in several parents; lineage is cut every round.  Nodes go by the hashes of their
    names, and names only ride along.
    """
    spark = nodes.sparkSession
    ids, seed = _numbered(nodes)

    def number(c: str) -> Column:
        return F.xxhash64(c, F.lit(seed))

    pairs = links.where("child is not null and parent is not null").select(number("child").alias("c"), F.col("child").alias("name"), number("parent").alias("p"), F.col("parent").alias("p_name"))
    pairs = pairs.join(ids.withColumnRenamed("node", "c"), ["c", "name"], "left_semi").join(ids.select(F.col("node").alias("p"), F.col("name").alias("p_name")), ["p", "p_name"], "left_semi").dropDuplicates(["p", "p_name", "c", "name"])
    via = [F.array().cast("array<string>").alias("via")] if with_paths or closure else []
    parents = pairs.select(F.col("c").alias("p")).distinct().withColumn("inner", F.lit(True))
    edges = cut(pairs.join(parents, "p", "left").select("c", "p", F.lit(1).alias("w"), "name", "p_name", F.col("inner").isNull().alias("top"), *via))

    first = edges
    records: list[tuple[DataFrame, int]] = []
    left, more, round_no = edges.count(), True, 0
    while left and more:
        with one_task(spark, left <= TASK_LINKS):
            step = cut(_contract(_fit(edges, left), round_no))
            left, done, raked, unary = _fit(step, left).agg(F.count_if(F.col("kind") == "kept"), F.count_if(F.col("kind") != "kept"), F.count_if(F.col("kind") == "raked"), F.count_if((F.col("kind") == "kept") & F.col("unary"))).first()
        if done:
            records.append((step.where("kind <> 'kept'").drop("kind", "unary"), done))
        edges = step.where("kind = 'kept'").drop("kind", "unary")
        more = raked or unary > left // 4
        round_no += 1
    known = None
    if left:
        with one_task(spark, left <= TASK_LINKS):
            known = _core(edges, left, with_paths, closure)
    settled = left
    for step, done in reversed(records):
        settled += done
        with one_task(spark, settled <= TASK_LINKS):
            step, known = _fit(step, settled), known if known is None else _fit(known, settled)
            got = _below(step, known)
            got = got if with_paths else got.drop("path")
            got = cut(_least(got.unionByName(_own(step))) if closure else got)
        known = got if known is None else known.unionByName(got)
    path = [F.array("name").alias("path")] if with_paths else []
    top = ids.join(first.select(F.col("c").alias("node")), "node", "left_anti").select("node", "name", F.col("name").alias("root"), F.lit(0).alias("depth"), *path)
    known = top if known is None else top.unionByName(known)
    return known.select(F.col("name").alias("node"), *known.columns[2:])


def descendants(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``(node, descendant, depth)``: everything below each node, by the fewest links."""
    rows = contract_hierarchy(nodes, links, closure=True).where("depth > 0 and root <> node")
    return rows.select(F.col("root").alias("node"), F.col("node").alias("descendant"), "depth")


def qualified(name: Column, module: Column) -> Column:
    """An xml id without its outer blanks; one without a dot belongs to the row's module."""
    bare = F.trim(name)
    return F.when(bare == "", None).when(F.contains(bare, F.lit(".")), bare).otherwise(F.concat(F.trim(module), F.lit("."), bare))
