"""K-d tree partitioning into shards of equal bytes (operator 9), with DataFrame functions only.

A node of the tree is split at the weighted median (weights: bytes) of its widest metadata dimension, all
nodes of a level at once, until every leaf holds its share of the bytes.  The median is found by histograms
that Spark aggregates: each round keeps the bucket with the median and refines it, so the driver sees at most
``BUCKETS`` sums per node.  Equal values are divided by doc_id, so one value of a third of all rows splits too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordered import row_index
from tidemark.session import cut_lineage

BUCKETS = 512
#: A bucket with less than this share of its node's bytes is not refined further.
FINE = 2e-5
CHUNK_ROWS = 100_000


@dataclass
class Node:
    """A node of the tree: shards [first, first + count); split by (dimension, value, doc_id) once known."""

    first: int
    count: int
    dim: str = ""
    value: float = 0.0
    id: int | None = None  # rows of exactly `value` go left up to this id; None: none of them
    left: Node | None = None
    right: Node | None = None


def _goes_left(n: Node) -> Column:
    tie = F.lit(False) if n.id is None else (F.col(n.dim) == n.value) & (F.col("_id") <= n.id)
    return (F.col(n.dim) < n.value) | tie


def _leaf(n: Node) -> Column:
    """First shard of the leaf a row falls into: nested conditions, one per node."""
    return F.when(_goes_left(n), _leaf(n.left)).otherwise(_leaf(n.right)) if n.left else F.lit(n.first)


@dataclass
class _Search:
    """The histogram search for one node's split."""

    node: Node
    column: str  # what is searched: the dimension, then the id among equal values
    low: float
    high: float
    before: int
    target: float
    total: int
    done: bool = False

    def refine(self, rows: list) -> None:
        """rows: (bucket, bytes, min, max) of the interval, ascending."""
        for _, held, low, high in rows:
            if self.before + held < self.target:
                self.before += held
                continue
            stuck = (low, high) == (self.low, self.high) and len(rows) == 1
            if low < high and held > FINE * self.total and not stuck:
                self.low, self.high = low, high
            elif self.column != "_id" and low == high and held > FINE * self.total:
                self.node.value, self.column, self.low, self.high = low, "_id", None, None
            else:
                self._settle(held, low, high)
            return
        self._settle(0, self.high, self.high)

    def _settle(self, held: int, low, high) -> None:
        take = self.before + held - self.target <= self.target - self.before
        if self.column == "_id":
            self.node.id = int(high) if take else int(low) - 1
        else:
            self.node.value, self.node.id = (high, (1 << 63) - 1) if take else (low, None)
        self.done = True


def _split_level(rows: DataFrame, root: Node, level: list[Node], dims: list[str]) -> None:
    """Find the split of every node of a level (each node's ``first`` is its label)."""
    label = _leaf(root)
    stats = rows.groupBy(label.alias("n")).agg(F.sum("size").alias("s"), *[f(c).alias(f"{k}{c}") for c in dims for k, f in (("lo", F.min), ("hi", F.max))]).collect()
    by, searches = {r.n: r for r in stats}, {}
    for n in level:
        r = by.get(n.first)
        if r is None:  # no rows: any split will do
            n.dim, n.value, n.id = dims[0], 0.0, None
            continue
        n.dim = max(dims, key=lambda c: r[f"hi{c}"] - r[f"lo{c}"])
        searches[n.first] = _Search(n, n.dim, r[f"lo{n.dim}"], r[f"hi{n.dim}"], 0, r.s * (n.count // 2) / n.count, r.s)
    while active := {k: s for k, s in searches.items() if not s.done}:
        at = None
        x = low = high = hit = None
        for k, s in active.items():
            mine = F.col("_n") == k
            if s.column == "_id":
                mine &= F.col(s.node.dim) == s.node.value
            bounds = (s.low, s.high) if s.low is not None else (float(-(1 << 63)), float(1 << 63))
            pick = lambda old, new: F.when(mine, new) if old is None else old.when(mine, new)  # noqa: B023, E731
            x, low, high = pick(x, F.col(s.column).cast("double")), pick(low, F.lit(float(bounds[0]))), pick(high, F.lit(float(bounds[1])))
            hit = mine if hit is None else hit | mine
        first_ids = any(s.low is None for s in active.values())
        part = rows.withColumn("_n", label).where(hit).select("_n", "size", x.alias("_x"), "_id", low.alias("_l"), high.alias("_h"))
        if first_ids:  # the range of ids among equal values is not known yet
            for r in part.groupBy("_n").agg(F.min("_x").alias("l"), F.max("_x").alias("h")).collect():
                if active[r["_n"]].low is None:
                    active[r["_n"]].low, active[r["_n"]].high = r.l, r.h
            continue
        at = F.when(F.col("_h") > F.col("_l"), F.least(F.floor((F.col("_x") - F.col("_l")) / (F.col("_h") - F.col("_l")) * BUCKETS), F.lit(BUCKETS - 1))).otherwise(F.lit(0))
        sums = part.where(F.col("_x").between(F.col("_l"), F.col("_h"))).groupBy("_n", at.alias("b")).agg(F.sum("size").alias("s"), F.min("_x").alias("l"), F.max("_x").alias("h")).collect()
        for k, s in active.items():
            s.refine([(r.b, r.s, r.l, r.h) for r in sorted((r for r in sums if r["_n"] == k), key=lambda r: r.b)])


def kd_shards(docs: DataFrame, shards: int = 16, dims: dict[str, Column] | None = None) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)`` for every row of ``docs(doc_id, text, lang, source)``.

    ``size`` is the UTF-8 bytes of the text (null: none) plus 1; ``text_crc32`` of a null text is 0.  Shards hold
    near equal bytes: a split is off by one document or ``FINE`` of the node's bytes.  ``slot`` counts from 0 without gaps in each shard.  Repeated
    rows and null ids are rows like others (a null id sorts first); rows equal in all dimensions and id stay on
    one side.  An empty table gives no rows.  ``dims``: numeric columns over ``docs``, scaled to [0, 1] of their range.
    """
    dims = dims or {"lang": F.crc32("lang"), "source": F.crc32("source"), "length": F.log2(F.octet_length("text") + 1.0)}
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = cut_lineage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("_id"), *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_d{i}") for i, c in enumerate(dims.values())],
    ))
    names = [f"_d{i}" for i in range(len(dims))]
    span = rows.agg(F.count(F.lit(1)).alias("n"), *[f(c).alias(f"{k}{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))]).first()
    root = Node(0, shards)
    if span.n:
        scaled = rows.select("doc_id", "size", "text_crc32", "_id", *[((F.col(c) - span[f"lo{c}"]) / max(span[f"hi{c}"] - span[f"lo{c}"], 1e-9)).alias(c) for c in names])
        level = [root]
        while level := [n for n in level if n.count > 1]:
            _split_level(scaled, root, level, names)
            for n in level:
                half = n.count // 2
                n.left, n.right = Node(n.first, half), Node(n.first + half, n.count - half)
            level = [x for n in level for x in (n.left, n.right)]
        rows = scaled
    chunks = span.n // CHUNK_ROWS + 1
    placed = rows.select("doc_id", "size", "text_crc32", _leaf(root).cast("int").alias("shard"), F.pmod(F.xxhash64("_id", "text_crc32"), F.lit(chunks)).alias("_chunk"))
    return row_index(placed, ["shard"], "_chunk", ["doc_id", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))
