"""Prefix trie of conversations by fixed-length block hashing (operator 11).

A conversation is cut into blocks of ``BLOCK`` turns.  Each block gets the digest of all turns up to its end, so conversations with
one digest share that whole prefix; they are grouped by these digests first.  A group (an *edge* of the block trie) stands for all its
conversations from there on.  Only where a group is followed by different blocks, turn boundaries inside these blocks are told apart by digests of
their own; elsewhere a block's turns are one path, whatever the number of conversations on it.

Sums over subtrees need no walk up the trie.  Let conversation m own the nodes of which it is the smallest member: these are the nodes of its
path from some depth on.  With F(m) the words of its turns above the first node it owns, the nodes below and including a node v of n
members that follows W words save  sum of F(m) over its members - F(smallest member) - (n - 1) * W  tokens; leaves below v are the
members that own the childless end of their path.  Both are sums per group, then per node.
"""

from __future__ import annotations

from collections.abc import Iterator

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, release

BLOCK = 4
#: Blocks whose digests one task folds in one go; a longer conversation goes on in the next stretch.
STRETCH = 4096
#: Turn numbers of one chunk of a conversation while turns are numbered.
CHUNK = 1024
#: Decimal ids joined into one piece before a node's digest is taken.
PIECE_IDS = 8192
WORD = r"[^\x20\x09-\x0D]+"


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_hash, words): turns from 0, in ascending order of ``turn``, null first, ties by digest of role and text.

    Numbers come in two levels (chunks of turn numbers, then rows of a chunk), so a conversation of very many turns is not one task's.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("turn_hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"),
    )
    turns = turns.withColumn("_chunk", F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))))
    sizes = turns.groupBy("conv_id", "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("conv_id", "_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("conv_id", "_chunk").orderBy(F.col("turn").asc_nulls_first(), "turn_hash")
    numbered = turns.withColumn("_row", F.row_number().over(inside))
    return numbered.join(sizes, ["conv_id", "_chunk"]).select("conv_id", (F.col("_before") + F.col("_row") - 1).alias("pos"), "turn_hash", "words")


def rebuild(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Numbered turns of every conversation c after its first h = crc32(c) % ``heads`` turns became those of c - c % ``family``."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    ids = turns.select("conv_id").distinct().withColumn("_h", h).withColumn("_base", F.col("conv_id") - F.col("conv_id") % family)
    first = turns.filter((F.col("pos") < heads - 1) & (F.col("conv_id") % family == 0)).withColumnRenamed("conv_id", "_base")
    had = first.groupBy("_base").agg(F.count(F.lit(1)).alias("_had"))
    taken = ids.join(first, "_base").filter(F.col("pos") < F.col("_h")).select("conv_id", "pos", "turn_hash", "words")
    fewer = ids.join(had, "_base", "left").select("conv_id", (F.col("_h") - F.coalesce("_had", F.lit(0))).alias("_short")).filter("_short > 0")  # these move up
    own = turns.filter(F.col("pos") >= h).join(fewer, "conv_id", "left").withColumn("pos", F.col("pos") - F.coalesce("_short", F.lit(0)))
    return taken.unionByName(own.select("conv_id", "pos", "turn_hash", "words"))


_FOLDED = {"conv_id": pa.int64(), "stretch": pa.int64(), "k": pa.int64(), "up": pa.string(), "digest": pa.string(), "hashes": pa.list_(pa.string()), "words": pa.list_(pa.int64()), "before": pa.int64()}


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of (conv_id, stretch) in order: digests and words of the stretch up to each block."""
    at, up, total = None, "", 0
    for batch in batches:
        out = []
        for conv, stretch, k, hashes, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "stretch", "k", "hashes", "words"))):
            if (conv, stretch) != at:
                at, up, total = (conv, stretch), "", 0
            digest = hashlib.sha256("".join([up, *hashes]).encode()).hexdigest()
            out.append((conv, stretch, k, up, digest, hashes, words, total))
            up, total = digest, total + sum(words)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _FOLDED.values())], list(_FOLDED))


def blocks(turns: DataFrame, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """One row per conversation and block k: digests of all turns before (``up``) and up to its end, its turns, words before it.

    A conversation of more than ``stretch`` blocks is folded in stretches side by side; digests then carry those of the stretches
    before, so equal prefixes still have equal digests.
    """
    cut = turns.groupBy("conv_id", F.floor(F.col("pos") / block).alias("k")).agg(F.sort_array(F.collect_list(F.struct("pos", "turn_hash", "words"))).alias("t"))  # at most ``block`` turns
    cut = cut.select("conv_id", F.floor(F.col("k") / stretch).alias("stretch"), "k", F.col("t.turn_hash").alias("hashes"), F.col("t.words").alias("words"))
    cut = cut.repartition("conv_id", "stretch").sortWithinPartitions("conv_id", "stretch", "k")
    cut = cut_lineage(cut.mapInArrow(_fold, "conv_id long, stretch long, k long, up string, digest string, hashes array<string>, words array<long>, before long"))
    total = F.col("before") + F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)
    long = cut.filter("stretch > 0").select("conv_id").distinct()
    ends = cut.join(long, "conv_id", "left_semi").groupBy("conv_id", "stretch").agg(F.max_by(F.struct("digest", total.alias("total")), "k").alias("e"))
    earlier = Window.partitionBy("conv_id").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_d", F.when(F.col("stretch") > 0, F.sha2(F.concat_ws("", F.collect_list("e.digest").over(earlier)), 256)))
    carried = lambda c: F.when(F.col("_d").isNull(), c).otherwise(F.sha2(F.concat("_d", c), 256))
    order = Window.partitionBy("conv_id").orderBy("stretch")
    ends = ends.select("conv_id", "stretch", "_d", F.lag(carried(F.col("e.digest"))).over(order).alias("_up"), F.sum("e.total").over(earlier).alias("_w")).filter("stretch > 0")
    out = cut.join(ends, ["conv_id", "stretch"], "left").select(
        "conv_id", "k", F.when(F.col("up") == "", F.coalesce("_up", F.lit(""))).otherwise(carried(F.col("up"))).alias("up"), carried(F.col("digest")).alias("digest"), "hashes", "words", (F.col("before") + F.coalesce("_w", F.lit(0))).alias("before")
    )
    out._table_path = cut._table_path  # goes with the frame
    return out


def steps(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """The turns of each edge(digest, up, k, n, conv_id, hashes, words, before) as (id, parent_id, depth, ...): the nodes they end at.

    The end of a full block is named by the block's digest.  Turns inside get digests of their own only where other blocks
    follow the same prefix; the turns of a lone block are numbered.
    """
    lone = edges.groupBy("up").agg(F.count(F.lit(1)).alias("_n"), F.max("digest").alias("digest")).filter("_n = 1").select("digest", F.lit(True).alias("_lone"))
    turn = edges.join(lone, "digest", "left").withColumn("j", F.explode(F.sequence(F.lit(1), F.size("hashes"))))

    def name(j):
        inside = F.when(F.col("_lone"), F.concat("digest", F.lit(":"), j.cast("string"))).otherwise(F.sha2(F.concat("up", F.lit(":"), F.array_join(F.slice("hashes", 1, j), "")), 256))
        return F.when(j == 0, F.col("up")).when(j == block, F.col("digest")).otherwise(inside)

    j = F.col("j")
    return turn.select(
        name(j).alias("id"), name(j - 1).alias("parent_id"), (F.col("k") * block + j).alias("depth"), "digest", (j == F.size("hashes")).alias("last"), "n", "conv_id",
        (F.col("before") + F.aggregate(F.slice("words", 1, j - 1), F.lit(0).cast("long"), lambda a, x: a + x)).alias("before"),
    )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids in order, joined by commas."""
    at, ids = None, []

    def piece():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))], pa.string())], ["digest", "first", "ids"])

    for batch in batches:
        for digest, conv in zip(batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (digest != at or len(ids) >= PIECE_IDS):
                yield piece()
                ids = []
            at = digest
            ids.append(conv)
    if ids:
        yield piece()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each digest, one after another."""
    at, h, out = None, None, []
    for batch in batches:
        for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
            if digest != at:
                out += [(at, h.hexdigest())] if h else []
                at, h = digest, hashlib.sha256(ids.encode())
            else:
                h.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["digest", "ends_sha256"])
            out = []
    if h:
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.string()), pa.array([h.hexdigest()], pa.string())], ["digest", "ends_sha256"])


def ends_hash(ends: DataFrame) -> DataFrame:
    """SHA-256 of the ids of ends(digest, conv_id) by digest, ascending and comma-joined.

    A hash takes its text in order, so one task reads a digest's text; it does so from joined pieces of a sort over all tasks,
    without holding them.
    """
    text = ends.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id").mapInArrow(_pieces, "digest string, first long, ids string")
    return text.repartition("digest").sortWithinPartitions("digest", "first").mapInArrow(_hashed, "digest string, ends_sha256 string")


def trie(turns: DataFrame, conversations: DataFrame, block: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """Nodes of the prefix trie of numbered turns(conv_id, pos, turn_hash, words); ``conversations(conv_id)`` also lists those without turns."""
    folded = blocks(turns, block, stretch)
    rows = cut_lineage(folded)
    release(folded)
    edges = cut_lineage(rows.groupBy("digest").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n"), F.first(F.struct("up", "k", "hashes", "words", "before")).alias("e")).select("digest", "conv_id", "n", "e.*"))
    ids = conversations.select("conv_id").distinct()
    turn = cut_lineage(steps(edges, block))
    root = ids.agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id")).filter("n > 0")
    root = root.select(F.lit("").alias("id"), F.lit(None).cast("string").alias("parent_id"), F.lit(0).cast("long").alias("depth"), "n", "conv_id", F.lit(0).cast("long").alias("before"))
    nodes = turn.groupBy("id").agg(F.first("parent_id").alias("parent_id"), F.first("depth").alias("depth"), F.sum("n").alias("n"), F.min("conv_id").alias("conv_id"), F.first("before").alias("before"))
    plain = nodes = cut_lineage(nodes.unionByName(root))
    children = nodes.filter("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    # What a conversation brings to every node on its path: words above its first own node, and whether its path's end is an own leaf.
    own = nodes.groupBy("conv_id").agg(F.min_by("before", "depth").alias("own"), F.max_by((F.col("n_children") == 0).cast("long"), F.col("depth")).alias("leaf"))
    last = rows.groupBy("conv_id").agg(F.max_by(F.struct("digest", (F.col("before") + F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x)).alias("total")), "k").alias("e")).select("conv_id", "e.*")
    value = ids.join(last, "conv_id", "left").join(own, "conv_id", "left")
    value = cut_lineage(value.select("conv_id", F.coalesce("digest", F.lit("")).alias("digest"), F.coalesce("own", "total", F.lit(0)).alias("own"), F.coalesce("leaf", F.lit(0)).alias("leaf")))
    sums = [F.sum("own").alias("own"), F.sum("leaf").alias("n_leaves"), F.min_by("own", "conv_id").alias("least"), F.min("conv_id").alias("conv_id")]
    by_edge = rows.select("conv_id", "digest").join(value.drop("digest"), "conv_id").groupBy("digest").agg(*sums)
    by_node = turn.select("id", "digest").join(by_edge, "digest").groupBy("id").agg(F.sum("own").alias("own"), F.sum("n_leaves").alias("n_leaves"), F.min_by("least", "conv_id").alias("least"))
    by_node = by_node.unionByName(value.agg(*sums).filter("conv_id is not null").select(F.lit("").alias("id"), "own", "n_leaves", "least"))
    ends = ends_hash(value.select("digest", "conv_id")).join(turn.filter("last").select("digest", "id"), "digest", "left")
    ends = ends.select(F.when(F.col("digest") == "", F.lit("")).otherwise(F.col("id")).alias("id"), "ends_sha256")
    out = cut_lineage(nodes.join(by_node, "id").join(ends, "id", "left"))
    for done in (rows, edges, turn, plain, value):
        release(done)
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    out = out.join(parents, "parent_id", "left").select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", (F.col("own") - F.col("least") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    return out


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of ``conversations(conv_id, turn, role, text)`` after the heads of each family were exchanged (``rebuild``).

    Per node: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256.  Null roles and texts are empty; a null turn comes first; rows of one turn are ordered by the SHA-256 of their role and text, and
    repeated rows are turns of their own.  Rows without conv_id belong to no conversation.  Words of a long text all count.  Other
    columns are not read.  No conversations give no rows; a conversation without turns is a member of the root alone.
    """
    turns = cut_lineage(numbered_turns(conversations))
    ids = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"))
    out = trie(rebuild(turns), ids)
    release(turns)
    return out


SQL = r"""
with recursive codes as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as t),
rows_ as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
numbered as (
  select conv_id, concat(length(role), ':', role, text) as said, len(regexp_extract_all(text, '[^ 	-
]+')) as words,
    row_number() over (partition by conv_id order by turn nulls first, sha256(concat(length(role), ':', role, text))) - 1 as pos
  from rows_),
ids as (
  select c, c - c % 20 as base, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(c::varchar) + 1), lambda i: ascii(substr(c::varchar, i, 1))::bigint)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 4 as h
  from (select distinct conv_id as c from numbered), codes),
rebuilt as (
  select c, 0 as part, pos, said, words from ids join numbered on conv_id = base where pos < h
  union all
  select c, 1, pos, said, words from ids join numbered on conv_id = c where pos >= h),
paths as (
  select c, words, list(said) over (partition by c order by part, pos rows unbounded preceding) as path, lead(pos) over (partition by c order by part, pos) is null as ends from rebuilt
  union all
  select c, 0, []::varchar[], not exists (select 1 from rebuilt r where r.c = ids.c) from ids),
nodes as (
  select path, len(path) as depth, min(c) as conv_id, count(*) as n, any_value(words) as words, coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '') as ended
  from paths group by path),
children as (select path[1:depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by 1),
above as (
  select n.path[1:i] as path, count(*) filter (c.path is null) as n_leaves, sum((n.n - 1) * n.words) as saved
  from nodes n left join children c on n.path = c.path, unnest(range(0, depth + 1)) as u(i) group by 1)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n as n_convs, coalesce(n_children, 0)::bigint as n_children, n_leaves::bigint as n_leaves,
  saved::bigint as saved_tokens, sha256(n.ended) as ends_sha256
from nodes n join above a on a.path = n.path left join children c on c.path = n.path left join nodes p on n.depth > 0 and p.path = n.path[1:n.depth - 1]
"""
