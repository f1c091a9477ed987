"""N-gram Jaccard join as a blocked sparse matrix product (operator 2).

The incidence matrix (texts x distinct word shingles) is cut into blocks of shingles.  A block's product with
its transpose tells which shingles occur in more than one text; only those can add to an overlap.  Bounds that
follow from the sizes then discard work without losing a pair:

* 100 * overlap >= 75 * union needs overlap >= 0.75 * size, so a text with fewer shared shingles has no partner;
* with every text's shingles in one common order, rarest first, partners share one of the first
  size - ceil(0.75 * size) + 1; shingles of a single text fill part of that prefix for free;
* partners' sizes differ by a quarter at most.

* the symmetric difference is at most (100 - 75) / (100 + 75) of the sizes' sum; shingles of a single text count in full, and
  the bits in which parity maps of the others differ bound the rest from below.

Equal sets are one node throughout, so copies cost nothing.  Groups of near copies are joined by stars first, around the node with
the fewest shingles of its own; after that only pairs from different components that pass all bounds are compared, each exactly, so no
link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.wordbuf import Texts, mix, pieces
from tidemark.operators.graph import connected_components
from tidemark.session import cut_lineage

WORDS = 5
PERCENT = 75
BLOCK_ENTRIES = 1 << 20
CHUNK_ENTRIES = 1 << 21
CHUNK_TEXTS = 60_000
HASH_BITS = 48
MAP_WORDS = 4  # longs of a parity map
_DOC = np.uint64(16)
_LOW = np.uint64(0xFFFF)


def _sets(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a run of at most ``CHUNK_TEXTS`` texts: sorted keys (shingle hash << 16 | text), set sizes, set digests (0 without words)."""
    t = Texts.of(column, lower=True)
    at, h = t.shingles(words, short=True)
    keys = np.unique((h >> np.uint64(64 - HASH_BITS) << _DOC) | t.word_text[at].astype(np.uint64))
    text = (keys & _LOW).astype(np.uint16)
    size = np.bincount(text, minlength=t.n)
    order = np.argsort(text, kind="stable")
    run = np.zeros(len(keys) + 1, np.uint64)
    np.cumsum(mix((keys >> _DOC) + np.uint64(0x632BE59BD9B4E019))[order], out=run[1:])
    cut = np.concatenate([[0], np.cumsum(size)])
    digest = mix(run[cut[1:]] - run[cut[:-1]] + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    digest[size == 0] = 0
    return keys, size, digest


def _runs(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    for first, part in pieces(column):
        for k in range(0, len(part), CHUNK_TEXTS):
            yield first + k, part.slice(k, CHUNK_TEXTS)


def members(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``(doc_id, n_shingles, node)``: equal sets have equal nodes; a text without words has none."""

    def run(batches):
        for b in batches:
            for first, column in _runs(b.column("text")):
                _, size, digest = _sets(column, words)
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, len(column)), pa.array(size, pa.int64()), pa.array(digest.view(np.int64), mask=size == 0)], ["doc_id", "n_shingles", "node"]
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long")


def _binary(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _incidence(texts: DataFrame, words: int, bits: int) -> DataFrame:
    """Chunks of the matrix by block of shingles (the first ``bits`` of the hash)."""
    schema = pa.schema([("block", pa.int32()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary()), ("hash", pa.binary())])

    def chunk(held) -> pa.RecordBatch:
        keys, size, digest, base = [], [], [], 0
        for k, s, d in held:
            keys.append(k + np.uint64(base))
            size.append(s)
            digest.append(d)
            base += len(s)
        keys, size, digest = np.concatenate(keys), np.concatenate(size), np.concatenate(digest)
        first = np.zeros(len(size), bool)
        first[np.unique(digest, return_index=True)[1]] = True  # copies inside the chunk count once
        keys = np.sort(keys[first[(keys & _LOW).astype(np.int64)]])
        block = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        rows, cut = [], np.searchsorted(block, np.arange((1 << bits) + 1))
        for b in np.flatnonzero(np.diff(cut)):
            part = keys[cut[b] : cut[b + 1]]
            text = part & _LOW
            used, local = np.unique(text, return_inverse=True)
            step = np.diff(part >> _DOC, prepend=np.uint64(0))
            step[0] = (part[0] >> _DOC) - np.uint64(int(b) << (HASH_BITS - bits))
            if step.max() < 1 << 32:
                step = step.astype(np.uint32)
            used = used.astype(np.int64)
            rows.append((int(b), _binary(digest[used]), _binary(size[used].astype(np.uint32)), _binary(local.astype(np.uint16)), _binary(step)))
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    def run(batches):
        held, entries, texts_held = [], 0, 0
        for b in batches:
            for _, column in _runs(b.column("text")):
                if held and (entries >= CHUNK_ENTRIES or texts_held + len(column) > CHUNK_TEXTS):
                    yield chunk(held)
                    held, entries, texts_held = [], 0, 0
                held.append(_sets(column, words))
                entries += len(held[-1][0])
                texts_held += len(column)
        if entries:
            yield chunk(held)

    return texts.mapInArrow(run, "block int, nodes binary, sizes binary, text binary, hash binary")


def _shared(incidence: DataFrame, bits: int, node_blocks: int) -> DataFrame:
    """Per block: the shingles of two nodes or more, handed to the nodes they belong to."""
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("rank", pa.binary()), ("df", pa.binary())])

    def product(table: pa.Table) -> pa.Table:
        block, hashes, nodes, sizes = table["block"][0].as_py(), [], [], []
        for r in range(table.num_rows):
            local = np.frombuffer(table["text"][r].as_buffer(), np.uint16)
            raw = table["hash"][r].as_buffer()
            hashes.append(np.cumsum(np.frombuffer(raw, np.uint32 if raw.size == 4 * len(local) else np.uint64), dtype=np.uint64))
            nodes.append(np.frombuffer(table["nodes"][r].as_buffer(), np.uint64)[local])
            sizes.append(np.frombuffer(table["sizes"][r].as_buffer(), np.uint32)[local])
        h, node, size = np.concatenate(hashes), np.concatenate(nodes), np.concatenate(sizes)
        order = np.argsort(h)
        twin = np.diff(h[order]) == 0
        some = order[np.concatenate([twin, [False]]) | np.concatenate([[False], twin])]
        h, node, size = h[some], node[some], size[some]
        order = np.lexsort((node, h))  # copies of a text from several chunks are one
        h, node, size = h[order], node[order], size[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, size = h[new], node[new], size[new]
        _, rank, df = np.unique(h, return_inverse=True, return_counts=True)
        df = df[rank]
        real = df > 1
        node, size, rank, df = node[real], size[real], rank[real], df[real]
        part = (node % np.uint64(node_blocks)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(node_blocks + 1))
        rows = []
        for p in np.flatnonzero(np.diff(cut)):
            at = order[cut[p] : cut[p + 1]]
            rows.append((int(p), block, _binary(node[at]), _binary(size[at]), _binary(rank[at].astype(np.uint32)), _binary(np.minimum(df[at], 65535).astype(np.uint16))))
        return pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    return incidence.groupBy("block").applyInArrow(product, "part int, block int, nodes binary, sizes binary, rank binary, df binary")


def _bounded(shared: DataFrame, percent: int) -> DataFrame:
    """Nodes with enough shared shingles: size, number of own shingles, parity map, all shared shingles, and the prefix that partners must meet in."""
    schema = pa.schema([("node", pa.int64()), ("n", pa.int64()), ("own", pa.int64()), ("map", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64()))])

    def parity(shingles: np.ndarray) -> np.ndarray:
        odd = np.bincount((mix(shingles.astype(np.uint64)) % np.uint64(64 * MAP_WORDS)).astype(np.int64), minlength=64 * MAP_WORDS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    def bound(table: pa.Table) -> pa.Table:
        join = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table[name]])
        node, size, rank, df = join("nodes", np.uint64), join("sizes", np.uint32).astype(np.int64), join("rank", np.uint32).astype(np.int64), join("df", np.uint16)
        per_row = np.array([x.as_buffer().size // 8 for x in table["nodes"]])
        shingle = np.repeat(table["block"].to_numpy().astype(np.int64), per_row) << 32 | rank
        order = np.lexsort((shingle, df, node))
        node, size, shingle = node[order], size[order], shingle[order]
        head = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        end = np.concatenate([head[1:], [len(node)]]) if len(head) else head
        out = []
        for a, b in zip(head, end):
            n = int(size[a])
            need = -(-percent * n // 100)
            if b - a >= need:
                prefix = n - need + 1 - (n - int(b - a))
                out.append({"node": int(node[a].astype(np.int64)), "n": n, "own": n - int(b - a), "map": parity(shingle[a:b]), "shared": np.sort(shingle[a:b]), "prefix": shingle[a : a + prefix]})
        return pa.Table.from_pylist(out, schema)

    return shared.groupBy("part").applyInArrow(bound, "node long, n long, own long, map array<long>, shared array<long>, prefix array<long>")


def _alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are alike, by exact overlap."""
    left = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("shared").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("shared").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")


def _label(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select(F.col("node").alias("id"))
    return connected_components(edges, ids).select(F.col("id").alias("node"), F.col("component").alias("label"))


def _possible(percent: int, x: str, y: str):
    """Whether sizes, own shingles and parity maps of two nodes (columns with these endings) leave the pair a chance."""
    c = lambda name, end: F.col(f"{name}{end}")
    differ = c("own", x) + c("own", y)
    for k in range(MAP_WORDS):
        differ = differ + F.bit_count(c("map", x)[k].bitwiseXOR(c("map", y)[k]))
    total = c("n", x) + c("n", y)
    return (100 * F.least(c("n", x), c("n", y)) >= percent * F.greatest(c("n", x), c("n", y))) & ((100 + percent) * differ <= (100 - percent) * total)


def links(nodes: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Edges that connect every component of the similarity graph, and the components' labels."""
    traits = lambda end: nodes.select(F.col("node").alias(f"node{end}"), *[F.col(c).alias(f"{c}{end}") for c in ("n", "own", "map")])
    index = nodes.select("node", F.explode("prefix").alias("f"), F.floor(F.log(F.col("n").cast("double")) / -float(np.log(percent / 100))).alias("c"), (F.col("own") / F.col("n")).alias("share"))
    index = cut_lineage(index)
    # in every bucket (shingle, size class) each node meets one centre, the one with the smallest share of own shingles
    seats = index.groupBy("f", "c").agg(F.min(F.struct("share", "node")).alias("seat"), F.count(F.lit(1)).alias("k")).where("k > 1").select("f", "c", F.col("seat.node").alias("o"))
    met = index.join(seats, ["f", "c"]).where("node <> o").select(F.least("node", "o").alias("nodea"), F.greatest("node", "o").alias("nodeb")).distinct()
    met = met.join(traits("a"), "nodea").join(traits("b"), "nodeb").where(_possible(percent, "a", "b"))
    edges = cut_lineage(_alike(met.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")), nodes, percent))
    labels = _label(edges, nodes)
    # buckets that still hold several components: all pairs across them that the bounds allow
    now = index.join(labels, "node").select("f", "node", "label")
    split = now.groupBy("f").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("f")
    now = cut_lineage(now.join(split, "f", "left_semi").join(traits(""), "node"))
    a, b = (now.select("f", *[F.col(c).alias(f"{c}{k}") for c in ("node", "n", "own", "map", "label")]) for k in "ab")
    rest = a.join(b, "f").where((F.col("nodea") < F.col("nodeb")) & (F.col("labela") != F.col("labelb")) & _possible(percent, "a", "b"))
    found = cut_lineage(_alike(rest.select(F.col("nodea").alias("a"), F.col("nodeb").alias("b")).distinct(), nodes, percent))
    if found.limit(1).count():
        edges = edges.unionByName(found)
        labels = _label(edges, nodes)
    return edges, labels


def components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text)``.

    A set holds the distinct runs of ``words`` words (A-Z in lower case), a shorter text its whole sequence.  Texts
    link when 100 * overlap >= percent * union; ``component_id`` is the smallest doc_id that links reach.  Null texts and texts without words have no
    shingles and stay alone (a null doc_id too, if its text has no words; with words it takes its group's smallest id).  Repeated
    rows are equal sets.  An empty table gives no rows.  Shingles are told apart by 48 bits of a hash, sets by 64.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    member = cut_lineage(members(texts, words))
    total = member.agg(F.sum("n_shingles").alias("t")).first().t or 0
    bits = max(0, int(np.ceil(np.log2(max(total, 1) / BLOCK_ENTRIES))))
    nodes = cut_lineage(_bounded(_shared(_incidence(texts.select("text"), words, bits), bits, 1 << bits), percent))
    _, labels = links(nodes, percent)
    first = member.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_rep"))
    smallest = labels.join(first, "node").groupBy("label").agg(F.min("_rep").alias("_min"))
    linked = labels.join(smallest, "label").select("node", "_min")
    group = first.join(linked, "node", "left").select("node", F.coalesce("_min", "_rep").alias("component_id"))
    return member.join(group, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, all columns, without near duplicates: of each component the document of the smallest id stays.

    Of rows with one and the same id one stays.  Rows with a null id, and texts without words, are compared with nothing and stay.
    """
    found = components(docs.where("doc_id IS NOT NULL"), words, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("_near")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_salt"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    left = rows.join(found, F.col("_id") == F.col("_near"), "left").where("_near IS NULL")
    salt = F.when(F.col("_id").isNull(), F.col("_salt"))  # null ids spread over the partitions
    turn = F.row_number().over(Window.partitionBy("_id", salt).orderBy("_id"))
    return left.withColumn("_turn", turn).where("_turn = 1 OR _id IS NULL").select("_row.*")
