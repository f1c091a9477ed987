"""Similar token sets near in time as a blocked sparse product.

Sets are dealt into blocks of one stretch of time and of bounded size; every two blocks of the same or of neighbouring stretches make one
cell.  A cell holds its two blocks packed and looks for pairs inside: the lighter set offers its heaviest tokens, the other all its own, and the weight
summed over the tokens two sets meet in must reach what the tokens not offered leave open.  What does is checked on all tokens where it
is, so only results leave a cell: no table of candidates is shuffled, and texts move once for each cell of their block.
"""

from __future__ import annotations

from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, release

BLOCK_TOKENS = 1 << 21  # tokens of the sets in a block
STEP = 1 << 21  # meetings looked at together
MOST_TASKS = 4096
MORE, MORE_IDF = 0.8, 4.0  # tokens offered beyond the necessary ones: down to this part of the threshold, and only above this weight


def blocks(items: DataFrame, seconds: int, sets: DataFrame | None = None) -> DataFrame:
    """One row for each part of a stretch of time, with the numbers of parts before, in and after it.

    ``items(node, k, id, t0, t1, n)``: what has the n tokens of set (node, k) from t0 to t1; ``sets(node, k, tw, total, fresh)``, or without it each item is a
    set and has these columns itself.  Sets that are not ``fresh`` are only compared with those that are.  An item stands in every stretch it touches, always in the same part.
    """
    span = lambda c: F.floor(F.col(c) / seconds)
    x = items.withColumn("bucket", F.explode(F.sequence(span("t0"), span("t1"))))
    parts = x.groupBy("bucket").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).alias("parts"))
    beside = parts.select("parts", F.explode(F.array(*[F.struct((F.col("bucket") + d).alias("bucket"), F.lit(d).alias("d")) for d in (-1, 0, 1)])).alias("e")).select("e.*", "parts")
    count = lambda d, name: F.coalesce(F.max(F.when(F.col("d") == d, F.col("parts"))), F.lit(0)).alias(name)
    beside = cut_lineage(beside.groupBy("bucket").agg(count(1, "before"), count(0, "own"), count(-1, "after")).filter("own > 0"))
    place = ["bucket", "part", "before", "own", "after"]
    x = x.join(beside, "bucket").withColumn("part", F.pmod(F.xxhash64("id"), "own"))
    item = F.struct("id", "t0", "t1")
    if sets is None:
        x = x.select(*place, "k", "tw", "total", "fresh", F.array(item).alias("items"))
    else:
        x = x.groupBy(*place, "node", "k").agg(F.collect_set(item).alias("items")).hint("merge").join(sets.select("node", "k", "tw", "total", "fresh"), ["node", "k"]).drop("node")
    out = cut_lineage(x.groupBy(*place).applyInArrow(_pack, "bucket long, part long, before long, own long, after long, sets binary, words binary"))
    release(beside)
    return out


def cells(packed: DataFrame) -> DataFrame:
    """Every block once for each cell it is in."""
    at = lambda b, i, c, j: F.struct(b.alias("b"), i.alias("i"), c.alias("c"), j.alias("j"))
    b, p = F.col("bucket"), F.col("part")
    each = lambda n, f: F.transform(F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<bigint>")), f)
    every = F.concat(each("before", lambda j: at(b - 1, j, b, p)), each("own", lambda j: at(b, F.least(p, j), b, F.greatest(p, j))), each("after", lambda j: at(b, p, b + 1, j)))
    tasks = packed.agg(F.coalesce(F.ceil(F.sum((F.col("own") + 1) / 2 + F.col("after"))), F.lit(1))).first()[0]
    return packed.select("bucket", "part", "sets", "words", F.explode(every).alias("cell")).repartition(max(1, min(int(tasks), MOST_TASKS)), "cell")


def pairs(packed: DataFrame, kind: str, seconds: int, threshold: float, min_shared: int, rare: float | None, linked: bool) -> DataFrame:
    """(a, b, shared, similarity) of items; ``linked``: of every cell only the pairs that connect what is similar, without figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cell(batches, schema, seconds, threshold, min_shared, rare, linked)

    schema = ["a", "b"] if linked else ["a", "b", "shared", "similarity"]
    types = f"a {kind}, b {kind}" + ("" if linked else ", shared int, similarity double")
    return cells(packed).groupBy("cell").applyInArrow(run, types)


# --- inside a task ---------------------------------------------------------------------------------------

def _wire(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _whole(table: pa.Table, name: str) -> pa.Array:
    column = table[name].combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def _pack(table: pa.Table) -> pa.Table:
    """A block: its sets as numbers of words, heaviest first, and its words with their weights."""
    tw = _whole(table, "tw")
    word, weight = tw.flatten().field("token").dictionary_encode(), -tw.flatten().field("neg").to_numpy(zero_copy_only=False)
    codes = word.indices.to_numpy(zero_copy_only=False)
    weights = np.zeros(len(word.dictionary))
    weights[codes] = weight
    offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(tw).to_numpy(zero_copy_only=False))])
    sets = pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(codes, pa.int32())), _whole(table, "items"), *(_whole(table, c) for c in ("total", "k", "fresh"))], names=["codes", "items", "total", "k", "fresh"])
    words = pa.RecordBatch.from_arrays([word.dictionary, pa.array(weights)], names=["word", "weight"])
    place = {c: [table[c][0].as_py()] for c in ("bucket", "part", "before", "own", "after")}
    return pa.table({**place, "sets": pa.array([_wire(sets)], pa.binary()), "words": pa.array([_wire(words)], pa.binary())})


def _unpack(row: dict, words: pa.Array | None = None) -> SimpleNamespace:
    """A block in arrays; its tokens by their numbers in ``words`` (-1: not there), its own words by default."""
    sets, own = (pa.ipc.open_stream(row[c]).read_next_batch() for c in ("sets", "words"))
    codes, items, word, weight = sets["codes"], sets["items"], own["word"], own["weight"].to_numpy()
    code = codes.flatten().to_numpy()
    x = SimpleNamespace(n=len(sets), bucket=row["bucket"], words=word, weight=weight[code], total=sets["total"].to_numpy(), k=sets["k"].to_numpy(), fresh=sets["fresh"].to_numpy(zero_copy_only=False))
    x.code = code.astype(np.int64) if words is None else pc.fill_null(pc.index_in(word, value_set=words), -1).to_numpy().astype(np.int64)[code]
    x.size, x.items = (pc.list_value_length(c).to_numpy().astype(np.int64) for c in (codes, items))
    x.end, x.items_end = np.cumsum(x.size), np.cumsum(x.items)
    x.row = np.repeat(np.arange(x.n), x.size)
    x.id, x.t0, x.t1 = items.flatten().field("id"), items.flatten().field("t0").to_numpy(), items.flatten().field("t1").to_numpy()
    x.lo, x.hi = np.minimum.reduceat(x.t0, x.items_end - x.items), np.maximum.reduceat(x.t1, x.items_end - x.items)
    return x


def _runs(counts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Slices with ``STEP`` counts in all, or with one row that has more."""
    total, a = np.cumsum(counts), 0
    while a < len(counts):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + STEP, "right")))
        yield a, b
        a = b


def _each(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every count so many rows: whose they are, and their number within it."""
    whose = np.repeat(np.arange(len(counts)), counts)
    return whose, np.arange(len(whose)) - np.repeat(np.cumsum(counts) - counts, counts)


def _similar(x: SimpleNamespace, y: SimpleNamespace, rank_x: np.ndarray, rank_y: np.ndarray, seconds: int, threshold: float, min_shared: int, rare: float | None, known=None) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, shared, similarity) of sets i of ``x`` and j of ``y`` whose rank is higher; pairs that ``known`` tells to be connected are left out."""
    least = threshold * x.total - 1e-9
    run = np.cumsum(x.weight)
    before = run - x.weight - np.repeat((run - x.weight)[x.end - x.size], x.size)
    left = x.total[x.row] - before  # the weight of this token and all lighter ones
    head = (left >= least[x.row] - 1e-6) | ((left >= MORE * least[x.row]) & (x.weight >= MORE_IDF)) | (before == 0)
    offered = np.bincount(x.row, head, x.n).astype(np.int64)
    need = least - (x.total - np.bincount(x.row, x.weight * head, x.n))
    top, real = int(max(rank_x.max(), rank_y.max())) + 2, y.code >= 0
    held, owner = y.code[real] * top + rank_y[y.row[real]], y.row[real]
    order = np.argsort(held)
    held, owner = held[order], owner[order]
    own = np.sort(owner * (1 << 32) + y.code[real][order])
    at = np.flatnonzero(head & (x.code >= 0))
    first = np.searchsorted(held, x.code[at] * top + rank_x[x.row[at]], "right")
    meets = np.searchsorted(held, (x.code[at] + 1) * top) - first
    rows = np.bincount(x.row[at], meets, x.n).astype(np.int64)
    starts = np.searchsorted(x.row[at], np.arange(x.n + 1))
    for a, b in _runs(rows):
        e = slice(starts[a], starts[b])
        whose, nth = _each(meets[e])
        i, j = x.row[at[e]][whose], owner[first[e][whose] + nth]
        near = (y.lo[j] <= x.hi[i] + seconds) & (x.lo[i] <= y.hi[j] + seconds) & (x.fresh[i] | y.fresh[j])
        key, weight = (i * y.n + j)[near], x.weight[at[e]][whose][near]
        if not len(key):
            continue
        order = np.argsort(key)
        key, weight = key[order], weight[order]
        new = np.flatnonzero(np.diff(key, prepend=-1))
        met, i, j = np.add.reduceat(weight, new), key[new] // y.n, key[new] % y.n
        shared = np.diff(new, append=len(key))
        seldom = np.add.reduceat((weight >= rare).astype(np.int64), new) if rare is not None else shared
        good = met >= need[i] - 1e-9
        if known is not None:
            good &= ~known(i, j)
        i, j, met, shared, seldom = i[good], j[good], met[good], shared[good], seldom[good]
        rest = x.size[i] - offered[i]
        for c, d in _runs(rest):  # the tokens that were not offered
            whose, nth = _each(rest[c:d])
            token = (x.end[i[c:d]] - rest[c:d])[whose] + nth
            want = j[c:d][whose] * (1 << 32) + x.code[token]
            found = np.searchsorted(own, want)
            hit = (x.code[token] >= 0) & (own[np.minimum(found, len(own) - 1)] == want)
            more = lambda w: np.bincount(whose[hit], w, d - c)  # noqa: B023, E731
            both = shared[c:d] + more(None)
            similarity = (met[c:d] + more(x.weight[token[hit]])) / x.total[i[c:d]]
            ok = (similarity >= threshold - 1e-12) & (both >= min_shared)
            if rare is not None:
                ok &= seldom[c:d] + more((x.weight[token[hit]] >= rare).astype(float)) >= 2
            yield i[c:d][ok], j[c:d][ok], both[ok], similarity[ok]


def _join(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels (the smallest number of a group) after these pairs are connected."""
    while True:
        a, b = labels[i], labels[j]
        apart = a != b
        if not apart.any():
            return labels
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels != labels[labels]).any():
            labels = labels[labels]


def _cell(batches: Iterator[pa.RecordBatch], names: list[str], seconds: int, threshold: float, min_shared: int, rare: float | None, linked: bool) -> Iterator[pa.RecordBatch]:
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["bucket"], r["part"]))
    where = rows[0]["cell"]
    alone = (where["b"], where["i"]) == (where["c"], where["j"])
    if not alone and len(rows) < 2:
        return  # the other part is empty
    x = _unpack(rows[0])
    y = x if alone else _unpack(rows[1], x.words)
    del rows
    if not (x.fresh.any() or y.fresh.any()):
        return
    total, k = np.concatenate([x.total, y.total]), np.concatenate([x.k, y.k])
    order = np.lexsort((k, total))
    if alone:
        order = order[order < x.n]
        rank = np.empty(x.n, np.int64)
        rank[order] = np.arange(x.n)
        turns = [(x, x, rank, rank, 0, 0)]
    else:
        step = np.concatenate([[0], (np.diff(total[order]) != 0) | (np.diff(k[order]) != 0)])
        rank = np.empty(x.n + y.n, np.int64)
        rank[order] = 2 * np.cumsum(step)
        turns = [(x, y, rank[: x.n], rank[x.n :] + 1, 0, x.n), (y, x, rank[x.n :] + 1, rank[: x.n], x.n, 0)]  # one set in both blocks: the first holds the lighter one
    labels = np.arange(x.n if alone else x.n + y.n)
    for p, q, rp, rq, op, oq in turns:
        known = (lambda i, j: labels[i + op] == labels[j + oq]) if linked else None  # noqa: B023
        for i, j, shared, similarity in _similar(p, q, rp, rq, seconds, threshold, min_shared, rare, known):
            if linked:
                labels = _join(labels, i + op, j + oq)
            else:
                yield from _items(p, q, i, j, shared, similarity, seconds, names)
    if linked:
        own = np.flatnonzero(labels != np.arange(len(labels)))
        ids = x.id if alone else pa.concat_arrays([x.id, y.id])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(labels[own])), ids.take(pa.array(own))], names=names)
    elif alone:
        same = np.flatnonzero(x.items > 1)
        yield from _items(x, x, same, same, x.size[same], np.ones(len(same)), seconds, names)


def _items(x: SimpleNamespace, y: SimpleNamespace, i: np.ndarray, j: np.ndarray, shared: np.ndarray, similarity: np.ndarray, seconds: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """What has sets i of ``x`` with what has sets j of ``y``, as far as both lie near; of one set each pair once.  Pairs in several cells come from the first."""
    for a, b in _runs(x.items[i]):
        whose, nth = _each(x.items[i[a:b]])
        u, pair = x.items_end[i[a:b]][whose] - x.items[i[a:b]][whose] + nth, a + whose
        twin = (i[pair] == j[pair]) & (x is y)
        after = np.where(twin, nth + 1, 0)
        counts = y.items[j[pair]] - after
        for c, d in _runs(counts):
            whose, nth = _each(counts[c:d])
            p, at = u[c:d][whose], pair[c:d][whose]
            q = y.items_end[j[at]] - y.items[j[at]] + after[c:d][whose] + nth
            near = (y.t0[q] <= x.t1[p] + seconds) & (x.t0[p] <= y.t1[q] + seconds)
            p0, p1, q0, q1 = (t // seconds for t in (x.t0[p], x.t1[p], y.t0[q], y.t1[q]))
            near &= np.where(p0 <= q0, (np.minimum(p1, q0) == x.bucket) & (q0 == y.bucket), (p0 == x.bucket) & (np.minimum(q1, p0) == y.bucket))
            p, q, at = p[near], q[near], at[near]
            yield pa.RecordBatch.from_arrays([x.id.take(pa.array(p)), y.id.take(pa.array(q)), pa.array(shared[at], pa.int32()), pa.array(similarity[at])], names=names)
