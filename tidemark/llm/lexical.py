"""Ranked lexical search for many items at once (operator 12).

Items are taken in blocks of bounded size.  Term sets that items of a block share are mined into a query-sharing DAG: a node is
a set of weighted terms and smaller nodes, and each item is a node, too.  Documents go by in bounded runs; for each run every node's partial
score is computed once, as one array over the run's documents, from the nodes below it, so what several items share is summed a single
time.  Only the best rows of each item leave a task.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.wordbuf import Texts, pieces
from tidemark.session import cut_lineage, release

TOP = 20
BLOCK_ITEMS = 512
BLOCK_TERMS = 1 << 16
#: Cells (documents x rows of the DAG) of a run.
RUN_CELLS = 1 << 22

# The bytes of a term, and the constants of its score.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_NO_TERM = np.array([bool(re.fullmatch(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", bytes([b]))) for b in range(256)])
_LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text: str | None) -> list[str]:
    return re.findall(TERM, (text or "").translate(_LOWER))


class TermTexts(Texts):
    """Texts whose words are terms."""

    @cached_property
    def separators(self) -> np.ndarray:
        return _NO_TERM[self.data]


class Vocabulary:
    """Numbers of the terms of a block of items; looked up by hash, then held to the bytes."""

    def __init__(self, words: list[str]):
        raw = [w.encode() for w in words]
        t = TermTexts.of(pa.array([w.decode() for w in raw], pa.large_string()))
        order = np.argsort(t.words, kind="stable")
        self.hashes, self.number = t.words[order], order.astype(np.int32)
        self.data, self.start = t.data, t.spans[0]
        self.length = t.spans[1] - t.spans[0]

    def find(self, t: TermTexts) -> tuple[np.ndarray, np.ndarray]:
        """(which terms of the texts are known, their numbers)."""
        if not len(self.hashes) or not len(t.words):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        start, end = t.spans
        at = np.minimum(np.searchsorted(self.hashes, t.words), len(self.hashes) - 1)
        hit = np.flatnonzero((self.hashes[at] == t.words) & (self.length[self.number[at]] == end - start))
        number = self.number[at[hit]]
        same, first, length = np.ones(len(hit), bool), start[hit], self.length[number]
        for j in range(int(length.max()) if len(hit) else 0):
            rows = np.flatnonzero(length > j) if j else slice(None)
            same[rows] &= t.data[first[rows] + j] == self.data[self.start[number[rows]] + j]
        return hit[same], number[same]


@dataclass
class Dag:
    """Rows 0 .. len(weights) - 1 are (term, times); later rows sum earlier ones; ``items`` names the row of each item.

    ``edges[i]`` lists what row ``len(atoms) + i`` sums.  A row of no parts is zero.
    """

    atoms: list[tuple[int, int]] = field(default_factory=list)
    edges: list[list[int]] = field(default_factory=list)
    items: list[int] = field(default_factory=list)

    @property
    def additions(self) -> int:
        return sum(max(len(e) - 1, 0) for e in self.edges)

    def sums(self, scores: np.ndarray) -> np.ndarray:
        """Scores (terms x documents) to scores (items x documents)."""
        rows: list[np.ndarray] = [scores[t] * k if k > 1 else scores[t] for t, k in self.atoms]
        zero = np.zeros(scores.shape[1], np.int64)
        for parts in self.edges:
            rows.append(rows[parts[0]] if len(parts) == 1 else sum((rows[p] for p in parts[1:]), rows[parts[0]]) if parts else zero)
        return np.stack([rows[r] for r in self.items]) if self.items else np.zeros((0, scores.shape[1]), np.int64)


def share(items: list[dict[int, int]]) -> Dag:
    """The DAG of items given as {term: times}.

    Terms that occur in the very same items become one node first.  Then, again and again, the two rows (items or nodes) with the largest
    common part become sums over a new node of that part, in every row that holds it whole, until no two rows share two parts.
    """
    atoms = sorted({(t, k) for item in items for t, k in item.items()})
    number = {a: i for i, a in enumerate(atoms)}
    holds = np.zeros((len(items), len(atoms)), bool)
    for r, item in enumerate(items):
        holds[r, [number[a] for a in item.items()]] = True
    groups: dict[bytes, list[int]] = {}
    for a in range(len(atoms)):
        groups.setdefault(np.packbits(holds[:, a]).tobytes(), []).append(a)
    parts: list[set[int]] = [set() for _ in items]
    nodes: dict[int, list[int]] = {}
    for group in groups.values():
        name = group[0] if len(group) == 1 else len(atoms) + len(nodes)
        if len(group) > 1:
            nodes[name] = group
        for r in np.flatnonzero(holds[:, group[0]]):
            parts[r].add(name)
    rows = {("item", r): p for r, p in enumerate(parts)}
    heap: list = []

    def compare(key, others):
        for other in others:
            if other != key and (n := len(rows[key] & rows[other])) > 1:
                heapq.heappush(heap, (-n, key, other))

    for i, key in enumerate(keys := list(rows)):
        compare(key, keys[:i])
    while heap:
        n, a, b = heapq.heappop(heap)
        new = rows[a] & rows[b]
        if len(new) < -n:  # common parts only shrink; look again when it is this pair's turn
            if len(new) > 1:
                heapq.heappush(heap, (-len(new), a, b))
            continue
        same = [key for key in (a, b) if key[0] == "node" and rows[key] == new]  # one of the two is the common part itself
        node = same[0] if same else ("node", len(atoms) + len(nodes))
        for key in [key for key, p in rows.items() if key != node and new <= p]:
            rows[key] = rows[key] - new | {node[1]}
        if not same:
            nodes[node[1]], rows[node] = [], new
            compare(node, list(rows))
    for key, p in rows.items():
        if key[0] == "node":
            nodes[key[1]] = sorted(p)
    return _ordered(atoms, nodes, [sorted(rows["item", r]) for r in range(len(items))])


def _ordered(atoms: list, nodes: dict[int, list[int]], items: list[list[int]]) -> Dag:
    """Rows in an order in which a row's parts come before it."""
    place, edges = {i: i for i in range(len(atoms))}, []
    todo = [(n, False) for n in nodes]
    while todo:
        n, ready = todo.pop()
        if n in place:
            continue
        if ready:
            place[n] = len(atoms) + len(edges)
            edges.append([place[p] for p in nodes[n]])
        else:
            todo.append((n, True))
            todo += [(p, False) for p in nodes[n] if p not in place]
    dag = Dag([(int(t), int(k)) for t, k in atoms], edges)
    for parts in items:
        dag.items.append(len(atoms) + len(edges))
        edges.append([place[p] for p in parts])
    return dag


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, dict[str, int]]]]:
    """Items as (item_id, {term: times}), in blocks of at most BLOCK_ITEMS items and, unless one item alone has more, BLOCK_TERMS terms."""
    block, seen = [], set()
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        counts: dict[str, int] = {}
        for t in terms(r.text):
            counts[t] = counts.get(t, 0) + 1
        if block and (len(block) >= BLOCK_ITEMS or len(seen | counts.keys()) > BLOCK_TERMS):
            yield block
            block, seen = [], set()
        block.append((r.item_id, counts))
        seen |= counts.keys()
    if block:
        yield block


_POSTINGS = "doc_ids binary, sizes binary, ends binary, numbers binary, counts binary, n_docs long, n_terms long, df_numbers array<int>, df array<long>"


def _postings(words: list[str]):
    """Runs of documents: per document its size and (term, occurrences) of the block's terms; per run the documents that hold each term."""
    names = [c.split()[0] for c in _POSTINGS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, width = Vocabulary(words), max(len(words), 1)
        for batch in batches:
            ids = batch.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False)  # a null id comes last among ties
            for at, column in pieces(batch.column("text")):
                t = TermTexts.of(column, lower=True)
                hit, number = vocabulary.find(t)
                pair, count = np.unique(t.word_text[hit].astype(np.int64) * width + number, return_counts=True)
                doc, number = pair // width, (pair % width).astype(np.int32)
                held, df = np.unique(number, return_counts=True)
                docs, place = np.unique(doc, return_inverse=True)  # a document without any of the terms has score 0 everywhere
                ends = np.cumsum(np.bincount(place, minlength=len(docs))) if len(docs) else np.zeros(0, np.int64)
                sizes = t.n_words
                row = [ids[at : at + t.n][docs].astype("<i8").tobytes(), sizes[docs].astype("<i8").tobytes(), ends.astype("<i8").tobytes(), number.astype("<i4").tobytes(), count.astype("<u4").tobytes(),
                       int((sizes > 0).sum()), int(sizes.sum()), held.tolist(), df.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, [pa.binary()] * 5 + [pa.int64()] * 2 + [pa.list_(pa.int32()), pa.list_(pa.int64())])], names)

    return run


def _best(dag: Dag, weights: list[int], n_docs: int, n_terms: int, top: int):
    """The best documents of every item among the runs of a task, as (item, doc_id, score)."""
    weight = np.array(weights, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = len(dag.items)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(items)]
        floor = np.ones(items, np.int64)  # what a row needs to be among the best
        step = max(1, RUN_CELLS // max(len(dag.atoms) + len(dag.edges), 1))
        for batch in batches:
            for row in batch.to_pylist():
                doc, size, ends = (np.frombuffer(row[c], "<i8") for c in ("doc_ids", "sizes", "ends"))
                number, tf = np.frombuffer(row["numbers"], "<i4"), np.frombuffer(row["counts"], "<u4").astype(np.int64)
                for a in range(0, len(doc), step):
                    b = min(a + step, len(doc))
                    lo, hi = (int(ends[a - 1]) if a else 0), int(ends[b - 1])
                    place = np.repeat(np.arange(b - a), np.diff(ends[a:b], prepend=lo))
                    m = 100 - 25 + (25 * size[a:b] * n_docs) // n_terms
                    n, k = number[lo:hi], tf[lo:hi]
                    scores = np.zeros((len(weight), b - a), np.int64)
                    scores[n, place] = weight[n] * ((1_000_000_000 * k) // (1000 * k + 12 * m[place]))
                    total = dag.sums(scores)
                    for i in np.flatnonzero((total >= floor[:, None]).any(axis=1)):
                        new = np.flatnonzero(total[i] >= floor[i])
                        d, s = np.concatenate([best[i][0], doc[a:b][new]]), np.concatenate([best[i][1], total[i][new]])
                        keep = np.lexsort((d, -s))[:top]
                        best[i] = d[keep], s[keep]
                        if len(keep) == top:
                            floor[i] = max(int(s[keep[-1]]), 1)
        rows = [len(d) for d, _ in best]
        if sum(rows):
            doc = np.concatenate([d for d, _ in best])
            columns = [pa.array(np.repeat(np.arange(items), rows)), pa.array(doc, mask=doc == np.iinfo(np.int64).max), pa.array(np.concatenate([s for _, s in best])), pa.array(np.full(sum(rows), TaskContext.get().partitionId() % 64))]
            yield pa.RecordBatch.from_arrays(columns, ["item", "doc_id", "score", "part"])

    return run


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """For each row of ``items(item_id, text)`` the ``top`` documents of ``docs(doc_id, text)``: item_id, rank, doc_id, score.

    Terms, weights and scores are in integers as described in ``SQL``.  Documents with score 0 are left out; equal scores
    rank by ascending doc_id, a null doc_id last.  Every row is a document and an item of its own, also where ids repeat or are null;
    null and empty texts have no terms: such an item has no rows, such a document is in none.  No documents or no items give no
    rows.  Other columns are not read.  Texts are read once for each block of items, and the matches kept are one (term, count) for
    each document and term of the block.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in item_blocks(items):
        words = sorted({t for _, counts in block for t in counts})
        number = {w: i for i, w in enumerate(words)}
        runs = cut_lineage(texts.mapInArrow(_postings(words), _POSTINGS))
        total = runs.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        n_docs, n_terms = total[0] or 0, total[1] or 0
        df = {r.number: r.n for r in runs.select(F.explode(F.arrays_zip("df_numbers", "df")).alias("x")).groupBy(F.col("x.df_numbers").alias("number")).agg(F.sum("x.df").alias("n")).collect()}  # at most the block's terms
        weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for i in range(len(words))]
        dag = share([{number[t]: k for t, k in counts.items()} for _, counts in block])
        found = runs.select("doc_ids", "sizes", "ends", "numbers", "counts").mapInArrow(_best(dag, weights, n_docs, max(n_terms, 1), top), "item long, doc_id long, score long, part long")
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= top)
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= top)
        ids = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item long, item_id long")
        rows = cut_lineage(found.join(ids, "item").select("item_id", "rank", "doc_id", "score"))
        release(runs)
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


SQL = r"""
with words as (
  select doc_id, doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select doc_id, text, row_number() over () as doc from documents)),
wanted as (
  select item_id, item, term, count(*) as k from (
    select item_id, item, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select item_id, text, row_number() over () as item from benchmark))
  group by all),
sizes as (select doc, doc_id, count(*) as n from words group by all),
totals as (select count(*)::bigint as docs, sum(n)::bigint as occurrences from sizes),
tf as (select doc, term, count(*) as tf from words where term in (select term from wanted) group by all),
weights as (select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from tf, totals group by term),
parts as (
  select tf.doc, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // occurrences))) as part
  from tf join sizes using (doc) join weights using (term), totals),
scores as (select item, item_id, doc, sum(k * part)::bigint as score from parts join wanted using (term) group by all having sum(k * part) > 0)
select item_id, rank::int as rank, doc_id, score from (
  select item_id, item, doc_id, score, row_number() over (partition by item order by score desc, doc_id) as rank from scores join sizes using (doc))
where rank <= 20
"""
