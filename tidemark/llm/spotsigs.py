"""Document fingerprints by spot signatures (operator 7), with DataFrame functions only.

Common words are anchors.  An anchor and the next ``CHAIN`` content words after it (anchors between them skipped) form
a signature; a text's fingerprint is its set of signatures.  Likeness is Jaccard's, pruned by set sizes:
sets whose sizes differ too much can't be alike, so near duplicates are sought by length class, among texts that share one
of their rarest signatures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import ngram_join
from tidemark.session import cut_lineage

CHAIN = 2
# Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was were with "
    "das dem den der des die ein eine im ist mit nicht und von zu "
    "dans du elle en est et la le les par pour que qui sur un une "
    "al con de del el las los no para por se su una y"
).split()
BLOCK_DOCS = 512
SEGMENTS = 64


def with_signatures(df: DataFrame, text: str, name: str) -> DataFrame:
    """Add the sorted distinct signatures (numbers below 2 ** 32) of a text column; a null text counts as empty.

    A text without a complete chain has one signature, the hash of the whole lower-case text.
    """
    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_w", F.filter(F.split(lowered, r"[^\p{L}\p{N}]+"), lambda x: x != ""))
    df = df.withColumn("_c", F.filter("_w", lambda x: ~x.isin(ANCHORS)))
    # the k-th anchor, at word i, has i - k content words before it
    places = F.filter(F.transform("_w", lambda x, i: F.when(x.isin(ANCHORS), i)), lambda i: i.isNotNull())
    df = df.withColumn("_p", places)
    chains = F.transform("_p", lambda i, k: F.when(i - k + CHAIN <= F.size("_c"), F.xxhash64(F.get("_w", i), *[F.get("_c", i - k + j) for j in range(CHAIN)]).bitwiseAND(0xFFFFFFFF)))
    df = df.withColumn("_s", F.array_sort(F.array_distinct(F.filter(chains, lambda x: x.isNotNull()))))
    whole = F.array(F.xxhash64(lowered).bitwiseAND(0xFFFFFFFF))
    return df.withColumn(name, F.when(F.size("_s") > 0, F.col("_s")).otherwise(whole)).drop("_w", "_c", "_p", "_s")


def as_string(signatures: Column) -> Column:
    """Eight hex digits for each signature, ascending."""
    return F.concat_ws("", F.transform(signatures, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")))


def pruned_jaccard(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard likeness of two sets; 0 without comparing them where their sizes alone rule ``at_least`` out."""
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return F.when(bound < at_least, 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def _blocks(docs: DataFrame) -> Column:
    """A block number that never decreases with doc_id, of about ``BLOCK_DOCS`` documents: linear between quantiles of the ids."""
    cuts = docs.agg(F.percentile_approx("doc_id", [i / SEGMENTS for i in range(SEGMENTS + 1)], 10_000).alias("q"), F.count("doc_id").alias("n")).first()
    if not cuts.n:
        return F.lit(0).cast("long")
    per = max(1, cuts.n // SEGMENTS // BLOCK_DOCS)
    edges = sorted(set(cuts.q))
    block = F.lit(0).cast("long")
    for k, (low, high) in enumerate(zip(edges, [*edges[1:], edges[-1] + 1])):
        inside = F.least(F.floor((F.col("doc_id") - low) / float(high - low) * per), F.lit(per - 1))
        block = F.when(F.col("doc_id") >= low, F.lit(k * per + 1) + inside).otherwise(block)
    return F.coalesce(block, F.lit(0)).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """``(doc_id, text, sigs, next_text, next_sigs)``: every row with the next one by ascending doc_id, the last with the first.

    Texts are shuffled once, by block; the first row of each block is also handed to the block before.  Rows of
    equal ids follow each other by their text; null ids come first.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumn("_b", _blocks(docs))
    first = docs.groupBy("_b").agg(F.min_by(F.struct("doc_id", "text"), F.struct("doc_id", "text")).alias("f")).select("_b", F.col("f.text").alias("_ft"))
    # the block before, in two levels: inside runs of blocks, then across the runs
    first = cut_lineage(first.withColumn("_r", F.floor(F.col("_b") / 4096)))
    runs = first.groupBy("_r").agg(F.max("_b").alias("_last"))
    across = Window.orderBy("_r")
    runs = runs.withColumn("_before", F.lag("_last").over(across))
    end = first.agg(F.max("_b").alias("m")).first().m
    inside = Window.partitionBy("_r").orderBy("_b")
    before = first.withColumn("_p", F.lag("_b").over(inside)).join(runs.select("_r", "_before"), "_r")
    before = with_signatures(before.select(F.coalesce("_p", "_before", F.lit(end)).alias("_b"), "_ft"), "_ft", "_fs")
    here = with_signatures(docs.repartition("_b"), "text", "sigs")
    order = Window.partitionBy("_b").orderBy("doc_id", "text")
    here = here.withColumn("_n", F.lead(F.struct("text", "sigs")).over(order))
    out = here.join(before, "_b", "left")
    return out.select("doc_id", "text", "sigs", F.coalesce("_n.text", "_ft").alias("next_text"), F.coalesce("_n.sigs", "_fs").alias("next_sigs"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``docs(doc_id, text)`` and of its edited text, and their likeness.

    The edited text replaces the last half (rounded down) by as much of the next document's beginning.  A null text is empty;
    two empty texts are alike (1.0).  Equal texts have equal fingerprints.  Repeated rows and null ids are kept.  A single row is its own next; no rows give no rows.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    df = with_next(docs).withColumn("n_chars", n.cast("long"))
    df = df.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    df = with_signatures(df, "edited", "edited_sigs")
    return df.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_string(F.col("sigs")).alias("fingerprint"), as_string(F.col("edited_sigs")).alias("edited_fingerprint"),
        pruned_jaccard(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), pruned_jaccard(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"),
    )


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``(doc_id, n_signatures, group_id)``: documents whose fingerprints are alike by ``percent`` or more, directly or through others.

    Equal fingerprints are one node.  A fingerprint's rarest signatures, as many as any partner must share one of, are its postings; they are
    partitioned by signature and length class, and pairs are compared only as far as sizes, own signatures and parity maps
    leave them a chance (see the n-gram join, whose linking this uses).  ``group_id`` is the smallest doc_id of the group.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = cut_lineage(with_signatures(texts, "text", "sigs").select("doc_id", F.size("sigs").cast("long").alias("n"), F.xxhash64("sigs").alias("node"), "sigs"))
    first = sets.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sigs").alias("sigs"))
    each = first.select("node", "n", F.explode("sigs").alias("s"))
    each = each.join(each.groupBy("s").agg(F.count(F.lit(1)).alias("df")), "s")
    shared, bits = F.col("df") > 1, 64 * ngram_join.MAP_WORDS
    slot = F.pmod(F.xxhash64("s"), F.lit(bits))
    maps = [F.bit_xor(F.when(shared & (F.floor(slot / 64) == k), F.expr("shiftleft(1L, cast(pmod(xxhash64(s), 64) as int))")).otherwise(F.lit(0).cast("long"))) for k in range(ngram_join.MAP_WORDS)]
    grouped = each.groupBy("node", "n").agg(F.count_if(~shared).alias("own"), F.array(*maps).alias("map"), F.sort_array(F.collect_list(F.when(shared, F.struct("df", "s")))).alias("o"))
    need = F.ceil(F.lit(percent) * F.col("n") / 100)
    kept = grouped.where(F.col("n") - F.col("own") >= need).withColumn("shared", F.transform("o", lambda e: e["s"]))
    nodes = cut_lineage(kept.select("node", "n", "own", "map", F.sort_array("shared").alias("shared"), F.slice("shared", 1, (F.col("n") - need + 1 - F.col("own")).cast("int")).alias("prefix")))
    _, labels = ngram_join.links(nodes, percent)
    least = labels.join(first.select("node", "rep"), "node")
    least = least.join(least.groupBy("label").agg(F.min("rep").alias("_min")), "label").select("node", "_min")
    group = first.select("node", "rep").join(least, "node", "left").select("node", F.coalesce("_min", "rep").alias("group_id"))
    return sets.join(group, "node").select("doc_id", F.col("n").alias("n_signatures"), "group_id")
