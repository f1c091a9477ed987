"""Bounded samples of labelled documents, and row-wise scoring, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.wordbuf import pieces


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's text, modulo; a null id gives null."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, max_rows: int) -> DataFrame:
    """``(text, y)`` of at most ``max_rows`` labelled documents in one partition, in the order of a hash of the id.

    ``held_out`` is over ``doc_id``; such rows, and rows with a null id or label, are never read.  Only ids are ranked; their texts
    are fetched by a join with at most ``max_rows`` ids.
    """
    seed = F.xxhash64("_id")
    ids = (
        labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("y")).where(F.col("_id").isNotNull() & F.col("y").isNotNull())
        .withColumn("doc_id", F.col("_id")).where(~held_out).select("_id", "y", seed.alias("_seed")).orderBy("_seed", "_id", "y").limit(max_rows)
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    # at most max_rows rows of 20 bytes are broadcast
    return texts.join(F.broadcast(ids), "_id").select("text", "y", "_seed", "_id").repartition(1).sortWithinPartitions("_seed", "_id").select("text", "y")


def train(rows: DataFrame, learn: Callable[[Iterator[tuple[pa.Array, np.ndarray]]], bytes]) -> bytes:
    """Run ``learn`` over the one partition of (texts, labels) pieces; its model, of bounded size, comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for b in batches:
                y = b.column("y").to_numpy(zero_copy_only=False)
                for first, column in pieces(b.column("text")):
                    yield column, y[first : first + len(column)]

        yield pa.RecordBatch.from_arrays([pa.array([learn(stream())], pa.binary())], ["model"])

    row = rows.mapInArrow(run, "model binary").first()
    return bytes(row.model) if row else learn(iter(()))


def score_rows(docs: DataFrame, score: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """``(doc_id, score)`` for every row, in batches of a few megabytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, column in pieces(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(first, len(column)), pa.array(score(column).astype(np.float64))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def filter_rows(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score passes ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = [keep(score(column)) for _, column in pieces(b.column(b.schema.get_field_index("text")))]
            yield b.filter(pa.array(np.concatenate(mask)) if mask else pa.array([], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
