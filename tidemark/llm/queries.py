"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import html_text, lexical, licences, ngram_join, packing, prefix_trie, quality_mil, quality_rules, sharding, simple8b, spotsigs, toxicity, viterbi
from tidemark.session import with_code

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = with_code(fn)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_html_extraction")
def op1_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op2_ngram_jaccard")
def op2_ngram_jaccard(spark, sf_dir):
    return ngram_join.components(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3_toxicity(spark, sf_dir):
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_quality_classifier")
def op4_quality_classifier(spark, sf_dir):
    return quality_mil.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_packing")
def op5_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


@query("op6_license_scan", licences.SQL)
def op6_license_scan(spark, sf_dir):
    return licences.scan(table(spark, sf_dir, "documents"))


@query("op7_fingerprints")
def op7_fingerprints(spark, sf_dir):
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


@query("op8_sentencepiece")
def op8_sentencepiece(spark, sf_dir):
    """Every whole text encoded and decoded again."""
    return viterbi.round_trip(table(spark, sf_dir, "documents"))


@query("op9_sharding")
def op9_sharding(spark, sf_dir):
    """Sixteen shards of near equal bytes."""
    out = sharding.kd_shards(table(spark, sf_dir, "documents"), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_quality_rules")
def op10_quality_rules(spark, sf_dir):
    return quality_rules.clean_lines(table(spark, sf_dir, "documents"), cleaned=False)


@query("op11_prefix_trie", prefix_trie.SQL)
def op11_prefix_trie(spark, sf_dir):
    """Nodes of the trie of all rebuilt conversations."""
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


@query("op12_lexical_search", lexical.SQL)
def op12_lexical_search(spark, sf_dir):
    """The 20 best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op13_token_files")
def op13_token_files(spark, sf_dir):
    """Ids of every whole text, from the files they were written to."""
    return simple8b.round_trip(table(spark, sf_dir, "documents"))
