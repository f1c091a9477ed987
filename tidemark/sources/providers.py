"""Article providers: one registry, one shape, one status row for each.

A provider reads its own format with Spark.  Every provider is read and stored by itself, so one that fails, at planning or while its
files are read, gives its status row and the others stay.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

SHAPE = "id long, title string, url string, source_name string, published timestamp"
MESSAGE = 140  # characters of an error that its status row shows


@dataclass(frozen=True)
class Provider:
    name: str
    label: str
    kind: str
    read: Callable[[SparkSession, str], DataFrame]
    needs: str | None = None  # a setting without which it is not asked


REGISTRY: dict[str, Provider] = {}


def provider(name: str, label: str, kind: str, needs: str | None = None):
    """Register a reader: (session, folder) to a frame with the columns of ``SHAPE``."""

    def add(read):
        REGISTRY[name] = Provider(name, label, kind, read, needs)
        return read

    return add


@provider("json_wire", "JSON lines", "news wire")
def json_wire(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SHAPE).option("mode", "FAILFAST").json(folder)


@provider("csv_table", "CSV with header", "archive")
def csv_table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SHAPE).option("header", True).option("escape", '"').option("multiLine", True).option("mode", "FAILFAST").csv(folder)


@provider("rss", "RSS items", "feed")
def rss(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("xml").schema(SHAPE).option("rowTag", "item").option("mode", "FAILFAST").load(folder)


def _reason(error: Exception) -> str:
    text = " ".join((error.getMessage() if isinstance(error, PySparkException) else str(error) or type(error).__name__).split())
    return text[:MESSAGE]


def fetch(spark: SparkSession, asked: Sequence[tuple[str, str, str]], settings: Collection[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(articles, status) of ``asked`` (name, registered provider, folder).

    Articles have the columns of ``SHAPE`` and ``provider``.  The status has a row for each that was asked: provider, label, kind, n, status (ok, empty, error,
    not configured) and, for the last two, why.
    """
    frames, rows = [], []
    for name, kind, folder in asked:
        p, why, status = REGISTRY.get(kind), None, "ok"
        if p is None:
            rows.append((name, None, None, "error", f"no provider {kind}"))
            continue
        if p.needs and p.needs not in settings:
            status, why = "not configured", f"needs {p.needs}"
        else:
            try:
                columns = [c.split()[0] for c in SHAPE.split(", ")]
                frames.append(cut_lineage(p.read(spark, folder).select(*columns)).withColumn("provider", F.lit(name)))
            except Exception as e:  # noqa: BLE001 - whatever a provider's read raises is its status
                status, why = "error", _reason(e)
        rows.append((name, p.label, p.kind, status, why))
    articles = spark.createDataFrame([], SHAPE + ", provider string")
    for f in frames:
        articles = articles.unionByName(f)
    counted = articles.groupBy("provider").agg(F.count(F.lit(1)).alias("n"))
    status = spark.createDataFrame(rows, "provider string, label string, kind string, status string, why string").join(counted, "provider", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return articles, status.withColumn("status", F.when((F.col("status") == "ok") & (F.col("n") == 0), "empty").otherwise(F.col("status"))).select("provider", "label", "kind", "n", "status", "why")
