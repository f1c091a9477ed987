"""One series per root from contract series, an unlabelled continuous series and an independent sample.

Per trading day: candles of the continuous series are identified by equal closes with a contract's, the contract in use follows the
volume and never goes back, its missing candles come only from a source that shows the same contract that day, and candles
on which compatible sources differ are marked.  Everything is a join by candle or by day; only the choice of the contract walks the days of
a root, in one fold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import intraday_quality as Q

OHLCV = [*Q.OHLC, "volume"]
UNLABELLED = -1  # rank of the part of the continuous series that is no listed contract
SAMPLE_MINIMUM = 20  # fixed value: candles in common before a sample is judged
CONTINUOUS, SAMPLE = "continuous", "sample"


@dataclass
class Composite:
    """``candles`` with contract, source and disagreement; ``days`` with what each day uses; ``rolls`` between contracts."""

    candles: DataFrame
    days: DataFrame

    @property
    def rolls(self) -> DataFrame:
        w = Window.partitionBy("root").orderBy("day")  # days of a root: bounded by the calendar
        x = self.days.withColumns({"from_rank": F.lag("rank").over(w), "from_contract": F.lag("contract").over(w)})
        return x.filter(F.col("rank") != F.col("from_rank")).select("root", "day", "from_contract", "contract", "volume", "from_volume")

    @property
    def segments(self) -> DataFrame:
        """Contiguous stretches of days with one contract and main source."""
        d = self.days.select(F.col("root").alias("symbol"), "day", "contract", "source", "bars", "filled", F.col("verified").cast("long").alias("verified"))
        return Q.segments(d).withColumnRenamed("symbol", "root")


def same_close(a: str, b: str) -> Column:
    return F.abs(F.col(a) - F.col(b)) < 1e-6


def identify(continuous: DataFrame, contracts: DataFrame) -> DataFrame:
    """The continuous candles with ``ranks`` of the contracts they equal (null: none) and ``noise`` for the others of a day that is otherwise identified."""
    k = contracts.select("root", "ts", F.col("close").alias("k_close"), F.col("rank").alias("k_rank"))
    labels = continuous.select("root", "ts", "close").join(k, ["root", "ts"]).filter(same_close("close", "k_close")).groupBy("root", "ts").agg(F.collect_set("k_rank").alias("ranks"))  # a handful of contracts
    c = continuous.join(labels, ["root", "ts"], "left")
    day = c.groupBy("root", "day").agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("ranks").isNull()).alias("_un"))
    noisy = (F.col("_un") < F.lit(1 - Q.IDENTITY_SHARE) * F.col("_n")) & (F.col("_un") < F.col("_n"))
    return c.join(day.select("root", "day", noisy.alias("_noisy")), ["root", "day"]).withColumn("noise", F.col("ranks").isNull() & F.col("_noisy")).drop("_noisy")


def assemble(continuous: DataFrame, contracts: DataFrame, sample: DataFrame, close_tol: float = Q.CLOSE_TOLERANCE, extreme_tol: float = Q.EXTREME_TOLERANCE, minimum: int = SAMPLE_MINIMUM) -> Composite:
    """``continuous`` and ``sample`` (root, ts, day, open, high, low, close, volume), ``contracts`` also contract and rank (later expiry, higher rank)."""
    c = identify(continuous, contracts)
    unlabelled = c.filter(F.col("ranks").isNull() & ~F.col("noise"))
    zero = F.coalesce("volume", F.lit(0.0))
    volumes = contracts.groupBy("root", "day", F.col("rank").cast("long").alias("rank")).agg(F.sum(zero).alias("volume")).unionByName(
        unlabelled.groupBy("root", "day").agg(F.sum(zero).alias("volume")).withColumn("rank", F.lit(UNLABELLED).cast("long")))
    use = Q.volume_roll(volumes)

    own = contracts.withColumn("rank", F.col("rank").cast("long")).join(use, ["root", "day", "rank"]).select("root", "ts", "day", "rank", "contract", F.concat(F.lit("contract:"), "contract").alias("source"), *OHLCV)
    rest = unlabelled.join(use.filter(F.col("rank") == UNLABELLED), ["root", "day"]).select("root", "ts", "day", "rank", F.lit(None).cast("string").alias("contract"), F.lit(CONTINUOUS).alias("source"), *OHLCV)
    chosen = own.unionByName(rest)

    other = lambda df, p: df.select("root", "ts", "day", *[F.col(x).alias(f"{p}{x}") for x in OHLCV])
    x = chosen.join(other(sample, "s_"), ["root", "ts", "day"], "full").join(other(c.filter("noise"), "n_"), ["root", "ts", "day"], "left")
    both = F.col("close").isNotNull() & F.col("s_close").isNotNull()
    day = x.groupBy("root", "day").agg(
        F.max("contract").alias("_contract"), F.max("rank").alias("_rank"), F.count("close").alias("_bars"), F.count_if(both).alias("_common"), F.count_if(both & same_close("close", "s_close")).alias("_equal"))
    share = F.when(F.col("_common") >= minimum, F.col("_equal") / F.col("_common"))
    day = day.filter("_bars > 0").select("root", "day", "_contract", "_rank", F.when(share.isNull(), "unknown").when(share >= Q.IDENTITY_SHARE, "same").otherwise("another").alias("sample"))

    x = x.join(day, ["root", "day"])
    usable = F.col("sample") == "same"
    fill = F.col("close").isNull() & usable
    x = x.filter(F.col("close").isNotNull() | usable)
    differs = lambda p: F.coalesce(Q.differs(close_tol, extreme_tol, "", p), F.lit(False))
    why = F.when((F.col("_rank") != UNLABELLED) & differs("n_"), CONTINUOUS).when(usable & differs("s_"), SAMPLE)
    candles = x.withColumn("disagrees", why).select(
        "root", "ts", "day", F.when(fill, F.col("_contract")).otherwise(F.col("contract")).alias("contract"), F.when(fill, SAMPLE).otherwise(F.col("source")).alias("source"), F.col("disagrees"),
        *[F.coalesce(v, f"s_{v}").alias(v) if v != "volume" else F.when(fill, F.col("s_volume")).otherwise(F.col("volume")).alias(v) for v in OHLCV])

    seen = c.filter(F.col("ranks").isNotNull()).join(use, ["root", "day"]).filter(F.array_contains("ranks", F.col("rank"))).groupBy("root", "day").agg(F.count(F.lit(1)).alias("_seen"))
    counts = candles.groupBy("root", "day").agg(F.count(F.lit(1)).alias("bars"), F.count_if(F.col("source") == SAMPLE).alias("filled"), F.count("disagrees").alias("disagree"))
    w = Window.partitionBy("root").orderBy("day")
    before = use.withColumn("_from", F.lag("rank").over(w)).select("root", "day", F.col("_from").alias("rank"))
    left = before.join(volumes, ["root", "day", "rank"]).select("root", "day", F.col("volume").alias("from_volume"))
    days = use.join(volumes, ["root", "day", "rank"]).join(day.drop("_rank"), ["root", "day"]).join(counts, ["root", "day"]).join(seen, ["root", "day"], "left").join(left, ["root", "day"], "left")
    main = F.when(F.col("rank") == UNLABELLED, CONTINUOUS).otherwise(F.concat(F.lit("contract:"), F.col("_contract")))
    days = days.select("root", "day", "rank", F.col("_contract").alias("contract"), main.alias("source"), "volume", F.coalesce("from_volume", F.lit(0.0)).alias("from_volume"), "bars", "filled", "disagree", "sample",
                       ((F.col("_seen").isNotNull() & (F.col("rank") != UNLABELLED)) | (F.col("sample") == "same")).alias("verified"))
    return Composite(candles, days)
