"""Research helpers around an experiment: grids, splits, previews, guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import change
from tidemark.operators import episodes as E
from tidemark.operators import indicators as I
from tidemark.operators import robust as R
from tidemark.operators.ordered import by_symbol


def neighbour_grid(daily: DataFrame, thresholds: Sequence[float], windows: Sequence[int], horizon: int) -> DataFrame:
    """Every (threshold, window) cell of a falling-price rule in one job.

    Bars are read and windowed once; each bar is expanded only to the cells it qualifies for.
    """
    w = by_symbol()
    df = I.numbered(daily).withColumn("exit_date", F.lead("date", horizon).over(w)).withColumn(
        "fr", change(F.lead("close", horizon).over(w), F.col("close"))
    )
    df = df.withColumns({f"_m{k}": I.returns(lag=k) for k in windows})
    cells = [
        F.when((F.col("i") >= k) & (F.col(f"_m{k}") <= -t / 100), F.struct(F.lit(float(t)).alias("threshold"), F.lit(k).alias("window")))
        for t in thresholds for k in windows
    ]
    q = df.withColumn("cell", F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull()))).select(
        F.concat_ws("\x1f", "symbol", F.col("cell.threshold").cast("string"), F.col("cell.window").cast("string")).alias("_key"),
        "symbol", "cell.*", "i", "exit_date", "fr", "date",
    )
    picks = E.greedy_episodes(
        q.withColumn("_s", F.col("symbol")).withColumn("symbol", F.col("_key")).withColumn("q", F.lit(True)).withColumn("gapped", F.lit(False)),
        "q", horizon, 0, ["_s", "threshold", "window", "fr"],
    )
    cell = picks.filter("status = 'complete'").groupBy(F.col("_s").alias("symbol"), "threshold", "window").agg(
        F.count(F.lit(1)).alias("n"), F.avg("fr").alias("mean"), F.percentile("fr", 0.5).alias("median")
    )
    base = df.filter("fr is not null").withColumn(
        "window", F.explode(F.filter(F.array(*[F.lit(k) for k in windows]), lambda k: F.col("i") >= k))
    ).groupBy("symbol", "window").agg(F.avg("fr").alias("_bm"))
    return cell.join(base, ["symbol", "window"]).withColumn("difference", F.col("mean") - F.col("_bm")).drop("_bm")


def grid_agreement(grid: DataFrame, threshold: float, window: int, min_n: int = 10, share: float = 0.75) -> DataFrame:
    """Cells with enough episodes whose difference from the baseline agrees with the centre cell."""
    centre = F.max(F.when((F.col("threshold") == threshold) & (F.col("window") == window), F.col("difference"))).over(Window.partitionBy("symbol"))
    g = grid.withColumn("_c", centre).groupBy("symbol").agg(
        F.count_if(F.col("n") >= min_n).alias("cells"),
        F.count_if((F.col("n") >= min_n) & ((F.col("difference") > 0) == (F.col("_c") > 0))).alias("agree"),
    )
    return g.withColumn("stable", (F.col("cells") > 0) & (F.col("agree") >= share * F.col("cells")))


def time_split(outcomes: DataFrame, baseline: DataFrame, min_each: int = 8) -> DataFrame:
    """Halves of equal episode counts, each against the baseline of its own period."""
    g = Window.partitionBy("symbol")
    x = outcomes.withColumn("_p", F.row_number().over(g.orderBy("i"))).withColumn("_c", F.count(F.lit(1)).over(g))
    x = x.withColumn("half", F.when(F.col("_p") <= F.floor(F.col("_c") / 2), 1).otherwise(2))
    h = x.groupBy("symbol", "half").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"),
        F.min("trigger_date").alias("first_date"), F.max("trigger_date").alias("last_date"),
    )
    b = baseline.select("symbol", "date", F.col("v").alias("_b")).join(h.select("symbol", "half", "first_date", "last_date"), "symbol")
    b = b.filter(F.col("date").between(F.col("first_date"), F.col("last_date"))).groupBy("symbol", "half").agg(F.avg("_b").alias("baseline_mean"))
    return h.join(b, ["symbol", "half"]).withColumn("difference", F.col("mean") - F.col("baseline_mean")).withColumn("enough", F.col("n") >= min_each)


# 365.25 days a year, truncated to whole days.
PERIODS = {"full": 1_000_000, "last_5y": int(365.25 * 5), "last_3y": int(365.25 * 3)}


def recency(outcomes: DataFrame, daily: DataFrame) -> DataFrame:
    last = daily.groupBy("symbol").agg(F.max("date").alias("_m"))
    x = outcomes.join(last, "symbol").withColumn("_age", F.datediff("_m", "trigger_date"))
    periods = F.array(*[F.when(F.col("_age") <= d, F.lit(p)) for p, d in PERIODS.items()])
    x = x.withColumn("period", F.explode(F.filter(periods, lambda p: p.isNotNull())))
    return x.groupBy("symbol", "period").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"),
        (F.count_if(F.col("v") > 0) / F.count(F.lit(1))).alias("positive_rate"),
    )


def outlier_rows(outcomes: DataFrame) -> DataFrame:
    keys = ["symbol"]
    s = outcomes.groupBy("symbol").agg(F.avg("v").alias("mean"), F.percentile("v", 0.5).alias("median"))
    s = s.join(R.trimmed_mean(outcomes, keys).drop("each_side"), keys).join(R.winsorized_mean(outcomes, keys).drop("each_side"), keys)
    s = s.join(R.without_extremes(outcomes, keys, "i"), keys)
    labels = {"mean": "mean", "median": "median", "trimmed": "trimmed_mean", "winsorized": "winsorized_mean",
              "without_extreme": "mean_without_extreme", "without_both": "mean_without_both"}
    rows = F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).alias("value")) for k, c in labels.items()])
    return s.select("symbol", F.explode(rows).alias("r")).select("symbol", "r.label", "r.value")


def challenge(outcomes: DataFrame, baseline: DataFrame, daily: DataFrame, min_each: int = 8) -> DataFrame:
    """survived / caution / too few, per check."""
    t = time_split(outcomes, baseline).groupBy("symbol").agg(
        F.when((F.min("n") >= min_each) & (F.count(F.lit(1)) == 2),
               (F.max(F.when(F.col("half") == 1, F.col("difference"))) > 0) == (F.max(F.when(F.col("half") == 2, F.col("difference"))) > 0)).alias("ok"))
    rec = recency(outcomes, daily)
    p = rec.groupBy("symbol").agg(
        F.max(F.when(F.col("period") == "full", F.col("mean"))).alias("_f"), F.max(F.when(F.col("period") == "last_5y", F.col("mean"))).alias("_r"),
        F.max(F.when(F.col("period") == "last_5y", F.col("n"))).alias("_n"),
    ).select("symbol", F.when(F.col("_n") >= min_each, (F.col("_f") > 0) == (F.col("_r") > 0)).alias("ok"))
    mean = outcomes.groupBy("symbol").agg(F.avg("v").alias("_m"))
    o = outlier_rows(outcomes).filter("value is not null").join(mean, "symbol").groupBy("symbol").agg(F.bool_and((F.col("value") > 0) == (F.col("_m") > 0)).alias("ok"))
    parts = [d.select("symbol", F.lit(n).alias("check"), "ok") for n, d in (("time_split", t), ("recency", p), ("outliers", o))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("symbol", "check", F.when(F.col("ok"), "survived").when(~F.col("ok"), "caution").otherwise("too few").alias("verdict"))


def preview(evaluated: DataFrame, order: Sequence[str]) -> DataFrame:
    """Qualifying bars as each condition is added, in one pass."""
    upto, acc = [], None
    for c in order:
        holds = F.coalesce(F.col(c), F.lit(False))
        acc = holds if acc is None else acc & holds
        upto.append(acc)
    g = evaluated.groupBy("symbol").agg(*[F.count_if(u).alias(f"s{k}") for k, u in enumerate(upto, 1)])
    rows = F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"s{k}").alias("bars")) for k in range(1, len(upto) + 1)])
    return g.select("symbol", F.explode(rows).alias("r")).select("symbol", "r.*")


def history_guard(daily: DataFrame, warm: int, horizon: int) -> DataFrame:
    """Needs warm-up + horizon + 20 bars, and a tested range of horizon + 5."""
    g = daily.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    g = g.withColumn("warm", F.lit(warm)).withColumn("tested", F.greatest(F.col("n") - warm, F.lit(0)))
    status = F.when(F.col("n") < warm + horizon + 20, "too little history").when(F.col("tested") < horizon + 5, "range too short").otherwise("ok")
    return g.withColumn("status", status)


def period_sizes(daily: DataFrame, periods: dict[str, int]) -> DataFrame:
    x = daily.withColumn("_age", F.datediff(I.last_date(daily), "date"))
    hit = F.array(*[F.when(F.col("_age") <= d, F.lit(p)) for p, d in periods.items()])
    x = x.withColumn("period", F.explode(F.filter(hit, lambda p: p.isNotNull())))
    return x.groupBy("symbol", "period").agg(F.count(F.lit(1)).alias("n"), F.min("date").cast("string").alias("first_date"))


def rules_hash(rules: Column) -> Column:
    """sha1 of the map written as JSON with sorted keys."""
    entries = F.array_sort(F.map_entries(rules))
    return F.sha1(F.to_json(F.map_from_entries(entries)))


def variants_tried(runs: DataFrame) -> DataFrame:
    return runs.groupBy("project").agg(
        F.count(F.lit(1)).alias("runs"), F.count_distinct(F.sha1("rules")).alias("distinct_rules"),
        F.sum("combos").alias("variants"), F.count_if("relaxed").alias("relaxations"),
    )


def benchmark_return(outcomes: DataFrame, bench: DataFrame) -> DataFrame:
    """Benchmark move between the same entry and exit dates."""
    b0 = bench.select(F.col("date").alias("trigger_date"), F.col("close").alias("_b0"))
    b1 = bench.select(F.col("date").alias("exit_date"), F.col("close").alias("_b1"))
    x = outcomes.join(b0, "trigger_date", "left").join(b1, "exit_date", "left")
    return x.withColumn("benchmark_return", change(F.col("_b1"), F.col("_b0")))


def without_best(outcomes: DataFrame) -> DataFrame:
    g = Window.partitionBy("symbol")
    x = outcomes.withColumn("_rk", F.row_number().over(g.orderBy(F.desc("v")))).withColumn("n", F.count(F.lit(1)).over(g))
    return x.groupBy("symbol", "n").agg(
        F.avg("v").alias("mean"), F.avg(F.when(F.col("_rk") > 1, F.col("v"))).alias("without_best"),
        F.avg(F.when(F.col("_rk") > F.ceil(F.col("n") * 0.1), F.col("v"))).alias("without_top10"),
    )
