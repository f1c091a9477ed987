"""Risk statistics per symbol on daily closes (a symbol's history is bounded by the calendar)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import TRADING_DAYS, change, ratio
from tidemark.operators import indicators as I
from tidemark.operators.ordered import by_symbol

# Fixed values.
HORIZONS = [1, 5, 21, 63, 252, 1260]
MIN_VALUES = 20
BINS = 36
DRAWDOWN_FLOOR = -0.05
SIGNIFICANT = -0.20
MIN_OVERLAP = 60
TAIL_MIN = 100
YEAR_DAYS = 365.25


def forward_moves(daily: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """(symbol, days, i, start, end, value): one scan, one window, all horizons."""
    w = by_symbol()
    df = I.numbered(daily)
    cells = [
        F.when(F.lead("close", d).over(w).isNotNull(),
               F.struct(F.lit(d).alias("days"), F.lead("date", d).over(w).alias("end"), (F.lead("close", d).over(w) / F.col("close") - 1).alias("value")))
        for d in horizons
    ]
    x = df.select("symbol", "i", F.col("date").alias("start"), F.array(*cells).alias("_c"))
    return x.select("symbol", "i", "start", F.explode(F.filter("_c", lambda c: c.isNotNull())).alias("c")).select("symbol", "i", "start", "c.*")


def horizon_stats(daily: DataFrame, horizons: Sequence[int] = tuple(HORIZONS)) -> DataFrame:
    m = forward_moves(daily, horizons)
    at = F.struct("value", F.col("start").alias("start"), F.col("end").alias("end"))
    g = m.groupBy("symbol", "days").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.percentile("value", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("_p"),
        F.min_by(at, F.struct("value", "i")).alias("worst"), F.max_by(at, F.struct(F.col("value"), (-F.col("i")).alias("o"))).alias("best"),
        F.count_if(F.col("value") < 0).alias("_neg"),
    ).filter(F.col("n") >= MIN_VALUES)
    return g.select(
        "symbol", "days", "n", F.floor(F.col("n") / F.col("days")).alias("independent"), "mean", "std",
        *[F.col("_p")[k].alias(n) for k, n in enumerate(("p5", "p25", "median", "p75", "p95"))],
        F.col("worst.value").alias("worst"), F.col("worst.start").alias("worst_start"), F.col("worst.end").alias("worst_end"),
        F.col("best.value").alias("best"), F.col("best.start").alias("best_start"), F.col("best.end").alias("best_end"),
        (F.col("_neg") / F.col("n")).alias("p_negative"),
    )


def histogram(values: DataFrame, keys: Sequence[str], bins: int = BINS, value: str = "v") -> DataFrame:
    """Counts between the 0.5 and 99.5 percentiles; outliers fall into the edge bins and are counted."""
    keys = list(keys)
    edge = values.groupBy(*keys).agg(F.percentile(value, 0.005).alias("lo"), F.percentile(value, 0.995).alias("_hi"))
    edge = edge.withColumn("_hi", F.when(F.col("_hi") <= F.col("lo"), F.col("lo") + 1e-9).otherwise(F.col("_hi")))
    edge = edge.withColumn("width", (F.col("_hi") - F.col("lo")) / bins)
    x = values.join(edge, keys)
    v = F.col(value)
    b = F.when(v < F.col("lo"), 0).when(v > F.col("_hi"), bins - 1).otherwise(F.least(F.floor((v - F.col("lo")) / F.col("width")), F.lit(bins - 1)))
    return x.groupBy(*keys, b.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(v < F.col("lo")).alias("clipped_below"), F.count_if(v > F.col("_hi")).alias("clipped_above"))


def underwater(daily: DataFrame) -> DataFrame:
    """Distance from the running peak and the number of the peak each bar hangs on."""
    w = by_symbol()
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = I.numbered(daily).withColumn("peak_price", F.max("close").over(upto))
    x = x.withColumn("peak_no", F.sum(F.when(F.col("close") >= F.col("peak_price"), 1).otherwise(0)).over(upto))
    return x.withColumn("depth", F.col("close") / F.col("peak_price") - 1)


def drawdowns(daily: DataFrame, floor: float = DRAWDOWN_FLOOR) -> DataFrame:
    """Episodes below a peak; recovered on the first close at or above it."""
    u = underwater(daily)
    g = u.groupBy("symbol", "peak_no").agg(
        F.min("date").alias("peak"), F.min("i").alias("_pi"), F.min_by("date", F.struct("depth", "i")).alias("trough"),
        F.min_by("i", F.struct("depth", "i")).alias("_ti"), F.min("depth").alias("depth"),
    )
    nxt = Window.partitionBy("symbol").orderBy("peak_no")
    g = g.withColumn("recovered", F.lead("peak").over(nxt)).withColumn("_ri", F.lead("_pi").over(nxt))
    return g.filter(F.col("depth") <= floor).select(
        "symbol", "peak", "trough", "depth", (F.col("_ti") - F.col("_pi")).alias("days_to_trough"), "recovered",
        (F.col("_ri") - F.col("_ti")).alias("days_to_recover"), (F.col("depth") <= SIGNIFICANT).alias("significant"))


def drawdown_summary(daily: DataFrame) -> DataFrame:
    u = underwater(daily).groupBy("symbol").agg(F.max_by("depth", "i").alias("current"))
    d = drawdowns(daily).groupBy("symbol").agg(
        F.min("depth").alias("deepest"), F.count_if("significant").alias("significant_count"),
        F.avg(F.when(F.col("significant"), F.col("depth"))).alias("average_significant"),
        F.percentile(F.when(F.col("significant"), F.col("days_to_recover").cast("double")), 0.5).alias("median_recovery_days"))
    return u.join(d, "symbol", "left")


def volatility(daily: DataFrame) -> DataFrame:
    """Annualised sample volatility: full, rolling 30/90/252, and where the current 30-day value stands."""
    w = by_symbol()
    root = F.sqrt(F.lit(float(TRADING_DAYS)))
    x = I.numbered(daily).withColumn("_r", I.returns())
    for d in (30, 90, 252):
        f = w.rowsBetween(-d + 1, 0)
        x = x.withColumn(f"vol_{d}", F.when(F.count("_r").over(f) == d, F.stddev_samp("_r").over(f) * root))
    g = Window.partitionBy("symbol")
    x = x.withColumn("_now", F.max_by("vol_30", "i").over(g))
    sampled = (F.col("i") >= 30) & (F.pmod(F.col("i") - 30, F.lit(5)) == 0)
    return x.groupBy("symbol").agg(
        (F.stddev_samp("_r") * root).alias("full"), *[F.max_by(f"vol_{d}", "i").alias(f"vol_{d}") for d in (30, 90, 252)],
        (F.count_if(sampled & (F.col("vol_30") <= F.col("_now"))) / F.nullif(F.count_if(sampled), F.lit(0))).alias("percentile_30"))


def since(daily: DataFrame, years: float) -> DataFrame:
    return I.slice_period(daily, days=int(YEAR_DAYS * years))


def aligned_returns(daily: DataFrame, bench: DataFrame) -> DataFrame:
    """Returns after alignment: keep the shared dates first, then difference."""
    b = bench.select("date", F.col("close").alias("_b"))
    w = by_symbol()
    x = daily.join(b, "date").withColumn("a", change(F.col("close"), F.lag("close").over(w))).withColumn("b", change(F.col("_b"), F.lag("_b").over(w)))
    return x.filter("a is not null").select("symbol", "date", "a", "b")


def returns_aligned(daily: DataFrame, bench: DataFrame) -> DataFrame:
    """Alignment of returns: difference each series on its own dates, then keep the shared ones."""
    rb = bench.withColumn("b", change(F.col("close"), F.lag("close").over(by_symbol()))).filter("b is not null").select("date", "b")
    ra = daily.withColumn("a", I.returns()).filter("a is not null").select("symbol", "date", "a")
    return ra.join(rb, "date")


def beta_corr(pairs: DataFrame, keys: Sequence[str], min_n: int = MIN_OVERLAP) -> DataFrame:
    g = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.covar_samp("a", "b").alias("_c"), F.var_samp("b").alias("_v"), F.corr("a", "b").alias("correlation"))
    return g.filter(F.col("n") >= min_n).select(*keys, "n", ratio(F.col("_c"), F.col("_v")).alias("beta"), "correlation")


def beta_over_years(daily: DataFrame, bench: DataFrame, years: Sequence[int] = (1, 3)) -> DataFrame:
    """Both spans from one pass: rows are tagged with the spans they fall into before differencing."""
    x = daily.withColumn("_age", F.datediff(I.last_date(daily), "date"))
    spans = F.array(*[F.when(F.col("_age") <= int(YEAR_DAYS * y), F.lit(y)) for y in years])
    x = x.withColumn("years", F.explode(F.filter(spans, lambda y: y.isNotNull())))
    b = bench.select("date", F.col("close").alias("_b"))
    w = Window.partitionBy("symbol", "years").orderBy("date")
    p = x.join(b, "date").withColumn("a", change(F.col("close"), F.lag("close").over(w))).withColumn("b", change(F.col("_b"), F.lag("_b").over(w)))
    return beta_corr(p.filter("a is not null"), ["symbol", "years"])


def extremes(daily: DataFrame, days: Sequence[int] = (1, 5, 21)) -> DataFrame:
    m = forward_moves(daily, days)
    at = F.struct("value", "i", "start", "end")
    g = m.groupBy("symbol", "days").agg(F.max(at).alias("g"), F.min(at).alias("l"))
    return g.select("symbol", "days", F.col("g.value").alias("gain"), F.col("g.start").alias("gain_start"), F.col("g.end").alias("gain_end"),
                    F.col("l.value").alias("loss"), F.col("l.start").alias("loss_start"), F.col("l.end").alias("loss_end"))


def overnight_gaps(daily: DataFrame, start: str | None = None) -> DataFrame:
    w = by_symbol()
    x = daily.withColumn("g", change(F.col("open"), F.lag("close").over(w))).filter("g is not null")
    x = I.slice_period(x, start=start)
    return x.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("sessions"), F.max(F.struct("g", "date")).alias("u"), F.min(F.struct("g", "date")).alias("d"),
        (F.count_if(F.abs("g") >= 0.05) / F.count(F.lit(1))).alias("share_over_5pct"), F.count_if(F.col("g") <= -0.10).alias("down_over_10pct"),
    ).select("symbol", "sessions", F.col("u.g").alias("largest_up"), F.col("u.date").alias("up_date"), F.col("d.g").alias("largest_down"),
             F.col("d.date").alias("down_date"), "share_over_5pct", "down_over_10pct")


def tail_risk(daily: DataFrame, years: float = 5) -> DataFrame:
    x = since(daily, years).withColumn("r", I.returns()).filter("r is not null")
    g = Window.partitionBy("symbol")
    x = x.withColumn("var95", F.percentile("r", 0.05).over(g)).withColumn("var99", F.percentile("r", 0.01).over(g))
    a = x.groupBy("symbol", "var95", "var99").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("r") <= F.col("var95"), F.col("r"))).alias("es95"),
        F.avg(F.when(F.col("r") <= F.col("var99"), F.col("r"))).alias("es99"),
        (F.sqrt(F.avg(F.pow(F.least("r", F.lit(0.0)), 2))) * F.sqrt(F.lit(252.0))).alias("downside_deviation"),
        (F.avg("r") * TRADING_DAYS).alias("annual_mean"), F.min("r").alias("worst_day"), F.max("r").alias("best_day"))
    return a.filter(F.col("n") > TAIL_MIN).withColumn("sortino", ratio(F.col("annual_mean"), F.col("downside_deviation")))


def quick_read(daily: DataFrame, bars: int = TRADING_DAYS) -> DataFrame:
    """One-year quick read: volatility, worst drawdown, days moving five percent or more."""
    last = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date")))
    x = daily.withColumn("_l", last).filter(F.col("_l") <= bars + 1)
    w = by_symbol()
    x = x.withColumn("r", I.returns()).withColumn("dd", F.col("close") / F.max("close").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return x.groupBy("symbol").agg((F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("vol"), F.min("dd").alias("worst_drawdown"), F.count_if(F.abs("r") >= 0.05).alias("big_days"))


def peer_moves(moves: DataFrame, group: Sequence[str], min_move: float = 0.01) -> DataFrame:
    """Per member: median move of the *other* members and how many moved as far the same way.

    Counts come from group totals minus the member itself and the median from two ranks, so no
    pair of members is ever formed.
    """
    g = Window.partitionBy(*group)
    x = moves.withColumn("_n", F.count(F.lit(1)).over(g)).withColumn("_rk", F.row_number().over(g.orderBy("move", "symbol")) - 1)
    m = F.col("_n") - 1
    lo, hi = F.floor((m - 1) / 2), F.floor(m / 2)
    up, down = F.col("move") >= min_move, F.col("move") <= -min_move
    totals = {"_up": F.sum(F.when(up, 1).otherwise(0)).over(g), "_down": F.sum(F.when(down, 1).otherwise(0)).over(g)}
    at = lambda k: F.max(F.when(F.col("_rk") == k, F.col("move"))).over(g)
    x = x.withColumns({**totals, "_lo": lo, "_hi": hi}).withColumns({
        "_l0": at(F.col("_lo")), "_l1": at(F.col("_lo") + 1), "_h0": at(F.col("_hi")), "_h1": at(F.col("_hi") + 1)})
    pick = lambda k, a, b: F.when(F.col(k) < F.col("_rk"), F.col(a)).otherwise(F.col(b))
    median = (pick("_lo", "_l0", "_l1") + pick("_hi", "_h0", "_h1")) / 2
    same = F.when(up, F.col("_up") - 1).when(down, F.col("_down") - 1)
    return x.filter("_n > 1").select(*moves.columns, (F.col("_n") - 1).alias("peers"), median.alias("peer_median"), same.alias("same_direction"))
