"""Conventional and robust statistics of outcome lists, side by side; nothing extreme is deleted.

Input: one row per outcome with the group keys, an order column and the value ``v``.  Outcome
lists are bounded: a symbol has at most one episode per ``horizon + 1`` daily bars.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import ratio

# Two-sided 95 % critical values of Student's t by degrees of freedom.
T_TABLE = {
    1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228,
    11: 2.201, 12: 2.179, 13: 2.160, 14: 2.145, 15: 2.131, 16: 2.120, 17: 2.110, 18: 2.101, 19: 2.093, 20: 2.086,
    21: 2.080, 22: 2.074, 23: 2.069, 24: 2.064, 25: 2.060, 26: 2.056, 27: 2.052, 28: 2.048, 29: 2.045, 30: 2.042,
    40: 2.021, 60: 2.000, 80: 1.990, 100: 1.984, 120: 1.980,
}
T_LIMIT = 1.960
BOOTSTRAP_SAMPLES = 2000
BOOTSTRAP_SEED = 7


def t_critical(df: Column) -> Column:
    """Table value; between rows linear in 1/df; the normal value above the last row."""
    knots = sorted(T_TABLE)
    out = F.when(df > knots[-1], F.lit(T_LIMIT))
    for a, b in zip(knots, knots[1:]):
        ta, tb = T_TABLE[a], T_TABLE[b]
        out = out.when(df == a, F.lit(ta))
        if b - a > 1:
            share = (1 / df - 1 / b) / (1 / a - 1 / b)
            out = out.when((df > a) & (df < b), F.lit(tb) + share * (ta - tb))
    return out.when(df == knots[-1], F.lit(T_TABLE[knots[-1]]))


def summarize(df: DataFrame, keys: Sequence[str], value: str = "v") -> DataFrame:
    """n, mean, median, sample std, signs, range, standard error and t interval."""
    v = F.col(value)
    g = df.groupBy(*keys).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.percentile(v, 0.5).alias("median"), F.stddev_samp(v).alias("std"),
        F.count_if(v > 0).alias("positives"), F.count_if(v < 0).alias("negatives"), F.count_if(v == 0).alias("flat"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    )
    g = g.withColumns({
        "positive_rate": ratio(F.col("positives"), F.col("n")), "negative_rate": ratio(F.col("negatives"), F.col("n")),
        "std_error": F.when(F.col("n") >= 2, F.col("std") / F.sqrt("n")), "t_crit": F.when(F.col("n") >= 2, t_critical(F.col("n") - 1)),
    })
    return g.withColumns({
        "ci_low": F.col("mean") - F.col("t_crit") * F.col("std_error"), "ci_high": F.col("mean") + F.col("t_crit") * F.col("std_error"),
    })


def percentiles(df: DataFrame, keys: Sequence[str], probs: dict[str, float], value: str = "v") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(value).alias("n"), *[F.percentile(value, p).alias(n) for n, p in probs.items()])


def _ranked(df: DataFrame, keys: Sequence[str], fraction: float, value: str) -> DataFrame:
    g = Window.partitionBy(*keys)
    x = df.filter(F.col(value).isNotNull()).withColumn("_rk", F.row_number().over(g.orderBy(value))).withColumn("n", F.count(F.lit(1)).over(g))
    k = F.floor(F.col("n") * fraction)
    return x.withColumn("k", F.when((k < 1) & (F.col("n") >= 10), 1).otherwise(k))


def _usable() -> Column:
    return (F.col("k") >= 1) & (F.col("n") - 2 * F.col("k") >= 2)


def trimmed_mean(df: DataFrame, keys: Sequence[str], fraction: float = 0.05, value: str = "v") -> DataFrame:
    """Mean without the k lowest and k highest; at least one each side once there are ten."""
    x = _ranked(df, keys, fraction, value)
    inside = (F.col("_rk") > F.col("k")) & (F.col("_rk") <= F.col("n") - F.col("k")) & _usable()
    return x.groupBy(*keys).agg(
        F.avg(F.when(inside, F.col(value))).alias("trimmed_mean"), F.max(F.when(_usable(), F.col("k")).otherwise(0)).alias("each_side")
    )


def winsorized_mean(df: DataFrame, keys: Sequence[str], fraction: float = 0.05, value: str = "v") -> DataFrame:
    """Mean with the k extremes of each side pulled to the nearest remaining value."""
    g = Window.partitionBy(*keys)
    x = _ranked(df, keys, fraction, value)
    x = x.withColumn("_lo", F.max(F.when(F.col("_rk") == F.col("k") + 1, F.col(value))).over(g)).withColumn(
        "_hi", F.max(F.when(F.col("_rk") == F.col("n") - F.col("k"), F.col(value))).over(g)
    )
    capped = F.least(F.greatest(F.col(value), F.col("_lo")), F.col("_hi"))
    return x.groupBy(*keys).agg(
        F.avg(F.when(_usable(), capped)).alias("winsorized_mean"), F.max(F.when(_usable(), F.col("k")).otherwise(0)).alias("each_side")
    )


def without_extremes(df: DataFrame, keys: Sequence[str], order: str, value: str = "v") -> DataFrame:
    """The outcome furthest from the median (first on ties) and the means without it / without both ends."""
    g = Window.partitionBy(*keys)
    x = df.withColumn("_d", F.abs(F.col(value) - F.percentile(value, 0.5).over(g)))
    a = x.groupBy(*keys).agg(
        F.count(value).alias("n"), F.sum(value).alias("_s"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.min_by(F.struct(F.col(value).alias("v"), F.col(order).alias("at")), F.struct((-F.col("_d")).alias("d"), F.col(order).alias("o"))).alias("_x"),
    )
    return a.select(
        *keys, "n", F.col("_x.v").alias("extreme_value"), F.col("_x.at").alias("extreme_at"),
        ratio(F.col("_s") - F.col("_x.v"), F.col("n") - 1).alias("mean_without_extreme"),
        F.when(F.col("n") >= 5, (F.col("_s") - F.col("_lo") - F.col("_hi")) / (F.col("n") - 2)).alias("mean_without_both"),
    )


def bootstrap_ci(df: DataFrame, keys: Sequence[str], order: str, value: str = "v", samples: int = BOOTSTRAP_SAMPLES,
                 seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """Percentile bootstrap of mean and median from hash-derived, repeatable draws."""
    vals = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"])
    g = df.groupBy(*keys).agg(vals.alias("_vals"), F.count(value).alias("n")).filter("n >= 5")
    # A key's values are copied to as many tasks as there are, not to every resample; each task then draws its share of the resamples.
    slices = max(1, min(samples, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    b = g.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(*keys, "_slice")
    b = b.withColumn("b", F.explode(F.sequence(F.col("_slice"), F.lit(samples - 1), F.lit(slices)))).drop("_slice")

    def draw(j):
        text = F.concat_ws("|", F.lit(str(seed)), F.col("b").cast("string"), j.cast("string"))
        number = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
        return F.element_at(F.col("_vals"), (number % F.col("n") + 1).cast("int"))

    drawn = b.withColumn("_s", F.sort_array(F.transform(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), draw)))
    mid = (F.element_at("_s", (F.floor((F.col("n") - 1) / 2) + 1).cast("int")) + F.element_at("_s", (F.floor(F.col("n") / 2) + 1).cast("int"))) / 2
    stat = drawn.select(*keys, "n", (F.aggregate("_s", F.lit(0.0), lambda a, x: a + x) / F.col("n")).alias("m"), mid.alias("d"))
    return stat.groupBy(*keys, "n").agg(
        F.percentile("m", 0.025).alias("mean_low"), F.percentile("m", 0.975).alias("mean_high"),
        F.percentile("d", 0.025).alias("median_low"), F.percentile("d", 0.975).alias("median_high"),
    )


def contribution(df: DataFrame, keys: Sequence[str], ks=(1, 3, 5), value: str = "v") -> DataFrame:
    """Share of all gains (losses) held by the k largest; null unless there are more than k."""
    side = F.when(F.col(value) > 0, "gain").when(F.col(value) < 0, "loss")
    x = df.withColumn("side", side).filter("side is not null").withColumn(
        "_rk", F.row_number().over(Window.partitionBy(*keys, "side").orderBy(F.desc(F.abs(F.col(value)))))
    )
    return x.groupBy(*keys, "side").agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"),
        *[F.when(F.count(F.lit(1)) > k, F.sum(F.when(F.col("_rk") <= k, F.col(value))) / F.sum(value)).alias(f"top{k}_share") for k in ks],
        (F.sum(F.when(F.col("_rk") == 1, F.col(value))) / F.sum(value)).alias("largest_share"),
    )


def rolling_outcomes(df: DataFrame, keys: Sequence[str], order: str, window: int = 20, value: str = "v") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    f = w.rowsBetween(-window + 1, 0)
    return df.withColumn("_rn", F.row_number().over(w)).withColumns({
        "mean": F.avg(value).over(f), "median": F.percentile(value, 0.5).over(f),
        "positive_rate": F.sum(F.when(F.col(value) > 0, 1).otherwise(0)).over(f) / window,
    }).filter(F.col("_rn") >= window).select(*keys, order, "mean", "median", "positive_rate")


def halves_and_years(df: DataFrame, keys: Sequence[str], order: str, date: str, value: str = "v") -> DataFrame:
    g = Window.partitionBy(*keys)
    x = df.withColumn("_rn", F.row_number().over(g.orderBy(order))).withColumn("_n", F.count(F.lit(1)).over(g))
    half = F.floor(F.col("_n") / 2)
    h = x.groupBy(*keys).agg(
        F.avg(F.when(F.col("_rn") <= half, F.col(value))).alias("first_half"), F.avg(F.when(F.col("_rn") > half, F.col(value))).alias("second_half"),
        F.avg(value).alias("_m"),
    )
    y = x.groupBy(*keys, F.year(date).alias("_y")).agg(F.avg(value).alias("_ym"))
    y = y.join(h, list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("years"), F.count_if((F.col("_ym") > 0) == (F.col("_m") > 0)).alias("years_agree"))
    return h.drop("_m").join(y, list(keys))


def robustness_checks(df: DataFrame, keys: Sequence[str], order: str, date: str, baseline_mean: DataFrame, trim: float = 0.05,
                      min_sample: int = 30) -> DataFrame:
    """One row per check; ``ok`` null means information only or not enough outcomes."""
    keys = list(keys)
    s = summarize(df, keys).join(trimmed_mean(df, keys, trim), keys).join(
        without_extremes(df, keys, order).drop("n"), keys).join(halves_and_years(df, keys, order, date), keys)
    gains = contribution(df, keys).filter("side = 'gain'").select(*keys, F.col("largest_share").alias("gain_share"))
    s = s.join(gains, keys, "left").join(baseline_mean, keys, "left")
    m, med = F.col("mean"), F.col("median")
    moved = F.abs(F.col("mean_without_extreme") - m)
    checks = {
        "sample": F.col("n") >= min_sample,
        "mean_median": ((m > 0) == (med > 0)) | (m == 0) | (med == 0),
        "trimmed_sign": F.when(F.col("trimmed_mean").isNotNull(), (F.col("trimmed_mean") > 0) == (m > 0)),
        "single_episode": F.when(F.col("mean_without_extreme").isNotNull() & (m != 0), ~(moved > F.greatest(0.25 * F.abs(m), F.lit(0.002)))),
        "largest_gain": F.when(F.col("gain_share").isNotNull() & (m > 0), F.col("gain_share") < 0.25),
        "halves": F.when(F.col("n") >= 10, (F.col("first_half") > 0) == (F.col("second_half") > 0)),
        "baseline": F.when(F.col("ci_low").isNotNull() & F.col("baseline_mean").isNotNull(),
                           ~F.col("baseline_mean").between(F.col("ci_low"), F.col("ci_high"))),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("ok")) for k, v in checks.items()])
    return s.select(*keys, F.when((F.col("n") >= 10) & (F.col("years") >= 3), F.col("years_agree")).alias("years_agree"), F.explode(rows).alias("c")).select(
        *keys, "c.check", "c.ok", "years_agree")
