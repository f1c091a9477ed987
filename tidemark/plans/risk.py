"""Risk statistics of daily closes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.maths import tidy
from tidemark.operators import episodes as E
from tidemark.operators import indicators as I
from tidemark.operators import risk as K
from tidemark.plans import views as V
from tidemark.plans.registry import query, r
from tidemark.plans.research import _FWD, _base, H, WARM

BENCH = "1-URGENT"


def _out(df, *rounded, dates=()):
    return df.withColumns({**{c: tidy(F.col(c)) for c in rounded}, **{d: F.col(d).cast("string") for d in dates}})


def _fm(days) -> str:
    return V.sql("dn") + ", fm AS (" + " UNION ALL ".join(
        f"SELECT symbol, {d} AS days, i, date AS s, lead(date, {d}) OVER w AS e, lead(close, {d}) OVER w / close - 1 AS v FROM dn WINDOW w AS (PARTITION BY symbol ORDER BY date)" for d in days
    ) + "), m AS (SELECT * FROM fm WHERE v IS NOT NULL)"


@query("horizon_stats", _fm(K.HORIZONS) + f""" SELECT symbol, days, count(*) AS n, CAST(count(*) // days AS BIGINT) AS independent, {r('avg(v)','mean')}, {r('stddev_samp(v)','std')}, {r('quantile_cont(v, 0.05)','p5')},
  {r('quantile_cont(v, 0.25)','p25')}, {r('quantile_cont(v, 0.5)','median')}, {r('quantile_cont(v, 0.75)','p75')}, {r('quantile_cont(v, 0.95)','p95')}, {r('min(v)','worst')},
  CAST(arg_min(s, (v, i)) AS VARCHAR) AS worst_start, CAST(arg_min(e, (v, i)) AS VARCHAR) AS worst_end, {r('max(v)','best')}, CAST(arg_max(s, (v, -i)) AS VARCHAR) AS best_start,
  CAST(arg_max(e, (v, -i)) AS VARCHAR) AS best_end, {r('count(*) FILTER (v < 0) / count(*)','p_negative')} FROM m GROUP BY 1, 2 HAVING count(*) >= 20""")
def horizon_stats(spark, sf):
    h = K.horizon_stats(V.daily(spark, sf))
    return _out(h, "mean", "std", "p5", "p25", "median", "p75", "p95", "worst", "best", "p_negative", dates=("worst_start", "worst_end", "best_start", "best_end"))


@query("histogram", _FWD + """, ed AS (SELECT symbol, quantile_cont(v, 0.005) AS lo, quantile_cont(v, 0.995) AS hi FROM base GROUP BY 1),
b AS (SELECT symbol, CASE WHEN v < lo THEN 0 WHEN v > hi THEN 35 ELSE least(CAST(floor((v - lo) / ((hi - lo) / 36)) AS INTEGER), 35) END AS bin, v < lo AS below, v > hi AS above FROM base JOIN ed USING (symbol))
SELECT symbol, bin, count(*) AS n, count(*) FILTER (below) AS clipped_below, count(*) FILTER (above) AS clipped_above FROM b GROUP BY 1, 2""")
def histogram(spark, sf):
    return K.histogram(E.baseline(_base(spark, sf), H, WARM), ["symbol"])


_DD = V.sql("dn") + """, u AS (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY date) AS pk FROM dn), pn AS (SELECT *, close / pk - 1 AS dep,
  sum(CASE WHEN close >= pk THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date) AS no FROM u),
g AS (SELECT symbol, no, min(date) AS peak, min(i) AS pi, arg_min(date, (dep, i)) AS trough, arg_min(i, (dep, i)) AS ti, min(dep) AS depth FROM pn GROUP BY 1, 2),
d AS (SELECT *, lead(peak) OVER (PARTITION BY symbol ORDER BY no) AS recovered, lead(pi) OVER (PARTITION BY symbol ORDER BY no) AS ri FROM g),
dd AS (SELECT * FROM d WHERE depth <= -0.05)"""


@query("drawdowns", _DD + f""" SELECT symbol, CAST(peak AS VARCHAR) AS peak, CAST(trough AS VARCHAR) AS trough, {r('depth','depth')}, ti - pi AS days_to_trough, CAST(recovered AS VARCHAR) AS recovered,
  ri - ti AS days_to_recover, depth <= -0.2 AS significant FROM dd""")
def drawdowns(spark, sf):
    d = K.drawdowns(V.daily(spark, sf)).withColumns({c: F.col(c).cast("long") for c in ("days_to_trough", "days_to_recover")})
    return _out(d, "depth", dates=("peak", "trough", "recovered"))


@query("drawdown_summary", _DD + f""", cur AS (SELECT symbol, arg_max(dep, i) AS c FROM pn GROUP BY 1)
SELECT symbol, {r('any_value(c)','current')}, {r('min(depth)','deepest')}, count(*) FILTER (depth <= -0.2) AS significant_count, {r('avg(depth) FILTER (depth <= -0.2)','average_significant')},
  {r('quantile_cont((ri - ti)::DOUBLE, 0.5) FILTER (depth <= -0.2)','median_recovery_days')} FROM dd JOIN cur USING (symbol) GROUP BY symbol""")
def drawdown_summary(spark, sf):
    return _out(K.drawdown_summary(V.daily(spark, sf)), "current", "deepest", "average_significant", "median_recovery_days")


@query("rolling_vol", V.sql("dn") + f""", x AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS rr FROM dn),
v AS (SELECT *, """ + ", ".join(f"CASE WHEN i >= {d} THEN stddev_samp(rr) OVER (PARTITION BY symbol ORDER BY date ROWS {d - 1} PRECEDING) * sqrt(252) END AS v{d}" for d in (30, 90, 252)) + f""" FROM x),
nw AS (SELECT symbol, arg_max(v30, i) AS now FROM v GROUP BY 1)
SELECT symbol, {r('stddev_samp(rr) * sqrt(252)','full')}, {r('arg_max(v30, i)','vol_30')}, {r('arg_max(v90, i)','vol_90')}, {r('arg_max(v252, i)','vol_252')},
  {r('count(*) FILTER (i >= 30 AND (i - 30) % 5 = 0 AND v30 <= now) / nullif(count(*) FILTER (i >= 30 AND (i - 30) % 5 = 0), 0)','percentile_30')} FROM v JOIN nw USING (symbol) GROUP BY symbol""")
def rolling_vol(spark, sf):
    return _out(K.volatility(V.daily(spark, sf)), "full", "vol_30", "vol_90", "vol_252", "percentile_30")


@query("beta_corr", V.sql("daily") + f""", m AS (SELECT *, max(date) OVER (PARTITION BY symbol) AS mx FROM daily),
t AS (SELECT m.symbol, years, m.date, m.close, b.close AS bc FROM m, (VALUES (1, 365), (3, 1095)) y(years, days), daily b WHERE b.symbol = '{BENCH}' AND b.date = m.date AND m.date >= mx - CAST(days AS INTEGER)),
p AS (SELECT symbol, years, close / lag(close) OVER w - 1 AS a, bc / lag(bc) OVER w - 1 AS b FROM t WINDOW w AS (PARTITION BY symbol, years ORDER BY date))
SELECT symbol, years, count(*) AS n, {r('covar_samp(a, b) / var_samp(b)','beta')}, {r('corr(a, b)','correlation')} FROM p WHERE a IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 60""")
def beta_corr(spark, sf):
    d = V.daily(spark, sf)
    return _out(K.beta_over_years(d, d.filter(F.col("symbol") == BENCH)), "beta", "correlation")


@query("aligned_returns", V.sql("daily") + f""", b AS (SELECT date, close AS bc FROM daily WHERE symbol = '{BENCH}'),
v1 AS (SELECT symbol, date, close / lag(close) OVER w - 1 AS a, bc / lag(bc) OVER w - 1 AS b FROM daily JOIN b USING (date) WINDOW w AS (PARTITION BY symbol ORDER BY date)),
rb AS (SELECT date, bc / lag(bc) OVER (ORDER BY date) - 1 AS b FROM b), ra AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS a FROM daily)
SELECT symbol, CAST(date AS VARCHAR) AS date, 'aligned first' AS variant, {r('a','a')}, {r('b','b')} FROM v1 WHERE a IS NOT NULL
UNION ALL SELECT symbol, CAST(date AS VARCHAR), 'returns first', {r('a','a')}, {r('b','b')} FROM ra JOIN rb USING (date) WHERE a IS NOT NULL AND b IS NOT NULL""")
def aligned_returns(spark, sf):
    d = V.daily(spark, sf)
    b = d.filter(F.col("symbol") == BENCH)
    x = K.aligned_returns(d, b).withColumn("variant", F.lit("aligned first")).unionByName(K.returns_aligned(d, b).withColumn("variant", F.lit("returns first")))
    return _out(x, "a", "b", dates=("date",))


@query("extremes", _fm((1, 5, 21)) + f""" SELECT symbol, days, {r('max(v)','gain')}, CAST(arg_max(s, (v, i)) AS VARCHAR) AS gain_start, CAST(arg_max(e, (v, i)) AS VARCHAR) AS gain_end,
  {r('min(v)','loss')}, CAST(arg_min(s, (v, i)) AS VARCHAR) AS loss_start, CAST(arg_min(e, (v, i)) AS VARCHAR) AS loss_end FROM m GROUP BY 1, 2""")
def extremes(spark, sf):
    return _out(K.extremes(V.daily(spark, sf)), "gain", "loss", dates=("gain_start", "gain_end", "loss_start", "loss_end"))


@query("gaps", V.sql("daily") + f""", g AS (SELECT symbol, date, open / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS g FROM daily)
SELECT symbol, count(*) AS sessions, {r('max(g)','largest_up')}, CAST(arg_max(date, (g, date)) AS VARCHAR) AS up_date, {r('min(g)','largest_down')}, CAST(arg_min(date, (g, date)) AS VARCHAR) AS down_date,
  {r('count(*) FILTER (abs(g) >= 0.05) / count(*)','share_over_5pct')}, count(*) FILTER (g <= -0.10) AS down_over_10pct FROM g WHERE g IS NOT NULL AND date >= DATE '1996-08-01' GROUP BY 1""")
def gaps(spark, sf):
    return _out(K.overnight_gaps(V.daily(spark, sf), "1996-08-01"), "largest_up", "largest_down", "share_over_5pct", dates=("up_date", "down_date"))


@query("tail_risk", V.sql("daily") + f""", m AS (SELECT *, max(date) OVER (PARTITION BY symbol) AS mx FROM daily), x AS (SELECT symbol, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS rr FROM m WHERE date >= mx - 1826),
y AS (SELECT * FROM x WHERE rr IS NOT NULL), q AS (SELECT symbol, quantile_cont(rr, 0.05) AS v95, quantile_cont(rr, 0.01) AS v99 FROM y GROUP BY 1)
SELECT symbol, {r('any_value(v95)','var95')}, {r('any_value(v99)','var99')}, count(*) AS n, {r('avg(rr) FILTER (rr <= v95)','es95')}, {r('avg(rr) FILTER (rr <= v99)','es99')},
  {r('sqrt(avg(least(rr, 0) ** 2)) * sqrt(252)','downside_deviation')}, {r('avg(rr) * 252','annual_mean')}, {r('min(rr)','worst_day')}, {r('max(rr)','best_day')},
  {r('avg(rr) * 252 / (sqrt(avg(least(rr, 0) ** 2)) * sqrt(252))','sortino')} FROM y JOIN q USING (symbol) GROUP BY symbol HAVING count(*) > 100""")
def tail_risk(spark, sf):
    return _out(K.tail_risk(V.daily(spark, sf)), "var95", "var99", "es95", "es99", "downside_deviation", "annual_mean", "worst_day", "best_day", "sortino")


@query("quick_read", V.sql("dn") + f""", x AS (SELECT *, close / lag(close) OVER w - 1 AS rr, close / max(close) OVER w - 1 AS dd FROM dn WHERE i >= n - 253 WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT symbol, {r('stddev_samp(rr) * sqrt(252)','vol')}, {r('min(dd)','worst_drawdown')}, count(*) FILTER (abs(rr) >= 0.05) AS big_days FROM x GROUP BY 1""")
def quick_read(spark, sf):
    return _out(K.quick_read(V.daily(spark, sf)), "vol", "worst_drawdown")


@query("peer_moves", V.sql("daily") + f""", mv AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS move FROM daily),
x AS (SELECT * FROM mv WHERE move IS NOT NULL)
SELECT a.symbol, CAST(a.date AS VARCHAR) AS date, {r('any_value(a.move)','move')}, count(*) AS peers, {r('quantile_cont(b.move, 0.5)','peer_median')},
  CASE WHEN any_value(a.move) >= 0.01 THEN count(*) FILTER (b.move >= 0.01) WHEN any_value(a.move) <= -0.01 THEN count(*) FILTER (b.move <= -0.01) END AS same_direction
FROM x a JOIN x b ON a.date = b.date AND a.symbol <> b.symbol GROUP BY a.symbol, a.date""")
def peer_moves(spark, sf):
    m = V.daily(spark, sf).withColumn("move", I.returns()).filter("move is not null").select("symbol", "date", "move")
    return _out(K.peer_moves(m, ["date"]), "move", "peer_median", dates=("date",))
