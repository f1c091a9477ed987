"""Daily bars: indicators, conditions, data quality, chart tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.maths import tidy
from tidemark.operators import conditions as C
from tidemark.operators import daily_quality as Q
from tidemark.operators import indicators as I
from tidemark.plans import views as V
from tidemark.plans.registry import query, r
from tidemark.plans.research import _FWD_BODY, _outcomes

_W = "WINDOW w AS (PARTITION BY symbol ORDER BY date)"


def _pick(df, *cols, tidied=()):
    return df.select("symbol", F.col("i").cast("long").alias("i"), *cols).withColumns({c: tidy(F.col(c)) for c in tidied})


def _nd(spark, sf):
    return I.numbered(V.daily(spark, sf))


@query("sma", V.sql("dn") + f" SELECT symbol, i, round(CASE WHEN i >= 19 THEN avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) END + 1e-9, 6) + 0.0 AS sma FROM dn")
def sma(spark, sf):
    return _pick(_nd(spark, sf).withColumn("sma", I.sma(20)), "sma", tidied=["sma"])


@query("trailing_mean", V.sql("dn") + " SELECT symbol, i, round(CASE WHEN i >= 20 THEN avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END + 1e-9, 6) + 0.0 AS mean FROM dn")
def trailing_mean(spark, sf):
    return _pick(_nd(spark, sf).withColumn("mean", I.trailing_mean(20, "volume")), "mean", tidied=["mean"])


_RSI = V.sql("dn") + """, ch AS (SELECT symbol, i, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS dn FROM dn WINDOW w AS (PARTITION BY symbol ORDER BY date)),
seed AS (SELECT symbol, 14::BIGINT AS i, avg(up) AS g, avg(dn) AS l FROM ch WHERE i BETWEEN 1 AND 14 GROUP BY symbol HAVING count(*) = 14),
ws AS (SELECT * FROM seed UNION ALL SELECT ws.symbol, ch.i, (ws.g * 13 + ch.up) / 14, (ws.l * 13 + ch.dn) / 14 FROM ws JOIN ch ON ch.symbol = ws.symbol AND ch.i = ws.i + 1),
rs AS (SELECT symbol, i, CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS v FROM ws)"""


@query("rsi", _RSI + f" SELECT dn.symbol, dn.i, {r('v','rsi')} FROM dn LEFT JOIN rs USING (symbol, i)")
def rsi(spark, sf):
    return _pick(I.with_rsi(_nd(spark, sf), 14), "rsi", tidied=["rsi"])


@query("returns", V.sql("dn") + f" SELECT symbol, i, {r('close / lag(close) OVER w - 1','ret')} FROM dn {_W}")
def returns(spark, sf):
    return _pick(_nd(spark, sf).withColumn("ret", I.returns()), "ret", tidied=["ret"])


@query("rolling_std", V.sql("dn") + " SELECT symbol, i, round(CASE WHEN i >= 19 THEN stddev_samp(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) END + 1e-9, 6) + 0.0 AS std FROM dn")
def rolling_std(spark, sf):
    return _pick(_nd(spark, sf).withColumn("std", I.rolling_std(20, "close")), "std", tidied=["std"])


def _cond(spark, sf, name, params):
    df = C.evaluate(V.daily(spark, sf), {"holds": (name, params)})
    return _pick(df.withColumnRenamed("holds_value", "value"), "holds", "value", tidied=["value"])


def _csql(holds: str, value: str, extra: str = "") -> str:
    return V.sql("dn") + f", f AS (SELECT *, {extra} FROM dn WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, i, {holds} AS holds, {r(value, 'value')} FROM f"


@query("c_price_move", _csql("close / p - 1 >= 0.05", "close / p - 1", "lag(close, 3) OVER w AS p"))
def c_price_move(spark, sf):
    return _cond(spark, sf, "price_move", {"direction": "rises", "threshold": 5, "window": 3})


@query("c_drawdown", _csql("CASE WHEN i >= 62 THEN close <= pk * (1 - 0.1) END", "CASE WHEN i >= 62 THEN close / pk - 1 END",
                           "max(close) OVER (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING) AS pk"))
def c_drawdown(spark, sf):
    return _cond(spark, sf, "drawdown_from_high", {"threshold": 10, "lookback": 63})


@query("c_new_extreme", _csql("CASE WHEN i >= 63 THEN close < pk END", "CASE WHEN i >= 63 THEN close / pk - 1 END",
                              "min(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING) AS pk"))
def c_new_extreme(spark, sf):
    return _cond(spark, sf, "new_extreme", {"kind": "low", "lookback": 63})


@query("c_gap", _csql("open / p - 1 >= 0.003", "open / p - 1", "lag(close) OVER w AS p"))
def c_gap(spark, sf):
    return _cond(spark, sf, "gap", {"direction": "rises", "threshold": 0.3})


@query("c_rel_volume", _csql("CASE WHEN i >= 20 THEN volume / nullif(a, 0) > 1.5 END", "CASE WHEN i >= 20 THEN volume / nullif(a, 0) END",
                             "avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS a"))
def c_rel_volume(spark, sf):
    return _cond(spark, sf, "relative_volume", {"op": "above", "multiple": 1.5, "lookback": 20})


@query("c_rsi", _RSI + f" SELECT dn.symbol, dn.i, CASE WHEN dn.i >= 42 THEN v < 30 END AS holds, {r('v','value')} FROM dn LEFT JOIN rs USING (symbol, i)")
def c_rsi(spark, sf):
    return _cond(spark, sf, "rsi", {"op": "below", "level": 30, "period": 14})


@query("c_ma_position", _csql("CASE WHEN i >= 49 THEN close > a END", "CASE WHEN i >= 49 THEN close / a - 1 END",
                              "avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) AS a"))
def c_ma_position(spark, sf):
    return _cond(spark, sf, "ma_position", {"op": "above", "period": 50})


@query("c_ma_cross", V.sql("dn") + """, f AS (SELECT symbol, i, date, close, CASE WHEN i >= 49 THEN avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) END AS a FROM dn),
g AS (SELECT *, lag(close - a) OVER (PARTITION BY symbol ORDER BY date) AS b FROM f)
SELECT symbol, i, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN b <= 0 AND close - a > 0 END AS holds, """ + r("close / a - 1", "value") + " FROM g")
def c_ma_cross(spark, sf):
    return _cond(spark, sf, "ma_cross", {"op": "above", "period": 50})


@query("c_measures", V.sql("dn") + f""", f AS (SELECT *, close / lag(close, 5) OVER w - 1 AS m1, open / lag(close) OVER w - 1 AS m2,
  CASE WHEN i >= 49 THEN close / avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING) - 1 END AS m3 FROM dn {_W})
SELECT symbol, i, {r('m1','price_move')}, {r('m2','gap')}, {r('m3','ma_position')} FROM f WHERE m1 <= -0.05""")
def c_measures(spark, sf):
    ids = {"a": ("price_move", {"threshold": 5, "window": 5}), "b": ("gap", {}), "c": ("ma_position", {"period": 50})}
    df = C.evaluate(V.daily(spark, sf), ids).filter("a")
    df = df.withColumnsRenamed({"a_value": "price_move", "b_value": "gap", "c_value": "ma_position"})
    return _pick(df, "price_move", "gap", "ma_position", tidied=["price_move", "gap", "ma_position"])


# --- data quality --------------------------------------------------------------------------------------

_MOVES_BODY = """ok AS (SELECT * FROM dirty WHERE close > 0),
mv AS (SELECT *, close / lag(close) OVER w AS jump, lead(close) OVER w / lag(close) OVER w AS across, row_number() OVER w AS rn FROM ok WINDOW w AS (PARTITION BY symbol ORDER BY date)),
sm AS (SELECT mv.symbol, mv.date, min(s.ratio) AS sr FROM mv JOIN splits s ON s.symbol = mv.symbol AND abs(s.date - mv.date) <= 4 WHERE abs(jump - 1) > 0.4 AND abs(jump * s.ratio - 1) < 0.06 GROUP BY 1, 2),
fl AS (SELECT mv.*, sr, coalesce(abs(jump - 1) > 0.4, false) AS ext, coalesce(abs(jump - 1) > 0.4 AND sr IS NULL AND abs(across - 1) < 0.12, false) AS sp FROM mv LEFT JOIN sm USING (symbol, date)),
il AS (SELECT *, rn - row_number() OVER (PARTITION BY symbol, sp ORDER BY date) AS isl FROM fl),
po AS (SELECT *, sp AND row_number() OVER (PARTITION BY symbol, sp, isl ORDER BY date) % 2 = 1 AS bad FROM il),
cl AS (SELECT *, CASE WHEN NOT ext OR coalesce(lag(bad) OVER (PARTITION BY symbol ORDER BY date), false) THEN NULL WHEN sr IS NOT NULL THEN 'unadjusted_split' WHEN bad THEN 'spike_and_revert'
  WHEN abs(jump - 1) > 0.45 AND list_bool_or([abs(jump * q - 1) < 0.03 FOR q IN [2, 3, 4, 5, 8, 10, 15, 20, 1/2, 1/3, 1/4, 1/5, 1/8, 1/10, 1/15, 1/20]]) THEN 'possible_split' ELSE 'extreme_move' END AS chk FROM po)"""
_MOVES = V.sql("dirty", "splits") + ", " + _MOVES_BODY


def _classified(spark, sf):
    return Q.classify_moves(V.dirty(spark, sf), V.splits(spark, sf))


@query("dq_invalid", V.sql("dirty") + ' SELECT symbol, count(*) AS "rows", count(*) FILTER (NOT coalesce(close > 0, false)) AS invalid FROM dirty GROUP BY 1')
def dq_invalid(spark, sf):
    return Q.invalid_counts(V.dirty(spark, sf))


@query("dq_moves", _MOVES + f' SELECT symbol, CAST(date AS VARCHAR) AS date, chk AS "check", {r("jump - 1","move")} FROM cl WHERE chk IS NOT NULL')
def dq_moves(spark, sf):
    x = _classified(spark, sf).filter("check is not null")
    return x.select("symbol", F.col("date").cast("string").alias("date"), "check", tidy(F.col("jump") - 1).alias("move"))


@query("split_match", _MOVES + ' SELECT symbol, CAST(date AS VARCHAR) AS date, sr AS ratio FROM sm')
def split_match(spark, sf):
    x = _classified(spark, sf).filter("split_ratio is not null")
    return x.select("symbol", F.col("date").cast("string").alias("date"), F.col("split_ratio").alias("ratio"))


@query("back_adjust", _MOVES + f""", aj AS (SELECT *, exp(coalesce(sum(CASE WHEN chk = 'unadjusted_split' THEN ln(jump) ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)) AS f FROM cl)
SELECT symbol, CAST(date AS VARCHAR) AS date, {r('close * f','close',4)}, {r('volume / f','volume',4)} FROM aj WHERE chk IS NULL OR chk <> 'spike_and_revert'""")
def back_adjust(spark, sf):
    x = Q.adjust(_classified(spark, sf))
    return x.select("symbol", F.col("date").cast("string").alias("date"), tidy(F.col("close"), 4).alias("close"), tidy(F.col("volume"), 4).alias("volume"))


@query("dq_gaps", V.sql("dirty") + """, g AS (SELECT symbol, date, date - lag(date) OVER (PARTITION BY symbol ORDER BY date) AS gap_days FROM dirty)
SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(gap_days AS INTEGER) AS gap_days FROM g WHERE gap_days > 10""")
def dq_gaps(spark, sf):
    return Q.date_gaps(V.dirty(spark, sf)).withColumn("date", F.col("date").cast("string"))


@query("dq_stale", V.sql("dirty") + """, b AS (SELECT *, CASE WHEN coalesce(close = lag(close) OVER w AND volume = 0, false) THEN 0 ELSE 1 END AS br FROM dirty WINDOW w AS (PARTITION BY symbol ORDER BY date)),
k AS (SELECT *, sum(br) OVER (PARTITION BY symbol ORDER BY date) AS isl FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY symbol, isl ORDER BY date) AS pos FROM k)
SELECT symbol, CAST(date AS VARCHAR) AS date, close FROM p WHERE pos = 5""")
def dq_stale(spark, sf):
    return Q.stale_quotes(V.dirty(spark, sf)).withColumn("date", F.col("date").cast("string"))


@query("dq_volume_spike", V.sql("dirty") + f""", b AS (SELECT *, nullif(volume, 0) AS v, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM dirty),
m AS (SELECT *, count(v) OVER p AS n, quantile_cont(v, 0.5) OVER p AS md FROM b WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)),
k AS (SELECT symbol, date, v / md AS mult, row_number() OVER (PARTITION BY symbol ORDER BY v / md DESC, date DESC) AS rk FROM m WHERE rn > 50 AND n >= 30 AND md > 0 AND v IS NOT NULL AND v / md > 10)
SELECT symbol, CAST(date AS VARCHAR) AS date, {r('mult','multiple')}, CAST(rk AS INTEGER) AS rank FROM k""")
def dq_volume_spike(spark, sf):
    return Q.volume_spikes(V.dirty(spark, sf)).select("symbol", F.col("date").cast("string").alias("date"), tidy(F.col("multiple")).alias("multiple"), "rank")


@query("dq_ohlc", V.sql("dirty") + " SELECT symbol, count(*) FILTER (high < greatest(open, close) * (1 - 0.001) OR low > least(open, close) * (1 + 0.001)) AS inconsistent FROM dirty GROUP BY 1")
def dq_ohlc(spark, sf):
    return Q.ohlc_inconsistent(V.dirty(spark, sf))


@query("episode_flags", V.sql("dn", "dirty", "splits") + ", " + _FWD_BODY + ", " + _MOVES_BODY + """
SELECT o.symbol, o.i, count(chk) AS flags, coalesce(string_agg(DISTINCT chk, ',' ORDER BY chk), '') AS kinds FROM out o
  LEFT JOIN cl ON cl.symbol = o.symbol AND cl.date BETWEEN o.date AND o.exit_date AND chk IN ('extreme_move', 'possible_split') GROUP BY 1, 2""")
def episode_flags(spark, sf):
    issues = _classified(spark, sf).filter("check in ('extreme_move', 'possible_split')")
    return Q.episode_flags(_outcomes(spark, sf), issues)


# --- chart tables --------------------------------------------------------------------------------------

@query("weekly", V.sql("daily") + """ SELECT symbol, CAST(CAST(date_trunc('week', date) AS DATE) AS VARCHAR) AS week, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close, sum(volume) AS volume
FROM daily GROUP BY 1, 2""")
def weekly(spark, sf):
    return I.weekly(V.daily(spark, sf)).withColumn("week", F.col("week").cast("string"))


@query("chart_overlay", V.sql("dn") + f""", o AS (SELECT *, max(date) OVER (PARTITION BY symbol) AS mx, """ + ", ".join(
    f"CASE WHEN i >= {n - 1} THEN avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING) END AS s{n}" for n in (20, 50, 200)) +
    f""" FROM dn) SELECT symbol, CAST(date AS VARCHAR) AS date, close, {r('s20','sma_20')}, {r('s50','sma_50')}, {r('s200','sma_200')} FROM o WHERE date >= mx - 365""")
def chart_overlay(spark, sf):
    d = V.daily(spark, sf).withColumns({f"sma_{n}": I.sma(n) for n in (20, 50, 200)})
    d = I.slice_period(d, days=365)
    return d.select("symbol", F.col("date").cast("string").alias("date"), "close", *[tidy(F.col(f"sma_{n}")).alias(f"sma_{n}") for n in (20, 50, 200)])


@query("range_summary", V.sql("daily") + f""", m AS (SELECT *, max(date) OVER (PARTITION BY symbol) AS mx FROM daily)
SELECT symbol, arg_min(close, date) AS first, arg_max(close, date) AS last, max(high) AS high, min(low) AS low, sum(volume) AS volume, {r('arg_max(close, date) / arg_min(close, date) - 1','change')}
FROM m WHERE date >= mx - 90 GROUP BY 1""")
def range_summary(spark, sf):
    return I.range_summary(I.slice_period(V.daily(spark, sf), days=90)).withColumn("change", tidy(F.col("change")))


@query("momentum", V.sql("dn") + f""", x AS (SELECT *, close / lag(close) OVER w - 1 AS rr FROM dn {_W}),
y AS (SELECT *, close / lag(close, 63) OVER w - 1 AS a, close / lag(close, 126) OVER w - 1 AS b, close / lag(close, 252) OVER w - 1 AS c, stddev_pop(rr) OVER y AS vp, max(close) OVER y AS mx
  FROM x WINDOW w AS (PARTITION BY symbol ORDER BY date), y AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING))
SELECT symbol, CAST(date AS VARCHAR) AS date, {r('a','ret_63')}, {r('b','ret_126')}, {r('c','ret_252')}, {r('vp * sqrt(252)','vol_1y')}, {r('close / mx - 1','from_high')} FROM y WHERE i = n - 1""")
def momentum(spark, sf):
    m = I.momentum(V.daily(spark, sf))
    return m.select("symbol", F.col("date").cast("string").alias("date"), *[tidy(F.col(c)).alias(c) for c in m.columns[2:]])


@query("ingest_daily", """WITH RECURSIVE l AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, o_totalprice AS close, row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS rn FROM orders)
SELECT symbol, CAST(date AS VARCHAR) AS date, close FROM l WHERE rn = 1""")
def ingest_daily(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_totalprice").alias("close"), "o_orderkey")
    return Q.dedupe_last(o, "o_orderkey").withColumn("date", F.col("date").cast("string"))
