"""Ordered matching, forward outcomes and their statistics on detected events."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions.maths import tidy
from tidemark.operators import bars as B
from tidemark.operators import detectors as D
from tidemark.operators import ordered as O
from tidemark.operators import setups as P
from tidemark.plans import patterns as T
from tidemark.plans import views as V
from tidemark.plans.intraday import _PREV, STEP, reference_levels
from tidemark.plans.registry import query, r


def _sec(c, name=None):
    return F.unix_seconds(F.col(c)).alias(name or c)


def triggers(spark, sf):
    return V.stored("structure", spark, sf, T.structure_events).select("symbol", "bar_no", F.col("confirmed_at").alias("t"), "direction", "day")


def steps(spark, sf):
    """Displacement the same way within ten hours, before it a swing the same way in the same session."""
    disp = V.stored("displacements", spark, sf, T.displacements).select("symbol", F.col("confirmed_at").alias("t"), "direction")
    sw = V.stored("swings", spark, sf, T.swing_points).select("symbol", F.col("confirmed_at").alias("t"), F.when(F.col("kind") == "swingl", "bullish").otherwise("bearish").alias("direction"))
    return [P.Step("displacement", disp, "within", 600), P.Step("swing", sw, "session")]


_DAY_OF = lambda c: V.roll_weekend(f"(CAST({V._ET.format(f'{c} - INTERVAL 1 SECOND')} AS DATE) + CASE WHEN hour({V._ET.format(f'{c} - INTERVAL 1 SECOND')}) >= 18 THEN 1 ELSE 0 END)")
_BASE = V.sql("tr", "bars1h", "dlev", "hours", "dayb") + f""", {T._STRUCT}, dpx AS (SELECT *, high - low AS rng FROM ab WHERE NOT suspect AND close <> open AND a1 IS NOT NULL AND high > low AND high - low >= 1.5 * a1 AND abs(close - open) >= 0.6 * (high - low)
  AND CASE WHEN close > open THEN high - close ELSE close - low END <= 0.25 * (high - low)),
tg AS (SELECT symbol, j AS bar_no, ts + INTERVAL 1 HOUR AS t, dir, day FROM ms),
ev1 AS (SELECT symbol, ts + INTERVAL 1 HOUR AS t, CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END AS dir FROM dpx),
ev0 AS (SELECT symbol, ct + INTERVAL 1 HOUR AS t, CASE WHEN kind = 'swingl' THEN 'bullish' ELSE 'bearish' END AS dir FROM swg)"""


def _chain(src: str, out: str, relax1: str = "false", relax0: str = "false") -> str:
    return f"""{out}1 AS (SELECT g.*, (SELECT max(e.t) FROM ev1 e WHERE e.symbol = g.symbol AND e.dir = g.dir AND e.t <= g.t) AS p1 FROM {src} g),
{out}2 AS (SELECT *, coalesce(p1 >= t - INTERVAL 600 MINUTE, false) AS ok1, CASE WHEN coalesce(p1 >= t - INTERVAL 600 MINUTE, false) AND NOT {relax1} THEN p1 ELSE t END AS up FROM {out}1),
{out}3 AS (SELECT g.*, (SELECT max(e.t) FROM ev0 e WHERE e.symbol = g.symbol AND e.dir = g.dir AND e.t <= g.up) AS p0 FROM {out}2 g),
{out} AS (SELECT *, coalesce({_DAY_OF('p0')} = {_DAY_OF('t')}, false) AS ok0 FROM {out}3)"""


_MATCH = f"{_BASE}, {_chain('tg', 'mc')}"
_T = "CAST(epoch(t) AS BIGINT) AS t"


@query("setups", _MATCH + f" SELECT symbol, {_T}, dir AS direction, CAST(epoch(p1) AS BIGINT) AS at_displacement, CAST(epoch(p0) AS BIGINT) AS at_swing FROM mc WHERE ok1 AND ok0")
def setups(spark, sf):
    m = P.match_chain(triggers(spark, sf), steps(spark, sf)).filter("fails is null")
    return m.select("symbol", _sec("t"), "direction", _sec("at_displacement"), _sec("at_swing"))


@query("setup_chain", _MATCH + f" SELECT symbol, {_T}, dir AS direction, CAST(epoch(p1) AS BIGINT) AS at_displacement FROM mc WHERE ok1")
def setup_chain(spark, sf):
    """Two conditions: the trigger and the displacement before it."""
    m = P.match_chain(triggers(spark, sf), steps(spark, sf)[:1]).filter("fails is null")
    return m.select("symbol", _sec("t"), "direction", _sec("at_displacement"))


@query("why_not", _MATCH + f" SELECT symbol, {_T}, dir AS direction, ok1 AS ok_displacement, CAST(epoch(p1) AS BIGINT) AS at_displacement, ok0 AS ok_swing, CAST(epoch(p0) AS BIGINT) AS at_swing, CASE WHEN NOT ok1 THEN 'displacement' ELSE 'swing' END AS fails FROM mc WHERE NOT (ok1 AND ok0)")
def why_not(spark, sf):
    m = P.match_chain(triggers(spark, sf), steps(spark, sf)).filter("fails is not null")
    return m.select("symbol", _sec("t"), "direction", "ok_displacement", _sec("at_displacement"), "ok_swing", _sec("at_swing"), "fails")


def conditions(spark, sf):
    """An event, a lasting state and two checks: displacement within ten hours, an open gap the same way, price above the previous day's low, regular hours."""
    gaps = V.stored("gap_lives", spark, sf, T.lives).select("symbol", F.col("confirmed_at").alias("start"), F.col("end_at").alias("end"), "direction")
    levels = V.stored("reference_levels", spark, sf, lambda spark, sf: reference_levels(V.bars1h(spark, sf)))
    return [steps(spark, sf)[0], P.State("gap", gaps), P.LevelCheck("above_pdl", levels, "pdl"), P.ClockCheck("hours", 570, 960)]


# the gap tables under names of their own
_GAPS = re.sub(r"\b(lv|bt|fvg|g3|en|sk|iv|va|pj|l2)\b(?!\()", r"gap_\1", T._LIFE_T)
_COND = f"""{_BASE}, {_GAPS}, {_PREV},
d1 AS (SELECT g.*, (SELECT max(e.t) FROM ev1 e WHERE e.symbol = g.symbol AND e.dir = g.dir AND e.t <= g.t) AS p1 FROM tg g),
d2 AS (SELECT *, coalesce(p1 >= t - INTERVAL 600 MINUTE, false) AS ok1, CASE WHEN coalesce(p1 >= t - INTERVAL 600 MINUTE, false) THEN p1 ELSE t END AS up FROM d1),
d3 AS (SELECT d2.*, b.close, (SELECT max(l.ts + INTERVAL 1 HOUR) FROM lt l WHERE l.symbol = d2.symbol AND l.dir = d2.dir AND l.ts + INTERVAL 1 HOUR <= d2.up AND (l.end_t IS NULL OR epoch(d2.t) < l.end_t)) AS p0,
  (SELECT arg_max(l.price, l.af) FROM lv l WHERE l.symbol = d2.symbol AND l.kind = 'pdl' AND l.af <= d2.t AND d2.t < l.vu) AS pdl, {V._ET.format('d2.t - INTERVAL 1 SECOND')} AS et FROM d2 JOIN bars1h b ON b.symbol = d2.symbol AND b.bar_no = d2.bar_no),
cd AS (SELECT *, p0 IS NOT NULL AS ok0, coalesce(close > pdl, false) AS okl, hour(et) * 60 + minute(et) BETWEEN 570 AND 959 AS okh FROM d3)"""


@query("setup_conditions", _COND + f""" SELECT symbol, {_T}, dir AS direction, CAST(epoch(p1) AS BIGINT) AS at_displacement, ok1 AS ok_displacement, CAST(epoch(p0) AS BIGINT) AS at_gap, ok0 AS ok_gap, okl AS ok_above_pdl, okh AS ok_hours,
CASE WHEN NOT ok1 THEN 'displacement' WHEN NOT ok0 THEN 'gap' WHEN NOT okl THEN 'above_pdl' WHEN NOT okh THEN 'hours' END AS fails FROM cd""")
def setup_conditions(spark, sf):
    """Every trigger with the verdict of each condition and the first that failed."""
    bars = V.bars1h(spark, sf).select("symbol", "bar_no", "close")
    m = P.match_chain(triggers(spark, sf).join(bars, ["symbol", "bar_no"]), conditions(spark, sf))
    return m.select("symbol", _sec("t"), "direction", _sec("at_displacement"), "ok_displacement", _sec("at_gap"), "ok_gap", "ok_above_pdl", "ok_hours", "fails")


_FUN = """fn AS (SELECT symbol, 0 AS step, 'trigger' AS name, count(*) AS remaining FROM mc GROUP BY 1 UNION ALL SELECT symbol, 1, 'displacement', count(*) FILTER (ok1) FROM mc GROUP BY 1 UNION ALL
SELECT symbol, 2, 'swing', count(*) FILTER (ok1 AND ok0) FROM mc GROUP BY 1)"""


@query("funnel", _MATCH + f", {_FUN} SELECT * FROM fn")
def funnel(spark, sf):
    st = steps(spark, sf)
    return P.funnel(P.match_chain(triggers(spark, sf), st), st)


@query("diagnose", _MATCH + f""", {_FUN}, ls AS (SELECT *, lag(remaining) OVER (PARTITION BY symbol ORDER BY step) - remaining AS lost FROM fn), w AS (SELECT symbol, arg_max(name, (lost, -step)) AS name, max(lost) AS lost FROM ls WHERE lost IS NOT NULL GROUP BY 1),
dc AS (SELECT symbol, count(DISTINCT day) AS days FROM bars1h GROUP BY 1), {_PREV}, cv AS (SELECT symbol, count(DISTINCT day) AS covered FROM lv WHERE kind = 'pdh' GROUP BY 1)
SELECT symbol, name AS most_restrictive, lost, days, coalesce(covered, 0) AS covered, coalesce(covered, 0) < 0.6 * days AS thin_levels FROM w JOIN dc USING (symbol) LEFT JOIN cv USING (symbol)""")
def diagnose(spark, sf):
    st = steps(spark, sf)
    f = P.funnel(P.match_chain(triggers(spark, sf), st), st)
    b = V.bars1h(spark, sf)
    return P.diagnose(f, b, reference_levels(b).filter("kind = 'pdh'"))


@query("relax_counts", _BASE + f""", tm AS (SELECT tg.*, rx1, rx0 FROM tg, (VALUES (false, false), (true, false), (false, true), (true, true)) x(rx1, rx0)), {_chain('tm', 'rc', 'rx1')}
SELECT symbol, CASE WHEN rx1 AND rx0 THEN 'displacement,swing' WHEN rx1 THEN 'displacement' WHEN rx0 THEN 'swing' ELSE '' END AS dropped, count(*) FILTER ((ok1 OR rx1) AND (ok0 OR rx0)) AS remaining, count(*) AS triggers FROM rc GROUP BY 1, 2""")
def relax_counts(spark, sf):
    return P.relaxed(triggers(spark, sf), steps(spark, sf))


COMBOS = [(1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (2.0, 2.0)]


def entries(spark, sf):
    """Every structure break as a setup entered at its close with the ATR known there."""
    b = B.with_atr(V.bars1h(spark, sf)).select("symbol", "bar_no", F.col("close").alias("entry"), "atr")
    return triggers(spark, sf).join(b, ["symbol", "bar_no"]).filter("atr is not null")


def all_trades(spark, sf):
    return V.stored("trades", spark, sf, build_trades)


def trades(spark, sf):
    """Trades with an exit."""
    return all_trades(spark, sf).filter(F.col("reason") != P.OPEN)


def build_trades(spark, sf):
    return P.barrier_outcomes(entries(spark, sf).drop("day"), V.bars1h(spark, sf), STEP, COMBOS, cost=0.01)


_TRADES = f"""{_BASE}, en AS (SELECT g.*, b.close AS entry, b.atr FROM tg g JOIN tr b USING (symbol, bar_no) WHERE b.atr IS NOT NULL),
fw AS (SELECT e.symbol, e.bar_no, e.t, e.dir, e.entry, e.atr, b.bar_no - e.bar_no AS k, b.ts, b.day, b.suspect, b.open, b.high, b.low, b.close, arg_min(b.day, b.bar_no) OVER (PARTITION BY e.symbol, e.bar_no, e.dir) AS day0
  FROM en e JOIN bars1h b ON b.symbol = e.symbol AND b.bar_no BETWEEN e.bar_no + 1 AND e.bar_no + 12),
f2 AS (SELECT * REPLACE (first_value(day) OVER (PARTITION BY symbol, bar_no, dir ORDER BY k) AS day0), lag(close) OVER (PARTITION BY symbol, bar_no, dir ORDER BY k) AS pc, lag(ts) OVER (PARTITION BY symbol, bar_no, dir ORDER BY k) AS pt FROM fw),
cx AS (SELECT f2.*, sa, tr_, CASE WHEN dir = 'bullish' THEN 1.0 ELSE -1.0 END AS sg, atr * sa AS risk FROM f2, (VALUES (1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (2.0, 2.0)) c(sa, tr_) WHERE atr * sa > 0),
lx AS (SELECT *, entry - sg * risk AS st, entry + sg * tr_ * risk AS tgt FROM cx),
hx AS (SELECT *, day <> day0 AS hd, CASE WHEN sg > 0 THEN low <= st ELSE high >= st END AS hs, CASE WHEN sg > 0 THEN high >= tgt ELSE low <= tgt END AS ht, epoch(ts) + 3600 - epoch(t) >= 43200 AS hm FROM lx),
kx AS (SELECT symbol, bar_no, dir, sa, tr_, min(k) AS ek FROM hx WHERE hd OR hs OR ht OR hm GROUP BY ALL),
ex AS (SELECT h.*, CASE WHEN hd THEN 'end of trading day' WHEN hs THEN 'stop' WHEN ht THEN 'target' ELSE 'time exit' END AS reason FROM hx h JOIN kx ON kx.symbol = h.symbol AND kx.bar_no = h.bar_no AND kx.dir = h.dir AND kx.sa = h.sa AND kx.tr_ = h.tr_ AND h.k = kx.ek),
sx AS (SELECT e.symbol, e.bar_no, e.dir, e.sa, e.tr_, max(f.high) AS hi, min(f.low) AS lo, bool_or(f.suspect) AS sus FROM ex e JOIN f2 f ON f.symbol = e.symbol AND f.bar_no = e.bar_no AND f.dir = e.dir AND f.k <= CASE WHEN e.reason = 'end of trading day' THEN e.k - 1 ELSE e.k END GROUP BY ALL),
trd AS (SELECT e.symbol, e.bar_no, e.t, e.dir, e.sa, e.tr_, e.entry, e.risk, e.reason, CASE reason WHEN 'end of trading day' THEN pt ELSE ts END + INTERVAL 1 HOUR AS xt, s.sus, reason = 'stop' AND ht AS amb,
  CASE reason WHEN 'stop' THEN CASE WHEN sg * (open - st) <= 0 THEN open ELSE st END WHEN 'target' THEN CASE WHEN sg * (open - tgt) >= 0 THEN open ELSE tgt END WHEN 'end of trading day' THEN pc ELSE close END AS xp, sg,
  greatest(0, CASE WHEN sg > 0 THEN hi - entry ELSE entry - lo END) / risk AS mfe, greatest(0, CASE WHEN sg > 0 THEN entry - lo ELSE hi - entry END) / risk AS mae FROM ex e JOIN sx s ON s.symbol = e.symbol AND s.bar_no = e.bar_no AND s.dir = e.dir AND s.sa = e.sa AND s.tr_ = e.tr_),
tx AS (SELECT symbol, bar_no, t, dir AS direction, CAST(sa AS DOUBLE) AS stop_atr, CAST(tr_ AS DOUBLE) AS target_r, entry, risk, xp, xt, reason, (xp - entry) * sg AS points, ((xp - entry) * sg - 0.01) / risk AS r_net, (xp - entry) * sg / risk AS r_gross, mfe AS mfe_r, mae AS mae_r,
  (epoch(xt) - epoch(t)) / 60 AS minutes, hour({V._ET.format('t')}) AS hour, isodow({V._ET.format('t')}) - 1 AS weekday, amb AS ambiguous, sus AS suspect FROM trd),
opn AS (SELECT e.*, CAST(sa AS DOUBLE) AS stop_atr, CAST(tr_ AS DOUBLE) AS target_r FROM en e, (VALUES (1.0, 1.0), (1.0, 2.0), (2.0, 1.0), (2.0, 2.0)) c(sa, tr_) WHERE atr * sa > 0 AND NOT EXISTS (SELECT 1 FROM trd x WHERE x.symbol = e.symbol AND x.bar_no = e.bar_no AND x.dir = e.dir AND x.sa = c.sa AND x.tr_ = c.tr_)),
txa AS (SELECT * FROM tx UNION ALL SELECT symbol, bar_no, t, dir, stop_atr, target_r, entry, atr * stop_atr, NULL, NULL, 'open', NULL, NULL, NULL, NULL, NULL, NULL, hour({V._ET.format('t')}), isodow({V._ET.format('t')}) - 1, false, false FROM opn)"""


@query("barrier_outcome", _TRADES + f" SELECT symbol, {_T}, direction, stop_atr, target_r, {r('entry','entry')}, {r('xp','exit')}, CAST(epoch(xt) AS BIGINT) AS exit_time, reason, {r('r_net','r_net',4)}, {r('mfe_r','mfe_r',4)}, {r('mae_r','mae_r',4)}, {r('minutes','minutes')}, ambiguous, suspect FROM txa")
def barrier_outcome(spark, sf):
    x = build_trades(spark, sf)
    return x.select("symbol", _sec("t"), "direction", "stop_atr", "target_r", tidy(F.col("entry")).alias("entry"), tidy(F.col("exit")).alias("exit"), _sec("exit_time"), "reason",
                    *[tidy(F.col(c), 4).alias(c) for c in ("r_net", "mfe_r", "mae_r")], tidy(F.col("minutes")).alias("minutes"), "ambiguous", "suspect")


_MET = ["win_rate", "expectancy", "median", "std", "avg_win", "avg_loss", "gross_mean", "profit_factor", "sharpe_like", "sortino_like", "holding_mean", "mfe_mean", "mae_mean"]


def _met_sql(keys: str) -> str:
    return f"""met AS (SELECT {keys}, count(*) FILTER (NOT suspect AND reason <> 'open') AS n, count(*) FILTER (suspect) AS excluded_suspect, count(*) FILTER (reason = 'open') AS open_at_end, count(*) FILTER (NOT suspect AND r_net > 0) AS wins, count(*) FILTER (NOT suspect AND r_net < 0) AS losses, avg(r_net) FILTER (NOT suspect) AS expectancy,
  quantile_cont(r_net, 0.5) FILTER (NOT suspect) AS median, stddev_samp(r_net) FILTER (NOT suspect) AS std, avg(r_net) FILTER (NOT suspect AND r_net > 0) AS avg_win, avg(r_net) FILTER (NOT suspect AND r_net < 0) AS avg_loss, avg(r_gross) FILTER (NOT suspect) AS gross_mean,
  sum(r_net) FILTER (NOT suspect AND r_net > 0) / -sum(r_net) FILTER (NOT suspect AND r_net < 0) AS profit_factor, sqrt(avg(least(r_net, 0) ** 2) FILTER (NOT suspect)) AS dd, avg(minutes) FILTER (NOT suspect) AS holding_mean, avg(mfe_r) FILTER (NOT suspect) AS mfe_mean,
  avg(mae_r) FILTER (NOT suspect) AS mae_mean FROM txa GROUP BY {keys} HAVING count(*) FILTER (NOT suspect AND reason <> 'open') > 0),
m2 AS (SELECT *, wins / n AS win_rate, CASE WHEN n >= 10 AND std > 0 THEN expectancy / std END AS sharpe_like, CASE WHEN n >= 10 AND std > 0 THEN expectancy / nullif(dd, 0) END AS sortino_like FROM met)"""


@query("trade_metrics", _TRADES + f", {_met_sql('symbol, stop_atr, target_r')} SELECT symbol, stop_atr, target_r, n, excluded_suspect, open_at_end, wins, losses, " + ", ".join(r(c, c, 5) for c in _MET) + " FROM m2")
def trade_metrics(spark, sf):
    m = P.trade_metrics(all_trades(spark, sf), ["symbol", "stop_atr", "target_r"])
    return m.withColumns({c: tidy(F.col(c), 5) for c in _MET})


@query("combo_matrix", _TRADES + f", {_met_sql('stop_atr, target_r')} SELECT stop_atr, target_r, n, {r('win_rate','win_rate',5)}, {r('expectancy','expectancy',5)}, {r('profit_factor','profit_factor',5)} FROM m2")
def combo_matrix(spark, sf):
    m = P.trade_metrics(all_trades(spark, sf), ["stop_atr", "target_r"]).select("stop_atr", "target_r", "n", "win_rate", "expectancy", "profit_factor")
    return m.withColumns({c: tidy(F.col(c), 5) for c in ("win_rate", "expectancy", "profit_factor")})


@query("compare_versions", _TRADES + f", {_met_sql('symbol, stop_atr')} SELECT symbol, any_value(n) FILTER (stop_atr = 1) AS n_tight, any_value(n) FILTER (stop_atr = 2) AS n_wide, {r('any_value(expectancy) FILTER (stop_atr = 1)','expectancy_tight',5)}, {r('any_value(expectancy) FILTER (stop_atr = 2)','expectancy_wide',5)} FROM m2 GROUP BY 1")
def compare_versions(spark, sf):
    m = P.trade_metrics(all_trades(spark, sf), ["symbol", "stop_atr"])
    v = m.withColumn("version", F.when(F.col("stop_atr") == 1.0, "tight").otherwise("wide"))
    p = v.groupBy("symbol").pivot("version", ["tight", "wide"]).agg(F.first("n").alias("n"), F.first("expectancy").alias("expectancy"))
    return p.select("symbol", F.col("tight_n").alias("n_tight"), F.col("wide_n").alias("n_wide"), tidy(F.col("tight_expectancy"), 5).alias("expectancy_tight"), tidy(F.col("wide_expectancy"), 5).alias("expectancy_wide"))


@query("by_hour_reason", _TRADES + f""", gs AS (SELECT symbol, hour, weekday, reason, count(*) AS n, avg(r_net) AS mean, count(*) FILTER (r_net > 0) / count(*) AS wr FROM tx WHERE NOT suspect GROUP BY GROUPING SETS ((symbol, hour), (symbol, weekday), (symbol, reason)))
SELECT symbol, CASE WHEN hour IS NOT NULL THEN 'hour' WHEN weekday IS NOT NULL THEN 'weekday' ELSE 'reason' END AS field, coalesce(CAST(hour AS VARCHAR), CAST(weekday AS VARCHAR), reason) AS value, n, {r('mean','mean',5)}, {r('wr','win_rate',5)} FROM gs""")
def by_hour_reason(spark, sf):
    return P.grouped_results(trades(spark, sf)).withColumns({c: tidy(F.col(c), 5) for c in ("mean", "win_rate")})


_ORD = "PARTITION BY symbol, stop_atr, target_r ORDER BY t, direction"


def _ordered_trades(spark, sf):
    return trades(spark, sf).withColumn("day", F.to_date("t"))


@query("streaks", _TRADES + f""", sg1 AS (SELECT *, sign(r_net) AS s FROM tx WHERE NOT suspect), bk1 AS (SELECT *, CASE WHEN s IS NOT DISTINCT FROM lag(s) OVER ({_ORD}) THEN 0 ELSE 1 END AS nw FROM sg1), rn1 AS (SELECT *, sum(nw) OVER ({_ORD}) AS run FROM bk1),
ln AS (SELECT symbol, stop_atr, target_r, run, s, count(*) AS len FROM rn1 GROUP BY ALL) SELECT symbol, stop_atr, target_r, coalesce(max(len) FILTER (s > 0), 0) AS max_wins, coalesce(max(len) FILTER (s < 0), 0) AS max_losses FROM ln GROUP BY 1, 2, 3""")
def streaks(spark, sf):
    return P.streaks(_ordered_trades(spark, sf), ["symbol", "stop_atr", "target_r"], ["t", "direction"], "day")


@query("cum_drawdown", _TRADES + f""", eq1 AS (SELECT *, sum(r_net) OVER ({_ORD}) AS equity FROM tx WHERE NOT suspect), pk1 AS (SELECT *, max(equity) OVER ({_ORD}) AS peak FROM eq1)
SELECT symbol, stop_atr, target_r, {r('least(min(equity - greatest(peak, 0)), 0)','max_drawdown',5)}, {r('sum(r_net)','total',5)} FROM pk1 GROUP BY 1, 2, 3""")
def cum_drawdown(spark, sf):
    x = P.cumulative_drawdown(_ordered_trades(spark, sf), ["symbol", "stop_atr", "target_r"], ["t", "direction"], "day")
    return x.withColumns({c: tidy(F.col(c), 5) for c in ("max_drawdown", "total")})


@query("mid_rank", _TRADES + f""", g AS (SELECT stop_atr, target_r, count(*) AS n, (count(*) FILTER (r_net < 0.5) + 0.5 * count(*) FILTER (r_net = 0.5)) / count(*) AS p FROM tx WHERE NOT suspect GROUP BY 1, 2)
SELECT stop_atr, target_r, n, {r('p','percentile')}, CASE WHEN n < 10 THEN 'too few' WHEN p >= 0.9 THEN 'unusually strong' WHEN p <= 0.1 THEN 'unusually weak' ELSE 'usual range' END AS verdict FROM g""")
def mid_rank(spark, sf):
    return P.mid_rank(trades(spark, sf), ["stop_atr", "target_r"], 0.5).withColumn("percentile", tidy(F.col("percentile")))


@query("half_r_bins", _TRADES + " SELECT stop_atr, target_r, least(greatest(round_even(r_net * 2, 0) / 2, -3.0), 5.0)::DOUBLE + 0.0 AS bin, count(*) AS n FROM tx WHERE NOT suspect GROUP BY 1, 2, 3")
def half_r_bins(spark, sf):
    return P.half_r_bins(trades(spark, sf), ["stop_atr", "target_r"])


@query("reject_counts", _TRADES + """, sq1 AS (SELECT e.symbol, CASE WHEN e.dir = 'bullish' THEN 1 ELSE -1 END * (e.entry - CASE WHEN e.dir = 'bullish' THEN b.low ELSE b.high END) AS risk FROM en e JOIN bars1h b USING (symbol, bar_no))
SELECT symbol, CASE WHEN risk <= 0 THEN 'stop on the wrong side' WHEN risk < 0.2 - 1e-9 THEN 'risk too small' ELSE 'accepted' END AS reject_reason, count(*) AS n FROM sq1 GROUP BY 1, 2""")
def reject_counts(spark, sf):
    b = V.bars1h(spark, sf).select("symbol", "bar_no", "high", "low")
    e = entries(spark, sf).join(b, ["symbol", "bar_no"]).withColumn("stop", F.when(F.col("direction") == "bullish", F.col("low")).otherwise(F.col("high")))
    return P.reject_counts(e, 0.05, "stop")


@query("nearest_target", _TRADES + f""", {_PREV} SELECT e.symbol, CAST(epoch(e.t) AS BIGINT) AS t, e.dir AS direction, any_value(e.entry) AS entry, CASE WHEN e.dir = 'bullish' THEN min(l.price) ELSE max(l.price) END AS target FROM en e LEFT JOIN lv l ON l.symbol = e.symbol AND l.af <= e.t AND e.t < l.vu
  AND CASE WHEN e.dir = 'bullish' THEN l.price > e.entry AND l.kind IN ('pdh', 'onh') ELSE l.price < e.entry AND l.kind IN ('pdl', 'onl') END GROUP BY e.symbol, e.t, e.dir""")
def nearest_target(spark, sf):
    e = entries(spark, sf).select("symbol", "t", "direction", "entry", P.trading_day_of(F.col("t")).alias("day"))
    return P.nearest_target(e, reference_levels(V.bars1h(spark, sf))).select("symbol", _sec("t"), "direction", "entry", "target")
