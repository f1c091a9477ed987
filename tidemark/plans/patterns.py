"""Event detectors on hourly candles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.maths import tidy
from tidemark.operators import bars as B
from tidemark.operators import definitions as DEF
from tidemark.operators import detectors as D
from tidemark.operators import ordered as O
from tidemark.plans import views as V
from tidemark.plans.intraday import _OR, _PREV, _VW, STEP, reference_levels
from tidemark.plans.registry import query, r

TICK = 0.01


def market(spark, sf, **more):
    return DEF.Market(V.bars1h(spark, sf), STEP, TICK, **more)


def _events(spark, sf, concept, **params):
    return DEF.events(market(spark, sf), concept, params)


def _out(df, *extra, tidied=()):
    cols = ["symbol", "direction", F.unix_seconds("occurred_at").alias("occurred_at"), F.unix_seconds("confirmed_at").alias("confirmed_at"), F.col("day").cast("string").alias("day")]
    return df.select(*cols, *extra, *[tidy(F.col(c)).alias(c) for c in tidied])


def _ev(direction: str, start: str, end: str, day: str = "day") -> str:
    """Common event columns in SQL; ``end`` is the open of the confirming bar."""
    return f"symbol, {direction} AS direction, CAST(epoch({start}) AS BIGINT) AS occurred_at, CAST(epoch({end}) AS BIGINT) + {STEP} AS confirmed_at, CAST({day} AS VARCHAR) AS day"


_SELL_DIR = "CASE WHEN sell THEN 'bullish' ELSE 'bearish' END"
_UPDN = "CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END"

_FVG = f"""g3 AS (SELECT *, lag(high, 2) OVER d AS h1, lag(low, 2) OVER d AS l1, lag(ts, 2) OVER d AS t1, suspect OR after_gap OR lag(suspect) OVER d OR lag(after_gap) OVER d OR lag(suspect, 2) OVER d OR lag(after_gap, 2) OVER d AS dirty
  FROM bars1h WINDOW d AS (PARTITION BY symbol, day ORDER BY ts)),
fvg AS (SELECT symbol, CASE WHEN h1 < low THEN 'bullish' ELSE 'bearish' END AS dir, t1, ts, day, bar_no, regime, CASE WHEN h1 < low THEN low ELSE l1 END AS top, CASE WHEN h1 < low THEN h1 ELSE high END AS bottom
  FROM g3 WHERE epoch(ts) - epoch(t1) = 7200 AND (h1 < low OR l1 > high) AND NOT dirty)"""


def fvgs(spark, sf):
    return D.fvg(V.bars1h(spark, sf).withColumn("atr", F.lit(None).cast("double")), STEP)


@query("fvg_create", V.sql("bars1h") + f", {_FVG} SELECT {_ev('dir', 't1', 'ts')}, top, bottom, {r('top - bottom','size')} FROM fvg")
def fvg_create(spark, sf):
    return _out(fvgs(spark, sf), "top", "bottom", tidied=["size"])


@query("fvg_displaced", V.sql("tr") + f""", g3 AS (SELECT *, lag(high, 2) OVER d AS h1, lag(low, 2) OVER d AS l1, lag(ts, 2) OVER d AS t1, lag(high) OVER d - lag(low) OVER d AS rng, abs(lag(close) OVER d - lag(open) OVER d) AS body, lag(atr) OVER d AS a2, lag(atr, 2) OVER d AS a1,
  suspect OR after_gap OR lag(suspect) OVER d OR lag(after_gap) OVER d OR lag(suspect, 2) OVER d OR lag(after_gap, 2) OVER d AS dirty FROM tr WINDOW d AS (PARTITION BY symbol, day ORDER BY ts)),
fvg AS (SELECT *, CASE WHEN h1 < low THEN 'bullish' ELSE 'bearish' END AS dir, CASE WHEN h1 < low THEN low - h1 ELSE l1 - high END AS size FROM g3 WHERE epoch(ts) - epoch(t1) = 7200 AND (h1 < low OR l1 > high) AND NOT dirty)
SELECT {_ev('dir', 't1', 'ts')}, {r('size','size')} FROM fvg WHERE size >= 0.3 * a2 AND rng > 0 AND body / rng >= 0.6 AND rng >= 0.8 * a1""")
def fvg_displaced(spark, sf):
    return _out(_events(spark, sf, "fvg", min_gap=0.3, min_gap_unit="ATR", require_displacement=True, displacement_atr=0.8), tidied=["size"])


_LIFE = f"""{_FVG}, pj AS (SELECT f.symbol, f.bar_no, f.dir = 'bullish' AS bull, f.top, f.bottom, (f.top + f.bottom) / 2 AS mid, f.day, f.regime, b.bar_no - f.bar_no AS k, b.ts, b.day AS bd, b.regime AS br, b.suspect, b.high, b.low, b.close
  FROM fvg f JOIN bars1h b ON b.symbol = f.symbol AND b.bar_no BETWEEN f.bar_no + 1 AND f.bar_no + 49),
sk AS (SELECT symbol, bar_no, min(k) AS stop_k, arg_min(CASE WHEN bd <> day THEN 'session ended' WHEN k > 48 THEN 'age limit' WHEN br <> regime THEN 'contract roll' ELSE 'suspect data' END, k) AS why FROM pj WHERE bd <> day OR k > 48 OR br <> regime OR suspect GROUP BY 1, 2),
lv AS (SELECT p.*, sk.stop_k, sk.why FROM pj p LEFT JOIN sk USING (symbol, bar_no) WHERE stop_k IS NULL OR k < stop_k),
iv AS (SELECT symbol, bar_no, min(k) AS inv_k FROM lv WHERE CASE WHEN bull THEN close < bottom ELSE close > top END GROUP BY 1, 2),
l2 AS (SELECT lv.*, inv_k FROM lv LEFT JOIN iv USING (symbol, bar_no) WHERE inv_k IS NULL OR k <= inv_k),
en AS (SELECT symbol, bar_no, min(k) FILTER (CASE WHEN bull THEN low <= top ELSE high >= bottom END) AS ent_k, min(k) FILTER (CASE WHEN bull THEN low < top ELSE high > bottom END) AS par_k,
  min(k) FILTER (CASE WHEN bull THEN (top - low) / (top - bottom) >= 0.5 ELSE (high - bottom) / (top - bottom) >= 0.5 END) AS half_k, min(k) FILTER (CASE WHEN bull THEN (top - low) / (top - bottom) >= 1 ELSE (high - bottom) / (top - bottom) >= 1 END) AS full_k FROM l2 GROUP BY 1, 2),
va AS (SELECT l2.symbol, l2.bar_no, min(k) AS val_k FROM l2 JOIN en USING (symbol, bar_no) WHERE k >= ent_k AND (inv_k IS NULL OR k < inv_k) AND CASE WHEN bull THEN close > top ELSE close < bottom END GROUP BY 1, 2),
life AS (SELECT f.symbol, f.dir, f.bar_no, f.t1, f.ts, f.day, ent_k, par_k, half_k, full_k, val_k, inv_k, CASE WHEN inv_k IS NULL AND why IN ('session ended', 'age limit') THEN stop_k - 1 END AS exp_k,
  CASE WHEN inv_k IS NOT NULL THEN inv_k WHEN stop_k IS NOT NULL THEN stop_k - 1 END AS end_k, CASE WHEN inv_k IS NOT NULL THEN 'invalidated' ELSE coalesce(why, 'data ended') END AS reason
  FROM fvg f LEFT JOIN sk USING (symbol, bar_no) LEFT JOIN iv USING (symbol, bar_no) LEFT JOIN en USING (symbol, bar_no) LEFT JOIN va USING (symbol, bar_no)),
bt AS (SELECT symbol, bar_no, CAST(epoch(ts) AS BIGINT) + 3600 AS ct FROM bars1h)"""
_K = ["ent", "par", "half", "full", "val", "inv", "exp", "end"]
_LIFE_T = _LIFE + """, lt AS (SELECT l.*, """ + ", ".join(f"b_{k}.ct AS {k}_t" for k in _K) + " FROM life l " + " ".join(
    f"LEFT JOIN bt b_{k} ON b_{k}.symbol = l.symbol AND b_{k}.bar_no = l.bar_no + l.{k}_k" for k in _K) + ")"


def lives(spark, sf):
    return D.fvg_states(fvgs(spark, sf), V.bars1h(spark, sf), STEP)


@query("fvg_states", V.sql("bars1h") + f", {_LIFE_T} SELECT {_ev('dir', 't1', 'ts')}, ent_t AS entered, par_t AS partial, half_t AS half, full_t AS \"full\", val_t AS validated, inv_t AS invalidated, exp_t AS expired, end_t AS ended, reason FROM lt")
def fvg_states(spark, sf):
    g = lives(spark, sf)
    return _out(g, *[F.unix_seconds(f"{m}_at").alias(m) for m in D.MARKS], F.unix_seconds("end_at").alias("ended"), F.col("end_reason").alias("reason"))


@query("fvg_state_at", V.sql("bars1h") + f""", {_LIFE_T}, tq AS (SELECT *, CAST(epoch(ts) AS BIGINT) + 3600 + 4 * 3600 AS t FROM lt),
st AS (SELECT *, list_filter([{{'tm': CAST(epoch(ts) AS BIGINT) + 3600, 'o': -1, 'n': 'created'}}, {{'tm': ent_t, 'o': 0, 'n': 'entered'}}, {{'tm': par_t, 'o': 1, 'n': 'partial'}}, {{'tm': half_t, 'o': 2, 'n': 'half'}}, {{'tm': full_t, 'o': 3, 'n': 'full'}},
  {{'tm': val_t, 'o': 4, 'n': 'validated'}}, {{'tm': inv_t, 'o': 5, 'n': 'invalidated'}}, {{'tm': exp_t, 'o': 6, 'n': 'expired'}}], lambda s: s.tm <= t) AS s FROM tq), cu AS (SELECT *, list_sort(s)[-1].n AS c FROM st)
SELECT {_ev('dir', 't1', 'ts')}, CASE WHEN end_t IS NOT NULL AND t >= end_t AND c NOT IN ('invalidated', 'expired') THEN 'ended' ELSE c END AS state FROM cu""")
def fvg_state_at(spark, sf):
    g = lives(spark, sf)
    t = F.col("confirmed_at") + B.seconds_interval(4 * STEP)
    return _out(g.withColumn("state", D.fvg_state_at(F.col("states"), F.col("end_at"), t)), "state")


_SW = """sw0 AS (SELECT *, lead(ts, 3) OVER d AS ct, count(*) OVER s AS c, bool_or(suspect) OVER s AS sus, min(regime) OVER s = max(regime) OVER s AS one, max(high) OVER p AS hp, max(high) OVER n AS hn, min(low) OVER p AS lp, min(low) OVER n AS ln FROM bars1h
  WINDOW d AS (PARTITION BY symbol, day ORDER BY ts), s AS (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), p AS (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), n AS (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
swg AS (SELECT symbol, 'swingh' AS kind, high AS price, ts, ct, bar_no, regime, day FROM sw0 WHERE c = 7 AND NOT sus AND one AND high > hp AND high > hn UNION ALL
  SELECT symbol, 'swingl', low, ts, ct, bar_no, regime, day FROM sw0 WHERE c = 7 AND NOT sus AND one AND low < lp AND low < ln)"""


def swing_points(spark, sf):
    return D.swings(V.bars1h(spark, sf), STEP)


@query("swings", V.sql("bars1h") + f", {_SW} SELECT {_ev('kind', 'ts', 'ct')}, price, bar_no FROM swg")
def swings(spark, sf):
    return _out(swing_points(spark, sf).withColumn("direction", F.col("kind")), "price", "bar_no")


_EQ = """eq AS (SELECT p.symbol, CASE p.kind WHEN 'swingh' THEN 'eqh' ELSE 'eql' END AS kind, CASE p.kind WHEN 'swingh' THEN max(q.price) ELSE min(q.price) END AS price, min(q.ts) AS ts, p.ct, count(*) AS touches, p.day, p.bar_no
  FROM swg p JOIN swg q ON q.symbol = p.symbol AND q.kind = p.kind AND q.bar_no <= p.bar_no AND p.bar_no - q.bar_no <= 50 AND abs(q.price - p.price) <= 0.05 + 1e-9 GROUP BY p.symbol, p.kind, p.ct, p.day, p.bar_no HAVING count(*) >= 2)"""


@query("equal_levels", V.sql("bars1h") + f", {_SW}, {_EQ} SELECT {_ev('kind', 'ts', 'ct')}, price, touches FROM eq")
def equal_levels(spark, sf):
    return _out(D.equal_levels(swing_points(spark, sf), 0.05).withColumn("direction", F.col("kind")), "price", "touches")


_SWEEP = f"""{_PREV}, {_SW},
sl AS (SELECT symbol, kind, price, ct + INTERVAL 1 HOUR AS af, {V.roll_weekend('(CAST(et AS DATE) + CASE WHEN hour(et) >= 18 THEN 1 ELSE 0 END)')} AS d FROM (SELECT *, {V._ET.format('ct + INTERVAL 1 HOUR')} AS et FROM swg)),
lvs AS (SELECT symbol, kind, price, af, vu FROM lv UNION ALL SELECT symbol, kind, price, af, {V.clock('d', '17:00')} + CASE dayofweek(d) WHEN 5 THEN INTERVAL 72 HOUR ELSE INTERVAL 24 HOUR END FROM sl),
lp AS (SELECT l.*, kind IN ('pdl', 'onl', 'swingl') AS sell, p.close AS pc, p.bar_no AS pn, r.regime AS lr FROM lvs l ASOF JOIN (SELECT *, ts + INTERVAL 1 HOUR AS cl FROM bars1h) p ON p.symbol = l.symbol AND l.af >= p.cl
  ASOF JOIN bars1h r ON r.symbol = l.symbol AND l.af >= r.ts),
ok AS (SELECT * FROM lp WHERE NOT (CASE WHEN sell THEN pc <= price ELSE pc >= price END)),
tc AS (SELECT o.symbol, o.kind, o.price, o.af, o.vu, o.lr, o.sell, min(b.bar_no) AS j FROM ok o JOIN bars1h b ON b.symbol = o.symbol AND b.bar_no > o.pn AND b.ts + INTERVAL 1 HOUR <= o.vu AND b.regime = o.lr
  AND CASE WHEN sell THEN b.low <= o.price - 0.02 ELSE b.high >= o.price + 0.02 END GROUP BY ALL),
sq AS (SELECT t.*, b.bar_no - t.j AS k, b.ts, b.day, b.high, b.low, b.close, b.suspect OR b.regime <> t.lr AS bad FROM tc t JOIN bars1h b ON b.symbol = t.symbol AND b.bar_no BETWEEN t.j AND t.j + 2),
cf AS (SELECT symbol, kind, price, af, vu, sell, j, min(k) FILTER (bad) AS bk, min(k) FILTER (CASE WHEN sell THEN close > price ELSE close < price END) AS ck FROM sq GROUP BY ALL),
fin AS (SELECT c.symbol, c.kind, c.price, c.af, c.sell, arg_min(s.ts, s.k) AS o, arg_max(s.ts, s.k) AS e, arg_max(s.day, s.k) AS day, CASE WHEN c.sell THEN min(s.low) ELSE max(s.high) END AS ex FROM cf c JOIN sq s ON s.symbol = c.symbol AND s.kind = c.kind AND s.price = c.price AND s.af = c.af AND s.vu = c.vu AND s.k <= c.ck
  WHERE c.ck IS NOT NULL AND (c.bk IS NULL OR c.ck < c.bk) GROUP BY c.symbol, c.kind, c.price, c.af, c.sell, c.vu)"""


def all_levels(spark, sf):
    ref = reference_levels(V.bars1h(spark, sf)).select("symbol", "kind", "price", "available_from", "valid_until")
    return ref.unionByName(D.swing_levels(swing_points(spark, sf)))


def sweep_events(spark, sf):
    return DEF.events(market(spark, sf, levels=all_levels(spark, sf)), "liquidity_sweep")


@query("sweeps", V.sql("dlev", "hours", "dayb", "bars1h") + f", {_SWEEP} SELECT {_ev(_SELL_DIR, 'o', 'e')}, kind AS level_kind, price AS level_price, ex AS extreme, round_even(abs(ex - price) / 0.01, 0) AS penetration FROM fin")
def sweeps(spark, sf):
    return _out(sweep_events(spark, sf), "level_kind", "level_price", "extreme", "penetration")


@query("session_sweeps", V.sql("bars1h") + f""", s0 AS (SELECT *, min(low) OVER p AS lvl, count(*) OVER p AS n, [suspect, lead(suspect, 1) OVER d, lead(suspect, 2) OVER d] AS ss, [close, lead(close, 1) OVER d, lead(close, 2) OVER d] AS cs,
  [low, lead(low, 1) OVER d, lead(low, 2) OVER d] AS ls, [ts, lead(ts, 1) OVER d, lead(ts, 2) OVER d] AS tss FROM bars1h WINDOW d AS (PARTITION BY symbol, day ORDER BY ts), p AS (PARTITION BY symbol, day ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s1 AS (SELECT *, CASE WHEN cs[1] > lvl THEN 1 WHEN cs[2] > lvl AND NOT ss[2] THEN 2 WHEN cs[3] > lvl AND NOT ss[2] AND NOT ss[3] THEN 3 END AS k FROM s0 WHERE n >= 6 AND NOT suspect AND low <= lvl - 0.02)
SELECT {_ev("'bullish'", 'ts', 'tss[k]')}, lvl AS level_price, list_min(ls[1:k]) AS extreme FROM s1 WHERE k IS NOT NULL""")
def session_sweeps(spark, sf):
    return _out(_events(spark, sf, "session_sweep", warmup=6), "level_price", "extreme")


_AB = "ab AS (SELECT *, lag(atr) OVER (PARTITION BY symbol ORDER BY ts) AS a1 FROM tr)"
_DISP = f"""{_AB}, dp AS (SELECT *, high - low AS rng FROM ab WHERE NOT suspect AND close <> open AND a1 IS NOT NULL AND high > low AND high - low >= 1.5 * a1 AND abs(close - open) >= 0.6 * (high - low)
  AND CASE WHEN close > open THEN high - close ELSE close - low END <= 0.25 * (high - low))"""


def displacements(spark, sf):
    return _events(spark, sf, "displacement")


@query("displacement", V.sql("tr") + f", {_DISP} SELECT {_ev(_UPDN, 'ts', 'ts')}, {r('rng','size')}, {r('a1','atr')} FROM dp")
def displacement(spark, sf):
    return _out(displacements(spark, sf), tidied=["size", "atr"])


def _runs_sql(size: float, body: float, near: float, more: str = "true", late: str = "false") -> str:
    """Two-candle displacements taken left to right; ``late`` tells which are confirmed one candle later."""
    return f"""{_AB}, w2 AS (SELECT *, lag(ts) OVER d AS t0, lead(ts) OVER d AS tn, greatest(high, lag(high) OVER d) AS hi, least(low, lag(low) OVER d) AS lo, lag(open) OVER d AS o0, lag(close) OVER d AS c0, lag(a1) OVER d AS aa, lag(high) OVER d AS hp, lag(low) OVER d AS lp, lag(high, 2) OVER d AS h2, lag(low, 2) OVER d AS l2,
  lead(low) OVER d AS ln, lead(high) OVER d AS hn, volume + lag(volume) OVER d AS vol, NOT suspect AND coalesce(lag(run) OVER d = run, false) AND NOT coalesce(lag(suspect) OVER d, false) AS two,
  NOT suspect AND coalesce(lag(run, 2) OVER d = run, false) AND NOT coalesce(lag(suspect, 2) OVER d, false) AND coalesce(lead(run) OVER d = run, false) AND NOT coalesce(lead(suspect) OVER d, true) AS wide,
  CASE WHEN count(nullif(volume, 0)) OVER v >= 5 THEN avg(nullif(volume, 0)) OVER v END AS va FROM ab WINDOW d AS (PARTITION BY symbol, day ORDER BY ts), v AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 11 PRECEDING AND 2 PRECEDING)),
w3 AS (SELECT *, close > open AS up, hi - lo AS rng, CASE WHEN close > open THEN h2 < low ELSE l2 > high END AS early, CASE WHEN close > open THEN hp < ln ELSE lp > hn END AS late FROM w2 WHERE two AND ((close > open AND c0 > o0) OR (close < open AND c0 < o0))),
w4 AS (SELECT *, row_number() OVER (PARTITION BY symbol, day ORDER BY bar_no) AS rn FROM w3 WHERE aa IS NOT NULL AND rng > 0 AND rng >= {size} * aa AND abs(close - o0) >= {body} * rng AND CASE WHEN up THEN hi - close ELSE close - lo END <= {near} * rng AND {more}),
gr AS (SELECT symbol, day, rn, bar_no AS last, true AS took FROM w4 WHERE rn = 1 UNION ALL SELECT c.symbol, c.day, c.rn, CASE WHEN c.bar_no - g.last >= 2 THEN c.bar_no ELSE g.last END, c.bar_no - g.last >= 2 FROM gr g JOIN w4 c ON c.symbol = g.symbol AND c.day = g.day AND c.rn = g.rn + 1),
dr AS (SELECT w4.*, CASE WHEN {late} THEN tn ELSE ts END AS known FROM w4 JOIN gr USING (symbol, day, rn) WHERE took)
SELECT {_ev(_UPDN, 't0', 'known')}, {r('rng','size')}, {r('aa','atr')} FROM dr"""


@query("displacement_runs", V.sql("tr") + ", " + _runs_sql(1.2, 0.5, 0.4))
def displacement_runs(spark, sf):
    """Two-candle displacements, not overlapping."""
    return _out(_events(spark, sf, "displacement", consecutive=2, atr_mult=1.2, min_body_ratio=0.5, close_pct=40), tidied=["size", "atr"])


@query("displacement_gap", V.sql("tr") + ", " + _runs_sql(0.8, 0.4, 0.5, "wide AND (coalesce(early, false) OR coalesce(late, false)) AND vol >= 0.8 * va * 2", "NOT coalesce(early, false)"))
def displacement_gap(spark, sf):
    """Runs that leave a price gap and have volume; known one candle later where the gap is behind the last candle."""
    return _out(_events(spark, sf, "displacement", consecutive=2, atr_mult=0.8, min_body_ratio=0.4, close_pct=50, require_fvg=True, volume_mult=0.8, volume_lookback=10), tidied=["size", "atr"])


@query("candle_shape", V.sql("bars1h") + f""", c AS (SELECT *, lag(open) OVER d AS po, lag(close) OVER d AS pc, NOT suspect AND coalesce(lag(run) OVER d = run, false) AND NOT coalesce(lag(suspect) OVER d, false) AS two FROM bars1h WINDOW d AS (PARTITION BY symbol, day ORDER BY ts))
SELECT {_ev(_UPDN, 'ts', 'ts')}, CASE WHEN close > open THEN low ELSE high END AS extreme FROM c WHERE NOT suspect AND bar_no > 0 AND high > low AND close <> open AND abs(close - open) >= 0.6 * (high - low) AND two
  AND least(open, close) <= least(po, pc) AND greatest(open, close) >= greatest(po, pc) AND (pc - po) * (close - open) < 0""")
def candle_shape(spark, sf):
    return _out(_events(spark, sf, "candle", min_body_ratio=0.6, engulfing=True), "extreme")


@query("directional_move", V.sql("tr") + f""", m AS (SELECT *, close - lag(close, 6) OVER d AS mv, lag(atr, 6) OVER d AS a, NOT suspect AND coalesce(lag(run, 6) OVER d = run, false) AND NOT coalesce(lag(suspect, 6) OVER d, false) AS cg, lag(ts, 5) OVER d AS t0,
  min(low) OVER x AS mlo, max(high) OVER x AS mhi FROM tr WINDOW d AS (PARTITION BY symbol, day ORDER BY ts), x AS (PARTITION BY symbol, day ORDER BY ts ROWS 6 PRECEDING)),
f AS (SELECT *, coalesce(cg AND a IS NOT NULL AND mv >= greatest(0, 2 * a), false) AS u, coalesce(cg AND a IS NOT NULL AND -mv >= greatest(0, 2 * a), false) AS dn FROM m),
e AS (SELECT *, u AND NOT coalesce(lag(u) OVER d, false) AS nu, dn AND NOT coalesce(lag(dn) OVER d, false) AS nd FROM f WINDOW d AS (PARTITION BY symbol, day ORDER BY ts))
SELECT {_ev("CASE WHEN nu THEN 'bullish' ELSE 'bearish' END", 't0', 'ts')}, {r('mv','move')}, {r('CASE WHEN nu THEN mlo ELSE mhi END','extreme')} FROM e WHERE nu OR nd""")
def directional_move(spark, sf):
    return _out(_events(spark, sf, "directional_move"), tidied=["move", "extreme"])


@query("volume_spike", V.sql("bars1h") + f""", v AS (SELECT *, avg(nullif(volume, 0)) OVER p AS a, count(nullif(volume, 0)) OVER p AS c FROM bars1h WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
k AS (SELECT *, avg(volume) OVER p AS a, count(*) OVER p AS c FROM (SELECT *, strftime({V._ET.format('ts')}, '%H:%M') AS ck FROM bars1h) WINDOW p AS (PARTITION BY symbol, ck ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT 'trailing' AS mode, {_ev(_UPDN, 'ts', 'ts')}, {r('volume / a','ratio')} FROM v WHERE NOT suspect AND c >= 10 AND volume >= 2 * a AND close <> open
UNION ALL SELECT 'same time', {_ev(_UPDN, 'ts', 'ts')}, {r('volume / a','ratio')} FROM k WHERE NOT suspect AND c >= 3 AND volume >= 2 * a AND close <> open""")
def volume_spike(spark, sf):
    m = market(spark, sf)
    x = DEF.events(m, "volume_spike").withColumn("mode", F.lit("trailing")).unionByName(DEF.events(m, "volume_spike", {"same_time": True}).withColumn("mode", F.lit("same time")))
    return _out(x, "mode", tidied=["ratio"])


@query("vol_expansion", V.sql("tr") + f""", {_AB}, rt AS (SELECT *, CASE WHEN bar_no >= 4 THEN avg(t) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING) END AS fa, CASE WHEN bar_no >= 49 THEN avg(t) OVER (PARTITION BY symbol ORDER BY ts ROWS 49 PRECEDING) END AS sl FROM tr),
rc AS (SELECT *, fa >= 1.5 * sl AS now FROM rt WHERE fa IS NOT NULL AND sl IS NOT NULL AND NOT suspect), rp AS (SELECT *, lag(now) OVER (PARTITION BY symbol ORDER BY ts) AS was FROM rc)
SELECT 'range' AS mode, {_ev(_UPDN, 'ts', 'ts')}, {r('(high - low) / a1','ratio')} FROM ab WHERE NOT suspect AND a1 IS NOT NULL AND close <> open AND high - low >= 1.5 * a1
UNION ALL SELECT 'ratio', {_ev('NULL', 'ts', 'ts')}, {r('fa / sl','ratio')} FROM rp WHERE now AND NOT coalesce(was, false)""")
def vol_expansion(spark, sf):
    m = market(spark, sf)
    x = DEF.events(m, "volatility_expansion").withColumn("mode", F.lit("range")).unionByName(DEF.events(m, "volatility_expansion", {"mode": "atr_ratio"}).withColumn("mode", F.lit("ratio")))
    return _out(x, "mode", tidied=["ratio"])


@query("orb", V.sql("bars1h", "dayb") + f""", {_OR}, ob AS (SELECT b.symbol, b.day, b.ts, b.close, o.high AS rh, o.low AS rl, row_number() OVER (PARTITION BY b.symbol, b.day ORDER BY b.ts) AS rn FROM bars1h b JOIN org o ON o.symbol = b.symbol AND o.day = b.day
  WHERE b.ts + INTERVAL 1 HOUR > af AND b.ts + INTERVAL 1 HOUR <= vu AND NOT suspect AND (close > o.high OR close < o.low))
SELECT {_ev("CASE WHEN close > rh THEN 'bullish' ELSE 'bearish' END", 'ts', 'ts')}, CASE WHEN close > rh THEN rh ELSE rl END AS level FROM ob WHERE rn = 1""")
def orb(spark, sf):
    return _out(_events(spark, sf, "opening_range", minutes=120), "level")


@query("vwap_cross", V.sql("bars1h") + f""", {_VW}, sd AS (SELECT *, CASE WHEN gl IS NOT NULL AND NOT suspect THEN close > gl END AS s FROM vg), pv AS (SELECT *, lag(s) OVER (PARTITION BY symbol ORDER BY ts) AS p FROM sd)
SELECT {_ev("CASE WHEN s THEN 'bullish' ELSE 'bearish' END", 'ts', 'ts')}, {r('gl','level')} FROM pv WHERE s <> p""")
def vwap_cross(spark, sf):
    return _out(_events(spark, sf, "vwap", anchor="globex"), tidied=["level"])


_STRUCT = f"""{_AB}, {_SW}, sd AS (SELECT *, kind = 'swingh' AS up FROM swg),
ft AS (SELECT s.symbol, s.regime, s.up, s.bar_no AS sn, s.price, s.ts AS st, s.ct, (SELECT min(b.bar_no) FROM bars1h b WHERE b.symbol = s.symbol AND b.regime = s.regime AND NOT b.suspect AND b.bar_no > s.bar_no AND b.bar_no - s.bar_no <= 200 AND b.ts >= s.ct + INTERVAL 1 HOUR
  AND CASE WHEN s.up THEN b.close > s.price ELSE b.close < s.price END) AS j FROM sd s),
bk AS (SELECT symbol, regime, up, j, max(sn) AS sn, arg_max(price, sn) AS price, arg_max(st, sn) AS st FROM ft WHERE j IS NOT NULL GROUP BY 1, 2, 3, 4),
bt AS (SELECT bk.*, a.ts, a.day, a.open, a.high, a.low, a.close, a.a1 FROM bk JOIN ab a ON a.symbol = bk.symbol AND a.bar_no = bk.j),
vs AS (SELECT * FROM bt WHERE NOT EXISTS (SELECT 1 FROM ft u WHERE u.symbol = bt.symbol AND u.regime = bt.regime AND u.up = bt.up AND u.sn > bt.sn AND u.ct + INTERVAL 1 HOUR <= bt.ts AND bt.j - u.sn <= 200 AND (u.j IS NULL OR u.j > bt.j))),
tn AS (SELECT *, lag(up) OVER (PARTITION BY symbol, regime ORDER BY j, up DESC) AS tr, coalesce(high > low AND high - low >= a1 AND abs(close - open) >= 0.5 * (high - low), false) AS dsp FROM vs),
ms AS (SELECT *, CASE WHEN up THEN 'bullish' ELSE 'bearish' END AS dir, CASE WHEN tr IS NULL THEN 'break' WHEN tr = up THEN 'BOS' WHEN dsp THEN 'MSS' ELSE 'CHoCH' END AS type FROM tn)"""


def structure_events(spark, sf):
    return _events(spark, sf, "market_structure_break")


@query("structure", V.sql("tr", "bars1h") + f", {_STRUCT} SELECT {_ev('dir', 'ts', 'ts')}, type, price AS level, CAST(epoch(st) AS BIGINT) AS swing_at, dsp AS displacement FROM ms")
def structure(spark, sf):
    return _out(structure_events(spark, sf), "type", "level", F.unix_seconds("swing_at").alias("swing_at"), "displacement")


@query("structure_wick", V.sql("tr", "bars1h") + ", " + _STRUCT.replace("b.close > s.price ELSE b.close < s.price", "b.high > s.price ELSE b.low < s.price") + f" SELECT {_ev('dir', 'ts', 'ts')}, type, price AS level FROM ms WHERE type IN ('CHoCH', 'MSS')")
def structure_wick(spark, sf):
    """Trades beyond a swing against the trend."""
    return _out(_events(spark, sf, "market_structure_break", by="wick", type="choch"), "type", "level")


@query("smt", V.sql("bars1h") + f""", {_SW}, ob AS (SELECT * FROM bars1h WHERE symbol = 'view'), pr AS (SELECT *, lag(bar_no) OVER w AS pn, lag(price) OVER w AS pp, lag(ts) OVER w AS pt, lag(regime) OVER w AS prg FROM swg WHERE symbol <> 'view' WINDOW w AS (PARTITION BY symbol, kind ORDER BY bar_no)),
wx AS (SELECT p.*, (SELECT CASE WHEN count(*) = 3 AND NOT bool_or(suspect) THEN struct_pack(lo := min(low), hi := max(high)) END FROM ob WHERE ob.ts BETWEEN p.ts - INTERVAL 1 HOUR AND p.ts + INTERVAL 1 HOUR) AS cw,
  (SELECT CASE WHEN count(*) = 3 AND NOT bool_or(suspect) THEN struct_pack(lo := min(low), hi := max(high)) END FROM ob WHERE ob.ts BETWEEN p.pt - INTERVAL 1 HOUR AND p.pt + INTERVAL 1 HOUR) AS pw,
  (SELECT any_value(regime) FROM ob WHERE ob.ts = p.ts) AS rc, (SELECT any_value(regime) FROM ob WHERE ob.ts = p.pt) AS rp FROM pr p WHERE pn IS NOT NULL AND bar_no - pn <= 40 AND regime = prg),
df AS (SELECT *, price - pp AS da, CASE WHEN kind = 'swingl' THEN cw.lo - pw.lo ELSE cw.hi - pw.hi END AS db FROM wx WHERE cw IS NOT NULL AND pw IS NOT NULL AND rc = rp)
SELECT symbol, CASE WHEN kind = 'swingl' THEN 'bullish' ELSE 'bearish' END AS direction, CAST(epoch(ts) AS BIGINT) AS occurred_at, greatest(CAST(epoch(ct) AS BIGINT) + 3600, CAST(epoch(ts) AS BIGINT) + 7200) AS confirmed_at, CAST(day AS VARCHAR) AS day,
  price AS extreme, {r('da','own_change')}, {r('db','other_change')} FROM df WHERE (da > 0) <> (db > 0) AND abs(da) >= 0.02 AND abs(db) >= 0.02""")
def smt(spark, sf):
    b = V.bars1h(spark, sf)
    m = DEF.Market(b.filter("symbol <> 'view'"), STEP, TICK, other=b.filter("symbol = 'view'").drop("symbol"))  # compared with one market
    return _out(DEF.events(m, "smt_divergence", {"max_lag_bars": 1, "min_difference": 0.02}), "extreme", tidied=["own_change", "other_change"])


@query("union_events", V.sql("tr", "bars1h") + f""", {_FVG}, {_DISP} SELECT 'fvg' AS concept, {_ev('dir', 't1', 'ts')} FROM fvg UNION ALL SELECT 'displacement', {_ev(_UPDN, 'ts', 'ts')} FROM dp""")
def union_events(spark, sf):
    e = D.union_events([fvgs(spark, sf), displacements(spark, sf)])
    return _out(e, "concept")


@query("level_at_t", V.sql("dlev", "hours", "dayb", "bars1h") + f""", {_PREV}, j AS (SELECT b.symbol, b.bar_no, l.kind, l.price, l.af FROM bars1h b JOIN lv l ON l.symbol = b.symbol AND l.af <= b.ts + INTERVAL 1 HOUR AND b.ts + INTERVAL 1 HOUR < l.vu)
SELECT symbol, bar_no, kind, arg_max(price, af) AS price FROM j GROUP BY 1, 2, 3""")
def level_at_t(spark, sf):
    from tidemark.operators import setups as P

    b = V.bars1h(spark, sf).withColumn("t", D.close_time(STEP)).select("symbol", "bar_no", "t", "day")
    return P.level_at(b, reference_levels(V.bars1h(spark, sf)), "t").select("symbol", "bar_no", "kind", "price")


@query("asof_htf", V.sql("bars1h", "dayb") + f""", h4 AS (SELECT symbol, CAST(epoch(d0) + floor((epoch(ts) - epoch(d0)) / 14400) * 14400 AS BIGINT) + 14400 AS ct, arg_max(close, ts) AS c4 FROM bars1h JOIN dayb USING (symbol, day) GROUP BY 1, 2)
SELECT b.symbol, b.bar_no, h.c4 AS htf_close, h.ct AS htf_closed_at FROM bars1h b ASOF LEFT JOIN h4 h ON h.symbol = b.symbol AND CAST(epoch(b.ts) AS BIGINT) + 3600 >= h.ct""")
def asof_htf(spark, sf):
    b = V.bars1h(spark, sf)
    h = B.resample(b, 14400, STEP).select("symbol", (F.col("ts") + B.seconds_interval(14400)).alias("htf_closed_at"), F.col("close").alias("htf_close"))
    left = b.withColumn("t", D.close_time(STEP)).select("symbol", "bar_no", "t")
    x = O.asof_backward(left, h, ["symbol"], "t", "htf_closed_at", ["htf_close", "htf_closed_at"], lambda c: F.date_trunc("day", c))
    return x.select("symbol", "bar_no", "htf_close", F.unix_seconds("htf_closed_at").alias("htf_closed_at"))
