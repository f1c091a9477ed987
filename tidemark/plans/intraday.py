"""Candles: calendar, resampling, levels, feed quality, sources."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.functions.maths import tidy
from tidemark.operators import bars as B
from tidemark.operators import composite as K
from tidemark.operators import intraday_quality as Q
from tidemark.operators import ordered as O
from tidemark.plans import views as V
from tidemark.plans.registry import query, r
from tidemark.sources import archive as A
from tidemark.sources import readers as S

STEP = 3600


def _ep(c, name=None):
    """Instants leave as whole seconds."""
    return F.unix_seconds(F.col(c)).alias(name or c)


def _e(c: str, name: str | None = None) -> str:
    return f"CAST(floor(epoch({c})) AS BIGINT) AS {name or c}"


def _events(spark, sf):
    return V.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))


# --- calendar ------------------------------------------------------------------------------------------

_EV = f"WITH RECURSIVE e AS (SELECT event_id, ts, {V._ET.format('ts')} AS et FROM events)"


@query("in_window", _EV + """ SELECT event_id, hour(et) * 60 + minute(et) >= 570 AND hour(et) * 60 + minute(et) < 960 AS rth,
  hour(et) * 60 + minute(et) >= 1080 OR hour(et) * 60 + minute(et) < 570 AS overnight FROM e""")
def in_window(spark, sf):
    return _events(spark, sf).select("event_id", cal.in_window(F.col("ts"), 570, 960).alias("rth"), cal.in_window(F.col("ts"), 1080, 570).alias("overnight"))


@query("standard_open", _EV + """ SELECT event_id, CASE dayofweek(et) WHEN 6 THEN false WHEN 0 THEN hour(et) >= 18 WHEN 5 THEN hour(et) < 17 ELSE hour(et) <> 17 END AS is_open FROM e""")
def standard_open(spark, sf):
    return _events(spark, sf).select("event_id", cal.market_open(F.col("ts")).alias("is_open"))


@query("trading_day", _EV + f""" SELECT event_id, CAST({V.roll_weekend('(CAST(et AS DATE) + CASE WHEN hour(et) >= 18 THEN 1 ELSE 0 END)')} AS VARCHAR) AS day,
  CAST(epoch({V.clock(V.roll_weekend('(CAST(et AS DATE) + CASE WHEN hour(et) >= 18 THEN 1 ELSE 0 END)') + ' - 1', '18:00')}) AS BIGINT) AS opens FROM e""")
def trading_day(spark, sf):
    d = cal.trading_day(F.col("ts"))
    return _events(spark, sf).select("event_id", d.cast("string").alias("day"), F.unix_seconds(cal.day_start(d)).alias("opens"))


@query("expiries", """WITH RECURSIVE d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders),
x AS (SELECT *, CASE WHEN month(m) % 3 = 0 THEN m + CAST((5 - dayofweek(m) + 7) % 7 AS INTEGER) + 14 END AS e FROM d)
SELECT o_orderkey, CAST(e AS VARCHAR) AS expiry, coalesce(day BETWEEN e - 8 AND e + 3, false) AS in_roll, CASE WHEN e IS NOT NULL THEN 'NQ' || CASE month(e) WHEN 3 THEN 'H' WHEN 6 THEN 'M' WHEN 9 THEN 'U' ELSE 'Z' END || strftime(e, '%y') END AS code FROM x""")
def expiries(spark, sf):
    d = V.table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    e = Q.quarterly_expiry(F.col("day"))
    # Contract month letters.
    letter = F.when(F.month(e) == 3, "H").when(F.month(e) == 6, "M").when(F.month(e) == 9, "U").when(F.month(e) == 12, "Z")
    return d.select("o_orderkey", e.cast("string").alias("expiry"), Q.in_roll_window(F.col("day")).alias("in_roll"), F.concat(F.lit("NQ"), letter, F.date_format(e, "yy")).alias("code"))


@query("recency_bucket", f"""WITH RECURSIVE e AS (SELECT event_id, CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS ts, max(ts) OVER () AS now FROM events),
a AS (SELECT event_id, ts, CAST({V._ET.format('now')} AS DATE) - CAST({V._ET.format('ts')} AS DATE) AS age FROM e)
SELECT event_id, CASE WHEN ts IS NULL THEN 'undated' WHEN age <= 0 THEN 'today' WHEN age <= 7 THEN 'week' ELSE 'older' END AS bucket FROM a""")
def recency_bucket(spark, sf):
    e = _events(spark, sf)
    now = e.agg(F.max("ts").alias("now")).scalar()
    e = e.withColumn("ts", F.when(F.col("event_id") % 50 != 0, F.col("ts")))
    return e.select("event_id", cal.recency_bucket(F.col("ts"), now).alias("bucket"))


@query("et_to_utc", f"SELECT event_id, CAST(floor(epoch({V._UTC.format('ts')})) AS BIGINT) AS utc FROM events")
def et_to_utc(spark, sf):
    return S.et_to_utc(_events(spark, sf), "ts").select("event_id", _ep("ts", "utc"))


# --- sources -------------------------------------------------------------------------------------------

@query("normalize_bars", """WITH RECURSIVE x AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS p, CASE WHEN l_quantity = 13 THEN NULL WHEN l_quantity = 14 THEN 'nan'::DOUBLE WHEN l_quantity = 15 THEN -1 ELSE l_extendedprice END AS open,
  l_extendedprice * (1 + l_discount - 0.02) AS high, l_extendedprice * (1 - l_tax + 0.01) AS low, l_extendedprice * (1 + l_tax - l_discount) AS close, CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS volume FROM lineitem)
SELECT k, ln, p, round(open + 1e-9, 2) + 0.0 AS open, round(greatest(open, high, low, close) + 1e-9, 4) + 0.0 AS high, round(least(open, high, low, close) + 1e-9, 4) + 0.0 AS low, round(close + 1e-9, 4) + 0.0 AS close, coalesce(volume, 0) AS volume
FROM x WHERE open IS NOT NULL AND NOT isnan(open) AND open > 0 AND high >= low AND high > 0 AND low > 0 AND close > 0""")
def normalize_bars(spark, sf):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    x = V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("p"),
        F.when(q == 13, None).when(q == 14, float("nan")).when(q == 15, -1.0).otherwise(p).alias("open"), (p * (1 + F.col("l_discount") - 0.02)).alias("high"),
        (p * (1 - F.col("l_tax") + 0.01)).alias("low"), (p * (1 + F.col("l_tax") - F.col("l_discount"))).alias("close"), F.when(F.col("l_linenumber") != 3, q).alias("volume"))
    n = Q.normalize(x)
    return n.withColumns({"open": tidy(F.col("open"), 2), **{c: tidy(F.col(c), 4) for c in ("high", "low", "close")}})


def _archive(spark, sf):
    """Every tick is in one batch at least: the old one ends inside a candle, the new one reads again from six hours before."""
    t = V.ticks(spark, sf)
    old = B.bars_from_ticks(t.filter(F.col("ts") < F.lit("2024-01-20 00:30:00").cast("timestamp")), STEP).withColumn("batch", F.lit(1)).withColumn("interval", F.lit("1h"))
    fresh = B.bars_from_ticks(t.filter(F.col("ts") >= F.lit("2024-01-19 18:00:00").cast("timestamp")), STEP).withColumn("batch", F.lit(2)).withColumn("interval", F.lit("1h"))
    return A.merge_archive(old, fresh, F.lit("2024-01-30 12:30:00").cast("timestamp"), STEP)


_ARCH = V.sql("ticks") + f""", al AS (SELECT *, 1 AS batch FROM ({V._bars_sql("WHERE ts < TIMESTAMP '2024-01-20 00:30:00'")}) UNION ALL SELECT *, 2 AS batch FROM ({V._bars_sql("WHERE ts >= TIMESTAMP '2024-01-19 18:00:00'")})
  WHERE epoch(ts) + 3600 <= epoch(TIMESTAMP '2024-01-30 12:30:00')),
ar AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, ts ORDER BY batch DESC) AS rn FROM al) WHERE rn = 1)"""


@query("archive_merge", _ARCH + f" SELECT symbol, '1h' AS \"interval\", {_e('ts')}, open, high, low, close, volume, batch FROM ar")
def archive_merge(spark, sf):
    return _archive(spark, sf).select("symbol", "interval", _ep("ts"), "open", "high", "low", "close", "volume", "batch")


@query("catalog", _ARCH + f", m AS (SELECT symbol, max(batch) AS mb FROM ar GROUP BY 1) SELECT symbol, '1h' AS \"interval\", {_e('min(ts)', 'first')}, {_e('max(ts)', 'last')}, count(*) AS bars, count(*) FILTER (batch = mb) AS new_rows FROM ar JOIN m USING (symbol) GROUP BY symbol")
def catalog(spark, sf):
    return A.catalog(_archive(spark, sf)).select("symbol", "interval", _ep("first"), _ep("last"), "bars", "new_rows")


@query("src_csv_roundtrip", V.sql("bars1h") + f" SELECT symbol, '1h' AS interval, {_e('ts')}, open, high, low, close, volume, contract FROM bars1h")
def src_csv_roundtrip(spark, sf):
    """All candles written as CSV in the shared folder, a folder per symbol, and read back through the CSV reader."""
    from tidemark.session import checkpoint_dir

    root = checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/bars_csv_{os.urandom(6).hex()}"
    V.bars1h(spark, sf).select("symbol", F.unix_seconds("ts").cast("string").alias("timestamp"), "open", "high", "low", "close", "volume", "contract").write.partitionBy("symbol").option("header", True).csv(path)
    return S.read_bars_csv(spark, path, "1h").select("symbol", "interval", _ep("ts"), "open", "high", "low", "close", "volume", "contract")


# --- resampling and levels -----------------------------------------------------------------------------

_D4 = "epoch(d0) + floor((epoch(ts) - epoch(d0)) / 14400) * 14400"


def _resample_sql(bucket: str, close: str, label: str) -> str:
    return f"""SELECT '{label}' AS tf, symbol, CAST({bucket} AS BIGINT) AS ts, CAST(day AS VARCHAR) AS day, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n_base,
  coalesce(nullif((SELECT count(*) FROM hours WHERE open AND epoch(t) >= CAST({bucket} AS BIGINT) AND epoch(t) < {close}), 0), count(*)) AS n_expected,
  bool_or(suspect) AS s, CASE WHEN min(contract) = max(contract) THEN min(contract) ELSE 'mixed' END AS contract FROM bx GROUP BY symbol, day, {bucket}, {close}"""


@query("resample", V.sql("bars1h", "dayb", "hours") + f""", bx AS (SELECT b.*, d0, d1 FROM bars1h b JOIN dayb USING (symbol, day)),
b4 AS (SELECT *, CAST({_D4} AS BIGINT) AS bk, CAST({_D4} AS BIGINT) + 14400 AS be, '4h' AS tf FROM bx UNION ALL SELECT *, CAST(epoch(d0) AS BIGINT), CAST(epoch(d1) AS BIGINT), '1d' FROM bx),
g AS (SELECT tf, symbol, day, bk, be, arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS n_base, bool_or(suspect) AS s,
  CASE WHEN min(contract) = max(contract) THEN min(contract) ELSE 'mixed' END AS contract FROM b4 GROUP BY 1, 2, 3, 4, 5),
x AS (SELECT tf, bk, be, count(*) AS n FROM (SELECT DISTINCT tf, bk, be FROM g) JOIN hours ON open AND epoch(t) >= bk AND epoch(t) < be GROUP BY 1, 2, 3),
y AS (SELECT g.*, coalesce(x.n, n_base) AS ne FROM g LEFT JOIN x USING (tf, bk, be))
SELECT tf, symbol, bk AS ts, CAST(day AS VARCHAR) AS day, open, high, low, close, volume, n_base, ne AS n_expected, n_base < ne AS partial, s OR n_base < 0.8 * ne AS suspect, contract FROM y""")
def resample(spark, sf):
    b = V.bars1h(spark, sf)
    four, day = B.resample(b, 14400, STEP).withColumn("tf", F.lit("4h")), B.resample(b, 86400, STEP).withColumn("tf", F.lit("1d"))
    x = four.unionByName(day).withColumn("ts", F.unix_seconds("ts")).withColumn("day", F.col("day").cast("string"))
    return x.withColumn("n_expected", F.col("n_expected").cast("long"))


@query("day_levels", V.sql("dlev") + f" SELECT symbol, CAST(day AS VARCHAR) AS day, high, low, clean, expected, {r('coverage','coverage')}, CAST(regime AS BIGINT) AS regime, complete FROM dlev")
def day_levels(spark, sf):
    d = B.day_levels(V.bars1h(spark, sf), STEP)
    return d.select("symbol", F.col("day").cast("string").alias("day"), "high", "low", "clean", F.col("expected").cast("long").alias("expected"), tidy(F.col("coverage")).alias("coverage"), "regime", "complete")


def _levels(df, *more):
    return df.select("symbol", *more, "kind", "price", F.col("day").cast("string").alias("day"), _ep("available_from"), _ep("valid_until"))


_PREV = f"""nx AS (SELECT *, lead(day) OVER w AS nd, lead(reg_open) OVER w AS nr FROM dlev WINDOW w AS (PARTITION BY symbol ORDER BY day)),
pdl AS (SELECT symbol, nd AS day, high, low, {V.clock('nd - 1', '18:00')} AS af, {V.clock('nd', '17:00')} AS vu FROM nx WHERE complete AND nd IS NOT NULL AND coalesce(nr, last_regime) = regime),
onl AS (SELECT b.symbol, b.day, m0 AS af, d1 AS vu, max(high) FILTER (ng AND NOT suspect) AS high, min(low) FILTER (ng AND NOT suspect) AS low, count(*) FILTER (ng AND NOT suspect) AS clean, min(ts) FILTER (ng) AS f0,
  arg_min(regime, ts) FILTER (ng) AS r0, arg_max(regime, ts) FILTER (ts <= m0) AS r1, d0, (SELECT count(*) FROM hours WHERE open AND t >= d0 AND t < m0) AS ex
  FROM (SELECT *, hour(et) * 60 + minute(et) >= 1080 OR hour(et) * 60 + minute(et) < 570 AS ng FROM (SELECT *, {V._ET.format('ts')} AS et FROM bars1h)) b JOIN dayb USING (symbol, day) GROUP BY b.symbol, b.day, m0, d1, d0),
onok AS (SELECT * FROM onl WHERE ex > 0 AND clean >= 0.9 * ex AND epoch(f0) - epoch(d0) <= 1800 AND r0 = r1),
lv AS (SELECT symbol, 'pdh' AS kind, high AS price, day, af, vu FROM pdl UNION ALL SELECT symbol, 'pdl', low, day, af, vu FROM pdl UNION ALL
  SELECT symbol, 'onh', high, day, af, vu FROM onok UNION ALL SELECT symbol, 'onl', low, day, af, vu FROM onok)"""
_LV = f"symbol, kind, price, CAST(day AS VARCHAR) AS day, {_e('af','available_from')}, {_e('vu','valid_until')}"


def reference_levels(bars, step=STEP):
    return B.previous_day_levels(B.day_levels(bars, step)).unionByName(B.overnight_levels(bars, step))


@query("ref_levels", V.sql("dlev", "hours", "dayb") + f", {_PREV} SELECT {_LV} FROM lv")
def ref_levels(spark, sf):
    return _levels(reference_levels(V.bars1h(spark, sf)))


@query("overnight_levels", V.sql("dlev", "hours", "dayb") + f", {_PREV} SELECT {_LV} FROM lv WHERE kind IN ('onh', 'onl')")
def overnight_levels(spark, sf):
    return _levels(B.overnight_levels(V.bars1h(spark, sf), STEP))


@query("week_levels", V.sql("dlev") + f""", od AS (SELECT *, coalesce(reg_open, lag(last_regime) OVER (PARTITION BY symbol ORDER BY day)) AS org FROM dlev),
wk AS (SELECT symbol, CAST(date_trunc('week', day) AS DATE) AS week, count(*) AS n, bool_and(complete) AS ok, min(regime) AS r0, max(regime) AS r1, max(high) AS high, min(low) AS low, min(day) AS f, max(day) AS l, arg_min(org, day) AS org FROM od GROUP BY 1, 2),
wn AS (SELECT *, lead(f) OVER w AS nf, lead(l) OVER w AS nl, lead(org) OVER w AS nr FROM wk WINDOW w AS (PARTITION BY symbol ORDER BY week)),
k AS (SELECT *, {V.clock('nf - 1', '18:00')} AS af, {V.clock('nl', '17:00')} AS vu FROM wn WHERE nf IS NOT NULL AND n >= 3 AND ok AND r0 = r1 AND nr = r0),
lv AS (SELECT symbol, 'pwh' AS kind, high AS price, nf AS day, af, vu FROM k UNION ALL SELECT symbol, 'pwl', low, nf, af, vu FROM k) SELECT {_LV} FROM lv""")
def week_levels(spark, sf):
    return _levels(B.week_levels(B.day_levels(V.bars1h(spark, sf), STEP)))


_OR = f"""org AS (SELECT b.symbol, b.day, max(high) AS high, min(low) AS low, m0 + INTERVAL 2 HOUR AS af, m1 AS vu FROM bars1h b JOIN dayb USING (symbol, day)
  WHERE ts >= m0 AND ts < m0 + INTERVAL 2 HOUR GROUP BY b.symbol, b.day, m0, m1 HAVING count(*) >= 2 AND NOT bool_or(suspect))"""


@query("opening_range", V.sql("bars1h", "dayb") + f", {_OR} SELECT symbol, CAST(day AS VARCHAR) AS day, high, low, {_e('af','available_from')}, {_e('vu','valid_until')} FROM org")
def opening_range(spark, sf):
    return B.opening_ranges(V.bars1h(spark, sf), STEP, 120).select("symbol", F.col("day").cast("string").alias("day"), "high", "low", _ep("available_from"), _ep("valid_until"))


@query("session_ranges", V.sql("bars1h", "dayb", "hours") + f""", win AS (SELECT symbol, day, d1, unnest(['asia', 'london', 'ny_am']) AS session, unnest(['asiah', 'lonh', 'nyamh']) AS hk, unnest(['asial', 'lonl', 'nyaml']) AS lk,
  unnest([{V.clock('day - 1', '20:00')}, {V.clock('day', '02:00')}, {V.clock('day', '09:30')}]) AS s, unnest([{V.clock('day', '00:00')}, {V.clock('day', '05:00')}, {V.clock('day', '12:00')}]) AS e FROM dayb),
g AS (SELECT b.symbol, b.day, session, hk, lk, s, e, d1, count(*) AS n, max(high) AS high, min(low) AS low, (SELECT count(*) FROM hours WHERE open AND t >= date_trunc('hour', s) AND t < e) AS ex FROM bars1h b JOIN win w ON b.symbol = w.symbol AND b.day = w.day AND ts >= s AND ts < e
  GROUP BY b.symbol, b.day, session, hk, lk, s, e, d1 HAVING NOT bool_or(suspect) AND min(regime) = max(regime)),
k AS (SELECT * FROM g WHERE ex > 0 AND n >= 0.9 * ex), lv AS (SELECT symbol, session, hk AS kind, high AS price, day, e AS af, d1 AS vu FROM k UNION ALL SELECT symbol, session, lk, low, day, e, d1 FROM k)
SELECT session, {_LV} FROM lv""")
def session_ranges(spark, sf):
    return _levels(B.session_ranges(V.bars1h(spark, sf), STEP), "session")


@query("atr", V.sql("tr") + f" SELECT symbol, bar_no, {r('atr','atr')} FROM tr")
def atr(spark, sf):
    return B.with_atr(V.bars1h(spark, sf)).select("symbol", "bar_no", tidy(F.col("atr")).alias("atr"))


_VW = f"""vw AS (SELECT *, hour(et) * 60 + minute(et) >= 570 AND hour(et) * 60 + minute(et) < 960 AS rth FROM (SELECT *, {V._ET.format('ts')} AS et FROM bars1h)),
vg AS (SELECT symbol, bar_no, day, suspect, close, ts, sum(CASE WHEN NOT suspect THEN (high + low + close) / 3 * volume END) OVER g / sum(CASE WHEN NOT suspect THEN volume END) OVER g AS gl,
  CASE WHEN rth THEN sum(CASE WHEN NOT suspect THEN (high + low + close) / 3 * volume END) OVER s / sum(CASE WHEN NOT suspect THEN volume END) OVER s END AS rt
  FROM vw WINDOW g AS (PARTITION BY symbol, day ORDER BY ts), s AS (PARTITION BY symbol, day, rth ORDER BY ts))"""


@query("vwap", V.sql("bars1h") + f", {_VW} SELECT symbol, bar_no, {r('gl','globex')}, {r('rt','rth')} FROM vg")
def vwap(spark, sf):
    x = B.session_vwap(V.bars1h(spark, sf), "globex").withColumnRenamed("vwap", "globex")
    x = B.session_vwap(x, "rth")
    return x.select("symbol", "bar_no", tidy(F.col("globex")).alias("globex"), tidy(F.col("vwap")).alias("rth"))


@query("session_extreme", V.sql("bars1h") + """ SELECT symbol, bar_no, max(high) FILTER (NOT suspect) OVER w AS high_so_far, min(low) FILTER (NOT suspect) OVER w AS low_so_far FROM bars1h WINDOW w AS (PARTITION BY symbol, day ORDER BY ts)""")
def session_extreme(spark, sf):
    return B.session_extremes(V.bars1h(spark, sf)).select("symbol", "bar_no", "high_so_far", "low_so_far")


@query("regime", V.sql("bars1h") + " SELECT symbol, bar_no, CAST(regime AS BIGINT) AS regime FROM bars1h")
def regime(spark, sf):
    return V.bars1h(spark, sf).select("symbol", "bar_no", "regime")


@query("contiguous", V.sql("bars1h") + " SELECT symbol, bar_no, NOT suspect AND coalesce(lag(run, 2) OVER w = run, false) AND NOT coalesce(lag(suspect, 2) OVER w, false) AS three FROM bars1h WINDOW w AS (PARTITION BY symbol, day ORDER BY ts)")
def contiguous(spark, sf):
    from tidemark.operators import detectors as D

    return V.bars1h(spark, sf).withColumn("three", D.contiguous(2)).select("symbol", "bar_no", "three")


# --- feed quality --------------------------------------------------------------------------------------

@query("q_order", V.sql("feed") + ", p AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol ORDER BY arrival, copy) AS pt FROM feed) SELECT symbol, count(*) FILTER (ts < pt) AS out_of_order, count(*) AS \"rows\" FROM p GROUP BY 1")
def q_order(spark, sf):
    return Q.out_of_order(V.feed(spark, sf))


@query("q_duplicates", V.sql("feed") + f""" SELECT symbol, {_e('ts')}, count(*) AS copies, max(open) - min(open) >= 1e-9 OR max(high) - min(high) >= 1e-9 OR max(low) - min(low) >= 1e-9 OR max(close) - min(close) >= 1e-9 AS conflict,
  arg_min(close, (arrival, copy)) AS close FROM feed GROUP BY symbol, ts""")
def q_duplicates(spark, sf):
    return Q.deduplicate(V.feed(spark, sf), ("arrival", "copy")).select("symbol", _ep("ts"), "copies", "conflict", "close")


@query("q_missing", V.sql("bars1h", "hours") + f""", p AS (SELECT symbol, ts, day, lag(ts) OVER (PARTITION BY symbol, day ORDER BY ts) AS pt FROM bars1h),
m AS (SELECT p.symbol, p.ts, count(*) AS missing FROM p JOIN hours ON open AND t > pt AND t < ts WHERE epoch(ts) - epoch(pt) > 3600 GROUP BY 1, 2) SELECT symbol, {_e('ts')}, missing, missing >= 3 AS suspect FROM m""")
def q_missing(spark, sf):
    return Q.missing_bars(V.bars1h(spark, sf), STEP).select("symbol", _ep("ts"), F.col("missing").cast("long").alias("missing"), "suspect")


_ABN = """mv AS (SELECT *, lag(close) OVER d AS pc, epoch(ts) - epoch(lag(ts) OVER d) AS st FROM bars1h WINDOW d AS (PARTITION BY symbol, day ORDER BY ts)),
md AS (SELECT symbol, quantile_cont(abs(close / pc - 1), 0.5) AS tm, quantile_cont((high - low) / close, 0.5) AS tr FROM mv GROUP BY 1),
ab AS (SELECT symbol, ts, 'gap' AS kind, abs(open / pc - 1) AS jump, (high - low) / close AS rng FROM mv JOIN md USING (symbol) WHERE st = 3600 AND abs(open / pc - 1) > greatest(0.001, 3 * tm)
  UNION ALL SELECT symbol, ts, 'range', abs(open / pc - 1), (high - low) / close FROM mv JOIN md USING (symbol) WHERE (high - low) / close > greatest(0.002, 3 * tr))"""


# The hourly walk is calm, so the query uses tighter limits than the defaults.
_TIGHT = {"gap_floor": 0.001, "gap_times": 3, "range_floor": 0.002, "range_times": 3}


@query("q_abnormal", V.sql("bars1h") + f", {_ABN} SELECT symbol, {_e('ts')}, kind, {r('jump','jump')}, {r('rng','range')} FROM ab")
def q_abnormal(spark, sf):
    return Q.abnormal(V.bars1h(spark, sf), STEP, **_TIGHT).select("symbol", _ep("ts"), "kind", tidy(F.col("jump")).alias("jump"), tidy(F.col("range")).alias("range"))


@query("q_roll", V.sql("dirty") + """, p AS (SELECT symbol, date AS day, open, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS pc, CAST(date_trunc('month', date) AS DATE) AS m FROM dirty),
x AS (SELECT *, CASE WHEN month(m) % 3 = 0 THEN m + CAST((5 - dayofweek(m) + 7) % 7 AS INTEGER) + 14 END AS e, abs(open / nullif(pc, 0) - 1) AS jump FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY symbol, e ORDER BY jump DESC, day) AS rn FROM x WHERE day BETWEEN e - 8 AND e + 3 AND jump > 0.006)
SELECT symbol, CAST(e AS VARCHAR) AS expiry, CAST(day AS VARCHAR) AS day, """ + r("jump", "jump") + " FROM b WHERE rn = 1")
def q_roll(spark, sf):
    d = V.dirty(spark, sf).withColumn("prev_close", F.lag("close").over(O.by_symbol())).withColumnRenamed("date", "day")
    d = d.withColumn("ts", F.col("day").cast("timestamp")).withColumn("mid", F.lit(False))
    return Q.roll_artifacts(d).select("symbol", F.col("expiry").cast("string").alias("expiry"), F.col("day").cast("string").alias("day"), tidy(F.col("jump")).alias("jump"))


@query("q_contract_roll", V.sql("bars1h") + f", p AS (SELECT symbol, ts, contract, lag(contract) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars1h) SELECT symbol, {_e('ts')}, pc AS from_contract, contract AS to_contract FROM p WHERE pc <> contract")
def q_contract_roll(spark, sf):
    return Q.contract_changes(V.bars1h(spark, sf)).select("symbol", _ep("ts"), "from_contract", "to_contract")


@query("q_stale", V.sql("dirty") + """, f AS (SELECT *, coalesce(volume = 0 AND close = lag(close) OVER (PARTITION BY symbol ORDER BY date), false) AS flat FROM dirty),
i AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY date) AS isl FROM f)
SELECT symbol, CAST(min(date) AS VARCHAR) AS start, CAST(max(date) AS VARCHAR) AS "end", count(*) AS bars FROM i WHERE flat GROUP BY symbol, isl HAVING count(*) >= 5""")
def q_stale(spark, sf):
    d = V.dirty(spark, sf).select("symbol", F.col("date").alias("ts"), F.trunc("date", "month").alias("month"), F.col("close").alias("high"), F.col("close").alias("low"), "close", "volume")
    return Q.stale_runs(d, "month", 5).select("symbol", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "bars")


@query("q_short_session", V.sql("bars1h") + f""", d AS (SELECT symbol, day, count(*) AS bars FROM bars1h GROUP BY 1, 2), e AS (SELECT *, quantile_cont(bars, 0.5) OVER g AS typical, min(day) OVER g AS a, max(day) OVER g AS z FROM d WINDOW g AS (PARTITION BY symbol))
SELECT symbol, CAST(day AS VARCHAR) AS day, bars, {r('typical','typical')} FROM e WHERE day > a AND day < z AND bars < 0.95 * typical""")
def q_short_session(spark, sf):
    return Q.short_sessions(V.bars1h(spark, sf), 0.95).select("symbol", F.col("day").cast("string").alias("day"), "bars", tidy(F.col("typical")).alias("typical"))


@query("q_cross_check", V.sql("bars1h", "other_feed") + f""", x AS (SELECT b.symbol, b.ts, b.bar_no, b.close, abs(b.close - o.close) AS d FROM bars1h b JOIN other_feed o USING (symbol, ts)),
m AS (SELECT symbol, quantile_cont(d, 0.5) AS md FROM x GROUP BY 1), f AS (SELECT x.*, lag(bar_no) OVER (PARTITION BY x.symbol ORDER BY bar_no) AS pb FROM x JOIN m USING (symbol) WHERE d > greatest(0.05, 6 * md)),
i AS (SELECT *, sum(CASE WHEN bar_no - pb <= 30 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY bar_no) AS rn FROM f),
g AS (SELECT symbol, rn, min(ts) AS s, max(ts) AS e, count(*) AS bars, quantile_cont(d, 0.5) AS typical, arg_min(close, ts) AS c FROM i GROUP BY 1, 2)
SELECT symbol, {_e('s','start')}, {_e('e','"end"')}, bars, {r('typical','typical')}, CASE WHEN typical > 0.005 * c AND bars >= 10 THEN 'ROLL MISMATCH' ELSE 'CROSS-CHECK MISMATCH' END AS kind FROM g""")
def q_cross_check(spark, sf):
    x = Q.cross_check(V.bars1h(spark, sf), V.other_feed(spark, sf), 0.05)
    return x.select("symbol", _ep("start"), _ep("end"), "bars", tidy(F.col("typical")).alias("typical"), "kind")


_DIS = "(abs(b.close - o.close) > 0.05 OR abs(b.high - o.high) > 0.2 OR abs(b.low - o.low) > 0.2)"


@query("q_disagree", V.sql("bars1h", "other_feed") + f""", f AS (SELECT b.symbol, b.ts, lag(b.ts) OVER (PARTITION BY b.symbol ORDER BY b.ts) AS pt FROM bars1h b JOIN other_feed o USING (symbol, ts) WHERE {_DIS}),
i AS (SELECT *, sum(CASE WHEN epoch(ts) - epoch(pt) <= 30 * 3600 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM f)
SELECT symbol, {_e('min(ts)','start')}, {_e('max(ts)','"end"')}, count(*) AS bars FROM i GROUP BY symbol, rn""")
def q_disagree(spark, sf):
    return Q.disagreement_runs(V.bars1h(spark, sf), V.other_feed(spark, sf), 0.05, 0.2).select("symbol", _ep("start"), _ep("end"), "bars")


_CMP = f"""cm AS (SELECT b.symbol, b.day, count(*) AS bars, count(o.close) AS common, count(*) FILTER (abs(b.close - o.close) < 1e-6) AS eq, count(*) FILTER ({_DIS}) AS disagree
  FROM bars1h b LEFT JOIN other_feed o ON o.symbol = b.symbol AND o.ts = b.ts GROUP BY 1, 2),
idn AS (SELECT symbol, day, bars, common, CASE WHEN common >= 10 THEN eq / common END AS es, coalesce(CASE WHEN common >= 10 THEN eq / common END >= 0.9, false) AS same, disagree FROM cm)"""


@query("feed_compare", V.sql("bars1h", "other_feed") + f", {_CMP} SELECT symbol, CAST(day AS VARCHAR) AS day, bars, common, {r('es','equal_share')}, same AS same_contract, disagree FROM idn")
def feed_compare(spark, sf):
    x = Q.compare_feeds(V.bars1h(spark, sf), V.other_feed(spark, sf), 10, 0.05, 0.2)
    return x.withColumn("day", F.col("day").cast("string")).withColumn("equal_share", tidy(F.col("equal_share")))


def _filled(spark, sf):
    full, part = V.bars1h(spark, sf).select("symbol", "ts", "day", "contract", "open", "high", "low", "close", "volume"), V.other_feed(spark, sf)
    ident = Q.compare_feeds(part, full, 10, 0.05, 0.2)
    return Q.fill_gaps(part, full, ident), ident


_FILL = _CMP.replace("FROM bars1h b LEFT JOIN other_feed o", "FROM other_feed b LEFT JOIN bars1h o") + """,
fl AS (SELECT symbol, ts, day, NULL AS contract, open, close, false AS filled FROM other_feed UNION ALL SELECT b.symbol, b.ts, b.day, b.contract, b.open, b.close, true FROM bars1h b JOIN idn USING (symbol, day)
  WHERE same AND NOT EXISTS (SELECT 1 FROM other_feed o WHERE o.symbol = b.symbol AND o.ts = b.ts))"""


@query("gap_fill", V.sql("bars1h", "other_feed") + f", {_FILL} SELECT symbol, {_e('ts')}, open, close, filled FROM fl")
def gap_fill(spark, sf):
    return _filled(spark, sf)[0].select("symbol", _ep("ts"), "open", "close", "filled")


_VOL = """WITH RECURSIVE vol AS (SELECT event_type AS root, CAST(ts AS DATE) AS day, CAST(floor((dayofyear(CAST(ts AS DATE)) + user_id % 15) / 12) AS BIGINT) AS rank, count(*) AS volume FROM events GROUP BY 1, 2, 3),
dd AS (SELECT root, day, list({'v': volume, 'k': rank} ORDER BY volume DESC, rank DESC) AS cs, row_number() OVER (PARTITION BY root ORDER BY day) AS n FROM vol GROUP BY 1, 2),
st AS (SELECT root, n, day, cs[1].k AS cur FROM dd WHERE n = 1 UNION ALL
  SELECT s.root, d.n, d.day, coalesce(list_filter(d.cs, lambda c: c.k > s.cur AND c.v > coalesce(list_filter(d.cs, lambda z: z.k = s.cur)[1].v, 0))[1].k,
    CASE WHEN len(list_filter(d.cs, lambda z: z.k = s.cur)) = 0 THEN list_filter(d.cs, lambda z: z.k >= s.cur)[1].k END, s.cur) FROM st s JOIN dd d ON d.root = s.root AND d.n = s.n + 1)"""


@query("volume_roll", _VOL + " SELECT root, CAST(day AS VARCHAR) AS day, cur AS rank FROM st")
def volume_roll(spark, sf):
    return Q.volume_roll(V.contract_volumes(spark, sf)).withColumn("day", F.col("day").cast("string"))


def _composite(spark, sf):
    """Assembled once a session: candles and days are stored like an archive."""
    made = []

    def part(name):
        def build(spark, sf):
            if not made:
                feeds = [V.stored(f"feed_{i}", spark, sf, lambda spark, sf, i=i: V.contract_feeds(spark, sf)[i]) for i in range(3)]
                made.append(K.assemble(*feeds, minimum=10))
            return getattr(made[0], name)

        return V.stored(f"composite_{name}", spark, sf, build)

    return K.Composite(part("candles"), part("days"))


_MADE = """, lb AS (SELECT c.root, c.ts, list(k.rank) AS ranks FROM k_cont c JOIN k_contracts k USING (root, ts) WHERE abs(c.close - k.close) < 1e-6 GROUP BY 1, 2),
ci AS (SELECT c.*, lb.ranks, count(*) FILTER (lb.ranks IS NULL) OVER (PARTITION BY c.root, c.day) AS un, count(*) OVER (PARTITION BY c.root, c.day) AS nc FROM k_cont c LEFT JOIN lb USING (root, ts)),
cn AS (SELECT *, ranks IS NULL AND un < (1 - 0.9::DOUBLE) * nc AND un < nc AS noise FROM ci),
vk AS (SELECT root, day, rank, sum(volume) AS volume FROM k_contracts GROUP BY 1, 2, 3 UNION ALL SELECT root, day, -1, sum(volume) FROM cn WHERE ranks IS NULL AND NOT noise GROUP BY 1, 2),
dk AS (SELECT root, day, list({'v': volume, 'k': rank} ORDER BY volume DESC, rank DESC) AS cs, row_number() OVER (PARTITION BY root ORDER BY day) AS n FROM vk GROUP BY 1, 2),
us AS (SELECT root, n, day, cs[1].k AS cur, CAST(NULL AS BIGINT) AS was FROM dk WHERE n = 1 UNION ALL
  SELECT s.root, d.n, d.day, coalesce(list_filter(d.cs, lambda c: c.k > s.cur AND c.v > coalesce(list_filter(d.cs, lambda z: z.k = s.cur)[1].v, 0))[1].k, s.cur), s.cur FROM us s JOIN dk d ON d.root = s.root AND d.n = s.n + 1),
ch AS (SELECT k.root, k.ts, k.day, cur, contract, 'contract:' || contract AS source, open, high, low, close FROM k_contracts k JOIN us ON us.root = k.root AND us.day = k.day AND us.cur = k.rank
  UNION ALL SELECT c.root, c.ts, c.day, -1, NULL, 'continuous', open, high, low, close FROM cn c JOIN us ON us.root = c.root AND us.day = c.day AND us.cur = -1 WHERE ranks IS NULL AND NOT noise),
sh AS (SELECT c.root, c.day, max(c.contract) AS contract, max(cur) AS cur, count(s.close) AS common, count(*) FILTER (abs(c.close - s.close) < 1e-6) AS equal FROM ch c LEFT JOIN k_sample s USING (root, ts) GROUP BY 1, 2),
dy AS (SELECT *, CASE WHEN common < 10 THEN 'unknown' WHEN equal / common >= 0.9 THEN 'same' ELSE 'another' END AS sample FROM sh),
cd AS (SELECT c.root, c.ts, c.day, c.contract, c.source, c.close, CASE WHEN c.cur <> -1 AND (abs(c.close - n.close) > 1 OR abs(c.high - n.high) > 2 OR abs(c.low - n.low) > 2) THEN 'continuous'
    WHEN sample = 'same' AND (abs(c.close - s.close) > 1 OR abs(c.high - s.high) > 2 OR abs(c.low - s.low) > 2) THEN 'sample' END AS disagrees
  FROM ch c JOIN dy USING (root, day) LEFT JOIN (SELECT * FROM cn WHERE noise) n ON n.root = c.root AND n.ts = c.ts LEFT JOIN k_sample s ON s.root = c.root AND s.ts = c.ts
  UNION ALL SELECT s.root, s.ts, s.day, dy.contract, 'sample', s.close, NULL FROM k_sample s JOIN dy ON dy.root = s.root AND dy.day = s.day AND sample = 'same' WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.root = s.root AND ch.ts = s.ts)),
vf AS (SELECT DISTINCT c.root, c.day FROM cn c JOIN us ON us.root = c.root AND us.day = c.day WHERE list_contains(ranks, cur)),
dd AS (SELECT d.root, d.day, d.cur, d.contract, CASE WHEN d.cur = -1 THEN 'continuous' ELSE 'contract:' || d.contract END AS source, (SELECT count(*) FROM cd WHERE cd.root = d.root AND cd.day = d.day) AS bars, (SELECT count(*) FROM cd WHERE cd.root = d.root AND cd.day = d.day AND cd.source = 'sample') AS filled,
  (vf.root IS NOT NULL AND d.cur <> -1) OR sample = 'same' AS verified FROM dy d LEFT JOIN vf ON vf.root = d.root AND vf.day = d.day)"""
_COMPOSITE = V.sql("k_every", "k_contracts", "k_cont", "k_sample") + _MADE


@query("composite", _COMPOSITE + f" SELECT root, {_e('ts')}, CAST(day AS VARCHAR) AS day, contract, source, close, disagrees FROM cd")
def composite(spark, sf):
    """The assembled series: each candle with its contract, its source and who disagrees."""
    return _composite(spark, sf).candles.select("root", _ep("ts"), F.col("day").cast("string").alias("day"), "contract", "source", "close", "disagrees")


@query("composite_rolls", _COMPOSITE + """, rl AS (SELECT us.root, us.day, us.cur, was FROM us JOIN dd ON dd.root = us.root AND dd.day = us.day WHERE us.cur <> was)
SELECT r.root, CAST(r.day AS VARCHAR) AS day, CASE WHEN was <> -1 THEN 'K' || was END AS from_contract, 'K' || cur AS contract, n.volume, coalesce(o.volume, 0) AS from_volume
FROM rl r JOIN vk n ON n.root = r.root AND n.day = r.day AND n.rank = cur LEFT JOIN vk o ON o.root = r.root AND o.day = r.day AND o.rank = was""")
def composite_rolls(spark, sf):
    return _composite(spark, sf).rolls.withColumn("day", F.col("day").cast("string"))


@query("segments", _COMPOSITE + """, sb AS (SELECT *, CASE WHEN lag(source) OVER (PARTITION BY root ORDER BY day) = source THEN 0 ELSE 1 END AS nw FROM dd), sg AS (SELECT *, sum(nw) OVER (PARTITION BY root ORDER BY day) AS s FROM sb)
SELECT root, contract, source, CAST(min(day) AS VARCHAR) AS from_day, CAST(max(day) AS VARCHAR) AS to_day, CAST(sum(bars) AS BIGINT) AS bars, CAST(sum(filled) AS BIGINT) AS filled, count(*) FILTER (verified) AS verified_days FROM sg GROUP BY root, s, contract, source""")
def segments(spark, sf):
    return _composite(spark, sf).segments.withColumns({c: F.col(c).cast("string") for c in ("from_day", "to_day")})


@query("inspect_counts", V.sql("bars1h", "hours") + f""", {_ABN}, p AS (SELECT symbol, ts, lag(ts) OVER (PARTITION BY symbol, day ORDER BY ts) AS pt FROM bars1h),
ms AS (SELECT DISTINCT p.symbol, p.ts FROM p JOIN hours ON open AND t > pt AND t < ts WHERE epoch(ts) - epoch(pt) > 3600),
cr AS (SELECT symbol FROM (SELECT symbol, contract, lag(contract) OVER (PARTITION BY symbol ORDER BY ts) AS pc FROM bars1h) WHERE pc <> contract)
SELECT symbol, 'missing' AS kind, count(*) AS n FROM ms GROUP BY 1 UNION ALL SELECT symbol, 'abnormal', count(*) FROM ab GROUP BY 1 UNION ALL SELECT symbol, 'contract_roll', count(*) FROM cr GROUP BY 1 UNION ALL
SELECT symbol, 'suspect', count(*) FROM bars1h WHERE suspect GROUP BY 1""")
def inspect_counts(spark, sf):
    b = V.bars1h(spark, sf)
    return Q.inspect_counts({"missing": Q.missing_bars(b, STEP), "abnormal": Q.abnormal(b, STEP, **_TIGHT), "contract_roll": Q.contract_changes(b), "suspect": b.filter("suspect")}).select("symbol", "kind", "n")


@query("dataset_status", V.sql("bars1h") + """, g AS (SELECT symbol, CAST(epoch(TIMESTAMP '2024-01-31 15:00:00') - (epoch(max(ts)) + 3600) AS BIGINT) AS age FROM bars1h GROUP BY 1)
SELECT symbol, age, CASE WHEN age <= 900 + 3 * 3600 + 120 THEN 'DELAYED' ELSE 'HISTORICAL' END AS status FROM g""")
def dataset_status(spark, sf):
    return Q.dataset_status(V.bars1h(spark, sf), STEP, F.lit("2024-01-31 15:00:00").cast("timestamp"), delay=900).select("symbol", "age", "status")


@query("label_share", V.sql("bars1h") + f" SELECT symbol, count(*) AS bars, {r('count(contract) / count(*)','share')}, count(*) FILTER (contract = 'mixed') AS mixed, count(DISTINCT contract) AS contracts FROM bars1h GROUP BY 1")
def label_share(spark, sf):
    return Q.label_share(V.bars1h(spark, sf)).withColumn("share", tidy(F.col("share")))


@query("data_guard", V.sql("bars1h", "other_feed") + f""", g AS (SELECT b.symbol, count(*) FILTER (b.volume > 0) / count(*) AS vs, count(o.ts) / count(*) AS ps FROM bars1h b LEFT JOIN other_feed o ON o.symbol = b.symbol AND o.ts = b.ts GROUP BY 1)
SELECT symbol, {r('vs','volume_share')}, {r('ps','peer_share')}, CASE WHEN vs <= 0.5 THEN 'data: no volume' WHEN ps < 0.5 THEN 'data: peer missing' ELSE 'ok' END AS reason FROM g""")
def data_guard(spark, sf):
    return Q.data_guard(V.bars1h(spark, sf), V.other_feed(spark, sf)).withColumns({c: tidy(F.col(c)) for c in ("volume_share", "peer_share")})


@query("build_bars", V.sql("bars1h") + f" SELECT symbol, {_e('ts')}, CAST(day AS VARCHAR) AS day, contract, open, high, low, close, volume, suspect, bar_no, CAST(regime AS BIGINT) AS regime, after_gap, CAST(run AS BIGINT) AS run FROM bars1h")
def build_bars(spark, sf):
    """Ticks to flagged candles, from the raw table every time."""
    b = V.build_bars1h(spark, sf)
    return b.withColumn("ts", F.unix_seconds("ts")).withColumn("day", F.col("day").cast("string"))
