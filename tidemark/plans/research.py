"""Daily experiments: condition -> episodes -> outcomes -> statistics -> challenge, all symbols in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import tidy
from tidemark.operators import conditions as C
from tidemark.operators import episodes as E
from tidemark.operators import indicators as I
from tidemark.operators import robust as R
from tidemark.operators import study as S
from tidemark.plans import views as V
from tidemark.plans.registry import query, r

H, WARM, TH, WIN = 10, 5, 5, 5
FALL = {"fall": ("price_move", {"direction": "falls", "threshold": TH, "window": WIN})}


def _base(spark: SparkSession, sf: str) -> DataFrame:
    return C.evaluate(V.daily(spark, sf), FALL)


def _episodes(spark: SparkSession, sf: str, gap: int | None = 10, **kw) -> DataFrame:
    return E.episodes(_base(spark, sf), C.combine("fall"), H, WARM, gap, **kw)


def _outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Completed outcomes, stored once: every statistic reads the same few rows."""
    return V.stored("outcomes", spark, sf, lambda spark, sf: E.completed(_episodes(spark, sf)))


def _usual(spark: SparkSession, sf: str) -> DataFrame:
    """The baseline, stored once likewise."""
    return V.stored("baseline", spark, sf, lambda spark, sf: E.baseline(_base(spark, sf), H, WARM))


# Shared SQL: fwd (forward columns), cand, ep (greedy picks), out (completed outcomes), base (baseline).
_FWD_BODY = f"""gapn AS (SELECT *, sum(CASE WHEN date - pd > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY date) AS g
  FROM (SELECT *, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS pd FROM dn)),
fwd AS MATERIALIZED (SELECT *, lead(date, {H}) OVER w AS exit_date, lead(close, {H}) OVER w AS exit_price,
  lead(close, {H}) OVER w / close - 1 AS fr, close / lag(close, {WIN}) OVER w - 1 AS mv,
  coalesce(lead(g, {H}) OVER w, max(g) OVER (PARTITION BY symbol)) - coalesce(lag(g, {WARM}) OVER w, 0) > 0 AS gapped
  FROM gapn WINDOW w AS (PARTITION BY symbol ORDER BY date)),
cand AS (SELECT * FROM fwd WHERE mv <= -{TH/100} AND i >= {WARM}),
usable AS (SELECT symbol, i FROM cand WHERE exit_date IS NULL OR NOT gapped),
hop AS (SELECT symbol, i, min(i) OVER (PARTITION BY symbol ORDER BY i RANGE BETWEEN {H + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS j FROM usable),
ep AS (SELECT symbol, min(i) AS i FROM usable GROUP BY 1 UNION ALL SELECT e.symbol, h.j FROM ep e JOIN hop h USING (symbol, i) WHERE h.j IS NOT NULL),
eps AS (SELECT c.*, CASE WHEN exit_date IS NULL THEN 'pending' ELSE 'complete' END AS status,
  row_number() OVER (PARTITION BY c.symbol, c.exit_date IS NULL ORDER BY i) AS k
  FROM cand c JOIN ep USING (symbol, i)),
out AS MATERIALIZED (SELECT symbol, i, date, exit_date, fr AS v FROM eps WHERE status = 'complete'),
base AS MATERIALIZED (SELECT symbol, i, date, fr AS v FROM fwd WHERE i >= {WARM} AND exit_date IS NOT NULL AND NOT gapped)
"""
_FWD = V.sql("dn") + ", " + _FWD_BODY
_TT = ", ".join(f"({a}, {b})" for a, b in R.T_TABLE.items())
_T = f"""tt(df, t) AS (VALUES {_TT}),
tcrit AS MATERIALIZED (SELECT d AS df, CASE WHEN d > 120 THEN 1.960 ELSE coalesce(x.t, hi.t + (1.0 / d - 1.0 / hi.df) / (1.0 / lo.df - 1.0 / hi.df) * (lo.t - hi.t)) END AS t
  FROM range(1, 100001) q(d) LEFT JOIN tt x ON x.df = d ASOF LEFT JOIN tt lo ON d >= lo.df ASOF LEFT JOIN tt hi ON d <= hi.df)"""


def _summary_sql(src: str, name: str) -> str:
    return f"""{name}0 AS (SELECT symbol, count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, stddev_samp(v) AS std,
  count(*) FILTER (v > 0) AS positives, count(*) FILTER (v < 0) AS negatives, count(*) FILTER (v = 0) AS flat, min(v) AS mn, max(v) AS mx
  FROM {src} GROUP BY symbol),
{name} AS MATERIALIZED (SELECT s.*, t.t AS t_crit, std / sqrt(n) AS se, mean - t.t * std / sqrt(n) AS ci_low, mean + t.t * std / sqrt(n) AS ci_high
  FROM {name}0 s LEFT JOIN tcrit t ON t.df = s.n - 1)"""


_STATS = _FWD + ", " + _T + ", " + _summary_sql("out", "so") + ", " + _summary_sql("base", "sb")
_SUM_COLS = ["mean", "median", "std", "positive_rate", "negative_rate", "min", "max", "std_error", "t_crit", "ci_low", "ci_high"]
_SUM_SELECT = f"""SELECT symbol, n, positives, negatives, flat, {r('mean','mean')}, {r('median','median')}, {r('std','std')},
  {r('positives / n','positive_rate')}, {r('negatives / n','negative_rate')}, {r('mn','min')}, {r('mx','max')}, {r('se','std_error')},
  {r('t_crit','t_crit')}, {r('ci_low','ci_low')}, {r('ci_high','ci_high')}"""


def _tidy(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: tidy(F.col(c)) for c in cols})


def flagship(spark: SparkSession, sf: str, max_gap_days: int | None = 10) -> DataFrame:
    base = _base(spark, sf)
    out = E.completed(E.episodes(base, C.combine("fall"), H, WARM, max_gap_days))
    usual = R.summarize(E.baseline(base, H, WARM, max_gap_days), ["symbol"])
    usual = usual.select("symbol", F.col("mean").alias("baseline_mean"), F.col("median").alias("baseline_median"), F.col("n").alias("baseline_n"))
    s = R.summarize(out, ["symbol"]).join(usual, "symbol")
    s = s.withColumn("difference", F.col("mean") - F.col("baseline_mean")).withColumn("median_difference", F.col("median") - F.col("baseline_median"))
    cols = ["n", "mean", "median", "positive_rate", "ci_low", "ci_high", "baseline_n", "baseline_mean", "difference", "median_difference"]
    return _tidy(s.select("symbol", *cols), *[c for c in cols if not c.endswith("n") or c in ("mean", "median", "baseline_mean")])


@query("experiment", _STATS + f"""SELECT so.symbol, so.n, {r('so.mean','mean')}, {r('so.median','median')}, {r('so.positives / so.n','positive_rate')},
  {r('so.ci_low','ci_low')}, {r('so.ci_high','ci_high')}, sb.n AS baseline_n, {r('sb.mean','baseline_mean')}, {r('so.mean - sb.mean','difference')},
  {r('so.median - sb.median','median_difference')} FROM so JOIN sb USING (symbol)""")
def experiment(spark, sf):
    return flagship(spark, sf)


@query("episodes", _FWD + f"""SELECT symbol, i, CAST(date AS VARCHAR) AS date, status, CAST(exit_date AS VARCHAR) AS exit_date FROM eps WHERE status = 'complete' OR k = 1""")
def episodes(spark, sf):
    e = _episodes(spark, sf).filter("i is not null")
    return e.select("symbol", "i", F.col("date").cast("string").alias("date"), "status", F.col("exit_date").cast("string").alias("exit_date"))


@query("outcomes", _FWD + f"""SELECT symbol, i, {r('close','entry_price')}, {r('exit_price','exit_price')}, {r('fr','forward_return')}, n - 1 - i AS elapsed,
  path_len, {r('low_path','low_path')} FROM eps LEFT JOIN LATERAL (SELECT CASE WHEN eps.status = 'complete' THEN count(*) END AS path_len,
  CASE WHEN eps.status = 'complete' THEN min(d.close) / eps.close - 1 END AS low_path FROM dn d
  WHERE d.symbol = eps.symbol AND d.i BETWEEN eps.i AND eps.i + {H}) ON true WHERE status = 'complete' OR k = 1""")
def outcomes(spark, sf):
    e = _episodes(spark, sf, with_path=True).filter("i is not null")
    e = e.select("symbol", "i", F.col("close").alias("entry_price"), "exit_price", "forward_return", F.col("elapsed").cast("long").alias("elapsed"),
                 F.when(F.col("path").isNotNull(), F.size("path")).cast("long").alias("path_len"), F.array_min("path").alias("low_path"))
    return _tidy(e, "entry_price", "exit_price", "forward_return", "low_path")


@query("summarize", _STATS + _SUM_SELECT + " FROM so")
def summarize(spark, sf):
    return _tidy(R.summarize(_outcomes(spark, sf), ["symbol"]), *_SUM_COLS)


@query("baseline", _STATS + _SUM_SELECT + " FROM sb")
def baseline(spark, sf):
    return _tidy(R.summarize(E.baseline(_base(spark, sf), H, WARM), ["symbol"]), *_SUM_COLS)


@query("t_interval", _STATS + f"SELECT symbol, n, {r('t_crit','t_crit')}, {r('ci_low','ci_low')}, {r('ci_high','ci_high')} FROM so UNION ALL "
       f"SELECT symbol || ' all', n, {r('t_crit','t_crit')}, {r('ci_low','ci_low')}, {r('ci_high','ci_high')} FROM sb")
def t_interval(spark, sf):
    cols = ["symbol", "n", "t_crit", "ci_low", "ci_high"]
    a = R.summarize(_outcomes(spark, sf), ["symbol"]).select(*cols)
    b = R.summarize(E.baseline(_base(spark, sf), H, WARM), ["symbol"]).withColumn("symbol", F.concat("symbol", F.lit(" all"))).select(*cols)
    return _tidy(a.unionByName(b), "t_crit", "ci_low", "ci_high")


_PCT = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}


@query("percentiles", _FWD + "SELECT symbol, count(*) AS n, " + ", ".join(r(f"quantile_cont(v, {p})", n) for n, p in _PCT.items()) + " FROM base GROUP BY symbol")
def percentiles(spark, sf):
    return _tidy(R.percentiles(E.baseline(_base(spark, sf), H, WARM), ["symbol"], _PCT), *_PCT)


_RANK = """rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY v) AS rn, count(*) OVER (PARTITION BY symbol) AS c FROM out),
kk AS (SELECT *, CASE WHEN floor(c * 0.05) < 1 AND c >= 10 THEN 1 ELSE CAST(floor(c * 0.05) AS BIGINT) END AS k FROM rk)"""


@query("trimmed_mean", _FWD + f""", {_RANK} SELECT symbol, {r('avg(v) FILTER (rn > k AND rn <= c - k AND k >= 1 AND c - 2 * k >= 2)','trimmed_mean')},
  max(CASE WHEN k >= 1 AND c - 2 * k >= 2 THEN k ELSE 0 END) AS each_side FROM kk GROUP BY symbol""")
def trimmed_mean(spark, sf):
    return _tidy(R.trimmed_mean(_outcomes(spark, sf), ["symbol"]), "trimmed_mean")


@query("winsorized_mean", _FWD + f""", {_RANK}, ends AS (SELECT symbol, max(v) FILTER (rn = k + 1) AS lo, max(v) FILTER (rn = c - k) AS hi FROM kk GROUP BY 1)
SELECT symbol, {r('avg(least(greatest(v, lo), hi)) FILTER (k >= 1 AND c - 2 * k >= 2)','winsorized_mean')},
  max(CASE WHEN k >= 1 AND c - 2 * k >= 2 THEN k ELSE 0 END) AS each_side FROM kk JOIN ends USING (symbol) GROUP BY symbol""")
def winsorized_mean(spark, sf):
    return _tidy(R.winsorized_mean(_outcomes(spark, sf), ["symbol"]), "winsorized_mean")


_EXTREME = """md AS (SELECT *, abs(v - quantile_cont(v, 0.5) OVER (PARTITION BY symbol)) AS d FROM out),
xt AS MATERIALIZED (SELECT symbol, count(*) AS n, arg_max(v, (d, -i)) AS ev, arg_max(i, (d, -i)) AS ei, sum(v) AS s, min(v) AS lo, max(v) AS hi FROM md GROUP BY 1)"""


@query("extreme_removed", _FWD + f""", {_EXTREME} SELECT symbol, n, {r('ev','extreme_value')}, ei AS extreme_at, {r('(s - ev) / nullif(n - 1, 0)','mean_without_extreme')},
  CASE WHEN n >= 5 THEN round((s - lo - hi) / (n - 2) + 1e-9, 6) + 0.0 END AS mean_without_both FROM xt""")
def extreme_removed(spark, sf):
    return _tidy(R.without_extremes(_outcomes(spark, sf), ["symbol"], "i"), "extreme_value", "mean_without_extreme", "mean_without_both")


@query("bootstrap_ci", _FWD + f""", o AS (SELECT symbol, v, row_number() OVER (PARTITION BY symbol ORDER BY i) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM out),
sz AS (SELECT DISTINCT symbol, n FROM o WHERE n >= 5),
dr AS (SELECT symbol, n, b, ('0x' || substr(md5('7|' || b || '|' || j), 1, 15))::BIGINT % n AS p FROM sz, range(0, 2000) x(b), LATERAL (SELECT unnest(range(0, n)) AS j)),
st AS (SELECT dr.symbol, dr.n, b, avg(v) AS m, quantile_cont(v, 0.5) AS d FROM dr JOIN o ON o.symbol = dr.symbol AND o.p = dr.p GROUP BY 1, 2, 3)
SELECT symbol, n, {r('quantile_cont(m, 0.025)','mean_low')}, {r('quantile_cont(m, 0.975)','mean_high')}, {r('quantile_cont(d, 0.025)','median_low')},
  {r('quantile_cont(d, 0.975)','median_high')} FROM st GROUP BY 1, 2""")
def bootstrap_ci(spark, sf):
    return _tidy(R.bootstrap_ci(_outcomes(spark, sf), ["symbol"], "i"), "mean_low", "mean_high", "median_low", "median_high")


@query("contribution", _FWD + f""", sd AS (SELECT symbol, CASE WHEN v > 0 THEN 'gain' ELSE 'loss' END AS side, v,
  row_number() OVER (PARTITION BY symbol, v > 0 ORDER BY abs(v) DESC) AS rk FROM out WHERE v <> 0)
SELECT symbol, side, count(*) AS n, {r('sum(v)','total')}, """ + ", ".join(
    f"CASE WHEN count(*) > {k} THEN round(sum(v) FILTER (rk <= {k}) / sum(v) + 1e-9, 6) + 0.0 END AS top{k}_share" for k in (1, 3, 5)
) + f", {r('sum(v) FILTER (rk = 1) / sum(v)','largest_share')} FROM sd GROUP BY 1, 2")
def contribution(spark, sf):
    return _tidy(R.contribution(_outcomes(spark, sf), ["symbol"]), "total", "top1_share", "top3_share", "top5_share", "largest_share")


@query("rolling_episodes", _FWD + f""", o AS (SELECT *, row_number() OVER w AS rn, avg(v) OVER f AS m, quantile_cont(v, 0.5) OVER f AS md,
  sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) OVER f / 20 AS pr FROM out WINDOW w AS (PARTITION BY symbol ORDER BY i), f AS (PARTITION BY symbol ORDER BY i ROWS 19 PRECEDING))
SELECT symbol, i, {r('m','mean')}, {r('md','median')}, {r('pr','positive_rate')} FROM o WHERE rn >= 20""")
def rolling_episodes(spark, sf):
    return _tidy(R.rolling_outcomes(_outcomes(spark, sf), ["symbol"], "i"), "mean", "median", "positive_rate")


@query("robustness_checks", _STATS + f""", {_RANK}, {_EXTREME}, tm AS MATERIALIZED (SELECT symbol, avg(v) FILTER (rn > k AND rn <= c - k AND k >= 1 AND c - 2 * k >= 2) AS tm FROM kk GROUP BY 1),
ha AS MATERIALIZED (SELECT symbol, avg(v) FILTER (p <= n // 2) AS h1, avg(v) FILTER (p > n // 2) AS h2, avg(v) AS m FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS p,
  count(*) OVER (PARTITION BY symbol) AS n FROM out) GROUP BY 1),
ye AS (SELECT symbol, count(*) AS years, count(*) FILTER ((ym > 0) = (m > 0)) AS agree FROM (SELECT symbol, year(date) AS y, avg(v) AS ym FROM out GROUP BY 1, 2) JOIN ha USING (symbol) GROUP BY 1),
ga AS (SELECT symbol, max(v) FILTER (v > 0) / sum(v) FILTER (v > 0) AS gs FROM out GROUP BY 1),
al AS (SELECT so.*, tm, h1, h2, years, agree, gs, (s - ev) / nullif(xt.n - 1, 0) AS mx1, sb.mean AS bm FROM so JOIN tm USING (symbol) JOIN xt USING (symbol) JOIN ha USING (symbol)
  JOIN ye USING (symbol) JOIN ga USING (symbol) JOIN sb USING (symbol))
SELECT symbol, chk AS "check", ok, CASE WHEN n >= 10 AND years >= 3 THEN agree END AS years_agree FROM (
  SELECT symbol, n, years, agree, unnest(['sample','mean_median','trimmed_sign','single_episode','largest_gain','halves','baseline']) AS chk, unnest([
    n >= 30, (mean > 0) = (median > 0) OR mean = 0 OR median = 0, CASE WHEN tm IS NOT NULL THEN (tm > 0) = (mean > 0) END,
    CASE WHEN mx1 IS NOT NULL AND mean <> 0 THEN NOT (abs(mx1 - mean) > greatest(0.25 * abs(mean), 0.002)) END,
    CASE WHEN gs IS NOT NULL AND mean > 0 THEN gs < 0.25 END, CASE WHEN n >= 10 THEN (h1 > 0) = (h2 > 0) END,
    CASE WHEN ci_low IS NOT NULL AND bm IS NOT NULL THEN NOT (bm BETWEEN ci_low AND ci_high) END]) AS ok FROM al)""")
def robustness_checks(spark, sf):
    base = R.summarize(_usual(spark, sf), ["symbol"]).select("symbol", F.col("mean").alias("baseline_mean"))
    return R.robustness_checks(_outcomes(spark, sf), ["symbol"], "i", "trigger_date", base)


# --- challenge: the same rule under other parameters, periods and samples ------------------------------

_GRID_TH, _GRID_WIN = (4.0, 5.0, 6.0), (3, 5, 8)
_GRID_SQL = V.sql("dn") + f""", cells AS (SELECT th, win FROM (VALUES (4.0), (5.0), (6.0)) a(th), (VALUES (3), (5), (8)) b(win)),
mv AS (SELECT symbol, i, n, date, close, lead(close, {H}) OVER w / close - 1 AS fr, close / lag(close, 3) OVER w - 1 AS m3, close / lag(close, 5) OVER w - 1 AS m5,
  close / lag(close, 8) OVER w - 1 AS m8 FROM dn WINDOW w AS (PARTITION BY symbol ORDER BY date)),
q AS (SELECT th, win, symbol, i, fr FROM mv, cells WHERE i >= win AND (CASE win WHEN 3 THEN m3 WHEN 5 THEN m5 ELSE m8 END) <= -th / 100),
hop AS (SELECT th, win, symbol, i, min(i) OVER (PARTITION BY th, win, symbol ORDER BY i RANGE BETWEEN {H + 1} FOLLOWING AND UNBOUNDED FOLLOWING) AS j FROM q),
ep AS (SELECT th, win, symbol, min(i) AS i FROM q GROUP BY 1, 2, 3 UNION ALL
  SELECT e.th, e.win, e.symbol, h.j FROM ep e JOIN hop h USING (th, win, symbol, i) WHERE h.j IS NOT NULL),
cell AS (SELECT th, win, symbol, count(*) AS n, avg(fr) AS mean, quantile_cont(fr, 0.5) AS median FROM ep JOIN q USING (th, win, symbol, i) WHERE fr IS NOT NULL GROUP BY 1, 2, 3),
cb AS (SELECT symbol, win, avg(fr) AS bm FROM mv, (VALUES (3), (5), (8)) b(win) WHERE i >= win AND fr IS NOT NULL GROUP BY 1, 2)
"""


@query("neighbours", _GRID_SQL + f"SELECT symbol, CAST(th AS DOUBLE) AS threshold, win AS \"window\", n, {r('mean','mean')}, {r('median','median')}, {r('mean - bm','difference')} FROM cell JOIN cb USING (symbol, win)")
def neighbours(spark, sf):
    return _tidy(S.neighbour_grid(V.daily(spark, sf), _GRID_TH, _GRID_WIN, H), "mean", "median", "difference")


@query("param_grid", _GRID_SQL + """, g AS (SELECT c.symbol, c.th, c.win, c.n, c.mean - cb.bm AS diff FROM cell c JOIN cb ON cb.symbol = c.symbol AND cb.win = c.win),
centre AS (SELECT symbol, diff AS cd FROM g WHERE th = 5 AND win = 5)
SELECT g.symbol, count(*) FILTER (n >= 10) AS cells, count(*) FILTER (n >= 10 AND (diff > 0) = (cd > 0)) AS agree,
  coalesce(count(*) FILTER (n >= 10 AND (diff > 0) = (cd > 0)) >= 0.75 * count(*) FILTER (n >= 10) AND count(*) FILTER (n >= 10) > 0, false) AS stable
  FROM g JOIN centre ON g.symbol = centre.symbol GROUP BY g.symbol""")
def param_grid(spark, sf):
    return S.grid_agreement(S.neighbour_grid(V.daily(spark, sf), _GRID_TH, _GRID_WIN, H), 5.0, 5)


_SPLIT = f"""o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY i) AS p, count(*) OVER (PARTITION BY symbol) AS c FROM out),
ph AS (SELECT symbol, CASE WHEN p <= c // 2 THEN 1 ELSE 2 END AS half, c, v, date FROM o),
hs AS (SELECT symbol, half, max(c) AS c, count(*) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, min(date) AS d0, max(date) AS d1 FROM ph GROUP BY 1, 2),
hb AS (SELECT h.symbol, h.half, avg(b.v) AS bm FROM hs h JOIN base b ON b.symbol = h.symbol AND b.date BETWEEN h.d0 AND h.d1 GROUP BY 1, 2)"""


@query("time_split", _FWD + f""", {_SPLIT} SELECT symbol, half, n, CAST(d0 AS VARCHAR) AS first_date, CAST(d1 AS VARCHAR) AS last_date, {r('mean','mean')}, {r('median','median')},
  {r('bm','baseline_mean')}, {r('mean - bm','difference')}, n >= 8 AS enough FROM hs JOIN hb USING (symbol, half)""")
def time_split(spark, sf):
    t = S.time_split(_outcomes(spark, sf), _usual(spark, sf))
    return _tidy(t.withColumns({c: F.col(c).cast("string") for c in ("first_date", "last_date")}), "mean", "median", "baseline_mean", "difference")


@query("recency", _FWD + f""", lastd AS (SELECT symbol, max(date) AS m FROM dn GROUP BY 1),
per AS (SELECT symbol, label, v FROM out JOIN lastd USING (symbol), (VALUES ('full', 1000000), ('last_5y', 1826), ('last_3y', 1095)) p(label, days) WHERE date >= m - CAST(days AS INTEGER))
SELECT symbol, label AS period, count(*) AS n, {r('avg(v)','mean')}, {r('quantile_cont(v, 0.5)','median')}, {r('count(*) FILTER (v > 0) / count(*)','positive_rate')} FROM per GROUP BY 1, 2""")
def recency(spark, sf):
    return _tidy(S.recency(_outcomes(spark, sf), V.daily(spark, sf)), "mean", "median", "positive_rate")


_OUTL = f""", {_RANK}, {_EXTREME}, wz AS (SELECT symbol, max(v) FILTER (rn = k + 1) AS lo, max(v) FILTER (rn = c - k) AS hi FROM kk GROUP BY 1),
ol AS (SELECT symbol, avg(v) AS mean, quantile_cont(v, 0.5) AS median, avg(v) FILTER (rn > k AND rn <= c - k AND k >= 1 AND c - 2 * k >= 2) AS trimmed,
  avg(least(greatest(v, lo), hi)) FILTER (k >= 1 AND c - 2 * k >= 2) AS winsorized FROM kk JOIN wz USING (symbol) GROUP BY 1),
orow AS (SELECT symbol, unnest(['mean','median','trimmed','winsorized','without_extreme','without_both']) AS label,
  unnest([mean, median, trimmed, winsorized, (s - ev) / nullif(n - 1, 0), CASE WHEN n >= 5 THEN (s - lo - hi) / (n - 2) END]) AS value FROM ol JOIN xt USING (symbol))"""


@query("outliers", _FWD + _OUTL + f" SELECT symbol, label, {r('value','value')} FROM orow")
def outliers(spark, sf):
    return _tidy(S.outlier_rows(_outcomes(spark, sf)), "value")


@query("challenge", _FWD + _OUTL + f""", {_SPLIT}, dd AS (SELECT symbol, half, n, mean - bm AS d FROM hs JOIN hb USING (symbol, half)),
ts AS (SELECT symbol, CASE WHEN min(n) >= 8 AND count(*) = 2 THEN (max(d) FILTER (half = 1) > 0) = (max(d) FILTER (half = 2) > 0) END AS ok FROM dd GROUP BY 1),
lastd AS (SELECT symbol, max(date) AS m FROM dn GROUP BY 1),
rc AS (SELECT symbol, CASE WHEN count(*) FILTER (date >= m - 1826) >= 8 THEN (avg(v) > 0) = (avg(v) FILTER (date >= m - 1826) > 0) END AS ok FROM out JOIN lastd USING (symbol) GROUP BY 1),
oo AS (SELECT symbol, bool_and((value > 0) = (mv > 0)) AS ok FROM orow JOIN (SELECT symbol, avg(v) AS mv FROM out GROUP BY 1) USING (symbol) WHERE value IS NOT NULL GROUP BY 1),
rows AS (SELECT symbol, 'time_split' AS chk, ok FROM ts UNION ALL SELECT symbol, 'recency', ok FROM rc UNION ALL SELECT symbol, 'outliers', ok FROM oo)
SELECT symbol, chk AS "check", CASE WHEN ok THEN 'survived' WHEN NOT ok THEN 'caution' ELSE 'too few' END AS verdict FROM rows""")
def challenge(spark, sf):
    return S.challenge(_outcomes(spark, sf), _usual(spark, sf), V.daily(spark, sf))


_PREVIEW = V.sql("dn") + """, cc AS (SELECT symbol, i, close / lag(close, 5) OVER w - 1 <= -0.05 AS c1,
  CASE WHEN i >= 19 THEN close < avg(close) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) END AS c2,
  CASE WHEN avg(volume) OVER p > 0 AND i >= 20 THEN volume / avg(volume) OVER p > 1 END AS c3
  FROM dn WINDOW w AS (PARTITION BY symbol ORDER BY date), p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""
_THREE = {"c1": ("price_move", {"direction": "falls", "threshold": 5, "window": 5}), "c2": ("ma_position", {"op": "below", "period": 20}),
          "c3": ("relative_volume", {"op": "above", "multiple": 1, "lookback": 20})}


@query("preview", _PREVIEW + """ SELECT symbol, 1 AS step, count(*) FILTER (c1) AS bars FROM cc GROUP BY 1 UNION ALL
  SELECT symbol, 2, count(*) FILTER (c1 AND c2) FROM cc GROUP BY 1 UNION ALL SELECT symbol, 3, count(*) FILTER (c1 AND c2 AND c3) FROM cc GROUP BY 1""")
def preview(spark, sf):
    return S.preview(C.evaluate(V.daily(spark, sf), _THREE), list(_THREE))


_LOGIC = {"op": "AND", "items": ["c1", {"op": "OR", "items": ["c2", "c3"]}]}


@query("combine_logic", _PREVIEW + " SELECT symbol, i, coalesce(c1, false) AND (coalesce(c2, false) OR coalesce(c3, false)) AS holds FROM cc")
def combine_logic(spark, sf):
    C.check_logic(_LOGIC, _THREE)
    return C.evaluate(V.daily(spark, sf), _THREE).select("symbol", F.col("i").cast("long").alias("i"), C.combine(_LOGIC).alias("holds"))


@query("warmup", V.sql("dn") + """, t AS (SELECT symbol, n, count(*) FILTER (i >= 20) AS tested FROM dn GROUP BY 1, 2)
SELECT symbol, n, 20 AS warm, tested, CASE WHEN n < 20 + 10 + 20 THEN 'too little history' WHEN tested < 15 THEN 'range too short' ELSE 'ok' END AS status FROM t""")
def warmup(spark, sf):
    return S.history_guard(V.daily(spark, sf), C.warmup(_THREE), H)


@query("gap_mask", _FWD + "SELECT symbol, i, gapped FROM fwd")
def gap_mask(spark, sf):
    return E.with_forward(V.daily(spark, sf), H, WARM).select("symbol", F.col("i").cast("long").alias("i"), "gapped")


@query("slice_period", V.sql("daily") + """, m AS (SELECT *, max(date) OVER (PARTITION BY symbol) AS mx FROM daily)
SELECT symbol, label AS period, count(*) AS n, CAST(min(date) AS VARCHAR) AS first_date FROM m, (VALUES ('1M', 30), ('1Y', 365), ('5Y', 1826), ('MAX', 1000000)) p(label, days)
WHERE date >= mx - CAST(days AS INTEGER) GROUP BY 1, 2""")
def slice_period(spark, sf):
    return S.period_sizes(V.daily(spark, sf), {"1M": 30, "1Y": 365, "5Y": 1826, "MAX": 1_000_000})


@query("variants_tried", """WITH runs AS (SELECT o_orderpriority AS project, (o_custkey % 7) || '|' || o_orderstatus AS rules, CASE WHEN o_orderkey % 5 = 0 THEN 9 ELSE 1 END AS combos,
  o_orderkey % 11 = 0 AS relaxed FROM orders) SELECT project, count(*) AS runs, count(DISTINCT sha1(rules)) AS distinct_rules, CAST(sum(combos) AS BIGINT) AS variants, count(*) FILTER (relaxed) AS relaxations FROM runs GROUP BY 1""")
def variants_tried(spark, sf):
    o = V.table(spark, sf, "orders")
    runs = o.select(F.col("o_orderpriority").alias("project"), F.concat_ws("|", F.col("o_custkey") % 7, "o_orderstatus").alias("rules"),
                    F.when(F.col("o_orderkey") % 5 == 0, 9).otherwise(1).alias("combos"), (F.col("o_orderkey") % 11 == 0).alias("relaxed"))
    return S.variants_tried(runs)


@query("rules_hash", """SELECT event_id, sha1('{"day":"' || strftime(ts, '%Y-%m-%d') || '","props":' || CAST(to_json(props) AS VARCHAR) || ',"type":' || CAST(to_json(event_type) AS VARCHAR) || '}') AS hash FROM events""")
def rules_hash(spark, sf):
    e = V.table(spark, sf, "events")
    rules = e.select("event_id", F.create_map(F.lit("type"), F.col("event_type"), F.lit("props"), F.col("props"), F.lit("day"), F.to_date("ts").cast("string")).alias("rules"))
    return rules.select("event_id", S.rules_hash(F.col("rules")).alias("hash"))


@query("bench_return", _FWD + f""", b AS (SELECT date, close FROM daily WHERE symbol = '1-URGENT')
SELECT o.symbol, o.i, {r('b1.close / b0.close - 1','benchmark_return')} FROM out o LEFT JOIN b b0 ON b0.date = o.date LEFT JOIN b b1 ON b1.date = o.exit_date""")
def bench_return(spark, sf):
    bench = V.daily(spark, sf).filter("symbol = '1-URGENT'").select("date", "close")
    return _tidy(S.benchmark_return(_outcomes(spark, sf), bench).select("symbol", "i", "benchmark_return"), "benchmark_return")


@query("outlier_sensitivity", _FWD + f""", d AS (SELECT symbol, v, row_number() OVER (PARTITION BY symbol ORDER BY v DESC) AS rk, count(*) OVER (PARTITION BY symbol) AS n FROM out)
SELECT symbol, n, {r('avg(v)','mean')}, {r('avg(v) FILTER (rk > 1)','without_best')}, {r('avg(v) FILTER (rk > ceil(n * 0.1))','without_top10')} FROM d GROUP BY 1, 2""")
def outlier_sensitivity(spark, sf):
    return _tidy(S.without_best(_outcomes(spark, sf)), "mean", "without_best", "without_top10")
