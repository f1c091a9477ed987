"""Reported facts, earnings and guidance derived from line items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.maths import tidy
from tidemark.operators import conditions as C
from tidemark.operators import facts as X
from tidemark.operators import indicators as I
from tidemark.plans import views as V
from tidemark.plans.registry import query, r


def build_quarter_sums(spark, sf):
    """The only pass over the line items: sums per supplier, flag and quarter."""
    li = V.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("tag"), F.trunc("l_shipdate", "quarter").alias("quarter")).agg(F.sum("l_extendedprice").alias("s"))


def _series(df):
    """One reporting series per supplier and flag, with a key of its own."""
    return df.withColumn("entity", F.col("entity") * 4 + F.when(F.col("tag") == "A", 0).when(F.col("tag") == "N", 1).otherwise(2))


def items(spark, sf):
    """Quarterly and annual sums per supplier and return flag; flag R lacks its fourth quarters, some years are restated."""
    sums = V.stored("quarter_sums", spark, sf, build_quarter_sums)

    def by(unit, months, lag, form):
        g = sums.groupBy("entity", "tag", F.trunc("quarter", unit).alias("start")).agg(F.round(F.sum("s"), 2).alias("val"))
        end = F.date_sub(F.add_months("start", months), 1)
        return g.select("entity", "tag", "start", end.alias("end"), "val", F.lit(form).alias("form"), F.date_add(end, lag).alias("filed"))

    q = by("quarter", 3, 40, "10-Q").filter((F.col("tag") != "R") | (F.month("end") != 12))
    a = by("year", 12, 60, "10-K")
    again = a.filter("entity % 3 = 0").withColumn("val", F.round(F.col("val") * 1.01 + 1e-6, 2)).withColumn("filed", F.date_add("filed", 365))
    return q.unionByName(a).unionByName(again)


_ITEMS = """li AS (SELECT l_suppkey AS entity, l_returnflag AS tag, CAST(l_shipdate AS DATE) AS d, l_extendedprice AS p FROM lineitem),
iq AS (SELECT entity, tag, CAST(date_trunc('quarter', d) AS DATE) AS st, round(sum(p), 2) AS val FROM li GROUP BY 1, 2, 3), ia AS (SELECT entity, tag, CAST(date_trunc('year', d) AS DATE) AS st, round(sum(p), 2) AS val FROM li GROUP BY 1, 2, 3),
i1 AS (SELECT entity, tag, st, CAST(st + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS en, val, '10-Q' AS form, 40 AS lg FROM iq UNION ALL SELECT entity, tag, st, CAST(st + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE), val, '10-K', 60 FROM ia
  UNION ALL SELECT entity, tag, st, CAST(st + INTERVAL 1 YEAR - INTERVAL 1 DAY AS DATE), round(val * 1.01 + 1e-6, 2), '10-K', 425 FROM ia WHERE entity % 3 = 0),
it AS (SELECT *, en + lg AS filed FROM i1 WHERE NOT (form = '10-Q' AND tag = 'R' AND month(en) = 12))"""
_IT = "WITH RECURSIVE " + _ITEMS
_CODE = "CASE tag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END"
_LF = _IT + f""", lf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, tag, en ORDER BY filed DESC, val DESC) AS rn FROM it WHERE en - st BETWEEN 350 AND 380) WHERE rn = 1), lfs AS (SELECT entity * 4 + {_CODE} AS entity, st, en, val, filed FROM lf)"""


@query("flatten_facts", _IT + f" SELECT entity, tag, 'USD' AS unit, CAST(st AS VARCHAR) AS start, CAST(en AS VARCHAR) AS \"end\", {r('val','val',2)}, form, CAST(filed AS VARCHAR) AS filed FROM it")
def flatten_facts(spark, sf):
    """Items nested per supplier as facts JSON (a supplier's periods are few) and flattened back."""
    i = items(spark, sf)
    s = F.struct(F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "val", "form", F.col("filed").cast("string").alias("filed"), F.lit("").alias("accn"))
    per_tag = i.groupBy("entity", "tag").agg(F.create_map(F.lit("USD"), F.collect_list(s)).alias("units"))
    js = per_tag.groupBy("entity").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("tag", F.struct("units"))))).alias("facts"))
    x = X.flatten_facts(js)
    return x.select("entity", "tag", "unit", "start", "end", tidy(F.col("val"), 2).alias("val"), "form", "filed")


@query("annual_values", _LF + f" SELECT entity, tag, CAST(en AS VARCHAR) AS \"end\", {r('val','val',2)}, CAST(filed AS VARCHAR) AS filed FROM lf")
def annual_values(spark, sf):
    x = X.latest_filed(items(spark, sf), X.ANNUAL_DAYS)
    return x.select("entity", "tag", F.col("end").cast("string").alias("end"), tidy(F.col("val"), 2).alias("val"), F.col("filed").cast("string").alias("filed"))


def _quarters(spark, sf):
    return X.quarters_with_q4(_series(items(spark, sf)))


_Q4 = _IT + f""", its AS (SELECT entity * 4 + {_CODE} AS entity, st, en, val, filed FROM it), qx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, en ORDER BY val DESC, filed DESC) AS rn FROM its WHERE en - st BETWEEN 80 AND 100) WHERE rn = 1),
ax AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, en ORDER BY val DESC, filed DESC) AS rn FROM its WHERE en - st BETWEEN 350 AND 380) WHERE rn = 1),
dv AS (SELECT a.entity, a.en, a.val - sum(q.val) AS val FROM ax a JOIN qx q ON q.entity = a.entity AND q.st >= a.st AND q.en <= a.en GROUP BY a.entity, a.en, a.val HAVING count(*) = 3),
qs AS (SELECT entity, en, val, false AS derived FROM qx UNION ALL SELECT entity, en, val, true FROM dv WHERE NOT EXISTS (SELECT 1 FROM qx WHERE qx.entity = dv.entity AND qx.en = dv.en))"""


@query("derive_q4", _Q4 + f" SELECT entity, CAST(en AS VARCHAR) AS \"end\", {r('val','val',2)}, derived FROM qs")
def derive_q4(spark, sf):
    return _quarters(spark, sf).select("entity", F.col("end").cast("string").alias("end"), tidy(F.col("val"), 2).alias("val"), "derived")


def _annual(spark, sf, tag=None):
    """Annual values of every series, or of the suppliers under one flag."""
    x = items(spark, sf)
    x = X.latest_filed(x if tag is None else x.filter(F.col("tag") == tag), X.ANNUAL_DAYS)
    return (_series(x) if tag is None else x).select("entity", F.col("end").alias("date"), F.col("val").alias("value"))


def _sources(spark, sf):
    """Two sources of the annual values; each lacks some periods, and every period is in one of them at least."""
    a = _annual(spark, sf)
    n = F.col("entity") + F.year("date")
    first = a.filter(n % 5 != 0)
    second = a.filter((n % 4 != 0) | (n % 5 == 0)).select("entity", F.expr("date_sub(date, cast(entity % 15 as int))").alias("date"), F.round(F.col("value") * (1 + (F.col("entity") % 5 - 2) * 0.02) + 1e-6, 2).alias("value"))
    return first, second


_MH = _LF + """, s1 AS (SELECT entity, en AS date, val AS value FROM lfs WHERE (entity + year(en)) % 5 <> 0), s2 AS (SELECT entity, en - CAST(entity % 15 AS INTEGER) AS date, round(val * (1 + (entity % 5 - 2) * 0.02) + 1e-6, 2) AS value FROM lfs WHERE (entity + year(en)) % 4 <> 0 OR (entity + year(en)) % 5 = 0),
mm AS (SELECT s1.entity, s1.date, s1.value, s2.date AS d2, s2.value AS v2 FROM s1 LEFT JOIN s2 ON s2.entity = s1.entity AND abs(s2.date - s1.date) <= 10),
mg AS (SELECT entity, date, value, 'first' AS source, CASE WHEN abs(value - v2) / greatest(abs(value), abs(v2)) > 0.02 THEN v2 END AS conflict FROM mm UNION ALL SELECT entity, date, value, 'second', NULL FROM s2 WHERE NOT EXISTS (SELECT 1 FROM mm WHERE mm.entity = s2.entity AND mm.d2 = s2.date)),
mk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY date DESC) AS rk FROM mg))"""


@query("merge_histories", _MH + f" SELECT entity, CAST(date AS VARCHAR) AS date, {r('value','value',2)}, source, {r('conflict','conflict',2)}, CAST(rk AS INTEGER) AS rank FROM mk")
def merge_histories(spark, sf):
    m = X.merge_histories(*_sources(spark, sf))
    return m.select("entity", F.col("date").cast("string").alias("date"), tidy(F.col("value"), 2).alias("value"), "source", "rank", tidy(F.col("conflict"), 2).alias("conflict"))


@query("conflict", _MH + f" SELECT entity, CAST(date AS VARCHAR) AS date, abs(value - v2) / greatest(abs(value), abs(v2)) > 0.02 AS conflict FROM mm WHERE v2 IS NOT NULL")
def conflict(spark, sf):
    a, b = _sources(spark, sf)
    b = b.select("entity", F.col("date").alias("d2"), F.col("value").alias("v2"))
    x = a.join(b, "entity").filter(F.abs(F.datediff("d2", "date")) <= X.SAME_PERIOD_DAYS)
    return x.select("entity", F.col("date").cast("string").alias("date"), X.disagree(F.col("value"), F.col("v2")).alias("conflict"))


@query("yoy_cagr", _LF + f""", p AS (SELECT entity, en AS date, val, lag(en) OVER w AS pe, lag(val) OVER w AS pv, max(en) OVER (PARTITION BY entity) AS le FROM lfs WINDOW w AS (PARTITION BY entity ORDER BY en)),
l AS (SELECT entity, arg_max(val, date) AS lv FROM p GROUP BY 1), c AS (SELECT entity, arg_min((lv / val) ** (1 / ((le - date) / 365.25)) - 1, date) AS cagr FROM p JOIN l USING (entity) WHERE abs((le - date) / 365.25 - 3) < 0.2 AND val > 0 AND lv > 0 GROUP BY 1)
SELECT p.entity, CAST(date AS VARCHAR) AS date, {r('CASE WHEN (date - pe) / 365.25 BETWEEN 0.8 AND 1.2 AND pv > 0 THEN val / pv - 1 END','yoy')}, {r('CASE WHEN (date - pe) / 365.25 BETWEEN 0.8 AND 1.2 THEN val - pv END','change',2)}, {r('cagr','cagr')} FROM p LEFT JOIN c USING (entity)""")
def yoy_cagr(spark, sf):
    a = _annual(spark, sf)
    x = X.with_yoy(a).join(X.cagr(a), "entity", "left")
    return x.select("entity", F.col("date").cast("string").alias("date"), tidy(F.col("yoy")).alias("yoy"), tidy(F.col("change"), 2).alias("change"), tidy(F.col("cagr")).alias("cagr"))


@query("free_cash_flow", _LF + f" SELECT a.entity, CAST(a.en AS VARCHAR) AS date, {r('a.val - b.val','value',2)} FROM lf a JOIN lf b ON a.entity = b.entity AND a.en = b.en AND a.tag = 'A' AND b.tag = 'N'")
def free_cash_flow(spark, sf):
    x = X.subtract(_annual(spark, sf, "A"), _annual(spark, sf, "N"))
    return x.select("entity", F.col("date").cast("string").alias("date"), tidy(F.col("value"), 2).alias("value"))


@query("health", _LF + f""", w AS (SELECT entity, en, max(val) FILTER (tag = 'A') AS a, max(val) FILTER (tag = 'N') AS n, max(val) FILTER (tag = 'R') AS rr FROM lf GROUP BY 1, 2), z AS (SELECT entity, en, CASE WHEN entity % 7 = 0 AND year(en) = 2001 THEN NULL ELSE a END AS a, CASE WHEN entity % 7 = 0 AND year(en) = 2001 THEN NULL ELSE n END AS n,
  CASE WHEN entity % 7 = 0 AND year(en) = 2001 THEN NULL ELSE rr END AS rr FROM w), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY en DESC) AS rk FROM z WHERE coalesce(a, n, rr) IS NOT NULL) WHERE rk = 1)
SELECT entity, CAST(en AS VARCHAR) AS date, {r('a - n','net_cash',2)}, {r('a / nullif(rr, 0)','current_ratio')}, {r('CASE WHEN rr - n > 0 THEN n / (rr - n) END','debt_to_equity')}, {r('n / nullif(rr, 0)','coverage')}, {r('(a - rr) / nullif(n, 0)','fcf_yield')}, {r('CASE WHEN a - rr < 0 THEN a / -(a - rr) END','runway_years')} FROM k""")
def health(spark, sf):
    f = X.latest_filed(items(spark, sf), X.ANNUAL_DAYS)
    w = f.groupBy("entity", F.col("end").alias("date")).pivot("tag", ["A", "N", "R"]).agg(F.max("val"))
    gone = (F.col("entity") % 7 == 0) & (F.year("date") == 2001)
    w = w.withColumns({c: F.when(~gone, F.col(c)) for c in ("A", "N", "R")})
    p = w.select("entity", "date", F.col("A").alias("cash"), F.col("N").alias("debt"), F.col("A").alias("current_assets"), F.col("R").alias("current_liabilities"), (F.col("R") - F.col("N")).alias("equity"),
                 F.col("N").alias("operating_income"), F.col("R").alias("interest"), (F.col("A") - F.col("R")).alias("fcf"), F.col("N").alias("market_cap"))
    h = X.health(p)
    return h.select("entity", F.col("date").cast("string").alias("date"), tidy(F.col("net_cash"), 2).alias("net_cash"), *[tidy(F.col(c)).alias(c) for c in ("current_ratio", "debt_to_equity", "coverage", "fcf_yield", "runway_years")])


@query("dilution", """WITH RECURSIVE sh AS (SELECT l_suppkey AS entity, CAST(date_trunc('quarter', l_shipdate) AS DATE) AS date, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2), sp AS (SELECT DISTINCT l_suppkey AS entity, DATE '2000-06-15' AS sd, 2.0 AS ratio FROM lineitem WHERE l_suppkey % 4 = 0),
l AS (SELECT entity, max(date) AS ld, arg_max(value, date) AS lv FROM sh GROUP BY 1), c AS (SELECT s.*, ld, lv, y, abs(s.date - (ld - CAST(floor(365.25 * y) AS INTEGER))) AS off FROM sh s JOIN l USING (entity), (VALUES (1), (3)) v(y)),
b AS (SELECT entity, y, ld, lv, arg_min(date, (off, date)) AS bd, arg_min(value, (off, date)) AS bv FROM c WHERE off <= 75 GROUP BY 1, 2, 3, 4), f AS (SELECT b.*, coalesce((SELECT exp(sum(ln(ratio))) FROM sp WHERE sp.entity = b.entity AND sd > bd AND sd <= ld), 1) AS fc FROM b WHERE bv <> 0)
SELECT entity, y AS years, CAST(bd AS VARCHAR) AS from_date, CAST(ld AS VARCHAR) AS to_date, """ + r("lv / (bv * fc) - 1", "change") + ", fc <> 1 AS split_adjusted FROM f")
def dilution(spark, sf):
    li = V.table(spark, sf, "lineitem")
    p = li.groupBy(F.col("l_suppkey").alias("entity"), F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("date")).agg(F.sum("l_quantity").alias("value"))
    s = li.filter("l_suppkey % 4 = 0").select(F.col("l_suppkey").alias("entity")).distinct().select("entity", F.lit("2000-06-15").cast("date").alias("date"), F.lit(2.0).alias("ratio"))
    d = X.dilution(p, s)
    return d.select("entity", "years", F.col("from_date").cast("string").alias("from_date"), F.col("to_date").cast("string").alias("to_date"), tidy(F.col("change")).alias("change"), "split_adjusted")


# --- earnings ------------------------------------------------------------------------------------------

def report_rows(spark, sf):
    """Every order as a report row of its quarter, dated to one of three days in the middle of the first month."""
    o, k = V.table(spark, sf, "orders"), F.col("o_orderkey")
    day = F.date_add(F.to_date(F.date_trunc("quarter", "o_orderdate")), (14 + k % 3).cast("int"))
    est = F.round(F.col("o_totalprice") / 1e5, 2)
    ts = F.timestamp_seconds(F.unix_date(day) * 86400 + (k % 24) * 3600)
    return o.select(F.col("o_orderpriority").alias("symbol"), ts.alias("ts"), k.alias("row_id"), est.alias("eps_estimate"), F.when(k % 5 != 0, F.round(est * (1 + (k % 7 - 3) / 20) + 1e-9, 2)).alias("eps_actual"))


_REP = """rp AS (SELECT o_orderpriority AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) + 14 + CAST(o_orderkey % 3 AS INTEGER) AS date, o_orderkey % 24 AS hh, o_orderkey AS k, round(o_totalprice / 1e5, 2) AS est, CASE WHEN o_orderkey % 5 <> 0 THEN round(round(o_totalprice / 1e5, 2) * (1 + (o_orderkey % 7 - 3) / 20) + 1e-9, 2) END AS act
  FROM orders),
eh AS (SELECT symbol, date, CASE WHEN hh = 0 THEN 'unknown' WHEN hh * 60 < 570 THEN 'before_open' WHEN hh * 60 >= 960 THEN 'after_close' ELSE 'during_market' END AS timing, est, act, (act / abs(est) - sign(est)) * 100 AS surprise FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY hh, k) AS rn FROM rp WHERE act IS NOT NULL) WHERE rn = 1)"""


def _history(spark, sf):
    return X.earnings_history(report_rows(spark, sf))


@query("earnings_history", "WITH RECURSIVE " + _REP + f" SELECT symbol, CAST(date AS VARCHAR) AS date, timing, est AS eps_estimate, act AS eps_actual, {r('surprise','surprise',4)} FROM eh")
def earnings_history(spark, sf):
    return _history(spark, sf).select("symbol", F.col("date").cast("string").alias("date"), "timing", "eps_estimate", "eps_actual", tidy(F.col("surprise"), 4).alias("surprise"))


_SES = V.sql("dn") + f""", {_REP}, kk AS (SELECT *, CASE WHEN timing IN ('before_open', 'during_market') THEN date ELSE date + 1 END AS k FROM eh),
sn AS (SELECT kk.symbol, kk.date AS rd, kk.timing, kk.surprise, d.i, d.date AS session FROM kk ASOF JOIN dn d ON d.symbol = kk.symbol AND kk.k <= d.date WHERE d.i > 0),
se AS (SELECT symbol, i, session, min(rd) AS report_date, arg_min(timing, rd) AS timing, arg_min(surprise, rd) AS surprise FROM sn GROUP BY 1, 2, 3)"""


def _sessions(spark, sf):
    return X.reacting_sessions(_history(spark, sf), I.numbered(V.daily(spark, sf)))


@query("earnings_session", _SES + " SELECT symbol, i, CAST(session AS VARCHAR) AS session, CAST(report_date AS VARCHAR) AS report_date, timing FROM se")
def earnings_session(spark, sf):
    return _sessions(spark, sf).select("symbol", F.col("i").cast("long").alias("i"), F.col("session").cast("string").alias("session"), F.col("report_date").cast("string").alias("report_date"), "timing")


@query("earnings_reaction", _SES + f""", rx AS (SELECT symbol, i, close / lag(close) OVER w - 1 AS d1, lead(close, 4) OVER w / lag(close) OVER w - 1 AS d5 FROM dn WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, i, {r('d1','one_day')}, {r('d5','five_day')} FROM se JOIN rx USING (symbol, i)""")
def earnings_reaction(spark, sf):
    x = X.reactions(_sessions(spark, sf), I.numbered(V.daily(spark, sf)))
    return x.select("symbol", F.col("i").cast("long").alias("i"), tidy(F.col("one_day")).alias("one_day"), tidy(F.col("five_day")).alias("five_day"))


@query("c_earnings", _SES + f""", fr AS (SELECT symbol, min(i) AS f FROM se GROUP BY 1), x AS (SELECT dn.symbol, dn.i, se.i IS NOT NULL AS has, surprise, f, dn.close / lag(dn.close) OVER (PARTITION BY dn.symbol ORDER BY dn.date) - 1 AS mv FROM dn LEFT JOIN se ON se.symbol = dn.symbol AND se.i = dn.i LEFT JOIN fr ON fr.symbol = dn.symbol)
SELECT symbol, i, CASE WHEN i >= f AND i > 0 THEN has AND coalesce(surprise > 0, false) AND coalesce(mv >= 0.005, false) END AS holds, {r('CASE WHEN has THEN mv END','value')} FROM x""")
def c_earnings(spark, sf):
    d = C.with_reports(I.numbered(V.daily(spark, sf)), _sessions(spark, sf))
    x = C.evaluate(d, {"holds": ("earnings", {"result": "beat", "reaction": "rises", "threshold": 0.5})})
    return x.select("symbol", F.col("i").cast("long").alias("i"), "holds", tidy(F.col("holds_value")).alias("value"))


_RPE = "rpe AS (SELECT DISTINCT l_suppkey * 4 + " + _CODE.replace("tag", "l_returnflag") + " AS entity, CAST(l_shipdate AS DATE) AS date FROM lineitem)"


def _entity_reports(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return _series(li.select(F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("tag"), F.to_date("l_shipdate").alias("date"))).select("entity", "date").distinct()


@query("match_quarter", _Q4 + f""", {_RPE}, mq AS (SELECT r.entity, r.date, max(q.en) AS qe, arg_max(q.val, q.en) AS qv FROM rpe r LEFT JOIN qs q ON q.entity = r.entity AND r.date - q.en > 0 AND r.date - q.en <= 120 GROUP BY 1, 2)
SELECT entity, CAST(date AS VARCHAR) AS date, CAST(qe AS VARCHAR) AS quarter_end, {r('qv','quarter_value',2)} FROM mq""")
def match_quarter(spark, sf):
    x = X.match_quarter(_entity_reports(spark, sf), _quarters(spark, sf))
    return x.select("entity", F.col("date").cast("string").alias("date"), F.col("quarter_end").cast("string").alias("quarter_end"), tidy(F.col("quarter_value"), 2).alias("quarter_value"))


@query("year_ago", _Q4 + f", y AS (SELECT a.entity, a.en, a.val, arg_min(b.val, b.en) AS prior FROM qs a JOIN qs b ON a.entity = b.entity AND a.en - b.en BETWEEN 350 AND 380 GROUP BY 1, 2, 3) SELECT entity, CAST(en AS VARCHAR) AS \"end\", {r('prior','prior',2)}, {r('CASE WHEN prior > 0 THEN val / prior - 1 END','yoy')} FROM y")
def year_ago(spark, sf):
    x = X.year_ago(_quarters(spark, sf))
    return x.select("entity", F.col("end").cast("string").alias("end"), tidy(F.col("prior"), 2).alias("prior"), tidy(F.col("yoy")).alias("yoy"))


@query("eps_yoy", "WITH RECURSIVE " + _REP + f", e AS (SELECT *, date - lag(date, 4) OVER w AS gap, lag(act, 4) OVER w AS pa FROM eh WINDOW w AS (PARTITION BY symbol ORDER BY date)) SELECT symbol, CAST(date AS VARCHAR) AS date, {r('CASE WHEN gap BETWEEN 330 AND 400 AND pa > 0 THEN act / pa - 1 END','eps_yoy')} FROM e")
def eps_yoy(spark, sf):
    return X.eps_yoy(_history(spark, sf)).select("symbol", F.col("date").cast("string").alias("date"), tidy(F.col("eps_yoy")).alias("eps_yoy"))


# --- guidance ------------------------------------------------------------------------------------------

def _guidance(spark, sf):
    """Report estimates read as guidance ranges: revenue in odd months' rows, a margin otherwise."""
    h = _history(spark, sf)
    pct = F.dayofmonth("date") == 16
    return h.select("symbol", F.date_sub("date", F.when(pct, 1).otherwise(0)).alias("date"), F.when(pct, "Gross margin").otherwise("Revenue").alias("metric"), F.concat(F.lit("FY"), F.year("date").cast("string")).alias("period"), F.when(pct, "%").otherwise("$").alias("unit"),
                    F.round(F.col("eps_estimate") * 0.98, 4).alias("low"), F.round(F.col("eps_estimate") * 1.02, 4).alias("high")).groupBy("symbol", "date", "metric", "period", "unit").agg(F.min("low").alias("low"), F.max("high").alias("high"))


_GD = f"""{_REP}, gd AS (SELECT symbol, date - CASE WHEN day(date) = 16 THEN 1 ELSE 0 END AS date, CASE WHEN day(date) = 16 THEN 'Gross margin' ELSE 'Revenue' END AS metric, 'FY' || year(date) AS period, CASE WHEN day(date) = 16 THEN '%' ELSE '$' END AS unit, min(round(est * 0.98, 4)) AS low, max(round(est * 1.02, 4)) AS high FROM eh GROUP BY ALL)"""


@query("guidance_change", "WITH RECURSIVE " + _GD + f""", p AS (SELECT *, (low + high) / 2 AS mid, lag((low + high) / 2) OVER w AS pm, lag(high - low) OVER w AS pw FROM gd WINDOW w AS (PARTITION BY symbol, metric, period ORDER BY date)),
c AS (SELECT *, CASE WHEN pm IS NULL THEN 'INITIATED' WHEN unit = '%' THEN CASE WHEN mid - pm > 0.1 THEN 'RAISED' WHEN mid - pm < -0.1 THEN 'LOWERED' ELSE 'REITERATED' END WHEN coalesce(mid / nullif(pm, 0) - 1, 0) > 0.005 THEN 'RAISED' WHEN coalesce(mid / nullif(pm, 0) - 1, 0) < -0.005 THEN 'LOWERED' ELSE 'REITERATED' END AS ch FROM p)
SELECT symbol, CAST(date AS VARCHAR) AS date, metric, period, ch AS change, coalesce(ch = 'REITERATED' AND high - low < pw * 0.9, false) AS narrowed, count(*) FILTER (ch = 'RAISED') OVER r > 0 AND count(*) FILTER (ch = 'LOWERED') OVER r > 0 AS mixed FROM c WINDOW r AS (PARTITION BY symbol, date)""")
def guidance_change(spark, sf):
    x = X.guidance_change(_guidance(spark, sf))
    return x.select("symbol", F.col("date").cast("string").alias("date"), "metric", "period", "change", "narrowed", "mixed")


@query("guidance_actual", "WITH RECURSIVE " + _GD + f""", qv AS (SELECT o_orderpriority AS symbol, CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS en, avg(o_totalprice) / 1e5 AS val FROM orders GROUP BY 1, 2),
m AS (SELECT g.symbol, g.metric, g.date, g.low, g.high, min(q.en) AS pe, arg_min(q.val, q.en) AS act FROM gd g JOIN qv q ON q.symbol = g.symbol AND q.en - g.date > 0 AND q.en - g.date <= 150 GROUP BY 1, 2, 3, 4, 5)
SELECT symbol, metric, CAST(date AS VARCHAR) AS date, CAST(pe AS VARCHAR) AS period_end, {r('act','actual',4)}, {r('act / nullif((low + high) / 2, 0) - 1','vs_mid',4)} FROM m""")
def guidance_actual(spark, sf):
    q = V.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.date_sub(F.add_months(F.to_date(F.date_trunc("quarter", "o_orderdate")), 3), 1).alias("end")).agg((F.avg("o_totalprice") / 1e5).alias("val"))
    x = X.guidance_actual(_guidance(spark, sf), q)
    return x.select("symbol", "metric", F.col("date").cast("string").alias("date"), F.col("period_end").cast("string").alias("period_end"), tidy(F.col("actual"), 4).alias("actual"), tidy(F.col("vs_mid"), 4).alias("vs_mid"))


# --- filings and search --------------------------------------------------------------------------------

@query("parallel_arrays", """WITH RECURSIVE f AS (SELECT o_custkey AS company, CAST(o_orderdate AS DATE) AS d, o_orderkey AS k FROM orders), z AS (SELECT company, unnest([CASE WHEN k % 3 = 0 THEN '10-K' ELSE '4' END, '8-K', '10-Q']) AS form, unnest([d, d + 30, d + 60]) AS filed, unnest(['', '2.02,9.01', '']) AS items FROM f),
k AS (SELECT *, row_number() OVER (PARTITION BY company ORDER BY filed DESC, form) AS rk FROM z WHERE form <> '4' AND filed >= DATE '2000-01-01')
SELECT company, CAST(rk AS INTEGER) AS position, form, CAST(filed AS VARCHAR) AS filed, CASE WHEN items = '' THEN '' ELSE 'Results of operations; Exhibits' END AS items FROM k""")
def parallel_arrays(spark, sf):
    o = V.table(spark, sf, "orders")
    d = F.to_date("o_orderdate")
    x = o.select(F.col("o_custkey").alias("company"), F.array(F.when(F.col("o_orderkey") % 3 == 0, "10-K").otherwise("4"), F.lit("8-K"), F.lit("10-Q")).alias("forms"), F.array(d, F.date_add(d, 30), F.date_add(d, 60)).alias("dates"), F.array(F.lit(""), F.lit("2.02,9.01"), F.lit("")).alias("items"))
    return X.filings(x, F.lit("2000-01-01").cast("date")).withColumn("filed", F.col("filed").cast("string"))


@query("symbol_search", """WITH RECURSIVE s AS (SELECT DISTINCT p_brand AS symbol, p_name AS name FROM part), k AS (SELECT *, CASE WHEN lower(symbol) = 'red' THEN 0 WHEN starts_with(lower(symbol), 'red') THEN 1 WHEN starts_with(lower(name), 'red') THEN 2 WHEN contains(lower(name), 'red') THEN 3 END AS score FROM s)
SELECT symbol, name, score FROM k WHERE score IS NOT NULL ORDER BY score, length(name), symbol, name LIMIT 8""")
def symbol_search(spark, sf):
    names = V.table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.col("p_name").alias("name")).distinct()
    return X.symbol_search(names, "red")


@query("safe_div", f"""WITH RECURSIVE x AS (SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS p, l_extendedprice / nullif(l_discount, 0) AS q, CASE WHEN l_tax > 0 THEN l_discount / l_tax - 1 END AS g FROM lineitem) SELECT k, ln, p, {r('q','quotient',4)}, {r('g','growth',4)} FROM x""")
def safe_div(spark, sf):
    from tidemark.functions.maths import growth, ratio

    li = V.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("ln"), F.col("l_partkey").alias("p"), tidy(ratio(F.col("l_extendedprice"), F.col("l_discount")), 4).alias("quotient"), tidy(growth(F.col("l_discount"), F.col("l_tax")), 4).alias("growth"))
