"""Baskets of holdings derived from the order tables."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tidemark.functions.maths import tidy
from tidemark.operators import basket as K
from tidemark.operators import indicators as I
from tidemark.plans import views as V
from tidemark.plans.registry import query, r

FUND = "5-LOW"
LINES_A_TASK = 500_000  # order lines that one task holds while they are counted
# Factor names by brand number: five kinds of five names each.
FACTORS = [
    ("supplier", ["entity:TSMC", "entity:Samsung", "entity:Intel", "entity:Micron", "entity:ASML"]),
    ("customer", ["customer:hyperscalers", "customer:us_gov", "concentration:customer", "entity:Apple", "entity:Dell"]),
    ("geography", ["geo:China", "geo:Taiwan", "geo:Japan", "geo:India", "geo:Mexico"]),
    ("policy", ["policy:Export controls", "policy:Tax policy", "policy:Tariffs & trade", "policy:Sector regulation", "policy:Antitrust & competition law"]),
    ("theme", ["theme:ai", "theme:data_center", "theme:quantum", "theme:ev", "theme:nuclear"]),
]
KEYS = [names[i] for i in range(5) for _, names in FACTORS]
ALL_SECTORS = ["Technology", "Energy", "Healthcare", "Utilities", "Materials", "Industrials", "Real Estate", "Financials"]


def raw_basket(spark, sf):
    """Share of every priority in a segment's order value; one weight is blank."""
    o, c = V.table(spark, sf, "orders"), V.table(spark, sf, "customer")
    # Pre-aggregated per customer, so a customer holding a third of all orders reaches the join as five rows.
    o = o.groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    x = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("portfolio_id"), F.col("o_orderpriority").alias("holding")).agg(F.sum("v").alias("v"))
    return x.select("portfolio_id", "holding", F.when(F.col("holding") != "2-HIGH", F.round(F.col("v") / 1e8, 4)).alias("weight"), F.round(F.col("v") / 1e8, 4).alias("full_weight"))


def basket(spark, sf):
    """Baskets, exposures and fund positions are stored tables: most queries here read each of them several times."""
    return V.stored("basket", spark, sf, build_basket)


def build_basket(spark, sf):
    b = raw_basket(spark, sf).select("portfolio_id", "holding", F.col("full_weight").alias("weight"))
    return K.normalize_weights(b, F.lit(0.0)).select("portfolio_id", "holding", F.round("weight", 4).alias("weight"))


def _brand_lines(spark, sf):
    li, o, p = V.table(spark, sf, "lineitem"), V.table(spark, sf, "orders"), V.table(spark, sf, "part")
    # Counts shrink before every join: per order and part, then per priority and part.  The number of tasks follows the lines, so that none holds more of them at 60 times the size.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-li.count() // LINES_A_TASK))
    x = li.select("l_orderkey", "l_partkey").repartition(tasks, "l_orderkey", "l_partkey").groupBy("l_orderkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    x = x.repartition(tasks, "l_orderkey").join(o.select("o_orderkey", "o_orderpriority").repartition(tasks, "o_orderkey").hint("merge"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderpriority", "l_partkey").agg(F.sum("n").alias("n"))
    return x.join(p, x.l_partkey == p.p_partkey).groupBy(
        F.col("o_orderpriority").alias("holding"), (F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 25).alias("b")).agg(F.sum("n").alias("n"))


def exposures(spark, sf):
    return V.stored("exposures", spark, sf, build_exposures)


def build_exposures(spark, sf):
    """A holding is exposed to a factor where its share of the brand's lines is above its peers'."""
    x = _brand_lines(spark, sf)
    mean = x.groupBy("b").agg(F.avg("n").alias("m"))
    x = x.join(mean, "b").withColumn("s", F.col("n") / F.col("m"))
    strength = F.when(F.col("s") > 1.06, "disclosed").when(F.col("s") > 1.02, "emphasized").when(F.col("s") > 0.97, "mentioned")
    key = F.element_at(F.array(*[F.lit(k) for k in KEYS]), F.col("b") + 1)
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in FACTORS]), F.col("b") % 5 + 1)
    return x.withColumn("strength", strength).filter("strength is not null").select("holding", key.alias("factor_key"), kind.alias("kind"), "strength", "n")


def fund_holdings(spark, sf):
    return V.stored("fund_holdings", spark, sf, build_fund_holdings)


def build_fund_holdings(spark, sf):
    o = V.table(spark, sf, "orders")
    total = o.agg(F.count(F.lit(1)).alias("t")).scalar()
    g = o.filter("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("holding")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / total / F.when(F.col("holding").isin("3-MEDIUM"), 2.0).when(F.col("holding") == "4-NOT SPECIFIED", 4.0).otherwise(1.0)
    return g.select(F.lit(FUND).alias("fund"), "holding", share.alias("share"))


def sectors(spark, sf):
    """Single sectors for companies; the fund is spread by order status."""
    o = V.table(spark, sf, "orders")
    own = F.when(F.col("o_orderpriority") == "3-MEDIUM", "Energy").otherwise("Technology")
    spread = F.when(F.col("o_orderstatus") == "F", "Technology").when(F.col("o_orderstatus") == "O", "Energy").otherwise("Healthcare")
    x = o.groupBy(F.col("o_orderpriority").alias("holding"), F.when(F.col("o_orderpriority") == FUND, spread).otherwise(own).alias("sector")).agg(F.count(F.lit(1)).alias("n"))
    t = x.groupBy("holding").agg(F.sum("n").alias("t"))
    return x.join(t, "holding").select("holding", "sector", (F.col("n") / F.col("t")).alias("share"))


def fundamentals(spark, sf):
    li, o = V.table(spark, sf, "lineitem"), V.table(spark, sf, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).groupBy(F.col("o_orderpriority").alias("holding")).agg(
        F.sum(F.col("l_extendedprice") * (0.05 - F.col("l_discount"))).alias("fcf"), (F.avg("l_quantity") / 12.75).alias("runway"), (F.avg("l_tax") * 2.5).alias("dilution"),
        (F.avg("l_discount") * 4).alias("growth"), F.avg(0.05 - F.col("l_discount")).alias("op_margin"), (F.avg("l_quantity") * 0.59).alias("ps"))


_RAW = """rawb AS (SELECT c_mktsegment AS portfolio_id, o_orderpriority AS holding, round(sum(o_totalprice) / 1e8, 4) AS fw FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
_BK = _RAW + ", bk AS (SELECT portfolio_id, holding, round(fw / sum(fw) OVER (PARTITION BY portfolio_id) * 100, 4) AS weight FROM rawb)"
_KEYL = "[" + ", ".join("'" + k + "'" for k in KEYS) + "]"
_KINDL = "[" + ", ".join("'" + k + "'" for k, _ in FACTORS) + "]"
_EX = f"""bl AS (SELECT o_orderpriority AS holding, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) % 25 AS b, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
bs AS (SELECT *, n / avg(n) OVER (PARTITION BY b) AS s FROM bl),
ex AS (SELECT holding, ({_KEYL})[b + 1] AS factor_key, ({_KINDL})[b % 5 + 1] AS kind, CASE WHEN s > 1.06 THEN 'disclosed' WHEN s > 1.02 THEN 'emphasized' ELSE 'mentioned' END AS strength, n FROM bs WHERE s > 0.97)"""
_GEN = """(kind = 'macro' OR factor_key IN ('policy:Tax policy', 'policy:Sector regulation', 'policy:Antitrust & competition law') OR (kind = 'geography' AND split_part(factor_key, ':', 2) NOT IN ('China', 'Taiwan', 'Hong Kong', 'Russia / Ukraine', 'Israel', 'Middle East', 'South Korea') AND strength <> 'disclosed'))"""
_FH = f"""fh AS (SELECT '{FUND}' AS fund, o_orderpriority AS holding, count(*) / (SELECT count(*) FROM orders) / CASE o_orderpriority WHEN '3-MEDIUM' THEN 2.0 WHEN '4-NOT SPECIFIED' THEN 4.0 ELSE 1.0 END AS share FROM orders WHERE o_orderstatus = 'F' GROUP BY 2)"""
_MAT = "('disclosed', 'emphasized', 'measured', 'classification')"
_MATL = "('disclosed', 'emphasized', 'measured', 'classification', 'look-through')"
_HO = f"""{_BK}, {_EX}, {_FH}, h0 AS (SELECT portfolio_id, factor_key, kind, holding, strength, weight, {_GEN} AS g FROM bk JOIN ex USING (holding)),
fg AS (SELECT portfolio_id, factor_key, arg_min(g, holding) AS fgen FROM h0 GROUP BY 1, 2),
ltp AS (SELECT b.portfolio_id, b.holding AS fund, b.weight AS fw, f.holding, f.share FROM bk b JOIN fh f ON f.fund = b.holding JOIN bk d ON d.portfolio_id = b.portfolio_id AND d.holding = f.holding WHERE f.share >= 0.02 AND f.fund <> f.holding),
lt AS (SELECT portfolio_id, factor_key, kind, fund AS holding, CASE WHEN max(share) >= 0.05 THEN 'look-through' ELSE 'mentioned' END AS strength, any_value(fw) AS weight FROM ltp p JOIN ex USING (holding) WHERE strength IN {_MAT} AND NOT {_GEN} AND NOT regexp_matches(factor_key, '^(fund|industry|sector):')
  AND NOT EXISTS (SELECT 1 FROM ex o WHERE o.holding = p.fund AND o.factor_key = ex.factor_key) GROUP BY 1, 2, 3, 4),
ho AS (SELECT portfolio_id, factor_key, kind, holding, strength, weight, fgen FROM h0 JOIN fg USING (portfolio_id, factor_key) UNION ALL SELECT portfolio_id, factor_key, kind, holding, strength, weight, fgen FROM lt JOIN fg USING (portfolio_id, factor_key)),
nb AS (SELECT portfolio_id, count(*) AS n FROM bk GROUP BY 1)"""
_W = "WITH RECURSIVE "


def _ho(spark, sf):
    return K.with_look_through(basket(spark, sf), fund_holdings(spark, sf), exposures(spark, sf))


def _t(df, *cols):
    return df.withColumns({c: tidy(F.col(c), 4) for c in cols})


@query("weights", _W + _RAW + f""", w0 AS (SELECT portfolio_id, holding, CASE WHEN holding <> '2-HIGH' THEN fw END AS w FROM rawb), w1 AS (SELECT *, greatest(0, 100 - 5 - coalesce(sum(w) OVER p, 0)) AS rest, count(*) FILTER (w IS NULL) OVER p AS miss FROM w0 WINDOW p AS (PARTITION BY portfolio_id)),
w2 AS (SELECT *, coalesce(w, rest / nullif(miss, 0)) AS x FROM w1), w3 AS (SELECT *, sum(x) OVER (PARTITION BY portfolio_id) + 5 AS t FROM w2) SELECT portfolio_id, holding, {r('x * 100 / t','weight',4)}, {r('5 * 100 / t','cash',4)} FROM w3""")
def weights(spark, sf):
    b = raw_basket(spark, sf).select("portfolio_id", "holding", "weight")
    return _t(K.normalize_weights(b, F.lit(5.0)), "weight", "cash")


@query("is_general", _W + _EX + f" SELECT holding, factor_key, strength, {_GEN} AS general FROM ex")
def is_general(spark, sf):
    return exposures(spark, sf).select("holding", "factor_key", "strength", K.is_general(F.col("kind"), F.col("factor_key"), F.col("strength")).alias("general"))


@query("look_through", _W + _HO + f" SELECT portfolio_id, factor_key, holding, strength, {r('weight','weight',4)} FROM lt")
def look_through(spark, sf):
    x = K.look_through(basket(spark, sf), fund_holdings(spark, sf), exposures(spark, sf))
    return _t(x.select("portfolio_id", "factor_key", "holding", "strength", "weight"), "weight")


_CON = f"""cn AS (SELECT portfolio_id, factor_key, kind, fgen AS general, count(*) FILTER (strength IN {_MATL}) AS count, sum(weight) AS weight, coalesce(sum(weight) FILTER (strength IN {_MATL}), 0) AS mw, coalesce(string_agg(DISTINCT holding, ',' ORDER BY holding) FILTER (strength IN {_MATL}), '') AS holders FROM ho GROUP BY 1, 2, 3, 4),
cc AS (SELECT cn.*, n FROM cn JOIN nb USING (portfolio_id) WHERE count >= 2 AND (mw >= 50 OR (n >= 3 AND count >= n - 1)))"""


@query("concentration", _W + _HO + f", {_CON} SELECT portfolio_id, factor_key, kind, general, count, {r('weight','weight',4)}, {r('mw','material_weight',4)}, holders, n FROM cc")
def concentration(spark, sf):
    return _t(K.concentration(_ho(spark, sf), basket(spark, sf)), "weight", "material_weight")


@query("merged_concentration", _W + _HO + f""", {_CON}, kr AS (SELECT *, CASE kind WHEN 'theme' THEN 0 WHEN 'customer' THEN 0 WHEN 'supplier' THEN 0 WHEN 'geography' THEN 1 WHEN 'policy' THEN 1 WHEN 'partner' THEN 2 WHEN 'industry' THEN 2 WHEN 'financial' THEN 3 ELSE 4 END AS rk FROM cc WHERE NOT general),
mg AS (SELECT portfolio_id, holders, min((rk, -mw, -count, factor_key)) AS o, string_agg(DISTINCT factor_key, ',' ORDER BY factor_key) AS factors, max(count) AS count FROM kr GROUP BY portfolio_id, holders, CASE WHEN kind IN ('industry', 'financial') THEN factor_key ELSE '' END),
ml AS (SELECT *, row_number() OVER (PARTITION BY portfolio_id ORDER BY o) AS line FROM mg) SELECT portfolio_id, line, holders, factors, count FROM ml""")
def merged_concentration(spark, sf):
    return K.merged_concentration(K.concentration(_ho(spark, sf), basket(spark, sf)))


@query("lenses", _W + _HO + f""", ln AS (SELECT *, CASE WHEN kind IN ('supplier', 'customer', 'partner', 'geography', 'policy') AND NOT fgen THEN 'dependency' WHEN kind IN ('theme', 'industry', 'sector') AND NOT fgen THEN 'thematic' WHEN kind IN ('financial', 'macro') OR (kind = 'policy' AND fgen) THEN 'macro' END AS lens FROM ho)
SELECT portfolio_id, lens, factor_key, count(*) FILTER (strength IN {_MATL}) AS count, {r(f'sum(weight) FILTER (strength IN {_MATL})','weight',4)}, count(*) AS holders FROM ln WHERE lens IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) FILTER (strength IN {_MATL}) >= 2""")
def lenses(spark, sf):
    return _t(K.lenses(_ho(spark, sf)), "weight")


@query("theme_levels", _W + _HO + f""", tl AS (SELECT ho.*, CASE WHEN ho.strength = 'look-through' THEN 'indirect' WHEN m >= 15 THEN 'high' WHEN m >= 5 THEN 'moderate' WHEN ho.strength = 'mentioned' AND m IS NULL THEN 'indirect' ELSE 'moderate' END AS level
  FROM ho LEFT JOIN (SELECT holding, factor_key, n % 25 AS m FROM ex WHERE kind = 'theme') e ON e.holding = ho.holding AND e.factor_key = ho.factor_key WHERE kind = 'theme')
SELECT portfolio_id, factor_key, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'moderate') AS moderate, count(*) FILTER (level = 'indirect') AS indirect, {r("coalesce(sum(weight) FILTER (level <> 'indirect'), 0)",'weight',4)}, count(*) FILTER (level <> 'indirect') >= 2 AS shared FROM tl GROUP BY 1, 2""")
def theme_levels(spark, sf):
    e = exposures(spark, sf)
    m = e.filter("kind = 'theme'").select("holding", "factor_key", (F.col("n") % 25).alias("mentions"))
    return _t(K.theme_levels(_ho(spark, sf), m), "weight")


@query("effective_weight", _W + f"""{_BK}, {_FH}, th AS (SELECT b.portfolio_id, f.holding, sum(b.weight * f.share) AS through FROM bk b JOIN fh f ON f.fund = b.holding WHERE f.share >= 0.02 AND f.fund <> f.holding GROUP BY 1, 2)
SELECT portfolio_id, holding, {r('weight','weight',4)}, {r('coalesce(through, 0)','through',4)}, {r('weight + coalesce(through, 0)','effective',4)} FROM bk LEFT JOIN th USING (portfolio_id, holding)""")
def effective_weight(spark, sf):
    return _t(K.effective_weights(basket(spark, sf), fund_holdings(spark, sf)), "weight", "through", "effective")


_SC = f"""se AS (SELECT o_orderpriority AS holding, CASE WHEN o_orderpriority = '{FUND}' THEN CASE o_orderstatus WHEN 'F' THEN 'Technology' WHEN 'O' THEN 'Energy' ELSE 'Healthcare' END WHEN o_orderpriority = '3-MEDIUM' THEN 'Energy' ELSE 'Technology' END AS sector, count(*) AS n FROM orders GROUP BY 1, 2),
ss AS (SELECT holding, sector, n / sum(n) OVER (PARTITION BY holding) AS share FROM se), sw AS (SELECT portfolio_id, sector, sum(weight * share) AS weight FROM bk JOIN ss USING (holding) GROUP BY 1, 2)"""


@query("sector_weights", _W + f"{_BK}, {_SC} SELECT portfolio_id, sector, {r('weight','weight',4)} FROM sw")
def sector_weights(spark, sf):
    return _t(K.sector_weights(basket(spark, sf), sectors(spark, sf)), "weight")


@query("missing_sectors", _W + f"{_BK}, {_SC}, al AS (SELECT portfolio_id, unnest(['" + "', '".join(ALL_SECTORS) + "']) AS sector FROM (SELECT DISTINCT portfolio_id FROM bk)) SELECT portfolio_id, sector FROM al WHERE NOT EXISTS (SELECT 1 FROM sw WHERE sw.portfolio_id = al.portfolio_id AND sw.sector = al.sector AND sw.weight >= 1)")
def missing_sectors(spark, sf):
    have = K.sector_weights(basket(spark, sf), sectors(spark, sf)).filter("weight >= 1")
    full = basket(spark, sf).select("portfolio_id").distinct().withColumn("sector", F.explode(F.array(*[F.lit(s) for s in ALL_SECTORS])))
    return full.join(have, ["portfolio_id", "sector"], "left_anti")


_SCN = "scn AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', [{', '.join(chr(39) + v + chr(39) for v in vs)}])" for k, vs in K.SCENARIOS.items()) + ") v(scenario, keys))"


@query("scenario_reach", _W + f"""{_BK}, {_EX}, {_SCN}, ht AS (SELECT holding, scenario, arg_max(strength, (CASE strength WHEN 'disclosed' THEN 3 WHEN 'emphasized' THEN 2 ELSE 1 END, strength)) AS st FROM ex JOIN scn ON list_contains(keys, factor_key) GROUP BY 1, 2),
rc AS (SELECT portfolio_id, scenario, count(*) AS reached, sum(weight) FILTER (st IN {_MAT}) AS mw, sum(weight) AS aw FROM bk JOIN ht USING (holding) GROUP BY 1, 2), al AS (SELECT portfolio_id, scenario, n FROM (SELECT portfolio_id, count(*) AS n FROM bk GROUP BY 1), scn)
SELECT portfolio_id, scenario, coalesce(reached, 0) AS reached, {r('coalesce(mw, 0)','material_weight',4)}, {r('coalesce(aw, 0)','any_weight',4)}, n - coalesce(reached, 0) AS unexposed FROM al LEFT JOIN rc USING (portfolio_id, scenario)""")
def scenario_reach(spark, sf):
    return _t(K.scenario_reach(basket(spark, sf), exposures(spark, sf)), "material_weight", "any_weight")


@query("unexposed", _W + f"{_BK}, {_EX} SELECT portfolio_id, holding FROM bk WHERE NOT EXISTS (SELECT 1 FROM ex WHERE ex.holding = bk.holding AND factor_key IN ('theme:quantum'))")
def unexposed(spark, sf):
    return K.unexposed(basket(spark, sf), exposures(spark, sf), K.SCENARIOS["quantum"])


def _unicode_words(p: str) -> str:
    """Word boundaries in the SQL engine are ASCII; here letters beyond ASCII belong to words too."""
    p = re.sub(r"\\b(?=\w)", r"(^|[^\\p{L}\\p{N}_])", p)
    return re.sub(r"\\b", r"([^\\p{L}\\p{N}_]|$)", p)


_WORD_KEYS = ", ".join("CASE WHEN regexp_matches(lower(text), '{}') THEN [{}] ELSE [] END".format(_unicode_words(p), ", ".join(f"'{k}'" for k in ks)) for p, ks in K.SCENARIO_WORDS)


@query("scenario_words", f"WITH k AS (SELECT doc_id, flatten([{_WORD_KEYS}]) AS l FROM documents) SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS keys FROM k")
def scenario_words(spark, sf):
    """Factor keys each document would point to if read as a scenario question."""
    d = V.table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(K.scenario_keys(F.col("text")), ",").alias("keys"))


# --- returns -------------------------------------------------------------------------------------------

_RET = """rr AS (SELECT symbol AS holding, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM daily), ra AS (SELECT *, row_number() OVER (PARTITION BY holding ORDER BY date DESC) AS age FROM rr WHERE r IS NOT NULL)"""
_PAIR = f"""{_BK}, {_RET}, pr AS (SELECT x.portfolio_id, x.holding AS a, y.holding AS b, x.weight AS wa, y.weight AS wb FROM bk x JOIN bk y ON x.portfolio_id = y.portfolio_id AND x.holding < y.holding)"""
_CORRW = """cw AS (SELECT p.a, p.b, w.k AS win, count(*) AS days, CASE WHEN count(*) >= CASE WHEN w.n IS NULL THEN 40 ELSE least(40, greatest(15, CAST(floor(w.n * 0.7) AS INTEGER))) END THEN corr(x.r, y.r) END AS c FROM (SELECT DISTINCT a, b FROM pr) p JOIN ra x ON x.holding = p.a JOIN ra y ON y.holding = p.b AND y.date = x.date
  JOIN (VALUES ('1m', 21), ('3m', 63), ('6m', 126), ('1y', 252), ('3y', 756), ('max', NULL)) w(k, n) ON w.n IS NULL OR (x.age <= w.n AND y.age <= w.n) GROUP BY p.a, p.b, w.k, w.n)"""
_RV = "WITH RECURSIVE " + V.sql("daily").split("WITH RECURSIVE ", 1)[1] + ", "


def _returns(spark, sf, n=None):
    return K.last_returns(V.daily(spark, sf), n)


def _corr(spark, sf, windows=None):
    return K.pair_correlations(K.basket_pairs(basket(spark, sf)), _returns(spark, sf), windows or K.CORR_WINDOWS)


@query("pair_corr", _RV + _PAIR + f", {_CORRW} SELECT a, b, win AS \"window\", days, {r('c','correlation')} FROM cw")
def pair_corr(spark, sf):
    return _corr(spark, sf).withColumn("correlation", tidy(F.col("correlation")))


@query("corr_view", _RV + _PAIR + f""", {_CORRW}, vw AS (SELECT portfolio_id, win, a, b, days, c, avg(c) OVER g AS av, row_number() OVER (g ORDER BY c DESC, a, b) AS rh, row_number() OVER (g ORDER BY c, a, b) AS rl FROM pr JOIN cw USING (a, b) WHERE c IS NOT NULL WINDOW g AS (PARTITION BY portfolio_id, win))
SELECT portfolio_id, win AS "window", a, b, days, {r('c','correlation')}, {r('av','average')}, rh AS rank_high, rl AS rank_low FROM vw WHERE rh <= 5 OR rl <= 5""")
def corr_view(spark, sf):
    return K.correlation_view(K.basket_pairs(basket(spark, sf)), _corr(spark, sf)).withColumns({c: tidy(F.col(c)) for c in ("correlation", "average")})


@query("short_history", _RV + f"""{_BK}, {_RET}, h AS (SELECT holding, count(*) AS have FROM ra GROUP BY 1) SELECT portfolio_id, holding, have, have < 0.8 * max(have) OVER (PARTITION BY portfolio_id) AS short FROM bk JOIN h USING (holding)""")
def short_history(spark, sf):
    return K.short_history(_returns(spark, sf), basket(spark, sf))


_MS = f"ms AS (SELECT holding, list(DISTINCT factor_key) AS ks FROM ex WHERE strength IN {_MAT} AND NOT starts_with(factor_key, 'industry:') AND NOT {_GEN} GROUP BY 1)"


@query("pair_class", _RV + _PAIR + f""", {_EX}, {_CORRW}, {_MS}, x AS (SELECT p.portfolio_id, p.a, p.b, c.c, len(list_intersect(coalesce(ma.ks, []), coalesce(mb.ks, []))) AS shared, len(list_distinct(list_concat(coalesce(ma.ks, []), coalesce(mb.ks, [])))) AS un
  FROM pr p LEFT JOIN (SELECT * FROM cw WHERE win = '1y') c USING (a, b) LEFT JOIN ms ma ON ma.holding = p.a LEFT JOIN ms mb ON mb.holding = p.b), y AS (SELECT *, coalesce(shared / nullif(un, 0), 0) AS ov FROM x)
SELECT portfolio_id, a, b, {r('c','correlation')}, CAST(shared AS INTEGER) AS shared, {r('ov','overlap')}, CASE WHEN ov >= 0.3 AND coalesce(c >= 0.6, false) THEN 'same_bet' WHEN ov >= 0.3 THEN 'hidden' WHEN coalesce(c >= 0.6, false) THEN 'market' ELSE 'independent' END AS kind FROM y""")
def pair_class(spark, sf):
    p = K.basket_pairs(basket(spark, sf))
    x = K.classify_pairs(p, _corr(spark, sf, {"1y": 252}), exposures(spark, sf))
    return x.select("portfolio_id", "a", "b", tidy(F.col("correlation")).alias("correlation"), "shared", tidy(F.col("overlap")).alias("overlap"), "kind")


@query("diversification", _RV + _PAIR + f""", {_CORRW}, vl AS (SELECT holding, stddev_pop(r) * sqrt(252) AS vol FROM ra WHERE age <= 252 GROUP BY 1), ow AS (SELECT portfolio_id, sum(weight / 100 * vol) AS wv, sum((weight / 100 * vol) ** 2) AS o FROM bk JOIN vl USING (holding) GROUP BY 1),
cr AS (SELECT portfolio_id, sum(2 * wa / 100 * wb / 100 * va.vol * vb.vol * c) AS x FROM pr JOIN cw USING (a, b) JOIN vl va ON va.holding = a JOIN vl vb ON vb.holding = b WHERE win = '1y' GROUP BY 1) SELECT portfolio_id, {r('wv / sqrt(o + x)','ratio')} FROM ow JOIN cr USING (portfolio_id)""")
def diversification(spark, sf):
    v = I.momentum(V.daily(spark, sf)).select(F.col("symbol").alias("holding"), F.col("vol_1y").alias("vol"))
    b = basket(spark, sf)
    return K.diversification(K.basket_pairs(b), _corr(spark, sf, {"1y": 252}), b, v).withColumn("ratio", tidy(F.col("ratio")))


@query("corr_clusters", _RV + _PAIR + f""", {_CORRW}, ed AS (SELECT portfolio_id, a, b FROM pr JOIN cw USING (a, b) WHERE win = '1y' AND c >= 0.0), e2 AS (SELECT portfolio_id, a, b FROM ed UNION SELECT portfolio_id, b, a FROM ed UNION SELECT portfolio_id, holding, holding FROM bk),
re AS (SELECT portfolio_id, a, b FROM e2 UNION SELECT re.portfolio_id, re.a, e2.b FROM re JOIN e2 ON e2.portfolio_id = re.portfolio_id AND e2.a = re.b), cp AS (SELECT portfolio_id, a AS holding, min(b) AS cluster FROM re GROUP BY 1, 2), sz AS (SELECT *, count(*) OVER (PARTITION BY portfolio_id, cluster) AS size FROM cp)
SELECT portfolio_id, holding, cluster, size FROM sz WHERE size >= 2""")
def corr_clusters(spark, sf):
    """Groups at a correlation of zero or more: the derived walks are independent, so the default of 0.7 would link nothing."""
    b = basket(spark, sf)
    return K.clusters(K.basket_pairs(b), _corr(spark, sf, {"1y": 252}), b, 0.0)


_PORT = f"""wn AS (SELECT *, weight / sum(weight) OVER g AS w, count(*) OVER g AS n FROM bk WINDOW g AS (PARTITION BY portfolio_id)), po AS (SELECT portfolio_id, date, sum(w * r) AS r FROM wn JOIN ra USING (holding) WHERE age <= 252 GROUP BY portfolio_id, date, n HAVING count(*) = n)"""


@query("portfolio_beta", _RV + f"""{_BK}, {_RET}, {_PORT} SELECT portfolio_id, count(*) AS n, {r('covar_pop(po.r, x.r) / var_pop(x.r)','beta')}, {r('corr(po.r, x.r)','correlation')} FROM po JOIN ra x ON x.holding = '1-URGENT' AND x.age <= 252 AND x.date = po.date GROUP BY 1 HAVING count(*) >= 40""")
def portfolio_beta(spark, sf):
    ret = _returns(spark, sf, 252)
    p = K.portfolio_returns(basket(spark, sf), ret)
    return K.portfolio_beta(p, ret.filter("holding = '1-URGENT'")).withColumns({c: tidy(F.col(c)) for c in ("beta", "correlation")})


@query("shared_dates", _RV + f"{_BK}, {_RET}, {_PORT} SELECT portfolio_id, count(*) AS dates, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date FROM po GROUP BY 1")
def shared_dates(spark, sf):
    p = K.portfolio_returns(basket(spark, sf), _returns(spark, sf, 252))
    return p.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("dates"), F.min("date").cast("string").alias("first_date"), F.max("date").cast("string").alias("last_date"))


_PROX = {"growth": ("1-URGENT", 0.02), "rates": ("2-HIGH", 0.02), "usd": ("3-MEDIUM", 0.05), "oil": ("4-NOT SPECIFIED", 0.0)}
_PX = ", ".join(f"('{k}', '{s}', {t})" for k, (s, t) in _PROX.items())


@query("macro_hits", _RV + f"""{_BK}, {_RET}, px AS (SELECT * FROM (VALUES {_PX}) v(proxy, sym, need)), pc AS (SELECT a.holding, proxy, need, corr(a.r, b.r) AS c FROM px JOIN ra b ON b.holding = sym AND b.age <= 252 JOIN ra a ON a.date = b.date AND a.age <= 252 GROUP BY 1, 2, 3 HAVING count(*) >= 40),
hi AS (SELECT * FROM pc WHERE CASE WHEN proxy = 'usd' THEN abs(c) >= need ELSE c >= need END) SELECT portfolio_id, proxy, count(*) AS count, {r('sum(weight)','weight',4)}, string_agg(holding, ',' ORDER BY holding) AS holders FROM bk JOIN hi USING (holding) GROUP BY 1, 2""")
def macro_hits(spark, sf):
    return _t(K.macro_hits(basket(spark, sf), _returns(spark, sf, 252), _PROX), "weight")


_MV = "mv AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', [{', '.join(chr(39) + v + chr(39) for v in vs)}])" for k, vs in K.MACRO_FACTORS.items()) + ") v(variable, keys))"


@query("macro_view", _W + f"""{_BK}, {_EX}, {_MV}, hv AS (SELECT DISTINCT holding, variable FROM ex JOIN mv ON list_contains(keys, factor_key) WHERE factor_key NOT IN ('theme:ai', 'theme:data_center', 'customer:hyperscalers') OR strength IN {_MAT})
SELECT portfolio_id, variable, count(*) AS count, string_agg(holding, ',' ORDER BY holding) AS holders, count(*) >= 2 AS shared FROM bk JOIN hv USING (holding) GROUP BY 1, 2""")
def macro_view(spark, sf):
    return K.macro_view(basket(spark, sf), exposures(spark, sf))


_CAT = "CASE WHEN starts_with(factor_key, 'concentration:') THEN 'Customer concentration' WHEN factor_key = 'customer:hyperscalers' THEN 'Customers' WHEN factor_key = 'customer:us_gov' THEN 'Government contracts' WHEN starts_with(factor_key, 'geo:') THEN 'Geography' WHEN starts_with(factor_key, 'policy:') THEN 'Regulation & policy' WHEN kind = 'supplier' THEN 'Suppliers & manufacturing' WHEN kind = 'customer' THEN 'Customers' ELSE 'Other' END"


@query("dependency_view", _W + _HO + f""" SELECT portfolio_id, factor_key, {_CAT} AS category, count(DISTINCT holding) AS holders, count(*) FILTER (strength IN {_MATL}) AS material, {r(f'coalesce(sum(weight) FILTER (strength IN {_MATL}), 0)','weight',4)},
  count(*) FILTER (strength IN {_MATL}) >= 2 AND NOT fgen AS major FROM ho WHERE kind IN ('supplier', 'customer', 'partner', 'geography', 'policy') GROUP BY portfolio_id, factor_key, kind, fgen HAVING count(DISTINCT holding) >= 2""")
def dependency_view(spark, sf):
    return _t(K.dependency_view(_ho(spark, sf)), "weight")


_FU = """fu AS (SELECT o_orderpriority AS holding, sum(l_extendedprice * (0.05 - l_discount)) AS fcf, avg(l_quantity) / 12.75 AS runway, avg(l_tax) * 2.5 AS dilution, avg(l_discount) * 4 AS growth, avg(0.05 - l_discount) AS op_margin, avg(l_quantity) * 0.59 AS ps
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"""


@query("stress_rules", _W + f"""{_BK}, {_FU}, ru AS (SELECT holding, unnest(list_filter([CASE WHEN fcf < 0 THEN 'burning_cash' END, CASE WHEN fcf < 0 AND runway < 2 THEN 'short_runway' END, CASE WHEN dilution > 0.1 THEN 'dilution' END, CASE WHEN growth > 0.2 THEN 'growth' END,
  CASE WHEN op_margin < 0 THEN 'losses' END, CASE WHEN ps > 15 THEN 'rich_valuation' END], lambda z: z IS NOT NULL)) AS rule FROM fu) SELECT portfolio_id, rule, count(*) AS count, {r('sum(weight)','weight',4)}, string_agg(holding, ',' ORDER BY holding) AS holders FROM bk JOIN ru USING (holding) GROUP BY 1, 2""")
def stress_rules(spark, sf):
    return _t(K.stress_rules(basket(spark, sf), fundamentals(spark, sf)), "weight")


@query("blind_spots", _RV + f"""{_PAIR}, {_CORRW}, {_SC}, {_FU}, nb AS (SELECT portfolio_id, count(*) AS n FROM bk GROUP BY 1), be AS (SELECT a.holding, covar_pop(a.r, b.r) / var_pop(b.r) AS beta FROM ra a JOIN ra b ON b.holding = '1-URGENT' AND b.date = a.date AND a.age <= 252 AND b.age <= 252 GROUP BY 1 HAVING count(*) >= 40),
al AS (SELECT portfolio_id, 'sector' AS kind, max(weight) AS value FROM sw GROUP BY 1 HAVING max(weight) >= 60 UNION ALL SELECT portfolio_id, 'coverage', (8 - count(*) FILTER (weight >= 1))::DOUBLE FROM sw GROUP BY 1 HAVING 8 - count(*) FILTER (weight >= 1) >= 5
  UNION ALL SELECT portfolio_id, 'regime', avg(c) FROM pr JOIN cw USING (a, b) JOIN nb USING (portfolio_id) WHERE win = '1y' AND n >= 3 GROUP BY 1 HAVING avg(c) >= 0.5 UNION ALL SELECT portfolio_id, 'beta', min(beta) FROM bk JOIN be USING (holding) GROUP BY 1 HAVING count(beta) >= 2 AND min(beta) > 1.1
  UNION ALL SELECT portfolio_id, 'funding', v FROM (SELECT portfolio_id, (count(*) FILTER (op_margin < 0))::DOUBLE AS v FROM bk JOIN fu USING (holding) GROUP BY 1) JOIN nb USING (portfolio_id) WHERE v >= 2 AND v >= n - 1) SELECT portfolio_id, kind, {r('value','value',4)} FROM al""")
def blind_spots(spark, sf):
    b = basket(spark, sf)
    ret = _returns(spark, sf, 252)
    base = ret.filter("holding = '1-URGENT'").select("date", F.col("r").alias("p"))
    betas = ret.join(base, "date").groupBy("holding").agg(F.count(F.lit(1)).alias("n"), (F.covar_pop("r", "p") / F.var_pop("p")).alias("beta")).filter("n >= 40").select("holding", "beta")
    x = K.blind_spots(K.sector_weights(b, sectors(spark, sf)), ALL_SECTORS, _corr(spark, sf, {"1y": 252}), K.basket_pairs(b), b, betas, fundamentals(spark, sf))
    return _t(x, "value")
