"""Weighted baskets: shared exposures, look-through, correlation structure, scenarios.

A basket is a short list (inputs are limited to ``MAX_HOLDINGS`` upstream), so its pairs are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import change, ratio
from tidemark.operators.graph import connected_components
from tidemark.operators.ordered import by_symbol

# Fixed values.
MAX_HOLDINGS = 20
MATERIAL = ["disclosed", "emphasized", "measured", "classification"]
MATERIAL_LT = [*MATERIAL, "look-through"]
STRENGTH_RANK = {"disclosed": 3, "emphasized": 2, "classification": 2, "measured": 2, "mentioned": 1}
GENERAL_POLICY = ["policy:Tax policy", "policy:Sector regulation", "policy:Antitrust & competition law"]
SPECIFIC_GEOS = ["China", "Taiwan", "Hong Kong", "Russia / Ukraine", "Israel", "Middle East", "South Korea"]
MIN_POINTS = 40
SAME_BET_OVERLAP, SAME_BET_CORR, CLUSTER_CORR = 0.3, 0.6, 0.7
CORR_WINDOWS = {"1m": 21, "3m": 63, "6m": 126, "1y": 252, "3y": 756, "max": None}  # None: the whole history
KIND_RANK = {"theme": 0, "customer": 0, "supplier": 0, "geography": 1, "policy": 1, "partner": 2, "industry": 2, "financial": 3}
SCENARIOS = {
    "ai_capex": ["theme:ai", "customer:hyperscalers", "theme:data_center"],
    "rates": ["fund:burning_cash", "fund:high_valuation", "fund:high_debt"],
    "export": ["policy:Export controls", "geo:China"],
    "tsmc": ["entity:TSMC", "geo:Taiwan"],
    "china": ["geo:China", "policy:Tariffs & trade"],
    "gov": ["customer:us_gov", "policy:Government contracts & procurement", "policy:Subsidies & incentives"],
    "funding": ["fund:burning_cash", "fund:dilution"],
    "quantum": ["theme:quantum"],
}
DEPENDENCY_CATEGORY = [
    ("concentration:", "Customer concentration"), ("customer:hyperscalers", "Customers"), ("customer:us_gov", "Government contracts"),
    ("policy:Government contracts", "Government contracts"), ("geo:", "Geography"), ("policy:", "Regulation & policy"),
]
MACRO_FACTORS = {
    "rates": ["macro:Interest rates", "fund:high_valuation", "fund:burning_cash", "fund:high_debt"], "usd": ["macro:Currency / U.S. dollar"],
    "growth": ["macro:Economic cycle", "macro:Industry cyclicality"], "capex": ["macro:Business / IT spending", "theme:ai", "theme:data_center", "customer:hyperscalers"],
    "consumer": ["macro:Consumer spending"], "inflation": ["macro:Inflation"], "commodities": ["macro:Commodities / energy"], "credit": ["macro:Credit / financing", "fund:burning_cash", "fund:dilution"],
}
MATERIAL_ONLY = ["theme:ai", "theme:data_center", "customer:hyperscalers"]
# Scenario words: a pattern in the question and the factors it points to.
SCENARIO_WORDS = [
    (r"\bai\b|artificial intelligence|capex|data ?cent|hyperscal", ["theme:ai", "customer:hyperscalers", "theme:data_center"]),
    (r"\brates?\b|interest|fed\b|yields?", ["fund:burning_cash", "fund:high_valuation", "fund:high_debt"]),
    (r"export|entity list", ["policy:Export controls"]), (r"china|chinese|beijing", ["geo:China"]), (r"taiwan|tsmc", ["entity:TSMC", "geo:Taiwan"]),
    (r"tariff|trade war", ["policy:Tariffs & trade"]), (r"government|defen[cs]e|contract", ["customer:us_gov", "policy:Government contracts & procurement"]),
    (r"recession|consumer|slowdown", ["macro:Consumer spending", "macro:Economic cycle"]), (r"dilut|funding|raise capital|issuance", ["fund:burning_cash", "fund:dilution"]),
    (r"quantum", ["theme:quantum"]), (r"samsung", ["entity:Samsung"]), (r"memory|hbm|micron|sk hynix", ["entity:SK hynix", "entity:Micron"]),
]


def normalize_weights(basket: DataFrame, cash: Column) -> DataFrame:
    """Blank weights share what is left; everything is scaled so weights and cash make 100."""
    g = Window.partitionBy("portfolio_id")
    x = basket.withColumn("cash", F.greatest(cash, F.lit(0.0)))
    given, missing = F.sum("weight").over(g), F.count_if(F.col("weight").isNull()).over(g)
    x = x.withColumn("_rest", F.greatest(F.lit(0.0), 100 - F.col("cash") - F.coalesce(given, F.lit(0.0)))).withColumn("_miss", missing)
    x = x.withColumn("weight", F.coalesce("weight", ratio(F.col("_rest"), F.col("_miss"))))
    total = F.sum("weight").over(g) + F.col("cash")
    x = x.withColumn("_t", total)
    return x.select("portfolio_id", "holding", F.coalesce(ratio(F.col("weight") * 100, F.col("_t")), F.lit(0.0)).alias("weight"), F.coalesce(ratio(F.col("cash") * 100, F.col("_t")), F.lit(0.0)).alias("cash"))


def is_general(kind: Column, key: Column, strength: Column) -> Column:
    geo = F.substring_index(key, ":", -1)
    return (kind == "macro") | key.isin(GENERAL_POLICY) | ((kind == "geography") & ~geo.isin(SPECIFIC_GEOS) & (strength != "disclosed"))


def holders(basket: DataFrame, exposures: DataFrame) -> DataFrame:
    """(portfolio, factor, holding, strength, weight) with the factor's general flag."""
    x = basket.join(exposures, "holding").withColumn("general", is_general(F.col("kind"), F.col("factor_key"), F.col("strength")))
    first = x.groupBy("portfolio_id", "factor_key").agg(F.min_by("general", "holding").alias("f_general"))
    return x.join(first, ["portfolio_id", "factor_key"])


def look_through(basket: DataFrame, fund_holdings: DataFrame, exposures: DataFrame, min_weight: float = 0.02, strong: float = 0.05) -> DataFrame:
    """Material factors a fund inherits from positions that are also held directly."""
    b = basket.select("portfolio_id", F.col("holding").alias("fund"), F.col("weight").alias("fund_weight"))
    d = basket.select("portfolio_id", "holding")
    f = fund_holdings.filter(F.col("share") >= min_weight).filter("fund <> holding")
    pos = b.join(f, "fund").join(d, ["portfolio_id", "holding"])
    x = pos.join(exposures.filter(F.col("strength").isin(MATERIAL)), "holding").filter(~is_general(F.col("kind"), F.col("factor_key"), F.col("strength")) & ~F.col("factor_key").rlike("^(fund|industry|sector):"))
    g = x.groupBy("portfolio_id", "factor_key", "kind", "fund", "fund_weight").agg(F.max("share").alias("share"))
    own = basket.join(exposures, "holding").select("portfolio_id", "factor_key", F.col("holding").alias("fund"))
    g = g.join(own, ["portfolio_id", "factor_key", "fund"], "left_anti")
    return g.select("portfolio_id", "factor_key", "kind", F.col("fund").alias("holding"), F.when(F.col("share") >= strong, "look-through").otherwise("mentioned").alias("strength"), F.col("fund_weight").alias("weight"))


def with_look_through(basket: DataFrame, fund_holdings: DataFrame, exposures: DataFrame) -> DataFrame:
    h = holders(basket, exposures)
    lt = look_through(basket, fund_holdings, exposures)
    flag = h.select("portfolio_id", "factor_key", "f_general").distinct()
    cols = ["portfolio_id", "factor_key", "kind", "holding", "strength", "weight", "f_general"]
    return h.select(*cols).unionByName(lt.join(flag, ["portfolio_id", "factor_key"]).select(*cols))


def concentration(holder_rows: DataFrame, basket: DataFrame) -> DataFrame:
    """Factors at least two holdings depend on materially and that dominate the basket."""
    n = basket.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n"))
    mat = F.col("strength").isin(MATERIAL_LT)
    g = holder_rows.groupBy("portfolio_id", "factor_key", "kind", "f_general").agg(
        F.count_if(mat).alias("count"), F.sum("weight").alias("weight"), F.coalesce(F.sum(F.when(mat, F.col("weight"))), F.lit(0.0)).alias("material_weight"),
        F.array_join(F.array_sort(F.collect_set(F.when(mat, F.col("holding")))), ",").alias("holders"))
    g = g.join(n, "portfolio_id")
    keep = (F.col("count") >= 2) & ((F.col("material_weight") >= 50) | ((F.col("n") >= 3) & (F.col("count") >= F.col("n") - 1)))
    return g.filter(keep).withColumnRenamed("f_general", "general")


def merged_concentration(conc: DataFrame) -> DataFrame:
    """Concentrations with identical holder sets read as one line, the leading line first."""
    c = conc.filter(~F.col("general"))
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in KIND_RANK.items()], F.lit(4))
    c = c.withColumn("_r", rank)
    alone = F.when(F.col("kind").isin("industry", "financial"), F.col("factor_key")).otherwise("")
    order = F.struct("_r", (-F.col("material_weight")).alias("w"), (-F.col("count")).alias("c"), "factor_key")
    g = c.groupBy("portfolio_id", "holders", alone.alias("_alone")).agg(F.min(order).alias("o"), F.array_join(F.array_sort(F.collect_set("factor_key")), ",").alias("factors"), F.max("count").alias("count"))
    w = Window.partitionBy("portfolio_id").orderBy("o")
    return g.withColumn("line", F.row_number().over(w)).select("portfolio_id", "line", "holders", "factors", "count")


def lenses(holder_rows: DataFrame) -> DataFrame:
    """Dependency / thematic / macro tables: factors with two material holders."""
    lens = (F.when(F.col("kind").isin("supplier", "customer", "partner", "geography", "policy") & ~F.col("f_general"), "dependency").when(F.col("kind").isin("theme", "industry", "sector") & ~F.col("f_general"), "thematic")
            .when(F.col("kind").isin("financial", "macro") | ((F.col("kind") == "policy") & F.col("f_general")), "macro"))
    mat = F.col("strength").isin(MATERIAL_LT)
    x = holder_rows.withColumn("lens", lens).filter("lens is not null")
    g = x.groupBy("portfolio_id", "lens", "factor_key").agg(F.count_if(mat).alias("count"), F.sum(F.when(mat, F.col("weight"))).alias("weight"), F.count(F.lit(1)).alias("holders"))
    return g.filter(F.col("count") >= 2)


def theme_levels(holder_rows: DataFrame, mentions: DataFrame) -> DataFrame:
    """HIGH / MODERATE / INDIRECT per holding; a theme is shared with two direct holders."""
    x = holder_rows.filter(F.col("kind").isin("theme", "industry", "sector")).join(mentions, ["holding", "factor_key"], "left")
    m = F.col("mentions")
    level = (F.when(F.col("strength") == "look-through", "indirect").when((F.col("kind") == "industry") | (m >= 15) | ((F.col("kind") == "sector") & (F.col("strength") == "measured")), "high")
             .when((F.col("kind") == "sector") | (m >= 5), "moderate").when((F.col("strength") == "mentioned") & m.isNull(), "indirect").otherwise("moderate"))
    x = x.withColumn("level", level)
    direct = F.col("level").isin("high", "moderate")
    return x.groupBy("portfolio_id", "factor_key", "kind").agg(
        F.count_if(F.col("level") == "high").alias("high"), F.count_if(F.col("level") == "moderate").alias("moderate"), F.count_if(F.col("level") == "indirect").alias("indirect"),
        F.coalesce(F.sum(F.when(direct, F.col("weight"))), F.lit(0.0)).alias("weight"), F.count_if(direct).alias("_d")).select(
        "portfolio_id", "factor_key", "high", "moderate", "indirect", "weight", ((F.col("_d") >= 2) & (F.col("kind") != "sector")).alias("shared"))


def effective_weights(basket: DataFrame, fund_holdings: DataFrame, min_share: float = 0.02) -> DataFrame:
    """Direct weight plus what funds in the basket hold of it."""
    f = basket.select("portfolio_id", F.col("holding").alias("fund"), F.col("weight").alias("fw")).join(fund_holdings.filter(F.col("share") >= min_share), "fund").filter("fund <> holding")
    through = f.groupBy("portfolio_id", "holding").agg(F.sum(F.col("fw") * F.col("share")).alias("through"))
    x = basket.join(through, ["portfolio_id", "holding"], "left").withColumn("through", F.coalesce("through", F.lit(0.0)))
    return x.select("portfolio_id", "holding", "weight", "through", (F.col("weight") + F.col("through")).alias("effective"))


def sector_weights(basket: DataFrame, sectors: DataFrame) -> DataFrame:
    """Weights by sector; ``sectors(holding, sector, share)`` spreads a fund over several."""
    return basket.join(sectors, "holding").groupBy("portfolio_id", "sector").agg(F.sum(F.col("weight") * F.col("share")).alias("weight"))


def scenario_reach(basket: DataFrame, exposures: DataFrame, scenarios: dict[str, Sequence[str]] = SCENARIOS) -> DataFrame:
    """Per scenario and basket: holdings reached, material and total weight, holdings not reached."""
    s = F.explode(F.array(*[F.struct(F.lit(k).alias("scenario"), F.array(*[F.lit(v) for v in keys]).alias("keys")) for k, keys in scenarios.items()]))
    n = basket.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n")).withColumn("s", s).select("portfolio_id", "n", "s.scenario")
    tag = F.filter(F.array(*[F.when(F.col("factor_key").isin(list(keys)), F.lit(k)) for k, keys in scenarios.items()]), lambda k: k.isNotNull())
    rank = F.coalesce(*[F.when(F.col("strength") == k, F.lit(v)) for k, v in STRENGTH_RANK.items()], F.lit(0))
    hit = exposures.withColumn("scenario", F.explode(tag)).groupBy("holding", "scenario").agg(F.max_by("strength", F.struct(rank.alias("r"), F.col("strength").alias("s"))).alias("strongest"))
    x = basket.join(hit, "holding").groupBy("portfolio_id", "scenario").agg(
        F.count(F.lit(1)).alias("reached"), F.sum(F.when(F.col("strongest").isin(MATERIAL), F.col("weight"))).alias("material_weight"), F.sum("weight").alias("any_weight"))
    x = n.join(x, ["portfolio_id", "scenario"], "left").fillna(0, ["reached", "material_weight", "any_weight"])
    return x.select("portfolio_id", "scenario", "reached", "material_weight", "any_weight", (F.col("n") - F.col("reached")).alias("unexposed"))


def unexposed(basket: DataFrame, exposures: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Holdings no factor of the list reaches."""
    return basket.join(exposures.filter(F.col("factor_key").isin(list(keys))), "holding", "left_anti").select("portfolio_id", "holding")


def scenario_keys(text: Column) -> Column:
    """Factor keys a free-text scenario points to, by the word rules."""
    low = F.lower(text)
    return F.array_distinct(F.flatten(F.filter(F.array(*[F.when(low.rlike(p), F.array(*[F.lit(k) for k in ks])) for p, ks in SCENARIO_WORDS]), lambda a: a.isNotNull())))


# --- returns of holdings -------------------------------------------------------------------------------

def last_returns(closes: DataFrame, n: int | None = None) -> DataFrame:
    """Each holding's simple returns (the last ``n``), newest first in ``age`` (1-based)."""
    w = by_symbol()
    x = closes.withColumn("r", change(F.col("close"), F.lag("close").over(w))).filter("r is not null")
    x = x.withColumn("age", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("date"))))
    x = x if n is None else x.filter(F.col("age") <= n)
    return x.select(F.col("symbol").alias("holding"), "date", "r", "age")


def basket_pairs(basket: DataFrame) -> DataFrame:
    """Pairs a < b inside each basket: the correlation matrix itself, a few hundred entries per basket."""
    b = basket
    l = b.select("portfolio_id", F.col("holding").alias("a"), F.col("weight").alias("wa"))
    r = b.select("portfolio_id", F.col("holding").alias("b"), F.col("weight").alias("wb"))
    return l.join(r, "portfolio_id").filter("a < b")


def pair_correlations(pairs: DataFrame, returns: DataFrame, windows: dict[str, int | None]) -> DataFrame:
    """Correlation of every distinct pair over several windows from one join on the date."""
    p = pairs.select("a", "b").distinct()
    ra = returns.select(F.col("holding").alias("a"), "date", F.col("r").alias("x"), F.col("age").alias("age_a"))
    rb = returns.select(F.col("holding").alias("b"), "date", F.col("r").alias("y"), F.col("age").alias("age_b"))
    j = p.join(ra, "a").join(rb, ["b", "date"])
    old = F.greatest("age_a", "age_b")
    tags = F.filter(F.array(*[F.when(F.lit(True) if n is None else old <= n, F.struct(F.lit(k).alias("window"), F.lit(40 if n is None else min(40, max(15, int(n * 0.7)))).alias("need"))) for k, n in windows.items()]), lambda t: t.isNotNull())
    g = j.withColumn("t", F.explode(tags)).groupBy("a", "b", "t.window", "t.need").agg(F.count(F.lit(1)).alias("days"), F.corr("x", "y").alias("correlation"))
    return g.withColumn("correlation", F.when(F.col("days") >= F.col("need"), F.col("correlation"))).drop("need")


def material_sets(exposures: DataFrame) -> DataFrame:
    """A holding's material, specific factor keys (a few dozen at most)."""
    x = exposures.filter(F.col("strength").isin(MATERIAL) & ~F.col("factor_key").startswith("industry:") & ~is_general(F.col("kind"), F.col("factor_key"), F.col("strength")))
    return x.groupBy("holding").agg(F.collect_set("factor_key").alias("keys"))


def classify_pairs(pairs: DataFrame, corr: DataFrame, exposures: DataFrame) -> DataFrame:
    """same_bet / hidden / market / independent from dependency overlap and correlation."""
    m = material_sets(exposures)
    x = pairs.join(corr.select("a", "b", "correlation"), ["a", "b"], "left").join(m.select(F.col("holding").alias("a"), F.col("keys").alias("ka")), "a", "left").join(m.select(F.col("holding").alias("b"), F.col("keys").alias("kb")), "b", "left")
    none = F.array().cast("array<string>")
    ka, kb = F.coalesce("ka", none), F.coalesce("kb", none)
    union, shared = F.size(F.array_union(ka, kb)), F.size(F.array_intersect(ka, kb))
    x = x.withColumn("overlap", F.coalesce(ratio(shared, union), F.lit(0.0))).withColumn("shared", shared)
    high = F.coalesce(F.col("correlation") >= SAME_BET_CORR, F.lit(False))
    close = F.col("overlap") >= SAME_BET_OVERLAP
    return x.withColumn("kind", F.when(close & high, "same_bet").when(close, "hidden").when(high, "market").otherwise("independent"))


def diversification(pairs: DataFrame, corr: DataFrame, basket: DataFrame, vols: DataFrame) -> DataFrame:
    """Weighted volatility over portfolio volatility; needs every correlation and volatility."""
    b = basket.join(vols, "holding", "left").withColumn("w", F.col("weight") / 100)
    own = b.groupBy("portfolio_id").agg(F.sum(F.col("w") * F.col("vol")).alias("_wv"), F.sum(F.pow(F.col("w") * F.col("vol"), 2)).alias("_own"), F.count_if(F.col("vol").isNull()).alias("_miss"), F.count(F.lit(1)).alias("n"))
    v = vols.select(F.col("holding").alias("h"), "vol")
    p = pairs.join(corr.select("a", "b", "correlation"), ["a", "b"], "left").join(v.select(F.col("h").alias("a"), F.col("vol").alias("va")), "a").join(v.select(F.col("h").alias("b"), F.col("vol").alias("vb")), "b")
    cross = p.groupBy("portfolio_id").agg(F.sum(2 * F.col("wa") / 100 * F.col("wb") / 100 * F.col("va") * F.col("vb") * F.col("correlation")).alias("_cross"), F.count_if(F.col("correlation").isNull()).alias("_nc"))
    x = own.join(cross, "portfolio_id").filter("_miss = 0 and _nc = 0 and n > 1")
    var = F.col("_own") + F.col("_cross")
    return x.select("portfolio_id", F.when(var > 0, F.col("_wv") / F.sqrt(var)).alias("ratio"))


def correlation_view(pairs: DataFrame, corr: DataFrame, top: int = 5) -> DataFrame:
    """The five closest and five most distant pairs per basket and window, with the average."""
    x = pairs.join(corr, ["a", "b"]).filter("correlation is not null")
    g = Window.partitionBy("portfolio_id", "window")
    x = x.withColumns({"average": F.avg("correlation").over(g), "rank_high": F.row_number().over(g.orderBy(F.desc("correlation"), "a", "b")), "rank_low": F.row_number().over(g.orderBy("correlation", "a", "b"))})
    return x.filter((F.col("rank_high") <= top) | (F.col("rank_low") <= top)).select("portfolio_id", "window", "a", "b", "days", "correlation", "average", "rank_high", "rank_low")


def short_history(returns: DataFrame, basket: DataFrame, n: int | None = None) -> DataFrame:
    """Holdings with under 80 % of the window's (or the longest holding's) returns."""
    c = (returns if n is None else returns.filter(F.col("age") <= n)).groupBy("holding").agg(F.count(F.lit(1)).alias("have"))
    x = basket.join(c, "holding").withColumn("_m", F.max("have").over(Window.partitionBy("portfolio_id")))
    return x.select("portfolio_id", "holding", "have", (F.col("have") < 0.8 * (F.col("_m") if n is None else F.least(F.lit(n), F.col("_m")))).alias("short"))


def clusters(pairs: DataFrame, corr: DataFrame, basket: DataFrame, threshold: float = CLUSTER_CORR) -> DataFrame:
    """Single-linkage groups of holdings correlated at or above the threshold, two members at least."""
    name = lambda c: F.concat_ws("\x1f", "portfolio_id", c)
    e = pairs.join(corr, ["a", "b"]).filter(F.col("correlation") >= threshold).select(name("a").alias("a"), name("b").alias("b"))
    comp = connected_components(e, basket.select(name("holding").alias("id")))
    x = comp.select(F.split("id", "\x1f").alias("p"), "component").select(F.col("p")[0].alias("portfolio_id"), F.col("p")[1].alias("holding"), F.split("component", "\x1f")[1].alias("cluster"))
    size = F.count(F.lit(1)).over(Window.partitionBy("portfolio_id", "cluster"))
    return x.withColumn("size", size).filter("size >= 2")


def portfolio_returns(basket: DataFrame, returns: DataFrame) -> DataFrame:
    """Weighted return on the dates every holding has one."""
    g = Window.partitionBy("portfolio_id")
    b = basket.withColumn("w", F.col("weight") / F.sum("weight").over(g)).withColumn("n", F.count(F.lit(1)).over(g))
    x = b.join(returns, "holding").groupBy("portfolio_id", "date", "n").agg(F.count(F.lit(1)).alias("have"), F.sum(F.col("w") * F.col("r")).alias("r"))
    return x.filter("have = n").select("portfolio_id", "date", "r")


def portfolio_beta(port: DataFrame, proxy: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Population beta and correlation against a proxy on common dates."""
    x = port.join(proxy.select("date", F.col("r").alias("p")), "date").groupBy("portfolio_id").agg(
        F.count(F.lit(1)).alias("n"), F.covar_pop("r", "p").alias("_c"), F.var_pop("p").alias("_v"), F.corr("r", "p").alias("correlation"))
    return x.filter(F.col("n") >= min_points).select("portfolio_id", "n", ratio(F.col("_c"), F.col("_v")).alias("beta"), "correlation")


def macro_hits(basket: DataFrame, returns: DataFrame, proxies: dict[str, tuple[str, float]], absolute: Sequence[str] = ("usd",), min_points: int = MIN_POINTS) -> DataFrame:
    """Holdings whose correlation with a macro proxy passes that proxy's threshold."""
    tag = F.coalesce(*[F.when(F.col("holding") == s, F.struct(F.lit(k).alias("proxy"), F.lit(t).alias("need"), F.lit(k in absolute).alias("abs"))) for k, (s, t) in proxies.items()])
    p = returns.withColumn("p", tag).filter("p is not null").select("date", F.col("r").alias("y"), "p.*")
    c = returns.join(p, "date").groupBy("holding", "proxy", "need", "abs").agg(F.count(F.lit(1)).alias("n"), F.corr("r", "y").alias("c")).filter(F.col("n") >= min_points)
    hit = c.filter(F.when(F.col("abs"), F.abs("c") >= F.col("need")).otherwise(F.col("c") >= F.col("need")))
    return basket.join(hit, "holding").groupBy("portfolio_id", "proxy").agg(F.count(F.lit(1)).alias("count"), F.sum("weight").alias("weight"), F.array_join(F.array_sort(F.collect_list("holding")), ",").alias("holders"))


def macro_view(basket: DataFrame, exposures: DataFrame) -> DataFrame:
    """Macro variables with the holdings that state an exposure (filings, traits, material themes)."""
    ok = ~F.col("factor_key").isin(MATERIAL_ONLY) | F.col("strength").isin(MATERIAL)
    tags = F.filter(F.array(*[F.when(F.col("factor_key").isin(keys), F.lit(v)) for v, keys in MACRO_FACTORS.items()]), lambda t: t.isNotNull())
    x = exposures.filter(ok).withColumn("variable", F.explode(tags)).select("holding", "variable").distinct()
    g = basket.join(x, "holding").groupBy("portfolio_id", "variable").agg(F.count(F.lit(1)).alias("count"), F.array_join(F.array_sort(F.collect_list("holding")), ",").alias("holders"))
    return g.withColumn("shared", F.col("count") >= 2)


def dependency_category(key: Column, kind: Column) -> Column:
    c = F.lit(None).cast("string")
    for prefix, cat in reversed(DEPENDENCY_CATEGORY):
        c = F.when(key.startswith(prefix), cat).otherwise(c)
    rest = F.when(kind == "supplier", "Suppliers & manufacturing").when(kind == "customer", "Customers").when(kind == "partner", "Partners & distribution").otherwise("Other")
    return F.coalesce(c, rest)


def dependency_view(holder_rows: DataFrame) -> DataFrame:
    """Dependencies two or more holdings share, with their category and whether they are major."""
    x = holder_rows.filter(F.col("kind").isin("supplier", "customer", "partner", "geography", "policy"))
    mat = F.col("strength").isin(MATERIAL_LT)
    g = x.groupBy("portfolio_id", "factor_key", "kind", "f_general").agg(F.count_distinct("holding").alias("holders"), F.count_if(mat).alias("material"), F.sum(F.when(mat, F.col("weight"))).alias("weight"))
    return g.filter(F.col("holders") >= 2).select("portfolio_id", "factor_key", dependency_category(F.col("factor_key"), F.col("kind")).alias("category"), "holders", "material", F.coalesce("weight", F.lit(0.0)).alias("weight"),
                                                  ((F.col("material") >= 2) & ~F.col("f_general")).alias("major"))


# Rule name and the test on a holding's fundamentals.
STRESS_RULES = {
    "burning_cash": "fcf < 0", "short_runway": "fcf < 0 and runway < 2", "dilution": "dilution > 0.1", "growth": "growth > 0.2", "losses": "op_margin < 0", "rich_valuation": "ps > 15",
}


def stress_rules(basket: DataFrame, fundamentals: DataFrame) -> DataFrame:
    rules = F.filter(F.array(*[F.when(F.expr(e), F.lit(k)) for k, e in STRESS_RULES.items()]), lambda r: r.isNotNull())
    x = basket.join(fundamentals, "holding").withColumn("rule", F.explode(rules))
    return x.groupBy("portfolio_id", "rule").agg(F.count(F.lit(1)).alias("count"), F.sum("weight").alias("weight"), F.array_join(F.array_sort(F.collect_list("holding")), ",").alias("holders"))


def blind_spots(sectors: DataFrame, all_sectors: Sequence[str], corr: DataFrame, pairs: DataFrame, basket: DataFrame, betas: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Descriptive rules as rows: one sector, missing sectors, one regime, high betas, funding need."""
    n = basket.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("n"))
    sec = sectors.groupBy("portfolio_id").agg(F.max("weight").alias("value"), F.count_if(F.col("sector").isin(list(all_sectors)) & (F.col("weight") >= 1)).alias("_have"))
    a = sec.filter("value >= 60").select("portfolio_id", F.lit("sector").alias("kind"), "value")
    b = sec.withColumn("value", (F.lit(len(all_sectors)) - F.col("_have")).cast("double")).filter("value >= 5").select("portfolio_id", F.lit("coverage").alias("kind"), "value")
    c = pairs.join(corr, ["a", "b"]).groupBy("portfolio_id").agg(F.avg("correlation").alias("value")).join(n, "portfolio_id").filter("value >= 0.5 and n >= 3").select("portfolio_id", F.lit("regime").alias("kind"), "value")
    d = basket.join(betas, "holding").groupBy("portfolio_id").agg(F.min("beta").alias("value"), F.count("beta").alias("_k")).filter("_k >= 2 and value > 1.1").select("portfolio_id", F.lit("beta").alias("kind"), "value")
    e = basket.join(fundamentals, "holding").groupBy("portfolio_id").agg(F.count_if(F.col("op_margin") < 0).cast("double").alias("value")).join(n, "portfolio_id").filter("value >= 2 and value >= n - 1").select("portfolio_id", F.lit("funding").alias("kind"), "value")
    return a.unionByName(b).unionByName(c).unionByName(d).unionByName(e)
