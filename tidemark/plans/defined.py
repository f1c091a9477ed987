"""Definitions stored as JSON, checked and compiled."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.operators import definitions as DEF
from tidemark.plans import patterns as T
from tidemark.plans import views as V
from tidemark.plans.registry import query
from tidemark.session import checkpoint_dir

SAVED = {
    "My displacement": {"concept": "displacement", "params": {"atr_mult": 1.5, "direction": "bullish"}},
    "Fall on volume": {"conditions": [{"id": "fall", "type": "price_move", "params": {"direction": "falls", "threshold": 2, "window": 5}}, {"id": "busy", "type": "relative_volume", "params": {"multiple": 1.0}}, {"id": "low", "type": "new_extreme", "params": {"kind": "low", "lookback": 20}}],
                       "logic": {"op": "OR", "items": [{"op": "AND", "items": ["fall", "busy"]}, "low"]}},
}


@query("defined_signals", V.sql("tr", "dn") + f""", {T._DISP}, cd AS (SELECT *, close / lag(close, 5) OVER w - 1 <= -0.02 AS fall, volume > avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AND i >= 20 AS busy,
  close < min(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AND i >= 20 AS lowest FROM dn WINDOW w AS (PARTITION BY symbol ORDER BY date))
SELECT 'My displacement' AS name, symbol, CAST(epoch(ts) AS BIGINT) + 3600 AS at, 'bullish' AS direction FROM dp WHERE close > open
UNION ALL SELECT 'Fall on volume', symbol, CAST(epoch(date) AS BIGINT), NULL FROM cd WHERE (coalesce(fall, false) AND coalesce(busy, false)) OR coalesce(lowest, false)""")
def defined_signals(spark, sf):
    """Two saved definitions, one of candles and one of daily bars, read back and compiled."""
    saved = DEF.Definitions(spark, f"{checkpoint_dir(spark).rstrip('/')}/definitions_{uuid.uuid4().hex}")
    for name, body in SAVED.items():
        saved.save(name, body)
    out = saved.compiled(list(SAVED), T.market(spark, sf), V.daily(spark, sf))
    return out.select("name", "symbol", F.unix_seconds("at").alias("at"), "direction")


def worded_definitions(spark, sf):
    """A definition per part, its parameters from the part's numbers: most compile, some are out of bounds."""
    size, n = F.col("p_size"), F.col("p_partkey") % 4
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    body = (
        F.when(n == 0, text('{"concept": "price_move", "params": {"threshold": ', size * 3, ', "window": ', size, "}}"))
        .when(n == 1, text('{"concept": "rsi", "params": {"period": ', size, ', "op": "', F.when(size % 7 == 0, F.lit("beyond")).otherwise(F.lit("above")), '"}}'))
        .when(n == 2, text('{"conditions": [{"type": "gap", "params": {"threshold": ', size, '}}, {"type": "new_extreme", "params": {"lookback": ', size * 20, ', "kind": "low"}}]}'))
        .otherwise(text('{"concept": "', F.when(size % 10 == 0, F.lit("unheard of")).otherwise(F.lit("displacement")), '", "params": {"require_fvg": ', F.when(size % 2 == 0, F.lit("true")).otherwise(F.lit("false")), ', "consecutive": ', size / 4, "}}"))
    )
    return V.table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("name"), body.alias("body"))


@query("definition_check", """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS name, p_partkey % 4 AS n, p_size AS s FROM part),
x AS (SELECT name, 0 AS part, 'price_move' AS type, CASE WHEN s * 3 > 95 THEN 'price_move: threshold must be between 0.5 and 95' END AS problem, 3 AS n_params, CAST(s AS VARCHAR) AS value FROM p WHERE n = 0
UNION ALL SELECT name, 0, 'rsi', CASE WHEN s % 7 = 0 THEN 'rsi: op must be one of below, above' WHEN s < 2 THEN 'rsi: period must be between 2 and 50' END, 3, CAST(s AS VARCHAR) FROM p WHERE n = 1
UNION ALL SELECT name, 0, 'gap', NULL, 2, NULL FROM p WHERE n = 2
UNION ALL SELECT name, 1, 'new_extreme', CASE WHEN s * 20 > 756 THEN 'new_extreme: lookback must be between 5 and 756' END, 2, CAST(s * 20 AS VARCHAR) FROM p WHERE n = 2
UNION ALL SELECT name, 0, CASE WHEN s % 10 = 0 THEN 'unheard of' ELSE 'displacement' END, CASE WHEN s % 10 = 0 THEN 'unknown concept: unheard of' WHEN s / 4.0 < 1 OR s / 4.0 > 10 THEN 'displacement: consecutive must be between 1 and 10' END, 10, CAST(CAST(round_even(s / 4.0, 0) AS BIGINT) AS VARCHAR) FROM p WHERE n = 3)
SELECT name, part, type, problem, CASE WHEN problem IS NULL THEN n_params END AS n_params, CASE WHEN problem IS NULL THEN value END AS value FROM x""")
def definition_check(spark, sf):
    """Every worded definition checked in one join: its clean parameters or what is wrong."""
    x = DEF.check_table(worded_definitions(spark, sf))
    value = F.coalesce(*[F.try_element_at("params", F.lit(p)) for p in ("window", "period", "lookback", "consecutive")])
    return x.select("name", "part", "type", "problem", F.when(F.col("params").isNotNull(), F.size("params")).alias("n_params"), value.alias("value"))
