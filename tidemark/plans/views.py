"""Price-like views over the given tables, once as DataFrames and once as SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import calendar as cal
from tidemark.operators import bars as B
from tidemark.operators import ordered as O
from tidemark.session import cut_lineage


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # instants in the tables are UTC
    return spark.read.parquet(f"{sf}/{name}.parquet")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    raw = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.avg("o_totalprice").alias("x"), F.count(F.lit(1)).cast("double").alias("volume"))
    )
    s, w = Window.partitionBy("symbol"), O.by_symbol()
    z = raw.withColumn("z", (F.col("x") - F.avg("x").over(s)) / F.stddev_samp("x").over(s))
    run = F.sum("z").over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = z.withColumn("close", F.round(100 * F.exp(0.015 * run), 2))
    o = c.withColumn("open", F.round(F.coalesce(F.lag("close").over(w) * (1 + 0.002 * F.col("z")), F.col("close")), 2))
    return o.select(
        "symbol", "date", "open", F.greatest("open", "close").alias("high"), F.least("open", "close").alias("low"),
        "close", "volume",
    )


def spread(df: DataFrame) -> DataFrame:
    """Deal out a small one-file table for row-local text work, where the session asks for it (tests and bench); else the scan's splits stay."""
    parts = df.sparkSession.conf.get("spark.tidemark.spread", None)
    return df.repartition(int(parts)) if parts else df


TICK_CHUNK = 1_000_000


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """A price walk per symbol; running sum in two levels because ticks are not bounded by a calendar."""
    ev = table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value"
    )
    stats = ev.groupBy("symbol").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    z = ev.join(stats, "symbol").withColumn("z", (F.col("value") - F.col("m")) / F.col("s"))
    z = z.withColumn("_chunk", F.floor(F.col("event_id") / TICK_CHUNK))
    run = O.running(z, ["symbol"], "_chunk", ["event_id"], {"w": ("sum", "z")})
    return run.select("symbol", "ts", "event_id", F.round(100 * F.exp(0.002 * F.col("w")), 2).alias("price"))


_STORED: dict[tuple, DataFrame] = {}


def input_state(spark: SparkSession, sf: str) -> tuple:
    """Names, sizes and times of the files under a table folder: a changed input is another input."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sf)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def bars1h(spark: SparkSession, sf: str) -> DataFrame:
    """The candle table, written once per session to the shared checkpoint folder.

    Candles are a stored archive that many detectors read; rebuilding them from ticks inside every
    branch of every plan would repeat the widest shuffle each time.
    """
    return stored("bars1h", spark, sf, build_bars1h)


def stored(name: str, spark: SparkSession, sf: str, build: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """A table derived once per session and state of the input, kept in the shared checkpoint folder for its many readers."""
    key = (spark.sparkContext.applicationId, name, input_state(spark, sf))
    if key not in _STORED:
        _STORED[key] = cut_lineage(build(spark, sf))
    return _STORED[key]


def build_bars1h(spark: SparkSession, sf: str) -> DataFrame:
    """One-hour base candles with trading day, contract, regime, position and the quality flags."""
    raw = B.bars_from_ticks(ticks(spark, sf), 3600)
    raw = raw.withColumn("day", cal.trading_day(F.col("ts"))).withColumn(
        "contract", F.concat(F.lit("C"), F.floor((F.dayofyear("day") - 1) / 10).cast("string"))
    )
    raw = raw.withColumn("suspect", F.col("high") > F.col("low") * 1.02)
    return B.prepare(raw, 3600)


def sql(*names: str) -> str:
    """WITH clause holding the named views and everything they need."""
    needed: list[str] = []

    def add(n: str) -> None:
        for d in _DEPS.get(n, ()):
            add(d)
        if n not in needed:
            needed.append(n)

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({_SQL[n]})" for n in needed)


_DEPS = {
    "daily_z": ("daily_raw",), "daily_c": ("daily_z",), "daily": ("daily_c",), "dn": ("daily",),
    "ticks_z": (), "ticks": ("ticks_z",), "bars_raw": ("ticks",), "bars_day": ("bars_raw",),
    "bars_flag": ("bars_day",), "bars_reg": ("bars_flag",), "bars1h": ("bars_reg",), "tr": ("bars1h",),
}
_SQL = {
    "daily_raw": """SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS x,
  CAST(count(*) AS DOUBLE) AS volume FROM orders GROUP BY 1, 2""",
    "daily_z": """SELECT symbol, date, volume,
  (x - avg(x) OVER (PARTITION BY symbol)) / stddev_samp(x) OVER (PARTITION BY symbol) AS z FROM daily_raw""",
    "daily_c": """SELECT *, round(100 * exp(0.015 * sum(z) OVER (PARTITION BY symbol ORDER BY date)), 2) AS close FROM daily_z""",
    "daily": """SELECT symbol, date, open, greatest(open, close) AS high, least(open, close) AS low, close, volume FROM (
  SELECT symbol, date, close, volume,
    round(coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY date) * (1 + 0.002 * z), close), 2) AS open FROM daily_c)""",
    "dn": """SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i,
  count(*) OVER (PARTITION BY symbol) AS n FROM daily""",
    "ticks_z": """SELECT event_type AS symbol, ts, event_id,
  (value - avg(value) OVER (PARTITION BY event_type)) / stddev_samp(value) OVER (PARTITION BY event_type) AS z FROM events""",
    "ticks": """SELECT symbol, ts, event_id,
  round(100 * exp(0.002 * sum(z) OVER (PARTITION BY symbol ORDER BY event_id)), 2) AS price FROM ticks_z""",
    "bars_raw": """SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(price, (ts, event_id)) AS open,
  max(price) AS high, min(price) AS low, arg_max(price, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM ticks GROUP BY 1, 2""",
    "bars_day": """SELECT *, CAST(et AS DATE) + CASE
    WHEN hour(et) >= 18 THEN CASE dayofweek(et) WHEN 5 THEN 3 WHEN 6 THEN 2 ELSE 1 END
    ELSE CASE dayofweek(et) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END END AS day FROM (
  SELECT *, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS et FROM bars_raw)""",
    "bars_flag": """SELECT symbol, ts, day, 'C' || CAST((dayofyear(day) - 1) // 10 AS VARCHAR) AS contract, open, high, low, close, volume,
  high > low * 1.02 AS suspect FROM bars_day""",
    "bars_reg": """SELECT *, row_number() OVER w - 1 AS bar_no,
  sum(CASE WHEN contract <> prev_contract THEN 1 ELSE 0 END) OVER w AS regime,
  coalesce(epoch(ts) - epoch(prev_ts) <> 3600 AND prev_day = day, false) AS after_gap
  FROM (SELECT *, lag(contract) OVER u AS prev_contract, lag(ts) OVER u AS prev_ts, lag(day) OVER u AS prev_day
        FROM bars_flag WINDOW u AS (PARTITION BY symbol ORDER BY ts)) WINDOW w AS (PARTITION BY symbol ORDER BY ts)""",
    "bars1h": """SELECT symbol, ts, day, contract, open, high, low, close, volume, suspect, bar_no, regime, after_gap,
  sum(CASE WHEN coalesce(suspect OR after_gap OR p_suspect OR regime <> p_regime OR epoch(ts) - epoch(p_ts) <> 3600, true)
      THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, day ORDER BY ts) AS run FROM (
  SELECT *, lag(suspect) OVER d AS p_suspect, lag(regime) OVER d AS p_regime, lag(ts) OVER d AS p_ts
  FROM bars_reg WINDOW d AS (PARTITION BY symbol, day ORDER BY ts))""",
}


def dirty(spark: SparkSession, sf: str) -> DataFrame:
    """``daily`` with an unapplied split, bad prints, invalid closes, a stale run, holes and volume spikes."""
    from tidemark.operators.indicators import numbered

    i = F.col("i")
    c = (
        F.when(i % 500 == 250, 0.0).when((i % 300).between(100, 106), 100.0).when(i % 400 == 200, F.col("close") * 3).otherwise(F.col("close"))
        * F.when(F.col("date") < F.lit("1998-06-01").cast("date"), 4.0).otherwise(1.0)
    )
    v = F.when((i % 300).between(100, 106), 0.0).when(i % 350 == 175, F.col("volume") * 50).otherwise(F.col("volume"))
    x = numbered(daily(spark, sf)).withColumn("close", c).withColumn("volume", v).filter(~(i % 700).between(300, 320))
    return x.drop("i", "n")


def splits(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf).select("symbol").distinct()
    return d.select("symbol", F.lit("1998-06-02").cast("date").alias("date"), F.lit(4.0).alias("ratio"))


_DEPS["dirty"] = ("dn",)
_SQL["dirty"] = """SELECT symbol, date, open, high, low, CASE WHEN i % 500 = 250 THEN 0.0 WHEN i % 300 BETWEEN 100 AND 106 THEN 100.0
  WHEN i % 400 = 200 THEN close * 3 ELSE close END * CASE WHEN date < DATE '1998-06-01' THEN 4.0 ELSE 1.0 END AS close,
  CASE WHEN i % 300 BETWEEN 100 AND 106 THEN 0.0 WHEN i % 350 = 175 THEN volume * 50 ELSE volume END AS volume
  FROM dn WHERE NOT (i % 700 BETWEEN 300 AND 320)"""
_DEPS["splits"] = ("daily",)
_SQL["splits"] = "SELECT DISTINCT symbol, DATE '1998-06-02' AS date, 4.0::DOUBLE AS ratio FROM daily"


def feed(spark: SparkSession, sf: str) -> DataFrame:
    """Raw candle rows with late second copies (from every seventh tick) in arrival order."""
    t = ticks(spark, sf)

    def rows(x, copy, late):
        last = x.groupBy("symbol", F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 3600) * 3600).alias("ts")).agg(F.max("event_id").alias("arrival"))
        return B.bars_from_ticks(x, 3600).join(last, ["symbol", "ts"]).withColumn("arrival", F.col("arrival") + late).withColumn("copy", F.lit(copy))

    return rows(t, 0, 0).unionByName(rows(t.filter("event_id % 7 = 0"), 1, 40))


def other_feed(spark: SparkSession, sf: str) -> DataFrame:
    """A second candle feed that missed every twentieth tick."""
    return B.bars_from_ticks(ticks(spark, sf).filter("event_id % 20 <> 0"), 3600).withColumn("day", cal.trading_day(F.col("ts")))


def contract_volumes(spark: SparkSession, sf: str) -> DataFrame:
    """Traded count per (root, day, contract rank); later contracts gain volume as days pass."""
    e = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    rank = F.floor((F.dayofyear("day") + F.col("user_id") % 15) / 12).cast("long")
    return e.groupBy(F.col("event_type").alias("root"), "day", rank.alias("rank")).agg(F.count(F.lit(1)).alias("volume"))


def contract_feeds(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(continuous, contracts, sample): candles of each contract with some hours missing, of the front one under no label (an expired one in the first days), and of an independent vendor."""
    t = ticks(spark, sf).withColumn("rank", F.floor((F.dayofyear("ts") + F.col("event_id") % 15) / 12).cast("long"))
    by_rank = B.bars_from_ticks(t.withColumns({"symbol": F.concat_ws("|", "symbol", "rank"), "price": F.col("price") + 3 * F.col("rank")}), 3600)
    every = by_rank.withColumns({"root": F.substring_index("symbol", "|", 1), "rank": F.substring_index("symbol", "|", -1).cast("long"), "day": cal.trading_day(F.col("ts")), "h": (F.unix_seconds("ts") / 3600).cast("long"), "d": F.dayofyear("ts")})
    every = every.withColumn("contract", F.concat(F.lit("K"), F.col("rank").cast("string")))
    old = B.bars_from_ticks(ticks(spark, sf).filter(F.dayofyear("ts") <= 5).withColumn("price", F.col("price") - 5), 3600)
    columns = ["root", "ts", "day", "open", "high", "low", "close", "volume"]
    front = every.filter(F.col("rank") == F.floor((F.col("d") + 7) / 12))
    continuous = front.filter("d > 5").withColumn("close", F.col("close") + F.when(F.col("h") % 37 == 0, 2.0).otherwise(0.0)).select(*columns)
    continuous = continuous.unionByName(old.select(F.col("symbol").alias("root"), "ts", cal.trading_day(F.col("ts")).alias("day"), "open", "high", "low", "close", "volume"))
    off = F.when(F.col("h") % 41 == 0, 3.0).otherwise(0.0)
    sample = front.filter("d between 8 and 25").withColumns({"close": F.col("close") + off, "high": F.col("high") + off}).select(*columns)
    return continuous, every.filter("h % 29 <> 0").select(*columns, "contract", "rank"), sample


def _bars_sql(where: str) -> str:
    return f"""SELECT symbol, time_bucket(INTERVAL '1 hour', ts) AS ts, arg_min(price, (ts, event_id)) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume, max(event_id) AS arrival FROM ticks {where} GROUP BY 1, 2"""


_ET = "(({0}) AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York'"
_UTC = "(({0}) AT TIME ZONE 'America/New_York') AT TIME ZONE 'UTC'"


def clock(day: str, hhmm: str) -> str:
    """UTC instant of a New York clock time on a date expression."""
    return _UTC.format(f"({day}) + TIME '{hhmm}'")


def roll_weekend(d: str) -> str:
    return f"({d} + CASE dayofweek({d}) WHEN 6 THEN 2 WHEN 0 THEN 1 ELSE 0 END)"


_ET_DAY = roll_weekend("(CAST(et AS DATE) + CASE WHEN hour(et) >= 18 THEN 1 ELSE 0 END)")
_DEPS["k_every"] = ("ticks",)
_SQL["k_every"] = f"""SELECT *, {_ET_DAY} AS day, CAST(epoch(ts) AS BIGINT) // 3600 AS h, dayofyear(ts) AS d FROM (SELECT *, {_ET.format('ts')} AS et FROM (SELECT symbol AS root, rank, 'K' || rank AS contract, time_bucket(INTERVAL '1 hour', ts) AS ts,
  arg_min(p, (ts, event_id)) AS open, max(p) AS high, min(p) AS low, arg_max(p, (ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume FROM (SELECT *, price + 3 * rank AS p FROM (SELECT *, CAST(floor((dayofyear(ts) + event_id % 15) / 12) AS BIGINT) AS rank FROM ticks)) GROUP BY 1, 2, 3, 4))"""
_DEPS["k_contracts"] = ("k_every",)
_SQL["k_contracts"] = "SELECT root, ts, day, open, high, low, close, volume, contract, rank FROM k_every WHERE h % 29 <> 0"
_DEPS["k_cont"] = ("k_every",)
_SQL["k_cont"] = f"""SELECT root, ts, day, open, high, low, close + CASE WHEN h % 37 = 0 THEN 2.0 ELSE 0.0 END AS close, volume FROM k_every WHERE rank = floor((d + 7) / 12) AND d > 5
  UNION ALL SELECT symbol, ts, {_ET_DAY}, open - 5, high - 5, low - 5, close - 5, volume FROM (SELECT *, {_ET.format('ts')} AS et FROM ({_bars_sql('WHERE dayofyear(ts) <= 5')}))"""
_DEPS["k_sample"] = ("k_every",)
_SQL["k_sample"] = "SELECT root, ts, day, open, high + CASE WHEN h % 41 = 0 THEN 3.0 ELSE 0.0 END AS high, low, close + CASE WHEN h % 41 = 0 THEN 3.0 ELSE 0.0 END AS close, volume FROM k_every WHERE rank = floor((d + 7) / 12) AND d BETWEEN 8 AND 25"
_DEPS["feed"] = ("ticks",)
_SQL["feed"] = f"SELECT *, 0 AS copy FROM ({_bars_sql('')}) UNION ALL SELECT symbol, ts, open, high, low, close, volume, arrival + 40, 1 FROM ({_bars_sql('WHERE event_id % 7 = 0')})"
_DEPS["other_raw"] = ("ticks",)
_SQL["other_raw"] = f"SELECT *, {_ET.format('ts')} AS et FROM ({_bars_sql('WHERE event_id % 20 <> 0')})"
_DEPS["other_feed"] = ("other_raw",)
_SQL["other_feed"] = f"""SELECT symbol, ts, open, high, low, close, volume, {roll_weekend("(CAST(et AS DATE) + CASE WHEN hour(et) >= 18 THEN 1 ELSE 0 END)")} AS day FROM other_raw"""
_DEPS["hours"] = ("bars1h",)
_SQL["hours"] = f"""SELECT t, et, CASE dayofweek(et) WHEN 6 THEN false WHEN 0 THEN hour(et) >= 18 WHEN 5 THEN hour(et) < 17 ELSE hour(et) <> 17 END AS open
  FROM (SELECT t, {_ET.format('t')} AS et FROM (SELECT unnest(generate_series((SELECT min(ts) FROM bars1h) - INTERVAL 5 DAY, (SELECT max(ts) FROM bars1h) + INTERVAL 5 DAY, INTERVAL 1 HOUR)) AS t))"""
_DEPS["dayb"] = ("bars1h",)
_SQL["dayb"] = f"SELECT DISTINCT symbol, day, {clock('day - 1', '18:00')} AS d0, {clock('day', '17:00')} AS d1, {clock('day', '09:30')} AS m0, {clock('day', '16:00')} AS m1 FROM bars1h"
_DEPS["dlev0"] = ("bars1h", "dayb", "hours")
_SQL["dlev0"] = """SELECT b.symbol, b.day, d0, d1, max(high) FILTER (NOT suspect) AS high, min(low) FILTER (NOT suspect) AS low, count(*) FILTER (NOT suspect) AS clean,
  min(ts) AS first_ts, min(regime) AS regime, max(regime) AS last_regime, max(regime) FILTER (ts <= d0) AS reg_open,
  (SELECT count(*) FROM hours WHERE open AND t >= d0 AND t < d1) AS expected FROM bars1h b JOIN dayb USING (symbol, day) GROUP BY 1, 2, 3, 4"""
_DEPS["dlev"] = ("dlev0",)
_SQL["dlev"] = """SELECT *, clean / expected AS coverage, high IS NOT NULL AND clean / expected >= 0.9 AND epoch(first_ts) - epoch(d0) <= 1800 AND regime = last_regime AS complete FROM dlev0"""
_DEPS["tr"] = ("bars1h",)
_SQL["tr"] = """SELECT *, CASE WHEN bar_no >= 13 THEN avg(t) OVER (PARTITION BY symbol ORDER BY ts ROWS 13 PRECEDING) END AS atr FROM (
  SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS t FROM (SELECT *, CASE WHEN lag(day) OVER w = day THEN lag(close) OVER w END AS pc FROM bars1h WINDOW w AS (PARTITION BY symbol ORDER BY ts)))"""


# --- texts ---------------------------------------------------------------------------------------------
# Prose in the given documents is invented and names no company, so rule-based extraction also runs on
# one filing sentence per order, worded from that order's own values.

_WORDED = {
    0: "'Customer ' || {letter} || ' accounted for ' || {p} || '% of our total net revenue in fiscal year ' || {y} || ', mainly through its cloud business.'",
    1: "'We rely on Taiwan Semiconductor Manufacturing as our sole-source foundry for wafers, and supply from Taiwan may be disrupted.'",
    2: "'Sales to customers in China represented ' || {p} || '% of our revenue in fiscal ' || {y} || ' and export controls could reduce demand.'",
    3: "'Apple and Samsung are among our competitors, and competition in Japan could lower our sales.'",
    4: "'No customer represented less than 10% of our net sales, although tariffs and interest rates may affect demand from customers.'",
    5: "'Microsoft and Amazon purchased from us for their data centers; a recession could slow cloud spending by these customers in Europe.'",
    6: "'A class action lawsuit was filed in the district court and the complaint was dismissed on March ' || {d} || ', ' || {y} || '.'",
    7: "'For fiscal ' || {y} || ' we expect revenue of $' || {p} || '.5 billion to $' || {p2} || ' billion from the products and services we sell.'",
    8: "'The Department of Justice opened an investigation and issued a subpoena; the Federal Trade Commission fined the company.'",
    9: "'For fiscal ' || {y} || ' gross margin is expected to be ' || {p} || '%, plus or minus 50 basis points, founded in ' || {y} || '.'",
}


def filing_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id = customer, pos = order, sent, day): one worded sentence per order."""
    parts = {"letter": "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(o_custkey % 26 + 1 as int), 1)", "p": "cast(o_orderkey % 89 + 1 as string)", "p2": "cast(o_orderkey % 89 + 2 as string)",
             "y": "cast(year(o_orderdate) as string)", "d": "cast(day(o_orderdate) as string)"}
    case = "CASE o_orderkey % 10 " + " ".join(f"WHEN {k} THEN {v.format(**parts)}" for k, v in _WORDED.items()) + " END"
    return spread(table(spark, sf, "orders")).select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.expr(case).alias("sent"), F.to_date("o_orderdate").alias("day"))


_DEPS["fs"] = ()
_SQL["fs"] = "SELECT o_custkey AS doc_id, o_orderkey AS pos, CAST(o_orderdate AS DATE) AS day, CASE o_orderkey % 10 " + " ".join(
    f"WHEN {k} THEN " + v.format(letter="substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(o_custkey % 26 + 1 AS INTEGER), 1)", p="CAST(o_orderkey % 89 + 1 AS VARCHAR)", p2="CAST(o_orderkey % 89 + 2 AS VARCHAR)",
                                 y="CAST(year(o_orderdate) AS VARCHAR)", d="CAST(day(o_orderdate) AS VARCHAR)") for k, v in _WORDED.items()) + " END AS sent FROM orders"
