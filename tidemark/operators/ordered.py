"""Ordered computations that do not put one key's whole history into one task.

A window partitioned by symbol alone sorts a symbol's entire history in a single task, so a
symbol holding a third of all rows decides the run time.  Everything here works in two levels
instead: rows are grouped by (key, chunk), where ``chunk`` is a column that never decreases
along the order (a trading day, a month, ``id // 1_000_000``); each chunk is reduced to one
summary row; the summaries, which are few, carry the state across chunks.

Daily bars are the exception: after de-duplication there is one row per (symbol, date), so the
calendar bounds a symbol at about 250 rows a year and plain windows by symbol are safe.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536


def by_symbol(*order: str) -> WindowSpec:
    """Window over one symbol's daily bars (bounded by the calendar)."""
    return Window.partitionBy("symbol").orderBy(*(order or ("date",)))


def row_index(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], name: str = "bar_no") -> DataFrame:
    """0-based position of every row within its key, from chunk sizes plus position in the chunk."""
    keys = list(keys)
    sizes = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, chunk, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    return (
        df.join(sizes, [*keys, chunk])
        .withColumn(name, F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_before")
    )


_COMBINE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_PLAIN = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def running(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], aggs: dict[str, tuple[str, Column | str]]
) -> DataFrame:
    """Running sum / count / max / min per key: ``{"name": ("sum", column)}``, current row included."""
    keys = list(keys)
    columns = {n: (F.col(c) if isinstance(c, str) else c) for n, (_, c) in aggs.items()}
    part = df.groupBy(*keys, chunk).agg(*[_PLAIN[kind](columns[n]).alias(f"_{n}") for n, (kind, _) in aggs.items()])
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(
        *keys, chunk, *[_COMBINE[kind](f"_{n}").over(before).alias(f"_b_{n}") for n, (kind, _) in aggs.items()]
    )
    inside = Window.partitionBy(*keys, chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.join(part, [*keys, chunk])
    for n, (kind, _) in aggs.items():
        here, prior = _PLAIN[kind](columns[n]).over(inside), F.col(f"_b_{n}")
        if kind in ("sum", "count"):
            value = F.when(prior.isNull(), here).when(here.isNull(), prior).otherwise(prior + here)
        else:
            value = (F.greatest if kind == "max" else F.least)(here, prior)
        out = out.withColumn(n, value)
    return out.drop(*[f"_b_{n}" for n in aggs])


def carry_last(
    df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str], columns: dict[str, Column | str],
    include_current: bool = True,
) -> DataFrame:
    """Latest non-null value so far per key, carried across chunks (the core of an as-of join)."""
    keys = list(keys)
    exprs = {n: (F.col(c) if isinstance(c, str) else c) for n, c in columns.items()}
    work = df
    for n, e in exprs.items():
        work = work.withColumn(f"_v_{n}", e)
    position = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    part = work.groupBy(*keys, chunk).agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), position)).alias(f"_e_{n}")
            for n in exprs
        ]
    )
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*keys, chunk, *[F.last(f"_e_{n}", True).over(before).alias(f"_b_{n}") for n in exprs])
    inside = Window.partitionBy(*keys, chunk).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, 0 if include_current else -1)
    out = work.join(part, [*keys, chunk])
    for n in exprs:
        out = out.withColumn(n, F.coalesce(F.last(f"_v_{n}", True).over(inside), F.col(f"_b_{n}")))
    return out.drop(*[f"_b_{n}" for n in exprs], *[f"_v_{n}" for n in exprs])


def halo(
    df: DataFrame, keys: Sequence[str], back: int, fwd: int, index: str = "bar_no", block: int = BLOCK_ROWS
) -> tuple[DataFrame, WindowSpec]:
    """Copy the ``back`` rows before and ``fwd`` rows after every block into it.

    Returns the widened frame and a window over (key, block).  Frames of up to ``back`` preceding
    and ``fwd`` following rows are exact on the rows where ``_own`` is true.
    """
    block = max(block, back, fwd, 1)
    home = F.floor(F.col(index) / F.lit(block)).cast("long")
    within = F.col(index) % F.lit(block)
    targets = [F.struct(home.alias("b"), F.lit(True).alias("own"))]
    if back:
        targets.append(F.when(within >= block - back, F.struct((home + 1).alias("b"), F.lit(False).alias("own"))))
    if fwd:
        targets.append(F.when(within < fwd, F.struct((home - 1).alias("b"), F.lit(False).alias("own"))))
    wide = (
        df.withColumn("_t", F.explode(F.filter(F.array(*targets), lambda x: x.isNotNull())))
        .withColumn("_block", F.col("_t.b"))
        .withColumn("_own", F.col("_t.own"))
        .drop("_t")
    )
    return wide, Window.partitionBy(*keys, "_block").orderBy(index)


def rolling(
    df: DataFrame, keys: Sequence[str], back: int, fwd: int, build: Callable[[DataFrame, WindowSpec], DataFrame],
    index: str = "bar_no", block: int = BLOCK_ROWS,
) -> DataFrame:
    """Apply ``build(frame, window)`` block by block with exact bounded frames."""
    wide, window = halo(df, keys, back, fwd, index, block)
    return build(wide, window).filter("_own").drop("_own", "_block")


def asof_backward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
    values: Sequence[str], chunk_of: Callable[[Column], Column],
) -> DataFrame:
    """For every left row the newest right row with ``right_time <= left_time`` (ties: right wins)."""
    keys = list(keys)
    lcols = [c for c in left.columns if c not in keys]
    packed = F.struct(F.col(right_time).alias(right_time), *[F.col(v).alias(v) for v in values if v != right_time])
    r = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), packed.alias("_r"))
    l = left.select(*keys, F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.struct(*lcols).alias("_l"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_chunk", chunk_of(F.col("_t")))
    both = carry_last(both, keys, "_chunk", ["_t", "_side"], {"_hit": "_r"})
    picked = both.filter("_side = 1")
    out_values = [v for v in values]
    return picked.select(*keys, "_l.*", *[F.col(f"_hit.{v}").alias(v) for v in out_values])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], accuracy: int = 20_000
) -> DataFrame:
    """Exact linearly interpolated quantiles of groups of any size, with their count ``n``.

    A sketch brackets each wanted rank; only the rows inside the bracket, pre-counted per
    distinct value, are ordered.  Rows below the bracket are only counted.
    """
    keys = list(keys)
    base = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    names = list(probs)
    margin = 4.0 / accuracy
    points = [p for n in names for p in (max(probs[n] - margin, 0.0), min(probs[n] + margin, 1.0))]
    sketch = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", points, accuracy).alias("_p"),
    )
    small = 2 * accuracy // 8
    bands = sketch.select(
        *keys, "n",
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("q"),
                        F.lit(float(probs[n])).alias("p"),
                        F.when(F.col("n") <= small, F.col("_min")).otherwise(
                            F.element_at("_p", 2 * i + 1) if probs[n] - margin > 0 else F.col("_min")
                        ).alias("lo"),
                        F.when(F.col("n") <= small, F.col("_max")).otherwise(
                            F.element_at("_p", 2 * i + 2) if probs[n] + margin < 1 else F.col("_max")
                        ).alias("hi"),
                    )
                    for i, n in enumerate(names)
                ]
            )
        ).alias("b"),
    ).select(*keys, "n", "b.*")
    counted = (
        base.join(bands, keys).filter("_v <= hi")
        .groupBy(*keys, "q", "p", "n", F.when(F.col("_v") >= F.col("lo"), F.col("_v")).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    order = Window.partitionBy(*keys, "q").orderBy(F.col("_v").asc_nulls_first())
    ranked = counted.withColumn("_to", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    pos = F.col("p") * (F.col("n") - 1)
    hit = lambda k: (F.col("_to") > k) & (F.col("_to") - F.col("_c") <= k) & F.col("_v").isNotNull()
    picked = ranked.groupBy(*keys, "q").agg(
        F.max(F.when(hit(F.floor(pos)), F.col("_v"))).alias("a"),
        F.max(F.when(hit(F.ceil(pos)), F.col("_v"))).alias("b"),
        F.first(pos - F.floor(pos)).alias("w"),
        F.first("n").alias("n"),
    )
    return picked.groupBy(*keys).agg(
        F.first("n").alias("n"),
        *[F.max(F.when(F.col("q") == n, F.col("a") + (F.col("b") - F.col("a")) * F.col("w"))).alias(n) for n in names],
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Column, keep: Sequence[str]) -> DataFrame:
    """First row per key by ``order`` as a partial aggregation, so a hot key is combined map-side."""
    packed = F.struct(*keep)
    return df.groupBy(*keys).agg(F.min_by(packed, order).alias("_f")).select(*keys, "_f.*")


def last_rows(df: DataFrame, keys: Sequence[str], order: Column, keep: Sequence[str]) -> DataFrame:
    packed = F.struct(*keep)
    return df.groupBy(*keys).agg(F.max_by(packed, order).alias("_f")).select(*keys, "_f.*")


def islands(
    df: DataFrame, keys: Sequence[str], chunk: str, position: str, max_gap: int, name: str = "run_no"
) -> DataFrame:
    """Number the runs of rows whose positions are at most ``max_gap`` apart."""
    x = carry_last(df, keys, chunk, [position], {"_prev": position}, include_current=False)
    x = x.withColumn("_new", F.when(F.col(position) - F.col("_prev") <= max_gap, 0).otherwise(1))
    return running(x, keys, chunk, [position], {name: ("sum", "_new")}).drop("_new", "_prev")
