import datetime as dt

from pyspark.sql import functions as F

from tidemark.operators import setups as P

T0 = dt.datetime(2024, 1, 10, 15, 0)  # 10:00 in New York
AT = lambda m: T0 + dt.timedelta(minutes=m)


def run(spark, steps, rows=((0, "bullish", 10.0),)):
    x = spark.createDataFrame([("S", i, AT(m), d, c) for i, (m, d, c) in enumerate(rows)], "symbol string, bar_no long, t timestamp, direction string, close double")
    return {r.bar_no: r for r in P.match_chain(x, steps).collect()}


def spans(spark, *rows):
    return spark.createDataFrame([("S", AT(a), None if b is None else AT(b), d) for a, b, d in rows], "symbol string, start timestamp, end timestamp, direction string")


def test_a_state_must_have_begun_and_still_hold(spark):
    s = P.State("gap", spans(spark, (-50, -10, "bullish"), (-200, 30, "bullish"), (-5, 20, "bearish"), (10, 40, "bullish")))
    r = run(spark, [s])[0]
    assert r.ok_gap and r.at_gap == AT(-200) and r.fails is None
    assert run(spark, [P.State("gap", spans(spark, (-50, 0, "bullish")))])[0].fails == "gap"  # the end is exclusive
    assert run(spark, [P.State("gap", spans(spark, (-50, -10, "bullish")), minutes=30)])[0].ok_gap
    assert run(spark, [P.State("gap", spans(spark, (-50, None, None)))])[0].ok_gap


def test_a_state_moves_the_bound_of_earlier_conditions(spark):
    events = spark.createDataFrame([("S", AT(-20), "bullish"), ("S", AT(-90), "bullish")], "symbol string, t timestamp, direction string")
    r = run(spark, [P.State("gap", spans(spark, (-60, 30, "bullish"))), P.Step("sweep", events)])[0]
    assert r.at_sweep == AT(-90)


def test_checks_name_the_condition_that_failed(spark):
    levels = spark.createDataFrame([("S", "pdl", 9.0, AT(-600), AT(600)), ("S", "pdl", 11.0, AT(-60), AT(600)), ("S", "pdh", 1.0, AT(-600), AT(600))], "symbol string, kind string, price double, available_from timestamp, valid_until timestamp")
    above, below = P.LevelCheck("above", levels, "pdl"), P.LevelCheck("below", levels, "pdl", above=False)
    hours = P.ClockCheck("hours", 570, 960)
    rows = ((0, "bullish", 11.5), (1, "bullish", 10.0), (480, "bullish", 11.5))
    got = run(spark, [hours, above], rows)
    assert [got[i].fails for i in range(3)] == [None, "above", "hours"]
    assert run(spark, [below], rows)[1].ok_below and not run(spark, [below], rows)[0].ok_below
    assert run(spark, [P.LevelCheck("none", levels, "onh")])[0].fails == "none"


def test_relaxing_counts_states_and_checks(spark):
    x = spark.createDataFrame([("S", 0, AT(0), "bullish", 10.0)], "symbol string, bar_no long, t timestamp, direction string, close double")
    out = P.relaxed(x, [P.State("gap", spans(spark, (-50, -10, "bullish"))), P.ClockCheck("hours", 570, 960)])
    left = {r.dropped: r.remaining for r in out.collect()}
    assert left == {"": 0, "gap": 1, "hours": 0, "gap,hours": 1}
    assert out.where(F.col("triggers") != 1).count() == 0
