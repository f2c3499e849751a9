"""Time joins against brute force."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lakesieve import queries
from lakesieve.operators import joins

from .oracle import connect, same


def points_of(n, seed, users=4, span=300, hot=0.5):
    r = random.Random(seed)
    out = [(k, None if r.random() < 0.05 else 1 if r.random() < hot else r.randrange(users), None if r.random() < 0.05 else r.randrange(span)) for k in range(n)]
    return out + out[:3]


def spans_of(n, seed, users=4, span=300):
    r = random.Random(seed)
    out = []
    for k in range(n):
        start = r.randrange(span)
        length = r.choice([0, 1, 2, 5, 40, 5000, -3])
        out.append((k, r.choice([None, 0, 1, 1, 1, *range(users)]), None if r.random() < 0.05 else start, None if r.random() < 0.05 else start + length))
    return out + out[:2]


def brute_intervals(points, spans, closed):
    hit = lambda p, s: p[1] is not None and p[1] == s[1] and None not in (p[2], s[2], s[3]) and s[2] <= p[2] and (p[2] <= s[3] if closed else p[2] < s[3])
    pairs = [(p, s) for p, s in itertools.product(points, spans) if hit(p, s)]
    alone = [p for p in points if not any(hit(p, s) for s in spans)]
    return pairs, alone


def key(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("closed,width,hot", [(False, None, 100_000), (True, 3.0, 2), (False, 1000.0, 5)])
def test_interval_join(spark, monkeypatch, closed, width, hot):
    monkeypatch.setattr(joins, "HOT", hot)
    points, spans = points_of(150, 1), spans_of(90, 2)
    p = spark.createDataFrame(points, "p long, user int, t long").repartition(3)
    s = spark.createDataFrame(spans, "s long, user int, a long, b long").repartition(2)
    pairs, alone = brute_intervals(points, spans, closed)
    run = lambda how: [tuple(x) for x in joins.interval_join(p, s, ["user"], "t", "a", "b", how, closed, width).collect()]
    want = [(*x, y[0], y[2], y[3]) for x, y in pairs]
    assert len(want) > 100 and key(run("inner")) == key(want)
    assert key(run("left")) == key(want + [(*x, None, None, None) for x in alone]) and key(run("left_anti")) == key(alone)


@pytest.mark.parametrize("closed,width,hot", [(False, None, 100_000), (True, 2.0, 3)])
def test_overlap_join(spark, monkeypatch, closed, width, hot):
    monkeypatch.setattr(joins, "HOT", hot)
    left, right = spans_of(70, 3), spans_of(50, 4)
    a = spark.createDataFrame(left, "p long, user int, a long, b long")
    b = spark.createDataFrame(right, "s long, user int, c long, d long")

    def meet(x, y):
        if None in (x[1], x[2], x[3], y[2], y[3]) or x[1] != y[1]:
            return False
        if closed:
            return x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3]
        return max(x[2], y[2]) < min(x[3], y[3])

    want = [(*x, y[0], y[2], y[3]) for x, y in itertools.product(left, right) if meet(x, y)]
    got = [tuple(x) for x in joins.overlap_join(a, b, ["user"], ("a", "b"), ("c", "d"), closed, width).collect()]
    assert len(want) > 50 and key(got) == key(want)


def test_interval_join_of_timestamps_dates_and_doubles(spark):
    day = dt.datetime(2024, 3, 1)
    p = spark.createDataFrame([(1, day, day.date(), 0.5), (2, day + dt.timedelta(hours=5), day.date() + dt.timedelta(days=3), float("nan")), (3, dt.datetime(1960, 1, 1, 12), dt.date(1960, 1, 1), -2.5)], "k int, t timestamp, d date, x double")
    s = spark.createDataFrame([("a", day, day + dt.timedelta(hours=5), day.date(), day.date(), -3.0, 0.5), ("b", dt.datetime(1960, 1, 1), dt.datetime(1960, 1, 2), dt.date(1960, 1, 1), dt.date(1970, 1, 1), 0.5, float("inf"))], "n string, t0 timestamp, t1 timestamp, d0 date, d1 date, x0 double, x1 double")
    pairs = lambda time, ends, closed=False, width=None: sorted((r["k"], r["n"]) for r in joins.interval_join(p, s, [], time, *ends, closed=closed, width=width).collect())
    assert pairs("t", ("t0", "t1")) == [(1, "a"), (3, "b")] and pairs("t", ("t0", "t1"), True) == [(1, "a"), (2, "a"), (3, "b")]
    assert pairs("d", ("d0", "d1"), True) == [(1, "a"), (3, "b")]
    assert pairs("x", ("x0", "x1"), width=1.0) == [(1, "b"), (3, "a")]


def test_a_long_interval_covers_few_buckets(spark):
    spans = spark.createDataFrame([(1, 0, 10**12), (2, 5, 6)], "s long, a long, b long")
    known = joins._intervals(spans, "a", "b", [], False)
    covered = joins._covered(joins._levelled(known, 1.0), 1.0)
    assert max(r["count"] for r in covered.groupBy("s").count().collect()) <= joins.FACTOR + 1


def test_empty_sides_and_clashing_names(spark):
    p, s = spark.createDataFrame([(1, 1, 5)], "p long, user int, t long"), spark.createDataFrame([(1, 1, 2, 9)], "s long, user int, a long, b long")
    run = lambda x, y, how="inner": [tuple(r) for r in joins.interval_join(x, y, ["user"], "t", "a", "b", how).collect()]
    none_p, none_s = p.where("false"), s.where("false")
    assert run(p, s) == [(1, 1, 5, 1, 2, 9)] and run(none_p, s) == [] and run(p, none_s) == [] and run(p, none_s, "left") == [(1, 1, 5, None, None, None)] and run(p, none_s, "left_anti") == [(1, 1, 5)]
    assert joins.overlap_join(s, none_s.withColumnsRenamed({"s": "z", "a": "c", "b": "d"}), ["user"], ("a", "b"), ("c", "d")).collect() == []
    r = spark.createDataFrame([(7, 1, 4)], "q long, user int, u long")
    assert joins.asof_join(p, r.where("false"), ["user"], "t", "u").collect()[0]["q"] is None and joins.asof_join(p.where("false"), r, ["user"], "t", "u").collect() == []
    with pytest.raises(ValueError, match="both sides"):
        joins.interval_join(p, s.withColumnRenamed("s", "t"), ["user"], "t", "a", "b")
    with pytest.raises(ValueError, match="how"):
        joins.interval_join(p, s, ["user"], "t", "a", "b", "full")
    with pytest.raises(ValueError, match="direction"):
        joins.asof_join(p, r, ["user"], "t", "u", "nearest")


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("exact,tolerance,parts,batch", [(True, None, 4, 10_000), (False, None, 9, 7), (True, 6, 1, 3), (False, 0, 3, 1)])
def test_asof_join(spark, direction, exact, tolerance, parts, batch):
    left, r = points_of(120, 5, users=6), random.Random(6)
    right = [(1000 + k, r.choice([None, 1, 1, 2, 3, 9]), None if r.random() < 0.1 else r.randrange(300), r.randrange(50)) for k in range(70)]
    right = [(q, u, t, k * 10_000 + w) for k, (q, u, t, w) in enumerate(right)]  # ties go by w
    sign = 1 if direction == "backward" else -1
    want = []
    for p, u, t in left:
        fits = [x for x in right if None not in (u, t, x[2]) and x[1] == u and (sign * x[2] < sign * t or exact and x[2] == t)]
        best = max(fits, key=lambda x: (sign * x[2], x[3]), default=None)
        if best and tolerance is not None and abs(best[2] - t) > tolerance:
            best = None
        want.append((p, u, t, *((best[0], best[2], best[3]) if best else (None, None, None))))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        a, b = spark.createDataFrame(left, "p long, user int, t long").repartition(3), spark.createDataFrame(right, "q long, user int, u long, w long").repartition(2)
        got = [tuple(x) for x in joins.asof_join(a, b, ["user"], "t", "u", direction, exact, tolerance, ["w"]).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert key(got) == key(want)


def test_asof_join_of_one_hot_key_over_many_partitions(spark):
    """One right row long before all others: it has to pass several borders."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        left = spark.range(400).select(F.lit("k").alias("key"), F.lit("x").alias("other"), F.col("id").alias("p"), (F.col("id") + 10).alias("t"))
        right = spark.createDataFrame([("k", "x", 1, 0), ("j", "x", 2, 500), ("k", "y", 3, 300)], "key string, other string, q long, u long")
        out = joins.asof_join(left, right, ["key", "other"], "t", "u")
        assert {r["q"] for r in out.collect()} == {1} and out.count() == 400
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("name", ["events_in_orders", "overlapping_orders"])
def test_open_orders_are_open_for_rounded_minutes(spark, tmp_path, name):
    """Prices on both sides of a half and on it; events and orders begin in the minute that rounding adds."""
    prices = [1001.91, 1050.0, 1150.0, 1149.99, 1250.0, 1250.01, 1299.99, 75462.67]
    zero, orders, events = dt.datetime(2024, 1, 1), [], []
    for user, price in enumerate(prices):
        first = 100 * user
        orders.append((first, user, price))
        begin = first * 7919 % 2592000
        for minutes in (int(price // 100), int(price // 100) + 1):
            for shift in (-1, 1):
                events.append((len(events), zero + dt.timedelta(seconds=begin + 60 * minutes + shift), user))
        # a later order of the same user that begins within the last minute
        orders += [((begin + 60 * int(price // 100) + s) * pow(7919, -1, 2592000) % 2592000, user, price) for s in (1, 59)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = connect("/root/testdata/sf0.001")
    for table in ("orders", "events"):
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    same(queries.queries()[name](spark, str(tmp_path)), con, queries.oracle_sql()[name])
