"""Joins by time: points in intervals, overlapping intervals, and the last row before.

No join here compares all rows of a key with each other.  Intervals are dealt to buckets of time, of a size that goes with
their own length, so that a long one isn't cut into many; rows meet where key, size and bucket agree, and the exact
condition follows.  What has a bucket with many rows to itself is salted.  The as-of join is one sorted merge of both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructType, TimestampNTZType, TimestampType

from ..sources.shared import written

#: A level's buckets are so many times as wide as those of the level below; an interval covers about as many of its own at most.
FACTOR = 4
#: The level of intervals without an end.
ENDLESS = 1000
#: Rows that meet the same intervals in one task before they are salted.
HOT = 100_000


def _number(df: DataFrame, column: str) -> Column:
    """A time or number as a number: micros, days, or itself; NaN: null."""
    kind, c = df.schema[column].dataType, F.col(column)
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    if isinstance(kind, DateType):
        return F.unix_date(c).cast("bigint")
    return F.nanvl(c.cast("double"), F.lit(None)) if kind.typeName() in ("double", "float") else c


def _distinct_names(left: DataFrame, right: DataFrame, on: list[str]) -> None:
    both = (set(left.columns) & set(right.columns)) - set(on)
    if both:
        raise ValueError(f"columns of both sides: {sorted(both)}; rename them on one side")


def _bucket(value: Column, width: float, level: Column) -> Column:
    """Monotone in the value, so that what lies in an interval has a bucket between those of its ends.  At level ENDLESS all is one bucket."""
    finite = F.greatest(F.lit(-1e300), F.least(F.lit(1e300), value.cast("double")))
    return F.floor(finite / (F.lit(float(width)) * F.pow(F.lit(float(FACTOR)), level))).cast("bigint")


def _levelled(df: DataFrame, width: float) -> DataFrame:
    """With _level: that whose buckets are first as wide as the interval (_start, _end) is long."""
    times = (F.col("_end").cast("double") - F.col("_start").cast("double")) / F.lit(float(width))
    steps = F.ceil(F.log(times) / F.lit(float(np.log(FACTOR))))
    return df.withColumn("_level", F.when(times > 1e200, ENDLESS).when(times > 1, steps).otherwise(0).cast("int"))


def _covered(df: DataFrame, width: float) -> DataFrame:
    """A row for each bucket of its level that an interval covers."""
    ends = F.sequence(_bucket(F.col("_start"), width, F.col("_level")), _bucket(F.col("_end"), width, F.col("_level")))
    return df.withColumn("_bucket", F.explode(ends))


def _salted(many: DataFrame, few: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both with _salt: of groups of over HOT rows in ``many`` these are dealt out by _place, and those of ``few`` are there for each salt."""
    hot = many.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > HOT).select(*by, F.ceil(F.col("_n") / HOT).cast("int").alias("_salts"))
    one = F.coalesce("_salts", F.lit(1))
    dealt = many.join(hot, by, "left").withColumn("_salt", F.pmod(F.xxhash64("_place"), one).cast("int")).drop("_salts")
    spread = few.join(hot, by, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    return dealt, spread


def _intervals(df: DataFrame, start: str, end: str, on: list[str], closed: bool) -> DataFrame:
    """Rows whose interval holds anything, with _start and _end."""
    out = df.withColumn("_start", _number(df, start)).withColumn("_end", _number(df, end))
    holds = F.col("_start") <= F.col("_end") if closed else F.col("_start") < F.col("_end")
    for c in on:
        holds = holds & F.col(c).isNotNull()
    return out.where(holds)


def _scale(intervals: DataFrame, width: float | None) -> tuple[float, list[int]]:
    """The width of the narrowest buckets (None: the mean length of an interval) and the levels that occur: one row."""
    length = F.col("_end").cast("double") - F.col("_start").cast("double")
    mean = width or intervals.agg(F.avg(F.when(length < 1e200, length))).first()[0] or 1.0
    levels = _levelled(intervals, mean).agg(F.collect_set("_level")).first()[0]
    return float(mean), sorted(levels)


def interval_join(points: DataFrame, intervals: DataFrame, on: list[str], time: str, start: str, end: str, how: str = "inner", closed: bool = False, width: float | None = None) -> DataFrame:
    """Each row of ``points`` with each row of ``intervals`` of the same keys that has start <= time < end (``closed``: <= end).

    ``how``: inner, left (points without an interval stay, with nulls) or left_anti (only these).  ``width``: of the
    narrowest buckets, in microseconds of timestamps, days of dates, or units of numbers; it changes the speed only.
    Null keys, times and ends match nothing, nor do intervals that end before they begin; repeated rows match each.
    Columns other than the keys have different names on both sides, or it's an error.
    """
    if how not in ("inner", "left", "left_anti"):
        raise ValueError(f"how is {how}, not inner, left or left_anti")
    _distinct_names(points, intervals, on)
    known = _intervals(intervals, start, end, on, closed)
    size, levels = _scale(known, width)
    covered = _covered(_levelled(known, size), size)
    inside = lambda t: (F.col(t) >= F.col("_start")) & ((F.col(t) <= F.col("_end")) if closed else (F.col(t) < F.col("_end")))
    timed = points.withColumn("_time", _number(points, time)).withColumn("_place", F.monotonically_increasing_id())
    names = [*points.columns, *[c for c in intervals.columns if c not in on]]
    found = None
    if how != "left_anti":
        dealt = timed.where(F.col("_time").isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>")))
        by = [*on, "_level", "_bucket"]
        dealt, spread = _salted(dealt.withColumn("_bucket", _bucket(F.col("_time"), size, F.col("_level"))), covered, by)
        found = dealt.join(spread, [*by, "_salt"]).where(inside("_time")).select(*names)
    if how == "inner":
        return found
    alone = timed
    for level in levels:
        own = covered.where(F.col("_level") == level).select(*[F.col(c).alias(f"_on{k}") for k, c in enumerate(on)], "_bucket", "_start", "_end")
        same = [F.col(c) == F.col(f"_on{k}") for k, c in enumerate(on)]
        alone = alone.join(own, [*same, _bucket(F.col("_time"), size, F.lit(level)) == F.col("_bucket"), inside("_time")], "left_anti")
    if how == "left_anti":
        return alone.select(*points.columns)
    kinds = {f.name: f.dataType for f in intervals.schema}
    return found.unionByName(alone.select(*points.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in names[len(points.columns) :]]))


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], closed: bool = False, width: float | None = None) -> DataFrame:
    """Pairs of rows of the same keys whose intervals have something in common (``closed``: an end in common is enough).

    Two intervals meet at the longer one's level; of the buckets that both cover, the one in which the later one begins
    has the pair.  Nulls, empty intervals and names as in ``interval_join``.
    """
    _distinct_names(left, right, on)
    a, b = _intervals(left, *left_ends, on, closed), _intervals(right, *right_ends, on, closed)
    size, levels = _scale(a.select("_start", "_end").unionByName(b.select("_start", "_end")), width)

    def at_levels(df: DataFrame) -> DataFrame:
        above = F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x >= F.col("_own"))
        return _covered(_levelled(df, size).withColumnRenamed("_level", "_own").withColumn("_level", F.explode(above)), size)

    by = [*on, "_level", "_bucket"]
    first = at_levels(a.withColumn("_place", F.monotonically_increasing_id()))
    second = at_levels(b).withColumnsRenamed({"_start": "_start2", "_end": "_end2", "_own": "_own2"})
    first, second = _salted(first, second, by)
    meet = (F.col("_start") <= F.col("_end2")) & (F.col("_start2") <= F.col("_end")) if closed else (F.col("_start") < F.col("_end2")) & (F.col("_start2") < F.col("_end"))
    once = (F.col("_level") == F.greatest("_own", "_own2")) & (F.col("_bucket") == _bucket(F.greatest("_start", "_start2"), size, F.col("_level")))
    return first.join(second, [*by, "_salt"]).where(meet & once).select(*left.columns, *[c for c in right.columns if c not in on])


def _merge_sorted(dealt: DataFrame, keys: int, schema: StructType) -> DataFrame:
    """From both sides in the order of the merge, the left rows (kind 0) with the last right row of their key in this partition; ``open`` if there is none here but may be one before; and a row a partition (kind 1) with its last key and that key's last right row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    out_schema = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, held, seen = TaskContext.get().partitionId(), None, None, 0
        left_type = right_type = None
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            columns, right, ours, theirs = b.columns[:keys], b.column(keys).to_numpy(zero_copy_only=False), b.column(keys + 1), b.column(keys + 2)
            left_type, right_type = ours.type, theirs.type
            changed = np.zeros(n, dtype=bool)
            for k, c in enumerate(columns):
                changed[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False)
                changed[0] |= key is None or c[0].as_py() is None or c[0].as_py() != key[k]
            at = np.arange(n)
            start, last = np.maximum.accumulate(np.where(changed, at, 0)), np.maximum.accumulate(np.where(right, at, -1))
            group, here = seen + np.cumsum(changed), last >= start
            goes_on = ~here & ~np.logical_or.accumulate(changed) & (held is not None)
            some = pa.concat_arrays([held if held is not None else pa.nulls(1, right_type), theirs])
            rows = np.flatnonzero(~right)
            index = pa.array(np.where(here, last + 1, 0)[rows], mask=~(here | goes_on)[rows])
            take = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rows), part), pa.int32()), pa.array(np.zeros(len(rows)), pa.int32()), pa.array((~here & ~goes_on & (group == 1))[rows]), *[c.take(take) for c in columns], ours.take(take), some.take(index)], names=out_schema.names,
            )
            key = [c[n - 1].as_py() for c in columns]
            held = theirs.slice(int(last[-1]), 1) if here[-1] else held if goes_on[-1] else None
            seen = int(group[-1])
        if key is not None:
            ends = [pa.array([k], type=f.type) for k, f in zip(key, list(out_schema)[3:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([1], pa.int32()), pa.array([False]), *ends, pa.nulls(1, left_type), held if held is not None else pa.nulls(1, right_type)], names=out_schema.names)

    return dealt.mapInArrow(run, schema)


def asof_join(
    left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str,
    direction: str = "backward", exact: bool = True, tolerance: float | None = None, tie: list[str] | None = None,
) -> DataFrame:
    """Every row of ``left`` with the last row of ``right`` of the same keys that isn't later (``forward``: the first that isn't earlier).

    ``exact``: whether a row of the same time counts.  ``tolerance``: how far away it may be, in microseconds, days or
    units.  ``tie``: columns of ``right`` by which the greatest of rows of one key and time is taken (else any).  Rows
    without a partner, with a null key or a null time have nulls; null keys and times of ``right`` match nothing;
    repeated rows stay.  Columns other than the keys have different names on both sides, or it's an error.

    Both sides are dealt together by ranges of (keys, time) and sorted there, so a hot key is many ranges, also where its
    times are the same.  A pass over each range carries the last right row along; a row a partition says what the next
    one begins with.  The merged rows are written once, as partitions must be the same for both.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction is {direction}, not backward or forward")
    _distinct_names(left, right, on)
    back = direction == "backward"
    payload = [c for c in right.columns if c not in on]
    struct = lambda names: F.struct(*[F.col(f"`{c}`") for c in names])
    known = right.where(_number(right, right_time).isNotNull())
    for c in on:
        known = known.where(F.col(c).isNotNull())
    best = [f"_tie{k}" for k in range(len(tie or []))]
    theirs = known.select(*on, _number(known, right_time).alias("_t"), F.lit(True).alias("_right"), struct(payload).alias("_r"), *[F.col(c).alias(b) for c, b in zip(tie or [], best, strict=True)])
    ours = left.select(*on, _number(left, left_time).alias("_t"), F.lit(False).alias("_right"), struct(left.columns).alias("_l"))
    both = theirs.unionByName(ours, allowMissingColumns=True).withColumn("_place", F.monotonically_increasing_id())
    side = F.col("_right").desc() if exact else F.col("_right").asc()
    order = [*on, F.col("_t").asc_nulls_first() if back else F.col("_t").desc_nulls_last(), side, *best, "_place"]
    dealt = both.repartitionByRange(*order).sortWithinPartitions(*order).select(*[F.col(c).alias(f"_on{k}") for k, c in enumerate(on)], "_right", "_l", "_r")
    schema = StructType.fromDDL("part int, kind int, open boolean")
    for f in dealt.schema.fields:
        if f.name != "_right":
            schema = schema.add(f.name, f.dataType, True)
    merged = written(_merge_sorted(dealt, len(on), schema))
    keys = [f"_on{k}" for k in range(len(on))]
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    some = F.when(F.col("_r").isNotNull(), F.struct(F.col("_r"), *keys))
    carried = merged.where("kind = 1").select("part", F.last(some, ignorenulls=True).over(before).alias("_carry"))
    out = merged.where("kind = 0").join(F.broadcast(carried), "part", "left")
    same = F.col("open")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_carry.{k}"))
    partner = F.when(same, F.col("_carry._r")).otherwise(F.col("_r"))
    out = out.select(F.col("_l"), partner.alias("_r")).select("_l.*", "_r")
    gap = _number(left, left_time) - _number(right, right_time)
    fits = F.col(left_time).isNotNull()
    if tolerance is not None:
        flat = out.withColumn(right_time, F.col("_r")[right_time])
        fits = fits & F.coalesce(F.abs(gap) <= tolerance, F.lit(False))
        out = flat.withColumn("_r", F.when(fits, F.col("_r"))).drop(right_time)
    else:
        out = out.withColumn("_r", F.when(fits, F.col("_r")))
    return out.select(*left.columns, *[F.col("_r")[c].alias(c) for c in payload])
