"""As-of and interval joins by time, without range products.

As-of: each left row gets the latest right row of its key whose time isn't later. Both
sides are merged in the order of time: a window over (key, time bucket) passes the last
right row on. What a bucket inherits is decided on one row for each key and bucket that
occur, so neither a hot key nor a long time goes through one task: a bucket holds the rows
of one key in ``bucket`` seconds.

Interval: left rows whose time lies in [start, end) of a right row of the same key.
Intervals are cut into dyadic pieces, each a whole multiple of a power of two of ``unit``
seconds, at most two of each size, and times look up the one piece of each size that
they lie in: equal keys again, whatever the lengths of the intervals.

Nulls: a left row with a null key or time has no match; right rows with one, and intervals
with a null or reversed end, are nobody's. Of right rows of one key and time the one with
the greatest values counts. Repeated left rows each get their match. Left columns stay,
right ones come as one struct named ``match``, so that no names clash. An empty side gives
the left rows without match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, bucket: int = 86_400) -> DataFrame:
    """left's rows with match, a struct of right's columns or null; key is a column of both."""
    width = bucket * 1_000_000
    rows = left.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"), F.col(key).alias("k"), _micros(F.col(left_time)).alias("t"))
    sides = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull())
    sides = sides.select(F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("m"), F.col(key).alias("k"), _micros(F.col(right_time)).alias("t"))
    place = F.floor(F.col("t") / F.lit(width)).alias("b")
    lone = F.col("k").isNull() | F.col("t").isNull()
    known, others = rows.where(~lone), rows.where(lone)

    # The last right row of each bucket, and what each bucket that has left rows inherits.
    last = sides.groupBy("k", place).agg(F.max(F.struct("t", "m")).alias("last"))
    wanted = known.select("k", place).distinct().withColumn("last", F.lit(None).cast(last.schema["last"].dataType))
    buckets = last.unionByName(wanted).groupBy("k", "b").agg(F.max("last").alias("last"), F.max(F.col("last").isNull().cast("int")).alias("wanted"))
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.withColumn("carried", F.last("last", ignorenulls=True).over(before)).where("wanted = 1 AND carried IS NOT NULL")

    # 0: inherited, 1: right rows, 2: left rows, in the order of time.
    none = F.lit(None).cast(sides.schema["m"].dataType)
    parts = [
        known.select("k", place, "t", F.lit(2).alias("side"), none.alias("m"), "row"),
        sides.select("k", place, "t", F.lit(1).alias("side"), "m", F.lit(None).cast(rows.schema["row"].dataType).alias("row")),
        carried.select("k", "b", F.col("carried.t").alias("t"), F.lit(0).alias("side"), F.col("carried.m").alias("m"), F.lit(None).cast(rows.schema["row"].dataType).alias("row")),
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    upto = Window.partitionBy("k", "b").orderBy("t", "side", "m").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = merged.withColumn("match", F.last("m", ignorenulls=True).over(upto)).where("side = 2").select("row", "match")
    every = found.unionByName(others.select("row", none.alias("match")))
    return every.select(*[F.col(f"row.`{c}`").alias(c) for c in left.columns], "match")


#: Sizes of dyadic pieces: up to 2^LEVELS units.
LEVELS = 26


def _pieces(start: Column, end: Column) -> Column:
    """The dyadic pieces (level, place) that [start, end), in units, consists of: at each
    size the odd ones at either end, and at the last whatever is left."""

    def at(level: Column) -> Column:
        size = F.pow(F.lit(2), level).cast("long")
        up = F.ceil(start / size).cast("long")
        down = F.floor(end / size).cast("long")
        left = F.when((up < down) & (up % 2 != 0) & (level < LEVELS), F.array(up)).otherwise(F.array().cast("array<bigint>"))
        right = F.when((up < down) & (down % 2 != 0) & (level < LEVELS), F.array(down - 1)).otherwise(F.array().cast("array<bigint>"))
        rest = F.when((up < down) & (level == LEVELS), F.sequence(up, down - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.array_distinct(F.concat(left, right, rest)), lambda p: F.struct(level.alias("level"), p.alias("place")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), at))


def interval_join(left: DataFrame, right: DataFrame, key: str, time: str, start: str, end: str, unit: int = 60) -> DataFrame:
    """(left's columns, match) for each left row and interval of its key that it lies in."""
    width = unit * 1_000_000
    sides = right.where(F.col(key).isNotNull() & (F.col(start) < F.col(end)))
    s, e = _micros(F.col(start)), _micros(F.col(end))
    sides = sides.select(F.struct(*[F.col(f"`{c}`") for c in right.columns]).alias("match"), F.col(key).alias("k"), s.alias("s"), e.alias("e"))
    # Pieces cover the units that the interval touches; the exact ends are compared afterwards.
    touched = _pieces(F.floor(F.col("s") / F.lit(width)), F.ceil(F.col("e") / F.lit(width)))
    sides = sides.select("match", "k", "s", "e", F.explode(touched).alias("p")).select("match", "k", "s", "e", "p.*")
    rows = left.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"), F.col(key).alias("k"), _micros(F.col(time)).alias("t"))
    looked = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda x: F.struct(x.alias("level"), F.floor(F.col("t") / (F.lit(width) * F.pow(F.lit(2), x))).cast("long").alias("place")))
    rows = rows.select("row", "k", "t", F.explode(looked).alias("p")).select("row", "k", "t", "p.*")
    found = rows.join(sides, ["k", "level", "place"]).where((F.col("t") >= F.col("s")) & (F.col("t") < F.col("e")))
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in left.columns], "match")
