"""Pieces that several operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.sources.shared import discard, shared_folder, store, written, written_stage
from kilnworks.sources.tables import table

__all__ = ["discard", "shared_folder", "store", "table", "written", "written_stage"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often body uses it."""
    return F.transform(F.array(value), body)[0]


def literal_strings(values, separator: str = "\x01") -> Column:
    """An array literal. Catalyst folds the split while it plans, so that tasks
    get one array; building it from single literals takes seconds per 10,000."""
    return F.split(F.lit(_joined(values, separator)), separator, -1)


def literal_longs(values) -> Column:
    return F.split(F.lit(_joined(map(str, values), ",")), ",").cast("array<bigint>")


def _joined(values, separator: str) -> str:
    """Joined in parts: a million small strings at once would fill the driver."""
    values, parts = iter(values), []
    while part := list(islice(values, 4096)):
        parts.append(separator.join(part))
    return separator.join(parts)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the undirected edges (a, b), component
    being the least node that can be reached. Alternates the large-star and
    small-star steps of Kiveris et al. (2014); each round is written to the shared
    folder, so lineage stays short and no link is gathered in one place. Rounds
    grow with the logarithm of the longest path. Empty edges give no rows."""
    e = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("m").alias("a"), "b")
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(down, "b").select(F.col("m").alias("x"), "a", "b")
        small = small.select(F.explode(F.array(F.struct(F.col("x").alias("a"), F.col("a").alias("b")), F.struct(F.col("x").alias("a"), F.col("b").alias("b")))).alias("e"))
        e = written(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if now == seen:
            break
        seen = now
    stars = e.groupBy("b").agg(F.min("a").alias("component"))
    return stars.select(F.col("b").alias("node"), "component").union(stars.select(F.col("component").alias("node"), "component").distinct())


def give_back() -> None:
    """What a Python worker has freed goes back to the system: Arrow's pool and glibc keep it
    otherwise, beside the executor's heap, as long as the worker lives."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        ctypes.CDLL(None).malloc_trim(0)


def runs(batches: Iterator, keys: list[str]) -> Iterator[list]:
    """Lists of the consecutive rows (as pandas frames) that agree in keys, over the
    batches of one sorted partition. A run is as long as its group, so groups must
    be bounded by whoever dealt them."""
    held: list = []
    last = None
    for frame in batches:
        if not len(frame):
            continue
        changed = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
        changed[0] = True
        starts = [*np.flatnonzero(changed), len(frame)]
        for i, j in zip(starts, starts[1:]):
            part = frame.iloc[i:j]
            key = tuple(part[keys].iloc[0])
            if held and key != last:
                yield held
                held = []
            held.append(part)
            last = key
    if held:
        yield held


class RangeBuckets:
    """Deals rows into n consecutive ranges of an ordering column, n being the
    caller's number of partitions. Bounds are quantiles; with a weight (bytes), fine
    quantiles are merged so that ranges weigh alike. At most 16 n numbers come to the
    driver, however many rows there are. Nulls follow in n ranges of their own, by
    their hash ``z``, so that many rows without an id don't meet in one task."""

    FINE = 16

    def __init__(self, df: DataFrame, column: str, n: int, ascending: bool = True, weight: Column | None = None):
        self.column, self.n, self.ascending = column, n, ascending
        parts = n * self.FINE if weight is not None else n
        known = df.where(F.col(column).isNotNull())
        cuts = known.stat.approxQuantile(column, [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
        self.cuts = sorted({int(x) for x in cuts})
        if weight is not None and self.cuts:
            sums = dict(known.groupBy(self._above().alias("k")).agg(F.sum(weight).alias("w")).collect())
            total, held, kept = sum(w or 0 for w in sums.values()), 0, []
            for k, cut in enumerate(self.cuts):
                held += sums.get(k) or 0
                if held >= total / n:
                    kept.append(cut)
                    held = 0
            self.cuts = kept[: n - 1]

    def _above(self) -> Column:
        """How many cuts lie below the column's value: a search in two steps."""
        x, m = F.col(self.column), math.isqrt(len(self.cuts)) + 1
        if not self.cuts:
            return F.lit(0)
        below = lambda a: F.size(F.filter(a, lambda cut: cut < x))
        at = let(below(literal_longs(self.cuts[m - 1 :: m])) if len(self.cuts) >= m else F.lit(0), lambda k: k * m + below(F.slice(literal_longs(self.cuts), k * m + 1, F.lit(m))))
        return at.cast("int")

    def bucket(self, z: Column) -> Column:
        """0 .. n - 1 in the order asked for, n .. 2 n - 1 for nulls."""
        at = self._above() if self.ascending else F.lit(len(self.cuts)) - self._above()
        part = F.shiftright((F.shiftright(z, 32) + (1 << 31)) * self.n, 32).cast("int")
        part = part if self.ascending else F.lit(self.n - 1) - part
        return F.when(F.col(self.column).isNull(), part + self.n).otherwise(at)

    def dealt(self, df: DataFrame, bucket: str) -> DataFrame:
        """df with each range whole in one partition; ranges are spread evenly."""
        return df.repartitionById(self.n, F.pmod(F.col(bucket), F.lit(self.n)).cast("int"))
