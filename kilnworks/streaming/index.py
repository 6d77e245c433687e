"""Terms of files that arrive on a stream, each version of a file once.

State is a row for each file that changed lately: the hash and time of its newest version.
A version that is a replay (same time or older) changes nothing, and neither does a file
that is later than ``late`` behind the newest time seen; when the watermark passes a
file's time its state goes, because anything older would be late. So state is bounded by
the files of that time, however long the stream runs, where running totals of terms grow
for ever. What comes out is what a sink adds or replaces: a file's terms with its time.

Nulls: a file without doc_id, kb or time is left out; a null text has no terms and sends
one row without token, which says that the version has none. Repeated rows are replays.
Of two versions with one time in one batch the one with the greater text counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from kilnworks.functions.text import tokens

NEWEST = StructType([StructField("changed", LongType())])
VERSIONS = StructType([StructField("kb", StringType()), StructField("doc_id", LongType()), StructField("changed_ms", LongType()), StructField("text", StringType())])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    kinds = {"kb": object, "doc_id": "int64", "changed_ms": "int64", "text": object}
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=k) for i, (c, k) in enumerate(kinds.items())})


class Newest(StatefulProcessor):
    """Passes the versions of a file on that are newer than any before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", NEWEST)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        before = self.newest.get()[0] if self.newest.exists() else -1
        best = None
        for frame in rows:
            for ms, text in zip(frame["changed_ms"].tolist(), frame["text"].tolist()):
                if ms >= watermark and ms > before and (best is None or (ms, text or "") > best):
                    best = (ms, text or "")
        if best is None:
            return
        if before >= 0:
            self.handle.deleteTimer(before)
        self.newest.update((best[0],))
        self.handle.registerTimer(best[0])
        yield _frame([(key[0], key[1], *best)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.newest.clear()
        yield _frame([])

    def close(self) -> None:
        pass


def newest_versions(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """(kb, doc_id, changed_ms, text) of each version of a file that is news; files has
    doc_id, kb, text and changed, a time. Needs the RocksDB state store."""
    known = files.where("doc_id IS NOT NULL AND kb IS NOT NULL AND changed IS NOT NULL")
    rows = known.select("kb", F.col("doc_id").cast("long").alias("doc_id"), F.col("changed").cast("timestamp").alias("changed"), "text")
    rows = rows.withWatermark("changed", late).withColumn("changed_ms", F.unix_millis("changed"))
    return rows.groupBy("kb", "doc_id").transformWithStateInPandas(Newest(), VERSIONS, "Append", "EventTime")


def index_stream(files: DataFrame, late: str = "1 hour") -> DataFrame:
    """(kb, doc_id, changed_ms, token, tf): the terms of each version that is news."""
    news = newest_versions(files, late)
    counted = F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("token"), F.size(F.filter("w", lambda x: x == t)).alias("tf")))
    cut = news.select("kb", "doc_id", "changed_ms", F.explode(F.array(tokens(F.col("text")))).alias("w"))
    return cut.select("kb", "doc_id", "changed_ms", F.explode_outer(counted).alias("t")).select("kb", "doc_id", "changed_ms", "t.*")
