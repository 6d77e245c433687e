"""Vectors, usage, windows, the table function and the index of a stream."""

from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from kilnworks.operators import search as S
from kilnworks.operators import table_function, usage, vectors
from kilnworks.plans import queries as Q
from kilnworks.sources.tables import table
from kilnworks.streaming import index as stream_index
from kilnworks.streaming import windows

START = datetime(2024, 1, 1)


def feed(spark, frames, schema, path, query):
    """Rows of a stream's output by batch, a file for each of frames."""
    Path(path).mkdir()
    stream, seen = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path), []
    q = query(stream).writeStream.outputMode("append").foreachBatch(lambda df, i: seen.append(df.collect())).start()
    try:
        for f in frames:
            f.coalesce(1).write.mode("append").parquet(path)
            q.processAllAvailable()
        return [r for rows in seen for r in rows], q.lastProgress
    finally:
        q.stop()


def test_stream_of_versions(spark, tmp_path):
    schema = "doc_id long, kb string, text string, changed timestamp"
    at = lambda h: START + timedelta(hours=h)
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    first = rows((1, "a", "one two two", at(0)), (2, "a", None, at(0)), (3, "b", "old", at(0)), (3, "b", "new", at(1)), (None, "a", "no id", at(0)), (4, None, "no kb", at(0)), (5, "a", "no time", None))
    later = rows((1, "a", "three", at(2)))
    frames = [first, first, later, first, rows((9, "a", "far ahead", at(100))), rows((1, "a", "late", at(3)), (8, "b", "late too", at(50))), rows((1, "a", "again", at(101)))]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got, last = feed(spark, frames, schema, str(tmp_path / "in"), stream_index.index_stream)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    hour = lambda ms: round((datetime.fromtimestamp(ms / 1000) - START).total_seconds() / 3600)
    assert sorted((r.kb, r.doc_id, hour(r.changed_ms), r.token or "", r.tf or 0) for r in got) == [
        ("a", 1, 0, "one", 1), ("a", 1, 0, "two", 2), ("a", 1, 2, "three", 1), ("a", 1, 101, "again", 1), ("a", 2, 0, "", 0), ("a", 9, 100, "ahead", 1), ("a", 9, 100, "far", 1), ("b", 3, 1, "new", 1),
    ]
    assert last["stateOperators"][0]["numRowsTotal"] <= 4  # files 1 and 9 and their timers: older state is gone


@pytest.mark.parametrize("kind", [windows.sessions, windows.sliding])
def test_stream_equals_table(spark, tmp_path, kind):
    """A stream in order of time, with repeated and late rows, gives the windows that the table gives without the late ones."""
    events = table(spark, SMALL, "events").select("event_id", "ts", "user_id").where("event_id < 400").withColumn("ts", F.col("ts").cast("timestamp"))
    key = "user_id"
    frames = [events.where(f"event_id >= {a} AND event_id < {a + 100}") for a in range(0, 400, 100)]
    frames.insert(3, events.where("event_id < 20"))  # days late
    end = events.agg(F.max("ts") + F.expr("INTERVAL 30 DAYS")).first()[0]
    frames += [spark.createDataFrame([(10**6, end, -1)], events.schema), spark.createDataFrame([(10**6, end, -1)], events.schema)]
    got, _ = feed(spark, frames, events.schema, str(tmp_path / "in"), lambda s: kind(s, key, "ts"))
    tuples = lambda rows: sorted((r[key], r.opens, r.closes, r.n) for r in rows if r[key] != -1)
    assert tuples(got) == tuples(kind(events, key, "ts").collect())


def test_windows_nulls(spark):
    rows = spark.createDataFrame([(1, START), (1, START), (1, None), (None, START)], "u long, t timestamp")
    assert [r.n for r in windows.sessions(rows, "u", "t").collect()] == [2]
    assert {(r.u, r.n) for r in windows.sliding(rows, "u", "t").collect()} == {(1, 2), (None, 1)}
    assert windows.sessions(rows.limit(0), "u", "t").count() == 0


def test_listed_vectors_recall(spark):
    for d in (SMALL, "/root/testdata/sf0.1"):
        every = table(spark, d, "embeddings")
        want = {(r.query_id, r.vec_id) for r in vectors.exact_top(every).collect()}
        got = {(r.query_id, r.vec_id) for r in vectors.listed_top(every).collect()}
        assert len(got & want) >= 0.9 * len(want) and len(got) == len(want)


def test_vectors_odd(spark, monkeypatch):
    """Copies that fill a list, ties, repeated and bad rows; all lists give the exact result."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(1000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(400)]
    rows += [(2000, [float("nan")] * 4), (2100, None), (2200, [1.0] * 3), (None, [1.0] * 4), (2300, [None] * 4), (0, rows[0][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, list string")
    good = [(i, v) for i, v in rows if i is not None and i < 2000]
    want = []
    for q, v in {i: v for i, v in good if i % 100 == 0}.items():
        best = sorted(((-int(np.rint(np.dot(v, w) * 1e6)), i) for i, w in good))[:7]
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(best)]
    monkeypatch.setattr(vectors, "BLOCK", 3)
    monkeypatch.setattr(vectors, "CHUNK", 50)
    tuples = lambda x: sorted(tuple(r) for r in x.collect())
    assert tuples(vectors.exact_top(df, k=7, dim=4)) == sorted(want)
    assert tuples(vectors.listed_top(df, k=7, dim=4, lists=8, probes=8)) == sorted(want)
    assert vectors.exact_top(df.limit(0), dim=4).count() == 0 and vectors.listed_top(df.limit(0), dim=4).count() == 0


def test_cube_nulls(spark):
    files = spark.createDataFrame([("a", "en", "s", "xy"), ("a", None, "s", None), (None, None, None, "z")], "kb string, lang string, source string, text string")
    got = {(r.kb, r.lang, r.source, r.level): (r.n_files, r.n_chars) for r in usage.usage_cube(files).collect()}
    assert got[None, None, None, 7] == (3, 3) and got[None, None, None, 0] == (1, 1)
    assert got["a", None, None, 3] == (2, 2) and got["a", None, "s", 0] == (1, 0)
    assert all(level == 7 for _, _, _, level in [tuple(r)[:4] for r in usage.usage_cube(files.limit(0)).collect()])


def test_sketches_are_mergeable(spark):
    """Days in any order and any grouping give the sketch of all days; bounds hold at 200,000 users."""
    events = spark.range(600_000).selectExpr("'t' AS k", "hash(id) % 200000 AS u", "CAST(id % 1000 AS DOUBLE) AS v", "timestamp'2024-01-01' + make_interval(0, 0, 0, CAST(id % 9 AS INT)) AS ts")
    days = usage.daily_sketches(events, "k", "u", "v", "ts")
    assert days.count() == 9
    m = usage.merged(days, "k")
    assert usage.within(m, events, "k", "u", "v").where("users_ok AND middle_ok").count() == 1
    assert abs(m.first().middle - 500) < 20


def test_table_function(spark):
    """The function's rows are the search's; its arguments can't reach other knowledge bases."""
    files = Q._files(spark, SMALL)
    table_function.register(files, Q._acl(spark))
    want = [(r.doc_id, r.score, r.rnk) for r in S.tf_search(files, Q._acl(spark), Q.TERMS).where("principal = 'ana'").orderBy("rnk").collect()]
    call = lambda who, terms="array('the', 'and', 'on')", k=5: [tuple(r) for r in spark.sql("SELECT * FROM kb_search(" + terms + ", :who, :k) ORDER BY rnk", {"who": who, "k": k}).collect()]
    assert call("ana") == want and call("ana", k=2) == want[:2]
    for who in ("nobody", "", None, "ana' OR '1'='1", "%", "ana', 'ben", "x' UNION SELECT * FROM kb_search_files --"):
        assert call(who) == []
    plant = {r.doc_id for r in files.where("kb = 'plant'").select("doc_id").collect()}
    assert not plant & {r[0] for r in call("ana", terms="array('the', 'x'') OR true --', '%', NULL)", k=10_000)}
    plan = spark.sql("SELECT * FROM kb_search(array('the'), 'ana', 5)")._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.split("\n")
    depth = lambda word: [len(x) - len(x.lstrip(" :+-")) for x in lines if word in x]
    assert max(depth("LeftSemi")) > min(depth("Generate explode"))
