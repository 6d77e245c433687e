import pytest
from oracle import SMALL, assert_same
from pyspark.sql import functions as F

from kilnworks.operators import search as S
from kilnworks.plans.queries import QUERIES, SQL, TERMS
from kilnworks.streaming.search import term_freq_stream


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, name):
    assert_same(QUERIES[name](spark, SMALL), SQL[name])


@pytest.fixture
def files(spark):
    return spark.createDataFrame([(1, "a", "The cat and the dog"), (2, "a", None), (3, "b", "on the mat"), (4, "b", "")], "doc_id long, kb string, text string")


def acl(spark, grants):
    return spark.createDataFrame(grants, "principal string, kb string")


def test_isolation(spark, files):
    grants = acl(spark, [("p", "a"), ("p", "a"), ("q", "b")])
    got = S.bm25_search(files, grants, TERMS).collect()
    assert {(r.principal, r.doc_id) for r in got} == {("p", 1), ("q", 3)}
    more = files.union(spark.createDataFrame([(9, "b", "the the the and")], files.schema))
    after = S.bm25_search(more, grants, TERMS).where("principal = 'p'").collect()
    assert after == [r for r in got if r.principal == "p"]
    assert S.acl_visible(files, grants, "nobody").count() == 0


def test_leaks_are_counted(spark, files):
    results = spark.createDataFrame([("p", 1), ("p", 3)], "principal string, doc_id long")
    got = S.leak_check(results, files, acl(spark, [("p", "a")])).collect()
    assert {(r.kb, r.violations) for r in got} == {("a", 0), ("b", 1)}


def test_overlap_and_empty(spark, files):
    sets = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "kb string, file_id long")
    assert [tuple(r) for r in S.file_set_overlap(sets).collect()] == [(1, 2)]
    assert S.tf_search(files.limit(0), acl(spark, [("p", "a")]), TERMS).count() == 0


def test_stream(spark, files, tmp_path):
    files.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    q = term_freq_stream(stream).writeStream.outputMode("complete").format("memory").queryName("tf").start()
    q.processAllAvailable()
    q.stop()
    got = {tuple(r) for r in spark.table("tf").select("kb", "doc_id", "token", "tf").collect()}
    assert got == {tuple(r) for r in S.term_freq(files).select("kb", "doc_id", "token", "tf").collect()}
    with pytest.raises(ValueError):
        term_freq_stream(files)


def test_access_is_below_tokenising(spark, files):
    """The semi-join with the grants stands under the generator of tokens."""
    acl_ = acl(spark, [("p", "a")])
    for q in (S.tf_search(files, acl_, TERMS), S.lengths_and_counts(S.granted(files, acl_), TERMS)):
        lines = q._jdf.queryExecution().optimizedPlan().toString().split("\n")
        depth = lambda word: [len(x) - len(x.lstrip(" :+-")) for x in lines if word in x]
        assert depth("Generate explode") and max(depth("LeftSemi")) > min(depth("Generate explode"))
    assert S.tf_search(files, acl_, TERMS, 1).collect()[0].doc_id == 1


def test_planted_leak_and_overlap(spark):
    leaks = {r.kb: r.violations for r in QUERIES["p7_leak_check"](spark, SMALL).collect()}
    assert leaks == {"archive": 0, "plant": 5}
    assert {r.n_kb for r in QUERIES["p8_file_set_overlap"](spark, SMALL).collect()} == {2}


def test_odd_sources(spark):
    """A source without a number is in neither knowledge base's even half; it fails nothing."""
    docs = spark.createDataFrame([(1, "srcX"), (2, None), (3, "src4")], "doc_id long, source string")
    rule = F.when(F.substring("source", 4, 9).try_cast("int") % 2 == 0, "archive").otherwise("plant")
    assert {r.doc_id: r.kb for r in S.kb_assign(docs, rule).collect()} == {1: "plant", 2: "plant", 3: "archive"}


def test_bm25_reads_texts_once(spark):
    """One scan and one tokenisation of the texts; what follows reads counts."""
    table_ = spark.read.parquet(f"{SMALL}/documents.parquet").selectExpr("doc_id", "'a' AS kb", "text")
    first = S.lengths_and_counts(table_, TERMS)._jdf.queryExecution().executedPlan().toString()
    assert first.count("FileScan") == 1 and all(x.count("split(lower") <= 1 for x in first.split("\n"))
    rest = S.bm25_scores(table_, TERMS)._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in rest and "documents.parquet" not in rest


def test_stream_update_mode(spark, files, tmp_path):
    """Batches that arrive later only send the counts that changed."""
    files.where("doc_id < 3").coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    q = term_freq_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: seen.append({(r.kb, r.doc_id, r.token): r.tf for r in df.collect()})).start()
    q.processAllAvailable()
    files.where("doc_id >= 3").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert ("a", 1, "the") in seen[0] and all(d == 3 for _, d, _ in seen[-1])
    whole = {}
    for s in seen:
        whole |= s
    assert whole == {(r.kb, r.doc_id, r.token): r.tf for r in S.term_freq(files).collect()}
