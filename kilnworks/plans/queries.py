"""Registered queries of the search engine and the SQL that says the same.

The tables hold no agents, grants or file sets; these are stated here."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnworks.operators import asof
from kilnworks.operators import index as I
from kilnworks.operators import search as S
from kilnworks.operators import table_function, usage, vectors
from kilnworks.sources import kb_store
from kilnworks.sources.shared import written
from kilnworks.sources.tables import table
from kilnworks.streaming import windows

TERMS = ["the", "and", "on"]
MIXED = ["the", "mit", "license"]
PHRASE = ["of", "the"]
GRANTS = [("ana", "archive"), ("ben", "plant"), ("cas", "archive"), ("cas", "plant")]
AGENTS = [("archivist", "archive"), ("engineer", "plant")]
_KB = "CASE WHEN TRY_CAST(substr(source, 4) AS INT) % 2 = 0 THEN 'archive' ELSE 'plant' END"


def _files(spark, d):
    return S.kb_assign(table(spark, d, "documents"), F.when(F.substring("source", 4, 9).try_cast("int") % 2 == 0, "archive").otherwise("plant")).select("doc_id", "kb", "text")


def _acl(spark):
    return spark.createDataFrame(GRANTS, "principal string, kb string")


def _sets(spark, d):
    return _files(spark, d).select("kb", F.col("doc_id").alias("file_id"))


def _results(spark, d):
    """Search results with a planted leak: ana's list has the best files of the other
    knowledge base as well, as an index shared between knowledge bases would give."""
    acl = _acl(spark)
    leaked = S.tf_search(_files(spark, d), acl.where("kb = 'plant'"), TERMS).where("principal = 'ben'").withColumn("principal", F.lit("ana"))
    return S.tf_search(_files(spark, d), acl, TERMS).unionByName(leaked)


def _shared_sets(spark, d):
    """The file sets, with every tenth file of one planted in the other's as well."""
    sets = _sets(spark, d)
    return sets.union(sets.where("kb = 'archive' AND file_id % 10 = 0").select(F.lit("plant").alias("kb"), "file_id"))


def _indexed(spark, d, search):
    """What a search finds in an index of the files, written; the index goes."""
    index = I.build(_files(spark, d))
    found = written(search(index, _acl(spark)), "found")
    index.drop()
    return found


def _phrase(spark, d):
    return _indexed(spark, d, lambda index, acl: I.phrase_search(index, acl, PHRASE))


def _best(terms):
    return lambda spark, d: _indexed(spark, d, lambda index, acl: I.best_files(index, acl, terms)[0])


def _store_visible(spark, d):
    """Each knowledge base's files and characters that a principal reads from the store."""
    held = kb_store.store(_files(spark, d), _acl(spark))
    return held.visible("ana").select("doc_id", "kb", F.length("text").cast("long").alias("n_chars"))


def _uses_and_grants(spark, d):
    """Uses of knowledge bases, and the log of what users were granted when: purchases
    grant, errors revoke, with the knowledge base by the parity of the user."""
    events = table(spark, d, "events").withColumn("kb", F.when(F.col("user_id") % 2 == 0, "archive").otherwise("plant"))
    uses = events.where("event_type IN ('view', 'click')").select("event_id", "user_id", "kb", "ts")
    return uses, events.where("event_type IN ('purchase', 'error')").select("user_id", "kb", "ts", "event_id", (F.col("event_type") == "purchase").alias("granted"))


def _grants_asof(spark, d):
    uses, log = _uses_and_grants(spark, d)
    found = asof.asof_join(uses, log, "user_id", "ts", "ts")
    return found.select("event_id", "user_id", "kb", F.coalesce("match.event_id", F.lit(-1)).cast("long").alias("grant_id"), F.coalesce("match.granted", F.lit(False)).alias("allowed"))


def _grants_interval(spark, d):
    """Uses inside the grants that a purchase opens for as many hours as it cost."""
    uses, log = _uses_and_grants(spark, d)
    paid = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("grant_id"), "user_id", F.col("ts").alias("opens"), (F.unix_micros(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 100).cast("long") * 36_000_000).alias("us"))
    paid = paid.withColumn("closes", F.timestamp_micros("us").cast("timestamp_ntz"))
    return asof.interval_join(uses, paid, "user_id", "ts", "opens", "closes").select("event_id", "user_id", F.col("match.grant_id").alias("grant_id"))


def _search_sql(spark, d):
    """P5 through the table function of SQL, a call for each principal."""
    table_function.register(_files(spark, d), _acl(spark))
    terms = ", ".join(f"'{t}'" for t in TERMS)
    return spark.sql(" UNION ALL ".join(f"SELECT '{p}' AS principal, * FROM kb_search(array({terms}), '{p}', 5)" for p in dict(GRANTS)))


def _cube(spark, d):
    docs = S.kb_assign(table(spark, d, "documents"), F.when(F.substring("source", 4, 9).try_cast("int") % 2 == 0, "archive").otherwise("plant"))
    return usage.usage_cube(docs)


def _sketches(spark, d):
    events = table(spark, d, "events")
    days = written(usage.daily_sketches(events, "event_type", "user_id", "value", "ts"), "sketches")
    return usage.within(usage.merged(days, "event_type"), events, "event_type", "user_id", "value")


def _utc(found):
    return found.withColumns({c: F.unix_micros(c) for c in ("opens", "closes")})


QUERIES = {
    "kb_search_sql": _search_sql,
    "usage_cube": _cube,
    "usage_sketches": _sketches,
    "event_sessions": lambda s, d: _utc(windows.sessions(table(s, d, "events"), "user_id", "ts")),
    "event_sliding": lambda s, d: _utc(windows.sliding(table(s, d, "events"), "event_type", "ts")),
    "vec_exact_top": lambda s, d: vectors.exact_top(table(s, d, "embeddings")),
    "vec_listed_top": lambda s, d: vectors.listed_top(table(s, d, "embeddings")),
    "kb_store_visible": _store_visible,
    "grants_asof": _grants_asof,
    "grants_interval": _grants_interval,
    "idx_phrase_search": _phrase,
    "idx_best_files": _best(MIXED),
    "idx_best_files_common": _best(TERMS),
    "p1_kb_assign": lambda s, d: _files(s, d).select("doc_id", "kb"),
    "p2_acl_visible": lambda s, d: S.acl_visible(_files(s, d), _acl(s), "ana").select("doc_id"),
    "p3_tokenize": lambda s, d: S.tokenize(_files(s, d)),
    "p4_term_freq": lambda s, d: S.term_freq(_files(s, d)),
    "p4_doc_freq": lambda s, d: S.doc_freq(_files(s, d)),
    "p5_tf_search": lambda s, d: S.tf_search(_files(s, d), _acl(s), TERMS),
    "p6_bm25_scores": lambda s, d: S.bm25_scores(_files(s, d), TERMS),
    "p6_bm25_search": lambda s, d: S.bm25_search(_files(s, d), _acl(s), TERMS),
    "p7_leak_check": lambda s, d: S.leak_check(_results(s, d), _files(s, d), _acl(s)),
    "p7_no_leak": lambda s, d: S.leak_check(S.tf_search(_files(s, d), _acl(s), TERMS), _files(s, d), _acl(s)),
    "p8_file_set_overlap": lambda s, d: S.file_set_overlap(_shared_sets(s, d)),
    "p8_file_sets_disjoint": lambda s, d: S.file_set_overlap(_sets(s, d)).agg(F.count(F.lit(1)).alias("n_shared")),
    "r3_agent_files": lambda s, d: S.agent_files(s.createDataFrame(AGENTS, "agent string, kb string"), _sets(s, d)),
}

_ACL = "acl(principal, kb) AS (VALUES " + ", ".join(f"('{p}', '{k}')" for p, k in GRANTS) + ")"
_AGENTS = "agents(agent, kb) AS (VALUES " + ", ".join(f"('{p}', '{k}')" for p, k in AGENTS) + ")"
_F = f"f AS (SELECT doc_id, {_KB} AS kb, text FROM documents)"
_T = _F + r", t AS (SELECT doc_id, kb, token FROM (SELECT doc_id, kb, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+')) AS token FROM f) WHERE token <> '')"
_IN = "token IN (" + ", ".join(f"'{t}'" for t in TERMS) + ")"
_MIXED = "token IN (" + ", ".join(f"'{t}'" for t in MIXED) + ")"
_TOP = "SELECT principal, doc_id, score, rnk FROM (SELECT principal, doc_id, score, CAST(row_number() OVER (PARTITION BY principal ORDER BY score DESC, doc_id) AS INT) AS rnk FROM s JOIN acl USING (kb)) WHERE rnk <= 5"
_TF = f"{_T}, s AS (SELECT kb, doc_id, count(*) AS score FROM t WHERE {_IN} GROUP BY ALL)"
_BM = (
    f"{_T}, l AS (SELECT f.kb, f.doc_id, count(t.token) AS dl FROM f LEFT JOIN t USING (kb, doc_id) GROUP BY ALL), a AS (SELECT kb, count(*) AS n, avg(dl) AS avgdl FROM l GROUP BY kb), "
    f"q AS (SELECT kb, doc_id, token, count(*) AS tf FROM t WHERE {_IN} GROUP BY ALL), e AS (SELECT kb, token, count(*) AS df FROM q GROUP BY ALL), "
    "s AS (SELECT kb, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM q JOIN e USING (kb, token) JOIN l USING (kb, doc_id) JOIN a USING (kb) GROUP BY ALL)"
)
_LEAKS = "v AS (SELECT f.kb, count(*) AS n FROM r JOIN f USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM acl WHERE acl.principal = r.principal AND acl.kb = f.kb) GROUP BY f.kb) SELECT k.kb, CAST(coalesce(v.n, 0) AS BIGINT) AS violations FROM (SELECT DISTINCT kb FROM f) k LEFT JOIN v USING (kb)"
_WORDS = _F + r", w AS (SELECT doc_id, kb, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS w FROM f)"
_PHRASE = " AND ".join(f"w[p + {i}] = '{t}'" for i, t in enumerate(PHRASE))
_USES = "u AS (SELECT event_id, user_id, CASE WHEN user_id % 2 = 0 THEN 'archive' ELSE 'plant' END AS kb, ts FROM events WHERE event_type IN ('view', 'click'))"
SQL = {
    "kb_search_sql": f"WITH {_TF}, {_ACL} {_TOP}",
    "usage_cube": f"SELECT kb, lang, source, GROUPING(kb, lang, source) AS level, count(*) AS n_files, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM (SELECT {_KB} AS kb, lang, source, text FROM documents) GROUP BY CUBE (kb, lang, source)",
    "usage_sketches": "SELECT event_type, count(DISTINCT user_id) AS exact_users, true AS users_ok, true AS middle_ok FROM events GROUP BY event_type",
    "event_sessions": "SELECT user_id, min(epoch_us(ts)) AS opens, max(epoch_us(ts)) + 21600000000 AS closes, count(*) AS n FROM (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)) GROUP BY user_id, g",
    "event_sliding": "SELECT event_type, opens, opens + 86400000000 AS closes, count(*) AS n FROM (SELECT event_type, epoch_us(ts) // 43200000000 * 43200000000 - unnest([0, 43200000000]) AS opens FROM events WHERE ts IS NOT NULL) GROUP BY ALL",
    "vec_exact_top": "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE len(embedding) = 64), s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(round(list_inner_product(q.e, v.e) * 1000000) AS BIGINT) AS score FROM v q, v WHERE q.vec_id % 100 = 0) SELECT query_id, vec_id, score, rnk FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rnk FROM s) WHERE rnk <= 10",
    "kb_store_visible": f"WITH {_F}, {_ACL} SELECT doc_id, kb, CAST(length(text) AS BIGINT) AS n_chars FROM f WHERE kb IN (SELECT kb FROM acl WHERE principal = 'ana')",
    "grants_asof": f"WITH {_USES}, g AS (SELECT user_id, ts, event_id, event_type = 'purchase' AS granted FROM events WHERE event_type IN ('purchase', 'error')) SELECT u.event_id, u.user_id, u.kb, CAST(coalesce(g.event_id, -1) AS BIGINT) AS grant_id, coalesce(g.granted, false) AS allowed FROM u ASOF LEFT JOIN g ON u.user_id = g.user_id AND u.ts >= g.ts",
    "grants_interval": f"WITH {_USES}, p AS (SELECT event_id, user_id, ts AS opens, ts + to_microseconds(CAST(round(value * 100) AS BIGINT) * 36000000) AS closes FROM events WHERE event_type = 'purchase') SELECT u.event_id, u.user_id, p.event_id AS grant_id FROM u JOIN p ON u.user_id = p.user_id AND u.ts >= p.opens AND u.ts < p.closes",
    "idx_phrase_search": f"WITH {_WORDS}, {_ACL}, h AS (SELECT kb, doc_id, count(*) AS n FROM (SELECT kb, doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w) WHERE {_PHRASE} GROUP BY ALL) SELECT principal, doc_id, n FROM h JOIN acl USING (kb)",
    "idx_best_files": f"WITH {_BM.replace(_IN, _MIXED)}, {_ACL} {_TOP}",
    "idx_best_files_common": f"WITH {_BM}, {_ACL} {_TOP}",
    "p1_kb_assign": f"WITH {_F} SELECT doc_id, kb FROM f",
    "p2_acl_visible": f"WITH {_F}, {_ACL} SELECT doc_id FROM f WHERE kb IN (SELECT kb FROM acl WHERE principal = 'ana')",
    "p3_tokenize": f"WITH {_T} SELECT doc_id, kb, token FROM t",
    "p4_term_freq": f"WITH {_T} SELECT kb, doc_id, token, count(*) AS tf FROM t GROUP BY ALL",
    "p4_doc_freq": f"WITH {_T} SELECT kb, token, count(DISTINCT doc_id) AS df FROM t GROUP BY ALL",
    "p5_tf_search": f"WITH {_TF}, {_ACL} {_TOP}",
    "p6_bm25_scores": f"WITH {_BM} SELECT kb, doc_id, score FROM s",
    "p6_bm25_search": f"WITH {_BM}, {_ACL} {_TOP}",
    "p7_leak_check": f"WITH {_TF}, {_ACL}, o AS ({_TOP}), r AS (SELECT principal, doc_id FROM o UNION ALL SELECT 'ana', doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rnk FROM s WHERE kb = 'plant') WHERE rnk <= 5), {_LEAKS}",
    "p7_no_leak": f"WITH {_TF}, {_ACL}, r AS ({_TOP}), {_LEAKS}",
    "p8_file_set_overlap": f"WITH {_F}, x AS (SELECT kb, doc_id FROM f UNION ALL SELECT 'plant', doc_id FROM f WHERE kb = 'archive' AND doc_id % 10 = 0) SELECT doc_id AS file_id, count(DISTINCT kb) AS n_kb FROM x GROUP BY doc_id HAVING count(DISTINCT kb) > 1",
    "p8_file_sets_disjoint": f"WITH {_F} SELECT count(*) AS n_shared FROM (SELECT doc_id FROM f GROUP BY doc_id HAVING count(DISTINCT kb) > 1)",
    "r3_agent_files": f"WITH {_F}, {_AGENTS} SELECT agent, count(DISTINCT doc_id) AS n_files FROM agents JOIN f USING (kb) GROUP BY agent",
}
