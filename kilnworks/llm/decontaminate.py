r"""Benchmark decontamination with DataFrame functions only.

Test items become windows of ``n`` consecutive normalised words (an item of fewer
words is one window). Every window is known by a key of its first and last word and
its length. The keys form a broadcast hash set; the words of each training text give
one key per position, which one generator and one broadcast hash join test. Only
positions that pass carry their words on, and are verified word by word against the
windows of that key.

The hash set is broadcast only in blocks of at most ``max_broadcast`` windows; a
larger benchmark takes one pass over the texts for each block. Texts are not
shuffled, only hits are; a hit group is one document's.

Nulls: a null text or item has no words; a null item_id is no item (its windows
still count as hits). Repeated rows stay separate rows. Extra columns are ignored by
``hits`` and kept by ``remove``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ODD = -7046029254386353131


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _key(first: Column, last: Column, m: Column) -> Column:
    return F.xxhash64(first, last, m)


def windows(bench: DataFrame, n: int = 10) -> DataFrame:
    """(item_id, m, gram, key) of every window of every item."""
    w = bench.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    w = w.withColumn("m", F.least(F.lit(n), F.size("w")))
    at = w.select("item_id", "m", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1)).alias("p"))
    gram = F.slice("w", F.col("p"), F.col("m"))
    return at.select("item_id", "m", F.array_join(gram, " ").alias("gram"), _key(F.xxhash64(gram[0]), F.xxhash64(F.element_at(gram, -1)), F.col("m")).alias("key"))


def hits(docs: DataFrame, bench: DataFrame, n: int = 10, keep: list[str] = ["doc_id"], max_broadcast: int = 200_000) -> DataFrame:
    """Per document: the columns keep, n_words, hit_words (sorted places, from 0, of
    words inside any occurrence of a window) and items (sorted ids, as strings)."""
    grams = windows(bench, n).groupBy("key", "m", "gram").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    lengths = sorted(r[0] for r in grams.groupBy("m").agg(F.count(F.lit(1)).alias("k")).select("m").collect())  # n values at most
    blocks = max(1, -(-grams.count() // max_broadcast))
    base = docs.select(F.monotonically_increasing_id().alias("_row"), *[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], words(F.col("text")).alias("w"))
    base = base.withColumn("n_words", F.size("w")).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))

    def keys(m: int) -> Column:
        count = F.greatest(F.col("n_words") - m + 1, F.lit(0))
        return F.zip_with(F.slice("h", F.lit(1), count), F.slice("h", F.lit(m), count), lambda a, b: _key(a, b, F.lit(m)))

    every = F.lit(0).cast("long")  # each document's first key, which is in the set: it carries the row without hits
    base = base.withColumn("keys", F.concat(F.array(every), *[keys(m) for m in lengths]))
    carried = ["_row", *[f"_keep{i}" for i in range(len(keep))], "n_words"]
    parts = []
    for b in range(blocks):
        mine = grams if blocks == 1 else grams.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b)
        row = mine.sparkSession.range(1).select(every.alias("key"), F.lit(0).alias("m"), F.lit("").alias("gram"), F.array().cast("array<string>").alias("items"))
        held = F.broadcast(mine.select("key", "m", "gram", "items").union(row))
        got = base.select(*carried, "w", F.posexplode("keys").alias("at", "key")).join(held, "key")
        before = F.lit(1)
        place = F.lit(0)
        for m in lengths:
            place = F.when(F.col("m") == m, F.col("at") - before).otherwise(place)
            before = before + F.greatest(F.col("n_words") - m + 1, F.lit(0))
        got = got.withColumn("p", place).where((F.col("m") == 0) | (F.array_join(F.slice("w", F.col("p") + 1, F.greatest("m", F.lit(1))), " ") == F.col("gram")))
        parts.append(got.select(*carried, "p", "m", "items"))
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    spans = F.when(F.col("m") > 0, F.sequence("p", F.col("p") + F.col("m") - 1))
    out = found.groupBy(*carried).agg(F.collect_set(spans).alias("spans"), F.collect_set("items").alias("items"))
    return out.select(
        *[F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)],
        F.col("n_words").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten("spans"))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten("items"))).alias("items"),
    )


def remove(docs: DataFrame, bench: DataFrame, n: int = 10, spans: bool = False, max_broadcast: int = 200_000) -> DataFrame:
    """docs without contaminated documents or, with ``spans``, with the hit words
    (and what stands between two of them) cut out of their texts and n_chars set to
    what is left."""
    # Whole rows travel as one column, so that no name of theirs can clash.
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    keyed = docs.select(whole, "doc_id", "text", F.xxhash64("text").alias("digest"))
    bad = hits(keyed, bench, n, ["doc_id", "digest"], max_broadcast).where(F.size("hit_words") > 0).dropDuplicates(["doc_id", "digest"])
    bad = bad.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_d"), F.col("hit_words").alias("_hits"))
    same = keyed["doc_id"].eqNullSafe(bad["_id"]) & (keyed["digest"] == bad["_d"])
    columns = {c: F.col(f"whole.`{c}`").alias(c) for c in docs.columns}
    if not spans:
        return keyed.join(bad, same, "left_anti").select(*columns.values())
    gap, inside = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
    joined = keyed.join(bad, same, "left").withColumn("_pieces", F.regexp_extract_all("text", F.lit(rf"(?:^{gap}+)?{inside}+{gap}*"), F.lit(0)))
    cut = F.array_join(F.filter(F.transform("_pieces", lambda x, i: F.when(F.array_contains("_hits", i), F.lit(None)).otherwise(x)), lambda x: x.isNotNull()), "")
    joined = joined.withColumn("_new", F.when(F.col("_hits").isNull(), F.col("text")).otherwise(cut))
    own = {"text": F.col("_new").alias("text"), "n_chars": F.length("_new").cast("long").alias("n_chars")}
    return joined.select(*[own.get(c, x) for c, x in columns.items()])


def digest_query(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """What is asked of op8."""
    return hits(docs, bench).select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, m, array_to_string(w[p:p + m - 1], ' ') AS gram FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT m FROM g),
o AS (SELECT doc_id, m, p, array_to_string(w[p:p + m - 1], ' ') AS gram FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, k WHERE len(w) >= m)),
f AS (SELECT doc_id, p, o.m, item_id FROM o JOIN g ON o.m = g.m AND o.gram = g.gram),
h AS (SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(p, p + m)) AS x FROM (SELECT DISTINCT doc_id, p, m FROM f)) GROUP BY doc_id),
i AS (SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN i USING (doc_id)
"""
