"""File search over isolated, access-controlled knowledge bases.

Access is decided before anything is ranked, and statistics are taken inside each
knowledge base, so that what a principal can't see changes nothing that they see.
All of it is built-in expressions; the only shuffles are those of the aggregations
and of the ranking, whose per-principal top-k Spark limits before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.functions.text import tokens
from kilnworks.sources.shared import written


def kb_assign(docs: DataFrame, rule) -> DataFrame:
    """docs with kb, a column expression's value; a null kb belongs to nobody."""
    return docs.withColumn("kb", rule)


def acl_visible(files: DataFrame, acl: DataFrame, principal: str) -> DataFrame:
    """files that one principal is granted; repeated grants change nothing."""
    return files.join(acl.where(F.col("principal") == principal), "kb", "left_semi")


def acl_expand(files: DataFrame, acl: DataFrame) -> DataFrame:
    """files once per principal who is granted them."""
    return files.join(acl.select("principal", "kb").distinct(), "kb")


def tokenize(files: DataFrame) -> DataFrame:
    return files.select("doc_id", "kb", F.explode(tokens(F.col("text"))).alias("token"))


def term_freq(files: DataFrame) -> DataFrame:
    return tokenize(files).groupBy("kb", "doc_id", "token").agg(F.count(F.lit(1)).alias("tf"))


def doc_freq(files: DataFrame) -> DataFrame:
    words = files.select("kb", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    return words.groupBy("kb", "token").agg(F.count(F.lit(1)).alias("df"))


def _matched(files: DataFrame, terms: list[str]) -> DataFrame:
    """Occurrences of the terms alone: other tokens never leave the scan's stage."""
    return tokenize(files).where(F.col("token").isin(terms))


def granted(files: DataFrame, acl: DataFrame) -> DataFrame:
    """files that anybody is granted; what nobody sees is never tokenised."""
    return files.join(acl.select("kb"), "kb", "left_semi")


def tf_search(files: DataFrame, acl: DataFrame, terms: list[str], k: int = 5) -> DataFrame:
    """(principal, doc_id, score, rnk): occurrences of the terms, ties by doc_id."""
    hits = _matched(granted(files, acl), terms).groupBy("kb", "doc_id").agg(F.count(F.lit(1)).alias("score"))
    return top(acl_expand(hits, acl), k)


def top(scored: DataFrame, k: int) -> DataFrame:
    """Each principal's k best of (principal, doc_id, score), with ranks; ties by doc_id."""
    order = Window.partitionBy("principal").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k).select("principal", "doc_id", "score", "rnk")


def lengths_and_counts(files: DataFrame, terms: list[str]) -> DataFrame:
    """(kb, doc_id, dl, found): each file's length and the terms' counts in it, from one
    pass over the texts."""
    # The generator keeps Catalyst from computing the tokens once for each use.
    words = files.select("kb", "doc_id", F.explode(F.array(tokens(F.col("text")))).alias("w"))
    tf = F.transform(F.array(*[F.lit(t) for t in sorted(set(terms))]), lambda t: F.struct(t.alias("token"), F.size(F.filter("w", lambda x: x == t)).alias("tf")))
    return words.select("kb", "doc_id", F.size("w").alias("dl"), F.filter(tf, lambda x: x["tf"] > 0).alias("found"))


def bm25_scores(files: DataFrame, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(kb, doc_id, score): BM25 with the statistics of each knowledge base. Texts are
    read once, into their lengths and the terms' counts, which are written; the
    statistics (a row for each knowledge base) and the scores read those."""
    sized = written(lengths_and_counts(files, terms), "counts")
    names = sorted(set(terms))
    has = [F.sum(F.array_contains("found.token", t).cast("long")) for t in names]
    stats = sized.groupBy("kb").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), F.map_from_arrays(F.array(*[F.lit(t) for t in names]), F.array(*has)).alias("df"))
    hits = sized.select("kb", "doc_id", "dl", F.inline("found"))
    x = hits.join(stats, "kb").withColumn("df", F.element_at("df", F.col("token")))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return x.groupBy("kb", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))


def bm25_search(files: DataFrame, acl: DataFrame, terms: list[str], k: int = 5) -> DataFrame:
    return top(acl_expand(bm25_scores(granted(files, acl), terms), acl), k)


def leak_check(results: DataFrame, files: DataFrame, acl: DataFrame) -> DataFrame:
    """(kb, violations): results that no grant covers, for every kb of files."""
    placed = results.join(files.select("doc_id", "kb"), "doc_id")
    leaks = placed.join(acl, ["principal", "kb"], "left_anti").groupBy("kb").agg(F.count(F.lit(1)).alias("v"))
    return files.select("kb").distinct().join(leaks, "kb", "left").select("kb", F.coalesce("v", F.lit(0)).cast("long").alias("violations"))


def file_set_overlap(file_sets: DataFrame) -> DataFrame:
    """(file_id, n_kb) of files in more than one knowledge base."""
    return file_sets.groupBy("file_id").agg(F.countDistinct("kb").alias("n_kb")).where("n_kb > 1")


def agent_files(agents: DataFrame, file_sets: DataFrame) -> DataFrame:
    """(agent, n_files): each private agent's own file set."""
    return agents.join(file_sets, "kb").groupBy("agent").agg(F.countDistinct("file_id").alias("n_files"))
