"""A training-data pipeline over ``documents``: five stages, each an operator of
kilnworks.llm applied to all that the stage before it kept. Each stage's rows are
written to the shared folder and read again, so a lost executor costs one stage at
most; ``run`` deletes a stage's rows when the next one's are written.

ORACLE_SQL is None: the first stage is a fitted model, which SQL can't express; tests
compare each stage with a brute-force version.

Nulls, empty and wordless texts are clean and unlike any other: they pass every stage
and have no ids. Rows without doc_id are treated like others. Rows that agree in doc_id
and text are one document, of which the third stage keeps one row. Extra columns stay,
whatever their names, but for ``ids`` and ``n_tokens``, which the last stage replaces.
An empty table gives no rows.
"""

from __future__ import annotations

from contextlib import nullcontext

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.llm import bpe, decontaminate, jaccard_join, line_dedup, toxicity
from kilnworks.llm.common import discard, table, written_stage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose expected severity is below the cut that the fit chose."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("grade")))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "text")
    return toxicity.score(whole, model).where(~toxicity.toxic(model)).select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated runs of units, which are cut by content so that passages
    in the middle of a sentence are found; those of which no unit is left go."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), "doc_id", "text")
    out = line_dedup.dedup(whole, content=True).where((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_units")))
    own = {"text": F.col("text")} | ({"n_chars": F.length("text").cast("long").alias("n_chars")} if "n_chars" in docs.columns else {})
    return out.select(*[own.get(c, F.col(f"whole.`{c}`").alias(c)) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingle sets are linked by a
    Jaccard similarity of 0.8 or more."""
    return jaccard_join.keep_one(docs, n=5, similarity=(80, 100))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of a benchmark item."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their token ids; a text that the ids don't decode to fails."""
    codec = bpe.ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    out = codec.encode(docs)
    exact = F.coalesce(codec.decode(F.col("ids")) == F.coalesce(F.col("text"), F.lit("")).cast("binary"), F.lit(False))
    return out.withColumn("n_tokens", F.when(exact, F.size("ids").cast("long")).otherwise(F.raise_error(F.lit("ids don't decode to the text")).cast("long")))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", decontaminated),
    ("byte_bpe", tokenised),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with bpe.short_plans(spark) if stage is tokenised else nullcontext():
            docs = written_stage(lambda f=stage, d=docs: f(spark, d, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return docs
