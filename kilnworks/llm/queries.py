"""The queries of this subpackage's operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import public_tokenizers as P

from . import ball_tree, bpe, conversation_repair, decontaminate, html_extract, jaccard_join, license_scan, line_dedup, merkle, quality, token_files, toxicity, warc
from .common import table


def op1_warc(spark, sf_dir):
    return warc.digest_query(table(spark, sf_dir, "pages"))


def op2_token_files(spark, sf_dir):
    return token_files.digest_query(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN)


def op4_merkle(spark, sf_dir):
    return merkle.digest_query(table(spark, sf_dir, "documents"))


def op6_license_scan(spark, sf_dir):
    return license_scan.digest_query(table(spark, sf_dir, "documents"))


def op10_html_extract(spark, sf_dir):
    return html_extract.digest_query(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.digest_query(table(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    return toxicity.digest_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_byte_bpe(spark, sf_dir):
    return bpe.digest_query(spark, table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


def op8_decontamination(spark, sf_dir):
    return decontaminate.digest_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_join.digest_query(table(spark, sf_dir, "documents"))


def op11_ball_tree(spark, sf_dir):
    return ball_tree.cluster(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark, sf_dir):
    return conversation_repair.digest_query(table(spark, sf_dir, "conversations"))


def op13_quality_rules(spark, sf_dir):
    return quality.digest_query(table(spark, sf_dir, "documents"))


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_warc, op2_token_files, op3_line_dedup, op4_merkle, op5_toxicity, op6_license_scan, op7_byte_bpe, op8_decontamination, op9_jaccard_join, op10_html_extract, op11_ball_tree, op12_conversation_repair, op13_quality_rules, pipeline)}
SQL = {"op1_warc": warc.SQL, "op3_line_dedup": line_dedup.SQL, "op6_license_scan": license_scan.SQL, "op8_decontamination": decontaminate.SQL, "op9_jaccard_join": jaccard_join.SQL, "op11_ball_tree": ball_tree.SQL}
