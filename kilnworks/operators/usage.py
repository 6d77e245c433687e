"""Usage of knowledge bases at several levels, and sketches of users that merge over days.

Sketches keep a bounded number of bytes whatever they have seen, and days are merged
without reading events again; they are exact within the bounds that ``within`` checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usage_cube(files: DataFrame) -> DataFrame:
    """(kb, lang, source, level, n_files, n_chars) for every combination of kb, lang and
    source being given or summed over (level has a bit for each that is summed over). The
    finest level is counted first, so only its few rows are repeated for the others."""
    fine = files.groupBy("kb", "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("c"))
    # grouping_id() keeps a null that is a value apart from one that stands for all.
    return fine.cube("kb", "lang", "source").agg(F.grouping_id().cast("long").alias("level"), F.sum("n").alias("n_files"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_chars"))


def daily_sketches(events: DataFrame, key: str, user: str, value: str, time: str, lg_k: int = 12) -> DataFrame:
    """(key, day, users, amounts): for each day a HyperLogLog of its users and a KLL
    sketch of its values; a table of these is what is stored."""
    days = events.groupBy(key, F.to_date(time).alias("day"))
    return days.agg(F.hll_sketch_agg(user, F.lit(lg_k)).alias("users"), F.kll_sketch_agg_double(value).alias("amounts"))


def merged(sketches: DataFrame, key: str, quantile: float = 0.5) -> DataFrame:
    """(key, n_users, middle): the days' sketches merged: estimates of the number of
    different users and of a quantile of the values."""
    both = sketches.groupBy(key).agg(F.hll_union_agg("users").alias("u"), F.kll_merge_agg_double("amounts").alias("a"))
    return both.select(key, F.hll_sketch_estimate("u").alias("n_users"), F.kll_sketch_get_quantile_double("a", F.lit(quantile)).alias("middle"))


def within(estimates: DataFrame, events: DataFrame, key: str, user: str, value: str, users_off: float = 0.05, rank_off: float = 0.02) -> DataFrame:
    """(key, exact_users, users_ok, middle_ok): whether the estimates are within bounds of
    the exact number of users, and of the rank that the middle value should have."""
    exact = events.groupBy(key).agg(F.countDistinct(user).alias("exact_users"))
    ranks = events.join(estimates.select(key, "middle"), key).groupBy(key)
    ranks = ranks.agg(F.avg((F.col(value) < F.col("middle")).cast("double")).alias("below"), F.avg((F.col(value) <= F.col("middle")).cast("double")).alias("upto"))
    both = exact.join(estimates, key).join(ranks, key)
    middle = (F.col("below") <= 0.5 + rank_off) & (F.col("upto") >= 0.5 - rank_off)
    return both.select(key, "exact_users", (F.abs(F.col("n_users") - F.col("exact_users")) <= users_off * F.col("exact_users")).alias("users_ok"), middle.alias("middle_ok"))
