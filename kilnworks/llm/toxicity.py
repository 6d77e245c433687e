"""Toxicity grades by cumulative-link (proportional odds) regression.

P(grade <= j) = sigmoid(theta_j - w . x): one sparse weight per word is shared by all
ordered thresholds theta_0 < ... < theta_(K-2), and the output is the expected grade,
sum over j of P(grade > j). Features of a text are its words, each with
log(1 + 200 * occurrences / words), so that a word counts by its share of the text.

Fitting uses at most ``sample`` labelled rows, chosen by a hash of doc_id, and all
words that ``least_documents`` of them have, since fewer can't show a weight; nothing
else is bounded: every word of every whole text is scored, by the words with a weight, which
travel with the task. Weights are found by full-batch proximal Adam (L1), so most are
zero.

A text counts as toxic from ``cut`` on, the least expected grade at which at most
``false_rejections`` of the sample's rows of grade 0 are rejected by models fitted
without them (cross-validation in ``folds`` parts). L1 shrinks the grades of short
evidence, so a fixed 0.5 would miss rows that no clean row comes near. A sample too
small to show that rate keeps 0.5.

Grades are integers 0 .. K-1; ``documents`` has only toxic 0/1, so K is 2 there.
Nulls: a null text has no words; a null grade or doc_id isn't fitted on. Without
labelled rows, or with one grade only, every expected grade is that grade (0 without
rows). A document with several labels has the highest; of several texts under one
doc_id the least by hash is fitted on, so that a fit is the same each time. Repeated
rows and extra columns stay; a column named severity is replaced. An empty table of
documents gives the empty model and no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WORDS = re.compile(r"\w+")


def _words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def _value(times, n):
    return math.log1p(200.0 * times / n)


@dataclass
class Ordinal:
    """A fitted model."""

    weights: dict[str, float] = field(default_factory=dict)
    thresholds: list[float] = field(default_factory=list)
    least: int = 0
    cut: float = 0.5

    def expected(self, text: str | None) -> float:
        words = _words(text)
        known = self.weights
        found = Counter(w for w in words if w in known)
        z = sum(known[w] * _value(k, len(words)) for w, k in sorted(found.items()))
        return self.least + sum(1.0 / (1.0 + math.exp(min(60.0, max(-60.0, t - z)))) for t in self.thresholds)


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = []
        for i, g, t in zip(frame["doc_id"], frame["grade"], frame["text"]):
            words = _words(t)
            rows += [(i, g, w, _value(k, len(words))) for w, k in Counter(words).items()] or [(i, g, "", 0.0)]
        yield pd.DataFrame(rows, columns=["doc_id", "grade", "word", "x"])


def fit(docs: DataFrame, grades: DataFrame, sample: int = 4000, least_documents: int = 4, steps: int = 250, l1: float = 2e-4, false_rejections: float = 0.005, folds: int = 5) -> Ordinal:
    """grades: (doc_id, grade)."""
    known = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.max("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # sample rows at most
    rows = rows.groupBy("doc_id", "grade").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"))).alias("text"))
    x = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade"), "text").mapInPandas(_explode, "doc_id long, grade int, word string, x double")
    # Rows of one document come together; the words' counts are those of the sample.

    x = written(x, "sample")
    kept = x.groupBy("word").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") >= least_documents).select("word", F.xxhash64("word").alias("w"))
    labels = x.select("doc_id", "grade").distinct().toArrow().to_pandas().sort_values("doc_id", ignore_index=True)
    cells = x.join(F.broadcast(kept), "word").select("doc_id", "w", F.col("x").cast("float").alias("x")).toArrow().to_pandas().sort_values(["doc_id", "w"], ignore_index=True)
    names = dict(kept.select("w", "word").toArrow().to_pandas().itertuples(index=False, name=None))
    cells = cells.rename(columns={"w": "word"})
    model = solve(labels, cells, steps, l1)
    cut = held_out_cut(labels, cells, steps, l1, least_documents, false_rejections, folds)
    return Ordinal({names[int(w)]: v for w, v in model.weights.items()}, model.thresholds, model.least, cut)


def held_out_cut(labels: pd.DataFrame, cells: pd.DataFrame, steps: int, l1: float, least_documents: int, false_rejections: float, folds: int) -> float:
    """The least cut that models of the other folds show to reject at most
    false_rejections of the rows of grade 0, counted as (k + 1) / (n + 1)."""
    n = int((labels["grade"] == 0).sum())
    allowed = int(false_rejections * (n + 1)) - 1
    if allowed < 0 or labels["grade"].max() <= 0:
        return 0.5
    fold = pd.util.hash_array(labels["doc_id"].to_numpy()) % folds
    cell_fold = fold[np.searchsorted(labels["doc_id"].to_numpy(), cells["doc_id"].to_numpy())]
    clean = []
    for f in range(folds):
        known = cells[cell_fold != f]
        known = known[known.groupby("word")["word"].transform("size") >= least_documents]
        model = solve(labels[fold != f].reset_index(drop=True), known.reset_index(drop=True), steps, l1)
        held = cells[cell_fold == f]
        z = (held["word"].astype(str).map(model.weights).fillna(0.0) * held["x"]).groupby(held["doc_id"]).sum()
        z = z.reindex(labels["doc_id"][(fold == f) & (labels["grade"] == 0)], fill_value=0.0).to_numpy()
        clean.append(model.least + sum((1 / (1 + np.exp(np.clip(t - z, -60, 60))) for t in model.thresholds), np.zeros(len(z))))
    clean = np.sort(np.concatenate(clean))[::-1]
    return float(np.nextafter(clean[allowed], np.inf))


def toxic(model: Ordinal) -> Column:
    """Of the rows of score: whether they reach the model's cut."""
    return F.col("severity") >= model.cut


def solve(labels: pd.DataFrame, cells: pd.DataFrame, steps: int = 250, l1: float = 2e-4) -> Ordinal:
    """The model of labels (doc_id, grade) and cells (doc_id, word, x)."""
    if not len(labels):
        return Ordinal()
    names, grade = np.unique(labels["grade"].to_numpy(), return_inverse=True)
    least, k = int(names[0]), int(names[-1] - names[0] + 1)
    if k == 1:
        return Ordinal(least=least)
    grade = labels["grade"].to_numpy() - least
    row = np.searchsorted(labels["doc_id"].to_numpy(), cells["doc_id"].to_numpy())
    col, words = pd.factorize(cells["word"])
    value = cells["x"].to_numpy()
    n, m = len(labels), len(words)
    above = (grade[:, None] > np.arange(k - 1)[None, :]).astype(float)
    share = np.clip(above.mean(axis=0), 1e-4, 1 - 1e-4)
    theta = np.log(1 - share) - np.log(share)
    w = np.zeros(m)
    moments = [np.zeros(m), np.zeros(m), np.zeros(k - 1), np.zeros(k - 1)]
    for step in range(1, steps + 1):
        z = np.bincount(row, weights=value * w[col], minlength=n)
        p = 1 / (1 + np.exp(np.clip(theta[None, :] - z[:, None], -60, 60)))  # P(grade > j)
        slope = p - above
        g_w = np.bincount(col, weights=value * slope.sum(axis=1)[row], minlength=m) / n
        g_t = -slope.sum(axis=0) / n
        rate = 0.1
        for x, g, a, b in ((w, g_w, 0, 1), (theta, g_t, 2, 3)):
            moments[a] = 0.9 * moments[a] + 0.1 * g
            moments[b] = 0.99 * moments[b] + 0.01 * g * g
            size = np.sqrt(moments[b] / (1 - 0.99**step)) + 1e-6
            x -= rate * (moments[a] / (1 - 0.9**step)) / size
            if x is w:
                np.copyto(w, np.sign(w) * np.maximum(np.abs(w) - rate * l1 / size, 0))
        theta.sort()
    kept = {str(words[i]): float(w[i]) for i in np.flatnonzero(w)}
    return Ordinal(kept, [float(t) for t in theta], least)


def score(docs: DataFrame, model: Ordinal) -> DataFrame:
    """docs with severity, the expected grade."""

    @F.pandas_udf("double")
    def expected(texts: pd.Series) -> pd.Series:
        return pd.Series([model.expected(t) for t in texts], dtype="float64")

    return docs.withColumn("severity", expected(F.col("text")))


def digest_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels.select("doc_id", F.col("toxic").alias("grade")))
    return score(docs.select("doc_id", "text"), model).select("doc_id", "severity", toxic(model).alias("toxic"))
