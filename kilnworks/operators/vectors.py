"""Nearest vectors by inner product: exact, and by inverted lists of coarse centroids.

Queries are rows of the same table and go in blocks of at most ``BLOCK`` (the only rows
that come to the driver, a block at a time); each block is one pass in which tasks keep
the best k of their rows for each query, so a query gets k rows from each task.

The inverted file: coarse centroids are fitted on a bounded sample of ``SAMPLE`` vectors,
every vector goes to the list of its nearest one, and lists are cut into chunks of about
``CHUNK`` vectors, so that a list with a third of all vectors, copies of one say, is many
groups. A query looks into the ``probes`` lists whose centroids are best for it: queries
are joined to chunks by (list, chunk), and candidates are ranked by their exact products.
How many lists to look into sets recall, which tests measure (vectors without clusters, as
the given ones, need most of them); all lists give the exact result.

Scores are rounded to millionths, as integers, before they are ranked; ties go to the
smaller id. Vectors with another size, a null or a number that isn't finite are left out,
as queries too; so are rows without id. Repeated ids come back as often. An empty table,
or one without queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.sources.shared import written

BLOCK, SAMPLE, CHUNK = 2048, 20_000, 4096
RESULT = "query_id bigint, vec_id bigint, score bigint"


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(vec_id, v) of vectors that take part, as doubles."""
    fine = (F.size("embedding") == dim) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _best(query_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of each query, of scores by (query, row)."""
    out = [(q, ids[c], s[c]) for q, s in zip(query_ids, scores) for c in [np.lexsort((ids, -s))[:k]]]
    q = np.concatenate([np.full(len(c), i) for i, c, _ in out]) if out else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), *(pa.array(np.concatenate([x[j] for x in out]) if out else np.zeros(0, np.int64), pa.int64()) for j in (1, 2))], names=["query_id", "vec_id", "score"])


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    return np.rint(queries @ rows.T * 1e6).astype(np.int64)


def _scan(query_ids: np.ndarray, queries: np.ndarray, k: int):
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = _matrix(batch.column(1), queries.shape[1])
                yield _best(query_ids, batch.column(0).to_numpy(), _scores(queries, rows), k)

    return f


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= k).select("query_id", "vec_id", "score", "rnk")


def exact_top(vectors: DataFrame, every: int = 100, k: int = 10, dim: int = 64) -> DataFrame:
    """(query_id, vec_id, score, rnk): for every vector whose id is divisible by ``every``
    the k best among all."""
    rows, found, last = usable(vectors, dim), None, None
    queries = written(rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]), "queries")
    while True:
        block = (queries if last is None else queries.where(F.col("vec_id") > last)).orderBy("vec_id").limit(BLOCK).collect()
        if not block:
            break
        last = block[-1].vec_id
        part = rows.mapInArrow(_scan(np.array([r.vec_id for r in block]), np.array([r.v for r in block]), k), RESULT)
        found = part if found is None else found.union(part)
    return _ranked(found if found is not None else vectors.sparkSession.createDataFrame([], RESULT), k)


def centroids(rows: DataFrame, lists: int, dim: int, rounds: int = 8) -> np.ndarray:
    """Coarse centroids, fitted on at most ``SAMPLE`` vectors, those with the least hash of
    their ids."""
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()]).reshape(-1, dim)
    if not len(sample):
        return sample
    sample = np.unique(sample, axis=0)
    c = sample[np.random.default_rng(0).permutation(len(sample))[:lists]]
    for _ in range(rounds):
        near = _nearest(sample, c)
        c = np.array([sample[near == i].mean(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
    return c


def _nearest(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(axis=1) - 2 * rows @ c.T).argmin(axis=1)


def _listed(c: np.ndarray, probes: int):
    """Each vector's list, or the probes lists that are best for a query."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _matrix(batch.column(1), c.shape[1])
            near = _nearest(rows, c)[:, None] if probes == 0 else np.argsort(-(rows @ c.T), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.tolist(), pa.list_(pa.int32()))], names=["vec_id", "v", "lists"])

    return f


def _compared(dim: int, k: int):
    def f(left: pa.Table, right: pa.Table) -> pa.Table:
        """Queries against one chunk of a list."""
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in ("query_id", "vec_id", "score")})
        q, rows = (_matrix(t.column("v").combine_chunks(), dim) for t in (left, right))
        ids, names = left.column("query_id").to_numpy(), right.column("vec_id").to_numpy()
        parts = [_best(ids[i : i + 512], names, _scores(q[i : i + 512], rows), k) for i in range(0, len(q), 512)]
        return pa.Table.from_batches(parts)

    return f


def listed_top(vectors: DataFrame, every: int = 100, k: int = 10, dim: int = 64, lists: int = 64, probes: int = 40) -> DataFrame:
    """As exact_top, looking into the probes best lists only."""
    rows = usable(vectors, dim)
    c = centroids(rows, lists, dim)
    if not len(c):
        return exact_top(vectors, every, k, dim)
    kinds = "vec_id bigint, v array<double>, lists array<int>"
    inverted = rows.mapInArrow(_listed(c, 0), kinds).select("vec_id", "v", F.get("lists", F.lit(0)).alias("list"))
    inverted = written(inverted, "inverted-lists")
    sizes = inverted.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))  # a row for each list
    sizes = F.broadcast(sizes)
    chunked = inverted.join(sizes, "list").withColumn("chunk", F.pmod(F.xxhash64("vec_id"), "chunks").cast("int"))
    queries = rows.where(F.col("vec_id") % every == 0).dropDuplicates(["vec_id"]).mapInArrow(_listed(c, min(probes, len(c))), kinds)
    queries = queries.select(F.col("vec_id").alias("query_id"), "v", F.explode("lists").alias("list")).join(sizes, "list")
    queries = queries.select("query_id", "v", "list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    # Queries of one list are cut as vectors are: a block of them meets a copy of the chunk.
    queries = queries.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(4)).cast("int"))
    chunked = chunked.select("vec_id", "v", "list", "chunk", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("part"))
    on = ["list", "chunk", "part"]
    found = queries.groupBy(*on).cogroup(chunked.groupBy(*on)).applyInArrow(_compared(dim, k), RESULT)
    return _ranked(found, k)
