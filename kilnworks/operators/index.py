"""A positional inverted index of the files of knowledge bases, and searches over it.

The index is four tables:

postings  a row is a block of one term in one knowledge base: the files, and for each its
          term count, length and positions, positions as differences; and ``top``, at least
          what any of these files gets from its count and length (BM25 without the rarity).
          Partitioned by kb, bucketed by ``key``, sorted by key and block.
terms     kb, token, df and parts of each term, bucketed by token.
places    a row for each length that a knowledge base's files have, with the files before.
stats     n and avgdl of each knowledge base, a row each.

Files of a knowledge base stand in one order, by their length: their place, ``BITS`` bits of a
number in [0, 1), is the share of files before a file, files of equal length being spread by a
hash of their id; it follows from id and length. Texts are shuffled once, by zones: ranges of
places, halved until their files have at most ``ZONE`` words. A task has all files of its
zones and makes whole blocks of them, so postings are never shuffled. A term's blocks are
equal parts of a zone, 2^-level wide, so blocks of different terms nest; they hold ``BLOCK``
files of the term on average and at most as many as all files that stand there. A block's
key is its term and a part number: 0 if it is all that the zone has of the term, else one per
``PART`` blocks, so that a term that every file has spreads over buckets.

A search looks its terms up (a bucket of ``terms`` each), and their keys, as literals, let
Spark read the buckets of these terms only and, of those, by ``kb``, the knowledge bases
that somebody of the given principals may read. Access is decided before ranking, and all
statistics are those of one knowledge base.

Nulls: a null text has no tokens; files without kb are in no knowledge base and aren't
indexed. Rows of one (kb, doc_id) should be one file; repeated rows count as files of
their own in n and df and come back as often: ``twin`` numbers those of one length, and files
without id. Ties rank by doc_id. An empty table gives an index without rows, and searches in
it give none. Other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnworks.functions.text import tokens
from kilnworks.operators.search import top
from kilnworks.sources.shared import cleaning, delete, shared_folder, written_stage

BLOCK, PART, BITS = 32, 64, 30
#: Words of a zone's files, and how often a search halves a mean block to have its cells.
ZONE, CELLS = 1 << 21, 2
K1, B = 1.2, 0.75
#: Parquet's second version writes sorted strings and numbers as differences.
PACKED = {"compression": "zstd", "parquet.writer.version": "PARQUET_2_0"}
BLOCKS = "key string, token string, level int, block bigint, n int, top double, doc_id array<bigint>, twin array<bigint>, tf array<int>, dl array<int>, steps array<array<int>>, kb string"


def _table(df: DataFrame, folder: str, name: str, buckets: int, key: str, order: list[str], by: tuple[str, ...] = ()) -> str:
    """Writes a bucketed table below the folder, from df's partitions as they are."""
    out = df.write.options(**PACKED).bucketBy(buckets, key).sortBy(*order).option("path", f"{folder}/{name}")
    table = f"kiln_{name}_{uuid.uuid4().hex}"
    with cleaning(df.sparkSession):
        (out.partitionBy(*by) if by else out).saveAsTable(table)
    return table


@dataclass
class Index:
    """The names of an index's tables, and the folder that they are in."""

    spark: SparkSession
    postings: str
    terms: str
    places: str
    stats: str
    folder: str

    def drop(self) -> None:
        """Deletes the index. What was searched in it must have been written."""
        for t in (self.postings, self.terms, self.places, self.stats):
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        delete(self.folder)

    def lookup(self, wanted: list[str]) -> list[tuple]:
        """(kb, token, df, parts) of the terms: a row for each in each knowledge base."""
        rows = self.spark.table(self.terms).where(F.col("token").isin(sorted(set(wanted))))
        return [tuple(r) for r in rows.select("kb", "token", "df", "parts").collect()]

    def blocks(self, found: list[tuple]) -> DataFrame:
        """The postings' rows of terms that were looked up; buckets and kbs are pruned."""
        keys = sorted({_key(t, p) for _, t, _, parts in found for p in parts})
        kbs = sorted({kb for kb, *_ in found})
        return self.spark.table(self.postings).where(F.col("kb").isin(kbs) & F.col("key").isin(keys))


def _key(token: str, part: int) -> str:
    return f"{token}#{part}"


def _place(doc_id: Column, twin: Column) -> Column:
    """A file's place among the files of its knowledge base, from its row of ``places``."""
    spread = (F.pmod(F.xxhash64(F.coalesce(doc_id, twin)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return F.floor((F.col("before") + spread * F.col("same")) / F.col("all") * (1 << BITS)).cast("long")


def build(files: DataFrame, buckets: int = 16, k1: float = K1, b: float = B) -> Index:
    """Indexes files (doc_id, kb, text)."""
    spark, folder = files.sparkSession, shared_folder(files.sparkSession, "index")
    # The generator keeps Catalyst from computing the tokens once for each use.
    cut = files.where("kb IS NOT NULL").select("kb", F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(tokens(F.col("text")))).alias("w"))
    lengths = written_stage(lambda: cut.groupBy("kb", F.size("w").alias("dl")).agg(F.count(F.lit(1)).alias("same")), "lengths")
    stats = lengths.groupBy("kb").agg(F.sum("same").alias("n"), (F.sum(F.col("same") * F.col("dl")) / F.sum("same")).alias("avgdl"))
    stats = written_stage(lambda: stats, "stats")  # a row for each knowledge base
    before = Window.partitionBy("kb").orderBy("dl").rowsBetween(Window.unboundedPreceding, -1)
    places = lengths.withColumn("before", F.coalesce(F.sum("same").over(before), F.lit(0))).join(stats.select("kb", F.col("n").alias("all"), "avgdl"), "kb")
    places = written_stage(lambda: places, "places")  # a row for each length that occurs
    n_places, n_words = places.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("same") * F.col("dl")), F.lit(0))).first()

    numbered = cut.where(F.size("w") > 0).withColumn("twin", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    numbered = numbered.select("kb", "doc_id", "twin", F.size("w").alias("dl"), F.array_join("w", " ").alias("words"))
    placed = numbered.join(F.broadcast(places) if n_places < 1 << 20 else places, ["kb", "dl"]).withColumn("place", _place(F.col("doc_id"), F.col("twin")))
    depth = F.least(F.greatest(F.ceil(F.log2(F.col("all") * F.col("dl") / ZONE)), F.lit(0)), F.lit(BITS)).cast("int")
    placed = placed.withColumn("depth", depth).withColumn("zone", F.expr(f"shiftright(place, {BITS} - depth)"))
    # Zones have at most ZONE words each, but for files of one id and length.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_words // ZONE))
    zones = placed.select("kb", "depth", "zone", "place", "doc_id", "twin", "dl", "avgdl", "words").repartition(tasks, "kb", "depth", "zone")
    blocks = zones.sortWithinPartitions("kb", "depth", "zone", "doc_id", "dl").mapInArrow(_inverted(BLOCK, PART, k1, b), BLOCKS)
    postings = _table(blocks, folder, "postings", buckets, "key", ["key", "block"], ("kb",))
    part = F.substring_index("key", "#", -1).cast("int")
    terms = spark.table(postings).groupBy("kb", "token", part.alias("part")).agg(F.sum("n").alias("n"))
    terms = terms.repartition(tasks, "token").groupBy("kb", "token").agg(F.sum("n").alias("df"), F.sort_array(F.collect_list("part")).alias("parts"))
    return Index(
        spark,
        postings,
        _table(terms.repartition(buckets, "token"), folder, "terms", buckets, "token", ["token", "kb"]),
        _table(places.drop("avgdl").coalesce(1), folder, "places", 1, "kb", ["kb", "dl"]),
        _table(stats.coalesce(1), folder, "stats", 1, "kb", ["kb"]),
        folder,
    )


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Which rows differ from the row before; the first does."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return new


def _inverted(block: int, part: int, k1: float, b: float):
    """Blocks of the zones of a sorted partition, a zone or some small ones at a time."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last, twins = [], 0, None, (None, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            zone = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("kb", "depth", "zone")]
            file = [*zone, pc.fill_null(batch.column("doc_id"), 0).to_numpy(), batch.column("dl").to_numpy()]
            runs = np.flatnonzero(_changes(*file))
            twin = np.arange(batch.num_rows) - np.repeat(runs, np.diff(np.append(runs, batch.num_rows)))
            if tuple(x[0] for x in file) == twins[0]:
                twin[: runs[1] if len(runs) > 1 else None] += twins[1]
            twins = tuple(x[-1] for x in file), int(twin[-1]) + 1
            batch = batch.set_column(batch.schema.get_field_index("twin"), "twin", pc.coalesce(batch.column("twin"), pa.array(twin, pa.int64())))
            # A zone is cut as well where it has too many words: copies of one id.
            words = np.cumsum(file[-1], dtype=np.int64)
            starts = np.flatnonzero(_changes(*zone, words // ZONE)).tolist()
            for i, j in zip(starts, [*starts[1:], batch.num_rows]):
                now = tuple(x[i] for x in zone)
                if size >= (ZONE // 4 if now != last else 2 * ZONE):
                    yield from _blocks(held, block, part, k1, b)
                    held, size = [], 0
                held.append(batch.slice(i, j - i))
                size, last = size + int(file[-1][i:j].sum()), now
        if held:
            yield from _blocks(held, block, part, k1, b)

    return f


def _blocks(held: list[pa.RecordBatch], block: int, part: int, k1: float, b: float) -> Iterator[pa.RecordBatch]:
    """Rows of BLOCKS of whole zones' files, which come by zone and doc_id."""
    files = pa.Table.from_batches(held).combine_chunks()
    kb, doc_id, twin = (files[c].chunk(0) for c in ("kb", "doc_id", "twin"))
    depth, zone, place, dl, avgdl = (files[c].to_numpy() for c in ("depth", "zone", "place", "dl", "avgdl"))
    words = pc.split_pattern(files["words"].chunk(0), " ").flatten().dictionary_encode()
    run = np.cumsum(_changes(kb.to_numpy(zero_copy_only=False), depth, zone)) - 1
    # Words by zone and token, of each by file and position.
    owner = np.repeat(np.arange(len(dl), dtype=np.int32), dl)
    at = np.arange(len(owner), dtype=np.int32) - np.repeat((np.cumsum(dl) - dl).astype(np.int32), dl)
    term = run[owner] * len(words.dictionary) + words.indices.to_numpy()
    order = np.argsort(term, kind="stable")
    term, owner, at, words = term[order], owner[order], at[order], words.dictionary
    del order
    starts = np.flatnonzero(_changes(term, owner))
    ends = np.append(starts[1:], len(at))
    steps = np.diff(at, prepend=0)
    steps[starts] = at[starts]
    steps = pa.ListArray.from_arrays(pa.array(np.append(starts, len(at)), pa.int32()), pa.array(steps, pa.int32()))
    # Postings by zone, token and block.
    term, owner, tf = term[starts], owner[starts], ends - starts
    first = np.flatnonzero(_changes(term))
    n = np.diff(np.append(first, len(term)))
    finer = np.repeat(np.ceil(np.log2(np.maximum(n / block, 1))).astype(np.int64), n)
    level = np.minimum(depth[owner] + finer, BITS)
    number = place[owner] >> (BITS - level)
    order = np.argsort((np.repeat(np.arange(len(n)), n) << BITS) | number, kind="stable")
    term, owner, tf, number, level, finer = (x[order] for x in (term, owner, tf, number, level, finer))
    starts = np.flatnonzero(_changes(term, number))
    bounds = pa.array(np.append(starts, len(term)), pa.int32())
    dl, avgdl = dl[owner], avgdl[owner]
    most = np.maximum.reduceat(tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), starts)
    token = words.take(pa.array(term[starts] % len(words)))
    parts = pa.array(np.where(finer[starts] > 0, number[starts] // part, 0)).cast(pa.string())
    lists = [doc_id.take(pa.array(owner)), twin.take(pa.array(owner)), pa.array(tf, pa.int32()), pa.array(dl, pa.int32()), steps.take(pa.array(order))]
    rows = [
        pc.binary_join_element_wise(token, parts, "#"), token, pa.array(level[starts], pa.int32()), pa.array(number[starts], pa.int64()), pa.array(np.diff(np.append(starts, len(term))), pa.int32()),
        pa.array(np.ceil(most * 256) / 256),  # few different numbers are stored in fewer bytes
        *[pa.ListArray.from_arrays(bounds, x) for x in lists], kb.take(pa.array(owner[starts])),
    ]
    out = pa.RecordBatch.from_arrays(rows, names=[c.split()[0] for c in BLOCKS.split(", ")])
    for i in range(0, out.num_rows, 1 << 15):
        yield out.slice(i, 1 << 15)


def phrase_search(index: Index, acl: DataFrame, phrase: list[str]) -> DataFrame:
    """(principal, doc_id, n): how often the words follow each other, in files that the
    principal is granted. A phrase of no words is found nowhere."""
    found = index.lookup(phrase)
    slots = {t: [i for i, x in enumerate(phrase) if x == t] for t in set(phrase)}
    at = reduce(lambda c, t: c.when(F.col("token") == t, F.array(*[F.lit(i) for i in slots[t]])), slots, F.when(F.lit(False), F.array(F.lit(0))))
    blocks = index.blocks(found).join(F.broadcast(acl.select("kb").distinct()), "kb", "left_semi")
    files = blocks.select("kb", "token", F.explode(F.arrays_zip("doc_id", "dl", "twin", "steps")).alias("f"))
    # Positions come back as running sums of their differences; each slot of the phrase moves them to its beginning.
    p = F.aggregate("f.steps", F.array().cast("array<int>"), lambda held, s: F.concat(held, F.array(s + F.coalesce(F.get(held, F.size(held) - 1), F.lit(0)))))
    starts = files.select("kb", "f.doc_id", "f.dl", "f.twin", at.alias("slots"), F.explode(F.array(p)).alias("p"))
    starts = starts.select("kb", "doc_id", "dl", "twin", F.explode("slots").alias("slot"), "p").withColumn("s", F.transform("p", lambda x: x - F.col("slot")))
    whole = starts.groupBy("kb", "doc_id", "dl", "twin").agg(F.collect_list("s").alias("s")).where(F.size("s") == len(phrase))
    both = F.aggregate(F.slice("s", 2, len(phrase)), F.get("s", F.lit(0)), F.array_intersect)
    hits = whole.select("kb", "doc_id", F.size(both).cast("long").alias("n")).where("n > 0")
    return hits.join(acl.select("principal", "kb").distinct(), "kb").select("principal", "doc_id", "n")


@dataclass
class Read:
    """What a search for the best files read: postings scored, and those of its terms."""

    scored: int
    held: int


def best_files(index: Index, acl: DataFrame, terms: list[str], k: int = 5, probe: int = 16) -> tuple[DataFrame, Read]:
    """(principal, doc_id, score, rnk) as BM25 over all files gives them, without scoring
    all, and how many postings that took.

    Quarters of the most frequent term's mean block are cells. A file of a cell scores at most
    the sum, over the terms that occur in the cell, of rarity times ``top`` of the term's
    block. First the cells of each knowledge base with the highest bounds are scored, as many
    as ``probe`` mean blocks have; the k-th best score of a principal then is a threshold, and
    of the other cells only those whose bound reaches the least threshold of the principals
    who may read the knowledge base are scored. Bounds come from the blocks' small columns; of
    rare terms, whose blocks are wider than they have files, from what these files get. At most
    4 ``probe`` cells a knowledge base and k scores a principal come to the driver."""
    grants = acl.select("principal", "kb").distinct()
    seen = {r.kb for r in acl.select("kb").distinct().collect()}  # as many as knowledge bases
    found = [r for r in index.lookup(terms) if r[0] in seen]
    spark = index.spark
    if not found:
        return spark.createDataFrame([], "principal string, doc_id bigint, score double, rnk int"), Read(0, 0)
    stats = {r.kb: r.n for r in spark.table(index.stats).collect()}
    finest = {kb: max(max(0, math.ceil(math.log2(r[2] / BLOCK))) + CELLS for r in found if r[0] == kb) for kb in {r[0] for r in found}}
    rare = [(kb, t, math.log(1 + (stats[kb] - df + 0.5) / (df + 0.5)), finest[kb]) for kb, t, df, _ in found]
    rare = F.broadcast(spark.createDataFrame(rare, "kb string, token string, idf double, finest int"))  # terms times knowledge bases
    blocks = index.blocks(found).join(rare, ["kb", "token"])
    stats_of = F.broadcast(spark.table(index.stats).select("kb", "avgdl"))
    places = spark.table(index.places)
    weight = F.col("f.tf") * (K1 + 1) / (F.col("f.tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    cell = F.expr(f"shiftright(place, {BITS} - finest)").alias("cell")

    def in_cells(rows: DataFrame) -> DataFrame:
        """Files with the cells that they are in."""
        return rows.select("*", "f.doc_id", "f.dl", "f.twin").join(places, ["kb", "dl"]).withColumn("place", _place(F.col("doc_id"), F.col("twin"))).select("*", cell)

    most = (F.col("idf") * F.col("top")).alias("most")
    few = "shiftleft(4L, finest - level) <= n"  # a block's cells, if most have files
    fine = blocks.where("level >= finest").select("kb", "token", F.expr("shiftright(block, level - finest)").alias("cell"), most)
    wide = blocks.where(f"level < finest AND {few}").select("kb", "token", most, F.expr("explode(sequence(shiftleft(block, finest - level), shiftleft(block + 1, finest - level) - 1))").alias("cell"))
    single = in_cells(blocks.where(f"level < finest AND NOT {few}").select("kb", "token", "idf", "finest", F.explode(F.arrays_zip("doc_id", "dl", "twin", "tf")).alias("f")))
    single = single.join(stats_of, "kb").select("kb", "token", "cell", (F.col("idf") * weight).alias("most"))
    both = fine.union(wide.select("kb", "token", "cell", "most")).union(single).groupBy("kb", "token", "cell").agg(F.max("most").alias("most"))
    cells = written_stage(lambda: both.groupBy("kb", "cell").agg(F.sum("most").alias("most")), "cells")

    files = in_cells(blocks.select("kb", "token", "idf", "finest", F.explode(F.arrays_zip("doc_id", "dl", "twin", "tf")).alias("f")))

    def scores(chosen: DataFrame) -> DataFrame:
        hit = files.join(chosen, ["kb", "cell"], "left_semi").join(stats_of, "kb")
        return hit.groupBy("kb", "doc_id", "dl", "twin").agg(F.round(F.sum(F.col("idf") * weight), 6).alias("score"), F.count(F.lit(1)).alias("read"))

    order = Window.partitionBy("kb").orderBy(F.desc("most"), "cell")
    first = cells.withColumn("r", F.row_number().over(order)).where(F.col("r") <= probe << CELLS).select("kb", "cell")
    first = F.broadcast(spark.createDataFrame(first.collect(), "kb string, cell long"))
    tried = written_stage(lambda: scores(first), "tried")
    kth = top(tried.join(grants, "kb"), k).where(F.col("rnk") == k).select("principal", F.col("score").alias("least"))
    # Where a principal has fewer than k files yet, nothing may be left out.
    least = grants.join(kth, "principal", "left").groupBy("kb").agg(F.min(F.coalesce("least", F.lit(-1.0))).alias("least"))
    rest = cells.join(first, ["kb", "cell"], "left_anti").join(least, "kb").where(F.col("most") >= F.col("least") - 2e-6).select("kb", "cell")
    more = written_stage(lambda: scores(rest), "more")
    every = tried.union(more)
    read = Read(every.agg(F.coalesce(F.sum("read"), F.lit(0))).first()[0], sum(df for _, _, df, _ in found))
    return top(every.select("kb", "doc_id", "score").join(grants, "kb"), k), read
