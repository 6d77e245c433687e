"""Byte-level BPE encoding and decoding by higher-order functions.

The corpus is split into words by the tokenizer's own pattern. A fold over each
word's byte array applies the ranked merges: the state holds the ids and the rank
of every adjacent pair, and each step merges the leftmost pair of least rank, as
the public library does. The ranks are a literal map from pairs: each left id has a
displacement, and the rank lies in one array at the displacement plus the right id,
so that a look-up reads one place.

Work per distinct word: word counts over all documents (one aggregation, combined
before its shuffle) give the words that occur more than once, and a histogram of the
counts says from which count on at most ``held_words`` words are left. Those are
folded once and written to the shared folder. Python workers read them, cut the texts
in Arrow batches and put the ids in their places: the ``quick`` most frequent words are
in a dict, the others in arrays sorted by hash. Any word beyond takes the same fold in
place, which for a word that occurs once is the only time. So the bounds decide speed,
never the result, and text is never shuffled. The fold's arrays are copied at each
merge; words of more than ``LONG`` characters, such as a megabyte without a break, are
merged in the Python worker, with a heap.

Nulls: a null text has no ids. Rows are independent: repeated rows, ties and extra
columns stay as they are, whatever their names; the column that the result is put in
is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import contextlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, give_back, let, literal_longs, literal_strings, store, written
from .token_files import PLAIN, plain_pattern

#: Code points of the Unicode property White_Space. Fixed values.
WHITE = r"\t-\r \u0085   -     　"
NO_RANK = 1 << 18
#: Words of more characters are merged in a Python worker.
LONG = 1000
#: Characters of texts that a Python worker encodes at a time.
AT_ONCE = 1 << 20
#: Characters of a plan's text that the driver keeps: the literal tables would fill it.
PLAN_TEXT = 100_000
#: Bits of an id and a start in an entry of the fold; ids in tables have as many.
ID, START = 20, 24


@contextlib.contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Plans are described without their expressions inside: the literal tables' text, some
    megabytes for each use in a plan and each description, would fill the driver."""
    short = {"spark.sql.maxPlanStringLength": str(PLAN_TEXT), "spark.sql.debug.maxToStringFields": "0"}
    before = {k: spark.conf.get(k) for k in short}
    for k, v in short.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def java_pattern(pattern: str) -> str:
    r"""The pattern with \s and \S spelt out, which Java limits to ASCII."""
    return pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pair_ranks(ranks: dict[bytes, int]) -> tuple[array, array]:
    """Every way to join two tokens into a third: left and right id, packed as
    left << 32 | right, and the third's id."""
    pairs, out = array("q"), array("q")
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs.append(a << 32 | b)
                out.append(rank)
    return pairs, out


def displaced(pairs: array, out: array) -> tuple[array, array]:
    """(displacement of each left id, table): the pair (a, b) lies at b plus a's displacement,
    as a << ID | third id, -1 where none lies. The ids with most pairs are placed first, each
    at the first place where all of its pairs are free, from that of the one before if it has as many."""
    keys = np.frombuffer(pairs, np.int64)
    left, right = keys >> 32, keys & 0xFFFFFFFF
    order = np.lexsort((right, left))
    starts = np.flatnonzero(np.r_[True, np.diff(left[order]) != 0])
    rows = np.split(order, starts[1:]) if len(order) else []
    size = 2 * (len(keys) + int(max(left.max(initial=0), right.max(initial=0))) + 1)
    table, at, low = np.full(size, -1), np.zeros(int(left.max(initial=0)) + 1, np.int64), 0
    begin, before = 0, 0
    for row in sorted(rows, key=len, reverse=True):
        b, begin, before = right[row], begin if len(row) == before else low, len(row)
        while True:
            fits = begin + np.flatnonzero(table[begin : begin + 4096] < 0)
            fits = fits[fits + (b[-1] - b[0]) < size]
            for further in b[1:] - b[0]:
                fits = fits[table[fits + further] < 0]
                if not len(fits):
                    break
            if len(fits):
                break
            begin += 4096
            if begin >= size:
                raise ValueError("table too full")
        at[left[row[0]]] = fits[0] - b[0]
        table[fits[0] + (b - b[0])] = left[row] << ID | np.frombuffer(out, np.int64)[row]
        while low < size and table[low] >= 0:
            low += 1
    return array("q", at.tobytes()), array("q", table[: int(np.flatnonzero(table >= 0).max(initial=-1)) + 1].tobytes())


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one long word: the leftmost pair of least rank first, by a heap."""
    n = len(word)
    after, before, ends = [*range(1, n), -1], [*range(-1, n - 1)], [*range(1, n + 1)]
    heap: list[tuple[int, int, int]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0:
            rank = ranks.get(word[i : ends[after[i]]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, ends[after[i]]))

    for i in range(n):
        offer(i)
    while heap:
        _, i, end = heapq.heappop(heap)
        j = after[i] if ends[i] else -1
        if j < 0 or ends[j] != end:
            continue  # one of the two has merged since
        ends[i], ends[j], after[i] = end, 0, after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [ranks[word[i : ends[i]]] for i in range(n) if ends[i]]


class Words:
    """The folded words of a folder: hash, word and ids in the order of hashes, and
    the most frequent ones in a dict."""

    def __init__(self, folder: str, quick: int):
        fs, root = store(folder)
        rows = pyarrow.dataset.dataset(root, filesystem=fs, format="parquet").to_table(columns=["h", "n", "word", "ids"]).sort_by("h").combine_chunks()
        self.hashes = rows["h"].to_numpy()
        self.words, self.ids = (pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in rows[n].chunks)]) for n in ("word", "ids"))
        top = pa.array(np.argsort(-rows["n"].to_numpy(), kind="stable")[:quick])
        self.quick = dict(zip(self.words.take(top).to_pylist(), self.ids.take(top).to_pylist()))
        del rows, top
        give_back()  # a worker keeps its words as long as it lives

    def look_up(self, words: list[str]) -> list[str | None]:
        """ids of words, None where one isn't held."""
        if not words or not len(self.hashes):
            return [None] * len(words)
        # Spark's xxhash64 has the seed 42.
        hashes = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], np.uint64).view(np.int64)
        at = pa.array(np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1))
        same = pc.equal(self.words.take(at), pa.array(words, pa.string()))
        return pc.if_else(same, self.ids.take(at), pa.scalar(None, pa.string())).to_pylist()


#: A Python worker reads a folder and a file of ranks once for all its tasks.
_WORDS: dict[str, Words] = {}
_RANKS: dict[str, dict[bytes, int]] = {}


def _encoder(folder: str, path: str, pattern: str, quick: int):
    """The ids of texts as stretches of text, with the words between them that aren't held."""

    def long(word: str) -> str:
        if path not in _RANKS:
            _RANKS[path] = read_ranks(path)
        return ",".join(map(str, merge(word.encode(), _RANKS[path])))

    def encoded(texts: list[str | None], held: Words, cut) -> Iterator[tuple[list[str], list[str]]]:
        found, rare = [], []
        for text in texts:
            words = cut(text or "")
            found.append(list(map(held.quick.get, words)))
            rare.append([w for w, ids in zip(words, found[-1]) if ids is None])
        flat = [w for ws in rare for w in ws]
        more = iter([long(w) if ids is None and len(w) > LONG else ids for w, ids in zip(flat, held.look_up(flat))])
        for got, words in zip(found, rare):
            rest = []
            if words:
                looked = [next(more) for _ in words]
                rest = [w for w, ids in zip(words, looked) if ids is None]
                fill = iter(looked)
                got = ["=" if ids is None else ids for ids in (next(fill) if ids is None else ids for ids in got)]
            yield ",".join(got).split("="), rest

    @F.arrow_udf("struct<ids array<string>, other array<string>>")
    def encode(texts: pa.Array) -> pa.Array:
        import regex

        if folder not in _WORDS:
            _WORDS.clear()
            _WORDS[folder] = Words(folder, quick)
        every, plain = regex.compile(pattern).findall, re.compile(plain_pattern(pattern)).findall

        def cut(text: str) -> list[str]:  # Python's own re is twice as fast
            return (every if PLAIN.search(text) else plain)(text)

        ends = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)) // AT_ONCE
        starts = [0, *(np.flatnonzero(np.diff(ends)) + 1), len(texts)]
        ids, other = [], []
        for i, j in zip(starts, starts[1:]):
            part = list(zip(*encoded(texts[i:j].to_pylist(), _WORDS[folder], cut))) or [(), ()]
            ids.append(pa.array(part[0], pa.list_(pa.string())))
            other.append(pa.array(part[1], pa.list_(pa.string())))
        return pa.StructArray.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(other)], ["ids", "other"])

    return encode


class ByteBpe:
    """Encoder and decoder for one file of ranks (the file's path is a parameter,
    read on the driver)."""

    def __init__(self, path: str, pattern: str, quick: int = 1 << 17, held_words: int = 1 << 20):
        self.path, self.ranks, self.pattern = path, read_ranks(path), java_pattern(pattern)
        self.quick, self.held_words = quick, held_words
        if max(self.ranks.values()) >= NO_RANK:
            raise ValueError("ids beyond the fold's bits")
        self._left, self._pairs = map(literal_longs, displaced(*pair_ranks(self.ranks)))
        # The entry of a byte before another one, and of a word's last byte, each without its start.
        self._byte_pairs = literal_longs(self.ranks.get(bytes([a, b]), NO_RANK) << ID + START | self.ranks[bytes([a])] for a in range(256) for b in range(256))
        self._last = literal_longs(NO_RANK << ID + START | self.ranks[bytes([b])] for b in range(256))
        pieces = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            pieces[rank] = token
        # A byte is the character of its number, up to U+00FF; U+0100 parts the pieces.
        self._pieces = literal_strings((p.decode("latin-1") for p in pieces), "\u0100")

    def _rank(self, left: Column, table: Column, a: Column, b: Column) -> Column:
        """The rank of the pair (a, b), NO_RANK if it doesn't join."""
        found = F.get(table, (F.get(left, a.cast("int")) + b).cast("int"))
        return let(found, lambda x: F.when(F.shiftright(x, ID) == a, x.bitwiseAND((1 << ID) - 1)).otherwise(F.lit(NO_RANK).cast("long")))

    def fold(self, word: Column) -> Column:
        """The ids of one word that isn't empty, array<bigint>.

        The state is one array with an entry for each token: the rank of its pair
        with the next one, the byte at which it starts, and its id, packed so that
        the least entry is the leftmost pair of least rank. An entry at either end
        has an id that joins with nothing, so that every pair has neighbours."""
        edge, none = (1 << ID) - 1, NO_RANK << ID + START

        def entry(rank: Column, place: Column) -> Column:  # place: start and id
            return F.shiftleft(rank, ID + START).bitwiseOR(place)

        def token(x: Column) -> Column:
            return x.bitwiseAND(edge)

        def begin(at: Column) -> Column:  # the word's bytes
            def one(a: Column, k: Column) -> Column:
                first = F.coalesce(F.get(self._byte_pairs, a * 256 + F.get(at, k + 1)), F.get(self._last, a))
                return first.bitwiseOR(F.shiftleft(k.cast("long"), ID))

            return F.concat(F.array(F.lit(none | edge)), F.transform(at, one), F.array(F.lit(none | edge)))

        def folded(left: Column, table: Column) -> Column:
            def step(s: Column, _: Column) -> Column:
                def merge(least: Column) -> Column:
                    def at(p: Column) -> Column:  # the pair is entries p and p + 1, from 1
                        def joined(before: Column, m: Column) -> Column:
                            one = entry(self._rank(left, table, token(before), m), before.bitwiseAND((1 << ID + START) - 1))
                            two = entry(self._rank(left, table, m, token(F.get(s, p + 1))), least.bitwiseAND((1 << START) - 1 << ID).bitwiseOR(m))
                            return F.array(one, two)

                        pair = joined(F.get(s, p - 2), F.shiftright(least, ID + START))
                        return F.concat(F.slice(s, F.lit(1), p - 2), pair, F.slice(s, p + 2, F.lit(1 << 30)))

                    return F.when(least >= none, s).otherwise(let(F.array_position(s, least).cast("int"), at))

                return let(F.array_min(s), merge)

            def run(at: Column) -> Column:
                return let(F.aggregate(F.slice(at, 2, 1 << 30), begin(at), step), lambda x: F.transform(F.slice(x, F.lit(2), F.size(x) - 2), token))

            latin = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
            return let(F.transform(F.split(latin, ""), lambda c: F.ascii(c)), run)

        return let(self._left, lambda left: let(self._pairs, lambda table: folded(left, table)))

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def dictionary(self, docs: DataFrame, text_col: str) -> str:
        """The folder of frequent words (word, count, ids as text, hash)."""
        words = docs.select(F.explode(self.words(F.col(f"`{text_col}`"))).alias("word")).where(F.length("word") <= LONG)
        words = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        counted = written(words.withColumn("level", F.floor(F.log2("n") * 8).cast("int")), "words")  # at most 512 levels
        least, total = 1 << 30, 0
        for level, n in sorted(((r.level, r["count"]) for r in counted.groupBy("level").count().collect()), reverse=True):
            total += n
            if total > self.held_words:
                break
            least = level
        folded = counted.where(F.col("level") >= least).select("word", "n", self.fold_text(F.col("word")).alias("ids"), F.xxhash64("word").alias("h"))
        with short_plans(docs.sparkSession):
            folded = written(folded, "folded")
        discard(counted)
        return folded.written_to

    def fold_text(self, word: Column) -> Column:
        return F.array_join(self.fold(word).cast("array<string>"), ",")

    def encode_text(self, docs: DataFrame, text_col: str = "text", out: str = "ids_text") -> DataFrame:
        """docs with their ids as text: decimal, joined by commas; '' for none."""
        docs.sparkSession.conf.set("spark.sql.maxPlanStringLength", PLAN_TEXT)
        encode = _encoder(self.dictionary(docs, text_col), self.path, self.pattern, self.quick)
        # Whole rows travel as one column, so that no name of theirs can clash. The
        # generator keeps Catalyst from folding words once for each use of the result.
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
        parts = docs.select(row, encode(F.col(f"`{text_col}`")).alias("x"))
        ends = F.concat(F.transform("x.other", self.fold_text), F.array(F.lit("")))
        text = F.explode(F.array(F.array_join(F.zip_with("x.ids", ends, lambda x, y: F.concat(x, y)), "")))
        names = [c for c in docs.columns if c.lower() != out.lower()]
        return parts.select("row", text.alias("text")).select(*[F.col(f"row.`{c}`").alias(c) for c in names], F.col("text").alias(out))

    def encode(self, docs: DataFrame, text_col: str = "text", out: str = "ids") -> DataFrame:
        """docs with an array<int> of ids."""
        return self.encode_text(docs, text_col, out).withColumn(out, parse_ids(F.col(f"`{out}`")))

    def decode(self, ids: Column) -> Column:
        """The bytes of an array of ids: their pieces, concatenated, each byte being a
        character of Latin-1 while Spark joins them in one pass."""
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(self._pieces, i.cast("int"))), ""), "ISO-8859-1")

    def decode_text(self, ids_text: Column) -> Column:
        """decode() of ids as text."""
        pieces = F.transform(F.split(ids_text, ","), lambda i: F.get(self._pieces, i.cast("int")))
        return F.encode(F.when(ids_text == "", F.lit("")).otherwise(F.array_join(pieces, "")), "ISO-8859-1")


def parse_ids(ids_text: Column) -> Column:
    return F.when(ids_text == "", F.array().cast("array<int>")).otherwise(F.split(ids_text, ",").cast("array<int>"))


def count_ids(ids_text: Column) -> Column:
    return F.when(ids_text == "", F.lit(0)).otherwise(F.length(ids_text) - F.length(F.replace(ids_text, F.lit(","), F.lit(""))) + 1).cast("long")


def digest_query(spark: SparkSession, docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """What is asked of op7: digests of ids and of the decoded bytes."""
    bpe = ByteBpe(ranks_path, pattern)
    encoded = bpe.encode_text(docs.select("doc_id", "text"))
    return encoded.select(
        "doc_id",
        count_ids(F.col("ids_text")).alias("n_tokens"),
        F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(bpe.decode_text(F.col("ids_text")), 256).alias("decoded_sha256"),
    )
