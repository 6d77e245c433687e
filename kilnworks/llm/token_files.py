"""Token files compressed by Re-Pair grammars.

Documents are dealt into consecutive ranges of doc_id (bounds are quantiles of equal
bytes), each range is encoded and written by one task in ascending doc_id order, in
shards of about ``shard_tokens`` ids. A shard's ids are compressed by Re-Pair, in
rounds: every pair of neighbouring symbols that is at least as frequent as the two
pairs it overlaps with gives way to a nonterminal, until no pair is left that occurs
``least`` times, from where on a rule takes more room than it saves. In a run of equal
symbols pairs are taken from the left. Pairs never cross the end of a document, so
each one decodes alone.

File: b"KWRP", version, counts, then little-endian arrays: rules (left, right) and
expansion length of every rule, 32 bits each; documents' doc_ids, first symbols and id
counts, 64 bits each; the symbols, 24 bits each. Random access reads by byte range: the
header and the rules once, then a document's offsets and its own symbols. A single id
is found by skipping symbols by their expansion lengths; only what covers it is
expanded.

A shard's place among all ids is the sum of the shards before it: sums of ranges (two
per partition at most), and within a range a window over its shards. Lost attempts
leave files that the index doesn't name.

Texts are encoded as the library does it without adding special tokens: a special
token's string in a text is its id. Words are cut by the tokenizer's own pattern, and
each one is encoded once per worker and remembered; texts with special tokens' strings
or characters beyond ``PLAIN`` go to the library whole.

Nulls: a null text is empty and has the end id only. Rows without doc_id come last;
rows that share a doc_id, or have none, keep the order of their texts' hashes. Repeated
rows are written each. Extra columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import io
import json
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RangeBuckets, partitions, shared_folder, store, written, written_stage

MAGIC, VERSION = b"KWRP", 2
#: Odd, so that products are different modulo 2 ** 32.
SCATTER = 2654435761
#: Bins that pairs are counted in at first, and ids of a rule that a reader holds expanded.
BINS, SHORT = 1 << 22, 64
HEADER = "<4sIIIQQ"
#: Ranges of characters in which words are cut here: Latin, Greek, Cyrillic, punctuation.
SPANS = [(0x00, 0x1B), (0x20, 0x24F), (0x370, 0x377), (0x391, 0x3C9), (0x410, 0x44F), (0x2010, 0x2027), (0x20AC, 0x20AC)]
PLAIN = re.compile("[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in SPANS) + "]")

#: The pre-tokenizer that splits by the pattern and spells bytes, and how it spells them.
BYTES_ONLY = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELT = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in SHOWN)}


def spelt(word: str) -> str:
    """The word's bytes as ByteLevel spells them; of most words only blanks are spelt."""
    if word.isascii() and word.isprintable():
        return word.replace(" ", chr(SPELT[32]))
    return word.encode().decode("latin-1").translate(SPELT)


def plain_pattern(pattern: str) -> str:
    r"""The pattern with \p{L} and \p{N} spelt out over SPANS, for Python's own re."""
    import regex

    every = "".join(chr(c) for a, b in SPANS for c in range(a, b + 1))
    out, inside, at = [], False, 0
    while at < len(pattern):
        piece = pattern[at : at + (5 if pattern.startswith((r"\p{L}", r"\p{N}"), at) else 2 if pattern[at] == "\\" else 1)]
        at += len(piece)
        if len(piece) == 5:
            members = "".join(re.escape(c) for c in regex.findall(piece, every))
            piece = members if inside else f"[{members}]"
        elif piece in "[]":
            inside = piece == "["
        out.append(piece)
    return "".join(out)


class Encoder:
    """ids of texts by the tokenizers library; remembers words up to a bound."""

    def __init__(self, path: str, pattern: str, bound: int = 600_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added)) if added else "(?!)")
        self.find, self.known, self.bound = re.compile(plain_pattern(pattern)).findall, {}, bound
        own = json.loads(self.library.to_str())
        steps = own["normalizer"], own["post_processor"], own["truncation"], own["padding"], own["model"]["dropout"]
        self.bare = own["model"]["type"] == "BPE" and not any(steps) and own["pre_tokenizer"] == BYTES_ONLY
        self.tokenize = self.library.model.tokenize

    def word_ids(self, words: list[str]) -> Iterator[list[int]]:
        """ids of words. Where the library does no more with a word than to spell its bytes
        for the model, its model is called at once, for a quarter of the time."""
        if self.bare:
            return ([x.id for x in self.tokenize(spelt(w))] for w in words)
        return (e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False))

    def __call__(self, text: str) -> np.ndarray:
        if PLAIN.search(text) or self.special.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)
        words, known = self.find(text), self.known
        if len(known) > self.bound:
            known.clear()
        try:
            return np.frombuffer(b"".join([known[w] for w in words]), np.int32)
        except KeyError:
            new = list(set(words).difference(known))
            for w, ids in zip(new, self.word_ids(new)):
                known[w] = array("i", ids).tobytes()
            return np.frombuffer(b"".join([known[w] for w in words]), np.int32)


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker, so that its tasks share the words that it knows."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def repair(ids: np.ndarray, stops: np.ndarray, first: int, least: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, starts, rules): ids with frequent pairs replaced; stops are the
    documents' ends in ids, starts their first symbols; rule i is symbol first + i."""
    rules = [np.zeros((0, 2), np.int32)]
    n_rules = 0
    last = np.zeros(len(ids), bool)
    last[stops - 1] = True
    x = ids.astype(np.int32)
    live = np.ones(len(x), bool)  # places whose pair may be frequent: it was, or one of its symbols is new
    while len(x) > 1:
        at = np.flatnonzero(live[:-1] & ~last[:-1])
        keys = x[at].astype(np.int64) << 32 | x[at + 1]
        # A bin of pairs is at least as frequent as each of them: most rare pairs go before they are told apart.
        bins = (keys ^ keys >> 32) * SCATTER >> 8 & BINS - 1
        kept = np.bincount(bins, minlength=BINS)[bins] >= least
        live[at[~kept]] = False
        at = at[kept]
        codes, pairs = pd.factorize(keys[kept])
        times = np.bincount(codes, minlength=len(pairs))
        frequent = times >= least
        kept = frequent[codes]
        live[at[~kept]] = False
        at, codes = at[kept], codes[kept]
        # A pair's rank: by frequency, then by a scattered number of its own, so that only equal pairs
        # tie, and a passage whose pairs are equally frequent shrinks in many places at once.
        rank = (times << 32 | np.arange(len(pairs)) * SCATTER & 0xFFFFFFFF)[codes]
        apart = np.diff(at) != 1
        best = np.ones(len(at), bool)
        best[1:] &= apart | (rank[1:] >= rank[:-1])
        best[:-1] &= apart | (rank[:-1] >= rank[1:])
        at, codes = at[best], codes[best]
        # Neighbours that are both best are one pair in a run of equal symbols: every second one, from the left.
        fresh = np.r_[True, np.diff(at) != 1]
        place = np.arange(len(at))
        second = (place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0
        at, codes = at[second], codes[second]
        if not len(at):
            break
        enough = np.bincount(codes, minlength=len(pairs)) >= least
        if not enough.any():  # pairs that overlap too often with themselves make way for others
            live[at] = False
            continue
        kept = enough[codes]
        at, chosen = at[kept], pairs[enough]
        x[at] = first + n_rules + (np.cumsum(enough) - 1)[codes[kept]]
        last[at] = last[at + 1]
        live[at] = live[np.maximum(at - 1, 0)] = True
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        x, last, live = x[keep], last[keep], live[keep]
        rules.append(np.stack([chosen >> 32, chosen & 0xFFFFFFFF], 1).astype(np.int32))
        n_rules += len(chosen)
    ends = np.flatnonzero(last) + 1
    return x, np.r_[0, ends[:-1]].astype(np.int64), np.concatenate(rules)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Rules only name rules before them."""
    out: list[int] = []
    for a, b in rules.tolist():
        out.append((1 if a < first else out[a - first]) + (1 if b < first else out[b - first]))
    return np.array(out, np.int32)


class Shard:
    """A file's documents; read(offset, length) gives bytes of it."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, version, self.first, n_rules, self.n_docs, self.n_symbols = struct.unpack(HEADER, read(0, struct.calcsize(HEADER)))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file")
        self.at, at = {}, struct.calcsize(HEADER)
        for name, size in (("rules", 8 * n_rules), ("lengths", 4 * n_rules), ("doc_ids", 8 * self.n_docs), ("starts", 8 * self.n_docs), ("counts", 8 * self.n_docs), ("symbols", 3 * self.n_symbols)):
            self.at[name] = at
            at += size
        grammar = read(self.at["rules"], 12 * n_rules)
        self.rules = np.frombuffer(grammar, "<i4", 2 * n_rules).reshape(-1, 2)
        self.lengths = np.frombuffer(grammar, "<i4", n_rules, 8 * n_rules)
        self.held = None

    def _longs(self, name: str, i: int, n: int) -> np.ndarray:
        return np.frombuffer(self.read(self.at[name] + 8 * i, 8 * n), "<i8")

    def _symbols(self, start: int, end: int) -> np.ndarray:
        data = np.frombuffer(self.read(self.at["symbols"] + 3 * start, 3 * (end - start)), np.uint8).reshape(-1, 3).astype(np.int32)
        return data[:, 0] | data[:, 1] << 8 | data[:, 2] << 16

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Long rules all at once, step by step; then short ones, from their expansions."""
        if self.held is None:
            return self._expand(symbols, 0)
        x = self._expand(symbols, SHORT)
        starts, ids = self.held
        rule = x >= self.first
        n, begin = np.ones(len(x), np.int64), np.zeros(len(x), np.int64)
        n[rule], begin[rule] = self.lengths[x[rule] - self.first], starts[x[rule] - self.first]
        ends = np.cumsum(n)
        out = ids[np.repeat(begin - (ends - n), n) + np.arange(n.sum())] if rule.any() else x.copy()
        out[(ends - n)[~rule]] = x[~rule]
        return out

    def _expand(self, symbols: np.ndarray, short: int) -> np.ndarray:
        """Rules of more than short ids: as many steps as the grammar is deep."""
        long = np.r_[False, self.lengths > short]
        while (rule := long[np.maximum(symbols - (self.first - 1), 0)]).any():
            n = 1 + rule
            out = np.repeat(symbols, n)
            at = (np.cumsum(n) - n)[rule]
            sides = self.rules[symbols[rule] - self.first]
            out[at], out[at + 1] = sides[:, 0], sides[:, 1]
            symbols = out
        return symbols

    def documents(self, batch: int = 256) -> Iterator[tuple[int, np.ndarray]]:
        """(doc_id, ids) of all documents, in order."""
        if self.held is None:
            lengths = np.where(self.lengths > SHORT, 0, self.lengths).astype(np.int64)
            self.held = np.cumsum(lengths) - lengths, self._expand(self.first + np.flatnonzero(lengths).astype(np.int32), 0)
        for i in range(0, self.n_docs, batch):
            n = min(batch, self.n_docs - i)
            counts = self._longs("counts", i, n)
            ids = self.expand(self._symbols(*self._span(i, n)))
            yield from zip(self._longs("doc_ids", i, n).tolist(), np.split(ids, np.cumsum(counts)[:-1]))

    def _span(self, i: int, n: int) -> tuple[int, int]:
        starts = self._longs("starts", i, min(n + 1, self.n_docs - i)).tolist()
        return starts[0], starts[n] if len(starts) > n else self.n_symbols

    def document(self, i: int) -> np.ndarray:
        return self.expand(self._symbols(*self._span(i, 1)))

    def token(self, i: int, k: int) -> int:
        """The k-th id of the i-th document, without expanding the rest."""
        symbols = self._symbols(*self._span(i, 1))
        n = np.ones(len(symbols), np.int64)
        rule = symbols >= self.first
        n[rule] = self.lengths[symbols[rule] - self.first]
        ends = np.cumsum(n)
        s = int(np.searchsorted(ends, k, "right"))
        k -= int(ends[s] - n[s])
        s = int(symbols[s])
        while s >= self.first:
            a, b = self.rules[s - self.first].tolist()
            width = 1 if a < self.first else int(self.lengths[a - self.first])
            s, k = (a, k) if k < width else (b, k - width)
        return s


def pack(ids: np.ndarray, counts: list[int], doc_ids: list[int], first: int, least: int) -> bytes:
    symbols, starts, rules = repair(ids, np.cumsum(counts), first, least)
    if first + len(rules) > 1 << 24:
        raise ValueError("a shard's symbols must fit 24 bits: write smaller shards")
    out = io.BytesIO()
    out.write(struct.pack(HEADER, MAGIC, VERSION, first, len(rules), len(doc_ids), len(symbols)))
    for a, kind in ((rules, "<i4"), (expansion_lengths(rules, first), "<i4"), (np.array(doc_ids, np.int64), "<i8"), (starts, "<i8"), (np.array(counts, np.int64), "<i8")):
        out.write(a.astype(kind).tobytes())
    out.write(symbols.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes())
    return out.getvalue()


NO_ID = -(1 << 63)
SHARDS = "file string, bucket int, part int, n_docs long, n_tokens long, n_symbols long, n_bytes long"


def _writer(folder: str, path: str, pattern: str, end_id: int, first: int, least: int, shard_tokens: int):
    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path, pattern)
        fs, root = store(folder)
        fs.create_dir(root, recursive=True)
        end = np.array([end_id], np.int32)
        ids, counts, doc_ids, size, part, bucket = [], [], [], 0, 0, None

        def flush() -> pd.DataFrame:
            name, whole = f"{uuid.uuid4().hex}.kwrp", np.concatenate(ids)
            ids.clear()
            with fs.open_output_stream(f"{root}/{name}") as out:
                out.write(data := pack(whole, counts, doc_ids, first, least))
            row = pd.DataFrame([(f"{folder}/{name}", bucket, part, len(counts), sum(counts), struct.unpack_from(HEADER, data)[5], len(data))], columns=[c.split()[0] for c in SHARDS.split(", ")])
            counts.clear(), doc_ids.clear()
            return row

        for frame in batches:
            for b, doc_id, text in zip(frame["bucket"].tolist(), frame["doc_id"], frame["text"]):
                if counts and (b != bucket or size >= shard_tokens):
                    yield flush()
                    part, size = (part + 1 if b == bucket else 0), 0
                elif b != bucket:
                    part, size = 0, 0
                bucket = b
                got = np.concatenate([encode(text or ""), end])
                ids.append(got)
                counts.append(len(got))
                doc_ids.append(NO_ID if pd.isna(doc_id) else int(doc_id))
                size += len(got)
        if counts:
            yield flush()

    return f


def write(docs: DataFrame, path: str, pattern: str, end_id: int = 2, first: int = 1 << 20, least: int = 5, shard_tokens: int = 4_000_000, folder: str | None = None) -> DataFrame:
    """Writes token files and returns the index of shards, with the place of each
    one's first id among all ids. ids below ``first`` are the tokenizer's."""
    folder = folder or shared_folder(docs.sparkSession, "tokens")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ranges = RangeBuckets(docs, "doc_id", partitions(docs.sparkSession), weight=F.octet_length("text"))
    z = F.xxhash64("text")
    dealt = ranges.dealt(docs.withColumn("bucket", ranges.bucket(z)), "bucket")
    dealt = dealt.sortWithinPartitions("bucket", F.asc_nulls_last("doc_id"), z).select("bucket", "doc_id", "text")
    shards = written(dealt.mapInPandas(_writer(folder, path, pattern, end_id, first, least, shard_tokens), SHARDS), "shards")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges = shards.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))  # two per partition at most
    ranges = ranges.select("bucket", F.coalesce(F.sum("n").over(before(Window.orderBy("bucket"))), F.lit(0)).alias("_before"))
    inside = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("bucket").orderBy("part"))), F.lit(0))
    return shards.withColumn("start", inside).join(F.broadcast(ranges), "bucket").withColumn("start", F.col("start") + F.col("_before")).drop("_before")


def ranged(file) -> Callable[[int, int], bytes]:
    """Byte ranges of an open file."""

    def read(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return read


def _reader(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "start", "n_tokens", "ids"]
    for frame in batches:
        for name, start in zip(frame["file"], frame["start"]):
            fs, path = store(name)
            with fs.open_input_file(path) as file:
                at, rows = int(start), []
                for doc_id, ids in Shard(ranged(file)).documents():
                    rows.append((None if doc_id == NO_ID else doc_id, at, len(ids), ids))
                    at += len(ids)
                    if len(rows) == 256:
                        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files."""
    n = partitions(shards.sparkSession)
    return shards.select("file", "start").repartition(n, "file").mapInPandas(_reader, "doc_id long, start long, n_tokens long, ids array<int>")


def digest_query(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """What is asked of op2, from the files, which go then."""
    return written_stage(lambda: _digests(docs, path, pattern), "token-digests")


def _digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    shards = write(docs, path, pattern)

    def crcs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _reader(batches):
            frame["ids_crc32"] = [zlib.crc32(np.asarray(x).astype("<u4").tobytes()) for x in frame["ids"]]
            yield frame[["doc_id", "start", "n_tokens", "ids_crc32"]]

    n = partitions(shards.sparkSession)
    return shards.select("file", "start").repartition(n, "file").mapInPandas(crcs, "doc_id long, start long, n_tokens long, ids_crc32 long")
