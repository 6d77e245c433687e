"""Exact n-gram Jaccard join by PartEnum signatures (Arasu et al., 2006).

A document is its set of hashed word n-grams. Sets whose Jaccard similarity is at
least s have sizes within one factor of each other, so sizes fall into bands and each
set signs for its own band and the next. Two such sets of a band differ in at most
k items; the item domain is cut into n1 partitions, at most k / (k2 + 1) of which hold
more than k2 differing items, and each into ``fine`` parts, of which fine - k2 agree
in any other partition: every subset of that many parts is one signature. A band's k2 and
fine are those with the fewest signatures whose subsets have ``ITEMS`` items on average
in its largest sets, or else the most items: at a high similarity single parts of
halved partitions do, at a low one larger subsets of more parts. Sets of a band with
k = 0 are equal and have one signature.

A part without items would sign alike for unrelated sets, so a subset without items
doesn't sign. There are a twelfth more partitions than the bound asks for (a sixth where
single parts sign); a set with more than k / (k2 + 1) partitions in which every subset has
items, or with more than k parts that have items where those sign, shares a signature
with every set that it links to. A set with fewer also signs by other hashes, where the
same holds, and after ``LEVELS`` of them by all subsets, empty ones too: no link is lost.

Equal sets are one class from the start. A class signs once for so many different sets
as a task remembers (a bounded number), and of the sets of a batch that share a signature
those that link to the first one leave it to that one. So a signature that a third of all
sets have, near copies of a form letter say, is one row per batch in the shuffle. Sets with
one signature mostly share a stock phrase and no more, so they are sieved before any text
moves: each set has an odd sketch (Mitzenmacher et al., 2014), at least twice as many bits
as items, of which each item flips one. Sketches differ in no more bits than sets in items,
so two sets that link are never sieved out; a set's ``reach`` adds what it lies from those
that left their signatures to it. Of signatures that the same rows have (by number, ends and
128 bits) one is enough. Its rows are dealt into blocks of bounded size,
each pair of blocks a unit of work that writes a forest of the pairs that pass. These forests
and the links found within batches give candidate components, and each component's
classes are compared exactly, by postings of their items, in blocks of bounded size. At
first all blocks meet the component's leading one only. What that links needs no further
comparison within itself: of the groups known by then the largest one's blocks meet
only the blocks of the rest, and the rest's meet each other, each pair of blocks one unit
of work. So a huge group of near copies is neither gathered in one task nor written out
as pairs, and its texts move as often as the rest has blocks. Links stay whole: each
two classes of a candidate component are compared, or known to be connected already;
only a spanning forest is written.

Null or wordless texts have an empty set and no link. doc_id may be null or repeated:
a document is a doc_id and a text, and is compared by its own text; a component's id is its least doc_id, or null where none has one. A component that rows
without doc_id connect is connected. Ties and repeated rows are equal sets. Extra
columns are ignored by ``join`` and kept by ``keep_one``. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, give_back, partitions, runs, written, written_stage

U = np.uint64
A1, A2, A3 = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Shingler:
    """Sets of 64-bit hashes of word n-grams; remembers the hashes of words, up to a
    bound."""

    def __init__(self, n: int, bound: int = 1_000_000):
        self.n, self.bound, self.known = n, bound, {}

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, U)
        known = self.known
        if len(known) > self.bound:
            known.clear()
        try:
            ids = [known[w] for w in words]
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            ids = [known[w] for w in words]
        h = np.array(ids, U)
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, U(n))
        for j in range(n):
            out = _mix(out * A2 + h[j : len(h) - n + 1 + j])
        return np.unique(out)


class Bands:
    def __init__(self, similarity: tuple[int, int]):
        self.num, self.den, self.ends, self.known = *similarity, [1], {}

    def of(self, size: int) -> int:
        while self.ends[-1] < size:
            self.ends.append(max(self.ends[-1] + 1, (self.ends[-1] + 1) * self.den // self.num))
        return int(np.searchsorted(self.ends, size))

    def partitions(self, b: int) -> tuple[int, int, int, int]:
        """chosen() of band b."""
        if b not in self.known:
            self.known[b] = chosen(self.most(b), self.ends[b])
        return self.known[b]

    def most(self, b: int) -> int:
        """Items in which two sets that link, of band b or b and the one below, differ at most."""
        while len(self.ends) <= b:
            self.of(self.ends[-1] + 1)
        return (self.den - self.num) * 2 * self.ends[b] // (self.den + self.num)


LEVELS = 5
#: Items that a signature's subset has on average, and (k2, fine) to choose from.
ITEMS = 3
CHOICES = [(k2, k2 + more) for k2 in range(1, 5) for more in range(1, 4)]


def chosen(k: int, size: int) -> tuple[int, int, int, int]:
    """(n1, k2, fine, spoilt) for sets of so many items that differ in k at most; n1 with
    the spare partitions, spoilt being the parts (where single parts sign) or partitions
    that differing items can spoil."""
    found = []
    for k2, fine in CHOICES:
        spoilt = k if fine - k2 == 1 else k // (k2 + 1)
        n1 = -(-(spoilt + 1 + spoilt // 6) // fine) if fine - k2 == 1 else spoilt + 1 + spoilt // 12
        items = size / n1 * (fine - k2) / fine
        found.append((items < ITEMS, n1 * comb(fine, k2) if items >= ITEMS else -items, n1, k2, fine, spoilt))
    return min(found)[2:]


def signatures(items: np.ndarray, band: Bands) -> np.ndarray:
    """All signatures of one set of hashes."""
    out = []
    b = band.of(len(items))
    for c in (b, b + 1):
        k = band.most(c)
        if not k:  # sets of this band that link are equal
            out.append(_signed(items, c, 1, 0, 1, 0)[0])
            continue
        n1, k2, fine, spoilt = band.partitions(c)
        for level in range(LEVELS + 1):
            got, full = _signed(items, c, n1, k2, fine, level)
            out.append(got)
            if full > spoilt:
                break
    return np.unique(np.concatenate(out))


def _signed(items: np.ndarray, c: int, n1: int, k2: int, fine: int, level: int) -> tuple[np.ndarray, int]:
    """Signatures by one partitioning of the domain, without those of no item, and the
    number of partitions that lack none, or of parts with items where single ones sign."""
    salted = _mix(items + A1 * np.array([level + 1], U))
    cells = ((salted >> U(32)) * U(n1 * fine) >> U(32)).astype(np.int64)
    sums = _sums(cells, salted * A3 | U(1), n1 * fine).reshape(n1, fine)
    count = np.bincount(cells, minlength=n1 * fine).reshape(n1, fine)
    place = np.arange(n1, dtype=U) * U(1 << 20) + U((c << 40) + level)
    out, whole = [], np.ones(n1, bool)
    for i, chosen in enumerate(combinations(range(fine), fine - k2)):
        mixed = np.zeros(n1, U)
        for j in chosen:
            mixed = _mix(mixed * A2 + sums[:, j] + U(j))
        got = _mix(mixed ^ _mix(place + A3 * np.array([i], U)))
        full = count[:, list(chosen)].sum(axis=1) > 0
        whole &= full
        out.append(got if level == LEVELS else got[full])
    return np.concatenate(out), int((count > 0).sum() if fine - k2 == 1 else whole.sum())


def _sums(cells: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(cells, kind="stable")
    at = cells[order]
    starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    out = np.zeros(n, U)
    out[at[starts]] = np.add.reduceat(values[order], starts)
    return out


#: Classes that a task remembers to have signed, and rows that it signs at a time.
REMEMBERED, AT_ONCE = 1 << 20, 2048


def _features(n: int, similarity: tuple[int, int]):
    """Each row's number i, set size, set hash, odd sketch, reach, the signatures that it
    takes along, and the rows of its piece of a batch that took others of its signatures along."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle, band, seen = Shingler(n), Bands(similarity), set()
        none = np.zeros(0, np.int64)
        i = TaskContext.get().partitionId() << 33
        for frame in (b.iloc[k : k + AT_ONCE] for b in batches for k in range(0, len(b), AT_ONCE)):
            rows, signed, sets = [], [], []
            if len(seen) > REMEMBERED:
                seen.clear()
            for doc_id, text, t1, t2 in zip(*(frame[c].tolist() for c in ("doc_id", "text", "t1", "t2"))):
                s = shingle(text)
                h1, h2 = (int((_mix(s * a)).sum(dtype=U).astype(np.int64)) for a in (A1, A2))
                new = len(s) and (h1, h2) not in seen
                seen.add((h1, h2))
                rows.append((i, doc_id, t1, t2, len(s), h1, h2, odd_sketch(s) if new else b""))
                sets.append(s)
                signed.append(signatures(s, band).astype(np.int64) if new else none)
                i += 1
            out = pd.DataFrame(rows, columns=["i", "doc_id", "t1", "t2", "n", "h1", "h2", "odd"]).astype({"doc_id": "Int64"})
            leaders = Leaders(sets, *similarity)
            out["sig"], out["near"] = _taken(signed, out["i"].to_numpy(), leaders)
            out["reach"] = leaders.reach()
            del rows, signed, sets, leaders
            yield out
            del out
            give_back()

    return f


def odd_sketch(items: np.ndarray) -> bytes:
    """Bits that the items flip, at least twice as many as items: a power of two, and 64 at
    least. The halves' exclusive or is the sketch of half the size."""
    size = max(64, 1 << int(2 * len(items) - 1).bit_length())
    return np.packbits((np.bincount((items & U(size - 1)).astype(np.int64), minlength=size) & 1).astype(np.uint8)).tobytes()


class Leaders:
    """Whether sets link to others of their batch that have a signature of theirs already."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        self.n = np.array([len(s) for s in sets], np.int64)
        self.largest, self.away = self.n.copy(), np.zeros(len(sets), np.int64)

    def __call__(self, a: int, b: int) -> bool:
        n, num, den = self.n, self.num, self.den
        if den * min(n[a], n[b]) < num * max(n[a], n[b]):
            return False
        both = len(np.intersect1d(self.sets[a], self.sets[b], assume_unique=True))
        if den * both < num * (n[a] + n[b] - both):
            return False
        self.largest[a], self.away[a] = max(self.largest[a], n[b]), max(self.away[a], n[a] + n[b] - 2 * both)
        return True

    def reach(self) -> np.ndarray:
        """If x or a set that it leads links to y or one that y leads, then (den + num) times
        the items in which x and y differ is at most the sum of their reaches."""
        return (self.den - self.num) * self.largest + (self.den + self.num) * self.away


def _taken(signed: list[np.ndarray], i: np.ndarray, follows=None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By row, the signatures that no row before has, and the first rows that have the others;
    those that a row has of a first row that it doesn't follow it takes along as well."""
    sizes = np.array([len(s) for s in signed])
    flat, owner = np.concatenate(signed), np.repeat(np.arange(len(signed)), sizes)
    order = np.argsort(flat, kind="stable")
    new = np.ones(len(flat), bool)
    new[1:] = flat[order[1:]] != flat[order[:-1]]
    first = np.empty(len(flat), np.int64)
    first[order] = owner[order[np.maximum.accumulate(np.where(new, np.arange(len(flat)), 0))]]
    own, at = first == owner, np.r_[0, np.cumsum(sizes)]
    if follows is not None and not own.all():
        pairs, which = np.unique(first[~own] * len(signed) + owner[~own], return_inverse=True)
        own[~own] = ~np.array([follows(p // len(signed), p % len(signed)) for p in pairs.tolist()])[which]
    parts = [slice(a, b) for a, b in zip(at, at[1:])]
    return [flat[p][own[p]] for p in parts], [i[np.unique(first[p][~own[p]])] for p in parts]


#: Rows of a block of one signature.
ROWS = 2048


def _plausible(num: int, den: int):
    """Of a unit of work's rows, one or two blocks of a signature, a forest (a, b) of the
    pairs that their sketches allow to link."""

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for i, reach, block, odd in _units(batches):
            if len(i) == 2:  # most units
                if (den + num) * _apart(*odd) <= reach[0] + reach[1]:
                    out.append((i[0], i[1]))
                continue
            bits, root = _folded(odd), list(range(len(odd)))

            def find(k: int) -> int:
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            # Of two blocks, which come sorted, only the pairs across are new.
            start = int(np.searchsorted(block, block[0], "right"))
            for a in range(start if start < len(odd) else len(odd) - 1):
                others = slice(start if start < len(odd) else a + 1, None)
                d = np.bitwise_count(bits[others] ^ bits[a]).sum(axis=1, dtype=np.int64)
                for b in (np.flatnonzero((den + num) * d <= reach[others] + reach[a]) + others.start).tolist():
                    p, q = find(a), find(b)
                    if p != q:
                        root[p] = q
                        out.append((i[a], i[b]))
            if len(out) > 4096:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return f


def _units(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    """(i, reach, b, odd) of each unit of work (s, x, y) of a sorted partition."""
    held = None
    for frame in batches:
        if not len(frame):
            continue
        frame = frame if held is None else pd.concat([held, frame])
        keys = frame[["s", "x", "y"]].to_numpy()
        starts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist()]
        held = frame.iloc[starts[-1] :]  # may go on in the next batch
        yield from _cut(frame, starts)
    if held is not None:
        yield from _cut(held, [0, len(held)])


def _cut(frame: pd.DataFrame, at: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
    i, reach, block, odd = *(frame[c].to_numpy() for c in ("i", "reach", "b")), frame["odd"].tolist()
    for p, q in zip(at, at[1:]):
        yield i[p:q], reach[p:q], block[p:q], odd[p:q]


def _apart(x: bytes, y: bytes) -> int:
    """Bits in which two sketches differ, at the smaller one's size."""
    while len(x) > len(y):
        x = (int.from_bytes(x[: len(x) // 2]) ^ int.from_bytes(x[len(x) // 2 :])).to_bytes(len(x) // 2)
    return _apart(y, x) if len(x) < len(y) else (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


def _folded(odd: list[bytes]) -> np.ndarray:
    """Sketches as rows of words, folded to the smallest one's size."""
    least, rows = min(map(len, odd)), []
    for x in odd:
        a = np.frombuffer(x, np.uint8)
        while len(a) > least:
            a = a[: len(a) // 2] ^ a[len(a) // 2 :]
        rows.append(a)
    return np.stack(rows).view(np.uint64)


def _compare(n: int, similarity: tuple[int, int]):
    """Links that connect what is linked in a unit of work: one block or two."""
    num, den = similarity

    def f(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingle = Shingler(n)
        for parts in runs(batches, ["c", "x", "y"]):
            g = pd.concat(parts) if len(parts) > 1 else parts[0]
            key = g["k"].tolist()
            out = [(key[i], key[j]) for i, j in _forest([shingle(t) for t in g["text"]], num, den)]
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return f


def _forest(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Links that connect all that links connect. A set that nothing has reached yet is
    compared with all others; then those outside the largest group are. Two sets of one
    group, or one that has been compared with all, need no further comparison: a block of
    near copies of one text takes about as many comparisons as it has sets."""
    root, out = list(range(len(sets))), []
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def compare(i: int) -> None:
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        width = hi - lo
        at = np.repeat(lo - np.r_[0, np.cumsum(width)[:-1]], width) + np.arange(width.sum())
        both = np.bincount(owner[at], minlength=len(sets))
        for j in np.flatnonzero(den * both >= num * (sizes + sizes[i] - both)).tolist():
            p, q = find(i), find(j)
            if p != q:
                root[p] = q
                out.append((i, j))

    done = np.zeros(len(sets), bool)
    reached = np.zeros(len(sets), bool)
    for i in range(len(sets)):
        if not reached[i]:
            before = len(out)
            compare(i)
            done[i] = reached[i] = True
            for _, j in out[before:]:
                reached[j] = True
    groups = np.array([find(i) for i in range(len(sets))])
    main = np.bincount(groups).argmax()
    for i in np.flatnonzero((groups != main) & ~done).tolist():
        compare(i)
    return out


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, t1, t2, text): t1 and t2 are 128 bits of the text. Rows that agree in
    the first three are one document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.col("text").cast("string").alias("text"), *more)


def _same(a: DataFrame, b: DataFrame, key: str) -> Column:
    """Whether a row of a is the document that b names as a struct."""
    return a["doc_id"].eqNullSafe(b[key]["doc_id"]) & (a["t1"] == b[key]["t1"]) & (a["t2"] == b[key]["t2"])


def _links(texts: DataFrame, lead: Column, n: int, similarity: tuple[int, int]) -> DataFrame:
    """Links (a, b) between texts (c, k, text, b, nb) of one component c, the blocks b
    below lead compared with all nb blocks and within themselves."""
    others = F.explode(F.sequence(F.lit(0), F.when(F.col("b") < lead, F.col("nb")).otherwise(lead) - 1))
    work = texts.select("c", "k", "text", "b", others.alias("o"))
    work = work.select("c", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "k", "text")
    work = work.repartition(partitions(texts.sparkSession) * 4, "c", "x", "y").sortWithinPartitions("c", "x", "y")
    return work.mapInPandas(_compare(n, similarity), "a string, b string")


def _rest(texts: DataFrame, links: DataFrame, block_chars: int) -> tuple[DataFrame, Column]:
    """texts (c, k, text, size) dealt into blocks, and how many of them lead: those of
    the texts outside the largest group that links connect in their component. A component
    without such texts has no more to compare and no rows."""
    known = components(links)
    grouped = texts.join(known, texts["k"] == known["node"], "left").select("c", "k", "text", "size", F.coalesce("component", "k").alias("g"))
    grouped = written(grouped, "groups")
    groups = grouped.groupBy("c", "g").agg(F.sum("size").alias("size"))
    largest = groups.groupBy("c").agg(F.max_by("g", F.struct("size", "g")).alias("main"), F.max("size").alias("held"), F.sum("size").alias("size"))
    blocks = largest.where("held < size").select("c", "main", F.ceil((F.col("size") - F.col("held")) / block_chars).cast("int").alias("lead"), F.ceil(F.col("held") / block_chars).cast("int").alias("more"))
    dealt = grouped.join(blocks, "c").withColumn("z", F.xxhash64("k"))
    b = F.when(F.col("g") == F.col("main"), F.col("lead") + F.pmod("z", "more")).otherwise(F.pmod("z", "lead"))
    return dealt.select("c", "k", "text", b.cast("int").alias("b"), (F.col("lead") + F.col("more")).alias("nb"), "lead"), F.col("lead")


def _different(again: DataFrame) -> DataFrame:
    """(s, k) of one signature for each different set of k rows that have a signature in
    common: near copies share most of theirs, and their sketches need one comparison."""
    own = [F.count(F.lit(1)).alias("k"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.bit_xor(F.xxhash64("i")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "i")).alias("x2")]
    return again.groupBy("s").agg(*own).groupBy("k", "lo", "hi", "x1", "x2").agg(F.min("s").alias("s")).select("s", "k")


def labelled(docs: DataFrame, n: int, similarity: tuple[int, int], block_chars: int) -> DataFrame:
    """(doc_id, t1, t2, n, first, least) of each row of _keyed: its set's size, the
    first document with that set and the first one of its component."""
    found = docs.mapInPandas(_features(n, similarity), "i long, doc_id long, t1 long, t2 long, n long, h1 long, h2 long, odd binary, sig array<long>, near array<long>, reach long")
    found = written(found, "features")
    signed = found.select("i", F.explode("sig").alias("s"))
    w = Window.partitionBy("s").orderBy("i")
    again = signed.withColumns({"o": F.lag("i").over(w), "p": F.lead("i").over(w)}).where("o is not null or p is not null").select("s", "i")
    again = written(again, "shared-signatures")
    near = written(found.select(F.explode("near").alias("a"), F.col("i").alias("b")), "near")
    first = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t1", "t2")
    classes = written(found.where("n > 0").groupBy("h1", "h2", "n").agg(F.min(first).alias("first")), "classes")
    named = written(found.drop("sig", "near"), "sets")
    discard(found)
    rows = again.join(_different(again).select("s", F.ceil(F.col("k") / ROWS).cast("int").alias("nb")), "s")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("i"), F.col("nb")).cast("int")).join(named.select("i", "reach", "odd"), "i")
    rows = rows.select("s", "i", "b", "reach", "odd", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    rows = rows.select("s", F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "i", "reach", "odd")
    rows = rows.repartition(partitions(docs.sparkSession), "s", "x", "y").sortWithinPartitions("s", "x", "y", "b")
    allowed = written(rows.mapInPandas(_plausible(*similarity), "a long, b long"), "allowed")
    discard(again)
    candidates = components(allowed.union(near))
    held = named.join(candidates, named["i"] == candidates["node"]).select("component", "h1", "h2", "n").distinct()
    held = written(held, "candidates")
    several = written(held.groupBy("component").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("component"), "several")
    members = classes.join(held.join(several, "component"), ["h1", "h2", "n"]).select("component", F.struct("h1", "h2").alias("k"), "first")
    texts = docs.join(members, _same(docs, members, "first")).groupBy("component", "k").agg(F.any_value("text").alias("text"))  # repeated rows have one text
    texts = written(texts.withColumn("size", F.length("text").cast("long")), "members")
    texts = texts.select(F.col("component").alias("c"), F.concat_ws(":", "k.h1", "k.h2").alias("k"), "text", "size")
    size = texts.groupBy("c").agg(F.ceil(F.sum("size") / block_chars).cast("int").alias("nb"))
    dealt = texts.join(size, "c").withColumn("b", F.pmod(F.xxhash64("k"), F.col("nb")).cast("int"))
    links = written(_links(dealt, F.lit(1), n, similarity), "links")
    large = written(size.where("nb > 1"), "large-components")
    if not large.isEmpty():
        links = links.union(_links(*_rest(texts.join(large.select("c"), "c"), links, block_chars), n, similarity))
    final = components(links)
    label = classes.withColumn("k", F.concat_ws(":", "h1", "h2")).join(final, F.col("k") == final["node"], "left").select("h1", "h2", "first", F.coalesce("component", "k").alias("g"))
    label = written(label, "labels")
    least = written(label.groupBy("g").agg(F.min("first").alias("least")), "components")
    label = written(label.join(least, "g").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first", "least"), "labelled")
    out = named.join(label, (named["h1"] == label["_h1"]) & (named["h2"] == label["_h2"]) & (named["n"] > 0), "left")
    return out.select("doc_id", "t1", "t2", "n", "first", "least")


def join(docs: DataFrame, n: int = 3, similarity: tuple[int, int] = (90, 100), block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) per row of docs. class_id is the
    least doc_id with an equal set."""
    out = labelled(_keyed(docs), n, similarity, block_chars)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("least.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 3, similarity: tuple[int, int] = (90, 100), block_chars: int = 4_000_000) -> DataFrame:
    """docs with one row of each component: that with the least doc_id, or one without
    doc_id where none has one. Documents without words stay. Rows that agree in doc_id
    and text are one document, of which one row stays."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    labels = labelled(_keyed(docs), n, similarity, block_chars)
    own = F.struct("doc_id", "t1", "t2")
    gone = labels.where("n > 0").where(own != F.struct("least.doc_id", "least.t1", "least.t2")).select(own.alias("key")).distinct()
    rows = _keyed(docs, whole).drop("text")
    gone = written(gone, "near-duplicates")
    # Only rows that come again are dealt by their keys; the others stay where they are.
    again = rows.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(own.alias("key"))
    again = written(again, "repeated-rows")
    kept = rows.join(gone, _same(rows, gone, "key"), "left_anti")
    once = kept.join(again, _same(kept, again, "key"), "left_anti")
    more = kept.join(again, _same(kept, again, "key"), "left_semi").dropDuplicates(["doc_id", "t1", "t2"])
    return once.union(more).select(*[F.col(f"whole.`{c}`").alias(c) for c in docs.columns])


def digest_query(docs: DataFrame) -> DataFrame:
    """What is asked of op9."""
    return written_stage(lambda: join(docs).select("doc_id", "n_shingles", "component_id"), "components-of")  # all other tables go


SQL_BODY = r"""
w0 AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs}),
t0 AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM w0 WHERE len(w) > 0)),
n0 AS (SELECT doc_id, count(*) AS n FROM t0 GROUP BY doc_id),
p0 AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM t0 a JOIN t0 b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l0 AS (SELECT a, b FROM p0 JOIN n0 x ON x.doc_id = a JOIN n0 y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
e0 AS (SELECT a, b FROM l0 UNION SELECT b, a FROM l0),
r0(doc_id, c) AS (SELECT doc_id, doc_id FROM w0 UNION SELECT e0.b, r0.c FROM r0 JOIN e0 ON e0.a = r0.doc_id WHERE r0.c < e0.b),
c0 AS (SELECT doc_id, min(c) AS component_id FROM r0 GROUP BY doc_id)
"""
SQL = f"""WITH RECURSIVE {SQL_BODY.replace("{docs}", "documents")}
SELECT c0.doc_id, CAST(coalesce(n0.n, 0) AS BIGINT) AS n_shingles, c0.component_id FROM c0 LEFT JOIN n0 USING (doc_id)"""
