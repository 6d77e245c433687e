r"""Merkle fingerprints of documents.

A text is a tree: sections (groups of paragraphs; one ends at a blank line or after a
paragraph whose hash is divisible by 8, so that an insertion moves no later bound),
paragraphs (lines), and pieces of a paragraph: sentences, cut after . ! or ? and white
space and after ``PIECE`` characters without one, taken together up to one whose checksum
is even, or to ``PIECE`` characters. Nodes have 128-bit hashes; a node's covers its
children's, a piece's its bytes. Equal texts, and only those up to hash collisions, have
equal roots; ``differing`` walks down unequal branches to the pieces that changed.

A fingerprint is base64 of bytes: the root's hash, then the sections, each with its
paragraphs, each with its pieces and their lengths: what likeness needs without the
texts. Sections keep 128 bits of their hashes, paragraphs and pieces 64, and a node with
one child keeps none, its child's being its own. On the given documents fingerprints have
a fifth to a quarter of the texts' bytes.
Likeness is the share of text below branches that both trees have:
2 * common / (length + length), 1 for equal roots, from 0 to 1; two empty texts are
alike.

Documents meet their neighbours in descending doc_id order by streaming over ranges
of doc_id: bounds are quantiles of equal bytes, each range also gets the first document
of the range after it, so no window spans the table and each text is shuffled once.

Nulls: a null text is ''. A null doc_id comes last in the order. Rows with one doc_id,
or none, follow each other in descending order of their texts' hashes (64 bits);
repeated rows are neighbours of each other. The last document has the first as its
next one. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import RangeBuckets, partitions

PIECE = 256
CUT = re.compile(r"(?:[^.!?]{1,%d}?(?:[.!?]+(?:\s+|$))|.{1,%d})" % (PIECE, PIECE), re.S)
#: Bytes of a whole hash, and of what is kept of a paragraph's or piece's.
WHOLE, SHORT = 16, 8


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=WHOLE).digest()


def _pieces(line: str) -> Iterator[bytes]:
    held, size = [], 0
    for sentence in CUT.findall(line):
        data = sentence.encode("utf-8", "surrogatepass")
        held.append(data)
        size += len(sentence)
        if size >= PIECE or zlib.crc32(data) % 2 == 0:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _parent(whole: list[bytes], keys: list[bytes], kept: int) -> tuple[bytes, bytes]:
    """A node's hash and what is kept of it."""
    if len(whole) == 1:
        return whole[0], keys[0]
    h = _hash(b"".join(whole))
    return h, h[:kept]


def rooted(text: str | None) -> tuple[bytes, list]:
    """(root, [(kept hash, length, [(kept hash, length, [(kept hash, length), ...]), ...]), ...]):
    sections, paragraphs, pieces."""
    sections, wholes, held = [], [], []

    def close() -> None:
        if held:
            whole, key = _parent([h for h, _ in held], [p[0] for _, p in held], WHOLE)
            wholes.append(whole)
            sections.append((key, sum(p[1] for _, p in held), [p for _, p in held]))
            held.clear()

    for line in (text or "").splitlines(keepends=True):
        data = list(_pieces(line))
        hashes = [_hash(d) for d in data]
        pieces = [(h[:SHORT], _length(d)) for h, d in zip(hashes, data)]
        whole, key = _parent(hashes, [p[0] for p in pieces], SHORT)
        held.append((whole, (key, len(line), pieces)))
        if not line.strip() or whole[0] % 8 == 0:
            close()
    close()
    return _hash(b"".join(wholes)), sections


def _length(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "surrogatepass"))


def tree(text: str | None) -> list:
    return rooted(text)[1]


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def encoded(root: bytes, sections: list) -> str:
    out = [root]
    for key, _, paragraphs in sections:
        out.append(_number(len(paragraphs)))
        if len(paragraphs) > 1:
            out.append(key)
        for own, _, pieces in paragraphs:
            out.append(_number(len(pieces)))
            if len(pieces) > 1:
                out.append(own)
            out += [x for h, n in pieces for x in (h, _number(n))]
    return base64.b64encode(b"".join(out)).decode()


def fingerprint(text: str | None) -> str:
    return encoded(*rooted(text))


def from_string(fingerprint: str) -> tuple[bytes, list]:
    data = base64.b64decode(fingerprint)
    at = WHOLE

    def taken(n: int) -> bytes:
        nonlocal at
        at += n
        return data[at - n : at]

    def number() -> int:
        n = shift = 0
        while True:
            (x,) = taken(1)
            n |= (x & 127) << shift
            shift += 7
            if x < 128:
                return n

    sections = []
    while at < len(data):
        n = number()
        key, paragraphs = taken(WHOLE) if n > 1 else b"", []
        for _ in range(n):
            m = number()
            own = taken(SHORT) if m > 1 else b""
            pieces = [(taken(SHORT), number()) for _ in range(m)]
            paragraphs.append((own or pieces[0][0], sum(x for _, x in pieces), pieces))
        sections.append((key or paragraphs[0][0], sum(p[1] for p in paragraphs), paragraphs))
    return data[:WHOLE], sections


def _unmatched(a: list, b: list) -> tuple[int, list, list]:
    """Length under nodes that both lists have, and the nodes left over."""
    left, common, rest_a, rest_b = Counter(x[0] for x in b), 0, [], []
    taken: Counter = Counter()
    for x in a:
        if left[x[0]] > taken[x[0]]:
            taken[x[0]] += 1
            common += x[1]
        else:
            rest_a.append(x)
    for x in b:
        if taken[x[0]]:
            taken[x[0]] -= 1
        else:
            rest_b.append(x)
    return common, rest_a, rest_b


def _descend(a: list, b: list) -> tuple[int, list, list]:
    common, a, b = _unmatched(a, b)
    for _ in range(2):
        more, a, b = _unmatched([x for s in a for x in s[2]], [x for s in b for x in s[2]])
        common += more
    return common, a, b


def likeness(a: str, b: str) -> float:
    (ra, sa), (rb, sb) = from_string(a), from_string(b)
    return tree_likeness(ra, sa, rb, sb)


def tree_likeness(ra: bytes, sa: list, rb: bytes, sb: list) -> float:
    if ra == rb:
        return 1.0
    total = sum(s[1] for s in sa) + sum(s[1] for s in sb)
    return 2.0 * _descend(sa, sb)[0] / total if total else 1.0


def differing(a: str, b: str) -> tuple[list[str], list[str]]:
    """Hashes of the pieces that only one of two texts has: where edits lie."""
    _, x, y = _descend(from_string(a)[1], from_string(b)[1])
    return [p[0].hex() for p in x], [p[0].hex() for p in y]


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with their fingerprint."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t) for t in texts], dtype=object)

    return docs.withColumn("fingerprint", of(F.col(text_col)))


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    held = None  # the row before: its bucket, doc_id, text, root and tree

    for frame in batches:
        rows = []
        for bucket, ahead, doc_id, text in zip(frame["bucket"], frame["ahead"], frame["doc_id"], frame["text"]):
            text = text or ""
            own = rooted(text)
            if held and held[0] == bucket:
                _, last, old, before = held
                half = len(old) // 2
                edited = old[: len(old) - half] + text[:half]
                changed = rooted(edited)
                rows.append((last, len(old), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), encoded(*before), encoded(*changed), tree_likeness(*before, *changed), tree_likeness(*before, *own)))
            held = None if ahead else (bucket, doc_id, text, own)
        yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})


def neighbours(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and their likeness."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ranges = RangeBuckets(docs, "doc_id", partitions(docs.sparkSession), ascending=False, weight=F.octet_length("text"))
    placed = docs.withColumn("z", F.xxhash64("text"))
    placed = placed.withColumn("bucket", ranges.bucket(F.col("z")))
    # The first document of each range also goes to the range before it. Heads are 2 n
    # rows at most, n being the number of partitions, which bounds window and broadcast.
    first = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("i"), "z")
    heads = placed.groupBy("bucket").agg(F.max(first).alias("head"))
    every = Window.orderBy("bucket")
    around = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("head", F.coalesce(F.lag("bucket").over(every), F.last("bucket").over(around)).alias("before"))
    own, ahead = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("a")), F.struct(F.col("before").alias("b"), F.lit(True).alias("a"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, ahead))
    dealt = placed.join(F.broadcast(heads), first == F.col("head"), "left").withColumn("at", F.explode(places))
    dealt = ranges.dealt(dealt.select(F.col("at.b").alias("bucket"), F.col("at.a").alias("ahead"), "doc_id", "text", "z"), "bucket")
    dealt = dealt.sortWithinPartitions("bucket", "ahead", F.desc_nulls_last("doc_id"), F.desc("z"))
    return dealt.select("bucket", "ahead", "doc_id", "text").mapInPandas(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def digest_query(docs: DataFrame) -> DataFrame:
    """What is asked of op4."""
    return neighbours(docs)
