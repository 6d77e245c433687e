"""Conversation structure repair by a bidirectional tight-arc DAG.

A conversation is its rows by turn. A row's fault is the first of: blank (no visible
character), duplicate (its role and text were seen earlier), truncated (its last visible
character ends no sentence). Edits make the roles' initials match (s?(ua)+)?: keep a row
(0), give it the role user or assistant (1), delete it (2; blank and duplicate rows must
go), insert a row without text (5); a truncated row that stays costs 5 more.

Nodes of the DAG are a place between rows and a state of that pattern (nothing yet, or
the last role s, u or a), arcs are edits. With the least cost F from the start and B to
the end an arc lies on a cheapest way exactly if F + its cost + B is the total: it is
tight. From the start on, the frontier follows the least letter of its tight arcs, which
gives the ASCII-least of the cheapest audits. Given its state, each letter leads to one
node, so a frontier that starts from one node stays one.

A conversation may be any share of all rows. Rows are ranged by (conv_id, turn) into
partitions of bounded size, so a long conversation is several pieces. A piece's least
costs between each two states are a 4 x 4 matrix; matrices of a conversation's pieces (a
partition each at most) are multiplied from both ends in the (min, +) sense, which gives
each piece F at its start and B at its end. Every piece then finds its own tight arcs
and, from each state that it may begin in, its letters; a conversation chains those. No
step holds more than a piece or one letter a row, the audit itself. The repaired text's
digest is a stream over a conversation's rows in order, as SHA-256 has to be.

Nulls: a null conv_id is one conversation; a null role or text is one space; null turns
come first and have no part in gaps. Rows of one turn are in the order of the MD5 of
role and text; rows that agree in all of it are repeated rows. Extra columns are ignored.
A conversation without rows has zeros, an empty audit and the empty text's digest; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, partitions, written

#: States: nothing yet, and the last role's initial.
STATES = "-sua"
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
#: A row's code is 3 times its initial's place in INITIALS plus its kind.
INITIALS, PLAIN, TRUNCATED, GONE = "sua?", 0, 1, 2
KEEP, REROLE, DELETE, INSERT, SHORT = 0, 1, 2, 5, 5
FAR = 1 << 60
VISIBLE = r"[^\x20\x09-\x0D]"


def _step(state: int) -> int:
    """Where the one role of user and assistant that may follow leads."""
    return 3 if state == 2 else 2


def arcs(code: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of the edits that consume a row with this code."""
    initial, kind = INITIALS[code // 3], code % 3
    out = [("D", s, s, DELETE) for s in range(4)]
    if kind != GONE:
        more = SHORT if kind == TRUNCATED else 0
        out += [("K", s, to, KEEP + more) for s, to in NEXT.get(initial, {}).items()]
        out += [("R", s, _step(s), REROLE + more) for s in range(4)]
    return out


ARCS = [arcs(c) for c in range(12)]
INSERTS = [("I", s, _step(s), INSERT) for s in range(4)]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product of cost matrices, or of a row and a matrix."""
    return np.minimum((a[..., :, None] + b).min(axis=-2), FAR)


def _matrix(found: list[tuple[str, int, int, int]]) -> np.ndarray:
    m = np.full((4, 4), FAR)
    for _, s, to, cost in found:
        m[s, to] = min(m[s, to], cost)
    return m


_UNIT = _matrix([("", s, s, 0) for s in range(4)])
_ONE_MORE = np.minimum(_UNIT, _matrix(INSERTS))
#: Any inserts: three reach every state that they can.
_INSERTED = product(product(_ONE_MORE, _ONE_MORE), _ONE_MORE)
#: Inserts and then a row.
MATRICES = [product(_INSERTED, _matrix(a)) for a in ARCS]
#: The least cost to a full pattern after the last row, by inserts, and their letters.
END = product(_INSERTED, np.array([[0], [FAR], [FAR], [0]]))[:, 0]
LAST = ["", "II", "I", ""]


def through(codes: bytes) -> np.ndarray:
    m = _UNIT
    for c in codes:
        m = product(m, MATRICES[c])
    return m


def ways(codes: bytes, first: np.ndarray, after: np.ndarray, total: int) -> list[tuple[int, str]]:
    """For each state that the piece may begin in, where the least tight letters lead and
    the letters; first: F of the states at its start, after: B of those at its end."""
    back = [after.tolist()]
    for c in reversed(codes):
        back.append(product(MATRICES[c], np.array(back[-1])[:, None])[:, 0].tolist())
    back = back[::-1]
    ahead = [product(first[None, :], _INSERTED)[0].tolist()]  # inserts before a row are part of its layer
    for c in codes:
        ahead.append(product(product(np.array([ahead[-1]]), _matrix(ARCS[c])), _INSERTED)[0].tolist())
    out = []
    for start in range(4):
        if first[start] + back[0][start] != total:
            out.append((-1, ""))
            continue
        letters, state, i = [], start, 0
        while i < len(codes):
            here = ahead[i][state]
            tight = [(x, to) for x, s, to, cost in ARCS[codes[i]] if s == state and here + cost + back[i + 1][to] == total]
            tight += [(x, to) for x, s, to, cost in INSERTS if s == state and here + cost + back[i][to] == total]
            letter, state = min(tight)
            letters.append(letter)
            i += letter != "I"
        out.append((state, "".join(letters)))
    return out


def rows_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) without nulls in the last two."""
    full = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), full("role"), full("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """rows after the damage that a checksum of conv_id and turn picks for each."""
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(name.cast("binary")) % 20
    hit = rows.withColumn("kind", kind).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def _last(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"[\x20\x09-\x0D]+\z", ""), -1, 1)


_CODED = "part int, codes binary, costs array<bigint>, sums array<bigint>"


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A piece's codes, cost matrix, and (blank, duplicate, truncated, illegal pairs inside,
    different turns, has turns, first turn, last turn, first initial, last initial)."""
    for frame in batches:
        out = []
        for conv_id, part, rows in zip(frame["conv_id"], frame["part"], frame["rows"]):
            initials, faults = [r["initial"] for r in rows], [r["fault"] for r in rows]
            codes = bytes(3 * a + (GONE if f in (1, 2) else TRUNCATED if f == 3 else PLAIN) for a, f in zip(initials, faults))
            turns = [r["turn"] for r in rows if r["turn"] is not None]
            illegal = sum(not _legal(a, b) for a, b in zip(initials, initials[1:]))
            sums = [*(faults.count(f) for f in (1, 2, 3)), illegal, len(set(turns)), int(bool(turns)), *(turns[:1] or [0]), *(turns[-1:] or [0]), initials[0], initials[-1]]
            out.append((conv_id, part, codes, through(codes).ravel().tolist(), sums))
        yield pd.DataFrame(out, columns=["conv_id", "part", "codes", "costs", "sums"]).astype({"conv_id": "Int64"})


def _legal(a: int, b: int) -> bool:
    return INITIALS[a] + INITIALS[b] in ("su", "ua", "au")


_PLANNED = "conv_id bigint, part int, first array<bigint>, after array<bigint>, cost bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def _planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each piece's F at its start and B at its end, and the conversation's counts."""
    for frame in batches:
        out = []
        for conv_id, pieces in zip(frame["conv_id"], frame["pieces"]):
            matrices = [np.array(p["costs"]).reshape(4, 4) for p in pieces]
            first, after = [np.array([0, FAR, FAR, FAR])], [END]
            for m in matrices:
                first.append(product(first[-1][None, :], m)[0])
            for m in reversed(matrices):
                after.append(product(m, after[-1][:, None])[:, 0])
            after = after[::-1]
            sums = [[int(x) for x in p["sums"]] for p in pieces]
            dated = [s for s in sums if s[5]]
            turns = sum(s[4] for s in dated) - sum(a[7] == b[6] for a, b in zip(dated, dated[1:]))
            gaps = dated[-1][7] - dated[0][6] + 1 - turns if dated else 0
            illegal = sum(s[3] for s in sums) + sum(not _legal(a[9], b[8]) for a, b in zip(sums, sums[1:]))
            counts = [int(after[0][0]), gaps, *(sum(s[j] for s in sums) for j in range(3)), illegal]
            out += [(conv_id, p["part"], f.tolist(), b.tolist(), *counts) for p, f, b in zip(pieces, first, after[1:])]
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _PLANNED.split(", ")]).astype({"conv_id": "Int64"})


def _walked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        rows = zip(frame["conv_id"], frame["part"], frame["codes"], frame["first"], frame["after"], frame["cost"])
        out = [(c, p, *zip(*ways(bytes(codes), np.array(f), np.array(b), int(cost)))) for c, p, codes, f, b, cost in rows]
        yield pd.DataFrame(out, columns=["conv_id", "part", "ends", "letters"]).astype({"conv_id": "Int64"})


_REPAIRED = "conv_id bigint, repaired_sha256 string"


def _repaired(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The digest of each conversation's repaired rows; its audit comes first (pos -1)."""
    known, digest, audit, at, state, lines = None, None, "", 0, 0, 0

    def line(role: str, text: str) -> None:
        nonlocal lines
        digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
        lines += 1

    def inserted() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state = _step(state)
            line("assistant" if state == 3 else "user", "")
            at += 1

    for frame in batches:
        out = []
        for conv_id, pos, role, text in zip(frame["conv_id"], frame["pos"], frame["role"], frame["text"]):
            if pos < 0:
                if digest is not None:
                    inserted()
                    out.append((known, digest.hexdigest()))
                known, digest, audit, at, state, lines = conv_id, hashlib.sha256(), text, 0, 0, 0
                continue
            inserted()
            letter = audit[at]
            at += 1
            if letter == "K":
                state = NEXT[role[0]][state]
                line(role, text)
            elif letter == "R":
                state = _step(state)
                line("assistant" if state == 3 else "user", text)
        yield pd.DataFrame(out, columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})
    if digest is not None:
        inserted()
        yield pd.DataFrame([(known, digest.hexdigest())], columns=["conv_id", "repaired_sha256"]).astype({"conv_id": "Int64"})


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256) of each conversation in rows (conv_id, turn, role, text)."""
    n = partitions(rows.sparkSession)
    tie = F.md5(F.concat_ws("\x00", "role", "text").cast("binary"))
    ranged = rows.withColumns({"tie": tie, "input": F.monotonically_increasing_id()})
    order = ["conv_id", "turn", "tie", "input"]
    ranged = ranged.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = written(ranged.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("pos")), "turns")

    short = (F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) == 0).alias("blank")
    initial = F.coalesce(F.array_position(F.array(*[F.lit(x) for x in "sua"]), F.substring("role", 1, 1)), F.lit(0)).cast("int")
    initial = F.when(initial == 0, 3).otherwise(initial - 1).alias("initial")
    cut = (~_last(F.col("text")).isin(".", "!", "?")).alias("cut")
    said = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2")]
    marks = written(ranged.select("conv_id", "part", "pos", "turn", initial, short, cut, *said), "marks")
    again = marks.where("NOT blank").groupBy("conv_id", "h1", "h2").agg(F.min("pos").alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "one")
    seen = marks.join(again, marks["conv_id"].eqNullSafe(again["c"]) & (marks["h1"] == again["_h1"]) & (marks["h2"] == again["_h2"]), "left")
    fault = F.when(F.col("blank"), 1).when(F.coalesce(F.col("pos") > F.col("one"), F.lit(False)), 2).when(F.col("cut"), 3).otherwise(0)
    piece = F.sort_array(F.collect_list(F.struct("pos", "initial", fault.alias("fault"), "turn"))).alias("rows")
    coded = written(seen.groupBy("conv_id", "part").agg(piece).mapInPandas(_pieces, f"conv_id bigint, {_CODED}"), "pieces")
    discard(marks)
    whole = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "costs", "sums"))).alias("pieces"))
    plan = written(whole.mapInPandas(_planned, _PLANNED), "plan")
    walk = coded.alias("a").join(plan.alias("b"), F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.part") == F.col("b.part")))
    walk = walk.select("a.conv_id", "a.part", "codes", "first", "after", "cost").mapInPandas(_walked, "conv_id bigint, part int, ends array<int>, letters array<string>")
    pieces = F.sort_array(F.collect_list(F.struct("part", "ends", "letters")))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("audit"))
    chained = F.aggregate(pieces, state, lambda s, p: F.struct(F.get(p["ends"], s["at"]).alias("at"), F.concat(s["audit"], F.get(p["letters"], s["at"])).alias("audit")))
    audits = walk.groupBy("conv_id").agg(chained.alias("s")).select("conv_id", F.concat("s.audit", F.get(F.array(*[F.lit(x) for x in LAST]), F.col("s.at"))).alias("audit"))
    audits = written(audits, "audits")
    stream = audits.select("conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("role"), F.col("audit").alias("text")).union(ranged.select("conv_id", "pos", "role", "text"))
    stream = stream.repartition(n, "conv_id").sortWithinPartitions("conv_id", "pos").mapInPandas(_repaired, _REPAIRED)
    sums = plan.groupBy("conv_id").agg(*[F.first(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")])  # alike in all pieces
    parts = [written(stream, "repaired").alias("r"), audits.alias("t"), sums.alias("s")]
    on = lambda x: F.col("r.conv_id").eqNullSafe(F.col(f"{x}.conv_id"))
    out = parts[0].join(parts[1], on("t")).join(parts[2], on("s"))
    discard(ranged, coded)
    return out.select("r.conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def digest_query(conversations: DataFrame) -> DataFrame:
    """What is asked of op12: repairs after the damage, with the conversations that it left empty."""
    rows = rows_of(conversations)
    every, found = rows.select(F.col("conv_id").alias("c")).distinct(), repair(damaged(rows))
    both = every.join(found, every["c"].eqNullSafe(found["conv_id"]), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select(F.col("c").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
