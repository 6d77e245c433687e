r"""Line deduplication by winnowing, with DataFrame functions only.

A text is a run of units: lines, cut after a word that ends in . ! or ? and after
ten words, so that a passage is the same units wherever its line breaks fall; a unit
takes the white space before it along. Blank space carries no unit.

Winnowing (Schleimer et al., 2003): the hash of every k consecutive units is a
fingerprint, and the least one in each window of w consecutive fingerprints, the first
of equals, is selected. A window spans a run of t = k + w - 1 units, and equal runs
select the same fingerprint at the same place in them, wherever they stand. So a run
that repeats lies around a selected fingerprint that repeats: fingerprints that occur
once are dropped, the places of the others are joined back to their documents, and
there each match is extended both ways to the runs of t units that selected it. Runs
are compared as a whole: by 128 bits over the hashes of all their units, so that a
stock passage among different neighbours is not taken for a repeated run. Every run
but the first in (doc_id, place) order is deleted; overlapping and adjacent runs merge,
so a repeated passage goes as a whole. That is exactly: a unit goes if it lies in a run
of t units that has occurred before.

A fingerprint's or run's occurrences are never gathered in one place: repeated
fingerprints and first occurrences are aggregations, combined before the shuffle and
written; joining occurrences to these tables lets adaptive execution split a passage
that a third of all documents share. With t = 5 a passage of over 50 words is always
caught when its first word begins a unit.

Units by content (``content``) also end after each word whose hash is divisible by
``CONTENT``, so that the units of a passage that begins in the middle of a sentence agree
again from the first such word on, wherever the count of ten stood before it. Of such
passages without any . ! or ?, by simulation 2% are missed at 51 words, 0.5% at 60;
with a sentence end every twelve words 0.1% at 51.

Nulls: a null text stays null. A null doc_id comes after all others. Rows that agree
in doc_id and text (by 128 bits of it) are one document and fare alike; a text without
words has no units and stays, however long; the same text under another
doc_id is a copy, of which the lowest doc_id stays. A text that loses no unit stays
as it is, byte by byte; one that loses all of them becomes ''. Extra columns stay,
whatever their names; n_units and n_deleted are replaced. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, let, written

K, W = 2, 4
#: One unit; for Java and RE2 alike.
UNIT = r"[ \t\n\r]*(?:[^ \t\n\r]*[^ \t\n\r.!?][ \t]+){0,9}[^ \t\n\r]+(?:[ \t\n\r]+$)?"


WORD = r"[ \t\n\r]*[^ \t\n\r]+(?:[ \t\n\r]+$)?"
CONTENT, MARK = 6, "\x01"


def units(text: Column, content: bool = False) -> Column:
    """A text's units, null for a null text; none of a text without any word, in which the
    pattern would look for a word from each place on."""
    return F.when(F.rlike(text, F.lit(r"[^ \t\n\r]")), _units(text, content)).when(text.isNotNull(), F.array().cast("array<string>"))


def _units(text: Column, content: bool) -> Column:
    plain = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    if not content:
        return plain

    def marked(words: Column) -> Column:  # but for the last word, which ends a unit anyway
        ends = lambda w: F.pmod(F.xxhash64(F.trim(F.translate(w, "\t\n\r", "   "))), F.lit(CONTENT)) == 0
        return F.array_join(F.transform(words, lambda w, i: F.when(ends(w) & (i < F.size(words) - 1), F.concat(w, F.lit(MARK))).otherwise(w)), "")

    cut = F.regexp_extract_all(let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), marked), F.lit(UNIT.replace(".!?", f".!?{MARK}")), F.lit(0))
    # A text that has the mark itself is cut by its lines, sentences and tens.
    return F.when(F.contains(text, F.lit(MARK)), plain).otherwise(F.transform(cut, lambda u: F.translate(u, MARK, "")))


def _digests() -> list[Column]:
    """128 bits of the text: rows that agree in doc_id and in these are one document."""
    return [F.xxhash64("text").alias("d1"), F.xxhash64(F.lit(1), "text").alias("d2")]


def _hashes(docs: DataFrame, k: int, w: int, content: bool) -> DataFrame:
    """(id, d1, d2, h, at) of documents with a run at least: the hashes of their units
    and, for the run that begins at each place, how far in its least fingerprint is."""
    t, bits = k + w - 1, max(1, (w - 1).bit_length())

    def offset(h: Column, s: Column) -> Column:  # the low bits of a fingerprint give way to its place
        return F.least(*[F.shiftleft(F.shiftright(_fingerprint(h, s + i, k), bits), bits).bitwiseOR(F.lit(i)) for i in range(w)]).bitwiseAND((1 << bits) - 1).cast("byte")

    line = F.transform(units(F.col("text"), content), lambda u: F.xxhash64(F.trim(F.translate(u, "\t\n\r", "   "))))
    # The generator keeps Catalyst from splitting the text once for each use.
    split = docs.select(F.col("doc_id").alias("id"), *_digests(), F.explode(F.array(line)).alias("h")).where(F.size("h") >= t)
    return split.withColumn("at", F.transform(F.slice("h", F.lit(1), F.size("h") - (t - 1)), lambda x, s: offset(F.col("h"), s)))


def _fingerprint(h: Column, p: Column, k: int) -> Column:
    return F.get(h, p) if k == 1 else F.xxhash64(*[F.get(h, p + i) for i in range(k)])


def deleted(docs: DataFrame, k: int = K, w: int = W, content: bool = False) -> DataFrame:
    """(id, d1, d2, n, gone) per document with a run at least: its number of units and, if it
    has later occurrences, the places of their first units; each deletes k + w - 1 units."""
    t = k + w - 1
    hashes = written(_hashes(docs, k, w, content), "hashes")
    places = F.array_distinct(F.transform("at", lambda o, s: s + o.cast("int")))
    selected = F.transform(places, lambda p: F.struct(p.alias("p"), _fingerprint(F.col("h"), p, k).alias("fingerprint")))
    anchors = hashes.select("id", "d1", "d2", F.explode(selected).alias("a")).select("id", "d1", "d2", "a.*")
    again = written(anchors.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("fingerprint"), "fingerprints")
    matched = anchors.join(again, "fingerprint").groupBy("id", "d1", "d2").agg(F.collect_set("p").alias("hit"))  # a document's places
    matched = written(matched.withColumnsRenamed({"id": "_id", "d1": "_d1", "d2": "_d2"}), "matches")

    def runs(p: Column) -> Column:  # those that selected the fingerprint at p
        return F.filter(F.sequence(F.greatest(p - (w - 1), F.lit(0)), F.least(p, F.size("at") - 1)), lambda s: s + F.get("at", s).cast("int") == p)

    def named(s: Column) -> Column:
        u = [F.get("h", s + i) for i in range(t)]
        return F.struct(s.alias("s"), F.xxhash64(*u).alias("n1"), F.xxhash64(F.lit(t), *reversed(u)).alias("n2"))

    found = hashes.join(matched, hashes["id"].eqNullSafe(matched["_id"]) & (hashes["d1"] == matched["_d1"]) & (hashes["d2"] == matched["_d2"]))
    found = found.select("id", "d1", "d2", F.explode(F.transform(F.flatten(F.transform("hit", runs)), named)).alias("r"))
    found = written(found.select(F.struct(F.col("id").isNull().alias("z"), "id", "d1", "d2", "r.s").alias("at"), "r.n1", "r.n2"), "runs")
    first = found.groupBy("n1", "n2").agg(F.min("at").alias("one"), F.max("at").alias("last")).where("one <> last")
    first = written(first.select("n1", "n2", "one"), "first-runs")
    later = found.join(first, ["n1", "n2"]).where("at <> one").select("at.id", "at.d1", "at.d2", "at.s")
    sizes = hashes.select("id", "d1", "d2", F.size("h").alias("n"), F.lit(None).cast("int").alias("s"))
    both = later.select("id", "d1", "d2", F.lit(None).cast("int").alias("n"), "s").union(sizes.select("id", "d1", "d2", "n", "s"))
    gone = both.groupBy("id", "d1", "d2").agg(F.max("n").alias("n"), F.collect_set("s").alias("gone"))
    gone = written(gone.withColumn("gone", F.when(F.size("gone") > 0, F.col("gone"))), "gone")
    discard(hashes, again, matched, found, first)
    return gone


def dedup(docs: DataFrame, k: int = K, w: int = W, content: bool = False) -> DataFrame:
    """docs with n_units and n_deleted, and text and n_chars as they are after the
    deletion."""
    t = k + w - 1
    gone = deleted(docs, k, w, content)
    # Whole rows travel as one column, so that no name of theirs can clash.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("k"), *[d.alias(f"_{n}") for n, d in zip(("d1", "d2"), _digests())], F.col("text").alias("text"))
    joined = rows.join(gone, rows["k"].eqNullSafe(gone["id"]) & (rows["_d1"] == gone["d1"]) & (rows["_d2"] == gone["d2"]), "left").select("row", "text", "gone", "n")
    # The generator keeps Catalyst from splitting the text once for each use. A text that stays
    # as it is needs no units but their number.
    split = F.when(F.col("gone").isNotNull() | F.col("n").isNull(), units(F.col("text"), content))
    joined = joined.select("row", "gone", "n", F.explode(F.array(split)).alias("_units"))
    away = F.array_sort(F.array_distinct(F.flatten(F.transform("gone", lambda s: F.sequence(s, s + (t - 1))))))
    joined = joined.select("row", "gone", "n", "_units", F.explode(F.array(away)).alias("_away"))
    # Kept stretches lie between deleted places: slices, so that no unit is looked up in a list.
    stops = F.concat(F.array(F.lit(-1)), F.col("_away"), F.array(F.size("_units")))

    def stretches(at: Column) -> Column:
        return F.transform(F.slice(at, F.lit(2), F.size(at) - 1), lambda stop, i: F.slice("_units", F.get(at, i) + 2, stop - F.get(at, i) - 1))

    text = F.when(F.col("gone").isNotNull(), F.array_join(F.flatten(let(stops, stretches)), ""))
    text = F.when(F.array_contains("_away", 0), F.regexp_replace(text, r"^[ \t\n\r]+", "")).otherwise(text)
    new = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(text)
    out = joined.select("row", F.coalesce("n", F.when(F.col("_units").isNotNull(), F.size("_units")), F.lit(0)).cast("long").alias("n_units"), F.when(F.col("gone").isNull(), F.lit(0)).otherwise(F.size("_away")).cast("long").alias("n_deleted"), new.alias("new"))
    own = {"text": F.col("new"), "n_chars": F.length("new").cast("long")}
    names = [c for c in docs.columns if c.lower() not in ("n_units", "n_deleted")]
    return out.select(*[own.get(c, F.col(f"row.`{c}`")).alias(c) for c in names], "n_units", "n_deleted")


def digest_query(docs: DataFrame) -> DataFrame:
    """What op3 returns: per document its units, deleted units and new text's digest."""
    out = dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_units", "n_deleted", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


_CLASS = r"[ \t\n\r]"
_BODY = r"""
u AS (SELECT doc_id, text, regexp_extract_all(text, '{unit}') AS w FROM {docs} WHERE text IS NOT NULL),
x AS (SELECT doc_id, unnest(w) AS unit, unnest(range(len(w))) AS p FROM u),
h AS (SELECT doc_id, p, unit, trim(translate(unit, chr(9) || chr(10) || chr(13), '   ')) AS t FROM x),
r AS (SELECT doc_id, p, CASE WHEN lead(t, 4) OVER o IS NOT NULL THEN hash(t, lead(t, 1) OVER o, lead(t, 2) OVER o, lead(t, 3) OVER o, lead(t, 4) OVER o) END AS run FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY p)),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, p) AS k FROM r WHERE run IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 5)) AS p FROM f WHERE k > 1),
s AS (SELECT h.doc_id, count(*) AS n, count(g.p) AS gone, count(*) FILTER (g.p = 0) AS head, coalesce(string_agg(h.unit, '' ORDER BY h.p) FILTER (g.p IS NULL), '') AS kept FROM h LEFT JOIN g USING (doc_id, p) GROUP BY h.doc_id)
"""
BODY = _BODY.replace("{unit}", UNIT.replace("$)", r"\z)"))
NEW_TEXT = r"CASE WHEN coalesce(s.gone, 0) = 0 THEN d.text WHEN s.head > 0 THEN regexp_replace(s.kept, '^[ \t\n\r]+', '') ELSE s.kept END"
SQL = f"""WITH {BODY.replace("{docs}", "documents")}
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_units, CAST(coalesce(s.gone, 0) AS BIGINT) AS n_deleted, sha256({NEW_TEXT}) AS text_sha256
FROM documents d LEFT JOIN s USING (doc_id)"""
