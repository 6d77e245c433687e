"""License scans with DataFrame functions only.

Texts and templates become five-word shingles, as hashes. Overlapping windows of c
shingles have ``BANDS`` MinHash values each, one per band; windows of a text and a template
that share a band retrieve the template for that text. A text's windows begin at every
c/4 shingles, a template's at every c/8 (or every one). c is 32 for templates of 64
shingles or more, 8 from 16 on; of smaller ones every single shingle is a window.

Two windows share a band with their similarity J as probability, so all bands miss with
(1 - J) ** BANDS. A match has 0.8 n of a template's n shingles in 1.25 n places: windows
that lie in an exact copy differ from a template's by their offset, c/16 on average, J about
0.9, and of those that edits thin out the median one has J of 0.6 or more: it is missed with
0.4 ** 6 = 0.4%, two that don't overlap with 2e-5, and a template has two at least, four or
more from 128 shingles on. Tests plant edited copies at the threshold and find 99.5% of them.

Retrieved templates are verified exactly: the most of the template's different shingles that
any 1.25 n places of the text hold, as a share of n; 0.8 or more is a match. Each place of
a shingle that the template has counts for the starts from which it is the first of its
kind within reach, an interval; the highest sum of intervals is the result, so the cost is
that of sorting a text's places, whatever the template's size.

Texts without any of a block's shingles can't match: most are told by a table of bits, and
no windows of theirs are hashed. Templates are a parameter. Their shingles and bands are broadcast in blocks of
``block_chars`` characters of templates (at most about eight rows a word), one pass over the
texts each; a longer template is a block of its own. Texts aren't shuffled, only places of
template shingles are, by text and template.

Nulls: a null text has no words. Repeated rows match alike and give one result row
per (doc_id, license), also where several templates have one name; of templates that
match alike each is reported. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, literal_longs, written
from .decontaminate import words

#: License notices and texts. Fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("MIT-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    ("BSD-text", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
]
SHINGLE, SHARE = 5, 0.8
SEEDS = [0, 7046029254386353131, 1609587929392839161, 4354685564936845319, 2870177450012600261, 8275004299218137483]


def shingles(text: Column) -> Column:
    def over(w: Column) -> Column:
        return F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(0))), lambda x, i: F.xxhash64(*[F.get(w, i + j) for j in range(SHINGLE)]))

    return let(words(text), over)


BANDS = len(SEEDS)
BITS = 1 << 22
#: Shingles of a window, and of the smallest templates that have such windows.
SIZES = [(8, 16), (32, 64)]


def _keys(windows: Column, c: int, bands: int) -> Column:
    """One key per window (a struct of minima by band) and band; c and the band are part of it."""
    return F.flatten(F.transform(windows, lambda w: F.array(*[F.xxhash64(F.lit(c), F.lit(j), w[f"m{j}"]) for j in range(bands)])))


def _against(seed: int):
    return lambda x: x.bitwiseXOR(F.lit(seed))


def _minima(shingles: Column, bands: int) -> Column:
    return F.struct(*[F.array_min(F.transform(shingles, _against(SEEDS[j]))).alias(f"m{j}") for j in range(bands)])


def _window(c: int, bands: int):
    return lambda p: _minima(F.slice("ts", p, F.lit(c)), bands)


def _text_keys(s: Column, c: int, bands: int) -> Column:
    """Keys of a text's windows, from the minima of quarters of a window."""
    pane = c // 4

    def windows(panes: Column) -> Column:
        least = lambda q, j: F.least(*[F.get(panes, q + i)[f"m{j}"] for i in range(4)])
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(panes) - 4, F.lit(0))), lambda q: F.struct(*[least(q, j).alias(f"m{j}") for j in range(bands)]))

    starts = F.sequence(F.lit(1), F.size(s), F.lit(pane))
    return _keys(let(F.transform(starts, lambda q: let(F.slice(s, q, F.lit(pane)), lambda w: _minima(w, bands))), windows), c, bands)


def _blocks(templates: list[tuple[str, str]], block_chars: int) -> list[list[tuple[str, str]]]:
    """The templates in order, in lists of at most block_chars characters or one template."""
    out, held = [[]], 0
    for license, text in templates:
        held += len(text or "")
        if out[-1] and held > block_chars:
            out.append([])
            held = len(text or "")
        out[-1].append((license, text))
    return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, bands: int = BANDS, block_chars: int = 500_000) -> DataFrame:
    """(doc_id, license, containment) of every match."""
    found = reduce(DataFrame.union, [_matches(docs, block, bands) for block in _blocks(templates, block_chars)])
    return found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"))


def _known(docs: DataFrame, templates: list[tuple[str, str]]) -> DataFrame:
    """(t, license, ts): the templates that have shingles, by number."""
    t = docs.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(templates)], "t int, license string, text string")
    return t.select("t", "license", F.array_distinct(shingles(F.col("text"))).alias("ts")).where(F.size("ts") > 0)


def _wanted(known: DataFrame, bands: int) -> DataFrame:
    """(key, t, retrieves): the templates' shingles, and the keys of their windows."""
    own = known.select(F.explode("ts").alias("key"), "t", (F.size("ts") < SIZES[0][1]).alias("retrieves"))
    tops = [n for _, n in SIZES[1:]] + [None]
    for (c, n), top in zip(SIZES, tops):
        sized = known.where((F.size("ts") >= n) & (F.lit(True) if top is None else F.size("ts") < top))
        windows = F.transform(F.sequence(F.lit(1), F.size("ts") - (c - 1), F.lit(max(1, c // 8))), _window(c, bands))
        own = own.union(sized.select(F.explode(_keys(windows, c, bands)).alias("key"), "t", F.lit(True)).distinct())
    return own


def _may_hold(known: DataFrame) -> Column:
    """Whether a text (s) may have a shingle of any template, without which it can't match:
    by a bit for each shingle, of ``BITS`` in all."""
    bits: dict[int, int] = {}
    for (x,) in known.select(F.explode("ts")).collect():  # a block's
        word, bit = (x >> 6) % (BITS // 64), x & 63
        bits[word] = bits.get(word, 0) | 1 << bit
    signed = [v - (1 << 64) if v >> 63 else v for v in (bits.get(i, 0) for i in range(BITS // 64))]
    table = literal_longs(signed)
    word = lambda x: F.get(table, F.shiftright(x, 6).bitwiseAND(BITS // 64 - 1).cast("int"))
    return F.exists("s", lambda x: F.getbit(word(x), x.bitwiseAND(63).cast("int")) == 1)


def _matches(docs: DataFrame, templates: list[tuple[str, str]], bands: int) -> DataFrame:
    """Matches of one block of templates, repeated ones too."""
    known = _known(docs, templates)
    # The generators keep Catalyst from computing the shingles once for each use.
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.explode(F.array(shingles(F.col("text")))).alias("s")).where(_may_hold(known))
    places = [F.transform("s", lambda x, i: F.struct(x.alias("key"), i.alias("p")))]
    largest = known.agg(F.max(F.size("ts"))).first()[0] or 0
    for c, n in SIZES:
        if n <= largest:
            places.append(F.transform(_text_keys(F.col("s"), c, bands), lambda k: F.struct(k.alias("key"), F.lit(-1).alias("p"))))
    looked = d.select("row", "doc_id", F.explode(F.concat(*places)).alias("k")).select("row", "doc_id", "k.*")
    found = written(looked.join(F.broadcast(_wanted(known, bands)), "key"), "template-places")
    retrieved = found.where("retrieves").select("row", "t").distinct()
    sizes = known.select("t", "license", F.size("ts").alias("n"))
    hits = found.where("p >= 0").join(retrieved, ["row", "t"], "left_semi").join(F.broadcast(sizes), "t")
    span = F.col("n") + F.floor(F.col("n") / 4).cast("int")
    before = F.lag("p").over(Window.partitionBy("row", "t", "key").orderBy("p"))
    hits = hits.withColumn("lo", F.greatest(F.coalesce(before + 1, F.lit(0)), F.col("p") - span + 1))
    ends = hits.select("row", "doc_id", "t", "license", "n", F.explode(F.array(F.struct(F.col("lo").alias("x"), F.lit(1).alias("d")), F.struct((F.col("p") + 1).alias("x"), F.lit(-1).alias("d")))).alias("e"))
    steps = ends.groupBy("row", "doc_id", "t", "license", "n", "e.x").agg(F.sum("e.d").alias("d"))
    held = F.sum("d").over(Window.partitionBy("row", "t").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    most = steps.withColumn("held", held).groupBy("row", "doc_id", "t", "license", "n").agg(F.max("held").alias("held"))
    return most.select("doc_id", "license", (F.col("held") / F.col("n")).alias("containment")).where(F.col("containment") >= SHARE)


def digest_query(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", "license", F.round("containment", 6).alias("containment"))


def _quoted(text: str) -> str:
    return text.replace("'", "''")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH l(license, text) AS (VALUES {", ".join(f"('{a}', '{_quoted(b)}')" for a, b in TEMPLATES)}),
d AS (SELECT doc_id, p, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) >= 5)),
t AS (SELECT DISTINCT license, array_to_string(w[p:p + 4], ' ') AS g FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS p FROM (SELECT license, {_WORDS} AS w FROM l) WHERE len(w) >= 5)),
n AS (SELECT license, count(*) AS n, count(*) + count(*) // 4 AS span FROM t GROUP BY license),
h AS (SELECT doc_id, license, p, d.g FROM d JOIN t ON d.g = t.g),
c AS (SELECT a.doc_id, a.license, a.p, count(DISTINCT b.g) AS k FROM h a JOIN n USING (license) JOIN h b ON a.doc_id = b.doc_id AND a.license = b.license AND b.p >= a.p AND b.p < a.p + n.span GROUP BY ALL)
SELECT doc_id, license, round(max(k / n.n), 6) AS containment FROM c JOIN n USING (license) GROUP BY doc_id, license HAVING max(k / n.n) >= 0.8
"""
