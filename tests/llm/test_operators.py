"""Each operator on small fixtures: against brute force, round trips, edge cases."""

import hashlib
import io
import math
import random
import time
import zlib

import numpy as np
import pandas as pd
import public_tokenizers as P
import pytest
from oracle import SMALL, assert_same
from pyspark.sql import functions as F

from kilnworks.llm import bpe, decontaminate, html_extract, jaccard_join, license_scan, line_dedup, merkle, queries, token_files, toxicity, warc
from kilnworks.llm.common import components, table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, hit_words string"
ODD = [None, "", "   \n ", "x", "Same text. " * 40, "Same text. " * 40, "é " * 30 + "日本語 🎉\r\n\tend", "a" * 3000, "word " * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, a clashing extra column."""
    rows = [(i, t, None, "s", len(t or ""), "own") for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [rows[4], (None, "no id here at all", "en", None, 1, None), (None, None, None, None, None, None)], SCHEMA).cache()


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "word word"), (2, None), (3, "same TEXT same text same text same text same text x"), (None, "x")], "item_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_oracle(spark, name):
    assert_same(queries.QUERIES[name](spark, SMALL), queries.SQL[name])


def test_every_query_is_there():
    assert {n.split("_")[0] for n in queries.QUERIES} == {*(f"op{i}" for i in range(1, 14)), "pipeline"}


def test_components(spark):
    random.seed(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(random.randrange(100, 160), random.randrange(100, 160)) for _ in range(40)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/x y", "é"), (2, None, None), (3, "http://a/3", "é"), (4, "u", ""), (None, "v", "é"), (5, "w", "other" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.read(warc.write(pages)).collect()}
    assert len(got) == 6 and got[1].record_type == "revisit" and got[1].refers_to == 3 and got[1].payload is None
    assert got[None].refers_to == 3 and got[3].record_type == "response" and bytes(got[3].payload) == "é".encode()
    assert (got[2].refers_to, got[4].record_type, got[5].payload_bytes) == (4, "response", 45000)
    assert {r.record_type for r in warc.read(warc.write(pages, revisit_bytes=3), payload=False).collect()} == {"response"}
    index = warc.write(pages)
    assert [r.page_id for r in warc.read(index.where("page_id = 5")).collect()] == [5]
    assert warc.read(warc.write(pages.limit(0))).count() == 0
    assert [len(g) for g in warc.coalesced([(0, 10), (12, 10), (100, 10), (110, 50)], 5, 55)] == [2, 1, 1]


SPECIAL = ["<|endoftext|>", "before <|endoftext|><|endoftext|> after <|endoftext", "ctl \x1c\x1f x\x85y \u00a0 z² ½ 3½ _a_ don't I'LL"]


def test_token_files(spark, odd):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    odd = odd.drop("hit_words").union(spark.createDataFrame([(20 + i, t, None, None, 0) for i, t in enumerate(SPECIAL)], odd.drop("hit_words").schema))
    shards = token_files.write(odd, P.path("byte_bpe_50k.json"), P.PATTERN)
    got = sorted(token_files.read(shards).collect(), key=lambda r: r.start)
    assert len(got) == odd.count()
    texts = {i: t for i, t in enumerate(ODD)} | {20 + i: t for i, t in enumerate(SPECIAL)}
    at = 0
    for r in got:
        if r.doc_id is not None:
            assert r.ids == library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == [0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 20, 21, 22, None, None]
    assert token_files.read(token_files.write(odd.limit(0), P.path("byte_bpe_50k.json"), P.PATTERN)).count() == 0


def test_repair_round_trip():
    rng = np.random.default_rng(0)
    counts = [int(x) for x in rng.integers(1, 900, 60)] + [1000, 7]
    ids = np.concatenate([rng.zipf(1.6, n).clip(1, 500).astype(np.int32) for n in counts[:-2]] + [np.full(1007, 9, np.int32)])
    data = token_files.pack(ids, counts, list(range(62)), 1 << 20, 5)
    read = []

    def part(at, n):
        read.append(n)
        return data[at : at + n]

    shard = token_files.Shard(part)
    assert len(shard.rules) and shard.n_symbols < len(ids)
    at = 0
    for i, n in enumerate(counts):
        read.clear()
        assert (shard.document(i) == ids[at : at + n]).all()
        assert sum(read) <= 16 + 3 * n  # its offsets and symbols, nothing else
        assert [shard.token(i, k) for k in range(0, n, 7)] == ids[at : at + n : 7].tolist()
        at += n
    assert [(d, x.tolist()) for d, x in shard.documents(7)] == [(i, x.tolist()) for i, x in enumerate(np.split(ids, np.cumsum(counts)[:-1]))]


def test_repair_leaves_no_frequent_pair():
    """No cap on rounds or rules: what is left occurs fewer than ``least`` times, or only across documents or overlapping with itself."""
    from collections import Counter

    rng = np.random.default_rng(1)
    counts = [400] * 50
    passage = rng.integers(0, 5000, 120).astype(np.int32)
    docs = [np.r_[rng.integers(0, 5000, 280).astype(np.int32), passage] for _ in counts]
    x, starts, rules = token_files.repair(np.concatenate(docs), np.cumsum(counts), 1 << 20, 5)
    left = Counter()
    for a, b in zip(starts, [*starts[1:], len(x)]):
        left.update(zip(x[a : b - 1].tolist(), x[a + 1 : b].tolist()))
    assert max(n for (a, b), n in left.items() if a != b) < 5
    assert max(token_files.expansion_lengths(rules, 1 << 20)) == 120  # the shared passage is one symbol


def test_token_query_brute_force(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in queries.op2_token_files(spark, SMALL).collect()}
    at = 0
    for r in table(spark, SMALL, "documents").orderBy("doc_id").collect():
        ids = library.encode(r.text, add_special_tokens=False).ids + [2]
        x = got[r.doc_id]
        assert (x.start, x.n_tokens, x.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_line_dedup(spark, odd):
    run = "One two three. Four five six. Seven eight. Nine ten. Eleven twelve."
    docs = spark.createDataFrame([(1, f"Head one. {run} Tail."), (2, f"Other\nstart here.\n{run}\nEnd of it."), (3, run), (4, "One two three. Four five six."), (5, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert got[1].n_deleted == 0 and got[4].n_deleted == 0 and got[5].text is None
    assert got[2].text == "Other\nstart here.\nEnd of it." and got[3].text == ""
    out = line_dedup.dedup(odd)
    assert out.count() == odd.count() and set(odd.columns) <= set(out.columns)
    assert line_dedup.dedup(odd.limit(0)).count() == 0
    names = {c: F.lit(c) for c in ("gone", "id", "_id", "_d1", "d1", "_units", "row", "n_units", "a.b")}
    clash = line_dedup.dedup(docs.withColumns(names))
    assert clash.columns == [*docs.columns, *(c for c in names if c != "n_units"), "n_units", "n_deleted"]
    assert {(r.doc_id, r.text, r.n_deleted) for r in clash.collect()} == {(i, r.text, r.n_deleted) for i, r in got.items()}
    assert {(r.gone, r.row, r["a.b"]) for r in clash.collect()} == {("gone", "row", "a.b")}


@pytest.mark.parametrize("kw", [(1, 5), (2, 4), (3, 3), (5, 1)])
def test_line_dedup_brute_force(spark, kw):
    """Runs of few different units, so that fingerprints tie and overlap; repeated rows and null ids."""
    random.seed(7)
    rows = [(i, " ".join(f"{random.choice('abc')}." for _ in range(random.randrange(0, 30)))) for i in range(40)]
    rows += [(None, rows[3][1]), (None, "q. r. s. t. u. v."), rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = {(r.doc_id, r.text): r.h for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()}
    seen, want = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, hashes[r])):
        u, away = t.split(), set()
        for s in range(len(u) - 4):
            if tuple(u[s : s + 5]) in seen:
                away |= set(range(s, s + 5))
            seen.add(tuple(u[s : s + 5]))
        want[i, hashes[i, t]] = " ".join(x for j, x in enumerate(u) if j not in away)
    got = line_dedup.dedup(docs.withColumn("h", F.xxhash64("text"))).collect()
    assert len(got) == len(rows)
    assert all(r.text == want[r.doc_id, r.h] for r in got)


def test_line_dedup_tells_documents_apart(spark):
    """Rows without doc_id are told apart by all of their text: two whose 32-bit hashes agree,
    of which one repeats a run and the other nothing, don't share the deletion."""
    run = "Aa bb. Cc dd. Ee ff. Gg hh. Ii jj. "
    own = F.concat(*[x for c in "abcdef" for x in (F.lit("V"), F.col("id"), F.lit(f"{c}. "))])
    tries = spark.range(150_000).select(F.concat(F.lit(run), F.lit("Un"), "id", F.lit("a.")).alias("a"), own.alias("b"))
    twin = tries.select("a", F.hash("a").alias("h")).join(tries.select("b", F.hash("b").alias("h")), "h").orderBy("a", "b").first()
    docs = spark.createDataFrame([(1, run), (None, twin.a), (None, twin.b)], "doc_id long, text string")
    got = {r.text for r in line_dedup.dedup(docs).collect()}
    assert got == {run, twin.a[len(run) :], twin.b}


def test_line_dedup_blank_texts(spark):
    """A text without words has no units and takes a moment, however long."""
    blank = [" " * 1_000_000, "\n" * 300_000, "\t \r\n" * 100_000]
    rows = [(i, t) for i, t in enumerate([*blank, blank[0] + "word.", "a" + blank[0] + "b", "c." + blank[1], ""])]
    for content in (False, True):
        began = time.time()
        got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), content=content).collect()}
        assert time.time() - began < 60
        assert [got[i].n_units for i in (0, 1, 2, 3, 5, 6)] == [0, 0, 0, 1, 1, 0] and got[4].n_units in (1, 1 + content)
        assert all(got[i].text == t for i, t in rows)


def test_line_dedup_stock_passage(spark):
    """Different runs around one passage of three units, whose fingerprint is low enough to be selected: none may pass for another."""
    docs = spark.range(400_000).selectExpr("id AS doc_id", "concat('A', id, '. B', id, '. Stock 53. Stock text. Stock end. C', id, '. D', id, '.') AS text")
    assert line_dedup.dedup(docs).where("n_deleted > 0").count() == 0


def test_line_dedup_counts_units_once(spark):
    """Unit numbers of texts that stay come from the hashes, also of repeated rows and without doc_id."""
    long = " ".join(f"Line {j} says this." for j in range(9))
    rows = [(1, long), (1, long), (2, "Before. " + long), (None, "One. Two. Three. Four. Five. Six."), (3, "Short one. Two."), (4, None), (5, " \n"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.id, r.n): r.gone for r in line_dedup.deleted(docs).collect()}
    assert {k for k, gone in found.items() if gone is None} == {(1, 9), (None, 6)} and sorted(found[2, 10]) == [1, 2, 3, 4, 5]
    got = sorted((r.doc_id or 0, r.n_units, r.n_deleted, r.text) for r in line_dedup.dedup(docs).where("text IS NOT NULL").collect())
    assert got == [(0, 6, 0, rows[3][1]), (1, 9, 0, long), (1, 9, 0, long), (2, 10, 9, "Before."), (3, 2, 0, rows[4][1]), (5, 0, 0, " \n")]
    assert docs.where("text IS NULL").select(line_dedup.units(F.col("text")).alias("u")).collect() == [(None,), (None,)]


def test_line_dedup_passages_mid_sentence(spark):
    """Passages of over 50 words inside other sentences: units by content meet again."""
    random.seed(8)
    said = lambda n: [random.choice("abcdefgh") + str(random.randrange(10**6)) for _ in range(n)]
    rows = []
    for _ in range(100):
        passage = said(60)
        rows += [(len(rows) + i, " ".join(said(random.randrange(40, 80)) + passage + said(30))) for i in range(2)]
    rows += [(1000, " ".join(said(80)) + " \x01 x\x01 y"), (1001, " \n "), (1002, None), (1003, "  one\ttwo\nthree  ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cut = docs.select("doc_id", line_dedup.units(F.col("text"), True).alias("u")).collect()
    texts = dict(rows)
    assert all(r.u is None or "".join(r.u) == texts[r.doc_id] or not texts[r.doc_id].strip() for r in cut)  # units are the text
    out = {r.doc_id: r.n_deleted for r in line_dedup.dedup(docs, content=True).collect()}
    plain = {r.doc_id: r.n_deleted for r in line_dedup.dedup(docs).collect()}
    assert sum(out[i] > 0 for i in range(1, 200, 2)) >= 90 > sum(plain[i] > 0 for i in range(1, 200, 2))
    assert not any(out[i] for i in [*range(0, 200, 2), 1000, 1001, 1002, 1003])


def test_merkle(spark, odd):
    text = "\n".join(f"Paragraph {i} says something. And more of it." for i in range(40))
    edited = text.replace("Paragraph 20 says", "Paragraph 20 denies")
    a, b = merkle.fingerprint(text), merkle.fingerprint(edited)
    assert merkle.likeness(a, a) == 1 and 0.9 < merkle.likeness(a, b) < 1 and merkle.likeness(a, merkle.fingerprint("zz")) == 0
    one, other = merkle.differing(a, b)
    assert 1 <= len(one) <= 2 and 1 <= len(other) <= 2 and a[:20] != b[:20]  # the edited sentence, alone or with its neighbour
    assert "".join(merkle.CUT.findall("x" * 999 + ". no end\n")) == "x" * 999 + ". no end\n"
    check_neighbours(spark, odd)
    assert merkle.neighbours(odd.limit(0)).count() == 0


def check_neighbours(spark, docs):
    """Against a plain walk in the documented order."""
    rows = [(r.doc_id, r.text or "", r.z) for r in docs.selectExpr("doc_id", "text", "xxhash64(text) AS z").collect()]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)
    want = []
    for k, (i, t, _) in enumerate(rows):
        n = rows[(k + 1) % len(rows)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        prints = [merkle.fingerprint(x) for x in (t, e, n)]
        want.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), *prints[:2], merkle.likeness(prints[0], prints[1]), merkle.likeness(prints[0], prints[2])))
    assert sorted(map(str, (tuple(r) for r in merkle.neighbours(docs).collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("n", [1, 3, 2000])
def test_merkle_partitions(spark, odd, n):
    spark.conf.set("spark.sql.shuffle.partitions", n)
    try:
        none = [(None, f"text {i} without id") for i in range(30)]
        docs = odd.select("doc_id", "text").union(spark.createDataFrame(none + [(9 + i, f"Text {i}. " * i) for i in range(300)], "doc_id long, text string"))
        check_neighbours(spark, docs.coalesce(2))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def plain_pieces(text):
    """Sections of paragraphs of pieces, as the docstring says, as texts."""
    sections, held = [], []
    for line in text.splitlines(keepends=True):
        pieces, open_ = [], ""
        for sentence in merkle.CUT.findall(line):
            open_ += sentence
            if len(open_) >= merkle.PIECE or zlib.crc32(sentence.encode()) % 2 == 0:
                pieces, open_ = [*pieces, open_], ""
        held.append([*pieces, open_] if open_ else pieces)
        whole = [hashlib.blake2b(p.encode(), digest_size=16).digest() for p in held[-1]]
        h = whole[0] if len(whole) == 1 else hashlib.blake2b(b"".join(whole), digest_size=16).digest()
        if not line.strip() or h[0] % 8 == 0:
            sections.append(held)
            held = []
    return [*sections, held] if held else sections


def plain_likeness(a, b):
    """Share of text under equal sections, then equal paragraphs, then equal pieces."""
    if a == b:
        return 1.0
    common, x, y = 0, plain_pieces(a), plain_pieces(b)
    size = lambda node: len(node) if isinstance(node, str) else sum(map(size, node))
    for _ in range(3):
        left = []
        for node in x:
            if node in y:
                y.remove(node)
                common += size(node)
            else:
                left.append(node)
        x, y = ([child for node in side for child in node] for side in (left, y))
    return 2.0 * common / (len(a) + len(b))


def test_merkle_query_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").orderBy("doc_id", ascending=False).collect()]
    got = {r.doc_id: r for r in queries.op4_merkle(spark, SMALL).collect()}
    roots = {}
    for k, (i, t) in enumerate(docs):
        n = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + n[:half]
        x = got[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert x.near_edited == plain_likeness(t, e) and x.near_next == plain_likeness(t, n)
        for text, print_ in ((t, x.fingerprint), (e, x.edited_fingerprint)):
            assert roots.setdefault(print_, text) == text  # equal fingerprints: equal texts
            assert merkle.encoded(*merkle.from_string(print_)) == print_
    assert {t for _, t in docs} <= set(roots.values()) and len(set(roots.values())) == len(roots)


def test_merkle_is_small(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").limit(1000)
    size = merkle.fingerprints(docs).agg(F.sum(F.length("fingerprint")).alias("f"), F.sum(F.octet_length("text")).alias("t")).first()
    assert size.f <= 0.25 * size.t


def test_ordinal_grades():
    rng = np.random.default_rng(3)
    labels, cells = [], []
    for i in range(900):
        bad = int(rng.integers(0, 3))
        labels.append((i, bad))
        cells += [(i, f"bad{j}", 1.0) for j in range(bad)] + [(i, f"w{int(rng.integers(0, 50))}", 1.0)]
    model = toxicity.solve(pd.DataFrame(labels, columns=["doc_id", "grade"]), pd.DataFrame(cells, columns=["doc_id", "word", "x"]))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]
    assert model.expected("") < model.expected("bad0") < model.expected("bad0 bad1")
    assert toxicity.Ordinal().expected(None) == 0


def test_toxicity_query(spark):
    """The registered query scores every document by the formula and cuts where the fit says."""
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels").selectExpr("doc_id", "toxic AS grade")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: (r.severity, r.toxic) for r in queries.op5_toxicity(spark, SMALL).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        words = toxicity.WORDS.findall(r.text.lower())
        z = sum(w * math.log(1 + 200 * words.count(x) / len(words)) for x, w in model.weights.items() if x in words)
        severity = sum(1 / (1 + math.exp(t - z)) for t in model.thresholds)
        assert abs(got[r.doc_id][0] - severity) < 1e-9 and got[r.doc_id][1] == (got[r.doc_id][0] >= model.cut)


def test_toxicity_cut_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels").selectExpr("doc_id", "toxic AS grade")
    model = toxicity.fit(docs, labels.where("doc_id % 4 <> 1"))
    rows = toxicity.score(docs, model).join(labels.where("doc_id % 4 = 1"), "doc_id").select("grade", toxicity.toxic(model).alias("p")).collect()
    caught, rejected = ([r.p for r in rows if (r.grade > 0) == t] for t in (True, False))
    print(model.cut, sum(caught), len(caught), sum(rejected), len(rejected))
    assert sum(caught) / len(caught) >= 0.9
    assert sum(rejected) / len(rejected) < 0.01


def test_toxicity_brute_force(spark):
    """Scores by the formula, word by word; the fit against a dense loss and plain gradient steps."""
    import math

    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels").selectExpr("doc_id", "toxic AS grade")
    model = toxicity.fit(docs, labels, least_documents=1)
    for r in toxicity.score(docs, model).collect():
        words = toxicity.WORDS.findall(r.text.lower())
        z = sum(w * math.log(1 + 200 * words.count(x) / len(words)) for x, w in model.weights.items() if x in words)
        assert abs(r.severity - sum(1 / (1 + math.exp(t - z)) for t in model.thresholds)) < 1e-9
    rng = np.random.default_rng(5)
    x = (rng.random((200, 6)) < 0.3) * rng.random((200, 6))
    grade = np.clip((x @ np.array([6, 3, 0, 0, -4, 0]) + rng.normal(0, 0.3, 200)).round(), 0, 2).astype(int)
    cells = pd.DataFrame([(i, f"f{j}", x[i, j]) for i in range(200) for j in range(6) if x[i, j]], columns=["doc_id", "word", "x"])
    got = toxicity.solve(pd.DataFrame({"doc_id": range(200), "grade": grade}), cells, 2000)

    def loss(w, theta):
        p = 1 / (1 + np.exp(np.clip(np.array(theta)[None] - (x @ w)[:, None], -60, 60)))
        above = grade[:, None] > np.arange(2)[None]
        return -np.where(above, np.log(p), np.log(1 - p)).sum() / 200 + 2e-4 * np.abs(w).sum()

    w, theta = np.zeros(6), np.array([0.0, 1.0])
    for _ in range(6000):
        p = 1 / (1 + np.exp(theta[None] - (x @ w)[:, None]))
        slope = p - (grade[:, None] > np.arange(2)[None])
        w -= 2.0 * (x.T @ slope.sum(1) / 200 + 2e-4 * np.sign(w))
        theta += 2.0 * slope.sum(0) / 200
    mine = np.array([got.weights.get(f"f{j}", 0.0) for j in range(6)])
    assert loss(mine, got.thresholds) < loss(w, theta) * 1.02


def test_toxicity_is_the_same_each_time(spark):
    docs = spark.createDataFrame([(i, f"{'bad' if i % 3 == 0 else 'good'} word {i % 7}") for i in range(60)] + [(3, "good other"), (4, "bad other")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(3, 0), (4, 1), (4, 0)], "doc_id long, grade int")
    models = [toxicity.fit(d, g) for d, g in ((docs, labels), (docs.orderBy(F.desc("text")).repartition(3), labels.repartition(3)))]
    assert models[0] == models[1] and models[0].expected("bad word") > models[0].expected("good word")
    assert toxicity.score(docs.limit(0), models[0]).count() == 0 and toxicity.fit(docs.limit(0), labels) == toxicity.Ordinal()
    again = toxicity.score(docs.union(docs.limit(1)).withColumn("severity", F.lit("own")), models[0])
    assert again.count() == 63 and dict(again.dtypes)["severity"] == "double"


def test_toxicity_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, grade int")
    assert toxicity.fit(odd, none) == toxicity.Ordinal()
    model = toxicity.fit(odd, spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, grade int"))
    assert {r.severity for r in toxicity.score(odd, model).collect()} == {1.0}


def test_license_scan(spark, odd):
    text = "Noise before it. This work is licensed under the GNU General Public License, version 3. Noise after"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "Licensed under"), (1, text)], "doc_id long, text string")
    assert [tuple(r) for r in license_scan.scan(docs).collect()] == [(1, "GPL-3.0", 1.0)]
    grant = dict(license_scan.TEMPLATES)["MIT-grant"].replace("files", "papers")
    assert license_scan.scan(spark.createDataFrame([(1, "z " * 30 + grant)], "doc_id long, text string")).first().license == "MIT-grant"
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(docs, []).count() == 0 and license_scan.scan(docs.limit(0)).count() == 0
    twice = license_scan.scan(docs.withColumn("license", F.lit("own")), [("b", text), ("a", text), ("a", text), (None, "short")], block_chars=1).collect()
    assert sorted(tuple(r) for r in twice) == [(1, "a", 1.0), (1, "b", 1.0)]  # ties
    assert [len(b) for b in license_scan._blocks([("l", "x" * n) for n in (4, 3, 3, 9, 1)], 7)] == [2, 1, 1, 1]


def test_license_scan_brute_force(spark):
    """Whole and edited notices at every offset, against all spans."""
    templates = license_scan.TEMPLATES + [("long", " ".join(f"term{i}" for i in range(63))), ("again", "as is and with all faults " * 3 + "as is")]
    cut = lambda t: (lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)])("".join(c if c.isalnum() else " " for c in t.lower()).split())
    random.seed(4)
    rows = []
    for _, t in templates:
        w = t.split()
        for k in range(24 if len(w) < 80 else 6):
            rows.append(" ".join([f"x{len(rows)}y{i}" for i in range(k)] + w + [f"z{len(rows)}y{i}" for i in range(9)]))
        for k in range(60):
            e = list(w)
            for _ in range(1 + k % 3):
                i = random.choice([random.randrange(len(e)), random.randrange(4), len(e) - 1 - random.randrange(4)])
                e[i : i + 1] = random.choice([["other"], [], [e[i], "more"]])
            rows.append(" ".join([f"x{len(rows)}y{i}" for i in range(k)] + e))
    for _, t in license_scan.TEMPLATES:
        rows += [f"a{len(rows)}b c{len(rows)}d e{i} f{i} g{i} {t} h{i} k{i} l{i} m{i}" for i in range(60)]
    want = {}
    for name, t in templates:
        ts = set(cut(t))
        span = len(ts) + len(ts) // 4
        for d, text in enumerate(rows):
            s = cut(text)
            share = max((len(ts & set(s[i : i + span])) / len(ts) for i, x in enumerate(s) if x in ts), default=0)
            if share >= 0.8:
                want[d, name] = round(share, 6)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for more in ({}, {"block_chars": 150}):  # no match depends on blocks
        got = license_scan.scan(docs, templates, **more).collect()
        assert len(got) == len(want)
        assert {(r.doc_id, r.license): round(r.containment, 6) for r in got} == want


def test_license_scan_bound(spark):
    """Copies edited down to the threshold: all bands find 99.5% of them at least, one band fewer."""
    rng = random.Random(9)
    templates = [(f"t{n}", " ".join(f"t{n}w{i}" for i in range(n + 4))) for n in (16, 20, 40, 63, 64, 100, 300)]
    rows = []
    for _ in range(120):
        for name, t in templates:
            w = t.split()
            n = len(w) - 4
            for _ in range(max(1, int(n * 0.2 / 5))):  # a changed word takes five shingles at most
                w[rng.randrange(len(w))] = f"other{len(rows)}"
            rows.append((len(rows), name, " ".join([f"b{len(rows)}x{i}" for i in range(rng.randrange(40))] + w + [f"a{len(rows)}x{i}" for i in range(rng.randrange(40))])))
    edge = {}
    for i, name, text in rows:
        ts, s = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (dict(templates)[name].split(), text.split()))
        edge[i] = len(ts & s) / len(ts)
    want = {(i, name) for i, name, _ in rows if edge[i] >= 0.8}
    assert len(want) > 600 and sum(edge[i] < 0.85 for i, _ in want) > 300
    docs = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string")
    found = [{(r.doc_id, r.license) for r in license_scan.scan(docs, templates, **more).collect()} for more in ({}, {"bands": 1})]
    assert found[0] <= want and len(found[0]) >= 0.995 * len(want)
    assert len(found[1]) < len(found[0])


def test_license_scan_long_template(spark):
    """A template of 6,000 words, with repetition, in seconds; a text that holds it three times, and one of half of it."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(800)}" for _ in range(6000)]
    long, other = " ".join(words), " ".join(f"o{rng.randrange(10**6)}" for _ in range(20_000))
    docs = spark.createDataFrame([(1, f"{other} {long} {long} x {long}"), (2, " ".join(words[:3000])), (3, " ".join(words[:5000])), (4, other)], "doc_id long, text string")
    began = time.time()
    got = {r.doc_id: round(r.containment, 2) for r in license_scan.scan(docs, [("long", long)]).collect()}
    assert got == {1: 1.0, 3: 0.83} and time.time() - began < 60


@pytest.mark.parametrize("bounds", [(1 << 15, 1 << 20), (3, 1 << 20), (0, 0)])
def test_byte_bpe(spark, odd, bounds):
    import tiktoken

    codec = bpe.ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, *bounds)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    random.seed(9)
    more = ["=AB,=12, 1=2", "\x01\x02 \x00\u0100 =", "word=word " * 3, "".join(random.choice("aeiou\u00e9xyz") for _ in range(60_000))]
    docs = odd.union(spark.createDataFrame([(30 + i, t, None, None, 0, None) for i, t in enumerate(more)], SCHEMA)).withColumn("row", F.lit(1)).withColumn("x", F.lit(2)).withColumn("ids", F.lit("own"))
    out = codec.encode(docs)
    assert out.columns == docs.columns
    rows = out.select("text", "ids", codec.decode(out["ids"]).alias("b")).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.b) == (r.text or "").encode()
    assert codec.encode(odd.limit(0)).count() == 0


def test_byte_bpe_query_brute_force(spark):
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in queries.op7_byte_bpe(spark, SMALL).collect()}
    docs = table(spark, SMALL, "documents").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids, x = library.encode_ordinary(r.text), got[r.doc_id]
        assert (x.n_tokens, x.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert x.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_byte_bpe_long_words():
    import tiktoken

    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    random.seed(2)
    for word in ["a" * 5000, "x", "ab" * 700, *("".join(random.choice("etaoin\u00e9\u00fc") for _ in range(n)) for n in (2, 3, 50, 3000))]:
        assert bpe.merge(word.encode(), ranks) == library.encode_ordinary(word)


def test_byte_bpe_displaced_pairs(spark):
    """Each pair lies in one place that names its left id, and the fold agrees with the heap."""
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    pairs, out = bpe.pair_ranks(ranks)
    at, table = bpe.displaced(pairs, out)
    known = dict(zip(pairs, out))
    random.seed(3)
    some = [*known, *(random.randrange(len(at)) << 32 | random.randrange(50_000) for _ in range(200_000))]
    for a, b in ((k >> 32, k & 0xFFFFFFFF) for k in some):
        x = table[at[a] + b] if 0 <= at[a] + b < len(table) else -1
        assert (x & (1 << bpe.ID) - 1 if x >> bpe.ID == a else None) == known.get(a << 32 | b)
    assert bpe.displaced(*bpe.pair_ranks({b"a": 0, b"b": 1}))[1].tolist() == []
    words = ["a", "\u00e9", "\u0100\u4e00", *("".join(random.choice("etaoin\u00e9\u00fc zq") for _ in range(n)) for n in (2, 5, 63, 64, 200, 1000))]
    codec = bpe.ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    with bpe.short_plans(spark):
        for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", codec.fold(F.col("w")).alias("ids")).collect():
            assert r.ids == bpe.merge(r.w.encode(), ranks)


def test_decontamination(spark, odd, bench):
    got = {(r.doc_id, r.n_words): r for r in decontaminate.hits(odd, bench).collect()}
    assert got[8, 5000].hit_words == list(range(5000)) and got[8, 5000].items == ["1"]
    assert got[3, 1].hit_words == [0] and got[3, 1].items == []
    assert decontaminate.hits(odd, bench).count() == odd.count()
    one, many = (sorted((str(r) for r in decontaminate.hits(odd, bench, max_broadcast=m).collect())) for m in (100, 1))
    assert one == many
    left = decontaminate.remove(odd, bench)
    assert left.columns == odd.columns and left.where("doc_id IN (3, 8)").count() == 0
    cut = {r.doc_id: r.text for r in decontaminate.remove(odd, bench, spans=True).collect()}
    assert cut[8] == "" and cut[6] == ODD[6]
    nothing = decontaminate.hits(odd, bench.limit(0))
    assert nothing.count() == odd.count() and decontaminate.hits(odd.limit(0), bench).count() == 0


def test_jaccard_join(spark, odd):
    random.seed(5)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for g in range(25):
        base = [random.choice(words) for _ in range(random.choice([3, 8, 40, 200, 700]))]
        for _ in range(6):
            t = list(base)
            for _ in range(random.choice([0, 1, max(1, len(t) // 60), len(t) // 20])):
                t[random.randrange(len(t))] = random.choice(words)
            rows.append((len(rows), " ".join(t)))
    sets = {}
    for i, t in rows:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 3]) for j in range(len(w) - 2)}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 90 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for more in ({}, {"block_chars": 500}):
        got = {r.doc_id: (r.component_id, r.n_shingles) for r in jaccard_join.join(docs, **more).collect()}
        assert got == {i: (find(i), len(sets[i])) for i in sets}
    out = jaccard_join.join(odd)
    assert out.count() == odd.count()
    assert {r.doc_id: r.component_id for r in out.collect()}[5] == 4
    assert jaccard_join.keep_one(odd).columns == odd.columns and jaccard_join.join(odd.limit(0)).count() == 0


def test_jaccard_ids_and_copies(spark):
    """Rows without doc_id connect others; rows that share a doc_id are compared by their own texts."""
    words = [f"w{i}" for i in range(300)]

    def text(*changed):
        return " ".join("x" + w if i in changed else w for i, w in enumerate(words))

    a, b, c = text(), text(20, 50, 80), text(20, 50, 80, 110, 140, 170)
    sets = [{tuple(t.split()[i : i + 3]) for i in range(298)} for t in (a, b, c)]
    share = lambda x, y: len(x & y) / len(x | y)
    assert share(sets[0], sets[1]) >= 0.9 <= share(sets[1], sets[2]) and share(sets[0], sets[2]) < 0.9
    docs = spark.createDataFrame([(1, a), (None, b), (3, c), (4, "other words here"), (4, c), (5, "other words here"), (None, "lone text without id"), (6, None)], "doc_id long, text string")
    got = sorted(str((r.doc_id, r.component_id)) for r in jaccard_join.join(docs).collect())
    assert got == sorted(str(x) for x in [(1, 1), (None, 1), (3, 1), (4, 4), (4, 1), (5, 4), (None, None), (6, 6)])
    near = spark.createDataFrame([(i % 20, text(*range(i, 300, 40)) if i >= 20 else f"unrelated {i} {i * 7} {i * 11}") for i in range(40)] + [(50 + i, text(*range(20 + i, 300, 40), 5)) for i in range(20)], "doc_id long, text string")
    linked = {r.doc_id: r.component_id for r in jaccard_join.join(near).where("doc_id >= 50").collect()}
    assert all(v == k - 50 for k, v in linked.items())  # none is lost though each id has another text as well
    rows = jaccard_join.keep_one(docs.union(docs.where("doc_id = 1")).withColumn("whole", F.lit("own")).withColumn("row", F.lit("r")))
    assert rows.columns == ["doc_id", "text", "whole", "row"]
    assert sorted(str((r.doc_id, r.text and len(r.text))) for r in rows.collect()) == sorted(str(x) for x in [(1, len(a)), (4, 16), (None, 20), (6, None)])


def test_jaccard_large_components(spark):
    """Links only through one text, or along a chain, over many blocks; what is linked isn't compared again."""
    words = [f"w{i}" for i in range(100)]

    def text(*changed):
        return " ".join("x" + w if i in changed else w for i, w in enumerate(words))

    star = [(100 + i, text(3 * i)) for i in range(30)] + [(7, text())]
    chain = [(200 + i, text(*range(4, 4 + 9 * i, 9))) for i in range(1, 10)]
    far = [(300 + i, text(*range(i, 100, 9))) for i in range(3)]
    rows = star + chain + far
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(98)} for i, t in rows}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sum(find(i) == 7 for i in sets) == 40
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block_chars in (300, 2000, 100_000):
        assert {r.doc_id: r.component_id for r in jaccard_join.join(docs, block_chars=block_chars).collect()} == {i: find(i) for i in sets}
    texts = spark.createDataFrame([("c", k, "t", 10) for k in "abcd"], "c string, k string, text string, size long")
    linked = lambda *e: spark.createDataFrame(list(e), "a string, b string")
    assert jaccard_join._rest(texts, linked(("a", "b"), ("b", "c"), ("c", "d")), 10)[0].count() == 0
    out = {r.k: (r.b, r.lead, r.nb) for r in jaccard_join._rest(texts, linked(("a", "b"), ("b", "d")), 10)[0].collect()}
    assert out["c"] == (0, 1, 4) and all(1 <= out[k][0] < 4 for k in "abd")


@pytest.mark.parametrize("similarity", [(90, 100), (80, 100), (50, 100)])
def test_jaccard_signatures_are_complete(similarity):
    """Any two sets at the threshold share a signature, small and large, whatever parts are empty."""
    rng = np.random.default_rng(11)
    band, (num, den) = jaccard_join.Bands(similarity), similarity
    for size in [*range(1, 60), 100, 311, 1000] if num > 50 else [*range(1, 30), 100]:
        most = size * (den - num) // den
        for _ in range(12):
            items = rng.integers(0, 1 << 63, size * 2 + 2, dtype=np.uint64)
            out = int(rng.integers(0, most + 1))
            other = np.r_[items[: size - out], items[size : size + int(rng.integers(0, most + 1))]]
            x, y = np.unique(items[:size]), np.unique(other)
            both = len(np.intersect1d(x, y))
            if den * both >= num * (len(x) + len(y) - both):
                assert len(np.intersect1d(jaccard_join.signatures(x, band), jaccard_join.signatures(y, band)))


def test_jaccard_choice():
    """Single parts where differences are few; larger subsets of more parts where they are many."""
    few, many = jaccard_join.chosen(105, 1000), jaccard_join.chosen(660, 1000)
    assert few[0] * math.comb(few[2], few[1]) < 1.2 * 106 and few[2] - few[1] == 1
    assert many[2] - many[1] > 1
    count = lambda n, s: len(jaccard_join.signatures(np.arange(n, dtype=np.uint64) * jaccard_join.A1, jaccard_join.Bands(s)))
    assert count(1000, (90, 100)) < 300 and count(1000, (80, 100)) < 660  # 390 and 884 with three parts each
    assert sum(count(n, (80, 100)) for n in range(100, 1000, 7)) < 0.7 * sum(range(100, 1000, 7))  # sparse sets don't sign again and again


def test_jaccard_batch_chains():
    """Of the rows that share a signature the first takes it along, the others name that row."""
    i = np.array([70, 71, 72, 73])
    sig, near = jaccard_join._taken([np.array([5, 9]), np.array([9, 11]), np.array([], np.int64), np.array([5, 11, 12])], i)
    assert [x.tolist() for x in sig] == [[5, 9], [11], [], [12]]
    assert [x.tolist() for x in near] == [[], [70], [], [70, 71]]


def test_jaccard_sketches_sieve_no_link():
    """Sets that link, or whose followers do, pass; of others of one size hardly any."""
    rng, links = np.random.default_rng(5), 0
    for num, den in ((90, 100), (80, 100), (50, 100)):
        for size in (1, 2, 5, 31, 33, 100, 700):
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            sets = [np.unique(np.r_[base[rng.random(size) > 0.15 * (j % 3)], rng.integers(0, 1 << 63, j % 4 * size // 20, dtype=np.uint64)]) for j in range(12)]
            sets = [s if len(s) else base for s in sets] + [np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))]
            linked = lambda a, b: den * len(np.intersect1d(sets[a], sets[b])) >= num * len(np.union1d(sets[a], sets[b]))
            leaders = jaccard_join.Leaders(sets, num, den)
            led = {a: [a, *(b for b in range(a + 1, 13) if (a + b) % 2 and leaders(a, b))] for a in range(13)}
            bits, reach = jaccard_join._folded([jaccard_join.odd_sketch(s) for s in sets]), leaders.reach()
            for a in range(13):
                for b in range(a):
                    passes = (den + num) * np.bitwise_count(bits[a] ^ bits[b]).sum(dtype=np.int64) <= reach[a] + reach[b]
                    if any(linked(x, y) for x in led[a] for y in led[b]):
                        links += 1
                        assert passes
            if size == 700 and num >= 80:
                alone = jaccard_join.Leaders(sets, num, den).reach()
                assert all((den + num) * np.bitwise_count(bits[12] ^ x).sum(dtype=np.int64) > alone[12] + r for x, r in zip(bits[:12], alone))
    assert links > 500


def test_jaccard_stock_phrases_move_no_texts(spark, monkeypatch):
    """Texts that share stock phrases, and so signatures, but don't link aren't candidates."""
    rng = random.Random(3)
    stock = [" ".join(f"s{rng.randrange(10**6)}" for _ in range(8)) for _ in range(6)]
    rows = [(i, " ".join(rng.choice(stock) if j % 3 == 0 else f"u{rng.randrange(10**9)}" for j in range(rng.randrange(9, 40)))) for i in range(3000)]
    rows += [(5000, rows[7][1] + " x"), (5001, rows[2900][1])]
    counts, written = {}, jaccard_join.written

    def counted(df, name, *by):
        out = written(df, name, *by)
        counts[name] = max(out.count(), counts.get(name, 0))
        return out

    monkeypatch.setattr(jaccard_join, "written", counted)
    monkeypatch.setattr(jaccard_join, "ROWS", 64, raising=False)
    got = jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), similarity=(80, 100)).collect()
    ids = {r.doc_id: r.component_id for r in got}
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows}
    assert 10 * len(sets[7] & sets[5000]) >= 8 * len(sets[7] | sets[5000]) and ids[5000] == 7 and ids[5001] == 2900
    assert counts["members"] < 0.2 * len(rows)


def test_jaccard_many_near_copies(spark):
    """100,000 different sets that share a signature: no window or comparison grows with their square."""
    words = " ".join(f"w{i}" for i in range(70))
    copies = spark.range(100_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(words + " k"), "id").alias("text"))
    far = spark.range(100_000, 100_050).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit(f"z{j}q"), "id") for j in range(70)]).alias("text"))
    began = time.time()
    got = jaccard_join.join(copies.union(far)).groupBy("component_id").count().collect()
    assert sorted(r["count"] for r in got)[-1] == 100_000 and len(got) == 51
    assert time.time() - began < 400


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="ad-free">
<nav><ul><li>Menu</li></ul></nav><div class="ad">Buy</div><div class="strip">Same %s everywhere</div><div id="story"><h1>Head &amp; tail %d</h1><p><b>One<br>two
<p>Three   %d</div><div class="comments"><p>First!</p></div><form><p>Name</p></form><aside>Side</aside><footer>&copy; me</footer></body></html>"""


def test_token_files_words():
    """The model alone gives a word the ids that the library gives it."""
    e = token_files.Encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    random.seed(5)
    every = [chr(c) for a, b in token_files.SPANS for c in range(a, b + 1)]
    words = list({w for _ in range(300) for w in e.find("".join(random.choices(every + [" "] * 200 + list("etaoin") * 50, k=300)))}) + ["x" * 5000, " " * 900, "\n"]
    assert e.bare and list(e.word_ids(words)) == [x.ids for x in e.library.encode_batch(words, add_special_tokens=False)]


def test_bpe_short_plans(spark):
    """The literal tables aren't in the plans' descriptions, and the session is as before."""
    codec = bpe.ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    row = spark.createDataFrame([("1,20000,300",), ("",), (None,)], "ids string")
    both = row.select(codec.decode(bpe.parse_ids(F.col("ids"))).alias("a"), codec.decode_text(F.col("ids")).alias("b"), codec.fold_text(F.coalesce("ids", F.lit("null"))))

    def described(info):
        return len(info.simpleString()) + sum(described(info.children().apply(i)) for i in range(info.children().size()))

    plan = lambda: described(spark._jvm.org.apache.spark.sql.execution.SparkPlanInfo.fromSparkPlan(both._jdf.queryExecution().executedPlan()))
    before = spark.conf.get("spark.sql.debug.maxToStringFields"), spark.conf.get("spark.sql.maxPlanStringLength")
    assert plan() > 1_000_000
    with bpe.short_plans(spark):
        assert plan() < 10_000
    assert before == (spark.conf.get("spark.sql.debug.maxToStringFields"), spark.conf.get("spark.sql.maxPlanStringLength"))
    got = both.collect()
    assert all(r.a == r.b for r in got) and [r.a is None or len(r.a) for r in got][1:] == [0, True]


def test_jaccard_join_units(spark):
    """Signatures of the same rows give one unit of work; units of any size and batch give
    the pairs that their sketches allow."""
    rows = [(s, i) for s in range(40) for i in (7, 9)] + [(s, i) for s in (50, 51, 52) for i in (7, 9, 11)] + [(60, 7), (60, 11)]
    got = jaccard_join._different(spark.createDataFrame(rows, "s long, i long")).collect()
    assert {(r.s, r.k) for r in got} == {(0, 2), (50, 3), (60, 2)}
    rng = np.random.default_rng(3)
    common = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.r_[common[: rng.integers(30, 400)], rng.integers(0, 2**63, 8).astype(np.uint64)]) for _ in range(60)]
    sets += [np.unique(np.r_[common[:300], rng.integers(0, 2**63, 3).astype(np.uint64)]) for _ in range(20)]
    odd = [jaccard_join.odd_sketch(x) for x in sets]
    reach = jaccard_join.Leaders(sets, 90, 100).reach()
    allowed, units = lambda a, b: 190 * int(np.bitwise_count(np.bitwise_xor(*jaccard_join._folded([odd[a], odd[b]]))).sum()) <= reach[a] + reach[b], {}
    for s in range(150):
        units[s] = sorted(rng.choice(80, 2 if s % 3 else int(rng.integers(1, 6)), replace=False).tolist())
    frame = pd.DataFrame([(s, 0, 0, 0, i, reach[i], odd[i]) for s, u in units.items() for i in u], columns=["s", "x", "y", "b", "i", "reach", "odd"])
    want = {p for u in units.values() if len(u) == 2 for p in [tuple(u)] if allowed(*p)}
    assert want
    for size in (1, 7, 1000):
        batches = [frame.iloc[k : k + size] for k in range(0, len(frame), size)] + [frame.iloc[:0]]
        cut = [i.tolist() for i, _, _, _ in jaccard_join._units(iter(batches))]
        assert cut == list(units.values())
        got = {tuple(p) for f in jaccard_join._plausible(90, 100)(iter(batches)) for p in f.to_numpy().tolist()}
        assert want <= got <= {(a, b) for u in units.values() for a in u for b in u if a < b}
    two = frame[frame["s"].map(lambda s: len(units[s]) == 2)]
    assert {tuple(p) for f in jaccard_join._plausible(90, 100)(iter([two])) for p in f.to_numpy().tolist()} == want


def test_html_extract(spark):
    rows = [(i, f"http://host/{i}", PAGE % ("x", i, i)) for i in range(8)]
    rows += [(20, None, None), (21, "http://else/", "<article><header><h1>A</h1></header><p>B &am"), (22, "http://else/", "plain <i>te</i>xt"), (22, "http://else/", "plain <i>te</i>xt")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract(pages).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 12
    assert texts[3] == "Head & tail 3\n\nOne two\n\nThree 3"  # the strip says the same on every page
    assert texts[20] == "" and texts[21] == "A\n\nB &am" and texts[22] == "plain text"
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_html_copies_under_other_adverts(spark):
    page = '<html><body><div class="ad">Buy %s</div>%s</body></html>'
    story = "<article><h1>News</h1><p>%s</p></article>"
    near = '<main><div class="date">Day %s</div><div class="body"><p>%s</p></div></main>'
    bare = '<div class="strip">Same strip</div><div class="story"><p>%s</p></div>'
    texts = {"a": [story % "copied"] * 20 + [story % "one", story % "two"], "b": [near % (i, "copied") for i in range(20)] + [near % (20, "one")], "c": [bare % "copied"] * 20 + [bare % f"own {i}" for i in range(6)]}
    rows = [(i, f"http://{host}/{i}", page % (i, t)) for host, all in texts.items() for i, t in enumerate(all)]
    got = {r.url: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {got[f"http://a/{i}"] for i in range(20)} == {"News\n\ncopied"} and (got["http://a/20"], got["http://a/21"]) == ("News\n\none", "News\n\ntwo")
    assert got["http://b/3"] == "Day 3\n\ncopied" and got["http://b/20"] == "Day 20\n\none"
    assert got["http://c/0"] == "copied" and got["http://c/25"] == "own 5"  # the strip is a template still


def test_html_record_numbers_in_ids(spark):
    page = '<html><body><div id="post-%d"><div class="strip">Same strip</div><div class="story"><p>Own %d</p></div></div></body></html>'
    rows = [(i, "http://a/", page % (i, i)) for i in range(1000, 1008)]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Own {i}" for i in range(1000, 1008)}
    tree = [("a", 1, 9, 0.0), ("a", 2, 9, 0.5), ("a", 3, 2, 0.0)] + [("a", 100 + i, 1, 1.0) for i in range(1000)]
    nodes = html_extract.low_nodes(spark.createDataFrame(tree, "host string, path long, pages long, importance double"), 0.2, 3)
    assert [tuple(r) for r in nodes.collect()] == [("a", 1)]  # no path that stays comes along


def test_html_entropy_decides_on_hints(spark):
    """Parts of an article whose class hints at a box: those that say the same everywhere go, the others stay. Off, the tree removes nothing."""
    page = '<html><body><nav>Menu</nav><article><h1>Head %d</h1><section class="share-price"><p>Price %d</p></section><div class="share-box"><p>Share this</p></div><p>Same law</p><div class="comments"><p>First %d</p></div></article></body></html>'
    rows = [(i, f"http://{'big' if i < 9 else 'small'}/{i}", page % (i, i, i)) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "low": F.lit("y"), "k1": F.lit(1)})
    for more in ({}, {"broadcast_nodes": 0}):
        got = {r.page_id: r.text for r in html_extract.extract(pages, **more).collect()}
        assert got == {i: f"Head {i}\n\nPrice {i}\n\nSame law" for i in range(12)}
    off = {r.page_id: r.text for r in html_extract.extract(pages, least=0.0).collect()}
    assert off == {i: f"Head {i}\n\nPrice {i}\n\nShare this\n\nSame law\n\nFirst {i}" for i in range(12)}


def test_html_article_is_evidence(spark):
    """A teaser in an article element doesn't outweigh the text beside it; related sections and
    banners inside of an article stay where they differ from page to page and go where not."""
    teaser = '<html><body><nav>Menu</nav><div id="content"><h1>Head %d</h1><p>' + "Long own text %d. " * 30 + '</p></div><article><p>Teaser %d</p></article></body></html>'
    inner = '<html><body><article><h1>Head %d</h1><p>Text of %d is long enough.</p><section class="related"><p>Own %d</p></section><div class="banner"><p>%s</p></div></article><div>Beside %d</div></body></html>'
    rows = [(i, "http://t/", teaser % ((i,) * 32)) for i in range(6)]
    rows += [(10 + i, "http://i/", inner % (i, i, i, "Same for all", i)) for i in range(6)]
    got = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(6):
        assert got[i] == f"Head {i}\n\n" + " ".join([f"Long own text {i}."] * 30) + f"\n\nTeaser {i}"
        assert got[10 + i] == f"Head {i}\n\nText of {i} is long enough.\n\nOwn {i}"


def test_html_deep_pages(spark):
    """Pages of 20,000 elements inside each other take a moment, closed or not."""
    deep = ["<div>" * 20_000 + "text" + "</div>" * 20_000, "<div>x" * 20_000, "<ul><li>y" * 10_000, "<li>z" * 20_000, "<p>q" * 20_000, "<b>w</i>" * 20_000]
    began = time.time()
    pages = spark.createDataFrame([(i, "http://deep/", t) for i, t in enumerate(deep)], "page_id long, url string, html string")
    got = {r.page_id: r.n_chars for r in html_extract.extract(pages, least=0.0).collect()}
    assert time.time() - began < 60 and got[0] == 4 and got[1] == got[3] == got[4] == 3 * 20_000 - 2


def test_html_tree_decides(spark):
    """On the given pages the tree removes what isn't the article: off, its parts come along."""
    d = "/root/testdata/sf0.01"
    on, off = ({r.page_id: r.n_chars for r in html_extract.extract(table(spark, d, "pages"), **more).collect()} for more in ({}, {"least": 0.0}))
    assert sum(on[i] < off[i] for i in on) > len(on) / 2 and all(on[i] <= off[i] for i in on)


def test_html_without_article(spark):
    """Three pages are enough to know a host's menu and last line; a page of 2 MB and repeated rows."""
    page = '<html><body><div class="top"><p>Home Shop</p></div><div class="text"><p>%s</p></div><div class="end"><p>All rights</p></div></body></html>'
    rows = [(i, f"http://h/{i}", page % (f"Own {i} " * (300_000 if i == 2 else 1))) for i in range(3)]
    rows += [rows[0], (7, "http://other/", page % "alone")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(0, 5), (0, 5), (1, 5), (2, 1_799_999), (7, len("Home Shop\n\nalone\n\nAll rights"))]


def test_html_is_the_article(spark):
    import html
    import re

    got = {r.page_id: r.text for r in queries.op10_html_extract(spark, SMALL).collect()}
    for r in table(spark, SMALL, "pages").collect():
        body = r.html.split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        body = re.sub(r"<[^>]*>|<[/a-z][^>]*$", "", re.sub(r"<(/?p|/?h1)>", "\n", body))
        blocks = (" ".join(html.unescape(b).split()) for b in body.split("\n"))
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_jaccard_signs_in_pieces(monkeypatch):
    """A batch of many rows is signed piece by piece, the same links stay, and memory goes back after each."""
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 2)  # noqa: N815

    given = []
    monkeypatch.setattr(jaccard_join, "TaskContext", Task)
    monkeypatch.setattr(jaccard_join, "give_back", lambda: given.append(1))
    random.seed(3)
    texts = [" ".join(random.choice("abcdefgh") + str(random.randrange(9)) for _ in range(30)) for _ in range(1000)] * 5 + [None, ""]
    frame = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "t1": 0, "t2": 0})
    out = list(jaccard_join._features(5, (80, 100))([frame]))
    assert len(out) == len(given) > 1 and max(map(len, out)) <= jaccard_join.AT_ONCE
    rows = pd.concat(out)
    assert rows["i"].tolist() == [(2 << 33) + k for k in range(len(texts))] and rows["doc_id"].tolist() == list(range(len(texts)))
    shingle = jaccard_join.Shingler(5)
    assert rows["n"].tolist() == [len(shingle(t)) for t in texts]
    assert all(len(s) for s in rows["sig"][:1000]) and not any(len(s) for s in rows["sig"].tolist()[1000:])  # copies don't sign again


def test_token_files_reader_holds_short_rules():
    """Short rules come from their expansions, long ones step by step; both give the ids."""
    random.seed(4)
    docs = [[7] * 5000, [1, 2, 3, 4] * 300, [random.randrange(50) for _ in range(3000)], [9], [5, 6] * 33]
    ids = np.array([x for d in docs for x in d], np.int32)
    data = token_files.pack(ids, list(map(len, docs)), list(range(len(docs))), 1 << 20, 5)
    shard = token_files.Shard(token_files.ranged(io.BytesIO(data)))
    assert shard.lengths.max() > token_files.SHORT
    steps, own = [], shard._expand
    shard._expand = lambda symbols, short: steps.append(short) or own(symbols, short)
    assert [x.tolist() for _, x in shard.documents(2)] == docs and steps == [0, *[token_files.SHORT] * 3]
    assert [shard.document(i).tolist() for i in range(len(docs))] == docs and shard.token(0, 4999) == 7
    bare = token_files.Shard(token_files.ranged(io.BytesIO(data)))
    assert bare.document(0).tolist() == docs[0] and bare.held is None  # a single document needs no expansions
    for w in (" word", "two words", "é x", "\n\n", "\x7f", "~!"):
        assert token_files.spelt(w) == w.encode().decode("latin-1").translate(token_files.SPELT)
