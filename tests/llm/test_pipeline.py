"""The pipeline's stages, each against a plain version of its decision."""

import re

import public_tokenizers as P
import xxhash
from oracle import SMALL

import corpus_pipeline as C
from kilnworks.llm import bpe, toxicity
from kilnworks.llm.common import table, written


def shingles(text, n=5):
    w = text.encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def cut(text):
    """Units end at line ends, after . ! or ?, after words with a hash divisible by six, and after ten words."""
    out, n = [""], 0
    for m in re.finditer(r"([ \t\n\r]*)([^ \t\n\r]+)", text):
        space, word = m.groups()
        if n and re.search(r"[\n\r]", space):
            out.append("")
            n = 0
        out[-1] += m.group()
        n += 1
        h = xxhash.xxh64_intdigest(word.encode(), 42)
        h -= (h >> 63) << 64
        if n == 10 or word[-1] in ".!?" or h % 6 == 0:
            out.append("")
            n = 0
    out = [u for u in out if u]
    tail = re.search(r"[ \t\n\r]*\Z", text).group()
    return out[:-1] + [out[-1] + tail] if out else out


def lines(texts):
    """Units in runs of five that have occurred before go; so do texts of which nothing is left."""
    seen, out = set(), {}
    for i in sorted(texts):
        units = cut(texts[i])
        bare = [re.sub(r"[\t\n\r]", " ", u).strip(" ") for u in units]
        away = set()
        for s in range(len(bare) - 4):
            if tuple(bare[s : s + 5]) in seen:
                away |= set(range(s, s + 5))
            seen.add(tuple(bare[s : s + 5]))
        text = "".join(u for j, u in enumerate(units) if j not in away) if away else texts[i]
        if len(away) < len(units) or not away:
            out[i] = re.sub(r"^[ \t\n\r]+", "", text) if 0 in away else text
    return out


def clean(texts, items):
    """Documents without any ten words in a row, or whole short item, of an item."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    bad = {tuple(w[p : p + 10]) for w in map(cut, items) for p in range(max(1, len(w) - 9)) if w}
    sizes = {len(b) for b in bad}
    return {i for i, t in texts.items() for w in [cut(t)] if not any(tuple(w[p : p + m]) in bad for m in sizes for p in range(len(w) - m + 1))}


ODD = "doc_id long, text string, lang string, source string, n_chars long, severity string, gone string, ids string, whole string"


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, no rows at all."""
    own = ("own", "g", "i", "w")
    near = " ".join(f"w{i}" for i in range(200))
    rows = [(1, None), (2, ""), (3, " \n "), (None, None), (None, "No id but words."), (4, near), (4, near), (5, near + " more"), (6, "x" * 50_000 + "".join(f" y{i}" for i in range(9000))), (7, "lone")]
    docs = spark.createDataFrame([(i, t, None, "s", len(t) if t else None, *own) for i, t in rows], ODD)
    for folder, d in (("some", docs), ("none", docs.limit(0))):
        d.write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        for name in ("labels", "benchmark"):
            table(spark, SMALL, name).where("false" if name == "labels" else "true").write.parquet(f"{tmp_path}/{folder}/{name}.parquet")
    assert C.run(spark, f"{tmp_path}/none").count() == 0
    out = C.run(spark, f"{tmp_path}/some").collect()
    got = sorted(((r.doc_id, r.text) for r in out), key=str)
    assert got == sorted({r for r in rows if r[0] != 5} | {(5, lines({4: near, 5: near + " more"})[5])}, key=str)  # a copied run goes, the unit with the new word stays
    assert {(r.severity, r.gone, r.whole) for r in out} == {("own", "g", "w")}
    assert all(r.n_tokens == len(r.ids) and (r.n_tokens > 0) == bool(r.text) for r in out)


def test_stages(spark):
    import tiktoken

    docs = table(spark, SMALL, "documents")
    columns, before = docs.columns, None
    kept = {}
    for name, stage in C.STAGES:
        docs = written(stage(spark, docs, SMALL), name)
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert name == "byte_bpe" or docs.columns == columns
        assert before is None or set(kept[name]) <= set(before)
        before = kept[name]
    model = toxicity.fit(table(spark, SMALL, "documents"), table(spark, SMALL, "labels").selectExpr("doc_id", "toxic AS grade"))
    every = {r.doc_id: r for r in table(spark, SMALL, "documents").collect()}
    assert set(kept["toxicity"]) == {i for i, r in every.items() if model.expected(r.text) < model.cut}
    assert {i: r.text for i, r in kept["line_dedup"].items()} == lines({i: r.text for i, r in kept["toxicity"].items()})
    assert set(kept["decontamination"]) == clean({i: r.text for i, r in kept["jaccard_join"].items()}, [r.text for r in table(spark, SMALL, "benchmark").collect()])
    near = kept["line_dedup"]
    sets = {i: shingles(r.text) for i, r in near.items()}
    root = {i: i for i in sets}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(kept["jaccard_join"]) == {i for i in sets if find(i) == i}
    codec = bpe.ByteBpe(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN, 10)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    assert set(kept["byte_bpe"]) == set(kept["decontamination"])
    for r in kept["byte_bpe"].values():
        assert r.ids == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids)


def test_names():
    assert [n for n, _ in C.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "byte_bpe"]
