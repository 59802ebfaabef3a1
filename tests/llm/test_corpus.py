"""Toxicity, near and passage deduplication, the pipeline, against plain versions."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from lumaspec.llm import bwt, near_dedup, shingles, suffix_dedup, toxicity

WORDS = [a + b for a in ("ba", "ke", "li", "mo", "nu", "ra", "so", "ti") for b in ("n", "st", "r", "lo", "mi", "d")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def corpus(seed=0):
    rng = random.Random(seed)
    docs = [prose(rng, rng.randint(20, 120)) for _ in range(40)]
    shared = prose(rng, 30)
    for i in range(0, 40, 4):
        docs[i] += "\n" + shared
    for i in range(12):
        words = docs[i].split(" ")
        words[rng.randrange(len(words))] = "changed"
        docs.append(" ".join(words))
    docs += [docs[0], docs[0].upper(), "", None, "   \n", "one two", "one  TWO", "é" * 60, "é" * 60 + "x", "ab" * 3000]
    return docs


def frame(spark, docs, shuffle=True):
    rows = [(i, t, i, b"k", "en", "s", len(t or "")) for i, t in enumerate(docs)]
    if shuffle:
        random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, n long, keys binary, lang string, source string, n_chars long")


def sets_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return set()
    return {tuple(w)} if len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_shingles_count_like_sets():
    texts = [(t or "") for t in corpus()] + ["To To To to to to a a a a a b b b b b"]
    _, bounds = shingles.shingle_sets([t.encode() for t in texts])
    assert np.diff(bounds).tolist() == [len(sets_of(t)) for t in texts]


def plain_components(docs):
    s = [sets_of(t) for t in docs]
    head = list(range(len(docs)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            c = len(s[i] & s[j])
            if c and 100 * c >= 75 * (len(s[i]) + len(s[j]) - c):
                a, b = find(i), find(j)
                head[max(a, b)] = min(a, b)
    return s, [find(i) for i in range(len(docs))]


def test_near_duplicates(spark):
    docs = corpus()
    s, want = plain_components(docs)
    got = {r["doc_id"]: r for r in near_dedup.near_duplicates(frame(spark, docs)).collect()}
    assert len(got) == len(docs)
    for i in range(len(docs)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(s[i]), want[i], want[i] == i)
    assert near_dedup.near_duplicates(frame(spark, [])).count() == 0


def test_near_group_with_many_pivots(spark):
    """A chain of edits: neighbours are linked, ends are not."""
    rng = random.Random(3)
    words = prose(rng, 100).split(" ")
    docs = []
    for i in range(30):
        words[(i * 7) % 100] = f"edit{i}"
        docs.append(" ".join(words))
    _, want = plain_components(docs)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, docs)).collect()}
    assert [got[i] for i in range(30)] == want


def test_sketch_limit_lets_similar_pairs_pass():
    rng = np.random.default_rng(0)
    most = near_dedup.xor_limit(0.75)
    for _ in range(200):
        common = rng.integers(0, 2**63, 300).astype(np.uint64)
        own = rng.integers(0, 2**63, 100).astype(np.uint64)
        a, b = np.unique(np.concatenate([common, own[:50]])), np.unique(np.concatenate([common, own[50:]]))
        s = near_dedup.sketches(near_dedup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])))
        assert np.bitwise_count(s[0] ^ s[1]).sum() <= most


def plain_removal(docs, width=50):
    raw = [(t or "").encode() for t in docs]
    first = {}
    for d, b in enumerate(raw):
        for i in range(len(b) - width + 1):
            first.setdefault(b[i : i + width], d)
    out = []
    for d, b in enumerate(raw):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if first[b[i : i + width]] < d:
                gone[i : i + width] = b"\1" * width
        out.append((bytes(x for x, g in zip(b, gone, strict=True) if not g), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))))
    return out


@pytest.mark.parametrize("group_bytes", [4_000_000, 3_000])
def test_passages(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group_bytes)
    docs = corpus(5)
    want = plain_removal(docs)
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(frame(spark, docs)).collect()}
    assert len(got) == len(docs)
    for i, (kept, spans) in enumerate(want):
        assert bytes(got[i]["kept"]) == kept and len(got[i]["removed"]) == spans, i
    assert suffix_dedup.remove_repeats(frame(spark, [])).count() == 0


def test_a_bucket_merges_several_transforms(monkeypatch):
    """One bucket's answer to several groups comes from several merged shards, and is that of brute force."""
    rng = random.Random(6)
    common = [prose(rng, 40) for _ in range(6)]
    merged = []
    merge = bwt.merge
    monkeypatch.setattr(bwt, "merge", lambda t, longer, depth: (merged.append(len(t)), merge(t, longer, depth))[1])
    groups = []
    for g in range(12):
        texts = [prose(rng, 20) + rng.choice(common)[rng.randrange(30) :] + prose(rng, 9) for _ in range(6)]
        rows = {"g": [g] * 6, "doc_id": [g * 6 + i for i in range(6)], "text": [t.encode() for t in texts], "text_hash": [0] * 6}
        groups.append(pa.table(rows))
    told = pa.concat_tables(suffix_dedup._announce(1)(t) for t in groups)
    told = suffix_dedup._repeated(told)
    sent = pa.concat_tables(suffix_dedup._submit(1)(t, told.filter(pc.field("g") == g)) for g, t in enumerate(groups))
    answers = suffix_dedup._answer(sent)
    both = pa.concat_tables([told.append_column("kind", pa.array([0] * len(told))), answers.append_column("kind", pa.array([1] * len(answers)))])
    got = {}
    for g, t in enumerate(groups):
        for r in suffix_dedup._remove(1)(t, both.filter(pc.field("g") == g)).to_pylist():
            got[r["doc_id"]] = r["kept"]
    texts = [x.decode() for t in groups for x in t.column("text").to_pylist()]
    assert [got[i] for i in range(72)] == [k for k, _ in plain_removal(texts)]
    assert merged == [suffix_dedup.SHARDS]


def test_equal_and_missing_ids(spark):
    p = prose(random.Random(1), 40)
    df = spark.createDataFrame([(1, p), (1, p), (None, p), (2, p)], "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df).collect()
    assert sorted((r["doc_id"] or 0, len(r["kept"])) for r in rows) == [(0, len(p)), (1, len(p)), (1, len(p)), (2, 0)]


def test_merged_transforms():
    rng = random.Random(2)
    strings = list(dict.fromkeys("".join(rng.choice("ab") for _ in range(rng.randint(6, 30))).encode() for _ in range(300)))
    owners = np.array([rng.randrange(1000) for _ in strings])
    least = {}
    for s, o in zip(strings, owners, strict=True):
        for i in range(len(s) - 5):
            least[s[i : i + 6]] = min(least.get(s[i : i + 6], 9999), o)
    for size in (7, 1000):
        shards = [len(strings[a : a + size]) for a in range(0, len(strings), size)]
        got, windows = bwt.least_owners(strings, owners, 6, [0, *shards])
        assert got.tolist() == [least[s[i : i + 6]] for s in strings for i in range(len(s) - 5)]
        assert windows.tolist() == [len(s) - 5 for s in strings]


def chain_by_enumeration(chain, emission):
    from itertools import product

    n = len(emission)
    total, ones = 0.0, np.zeros(n)
    for path in product((0, 1), repeat=n):
        w = np.exp(sum(e for e, s in zip(emission, path, strict=True) if s) + sum(chain.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        ones += w * np.array(path)
    return ones / total


def test_marginals_against_enumeration():
    rng = np.random.default_rng(0)
    chain = toxicity.Chain()
    chain.moves = rng.normal(size=(2, 2))
    sizes = [0, 5, 1, 7, 0, 3]
    e = rng.normal(size=sum(sizes))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    p, _ = chain.marginals(e, bounds)
    want = np.concatenate([chain_by_enumeration(chain, e[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a])
    assert np.allclose(p, want)


def labelled(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        words = prose(rng, rng.randint(10, 80)).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = "zarg" + rng.choice(WORDS)
        docs.append(" ".join(words))
        labels.append((i, int(toxic)))
    docs += ["", None]
    lab = spark.createDataFrame([*labels, (1, None), (9999, 1)], "doc_id long, toxic int")
    return frame(spark, docs), lab, docs


@pytest.mark.parametrize("size", [3000, 1990, 1000])
def test_a_long_text_does_not_shut_out_others(spark, monkeypatch, size):
    lab = spark.createDataFrame([(i, int(i % 2)) for i in range(80)], "doc_id long, toxic int")
    order = [r["doc_id"] for r in lab.where((toxicity.fold("doc_id") != 0)).orderBy(F.xxhash64("doc_id")).collect()]
    texts = {i: f"text {i:04d} " + "word " * 8 for i in range(80)}
    long_ids = [next(i for i in order if i % 2 == c) for c in (0, 1)]
    for i in long_ids:
        texts[i] = f"{i:04d}".ljust(size, "x")
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 2 * 2000)
    monkeypatch.setattr(toxicity, "fit_model", lambda rows, sizes: rows)
    got = {r[0] for r in toxicity.train(spark.createDataFrame([*texts.items(), (3, texts[3])], "doc_id long, text string"), lab)}
    for c in (0, 1):
        mine = [texts[i] for i in order if i % 2 == c and i not in long_ids]
        taken = [t for t in mine if t in got]
        assert taken == mine[: (2000 // len(mine[0]))] and len(taken) == min(len(mine), 2000 // len(mine[0]))
        assert sum(map(len, taken)) <= 2000


def test_toxicity_on_held_out_rows(spark):
    df, lab, docs = labelled(spark)
    model = toxicity.train(df, lab)
    rows = {r["doc_id"]: r for r in toxicity.score_documents(df, model).select("row.doc_id", "score", "toxic_spans").collect()}
    import zlib

    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(rows[i]["score"] >= 0.5) == (i % 4 == 0) for i in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in rows.values()) and rows[400]["score"] == rows[401]["score"] < 0.5
    for i in held:
        for s in rows[i]["toxic_spans"]:
            assert docs[i][s["start"] : s["end"]].isalpha()
    found = {docs[i][s["start"] : s["end"]][:4] for i in held for s in rows[i]["toxic_spans"]}
    assert "zarg" in found
    none = toxicity.train(df, lab.limit(0))
    assert all(r["score"] < 1e-9 for r in toxicity.score_documents(df, none).collect())
    assert toxicity.score_documents(df.limit(0), model).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    df, lab, docs = labelled(spark)
    df = df.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(500, docs[1], "en", "s", 5), (501, docs[1] + " tail", "en", "s", 5), (None, "no id", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    lab.write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in corpus_pipeline.STAGES[:3]:
        at = stage(spark, at, str(tmp_path))
        assert sorted(at.columns) == sorted(df.columns), name
        at.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        kept.append({r["doc_id"] for r in at.collect()})
    assert len(kept[0] & set(range(0, 400, 4))) < 10 and len(kept[0] & {i for i in range(400) if i % 4}) > 290
    assert 500 not in kept[1] and None in kept[1] and kept[1] == kept[2]
    packed = corpus_pipeline.STAGES[3][1](spark, at, str(tmp_path))
    assert {r["doc_id"] for r in packed.collect()} == kept[2]
    assert corpus_pipeline.ORACLE_SQL is None and hashlib is not None and F is not None


def test_near_with_repeated_and_null_ids(spark):
    """Rows of one id and different texts are linked each by its own text; a class never multiplies rows."""
    rng = random.Random(8)
    a, b = prose(rng, 60), prose(rng, 60)
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, "x"), (1, a), (None, a), (None, None), (5, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(df).collect()), key=repr)
    n = {t: len(sets_of(t)) for _, t in rows}
    assert got == sorted(((i, n[t], None if i is None else 1 if i < 4 else i) for i, t in rows), key=repr)


def test_large_buckets_in_blocks(spark, monkeypatch):
    """Blocks of a few classes give the components of brute force; links between components are found in them."""
    monkeypatch.setattr(near_dedup, "SMALL", 2)
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "STARS", 1)
    rng = random.Random(9)
    base = prose(rng, 120).split(" ")
    docs = []
    for i in range(40):
        words = list(base)
        for _ in range(3 if i % 4 else 8):
            words[rng.randrange(120)] = f"w{rng.randrange(30)}"
        docs.append(" ".join(words))
    _, want = plain_components(docs)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(frame(spark, docs)).collect()}
    assert [got[i] for i in range(40)] == want and len(set(want)) > 1
