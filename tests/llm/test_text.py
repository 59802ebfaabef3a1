"""Tokenising, packing, section counts and chat formatting against plain versions."""

import functools
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumaspec.llm import bpe_codec, bytebpe, chat, duckdb_bpe, packing, token_counts

RANKS = P.path("byte_bpe_50k.tiktoken")
ODD = ["", None, " ", "  ", "don't 'tis it's 's's ''s .'s I'll'lll 'VE   x", "a\n\n b\n", "\t\tx  y   ", "9's 12 a1 ²½ é́ ​", "日本 語。x\U0001f600", "<|endoftext|> <|x", "x" * 3000, "a b c d e f", "a b c d e f"]


def plain():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})


def table(spark, texts):
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids long, length string")  # names that operators use themselves


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab's tdrelvm \n\t  .!é中1²'")), max_size=40), max_size=4))
def test_words_are_those_of_the_library(texts):
    c = bytebpe.coder("ranks", RANKS)
    ids, bounds = c.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [plain().encode_ordinary(t) for t in texts]


def test_recursive_merges():
    words = ["hello", " tokenization", "Thntblere", "日本語", "a" * 300, "x", "\n\n", "ü"]
    assert [list(x) for x in duckdb_bpe.duckdb_merges(RANKS)(words)] == [plain().encode_single_piece(w) if False else plain()._core_bpe.encode_single_piece(w.encode()) for w in words]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abtheinrs -=é中")), min_size=1, max_size=60), min_size=1, max_size=4))
def test_keyed_recursion_agrees_with_the_library(words):
    old, duckdb_bpe.LONG = duckdb_bpe.LONG, 1
    try:
        assert [list(x) for x in duckdb_bpe.duckdb_merges(RANKS)(words)] == [plain()._core_bpe.encode_single_piece(w.encode()) for w in words]
    finally:
        duckdb_bpe.LONG = old


def test_a_very_long_word():
    word = "".join(chr(0x4E00 + (i * 7919 + i * i) % 20000) for i in range(12_000))
    assert list(duckdb_bpe.duckdb_merges(RANKS)([word])[0]) == plain()._core_bpe.encode_single_piece(word.encode())


def test_small_caches_start_anew():
    c = bytebpe.WordCoder(bytebpe.rank_merges(RANKS), max_words=3)
    for t in ("one two three four five", "six seven one two", "one"):
        ids, _ = c.encode([t])
        assert ids.tolist() == plain().encode_ordinary(t)


def test_round_trip(spark):
    got = {r["doc_id"]: r for r in bpe_codec.round_trip(table(spark, ODD), RANKS).collect()}
    assert len(got) == len(ODD)
    for i, t in enumerate(ODD):
        ids = plain().encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe_codec.round_trip(table(spark, []), RANKS).count() == 0


def test_decoding_lists(spark):
    enc = bpe_codec.encode_documents(table(spark, ODD[4:8]), RANKS).unionByName(spark.createDataFrame([(99, None)], "doc_id long, ids array<int>"))
    got = {r["doc_id"]: bytes(r["bytes"]).decode() for r in bpe_codec.decode_ids(enc, RANKS).collect()}
    assert got == {**dict(enumerate(ODD[4:8])), 99: ""}


@pytest.mark.parametrize("capacity", [8, 1024])
def test_packing(spark, capacity):
    docs = table(spark, [*ODD, *["word " * k for k in range(1, 40)]])
    rows = packing.pack_pieces(packing.token_pieces(docs, P.path("byte_bpe_50k.json"), capacity, with_ids=True), capacity).collect()
    texts = [*ODD, *["word " * k for k in range(1, 40)]]
    places, pieces = {}, {}
    for r in rows:
        ids = [*plain().encode_ordinary(texts[r["doc_id"]] or ""), 2]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert r["ids"] == part and r["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes()) and r["length"] == len(part)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["length"], len(ids)))
    for p in places.values():
        end = 0
        for offset, n in sorted(p):
            assert offset == end
            end += n
        assert end <= capacity
    for p in pieces.values():
        p.sort()
        assert [x[0] for x in p] == list(range(len(p))) and sum(x[1] for x in p) == p[0][2]
        assert all(x[1] == capacity for x in p[1:]) and len(p) == -(-p[0][2] // capacity)
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // capacity) * 1.1 + 1
    assert packing.pack_pieces(packing.token_pieces(table(spark, []), P.path("byte_bpe_50k.json"))).count() == 0


@functools.lru_cache(maxsize=1)
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


ADDED = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>'s  \n <|endoftext|", "  <|endoftext|>  don<|endoftext|>'t", "none", None, "", "x <|endoftext|>"]


def test_op4_ids_are_those_of_the_tokenizers_library(spark, tmp_path):
    tok = library()
    texts = ADDED + ODD
    table(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    rows = packing.op4_best_fit_packing(spark, str(tmp_path)).orderBy("doc_id", "piece").collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"]))
    for i, t in enumerate(texts):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        assert sum(n for _, n, _ in got[i]) == len(ids)
        assert all(crc == zlib.crc32(ids[a : a + n].tobytes()) for a, n, crc in got[i])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", " ", "a", "'s", "\n", "é1"]), max_size=12).map("".join), max_size=4))
def test_added_tokens_are_matched_as_by_the_library(texts):
    tok = library()
    ids, bounds = bytebpe.coder("json", P.path("byte_bpe_50k.json"), added=True).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1), st.integers(1, 40))
def test_plan_places_everything_once(counts, groups):
    rows = packing.plan_packing(counts, 64, groups)
    got, fill = {}, {}
    for size, a, b, first, offset in rows:
        assert a == got.get(size, 0)
        got[size] = b
        for s in range(first, first + b - a):
            fill.setdefault(s, []).append((offset, size))
    assert got == counts
    for x in fill.values():
        end = 0
        for o, n in sorted(x):
            assert o == end
            end += n
        assert end <= 64


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections(spark, rule):
    texts = [*ODD, "ab\n\n\ncd é\n x\n", "\n", "a\n"]
    rows = token_counts.section_token_counts(table(spark, texts), RANKS, rule).collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], {})[r["section"]] = (r["start"], r["n_chars"], r["n_tokens"])
    enc = plain()
    for i, t in enumerate(texts):
        lines = (t or "").splitlines(keepends=True) if "\n" in (t or "") else [t or ""]
        lines = [x for x in (t or "").split("\n")]
        parts = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        owner = [k for k, p in enumerate(parts) for _ in p.encode()]
        want, at = [0] * len(parts), 0
        for tok in enc.encode_ordinary(t or ""):
            n = len(enc.decode_single_token_bytes(tok))
            own = owner[at : at + n]
            want[own[0] if rule == "first" else own[-1] if rule == "last" else max(sorted(set(own)), key=own.count)] += 1
            at += n
        assert [got[i][k][2] for k in range(len(parts))] == want
        assert [got[i][k][1] for k in range(len(parts))] == [len(p) for p in parts] and len(got[i]) == len(parts)
    with pytest.raises(ValueError):
        token_counts.section_token_counts(table(spark, []), RANKS, "other")


def test_chat_reads_back(spark):
    evil = ["<|end|>", "<\\|turn|>", "\\", "a<", "|>b", "<|next|><|text|>", "", None, "é\U0001f600"]
    rows = [(c, t, ("user", "assistant", "assistant", None, "<|r")[(c + t) % 5], evil[(c * 3 + t) % len(evil)], 1) for c in range(4) for t in range(150 if c == 0 else 7)]
    rows += [(7, 1, "user", "same", 1), (7, 1, "user", "same", 1), (7, 1, "assistant", "b", 1), (None, 0, "user", "n", 1), (8, None, "user", "z", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, block int")
    back = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    want = {}
    for c, t, r, x, _ in sorted(rows, key=lambda v: (str(v[0]), -1 if v[1] is None else v[1], v[2] or "", v[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert set(back) == set(want)
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == turns
        assert back[c]["loss"] == "".join(x for r, x in turns if r == "assistant")
    assert chat.format_chats(df.limit(0)).count() == 0
    merged = chat.format_chats(df.where("conv_id = 0")).first()["formatted"]
    assert merged.count("<|turn|>") == sum(1 for a, b in zip([None, *want[0]], want[0], strict=False) if a is None or a[0] != b[0])
    assert F is not None


def test_ties_of_control_strings_are_ordered_by_plain_text(spark):
    rows = [(1, 0, "user", t) for t in ("<a", "<|", "<\\|", "\\", "<z")] + [(1, 0, "<|", "x"), (1, 0, "<a", "y")]
    got = chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert [(t["role"], t["text"]) for t in got["turns"]] == sorted((r, t) for _, _, r, t in rows)
