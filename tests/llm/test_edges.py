"""Nulls, empty tables, repeated rows, very long texts and clashing column names in every operator and stage."""

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from lumaspec.llm import bpe_codec, bytebpe, chat, near_dedup, nn_descent, packing, suffix_dedup, token_counts, toxicity, url_filter

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")
WORDS = ["ban", "kest", "lir", "molo", "numi", "rad", "son", "tist"]
#: Names that operators use themselves.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, id long, th long, cls long, g long, row string, _hash long, _kept_id long, score double, ids string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def table(spark, texts):
    rows = [(i, t, "en", "s", len(t or ""), 7, 7, 7, 7, "r", 7, 7, 0.5, "x") for i, t in texts]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="module")
def long_text():
    return prose(random.Random(0), 150_000)


def test_equal_ids_of_different_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(v) for v in rng.normal(size=6)], "q", 1.0) for i in [*range(40), 3, 3, 7]] + [(None, [1.0] * 6, "q", 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, query string, score double")
    got = {}
    for r in nn_descent.nearest(df, df.where("vec_id in (3, 20)")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == {3, 20}
    for q, found in got.items():
        assert all(v != q for _, v in found) and None not in {v for _, v in found}
        assert sorted(k for k, _ in found) == list(range(1, len(found) + 1)) and len(found) == 5


def test_section_counts_of_repeated_rows_and_no_rows(spark, long_text):
    assert token_counts.section_token_counts(table(spark, []), RANKS).count() == 0
    rows = token_counts.section_token_counts(table(spark, [(1, "a b\nc"), (1, "a b\nc"), (None, None), (2, ""), (3, long_text)]), RANKS).collect()
    assert sorted((r["section"], r["n_tokens"]) for r in rows if r["doc_id"] == 1) == [(0, 3), (0, 3), (1, 1), (1, 1)]
    assert [(r["section"], r["n_tokens"], r["n_chars"]) for r in rows if r["doc_id"] in (None, 2)] == [(0, 0, 0)] * 2
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(RANKS), special_tokens={})
    assert [r["n_tokens"] for r in rows if r["doc_id"] == 3] == [len(plain.encode_ordinary(long_text))]


def test_packing_of_repeated_rows_and_a_very_long_text(spark, long_text):
    from tokenizers import Tokenizer

    texts = [(1, "same words"), (1, "same words"), (None, None), (2, long_text)]
    rows = packing.pack_pieces(packing.token_pieces(table(spark, texts), JSON, added=True)).collect()
    assert sum(r["doc_id"] == 1 for r in rows) == 2 and sum(r["doc_id"] is None for r in rows) == 1
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    ids = np.array([*Tokenizer.from_file(JSON).encode(long_text, add_special_tokens=False).ids, 2], dtype="<u4")
    mine = sorted((r for r in rows if r["doc_id"] == 2), key=lambda r: r["piece"])
    assert sum(r["length"] for r in mine) == len(ids) and all(r["length"] == 1024 for r in mine[1:])
    assert all(r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) for r in mine)


def test_round_trip_of_repeated_rows_and_a_very_long_text(spark, long_text):
    rows = bpe_codec.round_trip(table(spark, [(1, "é x"), (1, "é x"), (None, None), (3, long_text)]), RANKS).collect()
    assert len(rows) == 4 and len({r["ids_sha256"] for r in rows if r["doc_id"] == 1}) == 1


def test_toxicity_of_long_repeated_and_nameless_rows(spark, long_text):
    rng = random.Random(2)
    texts = [(i, prose(rng, 30) + (" zarg zargo zargi" if i % 3 == 0 else "")) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(None, 1), (5, None), (900, 1)], "doc_id long, toxic int")
    odd = [(900, long_text), (901, long_text + " zarg zargo zargi"), (7, texts[7][1]), (None, texts[3][1]), (None, None), (902, "")]
    df = table(spark, texts + odd)
    model = toxicity.train(df, labels)
    rows = toxicity.score_documents(df, model, keep=True).select("row.doc_id", "row.score", "score", "toxic_spans").collect()
    assert len(rows) == 126 and all(0 <= r["score"] <= 1 for r in rows)
    same = [r["score"] for r in rows if r["doc_id"] == 7]
    assert len(same) == 2 and same[0] == same[1]
    (long_,) = [r for r in rows if r["doc_id"] == 901]
    assert [long_text[0:0] + (long_text + " zarg zargo zargi")[s["start"] : s["end"]] for s in long_["toxic_spans"]][-3:] == ["zarg", "zargo", "zargi"]
    assert toxicity.score_documents(table(spark, []), model).count() == 0


def test_chat_and_urls_with_extra_columns(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", "x", 3), (1, 0, "user", "a", "x", 3), (1, 1, "assistant", "b" * 300_000, "x", 3)], "conv_id long, turn long, role string, text string, formatted string, block int")
    got = chat.read_chats(chat.format_chats(turns)).first()
    assert len(got["turns"]) == 3 and got["loss"] == "b" * 300_000
    pages = spark.createDataFrame([(1, "http://a.com/en/" + "x" * 200_000, "k", "s"), (1, "http://a.com/en/", "k", "s"), (None, None, "k", "s")], "page_id long, url string, key string, stack string")
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    assert sorted((r["page_id"] or 0, r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()) == [(0, "allow"), (1, "block"), (1, "block")]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("stages"))
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int").write.parquet(at + "/labels.parquet")
    return at


def test_stages_on_an_empty_table(spark, folder):
    for name, run in corpus_pipeline.STAGES:
        assert run(spark, table(spark, []), folder).count() == 0, name


def test_stages_keep_clashing_columns_and_define_repeats(spark, folder, long_text):
    rng = random.Random(5)
    a = prose(rng, 60)
    rows = [(1, a), (1, a), (2, a + " tail"), (3, None), (3, None), (4, ""), (None, a), (None, None), (5, long_text), (6, prose(rng, 50)), (6, prose(rng, 50))]
    docs = table(spark, rows)
    kept = stage("near_dedup")(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [-1, -1, 1, 3, 4, 5, 6, 6]
    cut = stage("suffix_dedup")(spark, docs, folder)
    assert cut.columns == docs.columns
    got = {}
    for r in cut.collect():
        got.setdefault(r["doc_id"], []).append(r["text"])
    assert len(got[None]) == 2 and got[1] == [a, a] and len(got[2][0]) < 20 and got[5] == [long_text] and len(got[6]) == 2
    assert all(r["n_chars"] == len(r["text"] or "") for r in cut.collect() if r["doc_id"] is not None)
    packed = stage("packing")(spark, docs, folder)
    assert packed.where("piece = 0").count() == len(rows)
    clean = stage("toxicity")(spark, docs, folder)
    assert clean.columns == docs.columns


def test_operators_on_empty_tables(spark):
    assert near_dedup.near_duplicates(table(spark, [])).count() == 0
    assert suffix_dedup.remove_repeats(table(spark, [])).count() == 0
    assert bpe_codec.round_trip(table(spark, []), RANKS).count() == 0
    assert packing.pack_pieces(packing.token_pieces(table(spark, []), JSON)).count() == 0
