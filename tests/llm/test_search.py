"""Searches and url rules against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaspec.llm import hamming, nn_descent, url_filter


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], "vec_id long, embedding array<float>, score int")


def cosine_top(rows, q, k):
    v = dict(rows)[q]
    out = []
    for i, w in rows:
        if i != q:
            a, b = np.float64(np.float32(v)), np.float64(np.float32(w))
            out.append((-float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))), i))
    return sorted(out)[:k]


def test_nearest_with_copies_and_broken_rows(spark):
    rng = np.random.default_rng(0)
    good = [(i, rng.normal(size=8)) for i in range(60)]
    good += [(100 + i, good[3][1]) for i in range(9)]
    bad = [(200, None), (201, [0] * 8), (202, [float("nan")] * 8), (203, [float("inf")] + [0] * 7), (204, [None] + [1] * 7), (205, [1.0, 2.0])]
    df = vectors(spark, good + bad)
    got = {}
    for r in nn_descent.nearest(df, df.where("vec_id % 10 = 3 OR vec_id = 105 OR vec_id >= 200")).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(got) == {3, 13, 23, 33, 43, 53, 103, 105}
    hits = total = 0
    for q, found in got.items():
        want = cosine_top(good, q, 5)
        assert sorted(found) == [1, 2, 3, 4, 5]
        hits += len({v for v, _ in found.values()} & {i for _, i in want})
        total += 5
    assert hits / total >= 0.95
    assert [got[105][r][0] for r in range(1, 6)] == [3, 100, 101, 102, 103] and [got[3][r][0] for r in range(1, 6)] == [100, 101, 102, 103, 104]


def test_few_or_no_vectors(spark):
    df = vectors(spark, [(0, [1, 0]), (50, [1, 1])])
    assert [(r["query_id"], r["vec_id"]) for r in nn_descent.nearest(df, df.where("vec_id = 0")).collect()] == [(0, 50)]
    assert nn_descent.nearest(df.limit(0), df.limit(0)).count() == 0


def test_recall_on_random_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(1500, 16)))]
    df = vectors(spark, rows)
    got = {}
    for r in nn_descent.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = sum(len(got[q] & {i for _, i in cosine_top(rows, q, 5)}) for q in range(0, 1500, 50))
    assert hit / 150 >= 0.9


def test_hamming_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    codes = [(i, int(c)) for i, c in enumerate(rng.integers(-(2**63), 2**63, size=150))]
    codes += [(1000 + i, codes[0][1]) for i in range(15)]
    df = spark.createDataFrame(codes, "vec_id long, code long")
    got = {}
    for r in hamming.hamming_top_k(df, df.where("vec_id % 40 = 0"), 10).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
    known = dict(codes)
    assert set(got) == {i for i in known if i % 40 == 0}
    for q, rows in got.items():
        want = sorted(((bin((known[q] ^ c) & (2**64 - 1)).count("1"), i) for i, c in codes if i != q))[:10]
        assert [(d, i) for _, i, d in sorted(rows)] == want
    for masks, segments in ((0, 4), (20, 2), (10**6, None)):  # a scan at once, a scan after a round, other widths
        monkeypatch.setattr(hamming, "MASKS", masks)
        again = {}
        for r in hamming.hamming_top_k(df, df.where("vec_id % 40 = 0"), 10, segments=segments).collect():
            again.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["distance"]))
        assert {q: sorted(v) for q, v in again.items()} == {q: sorted(v) for q, v in got.items()}
    few = df.where("vec_id < 3")
    assert hamming.hamming_top_k(few, few.where("vec_id = 0"), 10).count() == 2
    assert hamming.hamming_top_k(df.limit(0), df.limit(0)).count() == 0


def test_hamming_codes_of_odd_rows(spark):
    """Null and non-finite vectors take no part, repeated ids count once, clashing names and long vectors."""
    rows = [(1, [1.0, -1.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (3, [-1.0, -1.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (2, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, code string, distance int")
    codes = df.where(hamming.usable(F.col("embedding"))).select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in hamming.hamming_top_k(codes, codes, 2).collect())
    assert got == [(1, 1, 2, 0), (1, 2, 3, 1), (2, 1, 1, 0), (2, 2, 3, 2), (3, 1, 1, 1), (3, 2, 2, 2)]
    with pytest.raises(Exception, match="more than 64"):
        spark.createDataFrame([([1.0] * 65,)], "v array<double>").select(hamming.sign_code(F.col("v"))).collect()


def test_urls(spark):
    urls = [None, "", "nohost", "http://", "HTTP://Sub.Example.COM/en/7?x", "http://example.com/en/70", "http://com/en/", "http://community/en/", "http://a.net/de/8", "http://b.example.net/de/8#f", "x://c.org?/es/", "x://c.org/es/#", "http://example.com:80/en/7", "http://İ.com/en/", "http://.com/en/", "http://com./en/", "http://example.com/en/7"] * 3
    rows = [(i, u, "h") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame([*url_filter.RULES, ("allow", "com", "/en/"), ("block", "sub.example.com", "/")], "verdict string, host string, path string")
    known = [(v, h, p) for v, h, p in [*url_filter.RULES, ("block", "sub.example.com", "/")] if (v, h, p) != ("allow", "com", "/en/")]
    got = {r["page_id"]: r for r in url_filter.judge_urls(df, rules).collect()}
    for i, u, _ in rows:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        rest = rest.split("?")[0].split("#")[0]
        host, slash, path = rest.partition("/")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = slash + path
        fits = [(len(h + p), v == "block", h + p, v) for v, h, p in known if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits) if fits else (0, 0, None, "allow")
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == (host, path, best[2], best[3]), u
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0
    for broken in (("block", "", "/"), ("block", None, "/"), (None, "com", "/")):
        with pytest.raises(ValueError):
            url_filter.judge_urls(df, spark.createDataFrame([*url_filter.RULES, broken], "verdict string, host string, path string"))
    assert url_filter.judge_urls(df, rules.limit(0)).where("rule IS NOT NULL OR verdict <> 'allow'").count() == 0
