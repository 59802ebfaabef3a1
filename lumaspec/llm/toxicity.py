"""Operator 8: toxicity by a linear-chain conditional random field over tokens.

Labels are of documents, so token labels come first: in the training texts a
token of a toxic document is labelled toxic if its word, or one of its first
three to five letters, stands in toxic documents significantly more often (G
statistic at least ``LEAST_G``). A two-state chain over all tokens of a text is
then fitted to these labels by gradient ascent; its features are hashes of the
word, its beginnings and its end. Forward-backward marginals give each token's
probability; their sum, their maximum and the number of tokens go through a
logistic curve, fitted on training documents that the chain has not seen, to
the score. Tokens of probability 0.5 or more form the offending spans.

Fitting takes a bounded sample of labelled rows (``PER_CLASS`` of each class and
``SAMPLE_CHARS`` characters, in order of a hash of the id; a text that does not
fit is left out alone, and those of over a sixteenth of ``SAMPLE_CHARS`` come
last). Scores cover whole
texts and use nothing but the text.

Edge cases: null and empty texts have no tokens and get the curve's value for
none; rows are scored each; labels of a document that differ count as toxic;
null labels and labels of unknown documents are ignored; without labelled rows
of both classes every score is the share of toxic rows (0 if there are none);
an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebpe import LETTER, NUMBER, char_classes, code_points
from .common import SpanHasher, cut, lean, mix64, read, text_runs

PER_CLASS, SAMPLE_CHARS = 2_000, 8_000_000
LEAST_G = 12.0
BITS = 18
EPOCHS = 40
#: Bytes of texts scored at a time (one text is never cut); a batch costs as many steps as its longest text has tokens.
SCORED_BYTES = 1_000_000
#: Kinds of features of a token: the word, its first 3, 4 and 5 letters, its last 3.
KINDS = 5

_HASHER = SpanHasher()


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000:
            low = chr(c).lower()
            if len(low) == 1:
                out[c] = ord(low)
    return out


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends) of runs of letters and digits in the joined texts, (tokens, KINDS) feature numbers (0: none), first token of each text and the end."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    codes = code_points(texts)
    kinds, table = char_classes()
    n = len(codes)
    inside = np.zeros(n + 2, dtype=bool)
    kind = kinds[codes]
    inside[1 : n + 1] = (kind == LETTER) | (kind == NUMBER)
    ends_of = np.cumsum(sizes)
    begins = inside[1:] & ~inside[:-1]
    first = (ends_of - sizes)[sizes > 0]
    begins[first] |= inside[first + 1]
    starts = np.flatnonzero(begins)
    stop = np.zeros(n + 1, dtype=bool)
    stop[1:] = inside[1 : n + 1] & ~inside[2:]
    last = ends_of[sizes > 0]
    stop[last] |= inside[last]
    ends = np.flatnonzero(stop)
    codes = _lower()[codes]
    length = ends - starts
    out = np.zeros((len(starts), KINDS), dtype=np.int32)
    if len(starts):
        for k, (a, b, has) in enumerate([(starts, ends, None), *((starts, np.minimum(starts + m, ends), length > m) for m in (3, 4, 5)), (np.maximum(ends - 3, starts), ends, length > 3)]):
            key = (mix64(_HASHER(codes, a, b, table) + np.uint64(k + 1)) >> np.uint64(64 - BITS)).astype(np.int32) | 1
            out[:, k] = key if has is None else np.where(has, key, 0)
    return starts, ends, out, np.searchsorted(starts, np.concatenate([[0], ends_of]))


def token_features(texts: list[str], chars: int = 500_000) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and bounds as ``tokens`` gives them, block by block (one text is never cut)."""
    parts, sizes, a = [], [], 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b]) <= chars):
            size += len(texts[b])
            b += 1
        _, _, f, bounds = tokens(texts[a:b])
        parts.append(f)
        sizes.append(np.diff(bounds))
        a = b
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])


class Chain:
    """Two states, 0 and 1 (toxic). ``weights``: a feature's share of state 1's log odds; ``moves[i, j]``: log weight of state j after i."""

    def __init__(self) -> None:
        self.weights = np.zeros(1 << BITS)
        self.bias = -2.0
        self.moves = np.zeros((2, 2))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        w = self.weights.copy()
        w[0] = 0.0
        out = np.full(len(features), self.bias)
        for k in range(features.shape[1]):
            out += w[features[:, k]]
        return np.clip(out, -30, 30)

    def marginals(self, emission: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(state 1) of each token, and the (2, 2) sums of P(state i, then j)."""
        n = np.diff(bounds)
        order = np.argsort(-n, kind="stable")
        begin, n = bounds[:-1][order], n[order]
        active = len(n) - np.searchsorted(n[::-1], np.arange(1, (n[0] if len(n) else 0) + 1), "left")
        odds = np.exp(emission)
        m = np.exp(self.moves)
        fore = np.empty(len(emission))  # P(state 1 | tokens so far)
        back = np.ones(len(emission))  # likelihood ratio, state 1 to 0, of the tokens after
        p = None
        for t, k in enumerate(active):
            at = begin[:k] + t
            one = odds[at] if p is None else (p[:k] * m[1, 1] + (1 - p[:k]) * m[0, 1]) * odds[at]
            zero = 1.0 if p is None else p[:k] * m[1, 0] + (1 - p[:k]) * m[0, 0]
            p = one / (one + zero)
            fore[at] = p
        for t in range(len(active) - 2, -1, -1):
            at = begin[: active[t + 1]] + t
            x = odds[at + 1] * back[at + 1]
            back[at] = (m[1, 1] * x + m[1, 0]) / (m[0, 1] * x + m[0, 0])
        p1 = fore * back / (fore * back + 1 - fore)
        inner = np.ones(len(emission), dtype=bool)
        inner[bounds[:-1][np.diff(bounds) > 0]] = False
        at = np.flatnonzero(inner)
        a, x = fore[at - 1], odds[at] * back[at]
        joint = np.stack([(1 - a) * m[0, 0], (1 - a) * m[0, 1] * x, a * m[1, 0], a * m[1, 1] * x])
        joint = (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2) if len(at) else np.zeros((2, 2))
        return p1, joint

    def fit(self, features: np.ndarray, bounds: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, l2: float = 0.05, rate: float = 0.3) -> None:
        inner = np.ones(len(labels), dtype=bool)
        inner[bounds[:-1][np.diff(bounds) > 0]] = False
        at = np.flatnonzero(inner)
        seen = np.bincount(labels[at - 1] * 2 + labels[at], minlength=4).reshape(2, 2).astype(float)
        size = 1 << BITS
        m1, m2 = np.zeros(size + 5), np.zeros(size + 5)
        for epoch in range(1, epochs + 1):
            p, joint = self.marginals(self.emissions(features), bounds)
            d = labels - p
            g = np.concatenate([sum(np.bincount(features[:, k], d, minlength=size) for k in range(KINDS)) - l2 * self.weights, [d.sum()], (seen - joint).ravel() - l2 * self.moves.ravel()])
            g[0] = 0.0
            m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
            step = rate * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.99**epoch)) + 1e-8)
            self.weights += step[:size]
            self.bias += step[size]
            self.moves += step[size + 1 :].reshape(2, 2)


def token_labels(features: np.ndarray, bounds: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic texts with a feature that stands in them significantly more often."""
    doc = np.repeat(np.arange(len(toxic)), np.diff(bounds))
    a, b = np.zeros(1 << BITS), np.zeros(1 << BITS)  # documents of each class that hold a feature
    for d, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
        (a if toxic[d] else b)[np.unique(features[x:y, : KINDS - 1])] += 1
    n1, n0 = max(toxic.sum(), 1), max((1 - toxic).sum(), 1)

    def term(x, rate, size):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(np.where(x > 0, x, 1) / np.maximum(rate * size, 1e-12)), 0.0)

    rate = (a + b) / (n1 + n0)
    g = 2 * (term(a, rate, n1) + term(b, rate, n0) + term(n1 - a, 1 - rate, n1) + term(n0 - b, 1 - rate, n0))
    telling = (g >= LEAST_G) & ((a + 0.5) / (n1 + 1) > 8 * (b + 0.5) / (n0 + 1))
    telling[0] = False
    return (telling[features[:, : KINDS - 1]].any(axis=1) & (toxic[doc] == 1)).astype(np.int64)


def _document_values(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(p)])
    n = np.diff(bounds)
    most = np.zeros(len(n))
    if len(p):
        some = n > 0
        most[some] = np.maximum.reduceat(p, bounds[:-1][some])
    return np.column_stack([np.ones(len(n)), np.log1p(sums[bounds[1:]] - sums[bounds[:-1]]), most, np.log1p(n) / 10])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    beta = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + keep
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - keep @ beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


class Model:
    """A fitted chain with its curve."""

    def __init__(self, chain: Chain, curve: np.ndarray) -> None:
        self.chain, self.curve = chain, curve

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Scores and offending spans (characters) of texts."""
        starts, ends, features, bounds = tokens(texts)
        p, _ = self.chain.marginals(self.chain.emissions(features), bounds)
        score = 1 / (1 + np.exp(-np.clip(_document_values(p, bounds) @ self.curve, -30, 30)))
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        base = np.cumsum([0, *map(len, texts)])
        hit = np.flatnonzero(p >= 0.5)
        doc = np.searchsorted(bounds, hit, "right") - 1
        for i, d in zip(hit.tolist(), doc.tolist(), strict=True):
            spans[d].append((int(starts[i] - base[d]), int(ends[i] - base[d])))
        return score, spans


def fit_model(rows: list[tuple[str, int, int]], class_sizes: tuple[int, int]) -> Model:
    """``rows``: (text, toxic, fold); fold 1 of the training folds fits the curve, the others the chain."""
    rows = list({r[0]: r for r in rows}.values())
    chain = Chain()
    share = class_sizes[1] / max(1, sum(class_sizes))
    constant = np.array([np.log(max(share, 1e-13) / max(1 - share, 1e-13)), 0.0, 0.0, 0.0])
    if not rows or len({r[1] for r in rows}) < 2:
        chain.bias = -30.0
        return Model(chain, constant)
    for part in ([r for r in rows if r[2] != 1], rows):  # the curve comes from the first chain, tokens' odds from the last
        features, bounds = token_features([r[0] for r in part])
        y = np.array([r[1] for r in part])
        chain = Chain()
        chain.fit(features, bounds, token_labels(features, bounds, y))
        if part is not rows:
            unseen = [r for r in rows if r[2] == 1]
            if len({r[1] for r in unseen}) < 2:
                unseen = rows
            f, b = token_features([r[0] for r in unseen])
            y = np.array([r[1] for r in unseen])
            weight = np.where(y == 1, class_sizes[1] / max(1, y.sum()), class_sizes[0] / max(1, (1 - y).sum()))
            curve = _logistic(_document_values(chain.marginals(chain.emissions(f), b)[0], b), y, weight * len(y) / weight.sum())
    return Model(chain, curve)


def fold(id_col: str):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from labelled rows outside fold 0."""
    known = labels.where(F.col(label_col).isNotNull() & (fold(id_col) != 0)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("toxic"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    ordered = known.withColumn("_h", F.xxhash64(id_col))
    chosen = ordered.where("toxic = 1").orderBy("_h", id_col).limit(PER_CLASS).unionByName(ordered.where("toxic = 0").orderBy("_h", id_col).limit(PER_CLASS))
    texts = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    room = SAMPLE_CHARS // 2
    # At most 2 * PER_CLASS ids; a text over the whole bound can never enter. Equal rows teach once.
    sample = texts.join(F.broadcast(chosen), id_col).withColumn("_size", F.length("text")).where(F.col("_size") <= room).distinct()
    at = F.row_number().over(Window.partitionBy("toxic").orderBy("_h", id_col, "text"))
    sample = cut(sample.withColumn("_at", at).withColumn("fold", fold(id_col)).select("toxic", "_at", "_size", "fold", "text"))
    fits, used = [], {0: 0, 1: 0}
    # Texts of more than an eighth of the bound come last, so that one cannot take the others' room.
    for r in sample.select("toxic", "_at", "_size").orderBy(F.col("_size") > room // 8, "toxic", "_at").collect():
        if used[r["toxic"]] + r["_size"] <= room:
            used[r["toxic"]] += r["_size"]
            fits.append((r["toxic"], r["_at"]))
    taken = docs.sparkSession.createDataFrame(fits, "toxic int, _at int")
    rows = sample.join(F.broadcast(taken), ["toxic", "_at"]).select("text", "toxic", "fold").collect()
    rows = sorted(((r["text"], r["toxic"], r["fold"]) for r in rows), key=lambda r: (r[1], r[2], r[0]))
    return fit_model(rows, (sizes.get(0, 0), sizes.get(1, 0)))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``row`` (struct of the id, or of all columns with ``keep``), score and toxic_spans (array of start, end in characters)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.chain.weights.astype(np.float32), model.chain.bias, model.chain.moves, model.curve))
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = Chain()
        chain.weights, chain.bias, chain.moves, curve = shared.value
        score = Model(chain, curve)
        for batch in batches:
            for a, b in text_runs(batch.column(1), SCORED_BYTES):
                values, spans = score([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                rows = [[{"start": x, "end": y} for x, y in s] for s in spans]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(values, pa.float64()), pa.array(rows, pa.list_(span))], names=["row", "score", "toxic_spans"])

    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep else [id_col])])
    given = docs.select(row.alias("row"), F.col(text_col).alias("text"))
    return given.mapInArrow(lean(run), f"row {given.schema['row'].dataType.simpleString()}, score double, toxic_spans array<struct<start:int,end:int>>")


def op8_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score_documents(docs, train(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        F.col("row.doc_id").alias("doc_id"),
        F.coalesce(fold("row.doc_id") == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "toxic_spans",
    )
