"""Operator 1: approximate nearest neighbours by NN-descent and greedy graph search.

The graph starts from runs of vectors that are adjacent along random
projections. Each iteration joins every node's neighbours and reverse
neighbours with their vectors at the node (neighbours of neighbours meet
there), scores the pairs of which one side is new, and keeps each vector's best
``K``; it stops when few lists change. A query searches the graph greedily: the
best unexpanded nodes of its beam are joined with the graph, and what they lead
to is scored, until the whole beam is expanded.

Equal vectors are one node with its least ids as members (as many as an answer
can use), so copies neither crowd the graph nor each other's lists. Graph scores
use half-precision copies of the unit vectors; answers are scored on the
original vectors in double precision.

Edge cases: vectors that are null, zero, or hold null or non-finite components,
or whose length is not the usual one, take no part; fewer candidates than k
give fewer rows; ties go to the smaller id; rows of a repeated id are nodes each
by its own vector, a query of such an id asks with each of them, and an id is
found once, at its best score; an empty table gives an empty table; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, tidy
from .hamming import usable

K, REVERSE, RUN, PROJECTIONS = 32, 32, 64, 10
SPLITS = 32
ROUNDS, STOP = 10, 0.06
#: Best of each group that one local join passes on to a vector.
PASSED = 8
BEAM, EXPAND = 160, 64


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    """Rows of equal bytes as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype).reshape(len(column), -1)


def _groups(batches: Iterator[pa.RecordBatch], key: str, most: int | None = None) -> Iterator[pa.Table]:
    """Tables of whole groups of a partition that is sorted by ``key``; with ``most``, groups of more rows come in parts of at least that many."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        number = np.asarray(batch.column(key))
        other = np.flatnonzero(number != number[-1])
        if len(other):  # what stands before the last group of this batch is whole
            end = int(other[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, end)])
            held = [batch.slice(end)]
        elif held and np.asarray(held[-1].column(key))[-1] != number[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
        if most and sum(map(len, held)) >= most:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def _scored(ids: np.ndarray, vectors: np.ndarray, fresh: np.ndarray, worst: np.ndarray, out: list) -> None:
    """Adds (id, neighbour, score) of one group's pairs that beat the id's worst neighbour, its best ``PASSED``."""
    if len(ids) < 2:
        return
    s = vectors @ vectors.T
    s[ids[:, None] == ids[None, :]] = -2.0
    s[~(fresh[:, None] | fresh[None, :])] = -2.0
    s[s <= worst[:, None]] = -2.0
    take = min(PASSED, len(ids) - 1)
    top = np.argpartition(-s, take - 1, axis=1)[:, :take]
    value = np.take_along_axis(s, top, axis=1)
    row, col = np.nonzero(value > -2.0)
    if len(row):
        out.append((ids[row], ids[top[row, col]], value[row, col]))


def _emit(out: list) -> Iterator[pa.RecordBatch]:
    if out:
        a, b, s = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(s.astype(np.float32))], names=["id", "nid", "score"])


def _projected(nodes: DataFrame, dims: int) -> DataFrame:
    """(id, nid, score): pairs within runs of ``RUN`` nodes adjacent in the order of their sides of ``SPLITS`` random planes, the first plane first; ``PROJECTIONS`` such orders, dealt out by one range partitioning."""
    rng = np.random.default_rng(1)
    planes = [rng.normal(size=(dims, SPLITS)) for _ in range(PROJECTIONS)]
    weight = 1 << np.arange(SPLITS - 1, -1, -1, dtype=np.int64)

    def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                vectors = _matrix(b.column("vec"), np.float16).astype(np.float64)
                for turn, p in enumerate(planes):
                    place = (vectors @ p > 0) @ weight
                    yield pa.RecordBatch.from_arrays([b.column("id"), b.column("vec"), pa.array(np.full(len(place), turn, dtype=np.int32)), pa.array(place)], names=["id", "vec", "turn", "place"])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "turn", RUN * 200):
            turn, ids = np.asarray(t.column("turn")), np.asarray(t.column("id"))
            vectors = _matrix(t.column("vec").combine_chunks(), np.float16).astype(np.float32)
            out: list = []
            edges = np.flatnonzero(np.concatenate([[True], turn[1:] != turn[:-1], [True]])).tolist()
            for first, end in zip(edges[:-1], edges[1:], strict=True):
                for at in range(first, end, RUN):
                    x = slice(max(first, min(at, end - RUN)), min(at + RUN, end))  # the last run reaches back to be full
                    n = len(ids[x])
                    _scored(ids[x], vectors[x], np.ones(n, dtype=bool), np.full(n, -2.0, dtype=np.float32), out)
            yield from _emit(out)

    ordered = nodes.select("id", "vec").mapInArrow(along, "id long, vec binary, turn int, place long").repartitionByRange("turn", "place").sortWithinPartitions("turn", "place", "id")
    return ordered.select("id", "vec", "turn").mapInArrow(runs, "id long, nid long, score float")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _groups(batches, "node"):
        node, ids = np.asarray(t.column("node")), np.asarray(t.column("id"))
        vectors = _matrix(t.column("vec").combine_chunks(), np.float16).astype(np.float32)
        fresh, worst = np.asarray(t.column("fresh")), np.asarray(t.column("worst"))
        edges = np.concatenate([[0], np.flatnonzero(node[1:] != node[:-1]) + 1, [len(node)]])
        out: list = []
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            _scored(ids[a:b], vectors[a:b], fresh[a:b], worst[a:b], out)
        yield from _emit(out)


def _top(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "id"):
            ids, nid, score, fresh = (np.asarray(t.column(c)) for c in ("id", "nid", "score", "fresh"))
            order = np.lexsort((fresh, -score, nid, ids))  # of equal pairs the best first, then the old one
            ids, nid, score, fresh = ids[order], nid[order], score[order], fresh[order]
            once = np.ones(len(ids), dtype=bool)
            once[1:] = (ids[1:] != ids[:-1]) | (nid[1:] != nid[:-1])
            ids, nid, score, fresh = ids[once], nid[once], score[once], fresh[once]
            order = np.lexsort((nid, -score, ids))
            ids, nid, score, fresh = ids[order], nid[order], score[order], fresh[order]
            begin = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            rank = np.arange(len(ids)) - np.repeat(begin, np.diff(np.append(begin, len(ids))))
            keep = rank < k
            full = np.minimum(np.diff(np.append(begin, len(ids))), k)
            worst = np.where(full < k, np.float32(-2), score[begin + full - 1])
            ids, nid, score, fresh = ids[keep], nid[keep], score[keep], fresh[keep]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(nid), pa.array(score), pa.array(fresh), pa.array(np.repeat(worst, full).astype(np.float32))], names=["id", "nid", "score", "fresh", "worst"])

    return run


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """(id, nid, score, fresh, worst) of the k best neighbours, old ones before equal new ones; worst: the k-th score, -2 while there are fewer."""
    return pairs.repartition("id").sortWithinPartitions("id").mapInArrow(_top(k), "id long, nid long, score float, fresh int, worst float")


def neighbour_graph(nodes: DataFrame, dims: int, k: int = K) -> DataFrame:
    """(id, nid, score, fresh, worst) over ``nodes`` (id, vec: half-precision unit vector)."""
    n = nodes.count()
    graph = cut(_best(_projected(nodes, dims).withColumn("fresh", F.lit(1)), k))
    for turn in range(ROUNDS):
        edges = graph.select("id", "nid", "score", "fresh")
        back = edges.select(F.col("nid").alias("node"), "id", "fresh", F.xxhash64("nid", "id", F.lit(turn)).alias("_h"))
        back = back.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy(F.col("fresh").desc(), "_h"))).where(F.col("_r") <= REVERSE)
        around = edges.select(F.col("id").alias("node"), F.col("nid").alias("id"), "fresh").unionByName(back.select("node", "id", "fresh"))
        known = nodes.join(graph.groupBy("id").agg(F.first("worst").alias("worst")), "id")
        met = around.join(known, "id").select("node", "id", (F.col("fresh") == 1).alias("fresh"), "worst", "vec")
        found = met.repartition("node").sortWithinPartitions("node", "id").mapInArrow(_joined, "id long, nid long, score float")
        graph = cut(_best(edges.withColumn("fresh", F.lit(0)).unionByName(found.withColumn("fresh", F.lit(1))), k))
        changed = graph.agg(F.sum("fresh")).first()[0]
        tidy()
        if (changed or 0) <= STOP * n * k:
            break
    return graph


def _cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: A query's state is one row: ids, scores and marks of the nodes it has met, packed, and the nodes it opens next.
_STATE = "query long, ids binary, scores binary, done binary, open array<long>"


def _by_query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each query."""
    for t in _groups(batches, "query"):
        query = np.asarray(t.column("query"))
        edges = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1], [True]])).tolist()
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield t.slice(a, b - a)


def _packed(t: pa.Table, column: str, dtype) -> np.ndarray:
    """What one row of a query's rows holds in a packed column; nothing if none does."""
    found = [v for v in t.column(column).to_pylist() if v is not None]
    return np.frombuffer(found[0], dtype=dtype) if found else np.zeros(0, dtype=dtype)


def _unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, id) that a query has not met yet, once."""
    for t in _by_query(batches):
        ids = np.unique(np.asarray(t.column("id").drop_null()))
        new = np.setdiff1d(ids, _packed(t, "ids", np.int64), assume_unique=True)
        if len(new):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), t.column("query")[0].as_py()), pa.int64()), pa.array(new)], names=["query", "id"])


def _advanced(beam: int, expand: int):
    """Scores what a query has met anew and opens the best ``expand`` unexpanded nodes of its beam."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _by_query(batches):
            ids, score, done = _packed(t, "ids", np.int64), _packed(t, "scores", np.float32), _packed(t, "done", bool)
            fresh = t.filter(pc.is_valid(t.column("vec")))
            if fresh.num_rows:
                q = _packed(t, "qvec", np.float16).astype(np.float32)
                ids = np.concatenate([ids, np.asarray(fresh.column("id"))])
                score = np.concatenate([score, _matrix(fresh.column("vec").combine_chunks(), np.float16).astype(np.float32) @ q])
                done = np.concatenate([done, np.zeros(fresh.num_rows, dtype=bool)])
            order = np.lexsort((ids, -score))
            ids, score, done = ids[order], score[order], done[order]
            opened = np.flatnonzero(~done[:beam])[:expand]
            done[opened] = True
            columns = [pa.array([t.column("query")[0].as_py()], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in (ids, score, done)), pa.array([ids[opened].tolist()], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["query", "ids", "scores", "done", "open"])

    return run


def _beams(beam: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, ids, scores in zip(b.column("query").to_pylist(), b.column("ids").to_pylist(), b.column("scores").to_pylist(), strict=True):
                x = np.frombuffer(ids, dtype=np.int64)[:beam]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), q), pa.int64()), pa.array(x), pa.array(np.frombuffer(scores, dtype=np.float32)[:beam])], names=["query", "id", "score"])

    return run


def search(nodes: DataFrame, links: DataFrame, queries: DataFrame, beam: int = BEAM, entries: int = 32) -> DataFrame:
    """(query, id, score): the beam of each query (query, qvec, start: a node's id or null).

    The search ends when each query's whole beam is expanded. What a query has
    met, at most the neighbours of the nodes it has expanded and the doors,
    travels as one packed row.
    """
    doors = nodes.select("id", F.xxhash64("id").alias("_h")).orderBy("_h", "id").limit(entries).agg(F.collect_list("id").alias("doors"))
    met = queries.join(F.broadcast(doors)).select("query", F.explode(F.array_union("doors", F.when(F.col("start").isNotNull(), F.array("start")).otherwise(F.array().cast("array<long>")))).alias("id"))
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    asks = queries.select("query", none("long", "id"), none("binary", "vec"), "qvec", *[none("binary", c) for c in ("ids", "scores", "done")])
    state = None
    while True:
        new = met.join(nodes.select("id", "vec"), "id").select("query", "id", "vec", none("binary", "qvec"), *[none("binary", c) for c in ("ids", "scores", "done")])
        rows = asks.unionByName(new)
        if state is not None:
            rows = rows.unionByName(state.select("query", none("long", "id"), none("binary", "vec"), none("binary", "qvec"), "ids", "scores", "done"))
        state = cut(rows.repartition("query").sortWithinPartitions("query").mapInArrow(_advanced(beam, EXPAND), _STATE))
        front = state.select("query", F.explode("open").alias("id"))
        if front.isEmpty():
            return state.select("query", "ids", "scores").mapInArrow(_beams(beam), "query long, id long, score float")
        ahead = front.join(links, "id").select("query", F.col("nid").alias("id"), none("binary", "ids"))
        both = ahead.unionByName(state.where(F.size("open") > 0).select("query", none("long", "id"), "ids"))
        met = both.repartition("query").sortWithinPartitions("query").mapInArrow(_unseen, "query long, id long")
        del new, rows, front, ahead, both
        tidy()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id and score (cosine) of the k nearest rows of ``vectors`` found for each row of ``queries``, its own id left out."""
    zero = lambda c: ~F.exists(c, lambda x: x != 0)
    clean = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where(usable(F.col("v")) & F.col("id").isNotNull())
    clean = clean.where(~zero(F.col("v")))
    common = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    schema = f"query_id long, rank int, `{id_col}` long, score double"
    if common is None:
        return vectors.sparkSession.createDataFrame([], schema)
    dims = common["d"]
    clean = cut(clean.where(F.size("v") == dims).withColumn("h", F.xxhash64("v")))
    vectors_of = clean.select("id", "h").distinct().groupBy("id").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 1
    need = (k + 1) * vectors_of  # members that k others than the query's own id can take
    salted = Window.partitionBy("h", "v", "s").orderBy("id")
    few = clean.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(256))).withColumn("_r", F.dense_rank().over(salted)).where(F.col("_r") <= need)
    # A node's number is read from the checkpoint alone: ids may repeat with other vectors.
    classes = cut(few.groupBy("h", "v").agg(F.slice(F.sort_array(F.collect_set("id")), 1, need).alias("ids")).withColumn("id", F.monotonically_increasing_id()))

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.asarray(b.column("v").flatten(), dtype=np.float64).reshape(b.num_rows, -1)
                scale = np.abs(v).max(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for x in _unit(v / scale).astype(np.float16)], pa.binary())], names=["id", "vec"])

    nodes = cut(classes.select("id", "v").mapInArrow(halves, "id long, vec binary").repartition("id"))  # joins on id find it dealt out already
    graph = neighbour_graph(nodes, dims)
    edges = graph.select("id", "nid")
    back = edges.select(F.col("nid").alias("id"), F.col("id").alias("nid")).withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("id", "nid")))).where(F.col("_r") <= K)
    links = cut(edges.unionByName(back.select("id", "nid")).distinct().repartition("id"))
    asked = queries.select(F.col(id_col).cast("long").alias("q"), F.col(vec_col).alias("v")).where(usable(F.col("v")) & F.col("q").isNotNull())
    asked = asked.where(~zero(F.col("v")) & (F.size("v") == dims)).withColumn("h", F.xxhash64("v"))
    # Equal query vectors are searched once; a vector of the index starts at its own node.
    distinct = asked.select("h", "v").distinct().join(classes.select("h", "v", F.col("id").alias("start")), ["h", "v"], "left")
    distinct = cut(distinct.withColumn("query", F.coalesce("start", -1 - F.pmod(F.xxhash64("v"), F.lit(1 << 62)))))
    qvecs = distinct.select(F.col("query").alias("id"), "v").mapInArrow(halves, "id long, vec binary").select(F.col("id").alias("query"), F.col("vec").alias("qvec"))
    beams = search(nodes, links, cut(qvecs.join(distinct.select("query", "start"), "query")))
    close = beams.join(classes.select("id", F.col("v").alias("w"), "ids"), "id").join(distinct.select("query", "v"), "query")
    close = close.select("query", "ids", _cosine(F.col("v"), F.col("w")).alias("score"))
    mine = asked.join(distinct.select("h", "v", "query"), ["h", "v"]).select("q", "query")
    # A query needs the members of its best ``need`` nodes at most.
    cutoff = close.withColumn("_r", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("ids")[0]))).where(F.col("_r") <= need)
    rows = mine.join(cutoff, "query").select("q", F.explode("ids").alias("id"), "score").where("q <> id").groupBy("q", "id").agg(F.max("score").alias("score"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id")))
    return ranked.where(F.col("rank") <= k).select(F.col("q").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where("vec_id % 50 = 0"))
