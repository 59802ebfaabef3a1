"""Operator 2: exact top-k search in Hamming space by incremental multi-index hashing.

Codes of ``bits`` bits are cut into segments of about log2(number of codes)
bits. In round s every open query looks up, in each segment's index, the values
at distance exactly s from its own segment; what is found is verified on whole
codes, codes farther than the k-th nearest so far are dropped on the spot, and
the k nearest are kept. After round s every code within segments * (s + 1) - 1
has been met, so a query is done once its k-th verified distance is within that
bound; the last round (s = segment width) covers everything. Where a round
would need more than ``MASKS`` values for a segment, the queries that are still
open are compared with all codes in blocks instead, which covers everything too.

Equal codes are one class in the index: a class stands for its k + 1 least ids,
which is all that a top-k with ties to the smaller id can use (more where ids
repeat with different codes: (k + 1) times the most codes of one id). Nothing is
capped: what a full class leaves out is beaten by its own members.

Edge cases: rows whose vector is null, or holds null or non-finite components,
take no part; a vector of more components than the code has bits is an error, one
of fewer has zero bits in their place; a code of null takes no part; fewer
candidates than k give fewer rows; rows of a repeated id are searched by each of
its codes and a code's equal ids count once, so each (id, code) of a query gives
the k nearest ids, an id at its least distance; ties go to the smaller id; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, tidy

MASKS = 250_000
#: Parts into which ids of one code are dealt before their least ones are gathered.
SALTS = 64
#: Codes in a block of the final scan.
SCANNED = 4_096


def sign_code(vector: Column, bits: int = 64) -> Column:
    """Bit i is set where component i is above zero; ``bits`` at most 64. A longer vector is an error."""
    code = F.aggregate(
        F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda acc, x: acc.bitwiseOR(x),
    )
    return F.when(F.size(vector) > bits, F.raise_error(F.lit(f"a vector has more than {bits} components")).cast("long")).otherwise(code)


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def segment_widths(n: int, bits: int) -> list[int]:
    """Widths of the segments for ``n`` codes: about log2(n) bits each, 8 to 32."""
    width = min(max(log2(max(n, 2)), 8), 32, bits)
    segments = max(1, round(bits / width))
    return [bits // segments + (j < bits % segments) for j in range(segments)]


def _segments(code: Column, widths: list[int]) -> Column:
    shifts = [sum(widths[:j]) for j in range(len(widths))]
    return F.array(*[F.struct(F.lit(j).alias("segment"), F.shiftrightunsigned(code, s).bitwiseAND(F.lit((1 << w) - 1)).alias("value")) for j, (s, w) in enumerate(zip(shifts, widths, strict=True))])


def _flips(spark: SparkSession, widths: list[int], s: int) -> DataFrame:
    """The masks of round ``s`` for each segment: at most ``MASKS`` rows for each, whatever the data."""
    rows = [(j, sum(1 << b for b in c)) for j, w in enumerate(widths) for c in combinations(range(w), s)]
    return spark.createDataFrame(pa.table({"segment": pa.array([r[0] for r in rows], pa.int32()), "mask": pa.array([r[1] for r in rows], pa.int64())}).to_pandas())


def _best(rows: DataFrame, need: int) -> DataFrame:
    """(query, code, distance, n, far) of the nearest classes of each query, until ``need`` members are in; far: their largest distance, null while there are fewer members."""
    by_query = Window.partitionBy("query")
    rows = rows.repartition("query").dropDuplicates(["query", "code"])
    nearer = F.coalesce(F.sum("n").over(by_query.orderBy("distance").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = rows.withColumn("_nearer", nearer).where(F.col("_nearer") < need)
    kept = kept.withColumn("far", F.when(F.sum("n").over(by_query) >= need, F.max("distance").over(by_query)))
    return kept.select("query", "code", "distance", "n", "far")


def _scan(open_: DataFrame, classes: DataFrame, need: int) -> DataFrame:
    """(query, code, distance, n) of each open query's nearest classes among all codes, block by block."""
    spark = open_.sparkSession
    n = classes.count()
    blocks = max(1, -(-n // SCANNED))
    held = classes.select("code", F.size("ids").alias("n"), F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block"))
    groups = max(1, -(-open_.count() // SCANNED))
    asked = open_.select("query", F.pmod(F.xxhash64("query"), F.lit(groups)).alias("part")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        q, c = (np.asarray(t.column(0)).astype(np.int64) for t in (left, right))
        size = np.asarray(right.column("n"))
        out: list[tuple[np.ndarray, ...]] = []
        for x in q.tolist() if len(c) else ():
            d = np.bitwise_count((c ^ x).view(np.uint64)).astype(np.int32)
            order = np.argsort(d, kind="stable")
            first = int(np.searchsorted(np.cumsum(size[order]), need))
            take = np.flatnonzero(d <= d[order[min(first, len(d) - 1)]])
            out.append((np.full(len(take), x), c[take], d[take], size[take]))
        columns = [np.concatenate(v) for v in zip(*out, strict=True)] if out else [np.zeros(0, dtype=np.int64)] * 4
        return pa.table({"query": columns[0].astype(np.int64), "code": columns[1].astype(np.int64), "distance": columns[2].astype(np.int32), "n": columns[3].astype(np.int32)})

    pairs = asked.groupBy("part", "block").cogroup(held.select("code", "n", "part", "block").groupBy("part", "block"))
    return spark.createDataFrame([], "query long, code long, distance int, n int").unionByName(pairs.applyInArrow(run, "query long, code long, distance int, n int"))


def hamming_top_k(codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64, segments: int | None = None, id_col: str = "vec_id") -> DataFrame:
    """``codes`` and ``queries``: (id, code). Returns query_id, rank (from 1), id, distance; a query never finds its own id.

    ``segments`` overrides the number of segments that follows from the number of codes.
    """
    known = codes.where(F.col("code").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), "code")
    asked = queries.where(F.col("code").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("query_id"), F.col("code").alias("query"))
    codes_of = known.distinct().groupBy("id").agg(F.count("*").alias("c")).agg(F.max("c")).first()[0] or 1
    need = (k + 1) * codes_of
    least = lambda c: F.slice(F.sort_array(F.array_distinct(c)), 1, need)
    # Least ids of a code: by salted ranks first, so that no array grows with a hot code.
    salted = Window.partitionBy("code", "_salt").orderBy("id")
    few = known.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("_r", F.dense_rank().over(salted)).where(F.col("_r") <= need)
    classes = cut(few.groupBy("code").agg(least(F.collect_set("id")).alias("ids")))
    n = classes.count()
    widths = [bits // segments + (j < bits % segments) for j in range(segments)] if segments else segment_widths(n, bits)
    index = cut(classes.select("code", F.size("ids").alias("n"), F.explode(_segments(F.col("code"), widths)).alias("s")).select("code", "n", "s.segment", "s.value"))
    open_ = cut(asked.select("query", F.lit(None).cast("int").alias("far")).distinct())
    found, done = None, []
    for s in range(max(widths) + 1):
        if max(comb(w, s) for w in widths) > MASKS:
            done.append(_best(_scan(open_, classes, need), need))
            break
        probes = open_.select("query", "far", F.explode(_segments(F.col("query"), widths)).alias("s")).select("query", "far", "s.segment", "s.value")
        probes = probes.join(F.broadcast(_flips(codes.sparkSession, widths, s)), "segment").select("query", "far", "segment", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code")))
        met = probes.join(index, ["segment", "value"]).select("query", "code", distance.alias("distance"), "n", "far")
        met = met.where(F.col("far").isNull() | (F.col("distance") <= F.col("far"))).drop("far")
        found = cut(_best(met if found is None else met.unionByName(found), need))
        covered = len(widths) * (s + 1) - 1
        near = F.col("far") <= covered
        done.append(found.where(near))
        ends = found.groupBy("query").agg(F.max("far").alias("far"))
        open_ = open_.select("query").join(ends, "query", "left").where(F.coalesce(~near, F.lit(True)))
        if s == max(widths):
            done.append(found.where(F.coalesce(~near, F.lit(True))))
            break
        open_ = cut(open_)
        if open_.isEmpty():
            break
        found = found.where(F.coalesce(~near, F.lit(True))).drop("far")
        tidy()
    best = done[0].select("query", "code", "distance")
    for d in done[1:]:
        best = best.unionByName(d.select("query", "code", "distance"))
    rows = asked.distinct().join(best, "query").join(classes, "code").select("query_id", F.explode("ids").alias("id"), "distance").where("query_id <> id")
    rows = rows.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), F.col("distance").cast("int").alias("distance"))


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = read(spark, sf_dir, "embeddings").where(usable(F.col("embedding"))).select("vec_id", sign_code(F.col("embedding")).alias("code"))
    codes = cut(codes)
    return hamming_top_k(codes, codes.where("vec_id % 20 = 0"))


OP2_SQL = """
WITH v AS (
    SELECT vec_id, embedding FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), d AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda z: CASE WHEN (z[1] > 0) <> (z[2] > 0) THEN 1 ELSE 0 END))::INTEGER AS distance
    FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INTEGER AS rank FROM d
)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
