"""Operator 4: packing of token pieces into sequences by linear grouping.

1. Every document is encoded, ends in a separator id, and is cut into pieces
   of at most ``capacity`` ids if it is longer (the first may be shorter).
2. The count of pieces of each length (at most ``capacity`` rows, whatever the
   corpus) is all that the plan needs. Lengths above ``capacity * small`` are
   rounded up to the largest of their group, the groups holding equal numbers
   of pieces; configurations of the few rounded sizes are chosen by a knapsack
   that fills what the largest remaining size leaves; actual lengths take the
   rounded ones' places; small pieces then go best-fit into the gaps.
3. Pieces of a length are interchangeable: their rank within the length is
   found in hash buckets, and a range join with the plan gives the place.

Edge cases: a null text counts as empty, so it is one piece of one id; repeated
rows are packed each on their own; an empty table gives an empty table; other
columns of the input are not read. With ``added`` the added tokens of a json file
are matched in the texts, as the tokenizers library does (op4 and the pipeline);
without, their strings are ordinary text.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebpe import coder
from .common import cut, lean, parallelism, read


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Pieces of all documents: id, piece, start, length, ids_crc32 and, if asked for, ids."""
    engine = "json" if tokenizer_path.endswith(".json") else "ranks"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(engine, tokenizer_path, added)
        for batch in batches:
            for first, ids, bounds in c.batches(batch.column(1)):
                n = np.diff(bounds) + 1
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = n - (pieces - 1) * capacity
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                flat = np.insert(ids.astype("<u4"), bounds[1:], end_id)
                base = bounds[:-1] + np.arange(len(n))
                raw = memoryview(flat.tobytes())
                begin = (base[doc] + start).tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(begin, length.tolist(), strict=True)]
                columns = [batch.column(0).take(pa.array(doc + first)), pa.array(piece.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(length.astype(np.int64)), pa.array(crc, pa.int64())]
                names = [id_col, "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    edges = np.append(begin, len(flat)).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(edges), pa.array(flat.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), schema)


def linear_groups(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded size, [[actual size, count], ...]) for groups of equal cardinality, largest first."""
    share = max(1, -(-sum(counts.values()) // groups))
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            if not room:
                out.append((size, []))
                room = share
            n = min(left, room)
            out[-1][1].append([size, n])
            left, room = left - n, room - n
    return out


def _fill(room: int, sizes: list[int], counts: list[int]) -> list[int]:
    """Indices (with repeats) of sizes whose sum is the largest that ``room`` holds."""
    reach = np.full(room + 1, -1, dtype=np.int64)  # the item by which a sum was first reached
    reach[0] = len(sizes)
    for i, (s, n) in enumerate(zip(sizes, counts, strict=True)):
        if s > room or not n:
            continue
        before = reach.copy()
        for k in range(1, min(n, room // s) + 1):
            target = reach[k * s :]
            fresh = (target < 0) & (before[: room + 1 - k * s] >= 0)
            if not fresh.any():
                break
            target[fresh] = i
        if reach[room] >= 0:
            break
    at = int(np.flatnonzero(reach >= 0)[-1])
    used: list[int] = []
    while at:
        used.append(int(reach[at]))
        at -= sizes[used[-1]]
    return used


def plan_packing(counts: dict[int, int], capacity: int, groups: int = 2048, small: float = 0.25) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, offset): the pieces of
    ranks r in the range stand at ``offset`` in sequence ``first + r - first rank``."""
    large = {s: n for s, n in counts.items() if n and s > capacity * small}
    tiny = {s: n for s, n in counts.items() if n and s <= capacity * small}
    grouped = linear_groups(large, groups)
    sizes, queues = [g[0] for g in grouped], [list(map(list, g[1])) for g in grouped]
    left = [sum(n for _, n in q) for q in queues]
    runs: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)  # by free room: (sequences, lengths in them)
    top = 0
    while top < len(sizes):
        if not left[top]:
            top += 1
            continue
        left[top] -= 1
        used = [top, *(top + i for i in _fill(capacity - sizes[top], sizes[top:], left[top:]))]
        left[top] += 1
        need: dict[int, int] = defaultdict(int)
        for i in used:
            need[i] += 1
        times = min(left[i] // k for i, k in need.items())
        if not times:  # reached through a repeat that is not there: the largest size alone
            used, need, times = [top], {top: 1}, left[top]
        for i, k in need.items():
            left[i] -= times * k
        # Substitution: each place takes ``times`` actual pieces of its group, in runs of equal length.
        while times:
            now = times
            taken = []
            for i in used:
                while not queues[i][0][1]:
                    queues[i].pop(0)
                taken.append(queues[i][0])
            for q in {id(t): t for t in taken}.values():
                now = min(now, q[1] // sum(t is q for t in taken) or 1)
            lengths = []
            for i in used:
                while not queues[i][0][1]:
                    queues[i].pop(0)
                now = min(now, queues[i][0][1]) if now > 1 else now
            if now > 1:
                for t in taken:
                    t[1] -= now
                    lengths.append(t[0])
            else:
                for i in used:
                    while not queues[i][0][1]:
                        queues[i].pop(0)
                    queues[i][0][1] -= 1
                    lengths.append(queues[i][0][0])
            runs[capacity - sum(lengths)].append((now, lengths))
            times -= now
    for size in sorted(tiny, reverse=True):
        n = tiny[size]
        while n:
            room = min((r for r, x in runs.items() if r >= size and x), default=None)
            if room is None:
                new = -(-n // (capacity // size))
                runs[capacity - size].append((new, [size]))
                n -= new
                continue
            times, lengths = runs[room].pop()
            k = min(n, times)
            if k < times:
                runs[room].append((times - k, lengths))
            runs[room - size].append((k, [*lengths, size]))
            n -= k
    rank: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for times, lengths in (x for room in sorted(runs) for x in runs[room]):
        offset = 0
        for size in lengths:
            rows.append((size, rank[size], rank[size] + times, sequence, offset))
            rank[size] += times
            offset += size
        sequence += times
    return rows


def pack_pieces(pieces: DataFrame, capacity: int = 1024, id_col: str = "doc_id") -> DataFrame:
    """``pieces`` with sequence_id and offset. The driver sees counts by length and the plan alone; both are bounded by the capacity."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan_packing(counts, capacity)
    plan = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length long, rank_from long, rank_to long, sequence_from long, place long")
    order = [F.col(c) for c in (id_col, "piece", "start", "ids_crc32")]
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(parallelism(spark))))
    sums = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n")).select("length", "_bucket", F.coalesce(F.sum("_n").over(sums), F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # The plan is bounded: runs of (configuration, actual lengths) of at most ``capacity`` lengths.
    return (
        ranked.join(F.broadcast(plan), "length")
        .where((F.col("_rank") >= F.col("rank_from")) & (F.col("_rank") < F.col("rank_to")))
        .withColumn("sequence_id", F.col("sequence_from") + F.col("_rank") - F.col("rank_from"))
        .withColumnRenamed("place", "offset")
        .select(*pieces.columns, "sequence_id", "offset")
    )


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = cut(token_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True))
    return pack_pieces(pieces)
