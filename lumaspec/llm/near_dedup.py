"""Operator 10: near-duplicate documents by banded MinHash and odd sketches.

1. Each text's set of 5-word shingles gives ``BANDS * ROWS`` MinHash samples.
   Bands of ``ROWS`` samples are bucket keys; the odd sketch is a bitmap of
   ``SKETCH_BITS`` in which every sample (its number and its value) flips one
   bit, so two sketches' XOR holds the parity of the samples that differ.
2. Texts of equal sets are one class with a number of its own; ids come back in
   the last step only, so rows that share an id but not a text stay apart.
3. In each bucket every class is compared with one pivot (a star, as many pairs
   as members), for ``STARS`` choices of pivot. In a bucket whose classes are
   then not all connected, the classes outside the bucket's largest component
   are compared with all classes of other components, so no link between
   different components is lost. The XOR's population count decides which
   pairs are worth an exact check (estimates down to five standard errors below
   the threshold pass), and each pair that passes is confirmed on the two full
   shingle sets: pairs of buckets of up to ``SMALL`` classes by joins with the
   texts, those of larger buckets inside the tasks of their blocks, where each
   pair is checked in the first bucket it shares and links alone come out.
   Blocks hold at most about ``BLOCK`` classes of a side and ``BLOCK_BYTES`` of
   sets, however large their bucket.
4. Confirmed links are joined to components by label passing with pointer
   jumping, in tables.

A pair at the threshold shares no bucket with probability
(1 - 0.75**ROWS)**BANDS, about 2e-6 for independent samples, and the sketch
leaves out a pair whose estimate is more than five standard errors too low;
every pair that passes both is confirmed exactly.

Edge cases: null, empty and blank texts have empty sets, are linked with
nothing and are components of their own; repeated rows are one class; rows of
equal id and different texts are linked each by its own text; rows with null id
are components of their own; ties of ids go to the least; an empty table gives
an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, mix64, read, text_runs, tidy
from .shingles import shingle_sets

BANDS, ROWS = 48, 5
SKETCH_BITS = 1024
STARS = 2
SMALL, BLOCK, BLOCK_BYTES = 16, 512, 8_000_000
SAMPLES = BANDS * ROWS
#: Bytes of texts whose shingles a worker holds at a time (one text is never cut).
TEXT_BYTES = 1_000_000
_SEEDS = (mix64(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_FACTORS = (mix64(np.arange(SAMPLES + 1, 2 * SAMPLES + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def xor_limit(similarity: float, samples: int = SAMPLES, bits: int = SKETCH_BITS, errors: float = 5.0) -> int:
    """Largest population count of an XOR that a pair of this similarity reaches, ``errors`` standard errors allowed."""
    low = similarity - errors * np.sqrt(similarity * (1 - similarity) / samples)
    differ = 2 * samples * (1 - low)
    mean = bits / 2 * (1 - np.exp(-2 * differ / bits))
    return int(np.ceil(mean + errors * np.sqrt(mean * (1 - mean / bits)) / 3))


def signatures(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES) MinHash samples; rows of empty sets are 0."""
    some = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, SAMPLES), dtype=np.uint32)
    if not len(some):
        return out
    short = (sets >> np.uint64(32)).astype(np.uint32)
    begin = bounds[some]
    with np.errstate(over="ignore"):
        for k in range(SAMPLES):
            out[some, k] = np.minimum.reduceat((short ^ _SEEDS[k]) * _FACTORS[k], begin)
    return out


def sketches(samples: np.ndarray) -> np.ndarray:
    """(texts, SKETCH_BITS / 8) bytes: parity bitmaps of the samples."""
    cell = mix64(samples.astype(np.uint64) + (np.arange(1, SAMPLES + 1, dtype=np.uint64) << np.uint64(32))) % np.uint64(SKETCH_BITS)
    flat = cell.astype(np.int64) + np.arange(len(samples))[:, None] * SKETCH_BITS
    parity = np.bincount(flat.ravel(), minlength=len(samples) * SKETCH_BITS) & 1
    return np.packbits(parity.astype(np.uint8).reshape(len(samples), SKETCH_BITS), axis=1)


def band_keys(samples: np.ndarray) -> np.ndarray:
    """(texts, BANDS) bucket keys; a band's number is part of its key."""
    parts = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key.astype(np.int64)


def fingerprints(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text as binary): id, th (hash of the text), n (shingles), h1, h2 (of the set), keys (array), sketch (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_runs(batch.column(2), TEXT_BYTES):
                sets, bounds = shingle_sets([t or b"" for t in batch.column(2).slice(a, b - a).to_pylist()])
                n = np.diff(bounds)
                sums = []
                with np.errstate(over="ignore"):
                    for salt in (0x1B873593, 0xCC9E2D51):
                        c = np.concatenate([[np.uint64(0)], np.cumsum(mix64(sets ^ np.uint64(salt)), dtype=np.uint64)])
                        sums.append((c[bounds[1:]] - c[bounds[:-1]]).astype(np.int64))
                samples = signatures(sets, bounds)
                keys, drawn = band_keys(samples), sketches(samples)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n), *map(pa.array, sums), pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.ravel())), pa.array([x.tobytes() for x in drawn], pa.binary())],
                    names=["id", "th", "n", "h1", "h2", "keys", "sketch"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", F.xxhash64("text").alias("th"), "text").mapInArrow(lean(run), f"id {kind}, th long, n long, h1 long, h2 long, keys array<long>, sketch binary")


def _near(xor_most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("sa").to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
                y = np.frombuffer(b"".join(batch.column("sb").to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
                keep = np.bitwise_count(x ^ y).sum(axis=1) <= xor_most
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in text_runs(batch.column("ta"), TEXT_BYTES // 2):  # linked texts are of like length
                part = batch.slice(at, end - at)
                both = [t or b"" for c in ("ta", "tb") for t in part.column(c).to_pylist()]
                texts = list(dict.fromkeys(both))
                sets, bounds = shingle_sets(texts)
                number = {t: i for i, t in enumerate(texts)}
                each = [sets[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                n = part.num_rows
                keep = []
                for x, y in zip(both[:n], both[n:], strict=True):
                    keep.append(_linked(each[number[x]], each[number[y]], percent))
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _linked(p: np.ndarray, q: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are linked."""
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return common > 0 and 100 * common >= percent * (len(p) + len(q) - common)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole blocks of a partition that is sorted by block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        number = np.asarray(batch.column("block"))
        other = np.flatnonzero(number != number[-1])
        if len(other):  # what stands before the last block of this batch is whole
            end = int(other[-1]) + 1
            yield pa.Table.from_batches([*held, batch.slice(0, end)])
            held = [batch.slice(end)]
        elif held and np.asarray(held[-1].column("block"))[-1] != number[0]:
            yield pa.Table.from_batches(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _pairs(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    x, y = (np.concatenate(v) if v else np.zeros(0, dtype=np.int64) for v in (a, b))
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _small_blocks(xor_most: int, percent: int):
    """Pairs of rows of one small bucket from different components that may be near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_blocks(batches):
            number, ids, comp, n = (np.asarray(t.column(c)) for c in ("block", "cls", "comp", "n"))
            sketch = _words(t.column("sketch"))
            left, right = [], []
            rows = np.arange(len(ids))
            d = 1
            while len(rows):
                rows = rows[rows + d < len(ids)]
                rows = rows[number[rows] == number[rows + d]]
                x, y = rows, rows + d
                fit = (comp[x] != comp[y]) & (np.minimum(n[x], n[y]) * 100 >= percent * np.maximum(n[x], n[y]))
                x, y = x[fit], y[fit]
                near = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1) <= xor_most
                left.append(ids[x[near]])
                right.append(ids[y[near]])
                d += 1
            yield _pairs(left, right)

    return run


def _large_blocks(xor_most: int, percent: int):
    """Links between a block's rows of different components, one side outside the bucket's largest component (``minor``).

    Rows carry their bucket's key, all their keys and their set; a pair counts
    in the first bucket that both share. Rows of side 0 meet those of side 1;
    in a block of side 2 all meet.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_blocks(batches):
            number = np.asarray(t.column("block"))
            edges = [0, *(np.flatnonzero(number[1:] != number[:-1]) + 1).tolist(), len(number)]
            left, right = [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                ids, comp, n, side, key, minor = (np.asarray(t.column(c).slice(a, b - a)) for c in ("cls", "comp", "n", "side", "key", "minor"))
                sketch = _words(t.column("sketch").slice(a, b - a))
                keys = np.asarray(t.column("keys").slice(a, b - a).combine_chunks().flatten()).reshape(b - a, BANDS)
                raw = t.column("set").slice(a, b - a)
                sets: dict[int, np.ndarray] = {}
                rows = np.arange(b - a)
                for x in np.flatnonzero(minor & (side != 1)).tolist():
                    fit = (comp != comp[x]) & (np.minimum(n, n[x]) * 100 >= percent * np.maximum(n, n[x]))
                    fit &= (side == 1) if side[x] == 0 else ~minor | (rows > x)
                    y = np.flatnonzero(fit)
                    y = y[np.bitwise_count(sketch[y] ^ sketch[x]).sum(axis=1) <= xor_most]
                    same = keys[y] == keys[x]
                    y = y[keys[x][np.argmax(same, axis=1)] == key[x]] if len(y) else y
                    for i in {x, *y.tolist()} - sets.keys() if len(y) else ():
                        sets[i] = np.frombuffer(raw[i].as_py(), dtype=np.uint64)
                    hit = [i for i in y.tolist() if _linked(sets[x], sets[i], percent)]
                    left.append(np.full(len(hit), ids[x]))
                    right.append(ids[hit])
            yield _pairs(left, right)

    return run


def _words(column: pa.ChunkedArray) -> np.ndarray:
    """Sketches as rows of 64-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint64).reshape(len(column), -1)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, set): the sorted shingle hashes of each text, as bytes."""
    for batch in batches:
        for a, b in text_runs(batch.column(1), TEXT_BYTES):
            part = batch.slice(a, b - a)
            sets, bounds = shingle_sets([t or b"" for t in part.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sets[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())], names=["cls", "set"])


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the least id reachable from each id of ``edges`` (a, b)."""
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), forget=True)
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("comp")).select(F.col("a").alias("id"), "comp"), forget=True)
    while True:
        around = both.join(labels.select(F.col("id").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        step = labels.join(around.withColumnRenamed("a", "id"), "id").select("id", "comp", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("comp").alias("far"))
        new = cut(step.join(jump, "next", "left").select("id", F.col("comp").alias("old"), F.least("next", F.coalesce("far", "next")).alias("comp")), forget=True)
        labels = new.select("id", "comp")
        del around, step, jump
        if new.where("old <> comp").isEmpty():
            return labels
        tidy()


def _blocks(left: DataFrame) -> DataFrame:
    """``left`` (key, cls, comp, n, major, minors, minor_sum, m, n_sum, sketch) with the blocks of each row: block, side, minor.

    The minors of a bucket are cut into ``p`` parts and the rows of its largest
    component into ``q``; each part of minors meets itself, each other part and
    each part of the largest component. A bucket of one part each is one block.
    """

    def parts(rows: str, shingles: str) -> Column:
        return F.greatest(F.lit(1), F.ceil(F.expr(rows) / BLOCK), F.ceil(F.expr(shingles) * 8 / BLOCK_BYTES)).cast("int")

    rows = left.withColumn("minor", F.col("comp") != F.col("major")).withColumn("p", parts("minors", "minor_sum")).withColumn("q", parts("m - minors", "n_sum - minor_sum"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("cls"), F.when(F.col("minor"), F.col("p")).otherwise(F.col("q"))).cast("int"))
    mine, to = F.col("mine"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, x, y, side: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"), side.cast("int").alias("side"))
    among = F.transform(to("p"), lambda o: place(0, F.least(mine, o), F.greatest(mine, o), F.when(mine == o, 2).when(mine < o, 0).otherwise(1)))
    across = F.transform(to("q"), lambda j: place(1, mine, j, F.lit(0)))
    against = F.transform(to("p"), lambda i: place(1, i, mine, F.lit(1)))
    one = F.array(place(0, F.lit(0), F.lit(0), F.lit(2)))
    places = F.when((F.col("p") == 1) & (F.col("q") == 1), one).when(F.col("minor"), F.concat(among, across)).otherwise(against)
    rows = rows.withColumn("at", F.explode(places))
    return rows.select(F.xxhash64("key", "at.kind", "at.x", "at.y").alias("block"), "cls", "comp", "n", "at.side", "minor", "sketch", "key")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles, component_id, kept, text_hash (xxhash64 of the text's bytes) and component for each row of ``docs``; links are pairs of Jaccard similarity ``percent`` / 100 or more.

    ``component`` is a number of the component that tells rows of one id apart (null for rows that are linked with nothing by definition).
    """
    most = xor_limit(percent / 100)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    prints = cut(fingerprints(rows))
    filled = prints.where("n > 0 AND id IS NOT NULL")
    # Numbers of classes are read from the checkpoint alone, so they stay what they are.
    classes = filled.groupBy("h1", "h2").agg(F.min(F.struct("id", "th")).alias("rep"), F.first(F.struct("n", "keys", "sketch")).alias("v"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("cls"), "h1", "h2", "rep.id", "rep.th", "v.n", "v.keys", "v.sketch"))
    members = classes.select("cls", "n", F.explode("keys").alias("key"))
    shared = cut(members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"))
    buckets = cut(members.join(shared, "key").select("key", "cls", "n"))
    info = cut(classes.join(buckets.select("cls").distinct(), "cls", "left_semi").select("cls", "id", "th", "n", "sketch", "keys"))
    del members, shared, filled
    tidy()
    texts = cut(rows.withColumn("th", F.xxhash64("text")).join(info.select("cls", "id", "th"), ["id", "th"]).select("cls", "text").dropDuplicates(["cls"]))
    labels = cut(info.select("cls", F.col("cls").alias("comp")))
    tidy()
    pair, tested, links = "a long, b long", None, None

    def check(pairs: DataFrame) -> DataFrame:
        """Pairs confirmed on full sets."""
        with_a = pairs.join(texts.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
        with_b = with_a.join(texts.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b")
        return with_b.mapInArrow(lean(_confirm(percent)), pair)

    for turn in range(STARS + 1):
        placed = buckets.join(labels, "cls")
        if turn < STARS:
            seat = F.struct("cls", "comp")
            # Written out, so that a hot key's rows can be split in the join after it.
            open_ = cut(placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), (F.min if turn == 0 else F.max)(seat).alias("pivot")).where("low < high").select("key", "pivot"))
            stars = placed.join(open_, "key").where(F.col("comp") != F.col("pivot.comp"))
            pairs = stars.select(F.least("cls", "pivot.cls").alias("a"), F.greatest("cls", "pivot.cls").alias("b")).distinct()
            sides = [info.select(F.col("cls").alias(c), F.col("n").alias(f"n{c}"), F.col("sketch").alias(f"s{c}")) for c in ("a", "b")]
            pairs = pairs.join(sides[0], "a").join(sides[1], "b").where(F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb"))
            pairs = pairs.select("a", "b", "sa", "sb").mapInArrow(_near(most), pair)
        else:
            by_comp = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
            largest = F.max(F.struct("c", "s", "comp"))
            sums = by_comp.groupBy("key").agg(F.sum("c").alias("m"), F.sum("s").alias("n_sum"), largest.alias("top")).where("top.c < m")
            open_ = cut(sums.select("key", "m", "n_sum", F.col("top.comp").alias("major"), (F.col("m") - F.col("top.c")).alias("minors"), (F.col("n_sum") - F.col("top.s")).alias("minor_sum")))
            few = placed.join(open_.where(F.col("m") <= SMALL), "key").join(info.select("cls", "sketch"), "cls").select(F.col("key").alias("block"), "cls", "comp", "n", "sketch")
            pairs = few.repartition("block").sortWithinPartitions("block", "cls").mapInArrow(_small_blocks(most, percent), pair).distinct()
            many = _blocks(placed.join(open_.where(F.col("m") > SMALL), "key").join(info.select("cls", "sketch"), "cls"))
            wanted = placed.join(open_.where(F.col("m") > SMALL), "key").select("cls").distinct()
            sets = texts.join(wanted, "cls", "left_semi").select("cls", "text").mapInArrow(lean(_sets), "cls long, set binary")
            many = many.join(sets.join(info.select("cls", "keys"), "cls"), "cls")
            direct = many.repartition("block").sortWithinPartitions("block", "cls").mapInArrow(lean(_large_blocks(most, percent)), pair)
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        found = cut(check(pairs) if turn < STARS else check(pairs).unionByName(direct))
        tested = pairs if tested is None else tested.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        del pairs, placed, open_
        tidy()
        joined = components(links)
        labels = cut(info.select("cls").join(joined, F.col("cls") == F.col("id"), "left").select("cls", F.coalesce("comp", "cls").alias("comp")))
    least = cut(labels.join(info.select("cls", "id"), "cls").groupBy("comp").agg(F.min("id").alias("least")))
    ends = labels.join(least, "comp").select("cls", "least", "comp")
    heads = classes.select("h1", "h2", "id", "cls").join(ends, "cls", "left").select("h1", "h2", F.coalesce("least", "id").alias("component_id"), F.coalesce("comp", "cls").alias("component"))
    every = prints.select("id", "n", "h1", "h2", "th")
    whole = every.where("n > 0 AND id IS NOT NULL").join(heads, ["h1", "h2"]).select("id", "n", "component_id", "th", "component")
    alone = every.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id"), "th", F.lit(None).cast("long").alias("component"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")
    return whole.unionByName(alone).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", kept, F.col("th").alias("text_hash"), "component")


def op10_minhash_odd_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).drop("text_hash", "component")


OP10_SQL = r"""
WITH words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words
), shingles AS (
    SELECT doc_id, unnest(s) AS g FROM sets
), sizes AS (
    SELECT doc_id, len(s) AS n FROM sets
), common AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
), both_ways AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
)
, reach AS (
    WITH RECURSIVE r(id, place) AS (
        SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM r JOIN both_ways e ON e.a = r.place
    ) SELECT id, min(place) AS component_id FROM r GROUP BY id
)
SELECT s.doc_id, s.n::BIGINT AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
FROM sizes s JOIN reach r ON r.id = s.doc_id
"""
