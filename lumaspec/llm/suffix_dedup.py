"""Operator 9: removal of byte strings repeated from documents of smaller id.

Every window of ``WIDTH`` bytes is assigned to its anchor, the substring of
``ANCHOR`` bytes with the least hash in it. Equal windows have equal anchors, so
anchors deal the work out exactly. An anchor is so long that it rarely repeats
where no window does, however large the table: strings of such an anchor would
be merged for nothing, and their number grows with the square of the table's:

1. Documents are dealt into groups of a few MB. Each group sends the hashes of
   its anchors to buckets; a bucket tells each group which of them stand in
   more than one document. Windows of other anchors cannot repeat.
2. Maximal runs of windows with one repeated anchor are strings of at most
   2 * WIDTH - ANCHOR bytes; each group sends its different ones, each with its
   least document, to the anchor's bucket. There each share of the groups is a
   shard with a Burrows-Wheeler transform of its own; the shards' transforms are
   merged by interleave refinement (``bwt``), and the repeated intervals give
   the least document of every window.
3. Each group removes the bytes covered by windows whose least document is
   smaller than their own.

Nothing but hashes, strings of repeated anchors and answers travels; groups,
buckets and tasks have a bounded part of the text, and a passage that many
documents share is sent once by each group.

Edge cases: a null text counts as empty; texts under WIDTH bytes are kept; rows
of equal id do not count against each other; a text of 256 MB or more raises a
ValueError; rows with null id are kept whole
and count against no one; an empty table gives an empty table; other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwt import least_owners
from .common import SpanHasher, mix64, read, release

#: ANCHOR is a multiple of 8.
WIDTH, ANCHOR = 50, 24
#: Bytes of text in a group, on average.
GROUP_BYTES = 4_000_000
#: Groups whose text a bucket of hashes, and one of strings, has as its share of the input. Messages between groups and buckets are fewer with more.
GROUPS_PER_KEY_BUCKET, GROUPS_PER_BUCKET = 4, 1
#: Shards whose transforms a bucket merges: each holds the strings of a share of the groups.
SHARDS = 8
#: Bits of an anchor's hash that travel; a bucket's number tells the rest. Anchors taken for equal only cost work.
KEY_BITS = 40
#: Bytes of text whose windows are looked for at a time.
BLOCK_BYTES = 400_000
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_HASHER = SpanHasher()
_SENT = "bucket long, g long, data binary"
_SENT_ARROW = pa.schema([("bucket", pa.int64()), ("g", pa.int64()), ("data", pa.binary())])


class Windows:
    """The documents of one group and the runs of windows that share an anchor."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.ids, self.hashes = np.asarray(table.column("doc_id")), table.column("text_hash")
        texts = [t or b"" for t in table.column("text").to_pylist()]
        self.sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.raw = b"".join(texts)
        self.data = np.frombuffer(self.raw, dtype=np.uint8)
        parts, a = [], 0
        while a < len(texts):  # blocks of whole texts, small enough for the processor's caches
            b, size = a, 0
            while b < len(texts) and (b == a or size + self.sizes[b] <= BLOCK_BYTES):
                size += self.sizes[b]
                b += 1
            parts.append(self._block(a, b))
            a = b
        starts, stops, doc, anchors = zip(*parts, strict=True) if parts else ([np.zeros(0, dtype=np.int64)],) * 3 + ([np.zeros(0, dtype=np.uint64)],)
        self.starts, self.stops, self.doc, self.anchors = (np.concatenate(x) for x in (starts, stops, doc, anchors))

    def _block(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First and end windows, text and anchor hash of each run of texts a to b."""
        base = int(self.begin[a])
        data = self.data[base : int(self.begin[b - 1] + self.sizes[b - 1])]
        n = len(data) - WIDTH + 1
        if n <= 0:
            return (np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)
        words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=data, strides=(1,)).astype(np.uint64)  # 8 bytes from each place
        m = len(data) - ANCHOR + 1
        grams = words[:m] * np.uint64(0x9E3779B97F4A7C15)
        for at in range(8, ANCHOR, 8):
            grams ^= grams >> np.uint64(29)
            grams += words[at : at + m]
            grams *= np.uint64(0xBF58476D1CE4E5B9)
        grams ^= grams >> np.uint64(32)
        grams *= np.uint64(0x94D049BB133111EB)
        if len(data) >= 1 << 28:
            raise ValueError("a text of 256 MB or more is not supported")
        low = np.uint64((1 << 28) - 1)
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        span, size = 1, WIDTH - ANCHOR + 1
        while span * 2 <= size:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:n], least[size - span : size - span + n])
        place = (least & low).astype(np.int64)
        first = np.empty(n, dtype=bool)
        first[0] = True
        np.not_equal(place[1:], place[:-1], out=first[1:])
        edges = self.begin[a:b] - base
        ends = edges + self.sizes[a:b]
        first[edges[edges < n]] = True
        outside = np.maximum(ends - WIDTH + 1, edges)  # windows from here on would leave their text
        first[outside[outside < n]] = True
        starts = np.flatnonzero(first)
        stops = np.append(starts[1:], n)
        doc = np.searchsorted(edges, starts, "right") - 1
        keep = starts + WIDTH <= ends[doc]
        starts, stops, doc = starts[keep], stops[keep], doc[keep]
        return starts + base, stops + base, doc + a, grams[place[starts]]

    def keys(self, buckets: int) -> np.ndarray:
        return _keys(self.anchors % np.uint64(buckets), self.anchors >> np.uint64(64 - KEY_BITS))

    def anchor_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Different anchors, and whether each stands in two documents here."""
        order = np.argsort(self.anchors, kind="stable")
        a, d = self.anchors[order], self.ids[self.doc[order]]
        fresh = np.ones(len(a), dtype=bool)
        fresh[1:] = a[1:] != a[:-1]
        at = np.flatnonzero(fresh)
        if not len(at):
            return a, fresh
        return a[at], np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)

    def strings(self, repeated: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of repeated anchors: (their numbers, first run of each different string, number of each run's string)."""
        runs = np.flatnonzero(np.isin(self.keys(buckets), repeated, kind="sort")) if len(repeated) else np.zeros(0, dtype=np.int64)
        a, b = self.starts[runs], self.stops[runs] + WIDTH - 1
        if not len(runs):
            return runs, runs, runs
        edges = np.append(np.flatnonzero(np.diff(a // BLOCK_BYTES, prepend=-1)), len(a))  # runs that start in one block of bytes: small tables of powers
        key = np.concatenate([_HASHER(self.data[a[i] : b[k - 1]], a[i:k] - a[i], b[i:k] - a[i], _TABLE) for i, k in zip(edges[:-1], edges[1:], strict=True)])
        _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        return runs, runs[first], inverse


def _keys(bucket: np.ndarray, short: np.ndarray) -> np.ndarray:
    """One number for a bucket and the bits of a hash that travel."""
    return mix64(bucket) ^ short


def _short(hashes: np.ndarray) -> bytes:
    """The upper ``KEY_BITS`` bits of each hash."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BITS // 8 :].tobytes()


def _long(raw: bytes) -> np.ndarray:
    """What ``_short`` wrote, as numbers."""
    n = KEY_BITS // 8
    out = np.zeros((len(raw) // n, 8), dtype=np.uint8)
    out[:, :n] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, n)
    return out.view("<u8").ravel().astype(np.uint64)


def _pack(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.decompress(data[4:], decompressed_size=int.from_bytes(data[:4], "little"), codec="zstd", asbytes=True)


def _by_bucket(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of hashes by bucket, and where the buckets begin and which they are."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    names, at = np.unique(bucket[order], return_index=True)
    return order, np.append(at, len(order)), names


def _whole(run):
    """``run``, a function of tables, with the worker's memory given back after each group."""

    def one(table: pa.Table) -> pa.Table:
        try:
            return run(table)
        finally:
            release()

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return run(left, right)
        finally:
            release()

    return two if run.__code__.co_argcount == 2 else one


def _send(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_pydict({"bucket": [r[0] for r in rows], "g": [r[1] for r in rows], "data": [r[2] for r in rows]}, schema=_SENT_ARROW)


def _announce(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        hashes, twice = Windows(table).anchor_hashes()
        order, at, names = _by_bucket(hashes, buckets)
        return _send([(int(k), g, _short(hashes[x]) + twice[x].tobytes()) for k, x in ((k, order[a:b]) for k, a, b in zip(names, at[:-1], at[1:], strict=True))])

    return run


def _repeated(table: pa.Table) -> pa.Table:
    """Tells each group which of its anchors repeat."""
    groups, raw = table.column("g").to_pylist(), table.column("data").to_pylist()
    width = KEY_BITS // 8
    sizes = [len(r) // (width + 1) for r in raw]
    hashes = np.concatenate([_long(r[: width * k]) for r, k in zip(raw, sizes, strict=True)])
    twice = np.concatenate([np.frombuffer(r[width * k :], dtype=bool) for r, k in zip(raw, sizes, strict=True)])
    names, inverse, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    many = counts > 1
    many[inverse[twice]] = True
    bucket, out, a = table.column("bucket")[0].as_py(), [], 0
    for g, k in zip(groups, sizes, strict=True):
        x = hashes[a : a + k][many[inverse[a : a + k]]]
        if len(x):
            out.append((bucket, g, _short(x << np.uint64(64 - KEY_BITS))))
        a += k
    return _send(out)


def _known(told: pa.Table) -> np.ndarray:
    buckets = np.asarray(told.column("bucket")).astype(np.uint64)
    rows = [_keys(b, _long(r)) for b, r in zip(buckets, told.column("data").to_pylist(), strict=True)]
    return np.sort(np.concatenate(rows)) if rows else np.zeros(0, dtype=np.uint64)


def _submit(keys: int, buckets: int | None = None):
    """``keys``: how many buckets of hashes there are; ``buckets``: of strings, as many if not given."""
    buckets = buckets or keys

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows or not told.num_rows:
            return _send([])
        w = Windows(docs)
        g = docs.column("g")[0].as_py()
        _, first, _ = w.strings(_known(told), keys)
        order, at, names = _by_bucket(w.anchors[first], buckets)
        out = []
        for k, a, b in zip(names, at[:-1], at[1:], strict=True):
            x = first[order[a:b]]
            starts, ends = w.starts[x], w.stops[x] + WIDTH - 1
            text = b"".join(w.raw[i:j] for i, j in zip(starts.tolist(), ends.tolist(), strict=True))
            head = np.array([len(x)], dtype="<u4").tobytes()
            anchor = (w.anchors[x] >> np.uint64(32)).astype("<u4").tobytes()
            out.append((int(k), g, _pack(head + w.ids[w.doc[x]].astype("<i8").tobytes() + anchor + (ends - starts).astype(np.uint8).tobytes() + text)))
        return _send(out)

    return run


def _answer(table: pa.Table) -> pa.Table:
    """Merges the transforms of a bucket's strings; answers each group with runs of (length, least document) for its strings."""
    table = table.sort_by([("g", "ascending")])
    groups, raw = table.column("g").to_pylist(), map(_unpack, table.column("data").to_pylist())
    number: dict[bytes, int] = {}
    owners: list[int] = []
    anchors: list[int] = []
    known = [0]  # strings after each group
    sent: list[list[int]] = []
    for r in raw:
        n = int(np.frombuffer(r[:4], dtype="<u4")[0])
        ids = np.frombuffer(r[4 : 4 + 8 * n], dtype="<i8").tolist()
        keys = np.frombuffer(r[4 + 8 * n : 4 + 12 * n], dtype="<u4").tolist()
        ends = np.cumsum(np.frombuffer(r[4 + 12 * n : 4 + 13 * n], dtype=np.uint8)).tolist()
        text, a, mine = r[4 + 13 * n :], 0, []
        for doc, key, b in zip(ids, keys, ends, strict=True):
            s = text[a:b]
            i = number.setdefault(s, len(owners))
            if i == len(owners):
                owners.append(doc)
                anchors.append(key)
            elif doc < owners[i]:
                owners[i] = doc
            mine.append(i)
            a = b
        sent.append(mine)
        known.append(len(owners))
    # Windows of an anchor with one string alone belong to that string's least document. The others are dealt into
    # shards by the groups that brought them, and the shards' transforms are merged.
    _, inverse, count = np.unique(np.array(anchors, dtype=np.uint32), return_inverse=True, return_counts=True)
    shared = count[inverse] > 1
    owner, strings = np.array(owners, dtype=np.int64), list(number)
    windows = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)) - WIDTH + 1
    string = np.repeat(np.arange(len(windows)), windows)
    least = owner[string]
    before = np.concatenate([[0], np.cumsum(shared)])[known]  # strings to merge, after each group
    edges = before[np.linspace(0, len(groups), min(SHARDS, len(groups)) + 1).astype(np.int64)]
    least[shared[string]] = least_owners([strings[i] for i in np.flatnonzero(shared)], owner[shared], WIDTH, np.diff(edges).tolist())[0]
    fresh = np.ones(len(least), dtype=bool)
    fresh[1:] = (least[1:] != least[:-1]) | (string[1:] != string[:-1])
    at = np.flatnonzero(fresh)
    length = np.diff(np.append(at, len(least))).astype(np.uint8)
    value = least[at].astype("<i8")
    edges = np.searchsorted(string[at], np.arange(len(windows) + 1))
    bucket, out = table.column("bucket")[0].as_py(), []
    for g, mine in zip(groups, sent, strict=True):
        x = np.array(mine)
        count = edges[x + 1] - edges[x]
        take = np.repeat(edges[x] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        head = np.array([len(x), len(take)], dtype="<u4").tobytes()
        out.append((bucket, g, head + value[take].tobytes() + count.astype(np.uint8).tobytes() + length[take].tobytes()))
    return _send(out)


_RESULT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _remove(keys: int, buckets: int | None = None):
    buckets = buckets or keys

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _RESULT.empty_table()
        w = Windows(docs)
        change = np.zeros(len(w.data) + WIDTH + 1, dtype=np.int32)
        kinds = np.asarray(told.column("kind")) if told.num_rows else np.zeros(0, dtype=np.int32)
        answers = {b: r for b, r, k in zip(told.column("bucket").to_pylist(), told.column("data").to_pylist(), kinds, strict=True) if k == 1}
        if answers:
            runs, first, inverse = w.strings(_known(told.filter(pa.array(kinds == 0))), keys)
            order, at, names = _by_bucket(w.anchors[first], buckets)
            counts, lengths, values = [], [], []
            for k in names.tolist():
                r = answers[k]
                n, m = np.frombuffer(r[:8], dtype="<u4").tolist()
                values.append(np.frombuffer(r[8 : 8 + 8 * m], dtype="<i8"))
                counts.append(np.frombuffer(r[8 + 8 * m : 8 + 8 * m + n], dtype=np.uint8))
                lengths.append(np.frombuffer(r[8 + 8 * m + n :], dtype=np.uint8))
            count, length, value = (np.concatenate(x).astype(np.int64) for x in (counts, lengths, values))
            where = np.empty(len(first), dtype=np.int64)  # of a string among the answers
            where[order] = np.arange(len(first))
            edge = np.cumsum(count) - count
            offset = np.cumsum(length) - length  # windows before each answered run
            mine = where[inverse]
            k = count[mine]
            take = np.repeat(edge[mine] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            run = np.repeat(np.arange(len(runs)), k)
            less = value[take] < w.ids[w.doc[runs[run]]]
            take, run = take[less], run[less]
            start = w.starts[runs[run]] + offset[take] - offset[edge[mine[run]]]
            np.add.at(change, start, 1)
            np.add.at(change, start + length[take] - 1 + WIDTH, -1)
        gone = np.cumsum(change[: len(w.data)], dtype=np.int32) > 0
        kept, removed = [], []
        for a, n in zip(w.begin.tolist(), w.sizes.tolist(), strict=True):
            x = gone[a : a + n]
            if not x.any():
                kept.append(w.raw[a : a + n])
                removed.append([])
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], x.view(np.int8), [0]]))).reshape(-1, 2).tolist()
            kept.append(w.data[a : a + n][~x].tobytes())
            removed.append([{"start": i, "end": j} for i, j in edges])
        return pa.Table.from_pydict({"doc_id": w.ids, "text_hash": w.hashes, "n_bytes": w.sizes, "kept": kept, "removed": removed}, schema=_RESULT)

    return run


def key_buckets(groups: int) -> int:
    return -(-groups // GROUPS_PER_KEY_BUCKET)


def string_buckets(groups: int) -> int:
    return -(-groups // GROUPS_PER_BUCKET)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash (xxhash64 of the text's bytes), n_bytes, kept (binary) and removed (array of start, end in bytes) for each row of ``docs``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    keys, buckets = key_buckets(groups), string_buckets(groups)
    grouped = rows.where("doc_id IS NOT NULL").select(F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(groups)).alias("g"), "doc_id", "text", "text_hash")
    by_group = grouped.groupBy("g")
    told = by_group.applyInArrow(_whole(_announce(keys)), _SENT).groupBy("bucket").applyInArrow(_whole(_repeated), _SENT)
    sent = by_group.cogroup(told.groupBy("g")).applyInArrow(_whole(_submit(keys, buckets)), _SENT)
    answers = sent.groupBy("bucket").applyInArrow(_whole(_answer), _SENT)
    both = told.withColumn("kind", F.lit(0)).unionByName(answers.withColumn("kind", F.lit(1)))
    result = by_group.cogroup(both.groupBy("g")).applyInArrow(_whole(_remove(keys, buckets)), "doc_id long, text_hash long, n_bytes long, kept binary, removed array<struct<start:long,end:long>>")
    alone = rows.where("doc_id IS NULL").select("doc_id", "text_hash", F.octet_length("text").cast("long").alias("n_bytes"), F.col("text").alias("kept"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("removed"))
    return result.unionByName(alone)


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
