"""BPE merges and decoding as recursive and ordered DuckDB queries in each worker.

``symbols`` holds one row for each word and token position. The recursive query
joins neighbouring rows with the merge table, keeps each word's leftmost pair
of least rank and contracts it, until no word has a pair left. Words of over
``LONG`` bytes go through a keyed recursion, which holds their last turn only
and contracts, in one turn, all places of a word's least rank that the
one-by-one order would contract next; where a contraction could make a pair of
a still lower rank, that word's leftmost place alone is contracted. So memory
grows with the symbols, not with symbols times turns. A word that is a token
as it stands is that token, by a join with the vocabulary. Decoding joins ids
with the vocabulary and aggregates the bytes in order of position.

DuckDB never spills (there is no folder that it could write to); a block that
outgrows ``MEMORY_MB`` (or ``BYTES_PER_SYMBOL`` for each byte of a single longer
word) is an error.
"""

from __future__ import annotations

import atexit
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from .bytebpe import read_ranks
from .common import HashIndex, SpanHasher, mix64

#: Symbols (bytes of words) that one recursive query takes at a time; bounds its memory.
BLOCK_SYMBOLS = 150_000
LONG = 128
MEMORY_MB, BYTES_PER_SYMBOL = 300, 2_000

_ENCODE = """
WITH RECURSIVE step(turn, word, pos, id) AS (
    SELECT 0, word, pos, id FROM symbols
    UNION ALL
    SELECT p.turn + 1, p.word, p.pos, CASE WHEN p.pos = c.place THEN c.made ELSE p.id END
    FROM (
        SELECT turn, word, pos, id, lag(pos) OVER (PARTITION BY word ORDER BY pos) AS before FROM step
    ) p JOIN (
        SELECT word, least & 4294967295 AS place, (least >> 32)::INTEGER AS made
        FROM (
            SELECT s.word, min((m.rank << 32) | s.pos) AS least
            FROM (SELECT word, pos, id, lead(id) OVER (PARTITION BY word ORDER BY pos) AS next_id FROM step) s
            JOIN merges m ON m.a = s.id AND m.b = s.next_id
            GROUP BY s.word
        )
    ) c ON c.word = p.word
    WHERE p.before IS DISTINCT FROM c.place
), ends AS (
    SELECT word, max(turn) AS turn FROM step GROUP BY word
)
SELECT s.word, s.id FROM step s JOIN ends e ON e.word = s.word AND e.turn = s.turn ORDER BY s.word, s.pos
"""

_ENCODE_LONG = """
WITH RECURSIVE step(word, pos, id) USING KEY (word, pos) AS (
    SELECT word, pos, id FROM symbols
    UNION
    (WITH live AS (
        SELECT word, pos, id, lead(id) OVER w AS next_id, lead(id, 2) OVER w AS third, lag(id) OVER w AS before
        FROM recurring.step WHERE id >= 0 WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), ranked AS (
        SELECT l.*, m.rank, min(m.rank) OVER (PARTITION BY l.word) AS best
        FROM live l LEFT JOIN merges m ON m.a = l.id AND m.b = l.next_id
    ), numbered AS (
        SELECT *, coalesce(rank = best, false) AS hit, row_number() OVER (PARTITION BY word ORDER BY pos) AS k FROM ranked WHERE best IS NOT NULL
    ), runs AS (
        SELECT *, k - max(CASE WHEN hit THEN 0 ELSE k END) OVER (PARTITION BY word ORDER BY pos) AS nth FROM numbered
    ), careful AS (
        SELECT DISTINCT word FROM runs r WHERE hit AND nth % 2 = 1 AND (
            EXISTS (FROM early e WHERE e.a = r.best AND e.b = r.third AND e.rank < r.best)
            OR EXISTS (FROM early e WHERE e.a = r.before AND e.b = r.best AND e.rank < r.best)
            OR EXISTS (FROM early e WHERE e.a = r.best AND e.b = r.best AND e.rank < r.best))
    ), chosen AS (
        SELECT r.*, hit AND nth % 2 = 1 AND (c.word IS NULL OR k = min(CASE WHEN hit THEN k END) OVER (PARTITION BY r.word)) AS takes
        FROM runs r LEFT JOIN careful c ON c.word = r.word
    )
    SELECT word, pos, (CASE WHEN takes THEN best WHEN lag(takes, 1, false) OVER (PARTITION BY word ORDER BY pos) THEN -1 ELSE id END)::INTEGER FROM chosen)
)
SELECT word, id FROM step WHERE id >= 0 ORDER BY word, pos
"""

_WHOLE = "SELECT w.word, v.id FROM words w JOIN vocab v ON v.bytes = w.bytes"

_DECODE = """
SELECT t.segment, string_agg(v.bytes, '' ORDER BY t.pos) AS bytes
FROM tokens t JOIN vocab v ON v.id = t.id GROUP BY t.segment
"""


@lru_cache(maxsize=2)
def _connection(path: str):
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY_MB}MB", "temp_directory": "", "preserve_insertion_order": False})
    atexit.register(con.close)
    ranks = read_ranks(path)
    a, b, rank = [], [], []
    for token, r in ranks.items():
        for i in range(1, len(token)):
            x, y = ranks.get(token[:i]), ranks.get(token[i:])
            if x is not None and y is not None:
                a.append(x)
                b.append(y)
                rank.append(r)
    # Bytes travel as characters of equal number: string_agg joins text.
    merges = pa.table({"a": pa.array(a, pa.int32()), "b": pa.array(b, pa.int32()), "rank": pa.array(rank, pa.int64())})
    vocab = pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array([t.decode("latin-1") for t in ranks])})
    for name, table in (("merges", merges), ("vocab", vocab)):
        con.register("given", table)
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        con.unregister("given")
    con.execute("CREATE TABLE early AS SELECT * FROM merges WHERE rank < greatest(a, b)")
    return con


def _merge_block(con, single: np.ndarray, parts: list[bytes], query: str) -> list[np.ndarray]:
    raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    word = np.repeat(np.arange(len(parts)), sizes)
    pos = np.arange(len(raw)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    room = max(MEMORY_MB, len(raw) * BYTES_PER_SYMBOL // 1_000_000)
    con.register("symbols", pa.table({"word": word.astype(np.int32), "pos": pos, "id": single[raw]}))
    con.register("words", pa.table({"word": np.arange(len(parts), dtype=np.int32), "bytes": [p.decode("latin-1") for p in parts]}))
    try:
        con.execute(f"SET memory_limit = '{room}MB'")
        out = con.execute(query).fetchnumpy()
        whole = con.execute(_WHOLE).fetchall()
    finally:
        con.unregister("symbols")
        con.unregister("words")
    ids = np.split(np.asarray(out["id"]), np.searchsorted(np.asarray(out["word"]), np.arange(1, len(parts))))
    for i, token in whole:
        ids[i] = np.array([token], dtype=np.int32)
    return ids


def duckdb_merges(path: str) -> Callable[[list[str]], list]:
    """Words encoded by recursive queries over the merge table of a rank file, in blocks of at most ``BLOCK_SYMBOLS`` bytes or one longer word."""
    ranks, con = read_ranks(path), _connection(path)
    single = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)

    def merge(words: list[str]) -> list:
        raw = [w.encode("utf-8", "replace") for w in words]
        out: list = [()] * len(raw)
        for query, todo in ((_ENCODE, [i for i, w in enumerate(raw) if len(w) <= LONG]), (_ENCODE_LONG, [i for i, w in enumerate(raw) if len(w) > LONG])):
            a = 0
            while a < len(todo):
                b, size = a, 0
                while b < len(todo) and (b == a or size + len(raw[todo[b]]) <= BLOCK_SYMBOLS):
                    size += len(raw[todo[b]])
                    b += 1
                for i, ids in zip(todo[a:b], _merge_block(con, single, [raw[i] for i in todo[a:b]], query), strict=True):
                    out[i] = ids.tolist()
                a = b
        return out

    return merge


class SegmentDecoder:
    """Bytes of id sequences. Sequences are cut before tokens that begin with a
    blank, and each distinct segment is decoded once by an ordered aggregation."""

    def __init__(self, path: str, max_segments: int = 200_000) -> None:
        ranks = read_ranks(path)
        self.con, self.max_segments = _connection(path), max_segments
        top = max(ranks.values()) + 1
        self.opens = np.zeros(top, dtype=bool)
        self.opens[[i for t, i in ranks.items() if t[:1].isspace()]] = True
        self.table = mix64(np.arange(1, top + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.hasher = SpanHasher()
        self._reset()

    def _reset(self) -> None:
        self.index, self.parts = HashIndex(17), []

    def _learn(self, keys: np.ndarray, ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> None:
        before = np.cumsum(sizes) - sizes
        pos = np.arange(int(sizes.sum())) - np.repeat(before, sizes)
        segment = np.repeat(np.arange(len(keys)), sizes)
        tokens = pa.table({"segment": segment.astype(np.int32), "pos": pos, "id": ids[np.repeat(starts, sizes) + pos].astype(np.int32)})
        self.con.register("tokens", tokens)
        try:
            rows = dict(self.con.execute(_DECODE).fetchall())
        finally:
            self.con.unregister("tokens")
        self.index.add(keys)
        self.parts += [rows[i].encode("latin-1") for i in range(len(keys))]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Bytes of ids[bounds[i]:bounds[i + 1]] for each i."""
        start = np.zeros(len(ids) + 1, dtype=bool)
        start[: len(ids)] = self.opens[ids]
        start[bounds] = True
        start[len(ids)] = False
        starts = np.flatnonzero(start)
        stops = np.append(starts[1:], len(ids)) if len(starts) else starts
        if self.index.size > self.max_segments:
            self._reset()
        keys = self.hasher(ids, starts, stops, self.table)
        numbers = self.index.get(keys)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            self._learn(fresh, ids, starts[new[at]], (stops - starts)[new[at]])
            numbers[new] = self.index.get(keys[new])
        parts = [self.parts[i] for i in numbers.tolist()]
        at = np.searchsorted(starts, bounds).tolist()
        return [b"".join(parts[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
