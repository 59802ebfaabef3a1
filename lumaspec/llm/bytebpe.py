"""Byte-level BPE over whole batches of texts.

Texts are cut into words by the pattern of the vocabulary with array
operations on code points, equal words are recognised by a 64-bit hash, and
only words that a worker has not met yet reach the merge routine. The routine
is a parameter: the installed libraries' (``library_merges``) or recursive
DuckDB queries (``duckdb_bpe``).
"""

from __future__ import annotations

import base64
import os
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex

from .common import HashIndex, SpanHasher, mix64, text_runs

LETTER, NUMBER, SPACE, OTHER, BLANK = 0, 1, 2, 3, 4


@lru_cache(maxsize=1)
def char_classes() -> tuple[np.ndarray, np.ndarray]:
    """Class and random 64-bit number of every code point."""
    text = "".join(map(chr, (c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)))
    kinds = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, text):
            kinds[[ord(c) for c in m[0]]] = kind
    kinds[0x20] = BLANK
    return kinds, mix64(np.arange(1, sys.maxunicode + 2, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def split_words(codes: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Starts of the words (matches of the pattern) of concatenated texts.

    ``codes``: code points of all texts; ``doc_starts``: where each nonempty
    text starts. The contraction suffixes, the blank that joins the run after
    it and white space that leaves its last character to the next match are
    those of the public pattern.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = char_classes()[0][codes]
    is_space = (kind == SPACE) | (kind == BLANK)
    group = np.where(is_space, np.uint8(SPACE), kind)
    first = np.zeros(n + 1, dtype=bool)  # of a document
    first[doc_starts] = True
    first[n] = True
    start = np.zeros(n + 1, dtype=bool)
    start[0] = start[n] = True
    start[1:n] = group[1:] != group[:-1]
    start |= first
    runs = np.flatnonzero(start)
    run_from, run_to = runs[:-1], runs[1:]
    # White space before something else of its document gives up its last character.
    spaces = is_space[run_from] & ~first[run_to]
    last = run_to[spaces] - 1
    start[last] = True
    joined = codes[last] == 0x20
    start[last[joined] + 1] = False
    # Contractions: a lone apostrophe that no blank joins.
    lone = (run_to - run_from == 1) & (codes[run_from] == 0x27) & ~first[run_to]
    at = run_from[lone]
    at = at[start[at]]
    if len(at):
        padded = np.concatenate([codes, np.zeros(3, dtype=codes.dtype)])
        c1, c2 = padded[at + 1], padded[at + 2]
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = np.zeros(len(at), dtype=bool)
        for a, b in ("re", "ve", "ll"):
            two |= (c1 == ord(a)) & (c2 == ord(b))
        two &= ~one & ~first[np.minimum(at + 2, n)]
        for hit, size in ((at[one], 2), (at[two], 3)):
            start[hit + 1] = False
            if size == 3:
                start[hit + 2] = False
            start[hit + size] = True
    return np.flatnonzero(start[:n])


def code_points(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class WordCoder:
    """Ids of texts, word by word; words are merged once for each worker.

    ``merge_words(list of words) -> list of id sequences`` encodes new words.
    The cache is emptied when it holds ``max_words`` words, so memory stays
    bounded whatever the vocabulary of the corpus. ``added`` (content to id)
    are tokens matched in the text before it is cut into words.
    """

    def __init__(self, merge_words: Callable[[list[str]], list], max_words: int = 800_000, added: dict[str, int] | None = None) -> None:
        self.merge_words, self.max_words = merge_words, max_words
        self.added = added or {}
        # Leftmost, then longest, as the library matches them.
        self.added_pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.hasher = SpanHasher()
        self._reset()

    def _reset(self) -> None:
        self.index = HashIndex(17)
        self.counts = np.zeros(1 << 16, dtype=np.int32)
        self.offsets = np.zeros(1 << 16, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.used = 0

    @staticmethod
    def _grown(a: np.ndarray, n: int) -> np.ndarray:
        if n <= len(a):
            return a
        out = np.zeros(max(n, 2 * len(a)), dtype=a.dtype)
        out[: len(a)] = a
        return out

    def _learn(self, keys: np.ndarray, words: list[str]) -> np.ndarray:
        rows = self.merge_words(words)
        numbers = self.index.add(keys)
        sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
        flat = np.fromiter(chain.from_iterable(rows), dtype=np.uint32, count=int(sizes.sum()))
        self.counts, self.offsets = self._grown(self.counts, self.index.size), self._grown(self.offsets, self.index.size)
        self.ids = self._grown(self.ids, self.used + len(flat))
        self.counts[numbers] = sizes
        self.offsets[numbers] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        return numbers

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids start (one more entry: the end)."""
        if not any(a in t for t in texts for a in self.added):
            return self._encode_plain(texts)
        split = [self.added_pattern.split(t) for t in texts]  # text and added token in turn
        ids, bounds = self._encode_plain([p for s in split for p in s[::2]])
        first = np.cumsum([0, *((len(s) + 1) // 2 for s in split)])  # part of each text
        before_token = np.ones(len(bounds) - 1, dtype=bool)
        before_token[first[1:] - 1] = False
        tokens = np.array([self.added[p] for s in split for p in s[1::2]], dtype=ids.dtype)
        return np.insert(ids, bounds[1:][before_token], tokens), bounds[first] + first - np.arange(len(first))

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        ends = np.cumsum(sizes)
        codes = code_points(texts)
        starts = split_words(codes, (ends - sizes)[sizes > 0])
        stops = np.append(starts[1:], len(codes)) if len(starts) else starts
        if self.index.size > self.max_words:
            self._reset()
        keys = self.hasher(codes, starts, stops, char_classes()[1])
        numbers = self.index.get(keys)
        new = np.flatnonzero(numbers < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            where = new[at]
            text = "".join(texts)
            self._learn(fresh, [text[a:b] for a, b in zip(starts[where].tolist(), stops[where].tolist(), strict=True)])
            numbers[new] = self.index.get(keys[new])
        counts = self.counts[numbers].astype(np.int64)
        before = np.cumsum(counts) - counts
        total = int(counts.sum())
        ids = self.ids[np.repeat(self.offsets[numbers] - before, counts) + np.arange(total)]
        word_of_doc = np.searchsorted(starts, np.concatenate([[0], ends]))
        bounds = np.append(before, total)[word_of_doc]
        return ids, bounds

    def batches(self, texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of the first text, ids, bounds) for runs of texts of at most ``most`` bytes (one text is never cut); a null text counts as empty."""
        for a, b in text_runs(texts, most):
            yield (a, *self.encode([t or "" for t in texts.slice(a, b - a).to_pylist()]))


@lru_cache(maxsize=4)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all tokens end to end, each token's offset and length, by id."""
    by_id = sorted((v, k) for k, v in read_ranks(path).items())
    top = by_id[-1][0] + 1
    sizes = np.zeros(top, dtype=np.int64)
    for v, k in by_id:
        sizes[v] = len(k)
    return np.frombuffer(b"".join(k for _, k in by_id), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes


def rank_merges(path: str) -> Callable[[list[str]], list]:
    """Words encoded by the tiktoken library from a rank file."""
    import tiktoken

    core = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=read_ranks(path), special_tokens={})._core_bpe
    return lambda words: [core.encode_single_piece(w.encode("utf-8", "replace")) for w in words]


@lru_cache(maxsize=1)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def json_merges(path: str) -> Callable[[list[str]], list]:
    """Words encoded by the tokenizers library from its own file."""
    tok = _library(path)
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already share the processors
    # A few words at a time: the library's encodings hold far more than ids.
    return lambda words: [e.ids for a in range(0, len(words), 2_000) for e in tok.encode_batch_fast(words[a : a + 2_000], add_special_tokens=False)]


def json_added(path: str) -> dict[str, int]:
    """Content and id of the added tokens of a file of the tokenizers library."""
    tokens = _library(path).get_added_tokens_decoder()
    if any(t.lstrip or t.rstrip or t.single_word or t.normalized for t in tokens.values()):
        raise ValueError("added tokens that strip, match single words or normalised text are not supported")
    return {t.content: i for i, t in tokens.items()}


_CODERS: dict[tuple, WordCoder] = {}


def coder(kind: str, path: str, added: bool = False) -> WordCoder:
    """The worker's own coder, kept between tasks (a cache only: losing it loses no result).

    ``added``: the added tokens of a json file are matched, as by the library; otherwise their strings are ordinary text.
    """
    if (kind, path, added) not in _CODERS:
        if kind == "duckdb":
            from .duckdb_bpe import duckdb_merges as make
        else:
            make = {"ranks": rank_merges, "json": json_merges}[kind]
        _CODERS[kind, path, added] = WordCoder(make(path), added=json_added(path) if added and kind == "json" else None)
    return _CODERS[kind, path, added]
