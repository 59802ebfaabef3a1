"""Operator 3: token counts of sections by offset-mapped attribution.

A document is encoded once, as a whole. Tokens become spans of the text, and a
sorted merge of token spans with section spans gives each token to one section.
Tokens that cross a section's end go by an explicit rule:

* ``first``: to the section of the token's first character,
* ``last``: to the section of its last character,
* ``largest``: to the section that holds most of its bytes, the first of equals.

Sections are the lines of a text, the line feed being the last character of
its line. Edge cases: a null or empty text has one empty section; a text that
ends in a line feed has no empty section after it; tokens of a part of a
character count where that character stands; repeated rows are counted each on
their own; an empty table gives an empty table. Strings of special tokens are
ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import coder, token_bytes
from .common import lean, read

RULES = ("first", "last", "largest")


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> np.ndarray:
    """Number of the section of each token span; ``sections``: sorted starts."""
    a = np.searchsorted(sections, starts, "right") - 1
    if rule == "first":
        return a
    b = np.searchsorted(sections, ends - 1, "right") - 1
    if rule == "last":
        return b
    out = a.copy()
    for i in np.flatnonzero(a != b):
        edges = np.concatenate([[starts[i]], sections[a[i] + 1 : b[i] + 1], [ends[i]]])
        out[i] = a[i] + int(np.argmax(np.diff(edges)))
    return out


def section_token_counts(docs: DataFrame, ranks_path: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document and section: ``section`` from 0, ``start`` and ``n_chars`` in characters, ``n_tokens``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sizes = coder("ranks", ranks_path), token_bytes(ranks_path)[2]
        for batch in batches:
            for first, ids, bounds in c.batches(batch.column(1)):
                raw = [t or b"" for t in batch.column(1).slice(first, len(bounds) - 1).cast(pa.binary()).to_pylist()]
                data = np.frombuffer(b"".join(raw), dtype=np.uint8)
                length = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
                doc_from = np.cumsum(length) - length
                is_start = np.zeros(len(data) + 1, dtype=bool)
                is_start[np.flatnonzero(data == 10) + 1] = True
                is_start[doc_from] = True
                is_start[len(data)] = False
                filled = np.flatnonzero(is_start)  # sections with text
                ends = np.cumsum(sizes[ids])
                starts = ends - sizes[ids]
                tokens = np.bincount(attribute(starts, ends, filled, rule), minlength=len(filled)) if len(filled) else np.zeros(0, dtype=np.int64)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                stops = np.append(filled[1:], len(data)) if len(filled) else filled
                doc = np.searchsorted(doc_from, filled, "right") - 1
                empty = np.flatnonzero(length == 0)
                doc = np.concatenate([doc, empty])
                n_tokens = np.concatenate([tokens, np.zeros(len(empty), dtype=np.int64)])
                start = np.concatenate([chars[filled] - chars[doc_from[doc[: len(filled)]]], np.zeros(len(empty), dtype=np.int64)])
                n_chars = np.concatenate([chars[stops] - chars[filled], np.zeros(len(empty), dtype=np.int64)])
                number = np.arange(len(filled)) - np.searchsorted(doc[: len(filled)], doc[: len(filled)])
                number = np.concatenate([number, np.zeros(len(empty), dtype=np.int64)])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc + first)), pa.array(number.astype(np.int32)), pa.array(start.astype(np.int64)), pa.array(n_chars.astype(np.int64)), pa.array(n_tokens.astype(np.int64))], names=[id_col, "section", "start", "n_chars", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(run), f"`{id_col}` {kind}, section int, start long, n_chars long, n_tokens long")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return section_token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
