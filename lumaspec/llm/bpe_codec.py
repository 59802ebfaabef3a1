"""Operator 6: byte-level BPE encoding and decoding of whole documents.

Words of a partition's texts are merged by DuckDB's recursive queries
(``duckdb_bpe``); ids are decoded by ordered aggregation. Both keep a bounded
cache of distinct words or segments in each worker.

Edge cases: a null text counts as empty and gives no ids; a null id column is
passed on; repeated rows give repeated results; an empty table gives an empty
table; other columns of the input are not touched or read. Strings of special
tokens are ordinary text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import coder
from .common import lean, read

_DECODERS: dict[str, object] = {}


def _decoder(path: str):
    if path not in _DECODERS:
        from .duckdb_bpe import SegmentDecoder

        _DECODERS[path] = SegmentDecoder(path)
    return _DECODERS[path]


Batches = Iterator[pa.RecordBatch]


def _encoded(batches: Batches, path: str, engine: str) -> Batches:
    c = coder(engine, path)
    for batch in batches:
        for a, ids, bounds in c.batches(batch.column(1)):
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(bounds) - 1), lists], names=[batch.schema.names[0], "ids"])


def _decoded(batches: Batches, path: str) -> Batches:
    d = _decoder(path)
    for batch in batches:
        lists = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
        bounds = np.asarray(lists.offsets).astype(np.int64)
        step = 0
        while step < len(lists):
            stop = max(step + 1, int(np.searchsorted(bounds, bounds[step] + 1_000_000, "right")) - 1)
            ids = np.asarray(lists.values)[bounds[step] : bounds[stop]]
            data = d.decode(ids, bounds[step : stop + 1] - bounds[step])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(step, stop - step), lists.slice(step, stop - step), pa.array(data, pa.binary())], names=[batch.schema.names[0], "ids", "bytes"])
            step = stop


def _digested(batches: Batches) -> Batches:
    for batch in batches:
        lists = batch.column(1)
        bounds = np.asarray(lists.offsets).tolist()
        raw = np.asarray(lists.values).astype("<u4").tobytes()
        ids = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        text = [hashlib.sha256(x).hexdigest() for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(ids), pa.array(text)], names=[batch.schema.names[0], "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", engine: str = "duckdb") -> DataFrame:
    """``id_col`` and ``ids`` (array of int): the whole text's token ids."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(lambda b: _encoded(b, ranks_path, engine)), f"`{id_col}` {kind}, ids array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col``, ``ids`` and ``bytes`` (binary): the bytes that the ids stand for; a null list counts as empty."""
    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(F.col(id_col), F.col(ids_col)).mapInArrow(lean(lambda b: _decoded(b, ranks_path)), f"`{id_col}` {kind}, ids array<int>, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and SHA-256 digests of ids (little-endian unsigned 32-bit) and of decoded bytes; the
    encoder and the decoder run in one worker, batch by batch, so ids never leave it."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(lean(lambda b: _digested(_decoded(_encoded(b, ranks_path, "duckdb"), ranks_path))), schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(read(spark, sf_dir, "documents"), path)
