"""Shared helpers: table access, hashing, cutting lineage in the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the data folder, by Spark's reader alone (any store Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame, forget: bool = False) -> DataFrame:
    """``df`` materialised with its lineage cut, in the shared checkpoint folder.

    The folder is the one ``spark.checkpoint.dir`` names. Only where that is
    unset and the master is local (tests, single machine) a temporary one is
    set; on a cluster it is an error, as executors could not share it.
    ``forget`` also drops what the optimizer knows of the rows: in long loops
    the constraints that a checkpoint inherits would double with each round.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        at = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not at and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(at or os.path.join(tempfile.gettempdir(), "lumaspec-checkpoints"))
    out = df.checkpoint(eager=True)
    if forget:
        out = DataFrame(spark._jsparkSession.internalCreateDataFrame(out._jdf.queryExecution().toRdd(), out._jdf.schema(), False), spark)
    return out


def tidy() -> None:
    """Lets Spark drop shuffle files and checkpoints that nothing refers to any more (it does so when the driver's garbage is collected)."""
    gc.collect()
    sc = SparkContext._active_spark_context
    if sc is not None:
        sc._jvm.System.gc()


def release() -> None:
    """Gives a worker's freed memory back to the system: workers live on and serve other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable) -> Callable:
    """``run``, a function of batches, with its memory given back at the end."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def text_runs(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of rows of a column of strings or bytes that hold at most ``most`` bytes together, or one longer row."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    a = 0
    while a < len(lengths):
        b, size = a, 0
        while b < len(lengths) and (b == a or size + lengths[b] <= most):
            size += lengths[b]
            b += 1
        yield a, b
        a = b


def parallelism(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = np.asarray(x, dtype=U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


class SpanHasher:
    """64-bit hashes of many spans of one long array of small integers.

    A span's hash depends on its values alone, not on its place: prefix sums
    of value * BASE**position, brought back to position 0 by the inverse of
    BASE modulo 2**64. All hashers of a process share tables of powers, which
    grow with the arrays up to ``KEPT`` positions; longer ones get tables for the
    call alone.
    """

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)
    KEPT = 1 << 22
    _tables: tuple[np.ndarray, np.ndarray] | None = None

    def __call__(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray) -> np.ndarray:
        """``table`` maps a value to a random 64-bit number."""
        n = len(codes)
        if n >= self.KEPT:
            up, down = powers(n + 1, self.BASE), powers(n + 1, self.INVERSE)
        else:
            if SpanHasher._tables is None or len(SpanHasher._tables[0]) <= n:
                size = max(1 << 16, 1 << n.bit_length())
                SpanHasher._tables = powers(size, self.BASE), powers(size, self.INVERSE)
            up, down = SpanHasher._tables
        sums = np.zeros(n + 1, dtype=U64)
        with np.errstate(over="ignore"):
            np.cumsum(table[codes] * up[:n], out=sums[1:], dtype=U64)
            raw = (sums[ends] - sums[starts]) * down[starts]
        return mix64(raw + (np.asarray(ends - starts, dtype=U64) << U64(32)))


class HashIndex:
    """Open-addressing map from uint64 keys to dense numbers 0, 1, 2, ... in NumPy."""

    def __init__(self, bits: int = 16) -> None:
        self._alloc(bits)
        self.size = 0

    def _alloc(self, bits: int) -> None:
        self.bits = bits
        self.keys = np.zeros(1 << bits, dtype=U64)
        self.values = np.full(1 << bits, -1, dtype=np.int32)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 where unknown."""
        mask = (1 << self.bits) - 1
        slot = (keys >> U64(64 - self.bits)).astype(np.int64)
        out = self.values[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(open_):
            slot_o = (slot[open_] + 1) & mask
            slot[open_] = slot_o
            v = self.values[slot_o]
            out[open_] = v
            open_ = open_[(v >= 0) & (self.keys[slot_o] != keys[open_])]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Numbers for keys that are distinct and not yet known."""
        while (self.size + len(keys)) * 2 > len(self.keys):
            old = self.values >= 0
            k, v = self.keys[old], self.values[old]
            self._alloc(self.bits + 2)
            self._place(k, v)
        ids = np.arange(self.size, self.size + len(keys), dtype=np.int32)
        self._place(keys, ids)
        self.size += len(keys)
        return ids

    def _place(self, keys: np.ndarray, ids: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (keys >> U64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.values[slot[todo]] < 0
            at, first = np.unique(slot[todo][free], return_index=True)
            took = todo[free][first]
            self.keys[at], self.values[at] = keys[took], ids[took]
            left = np.ones(len(keys), dtype=bool)
            left[took] = False
            todo = todo[left[todo]]
            again = self.values[slot[todo]] >= 0
            slot[todo[again]] = (slot[todo[again]] + 1) & mask
