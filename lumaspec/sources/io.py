"""Sources and sinks: acquisition folders, tables, annotations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANNOTATION = "struct<x:double,y:double,text:string>"


def parse_parameters(text: str) -> dict[str, str]:
    """Name and value of each ``##$NAME= value`` record of a JCAMP-DX parameter file; wrapped values are joined."""
    out: dict[str, str] = {}
    name = None
    for line in (text or "").splitlines():
        m = re.match(r"##\$?([^=]+)=\s*(.*)", line)
        if m:
            name = m[1].strip()
            out[name] = m[2].strip()
        elif name and not line.startswith("$$"):
            out[name] = f"{out[name]} {line.strip()}".strip()
    return out


def decode_fid(raw: bytes, parameters: dict[str, str]) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary parts of interleaved points: DTYPA 0 is 32-bit integers, 2 is doubles; BYTORDA 1 is big-endian."""
    order = ">" if parameters.get("BYTORDA", "0") == "1" else "<"
    kind = "f8" if parameters.get("DTYPA", "0") == "2" else "i4"
    size = int(kind[1])
    points = np.frombuffer(raw[: len(raw) // (2 * size) * 2 * size], dtype=order + kind).astype(float)
    return points[::2], points[1::2]


def read_fids(spark: SparkSession, path: str) -> DataFrame:
    """sample_id (folder of the acquisition), re, im, parameters of every ``fid`` file under ``path``; an error if there is none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    folder = F.regexp_replace("path", r"/[^/]+$", "")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    found = files.where(name.isin("fid", "acqus")).groupBy(folder.alias("folder")).agg(F.max(F.when(name == "fid", F.col("content"))).alias("fid"), F.max(F.when(name == "acqus", F.col("content"))).alias("acqus")).where("fid IS NOT NULL")
    if found.select("folder").isEmpty():
        raise FileNotFoundError(f"no fid file under {path}")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for folder_, fid, acqus in b.itertuples(index=False):
                p = parse_parameters(bytes(acqus).decode("latin-1") if acqus is not None else "")
                re_, im = decode_fid(bytes(fid), p)
                rows.append((folder_.rsplit("/", 1)[-1], re_, im, p))
            yield pd.DataFrame(rows, columns=["sample_id", "re", "im", "parameters"])

    return found.select("folder", "fid", "acqus").mapInPandas(decode, "sample_id string, re array<double>, im array<double>, parameters map<string,string>")


def bin_headers(columns: list[str]) -> dict[str, float]:
    """Centre of each column named ``low_high``; other columns are left out."""
    out = {}
    for c in columns:
        m = re.fullmatch(r"(-?[\d.]+)_(-?[\d.]+)", c)
        if m:
            out[c] = (float(m[1]) + float(m[2])) / 2
    return out


def read_buckets(spark: SparkSession, path: str, sample: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(long form, axis) of a table with one column for each bucket."""
    wide = spark.read.option("header", True).option("sep", sep).csv(path)
    centres = bin_headers(wide.columns)
    names = sorted(centres, key=lambda c: centres[c])
    values = F.array(*[F.expr(f"try_cast(`{c}` AS double)") for c in names])
    long = wide.select(F.col(sample).alias("sample_id"), F.posexplode(values).alias("j", "value")).withColumn("j", F.col("j").cast("long"))
    axis = spark.createDataFrame([(j, centres[c], c) for j, c in enumerate(names)], "j long, coord double, name string")
    return long, axis


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """Comma-separated files with a header, one folder for each value of ``by``; text is guarded against formulas."""
    from ..functions.scalars import csv_text

    safe = df.select(*[csv_text(F.col(f.name)).alias(f.name) if f.dataType.simpleString() == "string" and f.name != by else F.col(f.name) for f in df.schema])
    writer = safe.write.mode("overwrite").option("header", True)
    (writer.partitionBy(by) if by else writer).csv(path)


def annotations_to_json(df: DataFrame) -> DataFrame:
    """One JSON text of all of a sample's annotations (x, y, text)."""
    from ..functions.scalars import html_text

    item = F.struct("x", "y", html_text(F.col("text")).alias("text"))
    return df.groupBy("sample_id").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("json"))


def annotations_from_json(df: DataFrame) -> DataFrame:
    """sample_id, x, y, text; entries without a position or a text are left out."""
    from ..functions.scalars import html_text

    rows = df.select("sample_id", F.explode(F.from_json("json", f"array<{ANNOTATION}>")).alias("a")).select("sample_id", "a.*")
    return rows.where("x IS NOT NULL AND y IS NOT NULL AND text IS NOT NULL").withColumn("text", html_text(F.col("text")))


def annotated_intensities(long: DataFrame, axis: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row for each sample with its value at the feature nearest to each annotation (x, text), columns named ``text_coord``."""
    from ..plans.matrix import nearest_feature

    at = nearest_feature(axis, annotations.select(F.col("x").alias("target")).distinct()).join(annotations.withColumnRenamed("x", "target"), "target")
    named = at.select("j", F.concat_ws("_", "text", F.format_number("coord", 3)).alias("label"))
    return long.join(named, "j").groupBy("sample_id").pivot("label").agg(F.first("value"))


def output_path(root: str, table: str, a: str | None = None, b: str | None = None) -> str:
    """Where a table, or a pair's part of it, is written."""
    return f"{root}/{table}" if a is None else f"{root}/{table}/pair={a}_vs_{b}".replace("//", "/")
