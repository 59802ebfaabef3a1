"""Corpus pipeline: toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``, whatever their names. Rows with null
ids or texts pass through every filter by the operators' own rules; an empty
table passes as an empty table; very long texts are never cut before packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaspec.llm.common import cut, read
from lumaspec.llm.near_dedup import near_duplicates
from lumaspec.llm.packing import pack_pieces, token_pieces
from lumaspec.llm.suffix_dedup import remove_repeats
from lumaspec.llm.toxicity import score_documents, train


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain scores under 0.5; every row is scored by its own text, repeated ones alike."""
    model = train(docs, read(spark, sf_dir, "labels"))
    return score_documents(docs, model, keep=True).where("score < 0.5").select("row.*")


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows that have an id as one struct each, beside their id and the hash of their text's bytes, so that no column of ``docs`` clashes."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.where("doc_id IS NOT NULL").select(row.alias("row"), F.col("doc_id").alias("key_id"), F.xxhash64(F.coalesce(F.col("text").cast("binary"), F.lit(b""))).alias("key_hash"))


def _columns(docs: DataFrame, **new) -> list:
    """The columns of ``docs`` out of the struct, some of them replaced."""
    return [new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, once: of the least id, then of the least hash of its text. Rows without an id are kept; so is one empty text of each id (null counts as empty)."""
    found = near_duplicates(docs.withColumn("text", F.coalesce("text", F.lit("")))).where("doc_id IS NOT NULL")
    linked = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("head")).select("head.doc_id", "head.text_hash")
    heads = linked.unionByName(found.where("component IS NULL").select("doc_id", "text_hash"))  # empty and blank texts are linked with nothing
    heads = cut(heads.select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash")).distinct())
    kept = _keyed(docs).join(heads, ["key_id", "key_hash"], "left_semi").dropDuplicates(["key_id", "key_hash"])
    return kept.select(*_columns(docs)).unionByName(docs.where("doc_id IS NULL"))


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats from documents of smaller id; bytes of characters that a cut split are dropped with it. Every row stays, repeated ones too; rows without an id stay as they are."""
    kept = remove_repeats(docs).where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "text_hash"])
    text = F.coalesce(F.try_validate_utf8(F.col("kept").cast("string")), F.translate(F.make_valid_utf8(F.col("kept").cast("string")), "\ufffd", ""))
    kept = kept.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash"), text.alias("kept_text"))
    joined = _keyed(docs).join(kept, (F.col("key_id").cast("long") == F.col("kept_id")) & (F.col("key_hash") == F.col("kept_hash")))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)}
    return joined.select(*_columns(docs, **new)).unionByName(docs.where("doc_id IS NULL"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their places in sequences; repeated rows and empty texts are packed each on their own."""
    import public_tokenizers

    return pack_pieces(cut(token_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), added=True)))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_near),
    ("suffix_dedup", remove_repeated_passages),
    ("packing", pack),
]

#: SQL can express neither the trained scores nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
