"""A training corpus in five stages: toxic documents go, one of each near-duplicate group stays, repeated passages go,
sources are mixed to weights, and what is left is packed into sequences.

Each stage is written as Parquet to the shared folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plugload.llm import mixing, packing, queries, simhash, substrings, toxicity
from plugload.session import materialized


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5, by a classifier learnt as in op1."""
    model = queries.toxicity_model(spark, sf_dir)
    scored = toxicity.score(docs.select(F.struct(*docs.columns).alias("row"), "text"), model, carry=["row"])
    return scored.where("score < 0.5").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts with similar five-word shingles, 0.8 or more, the document with the least doc_id.

    Texts of fewer than five words are one shingle and so are like equal ones only. Of texts without words one stays. Of repeated rows one stays. Rows without doc_id are not grouped and stay.
    """
    groups = simhash.similar_documents(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.where("doc_id is not null").join(groups, F.col("doc_id") == F.col("_id"), "left_semi")
    return kept.dropDuplicates(["doc_id"]).select(*docs.columns).union(docs.where("doc_id is null"))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that occur anywhere else; n_chars follows the text."""
    cleaned = substrings.remove_repeats(docs, with_text=True)
    text = F.when(F.col("removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    length = F.when(F.col("removed") > 0, F.length("kept")).otherwise(F.col("row.n_chars"))
    new = {"text": text, "n_chars": length.cast("bigint")}
    return cleaned.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per copy that the mix of op10 takes; a document taken in part has its first words only."""
    return mixing.repeated(mixing.mix(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all copies with their places in sequences of 2,048 tokens, as op7 gives them."""
    placed = packing.pack_documents(docs, queries.tokenizer_file())
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeats),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learning, SimHash and tokenizing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialized(stage(spark, docs, sf_dir))
    return docs
