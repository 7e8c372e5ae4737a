"""A training corpus in five stages over `documents`. Each stage works on all that the one before it kept.

All stages take nulls in any column, empty and very long texts (always whole), ties and repeated rows, empty tables (no rows
come out), and further columns of any name, which all but the last stage pass on. What each does with them is said there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import minhash, mixing, perplexity, pieces, toxicity
from quillon.llm.shared import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity below 0.7, learnt from the labels outside the held-out third. Null, empty and wordless texts stay,
    as do rows of null ids that are harmless; repeated rows are judged alike; without labels of both kinds nothing goes."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic").where(~toxicity.held_out(3, 1))
    return toxicity.keep_harmless(docs, toxicity.fit(toxicity.labelled_sample(docs.select("doc_id", "text"), labels), weight_col="weight"))


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is not above their language's threshold; trusted: those labelled as of good quality. Null, empty
    and wordless texts have no perplexity and go; a null language has the threshold of all; rows of null ids are judged as one
    (all stay if one does), as are rows of one id; a perplexity at the threshold stays."""
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    return perplexity.keep_good(docs, trusted)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8 or more), the one of the smallest id. Texts
    without words are copies of none and stay, as do rows of null ids; rows of one id are one document, and stay or go together."""
    return minhash.keep_one(docs, 0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the sources' target weights: a row for each time that the mix takes a document. A null source is one of its own;
    texts without words have no size and are left out; rows of equal id and text are taken as often as the plan says in all."""
    return mixing.mixed_documents(docs, F.array("source"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the pieces of each row of the mix, and of what they decode to. Null and empty texts have the two outer ids."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", drop_poor),
    ("minhash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("pieces", encode),
]

#: Learnt models and piece codes are beyond SQL; a test holds run() against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{k + 1}")
    return docs
