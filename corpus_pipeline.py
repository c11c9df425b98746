"""A corpus pipeline of five stages: classify, drop copies, drop near copies, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor kept; all but the last return the columns
of documents. run() writes each stage's result to the shared folder and reads it again before the next, so a lost
executor costs a re-read, never an earlier stage.

Defined results: null and empty texts pass the classifier, and one of them (the row with the largest id) passes the exact
dedup; a null id passes the near dedup and draws by its text; null languages and sources count as ''; repeated rows leave
one; columns beyond those of documents are carried through. Without trusted labels every document passes the classifier.
Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import exact_dedup, kneser_ney, minhash_dedup, mixing, piece_dropout
from strandline.llm.queries import DROPOUT, DROPOUT_SEED, table, tokenizer_file
from strandline.llm.shared import cut


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose perplexity is within their language's threshold; the model is trained on labelled documents of this input."""
    return kneser_ney.keep_trusted_like(docs, kneser_ney.fit(docs, table(spark, sf_dir, "labels")))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact_dedup.exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return minhash_dedup.near_dedup(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by the probabilities that bring source, language and topic to their target weights."""
    return mixing.mix_sample(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, by seeded merge-dropout."""
    return piece_dropout.encode_pieces(docs, tokenizer_file("piece_bpe_32k.model"), DROPOUT, DROPOUT_SEED)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_copies),
    ("near_dedup", near_copies),
    ("mixing", source_mixing),
    ("piece_encoding", piece_encoding),
]

#: SQL can express neither the classifier nor near duplicates nor raking; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
