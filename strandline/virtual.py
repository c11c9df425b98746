"""Reads made from the star-schema tables, where there are no FASTQ files: each step is the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEX, BASES_N, BASES = "0123456789abcdef", "ACGTACGTACGTACGN", "ACGTACGTACGTACGT"


def sequence(key: Column, with_n: bool = True) -> Column:
    """32 bases of a key's digest."""
    return F.translate(F.md5(key.cast("string")), HEX, BASES_N if with_n else BASES)


def quality(key: Column) -> Column:
    """32 quality characters of a key's digest."""
    return F.translate(F.md5(F.concat(F.lit("q"), key.cast("string"))), HEX, "!#%')+-/13579;?I")


def header(key: Column) -> Column:
    """An instrument's header with run, flowcell and lane, or one that lacks them for every seventh key."""
    good = F.format_string("INST%d:%d:FC%d:%d:1101:%d:1000 1:N:0", key % 3, key % 50, key % 5, key % 8 + 1, key)
    return F.when(key % 7 == 0, F.format_string("read-%d/1", key)).otherwise(good)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, header, barcode, seq, qual of each event: 16 bases of its user, then 10 and more of its own."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), "user_id")
    own = sequence(F.col("id"))
    return events.select("id", header(F.col("id")).alias("header"), F.concat(F.substr(sequence(F.col("user_id")), F.lit(1), F.lit(16)), own).alias("seq"), F.concat(quality(F.col("id")), quality(F.col("user_id"))).alias("qual"))
