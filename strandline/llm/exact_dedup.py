"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only.

Each level leaves only the rows whose key more than one row has. What a level knows travels to the next scan as a
bitmap of bounded size (shared.sieve), so no text is shuffled to find candidates; rows that a bitmap lets through by
collision are told apart by the exact grouping on (length, SHA-256) at the end. Full contents are hashed for surviving
rows only. Counting is by partial aggregation, and the groups are joined back over both sides' exchanges, so adaptive
execution splits a group of any size.

Defined results: a null text counts as empty; all empty texts are one group; null ids sort below all others; of rows
with the same text and the same largest id one stays, the first in scan order; texts of any length are hashed whole. An empty
table gives no rows. `docs` must be re-readable in the same row order, as a table is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, sieve, sieve_bits, sift

PREFIX_CHARS = 256


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, prefix_chars: int = PREFIX_CHARS, hash_col: str | None = None) -> DataFrame:
    """One row per row of `docs`: keep_id, group_size, kept, full_hash (null for texts that an earlier level proved unique), then the `carry` columns (default: none) as a struct `carried`.

    `hash_col` names a carried column that has the texts' SHA-256 already (of '' for null), so that none is hashed twice.
    """
    names = carry or []
    base = docs.select(
        F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)]
    ).withColumns({"_rid": F.monotonically_increasing_id(), "_n": F.octet_length("_text")})

    lengths = base.groupBy("_n").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1")
    level1 = sift(base, F.col("_n"), sieve(lengths, F.col("_n")), "_m1")

    prefix = F.when(F.col("_m1"), F.xxhash64(F.substring("_text", 1, prefix_chars)))
    prefixed = level1.withColumn("_ph", prefix)
    prefixes = cut(prefixed.where("_m1").groupBy("_n", "_ph").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("_n", "_ph"), "prefixes")
    pair, bits = F.struct("_n", "_ph"), sieve_bits(prefixes.count())
    level2 = sift(prefixed, pair, sieve(prefixes, pair, bits), "_m2", bits)

    full = F.sha2("_text", 256) if hash_col is None else F.col(f"_c{names.index(hash_col)}")
    hashed = level2.withColumn("_alive", F.col("_m1") & F.col("_m2")).withColumn("_full", F.when(F.col("_alive"), full)).drop("_text", "_m1", "_m2", "_ph")
    alive = hashed.where("_alive")
    ties = alive.groupBy("_n", "_full", "_id").agg(F.count(F.lit(1)).alias("_same"), F.min("_rid").alias("_first"))
    groups = (
        ties.groupBy("_n", "_full")
        .agg(F.max(F.struct("_id", "_same", "_first")).alias("_top"), F.sum("_same").alias("_size"))
        .select(F.xxhash64("_n", "_full").alias("_jk"), F.col("_full").alias("_gfull"), "_top", "_size")
    )
    joined = alive.withColumn("_jk", F.xxhash64("_n", "_full")).join(groups.withColumnRenamed("_jk", "_gk"), (F.col("_jk") == F.col("_gk")) & (F.col("_full") == F.col("_gfull")))
    carried = F.struct(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(names)]) if names else F.lit(None).cast("string")
    top = F.col("_top._id")
    found = joined.select(
        F.col("_id").alias(id_col),
        top.alias("keep_id"),
        F.col("_size").cast("long").alias("group_size"),
        (F.col("_id").eqNullSafe(top) & ((F.col("_top._same") == 1) | (F.col("_rid") == F.col("_top._first")))).alias("kept"),
        F.col("_full").alias("full_hash"),
        carried.alias("carried"),
    )
    alone = hashed.where(~F.col("_alive")).select(
        F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lit(None).cast("string").alias("full_hash"), carried.alias("carried")
    )
    return found.unionByName(alone)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """The rows of `docs` that stay, with their own columns."""
    return exact_groups(docs, id_col, text_col, docs.columns, prefix_chars).where("kept").select("carried.*")
