"""Helpers that several operators use: shared-folder tables, bounded bitmaps, column hygiene."""

from __future__ import annotations

import atexit
import ctypes
import inspect
import shutil
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Least and most bits of a sieve. 2**24 bits are at most 512 rows of 4 KiB, 2 MiB; 2**29 bits are 64 MiB, whatever the input holds.
SIEVE_BITS, MOST_SIEVE_BITS = 1 << 24, 1 << 29
_WORD = 32768  # bits of one bitmap row of Spark's bitmap functions


_own: dict[str, str] = {}  # by application, where the session names no folder


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode a fresh one where it is unset."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="strandline-")
        atexit.register(shutil.rmtree, _own[app], True)
    return _own[app]


def _tables(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandline/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has cut, once no DataFrame that reads them is needed any more."""
    _delete(spark, _tables(spark))


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write `df` as a table in the shared folder and read it back: lineage ends here, and a lost executor costs a re-read."""
    spark = df.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def drop_cut(df: DataFrame | None) -> None:
    """Delete a table made by cut() that nothing reads any more."""
    if path := getattr(df, "_strandline_path", None):
        _delete(df.sparkSession, path)


def sieve_bits(keys: int) -> int:
    """Bits of a sieve for so many keys: eight a key, so that about one other key in nine passes, within the bounds.

    Beyond 64 million keys more of the others pass. That only costs the caller a larger exchange, as passing never decides.
    """
    return min(MOST_SIEVE_BITS, max(SIEVE_BITS, 1 << (8 * keys).bit_length()))


def sieve(keys: DataFrame, key: Column, bits: int = SIEVE_BITS) -> DataFrame:
    """A bitmap of hashed keys, at most bits/8 bytes at any input size: bucket, bitmap (words of 64 bits). Built by partial aggregation."""
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    rows = keys.select((slot / _WORD).cast("long").alias("_sb"), (slot % _WORD).alias("_sp"))
    made = rows.groupBy("_sb").agg(F.bitmap_construct_agg("_sp").alias("_sm"))
    words = f"transform(sequence(0, {_WORD // 64 - 1}), w -> cast(conv(hex(substring(_sm, 8 * w + 1, 8)), 16, -10) as bigint))"
    return made.select("_sb", F.expr(words).alias("_sm"))


def sift(df: DataFrame, key: Column, made: DataFrame, name: str, bits: int = SIEVE_BITS) -> DataFrame:
    """Add boolean `name`: False means that `key` is certainly not among the sieve's keys; True may be a collision.

    The sieve is broadcast: its size is bounded by `bits`, not by the input.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    rows = df.withColumns({"_sb": (slot / _WORD).cast("long"), "_sp": (slot % _WORD).cast("int")})
    word = F.get("_sm", F.call_function("shiftright", "_sp", F.lit(6)))
    # the first of a word's bytes is its highest
    hit = F.call_function("shiftright", word, (F.col("_sp") % 64).bitwiseXOR(F.lit(56))).bitwiseAND(F.lit(1)) == 1
    out = rows.join(F.broadcast(made), "_sb", "left").withColumn(name, F.coalesce(hit, F.lit(False)))
    return out.drop("_sb", "_sp", "_sm")


def unit(*parts: Column) -> Column:
    """A hash of the parts as a double in [0, 1): the same on every executor and in every run."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / F.lit(float(1 << 53))


def without(docs: DataFrame, gone: DataFrame, key: str | Column) -> DataFrame:
    """The rows of `docs` whose key (an id column's name, or a long of its own) isn't in gone.id, with their own columns.

    Rows that the sieve clears pass without a shuffle; only the others, those gone and a few more, go through a join.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    key = F.col(f"`{key}`").cast("long") if isinstance(key, str) else key
    bits = sieve_bits(gone.count())
    rows = sift(docs.select(F.struct(*columns).alias("_row"), key.alias("_id")), F.col("_id"), sieve(gone, F.col("id"), bits), "_hit", bits)
    maybe = rows.where("_hit").join(gone.select(F.col("id").alias("_gone")), F.col("_id") == F.col("_gone"), "left_anti")
    return rows.where("not _hit").unionByName(maybe).select("_row.*")


def release() -> None:
    """Give memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:  # glibc
        trim(0)


def released(f: Callable) -> Callable:
    """`f`, a function for mapInArrow or applyInArrow, which gives its memory back at the end of its rows.

    Python workers outlive their stage, up to two a core, beside those of the next one: what they keep counts for the executor.
    """
    if inspect.isgeneratorfunction(f):

        def run(batches):
            try:
                yield from f(batches)
            finally:
                release()

    elif len(inspect.signature(f).parameters) == 1:

        def run(rows):
            try:
                return f(rows)
            finally:
                release()

    else:

        def run(left, right):
            try:
                return f(left, right)
            finally:
                release()

    return run
