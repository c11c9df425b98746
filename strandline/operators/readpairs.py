"""Read pairs as relations: zip, validate, sample, trim, slice, interleave and render, all of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.headers import header_info, header_prefix, unknown_header
from ..functions.sequences import is_content
from ..schema import READ_NAMES, READS


def record(header: Column | str, seq: Column | str, qual: Column | str) -> Column:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.struct(c(header).alias("header"), c(seq).alias("seq"), c(qual).alias("qual"))


def zip_reads(reads: dict[str, DataFrame]) -> DataFrame:
    """Read tables (group_id, ordinal, header, seq, qual) side by side: group_id, ordinal, r1..i2; absent reads are null.

    An outer join on the position, so a stream that ends early shows as nulls (premature_end).
    """
    out = None
    for r in READS:
        if r in reads:
            one = reads[r].select("group_id", "ordinal", record("header", "seq", "qual").alias(r))
            out = one if out is None else out.join(one, ["group_id", "ordinal"], "full")
    if out is None:
        raise ValueError("no reads to zip")
    absent = F.lit(None).cast("struct<header:string,seq:string,qual:string>")
    return out.select("group_id", "ordinal", *[F.col(r) if r in reads else absent.alias(r) for r in READS])


def premature_end(pairs: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """group_id, ended, records: of each group whose streams differ in length, the first that ended and its length."""
    counts = [F.count(r).alias(r) for r in expected]
    rows = pairs.groupBy("group_id").agg(*counts)
    least = F.least(*expected) if len(expected) > 1 else F.col(expected[0])
    most = F.greatest(*expected) if len(expected) > 1 else F.col(expected[0])
    ended = F.coalesce(*[F.when(F.col(r) == least, r) for r in expected])
    return rows.where(least < most).select("group_id", ended.alias("ended"), least.alias("records"))


def header_mismatch(expected: tuple[str, ...] = READS) -> Column:
    """The first read whose header prefix isn't that of the first present read; null if there is none."""
    own = header_prefix(F.coalesce(*[F.col(f"{r}.header") for r in expected]))
    return F.coalesce(*[F.when(F.col(r).isNotNull() & (header_prefix(F.col(f"{r}.header")) != own), F.lit(r)) for r in expected])


def bad_bases() -> Column:
    """The first read with another character than A, C, G, T and N; null if there is none."""
    return F.coalesce(*[F.when(~is_content(F.col(f"{r}.seq")), F.lit(r)) for r in READS])


def reason() -> Column:
    """Why a pair is not valid; null if it is."""
    return F.coalesce(F.concat(F.lit("other characters than [ACGTN] in "), bad_bases()), F.concat(F.lit("header mismatch of "), header_mismatch()))


def validate(pairs: DataFrame, on_error: str = "fail") -> DataFrame:
    """Valid pairs; `fail` raises at an invalid one, `quarantine` keeps it and adds its reason."""
    if on_error == "quarantine":
        return pairs.withColumn("reason", reason())
    return pairs.where(F.when(reason().isNotNull(), F.raise_error(reason()).cast("boolean")).otherwise(F.lit(True)))


def subsample(pairs: DataFrame, rate: float, seed: int = 0, header: Column | str | None = None) -> DataFrame:
    """Pairs by keyed hash of the header's prefix: independent of partitions, and the same as the file reader's choice."""
    if rate >= 1:
        return pairs
    own = header_prefix(F.coalesce(*[F.col(f"{r}.header") for r in READS]) if header is None else header)
    draw = F.conv(F.substr(F.md5(F.concat(own, F.lit(str(seed)))), F.lit(1), F.lit(8)), 16, 10).cast("double") / 4294967296
    return pairs.where(draw < rate)


def length_trim(pairs: DataFrame, r1: int | None = None, r2: int | None = None) -> DataFrame:
    """Sequence and quality of R1 and R2 up to a length; headers and index reads stay."""
    cut = lambda r, n: F.when(F.col(r).isNotNull(), record(f"{r}.header", F.substr(f"{r}.seq", F.lit(1), F.lit(n)), F.substr(f"{r}.qual", F.lit(1), F.lit(n))))
    return pairs.withColumns({r: cut(r, n) for r, n in (("r1", r1), ("r2", r2)) if n is not None})


def is_empty() -> Column:
    """No present read has a base."""
    return F.greatest(*[F.coalesce(F.length(f"{r}.seq"), F.lit(0)) for r in READS]) == 0


def read_lengths() -> list[Column]:
    """The reads' lengths, null for absent ones."""
    return [F.length(f"{r}.seq").alias(f"{r}_length") for r in READS]


def to_long(pairs: DataFrame) -> DataFrame:
    """One row per present read: the pair's other columns, which, header, seq, qual."""
    keep = [c for c in pairs.columns if c not in READS]
    entries = F.array(*[F.struct(F.lit(READ_NAMES[r]).alias("which"), F.col(r).alias("record")) for r in READS])
    rows = pairs.select(*keep, F.explode(entries).alias("x")).where("x.record is not null")
    return rows.select(*keep, "x.which", "x.record.*")


def from_long(rows: DataFrame) -> DataFrame:
    """Pairs from one row per read: group_id, ordinal, which, header, seq, qual. An error if a pair has two records of one read."""
    whole, kind = record("header", "seq", "qual"), "struct<header:string,seq:string,qual:string>"

    def slot(r: str) -> Column:
        mine = F.col("which") == READ_NAMES[r]
        twice = F.raise_error(F.lit(f"{READ_NAMES[r]} is there already")).cast(kind)
        return F.when(F.count(F.when(mine, 1)) > 1, twice).otherwise(F.max(F.when(mine, whole))).alias(r)

    return rows.groupBy("group_id", "ordinal").agg(*[slot(r) for r in READS])


def single_ended(rows: DataFrame) -> DataFrame:
    """group_id, single_ended of interleaved streams: the first two records are of different clusters, or there is but one."""
    first = rows.where("ordinal < 2").groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.min(header_prefix("header")).alias("lo"), F.max(header_prefix("header")).alias("hi"))
    return first.select("group_id", ((F.col("n") < 2) | (F.col("lo") != F.col("hi"))).alias("single_ended"))


def odd_interleaved(rows: DataFrame) -> DataFrame:
    """group_id, records of the interleaved streams with an odd number of records."""
    return rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("records")).where("records % 2 = 1")


def read_set_header(pairs: DataFrame, default: bool = False) -> DataFrame:
    """group_id, header_info: run information of each set's first pair, from its first present read; null, or with `default`
    the values for an unknown run, where the header has none. An error if there are no pairs at all."""
    if pairs.isEmpty():
        raise ValueError("no reads to take a header from")
    info = header_info(F.coalesce(*[F.col(f"{r}.header") for r in READS]))
    if default:
        info = F.coalesce(info, unknown_header())
    return pairs.groupBy("group_id").agg(F.min_by(F.struct(info.alias("x")), "ordinal").alias("first")).select("group_id", F.col("first.x").alias("header_info"))


def interleave(pairs: DataFrame) -> DataFrame:
    """group_id, ordinal, header, seq, qual: R1 at even ordinals, R2 at odd ones."""
    both = F.posexplode(F.array("r1", "r2")).alias("k", "record")
    return pairs.select("group_id", F.col("ordinal").alias("pair"), both).select("group_id", (F.col("pair") * 2 + F.col("k")).alias("ordinal"), "record.*")


def deinterleave(rows: DataFrame, single_ended: bool = False) -> DataFrame:
    """The pairs of an interleaved stream (group_id, ordinal, header, seq, qual); single-ended ones get an empty R2 of the same header."""
    whole = record("header", "seq", "qual")
    absent = F.lit(None).cast("struct<header:string,seq:string,qual:string>")
    if single_ended:
        return rows.select("group_id", "ordinal", whole.alias("r1"), record("header", F.lit(""), F.lit("")).alias("r2"), absent.alias("i1"), absent.alias("i2"))
    at = lambda k: F.max(F.when(F.col("ordinal") % 2 == k, whole)).alias(f"r{k + 1}")
    pairs = rows.groupBy("group_id", F.floor(F.col("ordinal") / 2).cast("long").alias("ordinal_")).agg(at(0), at(1))
    odd = F.when(F.col("r2").isNull(), F.raise_error(F.lit("an odd number of interleaved records")).cast("struct<header:string,seq:string,qual:string>")).otherwise(F.col("r2"))
    return pairs.select("group_id", F.col("ordinal_").alias("ordinal"), "r1", odd.alias("r2"), absent.alias("i1"), absent.alias("i2"))


def render_fastq(header: Column | str, seq: Column | str, qual: Column | str) -> Column:
    """A record as text without its last line end, as text writers add one; null for an absent read."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.concat(F.lit("@"), c(header), F.lit("\n"), c(seq), F.lit("\n+\n"), c(qual))
