"""The queries of the operators on reads, and the SQL that each is held against. Reads come from virtual.py."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import headers as H
from .functions import ranges as R
from .functions import sequences as S
from .operators import adapters as A
from .operators import manifest as M
from .operators import readpairs as P
from .operators import sample_index as X
from .schema import which_read
from .virtual import HEX, header, quality, reads, sequence

ADAPTER_LONG = A.Adapter("long", "three_prime", "anywhere", "ACGTACGGTTCA")
_POLY = {loc: {end: A.Adapter(f"poly_a_{end}_{loc}", end, loc, "AAAAAAAA") for end in A.ENDS} for loc in A.LOCATIONS}


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("id"), "user_id")


def _short(spark: SparkSession, d: str) -> DataFrame:
    """id and s: sequences of 0 to 8 bases with N, of orders."""
    orders = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"))
    return orders.select("id", F.substr(sequence(F.col("id")), F.lit(1), (F.col("id") % 9).cast("int")).alias("s"))


def barcode_umi_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = reads(spark, d).select(R.slice_column("seq", 0, 16).alias("barcode"), R.slice_column("seq", 16, 10).alias("umi"))
    rows = rows.where(~S.has_n("barcode") & ~S.has_n("umi") & ~S.is_homopolymer("barcode") & ~S.is_homopolymer("umi"))
    return rows.groupBy("barcode").agg(F.count(F.lit(1)).alias("n_reads"), F.countDistinct("umi").alias("n_umis"))


def range_slices(spark: SparkSession, d: str) -> DataFrame:
    rows = _short(spark, d)
    return rows.select("id", R.slice_column("s", 2, 3).alias("closed"), R.slice_column("s", 3).alias("open"), R.slice_column("s", (F.col("id") % 11).cast("int"), (F.col("id") % 5).cast("int")).alias("varied"))


def _ranges(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("l_orderkey")
    rows = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber")
    k = i * 7 + F.col("l_linenumber")
    return rows.select(k.alias("id"), (k % 40).alias("o1"), F.when(k % 3 != 0, k % 23).alias("n1"), (k % 31).alias("o2"), F.when(k % 4 != 0, k % 17).alias("n2"))


def range_intersect(spark: SparkSession, d: str) -> DataFrame:
    o, n = R.intersect_columns("o1", "n1", "o2", "n2")
    return _ranges(spark, d).select("id", "o1", "n1", "o2", "n2", o.alias("offset"), n.alias("len"))


def range_shrink(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranges(spark, d).where("n1 >= 2 or n1 is null")
    start = (F.col("id") % 2).cast("int")
    o, n = R.shrink_columns("o1", "n1", start, start + F.floor(F.col("id") % 4 / 2).cast("int"))
    return rows.select("id", "o1", "n1", o.cast("long").alias("offset"), n.cast("long").alias("len"))


def range_trim(spark: SparkSession, d: str) -> DataFrame:
    """Closed and open ranges; an open one has no end to trim, but nothing may be trimmed off it."""
    rows = _ranges(spark, d).where("n1 >= 3 or n1 is null")
    o5, n5 = R.trim_columns("o1", "n1", "five_prime", F.col("id") % 4)
    o3, n3 = R.trim_columns("o1", "n1", "three_prime", F.when(F.col("n1").isNull(), 0).otherwise(F.col("id") % 3))
    return rows.select("id", *[c.cast("long").alias(name) for c, name in ((o5, "offset5"), (n5, "len5"), (o3, "offset3"), (n3, "len3"))])


def range_packed(spark: SparkSession, d: str) -> DataFrame:
    packed = (F.col("o1").cast("long") * 32768 + F.coalesce("n1", F.lit(R.OPEN))).alias("packed")
    rows = _ranges(spark, d).select("id", packed)
    _, o, n = R.packed_parts("packed")
    return rows.select("id", "packed", o.cast("long").alias("offset"), n.cast("long").alias("len"))


def seq_validate(spark: SparkSession, d: str) -> DataFrame:
    s = F.when(F.col("id") % 5 == 0, F.concat("s", F.lit("x"))).when(F.col("id") % 7 == 0, F.lower("s")).otherwise(F.col("s"))
    rows = _short(spark, d).select("id", s.alias("s"))
    return rows.select("id", S.is_content("s").alias("valid"), S.bad_position("s").cast("long").alias("bad_at"))


def qual_validate(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("id", F.when(F.col("id") % 6 == 0, F.concat(quality(F.col("id")), F.lit(" "))).otherwise(quality(F.col("id"))).alias("q"))
    return rows.select("id", S.is_content("q", "quality").alias("valid"))


def seq_predicates(spark: SparkSession, d: str) -> DataFrame:
    return _short(spark, d).select("id", S.has_n("s").alias("has_n"), S.is_homopolymer("s").alias("homopolymer"), S.has_polyt_suffix("s", 2).alias("polyt2"), S.has_homopolymer_suffix("s", "A", 1).alias("ends_a"))


def encode_2bit(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("id", F.substr(sequence(F.col("id"), False), F.lit(1), (F.col("id") % 17).cast("int")).alias("s"))
    return rows.select("id", "s", S.encode_2bit("s").alias("code"))


def _exploded(rows: DataFrame, made: Column) -> DataFrame:
    return rows.select("id", F.posexplode(made).alias("k", "neighbor")).select("id", F.col("k").cast("long").alias("k"), "neighbor")


def hamming_skip(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_short(spark, d), S.hamming_neighbors("s"))


def hamming_mutate(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_short(spark, d), S.hamming_neighbors("s", "mutate_n"))


def hamming_custom(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_short(spark, d), S.hamming_neighbors("s", "custom", "AN", "CGN"))


def deletion_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_short(spark, d), S.deletion_neighbors("s"))


def insertion_neighbors(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(_short(spark, d), S.insertion_neighbors("s"))


def edit_neighbors(spark: SparkSession, d: str) -> DataFrame:
    rows = _short(spark, d).select("id", F.explode(F.array_distinct(S.edit_neighbors("s"))).alias("neighbor"), "s")
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("neighbor").alias("first"), F.max("neighbor").alias("last"))


def barcode_correction(spark: SparkSession, d: str) -> DataFrame:
    """Observed 8-mers within one substitution of a listed barcode, by a hash join on the neighbours."""
    listed = spark.read.parquet(f"{d}/supplier.parquet").select(F.substr(sequence(F.col("s_suppkey"), False), F.lit(1), F.lit(5)).alias("barcode")).distinct()
    seen = _events(spark, d).select("id", F.substr(sequence(F.col("id")), F.lit(1), F.lit(5)).alias("s"))
    near = seen.select("id", F.explode(F.concat(F.array("s"), S.hamming_neighbors("s", "mutate_n"))).alias("barcode"))
    return near.join(listed, "barcode").groupBy("id").agg(F.count(F.lit(1)).alias("n_hits"), F.min("barcode").alias("first_hit"))


def header_info(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("id", H.header_info(header(F.col("id"))).alias("h"))
    return rows.select("id", "h.instrument", "h.run_number", "h.flowcell", "h.lane")


def _paths(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("o_orderkey")
    reads_ = F.element_at(F.array(*[F.lit(x) for x in ("R1", "R2", "I1", "I2", "R3", "R1", "R2")]), (i % 7 + 1).cast("int"))
    sample = F.concat(F.lit("sample_"), (i % 13).cast("string"))
    lane = F.when(i % 13 < 9, F.format_string("_L%03d", i % 4 + 1)).otherwise("")
    name = F.format_string("%s_S%d%s_%s_001.fastq%s", sample, i % 13 + 1, lane, reads_, F.when(i % 2 == 0, ".gz").otherwise(""))
    other = F.format_string("read-%s_si-%s_lane-%03d-chunk-%03d.fastq.lz4", F.element_at(F.array(*[F.lit(x) for x in ("RA", "I1", "I2")]), (i % 3 + 1).cast("int")), F.substr(sequence(i % 40), F.lit(1), F.lit(8)), i % 4 + 1, i % 2)
    path = F.concat(F.lit("/run/"), (i % 5).cast("string"), F.lit("/"), F.when(i % 3 == 0, other).when(i % 11 == 0, F.lit("notes.txt")).otherwise(name))
    return spark.read.parquet(f"{d}/orders.parquet").select(i.alias("id"), path.alias("path"))


def filename_bcl2fastq(spark: SparkSession, d: str) -> DataFrame:
    rows = _paths(spark, d).select("id", H.bcl2fastq_name("path").alias("f")).where("f is not null")
    return rows.select("id", "f.sample", F.col("f.s").cast("long").alias("s"), F.col("f.lane").cast("long").alias("lane"), "f.read", F.col("f.chunk").cast("long").alias("chunk"))


def filename_bcl_processor(spark: SparkSession, d: str) -> DataFrame:
    rows = _paths(spark, d).select("id", H.bcl_processor_name("path").alias("f")).where("f is not null")
    return rows.select("id", "f.si", F.col("f.lane").cast("long").alias("lane"), "f.read", F.col("f.chunk").cast("long").alias("chunk"))


def _wide(groups: DataFrame, keys: tuple) -> DataFrame:
    longs = {"s", "lane", "chunk"}
    return groups.select(*[F.col(k).cast("long").alias(k) if k in longs else F.col(k) for k in keys], "r1", "r2", "i1", "i2", "r1_interleaved")


def group_files_bcl2fastq(spark: SparkSession, d: str) -> DataFrame:
    return _wide(M.group_bcl2fastq(_paths(spark, d)), M.KEYS["bcl2fastq"])


def group_files_bcl_processor(spark: SparkSession, d: str) -> DataFrame:
    return _wide(M.group_bcl_processor(_paths(spark, d)), M.KEYS["bcl_processor"])


def find_by_sample_and_lane(spark: SparkSession, d: str) -> DataFrame:
    groups = M.group_bcl2fastq(_paths(spark, d))
    return _wide(M.Bcl2FastqDef("", ("sample_1", "sample_7"), (1, 2)).select(groups), M.KEYS["bcl2fastq"])


def find_by_index(spark: SparkSession, d: str) -> DataFrame:
    groups = M.group_bcl_processor(_paths(spark, d))
    wanted = ("GAATAATG", "GATACGTC", "CTATCATG")
    return _wide(M.BclProcessorDef("", wanted, 2).select(groups), M.KEYS["bcl_processor"])


def index_match_n(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("id", F.substr(sequence(F.col("id")), F.lit(1), F.lit(3)).alias("observed"))
    return rows.select("id", "observed", *[S.matches_with_n(F.lit("ACG"), "observed", n).alias(f"within_{n}") for n in (0, 1, 3)])


def group_samples(spark: SparkSession, d: str) -> DataFrame:
    table = X.index_table(spark)
    seqs = sorted({s for v in X.SETS.values() for s in v})
    known = F.element_at(F.array(*[F.lit(s) for s in seqs]), (F.col("id") % len(seqs) + 1).cast("int"))
    groups = _events(spark, d).select("id", F.when(F.col("id") % 4 == 0, F.substr(sequence(F.col("id")), F.lit(1), F.lit(8))).otherwise(known).alias("si"))
    return X.group_samples(groups, table, True).groupBy("set_name").agg(F.count(F.lit(1)).alias("n"), F.min("si").alias("first_si"))


def _streams(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    i = F.col("id")
    rows = _events(spark, d).select((i % 20).alias("group_id"), F.floor(i / 20).alias("ordinal"), i.alias("id"))
    one = lambda part, keep, head: rows.where(keep).select("group_id", "ordinal", head.alias("header"), sequence(F.concat(F.lit(part), i.cast("string"))).alias("seq"), quality(i).alias("qual"))
    name = F.concat(F.lit("c:"), i.cast("string"))
    return {
        "r1": one("a", F.lit(True), F.concat(name, F.lit(" 1:N"))),
        "r2": one("b", F.lit(True), F.concat(F.when(i % 97 == 5, F.lit("x")).otherwise(F.lit("")), name, F.lit("/2"))),
        "i1": one("c", ~((F.col("group_id") == 3) & (F.col("ordinal") >= 10)), name),
    }


def zip_reads(spark: SparkSession, d: str) -> DataFrame:
    pairs = P.zip_reads(_streams(spark, d))
    return pairs.select("group_id", "ordinal", F.col("r1.header").alias("h1"), F.col("r2.seq").alias("seq2"), F.col("i1.seq").alias("index1"), F.col("i2.seq").alias("index2"))


def header_mismatch(spark: SparkSession, d: str) -> DataFrame:
    pairs = P.zip_reads(_streams(spark, d))
    return pairs.select("group_id", "ordinal", P.header_mismatch().alias("mismatch")).where("mismatch is not null")


def premature_end(spark: SparkSession, d: str) -> DataFrame:
    return P.premature_end(P.zip_reads(_streams(spark, d)), ("r1", "r2", "i1"))


def length_trim(spark: SparkSession, d: str) -> DataFrame:
    pairs = P.length_trim(P.zip_reads(_streams(spark, d)), 10, 40)
    return pairs.select("group_id", "ordinal", F.col("r1.seq").alias("s1"), F.col("r1.qual").alias("q1"), F.col("r2.seq").alias("s2"), F.col("i1.seq").alias("s3"))


def subsample(spark: SparkSession, d: str) -> DataFrame:
    return P.subsample(P.zip_reads(_streams(spark, d)), 0.25, 7).select("group_id", "ordinal")


def pattern_exists(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("id", S.pattern_exists("seq", "GATT").alias("found"))


def mean_phred(spark: SparkSession, d: str) -> DataFrame:
    return reads(spark, d).select("id", F.round(S.mean_phred("qual"), 6).alias("mean"))


def interleave_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    streams = _streams(spark, d)
    pairs = P.deinterleave(P.interleave(P.zip_reads({"r1": streams["r1"], "r2": streams["r2"]})))
    long = P.to_long(pairs)
    return long.select("group_id", "ordinal", "which", P.render_fastq("header", "seq", "qual").alias("text"))


def _poly(end: str, location: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        made = F.translate(F.md5(F.col("id").cast("string")), HEX, "AAAAAAAAAAAACGTN")
        rows = _events(spark, d).select("id", F.substr(made, F.lit(1), (F.col("id") % 33).cast("int")).alias("s"))
        hit = rows.select("id", A.find_homopolymer("s", _POLY[location][end]).alias("t")).where("t is not null")
        return hit.select("id", *[F.col(f"t.{f}").cast("long").alias(f) for f in A._FIELDS])

    return run


def trim_adapter(spark: SparkSession, d: str) -> DataFrame:
    """A planted adapter, whole, cut short by the read's end or with an error, found and trimmed."""
    i = F.col("id")
    planted = F.when(i % 4 == 0, F.lit("ACGTACGGTTCA")).when(i % 4 == 1, F.lit("ACGTACGGATCA")).when(i % 4 == 2, F.lit("ACGTACG")).otherwise(F.lit(""))
    body = F.translate(F.md5(i.cast("string")), HEX, "CCGTTGGTCCTTGGCC")
    rest = F.when(i % 4 < 2, F.substr(sequence(i), F.lit(1), (i % 9).cast("int"))).otherwise(F.lit(""))
    rows = _events(spark, d).select("id", F.concat(body, planted, rest).alias("s"))
    hit = rows.select("id", "s", A.find_adapter("s", ADAPTER_LONG).alias("t"))
    return hit.select("id", F.col("t.trim_start").alias("trim_start"), F.substr("s", F.lit(1), F.coalesce("t.retain_end", F.length("s"))).alias("kept"))


def single_ended(spark: SparkSession, d: str) -> DataFrame:
    """Interleaved streams of which every third has one read a cluster."""
    i = F.col("id")
    rows = _events(spark, d).select((i % 20).alias("group_id"), F.floor(i / 20).alias("ordinal"), i.alias("id"))
    cluster = F.when(F.col("group_id") % 3 == 0, F.col("ordinal")).otherwise(F.floor(F.col("ordinal") / 2))
    return P.single_ended(rows.select("group_id", "ordinal", F.format_string("c:%d %d", cluster, F.col("ordinal") % 2).alias("header")))


def odd_interleaved(spark: SparkSession, d: str) -> DataFrame:
    return P.odd_interleaved(_events(spark, d).select((F.col("id") % 17).alias("group_id")))


def check_range(spark: SparkSession, d: str) -> DataFrame:
    trimmed = P.length_trim(P.zip_reads(_streams(spark, d)), 10, 40)
    return trimmed.select("group_id", "ordinal", R.ReadRange("r1", 4, 8).problem("UMI").alias("r1"), R.ReadRange("r2", 20, 12).problem("Tag").alias("r2"), R.ReadRange("i1", 30, 4).problem("Index").alias("i1"), R.ReadRange("i2", 0).problem("Index").alias("i2"))


def empty_pairs(spark: SparkSession, d: str) -> DataFrame:
    none = lambda r: P.record(f"{r}.header", F.lit(""), F.lit(""))
    pairs = P.zip_reads(_streams(spark, d)).withColumns({"r1": F.when(F.col("ordinal") % 3 == 0, none("r1")).otherwise(F.col("r1")), "r2": F.when(F.col("ordinal") % 2 == 0, none("r2")).otherwise(F.col("r2"))})
    return pairs.where(P.is_empty()).select("group_id", "ordinal")


def read_parts(spark: SparkSession, d: str) -> DataFrame:
    """Parts of reads by name and number, and the reads' lengths."""
    pairs = P.zip_reads(_streams(spark, d))
    part = lambda read, field: F.col(f"{which_read(read)}.{field}")
    lengths = [c.cast("long") for c in P.read_lengths()]
    return pairs.select("group_id", "ordinal", part("R1", "header").alias("h1"), part(1, "qual").alias("q2"), part("index1", "seq").alias("s3"), part("i2", "seq").alias("s4"), *[c.alias(f"n_{r}") for r, c in zip(("r1", "r2", "i1", "i2"), lengths)])


def range_valid(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranges(spark, d).select("id", (F.col("o1") * 1000 - 500).alias("o"), (F.col("n1") * 1500 - 10).alias("n"))
    return rows.select("id", R.valid_range("o", "n").alias("valid"))


def half_open_intersect(spark: SparkSession, d: str) -> DataFrame:
    rows = _ranges(spark, d).where("n1 is not null and n2 is not null")
    start, end = R.intersect_half_open(F.col("o1"), F.col("o1") + F.col("n1"), F.col("o2"), F.col("o2") + F.col("n2"))
    return rows.select("id", start.alias("start"), end.alias("end"))


def pairs_from_long(spark: SparkSession, d: str) -> DataFrame:
    pairs = P.from_long(P.to_long(P.zip_reads(_streams(spark, d))))
    return pairs.select("group_id", "ordinal", F.col("r1.seq").alias("s1"), F.col("r2.header").alias("h2"), F.col("i1.qual").alias("q3"), F.col("i2.seq").alias("s4"))


def read_set_header(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id")
    rows = _events(spark, d).select((i % 50).alias("group_id"), F.floor(i / 50).alias("ordinal"), header(i).alias("header"), F.lit("A").alias("seq"), F.lit("I").alias("qual"))
    return P.read_set_header(P.zip_reads({"r1": rows}), True).select("group_id", "header_info.*")


def lane_modes(spark: SparkSession, d: str) -> DataFrame:
    groups = M.group_bcl2fastq(_paths(spark, d))
    return groups.groupBy(M.lane_mode().alias("mode")).agg(F.count(F.lit(1)).alias("n_groups"), F.countDistinct("sample").alias("n_samples"))


def mixed_lanes(spark: SparkSession, d: str) -> DataFrame:
    groups = M.group_bcl2fastq(_paths(spark, d)).withColumn("project", F.col("s").cast("long") % 5)
    return M.lane_modes(groups, "project")


DEFINITIONS = ('{"bcl2fastq": {"path": "", "samples": ["sample_1", "sample_7"], "lanes": [1, 2]}}', '{"bcl_processor": {"path": "", "indices": ["GAATAATG", "GATACGTC", "CTATCATG"], "max_ns": 2}}')


def fastq_defs(spark: SparkSession, d: str) -> DataFrame:
    """Definitions of both layouts, from JSON, each resolved by its own class."""
    files = _paths(spark, d)
    found = [M.fastq_def(x).of_files(files).select(F.lit(k).alias("definition"), "r1", "r2", "i1", "i2", "r1_interleaved") for k, x in enumerate(DEFINITIONS)]
    return found[0].unionByName(found[1])


def folder_samples(spark: SparkSession, d: str) -> DataFrame:
    groups = M.group_bcl2fastq(_paths(spark, d))
    return groups.groupBy("sample").agg(F.count(F.lit(1)).alias("n_groups"), F.sort_array(F.collect_set("lane")).cast("string").alias("lanes"))


def folder_indices(spark: SparkSession, d: str) -> DataFrame:
    groups = _events(spark, d).select(F.element_at(F.array(*[F.lit(x) for x in INDICES]), (F.col("id") % len(INDICES) + 1).cast("int")).alias("si"))
    sets = spark.createDataFrame([(k, s) for k, v in X.SETS.items() if k in WANTED for s in v], "set_name string, si string")
    return M.contained_indices(groups, spark.createDataFrame([(x,) for x in WANTED], "index string"), sets)


#: Set names and sequences to look for, and the sequences that files have.
WANTED = ("SI-GA-A1", "SI-001", "SI-P2-H12", "AAAACCCC", "GATTACAA")
INDICES = (X.SETS["SI-GA-A1"][0], X.SETS["SI-GA-A1"][2], "GATTACAA", "TTTTTTTT")


def check_samples(spark: SparkSession, d: str) -> DataFrame:
    return M.usable_samples(M.group_bcl2fastq(_paths(spark, d)), ["sample_2", "sample_8", "sample_99"], [1, 3])


def char_sets(spark: SparkSession, d: str) -> DataFrame:
    return _short(spark, d).select("id", S.distinct_bases("s").alias("letters"), F.size(S.bases("s")).cast("long").alias("n"), F.get(S.bases("s"), F.lit(2)).alias("third"))


def construct(spark: SparkSession, d: str) -> DataFrame:
    letters = F.transform(S.bases("s"), lambda c: F.when((F.col("id") % 11 == 0) & (c == "G"), F.lit("x")).otherwise(c))
    return _short(spark, d).select("id", S.from_bases(F.reverse(letters)).alias("made"))


def seq_edits(spark: SparkSession, d: str) -> DataFrame:
    rows = _short(spark, d).where("length(s) >= 3")
    return rows.select("id", S.push("s", "A").alias("pushed"), S.remove("s", 1).alias("removed"), S.insert("s", 2, "C").alias("inserted"), S.get_base("s", 0).alias("first"), S.set_base("s", 1, "G").alias("set"))


def seq_order(spark: SparkSession, d: str) -> DataFrame:
    """Equality, order and hash of sequences: classes of equal ones and the one that follows."""
    from pyspark.sql import Window

    rows = _short(spark, d).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("next", F.lead("s").over(Window.partitionBy(F.length("s")).orderBy("s")))


def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    scores = S.phred(quality(F.col("id")))
    return _events(spark, d).select("id", F.array_max(scores).cast("long").alias("best"), F.array_min(scores).cast("long").alias("worst"))


def processed_reads(spark: SparkSession, d: str) -> DataFrame:
    """The barcode processor over pairs, with the aligner's view and tags of what it takes."""
    from .plans.processor import BarcodeUmi, alignable, bam_tags

    pairs = P.zip_reads(_streams(spark, d)).withColumn("r1", F.when(F.col("ordinal") % 5 == 0, P.record("r1.header", F.substr("r1.seq", F.lit(1), F.lit(20)), F.substr("r1.qual", F.lit(1), F.lit(20)))).otherwise(F.col("r1")))
    rows = BarcodeUmi([]).run(pairs)
    view = alignable(pairs).select("group_id", "ordinal", F.length("align_sequence.read1").cast("long").alias("n1"), F.col("align_quality.read2").alias("q2"))
    tags = bam_tags({"CB": F.col("processed.barcode"), "UB": F.col("processed.umi")})
    return rows.join(view, ["group_id", "ordinal"]).select("group_id", "ordinal", F.col("gem_group").cast("long").alias("gem_group"), "reason", F.get(F.map_values(tags), F.lit(0)).alias("cb"), F.col("processed.umi").alias("ub"), F.col("unprocessed.r1.header").alias("refused"), "n1", "q2")


def catalog_trim(spark: SparkSession, d: str) -> DataFrame:
    """Two adapters of R1 and one of R2, by name, and what all of them leave."""
    i = F.col("id")
    body = F.translate(F.md5(i.cast("string")), HEX, "CCGTTGGTCCTTGGCC")
    planted = F.when(i % 3 == 0, F.lit("ACGTACGGTTCA")).when(i % 3 == 1, F.lit("AAAAAAAA")).otherwise(F.lit(""))
    whole = lambda s: P.record(F.lit("c"), s, F.repeat(F.lit("I"), F.length(s)))
    pairs = _events(spark, d).select((i % 20).alias("group_id"), i.alias("ordinal"), whole(F.concat(body, planted)).alias("r1"), whole(F.concat(F.lit("AAAAAAAA"), body)).alias("r2"))
    catalog = A.AdapterCatalog({"r1": [ADAPTER_LONG, _POLY["anywhere"]["three_prime"]], "r2": [_POLY["anchored"]["five_prime"]]})
    rows = catalog.trim(pairs)
    return rows.select("ordinal", F.col("r1.seq").alias("s1"), F.length("r1.qual").cast("long").alias("n1"), F.col("r2.seq").alias("s2"))


def trimmed_fastq(spark: SparkSession, d: str) -> DataFrame:
    pairs = P.length_trim(P.zip_reads(_streams(spark, d)), 12)
    return pairs.select("group_id", "ordinal", P.render_fastq("r1.header", "r1.seq", "r1.qual").alias("text"))


def change_dir(spark: SparkSession, d: str) -> DataFrame:
    moved = M.change_dir(M.group_bcl2fastq(_paths(spark, d)), "/elsewhere/")
    return moved.select("r1", "r2", "i1", "i2")


def fasta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    from .sources import fasta

    folder = f"{_scratch(spark)}/fasta-{os.urandom(6).hex()}"
    fasta.write_fasta(_events(spark, d).select(F.col("id").cast("string").alias("id"), sequence(F.col("id")).alias("seq")), folder)
    return fasta.read_fasta(spark, folder).select(F.col("id").cast("long").alias("id"), "seq")


def json_adapters(spark: SparkSession, d: str) -> DataFrame:
    """Adapters and a chemistry written as JSON and read with their types."""
    from .sources import fasta

    folder = f"{_scratch(spark)}/json-{os.urandom(6).hex()}"
    adapters = json.dumps({"R1": [{"name": "a", "end": "three_prime", "location": "anywhere", "seq": "ACGTACGT"}], "R2": [{"name": "b", "end": "five_prime", "location": "anchored", "seq": "AAAAAAAA"}]})
    chemistry = json.dumps({"name": "x", "barcode_read_type": "R1", "barcode_read_offset": 0, "barcode_read_length": 16, "umi_read_type": "R1", "umi_read_offset": 16, "umi_read_length": 10})
    for name, text in (("adapters", adapters), ("chemistry", chemistry)):
        spark.createDataFrame([(text,)], "value string").write.text(f"{folder}/{name}")
    found = fasta.read_adapters(spark, f"{folder}/adapters")
    ranges = fasta.read_chemistry(spark, f"{folder}/chemistry").select(F.lit("R1").alias("read"), *[fasta.chemistry_range(x).alias(x) for x in ("barcode", "umi", "rna2")])
    at = lambda x: F.concat_ws(":", f"{x}.read", f"{x}.offset", f"{x}.len")
    return found.join(ranges.select("read", at("barcode").alias("barcode"), at("umi").alias("umi"), F.col("rna2").isNull().alias("no_rna2")), "read", "left")


def _written(spark: SparkSession, d: str, suffix: str = "fastq.gz", faults: bool = False) -> tuple[str, list[str]]:
    """A folder with read sets of this input as files, and the sets' names."""
    from .sources.fastq import ReadSetSource

    spark.dataSource.register(ReadSetSource)
    folder = f"{_scratch(spark)}/readset-{os.urandom(6).hex()}"
    streams = _streams(spark, d)
    pairs = P.zip_reads({"r1": streams["r1"], "r2": streams["r1"]}).repartition(4, "group_id").sortWithinPartitions("group_id", "ordinal")
    if faults:  # a base that isn't one, in one cluster
        pairs = pairs.withColumn("r2", F.when((F.col("group_id") == 0) & (F.col("ordinal") == 3), P.record("r2.header", F.lit("ACGU"), F.lit("IIII"))).otherwise(F.col("r2")))
    pairs.write.format("readset").option("suffix", suffix).mode("append").save(folder)
    return folder, sorted(x[: -len(f"_R1.{suffix}")] for x in os.listdir(folder) if x.endswith(f"_R1.{suffix}"))


def _manifest(folder: str, sets: list[str], suffix: str = "fastq.gz") -> str:
    return json.dumps([{"r1": f"{folder}/{s}_R1.{suffix}", "r2": f"{folder}/{s}_R2.{suffix}", "r1_interleaved": False} for s in sets])


def fastq_scan(spark: SparkSession, d: str) -> DataFrame:
    """Read sets of this input written as files in the shared folder and scanned again by the reader."""
    found = spark.read.format("readset").option("manifest", _manifest(*_written(spark, d))).load()
    return found.groupBy().agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.length("r1.seq")).alias("bases"), F.countDistinct("r1.header").alias("headers"))


def fastq_faults(spark: SparkSession, d: str) -> DataFrame:
    """Sets of which one has a fault: what came before it is kept, and the fault has a row."""
    folder, sets = _written(spark, d, "fastq", True)
    found = spark.read.format("readset").option("manifest", _manifest(folder, sets, "fastq")).option("on_error", "quarantine").load()
    fault = F.substring_index("reason", " (", 1)
    return found.where("reason is not null or r1.seq <> r2.seq").select(fault.alias("fault"), F.col("r1").isNull().alias("no_reads"))


def folder_files(spark: SparkSession, d: str) -> DataFrame:
    """The files of a folder, listed by Spark, with their parts."""
    folder, _ = _written(spark, d)
    names = M.list_files(spark, folder, False).select(F.regexp_extract("path", r"_([RI][12])\.fastq\.gz$", 1).alias("read"))
    return names.groupBy("read").agg((F.count(F.lit(1)) > 0).alias("there"))


def _scratch(spark: SparkSession) -> str:
    """The shared folder as a path that Python opens too (the readset source needs one); in local mode a fresh one where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        return tempfile.mkdtemp()
    path = root.removeprefix("file://")
    if "://" in path:
        raise ValueError(f"read set files need a mounted folder, not {root}")
    return path


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        barcode_umi_counts, range_slices, range_intersect, range_shrink, range_trim, range_packed, seq_validate, qual_validate, seq_predicates, encode_2bit,
        hamming_skip, hamming_mutate, hamming_custom, deletion_neighbors, insertion_neighbors, edit_neighbors, barcode_correction, header_info,
        filename_bcl2fastq, filename_bcl_processor, group_files_bcl2fastq, group_files_bcl_processor, find_by_sample_and_lane, find_by_index, index_match_n,
        group_samples, zip_reads, header_mismatch, premature_end, length_trim, subsample, pattern_exists, mean_phred, interleave_roundtrip, trim_adapter, fastq_scan,
        single_ended, odd_interleaved, check_range, empty_pairs, read_parts, range_valid, half_open_intersect, pairs_from_long, read_set_header, lane_modes, mixed_lanes, fastq_defs,
        folder_samples, folder_indices, check_samples, char_sets, construct, seq_edits, seq_order, quality_scores, processed_reads, catalog_trim, trimmed_fastq, change_dir, fasta_roundtrip,
        json_adapters, fastq_faults, folder_files,
    )
} | {f"trim_homopolymer_{end[0:5].rstrip('_')}_{loc}": _poly(end, loc) for end in A.ENDS for loc in A.LOCATIONS}
