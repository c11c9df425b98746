import random

import pytest
from pyspark.sql import functions as F

from strandline.functions import sequences as S
from strandline.functions.register import register


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_checks(spark):
    rows = spark.createDataFrame([("ACGTN",), ("",), ("ACGx",), ("acgt",), ("A\n",), (None,)], "s string")
    got = rows.select(S.is_content("s"), S.bad_position("s")).collect()
    assert [tuple(r) for r in got] == [(True, None), (True, None), (False, 3), (False, 0), (False, 1), (None, None)]
    for text, position in (("ACGx", 3), ("acgt", 0), ("A\n", 1)):
        with pytest.raises(Exception, match=f"position {position}"):
            one(spark, S.checked(F.lit(text)))
    with pytest.raises(Exception, match="longer than 4"):
        one(spark, S.checked(F.lit("ACGTA"), capacity=4))
    assert one(spark, S.is_content(F.lit("!~"), "quality")) and not one(spark, S.is_content(F.lit(" "), "quality"))


def test_predicates(spark):
    assert one(spark, S.has_n(F.lit("AnT"))) and not one(spark, S.has_n(F.lit("ACT")))
    assert one(spark, S.is_homopolymer(F.lit("AAA"))) and not one(spark, S.is_homopolymer(F.lit("AAC"))) and one(spark, S.is_homopolymer(F.lit(""))) is None
    assert one(spark, S.has_polyt_suffix(F.lit("ATT"), 2)) and one(spark, S.has_polyt_suffix(F.lit("A"), 0)) and not one(spark, S.has_polyt_suffix(F.lit("T"), 2))


def test_encode(spark):
    assert [one(spark, S.encode_2bit(F.lit(s))) for s in ("AATA", "T" * 16, "")] == [12, 4294967295, 0]
    for bad in ("AN", "A" * 17):
        with pytest.raises(Exception, match="2-bit"):
            one(spark, S.encode_2bit(F.lit(bad)))


def hamming(s, skip, mutation):
    return [s[:i] + c + s[i + 1 :] for i in range(len(s)) if s[i] not in skip for c in mutation if c != s[i]]


def test_neighbors(spark):
    rnd = random.Random(5)
    for s in ["", "A", "GNT"] + ["".join(rnd.choices("ACGTN", k=rnd.randrange(1, 9))) for _ in range(12)]:
        v = F.lit(s)
        assert one(spark, S.hamming_neighbors(v)) == hamming(s, "N", "ACGT")
        assert one(spark, S.hamming_neighbors(v, "mutate_n")) == hamming(s, "", "ACGT")
        assert one(spark, S.hamming_neighbors(v, "custom", "A", "TGN")) == hamming(s, "A", "TGN")
        assert one(spark, S.deletion_neighbors(v)) == [s[:i] + s[i + 1 :] for i in range(len(s))]
        assert one(spark, S.insertion_neighbors(v, True)) == [s[:i] + c + s[i:] for i in range(len(s) + 1) for c in "ACGTN"]
        edits = one(spark, S.edit_neighbors(v))
        assert len(edits) == len(hamming(s, "N", "ACGT")) + len(s) + 4 * (len(s) + 1)
    with pytest.raises(Exception, match="capacity"):
        one(spark, S.insertion_neighbors(F.lit("A" * 23)))


def test_edits(spark):
    assert one(spark, S.get_base(F.lit("ACG"), 2)) == "G" and one(spark, S.set_base(F.lit("ACG"), 1, "T")) == "ATG"
    assert one(spark, S.push(F.lit("AC"), "G")) == "ACG" and one(spark, S.remove(F.lit("ACG"), 0)) == "CG" and one(spark, S.insert(F.lit("AC"), 2, "T")) == "ACT"
    for wrong in (S.get_base(F.lit("A"), 1), S.remove(F.lit(""), 0), S.push(F.lit("AA"), "A", 2), S.insert(F.lit("A"), 2, "T")):
        with pytest.raises(Exception, match="beyond|longer"):
            one(spark, wrong)
    assert S.unique_chars("ACTGA") == "ACTG"


def test_quality_and_index(spark):
    assert one(spark, S.phred(F.lit("!I"))) == [0, 40] and one(spark, S.mean_phred(F.lit("!I"))) == 20 and one(spark, S.phred(F.lit(""))) == []
    match = lambda t, o, n: one(spark, S.matches_with_n(F.lit(t), F.lit(o), n))
    assert match("ACGT", "ANGT", 1) and not match("ACGT", "ANNT", 1) and not match("ACGT", "AGGT", 4) and not match("ACGT", "ACG", 4) and not match("NCGT", "ACGT", 4)


def test_sql_names(spark):
    register(spark)
    row = spark.sql("SELECT seq_has_n('AN'), seq_encode_2bit('AATA'), seq_slice('ACGT', 1, 2), seq_slice('ACGT', 4, NULL), seq_slice('ACGT', 5, NULL), seq_matches_with_n('AC', 'AN', 1), qual_mean('!I'), header_prefix('a:b c'), fastq_sample('/x/a_b_S1_L001_R1_001.fastq.gz'), fastq_sample_index('read-RA_si-ACGT_lane-001-chunk-000.fastq')").first()
    assert tuple(row) == (True, 12, "CG", "", None, True, 20.0, "a:b", "a_b", "ACGT")
