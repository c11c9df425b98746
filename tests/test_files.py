import gzip
import os
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.functions import headers as H
from strandline.operators import manifest as M
from strandline.operators import readpairs as P
from strandline.operators import sample_index as X
from strandline.plans.processor import BarcodeUmi, alignable, bam_tags
from strandline.sources import fasta
from strandline.sources.fastq import FastqError, ReadSetSource, records, render, write_text
from strandline.streaming.arrivals import sets_in


def fq(n, tag="", size=8, start=0):
    return b"".join(render((f"c:{i}:F:2:{i}{tag}", ("ACGTNACGTACG" * 3)[i % 4 : i % 4 + size], "I" * size)) for i in range(start, start + n))


def put(path, data, how="plain"):
    if how == "gz":
        data = gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :])
    elif how == "lz4":
        sink = pa.BufferOutputStream()
        with pa.CompressedOutputStream(sink, "lz4") as out:
            out.write(data)
        data = sink.getvalue().to_pybytes()
    path.write_bytes(data)
    return str(path)


def load(spark, **options):
    spark.dataSource.register(ReadSetSource)
    return spark.read.format("readset").options(**options).load()


@pytest.mark.parametrize("how", ["plain", "gz", "lz4"])
def test_compressions_by_content(spark, tmp_path, how):
    r1, r2 = put(tmp_path / "a.fastq.gz", fq(10, " 1"), how), put(tmp_path / "b.fastq", fq(10, "/2"), how)
    got = load(spark, r1=r1, r2=r2).orderBy("ordinal").collect()
    assert [r.r1.seq for r in got] == [s for _, s, _ in records(r1)] and len(got) == 10 and got[0].i1 is None and got[3].r2.header == "c:3:F:2:3/2"


def test_interleaved_single_ended_and_trims(spark, tmp_path):
    both = b"".join(render((f"c:{i} {k}", "ACGTACGT", "IIIIIIII")) for i in range(4) for k in (1, 2))
    got = load(spark, r1=put(tmp_path / "ra", both), interleaved="true", r1_length="3").collect()
    assert len(got) == 4 and got[0].r1.seq == "ACG" and got[0].r1.qual == "III" and got[0].r2.seq == "ACGTACGT"
    got = load(spark, r1=put(tmp_path / "se", fq(5)), interleaved="true").collect()
    assert len(got) == 5 and got[0].r2.seq == "" and got[0].r2.header == got[0].r1.header
    assert len(load(spark, r1=put(tmp_path / "one", fq(1)), interleaved="true").collect()) == 1


def test_errors(spark, tmp_path):
    good = put(tmp_path / "good", fq(8))
    cases = {
        "ends before the others": {"r1": good, "r2": put(tmp_path / "short", fq(7))},
        "odd number": {"r1": put(tmp_path / "odd", b"".join(render((f"c:{i // 2}", "A", "I")) for i in range(5))), "interleaved": "true"},
        "something else": {"r1": put(tmp_path / "char", fq(8).replace(b"ACGT", b"aCGT", 1))},
        "different headers": {"r1": good, "i1": put(tmp_path / "head", fq(8).replace(b"@c:3", b"@d:3"))},
        "begin with @": {"r1": put(tmp_path / "at", fq(8).replace(b"@c:5", b"c:5"))},
        "differ in length": {"r1": put(tmp_path / "len", b"@a\nAC\n+\nI\n")},
        "neither": {"r1": put(tmp_path / "what", b"hello world")},
        "shorter": {"r1": put(tmp_path / "tiny", b"")},
        "can't be opened": {"r1": str(tmp_path / "absent")},
    }
    for message, options in cases.items():
        with pytest.raises(Exception, match=message):
            load(spark, validate_on_open="false", **options).collect()
        rows = load(spark, on_error="quarantine", **options).orderBy("ordinal").collect()
        assert message in rows[-1].reason and all(r.reason is None for r in rows[:-1])
    with pytest.raises(FastqError):
        write_text(str(tmp_path / "x.lz4"), iter([]))


def test_write_and_read_back(spark, tmp_path):
    r1, i1 = put(tmp_path / "a", fq(20)), put(tmp_path / "i", fq(20, size=4))
    pairs = load(spark, r1=r1, i1=i1)
    pairs.write.format("readset").option("suffix", "fastq.gz").mode("append").save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["part-00000_I1.fastq.gz", "part-00000_R1.fastq.gz"]
    assert gzip.open(tmp_path / "out/part-00000_R1.fastq.gz").read() == fq(20)
    with pytest.raises(Exception, match="LZ4"):
        pairs.write.format("readset").option("suffix", "fastq.lz4").mode("append").save(str(tmp_path / "no"))


def test_sampling_is_the_same_in_file_and_frame(spark, tmp_path):
    r1 = put(tmp_path / "a", fq(400))
    a = {r.ordinal for r in load(spark, r1=r1, subsample_rate="0.3", seed="5").collect()}
    b = {r.ordinal for r in P.subsample(load(spark, r1=r1).repartition(3), 0.3, 5).collect()}
    assert a == b and 80 < len(a) < 160


def test_headers(spark):
    heads = ["A00419:42:H7CL3DRXX:1:1 1:N", "3:1101:1597:1000", "SLNXA:H2K:1:2", "plain", "a:+7:f:4294967296", "a: 5:f:1", "a:5:f:4294967295/1", None]
    got = spark.createDataFrame([(h,) for h in heads], "h string").select(H.header_info("h").alias("x")).collect()
    found = [tuple(r.x) if r.x else None for r in got]
    assert found == [("A00419", 42, "H7CL3DRXX", 1), ("3", 1101, "1597", 1000), None, None, None, None, ("a", 5, "f", 4294967295), None]
    assert tuple(spark.range(1).select(H.unknown_header().alias("x")).first().x) == ("unknown_instrument", 0, "unknow_flowcell", 0)


def touch(folder, *names):
    for n in names:
        p = folder / n
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"")


def test_bcl2fastq_folder(spark, tmp_path):
    touch(tmp_path, *[f"Inf_S1_L00{lane}_{r}_001.fastq.gz" for lane in (1, 2) for r in ("R1", "R2", "I1")], "sub/Other_S2_L001_R1_001.fastq", "x_S3_L001_R2_001.fastq", "notes.txt")
    touch(tmp_path, *[f"three_S4_L001_{r}_001.fastq" for r in ("R1", "R2", "R3", "I1")])
    d = M.Bcl2FastqDir(spark, str(tmp_path))
    assert d.samples() == ["Inf", "Other", "three"] and d.count() == 4 and d.contains_sample("Inf") and not d.contains_sample("x") and d.contains_lane(2) and not d.contains_lane(3)
    rows = M.Bcl2FastqDef(str(tmp_path), "Inf", (2,)).find(spark).collect()
    assert len(rows) == 1 and rows[0].i1.endswith("L002_I1_001.fastq.gz") and rows[0].i2 is None and not rows[0].r1_interleaved
    third = M.Bcl2FastqDef(str(tmp_path), "three").find(spark).first()
    assert [os.path.basename(x).split("_")[3] for x in (third.r2, third.i1, third.i2)] == ["R3", "R2", "I1"]
    moved = M.change_dir(d.groups, "/elsewhere").where("sample = 'Other'").first()
    assert moved.r1 == "/elsewhere/Other_S2_L001_R1_001.fastq" and moved.r2 is None
    with pytest.raises(M.ManifestError, match="several samples"):
        M.check_samples(spark, str(tmp_path), None, None, "help")
    assert M.check_samples(spark, str(tmp_path), ["Inf", "nope"], [1], "help") == ["Inf"]
    for requested, lanes, message in ((["nope"], None, "not found"), (["Inf"], [7], "help")):
        with pytest.raises(M.ManifestError, match=message):
            M.check_samples(spark, str(tmp_path), requested, lanes, "help")


def test_lanes_of_unsplit_files(spark, tmp_path):
    touch(tmp_path, "a_S1_R1_001.fastq", "a_S1_R2_001.fastq")
    assert not M.Bcl2FastqDir(spark, str(tmp_path)).lane_split
    with pytest.raises(Exception, match="not split"):
        M.Bcl2FastqDef(str(tmp_path), None, (1,)).find(spark).collect()
    touch(tmp_path, "a_S1_L001_R1_001.fastq")
    with pytest.raises(M.ManifestError, match="some files"):
        M.Bcl2FastqDir(spark, str(tmp_path))
    (tmp_path / "none").mkdir()
    with pytest.raises(M.ManifestError, match="help"):
        M.check_samples(spark, str(tmp_path / "none"), None, None, "help")


def test_bcl_processor_folder(spark, tmp_path):
    touch(tmp_path, *[f"read-{r}_si-{si}_lane-00{lane}-chunk-001.fastq.gz" for r in ("RA", "I1", "I2") for si in ("TCGCCATA", "GTATNCAC", "AAAAAAAA") for lane in (1, 2)], "read-I1_si-CCCCCCCC_lane-001-chunk-001.fastq")
    d = M.BclProcessorDir(spark, str(tmp_path))
    assert not d.is_empty() and d.contains_index("SI-001") and d.contains_index("AAAAAAAA") and not d.contains_index("CCCCCCCC") and d.contains_index_with_lane("220027", 2) and not d.contains_lane(3)
    assert M.BclProcessorDef(str(tmp_path), ("GTATACAC",)).find(spark).count() == 2 and M.BclProcessorDef(str(tmp_path), ("GTATACAC",), 0).find(spark).count() == 0
    named = X.group_samples(d.groups, X.index_table(spark), True).groupBy("set_name").count().collect()
    assert dict(map(tuple, named)) == {"220027": 2, "GTATNCAC": 2, "AAAAAAAA": 2}
    assert X.group_samples(d.groups, X.index_table(spark), False).count() == 2
    assert sets_in(str(tmp_path), "bcl_processor")[0]["r1_interleaved"]


def test_processor(spark, tmp_path):
    r1 = put(tmp_path / "r1", fq(30, size=26))
    rows = BarcodeUmi([{"r1": r1, "r1_interleaved": False}]).read(spark).collect()
    assert len(rows) == 30 and all((r.processed is None) == (r.reason is not None) and (r.unprocessed is None) == (r.reason is None) for r in rows)
    short = BarcodeUmi([{"r1": put(tmp_path / "s", fq(3)), "r1_interleaved": False}]).read(spark).collect()
    assert {r.reason for r in short} == {"Barcode: read1 has 8 bases, but 0 to 16 are needed"}
    pairs = load(spark, r1=r1)
    row = alignable(pairs).select("align_sequence", bam_tags({"CB": F.col("r1.seq"), "UB": F.col("r2.seq")}).alias("t")).first()
    assert row.align_sequence.read2 is None and set(row.t) == {"CB"}


def test_relations(spark, tmp_path):
    pairs = load(spark, r1=put(tmp_path / "a", fq(6)), r2=put(tmp_path / "b", fq(6)))
    assert P.deinterleave(P.interleave(pairs)).orderBy("ordinal").collect() == pairs.orderBy("ordinal").collect()
    bad = pairs.withColumn("r2", F.when(F.col("ordinal") == 2, P.record(F.lit("zz"), F.lit("AC"), F.lit("II"))).otherwise(F.col("r2")))
    assert P.validate(bad, "quarantine").where("reason is not null").select("ordinal", "reason").first() == (2, "header mismatch of r2")
    with pytest.raises(Exception, match="header mismatch"):
        P.validate(bad).collect()
    assert P.to_long(pairs).count() == 12 and pairs.where(P.is_empty()).count() == 0


def test_stream(spark, tmp_path):
    spark.dataSource.register(ReadSetSource)
    put(tmp_path / "a_S1_L001_R1_001.fastq", fq(5))
    stream = spark.readStream.format("readset").option("folder", str(tmp_path)).option("required", "R1").load()
    run = lambda: stream.writeStream.format("parquet").option("path", str(tmp_path / "out/x")).option("checkpointLocation", str(tmp_path / "out/c")).trigger(availableNow=True).start().awaitTermination(90)
    run()
    put(tmp_path / "b_S2_L001_R1_001.fastq", fq(7))
    run()
    assert spark.read.parquet(str(tmp_path / "out/x")).count() == 12


def test_stream_waits_for_late_reads(spark, tmp_path):
    """R1 alone is not a set; when R2 comes, both are read, once."""
    spark.dataSource.register(ReadSetSource)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.format("readset").option("folder", str(tmp_path / "in")).load()
    run = lambda: stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(90)
    put(tmp_path / "in" / "a_S1_L001_R1_001.fastq", fq(5))
    put(tmp_path / "in" / "b_S2_L001_R1_001.fastq", fq(3))
    put(tmp_path / "in" / "b_S2_L001_R2_001.fastq", fq(3))
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 3 and all(r.r2 is not None for r in rows)
    put(tmp_path / "in" / "a_S1_L001_R2_001.fastq", fq(5))
    run()
    run()
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(rows) == 8 and all(r.r2 is not None for r in rows) and len({(r.group_id, r.ordinal) for r in rows}) == 8


def test_batches_are_the_rows(tmp_path, monkeypatch):
    """Columnar reading against reading record by record: blocks of any size, odd ends, samples, faults."""
    from strandline.sources import fastq

    good, crlf = fq(50, " 1"), fq(50, "/2").replace(b"\n", b"\r\n")
    both = b"".join(render((f"c:{i} {k}", "ACGT", "IIII")) for i in range(25) for k in (1, 2))
    cases = [
        ({"r1": good, "r2": crlf}, False), ({"r1": good + b"\n\n", "i1": good}, False), ({"r1": both}, True), ({"r1": good}, True), ({"r1": good[:-1], "r2": fq(49)}, False),
        ({"r1": good, "r2": fq(20) + fq(30, start=21)}, False), ({"r1": both[:-18]}, True), ({"r1": good.replace(b"c:30", b"c:\xe9")}, False), ({"r1": fq(7) + b"@x\nAU\n+\nII\n" + fq(3)}, False),
    ]
    for block in (4096, 7):
        monkeypatch.setattr(fastq, "BLOCK", block)
        for k, (files, interleaved) in enumerate(cases):
            paths = {r: put(tmp_path / f"{k}{r}", x) for r, x in files.items()}
            for rate, lengths in ((1.0, {}), (0.5, {"r1": 3})):
                def drain(found, out):
                    try:
                        for x in found:
                            out.append(x)
                    except fastq.FastqError as e:
                        return str(e)

                want, batches = [], []
                fault = drain(fastq.read_pairs(fastq.ReadSet(4, paths, interleaved), lengths, rate, 1), want)
                assert drain(fastq.read_batches(fastq.ReadSet(4, paths, interleaved), lengths, rate, 1), batches) == fault
                rows = [tuple(r.values()) for b in batches for r in b.to_pylist()]
                assert [tuple(tuple(x.values()) if isinstance(x, dict) else x for x in r) for r in rows] == want


def test_definitions(spark, tmp_path):
    touch(tmp_path, "a_S1_L001_R1_001.fastq.gz", "a_S1_L001_R2_001.fastq.gz", "a_S1_L002_R1_001.fastq.gz")
    d = M.fastq_def({"bcl2fastq": {"path": str(tmp_path), "lanes": [2]}})
    assert d == M.Bcl2FastqDef(str(tmp_path), None, (2,)) and M.fastq_def(M.fastq_def_json(d)) == d and d.find(spark).count() == 1
    for bad in ("[]", '{"other": {}}', '{"bcl2fastq": {"no": 1}}'):
        with pytest.raises(M.ManifestError):
            M.fastq_def(bad)
    with pytest.raises(M.ManifestError, match="No read files"):
        M.check_samples(spark, str(tmp_path), None, [7])


def test_set_header_and_slots(spark):
    kind = "group_id long, ordinal long, header string, seq string, qual string"
    rows = spark.createDataFrame([(1, 0, "i:3:f:2:1 1:N", "A", "I"), (1, 1, "i:4:f:2:1", "A", "I"), (2, 0, "odd", "A", "I")], kind)
    pairs = P.zip_reads({"r1": rows})
    got = {r.group_id: r.header_info for r in P.read_set_header(pairs).collect()}
    assert tuple(got[1]) == ("i", 3, "f", 2) and got[2] is None
    assert tuple({r.group_id: r.header_info for r in P.read_set_header(pairs, True).collect()}[2]) == H.UNKNOWN_HEADER
    with pytest.raises(ValueError, match="no reads"):
        P.read_set_header(pairs.limit(0))
    twice = P.to_long(pairs).unionByName(P.to_long(pairs))
    with pytest.raises(Exception, match="there already"):
        P.from_long(twice).collect()


def test_fasta_and_json(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">one first read\nACGT\nAC\n>two\nGG\n")
    assert [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect()] == [("one", "first read", "ACGTAC"), ("two", "", "GG")]
    (tmp_path / "a.json").write_text('{"R1": [{"name": "x", "end": "three_prime", "location": "anywhere", "seq": "AAAAA"}], "R2": []}')
    assert [tuple(r) for r in fasta.read_adapters(spark, str(tmp_path / "a.json")).collect()] == [("R1", "x", "three_prime", "anywhere", "AAAAA")]


def test_all_sample_index_sets(spark):
    assert len(X.SETS) == 600 and all(len(v) == 4 and all(re.fullmatch("[ACGT]{8}", s) for s in v) for v in X.SETS.values())
    plates = Counter(k.rsplit("-", 1)[0] for k in X.SETS if k.count("-") == 2)
    assert plates == {"SI-3A": 96, "SI-GA": 96, "SI-P01": 96, "SI-P02": 96, "SI-P03": 96, "SI-P2": 96, "SI-T2": 8}
    table = X.index_table(spark)
    assert table.count() == 832 and table.select(F.explode("set_names").alias("s")).distinct().count() == 600
    si = X.SETS["SI-GA-A1"][0]
    assert X.group_samples(spark.createDataFrame([(si,)], "si string"), table, False).count() == 1
