import numpy as np
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import adapters as A
from strandline.operators.readpairs import record

SEQ = "AGATCGGAAGAGCACACG"


def find(spark, adapter, reads):
    rows = spark.createDataFrame(list(enumerate(reads)), "i int, s string").select("i", A.find_adapter("s", adapter).alias("t")).orderBy("i").collect()
    return [r.t for r in rows]


def naive_homopolymer(read, a):
    m, n, best = len(a.seq), len(read), None
    if a.end == "three_prime":
        places = {"anywhere": range(n), "non_internal": range(max(0, n - m), n), "anchored": range(max(n - m, 0), max(n - m, 0) + 1)}[a.location]
        windows = [(p, min(n, p + m)) for p in places]
    else:
        places = {"anywhere": range(n), "non_internal": range(min(m, n) + 1), "anchored": range(m, min(m, n) + 1)}[a.location]
        windows = [(max(0, p - m), p) for p in places]
    for i, j in windows:
        hits, size = read[i:j].count(a.seq[0]), j - i
        if size >= 5 and (size - hits) / size <= 0.1 and (best is None or (hits, hits - size) > best[0]):
            best = ((hits, hits - size), i, j)
    return best and (best[1], best[2], best[0][0] + 2 * best[0][1])


@pytest.mark.parametrize("end", A.ENDS)
@pytest.mark.parametrize("location", A.LOCATIONS)
def test_homopolymers(spark, end, location):
    rnd = random.Random(3)
    reads = ["", "A", "AAAAA", "A" * 30] + ["".join(rnd.choices("ACG", (8, 1, 1), k=rnd.randrange(0, 40))) for _ in range(150)]
    a = A.Adapter("p", end, location, "A" * 12)
    for read, got in zip(reads, find(spark, a, reads)):
        want = naive_homopolymer(read, a)
        assert (got and (got.adapter_start, got.adapter_end, got.score)) == want, read


def test_planted(spark):
    rnd = random.Random(4)
    noise = lambda k: "".join(rnd.choices("CT", k=k))
    for end in A.ENDS:
        a = A.Adapter("x", end, "anywhere", SEQ)
        reads, want = [], []
        for k in range(60):
            body, rest = noise(40), noise(rnd.randrange(0, 20))
            planted = SEQ if k % 3 else SEQ[:9] + "T" + SEQ[10:]
            reads.append(body + planted + rest if end == "three_prime" else rest + planted + body)
            want.append(body)
        for read, body, t in zip(reads, want, find(spark, a, reads)):
            assert t is not None and abs((t.retain_end - t.retain_start) - len(body)) <= 2, (read, t)
        assert not any(find(spark, a, [noise(80) for _ in range(50)]))


def test_locations(spark):
    at = lambda end, location, read: find(spark, A.Adapter("x", end, location, SEQ), [read])[0]
    body = "CTCTTCTCCTTTCCTC"
    assert at("three_prime", "anchored", body + SEQ).trim_start == len(body) and at("three_prime", "anchored", body + SEQ + "CTCTC") is None
    assert at("three_prime", "anchored", body + SEQ[:10]) is None and at("three_prime", "non_internal", body + SEQ[:10]).trim_start == len(body)
    assert at("three_prime", "non_internal", body + SEQ + "CTCTCCTC") is None and at("three_prime", "anywhere", body + SEQ + "CTCTCCTC").trim_start == len(body)
    assert at("five_prime", "anchored", SEQ + body).trim_end == len(SEQ) and at("five_prime", "anchored", "CTCTC" + SEQ + body) is None
    assert at("five_prime", "non_internal", SEQ[8:] + body).trim_end == len(SEQ) - 8 and at("five_prime", "non_internal", "CTCTCCTC" + SEQ + body) is None
    two = body + SEQ + body + SEQ + body
    assert at("three_prime", "anywhere", two).adapter_start == len(body) and at("five_prime", "anywhere", two).adapter_start == len(body)
    assert find(spark, A.Adapter("x", "three_prime", "anywhere", SEQ), [None, ""]) == [None, None]


def test_catalog(spark):
    a, b = A.Adapter("a", "three_prime", "anywhere", SEQ), A.Adapter("b", "five_prime", "anywhere", "A" * 10)
    catalog = A.AdapterCatalog({"R1": [a, b]})
    for wrong in (lambda: catalog.add("R2", a), lambda: catalog.add("I1", b), lambda: catalog.of("i2"), lambda: A.Adapter("c", "three_prime", "anywhere", "ACGT"), lambda: A.Adapter("c", "up", "anywhere", SEQ)):
        with pytest.raises(ValueError):
            wrong()
    read = "A" * 10 + "CTCTCCTTCTCT" + SEQ
    pairs = spark.createDataFrame([(read,), ("CTCTCTCT",)], "s string").select(record(F.lit("h"), "s", "s").alias("r1"), F.lit(None).cast("struct<header:string,seq:string,qual:string>").alias("r2"))
    assert [r.r1.seq for r in catalog.trim(pairs).collect()] == ["CTCTCCTTCTCT", "CTCTCTCT"]


def planted(rng, adapter, indels, most_errors=0.08):
    """A read of some 150 bases and where the adapter stands in it: with errors, cut short by the read's end where its location allows."""
    bases = list("ACGT")
    seq = list(adapter.seq)
    if adapter.location != "anchored" and rng.random() < 0.5:
        keep = int(rng.integers(12, len(seq) + 1))
        seq = seq[:keep] if adapter.end == "three_prime" else seq[-keep:]
        whole = keep == len(adapter.seq)
    else:
        whole = True
    for _ in range(int(rng.integers(0, int(most_errors * len(seq)) + 1))):
        k, kind = int(rng.integers(3, len(seq) - 3)), rng.integers(3) if indels else 0
        if kind == 0:
            seq[k] = bases[(bases.index(seq[k]) + 1 + int(rng.integers(3))) % 4]
        elif kind == 1:
            del seq[k]
        else:
            seq.insert(k, str(rng.choice(bases)))
    body = "".join(rng.choice(bases, 100))
    behind = "".join(rng.choice(bases, int(rng.integers(0, 30)))) if whole and adapter.location == "anywhere" else ""
    if adapter.end == "three_prime":
        return body + "".join(seq) + behind, len(body), len(body) + len(seq)
    return behind + "".join(seq) + body, len(behind), len(behind) + len(seq)


@pytest.mark.parametrize("indels", [False, True])
@pytest.mark.parametrize("location", A.LOCATIONS)
@pytest.mark.parametrize("end", A.ENDS)
def test_accuracy(end, location, indels):
    """Sensitivity, precision and concordance (inner end within two bases) of planted adapters, each above 0.99."""
    rng = np.random.default_rng(A.ENDS.index(end) * 10 + A.LOCATIONS.index(location) + 100 * indels)
    found_, planted_, right, wrong = 0, 0, 0, 0
    for k in range(5):
        adapter = A.Adapter(f"a{k}", end, location, "".join(rng.choice(list("ACGT"), int(rng.integers(24, 34)))))
        cases = [planted(rng, adapter, indels) for _ in range(200)]
        none = ["".join(rng.choice(list("ACGT"), 150)) for _ in range(200)]
        got = A.align([c[0] for c in cases] + none, adapter)
        hit = got[0].astype(bool)
        planted_ += 200
        found_ += int(hit[:200].sum())
        wrong += int(hit[200:].sum())
        inner = got[1][:200] if end == "three_prime" else got[2][:200]
        want = np.array([c[1] if end == "three_prime" else c[2] for c in cases])
        right += int((hit[:200] & (np.abs(inner - want) <= 2)).sum())
    assert found_ / planted_ > 0.99 and found_ / (found_ + wrong) > 0.99 and right / found_ > 0.99, (found_, planted_, wrong, right)


def test_groups_of_alike_lengths():
    lengths = np.array([150, np.nan, 9, 150, 100_000, 0, 151, np.nan, 10] * 50, float)
    groups = list(A.alike_lengths(lengths, 30))
    assert sorted(np.concatenate(groups).tolist()) == np.flatnonzero(~np.isnan(lengths)).tolist()
    assert all(lengths[g].max() <= lengths[g].min() * 1.25 + 8 and len(g) * lengths[g].max() <= 1 << 23 for g in groups)


def test_catalog_leaves_other_columns(spark):
    pairs = spark.createDataFrame([(1, ("h", "CCCCCCCCAAAAAAAA", "I" * 16), None, 5)], "_hit0 int, r1 struct<header:string,seq:string,qual:string>, r2 struct<header:string,seq:string,qual:string>, x int")
    out = A.AdapterCatalog({"r1": [A.Adapter("p", "three_prime", "anywhere", "AAAAAAAA")]}).trim(pairs)
    row = out.first()
    assert out.columns == pairs.columns and row.r1.seq == "CCCCCCCC" and row._hit0 == 1
