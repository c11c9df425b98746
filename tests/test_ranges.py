import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import ranges as R

spans = st.builds(R.ReadRange, st.sampled_from(["r1", "r2", "i1", "i2"]), st.integers(0, 32767), st.none() | st.integers(0, 32766))


@given(spans)
def test_packing(r):
    assert R.ReadRange.unpacked(r.packed()) == r and 0 <= r.packed() < 1 << 32


@given(st.integers(0, 100), st.none() | st.integers(0, 100), st.integers(0, 100), st.none() | st.integers(0, 100))
def test_intersection(o1, n1, o2, n2):
    got = R.ReadRange("r1", o1, n1).intersect(R.ReadRange("r1", o2, n2))
    size = 400
    both = set(range(o1, o1 + n1 if n1 is not None else size)) & set(range(o2, o2 + n2 if n2 is not None else size))
    assert set(range(got.offset, got.end if got.end is not None else size)) == both


@settings(max_examples=50)
@given(st.integers(0, 50), st.integers(0, 50), st.integers(0, 50), st.sampled_from(["three_prime", "five_prime"]))
def test_trim(o, n, k, end):
    r = R.ReadRange("r2", o, n)
    if k > n:
        with pytest.raises(ValueError):
            r.trim(end, k)
        return
    got = r.trim(end, k)
    assert (got.offset, got.end) == ((o + k, o + n) if end == "five_prime" else (o, o + n - k))


def test_bounds():
    for bad in ((1 << 15, None), (0, 0x7FFF), (-1, 2)):
        with pytest.raises(ValueError):
            R.ReadRange("r1", *bad)
    with pytest.raises(ValueError):
        R.ReadRange("r1", 3).trim("three_prime", 1)
    assert R.ReadRange("r1", 3).trim("five_prime", 2) == R.ReadRange("r1", 5) and R.ReadRange("r1", 3).shrink(1, 4) == R.ReadRange("r1", 4, 3)
    with pytest.raises(ValueError):
        R.ReadRange("r1", 3, 2).shrink(1, 4)
    with pytest.raises(ValueError):
        R.ReadRange("r1", 3, 2).intersect(R.ReadRange("r2", 3, 2))
    assert sorted([R.ReadRange("r1", 1), R.ReadRange("r1", 1, 5), R.ReadRange("r2", 0), R.ReadRange("r1", 0, 9)]) == [R.ReadRange("r1", 0, 9), R.ReadRange("r1", 1, 5), R.ReadRange("r1", 1), R.ReadRange("r2", 0)]


def test_slices(spark):
    cases = [("ACGTA", 1, 3, "CGT"), ("ACGTA", 2, None, "GTA"), ("ACGTA", 5, None, ""), ("ACGTA", 6, None, None), ("ACGTA", 3, 3, None), ("ACGTA", 0, 0, ""), (None, 0, 0, None)]
    rows = spark.createDataFrame([c[:3] for c in cases], "s string, o int, n int")
    assert [r[0] for r in rows.select(R.slice_column("s", F.col("o"), F.col("n"))).collect()] == [c[3] for c in cases]


def test_half_open(spark):
    rows = spark.createDataFrame([(0, 20, 50, 100), (0, 20, 5, 10), (5, 10, 0, 7)], "a int, b int, c int, d int")
    got = rows.select(*R.intersect_half_open(*map(F.col, "abcd"))).collect()
    assert [tuple(r) for r in got] == [(20, 20), (5, 10), (5, 7)]


def test_column_guards(spark):
    rows = spark.createDataFrame([(3, 2)], "o int, n int")
    for pair in (R.shrink_columns("o", "n", F.lit(1), F.lit(4)), R.trim_columns("o", "n", "five_prime", 3), R.trim_columns("o", F.lit(None).cast("int"), "three_prime", 1)):
        with pytest.raises(Exception, match="range"):
            rows.select(*pair).collect()
