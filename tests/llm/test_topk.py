import math

import numpy as np
from pyspark.sql import functions as F

from strandline.llm import topk_search

from ..conftest import SMALL


def brute(rows, every, k=5):
    out = []
    whole = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    for a, (i, q) in enumerate(whole):
        if i is not None and i % every == 0:
            scores = [(-int(q @ v), j is None, j or 0) for b, (j, v) in enumerate(whole) if b != a and len(v) == len(q)]
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def run(frame, every):
    return sorted((tuple(r) for r in topk_search.top_k(frame, F.col("vec_id") % every == 0).collect()), key=str)


def test_table(spark, monkeypatch):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    assert run(vectors, 50) == brute(rows, 50)
    assert topk_search.top_k(vectors, F.col("vec_id") % 50 == 0).select("score").count() == 5 * sum(i % 50 == 0 for i, _ in rows)
    monkeypatch.setattr(topk_search, "SLICE", 90)
    monkeypatch.setattr(topk_search, "GROUP", 3)
    assert run(vectors, 50) == brute(rows, 50)


def test_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (0, [0.1, -0.2]), (None, [0.9, 0.9]), (4, None), (5, []), (6, [nan, 1.0]), (7, [1.0, inf]), (8, [None, 1.0]), (10, [0.1, 0.2, 0.3]), (12, [0.001, -0.001])]
    frame = spark.createDataFrame([(*r, 3, "x") for r in rows], "vec_id long, embedding array<float>, score int, row string")
    assert run(frame, 2) == brute([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], 2)
    assert run(frame.limit(0), 2) == []


def test_large_components(spark):
    """Components far beyond 2**24 after scaling: exact scores, no error, beside ordinary vectors."""
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 6)]) for i in range(60)] + [(100, [70000.0] * 6), (101, [-70001.5] + [3.25] * 5), (102, [1e9, -1e9, 1e9, 1.0, 0.5, 2.0]), (104, [1e9, 1e9, 1e9, 1.0, 0.5, 2.0])]
    held = lambda s: max(min(s, (1 << 63) - 1), -(1 << 63))
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    want = []
    for i, q in whole:
        if i % 2 == 0:
            scores = sorted((-held(sum(a * b for a, b in zip(q, v))), j) for j, v in whole if j != i)[:5]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run(frame, 2) == sorted(want, key=str)


def test_bounds_from_the_first_slice(spark, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 12)]) for i in range(500)]  # many ties
    monkeypatch.setattr(topk_search, "SLICE", 40)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run(frame, 20) == brute(rows, 20)
