"""Each registered query of the subpackage, over a whole table, against SQL or a version of its own; the pipeline with awkward rows."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.llm import line_dedup, piece_dropout
from strandline.llm.queries import DROPOUT, DROPOUT_SEED, QUERIES, SQL

from .conftest import AWKWARD, SMALL
from .test_dedup import brute_near
from .test_text import brute_base, brute_tokens, naive_pieces


def rows_of(spark, name, folder=SMALL):
    return QUERIES[name](spark, folder).collect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(SMALL):
        db.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    frame = QUERIES[name](spark, SMALL)
    columns = sorted(frame.columns)
    result = db.sql(SQL[name])
    assert sorted(result.columns) == columns
    want = sorted(repr(tuple(dict(zip(result.columns, r))[c] for c in columns)) for r in result.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect()) == want


def test_op4(spark, documents, texts):
    got = {r.doc_id: r for r in rows_of(spark, "op4_line_dedup")}
    gone = {}
    for r in line_dedup.line_groups(documents).where("not kept").collect():
        gone.setdefault(r.doc_id, []).append(r.line_no)
    assert got.keys() == texts.keys() and len(gone) > 5
    for i, t in texts.items():
        drops = sorted(gone.get(i, []))
        assert (got[i].n_lines, got[i].n_dropped, got[i].dropped) == (len((t or "").split("\n")), len(drops), ",".join(map(str, drops)))


def test_op8(spark, texts):
    sets, comp = brute_near(texts.items())
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows_of(spark, "op8_near_dedup")} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in texts}


def test_op9(spark, texts):
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows_of(spark, "op9_token_files"))
    assert got == brute_tokens(sorted(texts.items()))


def test_op10(spark, texts):
    for r in rows_of(spark, "op10_secret_scan"):
        base = brute_base(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[0] == k for x in base) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
        spans = [x.split(":") for x in r.spans.split(",") if x]
        assert [(k, int(s), int(e)) for k, s, e in spans if k in ("assign", "access", "hex")] == base
        assert [int(s) for _, s, _ in spans] == sorted(int(s) for _, s, _ in spans) and len(spans) == r.n_assign + r.n_access + r.n_hex + r.n_identifier + r.n_secret + r.n_endpoint


def test_op1_op3_op6(spark, texts):
    quality = rows_of(spark, "op1_quality_classifier")
    assert {r.doc_id for r in quality} == texts.keys() and all(r.kept == (r.perplexity <= r.threshold) and r.n_symbols == len((texts[r.doc_id] or "").encode()) for r in quality)
    mixed = rows_of(spark, "op3_mixing")
    assert {r.doc_id for r in mixed} == texts.keys() and 0 < sum(r.sampled for r in mixed) < len(mixed)
    assert all(r.n_tokens == len((texts[r.doc_id] or "").split()) for r in mixed if (texts[r.doc_id] or "").isascii())
    pieces = {r.doc_id: r for r in rows_of(spark, "op6_piece_dropout")}
    assert pieces.keys() == texts.keys() and all(r.lossless for r in pieces.values())
    for i in sorted(texts, key=lambda i: len(texts[i] or ""))[:20]:
        assert pieces[i].ids == naive_pieces(texts[i] or "", i, DROPOUT_SEED, DROPOUT)


def test_pipeline_awkward(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names: the stages' defined results; empty tables."""
    import corpus_pipeline

    words = "one two three and four words of text to learn from every day of the week"
    rows = [(i, t, "en", "s", 7, "b", 1, 2) for i, t in AWKWARD] + [(20 + i, f"{words} {i} " * 4, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", 7, "b", 1, 2) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, kept int, bucket string, _id int, id long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(20 + i, 1, 0) for i in range(40)] + [(None, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        sizes.append(docs.count())
    assert sizes[0] > 60 and sizes == sorted(sizes, reverse=True)
    kept = [r.text or "" for r in spark.read.parquet(str(tmp_path / "stage1")).collect()]
    assert len(kept) == len(set(kept))
    final = corpus_pipeline.run(spark, str(tmp_path))
    left = {r.doc_id: r.text for r in docs.collect()}
    assert {r.doc_id for r in final.collect()} == left.keys() and all(r.lossless for r in final.collect())
    back = piece_dropout.decode_pieces(final, corpus_pipeline.tokenizer_file("piece_bpe_32k.model")).collect()
    assert {r.doc_id: r.text for r in back} == {i: t or "" for i, t in left.items()}
    empty = str(tmp_path / "empty")
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).collect() == []
