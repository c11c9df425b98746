"""The operators' queries and SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser_ney
from .backoff_lm import backoff_scores
from .exact_dedup import exact_groups
from .line_dedup import with_dropped
from .minhash_dedup import near_groups
from .mixing import mixing_decisions
from .piece_dropout import encode_pieces
from .secret_scan import KINDS, find_secrets
from .token_files import token_positions, write_token_files
from .topk_search import top_k

DROPOUT, DROPOUT_SEED = 0.1, 20261
END_ID = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_groups(docs, carry=["text_sha256"], hash_col="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "carried.text_sha256")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.score(docs, kneser_ney.fit(docs, table(spark, sf_dir, "labels")))


def op2_backoff_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = backoff_scores(table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", *[F.col("n_by_order")[k].alias(f"n_order{k + 1}") for k in range(3)], F.round("log_score", 3).alias("log_score"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_lines")
    rows = with_dropped(table(spark, sf_dir, "documents"), [F.col("doc_id"), n_lines])
    n_dropped = F.when(F.col("_dropped").isNull(), 0).otherwise(F.size("_dropped")).cast("long").alias("n_dropped")
    return rows.select("doc_id", "n_lines", n_dropped, F.coalesce(F.array_join("_dropped", ","), F.lit("")).alias("dropped"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_decisions(table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file, as the installed package knows it: the path is a parameter of every operator."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op6_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), DROPOUT, DROPOUT_SEED)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), END_ID)
    return token_positions(files)


def _joined(spans: str, keep: str = "true") -> Column:
    return F.expr(f"array_join(transform(filter({spans}, x -> {keep}), x -> concat_ws(':', x.kind, x.start, x.end)), ',')")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    base = F.sha2(_joined("spans", "x.kind in ('assign', 'access', 'hex')"), 256).alias("base_sha256")
    return found.select("doc_id", *counts[:3], base, _joined("spans").alias("spans"), *counts[3:])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_backoff_lm": op2_backoff_lm,
    "op3_mixing": op3_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op5_topk_search": op5_topk_search,
    "op6_piece_dropout": op6_piece_dropout,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_near_dedup": op8_near_dedup,
    "op9_token_files": op9_token_files,
    "op10_secret_scan": op10_secret_scan,
}

SQL: dict[str, str] = {
    "op2_backoff_lm": r"""
        WITH texts AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        lists AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
        places AS (SELECT r, w[i] AS w1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS w2, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS w3,
                          CASE WHEN i > 1 THEN w[i - 1] END AS v1, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS v2
                   FROM (SELECT r, w, unnest(generate_series(1, len(w))) AS i FROM lists)),
        grams AS (SELECT r, unnest([w1, w2, w3]) AS g FROM places),
        own AS (SELECT r, g, count(*) AS n FROM grams WHERE g IS NOT NULL GROUP BY ALL),
        every AS (SELECT g, sum(n) AS n FROM own GROUP BY g),
        rest AS (SELECT r, g, every.n - own.n AS n FROM own JOIN every USING (g)),
        words AS (SELECT r, count(*) AS n_words FROM places GROUP BY r),
        total AS (SELECT sum(n_words) AS n FROM words),
        scored AS (SELECT p.r,
                          CASE WHEN c3.n > 0 THEN 3 WHEN c2.n > 0 THEN 2 ELSE 1 END AS o,
                          CASE WHEN c3.n > 0 THEN ln(c3.n / b2.n)
                               WHEN c2.n > 0 THEN ln(c2.n / b1.n) + CASE WHEN p.w3 IS NOT NULL THEN ln(0.4) ELSE 0 END
                               ELSE ln(greatest(c1.n, 1)) - ln(greatest((SELECT n FROM total) - words.n_words, 1))
                                    + CASE WHEN p.w3 IS NOT NULL THEN 2 * ln(0.4) WHEN p.w2 IS NOT NULL THEN ln(0.4) ELSE 0 END END AS s
                   FROM places p JOIN words USING (r) JOIN rest c1 ON c1.r = p.r AND c1.g = p.w1
                   LEFT JOIN rest c2 ON c2.r = p.r AND c2.g = p.w2 LEFT JOIN rest c3 ON c3.r = p.r AND c3.g = p.w3
                   LEFT JOIN rest b1 ON b1.r = p.r AND b1.g = p.v1 LEFT JOIN rest b2 ON b2.r = p.r AND b2.g = p.v2)
        SELECT doc_id, count(s) AS n_words, count(*) FILTER (o = 1) AS n_order1, count(*) FILTER (o = 2) AS n_order2, count(*) FILTER (o = 3) AS n_order3, round(coalesce(sum(s), 0), 3) AS log_score
        FROM lists LEFT JOIN scored USING (r) GROUP BY r, doc_id""",
    "op5_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.e)), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
}
