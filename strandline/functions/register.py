"""SQL names: after register(spark), Spark SQL can call the functions on sequences, ranges, headers and file names."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .headers import BCL2FASTQ_LANES, BCL_PROCESSOR
from .sequences import CONTENTS, QUAL_OFFSET

_N = "[Nn]"

#: name -> (arguments, result, body): SQL functions, which the optimizer inlines.
FUNCTIONS = {
    "seq_is_valid": ("s STRING", "BOOLEAN", f"s RLIKE r'{CONTENTS['sequence'][0]}'"),
    "qual_is_valid": ("q STRING", "BOOLEAN", f"q RLIKE r'{CONTENTS['quality'][0]}'"),
    "seq_has_n": ("s STRING", "BOOLEAN", f"s RLIKE '{_N}'"),
    "seq_is_homopolymer": ("s STRING", "BOOLEAN", "CASE WHEN length(s) > 0 THEN s = repeat(substr(s, 1, 1), length(s)) END"),
    "seq_polyt_suffix": ("s STRING, n INT", "BOOLEAN", "endswith(s, repeat('T', n))"),
    "seq_encode_2bit": ("s STRING", "BIGINT", "CASE WHEN s = '' THEN 0 WHEN s RLIKE r'^[ACGT]{1,16}\\z' THEN cast(conv(translate(s, 'ACGT', '0123'), 4, 10) AS BIGINT) WHEN s IS NOT NULL THEN cast(raise_error('2-bit code: at most 16 bases of A, C, G and T') AS BIGINT) END"),
    "seq_slice": ("s STRING, o INT, n INT", "STRING", "CASE WHEN o + coalesce(n, 0) <= length(s) THEN substr(s, o + 1, coalesce(n, length(s) - o)) END"),
    "seq_matches_with_n": ("t STRING, o STRING, n INT", "BOOLEAN", "length(t) = length(o) AND forall(zip_with(split(t, ''), split(o, ''), (a, b) -> b = 'N' OR a = b), x -> x) AND length(o) - length(translate(o, 'N', '')) <= n"),
    "qual_mean": ("q STRING", "DOUBLE", f"CASE WHEN length(q) > 0 THEN aggregate(transform(split(q, ''), c -> ascii(c) - {QUAL_OFFSET}), 0, (a, x) -> a + x) / length(q) END"),
    "header_prefix": ("h STRING", "STRING", "regexp_extract(h, '^[^ /]*', 0)"),
    "fastq_sample": ("p STRING", "STRING", f"nullif(regexp_extract(substring_index(p, '/', -1), r'{BCL2FASTQ_LANES}', 1), '')"),
    "fastq_sample_index": ("p STRING", "STRING", f"nullif(regexp_extract(substring_index(p, '/', -1), r'{BCL_PROCESSOR}', 2), '')"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (args, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
