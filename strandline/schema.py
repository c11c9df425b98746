"""Schemas of the data model: records, read pairs, ranges, manifests, adapters and trim results.

A read pair is one row of up to four record structs: an absent read is a null struct, a present but empty one holds ''.
"""

from __future__ import annotations

from pyspark.sql import types as T

READS = ("r1", "r2", "i1", "i2")
READ_NAMES = {"r1": "read1", "r2": "read2", "i1": "index1", "i2": "index2"}

RECORD = T.StructType([T.StructField("header", T.StringType()), T.StructField("seq", T.StringType()), T.StructField("qual", T.StringType())])
READ_PAIR = T.StructType([T.StructField("group_id", T.LongType()), T.StructField("ordinal", T.LongType()), *[T.StructField(r, RECORD) for r in READS]])
MANIFEST = T.StructType([*[T.StructField(r, T.StringType()) for r in READS], T.StructField("r1_interleaved", T.BooleanType())])
RANGE = T.StructType([T.StructField("read", T.StringType()), T.StructField("offset", T.IntegerType()), T.StructField("len", T.IntegerType())])
HEADER_INFO = T.StructType([T.StructField("instrument", T.StringType()), T.StructField("run_number", T.LongType()), T.StructField("flowcell", T.StringType()), T.StructField("lane", T.LongType())])
ADAPTER = T.StructType([T.StructField("name", T.StringType()), T.StructField("end", T.StringType()), T.StructField("location", T.StringType()), T.StructField("seq", T.StringType())])
TRIM_RESULT = T.StructType([T.StructField(f"{a}_{b}", T.IntegerType()) for a in ("adapter", "trim", "retain") for b in ("start", "end")] + [T.StructField("score", T.IntegerType())])
#: Of a processing step: exactly one of `processed` and `reason` is not null.
REASON = T.StructField("reason", T.StringType())


def which_read(name: str) -> str:
    """'R1', 'r1', 'read1' or 0..3 as a read's column name."""
    if isinstance(name, int):
        if not 0 <= name < 4:
            raise ValueError(f"no read has the number {name}")
        return READS[name]
    key = name.lower()
    key = {v: k for k, v in READ_NAMES.items()}.get(key, key)
    if key not in READS:
        raise ValueError(f"not a read: {name!r}")
    return key
