"""Run information from read headers and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the naming conventions of the two file layouts, and the values that stand for unknown run information
BCL2FASTQ_LANES = r"^([\w_-]+)_S(\d+)_L(\d+)_([RI][A123])_(\d+).fastq(\.gz|\.lz4)?\z"
BCL2FASTQ_NO_LANES = r"^([\w_-]+)_S(\d+)_([RI][A123])_(\d+).fastq(\.gz|\.lz4)?\z"
BCL_PROCESSOR = r"^read-([RI][A0-9])_si-([^_]+)_lane-([0-9]+)-chunk-([0-9]+).fastq(\.gz|\.lz4)?\z"
UNKNOWN_HEADER = ("unknown_instrument", 0, "unknow_flowcell", 0)

_UNSIGNED = r"^\+?[0-9]+\z"


def header_prefix(header: Column | str) -> Column:
    """A header up to its first space or slash: equal for the reads of one cluster."""
    return F.regexp_extract(F.col(header) if isinstance(header, str) else header, r"^[^ /]*", 0)


def _u32(s: Column) -> Column:
    """The number, if it is one from 0 to 4294967295 without blanks."""
    value = F.when(s.rlike(_UNSIGNED), s.try_cast("decimal(38,0)"))
    return F.when(value <= 4294967295, value.cast("long"))


def header_info(header: Column | str) -> Column:
    """struct(instrument, run_number, flowcell, lane), or null if the header has too few parts or no numbers in their place."""
    parts = F.split(header_prefix(header), ":")
    at = lambda i: F.get(parts, F.lit(i))
    run, lane = _u32(at(1)), _u32(at(3))
    return F.when((F.size(parts) >= 4) & run.isNotNull() & lane.isNotNull(), F.struct(at(0).alias("instrument"), run.alias("run_number"), at(2).alias("flowcell"), lane.alias("lane")))


def unknown_header() -> Column:
    instrument, run, flowcell, lane = UNKNOWN_HEADER
    return F.struct(F.lit(instrument).alias("instrument"), F.lit(run).cast("long").alias("run_number"), F.lit(flowcell).alias("flowcell"), F.lit(lane).cast("long").alias("lane"))


def basename(path: Column | str) -> Column:
    return F.substring_index(F.col(path) if isinstance(path, str) else path, "/", -1)


def bcl2fastq_name(path: Column | str) -> Column:
    """struct(sample, s, lane, read, chunk) of a file name, lane null without lane splitting; null for other names."""
    name = basename(path)
    lanes, plain = name.rlike(BCL2FASTQ_LANES), name.rlike(BCL2FASTQ_NO_LANES)
    part = lambda a, b: F.when(lanes, F.regexp_extract(name, BCL2FASTQ_LANES, a)).when(plain, F.regexp_extract(name, BCL2FASTQ_NO_LANES, b))
    lane = F.when(lanes, F.regexp_extract(name, BCL2FASTQ_LANES, 3).cast("int"))
    return F.when(lanes | plain, F.struct(part(1, 1).alias("sample"), part(2, 2).cast("int").alias("s"), lane.alias("lane"), part(4, 3).alias("read"), part(5, 4).cast("int").alias("chunk")))


def bcl_processor_name(path: Column | str) -> Column:
    """struct(si, lane, read, chunk) of a file name; null for other names."""
    name = basename(path)
    part = lambda i: F.regexp_extract(name, BCL_PROCESSOR, i)
    return F.when(name.rlike(BCL_PROCESSOR), F.struct(part(2).alias("si"), part(3).cast("int").alias("lane"), part(1).alias("read"), part(4).cast("int").alias("chunk")))
