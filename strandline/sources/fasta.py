"""FASTA files as a table of id and seq, and back; adapters and chemistries from JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ADAPTER


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id (the header up to its first space), description, seq (line ends removed); records are split by the reader itself."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"^>|\r", "").alias("value")).where("value <> ''")
    head = F.substring_index("value", "\n", 1)
    return rows.select(
        F.substring_index(head, " ", 1).alias("id"), F.regexp_extract(head, r"^\S* (.*)$", 1).alias("description"),
        F.regexp_replace(F.when(F.contains("value", F.lit("\n")), F.expr("substr(value, instr(value, '\n') + 1)")).otherwise(""), "\n", "").alias("seq"),
    )


def write_fasta(rows: DataFrame, path: str) -> None:
    rows.select(F.concat(F.lit(">"), "id", F.lit("\n"), "seq").alias("value")).write.text(path)


def read_adapters(spark: SparkSession, path: str) -> DataFrame:
    """read, name, end, location, seq of a JSON file {read: [adapter, ...]}."""
    item = f"array<{ADAPTER.simpleString()}>"
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{item}>")).alias("read", "adapters"))
    return rows.select("read", F.inline("adapters"))


_PARTS = ("barcode", "umi", "rna", "rna2", "si")
CHEMISTRY = ", ".join(
    ["name string", "description string", *[f"{p}_read_{f}" for p in ("barcode", "umi", "rna", "si") for f in ("type string", "offset int", "length int")], *[f"rna_read2_{f}" for f in ("type string", "offset int", "length int")],
     "strandedness string", "endedness string", "read_type_to_bcl_processor_filename map<string,string>", "read_type_to_bcl2fastq_filename map<string,string>", "barcode_whitelist string"]
)


def read_chemistry(spark: SparkSession, path: str) -> DataFrame:
    """A chemistry as one typed row; fields that the file lacks are null."""
    return spark.read.schema(CHEMISTRY).json(path, multiLine=True)


def chemistry_range(part: str) -> Column:
    """The range of a part (barcode, umi, rna, rna2 or si) in a chemistry's row: read, offset, len (null: open)."""
    if part not in _PARTS:
        raise ValueError(f"not a part: {part!r}")
    field = "rna_read2" if part == "rna2" else f"{part}_read"
    return F.when(F.col(f"{field}_type").isNotNull(), F.struct(F.lower(f"{field}_type").alias("read"), F.col(f"{field}_offset").alias("offset"), F.col(f"{field}_length").alias("len")))
