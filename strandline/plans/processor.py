"""Read processing as a chain of DataFrame steps: scan, trim, sample, then the user's own columns.

A processor says which files, rates and lengths it wants and turns pairs into processed rows, best with column
expressions. Rows come out as struct `processed` or, where that is null, with the pair in `unprocessed` and a `reason`.
"""

from __future__ import annotations

import json
from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranges import ReadRange
from ..operators.readpairs import subsample
from ..schema import READS
from ..sources.fastq import ReadSetSource


class Processor(ABC):
    read_subsample_rate: float = 1.0
    barcode_subsample_rate: float = 1.0
    r1_length: int | None = None
    r2_length: int | None = None
    gem_group: int = 1

    @abstractmethod
    def read_sets(self) -> list[dict]:
        """Rows of a manifest: r1, r2, i1, i2, r1_interleaved."""

    @abstractmethod
    def process(self, pairs: DataFrame) -> tuple[Column, Column]:
        """Columns over the read pairs: the processed struct, and the reason why there is none (null if there is)."""

    def barcode(self) -> ReadRange | None:
        """Where the barcode stands, for sampling by barcode."""
        return None

    def read(self, spark: SparkSession, seed: int = 0) -> DataFrame:
        """group_id, ordinal, gem_group, processed, unprocessed, reason."""
        spark.dataSource.register(ReadSetSource)
        options = {"manifest": json.dumps(self.read_sets()), "subsample_rate": str(self.read_subsample_rate), "seed": str(seed)}
        options |= {k: str(v) for k, v in (("r1_length", self.r1_length), ("r2_length", self.r2_length)) if v is not None}
        return self.run(spark.read.format("readset").options(**options).load(), seed)

    def run(self, pairs: DataFrame, seed: int = 0) -> DataFrame:
        """The same for pairs that are there already."""
        where = self.barcode()
        if where is not None and self.barcode_subsample_rate < 1:
            pairs = subsample(pairs, self.barcode_subsample_rate, seed, where.of("seq"))
        processed, reason = self.process(pairs)
        return pairs.select(
            "group_id", "ordinal", F.lit(self.gem_group).alias("gem_group"),
            F.when(reason.isNull(), processed).alias("processed"), F.when(reason.isNotNull(), F.struct(*READS)).alias("unprocessed"), reason.alias("reason"),
        )


def alignable(pairs: DataFrame, header: Column | None = None) -> DataFrame:
    """`pairs` with the view that an aligner takes: header, both sequences and both qualities."""
    two = lambda part: F.struct(F.col(f"r1.{part}").alias("read1"), F.col(f"r2.{part}").alias("read2"))
    return pairs.withColumns({"align_header": F.col("r1.header") if header is None else header, "align_sequence": two("seq"), "align_quality": two("qual")})


def bam_tags(tags: dict[str, Column]) -> Column:
    """Tags of two letters as a map; those with null values are left out."""
    if any(len(t) != 2 for t in tags):
        raise ValueError("a tag has two letters")
    return F.map_filter(F.create_map(*[x for t, c in tags.items() for x in (F.lit(t), c)]), lambda k, v: v.isNotNull())


class BarcodeUmi(Processor):
    """Slices barcode and UMI out of R1 and refuses pairs whose R1 is too short or whose barcode holds an N."""

    def __init__(self, sets: list[dict], barcode: ReadRange | None = None, umi: ReadRange | None = None):
        self.sets, self.at, self.umi = sets, barcode or ReadRange("r1", 0, 16), umi or ReadRange("r1", 16, 10)

    def read_sets(self) -> list[dict]:
        return self.sets

    def barcode(self) -> ReadRange:
        return self.at

    def process(self, pairs: DataFrame) -> tuple[Column, Column]:
        fields = F.struct(self.at.of("seq").alias("barcode"), self.at.of("qual").alias("barcode_qual"), self.umi.of("seq").alias("umi"))
        no = F.coalesce(self.at.problem("Barcode"), self.umi.problem("UMI"), F.when(self.at.of("seq").contains("N"), F.lit("Barcode holds an N")))
        return fields, no
