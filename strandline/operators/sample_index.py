"""Sample index sets: names of four index sequences each, and file groups by set."""

from __future__ import annotations

import json
import pkgutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: All 600 sets of the plates, from the data file beside this module; other plates are read with load_sets().
SETS: dict[str, tuple[str, ...]] = {k: tuple(v) for k, v in json.loads(pkgutil.get_data(__package__, "sample_index.json")).items()}


def load_sets(path: str) -> dict[str, tuple[str, ...]]:
    """Sets from a JSON file {name: [sequences]}: the way to add plates."""
    with open(path) as f:
        return {k: tuple(v) for k, v in json.load(f).items()}


def index_table(spark: SparkSession, sets: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """si, set_name, set_names: one row per sequence. A sequence of several sets goes by the smallest name; set_names has all."""
    rows = [(si, name) for name, members in (SETS if sets is None else sets).items() for si in members]
    table = spark.createDataFrame(rows, "si string, set_name string")
    return table.groupBy("si").agg(F.min("set_name").alias("set_name"), F.sort_array(F.collect_set("set_name")).alias("set_names"))


def group_samples(groups: DataFrame, index: DataFrame, include_unrecognized: bool) -> DataFrame:
    """`groups` with set_name: the set that its si belongs to, or the si itself for others, if those are included.

    The built-in index table has 832 rows, but any table may be given, so Spark chooses the join by its size.
    """
    named = groups.join(index.select("si", "set_name"), "si", "left" if include_unrecognized else "inner")
    return named.withColumn("set_name", F.coalesce("set_name", "si"))
