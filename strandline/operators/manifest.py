"""File groups: from a table of paths to a manifest of read sets, by declarative filters and one aggregation."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import basename, bcl2fastq_name, bcl_processor_name
from ..functions.sequences import matches_with_n
from ..schema import READS

KEYS = {"bcl2fastq": ("sample", "s", "lane", "chunk"), "bcl_processor": ("si", "lane", "chunk")}


class ManifestError(ValueError):
    """A directory or a request that the file groups can't satisfy."""


def list_files(spark: SparkSession, path: str, subdirectories: bool) -> DataFrame:
    """path of each file in a folder and, if asked for, in its immediate subfolders, in any store that Spark reads."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for entry in store.listStatus(folder):
        if entry.isFile():
            found.append(entry.getPath().toString())
        elif subdirectories:
            found += [x.getPath().toString() for x in store.listStatus(entry.getPath()) if x.isFile()]
    return spark.createDataFrame([(re.sub("^file:/*", "/", x),) for x in found], "path string")


def _order(path: Column) -> Column:
    """Paths compare by component."""
    return F.split(path, "/")


def group_bcl2fastq(files: DataFrame) -> DataFrame:
    """sample, s, lane, chunk, r1, r2, i1, i2, r1_interleaved of a table of paths.

    The last path of a read wins. With an R3, the second read is R3 and R2 and I1 are the indices. Groups without R1 are left out.
    """
    rows = files.select("path", bcl2fastq_name("path").alias("f")).where("f is not null").select("path", "f.*")
    last = lambda read: F.max_by(F.when(F.col("read") == read, F.col("path")), F.when(F.col("read") == read, _order(F.col("path")))).alias(read.lower())
    sets = rows.groupBy(*KEYS["bcl2fastq"]).agg(*[last(r) for r in ("R1", "R2", "R3", "I1", "I2")]).where("r1 is not null")
    third = F.col("r3").isNotNull()
    pick = lambda with_third, without: F.when(third, F.col(with_third)).otherwise(F.col(without))
    return sets.select(*KEYS["bcl2fastq"], "r1", pick("r3", "r2").alias("r2"), pick("r2", "i1").alias("i1"), pick("i1", "i2").alias("i2"), F.lit(False).alias("r1_interleaved"))


def group_bcl_processor(files: DataFrame) -> DataFrame:
    """si, lane, chunk, r1, r2, i1, i2, r1_interleaved: the first path of a read wins, RA is needed and holds both reads."""
    rows = files.select("path", bcl_processor_name("path").alias("f")).where("f is not null").select("path", "f.*")
    first = lambda read: F.min_by(F.when(F.col("read") == read, F.col("path")), F.when(F.col("read") == read, _order(F.col("path"))))
    sets = rows.groupBy(*KEYS["bcl_processor"]).agg(first("RA").alias("r1"), first("I1").alias("i1"), first("I2").alias("i2")).where("r1 is not null")
    return sets.select(*KEYS["bcl_processor"], "r1", F.lit(None).cast("string").alias("r2"), "i1", "i2", F.lit(True).alias("r1_interleaved"))


def lane_ok(lanes: list[int] | None) -> Column:
    """The lane is asked for; an error if lanes are and the file has none."""
    if lanes is None:
        return F.lit(True)
    missing = F.raise_error(F.lit("lanes were asked for, but files are not split by lane")).cast("boolean")
    return F.when(F.col("lane").isNull(), missing).otherwise(F.col("lane").isin([int(x) for x in lanes]))


def sample_ok(names: list[str] | str | None) -> Column:
    names = [names] if isinstance(names, str) else names
    return F.lit(True) if names is None else F.col("sample").isin(list(names))


def index_ok(indices: list[str] | str | None, max_ns: int = 1) -> Column:
    """Some index asked for matches the file's, N standing for any base up to max_ns times."""
    indices = [indices] if isinstance(indices, str) else indices
    if indices is None:
        return F.lit(True)
    return F.exists(F.array(*[F.lit(x) for x in indices]).cast("array<string>"), lambda t: matches_with_n(t, F.col("si"), max_ns))


def _selected(groups: DataFrame, first: Column, lanes: list[int] | None, keys: tuple) -> DataFrame:
    # the lane test may raise, so it must not run before the other one
    return groups.where(F.when(first, lane_ok(lanes)).otherwise(F.lit(False))).orderBy(*keys, *READS, "r1_interleaved")


@dataclass(frozen=True)
class Bcl2FastqDef:
    """A folder in the layout of sample names; names and lanes None: any."""

    path: str
    samples: tuple[str, ...] | str | None = None
    lanes: tuple[int, ...] | None = None

    def select(self, groups: DataFrame) -> DataFrame:
        names = self.samples if self.samples is None or isinstance(self.samples, str) else list(self.samples)
        return _selected(groups, sample_ok(names), None if self.lanes is None else list(self.lanes), KEYS["bcl2fastq"])

    def of_files(self, files: DataFrame) -> DataFrame:
        """The read sets among a table of paths."""
        return self.select(group_bcl2fastq(files))

    def groups(self, spark: SparkSession) -> DataFrame:
        return group_bcl2fastq(list_files(spark, self.path, True))

    def find(self, spark: SparkSession) -> DataFrame:
        return self.select(self.groups(spark))


@dataclass(frozen=True)
class BclProcessorDef:
    """A folder in the layout of sample indices; indices and lanes None: any."""

    path: str
    indices: tuple[str, ...] | str | None = None
    max_ns: int = 1
    lanes: tuple[int, ...] | None = None

    def select(self, groups: DataFrame) -> DataFrame:
        indices = self.indices if self.indices is None or isinstance(self.indices, str) else list(self.indices)
        return _selected(groups, index_ok(indices, self.max_ns), None if self.lanes is None else list(self.lanes), KEYS["bcl_processor"])

    def of_files(self, files: DataFrame) -> DataFrame:
        """The read sets among a table of paths."""
        return self.select(group_bcl_processor(files))

    def groups(self, spark: SparkSession) -> DataFrame:
        return group_bcl_processor(list_files(spark, self.path, False))

    def find(self, spark: SparkSession) -> DataFrame:
        return self.select(self.groups(spark))


FastqDef = Bcl2FastqDef | BclProcessorDef
LAYOUTS = {"bcl2fastq": Bcl2FastqDef, "bcl_processor": BclProcessorDef}


def fastq_def(spec: str | dict) -> FastqDef:
    """A definition from JSON: {layout: {field: value, ...}}, layout bcl2fastq or bcl_processor, fields as in its class."""
    spec = json.loads(spec) if isinstance(spec, str) else spec
    if not isinstance(spec, dict) or len(spec) != 1 or next(iter(spec)) not in LAYOUTS:
        raise ManifestError(f"a definition has one of the keys {', '.join(LAYOUTS)}")
    ((layout, fields),) = spec.items()
    try:
        return LAYOUTS[layout](**{k: tuple(v) if isinstance(v, list) else v for k, v in fields.items()})
    except TypeError as e:
        raise ManifestError(f"{layout}: {e}") from e


def fastq_def_json(definition: FastqDef) -> str:
    layout = next(k for k, c in LAYOUTS.items() if isinstance(definition, c))
    return json.dumps({layout: asdict(definition)})


def lane_mode(lane: Column | str = "lane") -> Column:
    """How a group was made: 'lane N', or 'all lanes' where files are not split by lane."""
    c = F.col(lane) if isinstance(lane, str) else lane
    return F.when(c.isNull(), F.lit("all lanes")).otherwise(F.concat(F.lit("lane "), c.cast("string")))


def lane_modes(groups: DataFrame, *keys: str) -> DataFrame:
    """Per key: n_split, n_whole (groups with and without a lane) and mixed."""
    split = F.count("lane")
    return groups.groupBy(*keys).agg(split.alias("n_split"), (F.count(F.lit(1)) - split).alias("n_whole")).withColumn("mixed", (F.col("n_split") > 0) & (F.col("n_whole") > 0))


def contained_indices(groups: DataFrame, wanted: DataFrame, table: DataFrame) -> DataFrame:
    """For each row of `wanted` (index: a sequence or a set's name): index, n_groups that have it. `table` has set_name and si."""
    own = wanted.select("index", F.col("index").alias("si")).unionByName(wanted.join(table, F.col("index") == F.col("set_name")).select("index", "si"))
    sizes = groups.groupBy("si").agg(F.count(F.lit(1)).alias("n"))
    return own.distinct().join(sizes, "si", "left").groupBy("index").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_groups"))


def usable_samples(groups: DataFrame, requested: list[str] | None = None, lanes: list[int] | None = None) -> DataFrame:
    """sample, n_groups of those asked for (or all) that have files in the lanes asked for."""
    rows = groups.where(F.when(sample_ok(requested), lane_ok(lanes)).otherwise(F.lit(False)))
    return rows.groupBy("sample").agg(F.count(F.lit(1)).alias("n_groups"))


def change_dir(manifest: DataFrame, folder: str) -> DataFrame:
    """The manifest with each path's file name in another folder."""
    return manifest.withColumns({r: F.when(F.col(r).isNotNull(), F.concat(F.lit(folder.rstrip("/") + "/"), basename(r))) for r in READS})


def only_one_lane_mode(groups: DataFrame) -> bool:
    """Whether the files are split by lane (True for none); an error for a mixture."""
    modes = [r[0] for r in groups.select(F.col("lane").isNotNull()).distinct().collect()]
    if len(modes) > 1:
        raise ManifestError("some files are split by lane and some are not")
    return modes[0] if modes else True


class Bcl2FastqDir:
    """What a folder in the layout of sample names holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self.groups = path, Bcl2FastqDef(path).groups(spark)
        self.lane_split = only_one_lane_mode(self.groups)

    def count(self) -> int:
        return self.groups.count()

    def is_empty(self) -> bool:
        return self.groups.isEmpty()

    def samples(self) -> list[str]:
        return sorted(r[0] for r in self.groups.select("sample").distinct().collect())

    def contains_sample(self, name: str) -> bool:
        return not self.groups.where(F.col("sample") == name).isEmpty()

    def contains_lane(self, lane: int) -> bool:
        if not self.lane_split:
            raise ManifestError("files are not split by lane")
        return not self.groups.where(F.col("lane") == lane).isEmpty()

    def data(self, samples=None, lanes=None) -> DataFrame:
        return Bcl2FastqDef(self.path, samples, lanes).select(self.groups)


class BclProcessorDir:
    """What a folder in the layout of sample indices holds; an index may be a sequence or the name of a set."""

    def __init__(self, spark: SparkSession, path: str, index_sets: dict[str, tuple[str, ...]] | None = None):
        from .sample_index import SETS

        self.groups, self.sets = BclProcessorDef(path).groups(spark), SETS if index_sets is None else index_sets

    def _of(self, index: str) -> DataFrame:
        return self.groups.where(F.col("si").isin(list(self.sets.get(index, (index,)))))

    def is_empty(self) -> bool:
        return self.groups.isEmpty()

    def contains_index(self, index: str) -> bool:
        return not self._of(index).isEmpty()

    def contains_lane(self, lane: int) -> bool:
        return not self.groups.where(F.col("lane") == lane).isEmpty()

    def contains_index_with_lane(self, index: str, lane: int) -> bool:
        return not self._of(index).where(F.col("lane") == lane).isEmpty()


NO_FILES = """No read files were found for this request. Check that
 - the sample names are spelt as in the sample sheet,
 - file names follow the convention, such as Sample_S1_L001_R1_001.fastq.gz with its R2,
 - the folder is the one that holds the files, or its parent.
"""


def check_samples(spark: SparkSession, path: str, requested: list[str] | None = None, lanes: list[int] | None = None, help_text: str = NO_FILES) -> list[str]:
    """The samples to use: those asked for that are there, or the only one; ManifestError if none is left, or none asked for of several."""
    folder = Bcl2FastqDir(spark, path)
    available = folder.samples()
    if not available:
        raise ManifestError(help_text)
    if requested is None and len(available) > 1:
        raise ManifestError("several samples are here, and one must be named. Available samples:\n" + "\n".join(available))
    names = available if requested is None else [x for x in dict.fromkeys(requested) if x in available]
    if not names:
        raise ManifestError(f"requested samples not found in {path}. Available samples:\n" + "\n".join(available))
    if folder.data(tuple(names), None if lanes is None else tuple(lanes)).isEmpty():
        raise ManifestError(help_text)
    return sorted(names)
