"""Read sets that arrive in a folder as a stream: each batch reads the sets that have become complete.

    spark.readStream.format("readset").option("folder", ...).option("layout", "bcl2fastq").load()

A set is complete when all its `required` reads are there: the option's reads, by default R1 and R2 (RA in the layout of
sample indices). Index reads that a run has must be named too, or a set may be read before they come. Files must
be moved into the folder when they are whole. A set's place in the order of arrival is the latest change time among
its required files, then its key; the offset is the last place that was read, so it has the same size however many sets have
come. A file that is touched again makes its set arrive again. Pairs within a set are checked as in a batch scan.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

from pyspark.sql.datasource import DataSourceStreamReader

from ..functions.headers import BCL2FASTQ_LANES, BCL2FASTQ_NO_LANES, BCL_PROCESSOR

_PYTHON = {k: re.compile(v.replace(r"\z", r"\Z")) for k, v in (("lanes", BCL2FASTQ_LANES), ("plain", BCL2FASTQ_NO_LANES), ("processor", BCL_PROCESSOR))}


def parse_name(name: str, layout: str) -> tuple[tuple, str] | None:
    """Key of the set and read of a file name, or None."""
    if layout == "bcl_processor":
        if m := _PYTHON["processor"].match(name):
            return (m[2], int(m[3]), int(m[4])), m[1]
    elif m := _PYTHON["lanes"].match(name):
        return (m[1], int(m[2]), int(m[3]), int(m[5])), m[4]
    elif m := _PYTHON["plain"].match(name):
        return (m[1], int(m[2]), -1, int(m[4])), m[3]
    return None


REQUIRED = {"bcl2fastq": "R1,R2", "bcl_processor": "RA"}


def sets_in(folder: str, layout: str, required: str | None = None) -> list[dict]:
    """The complete sets in their order of arrival: place (nanoseconds, key) and a manifest row's fields."""
    found: dict[tuple, dict] = {}
    with os.scandir(folder) as entries:
        for entry in sorted(entries, key=lambda x: x.name):
            if parsed := parse_name(entry.name, layout):
                found.setdefault(parsed[0], {})[parsed[1]] = (entry.path, entry.stat().st_ctime_ns)
    needed, out = (required or REQUIRED[layout]).split(","), []
    for key, files in found.items():
        if any(r not in files for r in needed) or ("RA" if layout == "bcl_processor" else "R1") not in files:
            continue
        path = {r: p for r, (p, _) in files.items()}
        if layout == "bcl_processor":
            row = {"r1": path["RA"], "r2": None, "i1": path.get("I1"), "i2": path.get("I2"), "r1_interleaved": True}
        else:
            rest = [path.get(r) for r in (("R3", "R2", "I1") if "R3" in path else ("R2", "I1", "I2"))]
            row = {"r1": path["R1"], "r2": rest[0], "i1": rest[1], "i2": rest[2], "r1_interleaved": False}
        out.append(row | {"place": (max(files[r][1] for r in needed), "/".join(map(str, key)))})
    return sorted(out, key=lambda x: x["place"])


class ArrivingSets(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options, self.folder, self.layout = options, options["folder"], options.get("layout", "bcl2fastq")
        self.required = options.get("required")

    def initialOffset(self) -> dict:
        return {"at": 0, "key": ""}

    def latestOffset(self) -> dict:
        sets = sets_in(self.folder, self.layout, self.required)
        return {"at": sets[-1]["place"][0], "key": sets[-1]["place"][1]} if sets else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list:
        from ..sources.fastq import ReadSet

        low, high = ((x["at"], x["key"]) for x in (start, end))
        number = lambda x: int.from_bytes(hashlib.blake2b(repr(x).encode(), digest_size=8).digest(), "little") >> 1
        return [ReadSet(number(s["place"]), s, s["r1_interleaved"]) for s in sets_in(self.folder, self.layout, self.required) if low < s["place"] <= high]

    def read(self, partition) -> Iterator:
        from ..sources.fastq import read_batches

        lengths = {r: int(self.options[f"{r}_length"]) for r in ("r1", "r2") if f"{r}_length" in self.options}
        return read_batches(partition, lengths, float(self.options.get("subsample_rate", "1")), int(self.options.get("seed", "0")))

    def commit(self, end: dict) -> None:
        pass
