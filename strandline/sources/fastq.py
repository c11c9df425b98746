"""FASTQ read sets as a Spark data source, `readset`: a reader of read pairs and a writer of aligned files.

One input partition is one read set, whose files are read in lockstep, so no shuffle puts pairs together; parallelism
is the number of sets. Compressed files can't be split; repartition after the scan for wide work. The compression is
told from the first bytes, never from the name: gzip (also of several members), LZ4 frames or plain text. Columns are
group_id (the set's number), ordinal, and a struct for each read.

    spark.dataSource.register(ReadSetSource)
    spark.read.format("readset").option("r1", ...).option("r2", ...).load()
    spark.read.format("readset").option("manifest", manifest_json(manifest)).load()

Options: r1, r2, i1, i2, interleaved; manifest; r1_length, r2_length (longest kept length); subsample_rate, seed;
validate_on_open; on_error: fail, or quarantine, which ends a set at its first error with a row that has the column
`reason` instead of reads.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..schema import READ_PAIR, READS, REASON

GZIP, LZ4_FRAME = b"\x1f\x8b", b"\x04\x22\x4d\x18"
PROBED = 10
_BASES = re.compile(rb"[ACGTN]*")
_PREFIX = re.compile(rb"[^ /]*")
#: A manifest of at most so many sets is probed before the scan; the tasks check the files of a larger one, as of any.
PROBED_SETS = 16


class FastqError(Exception):
    """kind: open, io or format. line counts from 0, four a record."""

    def __init__(self, kind: str, message: str, path: str | None = None, line: int | None = None):
        self.kind, self.message, self.path, self.line = kind, message, path, line
        super().__init__(f"{message} ({path}, line {line})" if path else message)

    def __reduce__(self):
        return FastqError, (self.kind, self.message, self.path, self.line)


def open_fastq(path: str) -> io.BufferedIOBase:
    """The file's uncompressed bytes, by its first four."""
    try:
        raw = open(path, "rb")
    except OSError as e:
        raise FastqError("open", f"can't be opened: {e.strerror}", path) from e
    head = raw.read(4)
    raw.seek(0)
    if len(head) < 4:
        raise FastqError("io", "shorter than four bytes", path, 0)
    if head[:2] == GZIP:
        return gzip.GzipFile(fileobj=raw)
    if head == LZ4_FRAME:
        return io.BufferedReader(pa.CompressedInputStream(pa.PythonFile(raw, "r"), "lz4"), 1 << 16)
    if head[:1] == b"@":
        return raw
    raise FastqError("format", "neither gzip nor LZ4 nor plain FASTQ", path, 0)


def records(path: str) -> Iterator[tuple[str, str, str]]:
    """(header, seq, qual) of each record. Line ends may be LF or CRLF, the last may lack one; blank lines may end the file."""
    number = 0
    try:
        with open_fastq(path) as f:
            while True:
                lines = [f.readline() for _ in range(4)]
                if not any(x.strip() for x in lines):
                    return
                head, seq, plus, qual = (x.rstrip(b"\r\n") for x in lines)
                line = 4 * number
                if head[:1] != b"@":
                    raise FastqError("format", "a record's header doesn't begin with @", path, line)
                if plus[:1] != b"+":
                    raise FastqError("format", "a record's third line doesn't begin with +", path, line)
                if len(seq) != len(qual):
                    raise FastqError("format", "sequence and quality differ in length", path, line)
                if not _BASES.fullmatch(seq):
                    raise FastqError("format", "a sequence holds something else than A, C, G, T or N", path, line)
                yield head[1:].decode("latin-1"), seq.decode(), qual.decode("latin-1")
                number += 1
    except (OSError, EOFError, pa.ArrowException) as e:
        raise FastqError("io", str(e), path, 4 * number) from e


def prefix(header: str) -> str:
    return re.split("[ /]", header, maxsplit=1)[0]


def is_single_ended(r1: str, r2: str | None, interleaved: bool) -> bool:
    """Not interleaved: no second file. Interleaved: the first two records have different prefixes, or there is but one."""
    if not interleaved:
        return r2 is None
    first = [prefix(h) for h, _, _ in itertools.islice(records(r1), 2)]
    return len(first) < 2 or first[0] != first[1]


def sampled(header: str, rate: float, seed: int) -> bool:
    """By keyed hash of the header's prefix: partitions don't matter, and SQL can say the same."""
    return rate >= 1 or int(hashlib.md5(f"{prefix(header)}{seed}".encode()).hexdigest()[:8], 16) / 4294967296 < rate


@dataclass
class ReadSet(InputPartition):
    group_id: int
    paths: dict
    interleaved: bool


def read_pairs(reads: ReadSet, lengths: dict | None = None, rate: float = 1.0, seed: int = 0) -> Iterator[tuple]:
    """(group_id, ordinal, r1, r2, i1, i2) of a set; FastqError at its first fault."""
    paths = {r: p for r in READS if (p := reads.paths.get(r))}
    if "r1" not in paths and reads.interleaved:
        raise FastqError("format", "an interleaved set needs r1")
    lengths = lengths or {}
    single = reads.interleaved and is_single_ended(paths["r1"], None, True)
    streams, count = {r: records(p) for r, p in paths.items()}, dict.fromkeys(paths, 0)

    def advance(r: str):
        count[r] += 1
        return next(streams[r], None)

    for ordinal in itertools.count():
        row = {}
        for r in paths:
            row[r] = advance(r)
            if r == "r1" and reads.interleaved and row[r] is not None:
                if single:
                    row["r2"] = (row[r][0], "", "")
                elif (second := advance(r)) is None:
                    raise FastqError("format", "the interleaved file holds an odd number of records", paths[r], 4 * (count[r] - 1))
                else:
                    row["r2"] = second
        ended = [r for r in paths if row[r] is None]
        if ended:
            if len(ended) < len(paths):
                raise FastqError("format", "this file ends before the others of its set", paths[ended[0]], 4 * (count[ended[0]] - 1))
            return
        there = [r for r in READS if r in row]
        own = prefix(row[there[0]][0])
        if not sampled(own, rate, seed):
            continue
        for r in there[1:]:
            if prefix(row[r][0]) != own:
                raise FastqError("format", "the reads of one cluster have different headers", paths.get(r, paths[there[0]]), 4 * (count.get(r, count[there[0]]) - 1))
        cut = [None if r not in row else (row[r][0], *(x[: lengths[r]] if lengths.get(r) is not None else x for x in row[r][1:])) for r in READS]
        yield (reads.group_id, ordinal, *cut)


#: Records of a file that are parsed at once.
BLOCK = 4096
_RECORD = pa.struct([("header", pa.string()), ("seq", pa.string()), ("qual", pa.string())])
_PAIR = pa.schema([("group_id", pa.int64()), ("ordinal", pa.int64()), *[(r, _RECORD) for r in READS]])


class _Odd(Exception):
    """A block that isn't plainly good: the record by record reader decides about it."""


def _block(f: io.BufferedIOBase, count: int) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Headers, sequences and qualities of the next `count` records, fewer at the end."""
    lines = list(itertools.islice(f, 4 * count))
    if len(lines) % 4:
        raise _Odd
    lines = [x.rstrip(b"\r\n") for x in lines]
    heads, seqs, quals = lines[0::4], lines[1::4], lines[3::4]
    good = all(x[:1] == b"@" for x in heads) and all(x[:1] == b"+" for x in lines[2::4]) and list(map(len, seqs)) == list(map(len, quals))
    if not good or b"".join(seqs).translate(None, b"ACGTN"):
        raise _Odd
    return [x[1:] for x in heads], seqs, quals


def _strings(values: list[bytes]) -> pa.Array:
    if b"".join(values).isascii():
        return pa.array(values, pa.binary()).cast(pa.string())
    return pa.array([x.decode("latin-1") for x in values], pa.string())


def _rows(group_id: int, rows: list[tuple]) -> pa.RecordBatch:
    names = ("header", "seq", "qual")
    structs = [pa.array([None if x is None else dict(zip(names, x)) for x in column], _RECORD) for column in zip(*(r[2:] for r in rows))]
    return pa.RecordBatch.from_arrays([pa.array([group_id] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.int64()), *structs], schema=_PAIR)


def read_batches(reads: ReadSet, lengths: dict | None = None, rate: float = 1.0, seed: int = 0) -> Iterator[pa.RecordBatch]:
    """What read_pairs gives, in Arrow batches. Blocks of all files are checked and built column by column; from the first
    block on that isn't plainly good, read_pairs goes on, which finds the place of a fault."""
    paths, lengths, done = {r: p for r in READS if (p := reads.paths.get(r))}, lengths or {}, 0
    files: dict[str, io.BufferedIOBase] = {}
    try:
        try:
            if "r1" not in paths:
                raise _Odd
            single = reads.interleaved and is_single_ended(paths["r1"], None, True)
            files = {r: open_fastq(p) for r, p in paths.items()}
            while True:
                blocks = {r: _block(f, BLOCK * (2 if r == "r1" and reads.interleaved and not single else 1)) for r, f in files.items()}
                if reads.interleaved:
                    heads, seqs, quals = blocks["r1"]
                    if single:
                        blocks["r2"] = heads, [b""] * len(heads), [b""] * len(heads)
                    elif len(heads) % 2:
                        raise _Odd
                    else:
                        blocks["r1"], blocks["r2"] = (heads[0::2], seqs[0::2], quals[0::2]), (heads[1::2], seqs[1::2], quals[1::2])
                sizes = {len(b[0]) for b in blocks.values()}
                if len(sizes) > 1:
                    raise _Odd
                if not (n := sizes.pop()):
                    return
                there = [r for r in READS if r in blocks]
                own = [_PREFIX.match(x)[0] for x in blocks[there[0]][0]]
                kept = list(range(n)) if rate >= 1 else [i for i, x in enumerate(own) if sampled(x.decode("latin-1"), rate, seed)]
                for r in there[1:]:
                    other = blocks[r][0]
                    if any(_PREFIX.match(other[i])[0] != own[i] for i in kept):
                        raise _Odd
                columns = []
                for r in READS:
                    if r not in blocks:
                        columns.append(pa.nulls(len(kept), _RECORD))
                        continue
                    heads, seqs, quals = blocks[r] if len(kept) == n else tuple([x[i] for i in kept] for x in blocks[r])
                    if (most := lengths.get(r)) is not None:
                        seqs, quals = [x[:most] for x in seqs], [x[:most] for x in quals]
                    columns.append(pa.StructArray.from_arrays([_strings(heads), _strings(seqs), _strings(quals)], fields=list(_RECORD)))
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array([reads.group_id] * len(kept), pa.int64()), pa.array([done + i for i in kept], pa.int64()), *columns], schema=_PAIR)
                done += n
        finally:
            for f in files.values():
                f.close()
    except (_Odd, FastqError, OSError, EOFError, pa.ArrowException):
        rows: list[tuple] = []
        try:
            for row in read_pairs(reads, lengths, rate, seed):
                if row[1] >= done:
                    rows.append(row)
                    if len(rows) == BLOCK:
                        yield _rows(reads.group_id, rows)
                        rows = []
        finally:
            if rows:
                last, rows = rows, []
                yield _rows(reads.group_id, last)


def manifest_json(manifest: DataFrame) -> str:
    """A manifest (a table of a few thousand read sets, not of reads) as the option of that name."""
    return json.dumps([r.asDict() for r in manifest.select(*READS, "r1_interleaved").collect()])


class ReadSetReader(DataSourceReader):
    def __init__(self, options: dict):
        get = lambda k, d=None: options.get(k, d)
        sets = json.loads(get("manifest")) if get("manifest") else [{r: get(r) for r in READS} | {"r1_interleaved": get("interleaved", "false").lower() == "true"}]
        self.sets = [ReadSet(i, {r: s.get(r) for r in READS}, bool(s.get("r1_interleaved"))) for i, s in enumerate(sets)]
        self.lengths = {r: int(get(f"{r}_length")) for r in ("r1", "r2") if get(f"{r}_length") is not None}
        self.rate, self.seed, self.quarantine = float(get("subsample_rate", "1")), int(get("seed", "0")), get("on_error", "fail") == "quarantine"
        if get("validate_on_open", "true").lower() == "true" and not self.quarantine and len(self.sets) <= PROBED_SETS:
            for s in self.sets:
                for p in filter(None, s.paths.values()):
                    for _ in itertools.islice(records(p), PROBED):
                        pass

    def partitions(self) -> list[ReadSet]:
        return self.sets

    def read(self, partition: ReadSet) -> Iterator[pa.RecordBatch]:
        found = read_batches(partition, self.lengths, self.rate, self.seed)
        if not self.quarantine:
            yield from found
            return
        last, schema = -1, _PAIR.append(pa.field("reason", pa.string()))
        try:
            for batch in found:
                last = batch.column(1)[-1].as_py()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.nulls(batch.num_rows, pa.string())], schema=schema)
        except FastqError as e:
            one = [pa.array([partition.group_id], pa.int64()), pa.array([last + 1], pa.int64()), *[pa.nulls(1, _RECORD) for _ in READS], pa.array([str(e)])]
            yield pa.RecordBatch.from_arrays(one, schema=schema)


@dataclass
class Written(WriterCommitMessage):
    renames: list


def render(record) -> bytes:
    header, seq, qual = record
    return f"@{header}\n{seq}\n+\n{qual}\n".encode("latin-1")


class ReadSetWriter(DataSourceWriter):
    """Files `<prefix>-<partition>_<READ>.fastq[.gz]`, whose records stand in the same order; absent reads write nothing."""

    def __init__(self, options: dict, overwrite: bool):
        self.folder, self.prefix = options.get("path"), options.get("prefix", "part")
        self.suffix = options.get("suffix", "fastq")
        self.interleaved = options.get("interleaved", "false").lower() == "true"
        if not self.folder:
            raise FastqError("open", "a folder is needed to write to")
        if self.suffix.endswith("lz4"):
            raise FastqError("format", "LZ4 output isn't supported; choose gz or plain text")
        os.makedirs(self.folder, exist_ok=True)
        if overwrite:
            for name in os.listdir(self.folder):
                if name.endswith((".fastq", ".fastq.gz")):
                    os.remove(f"{self.folder}/{name}")

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        part, tag, files = TaskContext.get().partitionId(), uuid.uuid4().hex, {}
        opened = gzip.open if self.suffix.endswith("gz") else open

        def out(name: str):
            if name not in files:
                path = f"{self.folder}/{self.prefix}-{part:05}_{name}.{self.suffix}"
                files[name] = (opened(f"{path}.{tag}", "wb"), f"{path}.{tag}", path)
            return files[name][0]

        try:
            for row in rows:
                for r in READS:
                    if row[r] is not None:
                        out("RA" if self.interleaved and r in ("r1", "r2") else r.upper()).write(render(row[r]))
        finally:
            for f, _, _ in files.values():
                f.close()
        return Written([(a, b) for _, a, b in files.values()])

    def commit(self, messages: list) -> None:
        for m in filter(None, messages):
            for a, b in m.renames:
                os.replace(a, b)

    def abort(self, messages: list) -> None:
        for m in filter(None, messages):
            for a, _ in m.renames:
                if os.path.exists(a):
                    os.remove(a)


class ReadSetSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "readset"

    def schema(self) -> StructType:
        quarantine = self.options.get("on_error", "fail") == "quarantine"
        return StructType([*READ_PAIR.fields, REASON]) if quarantine else READ_PAIR

    def reader(self, schema: StructType) -> ReadSetReader:
        return ReadSetReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ReadSetWriter:
        return ReadSetWriter(dict(self.options), overwrite)

    def streamReader(self, schema: StructType):
        from ..streaming.arrivals import ArrivingSets

        return ArrivingSets(dict(self.options))


def write_text(path: str, rows: Iterator[bytes]) -> None:
    """Records to one file, compressed by its extension: .gz or none; LZ4 is refused rather than written as plain text."""
    if path.endswith(".lz4"):
        raise FastqError("format", "LZ4 output isn't supported; choose gz or plain text", path)
    with (gzip.open if path.endswith(".gz") else open)(path, "wb") as f:
        for x in rows:
            f.write(x)
