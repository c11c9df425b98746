"""Token-ID files: independent zstandard frames, one for each document, with a trailing seek table and checksums.

A file is the frames of consecutive documents in ascending id order, then the seek table in a zstandard skippable
frame, so that any zstandard reader can also decompress the whole file:

    frame 0 .. frame n-1 | 0x184D2A5E u32 | table bytes u32 | n x ENTRY | FOOTER

ENTRY holds the id, a flag for a null id, the frame's compressed bytes, its number of ids and the CRC-32 of its
uncompressed bytes; FOOTER holds n, the bytes of an id (2 or 4) and a magic word. A reader takes the last bytes, then
the table, and then decompresses the frames it wants alone. Files are rows of a table in the shared folder (part, seq,
payload): a cluster's executors share no other place; export() writes them as files to a mounted folder.

Encoding reads each text once. Texts are cut at ASCII white space, at which the tokenizer never joins, and the library
encodes each distinct piece once per worker as long as a cache of bounded size holds it. Range partitioning and sorting are
Spark's own and spill; they go by id, checksum, length and a number of the row, so repeated or null ids spread over
partitions like any others. A file is closed at `file_bytes`, so memory is bounded by that and by one document.

Defined results: a null text is an empty one (the end id alone); null ids come first; equal ids follow each other,
ordered by checksum and length; a text longer than `file_bytes` has a file of its own. An empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut

SKIPPABLE, MAGIC = 0x184D2A5E, 0x5344544B
ENTRY = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("frame_bytes", "<u8"), ("n_tokens", "<u8"), ("crc32", "<u4")])
FOOTER = struct.Struct("<IBI")
FILE_BYTES = 8 << 20
CACHE_PIECES = 800_000
TEXTS_AT_ONCE_BYTES = 2 << 20


class PieceCache:
    """piece -> its ids as little-endian bytes. Two generations of at most half of `most` pieces: what is used stays.

    A piece of letters is one word for the tokenizer: many are encoded as one text, whose ids fall into words at the ids
    that end one. ASCII marks behind letters are a word of their own. Any other piece is encoded alone.
    """

    MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, width: int, most: int = CACHE_PIECES):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.kind, self.width, self.most = Tokenizer.from_file(path), f"<u{width}", width, most // 2
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # of the ids that end a word
        self.last[[i for p, i in vocabulary.items() if p.endswith("</w>")]] = True
        self.lowers = "Lowercase" in str(self.tokenizer.normalizer)
        self.joinable = self.lowers and bool(self.last.any())
        # lower-case ASCII letters pass normalisation and byte mapping as they are: the model itself, cut at spaces, will do
        self.words_only = Tokenizer(self.tokenizer.model)
        self.words_only.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        self.old: dict[bytes, bytes] = {}
        self.pending: dict[bytes, bytearray] = {}
        self.young = _Young(self.old, self.pending)

    def plain(self, word: bytes) -> bool:
        """Whether it is one word for the tokenizer: letters that normalisation leaves letters."""
        if word.isalpha():
            return True
        s = word.decode()
        return s.isalpha() and s.lower().isalpha() and unicodedata.is_normalized("NFC", s)

    def _encode(self, words: list[bytes], tokenizer) -> None:
        """Encode plain words together and add them."""
        for i in range(0, len(words), 2000):
            some = words[i : i + 2000]
            ids = np.array(tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, self.kind)
            stops = np.flatnonzero(self.last[ids]) + 1
            if len(stops) != len(some):
                self._encode_alone(some)
                continue
            raw, begin = ids.tobytes(), 0
            for p, stop in zip(some, (stops * self.width).tolist()):
                self.young[p] = raw[begin:stop]
                begin = stop

    def _encode_alone(self, pieces: list[bytes]) -> None:
        for p, e in zip(pieces, self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)):
            self.young[p] = np.array(e.ids, self.kind).tobytes()

    def _unknown(self, pieces) -> set[bytes]:
        """Those that neither generation holds; those of the old one are young again."""
        missing = pieces - self.young.keys()
        if self.old:
            again = missing & self.old.keys()
            self.young.update({p: self.old[p] for p in again})
            missing -= again
        return missing

    def begin(self):
        """What looks a piece's ids up: a piece that isn't known gets a place that fill() fills. Makes room first."""
        if len(self.young) > self.most:
            marks = set(self.MARKS)  # pieces that end in marks are made of their words again, without encoding
            self.old = {p: ids for p, ids in self.young.items() if p[-1] not in marks or len(p) < 4}
            self.young = _Young(self.old, self.pending)
        return self.young.__getitem__

    def fill(self) -> None:
        """Encode the pieces that were asked for and not known, and fill their places."""
        young, old, pending, marks = self.young, self.old, self.pending, self.MARKS
        ascii_words, words, ended, alone = [], [], [], []
        for p in pending if self.joinable else ():
            if p.isalpha():
                (ascii_words if p.islower() else words).append(p)
            elif (word := p.rstrip(marks)) and (word.isalpha() or self.plain(word)):
                if len(word) == len(p):
                    words.append(p)
                else:
                    ended.append((p, word))
            else:
                alone.append(p)
        self._encode_alone(alone if self.joinable else list(pending))
        bare = set()
        for _, w in ended:
            if w not in young and w not in pending and w not in bare:
                if (ids := old.get(w)) is not None:
                    young[w] = ids
                else:
                    bare.add(w)
                    (ascii_words if w.isalpha() and w.islower() else words).append(w)
        self._encode(ascii_words, self.words_only)
        self._encode(words, self.tokenizer)
        self._encode_alone(list(self._unknown({p[len(w) :] for p, w in ended})))
        for p, w in ended:
            young[p] = young[w] + young[p[len(w) :]]
        for p, place in pending.items():
            place += young[p]
        pending.clear()

    def learn(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """A dictionary that holds them all."""
        get = self.begin()
        for p in pieces:
            get(p)
        self.fill()
        return self.young


class _Young(dict):
    """The younger generation. A piece that it lacks comes from the older one, or gets an empty place to be filled."""

    __slots__ = ("old", "pending")

    def __init__(self, old: dict[bytes, bytes], pending: dict[bytes, bytearray]):
        self.old, self.pending = old, pending

    def __missing__(self, piece: bytes):
        if (ids := self.old.get(piece)) is not None:
            self[piece] = ids
            return ids
        if (place := self.pending.get(piece)) is None:
            place = self.pending[piece] = bytearray()
        return place


_caches: dict = {}


def _cache(path: str, width: int) -> PieceCache:
    if (path, width) not in _caches:
        _caches[path, width] = PieceCache(path, width)
    return _caches[path, width]


def _runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of at most `most` bytes together, or of one."""
    begin = total = 0
    for i, n in enumerate(sizes):
        if i > begin and total + n > most:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def encode_frames(docs: DataFrame, tokenizer: str, end_id: int, width: int, id_col: str = "doc_id", text_col: str = "text", level: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, crc32 (of the frame's uncompressed bytes), frame."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        cache = _cache(tokenizer, width)
        lower = cache.lowers
        pack, end = zstandard.ZstdCompressor(level=level, write_checksum=True), end_id.to_bytes(width, "little")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            sizes = pa.compute.binary_length(texts).to_pylist()
            for begin, stop in _runs(sizes, TEXTS_AT_ONCE_BYTES):
                # ASCII capitals make no difference to a tokenizer that lowers case; its special tokens are spelt with <|
                split = [(t.lower() if lower and b"<|" not in t else t).split() for t in texts.slice(begin, stop - begin).to_pylist()]
                n, crc, frames = [], [], []
                get = cache.begin()
                found = [list(map(get, words)) for words in split]
                cache.fill()
                for ids_of_words in found:
                    raw = b"".join(ids_of_words) + end
                    n.append(len(raw) // width)
                    crc.append(zlib.crc32(raw))
                    frames.append(pack.compress(raw))
                yield pa.RecordBatch.from_arrays([ids.slice(begin, stop - begin), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(frames, pa.binary())], names=["doc_id", "n_tokens", "crc32", "frame"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, n_tokens long, crc32 long, frame binary")


def pack_file(entries: list[tuple], frames: list[bytes], width: int) -> bytes:
    rows = np.array(entries, ENTRY).tobytes() + FOOTER.pack(len(entries), width, MAGIC)
    return b"".join([*frames, struct.pack("<II", SKIPPABLE, len(rows)), rows])


def seek_table(payload: bytes) -> tuple[np.ndarray, int]:
    """A file's ENTRY rows and the bytes of an id; ValueError if the file is damaged."""
    if len(payload) < FOOTER.size:
        raise ValueError("token file: too short")
    n, width, magic = FOOTER.unpack_from(payload, len(payload) - FOOTER.size)
    begin = len(payload) - FOOTER.size - n * ENTRY.itemsize
    if magic != MAGIC or begin < 8 or struct.unpack_from("<II", payload, begin - 8) != (SKIPPABLE, len(payload) - begin):
        raise ValueError("token file: no seek table")
    table = np.frombuffer(payload, ENTRY, n, begin)
    if int(table["frame_bytes"].sum()) != begin - 8:
        raise ValueError("token file: frames and seek table differ")
    return table, width


def read_frame(payload: bytes, table: np.ndarray, width: int, k: int, offset: int) -> np.ndarray:
    """Document k's ids from its own frame; ValueError if its checksum differs."""
    import zstandard

    row = table[k]
    raw = zstandard.ZstdDecompressor().decompress(payload[offset : offset + int(row["frame_bytes"])])
    if zlib.crc32(raw) != row["crc32"] or len(raw) != row["n_tokens"] * width:
        raise ValueError(f"token file: frame {k} is damaged")
    return np.frombuffer(raw, f"<u{width}")


FILES = "part int, seq int, n_docs long, n_tokens long, first_id long, last_id long, payload binary"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """The table of files: part, seq (ids ascend by part and seq), n_docs, n_tokens, first_id and last_id (null: null ids only), payload."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, size = TaskContext.get().partitionId(), 0, 0
        entries: list[tuple] = []
        frames: list[bytes] = []

        def close() -> pa.RecordBatch:
            ids = [x[0] for x in entries if not x[1]]
            values = [part, seq, len(entries), sum(x[3] for x in entries), min(ids, default=None), max(ids, default=None), pack_file(entries, frames, width)]
            kinds = [("part", pa.int32()), ("seq", pa.int32()), *[(c, pa.int64()) for c in ("n_docs", "n_tokens", "first_id", "last_id")], ("payload", pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([v], kind) for v, (_, kind) in zip(values, kinds)], names=[c for c, _ in kinds])

        for batch in batches:
            for doc_id, n, crc, frame in zip(*(c.to_pylist() for c in batch.columns)):
                entries.append((doc_id or 0, doc_id is None, len(frame), n, crc))
                frames.append(frame)
                size += len(frame)
                if size >= file_bytes:
                    yield close()
                    seq, size, entries, frames = seq + 1, 0, [], []
        if entries:
            yield close()

    framed = cut(encode_frames(docs, tokenizer, end_id, width, id_col, text_col), "frames").withColumn("tie", F.monotonically_increasing_id())
    by = [F.col("doc_id").asc_nulls_first(), F.col("crc32"), F.col("n_tokens"), F.col("tie")]
    ordered = framed.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie")
    return cut(ordered.mapInArrow(assemble, FILES), "token-files")


def read_documents(files: DataFrame, wanted: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """Per document (all, or those of the ids `wanted`): part, seq, doc_id, at (ids before it in its file), n_tokens,
    ids_crc32, ids (null if not asked for). Only the frames asked for are decompressed."""
    want = None if wanted is None else np.array(sorted(set(wanted)), np.int64)
    if want is not None:
        ids = F.array(*[F.lit(int(x)) for x in want]).cast("array<long>")
        reach = F.col("first_id").between(int(want.min()), int(want.max())) | F.lit(int(want.min())).between(F.col("first_id"), F.col("last_id")) if len(want) else F.lit(False)
        files = files.where(reach & F.exists(ids, lambda x: x.between(F.col("first_id"), F.col("last_id"))))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, seq, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                payload = payload.as_py()
                table, width = seek_table(payload)
                offsets = np.concatenate(([0], np.cumsum(table["frame_bytes"])[:-1])).astype(np.int64)
                at = np.concatenate(([0], np.cumsum(table["n_tokens"])[:-1])).astype(np.int64)
                rows = np.arange(len(table)) if want is None else np.flatnonzero(np.isin(table["doc_id"], want) & (table["null_id"] == 0))
                for some in np.array_split(rows, len(rows) // 500 + 1):
                    if len(some):
                        ids = [read_frame(payload, table, width, k, offsets[k]).astype("<u4") for k in some]
                        ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([part] * len(some), pa.int32()), pa.array([seq] * len(some), pa.int32()),
                                pa.array([None if table["null_id"][k] else int(table["doc_id"][k]) for k in some], pa.int64()), pa.array(at[some], pa.int64()),
                                pa.array(np.diff(ends), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))) if with_ids else pa.nulls(len(some), pa.list_(pa.int32())),
                            ],
                            names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
                        )

    return files.select("part", "seq", "payload").mapInArrow(read, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long, ids array<int>")


def file_totals(files: DataFrame) -> DataFrame:
    """Per file: part, seq, n_docs, n_tokens, base (ids in all files before it); no payload is read."""
    found = files.select("part", "seq", "n_docs", "n_tokens")
    # sums of whole parts first: one row a partition in the only window that spans them all
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(whole), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = found.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return own.join(parts, "part").select("part", "seq", "n_docs", "n_tokens", (F.col("part_base") + F.col("inside")).cast("long").alias("base"))


def token_positions(files: DataFrame) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (ids as little-endian uint32)."""
    bases = file_totals(files).select("part", "seq", "base")
    rows = read_documents(files, with_ids=False).drop("ids")
    return rows.join(bases, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def export(files: DataFrame, folder: str) -> DataFrame:
    """Write each file to `folder`, which all executors must have mounted: part, seq, path. Lazy, like any DataFrame."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        for batch in batches:
            paths = []
            for part, seq, payload in zip(*(c.to_pylist() for c in batch.columns)):
                paths.append(path := f"{folder}/tokens-{part:06}-{seq:04}.zst")
                with open(f"{path}.{os.getpid()}", "wb") as out:
                    out.write(payload)
                os.replace(out.name, path)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(paths)], names=["part", "seq", "path"])

    return files.select("part", "seq", "payload").mapInArrow(write, "part int, seq int, path string")
