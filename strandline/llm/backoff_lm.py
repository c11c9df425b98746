"""Stupid-backoff scores of all documents from counts over all documents, by a blocked relational join.

The relations are n-grams exploded from texts (block, n-gram, count) and count tables partitioned by n-gram hash
(shard, n-gram, count). Rows of single n-grams would be many times the input, so both travel as sorted columns: a block
of documents sends each shard one row with its distinct n-grams there, as packed differences, and their counts. A shard
merges its blocks' columns into its part of the count table, joins each block's n-grams with it, and sends back how
often they occur elsewhere - mostly never, which packs to nothing. The block then scores its documents and sums. Texts
are packed and dealt to blocks once; both stages that read them share the exchange. A common n-gram is one entry a block,
so no shard is hot, and blocks are dealt by hash of their runs of documents.

Rows grow as the input does. A block has at most as many shards as leave `cell` n-grams a row; where a shard would be more
than a task holds, `FAN` blocks are merged into one and a shard is cut into as many, level by level, and the answers come
back the same way: a level has a row for every `cell` n-grams at most, and there are as many levels as the logarithm of the
input to the base `FAN` asks for (none below 8 GB of text, three at 100 TB).

Counts leave out the document that is scored, or every n-gram would be seen. With c these counts and N the words of the
other documents, the word w after (u, v) scores c(uvw)/c(uv) if uvw is seen elsewhere, else 0.4 c(vw)/c(v) if vw is, else
0.16 c(w)/N, and an unseen word counts as seen once. A first word starts from c(w)/N, a second from its pair. Words are
`[^\\x20\\x09-\\x0D]+` after lower-casing A-Z; n-grams are told apart by 64-bit hashes at every size.

Defined results: null, empty and blank texts have no words and score 0 (null per word); null ids are kept; a repeated
row is a document of its own, so its copies count as elsewhere; a long text is taken whole, in a block with few others; an
empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash_dedup import _mix, byte_runs, text_words
from .shared import cut, released

ORDER = 3
ALPHA = 0.4
BLOCK_BYTES = 10 << 20
RUN_BYTES = 256 << 10
SHARD_NGRAMS = 1_500_000
CELL = 256
FAN = 64
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def pack(x: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes; planes of zeros are left out."""
    import zstandard

    x = np.ascontiguousarray(x, "<u8")
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())


def unpack(data: bytes, n: int) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data) if n else b""
    out = np.zeros((n, 8), np.uint8)
    planes = np.frombuffer(raw, np.uint8).reshape(-1, n) if n else np.empty((0, 0), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").ravel()


class _Block:
    """The n-grams of some documents: by order, the sorted distinct codes, their counts, and each place's number among them (-1: none ends here)."""

    def __init__(self, texts: list[bytes], order: int):
        self.words, self.sizes = text_words(texts)
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        at = np.arange(len(self.words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.codes, self.counts, self.where = [], [], []
        for k in range(order):
            ends = np.flatnonzero(at >= k)
            total = np.full(len(ends), k + 1, np.uint64)
            for j in range(k + 1):
                total += self.words[ends - j] * _PLACE[j]
            codes, where, counts = np.unique(_mix(total), return_inverse=True, return_counts=True)
            self.codes.append(codes)
            self.counts.append(counts.astype(np.int32))
            self.where.append(np.full(len(self.words), -1, np.int32))
            self.where[-1][ends] = where
            del total, where, counts

    def own(self, k: int) -> np.ndarray:
        """How often the n-gram that ends at each place occurs in its own document."""
        out = np.ones(len(self.words), np.int64)
        some = np.flatnonzero((self.where[k] >= 0) & (self.counts[k][self.where[k]] > 1)) if len(self.words) else []
        if len(some):
            _, where, counts = np.unique(self.doc[some].astype(np.int64) * len(self.codes[k]) + self.where[k][some], return_inverse=True, return_counts=True)
            out[some] = counts[where]
        return out


def _score(block: _Block, elsewhere: list[np.ndarray], alpha: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Per document: sum of logs but for the words' share of N, the places that count N, places by the order that scored them."""
    n = len(block.words)
    left_out = []  # counts without the own document, at each place, by order
    for k, totals in enumerate(elsewhere):
        at = block.where[k]
        left_out.append(np.where(at >= 0, (totals + block.counts[k])[at] - block.own(k), 0) if len(totals) else np.zeros(n, np.int64))
    logs, todo, tried, hits = np.zeros(n), np.arange(n), np.zeros(n, np.int64), []
    for k in range(len(elsewhere) - 1, 0, -1):
        hit = left_out[k][todo] > 0
        found = todo[hit]
        logs[found] = np.log(left_out[k][found] / left_out[k - 1][found - 1]) + tried[found] * math.log(alpha)
        hits.append(np.bincount(block.doc[found], minlength=len(block.sizes)))
        todo = todo[~hit]
        tried[todo] += block.where[k][todo] >= 0
    logs[todo] = np.log(np.maximum(left_out[0][todo], 1)) + tried[todo] * math.log(alpha)
    uni = np.bincount(block.doc[todo], minlength=len(block.sizes))
    return np.bincount(block.doc, logs, minlength=len(block.sizes)), uni, hits[::-1]


def packed_runs(docs: DataFrame, id_col: str, text_col: str, run_bytes: int = RUN_BYTES) -> DataFrame:
    """Neighbouring documents in runs of about `run_bytes`: ids, sizes (bytes of each text) and texts (compressed)."""

    def pack_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for begin, stop in byte_runs(batch.column(1), run_bytes, 1 << 20):
                ids, texts = batch.column(0).slice(begin, stop - begin), batch.column(1).slice(begin, stop - begin).to_pylist()
                one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
                raw = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
                yield pa.RecordBatch.from_arrays([one(pa.concat_arrays([ids])), one(pa.array([len(t) for t in texts], pa.int64())), pa.array([raw], pa.binary())], names=["ids", "sizes", "texts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(released(pack_texts), "ids array<long>, sizes array<long>, texts binary")


def _texts(runs: pa.Table) -> list[bytes]:
    import zstandard

    out: list[bytes] = []
    for sizes, raw in zip(runs.column("sizes").to_pylist(), runs.column("texts")):
        whole, at = zstandard.ZstdDecompressor().decompress(raw.as_py()) if sum(sizes) else b"", 0
        for n in sizes:
            out.append(whole[at : at + n])
            at += n
    return out


_SENT = "src long, k int, shard long, n int, codes binary, counts binary"
_BACK = "src long, k int, shard long, n int, rest binary"


def _rows(src: int, k: int, first: int, shards: int, low: int, span: int, codes: np.ndarray, counts: np.ndarray) -> list[tuple]:
    """A row for each of `shards` equal parts, that has n-grams, of the hashes from `low` over `span`."""
    edges = np.searchsorted(codes, np.array([low + span * i // shards for i in range(shards)], np.uint64)).tolist() + [len(codes)]
    return [(src, k, first + s, b - a, pack(np.diff(codes[a:b], prepend=np.uint64(0))), pack(counts[a:b])) for s, (a, b) in enumerate(zip(edges, edges[1:])) if a < b]


def _table(rows: list[tuple]) -> pa.Table:
    kinds = [("src", pa.int64()), ("k", pa.int32()), ("shard", pa.int64()), ("n", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())]
    return pa.table([[x[i] for x in rows] for i in range(6)], schema=pa.schema(kinds))


def sent_rows(runs: DataFrame, order: int, shards: int) -> DataFrame:
    """A row for each block, order and shard: src (the block), k (order - 1), shard, n, codes, counts."""

    def explode(rows: pa.Table) -> pa.Table:
        block, src = _Block(_texts(rows), order), rows.column("block")[0].as_py()
        return _table([x for k in range(order) for x in _rows(src, k, 0, shards, 0, 1 << 64, block.codes[k], block.counts[k])])

    return runs.groupBy("block").applyInArrow(explode, _SENT)


def _columns(rows: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Sizes, codes and counts of the rows, one after another."""
    sizes = rows.column("n").to_pylist()
    codes = [np.cumsum(unpack(x.as_py(), n), dtype=np.uint64) for x, n in zip(rows.column("codes"), sizes)]
    own = [unpack(x.as_py(), n).astype(np.int64) for x, n in zip(rows.column("counts"), sizes)]
    return sizes, np.concatenate([np.empty(0, np.uint64), *codes]), np.concatenate([np.empty(0, np.int64), *own])


def _answer(rows: pa.Table, sizes: list[int], rest: np.ndarray) -> pa.Table:
    ends = np.cumsum(sizes)
    packed = [pack(rest[e - n : e]) for e, n in zip(ends.tolist(), sizes)]
    return pa.table([*(rows.column(c) for c in ("src", "k", "shard", "n")), pa.array(packed, pa.binary())], names=["src", "k", "shard", "n", "rest"])


def elsewhere_counts(sent: DataFrame, shards: int, wanted: int, fan: int = FAN) -> DataFrame:
    """For each row of `sent`: src, k, shard, n and rest, how often its n-grams occur in all other rows of its k and shard.

    With fewer `shards` than `wanted`, a level of merged sources and finer shards does the counting.
    """
    if shards >= wanted:

        def count(rows: pa.Table) -> pa.Table:
            sizes, codes, own = _columns(rows)
            where = np.unique(codes, return_inverse=True)[1]
            return _answer(rows, sizes, np.bincount(where, own).astype(np.int64)[where] - own)

        return sent.groupBy("k", "shard").applyInArrow(count, _BACK)
    parts = min(fan, wanted // shards)
    span = (1 << 64) // shards
    grouped = sent.withColumn("into", F.floor(F.col("src") / fan))

    def merge(rows: pa.Table) -> pa.Table:
        _, codes, own = _columns(rows)
        k, shard, into = (rows.column(c)[0].as_py() for c in ("k", "shard", "into"))
        merged, where = np.unique(codes, return_inverse=True)
        return _table(_rows(into, k, shard * parts, parts, shard * span, span, merged, np.bincount(where, own).astype(np.int64)))

    finer = elsewhere_counts(grouped.groupBy("k", "shard", "into").applyInArrow(merge, _SENT), shards * parts, wanted, fan)

    def spread(rows: pa.Table, counted: pa.Table) -> pa.Table:
        sizes, codes, own = _columns(rows)
        where = np.unique(codes, return_inverse=True)[1]
        parts_ = sorted(zip(*(counted.column(c).to_pylist() for c in ("part", "n", "rest"))), key=lambda x: x[0])
        outside = np.concatenate([np.empty(0, np.int64), *(unpack(d, n).astype(np.int64) for _, n, d in parts_)])
        return _answer(rows, sizes, (np.bincount(where, own).astype(np.int64) + outside)[where] - own)

    back = finer.select("k", F.floor(F.col("shard") / parts).alias("shard"), F.col("src").alias("into"), F.col("shard").alias("part"), "n", "rest")
    return grouped.groupBy("k", "shard", "into").cogroup(back.groupBy("k", "shard", "into")).applyInArrow(spread, _BACK)


def shard_plan(size: int, order: int, block_bytes: int, shard_ngrams: int, cell: int) -> tuple[int, int, int]:
    """Blocks, shards a block sends to and shards that count, for so many bytes of text."""
    blocks = max(1, math.ceil(size / block_bytes))
    wanted = 1 << max(0, math.ceil(math.log2(max(1, size // 4 * order / shard_ngrams))))
    most = 1 << max(0, int(math.log2(max(1, block_bytes // 6 // cell))))
    return blocks, min(wanted, most), wanted


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, block_bytes: int = BLOCK_BYTES, shard_ngrams: int = SHARD_NGRAMS, cell: int = CELL, fan: int = FAN) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_by_order (words scored by each order from 1), log_score, log_score_per_word."""
    if not 1 <= order <= len(_PLACE):
        raise ValueError(f"order must be from 1 to {len(_PLACE)}")
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    blocks, shards, wanted = shard_plan(size, order, block_bytes, shard_ngrams, cell)
    runs = packed_runs(docs, id_col, text_col, min(RUN_BYTES, max(1, block_bytes // 16)))
    dealt = runs.withColumn("block", F.pmod(F.xxhash64("texts", "ids"), F.lit(blocks)).cast("long"))

    def score(rows: pa.Table, counted: pa.Table) -> pa.Table:
        block = _Block(_texts(rows), order)
        parts = sorted(zip(*(counted.column(c).to_pylist() for c in ("k", "shard", "n", "rest"))), key=lambda x: x[:2])
        elsewhere = [np.concatenate([np.empty(0, np.int64), *(unpack(d, n).astype(np.int64) for kk, _, n, d in parts if kk == k)]) for k in range(order)]
        part, uni, hits = _score(block, elsewhere, alpha)
        by = np.stack([uni, *hits], axis=1).astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(by) + 1) * order, pa.int32()), pa.array(by.ravel()))
        return pa.table([rows.column("ids").combine_chunks().flatten(), pa.array(block.sizes), lists, pa.array(part)], names=["doc_id", "n_words", "n_by_order", "part"])

    back = elsewhere_counts(sent_rows(dealt, order, shards), shards, wanted, fan).withColumnRenamed("src", "block")
    scored = dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, "doc_id long, n_words long, n_by_order array<long>, part double")
    scored = cut(scored, "scored")
    words = scored.agg(F.sum("n_words")).first()[0] or 0
    other = F.greatest(F.lit(words) - F.col("n_words"), F.lit(1))
    total = F.when(F.col("n_words") > 0, F.col("part") - F.col("n_by_order")[0] * F.log(other)).otherwise(0.0)
    return scored.select("doc_id", "n_words", "n_by_order", total.alias("log_score"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("log_score_per_word"))
