"""SentencePiece encoding and decoding with seeded merge-dropout.

Encoding follows the BPE model: symbols of a unit merge in order of the merged piece's rank, leftmost first, from an
agenda; each candidate merge that comes up is skipped when a hash keyed by seed, document, the unit's place in the text,
the place in the unit and the merged piece falls below `dropout`. With dropout 0 the result is the model's own. So every occurrence of
a word is cut by draws of its own, and always alike when run again, on any machine. No cuts are cached; the agendas of
many units go on side by side, in NumPy.

Pieces join neither across a space's left side nor across a character that no piece holds, so texts are cut into units
there. Characters without a piece become byte pieces, and so does a literal U+2581, the model's mark for a space:
decoding gives every text back exactly.

Defined results: null and empty texts give no pieces; a null id draws by the text instead; rows that share an id share their
draws at equal places; a text is cut whole, however long, its units some thousands at a time; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash_dedup import byte_runs
from .shared import released

SPACE = "▁"
LITERAL = "\x00▁"  # a symbol for U+2581 in the text: no piece holds it
UNITS_AT_ONCE = 16_384
SHORT = 24
TEXTS_AT_ONCE, BYTES_AT_ONCE = 200, 4 << 20
_M64, _NEVER, _NONE = (1 << 64) - 1, 1 << 62, (1 << 31) - 1
_K1, _K2, _K3, _K4 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _skipped(base: int, place: int, rank: int, limit: int) -> bool:
    """The keyed draw of a candidate: of an occurrence's key, the place of its first character and the merged piece."""
    x = (base ^ (place * _K1) ^ (rank * _K2)) & _M64
    x = ((x ^ (x >> 31)) * _K3) & _M64
    x = ((x ^ (x >> 29)) * _K4) & _M64
    return x ^ (x >> 32) < limit


def _merge_short(symbols: list[str], rank: dict[str, int], base: int, limit: int) -> list[str]:
    """The agenda as a list, a rank for each pair of neighbours: the fastest for short units."""
    get = rank.get
    ranks = [get(a + b, _NEVER) for a, b in zip(symbols, symbols[1:])]
    places = list(range(len(symbols)))
    while ranks and (r := min(ranks)) != _NEVER:
        i = ranks.index(r)
        if limit and _skipped(base, places[i], r, limit):
            ranks[i] = _NEVER
            continue
        symbols[i : i + 2] = [merged := symbols[i] + symbols[i + 1]]
        del places[i + 1], ranks[i]
        if i < len(ranks):
            ranks[i] = get(merged + symbols[i + 1], _NEVER)
        if i:
            ranks[i - 1] = get(symbols[i - 1] + merged, _NEVER)
    return symbols


def _merge_long(symbols: list[str], rank: dict[str, int], base: int, limit: int) -> list[str]:
    """The agenda as a heap: the time for n characters grows as n log n."""
    n, parts = len(symbols), list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    agenda = [(r, i, i + 1, len(parts[i]) + len(parts[i + 1])) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(agenda)
    while agenda:
        r, i, j, size = heapq.heappop(agenda)
        left, right = parts[i], parts[j]
        if not left or not right or after[i] != j or len(left) + len(right) != size or limit and _skipped(base, i, r, limit):
            continue
        merged = left + right
        parts[i], parts[j] = merged, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (q := rank.get(merged + parts[k])) is not None:
                heapq.heappush(agenda, (q, i, k, size + len(parts[k])))
        if (k := before[i]) >= 0 and (q := rank.get(parts[k] + merged)) is not None:
            heapq.heappush(agenda, (q, k, i, size + len(parts[k])))
    return [p for p in parts if p]


def _skipped_many(base: np.ndarray, place: np.ndarray, rank: np.ndarray, limit: int) -> np.ndarray:
    x = base ^ place.astype(np.uint64) * np.uint64(_K1) ^ rank.astype(np.uint64) * np.uint64(_K2)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(_K3)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_K4)
    return x ^ (x >> np.uint64(32)) < np.uint64(min(limit, _M64))


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(_K1) >> np.uint64(64 - bits)).astype(np.int64)


def _hash_table(pairs: list[tuple[int, int]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (-1: free) and values of a table of open addresses: much faster to ask than a sorted one."""
    keys, values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
    for (key, value), at in zip(pairs, _slots(np.array([k for k, _ in pairs], np.int64), bits).tolist() if pairs else []):
        while keys[at] >= 0:
            at = (at + 1) & ((1 << bits) - 1)
        keys[at], values[at] = key, value
    return keys, values


class PieceModel:
    """Pieces, ranks and bytes of a model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        size = sp.vocab_size()
        self.ids = {sp.id_to_piece(i): i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # scores fall as ids grow in such models; ranks are taken from the scores, so that another order also works
        by_score = sorted(self.ids.items(), key=lambda x: (-sp.get_score(x[1]), x[1]))
        self.rank = {p: r for r, (p, _) in enumerate(by_score)}
        self.bytes_of = [b""] * size
        for p, i in self.ids.items():
            self.bytes_of[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.bytes_of[i] = bytes([b])
        self.char_ids = np.full(0x110000, -1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        self.char_ids[ord(" ")], self.char_ids[ord(SPACE)] = self.char_ids[ord(SPACE)], -1
        pairs = sorted((self.ids[p[:k]] * size + self.ids[p[k:]], r) for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids)
        self.bits = max(10, (8 * len(pairs)).bit_length())
        self.pairs, self.pair_ranks = _hash_table(pairs, self.bits)
        self.rank_ids = np.array([i for _, i in by_score], np.int32)
        # a line break may end a unit if no piece holds one
        self.units = re.compile(r" *[^ \n]+| +|\n" if not any("\n" in p for p in self.ids) else r" *[^ ]+| +")

    def segment(self, unit: str, dropout: float, key: int = 0) -> list[int]:
        """Ids of a unit (a run of spaces and what follows up to the next space)."""
        symbols = list(unit.replace(" ", SPACE)) if SPACE not in unit else [SPACE if c == " " else LITERAL if c == SPACE else c for c in unit]
        symbols = (_merge_short if len(symbols) <= SHORT else _merge_long)(symbols, self.rank, key, int(dropout * (1 << 64)))
        out = []
        for s in symbols:
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in (SPACE if s == LITERAL else s).encode()]
        return out

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * len(self.bytes_of) + right
        at = _slots(key, self.bits)
        found = self.pairs[at]
        out = self.pair_ranks[at]
        other = found != key
        out[other] = _NONE
        open_ = np.flatnonzero(other & (found >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.pairs[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.pair_ranks[at[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def _merge_many(self, ids: np.ndarray, sizes: np.ndarray, base: np.ndarray, limit: int) -> np.ndarray:
        """_merge_short for many units at once: a row of symbol ids each, one step of every row's agenda at a time. -1: no symbol."""
        n, width = ids.shape
        after, before = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1)), np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        ranks = np.full((n, width), _NONE, np.int32)
        row, col = np.nonzero(np.arange(1, width + 1) < sizes[:, None])
        ranks[row, col] = self._pair_ranks(ids[row, col], ids[row, col + 1])
        live = np.arange(n)
        while len(live):
            place = ranks[live].argmin(axis=1)
            best = ranks[live, place]
            go = best != _NONE
            live, place, best = live[go], place[go], best[go]
            if not len(live):
                break
            if limit:
                out = _skipped_many(base[live], place, best, limit)
                ranks[live[out], place[out]] = _NONE
                row, i, r = live[~out], place[~out], best[~out]
            else:
                row, i, r = live, place, best
            j = after[row, i]
            k = after[row, j]
            ids[row, i] = merged = self.rank_ids[r]
            ids[row, j], ranks[row, j], ranks[row, i], after[row, i] = -1, _NONE, _NONE, k
            on = k < sizes[row]
            x, y = row[on], k[on]
            before[x, y] = i[on]
            ranks[x, i[on]] = self._pair_ranks(merged[on], ids[x, y])
            k = before[row, i]
            on = k >= 0
            x, y = row[on], k[on]
            ranks[x, y] = self._pair_ranks(ids[x, y], merged[on])
        return ids

    def segment_many(self, units: list[str], dropout: float, keys: list[int] | np.ndarray) -> list[bytes]:
        """segment() of each unit with its key, as little-endian uint32 bytes."""
        out: list[bytes] = [b""] * len(units)
        sizes = np.array([len(u) for u in units], np.int64)
        base = np.asarray(keys, np.uint64)
        alone = sizes > SHORT
        for low, high in ((0, 8), (8, 14), (14, SHORT)):
            some = np.flatnonzero((sizes > low) & (sizes <= high))
            points = np.frombuffer("".join([units[i] for i in some]).encode("utf-32-le"), np.uint32)
            ids = np.full((len(some), high), -1, np.int32)
            there = np.arange(high) < sizes[some, None]
            ids[there] = self.char_ids[points]
            odd = (ids < 0).sum(axis=1) > high - sizes[some]
            alone[some[odd]] = True
            some = some[~odd]
            ids = self._merge_many(ids[~odd], sizes[some], base[some], int(dropout * (1 << 64)))
            raw, stops = ids[ids >= 0].astype("<u4").tobytes(), np.cumsum((ids >= 0).sum(axis=1)) * 4
            begin = 0
            for i, stop in zip(some.tolist(), stops.tolist()):
                out[i] = raw[begin:stop]
                begin = stop
        for i in np.flatnonzero(alone).tolist():
            out[i] = array("I", self.segment(units[i], dropout, int(keys[i]))).tobytes()
        return out

    def decode(self, ids) -> str:
        """The text that `ids` stand for: without the space that encoding puts in front."""
        return b"".join(map(self.bytes_of.__getitem__, ids))[1:].decode()


class DropoutEncoder:
    """Encodes texts, each by its key. Nothing is kept from text to text: every occurrence of a unit has draws of its own."""

    def __init__(self, path: str, dropout: float, seed: int, most: int = UNITS_AT_ONCE):
        if not 0 <= dropout <= 1:
            raise ValueError("dropout must be in [0, 1]")
        self.model, self.dropout, self.seed, self.most = piece_model(path), dropout, seed, most

    def key(self, doc_id: int | None, text: str = "") -> int:
        """The key of a document's draws."""
        name = f"{self.seed}/{doc_id}" if doc_id is not None else f"{self.seed}//{text}"
        return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")

    @staticmethod
    def occurrence_keys(key: int, n: int) -> np.ndarray:
        """A key for each of a document's n units, by place."""
        x = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(_K1) + np.uint64(key)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_K3)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_K4)
        return x ^ (x >> np.uint64(31))

    def encode_all(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Ids of each text by its key."""
        find = self.model.units.findall
        cut = [find(" " + t) if t else [] for t in texts]
        units = [u for x in cut for u in x]
        own = np.concatenate([np.zeros(0, np.uint64), *[self.occurrence_keys(k, len(x)) for k, x in zip(keys, cut)]])
        ids: list[bytes] = []
        for at in range(0, len(units), self.most):
            ids += self.model.segment_many(units[at : at + self.most], self.dropout, own[at : at + self.most])
        out, begin = [], 0
        for x in cut:
            out.append(np.frombuffer(b"".join(ids[begin : begin + len(x)]), "<u4"))
            begin += len(x)
        return out

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        return self.encode_all([text], [key])[0]


_models: dict = {}
_encoders: dict = {}


def piece_model(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encoder(path: str, dropout: float, seed: int) -> DropoutEncoder:
    key = (path, dropout, seed)
    if key not in _encoders:
        _encoders[key] = DropoutEncoder(*key)
    return _encoders[key]


def encode_pieces(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes (of the text), n_pieces, lossless (the ids were decoded and gave the text), ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model, dropout, seed)
        for whole in batches:
            for at, stop in byte_runs(whole.column(1), BYTES_AT_ONCE, TEXTS_AT_ONCE):
                batch = whole.slice(at, stop - at)
                texts = batch.column(1).to_pylist()
                ids = enc.encode_all(texts, [enc.key(x, t) for x, t in zip(batch.column(0).to_pylist(), texts)])
                sizes = pa.compute.binary_length(batch.column(1))
                same = [enc.model.decode(x.tolist()) == t for x, t in zip(ids, texts)]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0), sizes.cast(pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(same, pa.bool_()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32))),
                    ],
                    names=["doc_id", "n_bytes", "n_pieces", "lossless", "ids"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, n_bytes long, n_pieces long, lossless boolean, ids array<int>")


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "ids", id_col: str = "doc_id") -> DataFrame:
    """doc_id and the text that its ids stand for. Null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = piece_model(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.decode(x.as_py() or []) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, text string")
