"""Near-duplicate documents: MinHash bands for candidates, odd sketches to weed them out, full shingle sets to confirm.

A text is lower-cased (A-Z) and cut into words `[^\\x20\\x09-\\x0D]+`; its set is its distinct five-word shingles (all
its words as one shingle if there are fewer), each as a 64-bit hash. A pass over the texts, in NumPy over a few
megabytes at a time, gives each document 128 MinHash samples, folded in two ways: 32 bands of 4 samples to find
candidates, and a 512-bit odd sketch - the parity, bit by bit, of the samples hashed to it. For candidates the population count of
the XOR of two sketches estimates the similarity; pairs estimated far below the threshold (five standard deviations) go
no further. For the rest the full sets are made again from the texts - of these documents only - and compared exactly.

Documents with equal sets form one class and only its smallest id goes on, so copies give no pairs. Large buckets are
compared with a pivot, and what that leaves open block by block within tasks (linking.link_groups). A pair of similarity 0.75 shares no band with probability 5e-6, and 1e-7 is
lost to the sketch; both fall off steeply above.

Defined results: null, empty and blank texts have an empty set, link with nothing and are kept; a null id is kept and
links with nothing; rows that share an id count as one document; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linking import link_groups, live_buckets, spread_join
from .shared import cut, drop_cut, released, sieve, sieve_bits, sift, without

WORDS = 5
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS = 512
LINK_PERCENT = 75
#: Pairs that the odd sketch puts below this similarity are dropped: 5 standard deviations under the threshold.
SKETCH_FLOOR = 0.45
CHUNK = 1 << 20

_rng = np.random.default_rng(0x5EED)
_BYTE = _rng.integers(0, 1 << 64, 256, np.uint64)
_PLACE = _rng.integers(0, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_FEW = _rng.integers(0, 1 << 64, WORDS, np.uint64)
_MUL = _rng.integers(0, 1 << 31, SAMPLES, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SAMPLES, np.uint32)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x + np.uint64(salt)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, at least n of each."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(max(n, CHUNK + 1), base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def _word_hashes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of lower-cased bytes, and the words' first places."""
    gap = np.empty(len(text) + 2, bool)
    gap[0] = gap[-1] = True
    np.less_equal(text - np.uint8(9), 4, out=gap[1:-1])
    gap[1:-1] |= text == 32
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    up, down = _tables(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum(_BYTE[text] * up[: len(text)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * down[start], 0x51), start


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of about a chunk, cut at white space."""
    at = 0
    while len(text) - at > 4 * CHUNK:
        cuts = [k for c in b" \t\n\v\f\r" if (k := text.find(bytes([c]), at + CHUNK)) >= 0]
        if not cuts:
            break
        yield text[at : min(cuts)]
        at = min(cuts)
    yield text[at:]


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Each text's set: sorted distinct 64-bit hashes of its shingles."""
    i = 0
    while i < len(texts):
        if len(texts[i]) > CHUNK:
            words = np.concatenate([_word_hashes(np.frombuffer(p, np.uint8))[0] for p in _pieces(texts[i].lower())])
            yield _set(words, _shingles(words))
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j]) + 1
            j += 1
        words, at = _word_hashes(np.frombuffer(b" ".join(texts[i:j]).lower(), np.uint8))
        shingles = _shingles(words)
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[i:j]])))
        bounds = np.searchsorted(at, begins)
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield _set(words[a:b], shingles[a : max(a, b - WORDS + 1)])
        i = j


def text_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after another, and each text's number of words."""
    found, counts, i = [np.empty(0, np.uint64)], [], 0
    while i < len(texts):
        if len(texts[i]) > CHUNK:
            parts = [_word_hashes(np.frombuffer(p, np.uint8))[0] for p in _pieces(texts[i].lower())]
            found += parts
            counts.append(sum(map(len, parts)))
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j]) + 1
            j += 1
        words, at = _word_hashes(np.frombuffer(b" ".join(texts[i:j]).lower(), np.uint8))
        found.append(words)
        counts += np.diff(np.searchsorted(at, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts[i:j]]))))).tolist()
        i = j
    return np.concatenate(found), np.array(counts, np.int64)


def _shingles(words: np.ndarray) -> np.ndarray:
    n = len(words) - WORDS + 1
    if n < 1:
        return np.empty(0, np.uint64)
    total = words[:n] * _PLACE[0]
    for k in range(1, WORDS):
        total += words[k : k + n] * _PLACE[k]
    return _mix(total)


def _set(words: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    if len(words) < WORDS:
        return _mix((words * _PLACE[: len(words)]).sum(keepdims=True) + _FEW[len(words)]) if len(words) else shingles
    s = np.sort(shingles)
    keep = np.empty(len(s), bool)
    keep[:1] = True
    np.not_equal(s[1:], s[:-1], out=keep[1:])
    return s[keep]


def samples(found: np.ndarray) -> np.ndarray:
    """The 128 MinHash samples of a non-empty set."""
    low, best = (found >> np.uint64(32)).astype(np.uint32), np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), 1024):
        x = low[None, i : i + 1024] * _MUL[:, None]
        x += _ADD[:, None]
        np.minimum(best, x.min(axis=1), out=best)
    return best


def bands_of(mins: np.ndarray) -> np.ndarray:
    """Band keys of rows of samples: rows x 32 signed 64-bit hashes."""
    x = mins.reshape(-1, BANDS, ROWS).astype(np.uint64)
    return _mix((x * _PLACE[None, None, :ROWS]).sum(axis=2) + np.arange(BANDS, dtype=np.uint64) * np.uint64(_BASE)).view(np.int64)


def sketches_of(mins: np.ndarray) -> np.ndarray:
    """Odd sketches of rows of samples: rows x 8 signed 64-bit words."""
    n = len(mins)
    bit = _mix(mins.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)), 0x0DD) % np.uint64(SKETCH_BITS)
    flat = (bit + np.arange(n, dtype=np.uint64)[:, None] * np.uint64(SKETCH_BITS)).ravel().astype(np.int64)
    odd = (np.bincount(flat, minlength=n * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64).reshape(n, SKETCH_BITS // 64)


def most_differing_bits(similarity: float) -> int:
    """Expected XOR count of the sketches of two sets of that similarity."""
    return int(SKETCH_BITS / 2 * (1 - np.exp(-4 * SAMPLES * (1 - similarity) / SKETCH_BITS)))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


#: Texts are taken in runs of about so many bytes, as their sizes, not their number, decide the memory.
RUN_BYTES, RUN_ROWS = 8 << 20, 1000


def byte_runs(texts: pa.Array, most: int = RUN_BYTES, rows: int = RUN_ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours of at most `most` bytes together, and at most `rows`; a longer text is a range of its own."""
    sizes = pa.compute.binary_length(texts).fill_null(0).to_numpy()
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        before = int(ends[at - 1]) if at else 0
        stop = min(max(at + 1, int(np.searchsorted(ends, before + most, "right"))), at + rows)
        yield at, stop
        at = stop


SIGNATURE = "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>"


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, h1 and h2 (a 128-bit hash of the set), bands, sketch; the last four null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, stop in byte_runs(whole.column(1)):
                batch = whole.slice(at, stop - at)
                n, h1, h2, mins = [], [], [], np.zeros((batch.num_rows, SAMPLES), np.uint32)
                for i, s in enumerate(shingle_sets(batch.column(1).cast(pa.binary()).to_pylist())):
                    n.append(len(s))
                    h1.append(int(_mix(s, 1).sum()))
                    h2.append(int(_mix(s, 2).sum()))
                    if len(s):
                        mins[i] = samples(s)
                none = np.array(n) == 0
                lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()), mask=pa.array(none))
                longs = lambda x: pa.array(np.array(x, np.uint64).view(np.int64), mask=none)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), longs(h1), longs(h2), lists(bands_of(mins)), lists(sketches_of(mins))], names=["doc_id", "n_shingles", "h1", "h2", "bands", "sketch"])

    return _rows(docs, id_col, text_col).mapInArrow(released(run), SIGNATURE)


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and set (its hashes as bytes) of the documents with these ids, and perhaps of a few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, stop in byte_runs(whole.column(1)):
                batch = whole.slice(at, stop - at)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(batch.column(1).cast(pa.binary()).to_pylist())], pa.binary())], names=["doc_id", "set"])

    bits = sieve_bits(ids.count())
    rows = sift(_rows(docs, id_col, text_col), F.col("doc_id"), sieve(ids, F.col("id"), bits), "hit", bits).where("hit").drop("hit")
    return rows.mapInArrow(released(run), "doc_id long, set binary")


def _wanted_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and set of the documents with these ids (a cut table)."""
    return cut(_sets(docs, ids, id_col, text_col).join(ids, F.col("doc_id") == F.col("id"), "left_semi"), "sets")


def _fits(a: Column, b: Column) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * LINK_PERCENT


def _confirmed(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    side = lambda x: sketches.select(F.col("doc_id").alias(x), F.col("sketch").alias(f"sketch_{x}"))
    near = spread_join(spread_join(pairs, side("a"), ["a"]), side("b"), ["b"])
    differing = sum((F.bit_count(F.col("sketch_a")[i].bitwiseXOR(F.col("sketch_b")[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.col("sketch_a")[0].bitwiseXOR(F.col("sketch_b")[0])))
    near = cut(near.where(differing <= most_differing_bits(SKETCH_FLOOR)).select("a", "b"), "near")
    ids = cut(near.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = _wanted_sets(docs, ids, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                k = np.searchsorted(q, p)
                both = int((q[np.minimum(k, len(q) - 1)] == p).sum())
                keep.append(100 * both >= LINK_PERCENT * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_sets = spread_join(near, sets.select(F.col("doc_id").alias("a"), F.col("set").alias("set_a")), ["a"])
    with_sets = spread_join(with_sets, sets.select(F.col("doc_id").alias("b"), F.col("set").alias("set_b")), ["b"])
    links = cut(with_sets.select("a", "b", "set_a", "set_b").mapInArrow(released(run), "a long, b long"), "confirmed")
    for table in (near, ids, sets):
        drop_cut(table)
    return links


#: Bytes of the sets in a block of a large bucket: what a task holds is at most two blocks.
BLOCK = 16 << 20


def links_in_block(part: np.ndarray, same_block: bool, labels: np.ndarray, sizes: np.ndarray, sketches: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that join different labels among the members of two blocks (or of one), enough to join all that are linked.

    Sketches are compared first; then a member's set is held against all sets that are left at once.
    """
    most, ends = most_differing_bits(SKETCH_FLOOR), np.cumsum(sizes)
    flat, labels, out = None, labels.copy(), []
    for a in range(len(part) - 1):
        b = np.arange(a + 1, len(part))
        b = b[(labels[b] != labels[a]) & (np.minimum(sizes[b], sizes[a]) * 100 >= np.maximum(sizes[b], sizes[a]) * LINK_PERCENT)]
        if not same_block:
            b = b[part[b] != part[a]]
        b = b[np.bitwise_count(sketches[b] ^ sketches[a]).sum(axis=1) <= most] if len(b) else b
        if not len(b):
            continue
        if flat is None:
            flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
            has = np.zeros(int(flat.max()) + 1, np.bool_)
        own = flat[ends[a] - sizes[a] : ends[a]]
        has[own] = True
        if int(sizes[b].sum()) * 4 > len(flat):
            sums = np.concatenate(([0], np.cumsum(has[flat])))
            both = sums[ends[b]] - sums[ends[b] - sizes[b]]
        else:
            both = np.array([np.count_nonzero(has[flat[ends[x] - sizes[x] : ends[x]]]) for x in b])
        has[own] = False
        for x in b[100 * both >= LINK_PERCENT * (sizes[a] + sizes[b] - both)]:
            if labels[x] != labels[a]:
                out.append((a, int(x)))
                labels[labels == labels[x]] = labels[a]
    return out


def _within(rows: DataFrame, heads: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ids = cut(rows.select("id").distinct(), "ids")
    sets = _wanted_sets(docs, ids, id_col, text_col).withColumnRenamed("doc_id", "id")
    full = spread_join(spread_join(rows, sets, ["id"]), heads.select(F.col("doc_id").alias("id"), "sketch"), ["id"])

    def run(table: pa.Table) -> pa.Table:
        part, labels = (table.column(c).to_numpy() for c in ("part", "label"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("set")]
        sketches = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(sets), -1)
        found = links_in_block(part, table.column("i")[0] == table.column("j")[0], labels, np.array([len(s) for s in sets]), sketches, sets)
        ids = table.column("id").to_numpy()
        return pa.table({"a": pa.array([ids[a] for a, _ in found], pa.int64()), "b": pa.array([ids[b] for _, b in found], pa.int64())})

    return full.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_shingles, component_id (the smallest id that links lead to), kept (it is its own component_id), class_id (the smallest id with the same set)."""
    sig = cut(signatures(docs, id_col, text_col), "signatures")
    full = sig.where("n_shingles > 0 and doc_id is not null")
    classes = cut(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("n")), "classes")
    heads = spread_join(full, classes.select("h1", "h2", "class_id"), ["h1", "h2"]).where("doc_id = class_id").dropDuplicates(["h1", "h2"])
    heads = cut(heads.select("doc_id", "n_shingles", "bands", "sketch"), "heads")
    members = heads.select(F.explode("bands").alias("bucket"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("size"))
    live = live_buckets(members)
    links = link_groups(live, lambda pairs: _confirmed(pairs, heads.select("doc_id", "sketch"), docs, id_col, text_col), lambda rows: _within(rows, heads, docs, id_col, text_col), _fits, BLOCK, lambda size: size * 8)
    placed = classes.join(links, F.col("class_id") == F.col("id"), "left").select("h1", "h2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    linked = spread_join(full.select("doc_id", "n_shingles", "h1", "h2"), placed, ["h1", "h2"]).select("doc_id", "n_shingles", "component_id", "class_id")
    alone = sig.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.col("doc_id").alias("class_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "n_shingles", "component_id", "kept", "class_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with their own columns: one document of each group."""
    gone = cut(near_groups(docs, id_col, text_col).where("not kept").select(F.col("doc_id").alias("id")).distinct(), "gone")
    return without(docs, gone, id_col)
