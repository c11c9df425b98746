"""Adapter trimming: where an adapter stands in a read, with errors, and what the trimmed read retains.

Homopolymers are found by column expressions. Other adapters are aligned in an Arrow-batched function, for all reads of
a batch at once; a native filter on the adapter's 5-mers comes first, and reads that share none never leave the JVM's
side of the decision: they can't hold the adapter.

Where an end is cut free depends on the adapter's end and location: at the 3' end the read's front is free, and behind
the match either the read's rest or the adapter's rest (anywhere), only the adapter's (non_internal), or neither
(anchored); at the 5' end the same, mirrored. An adapter is found if errors are at most a tenth of the aligned bases.
Among equal scores the smallest position in the read wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import TRIM_RESULT, which_read

# fixed values: scoring and limits
MATCH, ERROR = 1, -2
KMER, MOST_ERRORS = 5, 0.1
ENDS, LOCATIONS = ("three_prime", "five_prime"), ("anywhere", "non_internal", "anchored")
_FIELDS = TRIM_RESULT.fieldNames()
_FAR = -(1 << 20)


@dataclass(frozen=True)
class Adapter:
    name: str
    end: str
    location: str
    seq: str

    def __post_init__(self):
        if self.end not in ENDS or self.location not in LOCATIONS:
            raise ValueError(f"{self.name}: not an end or a location")
        if len(self.seq) < KMER:
            raise ValueError(f"{self.name}: shorter than {KMER} bases")

    @property
    def homopolymer(self) -> bool:
        return len(set(self.seq)) == 1


def _ranges(adapter: Adapter, start, end, length, score) -> list:
    """adapter, trim and retain ranges and the score, in the order of the result's fields."""
    if adapter.end == "three_prime":
        return [start, end, start, length, 0 * start, start, score]
    return [start, end, 0 * start, end, end, length, score]


def find_homopolymer(seq: Column | str, adapter: Adapter) -> Column:
    """The result struct for a homopolymer adapter; null if it isn't found. A window is valid from 5 bases on; the most
    matches win, then the fewest errors, then the first position."""
    s = F.col(seq) if isinstance(seq, str) else seq
    m, n, base = len(adapter.seq), F.length(s), adapter.seq[0]
    if adapter.end == "three_prime":
        low = {"anywhere": F.lit(0), "non_internal": F.greatest(n - m, F.lit(0)), "anchored": F.greatest(n - m, F.lit(0))}[adapter.location]
        high = {"anywhere": n, "non_internal": n, "anchored": F.greatest(n - m + 1, F.when(n < m, F.lit(1)).otherwise(F.lit(0)))}[adapter.location]
        start, end = lambda p: p, lambda p: F.least(n, p + m)
    else:
        low = F.lit(m) if adapter.location == "anchored" else F.lit(0)
        # the read's own end is left out for anywhere; the others stop at the read's end if it is shorter
        high = n if adapter.location == "anywhere" else F.least(F.lit(m), n) + 1
        start, end = lambda p: F.greatest(p - m, F.lit(0)), lambda p: p
    places = F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))

    def window(p: Column) -> Column:
        bases = F.substr(s, start(p) + 1, end(p) - start(p))
        size = F.length(bases)
        matches = size - F.length(F.replace(bases, F.lit(base), F.lit("")))
        good = (size >= KMER) & ((size - matches) * 10 <= size)
        return F.when(good, F.struct(matches.alias("matches"), (matches - size).alias("errors"), (-p).alias("place")))

    def result(best: Column) -> Column:
        place = -best["place"]
        score = best["matches"] * MATCH - best["errors"] * ERROR
        values = _ranges(adapter, start(place), end(place), n, score)
        return F.when(best.isNotNull(), F.struct(*[v.cast("int").alias(f) for v, f in zip(values, _FIELDS)]))

    # the best window is bound once: its fields are named many times
    return F.get(F.transform(F.array(F.array_max(F.transform(places, window))), result), F.lit(0))


def kmer_filter(seq: Column | str, adapter: Adapter) -> Column:
    """Whether the read holds any of the adapter's 5-mers."""
    s = F.col(seq) if isinstance(seq, str) else seq
    kmers = dict.fromkeys(adapter.seq[i : i + KMER] for i in range(len(adapter.seq) - KMER + 1))
    return s.rlike("|".join(kmers))


def align(reads: list[str], adapter: Adapter) -> np.ndarray:
    """rows: found, start, end, score of each read. Dynamic programming over bases, all reads at once.

    A five-prime adapter is the mirror image of a three-prime one in mirrored reads, but for the choice among equals.
    """
    mirrored = adapter.end == "five_prime"
    text = adapter.seq[::-1] if mirrored else adapter.seq
    lengths = np.array([len(r) for r in reads], np.int32)
    n, m, b = int(lengths.max(initial=0)), len(text), len(reads)
    bases = np.zeros((n, b), np.uint8)
    for k, r in enumerate(reads):
        bases[: len(r), k] = np.frombuffer((r[::-1] if mirrored else r).encode(), np.uint8)
    letters = np.frombuffer(text.encode(), np.uint8)
    # per adapter place: score, first read place, errors, operations of the best path that ends here
    score = np.tile((np.arange(m + 1) * ERROR).astype(np.int32)[:, None], (1, b))
    begin, errors, steps = np.zeros((m + 1, b), np.int32), np.tile(np.arange(m + 1, dtype=np.int32)[:, None], (1, b)), np.tile(np.arange(m + 1, dtype=np.int32)[:, None], (1, b))
    best = np.full((5, b), _FAR, np.int32)  # score, end, begin, errors, steps

    def offer(at: np.ndarray, i: int, j: int) -> None:
        better = at & ((score[i] >= best[0]) if mirrored else (score[i] > best[0]))
        for row, value in enumerate((score[i], j, begin[i], errors[i], steps[i])):
            best[row] = np.where(better, value, best[row])

    for j in range(n + 1):
        if j:
            old = score, begin, errors, steps
            score, begin, errors, steps = (np.empty_like(x) for x in old)
            score[0], begin[0], errors[0], steps[0] = 0, j, 0, 0
            same = bases[j - 1][None, :] == letters[:, None]
            for i in range(1, m + 1):
                diagonal = old[0][i - 1] + np.where(same[i - 1], MATCH, ERROR)
                read_gap, adapter_gap = old[0][i] + ERROR, score[i - 1] + ERROR
                use = np.where((diagonal >= read_gap) & (diagonal >= adapter_gap), 0, np.where(read_gap >= adapter_gap, 1, 2))
                score[i] = np.choose(use, (diagonal, read_gap, adapter_gap))
                begin[i] = np.choose(use, (old[1][i - 1], old[1][i], begin[i - 1]))
                errors[i] = np.choose(use, (old[2][i - 1] + ~same[i - 1], old[2][i] + 1, errors[i - 1] + 1))
                steps[i] = np.choose(use, (old[3][i - 1], old[3][i], steps[i - 1])) + 1
        inside, at_end = j <= lengths, j == lengths
        if adapter.location == "anywhere":
            offer(inside, m, j)
        elif adapter.location == "anchored":
            offer(at_end, m, j)
        if adapter.location != "anchored" and at_end.any():
            for i in range(KMER, m + 1):
                offer(at_end, i, j)
    value, end, start, wrong, ops = best
    found = (value > _FAR) & (ops > 0) & (wrong <= MOST_ERRORS * np.minimum(ops, m) + 1e-9) & (ops - wrong >= KMER)
    if mirrored:
        start, end = lengths - end, lengths - start
    return np.stack([found, start, end, value])


def alike_lengths(lengths: np.ndarray, m: int, cells: int = 1 << 22) -> Iterator[np.ndarray]:
    """Places of the reads that are there (length not NaN), in groups of similar length: a long read costs nobody else a long table."""
    by = np.argsort(lengths, kind="stable")
    by = by[~np.isnan(lengths[by])]
    at = 0
    while at < len(by):
        first = lengths[by[at]]
        stop = int(np.searchsorted(lengths[by], first * 1.25 + 8, "right"))
        stop = min(stop, at + max(1, int(cells // ((first * 1.25 + 8) + m))), at + 4096)
        yield np.sort(by[at:stop])
        at = stop


_TRIM_DDL = ", ".join(f"{f} int" for f in _FIELDS)


def find_adapter(seq: Column | str, adapter: Adapter) -> Column:
    """The result struct of an adapter in a read (a column); null if it isn't found."""
    if adapter.homopolymer:
        return find_homopolymer(seq, adapter)

    @F.pandas_udf(_TRIM_DDL)
    def aligned(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for reads in batches:
            out = np.full((len(reads), len(_FIELDS)), np.nan)
            for part in alike_lengths(reads.str.len().to_numpy(np.float64, na_value=np.nan), len(adapter.seq)):
                some = reads.iloc[part].tolist()
                found, start, end, score = align(some, adapter)
                hit = found.astype(bool)
                values = _ranges(adapter, start, end, np.array([len(r) for r in some]), score)
                out[part[hit]] = np.stack(values, axis=1)[hit]
            yield pd.DataFrame(out, columns=_FIELDS).astype("Int32")

    s = F.col(seq) if isinstance(seq, str) else seq
    found = aligned(F.when(kmer_filter(s, adapter), s))
    return F.when(found["score"].isNotNull(), found)


def retained(seq: Column | str, results: list[Column]) -> tuple[Column, Column]:
    """Start and end of what all results leave of a read: the intersection of their retained ranges; absent results leave all."""
    s = F.col(seq) if isinstance(seq, str) else seq
    start, end = F.lit(0), F.length(s)
    for r in results:
        end_ = F.least(end, r["retain_end"])
        start, end = F.least(F.greatest(start, r["retain_start"]), end_), end_
    return start, end


class AdapterCatalog:
    """Adapters by read; names are unique over both reads, and index reads have none."""

    def __init__(self, adapters: dict[str, list[Adapter]] | None = None):
        self.adapters: dict[str, list[Adapter]] = {"r1": [], "r2": []}
        for read, items in (adapters or {}).items():
            for a in items:
                self.add(read, a)

    def add(self, read: str, adapter: Adapter) -> None:
        read = which_read(read)
        if read not in self.adapters:
            raise ValueError("index reads have no adapters")
        if any(a.name == adapter.name for items in self.adapters.values() for a in items):
            raise ValueError(f"two adapters are named {adapter.name}")
        self.adapters[read].append(adapter)

    def of(self, read: str) -> list[Adapter]:
        read = which_read(read)
        if read not in self.adapters:
            raise ValueError("index reads have no adapters")
        return self.adapters[read]

    def trim(self, pairs):
        """Pairs with R1 and R2 cut to what all their adapters leave."""
        from .readpairs import record

        for read, items in self.adapters.items():
            if items:
                seq, own = F.col(f"{read}.seq"), f"_hit_{uuid.uuid4().hex}_"
                for k, a in enumerate(items):
                    pairs = pairs.withColumn(f"{own}{k}", find_adapter(seq, a))
                start, end = retained(seq, [F.col(f"{own}{k}") for k in range(len(items))])
                cut = lambda part: F.substr(F.col(f"{read}.{part}"), start + 1, end - start)  # noqa: B023, E731
                pairs = pairs.withColumn(read, F.when(F.col(read).isNotNull(), record(f"{read}.header", cut("seq"), cut("qual"))))
                pairs = pairs.drop(*[f"{own}{k}" for k in range(len(items))])
        return pairs
