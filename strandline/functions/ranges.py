"""Ranges of a read: which read, offset and an optional length (open ranges run to the read's end).

ReadRange is the value for plans; the functions below do the same on columns, where a null length is open.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import READ_NAMES, READS, which_read

OPEN = 0x7FFF


def _col(x: Column | str | int | None) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


@dataclass(frozen=True)
class ReadRange:
    read: str
    offset: int
    len: int | None = None

    def __post_init__(self):
        object.__setattr__(self, "read", which_read(self.read))
        if not 0 <= self.offset < 1 << 15:
            raise ValueError(f"offset {self.offset} is not below 32768")
        if self.len is not None and not 0 <= self.len < OPEN:
            raise ValueError(f"length {self.len} is not below 32767")

    @property
    def end(self) -> int | None:
        return None if self.len is None else self.offset + self.len

    def packed(self) -> int:
        """Two bits of read, 15 of offset, 15 of length; ordered as (read, offset, length), open last."""
        return READS.index(self.read) << 30 | self.offset << 15 | (OPEN if self.len is None else self.len)

    @staticmethod
    def unpacked(value: int) -> ReadRange:
        size = value & OPEN
        return ReadRange(READS[value >> 30], value >> 15 & OPEN, None if size == OPEN else size)

    def __lt__(self, other: ReadRange) -> bool:
        return self.packed() < other.packed()

    def intersect(self, other: ReadRange) -> ReadRange:
        if self.read != other.read:
            raise ValueError(f"{self} and {other} are of different reads")
        ends = [x.end for x in (self, other) if x.end is not None]
        offset = max(self.offset, other.offset)
        if not ends:
            return replace(self, offset=offset)
        offset = min(min(ends), offset)
        return ReadRange(self.read, offset, min(ends) - offset)

    def shrink(self, start: int, end: int) -> ReadRange:
        """The sub-range start..end, counted within this range."""
        if start > end or self.len is not None and end > self.len:
            raise ValueError(f"{start}..{end} is not a range within {self}")
        return ReadRange(self.read, self.offset + start, end - start)

    def trim(self, end: str, amount: int) -> ReadRange:
        """This range without `amount` bases at its 'three_prime' or 'five_prime' end."""
        if end not in ("three_prime", "five_prime"):
            raise ValueError(f"not an end: {end!r}")
        if amount == 0:
            return self
        if self.len is not None and amount > self.len:
            raise ValueError(f"{amount} is more than {self} holds")
        if end == "five_prime":
            return ReadRange(self.read, self.offset + amount, None if self.len is None else self.len - amount)
        if self.len is None:
            raise ValueError("the end of an open range can't be trimmed")
        return replace(self, len=self.len - amount)

    def of(self, part: str = "seq") -> Column:
        """This range of a read-pair row's part ('seq', 'qual' or 'header'); null if the read is absent or too short."""
        return slice_column(F.col(f"{self.read}.{part}"), self.offset, self.len)

    def problem(self, name: str) -> Column:
        """What is wrong with this range in a read-pair row; null if nothing is."""
        need = self.offset + (self.len or 0)
        seq, label = F.col(f"{self.read}.seq"), READ_NAMES[self.read]
        short = F.format_string(f"{name}: {label} has %d bases, but {self.offset} to {need} are needed", F.length(seq))
        return F.when(seq.isNull(), F.lit(f"{name}: there is no {label}")).when(F.length(seq) < need, short)


def slice_column(s: Column | str, offset: Column | int, size: Column | int | None = None) -> Column:
    """`s` from `offset` on for `size` characters or, if that is null, to its end; null where it doesn't reach so far."""
    s, o, n = _col(s), _col(offset), _col(size).cast("int")
    return F.when(o + F.coalesce(n, F.lit(0)) <= F.length(s), F.substr(s, o + 1, F.coalesce(n, F.length(s) - o)))


def valid_range(offset: Column | str, size: Column | str) -> Column:
    """Whether ReadRange takes the offset and length (null: open)."""
    o, n = _col(offset), _col(size)
    return o.between(0, (1 << 15) - 1) & F.coalesce(n.between(0, OPEN - 1), F.lit(True))


def packed_parts(value: Column | str) -> tuple[Column, Column, Column]:
    """Number of the read, offset and length (null: open) of a packed range (a bigint)."""
    v = _col(value)
    size = v.bitwiseAND(F.lit(OPEN)).cast("int")
    return F.shiftright(v, 30).cast("int"), F.shiftright(v, 15).bitwiseAND(F.lit(OPEN)).cast("int"), F.when(size != OPEN, size)


def intersect_columns(o1: Column | str, n1: Column | str, o2: Column | str, n2: Column | str) -> tuple[Column, Column]:
    """Offset and length of the intersection of two ranges of one read; least and greatest pass over nulls, that is open ends."""
    o1, n1, o2, n2 = map(_col, (o1, n1, o2, n2))
    end = F.least(o1 + n1, o2 + n2)
    offset = F.least(end, F.greatest(o1, o2))
    return offset, end - offset


def shrink_columns(offset: Column | str, size: Column | str, start: Column | str, end: Column | str) -> tuple[Column, Column]:
    o, n, a, b = map(_col, (offset, size, start, end))
    good = (a <= b) & F.coalesce(b <= n, F.lit(True))
    wrong = F.raise_error(F.lit("not a range within the one to shrink")).cast("int")
    return F.when(good, o + a).otherwise(wrong), F.when(good, b - a).otherwise(wrong)


def trim_columns(offset: Column | str, size: Column | str, end: str, amount: Column | str | int) -> tuple[Column, Column]:
    o, n, k = _col(offset), _col(size), _col(amount)
    wrong = F.raise_error(F.lit("more is trimmed than the range holds, or the end of an open range")).cast("int")
    good = (k == 0) | F.coalesce(k <= n, F.lit(end == "five_prime"))
    return F.when(good, o + k if end == "five_prime" else o).otherwise(wrong), F.when(good, n - k).otherwise(wrong)


def intersect_half_open(a1: Column, b1: Column, a2: Column, b2: Column) -> tuple[Column, Column]:
    """Start and end of the intersection of a1..b1 and a2..b2; an empty one stands at the smaller end."""
    end = F.least(b1, b2)
    return F.least(F.greatest(a1, a2), end), end
