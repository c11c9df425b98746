"""Short sequences as columns: checks, 2-bit codes, neighbours. All of it is built-in functions, so it stays in the JVM.

Conditions that a caller must not break raise an error on the row (raise_error) in the `checked` forms; the plain
predicates return false or null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DNA, DNA_N = "ACGT", "ACGTN"
QUAL_OFFSET = 33
#: Content policies: what a whole value must match, and how an error names it.
CONTENTS = {"sequence": (r"^[ACGTN]*\z", "^[ACGTN]*", "[ACGTN]"), "quality": (r"^[!-~]*\z", "^[!-~]*", "ASCII 33 to 126")}
SEQUENCE_CAPACITY = 23


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_content(s: Column | str, policy: str = "sequence") -> Column:
    return _col(s).rlike(CONTENTS[policy][0])


def bad_position(s: Column | str, policy: str = "sequence") -> Column:
    """Place (from 0) of the first character that the policy refuses; null if there is none."""
    s = _col(s)
    return F.when(~is_content(s, policy), F.length(F.regexp_extract(s, CONTENTS[policy][1], 0)))


def checked(s: Column | str, policy: str = "sequence", capacity: int | None = None) -> Column:
    """The value itself, or an error that names the first bad place or the capacity."""
    s = _col(s)
    bad = F.raise_error(F.format_string(f"expected {CONTENTS[policy][2]}, not so at position %d", bad_position(s, policy)))
    out = F.when(~is_content(s, policy), bad)
    if capacity is not None:
        out = out.when(F.length(s) > capacity, F.raise_error(F.lit(f"longer than {capacity}")))
    return out.otherwise(s)


def has_n(s: Column | str) -> Column:
    return _col(s).rlike("[Nn]")


def is_homopolymer(s: Column | str) -> Column:
    """All bases equal; null for an empty sequence, which has no first base."""
    s = _col(s)
    return F.when(F.length(s) > 0, s == F.repeat(F.substr(s, F.lit(1), F.lit(1)), F.length(s)))


def has_homopolymer_suffix(s: Column | str, base: str, n: int) -> Column:
    return _col(s).endswith(base * n) if n else F.lit(True)


def has_polyt_suffix(s: Column | str, n: int) -> Column:
    return has_homopolymer_suffix(s, "T", n)


def encode_2bit(s: Column | str) -> Column:
    """A=0, C=1, G=2, T=3, the first base most significant; an error for other bases or more than 16."""
    s = _col(s)
    fit = s.rlike(r"^[ACGT]{0,16}\z")
    code = F.conv(F.translate(s, DNA, "0123"), 4, 10).cast("long")
    return F.when(s.isNull(), F.lit(None).cast("long")).when(~fit, F.raise_error(F.lit("2-bit code: at most 16 bases of A, C, G and T")).cast("long")).when(s == "", F.lit(0).cast("long")).otherwise(code)


def get_base(s: Column | str, i: int) -> Column:
    """Character i (from 0); an error beyond the end."""
    s = _col(s)
    return F.when(F.length(s) > i, F.substr(s, F.lit(i + 1), F.lit(1))).when(s.isNotNull(), F.raise_error(F.lit(f"position {i} is beyond the end")))


def set_base(s: Column | str, i: int, base: str) -> Column:
    s = _col(s)
    return F.when(F.length(s) > i, F.overlay(s, F.lit(base), F.lit(i + 1), F.lit(1))).when(s.isNotNull(), F.raise_error(F.lit(f"position {i} is beyond the end")))


def push(s: Column | str, base: str, capacity: int = SEQUENCE_CAPACITY) -> Column:
    s = _col(s)
    return F.when(F.length(s) < capacity, F.concat(s, F.lit(base))).when(s.isNotNull(), F.raise_error(F.lit(f"longer than {capacity}")))


def remove(s: Column | str, i: int) -> Column:
    s = _col(s)
    return F.when(F.length(s) > i, F.concat(F.substr(s, F.lit(1), F.lit(i)), F.substr(s, F.lit(i + 2), F.length(s)))).when(s.isNotNull(), F.raise_error(F.lit(f"position {i} is beyond the end")))


def insert(s: Column | str, i: int, base: str, capacity: int = SEQUENCE_CAPACITY) -> Column:
    s = _col(s)
    fits = (F.length(s) >= i) & (F.length(s) < capacity)
    return F.when(fits, F.concat(F.substr(s, F.lit(1), F.lit(i)), F.lit(base), F.substr(s, F.lit(i + 1), F.length(s)))).when(s.isNotNull(), F.raise_error(F.lit(f"position {i} is beyond the end, or the result longer than {capacity}")))


def unique_chars(s: str) -> str:
    """Distinct characters in their first order."""
    return "".join(dict.fromkeys(s))


def distinct_bases(s: Column | str) -> Column:
    """unique_chars of a column."""
    return F.array_join(F.array_distinct(bases(s)), "")


def from_bases(letters: Column | str, policy: str = "sequence") -> Column:
    """A sequence from an array of its characters; null if the policy refuses one."""
    whole = F.array_join(_col(letters), "")
    return F.when(is_content(whole, policy), whole)


def bases(s: Column | str) -> Column:
    """The characters as an array; empty for ''."""
    s = _col(s)
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def _places(s: Column, first: int, beyond: int) -> Column:
    """1-based places from `first` to length + beyond, also where there are none."""
    last = F.length(s) + beyond
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def hamming_neighbors(s: Column | str, mode: str = "skip_n", skip: str = "", mutation: str = DNA) -> Column:
    """All sequences at Hamming distance one, by place and then base, as an array.

    mode: skip_n leaves N as it is, mutate_n replaces it too, custom skips the bases of `skip` and puts in those of `mutation`.
    """
    s = _col(s)
    skip, mutation = {"skip_n": ("N", DNA), "mutate_n": ("", DNA), "custom": (unique_chars(skip), unique_chars(mutation))}[mode]
    letters = F.array(*[F.lit(c) for c in mutation]).cast("array<string>")

    def at(i: Column) -> Column:
        own = F.substr(s, i, F.lit(1))
        here = F.lit(skip).contains(own) if skip else F.lit(False)
        kept = F.filter(letters, lambda c: (c != own) & ~here)
        return F.transform(kept, lambda c: F.concat(F.substr(s, F.lit(1), i - 1), c, F.substr(s, i + 1, F.length(s))))

    return F.flatten(F.transform(_places(s, 1, 0), at))


def deletion_neighbors(s: Column | str) -> Column:
    """Each sequence with one base less, by place, repeats kept."""
    s = _col(s)
    return F.transform(_places(s, 1, 0), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1, F.length(s))))


def insertion_neighbors(s: Column | str, with_n: bool = False, capacity: int = SEQUENCE_CAPACITY) -> Column:
    """Each sequence with one base more, by place and then base, repeats kept; an error at capacity."""
    s = _col(s)
    letters = F.array(*[F.lit(c) for c in (DNA_N if with_n else DNA)])
    made = F.flatten(F.transform(_places(s, 1, 1), lambda i: F.transform(letters, lambda c: F.concat(F.substr(s, F.lit(1), i - 1), c, F.substr(s, i, F.length(s))))))
    return F.when(F.length(s) >= capacity, F.raise_error(F.lit(f"no room for an insertion: the capacity is {capacity}")).cast("array<string>")).otherwise(made)


def edit_neighbors(s: Column | str, mode: str = "skip_n", with_n: bool = False, skip: str = "", mutation: str = DNA) -> Column:
    """Substitutions, deletions and insertions, in this order."""
    return F.concat(hamming_neighbors(s, mode, skip, mutation), deletion_neighbors(s), insertion_neighbors(s, with_n))


def pattern_exists(s: Column | str, pattern: str) -> Column:
    return F.contains(_col(s), F.lit(pattern))


def phred(qual: Column | str) -> Column:
    """Quality scores of a quality string as an array."""
    return F.transform(bases(qual), lambda c: F.ascii(c) - QUAL_OFFSET)


def mean_phred(qual: Column | str) -> Column:
    q = _col(qual)
    return F.when(F.length(q) > 0, F.aggregate(phred(q), F.lit(0), lambda a, x: a + x) / F.length(q))


def matches_with_n(target: Column | str, observed: Column | str, ns_allowed: int | Column = 1) -> Column:
    """Equal length, equal bases but for at most `ns_allowed` observed N, each of which stands for any base."""
    t, o = _col(target), _col(observed)
    ns = F.length(o) - F.length(F.translate(o, "N", ""))
    return (F.length(t) == F.length(o)) & F.forall(F.zip_with(F.split(t, ""), F.split(o, ""), lambda a, b: (b == "N") | (a == b)), lambda x: x) & (ns <= ns_allowed)
