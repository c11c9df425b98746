"""Secret scans with multipart linking.

Base findings (assignments, access identifiers, long hex) stand alone and are always reported. On top of them weak
parts - account identifiers, endpoints, key-like strings - are candidates only: a part is reported when complementary
parts co-occur with it in its scope. A scope is a paragraph (text between blank lines), and within it parts join when
the gap between their spans is at most `reach` code points. An identifier needs a secret in reach, a key-like string
needs an identifier or an endpoint, an endpoint needs an identifier and a secret. Base assignments and hex count as
secrets, base access identifiers as identifiers. An identifier's own value is no secret
beside it. Names may follow '_' or '-' (DB_HOST, aws_access_key_id), and values '=' or ':' without a space or quote, as
in .env files. The interval join looks for the nearest span of the complementary kind in sorted order, so it is linear
in the parts of a text and emits no pairs.

Spans are code points, end exclusive. Defined results: a null text is an empty one and has no spans; a null id is kept
as null; repeated rows give repeated results; long texts are scanned whole, a few megabytes of texts or one text at a time;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .minhash_dedup import byte_runs

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
REACH = 300
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:client_?id|access_?key_?id|account_?id|user_?name|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.I | re.A)
ENDPOINT = re.compile(r"""(?:[a-z][a-z0-9+.-]{1,15}://|(?<![A-Za-z0-9])(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?)[A-Za-z0-9][^\s"'<>]{3,}""", re.I | re.A)
KEYLIKE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/=_-])", re.A)
BLANK = re.compile(r"\n[ \t]*\n")


def _random_looking(s: str) -> bool:
    """Letters of both cases or letters and digits, and at least 3.5 bits a character."""
    if not (any(map(str.isdigit, s)) and any(map(str.isalpha, s))):
        return False
    return -sum(c / len(s) * log2(c / len(s)) for c in Counter(s).values()) >= 3.5


class _Parts:
    """Spans of one role, to ask for one within reach in the same scope."""

    def __init__(self, spans: list[tuple[int, int]], scopes: list[int]):
        self.spans, self.scopes = sorted(set(spans)), scopes
        self.starts = [s for s, _ in self.spans]
        self.ends, most = [], 0  # running maximum: spans of different kinds may overlap
        for _, e in self.spans:
            self.ends.append(most := max(most, e))

    def overlap(self, start: int, end: int) -> bool:
        j = bisect_left(self.starts, end)
        return j > 0 and self.ends[j - 1] > start

    def near(self, start: int, end: int, reach: int, inside: bool = True, around: bool = True) -> bool:
        """Whether a span is within reach; without `inside` those that lie in this one don't count, without `around` those that hold it."""
        k = bisect_right(self.scopes, start)
        low = max(start - reach, self.scopes[k - 1] if k else 0)
        high = min(end + reach, self.scopes[k] - 1 if k < len(self.scopes) else end + reach)
        # the spans that end at or after low and begin at or before high, but for the span itself
        i, j = bisect_left(self.ends, low), bisect_right(self.starts, high)
        while i < j:
            s, e = self.spans[i]
            if (s, e) != (start, end) and e >= low and (inside or s < start or e > end) and (around or s > start or e < end):
                return True
            i += 1
        return False


def scan(text: str, reach: int = REACH) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start, then kind as listed in KINDS."""
    low = text.lower()
    out = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    ids = [m.span() for m in IDENTIFIER.finditer(text)] if "user" in low or "login" in low or "id" in low and ("client" in low or "access" in low or "account" in low) else []
    ends = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text or "host" in low or "endpoint" in low or "server" in low else []
    if ids or ends or any(k == "access" for k, _, _ in out):
        out += _linked(text, out, ids, ends, reach)
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _linked(text: str, base: list[tuple[str, int, int]], ids: list, ends: list, reach: int) -> list[tuple[str, int, int]]:
    scopes = [m.end() for m in BLANK.finditer(text)]
    taken = _Parts([(s, e) for _, s, e in base], [])
    keys = [m.span() for m in KEYLIKE.finditer(text) if _random_looking(m[0]) and not taken.overlap(*m.span())]
    known = _Parts(ids + [(s, e) for k, s, e in base if k == "access"], scopes)
    hidden = _Parts(keys + [(s, e) for k, s, e in base if k != "access"], scopes)
    places = _Parts(ends, scopes)
    out = [("identifier", *x) for x in ids if hidden.near(*x, reach, inside=False)]
    out += [("secret", *x) for x in keys if known.near(*x, reach, around=False) or places.near(*x, reach)]
    return out + [("endpoint", *x) for x in ends if known.near(*x, reach) and hidden.near(*x, reach)]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per row of `docs`: doc_id, spans (array of kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, stop in byte_runs(whole.column(1)):
                batch = whole.slice(at, stop - at)
                found = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t.as_py(), reach)] for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")
