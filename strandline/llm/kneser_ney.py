"""Quality classifier: an interpolated modified Kneser-Ney model of byte n-grams, trained on trusted text.

Training reads every trusted document, four fifths to count and one fifth to calibrate; a caller may bound it to a sample
(`per_lang` of each language, in expectation). The counts of the highest order, the continuation counts of the lower ones, the discounts
from the counts of counts, context totals and interpolated probabilities are joins and aggregations of tables hashed by
n-gram or context. Symbols are the bytes of UTF-8, so no character of any script is folded into another, and no n-gram is
pruned. The tables stay in the shared folder, dealt to shards by the last two symbols of the context: an n-gram, its
shorter forms and all their contexts fall into one shard (tables of at most two symbols are in each).

Scoring covers all documents and whole texts, by a sharded join: a block of documents sends each shard its distinct n-grams
as packed columns, the shard looks up log P of each, from the highest order down, and sends them back, and the block
sums them per document. No task or driver holds more of the model than a shard. Texts are packed and dealt to blocks once.
The more shards, the more blocks meet one copy of a shard, so that copies of the model grow with the input, not its square.

A document's perplexity is shrunk to its language's mean by `prior` symbols, or chance would decide on short texts. A
language's threshold is the `quantile` of its calibration documents' perplexities, times `slack`. Languages without
calibration documents take the pooled threshold. Quantiles are exact: by counts of narrow bins, then by rank in the bins
that hold the wanted ranks.

Defined results: null and empty texts have no symbols, take the language's mean and are kept; null languages count as
the language ''; without trusted text every document is kept, with null figures; null ids are kept as they are; long texts
are scored whole, in blocks with few others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .backoff_lm import RUN_BYTES, _texts, pack, packed_runs, unpack
from .linking import spread_join
from .minhash_dedup import _mix
from .shared import cut, released, sieve, sieve_bits, sift, unit, without

ORDER = 5
START = 255  # no byte of UTF-8
PRIOR = 60.0
QUANTILE, SLACK = 0.995, 1.1
CHUNK = 1 << 20
BLOCK_BYTES = 8 << 20
SHARD_NGRAMS = 250_000
#: Blocks that meet a copy of a shard of the model in one task, at least, and for each shard.
TOGETHER, TOGETHER_SHARD = 32, 4
#: N-grams that a counting task merges before it sends them on, and those of one batch.
MERGE, BATCH = 1 << 20, 1 << 17
#: Bins of the natural logarithm of perplexities, for quantiles.
BINS = 1024


@dataclass
class Model:
    order: int
    shards: int
    tables: DataFrame  # shard, k, kind (0: n-grams, 1: contexts), n, codes, values: sorted columns
    floor: float  # log probability of a symbol that no table has
    levels: DataFrame | None = None  # lang, mean (bits of a symbol, as natural logarithm), limit
    pooled: tuple[float, float] = (0.0, float("inf"))


def ngram_codes(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at each byte of each text, after order - 1 start marks; each text's number of bytes."""
    pad = bytes([START]) * (order - 1)
    joined = np.frombuffer(pad.join([b"", *texts]), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes + order - 1) - sizes
    code = np.zeros(len(joined), np.uint64)
    for k in range(order):
        code[k:] |= joined[: len(joined) - k].astype(np.uint64) << np.uint64(8 * k)
    real = np.ones(len(joined), bool)
    for k in range(1, order):
        real[begins - k] = False
    return code[real], sizes


def _find(table: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return at, table[at] == wanted


def ngram_logp(tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], order: int, floor: float, codes: np.ndarray) -> np.ndarray:
    """log P(last symbol | the others) of distinct n-grams of a shard: a join with each order's table, from the highest down."""
    out, left = np.zeros(len(codes)), np.arange(len(codes))
    none = np.empty(0, np.uint64), np.empty(0)
    for k in range(order, 0, -1):
        part = codes[left] & np.uint64((1 << 8 * k) - 1)
        grams, logp = tables.get((k, 0), none)
        at, hit = _find(grams, part)
        out[left[hit]] += logp[at[hit]]
        left, part = left[~hit], part[~hit]
        if k > 1:
            contexts, backoff = tables.get((k, 1), none)
            at, seen = _find(contexts, part >> np.uint64(8))
            out[left[seen]] += backoff[at[seen]]
    out[left] += floor
    return out


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse. Short codes are sorted together with their places in one word, which is much faster."""
    if len(codes) >= 1 << 24 or not len(codes) or int(codes.max()) >= 1 << 40:
        return np.unique(codes, return_inverse=True)
    packed = np.sort(codes << np.uint64(24) | np.arange(len(codes), dtype=np.uint64))
    ordered, place = packed >> np.uint64(24), (packed & np.uint64((1 << 24) - 1)).astype(np.int64)
    first = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    where = np.empty(len(codes), np.int64)
    where[place] = np.cumsum(first) - 1
    return ordered[first], where


class _Block:
    """The distinct n-grams of some texts, sorted, and where they stand; a megabyte or a text at a time."""

    def __init__(self, texts: list[bytes], order: int):
        self.parts, found, i = [], [np.empty(0, np.uint64)], 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                size += len(texts[j])
                j += 1
            codes, sizes = ngram_codes(texts[i:j], order)
            distinct, where = _distinct(codes)
            self.parts.append((len(distinct), where.astype(np.int32), sizes))
            found.append(distinct)
            i = j
        self.codes, self.inverse = np.unique(np.concatenate(found), return_inverse=True)

    def sums(self, logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's log probability and number of symbols, from those of `codes`."""
        total, count, at = [np.empty(0)], [np.empty(0, np.int64)], 0
        for n, where, sizes in self.parts:
            own = logp[self.inverse[at : at + n]]
            sums = np.concatenate(([0.0], np.cumsum(own[where])))
            ends = np.cumsum(sizes)
            total.append(sums[ends] - sums[ends - sizes])
            count.append(sizes)
            at += n
        return np.concatenate(total), np.concatenate(count)


def shard_of(codes: np.ndarray, shards: int) -> np.ndarray:
    """The shard of n-grams: by the last two symbols of their contexts."""
    return (_mix((codes >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int64)


def log_probs(docs: DataFrame, model: Model, key: Column, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, n (symbols) and logp, one row per row of `docs`."""
    order, shards, floor = model.order, model.shards, model.floor
    text = F.col(f"`{text_col}`").cast("string")
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    runs = packed_runs(docs.select(key.alias("key"), text.alias("text")), "key", "text", min(RUN_BYTES, max(1, block_bytes // 16)))
    dealt = runs.withColumn("block", F.pmod(F.xxhash64("texts", "ids"), F.lit(blocks)).cast("long"))

    def explode(rows: pa.Table) -> pa.Table:
        codes, src = _Block(_texts(rows), order).codes, rows.column("block")[0].as_py()
        at = shard_of(codes, shards)
        out = [(src, s, len(c), pack(np.diff(c, prepend=np.uint64(0)))) for s in range(shards) if len(c := codes[at == s])]
        kinds = [("block", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("codes", pa.binary())]
        return pa.table([[x[i] for x in out] for i in range(4)], schema=pa.schema(kinds))

    def look_up(rows: pa.Table, own: pa.Table) -> pa.Table:
        import zstandard

        tables, out = _unpacked(own), []
        for n, codes in zip(rows.column("n").to_pylist(), rows.column("codes")):
            logp = ngram_logp(tables, order, floor, np.cumsum(unpack(codes.as_py(), n), dtype=np.uint64)).astype("<f4")
            planes = np.ascontiguousarray(logp.view(np.uint8).reshape(-1, 4).T).tobytes()
            out.append(zstandard.ZstdCompressor(level=1).compress(planes))
        return pa.table([rows.column("block"), rows.column("shard"), rows.column("n"), pa.array(out, pa.binary())], names=["block", "shard", "n", "logp"])

    def score(rows: pa.Table, found: pa.Table) -> pa.Table:
        import zstandard

        block = _Block(_texts(rows), order)
        at, logp = shard_of(block.codes, shards), np.zeros(len(block.codes))
        for s, n, x in zip(*(found.column(c).to_pylist() for c in ("shard", "n", "logp"))):
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.uint8).reshape(4, n)
            logp[at == s] = np.ascontiguousarray(planes.T).view("<f4").ravel()
        total, count = block.sums(logp)
        return pa.table([rows.column("ids").combine_chunks().flatten(), pa.array(count), pa.array(total)], names=["key", "n", "logp"])

    together = max(TOGETHER, TOGETHER_SHARD * shards)
    sent = dealt.groupBy("block").applyInArrow(released(explode), "block long, shard long, n long, codes binary").withColumn("set", F.floor(F.col("block") / together))
    sets = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((blocks - 1) // together).cast("long")))
    copies = model.tables.select(sets.alias("set"), "*")
    back = sent.groupBy("set", "shard").cogroup(copies.groupBy("set", "shard")).applyInArrow(released(look_up), "block long, shard long, n long, logp binary")
    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(released(score), "key long, n long, logp double")


def _unpacked(rows: pa.Table) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    out = {}
    for k, kind, n, codes, values in zip(*(rows.column(c).to_pylist() for c in ("k", "kind", "n", "codes", "values"))):
        out[k, kind] = np.cumsum(unpack(codes, n), dtype=np.uint64), np.frombuffer(values, "<f8")
    return out


def trusted_sample(docs: DataFrame, labels: DataFrame, per_lang: int | None, seed: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """doc_id, lang, text, calibrate of all trusted documents, or of about `per_lang` of each language, by keyed hash of the id."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang")
    if per_lang is None:
        chosen = cut(good.select(F.col("doc_id").alias("id")), "chosen")
    else:
        pool = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), lang).join(good, "doc_id"), "pool")
        sizes = pool.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
        chosen = pool.join(sizes, "lang").where(unit(F.lit(seed), F.col("doc_id")) * F.col("n") < per_lang).select(F.col("doc_id").alias("id")).distinct()
        chosen = cut(chosen, "chosen")
    bits = sieve_bits(chosen.count())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), lang, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    near = sift(texts, F.col("doc_id"), sieve(chosen, F.col("id"), bits), "hit", bits).where("hit").drop("hit")
    rows = near.join(chosen, F.col("doc_id") == F.col("id"), "left_semi")
    return cut(rows.withColumn("calibrate", unit(F.lit(seed + 1), F.col("doc_id")) < 0.2), "trusted")


def _counts(texts: DataFrame, order: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes, where = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
            n = np.zeros(len(codes), np.int64)
            np.add.at(n, where, np.concatenate([n for _, n in held]))
            return codes, n

        def sent(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(codes), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + BATCH].view(np.int64)), pa.array(n[i : i + BATCH])], names=["code", "n"])

        for whole in batches:
            texts = whole.column(0).cast(pa.binary()).to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK):
                    size += len(texts[stop])
                    stop += 1
                codes, n = np.unique(ngram_codes(texts[at:stop], order)[0], return_counts=True)
                held.append((codes, n.astype(np.int64)))
                at = stop
                if sum(len(c) for c, _ in held) > MERGE:
                    held = [merged()]
                    if len(held[0][0]) > MERGE // 2:
                        yield from sent(*held[0])
                        held = []
        if held:
            yield from sent(*merged())

    return texts.select("text").mapInArrow(released(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def discounts(of: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the numbers of n-grams that occur one to four times."""
    n1, n2, n3, n4 = (max(x, 1) for x in of)
    y = n1 / (n1 + 2 * n2)
    return tuple(float(min(max(k - (k + 1) * y * b / a, 0.05), k - 0.05 if k == 1 else k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))


def train(texts: DataFrame, order: int = ORDER, shard_ngrams: int = SHARD_NGRAMS) -> Model:
    """The model of `texts` (column text), of any number."""
    if not 2 <= order <= 7:
        raise ValueError("order must be from 2 to 7")
    counts = {order: cut(_counts(texts, order), "counts")}
    for k in range(order - 1, 0, -1):  # a lower order counts the symbols that go before
        counts[k] = cut(counts[k + 1].groupBy(F.col("code").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("code")).agg(F.count(F.lit(1)).alias("n")), "counts")
    floor = -math.log(256)
    lower: DataFrame | None = None
    rows: DataFrame | None = None
    for k in range(1, order + 1):
        c = counts[k]
        of = c.agg(*[F.count(F.when(F.col("n") == i, 1)) for i in (1, 2, 3, 4)]).first()
        d1, d2, d3 = discounts(list(of))
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        grams = c.withColumns({"ctx": F.shiftrightunsigned("code", 8), "less": F.col("code").bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)), "d": discount})
        contexts = grams.groupBy("ctx").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("gamma"))
        grams = spread_join(grams, contexts, ["ctx"])
        own = (F.col("n") - F.col("d")) / F.col("total")
        if lower is None:
            p = grams.select("code", "ctx", "gamma", (own + F.col("gamma") * math.exp(floor)).alias("p"))
            floor += math.log(max(grams.agg(F.max("gamma")).first()[0] or 1.0, 1e-12))
        else:
            grams = grams.join(lower.select(F.col("code").alias("less"), F.col("p").alias("q")), "less")
            p = grams.select("code", "ctx", "gamma", (own + F.col("gamma") * F.col("q")).alias("p"))
        lower = cut(p, "kneser-ney")
        both = lower.select(F.lit(k).alias("k"), F.lit(0).alias("kind"), "code", F.log("p").alias("x"))
        both = both.unionByName(lower.groupBy(F.col("ctx").alias("code")).agg(F.log(F.max("gamma")).alias("x")).select(F.lit(k).alias("k"), F.lit(1).alias("kind"), "code", "x"))
        rows = both if rows is None else rows.unionByName(both)
    shards = max(1, math.ceil(sum(c.count() for c in counts.values()) / shard_ngrams))
    return Model(order, shards, _sharded(rows, shards), floor)


def _sharded(rows: DataFrame, shards: int) -> DataFrame:
    """The tables (k, kind, code, x), packed by shard; cut. Those that the last two symbols of a context don't tell apart go to all."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, kind, codes = (batch.column(i).to_numpy() for i in range(3))
            codes = codes.view(np.uint64)
            every = k <= 2
            own = shard_of(np.where(kind == 0, codes, codes << np.uint64(8)), shards)
            places = np.concatenate([np.flatnonzero(~every), np.repeat(np.flatnonzero(every), shards)])
            to = np.concatenate([own[~every], np.tile(np.arange(shards), int(every.sum()))])
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int64)), *(batch.column(i).take(pa.array(places)) for i in range(4))], names=["shard", "k", "kind", "code", "x"])

    def pack_table(table: pa.Table) -> pa.Table:
        codes = table.column("code").to_numpy().view(np.uint64)
        by = np.argsort(codes)
        shard, k, kind = (table.column(c)[0].as_py() for c in ("shard", "k", "kind"))
        values = table.column("x").to_numpy()[by].astype("<f8").tobytes()
        columns = [pa.array([shard], pa.int64()), pa.array([k], pa.int32()), pa.array([kind], pa.int32()), pa.array([len(by)], pa.int64()), pa.array([pack(np.diff(codes[by], prepend=np.uint64(0)))], pa.binary()), pa.array([values], pa.binary())]
        return pa.table(columns, names=["shard", "k", "kind", "n", "codes", "values"])

    dealt = rows.mapInArrow(released(deal), "shard long, k int, kind int, code long, x double")
    return cut(dealt.groupBy("shard", "k", "kind").applyInArrow(released(pack_table), "shard long, k int, kind int, n long, codes binary, values binary"), "model")


def fit(docs: DataFrame, labels: DataFrame, order: int = ORDER, per_lang: int | None = None, prior: float = PRIOR, quantile: float = QUANTILE, slack: float = SLACK, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model with each language's mean and threshold; None without trusted text."""
    sample = trusted_sample(docs, labels, per_lang, seed, id_col, text_col, lang_col)
    counting = sample.where("not calibrate and text <> ''")
    if counting.isEmpty():
        return None
    model = train(counting, order)
    held = sample.where("text <> ''")
    held = held.where("calibrate") if not held.where("calibrate").isEmpty() else held
    scored = log_probs(held, model, F.col("doc_id")).join(held.select(F.col("doc_id").alias("key"), "lang").distinct(), "key")
    scored = cut(scored.select("lang", "n", "logp"), "calibration")

    def levels(rows: DataFrame) -> DataFrame:
        mean = rows.groupBy("lang").agg((-F.sum("logp") / F.sum("n")).alias("mean"))
        ppl = F.exp((prior * F.col("mean") - F.col("logp")) / (F.col("n") + prior)).alias("x")
        limits = quantiles(rows.join(F.broadcast(mean), "lang").select("lang", ppl), quantile)
        return mean.join(limits, "lang").select("lang", "mean", (F.col("x") * slack).alias("limit"))

    model.pooled = tuple(levels(scored.withColumn("lang", F.lit(""))).select("mean", "limit").first())
    model.levels = cut(levels(scored), "levels")
    return model


def quantiles(rows: DataFrame, quantile: float) -> DataFrame:
    """lang and x, the exact quantile (between neighbours in proportion) of the positive x of each lang.

    Only counts of bins are gathered, and the rows of the one or two bins that hold the wanted ranks are sorted.
    """
    rows = rows.withColumn("bin", F.floor(F.log("x") * BINS))
    bins = rows.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy("lang")
    bins = bins.withColumns({"before": F.sum("n").over(by.orderBy("bin")) - F.col("n"), "at": (F.sum("n").over(by) - 1) * F.lit(quantile)})
    bins = bins.where((F.col("before") <= F.ceil("at")) & (F.col("before") + F.col("n") > F.floor("at"))).drop("n")
    near = rows.join(F.broadcast(bins), ["lang", "bin"])
    rank = F.col("before") + F.row_number().over(Window.partitionBy("lang", "bin").orderBy("x")) - 1
    ranked = near.withColumn("rank", rank).where((F.col("rank") == F.floor("at")) | (F.col("rank") == F.ceil("at")))
    low, high = F.min("x"), F.max("x")
    return ranked.groupBy("lang", "at").agg((low + (high - low) * (F.col("at") - F.floor("at"))).alias("x")).drop("at")


def _judged(docs: DataFrame, model: Model, prior: float, text_col: str, lang_col: str) -> DataFrame:
    """key (all that decides: language and text), logp, n, ppl, limit and kept, one row per row of `docs`."""
    rows = log_probs(docs, model, _key(text_col, lang_col), text_col)
    langs = docs.select(_key(text_col, lang_col).alias("key"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang")).distinct()
    mean, limit = model.pooled
    known = spread_join(langs, model.levels, ["lang"], "left").select("key", F.coalesce("mean", F.lit(mean)).alias("mean"), F.coalesce("limit", F.lit(limit)).alias("limit"))
    ppl = F.exp((prior * F.col("mean") - F.col("logp")) / (F.col("n") + prior))
    return spread_join(rows, known, ["key"]).withColumn("ppl", ppl).withColumn("kept", F.col("ppl") <= F.col("limit"))


def _key(text_col: str, lang_col: str) -> Column:
    return F.xxhash64(F.lit("quality"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))


def score(docs: DataFrame, model: Model | None, prior: float = PRIOR, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of `docs`: doc_id, lang, n_symbols (bytes), log_prob, perplexity, threshold, kept."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.octet_length(text).cast("long").alias("n_symbols"), _key(text_col, lang_col).alias("key"))
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", "lang", "n_symbols", none.alias("log_prob"), none.alias("perplexity"), none.alias("threshold"), F.lit(True).alias("kept"))
    judged = cut(_judged(docs, model, prior, text_col, lang_col).dropDuplicates(["key"]), "judged")
    found = spread_join(rows, judged, ["key"])
    return found.select("doc_id", "lang", "n_symbols", F.col("logp").alias("log_prob"), F.col("ppl").alias("perplexity"), F.col("limit").alias("threshold"), "kept")


def keep_trusted_like(docs: DataFrame, model: Model | None, prior: float = PRIOR, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` that the classifier keeps, with their own columns; only those that go are shuffled."""
    if model is None:
        return docs
    gone = _judged(docs, model, prior, text_col, lang_col).where("not kept").select(F.col("key").alias("id")).distinct()
    return without(docs, cut(gone, "gone"), _key(text_col, lang_col))
