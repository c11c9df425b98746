"""Mixing sources to target weights: iterative proportional fitting, then sampling by calibrated probabilities.

Documents are counted into cells of source, language and topic, in tokens. Raking scales the cells' weights to the
targets of one dimension after another until all marginals agree; a sweep is three small aggregations and joins of the
cell table, which is as large as there are combinations, not documents. The calibrated weight over the tokens there
are gives each cell a rate; rates are scaled to the token budget and held to at most 1 (no document is repeated), and
the scale is found again with the held cells set aside. A document is sampled when its keyed hash falls below its
cell's probability: the same documents in every run and on every machine. The key holds the id, text, source and
language, so rows that repeat an id draw apart unless they are alike in all of these.

The default target of a value is its share of the tokens to the power of the dimension's `alpha`, so 1 keeps a
marginal and 0 makes it even; targets can be given as tables (value, share) instead. The default topic is the text's
form: tabular, shouting, symbols, digits, short prose or long prose.

Defined results: null source or language counts as ''; null and empty texts have no tokens, belong to their cell and
are sampled with its probability (1 if the cell has no tokens at all); a null id is hashed as such with its text; texts of
any length are counted whole, within Spark's expressions; an empty table gives no rows. Where the cells that exist cannot
meet the targets, raking ends after `sweeps` with the weights it has and warns. Values that a target table lacks get no weight; targets of values that do not occur are left
out and the others scaled up.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .linking import spread_join
from .shared import cut, drop_cut, without

DIMENSIONS = ("source", "lang", "topic")
ALPHAS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
BUDGET = 0.8
SWEEPS, TOLERANCE = 40, 1e-6
#: Relative error of a marginal after the last sweep that is worth a warning.
WARN_ABOVE = 0.01
#: Cells that one task may rake by itself, which saves the exchanges; larger tables are raked by the same steps, distributed.
ONE_TASK_CELLS = 20_000


def text_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def text_form(text: Column, tokens: Column) -> Column:
    """The form of a text by the marks in it."""
    size = F.greatest(F.length(text), F.lit(1))
    share = lambda marks: F.regexp_count(text, F.lit(f"[{marks}]")) / size
    return (
        F.when(share(r"|\t") > 0.02, "tabular")
        .when(share("!") > 0.05, "shouting")
        .when(share(r"#$%&*@<>{}\[\]=\\^~") > 0.04, "symbols")
        .when(share("0-9") > 0.1, "digits")
        .when(tokens < 150, "short prose")
        .otherwise("long prose")
    )


def row_key(id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> Column:
    """A hash of all that decides on a row: rows of one key are alike in it, and sampled alike."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.xxhash64(F.lit("mixing"), F.col(id_col).cast("long"), text, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (source_col, lang_col)])


def cells_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """One narrow row per document: doc_id, source, lang, topic, n_tokens, key (row_key)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((source_col, "source"), (lang_col, "lang"))],
        F.lit(None).cast("string").alias("topic") if topic is None else F.coalesce(topic.cast("string"), F.lit("")).alias("topic"), text.alias("text"), text_tokens(text).alias("n_tokens"),
        row_key(id_col, text_col, source_col, lang_col).alias("key"),
    )
    if topic is None:
        rows = rows.withColumn("topic", text_form(F.col("text"), F.col("n_tokens")))
    return rows.select("doc_id", *DIMENSIONS, "n_tokens", "key")


def draw(key: Column) -> Column:
    """A row's number in [0, 1)."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 53)) / F.lit(float(1 << 53))


def default_targets(cells: DataFrame, dimension: str, alpha: float) -> DataFrame:
    """value, share: the dimension's token shares to the power of alpha."""
    return cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("n_tokens").alias("n")).where("n > 0").select("value", F.pow(F.col("n").cast("double"), F.lit(alpha)).alias("share"))


def rake(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """`cells` (the dimensions and n_tokens) with weight: shares of 1 whose marginals are the targets, as far as the cells that exist allow."""
    goals = {}
    for d, t in targets.items():
        there = cells.where("n_tokens > 0").select(F.col(d).alias("value")).distinct()
        t = t.groupBy("value").agg(F.sum("share").alias("share")).join(there, "value", "left_semi")
        total = t.agg(F.sum("share")).first()[0] or 1.0
        goals[d] = cut(t.select(F.col("value").alias(d), (F.col("share") / F.lit(float(total))).alias("goal")), "goals")
    now = cells.withColumn("weight", F.col("n_tokens").cast("double"))
    sweep, each = (_sweep_in_one_task, 4) if cells.count() <= ONE_TASK_CELLS else (_sweep, 1)
    columns = [*now.columns]
    if each > 1:
        for d, goal in goals.items():
            now = now.join(goal.withColumnRenamed("goal", f"_g{d}"), d, "left")
            columns.append(f"_g{d}")
        now = cut(now, "raked")
    kept, off = None, 0.0
    for _ in range(0, sweeps, each):
        for _ in range(each):
            now = sweep(now, goals)
        now = cut(now, "raked")
        drop_cut(kept)
        kept = now
        # factors of a sweep are near 1 once the marginals agree; the first sweep's also hold the scale
        off = now.agg(F.greatest(*[F.max(F.when(F.col("weight") > 0, F.abs(F.col(f"_f{d}") - 1))) for d in goals], F.lit(0.0))).first()[0]
        now = now.select(*columns)
        if off < tolerance:
            break
    if off > WARN_ABOVE:
        warnings.warn(f"raking: after {sweeps} sweeps a marginal is still off by {off:.1%}; the cells that exist may not allow the targets", stacklevel=2)
    return now.select(*cells.columns, "weight")


def _factor(goal: str, have: Column) -> Column:
    return F.when(have > 0, F.coalesce(goal, F.lit(0.0)) / have).otherwise(0.0)


def _sweep(now: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """One pass over the dimensions; each adds its factor as _f<dimension>."""
    for d, goal in goals.items():
        sums = now.groupBy(d).agg(F.sum("weight").alias("have")).join(goal, d, "left").select(d, _factor("goal", F.col("have")).alias(f"_f{d}"))
        now = spread_join(now.drop(f"_f{d}"), sums, [d]).withColumn("weight", F.col("weight") * F.col(f"_f{d}"))
    return now


def _sweep_in_one_task(now: DataFrame, goals: dict[str, DataFrame]) -> DataFrame:
    """The same for a table of at most ONE_TASK_CELLS rows that has the goals as _g<dimension>: no exchange, no join."""
    now = now.coalesce(1)
    for d in goals:
        now = now.withColumn(f"_f{d}", _factor(f"_g{d}", F.sum("weight").over(Window.partitionBy(d)))).withColumn("weight", F.col("weight") * F.col(f"_f{d}"))
    return now


def probabilities(raked: DataFrame, budget: float) -> DataFrame:
    """`raked` with probability: weight over tokens, scaled so that `budget` of the tokens are expected, at most 1."""
    rate = F.when(F.col("n_tokens") > 0, F.col("weight") / F.col("n_tokens"))
    total = raked.agg(F.sum("n_tokens")).first()[0] or 0
    held, scale = 0.0, 0.0
    for _ in range(60):
        full = F.coalesce(rate * F.lit(scale) >= 1, F.lit(False))
        tokens, weight = raked.agg(F.sum(F.when(full, F.col("n_tokens"))), F.sum(F.when(~full, F.col("weight")))).first()
        new = max(0.0, budget * total - (tokens or 0)) / weight if weight else scale
        if tokens == held and scale or new <= scale:
            break
        held, scale = tokens, new
    return raked.withColumn("probability", F.coalesce(F.least(rate * F.lit(scale), F.lit(1.0)), F.lit(1.0)))


def mix(rows: DataFrame, alphas: dict[str, float] | None = None, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None) -> DataFrame:
    """The cells of `rows` (cells_of): dimensions, n_docs, n_tokens, weight, probability."""
    cells = cut(rows.groupBy(*DIMENSIONS).agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "cells")
    goals = {d: (targets or {}).get(d, default_targets(cells, d, (alphas or ALPHAS)[d])) for d in DIMENSIONS}
    return cut(probabilities(rake(cells, goals), budget), "mixed")


def _decided(rows: DataFrame, alphas: dict[str, float] | None, budget: float, targets: dict[str, DataFrame] | None) -> DataFrame:
    """`rows` (cells_of, cut) with their cell's weight and probability, and sampled. Joined by cell, whatever the number of cells."""
    cells = mix(rows, alphas, budget, targets).select(*DIMENSIONS, "weight", "probability")
    return spread_join(rows, cells, list(DIMENSIONS)).withColumn("sampled", draw(F.col("key")) < F.col("probability"))


def mixing_decisions(docs: DataFrame, alphas: dict[str, float] | None = None, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None, **columns) -> DataFrame:
    """One row per row of `docs`: doc_id, source, lang, topic, n_tokens, weight (of its cell), probability, sampled."""
    return _decided(cut(cells_of(docs, **columns), "rows"), alphas, budget, targets).select("doc_id", *DIMENSIONS, "n_tokens", "weight", "probability", "sampled")


def mix_sample(docs: DataFrame, alphas: dict[str, float] | None = None, budget: float = BUDGET, targets: dict[str, DataFrame] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The sampled rows of `docs`, with their own columns: those that mixing_decisions samples, one way for any number of cells.

    Texts are counted once. Rows that are not sampled go by their key, which holds all that decides on a row.
    """
    names = {"id_col": id_col, "text_col": text_col, "source_col": source_col, "lang_col": lang_col}
    rows = cut(cells_of(docs, **names), "rows")
    gone = cut(_decided(rows, alphas, budget, targets).where("not sampled").select(F.col("key").alias("id")).distinct(), "gone")
    return without(docs, gone, row_key(**names))
