"""Mixing sources to target weights (operator 1).

Token counts are summed by cell (source, language, topic). Iterative
proportional fitting rakes the cells' token weights until their source, language
and topic marginals are the target shares; a document's inclusion probability is
its cell's weight for each token, scaled (and cut at one) so that the expected
number of sampled tokens is the budget. A document is sampled if a number derived
from the hash of its doc_id lies below that probability.

The cell table is tiny beside the corpus; up to ``CELLS`` cells it is raked on
the driver, beyond that by the same steps as DataFrame aggregations.

Defined results: null or missing source, language or topic is a category of its
own, ``(none)``; categories without a target share get weight zero, target shares
of absent categories are dealt to the others in proportion; null and empty texts
have no token and are never sampled; rows with a repeated doc_id are drawn alike;
texts of any length are counted whole; an empty table gives an empty one. Columns other
than doc_id, text, source, lang and topic, whatever their names, are not read; ``sample``
keeps them, but for those that it writes.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, unit_interval

DIMS = ("source", "lang", "topic")
CELLS, SWEEPS, TOLERANCE = 200_000, 200, 1e-9
NONE = "(none)"
#: In a target: all categories that it does not name, which share by their tokens.
REST = "*"

#: Topic of a text: the first whose mark occurs in it.
TOPICS = (("table", " | "), ("legal", "icensed "), ("contact", "@"), ("shouting", "!!"))
OTHER_TOPIC = "prose"


def topic_of(text: Column) -> Column:
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for name, mark in TOPICS:
        out = out.when(text.contains(mark), name)
    return out.otherwise(OTHER_TOPIC)


def tokens_of(text: Column) -> Column:
    """Number of runs of non-blank characters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def dims_of(docs: DataFrame) -> dict[str, Column]:
    """The three dimensions and the tokens of each row."""
    named = {c: F.coalesce(F.col(c).cast("string"), F.lit(NONE)) if c in docs.columns else F.lit(NONE) for c in DIMS[:2]}
    topic = F.col("topic").cast("string") if "topic" in docs.columns else topic_of(F.col("text"))
    return named | {"topic": F.coalesce(topic, F.lit(NONE)), "tokens": tokens_of(F.col("text"))}


def shares_local(cells: pd.DataFrame, dim: str, target: Mapping[str, float] | float) -> dict[str, float]:
    """The shares that a target (see ``mix``) gives to the categories of a dimension."""
    n = cells[cells["tokens"] > 0].groupby(dim)["tokens"].sum().astype(float)
    if not isinstance(target, Mapping):
        n = n**target
        return (n / max(n.sum(), 1e-300)).to_dict()
    rest = n[[k not in target for k in n.index]]
    others = (rest / max(rest.sum(), 1e-300) * target[REST]).to_dict() if REST in target else {}
    return {k: v for k, v in target.items() if k != REST} | others


def shares_frame(cells: DataFrame, dim: str, target: Mapping[str, float] | float) -> DataFrame:
    """``shares_local`` as a DataFrame (dim, want), for any number of categories."""
    n = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("n")).where("n > 0")
    if not isinstance(target, Mapping):
        return n.select(dim, F.pow("n", F.lit(float(target))).alias("want"))
    named = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in target.items() if k != REST and v > 0], f"{dim} string, want double")
    if not target.get(REST):
        return named
    rest = n.join(named, dim, "left_anti")
    return named.union(rest.crossJoin(F.broadcast(rest.agg(F.sum("n").alias("all")))).select(dim, F.col("n") / F.col("all") * float(target[REST])))


def rake_local(cells: pd.DataFrame, targets: Mapping[str, Mapping[str, float]]) -> np.ndarray:
    """Weights of the cells that start at their tokens; marginals go to the targets."""
    w = cells["tokens"].to_numpy(dtype=float)
    for dim in DIMS:
        w = np.where(cells[dim].map(lambda k, t=targets[dim]: t.get(k, 0) > 0), w, 0.0)
    codes = {d: pd.factorize(cells[d]) for d in DIMS}
    w = w / max(w.sum(), 1e-300)
    for _ in range(SWEEPS):
        moved = 0.0
        for dim in DIMS:
            code, names = codes[dim]
            have = np.bincount(code, weights=w, minlength=len(names)).astype(float)
            want = np.array([targets[dim].get(k, 0.0) for k in names]) * (have > 0)
            want = want / max(want.sum(), 1e-300)
            ratio = np.divide(want, have, out=np.zeros_like(have), where=have > 0)
            moved = max(moved, np.abs(have - want).max(initial=0))
            w = w * ratio[code]
        if moved < TOLERANCE:
            break
    return w


def scale_local(tokens: np.ndarray, w: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, t * w / tokens) with the given expected tokens."""
    rate = np.divide(w, tokens, out=np.zeros_like(w), where=tokens > 0)
    if budget >= tokens[rate > 0].sum():
        return (rate > 0).astype(float)
    p, full = np.zeros_like(rate), np.zeros(len(rate), dtype=bool)
    while True:  # cells that reach one leave the rest to the others
        open_ = ~full & (rate > 0)
        t = (budget - tokens[full].sum()) / (rate[open_] * tokens[open_]).sum()
        p = np.where(full, 1.0, t * rate)
        if not (p > 1).any():
            return p
        full |= p >= 1


def rake_cells(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], budget_share: float) -> DataFrame:
    """The DataFrame form of ``rake_local`` and ``scale_local``, for cell tables of any size."""
    want = {d: saved(shares_frame(cells, d, targets[d]), "shares") for d in DIMS}
    now = cells.withColumn("w", F.col("tokens").cast("double"))
    for d in DIMS:
        now = now.join(want[d].select(d), d, "left_semi")
    now = saved(now, "cells")
    for _ in range(SWEEPS):
        moved = 0.0
        for d in DIMS:
            have = now.groupBy(d).agg(F.sum("w").alias("have")).where("have > 0").join(want[d], d)
            sums = have.agg(F.sum("have"), F.sum("want")).first()
            have = saved(have.withColumn("want", F.col("want") / sums[1]).withColumn("have1", F.col("have") / sums[0]), "marginal")
            moved = max(moved, have.agg(F.max(F.abs(F.col("have1") - F.col("want")))).first()[0] or 0.0)
            now = now.join(have.select(d, (F.col("want") / F.col("have")).alias("ratio")), d).withColumn("w", F.col("w") * F.col("ratio")).drop("ratio")
        now = saved(now, "cells")
        if moved < TOLERANCE:
            break
    now = now.withColumn("rate", F.col("w") / F.col("tokens"))
    whole = cells.agg(F.sum("tokens")).first()[0] or 0
    budget = whole * budget_share
    t, last = 0.0, -1
    while True:
        p = now.withColumn("full", F.col("rate") * t >= 1)
        full, n, rest = p.agg(F.coalesce(F.sum(F.when(F.col("full"), F.col("tokens"))), F.lit(0)), F.count_if("full"), F.sum(F.when(~F.col("full"), F.col("w")))).first()
        if n == last or not rest:
            break
        last, t = n, max((budget - full) / rest, 0.0)
    return now.withColumn("weight", F.col("w")).withColumn("probability", F.least(F.lit(1.0), F.col("rate") * t)).select(*DIMS, "weight", "probability")


def calibrate(cells: DataFrame, targets: Mapping[str, Mapping[str, float] | float], budget_share: float, most: int = CELLS) -> DataFrame:
    """source, lang, topic, weight, probability for each cell with tokens."""
    cells = cells.where("tokens > 0")
    if cells.limit(most + 1).count() > most:
        return rake_cells(cells, targets, budget_share)
    local = cells.toPandas().sort_values(list(DIMS)).reset_index(drop=True)
    w = rake_local(local, {d: shares_local(local, d, targets[d]) for d in DIMS})
    p = scale_local(local["tokens"].to_numpy(dtype=float), w, budget_share * float(local["tokens"].sum()))
    out = [(*r, float(a), float(b)) for r, a, b in zip(local[list(DIMS)].itertuples(index=False), w, p, strict=True)]
    schema = "source string, lang string, topic string, weight double, probability double"
    return F.broadcast(cells.sparkSession.createDataFrame(out, schema))


def calibrated(rows: DataFrame, targets: Mapping[str, Mapping[str, float] | float], budget_share: float) -> DataFrame:
    cells = saved(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")), "cells")
    return calibrate(cells, targets, budget_share)


def drawn(probability: Column, tokens: Column, salt: str) -> tuple[Column, Column]:
    p = F.when(tokens > 0, F.coalesce(probability, F.lit(0.0))).otherwise(0.0)
    return p, F.coalesce(unit_interval(F.col("doc_id"), salt) < p, F.lit(False))


def mix(docs: DataFrame, targets=None, budget_share: float = 0.5, salt: str = "mix") -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight (of the document's cell),
    probability, sampled. A target is a mapping of shares, in which ``REST`` stands for
    all categories without one (they get none if it is missing), or a power to which
    the dimension's own token shares are raised."""
    rows = saved(docs.select("doc_id", *[c.alias(n) for n, c in dims_of(docs).items()]), "tokens")
    joined = rows.join(calibrated(rows, targets or TARGETS, budget_share), list(DIMS), "left")
    p, sampled = drawn(F.col("probability"), F.col("tokens"), salt)
    return joined.select("doc_id", *DIMS, "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"), p.alias("probability"), sampled.alias("sampled"))


#: The mixture of the registered query and of the pipeline.
TARGETS = {"source": 0.5, "lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1, REST: 0.05}, "topic": 0.7}


def sample(docs: DataFrame, targets=None, budget_share: float = 0.5, salt: str = "mix") -> DataFrame:
    """The sampled rows of ``docs``, with the cell's ``mix_weight`` and
    ``mix_probability`` in place of columns of these names (or of ``_source``, ``_lang``,
    ``_topic``, ``_tokens``, which go). Rows without doc_id, or with a null or empty
    text, are never sampled; rows with equal doc_ids are drawn alike. Texts are read twice and never shuffled: the cells are
    joined to the rows by broadcast."""
    rows = docs.select(*[c.alias(n) for n, c in dims_of(docs).items()])
    cells = calibrated(rows, targets or TARGETS, budget_share).toDF(*[f"_{d}" for d in DIMS], "mix_weight", "mix_probability")
    own = {f"_{n}": c for n, c in dims_of(docs).items()}
    joined = docs.drop("mix_weight", "mix_probability").withColumns(own).join(cells, [f"_{d}" for d in DIMS], "left")
    _, sampled = drawn(F.col("mix_probability"), F.col("_tokens"), salt)
    return joined.where(sampled).drop(*own)
