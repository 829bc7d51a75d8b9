"""Mixing sources to target weights: iterative proportional fitting of token weights, then calibrated sampling.

Documents fall into cells (source, language, topic). Only the cells' token sums are fitted, on the driver if they are
few, else by the same steps in Spark. Raking scales the cells until the weighted
tokens agree with the target shares of each margin. Document weights become inclusion probabilities that meet a token
budget, and a hash of the identifier draws the sample, so a rerun after a lost executor draws the same documents.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, drop_staged, local_table, stage

MARGINS = ("source", "lang", "topic")
#: Target shares of tokens by language and by topic(); sources get their observed shares to a power
TARGETS = {
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2},
    "topic": {"prose": 0.5, "long": 0.25, "short": 0.1, "lines": 0.1, "marked": 0.05},
}
#: Cells that the driver fits at most. Where more occur, the same fit is made in Spark
MAX_CELLS = 100_000


def n_tokens(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of the text; 0 if null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def topic(text: Column) -> Column:
    """A coarse form of the text, for want of a topic column: fixed rules over the whole text.

    marked: over a fifth of the characters is neither letter nor white space; lines: on average under 60 characters a
    line; short: under 400 characters; long: over 8000; else prose. Null or empty is empty.
    """
    n = F.char_length(text)
    plain = F.char_length(F.regexp_replace(text, r"[^\p{L}\s]+", ""))
    lines = n - F.char_length(F.translate(text, "\n", "")) + 1
    return (
        F.when(F.coalesce(n, F.lit(0)) == 0, "empty")
        .when((n - plain) * 5 > n, "marked")
        .when((lines > 2) & (n < lines * 60), "lines")
        .when(n < 400, "short")
        .when(n > 8000, "long")
        .otherwise("prose")
    )


@dataclass(frozen=True)
class Fit:
    cells: pd.DataFrame
    rounds: int
    error: float


def targets_of(cells: pd.DataFrame, margins: Sequence[str], given: Mapping[str, Mapping[str, float]], power: float) -> dict[str, pd.Series]:
    """Target shares of each margin: those given, or the observed shares to a power.

    A value without tokens cannot be raked and has no share. Values that no share is given for keep the share that they
    have, and those given divide the rest among them. A margin with no observed value of positive share is left out.
    """
    out = {}
    for m in margins:
        seen = cells.groupby(m, sort=True)["tokens"].sum()
        seen = seen[seen > 0].astype(float)
        if m in given:
            named = seen.index.isin(list(given[m]))
            share = seen / seen.sum()
            wanted = pd.Series([float(given[m].get(v, 0)) for v in seen.index], seen.index, dtype=float)
            if wanted.sum() > 0:
                share[named] = wanted[named] / wanted.sum() * share[named].sum()
            else:
                share = share[:0]
        else:
            share = seen**power
        if share.sum() > 0:
            out[m] = share / share.sum()
    return out


def rake(cells: pd.DataFrame, targets: Mapping[str, pd.Series], rounds: int = 200, tolerance: float = 1e-9) -> Fit:
    """cells (margins, tokens) with weight: tokens * weight has the targets' shares of all margins, in sum 1.

    Stops at the largest difference of a share under tolerance, or after rounds (targets may contradict each other
    where cells are missing; the last margin then holds exactly, error says how far the others are off).
    """
    cells = cells.reset_index(drop=True)
    tokens = cells["tokens"].to_numpy(float)
    codes, wanted = [], []
    for m, t in targets.items():
        at = pd.Categorical(cells[m], categories=t.index).codes.astype(np.int64)
        codes.append(np.where(at < 0, len(t), at))
        wanted.append(np.r_[t.to_numpy(float), 0.0])
    weight = np.where(tokens > 0, 1.0 / max(tokens.sum(), 1.0), 0.0)
    error, k = 0.0, 0
    for k in range(1, rounds + 1):
        for code, want in zip(codes, wanted):
            have = np.bincount(code, tokens * weight, len(want))
            weight = weight * np.divide(want, have, out=np.zeros_like(want), where=have > 0)[code]
        error = max((float(np.abs(np.bincount(code, tokens * weight, len(want)) - want).max()) for code, want in zip(codes, wanted)), default=0.0)
        if error < tolerance:
            break
    return Fit(cells.assign(weight=weight), k, error)


def inclusion(cells: pd.DataFrame, budget: float) -> np.ndarray:
    """For each cell the probability proportional to its weight, cut at 1, that expects budget tokens in all.

    Cells at 1 hand what they cannot give to the others, until the budget or all tokens of weighted cells are met.
    """
    tokens, weight = cells["tokens"].to_numpy(float), cells["weight"].to_numpy(float)
    order = np.argsort(-weight, kind="stable")
    t, w = tokens[order], weight[order]
    full = np.r_[0.0, np.cumsum(t)[:-1]] if len(t) else t
    rest = np.cumsum((t * w)[::-1])[::-1] if len(t) else t
    scale = np.divide(np.maximum(budget - full, 0), rest, out=np.full(len(t), np.inf), where=rest > 0)
    p = np.zeros(len(t))
    for k in range(len(t)):
        if scale[k] * w[k] < 1:
            p[k:] = scale[k] * w[k:]
            break
        p[k] = 1.0 if w[k] > 0 else 0.0
    out = np.empty(len(t))
    out[order] = np.minimum(p, 1.0)
    return out


def uniform(doc_id: Column, seed: int) -> Column:
    """In [0, 1), by a hash of the identifier."""
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def mix(
    docs: DataFrame,
    given: Mapping[str, Mapping[str, float]] | None = None,
    power: float = 0.7,
    share: float = 0.8,
    seed: int = 8,
    margins: Sequence[str] = MARGINS,
    topics: Column | None = None,
) -> DataFrame:
    """docs (doc_id, text, source, lang) and n_tokens, topic, weight, probability, sampled.

    share: of all tokens, how many the sample is to hold. weight: the document's token weight (1 where the corpus
    has its target share already). A null margin is a value of its own, shown as null; documents without tokens have
    weight and probability 0. A null doc_id draws like any value; rows that share a doc_id are drawn together.
    Columns with the new names are replaced, others stay whatever their names, an empty table stays empty. given:
    target shares by margin and value, as in TARGETS; see targets_of() for what they don't name. Up to MAX_CELLS cells
    are fitted on the driver and broadcast; more are fitted in Spark and joined, with the same result but for rounding.
    """
    spark = docs.sparkSession
    new = ("n_tokens", "weight", "probability", "sampled")
    base = docs.drop(*new, *(["topic"] if "topic" in margins else []))
    # names of this call's own columns: longer than any that docs has
    own = "_" * (max(map(len, docs.columns), default=0) + 1)
    made = [n_tokens(F.col("text")).alias("n_tokens")]
    if "topic" in margins:
        made.append((topic(F.col("text")) if topics is None else topics).alias("topic"))
    # a row of its own for what is read from the text, so that it is read once, however often it is used
    base = base.select("*", F.inline(F.array(F.struct(*made))))
    # a null and the word null are different values
    named = [F.when(F.col(m).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(m).cast("string"))) for m in margins]
    sums = base.select("n_tokens", *(c.alias(m) for m, c in zip(margins, named)))
    sums = sums.groupBy(*margins).agg(F.sum("n_tokens").alias("tokens"))
    chosen = {m: {("-" if v is None else f"+{v}"): x for v, x in t.items()} for m, t in (given or {}).items()}
    held = sums.limit(MAX_CELLS + 1).toPandas()
    if len(held) > MAX_CELLS:
        looked = _fit_many(checkpoint(sums), margins, chosen, power, share)
        looked = looked.select(*(F.col(m).alias(f"{own}{m}") for m in margins), "weight", "probability")
    else:
        cells = held.sort_values(list(margins), kind="stable", ignore_index=True)
        total = float(cells["tokens"].sum())
        if total > 0:
            fit = rake(cells, targets_of(cells, margins, chosen, power)).cells
            fit["probability"] = inclusion(fit, share * total)
            fit["weight"] = fit["weight"] * total
        else:
            fit = cells.assign(weight=0.0, probability=0.0)
        table = fit[[*margins, "weight", "probability"]].rename(columns={m: f"{own}{m}" for m in margins})
        kinds = dict.fromkeys((f"{own}{m}" for m in margins), "string") | {"weight": "double", "probability": "double"}
        looked = F.broadcast(local_table(spark, table, kinds))
    keys = [f"{own}{m}" for m in margins]
    out = base.select("*", *(c.alias(k) for k, c in zip(keys, named))).join(looked, keys, "left").drop(*keys)
    zero = F.col("n_tokens") == 0
    out = out.withColumns({c: F.when(zero, 0.0).otherwise(F.coalesce(c, F.lit(0.0))) for c in ("weight", "probability")})
    return out.withColumn("sampled", uniform(F.col("doc_id"), seed) < F.col("probability"))


def _targets_many(cells: DataFrame, m: str, given: Mapping[str, float] | None, power: float) -> DataFrame | None:
    """(m, want): targets_of() for one margin of many cells."""
    seen = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("t")).where("t > 0")
    if given is None:
        seen = seen.withColumn("want", F.pow("t", F.lit(float(power))))
    else:
        table = local_table(cells.sparkSession, {m: list(given), "named": [float(x) for x in given.values()]}, {m: "string", "named": "double"})
        seen = seen.join(F.broadcast(table), m, "left")
        sums = seen.where("named is not null").agg(F.sum("named"), F.sum("t")).first()
        if not sums[0]:
            return None
        seen = seen.withColumn("want", F.coalesce(F.col("named") / sums[0] * sums[1], "t"))
    total = seen.agg(F.sum("want")).first()[0]
    return checkpoint(seen.select(m, (F.col("want") / total).alias("want"))) if total else None


def _fit_many(cells: DataFrame, margins: Sequence[str], given: Mapping[str, Mapping[str, float]], power: float, share: float, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """cells (margins, tokens) with weight and probability: targets_of(), rake() and inclusion() in Spark."""
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    if not total:
        return cells.withColumns({"weight": F.lit(0.0), "probability": F.lit(0.0)})
    wanted = {m: w for m in margins if (w := _targets_many(cells, m, given.get(m), power)) is not None}
    held = F.sum(F.col("tokens") * F.col("weight")).alias("have")
    fit = stage(cells.withColumn("weight", F.when(F.col("tokens") > 0, 1 / total).otherwise(0.0)), "cells")
    for _ in range(rounds if wanted else 0):
        for m, want in wanted.items():
            factor = fit.groupBy(m).agg(held).where("have > 0").join(want, m).select(m, (F.col("want") / F.col("have")).alias("factor"))
            scaled = fit.join(factor, m, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(0.0))).drop("factor")
            old, fit = fit, stage(scaled, "cells")
            drop_staged(old)
        off = [fit.groupBy(m).agg(held).join(want, m, "full").select(F.abs(F.coalesce("have", F.lit(0.0)) - F.coalesce("want", F.lit(0.0))).alias("off")) for m, want in wanted.items()]
        if functools.reduce(DataFrame.union, off).agg(F.max("off")).first()[0] < tolerance:
            break
    # water-filling: each step puts more cells at 1, until none is added
    budget, scale, n = share * total, 0.0, -1
    while True:
        at_one = F.col("weight") * scale >= 1
        rest, full, now = fit.agg(F.sum(F.when(~at_one, F.col("tokens") * F.col("weight"))), F.sum(F.when(at_one, F.col("tokens"))), F.count_if(at_one)).first()
        if now == n or not rest:
            break
        scale, n = max(budget - float(full or 0), 0.0) / rest, now
    # no cell with weight is left: all are at 1
    probability = F.least(F.col("weight") * scale, F.lit(1.0)) if rest else F.when(F.col("weight") > 0, 1.0).otherwise(0.0)
    return fit.withColumns({"weight": F.col("weight") * total, "probability": probability})
