"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact token length. A source whose target is e whole passes and a rest takes every document e
times and fills the rest with a subset whose lengths sum to it: a proportional share of each length first, the remaining
budget by bounded-knapsack dynamic programming over (length, documents left). Of each length the documents with the
smallest seeded hash are taken.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: A (source, length) group is dealt to this many tasks; their order by hash is still that of the whole group.
SALTS = 256
OUTPUT = ("size", "source_size", "target", "copies", "taken")


def fit_budget(lengths: np.ndarray, counts: np.ndarray, budget: int, window: int = 1 << 16) -> np.ndarray:
    """How many documents of each length to take so that their lengths sum to budget, or as near as can be.

    Proportional shares, rounded down, keep the length distribution; the rest is filled from the longest length down until
    at most `window` remains, and that is solved exactly by bounded-knapsack dynamic programming (binary-split counts).
    Time and memory depend on the number of distinct lengths and on `window`, not on the number of documents.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    total = int((lengths * counts).sum())
    if budget >= total:
        return counts.copy()
    taken = np.where(lengths > 0, (counts * (max(budget, 0) / max(total, 1))).astype(np.int64), 0)
    while (over := int((taken * lengths).sum()) - budget) > 0:  # only by the rounding of floats
        i = int(np.argmax(np.where(taken > 0, lengths, 0)))
        taken[i] -= min(taken[i], -(-over // lengths[i]))
    rest = budget - int((taken * lengths).sum())
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if rest <= window:
            break
        n = min(int(counts[i] - taken[i]), (rest - window + lengths[i] - 1) // lengths[i] if lengths[i] else 0, rest // lengths[i] if lengths[i] else 0)
        taken[i] += n
        rest -= n * int(lengths[i])
    if rest <= 0:
        return taken
    # Give back a document of each length in turn, so that the dynamic programme has room to reach the sum exactly.
    for _ in range(64):
        back = [i for i in order[::-1] if lengths[i] and taken[i]]
        for i in back:
            if rest < window // 2 and rest + lengths[i] <= window:
                taken[i] -= 1
                rest += int(lengths[i])
        if not back or rest >= window // 2:
            break
    # Sums a little above the rest count too: some sum lies within one document's length above it.
    span = rest + min(int(lengths.max()), window)
    reach, by = np.zeros(span + 1, bool), np.full(span + 1, -1, np.int64)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i in order:
        left, n = min(int(counts[i] - taken[i]), span // lengths[i] if lengths[i] else 0), 1
        while left > 0 and not reach[rest]:
            part = min(n, left)
            w = part * int(lengths[i])
            new = np.flatnonzero(reach[: span + 1 - w] & ~reach[w:]) + w if w <= span else np.zeros(0, np.int64)
            by[new] = len(items)
            reach[new] = True
            items.append((int(i), part))
            left, n = left - part, n * 2
        if reach[rest]:
            break
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        i, part = items[by[at]]
        taken[i] += part
        at -= part * int(lengths[i])
    return taken


def source_targets(sizes: DataFrame, weights: Sequence[float], max_repeat: int, share: float) -> DataFrame:
    """(_src, source_size) -> with `target`: shares by weight, none above max_repeat times the source's size.

    One row a source. Weights repeat over sources by code point, null last. Sources that reach their cap are a prefix in the
    order of cap / weight, so the resharing needs no loop: running sums give the level at which the rest share.
    """
    everything = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_n") % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy("_ratio", "_n")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    out = (
        sizes.withColumn("_n", F.row_number().over(Window.orderBy(F.col("_src").asc_nulls_last())) - 1)
        .withColumn("_w", w)
        .withColumn("_cap", F.col("source_size") * float(max_repeat))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_all", F.sum("source_size").over(everything) * float(share))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_wleft", F.sum("_w").over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("_level", F.col("_left") / F.col("_wleft"))
        .withColumn("_capped", F.col("_ratio") <= F.col("_level"))
        .withColumn("_open", F.min(F.when(~F.col("_capped"), F.struct("_ratio", "_n", "_level"))).over(everything))
    )
    return out.select("_src", "source_size", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_w") * F.col("_open._level")).alias("target"))


def _prepared(docs: DataFrame, keep: dict[str, Column], id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    size = common.n_words(F.col(text_col))
    return docs.select(
        *[c.alias(f"k_{name}") for name, c in keep.items()],
        F.col(source_col).alias("_src"),
        F.concat(F.when(F.col(source_col).isNull(), "n").otherwise("s"), F.coalesce(F.col(source_col), F.lit(""))).alias("_key"),
        size.alias("_size"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(source_col), F.col(text_col)).alias("_h"),
        F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if not isinstance(docs.schema[c].dataType, T.MapType)]).alias("_tie"),
    ).withColumn("_salt", F.pmod(F.shiftrightunsigned(F.col("_h"), 40), F.lit(SALTS)).cast("int"))


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    max_repeat: int = 3,
    share: float = 1.0,
    seed: int = 17,
    window: int = 1 << 16,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Each document with how often the mix takes it.

    Returns the columns `keep` (by default the id) plus size (words), source_size, target (words wanted of the source),
    copies (0 to max_repeat) and taken (= size * copies). Sources: null is a source of its own and comes last. Null or empty
    texts have size 0 and are taken as often as the whole source is. Repeated rows and ids count row by row; ties by the hash of
    id, source and text are broken by id, then by a hash of all columns (maps apart), so reruns over reordered rows agree. An empty table gives no rows. Other columns pass through only if named in `keep`, under their own names,
    unless those are the names of the results.
    Every sum of words taken is as near its target as the lengths allow, to the word where a subset has that sum.
    """
    keep = [c for c in keep or [id_col] if c not in OUTPUT]
    slim = common.materialize(_prepared(docs, {"id": F.col(id_col)}, id_col, text_col, source_col, seed), "mix")
    by_salt = slim.groupBy("_key", "_size", "_salt").agg(F.count("*").alias("_n"), F.first("_src").alias("_src"))
    hist = common.materialize(by_salt, "mix-hist")
    sizes = hist.groupBy("_key").agg(F.first("_src").alias("_src"), F.sum(F.col("_size") * F.col("_n")).alias("source_size"))
    goal = source_targets(sizes, weights, max_repeat, share).select(
        F.concat(F.when(F.col("_src").isNull(), "n").otherwise("s"), F.coalesce("_src", F.lit(""))).alias("_key"), "source_size", "target"
    )

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        s, t = int(pdf["source_size"].iloc[0]), float(pdf["target"].iloc[0])
        passes = min(int(t // s), max_repeat) if s else 0
        rest = int(round(t - passes * s)) if passes < max_repeat else 0
        pdf = pdf.sort_values("_size")
        extra = fit_budget(pdf["_size"].to_numpy(), pdf["_n"].to_numpy(), rest, window) if rest > 0 else np.zeros(len(pdf), np.int64)
        return pd.DataFrame({"_key": pdf["_key"], "_size": pdf["_size"], "source_size": s, "target": t, "_passes": passes, "_extra": extra})

    counted = hist.groupBy("_key", "_size").agg(F.sum("_n").alias("_n")).join(goal, "_key")
    plans = counted.groupBy("_key").applyInPandas(plan, "_key string, _size long, source_size long, target double, _passes int, _extra long")
    upto = Window.partitionBy("_key", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        hist.join(plans, ["_key", "_size"])
        .withColumn("_lo", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
        .select("_key", "_size", "_salt", "source_size", "target", "_passes", F.greatest(F.lit(0), F.col("_extra") - F.col("_lo")).alias("_k"))
    )
    cells = common.materialize(cells, "mix-plan")
    plain = keep == [id_col]
    rows = slim if plain else _prepared(docs, {c: F.col(c) for c in keep}, id_col, text_col, source_col, seed).withColumn("k__id", F.col(f"k_{id_col}"))
    order = "k_id" if plain else "k__id"
    ranked = rows.drop("_src").withColumn("_r", F.row_number().over(Window.partitionBy("_key", "_size", "_salt").orderBy("_h", order, "_tie")))
    copies = F.col("_passes") + F.when(F.col("_r") <= F.col("_k"), 1).otherwise(0)
    return ranked.join(cells, ["_key", "_size", "_salt"]).select(
        *[F.col("k_id" if plain else f"k_{c}").alias(c) for c in keep], F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (F.col("_size") * copies).cast("long").alias("taken")
    )


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(common.read_table(spark, sf_dir, "documents"))
