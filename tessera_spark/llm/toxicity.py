"""Toxicity: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios.

Learning uses a bounded sample of labelled rows (`max_per_class`, taken by hash over all of them): executors make the features
of the sample's whole texts, and the driver gets the counts of the features that weigh and, of each text, which of them it has. Scoring covers every whole text on the executors, in Arrow batches. Features are hashed n-grams of UTF-8 bytes inside a text with
ASCII letters lower-cased, present or absent, so neither length nor repetition dilutes a text's evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Texts are scored this many bytes at a time, so that one batch of very long texts cannot fill memory; n-grams overlap the cuts.
BLOCK = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Params:
    sizes: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    max_per_class: int = 3000
    min_docs: int = 4
    smooth: float = 0.5
    g2: float = 12.0
    rounds: int = 60
    l2: float = 0.02
    seed: int = 11


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace").lower()


def grams(block: np.ndarray, size: int, bits: int) -> np.ndarray:
    """Hash of each run of `size` bytes of block."""
    if len(block) < size:
        return np.zeros(0, np.uint32)
    n = len(block) - size + 1
    packed = np.zeros(n, np.uint64)
    for i in range(size):
        packed <<= np.uint64(8)
        packed |= block[i : i + n]
    packed += np.uint64(size)
    packed *= _MIX
    packed >>= np.uint64(64 - bits)
    return packed.astype(np.uint32)


def features(text: str | None, p: Params) -> np.ndarray:
    data = np.frombuffer(_lower(text), np.uint8)
    return np.unique(np.concatenate([grams(data, s, p.bits) for s in p.sizes]))


def association(counts: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """G2 of each feature's presence and the label: it grows with the texts that a feature is in, and a class without it does not weaken it."""
    seen, out = counts.sum(0), np.zeros(counts.shape[1])
    for c, n in ((counts[0], n0), (counts[1], n1)):
        for here, total in ((c, seen), (n - c, n0 + n1 - seen)):
            met = here > 0
            out[met] += 2 * here[met] * np.log(here[met] / (total[met] * (n / (n0 + n1))))
    return out


def association_column(c0: Column, c1: Column, n0: int, n1: int) -> Column:
    """association() of columns."""
    seen, out = c0 + c1, F.lit(0.0)
    for c, n in ((c0, n0), (c1, n1)):
        for here, total in ((c, seen), (F.lit(n) - c, F.lit(n0 + n1) - seen)):
            out = out + F.when(here > 0, 2 * here * F.log(here / (total * (n / (n0 + n1))))).otherwise(0.0)
    return out


def select(counts: np.ndarray, n0: float, n1: float, p: Params) -> np.ndarray:
    """Log-count ratio of each hashed feature; 0 for those in fewer than min_docs texts or with a G2 below g2."""
    ratio = np.log((counts[1] + p.smooth) / (n1 + 2 * p.smooth)) - np.log((counts[0] + p.smooth) / (n0 + 2 * p.smooth))
    use = (counts.sum(0) >= p.min_docs) & (association(counts, n0, n1) >= p.g2)
    return np.where(use, ratio, 0.0)


#: Texts of the sample that a step of the solver looks at together; memory beside the features themselves goes with it.
STEP = 500


def solve(cols: np.ndarray, lens: np.ndarray, labels: np.ndarray, ratio: np.ndarray, p: Params, rate: float | None) -> tuple[np.ndarray, float]:
    """(weight of each feature, intercept). cols are the features of one text after another, lens of each, ratio the features' log-count ratios; rate is the share of label 1 among all labels, by default the sample's."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    # Half way between the labels' own share and even classes: rare classes are found without flooding the other.
    rate = (n1 / len(labels) if rate is None else rate) / 2 + 0.25
    weight = np.where(labels == 1, rate * len(labels) / n1, (1 - rate) * len(labels) / n0)
    ends = np.concatenate([[0], np.cumsum(lens)])
    w, b = np.zeros(len(ratio)), 0.0
    g2, gb2 = np.full(len(ratio), 1e-8), 1e-8
    for _ in range(p.rounds):  # AdaGrad on the whole sample
        scaled, g, gb = w * ratio, np.zeros(len(ratio)), 0.0
        for at in range(0, len(labels), STEP):
            part = slice(at, at + STEP)
            mine = cols[ends[at] : ends[min(at + STEP, len(labels))]].astype(np.int64)
            of = np.repeat(np.arange(len(lens[part])), lens[part])
            z = np.bincount(of, weights=scaled[mine], minlength=len(lens[part])) + b
            err = weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(labels)
            g += np.bincount(mine, weights=err[of], minlength=len(ratio))
            gb += err.sum()
        g = g * ratio + p.l2 * w / len(labels)
        g2 += g * g
        gb2 += gb * gb
        w -= 0.1 * g / np.sqrt(g2)
        b -= 0.1 * gb / np.sqrt(gb2)
    return w * ratio, float(b)


def whole(use: np.ndarray, weights: np.ndarray, p: Params) -> np.ndarray:
    """The weight of each hashed feature from those of the features in use."""
    out = np.zeros(1 << p.bits, np.float32)
    out[use] = weights
    return out


def one_class(labels: np.ndarray, p: Params) -> tuple[np.ndarray, float]:
    """The model of labels that are all equal, or none: the intercept alone."""
    only = (labels.sum() + p.smooth) / (len(labels) + 2 * p.smooth)
    return np.zeros(1 << p.bits, np.float32), float(np.log(only / (1 - only)))


def train(texts: list[str | None], labels: np.ndarray, p: Params = Params(), rate: float | None = None) -> tuple[np.ndarray, float]:
    """The model of texts at hand; fit() learns the same from tables."""
    labels = np.asarray(labels, np.float64)
    if len(labels) == 0 or labels.min() == labels.max():
        return one_class(labels, p)
    rows, counts = [features(t, p) for t in texts], np.zeros((2, 1 << p.bits), np.int64)
    for r, y in zip(rows, labels, strict=True):
        counts[int(y)][r] += 1
    ratio = select(counts, len(labels) - labels.sum(), labels.sum(), p)
    use, rows = np.flatnonzero(ratio), [r[ratio[r] != 0] for r in rows]
    weights, b = solve(np.searchsorted(use, np.concatenate(rows)), np.array([len(r) for r in rows]), labels, ratio[use], p, rate)
    return whole(use, weights, p), b


def score_one(text: str | None, weight: np.ndarray, b: float, p: Params) -> float:
    data, found, step = np.frombuffer(_lower(text), np.uint8), [], max(p.sizes) - 1
    for at in range(0, max(len(data), 1), BLOCK):
        block = data[at : at + BLOCK + step]
        for s in p.sizes:
            g = grams(block, s, p.bits)
            found.append(g[weight[g] != 0])
    z = float(weight[np.unique(np.concatenate(found))].sum(dtype=np.float64)) + b
    return 1 / (1 + float(np.exp(-np.clip(z, -30, 30))))


def labelled_sample(docs: DataFrame, labels: DataFrame, p: Params, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[DataFrame, float | None]:
    """((id, t, y), share of label 1 over all labels): of each class the max_per_class documents with the smallest hash of their id.

    Rows without label, id or text don't teach, nor do ids with both labels; an id with several texts teaches the one with the smallest hash.
    """
    y = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_y in (0, 1) and _id is not null")
    y = y.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where("_y = _z").select("_id", "_y")
    h = F.xxhash64(F.lit(p.seed), "_id")
    rate = y.agg(F.avg("_y").alias("rate")).first()["rate"]
    chosen = None
    for k in (0, 1):
        part = y.where(F.col("_y") == k).orderBy(h, "_id").limit(p.max_per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).where("_t is not null")
    # At most 2 * max_per_class ids, so the broadcast has a bound.
    one = texts.join(F.broadcast(chosen), "_id").groupBy("_id").agg(F.first("_y").alias("y"), F.min(F.struct(F.xxhash64("_t").alias("h"), F.col("_t").alias("t"))).alias("m"))
    return one.select(F.col("_id").alias("id"), F.col("m.t").alias("t"), "y"), rate


def fit(docs: DataFrame, labels: DataFrame, p: Params = Params(), **cols: str) -> tuple[np.ndarray, float]:
    """(weight of each hashed feature, intercept), learnt from labelled_sample()."""
    spark = docs.sparkSession
    with common.batches_of(spark, 500):
        sample, rate = labelled_sample(docs, labels, p, **cols)
        sample = common.materialize(sample, "labelled")
        size = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
        n0, n1 = size.get(0, 0), size.get(1, 0)
        if not n0 or not n1:
            return one_class(np.repeat([0.0, 1.0], [n0, n1]), p)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((2, 1 << p.bits), np.int32)
            for b in batches:
                for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                    counts[y][features(t.as_py(), p)] += 1
            some = np.flatnonzero(counts.sum(0))
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (some, counts[0][some], counts[1][some])], ["f", "c0", "c1"])

        texts = sample.select("t", "y").coalesce(8)  # bounded rows; few tasks keep the counts from being sent many times
        sums = texts.mapInArrow(count, "f int, c0 int, c1 int").groupBy("f").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
        # select() drops the same ones; here they do not even reach the driver.
        sums = sums.where((F.col("c0") + F.col("c1") >= p.min_docs) & (association_column(F.col("c0"), F.col("c1"), n0, n1) >= p.g2 * (1 - 1e-9))).toArrow()
        counts = np.zeros((2, 1 << p.bits), np.int64)
        f = np.asarray(sums["f"])
        counts[0][f], counts[1][f] = np.asarray(sums["c0"]), np.asarray(sums["c1"])
        ratio = select(counts, n0, n1, p)
        use = np.flatnonzero(ratio)

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [np.searchsorted(use, np.intersect1d(features(t.as_py(), p), use, assume_unique=True)).astype(np.int32) for t in b.column(1)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int32())), b.column(2)], ["id", "fs", "y"])

        kind = sample.schema["id"].dataType.simpleString()
        rows = sample.select("id", "t", "y").mapInArrow(keep, f"id {kind}, fs array<int>, y int").orderBy("id").drop("id").toArrow()
        common.discard(sample)
    lens = pa.compute.fill_null(pa.compute.list_value_length(rows["fs"]), 0).to_numpy()
    cols = np.concatenate([np.asarray(c.flatten()) for c in rows["fs"].chunks])
    labels = rows["y"].to_numpy().astype(np.float64)
    del rows
    weights, b = solve(cols, lens, labels, ratio[use], p, rate)
    return whole(use, weights, p), b


def scorer(model: tuple[np.ndarray, float], p: Params = Params()):
    weight, b = model
    keep = np.flatnonzero(weight)
    small = (keep.astype(np.uint32), weight[keep])  # what a task gets: only the features that weigh

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = np.zeros(1 << p.bits, np.float32)
        w[small[0]] = small[1]
        for s in parts:
            yield pd.Series([score_one(t, w, b, p) for t in s], dtype="float64")

    return score


def score_documents(docs: DataFrame, model, *, text_col: str = "text", out: str = "score", p: Params = Params()) -> DataFrame:
    """docs with the column `out`: 0 to 1, higher for texts likelier toxic.

    Null and empty texts get the intercept's score. Rows are scored one by one; repeated rows agree, other columns pass through.
    """
    common.limit_batches(docs.sparkSession)
    return docs.withColumn(out, scorer(model, p)(F.col(text_col)))


def is_held_out(id_col: Column, folds: int = 5) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == 0, F.lit(False))


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.read_table(spark, sf_dir, "labels").where(~is_held_out(F.col("doc_id")))
    model = fit(docs, labels)
    scored = score_documents(docs, model)
    return scored.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject_toxic(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, p: Params = Params()) -> DataFrame:
    """The documents scored below threshold, with their own columns. Null and empty texts get the intercept's score, repeated rows agree, an empty table gives no rows."""
    model = fit(docs, labels, p, id_col=id_col, text_col=text_col)
    common.limit_batches(docs.sparkSession)
    return docs.where(scorer(model, p)(F.col(text_col)) < threshold)
