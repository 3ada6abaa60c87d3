"""Benchmark decontamination by SimHash windows.

Windows of a document have the size of the benchmark item they may repeat and slide over its words one by one. A window is
fingerprinted only where it can reach the wanted similarity at all: the shingles that it shares with items of its size must weigh
that share of the lightest such item. This is a bound, so it loses no window. Window and item fingerprints meet in one of
radius + 1 blocks, which holds every pair within the Hamming radius, and each such pair is verified by the exact weighted
Jaccard similarity of its shingles. Weights are whole numbers, so the comparison with the threshold has no rounding.

All of it is DataFrame operations. Equal texts are worked on once. Only what comes of the benchmark is broadcast, if it is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BITS = 64
#: A shingle's weight is its ln(1 + items / items that have it) in units of 1 / UNIT.
UNIT = 1 << 20


def norm_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    t = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def shingle_hashes(ws: Column, k: int) -> Column:
    """64-bit hashes of the k-word shingles in order; empty below k words."""
    n = F.size(ws) - k + 1
    zipped = F.arrays_zip(*[F.slice(ws, i + 1, n).alias(f"w{i}") for i in range(k)])
    return F.when(n > 0, F.transform(zipped, lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def hashed(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("ws", norm_words(F.col("t"))).withColumn("hs", shingle_hashes(F.col("ws"), k)).drop("t", "ws")


def _small(table: DataFrame) -> DataFrame:
    """A materialized table, to be broadcast if its bytes are few."""
    few = common.bounded(table)
    return table if few is None else few


def simhash(rows: DataFrame, by: list[str], h: str = "h", w: str = "w") -> DataFrame:
    """(by, fp, total): one 64-bit SimHash of each group of weighted hashes, and its weight."""
    sums = [F.sum(F.when(F.shiftrightunsigned(h, i).bitwiseAND(1) == 1, F.col(w)).otherwise(-F.col(w))).alias(f"_s{i}") for i in range(BITS)]
    bits = [F.when(F.col(f"_s{i}") > 0, F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(BITS)]
    fp = bits[0]
    for b in bits[1:]:
        fp = fp.bitwiseOR(b)
    return rows.groupBy(*by).agg(F.sum(w).alias("total"), *sums).select(*by, fp.alias("fp"), "total")


def blocks(fp: Column, radius: int) -> Column:
    """(block, value) of each of radius + 1 blocks of a fingerprint."""
    n, at, out = radius + 1, 0, []
    for i in range(n):
        size = BITS // n + (i < BITS % n)
        out.append(F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, at).bitwiseAND((1 << size) - 1).alias("value")))
        at += size
    return F.array(*out)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    shingle: int = 5,
    similarity: float = 0.8,
    radius: int = 20,
) -> DataFrame:
    """(id, row, item, similarity, start): the best window of each document and item with at least the wanted similarity.

    `row` is a 64-bit hash of id and text, which tells documents with equal ids apart. A shingle weighs its count times
    ln(1 + items / items that have it), rounded to 1 / UNIT. The similarity wanted counts to three decimals. Null and wordless
    texts, and texts or items with fewer words than a shingle, match nothing; a text shorter than an item is one window. Repeated
    documents and items each give their rows once. Of equally similar windows the first counts. Empty tables give no rows.
    Other columns are not looked at.
    """
    least = round(similarity * 1000)
    items = benchmark.select(F.col(item_col).alias("item"), norm_words(F.col(item_text)).alias("ws")).where(F.size("ws") >= shingle).distinct()
    at_item = common.materialize(items.select("item", F.size("ws").alias("size"), F.explode(shingle_hashes(F.col("ws"), shingle)).alias("h")), "items")
    n_items = at_item.select("item").distinct().count()
    scaled = lambda c: F.round(F.log1p(c) * UNIT).cast("long")
    top = scaled(F.lit(float(n_items)))  # the weight of a shingle that no item has
    weights = common.materialize(at_item.groupBy("h").agg(scaled(n_items / F.countDistinct("item")).alias("idf")), "weights")
    weigh = _small(weights)
    of_item = common.materialize(at_item.join(weigh, "h").groupBy("item", "size", "h").agg(F.count("*").alias("c"), F.first("idf").alias("w")), "item-shingles")
    lightest = of_item.groupBy("item", "size").agg(F.sum(F.col("c") * F.col("w")).alias("total")).groupBy("size").agg((F.min("total") * least).alias("floor"))
    lightest = _small(common.materialize(lightest, "lightest"))
    known = _small(common.materialize(of_item.select("size", "h", "w").distinct(), "known"))

    base = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("row"), F.xxhash64(text_col).alias("txt"), F.col(text_col).alias("t"))
    # Steps of their own, and outer generators, keep Catalyst from repeating the splits.
    places = hashed(base.select("txt", "t"), shingle).select("txt", F.size("hs").alias("m"), F.posexplode_outer("hs").alias("p", "h"))
    anchors = common.materialize(places.join(known, "h").select("txt", "m", "size", "p", "w").distinct(), "anchors")
    able = anchors.groupBy("txt", "size").agg(F.sum("w").alias("all")).join(lightest, "size").where(F.col("all") * 1000 >= F.col("floor")).select("txt", "size", "floor")
    n = F.col("size") - shingle + 1  # shingles of a window
    last = F.greatest(F.lit(0), F.col("m") - n)
    from_, to = F.least(last, F.greatest(F.lit(0), F.col("p") - n + 1)), F.least(last, F.col("p"))
    spread = anchors.join(able, ["txt", "size"]).select("txt", "size", "floor", "w", F.explode(F.sequence(from_, to)).alias("start"))
    spans = spread.groupBy("txt", "size", "start").agg(F.sum("w").alias("shared"), F.first("floor").alias("floor")).where(F.col("shared") * 1000 >= F.col("floor"))
    spans = common.materialize(spans.select("txt", "size", "start"), "spans")

    found = base.join(_small(common.materialize(spans.select("txt").distinct(), "texts")), "txt").select("txt", "t").dropDuplicates(["txt"])
    laid = spans.join(hashed(found, shingle).select("txt", "hs"), "txt")
    spots = laid.select("txt", "size", "start", F.explode(F.slice("hs", F.col("start") + 1, n)).alias("h")).join(weigh, "h", "left")
    counted = spots.groupBy("txt", "size", "start", "h").agg(F.count("*").alias("c"), F.first("idf").alias("idf"))
    windows = common.materialize(counted, "windows")
    fps = simhash(windows.select("txt", "size", "start", "h", (F.col("c") * F.coalesce("idf", top)).alias("w")), ["txt", "size", "start"])
    item_fp = simhash(of_item.select("item", "size", "h", (F.col("c") * F.col("w")).alias("w")), ["item", "size"])
    item_blocks = item_fp.select("item", F.col("size").alias("isize"), F.col("total").alias("itotal"), F.col("fp").alias("ifp"), F.explode(blocks(F.col("fp"), radius)).alias("b")).select("item", "isize", "itotal", "ifp", "b.*")
    item_blocks = _small(common.materialize(item_blocks, "item-blocks"))
    win_blocks = fps.select("txt", "size", "start", "fp", "total", F.explode(blocks(F.col("fp"), radius)).alias("b")).select("txt", "size", "start", "fp", "total", "b.*")
    met = win_blocks.join(item_blocks, (win_blocks["block"] == item_blocks["block"]) & (win_blocks["value"] == item_blocks["value"]) & (F.col("size") == F.col("isize")))
    pairs = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("ifp"))) <= radius).select("txt", "size", "start", "item", (F.col("total") + F.col("itotal")).alias("both")).distinct()

    # Exact verification: shared weight against each side's, with multiplicity.
    ours = windows.where("idf is not null").select("txt", "size", "start", "h", F.col("c").alias("cw"))
    shared = ours.join(_small(of_item), ["size", "h"]).groupBy("txt", "size", "start", "item").agg(F.sum(F.least("c", "cw") * F.col("w")).alias("shared"))
    scored = pairs.join(shared, ["txt", "size", "start", "item"]).where(F.col("shared") * 1000 >= (F.col("both") - F.col("shared")) * least)
    scored = scored.withColumn("similarity", F.col("shared") / (F.col("both") - F.col("shared")))
    best = scored.groupBy("txt", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("m"))
    best = _small(common.materialize(best, "best"))
    rows = base.select("id", "row", "txt").join(best, "txt").dropDuplicates(["row", "item"])
    return rows.select(F.col("id").alias(id_col), "row", F.col("item").alias(item_col), F.round("m.similarity", 6).alias("similarity"), (-F.col("m.back")).cast("int").alias("start"))


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, items = common.read_table(spark, sf_dir, "documents"), common.read_table(spark, sf_dir, "benchmark")
    return contaminated(docs.select("doc_id", "text"), items).drop("row")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without the documents that repeat a benchmark item. Null, empty and repeated rows, and clashing names, as in contaminated()."""
    hits = contaminated(docs.select(id_col, text_col), benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("row").alias("leak")).distinct()
    hits = _small(common.materialize(hits, "leaks"))
    return docs.join(hits, F.xxhash64(docs[id_col], docs[text_col]) == hits["leak"], "left_anti")
