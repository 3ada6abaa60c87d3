"""Operators over directed typed edges (type, from_id, to_id)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def incident(edges: DataFrame, node: str) -> DataFrame:
    """(neighbor, via, direction) of a node; a neighbour met in both directions by one type counts as outgoing."""
    out = edges.where(F.col("from_id") == node).select(F.col("to_id").alias("neighbor"), F.col("type").alias("via"), F.lit("outgoing").alias("direction"))
    into = edges.where(F.col("to_id") == node).select(F.col("from_id").alias("neighbor"), F.col("type").alias("via"), F.lit("incoming").alias("direction"))
    return out.unionByName(into).groupBy("neighbor", "via").agg(F.max("direction").alias("direction"))


def neighbors(edges: DataFrame, node: str) -> DataFrame:
    return incident(edges, node).select("neighbor").distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(file_id, n_edges, n_imports, n_reexports, n_sources) of edge targets."""
    return edges.groupBy(F.col("to_id").alias("file_id")).agg(
        F.count("*").alias("n_edges"),
        F.count_if(F.col("type") == "file_imports_file").alias("n_imports"),
        F.count_if(F.col("type") == "file_reexports_file").alias("n_reexports"),
        F.countDistinct("from_id").alias("n_sources"),
    )


def hydrate(edges: DataFrame, nodes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """edges with from_* and to_* columns of the nodes at either end; unknown ends stay null."""
    for end in ("from", "to"):
        edges = edges.join(nodes.select(F.col(key).alias(f"{end}_id"), *[F.col(c).alias(f"{end}_{c}") for c in columns]), f"{end}_id", "left")
    return edges


def two_hop(direct: DataFrame, edges: DataFrame, nodes: DataFrame, seed_order: list[Column], node_order: Callable[[], list[Column]], *, max_seeds: int = 40, per_seed: int = 16, limit: int = 200) -> DataFrame:
    """Importers of the direct hits, in a bounded breadth-first walk.

    Seeds are the first max_seeds direct hits (id, scope, reason, path); each has its first per_seed importers, counted before
    those already visited are taken away; an importer belongs to its earliest seed. A seed at which something is cut off is the
    last that is walked: with more direct hits than max_seeds, that is the first. Returns (rank, file_id, seed_id, seed_rank).
    """
    ranked = direct.withColumn("_sr", F.row_number().over(Window.orderBy(*seed_order)))
    seeds = ranked.where(F.col("_sr") <= max_seeds)
    cut = ranked.agg((F.count("*") > max_seeds).alias("_cut"))
    imp = edges.select(F.col("to_id").alias("id"), F.col("from_id").alias("file_id")).distinct().join(F.broadcast(seeds.select("id", "_sr")), "id")
    imp = imp.join(nodes, "file_id")
    w = Window.partitionBy("_sr")
    imp = imp.withColumn("_r", F.row_number().over(w.orderBy(*node_order()))).withColumn("_n", F.count("*").over(w))
    last = imp.where(F.col("_n") > per_seed).agg(F.min("_sr").alias("_full"))
    stop = F.broadcast(last.join(cut, F.lit(True)).select(F.least(F.col("_full"), F.when(F.col("_cut"), 1)).alias("_stop")))
    walked = imp.where(F.col("_r") <= per_seed).join(stop, F.col("_stop").isNull() | (F.col("_sr") <= F.col("_stop")))
    new = walked.join(F.broadcast(seeds.select(F.col("id").alias("file_id"))), "file_id", "left_anti")
    best = new.withColumn("_b", F.row_number().over(Window.partitionBy("file_id").orderBy("_sr", "_r"))).where("_b = 1")
    out = best.withColumn("rank", F.row_number().over(Window.orderBy("_sr", "_r")).cast("long")).where(F.col("rank") <= limit)
    return out.select("rank", "file_id", F.col("id").alias("seed_id"), F.col("_sr").cast("long").alias("seed_rank"))


def components(edges: DataFrame, a: str, b: str, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component): the smallest node reachable, by label propagation with pointer jumping; save() cuts lineage a round."""
    e = save(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).union(edges.select(F.col(b), F.col(a))).distinct())
    lab = save(e.groupBy("u").agg(F.least(F.min("u"), F.min("v")).alias("l")).withColumnRenamed("u", "node"))
    while True:
        near = e.join(lab.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("l").alias("m")).withColumnRenamed("u", "node")
        step = lab.join(near, "node").select("node", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        hop = lab.select(F.col("node").alias("l"), F.col("l").alias("up"))
        step = save(step.join(hop, "l").select("node", "old", F.least("l", "up").alias("l")))
        lab = step.select("node", "l")
        if not step.where("l <> old").limit(1).count():
            return lab.withColumnRenamed("l", "component")


def spanning_forest(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): of edges between longs, fewer with the same components; each task keeps one edge for each of its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = parent[x]
            return x

        for batch in batches:
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(u), root(v)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], [a, b])

    return edges.select(a, b).mapInArrow(run, f"{a} long, {b} long")


#: Edges of up to so many are one task's work.
SMALL_EDGES = 1 << 19


def forest_components(edges: DataFrame, a: str, b: str, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """components() of edges between longs, over a spanning forest of them; a small one is walked in one task."""
    forest = save(spanning_forest(edges, a, b))
    if forest.count() <= SMALL_EDGES:
        return save(spanning_forest(forest.toDF("node", "component").coalesce(1), "node", "component"))
    return components(forest, a, b, save)


def render_tree(edges: DataFrame, root: str, max_depth: int) -> DataFrame:
    """(path, depth, node) of the tree below a root, one row per path; a node that its own path holds already ends it."""
    level = edges.sparkSession.createDataFrame([(root, 0, root)], "path string, depth int, node string")
    out = level
    kids = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("kid"))
    for depth in range(1, max_depth + 1):
        level = level.join(kids, "node").where(~F.array_contains(F.split("path", ">"), F.col("kid")))
        level = level.select(F.concat("path", F.lit(">"), "kid").alias("path"), F.lit(depth).alias("depth"), F.col("kid").alias("node"))
        out = out.unionByName(level)
    return out
