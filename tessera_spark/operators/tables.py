"""Relational operators over entity, edge and snapshot tables. Every column name is a parameter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frequencies(symbols: DataFrame, name: str, repo: str, kind: str, exported: str) -> DataFrame:
    """(level, outer_key, name, n): five counts in one pass and one shuffle."""
    s = lambda level, outer, n: F.struct(F.lit(level).alias("level"), outer.cast("string").alias("outer_key"), n.alias("name"))
    none, n = F.lit(None), F.col(name)
    rows = F.array_compact(
        F.array(s("name", none, n), s("name_lower", none, F.lower(n)), s("repo_name", F.col(repo), n), s("kind_name", F.col(kind), n), F.when(F.col(exported), s("exported_name", none, n)))
    )
    return symbols.select(F.explode(rows).alias("r")).groupBy("r.level", "r.outer_key", "r.name").agg(F.count("*").alias("n"))


def keep_best(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in a total order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def ordinals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "ordinal") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def best_tier(tiers: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of candidate tables, of each key only the rows of its first tier that has any."""
    out = None
    for i, t in enumerate(tiers):
        t = t.withColumn("_tier", F.lit(i))
        out = t if out is None else out.unionByName(t)
    return out.withColumn("_best", F.min("_tier").over(Window.partitionBy(*keys))).where("_tier = _best").drop("_tier", "_best")


def resolve_unique(imports: DataFrame, targets: DataFrame, on: Sequence[str], keys: Sequence[str], target: str) -> DataFrame:
    """(keys, status, target, n_targets): resolved if exactly one distinct target matches, else ambiguous or unresolved.

    The columns `on` must follow from the keys. Targets are counted once for each value of `on`, before they meet any import.
    """
    t = targets.groupBy(*on).agg(F.countDistinct(target).alias("n_targets"), F.min(target).alias("_t"))
    hits = imports.select(*keys, *[c for c in on if c not in keys]).distinct().join(t, list(on), "left")
    n = F.coalesce("n_targets", F.lit(0))
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    return hits.select(*keys, status.alias("status"), F.when(n == 1, F.col("_t")).alias("target"), n.alias("n_targets"))


def nearest_ancestor(files: DataFrame, configs: DataFrame, key: str, path: str, config_dir: str, config: str) -> DataFrame:
    """Each file with the config of its nearest ancestor directory: an equi-join on exploded ancestors, not a prefix join."""
    from ..functions import paths

    up = files.select(key, F.explode(paths.ancestors(F.col(path))).alias("a")).select(key, F.col("a.dir").alias("_d"), F.col("a.depth").alias("depth"))
    hit = up.join(configs.select(F.col(config_dir).alias("_d"), F.col(config).alias("config")), "_d")
    best = hit.groupBy(key).agg(F.max(F.struct("depth", "config")).alias("b")).select(key, F.col("b.config").alias("config"), F.col("b.depth").cast("long").alias("depth"))
    return files.select(key).join(best, key, "left")


def innermost_interval(points: DataFrame, spans: DataFrame, group: str, at: str, start: str, end: str, name: str, width: int = 64) -> DataFrame:
    """Each point with the shortest span of its group that holds it, then the earliest. Spans are dealt to buckets of width, so the range join is an equi-join."""
    b = spans.select(group, start, end, name, F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))).alias("_b"))
    p = points.withColumn("_b", F.floor(F.col(at) / width))
    hit = p.join(b, [group, "_b"]).where(F.col(at).between(F.col(start), F.col(end)))
    best = hit.groupBy(group, at).agg(F.min(F.struct((F.col(end) - F.col(start)).alias("span"), F.col(start).alias("s"), F.col(name).alias("n"))).alias("m"))
    return points.join(best.select(group, at, F.col("m.n").alias(name), F.col("m.s").alias(start)), [group, at], "left")


def override(base: DataFrame, better: DataFrame, by: str) -> DataFrame:
    """better where it has rows for a key, base elsewhere."""
    return base.join(better.select(by).distinct(), by, "left_anti").unionByName(better)


def diff(old: DataFrame, new: DataFrame, key: str, compare: Sequence[str]) -> DataFrame:
    """(key, change): added, deleted, modified or unchanged; modified if any compared column differs, nulls being equal."""
    a, b = old.select(key, F.struct(*compare).alias("_a")), new.select(key, F.struct(*compare).alias("_b"))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(~F.col("_a").eqNullSafe(F.col("_b")), "modified").otherwise("unchanged")
    return j.select(key, change.alias("change"))


def merge(old: DataFrame, fresh: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """Old rows of unchanged keys with fresh rows of changed ones."""
    return old.join(changed.select(key), key, "left_anti").unionByName(fresh.join(changed.select(key), key, "left_semi"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, check: str) -> DataFrame:
    gone = child.select(F.col(key).alias("_k")).join(parent.select(F.col(parent_key).alias("_k")), "_k", "left_anti")
    return gone.agg(F.count("*").alias("n_orphans")).select(F.lit(check).alias("check"), "n_orphans")


def fingerprint(files: DataFrame, group: str, path: str, content_hash: str) -> DataFrame:
    """(group, n_files, fingerprint): SHA-256 over `path<tab>hash` lines in path order; lists are a group's own short hashes."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), F.col(content_hash).alias("h")))), lambda x: F.concat(x["p"].cast("string"), F.lit("\t"), x["h"]))
    return files.groupBy(group).agg(F.count("*").alias("n_files"), F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


def compare_fingerprints(wanted: DataFrame, found: DataFrame, group: str) -> DataFrame:
    a = wanted.select(group, F.col("fingerprint").alias("_fa"), F.col("n_files").alias("_na"))
    b = found.select(group, F.col("fingerprint").alias("_fb"), F.col("n_files").alias("_nb"))
    j = a.join(b, group, "full_outer")
    issue = (
        F.when(F.col("_fb").isNull(), "missing")
        .when(F.col("_fa").isNull(), "unexpected")
        .when(F.col("_fa") == F.col("_fb"), "fresh")
        .when(F.col("_na") != F.col("_nb"), "count_differs")
        .otherwise("content_differs")
    )
    return j.select(group, issue.alias("issue"))


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k of each group with their rank, and the group's total."""
    w = Window.partitionBy(*group)
    return df.withColumn("rank", F.row_number().over(w.orderBy(*order)).cast("long")).withColumn("total", F.count("*").over(w)).where(F.col("rank") <= k)


def merge_evidence(rows: DataFrame, key: str, reason: str, confidence: str, ranks: dict[str, int]) -> DataFrame:
    """(key, n_evidence, confidence, reasons): evidence of a key united, the strongest confidence kept, reasons as a sorted set."""
    rank = F.element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), F.col(confidence))
    g = rows.groupBy(key).agg(F.count("*").alias("n_evidence"), F.max(F.struct(rank.alias("r"), F.col(confidence).alias("c"))).alias("m"), F.array_sort(F.collect_set(reason)).alias("s"))
    return g.select(key, "n_evidence", F.col("m.c").alias("confidence"), F.array_join("s", ",").alias("reasons"))


def early_stop(rows: DataFrame, group: Sequence[str], order: Sequence[Column], cls: str, item: str, caps: dict[str, int], strong: str, medium: str, enough: int, need_medium: int) -> DataFrame:
    """An ordered scan of each group with caps by class that stops after the first accepted row at which enough is known."""
    w = Window.partitionBy(*group).orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cap = F.element_at(F.create_map(*[F.lit(x) for kv in caps.items() for x in kv]), F.col(cls))
    seen = rows.withColumn("_k", F.row_number().over(Window.partitionBy(*group, cls).orderBy(*order))).where(F.col("_k") <= cap)
    first = (F.row_number().over(Window.partitionBy(*group, cls, item).orderBy(*order)) == 1) & (F.col(cls) == strong)
    seen = seen.withColumn("_new", first.cast("int")).withColumn("_pos", F.row_number().over(w).cast("long"))
    seen = seen.withColumn("_strong", F.sum("_new").over(run)).withColumn("_medium", F.sum((F.col(cls) == medium).cast("int")).over(run))
    stop = F.when((F.col("_strong") >= enough) & (F.col("_medium") >= min(need_medium, caps[medium])), F.col("_pos"))
    seen = seen.withColumn("_stop", F.min(stop).over(Window.partitionBy(*group)))
    return seen.where(F.col("_stop").isNull() | (F.col("_pos") <= F.col("_stop"))).withColumnRenamed("_pos", "position").drop("_k", "_new", "_strong", "_medium", "_stop")
