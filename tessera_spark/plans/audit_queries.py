"""Snapshots, fingerprints, integrity and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import tables
from . import corpus as C
from .registry import query


@query(
    f"""WITH {C.SNAPSHOTS} SELECT coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'deleted' WHEN a.sha256 <> b.sha256 OR a.size <> b.size THEN 'modified' ELSE 'unchanged' END AS change
FROM a FULL OUTER JOIN b ON a.key = b.key"""
)
def snapshot_diff(spark, d):
    a, b = C.snapshot(spark, d)
    return tables.diff(a, b, "key", ["sha256", "size"])


@query(
    f"""WITH {C.SNAPSHOTS}, ch AS (SELECT coalesce(a.key, b.key) AS key FROM a FULL OUTER JOIN b ON a.key = b.key WHERE a.key IS NULL OR b.key IS NULL OR a.sha256 <> b.sha256)
SELECT key, sha256 FROM a WHERE key NOT IN (SELECT key FROM ch) UNION ALL SELECT key, sha256 FROM b WHERE key IN (SELECT key FROM ch)"""
)
def snapshot_merge(spark, d):
    """The old snapshot brought up to date with only what changed; equal to the new one."""
    a, b = (x.select("key", "sha256", "size") for x in C.snapshot(spark, d))
    changed = tables.diff(a, b, "key", ["sha256", "size"]).where("change <> 'unchanged'")
    return tables.merge(a, b, changed, "key").select("key", "sha256")


_FP = "sha256(string_agg(CAST(key AS VARCHAR) || chr(9) || sha256, chr(10) ORDER BY key))"


@query(f"WITH {C.SNAPSHOTS} SELECT repo, count(*) AS n_files, {_FP} AS fingerprint FROM a GROUP BY repo")
def fingerprint_repo(spark, d):
    return tables.fingerprint(C.snapshot(spark, d)[0], "repo", "key", "sha256")


@query(
    f"""WITH {C.SNAPSHOTS}, fa AS (SELECT repo, count(*) AS n, {_FP} AS f FROM a GROUP BY repo), fb AS (SELECT repo, count(*) AS n, {_FP} AS f FROM b GROUP BY repo)
SELECT coalesce(fa.repo, fb.repo) AS repo, CASE WHEN fb.f IS NULL THEN 'missing' WHEN fa.f IS NULL THEN 'unexpected' WHEN fa.f = fb.f THEN 'fresh' WHEN fa.n <> fb.n THEN 'count_differs' ELSE 'content_differs' END AS issue
FROM fa FULL OUTER JOIN fb ON fa.repo = fb.repo"""
)
def fingerprint_compare(spark, d):
    a, b = C.snapshot(spark, d)
    return tables.compare_fingerprints(tables.fingerprint(a, "repo", "key", "sha256"), tables.fingerprint(b, "repo", "key", "sha256"), "repo")


_CHECKS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("documents", "doc_id", "labels", "doc_id"),
    ("events", "user_id", "customer", "c_custkey"),
]


@query(" UNION ALL ".join(f"SELECT '{c}.{k}' AS \"check\", count(*) AS n_orphans FROM {c} WHERE {k} NOT IN (SELECT {q} FROM {p})" for c, k, p, q in _CHECKS))
def orphan_audit(spark, d):
    parts = [tables.orphans(C.table(spark, d, c), k, C.table(spark, d, p), q, f"{c}.{k}") for c, k, p, q in _CHECKS]
    return reduce(DataFrame.unionByName, parts)


_SCOPE = """CASE WHEN length(text) = 0 THEN 'empty' WHEN lang NOT IN ('en', 'de', 'fr', 'es') THEN 'unsupported' WHEN source IN ('src0') THEN 'generated' WHEN length(text) > 20000 THEN 'oversized'
  WHEN regexp_matches(text, '[#*$%&]{3}') THEN 'asset' WHEN length(text) < 200 THEN 'config' ELSE 'source' END"""


@query(f"WITH s AS (SELECT source AS repo, {_SCOPE} AS scope FROM documents) SELECT repo, count_if(scope = 'source') AS n_source, count_if(scope = 'generated') AS n_generated, count_if(scope = 'oversized') AS n_oversized, count_if(scope = 'asset') AS n_asset, count_if(scope = 'config') AS n_config, count(*) AS total, floor(count_if(scope = 'source') / greatest(count(*), 1) * 1000 + 0.5) / 1000 AS ratio FROM s GROUP BY repo")
def coverage_scope(spark, d):
    """Files of each repository by the first rule that they meet."""
    n = F.length("text")
    scope = (
        F.when(n == 0, "empty").when(~F.col("lang").isin("en", "de", "fr", "es"), "unsupported").when(F.col("source") == "src0", "generated").when(n > 20000, "oversized")
        .when(F.col("text").rlike("[#*$%&]{3}"), "asset").when(n < 200, "config").otherwise("source")
    )
    s = C.table(spark, d, "documents").select(F.col("source").alias("repo"), scope.alias("scope"))
    kinds = ["source", "generated", "oversized", "asset", "config"]
    g = s.groupBy("repo").agg(*[F.count_if(F.col("scope") == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("total"))
    return g.withColumn("ratio", text.round3(F.col("n_source") / F.greatest(F.col("total"), F.lit(1))))


_SIGNALS = [("large", "value > 30"), ("error", "event_type = 'error'"), ("late_month", "day(ts) > 15"), ("night", "hour(ts) < 6")]


@query(
    f"""WITH e AS (SELECT event_type AS change_kind, list_filter([{', '.join(f"CASE WHEN {c} THEN '{s}' END" for s, c in _SIGNALS)}], lambda x: x IS NOT NULL) AS signals FROM events),
x AS (SELECT change_kind, unnest(signals) AS signal FROM e) SELECT signal, count_if(change_kind = 'click') AS n_click, count_if(change_kind = 'view') AS n_view, count_if(change_kind = 'error') AS n_error, count(*) AS n FROM x GROUP BY signal"""
)
def change_overview(spark, d):
    """Change signals by kind of change."""
    signals = F.array_compact(F.array(*[F.when(F.expr(c), s) for s, c in _SIGNALS]))
    x = C.table(spark, d, "events").select(F.col("event_type").alias("change_kind"), F.explode(signals).alias("signal"))
    return x.groupBy("signal").agg(*[F.count_if(F.col("change_kind") == k).alias(f"n_{k}") for k in ("click", "view", "error")], F.count("*").alias("n"))


#: Metric, ratio and floor at which a drop counts as a regression.
_GUARDS = [("files", 0.15, 2), ("symbols", 0.25, 5), ("edges", 0.2, 5)]


@query(
    """WITH m AS (SELECT source AS repo, 'files' AS metric, count(*) AS baseline, count_if(lang = 'en') AS current FROM documents GROUP BY source
UNION ALL SELECT source, 'symbols', sum(len(string_split(text, chr(10)))), sum(CASE WHEN lang = 'es' THEN len(string_split(text, chr(10))) ELSE 0 END) FROM documents GROUP BY source
UNION ALL SELECT source, 'edges', count(DISTINCT lang) * 10, count(DISTINCT CASE WHEN length(text) > 30000 THEN lang END) FROM documents GROUP BY source),
g AS (SELECT * FROM (VALUES ('files', 0.15, 2), ('symbols', 0.25, 5), ('edges', 0.2, 5)) t(metric, r, low))
SELECT repo, metric, CAST(baseline AS BIGINT) AS baseline, CAST(current AS BIGINT) AS current, baseline >= 20 AND current / baseline <= CAST(r AS DOUBLE) AND current <= low AS regressed FROM m JOIN g USING (metric)"""
)
def count_regression(spark, d):
    """Counts that fell so far below their baseline that a refresh must not be published."""
    t = C.table(spark, d, "documents")
    n_lines = F.size(F.split("text", "\n"))
    g = t.groupBy(F.col("source").alias("repo")).agg(
        F.count("*").alias("fb"), F.count_if(F.col("lang") == "en").alias("fc"), F.sum(n_lines).alias("sb"), F.sum(F.when(F.col("lang") == "es", n_lines).otherwise(0)).alias("sc"),
        (F.countDistinct("lang") * 10).alias("eb"), F.countDistinct(F.when(F.length("text") > 30000, F.col("lang"))).alias("ec"),
    )
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(b).alias("baseline"), F.col(c).alias("current"), F.lit(r).alias("r"), F.lit(low).alias("low")) for (m, r, low), (b, c) in zip(_GUARDS, (("fb", "fc"), ("sb", "sc"), ("eb", "ec")), strict=True)])
    x = g.select("repo", F.explode(rows).alias("m")).select("repo", "m.*")
    return x.select("repo", "metric", "baseline", "current", ((F.col("baseline") >= 20) & (F.col("current") / F.col("baseline") <= F.col("r")) & (F.col("current") <= F.col("low"))).alias("regressed"))


@query(
    f"""WITH {C.SNAPSHOTS}, fa AS (SELECT repo, count(*) AS n FROM a GROUP BY repo), st AS (SELECT coalesce(a.repo, b.repo) AS repo, count_if(a.key IS NULL) AS added, count_if(b.key IS NULL) AS deleted, count_if(a.sha256 <> b.sha256) AS modified FROM a FULL OUTER JOIN b ON a.key = b.key GROUP BY 1)
SELECT st.repo, added, deleted, modified, CASE WHEN added + deleted + modified = 0 THEN 'trusted' WHEN (added + deleted + modified) / greatest(n, 1) > 0.5 THEN 'stale' ELSE 'drifted' END AS state,
  CASE WHEN 1 - (added + deleted + modified) / greatest(n, 1) < 0.6 THEN 'low' WHEN 1 - (added + deleted + modified) / greatest(n, 1) > 0.9 THEN 'high' ELSE 'medium' END AS confidence FROM st JOIN fa USING (repo)"""
)
def trust_state(spark, d):
    """How far an index of each repository can be trusted after a change."""
    a, b = C.snapshot(spark, d)
    x, y = a.select("key", F.col("repo").alias("ra"), F.col("sha256").alias("ha")), b.select("key", F.col("repo").alias("rb"), F.col("sha256").alias("hb"))
    j = x.join(y, "key", "full_outer").groupBy(F.coalesce("ra", "rb").alias("repo"))
    g = j.agg(F.count_if(F.col("ha").isNull()).alias("added"), F.count_if(F.col("hb").isNull()).alias("deleted"), F.count_if(F.col("ha") != F.col("hb")).alias("modified"), F.count("ha").alias("n"))
    all_ = F.col("added") + F.col("deleted") + F.col("modified")
    share = all_ / F.greatest(F.col("n"), F.lit(1))
    state = F.when(all_ == 0, "trusted").when(share > 0.5, "stale").otherwise("drifted")
    conf = F.when(1 - share < 0.6, "low").when(1 - share > 0.9, "high").otherwise("medium")
    return g.select("repo", "added", "deleted", "modified", state.alias("state"), conf.alias("confidence"))


@query(
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 21600000000 THEN 0 ELSE 1 END AS fresh FROM events),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, CAST(burst AS BIGINT) AS burst, count(*) AS n_requests, CASE WHEN count(*) > 1 THEN 2 ELSE 1 END AS n_runs FROM b GROUP BY user_id, burst"""
)
def coalesced_refresh(spark, d):
    """Bursts of requests of a scope, no more than six hours apart; each costs one run and at most one follow-up."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = C.table(spark, d, "events").select("user_id", "ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)
    b = e.withColumn("fresh", F.when(gap <= 21_600_000_000, 0).otherwise(1)).withColumn("burst", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return b.groupBy("user_id", "burst").agg(F.count("*").alias("n_requests")).withColumn("n_runs", F.when(F.col("n_requests") > 1, 2).otherwise(1))
