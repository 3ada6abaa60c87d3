"""Edges, neighbourhoods, impact and trees."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import graph, tables
from . import corpus as C
from .registry import query


@query(f"WITH {C.EDGES} SELECT to_id AS file_id, count(*) AS n_edges, count_if(type = 'file_imports_file') AS n_imports, count_if(type = 'file_reexports_file') AS n_reexports, count(DISTINCT from_id) AS n_sources FROM edges GROUP BY to_id")
def file_fan_in(spark, d):
    return graph.degrees(C.edges(spark, d))


@query(
    f"""WITH {C.FILES}, {C.SYMBOLS}, {C.EDGES}
SELECT 'repo_contains_file' AS type, repo AS from_id, file_id AS to_id FROM files UNION ALL SELECT 'file_defines_symbol', file_id, symbol_id FROM symbols
UNION ALL SELECT 'file_exports_symbol', file_id, symbol_id FROM symbols WHERE exported UNION ALL SELECT type, from_id, to_id FROM edges"""
)
def repo_file_symbol_edges(spark, d):
    """The whole graph: five types of edges."""
    f, s = C.files(spark, d), C.symbols(spark, d)
    e = lambda df, kind, a, b: df.select(F.lit(kind).alias("type"), F.col(a).alias("from_id"), F.col(b).alias("to_id"))
    own = e(f, "repo_contains_file", "repo", "file_id").unionByName(e(s, "file_defines_symbol", "file_id", "symbol_id")).unionByName(e(s.where("exported"), "file_exports_symbol", "file_id", "symbol_id"))
    return own.unionByName(C.edges(spark, d).select("type", "from_id", "to_id"))


@query(f"WITH {C.EDGES} SELECT DISTINCT CASE WHEN from_id = 's7' THEN to_id ELSE from_id END AS neighbor FROM edges WHERE from_id = 's7' OR to_id = 's7'")
def neighbors_in_out(spark, d):
    return graph.neighbors(C.edges(spark, d), "s7")


@query(
    f"""WITH {C.EDGES} SELECT neighbor, via, max(direction) AS direction FROM (
  SELECT to_id AS neighbor, type AS via, 'outgoing' AS direction FROM edges WHERE from_id = 's7' UNION ALL SELECT from_id, type, 'incoming' FROM edges WHERE to_id = 's7') GROUP BY neighbor, via"""
)
def related_files_via(spark, d):
    return graph.incident(C.edges(spark, d), "s7")


@query(
    f"""WITH {C.FILES}, {C.EDGES} SELECT type, from_id, to_id, a.repo AS from_repo, a.path AS from_path, b.repo AS to_repo, b.path AS to_path
FROM edges LEFT JOIN files a ON a.file_id = from_id LEFT JOIN files b ON b.file_id = to_id"""
)
def semantic_hydrate(spark, d):
    h = graph.hydrate(C.edges(spark, d), C.files(spark, d), "file_id", ["repo", "path"])
    return h.select("type", "from_id", "to_id", "from_repo", "from_path", "to_repo", "to_path")


_CONTEXT = f"""{C.FILES}, {C.EDGES}, {C.SYMBOLS}, t AS (SELECT * FROM files WHERE file_id = 's1'),
cand AS (SELECT neighbor, max(strong) AS strong, sum(w) AS w, count(*) AS n FROM (
  SELECT from_id AS neighbor, 1 AS strong, 12 AS w FROM edges WHERE to_id = 's1' AND type = 'file_imports_file'
  UNION ALL SELECT from_id, 1, 10 FROM edges WHERE to_id = 's1' AND type = 'file_reexports_file'
  UNION ALL SELECT to_id, 0, 5 FROM edges WHERE from_id = 's1' AND type = 'file_reexports_file') GROUP BY neighbor),
names AS (SELECT DISTINCT file_id, name FROM symbols),
shared AS (SELECT b.file_id AS neighbor, count(*) AS k FROM names a JOIN names b USING (name) WHERE a.file_id = 's1' GROUP BY b.file_id),
scored AS (
  SELECT c.neighbor AS file_id, f.repo, f.path, c.strong, c.w + c.n + 2 * c.strong + 3 * coalesce(k, 0) + CASE WHEN f.repo = t.repo THEN 2 ELSE 0 END
    + CASE WHEN string_split(f.path, '/')[1] <> string_split(t.path, '/')[1] THEN 0 WHEN string_split(f.path, '/')[2] <> string_split(t.path, '/')[2] THEN 1 WHEN string_split(f.path, '/')[3] <> string_split(t.path, '/')[3] THEN 2 ELSE 3 END
    + CASE WHEN f.classification = 'page' THEN 4 ELSE -2 END AS score
  FROM cand c JOIN files f ON f.file_id = c.neighbor LEFT JOIN shared s ON s.neighbor = c.neighbor CROSS JOIN t)"""


@query(
    f"""WITH {_CONTEXT}, r AS (SELECT *, row_number() OVER (PARTITION BY strong ORDER BY score DESC, repo, path) AS rank, count(*) OVER (PARTITION BY strong) AS total FROM scored WHERE score > 0)
SELECT CASE WHEN strong = 1 THEN 'medium' ELSE 'weak' END AS bucket, rank, file_id, CAST(score AS BIGINT) AS score, total, total > 24 AS truncated FROM r WHERE rank <= 24"""
)
def file_related_rank(spark, d):
    """Files related to a target, scored and ranked in buckets of edge strength, 24 a bucket."""
    f, e = C.files(spark, d), C.edges(spark, d)
    into, out = e.where("to_id = 's1'"), e.where("from_id = 's1' and type = 'file_reexports_file'")
    w = F.when(F.col("type") == "file_imports_file", 12).otherwise(10)
    cand = into.select(F.col("from_id").alias("file_id"), F.lit(1).alias("strong"), w.alias("w")).unionByName(out.select(F.col("to_id").alias("file_id"), F.lit(0).alias("strong"), F.lit(5).alias("w")))
    cand = cand.groupBy("file_id").agg(F.max("strong").alias("strong"), F.sum("w").alias("w"), F.count("*").alias("n"))
    names = C.symbols(spark, d).select("file_id", "name").distinct()
    shared = names.join(names.where("file_id = 's1'").select("name"), "name").groupBy("file_id").agg(F.count("*").alias("k"))
    t = f.where("file_id = 's1'").select(F.col("repo").alias("t_repo"), F.col("path").alias("t_path"))
    j = cand.join(f, "file_id").join(shared, "file_id", "left").join(F.broadcast(t), F.lit(True))
    score = (
        F.col("w") + F.col("n") + 2 * F.col("strong") + 3 * F.coalesce("k", F.lit(0)) + F.when(F.col("repo") == F.col("t_repo"), 2).otherwise(0)
        + paths.closeness(F.col("path"), F.col("t_path")) + F.when(F.col("classification") == "page", 4).otherwise(-2)
    )
    j = j.withColumn("score", score.cast("long")).where("score > 0")
    top = tables.top_k_per_group(j, ["strong"], [F.desc("score"), F.col("repo"), F.col("path")], 24)
    return top.select(F.when(F.col("strong") == 1, "medium").otherwise("weak").alias("bucket"), "rank", "file_id", "score", "total", (F.col("total") > 24).alias("truncated"))


_DIRECT = f"""{C.FILES}, {C.EDGES}, ord AS (SELECT f.*, len(string_split(path, '/')) AS segs FROM files f),
direct AS (SELECT DISTINCT to_id AS id, path FROM edges JOIN files ON file_id = to_id WHERE from_id = 's7' AND type = 'file_reexports_file'
  UNION SELECT from_id, path FROM edges JOIN files ON file_id = from_id WHERE to_id = 's7' AND type = 'file_reexports_file'),
seeds AS (SELECT * FROM (SELECT id, path, row_number() OVER (ORDER BY path, id) AS sr, count(*) OVER () AS n FROM direct) WHERE sr <= 40),
imp AS (SELECT sr, s.id, o.file_id, row_number() OVER (PARTITION BY sr ORDER BY segs, repo, o.path, o.file_id) AS r, count(*) OVER (PARTITION BY sr) AS cnt, s.n
  FROM seeds s JOIN (SELECT DISTINCT from_id, to_id FROM edges) e ON e.to_id = s.id JOIN ord o ON o.file_id = e.from_id),
stop AS (SELECT CASE WHEN (SELECT max(n) FROM seeds) > 40 THEN 1 ELSE coalesce((SELECT min(sr) FROM imp WHERE cnt > 16), 1000000) END AS s),
walked AS (SELECT * FROM imp, stop WHERE r <= 16 AND sr <= s AND file_id NOT IN (SELECT id FROM seeds)),
best AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sr, r) AS k FROM walked),
hop AS (SELECT row_number() OVER (ORDER BY sr, r) AS rank, file_id, id AS seed_id, sr AS seed_rank FROM best WHERE k = 1)"""


def _direct(spark, d):
    f, e = C.files(spark, d), C.edges(spark, d).where("type = 'file_reexports_file'")
    ids = e.where("from_id = 's7'").select(F.col("to_id").alias("file_id")).union(e.where("to_id = 's7'").select("from_id")).distinct()
    return ids.join(f, "file_id").select(F.col("file_id").alias("id"), "path")


@query(f"WITH {_DIRECT} SELECT rank, file_id, seed_id, seed_rank FROM hop WHERE rank <= 200")
def two_hop_impact(spark, d):
    """The files behind those that a change reaches at once."""
    nodes = C.files(spark, d).withColumn("segs", F.size(F.split("path", "/")))
    return graph.two_hop(_direct(spark, d), C.edges(spark, d), nodes, [F.col("path"), F.col("id")], lambda: [F.col("segs"), F.col("repo"), F.col("path"), F.col("file_id")])


@query(
    f"""WITH {_DIRECT}, a AS (SELECT file_id, 'indirect' AS scope FROM hop WHERE rank <= 200 UNION ALL SELECT id, 'direct' FROM direct)
SELECT repo, string_split(path, '/')[3] AS surface, count_if(scope = 'direct') AS n_direct, count_if(scope = 'indirect') AS n_indirect, count(*) AS n FROM a JOIN files USING (file_id) GROUP BY ALL"""
)
def impact_summary(spark, d):
    """Impacted files by repository and surface."""
    a = two_hop_impact(spark, d).select("file_id", F.lit("indirect").alias("scope")).unionByName(_direct(spark, d).select(F.col("id").alias("file_id"), F.lit("direct").alias("scope")))
    j = a.join(C.files(spark, d), "file_id").groupBy("repo", F.element_at(F.split("path", "/"), 3).alias("surface"))
    return j.agg(F.count_if(F.col("scope") == "direct").alias("n_direct"), F.count_if(F.col("scope") == "indirect").alias("n_indirect"), F.count("*").alias("n"))


def _tree_edges(spark, d):
    n, r = C.table(spark, d, "nation"), C.table(spark, d, "region")
    a = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("from_id"), F.col("n_name").alias("to_id"))
    b = C.files(spark, d).where("classification = 'service'").select(F.col("repo").alias("from_id"), F.col("file_id").alias("to_id"))
    back = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).where("n_name < 'NATION_2'").select(F.col("n_name").alias("from_id"), F.col("r_name").alias("to_id"))
    return a.unionByName(b).unionByName(back)


_TREE = f"""{C.FILES}, te AS (SELECT r_name AS a, n_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT repo, file_id FROM files WHERE classification = 'service'
  UNION ALL SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name < 'NATION_2'),
tree AS (SELECT 'ASIA' AS path, 0 AS depth, 'ASIA' AS node UNION ALL SELECT path || '>' || b, depth + 1, b FROM tree JOIN te ON te.a = tree.node WHERE depth < 4 AND NOT list_contains(string_split(path, '>'), b))"""


@query(f"WITH RECURSIVE {_TREE} SELECT path, depth, node FROM tree")
def ui_tree(spark, d):
    """The composition tree below a root; an edge back to an ancestor ends its path."""
    return graph.render_tree(_tree_edges(spark, d), "ASIA", 4)


@query(f"WITH RECURSIVE {_TREE} SELECT depth, count(*) AS total, count_if(starts_with(node, 's')) AS resolved, floor(count_if(starts_with(node, 's')) / count(*) * 1000 + 0.5) / 1000 AS ratio FROM tree GROUP BY depth")
def ui_tree_summary(spark, d):
    g = graph.render_tree(_tree_edges(spark, d), "ASIA", 4).groupBy("depth").agg(F.count("*").alias("total"), F.count_if(F.col("node").startswith("s")).alias("resolved"))
    return g.select("depth", "total", "resolved", text.round3(F.col("resolved") / F.col("total")).alias("ratio"))


@query(f"WITH {C.SYMBOLS}, {C.FILES}, k AS (SELECT repo, name, count(*) AS n FROM symbols JOIN files USING (file_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, name) AS rank FROM k) SELECT repo, name, n, rank FROM r WHERE rank <= 5")
def ui_common_props(spark, d):
    """The five most frequent names of each repository."""
    k = C.symbols(spark, d).join(C.files(spark, d).select("file_id", "repo"), "file_id").groupBy("repo", "name").agg(F.count("*").alias("n"))
    return tables.top_k_per_group(k, ["repo"], [F.desc("n"), F.col("name")], 5).select("repo", "name", "n", "rank")


@query(
    """WITH e AS (SELECT user_id, event_id, ts, CASE event_type WHEN 'purchase' THEN 'strong' WHEN 'signup' THEN 'medium' WHEN 'error' THEN 'medium' ELSE 'weak' END AS cls, event_type || ':' || CAST(floor(value) AS BIGINT) AS item FROM events),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, cls ORDER BY ts, event_id) AS k FROM e), a AS (SELECT * FROM c WHERE k <= CASE cls WHEN 'strong' THEN 12 WHEN 'medium' THEN 8 ELSE 4 END),
p AS (SELECT *, row_number() OVER w AS position, CASE WHEN cls = 'strong' AND row_number() OVER (PARTITION BY user_id, cls, item ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS nw FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(nw) OVER w AS strong, sum(CASE WHEN cls = 'medium' THEN 1 ELSE 0 END) OVER w AS medium FROM p WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
t AS (SELECT *, min(CASE WHEN strong >= 4 AND medium >= 2 THEN position END) OVER (PARTITION BY user_id) AS stop FROM s)
SELECT user_id, event_id, cls, position FROM t WHERE stop IS NULL OR position <= stop"""
)
def early_stop_scan(spark, d):
    """Each user's events in order, capped by class, up to the point at which enough is known."""
    e = C.table(spark, d, "events")
    cls = F.when(F.col("event_type") == "purchase", "strong").when(F.col("event_type").isin("signup", "error"), "medium").otherwise("weak")
    e = e.select("user_id", "event_id", "ts", cls.alias("cls"), F.concat("event_type", F.lit(":"), F.floor("value").cast("long").cast("string")).alias("item"))
    out = tables.early_stop(e, ["user_id"], [F.col("ts"), F.col("event_id")], "cls", "item", {"strong": 12, "medium": 8, "weak": 4}, "strong", "medium", 4, 2)
    return out.select("user_id", "event_id", "cls", "position")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS k FROM lineitem)
SELECT l_suppkey, l_partkey, l_orderkey, l_linenumber, l_extendedprice FROM r WHERE k = 1"""
)
def dedupe_keep_best(spark, d):
    li = C.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    # A total order also where orders repeat a line; max over a struct keeps the aggregate partial.
    best = li.groupBy("l_suppkey", "l_partkey").agg(F.max(F.struct("l_extendedprice", (-F.col("l_orderkey")).alias("o"), (-F.col("l_linenumber")).alias("n"))).alias("m"))
    return best.select("l_suppkey", "l_partkey", (-F.col("m.o")).alias("l_orderkey"), (-F.col("m.n")).alias("l_linenumber"), "m.l_extendedprice")


@query(
    """WITH e AS (SELECT 's' || l_suppkey AS file_id, CASE l_returnflag WHEN 'R' THEN 'high' WHEN 'A' THEN 'medium' ELSE 'low' END AS confidence, l_linestatus || ':' || l_returnflag AS reason FROM lineitem)
SELECT file_id, count(*) AS n_evidence, max_by(confidence, CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END) AS confidence, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM e GROUP BY file_id"""
)
def evidence_merge(spark, d):
    conf = F.when(F.col("l_returnflag") == "R", "high").when(F.col("l_returnflag") == "A", "medium").otherwise("low")
    e = C.table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("file_id"), conf.alias("confidence"), F.concat("l_linestatus", F.lit(":"), "l_returnflag").alias("reason"))
    return tables.merge_evidence(e, "file_id", "reason", "confidence", {"high": 3, "medium": 2, "low": 1})


@query(
    f"""WITH {C.FILES}, {C.EDGES}, imp AS (SELECT DISTINCT to_id, from_id FROM edges WHERE type = 'file_imports_file'), u AS (
  SELECT s.file_id, count(i.from_id) AS n_importers, count(DISTINCT regexp_replace(f.path, '/[^/]*$', '')) AS n_dirs, count(DISTINCT f.repo) AS n_areas, count_if(f.repo = s.repo) AS n_own
  FROM files s LEFT JOIN imp i ON i.to_id = s.file_id LEFT JOIN files f ON f.file_id = i.from_id WHERE s.classification = 'service' GROUP BY s.file_id)
SELECT file_id, n_importers, n_dirs, n_areas, CASE WHEN n_importers = 0 THEN 'none' WHEN n_dirs = 1 AND n_own = n_importers THEN 'local-only' WHEN n_areas <= 1 AND n_own = n_importers THEN 'feature-local'
  WHEN n_areas >= 4 OR n_importers >= 6 THEN 'repo-wide' ELSE 'cross-feature' END AS usage FROM u"""
)
def ownership_usage(spark, d):
    """How widely each service file is used."""
    f = C.files(spark, d).withColumn("dir", paths.dir_name(F.col("path")))
    imp = C.imports(spark, d).select(F.col("to_id").alias("file_id"), "from_id").join(f.select(F.col("file_id").alias("from_id"), F.col("repo").alias("area"), "dir"), "from_id")
    s = f.where("classification = 'service'").select("file_id", "repo").join(imp, "file_id", "left")
    u = s.groupBy("file_id").agg(F.count("from_id").alias("n_importers"), F.countDistinct("dir").alias("n_dirs"), F.countDistinct("area").alias("n_areas"), F.count_if(F.col("area") == F.col("repo")).alias("n_own"))
    own = F.col("n_own") == F.col("n_importers")
    usage = F.when(F.col("n_importers") == 0, "none").when((F.col("n_dirs") == 1) & own, "local-only").when((F.col("n_areas") <= 1) & own, "feature-local")
    return u.select("file_id", "n_importers", "n_dirs", "n_areas", usage.when((F.col("n_areas") >= 4) | (F.col("n_importers") >= 6), "repo-wide").otherwise("cross-feature").alias("usage"))


@query(
    f"""WITH {_DIRECT}, a AS (SELECT file_id, 2 AS bucket FROM hop WHERE rank <= 200 UNION ALL SELECT id, 1 FROM direct), o AS (SELECT bucket, path, file_id, row_number() OVER (ORDER BY bucket, path, file_id) AS step FROM a JOIN files USING (file_id))
SELECT step, file_id, CASE bucket WHEN 1 THEN 'edit' ELSE 'review' END AS role FROM o WHERE step <= 48"""
)
def ordered_plan(spark, d):
    """The first 48 steps of a change plan."""
    a = two_hop_impact(spark, d).select("file_id", F.lit(2).alias("bucket")).unionByName(_direct(spark, d).select(F.col("id").alias("file_id"), F.lit(1).alias("bucket")))
    top = a.join(C.files(spark, d), "file_id").orderBy("bucket", "path", "file_id").limit(48)
    step = F.row_number().over(Window.orderBy("bucket", "path", "file_id")).cast("long")
    return top.select(step.alias("step"), "file_id", F.when(F.col("bucket") == 1, "edit").otherwise("review").alias("role"))
