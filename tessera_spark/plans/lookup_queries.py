"""Lookups, joins and text search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import tables
from . import corpus as C
from .registry import query


@query(
    f"""WITH {C.FILES}, {C.SYMBOLS}, s AS (SELECT symbols.*, repo FROM symbols JOIN files USING (file_id))
SELECT 'name' AS level, CAST(NULL AS VARCHAR) AS outer_key, name, count(*) AS n FROM s GROUP BY name
UNION ALL SELECT 'name_lower', NULL, lower(name), count(*) FROM s GROUP BY lower(name)
UNION ALL SELECT 'repo_name', repo, name, count(*) FROM s GROUP BY repo, name
UNION ALL SELECT 'kind_name', kind, name, count(*) FROM s GROUP BY kind, name
UNION ALL SELECT 'exported_name', NULL, name, count(*) FROM s WHERE exported GROUP BY name"""
)
def symbol_frequency(spark, d):
    s = C.symbols(spark, d).join(C.files(spark, d).select("file_id", "repo"), "file_id")
    return tables.frequencies(s, "name", "repo", "kind", "exported")


@query(
    f"""WITH {C.FILES}, {C.SYMBOLS}, {C.IMPORTS}, fan AS (SELECT to_id AS file_id, count(*) AS fan_in FROM imports GROUP BY to_id),
freq AS (SELECT name, count(*) AS n FROM symbols GROUP BY name),
c AS (
  SELECT symbol_id, repo, path, start_line, end_line, kind, 10 + 3 * CAST(exported AS INT) + CASE WHEN repo = 'NATION_5' THEN 4 ELSE 0 END + CASE WHEN kind = 'PROMO' THEN 5 ELSE 0 END
    + CASE WHEN coalesce(fan_in, 0) > 1 THEN 1 ELSE 0 END + CASE WHEN end_line - start_line + 1 >= 8 THEN 1 ELSE 0 END - CASE WHEN n > 1 THEN least(n - 1, 5) ELSE 0 END AS score
  FROM symbols JOIN files USING (file_id) JOIN freq USING (name) LEFT JOIN fan USING (file_id) WHERE name = 'red widget'),
r AS (SELECT row_number() OVER (ORDER BY score DESC, repo, path, start_line, end_line, kind, symbol_id) AS rank, symbol_id, score, max(score) OVER () AS top FROM c)
SELECT rank, symbol_id, CAST(score AS BIGINT) AS score, top - score <= 2 AND rank > 1 AS rivals_top FROM r WHERE rank <= 20"""
)
def find_symbol_ranked(spark, d):
    """The 20 best candidates for a name, kind and repository."""
    s = C.symbols(spark, d)
    freq = s.groupBy("name").agg(F.count("*").alias("n")).where("name = 'red widget'")
    fan = C.imports(spark, d).groupBy(F.col("to_id").alias("file_id")).agg(F.count("*").alias("fan_in"))
    c = s.where("name = 'red widget'").join(C.files(spark, d), "file_id").join(freq, "name").join(fan, "file_id", "left")
    yes = lambda cond, points: F.when(cond, points).otherwise(0)
    score = (
        10 + yes(F.col("exported"), 3) + yes(F.col("repo") == "NATION_5", 4) + yes(F.col("kind") == "PROMO", 5) + yes(F.coalesce("fan_in", F.lit(0)) > 1, 1)
        + yes(F.col("end_line") - F.col("start_line") + 1 >= 8, 1) - yes(F.col("n") > 1, F.least(F.col("n") - 1, F.lit(5)))
    )
    c = c.withColumn("score", score.cast("long"))
    order = [F.desc("score"), "repo", "path", "start_line", "end_line", "kind", "symbol_id"]
    top = c.orderBy(*order).limit(20).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    best = F.max("score").over(Window.partitionBy())
    return top.withColumn("_top", best).select("rank", "symbol_id", "score", ((F.col("_top") - F.col("score") <= 2) & (F.col("rank") > 1)).alias("rivals_top"))


@query(
    f"""WITH {C.FILES}, {C.SYMBOLS}
SELECT symbol_id, file_id || ':' || kind || ':' || name || ':' || row_number() OVER (PARTITION BY file_id, kind, name ORDER BY start_line) AS stable_id FROM symbols"""
)
def symbol_ordinals(spark, d):
    o = tables.ordinals(C.symbols(spark, d), ["file_id", "kind", "name"], [F.col("start_line")])
    return o.select("symbol_id", F.concat_ws(":", "file_id", "kind", "name", "ordinal").alias("stable_id"))


@query(
    f"""WITH {C.FILES}, {C.SYMBOLS}, {C.IMPORTS}, own AS (SELECT DISTINCT f.repo, s.name, s.file_id FROM symbols s JOIN files f USING (file_id) WHERE exported),
want AS (SELECT DISTINCT i.from_id, f.repo, s.name FROM imports i JOIN files f ON f.file_id = i.from_id JOIN (SELECT DISTINCT file_id, kind AS name FROM symbols) k ON k.file_id = i.to_id JOIN part p ON p.p_type = k.name AND p.p_size = 7 JOIN (SELECT DISTINCT name FROM symbols) s ON s.name = p.p_name),
g AS (SELECT from_id, want.name, count(DISTINCT own.file_id) AS n_targets, min(own.file_id) AS t FROM want LEFT JOIN own ON own.repo = want.repo AND own.name = want.name GROUP BY from_id, want.name)
SELECT from_id, name, CASE WHEN n_targets = 1 THEN 'resolved' WHEN n_targets > 1 THEN 'ambiguous' ELSE 'unresolved' END AS status, CASE WHEN n_targets = 1 THEN t END AS target, n_targets FROM g"""
)
def import_resolution_unique(spark, d):
    """Names imported through a kind, resolved inside the importer's repository if one file exports them."""
    f, s = C.files(spark, d).select("file_id", "repo"), C.symbols(spark, d)
    own = s.where("exported").join(f, "file_id").select("repo", "name", "file_id")
    sold = C.table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(C.table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    kinds = sold.select(F.concat(F.lit("s"), "l_suppkey").alias("to_id"), F.col("p_type").alias("kind")).distinct()
    sold_names = C.table(spark, d, "part").join(C.table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select(F.col("p_name").alias("name")).distinct()
    named = C.table(spark, d, "part").where("p_size = 7").select(F.col("p_type").alias("kind"), F.col("p_name").alias("name")).distinct().join(sold_names, "name")
    want = C.imports(spark, d).join(f.select(F.col("file_id").alias("from_id"), "repo"), "from_id").join(kinds, "to_id").select("from_id", "repo", "kind").distinct().join(named, "kind")
    return tables.resolve_unique(want.select("from_id", "repo", "name"), own.withColumnRenamed("file_id", "target_file"), ["repo", "name"], ["from_id", "name"], "target_file")


@query(
    f"""WITH {C.FILES}, conf AS (
  SELECT r_name AS dir, 'region:' || r_name AS config FROM region
  UNION ALL SELECT r_name || '/' || n_name, 'nation:' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name < 'NATION_2'
  UNION ALL SELECT DISTINCT r_name || '/' || n_name || '/BUILDING', 'segment:' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey),
hit AS (SELECT file_id, config, len(string_split(dir, '/')) AS depth, row_number() OVER (PARTITION BY file_id ORDER BY length(dir) DESC) AS k FROM files JOIN conf ON starts_with(path, dir || '/'))
SELECT file_id, config, depth FROM hit WHERE k = 1"""
)
def nearest_prefix_config(spark, d):
    """The config of the nearest directory above each file."""
    n = C.table(spark, d, "nation").join(F.broadcast(C.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    conf = C.table(spark, d, "region").select(F.col("r_name").alias("dir"), F.concat(F.lit("region:"), "r_name").alias("config"))
    conf = conf.unionByName(n.where("n_name < 'NATION_2'").select(F.concat_ws("/", "r_name", "n_name").alias("dir"), F.concat(F.lit("nation:"), "n_name").alias("config")))
    conf = conf.unionByName(n.select(F.concat_ws("/", "r_name", "n_name", F.lit("BUILDING")).alias("dir"), F.concat(F.lit("segment:"), "n_name").alias("config")))
    return tables.nearest_ancestor(C.files(spark, d), conf, "file_id", "path", "dir", "config")


@query(
    f"""WITH {C.SYMBOLS}, pts AS (SELECT DISTINCT 's' || l_suppkey AS file_id, l_partkey + l_linenumber AS line FROM lineitem),
hit AS (SELECT p.file_id, p.line, s.symbol_id, s.start_line, row_number() OVER (PARTITION BY p.file_id, p.line ORDER BY s.end_line - s.start_line, s.start_line, s.symbol_id) AS k
  FROM pts p JOIN symbols s ON s.file_id = p.file_id AND p.line BETWEEN s.start_line AND s.end_line)
SELECT file_id, line, symbol_id, start_line FROM hit WHERE k = 1"""
)
def innermost_interval(spark, d):
    """The innermost symbol around each line that an order touches, where there is one."""
    pts = C.table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("file_id"), (F.col("l_partkey") + F.col("l_linenumber")).alias("line")).distinct()
    return tables.innermost_interval(pts, C.symbols(spark, d), "file_id", "line", "start_line", "end_line", "symbol_id").where("symbol_id is not null").select("file_id", "line", "symbol_id", "start_line")


@query(
    f"""WITH {C.SYMBOLS}, {C.IMPORTS}, kinds AS (SELECT DISTINCT file_id, name, kind FROM symbols WHERE exported),
b AS (SELECT DISTINCT 'c' || o_custkey AS from_id, 's' || l_suppkey AS to_id, p_name AS local, p_type AS kind FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_linenumber = 1)
SELECT to_id AS file_id, count(*) AS n_bindings, count_if(kind = 'PROMO' OR EXISTS (SELECT 1 FROM kinds k WHERE k.file_id = b.to_id AND k.name = b.local AND b.kind <> 'SMALL')) AS n_matching FROM b GROUP BY to_id"""
)
def binding_export_match(spark, d):
    """Bindings that hit an exported name: namespaces always do, type-only ones never."""
    o = C.table(spark, d, "orders").select("o_orderkey", "o_custkey")
    b = C.table(spark, d, "lineitem").where("l_linenumber = 1").join(o, F.col("o_orderkey") == F.col("l_orderkey")).join(C.table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    b = b.select(F.concat(F.lit("c"), "o_custkey").alias("from_id"), F.concat(F.lit("s"), "l_suppkey").alias("file_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind")).distinct()
    exports = C.symbols(spark, d).where("exported").select("file_id", "name").distinct().withColumn("_hit", F.lit(True))
    hit = (F.col("kind") == "PROMO") | (F.col("_hit").isNotNull() & (F.col("kind") != "SMALL"))
    return b.join(exports, ["file_id", "name"], "left").groupBy("file_id").agg(F.count("*").alias("n_bindings"), F.count_if(hit).alias("n_matching"))


@query(
    f"""WITH {C.SYMBOLS}, pts AS (SELECT DISTINCT 's' || l_suppkey AS file_id, l_partkey + l_linenumber - 1 AS line FROM lineitem)
SELECT p.file_id, count(*) AS n_references FROM pts p WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.file_id = p.file_id AND s.start_line = p.line) GROUP BY p.file_id"""
)
def definition_anti_join(spark, d):
    """References that are not definitions."""
    pts = C.table(spark, d, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("file_id"), (F.col("l_partkey") + F.col("l_linenumber") - 1).alias("line")).distinct()
    defs = C.symbols(spark, d).select("file_id", F.col("start_line").alias("line"))
    return pts.join(defs, ["file_id", "line"], "left_anti").groupBy("file_id").agg(F.count("*").alias("n_references"))


@query(
    f"""WITH {C.FILES}, better AS (SELECT repo, file_id FROM files JOIN supplier ON file_id = 's' || s_suppkey WHERE s_acctbal > 9000),
base AS (SELECT repo, file_id FROM files WHERE classification = 'page')
SELECT repo, file_id FROM base WHERE repo NOT IN (SELECT repo FROM better) UNION ALL SELECT repo, file_id FROM better"""
)
def per_repo_override(spark, d):
    f = C.files(spark, d)
    rich = C.table(spark, d, "supplier").where("s_acctbal > 9000").select(F.concat(F.lit("s"), "s_suppkey").alias("file_id"))
    return tables.override(f.where("classification = 'page'").select("repo", "file_id"), f.join(rich, "file_id").select("repo", "file_id"), "repo")


@query(
    r"""WITH calls AS (SELECT page_id, regexp_replace(unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)), '[?#].*$', '') AS route FROM pages),
c AS (SELECT DISTINCT page_id, regexp_replace(route, '/+$', '') AS route FROM calls WHERE starts_with(route, '/')),
h AS (SELECT DISTINCT page_id AS handler_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/+$', '') AS full_path FROM pages),
k AS (SELECT handler_id, '/' || string_split(full_path, '/')[-1] AS route FROM h WHERE full_path <> '')
SELECT c.route, count(DISTINCT page_id) AS n_clients, count(DISTINCT handler_id) AS n_handlers FROM c LEFT JOIN k ON k.route = c.route GROUP BY c.route"""
)
def route_propagation(spark, d):
    """Routes that pages call, with the pages that serve them."""
    p = C.table(spark, d, "pages")
    route = F.regexp_replace(F.regexp_replace(F.col("r"), "[?#].*$", ""), "/+$", "")
    calls = p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("r")).where(F.col("r").startswith("/")).select("page_id", route.alias("route")).distinct()
    path = F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1), "/+$", "")
    serve = p.select(F.col("page_id").alias("handler_id"), path.alias("p")).where("p <> ''").select("handler_id", F.concat(F.lit("/"), paths.base_name(F.col("p"))).alias("route")).distinct()
    clients = calls.groupBy("route").agg(F.count("*").alias("n_clients"))  # counted first, so that no pair of clients and handlers is made
    handlers = serve.groupBy("route").agg(F.count("*").alias("n_handlers"))
    return clients.join(handlers, "route", "left").select("route", "n_clients", F.coalesce("n_handlers", F.lit(0)).alias("n_handlers"))


@query(
    f"""WITH {C.FILES}, f AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '([^/#]*)[^/]*$', 1) AS stem FROM files), t AS (SELECT * FROM f WHERE file_id = 'c7')
SELECT f.file_id, CASE WHEN f.stem = t.stem THEN 'bundle' ELSE 'sibling' END AS category FROM f JOIN t ON f.dir = t.dir WHERE f.file_id <> t.file_id"""
)
def nearby_bundle(spark, d):
    f = C.files(spark, d).withColumn("dir", paths.dir_name(F.col("path"))).withColumn("stem", paths.stem(F.col("path")))
    t = f.where("file_id = 'c7'").select("dir", F.col("stem").alias("_s"))
    return f.where("file_id <> 'c7'").join(F.broadcast(t), "dir").select("file_id", F.when(F.col("stem") == F.col("_s"), "bundle").otherwise("sibling").alias("category"))


@query(
    rf"""WITH {C.LINES}, hit AS (SELECT doc_id, line_no, line, row_number() OVER (ORDER BY doc_id, line_no) AS rank, count(*) OVER () AS total FROM lines WHERE regexp_matches(line, '\bthe\b') AND regexp_matches(line, '\bidiot\b'))
SELECT rank, doc_id, line_no, line, total FROM hit WHERE rank <= 50"""
)
def text_search(spark, d):
    """The first 50 lines that have all terms of a query, and how many there are."""
    hit = C.lines(spark, d).where(text.whole_word(F.col("line"), "the") & text.whole_word(F.col("line"), "idiot"))
    total = hit.agg(F.count("*").alias("total"))
    top = hit.orderBy("doc_id", "line_no").limit(50)
    rank = F.row_number().over(Window.orderBy("doc_id", "line_no")).cast("long")
    return top.join(F.broadcast(total), F.lit(True)).select(rank.alias("rank"), "doc_id", "line_no", "line", "total")


@query(
    f"""WITH {C.LINES}
SELECT doc_id, line_no, lpad(CAST(line_no AS VARCHAR), 4, ' ') || ' | ' || line AS shown FROM lines WHERE line_no BETWEEN 2 AND 4"""
)
def open_range(spark, d):
    """Lines 2 to 4 of every document, numbered."""
    t = C.table(spark, d, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 2, 3)).alias("p", "line")).withColumn("line_no", (F.col("p") + 2).cast("long"))
    return t.select("doc_id", "line_no", F.concat(F.lpad(F.col("line_no").cast("string"), 4, " "), F.lit(" | "), "line").alias("shown"))


@query(
    f"""WITH {C.FILES}, {C.SYMBOLS}, w AS (SELECT unnest(['red widget', 'RED Widget', 'no such name']) AS wanted), c AS (SELECT wanted, symbol_id, s.file_id, kind, exported, start_line, name = wanted AS exact
  FROM w JOIN symbols s ON lower(s.name) = lower(wanted) JOIN files f ON f.file_id = s.file_id WHERE repo < 'NATION_3')
SELECT wanted, symbol_id, file_id, kind, exported, start_line, exact FROM c WHERE exact OR NOT EXISTS (SELECT 1 FROM c d WHERE d.wanted = c.wanted AND d.exact)"""
)
def symbol_tiered_lookup(spark, d):
    """Exact matches of each wanted name, or else those in other case."""
    own = C.symbols(spark, d).join(C.files(spark, d).where("repo < 'NATION_3'").select("file_id"), "file_id").withColumn("low", F.lower("name"))
    wanted = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("red widget", "RED Widget", "no such name")])).alias("wanted"))
    both = own.join(F.broadcast(wanted.withColumn("low", F.lower("wanted"))), "low").withColumn("exact", F.col("name") == F.col("wanted"))
    hit = tables.best_tier([both.where("exact"), both.where("not exact")], ["wanted"])
    return hit.select("wanted", "symbol_id", "file_id", "kind", "exported", "start_line", "exact")
