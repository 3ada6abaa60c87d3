"""The engine's tools over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import corpus as C
from . import pattern_queries
from .engine import Corpus, Engine
from .registry import query


def engine(spark, d) -> Engine:
    """An engine whose files are suppliers, customers and documents; only the latter have lines."""
    t = C.table(spark, d, "documents")
    own = t.select(F.concat(F.lit("d"), "doc_id").alias("file_id"), F.col("source").alias("repo"), F.concat_ws("/", F.lit("texts"), "lang", F.col("doc_id").cast("string")).alias("path"), F.lit("text").alias("classification"))
    lines = C.lines(spark, d).select(F.concat(F.lit("d"), "doc_id").alias("file_id"), "line_no", "line")
    return Engine(Corpus(C.files(spark, d).unionByName(own), C.symbols(spark, d), C.edges(spark, d), lines, pattern_queries._top(spark, d, 6).select(F.col("pattern_id").alias("file_id"), "other", "score")))


_TEXTS = f"{C.LINES}, tx AS (SELECT repo, 'texts/' || dir || '/' || doc_id AS path, line_no, line FROM lines)"


@query(rf"WITH {_TEXTS} SELECT repo, path, line_no, line FROM tx WHERE regexp_matches(line, 'moron') AND regexp_matches(line, 'stupid') AND starts_with(path, 'texts/en')")
def tool_search_code(spark, d):
    return engine(spark, d).search_code("moron stupid", path_prefix="texts/en")


@query(
    rf"""WITH {_TEXTS} SELECT repo, path, line_no, line, CASE WHEN regexp_matches(line, '^\s*import\b') THEN 4 WHEN regexp_matches(line, '\bnew\s+scum\s*\(') THEN 3 WHEN regexp_matches(line, '\.scum\b') THEN 2 WHEN regexp_matches(line, '\bscum\s*\(') THEN 2 ELSE 1 END AS score
FROM tx WHERE regexp_matches(line, '\bscum\b') AND NOT regexp_matches(trim(line), '^(//|/\*|\*)')"""
)
def tool_find_references(spark, d):
    return engine(spark, d).find_references("scum")


@query(f"WITH {C.SYMBOLS} SELECT symbol_id, file_id, name, kind, exported, start_line, end_line FROM symbols WHERE file_id = 's7'")
def tool_list_symbols(spark, d):
    return engine(spark, d).list_symbols("s7")


@query(f"WITH {C.LINES} SELECT line_no, lpad(CAST(line_no AS VARCHAR), 6, ' ') || ' | ' || line AS shown FROM lines WHERE doc_id = 3 AND line_no BETWEEN 1 AND 5")
def tool_open_file(spark, d):
    return engine(spark, d).open_file("d3", 1, 5)


@query(f"WITH {C.FILES}, {C.SYMBOLS} SELECT symbol_id, file_id, kind, exported, path FROM symbols JOIN files USING (file_id) WHERE name = 'red widget' AND kind = 'PROMO' AND repo = 'NATION_5'")
def tool_find_symbol(spark, d):
    return engine(spark, d).find_symbol("red widget", "PROMO", "NATION_5").select("symbol_id", "file_id", "kind", "exported", "path")


def _items(response, fields: str):
    """The items of a tool's JSON answer as rows (rank, fields, total, truncated)."""
    body = F.from_json("response", f"items array<struct<{fields}>>, total long, truncated boolean")
    r = response.select(body.alias("b")).select("b.total", "b.truncated", F.posexplode("b.items").alias("_p", "i"))
    return r.select((F.col("_p") + 1).alias("rank"), "i.*", "total", "truncated")


_RELATED = f"""{C.FILES}, {C.SYMBOLS}, {C.EDGES}, inc AS (SELECT to_id AS nb, type, 'outgoing' AS dir FROM edges WHERE from_id = 's7' UNION SELECT from_id, type, 'incoming' FROM edges WHERE to_id = 's7'),
one AS (SELECT nb, type, max(dir) AS dir FROM inc GROUP BY nb, type),
ev AS (SELECT nb AS file_id, max(CASE WHEN dir = 'incoming' THEN 2 ELSE 1 END) AS strength, max(CASE WHEN dir = 'incoming' AND type = 'file_imports_file' THEN 12 WHEN dir = 'incoming' THEN 10 ELSE 4 END) AS w, count(*) AS n FROM one GROUP BY nb),
nm AS (SELECT DISTINCT file_id, name FROM symbols), sh AS (SELECT file_id, count(*) AS k FROM nm WHERE name IN (SELECT name FROM nm WHERE file_id = 's7') GROUP BY file_id),
me AS (SELECT repo AS r0, string_split(path, '/') AS p0 FROM files WHERE file_id = 's7'),
rel AS (SELECT f.file_id, f.repo, f.path, strength, w + n + CASE WHEN strength = 2 THEN 2 ELSE -1 END + 3 * coalesce(k, 0) + CASE WHEN repo = r0 THEN 2 ELSE 0 END
    + CASE WHEN string_split(path, '/')[1] <> p0[1] THEN 0 WHEN string_split(path, '/')[2] <> p0[2] THEN 1 WHEN string_split(path, '/')[3] <> p0[3] THEN 2 ELSE 3 END AS score
  FROM ev JOIN files f ON f.file_id = ev.file_id LEFT JOIN sh ON sh.file_id = f.file_id CROSS JOIN me),
related AS (SELECT * FROM rel WHERE score > 0)"""


@query(f"WITH {_RELATED} SELECT file_id, repo, path, strength, score FROM related")
def tool_find_related_files(spark, d):
    return engine(spark, d).find_related_files("s7")


_RANKED = f"""{C.FILES}, {C.SYMBOLS}, {C.EDGES}, fan AS (SELECT to_id AS file_id, count(*) AS fan_in FROM edges WHERE type = 'file_imports_file' GROUP BY to_id),
ranked AS (SELECT s.symbol_id, s.file_id, f.repo, f.path, s.start_line, 'canonical' AS tier, 10 + CASE WHEN exported THEN 3 ELSE 0 END + 3 + CASE WHEN fan_in > 1 THEN 1 ELSE 0 END + CASE WHEN end_line - start_line + 1 >= 8 THEN 1 ELSE 0 END
    - CASE WHEN count(*) OVER () > 1 THEN least(count(*) OVER () - 1, 5) ELSE 0 END AS score FROM symbols s JOIN files f USING (file_id) LEFT JOIN fan USING (file_id) WHERE s.name = 'red widget'),
top AS (SELECT *, row_number() OVER (ORDER BY score DESC, repo, path, start_line, symbol_id) AS rank, count(*) OVER () AS total FROM ranked)"""


@query(f"WITH {_RANKED} SELECT rank, symbol_id, tier, score, CASE WHEN score >= 14 THEN 'high' WHEN score >= 8 THEN 'medium' ELSE 'low' END AS match, total, total > 10 AS truncated FROM top WHERE rank <= 10")
def tool_explore_component(spark, d):
    return _items(engine(spark, d).explore_component("red widget"), "symbol_id string, tier string, score long, match string")


@query(
    f"""WITH {_RANKED}, deg AS (SELECT to_id AS file_id, count(*) AS n_edges, count(DISTINCT from_id) AS n_sources FROM edges GROUP BY to_id)
SELECT rank, symbol_id, score, n_edges, n_sources, 'module' AS area, total, total > 20 AS truncated FROM top LEFT JOIN deg USING (file_id) WHERE rank <= 20"""
)
def tool_analyze_symbol(spark, d):
    return _items(engine(spark, d).analyze_symbol("red widget"), "symbol_id string, score long, n_edges long, n_sources long, area string")


_SIMILAR = f"{pattern_queries.FP}, {pattern_queries._TOP}, own AS (SELECT other, score, CASE WHEN score >= 0.8 THEN 'high' WHEN score >= 0.55 THEN 'medium' ELSE 'low' END AS strength FROM top WHERE rank <= 6 AND pattern_id = 's7')"


@query(f"WITH {_SIMILAR} SELECT other, score, strength FROM own")
def tool_search_patterns(spark, d):
    return engine(spark, d).search_patterns("s7")


_PREC = f"{_SIMILAR}, {C.FILES}, prec AS (SELECT other, repo, path, floor(least(greatest(CAST(0.82 AS DOUBLE) * score + CASE WHEN repo <> (SELECT repo FROM files WHERE file_id = 's7') THEN CAST(0.04 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END, 0), 1) * 1000 + CAST(0.5 AS DOUBLE)) / 1000 AS precedent_score, strength FROM own JOIN files ON file_id = other)"


@query(f"WITH {_PREC} SELECT other, repo, path, precedent_score, strength FROM prec")
def tool_find_precedents(spark, d):
    return engine(spark, d).find_precedents("s7")


@query(
    f"""WITH {_RELATED}, r AS (SELECT *, row_number() OVER (ORDER BY strength DESC, score DESC, repo, path) AS rank, count(*) OVER () AS total FROM related)
SELECT rank, file_id, strength, score, CASE WHEN score >= 22 THEN 'high' WHEN score >= 12 THEN 'medium' ELSE 'low' END AS match, total, total > 20 AS truncated FROM r WHERE rank <= 20"""
)
def tool_collect_refactor_context(spark, d):
    return _items(engine(spark, d).collect_refactor_context("s7"), "file_id string, strength int, score long, match string")


_PLAN = f"""{C.FILES}, {C.EDGES}, inc AS (SELECT to_id AS nb, type, 'outgoing' AS dir FROM edges WHERE from_id = 's7' UNION SELECT from_id, type, 'incoming' FROM edges WHERE to_id = 's7'),
direct AS (SELECT DISTINCT f.file_id AS id, f.path FROM (SELECT nb, type, max(dir) AS dir FROM inc GROUP BY nb, type) x JOIN files f ON f.file_id = x.nb WHERE dir = 'incoming'),
nseed AS (SELECT count(*) AS n FROM direct), seeds AS (SELECT * FROM (SELECT id, path, row_number() OVER (ORDER BY path, id) AS sr FROM direct) WHERE sr <= 40),
imp AS (SELECT sr, o.file_id, o.path, row_number() OVER (PARTITION BY sr ORDER BY len(string_split(o.path, '/')), o.repo, o.path, o.file_id) AS r, count(*) OVER (PARTITION BY sr) AS cnt
  FROM seeds s JOIN (SELECT DISTINCT from_id, to_id FROM edges) e ON e.to_id = s.id JOIN files o ON o.file_id = e.from_id),
stop AS (SELECT CASE WHEN (SELECT n FROM nseed) > 40 THEN 1 ELSE coalesce((SELECT min(sr) FROM imp WHERE cnt > 16), 1000000) END AS s),
best AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY sr, r) AS k FROM imp, stop WHERE r <= 16 AND sr <= s AND file_id NOT IN (SELECT id FROM seeds)),
hop AS (SELECT file_id, path, row_number() OVER (ORDER BY sr, r) AS o FROM best WHERE k = 1),
every AS (SELECT id AS file_id, path, 1 AS depth, 'edit' AS role FROM direct UNION ALL SELECT file_id, path, 2, 'review' FROM hop WHERE o <= 200 AND file_id <> 's7'),
plan AS (SELECT *, row_number() OVER (ORDER BY depth, path, file_id) AS rank, count(*) OVER () AS total FROM every)"""


@query(f"WITH {_PLAN} SELECT rank, file_id, depth, role, total, total > 48 AS truncated FROM plan WHERE rank <= 48")
def tool_plan_change(spark, d):
    return _items(engine(spark, d).plan_change("s7"), "file_id string, depth int, role string")


@query(
    f"""WITH {_PLAN}, {_RELATED.replace(C.FILES + ', ', '').replace(C.EDGES + ', ', '').replace('inc AS (', 'inc2 AS (').replace('FROM inc GROUP', 'FROM inc2 GROUP')}, {_PREC.replace(C.FILES + ', ', '')}
SELECT 'collect_refactor_context' AS tool, count(*) AS total, least(count(*), 10) AS shown FROM related UNION ALL SELECT 'plan_change', count(*), least(count(*), 10) FROM every UNION ALL SELECT 'find_precedents', count(*), least(count(*), 10) FROM prec"""
)
def tool_build_change_context(spark, d):
    body = F.from_json("response", "sections array<struct<tool:string,items:array<struct<path:string>>,total:long>>")
    x = engine(spark, d).build_change_context("s7").select(F.explode(body["sections"]).alias("s"))
    return x.select("s.tool", "s.total", F.size("s.items").alias("shown"))
