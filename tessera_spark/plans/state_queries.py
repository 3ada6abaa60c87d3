"""Change classification, freshness, integrity and routes over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators import tables
from . import corpus as C
from .registry import query




@query(
    r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/+$', '') AS route FROM pages"""
)
def route_ids(spark, d):
    """Host and canonical route of each page."""
    p = C.table(spark, d, "pages")
    return p.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.regexp_replace(F.regexp_extract("url", "^[a-z]+://[^/?#]+([^?#]*)", 1), "/+$", "").alias("route"))


@query(
    f"""WITH {C.FILES} SELECT file_id, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS base, regexp_extract(path, '([^/.#]*)[^/]*$', 1) AS stem, len(string_split(path, '/')) AS segments FROM files"""
)
def path_parts(spark, d):
    p = F.col("path")
    return C.files(spark, d).select("file_id", paths.dir_name(p).alias("dir"), paths.base_name(p).alias("base"), paths.stem(p).alias("stem"), F.size(F.split(p, "/")).cast("long").alias("segments"))


@query(
    f"""WITH {C.FILES}, k AS (SELECT repo, string_split(path, '/')[3] AS surface, count(*) AS n FROM files GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY n DESC, surface) AS k FROM k)
SELECT repo, surface AS family, n FROM r WHERE k = 1"""
)
def dominant_family(spark, d):
    """The most frequent surface of each repository; ties go to the first by name."""
    k = C.files(spark, d).groupBy("repo", F.element_at(F.split("path", "/"), 3).alias("family")).agg(F.count("*").alias("n"))
    return tables.keep_best(k, ["repo"], [F.desc("n"), F.col("family")])


@query(
    f"""WITH {C.SYMBOLS}, tok AS (SELECT DISTINCT file_id, unnest(string_split(name, ' ')) AS token FROM symbols), df AS (SELECT token, count(*) AS df FROM tok GROUP BY token), r AS (SELECT file_id, token, df, row_number() OVER (PARTITION BY file_id ORDER BY df, token) AS k FROM tok JOIN df USING (token))
SELECT file_id, token, df FROM r WHERE k = 1"""
)
def rarest_token(spark, d):
    """The rarest name token of each file."""
    tok = C.symbols(spark, d).select("file_id", F.explode(F.split("name", " ")).alias("token")).distinct()
    df = tok.groupBy("token").agg(F.count("*").alias("df"))
    return tables.keep_best(tok.join(df, "token"), ["file_id"], [F.col("df"), F.col("token")]).select("file_id", "token", "df")


@query(
    f"""WITH {C.SYMBOLS}, p AS (SELECT file_id, symbol_id, start_line, lead(symbol_id) OVER w AS nxt, lead(start_line) OVER w - start_line AS gap FROM symbols WINDOW w AS (PARTITION BY file_id ORDER BY start_line, symbol_id))
SELECT symbol_id, nxt AS next_symbol, gap FROM p WHERE nxt IS NOT NULL"""
)
def nearest_siblings(spark, d):
    """Each symbol's next one in its file and how far it is."""
    from pyspark.sql import Window

    w = Window.partitionBy("file_id").orderBy("start_line", "symbol_id")
    s = C.symbols(spark, d).select("symbol_id", F.lead("symbol_id").over(w).alias("next_symbol"), (F.lead("start_line").over(w) - F.col("start_line")).alias("gap"))
    return s.where("next_symbol is not null")
