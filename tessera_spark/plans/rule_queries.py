"""Rule ladders over ordinary rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sets, text
from . import corpus as C
from .registry import query


@query(
    r"""WITH t AS (SELECT p_partkey, p_name, regexp_split_to_array(lower(p_name), '[^a-z0-9]+') AS ts FROM part)
SELECT p_partkey, p_name, array_to_string(ts, '|') AS tokens, CAST(len(ts) AS INT) AS n_tokens, CAST(ceil(length(p_name) / 4.0) AS BIGINT) AS estimate FROM t"""
)
def name_tokens(spark, d):
    p = C.table(spark, d, "part")
    t = text.name_tokens(F.col("p_name"))
    return p.select("p_partkey", "p_name", F.array_join(t, "|").alias("tokens"), F.size(t).alias("n_tokens"), text.estimated_tokens(F.col("p_name")).cast("long").alias("estimate"))


@query(
    """WITH o AS (SELECT o_custkey, count(*) AS breadth, count_if(o_orderstatus = 'F') AS direct, count(DISTINCT o_orderpriority) AS areas FROM orders GROUP BY o_custkey)
SELECT o_custkey, breadth, direct, areas, CASE WHEN breadth >= 8 OR direct >= 5 THEN 'high-fanout' WHEN areas >= 4 THEN 'cross-feature' WHEN areas >= 2 THEN 'feature' ELSE 'local' END AS scope,
  CASE WHEN (breadth >= 8 OR direct >= 5) AND areas >= 4 THEN 'high' WHEN breadth >= 8 OR direct >= 5 OR areas >= 3 THEN 'medium' ELSE 'low' END AS risk FROM o"""
)
def change_scope_risk(spark, d):
    """Scope and risk of a change by its breadth."""
    o = C.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("breadth"), F.count_if(F.col("o_orderstatus") == "F").alias("direct"), F.countDistinct("o_orderpriority").alias("areas"))
    wide = (F.col("breadth") >= 8) | (F.col("direct") >= 5)
    scope = F.when(wide, "high-fanout").when(F.col("areas") >= 4, "cross-feature").when(F.col("areas") >= 2, "feature").otherwise("local")
    risk = F.when(wide & (F.col("areas") >= 4), "high").when(wide | (F.col("areas") >= 3), "medium").otherwise("low")
    return o.select("o_custkey", "breadth", "direct", "areas", scope.alias("scope"), risk.alias("risk"))


@query(
    """WITH b AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'unknown' WHEN c_mktsegment = 'BUILDING' THEN 'page' WHEN c_mktsegment = 'MACHINERY' THEN 'service' WHEN c_mktsegment IN ('AUTOMOBILE', 'FURNITURE') AND c_acctbal > 5000 THEN 'component' WHEN c_acctbal > 8000 THEN 'library' ELSE 'module' END AS area, c_acctbal FROM customer)
SELECT area, count(*) AS n, floor(sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) / count(*) * 1000 + 0.5) / 1000 AS rich_ratio FROM b GROUP BY area"""
)
def area_ladder(spark, d):
    """Files by area, the first rule that holds."""
    bal, seg = F.col("c_acctbal"), F.col("c_mktsegment")
    area = F.when(bal < 0, "unknown").when(seg == "BUILDING", "page").when(seg == "MACHINERY", "service").when(seg.isin("AUTOMOBILE", "FURNITURE") & (bal > 5000), "component").when(bal > 8000, "library").otherwise("module")
    g = C.table(spark, d, "customer").select(area.alias("area"), bal).groupBy("area").agg(F.count("*").alias("n"), F.count_if(bal > 5000).alias("r"))
    return g.select("area", "n", text.round3(F.col("r") / F.col("n")).alias("rich_ratio"))


@query(
    """WITH c AS (SELECT conv_id, turn, role, text, coalesce(text, '') AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN length(t) = 0 THEN 'none' WHEN length(t) >= 400 THEN 'high' WHEN length(t) >= 150 THEN 'medium' ELSE 'low' END AS bucket, row_number() OVER (PARTITION BY conv_id ORDER BY length(t) DESC, turn) AS rank FROM c"""
)
def result_tiers(spark, d):
    """Rows of each group in order of score, with the score's bucket."""
    from pyspark.sql import Window

    n = F.length(F.coalesce("text", F.lit("")))
    bucket = F.when(n == 0, "none").when(n >= 400, "high").when(n >= 150, "medium").otherwise("low")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy(n.desc(), "turn"))
    return C.table(spark, d, "conversations").select("conv_id", "turn", bucket.alias("bucket"), rank.cast("long").alias("rank"))


@query(
    """WITH s AS (SELECT l_suppkey, list_sort(list(DISTINCT l_shipdate_y)) AS ys, list_sort(list(DISTINCT f)) AS fs FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS VARCHAR) AS l_shipdate_y, CAST(1994 + 2 * CAST(l_quantity AS INT) % 8 AS VARCHAR) AS f FROM lineitem) GROUP BY l_suppkey)
SELECT l_suppkey, CAST(len(list_intersect(ys, fs)) AS INT) AS n_shared, floor(CAST(len(list_intersect(ys, fs)) AS DOUBLE) / len(list_distinct(list_concat(ys, fs))) * 1000 + 0.5) / 1000 AS overlap FROM s"""
)
def set_overlap(spark, d):
    """Two sets of each supplier, and how far they overlap."""
    year = F.year("l_shipdate").cast("string")
    other = (1994 + 2 * F.col("l_quantity").cast("int") % 8).cast("string")
    s = C.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.collect_set(year).alias("ys"), F.collect_set(other).alias("fs"))
    return s.select("l_suppkey", F.size(F.array_intersect("ys", "fs")).alias("n_shared"), text.round3(sets.jaccard(F.col("ys"), F.col("fs"))).alias("overlap"))
