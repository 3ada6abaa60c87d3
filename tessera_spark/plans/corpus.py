"""The driver's star-schema tables seen as a corpus: repositories, files, symbols, edges and text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def files(spark: SparkSession, d: str) -> DataFrame:
    """(file_id, repo, path, classification): a file per supplier and customer; nations are repositories."""
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    one = s.select(F.concat(F.lit("s"), "s_suppkey").alias("file_id"), F.col("n_name").alias("repo"), F.concat_ws("/", "r_name", "n_name", F.lit("suppliers"), "s_name").alias("path"), F.lit("service").alias("classification"))
    two = c.select(F.concat(F.lit("c"), "c_custkey").alias("file_id"), F.col("n_name").alias("repo"), F.concat_ws("/", "r_name", "n_name", "c_mktsegment", "c_name").alias("path"), F.lit("page").alias("classification"))
    return one.unionByName(two)


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """(symbol_id, file_id, name, kind, exported, start_line, end_line): a symbol per part that a supplier ships."""
    sold = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    j = sold.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return j.select(
        F.concat(F.lit("s"), "l_suppkey", F.lit(":"), "l_partkey").alias("symbol_id"), F.concat(F.lit("s"), "l_suppkey").alias("file_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"),
        (F.col("p_retailprice") >= 950).alias("exported"), F.col("p_partkey").alias("start_line"), (F.col("p_partkey") + F.col("p_size")).alias("end_line"),
    )


def imports(spark: SparkSession, d: str) -> DataFrame:
    """(from_id, to_id): customers' files import the suppliers' they buy from."""
    j = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "lineitem").select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(F.concat(F.lit("c"), "o_custkey").alias("from_id"), F.concat(F.lit("s"), "l_suppkey").alias("to_id")).distinct()


def reexports(spark: SparkSession, d: str) -> DataFrame:
    """(from_id, to_id): a supplier re-exports the next one with a returned item of the same part."""
    back = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    nxt = back.withColumn("n", F.lead("l_suppkey").over(Window.partitionBy("l_partkey").orderBy("l_suppkey"))).where("n is not null")
    return nxt.select(F.concat(F.lit("s"), "l_suppkey").alias("from_id"), F.concat(F.lit("s"), "n").alias("to_id")).distinct()


def edges(spark: SparkSession, d: str) -> DataFrame:
    a = imports(spark, d).withColumn("type", F.lit("file_imports_file"))
    return a.unionByName(reexports(spark, d).withColumn("type", F.lit("file_reexports_file")))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, repo, dir, line_no, line) of all documents; lines count from 1."""
    t = table(spark, d, "documents")
    return t.select("doc_id", F.col("source").alias("repo"), F.col("lang").alias("dir"), F.posexplode(F.split("text", "\n")).alias("_p", "line")).select("doc_id", "repo", "dir", (F.col("_p") + 1).cast("long").alias("line_no"), "line")


def hashed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("source").alias("repo"), F.col("lang").alias("dir"), F.col("text"), F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("size"))


def snapshot(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots: in the later one German files are gone, those of src3 have a line more, and French ones have a copy."""
    a = hashed(spark, d)
    b = a.where("dir <> 'de'")
    text = F.when(F.col("repo") == "src3", F.concat("text", F.lit("\n// changed"))).otherwise(F.col("text"))
    b = b.withColumn("text", text).withColumn("sha256", F.sha2("text", 256)).withColumn("size", F.length("text").cast("long"))
    copy = a.where("dir = 'fr'").withColumn("key", F.col("key") + 1_000_000_000_000)
    return a, b.unionByName(copy)


# The same in SQL, as common table expressions.
FILES = """files AS (
  SELECT 's' || s_suppkey AS file_id, n_name AS repo, r_name || '/' || n_name || '/suppliers/' || s_name AS path, 'service' AS classification
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'c' || c_custkey, n_name, r_name || '/' || n_name || '/' || c_mktsegment || '/' || c_name, 'page'
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SYMBOLS = """symbols AS (
  SELECT 's' || l_suppkey || ':' || l_partkey AS symbol_id, 's' || l_suppkey AS file_id, p_name AS name, p_type AS kind, p_retailprice >= 950 AS exported,
    p_partkey AS start_line, p_partkey + p_size AS end_line
  FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey)"""
IMPORTS = "imports AS (SELECT DISTINCT 'c' || o_custkey AS from_id, 's' || l_suppkey AS to_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
REEXPORTS = """reexports AS (
  SELECT DISTINCT 's' || l_suppkey AS from_id, 's' || n AS to_id FROM (
    SELECT l_suppkey, lead(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_suppkey) AS n
    FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')) WHERE n IS NOT NULL)"""
EDGES = f"{IMPORTS}, {REEXPORTS}, edges AS (SELECT from_id, to_id, 'file_imports_file' AS type FROM imports UNION ALL SELECT from_id, to_id, 'file_reexports_file' FROM reexports)"
LINES = """lines AS (
  SELECT doc_id, repo, dir, row_number() OVER (PARTITION BY rid ORDER BY p) AS line_no, line FROM (
    SELECT rid, doc_id, repo, dir, unnest(range(1, len(xs) + 1)) AS p, unnest(xs) AS line FROM (
      SELECT row_number() OVER () AS rid, doc_id, source AS repo, lang AS dir, string_split(text, chr(10)) AS xs FROM documents)))"""
SNAPSHOTS = """a AS (SELECT doc_id AS key, source AS repo, lang AS dir, text, sha256(text) AS sha256, length(text) AS size FROM documents),
b AS (
  SELECT key, repo, dir, text, sha256(text) AS sha256, length(text) AS size FROM (
    SELECT key, repo, dir, CASE WHEN repo = 'src3' THEN text || chr(10) || '// changed' ELSE text END AS text FROM a WHERE dir <> 'de')
  UNION ALL SELECT key + 1000000000000, repo, dir, text, sha256, size FROM a WHERE dir = 'fr')"""
