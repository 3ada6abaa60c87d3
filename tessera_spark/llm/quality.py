"""Quality rules, line first: lines that fail a rule go, then documents that lost too much text.

Everything is a column expression over one row; no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SYMBOL_RE = "[#*$%&|<>]"
# Phrases of page furniture that mark a whole line as boilerplate.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "lorem ipsum", "privacy policy",
    "read more", "sign in", "sign up", "skip to content", "subscribe to", "terms of service", "terms of use",
)
BOILERPLATE_RE = "(?i)(" + "|".join(BOILERPLATE) + ")"


@dataclass(frozen=True)
class Rules:
    """Shares of a line's words above which it fails, and of a document's words below which it is rejected.

    A phrase of page furniture marks a line only up to max_furniture_words: in a longer one it can be part of prose. Missing
    punctuation counts only above max_plain_words: headings, list items and verse have none.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_separator: float = 0.2
    max_symbol: float = 0.3
    max_exclaim: float = 0.3
    max_plain_words: int = 60
    max_furniture_words: int = 30
    min_kept: float = 0.5


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def line_ok(line: Column, r: Rules) -> Column:
    """Whether a line passes. Lines without a word pass: they are kept as paragraph breaks and carry no words."""
    def judge(n: Column) -> Column:
        navigation = count(line, r"(?<![^\x20\x09-\x0D])[|»›•·/](?![^\x20\x09-\x0D])") > r.max_separator * n
        symbols = count(line, SYMBOL_RE + "{2,}") > r.max_symbol * n
        exclaim = count(line, "!{2,}") > r.max_exclaim * n
        unpunctuated = (n > r.max_plain_words) & ~line.rlike(r"[.!?…。！？:;]")
        boilerplate = (n <= r.max_furniture_words) & line.rlike(BOILERPLATE_RE)
        return (n == 0) | ~(navigation | symbols | exclaim | unpunctuated | boilerplate)

    # Bound once: an expression inside a lambda is computed wherever it stands.
    return F.transform(F.array(count(line, r"[^\x20\x09-\x0D]+")), judge)[0]


def with_repeats(d: DataFrame, ws: str, size: str, out: str) -> DataFrame:
    """Adds `out`: words in 3-word windows found twice or more, first included.

    Windows count by their 64-bit hash. Texts without a repeated window stop at a hash-set count; the others sort their
    windows once. Each step is a column of its own, so that nothing is computed twice.
    """
    n = F.col(size)
    hashed = F.transform(
        F.arrays_zip(F.slice(ws, 1, n - 2).alias("a"), F.slice(ws, 2, n - 2).alias("b"), F.slice(ws, 3, n - 2).alias("c")), lambda z: F.xxhash64(z["a"], z["b"], z["c"])
    )
    d = d.withColumn("_r_h", F.when(n > 3, hashed))
    d = d.withColumn("_r_m", F.when(F.size(F.array_distinct("_r_h")) < n - 2, F.sort_array(F.transform("_r_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    # A window beside its neighbours in hash order; the ends meet null, which equals nothing.
    pair = F.arrays_zip(F.col("_r_m").alias("m"), F.concat(F.array(F.lit(None).cast("bigint")), F.col("_r_m.h")).alias("b"), F.slice(F.col("_r_m.h"), 2, n).alias("a"))
    d = d.withColumn("_r_i", F.transform(F.filter(pair, lambda z: (z["m"]["h"] == z["b"]) | (z["m"]["h"] == z["a"])), lambda z: z["m"]["i"]))
    covered = F.size(F.array_union(F.array_union("_r_i", F.transform("_r_i", lambda i: i + 1)), F.transform("_r_i", lambda i: i + 2)))
    return d.withColumn(out, F.when(F.col("_r_m").isNotNull(), covered).otherwise(0).cast("long"))


def quality(docs: DataFrame, *, text_col: str = "text", rules: Rules = Rules(), out: str = "q") -> DataFrame:
    """Adds one struct column `out` to docs: counts, base_failed, kept and the cleaned text.

    Null and empty texts have no words, fail the base and are not kept; their cleaned text is empty. Rows are judged one by
    one, so repeated rows get the same result; other columns stay untouched, whatever their names (but for `out` itself).
    """
    ws = common.words(F.col("_x_text"))
    lines = F.split(F.col("_x_text"), "\n")
    worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    ok = F.filter(lines, lambda x: line_ok(x, rules))
    d = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)], F.coalesce(F.col(text_col), F.lit("")).alias("_x_text"))
    d = d.withColumn("_x_w", ws).withColumn("_x_l", worded).withColumn("_x_clean", F.array_join(ok, "\n")).withColumn("_x_n", F.size("_x_w"))
    d = with_repeats(d, "_x_w", "_x_n", "_x_rep")
    n = F.col("_x_n").cast("long")
    failed = (n < rules.min_words) | (100 * F.col("_x_rep") > rules.max_repeat_percent * n)
    kept_words = common.n_words(F.col("_x_clean"))
    s = F.struct(
        n.alias("n_words"),
        F.length(F.array_join("_x_w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_x_text", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("_x_l") - F.size(F.array_distinct("_x_l"))).cast("long").alias("n_dup_lines"),
        F.col("_x_rep").alias("n_repeat_words"),
        failed.alias("base_failed"),
        (~failed & (kept_words >= rules.min_kept * n)).alias("kept"),
        kept_words.alias("kept_words"),
        F.col("_x_clean").alias("clean_text"),
    )
    return d.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns) if c != out], s.alias(out))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs).select("doc_id", "q.n_words", "q.word_chars", "q.n_symbols", "q.n_dup_lines", "q.n_repeat_words", "q.base_failed", "q.kept", "q.kept_words")


OP3_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
win AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 3)),
hit AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, i + o AS j FROM hit, (SELECT unnest([0, 1, 2]) AS o)) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(text, chr(10))) AS x FROM d),
lw AS (SELECT rid, x, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n FROM ln WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
lt AS (
  SELECT rid, count(*) - count(DISTINCT x) AS dup,
    coalesce(sum(n) FILTER (WHERE NOT (
      len(list_filter(regexp_split_to_array(x, '[\x20\x09-\x0D]+'), lambda y: y IN ('|', '»', '›', '•', '·', '/'))) > 0.2 * n
      OR len(regexp_extract_all(x, '[#*$%&|<>]{{2,}}')) > 0.3 * n
      OR len(regexp_extract_all(x, '!{{2,}}')) > 0.3 * n
      OR (n > 60 AND NOT regexp_matches(x, '[.!?…。！？:;]'))
      OR (n <= 30 AND regexp_matches(x, '{BOILERPLATE_RE}')))), 0) AS kept_words
  FROM lw GROUP BY rid),
a AS (
  SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(kept_words, 0) AS kept_words
  FROM w LEFT JOIN cov USING (rid) LEFT JOIN lt USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND kept_words >= 0.5 * n_words) AS kept, CAST(kept_words AS BIGINT) AS kept_words
FROM a
"""
