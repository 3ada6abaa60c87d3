"""Symbols, imports, exports and component uses of TypeScript and JavaScript texts.

A line grammar on the JVM: no parser runs on the executors. Coverage is partial by design: declarations that a line does not
start, and names built at run time, are not seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID = r"[A-Za-z_$][\w$]*"
# Kind -> pattern whose group 1 is the name; the first that matches a line gives its symbol.
DECLARATIONS = {
    "function": rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({ID})",
    "class": rf"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+({ID})",
    "interface": rf"^\s*(?:export\s+)?(?:declare\s+)?interface\s+({ID})",
    "type": rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+({ID})\s*(?:<[^=]*>)?\s*=",
    "variable": rf"^(?:export\s+)?(?:const|let|var)\s+({ID})\s*[:=]",
    "method": rf"^\s+(?:(?:public|private|protected|static|async|get|set)\s+)*({ID})\s*\([^;]*\)\s*(?::[^={{]+)?\{{\s*$",
}
NOT_METHODS = ("catch", "for", "function", "if", "return", "switch", "while", "with")


def lines(files: DataFrame, text: str = "text") -> DataFrame:
    """files with (line_no, line); line_no counts from 1."""
    keep = [c for c in files.columns if c != text]
    return files.select(*keep, F.posexplode_outer(F.split(text, r"\r?\n")).alias("_p", "line")).where("line is not null").select(*keep, (F.col("_p") + 1).alias("line_no"), "line")


def symbols(files: DataFrame, file_id: str = "file_id") -> DataFrame:
    """(symbol_id, file_id, name, kind, exported, start_line, end_line): ids are file:kind:name:ordinal; a symbol ends before the next of its level."""
    kind, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, pattern in reversed(DECLARATIONS.items()):
        found = F.regexp_extract("line", pattern, 1)
        ok = (found != "") & (~found.isin(*NOT_METHODS) if k == "method" else F.lit(True))
        kind, name = F.when(ok, k).otherwise(kind), F.when(ok, found).otherwise(name)
    x = lines(files.select(file_id, "text")).select(file_id, "line_no", "line", kind.alias("kind"), name.alias("name"))
    last = F.max("line_no").over(Window.partitionBy(file_id))
    s = x.withColumn("_last", last).where("kind is not null").withColumn("_inner", F.col("kind") == "method")
    after = F.min(F.when(~F.col("_inner"), F.col("line_no"))).over(Window.partitionBy(file_id).orderBy("line_no").rowsBetween(1, Window.unboundedFollowing))
    after_any = F.lead("line_no").over(Window.partitionBy(file_id).orderBy("line_no"))
    end = F.coalesce(F.when(F.col("_inner"), after_any).otherwise(after) - 1, F.col("_last"))
    n = F.row_number().over(Window.partitionBy(file_id, "kind", "name").orderBy("line_no"))
    return s.select(F.concat_ws(":", file_id, "kind", "name", n).alias("symbol_id"), file_id, "name", "kind", F.col("line").rlike(r"\bexport\b").alias("exported"), F.col("line_no").alias("start_line"), end.alias("end_line"))


def imports(files: DataFrame, file_id: str = "file_id") -> DataFrame:
    """(file_id, source, imported, local, kind, type_only): a row per binding; kind is default, named, namespace or side_effect."""
    pattern = r"import\s+(type\s+)?([^'\";]*?)\s*from\s*['\"]([^'\"]+)['\"]"
    whole = F.regexp_extract_all("text", F.lit(r"(import\s+(?:type\s+)?[^'\";]*?\s*from\s*['\"][^'\"]+['\"])"), F.lit(1))
    rows = files.select(file_id, F.explode(whole).alias("s"))
    rows = rows.select(file_id, F.regexp_extract("s", pattern, 3).alias("source"), (F.regexp_extract("s", pattern, 1) != "").alias("type_only"), F.regexp_extract("s", pattern, 2).alias("clause"))
    named = F.regexp_extract("clause", r"\{([^}]*)\}", 1)
    space = F.regexp_extract("clause", rf"\*\s*as\s+({ID})", 1)
    default = F.regexp_extract("clause", rf"^({ID})", 1)
    b = lambda imported, local, kind: F.struct(imported.alias("imported"), local.alias("local"), F.lit(kind).alias("kind"))
    part = F.filter(F.transform(F.split(named, ","), lambda p: F.regexp_replace(F.trim(p), r"^type\s+", "")), lambda p: p != "")
    all_ = F.concat(
        F.when(default != "", F.array(b(F.lit("default"), default, "default"))).otherwise(F.array()),
        F.when(space != "", F.array(b(F.lit("*"), space, "namespace"))).otherwise(F.array()),
        F.transform(part, lambda p: b(F.regexp_extract(p, rf"^({ID})", 1), F.regexp_extract(p, rf"({ID})$", 1), "named")),
    )
    bound = rows.select(file_id, "source", "type_only", F.explode(all_).alias("b")).select(file_id, "source", "b.imported", "b.local", "b.kind", "type_only")
    bare = files.select(file_id, F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*import\s+['\"]([^'\"]+)['\"]"), F.lit(1))).alias("source"))
    none = F.lit(None).cast("string")
    return bound.unionByName(bare.select(file_id, "source", none.alias("imported"), none.alias("local"), F.lit("side_effect").alias("kind"), F.lit(False).alias("type_only")))


def exports(files: DataFrame, file_id: str = "file_id") -> DataFrame:
    """(file_id, kind, exported, local, source): declarations, lists, re-exports, star exports and default expressions."""
    x = lines(files.select(file_id, "text"))
    none = F.lit(None).cast("string")
    decl = rf"^\s*export\s+(?:default\s+)?(?:declare\s+)?(?:abstract\s+)?(?:async\s+)?(?:function\s*\*?|class|interface|type|const|let|var|enum)\s+({ID})"
    own = x.where(F.col("line").rlike(decl)).select(file_id, F.lit("declaration").alias("kind"), F.when(F.col("line").rlike(r"^\s*export\s+default\b"), "default").otherwise(F.regexp_extract("line", decl, 1)).alias("exported"), F.regexp_extract("line", decl, 1).alias("local"), none.alias("source"))
    value = x.where(F.col("line").rlike(r"^\s*export\s+default\b") & ~F.col("line").rlike(decl))
    named_value = F.nullif(F.regexp_extract("line", rf"^\s*export\s+default\s+({ID})\s*;?\s*$", 1), F.lit(""))
    value = value.select(file_id, F.lit("default").alias("kind"), F.lit("default").alias("exported"), named_value.alias("local"), none.alias("source"))
    lists = r"export\s+(?:type\s+)?\{([^}]*)\}(?:\s*from\s*['\"]([^'\"]+)['\"])?"
    found = files.select(file_id, F.explode(F.regexp_extract_all("text", F.lit(r"(export\s+(?:type\s+)?\{[^}]*\}(?:\s*from\s*['\"][^'\"]+['\"])?)"), F.lit(1))).alias("s"))
    found = found.select(file_id, F.nullif(F.regexp_extract("s", lists, 2), F.lit("")).alias("source"), F.explode(F.split(F.regexp_extract("s", lists, 1), ",")).alias("p")).withColumn("p", F.trim("p")).where("p <> ''")
    named = found.select(file_id, F.when(F.col("source").isNull(), "list").otherwise("reexport").alias("kind"), F.regexp_extract("p", rf"({ID})$", 1).alias("exported"), F.regexp_extract("p", rf"^({ID})", 1).alias("local"), "source")
    star = files.select(file_id, F.explode(F.regexp_extract_all("text", F.lit(r"export\s+\*\s*from\s*['\"]([^'\"]+)['\"]"), F.lit(1))).alias("source")).select(file_id, F.lit("star").alias("kind"), F.lit("*").alias("exported"), none.alias("local"), "source")
    return own.unionByName(value).unionByName(named).unionByName(star)


def components(files: DataFrame, file_id: str = "file_id") -> DataFrame:
    """(file_id, line_no, component, base, prop, value_kind): uses of capitalised elements, a row per prop, one with null prop if it has none."""
    x = lines(files.select(file_id, "text"))
    tag = r"(<(?:[A-Z][\w.]*|[a-z]\w*\.[A-Z]\w*)(?:\s+[\w-]+(?:=(?:\{[^}]*\}|\"[^\"]*\"|'[^']*'))?)*)"
    t = x.select(file_id, "line_no", F.explode(F.regexp_extract_all("line", F.lit(tag), F.lit(1))).alias("t"))
    t = t.select(file_id, "line_no", F.regexp_extract("t", r"^<([\w.]+)", 1).alias("component"), F.regexp_extract_all("t", F.lit(r"\s([\w-]+(?:=(?:\{[^}]*\}|\"[^\"]*\"|'[^']*'))?)"), F.lit(1)).alias("ps"))
    p = t.select(file_id, "line_no", "component", F.explode_outer("ps").alias("p"))
    kind = F.when(F.col("p").isNull(), None).when(~F.col("p").contains("="), "boolean").when(F.col("p").contains("={"), "expression").otherwise("string")
    return p.select(file_id, "line_no", "component", F.substring_index("component", ".", 1).alias("base"), F.regexp_extract("p", r"^([\w-]+)", 1).alias("prop"), kind.alias("value_kind"))


def is_reference(line: Column, name: str) -> Column:
    """A line that uses a name, comments aside."""
    from ..functions.text import whole_word

    return whole_word(line, name) & ~F.trim(line).rlike(r"^(//|/\*|\*)")


def reference_score(line: Column, name: str) -> Column:
    """4 for an import, 3 for a construction, 2 for a member or a call, else 1."""
    import re

    n = re.escape(name)
    return F.when(line.rlike(r"^\s*import\b"), 4).when(line.rlike(rf"\bnew\s+{n}\s*\("), 3).when(line.rlike(rf"\.{n}\b"), 2).when(line.rlike(rf"\b{n}\s*\("), 2).otherwise(1)
