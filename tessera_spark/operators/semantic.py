"""Edges between symbols, from extracted rows: references through imports, components in JSX, and calls of API routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import extract
from . import tables

# Files that handle routes, their methods, and how clients call them.
ROUTE_FILE_RE = r"^(?:src/)?app(/api/.+)/route\.(?:tsx?|jsx?)$"
PAGES_FILE_RE = r"^(?:src/)?pages(/api/.+)\.(?:tsx?|jsx?)$"
METHODS = ("GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS")
CALL_RE = r"\b(?:fetch|(?:axios|client|http|api)\.(get|post|put|patch|delete))\s*(?:<[^>()]*>)?\(\s*['\"`](/api/[^'\"`]*)['\"`]"


def word_in(line: Column, name: Column) -> Column:
    """Whether a line has an identifier, both given as columns; not where a quote is right before it."""
    return F.regexp_like(line, F.concat(F.lit(r"(?<![\w$.'\"`])"), F.regexp_replace(name, r"\$", r"\\\\\\$"), F.lit(r"(?![\w$])")))


def bound_symbols(imports: DataFrame, resolved: DataFrame, exports: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, local, type_only, to_file, to_symbol): what each import binding stands for, through the target's exports."""
    at = resolved.where("status = 'resolved'").select("file_id", "source", F.col("target").alias("to_file"))
    shown = exports.where("source is null").select(F.col("file_id").alias("to_file"), F.col("exported").alias("imported"), F.coalesce("local", "exported").alias("name")).distinct()
    s = tables.keep_best(symbols.select(F.col("file_id").alias("to_file"), "name", F.col("symbol_id").alias("to_symbol"), "start_line"), ["to_file", "name"], [F.col("start_line")])
    return imports.join(at, ["file_id", "source"]).join(shown, ["to_file", "imported"]).join(s, ["to_file", "name"]).select("file_id", "local", "type_only", "to_file", "to_symbol")


def references(files: DataFrame, bound: DataFrame) -> DataFrame:
    """(file_id, line_no, to_file, to_symbol, kind): lines outside imports and comments that use a bound name; jsx, call, type_reference or reference."""
    x = extract.lines(files.select("file_id", "text")).where(~F.col("line").rlike(r"^\s*(import\b|//|/\*|\*)"))
    j = x.join(bound, "file_id").where(word_in(F.col("line"), F.col("local")))
    has = lambda before, after: F.regexp_like(F.col("line"), F.concat(F.lit(before), "local", F.lit(after)))
    kind = F.when(F.col("type_only"), "type_reference").when(has("<", r"[\s/>.]"), "jsx").when(has(r"(?<![\w$.])", r"\s*\("), "call").otherwise("reference")
    return j.select("file_id", F.col("line_no").cast("long").alias("line_no"), "to_file", "to_symbol", kind.alias("kind"))


def routes(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(route, method, file_id, symbol_id): handlers of API routes; a file under pages/api handles every method by its default."""
    path = F.col("path")
    app, pages = F.regexp_extract(path, ROUTE_FILE_RE, 1), F.regexp_extract(path, PAGES_FILE_RE, 1)
    f = files.select("file_id", F.when(app != "", app).when(pages != "", F.regexp_replace(pages, "/index$", "")).alias("route"), (app != "").alias("app")).where("route is not null")
    s = symbols.select("file_id", "name", "symbol_id")
    own = f.join(s, "file_id").where((F.col("app") & F.col("name").isin(*METHODS)) | (~F.col("app") & (F.lower("name") == "handler")))
    return own.select("route", F.when(F.col("app"), F.col("name")).otherwise("*").alias("method"), "file_id", "symbol_id")


def client_calls(files: DataFrame) -> DataFrame:
    """(file_id, line_no, route, method): calls of API routes by a constant address. Addresses made at run time are left out; queries and closing slashes are cut off."""
    x = extract.lines(files.select("file_id", "text"))
    found = x.select("file_id", F.col("line_no").cast("long").alias("line_no"), "line").where(F.col("line").rlike(CALL_RE))
    url = F.regexp_extract("line", CALL_RE, 2)
    method = F.upper(F.regexp_extract("line", CALL_RE, 1))
    given = F.upper(F.regexp_extract("line", r"method:\s*['\"](\w+)['\"]", 1))
    route = F.regexp_replace(F.substring_index(F.substring_index(url, "?", 1), "#", 1), "/+$", "")
    return found.where(~url.contains("${")).select("file_id", "line_no", route.alias("route"), F.when(method != "", method).when(given != "", given).otherwise("GET").alias("method"))


def semantic_edges(files: DataFrame, symbols: DataFrame, imports: DataFrame, exports: DataFrame, resolved: DataFrame) -> DataFrame:
    """(kind, from_file, from_symbol, to_file, to_symbol, strength, n): edges between symbols with the number of lines they come from.

    The symbol a line belongs to is the innermost around it, null at file level. API calls meet handlers by route and method. There is no cap on files or symbols.
    """
    refs = references(files, bound_symbols(imports, resolved, exports, symbols))
    handlers = routes(files, symbols).select("route", "method", F.col("file_id").alias("to_file"), F.col("symbol_id").alias("to_symbol"))
    calls = client_calls(files)
    api = calls.join(handlers, ["route", "method"]).unionByName(calls.join(handlers.where("method = '*'").drop("method"), "route"))
    every = refs.unionByName(api.select("file_id", "line_no", "to_file", "to_symbol", F.lit("api_client_to_route").alias("kind")))
    spans = symbols.select("file_id", "symbol_id", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))
    owner = tables.innermost_interval(every.select("file_id", "line_no").distinct(), spans, "file_id", "line_no", "start_line", "end_line", "symbol_id").select("file_id", "line_no", F.col("symbol_id").alias("from_symbol"))
    j = every.join(owner, ["file_id", "line_no"], "left")
    strength = F.when(F.col("kind").isin("type_reference"), "weak").when(F.col("kind") == "api_client_to_route", "medium").otherwise("strong")
    return j.groupBy("kind", F.col("file_id").alias("from_file"), "from_symbol", "to_file", "to_symbol").agg(F.count("*").alias("n")).withColumn("strength", strength)


def importer_impacts(edges: DataFrame, importers: DataFrame, target_symbol: str, target_file: str) -> DataFrame:
    """(file_id, symbol_id, reason, confidence): what a change of a symbol reaches at once.

    Symbols that refer to it by an edge (high), files that import its file without such an edge (medium), and those that
    re-export it (medium). importers(file_id, kind) are files with an `import` or `reexport` of the target's file.
    """
    used = edges.where((F.col("to_symbol") == target_symbol) & (F.col("from_file") != target_file)).select(F.col("from_file").alias("file_id"), F.col("from_symbol").alias("symbol_id"), F.concat(F.lit("uses-"), "kind").alias("reason"), F.lit("high").alias("confidence"))
    rest = importers.join(used.select("file_id").distinct(), "file_id", "left_anti").select("file_id", F.lit(None).cast("string").alias("symbol_id"), F.when(F.col("kind") == "reexport", "reexports-target").otherwise("imports-target").alias("reason"), F.lit("medium").alias("confidence"))
    return used.unionByName(rest).distinct()


def same_file_impacts(symbols: DataFrame, target_symbol: str, files: DataFrame) -> DataFrame:
    """(symbol_id, confidence): other symbols of a symbol's file that name it, medium, before all else of the file, low."""
    t = symbols.where(F.col("symbol_id") == target_symbol).select("file_id", F.col("name").alias("_name"))
    others = symbols.where(F.col("symbol_id") != target_symbol).join(F.broadcast(t), "file_id")
    x = extract.lines(files.select("file_id", "text")).withColumn("line_no", F.col("line_no").cast("long"))
    hit = others.join(x, "file_id").where((F.col("line_no") >= F.col("start_line")) & (F.col("line_no") <= F.col("end_line")) & word_in(F.col("line"), F.col("_name"))).select("symbol_id").distinct().withColumn("_hit", F.lit(True))
    return others.join(hit, "symbol_id", "left").select("symbol_id", F.when(F.col("_hit"), "medium").otherwise("low").alias("confidence"))

