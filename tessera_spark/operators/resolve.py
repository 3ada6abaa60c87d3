"""Import specifiers to files, and uses of components to the symbols they mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from . import tables

# Prefixes that look like an alias of the repository itself.
ALIAS_PREFIXES = ("@/", "~/", "#/")
EXPLICIT_RE = r"\.(js|jsx|ts|tsx)$"
CONFIG_NAMES = ("tsconfig.json", "tsconfig.base.json", "jsconfig.json")


def configs(files: DataFrame) -> DataFrame:
    """(repo, dir, base_url, mappings): the path rules of each directory's config file, of rows (repo, path, text).

    base_url is relative to the repository, null where none is set. A mapping is (pattern, target), both with at most one `*`,
    targets relative to the repository. A directory's jsconfig.json comes first, then tsconfig.base.json, then tsconfig.json by
    the last of their names; malformed files have no rules.
    """
    c = files.where(paths.base_name(F.col("path")).isin(*CONFIG_NAMES)).withColumn("dir", paths.dir_name(F.col("path")))
    parsed = F.from_json("text", "compilerOptions struct<baseUrl: string, paths: map<string, array<string>>>")["compilerOptions"]
    c = c.withColumn("_o", parsed).where("_o is not null")
    join = lambda a, b: paths.resolve_relative(a, b)
    base = F.when(F.col("_o.baseUrl").isNotNull(), join(F.col("dir"), F.col("_o.baseUrl")))
    root = F.coalesce(base, F.col("dir"))
    rules = F.flatten(F.transform(F.map_entries(F.coalesce("_o.paths", F.create_map().cast("map<string,array<string>>"))), lambda e: F.transform(e["value"], lambda t: F.struct(e["key"].alias("pattern"), join(root, t).alias("target")))))
    best = tables.keep_best(c.select("repo", "path", "dir", base.alias("base_url"), F.filter(rules, lambda r: r["target"].isNotNull()).alias("mappings")), ["repo", "dir"], [F.desc("path")])
    return best.select("repo", "dir", "base_url", "mappings")


def candidates(base: Column) -> Column:
    """The files that a specifier's path may mean: as written with an extension, else with each one and as a directory's index."""
    at = F.regexp_replace(base, "^/+", "")
    ends = [*(f".{e}" for e in ("ts", "tsx", "js", "jsx")), *(f"/index.{e}" for e in ("ts", "tsx", "js", "jsx"))]
    every = F.array(*[F.regexp_replace(F.concat(at, F.lit(e)), "^/+", "") for e in ends])
    return F.when(at.rlike(EXPLICIT_RE), F.array(at)).otherwise(every)


def resolve_imports(imports: DataFrame, files: DataFrame, config: DataFrame) -> DataFrame:
    """(file_id, source, attempted, status, target, n_targets) of imports(file_id, source), files(file_id, repo, path).

    attempted is relative, alias, baseUrl or non_local; status resolved (one file), ambiguous, unresolved or non_local. Aliases
    come from the nearest config above the importer; `@/`, `~/` and `#/` count as aliases even without a rule. What baseUrl does
    not find is non_local unless its first directory exists.
    """
    i = imports.select("file_id", "source").distinct().join(files.select("file_id", "repo", "path"), "file_id")
    up = files.select("file_id", "repo", F.explode(paths.ancestors(F.col("path"))).alias("a")).select("file_id", "repo", F.col("a.dir").alias("dir"), F.col("a.depth").alias("depth"))
    near = tables.keep_best(up.join(config, ["repo", "dir"]), ["file_id"], [F.desc("depth")]).select("file_id", "base_url", "mappings")
    i = i.join(near, "file_id", "left")
    src = F.col("source")
    relative = src.rlike(r"^\.\.?(/|$)")
    star = lambda p: p.contains("*")
    before, after = (lambda p: F.substring_index(p, "*", 1)), (lambda p: F.substring_index(p, "*", -1))
    hit = lambda m: F.when(star(m["pattern"]), src.startswith(before(m["pattern"])) & src.endswith(after(m["pattern"]))).otherwise(src == m["pattern"])
    middle = lambda m: F.substring(src, F.length(before(m["pattern"])) + 1, F.length(src) - F.length(before(m["pattern"])) - F.length(after(m["pattern"])))
    filled = lambda m: F.when(star(m["pattern"]), F.concat(before(m["target"]), F.when(star(m["target"]), F.concat(middle(m), after(m["target"]))).otherwise(""))).otherwise(m["target"])
    aliases = F.transform(F.filter(F.col("mappings"), hit), filled)
    aliased = (F.coalesce(F.size(aliases), F.lit(0)) > 0) | F.exists(F.array(*[F.lit(p) for p in ALIAS_PREFIXES]), lambda p: src.startswith(p))
    based = F.col("base_url").isNotNull()
    attempted = F.when(relative, "relative").when(aliased, "alias").when(based, "baseUrl").otherwise("non_local")
    under_base = F.when(F.col("base_url") == "", src).otherwise(F.concat_ws("/", "base_url", "source"))
    bases = F.when(relative, F.array(paths.resolve_relative(paths.dir_name(F.col("path")), src))).when(aliased, F.coalesce(aliases, F.array().cast("array<string>"))).when(based, F.array(under_base))
    i = i.select("file_id", "repo", "source", "base_url", attempted.alias("attempted"), F.flatten(F.transform(F.array_compact(bases), candidates)).alias("cs"))
    target = files.select("repo", paths.normal(F.col("path")).alias("c"), F.col("file_id").alias("target"))
    found = i.select("file_id", "repo", "source", F.explode("cs").alias("c")).join(target, ["repo", "c"]).groupBy("file_id", "source").agg(F.countDistinct("target").alias("n_targets"), F.min("target").alias("t"))
    # Directories and file stems that exist, for what baseUrl does not find.
    first = F.when(F.col("base_url") == "", F.substring_index("source", "/", 1)).otherwise(F.concat_ws("/", "base_url", F.substring_index("source", "/", 1)))
    whole = files.select("repo", F.explode(F.concat(F.transform(paths.ancestors(F.col("path")), lambda a: a["dir"]), F.array(F.col("path"), F.concat_ws("/", F.nullif(paths.dir_name(F.col("path")), F.lit("")), F.substring_index(paths.base_name(F.col("path")), ".", 1))))).alias("_prefix")).distinct()
    i = i.withColumn("_prefix", first).join(whole.withColumn("_there", F.lit(True)), ["repo", "_prefix"], "left").join(found, ["file_id", "source"], "left")
    n = F.coalesce("n_targets", F.lit(0))
    plausible = F.col("_there").isNotNull() & F.col("source").contains("/") & ~F.col("source").startswith("@")
    lost = (F.col("attempted") == "non_local") | ((F.col("attempted") == "baseUrl") & (n == 0) & ~plausible)
    status = F.when(lost, "non_local").when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved")
    return i.select("file_id", "source", F.when(lost, "non_local").otherwise(F.col("attempted")).alias("attempted"), status.alias("status"), F.when(n == 1, F.col("t")).alias("target"), n.cast("long").alias("n_targets"))


def resolve_components(uses: DataFrame, symbols: DataFrame, bindings: DataFrame, resolved: DataFrame, exports: DataFrame) -> DataFrame:
    """uses(file_id, line_no, component) with (target_file, symbol_id, resolution).

    A name is a symbol of its own file if exactly one has it; else what an import binds under it (type-only bindings and, for plain
    names, namespaces aside): resolved_local with the exported symbol, missing_symbol without, package for what is no local file,
    or the import's own status. A member `Base.Name` goes through the binding of Base: a namespace's export, else a member that exports
    do not show. What nothing binds is unresolved, and so is a name that several symbols of the file have.
    """
    u = uses.select("file_id", "line_no", "component").distinct().withColumn("base", F.substring_index("component", ".", 1)).withColumn("member", F.when(F.col("component").contains("."), F.substring_index("component", ".", -1)))
    own = symbols.groupBy("file_id", F.col("name").alias("base")).agg(F.count("*").alias("_own"), F.min("symbol_id").alias("_sid"))
    b = tables.keep_best(bindings.where("not type_only"), ["file_id", "local"], [F.col("source"), F.col("imported")]).select("file_id", F.col("local").alias("base"), "source", "imported", F.col("kind").alias("_bk"))
    j = u.join(own, ["file_id", "base"], "left").join(b, ["file_id", "base"], "left").join(resolved.select("file_id", "source", "status", "target"), ["file_id", "source"], "left")
    wanted = F.when(F.col("member").isNotNull(), F.when(F.col("_bk") == "namespace", F.col("member"))).otherwise(F.col("imported"))
    shown = exports.select(F.col("file_id").alias("target"), F.col("exported").alias("_want"), F.col("local").alias("_local")).distinct()
    shown = tables.keep_best(shown, ["target", "_want"], [F.col("_local")])
    at = symbols.groupBy(F.col("file_id").alias("target"), F.col("name").alias("_local")).agg(F.min("symbol_id").alias("_there"))
    j = j.withColumn("_want", wanted).join(shown, ["target", "_want"], "left").join(at, ["target", "_local"], "left")
    mine = F.col("member").isNull() & (F.col("_own") == 1)
    torn = F.col("member").isNull() & (F.col("_own") > 1)
    bound = F.col("_bk").isNotNull() & (F.col("member").isNotNull() | (F.col("_bk") != "namespace"))
    local = bound & (F.col("status") == "resolved")
    resolution = (
        F.when(mine, "same_file").when(F.coalesce(torn, F.lit(False)), "unresolved").when(local & F.col("_there").isNotNull(), "resolved_local").when(local, "missing_symbol")
        .when(bound & (F.col("status") == "non_local"), "package").when(bound, F.concat(F.coalesce("status", F.lit("unresolved")), F.lit("_import"))).otherwise("unresolved")
    )
    return j.select("file_id", "line_no", "component", F.when(F.coalesce(mine, F.lit(False)), F.col("file_id")).when(local & ~F.coalesce(torn, F.lit(False)), F.col("target")).alias("target_file"), F.when(F.coalesce(mine, F.lit(False)), F.col("_sid")).when(local & ~F.coalesce(torn, F.lit(False)), F.col("_there")).alias("symbol_id"), resolution.alias("resolution"))
