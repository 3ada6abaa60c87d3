"""Pattern detectors: what a symbol or file of code is an instance of, with its fingerprint.

Every detector is a condition on columns of one row (a symbol with its body and its file's imports, or a file), so all of
them run in one pass without a shuffle of their own. Bodies are read by patterns, not by a parser; sources.extract says what that misses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from . import extract, repositories

# Patterns of code, of names and of import sources that tell kinds, signals and responsibilities.
JSX_RE = r"(?:return|=>|\(|&&|\?|:)\s*<[A-Za-z>]"
HOOK_CALL_RE = r"(?<![\w$.])(?<!function )use[A-Z0-9_][\w$]*\s*(?:<[^>()]*>)?\("
MAP_RE = r"\{[^{}]*\.map\s*\("
CONDITION_RE = r"&&|\s\?\s[^:]+:"
REQUEST_RE = r"\b(?:fetch|axios|request|client|service)\b[\w.]*\s*\(|\bawait\b[^;\n]*\b(?:fetch|axios|request|client|service)\b"
REQUEST_SOURCE_RE = r"(?i)axios|api|service|client|request|fetch"
METHODS_RE = r"(?i)^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)$"
ROUTE_RE, PAGES_API_RE = r"(?i)(^|/)route\.(tsx?|jsx?)$", r"(?i)^pages/api/"
UTILITY_RE = r"(?i)(^|/)(utils?|helpers?)/"
TEST_SOURCE_RE, TEST_CALL_RE = r"(?i)vitest|jest|testing-library", r"(?<![\w$.])(describe|it|test)\s*\("
STORY_FILE_RE = r"(?i)\.(stories|story)\.(tsx?|jsx?)$"
STORY_META_RE = r"satisfies\s+Meta<|:\s*Meta<|StoryObj<|StoryFn<|ComponentMeta<|ComponentStory<|export\s+default\s+\{[^}]*\b(title|component)\s*:"
STORY_SETUP_RE = r"(?i)(^|/)\.storybook/((main|preview|manager)|.*(setup|vitest\.setup))\.(tsx?|jsx?)$|(^|/)(vitest|storybook)\.config\.(tsx?|jsx?)$"
ROLES = {"component": "component", "hook": "hook", "api-handler": "handler", "utility-export": "utility", "test-suite": "test", "storybook-story": "story"}
NONE = "array<string>"


def _has(sources: Column, pattern: str) -> Column:
    return F.exists(sources, lambda s: F.lower(s).rlike(pattern))


def _set(*pairs: tuple[Column, str]) -> Column:
    return F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(s)) for c, s in pairs]))).cast(NONE)


def normal_source(source: Column) -> Column:
    """An import source without its extension and /index; scoped packages as they are."""
    return F.when(source.startswith("@"), source).otherwise(F.regexp_replace(F.regexp_replace(source, r"(?i)\.(tsx?|jsx?)$", ""), r"(?i)/index$", ""))


def bodies(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbols with the text of their lines."""
    j = symbols.join(files.select("file_id", "repo", "path", "text"), "file_id")
    return j.withColumn("body", F.array_join(F.slice(F.split("text", r"\r?\n"), F.col("start_line").cast("int"), (F.col("end_line") - F.col("start_line") + 1).cast("int")), "\n")).drop("text")


def file_facts(files: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """(file_id, sources, import_set, shown): import sources as written and normalised, exported names as (local, default)."""
    i = imports.groupBy("file_id").agg(F.sort_array(F.collect_set("source")).alias("sources"))
    e = exports.groupBy("file_id").agg(F.collect_set(F.struct(F.coalesce("local", F.lit("")).alias("local"), (F.col("exported") == "default").alias("default"))).alias("shown"))
    f = files.select("file_id").join(i, "file_id", "left").join(e, "file_id", "left")
    none = F.array().cast(NONE)
    f = f.withColumn("sources", F.coalesce("sources", none)).withColumn("shown", F.coalesce("shown", F.array().cast("array<struct<local:string,default:boolean>>")))
    return f.withColumn("import_set", F.array_sort(F.array_distinct(F.transform("sources", normal_source))))


def export_shape(shown: Column) -> Column:
    """none, default, named or mixed of a list of exports."""
    default = F.exists(shown, lambda x: x["default"])
    return F.when(F.size(shown) == 0, "none").when(default, F.when(F.size(shown) == 1, "default").otherwise("mixed")).otherwise("named")


def import_tokens(sources: Column, names: Column) -> Column:
    """Sorted tokens by which files are found through what they import: sources and bound names."""
    return F.array_sort(F.array_distinct(F.filter(F.concat(sources, names), lambda x: x.isNotNull() & (x != ""))))


def responsibilities(kind: Column, name: Column, path: Column, sources: Column, body: Column) -> Column:
    """What a pattern of a kind is there for, sorted."""
    layout = name.rlike(r"(?i)layout$|page$") | (body.rlike(r"(?i)<(main|section|header|footer)\b") & _has(sources, "^next/|routing|router|navigation|metadata"))
    component = _set((layout, "layout-component"), (name.rlike("(?i)button|input|textarea|checkbox|radio|toggle|switch|field|control"), "ui-control"), (name.rlike("(?i)select") | _has(sources, "react-select"), "ui-select"), (name.rlike("(?i)modal|dialog|drawer"), "ui-modal"))
    hook = _set(
        (name.rlike("^use(Get|Fetch|Load)") | _has(sources, "react-query|swr"), "query-hook"), (name.rlike("^use[A-Za-z0-9]*Store$|^useStore") | _has(sources, "zustand|store|context"), "store-hook"),
        (name.rlike("^use(Scroll|Viewport)") | name.rlike("(?i)overlay|measure|resize|position|popover"), "dom-hook"),
    )
    doing = _set((name.rlike("(?i)^(fetch|get|load)"), "fetch-helper"), (name.rlike("(?i)^(create|update|delete|remove|save|patch|upsert|add)"), "service-crud"))
    test = F.when(name.rlike("^use[A-Z]"), "test-hook").when(path.rlike("(?i)service|api|fetch|client"), "test-service").when(path.endswith(".test.tsx") | _has(sources, "testing-library/react"), "test-component")
    none = F.array().cast(NONE)
    return (
        F.when(kind == "component", component).when(kind == "hook", hook).when(kind.isin("async-data-flow", "utility-export", "api-handler"), doing).when(kind == "test-suite", F.array_compact(F.array(test))).otherwise(none)
    )


def detect(files: DataFrame, symbols: DataFrame, imports: DataFrame, exports: DataFrame) -> DataFrame:
    """Patterns of code: (pattern_id, kind, repo_id, file_id, name, start_line, end_line, structural, imports, export_shape, role, ui, async_, responsibility, confidence).

    files(file_id, repo, path, text); symbols, imports and exports as sources.extract gives them. A symbol can be of several kinds.
    """
    facts = file_facts(files, imports, exports)
    s = bodies(files, symbols).join(facts, "file_id")
    body, name, path, lang = F.col("body"), F.col("name"), F.col("path"), repositories.language(F.col("path"))
    first = F.substring_index(body, "\n", 1)
    callable_ = F.col("kind").isin("function", "method") | ((F.col("kind") == "variable") & body.rlike(r"=>|\bfunction\b"))
    handler = callable_ | ((F.col("kind") == "variable") & body.rlike(r"=\s*[\w.]+\("))
    jsx, hooks, is_async = body.rlike(JSX_RE), body.rlike(HOOK_CALL_RE), first.rlike(r"\basync\b")
    own = F.filter("shown", lambda x: x["local"] == name)
    exported = F.col("exported") | (F.size(own) > 0)
    component = callable_ & lang.isin("tsx", "jsx") & jsx & name.rlike("^[A-Z]")
    hook = callable_ & name.rlike("^use[A-Z0-9_]") & hooks
    request = body.rlike(REQUEST_RE) | _has(F.col("sources"), REQUEST_SOURCE_RE)
    careful = body.rlike(r"\btry\s*\{|\bcatch\b")
    flow = callable_ & is_async & body.rlike(r"\bawait\b") & (request | careful)
    route = path.rlike(ROUTE_RE) & name.rlike(METHODS_RE)
    api = handler & (path.rlike(ROUTE_RE) | path.rlike(PAGES_API_RE)) & (name.rlike(METHODS_RE) | name.rlike("(?i)^handler$")) & (route | request | body.rlike(r"(?i)\([^)]*\b(req|request|res|response)\b[^)]*\)"))
    utility = lang.isin("ts", "js") & path.rlike(UTILITY_RE) & exported & ~name.rlike("^use[A-Z0-9_]|^[A-Z]")
    yes, none = F.lit(True), F.array().cast(NONE)
    one = lambda kind, when, structural, ui, async_, confidence: F.when(when, F.struct(F.lit(kind).alias("kind"), structural.alias("structural"), ui.alias("ui"), async_.alias("async_"), confidence.alias("confidence")))
    flow_signals, api_signals = _set((yes, "async-function"), (request, "api-request"), (careful, "error-handling")), _set((is_async, "async-function"), (request, "api-request"))
    high = F.lit("high")
    found = F.array_compact(F.array(
        one("component", component, _set((yes, "react-function-component"), (yes, "jsx-return"), (hooks, "uses-hooks")), _set((yes, "jsx-return"), (hooks, "uses-hooks")), none, F.when(exported, "high").otherwise("medium")),
        one("hook", hook, _set((yes, "custom-hook"), (yes, "uses-hooks")), _set((yes, "uses-hooks")), none, high),
        one("async-data-flow", flow, flow_signals, none, flow_signals, F.when(F.size(flow_signals) >= 3, "high").otherwise("medium")),
        one("list-rendering", component & body.rlike(MAP_RE), _set((yes, "map-rendering")), _set((yes, "map-rendering")), none, high),
        one("conditional-rendering", component & body.rlike(CONDITION_RE), _set((yes, "conditional-render")), _set((yes, "conditional-render")), none, high),
        one("utility-export", utility, _set((yes, "named-export")), none, none, high),
        one("api-handler", api, F.array_sort(F.array_union(F.array(F.lit("route-handler")), api_signals)), none, api_signals, high),
    ))
    columns = ["file_id", "repo", "path", "name", "start_line", "end_line", "import_set", "sources", "body", "symbol_id", "shape"]
    of_symbols = s.withColumn("shape", export_shape(own)).withColumn("symbol_id", F.col("symbol_id")).select(*columns, F.explode(found).alias("f"))
    w = files.join(facts, "file_id").withColumn("name", F.regexp_replace(paths.base_name(path), r"\.[^.]+$", "")).withColumn("end_line", F.size(F.split("text", r"\r?\n")).cast("long")).withColumn("start_line", F.lit(1).cast("long"))
    src = F.col("text")
    suite = _has(F.col("sources"), TEST_SOURCE_RE) & src.rlike(TEST_CALL_RE)
    story = ~path.rlike(STORY_SETUP_RE) & (path.rlike(STORY_FILE_RE) | src.rlike(STORY_META_RE))
    whole = F.array_compact(F.array(one("test-suite", suite, _set((yes, "test-describe-block")), none, none, high), one("storybook-story", story, _set((yes, "storybook-meta")), none, none, high)))
    of_files = w.withColumn("symbol_id", F.lit("file-scope")).withColumn("shape", export_shape(F.col("shown"))).withColumn("body", F.lit("")).select(*columns, F.explode(whole).alias("f"))
    p = of_symbols.unionByName(of_files)
    kind, role = F.col("f.kind"), F.lit("module")
    for k, v in ROLES.items():
        role = F.when(kind == k, v).otherwise(role)
    return p.select(
        F.concat_ws(":", "repo", "file_id", "f.kind", "name", F.concat_ws("-", "start_line", "end_line"), "symbol_id").alias("pattern_id"), kind.alias("kind"), F.col("repo").alias("repo_id"), "file_id", "name",
        F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.col("f.structural").alias("structural"), F.col("import_set").alias("imports"), F.col("shape").alias("export_shape"), role.alias("role"),
        F.col("f.ui").alias("ui"), F.col("f.async_").alias("async_"), responsibilities(kind, F.col("name"), F.col("path"), F.col("sources"), F.col("body")).alias("responsibility"), F.col("f.confidence").alias("confidence"),
    )


def anchors(files: DataFrame, dependencies: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """(file_id, indexed, deps, dep_tokens, graph_anchored, strength): files' structural anchors.

    dependencies(file_id, target): resolved local imports; related(file_id, other): files found near. Strength is high with two of
    either or one of both, medium with one, else low.
    """
    p = files.select(F.col("file_id").alias("target"), F.col("path").alias("_tp"))
    d = dependencies.distinct().join(p, "target", "left").withColumn("_tp", F.coalesce("_tp", F.substring_index("target", ":", -1)))
    folder = F.when(paths.dir_name(F.col("_tp")) == "", F.col("_tp")).otherwise(paths.dir_name(F.col("_tp")))
    d = d.withColumn("_tk", text.path_tokens(folder)).groupBy("file_id").agg(F.sort_array(F.collect_set("target")).alias("deps"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("_tk")))).alias("dep_tokens"))
    f = files.select("file_id", (repositories.classify(F.col("path")) == "source").alias("indexed")).join(d, "file_id", "left")
    if related is not None:
        f = f.join(related.distinct().groupBy("file_id").agg(F.count("*").alias("_k")), "file_id", "left")
    none = F.array().cast(NONE)
    n, k = F.size(F.coalesce("deps", none)), F.coalesce("_k", F.lit(0)) if related is not None else F.lit(0)
    anchored = F.col("indexed") & ((n > 0) | (k > 0))
    strength = F.when(anchored & ((n >= 2) | (k >= 2) | ((n >= 1) & (k >= 1))), "high").when(anchored, "medium").otherwise("low")
    return f.select("file_id", "indexed", F.coalesce("deps", none).alias("deps"), F.coalesce("dep_tokens", none).alias("dep_tokens"), anchored.alias("graph_anchored"), strength.alias("strength"))
