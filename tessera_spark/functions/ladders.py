"""Rule ladders: the first clause that holds decides. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(score: Column, high: float = 0.8, medium: float = 0.55) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def coverage_ratio(analysed: Column, total: Column) -> Column:
    from .text import round3

    most = F.greatest(analysed, total)
    return F.when(total == 0, 0.0).otherwise(round3(analysed / most))


def tool_confidence(ratio: Column, completeness: Column, relevant: Column) -> Column:
    return F.when((ratio < 0.6) | (completeness < 0.4), "low").when((ratio > 0.9) & (completeness > 0.8) & relevant, "high").otherwise("medium")


# Words that tell a family, path parts, and file names of pages.
STATE_WORDS = ("context", "provider", "store", "state", "reducer", "slice")
WRAPPER_WORDS = ("wrapper", "shell", "layout", "container", "boundary", "frame")
COMPONENT_DIRS, ROUTE_DIRS = ("/_components/", "/components/", "/ui/"), ("/app/", "/pages/", "/screen")
SERVER_DIRS, MODULE_DIRS, HELPER_DIRS = ("/api/", "/server/", "/actions/"), ("/integration", "/adapters/", "/clients/", "/connectors/"), ("/utils/", "/helpers/")
PAGE_FILES = ("page.tsx", "page.jsx", "screen.tsx", "screen.jsx")


def family(path: Column, kind: Column, name: Column, role: Column, signals: Column, responsibilities: Column) -> Column:
    """The precedent family of a pattern without one: support and handlers by kind, then state, then components by page, place and wrapper cues, then paths."""
    low = F.lower(path)
    base = F.substring_index(low, "/", -1)
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(c, r"\.[^.]+$", ""), "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: w != "")
    every = F.concat(words(base), words(name), F.flatten(F.transform(responsibilities, words)))
    said = lambda ws: F.arrays_overlap(every, F.array(*[F.lit(w) for w in ws]))
    under = lambda parts: low.rlike("|".join(parts))
    component, hook = kind == "component", kind == "hook"
    state, wrapper, placed, canonical = said(STATE_WORDS), said(WRAPPER_WORDS), under(COMPONENT_DIRS), base.isin(*PAGE_FILES)
    routed = component & (under(ROUTE_DIRS) | low.rlike(r"\[[^\]]+\]"))
    named = canonical | F.arrays_overlap(words(name), F.array(F.lit("page"), F.lit("screen"))) | F.exists(responsibilities, lambda r: F.lower(r).rlike("page|screen|route"))
    page = named & (routed | canonical)
    visible = placed | (role == "component") | F.arrays_overlap(signals, F.array(F.lit("react-function-component"), F.lit("jsx-return")))
    shown = F.when(wrapper, "ui_wrapper_or_shell").otherwise("ui_component")
    return (
        F.when(kind.isin("test-suite", "storybook-story"), "support_runtime").when(kind == "api-handler", "api_or_handler")
        .when(hook, F.when(state, "state_or_store").otherwise("hook_or_context")).when(state, F.when(component, "state_or_store").otherwise("hook_or_context"))
        .when(component & page & (~placed | ~visible), "routed_page_or_screen").when(component, shown)
        .when(under(SERVER_DIRS), "api_or_handler").when(wrapper, "ui_wrapper_or_shell").when(under(MODULE_DIRS) | kind.isin("service-layer", "data-access"), "module_or_integration")
        .when((kind == "utility-export") & under(HELPER_DIRS), "util_or_helper").otherwise("module_or_integration")
    )


# What a path says of its boundary, the first that holds; and paths that a framework enters.
ENTRY_RE = r"(?i)^((src/)?app/layout|(src/)?app/.+/page|(src/)?app/page|(src/)?app/api/.+/route|pages/.+/index)\.(tsx?|jsx?)$"
BOUNDARIES = (
    ("internal", r"(?i)(^|/)(internal|private|impl|implementation|helpers?|__tests__|tests?|fixtures?)/"),
    ("entry", ENTRY_RE),
    ("public", r"(?i)(^|/)(public|api|exports?)/|^(src/)?index\.(tsx?|jsx?)$"),
    ("shared", r"(?i)(^|/)(shared|common)/|^(src/)?components/(ui|shared)/"),
    ("feature", r"(?i)^(src/)?(features?|app|pages)/|^(src/)?components/(admin|settings|project|bucket|translation|workspace)/"),
    ("infrastructure", r"(?i)(^|/)(infra|infrastructure|platform|core)/"),
)


def path_boundary(path: Column) -> Column:
    """struct(boundary, internal, entry) of a file's path; what a framework enters is a feature."""
    kind = F.lit("unknown")
    for name, pattern in reversed(BOUNDARIES):
        kind = F.when(path.rlike(pattern), name).otherwise(kind)
    return F.struct(F.when(kind == "entry", "feature").otherwise(kind).alias("boundary"), (kind == "internal").alias("internal"), (kind == "entry").alias("entry"))


def ownership(exported: Column, reexported: Column, entry_surface: Column, boundary: Column, internal: Column, entry: Column, usage: Column, ui: Column) -> Column:
    """Who a symbol is for, the first clause that holds.

    usage is none, local-only, feature-local, cross-feature or repo-wide; ui says how components reuse it.
    """
    idle, wide = usage.isin("none", "local-only"), usage.isin("cross-feature", "repo-wide")
    open_ = exported & ~internal
    shown = reexported | entry_surface
    primitive = (ui == "shared-ui-primitive") & ~internal & (boundary.isin("shared", "feature", "unknown") | wide)
    return (
        F.when(~exported & idle, "internal-local")
        .when(open_ & entry_surface & (reexported | (boundary == "public")) & (usage == "repo-wide"), "public-surface")
        .when(open_ & shown & ((boundary == "public") | wide | (((boundary == "shared") | entry_surface) & ~idle)), "shared-surface")
        .when(open_ & reexported & (boundary.isin("shared", "public", "feature") | ~idle), F.when(idle, "shared-internal").otherwise("shared-surface"))
        .when(open_ & entry & entry_surface & (usage != "cross-feature"), "shared-surface")
        .when(primitive, F.when(exported & (shown | (boundary == "public")), "shared-surface").otherwise("shared-internal"))
        .when((boundary.isin("shared", "infrastructure") | wide) & ~shown, "shared-internal")
        .when((usage == "feature-local") & (boundary.isin("feature", "internal", "unknown") | ~exported) & ~reexported, "feature-internal")
        .when(open_ & ui.isin("feature-ui-component", "page-level-feature-component") & ~shown & ~wide, "feature-internal")
        .when((~exported & idle) | (internal & ~wide), "internal-local")
        .otherwise("unknown")
    )


def api_boundary(owner: Column, exported: Column, entry_surface: Column, boundary: Column, usage: Column, ui: Column, parent_pages: Column) -> Column:
    """Which boundary a symbol of an owner stands at."""
    local = entry_surface | (boundary == "feature") | (usage == "feature-local") | ui.isin("feature-ui-component", "page-level-feature-component") | (parent_pages >= 1)
    return (
        F.when(owner == "unknown", "unknown").when(owner == "public-surface", "public-boundary").when((owner == "shared-surface") | (entry_surface & boundary.isin("shared", "public")), "shared-boundary")
        .when((owner == "shared-internal") & (boundary.isin("shared", "infrastructure") | usage.isin("cross-feature", "repo-wide")), "shared-boundary")
        .when((owner == "feature-internal") & local, "feature-boundary").when(owner == "internal-local", "not-api-like").when(exported | (usage == "local-only"), "local-boundary").otherwise("unknown")
    )


def usage(importers: Column, dirs: Column, areas: Column, only_own_dir: Column, only_own_area: Column) -> Column:
    return (
        F.when(importers == 0, "none").when(only_own_dir & (dirs <= 1), "local-only").when(only_own_area & (areas <= 1), "feature-local")
        .when((areas >= 4) | (importers >= 6), "repo-wide").otherwise("cross-feature")
    )


def change_signals(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Sorted signals of a modified file: each compared surface that differs, or metadataOnlyChanged if only its time does."""
    parts = [F.when(~old[k].eqNullSafe(new[k]), f"{k}Changed") for k in sorted(old) if k not in ("sha256", "mtime_ms")]
    content = ~old["sha256"].eqNullSafe(new["sha256"])
    touched = ~old["mtime_ms"].eqNullSafe(new["mtime_ms"])
    return F.array_sort(F.array_compact(F.array(*parts, F.when(content, "contentChanged"), F.when(~content & touched, "metadataOnlyChanged"))))


def modified_signals(changed: dict[str, Column], relations: Column) -> Column:
    """Sorted signals of a modified file from which of its surfaces differ.

    changed: content, symbols, imports, exports, uiStructure, uiProps, uiRendering, uiStyling, patterns. relations says whether both
    sides have a file relation. A change of content that no surface shows is an unknown structural one.
    """
    names = {"symbols": "symbolSurfaceChanged", "imports": "importsChanged", "exports": "exportsChanged", "uiStructure": "uiStructureChanged", "uiProps": "uiPropsChanged", "uiRendering": "uiRenderingChanged", "uiStyling": "uiStylingChanged", "patterns": "patternRelevantChanged"}
    some = F.lit(False)
    for k in names:
        some = some | changed[k]
    unknown = ~relations | (changed["content"] & ~some)
    parts = [F.when(changed[k], v) for k, v in names.items()]
    parts += [F.when(changed["imports"] | changed["exports"], "graphRelevantChanged"), F.when(changed["exports"], "likelyApiBoundaryChanged"), F.when(unknown, "unknownStructuralChange")]
    return F.array_sort(F.array_compact(F.array(*parts, F.when(changed["content"], "contentChanged").otherwise("metadataOnlyChanged"))))


def modified_hints(signals: Column, tsx: Column) -> Column:
    """Sorted hints of what a modified file makes necessary."""
    has = lambda *s: F.arrays_overlap(signals, F.array(*[F.lit(x) for x in s]))
    unknown = has("unknownStructuralChange")
    parts = {
        "requiresSymbolReindex": ~has("metadataOnlyChanged"), "mayAffectSearchFreshness": ~has("metadataOnlyChanged"), "requiresGraphRebuild": has("importsChanged", "exportsChanged", "graphRelevantChanged") | unknown,
        "requiresUiRefresh": has("uiStructureChanged", "uiPropsChanged", "uiRenderingChanged", "uiStylingChanged") | (unknown & tsx), "requiresPatternRefresh": has("patternRelevantChanged") | unknown,
        "mayAffectDependents": has("importsChanged", "exportsChanged", "likelyApiBoundaryChanged"), "highRiskStructuralChange": unknown,
    }
    return F.array_sort(F.array_compact(F.array(*[F.when(c, k) for k, c in parts.items()])))


def search_freshness(request: Column, request_at: Column, mine: Column, history_at: Column, snapshot: Column, outcome: Column, refreshed_at: Column, equal: Column) -> Column:
    """State of the search index: ready, stale, pending, failed or unknown.

    request and snapshot are the states of their markers (ok, missing or another); mine says whether the request is of this
    generation, history_at when the generation asked itself, outcome is the snapshot's own status, equal whether fingerprints agree.
    Markers that cannot be trusted only ever lower the state.
    """
    asked, seen = request == "ok", snapshot == "ok"
    failed = F.coalesce(outcome == "failed", F.lit(False))
    at = F.when(mine, request_at)
    careful = F.when(seen & failed, "failed").when(asked | F.coalesce(request_at, history_at).isNotNull(), "pending").when(seen, "stale").otherwise("unknown")
    exact = F.when(failed & F.coalesce(refreshed_at >= at, F.lit(False)), "failed").when(outcome == "ready", F.when(equal, "ready").otherwise("stale")).when(at.isNotNull(), "pending").otherwise("unknown")
    return F.when(asked & seen, exact).otherwise(careful)


def pattern_integrity(eligible: Column, patterns: Column, bearing: Column, previous: Column, changed: Column, trusted_before: Column, artifact: Column) -> Column:
    """struct(status, codes) of a pattern index: eligible source files, patterns, files that have some, the previous count (null: none), files changed, whether the previous generation was trusted, state of its artifact (null: none)."""
    before = F.coalesce(trusted_before & previous.isNotNull(), F.lit(False))
    checks = [
        ("previous-pattern-artifact-untrusted", "warning", F.coalesce(artifact != "ok", F.lit(False))),
        ("pattern-output-catastrophically-incomplete", "error", (eligible >= 25) & (patterns <= 2)),
        ("pattern-count-catastrophic-regression", "error", before & F.coalesce((previous >= 25) & (patterns <= F.greatest(F.lit(2), F.floor(previous * 0.1))), F.lit(False)) & (eligible >= 10) & (changed <= F.greatest(F.lit(10), F.floor(eligible * 0.25)))),
        ("pattern-bearing-files-collapse", "error", before & F.coalesce(previous >= 50, F.lit(False)) & (bearing <= 2) & (eligible >= 20)),
        ("pattern-output-empty", "warning", (eligible >= 10) & (patterns == 0) & previous.isNull()),
    ]
    codes = F.array_compact(F.array(*[F.when(c, code) for code, _, c in checks]))
    failed = F.lit(False)
    for _, severity, c in checks:
        failed = failed | c if severity == "error" else failed
    return F.struct(F.when(failed, "failed").when(F.size(codes) > 0, "degraded").otherwise("trusted").alias("status"), codes.alias("codes"))


def trust(state: Column, integrity_issues: Column, regressed: Column, drifted: Column) -> Column:
    return F.when(state.isNull(), "missing").when(state == "failed", "failed").when((integrity_issues > 0) | regressed, "degraded").when(drifted, "stale").otherwise("trusted")


def regressed(baseline_files: Column, changed_files: Column, baseline: Column, current: Column, ratio: float, floor: int) -> Column:
    """A count that fell too far to be explained by the files that changed."""
    small = changed_files <= F.greatest(F.lit(5), F.floor(0.2 * baseline_files))
    return (baseline_files >= 10) & small & (baseline >= 20) & (current / baseline <= ratio) & (current <= floor)


def budget_profile(files: int) -> dict[str, int]:
    """Caps of context assembly; large repositories get tighter ones."""
    return {"strong": 48, "medium": 24, "weak": 6, "enough": 3} if files >= 5000 else {"strong": 96, "medium": 64, "weak": 24, "enough": 4}
