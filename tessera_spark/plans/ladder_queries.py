"""Rule ladders over every combination of their inputs, which both engines count out from a range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import artifacts, ladders, paths
from ..sources import repositories
from .registry import query


def _digit(base: int, below: int) -> str:
    """A digit of id in mixed radix: `base` values, after `below` combinations of the digits before."""
    return f"(CAST(floor(id / {below}) AS INT) % {base})"


def _choice(values: list[str | None], digit: str) -> str:
    return f"CASE {digit} " + " ".join(f"WHEN {i} THEN {'NULL' if v is None else repr(v)}" for i, v in enumerate(values)) + " END"


def _table(columns: dict[str, list | int]) -> tuple[int, dict[str, str]]:
    """(number of combinations, column -> expression). A list is the column's values; an int n stands for 0 to n - 1, 2 for false and true."""
    below, out = 1, {}
    for name, values in columns.items():
        n = values if isinstance(values, int) else len(values)
        d = _digit(n, below)
        out[name] = (f"{d} = 1" if n == 2 else d) if isinstance(values, int) else _choice(values, d)
        below *= n
    return below, out


def _rows(spark, fixture: tuple[int, dict[str, str]]) -> DataFrame:
    n, columns = fixture
    return spark.range(n).selectExpr("id", *[f"{e} AS {c}" for c, e in columns.items()])


def _sql(fixture: tuple[int, dict[str, str]]) -> str:
    n, columns = fixture
    return f"t AS (SELECT id, {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM (SELECT range AS id FROM range({n})))"


_DIRS = ["", "src/", "src/app/", "app/cart/", "src/features/cart/", "pages/shop/", "src/components/ui/", "components/admin/", "src/shared/", "lib/core/x/", "src/internal/", "packages/api/", "src/__tests__/", "platform/", "web/common/", ".next/", "out/", "src/generated/", "web/fixtures/", "a/__snapshots__/", ".github/", "bench/", "web/src/compiled/", "src/app/api/orders/", "web/components/", "web/utils/", "web/adapters/", "web/app/"]
_NAMES = ["index.ts", "page.tsx", "layout.tsx", "route.ts", "Button.tsx", "useCart.ts", "a.test.ts", "x.d.ts", "x.min.js", "x.generated.ts", "style.css", "data.json", "README.md", "index.html", "Makefile", ".env", "yarn.lock", "x.snap", "logo.SVG", "Page.vue", "lib.min.jsx", "OrderScreen.tsx", "CartProvider.tsx", "AppShell.tsx", "[slug].tsx"]
PATHS = _table({"dir": _DIRS, "name": _NAMES})
_PATH_SQL = f"WITH {_sql(PATHS)}, p AS (SELECT id, dir || name AS path, lower(dir || name) AS low, name, lower(name) AS lname FROM t)"
_GEN = r"(regexp_matches(path, '(^|/)(\.next|\.turbo|\.cache|out|storybook-static|generated)(/|$)') OR regexp_matches(low, '(\.d\.ts|\.generated\.(js|jsx|ts|tsx)|\.min\.(js|jsx))$'))"
_EXT = r"regexp_extract(lname, '^.+(\.[^.]+)$', 1)"


def _in(words: str) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words.split()) + ")"


@query(
    rf"""{_PATH_SQL}, c AS (SELECT *, CASE WHEN {_GEN} THEN 'generated' WHEN {_EXT} IN ('.js', '.jsx', '.ts', '.tsx') THEN 'source' ELSE 'unknown' END AS class FROM p)
SELECT path, class, CASE WHEN starts_with(path, '.github/') THEN 'automation' WHEN starts_with(path, 'bench/') THEN 'benchmark' WHEN contains(path, '/src/compiled/') THEN 'compiled' END AS skipped,
  CASE WHEN class = 'source' THEN 'relevant_source' WHEN regexp_matches(low, '(^|/)(__fixtures__|__snapshots__|fixtures?|snapshots?)(/|$)') OR lname LIKE '%.snap' THEN 'fixture_or_snapshot' WHEN {_EXT} IN {_in(repositories.SCOPES['style_or_asset'])} THEN 'style_or_asset'
    WHEN {_EXT} IN {_in(repositories.SCOPES['data_or_config'])} OR lname IN {_in(' '.join(repositories.DATA_NAMES))} THEN 'data_or_config' WHEN {_EXT} IN {_in(repositories.SCOPES['documentation'])} THEN 'documentation' WHEN {_EXT} IN {_in(repositories.SCOPES['template_or_markup'])} THEN 'template_or_markup' ELSE 'other_non_source' END AS scope,
  regexp_matches(low, '(^|/)(\.git|node_modules|dist|build|coverage|\.next|\.turbo|\.cache|out|storybook-static|generated)(/|$)') OR lname = '.ds_store' OR regexp_matches(lname, '(\.d\.ts|\.generated\.(js|jsx|ts|tsx)|\.min\.(js|jsx)|\.tmp|\.temp|\.swp|\.swo|~)$') AS unsearched FROM c"""
)
def file_scopes(spark, d):
    """Class, skip reason and coverage scope of files."""
    p = F.concat("dir", "name")
    return _rows(spark, PATHS).select(p.alias("path"), repositories.classify(p).alias("class"), repositories.skip_reason(p).alias("skipped"), repositories.scope(p).alias("scope"), repositories.unsearched(p).alias("unsearched"))


@query(
    rf"""{_PATH_SQL}, b AS (SELECT path, regexp_matches(low, '^((src/)?app/layout|(src/)?app/.+/page|(src/)?app/page|(src/)?app/api/.+/route|pages/.+/index)\.(tsx?|jsx?)$') AS entry0, regexp_matches(low, '(^|/)(internal|private|impl|implementation|helpers?|__tests__|tests?|fixtures?)/') AS internal, low FROM p),
g AS (SELECT path, string_split(path, '/') AS seg FROM p)
SELECT b.path, CASE WHEN internal THEN 'internal' WHEN entry0 THEN 'feature' WHEN regexp_matches(low, '(^|/)(public|api|exports?)/') OR regexp_matches(low, '^(src/)?index\.(tsx?|jsx?)$') THEN 'public'
    WHEN regexp_matches(low, '(^|/)(shared|common)/') OR regexp_matches(low, '^(src/)?components/(ui|shared)/') THEN 'shared' WHEN regexp_matches(low, '^(src/)?(features?|app|pages)/') OR regexp_matches(low, '^(src/)?components/(admin|settings|project|bucket|translation|workspace)/') THEN 'feature'
    WHEN regexp_matches(low, '(^|/)(infra|infrastructure|platform|core)/') THEN 'infrastructure' ELSE 'unknown' END AS boundary, internal, entry0 AND NOT internal AS entry,
  CASE WHEN seg[1] = 'src' AND len(seg) >= 3 AND seg[2] IN ('features', 'app', 'pages', 'components', 'lib') THEN seg[1] || '/' || seg[2] || '/' || seg[3] WHEN len(seg) >= 2 THEN seg[1] || '/' || seg[2] ELSE seg[1] END AS area
FROM b JOIN g ON g.path = b.path"""
)
def path_boundaries(spark, d):
    """What paths say of ownership, and the feature that they belong to."""
    p = F.concat("dir", "name")
    return _rows(spark, PATHS).select(p.alias("path"), ladders.path_boundary(p).alias("b"), paths.feature_area(p).alias("area")).select("path", "b.boundary", "b.internal", "b.entry", "area")


_KINDS = ["component", "hook", "api-handler", "test-suite", "service-layer", "utility-export", "list-rendering"]
FAMILIES = _table({"dir": _DIRS[:2] + _DIRS[23:], "name": _NAMES[:7] + _NAMES[21:], "kind": _KINDS, "symbol": ["LoadOrders", "OrderPage", "UserState"], "role": ["component", "module"], "jsx": 2, "resp": [None, "route-guard"]})
_HASW = lambda ws: " OR ".join(f"list_contains(tk, '{w}')" for w in ws)


@query(
    rf"""WITH {_sql(FAMILIES)}, p AS (SELECT *, dir || name AS path, lower(dir || name) AS low, lower(name) AS base, list_filter(string_split_regex(lower(regexp_replace(symbol, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda w: w <> '') AS nt FROM t),
q AS (SELECT *, list_concat(list_concat(nt, string_split_regex(regexp_replace(base, '\.[^.]+$', ''), '[^a-z0-9]+')), CASE WHEN resp IS NULL THEN [] ELSE ['route', 'guard'] END) AS tk, regexp_matches(low, '/_components/|/components/|/ui/') AS placed, base IN ('page.tsx', 'page.jsx', 'screen.tsx', 'screen.jsx') AS canon FROM p),
r AS (SELECT *, {_HASW(ladders.STATE_WORDS)} AS state, {_HASW(ladders.WRAPPER_WORDS)} AS wrap, (canon OR list_contains(nt, 'page') OR list_contains(nt, 'screen') OR resp IS NOT NULL) AND (canon OR (kind = 'component' AND (regexp_matches(low, '/app/|/pages/|/screen') OR regexp_matches(low, '\[[^\]]+\]')))) AS page FROM q)
SELECT id, path, CASE WHEN kind = 'test-suite' THEN 'support_runtime' WHEN kind = 'api-handler' THEN 'api_or_handler' WHEN kind = 'hook' THEN CASE WHEN state THEN 'state_or_store' ELSE 'hook_or_context' END
  WHEN state THEN CASE WHEN kind = 'component' THEN 'state_or_store' ELSE 'hook_or_context' END
  WHEN kind = 'component' THEN CASE WHEN page AND NOT placed THEN 'routed_page_or_screen' WHEN wrap THEN 'ui_wrapper_or_shell' ELSE 'ui_component' END
  WHEN regexp_matches(low, '/api/|/server/|/actions/') THEN 'api_or_handler' WHEN wrap THEN 'ui_wrapper_or_shell' WHEN regexp_matches(low, '/integration|/adapters/|/clients/|/connectors/') OR kind = 'service-layer' THEN 'module_or_integration'
  WHEN kind = 'utility-export' AND regexp_matches(low, '/utils/|/helpers/') THEN 'util_or_helper' ELSE 'module_or_integration' END AS family FROM r"""
)
def precedent_families(spark, d):
    """The family of patterns by kind, name, place and signals."""
    p = F.concat("dir", "name")
    none = F.array().cast("array<string>")
    signals = F.when(F.col("jsx"), F.array(F.lit("jsx-return"))).otherwise(none)
    resp = F.when(F.col("resp").isNull(), none).otherwise(F.array("resp"))
    return _rows(spark, FAMILIES).select("id", p.alias("path"), ladders.family(p, F.col("kind"), F.col("symbol"), F.col("role"), signals, resp).alias("family"))


OWNERS = _table(
    {"exported": 2, "reexported": 2, "entry_surface": 2, "boundary": ["internal", "feature", "shared", "public", "infrastructure", "unknown"], "internal": 2, "entry": 2,
     "usage": ["none", "local-only", "feature-local", "cross-feature", "repo-wide"], "ui": ["none", "shared-ui-primitive", "feature-ui-component", "page-level-feature-component"], "pages": 2}
)


@query(
    f"""WITH {_sql(OWNERS)}, o AS (SELECT *, CASE WHEN NOT exported AND usage IN ('none', 'local-only') THEN 'internal-local'
  WHEN exported AND entry_surface AND (reexported OR boundary = 'public') AND usage = 'repo-wide' AND NOT internal THEN 'public-surface'
  WHEN exported AND (reexported OR entry_surface) AND (boundary = 'public' OR usage = 'cross-feature' OR usage = 'repo-wide' OR ((boundary = 'shared' OR entry_surface) AND usage <> 'none' AND usage <> 'local-only')) AND NOT internal THEN 'shared-surface'
  WHEN exported AND reexported AND NOT internal AND (boundary IN ('shared', 'public', 'feature') OR usage IN ('feature-local', 'cross-feature', 'repo-wide')) THEN CASE WHEN usage IN ('none', 'local-only') THEN 'shared-internal' ELSE 'shared-surface' END
  WHEN exported AND entry AND entry_surface AND usage <> 'cross-feature' AND NOT internal THEN 'shared-surface'
  WHEN ui = 'shared-ui-primitive' AND NOT internal AND (boundary IN ('shared', 'feature', 'unknown') OR usage IN ('cross-feature', 'repo-wide')) THEN CASE WHEN exported AND (reexported OR entry_surface OR boundary = 'public') THEN 'shared-surface' ELSE 'shared-internal' END
  WHEN (boundary IN ('shared', 'infrastructure') OR usage IN ('cross-feature', 'repo-wide')) AND NOT reexported AND NOT entry_surface THEN 'shared-internal'
  WHEN usage = 'feature-local' AND (boundary IN ('feature', 'internal', 'unknown') OR NOT exported) AND NOT reexported THEN 'feature-internal'
  WHEN exported AND ui IN ('feature-ui-component', 'page-level-feature-component') AND NOT reexported AND NOT entry_surface AND NOT internal AND usage NOT IN ('cross-feature', 'repo-wide') THEN 'feature-internal'
  WHEN (NOT exported AND usage IN ('none', 'local-only')) OR (internal AND usage NOT IN ('cross-feature', 'repo-wide')) THEN 'internal-local' ELSE 'unknown' END AS owner FROM t)
SELECT id, owner, CASE WHEN owner = 'unknown' THEN 'unknown' WHEN owner = 'public-surface' THEN 'public-boundary' WHEN owner = 'shared-surface' OR (entry_surface AND boundary IN ('shared', 'public')) THEN 'shared-boundary'
  WHEN owner = 'shared-internal' AND (boundary IN ('shared', 'infrastructure') OR usage IN ('cross-feature', 'repo-wide')) THEN 'shared-boundary'
  WHEN owner = 'feature-internal' AND (entry_surface OR boundary = 'feature' OR usage = 'feature-local' OR ui IN ('feature-ui-component', 'page-level-feature-component') OR pages) THEN 'feature-boundary'
  WHEN owner = 'internal-local' THEN 'not-api-like' WHEN exported OR usage = 'local-only' THEN 'local-boundary' ELSE 'unknown' END AS api FROM o"""
)
def ownership(spark, d):
    """Owner and API boundary for every combination of facts."""
    c = {k: F.col(k) for k in OWNERS[1]}
    owner = ladders.ownership(*[c[k] for k in ("exported", "reexported", "entry_surface", "boundary", "internal", "entry", "usage", "ui")])
    o = _rows(spark, OWNERS).withColumn("owner", owner)
    api = ladders.api_boundary(F.col("owner"), *[c[k] for k in ("exported", "entry_surface", "boundary", "usage", "ui")], F.col("pages").cast("int"))
    return o.select("id", "owner", api.alias("api"))


_SURFACES = ["content", "symbols", "imports", "exports", "uiStructure", "uiProps", "uiRendering", "uiStyling", "patterns"]
CHANGES = _table({k: 2 for k in [*_SURFACES, "relations", "tsx"]})
_NAMED = {"symbols": "symbolSurfaceChanged", "imports": "importsChanged", "exports": "exportsChanged", "uiStructure": "uiStructureChanged", "uiProps": "uiPropsChanged", "uiRendering": "uiRenderingChanged", "uiStyling": "uiStylingChanged", "patterns": "patternRelevantChanged"}


@query(
    f"""WITH {_sql(CHANGES)}, u AS (SELECT *, NOT relations OR (content AND NOT ({' OR '.join(_SURFACES[1:])})) AS unk FROM t),
s AS (SELECT *, list_sort(list_filter([{', '.join(f"CASE WHEN {k} THEN '{v}' END" for k, v in _NAMED.items())}, CASE WHEN imports OR exports THEN 'graphRelevantChanged' END, CASE WHEN exports THEN 'likelyApiBoundaryChanged' END, CASE WHEN unk THEN 'unknownStructuralChange' END, CASE WHEN content THEN 'contentChanged' ELSE 'metadataOnlyChanged' END], lambda x: x IS NOT NULL)) AS sg FROM u)
SELECT id, array_to_string(sg, ',') AS signals, array_to_string(list_sort(list_filter([CASE WHEN content THEN 'requiresSymbolReindex' END, CASE WHEN content THEN 'mayAffectSearchFreshness' END, CASE WHEN imports OR exports OR unk THEN 'requiresGraphRebuild' END,
  CASE WHEN uiStructure OR uiProps OR uiRendering OR uiStyling OR (unk AND tsx) THEN 'requiresUiRefresh' END, CASE WHEN patterns OR unk THEN 'requiresPatternRefresh' END, CASE WHEN imports OR exports THEN 'mayAffectDependents' END, CASE WHEN unk THEN 'highRiskStructuralChange' END], lambda x: x IS NOT NULL)), ',') AS hints FROM s"""
)
def change_signals(spark, d):
    """Signals and hints of modified files for every combination of surfaces that differ."""
    s = ladders.modified_signals({k: F.col(k) for k in _SURFACES}, F.col("relations"))
    r = _rows(spark, CHANGES).withColumn("_s", s)
    return r.select("id", F.array_join("_s", ",").alias("signals"), F.array_join(ladders.modified_hints(F.col("_s"), F.col("tsx")), ",").alias("hints"))


_MARKER = ["ok", "missing", "malformed"]
FRESHNESS = _table({"request": _MARKER, "asked": 3, "mine": 2, "history": 2, "snapshot": _MARKER, "outcome": ["ready", "failed", "running"], "refreshed": 3, "equal": 2})


@query(
    f"""WITH {_sql(FRESHNESS)}, f AS (SELECT id, request, CASE WHEN asked > 0 AND request = 'ok' THEN asked END AS at0, mine, CASE WHEN history THEN 1 END AS hist, snapshot, CASE WHEN snapshot = 'ok' THEN outcome END AS outcome, CASE WHEN refreshed > 0 THEN refreshed END AS done, equal FROM t),
g AS (SELECT *, CASE WHEN mine THEN at0 END AS own_at FROM f)
SELECT id, CASE WHEN request = 'ok' AND snapshot = 'ok' THEN CASE WHEN outcome = 'failed' AND own_at IS NOT NULL AND done IS NOT NULL AND done >= own_at THEN 'failed' WHEN outcome = 'ready' THEN CASE WHEN equal THEN 'ready' ELSE 'stale' END WHEN own_at IS NOT NULL THEN 'pending' ELSE 'unknown' END
  WHEN snapshot = 'ok' AND outcome = 'failed' THEN 'failed' WHEN request = 'ok' OR at0 IS NOT NULL OR hist IS NOT NULL THEN 'pending' WHEN snapshot = 'ok' THEN 'stale' ELSE 'unknown' END AS state FROM g"""
)
def search_freshness(spark, d):
    """The search index's state for every combination of markers."""
    r = _rows(spark, FRESHNESS)
    at = F.when((F.col("asked") > 0) & (F.col("request") == "ok"), F.col("asked"))
    state = ladders.search_freshness(F.col("request"), at, F.col("mine"), F.when(F.col("history"), 1), F.col("snapshot"), F.when(F.col("snapshot") == "ok", F.col("outcome")), F.when(F.col("refreshed") > 0, F.col("refreshed")), F.col("equal"))
    return r.select("id", state.alias("state"))


_N = {"eligible": [0, 9, 10, 20, 25, 40], "patterns": [0, 2, 3, 60], "bearing": [0, 2, 30], "previous": [None, 24, 25, 50, 600], "changed": [0, 10, 11]}
INTEGRITY = _table({**{k: [None if v is None else str(v) for v in vs] for k, vs in _N.items()}, "trusted": 2, "artifact": [None, "ok", "malformed"]})
_INT = ", ".join(f"CAST({k} AS INT) AS {k}" for k in _N)


@query(
    f"""WITH {_sql(INTEGRITY)}, n AS (SELECT id, {_INT}, trusted, artifact FROM t),
c AS (SELECT id, [CASE WHEN artifact IS NOT NULL AND artifact <> 'ok' THEN 'previous-pattern-artifact-untrusted' END, CASE WHEN eligible >= 25 AND patterns <= 2 THEN 'pattern-output-catastrophically-incomplete' END,
  CASE WHEN trusted AND previous IS NOT NULL AND previous >= 25 AND patterns <= greatest(2, floor(previous * 0.1)) AND eligible >= 10 AND changed <= greatest(10, floor(eligible * 0.25)) THEN 'pattern-count-catastrophic-regression' END,
  CASE WHEN trusted AND previous IS NOT NULL AND previous >= 50 AND bearing <= 2 AND eligible >= 20 THEN 'pattern-bearing-files-collapse' END, CASE WHEN eligible >= 10 AND patterns = 0 AND previous IS NULL THEN 'pattern-output-empty' END] AS cs FROM n)
SELECT id, CASE WHEN cs[2] IS NOT NULL OR cs[3] IS NOT NULL OR cs[4] IS NOT NULL THEN 'failed' WHEN cs[1] IS NOT NULL OR cs[5] IS NOT NULL THEN 'degraded' ELSE 'trusted' END AS status, array_to_string(list_filter(cs, lambda x: x IS NOT NULL), ',') AS codes FROM c"""
)
def integrity_codes(spark, d):
    """Status and issues of a pattern index for combinations of its counts."""
    r = _rows(spark, INTEGRITY).withColumns({k: F.col(k).cast("int") for k in _N})
    s = ladders.pattern_integrity(*[F.col(k) for k in (*_N, "trusted", "artifact")])
    return r.select("id", s.alias("s")).select("id", "s.status", F.array_join("s.codes", ",").alias("codes"))


_ART_DIRS = ["", "src/components/", "src/hooks/", "src/utils/", "app/x/", "pages/api/", "src/__tests__/", "src/stories/", "web/mocks/", "web/wrappers/", "web/server/", "web/clients/", "src/services/"]
_ART_NAMES = ["index.ts", "page.tsx", "Order.test.ts", "order.stories.tsx", "useOrder.ts", "route.ts", "OrderProvider.tsx", "AppShell.tsx", "Card.tsx", "item.mock.ts", "errorDecorator.ts", "layout.jsx"]
FILES_OF = _table({"dir": _ART_DIRS, "name": _ART_NAMES, "symbol": ["loadOrder", "OrderCard", "useOrder", "OrderStore"]})


@query(
    rf"""WITH {_sql(FILES_OF)}, p AS (SELECT *, dir || name AS path, lower(dir || name) AS low, lower(name) AS base FROM t),
r AS (SELECT *, CASE WHEN regexp_matches(low, '(\.|/)(stories|story)\.(tsx?|jsx?)$') THEN 'story' WHEN regexp_matches(low, '(\.|/)(test|spec)\.(tsx?|jsx?)$') THEN 'test' WHEN regexp_matches(low, '(\.|/)(page|layout)\.(tsx?|jsx?)$') THEN 'page'
  WHEN regexp_matches(low, '(\.|/)route\.(tsx?|jsx?)$') OR starts_with(low, 'pages/api/') THEN 'handler' WHEN symbol = 'useOrder' OR contains(low, '/hooks/') OR starts_with(base, 'use') THEN 'hook'
  WHEN contains(low, '/components/') OR (regexp_matches(low, '\.[tj]sx$') AND symbol IN ('OrderCard', 'OrderStore')) THEN 'component' WHEN regexp_matches(low, '/(utils|helpers|services)/') THEN 'utility' ELSE 'module' END AS role FROM p),
c AS (SELECT *, CASE WHEN contains(low, '__tests__/') OR regexp_matches(low, '(\.|/)(test|spec)\.(tsx?|jsx?)$') THEN 'test_artifact' WHEN role = 'story' OR regexp_matches(low, '(^|/)(stories|storybook)/') THEN 'story_artifact' WHEN contains(low, '/mocks/') OR regexp_matches(low, '\.(mock|fixture)\.(tsx?|jsx?)$') THEN 'mock_or_fixture_artifact'
  WHEN contains(low, '/wrappers/') OR regexp_matches(low, '(decorator|wrapper)\.(tsx?|jsx?)$') THEN 'support_or_wrapper_artifact' WHEN role IN ('story', 'test') THEN 'unknown' WHEN role = 'utility' THEN 'runtime_util' ELSE 'runtime_' || role END AS artifact,
  symbol = 'OrderStore' AS state, name = 'layout.jsx' AS wrap FROM r)
SELECT path, symbol, role, artifact, CASE WHEN artifact IN ('test_artifact', 'story_artifact', 'support_or_wrapper_artifact') THEN 'support_runtime' WHEN role = 'handler' THEN 'api_or_handler'
  WHEN role = 'page' THEN CASE WHEN regexp_matches(low, '/app/|/pages/|/screen') OR base IN ('page.tsx', 'page.jsx') THEN 'routed_page_or_screen' ELSE 'page' END WHEN state THEN CASE WHEN role = 'hook' THEN 'hook_or_context' ELSE 'state_or_store' END
  WHEN role = 'hook' THEN 'hook_or_context' WHEN role = 'component' THEN CASE WHEN wrap THEN 'ui_wrapper_or_shell' ELSE 'ui_component' END WHEN role = 'utility' THEN 'util_or_helper' WHEN regexp_matches(low, '/api/|/server/|/actions/') THEN 'api_or_handler' WHEN wrap THEN 'ui_wrapper_or_shell' ELSE 'module_or_integration' END AS family FROM c"""
)
def file_artifacts(spark, d):
    """Responsibility, artifact class and family of files by path and symbol."""
    p, names = F.concat("dir", "name"), F.array("symbol")
    r = _rows(spark, FILES_OF).select(p.alias("path"), "symbol", artifacts.responsibility(p, names).alias("role"))
    r = r.withColumn("artifact", artifacts.artifact(F.col("path"), F.col("role")))
    return r.withColumn("family", artifacts.file_family(F.col("path"), F.array("symbol"), F.col("role"), F.col("artifact")))


MATCHES = _table({
    "alignment": ["1.0", "0.6", "0.2"], "dependency": ["0.0", "0.1", "0.15", "0.3", "0.4"], "role": ["1.0", "0.4", "0.35", "0.2", "0.0"], "heuristic": ["0.1", "0.22", "0.5"], "target": ["runtime_page", "test_artifact"],
    "candidate": ["runtime_hook", "test_artifact", "story_artifact", "mock_or_fixture_artifact", "support_or_wrapper_artifact", "unknown"], "fit": ["1.0", "0.55", "0.0"], "useful": ["0.0", "0.75"], "hint": ["export", "path", None],
})
_DBL = ["alignment", "dependency", "role", "heuristic", "fit", "useful"]
_E = lambda x: f"CAST({x} AS DOUBLE)"
_RND = lambda x: f"floor(({x}) * 1000 + {_E(0.5)}) / 1000"


@query(
    f"""WITH {_sql(MATCHES)}, n AS (SELECT id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _DBL)}, starts_with(target, 'runtime_') AS run, starts_with(candidate, 'runtime_') AS other, candidate, hint FROM t),
s AS (SELECT *, {_RND(f"alignment * {_E(0.4)} + dependency * {_E(0.3)} + role * {_E(0.2)} + heuristic * {_E(0.1)}")} AS base, CASE candidate WHEN 'test_artifact' THEN {_E(0.18)} WHEN 'story_artifact' THEN {_E(0.16)} WHEN 'mock_or_fixture_artifact' THEN {_E(0.2)} WHEN 'support_or_wrapper_artifact' THEN {_E(0.12)} WHEN 'unknown' THEN {_E(0.08)} ELSE 0 END AS penalty FROM n),
e AS (SELECT *, CASE WHEN run AND other THEN CASE WHEN role = 1 THEN {_E(0.12)} WHEN role >= 0.4 THEN {_E(0.04)} ELSE {_E(0)} END + {_RND(f"fit * {_E(0.08)}")} + {_RND(f"useful * {_E(0.08)}")} ELSE {_E(0)} END AS extra, CASE WHEN alignment <= 0.6 AND dependency < 0.2 AND role < 0.4 AND heuristic < 0.25 THEN {_E(0.08)} ELSE {_E(0)} END AS weak FROM s),
f AS (SELECT *, {_RND(f"greatest({_E(0)}, base + extra - CASE WHEN run AND NOT other THEN penalty ELSE {_E(0)} END - weak)")} AS score FROM e)
SELECT id, score, CASE WHEN run AND other AND fit > 0 AND alignment >= 0.6 AND dependency > 0 THEN 'peer page precedent with shared dependencies' WHEN run AND other AND fit > 0 AND useful > 0 THEN 'peer page precedent' WHEN run AND other AND useful > 0 AND alignment >= 0.6 THEN 'more directly reusable runtime implementation'
  WHEN alignment >= 0.6 AND dependency > 0 AND run AND other AND role >= 0.4 THEN 'runtime precedent with shared dependencies' WHEN alignment >= 1 AND dependency > 0 AND role > 0 THEN 'shared dependencies + same responsibility + high structural alignment' WHEN alignment >= 0.6 AND dependency > 0 THEN 'shared dependencies + strong structural alignment'
  WHEN alignment >= 0.6 AND role > 0 THEN 'same responsibility + strong structural alignment' WHEN alignment >= 0.6 THEN 'strong structural alignment' WHEN dependency > 0 THEN 'shared dependency context' WHEN role > 0 THEN 'same responsibility' WHEN run AND NOT other THEN 'runtime precedent favored over artifact match'
  WHEN hint = 'export' THEN 'similar export surface' WHEN hint = 'path' THEN 'same directory family' ELSE 'heuristic pattern match' END AS reason FROM f
WHERE score > 0 AND NOT (alignment <= 0.2 AND dependency < 0.12 AND role < 0.2 AND heuristic < 0.2) AND NOT (run AND NOT other AND alignment <= 0.6 AND dependency < 0.18 AND role < 1 AND heuristic < 0.25)"""
)
def pattern_match(spark, d):
    """Scores and reasons of candidate files for combinations of their evidence; those that are too weak are left out."""
    r = _rows(spark, MATCHES).withColumns({c: F.col(c).cast("double") for c in _DBL})
    c = {k: F.col(k) for k in MATCHES[1]}
    score = artifacts.match_score(*[c[k] for k in ("alignment", "dependency", "role", "heuristic", "target", "candidate", "fit", "useful")])
    reason = artifacts.match_reason(*[c[k] for k in ("alignment", "dependency", "role", "target", "candidate", "fit", "useful")], F.lit("page"), c["hint"])
    return r.select("id", score.alias("score"), reason.alias("reason")).where("score is not null")
