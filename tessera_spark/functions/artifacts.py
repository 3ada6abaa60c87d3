"""What a file is there for, and how well it would serve as a pattern for another. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ladders import MODULE_DIRS, SERVER_DIRS, STATE_WORDS, WRAPPER_WORDS
from .text import round3

CODE = r"\.(tsx?|jsx?)$"
# Patterns of paths that tell artifacts and responsibilities, in order; fits of families; similarity of responsibilities; penalties.
ARTIFACTS = (
    ("test_artifact", rf"(^|/)__tests__(/|$)|(\.|/)(test|spec){CODE}"), ("story_artifact", rf"(\.|/)(stories|story){CODE}|(^|/)(stories|storybook)(/|$)"),
    ("mock_or_fixture_artifact", rf"(^|/)(__mocks__|__fixtures__|fixtures?|mocks?|samples?)(/|$)|\.(mock|fixture){CODE}"),
    ("support_or_wrapper_artifact", rf"(^|/)(storybook|decorators?|wrappers?|preview|playground)(/|$)|(decorator|wrapper){CODE}"),
)
RUNTIME = {"component": "runtime_component", "page": "runtime_page", "hook": "runtime_hook", "utility": "runtime_util", "handler": "runtime_handler", "module": "runtime_module"}
FITS = {
    ("page", "routed_page_or_screen"): 0.9, ("hook_or_context", "state_or_store"): 0.85, ("ui_component", "ui_wrapper_or_shell"): 0.55,
    ("util_or_helper", "module_or_integration"): 0.35, ("api_or_handler", "module_or_integration"): 0.45,
}
NEAR_ROLES = {("page", "component"): 0.4, ("utility", "handler"): 0.35, ("component", "hook"): 0.2}
PENALTIES = {"test_artifact": 0.18, "story_artifact": 0.16, "mock_or_fixture_artifact": 0.2, "support_or_wrapper_artifact": 0.12, "unknown": 0.08}


def _symmetric(a: Column, b: Column, table: dict[tuple[str, str], float]) -> Column:
    out = F.when(a == b, 1.0)
    for pair, score in table.items():
        out = out.when(a.isin(*pair) & b.isin(*pair), score)
    return out.otherwise(0.0)


def responsibility(path: Column, names: Column) -> Column:
    """story, test, page, handler, hook, component, utility or module, the first that a path or its symbols' names show."""
    low = F.lower(path)
    named = lambda pattern: F.exists(names, lambda n: n.rlike(pattern))
    base = F.substring_index(low, "/", -1)
    return (
        F.when(low.rlike(rf"(\.|/)(stories|story){CODE}"), "story").when(low.rlike(rf"(\.|/)(test|spec){CODE}"), "test").when(low.rlike(rf"(\.|/)(page|layout){CODE}"), "page")
        .when(low.rlike(rf"(\.|/)route{CODE}|^pages/api/"), "handler").when(named("^use[A-Z0-9_]") | low.contains("/hooks/") | base.startswith("use"), "hook")
        .when(low.contains("/components/") | (low.rlike(r"\.[tj]sx$") & named("^[A-Z]")), "component").when(low.rlike("/(utils|helpers|services)/"), "utility").otherwise("module")
    )


def artifact(path: Column, role: Column) -> Column:
    """Tests, stories, fixtures and wrappers by path; the rest is runtime code by its responsibility."""
    low = F.lower(path)
    out = F.lit("unknown")
    for kind, name in RUNTIME.items():
        out = F.when(role == kind, name).otherwise(out)
    for name, pattern in reversed(ARTIFACTS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def file_family(path: Column, names: Column, role: Column, kind: Column) -> Column:
    """The precedent family of a file, as a file's pattern match sees it (a pattern's own family can differ)."""
    low = F.lower(path)
    base = F.substring_index(low, "/", -1)
    words = lambda c: F.filter(F.split(F.lower(F.regexp_replace(F.regexp_replace(c, r"\.[^.]+$", ""), "([a-z0-9])([A-Z])", "$1 $2")), "[^a-z0-9]+"), lambda w: w != "")
    every = F.concat(words(base), F.flatten(F.transform(names, words)))
    said = lambda ws: F.arrays_overlap(every, F.array(*[F.lit(w) for w in ws]))
    state, wrapper = said(STATE_WORDS), said(WRAPPER_WORDS)
    routed = low.rlike("/app/|/pages/|/screen") | base.isin("page.tsx", "page.jsx", "screen.tsx", "screen.jsx")
    return (
        F.when(kind.isin("test_artifact", "story_artifact", "support_or_wrapper_artifact"), "support_runtime").when(role == "handler", "api_or_handler")
        .when(role == "page", F.when(routed, "routed_page_or_screen").otherwise("page")).when(state, F.when(role == "hook", "hook_or_context").otherwise("state_or_store"))
        .when(role == "hook", "hook_or_context").when(role == "component", F.when(wrapper, "ui_wrapper_or_shell").otherwise("ui_component")).when(role == "utility", "util_or_helper")
        .when(low.rlike("|".join(SERVER_DIRS)), "api_or_handler").when(wrapper, "ui_wrapper_or_shell").when(low.rlike("|".join(MODULE_DIRS)), "module_or_integration").otherwise("module_or_integration")
    )


def family_fit(a: Column, b: Column) -> Column:
    return _symmetric(a, b, FITS)


def role_likeness(a: Column, b: Column) -> Column:
    return _symmetric(a, b, NEAR_ROLES)


def expected_export(family: Column, names: Column) -> Column:
    """Whether names has one that a file of a family would export."""
    named = lambda pattern: F.exists(names, lambda n: n.rlike(pattern))
    return (
        F.when(family.isin("ui_component", "ui_wrapper_or_shell", "page", "routed_page_or_screen"), named("^[A-Z]")).when(family == "hook_or_context", named("^use[A-Z0-9_]|(Context|Provider)$"))
        .when(family == "state_or_store", named("(Store|Context|Provider|State|Reducer|Slice)$")).when(family.isin("util_or_helper", "api_or_handler", "module_or_integration"), named("^[a-z]")).otherwise(F.size(names) > 0)
    )


def usefulness(target: Column, candidate: Column, kind: Column, fit: Column, dependency: Column, exports: Column) -> Column:
    """How directly a candidate file can be reused as an implementation, 0 to 1."""
    by_fit = F.when(fit >= 1, 0.55).when(fit >= 0.8, 0.4).when(fit >= 0.5, 0.22).when(fit > 0, 0.1).otherwise(0.0)
    yes = lambda c, v: F.when(c, v).otherwise(0.0)
    visible = target.isin("ui_component", "page", "routed_page_or_screen", "hook_or_context", "state_or_store")
    s = by_fit + yes(exports, 0.2) + yes(kind.startswith("runtime_"), 0.1) + yes(dependency >= 0.35, 0.1) - yes(candidate == "ui_wrapper_or_shell", 0.25) - yes(candidate == "support_runtime", 0.2)
    return F.least(F.greatest(s - yes(visible & (candidate == "module_or_integration"), 0.2), F.lit(0.0)), F.lit(1.0))


def match_score(alignment: Column, dependency: Column, role: Column, heuristic: Column, target: Column, candidate: Column, fit: Column, useful: Column) -> Column:
    """Score of a candidate file as a pattern for a target, or null where its evidence is too weak to show.

    alignment is 1, 0.6 or 0.2; role the likeness of responsibilities; target and candidate are artifact classes.
    """
    run, other = target.startswith("runtime_"), candidate.startswith("runtime_")
    both = run & other
    penalty = F.lit(0.0)
    for kind, p in PENALTIES.items():
        penalty = F.when(candidate == kind, p).otherwise(penalty)
    base = round3(alignment * 0.4 + dependency * 0.3 + role * 0.2 + heuristic * 0.1)
    extra = F.when(both, F.when(role == 1, 0.12).when(role >= 0.4, 0.04).otherwise(0.0)).otherwise(0.0) + F.when(both, round3(fit * 0.08)).otherwise(0.0) + F.when(both, round3(useful * 0.08)).otherwise(0.0)
    weak = F.when((alignment <= 0.6) & (dependency < 0.2) & (role < 0.4) & (heuristic < 0.25), 0.08).otherwise(0.0)
    score = round3(F.greatest(F.lit(0.0), base + extra - F.when(run & ~other, penalty).otherwise(0.0) - weak))
    hidden = ((alignment <= 0.2) & (dependency < 0.12) & (role < 0.2) & (heuristic < 0.2)) | (run & ~other & (alignment <= 0.6) & (dependency < 0.18) & (role < 1) & (heuristic < 0.25))
    return F.when(~hidden & (score > 0), score)


def match_reason(alignment: Column, dependency: Column, role: Column, target: Column, candidate: Column, fit: Column, useful: Column, label: Column, hint: Column) -> Column:
    """Why a candidate was chosen, the first that holds. hint is the strongest of the plain signals: export, bundle, naming, path or null."""
    run, other = target.startswith("runtime_"), candidate.startswith("runtime_")
    both = run & other
    high, strong, shares, same = alignment >= 1, alignment >= 0.6, dependency > 0, role > 0
    family, use, bonus = both & (round3(fit * 0.08) > 0), both & (round3(useful * 0.08) > 0), both & ((role == 1) | (role >= 0.4))
    peer = F.concat(F.lit("peer "), label, F.lit(" precedent"))
    out = (
        F.when(family & strong & shares, F.concat(peer, F.lit(" with shared dependencies"))).when(family & use, peer).when(use & strong, "more directly reusable runtime implementation")
        .when(strong & shares & bonus, "runtime precedent with shared dependencies").when(high & shares & same, "shared dependencies + same responsibility + high structural alignment")
        .when(strong & shares, "shared dependencies + strong structural alignment").when(strong & same, "same responsibility + strong structural alignment").when(strong, "strong structural alignment")
        .when(shares, "shared dependency context").when(same, "same responsibility").when(run & ~other, "runtime precedent favored over artifact match")
    )
    for name, reason in (("export", "similar export surface"), ("bundle", "similar file bundle"), ("naming", "similar naming family"), ("path", "same directory family")):
        out = out.when(hint == name, reason)
    return out.otherwise("heuristic pattern match")
