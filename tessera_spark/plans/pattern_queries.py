"""Fingerprint similarity, clusters and precedents over patterns of all kinds, roles and families."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import patterns
from ..sources import scratch
from . import corpus as C
from .registry import query


def _pick(values: str, by: str) -> str:
    """The value at `by` of a list of words, in SQL that both engines read."""
    words = values.split()
    return f"CASE {by} % {len(words)} " + " ".join(f"WHEN {i} THEN '{w}'" for i, w in enumerate(words)) + " END"


def _some(*parts: tuple[str, str]) -> str:
    """A comma-separated set of the words whose conditions hold."""
    return " || ".join(f"CASE WHEN {cond} THEN '{word},' ELSE '' END" for word, cond in parts)


_THIRD, _HALF = "CAST(floor(k / 3) AS INT)", "CAST(floor(k / 2) AS INT)"
#: One pattern per supplier, by rule from its number k: half are components, the rest of every other kind.
SCALARS = {
    "pattern_id": "'s' || CAST(k AS STRING)",
    "kind": "CASE WHEN k % 2 = 0 THEN 'component' ELSE "
    + _pick("hook async-data-flow list-rendering conditional-rendering form-handling api-handler utility-export test-suite storybook-story service-layer data-access", _HALF) + " END",
    "repo_id": _pick("web admin", _THIRD),
    "file_id": f"'f' || CAST({_THIRD} AS STRING)",
    "name": "(" + _pick("Order User Cart Search", _HALF) + ") || (" + _pick("Button Card List Page Panel", "k") + ")",
    "export_shape": _pick("named default mixed none internal unknown named named", _THIRD),
    "role": "CASE WHEN k % 2 = 0 AND k % 10 < 8 THEN 'component' ELSE " + _pick("module component hook handler utility test story unknown", _HALF) + " END",
    "family": "CASE WHEN k % 28 = 0 THEN 'page' WHEN k % 22 = 0 THEN 'routed_page_or_screen' WHEN k % 2 = 0 THEN 'ui_component' ELSE "
    + _pick("hook_or_context state_or_store util_or_helper api_or_handler module_or_integration support_runtime ui_wrapper_or_shell", _HALF) + " END",
    "indexed": "CASE WHEN k % 13 = 0 THEN false WHEN k % 17 = 0 THEN CAST(NULL AS BOOLEAN) ELSE true END",
}
LISTS = {
    "structural": _some(("jsx-return", "k % 2 = 0 OR k % 7 = 0"), ("react-function-component", "k % 2 = 0"), ("uses-hooks", "k % 3 < 2"), ("conditional-render", "k % 5 = 0"), ("named-export", "k % 2 = 1"), ("async-function", "k % 9 = 1")),
    "imports": _some(("react", "k % 5 < 4"), ("lodash", "k % 8 = 0"), ("axios", "k % 6 = 1")),
    "ui": _some(("jsx-return", "k % 2 = 0"), ("list", "k % 12 = 0")),
    "async_": _some(("fetch", "k % 9 = 0"), ("await", "k % 11 = 0")),
    "responsibility": _some(("save", "k % 5 = 1 OR k % 5 = 2"), ("load", "k % 5 = 2")),
    "deps": _some(*[(f"d{i}", f"k % 6 = {i}") for i in range(6)], ("d8", "k % 8 = 0"), ("d9", "k % 9 = 0")),
    "dep_tokens": _some(("ui", "k % 4 < 3"), *[(t, f"k % 6 = {i}") for i, t in enumerate("billing orders search tax users zones".split())]),
}


def rows(spark, d) -> DataFrame:
    """Rows of operators.patterns with k, one per supplier."""
    df = C.table(spark, d, "supplier").selectExpr("CAST(s_suppkey AS INT) AS k").repartition(spark.sparkContext.defaultParallelism)  # a small file is one task
    df = df.selectExpr("k", *[f"{e} AS {n}" for n, e in (SCALARS | LISTS).items()])
    return df.select("k", *SCALARS, *[F.array_remove(F.split(n, ","), "").alias(n) for n in LISTS], F.lit("high").alias("confidence"))


_N = lambda x: f"CAST({x} AS DOUBLE)"


def _jac(c: str, empty: float, either: bool = False) -> str:
    a, b = f"x.{c}", f"y.{c}"
    guard = f"WHEN len({a}) = 0 OR len({b}) = 0 THEN {_N(0)}" if either else f"WHEN len({a}) + len({b}) = 0 THEN {_N(empty)}"
    return f"CASE {guard} ELSE CAST(len(list_intersect({a}, {b})) AS DOUBLE) / len(list_distinct(list_concat({a}, {b}))) END"


_FAM = lambda a, b: f"CASE WHEN {a} = {b} THEN {_N(1)} WHEN {a} IN ('page', 'routed_page_or_screen') AND {b} IN ('page', 'routed_page_or_screen') OR {a} IN ('hook_or_context', 'state_or_store') AND {b} IN ('hook_or_context', 'state_or_store') THEN {_N(0.85)} ELSE {_N(0)} END"
_ALIGN = lambda s: f"CASE WHEN {s}.indexed IS NULL THEN {_N(0.6)} WHEN NOT {s}.indexed THEN {_N(0.2)} WHEN len({s}.deps) > 0 THEN {_N(1)} WHEN len({s}.dep_tokens) > 0 THEN {_N(0.8)} ELSE {_N(0.6)} END"
_FACTOR = lambda s: f"least(greatest({_N(1)} + CASE WHEN {s}.export_shape IN ('named', 'default', 'mixed') THEN {_N(0.05)} WHEN {s}.export_shape IN ('none', 'internal') THEN {_N(-0.05)} ELSE {_N(0)} END + CASE WHEN len({s}.structural) >= 3 THEN {_N(0.03)} WHEN len({s}.structural) <= 1 THEN {_N(-0.08)} ELSE {_N(0)} END, {_N(0.85)}), {_N(1.08)})"
_R3 = lambda x: f"floor(({x}) * 1000 + {_N(0.5)}) / 1000"
_TOKENS = lambda s: rf"string_split(lower(regexp_replace({s}.name, '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' ')"
_PARTS = [("s", 0.3), ("im", 0.2), ("ex", 0.1), ("ro", 0.1), ("fa", 0.12)]
_OPTIONAL = [("ui", "ui", 0.05), ("a_", "async_", 0.05), ("re", "responsibility", 0.1), ("de", "deps", 0.12), ("dt", "dep_tokens", 0.12)]
_TOTAL = " + ".join([_N(0.2), *[f"{n} * {_N(w)}" for n, w in _PARTS], *[f"CASE WHEN has_{n} THEN {n} * {_N(w)} ELSE 0 END" for n, _, w in _OPTIONAL]])
_WEIGHT = " + ".join([_N(0.2), *[_N(w) for _, w in _PARTS], *[f"CASE WHEN has_{n} THEN {_N(w)} ELSE {_N(0)} END" for n, _, w in _OPTIONAL]])
#: The same rows and rules in SQL: fp (rows), j (scored pairs a < b of one kind, with the gate).
FP = f"""fp AS (SELECT k, {', '.join(f'{e} AS {n}' for n, e in SCALARS.items())}, {', '.join(f"list_filter(string_split({e}, ','), lambda v: v <> '') AS {n}" for n, e in LISTS.items())} FROM (SELECT CAST(s_suppkey AS INT) AS k FROM supplier)),
m AS (SELECT x.pattern_id AS a, y.pattern_id AS b, x.kind, x.file_id = y.file_id AS same_file, {_jac('structural', 1)} AS s, {_jac('imports', 1)} AS im,
    CASE WHEN x.export_shape = y.export_shape THEN {_N(1)} WHEN x.export_shape IN ('named', 'default', 'mixed') AND y.export_shape IN ('named', 'default', 'mixed') THEN {_N(0.5)} WHEN x.export_shape IN ('none', 'internal') AND y.export_shape IN ('none', 'internal') THEN {_N(0.5)} WHEN x.export_shape = 'unknown' OR y.export_shape = 'unknown' THEN {_N(0.25)} ELSE {_N(0)} END AS ex,
    CASE WHEN x.role = y.role THEN {_N(1)} WHEN x.role IN ('component', 'hook') AND y.role IN ('component', 'hook') OR x.role IN ('utility', 'module', 'handler') AND y.role IN ('utility', 'module', 'handler') OR x.role IN ('story', 'test') AND y.role IN ('story', 'test') THEN {_N(0.45)} WHEN x.role = 'unknown' OR y.role = 'unknown' THEN {_N(0.25)} ELSE {_N(0)} END AS ro,
    {_FAM('x.family', 'y.family')} AS fa, {', '.join(f"{_jac(c, 0)} AS {n}, len(x.{c}) + len(y.{c}) > 0 AS has_{n}" for n, c, _ in _OPTIONAL)}, {_jac('responsibility', 1)} AS r1,
    len(x.responsibility) > 0 AND len(y.responsibility) > 0 AS both_r, {_jac('imports', 0, True)} AS ic, {_jac('deps', 0, True)} AS dc, {_jac('dep_tokens', 0, True)} AS tc, {_jac('responsibility', 0, True)} AS rc, {_jac('ui', 0, True)} AS uc, {_jac('async_', 0, True)} AS ac,
    least(len(x.structural), len(y.structural)) AS fewest, len(list_intersect(x.structural, y.structural)) AS shared, ({_FACTOR('x')} + {_FACTOR('y')}) / {_N(2)} AS factor, least({_ALIGN('x')}, {_ALIGN('y')}) AS al, {_TOKENS('x')} AS t1, {_TOKENS('y')} AS t2
  FROM fp x JOIN fp y ON x.kind = y.kind AND x.pattern_id < y.pattern_id),
n AS (SELECT *, CASE WHEN kind IN ('component', 'hook', 'async-data-flow', 'utility-export') THEN least(greatest({_R3(f"CAST(len(list_intersect(t1, t2)) AS DOUBLE) / len(list_distinct(list_concat(t1, t2))) + CAST(CASE WHEN t1[1] = t2[1] THEN CASE WHEN t1[2] = t2[2] THEN 2 ELSE 1 END ELSE 0 END AS DOUBLE) / 2 * {_N(0.15)} + CAST(CASE WHEN t1[2] = t2[2] THEN CASE WHEN t1[1] = t2[1] THEN 2 ELSE 1 END ELSE 0 END AS DOUBLE) / 2 * {_N(0.15)}")}, 0), 1) ELSE {_N(0)} END AS nm,
    greatest(dc, {_N(0.8)} * tc, {_N(0.45)} * ic) AS dep, kind IN ('component', 'hook', 'async-data-flow') AS broad, kind IN ('component', 'hook', 'async-data-flow', 'utility-export') AS named,
    ({_TOTAL}) / ({_WEIGHT}) * CASE WHEN shared = 0 THEN {_N(0.25)} WHEN fewest <= 1 THEN {_N(0.85)} ELSE {_N(1)} END * CASE WHEN fa = 0 THEN {_N(0.72)} ELSE {_N(1)} END AS s0 FROM m),
o AS (SELECT *, CASE WHEN broad AND s < 0.5 THEN least(s0, {_N(0.6)}) ELSE s0 END * factor * CASE WHEN fewest <= 1 THEN {_N(0.9)} ELSE {_N(1)} END AS s1 FROM n),
j AS (SELECT *, {_R3(f"least(greatest(CASE WHEN named THEN {_N(0.85)} * s1 + {_N(0.15)} * nm ELSE s1 END * CASE WHEN nm > 0.6 THEN {_N(1.05)} ELSE {_N(1)} END * CASE WHEN r1 > 0 THEN {_N(1)} + least({_N(0.08)}, {_N(0.08)} * r1) WHEN both_r THEN {_N(0.88)} ELSE {_N(1)} END, 0), 1)")} AS score FROM o),
g AS (SELECT *, score >= 0.7 AND fa > 0 AND shared > 0 AND NOT (broad AND s < 0.5) AND NOT (al <= 0.2 AND dep < 0.18) AND NOT (dep < 0.18 AND ic < 0.45 AND rc < 0.55 AND uc = 0 AND ac = 0)
    AND NOT (fa < 1 AND dep < 0.34 AND rc < 0.55) AND NOT (broad AND dep < 0.18 AND ic < 0.45 AND nm < 0.2) AS passes FROM j)"""


@query(f"WITH {FP} SELECT a, b, score, passes FROM g")
def pattern_similarity(spark, d):
    """Scores of all pairs of a kind, and whether they pass the gate of clusters."""
    return patterns.scored_pairs(rows(spark, d), shared_signal=False, save=scratch.save, columns=("score", "passes"))


_TOP = f"""both_ AS (SELECT a AS pattern_id, b AS other, same_file, score FROM j UNION ALL SELECT b, a, same_file, score FROM j),
adj AS (SELECT pattern_id, other, {_R3(f"score * CASE WHEN same_file THEN {_N(0.9)} ELSE {_N(1)} END")} AS score FROM both_ WHERE score > 0),
top AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY score DESC, other) AS rank FROM adj)"""


def _top(spark, d, k: int) -> DataFrame:
    """The k patterns most like each one, those of its own file at nine tenths."""
    return patterns.most_similar(rows(spark, d), k, scratch.save)


@query(f"WITH {FP}, {_TOP} SELECT pattern_id, other, score, rank FROM top WHERE rank <= 6")
def similar_top_k(spark, d):
    """The six patterns most like each one."""
    return _top(spark, d, 6).select("pattern_id", "other", "score", "rank")


_PRECEDENT = f"""{_R3(f"least(greatest({_N(0.82)} * t.score + CASE WHEN y.export_shape IN ('named', 'default', 'mixed') THEN {_N(0.06)} ELSE {_N(0)} END + CASE WHEN x.file_id <> y.file_id THEN {_N(0.04)} ELSE {_N(0)} END + least({_N(0.04)}, {_N(0.01)} * (y.k % 7)) + least({_N(0.04)}, {_N(0.01)} * (y.k % 5)) + CASE WHEN NOT coalesce(y.indexed, false) OR len(y.deps) = 0 THEN {_N(0)} WHEN len(y.deps) >= 2 THEN {_N(0.04)} ELSE {_N(0.02)} END + {_N(0.05)} * {_jac('deps', 0)} + {_N(0.04)} * {_jac('dep_tokens', 0)} + {_N(0.05)} * {_jac('responsibility', 0)}, 0), 1)")}"""


@query(f"WITH {FP}, {_TOP} SELECT t.pattern_id, t.other, {_PRECEDENT} AS precedent_score, CASE WHEN {_PRECEDENT} >= 0.8 THEN 'high' WHEN {_PRECEDENT} >= 0.55 THEN 'medium' ELSE 'low' END AS strength FROM top t JOIN fp x ON x.pattern_id = t.pattern_id JOIN fp y ON y.pattern_id = t.other WHERE rank <= 20")
def precedents(spark, d):
    """The twenty patterns most like each one as precedents: similarity, export, use, anchors and what both have to do with."""
    p = rows(spark, d)
    t = _top(spark, d, 20).select(F.col("pattern_id").alias("_a"), F.col("other").alias("_b"), "score")
    j = t.join(p.alias("x"), F.col("_a") == F.col("x.pattern_id")).join(p.alias("y"), F.col("_b") == F.col("y.pattern_id"))
    anchored = F.when(~F.coalesce("y.indexed", F.lit(False)) | (F.size("y.deps") == 0), "none").when(F.size("y.deps") >= 2, "high").otherwise("medium")
    s = patterns.precedent_score(F.col("score"), usage=F.col("y.k") % 7, importers=F.col("y.k") % 5, anchored=anchored)
    return j.select(F.col("_a").alias("pattern_id"), F.col("_b").alias("other"), s.alias("precedent_score")).withColumn("strength", F.when(F.col("precedent_score") >= 0.8, "high").when(F.col("precedent_score") >= 0.55, "medium").otherwise("low"))


_CLUSTERS = f"""{FP}, l AS (SELECT a, b FROM g WHERE passes UNION SELECT b, a FROM g WHERE passes),
reach AS (SELECT pattern_id AS p, pattern_id AS q FROM fp UNION SELECT reach.p, l.b FROM reach JOIN l ON l.a = reach.q), comp AS (SELECT p AS pattern_id, min(q) AS cluster FROM reach GROUP BY p),
sc AS (SELECT a, b, score FROM g UNION ALL SELECT b, a, score FROM g), mem AS (SELECT c.pattern_id, c.cluster, fp.family AS own, len(fp.structural) AS ns, coalesce((SELECT {_R3('sum(sc.score)')} FROM sc JOIN comp e ON e.pattern_id = sc.b WHERE sc.a = c.pattern_id AND e.cluster = c.cluster), 0) AS total FROM comp c JOIN fp USING (pattern_id)),
rep AS (SELECT cluster, pattern_id AS representative FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY total DESC, ns DESC, pattern_id) AS r FROM mem) WHERE r = 1),
fam AS (SELECT cluster, own AS family FROM (SELECT cluster, own, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, own) AS r FROM mem GROUP BY cluster, own) WHERE r = 1),
sz AS (SELECT cluster, count(*) AS n FROM comp GROUP BY cluster),
cl AS (SELECT comp.pattern_id, comp.cluster, representative, fam.family, sz.n FROM comp JOIN rep USING (cluster) JOIN fam USING (cluster) JOIN sz USING (cluster)),
pm AS (SELECT a, b, score, dep, ic, rc, tc, al FROM g UNION ALL SELECT b, a, score, dep, ic, rc, tc, al FROM g)"""


@query(
    f"""WITH RECURSIVE {_CLUSTERS} SELECT cl.pattern_id, cl.cluster, representative, cl.family, cl.n,
CASE WHEN cl.pattern_id = representative OR ({_FAM('cl.family', 'fp.family')} > 0 AND pm.score >= 0.62 AND pm.al >= 0.6 AND (pm.dep >= 0.2 OR pm.ic >= 0.4 OR pm.rc >= 0.5)) THEN 'core' ELSE 'peripheral' END AS role
FROM cl JOIN fp ON fp.pattern_id = cl.pattern_id LEFT JOIN pm ON pm.a = representative AND pm.b = cl.pattern_id"""
)
def pattern_clusters(spark, d):
    """The clusters of all patterns, with their representatives, families and members' roles."""
    return patterns.clusters(rows(spark, d), scratch.save)


_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in patterns.LABELS.items())


@query(
    f"""WITH RECURSIVE {_CLUSTERS}, co AS (SELECT cl.cluster, count(*) AS n, {_R3(f"avg(CASE WHEN {_FAM('cl.family', 'fp.family')} > 0 THEN {_N(1)} ELSE {_N(0)} END)")} AS same_family_ratio, {_R3(f"coalesce(avg(pm.dep), {_N(1)})")} AS dependency_overlap, {_R3(f"avg({_ALIGN('fp')})")} AS structural_alignment
  FROM cl JOIN fp ON fp.pattern_id = cl.pattern_id LEFT JOIN pm ON pm.a = representative AND pm.b = cl.pattern_id GROUP BY cl.cluster),
tk AS (SELECT cluster, max(c) AS c FROM (SELECT cluster, t, count(*) AS c FROM (SELECT cl.cluster, unnest(fp.dep_tokens) AS t FROM cl JOIN fp USING (pattern_id)) GROUP BY cluster, t) GROUP BY cluster),
sg AS (SELECT cluster, string_agg(t, ',' ORDER BY r) AS dominant FROM (SELECT cluster, t, row_number() OVER (PARTITION BY cluster ORDER BY count(*) DESC, t) AS r FROM (SELECT cl.cluster, unnest(fp.structural) AS t FROM cl JOIN fp USING (pattern_id)) GROUP BY cluster, t) WHERE r <= 5 GROUP BY cluster),
lb AS (SELECT DISTINCT cluster, family, n, CASE family {_LABELS} ELSE 'runtime' END AS label FROM cl)
SELECT co.cluster, co.n, same_family_ratio, dependency_overlap, structural_alignment, dominant, CASE WHEN coalesce(tk.c, 0) >= greatest(2, ceil(lb.n * 0.5)) THEN 'shared ' || label || ' dependencies' WHEN family IN ('page', 'routed_page_or_screen') THEN 'same page family'
  WHEN family = 'state_or_store' THEN 'shared store pattern' WHEN family = 'hook_or_context' THEN 'shared hook/context pattern' ELSE 'same ' || label || ' family' END AS reason
FROM co JOIN lb ON lb.cluster = co.cluster LEFT JOIN tk ON tk.cluster = co.cluster LEFT JOIN sg ON sg.cluster = co.cluster"""
)
def cluster_summary(spark, d):
    """Each cluster's size, cohesion, dominant signals and reason."""
    p = rows(spark, d)
    m = scratch.save(patterns.clusters(p, scratch.save))
    s = patterns.dominant_signals(p, m).groupBy("cluster").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "signal"))), lambda x: x["signal"]), ",").alias("dominant"))
    return patterns.cohesion(p, m).join(s, "cluster", "left").join(patterns.reasons(p, m), "cluster")


@query(
    f"""WITH RECURSIVE {_CLUSTERS}, rr AS (SELECT DISTINCT cluster, representative, family FROM cl),
f AS (SELECT x.cluster AS c1, y.cluster AS c2 FROM rr x JOIN rr y ON x.cluster <> y.cluster JOIN pm ON pm.a = x.representative AND pm.b = y.representative
  WHERE {_FAM('x.family', 'y.family')} = 0 AND NOT (pm.score < greatest({_N(0.7)} - {_N(0.08)}, {_N(0.58)}) AND pm.dep < 0.5) AND NOT (pm.dep < 0.18 AND pm.rc < 0.55))
SELECT c1 AS cluster, c2 AS related FROM f"""
)
def related_clusters(spark, d):
    """Clusters of one kind and different families that are alike."""
    p = rows(spark, d)
    return patterns.related_clusters(p, patterns.clusters(p, scratch.save), scratch.save)  # read once


_GENERIC = ", ".join(f"'{t}'" for t in patterns.GENERIC_TOKENS)


@query(
    f"""WITH RECURSIVE {_CLUSTERS}, co AS (SELECT cl.cluster, {_R3(f"coalesce(avg(pm.dep), {_N(1)})")} AS dov FROM cl LEFT JOIN pm ON pm.a = representative AND pm.b = cl.pattern_id WHERE cl.family = 'ui_component' AND cl.n >= 40 GROUP BY cl.cluster),
tok AS (SELECT cl.pattern_id, cl.cluster, cl.n, unnest(fp.dep_tokens) AS token, unnest(range(1, len(fp.dep_tokens) + 1)) AS pos FROM cl JOIN co USING (cluster) JOIN fp USING (pattern_id)),
cnt AS (SELECT cluster, token, count(*) AS c FROM tok WHERE token NOT IN ({_GENERIC}) GROUP BY cluster, token),
dom AS (SELECT pattern_id, cluster, token FROM (SELECT tok.*, row_number() OVER (PARTITION BY pattern_id ORDER BY token IN ({_GENERIC}), coalesce(c, 0) >= greatest(4, floor(n * 0.25)), CASE WHEN token IN ({_GENERIC}) THEN pos END, c, token) AS r FROM tok LEFT JOIN cnt USING (cluster, token)) WHERE r = 1),
ts AS (SELECT cluster, token, count(*) AS c FROM dom GROUP BY cluster, token HAVING count(*) >= 4), tp AS (SELECT cluster, count(*) AS parts, max(c) AS largest FROM ts GROUP BY cluster HAVING count(*) >= 2),
wanted AS (SELECT cluster FROM co WHERE dov <= 0.78 UNION SELECT cluster FROM tp),
e AS (SELECT pm.a, pm.b FROM pm JOIN cl x ON x.pattern_id = pm.a JOIN cl y ON y.pattern_id = pm.b AND y.cluster = x.cluster JOIN wanted w ON w.cluster = x.cluster WHERE pm.dep >= 0.28 OR pm.tc >= 0.28 AND pm.score >= 0.7 OR pm.ic >= 0.5 AND pm.rc >= 0.5),
r2 AS (SELECT pattern_id AS p, pattern_id AS q FROM cl JOIN wanted USING (cluster) UNION SELECT r2.p, e.b FROM r2 JOIN e ON e.a = r2.q), pt AS (SELECT p AS pattern_id, min(q) AS part FROM r2 GROUP BY p),
gs AS (SELECT cl.cluster, part, count(*) AS c FROM pt JOIN cl USING (pattern_id) GROUP BY cl.cluster, part HAVING count(*) >= 4), gp AS (SELECT cluster, count(*) AS parts, max(c) AS largest FROM gs GROUP BY cluster HAVING count(*) >= 2),
way AS (SELECT w.cluster, CASE WHEN gp.parts IS NULL OR (tp.parts IS NOT NULL AND (tp.largest <= floor(gp.largest * 0.85) OR tp.parts > gp.parts)) THEN 'token' ELSE 'graph' END AS way FROM wanted w LEFT JOIN gp USING (cluster) LEFT JOIN tp USING (cluster) WHERE gp.parts IS NOT NULL OR tp.parts IS NOT NULL),
gm AS (SELECT pt.pattern_id, cl.cluster, pt.part, len(fp.structural) AS ns, coalesce((SELECT {_R3('sum(sc.score)')} FROM sc JOIN pt o ON o.pattern_id = sc.b AND o.part = pt.part WHERE sc.a = pt.pattern_id), 0) AS total FROM pt JOIN cl USING (pattern_id) JOIN fp USING (pattern_id) JOIN gs ON gs.cluster = cl.cluster AND gs.part = pt.part),
gr AS (SELECT cluster, part, pattern_id AS sub FROM (SELECT *, row_number() OVER (PARTITION BY cluster, part ORDER BY total DESC, ns DESC, pattern_id) AS r FROM gm) WHERE r = 1)
SELECT pattern_id, cluster, token AS sub, way FROM dom JOIN ts USING (cluster, token) JOIN way USING (cluster) WHERE way = 'token'
UNION ALL SELECT pattern_id, cluster, sub, way FROM gm JOIN gr USING (cluster, part) JOIN way USING (cluster) WHERE way = 'graph'"""
)
def subclusters(spark, d):
    """The parts of large clusters of components."""
    return patterns.cluster_parts(rows(spark, d), scratch.save)
