from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera_spark.functions import ladders
from tessera_spark.operators import patterns
from tessera_spark.sources import scratch

SCHEMA = "pattern_id string, kind string, repo_id string, file_id string, name string, structural array<string>, imports array<string>, export_shape string, role string, ui array<string>, async_ array<string>, responsibility array<string>, family string, deps array<string>, dep_tokens array<string>, confidence string, indexed boolean"


def row(i, kind="component", name="Button", file="f", family="ui_component", deps=("d",), **more):
    base = dict(pattern_id=i, kind=kind, repo_id="r", file_id=file, name=name, structural=["jsx-return", "react-function-component", "uses-hooks"], imports=["react"], export_shape="named", role="component", ui=["jsx-return"], async_=[], responsibility=[], family=family, deps=list(deps), dep_tokens=["ui"], confidence="high", indexed=True)
    return Row(**(base | more))


def table(spark, *rows):
    return spark.createDataFrame([tuple(r) for r in rows], SCHEMA)


def test_pinned_scores(spark):
    p = table(spark, row("a"), row("b", name="IconButton", file="g"), row("c", kind="hook", name="useX"), row("d", structural=["async"], imports=[], ui=[], family="module_or_integration", role="module", deps=[], dep_tokens=[]))
    got = {(r["a"], r["b"]): r["score"] for r in patterns.scored_pairs(p, shared_signal=False).collect()}
    assert got["a", "b"] == 1.0 and ("a", "c") not in got and got["a", "d"] < 0.25
    assert patterns.find_similar(p, "a").first()["pattern_id"] == "b"


def test_scores_are_symmetric(spark):
    p = table(spark, row("a", imports=["x", "y"], ui=[]), row("b", name="Thing", structural=["jsx-return"], responsibility=["save"]))
    q = table(spark, row("b", imports=["x", "y"], ui=[]), row("a", name="Thing", structural=["jsx-return"], responsibility=["save"]))
    assert patterns.scored_pairs(p, shared_signal=True).first()["score"] == patterns.scored_pairs(q, shared_signal=True).first()["score"]


def test_broad_kinds_are_capped_and_names_count(spark):
    p = table(spark, row("a"), row("b", name="LoadOrders", structural=["jsx-return", "x", "y", "z"]), row("c", kind="service-layer", name="A"), row("d", kind="service-layer", name="B"))
    got = {(r["a"], r["b"]): r for r in patterns.scored_pairs(p, shared_signal=False).collect()}
    assert got["a", "b"]["score"] <= 0.6 and not got["a", "b"]["passes"]
    assert got["c", "d"]["score"] == 1.0  # names of this kind do not count
    r = spark.createDataFrame([("component", "hook"), ("page", "component"), ("story", "test"), ("x", "unknown")], "a string, b string").select(patterns.role_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [x["s"] for x in r] == [0.45, 0.0, 0.45, 0.25]


def test_clusters(spark):
    p = table(spark, row("a"), row("b", name="IconButton"), row("c", name="LinkButton", deps=(), dep_tokens=[], imports=["react", "lodash"]), row("z", name="Far", structural=["other"], imports=["q"], ui=[], deps=[], dep_tokens=[]))
    m = patterns.clusters(p, scratch.save)
    got = {r["pattern_id"]: (r["cluster"], r["n"], r["role"], r["family"]) for r in m.collect()}
    assert got["a"] == ("a", 3, "core", "ui_component") and got["b"][0] == got["c"][0] == "a" and got["z"] == ("z", 1, "core", "ui_component")
    c = {r["cluster"]: r["same_family_ratio"] for r in patterns.cohesion(p, m).collect()}
    assert c == {"a": 1.0, "z": 1.0}
    assert patterns.dominant_signals(p, m).where("cluster = 'a' and rank = 1").first()["signal"] == "jsx-return"


def test_core_members_depend_on_the_same(spark):
    """A member that is alike but shares no dependency, import or responsibility is peripheral."""
    far = dict(deps=("other",), dep_tokens=["far"], imports=["vue"])
    p = table(spark, row("a"), row("b", name="IconButton"), row("c", name="Button", **far))
    m = {r["pattern_id"]: (r["cluster"], r["role"]) for r in patterns.clusters(p, scratch.save).collect()}
    assert m["a"] == ("a", "core") and m["b"] == ("a", "core") and m["c"] in (("a", "peripheral"), ("c", "core"))


def test_related_clusters_and_reasons(spark):
    p = table(spark, row("a"), row("b", name="IconButton"), row("c", family="state_or_store"), row("d", name="IconButton", family="state_or_store"), row("e", kind="hook", family="hook_or_context"))
    m = scratch.save(patterns.clusters(p, scratch.save))
    assert {(r["cluster"], r["related"]) for r in patterns.related_clusters(p, m).collect()} == {("a", "c"), ("c", "a")}
    assert {r["cluster"]: r["reason"] for r in patterns.reasons(p, m).collect()} == {"a": "shared component dependencies", "c": "shared store/context dependencies", "e": "shared hook/context pattern"}


def test_subclusters_by_token(spark):
    rows = [row(f"p{t}{i}", name=f"Thing{i}", deps=("base",), dep_tokens=["ui", t]) for t in ("billing", "orders") for i in range(4)]
    p = table(spark, *rows)
    m = scratch.save(patterns.clusters(p, scratch.save))
    got = {r["pattern_id"]: (r["sub"], r["way"]) for r in patterns.subclusters(p, m, scratch.save, parent=8).collect()}
    assert got == {f"p{t}{i}": (t, "token") for t in ("billing", "orders") for i in range(4)}


def test_ladders(spark):
    lit = F.lit
    old = {"sha256": lit("a"), "mtime_ms": lit(1.0), "exports": lit("x")}
    s = lambda **new: ladders.change_signals(old, old | new)
    r = spark.range(1).select(
        s(mtime_ms=lit(2.0)).alias("meta"), s(sha256=lit("b"), exports=lit("y")).alias("both"), ladders.modified_hints(F.array(lit("contentChanged"), lit("exportsChanged")), lit(False)).alias("hints"),
        ladders.tool_confidence(lit(0.95), lit(0.9), lit(True)).alias("c"), ladders.family(lit("src/app/x/page.tsx"), lit("component"), lit("P"), lit("component"), F.array(lit("jsx-return")), F.array().cast("array<string>")).alias("f"),
        ladders.search_freshness(lit("ok"), lit(5), lit(True), lit(None), lit("ok"), lit("ready"), lit(6), lit(False)).alias("stale"), ladders.regressed(lit(100), lit(3), lit(50), lit(1), 0.15, 2).alias("reg"),
        ladders.pattern_integrity(lit(30), lit(0), lit(0), lit(None).cast("int"), lit(0), lit(True), lit(None).cast("string")).alias("codes"), ladders.trust(lit("ok"), lit(0), lit(False), lit(True)).alias("t"),
    ).first()
    assert r["meta"] == ["metadataOnlyChanged"] and r["both"] == ["contentChanged", "exportsChanged"] and r["hints"] == ["mayAffectDependents", "mayAffectSearchFreshness", "requiresGraphRebuild", "requiresSymbolReindex"]
    assert (r["c"], r["f"], r["stale"], r["reg"], r["t"]) == ("high", "routed_page_or_screen", "stale", True, "stale")
    assert r["codes"].asDict() == {"status": "failed", "codes": ["pattern-output-catastrophically-incomplete", "pattern-output-empty"]}
    assert ladders.budget_profile(6000)["enough"] == 3


def test_blocks_score_as_rows_do(spark):
    """The scores of blocks are those of the column expressions, bit by bit, over all kinds; profiles stand for all their patterns."""
    from tessera_spark.plans import pattern_queries

    q = scratch.save(patterns.profiled(pattern_queries.rows(spark, "/root/testdata/sf0.01")))
    x, y = q.alias("x"), q.alias("y")
    j = x.join(y, (F.col("x.kind") == F.col("y.kind")) & (F.col("x._cls") <= F.col("y._cls")))
    names = [n.split()[0] for n in patterns.SCORED.split(", ")]
    want = {(r["u"], r["v"]): r for r in patterns.scored(j, {"u": F.col("x._cls"), "v": F.col("y._cls")}).select("u", "v", *names).collect()}
    got = {(r["u"], r["v"]): r for r in patterns.compared(patterns.profiles(q), columns=tuple(names)).select("u", "v", *names).collect()}
    assert len(got) > 1000 and got == want


def test_copies_are_scored_once(spark, monkeypatch):
    """Many patterns that agree in all that counts are one profile; their pairs, lists and clusters are those of all of them."""
    monkeypatch.setattr(patterns, "CHUNK", 3)
    p = table(spark, *[row(f"p{i}", file=f"f{i // 2}") for i in range(8)], row("z", name="Far", structural=["other"], imports=["q"], ui=[], deps=[], dep_tokens=[]))
    assert patterns.profiles(patterns.profiled(p)).count() == 2
    got = [(r["a"], r["b"]) for r in patterns.scored_pairs(p, shared_signal=True).collect()]
    assert sorted(got) == [(f"p{i}", f"p{j}") for i in range(8) for j in range(i + 1, 8)]
    top = {(r["pattern_id"], r["rank"]): (r["other"], r["score"]) for r in patterns.most_similar(p, 2, scratch.save).collect()}
    assert [top["p0", i] for i in (1, 2)] == [("p2", 1.0), ("p3", 1.0)] and [top["p2", i] for i in (1, 2)] == [("p0", 1.0), ("p1", 1.0)] and top["z", 1][0] == "p0"
    m = {r["pattern_id"]: (r["cluster"], r["representative"], r["n"], r["role"]) for r in patterns.clusters(p, scratch.save).collect()}
    assert m == {f"p{i}": ("p0", "p0", 8, "core") for i in range(8)} | {"z": ("z", "z", 1, "core")}


def test_clusters_across_blocks(spark, monkeypatch):
    """Components and sums of scores that span blocks are those of all pairs, by either walk; a block writes one matrix, not its pairs."""
    from tessera_spark.operators import graph

    rows = [row(f"p{i:02}", name=f"{'Icon' if i % 3 else 'Far'}Button{'List' if i % 4 == 0 else ''}", imports=["react"] if i % 2 else ["react", "axios"], deps=("d", f"e{i % 5}"), role=["component", "hook", None][i % 3], indexed=[True, None, False][i % 3]) for i in range(14)]
    p = table(spark, *rows, row("p99"), row("z1", name="Far", structural=["other"], imports=["q"], ui=[], deps=[], dep_tokens=[], family=None))
    pairs = [(r["a"], r["b"], r["score"], r["passes"]) for r in patterns.scored_pairs(p, shared_signal=False).collect()]
    ids = [r["pattern_id"] for r in p.collect()]
    part = {i: i for i in ids}
    for _ in ids:
        for a, b, _, passes in pairs:
            if passes:
                part[a] = part[b] = min(part[a], part[b])
    total = {i: sum(round(1000 * s) for a, b, s, _ in pairs if i in (a, b) and part[a] == part[b]) for i in ids}
    size = {i: len(r["structural"]) for i, r in zip(ids, p.collect(), strict=True)}
    want = {i: (part[i], min((j for j in ids if part[j] == part[i]), key=lambda j: (-total[j], -size[j], j))) for i in ids}
    monkeypatch.setattr(patterns, "BLOCK", 3)
    c = scratch.save(patterns.profiles(patterns.keyed(p)))
    assert c.count() > 9 and patterns.linked(c, lambda s: s["passes"]).count() <= 21
    for small in (graph.SMALL_EDGES, 0):
        monkeypatch.setattr(graph, "SMALL_EDGES", small)
        got = {r["pattern_id"]: (r["cluster"], r["representative"]) for r in patterns.clusters(p, scratch.save).collect()}
        assert got == want


def test_pairs_are_written_from_blocks(spark, monkeypatch):
    """Pairs across blocks of patterns are those of all rows, once each; ids that are null or equal make no pair; no pair is joined or exploded to find its ids."""
    monkeypatch.setattr(patterns, "PATTERNS", 3)
    monkeypatch.setattr(patterns, "SENT", 4)
    rows = [row(f"p{i % 11:02}", name=f"{'Icon' if i % 3 else 'Far'}Button", imports=["react"] if i % 2 else [], kind="hook" if i % 5 == 0 else "component", structural=["x"] if i == 7 else ["jsx-return", "uses-hooks"]) for i in range(13)]
    p = table(spark, *rows, row(None), row("z", kind=None))
    q = scratch.save(patterns.prepared(p))
    j = q.alias("x").join(q.alias("y"), (F.col("x.kind") == F.col("y.kind")) & (F.col("x.pattern_id") < F.col("y.pattern_id")))
    want = sorted(tuple(r) for r in patterns.scored(j, {"a": F.col("x.pattern_id"), "b": F.col("y.pattern_id")}).select("a", "b", "score", "passes", "dep", "shares").collect())
    got = patterns.scored_pairs(p, shared_signal=False, save=scratch.save, columns=("score", "passes", "dep", "shares"))
    assert len(want) > 40 and sorted(tuple(r) for r in got.collect()) == want
    shared = patterns.scored_pairs(p, shared_signal=True, save=scratch.save)
    assert sorted(tuple(r) for r in shared.collect()) == [r[:5] for r in want if r[5]]
    plan = shared._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Join ") == 1


def test_few_profiles_are_grouped_at_once(spark, monkeypatch):
    """Few profiles are grouped without tables between, as many are by joins: the same clusters, related clusters and parts."""
    rows = [row(f"p{i:02}", name=f"{'Icon' if i % 3 else 'Far'}Button", imports=["react"] if i % 2 else ["react", "axios"], deps=("d", f"e{i % 5}"), dep_tokens=["ui", f"t{i % 2}"], family=["ui_component", "ui_component", "page"][i % 3]) for i in range(16)]
    p = table(spark, *rows, row("q", kind="hook", family="hook_or_context"), row("s", family="state_or_store"), row("z", name="Far", structural=["other"], imports=["q"], ui=[], deps=[], dep_tokens=[], family=None))
    saved, got = [], []
    save = lambda df: saved.append(1) or scratch.save(df)
    monkeypatch.setattr(patterns, "BLOCK", 5)
    for few in (patterns.SMALL, 0):
        monkeypatch.setattr(patterns, "SMALL", few)
        saved.clear()
        m = patterns.clusters(p, save)
        many = len(saved)
        m = scratch.save(m)
        got.append([sorted(map(tuple, df.collect()), key=str) for df in (m, patterns.related_clusters(p, m, scratch.save), patterns.subclusters(p, m, scratch.save, parent=4))])
        assert many == 4 if few else many > 4
    assert got[0] == got[1] and all(got[0])


def test_parts_are_found_among_profiles(spark, monkeypatch):
    """Parts of clusters found among profiles are those found among patterns, copies counted, null ids left out, with fewer tables between; few profiles and many."""
    rows = [row(f"p{i:02}", name=f"{'Icon' if i % 3 else 'Far'}Button", imports=["react"] if i % 2 else ["react", "axios"], deps=("d", f"e{i % 5}"), dep_tokens=["ui", f"t{i % 2}"], family=["ui_component", "ui_component", "page"][i % 3]) for i in range(16)]
    rows += [row(f"q{i}", kind="hook", structural=["h", "i", "j"], imports=[f"m{i % 2}"], deps=(f"f{i % 2}", "g"), dep_tokens=["ui"], responsibility=["load"]) for i in range(9)]
    p = table(spark, *rows, *rows[:1], row(None), row("z", name="Far", structural=["other"], imports=["q"], ui=[], deps=[], dep_tokens=[], family=None))
    p = p.dropDuplicates(["pattern_id"]).unionByName(p.where("pattern_id = 'p01'").withColumn("pattern_id", F.lit("p99")))
    m = scratch.save(patterns.clusters(p.where("pattern_id is not null"), scratch.save))
    saved, got = [], []
    save = lambda df: saved.append(1) or scratch.save(df)
    monkeypatch.setattr(patterns, "BLOCK", 5)
    for few in (patterns.SMALL, 0):
        monkeypatch.setattr(patterns, "SMALL", few)
        saved.clear()
        parts = patterns.cluster_parts(p, save, parent=4)
        assert len(saved) <= 8 or not few
        got += [sorted(map(tuple, df.collect())) for df in (parts, patterns.subclusters(p, m, scratch.save, parent=4))]
    assert got[0] and all(g == got[0] for g in got)
