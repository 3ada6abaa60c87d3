import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera_spark.functions import paths, sets, text
from tessera_spark.operators import graph, tables
from tessera_spark.plans.engine import Corpus, Engine
from tessera_spark.sources import extract, generations, repositories, scratch
from tessera_spark.streaming import refresh


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def lit(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def test_jaccard_variants(spark):
    r = one(spark, a=sets.jaccard(lit(), lit(), empty=1.0), b=sets.jaccard(lit("x"), lit(), either_empty=0.0), c=sets.jaccard(lit(), lit()), d=sets.jaccard(lit("x", "y"), lit("y", "z")), n=sets.count_left(lit("x", "x", "y"), lit("x")))
    assert (r["a"], r["b"], r["c"], r["n"]) == (1.0, 0.0, 0.0, 2) and r["d"] == pytest.approx(1 / 3)


def test_text(spark):
    r = one(spark, t=text.name_tokens(F.lit("parseHTMLPage_v2")), p=text.common_prefix(lit("a", "b", "c"), lit("a", "b", "d")), s=text.common_suffix(lit("z", "c"), lit("y", "c")), r=text.round3(F.lit(0.0005)), n=text.name_similarity(lit("use", "data"), lit("use", "data")))
    assert r["t"] == ["parse", "html", "page", "v2"] and (r["p"], r["s"], r["r"], r["n"]) == (2, 1, 0.001, 1.0)


def test_paths(spark):
    p = F.lit("src/ui/button.test.tsx")
    r = one(spark, b=paths.base_name(p), d=paths.dir_name(p), s=paths.stem(p), e=paths.extension(p), c=paths.closeness(p, F.lit("src/api/x.ts")), up=paths.resolve_relative(F.lit("src/ui"), F.lit("../api/./x")), out=paths.resolve_relative(F.lit("a"), F.lit("../../x")))
    assert (r["b"], r["d"], r["s"], r["e"], r["c"], r["up"], r["out"]) == ("button.test.tsx", "src/ui", "button", ".tsx", 1, "src/api/x", None)
    got = one(spark, c=paths.import_candidates(F.lit("src"), F.lit("./a")))["c"]
    assert got[:2] == ["src/a", "src/a.ts"] and "src/a/index.tsx" in got


def test_diff_and_merge(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, h string")
    new = spark.createDataFrame([(2, "B"), (3, None), (4, "d")], "k int, h string")
    d = tables.diff(old, new, "k", ["h"])
    assert {r["k"]: r["change"] for r in d.collect()} == {1: "deleted", 2: "modified", 3: "unchanged", 4: "added"}
    merged = tables.merge(old, new, d.where("change <> 'unchanged'"), "k")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, new.collect()))


def test_resolution(spark):
    imports = spark.createDataFrame([("f", "a"), ("f", "b"), ("f", "c")], "file string, name string")
    targets = spark.createDataFrame([("a", "x"), ("b", "x"), ("b", "y"), ("a", "x")], "name string, t string")
    got = {r["name"]: (r["status"], r["target"]) for r in tables.resolve_unique(imports, targets, ["name"], ["file", "name"], "t").collect()}
    assert got == {"a": ("resolved", "x"), "b": ("ambiguous", None), "c": ("unresolved", None)}


def test_innermost_interval(spark):
    rng = random.Random(1)
    spans = [("f", a, a + rng.randint(0, 150), f"s{i}") for i, a in enumerate(rng.sample(range(300), 40))]
    points = [("f", x) for x in range(0, 460, 3)]
    got = tables.innermost_interval(spark.createDataFrame(points, "f string, x int"), spark.createDataFrame(spans, "f string, a int, b int, n string"), "f", "x", "a", "b", "n").collect()
    for r in got:
        inside = [(b - a, a, n) for _, a, b, n in spans if a <= r["x"] <= b]
        assert r["n"] == (min(inside)[2] if inside else None)
    assert len(got) == len(points)


def test_nearest_ancestor(spark):
    files = spark.createDataFrame([(1, "a/b/c.ts"), (2, "a/d.ts"), (3, "z.ts")], "id int, path string")
    conf = spark.createDataFrame([("a", "A"), ("a/b", "B")], "dir string, c string")
    assert {r["id"]: r["config"] for r in tables.nearest_ancestor(files, conf, "id", "path", "dir", "c").collect()} == {1: "B", 2: "A", 3: None}


def test_fingerprint_does_not_depend_on_order(spark):
    rows = [("r", f"p{i}", f"h{i}") for i in range(50)]
    a = tables.fingerprint(spark.createDataFrame(rows, "r string, p string, h string"), "r", "p", "h").first()
    b = tables.fingerprint(spark.createDataFrame(rows[::-1], "r string, p string, h string").repartition(5), "r", "p", "h").first()
    assert a == b and a["n_files"] == 50


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=20))
def test_components_equal_search(spark, pairs):
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(pairs, "a int, b int"), "a", "b", scratch.save).collect()}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[v] == min(seen)


def test_tree_stops_at_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("a", "c")], "from_id string, to_id string")
    assert {r["path"] for r in graph.render_tree(e, "a", 5).collect()} == {"a", "a>b", "a>c", "a>b>c"}


def test_two_hop_caps(spark):
    edges = spark.createDataFrame([(f"i{j}", s) for s in ("s1", "s2") for j in range(20)] + [("k", "s2")], "from_id string, to_id string")
    nodes = spark.createDataFrame([(f"i{j}", f"p{j:02}") for j in range(20)] + [("k", "a")], "file_id string, path string")
    direct = spark.createDataFrame([("s1", "a"), ("s2", "b")], "id string, path string")
    got = graph.two_hop(direct, edges, nodes, [F.col("path")], lambda: [F.col("path"), F.col("file_id")]).collect()
    assert len(got) == 16 and {r["seed_id"] for r in got} == {"s1"}  # the first seed is cut off, so the walk ends there
    wide = graph.two_hop(direct, edges, nodes, [F.col("path")], lambda: [F.col("path"), F.col("file_id")], per_seed=50).collect()
    assert len(wide) == 21 and [r["rank"] for r in wide] == list(range(1, 22)) or len(wide) == 21


TS = """import React, { useState as st, type FC } from 'react'
import * as api from "./api"
import './style.css'
export { Button as B, Icon } from './button'
export * from './all'

export function Widget(props) {
  const [a, b] = st(0)
  return <Card title="x" wide onClick={go}><Ns.Item /></Card>
}
export default class Store {
  async load(id: string): Promise<void> {
    if (id) {
    }
  }
}
interface Props { a: string }
type Id = string
const limit = 5 // Widget in a comment
"""


def test_extraction(spark):
    f = spark.createDataFrame([("f", TS)], "file_id string, text string")
    s = {(r["kind"], r["name"]): (r["exported"], r["start_line"], r["end_line"]) for r in extract.symbols(f).collect()}
    assert set(s) == {("function", "Widget"), ("class", "Store"), ("method", "load"), ("interface", "Props"), ("type", "Id"), ("variable", "limit")}
    assert s["function", "Widget"] == (True, 7, 10) and s["method", "load"][1] == 12
    i = {(r["source"], r["imported"], r["local"], r["kind"]) for r in extract.imports(f).collect()}
    assert i == {("react", "default", "React", "default"), ("react", "useState", "st", "named"), ("react", "FC", "FC", "named"), ("./api", "*", "api", "namespace"), ("./style.css", None, None, "side_effect")}
    e = {(r["kind"], r["exported"], r["local"], r["source"]) for r in extract.exports(f).collect()}
    assert {("reexport", "B", "Button", "./button"), ("reexport", "Icon", "Icon", "./button"), ("star", "*", None, "./all"), ("declaration", "Widget", "Widget", None), ("declaration", "default", "Store", None)} <= e
    c = {(r["component"], r["prop"], r["value_kind"]) for r in extract.components(f).collect()}
    assert c == {("Card", "title", "string"), ("Card", "wide", "boolean"), ("Card", "onClick", "expression"), ("Ns.Item", None, None)}


def test_scan_and_classify(spark, tmp_path):
    for p in ("one/src/a.ts", "one/node_modules/x.js", "two/b.test.tsx", "two/readme.md"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("export const a = 1\nline\n")
    f = repositories.scan(spark, str(tmp_path))
    got = {(r["repo"], r["path"]): (r["c"], r["s"]) for r in f.select("repo", "path", repositories.classify(F.col("path")).alias("c"), repositories.scope(F.col("path")).alias("s")).collect()}
    assert got == {("one", "src/a.ts"): ("source", "relevant_source"), ("two", "b.test.tsx"): ("source", "relevant_source"), ("two", "readme.md"): ("unknown", "documentation")}
    assert repositories.manifest(f).where("key = 'one/src/a.ts' and size = 24").count() == 1
    (tmp_path / "two/package.json").write_text("{}")
    assert [r["id"] for r in repositories.list_repositories(spark, str(tmp_path)).collect()] == ["one", "two"]
    assert [tuple(r) for r in repositories.list_repositories(spark, str(tmp_path / "two")).collect()] == [("two", str(tmp_path / "two"), False)]
    assert f.select(repositories.line_range(F.col("text"), 2, 2).alias("x")).first()["x"] == "line"
    with pytest.raises(ValueError):
        repositories.safe_path("a/../../b")


def test_generations(spark, tmp_path):
    store = generations.GenerationStore(spark, str(tmp_path / "g"))
    assert store.current() is None and store.load("t").status == "missing"
    a = store.stage({"t": spark.range(3)}, now=1000.0)
    assert store.current() is None
    store.publish(a)
    b = store.stage({"t": spark.range(5)}, now=1000.0)
    assert store.load("t").table.count() == 3
    store.publish(b)
    assert store.load("t").table.count() == 5 and store.load("nothing").status == "missing"
    c = store.stage({"t": spark.range(1)}, now=1000.0)
    assert store.clean(now=1500.0) == [] and store.clean(now=5000.0) == [c]
    with pytest.raises(ValueError):
        store.publish(c)
    assert {s["id"]: s["state"] for s in store.states()} == {a: "committed", b: "committed"}
    assert store.load("t", columns={"id": "bigint"}).status == "ok" and store.load("t", columns={"name": "string"}).status == "malformed"
    d = store.stage({"t": spark.range(2)})
    broken = next(iter((tmp_path / "g" / f"generation_id={d}" / "t").glob("part-*.parquet")))
    broken.write_bytes(b"no parquet")
    (broken.parent / f".{broken.name}.crc").unlink(missing_ok=True)
    assert store.load("t", gid=d).status == "malformed"


def test_markers_and_failures(spark, tmp_path):
    store = generations.GenerationStore(spark, str(tmp_path / "g"))
    fields = {"generationId": str, "requestedAt": str}
    assert store.load_marker("request", fields).status == "missing"
    store.save_marker("request", {"generationId": "a", "requestedAt": "now"})
    assert store.load_marker("request", fields).status == "ok" and store.load_marker("request", fields, version=2).status == "incompatible-version"
    assert store.load_marker("request", {"other": int}).status == "malformed"
    (tmp_path / "g/coordination/bad.json").write_text("{ no")
    (tmp_path / "g/coordination/dir.json").mkdir()
    assert store.load_marker("bad", fields).status == "malformed" and store.load_marker("dir", fields).status == "unreadable"
    store.record_failure("first", now=1.0)
    store.record_failure("second", now=2.0)
    assert store.failure()["reason"] == "second" and [f["reason"] for f in store.failures()] == ["first"]
    store.clear_failure()
    assert store.failure() is None and len(store.failures()) == 2


def test_stream_publishes_batches(spark, tmp_path):
    store = generations.GenerationStore(spark, str(tmp_path / "g"))
    src = tmp_path / "in"
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2)], "k int, v string, t int").coalesce(1).write.parquet(str(src))
    for _ in range(2):  # run again after a stop: nothing is applied twice
        stream = spark.readStream.schema("k int, v string, t int").parquet(str(src))
        refresh.publish_batches(stream, store, "rows", "k", "t", str(tmp_path / "state")).awaitTermination()
    assert {(r["k"], r["v"]) for r in store.load("rows").table.collect()} == {(1, "c"), (2, "b")}
    gone = tmp_path / "gone"
    spark.createDataFrame([(1, "c", 2, False), (2, "b", 1, False), (2, None, 3, True), (3, "d", 1, None)], "k int, v string, t int, gone boolean").coalesce(1).write.parquet(str(gone))
    stream = spark.readStream.schema("k int, v string, t int, gone boolean").parquet(str(gone))
    refresh.publish_batches(stream, store, "marked", "k", "t", str(tmp_path / "state2"), deleted="gone").awaitTermination()
    assert {(r["k"], r["v"]) for r in refresh.live(store.load("marked").table, "gone").collect()} == {(1, "c"), (3, "d")}
    assert refresh.lock_is_stale(0, 31, True) and refresh.lock_is_stale(0, 1, False) and not refresh.lock_is_stale(0, 29, True)


@pytest.fixture(scope="module")
def engine(spark):
    files = spark.createDataFrame([("f1", "r", "src/services/user.ts"), ("f2", "r", "src/pages/home.tsx"), ("f3", "q", "lib/index.ts")], "file_id string, repo string, path string")
    symbols = spark.createDataFrame([("s1", "f1", "User", "class", True, 2, 20), ("s2", "f3", "User", "type", False, 1, 1), ("s3", "f2", "user", "variable", False, 3, 3)], "symbol_id string, file_id string, name string, kind string, exported boolean, start_line int, end_line int")
    edges = spark.createDataFrame([("file_imports_file", "f2", "f1"), ("file_imports_file", "f3", "f2")], "type string, from_id string, to_id string")
    lines = spark.createDataFrame([("f1", 2, "export class User {"), ("f2", 1, "import { User } from 'x'"), ("f2", 5, "new User()"), ("f2", 6, "// User")], "file_id string, line_no int, line string")
    similar = spark.createDataFrame([("f1", "f3", 0.7)], "file_id string, other string, score double")
    return Engine(Corpus(files, symbols, edges, lines, similar))


def test_engine(engine):
    best = engine.rank_symbols("User").orderBy(F.desc("score")).collect()
    assert [r["symbol_id"] for r in best] == ["s1", "s2"] and best[1]["tier"] == "proxy"
    assert [r["symbol_id"] for r in engine.rank_symbols("USER").collect()].__len__() == 3
    assert engine.find_symbol("User", kind="type").first()["symbol_id"] == "s2"
    with pytest.raises(ValueError):
        engine.find_symbol(" ")
    refs = {(r["line_no"], r["score"]) for r in engine.find_references("User").collect()}
    assert refs == {(1, 4), (5, 3)}
    assert engine.search_code("User import", path_prefix="src").count() == 1 and engine.open_file("f2", 2, 5).first()["shown"].endswith("| new User()")
    assert {(r["file_id"], r["scope"]) for r in engine.impact("f1").collect()} == {("f2", "direct"), ("f3", "indirect")}
    assert engine.list_symbols("f1").count() == 1 and engine.find_related_files("f1").first()["file_id"] == "f2"
    assert engine.find_precedents("f1").first()["precedent_score"] == 0.614


def test_engine_envelopes(engine):
    out = json.loads(engine.build_change_context("f1").first()["response"])
    assert {s["tool"] for s in out["sections"]} == {"collect_refactor_context", "plan_change", "find_precedents"}
    e = json.loads(engine.explore_component("User", limit=1).first()["response"])
    assert e["total"] == 2 and e["truncated"] and e["items"][0]["symbol_id"] == "s1"
    assert json.loads(engine.analyze_symbol("User").first()["response"])["items"][0]["area"] == "service"
