import re

import pytest

import corpus_pipeline
from tessera_spark.llm import common, toxicity

from .test_operators import brute_components, common_words

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_shrink(spark):
    docs = common.read_table(spark, SF, "documents")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.materialize(stage(spark, docs, SF), name)
        n = docs.count()
        assert 0 < n <= before
        before = n
        if i + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
    assert docs.where("copies < 1 or copies > 3").count() == 0


def test_stages_take_odd_rows(spark):
    real = common.read_table(spark, SF, "documents")
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "a", 0), (None, "a word", "en", None, 6), (3, "a word", "en", "a", 6), (3, "a word", "en", "a", 6)], real.schema)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            docs = common.materialize(stage(spark, docs, SF), name)
        assert docs.count() <= 5


def within(a, b, k):
    """Whether two strings are within k edits: the common start goes, then one of the three edits is tried."""
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    a, b = a[n:], b[n:]
    if not a or not b:
        return len(a) + len(b) <= k
    return k > 0 and (within(a[1:], b[1:], k - 1) or within(a[1:], b, k - 1) or within(a, b[1:], k - 1))


def brute_line_stage(rows, tau=2, least=40):
    """{id: text} after lines that are equal or near to an earlier one have gone, and documents that lost all their words."""
    seen, by_length, out = set(), {}, {}
    for i, text in sorted(rows.items()):
        kept = []
        for x in text.split("\n"):
            if not common_words(x):
                kept.append(x)
                continue
            near = len(x) >= least and any(within(x, y, tau) for n in range(len(x) - tau, len(x) + tau + 1) if n >= least for y in by_length.get(n, ()))
            if x not in seen:
                seen.add(x)
                by_length.setdefault(len(x), []).append(x)
                if not near:
                    kept.append(x)
        cleaned = "\n".join(kept)
        if common_words(cleaned) or not common_words(text):
            out[i] = cleaned
    return out


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept: its rows and texts are those of a plain version of its rule."""
    docs = common.read_table(spark, SF, "documents")
    items = [r["text"] for r in common.read_table(spark, SF, "benchmark").collect()]
    model = toxicity.fit(docs, common.read_table(spark, SF, "labels"))
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        sources = {r["doc_id"]: r["source"] for r in docs.collect()}
        docs = common.materialize(stage(spark, docs, SF), name)
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "toxicity":
            assert after == {i: t for i, t in before.items() if toxicity.score_one(t, *model, toxicity.Params()) < 0.5}
        elif name == "line_dedup":
            assert after == brute_line_stage(before)
        elif name == "jaccard_join":
            first = brute_components(list(before.items()), 5, 80)
            assert after == {i: t for i, t in before.items() if first[i][1] == i}
        elif name == "decontamination":
            clean = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
            whole = {i for i, t in before.items() if any(f" {clean(x)} " in f" {clean(t)} " for x in items)}
            gone = set(before) - set(after)
            assert whole <= gone and len(gone - whole) <= 2 and all(after[i] == before[i] for i in after)
        else:
            size = {i: len(common_words(t)) for i, t in before.items()}
            taken = {}
            for r in docs.collect():
                assert r["size"] == size[r["doc_id"]] and r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
                taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
            targets = {r["source"]: r["target"] for r in docs.select("source", "target").distinct().collect()}
            whole = {s: sum(size[i] for i in size if sources[i] == s) for s in set(sources.values())}
            assert sum(targets.values()) == pytest.approx(sum(whole.values()), rel=0.01)
            assert all(abs(taken[s] - targets[s]) <= max(size.values()) and targets[s] <= 3 * whole[s] + 1e-6 for s in targets)
