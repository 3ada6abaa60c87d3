"""The queries on the smallest tables: against their SQL, a brute-force version, or held-out labels."""

import re
import zlib

import duckdb
import pandas as pd
import pytest

from tessera_spark.llm import queries, tokens

from .test_operators import brute_components, brute_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(str, got[columns].values.tolist())) == sorted(map(str, want[columns].values.tolist()))


def test_names():
    assert sorted(queries.QUERIES) == sorted(
        ["op1_decontamination", "op2_mixing", "op3_quality", "op4_toxicity", "op5_secrets", "op6_line_dedup", "op7_jaccard_join", "op8_chat_format", "op9_token_counts", "op10_licences"]
    )


def test_decontamination(spark, docs):
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op1_decontamination"](spark, SF).collect()}
    clean = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    whole = {(d.doc_id, i.item_id) for d in docs.itertuples() for i in items.itertuples() if f" {clean(i.text)} " in f" {clean(d.text)} "}
    assert whole <= got and len(got - whole) <= 1


def test_mixing(spark):
    out = queries.QUERIES["op2_mixing"](spark, SF).toPandas()
    size = out["size"].sum()
    docs = pd.read_parquet(f"{SF}/documents.parquet").merge(out, on="doc_id")
    assert out.drop_duplicates(["source_size", "target"])["target"].sum() == pytest.approx(size)
    assert (out["taken"] <= 3 * out["size"]).all()
    by = docs.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), n=("size", "size"))
    assert ((by["taken"] - by["target"]).abs() <= 0.02 * by["target"] + 60).all()


def test_toxicity(spark):
    out = queries.QUERIES["op4_toxicity"](spark, "/root/testdata/sf0.1").toPandas()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()
    held = out[out["held_out"]].merge(pd.read_parquet("/root/testdata/sf0.1/labels.parquet"), on="doc_id")
    assert held[held["toxic"] == 1]["predicted"].mean() >= 0.85 and held[held["toxic"] == 0]["predicted"].mean() <= 0.03


def test_line_dedup(spark, docs):
    got = {r["doc_id"]: r["text"] for r in queries.QUERIES["op6_line_dedup"](spark, SF).collect()}
    rows = [(r.doc_id, r.text) for r in docs.sort_values("doc_id").head(40).itertuples()]
    want = brute_lines(rows)  # what comes before a line decides, so the first documents can be checked alone
    assert {i: got[i] for i, _ in rows} == want


def test_jaccard(spark, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.QUERIES["op7_jaccard_join"](spark, SF).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.itertuples()], 3, 90)


def test_tokens(spark, docs):
    count = tokens.counter(tokens.DEFAULT_VOCABULARY)
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    for r in queries.QUERIES["op9_token_counts"](spark, SF).collect():
        assert [r["n_tokens"]] == count([text[r["doc_id"]]])
        assert [r["n_tokens_after"]] == count([re.sub(r"[0-9A-Fa-f]{16,}", "[REDACTED]", text[r["doc_id"]])])


def test_secrets(spark, docs):
    found = {r["doc_id"] for r in queries.QUERIES["op5_secrets"](spark, SF).where("is_secret").collect()}
    planted = {r.doc_id for r in docs.itertuples() if re.search(r'token = "[0-9a-f]{40}"', r.text)}
    assert planted <= found


def test_licences(spark, docs):
    found = {r["doc_id"] for r in queries.QUERIES["op10_licences"](spark, SF).where("confirmed").collect()}
    planted = {r.doc_id for r in docs.itertuples() if re.search(r"^(Licensed under|Released under|This work is licensed under) .*\.$", r.text, re.M)}
    assert found == planted
