"""Similarity, clusters and precedents of structural fingerprints.

Rows: pattern_id, kind, repo_id, file_id, name, structural, imports, export_shape, role, ui, async_, responsibility, family, deps,
dep_tokens, confidence, indexed. Sets are array<string>; null is empty. indexed says whether the pattern's file is structurally
indexed; null stands for a pattern without an anchor. Every rule is a column expression.

Pairs are scored between profiles: classes of patterns that agree in all that a rule reads. Ids come back when pairs are written
out. Scores of pairs of profiles are three-decimal numbers, so sums of them are exact whatever their order.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sets, text
from . import graph, tables

SETS = ("structural", "imports", "ui", "async_", "responsibility", "deps", "dep_tokens")
# Kinds with loose structure, kinds whose names count, families that go together, roles of one group, labels of families.
BROAD = ("component", "hook", "async-data-flow")
NAMED = ("component", "hook", "async-data-flow", "utility-export")
COMPATIBLE = (("page", "routed_page_or_screen"), ("hook_or_context", "state_or_store"))
ROLE_GROUPS = (("component", "hook"), ("utility", "module", "handler"), ("story", "test"))
LABELS = {
    "ui_component": "component", "ui_wrapper_or_shell": "wrapper", "page": "page", "routed_page_or_screen": "page", "hook_or_context": "hook/context", "state_or_store": "store/context",
    "util_or_helper": "utility", "api_or_handler": "API/handler", "module_or_integration": "module", "support_runtime": "support",
}
#: Tokens that name no neighbourhood of components.
GENERIC_TOKENS = ("ui", "component", "components", "shared", "common")
THRESHOLD = 0.7
CORE_SCORE, RELATED_SCORE = 0.62, 0.58
SUB_MEMBERS, SUB_PARENT, SUB_COHESION, SUB_EDGE = 4, 40, 0.78, 0.28
#: Ids of a profile that one row of pairs holds at most, and rows that are broadcast at most; beyond, both sides of a join are dealt out.
#: Patterns of a block whose pairs are written out, and pairs that are sent on at a time.
PATTERNS, SENT = 1024, 1 << 16
CHUNK = 512
SMALL = 200_000
#: Profiles of a block; a task holds the scores of two blocks.
BLOCK = 256


def _c(side: str, name: str) -> Column:
    return F.col(f"{side}.{name}")


def _both(f: Callable[..., Column], name: str, **how) -> Column:
    return f(_c("x", name), _c("y", name), **how)


def export_similarity(a: Column, b: Column) -> Column:
    a, b = F.coalesce(a, F.lit("unknown")), F.coalesce(b, F.lit("unknown"))
    out, inside = ("default", "named", "mixed"), ("none", "internal")
    half = (a.isin(*out) & b.isin(*out)) | (a.isin(*inside) & b.isin(*inside))
    return F.when(a == b, 1.0).when(half, 0.5).when((a == "unknown") | (b == "unknown"), 0.25).otherwise(0.0)


def role_similarity(a: Column, b: Column) -> Column:
    a, b = F.coalesce(a, F.lit("unknown")), F.coalesce(b, F.lit("unknown"))
    same = F.lit(False)
    for group in ROLE_GROUPS:
        same = same | (a.isin(*group) & b.isin(*group))
    return F.when(a == b, 1.0).when(same, 0.45).when((a == "unknown") | (b == "unknown"), 0.25).otherwise(0.0)


def family_similarity(a: Column, b: Column) -> Column:
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    fits = F.lit(False)
    for pair in COMPATIBLE:
        fits = fits | (a.isin(*pair) & b.isin(*pair))
    return F.when(a == b, 1.0).when(fits, 0.85).otherwise(0.0)


def dependency_overlap() -> Column:
    """The strongest of shared dependencies, their tokens and imports, the latter two discounted."""
    part = lambda n: _both(sets.jaccard, n, either_empty=0.0)
    return F.greatest(part("deps"), 0.8 * part("dep_tokens"), 0.45 * part("imports"))


def representativeness(side: str) -> Column:
    shape, n = F.coalesce(_c(side, "export_shape"), F.lit("unknown")), F.coalesce(F.size(_c(side, "structural")), F.lit(0))
    shown = F.when(shape.isin("default", "named", "mixed"), 0.05).when(shape.isin("none", "internal"), -0.05).otherwise(0.0)
    return text.clamp(1.0 + shown + F.when(n >= 3, 0.03).when(n <= 1, -0.08).otherwise(0.0), 0.85, 1.08)


def prepared(p: DataFrame) -> DataFrame:
    """What scored() reads of a pattern besides its id, in columns made once a row: sets of hashes with their sizes, tokens of names that count, anchor and representativeness."""
    none = F.array().cast("array<string>")
    p, at = p.alias("x"), lambda n: F.coalesce(_c("x", n), none)
    names = F.when(_c("x", "kind").isin(*NAMED), text.name_tokens(_c("x", "name")))
    hashes = lambda a: F.transform(a, lambda v: F.xxhash64(v))
    # Two lists have as many leading elements in common as hashes of their beginnings.
    starts = lambda a: F.transform(a, lambda _, i: F.xxhash64(F.array_join(F.slice(a, 1, i + 1), " ")))
    p = p.withColumns(
        {f"_h_{n}": F.array_distinct(hashes(at(n))) for n in SETS} | {f"_n_{n}": F.size(F.array_distinct(at(n))) for n in SETS}
        | {"_signals": F.size(at("structural")), "_shown": representativeness("x"), "_anchor": alignment("x"), "_tokens": names}
    )
    return p.withColumns({"_words": F.array_distinct(hashes(F.col("_tokens"))), "_starts": starts(F.col("_tokens")), "_ends": starts(F.reverse("_tokens"))})


#: Columns of prepared() that scored() reads.
PREPARED = ("kind", "export_shape", "role", "family", *[f"_h_{n}" for n in SETS], *[f"_n_{n}" for n in SETS], "_signals", "_words", "_starts", "_ends", "_shown", "_anchor")


def scored(j: DataFrame, keep: dict[str, Column], threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (x, y) of rows of prepared() with the columns `keep` and score, passes, dep, imports, responsibility, dep_tokens, fits and align.

    score: 0 to 1 with three decimals, 0 for different kinds. passes: whether a pair of one kind belongs in one cluster. dep, the
    overlap of dependencies; fits, of families; align, the weaker anchor; the others, overlaps of sets, 0 if either is empty. All
    are symmetric. Each step is a projection of its own, so no rule is evaluated twice.
    """
    both = lambda n: (_c("x", f"_n_{n}"), _c("y", f"_n_{n}"))
    j = j.select(
        *[v.alias(k) for k, v in keep.items()], _c("x", "kind").alias("_kind"), (_c("x", "kind") == _c("y", "kind")).alias("_one"), F.least(_c("x", "_anchor"), _c("y", "_anchor")).alias("align"),
        *[F.size(_both(F.array_intersect, f"_h_{n}")).alias(f"_i_{n}") for n in SETS], *[sum(both(n), F.lit(0)).alias(f"_s_{n}") for n in SETS], *[(F.least(*both(n)) > 0).alias(f"_b_{n}") for n in ("responsibility",)],
        _both(export_similarity, "export_shape").alias("_export"), _both(role_similarity, "role").alias("_role"), _both(family_similarity, "family").alias("fits"), F.least(_c("x", "_signals"), _c("y", "_signals")).alias("_fewest"),
        (_c("x", "_shown") + _c("y", "_shown")).alias("_shown"), F.size(_both(F.array_intersect, "_words")).alias("_i_words"), (F.size(_c("x", "_words")) + F.size(_c("y", "_words"))).alias("_s_words"), F.least(*[F.size(_c(v, "_words")) for v in "xy"]).alias("_b_words"),
        *[F.size(_both(F.array_intersect, n)).alias(n) for n in ("_starts", "_ends")], F.greatest(*[F.size(_c(v, "_starts")) for v in "xy"]).cast("double").alias("_longest"),
    )
    ratio = lambda n: F.when(F.col(f"_s_{n}") == 0, 0.0).otherwise(F.col(f"_i_{n}") / (F.col(f"_s_{n}") - F.col(f"_i_{n}")).cast("double"))
    # How alike the names are, for kinds whose names count: as text.name_similarity.
    words = F.col("_i_words") / (F.col("_s_words") - F.col("_i_words")).cast("double") + F.col("_starts") / F.col("_longest") * 0.15 + F.col("_ends") / F.col("_longest") * 0.15
    j = j.withColumn("_name", F.when(F.col("_one") & F.col("_kind").isin(*NAMED) & (F.col("_b_words") > 0), text.clamp(text.round3(words))).otherwise(0.0))
    j = j.withColumns({n if n in ("imports", "responsibility", "dep_tokens") else f"_{n}": ratio(n) for n in SETS})
    alike = lambda n: F.when(F.col(f"_s_{n}") == 0, 1.0).otherwise(F.col(n if n in ("imports", "responsibility") else f"_{n}"))
    # The strongest of shared dependencies, their tokens and imports, the latter two discounted.
    j = j.withColumns({"_alike": alike("structural"), "_imported": alike("imports"), "_same": alike("responsibility"), "dep": F.greatest(F.col("_deps"), 0.8 * F.col("dep_tokens"), 0.45 * F.col("imports"))})
    parts: list[tuple[Column, Column]] = [(F.lit(1.0), F.lit(0.2)), (F.col("_alike"), F.lit(0.3)), (F.col("_imported"), F.lit(0.2)), (F.col("_export"), F.lit(0.1)), (F.col("_role"), F.lit(0.1)), (F.col("fits"), F.lit(0.12))]
    for n, w in (("ui", 0.05), ("async_", 0.05), ("responsibility", 0.1), ("deps", 0.12), ("dep_tokens", 0.12)):
        parts.append((F.col(n if n in ("responsibility", "dep_tokens") else f"_{n}"), F.when(F.col(f"_s_{n}") > 0, w).otherwise(0.0)))
    total, weight = F.lit(0.0), F.lit(0.0)
    for v, w in parts:
        total, weight = total + v * w, weight + w
    broad, named, few = F.col("_kind").isin(*BROAD), F.col("_kind").isin(*NAMED), F.col("_fewest") <= 1
    s = total / weight * F.when(F.col("_i_structural") == 0, 0.25).when(few, 0.85).otherwise(1.0) * F.when(F.col("fits") == 0, 0.72).otherwise(1.0)
    j = j.withColumn("_s0", s)
    # Adjustments of the pair, in order.
    s = F.when(broad & (F.col("_alike") < 0.5), F.least(F.col("_s0"), F.lit(0.6))).otherwise(F.col("_s0"))
    j = j.withColumn("_s1", s * F.col("_shown") / 2.0 * F.when(few, 0.9).otherwise(1.0))
    s = F.when(named, 0.85 * F.col("_s1") + 0.15 * F.col("_name")).otherwise(F.col("_s1")) * F.when(F.col("_name") > 0.6, 1.05).otherwise(1.0)
    s = s * F.when(F.col("_same") > 0, 1.0 + F.least(F.lit(0.08), 0.08 * F.col("_same"))).when(F.col("_b_responsibility"), 0.88).otherwise(1.0)
    j = j.withColumn("score", F.when(F.col("_one"), text.round3(text.clamp(s))).otherwise(0.0))
    dep, imports, resp = F.col("dep"), F.col("imports"), F.col("responsibility")
    passes = (
        F.col("_one") & (F.col("score") >= threshold) & (F.col("fits") > 0) & (F.col("_alike") > 0) & ~(broad & (F.col("_alike") < 0.5)) & ~((F.col("align") <= 0.2) & (dep < 0.18))
        & ~((dep < 0.18) & (imports < 0.45) & (resp < 0.55) & (F.col("_ui") == 0) & (F.col("_async_") == 0)) & ~((F.col("fits") < 1) & (dep < 0.34) & (resp < 0.55)) & ~(broad & (dep < 0.18) & (imports < 0.45) & (F.col("_name") < 0.2))
    )
    return j.select(*keep, "score", passes.alias("passes"), "dep", "imports", "responsibility", "dep_tokens", "fits", "align", (F.col("_i_structural") > 0).alias("shares"))


def alignment(side: str) -> Column:
    """How well a pattern is anchored: by resolved dependencies 1, by their tokens 0.8, in an indexed file or unknown 0.6, not indexed 0.2."""
    some = lambda n: F.coalesce(F.size(_c(side, n)), F.lit(0)) > 0
    return F.when(_c(side, "indexed").isNull(), 0.6).when(~_c(side, "indexed"), 0.2).when(some("deps"), 1.0).when(some("dep_tokens"), 0.8).otherwise(0.6)


def _width(df: DataFrame) -> int:
    """Tasks for joins whose results are much larger than their inputs."""
    return 4 * df.sparkSession.sparkContext.defaultParallelism


def _small(df: DataFrame) -> DataFrame:
    """A saved table, to broadcast if it has at most SMALL rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


#: Columns that prepared() reads.
READ = ("kind", "export_shape", "role", "family", "name", "indexed", *SETS)


def keyed(p: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """p with _cls, a hash of all that prepared() reads of a pattern and of the columns `by`: equal hashes, equal scores."""
    of = lambda c: F.coalesce(c, F.lit("\0"))  # noqa: E731  a null counts as a value: the hash passes over nulls
    named = F.when(F.col("kind").isin(*NAMED), F.col("name"))
    sizes = [F.greatest(F.coalesce(F.size(n), F.lit(0)), F.lit(0)) for n in SETS]  # tell ['a'], [] from [], ['a']
    return p.alias("x").withColumn("_cls", F.xxhash64(*[of(F.col(n)) for n in ("kind", "export_shape", "role", "family")], of(named), alignment("x"), *sizes, *SETS, *by))


def profiled(p: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """prepared() and keyed()."""
    return prepared(keyed(p, by))


#: Columns of a profile that blocks are made of: what prepared() makes with hashes for columns is made of these where blocks are packed.
RULED = ("kind", "export_shape", "role", "family", *SETS, "_tokens", "_signals", "_shown", "_anchor")


def _ruled(p: DataFrame, *keep: Column | str) -> DataFrame:
    """(keep, RULED) of patterns."""
    more = {"_tokens": F.when(F.col("kind").isin(*NAMED), text.name_tokens(F.col("name"))), "_signals": F.greatest(F.coalesce(F.size("structural"), F.lit(0)), F.lit(0)), "_shown": representativeness("x"), "_anchor": alignment("x")}
    return p.alias("x").select(*keep, *[more[n].alias(n) if n in more else n for n in RULED])


def profiles(q: DataFrame, by: tuple[str, ...] = (), ident: str = "pattern_id") -> DataFrame:
    """(cls, n, lo, by, RULED): the profiles of rows of keyed(), their sizes and least ids."""
    c = q.groupBy(F.col("_cls").alias("cls")).agg(F.count("*").alias("n"), F.min(ident).alias("lo"), F.first(F.struct(*READ, *by)).alias("_r"))
    return _ruled(c.select("cls", "n", "lo", "_r.*"), "cls", "n", "lo", *by)


def chunked(q: DataFrame, ident: str = "pattern_id", by: tuple[str, ...] = ()) -> DataFrame:
    """(cls, chunk, by, ids): the ids of profiles of rows of keyed(), at most CHUNK a row."""
    at = F.row_number().over(Window.partitionBy("_cls").orderBy(ident))
    return q.withColumn("chunk", F.floor((at - 1) / CHUNK)).groupBy(F.col("_cls").alias("cls"), "chunk", *by).agg(F.collect_list(ident).alias("ids"))


#: Columns of scored() besides those that are kept.
SCORED = "score double, passes boolean, dep double, imports double, responsibility double, dep_tokens double, fits double, align double, shares boolean"


#: Columns of RULED by their different values: what a value is read as.
VALUES = {n: (lambda v: frozenset(v or ())) for n in SETS} | {n: (lambda v: "unknown" if v is None else v) for n in ("export_shape", "role")} | {"family": lambda v: v or "", "_tokens": lambda v: tuple(v or ())}


def _packed(rows: list[dict]) -> dict[str, tuple | np.ndarray]:
    """What _likeness() reads of rows with RULED: of each column of VALUES its different values and the rows' places among them, and the numbers."""
    out: dict[str, tuple | np.ndarray] = {n: np.array([r[n] for r in rows]) for n in ("_signals", "_shown", "_anchor")}
    for n, made in VALUES.items():
        all_ = [made(r[n]) for r in rows]
        at = {v: i for i, v in enumerate(dict.fromkeys(all_))}
        out[n] = list(at), np.array([at[v] for v in all_], np.intp)
    return out


def _ahead(u: tuple, v: tuple) -> int:
    """How many leading elements two tuples share."""
    return next((i for i, (a, b) in enumerate(zip(u, v, strict=False)) if a != b), min(len(u), len(v)))


def _likeness(kind: str, x: dict, y: dict, threshold: float) -> list[np.ndarray]:
    """The columns SCORED of all pairs of two blocks of _packed() rows of one kind, as matrices: scored() with the same operations in the same order.

    What follows from one column is made once for each pair of its different values.
    """
    table = lambda n, f: np.array([[f(u, v) for v in y[n][0]] for u in x[n][0]])
    wide = lambda n, t: t[x[n][1]].take(y[n][1], 1)
    sizes = lambda n: [np.array([len(v) for v in side[n][0]]) for side in (x, y)]
    total = lambda n: np.add.outer(*sizes(n))

    def alike(groups: tuple, same: float, unknown: str | None) -> Callable:
        return lambda u, v: 1.0 if u == v else same if any(u in g and v in g for g in groups) else 0.25 if unknown in (u, v) else 0.0

    def ratio(inter: np.ndarray, total: np.ndarray) -> np.ndarray:
        return np.where(total == 0, 0.0, inter / np.maximum(total - inter, 1).astype(float))

    r3 = lambda v: np.floor(v * 1000.0 + 0.5) / 1000.0
    clip = lambda v: np.minimum(np.maximum(v, 0.0), 1.0)
    inter, every = {n: table(n, lambda u, v: len(u & v)) for n in SETS}, {n: total(n) for n in SETS}
    few_part = {n: ratio(inter[n], every[n]) for n in SETS}
    part = {n: wide(n, v) for n, v in few_part.items()}
    export = wide("export_shape", table("export_shape", alike((("default", "named", "mixed"), ("none", "internal")), 0.5, "unknown")))
    role, fits = wide("role", table("role", alike(ROLE_GROUPS, 0.45, "unknown"))), wide("family", table("family", alike(COMPATIBLE, 0.85, None)))
    align, fewest = np.minimum.outer(x["_anchor"], y["_anchor"]), np.minimum.outer(x["_signals"], y["_signals"])
    name, named, broad = np.zeros(align.shape), kind in NAMED, kind in BROAD
    if named:
        lengths, words = sizes("_tokens"), [[frozenset(v) for v in side["_tokens"][0]] for side in (x, y)]
        longest = np.maximum(np.maximum.outer(*lengths), 1).astype(float)
        both = np.add.outer(*[np.array([len(v) for v in side]) for side in words])
        t = ratio(np.array([[len(u & v) for v in words[1]] for u in words[0]]), both) + table("_tokens", _ahead) / longest * 0.15 + table("_tokens", lambda u, v: _ahead(u[::-1], v[::-1])) / longest * 0.15
        name = wide("_tokens", np.where(np.minimum.outer(*lengths) > 0, clip(r3(t)), 0.0))
    structural, imported, same = (wide(n, np.where(every[n] == 0, 1.0, few_part[n])) for n in ("structural", "imports", "responsibility"))
    dep = np.maximum(np.maximum(part["deps"], 0.8 * part["dep_tokens"]), 0.45 * part["imports"])
    some = lambda n, w: wide(n, np.where(every[n] > 0, w, 0.0))
    parts = [(1.0, 0.2), (structural, 0.3), (imported, 0.2), (export, 0.1), (role, 0.1), (fits, 0.12)]
    parts += [(part[n], some(n, w)) for n, w in (("ui", 0.05), ("async_", 0.05), ("responsibility", 0.1), ("deps", 0.12), ("dep_tokens", 0.12))]
    s, weight = 0.0, 0.0
    for v, w in parts:
        s, weight = s + v * w, weight + w
    few, shares = fewest <= 1, wide("structural", inter["structural"] > 0)
    s = s / weight * np.where(~shares, 0.25, np.where(few, 0.85, 1.0)) * np.where(fits == 0, 0.72, 1.0)
    if broad:
        s = np.where(structural < 0.5, np.minimum(s, 0.6), s)
    s = s * np.add.outer(x["_shown"], y["_shown"]) / 2.0 * np.where(few, 0.9, 1.0)
    s = (0.85 * s + 0.15 * name if named else s) * np.where(name > 0.6, 1.05, 1.0)
    both = wide("responsibility", np.minimum.outer(*sizes("responsibility")) > 0)
    score = r3(clip(s * np.where(same > 0, 1.0 + np.minimum(0.08, 0.08 * same), np.where(both, 0.88, 1.0))))
    imports, resp = part["imports"], part["responsibility"]
    passes = (score >= threshold) & (fits > 0) & (structural > 0) & ~(broad & (structural < 0.5)) & ~((align <= 0.2) & (dep < 0.18))
    passes &= ~((dep < 0.18) & (imports < 0.45) & (resp < 0.55) & (part["ui"] == 0) & (part["async_"] == 0)) & ~((fits < 1) & (dep < 0.34) & (resp < 0.55)) & ~(broad & (dep < 0.18) & (imports < 0.45) & (name < 0.2))
    return [score, passes, dep, imports, resp, part["dep_tokens"], fits, align, shares]


def _blocks(c: DataFrame, on: tuple[str, ...], save: Callable[[DataFrame], DataFrame], size: int | None = None, order: tuple[str, ...] = ("cls",)) -> DataFrame:
    """(kind, _x, _y, _pair, xs, ys): all pairs of blocks of `size` rows (cls, RULED, order) that agree in `on`, a block with itself included.

    A block is packed once: the different cls of its rows with what _likeness() reads of them, the rows' places among these, and the last column of `order`.
    """
    at = F.row_number().over(Window.partitionBy(*on).orderBy(*order))
    rows = c.select(*dict.fromkeys(("cls", *RULED, *on, *order))).withColumn("_block", F.floor((at - 1) / (size or BLOCK)))

    def pack(t: pa.Table) -> pa.Table:
        cls, ids = (np.array(t.column(n).to_pylist(), object if n == "pattern_id" else np.int64) for n in ("cls", order[-1]))
        ends, first, place = np.unique(cls, return_index=True, return_inverse=True)
        rest = t.select(RULED).take(pa.array(first)).to_pylist()
        return t.select([*on, "_block"]).slice(0, 1).append_column("rows", pa.array([pickle.dumps((ends, _packed(rest), place, ids))], pa.binary()))

    kinds = dict(c.dtypes)
    # Sorting by the order within blocks is cheap and makes them the same in every run.
    # Dealt out again: the window leaves all blocks of a kind in one task.
    blocks = save(rows.repartition(_width(c), *on, "_block").groupBy(*on, "_block").applyInArrow(pack, ", ".join(f"`{n}` {kinds[n]}" for n in on) + ", _block long, rows binary"))
    x, y = blocks.alias("x"), blocks.alias("y")
    same = F.lit(True)
    for k in on:
        same = same & (_c("x", k) == _c("y", k))
    ident = lambda v: F.xxhash64(*[_c(v, k) for k in on], _c(v, "_block"))
    pairs = x.join(y, same & (_c("x", "_block") <= _c("y", "_block")))
    return pairs.select(_c("x", "kind").alias("kind"), ident("x").alias("_x"), ident("y").alias("_y"), F.xxhash64(*[_c("x", k) for k in on], "x._block", "y._block").alias("_pair"), _c("x", "rows").alias("xs"), _c("y", "rows").alias("ys"))


def _stars(link: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components as those of a matrix of links: from one end of each part to all that it reaches."""
    ends: list[list[np.ndarray]] = [[], []]
    todo = link.any(1)
    for i in np.flatnonzero(todo):
        if not todo[i]:
            continue
        rows, columns = np.zeros(len(u), bool), np.zeros(len(v), bool)
        new = np.array([i])
        while len(new):
            rows[new] = True
            more = link[new].any(0) & ~columns
            columns |= more
            new = np.flatnonzero(link[:, more].any(1) & ~rows)
        todo &= ~rows
        reached = np.concatenate([u[rows], v[columns]])
        ends[0].append(np.full(len(reached), u[i]))
        ends[1].append(reached)
    return tuple(np.concatenate(e) if e else np.zeros(0, np.int64) for e in ends)


def linked(c: DataFrame, link: Callable[[dict[str, np.ndarray]], np.ndarray], on: tuple[str, ...] = ("kind",), save: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(same, x, y, milli, u, v) of each pair of blocks of compared(): the profiles of both, their scores in thousandths as a matrix of 16-bit numbers, and edges (u, v) that connect what link(SCORED) does."""
    names = [n.split()[0] for n in SCORED.split(", ")]
    kind_of = pa.schema([("same", pa.bool_()), ("bx", pa.int64()), ("x", pa.list_(pa.int64())), ("by", pa.int64()), ("y", pa.list_(pa.int64())), ("milli", pa.binary()), ("u", pa.list_(pa.int64())), ("v", pa.list_(pa.int64()))])

    def run(t: pa.Table) -> pa.Table:
        out = []
        for kind, bx, by, xs, ys in zip(*(t.column(n).to_pylist() for n in ("kind", "_x", "_y", "xs", "ys")), strict=True):
            (x, one, *_), (y, two, *_) = pickle.loads(xs), pickle.loads(ys)
            got = dict(zip(names, _likeness(kind, one, two, THRESHOLD), strict=True))
            u, v = _stars(link(got), x, y)
            out.append({"same": bx == by, "bx": bx, "x": x, "by": by, "y": y, "milli": np.round(got["score"] * 1000).astype("<i2").tobytes(), "u": u, "v": v})
        return pa.Table.from_pylist(out, schema=kind_of)

    return _blocks(c, on, save).repartition(_width(c), "_pair").groupBy("_pair").applyInArrow(run, "same boolean, bx long, x array<long>, by long, y array<long>, milli binary, u array<long>, v array<long>")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (same, milli, x and y as lists of cls, n, component) of linked() -> (cls, s): the scores of a profile with its component's other patterns, added up."""
    for b in batches:
        ids, sums = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in b.to_pylist():
            (x, nx, gx), (y, ny, gy) = ([np.array([m[k] for m in r[side]], np.int64) for k in ("cls", "n", "component")] for side in "xy")
            known = np.array([m["known"] for m in r["x"]], bool)
            s = np.frombuffer(r["milli"], "<i2").reshape(len(x), len(y)).astype(np.int64) * ((gx[:, None] == gy[None, :]) & known[:, None])
            ids.append(x)
            sums.append(s @ ny - (np.diag(s) if r["same"] else 0))
            if not r["same"]:
                ids.append(y)
                sums.append(nx @ s)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(sums))], ["cls", "s"])


def compared(c: DataFrame, on: tuple[str, ...] = ("kind",), columns: tuple[str, ...] = ("score", "passes"), threshold: float = THRESHOLD, save: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(u, v, columns of SCORED): all pairs u <= v of the profiles `cls` of c that agree in `on`, a profile with itself included.

    Profiles are put into blocks, and a task scores two blocks at a time: no task has all of a large kind, and a rule on sets is evaluated once for each pair of different sets.
    """
    pairs = _blocks(c, on, save)
    names = [n.split()[0] for n in SCORED.split(", ")]

    def run(t: pa.Table) -> pa.Table:
        out = []
        for kind, xs, ys in zip(*(t.column(n).to_pylist() for n in ("kind", "xs", "ys")), strict=True):
            (u, one, *_), (v, two, *_) = pickle.loads(xs), pickle.loads(ys)
            once = u[:, None] <= v[None, :] if np.array_equal(u, v) else np.ones((len(u), len(v)), bool)
            ends = [np.broadcast_to(u[:, None], once.shape)[once], np.broadcast_to(v[None, :], once.shape)[once]]
            got = dict(zip(names, _likeness(kind, one, two, threshold), strict=True))
            out.append(pa.table([*ends, *[got[n][once] for n in columns]], names=["u", "v", *columns]))
        return pa.concat_tables(out)

    kinds = ", ".join(n for n in sorted(SCORED.split(", "), key=lambda n: (*columns, n.split()[0]).index(n.split()[0])) if n.split()[0] in columns)
    return pairs.repartition(_width(c), "_pair").groupBy("_pair").applyInArrow(run, f"u long, v long, {kinds}")


def expanded(pairs: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, columns) of pairs (u, v, columns) of profiles: the pairs of their ids, a < b. ids: (cls, chunk, ids), with at most CHUNK ids a row."""
    end = lambda v: ids.select(F.col("cls").alias(v), F.col("chunk").alias(f"_at{v}"), F.col("ids").alias(f"_of{v}"))
    j = pairs.join(end("u"), "u").join(end("v"), "v").where("u <> v or _atu <= _atv")
    j = j.select(((F.col("u") == F.col("v")) & (F.col("_atu") == F.col("_atv"))).alias("_self"), *columns, "_ofv", F.explode("_ofu").alias("_p"))
    j = j.select("_self", *columns, "_p", F.explode("_ofv").alias("_q")).where("not _self or _p < _q")
    return j.select(F.least("_p", "_q").alias("a"), F.greatest("_p", "_q").alias("b"), *columns)


def scored_pairs(p: DataFrame, *, shared_signal: bool, save: Callable[[DataFrame], DataFrame] = lambda df: df, columns: tuple[str, ...] = ("score", "passes", "dep")) -> DataFrame:
    """(a, b, columns of SCORED): pairs of one kind, a < b. With shared_signal, only pairs with a structural signal in common, which clusters need anyway.

    Blocks are of patterns in the order of their profiles: a task scores the profiles of two blocks and writes the pairs of their patterns at once, so no pair is shuffled or joined.
    """
    q = keyed(p).where("pattern_id is not null")
    pairs = _blocks(_ruled(q, F.col("_cls").alias("cls"), "pattern_id"), ("kind",), save, PATTERNS, ("cls", "pattern_id"))
    names = [n.split()[0] for n in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for b in batches for r in b.to_pylist()):
            (_, one, i, x), (_, two, j, y) = pickle.loads(r["xs"]), pickle.loads(r["ys"])
            got = dict(zip(names, _likeness(r["kind"], one, two, THRESHOLD), strict=True))
            ids, at = np.unique(np.concatenate([x, y]), return_inverse=True)
            at, ids = at.astype(np.int32), pa.array(ids, pa.string())
            lo, hi = at[: len(x)], at[len(x) :]
            self, step = r["_x"] == r["_y"], max(1, SENT // len(y))
            for k in range(0, len(x), step):
                u = lo[k : k + step, None]
                some = u < hi if self else u != hi
                if shared_signal:
                    some &= got["shares"][i[k : k + step]].take(j, 1)
                some = slice(None) if some.all() else some.ravel()
                ends = [f(u, hi).ravel()[some] for f in (np.minimum, np.maximum)]
                values = [got[n][i[k : k + step]].take(j, 1).ravel()[some] for n in columns]
                if len(ends[0]):
                    yield pa.RecordBatch.from_arrays([*[ids.take(pa.array(e)) for e in ends], *[pa.array(v) for v in values]], ["a", "b", *columns])

    kinds = dict(n.split() for n in SCORED.split(", "))
    return pairs.repartition(4 * _width(p), "_pair").groupBy("_pair").applyInArrow(run, "a string, b string, " + ", ".join(f"{n} {kinds[n]}" for n in columns))


def find_similar(p: DataFrame, pattern_id: str, limit: int = 6) -> DataFrame:
    """The patterns most like one: (pattern_id, score), same-file ones at nine tenths."""
    q = prepared(p)
    one = F.broadcast(q.where(F.col("pattern_id") == pattern_id)).alias("x")
    j = one.join(q.alias("y"), (F.col("x.kind") == F.col("y.kind")) & (F.col("x.pattern_id") != F.col("y.pattern_id")))
    j = scored(j, {"pattern_id": F.col("y.pattern_id"), "_same_file": F.col("x.file_id") == F.col("y.file_id")})
    s = text.round3(F.col("score") * F.when(F.col("_same_file"), 0.9).otherwise(1.0))
    return j.select("pattern_id", s.alias("score")).where("score > 0").orderBy(F.desc("score"), "pattern_id").limit(limit)


def most_similar(p: DataFrame, k: int, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(pattern_id, other, score, rank): the k patterns most like each one, same-file ones at nine tenths, ties by id.

    A pattern takes from its profile's list all but its own file's. A list of 2 k others, of one file at most k, is therefore long
    enough: without any one file it still has k, and what was left out comes after them. Pairs within files are scored apart.
    """
    q = profiled(p).withColumn("_file", F.coalesce(F.concat(F.lit("f"), "file_id"), F.concat(F.lit("p"), "pattern_id")))
    q = save(q.select("pattern_id", "_file", "_cls", *PREPARED, *[n for n in READ if n not in PREPARED]))
    ids = q.select("_cls", "pattern_id", "_file")
    first = tables.top_k_per_group(ids, ["_cls", "_file"], [F.col("pattern_id")], k).drop("rank", "total")
    first = tables.top_k_per_group(first, ["_cls"], [F.col("pattern_id")], 2 * k).groupBy("_cls").agg(F.collect_list(F.struct("pattern_id", "_file")).alias("ids"))
    first = _small(save(first.withColumnRenamed("_cls", "cls")))
    way = lambda a, b: F.struct(F.col(a).alias("to"), F.col(b).alias("cls"))
    j = save(compared(profiles(q), columns=("score",), save=save)).where("score > 0")
    j = j.select("score", F.explode(F.when(F.col("u") == F.col("v"), F.array(way("u", "v"))).otherwise(F.array(way("u", "v"), way("v", "u")))).alias("w")).select("w.*", "score")
    j = j.join(first, "cls").select(F.col("to").alias("cls"), "score", F.explode("ids").alias("o")).select("cls", "score", F.col("o.pattern_id").alias("other"), F.col("o._file").alias("_of"))
    order = lambda: [F.desc("score"), F.col("other")]
    best = lambda df, keys, n: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order()))).where(F.col("rank") <= n)
    lists = save(best(best(j, ["cls", "_of"], k).drop("rank"), ["cls"], 2 * k).drop("rank"))
    ids = ids.withColumnRenamed("_cls", "cls")
    far = ids.join(lists, "cls").where("_file <> _of").select("pattern_id", "other", "score")
    mates = scored(q.alias("x").join(q.alias("y"), (_c("x", "_file") == _c("y", "_file")) & (_c("x", "kind") == _c("y", "kind")) & (_c("x", "pattern_id") != _c("y", "pattern_id"))), {"pattern_id": _c("x", "pattern_id"), "other": _c("y", "pattern_id")})
    mates = mates.select("pattern_id", "other", F.explode_outer(F.when(F.col("score") > 0, F.array(0.9 * F.col("score")))).alias("score")).where("score is not null")
    both = far.unionByName(mates).withColumn("score", text.round3(F.col("score")))
    return best(both, ["pattern_id"], k).withColumn("rank", F.col("rank").cast("long"))


def precedent_score(score: Column, *, usage: Column, importers: Column, anchored: Column) -> Column:
    """How good a precedent y is for x, 0 to 1 with three decimals: likeness, export, another file, uses, importers, anchor (`high`, `none` or other) and overlaps."""
    shown = F.when(_c("y", "export_shape").isin("default", "named", "mixed"), 0.06).otherwise(0.0)
    apart = F.when(_c("x", "file_id") != _c("y", "file_id"), 0.04).otherwise(0.0)
    few = lambda n: F.least(F.lit(0.04), 0.01 * n)
    anchor = F.when(anchored == "none", 0.0).when(anchored == "high", 0.04).otherwise(0.02)
    part = lambda n: _both(sets.jaccard, n)
    s = 0.82 * score + shown + apart + few(usage) + few(importers) + anchor + 0.05 * part("deps") + 0.04 * part("dep_tokens") + 0.05 * part("responsibility")
    return text.round3(text.clamp(s))


def families(p: DataFrame, member: DataFrame) -> DataFrame:
    """(cluster, family): the most frequent family, then the first by name."""
    n = member.select("pattern_id", "cluster").join(p.select("pattern_id", F.coalesce("family", F.lit("")).alias("family")), "pattern_id").groupBy("cluster", "family").agg(F.count("*").alias("_n"))
    return tables.keep_best(n, ["cluster"], [F.desc("_n"), F.col("family")]).select("cluster", "family")


def _walked(ids: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The component of each of the sorted ids that an edge (u, v) touches, as the place of one of its ids; -1 for others."""
    up = np.arange(len(ids))
    x, y = np.searchsorted(ids, u), np.searchsorted(ids, v)
    while True:
        low = np.minimum(up[x], up[y])
        new = up.copy()
        for end in (up[x], up[y]):
            np.minimum.at(new, end, low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, up):
            break
        up = new
    up[np.setdiff1d(np.arange(len(ids)), np.concatenate([x, y]))] = -1
    return up


def _grouped_once(c: DataFrame, blocks: DataFrame, n_edges: int, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """grouped() of SMALL profiles at most, with family and n as well: the most frequent family of a group (then the first by name) and its patterns.

    The driver holds a few numbers a profile and walks the links; the sums of scores are made where the matrices are.
    """
    spark = c.sparkSession
    of = c.select("cls", "n", "lo", "_signals", F.coalesce("family", F.lit("")).alias("family")).toArrow().sort_by("cls")
    ids, n, signals = (of.column(k).to_numpy() for k in ("cls", "n", "_signals"))
    edges = blocks.select(F.inline(F.arrays_zip("u", "v")).alias("u", "v"))
    if n_edges > graph.SMALL_EDGES:
        edges = graph.forest_components(edges, "u", "v", save).toDF("u", "v")
    edges = edges.toArrow()
    part = _walked(ids, *(edges.column(k).to_numpy() for k in "uv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(len(ids), np.int64)
        for r in (r for b in batches for r in b.to_pylist()):
            x, y = (np.searchsorted(ids, r[side]) for side in "xy")
            s = np.frombuffer(r["milli"], "<i2").reshape(len(x), len(y)).astype(np.int64) * ((part[x][:, None] == part[y][None, :]) & (part[x] >= 0)[:, None])
            out[x] += s @ n[y] - (np.diag(s) if r["same"] else 0)
            if not r["same"]:
                out[y] += n[x] @ s
        some = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], ["at", "s"])

    got = blocks.select("same", "x", "y", "milli").mapInArrow(run, "at long, s long").groupBy("at").agg(F.sum("s").alias("s")).toArrow()
    total = np.zeros(len(ids), np.int64)
    total[got.column("at").to_numpy()] = got.column("s").to_numpy()
    lo, family = (np.array(of.column(k).to_pylist(), object) for k in ("lo", "family"))
    some = np.flatnonzero(part >= 0)
    by_lo = np.unique(lo, return_inverse=True)[1] if len(lo) else np.zeros(0, int)
    order = some[np.lexsort((ids[some], by_lo[some], -signals[some], -total[some], part[some]))]
    rep, least, size = {}, {}, {}
    for i in order.tolist():
        g = int(part[i])
        rep.setdefault(g, i)
        least[g] = min(least.get(g, lo[i]), lo[i])
        counts = size.setdefault(g, {})
        counts[family[i]] = counts.get(family[i], 0) + int(n[i])
    most = {g: min(counts, key=lambda k: (-counts[k], k)) for g, counts in size.items()}
    at = [int(part[i]) for i in order.tolist()]
    columns = {"cls": ids[order], "group": [least[g] for g in at], "rep_cls": [ids[rep[g]] for g in at], "representative": [lo[rep[g]] for g in at], "family": [most[g] for g in at], "n": [sum(size[g].values()) for g in at]}
    kinds = {"cls": pa.int64(), "rep_cls": pa.int64(), "n": pa.int64()}
    return F.broadcast(spark.createDataFrame(pa.table([pa.array(v, kinds.get(k, pa.string())) for k, v in columns.items()], names=list(columns))))


def grouped(c: DataFrame, blocks: DataFrame, save: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, bool]:
    """(cls, group, rep_cls, representative, family, n) of profiles c that have a link, from blocks, linked() written, of all pairs that can be in one group; and whether there are few, SMALL at most.

    group is the least id of a component. Its representative has the largest sum of scores within it, then the most structural
    signals, then the least id; family and n are the group's most frequent family, then the first by name, and its patterns.
    Patterns of other profiles are groups of their own. Up to SMALL profiles are grouped at once, more by joins.
    """
    of = blocks.agg(F.sum(F.size("u")).alias("edges"), F.sum(F.when(F.col("same"), F.size("x"))).alias("profiles")).first()
    if (of["profiles"] or 0) <= SMALL:
        return _grouped_once(c, blocks, of["edges"] or 0, save), True
    lab = graph.forest_components(blocks.select(F.inline(F.arrays_zip("u", "v"))), "u", "v", save)
    of = save(c.select("cls", "n", "lo", F.col("_signals").alias("signals"), F.coalesce("family", F.lit("")).alias("_family")).join(lab.withColumnRenamed("node", "cls"), "cls", "left"))
    # The places of a block's profiles are those of its matrices' rows and columns.
    places = blocks.where("same").select("bx", F.posexplode("x").alias("at", "cls")).join(of, "cls")
    # A profile with no link is in no component: `known` is false.
    member = F.struct("at", "cls", "n", F.coalesce("component", F.lit(0)).alias("component"), F.col("component").isNotNull().alias("known"))
    places = save(places.groupBy("bx").agg(F.sort_array(F.collect_list(member)).alias("m")))
    side = lambda b, v: places.select(F.col("bx").alias(b), F.col("m").alias(v))
    sums = blocks.select("same", "bx", "by", "milli").join(side("bx", "x"), "bx").join(side("by", "y"), "by").select("same", "milli", "x", "y")
    sums = sums.mapInArrow(_sums, "cls long, s long").groupBy("cls").agg(F.sum("s").alias("_sum"))
    of = of.where("component is not null")
    first = F.min(F.struct(-F.coalesce("_sum", F.lit(0)), -F.col("signals"), F.col("lo").alias("lo"), F.col("cls").alias("cls")))
    best = of.join(sums, "cls", "left").groupBy("component").agg(F.min("lo").alias("group"), first.alias("_r")).select("component", "group", F.col("_r.cls").alias("rep_cls"), F.col("_r.lo").alias("representative"))
    f = of.groupBy("component", "_family").agg(F.sum("n").alias("_n"))
    f = f.groupBy("component").agg(F.sum("_n").alias("n"), F.min(F.struct(-F.col("_n"), F.col("_family").alias("family")))["family"].alias("family"))
    return save(of.select("cls", "component").join(best, "component").join(f, "component").select("cls", "group", "rep_cls", "representative", "family", "n")), False


def clusters(p: DataFrame, save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(pattern_id, cluster, representative, family, n, role): components of the gate, core members against the representative."""
    q = save(keyed(p).select("pattern_id", "_cls", *READ))
    c = save(profiles(q))
    # A profile with a link has one cluster, so families, sizes and core members are those of profiles.
    m, few = grouped(c, save(linked(c, lambda s: s["passes"], save=save)), save)
    near = F.broadcast if few else lambda df: df
    rows = F.struct("cls", *RULED)
    x = c.join(m.select(F.col("rep_cls").alias("cls")).distinct(), "cls").select(F.col("cls").alias("rep_cls"), rows.alias("x"))
    j = c.select("cls", rows.alias("y")).join(m.select("cls", "rep_cls", F.col("family").alias("_of")), "cls").join(near(x), "rep_cls")
    core = j.select("x", "y", "_of").mapInArrow(_core, "cls long, core boolean")
    m = q.select("pattern_id", F.col("_cls").alias("cls"), F.coalesce("family", F.lit("")).alias("_own")).join(near(m), "cls", "left").join(near(core), "cls", "left")
    core = F.coalesce("core", F.lit(True)) | (F.col("pattern_id") == F.col("representative"))
    alone = lambda n, otherwise: F.coalesce(n, otherwise).alias(n)
    return m.select("pattern_id", F.coalesce("group", "pattern_id").alias("cluster"), alone("representative", F.col("pattern_id")), alone("family", F.col("_own")), alone("n", F.lit(1).cast("long")), F.when(core, "core").otherwise("peripheral").alias("role"))


def _core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (x, y, family of the cluster) -> (cls of y, core): whether y is a core member of a cluster whose representative is x."""
    names = [n.split()[0] for n in SCORED.split(", ")]
    for b in batches:
        groups: dict[int, list[dict]] = {}
        for r in b.to_pylist():
            groups.setdefault(r["x"]["cls"], []).append(r)
        ids, core = [], []
        for rows in groups.values():
            x, y = rows[0]["x"], [r["y"] for r in rows]
            s = {n: v[0] for n, v in zip(names, _likeness(x["kind"], _packed([x]), _packed(y), THRESHOLD), strict=True)}
            # A cluster has one family.
            fits = np.array([any(g == v or (g in pair and v in pair) for pair in COMPATIBLE) for g, v in ((r["_of"], r["y"]["family"] or "") for r in rows)])
            near = (s["dep"] >= 0.2) | (s["imports"] >= 0.4) | (s["responsibility"] >= 0.5)
            ids += [r["cls"] for r in y]
            core += (fits & (s["score"] >= CORE_SCORE) & (s["align"] >= 0.6) & near).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(core, pa.bool_())], ["cls", "core"])


def cohesion(p: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster, n, same_family_ratio, dependency_overlap, structural_alignment): shares and means, the overlap against the representative; a singleton has overlap 1."""
    m = membership.select(F.col("pattern_id").alias("_member"), "cluster", "representative", F.col("family").alias("_family"))
    j = m.join(p.alias("x"), F.col("representative") == F.col("x.pattern_id")).join(p.alias("y"), F.col("_member") == F.col("y.pattern_id"))
    g = j.groupBy("cluster").agg(
        F.count("*").alias("n"), F.avg((family_similarity(F.col("_family"), _c("y", "family")) > 0).cast("double")).alias("same"),
        F.avg(F.when(F.col("_member") != F.col("representative"), dependency_overlap())).alias("dep"), F.avg(alignment("y")).alias("aligned"),
    )
    return g.select("cluster", "n", text.round3(F.col("same")).alias("same_family_ratio"), text.round3(F.coalesce("dep", F.lit(1.0))).alias("dependency_overlap"), text.round3(F.col("aligned")).alias("structural_alignment"))


def reasons(p: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster, reason): a dependency token that half of the members share (two at least), else the family."""
    t = membership.select("pattern_id", "cluster", "family", "n").join(p.select("pattern_id", F.explode("dep_tokens").alias("_t")), "pattern_id").groupBy("cluster", "_t").agg(F.count("*").alias("_k"))
    top = t.groupBy("cluster").agg(F.max("_k").alias("_k"))
    label = F.lit("runtime")
    for k, v in LABELS.items():
        label = F.when(F.col("family") == k, v).otherwise(label)
    shared = F.coalesce("_k", F.lit(0)) >= F.greatest(F.lit(2), F.ceil(F.col("n") * 0.5))
    plain = F.when(F.col("family").isin(*COMPATIBLE[0]), "same page family").when(F.col("family") == "state_or_store", "shared store pattern").when(F.col("family") == "hook_or_context", "shared hook/context pattern")
    reason = F.when(shared, F.concat(F.lit("shared "), label, F.lit(" dependencies"))).otherwise(F.coalesce(plain, F.concat(F.lit("same "), label, F.lit(" family"))))
    return membership.select("cluster", "family", "n").distinct().join(top, "cluster", "left").select("cluster", reason.alias("reason"))


def related_clusters(p: DataFrame, membership: DataFrame, save: Callable[[DataFrame], DataFrame] = lambda df: df, threshold: float = THRESHOLD) -> DataFrame:
    """(cluster, related): clusters of one kind and incompatible families whose representatives are alike, or depend on the same; both ways."""
    r = membership.select("cluster", F.col("representative").alias("pattern_id"), F.coalesce("family", F.lit("")).alias("_family")).distinct().join(p, "pattern_id")
    # READ has the representative's own family, which scores read, _family is its cluster's.
    q = save(keyed(r, ("_family",)).select("cluster", "_cls", "_family", *READ))
    j = compared(profiles(q, ("_family",), "cluster"), columns=("score", "dep", "responsibility"), save=save)
    far = (F.col("score") < max(threshold - 0.08, RELATED_SCORE)) & (F.col("dep") < 0.5)
    loose = (F.col("dep") < 0.18) & (F.col("responsibility") < 0.55)
    ids = _small(save(chunked(q, "cluster", ("_family",))))
    of = ids.where("chunk = 0")
    end = lambda v: of.select(F.col("cls").alias(v), F.col("_family").alias(f"_f{v}"))
    j = j.where(~far & ~loose).join(end("u"), "u").join(end("v"), "v").where(family_similarity(F.col("_fu"), F.col("_fv")) == 0)
    found = expanded(j.select("u", "v"), ids, [])
    return found.select(F.explode(F.array(F.struct(F.col("a").alias("cluster"), F.col("b").alias("related")), F.struct(F.col("b").alias("cluster"), F.col("a").alias("related")))).alias("r")).select("r.*")


def neighborhoods(b: DataFrame, near: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(cls, cluster, n, token): the rarest dependency token of each profile of b (cls, n, cluster, size, dep_tokens) that names a neighbourhood, within its cluster.

    Tokens of a quarter of the cluster or more (four at least) count only where a profile has no other; generic tokens only where it has none.
    """
    t = b.select("cls", "cluster", "size", "n", F.posexplode("dep_tokens").alias("_at", "token")).withColumn("_generic", F.col("token").isin(*GENERIC_TOKENS))
    k = t.where("not _generic").groupBy("cluster", "token").agg(F.sum("n").alias("_k"))
    t = t.join(near(k), ["cluster", "token"], "left")
    wide = F.coalesce("_k", F.lit(0)) >= F.greatest(F.lit(SUB_MEMBERS), F.floor(F.col("size") * 0.25))
    first = F.min(F.struct("_generic", wide.alias("_wide"), F.when(F.col("_generic"), F.col("_at")).alias("_at"), "_k", "token"))
    return t.groupBy("cls", "cluster", "n").agg(first["token"].alias("token"))


def _parts(b: DataFrame, save: Callable[[DataFrame], DataFrame], few: bool) -> DataFrame:
    """(cls, cluster, sub, way): subclusters() of profiles b (cls, n, lo, cluster, size, rep, RULED) of large clusters; size counts a cluster's patterns, rep tells the profile of its representative."""
    near = F.broadcast if few else lambda df: df
    by_token = save(neighborhoods(b, near))
    sized = by_token.groupBy("cluster", "token").agg(F.sum("n").alias("_k")).where(F.col("_k") >= SUB_MEMBERS)
    split = sized.groupBy("cluster").agg(F.count("*").alias("_parts"), F.max("_k").alias("_largest")).where("_parts >= 2")
    # The representative itself is not compared, others of its profile are.
    j = b.alias("y").join(near(b.where("rep")).alias("x"), F.col("x.cluster") == F.col("y.cluster"))
    j = j.select("y.cluster", (_c("y", "n") - _c("y", "rep").cast("long")).alias("_w"), dependency_overlap().alias("_dep")).where("_w > 0")
    mean = F.sum(F.col("_dep") * F.col("_w")) / F.sum("_w")
    apart = j.groupBy("cluster").agg(text.round3(mean).alias("_mean")).where(F.col("_mean") <= SUB_COHESION)
    wanted = save(apart.select("cluster").union(split.select("cluster")).distinct())
    c = b.join(near(wanted), "cluster")
    c = c if few else save(c)
    link = lambda s: (s["dep"] >= SUB_EDGE) | ((s["dep_tokens"] >= SUB_EDGE) & (s["score"] >= THRESHOLD)) | ((s["imports"] >= 0.5) & (s["responsibility"] >= 0.5))
    of, _ = grouped(c, save(linked(c, link, ("kind", "cluster"), save)), save)
    by_graph = of.where(F.col("n") >= SUB_MEMBERS).select("cls", "group", "representative", F.col("n").alias("_k")).join(c.select("cls", "cluster"), "cls")
    graph_parts = by_graph.select("cluster", "group", "_k").distinct().groupBy("cluster").agg(F.count("*").alias("_gp"), F.max("_k").alias("_gl")).where("_gp >= 2")
    choice = wanted.join(graph_parts, "cluster", "left").join(split, "cluster", "left")
    token = F.col("_gp").isNull() | (F.col("_parts").isNotNull() & ((F.col("_largest") <= F.floor(F.col("_gl") * 0.85)) | (F.col("_parts") > F.col("_gp"))))
    choice = save(choice.where("_gp is not null or _parts is not null").select("cluster", F.when(token, "token").otherwise("graph").alias("way")))
    one = by_token.join(near(sized.select("cluster", "token")), ["cluster", "token"]).join(near(choice.where("way = 'token'")), "cluster").select("cls", "cluster", F.col("token").alias("sub"), "way")
    two = by_graph.join(near(choice.where("way = 'graph'")), "cluster").select("cls", "cluster", F.col("representative").alias("sub"), "way")
    return one.unionByName(two)


def subclusters(p: DataFrame, membership: DataFrame, save: Callable[[DataFrame], DataFrame], parent: int = SUB_PARENT) -> DataFrame:
    """(pattern_id, cluster, sub, way): parts of large clusters of components, by links of dependencies (`graph`) or by neighbourhood tokens (`token`).

    A part has SUB_MEMBERS members, and a cluster two parts. Tokens are taken where the largest part of links is at least as
    lopsided, or where they give more parts. sub is the representative's id, or the token.
    """
    big = membership.where((F.col("family") == "ui_component") & (F.col("n") >= parent)).select("pattern_id", "cluster", "representative", F.col("n").alias("size"))
    q = save(keyed(p.join(big, "pattern_id"), ("cluster",)).select("pattern_id", "cluster", "size", "representative", "_cls", *READ))
    rep = q.where("pattern_id = representative").select(F.col("_cls").alias("cls"), F.lit(True).alias("rep"))
    b = save(profiles(q, ("cluster", "size")).join(rep, "cls", "left").withColumn("rep", F.coalesce("rep", F.lit(False))))
    return q.select("pattern_id", F.col("_cls").alias("cls")).join(_parts(b, save, b.count() <= SMALL), "cls").select("pattern_id", "cluster", "sub", "way")


def cluster_parts(p: DataFrame, save: Callable[[DataFrame], DataFrame], parent: int = SUB_PARENT) -> DataFrame:
    """subclusters() of clusters(), among profiles: patterns are read to make these, and again to name the members of parts. A part has more than one pattern, so those that are clusters of their own do not count."""
    q = keyed(p).where("pattern_id is not null")
    c = save(profiles(q))
    m, few = grouped(c, save(linked(c, lambda s: s["passes"], save=save)), save)
    near = F.broadcast if few else lambda df: df
    big = m.where((F.col("family") == "ui_component") & (F.col("n") >= parent))
    big = big.select("cls", F.col("group").alias("cluster"), F.col("n").alias("size"), (F.col("cls") == F.col("rep_cls")).alias("rep"))
    b = c.join(near(big), "cls")
    b = b if few else save(b)
    return q.select("pattern_id", F.col("_cls").alias("cls")).join(near(_parts(b, save, few)), "cls").select("pattern_id", "cluster", "sub", "way")


def dominant_signals(p: DataFrame, membership: DataFrame, column: str = "structural", k: int = 5) -> DataFrame:
    """The k most frequent values of a set column in each cluster, by count, then name."""
    x = p.select("pattern_id", F.explode(column).alias("signal")).join(membership.select("pattern_id", "cluster"), "pattern_id").groupBy("cluster", "signal").agg(F.count("*").alias("n"))
    return tables.top_k_per_group(x, ["cluster"], [F.desc("n"), F.col("signal")], k).select("cluster", "signal", "n", "rank")
