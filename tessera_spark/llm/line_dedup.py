"""Line dedup by a segment-partition edit join.

A line goes if an equal line, or a different line within `tau` edits, comes earlier in the corpus (by document id, then line
number). Lines within tau edits share one of tau + 1 segments in place or shifted by what the edits before it allow, so
substrings are looked up in an index by (length, segment, substring); each candidate pair is verified by a banded
bit-parallel edit distance. Cells with many lines, such as variants of one template, recur: the shared segment is cut out and
the rest is split in the same way, which loses no pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Cells above this size recur, this many times at most.
LEAF = 100
DEPTH = 3
INDEX, PROBE, BOTH = 1, 2, 3


def with_edit_distance(df: DataFrame, a: str, b: str, tau: int, out: str) -> DataFrame:
    """df with `out`: the edit distance of two string columns, or null above tau. Do not filter on it before it is written.

    Bit d of a state is the diagonal `row - column = d - tau`; state e holds the diagonals reached with at most e edits. One
    step of the fold reads one character of b and updates the whole band with shifts, ands and ors. The characters of a are a
    column beside the fold, not part of its state, which would be copied at every step.
    """
    band, mask = range(-tau, tau + 1), (1 << (2 * tau + 1)) - 1

    def step(s: Column, c: Column) -> Column:
        eq = F.lit(0)
        for d in band:
            eq = eq.bitwiseOR(F.when(F.get(F.col("_ed_a"), s["j"] + d) == c, 1 << (d + tau)).otherwise(0))

        def update(e: int, q: Column, new: list[Column]) -> Column:
            """All states from e on, each bound to a variable before the next reads it."""
            if e > tau:
                return F.struct((s["j"] + 1).alias("j"), *[x.alias(f"e{i}") for i, x in enumerate(new)])
            x = s[f"e{e}"].bitwiseAND(q)
            if e:
                p = s[f"e{e - 1}"]
                x = x.bitwiseOR(p).bitwiseOR(F.shiftright(p, 1)).bitwiseOR(F.shiftleft(new[-1], 1)).bitwiseAND(mask)
            return F.transform(F.array(x), lambda v: update(e + 1, q, [*new, v]))[0]

        # No diagonal left: the distance is above tau, whatever follows.
        return F.when(s[f"e{tau}"] == 0, s).otherwise(F.transform(F.array(eq), lambda q: update(0, q, []))[0])

    start = [sum(1 << (tau + d) for d in range(e + 1)) for e in range(tau + 1)]
    zero = F.struct(F.lit(0).alias("j"), *[F.lit(x).alias(f"e{i}") for i, x in enumerate(start)])
    shift = F.length(a) - F.length(b)
    end = F.get(F.array(*[F.lit(1 << i) for i in range(2 * tau + 1)]), shift + tau)
    none = F.array().cast("array<string>")
    df = df.withColumn("_ed_a", F.when(F.col(a) == "", none).otherwise(F.split(a, ""))).withColumn("_ed_b", F.when(F.abs(shift) <= tau, F.when(F.col(b) == "", none).otherwise(F.split(b, ""))))
    df = df.withColumn("_ed_s", F.aggregate("_ed_b", zero, step))
    distance = F.lit(None).cast("int")
    for e in range(tau, -1, -1):
        distance = F.when(F.col(f"_ed_s.e{e}").bitwiseAND(end) != 0, e).otherwise(distance)
    return df.withColumn(out, distance).drop("_ed_a", "_ed_b", "_ed_s")


def _spots(tau: int, first: bool) -> list[tuple[int, int, int]]:
    """The lookups (difference in length, segment, shift) of a line."""
    k1 = tau + 1
    spots = [(d, i, o) for d in range(k1) for i in range(k1) for o in range(max(-i, d - (tau - i)), min(i, d + tau - i) + 1)]
    # Of two lines of one length, the other one finds a shift to the left as a shift to the right.
    return [(d, i, o) for d, i, o in spots if d or o >= 0] if first else spots


def _table(spots: list[tuple[int, int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(o).alias("o"), F.lit(s).alias("s")) for s, (d, i, o) in enumerate(spots)])


def _placed(r: DataFrame, tau: int) -> DataFrame:
    """r (n, d, i, o) with the place of a lookup: m, the length that it looks for, at and len."""
    k1 = tau + 1
    r = r.withColumn("m", F.col("n") - F.col("d"))
    base, over = F.floor(F.col("m") / k1).cast("int"), k1 - F.col("m") % k1
    return r.withColumn("len", base + F.when(F.col("i") >= over, 1).otherwise(0)).withColumn("at", F.col("i") * base + F.greatest(F.lit(0), F.col("i") - over) + F.col("o"))


def _lookups(rows: DataFrame, tau: int, first: bool, keep: tuple[str, ...]) -> DataFrame:
    """(keep, n, d, i, o, s, m, at, len, key) of each lookup of each of rows (x, salt, keep). The lookups are a constant array that each row explodes."""
    # As an outer generator: an inner one would infer a filter on its input.
    r = rows.select(*keep, "x", "salt", F.length("x").alias("n")).select(*keep, "x", "salt", "n", F.explode_outer(_table(_spots(tau, first))).alias("s"))
    r = _placed(r.select(*keep, "x", "salt", "n", "s.d", "s.i", "s.o", "s.s"), tau)
    return r.withColumn("key", F.xxhash64("salt", "i", "m", F.substring("x", F.col("at") + 1, F.col("len")))).where("m >= 0 and at >= 0 and at + len <= n")


def _own() -> Column:
    return (F.col("d") == 0) & (F.col("o") == 0)


def _first_cells(lines: DataFrame, tau: int) -> DataFrame:
    """(h, key, role, delta, at, len, m) of the lookups of all lines under keys where an indexed line meets another line, and how many rows a key has: every line indexes itself and probes all lengths.

    A lookup is shuffled once, as its key, its line's hash and one number; what it says is read from that number again.
    """
    r = _lookups(lines.select("h", "x", F.lit(0).cast("long").alias("salt")), tau, True, ("h",))
    r = r.select("key", "h", (F.col("n").cast("long") * 256 + F.col("s")).alias("spot"))
    own = [s for s, (d, _, o) in enumerate(_spots(tau, True)) if not d and not o]
    w = Window.partitionBy("key")
    indexed = F.max((F.col("spot") % 256).isin(*own)).over(w)
    r = r.select("key", "h", "spot", F.min("h").over(w).alias("_lo"), F.max("h").over(w).alias("_hi"), indexed.alias("_in"), F.count("*").over(w).alias("_m")).where("_lo <> _hi and _in").distinct()
    r = r.select("h", "key", "_m", F.floor(F.col("spot") / 256).cast("int").alias("n"), F.get(_table(_spots(tau, True)), (F.col("spot") % 256).cast("int")).alias("s"))
    r = _placed(r.select("h", "key", "_m", "n", "s.d", "s.i", "s.o"), tau)
    return r.select("h", "key", F.when(_own(), BOTH).otherwise(PROBE).alias("role"), F.col("d").alias("delta"), "at", "len", F.col("_m").alias("m"))


def _cells(rows: DataFrame, tau: int) -> DataFrame:
    """(h, x, key, role, delta, at, len) of each lookup of each of rows (h, x, salt, role, delta), which keep their roles and differences in length."""
    r = _lookups(rows, tau, False, ("h", "role", "delta"))
    indexes, probes = _own() & (F.col("role").bitwiseAND(INDEX) != 0), (F.col("d") == F.col("delta")) & (F.col("role").bitwiseAND(PROBE) != 0)
    role = F.when(indexes, INDEX).otherwise(0) + F.when(probes, PROBE).otherwise(0)
    return r.select("h", "x", "key", role.alias("role"), F.col("d").alias("delta"), "at", "len").where("role <> 0")


def _shared(cells: DataFrame) -> DataFrame:
    """Keys under which an indexed line meets another line, with the number of rows."""
    return cells.groupBy("key").agg(F.min("h").alias("lo"), F.max("h").alias("hi"), F.bit_or("role").alias("roles"), F.count("*").alias("m")).where("lo <> hi and roles = 3").select("key", "m")


def _small(table: DataFrame) -> DataFrame:
    """A materialized table, to be broadcast if its bytes are few."""
    few = common.bounded(table)
    return table if few is None else few


def profile(x: str) -> Column:
    """64 parities: each pair of neighbouring characters toggles the bit of its hash. An edit toggles four at most."""
    cs = F.split(F.col(x), "")
    pairs = F.zip_with(F.slice(cs, 1, F.greatest(F.size(cs) - 1, F.lit(0))), F.slice(cs, 2, F.size(cs)), lambda a, b: F.xxhash64(a, b))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, v: s.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), v.bitwiseAND(63).cast("int"))))


def plausible(a: str, b: str, tau: int) -> Column:
    """A condition that strings within tau edits meet: of 2 (tau + 1) pieces of a, all but tau occur in b."""
    k = 2 * (tau + 1)
    n = F.length(a)
    cut = [F.floor(n * i / k).cast("int") for i in range(k + 1)]
    found = F.lit(0)
    for i in range(k):
        found = found + F.contains(F.col(b), F.substring(a, cut[i] + 1, cut[i + 1] - cut[i])).cast("int")
    return found >= k - tau


def near_pairs(lines: DataFrame, tau: int) -> DataFrame:
    """(a, b) with a < b: hashes of different lines within tau edits, from lines (h, x); equal rows may repeat."""
    rows = pairs = texts = None
    for depth in range(DEPTH + 1):
        if texts is None:  # all lines: they come to the join without their text, which is read again for those that meet
            met = common.materialize(_first_cells(lines, tau), "met")
            some = common.materialize(met.select("h").distinct(), "lines")
            texts = lines.join(_small(some), "h").groupBy("h").agg(F.first("x").alias("x"))
            texts = common.materialize(texts.select("h", "x", profile("x").alias("bits")), "texts")
            met = met.join(_small(texts), "h")
        else:
            cells = _cells(rows, tau)
            shared = common.materialize(_shared(cells), "shared")
            met = cells.join(_small(shared), "key").distinct().join(_small(texts).select("h", "bits"), "h")
        met = common.materialize(met, "cells")
        small = met if depth == DEPTH else met.where(F.col("m") <= LEAF)
        x, y = small.where(F.col("role").bitwiseAND(INDEX) != 0).alias("x"), small.where(F.col("role").bitwiseAND(PROBE) != 0).alias("y")
        alike = F.bit_count(F.col("x.bits").bitwiseXOR(F.col("y.bits"))) <= 4 * tau
        p = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.h") != F.col("y.h")) & alike & plausible("x.x", "y.x", tau)).select(F.least("x.h", "y.h").alias("a"), F.greatest("x.h", "y.h").alias("b"))
        pairs = p if pairs is None else pairs.union(p)
        large = met.where(F.col("m") > LEAF)
        if depth == DEPTH or not large.limit(1).count():
            break
        rest = F.concat(F.substring("x", F.lit(1), F.col("at")), F.substring("x", F.col("at") + F.col("len") + 1, F.length("x")))
        rows = common.materialize(large.select("h", rest.alias("x"), F.col("key").alias("salt"), "role", "delta").distinct(), "rest")
    pairs = pairs.distinct()
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("x").alias("xa")), "a").join(texts.select(F.col("h").alias("b"), F.col("x").alias("xb")), "b")
    measured = with_edit_distance(both.where("xa <> xb"), "xa", "xb", tau, "d").select("a", "b", "d")
    return common.materialize(measured, "measured").where("d is not null").select("a", "b").distinct()


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, near_chars: int = 40) -> DataFrame:
    """docs with the cleaned text in place of the text, plus n_lines, n_equal and n_near (lines dropped of each kind).

    Every line with a word takes part. Two different lines are near only from near_chars characters on: in short ones, tau
    edits make another word. Blank lines stay. Order: by id (null last), then by a hash of the text, then by line number. Rows that repeat both id and text are one document and get one
    result. Null texts stay null, with no lines; empty tables give no rows. Other columns keep their names, clashes with the three
    counts apart.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_equal", "n_near")]
    docs = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # no name can clash
    id_col, text_col = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    rk = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("~")), F.col(text_col))
    long = docs.select(rk.alias("rk"), F.col(id_col).isNull().alias("last"), F.col(id_col).alias("id"), F.posexplode_outer(F.split(text_col, "\n")).alias("pos", "x")).where(F.btrim("x", F.lit(common.SPACE_CHARS)) != "")
    h = F.xxhash64("x").alias("h")
    occ = common.materialize(long.select("rk", F.struct("last", "id", "rk", "pos").alias("o"), "pos", h, F.xxhash64(F.lit(1), "x").alias("h2")), "occurrences")
    classes = occ.groupBy("h", "h2").agg(F.min("o").alias("o"), (F.min("o") != F.max("o")).alias("many"))
    classes = common.materialize(classes, "classes")
    near = near_pairs(long.where(F.length("x") >= near_chars).select(h, "x"), tau)
    # The later line of a near pair goes.
    ends = near.select(F.col("a").alias("h"), F.col("b").alias("other")).union(near.select(F.col("b"), F.col("a")))
    firsts = classes.select("h", "h2", "o")
    later = ends.join(firsts, "h").join(firsts.select(F.col("h").alias("other"), F.col("o").alias("o2")), "other").where("o2 < o").select("h", "h2").distinct().withColumn("near", F.lit(True))
    going = classes.join(later, ["h", "h2"], "left").where("many or near").select("h", "h2", F.col("o").alias("first"), F.coalesce("near", F.lit(False)).alias("near"))
    going = common.materialize(going, "going")  # a join of two shuffles alone, so that a hot line's can be split
    dropped = occ.join(going, ["h", "h2"]).where("near or o <> first").select("rk", "pos", (F.col("o") != F.col("first")).alias("equal")).distinct()
    of_doc = dropped.groupBy("rk").agg(F.collect_list("pos").alias("_gone"), F.count_if("equal").alias("_eq"), F.count_if(~F.col("equal")).alias("_nr"))
    of_doc = common.materialize(of_doc, "of-doc")
    out = docs.withColumn("_rk", rk).join(_small(of_doc), F.col("_rk") == F.col("rk"), "left")
    # Bound to a variable: a column beside it would be moved into the lambda, and the text split again for each of its lines.
    left = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("_gone"))
    cleaned = F.transform(F.array(F.split(F.col(text_col), "\n")), lambda ls: F.array_join(F.transform(left(ls), lambda i: F.get(ls, i)), "\n"))[0]
    cleaned = F.when(F.col("_gone").isNull(), F.col(text_col)).otherwise(cleaned)
    keep = [(cleaned if f"c{i}" == text_col else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)]
    n_lines = F.coalesce(F.length(text_col) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    return out.select(*keep, n_lines.alias("n_lines"), F.coalesce("_eq", F.lit(0)).cast("long").alias("n_equal"), F.coalesce("_nr", F.lit(0)).cast("long").alias("n_near"))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(common.read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def drop_lines(docs: DataFrame) -> DataFrame:
    """docs with their columns, texts cleaned; a document of which no word is left goes, one that had none stays."""
    out = dedup_lines(docs)
    return out.where((common.n_words(F.col("text")) > 0) | (F.col("n_equal") + F.col("n_near") == 0)).select(docs.columns)
