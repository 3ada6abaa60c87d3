"""Slash-separated paths."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import common_prefix

# Directories whose children are features.
AREA_ROOTS = ("features", "app", "pages", "components", "lib")


def normal(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "/+", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def stem(path: Column) -> Column:
    """The file name up to its first dot, or to a # that numbers a bundle."""
    return F.regexp_extract(base_name(path), r"^([^.#]*)", 1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def feature_area(path: Column) -> Column:
    """The part of a path that names its feature: two segments, or three below src/ where the second is a known root."""
    parts = F.filter(F.split(normal(path), "/"), lambda p: p != "")
    known = lambda i: F.coalesce(F.get(parts, i).isin(*AREA_ROOTS), F.lit(False))
    n = F.when((F.get(parts, F.lit(0)) == "src") & (F.size(parts) >= 3) & known(F.lit(1)), 3).otherwise(2)
    return F.array_join(F.slice(parts, 1, n), "/")


def closeness(a: Column, b: Column) -> Column:
    """Leading path segments that two paths share, file names aside; 1 if the directories are equal and empty."""
    da, db = dir_name(a), dir_name(b)
    return F.when(da == db, F.greatest(F.size(F.split(da, "/")), F.lit(1))).otherwise(common_prefix(F.split(da, "/"), F.split(db, "/")))


def ancestors(path: Column) -> Column:
    """All directories above a path, the root '' included, with their depth."""
    parts = F.split(dir_name(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("dir"), i.alias("depth")))


def resolve_relative(base_dir: Column, spec: Column) -> Column:
    """base_dir/spec with `.` and `..` folded away; null if it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", base_dir, spec), "/"), lambda p: (p != "") & (p != "."))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("at"), F.lit(True).alias("ok"))
    folded = F.aggregate(
        parts,
        start,
        lambda s, p: F.when(p == "..", F.struct(F.slice(s["at"], 1, F.greatest(F.size(s["at"]) - 1, F.lit(0))).alias("at"), (s["ok"] & (F.size(s["at"]) > 0)).alias("ok"))).otherwise(
            F.struct(F.concat(s["at"], F.array(p)).alias("at"), s["ok"].alias("ok"))
        ),
    )
    return F.when(folded["ok"], F.array_join(folded["at"], "/"))


def import_candidates(base_dir: Column, spec: Column, extensions: tuple[str, ...] = (".ts", ".tsx", ".js", ".jsx")) -> Column:
    """The files that an extensionless relative import may mean: as written, with each extension, and index files."""
    at = resolve_relative(base_dir, spec)
    return F.array_compact(F.array(at, *[F.concat(at, F.lit(e)) for e in extensions], *[F.concat(at, F.lit("/index" + e)) for e in extensions]))
