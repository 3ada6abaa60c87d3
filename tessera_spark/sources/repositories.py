"""Source trees as tables: files, manifests, classes and scopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths

# Directories that are never walked, languages by extension, generated directories and file names, paths that are not indexed, and scopes of what search shows.
PRUNED = (".git", "node_modules", ".next", "dist", "build", "coverage")
LANGUAGES = {".js": "js", ".jsx": "jsx", ".ts": "ts", ".tsx": "tsx"}
GENERATED_DIRS = (".next", ".turbo", ".cache", "out", "storybook-static", "generated")
GENERATED_RE = r"(\.d\.ts|\.generated\.(js|jsx|ts|tsx)|\.min\.(js|jsx))$"
SKIPPED = ((r"^\.github/", "automation"), (r"^bench/", "benchmark"), (r"/src/compiled/", "compiled"))
FIXTURE_DIRS = ("__fixtures__", "__snapshots__", "fixture", "fixtures", "snapshot", "snapshots")
SCOPES = {
    "style_or_asset": ".avif .bmp .css .eot .gif .ico .jpeg .jpg .less .mp3 .mp4 .otf .pdf .png .sass .scss .svg .ttf .wav .webm .webp .woff .woff2",
    "data_or_config": ".conf .env .graphql .gql .ini .json .json5 .jsonc .lock .toml .yaml .yml",
    "documentation": ".adoc .md .mdx .rst .txt",
    "template_or_markup": ".astro .hbs .handlebars .html .htm .liquid .njk .svelte .twig .vue .xml",
}
DATA_NAMES = (".env", ".env.example", ".env.local", "bun.lockb", "package-lock.json", "pnpm-lock.yaml", "yarn.lock")
# What makes a directory a repository, and what search leaves out, in any case.
REPOSITORY_MARKS = (".git", "package.json", "tsconfig.json", "next.config.ts", "next.config.js")
UNSEARCHED_DIRS = (".git", "node_modules", "dist", "build", "coverage", ".next", ".turbo", ".cache", "out", "storybook-static", "generated")
UNSEARCHED_NAMES = (".ds_store",)
UNSEARCHED_ENDS = (".d.ts", ".generated.js", ".generated.jsx", ".generated.ts", ".generated.tsx", ".min.js", ".min.jsx", ".tmp", ".temp", ".swp", ".swo", "~")


def list_repositories(spark: SparkSession, root: str) -> DataFrame:
    """(id, root, is_git): the root itself if it carries a mark of a repository, else its directories, by name. Any file system that Spark reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    marked = lambda at, names: any(fs.exists(path(f"{at}/{n}")) for n in names)
    root = root.rstrip("/")
    if marked(root, REPOSITORY_MARKS):
        rows = [(root.rsplit("/", 1)[-1], root, marked(root, (".git",)))]
    else:
        found = [x.getPath() for x in fs.listStatus(path(root)) if x.isDirectory()]
        rows = sorted((x.getName(), x.toString(), marked(x.toString(), (".git",))) for x in found)
    return spark.createDataFrame(rows, "id string, root string, is_git boolean")


def unsearched(path: Column) -> Column:
    """Whether search, and the fingerprint of what it shows, leaves a file out."""
    low = F.lower(paths.normal(path))
    name, out = paths.base_name(low), F.lit(False)
    for end in UNSEARCHED_ENDS:
        out = out | name.endswith(end)
    return out | _inside(low, UNSEARCHED_DIRS) | name.isin(*UNSEARCHED_NAMES)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(repo, path, size, mtime_ms, sha256, text) of every file below root/<repo>/..., pruned directories left out.

    A root may be any path that Spark reads. Files whose bytes are not UTF-8 keep what decodes.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    at = F.regexp_replace(F.col("path"), r"^[a-z]+:/+", "/")
    rel = F.substring_index(at, root.rstrip("/").split("://")[-1].rstrip("/") + "/", -1)
    rows = raw.select(
        F.substring_index(rel, "/", 1).alias("repo"), F.regexp_replace(rel, r"^[^/]*/", "").alias("path"), F.col("length").alias("size"),
        (F.unix_micros("modificationTime") / 1000.0).alias("mtime_ms"), F.sha2("content", 256).alias("sha256"), F.col("content").cast("string").alias("text"),
    )
    return rows.where(~F.arrays_overlap(F.split(paths.dir_name(F.col("path")), "/"), F.array(*[F.lit(x) for x in PRUNED])))


def manifest(files: DataFrame) -> DataFrame:
    """(key, repo, path, size, mtime_ms, sha256); order it by key where order matters."""
    return files.select(F.concat_ws("/", "repo", "path").alias("key"), "repo", "path", "size", "mtime_ms", "sha256")


def language(path: Column) -> Column:
    ext, out = paths.extension(path), F.lit(None).cast("string")
    for e, name in LANGUAGES.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def _inside(path: Column, names: tuple[str, ...]) -> Column:
    """Whether a segment of the path, its file name included, is one of names."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(n) for n in names]))


def classify(path: Column) -> Column:
    """generated, source or unknown: by directory and name, then by extension."""
    path = paths.normal(path)
    return F.when(_inside(path, GENERATED_DIRS) | F.lower(path).rlike(GENERATED_RE), "generated").when(language(path).isNotNull(), "source").otherwise("unknown")


def skip_reason(path: Column) -> Column:
    """Why policy leaves a source file out of the symbol index, or null."""
    out = F.lit(None).cast("string")
    for pattern, reason in reversed(SKIPPED):
        out = F.when(paths.normal(path).rlike(pattern), reason).otherwise(out)
    return out


def scope(path: Column) -> Column:
    """What a file that search shows is to coverage: relevant_source, or the first reason why it is not."""
    low = F.lower(paths.normal(path))
    name, ext = paths.base_name(low), paths.extension(low)
    out = F.when(classify(path) == "source", "relevant_source").when(_inside(low, FIXTURE_DIRS) | name.endswith(".snap"), "fixture_or_snapshot")
    for kind, extensions in SCOPES.items():
        hit = ext.isin(*extensions.split())
        out = out.when(hit | name.isin(*DATA_NAMES) if kind == "data_or_config" else hit, kind)
    return out.otherwise("other_non_source")


def line_range(text: Column, start: int, end: int) -> Column:
    """Lines start to end of a text, counted from 1, both included."""
    if start < 1 or end < start:
        raise ValueError(f"no line range: {start} to {end}")
    return F.array_join(F.slice(F.split(text, r"\r?\n"), start, end - start + 1), "\n")


def safe_path(path: str) -> str:
    """A repository-relative path, or ValueError if it escapes the repository."""
    parts: list[str] = []
    for p in path.replace("\\", "/").split("/"):
        if p == "..":
            if not parts:
                raise ValueError(f"path leaves the repository: {path}")
            parts.pop()
        elif p not in ("", "."):
            parts.append(p)
    return "/".join(parts)
