"""The engine's tools over a corpus of tables: files, symbols, edges, text lines and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import graph, tables
from ..sources import extract


@dataclass
class Corpus:
    """files(file_id, repo, path), symbols(symbol_id, file_id, name, kind, exported, start_line, end_line), edges(type, from_id, to_id), lines(file_id, line_no, line), similar(file_id, other, score)."""

    files: DataFrame
    symbols: DataFrame
    edges: DataFrame
    lines: DataFrame
    similar: DataFrame | None = None


#: Edge type -> (strength, weight) in related-file scores.
WEIGHTS = {"import_usage": (3, 19), "call": (3, 18), "api_route_handler": (3, 17), "jsx": (3, 16), "api_propagation": (2, 13), "file_imports_file": (2, 12), "file_reexports_file": (2, 10)}


def bucket(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def respond(tool: str, items: DataFrame, order: Sequence[str | Column], limit: int) -> DataFrame:
    """One row with the tool's JSON envelope: items in order up to limit, the total, and whether any were left out."""
    n = F.row_number().over(Window.orderBy(*order))
    total = items.agg(F.count("*").alias("total"))
    top = items.orderBy(*order).limit(limit).withColumn("_n", n)
    listed = top.agg(F.sort_array(F.collect_list(F.struct("_n", F.struct(*items.columns).alias("item")))).alias("l"))
    both = listed.join(F.broadcast(total), F.lit(True))
    body = F.struct(F.lit(tool).alias("tool"), F.col("l.item").alias("items"), F.col("total"), (F.col("total") > limit).alias("truncated"))
    return both.select(F.to_json(body).alias("response"), F.ceil(F.length(F.to_json(body)) / 4.0).cast("long").alias("estimated_tokens"))


class Engine:
    def __init__(self, corpus: Corpus):
        self.c = corpus

    # -- lookups
    def find_symbol(self, name: str, kind: str | None = None, repo: str | None = None) -> DataFrame:
        if not name.strip():
            raise ValueError("a symbol needs a name")
        s = self.c.symbols.join(self.c.files.select("file_id", "repo", "path"), "file_id").where(F.col("name") == name)
        if kind:
            s = s.where(F.col("kind") == kind)
        return s.where(F.col("repo") == repo) if repo else s

    def rank_symbols(self, name: str, kind: str | None = None, repo: str | None = None) -> DataFrame:
        """Candidates for a name, exact or else in other case, with score and tier."""
        s = self.c.symbols.join(self.c.files.select("file_id", "repo", "path"), "file_id").where(F.lower("name") == name.lower()).withColumn("q", F.lit(1))
        cand = tables.best_tier([s.where(F.col("name") == name), s], ["q"]).drop("q")
        fan = self.c.edges.where(F.col("type") == "file_imports_file").groupBy(F.col("to_id").alias("file_id")).agg(F.count("*").alias("fan_in"))
        freq = F.count("*").over(Window.partitionBy("name"))
        span = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))
        base = F.lower(paths.base_name(F.col("path")))
        hook = F.col("name").rlike("^use[A-Z0-9_]") | base.rlike("wrapper|query|mutation")
        proxy = F.col("path").rlike(r"(^|/)(wrappers|proxies)/") | base.rlike(r"^(index|barrel)\.")
        service = F.col("path").rlike(r"(^|/)services?/")
        tier = F.when(proxy, "proxy").when(hook & (F.coalesce("fan_in", F.lit(0)) <= 1) & ~service, "wrapper").otherwise("canonical")
        yes = lambda c, p: F.when(c, p).otherwise(0)
        j = cand.join(fan, "file_id", "left").withColumn("freq", freq).withColumn("tier", tier)
        score = (
            F.when(F.col("name") == name, 10).otherwise(6) + (yes(F.col("kind") == kind, 5) if kind else 0) + (yes(F.col("repo") == repo, 4) if repo else 0) + yes(F.col("exported"), 3)
            + yes(F.col("tier") == "canonical", 3) + yes(service, 2) + yes(F.col("fan_in") > 1, 1) + yes(span >= 8, 1) - yes(hook, 2) - yes(proxy, 3) - yes(F.col("freq") > 1, F.least(F.col("freq") - 1, F.lit(5)))
        )
        return j.select("symbol_id", "file_id", "repo", "path", "name", "kind", "start_line", "end_line", "tier", score.cast("long").alias("score"))

    def list_symbols(self, file_id: str) -> DataFrame:
        return self.c.symbols.where(F.col("file_id") == file_id)

    def open_file(self, file_id: str, start: int = 1, end: int | None = None) -> DataFrame:
        x = self.c.lines.where((F.col("file_id") == file_id) & (F.col("line_no") >= start))
        x = x.where(F.col("line_no") <= end) if end else x
        return x.select("line_no", F.concat(F.lpad(F.col("line_no").cast("string"), 6, " "), F.lit(" | "), "line").alias("shown"))

    def search_code(self, query: str, repo: str | None = None, path_prefix: str | None = None) -> DataFrame:
        """Lines that match every space-separated term, each a regular expression."""
        f = self.c.files
        if repo:
            f = f.where(F.col("repo") == repo)
        if path_prefix:
            f = f.where(F.col("path").startswith(path_prefix))
        x = self.c.lines.join(f.select("file_id", "repo", "path"), "file_id")
        for term in query.split():
            x = x.where(F.col("line").rlike(term))
        return x.select("repo", "path", "line_no", "line")

    def find_references(self, name: str, repo: str | None = None) -> DataFrame:
        """Lines that use a name, definitions left out, best first."""
        f = self.c.files.where(F.col("repo") == repo) if repo else self.c.files
        defs = self.c.symbols.where(F.col("name") == name).select("file_id", F.col("start_line").alias("line_no"))
        x = self.c.lines.where(extract.is_reference(F.col("line"), name)).join(defs, ["file_id", "line_no"], "left_anti").join(f.select("file_id", "repo", "path"), "file_id")
        return x.select("repo", "path", "line_no", "line", extract.reference_score(F.col("line"), name).cast("long").alias("score"))

    # -- neighbourhoods
    def find_related_files(self, file_id: str) -> DataFrame:
        """Neighbours with score and strength: evidence of edges, shared names, the same repository, closeness of paths."""
        e = graph.incident(self.c.edges, file_id)
        strength, weight = F.lit(1), F.lit(4)
        for kind, (s, w) in WEIGHTS.items():
            hit = (F.col("via") == kind) & (F.col("direction") == "incoming")
            strength, weight = F.when(hit, s).otherwise(strength), F.when(hit, w).otherwise(weight)
        g = e.select(F.col("neighbor").alias("file_id"), strength.alias("s"), weight.alias("w")).groupBy("file_id").agg(F.max("s").alias("strength"), F.max("w").alias("w"), F.count("*").alias("n"))
        t = self.c.files.where(F.col("file_id") == file_id).select(F.col("repo").alias("_r"), F.col("path").alias("_p"))
        names = self.c.symbols.select("file_id", "name").distinct()
        shared = names.join(names.where(F.col("file_id") == file_id).select("name"), "name").groupBy("file_id").agg(F.count("*").alias("k"))
        j = g.join(self.c.files.select("file_id", "repo", "path"), "file_id").join(shared, "file_id", "left").join(F.broadcast(t), F.lit(True))
        noise = F.when(F.col("path").rlike(r"(test|spec)\."), -10).when(F.col("path").contains("stories."), -8).when(F.col("path").contains("demo"), -6).otherwise(0)
        score = F.col("w") + F.col("n") + F.when(F.col("strength") == 3, 8).when(F.col("strength") == 2, 2).otherwise(-1) + 3 * F.coalesce("k", F.lit(0)) + F.when(F.col("repo") == F.col("_r"), 2).otherwise(0)
        score = score + paths.closeness(F.col("path"), F.col("_p")) + noise
        return j.select("file_id", "repo", "path", "strength", score.cast("long").alias("score")).where("score > 0")

    def impact(self, file_id: str, **caps: int) -> DataFrame:
        """(file_id, scope, depth): files that a change reaches, directly and through one more file."""
        hit = graph.incident(self.c.edges, file_id).where("direction = 'incoming'").select("neighbor").distinct()
        direct = hit.join(self.c.files, F.col("neighbor") == F.col("file_id")).select(F.col("file_id").alias("id"), "path")
        nodes = self.c.files.select("file_id", "repo", "path").withColumn("segs", F.size(F.split("path", "/")))
        far = graph.two_hop(direct, self.c.edges.where("type like 'file_%'"), nodes, [F.col("path"), F.col("id")], lambda: [F.col("segs"), F.col("repo"), F.col("path"), F.col("file_id")], **caps)
        return direct.select(F.col("id").alias("file_id"), F.lit("direct").alias("scope"), F.lit(1).alias("depth")).unionByName(far.where(F.col("file_id") != file_id).select("file_id", F.lit("indirect").alias("scope"), F.lit(2).alias("depth")))

    def search_patterns(self, file_id: str) -> DataFrame:
        if self.c.similar is None:
            raise ValueError("the corpus has no fingerprints")
        return self.c.similar.where(F.col("file_id") == file_id).select("other", "score", bucket(F.col("score"), 0.8, 0.55).alias("strength"))

    def find_precedents(self, file_id: str) -> DataFrame:
        own = self.c.files.where(F.col("file_id") == file_id).select(F.col("repo").alias("_r"))
        p = self.search_patterns(file_id).join(self.c.files.select(F.col("file_id").alias("other"), "repo", "path"), "other").join(F.broadcast(own), F.lit(True))
        s = text.round3(text.clamp(0.82 * F.col("score") + F.when(F.col("repo") != F.col("_r"), 0.04).otherwise(0.0)))
        return p.select("other", "repo", "path", s.alias("precedent_score"), "strength")

    # -- composites, as JSON envelopes
    def explore_component(self, name: str, repo: str | None = None, limit: int = 10) -> DataFrame:
        r = self.rank_symbols(name, repo=repo)
        return respond("explore_component", r.withColumn("match", bucket(F.col("score"), 14, 8)), [F.desc("score"), "repo", "path", "start_line", "symbol_id"], limit)

    def collect_refactor_context(self, file_id: str, limit: int = 20) -> DataFrame:
        r = self.find_related_files(file_id)
        return respond("collect_refactor_context", r.withColumn("match", bucket(F.col("score"), 22, 12)), [F.desc("strength"), F.desc("score"), "repo", "path"], limit)

    def plan_change(self, file_id: str, limit: int = 48) -> DataFrame:
        p = self.impact(file_id).join(self.c.files.select("file_id", "repo", "path"), "file_id").withColumn("role", F.when(F.col("depth") == 1, "edit").otherwise("review"))
        return respond("plan_change", p, ["depth", "path", "file_id"], limit)

    def analyze_symbol(self, name: str, repo: str | None = None, limit: int = 20) -> DataFrame:
        s = self.rank_symbols(name, repo=repo).join(graph.degrees(self.c.edges), "file_id", "left")
        area = F.when(F.col("path").rlike("(^|/)services?/"), "service").when(F.col("path").rlike("(^|/)(pages|app)/"), "page").otherwise("module")
        return respond("analyze_symbol", s.withColumn("area", area), [F.desc("score"), "repo", "path", "start_line", "symbol_id"], limit)

    def build_change_context(self, file_id: str, limit: int = 10) -> DataFrame:
        """One envelope of four sections: related files, impact, plan and, where there are fingerprints, precedents."""
        parts = [self.collect_refactor_context(file_id, limit), self.plan_change(file_id, limit)]
        if self.c.similar is not None:
            parts.append(respond("find_precedents", self.find_precedents(file_id), [F.desc("precedent_score"), "other"], limit))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        body = F.concat(F.lit('{"tool":"build_change_context","sections":['), F.array_join(F.sort_array(F.collect_list("response")), ","), F.lit("]}"))
        return out.agg(body.alias("response"), F.sum("estimated_tokens").alias("estimated_tokens"))
