"""Secret scans: candidates by shape, false positives removed by a random forest.

The forest (Spark's own, on the JVM) learns from labelled findings: candidate length, character transitions, dictionary
coverage, the document's path and the neighbouring words. The same column expressions make the features of the labelled
findings and of the candidates.
"""

from __future__ import annotations

import random
import string
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: A candidate: at least this many characters of a key's alphabet in one word, with a digit or a capital after a small letter.
MIN_CHARS = 16
CANDIDATE_RE = r"[A-Za-z0-9+/_.\-]{16,}={0,2}"
SHAPE_RE = "[0-9]|[a-z][A-Z]"
PIECE_RE = rf"(?s)(.*?)({CANDIDATE_RE}|\z)"
PRIVATE_KEY_RE = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
# Words that real keys do not consist of, pairs of letters that are frequent in words, words around keys, words around other long strings, telling paths.
DICTIONARY = (
    "about", "access", "account", "action", "active", "address", "admin", "after", "agent", "album", "api", "archive", "article", "asset", "attachment", "before", "blog", "body", "book", "border", "build", "button", "cache",
    "card", "cart", "category", "change", "changeme", "channel", "class", "client", "code", "color", "column", "command", "comment", "common", "component", "config", "contact", "container", "content", "context", "control",
    "count", "create", "data", "date", "default", "delete", "demo", "detail", "document", "domain", "download", "dummy", "edit", "element", "email", "error", "event", "example", "export", "factory", "feature", "field", "file",
    "filter", "folder", "font", "foo", "form", "format", "forum", "function", "gallery", "get", "global", "group", "handler", "hash", "header", "help", "here", "history", "home", "http", "icon", "image", "import", "index",
    "info", "input", "insert", "internal", "invoice", "item", "job", "key", "label", "language", "layout", "left", "length", "lib", "library", "line", "link", "list", "local", "login", "main", "manager", "media", "member", "menu",
    "message", "method", "model", "module", "name", "network", "news", "node", "number", "object", "option", "order", "other", "output", "page", "parent", "parser", "password", "path", "placeholder", "player", "plugin", "post",
    "price", "private", "process", "product", "profile", "project", "property", "provider", "public", "query", "random", "record", "release", "report", "request", "resource", "response", "result", "return", "right", "sample",
    "search", "secret", "section", "select", "server", "service", "session", "set", "setting", "shop", "source", "src", "start", "state", "status", "store", "string", "style", "support", "table", "template", "test", "text",
    "the", "theme", "time", "title", "token", "type", "update", "user", "value", "version", "view", "widget", "www", "xxx", "your",
)
PAIRS = ("al", "an", "ar", "as", "at", "ce", "ch", "co", "de", "ea", "ed", "el", "en", "er", "es", "ha", "he", "hi", "ic", "in", "io", "is", "it", "le", "li", "ll", "ma", "me", "nd", "ne", "ng", "nt", "of", "om", "on", "or", "ou", "ra", "re", "ri", "ro", "se", "si", "st", "te", "th", "ti", "to", "ur", "ve")
KEY_WORDS = ("api_key", "apikey", "auth", "bearer", "credential", "key", "passwd", "password", "pwd", "secret", "token")
OTHER_WORDS = ("account", "card", "checksum", "commit", "digest", "etag", "hash", "id", "iban", "integrity", "invoice", "isbn", "md5", "order", "phone", "revision", "sha1", "sha256", "tel", "uuid", "version")
TEST_PATHS = ("demo", "doc", "example", "fixture", "mock", "sample", "spec", "test")

FEATURES = ["f_len", "f_digit", "f_upper", "f_lower", "f_hex", "f_sep", "f_switch", "f_letter_digit", "f_digit_letter", "f_lower_upper", "f_pairs", "f_run", "f_vowel", "f_distinct", "f_dict", "f_keyword", "f_otherword", "f_assign", "f_path"]


@dataclass(frozen=True)
class Params:
    labelled_per_kind: int = 120
    trees: int = 24
    depth: int = 7
    threshold: float = 0.5
    seed: int = 3


def with_features(df: DataFrame) -> DataFrame:
    """Adds FEATURES to rows (value, before, after, path)."""
    v, n = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    any_of = lambda c, ws: F.regexp_like(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(^|[^a-z0-9])(" + "|".join(ws) + r")([^a-z0-9]|$)")).cast("double")
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d")
    near = F.concat_ws(" ", F.col("before"), F.col("after"))
    out = {
        "f_len": F.least(n, F.lit(200.0)),
        "f_digit": share("[0-9]"),
        "f_upper": share("[A-Z]"),
        "f_lower": share("[a-z]"),
        "f_hex": share("[0-9a-f]"),
        "f_sep": share(r"[._/\-]"),
        # Transitions: between lower case, upper case and digits in all and by kind, frequent pairs of letters, and the longest stretch of one class.
        "f_switch": (F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1) / n,
        "f_letter_digit": share("[A-Za-z](?=[0-9])"),
        "f_digit_letter": share("[0-9](?=[A-Za-z])"),
        "f_lower_upper": share("[a-z](?=[A-Z])"),
        "f_pairs": share(f"(?i)(?=({'|'.join(PAIRS)}))"),
        "f_run": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(classes, F.lit(r"l+|u+|d+"), F.lit(0)), F.length)), F.lit(0)) / n,
        "f_vowel": share("[aeiouAEIOU]"),
        "f_distinct": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(64.0)),
        "f_dict": F.length(F.array_join(F.regexp_extract_all(F.lower(v), F.lit("(" + "|".join(sorted(DICTIONARY, key=lambda w: (-len(w), w))) + ")"), F.lit(1)), "")) / n,
        "f_keyword": any_of(F.col("before"), KEY_WORDS),
        "f_otherword": any_of(near, OTHER_WORDS),
        "f_assign": F.regexp_like(F.coalesce(F.col("before"), F.lit("")), F.lit(r"[=:]\s*$")).cast("double"),
        "f_path": any_of(F.col("path"), TEST_PATHS),
    }
    return df.withColumns({k: F.coalesce(c.cast("double"), F.lit(0.0)) for k, c in out.items()})


def labelled_findings(p: Params = Params()) -> list[tuple[str, str, str, str, float]]:
    """(value, before, after, path, label) by rule: keys of the usual makes in the usual places, and what is mistaken for them."""
    rng = random.Random(p.seed)
    pick = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    hexa, alnum = "0123456789abcdef", string.ascii_letters + string.digits
    secret_before = ["token =", "api_key:", "secret =", "password:", "Authorization: Bearer", "export API_TOKEN =", "client_secret =", "auth_token =", "key ="]
    plain_before = ["the file", "see", "was stored as", "and the", "of", "in", ""]
    other_before = ["commit", "sha256", "md5 checksum", "order", "invoice id", "uuid", "card", "revision", "account", "etag:", "phone"]
    paths = ["src/app.py", "config/prod.yaml", "src3", "notes.txt", "deploy/env", "src12"]
    words = [w for w in DICTIONARY if len(w) > 3]
    dashed = lambda: "-".join(rng.choice(words) for _ in range(rng.randint(3, 5))) + str(rng.randint(1, 99))
    uuid = lambda: "-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12))
    makes = [lambda: pick(hexa, 40), lambda: pick(hexa, 32), lambda: pick(hexa, 64), lambda: pick(alnum, rng.randint(20, 44)), lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16), lambda: "ghp_" + pick(alnum, 36), lambda: "sk_live_" + pick(alnum, 24), lambda: pick(string.ascii_letters, rng.randint(24, 40)), lambda: pick(alnum + "+/", 40), lambda: "-".join(pick(alnum, n) for n in (11, 12, 24))]
    camel = lambda: rng.choice(words) + "".join(w.capitalize() for w in rng.sample(words, 3))
    fakes = [
        (dashed, plain_before + secret_before), (uuid, plain_before + other_before), (lambda: pick(string.digits, rng.randint(16, 24)), plain_before + other_before),
        (lambda: pick(hexa, 40), other_before), (lambda: pick(hexa, 64), other_before), (lambda: pick(hexa, 32), other_before),
        (lambda: "your-api-key-here-" + pick(string.digits, 3), secret_before), (lambda: pick("x0", 1) * rng.randint(16, 40) + "1", secret_before),
        (lambda: f"www.{rng.choice(words)}.com/{rng.choice(words)}/{rng.randint(1, 9999)}/{rng.choice(words)}", plain_before), (lambda: "/".join(rng.choice(words) for _ in range(4)) + f"/v{rng.randint(1, 9)}.{rng.randint(0, 9)}", plain_before),
        (camel, plain_before + secret_before), (lambda: "/".join([*rng.sample(words, 2), camel() + ".java"]), plain_before + ["import", "at"]), (lambda: camel() + str(rng.randint(1, 999)), plain_before),
        (lambda: f"{rng.choice(words)}.{rng.choice(words)}.{camel()}", plain_before), (lambda: "-".join(rng.sample(words, 4)) + f"-{rng.randint(2000, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}.html", plain_before),
        (lambda: "".join(rng.choice(["th", "er", "ion", "en", "re", "la", "os"]) for _ in range(9)) + str(rng.randint(1, 9)), plain_before),
    ]
    out = []
    for make in makes:
        out += [(make(), rng.choice(secret_before), rng.choice(["", "and", "for"]), rng.choice(paths), 1.0) for _ in range(p.labelled_per_kind)]
    for make in makes[4:7]:  # makes that tell by themselves
        out += [(make(), rng.choice(plain_before), "", rng.choice(paths), 1.0) for _ in range(p.labelled_per_kind)]
    for make, before in fakes:
        out += [(make(), rng.choice(before), rng.choice(["", "and", "is"]), rng.choice(paths), 0.0) for _ in range(p.labelled_per_kind)]
    for make in makes:  # keys of examples and tests are no findings
        out += [(make(), rng.choice(secret_before), "", rng.choice(["tests/test_auth.py", "docs/example.md", "fixture/keys"]), 0.0) for _ in range(p.labelled_per_kind // 4)]
    return out


def fit(spark: SparkSession, findings: DataFrame | None = None, p: Params = Params()):
    """The forest over labelled findings (value, before, after, path, label); by default those of labelled_findings()."""
    if findings is None:
        names = ("value", "before", "after", "path", "label")
        rows = [dict(zip(names, x, strict=True)) for x in labelled_findings(p)]
        findings = common.local_table(spark, rows, "value: string, before: string, after: string, path: string, label: double").coalesce(1)
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(with_features(findings))
    return RandomForestClassifier(numTrees=p.trees, maxDepth=p.depth, seed=p.seed, featureSubsetStrategy="sqrt").fit(vectors)


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """(id, word, value, before, after, path) of each candidate, word counting from 0.

    Every match of a word that has a digit, or a capital after a small letter, is a candidate. Its neighbours are the words around and, inside its own word, what
    lies between it and the matches beside it, with the match before it (which can be the key's name).
    """
    ws = F.col("ws")
    base = docs.select(F.col(id_col).alias("id"), (F.col(path_col) if path_col else F.lit("")).alias("path"), common.words(F.col(text_col)).alias("ws"))
    at = F.filter(F.sequence(F.lit(0), F.size(ws) - 1), lambda i: (F.length(F.get(ws, i)) >= MIN_CHARS) & F.get(ws, i).rlike(SHAPE_RE) & F.get(ws, i).rlike(CANDIDATE_RE))
    # No filters on computed columns before the generator: Catalyst would push them down with a split inside each lambda.
    at = F.when(F.size(ws) > 0, at)
    hits = base.withColumn("at", at).select("id", "path", "ws", F.explode_outer("at").alias("word")).where("word is not null")
    # A word falls into matches v, each after a gap g; the last gap is the word's tail, with an empty v. b is the match before, n the gap and nv the match after.
    gaps, values = (F.regexp_extract_all(F.get(ws, F.col("word")), F.lit(PIECE_RE), F.lit(i)) for i in (1, 2))
    rest = lambda parts: F.slice(parts, 2, F.size(parts))
    pieces = F.arrays_zip(values.alias("v"), gaps.alias("g"), F.concat(F.array(F.lit(None).cast("string")), values).alias("b"), rest(gaps).alias("n"), rest(values).alias("nv"))
    each = hits.select("id", "path", "ws", "word", F.explode_outer(F.filter(pieces, lambda x: x["v"].rlike(SHAPE_RE))).alias("m")).where("m is not null")
    words_before = F.concat_ws(" ", F.slice(ws, F.greatest(F.lit(1), F.col("word") - 2), F.least(F.col("word"), F.lit(3))))
    gap = F.regexp_replace(F.col("m.g"), r"[\"'\s]+$", "")
    before = F.when(F.col("m.b").isNull(), F.concat_ws(" ", words_before, gap)).otherwise(F.concat("m.b", gap))
    after = F.concat_ws(" ", F.regexp_extract("m.n", r"^[^,;&{}]*", 0), F.when(F.col("m.nv") == "", F.get(ws, F.col("word") + 1)))
    return each.select("id", "word", F.col("m.v").alias("value"), F.rtrim(before).alias("before"), after.alias("after"), "path")


def scan(docs: DataFrame, model, *, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", p: Params = Params()) -> DataFrame:
    """(id, word, value_sha256, n_chars, probability, is_secret): one row per candidate; secrets are shown by their hash.
    Several candidates of one word share its number.

    Headers of private keys are secrets with probability 1, at the word that starts them. Null and empty texts have no
    candidates, and an empty table no rows; a null path counts as none. Repeated rows give repeated findings. Other columns are not looked at.
    """
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep").transform(with_features(candidates(docs, id_col, text_col, path_col)))
    scored = model.transform(vectors.select("id", "word", "value", "features")).select("id", "word", "value", F.round(vector_to_array("probability")[1], 6).alias("probability"))
    found = scored.select("id", "word", F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("n_chars"), "probability", (F.col("probability") >= p.threshold).alias("is_secret"))
    pem = docs.where(F.col(text_col).contains("PRIVATE KEY-----")).select(F.col(id_col).alias("id"), common.words(F.col(text_col)).alias("ws"), F.col(text_col).rlike(PRIVATE_KEY_RE).alias("ok")).where("ok")
    starts = F.filter(F.sequence(F.lit(0), F.size("ws") - 1), lambda i: F.get(F.col("ws"), i).contains("-----BEGIN") & F.array_join(F.slice("ws", i + 1, 6), " ").rlike(PRIVATE_KEY_RE))
    keys = pem.select("id", F.explode(starts).alias("word"), F.lit("private key").alias("v")).select("id", "word", F.sha2("v", 256).alias("value_sha256"), F.lit(0).cast("long").alias("n_chars"), F.lit(1.0).alias("probability"), F.lit(True).alias("is_secret"))
    return found.unionByName(keys).withColumnRenamed("id", id_col)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(common.read_table(spark, sf_dir, "documents"), fit(spark))
