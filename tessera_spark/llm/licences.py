"""Licence scans: a trained paragraph classifier over sparse word n-grams.

Paragraphs are lines, and wrapped lines with those after them. A softmax regression over word uni- and bigrams, trained on variants of the templates below and on
bounded samples of other paragraphs, names the licence family or `unknown`; a temperature fitted on held-out variants
calibrates its probabilities. A prediction counts only if the paragraph also covers enough of one of the family's templates.
The model is small and fixed in size, so it is broadcast; texts never leave the JVM.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

# Licence families, the names that texts give them, and opening sentences of their grants.
NAMES = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache 2.0 license", "Apache-2.0"),
    "BSD": ("BSD License", "BSD 3-Clause License", "BSD-3-Clause", "BSD 2-Clause License", "BSD-2-Clause"),
    "CC-BY": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    "CC-BY-NC": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"),
    "CC-BY-SA": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    "CC0": ("CC0 1.0", "Creative Commons Zero public domain dedication", "CC0-1.0"),
    "GPL": ("GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3", "GPL-3.0", "GPL-2.0"),
    "LGPL": ("GNU Lesser General Public License, version 2.1", "GNU LGPL v3", "LGPL-2.1"),
    "MIT": ("MIT License", "MIT licence", "MIT"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"),
    "Proprietary": ("proprietary license", "commercial license agreement"),
}
GRANTS = {
    "Apache-2.0": ("You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
    "GPL": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",),
    "LGPL": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "MIT": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at http://mozilla.org/MPL/2.0/",),
    "Proprietary": ("All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential",),
}
FRAMES = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "This project is distributed under the terms of the {}.", "The code is available under the {}.", "SPDX-License-Identifier: {}", "License: {}", "See the {} for details.",
    "This file is part of a package covered by the {}.", "Copyright 2020 the authors. Licensed under the {}.",
)
OTHERS = (
    "The driver showed a license at the border and was let through.", "A fishing license costs more this year than last.", "The warranty ends after two years of use.",
    "Permission to enter was granted by the office.", "He had the permission of his parents.", "The public was free to attend the general meeting.", "Copyright law was the subject of the course.",
    "Version 2.0 of the program is under test.", "The software was released under pressure.", "This work is the best of the year.", "The attribution of the painting is in doubt.",
    "A commercial agreement was signed in May.", "The mozilla browser opened the page.", "The apache tribe lived in the south.", "MIT students built a bridge.", "The terms of the agreement are not public.",
    "The project is available to members.", "See the manual for details.", "The domain is open to the public.", "Liability was denied by the insurer.",
)
#: A paragraph with any of these is a candidate, and so is one that covers a template: see lures().
CUES = ("licen", "spdx", "redistribut", "permission is hereby", "proprietary", "unauthorized copying", "public domain", "mozilla public", "creative commons", "gnu ")
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Params:
    rounds: int = 300
    l2: float = 1e-3
    max_features: int = 8192
    min_probability: float = 0.5
    min_cover: float = 0.6
    seed: int = 5


def _words(text: str) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9.]+", " ", text.lower()).split() if w.strip(".")]


def _clean(w: str) -> str:
    return w.strip(".")


def ngrams(text: str) -> list[str]:
    ws = [_clean(w) for w in _words(text)]
    return sorted(set(ws) | {f"{a} {b}" for a, b in itertools.pairwise(ws)})


def labelled() -> list[tuple[str, str]]:
    out = [(f.format(name), fam) for fam, names in NAMES.items() for name in names for f in FRAMES]
    out += [(g, fam) for fam, gs in GRANTS.items() for g in gs for _ in range(4)]
    out += [(o, UNKNOWN) for o in OTHERS for _ in range(6)]
    out += [(f.format(x), UNKNOWN) for f in FRAMES for x in ("usual terms", "agreement of the parties", "new law", "old rules", "house", "same conditions", "minister")]
    return out


def _fit(x: list[list[int]], y: np.ndarray, n: int, k: int, p: Params) -> tuple[np.ndarray, np.ndarray]:
    rows, cols = np.repeat(np.arange(len(x)), [len(r) for r in x]), np.array([c for r in x for c in r], np.int64)
    w, b, g2, gb2 = np.zeros((n, k)), np.zeros(k), np.full((n, k), 1e-8), np.full(k, 1e-8)
    hot = np.eye(k)[y]
    for _ in range(p.rounds):
        z = np.zeros((len(x), k))
        np.add.at(z, rows, w[cols])
        z += b
        q = np.exp(z - z.max(1, keepdims=True))
        d = (q / q.sum(1, keepdims=True) - hot) / len(x)
        g = np.zeros_like(w)
        np.add.at(g, cols, d[rows])
        g += p.l2 * w / len(x)
        g2 += g * g
        gb2 += d.sum(0) ** 2
        w -= 0.3 * g / np.sqrt(g2)
        b -= 0.3 * d.sum(0) / np.sqrt(gb2)
    return w, b


@lru_cache(4)
def model(p: Params = Params()) -> tuple[dict[str, list[float]], list[float], list[str]]:
    """(weights of each n-gram, intercepts, families), the temperature already applied."""
    data = labelled()
    families = [*NAMES, UNKNOWN]
    rng = np.random.default_rng(p.seed)
    held = rng.random(len(data)) < 0.2
    grams = [ngrams(t) for t, _ in data]
    df = Counter(g for r in grams for g in r)
    vocab = {g: i for i, g in enumerate(sorted(df, key=lambda g: (-df[g], g))[: p.max_features])}
    x = [[vocab[g] for g in r if g in vocab] for r in grams]
    y = np.array([families.index(f) for _, f in data])
    part = [r for r, h in zip(x, held, strict=True) if not h]
    w, b = _fit(part, y[~held], len(vocab), len(families), p)
    # Temperature: the one at which the held-out variants are likeliest.
    z = np.array([w[r].sum(0) + b for r, h in zip(x, held, strict=True) if h])
    loss = {}
    for t in (0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0):
        q = z / t
        q -= q.max(1, keepdims=True)
        loss[t] = -(q[np.arange(len(q)), y[held]] - np.log(np.exp(q).sum(1))).mean()
    t = min(loss, key=loss.get)
    w, b = _fit(x, y, len(vocab), len(families), p)
    return {g: (w[i] / t).tolist() for g, i in vocab.items()}, (b / t).tolist(), families


def _column_words(text: Column) -> Column:
    ws = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9.]+", " ")), " ")
    return F.filter(F.transform(ws, lambda w: F.btrim(w, F.lit("."))), lambda w: w != "")


def _templates() -> dict[str, list[list[str]]]:
    return {fam: [[_clean(w) for w in _words(t)] for t in (*NAMES[fam], *GRANTS.get(fam, ()))] for fam in NAMES}


def _grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in itertools.pairwise(words)}


@lru_cache(4)
def lures(p: Params = Params()) -> tuple[str, ...]:
    """Words of which every paragraph that covers a template by min_cover has one.

    Of a name of one or two words, which counts only whole, the longest; of other templates so many words that the rest of it
    covers less, long ones first.
    """
    plain, out = {w for o in OTHERS for w in map(_clean, _words(o))}, set()
    for t in sorted((t for ts in _templates().values() for t in ts), key=len):
        left = lambda: len(_grams(t)) - len({g for g in _grams(t) if out & set(g.split())})  # noqa: E731, B023
        for w in sorted(set(t), key=lambda w: (len(w) <= 3, w in plain, -len(w), w)):
            if left() < (p.min_cover if len(t) > 2 else 1) * len(_grams(t)):
                break
            out.add(w)
    return tuple(sorted(out))


#: Names of one word can be ordinary words elsewhere (German "mit"): a paragraph is looked at if it has one as written, or after words that show it.
SHORT_NAMES = tuple(n for ns in NAMES.values() for n in ns if len(_words(n)) == 1)
#: What shows that such a word names a licence.
NAMED_RE = r"(?i)(under(\s+(the|a))?|terms\s+of(\s+the)?|covered\s+by(\s+the)?|licen[cs]e:|identifier:)\s+(" + "|".join(SHORT_NAMES) + r")(?![\p{L}\p{N}])"


def _column_grams(ws: Column) -> Column:
    return F.array_union(ws, F.transform(F.arrays_zip(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))).alias("a"), F.slice(ws, 2, F.size(ws)).alias("b")), lambda z: F.concat_ws(" ", z["a"], z["b"])))


def _shares(grams: Column, templates: list[list[str]]) -> list[Column]:
    """The share of each template that a paragraph has; of a name of one or two words, all or nothing."""
    out = []
    for t in templates:
        share = F.size(F.array_intersect(grams, F.array(*[F.lit(x) for x in sorted(_grams(t))]))) / float(len(_grams(t)))
        out.append(share if len(t) > 2 else F.when(share == 1, 1.0).otherwise(0.0))
    return out


def _short(text: Column) -> Column:
    found = text.rlike(NAMED_RE)
    for name in SHORT_NAMES:
        found = F.contains(text, F.lit(name)) | found
    return found


def covers_any(ws: Column, p: Params) -> Column:
    """Whether the words of a paragraph cover a template of two or more words."""
    long = [t for ts in _templates().values() for t in ts if len(t) > 1]
    return F.exists(F.array(ws), lambda w: F.exists(F.array(_column_grams(w)), lambda g: F.greatest(*_shares(g, long)) >= p.min_cover))


def covered(ws: Column, family: Column, short: Column) -> Column:
    """The largest share of a template's words, in bigrams beside single words, that the paragraph has; 0 for unknown.

    A template of one word counts only where `short` says that the paragraph has it as a name.
    """
    out = F.lit(0.0)
    grams = _column_grams(ws)
    for fam, templates in _templates().items():
        best = [F.when(short | (len(t) > 1), x).otherwise(0.0) for t, x in zip(templates, _shares(grams, templates), strict=True)]
        out = F.when(family == fam, F.greatest(*best) if len(best) > 1 else best[0]).otherwise(out)
    return out


#: Licence texts are often wrapped: a line of up to so many characters is also read with up to so many lines after it.
WRAP_CHARS, WRAP_LINES = 100, 4


def paragraphs(docs: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """(id, line, n_lines, x): lines that can be of a licence, and the same with the lines after them where those are wrapped; each once."""

    def has(text: Column, words) -> Column:
        """Whether a text has any of the words, in any case; lower-cased once."""

        def any_of(low: Column) -> Column:
            found = F.lit(False)
            for w in words:
                found = found | F.contains(low, F.lit(w))
            return found

        return F.exists(F.array(F.lower(text)), any_of)

    alone = {w for n in SHORT_NAMES for w in _words(n)}  # found by _short() instead: as parts of words they are everywhere
    wide = (*CUES, *(w for w in lures(p) if w not in alone and not any(x in w for x in CUES)))
    x = F.col("x")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(has(F.col("t"), wide) | _short(F.col("t"))).select("id", F.split("t", "\n").alias("ls"))
    lines = texts.select("id", "ls", F.posexplode_outer("ls").alias("line", "x")).where(has(x, wide) | _short(x))
    # The lines after, as far as each is wrapped and not blank.
    after = F.slice("ls", F.col("line") + 2, WRAP_LINES - 1)
    full = lambda y: (F.length(y) <= WRAP_CHARS) & (F.length(y) >= WRAP_CHARS // 3)
    stop = F.array_position(F.transform(F.concat(F.array("x"), after), full), False)
    taken = F.when(stop == 0, F.size(after)).otherwise(F.least(stop - 1, F.size(after)).cast("int"))
    lines = lines.select("id", "line", "x", F.filter(F.slice(after, 1, taken), lambda y: F.trim(y) != "").alias("more"))
    forms = F.array(F.struct(F.lit(1).alias("n_lines"), x.alias("x")), F.when(F.size("more") > 0, F.struct((F.size("more") + 1).alias("n_lines"), F.concat_ws(" ", "x", "more").alias("x"))))
    each = lines.select("id", "line", F.explode_outer(F.array_compact(forms)).alias("f")).select("id", "line", "f.n_lines", "f.x")
    cover = covers_any(_column_words(x), p) | _short(x)
    return each.where(F.when(F.col("n_lines") == 1, has(x, CUES) | cover).otherwise(cover)).dropDuplicates(["id", "line", "n_lines", "x"])


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", p: Params = Params()) -> DataFrame:
    """(id, line, n_lines, family, probability, cover, confirmed): one row per candidate paragraph, with the number of its first line from 0.

    A paragraph is a line, or a wrapped line with those after it where these are confirmed and the line alone is not.
    family is `unknown` where the model says so, where its probability is under min_probability, or where no template of the
    family is covered; confirmed is true where the template comparison agrees with the model. Null and empty texts have no
    candidates, and an empty table no rows. Repeated rows give equal rows once (all that is shown of them is equal); documents
    that share an id but not a line's text have a row for each. Other columns are not looked at.
    """
    spark = docs.sparkSession
    weights, bias, families = model(p)
    table = common.local_table(spark, [{"g": g, "w": w} for g, w in weights.items()], "g: string, w: array<double>")  # at most max_features rows
    k = len(families)
    found = paragraphs(docs, id_col, text_col, p).select("id", "line", "n_lines", F.xxhash64("x").alias("h"), _column_words(F.col("x")).alias("ws"), F.col("x").rlike(NAMED_RE).alias("short"))
    exploded = found.select("id", "line", "n_lines", "h", "ws", "short", F.explode_outer(_column_grams(F.col("ws"))).alias("g"))
    met = exploded.join(F.broadcast(table), "g", "left")
    sums = [F.sum(F.coalesce(F.col("w")[i], F.lit(0.0))).alias(f"z{i}") for i in range(k)]
    scored = met.groupBy("id", "line", "n_lines", "h").agg(F.first("ws").alias("ws"), F.first("short").alias("short"), *sums)
    z = F.array(*[F.col(f"z{i}") + bias[i] for i in range(k)])
    scored = scored.select("id", "line", "n_lines", "h", "ws", "short", z.alias("z")).withColumn("top", F.array_max("z"))
    probability = 1 / F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    best = F.element_at(F.array(*[F.lit(f) for f in families]), F.array_position("z", F.col("top")).cast("int"))
    scored = scored.select("id", "line", "n_lines", "h", "ws", "short", best.alias("best"), probability.alias("probability"))
    scored = scored.withColumn("cover", F.round(covered(F.col("ws"), F.col("best"), F.col("short")), 6))
    agree = (F.col("best") != UNKNOWN) & (F.col("probability") >= p.min_probability) & (F.col("cover") >= p.min_cover)
    scored = scored.select("id", "line", "n_lines", "h", F.when(agree, F.col("best")).otherwise(UNKNOWN).alias("family"), F.round("probability", 6).alias("probability"), "cover", agree.alias("confirmed"))
    # A wrapped text counts where it is confirmed, no line of it is confirmed alone, and no wrapped text that counts begins in the lines just before.
    doc = Window.partitionBy("id").orderBy("line")
    alone = F.min(F.when((F.col("n_lines") == 1) & F.col("confirmed"), F.col("line"))).over(doc.rangeBetween(0, WRAP_LINES - 1))
    scored = scored.withColumn("_w", (F.col("n_lines") > 1) & F.col("confirmed") & (F.coalesce(alone, F.col("line") + F.col("n_lines")) >= F.col("line") + F.col("n_lines")))
    before = F.max(F.when(F.col("_w"), F.col("line"))).over(doc.rangeBetween(1 - WRAP_LINES, -1))
    scored = scored.withColumn("_w", F.col("_w") & before.isNull()).where("n_lines = 1 or _w")
    ranked = scored.withColumn("_r", F.rank().over(Window.partitionBy("id", "line").orderBy(F.desc("_w")))).where("_r = 1")
    return ranked.select(F.col("id").alias(id_col), "line", "n_lines", "family", "probability", "cover", "confirmed")


def op10_licences(spark, sf_dir: str) -> DataFrame:
    return scan(common.read_table(spark, sf_dir, "documents"))
