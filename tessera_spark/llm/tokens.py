"""Edit-aware token counts.

A document keeps a segment tree over runs of whole pre-tokens: leaves hold characters and tokens, inner nodes their sums. Runs
are cut before a single space between two other characters, where a byte-level BPE pre-tokenizer always ends a pre-token and
looks no further back, so runs count independently. An edit re-encodes the runs that it or its boundary context touches and
updates the sums above them. The vocabulary is read from a path on every worker; it is a parameter, never part of the library.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the byte-level BPE vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters of a run at least, before it is cut.
RUN = 256
#: Characters around an edit whose change could move a cut.
CONTEXT = 2
_CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(2)
def counter(vocabulary: str) -> Callable[[list[str]], list[int]]:
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda parts: [len(encoding.encode_ordinary(p)) for p in parts]


def runs(text: str) -> list[str]:
    out, at = [], 0
    while m := _CUT.search(text, at + RUN):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]] if at < len(text) else out


class TokenTree:
    """Token counts of one text under edits."""

    def __init__(self, text: str, count: Callable[[list[str]], list[int]], leaves: tuple[list[int], list[int]] | None = None):
        self.text, self.count, self.encoded = text, count, 0
        if leaves is None:
            parts = runs(text)
            leaves = [len(p) for p in parts], count(parts)
            self.encoded = len(text)
        self._build(*leaves)

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.n = max(1, len(chars))
        self.size = 1 << (self.n - 1).bit_length()
        # Room for leaves to be split by edits; the tree is rebuilt from its leaves when it runs out.
        self.tree = np.zeros((2, 2 * self.size), np.int64)
        self.tree[0, self.size : self.size + len(chars)] = chars
        self.tree[1, self.size : self.size + len(tokens)] = tokens
        half = self.size
        while half > 1:
            level = self.tree[:, half : 2 * half]
            self.tree[:, half // 2 : half] = level[:, ::2] + level[:, 1::2]
            half //= 2

    @property
    def n_tokens(self) -> int:
        return int(self.tree[1, 1])

    @property
    def leaves(self) -> tuple[list[int], list[int]]:
        used = self.tree[:, self.size : self.size + self.n]
        return used[0].tolist(), used[1].tolist()

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """(leaf, its first character) of a position, by descending over the sums."""
        i, first = 1, 0
        while i < self.size:
            i *= 2
            if at >= first + self.tree[0, i]:
                first += int(self.tree[0, i])
                i += 1
        return min(i - self.size, self.n - 1), first

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        i = leaf + self.size
        change = np.array([chars, tokens]) - self.tree[:, i]
        while i:
            self.tree[:, i] += change
            i //= 2

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace text[start:end] by new; the characters that were encoded again."""
        if not 0 <= start <= end <= len(self.text):
            raise ValueError(f"edit {start}:{end} is outside a text of {len(self.text)} characters")
        if not self.text:
            self.__init__(new, self.count)
            return len(new)
        lo, lo_at = self._leaf_at(max(0, start - CONTEXT))
        hi, hi_at = self._leaf_at(min(len(self.text) - 1, end + CONTEXT))
        hi_at = min(hi_at, len(self.text))
        stop = hi_at + int(self.tree[0, hi + self.size])
        self.text = self.text[:start] + new + self.text[end:]
        region = self.text[lo_at : stop + len(new) - (end - start)]
        parts = runs(region)
        counts = self.count(parts)
        old = hi - lo + 1
        if len(parts) <= old:  # spare leaves of the region become empty
            for k in range(old):
                self._set(lo + k, len(parts[k]) if k < len(parts) else 0, counts[k] if k < len(parts) else 0)
        else:
            c, t = self.leaves
            self._build(c[:lo] + [len(p) for p in parts] + c[hi + 1 :], t[:lo] + counts + t[hi + 1 :])
        self.encoded += len(region)
        return len(region)


def valid_edits(edits: list[tuple[int | None, int | None, str]], length: int) -> list[tuple[int, int, str]]:
    """Edits in order: places outside the text are moved to its ends, and those without a place, backwards, or overlapping an earlier one do nothing."""
    out = []
    for start, end, new in sorted((e for e in edits if e[0] is not None and e[1] is not None and e[0] <= e[1]), key=lambda e: e):
        start, end = min(max(start, 0), length), min(max(end, 0), length)
        if not out or start >= out[-1][1]:
            out.append((start, end, new))
    return out


def _apply(tree: TokenTree, edits: list[tuple[int | None, int | None, str]]) -> None:
    """Edits name places in the text before any of them; from the last to the first, places stay valid."""
    for start, end, new in reversed(valid_edits(edits, len(tree.text))):
        tree.edit(start, end, new)


_COUNTED = "n_tokens long, leaf_chars array<int>, leaf_tokens array<int>"


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, text, n_tokens, leaf_chars, leaf_tokens): counts with the leaves from which later edits start.

    Null and empty texts have no tokens and no leaves. Rows count one by one; repeated rows agree.
    """
    common.limit_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                trees = [TokenTree(t or "", count) for t in part.column(1).to_pylist()]
                leaves = [x.leaves if x.text else ([], []) for x in trees]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([x.n_tokens for x in trees], pa.int64()), *(pa.array([x[k] for x in leaves], pa.list_(pa.int32())) for k in (0, 1))],
                    ["id", "t", "n_tokens", "leaf_chars", "leaf_tokens"],
                )

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, t string, {_COUNTED}").withColumnsRenamed({"id": id_col, "t": text_col})


def recount(counted: DataFrame, edits: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """counted after edits (id, start, end, new), with n_reencoded: characters that had to be encoded again.

    start and end are code points of the old text, end excluded; places outside it are moved to its ends. An edit with a null
    place, with its end before its start, or overlapping an earlier one (by start, end, then new) does nothing. Documents without
    edits pass through untouched; edits of unknown documents do nothing; a null `new` deletes. Rows with a repeated id all get
    its edits.
    """
    per_doc = edits.groupBy(F.col(id_col).alias("_id")).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("s"), F.col("end").cast("int").alias("e"), F.coalesce("new", F.lit("")).alias("n"))).alias("_edits"))
    common.limit_batches(counted.sparkSession)
    joined = counted.join(per_doc, F.col(id_col) == F.col("_id"), "left").select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), "n_tokens", "leaf_chars", "leaf_tokens", "_edits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            out = []
            for t, n, c, k, es in zip(*(b.column(i).to_pylist() for i in range(1, 6)), strict=True):
                if es:
                    tree = TokenTree(t or "", count, (c, k) if t else None)
                    _apply(tree, [(e["s"], e["e"], e["n"]) for e in es])
                    out.append((tree.text, tree.n_tokens, *(tree.leaves if tree.text else ([], [])), tree.encoded))
                else:
                    out.append((t, n, c, k, 0))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            kinds = [pa.string(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(x), y) for x, y in zip(cols, kinds, strict=True))], ["id", "t", "n_tokens", "leaf_chars", "leaf_tokens", "n_reencoded"])

    kind = joined.schema["id"].dataType.simpleString()
    return joined.mapInArrow(run, f"id {kind}, t string, {_COUNTED}, n_reencoded long").withColumnsRenamed({"id": id_col, "t": text_col})


def count_redacted(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", pattern: str = r"[0-9A-Fa-f]{16,}", new: str = "[REDACTED]", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, n_tokens, n_edits, n_tokens_after, n_reencoded): counts before and after each match of pattern is replaced.

    One pass: the edits come from the text itself, so no join is needed. Null and empty texts count 0; rows count one by one, so
    repeated rows agree; an empty table gives no rows. Other columns are not looked at.
    """
    common.limit_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    found = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for b in batches:
            out = []
            for t in b.column(1):
                text = t.as_py() or ""
                tree = TokenTree(text, count)
                before, base = tree.n_tokens, tree.encoded
                edits = [(m.start(), m.end(), new) for m in found.finditer(text)]
                _apply(tree, edits)
                out.append((before, len(edits), tree.n_tokens, tree.encoded - base))
            cols = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(cols[:, k]) for k in range(4))], ["id", "n_tokens", "n_edits", "n_tokens_after", "n_reencoded"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_edits long, n_tokens_after long, n_reencoded long").withColumnRenamed("id", id_col)


def op9_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_redacted(common.read_table(spark, sf_dir, "documents"))
