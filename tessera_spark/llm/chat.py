"""Chat formatting by schema fingerprints.

Each row's payload has a fingerprint: the hash of its nested field paths and their types, over all elements of all arrays. The
hash selects a declarative mapping (prompt/completion, instruction/input/output, message arrays, rows by turn) to canonical turns
array<struct<role, text>>. Turns are rendered in a template whose control strings cannot occur in texts, and the rendering can
be read back exactly.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# Control strings of the template, and of common templates, which texts may not contain unescaped.
TURN, SEP, END = "<|turn|>", "<|says|>", "<|end|>\n"
CONTROL_RE = r"([<\[])(\||/?s>|/?INST\]|</?SYS>>)"

TURNS = "array<struct<role:string,text:string>>"

#: Layout name -> (fields, mapping). Fields are names, or a name with the fields of its array's elements. A mapping is a list of
#: (role, fields joined by a blank line), or (role field, text field, other names of roles) of the array's elements.
LAYOUTS: dict[str, tuple[dict[str, tuple[str, ...]], list[tuple[str, tuple[str, ...]]] | tuple[str, str, dict[str, str]]]] = {
    "prompt_completion": ({"prompt": (), "completion": ()}, [("user", ("prompt",)), ("assistant", ("completion",))]),
    "question_answer": ({"question": (), "answer": ()}, [("user", ("question",)), ("assistant", ("answer",))]),
    "instruction": ({"instruction": (), "output": ()}, [("user", ("instruction",)), ("assistant", ("output",))]),
    "instruction_input": ({"instruction": (), "input": (), "output": ()}, [("user", ("instruction", "input")), ("assistant", ("output",))]),
    "system_prompt_completion": ({"system": (), "prompt": (), "completion": ()}, [("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))]),
    "messages": ({"messages": ("role", "content")}, ("role", "content", {})),
    "turns": ({"turns": ("role", "text")}, ("role", "text", {})),
    "sharegpt": ({"conversations": ("from", "value")}, ("from", "value", {"human": "user", "gpt": "assistant"})),
}


def shapes(fields: dict[str, tuple[str, ...]]) -> list[str]:
    """The schemas of payloads with these fields, as schema_of_variant() writes them; an array can be empty."""
    out = [""]
    for name in sorted(fields):
        inner = ", ".join(f"{f}: STRING" for f in sorted(fields[name]))
        kinds = [f"ARRAY<OBJECT<{inner}>>", "ARRAY<STRING>"] if inner else ["STRING"]
        out = [f"{o}, {name}: {k}" if o else f"{name}: {k}" for o in out for k in kinds]
    return [f"OBJECT<{o}>" for o in out]


def fingerprint(schema: str) -> str:
    return hashlib.sha256(schema.encode()).hexdigest()[:16]


REGISTRY = {fingerprint(x): name for name, (fields, _) in LAYOUTS.items() for x in shapes(fields)}


def fingerprint_of(payload: Column) -> Column:
    """The fingerprint of a JSON payload; null values count as strings. Null if there is no payload or it is malformed."""
    schema = F.regexp_replace(F.schema_of_variant(F.try_parse_json(payload)), r"\bVOID\b", "STRING")
    return F.sha2(schema, 256).substr(1, 16)


def _layout(key: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in REGISTRY.items() for x in kv])
    return F.element_at(names, key)


def _turns_of(payload: Column, name: str) -> Column:
    fields, mapping = LAYOUTS[name]
    parsed = F.from_json(payload, ", ".join(f"`{f}` " + (f"array<struct<{', '.join(f'`{x}`: string' for x in xs)}>>" if xs else "string") for f, xs in fields.items()))
    if isinstance(mapping, tuple):
        role, text, names = mapping

        def turn(m: Column) -> Column:
            said = m[role]
            for old, new in names.items():
                said = F.when(m[role] == old, new).otherwise(said)
            return F.struct(said.alias("role"), m[text].alias("text"))

        return F.coalesce(F.transform(parsed[next(iter(fields))], turn), F.array().cast(TURNS)).cast(TURNS)
    parts = []
    for role, of in mapping:
        rest = [F.when(F.coalesce(parsed[f], F.lit("")) != "", F.concat(F.lit("\n\n"), parsed[f])).otherwise("") for f in of[1:]]
        parts.append(F.struct(F.lit(role).alias("role"), (F.concat(F.coalesce(parsed[of[0]], F.lit("")), *rest) if rest else parsed[of[0]]).alias("text")))
    return F.filter(F.array(*parts), lambda t: (t["role"] != "system") | (F.coalesce(t["text"], F.lit("")) != "")).cast(TURNS)


def to_turns(df: DataFrame, id_col: str, payload: str | None = None) -> DataFrame:
    """(id, layout, turns): each row's layout by the fingerprint of its own payload, and its canonical turns.

    payload is a column of JSON. Without it, a row's payload is made of its columns that any layout names, those that are null
    left out; if that has no layout, with the nulls. So one table can hold several layouts. Rows of an unknown layout (also one
    with fields that no mapping knows, or values that are not strings), null and malformed payloads, and such of more than 128 MB get
    layout null and no turns; they are kept, and so are repeated rows and null ids. An empty table gives no rows. Other columns
    are not looked at.
    """
    if payload is not None:
        bodies = [F.col(payload)]
    else:
        tops = {f for fields, _ in LAYOUTS.values() for f in fields}
        cols = F.struct(*[F.col(f"`{c}`") for c in df.columns if c in tops and c != id_col] or [F.lit(None).alias("none")])
        bodies = [F.to_json(cols), F.to_json(cols, {"ignoreNullFields": "false"})]
    rows = df.select(F.col(id_col).alias("_id"), *[b.alias(f"_p{i}") for i, b in enumerate(bodies)])
    rows = rows.select("*", *[_layout(fingerprint_of(F.col(f"_p{i}"))).alias(f"_l{i}") for i in range(len(bodies))])
    layout = F.coalesce(*[F.col(f"_l{i}") for i in range(len(bodies))])
    body = F.col("_p0") if payload is not None else F.when(F.col("_l0").isNotNull(), F.col("_p0")).otherwise(F.col("_p1"))
    rows = rows.select("_id", layout.alias("layout"), body.alias("_p"))
    turns = F.array().cast(TURNS)
    for name in LAYOUTS:
        turns = F.when(F.col("layout") == name, _turns_of(F.col("_p"), name)).otherwise(turns)
    return rows.select(F.col("_id").alias(id_col), "layout", turns.alias("turns"))


def escape(text: Column) -> Column:
    """Backslashes double, and `\\~` goes after the first character of a control string; unescape() is the inverse."""
    return F.regexp_replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), CONTROL_RE, "$1\\\\~$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:(\\)|~)", "$1")


def format_turns(df: DataFrame, id_col: str, *, turns: str = "turns", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(id, formatted, loss_spans): the rendered conversation and the code-point spans [start, length) of texts that count for the loss.

    Null roles and texts render as empty. A conversation without turns renders as the empty string. Ids pass through as they
    are, repeated ids row by row.
    """
    piece = F.transform(F.coalesce(F.col("_turns"), F.array().cast(TURNS)), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), escape(t["role"]).alias("r"), escape(t["text"]).alias("x")))
    rendered = F.transform(F.col("_piece"), lambda p: F.concat(F.lit(TURN), p["r"], F.lit(SEP), p["x"], F.lit(END)))
    fixed = len(TURN) + len(SEP)
    walk = F.aggregate(
        F.col("_piece"),
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda s, p: F.struct(
            (s["at"] + fixed + F.length(p["r"]) + F.length(p["x"]) + len(END)).cast("long").alias("at"),
            F.when(
                p["role"].isin(*loss_roles), F.array_append(s["spans"], F.struct((s["at"] + fixed + F.length(p["r"])).cast("long").alias("start"), F.length(p["x"]).cast("long").alias("length")))
            ).otherwise(s["spans"]).alias("spans"),
        ),
    )["spans"]
    return (
        df.select(F.col(id_col).alias("_id"), F.col(turns).alias("_turns"))
        .select("_id", piece.alias("_piece"))
        .select(F.col("_id").alias(id_col), F.array_join(rendered, "").alias("formatted"), walk.alias("loss_spans"))
    )


def read_back(formatted: Column) -> Column:
    """The turns of a rendered conversation."""
    pieces = F.filter(F.split(formatted, common.java_literal(TURN)), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(F.substring_index(p, SEP, 1)).alias("role"),
            unescape(F.regexp_replace(F.substring(p, F.length(F.substring_index(p, SEP, 1)) + len(SEP) + 1, F.length(p)), common.java_literal(END) + r"\z", "")).alias("text"),
        ),
    )


def rows_to_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows by turn -> (conv, turns), ordered by turn, then role, then text, nulls first; repeated rows are kept, a null text is empty."""
    return (
        df.groupBy(F.col(conv).alias("_c"))
        .agg(F.sort_array(F.collect_list(F.struct(F.col(turn).alias("t"), F.col(role).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x")))).alias("_t"))
        .select(F.col("_c").alias(conv), F.transform("_t", lambda t: F.struct(t["r"].alias("role"), t["x"].alias("text"))).alias("turns"))
    )


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    raw = common.read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    extra = extra.select(*[F.col(f.name).cast(f.dataType) for f in raw.schema])
    turns = to_turns(rows_to_turns(raw.unionByName(extra)), "conv_id")
    out = format_turns(turns, "conv_id")
    back = out.select("conv_id", "formatted", "loss_spans", read_back(F.col("formatted")).alias("_b"))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return back.withColumn("_l", loss).select(
        "conv_id",
        F.size("_b").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_b", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_l").cast("long").alias("loss_chars"),
        F.sha2(F.col("_l"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, regexp_replace(replace(coalesce(role, ''), '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1\\~\2', 'g') AS er,
    regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|</?SYS>>)', '\1\\~\2', 'g') AS et
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text), '')) AS loss_sha256,
  CAST(sum(length(er) + length(et) + 24) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
