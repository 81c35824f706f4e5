"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records of several layouts share one DataFrame, with nulls where a record lacks a field. The
fingerprint of a record is the hash of its nested field paths, taken from the schema and from
which fields the record has; it selects a declarative mapping to canonical turns.

Template: ``<turn ROLE>\\nTEXT</turn>\\n``. In texts and roles ``\\`` becomes ``\\b`` and ``<``
becomes ``\\l``; in roles also ``>`` becomes ``\\g`` and a line break ``\\n``. So neither a mark nor
part of one can occur inside a text, and undoing ``\\l`` before ``\\b`` restores it exactly.

Edge cases: a null text or role is empty; turns are ordered by (turn, position, role, text), nulls
first, and repeated rows stay; a record whose fingerprint no mapping knows gives a conversation of
layout ``unknown`` without turns; an empty table gives no rows; other columns are ignored.
A conversation, however long its texts, is one output row, so its own length bounds what a task holds.
"""

from __future__ import annotations

from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: name: (fields a record must have, fields it may have, turns as (role, path); a path through an array gives its elements' role and text)
LAYOUTS = {
    "turn_rows": ((), ("turn", "role", "text"), [("=role", "text")]),
    "prompt_response": (("prompt", "response"), ("system",), [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    "instruction": (("instruction", "output"), ("input", "system"), [("system", "system"), ("user", "instruction+input"), ("assistant", "output")]),
    "messages": (("messages[].role", "messages[].content"), (), [("[]role", "messages.content")]),
    "exchanges": (("conversations[].from", "conversations[].value"), (), [("[]from", "conversations.value")]),
}
#: Other names of the canonical roles in nested layouts; rows of turns keep their roles as they are.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURN = "struct<turn:bigint,pos:int,role:string,text:string>"


def _paths(field: T.StructField, prefix: str = "") -> list[str]:
    kind, name = field.dataType, prefix + field.name
    if isinstance(kind, T.ArrayType):
        kind, name = kind.elementType, name + "[]"
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in _paths(f, name + ".")]
    return [name]


def _known() -> set[str]:
    return {p.split("[]")[0] for must, may, _ in LAYOUTS.values() for p in (*must, *may)}


def fingerprint(df: DataFrame) -> Column:
    """The hash of the record's nested field paths, sorted; a path is there when its top field isn't null."""
    found = [(p, f.name) for f in df.schema.fields if f.name in _known() for p in _paths(f)]
    there = [F.when(F.col(top).isNotNull(), F.lit(p)) for p, top in sorted(found)]
    return F.xxhash64(F.concat_ws("\n", *there) if there else F.lit(""))


def _turns(df: DataFrame, spec: list[tuple[str, str]]) -> Column:
    """An array of TURN by a mapping."""
    turn = (F.col("turn") if "turn" in df.columns else F.lit(None)).cast("bigint")
    parts = []
    for pos, (role, path) in enumerate(spec):
        if role[0] == "[":
            items, value = path.split(".")
            if items not in df.columns:
                continue
            parts.append(F.transform(F.col(items), _element(turn, role[2:], value)))
            continue
        texts = [F.col(c).cast("string") for c in path.split("+") if c in df.columns]
        if not texts:
            continue
        said = F.concat_ws("\n", *[F.when(t != "", t) for t in texts]) if len(texts) > 1 else F.coalesce(texts[0], F.lit(""))
        who = F.coalesce(F.col(role[1:]).cast("string"), F.lit("")) if role[0] == "=" else F.lit(role)
        one = F.array(F.struct(turn.alias("turn"), F.lit(pos).alias("pos"), who.alias("role"), said.alias("text")))
        # a turn of its own field is there only when the field is; a row of turn_rows is always a turn
        parts.append(one if role[0] == "=" else F.when(texts[0].isNotNull(), one).otherwise(F.array().cast(f"array<{TURN}>")))
    return F.concat(*[p.cast(f"array<{TURN}>") for p in parts]) if parts else F.array().cast(f"array<{TURN}>")


def _element(turn: Column, role: str, value: str):
    return lambda x, i: F.struct(turn.alias("turn"), i.alias("pos"), _role(x[role]).alias("role"), F.coalesce(x[value].cast("string"), F.lit("")).alias("text"))


def _role(role: Column) -> Column:
    out = F.coalesce(role.cast("string"), F.lit(""))
    for k, v in ROLES.items():
        out = F.when(out == k, v).otherwise(out)
    return out


def canonical_turns(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, layout, turns): each record's turns by the mapping that its fingerprint selects."""
    names, turns = F.lit("unknown"), F.array().cast(f"array<{TURN}>")
    print_ = F.col("_print")
    for name, (must, may, spec) in LAYOUTS.items():
        subsets = chain.from_iterable(combinations(may, n) for n in range(len(may) + 1))
        marks = [F.xxhash64(F.lit("\n".join(sorted((*must, *some))))) for some in subsets if must or some]
        if not {p.split("[]")[0] for p in must} <= set(df.columns):
            continue
        hit = F.array_contains(F.array(*marks), print_)
        if name == "turn_rows" and {"turn", "role", "text"} <= set(df.columns):
            hit = hit | (print_ == F.xxhash64(F.lit("")))  # a row of nulls is still a turn
        names, turns = F.when(hit, name).otherwise(names), F.when(hit, _turns(df, spec)).otherwise(turns)
    return df.withColumn("_print", fingerprint(df)).select(F.col(key), names.alias("layout"), turns.alias("turns"))


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(_escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\g"), F.lit(">")))


def format_chat(df: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, layouts, formatted, loss_spans): loss_spans are (start, length) in code points of the escaped assistant texts."""
    turns = canonical_turns(df, key).select(key, "layout", F.explode_outer("turns").alias("t")).select(key, "layout", "t.*")
    head = F.concat(F.lit("<turn "), _escape_role(F.col("role")), F.lit(">\n"))
    rows = turns.withColumns({"head": head, "body": _escape(F.col("text"))})
    rows = rows.withColumn("piece", F.coalesce(F.concat("head", "body", F.lit("</turn>\n")), F.lit("")))
    before = Window.partitionBy(key).orderBy("turn", "pos", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"stop": F.sum(F.length("piece")).over(before), "ord": F.count(F.lit(1)).over(before)})
    body_at = F.col("stop") - F.length("piece") + F.length("head")
    span = F.when(F.col("role") == "assistant", F.struct(body_at.cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    got = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "piece", span.alias("span")))).alias("a"), F.array_sort(F.collect_set("layout")).alias("layouts"))
    return got.select(key, "layouts", F.array_join(F.col("a.piece"), "").alias("formatted"), F.filter(F.col("a.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def parse_chat(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    marked = F.filter(F.split(formatted, "<"), lambda s: F.startswith(s, F.lit("turn ")))
    return F.transform(marked, lambda s: F.struct(_unescape_role(F.substring_index(F.substr(s, F.lit(6)), ">\n", 1)).alias("role"), unescape(F.substr(s, F.locate(">\n", s) + 2)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped and concatenated."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
