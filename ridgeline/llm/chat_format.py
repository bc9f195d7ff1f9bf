"""Chat formatting by schema fingerprints, with DataFrame functions only.

A record is a JSON text of any layout. Those of its nested field paths that any
mapping uses (without values and scalar types) are hashed to a fingerprint, and
the fingerprint selects a declarative mapping to canonical turns. Other fields
(ids, names, sources) don't matter. Where the paths fit no mapping as a whole,
the one with most paths that are all there is taken:

* `prompt`: one text, and a completion beside it;
* `instruction`: an instruction with optional input and system text, and an output;
* `messages`: a list of role and text objects, under several names.

Turns are formatted with a template that marks them, and control strings in
texts and roles are escaped reversibly: `\\` becomes `\\\\` and the control string
number k becomes `\\k`. Spans of assistant texts make the loss mask.

Scale: everything is row-wise over records, in the JVM. The fingerprint table
has a row for each known layout, whatever the input; it is a CASE expression.

Defined results: null or invalid JSON, and layouts without a mapping, give no
turns and `layout` null (`unmapped` counts them by fingerprint); null texts are empty; a null role is `user`; an empty
table gives an empty result; extra columns pass through.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of the template, by the digit that escapes them.
OPEN, HEAD, CLOSE = "<turn>", "</role>", "</turn>"
CONTROLS = (OPEN, HEAD, CLOSE)
TURNS = "array<struct<role:string,text:string>>"


class Layout(NamedTuple):
    """Field paths that identify a layout, and how they map to turns.

    fields: (path, role) for each text at the top, in turn order.
    items: path of a list, and the paths of role and text in its objects.
    roles: names of roles in the source, other than the canonical ones.
    """

    name: str
    paths: tuple[str, ...]
    fields: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None


#: Other names of the three roles (fixed values).
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = (
    Layout("prompt_completion", ("completion", "prompt"), (("prompt", "user"), ("completion", "assistant"))),
    Layout("prompt_response", ("prompt", "response"), (("prompt", "user"), ("response", "assistant"))),
    Layout("system_prompt_response", ("prompt", "response", "system"), (("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Layout("question_answer", ("answer", "question"), (("question", "user"), ("answer", "assistant"))),
    Layout("instruction", ("instruction", "output"), (("instruction", "user"), ("output", "assistant"))),
    Layout("instruction_input", ("input", "instruction", "output"), (("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Layout("instruction_system", ("instruction", "output", "system"), (("system", "system"), ("instruction", "user"), ("output", "assistant"))),
    Layout("instruction_input_system", ("input", "instruction", "output", "system"), (("system", "system"), ("instruction", "user"), ("input", "user"), ("output", "assistant"))),
    Layout("nested_prompt", ("data", "data.completion", "data.prompt"), (("data.prompt", "user"), ("data.completion", "assistant"))),
    Layout("messages", ("messages", "messages[].content", "messages[].role"), items=("messages", "role", "content")),
    Layout("message_texts", ("messages", "messages[].role", "messages[].text"), items=("messages", "role", "text")),
    Layout("conversations", ("conversations", "conversations[].from", "conversations[].value"), items=("conversations", "from", "value")),
    Layout("dialog", ("dialog", "dialog.turns", "dialog.turns[].speaker", "dialog.turns[].utterance"), items=("dialog.turns", "speaker", "utterance")),
)


def _is(kind: str, schema: Column) -> Column:
    return schema.startswith(kind)


def schema_paths(schema: Column) -> Column:
    """Sorted nested field paths from a variant's schema text, such as OBJECT<a: ARRAY<OBJECT<b: STRING>>>.

    A fold over the schema's tokens keeps the stack of open objects and lists.
    """
    tokens = F.regexp_extract_all(schema, F.lit(r"(OBJECT<|ARRAY<|>|`(?:[^`]|``)*`: |[^<>,:` ]+: )"), F.lit(1))
    start = F.struct(
        F.array().cast("array<string>").alias("stack"), F.lit("").alias("name"), F.array().cast("array<string>").alias("paths")
    )

    def step(acc: Column, token: Column) -> Column:
        top = F.coalesce(F.try_element_at(acc["stack"], F.lit(-1)), F.lit(""))
        key = F.regexp_replace(F.regexp_replace(token, ": $", ""), "^`|`$", "")
        path = F.when(top == "", key).otherwise(F.concat(top, F.lit("."), key))
        path = F.when(top.endswith("[]"), F.concat(top, F.lit("."), key)).otherwise(path)
        here = F.when(acc["name"] != "", acc["name"]).otherwise(top)
        opened = F.when(token == "ARRAY<", F.concat(here, F.lit("[]"))).otherwise(here)
        is_open, is_close = token.isin("OBJECT<", "ARRAY<"), token == ">"
        return F.struct(
            F.when(is_open, F.array_append(acc["stack"], opened))
            .when(is_close, F.slice(acc["stack"], F.lit(1), F.greatest(F.size(acc["stack"]) - 1, F.lit(0))))
            .otherwise(acc["stack"])
            .alias("stack"),
            F.when(is_open | is_close, F.lit("")).otherwise(path).alias("name"),
            F.when(is_open | is_close, acc["paths"]).otherwise(F.array_append(acc["paths"], path)).alias("paths"),
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, start, step)["paths"]))


def fingerprint(paths: Column) -> Column:
    """Hex digest of the sorted paths."""
    return F.sha2(F.array_join(paths, "\n"), 256)


def _known(layout: Layout) -> Column:
    return F.sha2(F.lit("\n".join(sorted(layout.paths))), 256)


def _role(role: Column) -> Column:
    out = F.coalesce(role, F.lit("user"))
    for name, canonical in ROLE_NAMES.items():
        out = F.when(role == name, F.lit(canonical)).otherwise(out)
    return out


def _turns(layout: Layout, record: Column) -> Column:
    def text(value: Column) -> Column:
        return F.coalesce(value, F.lit(""))

    if layout.items:
        path, role, content = layout.items
        items = F.try_variant_get(record, f"$.{path}", f"array<struct<`{role}`:string,`{content}`:string>>")
        return F.transform(items, lambda x: F.struct(_role(x[role]).alias("role"), text(x[content]).alias("text")))
    return F.array(*[F.struct(F.lit(role).alias("role"), text(F.try_variant_get(record, f"$.{path}", "string")).alias("text")) for path, role in layout.fields])


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """`records` with fingerprint, layout (null: unknown) and turns."""
    parsed = records.withColumn("__parsed", F.try_parse_json(F.col(record)))
    used = F.array(*[F.lit(x) for x in sorted({p for each in LAYOUTS for p in each.paths})])
    parsed = parsed.withColumn("__paths", F.array_intersect(schema_paths(F.schema_of_variant("__parsed")), used))
    parsed = parsed.withColumn("fingerprint", fingerprint(F.col("__paths")))
    layout = F.lit(None).cast("string")
    for each in sorted(LAYOUTS, key=lambda x: len(x.paths)):  # the last that matches is taken
        there = F.size(F.array_except(F.array(*[F.lit(p) for p in each.paths]), F.col("__paths"))) == 0
        layout = F.when(there, F.lit(each.name)).otherwise(layout)
    for each in LAYOUTS:
        layout = F.when(F.col("fingerprint") == _known(each), F.lit(each.name)).otherwise(layout)
    parsed, turns = parsed.withColumn("layout", layout), F.array().cast(TURNS)
    for each in LAYOUTS:
        turns = F.when(F.col("layout") == each.name, _turns(each, F.col("__parsed"))).otherwise(turns)
    return parsed.withColumn("turns", F.coalesce(turns, F.array().cast(TURNS))).drop("__parsed", "__paths")


def unmapped(chats: DataFrame) -> DataFrame:
    """(fingerprint, n): records without a mapping; a null fingerprint is no valid JSON."""
    return chats.where("layout is null").groupBy("fingerprint").agg(F.count("*").alias("n"))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for k, control in enumerate(CONTROLS):
        out = F.replace(out, F.lit(control), F.lit(f"\\{k}"))
    return out


def unescape(text: Column) -> Column:
    """Escapes have two characters and plain text has no backslash, so pairs of them split the text unambiguously."""

    def plain(part: Column) -> Column:
        for k, control in enumerate(CONTROLS):
            part = F.replace(part, F.lit(f"\\{k}"), F.lit(control))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def formatted(turns: Column) -> Column:
    """All turns in the template."""
    one = lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(HEAD), escape(t["text"]), F.lit(CLOSE))
    return F.array_join(F.transform(turns, one), "")


def loss_spans(text: Column, role: str = "assistant") -> Column:
    """(start, size) in code points of the escaped texts of `role` in a formatted text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,size:int>>").alias("spans"))
    head = len(OPEN) + len(HEAD)

    def step(acc: Column, turn: Column) -> Column:
        name = F.split_part(F.substring(turn, len(OPEN) + 1, 2**31 - 1), F.lit(HEAD), F.lit(1))
        size = F.length(turn) - head - F.length(name)
        span = F.struct((acc["at"] + head + F.length(name)).alias("start"), size.alias("size"))
        return F.struct(
            (acc["at"] + F.length(turn) + len(CLOSE)).alias("at"),
            F.when(name == escape(F.lit(role)), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(_split_turns(text), start, step)["spans"]


def _split_turns(text: Column) -> Column:
    """The marked turns without their closing marks."""
    parts = F.split(text, CLOSE)
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def read_back(text: Column) -> Column:
    """Turns from a formatted text."""

    def turn(part: Column) -> Column:
        body = F.substring(part, len(OPEN) + 1, 2**31 - 1)
        cut = F.locate(HEAD, body)
        return F.struct(
            unescape(F.substr(body, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substr(body, cut + len(HEAD))).alias("text"),
        )

    return F.transform(_split_turns(text), turn)


def masked_text(text: Column, spans: Column) -> Column:
    """What the loss mask covers, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(text, s["start"] + 1, s["size"]))), "")


def format_chats(records: DataFrame, record: str = "record") -> DataFrame:
    """`records` with layout, turns, formatted and loss_spans."""
    out = canonical_turns(records, record).withColumn("formatted", formatted(F.col("turns")))
    return out.withColumn("loss_spans", loss_spans(F.col("formatted")))
