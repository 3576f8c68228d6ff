"""Chat formatting: records of several layouts become one kind of turn, then one marked and maskable text.

A record's layout is known by its schema fingerprint: a hash over the paths of its nested fields that are present.
The fingerprint selects a declarative mapping from fields to turns. All of it is DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: The control strings of the template. Inside texts "<|" never stands as it is.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"

#: Layouts by the paths they have: either a list of messages (path of the list, role and text) or single fields by role.
MAPPINGS: tuple[dict, ...] = (
    {"paths": ("messages[].role", "messages[].text"), "messages": ("messages", "role", "text")},
    {"paths": ("conversations[].from", "conversations[].value"), "messages": ("conversations", "from", "value")},
    {"paths": ("prompt", "response"), "fields": (("user", ("prompt",)), ("assistant", ("response",)))},
    {"paths": ("prompt", "response", "system"), "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    {"paths": ("instruction", "output"), "fields": (("user", ("instruction",)), ("assistant", ("output",)))},
    {"paths": ("input", "instruction", "output"), "fields": (("user", ("instruction", "input")), ("assistant", ("output",)))},
)
#: Other names of the three roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


def present_paths(schema: StructType, skip: tuple[str, ...]) -> Column:
    """The paths of all leaf fields that a record has, sorted."""

    def walk(kind: DataType, value: Column, path: str) -> list[Column]:
        if isinstance(kind, StructType):
            return [c for f in kind.fields for c in walk(f.dataType, value[f.name], f"{path}.{f.name}" if path else f.name)]
        if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
            # A path inside a list is present with the list: its values may be null in any element.
            return [F.when(value.isNotNull(), F.lit(f"{path}[].{f.name}")) for f in kind.elementType.fields]
        return [F.when(value.isNotNull(), F.lit(path))]

    leaves = [c for f in schema.fields if f.name not in skip for c in walk(f.dataType, F.col(f"`{f.name}`"), f.name)]
    return F.array_sort(F.array_compact(F.array(*leaves)))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.concat_ws("\n", paths))


def _has(schema: StructType, path: str) -> bool:
    top, _, inner = path.partition("[].")
    if top not in schema.names:
        return False
    kind = schema[top].dataType
    return not inner or isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and inner in kind.elementType.names


def _turn(role: str, text: str, renamed: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda m: F.struct(renamed(m[role]).alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))


def canonical(records: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, layout, turns) of each record; a layout without a mapping has null turns.

    Fields that no mapping names must be dropped by the caller, as they change the fingerprint. Roles are taken as they
    are but for the known other names; a null role or text is an empty one.
    """
    schema = records.schema
    rows = records.withColumn("_layout", fingerprint(present_paths(schema, (key,))))
    turns = F.lit(None).cast(TURNS)
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    renamed = lambda role: F.coalesce(names[role], role, F.lit(""))
    for mapping in MAPPINGS:
        if not all(_has(schema, p) for p in mapping["paths"]):
            continue
        if "messages" in mapping:
            top, role, text = mapping["messages"]
            made = F.transform(top, _turn(role, text, renamed))
        else:
            made = F.array(*[
                F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *fields).alias("text")) for role, fields in mapping["fields"]
            ])
        known = fingerprint(F.array(*[F.lit(p) for p in sorted(mapping["paths"])]))
        turns = F.when(F.col("_layout") == known, made.cast(TURNS)).otherwise(turns)
    return rows.select(key, F.col("_layout").alias("layout"), turns.alias("turns"))


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def formatted(turned: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds the marked text and the spans (first character from 0, length) that count for the loss."""
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(TURN), escaped(t["role"]), F.lit(TEXT)).alias("head"),
        escaped(t["text"]).alias("body"), (t["role"] == loss_role).alias("counts"),
    ))
    rows = turned.withColumn("parts", parts)
    rows = rows.withColumn("formatted", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), ""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, part: Column) -> Column:
        head, body = F.length(part["head"]), F.length(part["body"])
        span = F.array(F.struct((state["at"] + head).alias("start"), body.alias("length")))
        return F.struct(
            (state["at"] + head + body + len(END)).alias("at"),
            F.when(part["counts"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    return rows.withColumn("loss_spans", F.aggregate("parts", start, step, lambda s: s["spans"])).drop("parts")


def read_back(marked: DataFrame) -> DataFrame:
    """Turns and loss text from the marked text and its spans alone."""
    pieces = F.split("formatted", END.replace("|", "\\|"), -1)
    rows = marked.withColumn("pieces", F.filter(pieces, lambda p: p != ""))
    role = lambda p: F.substring_index(p, TEXT, 1)
    turns = F.transform("pieces", lambda p: F.struct(
        unescaped(F.substr(role(p), F.lit(len(TURN) + 1))).alias("role"),
        unescaped(F.substr(p, F.length(role(p)) + len(TEXT) + 1)).alias("text"),
    ))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["length"])))
    return rows.select("*", turns.alias("read_turns"), F.array_join(loss, "").alias("loss_text")).drop("pieces")


def records_of(conversations: DataFrame) -> DataFrame:
    """Conversations by rows of turns, as records of three layouts: prompt and response, these with a system text, or messages.

    Turns are in the order of turn, then role, then text, nulls first. One conversation is one record, so the
    longest conversation must fit a task.
    """
    told = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("told"))
    rows = told.select("conv_id", F.transform("told", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("messages"))
    told_by = F.transform("messages", lambda m: F.coalesce(m["role"], F.lit("")))
    whole = F.forall("messages", lambda m: m["text"].isNotNull())
    text = lambda i: F.get("messages", F.lit(i))["text"]
    pair = whole & (told_by == F.array(F.lit("user"), F.lit("assistant")))
    three = whole & (told_by == F.array(F.lit("system"), F.lit("user"), F.lit("assistant")))
    return rows.select(
        "conv_id", F.when(~pair & ~three, F.col("messages")).alias("messages"),
        F.when(pair, text(0)).when(three, text(1)).alias("prompt"),
        F.when(pair, text(1)).when(three, text(2)).alias("response"), F.when(three, text(0)).alias("system"),
    )


def digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation with what is read back from its formatted text.

    A null role or text is an empty one, a null id is one conversation, an empty table gives no rows.
    """
    out = read_back(formatted(canonical(records_of(conversations))))
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
