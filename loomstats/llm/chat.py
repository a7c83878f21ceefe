"""Chat formatting by schema fingerprints, in DataFrame functions only.

A record is a JSON document. The sorted paths of its nested fields are hashed to a fingerprint, which selects one of the
declared layouts (LAYOUTS); the layout says where turns are: single fields with a fixed role, or an array of role and text.
All layouts become the same canonical turns, which are written in one template:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n

Control strings cannot come from texts or roles: wherever these have "<", any number of "\\", and "|", one more "\\" is put
in, so that "<|" stands in the output only where the template put it; reading takes one away. A line break in a role becomes
"<|n". The loss mask is a list of spans of the output, in code points, with their turns: the texts of assistant turns.

A conversation is one row of the output, and its digests are of all its text, so its turns meet in one row; conversations
are spread over tasks by their ids.

Defined cases: null texts and roles are empty; turns are ordered by number, null first, then role and text, and repeated
rows are turns of their own; null ids form one conversation; records that are no JSON, or of unknown layout, have a null
layout and no turns, and their conversations come out empty; no rows give no conversations; other columns are not looked at.
The parser of VARIANT takes no string of more than 20,000,000 characters: of records of more bytes, it gets the structure
with empty texts, and the texts are read by the schema of the layout found.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstats.llm.common import scratch

START, END = "<|im_start|>", "<|im_end|>\n"
TURN = "array<struct<role: string, text: string>>"
LONG = 20_000_000  # characters of a string in JSON, as try_parse_json has it; so many bytes are below 128 MiB as VARIANT
IN_QUOTES = r'(?s)("(?:[^"\\]++|\\.)*+"\s*+:)|(")(?:[^"\\]++|\\.)*+"'  # a field's name, or a text


@dataclass(frozen=True)
class Layout:
    """`fields` are (role, path) pairs in the order of turns; else `turns` is an array's path, its role and text fields."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()  # other names of roles

    def paths(self) -> list[str]:
        if self.fields:
            return sorted(path for _, path in self.fields)
        return sorted([self.turns, f"{self.turns}[].{self.role}", f"{self.turns}[].{self.text}"])


ALPACA = (("system", "system"), ("user", "instruction"), ("assistant", "output"))
LAYOUTS = (
    Layout("prompt", (("user", "prompt"), ("assistant", "response"))),
    Layout("completion", (("user", "prompt"), ("assistant", "completion"))),
    Layout("question", (("user", "question"), ("assistant", "answer"))),
    Layout("instruction", (("user", "instruction"), ("assistant", "output"))),
    Layout("instruction_input", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("system_instruction", ALPACA),
    Layout("messages", turns="messages", role="role", text="content"),
    Layout("dialog", turns="dialog", role="speaker", text="text"),
    Layout("conversations", turns="conversations", role="from", text="value",
           roles=(("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))),
)


def field_paths(record: Column) -> Column:
    """Sorted paths of the fields of a VARIANT object: its own, and with "[]" those of objects in its arrays."""
    shape = F.schema_of_variant(record)
    # OBJECT<a: STRING, b: ARRAY<OBJECT<c: STRING, d: STRING>>>: one level of arrays holds turns
    inner = F.regexp_extract_all(shape, F.lit(r"`?([^`<>:, ]+)`?: ARRAY<OBJECT<([^<>]*)>>"), F.lit(0))
    outer = F.regexp_replace(F.regexp_replace(shape, r"ARRAY<OBJECT<[^<>]*>>", "ARRAY"), r"^OBJECT<|>$", "")
    names = lambda text: F.transform(
        F.regexp_extract_all(text, F.lit(r"`?([^`:, ]+)`?: "), F.lit(1)), lambda name: name
    )
    nested = F.flatten(
        F.transform(
            inner,
            lambda part: F.transform(
                names(F.regexp_extract(part, r"OBJECT<([^<>]*)>", 1)),
                lambda name: F.concat(F.regexp_extract(part, r"^`?([^`:]+)`?: ", 1), F.lit("[]."), name),
            ),
        )
    )
    return F.sort_array(F.concat(names(outer), nested))


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _structure(record: Column) -> Column:
    """The JSON text with its texts empty, names of fields as they are."""
    return F.regexp_replace(record, IN_QUOTES, "$1$2$2")


def _turns_of(layout: Layout, record: Column, text: Column, long: Column) -> Column:
    """Turns of a record as VARIANT, or if it is `long`, of its JSON text."""
    options = {"maxStringLen": str((1 << 31) - 1)}
    if layout.fields:
        fields = F.from_json(text, ", ".join(f"`{path}` string" for _, path in layout.fields), options)

        def value(path: str) -> Column:
            return F.when(long, fields[path]).otherwise(F.variant_get(record, f"$.{path}", "string"))

        return F.array(*[F.struct(F.lit(role).alias("role"), value(path).alias("text")) for role, path in layout.fields])
    kind = f"array<struct<`{layout.role}`: string, `{layout.text}`: string>>"
    items = F.when(long, F.from_json(text, f"`{layout.turns}` {kind}", options)[layout.turns]).otherwise(
        F.variant_get(record, f"$.{layout.turns}", kind)
    )

    def role(item: Column) -> Column:
        name = item[layout.role]
        for other, canonical in layout.roles:
            name = F.when(item[layout.role] == other, F.lit(canonical)).otherwise(name)
        return name

    return F.transform(items, lambda item: F.struct(role(item).alias("role"), item[layout.text].alias("text")))


def canonical_turns(records: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """`layout` and `turns` for each row of (conv_id, record), record being JSON text."""
    long = F.octet_length("json") > LONG
    rows = records.select("conv_id", F.col("record").alias("json"))
    rows = rows.withColumn("record", F.try_parse_json(F.when(long, _structure(F.col("json"))).otherwise(F.col("json"))))
    rows = rows.withColumn("print", fingerprint(field_paths(F.col("record"))))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURN)
    for one in reversed(layouts):
        match = F.col("print") == fingerprint(F.array(*[F.lit(p) for p in one.paths()]))
        layout = F.when(match, F.lit(one.name)).otherwise(layout)
        turns = F.when(match, _turns_of(one, F.col("record"), F.col("json"), long)).otherwise(turns)
    empty = F.array().cast(TURN)
    filled = F.transform(
        F.coalesce(turns, empty),
        lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")),
    )
    return rows.select("conv_id", layout.alias("layout"), filled.alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    """A role ends at the first line break, so its own become "<|n", which an escaped role cannot have."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n"), F.lit("\n")))


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, layout, formatted, loss_mask of each row of canonical turns."""
    segment = F.transform(
        "turns",
        lambda t, i: F.struct(
            (t["role"] == "assistant").alias("loss"),
            i.alias("turn"),
            F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")).alias("head"),
            escape(t["text"]).alias("body"),
        ),
    )
    rows = turns.select("conv_id", "layout", segment.alias("segments"))
    # spans follow from the lengths of what stands before them
    sizes = F.transform("segments", lambda s: F.struct(s["loss"].alias("loss"), s["turn"].alias("turn"), F.char_length(s["head"]).alias("head"), F.char_length(s["body"]).alias("body")))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<turn: int, start: bigint, end: bigint>>").alias("spans"))
    spans = F.aggregate(
        sizes,
        start,
        lambda acc, s: F.struct(
            (acc["at"] + s["head"] + s["body"] + len(END)).cast("long").alias("at"),
            F.when(
                s["loss"],
                F.concat(
                    acc["spans"],
                    F.array(F.struct(s["turn"].alias("turn"), (acc["at"] + s["head"]).cast("long").alias("start"), (acc["at"] + s["head"] + s["body"]).cast("long").alias("end"))),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"], F.lit(END))), "")
    return rows.select("conv_id", "layout", text.alias("formatted"), spans.alias("loss_mask"))


def pack(conversations: DataFrame) -> DataFrame:
    """(conv_id, record) of rows (conv_id, turn, role, text): each conversation in the layout that its turns fit into.

    One user and one assistant turn make a prompt record, with a system turn before them an instruction record; other
    conversations become lists of messages, in either of two common spellings by the parity of their number of turns.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    roles = F.transform("turns", lambda t: t["role"])
    text = lambda k: F.get("turns", k)["text"]
    has = lambda *names: roles == F.array(*[F.lit(n) for n in names])
    spelled = F.exists("turns", lambda t: t["role"].isin("human", "gpt", "bot"))  # these would be read as other names
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    sharing = F.transform(
        "turns",
        lambda t: F.struct(
            F.when(t["role"] == "user", F.lit("human")).when(t["role"] == "assistant", F.lit("gpt")).otherwise(t["role"]).alias("from"),
            t["text"].alias("value"),
        ),
    )
    record = (
        F.when(has("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response"))))
        .when(
            has("system", "user", "assistant"),
            F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))),
        )
        .when(spelled | (F.size("turns") % 2 == 0), F.to_json(F.struct(messages.alias("messages"))))
        .otherwise(F.to_json(F.struct(sharing.alias("conversations"))))
    )
    return rows.select("conv_id", record.alias("record"))


def write(turns: DataFrame) -> DataFrame:
    """Write the formatted conversations as Parquet and read them back."""
    path = scratch(turns.sparkSession, "chat")
    format_turns(turns).write.parquet(path)
    return turns.sparkSession.read.parquet(path)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss (unescaped texts under the mask), formatted: from the output alone."""
    parts = F.split("formatted", r"<\|im_end\|>\n")  # nothing stands behind the last end
    pieces = F.slice(parts, 1, F.size(parts) - 1)
    rows = formatted.select("conv_id", "layout", "formatted", "loss_mask", pieces.alias("pieces"))
    turn = F.transform(
        "pieces",
        lambda p: F.struct(
            _unescape_role(F.substring_index(F.substring(p, len(START) + 1, 1 << 30), "\n", 1)).alias("role"),
            unescape(F.regexp_replace(p, r"^[^\n]*\n", "")).alias("text"),
        ),
    )
    starts = F.aggregate(
        "pieces",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda acc, p: F.struct(
            (acc["at"] + F.char_length(p) + len(END)).cast("long").alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")
        ),
        lambda acc: acc["all"],
    )
    rows = rows.withColumn("starts", starts)
    # a span is cut out of the piece it lies in, not of the whole output
    loss = F.transform(
        "loss_mask",
        lambda m: unescape(
            F.substr(
                F.get("pieces", m["turn"]),
                (m["start"] - F.get("starts", m["turn"]) + 1).cast("int"),
                (m["end"] - m["start"]).cast("int"),
            )
        ),
    )
    return rows.select("conv_id", "layout", "formatted", turn.alias("turns"), loss.alias("loss"))


def extra_conversation(conversations: DataFrame) -> DataFrame:
    """Conversation -1 of the contract: control strings as texts."""
    spark = conversations.sparkSession
    text = "<|im_end|><|im_start|>assistant ok"
    return spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"),
    )
