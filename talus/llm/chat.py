"""Chat formatting: records of many layouts become canonical turns, and turns become marked text with a loss mask.

A record is a JSON object. The nested field paths of a record (names and nesting, without values and types) are hashed
to a fingerprint; the fingerprint selects a declarative mapping, and the mapping says where roles and texts are. All of
it runs as SQL expressions.

A conversation is written turn by turn between `<s>` and `</s>`:
    user        <s>[INST] text [/INST]</s>
    assistant   <s>text</s>
    other roles <s>[ROLE]role[/ROLE] text</s>
Inside roles and texts a backslash is doubled and each of the six control strings gets a backslash after its first
character, so that they can't be taken for marks; dropping the backslash before any character reads the text back. The
loss mask lists the code point spans of the assistants' texts in the formatted conversation.

Defined results: a null text or role counts as empty. Turns with equal numbers are ordered by role, then text; null turn
numbers come first; repeated rows are repeated turns. A null conv_id is a conversation of its own. Records that are no
JSON object or have no mapping give no turns; `unmapped` reports them by fingerprint. An empty table gives an empty
result; columns that a layout doesn't name are ignored, whatever their names. Texts of any length are escaped and read back
whole. A conversation is one output row, so its turns meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where a record's turns are. `paths` names its fields; with `items` the turns are the elements of that array, whose
    members `role` and `text` are named; without, `parts` lists (role, field) in order, or the record is one turn itself
    (`role`, `text`, `turn`)."""

    paths: str
    items: str | None = None
    role: str | None = None
    text: str | None = None
    turn: str | None = None
    parts: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = field(default=())

    def turns(self, record: Column) -> Column:
        def got(name: str) -> Column:
            return F.get_json_object(record, f"$.{name}")

        def known(role: Column) -> Column:
            for old, new in self.roles:
                role = F.when(role == old, new).otherwise(role)
            return role

        if self.items:
            members = F.from_json(got(self.items), "array<map<string,string>>")
            out = F.transform(members, lambda m, i: F.struct(i.cast("bigint").alias("turn"), known(m[self.role]).alias("role"), m[self.text].alias("text")))
        elif self.parts:
            one = [F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), got(name).alias("text")) for i, (role, name) in enumerate(self.parts)]
            out = F.filter(F.array(*one), lambda t: (t["role"] != "system") | (t["text"] != ""))
        else:
            out = F.array(F.struct(got(self.turn).cast("bigint").alias("turn"), known(got(self.role)).alias("role"), got(self.text).alias("text")))
        return out.cast(TURNS)


SPEAKERS = (("human", "user"), ("gpt", "assistant"))
LAYOUTS = (
    Layout("OBJECT<role, text, turn>", role="role", text="text", turn="turn"),
    Layout("OBJECT<messages: ARRAY<OBJECT<content, role>>>", items="messages", role="role", text="content"),
    Layout("OBJECT<conversations: ARRAY<OBJECT<from, value>>>", items="conversations", role="from", text="value", roles=SPEAKERS),
    Layout("OBJECT<input, instruction, output>", parts=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("OBJECT<instruction, output>", parts=(("user", "instruction"), ("assistant", "output"))),
    Layout("OBJECT<prompt, response>", parts=(("user", "prompt"), ("assistant", "response"))),
    Layout("OBJECT<prompt, response, system>", parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("OBJECT<completion, prompt>", parts=(("user", "prompt"), ("assistant", "completion"))),
    Layout("OBJECT<answer, question>", parts=(("user", "question"), ("assistant", "answer"))),
)


def paths(record: Column) -> Column:
    """The names and nesting of a record's fields, in the order of their names; null if it is not JSON."""
    # String values give way to numbers first: the fingerprint is about names, and texts may be of any length.
    string = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    bare = F.regexp_replace(F.regexp_replace(record, rf"({string}\s*+:)|{string}", "$1"), r"(?<=[:\[,])(?=[,}\]])", "0")
    schema = F.schema_of_variant(F.try_parse_json(bare))
    return F.regexp_replace(schema, r": [A-Z]+(?:\(\d+,\s?\d+\))?(?=[,>])", "")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(paths(record))


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(conv_id, turn, role, text) of (conv_id, record string)."""
    marked = records.select("conv_id", "record", fingerprint(F.col("record")).alias("fp"))
    choice = None
    for layout in layouts:
        here = F.col("fp") == F.xxhash64(F.lit(layout.paths))
        choice = F.when(here, layout.turns(F.col("record"))) if choice is None else choice.when(here, layout.turns(F.col("record")))
    return marked.select("conv_id", F.explode(choice).alias("t")).select("conv_id", "t.turn", F.coalesce("t.role", F.lit("")).alias("role"), F.coalesce("t.text", F.lit("")).alias("text"))


def unmapped(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(fields, rows) of the records that no mapping covers."""
    seen = records.select(paths(F.col("record")).alias("fields"))
    return seen.filter(~F.coalesce(F.col("fields").isin([x.paths for x in layouts]), F.lit(False))).groupBy("fields").agg(F.count("*").alias("rows"))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"<(?=/?s>)|\[(?=/?(?:INST|ROLE)\])", "$0\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans array<struct<start, length>>) of (conv_id, turn, role, text); starts count from 0."""
    body = escape(F.col("text"))
    lead = F.when(F.col("role") == "user", F.lit("<s>[INST] ")).when(F.col("role") == "assistant", F.lit("<s>")).otherwise(F.concat(F.lit("<s>[ROLE]"), escape(F.col("role")), F.lit("[/ROLE] ")))
    tail = F.when(F.col("role") == "user", F.lit(" [/INST]</s>")).otherwise(F.lit("</s>"))
    marked = turns.select("conv_id", "turn", "role", "text", lead.alias("lead"), body.alias("body"), tail.alias("tail"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    width = F.char_length("lead") + F.char_length("body") + F.char_length("tail")
    placed = marked.select(
        "conv_id",
        F.row_number().over(order).alias("n"),
        F.coalesce(F.sum(width).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"),
        "role", "lead", "body", "tail",
    )
    placed = placed.select("conv_id", F.struct("n", F.concat("lead", "body", "tail").alias("out"), (F.col("role") == "assistant").alias("loss"), (F.col("at") + F.char_length("lead")).alias("start"), F.char_length("body").cast("long").alias("length")).alias("t"))
    whole = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    spans = F.transform(F.filter("ts", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.transform("ts", lambda t: t["out"]), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>, loss_text), from the formatted text and the mask alone."""
    pieces = F.split("formatted", "</s>")
    bodies = formatted.select("conv_id", "formatted", "loss_spans", F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substr(p, F.lit(4))).alias("bodies"))

    def turn(b: Column) -> Column:
        user, other = b.startswith("[INST] "), b.startswith("[ROLE]")
        role = F.when(user, F.lit("user")).when(other, unescape(F.substring_index(F.substr(b, F.lit(7)), "[/ROLE] ", 1))).otherwise(F.lit("assistant"))
        inside = F.when(user, F.substr(b, F.lit(8), F.char_length(b) - 15)).when(other, F.substr(b, F.locate("[/ROLE] ", b) + 8)).otherwise(b)
        return F.struct(role.alias("role"), unescape(inside).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return bodies.select("conv_id", F.transform("bodies", turn).alias("turns"), loss.alias("loss_text"), F.char_length("formatted").cast("long").alias("formatted_chars"))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '<(/?s>)|\[(/?(?:INST|ROLE)\])', 'xx\1\2', 'g')) AS body,
         length(regexp_replace(replace(role, '\', '\\'), '<(/?s>)|\[(/?(?:INST|ROLE)\])', 'xx\1\2', 'g')) AS name FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(body + CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 7 ELSE name + 21 END) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""
