"""Chat records of any known layout as canonical turns and as training text.

A record is a JSON object. The paths of its nested fields are hashed to a
fingerprint, which selects a declared mapping to turns of (role, text). The
template marks turns, and a backslash breaks every control string inside a text,
so a text can never forge a mark and can be read back unchanged. All of it is
DataFrame functions.
"""

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


def _turn(role: str | Column, text: Column) -> Column:
    named = F.lit(role) if isinstance(role, str) else F.coalesce(role, F.lit(""))
    return F.struct(named.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _pair(question: str, answer: str) -> Callable[[Column], Column]:
    return lambda r: F.array(_turn("user", r[question]), _turn("assistant", r[answer]))


def _speaker(name: Column) -> Column:
    return F.when(name == "human", "user").when(name == "gpt", "assistant").otherwise(name)


def _with_input(r: Column) -> Column:
    given = F.coalesce(r["input"], F.lit(""))
    question = F.concat(
        F.coalesce(r["instruction"], F.lit("")), F.when(given == "", "").otherwise(F.concat(F.lit("\n"), given))
    )
    return F.array(_turn("user", question), _turn("assistant", r["output"]))


@dataclass(frozen=True)
class Layout:
    """A layout by its field paths, the schema to read it with and its turns from the read record.

    In ``paths`` a ``?`` stands for any scalar and fields are in alphabetical order.
    """

    name: str
    paths: str
    schema: str
    turns: Callable[[Column], Column]


LAYOUTS = (
    Layout(
        "messages",
        "OBJECT<messages: ARRAY<OBJECT<content: ?, role: ?>>>",
        "messages array<struct<role:string,content:string>>",
        lambda r: F.transform(r["messages"], lambda m: _turn(m["role"], m["content"])),
    ),
    Layout(
        "from_value",
        "OBJECT<conversations: ARRAY<OBJECT<from: ?, value: ?>>>",
        "conversations array<struct<`from`:string,value:string>>",
        lambda r: F.transform(r["conversations"], lambda m: _turn(_speaker(m["from"]), m["value"])),
    ),
    Layout(
        "prompt_completion",
        "OBJECT<completion: ?, prompt: ?>",
        "prompt string, completion string",
        _pair("prompt", "completion"),
    ),
    Layout(
        "prompt_response",
        "OBJECT<prompt: ?, response: ?>",
        "prompt string, response string",
        _pair("prompt", "response"),
    ),
    Layout(
        "instruction",
        "OBJECT<instruction: ?, output: ?>",
        "instruction string, output string",
        _pair("instruction", "output"),
    ),
    Layout(
        "instruction_input",
        "OBJECT<input: ?, instruction: ?, output: ?>",
        "instruction string, input string, output string",
        _with_input,
    ),
)
# A list without entries has no fields to tell layouts apart by.
EMPTY_LISTS = {"OBJECT<messages: ARRAY<?>>", "OBJECT<conversations: ARRAY<?>>"}

# The layout of the records made by conversation_records.
MESSAGES = LAYOUTS[0].paths
# Shorter records are below all bounds of the parser: 20,000,000 characters of a string, 128 MiB of a value.
LONG_RECORD = 16_000_000
# The JSON reader has the first bound as a setting.
_UNBOUNDED = {"maxStringLen": str(2**31 - 1)}

_SCALARS = r"\b(STRING|VOID|BIGINT|BOOLEAN|DOUBLE|FLOAT|DATE|BINARY|DECIMAL\([0-9]+,[0-9]+\))(?=[,>]|$)"


def _paths_of(json: Column) -> Column:
    return F.regexp_replace(F.schema_of_variant(F.try_parse_json(json)), _SCALARS, "?")


def _shortened(record: Column) -> Column:
    """A record without escapes and with the first 100 characters of each string, so of the same paths."""
    plain = F.regexp_replace(record, r"(?s)\\.", "")
    return F.regexp_replace(plain, r'"([^"]{0,100})[^"]*+"', '"$1"')


def field_paths(record: str) -> Column:
    """The nested fields of a JSON record, scalars of any type as ``?``; null if it is no JSON.

    A record beyond the bounds of the parser is read with its strings cut short.
    An error is raised if that is too long as well.
    """
    text, short = F.col(record), _shortened(F.col(record))
    too_long = F.raise_error(F.lit("a record is too long to tell its layout"))
    cut = F.coalesce(
        _paths_of(text),
        _paths_of(short),
        F.when(F.octet_length(short) > LONG_RECORD, too_long).cast("string"),
    )
    return F.when(F.char_length(text) < LONG_RECORD, _paths_of(text)).otherwise(cut)


def fingerprint(record: str, paths: str | None = None) -> Column:
    found = field_paths(record)
    if paths:
        found = F.when(F.col(paths).isNotNull(), F.col(paths)).otherwise(found)
    return F.when(found.isNotNull(), F.xxhash64(found))


def canonical_turns(
    records: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS, paths: str | None = None
) -> DataFrame:
    """``records`` with ``fingerprint``, ``layout`` and ``turns`` added.

    A record of an unknown layout, or that is no JSON object, has null layout
    and turns. Null roles and texts are empty; a list without entries has no
    turns. Columns of these names that are there already are replaced.
    ``paths`` names a column with the field paths of records whose source is
    known; such a record is not parsed for its layout, and it is an error if it
    yields no turns.
    """
    rows = records.withColumn("fingerprint", fingerprint(record, paths))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for empty in sorted(EMPTY_LISTS):
        is_this = F.col("fingerprint") == F.xxhash64(F.lit(empty))
        name = F.when(is_this, "empty").otherwise(name)
        turns = F.when(is_this, F.array().cast(TURNS)).otherwise(turns)
    for layout in layouts:
        is_this = F.col("fingerprint") == F.xxhash64(F.lit(layout.paths))
        mapped = layout.turns(F.from_json(record, layout.schema, _UNBOUNDED))
        name = F.when(is_this, layout.name).otherwise(name)
        turns = F.when(is_this, mapped.cast(TURNS)).otherwise(turns)
    if paths:
        unread = F.raise_error(F.lit("a record of a known source has no turns"))
        turns = F.coalesce(turns, F.when(F.col(paths).isNotNull(), unread).cast(TURNS))
    return rows.withColumn("layout", name).withColumn("turns", turns)


START, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
# Marks of this template and of other common ones: none of them survives in a text.
CONTROLS = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Double backslashes and put one behind the first character of each control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _with_parts(turns: Column) -> Column:
    """A question and answer with the lines after the first as input."""
    question, answer = turns[0]["content"], turns[1]["content"]
    first = F.substring_index(question, "\n", 1)
    return F.to_json(
        F.struct(
            first.alias("instruction"),
            F.substring(question, F.char_length(first) + 2, F.char_length(question)).alias("input"),
            answer.alias("output"),
        )
    )


def _in_layout(turns: Column, pick: Column, messages: Column) -> Column:
    """The turns in the layout of number ``pick``; as ``messages`` where that layout could not tell them all."""
    speakers = F.transform(
        turns,
        lambda t: F.struct(
            F.when(t["role"] == "user", "human").when(t["role"] == "assistant", "gpt").otherwise(t["role"]).alias("from"),
            t["content"].alias("value"),
        ),
    )
    plain_roles = ~F.exists(turns, lambda t: t["role"].isin("human", "gpt"))
    pair = (F.size(turns) == 2) & (turns[0]["role"] == "user") & (F.element_at(turns, -1)["role"] == "assistant")
    # A last line end would be lost with an empty input.
    parts = pair & ~F.endswith(turns[0]["content"], F.lit("\n"))

    def two(question: str, answer: str) -> Column:
        return F.to_json(F.struct(turns[0]["content"].alias(question), turns[1]["content"].alias(answer)))

    return (
        F.when((pick == 1) & plain_roles, F.to_json(F.struct(speakers.alias("conversations"))))
        .when((pick == 2) & pair, two("prompt", "completion"))
        .when((pick == 3) & pair, two("prompt", "response"))
        .when((pick == 4) & pair, two("instruction", "output"))
        .when((pick == 5) & parts, _with_parts(turns))
        .otherwise(messages)
    )


def conversation_records(rows: DataFrame, varied: bool = False) -> DataFrame:
    """(conv_id, record, paths): turn rows (conv_id, turn, role, text) as one JSON record per conversation.

    Turns are in order of turn, then role and text; null roles and texts are
    empty and a null conv_id is a conversation. A conversation has to fit a row.
    Records are lists of messages; if ``varied``, a hash of conv_id gives each one of
    the layouts that can hold its turns, as sources of several kinds would.
    ``paths`` has the field paths of records too long for the parser, else null.
    """
    turn = F.struct(
        "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")
    )
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    listed = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    made = grouped.withColumn("record", F.to_json(F.struct(listed.alias("messages"))))
    long = F.char_length("record") >= LONG_RECORD
    record = F.col("record")
    if varied:
        pick = F.pmod(F.xxhash64(F.col("conv_id").cast("string")), F.lit(len(LAYOUTS)))
        record = F.when(long, record).otherwise(_in_layout(F.col("_turns"), pick, record))
    return made.select("conv_id", record.alias("record"), F.when(long, MESSAGES).alias("paths"))


def format_turns(turns: str = "turns") -> Column:
    """The training text: marks around each escaped role and text."""
    marked = F.transform(
        turns,
        lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END)),
    )
    return F.array_join(marked, "")


def loss_mask(turns: str = "turns", role: str = "assistant") -> Column:
    """(start, chars) of each text of ``role`` in the training text, in characters from zero."""
    marks = len(START) + len(TEXT)

    def add(state: Column, t: Column) -> Column:
        head = marks + F.char_length(escape(t["role"]))
        body = F.char_length(escape(t["text"]))
        span = F.struct((state["at"] + head).alias("start"), body.alias("chars"))
        own = F.when(t["role"] == role, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + head + body + len(END)).alias("at"), own.alias("spans"))

    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,chars:int>>").alias("spans")
    )
    return F.aggregate(turns, start, add, lambda state: state["spans"])


def read_turns(formatted: str = "formatted") -> Column:
    """The turns, read back from the training text."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>"), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(1), F.char_length(p) - len(END))

    def turn(p: Column) -> Column:
        fields = F.split(body(p), r"<\|text\|>", 2)
        return F.struct(unescape(fields[0]).alias("role"), unescape(fields[1]).alias("text"))

    return F.transform(parts, turn)


def read_loss(formatted: str = "formatted", mask: str = "mask") -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    cut = F.transform(
        mask, lambda m: unescape(F.substring(F.col(formatted), m["start"] + 1, m["chars"]))
    )
    return F.array_join(cut, "")
