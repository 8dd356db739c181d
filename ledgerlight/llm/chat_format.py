"""Chat records of many layouts to one reversible text format, with SQL functions only.

A record is a JSON object. The paths of all its nested fields, whatever their names,
are hashed; that schema fingerprint selects a declarative mapping (``MAPPINGS``) of
fields to roles, which turns prompt, instruction and message layouts alike into
canonical turns of (role, text). Turns become marked text; control strings inside
texts are escaped, so that reading the text back gives exactly the turns. Roles stay
as given, but for the names that a layout has of its own.

Records may also be columns: then their paths are those of the DataFrame's schema, hashed
in the same way, and texts of any length pass without a JSON parser. JSON strings may be
as long as a row can hold; their paths are read from the record with long strings made
short, where the parser would refuse it.

Null texts and null roles are empty strings. A record of an unknown layout, also one
with a field beyond a known layout's, keeps its fingerprint and has null turns and
text. A record that is no JSON object has no fingerprint. A conversation without turns
gives an empty array and an empty text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

#: Fields of a record that mappings may name. Arrays of objects hold one turn each.
MESSAGE_LISTS = {"messages": ("role", "content"), "conversations": ("from", "value"), "turns": ("speaker", "text")}
PLAIN_FIELDS = ("system", "prompt", "completion", "response", "instruction", "input", "output", "question", "answer")

#: Layouts: a message list, or plain fields with the role each one speaks; fields marked optional may be absent.
MAPPINGS = {
    "messages": {"list": "messages"},
    "conversations": {"list": "conversations", "roles": {"human": "user", "gpt": "assistant"}},
    "turns": {"list": "turns", "roles": {"human": "user", "bot": "assistant", "model": "assistant"}},
    "prompt-completion": {"fields": (("system", "system", True), ("prompt", "user", False), ("completion", "assistant", False))},
    "prompt-response": {"fields": (("system", "system", True), ("prompt", "user", False), ("response", "assistant", False))},
    "instruction": {"fields": (("system", "system", True), ("instruction", "user", False), ("input", "user", True), ("output", "assistant", False))},
    "question-answer": {"fields": (("system", "system", True), ("question", "user", False), ("answer", "assistant", False))},
}

#: role: (what opens its turn, what closes it). Other roles name themselves.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("[OUT] ", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
OTHER = ("[ROLE]", "[SAYS]", "[/ROLE]")
_CONTROL = r"(?:\[/?INST\]|\[OUT\]|</?s>|<</?SYS>>|\[/?ROLE\]|\[SAYS\])"
_OPEN = r"(\[INST\] |\[OUT\] |<<SYS>>|\[ROLE\](?s:.*?)\[SAYS\])"
_TURN = _OPEN + r"(?s:(.*?))( \[/INST\]|</s>|<</SYS>>|\[/ROLE\])"

_RECORD = ", ".join([f"{name} array<struct<{r}: string, {t}: string>>" for name, (r, t) in MESSAGE_LISTS.items()] + [f"{f} string" for f in PLAIN_FIELDS])


def _turn(role: str, text: str, names: dict[str, str]):
    named = F.create_map(*[F.lit(x) for pair in names.items() for x in pair]) if names else None
    said = (lambda m: F.coalesce(F.element_at(named, m[role]), m[role])) if names else (lambda m: m[role])
    return lambda m: F.struct(F.coalesce(said(m), F.lit("")).alias("role"), F.coalesce(m[text], F.lit("")).alias("text"))


def _paths(json: Column) -> Column:
    """The nested fields of a JSON text: names in order, braces around those of an object, brackets around an array's; null if it is no object."""
    # Of strings only the ends matter here: what the parser of variants refuses for its size is tried again with long strings cut out.
    plain = F.replace(F.replace(json, F.lit("\\\\"), F.lit("")), F.lit('\\"'), F.lit(""))
    brief = F.regexp_replace(plain, r'"[^"]{100,}+"', '""')
    shape = F.schema_of_variant(F.coalesce(F.try_parse_json(json), F.try_parse_json(brief)))
    shape = F.regexp_replace(F.regexp_replace(shape, "OBJECT<", "{"), "ARRAY<", "[")
    # What is left between names and braces are types of values.
    shape = F.regexp_replace(shape, r": (?:[A-Z_]+(?:\([0-9, ]+\))?)(?=[,>])", "")
    return F.when(shape.startswith("{"), shape)


def _hash(paths: Column) -> Column:
    return F.lower(F.hex(F.xxhash64(paths)))


def _layouts() -> list[tuple[str, str]]:
    """The paths of every set of fields that a mapping accepts."""
    found = []
    for name, about in MAPPINGS.items():
        if "list" in about:
            at, parts = about["list"], sorted(MESSAGE_LISTS[about["list"]])
            found += [(f"{{{at}: [{{{', '.join(some)}>>>", name) for some in (parts, parts[:1], parts[1:])]
            found += [(f"{{{at}: [{{>>>", name), (f"{{{at}: [VOID>>", name)]
        else:
            sets: list[list[str]] = [[]]
            for field, _, optional in about["fields"]:
                sets = [s + [field] for s in sets] + (sets if optional else [])
            found += [(f"{{{', '.join(sorted(s))}>", name) for s in sets]
    return found


def schema_fingerprint(json: Column) -> Column:
    """Hash of the paths of a JSON text's nested fields, 16 hex digits at most."""
    paths = _paths(json)
    return F.when(paths.isNotNull(), _hash(paths))


def typed_paths(kind: DataType) -> str:
    """The paths of a type's nested fields, written as those of a JSON record."""
    if isinstance(kind, StructType):
        return "{" + ", ".join(f"{f.name}{of if (of := typed_paths(f.dataType)) == '' else ': ' + of}" for f in sorted(kind.fields, key=lambda f: f.name)) + ">"
    return f"[{typed_paths(kind.elementType)}>" if isinstance(kind, ArrayType) else ""


def _by_hash() -> Column:
    return F.create_map(*[x for paths, name in _layouts() for x in (_hash(F.lit(paths)), F.lit(name))])


def _turns(mapping: str, record: Column, held: list[str] | None = None) -> Column:
    """The turns of a record whose layout has this mapping; ``held``: the fields that it has, if not all."""
    about = MAPPINGS[mapping]
    if "list" in about:
        role, text = MESSAGE_LISTS[about["list"]]
        return F.transform(record[about["list"]], _turn(role, text, about.get("roles", {})))
    return F.array_compact(F.array(*[F.when(record[f].isNotNull(), F.struct(F.lit(r).alias("role"), record[f].alias("text"))) for f, r, _ in about["fields"] if held is None or f in held]))


def canonical_turns(records: DataFrame, json_col: str = "record") -> DataFrame:
    """Adds schema_fingerprint, mapping (null: unknown) and turns: array of (role, text)."""
    parsed = records.withColumn("_r", F.from_json(json_col, _RECORD, {"maxStringLen": str((1 << 31) - 1)})).withColumn("schema_fingerprint", schema_fingerprint(F.col(json_col)))
    parsed = parsed.withColumn("mapping", F.element_at(_by_hash(), F.col("schema_fingerprint")))
    turns = F.lit(None).cast("array<struct<role: string, text: string>>")
    for name in MAPPINGS:
        turns = F.when(F.col("mapping") == name, _turns(name, F.col("_r"))).otherwise(turns)
    return parsed.withColumn("turns", turns).drop("_r")


def canonical_turns_of_columns(records: DataFrame, record_col: str = "record") -> DataFrame:
    """As ``canonical_turns``, of records in a struct column: its type's fingerprint selects the one mapping of all rows."""
    kind = records.schema[record_col].dataType
    paths = typed_paths(kind)
    known = dict(_layouts()).get(paths)
    turns = _turns(known, F.col(record_col), kind.names) if known else F.lit(None).cast("array<struct<role: string, text: string>>")
    fingerprint = _hash(F.lit(paths))
    return records.withColumns({"schema_fingerprint": fingerprint, "mapping": F.element_at(_by_hash(), fingerprint), "turns": turns})


def escape(text: Column) -> Column:
    """Doubles backslashes and puts one behind the first character of every control string."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([\[<])(?=(?<=\[)(?:/?INST|OUT|/?ROLE|SAYS)\]|(?<=<)(?:/?s>|</?SYS>>))", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\((?s:.))", "$1")


def format_turns(turns: Column) -> Column:
    """Turns as one text."""

    def one(t: Column) -> Column:
        text = escape(t["text"])
        said = F.concat(F.lit(OTHER[0]), escape(t["role"]), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
        for role, (opens, closes) in MARKS.items():
            said = F.when(t["role"] == role, F.concat(F.lit(opens), text, F.lit(closes))).otherwise(said)
        return said

    return F.array_join(F.transform(turns, one), "")


def read_turns(formatted: Column) -> Column:
    """The inverse of ``format_turns``."""
    opens, texts = (F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(k)) for k in (1, 2))
    named = {opens: role for role, (opens, _) in MARKS.items()}

    def one(mark: Column, text: Column) -> Column:
        role = unescape(F.substring(mark, len(OTHER[0]) + 1, F.length(mark) - len(OTHER[0]) - len(OTHER[1])))
        for opening, name in named.items():
            role = F.when(mark == opening, F.lit(name)).otherwise(role)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.zip_with(opens, texts, one)


def format_chats(records: DataFrame, json_col: str = "record") -> DataFrame:
    """Adds schema_fingerprint, mapping, turns, formatted and loss_spans (the loss mask) to records, in JSON or a struct column."""
    is_text = dict(records.dtypes)[json_col] == "string"
    return (canonical_turns if is_text else canonical_turns_of_columns)(records, json_col).withColumns({"formatted": format_turns(F.col("turns")), "loss_spans": loss_spans(F.col("turns"))})


def loss_spans(turns: Column) -> Column:
    """The loss mask over the formatted text of turns: (start, end) in code points, from 0, of each assistant text."""
    opens, closes = (F.lit(len(x)) for x in MARKS["assistant"])

    def add(held: Column, t: Column) -> Column:
        said = F.length(format_turns(F.array(t)))
        span = F.struct((held["at"] + opens).alias("start"), (held["at"] + said - closes).alias("end"))
        spans = F.when(t["role"] == "assistant", F.concat(held["spans"], F.array(span))).otherwise(held["spans"])
        return F.struct((held["at"] + said).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))
    return F.aggregate(turns, start, add, lambda held: held["spans"])


def loss_text(formatted: Column) -> Column:
    """All text under the loss mask of a formatted text, unescaped: each assistant text once, in order."""
    opens, closes = (re.escape(x) for x in MARKS["assistant"])
    found = F.regexp_extract_all(formatted, F.lit(rf"{opens}(?s:(.*?)){closes}"), F.lit(1))
    return F.array_join(F.transform(found, unescape), "")


def records_of_turns(rows: DataFrame) -> DataFrame:
    """Rows by turn (conv_id, turn, role, text) to one ``messages`` record (a struct) each, ties in turn by role and text.

    A conversation becomes one row, as its text is one sequence; nothing else is gathered.
    """
    said = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    messages = F.transform(F.array_sort(F.collect_list(said)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return rows.groupBy("conv_id").agg(F.struct(messages.alias("messages")).alias("record"))
