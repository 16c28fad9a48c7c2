"""Conversations of many layouts as canonical turns, and turns as training text with a loss mask.

Only DataFrame functions. A record's layout is told by a fingerprint: the SHA-256 of the nested field
paths it has, among the paths that any mapping uses; `list[].field` is there if any element of the list has it.
Each fingerprint selects a declarative mapping (`LAYOUTS`), which says where the turns are or which fields make up
which role's turn. A list whose messages name their fields differently has a fingerprint of its own, and each
message gives the fields it has. Records are JSON, so one column may hold many layouts, or typed columns; fields that no
mapping uses do not change a fingerprint.

A turn is written as its marks, role and text. Inside roles and texts a backslash is put before each
backslash and after the first character of each control string, of this template and of other common
ones, so that no text can end a turn, and reading back is exact.

Cases: null texts and roles are empty; several text fields of one message are joined by a blank line; a message that
is a bare JSON string is a text without role; in typed columns a null field is not there; a record of no known layout has null turns and keeps its
fingerprint; turns of one conversation are ordered by turn (null first), then role and text; repeated rows
are repeated turns; a null conv_id is one conversation; an empty table gives no rows. A conversation is one
record of the output, so its turns meet in one task; they are never collected across conversations.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

TURNS = "array<struct<role:string,text:string>>"
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common templates, none of which may appear unescaped in a text.
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>")
LOSS_ROLES = ("assistant",)
#: Names that data sets use for the same role.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


class JsonRecord:
    """Reads a VARIANT."""

    def __init__(self, document: Column):
        self.document = document

    def at(self, path: str) -> Column:
        return F.try_variant_get(self.document, f"$.{path}", "string")

    def elements(self, name: str) -> Column:
        return F.try_variant_get(self.document, f"$.{name}", "array<variant>")

    def has(self, path: str) -> Column:
        name, _, inner = path.partition("[].")
        if inner:
            return F.coalesce(F.exists(self.elements(name), lambda m: F.try_variant_get(m, f"$.{inner}", "variant").isNotNull()), F.lit(False))
        return F.try_variant_get(self.document, f"$.{path}", "variant").isNotNull()

    def messages(self, name: str, roles: tuple[str, ...], texts: tuple[str, ...]) -> Column:
        def turn(m: Column) -> Column:
            field = lambda f: F.try_variant_get(m, f"$.{f}", "string")
            bare = F.when(F.schema_of_variant(m) == "STRING", F.try_variant_get(m, "$", "string"))
            return _turn(F.coalesce(*map(field, roles), F.lit("")), _joined([*map(field, texts), bare]))

        return F.transform(self.elements(name), turn)


class ColumnRecord:
    """Reads the typed columns of a table with this schema."""

    def __init__(self, schema: StructType):
        self.tops = {f.name: f.dataType for f in schema.fields}

    def _inner(self, name: str) -> list[str]:
        kind = self.tops.get(name)
        return kind.elementType.names if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) else []

    def at(self, path: str) -> Column:
        return F.col(path).cast("string") if path in self.tops else F.lit(None).cast("string")

    def has(self, path: str) -> Column:
        name, _, inner = path.partition("[].")
        if not inner:
            return F.col(path).isNotNull() if path in self.tops else F.lit(False)
        return F.coalesce(F.exists(F.col(name), lambda m: m[inner].isNotNull()), F.lit(False)) if inner in self._inner(name) else F.lit(False)

    def messages(self, name: str, roles: tuple[str, ...], texts: tuple[str, ...]) -> Column:
        inner = self._inner(name)
        if not inner:
            return F.lit(None).cast(TURNS)

        def turn(m: Column) -> Column:
            role, text = ([m[f].cast("string") for f in fields if f in inner] for fields in (roles, texts))
            return _turn(F.coalesce(*role, F.lit("")), _joined(text))

        return F.transform(F.col(name), turn)


@dataclass(frozen=True)
class Layout:
    """Either a list of messages, which name role and text by some of the fields given, or fields that are turns themselves."""

    messages: str = ""
    roles: tuple[str, ...] = ()
    texts: tuple[str, ...] = ()
    fields: tuple[tuple[str, tuple[str, ...]], ...] = field(default=())  # role, paths joined by a blank line

    def paths(self) -> tuple[str, ...]:
        if self.messages:
            return tuple(f"{self.messages}[].{f}" for f in (*self.roles, *self.texts))
        return tuple(p for _, paths in self.fields for p in paths)

    def fingerprints(self) -> list[str]:
        """Of the records that the mapping is for: all fields, or any role fields with any text fields."""
        if not self.messages:
            return [fingerprint_of(self.paths())]
        some = lambda names: [x for n in range(1, len(names) + 1) for x in combinations(names, n)]
        return [fingerprint_of(f"{self.messages}[].{f}" for f in (*r, *t)) for r in some(self.roles) for t in some(self.texts)]

    def turns(self, record: JsonRecord | ColumnRecord) -> Column:
        if self.messages:
            return record.messages(self.messages, self.roles, self.texts)
        return F.array(*[_turn(F.lit(role), _joined([record.at(p) for p in paths])) for role, paths in self.fields])


def _fields(**roles: str | tuple[str, ...]) -> Layout:
    return Layout(fields=tuple((r, (p,) if isinstance(p, str) else p) for r, p in roles.items()))


def fingerprint_of(paths) -> str:
    """SHA-256 of the sorted nested paths."""
    return sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


LAYOUTS = (
    *[Layout(name, ("role", "from"), ("content", "text", "value")) for name in ("messages", "conversations", "conversation", "turns")],
    _fields(user="prompt", assistant="completion"),
    _fields(user="prompt", assistant="response"),
    _fields(system="system", user="prompt", assistant="response"),
    _fields(user="instruction", assistant="output"),
    _fields(user=("instruction", "input"), assistant="output"),
    _fields(user=("instruction", "context"), assistant="response"),
    _fields(user="question", assistant="answer"),
    _fields(system="system_prompt", user="question", assistant="response"),
)


KNOWN_PATHS = tuple(sorted({p for layout in LAYOUTS for p in layout.paths()}))


def _joined(texts: list[Column]) -> Column:
    return F.concat_ws("\n\n", *[F.nullif(t, F.lit("")) for t in texts])


def _turn(role: Column, text: Column) -> Column:
    known = F.coalesce(role, F.lit(""))
    renamed = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv]), known), known)
    return F.struct(renamed.alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def fingerprint(record: JsonRecord | ColumnRecord) -> Column:
    """Of the paths among `KNOWN_PATHS` that a record has (a JSON null counts as there)."""
    there = [F.when(record.has(p), F.lit(p)) for p in KNOWN_PATHS]
    return F.sha2(F.array_join(F.array_compact(F.array(*there)), "\n"), 256)


def _mapped(records: DataFrame, record: JsonRecord | ColumnRecord, mark: str, turns: str) -> DataFrame:
    """Add each record's fingerprint as ``mark`` and what the mapping selected by it gives as ``turns``."""
    found = F.lit(None).cast(TURNS)
    for layout in LAYOUTS:
        found = F.when(F.col(mark).isin(layout.fingerprints()), layout.turns(record)).otherwise(found)
    return records.withColumn(mark, fingerprint(record)).withColumn(turns, found)


def canonical_turns(records: DataFrame, column: str = "record") -> DataFrame:
    """Add `fingerprint` and `turns` to records that hold JSON text in ``column``."""
    return _mapped(records, JsonRecord(F.try_parse_json(F.col(column).cast("string"))), "fingerprint", "turns")


def structured_turns(records: DataFrame) -> DataFrame:
    """Add `fingerprint` and `canonical` turns to records whose fields are columns."""
    return _mapped(records, ColumnRecord(records.schema), "fingerprint", "canonical")


def turn_rows(rows: DataFrame) -> DataFrame:
    """Conversations given as one row per turn (conv_id, turn, role, text): conv_id, fingerprint and `turns`.

    The rows of a conversation become one record, whose own fingerprint selects the mapping as for any other.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    own = rows.select(F.col("conv_id").cast("long"), F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    listed = own.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    return structured_turns(listed).select("conv_id", "fingerprint", F.col("canonical").alias("turns"))


def escaped(text: Column) -> Column:
    tails = "|".join(f"{_quoted(c[0])}(?={_quoted(c[1:])})" for c in CONTROLS)
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({tails})", "$1\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


def formatted(conversations: DataFrame) -> DataFrame:
    """Replace `turns` by `formatted` text and `loss_spans` (start, length in code points, from 0)."""
    parts = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), escaped(t["role"]).alias("r"), escaped(t["text"]).alias("x")))
    out = conversations.withColumn("_parts", parts)
    text = F.array_join(F.transform("_parts", lambda p: F.concat(F.lit(TURN), p["r"], F.lit(TEXT), p["x"], F.lit(END))), "")
    head = len(TURN) + len(TEXT)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state, p):
        begin = state["at"] + head + F.length(p["r"])
        span = F.array(F.struct(begin.cast("long").alias("start"), F.length(p["x"]).cast("long").alias("length")))
        spans = F.when(p["role"].isin(*LOSS_ROLES), F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct((begin + F.length(p["x"]) + len(END)).cast("long").alias("at"), spans.alias("spans"))

    return out.withColumns({"formatted": text, "loss_spans": F.aggregate("_parts", start, step, lambda s: s["spans"])}).drop("_parts", "turns")


def read_turns(text: Column) -> Column:
    """The turns that a formatted text holds."""
    pieces = F.split(text, _quoted(END))

    def turn(piece):
        halves = F.split(F.substr(piece, F.lit(len(TURN) + 1)), _quoted(TEXT), 2)
        return F.struct(unescaped(halves[0]).alias("role"), unescaped(halves[1]).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def read_loss(text: Column, spans: Column) -> Column:
    """The texts under the loss mask, unescaped and concatenated."""
    under = F.transform(spans, lambda s: unescaped(F.substr(text, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(under, "")
