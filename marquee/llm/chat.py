"""Chat formatting: schema fingerprints pick declarative mappings; DataFrame functions only.

A record is a JSON object in any of several layouts. Its nested field paths (such as
"messages[].role"), sorted and hashed, are its schema fingerprint; a registry maps fingerprints to declarative mappings
that name where roles and texts stand. Every record becomes the same canonical turns, which one template
then formats with a loss mask over assistant texts.

The template writes <|im_start|>ROLE\\nTEXT<|im_end|>\\n for each turn. Inside roles and texts a
backslash is doubled and every control string of CONTROL gets a backslash after its first character, so no control
string survives inside a text; unescaping drops each backslash that stands before a character. In roles a
line feed is escaped too.

Defined results: a null text or role counts as empty; turns are ordered by turn (null first), then role and text,
repeated rows stay repeated turns; a record whose fingerprint is not registered (or that is not a JSON
object) keeps its row with layout "unknown" and no turns; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Strings that chat templates use for control; all are escaped inside texts.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>"
#: Possessive, so that long roles need no deep stack.
TURN = r"(?s)<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n(.*?)<\|im_end\|>\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """fields: (role, path) of records that hold one text for each field; items: (array, role field, text field) of records with a list.

    Fields that are null or missing give no turn, unless named in `required`.
    """

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    items: tuple[str, str, str] | None = None
    required: tuple[str, ...] = ()

    @property
    def paths(self) -> list[str]:
        if self.items:
            return sorted([self.items[0], f"{self.items[0]}[].{self.items[1]}", f"{self.items[0]}[].{self.items[2]}"])
        return sorted({path for _, path in self.fields})

    @property
    def fingerprint(self) -> str:
        return hashlib.md5("\n".join(self.paths).encode()).hexdigest()


#: The registry.
LAYOUTS = (
    Layout("prompt", (("user", "prompt"), ("assistant", "completion")), required=("prompt", "completion")),
    Layout("response", (("user", "prompt"), ("assistant", "response")), required=("prompt", "response")),
    Layout("instruction", (("system", "system"), ("user", "instruction"), ("assistant", "output")), required=("system", "instruction", "output")),
    Layout("instruction_input", (("user", "instruction"), ("user", "input"), ("assistant", "output")), required=("instruction", "output")),
    Layout("instruction_output", (("user", "instruction"), ("assistant", "output")), required=("instruction", "output")),
    Layout("messages", items=("messages", "role", "content")),
    Layout("conversations", items=("conversations", "from", "value")),
    Layout("turns", items=("turns", "role", "text")),
)
#: Other words for roles, for callers that want one vocabulary.
ROLES = {"human": "user", "gpt": "assistant"}


#: A JSON string; group 1 is its content if it is a key. What stands in other strings must not count as structure.
STRING = r'(?s)"(?:((?:[^"\\]++|\\.)*+)(?="\s*+:)|(?:[^"\\]++|\\.)*+)"'
#: Texts may be of any length.
JSON = {"maxStringLen": str((1 << 31) - 1)}


def field_paths(record: Column) -> Column:
    """Sorted nested field paths of a JSON object; null if it is none. A string has none below it, whatever it looks like: all are emptied first."""
    fields = F.from_json(F.regexp_replace(record, STRING, '"$1"'), "map<string,string>", JSON)
    none = F.array().cast("array<string>")

    def below(key: Column) -> Column:
        value = fields[key]
        objects = F.when(value.startswith("["), F.from_json(value, "array<map<string,string>>", JSON)).when(value.startswith("{"), F.array(F.from_json(value, "map<string,string>", JSON)))
        inner = F.flatten(F.transform(F.coalesce(objects, F.array().cast("array<map<string,string>>")), lambda o: F.coalesce(F.map_keys(o), none)))
        mark = F.when(value.startswith("["), F.lit("[].")).otherwise(F.lit("."))
        return F.concat(F.array(key), F.transform(F.array_distinct(inner), lambda k: F.concat(key, mark, k)))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.map_keys(fields), below))))


def fingerprint(record: Column) -> Column:
    return F.md5(F.array_join(field_paths(record), "\n"))


def _mapped(layout: Layout, record: Column, roles: dict[str, str]) -> Column:
    none = F.lit(None).cast("struct<role:string,text:string>")
    if layout.items:
        array, role, text = layout.items
        rows = F.from_json(record, f"struct<`{array}`:array<struct<`{role}`:string,`{text}`:string>>>", JSON)[array]
        known = lambda r: F.coalesce(*[F.when(r == k, v) for k, v in roles.items()], r, F.lit(""))
        return F.transform(rows, lambda t: F.struct(known(t[role]).alias("role"), F.coalesce(t[text], F.lit("")).alias("text")))
    fields = F.from_json(record, "struct<" + ",".join(f"`{p}`:string" for p in layout.paths) + ">", JSON)
    turns = [F.when(fields[p].isNotNull() | F.lit(p in layout.required), F.struct(F.lit(r).alias("role"), F.coalesce(fields[p], F.lit("")).alias("text"))).otherwise(none) for r, p in layout.fields]
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def canonical(records: DataFrame, record_col: str = "record", layouts: tuple[Layout, ...] = LAYOUTS, roles: dict[str, str] | None = None) -> DataFrame:
    """records with schema_fingerprint, layout and turns instead of the record. Roles of list layouts stay as they are, but for
    those that `roles` maps to another word, such as ROLES."""
    found = records.withColumn("schema_fingerprint", fingerprint(F.col(record_col)))
    name, turns = F.lit("unknown"), F.array().cast(TURNS)
    for layout in layouts:
        here = F.col("schema_fingerprint") == layout.fingerprint
        name = F.when(here, layout.name).otherwise(name)
        turns = F.when(here, _mapped(layout, F.col(record_col), roles or {}).cast(TURNS)).otherwise(turns)
    return found.withColumn("layout", name).withColumn("turns", F.coalesce(turns, F.array().cast(TURNS))).drop(record_col)


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(conversations: DataFrame, turns_col: str = "turns") -> DataFrame:
    """conversations with `formatted` (the text) and `loss_mask`: array of (start, length) in code points of it, over the escaped assistant texts."""
    parts = F.transform(F.col(turns_col), lambda t: F.struct(F.concat(F.lit(START), escaped_role(t["role"]), F.lit("\n")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")))
    df = conversations.withColumn("_parts", parts)
    tail = F.lit(END + "\n")
    df = df.withColumn("formatted", F.array_join(F.transform("_parts", lambda p: F.concat(p["head"], p["body"], tail)), ""))
    sizes = F.transform("_parts", lambda p: F.struct(F.char_length(p["head"]).alias("head"), F.char_length(p["body"]).alias("body"), p["loss"].alias("loss")))
    spans = F.aggregate(
        sizes,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, p: F.struct(
            (acc["at"] + p["head"] + p["body"] + len(END) + 1).alias("at"),
            F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["head"]).alias("start"), p["body"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return df.withColumn("loss_mask", spans).drop("_parts")


def read_turns(text: Column) -> Column:
    """The canonical turns of a formatted text."""
    roles, texts = F.regexp_extract_all(text, F.lit(TURN), F.lit(1)), F.regexp_extract_all(text, F.lit(TURN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescaped(r).alias("role"), unescaped(t).alias("text")))


def read_loss(text: Column, mask: Column) -> Column:
    """The unescaped text under the mask."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substring(text, s["start"] + 1, s["length"]))), "")
