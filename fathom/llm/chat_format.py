"""Chat formatting by schema fingerprints.

A record is a VARIANT of any layout. The nested field paths of a record, without the types at the leaves, are hashed to a
fingerprint; a registry of declarative mappings, keyed by fingerprint, says how that layout becomes canonical turns
(role, text). All work is on DataFrame expressions.

Defined results: an unknown layout gives null turns and a null mapping name (the record is kept); a null text or role is an
empty string; a record without turns gives an empty output; an empty table gives an empty result. Repeated rows stay repeated, and
turns with one number are ordered by role and text. Columns of the input named like a result are replaced. In the query, rows of a
conversation -7 of the table would be part of the conversation -7 that it adds.
"""

from __future__ import annotations

import functools
import hashlib
import operator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAF_TYPES = "STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|BINARY|DATE|TIMESTAMP|TIMESTAMP_NTZ|UUID|DECIMAL\\(\\d+,\\d+\\)"


@dataclass(frozen=True)
class Mapping:
    """One layout. paths: every nested field, arrays written as `[]`. Either `turns` names an array of objects with a role
    and a text field, or `fields` lists (role, field, field, ...): fields that are present are joined by a blank line."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, ...], ...] = ()
    aliases: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def layout(self) -> str:
        return layout_of(self.paths)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.layout.encode()).hexdigest()


def layout_of(paths: tuple[str, ...]) -> str:
    """Canonical text of a set of nested paths: objects with sorted fields, leaves without a type."""
    tree: dict = {}
    for path in paths:
        node = tree
        for part in path.replace("[]", ".[]").split("."):
            node = node.setdefault(part, {})

    def show(node: dict) -> str:
        if not node:
            return ""
        if "[]" in node:
            return f"ARRAY<{show(node['[]'])}>"
        return "OBJECT<" + ", ".join(f"{k}: {show(v)}" for k, v in sorted(node.items())) + ">"

    return show(tree)


SHAREGPT_ROLES = {"human": "user", "gpt": "assistant", "system": "system"}
MAPPINGS = (
    Mapping("messages", ("messages[].role", "messages[].content"), turns=("messages", "role", "content")),
    Mapping("sharegpt", ("conversations[].from", "conversations[].value"), turns=("conversations", "from", "value"), aliases=SHAREGPT_ROLES),
    Mapping("instruction", ("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Mapping("instruction_input", ("instruction", "input", "output"), fields=(("user", "instruction", "input"), ("assistant", "output"))),
    Mapping("prompt", ("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Mapping("prompt_system", ("system", "prompt", "response"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Mapping("question", ("question", "answer"), fields=(("user", "question"), ("assistant", "answer"))),
)


def fingerprint(record: Column) -> Column:
    """sha256 of the record's nested field paths; null for a null record."""
    erased = F.regexp_replace(F.schema_of_variant(record), f"(?<=[<: ])({LEAF_TYPES})(?=[,>]|$)", "")
    return F.sha2(erased, 256)


def _turns(record: Column, m: Mapping) -> Column:
    text = lambda v, name: F.coalesce(F.try_variant_get(v, f"$.{name}", "string"), F.lit(""))
    if m.turns:
        path, role, body = m.turns
        aliases = F.create_map(*[F.lit(x) for kv in m.aliases.items() for x in kv]) if m.aliases else None
        named = lambda v: F.coalesce(aliases[text(v, role)], text(v, role)) if m.aliases else text(v, role)
        return F.transform(F.try_variant_get(record, f"$.{path}", "array<variant>"), lambda v: F.struct(named(v).alias("role"), text(v, body).alias("text")))
    one = lambda role, names: F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *[F.try_variant_get(record, f"$.{n}", "string") for n in names]).alias("text"))
    return F.array(*[one(role, names) for role, *names in m.fields])


def canonical_turns(df: DataFrame, record: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds `fingerprint`, `mapping` (name) and `turns` (array of role, text)."""
    out = df.withColumn("fingerprint", fingerprint(F.col(record)))
    name, turns = F.lit(None).cast("string"), F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in reversed(mappings):
        hit = F.col("fingerprint") == m.fingerprint
        name, turns = F.when(hit, m.name).otherwise(name), F.when(hit, _turns(F.col(record), m)).otherwise(turns)
    empty = F.schema_of_variant(F.col(record)).rlike("^OBJECT<(messages|conversations): ARRAY<(VOID)?>>$")
    return out.withColumn("mapping", name).withColumn("turns", F.when(empty, F.array().cast("array<struct<role:string,text:string>>")).otherwise(turns))


# --- the template -------------------------------------------------------------------------------------------------
# Markers begin with < or [ ; inside texts and roles these two, > and the backslash are written \l \b \g \\ .


def escape(text: Column) -> Column:
    for raw, coded in (("\\", "\\\\"), ("<", "\\l"), (">", "\\g"), ("[", "\\b")):
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    """Reads left to right: the text is split at double backslashes, which are backslashes, and the rest decoded between."""

    def plain(part: Column) -> Column:
        for raw, coded in (("<", "\\l"), (">", "\\g"), ("[", "\\b")):
            part = F.replace(part, F.lit(coded), F.lit(raw))
        return part

    return F.array_join(F.transform(F.split(text, "\\\\\\\\", -1), plain), "\\")


def _marks(role: Column) -> tuple[Column, Column]:
    pre = F.when(role == "user", "<s>[INST] ").when(role == "assistant", "<a>").when(role == "system", "<<SYS>>").otherwise(F.concat(F.lit("<<ROLE:"), escape(role), F.lit(">>")))
    post = F.when(role == "user", " [/INST]").when(role == "assistant", "</s>").when(role == "system", "<</SYS>>").otherwise(F.lit("<</ROLE>>"))
    return pre, post


def render(df: DataFrame, turns: str = "turns", train_role: str = "assistant") -> DataFrame:
    """Adds `formatted` and `loss_mask`: (start, length) in code points of the escaped texts of train_role."""

    def piece(t: Column) -> Column:
        pre, post = _marks(t["role"])
        return F.struct(pre.alias("pre"), escape(t["text"]).alias("body"), post.alias("post"), (t["role"] == train_role).alias("train"))

    size = F.char_length

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + size(p["pre"])
        span = F.array(F.struct(start.alias("start"), size(p["body"]).alias("length")))
        return F.struct((start + size(p["body"]) + size(p["post"])).alias("at"), F.when(p["train"], F.concat(acc["mask"], span)).otherwise(acc["mask"]).alias("mask"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("mask"))
    return (
        df.withColumn("_pieces", F.transform(turns, piece))
        .withColumn("formatted", F.array_join(F.transform("_pieces", lambda p: F.concat(p["pre"], p["body"], p["post"])), ""))
        .withColumn("loss_mask", F.aggregate("_pieces", start, step)["mask"])
        .drop("_pieces")
    )


SEGMENT = r"<s>\[INST\] [^<\[]* \[/INST\]|<a>[^<\[]*</s>|<<SYS>>[^<\[]*<</SYS>>|<<ROLE:[^<\[>]*>>[^<\[]*<</ROLE>>"


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, unescaped."""

    def turn(s: Column) -> Column:
        between = lambda a, b: F.substring(s, F.lit(a + 1), F.char_length(s) - (a + b))
        close = F.locate(">>", s)
        role = F.when(s.startswith("<s>"), "user").when(s.startswith("<a>"), "assistant").when(s.startswith("<<SYS>>"), "system").otherwise(unescape(F.substring(s, F.lit(8), close - 8)))
        body = F.when(s.startswith("<s>"), between(10, 8)).when(s.startswith("<a>"), between(3, 4)).when(s.startswith("<<SYS>>"), between(7, 8)).otherwise(F.substring(s, close + 2, F.char_length(s) - close - 1 - 9))
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(SEGMENT), 0), turn)


def masked_text(formatted: Column, mask: Column) -> Column:
    return F.array_join(F.transform(mask, lambda m: unescape(F.substring(formatted, m["start"] + 1, m["length"]))), "")


# --- the query ----------------------------------------------------------------------------------------------------

PROBE = "</s>[INST] ok [/INST]"


def records(conversations: DataFrame) -> DataFrame:
    """One `messages` record for each conv_id, rows by turn (ties by role and text; null turns first)."""
    rows = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    messages = F.transform(rows, lambda r: F.struct(r["role"].alias("role"), r["text"].alias("content")))
    return conversations.groupBy("conv_id").agg(F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))


def varied_records(conversations: DataFrame) -> DataFrame:
    """Records of conversations as corpora have them: a question and its answer as `instruction`, `prompt` or `question`, with a system
    text as `prompt_system`, all else as `messages` or, where only the usual roles speak, `sharegpt`."""
    rows = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
    at = lambda i: F.try_element_at("_t", F.lit(i))
    text = lambda i: at(i)["text"]
    speak = lambda *roles: F.coalesce((F.size("_t") == len(roles)) & functools.reduce(operator.and_, [at(i)["role"] == r for i, r in enumerate(roles, 1)]), F.lit(False))
    record = lambda **fields: F.to_variant_object(F.struct(*[c.alias(k) for k, c in fields.items()]))
    listed = lambda role, body, named: F.transform("_t", lambda r: F.struct(named(r["role"]).alias(role), r["text"].alias(body)))
    alias = {v: k for k, v in SHAREGPT_ROLES.items()}
    usual = F.forall("_t", lambda r: F.coalesce(r["role"], F.lit("")).isin(*alias))
    renamed = lambda c: F.create_map(*[F.lit(x) for kv in alias.items() for x in kv])[c]
    kind, pair, blank = F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(4)), speak("user", "assistant"), F.locate("\n\n", text(1))
    split = record(instruction=F.substring(text(1), F.lit(1), blank - 1), input=F.substring(text(1), blank + 2, F.char_length(text(1))), output=text(2))
    layout = (
        F.when(pair & (kind == 0) & (blank > 0), split)
        .when(pair & (kind == 0), record(instruction=text(1), output=text(2)))
        .when(pair & (kind == 1), record(prompt=text(1), completion=text(2)))
        .when(pair & (kind == 2), record(question=text(1), answer=text(2)))
        .when(speak("system", "user", "assistant"), record(system=text(1), prompt=text(2), response=text(3)))
        .when(usual & (kind % 2 == 1), record(conversations=listed("from", "value", renamed)))
        .otherwise(record(messages=listed("role", "content", lambda c: c)))
    )
    return rows.select("conv_id", layout.alias("record"))


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    out = render(canonical_turns(varied_records(rows.unionByName(probe)), "record"))
    back = out.withColumn("back", read_back(F.col("formatted"))).withColumn("loss", masked_text(F.col("formatted"), F.col("loss_mask")))
    spoken = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
e AS (
  SELECT *, length(text) + length(regexp_replace(text, '[^\\\\<>\\[]', '', 'g')) AS body,
    CASE role WHEN 'user' THEN 18 WHEN 'assistant' THEN 7 WHEN 'system' THEN 15
      ELSE 18 + length(role) + length(regexp_replace(role, '[^\\\\<>\\[]', '', 'g')) END AS marks
  FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(body + marks)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
