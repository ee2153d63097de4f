"""Chat formatting: records of many layouts become canonical turns, then masked training text."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

TURNS = "conv_id long, at long, role string, text string, layout string"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping. `paths` are all field paths of a record, `[]` marking list elements.

    `turns` are pairs (role, text): a text is a path, a role a path or, after `=`, fixed. With `each`,
    the pair is read from each element of that list. `order` is the path of a turn number, else turns
    count from 0. With `optional`, a turn whose text is empty or null is left out.
    """

    name: str
    paths: tuple[str, ...]
    conv: str
    turns: tuple[tuple[str, str], ...]
    each: str = ""
    order: str = ""
    optional: bool = False


LAYOUTS = (
    Layout("turn row", ("conv_id", "role", "text", "turn"), "conv_id", (("role", "text"),), order="turn"),
    Layout("messages", ("id", "messages", "messages[].content", "messages[].role"), "id", (("role", "content"),), each="messages"),
    Layout("from and value", ("conversations", "conversations[].from", "conversations[].value", "id"), "id", (("from", "value"),), each="conversations"),
    Layout("prompt and response", ("id", "prompt", "response"), "id", (("=user", "prompt"), ("=assistant", "response"))),
    Layout("instruction", ("id", "input", "instruction", "output"), "id", (("=system", "instruction"), ("=user", "input"), ("=assistant", "output")), optional=True),
    Layout("nested chat", ("chat", "chat.turns", "chat.turns[].speaker", "chat.turns[].utterance", "id"), "id", (("speaker", "utterance"),), each="chat.turns"),
)

#: Names of speakers that stand for a canonical role.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value, at: str = "") -> set[str]:
    """The nested field paths of a decoded JSON value; all elements of a list share one path."""
    found: set[str] = set()
    if isinstance(value, dict):
        for k, v in value.items():
            here = f"{at}.{k}" if at else k
            found |= {here} | field_paths(v, here)
    elif isinstance(value, list):
        for v in value:
            found |= field_paths(v, f"{at}[]")
    return found


def fingerprint(paths) -> bytes:
    return hashlib.blake2b("\n".join(sorted(paths)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def get(value, path: str):
    for step in path.split("."):
        value = value.get(step) if isinstance(value, dict) else None
    return value


def as_text(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def turns_of(record, layout: Layout):
    """(conv_id, at, role, text) of each turn of a decoded record."""
    conv, at = get(record, layout.conv), 0
    for one in (get(record, layout.each) or []) if layout.each else [record]:
        for role, text in layout.turns:
            said = as_text(get(one, text))
            if layout.optional and not said:
                continue
            who = role[1:] if role[0] == "=" else as_text(get(one, role))
            number = get(one, layout.order) if layout.order else at
            yield conv, number, ROLES.get(who, who), said
            at += 1


def canonical_batches(layouts: tuple[Layout, ...]):
    by_print = {fingerprint(x.paths): x for x in layouts}

    def canonical(batches):
        for batch in batches:
            out: list[tuple] = []
            for raw in batch.column(0).to_pylist():
                try:
                    record = json.loads(raw) if raw is not None else None
                except ValueError:
                    record = None
                layout = by_print.get(fingerprint(field_paths(record)))
                if layout is None:
                    out.append((None, None, None, raw, None))
                else:
                    out += [(*turn, layout.name) for turn in turns_of(record, layout)]
            columns = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["conv_id", "at", "role", "text", "layout"])

    return canonical


def canonical_turns(records: DataFrame, column: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """TURNS of the JSON records in `column`, by the layout whose fingerprint each record has.

    A record of no known layout, or that is null or no JSON, gives one row with its text, and null in
    the other columns, so that nothing is lost unseen. Null texts are empty; null roles are empty.
    """
    return records.select(F.col(column).cast("string")).mapInArrow(canonical_batches(layouts), TURNS)


def escaped(text: Column, chars: str = r"\\#<") -> Column:
    """A backslash before each character from which the template's marks are made, and before backslashes."""
    return F.regexp_replace(text, f"([{chars}])", r"\\$1")


def formatted_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, at, formatted, loss_start, loss_end): the training text of each turn.

    A turn is `### role: text</turn>` and a newline; a conversation's text is its turns in the order of
    (at, formatted). Loss bounds are code points in `formatted`, null but for assistants.
    """
    head = F.concat(F.lit("### "), escaped(F.col("role"), r"\\#<:"), F.lit(": "))
    body = escaped(F.col("text"))
    rows = turns.filter("layout is not null").select("conv_id", "at", "role", head.alias("head"), body.alias("body"))
    start, assistant = F.length("head"), F.col("role") == "assistant"
    return rows.select("conv_id", "at", F.concat("head", "body", F.lit("</turn>\n")).alias("formatted"), F.when(assistant, start).alias("loss_start"), F.when(assistant, start + F.length("body")).alias("loss_end"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if "\\" in text else text


#: A role up to the first colon without a backslash before it.
HEAD = re.compile(r"### ((?:[^\\:]|\\.)*+): ", re.DOTALL)
END = "</turn>\n"

READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def parsed_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of a formatted turn."""
    head = HEAD.match(formatted)
    if head is None or not formatted.endswith(END):
        raise ValueError(f"not a turn: {formatted[:80]!r}")
    return unescaped(head[1]), unescaped(formatted[head.end() : -len(END)])


def read_batches(batches):
    """A mapInArrow function over sorted formatted turns that gives one READ row a conversation.

    It holds digests only, so a conversation may be longer than memory.
    """
    now: list | None = None
    out: list[tuple] = []

    def closed():
        return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

    def batch_of(rows):
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for conv, formatted, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append(closed())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parsed_turn(formatted)
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if start is not None:
                masked = unescaped(formatted[start:end])
                now[3] += len(masked)
                now[4].update(masked.encode("utf-8", "surrogatepass"))
            now[5] += len(formatted)
        if len(out) >= 1000:
            yield batch_of(out)
            out = []
    if now is not None:
        out.append(closed())
    if out:
        yield batch_of(out)


def read_back(formatted: DataFrame) -> DataFrame:
    """READ: what the formatted text of each conversation holds, parsed again.

    One SHA-256 over a conversation has to see its turns in order, so a conversation is one task's
    work; that task streams sorted rows. Null conversation ids form one conversation.
    """
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "at", "formatted")
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end").mapInArrow(read_batches, READ)


def op9_chat_formatting(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    as_json = F.to_json(F.struct("conv_id", "turn", "role", "text"), {"ignoreNullFields": "false"})
    said = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(json.dumps({"id": -7, "prompt": said, "response": said}),)], "record string")
    records = rows.select(as_json.alias("record")).unionByName(extra)
    return read_back(formatted_turns(canonical_turns(records, "record")))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '<', '\<'), ':', '\:') || ': '
         || replace(replace(replace(text, '\', '\\'), '#', '\#'), '<', '\<') || '</turn>' || chr(10) AS f FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, f)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, f) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(f))::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
