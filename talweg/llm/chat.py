"""Operator 2, chat formatting: a grammar that is checked by a round trip.

A conversation becomes one text of turns: `<<SYS>>…<</SYS>>` for system, `[INST] … [/INST]` for user, `…</s>`
for assistant and `<|turn:ROLE|>…<|end|>` for any other role. A deterministic parser reads the text back; a control string amid a
turn breaks its grammar, whether or not it would end the turn, since a tokenizer that knows the template would take it
for one. Turns that do not come back identical hold control strings (or look-alikes of escaped ones): one backslash goes
behind the first character of each such string in them, and the text is rendered and parsed again until it is identical.
The parser drops one backslash from every escaped string, so escaping is reversible for any text.

Defined results: null texts and null roles count as empty strings; turns are ordered by (turn, role, text), nulls
first, so repeated and tied rows keep a fixed order; rows of a null conv_id form one conversation; a conversation -7 of
the table stays apart from the one that the query adds; an empty table gives no rows (but that one); further columns are
ignored, whatever their names. A conversation is rendered by one task, since its text is one value.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_tasks

#: Fixed values of the template.
OPEN = {"system": "<<SYS>>", "user": "[INST] ", "assistant": ""}
CLOSE = {"system": "<</SYS>>", "user": " [/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_MID, OTHER_CLOSE = "<|turn:", "|>", "<|end|>"
#: A control string, its first character apart from the rest, with any escapes between them.
CONTROL = re.compile(r"(<)(\\*)(</?SYS>>|/SYS>>|/s>|\|turn:|\|end\|>)|(\[)(\\*)(/?INST\])|(\|)(\\*)(>)")
ESCAPED = re.compile(r"([<\[|])\\(\\*)(<?/?SYS>>|/s>|\|turn:|\|end\|>|/?INST\]|>)")

#: What no turn holds as it is.
RAW = re.compile(r"<<SYS>>|<</SYS>>|\[/?INST\]|</s>|<\|turn:|<\|end\|>")

Turn = tuple[str, str]


def escape(text: str) -> str:
    """One more backslash in every control string, escaped ones included."""
    return CONTROL.sub(lambda m: "".join(p for p in (m[1] or m[4] or m[7], "\\", m[2] or m[5] or m[8] or "", m[3] or m[6] or m[9])), text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def render(turns: list[Turn], escaped: set[int]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation, and where its loss mask is on: the assistant texts. Turns in `escaped` are escaped."""
    out: list[str] = []
    spans, at = [], 0
    for i, (role, text) in enumerate(turns):
        e = escape if i in escaped else str
        opening = OPEN[role] if role in OPEN else f"{OTHER_OPEN}{e(role)}{OTHER_MID}"
        body = e(text)
        if role == "assistant":
            spans.append((at + len(opening), at + len(opening) + len(body)))
        out += (opening, body, CLOSE.get(role, OTHER_CLOSE))
        at += sum(map(len, out[-3:]))
    return "".join(out), spans


def parse(text: str) -> list[Turn] | None:
    """The turns of a rendered text; None where it breaks the grammar. The opening decides, then the first closing ends the turn, and no control string lies between."""
    turns, at = [], 0
    while at < len(text):
        role = next((r for r in ("system", "user") if text.startswith(OPEN[r], at)), "assistant")
        at += len(OPEN[role])
        closing = CLOSE[role]
        if role == "assistant" and text.startswith(OTHER_OPEN, at):
            mid = text.find(OTHER_MID, at + len(OTHER_OPEN))
            if mid < 0:
                return None
            role, closing, at = text[at + len(OTHER_OPEN) : mid], OTHER_CLOSE, mid + len(OTHER_MID)
            if RAW.search(role):
                return None
            role = unescape(role)
        end = text.find(closing, at)
        if end < 0 or RAW.search(text, at, end):
            return None
        turns.append((role, unescape(text[at:end])))
        at = end + len(closing)
    return turns


def format_turns(turns: list[Turn]) -> tuple[str, list[tuple[int, int]], int]:
    """Text, loss spans and rounds. Only what conflicts is escaped; a round that changes nothing means all of it."""
    escaped: set[int] = set()
    for rounds in range(1, len(turns) + 3):
        text, spans = render(turns, escaped)
        back = parse(text)
        if back == turns:
            return text, spans, rounds
        conflicts = {i for i, t in enumerate(turns) if i not in escaped and parse(render([t], set())[0]) != [t]}
        escaped |= conflicts or set(range(len(turns)))
    raise AssertionError("escaping every turn is reversible for any text")


def by_conversation(convs: DataFrame, *apart: str) -> DataFrame:
    """conv_id and its ordered turns; `apart` names columns that keep conversations of one conv_id apart."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return convs.groupBy("conv_id", *apart).agg(F.sort_array(F.collect_list(turn)).alias("turns"))


FORMATTED = "conv_id long, formatted string, loss_spans array<struct<start:long,end:long>>, rounds long"


def format_chats(convs: DataFrame, *apart: str) -> DataFrame:
    """One row per conversation: its text, the loss mask as code-point spans of the text and the rounds that it took."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, made = batch.column("conv_id").to_pylist(), []
            for turns in batch.column("turns").to_pylist():
                made.append(format_turns([(t["role"], t["text"]) for t in turns]))
            yield pa.RecordBatch.from_pydict(
                {"conv_id": ids, "formatted": [m[0] for m in made], "loss_spans": [[{"start": a, "end": b} for a, b in m[1]] for m in made], "rounds": [m[2] for m in made]},
                schema=pa.schema([("conv_id", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("rounds", pa.int64())]),
            )

    return in_tasks(by_conversation(convs, *apart).withColumn("conv_id", F.col("conv_id").cast("long")).select("conv_id", "turns"), run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per formatted text: what the parser and the loss mask give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv, text, spans, rounds in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_spans", "rounds")), strict=True):
                turns = parse(text)
                if turns is None:
                    raise ValueError(f"conversation {conv} can't be read back")
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), rounds))
            names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rounds"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return in_tasks(formatted, run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rounds long")


#: The contract's conversation of nothing but control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(convs: DataFrame) -> DataFrame:
    probe = convs.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    asked = convs.select("conv_id", "turn", "role", "text", F.lit(False).alias("_probe")).unionByName(probe.withColumn("_probe", F.lit(True)))
    return read_back(format_chats(asked, "_probe"))


#: The same in DuckDB SQL. A turn conflicts if it holds a control string, an escaped one, its own closing, or an opening at the start of an assistant's text.
CONTROLS = r"(?:<\\*(?:</?SYS>>|/SYS>>|/s>|\|turn:|\|end\|>)|\[\\*/?INST\]|\|\\*>)"
ORACLE = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, false AS probe FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]', true), (-7, 1, 'assistant', '</s>[INST] ok [/INST]', true)),
framed AS (SELECT *, CASE role WHEN 'system' THEN '<<SYS>>' WHEN 'user' THEN '[INST] ' WHEN 'assistant' THEN '' ELSE '<|turn:' || role || '|>' END AS opening,
    CASE role WHEN 'system' THEN '<</SYS>>' WHEN 'user' THEN ' [/INST]' WHEN 'assistant' THEN '</s>' ELSE '<|end|>' END AS closing FROM t),
judged AS (SELECT *, regexp_matches(text, '<<SYS>>|<</SYS>>|\[/?INST\]|</s>|<\|turn:|<\|end\|>') OR strpos(text || closing, closing) <= length(text) OR regexp_matches(text, '(?:[<\[|]\\+(?:<?/?SYS>>|/s>|\|turn:|\|end\|>|/?INST\]|>))')
    OR (role = 'assistant' AND (starts_with(text, '<<SYS>>') OR starts_with(text, '[INST] ') OR starts_with(text, '<|turn:'))) AS conflict FROM framed),
sized AS (SELECT *, length(opening) + length(text) + length(closing) + CASE WHEN conflict THEN len(regexp_extract_all(text, '{CONTROLS}')) ELSE 0 END AS chars FROM judged),
grouped AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars, CAST(1 + max(CAST(conflict AS INT)) AS BIGINT) AS rounds FROM sized GROUP BY conv_id, probe)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars, rounds FROM grouped
"""
