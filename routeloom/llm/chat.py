"""Chat formatting by incremental rendering of a black-box template.

A template is any function from a list of (role, text) turns to a string. Each prefix of a
conversation is rendered; where the new output starts with the previous one, the rest is the
turn's span, and the text's place inside it is found by rendering the last turn with two probe
texts: what both outputs share before the probe is the turn's head. A template that changes what
it has already written is reported with the first turn that did so, and gets no spans from there
on. Rendering every prefix costs turns times length.

The template here marks turns and escapes its control strings in texts with backslashes, so that
``parse`` gets roles and texts back exactly.

Defined results: turns are ordered by turn, then role, then text (nulls first); repeated rows are
turns of their own; null texts and roles are empty; an empty table has no conversations; a null
conv_id is a conversation of its own. The input's other columns are not carried over.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

Turn = tuple[str, str]
#: Head and tail of each known role's turns.
MARKS = {"system": ("<s>[SYS]", "[/SYS]</s>\n"), "user": ("<s>[INST]", "[/INST]\n"), "assistant": ("[OUT]", "[/OUT]</s>\n")}
OTHER = ("<s>[ROLE]", "[TEXT]", "[/ROLE]</s>\n")
_CONTROL = re.compile(r"\\|<(?=/?s>)|\[(?=/?(?:INST|OUT|SYS|ROLE|TEXT)\])")
_ESCAPED = re.compile(r"\\(.)", re.S)
_BODY = r"((?:[^\\<\[]|\\.|<(?!/?s>)|\[(?!/?(?:INST|OUT|SYS|ROLE|TEXT)\]))*+)"
_TURN = re.compile("|".join([*(re.escape(a) + _BODY + re.escape(b) for a, b in MARKS.values()), re.escape(OTHER[0]) + _BODY + re.escape(OTHER[1]) + _BODY + re.escape(OTHER[2])]), re.S)
#: The loss mask covers the texts of these roles.
LEARNED = ("assistant",)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def template(turns: list[Turn]) -> str:
    out = []
    for role, text in turns:
        if role in MARKS:
            head, tail = MARKS[role]
            out.append(head + escape(text) + tail)
        else:
            out.append(OTHER[0] + escape(role) + OTHER[1] + escape(text) + OTHER[2])
    return "".join(out)


def parse(formatted: str) -> list[Turn]:
    turns, at = [], 0
    roles = list(MARKS)
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        i = m.lastindex
        if i <= len(roles):
            turns.append((roles[i - 1], unescape(m[i])))
        else:
            turns.append((unescape(m[len(roles) + 1]), unescape(m[len(roles) + 2])))
        at = m.end()
    return turns


@dataclass
class Rendered:
    text: str
    spans: list[tuple[int, int]]  # of each turn
    inner: list[tuple[int, int]]  # of each turn's text
    rewritten: int | None  # the first turn that changed earlier output


def _shared(a: str, b: str) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def render(turns: list[Turn], to_text: Callable[[list[Turn]], str] = template) -> Rendered:
    last, spans, inner = to_text([]), [], []
    for i, (role, _) in enumerate(turns):
        now = to_text(turns[: i + 1])
        if not now.startswith(last):
            return Rendered(to_text(turns), spans, inner, i)
        one, two = (to_text([*turns[:i], (role, probe)]) for probe in ("a", "bb"))
        if not (one.startswith(last) and two.startswith(last)):
            return Rendered(to_text(turns), spans, inner, i)
        head = _shared(one, two)
        tail = len(one) - head - 1
        spans.append((len(last), len(now)))
        inner.append((head, len(now) - tail))
        last = now
    return Rendered(last, spans, inner, None)


SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten_turn long, formatted string, loss_spans array<struct<start:long,end:long>>"


def _sha(parts) -> str:
    h = hashlib.sha256()
    for p in parts:
        h.update(p.encode("utf-8", "surrogatepass"))
    return h.hexdigest()


def _one(conv_id, turns: list[Turn], to_text, read) -> tuple:
    r = render(turns, to_text)
    back = read(r.text)
    loss = [(a, b) for (a, b), (role, _) in zip(r.inner, turns) if role in LEARNED]
    texts = [unescape(r.text[a:b]) for a, b in loss]
    return (conv_id, len(back), _sha(x for role, text in back for x in (role, "\n", text, "\n")), sum(map(len, texts)), _sha(texts), len(r.text), r.rewritten, r.text, [{"start": a, "end": b} for a, b in loss])


def _conversations(batches):
    """conv_id and turns of rows that come in order."""
    now, turns, any_yet = None, [], False
    for b in batches:
        for c, role, text in zip(*(b.column(k).to_pylist() for k in ("conv_id", "role", "text"))):
            if any_yet and c != now:
                yield now, turns
                turns = []
            now, any_yet = c, True
            turns.append((role or "", text or ""))
    if any_yet:
        yield now, turns


def formatted(conversations: DataFrame, to_text: Callable = template, read: Callable = parse) -> DataFrame:
    """SCHEMA: each conversation's output, what reads back from it, and its loss spans."""

    def go(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten_turn", "formatted", "loss_spans"]
        rows, size = [], 0
        for c, turns in _conversations(batches):
            rows.append(_one(c, turns, to_text, read))
            size += rows[-1][5]
            if size > 4_000_000 or len(rows) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=names)

    df = conversations.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    return df.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(tidy(go), SCHEMA)


def digest_sql() -> str:
    """DuckDB SQL for op8's columns."""
    fixed = " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, (a, b) in MARKS.items())
    escapes = "len(regexp_extract_all({0}, '\\\\|</?s>|\\[/?(INST|OUT|SYS|ROLE|TEXT)\\]'))"
    other = f"{sum(map(len, OTHER))} + length(role) + {escapes.format('role')}"
    probe = "</s>[INST] ok [/INST]"
    return f"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, 0, 'user', '{probe}' UNION ALL SELECT -1, 1, 'assistant', '{probe}')
    SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(length(text) + {escapes.format('text')} + CASE role {fixed} ELSE {other} END) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id"""
