"""Operator 3: chat formatting with typed content parts.

Method: a visitor goes through the parts of each turn (text, image, audio, document) in order and
flattens them: text is escaped, any other part becomes a placeholder with its ordinal, and its
reference and expanded token count are recorded.  The template marks each turn; control strings
inside roles and texts are escaped reversibly, so no text can pass for a mark.

``format_turns`` is a row-local map: one formatted segment a turn with the spans under the loss mask.
A conversation's formatted text is its segments in order of turn.  ``read_back`` deals conversations
out by id, sorts turns inside partitions and reads each conversation as a stream, so memory does not grow with
its number of turns (a digest over one conversation is sequential by nature).

Rows of equal conversation and turn come in order of their formatted segments; null roles and texts are empty; a
null conversation id is a conversation of its own; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, pieces, read_table

OPEN, ROLE_END, CLOSE = "<|turn|>", "<|says|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Strings that a template or a model may treat as control: none is left as it is inside a text.
CONTROL = (OPEN, ROLE_END, CLOSE, *PLACEHOLDERS.values(), "<|ref|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>", "<|im_start|>", "<|im_end|>")
_INNER = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(\\)?")
#: Tokens that a part stands for if it names no number of its own.
EXPANDED_TOKENS = {"image": 256, "audio": 128, "document": 512}


def escape(text: str) -> str:
    """Doubles backslashes, then puts one after the first character of every control string."""
    return _INNER.sub(lambda m: m.group() + "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m.group(1) or "", text)


class Flattener:
    """Visitor over typed parts: dicts of type, text, ref, n_tokens."""

    def __init__(self, expanded: dict[str, int] | None = None):
        self.expanded = EXPANDED_TOKENS | (expanded or {})

    def visit(self, parts: list[dict]) -> tuple[str, list[dict]]:
        self.pieces: list[str] = []
        self.attachments: list[dict] = []
        for part in parts:
            getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_unknown)(part)
        return "".join(self.pieces), self.attachments

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(part.get("text") or ""))

    def _attach(self, part: dict) -> None:
        kind, n = part["type"], part.get("n_tokens")
        self.attachments.append({"ordinal": len(self.attachments), "type": kind, "ref": part.get("ref"), "n_tokens": self.expanded[kind] if n is None else n})
        self.pieces.append(PLACEHOLDERS[kind])

    visit_image = visit_audio = visit_document = _attach

    def visit_unknown(self, part: dict) -> None:
        raise ValueError(f"content part of type {part.get('type')!r}")


def format_turn(role: str | None, parts: list[dict], loss_roles: tuple[str, ...] = ("assistant",)) -> tuple[str, int, int, list[dict]]:
    """The segment of one turn, the span under the loss mask (empty if none) and the attachments."""
    body, attachments = Flattener().visit(parts)
    head = f"{OPEN}{escape(role or '')}{ROLE_END}"
    end = len(head) + len(body)
    return f"{head}{body}{CLOSE}", len(head) if role in loss_roles else end, end, attachments


def parse_turn(segment: str) -> tuple[str, str]:
    """Role and text (placeholders as they stand) of a segment."""
    if not segment.startswith(OPEN) or segment.find(CLOSE) != len(segment) - len(CLOSE):
        raise ValueError("not one turn")
    role, mark, body = segment[len(OPEN) : -len(CLOSE)].partition(ROLE_END)
    if not mark:
        raise ValueError("no role")
    return unescape(role), unescape(body)


PARTS = "array<struct<type: string, text: string, ref: string, n_tokens: bigint>>"
SEGMENTS = "conv_id long, turn long, segment string, loss_start long, loss_end long, attachments array<struct<ordinal: long, type: string, ref: string, n_tokens: long>>"
_ATTACHMENT = pa.list_(pa.struct([("ordinal", pa.int64()), ("type", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())]))


def format_turns(conversations: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One segment per row of conv_id, turn, role and ``text``, or ``parts`` (typed content parts) where that column exists and isn't null."""
    parts = F.col("parts").cast(PARTS) if "parts" in conversations.columns else F.lit(None).cast(PARTS)
    text = F.col("text") if "text" in conversations.columns else F.lit(None)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), text.cast("string").alias("text"), parts.alias("parts"))
    names = ["conv_id", "turn", "segment", "loss_start", "loss_end", "attachments"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), _ATTACHMENT]

    def run(batches):
        for batch in pieces(batches, 4000):
            out = []
            for conv_id, turn, role, text, parts in zip(*(c.to_pylist() for c in batch.columns)):
                out.append((conv_id, turn, *format_turn(role, [{"type": "text", "text": text}] if parts is None else parts, loss_roles)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return map_batches(rows, run, SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """One row a conversation, from the formatted segments alone: digests of turns and of all text under the loss mask."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "expanded_tokens"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    nothing = object()

    def run(batches):
        current, state = nothing, None

        def row():
            return (current, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:])

        for batch in pieces(batches, 4000):
            out = []
            for conv_id, segment, a, b, attachments in zip(*(c.to_pylist() for c in batch.columns)):
                if current is nothing or conv_id != current:
                    if current is not nothing:
                        out.append(row())
                    current, state = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, text = parse_turn(segment)
                loss = unescape(segment[a:b])
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
                state[5] += len(attachments or ())
                state[6] += sum(x["n_tokens"] for x in attachments or ())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if current is not nothing:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), types)], names)

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"
    return map_batches(dealt.select("conv_id", "segment", "loss_start", "loss_end", "attachments"), run, schema)


def query(spark, sf_dir):
    given = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string")
    return read_back(format_turns(given.unionByName(own)))
