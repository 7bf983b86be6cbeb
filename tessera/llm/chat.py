r"""Chat formatting with typed content parts.

A message is a list of parts: text, image, audio or document.  A visitor flattens
them, in order, into one string: text is escaped, every other part becomes a
numbered placeholder, its reference is recorded, and the tokens that it will expand
to are counted.  Every turn becomes

    <|turn|>role<|sep|>content<|end|>

All control strings start with ``<|``.  Inside roles and texts a backslash is doubled
and ``<|`` becomes ``<\|``, so no text can forge a control string and reading back
restores it exactly.  The loss mask covers the content of assistant turns.

Turns are formatted where they lie; only the digests of a conversation need its turns
in order, and those are read as a sorted stream, one turn at a time, so that a
conversation of any length takes no more memory than a turn.

Defined results.  A null text or role counts as empty.  Turns with the same number go
by their formatted string, null turns first; repeated rows are turns of their own.  A
null conv_id is a conversation.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, SEP, END = "<|turn|>", "<|sep|>", "<|end|>"
_ESCAPED = re.compile(r"\\\\|<\\\|")
_PLACEHOLDER = re.compile(r"<\|(image|audio|document):(\d+)\|>")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[0] == "\\\\" else "<|", text)


@dataclass(frozen=True)
class Text:
    text: str

    def accept(self, v: Flattener) -> None:
        v.text(self)


@dataclass(frozen=True)
class Image:
    ref: str
    width: int = 0
    height: int = 0

    def accept(self, v: Flattener) -> None:
        v.image(self)


@dataclass(frozen=True)
class Audio:
    ref: str
    seconds: float = 0.0

    def accept(self, v: Flattener) -> None:
        v.audio(self)


@dataclass(frozen=True)
class Document:
    ref: str
    pages: int = 0

    def accept(self, v: Flattener) -> None:
        v.document(self)


@dataclass
class Flattener:
    """Visits parts in order; placeholders are numbered within the message."""

    patch: int = 28
    audio_rate: float = 25.0
    page_tokens: int = 512
    count: Callable[[str], int] = lambda t: len(t.split())
    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int]] = field(default_factory=list)
    tokens: int = 0

    def text(self, p: Text) -> None:
        self.pieces.append(escape(p.text))
        self.tokens += self.count(p.text)

    def image(self, p: Image) -> None:
        self._place("image", p.ref, max(1, math.ceil(p.width / self.patch)) * max(1, math.ceil(p.height / self.patch)))

    def audio(self, p: Audio) -> None:
        self._place("audio", p.ref, max(1, math.ceil(p.seconds * self.audio_rate)))

    def document(self, p: Document) -> None:
        self._place("document", p.ref, max(1, p.pages) * self.page_tokens)

    def _place(self, kind: str, ref: str, tokens: int) -> None:
        self.pieces.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append((kind, ref, tokens))
        self.tokens += tokens


def part_of(row: dict) -> Text | Image | Audio | Document:
    """A part from a row; missing values count as empty."""
    kind = row.get("type") or "text"
    if kind == "text":
        return Text(row.get("text") or "")
    if kind == "image":
        return Image(row.get("ref") or "", row.get("width") or 0, row.get("height") or 0)
    if kind == "audio":
        return Audio(row.get("ref") or "", row.get("seconds") or 0.0)
    if kind == "document":
        return Document(row.get("ref") or "", row.get("pages") or 0)
    raise ValueError(f"unknown part type: {kind}")


PART = "struct<type string, text string, ref string, width int, height int, seconds double, pages int>"


@dataclass(frozen=True)
class Formatted:
    text: str
    #: Where the loss mask begins and ends; equal where nothing is masked.
    loss: tuple[int, int]
    attachments: list[tuple[str, str, int]]
    tokens: int


def format_turn(role: str, parts: list, flattener: Callable[[], Flattener] = Flattener) -> Formatted:
    v = flattener()
    for p in parts:
        p.accept(v)
    head, body = f"{TURN}{escape(role)}{SEP}", "".join(v.pieces)
    span = (len(head), len(head) + len(body)) if role == "assistant" else (0, 0)
    return Formatted(head + body + END, span, v.attachments, v.tokens)


def read_back(formatted: str) -> Iterator[tuple[str, list[str | tuple[str, int]]]]:
    """Role and content of every turn: texts, and (kind, number) for placeholders."""
    at = 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            raise ValueError(f"no turn at {at}")
        sep = formatted.index(SEP, at)
        end = formatted.index(END, sep)
        body, content, done = formatted[sep + len(SEP) : end], [], 0
        for m in _PLACEHOLDER.finditer(body):
            if m.start() > done:
                content.append(unescape(body[done : m.start()]))
            content.append((m[1], int(m[2])))
            done = m.end()
        if done < len(body):
            content.append(unescape(body[done:]))
        yield unescape(formatted[at + len(TURN) : sep]), content
        at = end + len(END)


TURN_SCHEMA = "role string, formatted string, loss_from int, loss_to int, attachments array<struct<kind string, ref string, tokens int>>, tokens long"


def format_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, flattener: Callable[[], Flattener] = Flattener) -> DataFrame:
    """Every turn formatted: id_col, turn_col and TURN_SCHEMA.  ``parts_col`` holds an array of PART; else the text is the only part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int32())]))
        for batch in batches:
            roles = [r or "" for r in batch.column(2).to_pylist()]
            held = batch.column(3).to_pylist()
            parts = [[part_of(p) for p in x or []] for x in held] if parts_col else [[Text(x or "")] for x in held]
            done = [format_turn(r, p, flattener) for r, p in zip(roles, parts, strict=True)]
            columns = [
                pa.array(roles, pa.string()), pa.array([d.text for d in done], pa.string()), pa.array([d.loss[0] for d in done], pa.int32()), pa.array([d.loss[1] for d in done], pa.int32()),
                pa.array([[{"kind": k, "ref": r, "tokens": n} for k, r, n in d.attachments] for d in done], kind), pa.array([d.tokens for d in done], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["id", "turn", "role", "formatted", "loss_from", "loss_to", "attachments", "tokens"])

    kinds = [f"{c} {turns.schema[c].dataType.simpleString()}" for c in (id_col, turn_col)]
    return turns.select(id_col, turn_col, role_col, parts_col or text_col).mapInArrow(run, f"{kinds[0]}, {kinds[1]}, {TURN_SCHEMA}")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, out = None, None, []

    def close() -> None:
        out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5], state[6]))

    def flush() -> pa.RecordBatch:
        types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "n_tokens"])

    for batch in batches:
        for conv, formatted, a, b, n, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if state is None or conv != key:
                if state is not None:
                    close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            for role, content in read_back(formatted):
                state[0] += 1
                state[1].update(f"{role}\n{''.join(x for x in content if isinstance(x, str))}\n".encode())
            loss = unescape(_PLACEHOLDER.sub("", formatted[a:b]))
            state[2] += len(loss)
            state[3].update(loss.encode())
            state[4] += len(formatted)
            state[5] += n
            state[6] += tokens
        if len(out) > 2000:
            yield flush()
    if state is not None:
        close()
    if out:
        yield flush()


def read_conversations(formatted: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """What the formatted turns say when read back, one row per conversation."""
    kind = formatted.schema[id_col].dataType.simpleString()
    lined = formatted.repartition(id_col).sortWithinPartitions(id_col, turn_col, "formatted").select(id_col, "formatted", "loss_from", "loss_to", F.size("attachments").alias("n"), "tokens")
    return lined.mapInArrow(_read, f"{id_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, n_tokens long")
