"""Chat formatting with typed content parts.

A turn's content is an ordered list of parts: text, image, audio or document. A visitor flattens them into the turn's text:
text is escaped, any other part becomes a placeholder of its kind, its reference is recorded with its place in the formatted
turn and the number of tokens it expands to. The template marks turns with control strings; a control string or backslash
inside a text gets a backslash before it, so the reader gives back every turn exactly. The loss mask covers the text of
assistant turns.

Turns are formatted, and read back, row by row. A conversation's digests need its turns in order: turns are dealt by
conversation, sorted, and hashed as they stream by, so a conversation of any length is held one batch at a time.

Defined cases: null texts and roles are empty; null ids form a conversation of their own; turns of one number follow by role
and text; repeated rows are repeated turns; unknown kinds of parts are kept as documents; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from busloom.llm.common import utf8

KINDS = {"image": "[IMG]", "audio": "[AUD]", "document": "[DOC]"}
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", *KINDS.values()]
MARK = "|".join(map(re.escape, CONTROL))
ESCAPE = re.compile(rf"\\|{MARK}")
READ = re.compile(rf"\\(\\|{MARK})|({MARK})")
TRAINED = "assistant"
#: Tokens of a part: image patches of PATCH pixels a side, audio frames a second, tokens a page.
PATCH, FRAMES, PAGE = 28, 12.5, 512

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
FORMATTED = (
    "conv_id long, turn long, role string, formatted string, loss array<struct<start:int,stop:int>>, "
    "attachments array<struct<kind:string,ref:string,at:int,tokens:int>>"
)


def escape(text: str) -> str:
    return ESCAPE.sub(lambda m: "\\" + m[0], text)


@dataclass
class Flattener:
    """Visits the parts of a turn in order."""

    out: list[str] = field(default_factory=list)
    size: int = 0
    loss: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def write(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)

    def visit(self, part: dict, trained: bool) -> None:
        getattr(self, f"visit_{part.get('type') or 'text'}", self.visit_document)(part, trained)

    def visit_text(self, part: dict, trained: bool) -> None:
        start = self.size
        self.write(escape(part.get("text") or ""))
        if trained and self.size > start:
            self.loss.append({"start": start, "stop": self.size})

    def visit_image(self, part: dict, trained: bool) -> None:
        self.attach("image", part, math.ceil((part.get("width") or 0) / PATCH) * math.ceil((part.get("height") or 0) / PATCH))

    def visit_audio(self, part: dict, trained: bool) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * FRAMES))

    def visit_document(self, part: dict, trained: bool) -> None:
        self.attach("document", part, (part.get("pages") or 0) * PAGE)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "at": self.size, "tokens": tokens})
        self.write(KINDS[kind])


def format_turn(role: str, parts: list[dict]) -> Flattener:
    f = Flattener()
    f.write(f"<s>[INST]{escape(role)}[/INST]")
    for part in parts:
        f.visit(part, role == TRAINED)
    f.write("</s>")
    return f


def unescape(text: str) -> str:
    return READ.sub(lambda m: m[1] or m[2], text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn; placeholders stay in the text."""
    turns, here, role = [], [], ""
    at = 0
    for m in READ.finditer(formatted):
        here.append(formatted[at : m.start()])
        at = m.end()
        if m[1]:
            here.append(m[1])
        elif m[2] == "[/INST]":
            role, here = "".join(here), []
        elif m[2] == "</s>":
            turns.append((role, "".join(here)))
        elif m[2] in ("<s>", "[INST]"):
            here = []
        else:
            here.append(m[2])
    return turns


def format_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, content: array of PART) to FORMATTED, one row per turn."""

    def run(batches):
        for b in batches:
            made = [format_turn(r or "", p or []) for r, p in zip(b.column("role").to_pylist(), b.column("content").to_pylist())]
            columns = {
                "conv_id": b.column("conv_id"), "turn": b.column("turn"), "role": b.column("role"),
                "formatted": pa.array(["".join(f.out) for f in made], pa.string()),
                "loss": pa.array([f.loss for f in made], pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
                "attachments": pa.array([f.attachments for f in made], pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("at", pa.int32()), ("tokens", pa.int32())]))),
            }
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    picked = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), "content")
    return picked.mapInArrow(run, FORMATTED)


def as_text_part(text: str = "text"):
    fields = {"type": F.lit("text"), "text": F.col(text), "ref": F.lit(None).cast("string"), "width": F.lit(None).cast("int"), "height": F.lit(None).cast("int"), "seconds": F.lit(None).cast("double"), "pages": F.lit(None).cast("int")}
    return F.array(F.struct(*(c.alias(n) for n, c in fields.items())))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per turn: what the reader finds in the formatted text, and the text under the loss mask."""

    def run(batches):
        for b in batches:
            texts, masks = b.column("formatted").to_pylist(), b.column("loss").to_pylist()
            read = [read_turns(t)[0] for t in texts]
            lost = ["".join(unescape(t[m["start"] : m["stop"]]) for m in ms or []) for t, ms in zip(texts, masks)]
            att = [sum(a["tokens"] for a in x or []) for x in b.column("attachments").to_pylist()]
            columns = [b.column("conv_id"), b.column("turn"), *(pa.array(x, pa.string()) for x in ([r for r, _ in read], [t for _, t in read], [None if r[1] == x else x for r, x in zip(read, lost)])), pa.array(list(map(len, texts)), pa.int64()), pa.array(att, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "turn", "role", "text", "loss", "size", "attached_tokens"])

    return formatted.mapInArrow(run, "conv_id long, turn long, role string, text string, loss string, size long, attached_tokens long")


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation: turns, their digest, what the loss mask covers, and the formatted size. loss null: the whole text."""
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches):
        made: dict[str, list] = {n: [] for n in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attached_tokens")}
        now, open_ = None, False

        def close():
            for n, v in zip(made, (now, n_turns, all_.hexdigest(), loss_chars, lost.hexdigest(), size, attached)):
                made[n].append(v)

        def flush():
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            batch = pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(made.values(), kinds)], names=list(made))
            for v in made.values():
                v.clear()
            return batch

        for b in batches:
            for conv, role, text, loss, chars, tokens in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "size", "attached_tokens"))):
                if not open_ or conv != now:
                    if open_:
                        close()
                    now, open_ = conv, True
                    all_, lost = hashlib.sha256(), hashlib.sha256()
                    n_turns = loss_chars = size = attached = 0
                n_turns += 1
                size += chars
                attached += tokens
                all_.update(utf8(f"{role}\n{text}\n"))
                under = text if loss is None else loss
                loss_chars += len(under)
                lost.update(utf8(under))
            if len(made["conv_id"]) >= 1000:
                yield flush()
        if open_:
            close()
        yield flush()

    return dealt.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attached_tokens long")
