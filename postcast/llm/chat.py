"""Chat formatting with loss masks aligned to token offsets.

A conversation is rendered as one string, turn after turn:
``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``.  The markers are control
tokens of the tokenizer, so no token reaches across them.  Control strings inside
roles and texts are broken up by a backslash after their first character, and
backslashes are doubled, so the rendering can be undone exactly.  The whole
string is encoded once with offsets; the sorted spans of the assistant texts are
intersected with the sorted token spans by binary search, which marks the tokens
that count for the loss.

Defined cases: a null text or role counts as empty; turns with equal numbers are
ordered by role and text; a null turn number comes first; repeated rows stay
repeated turns; rows with a null conv_id form one conversation; extra columns are
ignored; an empty table gives an empty result.  One conversation is one string
and hence one unit of work; the turns of a conversation, not those of all, meet
in a task.
"""
from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postcast.llm.common import bounded_batches

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# Control strings of common templates, none of which may be read
# as control inside a text.
CONTROLS = [START, SEP, END, "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "<unk>", "[INST]", "[/INST]",
            "<<SYS>>", "<</SYS>>"]
SLICE = 64

_FIND = re.compile("|".join(["\\\\"] + [re.escape(c) for c in sorted(CONTROLS, key=len, reverse=True)]))
_UNDO = re.compile(r"\\(\\?)", re.S)


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of a control
    string.  Control strings neither overlap nor hold backslashes, so undoing it
    from left to right is exact."""
    return _FIND.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNDO.sub(lambda m: m[1], text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray, np.ndarray]:
    """The formatted string, and begin and end (code points) of every text."""
    out, begins, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        out += (head, body, END)
        begins.append(at + len(head))
        ends.append(begins[-1] + len(body))
        at = ends[-1] + len(END)
    return "".join(out), np.array(begins, np.int64), np.array(ends, np.int64)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts, read back from a formatted string."""
    turns = []
    for part in formatted.split(START)[1:]:
        role, text = part.split(SEP, 1)
        turns.append((unescape(role), unescape(text.removesuffix(END))))
    return turns


def mask_tokens(spans: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Flags for the tokens (rows of begin, end, in order) that lie in one of the
    sorted text spans; two binary searches for each span."""
    first = np.searchsorted(spans[:, 1], begins, "right")  # first token that ends after the begin
    last = np.searchsorted(spans[:, 0], ends, "left")  # first token that begins at the end or later
    step = np.zeros(len(spans) + 1, np.int64)
    full = last > first
    np.add.at(step, first[full], 1)
    np.add.at(step, last[full], -1)
    return np.cumsum(step[:-1]) > 0


def masked_text(formatted: str, spans: np.ndarray, mask: np.ndarray) -> str:
    """The text under the mask, unescaped: runs of marked tokens in order."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return "".join(unescape(formatted[spans[a, 0]:spans[b - 1, 1]]) for a, b in edge.reshape(-1, 2).tolist())


class ChatEncoder:
    """A tokenizer whose control tokens are the template's markers; offsets are
    code points and include leading white space."""

    def __init__(self, definition: str):
        from tokenizers import AddedToken, Tokenizer, processors
        spec = json.loads(definition)
        spec["added_tokens"] = []  # control strings of the file are ordinary text here
        self.tok = Tokenizer.from_str(json.dumps(spec))
        self.tok.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in (START, SEP, END)])
        self.tok.post_processor = processors.ByteLevel(trim_offsets=False)

    def encode(self, formatted: str) -> tuple[list[int], np.ndarray]:
        e = self.tok.encode(formatted, add_special_tokens=False)
        return e.ids, np.array(e.offsets, np.int64).reshape(-1, 2)


_ENCODERS: dict[str, ChatEncoder] = {}


def format_chats(turns: DataFrame, definition: str, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, ``formatted``, ``ids``, ``begins`` and
    ``ends`` of the tokens (code points), ``loss_mask`` per token, and the text
    under the mask (``loss_text``).  ``turns`` has conv_id, turn, role and text;
    texts of the roles in ``learn`` are under the mask."""
    bounded_batches(turns.sparkSession)
    shared = turns.sparkSession.sparkContext.broadcast(definition)
    key = hashlib.sha256(definition.encode()).hexdigest()
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(
        F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    schema = T.StructType([turns.schema["conv_id"], *T.StructType.fromDDL(
        "formatted string, ids array<int>, begins array<int>, ends array<int>, loss_mask array<boolean>, "
        "loss_text string").fields])

    def run(batches):
        if key not in _ENCODERS:
            _ENCODERS.clear()
            _ENCODERS[key] = ChatEncoder(shared.value)
        enc = _ENCODERS[key]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = []
                for conv in part.column("turns").to_pylist():
                    said = [(t["role"], t["text"]) for t in conv]
                    whole, begins, ends = render(said)
                    counts = np.array([r in learn for r, _ in said], bool)
                    ids, spans = enc.encode(whole)
                    mask = mask_tokens(spans, begins[counts], ends[counts])
                    made.append((whole, ids, spans[:, 0].tolist(), spans[:, 1].tolist(), mask.tolist(),
                                 masked_text(whole, spans, mask)))
                kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()),
                         pa.list_(pa.bool_()), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id")] + [pa.array(c, t) for c, t in zip(zip(*made), kinds)],
                    names=schema.names)
    return grouped.mapInArrow(run, schema)


def read_back(chats: DataFrame) -> DataFrame:
    """conv_id, ``turns`` (array of role and text) parsed from ``formatted``,
    with the other columns of the chats."""
    schema = T.StructType([*chats.schema.fields, *T.StructType.fromDDL(
        "turns array<struct<role: string, text: string>>").fields])
    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches):
        for b in batches:
            turns = [[{"role": r, "text": t} for r, t in parse(x)] for x in b.column("formatted").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(turns, kind)], names=schema.names)
    return chats.mapInArrow(run, schema)
