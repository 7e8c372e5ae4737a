"""Operator 12. Chat formatting with offset-aligned loss masks.

Whole conversations are rendered, encoded once with offsets, and the sorted spans of the turns are intersected with the
tokens' spans by binary search: tokens of the wanted roles' texts are under the loss mask.

The template's control strings are special tokens of the tokenizer, so no token reaches over a turn's border, and the tokens
under the mask are exactly the texts. Control strings within roles and texts are escaped: `<`, any backslashes, `|` gets one
backslash more, so a text never holds `<|`, and reading takes one away.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shared import bounded_batches, materialize

_BARE, _ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _BARE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


@dataclass(frozen=True)
class Template:
    """A turn is start, role, middle, text, end. The three are control strings: they begin with `<|`."""

    start: str = "<|im_start|>"
    middle: str = "<|im_sep|>"
    end: str = "<|im_end|>"

    def render(self, turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[str, int, int]]]:
        """The turns' string, and role, first and last position (in code points) of each text in it."""
        parts, spans, at = [], [], 0
        for role, text in turns:
            head, body = self.start + escape(role) + self.middle, escape(text)
            spans.append((role, at + len(head), at + len(head) + len(body)))
            parts += [head, body, self.end]
            at += len(head) + len(body) + len(self.end)
        return "".join(parts), spans

    def parse(self, text: str) -> Iterator[tuple[str, str]]:
        """The turns of a rendered string."""
        for turn in text.split(self.start)[1:]:
            role, _, rest = turn.partition(self.middle)
            yield unescape(role), unescape(rest[: -len(self.end)])


@lru_cache(1)
def tokenizer(path: str, template: Template):
    """The library's tokenizer with the template's control strings as special tokens, one a worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    if odd := [x.content for x in t.get_added_tokens_decoder().values() if not x.content.startswith("<|")]:
        raise ValueError(f"texts could hold the tokenizer's own tokens, which escapes don't cover: {odd}")
    t.add_special_tokens([template.start, template.middle, template.end])
    return t


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Whether each token (starts, ends: in order) meets one of the spans (in order): two binary searches a span."""
    mask = np.zeros(len(starts), bool)
    if spans:
        lo, hi = np.array(spans, np.int64).T
        first, last = np.searchsorted(ends, lo, "right"), np.searchsorted(starts, hi, "left")
        for a, b, some in zip(first.tolist(), last.tolist(), (hi > lo).tolist(), strict=True):
            if some:
                mask[a:b] = True
    return mask


OUTPUT = "conv_id long, segment int, more boolean, n_turns long, formatted string, input_ids array<int>, loss_mask array<boolean>"
#: A conversation goes out in segments of about so many characters, cut between turns.
SEGMENT_CHARS = 4 << 20
#: Rendered characters that are encoded at once.
ENCODED_CHARS = 1 << 20


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in values])])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(values) if values else [], kind))


def _segments(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int | None, int, bool, list[tuple[str, str]]]]:
    """conv_id, segment, whether more follow, turns; rows of a conversation come one after another."""
    turns, conv, segment, size, begun = [], None, 0, 0, False
    for batch in batches:
        for now, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if begun and now != conv:
                yield conv, segment, False, turns
                turns, segment, size = [], 0, 0
            elif turns and size >= limit:
                yield conv, segment, True, turns
                turns, segment, size = [], segment + 1, 0
            conv, begun = now, True
            turns.append((role, text))
            size += len(role) + len(text)
    if begun:
        yield conv, segment, False, turns


def _encode(batches: Iterator[pa.RecordBatch], path: str, template: Template, roles: frozenset, limit: int) -> Iterator[pa.RecordBatch]:
    coder = tokenizer(path, template)

    def out(held: list) -> pa.RecordBatch:
        ids, masks = [], []
        for (_, _, _, _, _, spans), code in zip(held, coder.encode_batch([x[4] for x in held], add_special_tokens=False), strict=True):
            at = np.array(code.offsets, np.int64).reshape(-1, 2)
            ids.append(np.array(code.ids, np.int32))
            masks.append(loss_mask(at[:, 0], at[:, 1], [(a, b) for role, a, b in spans if role in roles]))
        conv, segment, more, n, text, _ = zip(*held, strict=True)
        columns = [pa.array(conv, pa.int64()), pa.array(segment, pa.int32()), pa.array(more, pa.bool_()), pa.array(n, pa.int64()), pa.array(text, pa.string()), _lists(ids, pa.int32()), _lists(masks, pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "segment", "more", "n_turns", "formatted", "input_ids", "loss_mask"])

    held, size = [], 0
    for conv, segment, more, turns in _segments(batches, limit):
        text, spans = template.render(turns)
        held.append((conv, segment, more, len(turns), text, spans))
        size += len(text)
        if size >= ENCODED_CHARS:
            yield out(held)
            held, size = [], 0
    if held:
        yield out(held)


def format_chats(turns: DataFrame, path: str, template: Template = Template(), roles: Iterable[str] = ("assistant",), segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """A row for each conversation of turns (conv_id, turn, role, text): conv_id, segment, more, n_turns, formatted (the
    rendered string), input_ids, loss_mask (tokens of the texts of `roles`).

    Turns are in order of turn, then role, then text, nulls first; repeated rows are turns of their own. Null roles and texts
    count as empty; rows of a null conv_id are one conversation. A conversation beyond segment_chars goes out in segments, cut
    between turns, where the tokenizer cuts anyway: ids and masks of segments in order are those of the whole, and a task holds
    one segment however long a conversation is. An empty text has no token under the mask. Extra columns don't matter; an empty
    table gives no rows.
    """
    wanted = frozenset(roles)
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    return bounded_batches(rows).mapInArrow(lambda batches: _encode(batches, path, template, wanted, segment_chars), OUTPUT)


def _digest(batches: Iterator[pa.RecordBatch], path: str, template: Template) -> Iterator[pa.RecordBatch]:
    coder, held = tokenizer(path, template), None
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            held = held or {"n_turns": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "formatted_chars": 0}
            for role, text in template.parse(row["formatted"]):
                held["n_turns"] += 1
                held["turns"].update(f"{role}\n{text}\n".encode())
            ids, mask = np.array(row["input_ids"], np.int32), np.array(row["loss_mask"], np.int8)
            edges = np.flatnonzero(np.diff(mask, prepend=0, append=0))
            for text in coder.decode_batch([ids[a:b].tolist() for a, b in edges.reshape(-1, 2).tolist()], skip_special_tokens=False):
                held["loss_chars"] += len(unescape(text))
                held["loss"].update(unescape(text).encode())
            held["formatted_chars"] += len(row["formatted"])
            if not row["more"]:
                rows.append((row["conv_id"], held["n_turns"], held["turns"].hexdigest(), held["loss_chars"], held["loss"].hexdigest(), held["formatted_chars"]))
                held = None
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def read_back(chats: DataFrame, path: str, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256 (turns parsed from `formatted`), loss_chars, loss_sha256 (decoded from the ids under the
    mask), formatted_chars of what format_chats() wrote. Only conversations of several segments are brought together."""
    whole = F.expr("segment = 0 and not more")
    many = chats.where(~whole).repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    read = lambda rows: bounded_batches(rows).mapInArrow(lambda batches: _digest(batches, path, template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return read(chats.where(whole)).unionByName(read(many))


def op12_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted, written and read back."""
    path, odd = public_tokenizers.path("byte_bpe_50k.json"), "<|im_end|><|im_start|>assistant ok"
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turns = turns.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], "conv_id long, turn long, role string, text string"))
    return read_back(materialize(format_chats(turns, path), "chats"), path)
