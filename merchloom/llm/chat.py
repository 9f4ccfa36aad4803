"""Chat formatting with loss masks that are aligned by character offsets.

A conversation is rendered whole and encoded once. Control strings mark the turns and are single ids
that no text can produce: inside roles and texts a bar is added to each run of bars after ``<``, which
is undone by taking one away. A turn's text therefore begins and ends on a token, and the spans of the
turns under loss are found among the tokens' offsets by binary search.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import AddedToken, Tokenizer

BEGIN, BODY, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.DOTALL)

FORMATTED = "conv_id {kind}, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def escape(text: str) -> str:
    """Add a bar to every run of bars after ``<``: no control string is left, and ``unescape`` undoes it."""
    return re.sub(r"<(\|+)", r"<|\1", text)


def unescape(text: str) -> str:
    return re.sub(r"<\|(\|+)", r"<\1", text)


def render(turns: Sequence[tuple[str, str]], under_loss: Sequence[str]) -> tuple[str, list[tuple[int, int]]]:
    """The whole conversation and the spans of the texts whose role is under loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{escape(role)}{BODY}", escape(text)
        start = at + len(head)
        if role in under_loss and body:
            spans.append((start, start + len(body)))
        parts += [head, body, END]
        at = start + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def align(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Mask of the tokens inside sorted spans; tokens of one character share its offsets."""
    mask = np.zeros(len(starts), bool)
    if spans:
        bounds = np.array(spans)
        first, last = np.searchsorted(ends, bounds[:, 0], "right"), np.searchsorted(starts, bounds[:, 1], "left")
        for a, b in zip(first, last, strict=True):
            mask[a:b] = True
    return mask


def loss_texts(formatted: str, starts: Sequence[int], ends: Sequence[int], mask: Sequence[bool]) -> list[str]:
    """The texts under the mask, read back from the output: runs of masked tokens, unescaped."""
    masked = np.concatenate([[False], np.asarray(mask, bool), [False]])
    edges = np.flatnonzero(masked[1:] != masked[:-1])
    return [unescape(formatted[starts[a]:ends[b - 1]]) for a, b in zip(edges[::2], edges[1::2], strict=True)]


def chat_tokenizer(vocabulary: str) -> Tokenizer:
    found = Tokenizer.from_file(vocabulary)
    found.add_special_tokens([AddedToken(t, special=True, normalized=False) for t in (BEGIN, BODY, END)])
    return found


def format_chats(turns: DataFrame, vocabulary: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", under_loss: Sequence[str] = ("assistant",)) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, token_ids, token_starts, token_ends, loss_mask``.

    Rows are ordered by turn, then role and text; a repeated row is a turn of its own. A null role or
    text is empty, rows without an id make one conversation. The rows of one conversation meet in one
    row of the result, as they are encoded together.
    """
    kind = turns.schema[id_col].dataType.simpleString()
    rows = turns.select(F.col(id_col).alias("conv_id"), F.struct(
        F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("row"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    roles = tuple(under_loss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chat_tokenizer(vocabulary)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                columns: list[list] = [[], [], [], [], []]
                for turns_ in part.column(1).to_pylist():
                    text, spans = render([(t["role"], t["text"]) for t in turns_], roles)
                    encoded = tokenizer.encode(text, add_special_tokens=False)
                    offsets = np.array(encoded.offsets, np.int32).reshape(-1, 2)
                    mask = align(offsets[:, 0], offsets[:, 1], spans)
                    for column, value in zip(columns, (text, encoded.ids, offsets[:, 0], offsets[:, 1], mask), strict=True):
                        column.append(value)
                kinds = (pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]],
                    ["conv_id", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask"])

    return grouped.mapInArrow(run, FORMATTED.format(kind=kind))


def digests(chats: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read back from them.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, loss_tokens``.
    """
    kind = chats.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row in range(batch.num_rows):
                text, starts, ends, mask = (batch.column(k)[row] for k in (1, 3, 4, 5))
                text = text.as_py()
                turns = parse(text)
                mask = mask.values.to_numpy(zero_copy_only=False)
                loss = "".join(loss_texts(text, starts.values.to_numpy(), ends.values.to_numpy(), mask))
                joined = "".join(f"{role}\n{body}\n" for role, body in turns)
                out.append((len(turns), hashlib.sha256(joined.encode()).hexdigest(), len(loss),
                            hashlib.sha256(loss.encode()).hexdigest(), len(text), len(mask), int(mask.sum())))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            names = ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_tokens", "loss_tokens")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([o[k] for o in out], kinds[k]) for k in range(7)]], ["conv_id", *names])

    return chats.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long")
