"""Chat formatting with a loss mask aligned to token offsets.

A turn is rendered as ``<|turn|>role<|text|>text<|end|>``. The three markers are tokens of their own,
and what looks like the start of a marker inside a role or text gets one backslash more between its
two characters, which reading takes away again. Conversations are rendered in whole turns, encoded
once with offsets, and the token range of each assistant text is found by binary search among the
tokens' sorted offsets. A very long conversation is cut between turns: a marker parts tokens, so the
pieces' tokens behind each other are those of the whole.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.common import worker_cache

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
PART_TURNS = 64
PIECE_CHARS = 1 << 20

_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_RENDERED = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def tokenizer(path: str):
    """The tokenizer with the three markers added, loaded once per worker."""
    cache = worker_cache("chat tokenizers")
    if path not in cache:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (TURN, TEXT, END)])
        cache[path] = t
    return cache[path]


def render(turns: list[tuple[str, str]], loss_role: str) -> tuple[str, list[tuple[int, int]]]:
    """The formatted turns and the character spans of the texts to be learned."""
    out, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        out += [head, body, END]
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(out), spans


def token_mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> np.ndarray:
    """True for the tokens whose characters lie in one of the sorted spans."""
    starts = np.array([a for a, _ in offsets], dtype=np.int64)
    edges = np.searchsorted(starts, np.array(spans, dtype=np.int64).reshape(-1, 2), side="left")
    steps = np.zeros(len(offsets) + 1, dtype=np.int64)
    np.add.at(steps, edges[:, 0], 1)
    np.add.at(steps, edges[:, 1], -1)
    return np.cumsum(steps[:-1]) > 0


def format_conversations(turns: DataFrame, path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", loss_role: str = "assistant", part_turns: int = PART_TURNS,
                         piece_chars: int = PIECE_CHARS) -> DataFrame:
    """``conv_id, part, piece, n_turns, formatted, tokens, loss`` in pieces of whole turns.

    Turns are ordered by turn number (null first), equal numbers by role and text; (part, piece)
    orders a conversation's pieces. Null roles and texts count as empty, a null conversation id is
    a conversation. ``loss`` is true for the tokens of ``loss_role``'s texts. An empty table stays
    empty.
    """
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("_turn"),
                        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_role"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"),
                        F.floor(F.col(turn_col) / part_turns).cast("long").alias("part"))
    names = ["conv_id", "part", "piece", "n_turns", "formatted", "tokens", "loss"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        ready: list[tuple] = []  # pieces to encode together
        held: list[tuple[str, str]] = []
        key, piece, size, waiting = None, 0, 0, 0

        def encode():
            made = [render(p[3], loss_role) for p in ready]
            codes = t.encode_batch([text for text, _ in made], add_special_tokens=False)
            rows = [(*p[:3], len(p[3]), text, e.ids, token_mask(e.offsets, spans).tolist())
                    for p, (text, spans), e in zip(ready, made, codes)]
            ready.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names)

        for batch in batches:
            for conv, part, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "_role", "_text"))):
                if held and ((conv, part) != key or size >= piece_chars):
                    ready.append((*key, piece, held))
                    waiting += size
                    piece, held, size = piece + 1 if (conv, part) == key else 0, [], 0
                    if waiting >= piece_chars:
                        yield encode()
                        waiting = 0
                if (conv, part) != key:
                    key, piece = (conv, part), 0
                held.append((role, text))
                size += len(role) + len(text) + 24
        if held:
            ready.append((*key, piece, held))
        if ready:
            yield encode()

    return (rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "_turn", "_role", "_text")
            .mapInArrow(run, "conv_id long, part long, piece long, n_turns long, formatted string, tokens array<int>, loss array<boolean>"))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of formatted turns."""
    return [(unescape(r), unescape(t)) for r, t in _RENDERED.findall(formatted)]


def learned_texts(t, tokens: np.ndarray, loss: np.ndarray) -> list[str]:
    """The texts under the mask, decoded from their tokens alone."""
    edges = np.nonzero(np.diff(np.concatenate(([False], loss, [False])).astype(np.int8)))[0]
    return [unescape(t.decode(tokens[a:b].tolist(), skip_special_tokens=False)) for a, b in zip(edges[::2], edges[1::2])]


def digests(pieces: DataFrame, path: str) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` per conversation,
    from formatted pieces alone; pieces stream by in order, so nothing is gathered."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, state, rows = tokenizer(path), None, []

        def done():
            return (state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5])

        for batch in batches:
            for i in range(batch.num_rows):
                conv, n, formatted = (batch.column(c)[i].as_py() for c in ("conv_id", "n_turns", "formatted"))
                tokens, loss = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("tokens", "loss"))
                if state is None or state[0] != conv:
                    if state is not None:
                        rows.append(done())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns = read_turns(formatted)
                if len(turns) != n:
                    raise ValueError("formatted turns do not read back")
                state[1] += n
                for role, text in turns:
                    state[2].update(f"{role}\n{text}\n".encode())
                for text in learned_texts(t, tokens, loss):
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(formatted)
            if len(rows) > 5000:
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names)
                rows = []
        if state is not None:
            rows.append(done())
            yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*rows), types)], names)

    return (pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
