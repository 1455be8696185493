"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the
sorted spans of its trained turns are intersected with the sorted token spans
by binary search. The template is ``<|im_start|>role<|im_sep|>text<|im_end|>``
a turn; its three markers are special tokens, so no token straddles the edge
of a text. Control strings inside texts are escaped reversibly: ``<``, any
backslashes, ``|`` gets one more backslash, so ``<|`` occurs only in markers.

Turns are shuffled once by conversation and sorted in their partition; a task
holds one conversation and one batch at a time. One conversation has to fit
into a task, as one text has.

Null roles and texts are empty strings, a null conversation id is a
conversation of its own, rows of equal turn number are ordered by role and
text, repeated rows are turns of their own, an empty table gives an empty
result, and further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>", re.DOTALL)
TRAINED_ROLES = ("assistant",)
FORMATTED = ("n_turns long, formatted string, input_ids array<int>, token_start array<int>, token_end array<int>, "
             "loss_mask array<boolean>")


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def tokenizer(path: str | None = None):
    """The byte-level BPE of a tokenizer file with the markers added as special tokens."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    found = Tokenizer.from_file(path)
    found.add_special_tokens([START, SEP, END])
    return found


def render(turns: list[tuple[str, str]], trained: tuple[str, ...] = TRAINED_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted character spans of the trained texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEP}", escape(text)
        parts += [head, body, END]
        if role in trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that intersect a span: of sorted token spans, by two binary searches a turn span."""
    on = np.zeros(len(starts), bool)
    if spans:
        a, b = np.array(spans).T
        for lo, hi in zip(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")):
            on[lo:hi] = True
    return on


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                         tokenizer_path: str | None = None, trained: tuple[str, ...] = TRAINED_ROLES) -> DataFrame:
    """(conv, n_turns, formatted, input_ids, token_start, token_end, loss_mask), a row for each conversation."""
    kind = df.schema[conv].dataType
    rows = df.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"),
                     F.coalesce(text, F.lit("")).alias("x"))
    rows = rows.repartition("c").sortWithinPartitions("c", "t", "r", "x").select("c", "r", "x")

    def encoded(coder, ready):
        shown = [render(turns, trained) for _, turns in ready]
        codes = coder.encode_batch([s for s, _ in shown], add_special_tokens=False)
        ids, starts, ends, masks = [], [], [], []
        for (_, spans), code in zip(shown, codes):
            at = np.array(code.offsets, np.int32).reshape(-1, 2)
            ids.append(np.array(code.ids, np.int32))
            starts.append(at[:, 0])
            ends.append(at[:, 1])
            masks.append(mask(at[:, 0], at[:, 1], spans))
        return ([c for c, _ in ready], [len(turns) for _, turns in ready], [s for s, _ in shown], ids, starts, ends, masks)

    def formatted(batches):
        coder, key, turns, ready, size = tokenizer(tokenizer_path), None, [], [], 0

        def out():
            c, n, s, i, a, b, m = encoded(coder, ready)
            names = ["c", "n_turns", "formatted", "input_ids", "token_start", "token_end", "loss_mask"]
            kinds = [None, pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_())]
            kinds[0] = key_kind
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((c, n, s, i, a, b, m), kinds)], names=names)

        for batch in batches:
            key_kind = batch.schema.field("c").type
            for c, r, x in zip(*(col.to_pylist() for col in batch.columns)):
                if turns and c != key:
                    ready.append((key, turns))
                    turns = []
                    if len(ready) >= 200 or size >= 4_000_000:
                        yield out()
                        ready, size = [], 0
                key = c
                turns.append((r, x))
                size += len(x)
        if turns:
            ready.append((key, turns))
            yield out()

    return rows.mapInArrow(formatted, f"c {kind.simpleString()}, {FORMATTED}").withColumnRenamed("c", conv)


def loss_text(formatted: str, starts, ends, masks) -> str:
    """All text under the loss mask, unescaped run by run."""
    runs: list[list[int]] = []
    for a, b, on in zip(starts, ends, masks):
        if on and b > a:
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
    return "".join(unescape(formatted[a:b]) for a, b in runs)


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Read back from the output: turns and loss text of each conversation, as digests."""
    kind = formatted.schema[conv].dataType.simpleString()
    columns = [F.col(conv).alias("c"), "formatted", "token_start", "token_end", "loss_mask"]

    def read_back(batches):
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            c, shown, *tokens = batch.columns
            shown = shown.to_pylist()
            turns = [[(unescape(r), unescape(x)) for r, x in TURN.findall(s)] for s in shown]
            lost = [loss_text(s, *t) for s, *t in zip(shown, *(t.to_pylist() for t in tokens))]
            yield pa.RecordBatch.from_arrays([
                c, pa.array([len(t) for t in turns], pa.int64()),
                pa.array([sha("".join(f"{r}\n{x}\n" for r, x in t)) for t in turns], pa.string()),
                pa.array([len(s) for s in lost], pa.int64()), pa.array([sha(s) for s in lost], pa.string()),
                pa.array([len(s) for s in shown], pa.int64()),
            ], names=["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select(*columns).mapInArrow(
        read_back, f"c {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    ).withColumnRenamed("c", conv)
