"""Chat formatting: conversations as training text with a loss mask, assembled column by column.

A turn is its role between START and BODY and its text up to END. Control
strings inside roles and texts are broken by a backslash after their first
character, and backslashes are doubled, so that no control string of the output
comes from a text and ``unescape`` gives back every character.

Tasks take rows in the order of conversation and turn, cut by ranges of both, so
that a conversation of any length is spread over tasks. For a run of rows the
bytes of all turns are laid out at once: segment lengths, their running sums, and
scatter indices by which headers and contents are copied into one buffer, which
becomes the Arrow column of formatted texts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazmill.llm.common import chunks, stored

START, BODY, END = "<|start|>", "<|body|>", "<|end|>"
#: What may stand in no text unbroken: the template's own marks and those of other common templates. None begins inside another.
CONTROL = (START, BODY, END, "<s>", "</s>", "[INST]", "[/INST]")
#: The role whose texts are learned.
LEARNED = "assistant"
#: Bytes from which a segment is copied as a slice, without an index for each byte.
LONG = 1 << 14

PIECES = "conv_id long, part int, piece int, n_turns long, formatted string, loss_start array<int>, loss_end array<int>, gathered boolean"
_PIECES = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.list_(pa.int32())), ("loss_end", pa.list_(pa.int32())), ("gathered", pa.bool_())]
)


def escape(texts: pa.Array) -> pa.Array:
    """Texts without any control string."""
    texts = pc.replace_substring(texts, "\\", "\\\\")
    for c in CONTROL:
        texts = pc.replace_substring(texts, c, broken(c))
    return texts


def broken(control: str) -> str:
    return control[0] + "\\" + control[1:]


def unescape(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text) if "\\" in text else text


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each and of the end)."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def _scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, at: np.ndarray) -> None:
    """Copies segment i of data (at[i] to at[i + 1]) to place to[i] of out."""
    size = np.diff(at)
    for i in np.flatnonzero(size >= LONG):
        out[to[i] : to[i] + size[i]] = data[at[i] : at[i + 1]]
    short = np.flatnonzero((size < LONG) & (size > 0))
    n = size[short]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(to[short], n) + within] = data[np.repeat(at[short], n) + within]


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """(formatted runs, and for each the code points at which its learned texts start and end); first: the row at which each run starts."""
    rows = len(texts)
    learned = pc.equal(roles, LEARNED).to_numpy(zero_copy_only=False)
    roles, texts = escape(roles), escape(texts)
    (role_data, role_at), (text_data, text_at) = _bytes_of(roles), _bytes_of(texts)
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (START, BODY, END)]
    lengths = np.empty((rows, 5), np.int64)
    lengths[:, 0::2] = [len(m) for m in marks]
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    to = np.cumsum(lengths).reshape(rows, 5) - lengths
    total = int(lengths.sum())
    out = np.empty(total, np.uint8)
    for k, mark in zip((0, 2, 4), marks, strict=True):
        out[to[:, k, None] + np.arange(len(mark))] = mark
    _scatter(out, to[:, 1], role_data, role_at)
    _scatter(out, to[:, 3], text_data, text_at)
    kind = np.int32 if total < 2**31 else np.int64
    offsets = np.r_[to[first, 0], total].astype(kind)
    made = (pa.StringArray if kind is np.int32 else pa.LargeStringArray).from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(out))
    # the mask counts code points
    text_chars = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = lengths.copy()
    chars[:, 1], chars[:, 3] = pc.utf8_length(roles).to_numpy(zero_copy_only=False), text_chars
    begin = np.cumsum(chars).reshape(rows, 5) - chars
    own = begin[:, 3] - np.repeat(begin[first, 0], np.diff(np.r_[first, rows]))
    cuts = np.searchsorted(np.flatnonzero(learned), first[1:])
    return made, np.split(own[learned], cuts), np.split((own + text_chars)[learned], cuts)


def format_conversations(rows: DataFrame) -> DataFrame:
    """Pieces of formatted conversations: conv_id, part and piece (their order), n_turns, formatted, loss_start, loss_end, gathered.

    Turns stand by turn (null last), equal ones by text and role; all rows count,
    repeated ones too. A null text or role is empty, rows without conv_id are one
    conversation, other columns are ignored, no rows give none. A conversation is one row,
    unless it is long or lies across tasks: gathered holds for every piece of
    such a one, and for the outermost of each task. The learned texts of a piece
    are its code points loss_start[i] to loss_end[i], still escaped.
    """
    own = rows.select(
        rows["conv_id"].cast("long").alias("conv_id"),
        rows["turn"].cast("long").alias("turn"),
        F.coalesce(rows["role"].cast("string"), F.lit("")).alias("role"),
        F.coalesce(rows["text"].cast("string"), F.lit("")).alias("text"),
    )
    turn = F.col("turn").asc_nulls_last()
    # the first characters cut equal turns apart, in the same order as the whole texts
    ranged = own.repartitionByRange("conv_id", turn, F.substring("text", 1, 16)).sortWithinPartitions("conv_id", turn, "text", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, piece, outer = TaskContext.get().partitionId(), None, 0, True

        def row(r: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([r], schema=_PIECES)

        for batch in batches:
            texts = batch.column("text")
            for a, b in chunks(texts.to_pylist()):
                ids = batch.column("conv_id").slice(a, b - a)
                known, value = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
                first = np.flatnonzero(np.r_[True, (known[1:] != known[:-1]) | (value[1:] != value[:-1])])
                made, starts, ends = assemble(batch.column("role").slice(a, b - a), texts.slice(a, b - a), first)
                n = np.diff(np.r_[first, b - a])
                names = ids.take(pa.array(first))
                if held is not None:
                    goes_on = held["conv_id"] == names[0].as_py()
                    held["gathered"] |= goes_on or outer
                    yield row(held)
                    outer = outer and goes_on
                    piece = piece + 1 if goes_on else 0
                    many = goes_on
                else:
                    many = False
                last = len(first) - 1
                if last > 0:
                    gathered = np.zeros(last, bool)
                    gathered[0] = many or outer
                    outer = False
                    pieces = np.zeros(last, np.int32)
                    pieces[0] = piece
                    yield pa.RecordBatch.from_arrays(
                        [names.slice(0, last), pa.array(np.full(last, part, np.int32)), pa.array(pieces), pa.array(n[:last]), made.slice(0, last).cast(pa.string()), pa.array(starts[:last], pa.list_(pa.int32())), pa.array(ends[:last], pa.list_(pa.int32())), pa.array(gathered)],
                        schema=_PIECES,
                    )
                    piece, many = 0, False
                held = {"conv_id": names[last].as_py(), "part": part, "piece": piece, "n_turns": int(n[last]), "formatted": made[last].as_py(), "loss_start": starts[last], "loss_end": ends[last], "gathered": many or outer}
        if held is not None:
            yield row(held | {"gathered": True})

    return ranged.mapInArrow(run, PIECES)


_TURN = re.compile("(?s)" + re.escape(START) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END))


def turns_of(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, unescaped."""
    return ((unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted))


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of pieces of one conversation, read as a stream."""
    now, found = None, []

    def new(conv_id: int | None) -> dict:
        return {"conv_id": conv_id, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}

    def close(x: dict) -> None:
        found.append(x | {k: x[k].hexdigest() for k in ("turns_sha256", "loss_sha256")})

    kinds = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        for r in batch.to_pylist():
            if now is None or now["conv_id"] != r["conv_id"]:
                if now is not None:
                    close(now)
                now = new(r["conv_id"])
            text = r["formatted"]
            for role, said in turns_of(text):
                now["turns_sha256"].update(f"{role}\n{said}\n".encode())
                now["n_turns"] += 1
            for a, b in zip(r["loss_start"], r["loss_end"], strict=True):
                learned = unescape(text[a:b])
                now["loss_chars"] += len(learned)
                now["loss_sha256"].update(learned.encode())
            now["formatted_chars"] += len(text)
        yield pa.RecordBatch.from_pylist(found, schema=kinds)
        found.clear()
    if now is not None:
        close(now)
        yield pa.RecordBatch.from_pylist(found, schema=kinds)


def read_back(pieces: DataFrame) -> DataFrame:
    """For each conversation what its formatted text and its mask say: counts and digests of all turns and of the learned texts.

    Whole conversations are read where they lie; the pieces of the others meet in
    order, one piece at a time.
    """
    columns = ["conv_id", "formatted", "loss_start", "loss_end"]
    whole = pieces.where("not gathered").select(columns).mapInArrow(_digests, DIGEST)
    met = pieces.where("gathered").repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece").select(columns)
    return whole.unionByName(met.mapInArrow(_digests, DIGEST))


def formatted_digests(rows: DataFrame) -> DataFrame:
    """Formats, stores and reads back."""
    return read_back(stored(format_conversations(rows), "chat"))
