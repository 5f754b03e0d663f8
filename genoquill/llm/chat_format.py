"""Chat formatting by columnar byte assembly.

A turn becomes `<|im_start|>role\\ncontent<|im_end|>\\n`. A batch of turns is assembled at once: segment lengths give
cumulative offsets, and numpy scatters headers, contents and ends into one preallocated buffer that becomes the Arrow
column. Inside roles and contents each `<`, any backslashes and `|` in a row get one more backslash, so that no control
string is left in them; reading back takes it away again. Formatting needs no shuffle: the chunks of a conversation,
in the order of its turns, are its formatted text, and the loss mask of a chunk covers the content of assistant turns.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

START, END = b"<|im_start|>", b"<|im_end|>\n"
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(texts: pa.Array) -> pa.Array:
    """Control strings made harmless: `<|` to `<\\|`, `<\\|` to `<\\\\|` and so on. Null counts as empty."""
    return pc.replace_substring_regex(pc.fill_null(texts, ""), pattern=r"<(\\*)\|", replacement=r"<\\\1|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


#: Bytes that are scattered by index at once, and bytes of the turns that are assembled into one buffer.
SCATTER, BUFFER = 1 << 20, 1 << 25


def _scatter(out: np.ndarray, at: np.ndarray, values: pa.Array) -> None:
    """Copy each string of values to out from its place in at: by indices in blocks of about SCATTER bytes, a longer string as a whole."""
    offsets = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).astype(np.int64)
    size = np.diff(offsets)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)
    k = 0
    while k < len(size):
        end = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SCATTER, side="right")) - 1)
        part = data[offsets[k] : offsets[end]]
        if end == k + 1:
            out[at[k] : at[k] + size[k]] = part
        else:
            out[np.repeat(at[k:end] - (offsets[k:end] - offsets[k]), size[k:end]) + np.arange(len(part))] = part
        k = end


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The chunks of turns (large_binary), and the byte span of each chunk's content."""
    roles = pc.replace_substring(pc.replace_substring(escape(roles), "\x00", "\x00\x00"), "\n", "\x00n")
    texts = escape(texts)
    n, r, c = len(roles), pc.binary_length(roles).to_numpy().astype(np.int64), pc.binary_length(texts).to_numpy().astype(np.int64)
    ends = np.cumsum(len(START) + r + 1 + c + len(END))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if n else np.zeros(0, np.int64)
    out = np.empty(int(ends[-1]) if n else 0, np.uint8)
    out[starts[:, None] + np.arange(len(START))] = np.frombuffer(START, np.uint8)
    _scatter(out, starts + len(START), roles)
    content = starts + len(START) + r + 1
    out[content - 1] = 10
    _scatter(out, content, texts)
    out[(ends - len(END))[:, None] + np.arange(len(END))] = np.frombuffer(END, np.uint8)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    chunks = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(out)])
    return chunks, content - starts, content - starts + c


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row per turn: conv, turn, chunk (binary), loss_from and loss_to (byte span in the chunk, empty outside the loss)."""
    kind = [turns.schema[c].dataType for c in (conv, turn)]
    schema = T.StructType([T.StructField("conv", kind[0]), T.StructField("turn", kind[1]), T.StructField("chunk", T.BinaryType()), T.StructField("loss_from", T.LongType()), T.StructField("loss_to", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            group = np.cumsum(pc.fill_null(pc.binary_length(b.column(3)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // BUFFER
            edges = np.flatnonzero(np.diff(group, prepend=-1))
            for at, end in zip(edges, [*edges[1:], b.num_rows]):
                part = b.slice(at, end - at)
                roles, texts = part.column(2).cast(pa.string()), part.column(3).cast(pa.string())
                chunks, lo, hi = assemble(roles, texts)
                hi = np.where(pc.fill_null(pc.equal(roles, loss_role), False).to_numpy(zero_copy_only=False), hi, lo)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), chunks.cast(pa.binary()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=schema.names)

    return turns.select(F.col(conv), F.col(turn), F.col(role).cast("string"), F.col(text).cast("string")).mapInArrow(run, schema)


def parse_chunk(chunk: bytes) -> tuple[str, str]:
    """(role, content) of one chunk, unescaped."""
    if not chunk.startswith(START) or not chunk.endswith(END):
        raise ValueError("not a turn")
    role, _, content = chunk[len(START) : -len(END)].decode().partition("\n")
    return unescape(re.sub("\x00(.)", lambda m: "\n" if m[1] == "n" else m[1], role)), unescape(content)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation from format_turns: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The chunks are dealt by conversation and sorted within partitions by turn (nulls first, then by the chunk, so ties have
    one order), and stream through: only hash states are held, however long a conversation is. A null conversation is one
    conversation. A digest runs over its text in order, so one task reads one conversation.
    """
    kind = formatted.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), *[T.StructField(n, t) for n, t in (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def row(s: list) -> tuple:
            return s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]

        for b in batches:
            done = []
            for conv, chunk, lo, hi in zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(row(state))
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, content = parse_chunk(chunk)
                state[1] += 1
                state[2].update(f"{role}\n{content}\n".encode())
                loss = unescape(chunk[lo:hi].decode())
                state[3] += len(loss)
                state[4].update(loss.encode())
                state[5] += len(chunk.decode())
            if done:
                yield _rows(done, schema, b.schema.field(0).type)
        if state is not None:
            yield _rows([row(state)], schema, b.schema.field(0).type)

    parts = int(formatted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return formatted.repartition(parts, "conv").sortWithinPartitions("conv", "turn", "chunk").mapInArrow(run, schema)


def _rows(rows: list[tuple], schema: T.StructType, kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=schema.names)
