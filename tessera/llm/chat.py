"""Chat formatting by columnar byte assembly.

A turn is written as ``<|im_start|>ROLE<|im_sep|>TEXT<|im_end|>`` and a line feed. Control strings, those of this template
and ``<s>``, ``</s>``, ``[INST]``, ``[/INST]``, get a backslash after their first character inside roles and texts, as do those
that have backslashes there already: so none is left, and taking one backslash away restores the text.

Rows are shuffled by conversation and sorted by turn within partitions; each short run of rows is copied into one
preallocated buffer at offsets summed from the segment lengths. A conversation may come in several parts, numbered in
order, so that one of any length is formatted in bounded memory; the loss mask is a list of byte spans of each part.

Null roles and texts count as empty. Rows without conv_id make one conversation; rows without turn come first; rows of
equal turn follow by role, then text, and repeated rows all stay. An empty table gives an empty result. Further columns
are left behind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import python_pass, slices

START, SEP, END = b"<|im_start|>", b"<|im_sep|>", b"<|im_end|>\n"
_CONTROL = re.compile(r"<(?=\\*(?:\||/?s>))|\[(?=\\*/?INST\])")
_ESCAPED = re.compile(r"(?<=<)\\(?=\\*(?:\||/?s>))|(?<=\[)\\(?=\\*/?INST\])")
_TURN = re.compile(r"<\|im_start\|>(.*?)<\|im_sep\|>(.*?)<\|im_end\|>\n", re.DOTALL)

PARTS = "conv_id long, part long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def _escaped(column: pa.Array) -> pa.Array:
    """The column with control strings escaped; only texts that hold a first character of one are looked into."""
    odd = pc.or_(pc.match_substring(column, "<"), pc.match_substring(column, "["))
    if not pc.any(odd).as_py():
        return column
    changed = pa.array([escape(t) for t in column.filter(odd).to_pylist()], column.type)
    return pc.replace_with_mask(column, odd, changed)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column from its first row on, and the offsets of its rows."""
    column = pc.cast(column, pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64, column.offset + len(column) + 1)[column.offset :]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


#: Bytes for which scatter indices, eight times their size, are made at a time.
SCATTERED = 1 << 18


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, ends: np.ndarray) -> None:
    """Copies row i of ``data`` to ``out`` from ``at[i]`` on."""
    shift = at - ends[:-1]
    for start in range(0, len(data), SCATTERED):
        stop = min(start + SCATTERED, len(data))
        first, last = np.searchsorted(ends, start, "right") - 1, np.searchsorted(ends, stop, "left")
        times = np.diff(np.clip(ends[first : last + 1], start, stop))
        out[np.arange(start, stop) + np.repeat(shift[first:last], times)] = data[start:stop]


def assemble(conv: pa.Array, role: pa.Array, text: pa.Array) -> tuple[np.ndarray, pa.RecordBatch]:
    """First row of each run of one conversation, and the runs formatted."""
    n = len(conv)
    roles, role_ends = _bytes(_escaped(role))
    texts, text_ends = _bytes(_escaped(text))
    fixed = len(START) + len(SEP) + len(END)
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(np.diff(role_ends) + np.diff(text_ends) + fixed, out=begin[1:])
    role_at = begin[:-1] + len(START)
    sep_at = role_at + np.diff(role_ends)
    text_at = sep_at + len(SEP)
    end_at = text_at + np.diff(text_ends)
    buffer = pa.allocate_buffer(int(begin[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for at, mark in ((begin[:-1], START), (sep_at, SEP), (end_at, END)):
        out[(at[:, None] + np.arange(len(mark))).ravel()] = np.tile(np.frombuffer(mark, np.uint8), n)
    _scatter(out, role_at, roles, role_ends)
    _scatter(out, text_at, texts, text_ends)

    ids, known = np.asarray(pc.fill_null(conv, 0)), np.asarray(pc.is_valid(conv))
    first = np.concatenate([[0], 1 + np.flatnonzero((ids[1:] != ids[:-1]) | (known[1:] != known[:-1]))])
    stops = np.append(first, n)
    mask = np.asarray(pc.equal(role, "assistant"))
    run = np.repeat(np.arange(len(first)), np.diff(stops))[mask]
    lists = np.concatenate([[0], np.cumsum(np.bincount(run, minlength=len(first)))]).astype(np.int32)
    spans = [pa.ListArray.from_arrays(pa.array(lists), pa.array(x[mask] - begin[first][run])) for x in (text_at, end_at)]
    formatted = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(begin[stops].tobytes()), buffer)
    columns = [conv.take(pa.array(first)), pa.array(np.diff(stops)), formatted.cast(pa.string()), *spans]
    return first, pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "formatted", "loss_start", "loss_end"])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = object(), 0
    for batch in slices(batches, 256):
        conv, role, text = (batch.column(i) for i in range(3))
        _, out = assemble(conv, role, text)
        parts = []
        for c in out.column(0).to_pylist():
            last, part = c, part + 1 if c == last else 0
            parts.append(part)
        yield pa.RecordBatch.from_arrays(
            [out.column(0), pa.array(parts, pa.int64()), *[out.column(i) for i in range(1, 5)]],
            ["conv_id", "part", "n_turns", "formatted", "loss_start", "loss_end"],
        )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The parts of every formatted conversation; those of one conversation follow each other in one partition."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return python_pass(dealt.select("conv_id", "role", "text"), _format, PARTS)


class _Digest:
    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss = conv, hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, starts: list[int], ends: list[int]) -> None:
        self.formatted_chars += len(formatted)
        at = 0
        for m in _TURN.finditer(formatted):
            if m.start() != at:
                raise ValueError("formatted text doesn't parse")
            at = m.end()
            self.n_turns += 1
            self.turns.update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
        if at != len(formatted):
            raise ValueError("formatted text doesn't parse")
        data = formatted.encode()
        for a, b in zip(starts, ends, strict=True):
            said = unescape(data[a:b].decode())
            self.loss_chars += len(said)
            self.loss.update(said.encode())

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    now, done = None, []
    for batch in slices(batches, 256):
        for conv, part, formatted, starts, ends in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss_start", "loss_end")], strict=True):
            if part == 0:
                if now:
                    done.append(now.row())
                now = _Digest(conv)
            now.add(formatted, starts, ends)
        if len(done) >= 1000:
            yield batch_of(done)
            done = []
    if now:
        done.append(now.row())
    if done:
        yield batch_of(done)


def digests(parts: DataFrame) -> DataFrame:
    """What the formatted parts say, read back from them: a row for each conversation."""
    return python_pass(parts, _read_back, DIGESTS)


def with_control_strings(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one, -7, whose two turns are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select("conv_id", "turn", "role", "text").union(more)


ORACLE = r"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (SELECT *, length(role) + length(text) + 33 + len(regexp_extract_all(role, '<\\*(\||/?s>)|\[\\*/?INST\]'))
  + len(regexp_extract_all(text, '<\\*(\||/?s>)|\[\\*/?INST\]')) AS chars FROM c),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss, CAST(sum(chars) AS BIGINT) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""
