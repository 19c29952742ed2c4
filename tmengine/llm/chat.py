"""Chat formatting by columnar byte assembly.

A turn is ``<|turn|>role\\ntext<|end|>\\n``. Texts and roles may hold the template's own control strings: in them,
``<``, any number of backslashes and ``|`` gets one more backslash, so no ``<|`` is left, and taking one away gives the
text back. A newline in a role is written ``<|nl|>``, which no escaped role can hold otherwise.
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

from tmengine.llm.common import partitions_for

OPEN, MIDDLE, CLOSE, ROLE_NEWLINE = b"<|turn|>", b"\n", b"<|end|>\n", b"<|nl|>"
#: Role and text bytes formatted together; escapes and marks at most double them or so.
PART_BYTES = 1 << 28
_ESCAPED = re.compile(r"<(\\*)\\\|")


def escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, pattern=r"<(\\*)\|", replacement=r"<\1\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def gather(source: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, block: int = 1 << 22) -> np.ndarray:
    """Copy the segments ``source[offset : offset + length]`` one after another into one preallocated buffer."""
    ends = np.cumsum(lengths)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    at = 0
    while at < len(lengths):  # whole segments up to a block of bytes at a time: the index arrays stay small
        start = int(ends[at] - lengths[at])
        upto = max(at + 1, int(np.searchsorted(ends, start + block, "right")))
        n = lengths[at:upto]
        if upto - at == 1:
            out[start : ends[at]] = source[offsets[at] : offsets[at] + lengths[at]]
        else:
            begin = ends[at:upto] - n - start
            index = np.arange(int(ends[upto - 1]) - start) + np.repeat(offsets[at:upto] - begin, n)
            out[start : ends[upto - 1]] = source[index]
        at = upto
    return out


def assemble(roles: pa.Array, bodies: pa.Array, first: np.ndarray, loss_roles: tuple[str, ...]) -> dict:
    """Format runs of turns: ``first`` holds each conversation's first row and the number of rows."""
    roles, bodies = roles.cast(pa.large_string()), bodies.cast(pa.large_string())
    learnt = pc.is_in(roles, value_set=pa.array(loss_roles, pa.large_string())).to_numpy(zero_copy_only=False)
    roles = pc.replace_substring(escape(roles), pattern="\n", replacement=ROLE_NEWLINE.decode())
    bodies = escape(bodies)
    n = len(roles)
    parts, starts, at = [], {}, 0
    for name, raw in (("open", OPEN), ("middle", MIDDLE), ("close", CLOSE)):
        parts.append(np.frombuffer(raw, np.uint8))
        starts[name] = (at, len(raw))
        at += len(raw)
    spans = {}
    for name, column in (("role", roles), ("body", bodies)):
        offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
        spans[name] = (offsets[:-1] + at, np.diff(offsets))
        parts.append(np.frombuffer(column.buffers()[2] or b"", np.uint8))
        at += len(parts[-1])
    offsets, lengths = np.empty((n, 5), np.int64), np.empty((n, 5), np.int64)
    for k, name in enumerate(("open", "role", "middle", "body", "close")):
        offsets[:, k], lengths[:, k] = starts.get(name) or spans[name]
    data = gather(np.concatenate(parts), offsets.ravel(), lengths.ravel())
    row_end = np.concatenate([[0], np.cumsum(lengths.sum(1))])
    # positions in code points: bytes that do not continue a character, counted up to each place
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    body_at = row_end[:-1] + lengths[:, :3].sum(1)
    begin, stop = points[body_at], points[body_at + lengths[:, 3]]
    base = points[row_end[first[:-1]]]
    conversation = np.repeat(np.arange(len(first) - 1), np.diff(first))
    begin, stop = begin - base[conversation], stop - base[conversation]
    counts = np.concatenate([[0], np.cumsum(np.bincount(conversation[learnt], minlength=len(first) - 1))])
    pairs = pa.StructArray.from_arrays([pa.array(begin[learnt]), pa.array((stop - begin)[learnt])], names=["start", "length"])
    text = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(row_end[first].astype(np.int64)), pa.py_buffer(data))
    return {"formatted": text.cast(pa.string()), "loss_spans": pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pairs)}


def format_chats(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, n_turns, formatted, loss_spans)``: one row for each conversation of ``(conv_id, turn, role, text)``.

    loss_spans are (start, length) in code points of formatted that hold the texts of ``loss_roles``. Turns
    are ordered by turn, nulls first; ties and repeated rows by role and text, each kept. Null text or role:
    empty; the null conv_id is a conversation too; an empty table gives no rows; other columns are ignored.
    Rows are sorted into runs and streamed, so a task holds one Arrow batch and the conversation it is in.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    rows = rows.repartition(partitions_for(rows), "conv_id").sortWithinPartitions(*order)

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """The conversations of whole rows, as many together as stay well below a string column's 2 GiB."""
        table = table.combine_chunks()
        ids, n = table.column("conv_id").combine_chunks(), table.num_rows
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        number = ids.fill_null(0).to_numpy(zero_copy_only=False)
        first = np.concatenate([[0], np.flatnonzero((np.diff(number) != 0) | (np.diff(known.astype(np.int8)) != 0)) + 1, [n]])
        role, text = table.column("role").combine_chunks(), table.column("text").combine_chunks()
        size = np.add.reduceat(pc.add(pc.binary_length(role), pc.binary_length(text)).to_numpy(zero_copy_only=False).astype(np.int64), first[:-1])
        part = np.cumsum(size) // PART_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(first) - 1]
        for a, z in zip(cuts, cuts[1:]):
            at, rows = first[a], slice(first[a], first[z])
            made = assemble(role[rows], text[rows], first[a : z + 1] - at, loss_roles)
            columns = [ids.take(pa.array(first[a:z])), pa.array(np.diff(first[a : z + 1]).astype(np.int64)), made["formatted"], made["loss_spans"]]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "formatted", "loss_spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id")
            last = ids[batch.num_rows - 1].as_py()
            own = ids.is_null() if last is None else pc.fill_null(pc.equal(ids, last), False)
            tail = int(pc.sum(own.cast(pa.int64())).as_py())  # rows are sorted: the last conversation's rows are at the end
            if tail < batch.num_rows:
                head = batch.slice(0, batch.num_rows - tail)
                yield from emit(pa.Table.from_batches([*rest, head]))
                rest = []
            elif rest and rest[-1].column("conv_id")[0].as_py() != last:
                yield from emit(pa.Table.from_batches(rest))
                rest = []
            rest.append(batch.slice(batch.num_rows - tail))
        if rest:
            yield from emit(pa.Table.from_batches(rest))

    return rows.mapInArrow(run, "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:long,length:long>>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    out = []
    for part in formatted.split(OPEN.decode())[1:]:
        role, _, rest = part.partition(MIDDLE.decode())
        out.append((unescape(role.replace(ROLE_NEWLINE.decode(), "\n")), unescape(rest.removesuffix(CLOSE.decode()))))
    return out


def digests(chats: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the loss mask, read back from the formatted conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for chat, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist()):
                turns = read_back(chat)
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                learnt = "".join(unescape(chat[s["start"] : s["start"] + s["length"]]) for s in spans)
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in (said, learnt)]
                found.append((len(turns), sha[0], len(learnt), sha[1], len(chat)))
            a, b, c, d, e = zip(*found) if found else ((), (), (), (), ())
            columns = [batch.column("conv_id"), pa.array(a, pa.int64()), pa.array(b, pa.string()), pa.array(c, pa.int64()), pa.array(d, pa.string()), pa.array(e, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return chats.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(turns.unionByName(added)))


#: ``op2_chat_format`` in DuckDB over the same table.
OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\*\|')) AS body,
      length(role) + len(regexp_extract_all(role, '<\\*\|')) + 5 * len(regexp_extract_all(role, '\n')) AS head FROM t)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + head + 1 + body + 8)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""
