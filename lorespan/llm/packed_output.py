"""Packed token-id matrices by best-fit decreasing, with a segment tree over free capacities.

A document longer than the context is cut into full rows and a remainder, without loss. Remainders are
placed longest first, each into the open row with the least free space that still holds it; the segment
tree finds that capacity in log(context) steps. A row of the result is one row of the id matrix: ids padded
to the context, positions that restart at each segment, and cumulative segment lengths, ready for
variable-length attention kernels. Every task packs its own rows in bounded groups: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan.llm import text as T
from lorespan.llm.tokens import encoder, proven, vocabulary

GROUP_DOCS = 4096
GROUP_TOKENS = 2 << 20
#: Matrix rows in one Arrow batch: a few hundred kB, so that neither side holds large buffers.
BATCH_ROWS = 64
FIELDS = ("row_id", "n_tokens", "n_segments", "input_ids", "position_ids", "cu_seqlens", "doc_ids", "doc_starts", "ids_dtype")
KINDS = ("long", "int", "int", "binary", "binary", "array<int>", "array<{}>", "array<long>", "string")


class CapacityTree:
    """Rows by free capacity 0..size; ``least(n)`` is the smallest capacity >= n that some row has, or -1."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.count = [0] * (2 * self.width)
        self.rows: dict[int, list[int]] = {}

    def _change(self, capacity: int, by: int) -> None:
        i = capacity + self.width
        while i:
            self.count[i] += by
            i >>= 1

    def add(self, capacity: int, row: int) -> None:
        self.rows.setdefault(capacity, []).append(row)
        self._change(capacity, 1)

    def take(self, capacity: int) -> int:
        self._change(capacity, -1)
        return self.rows[capacity].pop()

    def least(self, n: int) -> int:
        i = n + self.width
        if self.count[i]:
            return n
        while i > 1:  # up, until a right-hand neighbour holds something
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.width:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.width
            i >>= 1
        return -1


def best_fit(lengths: list[int], context: int) -> list[list[tuple[int, int, int]]]:
    """Rows of (document, start, length); every token of every document is in exactly one."""
    rows, rest = [], []
    for d, n in enumerate(lengths):
        full = n - n % context
        rows += [[(d, at, context)] for at in range(0, full, context)]
        if full < n:
            rest.append((d, full, n - full))
    tree = CapacityTree(context)
    for piece in sorted(rest, key=lambda p: (-p[2], p[0])):
        free = tree.least(piece[2])
        if free < 0:
            rows.append([])
            row, free = len(rows) - 1, context
        else:
            row = tree.take(free)
        rows[row].append(piece)
        if free > piece[2]:
            tree.add(free - piece[2], row)
    return rows


def _binary(matrix: np.ndarray) -> pa.Array:
    n, width = len(matrix), matrix.shape[1] * matrix.itemsize
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix))])


def _packer(path: str, same: bool, context: int, end_id: int, pad_id: int, dtype: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, base, made = encoder(path, same), TaskContext.get().partitionId() << 33, 0

        def emit(keys, ids, rows):
            nonlocal made
            matrix = np.full((len(rows), context), pad_id, dtype)
            places = np.zeros((len(rows), context), "<u2" if context <= 1 << 16 else "<u4")
            count = np.arange(context, dtype=places.dtype)
            lengths, segments = [], []
            for r, row in enumerate(rows):
                offset, cuts = 0, [0]
                for d, at, n in row:
                    matrix[r, offset : offset + n] = ids[d][at : at + n]
                    places[r, offset : offset + n] = count[:n]
                    offset += n
                    cuts.append(offset)
                lengths.append(offset)
                segments.append(cuts)
            made += len(rows)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(base + made - len(rows), base + made)),
                    pa.array(lengths, pa.int32()),
                    pa.array([len(r) for r in rows], pa.int32()),
                    _binary(matrix),
                    _binary(places),
                    pa.array(segments, pa.list_(pa.int32())),
                    pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), keys.take(pa.array([d for r in rows for d, _, _ in r]))),
                    pa.array([[at for _, at, _ in r] for r in rows], pa.list_(pa.int64())),
                    pa.array([dtype] * len(rows)),
                ],
                names=[*FIELDS],
            )

        def flush(keys, ids):
            rows, keys = best_fit([len(x) for x in ids], context), pa.concat_arrays(keys)
            for at in range(0, len(rows), BATCH_ROWS):
                yield emit(keys, ids, rows[at : at + BATCH_ROWS])

        keys, ids, held = [], [], 0
        for batch in batches:
            for i, text in enumerate(batch.column(1)):
                body = codec.ids(text.as_py()) if text.is_valid else np.zeros(0, np.uint32)
                keys.append(batch.column(0).slice(i, 1))
                ids.append(np.append(body, np.uint32(end_id)).astype(dtype))
                held += len(ids[-1])
                if len(keys) >= GROUP_DOCS or held >= GROUP_TOKENS:
                    yield from flush(keys, ids)
                    keys, ids, held = [], [], 0
        if keys:
            yield from flush(keys, ids)

    return pack


def packed_ids(docs: DataFrame, tokenizer: str, context: int = 2048, end_id: int = 0, pad_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The packed matrix, one row of ``context`` ids per result row (little-endian, ``ids_dtype``).

    ids_dtype has 16 bits where all ids of the tokenizer and the two given ones fit, else 32.
    cu_seqlens: 0 and the end of each segment; doc_ids and doc_starts: each segment's document and its first
    token there; position_ids: unsigned 16-bit (32-bit for a context over 65,536), 0 at each segment's start
    and in the padding. Null texts count as empty; each document ends with ``end_id``, so none is lost. Rows
    that repeat an id are separate documents, a null id stays null, further columns are ignored, and an
    empty table gives no rows.
    """
    if context < 1:
        raise ValueError("context must be positive")
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    dtype = "<u2" if max(vocabulary(tokenizer) - 1, end_id, pad_id) < 1 << 16 else "<u4"
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = ", ".join(f"{f} {k.format(kind)}" for f, k in zip(FIELDS, KINDS, strict=True))
    return T.mapped(rows, _packer(tokenizer, proven(tokenizer), context, end_id, pad_id, dtype), schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """Writes the matrix rows as Parquet, which every executor can do for its own rows and do again."""
    packed.write.mode("overwrite").parquet(path)
