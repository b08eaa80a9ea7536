"""Token-ID output: documents packed into rows of a fixed length by best-fit decreasing, with a segment tree over capacities.

Documents longer than a row are split into pieces, losslessly. Pieces are placed from the longest on, each into the open
row with the least room that still takes it; a segment tree over capacities finds that row in a logarithm of the length.
Every task packs its own documents in buffers of ``BUFFER_TOKENS`` ids, so nothing is shuffled and memory is bounded.

A row holds its padded ids and the position of each id in its piece as little-endian 16-bit numbers (a row of the packed
matrices), the cumulative lengths of its segments, and where each segment came from: document, offset in it, length.

Null and empty texts have no ids and stand in no row; a text without an id is packed, its segments' document is null.
Repeated rows are packed each. Ties of length go by order of arrival. A very long text is held whole once, as any row of a
table is, fills rows of its own and leaves one remainder; buffers are emptied behind it. An empty table gives no rows; other
columns are not read. Row ids are unique in a run; the same input split alike gives the same rows. Vocabularies of more than
65,536 ids are refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.llm.bpe import _codec, _shipped, default_path
from streamloom.llm.common import column, map_arrow, slices, table

ROW_TOKENS, BUFFER_TOKENS, PAD = 2048, 2 << 20, 49407
SEGMENTS = "array<struct<doc_id:bigint,offset:bigint,length:int>>"


class CapacityTree:
    """How many open rows have each capacity from 0 to ``most``; finds the least capacity that is enough."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        node = capacity + self.leaves
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (capacity, row) of the fullest row with room for ``need``; None if there is none."""
        count, node = self.count, need + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1  # up until there is something on the right
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        while node:
            count[node] -= 1
            node >>= 1
        return capacity, self.rows[capacity].pop()


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Which pieces stand in each row, in order of placing. No length may be above ``most`` or below 1."""
    tree, rows = CapacityTree(most), []
    for k in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = tree.take(lengths[k])
        room, row = found if found else (most, len(rows))
        if not found:
            rows.append([])
        rows[row].append(k)
        if room > lengths[k]:
            tree.add(room - lengths[k], row)
    return rows


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, row_tokens: int = ROW_TOKENS, pad: int = PAD) -> DataFrame:
    """(row_id, n_tokens, n_segments, ids binary, positions binary, cu_seqlens array<int>, segments) of all documents."""
    if row_tokens > 1 << 16 or not 0 <= pad < 1 << 16:
        raise ValueError("ids and positions are 16-bit numbers")
    spec = _shipped(df.sparkSession, path or default_path())
    segment = pa.list_(pa.struct([("doc_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int32())]))
    names = ["row_id", "n_tokens", "n_segments", "ids", "positions", "cu_seqlens", "segments"]
    place = np.arange(row_tokens, dtype="<u2")

    def packed(pieces: list[tuple], first: int) -> pa.RecordBatch:
        out: list[list] = [[] for _ in names]
        for n, members in enumerate(best_fit([len(p[2]) for p in pieces], row_tokens)):
            row = [pieces[k] for k in members]
            ends = np.cumsum([len(p[2]) for p in row])
            ids, positions = np.full(row_tokens, pad, "<u2"), np.zeros(row_tokens, "<u2")
            ids[: ends[-1]] = np.concatenate([p[2] for p in row])
            positions[: ends[-1]] = np.concatenate([place[: len(p[2])] for p in row])
            values = (first + n, int(ends[-1]), len(row), ids.tobytes(), positions.tobytes(), [0, *ends.tolist()], [{"doc_id": p[0], "offset": p[1], "length": len(p[2])} for p in row])
            for c, v in zip(out, values, strict=True):
                c.append(v)
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), segment]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, made, held, pieces = _codec(spec.value), TaskContext.get().partitionId() << 32, 0, []
        if max(codec.token_of) >= 1 << 16:
            raise ValueError("a vocabulary of more than 65,536 ids does not fit into 16-bit numbers")
        for b in slices(batches, "text"):
            encoded = codec.encode_all(column(b, "text"))
            for doc, ids in zip(column(b, "id").to_pylist(), encoded, strict=True):
                ids = ids.astype("<u2")
                for at in range(0, len(ids), row_tokens):
                    pieces.append((doc, at, ids[at : at + row_tokens]))
                held += len(ids)
                if held >= BUFFER_TOKENS:
                    batch = packed(pieces, made)
                    made, held, pieces = made + batch.num_rows, 0, []
                    yield batch
        if pieces:
            yield packed(pieces, made)

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return map_arrow(rows, run, f"row_id long, n_tokens int, n_segments int, ids binary, positions binary, cu_seqlens array<int>, segments {SEGMENTS}")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
