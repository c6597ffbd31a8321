"""Packing by the sum-of-squares rule: token sequences of at most ``window`` ids with almost no padding.

Each task packs the documents of its own partition, in order, so nothing is shuffled and no task grows with
the corpus. A level array counts the open windows at each fill level. A document's full windows are cut off
first; its rest goes where the sum of the squared counts becomes smallest (a tie goes to the fullest level).
At the end of the partition the open windows are joined and cut anew into full windows, and what is left
over into powers of two, which need no padding.

Sequence ids hold the partition in their upper bits. Null texts are empty, so a document has at least its end
id; repeated rows and ids are separate documents; an empty table gives no pieces. Columns besides ``doc_id``
and ``text`` are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signflow.llm.common import WordBpe, encoder, prepare, texts_of

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
#: A piece: doc_id, start, ids, doc_tokens.
Piece = tuple


class SumOfSquares:
    """Online packing of pieces into windows; ``open`` holds the windows by fill level."""

    def __init__(self, window: int):
        self.window = window
        self.level = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list[Piece]]] = {}

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece of fewer than ``window`` ids into a window; gives the window back once it is full."""
        n = len(piece[2])
        change = self.level[n:] - self.level[: self.window + 1 - n]  # half the change of the sum, less one, from each level on
        change[0] = 2 * self.level[n] - 1  # a new window leaves no level; twice the scale and one less, as below
        change[1:] *= 2
        change[-1] -= 1  # a window that becomes full enters none
        empty = self.level[: self.window + 1 - n] == 0
        empty[0] = False
        change[empty] = np.iinfo(np.int64).max
        at = len(change) - 1 - int(np.argmin(change[::-1]))
        held = []
        if at:
            held = self.open[at].pop()
            self.level[at] -= 1
        held.append(piece)
        if at + n == self.window:
            return held
        self.level[at + n] += 1
        self.open.setdefault(at + n, []).append(held)
        return None

    def rest(self) -> list[list[Piece]]:
        """The open windows' pieces in full windows and powers of two."""
        out, held = [], []
        left = sum(k * int(n) for k, n in enumerate(self.level))
        room = self.window if left >= self.window else 1 << max(left, 1).bit_length() - 1
        for level in sorted(self.open, reverse=True):
            for window in self.open[level]:
                for doc, start, ids, total in window:
                    while len(ids):
                        part, ids = ids[:room], ids[room:]
                        held.append((doc, start, part, total))
                        start, room, left = start + len(part), room - len(part), left - len(part)
                        if not room:
                            out.append(held)
                            held = []
                            room = self.window if left >= self.window else 1 << max(left, 1).bit_length() - 1
        return out


def pack(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """The pieces of all documents: ids ``start`` to ``start + length`` of a document stand at ``offset`` of a sequence."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(WordBpe, tokenizer), SumOfSquares(window)
        base, done = TaskContext.get().partitionId() << 32, 0
        rows: list[tuple] = []

        def close(held: list[Piece]) -> None:
            nonlocal done
            at = 0
            for doc, start, ids, total in held:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, base + done, at))
                at += len(ids)
            done += 1

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")])

        for b in batches:
            for doc, raw in zip(b.column("doc_id").to_pylist(), encode.texts(texts_of(b)), strict=True):
                ids = np.frombuffer(raw + end, "<u4")
                cut = len(ids) // window * window
                for k in range(0, cut, window):
                    close([(doc, k, ids[k : k + window], len(ids))])
                if cut < len(ids) and (full := packer.place((doc, cut, ids[cut:].copy(), len(ids)))):
                    close(full)
            if rows:
                yield flush()
        for held in packer.rest():
            close(held)
        if rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, PIECES)
