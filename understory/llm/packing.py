"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from understory.llm.text import quoted, ready
from understory.llm.tokens import encoded_runs

PIECE_SCHEMA = ("id {id}, start bigint, length bigint, ids binary, loss_tokens bigint, doc_tokens bigint, "
                "sequence_id bigint, offset bigint")


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold at most."""
    tokens: int = 4096
    segments: int = 1024
    loss_tokens: int = 4096


class Packer:
    """Packs a stream of documents with a bounded pool of waiting ones.

    The open sequence takes, again and again, the waiting document whose demand vector (tokens, one segment,
    loss-bearing tokens; as shares of the limits) has the largest dot product with what is left of the sequence,
    among those that fit. If none fits whole, the document with the largest dot product is cut so that its head fills
    the sequence; the rest waits on. Ties go to the document that came first.
    """

    def __init__(self, limits: Limits, pool: int):
        self.limits, self.size = limits, pool
        self.caps = np.array([limits.tokens, limits.segments, limits.loss_tokens], np.float64)
        self.docs: list[tuple | None] = [None] * pool
        self.left = np.zeros((pool, 3))        # demand of what waits in each slot
        self.arrived = np.full(pool, np.inf)
        self.free = list(range(pool))
        self.clock = 0
        self.open: list[tuple] = []            # (document, first, end) of the open sequence
        self.room = self.caps.copy()

    def _loss(self, doc: tuple, first: int, end: int) -> int:
        return max(0, end - max(first, doc[2]))

    def add(self, doc: tuple) -> Iterator[list]:
        """doc: (id, ids, position of its first loss-bearing id)."""
        if not self.free:
            yield from self._place_one()
        slot = self.free.pop()
        self.docs[slot] = (doc, 0)
        self.left[slot] = len(doc[1]), 1, self._loss(doc, 0, len(doc[1]))
        self.arrived[slot], self.clock = self.clock, self.clock + 1

    def finish(self) -> Iterator[list]:
        while len(self.free) < self.size:
            yield from self._place_one()
        yield from self._seal()

    def _place_one(self) -> Iterator[list]:
        """Place pieces until one waiting document is used up."""
        while True:
            waits = np.isfinite(self.arrived)
            gain = np.where(waits, (self.left / self.caps) @ (self.room / self.caps), -1.0)
            fits = waits & (self.left <= self.room).all(1)
            among = np.where(fits, gain, -1.0) if fits.any() else gain
            best = np.flatnonzero(among == among.max())
            slot = int(best[np.argmin(self.arrived[best])])
            doc, first = self.docs[slot]
            end = len(doc[1]) if fits[slot] else self._cut(doc, first)
            if end > first:
                self.open.append((doc, first, end))
                self.room -= (end - first, 1, self._loss(doc, first, end))
            done = end == len(doc[1])
            if done:
                self.docs[slot], self.arrived[slot], self.left[slot] = None, np.inf, 0
                self.free.append(slot)
            else:
                self.docs[slot] = (doc, end)
                self.left[slot] = len(doc[1]) - end, 1, self._loss(doc, end, len(doc[1]))
            if not done or self.room[0] < 1 or self.room[1] < 1:
                yield from self._seal()
            if done:
                return

    def _cut(self, doc: tuple, first: int) -> int:
        """How far the document goes into the room that is left."""
        tokens, segments, loss = self.room
        if segments < 1:
            return first
        free_of_loss = max(0, doc[2] - first)
        return min(first + int(tokens), first + free_of_loss + int(loss), len(doc[1]))

    def _seal(self) -> Iterator[list]:
        """Close the open sequence. One that isn't full is cut into powers of two, which need no padding."""
        total = sum(b - a for _, a, b in self.open)
        sizes = [self.limits.tokens] if total == self.limits.tokens else [1 << k for k in range(62, -1, -1) if total >> k & 1]
        queue, self.open, self.room = self.open[::-1], [], self.caps.copy()
        for size in sizes:
            sequence, offset = [], 0
            while offset < size:
                doc, first, end = queue.pop()
                stop = min(end, first + size - offset)
                sequence.append((doc, first, stop, offset))
                offset += stop - first
                if stop < end:
                    queue.append((doc, stop, end))
            yield sequence


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), end_id: int | None = None, id_col: str = "doc_id",
         text_col: str = "text", loss_start: Column | None = None, pool: int = 512) -> DataFrame:
    """Pack every document's ids into sequences; one row per piece.

    Columns: id, start (ids of the document before the piece), length, ids (little-endian unsigned 32-bit),
    loss_tokens, doc_tokens, sequence_id, offset (place in the sequence, gapless from 0). end_id, if given, follows each
    document's ids. loss_start: position of a document's first loss-bearing id (a prompt's length); default 0.

    Every partition of docs packs its own rows as they stream by, with at most `pool` documents waiting, so nothing is
    shuffled and memory is bounded whatever the size or skew of the table. A sequence that is not filled to
    limits.tokens (the last of a partition, or one whose segments or loss-bearing tokens are used up) is cut into
    sequences of a power of two of ids, so no padding arises. NULL text is empty; a document without any id gives no
    row. Ids may be NULL or repeated. Other columns are left out. sequence_id holds the partition in its upper bits.
    """
    if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
        raise ValueError("limits must be positive")
    ready(docs.sparkSession)
    id_kind = next(f.dataType for f in docs.schema.fields if f.name == id_col)
    id_type, arrow_id = id_kind.simpleString(), to_arrow_type(id_kind)
    rows = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"),
                       F.greatest(F.coalesce((loss_start if loss_start is not None else F.lit(0)).cast("bigint"), F.lit(0)),
                                  F.lit(0)).alias("loss_start"))
    tail = [] if end_id is None else [end_id]

    def run(batches):
        high = TaskContext.get().partitionId() << 33
        packer, out, sequences = Packer(limits, pool), _Out(), 0
        for batch in batches:
            ids, starts = batch.column(0), batch.column(2)
            for start, end, flat, counts in encoded_runs(batch.column(1), tokenizer, 2 << 20):
                at = 0
                for k, n in enumerate(counts.tolist(), start):
                    doc_ids = np.append(flat[at:at + n], tail).astype("<u4")
                    at += n
                    if not len(doc_ids):
                        continue
                    for sequence in packer.add((ids[k].as_py(), doc_ids, starts[k].as_py())):
                        out.add(sequence, high + sequences)
                        sequences += 1
                if out.bytes > 4 << 20:
                    yield out.take()
        for sequence in packer.finish():
            out.add(sequence, high + sequences)
            sequences += 1
            if out.bytes > 4 << 20:
                yield out.take()
        yield out.take()

    class _Out:
        """Rows not handed on yet."""

        def __init__(self):
            self.rows, self.bytes = [], 0

        def add(self, sequence, sequence_id):
            for doc, first, end, offset in sequence:
                loss = max(0, end - max(first, doc[2]))
                self.rows.append((doc[0], first, end - first, doc[1][first:end].tobytes(), loss, len(doc[1]), sequence_id, offset))
                self.bytes += 4 * (end - first) + 64

        def take(self):
            columns = list(zip(*self.rows)) or [()] * 8
            self.rows, self.bytes = [], 0
            kinds = [arrow_id, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                              names=["id", "start", "length", "ids", "loss_tokens", "doc_tokens", "sequence_id", "offset"])

    return rows.mapInArrow(run, PIECE_SCHEMA.format(id=id_type))
