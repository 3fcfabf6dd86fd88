"""Exact top-k by integer inner product over a bit-sliced index."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from understory.llm.text import quoted, ready

#: Vectors in one block of the index (a power of two); a block is what one step of a task holds.
BLOCK_ROWS = 1 << 15
QUERY_ROWS = 64


def quantised(vectors: Column, scale: int) -> Column:
    """floor(scale * x) of each component as double; NULL if the vector or a component is NULL or not finite."""
    whole = F.transform(vectors, lambda x: x.cast("double"))
    fine = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vectors.isNotNull() & fine, F.transform(whole, lambda x: F.floor(x * F.lit(scale)).cast("bigint")))


class BlockIndex:
    """Bit slices of a block of integer vectors: slice (j, b) has bit b of component j less its minimum, a bit a row."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, n = ids, len(ids)
        self.low = vectors.min(0)
        offset = (vectors - self.low).astype(np.uint64)
        self.bits = [int(m).bit_length() for m in offset.max(0)]
        width = -(-n // 64) * 64
        self.words = width // 64
        self.valid = self._pack(np.ones(n, bool), width)
        self.slices = [[self._pack((offset[:, j] >> np.uint64(b)) & np.uint64(1), width) for b in range(k)]
                       for j, k in enumerate(self.bits)]

    @staticmethod
    def _pack(bits: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(width, np.uint8)
        out[:len(bits)] = bits
        return np.packbits(out, bitorder="little").view(np.uint64)

    def total(self, query: np.ndarray) -> tuple[int, list[np.ndarray]]:
        """Inner products of all rows as a constant and the bit slices of the rest, least significant first.

        A component with a negative weight enters by its complement, so that only sums of slices are needed; slices of
        the same place value are added three to two (sum and carry) until one is left of each.
        """
        constant, places = 0, {}
        for j, q in enumerate(query.tolist()):
            constant += q * int(self.low[j])
            if not self.bits[j]:
                continue
            if q < 0:
                constant += q * ((1 << self.bits[j]) - 1)
            for c in range(abs(q).bit_length()):
                if abs(q) >> c & 1:
                    for b, s in enumerate(self.slices[j]):
                        places.setdefault(b + c, []).append(~s if q < 0 else s)
        out, place = [], 0
        while places:
            column = places.pop(place, [])
            while len(column) > 2:
                x, y, z = column.pop(), column.pop(), column.pop()
                half = x ^ y
                column.insert(0, half ^ z)
                places.setdefault(place + 1, []).append((x & y) | (half & z))
            if len(column) == 2:
                x, y = column
                column = [x ^ y]
                places.setdefault(place + 1, []).append(x & y)
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            place += 1
        return constant, out

    def top(self, query: np.ndarray, k: int, skip: int | None) -> list[tuple[int, int]]:
        """(id, score) of the k best rows whose id isn't skip; ties to smaller ids."""
        constant, slices = self.total(query)
        sure, open_ = np.zeros(self.words, np.uint64), self.valid.copy()
        if skip is not None:
            for r in np.flatnonzero(self.ids == skip):
                open_[r >> 6] &= ~(np.uint64(1) << np.uint64(r & 63))
        if int(np.bitwise_count(open_).sum()) > k:
            for s in reversed(slices):  # from the most significant slice downward
                more = sure | (open_ & s)
                n = int(np.bitwise_count(more).sum())
                if n > k:
                    open_ &= s
                else:
                    sure, open_ = more, open_ & ~s
                    if n == k:
                        open_[:] = 0
                        break
        rows, boundary = self._rows(sure), self._rows(open_)
        # the rows left open share one score; the smallest ids among them fill up
        boundary = boundary[np.argsort(self.ids[boundary], kind="stable")][:k - len(rows)]
        rows = np.concatenate([rows, boundary])
        scores = np.full(len(rows), constant, object)
        for b, s in enumerate(slices):
            scores = scores + [(int(s[r >> 6]) >> int(r & 63) & 1) << b for r in rows]
        return [(int(self.ids[r]), int(x)) for r, x in zip(rows, scores)]

    @staticmethod
    def _rows(bits: np.ndarray) -> np.ndarray:
        if not bits.any():
            return np.zeros(0, np.int64)
        return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id",
          vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: the k rows of largest integer inner product for each query row.

    Components become floor(scale * x). Rows are shuffled once into blocks of BLOCK_ROWS and each block is indexed by
    bit slices; queries go to every block in groups of QUERY_ROWS, so a task holds one block and one group. Each block
    gives k rows per query at most, of which the k best are kept. Vectors that are NULL, hold NULL or values that
    aren't finite, or have a NULL id take no part. A query doesn't find rows with its own id; equal ids are otherwise
    rows like any others, and equal query rows give one result. All vectors must have the same length. Other columns
    are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ready(spark)
    whole = (vectors.select(quoted(id_col).cast("bigint").alias("id"), quantised(quoted(vector_col), scale).alias("v"),
                            F.coalesce(is_query, F.lit(False)).alias("asks")).filter("id is not null and v is not null"))
    queries = whole.filter("asks").select("id", "v").distinct()
    blocks = -(-whole.count() // BLOCK_ROWS) or 1
    # few blocks: copies of them let more tasks share the queries; from one block a core on, a single copy
    copies = max(1, spark.sparkContext.defaultParallelism // blocks)

    def matrix(lists: pa.Array) -> np.ndarray:
        flat = np.asarray(lists.flatten(), np.int64)
        return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.int64)

    def grouped(batches, rows):
        ids, vecs, have = [], [], 0
        for batch in batches:
            ids.append(np.asarray(batch.column(0), np.int64))
            vecs.append(matrix(batch.column(1)))
            have += len(batch)
            while have >= rows:
                i, v = np.concatenate(ids), np.concatenate(vecs)
                yield i[:rows], v[:rows]
                ids, vecs, have = [i[rows:]], [v[rows:]], have - rows
        if have:
            yield np.concatenate(ids), np.concatenate(vecs)

    def build(batches):
        part = TaskContext.get().partitionId()
        for ids, vecs in grouped(batches, 2 * BLOCK_ROWS):  # a large partition is a block of several indexes
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([pickle.dumps(BlockIndex(ids, vecs))], pa.binary())],
                                             names=["block", "index"])

    def bundle(batches):
        part = TaskContext.get().partitionId() << 33
        for n, (ids, vecs) in enumerate(grouped(batches, QUERY_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array([part + n], pa.int64()), pa.array([pickle.dumps((ids, vecs))], pa.binary())],
                                             names=["bundle", "queries"])

    def search(batches):
        for batch in batches:
            for bundle_id, asked, index in zip(*(c.to_pylist() for c in batch.columns)):
                index, (ids, vecs) = pickle.loads(index), pickle.loads(asked)
                found = [(bundle_id, n, int(q), *hit) for n, (q, v) in enumerate(zip(ids, vecs)) for hit in index.top(v, k, int(q))]
                columns = list(zip(*found)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 names=["bundle", "place", "query_id", "id", "score"])

    indexed = (whole.select("id", "v").repartition(blocks).mapInArrow(build, "block bigint, index binary")
               .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))))
    asked = (queries.mapInArrow(bundle, "bundle bigint, queries binary")
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<bigint>")))
             .withColumn("copy", F.pmod(F.xxhash64("bundle"), F.lit(copies)).cast("int")))
    hits = (asked.join(indexed, ["block", "copy"]).select("bundle", "queries", "index")
            .mapInArrow(search, "bundle bigint, place bigint, query_id bigint, id bigint, score bigint"))
    best = Window.partitionBy("bundle", "place").orderBy(F.col("score").desc(), "id")
    return (hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"))
