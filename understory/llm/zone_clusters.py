"""Centroid clustering in exact integers over zone-mapped blocks of a space-filling curve."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from understory.llm.text import quoted, ready
from understory.session import stored

#: Vectors of one block; a block carries the least and greatest value of each component.
BLOCK_ROWS = 128
#: The curve runs through the AXES directions in which the sample spreads most, CURVE_BITS bits each (63 at most in all).
AXES, CURVE_BITS = 6, 10
#: Vectors that the directions are learnt from, those of least hash. They set the order of rows only, no result.
SAMPLE_ROWS = 2048
#: Components beyond this can't be squared and summed exactly in 64 bits.
COMPONENT_LIMIT = 1 << 26
_DOUBLE_LIMIT = 1 << 22  # below it every term is a whole number that a double holds

BLOCK_SCHEMA = "n int, ids binary, no_id binary, vectors binary, low binary, high binary"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of whole-number points (rows) on the Hilbert curve: gray-coded bits of all axes, undone axis by axis."""
    x = points.astype(np.int64).T.copy()
    axes = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(axes):
            flip = (x[i] & q) != 0
            t = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            out = out << 1 | (x[i] >> b & 1)
    return out


class Curve:
    """Directions of greatest spread of a sample, and the range of each."""

    def __init__(self, sample: np.ndarray):
        axes = min(AXES, sample.shape[1])
        self.mean = sample.mean(0)
        centred = sample - self.mean
        self.directions = np.linalg.svd(centred, full_matrices=False)[2][:axes].T
        at = centred @ self.directions
        self.low, self.span = at.min(0), np.maximum(np.ptp(at, axis=0), 1e-9)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        cells = ((vectors - self.mean) @ self.directions - self.low) / self.span * (1 << CURVE_BITS)
        return hilbert(np.clip(cells, 0, (1 << CURVE_BITS) - 1).astype(np.int64), CURVE_BITS)


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to some vector of the box.

    A centroid is out if all of the box is nearer to the one that is nearest to its middle. The difference of the two squared
    distances is linear in the vector, so its least value in the box is found exactly, component by component.
    """
    middle = low + high  # of a box twice as large
    nearest_to_middle = ((2 * centroids - middle) ** 2).sum(1).argmin()
    apart = centroids - centroids[nearest_to_middle]
    norms = (centroids * centroids).sum(1)
    least = norms - norms[nearest_to_middle] - 2 * np.maximum(apart * low, apart * high).sum(1)
    return np.flatnonzero(least <= 0)


def nearest(vectors: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of `among` (ascending); ties go to the smaller number."""
    near = centroids[among]
    kind = np.float64 if max(np.abs(vectors).max(initial=0), np.abs(near).max(initial=0)) < _DOUBLE_LIMIT else np.int64
    v, c = vectors.astype(kind), near.astype(kind)
    distance = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)
    best = distance.argmin(1)
    return among[best], distance[np.arange(len(v)), best].astype(np.int64)


def scaled(vectors: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component as double; NULL unless there are `dims` components, all of them finite."""
    whole = F.transform(vectors, lambda x: x.cast("double"))
    fine = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    at = F.transform(whole, lambda x: F.floor(x * F.lit(float(scale))))
    inside = F.forall(at, lambda x: F.abs(x) < F.lit(COMPONENT_LIMIT))
    far = F.raise_error(F.lit(f"a component is beyond {COMPONENT_LIMIT} / {scale}")).cast("array<int>")
    return F.when((F.size(vectors) == dims) & fine, F.when(inside, at.cast("array<int>")).otherwise(far))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(lists.flatten(), np.int32).reshape(-1, dims)


def _blocks(dims: int):
    """Rows in curve order to blocks with their boxes; an incomplete block ends each partition."""
    def packed(ids, no_id, vectors):
        return [len(ids), ids.astype("<i8").tobytes(), np.packbits(no_id).tobytes(), vectors.astype("<i4").tobytes(),
                vectors.min(0).astype("<i4").tobytes(), vectors.max(0).astype("<i4").tobytes()]

    def build(batches):
        rest, out = None, []
        for batch in batches:
            part = (np.asarray(batch["id"].fill_null(0), np.int64), np.asarray(batch["id"].is_null()).astype(bool), _matrix(batch["v"], dims))
            if rest is not None:
                part = tuple(np.concatenate(pair) for pair in zip(rest, part))
            whole = len(part[0]) // BLOCK_ROWS * BLOCK_ROWS
            for k in range(0, whole, BLOCK_ROWS):
                out.append(packed(*[x[k:k + BLOCK_ROWS] for x in part]))
            rest = tuple(x[whole:] for x in part)
            if out:
                yield _batch(out)
                out = []
        if rest is not None and len(rest[0]):
            yield _batch([packed(*rest)])

    def _batch(rows):
        n, *binaries = zip(*rows)
        names = ["n", "ids", "no_id", "vectors", "low", "high"]
        return pa.RecordBatch.from_arrays([pa.array(n, pa.int32()), *[pa.array(b, pa.binary()) for b in binaries]], names=names)

    return build


def _opened(batches, dims: int, centroids: np.ndarray):
    """Each block's rows with the nearest centroid and distance, by the block's candidates only."""
    for batch in batches:
        for n, ids, no_id, vectors, low, high in zip(*(batch[c].to_pylist() for c in ("n", "ids", "no_id", "vectors", "low", "high"))):
            box = [np.frombuffer(x, "<i4").astype(np.int64) for x in (low, high)]
            among = candidates(*box, centroids)
            rows = np.frombuffer(vectors, "<i4").reshape(n, dims).astype(np.int64)
            yield ids, no_id, rows, *nearest(rows, centroids, among), len(among)


def _sums(dims: int, centroids: np.ndarray):
    """Per task: rows, sum of each component, for every centroid that has rows here."""
    def run(batches):
        count, total = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), dims), np.int64)
        for _, _, rows, cluster, _, _ in _opened(batches, dims, centroids):
            np.add.at(total, cluster, rows)
            count += np.bincount(cluster, minlength=len(count))
        used = np.flatnonzero(count)
        place = np.tile(np.arange(dims + 1), len(used))
        value = np.concatenate([count[used, None], total[used]], 1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(used, dims + 1), pa.int32()), pa.array(place, pa.int32()), pa.array(value, pa.int64())],
                                         names=["cluster", "place", "value"])
    return run


def _assigned(dims: int, centroids: np.ndarray):
    def run(batches):
        for ids, no_id, rows, cluster, distance, _ in _opened(batches, dims, centroids):
            missing = np.unpackbits(np.frombuffer(no_id, np.uint8))[:len(rows)].astype(bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, "<i8"), mask=missing), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                                             names=["id", "cluster", "distance"])
    return run


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: str = "2:",
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every kept vector, all in exact integers.

    Kept are vectors of exactly `dims` components, none NULL or not finite; a component becomes floor(scale * x), an error
    beyond COMPONENT_LIMIT. Centroids start as the k vectors of least SHA-256 of seed and id (then by content; NULL ids
    last; all, if fewer). In each round every vector goes to the nearest centroid, ties to the smaller number, and each
    centroid with vectors becomes the floor of their mean.

    Rows are sorted once along a Hilbert curve, ranges of the curve dealt to tasks by Spark (equal vectors by their ids, so
    a frequent one is spread), and written in blocks with their boxes. A round is one pass over the blocks: box bounds
    leave few centroids, which all rows of the block are compared with exactly; only k * (dims + 1) sums reach the driver.

    Repeated rows and ids count like any others. Other columns are left out; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ready(spark)
    kept = (vectors.select(quoted(id_col).cast("bigint").alias("id"), scaled(quoted(vector_col), dims, scale).alias("v"))
            .filter("v is not null"))
    drawn = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    sample = kept.orderBy(drawn.asc_nulls_last(), "v").limit(max(k, SAMPLE_ROWS)).collect()
    if not sample:
        return spark.createDataFrame([], _RESULT)
    sample = np.array([r.v for r in sample], np.int64)
    centroids, curve = sample[:k].copy(), Curve(sample.astype(np.float64))

    def placed(batches):
        for batch in batches:
            at = curve.place(_matrix(batch["v"], dims).astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(at), batch["id"], batch["v"]], names=["place", "id", "v"])

    along = (kept.mapInArrow(placed, "place bigint, id bigint, v array<int>").repartitionByRange("place", F.xxhash64("id", "v"))
             .sortWithinPartitions("place", "v"))
    blocks = stored(along.mapInArrow(_blocks(dims), BLOCK_SCHEMA), "blocks")

    for _ in range(rounds):
        sums = blocks.mapInArrow(_sums(dims, centroids), "cluster int, place int, value bigint")
        found = {}
        for r in sums.groupBy("cluster", "place").agg(F.sum("value").alias("value")).collect():  # k * (dims + 1) at most
            found.setdefault(r.cluster, {})[r.place] = r.value
        for number, values in found.items():
            centroids[number] = [values[j + 1] // values[0] for j in range(dims)]

    rows = stored(blocks.mapInArrow(_assigned(dims, centroids), "id bigint, cluster int, distance bigint"), "assigned")
    per_cluster = {r.cluster: r.total for r in rows.groupBy("cluster").agg(F.sum("distance").alias("total")).collect()}
    total = sum(per_cluster.values())
    digest = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in per_cluster}
    table = spark.createDataFrame([(c, per_cluster[c], total, digest[c]) for c in per_cluster],
                                  "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return rows.join(F.broadcast(table), "cluster").select(*_COLUMNS)  # k rows at most


_COLUMNS = ("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
_RESULT = "id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
