"""Quality classifier: a factorisation machine over hashed words, structure statistics and size."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.llm.text import SpanHasher, kept, pick, ready, text_runs, utf8, word_spans

BUCKETS = 4096
_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_CLASSES = {
    "upper": lambda b: 65 <= b <= 90, "lower": lambda b: 97 <= b <= 122, "digit": lambda b: 48 <= b <= 57,
    "stop": lambda b: b in b".,;:?", "mark": lambda b: b in b"!#$%&*+/<=>@\\^_`|~", "other": lambda b: b in b"\"'()-[]{}",
    "high": lambda b: b >= 128, "line": lambda b: b == 10, "blank": lambda b: b == 32,
}
_TABLES = [np.array([bool(f(b)) for b in range(256)]) for f in _CLASSES.values()]
#: Shares of byte classes, then shares over words, then sizes.
STATISTICS = (*_CLASSES, "distinct words", "repeats of the word before", "words without a letter", "mean word length",
              "long words", "log bytes", "log words", "words a line")
WIDTH = BUCKETS + len(STATISTICS)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: the first entry of each text (one more than there are texts), column numbers, values."""
    data, offsets = utf8(texts)
    n = len(texts)
    starts, ends, first = word_spans(data, offsets, ~_SPACE)
    owner = np.repeat(np.arange(n), np.diff(first))
    hashes = SpanHasher(data, lower=True)(starts, ends)
    bucket = (hashes % np.uint64(BUCKETS)).astype(np.int64)
    keys, times = np.unique(owner * BUCKETS + bucket, return_counts=True)
    row, col = keys // BUCKETS, keys % BUCKETS
    value = np.log1p(times)
    norm = np.sqrt(np.bincount(row, value * value, n))
    value = value / np.maximum(norm, 1e-9)[row]

    size, words = np.diff(offsets), np.diff(first)
    stats = np.zeros((n, len(STATISTICS)))
    for k, table in enumerate(_TABLES):
        sums = np.concatenate([[0], np.cumsum(table[data])])
        stats[:, k] = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1)
    k = len(_TABLES)
    w = np.maximum(words, 1)
    stats[:, k] = np.bincount(_distinct(owner, hashes), minlength=n) / w
    same = np.flatnonzero((hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1]))
    stats[:, k + 1] = np.bincount(owner[same], minlength=n) / w
    letters = np.concatenate([[0], np.cumsum(_TABLES[0][data] | _TABLES[1][data] | _TABLES[6][data])])
    stats[:, k + 2] = np.bincount(owner[letters[ends] == letters[starts]], minlength=n) / w
    length = ends - starts
    stats[:, k + 3] = np.bincount(owner, length, n) / w / 20
    stats[:, k + 4] = np.bincount(owner[length > 20], minlength=n) / w
    stats[:, k + 5] = np.log1p(size) / 12
    stats[:, k + 6] = np.log1p(words) / 10
    stats[:, k + 7] = np.log1p(words / (1 + stats[:, 7] * size)) / 6

    counts = np.bincount(row, minlength=n)
    begin = np.concatenate([[0], np.cumsum(counts + len(STATISTICS))])
    cols, vals = np.zeros(begin[-1], np.int64), np.zeros(begin[-1])
    at = np.arange(len(row)) + row * len(STATISTICS)
    cols[at], vals[at] = col, value
    tail = (begin[1:, None] - len(STATISTICS) + np.arange(len(STATISTICS))).ravel()
    cols[tail], vals[tail] = np.tile(BUCKETS + np.arange(len(STATISTICS)), n), stats.ravel()
    return begin, cols, vals


def _distinct(owner: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Owners of the distinct (owner, hash) pairs."""
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    keep = np.ones(len(o), bool)
    keep[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    return o[keep]


@dataclass
class FactorisationMachine:
    """score = sigmoid(w0 + w.x + sum over factors f of ((v_f.x)^2 - (v_f^2).(x^2)) / 2), linear in the entries of x."""
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, factors: int = 8, epochs: int = 15, rate: float = 0.02, decay: float = 1e-4,
            seed: int = 7) -> FactorisationMachine:
        """Adam on the log loss of dense rows; the caller bounds their number. Without both labels: a constant."""
        share = (y.sum() + 1) / (len(y) + 2)
        mean, scale = np.zeros(WIDTH, np.float32), np.ones(WIDTH, np.float32)
        model = cls(float(np.log(share / (1 - share))), np.zeros(WIDTH, np.float32), np.zeros((WIDTH, factors), np.float32), mean, scale)
        if len(set(y.tolist())) < 2:
            return model
        mean[BUCKETS:], scale[BUCKETS:] = x[:, BUCKETS:].mean(0), x[:, BUCKETS:].std(0) + 1e-3
        x = ((x - mean) / scale).clip(-5, 5).astype(np.float32)
        rng = np.random.default_rng(seed)
        params = [np.array([model.w0], np.float32), model.w, rng.normal(0, 0.02, model.v.shape).astype(np.float32)]
        first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for part in np.array_split(order, max(1, len(y) // 256)):
                xb, yb = x[part], y[part]
                xv = xb @ params[2]
                x2 = xb * xb
                z = params[0] + xb @ params[1] + 0.5 * ((xv * xv).sum(1) - x2 @ (params[2] * params[2]).sum(1))
                g = ((1 / (1 + np.exp(-z.clip(-30, 30))) - yb) / len(yb)).astype(np.float32)
                gx = g @ xb
                gv = (xb * g[:, None]).T @ xv - (g @ x2)[:, None] * params[2]
                t += 1
                for k, grad in enumerate((np.array([g.sum()], np.float32), gx + decay * params[1], gv + decay * params[2])):
                    first[k] = 0.9 * first[k] + 0.1 * grad
                    second[k] = 0.999 * second[k] + 0.001 * grad * grad
                    params[k] = params[k] - rate * (first[k] / (1 - 0.9 ** t)) / (np.sqrt(second[k] / (1 - 0.999 ** t)) + 1e-8)
        return cls(float(params[0][0]), params[1], params[2], mean, scale)

    def score(self, begin: np.ndarray, cols: np.ndarray, vals: np.ndarray) -> np.ndarray:
        """Probabilities of sparse rows; every row has its statistics, so none is without an entry."""
        if len(begin) < 2:
            return np.zeros(0)
        x = ((vals - self.mean[cols]) / self.scale[cols]).clip(-5, 5).astype(np.float32)
        linear = np.add.reduceat(x * self.w[cols], begin[:-1])
        pair = np.zeros(len(begin) - 1)
        for f in range(self.v.shape[1]):
            vx = self.v[cols, f] * x
            pair += np.add.reduceat(vx, begin[:-1]) ** 2 - np.add.reduceat(vx * vx, begin[:-1])
        return 1 / (1 + np.exp(-(self.w0 + linear + 0.5 * pair).clip(-30, 30)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          max_rows: int = 4000, **fit) -> FactorisationMachine:
    """Fit on at most max_rows labelled rows, those with the smallest hash of their id, on the driver.

    The bound holds whatever the size of the tables: the rows' feature vectors have at most WIDTH entries. Labels
    other than 0 and 1, labels without a text row, and NULL ids are left out; a repeated label counts once, and of texts
    with the same id each counts. No label at all gives the constant 1/2.
    """
    ready(docs.sparkSession)
    chosen = (pick(labels, id=id_col, y=label_col).filter(F.col("id").isNotNull() & F.col("y").isin(0, 1))
              .groupBy("id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(max_rows))
    rows = pick(docs, id=id_col, text=text_col).join(F.broadcast(chosen), "id")

    def run(batches):
        kept("scores")
        for batch in batches:
            for start, end, texts in text_runs(batch.column(0)):
                begin, cols, vals = features(texts)
                rows = [(cols[a:b].astype("<u2").tobytes(), vals[a:b].astype("<f4").tobytes()) for a, b in zip(begin, begin[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()),
                     batch.column(1).slice(start, end - start).cast(pa.int32())], names=["cols", "vals", "y"])

    got = (rows.select("text", F.col("y").cast("int")).mapInArrow(run, "cols binary, vals binary, y int")
           .limit(2 * max_rows).collect())
    x, y = np.zeros((len(got), WIDTH), np.float32), np.array([r.y for r in got], np.float32)
    order = sorted(range(len(got)), key=lambda k: (bytes(got[k].cols), bytes(got[k].vals)))  # the same fit each time
    for at, k in enumerate(order):
        x[at, np.frombuffer(got[k].cols, "<u2")] = np.frombuffer(got[k].vals, "<f4")
    return FactorisationMachine.fit(x, y[order], **fit)


def score_quality(docs: DataFrame, model: FactorisationMachine, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with one more column: the probability (0 to 1) that a text is good, from the text alone.

    NULL and empty texts are scored by their statistics; whole texts of any length count; all columns and rows are
    kept as they are. A column that is named like the new one is replaced.
    """
    ready(docs.sparkSession)
    docs = docs.drop(out)
    at = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH times (factors + 3) numbers

    def run(batches):
        kept("scores")
        for batch in batches:
            parts = [shared.value.score(*features(t)) for _, _, t in text_runs(batch.column(at))]
            scores = pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, {out} double")
