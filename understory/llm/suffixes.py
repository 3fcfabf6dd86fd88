"""Repeated byte strings across documents: suffix arrays per shard, merged across shards.

A document position is covered if the `length` bytes from it also start in a document with a smaller id. Within a shard
(a run of documents) a suffix array, sorted to that depth, tells this for every position. Across shards only a few
positions need to be compared: every string of `length` bytes holds an anchor, the smallest hash among its GRAM-byte
grams, and equal strings have equal anchors. Four exchanges narrow down what is sent, each a sorted key list per shard
that is merged with the other shards' in ranges of keys:

1. anchors: which occur in another shard at all;
2. contexts of those (all bytes that any string around the anchor can reach): a context that another shard has in a
   smaller document covers all strings around it;
3. for the contexts left: the bytes that all strings in a part of the places around the anchor have in common;
4. where another shard left open has these too: the single strings.

Anchors are found once and kept beside the shard's texts.

A shard sends each key once, with its smallest document id, so a passage that fills a third of the corpus is one row a
shard. Answers are a bit a key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.llm.text import SpanHasher, mixed, quoted, ready, text_runs, utf8, window_min
from understory.session import scratch_path

GRAM = 20
#: The places of strings around an anchor are told apart in so many parts before single strings are.
PARTS = 4
ROUNDS = 4
SHARD_BYTES = 1 << 20
#: Text bytes for each range of keys; sets how many ranges, so a merging task's size stays the same as data grows.
RANGE_BYTES = 8 << 20
_U = np.uint64


# ---- suffix arrays

def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number that sorts as they do; zeros behind the end."""
    out = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        out = (out[:-k] << _U(8 * k)) | out[k:]
    return out


def suffix_array(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by their first `depth` bytes (8 or more), and ranks that are equal for equal ones.

    Larsson and Sadakane's refinement: after a first sort by eight bytes, each round doubles the sorted depth by sorting
    the members of unsorted groups by the rank of the position one depth further; groups of one are left alone. The
    last round goes only as far as `depth`.
    """
    n = len(data)
    key = eight_bytes(data)
    order = np.argsort(key)
    rank = _ranks(order, key[order])
    h = 8
    while h < depth:
        step = min(h, depth - h)
        sizes = np.bincount(rank, minlength=n)
        slots = np.flatnonzero(sizes[rank[order]] > 1)  # places of the array that aren't settled
        if not len(slots):
            break
        members = order[slots]
        further = members + step
        behind = np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        again = np.argsort(rank[members].astype(np.uint64) << _U(32) | behind.astype(np.uint64))
        members, behind = members[again], behind[again]
        order[slots] = members
        rank = _refined(rank, members, behind, slots)
        h += step
    return order, rank


def _ranks(order, key):
    rank, starts = np.zeros(len(order), np.int64), np.ones(len(order), bool)
    starts[1:] = key[1:] != key[:-1]
    rank[order] = np.flatnonzero(starts)[np.cumsum(starts) - 1]
    return rank


def _refined(rank, members, behind, slots):
    """New ranks: a group's first place in the array."""
    old = rank[members]
    starts = np.ones(len(members), bool)
    starts[1:] = (old[1:] != old[:-1]) | (behind[1:] != behind[:-1])
    out = rank.copy()
    out[members] = slots[np.flatnonzero(starts)[np.cumsum(starts) - 1]]
    return out


def common_prefixes(data: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Bytes that each suffix of the array shares with the one before it, up to limit.

    What Kasai's scan gives, compared eight bytes at a time for all neighbours at once.
    """
    out = np.zeros(len(order), np.int64)
    live = np.arange(1, len(order))
    words, n, done = eight_bytes(data), len(data), 0
    while len(live) and done < limit:
        a, b = order[live - 1] + done, order[live] + done
        inside = (a < n) & (b < n)
        live, a, b = live[inside], a[inside], b[inside]
        differ = words[a] ^ words[b]
        equal = np.full(len(live), 8)
        some = differ != 0
        equal[some] = (63 - np.floor(np.log2(differ[some].astype(np.longdouble))).astype(np.int64)) // 8
        equal = np.minimum(equal, np.minimum(n - a, n - b))
        out[live] = np.minimum(done + equal, limit)
        live = live[equal == 8]
        done += 8
    return out


# ---- one shard

class Shard:
    """A run of documents with the anchors of all strings of `length` bytes. runs: as packed by pack_runs, if known."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, length: int, runs: bytes | None = None):
        self.data, self.offsets, self.ids, self.length = data, offsets, ids, length
        self.owner = np.repeat(np.arange(len(ids), dtype=np.int32), np.diff(offsets))
        self.window = length - GRAM + 1
        n = max(len(data) - length + 1, 0)
        self.valid = self.owner[:n] == self.owner[length - 1:] if n else np.zeros(0, bool)
        self.hash = SpanHasher(data)
        # the anchors rise with the strings: a run of strings has one
        self.starts, self.values = self.runs(n) if runs is None else unpack_runs(runs)
        self.lengths = np.diff(self.starts, append=n)
        some = np.add.reduceat(self.valid, self.starts, dtype=np.int64) > 0 if n else np.zeros(0, bool)
        self.of_run = np.where(some, np.cumsum(some) - 1, -1)
        self.anchors = self.values[some]
        self.gram = self.hash(self.anchors, self.anchors + GRAM)
        self.doc = self.owner[self.anchors]

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First string of each run and its anchor: the leftmost gram with the smallest hash."""
        anchor, step = np.zeros(n, np.int64), max(1 << 15, 4 * self.window)
        low = _U((1 << (step + self.window).bit_length()) - 1)  # the place in the low bits settles ties
        for a in range(0, n, step):
            gram = self.hash.every(GRAM, a, min(n, a + step) + self.window - 1)
            gram = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
            anchor[a:a + step] = (window_min(gram, self.window) & low).astype(np.int64) + a
        starts = np.flatnonzero(np.diff(anchor, prepend=-1))
        return starts, anchor[starts]

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """Hash of all bytes around chosen anchors that a string with this anchor can hold, and of where it stands."""
        at, doc = self.anchors[which], self.doc[which]
        left = np.maximum(self.offsets[doc], at - self.window + 1)
        right = np.minimum(self.offsets[doc + 1], at + self.length)
        return mixed(self.hash(left, right) + mixed((at - left).astype(np.uint64)))

    def strings(self, which: np.ndarray) -> np.ndarray:
        """Positions whose anchor is a chosen one."""
        chosen = np.zeros(len(self.anchors) + 1, bool)  # the last: runs without a string
        chosen[which] = True
        return np.flatnonzero(self.valid & np.repeat(chosen[self.of_run], self.lengths))

    def parts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For strings by their start: hashes of what strings of one anchor and part have in common, and which is whose."""
        anchor = self.values[np.searchsorted(self.starts, at, "right") - 1]
        part = (anchor - at) * PARTS // self.window
        first = np.ones(len(at), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])
        # strings of a part start from `far` to `near` bytes before the anchor
        near, far = -(-part[first] * self.window // PARTS), -(-(part[first] + 1) * self.window // PARTS) - 1
        common = self.hash(anchor[first] - near, anchor[first] - far + self.length)
        return mixed(common + part[first].astype(np.uint64)), np.cumsum(first) - 1

    def covered_here(self) -> np.ndarray:
        """Positions whose string starts in a document of this shard with a smaller id, by the suffix array."""
        out = np.zeros(len(self.valid), bool)
        # a string that occurs twice has an anchor that does: the bytes under such strings, laid one after another
        _, place, times = np.unique(self.gram, return_inverse=True, return_counts=True)
        at = self.strings(np.flatnonzero(times[place] > 1))
        if not len(at):
            return out
        edge = np.zeros(len(self.data) + 1, np.int32)
        edge[at] += 1
        edge[at + self.length] -= 1
        origin = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        part, starts_string = self.data[origin], np.zeros(len(origin), bool)
        starts_string[np.searchsorted(origin, at)] = True
        order, rank = suffix_array(part, self.length)
        # only positions with equals matter, and they stand together
        order = order[np.bincount(rank, minlength=len(rank))[rank[order]] > 1]
        order = order[starts_string[order]]
        starts = common_prefixes(part, order, self.length) < self.length
        if len(order):
            starts[0] = True
            ids = self.ids[self.owner[origin[order]]]
            least = np.minimum.reduceat(ids, np.flatnonzero(starts))[np.cumsum(starts) - 1]
            out[origin[order]] = least < ids
        return out


def pack_runs(starts: np.ndarray, values: np.ndarray) -> bytes:
    return zstandard.compress(np.diff(np.stack([starts, values]), prepend=0).astype(np.int32).tobytes(), 3)


def unpack_runs(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    starts, values = np.cumsum(np.frombuffer(zstandard.decompress(blob), np.int32).reshape(2, -1), axis=1, dtype=np.int64)
    return starts, values


class Keys:
    """Distinct keys of a shard, sorted, with the smallest document id of each."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray | None):
        self.keys, self.place = np.unique(keys, return_inverse=True)
        self.ids = np.zeros(len(self.keys), np.int64)
        if ids is not None and len(keys):
            order = np.argsort(self.place, kind="stable")
            first = np.flatnonzero(np.diff(self.place[order], prepend=-1))
            self.ids = np.minimum.reduceat(ids[order], first)
        self.with_ids = ids is not None

    def ranges(self, bits: int) -> Iterator[tuple[int, bytes]]:
        """(range of keys, packed keys and ids) for every range that has some."""
        number = (self.keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.keys), np.int64)
        for r, a, b in zip(*_groups(number)):
            yield int(r), pack_keys(self.keys[a:b], self.ids[a:b] if self.with_ids else None)

    def answers(self, bits: int, got: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For every key as given: another shard has it; another shard has it in a smaller document."""
        number = (self.keys >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(self.keys), np.int64)
        out = np.zeros((len(self.keys), 2), bool)
        for r, a, b in zip(*_groups(number)):
            if int(r) in got:
                out[a:b] = np.unpackbits(np.frombuffer(got[int(r)], np.uint8), count=2 * (b - a)).reshape(-1, 2)
        out = out[self.place]
        return out[:, 0], out[:, 1]


def _groups(sorted_numbers: np.ndarray):
    start = np.flatnonzero(np.diff(sorted_numbers, prepend=-1)) if len(sorted_numbers) else np.zeros(0, np.int64)
    return sorted_numbers[start], start, np.append(start[1:], len(sorted_numbers)) if len(start) else start


def pack_keys(keys: np.ndarray, ids: np.ndarray | None) -> bytes:
    """Differences of sorted keys, and ids, byte plane by byte plane, compressed."""
    planes = [np.diff(keys, prepend=_U(0))] + ([] if ids is None else [ids.astype(np.int64).view(np.uint64)])
    raw = b"".join(p.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for p in planes)
    return bytes([len(planes)]) + zstandard.compress(raw, 1)


def unpack_keys(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8)
    planes = raw.reshape(blob[0], 8, -1)
    columns = [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]
    return np.cumsum(columns[0], dtype=np.uint64), columns[1].view(np.int64) if len(columns) > 1 else np.zeros(len(columns[0]), np.int64)


def merge_range(rows: pa.Table) -> pa.Table:
    """Merge the sorted keys of all shards in one range; two bits a key in answer, none for keys of one shard only."""
    lists = [unpack_keys(b.as_py()) for b in rows["keys"]]
    keys, ids = (np.concatenate(x) for x in zip(*lists))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    least = np.minimum.reduceat(ids[order], np.flatnonzero(first))[np.cumsum(first) - 1]
    bits = np.zeros((len(keys), 2), bool)  # a shard has a key once
    bits[order, 0] = ~(first & np.append(first[1:], True))
    bits[order, 1] = least < ids[order]
    out, end = [], 0
    for shard, number, (own, _) in zip(rows["shard"].to_pylist(), rows["number"].to_pylist(), lists):
        start, end = end, end + len(own)
        if bits[start:end].any():
            out.append((shard, number, np.packbits(bits[start:end]).tobytes()))
    kinds = (("shard", pa.int64()), ("number", pa.int64()), ("bits", pa.binary()))
    return pa.table({name: pa.array([x[k] for x in out], kind) for k, (name, kind) in enumerate(kinds)})


# ---- all shards

def repeated_strings(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text",
                     shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: id, kept (the bytes that stay), spans (removed runs: start, end in bytes, by start).

    Removed is each byte covered by a `length`-byte string of the UTF-8 text that also starts in a document with a
    smaller id; strings don't cross documents and overlaps count. NULL text is empty. Documents with equal ids don't
    cover each other. A row with a NULL id stays whole and covers nothing. Other columns are left out. An empty table
    gives no rows. Strings of other shards are compared by 64-bit hashes, those of the same shard by their bytes.
    """
    if length < GRAM + 8:
        raise ValueError(f"length must be {GRAM + 8} or more")
    spark = docs.sparkSession
    ready(spark)
    rows = docs.select(quoted(id_col).cast("bigint").alias("id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))
    known = rows.filter("id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(0, int(-(-total // RANGE_BYTES) - 1).bit_length())

    def shards(batches):
        part, count = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            for start, end, texts in text_runs(batch.column(1), shard_bytes):
                data, offsets = utf8(texts)
                ids = np.asarray(batch.column(0).slice(start, end - start), np.int64)
                s = Shard(data, offsets, ids, length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part + count], pa.int64()), pa.array([ids.tobytes()], pa.binary()), pa.array([offsets.tobytes()], pa.binary()),
                     pa.array([zstandard.compress(data.tobytes(), 3)], pa.binary()), pa.array([pack_runs(s.starts, s.values)], pa.binary())],
                    names=["shard", "ids", "offsets", "data", "runs"])
                count += 1

    # a table in buckets by shard: joins with answers move only the answers
    table = f"shards_{uuid.uuid4().hex}"
    buckets = int(max(8, -(-total // (8 * shard_bytes))))
    (known.mapInArrow(shards, "shard bigint, ids binary, offsets binary, data binary, runs binary")
     .write.bucketBy(buckets, "shard").option("path", scratch_path(spark, table)).saveAsTable(table))

    def opened(row) -> Shard:
        return Shard(np.frombuffer(zstandard.decompress(row["data"]), np.uint8), np.frombuffer(row["offsets"], np.int64),
                     np.frombuffer(row["ids"], np.int64), length, row["runs"])

    def state(row, rounds: int):
        """What the answers so far say: the shard, keys of the next round, and what they stand for."""
        s = opened(row)
        got = [dict() for _ in range(ROUNDS)]
        for a in row["answers"] or ():
            got[a["round"]][a["number"]] = a["bits"]
        keys = Keys(s.gram & ~_U(0xFFFF), None)  # 48 bits: a chance match costs a comparison
        if rounds == 0:
            return s, keys, None, None
        which = np.flatnonzero(keys.answers(bits, got[0])[0])
        keys = Keys(s.contexts(which), s.ids[s.doc[which]])
        if rounds == 1:
            return s, keys, None, None
        smaller = keys.answers(bits, got[1])[1]
        covered, which = which[smaller], which[~smaller]
        # of equal contexts in this shard, one speaks for all; the suffix array covers the others
        at = s.strings(which)
        common, part = s.parts(at)
        keys = Keys(common, None)
        if rounds == 2:
            return s, keys, None, None
        at = at[keys.answers(bits, got[2])[0][part]]
        keys = Keys(s.hash(at, at + length), s.ids[s.owner[at]])
        if rounds == 3:
            return s, keys, None, None
        return s, keys.answers(bits, got[3])[1], at, covered

    def send(rounds: int):
        def run(batches):
            for batch in batches:
                for row in _rows(batch):
                    parts = list(state(row, rounds)[1].ranges(bits))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["shard"]] * len(parts), pa.int64()), pa.array([r for r, _ in parts], pa.int64()),
                         pa.array([b for _, b in parts], pa.binary())], names=["shard", "number", "keys"])
        return run

    def finish(batches):
        for batch in batches:
            for row in _rows(batch):
                s, elsewhere, at, contexts = state(row, ROUNDS)
                covered = s.covered_here()
                covered[s.strings(contexts)] = True
                covered[at[elsewhere]] = True
                yield _removed(s, covered)

    answers = None
    for rounds in range(ROUNDS):
        sent = _with_answers(spark, table, answers).mapInArrow(send(rounds), "shard bigint, number bigint, keys binary")
        got = (sent.groupBy("number").applyInArrow(merge_range, "shard bigint, number bigint, bits binary")
               .withColumn("round", F.lit(rounds)))
        path = scratch_path(spark, f"answers-{rounds}")
        got.write.parquet(path)
        got = spark.read.parquet(path)
        answers = got if answers is None else answers.unionByName(got)
    done = _with_answers(spark, table, answers).mapInArrow(finish, "id bigint, kept binary, spans array<struct<start:bigint,end:bigint>>")
    unknown = rows.filter("id is null").select("id", F.encode("text", "UTF-8").alias("kept"),
                                               F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"))
    return done.unionByName(unknown)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows one by one, as a shard's row is large."""
    for k in range(batch.num_rows):
        yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}


def _with_answers(spark, table: str, answers: DataFrame | None) -> DataFrame:
    shards = spark.table(table)
    if answers is None:
        return shards.withColumn("answers", F.lit(None).cast("array<struct<round:int,number:bigint,bits:binary>>"))
    return shards.join(answers.groupBy("shard").agg(F.collect_list(F.struct("round", "number", "bits")).alias("answers")), "shard", "left")


def _removed(s: Shard, covered: np.ndarray) -> pa.RecordBatch:
    """Documents without the bytes under covered strings."""
    edge = np.zeros(len(s.data) + 1, np.int64)
    at = np.flatnonzero(covered)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + s.length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    kept, spans = [], []
    for a, b in zip(s.offsets[:-1].tolist(), s.offsets[1:].tolist()):
        out = gone[a:b]
        kept.append(s.data[a:b][~out].tobytes())
        turn = np.flatnonzero(np.diff(out, prepend=False, append=False)).reshape(-1, 2) if b > a else np.zeros((0, 2), np.int64)
        spans.append([{"start": x, "end": y} for x, y in turn.tolist()])
    return pa.RecordBatch.from_arrays(
        [pa.array(s.ids, pa.int64()), pa.array(kept, pa.binary()),
         pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["id", "kept", "spans"])
