"""Repeated byte strings against brute force, in one shard and across many."""

import random

import numpy as np
import pyarrow as pa
import pytest

from understory.llm import suffixes
from understory.llm.suffixes import common_prefixes, repeated_strings, suffix_array

SCHEMA = "doc_id bigint, text string, kept int, spans int"


def brute(docs, length):
    """Spans and kept bytes of each row, by looking every string up among those of smaller ids."""
    raw = [(d, (t or "").encode()) for d, t in docs]
    out = []
    for d, b in raw:
        earlier = {x[i:i + length] for e, x in raw if d is not None and e is not None and e < d for i in range(len(x) - length + 1)}
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if b[i:i + length] in earlier:
                gone[i:i + length] = [True] * length
        spans, i = [], 0
        while i < len(b):
            if gone[i]:
                j = i
                while j < len(b) and gone[j]:
                    j += 1
                spans.append((i, j))
                i = j
            else:
                i += 1
        out.append((d, bytes(x for x, g in zip(b, gone) if not g), tuple(spans)))
    return sorted(out, key=repr)


def found(spark, docs, **how):
    rows = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], SCHEMA).repartition(3)
    got = repeated_strings(rows, **how).collect()
    return sorted([(r.id, bytes(r.kept), tuple((s.start, s.end) for s in r.spans)) for r in got], key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("abcé ") for _ in range(rng.randint(40, 160))) for _ in range(6)]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            if rng.random() < 0.5:  # an edit, or a part only
                k = rng.randrange(len(p))
                p = p[:k] + rng.choice("xyß") + p[k + 1:] if rng.random() < 0.5 else p[k:]
            parts.append(p if rng.random() < 0.7 else "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 80))))
        out.append("".join(parts))
    return out


@pytest.mark.parametrize(("seed", "shard_bytes"), [(1, 300), (2, 4 << 20), (3, 900)])
def test_as_brute_force(spark, monkeypatch, seed, shard_bytes):
    monkeypatch.setattr(suffixes, "RANGE_BYTES", 4096)
    docs = list(enumerate(texts(seed, 60)))
    docs += [(100 + k, t) for k, (_, t) in enumerate(docs[:8])]  # exact copies
    assert found(spark, docs, shard_bytes=shard_bytes) == brute(docs, 50)


@pytest.mark.parametrize("length", [28, 120])
def test_other_lengths_as_brute_force(spark, length):
    docs = list(enumerate(texts(length, 50)))
    assert found(spark, docs, length=length, shard_bytes=300) == brute(docs, length)


def test_edge_rows(spark):
    long = "".join(random.Random(5).choice("abcdef") for _ in range(4000))
    docs = [(1, None), (2, ""), (3, "a" * 500), (4, "a" * 49), (5, "a" * 50), (5, "a" * 60), (6, long), (7, long[1000:3000]), (None, long), (None, None)]
    assert found(spark, docs, shard_bytes=600) == brute(docs, 50)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    for size in (1, 7, 8, 300):
        data = rng.integers(97, 99, size).astype(np.uint8)
        raw = data.tobytes()
        order, rank = suffix_array(data, 20)
        keys = [raw[i:i + 20].ljust(20, b"\0") for i in order]
        assert keys == sorted(keys)
        assert all((rank[a] == rank[b]) == (raw[a:a + 20] == raw[b:b + 20]) for a in range(min(size, 60)) for b in range(min(size, 60))
                   if a + 20 <= size and b + 20 <= size)
        got = common_prefixes(data, order, 20)
        for k in range(1, size):
            a, b = raw[order[k - 1]:order[k - 1] + 20], raw[order[k]:order[k] + 20]
            assert got[k] == next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_a_shard_reopens_without_looking_for_anchors(monkeypatch):
    docs = [t.encode() for t in texts(7, 40)]
    data, offsets = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
    for length in (28, 50, 200):
        found_ = suffixes.Shard(data, offsets, np.arange(len(docs)), length)
        with monkeypatch.context() as m:
            m.setattr(suffixes.Shard, "runs", None)
            again = suffixes.Shard(data, offsets, np.arange(len(docs)), length, suffixes.pack_runs(found_.starts, found_.values))
        for name in ("valid", "anchors", "gram", "doc"):
            assert getattr(again, name).tolist() == getattr(found_, name).tolist()
        assert again.strings(np.arange(len(again.anchors))).tolist() == np.flatnonzero(again.valid).tolist()


@pytest.mark.parametrize("length", [28, 50, 200])
def test_equal_strings_have_equal_parts(length):
    docs = [t.encode() for t in texts(8, 60)]
    data, offsets = np.frombuffer(b"".join(docs), np.uint8), np.cumsum([0, *map(len, docs)])
    s = suffixes.Shard(data, offsets, np.arange(len(docs)), length)
    at = np.flatnonzero(s.valid)
    common, part = s.parts(at)
    seen = {}
    for start, key in zip(at.tolist(), common[part].tolist()):
        assert seen.setdefault(data[start:start + length].tobytes(), key) == key
    assert len(seen) < len(at) and len(common) < len(at)


def test_strings_of_parts_that_no_other_shard_has_are_not_sent(spark, monkeypatch):
    """A gram of 20 bytes in many documents, other bytes around it: no string is shared, so none needs to be sent."""
    rng = random.Random(9)
    docs = [(k, "".join(rng.choice("abcdefghijklmnop") for _ in range(60)) + " the same twenty bytes! " + "".join(rng.choice("abcdefghijklmnop") for _ in range(60)))
            for k in range(40)]
    with_ids = spark.createDataFrame(docs, "doc_id bigint, text string")
    sent = []
    groups = type(with_ids.groupBy())
    own = groups.applyInArrow

    def counted(self, f, schema):
        rows = own(self, lambda t: pa.table({"n": pa.array([sum(len(suffixes.unpack_keys(b.as_py())[0]) for b in t["keys"])], pa.int64())}), "n bigint").collect()
        sent.append(sum(r.n for r in rows))
        return own(self, f, schema)

    monkeypatch.setattr(groups, "applyInArrow", counted)
    assert [r.spans for r in repeated_strings(with_ids, shard_bytes=400).collect()] == [[]] * 40
    assert len(sent) == 4 and sent[0] > 0 and sent[3] == 0
