"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from understory.llm.text import SpanHasher, quoted, ready, run_hash, text_runs, utf8, window_min, word_spans

#: Runs of ASCII letters, digits and all bytes of other characters, after lower-casing A-Z.
_INSIDE = np.array([48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
GRAM = 5
#: Benchmark words in one block; blocks are broadcast, and texts pass through them one after another.
BLOCK_WORDS = 1 << 21


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each text's first word (one more than there are texts)."""
    data, offsets = utf8(texts)
    starts, ends, first = word_spans(data, offsets, _INSIDE)
    return SpanHasher(data, lower=True)(starts, ends), first


def fingerprints(words: np.ndarray, first: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing: of every w consecutive k-grams of a text, the smallest hash; (positions, hashes), each position once.

    Two texts that share a run of w + k - 1 words share a fingerprint inside it. Ties all count, so equal runs select
    equal grams.
    """
    gram = run_hash(words, k)
    if len(gram) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = window_min(gram, w)
    # windows that lie within one text
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = owner[:len(least)] == owner[w + k - 2:w + k - 2 + len(least)]
    # a gram is chosen if it equals the minimum of a window that holds it
    reach = np.full(len(gram), True)
    biggest = np.uint64(0xFFFFFFFFFFFFFFFF)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), np.where(inside, least, np.uint64(0)), np.zeros(w - 1, np.uint64)])
    reach = biggest - window_min(biggest - padded, w)  # the largest minimum among the windows that hold the gram
    at = np.flatnonzero((reach == gram) & (gram > 0))
    return at, gram[at]


@dataclass
class ItemBlock:
    """Items of a benchmark as word hashes, with their fingerprints."""
    ids: np.ndarray
    words: np.ndarray
    first: np.ndarray
    span: int

    def __post_init__(self):
        n = np.diff(self.first)
        long = n >= self.span
        keep = np.repeat(long, n)
        # fingerprints of items with a full window; positions in the block's words
        begin = np.concatenate([[0], np.cumsum(n[long])])
        at, marks = fingerprints(self.words[keep], begin, GRAM, self.span - GRAM + 1)
        at = np.flatnonzero(keep)[at] if len(at) else at
        order = np.argsort(marks, kind="stable")
        self.marks, self.places = marks[order], at[order]
        self.item_of = np.repeat(np.arange(len(n)), n)
        #: shorter items by length: hash of the whole, item
        self.short = {}
        for size in np.unique(n[(n > 0) & ~long]).tolist():
            items = np.flatnonzero(n == size)
            hashes = np.array([run_hash(self.words[a:a + size], size)[0] for a in self.first[items]], np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.short[size] = hashes[order], items[order]

    def hits(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, item) of every maximal run of words that full windows, or a short item, share with an item."""
        found = [self._long(words, first)]
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        for size, (hashes, items) in self.short.items():
            gram = run_hash(words, size)
            if not len(gram):
                continue
            lo, hi = np.searchsorted(hashes, gram, "left"), np.searchsorted(hashes, gram, "right")
            at = np.flatnonzero((hi > lo) & (owner[:len(gram)] == owner[size - 1:size - 1 + len(gram)]))
            many = hi[at] - lo[at]
            start = np.repeat(at, many)
            pick = np.repeat(lo[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
            found.append((start, start + size, items[pick]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _long(self, words, first):
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, marks = fingerprints(words, first, GRAM, self.span - GRAM + 1)
        if not len(at) or not len(self.marks):
            return none
        lo, hi = np.searchsorted(self.marks, marks, "left"), np.searchsorted(self.marks, marks, "right")
        some = hi > lo
        at, lo, many = at[some], lo[some], (hi - lo)[some]
        here = np.repeat(at, many)
        there = self.places[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
        # all hits on one diagonal of one text and item extend to the same run, unless another run lies between
        text = np.searchsorted(first, here, "right") - 1
        item = self.item_of[there]
        out = set()
        last = {}
        order = np.lexsort((here, here - there, item, text))
        for h, t, d, i in zip(here[order].tolist(), there[order].tolist(), text[order].tolist(), item[order].tolist()):
            key = (d, i, h - t)
            if last.get(key, -1) > h:
                continue
            a, b = self._extend(words, h, t, int(first[d]), int(first[d + 1]), int(self.first[i]), int(self.first[i + 1]))
            last = {key: b}
            if b - a >= self.span:
                out.add((a, b, i))
        if not out:
            return none
        return tuple(np.array(x, np.int64) for x in zip(*sorted(out)))

    def _extend(self, words, h, t, lo, hi, item_lo, item_hi) -> tuple[int, int]:
        """The run around a hit over which the text's words equal the item's."""
        left = min(h - lo, t - item_lo)
        differs = np.flatnonzero(words[h - left:h] != self.words[t - left:t])
        a = h - left + (differs[-1] + 1 if len(differs) else 0)
        right = min(hi - h, item_hi - t)
        differs = np.flatnonzero(words[h:h + right] != self.words[t:t + right])
        return int(a), int(h + (differs[0] if len(differs) else right))


def item_blocks(items: DataFrame, span: int, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS):
    """The benchmark in blocks of about block_words words; items without words and NULL ids are left out.

    Rows come to the driver one partition's batch at a time, and only as hashes; the last block may be smaller, and a
    single longer item is a block of its own.
    """
    rows = items.select(quoted(id_col).cast("string").alias("id"), quoted(text_col).alias("text")).filter("id is not null and text is not null")

    def hashed(batches):
        for batch in batches:
            for start, end, texts in text_runs(batch.column(1)):
                words, first = word_hashes(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, end - start), pa.array([words[a:b].tobytes() for a, b in zip(first, first[1:])], pa.binary())],
                    names=["id", "words"])

    ids, parts, have = [], [], 0

    def block():
        return ItemBlock(np.array(ids, object), np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), span)

    for row in rows.mapInArrow(hashed, "id string, words binary").toLocalIterator():
        words = np.frombuffer(row.words, np.uint64)
        if not len(words):
            continue
        if parts and have + len(words) > block_words:
            yield block()
            ids, parts, have = [], [], 0
        ids.append(row.id)
        parts.append(words)
        have += len(words)
    if parts:
        yield block()


def benchmark_hits(docs: DataFrame, items: DataFrame, span: int = 13, text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit (words inside a shared window) and items (distinct ids as sorted strings).

    A window is `span` consecutive words of an item, or all words of a shorter one. Fingerprints of texts and items are
    joined, and each hit is extended to the whole shared run; winnowing guarantees a fingerprint in every run of `span`
    words. The benchmark is broadcast in blocks of bounded size and the texts pass through them where they lie, so
    nothing is shuffled; whole texts of any length are read. NULL texts have no words. Rows and other columns are kept
    (columns named like the new ones are replaced); NULL items, items without words and an empty benchmark hit nothing.
    Words are compared by 64-bit hashes.
    """
    if span < GRAM:
        raise ValueError(f"span must be {GRAM} or more")
    ready(docs.sparkSession)
    new = ["n_words", "n_hit", "items"]
    kept = docs.drop(*new)
    at = kept.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    names_out = [*kept.columns, *new]
    blocks = [docs.sparkSession.sparkContext.broadcast(b) for b in item_blocks(items, span, item_col, item_text_col, block_words)]

    def run(batches):
        for batch in batches:
            n_words, n_hit, names = [], [], []
            for _, _, texts in text_runs(batch.column(at)):
                words, first = word_hashes(texts)
                n_words += np.diff(first).tolist()
                edge = np.zeros(len(words) + 1, np.int64)
                found: dict[int, set[str]] = {}
                for shared in blocks:
                    start, end, item = shared.value.hits(words, first)
                    np.add.at(edge, start, 1)
                    np.add.at(edge, end, -1)
                    for d, i in zip((np.searchsorted(first, start, "right") - 1).tolist(), item.tolist()):
                        found.setdefault(d, set()).add(shared.value.ids[i])
                hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
                n_hit += (hit[first[1:]] - hit[first[:-1]]).tolist()
                names += [sorted(found.get(d, ())) for d in range(len(texts))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(names, pa.list_(pa.string()))],
                names=names_out)

    return kept.mapInArrow(run, f"{schema}, n_words bigint, n_hit bigint, items array<string>")


def contaminated():
    """The rule: some word is hit, and a twentieth of all words or more."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))
